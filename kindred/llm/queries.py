"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, line_dedup, substring_dedup
from .chat_format import op8_chat_format
from .decontaminate import op1_decontaminate
from .language_id import op6_language_id
from .line_dedup import op2_line_dedup
from .mixing import op5_mix_sources
from .near_dup import op3_near_duplicates
from .neighbours import op4_nearest_neighbours
from .substring_dedup import op7_substring_dedup
from .token_counts import op10_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_mix_sources": op5_mix_sources,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op8_chat_format": chat_format.SQL,
}
