"""Operator 8: chat formatting by schema fingerprints.

A record arrives as JSON in one of several layouts. Its fingerprint is the hash of its sorted distinct
nested field paths (``messages[].role``); the fingerprint selects a declarative mapping that turns the record into canonical
turns. A fingerprint that is no layout's own belongs to the first layout, in a fixed order, all of whose paths it has, so
further fields of any name don't hide a layout.

The template marks turns with control strings. Inside texts, a backslash goes before each backslash and behind the first
character of each control string, so no text can close its turn, and removing the inserted backslashes gives the text
back. ``parse`` reads the turns and the loss mask (the assistants' texts, without their marks) back from the output.

Null texts are empty. A conversation's rows go by turn (null first), then role and text; repeated rows stay repeated turns. Null
roles are empty strings. Rows with a null conv_id form one conversation with a null id. Texts that are no strings become JSON, lists of
text parts are joined. A record that is null, no JSON, no object or of an unknown layout gives no turns: ``layout`` is null, the formatted text empty
and ``reject`` names the reason (``rejects`` counts them). One conversation is one output text, so it must fit a row.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import read


@dataclass(frozen=True)
class Layout:
    """A record layout: turns as (role, path) in order, or a list of turns with the fields that hold role and text."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.items:
            return [f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"]
        return [p for _, p in self.fields]


#: In order of precedence: the first whose paths a record has is its layout.
LAYOUTS = (
    Layout("messages", items="messages", role="role", text="content"),
    Layout("turns", items="turns", role="speaker", text="text"),
    Layout("conversations", items="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("system_prompt", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction_input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt", (("user", "prompt"), ("assistant", "response"))),
    Layout("question", (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", (("user", "instruction"), ("assistant", "output"))),
)


def field_paths(record: object, at: str = "") -> set[str]:
    """The nested paths of a record's values; elements of lists share a path, an empty list is marked as such."""
    if isinstance(record, dict):
        return {p for k, v in record.items() for p in field_paths(v, f"{at}.{k}" if at else k)} or {at + "{}"}
    if isinstance(record, list):
        return {p for v in record for p in field_paths(v, at + "[]")} or {at + "[]#"}
    return {at}


def fingerprint(paths: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _has(paths: set[str], path: str) -> bool:
    return any(p == path or p.startswith((path + ".", path + "[", path + "{")) for p in paths)


def layout_of(paths: set[str]) -> Layout | None:
    """The first layout whose paths are all there; a list of turns must hold nothing but objects."""
    for x in LAYOUTS:
        if x.items and f"{x.items}[]#" in paths:
            return x
        if x.items and (f"{x.items}[]" in paths or any(p.startswith(f"{x.items}[][") for p in paths)):
            continue
        if all(_has(paths, p) for p in x.paths()):
            return x
    return None


#: Layouts by fingerprint; fingerprints with further fields are added as they are met, MOST_KNOWN at most.
MAPPINGS: dict[str, Layout | None] = {fingerprint(x.paths()): x for x in LAYOUTS}
MOST_KNOWN = 10_000


def _as_text(value: object) -> str:
    """Strings as they are, null as empty, a list of text parts joined, anything else as JSON with sorted keys."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        parts = [v if isinstance(v, str) else v.get("text") if isinstance(v, dict) else None for v in value]
        if all(isinstance(p, str) for p in parts):
            return "".join(parts)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def canonical_turns(record: object) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout name, (role, text) of each turn) of a record; no layout: (None, [])."""
    if not isinstance(record, dict):
        return None, []
    paths = field_paths(record)
    key = fingerprint(paths)
    if key not in MAPPINGS:
        if len(MAPPINGS) >= MOST_KNOWN:
            MAPPINGS.clear()
        MAPPINGS[key] = layout_of(paths)
    layout = MAPPINGS[key]
    if layout is None:
        return None, []
    if layout.items:
        roles = dict(layout.roles)
        turns = [(_as_text(x.get(layout.role)), _as_text(x.get(layout.text))) for x in record[layout.items]]
        return layout.name, [(roles.get(r, r), t) for r, t in turns]
    return layout.name, [(role, _as_text(record[p])) for role, p in layout.fields]


#: Opening and closing marks of the turns of each role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = re.compile(r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|[a-z_]+\|>")
_INSERTED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<<SYS>>(.*?)<</SYS>>|\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|<\|role\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _INSERTED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> str:
    out = []
    for role, text in turns:
        if role in MARKS:
            out += [MARKS[role][0], escape(text), MARKS[role][1]]
        else:
            out += ["<|role|>", escape(role), "<|text|>", escape(text), "<|end|>"]
    return "".join(out)


def parse(formatted: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """The turns of a formatted conversation and its loss mask, as (begin, end) of code points."""
    turns, mask, at = [], [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        at = m.end()
        if m.lastindex == 5:
            turns.append((unescape(m[4]), unescape(m[5])))
        else:
            turns.append((("system", "user", "assistant")[m.lastindex - 1], unescape(m[m.lastindex])))
            if m.lastindex == 3:
                mask.append(m.span(3))
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns, mask


_FORMATTED = "conv_id long, layout string, formatted string, mask array<struct<begin:int,end:int>>, reject string"


def read_record(text: str | None) -> tuple[str | None, list[tuple[str, str]], str | None]:
    """(layout name, turns, null or why the record is rejected) of a record's JSON text."""
    if text is None:
        return None, [], "null"
    try:
        record = json.loads(text)
        if not isinstance(record, dict):
            return None, [], "no object"
        name, turns = canonical_turns(record)
    except (ValueError, RecursionError):
        return None, [], "no JSON"
    return name, turns, None if name else "unknown layout"


def _format(batches):
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("conv_id", pa.int64()), ("layout", pa.string()), ("formatted", pa.string()), ("mask", pa.list_(span)), ("reject", pa.string())])
    for batch in batches:
        rows = []
        for conv, record in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
            name, turns, reject = read_record(record)
            # half a pair of surrogates, which JSON can escape, is no character
            text = render([(r.encode("utf-8", "replace").decode(), t.encode("utf-8", "replace").decode()) for r, t in turns])
            rows.append((conv, name, text, [{"begin": a, "end": b} for a, b in parse(text)[1]], reject))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(5)], schema=schema)


def format_records(records: DataFrame) -> DataFrame:
    """(conv_id, layout, formatted, mask, reject) of records (conv_id, record: JSON text)."""
    return records.select(F.col("conv_id").cast("long"), "record").mapInArrow(_format, _FORMATTED)


def rejects(formatted: DataFrame) -> DataFrame:
    """(reject, n): how many records were rejected, by reason."""
    return formatted.filter("reject IS NOT NULL").groupBy("reject").agg(F.count("*").alias("n"))


def records_of(conversations: DataFrame) -> DataFrame:
    """Conversations (rows by turn) as records (conv_id, record): a user's and an assistant's turn in the prompt
    layout, with a system's turn before them in its layout, others as messages."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")
    rows = conversations.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), role, text).alias("m"))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    roles = F.transform("m", lambda x: x["role"])
    content = lambda i: F.col("m")[i]["content"]
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(content(0).alias("prompt"), content(1).alias("response"))))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(F.struct(content(0).alias("system"), content(1).alias("prompt"), content(2).alias("response"))))
        .otherwise(F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))))
    )
    return each.select("conv_id", record.alias("record"))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    for batch in batches:
        rows = []
        for conv, text, mask in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True):
            turns, _ = parse(text)
            told = "".join(f"{role}\n{said}\n" for role, said in turns)
            loss = "".join(unescape(text[m["begin"] : m["end"]]) for m in mask)
            rows.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, as counts and digests."""
    return formatted.select("conv_id", "formatted", "mask").mapInArrow(_digest, _DIGEST)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_records(records_of(rows)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|[a-z_]+\|>'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
      ELSE 23 + length(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|[a-z_]+\|>')) END AS f
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(f) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
