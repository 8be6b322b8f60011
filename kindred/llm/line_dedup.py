"""Operator 2: line dedup by a log-template tree of fixed depth.

A line's words are parsed as in Drain (He et al., 2017), in a form that needs no order of arrival: words with a digit are
variable (``<*>``); the tree leads by the number of words and the first ``LEADING`` words to a leaf. In a leaf,
a word is constant at its position if lines of at least ``MIN_DOCS`` documents have it there, otherwise the position
is variable. So a field that varies (a name, a date, a number) becomes a wildcard, while its template's other
words stay. A line with at least ``CONSTANT`` constant positions belongs to the template they form; a template
of at least ``MIN_DOCS`` documents recurs, and its lines are dropped from all documents but the one with the smallest id.

Beside the generalised templates, a line whose exact words recur in ``MIN_DOCS`` documents is a template of its own, however short it is and
however many of its words hold digits. Lines of fewer than ``MIN_WORDS`` words are never generalised.

Lines end at line feeds. Nothing of a row with a null id is dropped. Rows that share an id are one document here: what is dropped from one
is dropped from all. Null texts stay null and have no lines; kept lines stay as they are. Blank lines are neither counted nor dropped. All
aggregates combine before they shuffle; the words of a line are taken from one of its documents, and only texts that lose something are
shuffled, to meet what they lose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._shared import id_filter, parted, read, stage, unstage, with_lists

LEADING = 3
MIN_WORDS = 3
MIN_DOCS = 10
#: The least share of constant positions, in percent.
CONSTANT = 60
_VARIABLE = np.uint64(0x2A2A2A2A2A2A2A2B)
#: Names of columns that stand beside those of the input.
_LOST, _DOC = "_kindred_lost", "_kindred_doc"
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class Lines:
    """The lines with words of a batch of texts: text, line number within the text, words, leaf and hash of the masked words."""

    def __init__(self, texts: pa.Array):
        data, off = X.buffers(texts)
        words, first, begin, end = X.word_hashes(texts)
        digits = np.append(0, np.cumsum(_DIGIT[data]))
        digit = digits[end] > digits[begin]
        self.words = np.where(digit, _VARIABLE, words)
        feeds = np.flatnonzero(data == 10)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        number = np.searchsorted(feeds, begin)
        new = np.ones(len(words), bool)
        new[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
        self.at = np.flatnonzero(new)
        self.count = np.diff(np.append(self.at, len(words)))
        self.text = owner[self.at]
        self.number = number[self.at] - np.searchsorted(feeds, off[self.text])
        power, inverse = X._power_tables(len(words) + 1)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(X.mix(self.words) * power[: len(words)], out=total[1:])
        n = self.count.astype(np.uint64)
        self.line = X.mix((total[self.at + self.count] - total[self.at]) * inverse[self.at] + n)
        lead = n * X._GRAM[0]
        for k in range(LEADING):
            lead = lead + np.where(self.count > k, self.words[np.minimum(self.at + k, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(1)) * X._GRAM[k + 1]
        self.leaf = X.mix(lead)
        self.long = self.count >= MIN_WORDS
        #: Hash of the words as they are, and whether none of them holds a digit.
        np.cumsum(X.mix(words ^ np.uint64(0x5851F42D4C957F2D)) * power[: len(words)], out=total[1:])
        self.exact = X.mix((total[self.at + self.count] - total[self.at]) * inverse[self.at] + n)
        masked = np.append(0, np.cumsum(digit))
        self.plain = masked[self.at + self.count] == masked[self.at]


_LINES = pa.schema([("exact", pa.bool_()), ("plain", pa.bool_()), ("leaf", pa.int64()), ("line", pa.int64()), ("doc", pa.int64())])


def _parse(batches):
    """Each document's distinct long lines (masked), and its lines that are short or hold digits (exact); exact words of other lines are the masked ones."""
    for batch in batches:
        for part in X.slices(batch):
            x = Lines(part.column("text"))
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)
            for exact, rows, line in ((False, np.flatnonzero(x.long), x.line), (True, np.flatnonzero(~x.long | ~x.plain), x.exact)):
                _, once = np.unique(X.mix(line[rows] ^ X.mix(x.text[rows].astype(np.uint64))), return_index=True)
                rows = rows[once]
                n = len(rows)
                leaf = np.zeros(n, np.int64) if exact else X.signed(x.leaf[rows])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, exact)), pa.array(x.plain[rows]), pa.array(leaf), pa.array(X.signed(line[rows])), pa.array(doc[x.text[rows]].astype(np.int64))], schema=_LINES)


def _words_of(batches):
    """The words of the listed lines of each document."""
    schema = pa.schema([("leaf", pa.int64()), ("line", pa.int64()), ("words", pa.list_(pa.int64()))])
    for batch in batches:
        for part in X.slices(batch):
            x = Lines(part.column("text"))
            lists = part.column("lines")
            owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.uint64)
            wanted = X.mix(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ X.mix(owner))
            rows = np.flatnonzero(x.long)
            rows = rows[np.isin(X.mix(x.line[rows] ^ X.mix(x.text[rows].astype(np.uint64))), wanted)]
            _, once = np.unique(x.line[rows], return_index=True)
            rows = rows[once]
            count = x.count[rows]
            i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            words = pa.array(X.signed(x.words[np.repeat(x.at[rows], count) + i]))
            made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), words)
            yield pa.RecordBatch.from_arrays([pa.array(X.signed(x.leaf[rows])), pa.array(X.signed(x.line[rows])), made], schema=schema)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, line): hashes (masked or exact) of the lines that each document of docs (doc_id, text) loses."""
    parsed = stage(docs.mapInArrow(_parse, "exact boolean, plain boolean, leaf long, line long, doc long").distinct(), "lines")
    masked = parsed.filter("NOT exact").select("leaf", "line", "plain", "doc")
    leaves = stage(masked.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf"), "leaves")
    inside = stage(masked.hint("merge").join(leaves.hint("merge"), "leaf"), "candidates")
    weights = stage(inside.groupBy("leaf", "line").agg(F.count("*").alias("w"), F.min("doc").alias("source"), F.first("plain").alias("plain")), "weights")
    # lines whose exact words recur
    exact = parsed.filter("exact").groupBy("line").agg(F.count("*").alias("docs"), F.min("doc").alias("first")).filter(F.col("docs") >= min_docs).select("line", "first")
    exact = exact.unionByName(weights.filter((F.col("w") >= min_docs) & F.col("plain")).select("line", F.col("source").alias("first")))
    exact = stage(exact, "exact")
    own = parsed.filter("exact OR plain").select("doc", "line").hint("merge").join(exact.hint("merge"), "line").filter("doc <> first").select("doc", "line")
    # the words of each line, from its smallest document
    places = stage(weights.groupBy("source").agg(F.collect_list("line").alias("lines")), "places")
    words = with_lists(docs.select("doc_id", "text"), places, "source").mapInArrow(_words_of, "leaf long, line long, words array<long>")
    words = words.groupBy("leaf", "line").agg(F.first("words").alias("words"))
    weighed = stage(words.hint("merge").join(weights.select("leaf", "line", "w").hint("merge"), ["leaf", "line"]), "weighed")
    each = weighed.select("leaf", "line", "w", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word")).filter(F.col("word") != int(_VARIABLE.view(np.int64)))
    heavy = stage(each.groupBy("leaf", "pos", "word").agg(F.sum("w").alias("docs")).filter(F.col("docs") >= min_docs).select("leaf", "pos", "word"), "constants")
    fixed = each.hint("merge").join(heavy.hint("merge"), ["leaf", "pos", "word"]).groupBy("leaf", "line", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("t"))
    template = fixed.filter(F.size("t") * 100 >= F.col("n") * CONSTANT).select("leaf", "line", F.xxhash64("leaf", "t").alias("template"))
    template = stage(template, "templates")
    of_docs = stage(inside.select("leaf", "line", "doc").hint("merge").join(template.hint("merge"), ["leaf", "line"]).select("template", "doc", "line"), "occurrences")
    found = of_docs.groupBy("template", "doc").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("docs"), F.min("doc").alias("first")).filter(F.col("docs") >= min_docs)
    found = stage(found.select("template", "first"), "recurring")
    out = stage(of_docs.hint("merge").join(found.hint("merge"), "template").filter("doc <> first").select("doc", "line").union(own).distinct(), "lost")
    unstage(parsed, leaves, inside, weights, exact, places, weighed, heavy, template, of_docs, found)
    return out


def without_lines(text: str, lost: set[int]) -> tuple[str, int]:
    """(the text without the lines whose hashes are lost, number of dropped lines)."""
    x = Lines(pa.array([text]))
    masked, exact = X.signed(x.line).tolist(), X.signed(x.exact).tolist()
    gone = {int(k) for k, h, e, ok, plain in zip(x.number, masked, exact, x.long, x.plain, strict=True) if (ok and h in lost) or ((not ok or not plain) and e in lost)}
    return "\n".join(s for k, s in enumerate(text.split("\n")) if k not in gone), len(gone)


def _rewrite(batches):
    for batch in batches:
        texts, dropped = [], []
        for text, lost in zip(batch.column("text").to_pylist(), batch.column(_LOST).to_pylist(), strict=True):
            kept, n = without_lines(text, set(lost)) if text and lost else (text, 0)
            texts.append(kept)
            dropped.append(n)
        out = batch.drop_columns([_LOST])
        at = out.schema.get_field_index("text")
        yield out.set_column(at, "text", pa.array(texts, pa.string())).append_column("n_dropped", pa.array(dropped, pa.int64()))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (all columns, with doc_id long and text) without recurring lines, and the number of lines dropped as n_dropped (in place of a column of that name)."""
    lost = recurring_lines(docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL"), min_docs)
    sets = stage(lost.groupBy(F.col("doc").alias(_DOC)).agg(F.collect_list("line").alias(_LOST)), "losses")
    unstage(lost)
    docs = docs.drop("n_dropped")
    hit, rest = parted(docs, id_filter(sets, _DOC))
    joined = hit.hint("merge").join(sets.hint("merge"), hit.doc_id == sets[_DOC], "left").drop(_DOC)
    out = joined.mapInArrow(_rewrite, T.StructType([*docs.schema.fields, T.StructField("n_dropped", T.LongType())]))
    return out.unionByName(rest.withColumn("n_dropped", F.lit(0).cast("long")))


def _digest(batches):
    import hashlib

    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        dropped = batch.column("n_dropped").to_pylist()
        lines = [n + sum(1 for s in t.encode().split(b"\n") if s.split()) for t, n in zip(texts, dropped, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), batch.column("n_dropped"), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())], names=names)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return dedup_lines(docs).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), c AS (SELECT DISTINCT doc_id, w FROM l WHERE len(w) >= 3),
t AS (SELECT w, len(w) AS n, w[1:3] AS lead, count(*) AS k FROM c GROUP BY w),
e AS (SELECT w, n, lead, k, unnest(range(1, n + 1)) AS pos, unnest(w) AS word FROM t),
heavy AS (SELECT n, lead, pos, word FROM e WHERE word <> '<*>' GROUP BY n, lead, pos, word HAVING sum(k) >= 10),
fixed AS (
  SELECT e.w, e.n, e.lead, list(struct_pack(p := e.pos, v := e.word) ORDER BY e.pos) AS template
  FROM e JOIN heavy USING (n, lead, pos, word) GROUP BY e.w, e.n, e.lead HAVING count(*) * 100 >= e.n * 60
), rec AS (
  SELECT n, lead, template, min(doc_id) AS first FROM c JOIN fixed USING (w) GROUP BY n, lead, template HAVING count(DISTINCT doc_id) >= 10
), lost AS (
  SELECT DISTINCT c.doc_id, c.w FROM c JOIN fixed USING (w) JOIN rec USING (n, lead, template) WHERE c.doc_id <> rec.first
), own AS (
  SELECT DISTINCT l.doc_id, raw FROM l JOIN (SELECT raw, min(doc_id) AS first FROM l WHERE len(raw) > 0 GROUP BY raw HAVING count(DISTINCT doc_id) >= 10) x USING (raw) WHERE l.doc_id <> x.first
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (lost.w IS NULL AND own.raw IS NULL) AS text,
    count(*) FILTER (len(l.w) > 0) AS n_lines, count(*) FILTER (lost.w IS NOT NULL OR own.raw IS NOT NULL) AS n_dropped
  FROM l LEFT JOIN lost ON l.doc_id = lost.doc_id AND l.w = lost.w LEFT JOIN own ON l.doc_id = own.doc_id AND l.raw = own.raw GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
