"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size: class c holds those of 2^c to 2^(c + 1) - 1 distinct shingles. A class fixes how many MinHash samples an item
has: its shingles of smallest hash, a few (``SPARE``) more than a document that contains an item of the class may lack. A document that
contains an item of q shingles lacks at most a = q - ceil(t q) of them, so it has at least k - a of the item's k samples: documents
with as many are candidates, and no occurrence is missed, however short the item, long the document or scattered the copy.

* Every shingle of a text is looked up among the samples, wherever in the text it stands.
* Candidates (document, item) are decided on full sets: |item and document| / |item| >= t, over the whole document.

The benchmark is measured first. Up to ``MOST_ITEMS`` items and ``MOST_BYTES`` of text are broadcast. A larger one stays distributed: documents'
shingles that may be samples (a bitmap of bounded size says so) are joined with the samples, and candidates with the full sets.

Nulls and texts without words contain nothing; items without words match nothing. Texts and items with fewer than five
words are one shingle. Repeated rows of documents give repeated pairs; repeated items are items of their own; items with a null id or text
are none. Other columns of the inputs are ignored. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._shared import passes, read, stage, unstage

THRESHOLD = 0.8
#: A benchmark up to this size is broadcast.
MOST_ITEMS, MOST_BYTES = 20_000, 16 << 20
#: Samples beyond those that a containing document may lack.
SPARE = 4
#: Bits of the filter that a text's shingles pass before they are searched among the samples.
FILTER_BITS = 1 << 24


def least_common(n: int, containment: float) -> int:
    """The least number of common shingles that the verdict accepts, in its own floating point."""
    return next(c for c in range(max(0, math.floor(containment * n) - 1), n + 2) if c >= containment * n)


def samples(s: np.ndarray, containment: float) -> tuple[np.ndarray, int]:
    """(the MinHash samples of an item's set, how many of them a containing document has at least)."""
    n = len(s)
    largest = (1 << n.bit_length()) - 1
    k = min(n, largest - max(least_common(largest, containment), 1) + SPARE)
    order = np.argsort(X.mix(s ^ np.uint64(0x6A09E667F3BCC909)), kind="stable")
    return s[order[:k]], k - (n - max(least_common(n, containment), 1))


class Items:
    """Broadcast items: sets, and a lookup of their samples."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], containment: float):
        self.ids, self.sets = ids, sets
        made = [samples(s, containment) for s in sets]
        grams = np.concatenate([*(m[0] for m in made), np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), [len(m[0]) for m in made])
        self.need = np.array([m[1] for m in made], np.int64)
        order = np.argsort(grams, kind="stable")
        self.samples, self.owner = grams[order], owner[order]
        self.filter = np.zeros(FILTER_BITS, bool)
        self.filter[self.samples & np.uint64(FILTER_BITS - 1)] = True

    def candidates(self, grams: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) of texts whose shingles are grams[first : first + count], in order."""
        may = np.flatnonzero(self.filter[grams & np.uint64(FILTER_BITS - 1)])
        lo, hi = np.searchsorted(self.samples, grams[may], "left"), np.searchsorted(self.samples, grams[may], "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        begins = np.argsort(first, kind="stable")
        begins = begins[count[begins] > 0]
        text = begins[np.searchsorted(first[begins], may[hit], "right") - 1]
        # a shingle counts once in a text
        _, once = np.unique(text * np.int64(len(self.samples)) + lo[hit], return_index=True)
        text, lo, times = text[once], lo[hit][once], (hi - lo)[hit][once]
        at = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
        pair, found = np.unique(np.repeat(text, times) * np.int64(len(self.ids)) + self.owner[at], return_counts=True)
        item = pair % len(self.ids)
        enough = found >= self.need[item]
        return list(zip((pair[enough] // len(self.ids)).tolist(), item[enough].tolist(), strict=True))


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingle hashes in order, with the first and the number of each text's."""
    words, at, _, _ = X.word_hashes(texts, lower=True)
    n = np.diff(at)
    grams = X.gram_hashes(words, X.SHINGLE)
    count = np.maximum(n - X.SHINGLE + 1, 0)
    first = at[:-1].copy()
    short = np.flatnonzero((n > 0) & (n < X.SHINGLE))
    if len(short):
        first[short] = len(grams) + np.arange(len(short))
        count[short] = 1
        grams = np.concatenate([grams, *(X.short_shingle(words[at[i] : at[i + 1]]) for i in short)])
    return grams, first, count


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_common", pa.int64()), ("containment", pa.float64())])


_DDL = "doc_id long, item_id long, n_item long, n_common long, containment double"


def _rows(items: Items, containment: float, texts: pa.Array, names: list) -> list[tuple]:
    grams, first, count = _shingles(texts)
    rows, own = [], (-1, None)
    for t, i in items.candidates(grams, first, count):
        if own[0] != t:
            own = t, np.unique(grams[first[t] : first[t] + count[t]])
        common = int(np.isin(items.sets[i], own[1], assume_unique=True).sum())
        if common >= containment * len(items.sets[i]):
            rows.append((names[t], items.ids[i], len(items.sets[i]), common, common / len(items.sets[i])))
    return rows


def _search(shared, containment: float):
    def run(batches):
        for batch in batches:
            for part in X.slices(batch):
                rows = _rows(shared.value, containment, part.column("text"), part.column("doc_id").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _SCHEMA.field(k).type) for k in range(5)], schema=_SCHEMA)

    return run


def _clean(shared, containment: float):
    def run(batches):
        for batch in batches:
            for part in X.slices(batch):
                bad = np.zeros(part.num_rows, bool)
                bad[[r[0] for r in _rows(shared.value, containment, part.column("text"), list(range(part.num_rows)))]] = True
                yield part.filter(pa.array(~bad))

    return run


def broadcast_items(items: DataFrame, containment: float):
    """The items as a broadcast, if their measured size allows; None if not."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size["n"] > MOST_ITEMS or size["bytes"] > MOST_BYTES:
        return None
    rows = sorted((r["item_id"], r["text"]) for r in items.collect())
    sets = list(X.shingle_sets(pa.array([t for _, t in rows], pa.string())))
    full = [k for k, s in enumerate(sets) if len(s)]
    return items.sparkSession.sparkContext.broadcast(Items([rows[k][0] for k in full], [sets[k] for k in full], containment))


def _item_sets(containment: float):
    """Each item's shingles, with those that are samples marked and what a document needs of them."""

    def run(batches):
        schema = pa.schema([("item_id", pa.int64()), ("copy", pa.int64()), ("gram", pa.int64()), ("sample", pa.bool_()), ("need", pa.int64()), ("n_item", pa.int64())])
        for batch in batches:
            for part in X.slices(batch):
                for item, copy, s in zip(part.column("item_id").to_pylist(), part.column("copy").to_pylist(), X.shingle_sets(part.column("text")), strict=True):
                    if len(s):
                        chosen, need = samples(s, containment)
                        n = len(s)
                        yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([copy] * n, pa.int64()), pa.array(X.signed(s)), pa.array(np.isin(s, chosen)), pa.array([need] * n, pa.int64()), pa.array([n] * n, pa.int64())], schema=schema)

    return run


def _print(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of all words of each text."""
    power, inverse = X._power_tables(len(words) + 1)
    total = np.append(np.uint64(0), np.cumsum(words * power[: len(words)], dtype=np.uint64))
    return X.mix((total[first[1:]] - total[first[:-1]]) * inverse[first[:-1]] + np.diff(first).astype(np.uint64))


def _grams_of(bitmap: np.ndarray):
    """The distinct shingles of each text that the bitmap passes, with the text's fingerprint."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("f", pa.int64()), ("gram", pa.int64())])
        for batch in batches:
            for part in X.slices(batch):
                words, at, _, _ = X.word_hashes(part.column("text"), lower=True)
                prints = X.signed(_print(words, at)).tolist()
                for doc, f, s in zip(part.column("doc_id").to_pylist(), prints, X.shingle_sets(part.column("text")), strict=True):
                    s = X.signed(s)
                    s = s[passes(bitmap, s % (len(bitmap) * 8))]
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * len(s), pa.int64()), pa.array([f] * len(s), pa.int64()), pa.array(s)], schema=schema)

    return run


def _gram_filter(grams: DataFrame) -> np.ndarray:
    """A bitmap over shingles: 16 MB at most, whatever their number; an exact join follows."""
    bits = 1 << 27
    bit = F.pmod(F.col("gram"), F.lit(bits))
    out = np.zeros(bits // 8, np.uint8)
    for r in grams.groupBy(F.floor(bit / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(bit % 32768).alias("m")).toLocalIterator():
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        out[r["b"] * 4096 :][: len(m)] = m
    return out


_DOC_GRAMS = "doc_id long, f long, gram long"


def distributed_matches(docs: DataFrame, items: DataFrame, containment: float) -> DataFrame:
    """(doc_id, f, item_id, n_item, n_common) of distinct texts (doc_id, f: fingerprint), without any broadcast of items."""
    numbered = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").withColumn("copy", F.monotonically_increasing_id())
    numbered = stage(numbered, "items")
    sets = stage(numbered.mapInArrow(_item_sets(containment), "item_id long, copy long, gram long, sample boolean, need long, n_item long"), "item_sets")
    sampled = sets.filter("sample").select("copy", "gram", "need")
    hits = docs.mapInArrow(_grams_of(_gram_filter(sampled)), _DOC_GRAMS).distinct()
    found = hits.hint("merge").join(sampled.hint("merge"), "gram").groupBy("doc_id", "f", "copy").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    candidates = stage(found.filter("n >= need").select("doc_id", "f", "copy"), "candidates")
    texts = candidates.select(F.col("doc_id").alias("d"), F.col("f").alias("g")).distinct()
    chosen = stage(sets.join(candidates.select("copy").distinct(), "copy", "left_semi").select("item_id", "copy", "gram", "n_item"), "chosen")
    grams = docs.mapInArrow(_grams_of(_gram_filter(chosen)), _DOC_GRAMS).distinct()
    grams = grams.hint("merge").join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("f") == F.col("g")), "left_semi")
    pairs = grams.hint("merge").join(chosen.hint("merge"), "gram").groupBy("doc_id", "f", "copy", "item_id", "n_item").agg(F.count("*").alias("n_common"))
    out = stage(pairs.filter(F.col("n_common") >= F.lit(containment) * F.col("n_item")).select("doc_id", "f", "item_id", "n_item", "n_common"), "matches")
    unstage(numbered, sets, candidates, chosen)
    return out


def _printed(batches):
    for batch in batches:
        for part in X.slices(batch):
            words, at, _, _ = X.word_hashes(part.column("text"), lower=True)
            yield part.append_column("_kindred_f", pa.array(X.signed(_print(words, at))))


def _with_print(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_printed, T.StructType([*docs.schema.fields, T.StructField("_kindred_f", T.LongType())]))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment): items of which a document contains at least the given share of shingles."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shared = broadcast_items(items, containment)
    if shared is not None:
        return docs.mapInArrow(_search(shared, containment), _DDL)
    matches = distributed_matches(docs, items, containment).withColumnRenamed("doc_id", "d")
    # repeated rows give repeated pairs: the texts' fingerprints tell which rows are meant
    rows = _with_print(docs).select("doc_id", F.col("_kindred_f").alias("r"))
    joined = rows.join(matches, rows.doc_id.eqNullSafe(matches.d) & (rows.r == matches.f))
    return joined.select("doc_id", "item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, containment: float = THRESHOLD) -> DataFrame:
    """The rows of docs (all columns) that contain no item."""
    shared = broadcast_items(items, containment)
    if shared is not None:
        return docs.mapInArrow(_clean(shared, containment), docs.schema)
    bad = distributed_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, containment).select(F.col("doc_id").alias("_d"), F.col("f").alias("_f")).distinct()
    rows = _with_print(docs)
    return rows.join(bad, rows.doc_id.cast("long").eqNullSafe(bad["_d"]) & (rows["_kindred_f"] == bad["_f"]), "left_anti").drop("_kindred_f")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[s : s + 4], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM b WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(any_value(n_item) AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_common,
       count(*) / CAST(any_value(n_item) AS DOUBLE) AS containment
FROM ds JOIN bs USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
"""
