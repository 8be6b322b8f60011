"""Operator 7: removal of long passages that an earlier document has, by compaction of a de Bruijn graph of words.

Each window of ``WINDOW`` consecutive words is an edge of a de Bruijn graph. Storing every edge would multiply
the corpus, so edges are compacted into paths where they are made:

1. The anchor of a window is its smallest hash of ``ANCHOR`` words. Equal windows have equal anchors. Consecutive windows
   with one anchor are a path piece: a run of edges without a branch in this document. A piece is
   stored by its anchor, the hash of all its words and its source coordinate (document, first word).
2. Anchors that stand in one document only cannot carry a shared window; their pieces go. Pieces equal in
   anchor and words are one compacted path; its smallest document is found by a combining aggregate.
3. A piece of a later document that equals a whole path is covered. Where an anchor has several
   paths (they branch: the borders of a shared passage), the first source of each path is opened into its windows again
   (a join of documents with the exact places of theirs; a bitmap of ids only spares the shuffle of other texts),
   and windows are joined on (anchor, window hash) to find the smallest document of each.
4. Covered windows go back through their source coordinates to the words of each document.

Every window is judged on the input. Anchor and window hashes together give the identity of a window.

Nulls and texts with fewer words than a window lose nothing. Rows that share a doc_id never cover one another; they are
told apart by a fingerprint of their words. A row with a null doc_id neither covers nor loses anything.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._shared import id_filter, parted, read, stage, unstage, with_lists

WINDOW = 50
ANCHOR = 16
#: Windows of one path piece at most, so that a piece's covered windows fit one long.
PIECE = 48


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Path pieces of a batch of texts: text index, first word within the text, windows, anchor, run hash."""
    n = len(words) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return {"text": none, "start": none, "count": none, "anchor": none.view(np.uint64), "run": none.view(np.uint64), "at": none}
    anchor = _sliding_min(X.gram_hashes(words, ANCHOR), window - ANCHOR + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    good = owner[:n] == owner[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~good[:-1] | (owner[1:n] != owner[: n - 1])
    index = np.arange(n)
    since = index - np.maximum.accumulate(np.where(new, index, 0))
    new |= since % PIECE == 0
    at = np.flatnonzero(new & good)
    ends = np.append(np.flatnonzero(new), n)
    count = ends[np.searchsorted(ends, at, "right")] - at
    # a piece ends where its text ends, too
    count = np.minimum(count, first[owner[at] + 1] - window + 1 - at)
    power, inverse = X._power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(X.mix(words ^ np.uint64(0xA5A5A5A5)) * power[: len(words)], out=total[1:])
    run = X.mix((total[at + count + window - 1] - total[at]) * inverse[at] + count.astype(np.uint64))
    return {"text": owner[at], "start": at - first[owner[at]], "count": count, "anchor": anchor[at], "run": run, "at": at}


def fingerprints(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of all words of each text."""
    power, inverse = X._power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return X.mix((total[first[1:]] - total[first[:-1]]) * inverse[first[:-1]] + np.diff(first).astype(np.uint64))


_PIECES = pa.schema([("doc", pa.int64()), ("f", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("anchor", pa.int64()), ("run", pa.int64())])


def _cut(batches):
    for batch in batches:
        for part in X.slices(batch):
            words, first, _, _ = X.word_hashes(part.column("text"))
            p = pieces(words, first)
            f = fingerprints(words, first)
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)
            cols = [doc[p["text"]].astype(np.int64), X.signed(f[p["text"]]), p["start"].astype(np.int32), p["count"].astype(np.int32), X.signed(p["anchor"]), X.signed(p["run"])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_PIECES)


_WINDOWS = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("i", pa.int32()), ("win", pa.int64()), ("doc", pa.int64())])


def _open(batches):
    """The windows of the pieces that begin at the listed places; where rows share an id, they are true windows of its other texts, too."""
    for batch in batches:
        for part in X.slices(batch):
            words, first, _, _ = X.word_hashes(part.column("text"))
            p = pieces(words, first)
            doc = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = part.column("starts")
            text = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            wanted = text * (1 << 40) + lists.flatten().to_numpy(zero_copy_only=False)
            keep = np.isin(p["text"] * (1 << 40) + p["start"], wanted)
            if not keep.any():
                continue
            count, at = p["count"][keep], p["at"][keep]
            i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            win = X.gram_hashes(words, WINDOW)[np.repeat(at, count) + i]
            cols = [np.repeat(X.signed(p["anchor"][keep]), count), np.repeat(X.signed(p["run"][keep]), count), i.astype(np.int32), X.signed(win), np.repeat(doc[p["text"][keep]], count)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_WINDOWS)


def covered_pieces(docs: DataFrame) -> DataFrame:
    """(doc, f, start, mask): bit i of mask says that window start + i also starts in a smaller document."""
    found = stage(docs.mapInArrow(_cut, "doc long, f long, start int, count int, anchor long, run long"), "pieces")
    shared = stage(
        found.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), (F.min("run") < F.max("run")).alias("branches")).filter("lo < hi").select("anchor", "branches"), "anchors"
    )
    inside = stage(found.hint("merge").join(shared.hint("merge"), "anchor").select("doc", "f", "start", "count", "anchor", "run", "branches"), "repeated")
    unstage(found, shared)
    paths = stage(inside.groupBy("anchor", "run", "branches").agg(F.min(F.struct("doc", "start")).alias("source")).select("anchor", "run", "branches", "source.doc", "source.start"), "paths")
    source = paths.select("anchor", "run", F.col("doc").alias("source"))
    whole = inside.select("doc", "f", "start", "count", "anchor", "run").hint("merge").join(source.hint("merge"), ["anchor", "run"]).filter("source < doc")
    whole = whole.select("doc", "f", "start", F.expr("shiftleft(1L, count) - 1").alias("mask"))

    places = stage(paths.filter("branches").groupBy("doc").agg(F.collect_list("start").alias("starts")), "places")
    opened = with_lists(docs.select("doc_id", "text"), places, "doc")
    windows = stage(opened.mapInArrow(_open, "anchor long, run long, i int, win long, doc long"), "windows")
    earliest = stage(windows.groupBy("anchor", "win").agg(F.min("doc").alias("earliest")), "earliest")
    later = windows.hint("merge").join(earliest.hint("merge"), ["anchor", "win"]).filter("earliest < doc")
    masks = stage(later.groupBy("anchor", "run", "doc").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask")), "masks")
    borders = inside.hint("merge").join(masks.hint("merge"), ["anchor", "run", "doc"]).select("doc", "f", "start", "mask")
    out = stage(whole.union(borders), "covered")
    unstage(inside, paths, places, windows, earliest, masks)
    return out


def _removed(n: int, starts: np.ndarray, masks: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words the covered windows cover."""
    change = np.zeros(n + 1, np.int64)
    for i in range(PIECE):
        at = starts[(masks >> i) & 1 > 0] + i
        at = at[at + window <= n]
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    return np.cumsum(change[:n]) > 0


def kept_words(text: str | None, marks: list | None) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one space) of a text; marks: (start, mask) of its covered pieces."""
    words = (text or "").encode().split()
    if not marks:
        return len(words), 0, b" ".join(words)
    starts, masks = np.array([m["start"] for m in marks], np.int64), np.array([m["mask"] for m in marks], np.int64)
    gone = _removed(len(words), starts, masks)
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _keep(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    for batch in batches:
        for part in X.slices(batch):
            marks = part.column("marks").to_pylist() if "marks" in part.schema.names else [None] * part.num_rows
            rows = [kept_words(t, m) for t, m in zip(part.column("text").to_pylist(), marks, strict=True)]
            cols = [part.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)), pa.array([r[2].decode() for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)


def _fingerprint(batches):
    for batch in batches:
        for part in X.slices(batch):
            words, first, _, _ = X.word_hashes(part.column("text"))
            yield part.append_column("f", pa.array(X.signed(fingerprints(words, first))))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs (doc_id, text): the text without passages of smaller documents."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    covered = covered_pieces(docs.filter("doc_id IS NOT NULL"))
    marks = stage(covered.groupBy("doc", "f").agg(F.collect_list(F.struct("start", "mask")).alias("marks")), "marks")
    unstage(covered)
    hit, rest = parted(docs, id_filter(marks, "doc"))
    hit = hit.mapInArrow(_fingerprint, "doc_id long, text string, f long")
    hit = hit.hint("merge").join(marks.hint("merge"), (hit.doc_id == marks.doc) & (hit.f == marks.f), "left").select("doc_id", "text", "marks")
    return hit.mapInArrow(_keep, _KEPT).union(rest.mapInArrow(_keep, _KEPT))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(words[s : s + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50)
), flagged AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS lo FROM win) WHERE lo < doc_id
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM flagged
), gone AS (
  SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id
), word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), kept AS (
  SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.p) AS kept
  FROM word LEFT JOIN hit USING (doc_id, p) WHERE hit.p IS NULL GROUP BY word.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
