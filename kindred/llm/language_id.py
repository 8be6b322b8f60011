"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts come from a bounded sample, chosen by a hash of the id: about ``TRAIN_ROWS`` whole texts of each language and
``TRAIN_TEXTS`` of all, at most. Every language found in labels is learnt from, however many there are. Tasks send one row for each
language and hash value; the driver turns them into log-probabilities, kept sparsely (what a language never showed shares one
floor), so the broadcast grows with what the bounded sample holds. Scoring gathers from dense blocks of ``BLOCK`` languages in numpy, over
``WINDOW`` code points at a time, so memory doesn't grow with a text.

Texts that are null or hold no letter (Unicode's L classes) get ``und`` with score 0. The score is the posterior probability of the winner,
tempered: neighbouring n-grams aren't independent, so the evidence of n of them counts as that of sqrt(n) ones.
Rows without a language teach nothing; ties go to the language that sorts first. Without any row to
learn from, every text gets ``und``. Repeated rows and null ids stay as they are (a null id counts as held in). Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._shared import limit_batches, read, stage, unstage

#: Rows to learn from for each language, and in all, at most (roughly: they are chosen by hash; one of each language at least on average).
TRAIN_ROWS, TRAIN_TEXTS = 4000, 400_000
#: A table of as many languages, with their numbers of rows, is still broadcast.
MOST_BROADCAST = 100_000
GRAMS = (2, 3)
BUCKETS = 1 << 15
UNDETERMINED = "und"
#: Languages scored at once, and code points gathered at once for each of them.
BLOCK, WINDOW = 64, 1 << 16
#: Bytes of texts scored at once, so that the arrays stay in the processor's cache.
SLICE = 1 << 18
_GAP = " " * max(GRAMS)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points of all texts with gaps before, between and behind them, where each text's n-grams begin and the last's end)."""
    return X.folded(_GAP + _GAP.join(texts) + _GAP), np.cumsum([0] + [len(t) + len(_GAP) for t in texts])


def buckets(code: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """For each length of n-grams the bucket of the n-gram at each position from lo to hi."""
    out, total = [], np.zeros(hi - lo, np.uint32)
    for k in range(max(GRAMS)):
        total = total * np.uint32(0x01000193) + code[lo + k : hi + k]
        if k + 1 in GRAMS:
            out.append(((total + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


_TALLY = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _rows(sums: dict[str, np.ndarray]):
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], schema=_TALLY)


def _tally(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in X.slices(batch, most=SLICE):
            code, begins = codes(part.column("text").to_pylist())
            for i, lang in enumerate(part.column("lang").to_pylist()):
                if lang not in sums and len(sums) >= BLOCK:  # sums of a bounded number of languages are kept
                    yield from _rows(sums)
                    sums.clear()
                counts = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for lo in range(int(begins[i]), int(begins[i + 1]), WINDOW):
                    for b in buckets(code, lo, min(lo + WINDOW, int(begins[i + 1]))):
                        counts += np.bincount(b, minlength=BUCKETS)
    yield from _rows(sums)


class Model:
    """Languages in order; for each the log-probability of unseen n-grams, and by how much those of the seen ones are higher."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.floor, self.seen, self.more = np.zeros(len(counts), np.float32), [], []
        for k, lang in enumerate(self.langs):
            at, n = counts[lang]
            total = n.sum() + 0.5 * BUCKETS
            self.floor[k] = np.log(0.5 / total)
            self.seen.append(at.astype(np.int32))
            self.more.append((np.log((n + 0.5) / total) - np.log(0.5 / total)).astype(np.float32))
        self._at, self._block = -1, np.zeros((0, 0), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"_at": -1, "_block": None}

    def block(self, first: int) -> np.ndarray:
        """Log-probabilities of all buckets (rows) in the languages from ``first`` on, BLOCK at most."""
        if self._at != first:
            some = range(first, min(first + BLOCK, len(self.langs)))
            self._block = np.repeat(self.floor[None, some.start : some.stop], BUCKETS, axis=0)
            for j, k in enumerate(some):
                self._block[self.seen[k], j] += self.more[k]
            self._at = first
        return self._block

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        plain = [t or "" for t in texts]
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        code, begins = codes(plain)
        letters = np.append(0, np.cumsum(code != 32))
        known = letters[begins[1:]] > letters[begins[:-1] + len(_GAP)]
        sums = np.zeros((len(texts), len(self.langs)))
        for first in range(0, len(self.langs), BLOCK):
            table = self.block(first)
            for lo in range(0, int(begins[-1]), WINDOW):
                hi = min(lo + WINDOW, int(begins[-1]))
                a = int(np.searchsorted(begins, lo, "right")) - 1
                cuts = np.maximum(begins[a : int(np.searchsorted(begins, hi))], lo) - lo
                for b in buckets(code, lo, hi):
                    sums[a : a + len(cuts), first : first + table.shape[1]] += np.add.reduceat(np.take(table, b, axis=0), cuts, axis=0, dtype=np.float64)
        best = sums.argmax(axis=1)
        told = np.sqrt(np.maximum(np.diff(begins) * len(GRAMS), 1))
        score = 1 / np.exp((sums - sums.max(axis=1, keepdims=True)) / told[:, None]).sum(axis=1)
        return [self.langs[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known, strict=True)], [s if ok else 0.0 for s, ok in zip(score.tolist(), known, strict=True)]


def train(docs: DataFrame, rows: int = TRAIN_ROWS, texts: int = TRAIN_TEXTS) -> Model:
    """A model of the rows of docs (doc_id, text, lang) that are not held out."""
    limit_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = stage(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    number = sizes.count()
    each = max(1, min(rows, texts // max(1, number)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = sizes.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), each / F.col("n")).alias("share"))
    shares = F.broadcast(shares) if number <= MOST_BROADCAST else shares
    some = known.join(shares, known.lang == shares["_lang"]).filter(draw < F.col("share")).select("lang", "text")
    sums = some.mapInArrow(_tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    found = sums.toPandas()
    unstage(sizes)
    for lang, part in found.groupby("lang", sort=True):
        part = part.sort_values("bucket")
        counts[lang] = part["bucket"].to_numpy(), part["n"].to_numpy().astype(np.float64)
    return Model(counts)


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for part in X.slices(batch, most=SLICE):
                langs, scores = model.predict(part.column("text").to_pylist())
                yield part.drop_columns(["text"]).append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64()))

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return out.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def _keep(shared, least: float):
    def run(batches):
        model = shared.value
        for batch in batches:
            for part in X.slices(batch, most=SLICE):
                langs, scores = model.predict(part.column("text").to_pylist())
                yield part.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in zip(langs, scores, strict=True)], pa.bool_()))

    return run


def identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs (all columns) whose language is determined with at least this score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, least), docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
