"""Operator 9: toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (a run of letters, lower-cased) is the mean of the vectors of its character n-grams (its ends marked) and of the word
itself, all hashed into ``BUCKETS`` rows; a text is the mean of its words' vectors; a softmax layer over two classes follows. Unseen
misspellings share n-grams with words that were seen. A run of more than ``SLICE`` letters counts as several words.

Both layers are trained at once by proximal gradient descent with momentum on a bounded sample: about ``TRAIN_TOXIC`` and ``TRAIN_CLEAN``
labelled documents, and ``TRAIN_BYTES`` of distinct words, at most, chosen by a hash of the id. Each step shrinks every vector, so n-grams
that tell little stay at zero instead of fitting their rows' accidents; how strongly, and how many steps, is what a held-in
validation part (one text of ``VALIDATE``) likes best. n-grams of fewer than ``MIN_TEXTS`` (a fixed number) sampled words and texts teach nothing.
Texts are tallied where they lie: only each text's distinct words and their counts go to the training task.

Scoring needs the product of both layers only, one number for each bucket; it is broadcast, and whole texts are
scored in parts with running sums.

Null and letterless texts get the sample's share of toxic texts as score (below one half). A doc_id with several labels is toxic if any
says so; of documents that share an id, training takes one (the smallest text). Without labels of both classes every score is 0. Repeated
rows and null ids stay as they are (a null id counts as held in). Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._shared import read, stage, unstage

BUCKETS = 1 << 17
DIMENSION = 8
GRAMS = (3, 4, 5)
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 3000, 6000, 64 << 20
#: Words of sampled texts that an n-gram must stand in, each counted once in a text.
MIN_TEXTS = 5
ROUNDS, LAYER_RATE = 100, 0.1
#: Shrinkage that is tried, and what an n-gram must tell to be trained at all, as shares of what the strongest tells.
SPARSITY, SCREEN = (0.2, 0.1, 0.05), 0.08
VALIDATE = 5
#: Rounds without a better validation loss after which training stops.
PATIENCE = 20
#: Bytes of texts scored at once.
SLICE = 1 << 18
_PRIME = np.uint32(0x01000193)


class Words:
    """The words of some texts: text of each, hash, and buckets of the n-grams at each position."""

    def __init__(self, texts: list[str]):
        gap = " " * max(GRAMS)
        code = X.folded(gap + gap.join(texts) + gap)
        letter = code != 32
        self.begin = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        starts = np.cumsum([len(gap)] + [len(t) + len(gap) for t in texts])
        self.text = np.searchsorted(starts, self.begin, "right") - 1
        power, inverse = X._power_tables(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(X.mix(code.astype(np.uint64)) * power[: len(code)], out=total[1:])
        self.hash = X.mix((total[self.end] - total[self.begin]) * inverse[self.begin])
        self.whole = (self.hash >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        n = len(code) - max(GRAMS) + 1
        self.grams, h = {}, np.zeros(n, np.uint32)
        for k in range(max(GRAMS)):
            h = h * _PRIME + code[k : k + n]
            if k + 1 in GRAMS:
                self.grams[k + 1] = ((h + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        #: How many n-grams of each length a word with its two ends has.
        self.count = {k: np.maximum(self.end - self.begin + 3 - k, 0) for k in GRAMS}

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The mean weight of each word's n-grams and itself."""
        total, number = weights[self.whole].astype(np.float64), np.ones(len(self.begin))
        for k, h in self.grams.items():
            running = np.append(0, np.cumsum(weights[h], dtype=np.float64))
            first = np.minimum(self.begin - 1, len(running) - 1)
            last = np.minimum(first + self.count[k], len(running) - 1)
            total += running[last] - running[first]
            number += self.count[k]
        return total / number

    def buckets(self, i: int) -> np.ndarray:
        """The buckets of the word at i."""
        a = self.begin[i] - 1
        return np.concatenate([[self.whole[i]], *(h[a : a + self.count[k][i]] for k, h in self.grams.items())]).astype(np.int64)


class Model:
    """One weight for each bucket, an offset, and the score of texts without words."""

    def __init__(self, weights: np.ndarray, offset: float, base: float):
        self.weights, self.offset, self.base = weights, offset, base

    def score(self, texts: list[str | None]) -> np.ndarray:
        number, total = np.zeros(len(texts)), np.zeros(len(texts))
        parts, owners = [], []
        for i, t in enumerate(texts):
            for p in X.cut(t or "", SLICE):
                parts.append(p)
                owners.append(i)
        at = 0
        while at < len(parts):
            stop, size = at + 1, len(parts[at])
            while stop < len(parts) and size + len(parts[stop]) <= SLICE:
                size += len(parts[stop])
                stop += 1
            words = Words(parts[at:stop])
            of = np.array(owners[at:stop])
            number += np.bincount(of[words.text], minlength=len(texts))
            total += np.bincount(of[words.text], weights=words.scores(self.weights), minlength=len(texts))
            at = stop
        z = total / np.maximum(number, 1) + self.offset
        return np.where(number > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), self.base)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


class Sparse:
    """The shares of a text's words (rows) and the n-grams of each word (columns of shares): features are their product."""

    def __init__(self, owner: np.ndarray, word: np.ndarray, share: np.ndarray, bucket: np.ndarray, of_word: np.ndarray, part: np.ndarray, texts: int, words: int, buckets: int):
        self.owner, self.word, self.share = owner, word, share
        self.bucket, self.of_word, self.part = bucket, of_word, part
        self.texts, self.words, self.buckets = texts, words, buckets

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The value of each text under one weight for each bucket."""
        by_word = np.bincount(self.of_word, weights=weights[self.bucket] * self.part, minlength=self.words)
        return np.bincount(self.owner, weights=by_word[self.word] * self.share, minlength=self.texts)

    def gather(self, values: np.ndarray) -> np.ndarray:
        """What one value for each text gives each bucket (the transposed product)."""
        by_word = np.bincount(self.word, weights=values[self.owner] * self.share, minlength=self.words)
        return np.bincount(self.bucket, weights=by_word[self.of_word] * self.part, minlength=self.buckets)

    def only(self, keep: np.ndarray) -> Sparse:
        """The same features without those of the other buckets."""
        some = keep[self.bucket]
        words = np.bincount(self.of_word[some], minlength=self.words) > 0
        texts = words[self.word]
        name, at = np.cumsum(words) - 1, np.cumsum(keep) - 1
        return Sparse(
            self.owner[texts], name[self.word[texts]], self.share[texts], at[self.bucket[some]], name[self.of_word[some]], self.part[some], self.texts, int(words.sum()), int(keep.sum())
        )

    def squares(self) -> np.ndarray:
        """The sum over texts of each bucket's squared feature."""
        first = np.searchsorted(self.of_word, np.arange(self.words + 1))
        rows = np.searchsorted(self.owner, np.arange(self.texts + 1))
        total = np.zeros(self.buckets)
        for t in range(self.texts):
            w = self.word[rows[t] : rows[t + 1]]
            n = first[w + 1] - first[w]
            at = np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            value = np.repeat(self.share[rows[t] : rows[t + 1]], n) * self.part[at]
            order = np.argsort(self.bucket[at], kind="stable")
            b, v = self.bucket[at][order], value[order]
            if len(b):
                new = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                total[b[new]] += np.add.reduceat(v, new) ** 2
        return total


def tally(text: str) -> tuple[str, list[int]]:
    """(the distinct words of a text, lower-cased, with spaces between; how often each occurs)."""
    counts: dict[str, int] = {}
    for part in X.cut(text, SLICE):
        words = Words([part])
        lower = X.folded(part)
        _, once, times = np.unique(words.hash, return_index=True, return_counts=True)
        gap = max(GRAMS)
        for i, n in zip(once.tolist(), times.tolist(), strict=True):
            w = lower[words.begin[i] - gap : words.end[i] - gap].tobytes().decode("utf-32-le", "surrogatepass")
            counts[w] = counts.get(w, 0) + n
    return " ".join(counts), list(counts.values())


def features(texts: list[str], counts: list[list[int]], min_texts: int) -> tuple[Sparse, np.ndarray] | None:
    """The features of tallied texts and the buckets they use; None if nothing recurs."""
    kept: dict[int, np.ndarray] = {}
    hashes, owners, times = [], [], []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < SLICE):
            size += len(texts[stop])
            stop += 1
        words = Words(texts[at:stop])
        _, once = np.unique(words.hash, return_index=True)
        for i, h in zip(once.tolist(), words.hash[once].tolist(), strict=True):
            if h not in kept:
                kept[h] = words.buckets(i)
        hashes.append(words.hash)
        owners.append(words.text + at)
        times += [np.asarray(c, np.int64) for c in counts[at:stop]]
        at = stop
    if not kept:
        return None
    vocabulary, word = np.unique(np.concatenate(hashes), return_inverse=True)
    owner, times = np.concatenate(owners), np.concatenate(times)
    length = np.bincount(owner, weights=times, minlength=len(texts))
    lists = [kept[h] for h in vocabulary.tolist()]
    parts = np.array([len(x) for x in lists])
    bucket, of_word = np.concatenate(lists), np.repeat(np.arange(len(lists)), parts)
    support = np.bincount(word, minlength=len(lists))
    some = (np.bincount(bucket, weights=support[of_word], minlength=BUCKETS) >= min_texts)[bucket]
    used, bucket = np.unique(bucket[some], return_inverse=True)
    of_word = of_word[some]
    if not len(used):
        return None
    return Sparse(owner, word, times / length[owner], bucket, of_word, 1.0 / parts[of_word], len(texts), len(lists), len(used)), used


def descend(x: Sparse, scale: np.ndarray, y: np.ndarray, weight: np.ndarray, sparsity: float, rounds: int, watch: np.ndarray | None = None) -> tuple[np.ndarray, float, float, int]:
    """(weights by bucket, offset, least watched loss, its round) of embeddings and a softmax layer trained together.

    Embeddings follow proximal gradient steps with momentum: each step shrinks a bucket's vector by ``sparsity``, so that n-grams that
    tell too little stay at zero. Texts of weight zero teach nothing; ``watch`` weighs those that early stopping looks at.
    """
    rng = np.random.Generator(np.random.PCG64(9))
    layer = rng.standard_normal(DIMENSION)
    layer /= np.linalg.norm(layer)
    table, seen = np.zeros((x.buckets, DIMENSION)), np.zeros((x.buckets, DIMENSION))
    probe = rng.standard_normal(x.buckets)
    for _ in range(10):
        probe = scale * x.gather(weight * x.times(scale * probe))
        size = np.linalg.norm(probe)
        probe /= max(size, 1e-30)
    step = 1.0 / max(0.25 * size, 1e-12)
    base = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    offset, best, t = float(np.log(base / (1 - base))), (np.inf, np.zeros(x.buckets), 0.0, 0), 1.0
    for k in range(1, rounds + 1):
        z = x.times(scale * (seen @ layer)) + offset
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        g = (p - y) * weight
        by_bucket = scale * x.gather(g)
        new = seen - step * by_bucket[:, None] * layer
        norm = np.linalg.norm(new, axis=1)
        new *= np.maximum(1 - step * sparsity / np.maximum(norm, 1e-30), 0)[:, None]
        layer = layer - LAYER_RATE * (seen.T @ by_bucket)
        layer /= np.linalg.norm(layer)
        offset -= 2.0 * g.sum() / weight.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        seen, table, t = new + (t - 1) / after * (new - table), new, after
        if watch is not None and (k % 5 == 0 or k == rounds):
            z = x.times(scale * (table @ layer)) + offset
            loss = float((watch * np.logaddexp(0, np.where(y == 1, -z, z))).sum() / watch.sum())
            if loss < best[0]:
                best = (loss, scale * (table @ layer), offset, k)
            elif k - best[3] >= PATIENCE:
                break
    if watch is None:
        return scale * (table @ layer), offset, 0.0, rounds
    return best[1], best[2], best[0], best[3]


def fit(texts: list[str], counts: list[list[int]], toxic: np.ndarray, min_texts: int = MIN_TEXTS, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(the product of both layers by bucket, the offset) after joint training on tallied texts and their labels (0 or 1)."""
    out = np.zeros(BUCKETS, np.float32)
    made = features(texts, counts, min_texts)
    y = toxic.astype(np.float64)
    if made is None or not 0 < y.sum() < len(y):
        return out, 0.0
    x, used = made
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    tells = x.gather((y - 0.5) * weight)
    mean = x.gather(np.full(len(y), 1 / len(y)))
    scale = 1 / np.sqrt(np.maximum(x.squares() / len(y) - mean * mean, 1e-12))
    tells = np.abs(scale * tells)
    most = tells.max()
    keep = tells >= SCREEN * most
    x, scale, used = x.only(keep), scale[keep], used[keep]
    held = np.zeros(len(y), bool)
    for k in (0, 1):
        held[np.flatnonzero(y == k)[VALIDATE - 1 :: VALIDATE]] = True
    if not held[y == 1].any():
        held[:] = False
    tried = []
    for share in SPARSITY if held.any() else SPARSITY[1:2]:
        _, _, loss, stop = descend(x, scale, y, np.where(held, 0, weight), share * most, rounds, np.where(held, weight, 0) if held.any() else weight)
        tried.append((loss, share, stop))
    _, share, stop = min(tried)
    w, b, _, _ = descend(x, scale, y, weight, share * most, stop)
    out[used] = w
    return out, b


_TALLY = "doc_id long, toxic int, words string, counts array<int>, bytes long"


def _tallies(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.string()), ("counts", pa.list_(pa.int32())), ("bytes", pa.int64())])
    for batch in batches:
        for part in X.slices(batch, most=SLICE):
            made = [tally(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([w for w, _ in made], pa.string()), pa.array([c for _, c in made], schema.field(3).type), pa.array([len(w.encode()) + 4 * len(c) for w, c in made], pa.int64())], schema=schema)


def _train(batches):
    rows = []
    for batch in batches:
        rows += zip(batch.column("doc_id").to_pylist(), batch.column("words").to_pylist(), batch.column("counts").to_pylist(), batch.column("toxic").to_pylist(), strict=True)
    rows.sort()  # the same model, whatever order rows come in
    weights, offset = fit([r[1] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows])) if rows else (np.zeros(BUCKETS, np.float32), 0.0)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([offset], pa.float64())], names=["weights", "offset"])


def _draw(salt: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the labelled rows of docs (doc_id, text) that are not held out; None without both classes."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, TRAIN_TOXIC / sizes[1]))).otherwise(F.lit(min(1.0, TRAIN_CLEAN / sizes[0])))
    some = known.filter(F.col("toxic").isin(0, 1) & (_draw(11) < share))
    # the sample of ids is bounded above, so it may be broadcast; rows that share an id become one before they shuffle
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    tallied = stage(texts.select("doc_id", "text", "toxic").mapInArrow(_tallies, _TALLY), "tallies")
    size = tallied.agg(F.sum("bytes")).first()[0] or 0
    kept = tallied.filter(_draw(12) < min(1.0, TRAIN_BYTES / max(size, 1)))
    found = kept.drop("bytes").repartition(1).mapInArrow(_train, "weights binary, offset double").collect()[0]
    unstage(tallied)
    return Model(np.frombuffer(bytes(found["weights"]), np.float32), found["offset"], min(0.49, sizes[1] / (sizes[0] + sizes[1])))


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for part in X.slices(batch, most=SLICE):
                score = model.score(part.column("text").to_pylist()) if model is not None else np.zeros(part.num_rows)
                yield part.drop_columns(["text"]).append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= 0.5).astype(np.int32)))

    return run


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return out.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, read(spark, sf_dir, "labels")))
