"""Audio fingerprints: chroma bits for each second, majority votes, offset votes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the domain: sample rate, frame and hop of the transform, and the notes' range.
RATE, FRAME, HOP = 11025, 4096, 1365
LOW_HZ, HIGH_HZ = 27.5, 3520.0
_TAPS = np.array([0.25, 0.5, 1.0, 0.5, 0.25]) / 2.5


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """A 32-bit fingerprint for each second of mono samples at RATE: chroma bins compared at three intervals, majority of each second."""
    return words_of(chroma(pcm))


class Feed:
    """The fingerprint of samples that arrive in chunks of any size; the result doesn't depend on the chunks."""

    def __init__(self):
        self._rest, self._frames, self._seen = np.zeros(0), [], 0

    def feed(self, pcm: np.ndarray) -> None:
        self._rest = np.concatenate([self._rest, pcm.astype(np.float64)])
        n = (len(self._rest) - FRAME) // HOP + 1
        if n > 0:
            self._frames.append(chroma(self._rest[: (n - 1) * HOP + FRAME]))
            self._rest = self._rest[n * HOP :]

    def finish(self) -> np.ndarray:
        return words_of(np.concatenate(self._frames)) if self._frames else np.zeros(0, np.uint32)


#: Frames that are transformed at once, so memory doesn't grow with a track.
_AT_ONCE = 512


def chroma(pcm: np.ndarray) -> np.ndarray:
    """The power of the twelve notes in each frame."""
    n = max(0, (len(pcm) - FRAME) // HOP + 1)
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    use = (hz >= LOW_HZ) & (hz < HIGH_HZ)
    note = np.floor(12 * np.log2(hz[use] / 440.0) + 0.5).astype(int) % 12
    out = np.zeros((n, 12))
    for a in range(0, n, _AT_ONCE):
        b = min(a + _AT_ONCE, n)
        part = pcm[a * HOP : (b - 1) * HOP + FRAME].astype(np.float64)
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * np.hanning(FRAME)
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        np.add.at(out[a:b].T, note, power[:, use].T)
    return out


def words_of(notes: np.ndarray) -> np.ndarray:
    """Smoothed notes as a word of comparisons for each frame, and their majority for each second."""
    n = len(notes)
    if n < 5:
        return np.zeros(0, np.uint32)
    smooth = sum(_TAPS[k] * notes[k : n - 4 + k] for k in range(5))
    steps = [1] * 12 + [3] * 12 + [6] * 8
    bits = np.array([smooth[:, i % 12] > smooth[:, (i % 12 + s) % 12] for i, s in enumerate(steps)]).T
    words = (bits.astype(np.uint64) << np.arange(32, dtype=np.uint64)).sum(axis=1).astype(np.uint32)
    second = ((np.arange(len(words)) + 4) * HOP) // RATE
    return np.array([majority(words[second == s]) for s in range(second[-1] + 1)], np.uint32)


def fingerprints(chunks: DataFrame) -> DataFrame:
    """(id, fp) of PCM chunks (id, part, pcm: little-endian 16-bit mono samples): each track's chunks in order, one after the other."""

    def one(key, batches):
        track = Feed()
        for batch in batches:
            for part in batch.column("pcm").to_pylist():
                track.feed(np.frombuffer(part, "<i2"))
        fp = track.finish()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([fp.astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["id", "fp"])

    kind = dict(chunks.dtypes)["id"]
    return chunks.groupBy("id").applyInArrow(lambda key, table: _table(one(key, table.sort_by("part").to_batches())), f"id {kind}, fp array<long>")


def _table(batches) -> pa.Table:
    return pa.Table.from_batches(list(batches))


def majority(words: np.ndarray) -> int:
    """Each bit that more than half of the words have."""
    ones = ((words[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).sum(axis=0)
    return int((np.where(ones >= len(words) // 2 + 1, 1, 0).astype(np.uint64) << np.arange(32, dtype=np.uint64)).sum()) if len(words) else 0


def majority_vote(words: DataFrame, keys: list[str], word: str = "word") -> DataFrame:
    """keys and the majority word of their rows: bits that more than half of them have, by 32 combining sums."""
    sums = [F.sum(F.shiftright(word, i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(32)]
    counted = words.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    need = F.floor(F.col("n") / 2) + 1
    vote = sum((F.when(F.col(f"b{i}") >= need, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(32)), F.lit(0).cast("long"))
    return counted.select(*keys, vote.alias("word"))


def offset_votes(hits: DataFrame, tolerance: float, least_hits: int = 4) -> DataFrame:
    """(source, clip, offset, similarity, hits) from frame hits (source, clip, offset, sim): the upper median offset, and the mean of what lies near."""
    pair = W.partitionBy("source", "clip")
    ranked = hits.withColumn("r", F.row_number().over(pair.orderBy("offset"))).withColumn("n", F.count("*").over(pair))
    middle = ranked.withColumn("median", F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("offset"))).over(pair))
    near = middle.filter((F.col("n") >= least_hits) & (F.abs(F.col("offset") - F.col("median")) <= tolerance))
    return near.groupBy("source", "clip").agg(F.greatest(F.lit(0.0), F.first("median")).alias("offset"), F.avg("sim").alias("similarity"), F.count("*").alias("hits")).filter(F.col("hits") >= least_hits)
