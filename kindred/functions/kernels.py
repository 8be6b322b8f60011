"""Similarity kernels and gates as columns: frames, hashes, embeddings, tolerances, folders, wildcards."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 32
PIXELS = SIDE * SIDE
#: Fixed values of the domain: pixels up to BLACK are dark, from WHITE on white; a frame is dark at 80 % dark pixels.
BLACK, WHITE, DARK_PERCENT = 0x20, 0xF0, 80
#: Fixed flag bits of a match.
FLIPPED, PARTIAL_CLIP, AI_MATCHED, GRAY_MATCHED, PHASH_MATCHED = 1, 2, 4, 8, 16


def round6(x: Column) -> Column:
    """F.round(x, 6) of a float below 2^15 as double, without a decimal for each row: its 24 bits times 10^6 are exact in double precision, so half-up is."""
    wide = x.cast("double")
    # a sum with 0.0 has no negative zero
    return F.signum(wide) * (F.floor(F.abs(wide) * 1e6 + 0.5) / F.lit(1e6)) + F.lit(0.0)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two pixel arrays as a share of 256."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, d: s + d.cast("long"))
    return total / F.size(a) / 256.0


def masked_difference(a: Column, b: Column, ignore_black: bool = True, ignore_white: bool = True) -> Column:
    """Mean difference over the pixels that are neither black nor white in either frame; null if none is left."""

    def used(p: Column) -> Column:
        ok = F.lit(True)
        for x in (p["x"], p["y"]):
            ok = ok & ((x > BLACK) if ignore_black else F.lit(True)) & ((x < WHITE) if ignore_white else F.lit(True))
        return ok

    left = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), used)
    total = F.aggregate(left, F.lit(0).cast("long"), lambda s, p: s + F.abs(p["x"] - p["y"]).cast("long"))
    return F.when(F.size(left) > 0, total / F.size(left) / 256.0)


def is_dark(px: Column, percent: int = DARK_PERCENT) -> Column:
    return F.size(F.filter(px, lambda p: p <= BLACK)) * 100.0 / F.size(px) >= percent


def flip(px: Column, side: int = SIDE) -> Column:
    """The mirror image of a square frame."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.reverse(F.slice(px, r * side + 1, side))))


def frame_of(text: str, pixels: int = PIXELS) -> np.ndarray:
    """A stand-in for a frame: the sum of the code points of each of as many equal parts of the whole text, modulo 256.

    Part k of n takes the characters from k * length // n to (k + 1) * length // n, one at least; an empty text is black.
    """
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    if not len(code):
        return np.zeros(pixels, np.int64)
    ends = np.arange(pixels + 1) * len(code) // pixels
    total = np.append(0, np.cumsum(code))
    return (total[np.maximum(ends[1:], ends[:-1] + 1)] - total[ends[:-1]]) % 256


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def text_frame(texts: pd.Series) -> pd.Series:
    """``frame_of`` each text."""
    return pd.Series([frame_of(t).astype(np.int32) for t in texts])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def text_frames(texts: pd.Series) -> pd.Series:
    """``frame_of`` each third of each text."""
    cut = lambda t: [frame_of(t[len(t) * k // 3 : len(t) * (k + 1) // 3]).tolist() for k in range(3)]
    return pd.Series([cut(t) for t in texts])


@F.pandas_udf(T.BinaryType())
def packed(frames: pd.Series) -> pd.Series:
    """Each frame's pixels as bytes."""

    def one(px: np.ndarray) -> bytes:
        px = np.asarray(px)
        if len(px) and not 0 <= px.min() <= px.max() <= 255:
            raise ValueError("pixels lie between 0 and 255")
        return px.astype(np.uint8).tobytes()

    return pd.Series([one(px) for px in frames], dtype=object)


@F.pandas_udf(T.BinaryType())
def packed_wide(frames: pd.Series) -> pd.Series:
    """Each frame's values as 16-bit numbers."""
    return pd.Series([np.asarray(px).astype("<i2").tobytes() for px in frames], dtype=object)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def max_bits(percent: float, strict: bool) -> int:
    """How many of 64 bits may differ at a similarity of percent; half-even unless strict."""
    if not 0 <= percent <= 1:
        raise ValueError("a share from 0 to 1 is needed")
    return math.floor((1 - percent) * 64) if strict else round((1 - percent) * 64)


def phash_verdict(a: Column, b: Column, bits: int) -> Column:
    return F.struct((hamming(a, b) <= bits).alias("passes"), (1 - hamming(a, b) / 64.0).alias("similarity"), hamming(a, b).alias("distance"))


def quorum_matches(a: Column, b: Column, bits: int, ratio: float) -> Column:
    """(matches, mean difference): of the positions' hashes at least ceil(n ratio), one at least, must be within bits."""
    distance = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    need = F.greatest(F.lit(1), F.ceil(F.size(a) * min(max(ratio, 0.01), 1.0)))
    return F.struct((F.size(F.filter(distance, lambda d: d <= bits)) >= need).alias("matches"), (F.aggregate(distance, F.lit(0).cast("long"), lambda s, d: s + d.cast("long")) / 64.0 / F.size(a)).alias("difference"))


_DCT = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * np.arange(1, 9)[:, None] / (2 * SIDE)).astype(np.float32)


def phash_bits(frames: np.ndarray) -> np.ndarray:
    """64-bit perceptual hashes of frames (rows of 1024 pixels): low DCT coefficients against their median."""
    grid = frames.reshape(-1, SIDE, SIDE).astype(np.float32)
    ac = np.einsum("vy,nyx,ux->nvu", _DCT, grid, _DCT).reshape(-1, 64)
    bits = ac > np.median(ac, axis=1)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()


@F.pandas_udf(T.LongType())
def phash(frames: pd.Series) -> pd.Series:
    """Perceptual hash of each frame (array of 1024 pixels)."""
    return pd.Series(phash_bits(np.stack(frames.to_numpy()))) if len(frames) else pd.Series([], dtype="int64")


#: Word hashes that a task keeps at once.
_MOST_WORDS = 1 << 20


def simhash_bits(texts: pd.Series) -> np.ndarray:
    """64-bit simhashes of texts: a bit is set if more of the text's words have it in their hash than not."""
    known: dict[bytes, bytes] = {}
    out = np.zeros((len(texts), 64), np.uint8)
    for row, text in enumerate(texts):
        counts = Counter(text.encode().split())
        if not counts:
            continue
        if len(known) > _MOST_WORDS:
            known.clear()
        for w in counts:
            if w not in known:
                known[w] = hashlib.md5(w).digest()[:8]
        hashes = np.frombuffer(b"".join(known[w] for w in counts), np.uint8).reshape(-1, 8)
        n = np.fromiter(counts.values(), np.int64, len(counts))
        out[row] = 2 * (n @ np.unpackbits(hashes, axis=1)) > n.sum()
    return np.packbits(out, axis=1).view(">i8").astype(np.int64).ravel()


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """64-bit simhash of all words of each text."""
    return pd.Series(simhash_bits(texts), dtype="int64")


def quantize(v: Column) -> Column:
    """A unit vector as int8 components: 127 times each, half-even, within ±127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") * 127).cast("int"))))


def cosine_int8(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / 16129.0))


def sign_signature(q: Column) -> Column:
    """Bit i is set where component i of a vector of at most 64 is negative."""
    pairs = F.transform(q, lambda x, i: F.when(x < 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.transform(pairs, lambda x, i: F.call_function("shiftleft", x, i)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def sign_words(q: Column) -> Column:
    """Sign signatures of vectors of any length: 32 components to a word, bit i set where component i of the word's is negative."""
    words = F.sequence(F.lit(0), F.floor((F.size(q) - 1) / 32).cast("int"))
    bits = lambda w: F.transform(F.slice(q, w * 32 + 1, 32), lambda x, i: F.when(x < 0, F.call_function("shiftleft", F.expr("1L"), i)).otherwise(F.expr("0L")))
    return F.transform(words, lambda w: F.aggregate(bits(w), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))


def words_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two signatures of several words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: (s + d).cast("int"))


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def rgb_is_dark(rgb: Column, percent: int = DARK_PERCENT) -> Column:
    """Whether a frame of (red, green, blue) triples is dark: percent of its pixels dark in all three; an empty one is."""
    pixel = F.sequence(F.lit(0), F.floor(F.size(rgb) / 3).cast("int") - 1)
    dark = F.size(F.filter(pixel, lambda i: F.forall(F.slice(rgb, i * 3 + 1, 3), lambda c: c <= BLACK)))
    return F.when(F.size(rgb) < 3, True).otherwise(dark * 100.0 / F.floor(F.size(rgb) / 3) >= percent)


@F.pandas_udf(T.StringType())
def content_hash(content: pd.Series) -> pd.Series:
    """A hash of size and the ends of each file's bytes, as 16 hex digits: the size plus all little-endian 64-bit words of the first and last 64 KiB, modulo 2^64. Null below 64 KiB."""
    part = 1 << 16

    def one(c: bytes | None) -> str | None:
        if c is None or len(c) < part:
            return None
        total = len(c)
        for end in (c[:part], c[-part:]):
            total += int(np.frombuffer(end, "<u8").sum(dtype=np.uint64))
        return f"{total % (1 << 64):016x}"

    return pd.Series([one(bytes(c) if c is not None else None) for c in content], dtype=object)


def tensor(rgb: np.ndarray, mean: tuple = (0.485, 0.456, 0.406), deviation: tuple = (0.229, 0.224, 0.225)) -> np.ndarray:
    """Images (n, height, width, 3; bytes) as a model's input (n, 3, height, width): shares of 255 less the mean, by the deviation (fixed values of the model's training)."""
    scaled = (rgb.astype(np.float32) / np.float32(255) - np.array(mean, np.float32)) / np.array(deviation, np.float32)
    return np.ascontiguousarray(scaled.transpose(0, 3, 1, 2))


def first_token(output: np.ndarray) -> np.ndarray:
    """The vectors of a model's first token (n, tokens, dimensions), of length one."""
    v = output[:, 0, :].astype(np.float32)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(norm > 0, v / np.where(norm > 0, norm, 1), v)


def signature_bound(threshold: float, dimensions: int) -> int:
    """Differing signs that a cosine of threshold stays below but for 4.6 standard deviations."""
    p = math.acos(threshold) / math.pi
    return math.ceil(dimensions * p + 4.6 * math.sqrt(dimensions * p * (1 - p)))


def duration_tolerance(duration: Column, percent: float, least: float, most: float) -> Column:
    """Seconds that durations may differ: a share within bounds (0: no bound); at 0 percent the larger bound."""
    if percent <= 0:
        return F.lit(float(max(least, most, 0)))
    t = duration * (percent / 100.0)
    t = F.greatest(F.lit(float(least)), t) if least > 0 else t
    return F.least(F.lit(float(most)), t) if most > 0 else t


def folder_suffix(path: Column, depth: int) -> Column:
    """The last depth segments of a path, lower case, as one key; missing segments are empty."""
    parts = F.split(F.regexp_replace(F.lower(path), r"[/\\]+$", ""), r"[/\\]+")
    padded = F.concat(F.array_repeat(F.lit(""), depth), parts)
    return F.array_join(F.slice(padded, -depth, depth), "/")


def wildcard_pattern(pattern: str) -> str:
    """An anchored, case-insensitive regular expression for * and ?; a dot matches line ends."""
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def usable_frames(frames: DataFrame, key: str, order: list[str], frame: str, dark: Column) -> DataFrame:
    """frames with ``usable``: not dark, and not the same as the frame before, usable or not."""
    before = F.lag(frame).over(W.partitionBy(key).orderBy(*order))
    return frames.withColumn("usable", ~dark & ~F.col(frame).eqNullSafe(before))


def megabytes(size: Column) -> Column:
    return ((size / 1024).cast("float") / 1024).cast("float").cast("int")


def is_silent(fp: Column) -> Column:
    return (F.size(fp) > 0) & F.forall(fp, lambda x: x == 0)


def parse_duration(text: Column) -> Column:
    """Whole seconds of "H:MM:SS.frac" or of a number; negative as 0, otherwise null."""
    h, m, s = (F.regexp_extract(text, r"^(\d+):(\d+):(\d+(?:\.\d+)?)$", i) for i in (1, 2, 3))
    clock = h.try_cast("double") * 3600 + m.try_cast("double") * 60 + s.try_cast("double")
    seconds = F.coalesce(text.try_cast("double"), clock)
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0), F.floor(seconds)).cast("long"))


def hdr_rank(hdr: Column) -> Column:
    return F.when(hdr == "Dolby Vision", 4).when(hdr == "HDR10+", 3).when(hdr == "HDR10", 2).when(hdr == "HLG", 1).otherwise(0)


def hdr_format(transfer: Column, side_data: Column) -> Column:
    """HDR class of a stream from its transfer function and the kinds of its side data."""
    kinds = F.lower(F.array_join(side_data, "|"))
    pq = F.when(kinds.contains("dovi"), "Dolby Vision").when(kinds.contains("dolby vision"), "Dolby Vision").when(kinds.contains("hdr10+"), "HDR10+").when(kinds.contains("smpte2094"), "HDR10+").otherwise("HDR10")
    return F.when(transfer == "arib-std-b67", "HLG").when(transfer == "smpte2084", pq).otherwise("")


def language_tag(tag: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    return F.when(t == "und", "").otherwise(t)


def item_kind(ext: Column, images: list[str], videos: list[str]) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(images), "image").when(e.isin(videos), "video")
