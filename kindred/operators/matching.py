"""Verdicts on pairs of items with several sampled positions: frames, perceptual hashes and embeddings, orientation, gates, explanation.

An item (a snapshot) has id, is_image, duration, frames (array of pixel arrays, one for each position), ph (a 64-bit hash for each), emb (an int8
vector for each), emb_valid, folders, size, dev and ino. Images have one position. Verdicts are columns over a pair's two structs, so Catalyst
evaluates them where the pairs are, and ``explain`` keeps exactly what ``matches`` decides by.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions import kernels as K
from kindred.operators import cells

#: Items of a band that one task compares with as many others.
BLOCK = 512


@dataclass(frozen=True)
class MatchSettings:
    """What decides a match; percentages from 0 to 100. The defaults of the domain."""

    positions: int = 1
    percent: float = 92
    use_phash: bool = False
    combine: bool = False
    quorum: float = 0.6
    flipped: bool = True
    ignore_black: bool = True
    ignore_white: bool = True
    use_ai: bool = False
    ai_percent: float = 94
    folder_mode: str = "none"
    folder_depth: int = 1
    exclude_hard_links: bool = False
    tolerance_percent: float = 20
    tolerance_least: float = 0
    tolerance_most: float = 0

    def gray_limit(self) -> float:
        """What the summed differences of all positions may reach, in single precision."""
        return float(np.float32(np.float32(1 - np.float32(self.percent) / np.float32(100)) * np.float32(self.positions)))

    def image_limit(self) -> float:
        return float(np.float32(1 - np.float32(self.percent) / np.float32(100)))

    def max_bits(self) -> int:
        return K.max_bits(float(np.float32(np.float32(self.percent) / np.float32(100))), True)

    def ai_limit(self) -> float:
        return float(np.float32(np.float32(self.ai_percent) / np.float32(100)))


def _single(x: float) -> Column:
    return F.lit(x).cast("float")


def differences(a: Column, b: Column, ignore_black: bool, ignore_white: bool) -> Column:
    """The difference of each position in single precision; null where a masked pair of frames has no pixel left."""
    masked = ignore_black or ignore_white
    return F.zip_with(a, b, lambda x, y: (K.masked_difference(x, y, ignore_black, ignore_white) if masked else K.mean_difference(x, y)).cast("float"))


def gray_verdict(d: Column, s: MatchSettings) -> Column:
    """struct(matches, difference) of the differences at all positions: their sum stays within the limit; null differences never match."""
    total = F.aggregate(d, _single(0), lambda t, x: (t + x).cast("float"))
    return F.struct(F.coalesce(total <= _single(s.gray_limit()), F.lit(False)).alias("matches"), (total / F.lit(s.positions)).cast("float").alias("difference"))


def image_verdict(d: Column, s: MatchSettings) -> Column:
    first = F.get(d, F.lit(0))
    return F.struct(F.coalesce(first <= _single(s.image_limit()), F.lit(False)).alias("matches"), first.alias("difference"))


def hash_distances(a: Column, b: Column) -> Column:
    """Differing bits at each position that both have."""
    n = F.greatest(F.least(F.size(a), F.size(b)), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))


def quorum_verdict(distance: Column, s: MatchSettings) -> Column:
    """struct(matches, difference): enough positions within the bit budget; the difference is the mean over all of them."""
    n = F.size(distance)
    need = F.greatest(F.lit(1), F.ceil((n * _single(min(max(s.quorum, 0.01), 1.0))).cast("float")))
    total = F.aggregate(distance, _single(0), lambda t, d: (t + (d / 64.0).cast("float")).cast("float"))
    enough = F.size(F.filter(distance, lambda d: d <= s.max_bits())) >= need
    return F.struct(F.coalesce((n > 0) & enough, F.lit(False)).alias("matches"), F.when(n > 0, (total / n).cast("float")).alias("difference"))


def hash_verdict(a: Column, b: Column, s: MatchSettings) -> Column:
    return quorum_verdict(hash_distances(a, b), s)


_VERDICT = "struct<matches:boolean,difference:float,algorithms:int>"


def classic_verdict(is_image: Column, d: Column, distance: Column | None, s: MatchSettings) -> Column:
    """struct(matches, difference, algorithms): images by frames; videos by frames, hashes, or either (then the algorithms tell which)."""
    image = image_verdict(d, s)
    of_image = F.struct(image["matches"], F.coalesce(image["difference"], _single(1)), F.when(image["matches"] & F.lit(s.combine), F.lit(K.GRAY_MATCHED)).otherwise(0)).cast(_VERDICT)
    gray = gray_verdict(d, s)
    if s.combine:
        ph = quorum_verdict(distance, s)
        least = F.least(F.when(gray["matches"], gray["difference"]), F.when(ph["matches"], ph["difference"]))
        flags = F.when(gray["matches"], F.lit(K.GRAY_MATCHED)).otherwise(0) + F.when(ph["matches"], F.lit(K.PHASH_MATCHED)).otherwise(0)
        video = F.struct(gray["matches"] | ph["matches"], F.coalesce(least, _single(1)), flags)
    else:
        one = quorum_verdict(distance, s) if s.use_phash else gray
        video = F.struct(one["matches"], F.when(one["matches"], one["difference"]).otherwise(_single(1)), F.lit(0))
    return F.when(is_image, of_image).otherwise(video.cast(_VERDICT))


def ai_similarity(ea: Column, va: Column, eb: Column, vb: Column) -> Column:
    """The mean cosine over positions that are valid on both sides; -1 if fewer than half of them are."""
    n = F.least(F.size(va), F.size(vb))
    zipped = F.slice(F.arrays_zip(ea.alias("ea"), va.alias("va"), eb.alias("eb"), vb.alias("vb")), F.lit(1), F.greatest(n, F.lit(0)))
    both = F.filter(zipped, lambda p: F.coalesce(p["va"] & p["vb"], F.lit(False)))
    total = F.aggregate(F.transform(both, lambda p: K.cosine_int8(p["ea"], p["eb"]).cast("float")), _single(0), lambda t, c: (t + c).cast("float"))
    enough = F.size(both) >= F.greatest(F.lit(1), F.floor((n + 1) / 2))
    return F.when(F.coalesce(enough, F.lit(False)), (total / F.size(both)).cast("float")).otherwise(_single(-1))


def side_of(frame: Column) -> Column:
    return F.sqrt(F.size(frame)).cast("int")


def mirrored(frames: Column) -> Column:
    """Each frame's mirror image; frames are square."""
    return F.transform(frames, lambda px: F.flatten(F.transform(F.sequence(F.lit(0), side_of(px) - 1), lambda r: F.reverse(F.slice(px, r * side_of(px) + 1, side_of(px))))))


@F.pandas_udf(T.ArrayType(T.LongType()))
def frame_hashes(frames):
    """Perceptual hashes of each item's frames (arrays of 1024 pixels)."""
    import pandas as pd

    return pd.Series([K.phash_bits(np.stack([np.asarray(f) for f in each])).tolist() if each is not None and len(each) else [] for each in frames])


def with_mirrored(items: DataFrame, hashed: bool = False) -> DataFrame:
    """items with frames_flip, and ph_flip (perceptual hashes of the mirror images; without ``hashed`` an ``ph_flip`` of the input stays)."""
    out = items.withColumn("frames_flip", mirrored(F.col("frames")))
    return out.withColumn("ph_flip", frame_hashes("frames_flip")) if hashed else out


def measures(a: Column, b: Column, s: MatchSettings) -> dict[str, Column]:
    """What verdicts are made of, the dear part: differences and distances at each position, mirrored ones, and the AI similarity. a and b are structs of two items."""
    out = {"_d": differences(a["frames"], b["frames"], s.ignore_black, s.ignore_white)}
    hashed = s.combine or s.use_phash
    if hashed:
        out["_b"] = hash_distances(a["ph"], b["ph"])
    if s.flipped:
        out["_fd"] = differences(a["frames_flip"], b["frames"], s.ignore_black, s.ignore_white)
        if hashed:
            out["_fb"] = hash_distances(a["ph_flip"], b["ph"])
    if s.use_ai:
        out["_ai"] = ai_similarity(a["emb"], a["emb_valid"], b["emb"], b["emb_valid"])
    return out


def measured(pairs: DataFrame, s: MatchSettings) -> DataFrame:
    """pairs (a, b) with their measures as columns, each computed once for a pair.

    A filter on the verdict would be pushed through a projection, into the condition of the join, with a copy of the measures wherever the
    verdict looks at them. Nothing that reads a generator's output moves below it, so they come out of one with a single row.
    """
    at = measures(F.col("a"), F.col("b"), s)
    return pairs.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in at.items())))))


def verdict(a: Column, b: Column, s: MatchSettings, at: dict[str, Column] | None = None) -> dict[str, Column]:
    """The parts of a pair's verdict: normal, ai, flipped, and (match, difference, flags) of all together; ``at``: the pair's measures."""
    at = measures(a, b, s) if at is None else at
    normal = classic_verdict(a["is_image"], at["_d"], at.get("_b"), s)
    out = {"normal": normal}
    matches, difference, flags = normal["matches"], normal["difference"], F.when(normal["matches"], normal["algorithms"]).otherwise(0)
    if s.use_ai:
        out["ai"] = at["_ai"]
        by_ai = ~matches & (out["ai"] >= _single(s.ai_limit()))
        difference = F.when(by_ai, (F.lit(1) - out["ai"]).cast("float")).otherwise(difference)
        flags = F.when(by_ai, F.lit(K.AI_MATCHED)).otherwise(flags)
        matches = matches | by_ai
    if s.flipped:
        out["flipped"] = flipped = classic_verdict(a["is_image"], at["_fd"], at.get("_fb"), s)
        # the mirror image wins only where the normal one fails or differs more
        wins = flipped["matches"] & (~matches | (flipped["difference"] < difference))
        flags = F.when(wins, flipped["algorithms"].bitwiseOR(F.lit(K.FLIPPED))).otherwise(flags)
        difference = F.when(wins, flipped["difference"]).otherwise(difference)
        matches = matches | wins
    out["result"] = F.struct(matches.alias("match"), difference.cast("float").alias("difference"), flags.cast("int").alias("flags"))
    return out


def folder_keys(folders: Column, depth: int) -> Column:
    """The last ``depth`` segments of each folder path; no folder at all counts as one without a name."""
    some = F.when(F.size(F.coalesce(folders, F.array().cast("array<string>"))) > 0, folders).otherwise(F.array(F.lit("")))
    return F.transform(some, lambda p: K.folder_suffix(p, depth))


def folder_gate(a: Column, b: Column, s: MatchSettings) -> Column:
    same = F.arrays_overlap(folder_keys(a, s.folder_depth), folder_keys(b, s.folder_depth))
    return F.lit(True) if s.folder_mode == "none" else same if s.folder_mode == "same" else ~same


def duration_gate(a: Column, b: Column, s: MatchSettings) -> Column:
    """Videos' durations differ by at most the smaller of their tolerances; images always pass."""
    tolerance = lambda d: K.duration_tolerance(d, s.tolerance_percent, s.tolerance_least, s.tolerance_most)
    near = F.abs(a["duration"] - b["duration"]) <= F.least(tolerance(a["duration"]), tolerance(b["duration"]))
    return a["is_image"] | near


def hard_link(a: Column, b: Column) -> Column:
    """One file under two names: equal size, device and inode, and for videos equal duration."""
    known = F.coalesce(a["ino"].cast("string"), F.lit("")) != ""
    return F.coalesce((a["size"] == b["size"]) & (a["is_image"] | (a["duration"] == b["duration"])) & known & (a["ino"] == b["ino"]) & (a["dev"] == b["dev"]), F.lit(False))


def scale(duration: Column, s: MatchSettings) -> Column:
    """A scale on which durations within tolerance of each other lie at most 1 (with a share and a least number of seconds: 2) apart."""
    if s.tolerance_percent <= 0:
        return duration / float(max(s.tolerance_least, s.tolerance_most, 1e-9))
    p = s.tolerance_percent / 100.0
    log = lambda d: F.log(d) / math.log(1 + p)
    if s.tolerance_least <= 0:
        return F.when(duration > 0, log(duration.cast("double"))).otherwise(F.lit(-1e9))
    knee = s.tolerance_least / p
    return F.when(duration <= knee, duration / float(s.tolerance_least)).otherwise(knee / s.tolerance_least + log(duration / knee))


def candidate_pairs(items: DataFrame, s: MatchSettings) -> DataFrame:
    """(a, b): structs of pairs of items of one kind with a.id < b.id that pass the duration gate and are not both out of scope.

    The range join is an equi-join on bands of the duration's scale; images have no duration: theirs is one band. Each band is cut into
    hashed blocks by its own number of items, and each pair of blocks is a key of its own, so a hot duration is no hot key. A cell costs by its
    pairs, not its bytes: the session's number of partitions spreads cells, which adaptive execution would merge.
    """
    columns = items.columns
    reach = 2 if s.tolerance_percent > 0 and s.tolerance_least > 0 else 1
    band = F.when(F.col("is_image"), F.lit(0).cast("long")).otherwise(F.floor(scale(F.col("duration"), s)).cast("long"))
    banded = items.select(F.struct(*columns).alias("x"), F.col("is_image").alias("kind"), band.alias("k"))
    sizes = banded.groupBy("kind", "k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    # a pair of bands meets once, from the lower one; images have a single band
    above = F.when(F.col("kind"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(reach)))
    meet = sizes.select("kind", "k", "n", F.explode(above).alias("by")).withColumn("up", F.col("k") + F.col("by")).drop("by")
    meet = meet.join(sizes.select("kind", F.col("k").alias("up"), F.col("n").alias("m")), ["kind", "up"])
    place = lambda n: F.pmod(F.xxhash64("x.id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["kind", "k", "up", "i", "j"]
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = banded.join(meet, ["kind", "k"]).select(F.col("x").alias("p"), "kind", "k", "up", place("n").alias("i"), each("m").alias("j")).repartition(parts, *key)
    right = banded.withColumnRenamed("k", "up").join(meet, ["kind", "up"]).select(F.col("x").alias("q"), "kind", "k", "up", each("n").alias("i"), place("m").alias("j")).repartition(parts, *key)
    p, q = F.col("p"), F.col("q")
    near = F.when(F.col("k") == F.col("up"), p["id"] < q["id"]).otherwise(p["id"] != q["id"]) & duration_gate(p, q, s)
    if "in_scope" in columns:
        near = near & (p["in_scope"] | q["in_scope"])
    first = p["id"] < q["id"]
    return left.join(right, key).filter(near).select(F.when(first, p).otherwise(q).alias("a"), F.when(first, q).otherwise(p).alias("b"))


def matches(items: DataFrame, s: MatchSettings) -> DataFrame:
    """(a, b, difference, flags): all matching pairs of items, through every gate.

    Where no pixel is masked and every item is regular, cells in numpy decide (``cells``); else the columns do.
    """
    found = _by_cells(items, s, cells.FOUND)
    return found if found is not None else judged(candidate_pairs(_mirrored_too(items, s), s), s)


def _mirrored_too(items: DataFrame, s: MatchSettings) -> DataFrame:
    return with_mirrored(items) if s.flipped and "frames_flip" not in items.columns else items


def _by_cells(items: DataFrame, s: MatchSettings, what: str) -> DataFrame | None:
    """What cells return of all pairs of items; None where they can't decide."""
    hashed = s.combine or s.use_phash or what == cells.EXPLAINED
    if s.ignore_black or s.ignore_white or dict(items.dtypes)["id"] not in ("bigint", "int") or (s.flipped and hashed and "ph_flip" not in items.columns):
        return None
    known = items.filter(F.col("id").isNotNull() & F.col("is_image").isNotNull() & (F.col("is_image") | F.col("duration").isNotNull()))
    fits = F.when(F.col("is_image"), cells.regular(s, True, what)).otherwise(cells.regular(s, False, what))
    sizes = known.groupBy("is_image").agg(F.count_if(~fits).alias("odd"), F.countDistinct(F.size(F.get("frames", F.lit(0)))).alias("sizes")).collect()
    if not sizes or any(r.odd or r.sizes != 1 for r in sizes):
        return None
    fine = 16
    tolerance = K.duration_tolerance(F.col("duration"), s.tolerance_percent, s.tolerance_least, s.tolerance_most)
    reach = fine * (2 if s.tolerance_percent > 0 and s.tolerance_least > 0 else 1) + 1
    keys = folder_keys(F.col("folders"), s.folder_depth)
    videos = cells.matches(known.filter(~F.col("is_image")), s, False, F.floor(scale(F.col("duration"), s) * fine).cast("long"), reach, tolerance, keys, what)
    return videos.unionByName(cells.matches(known.filter("is_image"), s, True, F.lit(0).cast("long"), 0, F.lit(0.0), keys, what))


def judged(pairs: DataFrame, s: MatchSettings) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    gated = pairs.filter(duration_gate(a, b, s) & folder_gate(a["folders"], b["folders"], s))
    at = {n: F.col(n) for n in measures(a, b, s)}
    found = measured(gated, s).withColumn("r", verdict(a, b, s, at)["result"]).filter("r.match")
    found = found.filter(~hard_link(a, b)) if s.exclude_hard_links else found
    return found.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "r.difference", "r.flags")


def explain(pairs: DataFrame, s: MatchSettings) -> DataFrame:
    """Every gate and verdict of pairs (a, b: structs of items), none filtered: what ``judged`` decides by.

    Where kinds differ or a frame is missing, ``problem`` says so and the match is false.
    """
    a, b = F.col("a"), F.col("b")
    pairs = measured(pairs, s)
    parts = verdict(a, b, s, {n: F.col(n) for n in measures(a, b, s)})
    short = (F.size(F.coalesce(a["frames"], F.array())) < 1) | (F.size(F.coalesce(b["frames"], F.array())) < 1)
    missing = short | F.exists(a["frames"], lambda f: f.isNull()) | F.exists(b["frames"], lambda f: f.isNull())
    problem = F.when(a["is_image"] != b["is_image"], "kinds").when(missing, "frames")
    out = {
        "a": a["id"], "b": b["id"], "problem": problem, "duration_gap": F.abs(a["duration"] - b["duration"]), "duration_ok": duration_gate(a, b, s), "folder_ok": folder_gate(a["folders"], b["folders"], s),
        "frame_differences": differences(a["frames"], b["frames"], False, False), "masked_differences": F.col("_d"),
        "hash_distances": hash_distances(a["ph"], b["ph"]).cast("array<int>"),
        "dark_a": F.transform(a["frames"], K.is_dark), "dark_b": F.transform(b["frames"], K.is_dark),
        "normal": parts["normal"], "hard_link": hard_link(a, b),
    }
    out |= {k: parts[k] for k in ("flipped", "ai") if k in parts}
    rejected = hard_link(a, b) if s.exclude_hard_links else F.lit(False)
    ok = problem.isNull() & out["duration_ok"] & out["folder_ok"] & parts["result"]["match"] & ~rejected
    out["match"] = F.coalesce(ok, F.lit(False))
    out["difference"], out["flags"] = parts["result"]["difference"], parts["result"]["flags"]
    return pairs.select(*(c.alias(n) for n, c in out.items()))


def explain_pair(items: DataFrame, first: object, second: object, s: MatchSettings) -> DataFrame:
    """One row: why two items do or don't match."""
    items = with_mirrored(items) if s.flipped and "frames_flip" not in items.columns else items
    one = lambda i, n: items.filter(F.col("id") == F.lit(i)).select(F.struct(*items.columns).alias(n))
    return explain(one(first, "a").join(F.broadcast(one(second, "b"))), s)


def tally(items: DataFrame, s: MatchSettings) -> DataFrame:
    """(both, gray_only, phash_only): by what combined matches of items were found. Cells return their counts, not the matches."""
    counted = _by_cells(items, s, cells.FLAGS)
    counted = counted if counted is not None else matches(items, s).select("flags", F.lit(1).cast("long").alias("n"))
    f = F.col("flags").bitwiseAND(F.lit(K.GRAY_MATCHED | K.PHASH_MATCHED))
    total = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("n"))), F.lit(0).cast("long"))
    return counted.agg(total(f == (K.GRAY_MATCHED | K.PHASH_MATCHED)).alias("both"), total(f == K.GRAY_MATCHED).alias("gray_only"), total(f == K.PHASH_MATCHED).alias("phash_only"))


def diagnosed(items: DataFrame, s: MatchSettings) -> DataFrame:
    """(a, b, duration_gap, folder_ok, hard_link, ai, normal, flipped, hash_distances, match, difference, flags): every candidate pair with what decides it, none filtered.

    What ``explain`` says of the pairs that ``candidate_pairs`` makes, from cells where they can decide; ai is -1 and flipped false where the settings don't ask.
    """
    told = _by_cells(items, s, cells.EXPLAINED)
    if told is not None:
        return told
    shown = explain(candidate_pairs(_mirrored_too(items, s), s), s)
    ai = F.col("ai") if s.use_ai else _single(-1)
    flipped = F.col("flipped.matches") if s.flipped else F.lit(False)
    return shown.select("a", "b", F.col("duration_gap").cast("double").alias("duration_gap"), "folder_ok", "hard_link", ai.alias("ai"), F.col("normal.matches").alias("normal"), flipped.alias("flipped"), "hash_distances", "match", "difference", "flags")
