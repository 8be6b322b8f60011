"""From items and their table of fingerprints to what can be compared: reuse, rejections at run time, completeness, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import kernels as K
from kindred.sources import cache

FRAME_BYTES = K.PIXELS


def reuse(items: DataFrame, entries: DataFrame) -> DataFrame:
    """items (id, size, mtime, os_hash, ...) with their entries' columns and ``reused``: what was derived counts if the file is the same.

    An equal size and time, or an equal size and content hash under a new time, is the same file; otherwise derived columns are null.
    """
    own = [c for c in entries.columns if c not in ("id", "size", "mtime", "os_hash")]
    old = entries.select(F.col("id").alias("_id"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("os_hash").alias("_hash"), *(F.col(c).alias("_" + c) for c in own))
    both = items.join(old, items.id == old["_id"], "left")
    same = (F.col("size") == F.col("_size")) & ((F.col("mtime") == F.col("_mtime")) | (F.col("os_hash") == F.col("_hash")))
    out = both.withColumn("reused", F.coalesce(same, F.lit(False)))
    return out.select(*items.columns, *(F.when(F.col("reused"), F.col("_" + c)).alias(c) for c in own), "reused")


def runtime_reason(missing: Column, link: Column, read_only: Column, flags: Column, skip_links: bool = True, skip_read_only: bool = False, retry: bool = False) -> Column:
    """Why a file isn't analysed, the first reason that holds: missing, link, read-only, failed before; null if it is."""
    failed = cache.has(flags, cache.THUMBNAIL_ERROR | cache.METADATA_ERROR | cache.TOO_DARK) & F.lit(not retry)
    return F.coalesce(F.when(missing, "missing"), F.when(link & F.lit(skip_links), "link"), F.when(read_only & F.lit(skip_read_only), "read-only"), F.when(failed, "failed before"))


def complete(frames: Column, keys: Column) -> Column:
    """Whether a map of frames (bytes by position) has a whole frame at every key."""
    return F.coalesce(F.forall(keys, lambda k: F.coalesce(F.octet_length(F.try_element_at(frames, k)) == FRAME_BYTES, F.lit(False))), F.lit(False))


def eligible(has_info: Column, flags: Column, is_complete: Column) -> Column:
    """Whether an entry can be compared: its metadata are known, it has no error, isn't too dark and not excluded, and its frames are complete."""
    return F.coalesce(has_info & ~cache.has(flags, cache.THUMBNAIL_ERROR | cache.TOO_DARK | cache.EXCLUDED) & is_complete, F.lit(False))


def too_dark(samples: DataFrame) -> DataFrame:
    """(id, too_dark) of newly sampled frames (id, is_image, px): a video is if all of them are, an image by its only one."""
    return samples.groupBy("id").agg(F.bool_and(K.is_dark(F.col("px"))).alias("too_dark"))


def compare_order(items: DataFrame) -> DataFrame:
    """items by duration, then idx, dealt by ranges: the order of comparison without one task for all."""
    return items.orderBy("duration", "idx")
