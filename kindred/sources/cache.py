"""The fingerprint table: entries kept from scan to scan, with change detection, tombstones, statistics and JSON exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources import store

#: Fixed flag bits of an entry.
IS_IMAGE, EXCLUDED, THUMBNAIL_ERROR, METADATA_ERROR, TOO_DARK = 1, 2, 4, 8, 16
NO_AUDIO, AUDIO_ERROR, SILENT = 32, 64, 128
TOMBSTONE, MISSING, READ_ONLY = 1 << 16, 1 << 17, 1 << 18
FAILED = THUMBNAIL_ERROR | METADATA_ERROR | TOO_DARK | AUDIO_ERROR


def has(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) != 0


def with_bits(flags: Column, bits: int) -> Column:
    return flags.bitwiseOR(F.lit(bits))


def without_bits(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(~bits))


def change_state(items: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, state): new, kept, touched (same size and content hash, new time), changed or gone, of items against entries (id, size, mtime, os_hash)."""
    new = items.select("id", F.col("size").alias("ns"), F.col("mtime").alias("nm"), F.col("os_hash").alias("nh"))
    old = entries.select("id", F.col("size").alias("os"), F.col("mtime").alias("om"), F.col("os_hash").alias("oh"), F.lit(True).alias("known"))
    both = new.join(old, "id", "full")
    state = (
        F.when(F.col("ns").isNull(), "gone")
        .when(F.col("known").isNull(), "new")
        .when(F.col("ns") != F.col("os"), "changed")
        .when(F.col("nm") == F.col("om"), "kept")
        .when(F.col("nh").eqNullSafe(F.col("oh")) & F.col("nh").isNotNull(), "touched")
        .otherwise("changed")
    )
    return both.select("id", state.alias("state"))


def update_tombstones(entries: DataFrame, library: DataFrame, remember: bool = True) -> DataFrame:
    """entries (id, flags) with the tombstone bit set where the library (id) lacks them, and cleared where they came back."""
    ids = library.select(F.col("id"), F.lit(True).alias("present")).distinct()
    gone = with_bits(F.col("flags"), TOMBSTONE) if remember else F.col("flags")
    return entries.join(ids, "id", "left").withColumn("flags", F.when(F.col("present"), without_bits(F.col("flags"), TOMBSTONE)).otherwise(gone)).drop("present")


def clear_derived(entries: DataFrame, columns: list[str]) -> DataFrame:
    """entries without what is derived from content, and without the flags of its failures."""
    schema = dict(entries.dtypes)
    return entries.withColumns({c: F.lit(None).cast(schema[c]) for c in columns} | {"flags": without_bits(F.col("flags"), FAILED | NO_AUDIO | SILENT)})


def stats(entries: DataFrame) -> DataFrame:
    """Counts of entries (flags, size) by kind and state, and their bytes."""
    f = F.col("flags")
    return entries.agg(
        F.count("*").alias("entries"),
        F.count_if(has(f, IS_IMAGE)).alias("images"),
        F.count_if(~has(f, IS_IMAGE)).alias("videos"),
        F.count_if(has(f, FAILED)).alias("errors"),
        F.count_if(has(f, TOMBSTONE)).alias("tombstones"),
        F.count_if(has(f, EXCLUDED)).alias("excluded"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )


def derived_stats(entries: DataFrame) -> DataFrame:
    """Counts of what entries (flags, gray, audio, emb: maps and arrays, null if there is none) have derived: fingerprinted, frames, audio, embeddings."""
    number = lambda c: F.coalesce(F.size(F.map_keys(c)), F.lit(0))
    return entries.agg(
        F.count_if(number("gray") > 0).alias("fingerprinted"),
        F.coalesce(F.sum(number("gray")), F.lit(0)).alias("frames"),
        F.count_if(F.coalesce(F.size("audio"), F.lit(0)) > 0).alias("audio"),
        F.coalesce(F.sum(number("emb")), F.lit(0)).alias("embeddings"),
    )


def cleanup(entries: DataFrame, library: DataFrame, keep_tombstones: bool) -> DataFrame:
    """entries without those that the library (id) lacks; tombstones stay if they are remembered."""
    lacking = entries.join(library.select("id").distinct(), "id", "left_anti")
    gone = lacking.filter(~has(F.col("flags"), TOMBSTONE)) if keep_tombstones else lacking
    return entries.join(gone.select("id"), "id", "left_anti")


def _marked(entries: DataFrame, ids: DataFrame) -> DataFrame:
    some = ids.select(F.col("id").alias("_i")).distinct()
    return entries.join(some, entries.id == some["_i"], "left")


def set_flag(entries: DataFrame, ids: DataFrame, bit: int, value: bool = True) -> DataFrame:
    """entries with a flag set, or cleared, for the given ids: exclusion, tombstones and their like."""
    flags = with_bits(F.col("flags"), bit) if value else without_bits(F.col("flags"), bit)
    return _marked(entries, ids).withColumn("flags", F.when(F.col("_i").isNotNull(), flags).otherwise(F.col("flags"))).drop("_i")


def exclude(entries: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    """entries with the given ids excluded (or taken in again); ids without an entry get an empty one."""
    fresh = ids.select("id").distinct().join(entries.select("id"), "id", "left_anti")
    new = fresh.select("id", *(F.lit(0).alias(c) if c == "flags" else F.lit(None).cast(t).alias(c) for c, t in entries.dtypes if c != "id"))
    return set_flag(entries.unionByName(new), ids, EXCLUDED, value)


def mark_deleted(entries: DataFrame, ids: DataFrame, remember: bool) -> DataFrame:
    return set_flag(entries, ids, TOMBSTONE) if remember else entries


def restore_deleted(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return set_flag(entries, ids, TOMBSTONE, False)


def clear_entries(entries: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``clear_derived`` for the given ids only."""
    some = entries.join(ids.select("id").distinct(), "id", "left_semi")
    return entries.join(ids.select("id"), "id", "left_anti").unionByName(clear_derived(some, columns))


def excluded(entries: DataFrame) -> DataFrame:
    return entries.filter(has(F.col("flags"), EXCLUDED)).select("id", "name", "ext")


def failed(entries: DataFrame) -> DataFrame:
    """(id): entries to try again."""
    return entries.filter(has(F.col("flags"), FAILED)).select("id")


def upsert(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """entries with the rows of changes (same columns) in place of theirs of the same id."""
    return entries.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def flag_names(flags: Column) -> Column:
    names = {"image": IS_IMAGE, "excluded": EXCLUDED, "thumbnail error": THUMBNAIL_ERROR, "metadata error": METADATA_ERROR, "too dark": TOO_DARK, "no audio": NO_AUDIO, "audio error": AUDIO_ERROR, "silent": SILENT, "tombstone": TOMBSTONE, "missing": MISSING, "read-only": READ_ONLY}
    return F.array_compact(F.array(*(F.when(has(flags, b), F.lit(n)) for n, b in names.items())))


_IMPORT = "id string, name string, ext string, size long, mtime long, flags int, gray map<string,string>"


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) records of a JSON lines export; a record is taken whole or not at all."""
    rows = spark.read.schema(_IMPORT + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    frames = F.forall(F.map_values("gray"), lambda v: F.coalesce(F.octet_length(F.try_to_binary(v, F.lit("base64"))) == 1024, F.lit(False)))
    ok = F.col("_corrupt").isNull() & F.col("id").rlike("^[A-Za-z0-9]{1,64}$") & (F.length("name") > 0) & F.col("ext").rlike("^[A-Za-z0-9]{1,16}$") & (F.col("size") >= 0) & F.coalesce(frames, F.lit(True))
    marked = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = marked.filter("_ok").drop("_ok", "_corrupt").withColumn("gray", F.transform_values("gray", lambda k, v: F.unbase64(v)))
    return good, marked.filter("NOT _ok").drop("_ok")


def export_json(entries: DataFrame, path: str) -> None:
    """JSON lines with base64 frames."""
    entries.withColumn("gray", F.transform_values("gray", lambda k, v: F.base64(v))).write.mode("overwrite").json(path)


def save(entries: DataFrame, path: str) -> int:
    """Rows replace the table's rows of their ids; only the shards they touch are rewritten (see ``store.save``)."""
    return store.save(entries, path)
