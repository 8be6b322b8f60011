"""Tables that live from scan to scan: sharded entries with atomic versions, dense timelines, lists, results, settings, logs.

A sharded table is a folder of ``version=<n>/shard=<k>`` Parquet folders and a manifest that names each shard's version. A save rewrites
the touched shards under a new version and then replaces the manifest, so a reader sees all of a save or nothing, and a save that is
repeated or lost half-way changes nothing. ``spark.read.parquet`` of the folder reads the present rows, as older versions are removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SHARDS = 64
_MANIFEST = "_manifest.json"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, from any store that Spark reads."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and moves it there."""
    at, files = _files(spark, path)
    part, _ = _files(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = files.create(part)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = files.makeQualified
    context.rename(qualified(part), qualified(at), options)


def manifest(spark: SparkSession, path: str) -> dict:
    text = read_text(spark, f"{path}/{_MANIFEST}")
    return json.loads(text) if text else {"version": 0, "shards": {}, "batch": -1}


def load(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The present rows of a sharded table; of a table that was never written, none (then a schema is needed)."""
    now = manifest(spark, path)
    parts = [f"{path}/version={v}/shard={k}" for k, v in sorted(now["shards"].items())]
    lost = [p for p in parts if not exists(spark, p)]
    if lost:
        raise FileNotFoundError(f"the table {path} lacks {lost[0]}, which its manifest names")
    if not parts:
        if schema is None:
            raise FileNotFoundError(f"there is no table at {path}")
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*parts) if schema is not None else spark.read.parquet(*parts)


def save(changes: DataFrame, path: str, deleted: DataFrame | None = None, batch: int | None = None) -> int:
    """Rows of changes (id, ...) replace those of their ids; ids of ``deleted`` go. Only shards that these touch are read and rewritten.

    Returns the table's version. A batch whose number isn't above the last one written was written before and is skipped.
    """
    spark = changes.sparkSession
    now = manifest(spark, path)
    if batch is not None and batch <= now["batch"]:
        return now["version"]
    shard = F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int")
    ids = changes.select("id") if deleted is None else changes.select("id").union(deleted.select("id"))
    touched = sorted(r["shard"] for r in ids.select(shard.alias("shard")).distinct().collect())
    if not touched:
        return now["version"]
    out = changes
    old = [f"{path}/version={now['shards'][str(k)]}/shard={k}" for k in touched if str(k) in now["shards"]]
    if old:
        kept = spark.read.schema(changes.schema).parquet(*old).join(ids.distinct(), "id", "left_anti")
        out = kept.unionByName(changes)
    version = now["version"] + 1
    out.withColumn("shard", shard).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/version={version}")
    written = [k for k in touched if exists(spark, f"{path}/version={version}/shard={k}")]  # a shard all of whose rows went has none
    shards = {k: v for k, v in now["shards"].items() if int(k) not in touched} | {str(k): version for k in written}
    write_text(spark, f"{path}/{_MANIFEST}", json.dumps({"version": version, "shards": shards, "batch": now["batch"] if batch is None else batch}))
    for folder in old:
        at, files = _files(spark, folder)
        files.delete(at, True)
    for v in {now["shards"][str(k)] for k in touched if str(k) in now["shards"]} - set(shards.values()):
        at, files = _files(spark, f"{path}/version={v}")
        files.delete(at, True)
    return version


def readable_entries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with valid ids, those set aside)."""
    ok = F.coalesce(F.col("id").rlike(r"^[A-Za-z0-9]{1,64}$"), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def write_dense(timelines: DataFrame, path: str) -> None:
    """Appends timelines (id, size, mtime, failed, interval, emb, valid): one row for a file's state; ``failed`` marks files that gave none."""
    timelines.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def read_dense(dense: DataFrame, items: DataFrame) -> DataFrame:
    """items (id, size, mtime) with their timeline's columns; only a timeline of the same size and time counts, the last one written."""
    own = [c for c in dense.columns if c not in ("id", "size", "mtime", "written")]
    last = dense.groupBy("id", "size", "mtime").agg(F.max_by(F.struct(*own), "written").alias("_t")) if "written" in dense.columns else dense.select("id", "size", "mtime", F.struct(*own).alias("_t"))
    return items.join(last, ["id", "size", "mtime"], "left").select(*items.columns, F.col("_t").isNotNull().alias("found"), *(F.col(f"_t.{c}").alias(c) for c in own))


def save_results(rows: DataFrame, path: str) -> None:
    """Results as JSON lines under a new version; the pointer moves when they are complete."""
    spark = rows.sparkSession
    name = f"results-{uuid.uuid4().hex}"
    rows.write.json(f"{path}/{name}", ignoreNullFields=False)
    before = read_text(spark, f"{path}/_current")
    write_text(spark, f"{path}/_current", name)
    if before:
        at, files = _files(spark, f"{path}/{before}")
        files.delete(at, True)


def load_results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return valid_results(spark.read.schema(schema).json(f"{path}/{read_text(spark, f'{path}/_current')}"))[0]


def valid_results(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) result rows: id, name, ext and group_id must be well formed."""
    from kindred.operators import scope

    ok = scope.valid_id(F.col("id")) & scope.valid_name(F.col("name")) & scope.valid_extension(F.col("ext")) & F.coalesce(F.col("group_id") >= 1, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def save_settings(spark: SparkSession, path: str, values: dict) -> None:
    write_text(spark, path, json.dumps(values, sort_keys=True))


def load_settings(spark: SparkSession, path: str) -> dict:
    text = read_text(spark, path)
    return json.loads(text) if text else {}


def write_log(lines: DataFrame, path: str) -> None:
    """Log rows (time, level, message) as text, in order of time."""
    lines.orderBy("time").select(F.concat_ws(" ", F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.upper("level"), "message").alias("value")).write.mode("overwrite").text(path)


def file_columns(files: DataFrame) -> DataFrame:
    """(path, size, mtime) of files read with any of Spark's file sources."""
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.unix_millis("_metadata.file_modification_time").alias("mtime"))
