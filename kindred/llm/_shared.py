"""Tables that cut lineage, and filters of bounded size, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of an id filter: 16 for each id, between these bounds (1 MB and 32 MB), so it stays sparse up to some 20 million ids.
FILTER_BITS, MOST_FILTER_BITS = 1 << 23, 1 << 28
_BUCKET_BITS = 32768


#: Bytes of an Arrow batch at most: batches of whole texts must fit beside the JVM's heap.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES where it is higher (it stays so: plans run later)."""
    now = spark.conf.get(_BATCH, None)
    if now is None or not str(now).isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kindred-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: survives lost executors, cuts lineage.

    Tables lie in one folder for each application, which goes when the driver ends; those that no result reads go earlier (``unstage``).
    """
    spark = df.sparkSession
    limit_batches(spark)
    own = f"{shared_dir(spark)}/kindred/{spark.sparkContext.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _path(spark, own)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            at, files = _path(df.sparkSession, path)
            files.delete(at, True)


def filter_bits(number: int) -> int:
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (16 * max(number, 1) - 1).bit_length()))


def id_filter(ids: DataFrame, column: str, number: int | None = None) -> np.ndarray:
    """A bitmap over hashes of the ids, sized by their number (counted if it isn't given) within fixed bounds.

    It only spares work: an id may pass it by accident, none is missed, and an exact join follows before anything larger than the rows
    themselves is made.
    """
    bits = filter_bits(ids.count() if number is None else number)
    h = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits)).cast("long")
    rows = (
        ids.select(F.floor(h / _BUCKET_BITS).cast("int").alias("b"), (h % _BUCKET_BITS).alias("p"))
        .groupBy("b")
        .agg(F.bitmap_construct_agg("p").alias("m"))
        .collect()  # one job; toLocalIterator() runs one for each partition, one after another
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        out[r["b"] * (_BUCKET_BITS // 8) :][: len(m)] = m
    return out


def hash_bit(column: str, bitmap: np.ndarray) -> F.Column:
    """The bit of an id in this ``id_filter``, as a column."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(len(bitmap) * 8)).cast("int")


def passes(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


#: The name of the column that holds a row's bit.
BIT = "_kindred_bit"


def _passing(bitmap: np.ndarray, inside: bool):
    def run(batches):
        for batch in batches:
            bit = batch.column(BIT)
            hit = passes(bitmap, bit.fill_null(0).to_numpy(zero_copy_only=False)) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit if inside else ~hit)).drop_columns([BIT])

    return run


def parted(docs: DataFrame, bitmap: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id passes the bitmap, the others with those of a null id), both with the columns of docs."""
    shared = docs.withColumn(BIT, hash_bit("doc_id", bitmap))
    return shared.mapInArrow(_passing(bitmap, True), docs.schema), shared.mapInArrow(_passing(bitmap, False), docs.schema)


def with_lists(docs: DataFrame, lists: DataFrame, key: str, number: int | None = None) -> DataFrame:
    """The rows of docs (doc_id, ...) whose id is the key of a row of lists, joined with it: only rows that pass a bitmap are shuffled."""
    inside, _ = parted(docs, id_filter(lists, key, number))
    return inside.hint("merge").join(lists.hint("merge"), inside.doc_id == lists[key]).drop(key)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node of the edges reaches.

    Rounds of minimum labels over the links and a pointer jump, each a few shuffles; labels
    and links stay distributed, only the number of changed labels reaches the driver.
    Joins that meet a hot node are plain sort-merge joins of two exchanged tables, so that
    adaptive execution may split them; the aggregates combine before they shuffle.
    """
    edges = stage(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")), "edges")
    # one link for each larger end, to the smallest it has, and links among its smaller ends: fewer, and as connected
    least = stage(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
    among = edges.hint("merge").join(least.hint("merge"), "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b").distinct()
    fewer = stage(least.select(F.col("m").alias("a"), "b").union(among), "fewer")
    both = stage(fewer.select(F.col("a").alias("u"), F.col("b").alias("v")).union(fewer.select(F.col("b").alias("u"), F.col("a").alias("v"))), "links")
    unstage(edges, least, fewer)
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.hint("merge").join(labels.hint("merge"), both.u == labels.node).groupBy(F.col("v").alias("n")).agg(F.min("label").alias("m"))
        step = stage(labels.join(near, labels.node == near.n, "left").select("node", F.least("label", "m").alias("label"), F.col("label").alias("was")), "step")
        at = step.select(F.col("node").alias("t"), F.col("label").alias("further"))
        jumped = stage(step.hint("merge").join(at.hint("merge"), step.label == at.t, "left").select("node", F.coalesce("further", "label").alias("label"), "was"), "labels")
        changed = jumped.filter("label <> was").limit(1).count()
        unstage(labels, step)
        labels = jumped
        if not changed:
            break
    unstage(both)
    out = labels.select("node", "label")
    out._staged_path = labels._staged_path
    return out
