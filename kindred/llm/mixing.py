"""Operator 5: mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share ``SHARE`` times the words of all
documents. A target stops at ``MOST`` times its source's words; the excess is shared again by weight. So
target = least(MOST * size, level * weight), where the level follows from a running sum over the sources.

A document's expected copies are target / source size: the whole part is certain, the fraction is rounded by the
pivotal method (Deville and Tillé, 1998): two units' probabilities meet, mass moves at random to one of them
until one is 0 or 1, and the other goes on with what remains. Expectations hold exactly, and of n units with one
probability p, as many as n p are taken, up to one. Pairs meet in a reduction tree: each source's
documents are hashed into groups of about ``FAN``, each is folded from the longest down (so alike documents compete, the last one is short,
and words stay near the target), and the one unfinished unit of each group goes to the next level, until one is
left for each source. A source of any size is spread over many groups, and a group stays small.

Random numbers are hashes of ids, level and ``SEED``: reruns agree. Null and wordless texts have size 0. Repeated rows are units
of their own. Null ids and null sources are values like others. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import read, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
FAN = 64
SEED = 20240229
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """docs with the number of words of each text as size."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) of sources (source, source_size, n): one row for each source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (nth + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    level = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    # the first source that its share does not fill sets the level for itself and all later ones
    levels = ranked.withColumn("level", F.when(level <= F.col("ratio"), level))
    found = levels.withColumn("level", F.max("level").over(everything))
    return found.select("source", "source_size", "n", F.least(most * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), most * F.col("source_size"))).cast("double").alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11)).cast("double") / float(1 << 53)


_UNIT = "struct<doc_id:bigint,size:bigint,p:double,copy:bigint>"


def _fold(units: Column, level: int) -> Column:
    """(left: the unfinished unit or null, done: units with their decision as p) of a group's sorted units."""

    def meet(state: Column, unit: Column) -> Column:
        a, b = state["left"], unit
        total = a["p"] + b["p"]
        u = _uniform(F.lit(level), a["doc_id"], b["doc_id"], a["copy"], b["copy"])
        low = total < 1.0
        # the chance that the mass goes on with b: then a is finished, at 0 or at 1
        go = F.when(low, u * total < b["p"]).otherwise(u * (2.0 - total) < (1.0 - b["p"]))
        rest = F.when(low, total).otherwise(total - 1.0)
        end = F.when(low, F.lit(0.0)).otherwise(F.lit(1.0))
        on = F.when(go, b).otherwise(a)
        off = F.when(go, a).otherwise(b)
        left = F.struct(on["doc_id"].alias("doc_id"), on["size"].alias("size"), rest.alias("p"), on["copy"].alias("copy"))
        done = F.struct(off["doc_id"].alias("doc_id"), off["size"].alias("size"), end.alias("p"), off["copy"].alias("copy"))
        return F.struct(left.cast(_UNIT).alias("left"), F.concat(state["done"], F.array(done.cast(_UNIT))).alias("done"))

    first = F.struct(units[0].cast(_UNIT).alias("left"), F.array().cast(f"array<{_UNIT}>").alias("done"))
    return F.aggregate(F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(0))), first, meet)


def _level(units: DataFrame, level: int) -> DataFrame:
    """One level of the tree: units (source, source_size, target, groups, doc_id, size, p, copy) in groups of about FAN."""
    group = F.pmod(F.xxhash64(F.lit(SEED + level), "doc_id", "copy"), F.col("groups"))
    unit = F.struct("size", "doc_id", "copy", "p")
    grouped = units.groupBy("source", "source_size", "target", "groups", group.alias("g")).agg(F.sort_array(F.collect_list(unit), asc=False).alias("units"))
    ordered = F.transform("units", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["p"].alias("p"), x["copy"].alias("copy")))
    return grouped.select("source", "source_size", "target", "groups", _fold(ordered, level).alias("f"))


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, copy) for each row of docs (doc_id, source, size)."""
    rows = docs.select(F.col("doc_id").cast("long"), "source", "size")
    # rows that are alike in all of these are told apart by a number
    repeated = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    sources = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most), "sources")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = stage(
        repeated.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "source_size", "target", "doc_id", "size", expected.alias("e"), F.ceil(F.col("n") / FAN).alias("groups"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
        .select("source", "source_size", "target", "doc_id", "size", F.floor("e").alias("sure"), (F.col("e") - F.floor("e")).alias("p"), "groups", "copy"),
        "units",
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "copies", "copy"]
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    out = units.filter("p = 0").select("doc_id", "source", "size", "source_size", "target", F.col("sure").alias("copies"), "copy")
    left, level = units.filter("p > 0").select("source", "source_size", "target", "groups", "doc_id", "size", "p", "copy"), 0
    most_groups = sources.agg(F.max(F.ceil(F.col("n") / FAN))).first()[0] or 1
    while True:
        folded = stage(_level(left, level), f"level{level}")
        done = folded.select("source", "source_size", "target", F.explode("f.done").alias("u"))
        out = out.union(done.select("u.doc_id", "source", "u.size", "source_size", "target", (whole + F.col("u.p")).cast("long").alias("copies"), "u.copy"))
        left = folded.select("source", "source_size", "target", "groups", "f.left.*")
        last = left.filter("groups <= 1")
        drawn = F.when(_uniform(F.lit(-1), F.col("doc_id"), F.col("copy")) < F.col("p"), 1).otherwise(0)
        out = out.union(last.select("doc_id", "source", "size", "source_size", "target", (whole + drawn).cast("long").alias("copies"), "copy"))
        if most_groups <= 1:
            return out.select(*columns)
        left = left.filter("groups > 1").withColumn("groups", F.ceil(F.col("groups") / FAN))
        most_groups = -(-most_groups // FAN)
        level += 1


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source)."""
    rows = stage(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size"), "sizes")
    return copies(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
