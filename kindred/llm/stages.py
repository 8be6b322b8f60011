"""Operators as filters of a corpus: each takes and returns rows of documents (doc_id, text, lang, source, n_chars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, mixing, near_dup
from ._shared import id_filter, parted, read, stage, unstage


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined (operator 6, trained on these documents)."""
    return language_id.identified(docs, language_id.train(docs))


def drop_recurring_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines (operator 2); n_chars follows where a text changed."""
    out = line_dedup.dedup_lines(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 3), the one with the smallest id.

    Rows that share the kept id stay if their texts differ; of rows alike in id and text one stays, the same in every run. Documents
    without words and those with a null id stay. Only documents that may have to go are shuffled with their texts.
    """
    near = near_dup.near_duplicates(docs)
    found = stage(near.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept")), "found")
    touched = stage(found.filter("NOT kept OR rows > 1").select(F.col("doc_id").alias("_kindred_doc"), F.col("kept").alias("_kindred_kept")), "touched")
    unstage(found)
    inside, rest = parted(docs, id_filter(touched, "_kindred_doc"))
    maybe = inside.hint("merge").join(touched.hint("merge"), inside.doc_id == touched["_kindred_doc"], "left").filter("_kindred_kept IS NULL OR _kindred_kept")
    others = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    same = W.partitionBy("doc_id", "text").orderBy(F.xxhash64(*others), *others) if others else W.partitionBy("doc_id", "text").orderBy("doc_id")
    once = maybe.withColumn("_kindred_row", F.row_number().over(same)).filter("_kindred_row = 1")
    return once.select(*docs.columns).unionByName(rest)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item (operator 1)."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


#: What the mix adds to documents.
MIXED = ["size", "source_size", "target", "copies", "taken"]


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes (operator 5), with size, source_size, target, copies and taken words.

    Columns of documents with these names go on as input_<name>. Of rows alike in doc_id, source and size, each takes one of
    their numbers of copies, chosen by a hash of its text.
    """
    docs = docs.withColumnsRenamed({c: f"input_{c}" for c in docs.columns if c in MIXED})
    columns = docs.columns
    rows = mixing.sized(docs)
    sizes = stage(rows.select("doc_id", "source", "size"), "sizes")
    mixed = mixing.copies(sizes)
    of_key = mixed.groupBy("doc_id", "source", "size", "source_size", "target").agg(F.sort_array(F.collect_list("copies")).alias("numbers"))
    key = of_key.select(F.col("doc_id").alias("_k1"), F.col("source").alias("_k2"), F.col("size").alias("_k3"), "source_size", "target", F.col("numbers").alias("_numbers"))
    joined = rows.join(key, rows.doc_id.eqNullSafe(key["_k1"]) & rows.source.eqNullSafe(key["_k2"]) & (rows["size"] == key["_k3"]))
    chosen = F.col("_numbers")[F.pmod(F.xxhash64("text"), F.size("_numbers")).cast("int")]
    out = joined.withColumn("copies", chosen).filter("copies > 0").withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*columns, *MIXED)
