"""Result groups: best marks, sort keys, differences, reports, merge plans, suppression and regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions.kernels import hdr_rank


def mark_best(items: DataFrame, most: list[str], least: list[str], group: str = "group_id") -> DataFrame:
    """items with is_best_<column> where a row has the group's largest (or least) value; ties are all marked."""
    g = W.partitionBy(group)
    return items.withColumns({f"is_best_{c}": F.col(c) == F.max(c).over(g) for c in most} | {f"is_best_{c}": F.col(c) == F.min(c).over(g) for c in least})


#: Metrics that only videos have.
VIDEO_METRICS = ("duration", "fps", "bit_rate", "audio_sample_rate", "audio_bit_rate")


def highlight_best(items: DataFrame, prefers_larger: bool = False, group: str = "group_id") -> DataFrame:
    """items with the eight best marks of the domain: the most of each metric, the least size (the largest if that is preferred), the best HDR.

    Groups of images (by their first row) have no marks for what only videos have.
    """
    g = W.partitionBy(group)
    image = F.min_by(F.col("is_image"), F.col("idx")).over(g)
    rank = hdr_rank(F.col("hdr"))
    marks = {f"is_best_{c}": ~image & (F.col(c) == F.max(c).over(g)) for c in VIDEO_METRICS}
    marks["is_best_hdr"] = ~image & (rank == F.max(rank).over(g))
    marks["is_best_frame_size"] = F.col("frame_size") == F.max("frame_size").over(g)
    marks["is_best_size"] = F.col("size") == (F.max("size") if prefers_larger else F.min("size")).over(g)
    return items.withColumns(marks)


def group_stats(items: DataFrame, group: str = "group_id") -> DataFrame:
    """Sort keys of each group: total, largest and wasted size, files, similarity, first date, longest duration, first name."""
    return items.groupBy(group).agg(
        F.sum("size").alias("total_size"),
        F.max("size").alias("largest_file"),
        (F.sum("size") - F.max("size")).alias("wasted_space"),
        F.count("*").alias("file_count"),
        F.max("similarity").alias("similarity"),
        F.min("created").alias("first_created"),
        F.max("duration").alias("longest"),
        F.min("name").alias("first_name"),
    )


def duration_label(seconds: Column) -> Column:
    """A signed difference in seconds as -13s, +1m05s or +1h02m05s."""
    s = F.abs(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    body = F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), body)


def percent_label(value: Column, best: Column) -> Column:
    """The difference to the best in whole percent, half up: -20%."""
    p = F.floor((value - best) * 100.0 / best + 0.5).cast("long")
    return F.concat(F.when(p < 0, "").otherwise("+"), p.cast("string"), F.lit("%"))


def hover_differences(items: DataFrame, column: str, label: str = "percent", group: str = "group_id", least: bool = False, above: float | None = None) -> DataFrame:
    """items with diff_<column>: null if all of a group are equal, BEST for the largest (``least``: smallest), otherwise the difference to it.

    With ``above``, values are compared only with a best beyond it.
    """
    g = W.partitionBy(group)
    high, low = F.max(column).over(g), F.min(column).over(g)
    best = low if least else high
    text = duration_label(F.col(column) - best) if label == "duration" else signed_percent(F.col(column), best) if label == "signed" else percent_label(F.col(column), best)
    text = F.when(best > above, text) if above is not None else text
    return items.withColumn(f"diff_{column}", F.when(high == low, F.lit(None)).when(F.col(column) == best, "BEST").otherwise(text))


def hover_all(items: DataFrame) -> DataFrame:
    """items with the differences of all six metrics to their group's best; size counts as best where it is smallest."""
    out = hover_differences(hover_differences(items, "duration", "duration"), "size", "signed", least=True, above=0)
    for c, above in (("frame_size", 0), ("fps", 0.01), ("bit_rate", 0), ("audio_bit_rate", 0)):
        out = hover_differences(out, c, "signed", above=above)
    return out


def signed_percent(value: Column, best: Column) -> Column:
    """The difference to the best in percent: = below half a percent, else signed and rounded half up by its size."""
    p = (value - best) / best * 100.0
    return F.when(F.abs(p) < 0.5, "=").otherwise(F.concat(F.when(p < 0, "-").otherwise("+"), F.floor(F.abs(p) + 0.5).cast("long").cast("string"), F.lit("%")))


def dry_run(items: DataFrame, group: str = "group_id") -> DataFrame:
    """For each group with a checked row: rows kept and removed, bytes freed, and whether nothing would be kept."""
    checked = F.col("checked")
    each = items.groupBy(group).agg(
        F.count_if(~checked).alias("kept"), F.count_if(checked).alias("removed"), F.coalesce(F.sum(F.when(checked, F.col("size"))), F.lit(0)).alias("freed"), F.bool_and(checked).alias("nothing_kept")
    )
    return each.filter("removed > 0")


def suppress(groups: DataFrame, not_a_match: DataFrame) -> DataFrame:
    """groups (group_id, ids) that are not wholly inside one set of not_a_match (ids)."""
    sets = not_a_match.select(F.col("ids").alias("set_ids"), F.explode("ids").alias("id"))
    inside = groups.select("group_id", "ids", F.element_at("ids", 1).alias("id")).join(sets, "id").filter(F.size(F.array_except("ids", "set_ids")) == 0).select("group_id").distinct()
    return groups.join(inside, "group_id", "left_anti")


def regroup(members: DataFrame, removed: DataFrame, group: str = "group_id", idx: str = "idx") -> DataFrame:
    """members without the removed ones; groups of fewer than two go."""
    left = members.join(removed.select(idx).distinct(), idx, "left_anti")
    return left.withColumn("_n", F.count("*").over(W.partitionBy(group))).filter("_n >= 2").drop("_n")


def merge_plan(items: DataFrame, group: str = "group_id", idx: str = "idx", note_limit: int = 10_000) -> DataFrame:
    """For each group what its keeper gets: united tags in order of appearance, best rating, joined notes, first url.

    Notes are joined by a blank line as long as whole notes fit the limit; the keeper is the row with the smallest idx.
    """
    row = F.struct(F.col(idx).alias("idx"), "tags", "rating", "note", "url")
    rows = items.groupBy(group).agg(F.sort_array(F.collect_list(row)).alias("r"))
    tags = F.aggregate("r", F.array().cast("array<string>"), lambda s, x: F.array_union(s, F.coalesce(x["tags"], F.array().cast("array<string>"))))

    def add(s: Column, x: Column) -> Column:
        n = F.coalesce(x["note"], F.lit(""))
        both = F.when(s == "", n).otherwise(F.concat(s, F.lit("\n\n"), n))
        return F.when((n == "") | F.contains(s, n) | (F.length(both) > note_limit), s).otherwise(both)

    note = F.aggregate("r", F.lit(""), add)
    url = F.element_at(F.filter(F.transform("r", lambda x: F.coalesce(x["url"], F.lit(""))), lambda u: u != ""), 1)
    filled = F.when(F.exists("r", lambda x: F.coalesce(x["url"], F.lit("")) != ""), url).otherwise("")
    return rows.select(group, F.col("r")[0]["idx"].alias("keeper"), tags.alias("tags"), F.array_max(F.transform("r", lambda x: x["rating"])).alias("rating"), note.alias("note"), filled.alias("url"))


def metadata_pivot(tags: DataFrame, columns: list, only_differing: bool = True) -> DataFrame:
    """Metadata (id, tag, value) as one row for each tag and one column for each item; only tags whose values differ."""
    wide = tags.groupBy("tag").pivot("id", columns).agg(F.first("value"))
    if not only_differing:
        return wide
    differ = tags.groupBy("tag").agg(F.count_distinct(F.coalesce("value", F.lit(""))).alias("n"), F.count("*").alias("k")).filter((F.col("n") > 1) | (F.col("k") < len(columns))).select("tag")
    return wide.join(differ, "tag", "left_semi")


def numbered_names(items: DataFrame, name: str = "name", ext: str = "ext", idx: str = "idx") -> DataFrame:
    """items with export_name: equal names (whatever their case) get (2), (3), ... in order of idx."""
    k = F.row_number().over(W.partitionBy(F.lower(name), F.lower(ext)).orderBy(idx))
    return items.withColumn("export_name", F.concat(F.col(name), F.when(k > 1, F.format_string(" (%d)", k)).otherwise(""), F.lit("."), F.col(ext)))


def csv_lines(items: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One quoted CSV line for each row (beside the columns to keep); quotes doubled, arrays joined by "; "."""
    def cell(c: str) -> Column:
        col = F.array_join(c, "; ") if dict(items.dtypes)[c].startswith("array") else F.col(c).cast("string")
        return F.concat(F.lit('"'), F.replace(F.coalesce(col, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))

    return items.select(*(keep or []), F.concat_ws(",", *(cell(c) for c in columns)).alias("line"))


def results_union(*parts: tuple[str, DataFrame]) -> DataFrame:
    """The results (id, ...) of several searches in one table, all rows, with their kind."""
    out = None
    for kind, df in parts:
        named = df.withColumn("kind", F.lit(kind))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def tag_union(items: DataFrame, group: str, tags: str) -> DataFrame:
    """(group, tags): all tags of a group's items, sorted."""
    return items.select(group, F.explode(tags).alias("_t")).groupBy(group).agg(F.sort_array(F.collect_set("_t")).alias("tags"))


def added(own: Column, others: Column) -> Column:
    """What a merge would add to a list: values of the others that it lacks, in their order."""
    return F.array_except(others, own)


def prune_sets(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """Sets (set_id, ids) of a not-a-match list whose ids are all known (id)."""
    each = sets.select("set_id", F.explode("ids").alias("id"))
    broken = each.join(ids.select("id").distinct(), "id", "left_anti").select("set_id").distinct()
    return sets.join(broken, "set_id", "left_anti")
