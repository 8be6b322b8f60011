"""Results as they are reviewed: projection, filters of rows and groups, order, statistics, reports."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions import display, kernels as K
from kindred.operators import results, selection
from kindred.sources import cache, media


def described(members: DataFrame) -> DataFrame:
    """The result columns of members (group_id, id, difference, flags, offset, entry_flags, info, name, ext, path, size, created, modified, positions).

    Videos are described by their video stream with the most pixels and the audio stream with the most channels, images by their first stream.
    frame_size_int is width plus height.
    """
    image = cache.has(F.col("entry_flags"), cache.IS_IMAGE)
    streams = F.coalesce(F.col("info.streams"), F.array().cast(dict(members.select("info.streams").dtypes)["streams"]))
    first = F.get(streams, F.lit(0))
    video = F.when(image, first).otherwise(media.video_stream(streams))
    audio = F.when(~image, media.audio_stream(streams))
    single = lambda c: c.cast("float")
    width, height = F.coalesce(video["width"], F.lit(0)), F.coalesce(video["height"], F.lit(0))
    shown = F.when(video.isNotNull(), F.concat(width.cast("string"), F.lit("x"), height.cast("string"))).otherwise("")
    unknown = lambda s, c: F.when(s.isNull(), "").otherwise(F.coalesce(F.nullif(c, F.lit("")), F.lit("<Unknown>")))
    return members.select(
        "id", "group_id", "difference", single(single(1 - single(F.col("difference"))) * 100).alias("similarity"), "flags", F.coalesce("offset", F.lit(0.0)).alias("partial_offset"), image.alias("is_image"),
        F.when(image, F.lit(0).cast("long")).otherwise(F.coalesce("info.duration", F.lit(0).cast("long"))).alias("duration"),
        F.when(image, F.lower("ext")).otherwise(unknown(video, video["codec"])).alias("format"),
        F.when(image | video.isNull(), 0.0).otherwise(video["fps"].cast("double")).alias("fps"),
        F.when(image | video.isNull(), 0).otherwise(display.kilobits(video["bit_rate"])).alias("bit_rate"),
        shown.alias("frame_size"), F.when(video.isNotNull(), width + height).otherwise(0).alias("frame_size_int"),
        F.when(image | video.isNull(), "").otherwise(F.coalesce(video["hdr"], F.lit(""))).alias("hdr"),
        unknown(audio, audio["codec"]).alias("audio_format"), F.coalesce(audio["channels"], F.lit(0)).alias("audio_channels"), F.coalesce(audio["sample_rate"], F.lit(0)).alias("audio_sample_rate"),
        F.when(audio.isNull(), 0).otherwise(display.kilobits(audio["bit_rate"])).alias("audio_bit_rate"),
        F.when(image, "").otherwise(display.join_languages(streams, "audio")).alias("audio_languages"), F.when(image, "").otherwise(display.join_languages(streams, "subtitle", True)).alias("subtitle_languages"),
        "size", "created", "modified", cache.has(F.col("entry_flags"), cache.MISSING).alias("missing"), cache.has(F.col("entry_flags"), cache.TOMBSTONE).alias("tombstone"), "name", "ext", "path", "positions",
    )


def with_live(rows: DataFrame, live: DataFrame) -> DataFrame:
    """rows (id, name, ext, ...) with what the library (id, name, ext, folders, tags) knows of them now; ``gone`` where it has them no more."""
    now = live.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("ext").alias("_ext"), "folders", "tags")
    both = rows.join(now, rows.id == now["_id"], "left").withColumn("gone", F.col("_id").isNull())
    return both.withColumns({"name": F.coalesce("_name", "name"), "ext": F.coalesce("_ext", "ext")}).drop("_id", "_name", "_ext")


def visible(rows: DataFrame, kind: str = "", checked_only: bool = False, text: str = "", flipped: bool = False, ai: bool = False, partial: bool = False, deleted: bool = False, missing: bool = False, least_similarity: float = 0.0, group: str = "group_id") -> DataFrame:
    """rows with ``visible``: the group passes (some member has each wanted property, the best similarity is enough) and the row does.

    A row passes by kind (videos, images), its check mark, and a text that its name.ext, folders or tags contain, whatever the case. Rows
    need only the columns that the filters ask for.
    """
    g = W.partitionBy(group)
    some = lambda c: F.max(F.coalesce(c, F.lit(False))).over(g)
    ok = F.lit(True)
    for wanted, bit in ((flipped, K.FLIPPED), (ai, K.AI_MATCHED), (partial, K.PARTIAL_CLIP)):
        ok = ok & some(F.col("flags").bitwiseAND(F.lit(bit)) != 0) if wanted else ok
    ok = ok & some(F.col("tombstone") | F.col("gone")) if deleted else ok
    ok = ok & some(F.col("missing")) if missing else ok
    ok = ok & (F.max("similarity").over(g) >= least_similarity) if least_similarity > 0 else ok
    if kind:
        ok = ok & (F.col("is_image") if kind == "images" else ~F.col("is_image"))
    ok = ok & F.col("checked") if checked_only else ok
    if text:
        file = F.concat(F.coalesce("name", F.lit("")), F.lit("."), F.coalesce("ext", F.lit("")))
        lists = [F.coalesce(F.array_join(c, " "), F.lit("")) for c in ("folders", "tags") if c in rows.columns]
        ok = ok & F.contains(F.lower(F.concat_ws(" ", file, *lists)), F.lit(text.lower()))
    return rows.withColumn("visible", F.coalesce(ok, F.lit(False)))


#: How groups can be ordered, by which column of ``results.group_stats``.
SORT_KEYS = {"wasted_space": "wasted_space", "total_size": "total_size", "largest_file": "largest_file", "file_count": "file_count", "similarity": "similarity", "created": "last_created", "duration": "longest", "name": "first_name"}


def ordered_groups(rows: DataFrame, mode: str = "wasted_space", descending: bool = True) -> DataFrame:
    """(group_id, key, place): groups by a key over all their members, ties by group_id; place counts from 1."""
    stats = rows.groupBy("group_id").agg(
        F.sum("size").alias("total_size"), F.max("size").alias("largest_file"), (F.sum("size") - F.max("size")).alias("wasted_space"), F.count("*").alias("file_count"), F.max("similarity").alias("similarity"),
        F.max("created").alias("last_created"), F.max("duration").alias("longest"), F.lower(F.min_by("name", "idx")).alias("first_name"),
    )
    key = F.col(SORT_KEYS[mode])
    place = F.row_number().over(W.orderBy(key.desc() if descending else key.asc(), "group_id"))  # one row for each group
    return stats.select("group_id", key.alias("key"), place.alias("place"))


def best_first(rows: DataFrame, criteria: list[selection.Criterion]) -> DataFrame:
    """rows with ``place`` in their group: the keeper first, the others in order of idx."""
    kept = selection.keepers(rows, criteria)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("group_id").orderBy(F.desc("keeper"), "idx")))


def header(rows: DataFrame) -> DataFrame:
    """One row: groups and files that are visible, wasted bytes of their groups, checked files and their bytes."""
    shown = rows.filter("visible")
    groups = shown.select("group_id").distinct()
    wasted = rows.join(groups, "group_id", "left_semi").groupBy("group_id").agg((F.sum("size") - F.max("size")).alias("w")).agg(F.count("*").alias("groups"), F.coalesce(F.sum("w"), F.lit(0)).alias("wasted"))
    files = shown.agg(F.count("*").alias("files"))
    checked = rows.agg(F.count_if("checked").alias("checked"), F.coalesce(F.sum(F.when(F.col("checked"), F.col("size"))), F.lit(0)).alias("checked_bytes"))
    return wasted.join(F.broadcast(files)).join(F.broadcast(checked))  # one row each


def group_flags(rows: DataFrame) -> DataFrame:
    """(group_id, flags): every flag that some member has."""
    return rows.groupBy("group_id").agg(F.bit_or("flags").alias("flags"))


def dry_run_lines(rows: DataFrame) -> DataFrame:
    """(group_id, line_no, line): for each group with a checked row its header, a KEEP or REMOVE line for each row, bytes freed, and a warning where nothing is kept.

    The last line, of group null, is the total.
    """
    report = results.dry_run(rows)
    head = report.select("group_id", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("Group "), F.col("group_id").cast("string")).alias("line"))
    inside = rows.join(report.select("group_id"), "group_id", "left_semi")
    number = F.row_number().over(W.partitionBy("group_id").orderBy("idx")).cast("long")
    each = inside.select("group_id", number.alias("line_no"), F.concat(F.when(F.col("checked"), "  REMOVE ").otherwise("  KEEP   "), "path").alias("line"))
    freed = report.select("group_id", (F.col("kept") + F.col("removed") + 1).alias("line_no"), F.concat(F.lit("  frees "), F.col("freed").cast("string"), F.lit(" bytes")).alias("line"))
    warn = report.filter("nothing_kept").select("group_id", (F.col("removed") + 2).alias("line_no"), F.lit("  WARNING: nothing of this group is kept").alias("line"))
    total = report.agg(F.count("*").alias("n"), F.coalesce(F.sum("removed"), F.lit(0)).alias("r"), F.coalesce(F.sum("freed"), F.lit(0)).alias("f"))
    last = total.select(F.lit(None).cast(dict(rows.dtypes)["group_id"]).alias("group_id"), F.lit(0).cast("long").alias("line_no"), F.format_string("Total: %d groups, %d files, %d bytes", "n", "r", "f").alias("line"))
    return head.unionByName(each).unionByName(freed).unionByName(warn).unionByName(last)


#: The columns of the CSV export, and their titles.
CSV_COLUMNS = ("group_id", "name", "ext", "path", "similarity", "duration", "frame_size", "format", "fps", "bit_rate", "audio_format", "audio_channels", "audio_sample_rate", "size", "created", "tags", "folders", "checked")


def csv_report(rows: DataFrame, order: DataFrame) -> DataFrame:
    """(line_no, line): a title line, behind a byte order mark, and the rows by their group's place (group_id, place) and idx."""
    lines = results.csv_lines(rows.join(order.select("group_id", "place"), "group_id"), list(CSV_COLUMNS), ["place", "idx"])
    title = rows.sparkSession.createDataFrame([(-1, -1, "\ufeff" + ",".join(f'"{c}"' for c in CSV_COLUMNS))], "place int, idx long, line string")
    return title.unionByName(lines.select("place", F.col("idx").cast("long").alias("idx"), "line"))


def html_report(rows: DataFrame, title: str = "Duplicates") -> Iterator[str]:
    """The pieces of an HTML page of rows (group_id, idx, name, path, size, checked), group by group; read row by row, never gathered."""
    yield f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"
    now = None
    for r in rows.orderBy("group_id", "idx").toLocalIterator():
        if r["group_id"] != now:
            yield ("</table>" if now is not None else "") + f"<h2>Group {html.escape(str(r['group_id']))}</h2><table>"
            now = r["group_id"]
        cells = "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in ("name", "path", "size"))
        yield f"<tr{' class=checked' if r['checked'] else ''}>{cells}</tr>"
    yield "</table>" if now is not None else ""


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of a listing."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def listing(entries: DataFrame, part: str = "") -> DataFrame:
    """Entries whose name or id contains a text, whatever its case."""
    low = F.lit(part.lower())
    return entries.filter(F.contains(F.lower(F.coalesce("name", F.lit(""))), low) | F.contains(F.lower("id"), low)) if part else entries


def next_position(positions: Column, now: Column, forward: bool = True, tolerance: float = 0.01) -> Column:
    """The next (or last) sampled position from the present one, around the ends; null without positions."""
    beyond = F.filter(positions, lambda p: p > now + tolerance if forward else p < now - tolerance)
    return F.when(F.size(positions) > 0, F.coalesce(F.array_min(beyond), F.array_min(positions)) if forward else F.coalesce(F.array_max(beyond), F.array_max(positions)))


def remaining_seconds(elapsed: float, done: int, total: int) -> float:
    """What a phase still takes, by its pace so far."""
    return elapsed * max(total - done, 0) / (done + 1)
