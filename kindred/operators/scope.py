"""Scope, exclusions and ordered rejection of items; folder trees and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import kernels as K
from kindred.operators.lineage import cut


def folder_closure(folders: DataFrame) -> DataFrame:
    """(ancestor, id, depth): each folder of (id, parent) under each of its ancestors, itself included at depth 0.

    Paths double from round to round, so a tree of depth d takes log2(d) joins, however many rows. A parent that is no folder ends a
    path; folders in a cycle raise an error.
    """
    known = folders.select("id", "parent").filter("id IS NOT NULL")
    parents = known.select(F.col("id").alias("p"))
    hops = cut(known.join(parents, known.parent == parents.p, "left_semi").select("id", F.col("parent").alias("up")))
    closure, length = cut(known.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth"))), 1
    number = known.count()
    while hops.limit(1).count():
        if length > number:
            raise ValueError("the folders have a cycle")
        step = hops.select(F.col("id").alias("ancestor"), "up")
        closure = cut(closure.union(closure.join(step, "ancestor").select(F.col("up").alias("ancestor"), "id", (F.col("depth") + length).alias("depth"))))
        further = hops.select(F.col("id").alias("up"), F.col("up").alias("higher"))
        hops, length = cut(hops.join(further, "up").select("id", F.col("higher").alias("up"))), 2 * length
    return closure


def folder_paths(folders: DataFrame) -> DataFrame:
    """(id, path, depth) of folders (id, name, parent): names from the root down, joined by slashes; a folder whose parent is unknown is a root."""
    names = folders.select(F.col("id").alias("ancestor"), F.coalesce("name", F.lit("")).alias("name"))
    each = folder_closure(folders).join(names, "ancestor")
    parts = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("up"), "name"))).alias("p"))
    return parts.select("id", F.array_join(F.transform("p", lambda x: x["name"]), "/").alias("path"), (F.size("p") - 1).alias("depth"))


def chosen_folders(chosen: DataFrame, folders: DataFrame, with_subfolders: bool = True) -> DataFrame:
    """(folder): the chosen folders (id), with what lies under them."""
    if not with_subfolders:
        return chosen.select(F.col("id").alias("folder")).distinct()
    return folder_closure(folders).join(chosen.select(F.col("id").alias("ancestor")), "ancestor").select(F.col("id").alias("folder")).union(chosen.select("id")).distinct()


def in_folders(items: DataFrame, chosen: DataFrame, folders: DataFrame, with_subfolders: bool = True) -> DataFrame:
    """items (id, folders) with one of the chosen folders (id), or of what lies under them."""
    under = chosen_folders(chosen, folders, with_subfolders)
    ids = items.select("id", F.explode("folders").alias("folder")).join(under, "folder", "left_semi").select("id").distinct()
    return items.join(ids, "id", "left_semi")


def scoped(items: DataFrame, s, folders: DataFrame | None = None, selection: DataFrame | None = None, smart: dict[str, Column] | None = None, against_rest: bool = False) -> DataFrame:
    """items (id, folders, tags, ...) with in_scope, by the settings' scope mode; exclusions by folder or tag go first.

    Modes: library (all), selection (ids of ``selection``), folders, smartFolders (conditions by id in ``smart``), tags (any or all). Only
    items in scope stay unless they are compared ``against_rest``.
    """
    spark = items.sparkSession
    named = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    if s.exclude_tags:
        items = items.filter(~F.coalesce(has_tags(F.col("tags"), list(s.exclude_tags), False), F.lit(False)))
    if s.exclude_folder_ids:
        items = items.join(in_folders(items, named(s.exclude_folder_ids), folders).select("id"), "id", "left_anti")
    if s.scope_mode == "tags":
        inside = items.withColumn("in_scope", F.coalesce(has_tags(F.col("tags"), list(s.scope_tags), s.scope_tags_match_all), F.lit(False)))
    elif s.scope_mode in ("selection", "folders"):
        ids = selection if s.scope_mode == "selection" else in_folders(items, named(s.scope_folder_ids), folders, s.include_sub_directories)
        ids = ids.select(F.col("id").alias("_i")).distinct()
        inside = items.join(ids, items.id == ids["_i"], "left").withColumn("in_scope", F.col("_i").isNotNull()).drop("_i")
    elif s.scope_mode == "smartFolders":
        rules = [F.coalesce(rule, F.lit(False)) for i, rule in (smart or {}).items() if i in s.scope_folder_ids]
        inside = items.withColumn("in_scope", _any(rules) if rules else F.lit(False))
    else:
        inside = items.withColumn("in_scope", F.lit(True))
    return inside if against_rest else inside.filter("in_scope")


def smart_folders(tree: DataFrame, levels: int = 8) -> DataFrame:
    """(id, name, depth, rule): nested smart folders (id, name, rule, parent) flattened; levels below the given number raise an error."""
    flat = folder_closure(tree).groupBy("id").agg(F.max("depth").alias("depth"))
    if flat.filter(F.col("depth") > levels).limit(1).count():
        raise ValueError("smart folders are nested too deeply")
    return tree.join(flat, "id").select("id", "name", "depth", "rule")


#: What missing fields of an item count as.
ITEM_DEFAULTS = {"name": "", "ext": "", "width": 0, "height": 0, "size": 0, "star": 0, "importedAt": 0, "modifiedAt": 0, "url": "", "annotation": "", "noThumbnail": False}


def normalised_items(items: DataFrame) -> DataFrame:
    """items with defaults in place of nulls; missing lists are empty."""
    kinds = dict(items.dtypes)
    fill = {c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in ITEM_DEFAULTS.items() if c in kinds}
    fill |= {c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in ("folders", "tags") if c in kinds}
    return items.withColumns(fill)


def by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The items whose id is wanted; the join picks its own strategy by size."""
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def virtual_paths(folders: Column, name: Column, ext: Column, path: Column) -> Column:
    """folder/name.ext for each folder of an item (or name.ext alone), and its file's path."""
    file = F.concat(name, F.lit("."), ext)
    some = F.when(F.size(folders) > 0, F.transform(folders, lambda f: F.concat(f, F.lit("/"), file))).otherwise(F.array(file))
    return F.concat(some, F.array(path))


def kind_reason(kind: Column, images: bool, videos: bool) -> Column:
    """Why an item of this kind isn't taken: an unknown type, or a kind that is switched off; null if it is."""
    return F.when(kind.isNull(), "unsupported").when((kind == "image") & F.lit(not images), "images off").when((kind == "video") & F.lit(not videos), "videos off")


def has_tags(tags: Column, wanted: list[str], all_of: bool) -> Column:
    """Any or all of the wanted tags, whatever their case; all of none is false."""
    lower = F.transform(tags, F.lower)
    want = F.array(*(F.lit(w.lower()) for w in wanted)) if wanted else F.array().cast("array<string>")
    return F.lit(bool(wanted)) & (F.size(F.array_except(want, lower)) == 0) if all_of else F.arrays_overlap(lower, want)


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*(F.when(rule, F.lit(name)) for name, rule in rules))


def matches_any(paths: Column, patterns: list[str]) -> Column:
    rules = [K.wildcard_pattern(p) for p in patterns]
    return F.exists(paths, lambda p: _any([p.rlike(r) for r in rules])) if rules else F.lit(False)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def tag_counts(items: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n): tags by number of items, most frequent first, ties by name."""
    return items.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def same_file(size_a: Column, size_b: Column, inode_a: Column, inode_b: Column) -> Column:
    """Hard links by size and file number alone; ``matching.hard_link`` asks for device and duration, too."""
    return (size_a == size_b) & inode_a.eqNullSafe(inode_b)


#: What ids, names and extensions look like.
ID, EXTENSION, SUFFIX = r"^[A-Za-z0-9]{1,64}$", r"^[A-Za-z0-9]{1,16}$", r"^[A-Za-z0-9._-]{1,64}$"


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ID), F.lit(False))


def valid_name(c: Column) -> Column:
    """Not empty, no separators of paths, no control characters, no name of a folder itself."""
    return F.coalesce((F.length(c) > 0) & ~c.rlike(r"[/\\\x00-\x1f]") & ~c.isin(".", ".."), F.lit(False))


def valid_extension(c: Column) -> Column:
    return F.coalesce(c.rlike(EXTENSION), F.lit(False))


def valid_suffix(c: Column) -> Column:
    return F.coalesce(c.rlike(SUFFIX) & ~F.contains(c, F.lit("..")), F.lit(False))


def log_lines(log: DataFrame, level: str = "", part: str = "") -> DataFrame:
    """Log rows (level, message) of a level (all if it is empty) that contain a text, whatever its case."""
    kept = log.filter(F.col("level") == level) if level else log
    return kept.filter(F.contains(F.lower("message"), F.lit(part.lower()))) if part else kept
