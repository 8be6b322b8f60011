"""Survivorship: keepers by criteria with tolerances, checks of identical, oldest, newest and custom selections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions.kernels import wildcard_pattern


@dataclass(frozen=True)
class Criterion:
    """A column, which end is better, and how near a value ties with the best: by a difference or a share of the best."""

    column: str
    descending: bool = True
    within: float = 0.0
    share: float = 0.0

    def ties(self, value: Column, best: Column) -> Column:
        ok = F.abs(value - best) <= self.within
        return ok | (F.abs(value - best) <= F.abs(best) * self.share) if self.share else ok


#: Fixed values of the domain: the criteria in their default order.
CRITERIA = (
    Criterion("duration", within=1.0, share=0.01),
    Criterion("frame_size"),
    Criterion("bit_rate", share=0.05),
    Criterion("fps", within=0.5),
    Criterion("bits_per_pixel", share=0.05),
    Criterion("audio_bit_rate", share=0.05),
    Criterion("size", descending=False),
)
#: The other end of size, for those who keep the larger file; it is asked for by name.
LARGER = Criterion("size", descending=True)
#: What makes two rows alike, with and without size.
SAME = ("size", "duration", "frame_size", "format", "audio_format", "audio_channels", "audio_sample_rate", "bit_rate", "fps")
SAME_BUT_SIZE = SAME[1:]


def bits_per_pixel(kilobits: Column, frame_size: Column, fps: Column) -> Column:
    """Bits for each pixel of each frame, from "WxH"; 0 where something is unknown."""
    w, h = (F.regexp_extract(frame_size, r"^(\d+)x(\d+)$", i).try_cast("double") for i in (1, 2))
    pixels = w * h * fps
    return F.when((kilobits > 0) & (pixels > 0), kilobits * 1000.0 / pixels).otherwise(0.0)


def resolve_criteria(order: list[str], disabled: tuple[str, ...] = (), known: tuple[Criterion, ...] = CRITERIA) -> list[Criterion]:
    """The criteria in the given order, without unknown, repeated and disabled names, then those that weren't named."""
    by_name = {c.column: c for c in known}
    named = [n for n in dict.fromkeys(order) if n in by_name]
    return [by_name[n] for n in [*named, *(n for n in by_name if n not in named)] if n not in disabled]


def keepers(items: DataFrame, criteria: list[Criterion], group: str = "group_id", idx: str = "idx") -> DataFrame:
    """items with ``keeper``: in each group the candidates tied with the best go on from criterion to criterion.

    The keeper is the best by the last criterion that was applied; ties go to the smaller idx. Only window aggregates over the group.
    """
    g = W.partitionBy(group)
    out = items.withColumn("_in", F.lit(True)).withColumn("_done", F.lit(False)).withColumn("_keep", F.lit(None).cast("long"))
    for c in criteria:
        value = F.col(c.column).cast("double")
        rank = value if c.descending else -value
        best = F.max(F.when(F.col("_in"), rank)).over(g)
        top = F.min(F.when(F.col("_in") & (rank == best), F.col(idx))).over(g)
        out = out.withColumn("_best", F.when(~F.col("_done"), best)).withColumn("_keep", F.when(F.col("_done"), F.col("_keep")).otherwise(top))
        tied = c.ties(value, F.col("_best") if c.descending else -F.col("_best"))
        out = out.withColumn("_in", F.when(F.col("_done"), F.col("_in")).otherwise(F.col("_in") & tied))
        out = out.withColumn("_done", F.col("_done") | (F.sum(F.col("_in").cast("int")).over(g) <= 1))
    return out.withColumn("keeper", F.col(idx) == F.coalesce("_keep", F.min(idx).over(g))).drop("_in", "_done", "_keep", "_best")


def check_identical(items: DataFrame, fields: list[str], keep: Column | None = None, group: str = "group_id", idx: str = "idx") -> DataFrame:
    """items with ``checked``: in each group the first cluster of several rows alike in all fields is checked, but one.

    The first cluster is the one whose smallest row has another, visible one beside it; only visible rows are checked, the first
    row itself stays in its cluster even if it isn't visible. ``keep`` orders a cluster's rows (the smallest idx by default stays).
    """
    shown = F.coalesce(F.col("visible"), F.lit(True)) if "visible" in items.columns else F.lit(True)
    cluster = W.partitionBy(group, *fields)
    sized = items.withColumn("_v", shown).withColumn("_first", F.min(idx).over(cluster))
    sized = sized.withColumn("_n", F.sum((F.col("_v") & (F.col(idx) != F.col("_first"))).cast("int")).over(cluster))
    sized = sized.withColumn("_chosen", F.min(F.when(F.col("_n") > 0, F.col("_first"))).over(W.partitionBy(group)))
    inside = (F.col("_first") == F.col("_chosen")) & (F.col("_v") | (F.col(idx) == F.col("_first")))
    order = [keep] if keep is not None else []
    rank = F.row_number().over(W.partitionBy(group, *fields, "_in").orderBy(*order, F.col(idx)))
    out = sized.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_r", rank)
    return out.withColumn("checked", F.col("_in") & (F.col("_r") > 1)).drop("_n", "_v", "_first", "_chosen", "_in", "_r")


def check_by_date(items: DataFrame, date: str, keep_newest: bool, group: str = "group_id", idx: str = "idx") -> DataFrame:
    """items with ``checked``: all but the newest (or oldest) of each group of several."""
    order = F.col(date).desc() if keep_newest else F.col(date).asc()
    w = W.partitionBy(group)
    return items.withColumn("checked", (F.count("*").over(w) > 1) & (F.row_number().over(w.orderBy(order, F.col(idx))) > 1))


def check_lowest_quality(items: DataFrame, criteria: list[Criterion], group: str = "group_id", idx: str = "idx") -> DataFrame:
    """items with ``checked``: everything but the keeper of each group of several."""
    return keepers(items, criteria, group, idx).withColumn("checked", (F.count("*").over(W.partitionBy(group)) > 1) & ~F.col("keeper"))


@dataclass(frozen=True)
class CustomSelection:
    """A custom selection. The defaults of the domain.

    kind: "", videos or images; identical: "" any, same, same_but_size, different (each against the first match of its group);
    keep_date: "" none, oldest or newest; paths are wildcards, of which all (contains) or none (lacks) must match.
    """

    skip_checked: bool = True
    kind: str = ""
    identical: str = ""
    keep_date: str = ""
    least_mb: int = 0
    most_mb: int = 999_999_999
    contains: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    least_similarity: float = 0.0
    most_similarity: float = 100.0


def _some_path(pattern: str) -> Column:
    rule = wildcard_pattern(pattern)
    return F.exists("paths", lambda x: x.rlike(rule))


def check_custom(items: DataFrame, s: CustomSelection, group: str = "group_id", idx: str = "idx") -> DataFrame:
    """items (idx, group, size_mb, similarity, checked, and what the selection asks for: paths, is_image, created, the fields of SAME) with
    ``checked`` and ``keeper`` as the selection sets them; other rows keep their check mark.

    Of each group's matching rows, those alike to the first (as asked) are a cluster; its first by date, or by idx, is its keeper, the
    others are checked. Where neither identity nor date is asked for and only a part of the visible rows matches, all that match are checked.
    """
    shown = F.coalesce(F.col("visible"), F.lit(True)) if "visible" in items.columns else F.lit(True)
    match = shown & F.col("size_mb").between(s.least_mb, s.most_mb) & F.col("similarity").between(s.least_similarity, s.most_similarity)
    if s.kind:
        match = match & (F.col("is_image") if s.kind == "images" else ~F.col("is_image"))
    for p in s.contains:
        match = match & _some_path(p)
    for p in s.lacks:
        match = match & ~_some_path(p)
    g = W.partitionBy(group)
    if s.skip_checked:
        match = match & ~F.max(F.col("checked") & shown).over(g)
    out = items.withColumn("_m", F.coalesce(match, F.lit(False))).withColumn("_shown", F.sum(shown.cast("int")).over(g)).withColumn("_first", F.min(F.when(F.col("_m"), F.col(idx))).over(g))
    inside = F.col("_m")
    if s.identical:
        fields = SAME_BUT_SIZE if s.identical == "same_but_size" else SAME
        alike = F.lit(True)
        for f in fields:
            alike = alike & F.col(f).eqNullSafe(F.max(F.when(F.col(idx) == F.col("_first"), F.struct(F.col(f).alias("v")))).over(g)["v"])
        inside = inside & ((F.col(idx) == F.col("_first")) | (~alike if s.identical == "different" else alike))
    out = out.withColumn("_in", inside)
    order = {"oldest": [F.col("created").asc()], "newest": [F.col("created").desc()]}.get(s.keep_date, [])
    rank = F.row_number().over(W.partitionBy(group, "_in").orderBy(*order, F.col(idx)))
    no_keeper = F.lit(not s.identical and not s.keep_date) & (F.sum(F.col("_in").cast("int")).over(g) < F.col("_shown"))
    out = out.withColumn("keeper", F.col("_in") & ~no_keeper & (rank == 1))
    return out.withColumn("checked", F.when(F.col("_in"), ~F.col("keeper")).otherwise(F.col("checked"))).drop("_m", "_shown", "_first", "_in")


def keep_best(items: DataFrame, criteria: list[Criterion], group: str = "group_id", idx: str = "idx") -> DataFrame:
    """items with ``checked``: of each group's visible rows, two at least, all but the keeper; other rows keep their check mark."""
    shown = items.filter("visible")
    kept = keepers(shown, criteria, group, idx).withColumn("_n", F.count("*").over(W.partitionBy(group)))
    marks = kept.filter("_n >= 2").select(F.col(group).alias("_g"), F.col(idx).alias("_i"), (~F.col("keeper")).alias("_mark"))
    return items.join(marks, (F.col(group) == F.col("_g")) & (F.col(idx) == F.col("_i")), "left").withColumn("checked", F.coalesce("_mark", "checked")).drop("_g", "_i", "_mark")


def invert(items: DataFrame) -> DataFrame:
    """Visible rows' check marks turned."""
    return items.withColumn("checked", F.when(F.col("visible"), ~F.col("checked")).otherwise(F.col("checked")))


def clear(items: DataFrame) -> DataFrame:
    return items.withColumn("checked", F.lit(False))


def keep_only(items: DataFrame, chosen: DataFrame, group: str = "group_id", idx: str = "idx") -> DataFrame:
    """The chosen rows (group, idx) stay; the others of their groups are checked."""
    one = chosen.select(F.col(group).alias("_g"), F.col(idx).alias("_i"))
    return items.join(one, F.col(group) == F.col("_g"), "left").withColumn("checked", F.when(F.col("_g").isNull(), F.col("checked")).otherwise(F.col(idx) != F.col("_i"))).drop("_g", "_i")


def check_deleted_matches(items: DataFrame, visible_only: bool = False, group: str = "group_id") -> DataFrame:
    """Live rows of groups that hold deleted content are checked: what was deleted once came back."""
    gone = F.coalesce(F.col("tombstone") | F.col("gone"), F.lit(False))
    some = F.max(gone).over(W.partitionBy(group))
    mine = some & ~gone & ~F.coalesce(F.col("missing"), F.lit(False))
    return items.withColumn("checked", F.col("checked") | (mine & F.col("visible") if visible_only else mine))


def after_scan(items: DataFrame, preset: CustomSelection | None = None, check_deleted: bool = False) -> DataFrame:
    """What happens after a scan: a preset of the user, then the check of returned deleted content."""
    out = check_custom(items, preset).drop("keeper") if preset is not None else items
    return check_deleted_matches(out) if check_deleted else out


def expression_partition(items: DataFrame, condition: Column, group: str = "group_id") -> DataFrame:
    """(group, whole, n) of visible rows: groups with a row that meets the condition, whether all do, and how many."""
    shown = items.filter("visible") if "visible" in items.columns else items
    ok = shown.select(group, F.coalesce(condition, F.lit(False)).alias("ok"))
    return ok.groupBy(group).agg(F.bool_and("ok").alias("whole"), F.count_if("ok").alias("n")).filter("n > 0")


class Undo:
    """Earlier states of the check marks, the last ones first; DataFrames are immutable, so a state is just kept."""

    def __init__(self, most: int = 100):
        self._most, self._states = most, []

    def apply(self, before: DataFrame, after: DataFrame) -> DataFrame:
        self._states = [*self._states, before][-self._most :]
        return after

    def undo(self, now: DataFrame) -> DataFrame:
        return self._states.pop() if self._states else now


def pairwise_walk(items: DataFrame, group: str = "group_id", idx: str = "idx") -> DataFrame:
    """(group, left, right): the pairs a walk shows in which the left always wins."""
    w = W.partitionBy(group).orderBy(idx)
    return items.select(F.col(group), F.first(idx).over(w).alias("left"), F.col(idx).alias("right")).filter("left <> right")


def walk_steps(decisions: list[str], n: int) -> tuple[list[int], tuple[int, int]]:
    """(checked places in order, the pair shown now) of a winner-stays walk over n rows.

    Each decision is keepLeft (the right one is checked), keepRight (the left one is checked, the right one goes on) or skip (a pair of new rows
    follows). (-1, -1) when no pair is left.
    """
    checked, left, right = [], 0, 1
    for d in decisions:
        if right >= n or left < 0:
            break
        if d == "keepLeft":
            checked.append(right)
            right += 1
        elif d == "keepRight":
            checked.append(left)
            left, right = right, right + 1
        else:
            left, right = right + 1, right + 2
    return checked, ((left, right) if right < n else (-1, -1))


def walk(items: DataFrame, decisions: DataFrame, group: str = "group_id", idx: str = "idx") -> DataFrame:
    """(group, checked, left, right) of groups with decisions (group, step, decision): the idx that a walk checked, and the pair it shows now (null at the end)."""
    told = decisions.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("step", "decision"))).alias("_d"))
    rows = items.groupBy(group).agg(F.sort_array(F.collect_list(idx)).alias("_i")).join(told, group)
    # places, folded over the decisions: (checked, left, right)
    start = F.struct(F.array().cast("array<int>").alias("c"), F.lit(0).alias("l"), F.lit(1).alias("r"))

    def step(s: Column, d: Column) -> Column:
        over = s["r"] >= F.size("_i")
        keep_left, keep_right = d["decision"] == "keepLeft", d["decision"] == "keepRight"
        c = F.when(over, s["c"]).when(keep_left, F.concat(s["c"], F.array(s["r"]))).when(keep_right, F.concat(s["c"], F.array(s["l"]))).otherwise(s["c"])
        left = F.when(over | keep_left, s["l"]).when(keep_right, s["r"]).otherwise(s["r"] + 1)
        right = F.when(over, s["r"]).when(keep_left | keep_right, s["r"] + 1).otherwise(s["r"] + 2)
        return F.struct(c.alias("c"), left.cast("int").alias("l"), right.cast("int").alias("r"))

    state = F.aggregate("_d", start, step)
    out = rows.withColumn("_s", state)
    shown = lambda p: F.when(F.col("_s.r") < F.size("_i"), F.get(F.col("_i"), F.col(f"_s.{p}")))
    return out.select(group, F.transform("_s.c", lambda p: F.get(F.col("_i"), p)).alias("checked"), shown("l").alias("left"), shown("r").alias("right"))
