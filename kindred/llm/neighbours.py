"""Operator 4: nearest neighbours by largest inner product, through low-dimensional stable projections in kd-trees.

Inner products become distances: rows are divided by the largest norm M and completed to length one, x' = (x / M, sqrt(1 - |x|^2 / M^2)),
queries to q' = (q / |q|, 0); then |q' - x'|^2 = 2 - 2 q x / (M |q|). Projections on Gaussian (2-stable) directions keep distances in
this sense: the squared ratio of projected to true distance follows a chi-square distribution with ``DIMENSIONS`` degrees of freedom
(SRS, Sun et al., 2014).

1. Equal vectors become one, which remembers its k + 1 smallest ids: no others can count.
2. Rows of one length are parted by norm (each part within ``RATIO``), so that M is near every norm of a part; a part whose M is too
   small for a query is never opened. One kd-tree over each whole part: its splits are medians of a bounded sample of projections (``SAMPLE`` rows), every row goes to one of
   its cells (about ``CELL`` rows each), and the cells' boxes are those of all their rows. Larger cells, full of near copies, are hashed
   into blocks.
3. Queries meet cells in the order of the boxes' projected distance, in rounds of 1, 8, 64, ... cells; between rounds the best
   of all cells so far set a query's radius. Inside a cell a kd-tree opens leaves in the same order; a leaf's rows inside
   the radius, by their own projected distance, are verified by true inner products.
4. A query stops when the chi-square test holds: with d the distance of the (k + 1)-th found anywhere, a row nearer than d
   would have been projected beyond the radius sqrt(quantile) d with a chance of 1 - ``CONFIDENCE`` only. Each true neighbour
   is found with at least about this chance, however large the table is.

A query and a cell meet in blocks of bounded size, so no task grows with a hot cell; vectors move once into their cells, and to those
rounds that open them.

Vectors that are null, zero or hold null or non-finite components take no part, neither do rows with a null id. Rows that share an
id count once (the smallest vector). Vectors meet vectors of their own length only. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import read, stage, unstage

K = 20
DIMENSIONS = 8
CONFIDENCE = 0.95
#: Rows whose projections set the splits, at most (roughly, by hash); rows of a cell, and cells at most.
SAMPLE, CELL, MOST_CELLS = 1 << 16, 4096, 4096
#: Rows, and queries, that meet in one task at most (roughly, by hash).
BLOCK = 8192
LEAF = 32
#: Norms of a part lie within this ratio; PARTS parts at most, the last takes all smaller ones.
RATIO, PARTS = 1.15, 32
#: Leaves opened first (then twice as many each time), and growth of the number of cells from round to round.
STEP, GROWTH = 4, 8


def chi_square_cdf(x: float, m: int = DIMENSIONS) -> float:
    """P(X <= x) of a chi-square variable with an even number m of degrees of freedom."""
    h = x / 2
    return 1 - math.exp(-h) * sum(h**i / math.factorial(i) for i in range(m // 2))


def chi_square_bound(p: float = CONFIDENCE, m: int = DIMENSIONS) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, m) < p else (lo, mid)
    return hi


def axes(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(4 + dim)).standard_normal((dim + 1, DIMENSIONS))


def project_rows(vectors: np.ndarray, norm: float) -> np.ndarray:
    x = vectors / norm
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))
    return np.column_stack([x, rest]) @ axes(vectors.shape[1])


def project_queries(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ axes(vectors.shape[1])[:-1]


def _gaps(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The squared distance from q to each box."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


class KdTree:
    """Points in leaves of at most ``leaf``, split at the median of the widest axis; rows of other tables find their leaf by the splits."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.axis, self.at, self.children, self.leaves = [], [], [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            axis = -1
            if len(rows) > leaf:
                own = points[rows]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                value = own[:, axis]
                split = np.median(value)
                left = value < split
                if not left.any():  # half of them are the smallest
                    split = value[value > split].min() if (value > split).any() else split
                    left = value < split
                axis = axis if left.any() else -1
            if axis < 0:
                name = ~len(self.leaves)
                self.leaves.append(rows)
            else:
                name = len(self.axis)
                self.axis.append(axis)
                self.at.append(split)
                self.children.append([0, 0])
                todo += [(rows[left], name, 0), (rows[~left], name, 1)]
            if parent >= 0:
                self.children[parent][side] = name

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        if not self.axis:
            return np.zeros(len(points), np.int64)
        axis, at, children = np.array(self.axis), np.array(self.at), np.array(self.children)
        node = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(node >= 0)
            if not len(inner):
                return ~node
            n = node[inner]
            node[inner] = children[n, (points[inner, axis[n]] >= at[n]).astype(np.int64)]


class Index:
    """A block of rows of one cell (ids, vectors, projections), under one bound of norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, norm: float):
        self.norm, leaves = norm, KdTree(points, LEAF).leaves
        order = np.concatenate(leaves)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        ends = np.cumsum([len(r) for r in leaves])
        self.rows = [np.arange(e - len(r), e) for e, r in zip(ends.tolist(), leaves, strict=True)]
        self.low = np.array([points[r].min(axis=0) for r in leaves])
        self.high = np.array([points[r].max(axis=0) for r in leaves])
        self.bound = chi_square_bound()
        self.verified = 0

    def search(self, q: np.ndarray, p: np.ndarray, k: int, least: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows found that are not worse than ``least``, best first, ties to the smaller id."""
        distance = _gaps(self.low, self.high, p)
        order = np.argsort(distance)
        scale = 2 / (self.norm * math.sqrt(float(q @ q)))
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        a, step = 0, STEP
        while a < len(order):
            radius = self.bound * max(2 - scale * least, 0) if least > -math.inf else math.inf
            opened = order[a : a + step]
            opened = opened[distance[opened] <= radius]
            if not len(opened):
                break
            near = np.concatenate([self.rows[x] for x in opened.tolist()])
            if radius < math.inf:
                gap = self.points[near] - p
                near = near[np.einsum("ij,ij->i", gap, gap) <= radius]
            s = self.vectors[near] @ q
            self.verified += len(near)
            good = np.flatnonzero(s >= least)
            if len(good):
                ids, scores = np.concatenate([ids, self.ids[near[good]]]), np.concatenate([scores, s[good]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = max(least, float(scores[-1]))
            a, step = a + step, 2 * step
        return ids, scores


def _usable(column: str = "embedding") -> F.Column:
    c = F.col(column)
    finite = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, m = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m), pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def _by_part(batch: pa.RecordBatch):
    parts = batch.column("part").to_numpy()
    for part in np.unique(parts).tolist():
        yield part, batch.filter(pa.array(parts == part))


def _project(norms: dict[int, float]):
    """Projections of rows."""

    def run(batches):
        for batch in batches:
            for part, rows in _by_part(batch):
                yield pa.RecordBatch.from_arrays([rows.column("part"), _lists(project_rows(_matrix(rows.column("embedding")), norms[part]))], names=["part", "p"])

    return run


def _place(shared, norms: dict[int, float]):
    """Rows with their projections and cells."""

    def run(batches):
        trees = shared.value
        for batch in batches:
            for part, rows in _by_part(batch):
                points = project_rows(_matrix(rows.column("embedding")), norms[part])
                cell = trees[part].leaf_of(points).astype(np.int32) if part in trees else np.zeros(len(points), np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("part"), pa.array(cell), rows.column("vec_id"), rows.column("embedding"), _lists(points)], names=["part", "cell", "vec_id", "embedding", "p"])

    return run


_VISIT = "part int, cell int, vec_id long, embedding array<double>, p array<double>, least double"


def _visits(shared, lo: int, hi: int):
    """Queries with the cells that they open from place lo to hi, in the order of the scores that the boxes promise."""

    def run(batches):
        boxes, bound = shared.value, chi_square_bound()
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                asked = batch.filter(pa.array(dims == dim))
                parts, cells, norms, low, high = boxes[dim]
                vectors = _matrix(asked.column("embedding"))
                points, length = project_queries(vectors), np.linalg.norm(vectors, axis=1)
                least = asked.column("least").to_numpy(zero_copy_only=False)
                rows, opened = [], []
                for r in range(len(points)):
                    gap = _gaps(low, high, points[r])
                    order = np.argsort(norms * (gap / (2 * DIMENSIONS) - 1), kind="stable")[lo:hi]
                    if not np.isnan(least[r]):
                        order = order[gap[order] <= bound * np.maximum(2 - 2 * least[r] / (norms[order] * length[r]), 0)]
                    rows.append(np.full(len(order), r))
                    opened.append(order)
                rows, opened = np.concatenate(rows), np.concatenate(opened)
                for a in range(0, len(rows), 1024):
                    at, o = pa.array(rows[a : a + 1024]), opened[a : a + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(parts[o].astype(np.int32)), pa.array(cells[o].astype(np.int32)), asked.column("vec_id").take(at), asked.column("embedding").take(at), _lists(points[rows[a : a + 1024]]), asked.column("least").take(at)],
                        names=["part", "cell", "vec_id", "embedding", "p", "least"],
                    )

    return run


_FOUND = "query_id long, vec_id long, score double, verified long"


def _meet(norms: dict[int, float], k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = [[], [], [], []]
        if len(rows) and len(queries):
            index = Index(rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64), np.stack(rows["p"].to_numpy()).astype(np.float64), norms[int(key[0])])
            for own, q, p, least in zip(queries["vec_id"].tolist(), queries["embedding"], queries["p"], queries["least"].tolist(), strict=True):
                before = index.verified
                ids, scores = index.search(np.asarray(q, np.float64), np.asarray(p, np.float64), k, -math.inf if math.isnan(least) else least)
                # the work of a query stands in a row of its own
                found[0] += [own] * (len(ids) + 1)
                found[1] += [*ids.tolist(), -1]
                found[2] += [*scores.tolist(), math.nan]
                found[3] += [0] * len(ids) + [index.verified - before]
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score", "verified"], found, strict=True))).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "verified": "int64"})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; a limit on each key comes before the shuffle."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def search(rows: DataFrame, queries: DataFrame, k: int, cell: int = CELL) -> tuple[DataFrame, int]:
    """((query_id, vec_id, score): the k best rows found for each query, number of verified pairs) of distinct vectors (vec_id, dim, norm, embedding)."""
    spark = rows.sparkSession
    context = spark.sparkContext
    empty = spark.createDataFrame([], "query_id long, vec_id long, score double")
    top = {r["dim"]: r["norm"] for r in rows.groupBy("dim").agg(F.max("norm").alias("norm")).collect()}
    if not top:
        return empty, 0
    largest = F.lit(0.0)
    for d, m in top.items():
        largest = F.when(F.col("dim") == d, m).otherwise(largest)
    step = F.least(F.lit(PARTS - 1), F.floor(F.log(largest / F.col("norm")) / math.log(RATIO))).cast("int")
    rows = rows.withColumn("part", (F.col("dim") * PARTS + step).cast("int"))
    sizes = {r["part"]: r for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect()}
    norms = {d: r["norm"] for d, r in sizes.items()}
    share = F.lit(0.0)
    for d, r in sizes.items():
        if r["n"] > cell:
            share = F.when(F.col("part") == d, min(1.0, SAMPLE / r["n"])).otherwise(share)
    trees: dict[int, KdTree] = {}
    if any(r["n"] > cell for r in sizes.values()):
        draw = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = rows.filter(draw < share).select("part", "embedding").mapInArrow(_project(norms), "part int, p array<double>").toPandas()
        for d, of_part in sample.groupby("part"):
            points = np.stack(of_part["p"].to_numpy())
            points = points[np.lexsort(points.T)]  # the same splits, whatever order rows come in
            trees[int(d)] = KdTree(points, max(2, math.ceil(len(points) / min(MOST_CELLS, math.ceil(sizes[d]["n"] / cell)))))
    placed = stage(rows.select("part", "vec_id", "embedding").mapInArrow(_place(context.broadcast(trees), norms), "part int, cell int, vec_id long, embedding array<double>, p array<double>"), "placed")
    ends = [f(F.col("p")[i]).alias(f"{name}{i}") for i in range(DIMENSIONS) for name, f in (("lo", F.min), ("hi", F.max))]
    cells = placed.groupBy("part", "cell").agg(F.count("*").alias("n"), *ends).toPandas().sort_values(["part", "cell"])
    boxes = {}
    for d, c in cells.groupby(cells["part"] // PARTS):
        low, high = (c[[f"{name}{i}" for i in range(DIMENSIONS)]].to_numpy() for name in ("lo", "hi"))
        boxes[int(d)] = (c["part"].to_numpy(), c["cell"].to_numpy(), np.array([norms[x] for x in c["part"].tolist()]), low, high)
    shared = context.broadcast(boxes)
    number = spark.createDataFrame([(int(r.part), int(r.cell), -(-int(r.n) // BLOCK)) for r in cells.itertuples()], "part int, cell int, blocks int")
    block_of = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    best, verified, lo, hi = stage(empty, "best"), 0, 0, 1
    most_cells = max(len(b[0]) for b in boxes.values())
    while lo < most_cells:
        # what was found anywhere sets the radius
        radius = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("query_id", "least")
        asked = queries.join(radius, queries.vec_id == radius.query_id, "left").select("dim", "vec_id", "embedding", "least")
        visits = stage(asked.mapInArrow(_visits(shared, lo, hi), _VISIT), "visits")
        per_cell = visits.groupBy("part", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asks"))
        meetings = stage(per_cell.join(F.broadcast(number), ["part", "cell"]), "meetings")  # a row for each cell at most
        if not meetings.limit(1).count():
            unstage(visits, meetings)
            break
        small = F.broadcast(meetings)
        each = placed.join(small, ["part", "cell"]).select("part", "cell", block_of(1, "blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("j"), "vec_id", "embedding", "p")
        asks = visits.join(small, ["part", "cell"]).select("part", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), block_of(2, "asks").alias("j"), "vec_id", "embedding", "p", "least")
        key = ["part", "cell", "i", "j"]
        found = stage(each.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(_meet(norms, k), _FOUND), "found")
        verified += found.agg(F.sum("verified")).first()[0] or 0
        better = stage(_best(best.union(found.filter("NOT isnan(score)").select("query_id", "vec_id", "score")), k), "best")
        unstage(best, visits, meetings, found)
        best, lo, hi = better, hi, hi + GROWTH * (hi - lo)
    unstage(placed)
    return best, verified


def nearest(vectors: DataFrame, asked: F.Column, k: int = K, cell: int = CELL, work: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) that is asked, the k nearest others found.

    ``work`` is told the number of verified pairs, and of all pairs of distinct vectors that could have been.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & _usable()).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    rows = stage(rows.withColumn("asked", F.coalesce(asked, F.lit(False))), "vectors")
    # equal vectors: the smallest id stands for all; of each class the k + 1 smallest ids go on, and all that are asked
    alike = W.partitionBy("embedding").orderBy("vec_id")
    few = rows.select("vec_id", "embedding").withColumn("r", F.row_number().over(alike)).filter(F.col("r") <= k + 1)
    classes = few.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.collect_list("vec_id").alias("ids"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    classes = stage(classes.select(F.col("rep").alias("vec_id"), F.size("embedding").alias("dim"), norm.alias("norm"), "embedding", "ids"), "classes")
    askers = rows.filter("asked").select(F.col("vec_id").alias("asker"), F.col("embedding").alias("e"))
    askers = stage(askers.join(classes.select(F.col("vec_id").alias("rep"), "embedding"), F.col("e") == F.col("embedding")).select("asker", "rep"), "askers")
    queries = stage(classes.join(askers.select("rep").distinct(), classes.vec_id == F.col("rep"), "left_semi").select("vec_id", "dim", "embedding"), "queries")
    best, verified = search(classes.select("vec_id", "dim", "norm", "embedding"), queries, k + 1, cell)
    if work is not None:
        counts = classes.groupBy("dim").agg(F.count("*").alias("n")).join(queries.groupBy("dim").agg(F.count("*").alias("q")), "dim")
        work["verified"], work["pairs"] = verified, counts.agg(F.sum(F.col("n") * F.col("q"))).first()[0] or 0
    members = best.join(classes.select(F.col("vec_id").alias("c"), "ids"), F.col("vec_id") == F.col("c")).select("query_id", "score", F.explode("ids").alias("vec_id"))
    members = stage(_best(members, k + 1), "members")
    pairs = askers.join(members, F.col("rep") == F.col("query_id")).filter("asker <> vec_id")
    rank = F.row_number().over(W.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    out = pairs.select(F.col("asker").alias("query_id"), rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
    out = stage(out, "neighbours")
    unstage(rows, classes, askers, queries, best, members)
    return out


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
