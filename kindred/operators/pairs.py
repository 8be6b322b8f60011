"""Similarity joins: duration bands, frame differences block by block, hashes, embeddings, containment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import kernels as K

#: Rows of a band that one task compares with as many others.
BLOCK = 512
#: The part of a clip, in percent, that is compared at every offset first; values that are compared at once.
HEAD, AT_ONCE = 45, 1 << 22


def band(duration: F.Column, percent: float) -> F.Column:
    """Durations within percent of each other lie in the same or neighbouring bands; 0 is a band of its own."""
    base = math.log(1 + percent / 100.0)
    return F.when(duration > 0, F.floor(F.log(duration.cast("double")) / base)).otherwise(F.lit(-(1 << 40))).cast("long")


def band_join(items: DataFrame, percent: float, carry: list[str] | None = None) -> DataFrame:
    """Pairs a < b of items (id, duration, ...) whose durations differ by at most percent of the shorter.

    An equi-join on logarithmic bands replaces the range join, with an exact condition left.
    """
    carry = carry or []
    left = items.select(F.col("id").alias("a"), F.col("duration").alias("da"), *(F.col(c).alias(f"{c}_a") for c in carry), band(F.col("duration"), percent).alias("k"))
    right = items.select(F.col("id").alias("b"), F.col("duration").alias("db"), *(F.col(c).alias(f"{c}_b") for c in carry), band(F.col("duration"), percent).alias("kb"))
    right = right.withColumn("k", F.explode(F.array(F.col("kb") - 1, F.col("kb"), F.col("kb") + 1)))
    near = F.abs(F.col("da") - F.col("db")) <= F.least("da", "db") * (percent / 100.0)
    return left.join(right, "k").filter((F.col("a") < F.col("b")) & near).drop("k", "kb")


def frame_pairs(items: DataFrame, percent: float, most: float, mirrored: bool = False, masked: bool = False) -> DataFrame:
    """(a, b, diff): pairs a < b of items (id, duration, px) whose durations lie within percent and whose frames differ by at most ``most``.

    Pixels are bytes. Items are dealt, in the order of their durations, into blocks of bounded size; a hot duration is cut by a hash. A cell is a
    block and some of those that it can meet, so each frame, a byte for a pixel, is shuffled once for a cell and never joined. Inside a cell pairs
    pass a bound that a matrix product gives (``_Bound``), which loses none, before their pixels are compared; only matches leave the task.
    ``mirrored`` compares with the mirror image of the first; ``masked`` leaves out black and white pixels. With in_scope among the columns,
    pairs of two items out of scope are left out.
    """
    share = percent / 100.0
    scope = F.col("in_scope") if "in_scope" in items.columns else F.lit(True)
    step = math.log1p(share / FINE)
    duration = F.col("duration").cast("double")
    fine = F.when(duration > 0, F.floor(F.log(duration) / step)).otherwise(F.lit(-(1 << 40))).cast("long")
    # as many rows as the logarithm of the longest duration by the step: few enough for the driver
    sizes = sorted(tuple(r) for r in items.groupBy(fine.alias("k")).agg(F.count("*").alias("n")).collect())
    bands, cells = _cells(sizes, math.ceil(math.log1p(share) / step) + 1, *FRAMES)
    spark = items.sparkSession
    number = max((c for _, c, _ in cells), default=0) + 1
    bands = F.broadcast(spark.createDataFrame(bands, "k long, first int, parts int"))
    cells = F.broadcast(spark.createDataFrame(cells, "block int, cell int, role int"))
    rows = items.select("id", duration.alias("duration"), K.packed("px").alias("px"), scope.alias("scoped"), fine.alias("k")).join(bands, "k")
    rows = rows.withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(cells, "block").select("cell", "role", "block", "id", "duration", "px", "scoped")
    # a cell costs by its pairs: adaptive execution, which goes by bytes, must not merge them
    parts = min(2048, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * number))  # enough that few of them get two

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches))
        order = np.argsort(cell["duration"].to_numpy(), kind="stable")
        ids, durations, scoped, role = (cell[c].to_numpy()[order] for c in ("id", "duration", "scoped", "role"))
        px = _stacked(cell["px"])[order]
        del cell
        left, right = np.flatnonzero(role != RIGHT), np.flatnonzero(role != LEFT)
        for lo in range(0, len(left), TILE):
            rows = left[lo : lo + TILE]
            # a little more than the gate lets through, which is applied to the pairs that are left
            low = np.searchsorted(durations[right], durations[rows[0]] / (1 + share) * (1 - 1e-9))
            others = right[low : np.searchsorted(durations[right], durations[rows[-1]] * (1 + share) * (1 + 1e-9), "right")]
            if not len(others):
                continue
            one = px[rows].reshape(-1, K.SIDE, K.SIDE)[:, :, ::-1].reshape(len(rows), -1) if mirrored else px[rows]
            bound = _Bound(one, px, others, most, masked)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for at in range(0, len(others), 2 * TILE):
                some = others[at : at + 2 * TILE]
                x, y = bound.left(px[some])
                p, q = rows[x], some[y]
                # inside a block each pair meets twice: once is enough
                near = ((role[q] != BOTH) | (p < q)) & (ids[p] != ids[q]) & (scoped[p] | scoped[q]) & (np.abs(durations[p] - durations[q]) <= np.minimum(durations[p], durations[q]) * share)
                x, p, q = x[near], p[near], q[near]
                for k in range(0, len(p), AT_ONCE // px.shape[1]):
                    u, v, w = (z[k : k + AT_ONCE // px.shape[1]] for z in (x, p, q))
                    diff = _difference(one[u], px[w], masked)
                    good = np.flatnonzero(diff <= most)
                    out.append((np.minimum(ids[v[good]], ids[w[good]]), np.maximum(ids[v[good]], ids[w[good]]), diff[good]))
            if out:
                a, b, d = (np.concatenate([o[c] for o in out]) for c in range(3))
                yield pa.RecordBatch.from_pydict({"a": a.astype(np.int64), "b": b.astype(np.int64), "diff": d.astype(np.float64)})

    return rows.repartition(parts, "cell").groupBy("cell").applyInArrow(compare, "a long, b long, diff double")


def _stacked(frames: pa.ChunkedArray) -> np.ndarray:
    """Frames of equal size, as bytes, as the rows of a matrix."""
    parts = []
    for c in frames.chunks:
        if c.null_count:
            raise ValueError("every item has a frame")
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        if len(set(np.diff(ends).tolist())) > 1:
            raise ValueError("frames have equal sizes")
        parts.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(c), -1))
    return np.concatenate(parts)


#: Steps of a scale of durations into which a tolerance is cut; blocks that a table makes, rows of a block and of a cell's other side at most; rows of a tile.
FINE, BLOCKS, MOST_ROWS, OTHER_ROWS, TILE = 16, 48, 12288, 32768, 2048
#: The same three for frames, which weigh more than their pairs cost: larger blocks meet fewer others, so a frame is copied less often.
FRAMES = 32, 24576, 65536
LEFT, RIGHT, BOTH = 0, 1, 2


def _cells(sizes: list[tuple[int, int]], reach: int, number: int = BLOCKS, most: int = MOST_ROWS, other: int = OTHER_ROWS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """((band, its first block, number of its blocks) ..., (block, cell, role) ...) of bands' sizes in order; bands at most ``reach`` apart meet.

    A cell has one block at its left and some that aren't before it at its right, itself among them in the first one (role BOTH).
    """
    rows = min(most, max(BLOCK, -(-sum(n for _, n in sizes) // number)))
    bands: list[tuple[int, int, int]] = []
    blocks: list[list[int]] = []  # lowest and highest band, rows
    for k, n in sizes:
        if n <= rows and blocks and blocks[-1][2] + n <= rows:
            blocks[-1][1:] = [k, blocks[-1][2] + n]
            bands.append((k, len(blocks) - 1, 1))
        else:
            parts = -(-n // rows)
            bands.append((k, len(blocks), parts))
            blocks += [[k, k, -(-n // parts)] for _ in range(parts)]
    cells: list[tuple[int, int, int]] = []
    cell = 0
    for i, (_, high, _) in enumerate(blocks):
        cells.append((i, cell, BOTH))
        held = blocks[i][2]
        for j in range(i + 1, len(blocks)):
            if blocks[j][0] > high + reach:
                break
            if held + blocks[j][2] > other:
                cell, held = cell + 1, 0
                cells.append((i, cell, LEFT))
            cells.append((j, cell, RIGHT))
            held += blocks[j][2]
        cell += 1
    return bands, cells


def _difference(a: np.ndarray, b: np.ndarray, masked: bool) -> np.ndarray:
    """Mean differences of frames, row by row, as a share of 256; infinite where a mask leaves no pixel."""
    gap = np.abs(a.astype(np.int16) - b)
    if not masked:
        return gap.sum(axis=1, dtype=np.int64) / gap.shape[1] / 256.0
    use = (a > K.BLACK) & (a < K.WHITE) & (b > K.BLACK) & (b < K.WHITE)
    n = use.sum(axis=1)
    return np.where(n > 0, (gap * use).sum(axis=1, dtype=np.int64) / np.maximum(n, 1) / 256.0, np.inf)


class _Bound:
    """Which pairs of frames can differ by at most ``most``, by a matrix product.

    With pixels as steps (v ones, then zeros), an absolute difference is a squared distance. A projection of the steps onto r directions gives no
    more than that, and so does a part of the pixels; both are chosen by a sample of the pairs, the directions as those along which they differ most.
    Under a mask, the pixels that both frames use must sum to at most ``most`` each; pixels that are left out count as if they were equal.
    """

    #: Pairs below which all are compared; rows of a sample; nanoseconds of a factor in the product, of a comparison, and of a masked one.
    FEW, SAMPLE, COST, EXACT, EXACT_MASKED = 1 << 15, 128, 0.022, 700.0, 2500.0
    #: Directions at most.
    MOST = 4

    def __init__(self, one: np.ndarray, px: np.ndarray, others: np.ndarray, most: float, masked: bool):
        self.all = len(one) * len(others) < self.FEW
        self.number = len(one)
        if self.all:
            return
        pixels = one.shape[1]
        self.masked, self.each, self.limit = masked, most * 256.0, most * 256.0 * pixels
        pick = np.random.default_rng(len(others))
        x = one[pick.integers(0, len(one), self.SAMPLE)]
        y = px[others[pick.integers(0, len(others), self.SAMPLE)]]
        value = np.arange(256)
        self.use = ((value > K.BLACK) & (value < K.WHITE)).astype(np.float32) if masked else np.ones(256, np.float32)
        self.tables = self._directions(x, y)
        best = (1.0 * (self.EXACT_MASKED if masked else self.EXACT), 0, 0)
        for r in range(1, len(self.tables) + 1):
            for stride in (8, 4, 2, 1):
                if pixels % stride or (masked and stride > 2 and r > 2):
                    continue
                width = pixels // stride * (r + 2 if masked else r)
                passing = float((self._product(x, y, r, stride) >= 0).mean())
                cost = self.COST * width + passing * (self.EXACT_MASKED if masked else self.EXACT)
                best = min(best, (cost, r, stride))
        _, self.r, self.stride = best
        self.all = not self.r
        self.one = None if self.all else self._factors(one, self.r, self.stride)[0]

    def _directions(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """MOST rows: what each pixel value is along the directions in which pairs differ most."""
        ok = (self.use[x] * self.use[y]).ravel() > 0
        lo, hi = np.minimum(x, y).ravel()[ok].astype(np.int64), np.maximum(x, y).ravel()[ok]
        count = np.bincount(lo * 256 + hi, minlength=65536).reshape(256, 256).astype(np.float64)
        # of how many pairs the step t lies between the values: lo < t <= hi; of how many two steps do
        within = np.cumsum(count, axis=0)[:-1][:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        t = np.arange(255)
        both = within[np.minimum(t[:, None], t), np.maximum(t[:, None], t)]
        vectors = np.linalg.eigh(both)[1][:, ::-1][:, : self.MOST]
        along = np.vstack([np.zeros(self.MOST), np.cumsum(vectors, axis=0)]).T
        seen = np.bincount(np.concatenate([x.ravel(), y.ravel()]), minlength=256) * self.use
        return (along - (along * seen).sum(axis=1, keepdims=True) / max(seen.sum(), 1)).astype(np.float32)

    def _factors(self, px: np.ndarray, r: int, stride: int, other: bool = False) -> tuple[np.ndarray, int]:
        """Factors whose product is at least 0 where a pair's bound is within the limit; of a pair's first, or other, frame."""
        part = px[:, ::stride]
        n, m = part.shape
        norm = (self.tables[:r] ** 2).sum(axis=0)
        if not self.masked:
            out = np.empty((n, r * m + 2), np.float32)
            for k in range(r):
                np.take(self.tables[k], part, out=out[:, k * m : (k + 1) * m], mode="clip")
            half = norm[part].sum(axis=1, dtype=np.float64) / 2
            # a little is added for rounding
            out[:, -2:] = np.column_stack([np.ones(n), self.limit * 1.002 / 2 - half] if other else [-half, np.ones(n)])
            return out, m
        tables = [self.use, self.use * norm] if other else [-self.use * (norm - self.each), -self.use]
        tables += [self.use * v * (1 if other else 2) for v in self.tables[:r]]
        out = np.empty((n, len(tables) * m + 2), np.float32)
        for k, v in enumerate(tables):
            np.take(v.astype(np.float32), part, out=out[:, k * m : (k + 1) * m], mode="clip")
        rest = (self.use[px].sum(axis=1) - self.use[part].sum(axis=1)) * self.each / 2
        out[:, -2:] = np.column_stack([np.ones(n), rest] if other else [rest + 8, np.ones(n)])
        return out, m

    def _product(self, x: np.ndarray, y: np.ndarray, r: int, stride: int) -> np.ndarray:
        return self._factors(x, r, stride)[0] @ self._factors(y, r, stride, other=True)[0].T

    def left(self, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of the first frames and the others that may match."""
        if self.all:
            return np.repeat(np.arange(self.number), len(other)), np.tile(np.arange(len(other)), self.number)
        y = self._factors(other, self.r, self.stride, other=True)[0]
        found = [np.zeros((2, 0), np.int64)]
        for lo in range(0, self.number, 512):
            x, z = np.nonzero(self.one[lo : lo + 512] @ y.T >= 0)
            found.append(np.stack([x + lo, z]))
        return tuple(np.concatenate(found, axis=1))


#: Rows that share a slice's value before they are dealt by two slices at once.
HOT_SLICE = 1000


def hash_classes(items: DataFrame) -> DataFrame:
    """(h, rep, size): items (id, h) with equal hashes as one, named by the smallest id."""
    return items.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("size"))


def hamming_pairs(items: DataFrame, bits: int) -> DataFrame:
    """(a, b, distance): pairs a < b of items (id, h), with distinct hashes, that differ in 1 to ``bits`` of 64 bits.

    By the pigeonhole principle such hashes agree in one of bits + 1 slices, so an equi-join on slices loses none. Values of a
    slice that more than HOT_SLICE hashes share are dealt further, by each half slice outside of it: of these 2 * bits, at most ``bits``
    can differ, so the pair still meets.
    """
    one = hash_classes(items).select(F.col("rep").alias("id"), "h")
    each = one.select("id", "h", F.explode(_slices(bits + 1)).alias("p")).select("id", "h", "p.s", "p.v")
    sizes = each.groupBy("s", "v").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_SLICE).select(F.col("s").alias("hs"), F.col("v").alias("hv"))
    marked = each.join(sizes, (F.col("s") == F.col("hs")) & (F.col("v") == F.col("hv")), "left")
    finer = F.filter(_slices(2 * bits + 2), lambda x: F.floor(x["s"] / 2) != F.col("s"))
    nothing = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("v")))
    keyed = marked.withColumn("f", F.explode(F.when(F.col("hs").isNotNull(), finer).otherwise(nothing))).select("id", "h", "s", "v", F.col("f.s").alias("fs"), F.col("f.v").alias("fv"))
    a = keyed.select(F.col("id").alias("a"), F.col("h").alias("ha"), "s", "v", "fs", "fv")
    b = keyed.select(F.col("id").alias("b"), F.col("h").alias("hb"), "s", "v", "fs", "fv")
    found = a.hint("merge").join(b.hint("merge"), ["s", "v", "fs", "fv"]).filter((F.col("a") < F.col("b")) & (K.hamming(F.col("ha"), F.col("hb")) <= bits))
    return found.select("a", "b", K.hamming(F.col("ha"), F.col("hb")).alias("distance")).distinct()


def _slices(n: int) -> F.Column:
    """The hash h in n slices: array of struct(s: which, v: value)."""
    cuts = [64 * i // n for i in range(n + 1)]
    part = lambda lo, hi: F.shiftrightunsigned("h", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))
    return F.array(*(F.struct(F.lit(i).alias("s"), part(lo, hi).alias("v")) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))))


def hamming_links(items: DataFrame, bits: int) -> DataFrame:
    """(id, class_id, links) of items (id, h): the smallest id with an equal hash, and how many other items lie within ``bits`` bits. No pair of copies is written out."""
    classes = hash_classes(items)
    near = hamming_pairs(items, bits)
    both = near.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(near.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    further = both.join(classes.select(F.col("rep").alias("other"), "size"), "other").groupBy("rep").agg(F.sum("size").alias("more"))
    counted = classes.join(further, "rep", "left").select("h", "rep", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return items.hint("merge").join(counted.hint("merge"), "h").select("id", F.col("rep").alias("class_id"), "links")


def quorum_candidates(items: DataFrame, bits: int) -> DataFrame:
    """(a, b): pairs a < b of items (id, ph: a hash for each position), with distinct hashes, of which some position lies within ``bits`` bits.

    A quorum needs one such position at least. Distinct hashes of a position meet by slices, then the items that have them.
    """
    one = items.groupBy("ph").agg(F.min("id").alias("id"))
    each = one.select("id", F.posexplode("ph").alias("pos", "h"))
    cuts = each.select("pos", "h").distinct().select("pos", "h", F.explode(_slices(bits + 1)).alias("p")).select("pos", "h", "p.s", "p.v")
    x, y = (cuts.select("pos", "s", "v", F.col("h").alias("h" + c)) for c in "xy")
    met = x.join(y, ["pos", "s", "v"]).filter(K.hamming(F.col("hx"), F.col("hy")) <= bits).select("pos", "hx", "hy").distinct()
    a, b = (each.select("pos", F.col("id").alias(n), F.col("h").alias("h" + c)) for n, c in (("a", "x"), ("b", "y")))
    return met.join(a, ["pos", "hx"]).join(b, ["pos", "hy"]).filter("a < b").select("a", "b").distinct()


def cosine_pairs(vectors: DataFrame, threshold: float, bound: int | None = None) -> DataFrame:
    """(a, b, cosine): pairs a < b of vectors (id, q int8 array) of at least this cosine, block against block.

    ``bound`` drops pairs whose sign signatures differ in more bits, before their cosine is computed.
    """
    blocks = max(1, -(-vectors.count() // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("x")
    cells = vectors.select("id", "q", block.alias("own"), others).select("id", "q", "own", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(cell["q"].to_numpy()).astype(np.float32)
        ids, own = cell["id"].to_numpy(), cell["own"].to_numpy()
        ok = ids[:, None] < ids[None, :]
        if cell["i"].iloc[0] != cell["j"].iloc[0]:
            ok &= own[:, None] != own[None, :]
        if bound is not None:
            signs = (q < 0).astype(np.float32)
            ok &= signs @ (1 - signs).T + (1 - signs) @ signs.T <= bound
        a, b = np.nonzero(ok)
        found = [np.zeros(0)]
        if len(a) * 4 < len(q) ** 2:  # few enough pairs are left to be taken one by one
            found += [np.einsum("ij,ij->i", q[a[k : k + 65536]], q[b[k : k + 65536]], dtype=np.float64) for k in range(0, len(a), 65536)]
            cosine = np.concatenate(found)
        else:
            cosine = (q @ q.T).astype(np.float64)[a, b]
        cosine = np.clip(cosine / 16129.0, -1, 1)
        near = cosine >= threshold
        return pd.DataFrame({"a": ids[a[near]], "b": ids[b[near]], "cosine": cosine[near]})

    return cells.groupBy("i", "j").applyInPandas(compare, "a long, b long, cosine double")


def containment_candidates(items: DataFrame, least: float, most: float = 0.95) -> DataFrame:
    """(source, clip): pairs of items (id, duration) where the clip's duration is a share in [least, most) of the source's."""
    base = math.log(1.2)
    k = F.floor(F.log(F.col("duration").cast("double")) / base).cast("long")
    span = math.ceil(math.log(1 / least) / base) + 1
    some = items.filter("duration >= 1").withColumn("k", k)
    source = some.select(F.col("id").alias("source"), F.col("duration").alias("ds"), F.explode(F.sequence(F.col("k") - span, F.col("k"))).alias("k"))
    clip = some.select(F.col("id").alias("clip"), F.col("duration").alias("dc"), "k")
    return source.join(clip, "k").filter((F.col("dc") >= F.col("ds") * least) & (F.col("dc") < F.col("ds") * most)).select("source", "clip", "ds", "dc")


def best_offset(a: np.ndarray, b: np.ndarray, least: float) -> tuple[float, int]:
    """(similarity, offset) of the first best offset of b in a, uint32 each: the mean share of equal bits; (0, 0) if all are below ``least``.

    An offset that the first part of b already keeps from ``least`` is left there; offsets are worked through in pieces, so memory doesn't grow with a track.
    """
    n = len(b)
    if not n or n > len(a):
        return 0.0, 0
    windows = np.lib.stride_tricks.sliding_window_view(a, n)
    head = max(1, n * HEAD // 100)
    best = (0.0, 0)
    for lo in range(0, len(windows), max(1, AT_ONCE // n)):
        part = windows[lo : lo + max(1, AT_ONCE // n)]
        same = 32 * n - np.bitwise_count(part[:, :head] ^ b[:head]).sum(axis=1, dtype=np.int64)
        alive = np.flatnonzero(same / (32.0 * n) >= max(least, best[0]))
        if not len(alive):
            continue
        same = same[alive] - np.bitwise_count(part[alive, head:] ^ b[head:]).sum(axis=1, dtype=np.int64)
        i = int(same.argmax())
        s = float(same[i] / (32.0 * n))
        if s >= least and s > best[0]:
            best = (s, lo + int(alive[i]))
    return best


#: Bits of a word; long and short fingerprints whose spectra are multiplied at once; bytes of their products, and of the long ones' spectra, that are held.
BITS, LONGS, SHORTS, PRODUCT, SPECTRA = 32, 256, 120, 1 << 22, 1 << 26


def may_align(longs: list[np.ndarray], shorts: list[np.ndarray], low: float, high: float, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in longs, in shorts) of the pairs whose ``best_offset`` can reach ``least``: all of them, and few others.

    Fingerprints are uint32; the short one's length is a share in [low, high) of the long one's. Bits are signals of 1 and -1: at an offset where n words
    differ in at most (1 - least) of their bits, any c of the 32 signals correlate by at least (c - 64 (1 - least)) n. Correlations at all
    offsets are products of spectra; the sum of a product's absolute values bounds them before it is transformed back.
    """
    nl, ns = (np.array([len(x) for x in side], np.int64) for side in (longs, shorts))
    by_l, by_s = np.argsort(nl, kind="stable"), np.argsort(ns, kind="stable")
    sizes, lost = ns[by_s], 2 * BITS * (1 - least)
    at = int(np.searchsorted(nl[by_l], 1))
    while at < len(by_l):
        m = _length(int(nl[by_l[at]]))
        room = max(1, SPECTRA // (8 * BITS * (m // 2 + 1)))
        some = by_l[at : min(at + room, int(np.searchsorted(nl[by_l], m, "right")))]
        at += len(some)
        # a little more than the shares let through, which are applied to the pairs
        first, last = max(1, math.floor(nl[some[0]] * low) - 1), math.ceil(nl[some[-1]] * high) + 1
        first, last = int(np.searchsorted(sizes, first)), int(np.searchsorted(sizes, min(last, m), "right"))
        if first == last:
            continue
        one = _spectra([longs[k] for k in some], m)
        step = max(1, min(SHORTS, room // 2))
        for lo in range(first, last, step):
            clips = by_s[lo : min(lo + step, last)]
            fits = (ns[clips] >= nl[some][:, None] * low) & (ns[clips] < nl[some][:, None] * high) & (ns[clips] <= nl[some][:, None])
            if not fits.any():
                continue
            other = _spectra([shorts[k] for k in clips], m, conjugate=True)
            for k in range(0, len(some), LONGS):
                x, y = np.nonzero(fits[k : k + LONGS])
                if len(x):
                    x, y = _left(one[:, k : k + LONGS], other, nl[some[k : k + LONGS]], ns[clips], x, y, m, lost)
                    yield some[k + x], clips[y]


def _length(n: int) -> int:
    """A length of transforms that n words fit into, at most half as long again."""
    step = max(8, 1 << max(0, n.bit_length() - 2))
    return -(-n // step) * step


def _spectra(prints: list[np.ndarray], m: int, conjugate: bool = False) -> np.ndarray:
    """The spectrum (frequency, fingerprint, bit) of each of the bits of fingerprints, padded to m words; or the conjugate one (frequency, bit, fingerprint)."""
    words, used = np.zeros((len(prints), m), np.uint32), np.zeros((len(prints), m), np.uint32)
    for k, p in enumerate(prints):
        # backwards in time is conjugate
        places = -np.arange(len(p)) if conjugate else slice(len(p))
        words[k, places], used[k, places] = p, 0xFFFFFFFF
    shape = (m // 2 + 1, BITS, len(prints)) if conjugate else (m // 2 + 1, len(prints), BITS)
    out = np.empty(shape, np.complex64)
    for bit in range(BITS):
        # 1.0 with the bit as its sign; 0.0 behind the end
        signs = (words << np.uint32(31 - bit) & np.uint32(1 << 31) | np.uint32(0x3F800000)) & used
        out[(slice(None), bit) if conjugate else (..., bit)] = np.fft.rfft(signs.view(np.float32), axis=1).T
    return out


def _left(one: np.ndarray, other: np.ndarray, nl: np.ndarray, ns: np.ndarray, x: np.ndarray, y: np.ndarray, m: int, lost: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (x, y) of ``may_align`` that are left, by spectra (frequency, long, bit) and conjugate ones (frequency, bit, short)."""
    if lost >= BITS:
        return x, y
    # signals of which the sum of absolute values rules out unrelated pairs, by its mean for white noise and a little; else as few as rule them out by correlations
    ratio = float(nl[x].max() / ns[y].min())
    enough = [c for c in range(4, BITS + 1, 2) if c > lost and 1.13 * 1.07 * math.sqrt(c * ratio) <= c - lost]
    c = enough[0] if enough else min(BITS, math.ceil(lost * (1.25 if ns[y].min() >= 128 else 2.5)) + 1)
    one, other = one[:, :, :c], other[:, :c]
    # less for rounding
    need = (c - lost) * ns[y] - 1 - 1e-5 * c * np.sqrt(nl[x] * ns[y])
    if enough:
        total, step = np.zeros((len(nl), 2 * len(ns)), np.float32), max(1, PRODUCT // (8 * len(nl) * len(ns)))
        for k in range(0, len(one), step):
            parts = np.matmul(one[k : k + step], other[k : k + step]).view(np.float32)
            total += np.abs(parts, out=parts).sum(axis=0)
        near = 2.0 / m * (total[:, ::2] + total[:, 1::2])[x, y] >= need
        x, y, need = x[near], y[near], need[near]
    good = np.zeros(len(x), bool)
    # few pairs one by one, many by the products of all
    few = len(x) * 8 < len(nl) * len(ns)
    at, step = (np.arange(len(x)), max(1, PRODUCT // (8 * len(one) * c))) if few else (x, max(1, PRODUCT // (8 * len(one) * len(ns))))
    for k in range(0, int(at.max(initial=-1)) + 1, step):
        part = slice(*np.searchsorted(at, [k, k + step]))
        u, v = x[part], y[part]
        if not len(u):
            continue
        product = (one[:, u] * other[:, :, v].transpose(0, 2, 1)).sum(axis=2) if few else np.matmul(one[:, k : k + step], other)[:, u - k, v]
        good[part] = np.fft.irfft(np.ascontiguousarray(product.T), m, axis=1).max(axis=1) >= need[part]
    return x[good], y[good]


def sliding_window(pairs: DataFrame, least: float) -> DataFrame:
    """(source, clip, similarity, offset) of pairs with fingerprints (long_fp, short_fp: uint32 as long): ``best_offset`` of each."""

    def run(batches):
        for pdf in batches:
            best = [best_offset(np.asarray(x, np.uint32), np.asarray(y, np.uint32), least) for x, y in zip(pdf["long_fp"], pdf["short_fp"], strict=True)]
            yield pd.DataFrame({"source": pdf["source"], "clip": pdf["clip"], "similarity": [x[0] for x in best], "offset": [x[1] for x in best]})

    return pairs.select("source", "clip", "long_fp", "short_fp").mapInPandas(run, "source long, clip long, similarity double, offset long")
