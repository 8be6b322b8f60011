"""Verdicts of all pairs of items in numpy, cell by cell: what ``matching.verdict`` decides where no pixel is masked.

Items are dealt in the order of their durations as in ``pairs.frame_pairs``; images are one band. What a verdict measures is taken for a whole tile of
pairs, in integers; pairs that may match are decided from that in the single precision of the columns, so both ways give equal rows. Rows leave a task
tile by tile, so what it holds doesn't grow with the number of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import kernels as K
from kindred.operators import pairs
from kindred.operators.pairs import BOTH, LEFT, RIGHT

#: Rows of a tile, and of what they are compared with at once.
TILE, OTHERS = 256, 2048
#: A tile of which a bound on frames leaves more than this share of pairs is compared pixel by pixel as a whole.
DENSE = 1 / 8
#: Rows that leave a task at once; kinds of folders of a cell whose overlaps are kept in a table.
AT_ONCE, MOST_KINDS = 1 << 16, 2048
_single = np.float32


def regular(s, image: bool, what: str) -> F.Column:
    """Items that the arrays here can hold: square frames of bytes for each position, with hashes and vectors where the settings, or an explanation, read them."""
    n = 1 if image else s.positions
    size = F.size(F.get("frames", F.lit(0)))
    ok = (F.size("frames") == n) & (F.sqrt(size) == F.floor(F.sqrt(size))) & (size > 0) & F.forall("frames", lambda f: (F.size(f) == size) & F.forall(f, lambda p: p.between(0, 255)))
    if ((s.combine or s.use_phash) and not image) or what == EXPLAINED:
        whole = lambda c: (F.size(c) == n) & F.forall(c, lambda h: h.isNotNull())
        ok = ok & whole("ph") & (whole("ph_flip") if s.flipped else F.lit(True))
    if what == EXPLAINED:
        ok = ok & F.col("duration").isNotNull()
    if s.use_ai:
        wide = F.size(F.get("emb", F.lit(0)))
        ok = ok & (F.size("emb") == n) & (F.size("emb_valid") == n) & (wide > 0) & F.forall("emb", lambda e: (F.size(e) == wide) & F.forall(e, lambda x: x.between(-127, 127))) & F.forall("emb_valid", lambda v: v.isNotNull())
    return F.coalesce(ok, F.lit(False))


#: What a task returns of its pairs: the matches, how many of them have which flags, or every pair that passes the gate of duration.
FOUND, FLAGS = "a {0}, b {0}, difference float, flags int", "flags int, n long"
EXPLAINED = "a {0}, b {0}, duration_gap double, folder_ok boolean, hard_link boolean, ai float, normal boolean, flipped boolean, hash_distances array<int>, match boolean, difference float, flags int"


def matches(items: DataFrame, s, image: bool, band: F.Column, reach: int, tolerance: F.Column, folders: F.Column, what: str = FOUND) -> DataFrame:
    """The pairs of items of one kind, as ``what`` says: FOUND, FLAGS or EXPLAINED."""
    spark = items.sparkSession
    hashed, n = (s.combine or s.use_phash) and not image, 1 if image else s.positions
    told = what == EXPLAINED
    scope = F.coalesce("in_scope", F.lit(False)) if "in_scope" in items.columns else F.lit(True)
    rows = items.select(
        "id", F.col("duration").cast("double").alias("duration"), tolerance.cast("double").alias("tolerance"), scope.alias("scoped"), K.packed(F.flatten("frames")).alias("px"), F.size(F.get("frames", F.lit(0))).alias("pixels"),
        *([F.col("ph"), (F.col("ph_flip") if s.flipped else F.col("ph")).alias("ph_flip")] if hashed or told else []), *([F.flatten("emb").alias("emb"), "emb_valid"] if s.use_ai else []),
        *([folders.alias("folders")] if s.folder_mode != "none" or told else []), *([F.col("size"), "dev", F.col("ino").cast("string").alias("ino")] if s.exclude_hard_links or told else []), band.alias("k"),
    )
    sizes = sorted(tuple(r) for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect())
    bands, cells = pairs._cells(sizes, reach)
    number = max((c for _, c, _ in cells), default=0) + 1
    bands = F.broadcast(spark.createDataFrame(bands, "k long, first int, parts int"))
    cells = F.broadcast(spark.createDataFrame(cells, "block int, cell int, role int"))
    dealt = rows.join(bands, "k").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(cells, "block").drop("k", "first", "parts", "block")
    parts = min(2048, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * number))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches)).combine_chunks().sort_by("duration")
        if len(cell["pixels"].unique()) > 1:
            raise ValueError("frames of items that meet have equal sizes")
        yield from _Cell(cell, s, image, n, hashed, what).batches()

    return dealt.repartition(parts, "cell").groupBy("cell").applyInArrow(compare, what.format(dict(items.dtypes)["id"]))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Arrays of equal length as the rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class _FewPixels(pairs._Bound):
    """The bound of ``pairs.frame_pairs`` where pairs that pass it are compared for a few hundred pixels at most."""

    EXACT, MOST = 150.0, 8


class _Cell:
    def __init__(self, cell: pa.Table, s, image: bool, n: int, hashed: bool, what: str):
        self.s, self.image, self.n, self.hashed, self.what, self.told = s, image, n, hashed, what, what == EXPLAINED
        rows = len(cell)
        self.ids, self.duration, self.tolerance, self.scoped, self.role = (cell[c].to_numpy() for c in ("id", "duration", "tolerance", "scoped", "role"))
        self.rank = np.unique(self.ids, return_inverse=True)[1].astype(np.int32)
        px = np.frombuffer(b"".join(cell["px"].to_pylist()), np.uint8).reshape(rows, n, -1).astype(np.int16)
        self.pixels = px.shape[2]
        side = int(self.pixels**0.5)
        # a row for each pixel: tiles are worked through pixel by pixel
        self.px = np.ascontiguousarray(px.reshape(rows, -1).T)
        self.mirror = np.ascontiguousarray(px.reshape(rows, n, side, side)[..., ::-1].reshape(rows, -1).T) if s.flipped else None
        # sums of frames whose size is a power of two are exact in single precision: one for all positions will do
        self.whole = self.pixels & (self.pixels - 1) == 0 and 255 * self.pixels * n < 1 << 24
        self.gray = image or s.combine or not s.use_phash
        self.bounds = self._bounds(px.reshape(rows, -1)) if self.gray and not (hashed or s.use_ai or self.told) else None
        if hashed or self.told:
            self.ph, self.ph_flip = (_matrix(cell[c], rows).astype(np.int64).view(np.uint64) for c in ("ph", "ph_flip"))
            width = int(max(self.ph.max(), self.ph_flip.max())).bit_length()
            kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if width <= bits)
            self.ph, self.ph_flip = (np.ascontiguousarray(h.T.astype(kind)) for h in (self.ph, self.ph_flip))
        if s.use_ai:
            self.valid = _matrix(cell["emb_valid"], rows).astype(bool)
            emb = _matrix(cell["emb"], rows).reshape(rows, n, -1)
            # products of int8 components are exact in single precision for 1,000 of them
            self.emb = (emb.astype(_single if emb.shape[2] <= 1000 else np.float64) * self.valid[:, :, None]).transpose(1, 0, 2).copy()
        if s.folder_mode != "none" or self.told:
            self.folders, self.folder = self._codes([tuple(sorted(set(x))) for x in cell["folders"].to_pylist()])
            self.one_each = all(len(x) == 1 for x in self.folders)
            self.overlap = None if self.one_each or len(self.folders) > MOST_KINDS else np.array([[not set(x).isdisjoint(y) for y in self.folders] for x in self.folders], bool)
        if s.exclude_hard_links or self.told:
            files, self.file = self._codes([x if None not in x and x[2] else None for x in zip(*(cell[c].to_pylist() for c in ("size", "dev", "ino")), strict=True)])
            self.linked = np.array([x is not None for x in files])[self.file]

    def _bounds(self, px: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Factors of the frames at the left, as they are and mirrored, and of those at the right: a product below 0 rules a pair out. None where no bound pays."""
        s, out = self.s, []
        left, right = np.flatnonzero(self.role != RIGHT), np.flatnonzero(self.role != LEFT)
        if not len(left) or not len(right):
            return None
        # limits are sums of single-precision means over the positions: a little more is let through
        most = (s.image_limit() if self.image else s.gray_limit() / self.n) * (1 + 1e-5) + 1 / 256 / px.shape[1]
        flat = px.astype(np.uint8)
        for frames in (flat, None if self.mirror is None else np.ascontiguousarray(self.mirror.T).astype(np.uint8)):
            if frames is None:
                continue
            bound = _FewPixels(frames[left], flat, right, most, False)
            if bound.all:
                return None
            x, y = (np.zeros((len(px), bound.one.shape[1]), np.float32) for _ in range(2))
            x[left], y[right] = bound.one, bound._factors(flat[right], bound.r, bound.stride, other=True)[0]
            out.append((x, y))
        return out

    @staticmethod
    def _codes(values: list) -> tuple[list, np.ndarray]:
        known: dict = {}
        codes = np.array([known.setdefault(v, len(known)) for v in values], np.int64)
        return list(known), codes

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What the task returns, of about AT_ONCE rows each."""
        held, rows = [], 0
        count = np.zeros(32, np.int64)
        for found in self._tiles():
            if self.what == FLAGS:
                count += np.bincount(found["flags"], minlength=32)
                continue
            held.append(self._batch(found))
            rows += held[-1].num_rows
            if rows >= AT_ONCE:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches(AT_ONCE)
                held, rows = [], 0
        if self.what == FLAGS:
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"flags": some.astype(np.int32), "n": count[some]})
        elif held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(AT_ONCE)

    def _batch(self, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        columns = {c: pa.array(v) for c, v in found.items() if c != "hash_distances"}
        if self.told:
            at = found["hash_distances"]
            columns["hash_distances"] = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1], at.ravel())
        return pa.RecordBatch.from_pydict({c.split()[0]: columns[c.split()[0]] for c in self.what.split(", ")})

    def _tiles(self) -> Iterator[dict[str, np.ndarray]]:
        left, right = np.flatnonzero(self.role != RIGHT), np.flatnonzero(self.role != LEFT)
        for lo in range(0, len(left), TILE):
            rows = left[lo : lo + TILE]
            some = right
            if not self.image:
                most = self.tolerance[rows].max() * (1 + 1e-9)
                span = np.searchsorted(self.duration[right], self.duration[rows[0]] - most), np.searchsorted(self.duration[right], self.duration[rows[-1]] + most, "right")
                some = right[span[0] : span[1]]
            for at in range(0, len(some), OTHERS):
                found = self._tile(rows, some[at : at + OTHERS])
                if found is not None and len(found["a"]):
                    yield found

    def _tile(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray] | None:
        """The pairs of x and y that the task returns: those through the gates that some verdict may like are decided."""
        s = self.s
        gate = self.rank[x][:, None] != self.rank[y]
        if not self.scoped.all():
            gate &= self.scoped[x][:, None] | self.scoped[y]
        if (self.role[y] == BOTH).any():
            gate &= (self.role[y] != BOTH) | (x[:, None] < y)
        if not self.image:
            ends, least = self.duration[[x[0], x[-1], y[0], y[-1]]], min(self.tolerance[x].min(), self.tolerance[y].min())
            if not ends.max() - ends.min() <= least:  # else all of them are near
                gate &= np.abs(self.duration[x][:, None] - self.duration[y]) <= np.minimum(self.tolerance[x][:, None], self.tolerance[y])
        if s.folder_mode != "none" and self.one_each and not self.told:
            gate &= (self.folder[x][:, None] == self.folder[y]) == (s.folder_mode == "same")
        if not gate.any():
            return None
        at: dict[str, list[np.ndarray]] = {}
        may = np.zeros(gate.shape, bool)
        for one, other in self.bounds or ():
            may |= one[x] @ other[y].T >= 0
        sparse = self.bounds is not None and may.mean() <= DENSE
        if sparse:
            may &= gate
        for name, frames in (("d", self.px), ("fd", self.mirror)) if self.gray and not sparse else ():
            if frames is not None:
                at[name] = self._gaps(frames, x, y)
                limit = (s.image_limit() if self.image else s.gray_limit()) * 256.0 * self.pixels * (1 + 1e-5) + 1
                total = at[name][0] if len(at[name]) == 1 else sum(g.astype(np.int64) for g in at[name])
                may |= total <= min(int(limit), np.iinfo(total.dtype).max)
        if self.hashed or self.told:
            at["b"] = [np.bitwise_count(h[x][:, None] ^ h[y]) for h in self.ph]
            if self.hashed and s.flipped:
                first = self.rank[x][:, None] < self.rank[y]
                at["fb"] = [np.bitwise_count(np.where(first, f[x][:, None] ^ h[y], h[x][:, None] ^ f[y])) for f, h in zip(self.ph_flip, self.ph, strict=True)]
            for name in ("b", "fb") if self.hashed else ():
                if name in at:
                    may |= self._near(at[name]) >= self._need()
        if s.use_ai:
            at["ai"] = [self._similarity(x, y)]
            may |= at["ai"][0] >= _single(s.ai_limit())
        pick = np.flatnonzero(gate if self.told else may & gate)
        i, j = np.divmod(pick, len(y))
        p, q = x[i], y[j]
        first = self.rank[p] < self.rank[q]
        a, b = np.where(first, p, q), np.where(first, q, p)
        of = {c: [v.ravel()[pick] for v in each] for c, each in at.items()}
        if sparse:
            of |= {name: self._gaps_of(frames, p, q) for name, frames in (("d", self.px), ("fd", self.mirror)) if frames is not None}
        return self._decided(a, b, of)

    def _gaps(self, frames: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """The summed differences of all pixels, pixel by pixel over the tile; where sums are rounded, those of each position."""
        a, b = frames[:, x], self.px[:, y]
        size = len(a) if self.whole else self.pixels
        kind = np.int16 if size <= 128 else np.int32
        gap, out = np.empty((len(x), len(y)), np.int16), []
        for lo in range(0, len(a), size):
            total = np.zeros(gap.shape, kind)
            for k in range(lo, lo + size):
                np.subtract(a[k][:, None], b[k], out=gap)
                np.abs(gap, out=gap)
                total += gap
            out.append(total)
        return out

    def _gaps_of(self, frames: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
        """``_gaps`` of some pairs."""
        size = len(frames) if self.whole else self.pixels
        out = [np.zeros(len(p), np.int32) for _ in range(len(frames) // size)]
        for lo in range(0, len(p), AT_ONCE):
            gap = np.abs(frames[:, p[lo : lo + AT_ONCE]] - self.px[:, q[lo : lo + AT_ONCE]])
            for k, total in enumerate(out):
                total[lo : lo + AT_ONCE] = gap[k * size : (k + 1) * size].sum(axis=0, dtype=np.int32)
        return out

    def _need(self) -> int:
        return max(1, int(np.ceil(_single(self.n * _single(min(max(self.s.quorum, 0.01), 1.0))))))

    def _near(self, bits: list[np.ndarray]) -> np.ndarray:
        """At how many positions hashes are near."""
        return sum(((d <= self.s.max_bits()).view(np.int8) for d in bits), start=np.zeros(1, np.int16))

    def _similarity(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The mean cosine over positions that are valid on both sides, as ``matching.ai_similarity``."""
        total = np.zeros((len(x), len(y)), _single)
        for j in range(self.n):
            # an invalid position is a vector of zeros; adding its cosine, 0, changes nothing
            total += np.clip((self.emb[j][x] @ self.emb[j][y].T / 16129).astype(_single, copy=False), -1, 1)
        count = self.valid[x].astype(_single) @ self.valid[y].astype(_single).T
        return np.where(count >= max(1, (self.n + 1) // 2), total / np.maximum(count, 1), _single(-1))

    def _classic(self, gaps: list[np.ndarray] | None, bits: list[np.ndarray] | None, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matches, difference, algorithms) as ``matching.classic_verdict``."""
        s, one = self.s, _single(1)
        nothing = np.zeros(rows, np.int32)
        if gaps is not None:
            total = np.zeros(rows, _single)
            for g in gaps:
                total = total + (g / self.pixels / 256.0).astype(_single)
        if self.image:
            ok = total <= _single(s.image_limit())
            return ok, total, np.where(ok, K.GRAY_MATCHED, 0).astype(np.int32) if s.combine else nothing
        if gaps is not None:
            gray, of_gray = total <= _single(s.gray_limit()), total / _single(s.positions)
        if not self.hashed:
            return gray, np.where(gray, of_gray, one), nothing
        ph = self._near(bits) >= self._need()
        total = np.zeros(rows, _single)
        for d in bits:
            total = total + d / _single(64)
        of_ph = total / _single(self.n)
        if not s.combine:
            return ph, np.where(ph, of_ph, one), nothing
        least = np.where(gray & ph, np.minimum(of_gray, of_ph), np.where(gray, of_gray, np.where(ph, of_ph, one)))
        return gray | ph, least, gray * np.int32(K.GRAY_MATCHED) + ph * np.int32(K.PHASH_MATCHED)

    def _same_folder(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.folder[a], self.folder[b]
        if self.one_each:
            return x == y
        if self.overlap is not None:
            return self.overlap[x, y]
        kinds, at = np.unique(x * len(self.folders) + y, return_inverse=True)
        return np.array([not set(self.folders[i]).isdisjoint(self.folders[j]) for i, j in zip(*np.divmod(kinds, len(self.folders)), strict=True)], bool)[at]

    def _decided(self, a: np.ndarray, b: np.ndarray, at: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
        """Those that match, as ``matching.judged``; to explain them, every pair as ``matching.explain``."""
        s = self.s
        ok = np.ones(len(a), bool)
        if s.folder_mode != "none" or self.told:
            same = self._same_folder(a, b)
            folder_ok = ok if s.folder_mode == "none" else same if s.folder_mode == "same" else ~same
            ok = ok & folder_ok
        if s.exclude_hard_links or self.told:
            link = self.linked[a] & (self.file[a] == self.file[b])
            link = link if self.image else link & (self.duration[a] == self.duration[b])
            ok = ok & ~link if s.exclude_hard_links else ok
        match, difference, flags = normal, _, _ = self._classic(at.get("d"), at.get("b"), len(a))
        flags = np.where(match, flags, 0)
        if s.use_ai:
            by_ai = ~match & (at["ai"][0] >= _single(s.ai_limit()))
            difference, flags, match = np.where(by_ai, _single(1) - at["ai"][0], difference), np.where(by_ai, K.AI_MATCHED, flags), match | by_ai
        flipped = np.zeros(len(a), bool)
        if s.flipped:
            flipped, other, algorithms = self._classic(at.get("fd"), at.get("fb"), len(a))
            wins = flipped & (~match | (other < difference))
            flags, difference, match = np.where(wins, algorithms | K.FLIPPED, flags), np.where(wins, other, difference), match | wins
        flags = flags.astype(np.int32, copy=False)
        if self.told:
            out = {"a": self.ids[a], "b": self.ids[b], "duration_gap": np.abs(self.duration[a] - self.duration[b]), "folder_ok": folder_ok, "hard_link": link, "normal": normal, "flipped": flipped}
            out["hash_distances"] = np.stack(at["b"], axis=1).astype(np.int32)
            out["ai"] = at["ai"][0] if s.use_ai else np.full(len(a), -1, _single)
            return out | {"match": match & ok, "difference": difference, "flags": flags}
        keep = np.flatnonzero(match & ok)
        return {"a": self.ids[a[keep]], "b": self.ids[b[keep]], "difference": difference[keep], "flags": flags[keep]}
