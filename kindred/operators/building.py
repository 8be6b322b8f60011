"""Groups as the matcher sees them: representatives and majorities are tested with the verdict that found the pairs, without its gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import kernels as K
from kindred.operators import grouping
from kindred.operators.lineage import cut
from kindred.operators.matching import MatchSettings


class Snapshots:
    """Some items in arrays, and the verdict on two of them (``matching.verdict`` without gates)."""

    def __init__(self, pdf: pd.DataFrame, s: MatchSettings):
        self.s, self.place = s, {i: k for k, i in enumerate(pdf["id"].tolist())}
        self.image = pdf["is_image"].to_numpy(bool)
        whole = lambda c, kind: [[np.asarray(v, kind) for v in each] for each in pdf[c]]
        self.frames = whole("frames", np.int32)
        self.flipped = [[f.reshape(int(len(f) ** 0.5), -1)[:, ::-1].ravel() for f in each] for each in self.frames]
        self.hashes = [np.asarray(v, np.int64) for v in pdf["ph"]]
        self.flipped_hashes = [np.asarray(v, np.int64) for v in pdf["ph_flip"]] if "ph_flip" in pdf else self.hashes
        self.emb, self.valid = whole("emb", np.int64), [np.asarray(v, bool) for v in pdf["emb_valid"]]
        self._kinds: dict[bool, tuple[np.ndarray, dict[str, np.ndarray]] | None] = {}

    def _difference(self, a: np.ndarray, b: np.ndarray) -> np.float32:
        use = np.ones(len(a), bool)
        if self.s.ignore_black:
            use &= (a > K.BLACK) & (b > K.BLACK)
        if self.s.ignore_white:
            use &= (a < K.WHITE) & (b < K.WHITE)
        n = int(use.sum())
        return np.float32(np.abs(a - b)[use].sum() / n / 256.0) if n else np.float32(np.nan)

    def _classic(self, x: int, y: int, mirror: bool) -> bool:
        s = self.s
        frames = self.flipped[x] if mirror else self.frames[x]
        if self.image[x]:
            return bool(self._difference(frames[0], self.frames[y][0]) <= np.float32(s.image_limit()))
        gray = False
        if s.combine or not s.use_phash:
            total = np.float32(0)
            for p, q in zip(frames, self.frames[y], strict=True):
                total = np.float32(total + self._difference(p, q))
            gray = bool(total <= np.float32(s.gray_limit()))
        hashed = False
        if s.combine or s.use_phash:
            p, q = self.flipped_hashes[x] if mirror else self.hashes[x], self.hashes[y]
            n = min(len(p), len(q))
            near = np.bitwise_count((p[:n] ^ q[:n]).view(np.uint64)) <= s.max_bits()
            need = max(1, int(np.ceil(np.float32(n * np.float32(min(max(s.quorum, 0.01), 1.0))))))
            hashed = n > 0 and int(near.sum()) >= need
        return gray or hashed

    def _by_ai(self, x: int, y: int) -> bool:
        n = min(len(self.valid[x]), len(self.valid[y]))
        both = [j for j in range(n) if self.valid[x][j] and self.valid[y][j]]
        if len(both) < max(1, (n + 1) // 2):
            return False
        total = np.float32(0)
        for j in both:
            total = np.float32(total + np.float32(min(1.0, max(-1.0, int(self.emb[x][j] @ self.emb[y][j]) / 16129.0))))
        return bool(np.float32(total / len(both)) >= np.float32(self.s.ai_limit()))

    def similar(self, a: int, b: int) -> bool:
        """The verdict on the items a and b; with mirror images compared, a's is tried, too."""
        return self._similar(self.place[a], self.place[b])

    def _similar(self, x: int, y: int) -> bool:
        if self.image[x] != self.image[y]:
            return False
        return self._classic(x, y, False) or (self.s.use_ai and self._by_ai(x, y)) or (self.s.flipped and self._classic(x, y, True))

    def row(self, x: int, others: np.ndarray | None = None, first: bool = True) -> np.ndarray:
        """``similar`` of the item at place x to those at others, or to all: at once, where the items of its kind have equally many positions and pixels.

        Not ``first``, the others' to x: hashes of mirror images needn't agree with those that the mirrored other way round give.
        """
        others = np.arange(len(self.image)) if others is None else others
        out = np.zeros(len(others), bool)
        same = np.flatnonzero(self.image[others] == self.image[x])
        kind = bool(self.image[x])
        if kind not in self._kinds:
            self._kinds[kind] = self._stacked(kind)
        if self._kinds[kind] is None:
            out[same] = [self._similar(x, y) if first else self._similar(y, x) for y in others[same]]
        else:
            at, arrays = self._kinds[kind]
            out[same] = self._like(arrays, kind, int(at[x]), at[others[same]], first)
        return out

    def _stacked(self, image: bool) -> tuple[np.ndarray, dict[str, np.ndarray]] | None:
        """(what place each item has, arrays) of the items of a kind; None where they differ in form."""
        own = np.flatnonzero(self.image == image)
        s, out = self.s, {}
        hashed = (s.combine or s.use_phash) and not image
        lists = {"frames": self.frames, "flipped": self.flipped} if image or s.combine or not s.use_phash else {}
        lists |= {"hashes": self.hashes, "flipped_hashes": self.flipped_hashes} if hashed else {}
        lists |= {"emb": self.emb, "valid": self.valid} if s.use_ai else {}
        for name, values in lists.items():
            try:
                out[name] = np.array([values[k] for k in own])
            except ValueError:
                return None
            if out[name].ndim != (2 if name in ("hashes", "flipped_hashes", "valid") else 3) or not out[name].size:
                return None
        for name in ("frames", "flipped"):
            if name in out and -(1 << 14) <= out[name].min() and out[name].max() < 1 << 14:
                out[name] = out[name].astype(np.int16)
            if name in out:  # a row for each pixel: short frames are compared pixel by pixel
                out[name] = np.ascontiguousarray(out[name].transpose(1, 2, 0))
        if s.use_ai and out["emb"].shape[1] != out["valid"].shape[1]:
            return None
        at = np.full(len(self.image), -1)
        at[own] = np.arange(len(own))
        return at, out

    def _differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_difference`` of a frame to each of some, a column each."""
        a = a[:, None]
        gap = np.abs(a - b)
        if not (self.s.ignore_black or self.s.ignore_white):
            return (gap.sum(axis=0, dtype=np.int64) / len(gap) / 256.0).astype(np.float32)
        use = np.ones(gap.shape, bool)
        if self.s.ignore_black:
            use &= (a > K.BLACK) & (b > K.BLACK)
        if self.s.ignore_white:
            use &= (a < K.WHITE) & (b < K.WHITE)
        n = use.sum(axis=0)
        return np.where(n > 0, (gap * use).sum(axis=0, dtype=np.int64) / np.maximum(n, 1) / 256.0, np.nan).astype(np.float32)

    def _like(self, arrays: dict[str, np.ndarray], image: bool, x: int, y: np.ndarray, first: bool) -> np.ndarray:
        s, out = self.s, np.zeros(len(y), bool)
        others = arrays["frames"][:, :, y] if "frames" in arrays else None
        for frames, hashes in (("frames", "hashes"), ("flipped", "flipped_hashes")) if s.flipped else (("frames", "hashes"),):
            if "frames" in arrays:
                one = arrays[frames][:, :, x]
                total = np.zeros(len(y), np.float32)
                for j in range(1 if image else len(one)):
                    total = total + self._differences(one[j], others[j])
                out |= total <= np.float32(s.image_limit() if image else s.gray_limit())
            if "hashes" in arrays:
                one, other = (hashes, "hashes") if first else ("hashes", hashes)
                near = np.bitwise_count((arrays[one][x] ^ arrays[other][y]).view(np.uint64)) <= s.max_bits()
                n = near.shape[1]
                out |= near.sum(axis=1) >= max(1, int(np.ceil(np.float32(n * np.float32(min(max(s.quorum, 0.01), 1.0))))))
        if s.use_ai:
            n = arrays["valid"].shape[1]
            both = arrays["valid"][x] & arrays["valid"][y]
            count, total = both.sum(axis=1), np.zeros(len(y), np.float32)
            for j in range(n):
                cosine = np.clip(arrays["emb"][y, j] @ arrays["emb"][x, j] / 16129.0, -1.0, 1.0).astype(np.float32)
                total = total + np.where(both[:, j], cosine, np.float32(0))
            mean = total / np.maximum(count, 1).astype(np.float32)
            out |= (count >= max(1, (n + 1) // 2)) & (mean >= np.float32(s.ai_limit()))
        return out


class _Rows:
    """Rows of verdicts that are looked up again and again; as many are kept as HELD bytes hold."""

    HELD = 1 << 28

    def __init__(self, snaps: Snapshots):
        self.snaps, self.rows = snaps, {}

    def similar(self, x: int, y: int) -> bool:
        row = self.rows.get(x)
        if row is None:
            if len(self.rows) * len(self.snaps.image) > self.HELD:
                self.rows.clear()
            row = self.rows[x] = self.snaps.row(x).tobytes()
        return row[y] != 0


#: Edges that are replayed at once.
EDGES = 1 << 16
#: Members of a group whose links are all held while it is split; of larger groups as much is held, the rest is found again.
MOST_MEMBERS = 32_768


def matched_groups(edges: DataFrame, items: DataFrame, s: MatchSettings) -> DataFrame:
    """(group_id, idx, difference, flags, is_rep) of edges (a, b, difference, flags) between items (as in ``matching``).

    Each component is replayed in the order of (a, b): a new pair founds a group led by its first item; items join and groups merge
    only if the verdict likes the representatives. Groups of three or more are then split by majority pruning over the verdicts of all
    their pairs, in the order in which members came. A group's id is its smallest member.
    Groups and components may have any size.
    """
    wanted = ["id", "is_image", "frames", "ph", "emb", "emb_valid"] + (["ph_flip"] if "ph_flip" in items.columns else [])

    def fold(pdf: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        snaps = Snapshots(members, s)
        ids = members["id"].to_numpy()
        order = np.argsort(ids)
        place = lambda c: order[np.searchsorted(ids, pdf[c].to_numpy(), sorter=order)]
        a, b, difference, flags = place("a"), place("b"), pdf["difference"].to_numpy(), pdf["flags"].to_numpy()
        by = np.lexsort((ids[b], ids[a], ~snaps.image[a]))
        # tuples of so many edges at a time
        parts = (by[lo : lo + EDGES] for lo in range(0, len(by), EDGES))
        rows = (row for at in parts for row in zip(*(c[at].tolist() for c in (a, b, difference, flags)), strict=True))
        found: dict[int, list[tuple]] = {}
        for g, i, d, f, r in grouping.replay_edges(rows, _Rows(snaps).similar):
            found.setdefault(g, []).append((i, d, f, r))
        out = []
        for group in found.values():
            parts = [list(range(len(group)))]
            if len(group) > 2:
                at = np.array([m[0] for m in group])
                links = grouping.Links(len(at), lambda k: snaps.row(at[k], at[k + 1 :]), lambda k, low: snaps.row(at[k], at[low:k], first=False), MOST_MEMBERS)  # noqa: B023
                parts = grouping.split_links(links.degree, links.row, MOST_MEMBERS)
            names = [int(ids[m[0]]) for m in group]
            out += [(min(names[k] for k in part), names[k], *group[k][1:]) for part in parts for k in part]
        return pd.DataFrame(out, columns=["group_id", "idx", "difference", "flags", "is_rep"]).astype({"group_id": "int64", "idx": "int64", "difference": "float64", "flags": "int32", "is_rep": "bool"})

    edges = cut(edges)  # what finds them runs once
    of = grouping.components(edges)
    keyed = edges.select("a", "b", F.col("difference").cast("double").alias("difference"), F.col("flags").cast("int").alias("flags")).join(of.withColumnRenamed("node", "a"), "a")
    members = items.select(*wanted).join(of.select(F.col("node").alias("id"), F.col("component").alias("of")), "id")
    return keyed.groupBy("component").cogroup(members.groupBy("of")).applyInPandas(fold, "group_id long, idx long, difference double, flags int, is_rep boolean")
