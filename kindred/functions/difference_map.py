"""Difference maps of two luma grids: normalised, blurred, thresholded, and their regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise(luma: np.ndarray) -> np.ndarray:
    """Zero mean and unit deviation; a flat grid becomes zero."""
    std = luma.std()
    return np.zeros_like(luma, float) if std < 1e-4 else (luma - luma.mean()) / std


def blur(x: np.ndarray) -> np.ndarray:
    """The mean of each 3 x 3 neighbourhood inside the grid."""
    total, number = np.zeros_like(x, float), np.zeros_like(x, float)
    h, w = x.shape
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            to = (slice(max(dy, 0), h + min(dy, 0)), slice(max(dx, 0), w + min(dx, 0)))
            of = (slice(max(-dy, 0), h + min(-dy, 0)), slice(max(-dx, 0), w + min(-dx, 0)))
            total[to] += x[of]
            number[to] += 1
    return total / number


def difference_mask(a: np.ndarray, b: np.ndarray, sensitivity: float) -> np.ndarray:
    """Where two grids differ after normalisation; points with fewer than two marked neighbours are cleared."""
    mask = blur(np.abs(normalise(a) - normalise(b))) > 1.8 - 1.55 * min(max(sensitivity, 0), 1)
    padded = np.pad(mask, 1).astype(int)
    h, w = mask.shape
    around = sum(padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - mask
    return mask & (around >= 2)


def regions(mask: np.ndarray, least: int = 4, gap: int = 3, most: int = 12, pad: int = 2) -> list[tuple[float, float, float, float]]:
    """Boxes (x, y, width, height as shares) of 8-connected regions, near ones merged, the largest first."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while mask.any():
        padded = np.pad(label, 1, constant_values=h * w)
        near = np.min([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        new = np.where(mask, near, h * w)
        if (new == label).all():
            break
        label = new
    boxes = []
    for k in np.unique(label[mask]):
        y, x = np.nonzero(label == k)
        if len(y) >= least:
            boxes.append([x.min(), y.min(), x.max(), y.max(), len(y)])
    merged = True
    while merged:
        merged = False
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                p, q = boxes[i], boxes[j]
                if max(p[0], q[0]) - min(p[2], q[2]) - 1 <= gap and max(p[1], q[1]) - min(p[3], q[3]) - 1 <= gap:
                    boxes[i] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]), p[4] + q[4]]
                    del boxes[j]
                    merged = True
                    break
            if merged:
                break
    out = []
    for x0, y0, x1, y1, _ in sorted(boxes, key=lambda b: (-b[4], b[1], b[0]))[:most]:
        x0, y0, x1, y1 = max(x0 - pad, 0), max(y0 - pad, 0), min(x1 + pad, w - 1), min(y1 + pad, h - 1)
        out.append((x0 / w, y0 / h, (x1 - x0 + 1) / w, (y1 - y0 + 1) / h))
    return out


#: The longest side of a grid that is analysed.
MOST_SIDE = 384


def analysis_size(width: int, height: int, most: int = MOST_SIDE) -> tuple[int, int]:
    """The size at which a picture is analysed: smaller in proportion if a side is longer than ``most``."""
    scale = min(1.0, most / max(width, height, 1))
    return max(1, round(width * scale)), max(1, round(height * scale))


def shrink(luma: np.ndarray, width: int, height: int) -> np.ndarray:
    """The mean of the box of pixels behind each point of a smaller grid."""
    h, w = luma.shape
    ys, xs = np.arange(height + 1) * h // height, np.arange(width + 1) * w // width
    total = np.add.reduceat(np.add.reduceat(luma.astype(np.float64), ys[:-1], axis=0), xs[:-1], axis=1)
    return total / (np.diff(ys)[:, None] * np.diff(xs)[None, :])


def alpha(mask: np.ndarray, opacity: float = 0.6) -> np.ndarray:
    """How opaque a map over the picture is at each point, 0 to 255."""
    return np.where(mask, np.uint8(round(255 * opacity)), np.uint8(0)).astype(np.uint8)


def coverage(mask: np.ndarray) -> float:
    return float(mask.mean()) if mask.size else 0.0


_BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")])


@F.pandas_udf(T.StructType([T.StructField("coverage", T.DoubleType()), T.StructField("regions", T.ArrayType(_BOX))]))
def differing_regions(a: pd.Series, b: pd.Series, width: pd.Series, height: pd.Series, sensitivity: pd.Series) -> pd.DataFrame:
    """Of pairs of luma grids (arrays of width x height values): the share of points that differ, and boxes of where."""
    out = []
    for x, y, w, h, s in zip(a, b, width, height, sensitivity, strict=True):
        to = analysis_size(int(w), int(h))
        grids = [shrink(np.asarray(g, np.float64).reshape(int(h), int(w)), *to) for g in (x, y)]
        mask = difference_mask(*grids, float(s))
        out.append((coverage(mask), [dict(zip(("x", "y", "width", "height"), map(float, r), strict=True)) for r in regions(mask)]))
    return pd.DataFrame(out, columns=["coverage", "regions"])
