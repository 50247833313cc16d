"""Measures of raw grey pictures: the boundary to image decoding.

Decoding and neural inference are not part of this engine; a decoder gives
``(height, width, pixels)`` with one byte per pixel, and these functions run
on whole Arrow batches of them.  ``embedding_udf`` wraps any embedder the same
way.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = "brightness double, contrast double, sharpness double, focus double, dhash64 bigint"


class Embedder(Protocol):
    """A model as the engine sees it; pictures with different signatures are
    never compared."""

    signature: str
    dimension: int

    def extract(self, picture: np.ndarray) -> np.ndarray: ...


def _grey(height, width, pixels) -> np.ndarray | None:
    if pixels is None or height is None or width is None or height < 3 or width < 3 or len(pixels) != int(height) * int(width):
        return None
    return np.frombuffer(pixels, np.uint8).reshape(int(height), int(width)).astype(float)


def laplacian_variance(grey: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, edges mirrored."""
    p = np.pad(grey, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
    return float(lap.var())


def resized(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means on a regular grid."""
    rows = np.linspace(0, grey.shape[0], height + 1)
    cols = np.linspace(0, grey.shape[1], width + 1)
    total = np.pad(grey.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r, c = np.arange(grey.shape[0] + 1), np.arange(grey.shape[1] + 1)
    at_rows = np.stack([np.interp(rows, r, total[:, j]) for j in range(total.shape[1])], axis=1)
    at = np.stack([np.interp(cols, c, at_rows[i]) for i in range(height + 1)])
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return sums / (np.diff(rows)[:, None] * np.diff(cols)[None, :])


def difference_hash(grey: np.ndarray) -> int:
    """64 signs of horizontal differences on a 9 x 8 grid, as a signed BIGINT."""
    small = resized(grey, 8, 9)
    bits = (small[:, 1:] > small[:, :-1] + 1e-9).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value


#: Fixed values of the regional focus: side of the normal picture, rows of the
#: bands and columns inside it, spread of the smoothing, median of a standard
#: normal's absolute value, and least energy of the first derivatives.
SIDE, BANDS, INSIDE = 128, ((20, 54), (54, 86), (86, 116)), (20, 108)
SPREAD, MAD, LEAST_ENERGY = 0.5, 0.67448975, 16.0


def _normal_size(grey: np.ndarray) -> np.ndarray:
    """The picture at ``SIDE`` x ``SIDE`` in whole grey levels: area means, or
    between pixels if it is smaller."""
    if min(grey.shape) >= SIDE:
        return np.rint(resized(grey, SIDE, SIDE))
    for axis in (0, 1):
        n = grey.shape[axis]
        at = np.clip((np.arange(SIDE) + 0.5) * n / SIDE - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        grey = grey.take(low, axis) * (1 - part) + grey.take(np.minimum(low + 1, n - 1), axis) * part
    return np.rint(grey)


def _detail_kernels() -> tuple[np.ndarray, ...]:
    """Weights of five pixels: smoothing; smoothed first derivative and the
    mean across it; smoothed second derivative."""
    bell = np.exp(-(np.arange(-1, 2) ** 2) / (2 * SPREAD**2))
    bell /= bell.sum()
    wide = lambda k: np.convolve(bell, k)
    return np.pad(bell, 1), wide([-0.5, 0, 0.5]), wide([0.25, 0.5, 0.25]), wide([1, -2, 1])


def _filtered(region: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    """A separable filter where it does not leave the region."""
    view = np.lib.stride_tricks.sliding_window_view
    return view(view(region, 5, axis=0) @ down, 5, axis=1) @ across


def regional_focus(grey: np.ndarray) -> float:
    """Detail relative to contrast at a fixed face scale: the median over three
    bands of the lesser, by direction, of second to first derivative energy.

    White noise, told from the diagonal differences, adds the sum of squares
    of a filter's weights times its variance to the filter's energy, and that
    is taken off.  A band whose first derivatives have too little energy has
    no detail.
    """
    small = _normal_size(grey)
    smooth, slope, level, bend = _detail_kernels()
    out = []
    for top, bottom in BANDS:
        region = small[top:bottom, slice(*INSIDE)]
        corners = np.diff(np.diff(region, axis=0), axis=1) / 2
        noise = (np.median(np.abs(corners - np.median(corners))) / MAD) ** 2
        energy = lambda down, across: max(0.0, float((_filtered(region, down, across) ** 2).mean()) - noise * (down**2).sum() * (across**2).sum())  # noqa: B023, E731
        first, second = (energy(level, slope), energy(slope, level)), (energy(smooth, bend), energy(bend, smooth))
        seen = sum(first) >= LEAST_ENERGY and min(first) >= LEAST_ENERGY / 4
        out.append(min(s / f for s, f in zip(second, first)) if seen else 0.0)
    return float(np.median(out))


def uniform_patterns() -> np.ndarray:
    """Bin of every 8-bit circular pattern: 58 bins for the patterns with at
    most two changes, in order of their value, and one for all others."""
    codes = np.arange(256)
    changes = sum(((codes >> i) ^ (codes >> ((i + 1) % 8))) & 1 for i in range(8))
    table = np.full(256, 58)
    table[changes <= 2] = np.arange((changes <= 2).sum())
    return table


def pattern_histograms(grey: np.ndarray, radius: int = 1, grid: int = 8) -> np.ndarray:
    """Local binary pattern histograms on a grid, each summing to one."""
    h, w = grey.shape
    centre = grey[radius : h - radius, radius : w - radius]
    code = np.zeros(centre.shape, int)
    for i, (dy, dx) in enumerate(((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))):
        y, x = radius + dy * radius, radius + dx * radius
        code |= (grey[y : y + centre.shape[0], x : x + centre.shape[1]] >= centre).astype(int) << i
    bins = uniform_patterns()[code]
    out = []
    for row in np.array_split(bins, grid, axis=0):
        for cell in np.array_split(row, grid, axis=1):
            n = np.bincount(cell.ravel(), minlength=59).astype(float)
            out.append(n / max(n.sum(), 1.0))
    return np.concatenate(out)


def similarity_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least-squares rotation, scale and shift (2 x 3) between point lists;
    fewer than two different points or values that are not finite are errors."""
    s, t = np.asarray(source, float), np.asarray(target, float)
    if s.shape != t.shape or s.ndim != 2 or s.shape[1] != 2 or len(s) < 2 or not (np.isfinite(s).all() and np.isfinite(t).all()):
        raise ValueError("two equal lists of finite points are needed")
    a, b = s - s.mean(0), t - t.mean(0)
    size = (a * a).sum()
    if size < 1e-12:
        raise ValueError("the points coincide")
    re, im = (a * b).sum() / size, (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum() / size
    turn = np.array([[re, -im], [im, re]])
    return np.column_stack([turn, t.mean(0) - turn @ s.mean(0)])


def measures(height: Column, width: Column, pixels: Column) -> Column:
    """Brightness, contrast, sharpness, focus and difference hash of a picture;
    null fields if its size doesn't fit."""

    @F.pandas_udf(MEASURES)
    def run(h: pd.Series, w: pd.Series, p: pd.Series) -> pd.DataFrame:
        rows = []
        for g in (_grey(*x) for x in zip(h, w, p)):
            rows.append((None,) * 5 if g is None else (g.mean(), g.std(), laplacian_variance(g), regional_focus(g), difference_hash(g)))
        out = pd.DataFrame(rows, columns=["brightness", "contrast", "sharpness", "focus", "dhash64"])
        return out.astype({"dhash64": "Int64"})

    return run(height, width, pixels)


def embedding_udf(embedder: Embedder):
    """A column function that gives the embedder's vector of each picture."""

    @F.pandas_udf("array<double>")
    def run(h: pd.Series, w: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for g in (_grey(*x) for x in zip(h, w, p)):
            v = None if g is None else np.asarray(embedder.extract(g), float)
            if v is not None and (v.shape != (embedder.dimension,) or not np.isfinite(v).all()):
                raise ValueError(f"{embedder.signature}: not a finite vector of {embedder.dimension} numbers")
            out.append(None if v is None else v.tolist())
        return pd.Series(out)

    return run
