"""Volume operators that interpolate or reorder: one volume at a time in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import VOLUME


def _axis(n: int, m: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.clip(place, 0, n - 1)
    lo = np.floor(p).astype(int)
    hi = np.minimum(lo + 1, n - 1)
    return lo, hi, p - lo


def interpolate(v: np.ndarray, shape: tuple[int, ...], places: list[np.ndarray] | None = None, fill: float | None = None) -> np.ndarray:
    """Linear interpolation, one axis after another.

    ``places`` gives each output index's source place (default: cell centres, so that both grids cover the same span);
    places outside the source take the border value, or ``fill`` if given.
    """
    out = v.astype(np.float64)
    for ax, m in enumerate(shape):
        n = out.shape[ax]
        p = places[ax] if places is not None else (np.arange(m) + 0.5) * n / m - 0.5
        lo, hi, w = _axis(n, m, p)
        w = w.reshape([-1 if i == ax else 1 for i in range(out.ndim)])
        out = np.take(out, lo, ax) * (1 - w) + np.take(out, hi, ax) * w
        if fill is not None:
            outside = (p < 0) | (p > n - 1)
            out[tuple(outside if i == ax else slice(None) for i in range(out.ndim))] = fill
    return out.astype(np.float32)


def spacing_shape(shape: tuple[int, ...], spacing: tuple[float, ...], target: tuple[float, ...], rounding: str = "round") -> tuple[int, ...]:
    """Size n * s / t of each axis, rounded half to even or truncated; one at least."""
    f = round if rounding == "round" else int
    return tuple(max(1, f(n * s / t)) for n, s, t in zip(shape, spacing, target, strict=True))


def resample_spacing(v: np.ndarray, spacing: tuple[float, ...], target: tuple[float, ...], fill: float | None = None) -> np.ndarray:
    """To a target voxel distance: output index i lies at i * t / s of the source."""
    shape = spacing_shape(v.shape, spacing, target)
    places = [np.arange(m) * t / s for m, t, s in zip(shape, target, spacing, strict=True)]
    return interpolate(v, shape, places, fill)


def resample_grid(v: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """To a fixed grid that spans the same cells."""
    return interpolate(v, shape)


def resample_truncated(v: np.ndarray, spacing: tuple[float, ...], target: tuple[float, ...]) -> np.ndarray:
    """Cell-centred interpolation to the truncated size n * s / t."""
    return interpolate(v, spacing_shape(v.shape, spacing, target, "truncate"))


def reorient_ras(v: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A (x, y, z) volume with its axes permuted and flipped towards right, anterior, superior; and the permuted affine rows."""
    a = np.asarray(affine, float).reshape(3, 4)[:, :3]
    order, free = [0, 0, 0], [0, 1, 2]
    for world in np.argsort(-np.abs(a).max(axis=1)):
        src = max(free, key=lambda k: abs(a[world, k]))
        order[world] = src
        free.remove(src)
    out = v.transpose(order)
    b = a[:, order]
    for ax in range(3):
        if b[ax, ax] < 0:
            out = np.flip(out, ax)
            b[:, ax] = -b[:, ax]
    return out, b


def resize_bilinear(img: np.ndarray, size: int, longest: bool = False, pad: bool = False) -> np.ndarray:
    """A (h, w, c) image to size x size, or to that longest side, with centred zero padding to a square on demand."""
    h, w = img.shape[:2]
    nh, nw = (max(1, round(h * size / max(h, w))), max(1, round(w * size / max(h, w)))) if longest else (size, size)
    out = interpolate(img, (nh, nw))
    if longest and pad:
        full = np.zeros((size, size, *img.shape[2:]), np.float32)
        y, x = (size - nh) // 2, (size - nw) // 2
        full[y : y + nh, x : x + nw] = out
        out = full
    return np.rint(out).clip(0, 255).astype(np.uint8) if img.dtype == np.uint8 else out


def foreground_box(v: np.ndarray, threshold: float) -> tuple[slice, ...]:
    """The smallest box that holds all voxels above the threshold; everything if there is none."""
    where = np.argwhere(v > threshold)
    if not len(where):
        return tuple(slice(0, n) for n in v.shape)
    return tuple(slice(a, b + 1) for a, b in zip(where.min(0), where.max(0), strict=True))


def map_volumes(volumes: DataFrame, work) -> DataFrame:
    """``work(array, spacing, affine) -> array`` or ``(array, spacing)`` on each volume; nulls stay null.

    Rows go through one by one, so memory holds one volume a task beside the Arrow batch.
    """

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                if r.data is None:
                    yield pd.DataFrame([r._asdict()])
                    continue
                v = np.asarray(r.data, np.float32).reshape(tuple(r.shape))
                got = work(v, None if r.spacing is None else tuple(r.spacing), None if r.affine is None else np.asarray(r.affine))
                out, spacing = got if isinstance(got, tuple) else (got, r.spacing)
                yield pd.DataFrame({"case_id": [r.case_id], "shape": [list(out.shape)], "spacing": [spacing], "affine": [r.affine], "data": [np.ascontiguousarray(out, np.float32).reshape(-1)]})

    return volumes.select(*VOLUME.names).mapInPandas(run, VOLUME)


def foreground_bounds(voxels: DataFrame, keys: list[str], threshold: float, value: str = "value") -> DataFrame:
    """Bounding box of the voxel rows (z, y, x, value) above the threshold."""
    return voxels.where(F.col(value) > threshold).groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in ("z", "y", "x") for n, f in (("min", F.min), ("max", F.max))])


def voxel_rows(volumes: DataFrame, keys: list[str], data: str, shape: tuple[int, int, int]) -> DataFrame:
    """One row a voxel with its coordinates."""
    plane, line = shape[1] * shape[2], shape[2]
    flat = volumes.select(*keys, F.posexplode(data).alias("i", "value"))
    div = lambda a, b: F.floor(a / b).cast("int")
    return flat.select(*keys, div(F.col("i"), plane).alias("z"), div(F.col("i") % plane, line).alias("y"), (F.col("i") % line).cast("int").alias("x"), F.col("value").cast("double").alias("value"))
