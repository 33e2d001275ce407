"""Column functions over flattened (C-order) volumes: clipping, rescaling, windows, axis and border operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(a: str | Column) -> Column:
    return _c(a).cast("array<double>")


def clip(a: str | Column, lo: float, hi: float) -> Column:
    return F.transform(as_double(a), lambda x: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def rescale(a: str | Column, lo: float, hi: float, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Clip to [lo, hi] and map that range linearly onto ``to``."""
    span = float(hi - lo)
    return F.transform(clip(a, lo, hi), lambda x: (x - F.lit(float(lo))) / span * F.lit(float(to[1] - to[0])) + F.lit(float(to[0])))


def minmax(a: str | Column, least: float = 1e-6) -> Column:
    """Onto [0, 1] by the array's own range; zeros if the range is under ``least``."""
    return let(as_double(a), lambda v: let(F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi")), lambda r: F.transform(v, lambda x: F.when(r["hi"] - r["lo"] < least, F.lit(0.0)).otherwise((x - r["lo"]) / (r["hi"] - r["lo"])))))


def window_u8(a: str | Column, lo: float, hi: float) -> Column:
    """A display window as 0 .. 255, rounded half to even."""
    return F.transform(rescale(a, lo, hi, (0.0, 255.0)), lambda x: F.rint(x).cast("int"))


def rgb_windows(a: str | Column, bands: list[tuple[float, float]]) -> Column:
    """Per voxel one value for each of three windows."""
    red, green, blue = (window_u8(a, *b) for b in bands)
    return F.zip_with(F.zip_with(red, green, lambda x, y: F.array(x, y)), blue, lambda xy, z: F.concat(xy, F.array(z)))


Size = int | Column


def _n(x: Size) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def _product(sizes: Sequence[Size]) -> Size:
    return reduce(lambda p, q: p * q, sizes, 1)


class Axis(NamedTuple):
    """Where an output axis of ``size`` reads: output ``low <= c < high`` reads ``first + (c - low) * step`` of its source axis."""

    size: Size
    source: int
    low: Size = 0
    high: Size | None = None
    first: Size = 0
    step: Size = 1


def view(a: str | Column, shape: Sequence[Size], axes: Sequence[Axis], fill: float = 0.0) -> Column:
    """A strided view of a flattened volume: places are computed from output index, strides and offsets.

    The plan has one expression an axis, whatever the shape; sizes may be columns, so that rows differ in shape.  An output
    line that is contiguous in the source is one slice, others take each element from its computed place.  Places outside the source are
    ``fill``.
    """
    stride = [_product(shape[i + 1 :]) for i in range(len(shape))]
    *outer, inner = axes
    high = lambda x: x.size if x.high is None else x.high
    run = _n(inner.step * stride[inner.source])
    size = F.greatest(_n(high(inner)) - _n(inner.low), F.lit(0))
    before = _n(inner.low) if not isinstance(inner.low, int) or inner.low else None
    behind = None if inner.high is None else _n(inner.size) - _n(inner.high)
    contiguous = isinstance(inner.step, int) and inner.step == 1 and inner.source == len(shape) - 1

    def place(r: Column) -> tuple[Column, Column | None]:
        """Source place of the first element of output line ``r``, and whether the line lies inside the source at all."""
        at, inside, below = _n(inner.first) * _n(stride[inner.source]), None, 1
        for x in reversed(outer):
            c = F.call_function("div", r, _n(below)).cast("int") % _n(x.size) if not (isinstance(below, int) and below == 1) else r % _n(x.size)
            at = at + (_n(x.first) + (c - _n(x.low)) * _n(x.step)) * _n(stride[x.source])
            if x.high is not None or not (isinstance(x.low, int) and x.low == 0):
                here = (c >= _n(x.low)) & (c < _n(high(x)))
                inside = here if inside is None else inside & here
            below = below * x.size
        return at, inside

    def gathered(v: Column) -> Column:
        blank = F.lit(float(fill)).cast("double")

        def line(r: Column) -> Column:
            at, inside = place(r)
            if contiguous:
                body = F.slice(v, at + 1, size)
            else:
                body = F.when(size > 0, let(at, lambda s: F.transform(F.sequence(s, s + (size - 1) * run, run), lambda i: F.get(v, i)))).otherwise(F.slice(v, 1, 0))
            parts = [body]
            if before is not None:
                parts.insert(0, F.array_repeat(blank, before))
            if behind is not None:
                parts.append(F.array_repeat(blank, behind))
            whole = F.concat(*parts) if len(parts) > 1 else body
            return whole if inside is None else F.when(inside, whole).otherwise(F.array_repeat(blank, _n(inner.size)))

        lines = _n(_product([x.size for x in outer]))
        every = F.when(lines > 0, F.sequence(F.lit(0), F.greatest(lines, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(every, line))

    return let(as_double(a), gathered)


def transpose(a: str | Column, shape: Sequence[Size], axes: Sequence[int], flip: Sequence[bool | Column] | None = None) -> Column:
    """The volume with output axis k reading source axis ``axes[k]``, backwards where ``flip[k]`` says so."""
    out = []
    for k, ax in enumerate(axes):
        f = flip[k] if flip else False
        back = _n(shape[ax]) - 1
        if isinstance(f, Column):
            out.append(Axis(shape[ax], ax, first=F.when(f, back).otherwise(0), step=F.when(f, -1).otherwise(1)))
        else:
            out.append(Axis(shape[ax], ax, first=back, step=-1) if f else Axis(shape[ax], ax))
    return view(a, shape, out)


def _centred(n: Size, target: Size, source: int) -> Axis:
    """Padding and cropping put the smaller half before; along one axis only one of them is done, so their order does not matter."""
    if isinstance(n, int) and isinstance(target, int):
        missing, extra = max(0, target - n), max(0, n - target)
        low, first = missing // 2, extra // 2
        return Axis(target, source, low, low + min(n, target) if missing else None, first)
    missing, extra = F.greatest(_n(target) - _n(n), F.lit(0)), F.greatest(_n(n) - _n(target), F.lit(0))
    low, first = F.floor(missing / 2).cast("int"), F.floor(extra / 2).cast("int")
    return Axis(target, source, low, low + F.least(_n(n), _n(target)), first)


def pad_crop(a: str | Column, shape: Sequence[Size], target: Sequence[Size], fill: float = 0.0) -> Column:
    """Centred padding, then cropping, to ``target``."""
    return view(a, shape, [_centred(n, t, k) for k, (n, t) in enumerate(zip(shape, target, strict=True))], fill)


def crop_pad(a: str | Column, shape: Sequence[Size], target: Sequence[Size], fill: float = -1.0) -> Column:
    """Centred cropping, then padding, to ``target``."""
    return pad_crop(a, shape, target, fill)


def orientation(affine: str | Column) -> Column:
    """``(axes, flips)`` of a volume's affine rows (3 x 4, flattened): the voxel axis of each world axis, and whether it runs backwards.

    Greedy: the world axis with the largest component chooses first, the voxel axis with its largest component among those that are free.
    Of equal components the first counts.
    """
    rows = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda w: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(as_double(affine), w * 4 + k)))

    def assigned(m: Column) -> Column:
        size = lambda w, k: F.abs(F.get(F.get(m, w), k))
        worlds = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda w: F.struct((-F.array_max(F.transform(F.get(m, w), F.abs))).alias("s"), w.alias("w")))), lambda x: x["w"])

        def choose(done: Column, w: Column) -> Column:
            free = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: ~F.exists(done, lambda d: d["k"] == k))
            best = F.element_at(F.array_sort(F.transform(free, lambda k: F.struct((-size(w, k)).alias("s"), k.alias("k")))), 1)["k"]
            return F.concat(done, F.array(F.struct(w.alias("w"), best.alias("k"), (F.get(F.get(m, w), best) < 0).alias("back"))))

        none = F.array().cast("array<struct<w:int,k:int,back:boolean>>")
        in_order = F.array_sort(F.aggregate(worlds, none, choose))
        return F.struct(F.transform(in_order, lambda x: x["k"]).alias("axes"), F.transform(in_order, lambda x: F.coalesce(x["back"], F.lit(False))).alias("flips"))

    return let(rows, assigned)


def reorient(a: str | Column, shape: Sequence[Size], affine: str | Column) -> Column:
    """A (x, y, z) volume with its axes permuted and flipped towards right, anterior, superior, as the affine says.

    Each of the six orders is one view; a row evaluates its own.
    """
    def towards(o: Column) -> Column:
        out = None
        for axes in permutations(range(3)):
            flips = [F.get(o["flips"], k) for k in range(3)]
            this = F.concat_ws(",", o["axes"].cast("array<string>")) == ",".join(map(str, axes))
            value = transpose(a, shape, axes, flips)
            out = F.when(this, value) if out is None else out.when(this, value)
        return out

    return let(orientation(affine), towards)


def replicate_channels(a: str | Column, n: int = 3) -> Column:
    """The volume n times along a new leading axis."""
    return F.flatten(F.array_repeat(as_double(a), n))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays, in double; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(as_double(x), as_double(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
