"""Volumes as a relation of bricks, and linear resampling as joins: for volumes of any size.

A brick has its place (``b0, b1, b2``), its volume's sizes (``n0, n1, n2``) and its voxels in C order (``data``); all bricks but
a volume's last ones have ``edge`` voxels an axis.  Resampling goes axis by axis.  Along an axis each output brick is joined with the
source bricks that its places lie in, the neighbours that hold the halo included: as many as the scale says, two at least.  The
interpolation itself is array functions inside the output brick; a volume is never in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

EDGE = 32
AXES = (0, 1, 2)
_PLACE, _SIZE = ["b0", "b1", "b2"], ["n0", "n1", "n2"]


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def bricks_of_planes(planes: DataFrame, keys: list[str], edge: int = EDGE) -> DataFrame:
    """Bricks from rows of one plane each: ``keys, n0, n1, n2, z`` and ``data`` (n1 x n2 voxels, C order)."""
    tiles = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("n1") / edge).cast("int") * F.ceil(F.col("n2") / edge).cast("int") - 1),
        lambda i: let(
            F.struct(_div(i, 1).alias("i"), F.ceil(F.col("n2") / edge).cast("int").alias("wide")),
            lambda t: F.struct(F.floor(t["i"] / t["wide"]).cast("int").alias("b1"), (t["i"] % t["wide"]).alias("b2")),
        ),
    )
    rows = planes.where("n0 > 0 and n1 > 0 and n2 > 0").select("*", F.inline(tiles))
    high, wide = (F.least(F.lit(edge), F.col(f"n{k}") - F.col(f"b{k}") * edge) for k in (1, 2))
    lines = F.sequence(F.lit(0), high - 1)
    tile = F.flatten(F.transform(lines, lambda y: F.slice(F.col("data").cast("array<double>"), ((F.col("b1") * edge + y) * F.col("n2") + F.col("b2") * edge + 1).cast("int"), wide)))
    cut = rows.select(*keys, *_SIZE, _div(F.col("z"), edge).alias("b0"), "b1", "b2", F.struct("z", tile.alias("t")).alias("p"))
    whole = cut.groupBy(*keys, *_SIZE, *_PLACE).agg(F.sort_array(F.collect_list("p")).alias("p"))
    return whole.select(*keys, *_SIZE, *_PLACE, F.flatten(F.transform("p", lambda x: x["t"])).alias("data"))


def bricks_of_volumes(volumes: DataFrame, keys: list[str], shape: str = "shape", data: str = "data", edge: int = EDGE) -> DataFrame:
    """Bricks of volumes that have one row each."""
    n = {f"n{k}": F.col(shape)[k] for k in AXES}
    plane = F.col("n1") * F.col("n2")
    rows = volumes.where(F.col(data).isNotNull()).select(*keys, F.col(data).alias("data"), *[c.alias(k) for k, c in n.items()]).where("n0 > 0")
    z = rows.select(*keys, *_SIZE, F.explode(F.sequence(F.lit(0), F.col("n0") - 1)).alias("z"), "data")
    return bricks_of_planes(z.withColumn("data", F.slice("data", (F.col("z") * plane + 1).cast("int"), plane.cast("int"))), keys, edge)


def voxels(bricks: DataFrame, keys: list[str], edge: int = EDGE) -> DataFrame:
    """One row a voxel: ``keys, z, y, x, value``."""
    high, wide = (F.least(F.lit(edge), F.col(f"n{k}") - F.col(f"b{k}") * edge) for k in (1, 2))
    flat = bricks.select(*keys, *_PLACE, high.alias("__h"), wide.alias("__w"), F.posexplode("data").alias("__i", "value"))
    z, y, x = F.floor(F.col("__i") / (F.col("__h") * F.col("__w"))), F.floor(F.col("__i") / F.col("__w")) % F.col("__h"), F.col("__i") % F.col("__w")
    return flat.select(*keys, *[(F.col(f"b{k}") * edge + c).cast("int").alias(n) for k, c, n in zip(AXES, (z, y, x), "zyx", strict=True)], "value")


def cell_centred(n: Column, m: Column) -> Callable[[Column], Column]:
    """Both grids span the same cells."""
    return lambda j: (j + 0.5) * n / m - 0.5


def from_corner(spacing: Column | float, target: Column | float) -> Callable[[Column], Column]:
    """Output index j lies at j * target / spacing of the source."""
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (target, spacing))
    return lambda j: j * a / b


def resample_axis(bricks: DataFrame, keys: list[str], axis: int, size: Column, place: Callable[[Column], Column], fill: float | None = None, edge: int = EDGE) -> DataFrame:
    """Linear interpolation along one axis to ``size`` voxels; ``place`` gives an output index's source place, growing with it.

    Both may use the bricks' columns.  Places outside the source take the border's value, or ``fill``.
    """
    n, b = f"n{axis}", f"b{axis}"
    others = [c for c in _PLACE if c != b]
    last = F.col(n) - 1
    source = lambda j: F.least(F.greatest(place(j.cast("double")), F.lit(0.0)), last.cast("double"))
    extra = [c for c in bricks.columns if c not in {*keys, *_SIZE, *_PLACE, "data"}]
    lines = bricks.where(F.col(b) == 0).select(*keys, *_SIZE, *others, *extra, size.cast("int").alias("__m"))
    out = lines.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__m") / edge).cast("int") - 1)).alias("__o"))
    first, end = F.col("__o") * edge, F.least((F.col("__o") + 1) * edge, F.col("__m")) - 1
    low, high = F.floor(source(first)).cast("int"), F.least(F.floor(source(end)).cast("int") + 1, last)
    wanted = out.withColumn("__low", _div(low, edge)).withColumn("__s", F.explode(F.sequence(F.col("__low"), _div(high, edge))))
    parts = bricks.select(*keys, *others, F.col(b).alias("__s"), F.col("data").alias("__d"))
    joined = wanted.join(parts, [*keys, *others, "__s"])
    whole = joined.groupBy(*keys, *others, "__o").agg(*[F.first(c).alias(c) for c in (*_SIZE, *extra, "__m", "__low")], F.sort_array(F.collect_list(F.struct("__s", "__d"))).alias("__p"))

    def step(x: Column) -> Column:
        """Where source index ``x`` of the axis is: its part, its place in it, the part's width."""
        s = _div(x, edge)
        return F.struct((s - F.col("__low")).alias("part"), (x - s * edge).alias("at"), F.least(F.lit(edge), F.col(n) - s * edge).alias("width"))

    def reads(j: Column) -> Column:
        lo = let(F.struct(source(j).alias("p"), place(j.cast("double")).alias("raw")), lambda x: F.struct(x["p"].alias("p"), F.floor(x["p"]).cast("int").alias("lo"), ((x["raw"] < 0) | (x["raw"] > last)).alias("outside")))
        return let(lo, lambda x: F.struct(step(x["lo"]).alias("lo"), step(F.least(x["lo"] + 1, last)).alias("hi"), (x["p"] - x["lo"]).alias("w"), x["outside"].alias("outside")))

    steps = whole.withColumn("__j", F.transform(F.sequence(first, end), reads))
    dims = [F.least(F.lit(edge), F.col(f"n{k}") - F.col(f"b{k}") * edge) for k in AXES if k != axis]
    outer = reduce(lambda p, q: p * q, dims[:axis], F.lit(1))
    inner = reduce(lambda p, q: p * q, dims[axis:], F.lit(1))
    mix = lambda x, y, j: x * (F.lit(1.0) - j["w"]) + y * j["w"]

    def line(o: Column, j: Column) -> Column:
        """The ``inner`` voxels at output index ``j`` of outer line ``o``."""
        part = lambda r: F.get(F.col("__p"), r["part"])["__d"]
        start = lambda r: ((o * r["width"] + r["at"]) * F.col("__inner")).cast("int")
        if axis == 2:
            got = F.array(mix(F.get(part(j["lo"]), start(j["lo"])), F.get(part(j["hi"]), start(j["hi"])), j))
        else:
            ends = (F.slice(part(j[r]), start(j[r]) + 1, F.col("__inner").cast("int")) for r in ("lo", "hi"))
            got = F.zip_with(*ends, lambda x, y: mix(x, y, j))
        return got if fill is None else F.when(j["outside"], F.array_repeat(F.lit(float(fill)), F.col("__inner").cast("int"))).otherwise(got)

    data = F.flatten(F.transform(F.sequence(F.lit(0), F.col("__outer").cast("int") - 1), lambda o: F.flatten(F.transform("__j", lambda j: line(o, j)))))
    sized = steps.withColumns({"__outer": outer, "__inner": inner})
    sizes = [F.col("__m").alias(c) if c == n else F.col(c) for c in _SIZE]
    places = [F.col("__o").alias(c) if c == b else F.col(c) for c in _PLACE]
    return sized.select(*keys, *sizes, *places, *extra, data.alias("data"))


def resample_grid(bricks: DataFrame, keys: list[str], shape: tuple[int | Column | None, ...], edge: int = EDGE) -> DataFrame:
    """To a fixed grid that spans the same cells; None leaves an axis as it is."""
    for axis, m in enumerate(shape):
        if m is not None:
            m = m if isinstance(m, Column) else F.lit(m)
            bricks = resample_axis(bricks, keys, axis, m, cell_centred(F.col(f"n{axis}"), m), edge=edge)
    return bricks


def spaced_size(axis: int, spacing: float | Column, target: float | Column, rounding: str = "round") -> Column:
    """n * spacing / target, rounded half to even or truncated; one at least."""
    f = F.rint if rounding == "round" else F.floor
    s, t = (x if isinstance(x, Column) else F.lit(float(x)) for x in (spacing, target))
    return F.greatest(F.lit(1), f(F.col(f"n{axis}") * s / t).cast("int"))


def resample_spacing(bricks: DataFrame, keys: list[str], spacing: tuple, target: tuple, fill: float | None = None, edge: int = EDGE) -> DataFrame:
    """To a target voxel distance: output index j lies at j * target / spacing."""
    for axis, (s, t) in enumerate(zip(spacing, target, strict=True)):
        bricks = resample_axis(bricks, keys, axis, spaced_size(axis, s, t), from_corner(s, t), fill, edge)
    return bricks


def resample_truncated(bricks: DataFrame, keys: list[str], spacing: tuple, target: tuple, edge: int = EDGE) -> DataFrame:
    """Cell-centred interpolation to the truncated size n * spacing / target."""
    for axis, (s, t) in enumerate(zip(spacing, target, strict=True)):
        m = spaced_size(axis, s, t, "truncate")
        bricks = resample_axis(bricks, keys, axis, m, cell_centred(F.col(f"n{axis}"), m), edge=edge)
    return bricks


def resize_images(images: DataFrame, keys: list[str], size: int, longest: bool = False, edge: int = EDGE) -> DataFrame:
    """Images as volumes of (height, width, channel): to ``size`` x ``size``, or to that longest side."""
    if not longest:
        return resample_grid(images, keys, (size, size, None), edge)
    side = F.greatest("n0", "n1")
    sized = images.withColumns({f"__m{k}": F.greatest(F.lit(1), F.rint(F.col(f"n{k}") * size / side).cast("int")) for k in (0, 1)})
    out = resample_grid(sized, keys, (F.col("__m0"), F.col("__m1"), None), edge)
    return out.drop("__m0", "__m1")
