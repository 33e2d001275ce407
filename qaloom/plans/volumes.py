"""Array and volume operators over 4 x 4 x 4 arrays, and slice sampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays, sampling
from ..functions.jpeg import jpeg
from ..operators import bricks, volume
from ..session import table
from . import _data as D
from .registry import query

SHAPE = (4, 4, 4)
_V = "CAST(embedding AS DOUBLE[])"


def _vol(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def _digest(column, name: str = "digest"):
    """A text of rounded values, so that arrays compare as one value."""
    return F.array_join(F.transform(column, lambda x: F.rint(x * 1e6).cast("long").cast("string")), ",").alias(name)


def _sql(expr: str, extra: str = "") -> str:
    return f"SELECT vec_id, array_to_string(list_transform({expr}, lambda y: CAST(round_even(y * 1e6, 0) AS BIGINT)), ',') AS digest FROM embeddings {extra}"


_CLIP = f"list_transform({_V}, lambda x: greatest(-0.1::DOUBLE, least(0.1::DOUBLE, x)))"
_SCALE = f"list_transform({_CLIP}, lambda x: (x + 0.1::DOUBLE) / 0.2::DOUBLE * {{0}}::DOUBLE + {{1}}::DOUBLE)"


@query("volume_clip", _sql(_CLIP))
def volume_clip(spark, sf):
    return _vol(spark, sf).select("vec_id", _digest(arrays.clip("embedding", -0.1, 0.1)))


@query("volume_rescale", _sql(_SCALE.format("2.0", "-1.0")))
def volume_rescale(spark, sf):
    return _vol(spark, sf).select("vec_id", _digest(arrays.rescale("embedding", -0.1, 0.1, (-1.0, 1.0))))


@query("volume_minmax", _sql(f"CASE WHEN list_max({_V}) - list_min({_V}) < 1e-6 THEN list_transform({_V}, lambda x: 0.0::DOUBLE) ELSE list_transform({_V}, lambda x: (x - list_min({_V})) / (list_max({_V}) - list_min({_V}))) END"))
def volume_minmax(spark, sf):
    return _vol(spark, sf).select("vec_id", _digest(arrays.minmax("embedding")))


@query("volume_window_u8", f"SELECT vec_id, array_to_string(list_transform({_SCALE.format('255.0', '0.0')}, lambda y: CAST(round_even(y, 0) AS BIGINT)), ',') AS digest FROM embeddings")
def volume_window_u8(spark, sf):
    return _vol(spark, sf).select("vec_id", F.array_join(F.transform(arrays.window_u8("embedding", -0.1, 0.1), lambda x: x.cast("string")), ",").alias("digest"))


@query("volume_rgb", f"""SELECT vec_id, i::INT AS i, r::INT AS r, g::INT AS g, b::INT AS b FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(list_transform({_SCALE.format('255.0', '0.0')}, lambda y: round_even(y, 0))) AS r,
 unnest(list_transform({_V}, lambda x: round_even((greatest(0.0::DOUBLE, least(0.2::DOUBLE, x)) - 0.0::DOUBLE) / 0.2::DOUBLE * 255.0::DOUBLE + 0.0::DOUBLE, 0))) AS g, unnest(list_transform({_V}, lambda x: round_even((greatest(-0.05::DOUBLE, least(0.05::DOUBLE, x)) - -0.05::DOUBLE) / 0.1::DOUBLE * 255.0::DOUBLE + 0.0::DOUBLE, 0))) AS b FROM embeddings)""")
def volume_rgb(spark, sf):
    rgb = arrays.rgb_windows("embedding", [(-0.1, 0.1), (0.0, 0.2), (-0.05, 0.05)])
    flat = _vol(spark, sf).select("vec_id", F.posexplode(rgb).alias("i", "c"))
    return flat.select("vec_id", "i", F.col("c")[0].alias("r"), F.col("c")[1].alias("g"), F.col("c")[2].alias("b"))


@query("volume_transpose", _sql(f"list_transform(range(0, 64), lambda i: {_V}[1 + (i % 4) * 16 + ((i // 4) % 4) * 4 + i // 16])"))
def volume_transpose(spark, sf):
    return _vol(spark, sf).select("vec_id", _digest(arrays.transpose("embedding", SHAPE, (2, 1, 0))))


@query("volume_pad_crop", _sql(f"list_transform(range(0, 60), lambda i: CASE WHEN i // 10 < 1 OR i // 10 > 4 OR i % 5 > 3 THEN 0.0::DOUBLE ELSE {_V}[1 + (i // 10 - 1) * 16 + ((i // 5) % 2 + 1) * 4 + i % 5] END)"))
def volume_pad_crop(spark, sf):
    return _vol(spark, sf).select("vec_id", _digest(arrays.pad_crop("embedding", SHAPE, (6, 2, 5))))


@query("volume_crop_pad", _sql(f"list_transform(range(0, 60), lambda i: CASE WHEN i // 10 < 1 OR i // 10 > 4 OR i % 5 > 3 THEN -1.0::DOUBLE ELSE {_V}[1 + (i // 10 - 1) * 16 + ((i // 5) % 2 + 1) * 4 + i % 5] END)"))
def volume_crop_pad(spark, sf):
    return _vol(spark, sf).select("vec_id", _digest(arrays.crop_pad("embedding", SHAPE, (6, 2, 5))))


@query("volume_channels", "SELECT vec_id, 192::INT AS n, round(list_sum(CAST(embedding AS DOUBLE[])) * 3, 6) AS total FROM embeddings")
def volume_channels(spark, sf):
    c = arrays.replicate_channels("embedding", 3)
    return _vol(spark, sf).select("vec_id", F.size(c).alias("n"), F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("foreground_bbox", f"""SELECT vec_id, min(i // 16)::INT AS z_min, max(i // 16)::INT AS z_max, min((i // 4) % 4)::INT AS y_min, max((i // 4) % 4)::INT AS y_max, min(i % 4)::INT AS x_min, max(i % 4)::INT AS x_max
 FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest({_V}) AS v FROM embeddings) WHERE v > 0.2 GROUP BY vec_id""")
def foreground_bbox(spark, sf):
    return volume.foreground_bounds(volume.voxel_rows(_vol(spark, sf), ["vec_id"], "embedding", SHAPE), ["vec_id"], 0.2)


_LIN = "list_transform(range(0, 8), lambda i: CAST(round_even(i * ((n_chars % 40) - 1)::DOUBLE / 7, 0) AS INT))"


@query("slice_sample", f"SELECT doc_id, array_to_string(CASE WHEN n_chars % 40 = 0 THEN []::INT[] WHEN n_chars % 40 <= 8 THEN list_transform(range(0, n_chars % 40), lambda x: x::INT) ELSE {_LIN} END, ',') AS slices FROM documents")
def slice_sample(spark, sf):
    return D.documents(spark, sf).select("doc_id", F.array_join(sampling.uniform_indices((F.col("n_chars") % 40).cast("int"), 8).cast("array<string>"), ",").alias("slices"))


@query("slice_downsample", "SELECT doc_id, CASE WHEN n_chars % 40 = 0 THEN '' ELSE CAST((n_chars % 40) // 2 AS VARCHAR) END AS middle FROM documents")
def slice_downsample(spark, sf):
    n = (F.col("n_chars") % 40).cast("int")
    items = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    return D.documents(spark, sf).select("doc_id", F.array_join(sampling.downsample(items, 1).cast("array<string>"), ",").alias("middle"))


@query("middle_slice", "SELECT doc_id, (n_chars // 2)::INT AS middle FROM documents")
def middle_slice(spark, sf):
    return D.documents(spark, sf).select("doc_id", sampling.middle_index("n_chars").alias("middle"))


@query("slice_fit", """WITH RECURSIVE s AS (SELECT doc_id, CAST(n_chars % 90 AS INT) AS n, n_chars % 500 AS t FROM documents
 UNION ALL SELECT doc_id, greatest(least(CAST(floor(n * 0.8::DOUBLE) AS INT), n - 1), 1), t FROM s WHERE n * 260 + t > 8000 AND n > 1) SELECT doc_id, min(n) AS slices FROM s GROUP BY doc_id""")
def slice_fit(spark, sf):
    return D.documents(spark, sf).select("doc_id", sampling.fit_slices((F.col("n_chars") % 90).cast("int"), 260, F.col("n_chars") % 500, 8000).alias("slices"))


#: Volumes of 500 vectors: a vector is a plane of 8 x 8 voxels.
_STACK = """(SELECT vec_id // 500 AS case_id, row_number() OVER (PARTITION BY vec_id // 500 ORDER BY vec_id) - 1 AS z, count(*) OVER (PARTITION BY vec_id // 500) AS n, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""


def _planes(spark, sf):
    v = _vol(spark, sf).withColumn("case_id", F.floor(F.col("vec_id") / 500))
    n = v.groupBy("case_id").agg(F.count("*").cast("int").alias("n0"))
    z = (F.row_number().over(W.partitionBy("case_id").orderBy("vec_id")) - 1).alias("z")  # 500 rows a case
    return v.select("case_id", z, F.col("embedding").alias("data")).join(n, "case_id").withColumns({"n1": F.lit(8), "n2": F.lit(8)})


def _stacks(spark, sf):
    """Each volume whole: shape and voxels in one row."""
    lists = _planes(spark, sf).groupBy("case_id").agg(F.first("n0").alias("n0"), F.sort_array(F.collect_list(F.struct("z", "data"))).alias("p"))
    return lists.select("case_id", F.array("n0", F.lit(8), F.lit(8)).alias("shape"), F.flatten(F.transform("p", lambda x: x["data"].cast("array<double>"))).alias("data"))


def _weighed(a):
    """A sum in which each place has a weight of its own, as doubles."""
    return F.aggregate(F.transform(a, lambda x, i: x * (i % 97 + 1)), F.lit(0.0), lambda s, x: s + x)


@query("volume_stack_box", f"""SELECT case_id, 18000 AS n, round(sum(CASE WHEN zz BETWEEN 0 AND 299 AND y BETWEEN 1 AND 6 THEN x * (((zz * 6 + y - 1) * 10 + xx + 1) % 97 + 1) END) + sum(DISTINCT blank), 5) AS total
 FROM (SELECT case_id, e[i + 1] AS x, z + CASE WHEN n < 300 THEN (300 - n) // 2 ELSE -((n - 300) // 2) END AS zz, i // 8 AS y, i % 8 AS xx, 0 AS blank FROM {_STACK}, range(0, 64) r(i)) GROUP BY case_id""")
def volume_stack_box(spark, sf):
    s = _stacks(spark, sf).withColumn("v", arrays.pad_crop("data", [F.col("shape")[k] for k in range(3)], (300, 6, 10)))
    return s.select("case_id", F.size("v").alias("n"), F.round(_weighed(F.col("v")), 5).alias("total"))


@query("volume_stack_transpose", f"""SELECT case_id, round(sum(e[i + 1] * (((i % 8) * n + (n - 1 - z)) * 8 + i // 8) % 97 + e[i + 1]), 5) AS total FROM {_STACK}, range(0, 64) r(i) GROUP BY case_id""".replace("(((i % 8) * n + (n - 1 - z)) * 8 + i // 8) % 97", "((((i % 8) * n + (n - 1 - z)) * 8 + i // 8) % 97)"))
def volume_stack_transpose(spark, sf):
    s = _stacks(spark, sf).withColumn("v", arrays.transpose("data", [F.col("shape")[k] for k in range(3)], (2, 0, 1), (False, True, False)))
    return s.select("case_id", F.round(_weighed(F.col("v")), 5).alias("total"))


_CHOICE = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT vec_id, w, k, e[w * 4 + k + 1] AS a FROM e, range(0, 3) x(w), range(0, 3) y(k)),
 o AS (SELECT vec_id, w, row_number() OVER (PARTITION BY vec_id ORDER BY max(abs(a)) DESC, w) AS r FROM c GROUP BY vec_id, w),
 one AS (SELECT vec_id, arg_max({w: w, k: k, a: a}, abs(a)) AS x FROM c JOIN o USING (vec_id, w) WHERE r = 1 GROUP BY vec_id),
 two AS (SELECT vec_id, arg_max({w: c.w, k: c.k, a: c.a}, abs(c.a)) AS x FROM c JOIN o USING (vec_id, w) JOIN one USING (vec_id) WHERE r = 2 AND c.k <> one.x.k GROUP BY vec_id),
 three AS (SELECT vec_id, arg_max({w: c.w, k: c.k, a: c.a}, abs(c.a)) AS x FROM c JOIN o USING (vec_id, w) JOIN one USING (vec_id) JOIN two USING (vec_id) WHERE r = 3 AND c.k <> one.x.k AND c.k <> two.x.k GROUP BY vec_id),
 axes AS (SELECT vec_id, list(x.k ORDER BY x.w) AS ax, list(x.a < 0 ORDER BY x.w) AS back FROM (FROM one UNION ALL FROM two UNION ALL FROM three) GROUP BY vec_id)"""


@query("volume_reorient", f"""{_CHOICE}, p AS (SELECT vec_id, ax, back, i, [i // 16, (i // 4) % 4, i % 4] AS o FROM axes, range(0, 64) r(i)),
 q AS (SELECT vec_id, ax, back, i, list_transform(range(0, 3), lambda w: CASE WHEN back[w + 1] THEN 3 - o[w + 1] ELSE o[w + 1] END * (4 ** (2 - ax[w + 1]))::INT) AS s FROM p)
 SELECT vec_id, array_to_string(any_value(ax), ',') AS axes, array_to_string(list_transform(any_value(back), lambda b: CASE WHEN b THEN '-' ELSE '+' END), '') AS signs, round(sum(e[1 + s[1] + s[2] + s[3]] * (i % 97 + 1)), 5) AS total FROM q JOIN e USING (vec_id) GROUP BY vec_id""")
def volume_reorient(spark, sf):
    v = _vol(spark, sf).withColumn("o", arrays.orientation("embedding"))
    signs = F.array_join(F.transform(F.col("o.flips"), lambda b: F.when(b, "-").otherwise("+")), "")
    return v.select("vec_id", F.array_join(F.col("o.axes").cast("array<string>"), ",").alias("axes"), signs.alias("signs"), F.round(_weighed(arrays.reorient("embedding", SHAPE, "embedding")), 5).alias("total"))


def _linear(name: str, source: str, axis: str, keys: str, n: str, m: str, place: str) -> str:
    """SQL of one axis: ``source`` has keys, the axis and a value v."""
    rest = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name}_at AS (SELECT *, floor(p) AS lo, least(floor(p) + 1, size - 1) AS hi, p - floor(p) AS w FROM (SELECT case_id, size, j, greatest(0.0, least(size - 1.0, {place})) AS p FROM (SELECT case_id, {n} AS size, unnest(range(0, {m})) AS j FROM cases))),
 {name} AS (SELECT {rest}, j AS {axis}, a.v * (1 - w) + b.v * w AS v FROM {name}_at t JOIN {source} a ON a.case_id = t.case_id AND a.{axis} = lo JOIN {source} b ON b.case_id = t.case_id AND b.{axis} = hi AND {" AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))})"""


_VOXELS = f"WITH cases AS (SELECT case_id, max(n) AS n FROM {_STACK} GROUP BY case_id), v0 AS (SELECT case_id, z, i // 8 AS y, i % 8 AS x, e[i + 1] AS v FROM {_STACK}, range(0, 64) r(i))"
_CENTRED = "(j + 0.5::DOUBLE) * size / {m} - 0.5::DOUBLE"


@query("brick_resample_grid", f"""{_VOXELS}, {_linear("v1", "v0", "z", "case_id, y, x", "n", "70", _CENTRED.format(m="70"))}, {_linear("v2", "v1", "y", "case_id, z, x", "8", "5", _CENTRED.format(m="5"))}, {_linear("v3", "v2", "x", "case_id, z, y", "8", "11", _CENTRED.format(m="11"))}
 SELECT case_id, z::INT AS z, count(*) AS n, round(sum(v * (y * 11 + x + 1)), 5) AS total FROM v3 GROUP BY case_id, z""")
def brick_resample_grid(spark, sf):
    b = bricks.bricks_of_planes(_planes(spark, sf), ["case_id"], edge=4)
    out = bricks.voxels(bricks.resample_grid(b, ["case_id"], (70, 5, 11), edge=4), ["case_id"], edge=4)
    return out.groupBy("case_id", "z").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * (F.col("y") * 11 + F.col("x") + 1)), 5).alias("total"))


@query("brick_resample_spacing", f"""{_VOXELS}, {_linear("v1", "v0", "z", "case_id, y, x", "n", "greatest(1, round_even(n * 3.0::DOUBLE / 1.25, 0)::INT)", "j * 1.25::DOUBLE / 3.0")}, {_linear("v2", "v1", "y", "case_id, z, x", "8", "13", "j * 0.6::DOUBLE / 1.0")}, {_linear("v3", "v2", "x", "case_id, z, y", "8", "4", "j * 2.0::DOUBLE / 1.0")}
 SELECT case_id, z::INT AS z, count(*) AS n, round(sum(v * (y * 4 + x + 1)), 5) AS total FROM v3 GROUP BY case_id, z""")
def brick_resample_spacing(spark, sf):
    b = bricks.bricks_of_planes(_planes(spark, sf), ["case_id"], edge=4)
    out = bricks.voxels(bricks.resample_spacing(b, ["case_id"], (3.0, 1.0, 1.0), (1.25, 0.6, 2.0), edge=4), ["case_id"], edge=4)
    return out.groupBy("case_id", "z").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * (F.col("y") * 4 + F.col("x") + 1)), 5).alias("total"))


#: Images of 8 lines and as many columns as a volume has vectors, with one channel, brought to a longest side of 60.
_SIDES = "greatest(1, round_even(8 * 60.0::DOUBLE / n, 0)::INT)"


@query("brick_image_longest", f"""WITH cases AS (SELECT case_id, max(n) AS n FROM {_STACK} GROUP BY case_id), v0 AS (SELECT case_id, z AS x, i AS y, 0 AS c, e[i + 1] AS v FROM {_STACK}, range(0, 8) r(i)),
 {_linear("v1", "v0", "y", "case_id, x, c", "8", _SIDES, "(j + 0.5::DOUBLE) * size / " + _SIDES.replace("n,", "n,") + " - 0.5::DOUBLE").replace("SELECT case_id, 8 AS size", "SELECT case_id, n, 8 AS size")},
 {_linear("v2", "v1", "x", "case_id, y, c", "n", "60", _CENTRED.format(m="60"))} SELECT case_id, y::INT AS y, count(*) AS n, round(sum(v * (x + 1)), 5) AS total FROM v2 GROUP BY case_id, y""")
def brick_image_longest(spark, sf):
    wide = _planes(spark, sf).groupBy("case_id").agg(F.first("n0").alias("n"), F.sort_array(F.collect_list(F.struct("z", "data"))).alias("p"))
    lines = wide.select("case_id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform("p", lambda x: F.get(x["data"], y).cast("double")))).alias("z", "data"))
    b = bricks.bricks_of_planes(lines.select("case_id", F.lit(8).alias("n0"), F.col("n").alias("n1"), F.lit(1).alias("n2"), "z", "data"), ["case_id"], edge=4)
    out = bricks.voxels(bricks.resize_images(b, ["case_id"], 60, longest=True, edge=4), ["case_id"], edge=4)
    return out.groupBy("case_id", F.col("z").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * (F.col("y") + 1)), 5).alias("total"))


@query("slice_jpegs", "SELECT vec_id, 'data:image/jpeg;base64,/9j/' AS head, true AS ended FROM embeddings")
def slice_jpegs(spark, sf):
    """Each vector's display window as a JPEG slice of 8 x 8 pixels, in a data URI."""
    pixels = arrays.window_u8("embedding", -0.1, 0.1)
    uri = _vol(spark, sf).select("vec_id", jpeg(pixels, F.lit(8), F.lit(8)).alias("file"))
    return uri.select("vec_id", F.substring(F.concat(F.lit("data:image/jpeg;base64,"), F.base64("file")), 1, 27).alias("head"), (F.hex(F.substring("file", -2, 2)) == "FFD9").alias("ended"))
