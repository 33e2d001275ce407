"""Length statistics, histograms, kernel densities and quantiles.

Whole numbers of a bounded range (lengths) have few distinct values, whose counts fit a task; quantiles of free doubles come from
``quantiles``, which holds no more than ``MOST`` values of a group in a task whatever the group's size.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled

#: Upper ends of the half-open histogram bins (fixed values).
EDGES = (0, 5, 10, 20, 30, 40, 50, 100)
GRID = 220
#: Bandwidths beyond which a kernel counts as nothing (exp(-32) of its height).
REACH = 8.0
#: Distinct values of a group that are put in order in one task, and the parts that a larger range is cut into.
MOST, PARTS = 10_000, 128


def summary(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """count, mean, median, population std, min and max; an empty input gives count 0 and nulls."""
    v = F.col(value)
    if not isinstance(rows.schema[value].dataType, T.IntegralType):
        plain = rows.groupBy(*(keys or [])).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
        keyed = plain if keys else plain.withColumn("__all", F.lit(1))
        on = keys or ["__all"]
        q = quantiles(rows if keys else rows.withColumn("__all", F.lit(1)), on, value, [0.5])
        return _with_quantiles(keyed, q, on).select(*(keys or []), "count", "mean", F.col("q")[0].alias("median"), "std", "min", "max")
    return rows.groupBy(*(keys or [])).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def _with_quantiles(rows: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    same = q.withColumnsRenamed({k: f"__q_{k}" for k in keys})
    return rows.join(same, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__q_{k}")) for k in keys)), "left").drop(*[f"__q_{k}" for k in keys])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], most: int = MOST, parts: int = PARTS) -> DataFrame:
    """``keys, q``: the exact quantiles of each group, linearly interpolated, by distributed selection.

    Values are counted; a group with more than ``most`` distinct ones is cut at approximate quantiles of its range, and only the
    parts that hold a wanted rank are looked at further, until each has ``most`` values at most.  Counting combines before every
    shuffle, so that a group of any size is many tasks' work.  Null values do not count; a group without values has no row.
    """
    spread = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    left = settled(spread.select(F.struct(*keys).alias("key"), "v", "n", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("before")))
    places = lambda total: [x for p in shares for x in (F.floor((total - 1) * F.lit(p)), F.ceil((total - 1) * F.lit(p)))]
    wanted = settled(left.groupBy("key").agg(F.sum("n").alias("total")).withColumn("ranks", F.array(*(x.cast("long") for x in places(F.col("total"))))))
    holds = lambda start, n: F.exists("ranks", lambda r: (r >= start) & (r < start + n))
    for _ in range(40):
        large = settled(left.groupBy("key", "part").agg(F.count("*").alias("size")).where(F.col("size") > most))
        if large.isEmpty():
            break
        cuts = left.join(large, ["key", "part"]).groupBy("key", "part").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts"))
        dealt = left.join(settled(cuts), ["key", "part"], "left").withColumn("b", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("v")))))
        sizes = dealt.groupBy("key", "part", "before", "b").agg(F.sum("n").alias("m"))
        earlier = W.partitionBy("key", "part").orderBy("b").rowsBetween(W.unboundedPreceding, -1)  # ``parts`` rows
        starts = sizes.withColumn("start", F.col("before") + F.coalesce(F.sum("m").over(earlier), F.lit(0))).join(wanted, "key")
        kept = settled(starts.where(holds(F.col("start"), F.col("m"))).select("key", "part", "b", "start"))
        left = settled(dealt.join(kept, ["key", "part", "b"]).select("key", "v", "n", (F.col("part") * parts + F.col("b")).alias("part"), F.col("start").alias("before")))
    else:
        raise RuntimeError("quantiles did not settle")
    in_part = W.partitionBy("key", "part").orderBy("v").rowsBetween(W.unboundedPreceding, -1)  # ``most`` rows
    at = left.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(wanted, "key")
    hit = at.where(holds(F.col("start"), F.col("n"))).groupBy("key").agg(F.first("total").alias("total"), F.first("ranks").alias("ranks"), F.collect_list(F.struct("start", "n", "v")).alias("hit"))
    value_at = lambda r: F.element_at(F.filter("hit", lambda x: (x["start"] <= r) & (r < x["start"] + x["n"])), 1)["v"]

    def one(i: int, p: float):
        low, high = value_at(F.col("ranks")[2 * i]), value_at(F.col("ranks")[2 * i + 1])
        w = (F.col("total") - 1) * F.lit(p) - F.col("ranks")[2 * i]
        return low + (high - low) * w

    return hit.select("key.*", F.array(*(one(i, p) for i, p in enumerate(shares))).alias("q"))


def bin_label(value: str):
    v = F.col(value)
    out = F.lit(f">{EDGES[-1]}")
    for lo, hi in reversed(list(zip(EDGES[:-1], EDGES[1:], strict=True))):
        out = F.when(v <= hi, F.lit(f"{lo + 1}-{hi}")).otherwise(out)
    return F.when(v <= 0, F.lit("0")).otherwise(out)


def histogram(spark: SparkSession, rows: DataFrame, value: str) -> DataFrame:
    """``(bin, n)`` in bins (lo, hi], zero-filled; bin "0" only if populated; an empty input gives no bins."""
    got = rows.where(F.col(value).isNotNull()).groupBy(bin_label(value).alias("bin")).agg(F.count("*").alias("n"))
    names = [f"{lo + 1}-{hi}" for lo, hi in zip(EDGES[:-1], EDGES[1:], strict=True)] + [f">{EDGES[-1]}"]
    bins = spark.createDataFrame([(n,) for n in names], "bin string").join(F.broadcast(got.agg(F.sum("n").alias("all"))), F.col("all") > 0, "left_semi")
    return bins.join(got, "bin", "full").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n"))


def bandwidth(sd, n):
    """1.06 sd n^-0.2, 0.2 at least; 0.4 if sd is 0."""
    return F.when(sd == 0, F.lit(0.4)).otherwise(F.greatest(F.lit(0.2), F.lit(1.06) * sd * F.pow(n.cast("double"), F.lit(-0.2))))


def kde(rows: DataFrame, label: str, value: str, points: int = GRID, log: bool = False) -> DataFrame:
    """``(label, i, x, density)``: a Gaussian kernel density on an even grid from the smallest to the largest value.

    Values are counted first; each distinct value then meets the grid points within ``REACH`` bandwidths of it, no others, so the
    cost grows with the values and not with values times grid.  Sums are combined before the shuffle.  ``log`` works on log10 of
    positive values.
    """
    v = F.col(value).cast("double")
    src = rows.where(v > 0).select(label, F.log10(v).alias("v")) if log else rows.select(label, v.alias("v"))
    counted = src.where("v is not null").groupBy(label, "v").agg(F.count("*").alias("n"))
    whole = src.where("v is not null").groupBy(label).agg(F.stddev_pop("v").alias("sd"), F.count("*").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    whole = whole.select(label, "total", "lo", "hi", bandwidth(F.col("sd"), F.col("total")).alias("h")).withColumn("step", (F.col("hi") - F.col("lo")) / (points - 1))
    grid = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    # the grid places that a value reaches; of a single value all
    edge = lambda side: F.when(F.col("step") > 0, (F.col("v") + side * REACH * F.col("h") - F.col("lo")) / F.col("step"))
    first = F.greatest(F.lit(0), F.coalesce(F.ceil(edge(-1)), F.lit(0))).cast("int")
    last = F.least(F.lit(points - 1), F.coalesce(F.floor(edge(1)), F.lit(points - 1))).cast("int")
    near = counted.join(whole, label).select(label, "v", "n", "h", "lo", "hi", first.alias("a"), last.alias("b")).where("a <= b")
    near = near.select("*", F.explode(F.sequence("a", "b")).alias("i"))
    z = (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1) - F.col("v")) / F.col("h")
    sums = near.groupBy(label, "i").agg(F.sum(F.col("n") * F.exp(z * z * -0.5)).alias("s"))
    dense = grid.join(sums, [label, "i"], "left")
    return dense.select(label, "i", "x", (F.coalesce("s", F.lit(0.0)) / (F.col("total") * F.col("h") * 2.5066282746310002)).alias("density"))


def violin(density: DataFrame, quartiles: DataFrame, label: str) -> DataFrame:
    """Densities divided by their label's largest, and the grid place nearest to the median."""
    w = W.partitionBy(label)
    out = density.join(quartiles.select(label, "q2"), label).withColumn("width", F.col("density") / F.max("density").over(w))
    near = out.groupBy(label).agg(F.min_by("i", F.struct(F.abs(F.col("x") - F.col("q2")), F.col("i"))).alias("median_i"))
    return out.join(near, label).select(label, "i", "x", "width", (F.col("i") == F.col("median_i")).alias("at_median"))


def quartiles(rows: DataFrame, label: str, value: str) -> DataFrame:
    """q1, q2, q3 and whiskers (the outermost values within 1.5 IQR of the box)."""
    shares = [0.25, 0.5, 0.75]
    if isinstance(rows.schema[value].dataType, T.IntegralType):
        q = rows.groupBy(label).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("q"))
    else:
        q = quantiles(rows, [label], value, shares)
    q = q.select(label, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.join(q, label)
    ends = inside.groupBy(label).agg(F.min(F.when(F.col(value) >= low, F.col(value))).alias("whisker_low"), F.max(F.when(F.col(value) <= high, F.col(value))).alias("whisker_high"))
    return q.join(ends, label)
