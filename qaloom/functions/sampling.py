"""Index sampling over slices: uniform with half-even rounding, down-sampling and prompt-length reduction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def uniform_indices(n: str | Column | int, k: str | Column | int) -> Column:
    """``k`` of ``0 .. n - 1`` at even distances, rounded half to even; all if n <= k, none if k <= 0, the first if k is 1."""
    n, k = _c(n).cast("int"), _c(k).cast("int")
    step = lambda i: F.rint(i * (n - 1).cast("double") / (k - 1)).cast("int")
    empty = F.array().cast("array<int>")
    return (
        F.when((k <= 0) | (n <= 0), empty)
        .when(n <= k, F.sequence(F.lit(0), n - 1))
        .when(k == 1, F.array(F.lit(0)))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(2)) - 1), step))
    )


def downsample(items: str | Column, keep: str | Column | int, nonpositive: str = "middle") -> Column:
    """At most ``keep`` items at even places.  ``keep`` 1 takes the middle one; below 1 the middle one too, or all ("all")."""
    a, k = _c(items), _c(keep).cast("int")
    n = F.size(a)
    middle = F.when(n > 0, F.slice(a, (n / 2).cast("int") + 1, 1)).otherwise(a)
    picked = F.transform(uniform_indices(n, F.greatest(k, F.lit(2))), lambda i: F.get(a, i))
    low = a if nonpositive == "all" else middle
    return F.when(k <= 0, low).when(n <= k, a).when(k == 1, middle).otherwise(picked)


def middle_index(depth: str | Column) -> Column:
    return F.floor(_c(depth) / 2).cast("int")


def fit_slices(n: str | Column, tokens_per_slice: int, text_tokens: str | Column | int, limit: int) -> Column:
    """Slices left after cutting to 0.8 (by one at least) until the prompt fits the limit, or one is left."""
    n, t = _c(n).cast("int"), _c(text_tokens)
    shrink = lambda s: F.greatest(F.least(F.floor(s * 0.8).cast("int"), s - 1), F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), n, lambda s, _: F.when((s * tokens_per_slice + t <= limit) | (s <= 1), s).otherwise(shrink(s)))
