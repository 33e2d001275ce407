"""Column functions over file names and case identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOLUME = ".nii.gz"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def base_volume(name: str | Column) -> Column:
    """All but the last ``_`` token; empty if there is no ``_``."""
    n = _c(name)
    return F.when(F.instr(n, "_") > 0, F.regexp_replace(n, "_[^_]*$", "")).otherwise(F.lit(""))


def variant(name: str | Column) -> Column:
    """The last ``_`` token without the volume suffix."""
    return F.replace(F.element_at(F.split(_c(name), "_"), -1), F.lit(VOLUME), F.lit(""))


def normalize_image_id(path: str | Column) -> Column:
    """Base name with the volume suffix: array suffixes are swapped, anything else gets it appended."""
    b = base_name(path)
    return F.when(b.endswith(VOLUME), b).otherwise(F.concat(F.regexp_replace(b, r"\.(npy|npz)$", ""), F.lit(VOLUME)))


def question_id(case: str | Column, idx: str | Column) -> Column:
    return F.concat(_c(case), F.lit("::"), _c(idx).cast("string"))


def resolve_path(case: str | Column, root: str, any_case: bool = False, swap: tuple[str, ...] = ()) -> Column:
    """Where a case's volume lies under ``root``.

    Quotes go; suffixes in ``swap`` (as ``.npz``) become the volume suffix, which is appended where it lacks.  A name of
    ``valid`` and at least two more ``_`` tokens lies in ``root/t0_t1/t0_t1_t2/name``, any other in ``root/name``.
    """
    c = F.translate(_c(case), "\"'", "")
    for s in swap:
        c = F.when(c.endswith(s), F.concat(F.substring(c, F.lit(1), F.length(c) - len(s)), F.lit(VOLUME))).otherwise(c)
    name = F.when(c.endswith(VOLUME), c).otherwise(F.concat(c, F.lit(VOLUME)))
    t = F.split(F.replace(name, F.lit(VOLUME), F.lit("")), "_")
    first = F.lower(F.get(t, 0)) if any_case else F.get(t, 0)
    deep = (first == "valid") & (F.size(t) >= 3)
    folder = F.concat_ws("/", F.lit(root), F.array_join(F.slice(t, 1, 2), "_"), F.array_join(F.slice(t, 1, 3), "_"), name)
    return F.when(deep, folder).otherwise(F.concat_ws("/", F.lit(root), name))


def resolve_by_stem(case: str | Column, root: str) -> Column:
    """The same place by cutting the last ``_`` token twice, without a look at the first token."""
    name = normalize_image_id(case)
    stem = F.replace(name, F.lit(VOLUME), F.lit(""))
    once = F.regexp_replace(stem, "_[^_]*$", "")
    return F.concat_ws("/", F.lit(root), F.regexp_replace(once, "_[^_]*$", ""), once, name)


def output_path(source: str | Column, root: str, suffix: str) -> Column:
    """``root`` and the source's base name with its volume or array suffix swapped for ``suffix``."""
    return F.concat_ws("/", F.lit(root), F.concat(F.regexp_replace(base_name(source), r"(\.nii\.gz|\.npy|\.npz)$", ""), F.lit(suffix)))
