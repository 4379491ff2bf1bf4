"""Predicates on points, entries and catalog rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sondegrid.region import Region


def z_pass(z: str, upper: float | None = None, lower: float | None = None) -> Column:
    """Strictly between the limits; a null passes, and so does everything where no limit is given."""
    c = F.col(z)
    test = F.lit(True)
    if upper is not None:
        test = test & (c < F.lit(upper))
    if lower is not None:
        test = test & (c > F.lit(lower))
    return c.isNull() | test


def z_region_pass(upper: float | None = None, lower: float | None = None) -> Column:
    """Of rows with zmin and zmax: some value may pass ``z_pass``; unknown bounds pass."""
    test = F.lit(True)
    if upper is not None:
        test = test & F.coalesce(F.col("zmin") < F.lit(upper), F.lit(True))
    if lower is not None:
        test = test & F.coalesce(F.col("zmax") > F.lit(lower), F.lit(True))
    return test


def weight_pass(w: str, upper: float | None = None, lower: float | None = None) -> Column:
    return z_pass(w, upper, lower)


def all_hooks(*hooks: Column) -> Column:
    """Entries pass if they pass all hooks."""
    return reduce(lambda a, b: a & b, hooks, F.lit(True))


def select_split(points: DataFrame, region: Region) -> tuple[DataFrame, DataFrame]:
    """Points inside the box (borders included) and the others; a null coordinate is outside."""
    inside = F.coalesce(region.contains(), F.lit(False))
    return points.where(inside), points.where(~inside)


def attribute_filter(catalog: DataFrame, where: list[str] | str | None) -> DataFrame:
    """All predicates, as SQL texts."""
    for w in [where] if isinstance(where, str) else where or []:
        catalog = catalog.where(w)
    return catalog


def keep_classes(points: DataFrame, classes=(2, 29), column: str = "classification") -> DataFrame:
    return points.where(F.col(column).isin(*classes))


def is_polygon_text(c: str) -> Column:
    return F.col(c).rlike(r"^(MULTI)?POLYGON")
