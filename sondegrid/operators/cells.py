"""Points to cells: hash aggregates by (row, col), partial before the exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sondegrid.grid import GridSpec
from sondegrid.operators import ranks

K = ["row", "col"]


def aggregate(points: DataFrame, spec: GridSpec, *aggs: Column, strict: bool = True) -> DataFrame:
    """Any aggregates by cell. Points on the border of the region and beyond the last cell are dropped; null coordinates too."""
    return spec.index(points, strict).groupBy(*K).agg(*aggs)


def count(points: DataFrame, spec: GridSpec) -> DataFrame:
    return aggregate(points, spec, F.count("*").alias("v"))


def mean(points: DataFrame, spec: GridSpec, z: str = "z") -> DataFrame:
    return aggregate(points, spec, F.avg(z).alias("v"))


def mask(points: DataFrame, spec: GridSpec) -> DataFrame:
    return spec.index(points).select(*K).distinct().withColumn("v", F.lit(1))


def wet_dry(points: DataFrame, spec: GridSpec, z: str = "z") -> DataFrame:
    """1 where the mean is not below zero, else 0."""
    return aggregate(points, spec, F.when(F.avg(z) >= 0, 1).otherwise(0).alias("v"))


def dense(cells: DataFrame, spec: GridSpec, fill=None, value: str = "v") -> DataFrame:
    """All cells of the lattice; those without data get ``fill``."""
    d = spec.lattice(cells.sparkSession).join(cells, K, "left")
    return d if fill is None else d.withColumn(value, F.coalesce(value, F.lit(fill)))


def block(points: DataFrame, spec: GridSpec, z: str = "z", w: str | None = None, compat: bool = False) -> DataFrame:
    """Cell means as points at the cells' places. Weighted: sum(z w) / sum(w), a sum of weights of zero counting as 1; with
    ``compat`` the weights only divide."""
    if w is None:
        v = F.avg(z)
    else:
        total = F.when(F.sum(w) == 0, 1).otherwise(F.sum(w))
        v = F.sum(z) / total / F.count("*") if compat else F.sum(F.col(z) * F.col(w)) / total
    return aggregate(points, spec, v.alias("z")).select(*K, spec.x().alias("x"), spec.y().alias("y"), "z")


def block_centre(points: DataFrame, spec: GridSpec, z: str = "z") -> DataFrame:
    """Mean place and value of each cell's points."""
    return aggregate(points, spec, F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(z).alias("z"))


def block_median(points: DataFrame, spec: GridSpec, z: str = "z") -> DataFrame:
    """Exact medians; a cell of any number of points is never held in one place."""
    return ranks.percentiles(spec.index(points).select(*K, F.col(z).cast("double").alias("z")), K, "z", {"z": 0.5})


def half_medians(points: DataFrame, spec: GridSpec, z: str = "z") -> DataFrame:
    """(row, col, q1, q3): medians of the two halves of each cell's ordered values, the lower half without its last."""
    half = lambda n: F.floor(n / 2)

    def places(n: Column) -> Column:
        below, above = half(n) - 1, n - half(n)  # how many values either half has
        ends = [("q1", below, F.lit(0)), ("q3", above, half(n))]
        return F.array(*[F.struct(F.lit(name).alias("name"), (f((m - 1) / 2) + 1 + base).cast("bigint").alias("r"), (m > 0).alias("ok")) for name, m, base in ends for f in (F.floor, F.ceil)])

    found = ranks.order_statistics(spec.index(points).select(*K, F.col(z).cast("double").alias("z")), K, "z", lambda n: F.filter(places(n), lambda x: x["ok"]))
    # where both ranks are one value it comes once or twice, and the mean is that value
    return found.groupBy(*K).agg(*[F.avg(F.when(F.col("name") == q, F.col("v"))).alias(q) for q in ("q1", "q3")])


def block_lists(points: DataFrame, spec: GridSpec) -> DataFrame:
    """The points of each cell as an array, for kernels that need them; a cell must fit in memory."""
    cols = [c for c in points.columns if c not in K]
    return aggregate(points, spec, F.collect_list(F.struct(*cols)).alias("points"))


def envelope(points: DataFrame, by: list[str] | None = None, z: str = "z") -> DataFrame:
    """Zone map: bounds and number of points, by file or whatever ``by`` names."""
    aggs = [f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))] + [F.min(z).alias("zmin"), F.max(z).alias("zmax"), F.count("*").alias("numpts")]
    return points.groupBy(*(by or [])).agg(*aggs)


def no_data(v: str, ndv: float = -9999.0) -> Column:
    """Neither null nor NaN nor the sentinel."""
    return F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & (F.col(v) != F.lit(ndv))


def histogram(df: DataFrame, v: str, bins: int) -> DataFrame:
    """(bin, n): equal bins from least to greatest value, the last one closed. One pass finds the bounds, which are one row."""
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return df.select(F.lit(1).alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = F.lit((float(hi) - float(lo)) / bins or 1.0)
    place = F.least(F.floor((F.col(v).cast("double") - F.lit(float(lo))) / width).cast("int") + 1, F.lit(bins))
    return df.where(F.col(v).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def moments(v: str) -> dict[str, Column]:
    """Aggregates of a distribution; skew is that of samples, divided by n - 1."""
    c = F.col(v).cast("double")
    n = F.count(c)
    return {"n": n, "least": F.min(c), "greatest": F.max(c), "mean": F.avg(c), "std": F.stddev_pop(c), "skew": F.skewness(c) * n / F.nullif(n - 1, F.lit(0)), "kurt": F.kurtosis(c), "rms": F.sqrt(F.avg(c * c))}
