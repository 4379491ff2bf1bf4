"""Cell by cell algebra and reshaping of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sondegrid.geom import within
from sondegrid.grid import GridSpec

K = ["row", "col"]


def grid_points(cells: DataFrame, spec: GridSpec, z: tuple | None = None, mask: DataFrame | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Cells with data as points (x, y, z); z limits are inclusive, the mask is a table of cells to keep."""
    if window:
        x, y, nx, ny = window
        cells = cells.where(f"col >= {x} and col < {x + nx} and row >= {y} and row < {y + ny}")
    if z:
        cells = cells.where(F.col("v").between(*z))
    if mask is not None:
        cells = cells.join(mask.select(*K), K, "left_semi")
    return cells.where("v is not null").select(spec.x().alias("x"), spec.y().alias("y"), F.col("v").alias("z"))


def split(cells: DataFrame, at, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Upper and lower part; a value equal to ``at`` is upper, with ``compat`` in neither (and ``at`` cut to a whole number)."""
    at = int(at) if compat else at
    v = F.col("v")
    return cells.where(v > F.lit(at) if compat else v >= F.lit(at)), cells.where(v < F.lit(at))


def recombine(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Sum of two grids, no data counting as zero."""
    return upper.unionByName(lower).groupBy(*K).agg(F.sum("v").alias("v"))


def presence(cells: DataFrame, spec: GridSpec, invert: bool = False) -> DataFrame:
    """1 where there is data, else 0, for the whole lattice; inverted the other way round."""
    has = spec.lattice(cells.sparkSession).join(cells.where("v is not null").select(*K).withColumn("_", F.lit(1)), K, "left")
    v = F.when(F.col("_").isNotNull(), 1).otherwise(0)
    return has.select(*K, (1 - v if invert else v).alias("v"))


def invert(mask: DataFrame) -> DataFrame:
    return mask.withColumn("v", 1 - F.col("v"))


def calc(a: DataFrame, b: DataFrame | None, f) -> DataFrame:
    """Cells in both (or in a) with f of their values."""
    if b is None:
        return a.select(*K, f(F.col("v")).alias("v"))
    j = a.join(b.select(*K, F.col("v").alias("_b")), K)
    return j.select(*K, f(F.col("v"), F.col("_b")).alias("v"))


def cut(cells: DataFrame, spec: GridSpec, region) -> tuple[DataFrame, GridSpec]:
    x, y, nx, ny = spec.srcwin(region)
    part = cells.where(f"col >= {x} and col < {x + nx} and row >= {y} and row < {y + ny}")
    return part.select((F.col("row") - y).alias("row"), (F.col("col") - x).alias("col"), "v"), spec.cut(region)


def crop(cells: DataFrame) -> DataFrame:
    """Without the border rows and columns that have no data; the bounds are one row of aggregates."""
    data = cells.where("v is not null")
    b = data.agg(F.min("row").alias("r"), F.min("col").alias("c")).first()
    if b["r"] is None:
        return data
    return data.select((F.col("row") - b["r"]).alias("row"), (F.col("col") - b["c"]).alias("col"), "v")


def clip_polygon(cells: DataFrame, spec: GridSpec, rings: Column, invert: bool = False) -> DataFrame:
    """Cells outside the polygon; inverted, those inside. The place of the cell decides."""
    inside = within(rings, spec.x(), spec.y())
    return cells.where(inside if invert else ~inside)


def rasterize(spark: SparkSession, spec: GridSpec, rings: Column, burn=1, other=0) -> DataFrame:
    """The lattice with ``burn`` where the place of the cell is in the polygon."""
    return spec.lattice(spark).select(*K, F.when(within(rings, spec.x(), spec.y()), F.lit(burn)).otherwise(F.lit(other)).alias("v"))


def replace(cells: DataFrame, old, new) -> DataFrame:
    """Values close to ``old`` (or NaN, or "all" with data) become ``new``."""
    v = F.col("v")
    if old == "all":
        hit = v.isNotNull()
    elif old is None or old != old:
        hit = v.isNull() | F.isnan(v.cast("double"))
    else:
        hit = F.abs(v - F.lit(float(old))) <= F.lit(1e-8 + 1e-5 * abs(float(old)))
    return cells.withColumn("v", F.when(hit, F.lit(new)).otherwise(v))


def tiles(cells: DataFrame, n: int) -> DataFrame:
    """Cells with their tile of n by n; tiles in which every row equals the first are dropped (all columns constant)."""
    t = cells.withColumn("trow", F.floor(F.col("row") / n).cast("int")).withColumn("tcol", F.floor(F.col("col") / n).cast("int"))
    flat = t.groupBy("trow", "tcol", "col").agg((F.min("v") == F.max("v")).alias("same")).groupBy("trow", "tcol").agg(F.min("same").alias("flat"))
    return t.join(flat.where("not flat").select("trow", "tcol"), ["trow", "tcol"], "left_semi")


def mosaic(parts: DataFrame, order: str = "part") -> DataFrame:
    """Later parts overwrite earlier ones, no data never does."""
    return parts.where("v is not null").groupBy(*K).agg(F.max_by("v", order).alias("v"))


def coloured(cells: DataFrame, stops: list[float], colours: list[tuple[int, int, int]]) -> DataFrame:
    """(row, col, v, r, g, b): the colour of each value, linear between the stops, held beyond them. ``stops`` ascend."""
    at = F.array(*[F.lit(float(v)) for v in stops])
    k = F.least(F.greatest(F.size(F.filter(at, lambda x: x <= F.col("v"))), F.lit(1)), F.lit(len(stops) - 1))
    d = cells.where("v is not null").withColumn("_k", k)
    low, high = F.element_at(at, F.col("_k")), F.element_at(at, F.col("_k") + 1)
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - low) / (high - low)))
    band = lambda i: F.array(*[F.lit(float(c[i])) for c in colours])
    mix = lambda i: F.element_at(band(i), F.col("_k")) * (1 - F.col("_p")) + F.element_at(band(i), F.col("_k") + 1) * F.col("_p")
    return d.withColumn("_p", part).select(*K, "v", *[mix(i).alias(c) for i, c in enumerate("rgb")])


def shaded_relief(cells: DataFrame, shade: DataFrame, stops: list[float], colours: list[tuple[int, int, int]], brightness: float = 1.15) -> DataFrame:
    """(row, col, r, g, b), 0 to 255: the colours of the values multiplied by the shade (0 to 255) and brightened, for cells
    that have both."""
    j = coloured(cells, stops, colours).join(shade.select(*K, (F.col("v") / 255).alias("_s")), K)
    return j.select(*K, *[F.least(F.lit(255.0), F.col(c) * F.col("_s") * F.lit(brightness)).alias(c) for c in "rgb"])
