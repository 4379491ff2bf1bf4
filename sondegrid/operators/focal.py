"""Neighbourhood operators. Small kernels: each cell is sent to the cells it counts for, and summed there. Larger ones: tiles
with a halo in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondegrid.grid import GridSpec
from sondegrid.session import materialize

K = ["row", "col"]


def spread(cells: DataFrame, spec: GridSpec, offsets: list[tuple[int, int, float]], value: str = "v") -> DataFrame:
    """(row, col, v, k): each value at the cells that lie off by minus an offset, with the offset's weight."""
    o = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(float(k)).alias("k")) for r, c, k in offsets]))
    d = cells.select("row", "col", F.col(value).alias("v"), o.alias("o"))
    d = d.select((F.col("row") - F.col("o.r")).cast("int").alias("row"), (F.col("col") - F.col("o.c")).cast("int").alias("col"), "v", F.col("o.k").alias("k"), F.col("o.r").alias("dr"), F.col("o.c").alias("dc"))
    return d.where(f"row >= 0 and row < {spec.ny} and col >= 0 and col < {spec.nx}")


def gaussian_kernel(size: int) -> list[tuple[int, int, float]]:
    w = {(i, j): math.exp(-(i * i + j * j) / size) for i in range(-size, size + 1) for j in range(-size, size + 1)}
    total = sum(w.values())
    return [(i, j, v / total) for (i, j), v in w.items()]


def blur(cells: DataFrame, spec: GridSpec, size: int = 1) -> DataFrame:
    """Gaussian blur over symmetric borders; no data counts as zero while blurring and is no data afterwards."""
    full = spec.lattice(cells.sparkSession).join(cells, K, "left").select(*K, F.coalesce("v", F.lit(0)).cast("double").alias("v"))

    def mirrored(c: str, n: int):
        at = F.col(c)
        places = [F.when(at < size, -1 - at), at, F.when(at >= n - size, 2 * n - 1 - at)]
        return F.filter(F.array(*[p.cast("int") for p in places]), lambda x: x.isNotNull())

    padded = full.withColumn("row", F.explode(mirrored("row", spec.ny))).withColumn("col", F.explode(mirrored("col", spec.nx)))
    summed = spread(padded, spec, gaussian_kernel(size)).groupBy(*K).agg(F.sum(F.col("v") * F.col("k")).alias("v"))
    return summed.join(cells.where("v is not null").select(*K), K, "left_semi")


def focal_mean(cells: DataFrame, spec: GridSpec, weights: list[tuple[int, int, float]]) -> DataFrame:
    """Weighted mean of the data in a neighbourhood."""
    return spread(cells.where("v is not null"), spec, weights).groupBy(*K).agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("v"))


def cosine_kernel(radius: int) -> list[tuple[int, int, float]]:
    """Cosine arch: 1 + cos(pi r / radius) within the radius."""
    return [(i, j, 1 + math.cos(math.pi * math.hypot(i, j) / radius)) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if math.hypot(i, j) < radius]


def windows(nx: int, ny: int, n: int, step: int, spark) -> DataFrame:
    """(x, y, nx, ny): moving windows row by row, clipped at the far borders."""
    starts = lambda size: list(range(0, max(size - n, 0) + step, step)) if size > n else [0]
    xs, ys = [s for s in starts(nx) if s < nx], [s for s in starts(ny) if s < ny]
    d = spark.range(len(xs) * len(ys)).select((F.col("id") % len(xs) * step).cast("int").alias("x"), (F.expr(f"id div {len(xs)}") * step).cast("int").alias("y"))
    return d.select("x", "y", F.least(F.lit(n), F.lit(nx) - F.col("x")).cast("int").alias("nx"), F.least(F.lit(n), F.lit(ny) - F.col("y")).cast("int").alias("ny"))


def outliers(cells: DataFrame, n: int, factor: float = 1.5) -> DataFrame:
    """Cells beyond both Tukey fences (``factor`` interquartile ranges) of their n by n tile: of the value, and of its
    gradient along the column. One pass over tiles that don't overlap."""
    g = gradient(cells).withColumn("trow", F.floor(F.col("row") / n).cast("int")).withColumn("tcol", F.floor(F.col("col") / n).cast("int"))
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    f = g.groupBy("trow", "tcol").agg(q("v").alias("qv"), q("g").alias("qg"))
    beyond = lambda c, a: (F.col(c) > F.col(a)[1] + F.lit(factor) * (F.col(a)[1] - F.col(a)[0])) | (F.col(c) < F.col(a)[0] - F.lit(factor) * (F.col(a)[1] - F.col(a)[0]))
    return g.join(f, ["trow", "tcol"]).where(beyond("v", "qv") & beyond("g", "qg")).select(*K, "v")


def outliers_iterated(cells: DataFrame, spec: GridSpec, n: int | None = None, step: int | None = None, factor: float = 1.5, threshold: float | None = None, slope_threshold: float | None = None) -> DataFrame:
    """Overlapping windows of n by n cells (0.5 % of the columns, at least 10) at every step (a quarter of n). In a window whose
    values' standard deviation reaches the threshold (that of the grid), or whose gradient's does, cells beyond the fences of
    both value and gradient are dropped, again and again until there are none. Windows are judged apart from each other, so
    they can be spread over tasks; a cell found in any window is dropped from the grid."""
    n = n or max(10, int(spec.nx * 0.005))
    step = step or max(1, n // 4)
    last = [max(1, math.ceil(max(size - n, 0) / step) + 1) - 1 for size in (spec.ny, spec.nx)]
    if threshold is None:
        threshold = cells.agg(F.stddev_pop(F.col("v").cast("double"))).first()[0] or 0.0
    slope_threshold = threshold if slope_threshold is None else slope_threshold

    def under(c: str, most: int):
        at = F.floor(F.col(c) / step).cast("int")
        return F.explode(F.sequence(F.greatest(F.lit(0), F.least(at - math.ceil(n / step) + 1, F.lit(most))), F.least(at, F.lit(most))))

    d = cells.where("v is not null").select(*K, F.col("v").cast("double").alias("v")).withColumn("wr", under("row", last[0])).withColumn("wc", under("col", last[1]))
    d = d.where((F.col("row") < F.col("wr") * step + n) & (F.col("col") < F.col("wc") * step + n))
    ny, nx, none = spec.ny, spec.nx, pd.DataFrame({"row": [], "col": []}).astype("int32")

    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        a = np.full((min(n, ny - key[0] * step), min(n, nx - key[1] * step)), np.nan)
        r, cc = p["row"].to_numpy() - key[0] * step, p["col"].to_numpy() - key[1] * step
        a[r, cc] = p["v"]
        if min(a.shape) < 2 or (a == a[0]).all():
            return none
        found = np.zeros(a.shape, bool)
        while True:  # each round drops a cell or is the last
            slope = np.gradient(a, axis=0)
            if np.isnan(a).all() or np.isnan(slope).all() or (np.nanstd(a) < threshold and np.nanstd(slope) < slope_threshold):
                break
            bad = np.ones(a.shape, bool)
            for m in (a, slope):
                lo, hi = np.nanpercentile(m, [25, 75])
                with np.errstate(invalid="ignore"):
                    bad &= (m > hi + factor * (hi - lo)) | (m < lo - factor * (hi - lo))
            if not bad.any():
                break
            found |= bad
            a[bad] = np.nan
        hit = found[r, cc]
        return pd.DataFrame({"row": p["row"][hit], "col": p["col"][hit]})

    bad = d.groupBy("wr", "wc").applyInPandas(run, "row int, col int").distinct()
    return cells.join(bad, K, "left_anti")


def gradient(cells: DataFrame, by: str = "col", along: str = "row", value: str = "v") -> DataFrame:
    """Adds g: central differences along a line of cells, one-sided at its ends, over neighbours that exist."""
    w = Window.partitionBy(by).orderBy(along)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    v = F.col(value)
    return cells.withColumn("g", F.when(before.isNotNull() & after.isNotNull(), (after - before) / F.lit(2.0)).when(after.isNotNull(), (after - v) / F.lit(1.0)).when(before.isNotNull(), (v - before) / F.lit(1.0)).otherwise(F.lit(0.0)))


def _horn(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """(row, col, gx, gy): weighted differences of the eight neighbours, for cells that have all nine."""
    ring = [(r, c, 1.0) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    s = spread(cells.where("v is not null"), spec, ring)
    wx = F.col("dc") * (2 - F.abs("dr"))
    wy = F.col("dr") * (2 - F.abs("dc"))
    return s.groupBy(*K).agg(F.count("*").alias("n"), F.sum(F.col("v") * wx).alias("gx"), F.sum(F.col("v") * wy).alias("gy")).where("n = 9")


def slope(cells: DataFrame, spec: GridSpec, scale: float = 1.0) -> DataFrame:
    """Horn's slope in degrees of inner cells."""
    h = _horn(cells, spec)
    x, y = F.col("gx") / F.lit(8 * abs(spec.dx) * scale), F.col("gy") / F.lit(8 * abs(spec.dy) * scale)
    return h.select(*K, F.degrees(F.atan(F.sqrt(x * x + y * y))).alias("v"))


def hillshade(cells: DataFrame, spec: GridSpec, azimuth: float = 315.0, altitude: float = 45.0, scale: float = 111120.0) -> DataFrame:
    """Shade 1..255 of inner cells."""
    h = _horn(cells, spec)
    x, y = F.col("gx") / F.lit(8 * abs(spec.dx) * scale), F.col("gy") / F.lit(8 * abs(spec.dy) * scale)
    up, az = math.radians(altitude), math.radians(azimuth)
    # the light's direction is (sin az, -cos az) in columns and rows
    dot = F.lit(math.sin(up)) - F.lit(math.cos(up)) * (x * F.lit(math.sin(az)) - y * F.lit(math.cos(az)))
    shade = dot / F.sqrt(1 + x * x + y * y)
    return h.select(*K, F.greatest(F.lit(1.0), F.lit(1.0) + F.lit(254.0) * shade).alias("v"))


def proximity(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """Squared distance in cells to the nearest cell with data (not null, not zero), for the whole lattice: first along
    columns by windows, then over the rows' parabolas, one row of the grid at a time."""
    full = spec.lattice(cells.sparkSession).join(cells.where("v is not null and v <> 0").select(*K, F.col("row").alias("hit")), K, "left")
    w = Window.partitionBy("col").orderBy("row")
    up = F.last("hit", ignorenulls=True).over(w)
    down = F.first("hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = full.select(*K, F.least(F.col("row") - up, down - F.col("row")).alias("d"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("col")
        c, f = p["col"].to_numpy(np.int64), p["d"].to_numpy(np.float64)
        ok = np.flatnonzero(~np.isnan(f))
        out = np.full(len(c), np.nan)
        if len(ok):
            # lower envelope of parabolas
            v, z = [ok[0]], [-np.inf]
            for q in ok[1:]:
                while True:
                    k = v[-1]
                    s = ((f[q] ** 2 + c[q] ** 2) - (f[k] ** 2 + c[k] ** 2)) / (2 * (c[q] - c[k]))
                    if s > z[-1]:
                        break
                    v.pop()
                    z.pop()
                v.append(q)
                z.append(s)
            at = np.array(v)[np.searchsorted(z, c, side="left").clip(1) - 1]
            out = (c - c[at]) ** 2 + f[at] ** 2
        return pd.DataFrame({"row": p["row"], "col": p["col"], "d2": pd.array(np.where(np.isnan(out), -1, out).astype("int64"))})

    return d.groupBy("row").applyInPandas(run, "row int, col int, d2 bigint").select(*K, F.when(F.col("d2") >= 0, F.col("d2")).alias("d2"))


def fill_nodata(cells: DataFrame, spec: GridSpec, reach: int = 100, smooth: int = 0) -> DataFrame:
    """Cells without data get the inverse-distance mean of the nearest data in the four directions within reach; then the filled
    cells are ``smooth`` times replaced by the mean of the three by three cells around them that have a value."""
    full = spec.lattice(cells.sparkSession).join(cells, K, "left")
    out = full
    for name, by, along, sign in (("u", "col", "row", 1), ("d", "col", "row", -1), ("l", "row", "col", 1), ("r", "row", "col", -1)):
        w = Window.partitionBy(by).orderBy(F.col(along) * sign)
        near = F.last(F.when(F.col("v").isNotNull(), F.struct(F.col(along).alias("at"), F.col("v").cast("double").alias("v"))), ignorenulls=True).over(w)
        out = out.withColumn(f"_{name}", near).withColumn(f"_{name}d", F.abs(F.col(along) - F.col(f"_{name}.at")))
    ok = lambda n: F.col(f"_{n}d") <= reach
    total = lambda f: sum((F.when(ok(n), f(n)).otherwise(F.lit(0.0)) for n in "udlr"), F.lit(0.0))
    num, den = total(lambda n: F.col(f"_{n}.v") / F.nullif(F.col(f"_{n}d"), F.lit(0))), total(lambda n: 1 / F.nullif(F.col(f"_{n}d").cast("double"), F.lit(0.0)))
    out = out.select(*K, F.coalesce(F.col("v").cast("double"), num / F.nullif(den, F.lit(0.0))).alias("v"), F.col("v").isNull().alias("filled"))
    ring = [(r, c, 1.0) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    for _ in range(smooth):
        out = materialize(out, "filled")
        mean = spread(out.where("v is not null"), spec, ring).groupBy(*K).agg(F.avg("v").alias("m"))
        out = out.join(mean, K, "left").select(*K, F.when(F.col("filled") & F.col("v").isNotNull(), F.col("m")).otherwise(F.col("v")).alias("v"), "filled")
    return out.select(*K, "v")


def resample(cells: DataFrame, spec: GridSpec, target: GridSpec) -> DataFrame:
    """Bilinear: each target cell from the four source cells around it, over those that have data."""
    t = target.lattice(cells.sparkSession)
    fx, fy = (target.x() - F.lit(spec.xmin)) / F.lit(spec.dx), (target.y() - F.lit(spec.ymax)) / F.lit(spec.dy)
    t = t.select(F.col("row").alias("tr"), F.col("col").alias("tc"), fx.alias("fx"), fy.alias("fy"))
    four = F.explode(F.array(*[F.struct((F.floor("fy") + r).cast("int").alias("row"), (F.floor("fx") + c).cast("int").alias("col")) for r in (0, 1) for c in (0, 1)]))
    t = t.select("tr", "tc", "fx", "fy", four.alias("s")).select("tr", "tc", "fx", "fy", "s.row", "s.col")
    k = (1 - F.abs(F.col("fx") - F.col("col"))) * (1 - F.abs(F.col("fy") - F.col("row")))
    j = t.withColumn("k", k).where("k > 0").join(cells.where("v is not null"), K)
    return j.groupBy("tr", "tc").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("v")).select(F.col("tr").alias("row"), F.col("tc").alias("col"), "v")
