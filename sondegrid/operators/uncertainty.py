"""Uncertainty of interpolated grids: zones, split samples, error curves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from sondegrid.operators import ranks

K = ["row", "col"]
GUESS = (0.0, 0.1, 0.2)


def binned_std(df: DataFrame, x: str, e: str, bins: int = 10) -> DataFrame:
    """(bin, n, std, x): equal bins of x, the last closed; std = sqrt(E[e2] - E[e]2)."""
    lo, hi = df.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
    if lo is None:
        return df.select(F.lit(1).alias("bin"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("std"), F.lit(0.0).alias("x")).limit(0)
    at = F.least(F.floor((F.col(x) - F.lit(lo)) / F.lit((hi - lo) / bins or 1.0)).cast("int") + 1, F.lit(bins))
    ed = F.col(e).cast("double")
    var = F.avg(ed * ed) - F.avg(ed) * F.avg(ed)
    d = df.where(F.col(x).isNotNull() & F.col(e).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))
    return d.withColumn("x", F.lit(lo) + F.col("bin") * F.lit((hi - lo) / bins))


def fit_power(x: np.ndarray, y: np.ndarray, powers: np.ndarray | None = None) -> tuple[float, float, float]:
    """(c0, c1, c2) of y = c0 + c1 x^c2 by least squares: linear in c0 and c1 for each power tried, then refined. (0, 0) is
    put before the data and x is at least 1e-4."""
    x = np.maximum(np.concatenate([[0.0], np.asarray(x, float)]), 1e-4)
    y = np.concatenate([[0.0], np.asarray(y, float)])
    grid = np.linspace(0.05, 3, 60) if powers is None else powers
    best = (np.inf, 0.0, 0.1, 0.2)
    for _ in range(4):
        for p in grid:
            a = np.column_stack([np.ones_like(x), x**p])
            c, *_r = np.linalg.lstsq(a, y, rcond=None)
            r = float(((a @ c - y) ** 2).sum())
            if r < best[0] - 1e-15:
                best = (r, float(c[0]), float(c[1]), float(p))
        step = grid[1] - grid[0]
        grid = np.linspace(max(1e-3, best[3] - step), best[3] + step, 41)
    return best[1:]


def error_bins(errors: DataFrame, x: str = "distance", e: str = "error", bins: int = 10) -> tuple[np.ndarray, np.ndarray] | None:
    """Upper ends and standard deviations of the errors in at most ``bins`` equal bins, fewer until none is empty; None without
    errors. One scan counts in bins so fine that each number of bins is made of whole ones."""
    fine = math.lcm(*range(1, bins + 1))
    d = errors.select(F.col(x).cast("double").alias("x"), F.col(e).cast("double").alias("e")).where("x is not null and e is not null")
    lo, hi = d.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return None
    at = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit((hi - lo) or 1.0) * fine).cast("int"), F.lit(fine - 1))
    got = d.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("ss")).collect()  # at most ``fine`` rows
    sums = np.zeros((fine, 3))
    for r in got:
        sums[r["bin"]] = r["n"], r["s"], r["ss"]
    for k in range(bins, 0, -1):
        n, s, ss = sums.reshape(k, fine // k, 3).sum(1).T
        if n.all():
            break
    return lo + np.arange(1, k + 1) * (hi - lo) / k, np.sqrt(np.maximum(ss / n - (s / n) ** 2, 0.0))


def error_curve(errors: DataFrame, x: str = "distance", e: str = "error", bins: int = 10) -> tuple[float, float, float]:
    """Coefficients of the error by distance; the guess without errors."""
    found = error_bins(errors, x, e, bins)
    return GUESS if found is None else fit_power(*found)


def tile_stats(cells: DataFrame, n: int, p: float = 0.95) -> DataFrame:
    """(trow, tcol, filled, cells, density, prox): of cells with mask and prox columns, by n by n tile."""
    t = cells.groupBy(F.floor(F.col("row") / n).cast("int").alias("trow"), F.floor(F.col("col") / n).cast("int").alias("tcol"))
    return t.agg(F.sum("mask").alias("filled"), F.count("*").alias("cells"), (F.sum("mask") / F.count("*") * F.lit(100.0)).alias("density"), F.percentile("prox", F.lit(p)).alias("prox"))


def zones(tiles: DataFrame, low: float, high: float, tolerance: float = 0.01) -> DataFrame:
    """Tiles near data are dense, those far from it sparse."""
    z = F.when(F.col("prox") <= F.lit(low + tolerance), "high-dens").when(F.col("prox") < F.lit(high - tolerance), "mid-dens").otherwise("low-dens")
    return tiles.withColumn("zone", z)


def slope_zones(tiles: DataFrame, low: float, high: float, tolerance: float = 0.01) -> DataFrame:
    """Tiles by the slope within them."""
    z = F.when(F.col("slope") <= F.lit(low + tolerance), "low-slp").when(F.col("slope") < F.lit(high - tolerance), "mid-slp").when(F.col("slope").isNotNull(), "high-slp")
    return tiles.withColumn("slope_zone", z)


def training(tiles: DataFrame, per_zone: int = 25, tolerance: float = 0.01, zone: str = "zone", by: str = "density") -> DataFrame:
    """Of each zone the tiles of at most the zone's median density (or what ``by`` names), the least first, up to a number."""
    middle = ranks.percentiles(tiles.where(F.col(zone).isNotNull()), [zone], by, {"middle": 0.5})
    t = tiles.join(F.broadcast(middle), zone).where(F.col(by) <= F.col("middle") + F.lit(tolerance))  # three rows
    return t.withColumn("rank", F.row_number().over(Window.partitionBy(zone).orderBy(by, "trow", "tcol"))).where(F.col("rank") <= per_zone)


def sort_apart(boxes: list[tuple[float, float]], most: int = 25, seed: int = 0) -> list[int]:
    """Order of at most some hundred tile centres: from a seeded shuffle, each next one farther than the median from the last where possible."""
    rng = np.random.default_rng(seed)
    left = list(rng.permutation(len(boxes)))
    out = [left.pop(0)] if left else []
    while left and len(out) < most:
        at = np.array([boxes[i] for i in left])
        dist = np.hypot(*(at - np.array(boxes[out[-1]])).T)
        far = np.flatnonzero(dist > np.median(dist))
        out.append(left.pop(int(far[0]) if len(far) else 0))
    return [int(i) for i in out]


def split_sample(points: DataFrame, keep_percent: float, seed: int = 0) -> DataFrame:
    """Points with held = true for those kept out: by a hash of seed and id, so that a retry draws the same."""
    return points.withColumn("held", F.pmod(F.xxhash64(F.lit(seed), "pid"), F.lit(10_000)) >= F.lit(int(keep_percent * 100)))


def hold_out(cells: DataFrame, tile: list[str], seed: int = 0, keep: str = "keep") -> DataFrame:
    """All cells of each tile but ``keep`` of them, drawn by a hash of seed and id, so that a retry draws the same. A tile's cells
    are bounded in number."""
    draw = F.row_number().over(Window.partitionBy(*tile).orderBy(F.xxhash64(F.lit(seed), "pid"), "pid"))
    return cells.withColumn("_draw", draw).where(F.col("_draw") > F.col(keep)).drop("_draw")


def held_out_errors(points: DataFrame, tile: list[str], power: float = 2.0) -> DataFrame:
    """(tile, pid, error, distance): each point held out against the inverse-distance mean of the block means (by row, col) of
    its tile's other points, and the distance to the nearest of them. A point meets as many rows as its tile has cells."""
    kept = points.where("not held").groupBy(*tile, *K).agg(F.avg("x").alias("kx"), F.avg("y").alias("ky"), F.avg("z").alias("kz"))
    j = points.where("held").select(*tile, "pid", "x", "y", "z").join(kept.drop(*K), tile)
    d = F.greatest(F.sqrt(F.pow(F.col("x") - F.col("kx"), F.lit(2)) + F.pow(F.col("y") - F.col("ky"), F.lit(2))), F.lit(1e-9))
    w = F.pow("d", F.lit(-power))
    e = j.withColumn("d", d).groupBy(*tile, "pid", "x", "y", "z").agg((F.col("z") - F.sum(F.col("kz") * w) / F.sum(w)).alias("error"), F.min("d").alias("distance"))
    return e.select(*tile, "pid", "error", "distance")


def apply_curve(proximity: DataFrame, curve: tuple[float, float, float]) -> DataFrame:
    """c1 * v ^ c2 for each cell (no error where there is data)."""
    return proximity.select(*K, (F.lit(curve[1]) * F.pow("v", F.lit(curve[2]))).alias("v"))


def converge(sample, sims: int, tolerance: float = 1e-4, enough: int | None = None) -> tuple[tuple[float, float, float], int]:
    """Repeats sample(sim) -> errors, fits all errors so far, and stops after ``sims`` rounds, when the curve moves by less
    than the tolerance, or with ``enough`` errors. Errors are written to the shared folder round by round."""
    from sondegrid.session import materialize

    total, last, curve = None, None, GUESS
    for sim in range(sims):
        e = materialize(sample(sim).select("error", "distance"), "errors")
        total = e if total is None else total.unionByName(e)
        curve = error_curve(total)
        if curve == GUESS:  # no errors yet
            continue
        if (last is not None and sum(abs(a - b) for a, b in zip(curve, last)) < tolerance) or (enough is not None and total.count() >= enough):
            return curve, sim + 1
        last = curve
    return curve, sims
