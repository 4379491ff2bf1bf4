"""Interpolators: points or cells to a whole grid."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sondegrid.grid import GridSpec
from sondegrid.operators import cells as C, vector as V
from sondegrid.session import materialize

K = ["row", "col"]


def neighbourhood(cells: DataFrame, spec: GridSpec, k: int) -> DataFrame:
    """Every source cell under each target cell that has it within [-k, k) rows and columns."""
    r = F.explode(F.sequence(F.col("row") - (k - 1), F.col("row") + k))
    c = F.explode(F.sequence(F.col("col") - (k - 1), F.col("col") + k))
    rest = [x for x in cells.columns if x not in K]
    d = cells.select(r.alias("tr"), F.col("row").alias("sr"), F.col("col").alias("sc"), *rest)
    d = d.select("tr", F.explode(F.sequence(F.col("sc") - (k - 1), F.col("sc") + k)).alias("tc"), "sr", "sc", *rest)
    d = d.where(f"tr >= 0 and tr < {spec.ny} and tc >= 0 and tc < {spec.nx}")
    return d.select(F.col("tr").alias("row"), F.col("tc").alias("col"), "sr", "sc", *rest)


def _under(points: DataFrame, spec: GridSpec, k: int, z: str, w: str | None) -> DataFrame:
    """Points under each target cell, with their distance in degrees."""
    p = spec.index(points).select(*K, "x", "y", F.col(z).alias("z"), (F.col(w) if w else F.lit(1)).alias("w"))
    j = neighbourhood(p, spec, k)
    dx, dy = F.col("x") - spec.x(), F.col("y") - spec.y()
    return j.withColumn("dx", dx).withColumn("dy", dy).withColumn("d", F.sqrt(dx * dx + dy * dy))


def idw(points: DataFrame, spec: GridSpec, radius: float, power: float = 2.0, z: str = "z", w: str | None = None, compat: bool = False) -> DataFrame:
    """Inverse distance over a square window of cells. A point at the place of a cell gives the cell its value (several their
    mean). Weights multiply; with ``compat`` they divide by their power."""
    k = max(1, math.ceil(radius / spec.dx - 1e-9))
    j = _under(points, spec, k, z, w)
    f = F.pow("d", F.lit(-power)) * (F.pow("w", F.lit(-power)) if compat and w else F.col("w"))
    near = F.col("d") > 0
    v = F.coalesce(F.avg(F.when(~near, F.col("z"))), F.sum(F.when(near, F.col("z") * f)) / F.sum(F.when(near, f)))
    return j.groupBy(*K).agg(v.alias("v"))


def _ellipse(r1: float, r2: float, angle: float):
    a = math.radians(angle)
    u = F.col("dx") * F.lit(math.cos(a)) + F.col("dy") * F.lit(math.sin(a))
    v = F.col("dy") * F.lit(math.cos(a)) - F.col("dx") * F.lit(math.sin(a))
    return (u * u) / F.lit(r1 * r1) + (v * v) / F.lit(r2 * r2) <= 1


def invdst(points: DataFrame, spec: GridSpec, power: float = 2.0, smoothing: float = 0.0, radius1: float | None = None, radius2: float | None = None, angle: float = 0.0, max_points: int = 0, min_points: int = 0, z: str = "z") -> DataFrame:
    """Inverse distance within an ellipse, of at most ``max_points`` nearest points (ties by place), at least ``min_points``."""
    r1 = radius1 or 3 * spec.dx
    r2 = radius2 or r1
    j = _under(points, spec, max(1, math.ceil(max(r1, r2) / spec.dx) + 1), z, None).where(_ellipse(r1, r2, angle))
    if max_points:
        j = j.withColumn("k", F.row_number().over(Window.partitionBy(*K).orderBy("d", "x", "y", "z"))).where(F.col("k") <= max_points)
    d = F.sqrt(F.col("d") * F.col("d") + F.lit(smoothing * smoothing))
    f = F.pow(F.when(d > 0, d), F.lit(-power))
    v = F.coalesce(F.avg(F.when(d == 0, F.col("z"))), F.sum(F.col("z") * f) / F.sum(f))
    return j.groupBy(*K).agg(v.alias("v"), F.count("*").alias("_n")).where(F.col("_n") >= min_points).drop("_n")


def moving_average(points: DataFrame, spec: GridSpec, radius1: float | None = None, radius2: float | None = None, angle: float = 0.0, min_points: int = 0, z: str = "z") -> DataFrame:
    r1 = radius1 or 3 * spec.dx
    r2 = radius2 or r1
    j = _under(points, spec, max(1, math.ceil(max(r1, r2) / spec.dx) + 1), z, None).where(_ellipse(r1, r2, angle))
    return j.groupBy(*K).agg(F.avg("z").alias("v"), F.count("*").alias("n")).where(F.col("n") >= min_points)


def nearest(points: DataFrame, spec: GridSpec, radius: float | None = None, z: str = "z") -> DataFrame:
    """Value of the nearest point within the radius; of equally near ones the least value.

    Most cells of dense data are settled by the points of the cells around them: whatever lies farther off than those is more
    than a cell away. Only for the others, pairs of cells within reach are made of the cells that have data, and points looked
    up by them."""
    r = radius or 3 * spec.dx
    k = max(1, math.ceil(r / spec.dx) + 1)
    p = spec.index(points).select(*K, "x", "y", F.col(z).alias("z"))
    dx, dy = F.col("x") - spec.x(), F.col("y") - spec.y()
    least = F.min(F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), "z")).alias("m")

    def best(under: DataFrame) -> DataFrame:
        return under.groupBy(*K).agg(least).select(*K, F.col("m.d").alias("d"), F.col("m.z").alias("z"))

    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("j")) for i in (-1, 0, 1) for c in (-1, 0, 1)]))
    close = p.withColumn("_to", around).withColumns({"row": F.col("row") + F.col("_to.i"), "col": F.col("col") + F.col("_to.j")}).drop("_to")
    # a point of a cell two or more off is at least so far from the place of a cell
    sure = (2 - max(spec.half, 1 - spec.half)) * min(spec.dx, abs(spec.dy))
    first = best(close.where(f"row >= 0 and row < {spec.ny} and col >= 0 and col < {spec.nx}")).where(F.col("d") < F.lit(sure * (1 - 1e-9)))
    first = materialize(first, "nearest-close")
    pairs = neighbourhood(p.select(*K).distinct(), spec, k).join(first.select(*K), K, "left_anti")
    second = best(p.withColumnsRenamed({"row": "sr", "col": "sc"}).join(pairs, ["sr", "sc"]))
    return first.unionByName(second).where(F.col("d") <= F.lit(r)).select(*K, F.col("z").alias("v"))


def _spread(c: str, f: int, tile: int, halo: int, n: int):
    """Numbers of the tiles that need a cell of a grid f times as coarse as theirs."""
    lo, hi = F.floor((F.col(c) * f - (f - 1) * 2 - halo) / tile), F.floor((F.col(c) * f + (f - 1) * 3 + halo) / tile)
    return F.explode(F.sequence(F.greatest(F.lit(0), lo.cast("int")), F.least(F.lit((n - 1) // tile), hi.cast("int"))))


def relax(u: np.ndarray, fixed: np.ndarray, tension: float, rounds: int = 100_000, tol: float = 1e-6) -> np.ndarray:
    """Continuous-curvature spline in tension: fixed cells stay, the others relax from their start values to the discrete
    equation (1 - t) biharmonic - t harmonic = 0 by damped sweeps, until none moves by more than tol times the range; an error if that isn't reached."""
    tol *= max(np.ptp(u[fixed]) if fixed.any() else 0.0, 1e-12)
    for _ in range(rounds):
        p = np.pad(u, 2, mode="edge")
        n1 = p[1:-3, 2:-2] + p[3:-1, 2:-2] + p[2:-2, 1:-3] + p[2:-2, 3:-1]
        diag = p[1:-3, 1:-3] + p[1:-3, 3:-1] + p[3:-1, 1:-3] + p[3:-1, 3:-1]
        n2 = p[:-4, 2:-2] + p[4:, 2:-2] + p[2:-2, :-4] + p[2:-2, 4:]
        target = ((1 - tension) * (8 * n1 - 2 * diag - n2) + tension * n1) / (20 * (1 - tension) + 4 * tension)
        new = np.where(fixed, u, u + 0.5 * (target - u))  # beyond 0.6 the finest waves of the biharmonic part would grow
        change = np.abs(new - u).max()
        u = new
        if change < tol:
            return u
    raise ArithmeticError(f"no surface after {rounds} rounds")


def _wider(tension: float, s: int) -> float:
    """Tension of the same equation on cells s times as wide."""
    return tension * s * s / (1 - tension + tension * s * s)


def _between(a: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Values at fractional rows and columns, linear in both, held at the rim."""
    r, c = np.clip(rows, 0, a.shape[0] - 1), np.clip(cols, 0, a.shape[1] - 1)
    i, j = np.minimum(r.astype(int), max(a.shape[0] - 2, 0)), np.minimum(c.astype(int), max(a.shape[1] - 2, 0))
    k, m = np.minimum(i + 1, a.shape[0] - 1), np.minimum(j + 1, a.shape[1] - 1)
    fr, fc = (r - i)[:, None], (c - j)[None, :]
    return (1 - fr) * ((1 - fc) * a[np.ix_(i, j)] + fc * a[np.ix_(i, m)]) + fr * ((1 - fc) * a[np.ix_(k, j)] + fc * a[np.ix_(k, m)])


def relax_whole(a: np.ndarray, tension: float) -> np.ndarray:
    """The spline over one array, NaN where there is no data: each grid starts from that of cells twice as wide."""
    fixed = ~np.isnan(a)
    if max(a.shape) <= 4:
        start = np.full(a.shape, a[fixed].mean())
    else:
        p = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), constant_values=np.nan)
        p = p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2)
        n = (~np.isnan(p)).sum((1, 3))
        half = np.where(n > 0, np.nansum(p, (1, 3)) / np.maximum(n, 1), np.nan)
        start = _between(relax_whole(half, _wider(tension, 2)), (np.arange(a.shape[0]) - 0.5) / 2, (np.arange(a.shape[1]) - 0.5) / 2)
    return relax(np.where(fixed, np.nan_to_num(a), start), fixed, tension)


def _spline(cells: DataFrame, nx: int, ny: int, tension: float, tile: int, halo: int) -> DataFrame:
    """(row, col, v) of all cells of a grid. The first grid, of cells so wide that it is one tile, has all the data; each next
    one has cells half as wide and takes from the last its start and the rim of its tiles. The last grid is relaxed twice,
    the second time with the rims of the first. Tiles without data get theirs like all others."""
    scale = 1
    while -(-max(nx, ny) // scale) > tile:
        scale *= 2
    out = None
    for s, f in [(scale, 0), *((scale >> i, 2) for i in range(1, scale.bit_length())), *([(1, 1)] if scale > 1 else [])]:
        w, h, t = -(-nx // s), -(-ny // s), _wider(tension, s)
        at = [F.floor(F.col(c) / s).cast("int").alias(c) for c in K]
        d = cells.groupBy(*at).agg(F.avg("v").alias("v")).withColumn("data", F.lit(True)).withColumn("tr", _spread("row", 1, tile, halo, h)).withColumn("tc", _spread("col", 1, tile, halo, w))
        if out is not None:
            d = d.unionByName(out.withColumn("data", F.lit(False)).withColumn("tr", _spread("row", f, tile, halo, h)).withColumn("tc", _spread("col", f, tile, halo, w)))
        out = d.groupBy("tr", "tc").applyInPandas(_tile_kernel(w, h, f, t, tile, halo), "row int, col int, v double")
    return out


def _tile_kernel(w: int, h: int, f: int, tension: float, tile: int, halo: int):
    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile, key[1] * tile
        r1, c1 = min(r0 + tile, h), min(c0 + tile, w)
        ra, ca, rz, cz = max(r0 - halo, 0), max(c0 - halo, 0), min(r1 + halo, h), min(c1 + halo, w)
        a = np.full((rz - ra, cz - ca), np.nan)
        d = p[p["data"]]
        a[d["row"].to_numpy() - ra, d["col"].to_numpy() - ca] = d["v"].to_numpy()
        if not f:
            u = relax_whole(a, tension)
        else:
            g = p[~p["data"]]
            gr, gc = g["row"].to_numpy(), g["col"].to_numpy()
            last = np.zeros((np.ptp(gr) + 1, np.ptp(gc) + 1))
            last[gr - gr.min(), gc - gc.min()] = g["v"].to_numpy()
            start = _between(last, (np.arange(ra, rz) - (f - 1) / 2) / f - gr.min(), (np.arange(ca, cz) - (f - 1) / 2) / f - gc.min())
            fixed = ~np.isnan(a)
            u = np.where(fixed, np.nan_to_num(a), start)
            for side, inner in ((np.s_[:2], ra > 0), (np.s_[-2:], rz < h), (np.s_[:, :2], ca > 0), (np.s_[:, -2:], cz < w)):
                if inner:
                    fixed[side] = True
            u = relax(u, fixed, tension)
        rr, cc = np.mgrid[r0:r1, c0:c1]
        return pd.DataFrame({"row": rr.ravel().astype("int32"), "col": cc.ravel().astype("int32"), "v": u[r0 - ra : r1 - ra, c0 - ca : c1 - ca].ravel()})

    return run


def _plane(cells: DataFrame) -> tuple[float, float, float]:
    """Least-squares plane v = a + b row + c col; flat across where the cells lie on a line."""
    r, c, v = (F.col(x).cast("double") for x in (*K, "v"))
    m = cells.agg(F.avg(r), F.avg(c), F.avg(v), F.var_pop(r), F.covar_pop(r, c), F.var_pop(c), F.covar_pop(r, v), F.covar_pop(c, v)).first()
    if m[0] is None:
        return 0.0, 0.0, 0.0
    b = np.linalg.lstsq(np.array([[m[3], m[4]], [m[4], m[5]]]), np.array([m[6], m[7]]), rcond=1e-9)[0]
    return float(m[2] - b[0] * m[0] - b[1] * m[1]), float(b[0]), float(b[1])


def surface(points: DataFrame, spec: GridSpec, tension: float = 0.85, lower: float | None = None, upper: float | None = None, tile: int = 64, halo: int = 8, z: str = "z") -> DataFrame:
    """Block means, then a spline in tension over the whole grid, from wide cells to narrow ones and tile by tile with a halo;
    results may be held between limits."""
    means = materialize(C.block(points, spec, z).where("z is not null").select(*K, F.col("z").cast("double").alias("v")), "surface-means")
    a, b, c = _plane(means)
    trend = F.lit(a) + F.lit(b) * F.col("row") + F.lit(c) * F.col("col")
    out = _spline(means.withColumn("v", F.col("v") - trend), spec.nx, spec.ny, tension, tile, max(halo, 3)).withColumn("v", F.col("v") + trend)
    v = F.col("v")
    v = F.greatest(v, F.lit(float(lower))) if lower is not None else v
    return out.withColumn("v", F.least(v, F.lit(float(upper))) if upper is not None else v)


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Triangles (n, 3), counter-clockwise, of different points by insertion (Bowyer and Watson); none if all lie on a line.

    Each edge of the hull has a triangle with a point at infinity, whose circle is the half-plane beyond the edge. So nothing
    depends on far away coordinates, and points on a grid are judged exactly."""
    n = len(x)
    px, py = np.append(x - x.min(), 0.0) if n else x, np.append(y - y.min(), 0.0) if n else y
    turn = lambda a, b, c: (px[b] - px[a]) * (py[c] - py[a]) - (py[b] - py[a]) * (px[c] - px[a])
    if n < 3:
        return np.empty((0, 3), int)
    third = np.flatnonzero(turn(0, 1, np.arange(n)))
    if not len(third):
        return np.empty((0, 3), int)
    a, b, c = (0, 1, int(third[0])) if turn(0, 1, int(third[0])) > 0 else (1, 0, int(third[0]))
    tri = np.array([[a, b, c], [b, a, n], [c, b, n], [a, c, n]])
    for i in range(2, n):
        if i == c:
            continue
        u, v, w = tri.T
        far = w == n
        ux, uy, vx, vy, wx, wy = px[u] - px[i], py[u] - py[i], px[v] - px[i], py[v] - py[i], px[w] - px[i], py[w] - py[i]
        circle = (ux * ux + uy * uy) * (vx * wy - vy * wx) + (vx * vx + vy * vy) * (wx * uy - wy * ux) + (wx * wx + wy * wy) * (ux * vy - uy * vx)
        side = ux * vy - uy * vx  # of the edge u v, seen from the point
        bad = np.where(far, (side > 0) | ((side == 0) & (ux * vx + uy * vy < 0)), circle > 0)
        e = tri[bad][:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2)
        rim = e[~np.isin(e[:, 0] * (n + 1) + e[:, 1], e[:, 1] * (n + 1) + e[:, 0])]
        new = np.column_stack([rim, np.full(len(rim), i)])
        new[rim[:, 0] == n] = new[rim[:, 0] == n][:, [1, 2, 0]]  # the point at infinity comes last
        new[rim[:, 1] == n] = new[rim[:, 1] == n][:, [2, 0, 1]]
        tri = np.concatenate([tri[~bad], new])
    return tri[tri[:, 2] < n]


def _clip(ring: np.ndarray, axis: int, limit: float, sign: int) -> np.ndarray:
    """The part of a convex ring where sign * (coordinate - limit) >= 0."""
    out = []
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
        if da >= 0:
            out.append(a)
        if da * db < 0:
            out.append(a + (b - a) * (da / (da - db)))
    return np.array(out).reshape(-1, 2)


def _inside(ring: np.ndarray, x, y, slack: float = 1e-7):
    """In a convex counter-clockwise ring or on it."""
    ok = np.ones(np.shape(x), bool)
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        ok &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -slack
    return ok


def _meets(ring: np.ndarray, x: float, y: float, r: float) -> bool:
    """A circle has a point of a convex ring's area inside it."""
    if not len(ring):
        return False
    if len(ring) > 2 and _inside(ring, x, y):
        return True
    a, e = ring, np.roll(ring, -1, axis=0) - ring
    t = np.clip(((x - a[:, 0]) * e[:, 0] + (y - a[:, 1]) * e[:, 1]) / np.maximum((e**2).sum(1), 1e-300), 0, 1)
    return bool((np.hypot(a[:, 0] + t * e[:, 0] - x, a[:, 1] + t * e[:, 1] - y) < r * (1 - 1e-9)).any())


def barycentric(row, col, v, rr, cc, beyond=()):
    """Linear interpolation over the triangles of a tile's data: values, NaN outside the triangles, and whether each is settled:
    the circle about its triangle has none of the areas ``beyond``, where more data may be."""
    out, sure = np.full(rr.shape, np.nan), np.zeros(rr.shape, bool)
    if len(v) < 3:
        return out, sure
    for t in delaunay(col.astype(float), row.astype(float)):
        x, y, z = col[t].astype(float), row[t].astype(float), v[t]
        d = (y[1] - y[2]) * (x[0] - x[2]) + (x[2] - x[1]) * (y[0] - y[2])
        if d == 0:
            continue
        box = (cc >= x.min()) & (cc <= x.max()) & (rr >= y.min()) & (rr <= y.max())
        if not box.any():
            continue
        px, py = cc[box], rr[box]
        a = ((y[1] - y[2]) * (px - x[2]) + (x[2] - x[1]) * (py - y[2])) / d
        b = ((y[2] - y[0]) * (px - x[2]) + (x[0] - x[2]) * (py - y[2])) / d
        c = 1 - a - b
        hit = (a >= -1e-9) & (b >= -1e-9) & (c >= -1e-9)
        if not hit.any():
            continue
        part = out[box]
        part[hit] = (a * z[0] + b * z[1] + c * z[2])[hit]
        out[box] = part
        ex, ey, fx, fy = x[1] - x[0], y[1] - y[0], x[2] - x[0], y[2] - y[0]
        g = 2 * (ex * fy - ey * fx)
        ux, uy = (fy * (ex**2 + ey**2) - ey * (fx**2 + fy**2)) / g, (ex * (fx**2 + fy**2) - fx * (ex**2 + ey**2)) / g
        part = sure[box]
        part[hit] = not any(_meets(q, x[0] + ux, y[0] + uy, math.hypot(ux, uy)) for q in beyond)
        sure[box] = part
    return out, sure


def triangulate(points: DataFrame, spec: GridSpec, tile: int = 32, halo: int = 8, z: str = "z") -> DataFrame:
    """Block means, then linear interpolation over the Delaunay triangles of all of them, tile by tile. A tile whose triangles
    data beyond its halo may change, or that has cells of the hull in no triangle, is done again with twice the halo."""
    means = materialize(C.block(points, spec, z).where("z is not null").select(*K, F.col("z").cast("double").alias("v")), "triangle-means")
    spark, nx, ny = means.sparkSession, spec.nx, spec.ny
    schema = "tr int, tc int, row int, col int, v double"
    corners = V.convex_hull(means.select(F.lit(0).alias("g"), F.col("col").alias("x"), F.col("row").alias("y")), ["g"]).first()
    ring = np.array([list(map(float, q.split())) for q in corners["wkt"][10:-2].split(",")[:-1]]) if corners else np.zeros((0, 2))
    if len(ring) < 3:
        return means.limit(0)
    w, h = -(-nx // tile), -(-ny // tile)
    todo = spark.range(w * h).select(F.floor(F.col("id") / w).cast("int").alias("tr"), (F.col("id") % w).cast("int").alias("tc"))
    done = []
    while True:
        run = _triangle_kernel(ring, nx, ny, tile, halo)
        b = max(tile, halo)  # cells meet tiles by blocks as wide as the halo
        span = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) * tile - halo) / b).cast("int")), F.least(F.lit((n - 1) // b), F.floor((F.col(c) * tile + tile - 1 + halo) / b).cast("int"))))  # noqa: B023, E731
        need = todo.withColumn("br", span("tr", ny)).withColumn("bc", span("tc", nx))
        data = means.withColumn("br", F.floor(F.col("row") / b).cast("int")).withColumn("bc", F.floor(F.col("col") / b).cast("int"))
        near = need.join(data, ["br", "bc"], "left").drop("br", "bc")
        out = materialize(near.groupBy("tr", "tc").applyInPandas(run, schema), "triangles")
        done.append(out.where("row is not null").select(*K, "v"))
        todo = out.where("row is null").select("tr", "tc")
        if halo >= max(nx, ny) or todo.isEmpty():
            return reduce(DataFrame.unionByName, done)
        halo = max(halo * 2, 1)


def _triangle_kernel(ring: np.ndarray, nx: int, ny: int, tile: int, halo: int):
    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile, key[1] * tile
        r1, c1 = min(r0 + tile, ny), min(c0 + tile, nx)
        rr, cc = np.mgrid[r0:r1, c0:c1]
        want = _inside(ring, cc, rr)
        none = {"tr": [], "tc": [], "row": [], "col": [], "v": []}
        if not want.any():
            return pd.DataFrame(none)
        p = p[(p["row"] >= r0 - halo) & (p["row"] < r1 + halo) & (p["col"] >= c0 - halo) & (p["col"] < c1 + halo)]
        beyond = [_clip(ring, *side) for side in ((1, r0 - halo - 1, -1), (1, r1 + halo, 1), (0, c0 - halo - 1, -1), (0, c1 + halo, 1))]
        beyond = [q for q in beyond if len(q)]
        v, sure = barycentric(p["row"].to_numpy().astype(int), p["col"].to_numpy().astype(int), p["v"].to_numpy(), rr, cc, beyond)
        if beyond and not sure[want].all():
            return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "row": [None], "col": [None], "v": [None]})
        ok = want & ~np.isnan(v)
        return pd.DataFrame({"tr": key[0], "tc": key[1], "row": rr[ok].astype("int32"), "col": cc[ok].astype("int32"), "v": v[ok]})

    return run


def linear(points: DataFrame, spec: GridSpec, radius: float | None = None, z: str = "z") -> DataFrame:
    """Triangulation; outside the triangles the nearest point within the radius."""
    return triangulate(points, spec, z=z).withColumn("p", F.lit(0)).unionByName(nearest(points, spec, radius, z).withColumn("p", F.lit(1))).groupBy(*K).agg(F.min_by("v", "p").alias("v"))


def masked_spline(points: DataFrame, spec: GridSpec, reach: int = 10, tension: float = 0.35, z: str = "z") -> DataFrame:
    """Spline in tension kept within so many cells of data."""
    from sondegrid.operators.focal import proximity

    near = proximity(C.mask(points, spec), spec).where(F.col("d2") <= reach * reach).select(*K)
    return surface(points, spec, tension, z=z).join(near, K, "left_semi")
