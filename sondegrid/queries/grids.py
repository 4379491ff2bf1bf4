"""Map algebra, neighbourhoods, interpolation, polygons, uncertainty, sets, connectors' parsers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sondegrid.grid import GridSpec
from sondegrid.operators import algebra as A, cells as C, focal as N, interp as I, uncertainty as U, vector as V, ranks
from sondegrid.queries._base import CELLS, KEPT, LATTICE, PTS, SPEC, Registry, pts, table
from sondegrid.queries.points import INSIDE_CELLS, WITHIN, _CENTRES, diamond
from sondegrid.region import Region, chunks

q = Registry()
K = ["row", "col"]


def summed(spark, d, *more):
    return C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v"), *more)


def flag(t, v):
    return t.withColumn("part", F.lit(v))


# --- map algebra -----------------------------------------------------------------------------------------------------
@q("ra01_split", f"WITH {CELLS} SELECT row, col, s AS v, CASE WHEN s >= 0 THEN 'u' ELSE 'l' END AS part FROM cells")
def _(spark, d):
    u, low = A.split(summed(spark, d), 0)
    return flag(u, "u").unionByName(flag(low, "l"))


@q("ra01_split_compat", f"WITH {CELLS} SELECT row, col, n AS v, CASE WHEN n > 140 THEN 'u' ELSE 'l' END AS part FROM cells WHERE n <> 140")
def _(spark, d):
    u, low = A.split(C.count(pts(spark, d), SPEC), 140.7, compat=True)
    return flag(u, "u").unionByName(flag(low, "l"))


@q("ra02_mask", f"WITH {CELLS}, {LATTICE} SELECT l.row, l.col, CASE WHEN c.s IS NULL THEN 0 ELSE 1 END AS v FROM lattice l LEFT JOIN (SELECT * FROM cells WHERE s > 0) c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    return A.presence(summed(spark, d).where("v > 0"), SPEC)


@q("ra03_invert_mask", f"WITH {CELLS}, {LATTICE} SELECT l.row, l.col, CASE WHEN c.s IS NULL THEN 1 ELSE 0 END AS v FROM lattice l LEFT JOIN (SELECT * FROM cells WHERE s > 0) c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    return A.invert(A.presence(summed(spark, d).where("v > 0"), SPEC))


@q("ra04_number_mask", f"WITH {CELLS}, {LATTICE} SELECT l.row, l.col, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS v FROM lattice l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    return A.presence(C.count(pts(spark, d), SPEC).where("v % 2 = 0"), SPEC)


@q("ra05_calc_product", f"WITH {CELLS} SELECT row, col, s * n AS v FROM cells")
def _(spark, d):
    return A.calc(summed(spark, d), C.count(pts(spark, d), SPEC), lambda a, b: a * b)


@q("ra05_calc_mean", f"WITH {CELLS} SELECT row, col, (s + n) / 2.0E0 AS v FROM cells")
def _(spark, d):
    return A.calc(summed(spark, d), C.count(pts(spark, d), SPEC), lambda a, b: (a + b) / F.lit(2.0))


@q("ra05_calc_power", f"WITH {CELLS} SELECT row, col, round(0.5E0 + 1.5E0 * pow(n, 0.3E0), 6) AS v FROM cells")
def _(spark, d):
    return A.calc(C.count(pts(spark, d), SPEC), None, lambda a: F.round(F.lit(0.5) + F.lit(1.5) * F.pow(a, F.lit(0.3)), 6))


@q("ra06_cut", f"WITH {CELLS} SELECT row - 6 AS row, col - 4 AS col, s AS v FROM cells WHERE col >= 4 AND col < 12 AND row >= 6 AND row < 14")
def _(spark, d):
    return A.cut(summed(spark, d), SPEC, Region(-89.8, -89.4, 29.3, 29.7))[0]


@q("ra07_crop", f"WITH {CELLS}, k AS (SELECT * FROM cells WHERE row BETWEEN 3 AND 9 AND col BETWEEN 2 AND 17 AND n % 2 = 0) SELECT row - (SELECT min(row) FROM k) AS row, col - (SELECT min(col) FROM k) AS col, s AS v FROM k")
def _(spark, d):
    c = summed(spark, d, F.count("*").alias("n")).where("row between 3 and 9 and col between 2 and 17 and n % 2 = 0")
    return A.crop(c.select(*K, "v"))


@q("ra08_clip", f"WITH {CELLS}, {LATTICE}, {_CENTRES}, {INSIDE_CELLS} SELECT c.row, c.col, c.s AS v FROM cells c LEFT JOIN inside i ON c.row = i.row AND c.col = i.col WHERE i.row IS NULL")
def _(spark, d):
    return A.clip_polygon(summed(spark, d), SPEC, diamond())


@q("ra08_clip_invert", f"WITH {CELLS}, {LATTICE}, {_CENTRES}, {INSIDE_CELLS} SELECT c.row, c.col, c.s AS v FROM cells c JOIN inside i ON c.row = i.row AND c.col = i.col")
def _(spark, d):
    return A.clip_polygon(summed(spark, d), SPEC, diamond(), invert=True)


@q("ra09_find_replace", f"WITH {CELLS} SELECT row, col, CASE WHEN n % 5 = 3 THEN 99 ELSE n % 5 END AS v FROM cells")
def _(spark, d):
    c = C.count(pts(spark, d), SPEC).withColumn("v", F.col("v") % 5)
    return A.replace(c, 3, 99)


@q("ra10_chunks", f"WITH {CELLS}, t AS (SELECT row, col, CASE WHEN row < 5 THEN 1 ELSE n END AS v, row // 5 AS trow, col // 5 AS tcol FROM cells), f AS (SELECT trow, tcol, col, min(v) = max(v) AS same FROM t GROUP BY trow, tcol, col), g AS (SELECT trow, tcol FROM f GROUP BY trow, tcol HAVING NOT bool_and(same)) SELECT t.trow, t.tcol, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM t JOIN g ON t.trow = g.trow AND t.tcol = g.tcol GROUP BY t.trow, t.tcol")
def _(spark, d):
    c = C.count(pts(spark, d), SPEC).withColumn("v", F.when(F.col("row") < 5, F.lit(1).cast("bigint")).otherwise(F.col("v")))
    return A.tiles(c, 5).groupBy("trow", "tcol").agg(F.count("*").alias("n"), F.sum("v").alias("s"))


@q("ra11_region_chunk", "WITH c AS (SELECT CAST(i.range AS DOUBLE) AS i, CAST(j.range AS DOUBLE) AS j FROM range(3) i, range(3) j) SELECT CAST(i * 3 + j AS BIGINT) AS chunk, i * 4 AS xmin, least((i + 1) * 4, 10.0E0) AS xmax, j * 4 AS ymin, least((j + 1) * 4, 10.0E0) AS ymax FROM c")
def _(spark, d):
    return chunks(spark, Region(0.0, 10.0, 0.0, 10.0), 1.0, 4)


@q("ra13_rasterize", f"WITH {LATTICE}, {_CENTRES}, {INSIDE_CELLS} SELECT l.row, l.col, CASE WHEN i.row IS NULL THEN 0 ELSE 1 END AS v FROM lattice l LEFT JOIN inside i ON l.row = i.row AND l.col = i.col")
def _(spark, d):
    return A.rasterize(spark, SPEC, diamond())


@q("sk11_null_grid", f"WITH {LATTICE} SELECT row, col, -9999.0E0 AS v FROM lattice")
def _(spark, d):
    return SPEC.lattice(spark).withColumn("v", F.lit(-9999.0))


@q("sk12_null_copy", f"WITH {CELLS}, {LATTICE} SELECT row, col, -1 AS v FROM lattice")
def _(spark, d):
    return C.dense(summed(spark, d).limit(0), SPEC, -1).select(*K, F.col("v").cast("int").alias("v"))


@q("ra16_filter_lower", f"WITH {CELLS} SELECT row, col, s AS v FROM cells")
def _(spark, d):
    u, low = A.split(summed(spark, d), 0)
    return A.recombine(u, low)


# --- sets ------------------------------------------------------------------------------------------------------------
@q("st01_union_all", f"WITH {PTS} SELECT count(*) * 2 AS n FROM pts")
def _(spark, d):
    p = pts(spark, d)
    return p.unionByName(p).agg(F.count("*").alias("n"))


@q("st02_mosaic", f"WITH {CELLS}, p AS (SELECT row, col, s AS v, 1 AS part FROM cells UNION ALL SELECT row, col, n, 2 FROM cells WHERE n % 2 = 0) SELECT row, col, max_by(v, part) AS v FROM p GROUP BY row, col")
def _(spark, d):
    c = summed(spark, d, F.count("*").alias("n"))
    return A.mosaic(flag(c.select(*K, "v"), 1).unionByName(flag(c.where("n % 2 = 0").select(*K, F.col("n").alias("v")), 2)))


@q("st03_append_vectors", "SELECT r_regionkey AS id, r_name AS name, NULL AS parent FROM region UNION ALL SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) FROM nation")
def _(spark, d):
    a = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("parent"))
    return a.unionByName(b, allowMissingColumns=True)


@q("st04_complement", f"WITH {PTS} SELECT pid, x, y FROM pts WHERE NOT {WITHIN}")
def _(spark, d):
    from sondegrid.geom import within

    p = pts(spark, d)
    return p.select("pid", "x", "y").exceptAll(p.where(within(diamond(), F.col("x"), F.col("y"))).select("pid", "x", "y"))


@q("st06_recombine", f"WITH {CELLS} SELECT row, col, CASE WHEN s > 0 THEN s ELSE 0 END + CASE WHEN n % 2 = 0 THEN n ELSE 0 END AS v FROM cells WHERE s > 0 OR n % 2 = 0")
def _(spark, d):
    c = summed(spark, d, F.count("*").alias("n"))
    return A.recombine(c.where("v > 0").select(*K, "v"), c.where("n % 2 = 0").select(*K, F.col("n").alias("v")))


# --- sort, limit, sampling -------------------------------------------------------------------------------------------
@q("so01_topk_area", "WITH b AS (SELECT DISTINCT file_id AS fid, (minmax[2] - minmax[1]) * (minmax[4] - minmax[3]) AS area FROM inf_files WHERE minmax IS NOT NULL) SELECT fid, area FROM b WHERE area IS NOT NULL ORDER BY area DESC, fid LIMIT 8")
def _(spark, d):
    from sondegrid.queries._base import boxes

    b = boxes(spark, d).select(F.col("file_id").alias("fid"), F.lit(1).alias("dn"), ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("area"))
    return V.largest(b.where("area is not null")).select("fid", "area")


@q("so03_seeded_sample", f"WITH {PTS} SELECT pid FROM pts ORDER BY (pid * 7919 + 17) % 1000003, pid LIMIT 100")
def _(spark, d):
    return pts(spark, d).orderBy((F.col("pid") * 7919 + 17) % 1000003, "pid").limit(100).select("pid")


@q("so06_row_major", f"WITH {CELLS} SELECT row, col, s AS v, row_number() OVER (ORDER BY row, col) AS k FROM cells")
def _(spark, d):
    # places in row-major order from counts by row, so nothing is ordered in one task
    c = summed(spark, d)
    before = c.groupBy("row").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("row")) - F.col("n"))
    k = F.row_number().over(Window.partitionBy("row").orderBy("col"))
    return c.withColumn("r", k).join(before.select("row", "before"), "row").select(*K, "v", (F.col("r") + F.col("before")).alias("k"))


# --- neighbourhoods --------------------------------------------------------------------------------------------------
_KERNEL = "k AS (SELECT CAST(a.range AS INT) - 1 AS i, CAST(b.range AS INT) - 1 AS j FROM range(3) a, range(3) b), w AS (SELECT i, j, exp(-(i * i + j * j) / 1.0E0) / (SELECT sum(exp(-(i * i + j * j) / 1.0E0)) FROM k) AS w FROM k)"


@q("wn01_gaussian_blur", f"WITH {CELLS}, {LATTICE}, {_KERNEL}, t AS (SELECT l.row, l.col, CASE WHEN l.row + i < 0 THEN -1 - (l.row + i) WHEN l.row + i > 19 THEN 39 - (l.row + i) ELSE l.row + i END AS r, CASE WHEN l.col + j < 0 THEN -1 - (l.col + j) WHEN l.col + j > 19 THEN 39 - (l.col + j) ELSE l.col + j END AS c, w FROM lattice l, w) SELECT t.row, t.col, round(sum(coalesce(c.n, 0) * w), 6) AS v FROM t LEFT JOIN cells c ON t.r = c.row AND t.c = c.col GROUP BY t.row, t.col HAVING (t.row, t.col) IN (SELECT (row, col) FROM cells)")
def _(spark, d):
    return N.blur(C.count(pts(spark, d), SPEC), SPEC, 1).select(*K, F.round("v", 6).alias("v"))


@q("wn02_blur_nodata", f"WITH {CELLS}, {LATTICE}, {_KERNEL}, e AS (SELECT * FROM cells WHERE n % 3 <> 0), t AS (SELECT l.row, l.col, CASE WHEN l.row + i < 0 THEN -1 - (l.row + i) WHEN l.row + i > 19 THEN 39 - (l.row + i) ELSE l.row + i END AS r, CASE WHEN l.col + j < 0 THEN -1 - (l.col + j) WHEN l.col + j > 19 THEN 39 - (l.col + j) ELSE l.col + j END AS c, w FROM e l, w) SELECT t.row, t.col, round(sum(coalesce(c.n, 0) * w), 6) AS v FROM t LEFT JOIN e c ON t.r = c.row AND t.c = c.col GROUP BY t.row, t.col")
def _(spark, d):
    return N.blur(C.count(pts(spark, d), SPEC).where("v % 3 <> 0"), SPEC, 1).select(*K, F.round("v", 6).alias("v"))


@q("wn04_moving_windows", "SELECT CAST(c.range * 4 AS INT) AS x, CAST(r.range * 4 AS INT) AS y, CAST(least(4, 10 - c.range * 4) AS INT) AS nx, CAST(least(4, 10 - r.range * 4) AS INT) AS ny FROM range(3) r, range(3) c")
def _(spark, d):
    return N.windows(10, 10, 4, 4, spark)


_GRAD = "g AS (SELECT row, col, s AS v, CASE WHEN lag(s) OVER w IS NOT NULL AND lead(s) OVER w IS NOT NULL THEN (lead(s) OVER w - lag(s) OVER w) / 2.0E0 WHEN lead(s) OVER w IS NOT NULL THEN (lead(s) OVER w - s) / 1.0E0 WHEN lag(s) OVER w IS NOT NULL THEN (s - lag(s) OVER w) / 1.0E0 ELSE 0 END AS g FROM cells WINDOW w AS (PARTITION BY col ORDER BY row))"


@q("wn05_outlier_fences", f"WITH {CELLS}, {_GRAD}, t AS (SELECT *, row // 10 AS trow, col // 10 AS tcol FROM g), f AS (SELECT trow, tcol, quantile_cont(CAST(v AS DOUBLE), 0.25) AS v1, quantile_cont(CAST(v AS DOUBLE), 0.75) AS v3, quantile_cont(g, 0.25) AS g1, quantile_cont(g, 0.75) AS g3 FROM t GROUP BY trow, tcol) SELECT row, col, v FROM t JOIN f ON t.trow = f.trow AND t.tcol = f.tcol WHERE (v > v3 + 0.75E0 * (v3 - v1) OR v < v1 - 0.75E0 * (v3 - v1)) AND (g > g3 + 0.75E0 * (g3 - g1) OR g < g1 - 0.75E0 * (g3 - g1))")
def _(spark, d):
    return N.outliers(summed(spark, d), 10, 0.75)


@q("wn05_outlier_windows")
def _(spark, d):
    return N.outliers_iterated(summed(spark, d), SPEC, 10)


_HORN = "o AS (SELECT CAST(a.range AS INT) - 1 AS dr, CAST(b.range AS INT) - 1 AS dc FROM range(3) a, range(3) b), h AS (SELECT c.row - dr AS row, c.col - dc AS col, count(*) AS k, CAST(sum(n * dc * (2 - abs(dr))) AS DOUBLE) AS gx, CAST(sum(n * dr * (2 - abs(dc))) AS DOUBLE) AS gy FROM cells c, o GROUP BY 1, 2 HAVING count(*) = 9 AND c.row - dr BETWEEN 0 AND 19 AND c.col - dc BETWEEN 0 AND 19)"


@q("wn06_slope", f"WITH {CELLS}, {_HORN} SELECT row, col, round(degrees(atan(sqrt(pow(gx / 4000, 2) + pow(gy / 4000, 2)))), 6) AS v FROM h")
def _(spark, d):
    return N.slope(C.count(pts(spark, d), SPEC), SPEC, 10_000.0).select(*K, F.round("v", 6).alias("v"))


@q("wn07_gradient_slope", f"WITH {CELLS}, {_HORN} SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy) / 4000)), 5) AS v FROM h")
def _(spark, d):
    return N.slope(C.count(pts(spark, d), SPEC), SPEC, 10_000.0).select(*K, F.round("v", 5).alias("v"))


@q("wn08_hillshade", f"WITH {CELLS}, {_HORN}, s AS (SELECT row, col, gx / 40000 AS p, gy / 40000 AS r FROM h) SELECT row, col, round(greatest(1.0E0, 1 + 254 * (sin(radians(45)) - cos(radians(45)) * (p * sin(radians(315)) - r * cos(radians(315)))) / sqrt(1 + p * p + r * r)), 4) AS v FROM s")
def _(spark, d):
    return N.hillshade(C.count(pts(spark, d), SPEC), SPEC, scale=100_000.0).select(*K, F.round("v", 4).alias("v"))


@q("wn09_proximity", f"WITH {CELLS}, {LATTICE}, t AS (SELECT row, col FROM cells WHERE n % 7 = 0) SELECT l.row, l.col, CAST(min((l.row - t.row) * (l.row - t.row) + (l.col - t.col) * (l.col - t.col)) AS BIGINT) AS d2 FROM lattice l LEFT JOIN t ON true GROUP BY l.row, l.col")
def _(spark, d):
    return N.proximity(C.count(pts(spark, d), SPEC).where("v % 7 = 0"), SPEC)


@q("wn10_cosine_filter", f"WITH {CELLS}, k AS (SELECT CAST(a.range AS INT) - 2 AS i, CAST(b.range AS INT) - 2 AS j FROM range(5) a, range(5) b), w AS (SELECT i, j, 1 + cos(pi() * sqrt(i * i + j * j) / 2) AS w FROM k WHERE sqrt(i * i + j * j) < 2) SELECT c.row - i AS row, c.col - j AS col, round(sum(n * w) / sum(w), 6) AS v FROM cells c, w WHERE c.row - i BETWEEN 0 AND 19 AND c.col - j BETWEEN 0 AND 19 GROUP BY 1, 2")
def _(spark, d):
    return N.focal_mean(C.count(pts(spark, d), SPEC), SPEC, N.cosine_kernel(2)).select(*K, F.round("v", 6).alias("v"))


@q("wn12_resample", f"WITH {CELLS}, t AS (SELECT CAST(r.range AS INT) AS tr, CAST(c.range AS INT) AS tc, (-90.0E0 + c.range * 0.125E0 + 90.0E0) / 0.05E0 AS fx, (30.0E0 + r.range * -0.125E0 - 30.0E0) / -0.05E0 AS fy FROM range(8) r, range(8) c), s AS (SELECT tr, tc, CAST(floor(fy) AS INT) + a.range AS row, CAST(floor(fx) AS INT) + b.range AS col, (1 - abs(fx - (floor(fx) + b.range))) * (1 - abs(fy - (floor(fy) + a.range))) AS k FROM t, range(2) a, range(2) b) SELECT tr AS row, tc AS col, round(sum(n * k) / sum(k), 6) AS v FROM s JOIN cells c ON s.row = c.row AND s.col = c.col WHERE k > 0 GROUP BY tr, tc")
def _(spark, d):
    t = GridSpec.from_region(Region(-90.0, -89.0, 29.0, 30.0), 0.125)
    return N.resample(C.count(pts(spark, d), SPEC), SPEC, t).select(*K, F.round("v", 6).alias("v"))


@q("wn13_gradient", f"WITH {CELLS}, {_GRAD} SELECT row, col, v, g FROM g")
def _(spark, d):
    return N.gradient(summed(spark, d)).select(*K, "v", F.col("g").cast("double").alias("g"))


# --- interpolation ---------------------------------------------------------------------------------------------------
def _near(k: int) -> str:
    return f"o AS (SELECT CAST(a.range AS INT) - {k} AS dr, CAST(b.range AS INT) - {k} AS dc FROM range({2 * k}) a, range({2 * k}) b), u AS (SELECT k.row - dr AS row, k.col - dc AS col, k.x - (-90.0E0 + (k.col - dc) * 0.05E0) AS dx, k.y - (30.0E0 + (k.row - dr) * -0.05E0) AS dy, zc AS z, w FROM kept k, o WHERE k.row - dr BETWEEN 0 AND 19 AND k.col - dc BETWEEN 0 AND 19), p AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM u)"


@q("gr03_nearest", f"WITH {KEPT}, {_near(4)} SELECT row, col, min_by(z, (d, z)) AS v FROM p WHERE d <= 0.15E0 GROUP BY row, col".replace("min_by(z, (d, z))", "arg_min(z, struct_pack(d := d, z := z))"))
def _(spark, d):
    return I.nearest(pts(spark, d), SPEC, z="zc")


@q("gr04_num", f"WITH {CELLS} SELECT row, col, n, CAST(s AS DOUBLE) / n AS m FROM cells")
def _(spark, d):
    return C.aggregate(pts(spark, d), SPEC, F.count("*").alias("n"), F.avg("zc").alias("m"))


@q("gr05_idw", f"WITH {KEPT}, {_near(1)} SELECT row, col, round(coalesce(avg(CASE WHEN d = 0 THEN z END), sum(CASE WHEN d > 0 THEN z * pow(d, -2) END) / sum(CASE WHEN d > 0 THEN pow(d, -2) END)), 2) AS v FROM p GROUP BY row, col")
def _(spark, d):
    return I.idw(pts(spark, d), SPEC, 0.05, z="zc").select(*K, F.round("v", 2).alias("v"))


@q("gr05_idw_weighted", f"WITH {KEPT}, {_near(1)} SELECT row, col, round(coalesce(avg(CASE WHEN d = 0 THEN z END), sum(CASE WHEN d > 0 THEN z * pow(d, -2) * w END) / sum(CASE WHEN d > 0 THEN pow(d, -2) * w END)), 2) AS v FROM p GROUP BY row, col")
def _(spark, d):
    return I.idw(pts(spark, d), SPEC, 0.05, z="zc", w="w").select(*K, F.round("v", 2).alias("v"))


@q("gr05_idw_compat", f"WITH {KEPT}, {_near(1)} SELECT row, col, round(coalesce(avg(CASE WHEN d = 0 THEN z END), sum(CASE WHEN d > 0 THEN z * pow(d, -2) * pow(w, -2) END) / sum(CASE WHEN d > 0 THEN pow(d, -2) * pow(w, -2) END)), 2) AS v FROM p GROUP BY row, col")
def _(spark, d):
    return I.idw(pts(spark, d), SPEC, 0.05, z="zc", w="w", compat=True).select(*K, F.round("v", 2).alias("v"))


@q("gr06_invdst", f"WITH {KEPT}, {_near(3)}, e AS (SELECT * FROM p WHERE dx * dx / (0.1E0 * 0.1E0) + dy * dy / (0.05E0 * 0.05E0) <= 1), s AS (SELECT *, sqrt(d * d + 0.0001E0) AS ds FROM e) SELECT row, col, round(sum(z * pow(ds, -2)) / sum(pow(ds, -2)), 2) AS v FROM s GROUP BY row, col HAVING count(*) >= 3")
def _(spark, d):
    return I.invdst(pts(spark, d), SPEC, smoothing=0.01, radius1=0.1, radius2=0.05, min_points=3, z="zc").select(*K, F.round("v", 2).alias("v"))


@q("gr07_average", f"WITH {KEPT}, {_near(3)} SELECT row, col, CAST(sum(z) AS DOUBLE) / count(*) AS v, count(*) AS n FROM p WHERE dx * dx / (0.1E0 * 0.1E0) + dy * dy / (0.1E0 * 0.1E0) <= 1 GROUP BY row, col HAVING count(*) >= 5")
def _(spark, d):
    return I.moving_average(pts(spark, d), SPEC, 0.1, min_points=5, z="zc")


#: Cells with gaps between them, corners included, and the heights of a plane.
_GAPS = "(row * 7 + col * 3) % 5 = 0 OR ((row = 0 OR row = 19) AND (col = 0 OR col = 19))"
_FLAT = "SELECT row, col, round(3 + col * 0.1E0 + (row - 20) * 0.25E0, 4) AS v FROM ({})"
_KNOTS = f"WITH {CELLS}, {LATTICE}, e AS (SELECT row, col, CAST(s AS DOUBLE) / n / 100000 AS v FROM cells WHERE {_GAPS})"


def _gapped(spark, d):
    return SPEC.index(pts(spark, d)).where(_GAPS).withColumn("z", F.col("zc") / F.lit(100_000.0))


def _flat(spark, d, f):
    """An interpolator over points at the cells' places on a plane."""
    p = _gapped(spark, d).withColumn("z", F.lit(3.0) + F.col("col") * 0.1 + (F.col("row") - 20) * 0.25).select("x", "y", "z")
    return f(p).select(*K, F.round("v", 4).alias("v"))


def _knots(spark, d, f):
    """An interpolator's cells, with its values where there are data."""
    p = _gapped(spark, d)
    at = p.select(*K).distinct().withColumn("own", F.lit(True))
    return f(p.select("x", "y", "z")).join(at, K, "left").select(*K, F.when(F.col("own"), F.round(F.col("v") + 1.23e-6, 5)).alias("v"))


@q("gr01_surface", _KNOTS + " SELECT l.row, l.col, round(e.v + 1.23E-6, 5) AS v FROM lattice l LEFT JOIN e ON l.row = e.row AND l.col = e.col")
def _(spark, d):
    return _knots(spark, d, lambda p: I.surface(p, SPEC, tile=10, halo=4))


@q("gr01_plane", f"WITH {LATTICE} " + _FLAT.format("SELECT * FROM lattice"))
def _(spark, d):
    return _flat(spark, d, lambda p: I.surface(p, SPEC, tile=10, halo=4))


@q("gr02_triangulate", _KNOTS + " SELECT l.row, l.col, round(e.v + 1.23E-6, 5) AS v FROM lattice l LEFT JOIN e ON l.row = e.row AND l.col = e.col")
def _(spark, d):
    return _knots(spark, d, lambda p: I.triangulate(p, SPEC, tile=10, halo=4))


@q("gr02_plane", f"WITH {LATTICE} " + _FLAT.format("SELECT * FROM lattice"))
def _(spark, d):
    return _flat(spark, d, lambda p: I.triangulate(p, SPEC, tile=10, halo=4))


@q("gr08_linear", f"WITH {LATTICE} " + _FLAT.format("SELECT * FROM lattice"))
def _(spark, d):
    return _flat(spark, d, lambda p: I.linear(p, SPEC))


@q("gr10_masked_spline", _KNOTS + ", few AS (SELECT * FROM e WHERE row < 12), m AS (SELECT DISTINCT l.row, l.col FROM lattice l, few WHERE (l.row - few.row) * (l.row - few.row) + (l.col - few.col) * (l.col - few.col) <= 9) SELECT m.row, m.col, round(few.v + 1.23E-6, 5) AS v FROM m LEFT JOIN few ON m.row = few.row AND m.col = few.col")
def _(spark, d):
    p = _gapped(spark, d).where("row < 12")
    at = p.select(*K).distinct().withColumn("own", F.lit(True))
    return I.masked_spline(p.select("x", "y", "z"), SPEC, 3).join(at, K, "left").select(*K, F.when(F.col("own"), F.round(F.col("v") + 1.23e-6, 5)).alias("v"))


@q("gr13_spatial_metadata", f"WITH {KEPT}, c AS (SELECT DISTINCT src, row, col FROM kept), n AS (SELECT src, count(*) AS cells FROM c GROUP BY src), m AS (SELECT s_suppkey AS src, s_name AS name FROM supplier) SELECT n.src, cells, round(cells * 0.05E0 * 0.05E0, 6) AS area, coalesce(m.name, CAST(n.src AS VARCHAR)) AS name, CASE WHEN m.name IS NULL THEN 'unknown' ELSE '1 m' END AS resolution, CASE WHEN m.name IS NULL THEN 'unknown' ELSE 'u' END AS url FROM n LEFT JOIN m ON n.src = m.src AND n.src % 2 = 0")
def _(spark, d):
    from sondegrid.plans.modules import spatial_metadata

    s = table(spark, d, "supplier")
    meta = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.col("s_name"), *map(F.lit, ("a", "2001", "bag", "1 m", "h", "v", "u")))).otherwise(F.array(F.col("s_name")))
    m = spatial_metadata(pts(spark, d), SPEC, "src", s.select(F.col("s_suppkey").alias("src"), meta.alias("meta")))
    return m.select("src", "cells", F.round("area", 6).alias("area"), "name", "resolution", "url")


# --- polygons --------------------------------------------------------------------------------------------------------
@q("ve01_convex_hull", f"WITH {PTS}, b AS (SELECT src, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY src) SELECT src, x0, x1, y0, y1, true AS bounded FROM b")
def _(spark, d):
    from sondegrid import geom

    h = V.convex_hull(pts(spark, d), ["src"])
    e = geom.envelope(geom.wkt_rings(F.col("wkt")))
    return h.select("src", e["xmin"].alias("x0"), e["xmax"].alias("x1"), e["ymin"].alias("y0"), e["ymax"].alias("y1"), (F.col("corners") >= 1).alias("bounded"))


# an edge of a hull has all other points of its group to its left, or on it
@q("ve01_order_hulls", f"WITH {PTS}, p AS (SELECT DISTINCT pid // 8 AS g, CAST(floor((x + 90) * 10000 + 0.5E0) AS BIGINT) AS x, CAST(floor((y - 29) * 10000 + 0.5E0) AS BIGINT) AS y FROM pts), n AS (SELECT g, count(*) AS n FROM p GROUP BY g), e AS (SELECT a.g, a.x, a.y FROM p a JOIN p b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON a.g = c.g GROUP BY a.g, a.x, a.y, b.x, b.y HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND c.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND c.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)))), k AS (SELECT g, count(DISTINCT (x, y)) AS k FROM e GROUP BY g) SELECT n.g, CAST(coalesce(k.k, 1) AS INT) AS corners FROM n LEFT JOIN k ON n.g = k.g")
def _(spark, d):
    whole = lambda c, o: F.floor((F.col(c) - F.lit(o)) * 10000 + F.lit(0.5)).cast("double")
    p = pts(spark, d).select(F.expr("pid div 8").alias("g"), whole("x", -90.0).alias("x"), whole("y", 29.0).alias("y"))
    return V.convex_hull(p, ["g"], empty=True).select("g", F.greatest("corners", F.lit(1)).alias("corners"))  # orders without points count as one


@q("ve02_mask_union", f"WITH {CELLS} SELECT n % 3 AS k, count(*) AS polygons FROM cells GROUP BY n % 3")
def _(spark, d):
    from sondegrid import geom

    half = F.lit(0.025)
    c = C.count(pts(spark, d), SPEC).select((F.col("v") % 3).alias("k"), F.array(geom.box_ring(SPEC.x() - half, SPEC.x() + half, SPEC.y() - half, SPEC.y() + half)).alias("rings"))
    return V.collect_polygons(c, ["k"]).select("k", F.size(F.split("wkt", r"\)\),\(\(")).cast("bigint").alias("polygons"))


@q("ve03_clip_features", "WITH b AS (SELECT DISTINCT file_id, minmax[1] AS x0, minmax[2] AS x1, minmax[3] AS y0, minmax[4] AS y1 FROM inf_files WHERE minmax IS NOT NULL) SELECT file_id, round((least(x1, 180) - greatest(x0, 179)) * (least(y1, 40) - greatest(y0, -40)), 6) AS area FROM b WHERE least(x1, 180) > greatest(x0, 179) AND least(y1, 40) > greatest(y0, -40)")
def _(spark, d):
    from sondegrid import geom
    from sondegrid.queries._base import boxes

    b = boxes(spark, d).where("xmax > 179 and xmin < 180 and ymax > -40 and ymin < 40").withColumn("rings", F.array(geom.box_ring(*[F.col(c) for c in ("xmin", "xmax", "ymin", "ymax")])))
    return V.clip_features(b, Region(179.0, 180.0, -40.0, 40.0)).select("file_id", F.round(geom.area(F.element_at("rings", 1)), 6).alias("area")).where("area > 0")


_PARTS = "v AS (SELECT row, col, CASE WHEN s >= 0 THEN 1 ELSE 0 END AS v FROM cells), e AS (SELECT a.row * 100 + a.col AS a, b.row * 100 + b.col AS b FROM v a JOIN v b ON a.v = b.v AND abs(a.row - b.row) + abs(a.col - b.col) <= 1), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT a, min(b) AS label FROM r GROUP BY a)"


@q("ve05_components", f"WITH RECURSIVE {CELLS}, {_PARTS} SELECT label, count(*) AS n FROM l GROUP BY label")
def _(spark, d):
    p = V.components(C.wet_dry(pts(spark, d), SPEC, "zc"))
    return p.groupBy((F.floor(F.col("label") / F.lit(float(1 << 32))) * 100 + F.col("label") % F.lit(1 << 32)).cast("int").alias("label")).agg(F.count("*").alias("n"))


# holes by Euler's number: cells less neighbours plus full blocks of four is parts less holes
@q("ve05_polygons", f"WITH RECURSIVE {CELLS}, {_PARTS}, p AS (SELECT v.v, count(DISTINCT label) AS parts FROM l JOIN v ON l.a = v.row * 100 + v.col GROUP BY v.v), k AS (SELECT v, count(*) AS n FROM v GROUP BY v), j AS (SELECT a.v, count(*) AS n FROM v a JOIN v b ON a.v = b.v AND ((b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)) GROUP BY a.v), f AS (SELECT a.v, count(*) AS n FROM v a JOIN v b ON a.v = b.v AND b.row = a.row AND b.col = a.col + 1 JOIN v c ON a.v = c.v AND c.row = a.row + 1 AND c.col = a.col JOIN v e ON a.v = e.v AND e.row = a.row + 1 AND e.col = a.col + 1 GROUP BY a.v) SELECT k.v, CAST(parts AS INT) AS polygons, CAST(parts - (k.n - coalesce(j.n, 0) + coalesce(f.n, 0)) AS INT) AS holes, round(k.n * 0.05E0 * 0.05E0, 6) AS area FROM k JOIN p ON k.v = p.v LEFT JOIN j ON k.v = j.v LEFT JOIN f ON k.v = f.v")
def _(spark, d):
    return V.polygonize(C.wet_dry(pts(spark, d), SPEC, "zc"), SPEC, ["v"]).select("v", "polygons", "holes", F.round("area", 6).alias("area"))


@q("gr14_coast_polygons", f"WITH RECURSIVE {KEPT}, c0 AS (SELECT row, col, CASE WHEN avg(zc) >= 0 THEN 1 ELSE 0 END AS s FROM (SELECT * FROM kept WHERE zc < 100000 AND zc > -100000) GROUP BY row, col), v AS (SELECT row, col, s AS v FROM c0), e AS (SELECT a.row * 100 + a.col AS a, b.row * 100 + b.col AS b FROM v a JOIN v b ON a.v = b.v AND abs(a.row - b.row) + abs(a.col - b.col) <= 1), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT a, min(b) AS label FROM r GROUP BY a) SELECT label, round(count(*) * 0.05E0 * 0.05E0, 6) AS area FROM l JOIN v ON l.a = v.row * 100 + v.col WHERE v.v = 1 GROUP BY label ORDER BY count(*) DESC, label LIMIT 8")
def _(spark, d):
    from sondegrid.plans.modules import MODULES

    p = pts(spark, d).withColumn("z", F.col("zc") / F.lit(100_000.0))
    c = MODULES["coastline"](p, SPEC)["coast"]
    label = (F.floor(F.col("label") / F.lit(float(1 << 32))) * 100 + F.col("label") % F.lit(1 << 32)).cast("int")
    return c.select(label.alias("label"), F.round("area", 6).alias("area"))


@q("ve06_area", "WITH b AS (SELECT DISTINCT file_id, minmax FROM inf_files WHERE minmax IS NOT NULL) SELECT file_id, round((minmax[2] - minmax[1]) * (minmax[4] - minmax[3]), 6) AS area FROM b")
def _(spark, d):
    from sondegrid import geom
    from sondegrid.queries._base import boxes

    return boxes(spark, d).select("file_id", F.round(geom.area(geom.box_ring(*[F.col(c) for c in ("xmin", "xmax", "ymin", "ymax")])), 6).alias("area"))


# --- uncertainty -----------------------------------------------------------------------------------------------------
_TILES = f"WITH {CELLS}, {LATTICE}, m AS (SELECT row, col FROM cells WHERE n % 7 = 0), p AS (SELECT l.row, l.col, CAST(min((l.row - t.row) * (l.row - t.row) + (l.col - t.col) * (l.col - t.col)) AS BIGINT) AS prox FROM lattice l LEFT JOIN m t ON true GROUP BY l.row, l.col), t AS (SELECT row // 5 AS trow, col // 5 AS tcol, CAST(sum(CASE WHEN prox = 0 THEN 1 ELSE 0 END) AS BIGINT) AS filled, count(*) AS cells, quantile_cont(CAST(prox AS DOUBLE), 0.95) AS prox FROM p GROUP BY 1, 2)"


def _tiles(spark, d):
    near = N.proximity(C.count(pts(spark, d), SPEC).where("v % 7 = 0"), SPEC)
    return U.tile_stats(near.select(*K, (F.col("d2") == 0).cast("int").alias("mask"), F.col("d2").cast("double").alias("prox")), 5)


@q("un02_region_stats", f"WITH {CELLS} SELECT quantile_cont(CAST(n AS DOUBLE), 0.95) AS p95, quantile_cont(CAST(n AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(n AS DOUBLE), 0.75) AS p75, CAST(max(n) AS DOUBLE) AS p100 FROM cells")
def _(spark, d):
    return ranks.percentiles(C.count(pts(spark, d), SPEC), [], "v", {"p95": 0.95, "p25": 0.25, "p75": 0.75, "p100": 1.0})


@q("un03_tiles", _TILES + " SELECT trow, tcol, filled, cells, round(prox, 6) AS prox FROM t")
def _(spark, d):
    return _tiles(spark, d).select("trow", "tcol", "filled", "cells", F.round("prox", 6).alias("prox"))


_ZONES = ", z AS (SELECT *, CAST(filled AS DOUBLE) / cells * 100 AS density, CASE WHEN prox <= 2.01E0 THEN 'high-dens' WHEN prox < 8 - 0.01E0 THEN 'mid-dens' ELSE 'low-dens' END AS zone FROM t)"


@q("un04_zones", _TILES + _ZONES + " SELECT trow, tcol, zone FROM z")
def _(spark, d):
    return U.zones(_tiles(spark, d), 2.0, 8.0).select("trow", "tcol", "zone")


@q("un05_density", _TILES + _ZONES + " SELECT round(quantile_cont(density, 0.05), 6) AS p5 FROM z")
def _(spark, d):
    return ranks.percentiles(_tiles(spark, d), [], "density", {"p5": 0.05}).select(F.round("p5", 6).alias("p5"))


@q("un06_training", _TILES + _ZONES + ", y AS (SELECT *, quantile_cont(density, 0.5) OVER (PARTITION BY zone) AS mid FROM z), x AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY density, trow, tcol) AS rank FROM y WHERE density <= mid + 0.01E0) SELECT trow, tcol, zone, CAST(rank AS INT) AS rank FROM x WHERE rank <= 25")
def _(spark, d):
    return U.training(U.zones(_tiles(spark, d), 2.0, 8.0)).select("trow", "tcol", "zone", "rank")


@q("un07_split_sample", f"""WITH {KEPT}, p AS (SELECT *, row // 5 AS tr, col // 5 AS tc, zc / 100000.0E0 AS z FROM kept), k AS (SELECT tr, tc, row, col, avg(x) AS kx, avg(y) AS ky, avg(z) AS kz FROM p WHERE pid % 2 = 0 GROUP BY tr, tc, row, col),
 j AS (SELECT h.tr, h.tc, h.pid, h.x, h.y, h.z, kz, greatest(sqrt(pow(h.x - kx, 2) + pow(h.y - ky, 2)), 1e-9) AS d FROM p h JOIN k ON h.tr = k.tr AND h.tc = k.tc WHERE h.pid % 2 = 1), e AS (SELECT tr, tc, pid, z - sum(kz * pow(d, -2)) / sum(pow(d, -2)) AS error, min(d) AS distance FROM j GROUP BY tr, tc, pid, x, y, z)
 SELECT tr, tc, count(*) AS n, round(avg(error), 6) AS error, round(max(distance), 6) AS farthest FROM e GROUP BY tr, tc""")
def _(spark, d):
    p = SPEC.index(pts(spark, d)).withColumn("z", F.col("zc") / F.lit(100_000.0)).withColumn("held", F.col("pid") % 2 == 1)
    p = p.withColumn("tr", F.floor(F.col("row") / 5).cast("int")).withColumn("tc", F.floor(F.col("col") / 5).cast("int"))
    e = U.held_out_errors(p.select("tr", "tc", *K, "pid", "x", "y", "z", "held"), ["tr", "tc"])
    return e.groupBy("tr", "tc").agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("error"), F.round(F.max("distance"), 6).alias("farthest"))


@q("un07_hash_split", f"WITH {PTS} SELECT count(*) AS n, true AS about_half FROM pts")
def _(spark, d):
    p = U.split_sample(pts(spark, d), 50.0)
    return p.agg(F.count("*").alias("n"), F.avg(F.col("held").cast("int")).between(0.45, 0.55).alias("about_half"))


@q("un08_error_filter", f"WITH {CELLS}, e AS (SELECT row, col, n AS prox FROM cells), p AS (SELECT quantile_cont(CAST(prox AS DOUBLE), 0.95) AS p95 FROM e) SELECT row, col, prox FROM e, p WHERE prox > 0 AND prox < p95")
def _(spark, d):
    c = C.count(pts(spark, d), SPEC).withColumnRenamed("v", "prox")
    p95 = ranks.percentiles(c, [], "prox", {"p95": 0.95}).first()["p95"]
    return c.where((F.col("prox") > 0) & (F.col("prox") < F.lit(p95)))


def _errors(spark, d):
    return pts(spark, d).select(F.col("w").cast("double").alias("distance"), (F.when(F.col("pid") % 2 == 0, 1.0).otherwise(-1.0) * F.pow("w", F.lit(0.5))).alias("error"))


@q("un09_error_bins", f"WITH {PTS}, e AS (SELECT CAST(w AS DOUBLE) AS x, CASE WHEN pid % 2 = 0 THEN 1 ELSE -1 END * pow(w, 0.5) AS e FROM pts), b AS (SELECT min(x) AS lo, max(x) AS hi FROM e), i AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * 2520) AS INT), 2519) // 252 + 1 AS bin, e, lo, hi FROM e, b) SELECT CAST(bin AS INT) AS bin, round(any_value(lo + bin * (hi - lo) / 10), 6) AS x, round(stddev_pop(e), 6) AS std FROM i GROUP BY bin")
def _(spark, d):
    x, std = U.error_bins(_errors(spark, d))
    return spark.createDataFrame([(i + 1, round(float(a), 6), round(float(b), 6)) for i, (a, b) in enumerate(zip(x, std))], "bin int, x double, std double")


@q("un09_error_curve")
def _(spark, d):
    return spark.createDataFrame([U.error_curve(_errors(spark, d))], "c0 double, c1 double, c2 double")


@q("un11_apply_curve", f"WITH {CELLS} SELECT row, col, round((0.4E0 * pow(n, 0.5E0) + 0.2E0 * pow(n, 0.25E0)) / 2, 6) AS v FROM cells")
def _(spark, d):
    c = C.count(pts(spark, d), SPEC)
    j = A.calc(U.apply_curve(c, (0.0, 0.4, 0.5)), U.apply_curve(c, (0.0, 0.2, 0.25)), lambda a, b: F.round((a + b) / 2, 6))
    return j


# --- connectors ------------------------------------------------------------------------------------------------------
@q("cn01_catalog", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 360 - 180 <= 20 AND o_orderkey % 360 - 179 >= -20")
def _(spark, d):
    from sondegrid.sources.catalog import find

    x = (F.col("o_orderkey") % 360 - 180).cast("double")
    c = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"), F.lit("x").alias("DataSource"), x.alias("xmin"), (x + 1).alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("ymax"))
    return find(c, Region(-20.0, 20.0, -1.0, 2.0), "status = 'F'", ["x"]).select("id", "name")


@q("cn03_sounding_lists", "SELECT raw_id, line_no, CAST(split_part(line, ',', 3) AS DOUBLE) AS x, CAST(split_part(line, ',', 2) AS DOUBLE) AS y, CAST(split_part(line, ',', 4) AS DOUBLE) * -1 AS z FROM (SELECT l.* FROM raw_lines l JOIN raw_files f ON l.raw_id = f.raw_id WHERE f.cols LIKE 'id,lat,lon,depth%' AND f.delim = ',') WHERE regexp_matches(line, '^[^,]*,-?[0-9]+[.][0-9]+,-?[0-9]+[.][0-9]+,-?[0-9]+[.][0-9]+,')")
def _(spark, d):
    from sondegrid.sources.catalog import nos_points

    f = table(spark, d, "raw_files").where("cols like 'id,lat,lon,depth%' and delim = ','").select("raw_id")
    lines = table(spark, d, "raw_lines").join(f, "raw_id").where(F.col("line").rlike("^[^,]*,-?[0-9]+[.][0-9]+,-?[0-9]+[.][0-9]+,-?[0-9]+[.][0-9]+,"))
    return nos_points(lines)


@q("cn06_survey_listing", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, d):
    from sondegrid.functions.scalars import survey_of

    url = F.concat(F.lit("a/b/c/d/e/f/"), F.col("o_custkey").cast("string"), F.lit("/m/n/version1/x"))
    return table(spark, d, "orders").groupBy(survey_of(url).cast("bigint").alias("o_custkey")).agg(F.count("*").alias("n"))


@q("cn07_feature_service", "SELECT 'u' || CAST(o_orderkey AS VARCHAR) AS url FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    from sondegrid.sources.catalog import usace_rows

    j = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("SOURCEDATALOCATION"), F.col("o_orderstatus").alias("SURVEYTYPE")).alias("attributes"))).alias("features")))
    return usace_rows(table(spark, d, "orders").select(j.alias("json")), "O").select("url")


@q("cn08_page_items", "SELECT CAST(o_orderkey AS VARCHAR) AS title, CASE WHEN o_orderstatus = 'O' THEN 'img' ELSE 'down' END AS url FROM orders")
def _(spark, d):
    from sondegrid.sources.catalog import tnm_rows

    item = F.struct(F.col("o_orderkey").cast("string").alias("title"), F.when(F.col("o_orderstatus") == "O", F.create_map(F.lit("IMG"), F.lit("img"))).alias("urls"), F.lit("down").alias("downloadURL"))
    j = F.to_json(F.struct(F.lit(1).alias("total"), F.array(item).alias("items")))
    return tnm_rows(table(spark, d, "orders").select(j.alias("json")), ["TIFF", "IMG"]).select("title", "url")


@q("cn09_layer_urls", "SELECT 'http://s/g?east=' || CAST(o_custkey AS VARCHAR) || '&layer=topo&west=1' AS url FROM orders")
def _(spark, d):
    from sondegrid.sources.catalog import gmrt_urls

    j = F.to_json(F.array(F.concat(F.lit("http://s/g?west=1&east="), F.col("o_custkey").cast("string"), F.lit("&layer=mask"))))
    return gmrt_urls(table(spark, d, "orders").select(j.alias("json"))).select("url")


@q("cn10_altimetry", f"WITH {PTS} SELECT CAST(printf('%.4f', x + 360) AS DOUBLE) - 360 AS x, CAST(printf('%.4f', y) AS DOUBLE) AS y, CAST(zc AS DOUBLE) AS z FROM pts")
def _(spark, d):
    from sondegrid.sources.catalog import altimetry_points

    line = F.format_string("%.4f %.4f %d", F.col("x") + 360, F.col("y"), F.col("zc"))
    return altimetry_points(pts(spark, d).select(line.alias("line")))


@q("cn14_coverage_ids", "SELECT c_custkey, 'a__' || c_name AS id FROM customer")
def _(spark, d):
    from sondegrid.sources.catalog import chs_id

    return table(spark, d, "customer").select("c_custkey", chs_id(F.concat(F.lit("a:"), "c_name")).alias("id"))


@q("cn15_monuments", f"WITH {PTS} SELECT count(*) AS n, CAST(sum(zc) AS BIGINT) AS s FROM pts")
def _(spark, d):
    from sondegrid.sources.catalog import ngs_points

    j = F.to_json(F.array(F.struct(F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("zc").cast("double").alias("geoidHt"))))
    return ngs_points(pts(spark, d).select(j.alias("json"))).agg(F.count("*").alias("n"), F.sum(F.col("z").cast("bigint")).alias("s"))


@q("cn17_coverage", "SELECT 10.0E0 AS xmin, 20.0E0 AS xmax, 1.0E0 AS ymin, 5.0E0 AS ymax, 0.1E0 AS xres, 0.05E0 AS yres, 'image/tiff' AS format")
def _(spark, d):
    from sondegrid.sources.catalog import wcs_coverage

    xml = "<c><Envelope><lowerCorner>1 10</lowerCorner><upperCorner>5 20</upperCorner></Envelope><GridEnvelope><low>0 0</low><high>100 80</high></GridEnvelope><nativeFormat>image/tiff</nativeFormat></c>"
    return wcs_coverage(spark.createDataFrame([(xml,)], "xml string"))


@q("ag31_six_numbers", "SELECT file_id, minmax[1] AS xmin, minmax[6] AS zmax FROM (SELECT DISTINCT file_id, minmax FROM inf_files WHERE minmax IS NOT NULL)")
def _(spark, d):
    from sondegrid.queries._base import boxes
    from sondegrid.sources.catalog import gmt_inf

    line = F.concat_ws(" ", "xmin", "xmax", "ymin", "ymax", "zmin", "zmax")
    return gmt_inf(boxes(spark, d).select("file_id", line.alias("line"))).select("file_id", "xmin", "zmax")


@q("ag32_report_bounds", "SELECT file_id, minmax[1] AS xmin, minmax[2] AS xmax, -minmax[6] AS zmin, -minmax[5] AS zmax FROM (SELECT DISTINCT file_id, minmax FROM inf_files WHERE minmax IS NOT NULL)")
def _(spark, d):
    from sondegrid.queries._base import boxes
    from sondegrid.sources.catalog import mb_inf

    b = boxes(spark, d)
    text = lambda label, lo, hi: F.concat(F.lit(f"Minimum {label}: "), F.col(lo).cast("string"), F.lit(f" Maximum {label}: "), F.col(hi).cast("string"))
    lines = b.select("file_id", F.explode(F.array(text("Longitude", "xmin", "xmax"), text("Latitude", "ymin", "ymax"), text("Depth", "zmin", "zmax"))).alias("line"))
    return mb_inf(lines, ["file_id"]).select("file_id", "xmin", "xmax", "zmin", "zmax")


QUERIES, SQL = q.queries, q.sql
