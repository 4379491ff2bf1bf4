"""Scans, filters, aggregates and joins of points and cells."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sondegrid.operators import cells as C, ranks
from sondegrid.queries._base import BOX, CELLS, KEPT, LATTICE, PTS, SPEC, Registry, kept, pts, table

q = Registry()
K = ["row", "col"]


# --- aggregates ------------------------------------------------------------------------------------------------------
@q("ag01_grid_count", f"WITH {CELLS}, {LATTICE} SELECT l.row, l.col, coalesce(n, 0) AS v FROM lattice l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    return C.dense(C.count(pts(spark, d), SPEC), SPEC, 0)


@q("ag02_grid_mean", f"WITH {CELLS} SELECT row, col, CAST(s AS DOUBLE) / n AS v FROM cells")
def _(spark, d):
    return C.mean(pts(spark, d), SPEC, "zc")


@q("ag03_grid_mask", f"WITH {CELLS}, {LATTICE} SELECT l.row, l.col, CASE WHEN c.n IS NULL THEN 0 ELSE 1 END AS v FROM lattice l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    return C.dense(C.mask(pts(spark, d), SPEC), SPEC, 0)


@q("ag04_wet_dry", f"WITH {CELLS} SELECT row, col, CASE WHEN s >= 0 THEN 1 ELSE 0 END AS v FROM cells")
def _(spark, d):
    return C.wet_dry(pts(spark, d), SPEC, "zc")


@q("ag05_mask_tee", f"WITH {KEPT} SELECT row, col, count(*) AS passed, 1 AS v FROM kept GROUP BY row, col")
def _(spark, d):
    return C.aggregate(pts(spark, d), SPEC, F.count("*").alias("passed"), F.max(F.lit(1)).alias("v"))


@q("ag06_block_mean", f"WITH {CELLS} SELECT row, col, -90.0E0 + col * 0.05E0 AS x, 30.0E0 + row * -0.05E0 AS y, CAST(s AS DOUBLE) / n AS z FROM cells")
def _(spark, d):
    return C.block(pts(spark, d), SPEC, "zc")


@q("ag06_block_weighted", f"WITH {KEPT} SELECT row, col, CAST(sum(zc * CAST(w AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(w AS BIGINT)) AS DOUBLE) AS z FROM kept GROUP BY row, col")
def _(spark, d):
    p = pts(spark, d).withColumn("w", F.col("w").cast("bigint"))
    return C.block(p, SPEC, "zc", "w").select(*K, "z")


@q("ag06_block_compat", f"WITH {KEPT} SELECT row, col, CAST(sum(zc) AS DOUBLE) / CAST(sum(CAST(w AS BIGINT)) AS DOUBLE) / count(*) AS z FROM kept GROUP BY row, col")
def _(spark, d):
    p = pts(spark, d).withColumn("w", F.col("w").cast("bigint"))
    return C.block(p, SPEC, "zc", "w", compat=True).select(*K, "z")


@q("ag07_block_lists", f"WITH {KEPT} SELECT row, col, count(*) AS n, CAST(sum(pid) AS BIGINT) AS pids FROM kept GROUP BY row, col")
def _(spark, d):
    return C.block_lists(pts(spark, d), SPEC).select(*K, F.size("points").cast("bigint").alias("n"), F.aggregate("points", F.lit(0).cast("bigint"), lambda s, p: s + p["pid"]).alias("pids"))


@q("ag08_num_modes", f"WITH {CELLS} SELECT row, col, lo, hi, s, n FROM cells")
def _(spark, d):
    return C.aggregate(pts(spark, d), SPEC, F.min("zc").alias("lo"), F.max("zc").alias("hi"), F.sum("zc").alias("s"), F.count("*").alias("n"))


@q("ag09_block_centre", f"WITH {KEPT} SELECT row, col, CAST(sum(CAST(floor((x + 90.0E0) * 10000 + 0.5E0) AS BIGINT)) AS DOUBLE) / count(*) AS x, CAST(sum(CAST(floor((y - 29.0E0) * 10000 + 0.5E0) AS BIGINT)) AS DOUBLE) / count(*) AS y, CAST(sum(zc) AS DOUBLE) / count(*) AS z FROM kept GROUP BY row, col")
def _(spark, d):
    whole = lambda c, o: F.floor((F.col(c) - F.lit(o)) * 10000 + F.lit(0.5)).cast("bigint")
    return kept(spark, d).groupBy(*K).agg(F.avg(whole("x", -90.0)).alias("x"), F.avg(whole("y", 29.0)).alias("y"), F.avg("zc").alias("z"))


@q("ag10_block_median", f"WITH {KEPT} SELECT row, col, quantile_cont(CAST(zc AS DOUBLE), 0.5) AS z FROM kept GROUP BY row, col")
def _(spark, d):
    return C.block_median(pts(spark, d), SPEC, "zc")


@q("ag11_envelope", f"WITH {PTS} SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(zc) AS zmin, max(zc) AS zmax, count(*) AS numpts FROM pts")
def _(spark, d):
    return C.envelope(pts(spark, d), z="zc")


@q("ag11_file_envelopes", f"WITH {PTS} SELECT src, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(zc) AS zmin, max(zc) AS zmax, count(*) AS numpts FROM pts GROUP BY src")
def _(spark, d):
    return C.envelope(pts(spark, d), ["src"], "zc")


@q("ag13_grid_inf", f"WITH {CELLS}, {LATTICE} SELECT -90.0E0 AS xmin, -89.0E0 AS xmax, 29.0E0 AS ymin, 30.0E0 AS ymax, min(lo) AS zmin, max(hi) AS zmax, count(*) AS numpts FROM lattice l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    c = C.aggregate(pts(spark, d), SPEC, F.min("zc").alias("lo"), F.max("zc").alias("hi"))
    r = SPEC.region()
    return C.dense(c, SPEC).agg(*[F.lit(round(v, 9)).alias(n) for n, v in (("xmin", r.xmin), ("xmax", r.xmax), ("ymin", r.ymin), ("ymax", r.ymax))], F.min("lo").alias("zmin"), F.max("hi").alias("zmax"), F.count("*").alias("numpts"))


@q("ag18_grid_sum", f"WITH {CELLS}, {LATTICE} SELECT CAST(sum(coalesce(s, -9999)) AS BIGINT) AS total FROM lattice l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    return C.dense(C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v")), SPEC, -9999).agg(F.sum("v").alias("total"))


@q("ag19_percentile", f"WITH {CELLS} SELECT round(coalesce(quantile_cont(CAST(s AS DOUBLE), 0.95), 2.0E0), 3) AS p95 FROM cells WHERE s <> 0")
def _(spark, d):
    c = C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v"))
    return ranks.percentiles(c.where("v <> 0"), [], "v", {"p95": 0.95}).select(F.round(F.coalesce("p95", F.lit(2.0)), 3).alias("p95"))


@q("ag20_mask_analysis", f"WITH {CELLS}, {LATTICE}, m AS (SELECT CASE WHEN c.n > 20 THEN 1 ELSE 0 END AS v FROM lattice l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col) SELECT CAST(sum(v) AS BIGINT) AS filled, count(*) AS cells, CAST(sum(v) AS DOUBLE) / count(*) * 100.0E0 AS percent FROM m")
def _(spark, d):
    m = C.dense(C.count(pts(spark, d), SPEC), SPEC, 0).select((F.col("v") > 20).cast("int").alias("v"))
    return m.agg(F.sum("v").alias("filled"), F.count("*").alias("cells"), (F.sum("v").cast("double") / F.count("*") * F.lit(100.0)).alias("percent"))


@q("ag21_window_percentile", f"WITH {CELLS} SELECT round(quantile_cont(CAST(s AS DOUBLE), 0.95), 3) AS p95 FROM cells WHERE row BETWEEN 5 AND 14 AND col BETWEEN 5 AND 14")
def _(spark, d):
    c = C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v")).where("row between 5 and 14 and col between 5 and 14")
    return ranks.percentiles(c, [], "v", {"p95": 0.95}).select(F.round("p95", 3).alias("p95"))


@q("ag22_histogram", f"WITH {PTS}, b AS (SELECT CAST(min(zc) AS DOUBLE) AS lo, CAST(max(zc) AS DOUBLE) AS hi FROM pts) SELECT least(CAST(floor((zc - lo) / ((hi - lo) / 100)) AS INT) + 1, 100) AS bin, count(*) AS n FROM pts, b GROUP BY 1")
def _(spark, d):
    return C.histogram(pts(spark, d), "zc", 100)


_MOMENT = """m AS (SELECT count(*) AS n, avg(CAST(zc AS DOUBLE)) AS mean, stddev_pop(CAST(zc AS DOUBLE)) AS sd FROM pts)"""


@q("ag23_summary", f"WITH {PTS} SELECT count(*) AS n, min(zc) AS least, max(zc) AS greatest, round(CAST(sum(zc) AS DOUBLE) / count(*), 6) AS mean, round(sqrt((CAST(sum(CAST(zc AS HUGEINT) * zc) AS DOUBLE) - CAST(sum(zc) AS DOUBLE) * CAST(sum(zc) AS DOUBLE) / count(*)) / count(*)), 3) AS std, quantile_cont(CAST(zc AS DOUBLE), 0.5) AS median, quantile_cont(CAST(zc AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(zc AS DOUBLE), 0.75) AS q3 FROM pts")
def _(spark, d):
    z = F.col("zc").cast("double")
    return pts(spark, d).agg(F.count("*").alias("n"), F.min("zc").alias("least"), F.max("zc").alias("greatest"), F.round(F.avg("zc"), 6).alias("mean"), F.round(F.stddev_pop(z), 3).alias("std")).unionByName(ranks.percentiles(pts(spark, d), [], "zc", {"median": 0.5, "q1": 0.25, "q3": 0.75}), allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("n", "least", "greatest", "mean", "std", "median", "q1", "q3")])


@q("ag24_skewness", f"WITH {PTS}, {_MOMENT} SELECT round(sum(pow(zc - mean, 3)) / ((max(m.n) - 1) * pow(max(sd), 3)), 6) AS skew FROM pts, m")
def _(spark, d):
    return pts(spark, d).agg(F.round(C.moments("zc")["skew"], 6).alias("skew"))


@q("ag25_kurtosis", f"WITH {PTS}, {_MOMENT} SELECT round(sum(pow(zc - mean, 4)) / (max(m.n) * pow(max(sd), 4)) - 3, 6) AS kurt FROM pts, m")
def _(spark, d):
    return pts(spark, d).agg(F.round(F.kurtosis(F.col("zc").cast("double")), 6).alias("kurt"))


# medians of the two halves of each cell's ordered values, the lower half without its last
_HALVES = f"WITH {KEPT}, r AS (SELECT row, col, zc, row_number() OVER (PARTITION BY row, col ORDER BY zc) AS k, count(*) OVER (PARTITION BY row, col) AS n FROM kept) SELECT row, col, quantile_cont(CAST(CASE WHEN k < n // 2 THEN zc END AS DOUBLE), 0.5) AS q1, quantile_cont(CAST(CASE WHEN k > n // 2 THEN zc END AS DOUBLE), 0.5) AS q3 FROM r GROUP BY row, col"


@q("ag26_quartile", _HALVES)
def _(spark, d):
    return C.half_medians(pts(spark, d), SPEC, "zc")


@q("ag27_rms", f"WITH {KEPT} SELECT row, col, round(sqrt(CAST(sum(CAST(zc AS HUGEINT) * zc) AS DOUBLE) / count(*)), 3) AS rms FROM kept GROUP BY row, col")
def _(spark, d):
    z = F.col("zc").cast("double")
    return kept(spark, d).groupBy(*K).agg(F.round(F.sqrt(F.avg(z * z)), 3).alias("rms"))


@q("ag28_binned_error", f"WITH {PTS}, b AS (SELECT min(w) AS lo, max(w) AS hi FROM pts), e AS (SELECT least(CAST(floor((w - lo) / ((hi - lo) / 10)) AS INT) + 1, 10) AS bin, zc FROM pts, b) SELECT bin, count(*) AS n, round(sqrt(CAST(sum(CAST(zc AS HUGEINT) * zc) AS DOUBLE) / count(*) - pow(CAST(sum(zc) AS DOUBLE) / count(*), 2)), 3) AS std FROM e GROUP BY bin")
def _(spark, d):
    from sondegrid.operators.uncertainty import binned_std

    return binned_std(pts(spark, d), "w", "zc", 10).select("bin", "n", F.round("std", 3).alias("std"))


@q("ag29_extent_minmax", f"WITH {CELLS} SELECT min(-90.0E0 + col * 0.05E0) AS xmin, max(-90.0E0 + col * 0.05E0) AS xmax, min(30.0E0 + row * -0.05E0) AS ymin, max(30.0E0 + row * -0.05E0) AS ymax, min(s) AS zmin, max(s) AS zmax FROM cells")
def _(spark, d):
    c = C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v"))
    return c.select(SPEC.x().alias("x"), SPEC.y().alias("y"), "v").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.min("v").alias("zmin"), F.max("v").alias("zmax"))


# --- filters ---------------------------------------------------------------------------------------------------------
@q("pr01_in_box", f"WITH {PTS} SELECT pid, x, y, zc FROM pts WHERE x >= -89.8E0 AND x <= -89.4E0 AND y >= 29.2E0 AND y <= 29.9E0")
def _(spark, d):
    from sondegrid.region import Region

    return pts(spark, d).where(Region(-89.8, -89.4, 29.2, 29.9).contains()).select("pid", "x", "y", "zc")


_DIAMOND = [(-89.9, 29.5), (-89.5, 29.93), (-89.07, 29.5), (-89.5, 29.11)]
_SIDES = [tuple(f"{v}E0" for v in (*a, *b)) for a, b in zip(_DIAMOND, _DIAMOND[1:] + _DIAMOND[:1])]
_CROSSED = " + ".join(f"CASE WHEN ({b} > y) <> ({e} > y) AND x < {a} + (y - {b}) * ({c} - {a}) / ({e} - {b}) THEN 1 ELSE 0 END" for a, b, c, e in _SIDES)
_ON = " OR ".join(f"(({c} - {a}) * (y - {b}) - ({e} - {b}) * (x - {a}) = 0 AND x BETWEEN least({a}, {c}) AND greatest({a}, {c}) AND y BETWEEN least({b}, {e}) AND greatest({b}, {e}))" for a, b, c, e in _SIDES)
WITHIN = f"(({_CROSSED}) % 2 = 1 AND NOT ({_ON}))"


def diamond():
    return F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _DIAMOND]))


@q("pr01_in_polygon", f"WITH {PTS} SELECT pid FROM pts WHERE {WITHIN}")
def _(spark, d):
    from sondegrid.geom import within

    return pts(spark, d).where(within(diamond(), F.col("x"), F.col("y"))).select("pid")


@q("pr02_strict_guard", f"WITH {PTS} SELECT pid, x, y FROM pts WHERE x > -90 AND x < -89 AND y > 29 AND y < 30")
def _(spark, d):
    return pts(spark, d).where(BOX.contains(strict=True)).select("pid", "x", "y")


@q("pr05_z_pass", f"WITH {PTS} SELECT pid, zc FROM pts WHERE zc < 1000000 AND zc > -1000000")
def _(spark, d):
    from sondegrid.operators.filters import z_pass

    return pts(spark, d).where(z_pass("zc", 1000000, -1000000)).select("pid", "zc")


@q("pr14_nodata", f"WITH {CELLS}, v AS (SELECT row, col, CASE WHEN s % 7 = 0 THEN -9999 WHEN s % 5 = 0 THEN NULL ELSE s END AS v FROM cells) SELECT row, col, v FROM v WHERE v IS NOT NULL AND v <> -9999")
def _(spark, d):
    c = C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("s"))
    c = c.select(*K, F.when(F.col("s") % 7 == 0, -9999).when(F.col("s") % 5 == 0, None).otherwise(F.col("s")).alias("v"))
    return c.where(C.no_data("v"))


@q("pr16_nonzero", f"WITH {PTS} SELECT pid, zc % 10 AS z FROM pts WHERE zc % 10 <> 0")
def _(spark, d):
    return pts(spark, d).select("pid", (F.col("zc") % 10).alias("z")).where("z <> 0")


@q("pr17_select_split", f"WITH {PTS} SELECT CASE WHEN x >= -89.7E0 AND x <= -89.3E0 AND y >= 29.3E0 AND y <= 29.7E0 THEN 1 ELSE 0 END AS inside, count(*) AS n, CAST(sum(zc) AS BIGINT) AS s FROM pts GROUP BY 1")
def _(spark, d):
    from sondegrid.operators.filters import select_split
    from sondegrid.region import Region

    a, b = select_split(pts(spark, d), Region(-89.7, -89.3, 29.3, 29.7))
    tag = lambda t, v: t.groupBy(F.lit(v).alias("inside")).agg(F.count("*").alias("n"), F.sum("zc").alias("s"))
    return tag(a, 1).unionByName(tag(b, 0))


# --- joins -----------------------------------------------------------------------------------------------------------
@q("jn01_point_raster_lookup", f"WITH {CELLS}, looked AS (SELECT pid, zc, CAST(floor((x + 90.0E0)/0.05E0 + 0.5E0) AS INT) AS col, CAST(floor((y - 30.0E0)/-0.05E0 + 0.5E0) AS INT) AS row FROM pts WHERE x > -90 AND y < 30) SELECT pid, zc AS z, c.s AS g, zc - c.s AS d, zc + c.s AS m FROM looked l JOIN cells c ON l.row = c.row AND l.col = c.col")
def point_raster(spark, d):
    from sondegrid.operators.joins import query_grid

    p = pts(spark, d)
    return query_grid(p.withColumnRenamed("zc", "z"), C.aggregate(p, SPEC, F.sum("zc").alias("v")), SPEC).select("pid", "z", "g", "d", "m")


@q("jn02_script_query", f"WITH {CELLS}, g AS (SELECT row, col, s FROM cells WHERE s % 3 <> 0), looked AS (SELECT pid, zc, CAST(floor((x + 90.0E0)/0.05E0) AS INT) AS col, CAST(floor((y - 30.0E0)/-0.05E0) AS INT) AS row FROM pts) SELECT pid, zc AS z, coalesce(CAST(g.s AS DOUBLE), -9999.0E0) AS g, zc - coalesce(CAST(g.s AS DOUBLE), -9999.0E0) AS d, abs(round((zc - coalesce(CAST(g.s AS DOUBLE), -9999.0E0)) / (coalesce(CAST(g.s AS DOUBLE), -9999.0E0) + 0.00000001E0) * 100, 2)) AS c FROM looked l LEFT JOIN g ON l.row = g.row AND l.col = g.col")
def _(spark, d):
    from sondegrid.operators.joins import query_grid_all

    p = pts(spark, d)
    g = C.aggregate(p, SPEC, F.sum("zc").alias("v")).where("v % 3 <> 0")
    return query_grid_all(p.withColumnRenamed("zc", "z"), g, SPEC).select("pid", "z", "g", "d", "c")


@q("jn03_raster_difference", f"WITH {CELLS} SELECT a.row, a.col, a.s - b.n * 1000 AS v FROM cells a JOIN cells b ON a.row = b.row AND a.col = b.col")
def _(spark, d):
    from sondegrid.operators.joins import grid_difference

    p = pts(spark, d)
    return grid_difference(C.aggregate(p, SPEC, F.sum("zc").alias("v")), C.aggregate(p, SPEC, (F.count("*") * 1000).alias("v")))


_MASK = "mask AS (SELECT row, col, n % 3 AS v FROM cells)"


@q("jn04_clip_keep", f"WITH {CELLS}, {_MASK} SELECT k.pid FROM kept k JOIN mask m ON k.row = m.row AND k.col = m.col WHERE m.v <> 0")
def _(spark, d):
    from sondegrid.operators.joins import clip_by_mask

    p = kept(spark, d)
    m = p.groupBy(*K).agg((F.count("*") % 3).alias("v"))
    return clip_by_mask(p, m).select("pid")


@q("jn04_clip_reject", f"WITH {CELLS}, {_MASK} SELECT k.pid FROM kept k LEFT JOIN mask m ON k.row = m.row AND k.col = m.col AND m.v <> 0 WHERE m.v IS NULL")
def _(spark, d):
    from sondegrid.operators.joins import clip_by_mask

    p = kept(spark, d)
    m = p.groupBy(*K).agg((F.count("*") % 3).alias("v"))
    return clip_by_mask(p, m, invert=True).select("pid")


_CENTRES = "centres AS (SELECT row, col, -90.0E0 + col * 0.05E0 AS x, 30.0E0 + row * -0.05E0 AS y FROM lattice)"
INSIDE_CELLS = f"inside AS (SELECT row, col FROM centres WHERE {WITHIN})"


@q("jn05_clip_polygon", f"WITH {KEPT}, {LATTICE}, {_CENTRES}, {INSIDE_CELLS} SELECT k.pid FROM kept k JOIN inside i ON k.row = i.row AND k.col = i.col")
def _(spark, d):
    from sondegrid.operators.algebra import rasterize

    burned = rasterize(spark, SPEC, diamond()).where("v = 1")
    return kept(spark, d).join(burned, K, "left_semi").select("pid")


@q("jn08_mask_scan", f"WITH {CELLS}, {_MASK} SELECT c.row, c.col, c.s AS v FROM cells c JOIN mask m ON c.row = m.row AND c.col = m.col WHERE m.v <> 0")
def _(spark, d):
    c = C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v"), F.count("*").alias("n"))
    return c.select(*K, "v").join(c.where("n % 3 <> 0").select(*K), K, "left_semi")


@q("jn09_mask_anti", f"WITH {CELLS}, {_MASK} SELECT c.row, c.col, CASE WHEN m.v IS NOT NULL THEN -9999 ELSE c.s END AS v FROM cells c LEFT JOIN (SELECT * FROM mask WHERE v = 1) m ON c.row = m.row AND c.col = m.col")
def _(spark, d):
    from sondegrid.operators.joins import mask_out

    c = C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v"), F.count("*").alias("n"))
    return mask_out(c.select(*K, "v"), c.where("n % 3 = 1").select(*K), -9999)


@q("jn10_priority_fill", f"WITH {CELLS}, {LATTICE} SELECT l.row, l.col, coalesce(a.s, b.n, 7) AS v FROM lattice l LEFT JOIN (SELECT * FROM cells WHERE s > 0) a ON l.row = a.row AND l.col = a.col LEFT JOIN (SELECT * FROM cells WHERE n % 2 = 0) b ON l.row = b.row AND l.col = b.col")
def _(spark, d):
    from sondegrid.operators.joins import priority_fill

    c = C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("s"), F.count("*").alias("n"))
    return priority_fill(SPEC, [c.where("s > 0").select(*K, F.col("s").alias("v")), c.where("n % 2 = 0").select(*K, F.col("n").alias("v"))], 7)


@q("jn11_vote_mask", f"WITH {CELLS}, {LATTICE} SELECT l.row, l.col, CAST(CASE WHEN a.s IS NULL THEN 0 WHEN a.s >= 0 THEN 1 ELSE -1 END + CASE WHEN b.n IS NULL THEN 0 ELSE 1 END AS INT) AS v FROM lattice l LEFT JOIN cells a ON l.row = a.row AND l.col = a.col LEFT JOIN (SELECT * FROM cells WHERE n % 2 = 0) b ON l.row = b.row AND l.col = b.col")
def _(spark, d):
    from sondegrid.operators.joins import vote_mask

    c = C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("s"), F.count("*").alias("n"))
    return vote_mask(SPEC, [c.select(*K, F.when(F.col("s") >= 0, 1).otherwise(-1).alias("v")), c.where("n % 2 = 0").select(*K, F.lit(1).alias("v"))])


_OFF = "offs AS (SELECT CAST(r.range AS INT) - 2 AS dr, CAST(c.range AS INT) - 2 AS dc FROM range(4) r, range(4) c)"


@q("jn12_bucket_join", f"WITH {CELLS}, {LATTICE}, {_OFF} SELECT l.row, l.col, count(*) AS buckets, CAST(sum(c.n) AS BIGINT) AS n FROM lattice l, offs o, cells c WHERE c.row = l.row + o.dr AND c.col = l.col + o.dc GROUP BY l.row, l.col")
def _(spark, d):
    from sondegrid.operators.interp import neighbourhood

    c = C.count(pts(spark, d), SPEC)
    return neighbourhood(c, SPEC, 2).groupBy(*K).agg(F.count("*").alias("buckets"), F.sum("v").alias("n"))


# --- scans and sinks of points ---------------------------------------------------------------------------------------
@q("sc07_union_entries", f"WITH {PTS} SELECT src, count(*) AS n, CAST(sum(zc) AS BIGINT) AS s, src * 0.5E0 AS weight FROM pts GROUP BY src")
def _(spark, d):
    p = pts(spark, d)
    parts = [p.where(F.col("src") % 3 == k).withColumn("weight", F.col("src") * F.lit(0.5)) for k in range(3)]
    from sondegrid.sources.datalist import union_all

    return union_all(parts).groupBy("src").agg(F.count("*").alias("n"), F.sum("zc").alias("s"), F.max("weight").alias("weight"))


@q("sc14_raster_points", f"WITH {CELLS} SELECT -90.0E0 + col * 0.05E0 AS x, 30.0E0 + row * -0.05E0 AS y, s AS z FROM cells WHERE s BETWEEN -30000000 AND 30000000 AND n % 3 <> 0")
def _(spark, d):
    from sondegrid.operators.algebra import grid_points

    c = C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v"), F.count("*").alias("n"))
    return grid_points(c.select(*K, "v"), SPEC, z=(-30000000, 30000000), mask=c.where("n % 3 <> 0").select(*K))


@q("sc15_raster_window", f"WITH {CELLS} SELECT -90.0E0 + col * 0.05E0 AS x, 30.0E0 + row * -0.05E0 AS y, s AS z, 2.5E0 AS w FROM cells WHERE col >= 4 AND col < 12 AND row >= 6 AND row < 14")
def _(spark, d):
    from sondegrid.operators.algebra import grid_points
    from sondegrid.region import Region

    c = C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v"))
    return grid_points(c, SPEC, window=SPEC.srcwin(Region(-89.8, -89.4, 29.3, 29.7))).withColumn("w", F.lit(2.5))


@q("sc24_region_z_select", f"WITH {PTS} SELECT pid, x, y, zc FROM pts WHERE x >= -89.8E0 AND x <= -89.4E0 AND y >= 29.2E0 AND y <= 29.9E0 AND zc > -500000 AND zc < 500000")
def _(spark, d):
    from sondegrid.operators.filters import z_pass
    from sondegrid.region import Region

    return pts(spark, d).where(Region(-89.8, -89.4, 29.2, 29.9).contains() & z_pass("zc", 500000, -500000)).select("pid", "x", "y", "zc")


_TEXT = "printf('%.4f', x) || ' ' || printf('%.4f', y) || ' ' || CAST(zc AS VARCHAR)"


@q("sk01_xyz_line", f"WITH {PTS} SELECT pid, {_TEXT} AS line FROM pts")
def _(spark, d):
    from sondegrid.sinks import xyz_text

    fixed = lambda c: F.format_string("%.4f", F.col(c))
    return pts(spark, d).select("pid", xyz_text(fixed("x"), fixed("y"), F.col("zc")).alias("line"))


@q("sk02_parse_dump", f"WITH {PTS} SELECT {_TEXT} AS line FROM pts WHERE x >= -89.8E0 AND x <= -89.4E0 AND zc <> 0")
def _(spark, d):
    from sondegrid.region import Region
    from sondegrid.sinks import xyz_text
    from sondegrid.sources.xyz import XyzConfig, parse_xyz

    fixed = lambda c: F.format_string("%.4f", F.col(c))
    lines = pts(spark, d).where("zc <> 0").select(xyz_text(fixed("x"), fixed("y"), F.col("zc")).alias("line"))
    p = parse_xyz(lines, XyzConfig(), region=Region(-89.8, -89.4, -90.0, 90.0))
    return p.select(xyz_text(fixed("x"), fixed("y"), F.col("z").cast("bigint")).alias("line"))


@q("sk04_datalist_dump", f"WITH {PTS} SELECT src, count(*) AS lines, CAST(sum(length({_TEXT} || ' ' || CAST(CAST(w AS BIGINT) AS VARCHAR))) AS BIGINT) AS chars FROM pts GROUP BY src")
def _(spark, d):
    from sondegrid.sinks import xyz_text

    fixed = lambda c: F.format_string("%.4f", F.col(c))
    line = xyz_text(fixed("x"), fixed("y"), F.col("zc"), F.col("w").cast("bigint"))
    return pts(spark, d).select("src", line.alias("line")).groupBy("src").agg(F.count("*").alias("lines"), F.sum(F.length("line").cast("bigint")).alias("chars"))


@q("sk14_point_features", f"""WITH {PTS} SELECT pid, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(CAST(floor((x + 90.0E0) * 10000 + 0.5E0) AS BIGINT) AS VARCHAR) || ',' || CAST(zc AS VARCHAR) || ']}}}}' AS feature FROM pts""")
def _(spark, d):
    whole = F.floor((F.col("x") + F.lit(90.0)) * 10000 + F.lit(0.5)).cast("bigint")
    from sondegrid.sinks import point_feature

    return pts(spark, d).select("pid", point_feature(whole, F.col("zc")).alias("feature"))


@q("sk22_chunk_format", f"WITH {PTS} SELECT printf('%.8f %.8f %.2f', x, y, CAST(zc AS DOUBLE) / 100) AS line FROM pts WHERE zc / 100.0E0 > -99999 AND zc / 100.0E0 < 99999")
def _(spark, d):
    from sondegrid.operators.filters import z_pass

    p = pts(spark, d).withColumn("z", F.col("zc") / F.lit(100.0)).where(z_pass("z", 99999.0, -99999.0))
    return p.select(F.format_string("%.8f %.8f %.2f", "x", "y", "z").alias("line"))


QUERIES, SQL = q.queries, q.sql
