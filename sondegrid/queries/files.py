"""Readers and writers of files, by what comes back: each query writes to the shared folder and reads it again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sondegrid import sinks
from sondegrid.operators import cells as C
from sondegrid.queries._base import CELLS, KEPT, LATTICE, PTS, SPEC, Registry, pts
from sondegrid.session import fresh_path, materialize
from sondegrid.sources import archive, las

q = Registry()
K = ["row", "col"]


def points(spark, d):
    """The points with the columns of LAS files."""
    return pts(spark, d).select("x", "y", (F.col("zc") / F.lit(1000.0)).alias("z"), (F.col("pid") % 4 + 1).cast("int").alias("return_num"), (F.col("pid") % 31).cast("int").alias("classification"), F.col("w").cast("int").alias("intensity"))


def las_points(spark, d, p=None, **options):
    """The points, or those of ``p``, as LAS files in the shared folder, read through the data source with its options."""
    p = points(spark, d) if p is None else p
    path = fresh_path(spark, "las")
    sinks.write_las(p.repartition(8, "x", "y").sortWithinPartitions(*p.columns), path)  # in order, so a retry replaces files by the same
    las.register(spark)
    return spark.read.format("las").options(**options).load(path)


def all_points(spark, d):
    """The points through LAS files, and as they are those that no LAS file holds."""
    p = points(spark, d)
    held = sinks.las_holds(p)
    return las_points(spark, d, p.where(held)).unionByName(p.where(~held), allowMissingColumns=True)


@q("sc20_las_points", f"WITH {PTS} SELECT count(*) AS n, CAST(sum(zc) AS BIGINT) AS s, round(min(x), 4) AS x0, round(max(y), 4) AS y1 FROM pts")
def _(spark, d):
    return las_points(spark, d).agg(F.count("*").alias("n"), F.sum(F.round(F.col("z") * 1000).cast("bigint")).alias("s"), F.round(F.min("x"), 4).alias("x0"), F.round(F.max("y"), 4).alias("y1"))


@q("sc16_las_ground", f"WITH {PTS} SELECT pid % 31 AS classification, count(*) AS n FROM pts WHERE pid % 31 IN (2, 29) AND x >= -89.5E0 GROUP BY pid % 31")
def _(spark, d):
    p = las_points(spark, d, classes="2,29", xmin=-89.5 - 1e-9).where(F.col("classification").isin(2, 29) & (F.col("x") >= F.lit(-89.5 - 1e-9)))
    return p.groupBy(F.col("classification").cast("bigint").alias("classification")).agg(F.count("*").alias("n"))


@q("pr15_class_filter", f"WITH {PTS} SELECT count(*) AS n FROM pts WHERE pid % 31 IN (2, 29)")
def _(spark, d):
    from sondegrid.operators.filters import keep_classes

    return keep_classes(las_points(spark, d, classes="2,29")).agg(F.count("*").alias("n"))


@q("sc22_las_dump", f"WITH {PTS} SELECT pid % 31 AS c, CAST(sum(zc) AS BIGINT) AS z FROM pts WHERE pid % 31 = 7 GROUP BY 1")
def _(spark, d):
    p = las_points(spark, d, classes="7").where("classification = 7")
    line = sinks.xyz_text(F.col("classification"), F.round(F.col("z") * 1000).cast("bigint"), sep=",")
    t = F.split(line, ",")
    return p.groupBy(t[0].cast("bigint").alias("c")).agg(F.sum(t[1].cast("bigint")).alias("z"))


@q("ag30_return_stats", f"WITH {PTS} SELECT pid % 4 + 1 AS return_num, count(*) AS n, min(zc) AS lo, max(zc) AS hi FROM pts GROUP BY 1")
def _(spark, d):
    z = F.round(F.col("z") * 1000).cast("bigint")
    return all_points(spark, d).groupBy(F.col("return_num").cast("bigint").alias("return_num")).agg(F.count("*").alias("n"), F.min(z).alias("lo"), F.max(z).alias("hi"))


@q("ag12_las_envelope", f"WITH {PTS} SELECT count(*) AS numpts, round(min(x), 4) AS xmin, round(max(x), 4) AS xmax FROM pts")
def _(spark, d):
    return C.envelope(all_points(spark, d)).select("numpts", F.round("xmin", 4).alias("xmin"), F.round("xmax", 4).alias("xmax"))


@q("sc18_las_header", "SELECT true AS same, 2 AS records")
def _(spark, d):
    raw = sinks.las_header(7, (1.0, 2.0, 3.0, 4.0, -5.0, 6.0), [4, 3, 0, 0, 0])
    h = las.parse_header(raw)
    vlr = b"".join(las._VLR.pack(0, b"me", k, 3, b"text") + b"abc" for k in (1, 2))
    recs = las.parse_vlrs(raw + vlr, h | {"numvlrecords": 2})
    same = (h["numptrecords"], h["xmin"], h["zmin"], h["zmax"], h["numptbyreturn"][:2]) == (7, 1.0, -5.0, 6.0, [4, 3])
    return spark.createDataFrame([(same and recs[1]["data"] == b"abc", len(recs))], "same boolean, records int")


@q("sc09_archive_points", f"WITH {PTS} SELECT count(*) AS n, CAST(sum(zc) AS BIGINT) AS s, CAST(sum(w) AS BIGINT) AS w FROM (SELECT zc, 3 AS w FROM pts)")
def _(spark, d):
    import io
    import zipfile

    path = fresh_path(spark, "archive")
    lines = pts(spark, d).select(F.pmod(F.xxhash64("pid"), F.lit(64)).alias("part"), F.format_string("%.4f %.4f %d", "x", "y", "zc").alias("line"))

    def pack(key, p: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr(f"a{key[0]}.xyz", "\n".join(p["line"]))
            z.writestr("readme.txt", "no points")
        return pd.DataFrame({"name": [f"{key[0]}.zip"], "content": [raw.getvalue()]})

    sinks.write_files(lines.groupBy("part").applyInPandas(pack, "name string, content binary"), path)
    p = archive.archive_points(spark, path, 3.0)
    return p.agg(F.count("*").alias("n"), F.sum(F.col("z").cast("bigint")).alias("s"), F.sum("w").cast("bigint").alias("w"))


@q("sk07_archive_tee", f"WITH {PTS} SELECT src, count(*) AS n FROM pts GROUP BY src")
def _(spark, d):
    t = sinks.tee(pts(spark, d), fresh_path(spark, "tee"), ["src"])
    return t.groupBy(F.col("src").cast("bigint").alias("src")).agg(F.count("*").alias("n"))


@q("sk08_grid_round_trip", f"WITH {CELLS} SELECT row, col, s AS v, 20 AS nx FROM cells")
def _(spark, d):
    path = fresh_path(spark, "grid")
    sinks.write_grid(C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v")), SPEC, path)
    c, spec = sinks.read_grid(spark, path)
    return c.select(*K, "v", F.lit(spec.nx).alias("nx"))


@q("sk09_ascii_rows", f"WITH {CELLS}, l AS (SELECT CAST(r.range AS INT) AS row, CAST(c.range AS INT) AS col FROM range(20) r, range(20) c) SELECT l.row, string_agg(coalesce(CAST(n AS VARCHAR), '-9999'), ' ' ORDER BY l.col) AS line FROM l LEFT JOIN (SELECT * FROM cells WHERE n % 3 = 0) c ON l.row = c.row AND l.col = c.col GROUP BY l.row")
def _(spark, d):
    return sinks.grid_rows(C.count(pts(spark, d), SPEC).where("v % 3 = 0"), SPEC)


@q("sk21_chunk_files", f"WITH {KEPT} SELECT row // 5 AS chunk_row, col // 5 AS chunk_col, count(*) AS n FROM kept GROUP BY 1, 2")
def _(spark, d):
    p = SPEC.index(pts(spark, d)).withColumn("chunk_row", F.floor(F.col("row") / 5).cast("int")).withColumn("chunk_col", F.floor(F.col("col") / 5).cast("int"))
    path = fresh_path(spark, "chunks")
    p.repartition("chunk_row", "chunk_col").write.partitionBy("chunk_row", "chunk_col").parquet(path)
    return spark.read.parquet(path).groupBy("chunk_row", "chunk_col").agg(F.count("*").alias("n"))


_NEAR = """e AS (SELECT row, col, n AS v FROM cells WHERE n % 3 <> 0),
 near AS (SELECT l.row, l.col, max(CASE WHEN l.row = e.row AND l.col = e.col THEN v END) AS own, arg_max(v, e.row) FILTER (WHERE e.col = l.col AND e.row < l.row) AS u, l.row - max(e.row) FILTER (WHERE e.col = l.col AND e.row < l.row) AS ud,
 arg_min(v, e.row) FILTER (WHERE e.col = l.col AND e.row > l.row) AS d, min(e.row) FILTER (WHERE e.col = l.col AND e.row > l.row) - l.row AS dd, arg_max(v, e.col) FILTER (WHERE e.row = l.row AND e.col < l.col) AS f, l.col - max(e.col) FILTER (WHERE e.row = l.row AND e.col < l.col) AS fd,
 arg_min(v, e.col) FILTER (WHERE e.row = l.row AND e.col > l.col) AS g, min(e.col) FILTER (WHERE e.row = l.row AND e.col > l.col) - l.col AS gd FROM lattice l JOIN e ON e.row = l.row OR e.col = l.col GROUP BY l.row, l.col),
 filled AS (SELECT row, col, own IS NULL AS new, coalesce(own, (coalesce(u / CAST(ud AS DOUBLE), 0) + coalesce(d / CAST(dd AS DOUBLE), 0) + coalesce(f / CAST(fd AS DOUBLE), 0) + coalesce(g / CAST(gd AS DOUBLE), 0)) / (coalesce(1.0E0 / ud, 0) + coalesce(1.0E0 / dd, 0) + coalesce(1.0E0 / fd, 0) + coalesce(1.0E0 / gd, 0))) AS v FROM near)"""


@q("wn11_fill_nodata", f"WITH {CELLS}, {LATTICE}, {_NEAR} SELECT row, col, round(v, 6) AS v FROM filled")
def _(spark, d):
    from sondegrid.operators.focal import fill_nodata

    return fill_nodata(C.count(pts(spark, d), SPEC).where("v % 3 <> 0"), SPEC).select(*K, F.round("v", 6).alias("v"))


@q("wn11_fill_smoothed", f"WITH {CELLS}, {LATTICE}, {_NEAR}, s AS (SELECT a.row, a.col, CASE WHEN any_value(a.new) THEN avg(b.v) ELSE any_value(a.v) END AS v FROM filled a JOIN filled b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col) SELECT row, col, round(v, 5) AS v FROM s")
def _(spark, d):
    from sondegrid.operators.focal import fill_nodata

    return fill_nodata(C.count(pts(spark, d), SPEC).where("v % 3 <> 0"), SPEC, smooth=1).select(*K, F.round("v", 5).alias("v"))


@q("gr11_composite", f"WITH {CELLS}, {LATTICE} SELECT l.row, l.col, round(CAST(s AS DOUBLE) / n / 100000 + 1.23E-6, 5) AS v FROM lattice l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    from sondegrid.plans.modules import MODULES

    p = pts(spark, d).withColumn("z", F.col("zc") / F.lit(100_000.0))
    at = SPEC.index(p).select(*K).distinct().withColumn("own", F.lit(True))
    return MODULES["composite"](p, SPEC)["dem"].join(at, K, "left").select(*K, F.when(F.col("own"), F.round(F.col("v") + 1.23e-6, 5)).alias("v"))


@q("gr14_coastline", f"WITH {CELLS}, k AS (SELECT row, col, CASE WHEN avg(zc) >= 0 THEN 1 ELSE 0 END AS v FROM (SELECT * FROM kept WHERE zc < 100000 AND zc > -100000) GROUP BY row, col) SELECT row, col, v FROM k")
def _(spark, d):
    from sondegrid.plans.modules import MODULES

    p = pts(spark, d).withColumn("z", F.col("zc") / F.lit(100_000.0))
    return MODULES["coastline"](p, SPEC)["dem"].where("v is not null")


@q("gr15_landmask", f"WITH {CELLS}, l AS (SELECT CAST(r.range AS INT) AS row, CAST(c.range AS INT) AS col FROM range(20) r, range(20) c) SELECT l.row, l.col, CASE WHEN s IS NULL THEN 0 WHEN s >= 0 THEN -1 ELSE 1 END AS v FROM l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    from sondegrid.plans.modules import MODULES

    return MODULES["landmask"](pts(spark, d).withColumnRenamed("zc", "z"), SPEC)["dem"]


@q("gr16_uncertainty", f"WITH {CELLS}, {LATTICE} SELECT l.row, l.col, c.row IS NULL AS uncertain FROM lattice l LEFT JOIN (SELECT * FROM cells WHERE (row * 7 + col * 3) % 5 = 0) c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    from sondegrid.plans.modules import MODULES

    p = SPEC.index(pts(spark, d)).where("(row * 7 + col * 3) % 5 = 0").select("x", "y", (F.col("zc") / F.lit(100_000.0)).alias("z"))
    return MODULES["uncertainty"](p, SPEC)["dem"].select(*K, (F.col("v") > 0).alias("uncertain"))


@q("gr17_pipeline", f"WITH {CELLS} SELECT row, col, s AS v FROM cells WHERE row >= 4 AND row < 16 AND col >= 4 AND col < 16")
def _(spark, d):
    # the job's own grid begins at another corner, so its cells are looked up by their place
    from sondegrid.plans.modules import GridJob
    from sondegrid.region import Region

    job = GridJob.from_json(GridJob("num", Region(-89.8, -89.2, 29.2, 29.8), 0.05, extend_proc=4, options={"mode": "As"}).to_json())
    out = job.run(pts(spark, d).withColumnRenamed("zc", "z"))["dem"]
    return out.select((F.col("row") + 4).cast("int").alias("row"), (F.col("col") + 4).cast("int").alias("col"), "v")


QUERIES, SQL = q.queries, q.sql
