"""Conversions, configuration and the command line, by what they write and print."""

from __future__ import annotations

import contextlib
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from sondegrid import cli, sinks
from sondegrid.operators import algebra as A, cells as C, focal as N, joins as J
from sondegrid.plans.modules import MODULES, FetchJob, GridJob
from sondegrid.queries._base import BOXES, CELLS, ENTRIES, KEPT, LATTICE, PTS, SPEC, Registry, boxes, entries, kept, pts, table
from sondegrid.queries.files import las_points
from sondegrid.region import Region
from sondegrid.session import fresh_path, materialize
from sondegrid.sources import archive, catalog, connectors, datalist, las, xyz

q = Registry()
K = ["row", "col"]


def _text(spark, d, weight=False) -> str:
    """The points as text files; z in whole numbers."""
    path = fresh_path(spark, "xyz")
    sinks.write_xyz(pts(spark, d).select("x", "y", F.col("zc").alias("z"), "w"), path, weight)
    return path


def _printed(spark, *argv: str):
    """Lines that the command line prints."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.main([*argv])
    lines = out.getvalue().splitlines()
    return spark.createDataFrame([(x,) for x in lines], "line string")


@q("sk03_dump_entry", f"WITH {PTS} SELECT count(*) AS n, CAST(sum(zc) AS BIGINT) AS z, round(min(x), 4) AS x0, round(max(y), 4) AS y1 FROM pts WHERE x >= -89.5E0")
def _(spark, d):
    p = xyz.read_xyz(spark, _text(spark, d), region=Region(-89.5, 0.0, 0.0, 90.0))
    return p.agg(F.count("*").alias("n"), F.sum("z").cast("bigint").alias("z"), F.round(F.min("x"), 4).alias("x0"), F.round(F.max("y"), 4).alias("y1"))


@q("sk05_weighted_dump", f"WITH {PTS} SELECT count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM pts")
def _(spark, d):
    p = xyz.read_xyz(spark, _text(spark, d, True), xyz.XyzConfig(wpos=3))
    return p.agg(F.count("*").alias("n"), F.sum("w").cast("bigint").alias("w"))


@q("sk10_grid_text", f"WITH {CELLS}, {LATTICE}, r AS (SELECT l.row, string_agg(coalesce(CAST(n AS VARCHAR), '-9999'), ' ' ORDER BY l.col) AS line FROM lattice l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col GROUP BY l.row) SELECT row, line FROM r UNION ALL SELECT * FROM (VALUES (-6, 'ncols 20'), (-5, 'nrows 20'), (-4, 'xllcorner -90'), (-3, 'yllcorner 29'), (-2, 'cellsize 0.05'), (-1, 'NODATA_value -9999'))")
def _(spark, d):
    path = fresh_path(spark, "converted")
    sinks.write_grid(C.count(pts(spark, d), SPEC), SPEC, path)
    cells, spec = sinks.read_grid(spark, path)
    head = spark.createDataFrame([(i - 6, line) for i, line in enumerate(sinks.ascii_header(spec))], "row int, line string")
    return sinks.grid_rows(cells, spec).unionByName(head)


@q("sk16_grid_reference", f"WITH {CELLS} SELECT 4269 AS epsg, 20 AS nx, 20 AS ny, count(*) AS n, CAST(sum(n) AS BIGINT) AS points FROM cells")
def _(spark, d):
    from dataclasses import replace

    path = fresh_path(spark, "reference")
    sinks.write_grid(C.count(pts(spark, d), SPEC), replace(SPEC, epsg=4269), path)
    cells, spec = sinks.read_grid(spark, path)
    return cells.agg(F.lit(spec.epsg).alias("epsg"), F.lit(spec.nx).alias("nx"), F.lit(spec.ny).alias("ny"), F.count("*").alias("n"), F.sum("v").alias("points"))


def _catalog(spark, d):
    b = boxes(spark, d).where("xmin is not null")
    return b.select(F.col("file_id").cast("string").alias("ID"), "name", F.concat(F.lit("data/"), F.col("name")).alias("DataLink"), F.concat(F.lit("s"), F.col("source_id").cast("string")).alias("DataSource"), "xmin", "xmax", "ymin", "ymax")


@q("sk19_fetch_config", f"WITH {BOXES} SELECT CAST(file_id AS VARCHAR) AS id FROM boxes WHERE xmin <= 180.4E0 + 1.53E0 AND xmax >= 179.2E0 - 1.53E0 AND ymin <= 20.0E0 + 1.53E0 AND ymax >= -40.0E0 - 1.53E0 AND source_id IN (1, 2, 7)")
def _(spark, d):
    job = FetchJob(Region(179.2, 180.4, -40.0, 20.0), (), {"s1": {}, "s2": {}, "s7": {}})
    return FetchJob.from_json(job.to_json()).rows(_catalog(spark, d)).select(F.col("ID").alias("id"))


@q("sc25_source_entry", f"WITH {BOXES} SELECT 'data/' || name AS url FROM boxes WHERE xmin <= 180.4E0 AND xmax >= 179.2E0 AND ymin <= 20.0E0 AND ymax >= -40.0E0")
def _(spark, d):
    return connectors.connectors()["hrdem"].urls(_catalog(spark, d).withColumnRenamed("DataLink", "url"), Region(179.2, 180.4, -40.0, 20.0)).select("url")


@q("ra14_burnt_region", f"WITH {LATTICE} SELECT row, col, CASE WHEN row BETWEEN 5 AND 14 AND col BETWEEN 5 AND 14 THEN -9999 ELSE 0 END AS v FROM lattice")
def _(spark, d):
    from sondegrid import geom

    ring = geom.box_ring(*[F.lit(v) for v in (-89.76, -89.29, 29.29, 29.76)])
    return A.rasterize(spark, SPEC, F.array(ring), burn=-9999)


@q("ra15_nodata_converted", f"WITH {CELLS}, {LATTICE} SELECT l.row, l.col, coalesce(n, -32768) AS v FROM lattice l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    from dataclasses import replace

    path = fresh_path(spark, "nodata")
    sinks.write_grid(A.replace(C.dense(C.count(pts(spark, d), SPEC), SPEC), None, -32768), replace(SPEC, ndv=-32768.0), path, tags={"AREA_OR_POINT": "Area"})
    return sinks.read_grid(spark, path)[0].select(*K, "v")


_SHADE = "o AS (SELECT CAST(a.range AS INT) - 1 AS dr, CAST(b.range AS INT) - 1 AS dc FROM range(3) a, range(3) b), h AS (SELECT c.row - dr AS row, c.col - dc AS col, count(*) AS k, CAST(sum(n * dc * (2 - abs(dr))) AS DOUBLE) AS gx, CAST(sum(n * dr * (2 - abs(dc))) AS DOUBLE) AS gy FROM cells c, o GROUP BY 1, 2 HAVING count(*) = 9 AND c.row - dr BETWEEN 0 AND 19 AND c.col - dc BETWEEN 0 AND 19), s AS (SELECT row, col, gx / 40000 AS p, gy / 40000 AS r FROM h), shade AS (SELECT row, col, greatest(1.0E0, 1 + 254 * (sin(radians(45)) - cos(radians(45)) * (p * sin(radians(315)) - r * cos(radians(315)))) / sqrt(1 + p * p + r * r)) / 255 AS f FROM s)"


@q("ra17_shaded_relief", f"WITH {CELLS}, {_SHADE}, t AS (SELECT c.row, c.col, least(greatest(CAST(n AS DOUBLE), 0), 200) AS v, f FROM cells c JOIN shade ON c.row = shade.row AND c.col = shade.col), m AS (SELECT row, col, f, CASE WHEN v < 100 THEN 51.0E0 ELSE 51 + (187 - 51) * (v - 100) / 100 END AS r, CASE WHEN v < 100 THEN 102 + (204 - 102) * v / 100 ELSE 204 + (228 - 204) * (v - 100) / 100 END AS g, CASE WHEN v < 100 THEN 102 * v / 100 ELSE 102 + (146 - 102) * (v - 100) / 100 END AS b FROM t) SELECT row, col, round(least(255, r * f * 1.15E0), 4) AS r, round(least(255, g * f * 1.15E0), 4) AS g, round(least(255, b * f * 1.15E0), 4) AS b FROM m")
def _(spark, d):
    from sondegrid.functions import scalars as S

    c = C.count(pts(spark, d), SPEC)
    relief = [(t, S.RELIEF_COLORS[i]) for i, t in enumerate(S.RELIEF_TARGETS) if 0 <= t <= 200]
    out = A.shaded_relief(c, N.hillshade(c, SPEC, scale=100_000.0), [t for t, _ in relief], [x for _, x in relief])
    return out.select(*K, *[F.round(x, 4).alias(x) for x in "rgb"])


@q("cn19_fetch_queue", "SELECT true AS ok, count(*) AS n, CAST(sum(strlen(n_name)) AS BIGINT) AS bytes FROM nation UNION ALL SELECT false, 1, NULL")
def _(spark, d):
    path = fresh_path(spark, "queue")
    path = path if "://" in path else f"file://{path}"
    t = table(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("name"), F.encode("n_name", "UTF-8").alias("content"))
    sinks.write_files(t, path)
    urls = t.select("name").unionByName(spark.createDataFrame([("absent.txt",)], "name string")).select(F.concat(F.lit(path + "/"), F.col("name")).alias("url"))
    return catalog.fetch_all(urls, partitions=3).groupBy("ok").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes"))


@q("cn21_catalog_update", f"WITH {BOXES} SELECT DISTINCT CAST(file_id AS VARCHAR) AS id, CASE WHEN file_id % 3 = 0 THEN 'old' ELSE 'new' END AS said FROM boxes WHERE xmin IS NOT NULL AND ymin >= 0")
def _(spark, d):
    c = _catalog(spark, d)
    old, new = c.where("cast(ID as bigint) % 3 = 0").withColumn("said", F.lit("old")), c.withColumn("said", F.lit("new"))
    return catalog.find(catalog.add_absent(old, new, "ID"), where=["ymin >= 0"]).select(F.col("ID").alias("id"), "said").distinct()


@q("sc32_unzip", "SELECT n_name AS member, CAST(strlen(n_name) AS INT) AS bytes FROM nation")
def _(spark, d):
    def pack(batches):
        for b in batches:
            out = []
            for key, name in zip(b["n_nationkey"], b["n_name"]):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    z.writestr(f"{name}.XYZ", name)
                    z.writestr("notes.pdf", "none")
                out.append((f"{key}.zip", raw.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    a = table(spark, d, "nation").select("n_nationkey", "n_name").mapInPandas(pack, "path string, content binary")
    m = archive.members(a, ["xyz"])
    return m.select(F.regexp_replace("member", r"[.]XYZ$", "").alias("member"), F.length("content").alias("bytes"))


@q("ud02_entry_formats", f"WITH {ENTRIES}, f AS (SELECT * FROM (VALUES (-1, 'datalist'), (-2, 'archive'), (-4, 'remote'), (168, 'xyz'), (200, 'gdal'), (300, 'lasf')) t(fmt, name)) SELECT f.name, count(*) AS n FROM entries e JOIN f ON e.fmt = f.fmt GROUP BY f.name")
def _(spark, d):
    names = datalist.format_table(spark).select("fmt", "name").distinct()
    return entries(spark, d).join(F.broadcast(names), "fmt").groupBy("name").agg(F.count("*").alias("n"))


@q("vd02_offset_points", f"WITH {KEPT} SELECT row, col, CAST(sum(zc - (row * 10 + col)) AS BIGINT) AS z, count(*) AS n FROM kept GROUP BY row, col")
def _(spark, d):
    offsets = SPEC.lattice(spark).withColumn("v", F.col("row") * 10 + F.col("col"))
    grid = MODULES["vdatum"](pts(spark, d), SPEC, offsets=offsets)["dem"]
    p = J.query_grid(kept(spark, d).drop(*K).withColumnRenamed("zc", "z"), grid, SPEC)
    return SPEC.index(p).groupBy(*K).agg(F.sum("d").cast("bigint").alias("z"), F.count("*").alias("n"))


# --- the command line ------------------------------------------------------------------------------------------------
# points on the border of the region are within the wider region that a job grids
@q("ct01_grid_command", f"WITH {PTS}, b AS (SELECT CAST(floor((x + 90.0E0) / 0.05E0 + 0.5E0) AS INT) AS col, CAST(floor((y - 30.0E0) / -0.05E0 + 0.5E0) AS INT) AS row FROM pts) SELECT CAST(count(*) AS BIGINT) AS points, count(DISTINCT row * 100 + col) AS cells FROM b WHERE row BETWEEN 0 AND 19 AND col BETWEEN 0 AND 19")
def _(spark, d):
    out = fresh_path(spark, "ct01")
    cli.main(["grid", _text(spark, d), "-M", "num:mode=n", "-R", "-90/-89/29/30", "-E", "0.05", "-O", out])
    return sinks.read_grid(spark, f"{out}/dem")[0].agg(F.sum("v").alias("points"), F.count("*").alias("cells"))


@q("ct02_fetch_command", f"WITH {BOXES} SELECT DISTINCT 'data/' || file_id || '.xyz' AS line FROM boxes WHERE xmin <= 180.4E0 + 1.53E0 AND xmax >= 179.2E0 - 1.53E0 AND ymin <= 20.0E0 + 1.53E0 AND ymax >= -40.0E0 - 1.53E0 AND source_id IN (1, 2, 7)")
def _(spark, d):
    path = fresh_path(spark, "catalog")
    _catalog(spark, d).withColumn("DataLink", F.concat(F.lit("data/"), F.col("ID"), F.lit(".xyz"))).dropDuplicates(["ID"]).write.parquet(path)
    return _printed(spark, "fetch", path, "s1", "s2", "s7", "-R", "179.2/180.4/-40/20")


def _datalist(spark, d):
    """The points in two files, and a datalist that names them."""
    path = fresh_path(spark, "datalist")
    for k in (0, 1):
        sinks.write_xyz(pts(spark, d).where(F.col("pid") % 2 == k).select("x", "y", F.col("zc").alias("z")), f"{path}/{k}.xyz")
        sinks.append_entry(spark, f"{path}/list.datalist", (f"{path}/{k}.xyz", 168, k + 1))
    return path


@q("ct03_datalist_command", "SELECT * FROM (VALUES ('0.xyz 168 1.0 '), ('1.xyz 168 2.0 ')) t(line)")
def _(spark, d):
    lines = _printed(spark, "datalists", f"{_datalist(spark, d)}/list.datalist", "--list")
    return lines.select(F.element_at(F.split("line", "/"), -1).alias("line"))


@q("ct05_datalist_dump", f"WITH {PTS} SELECT count(*) AS n, CAST(sum(zc) AS BIGINT) AS z FROM pts WHERE x >= -89.75E0 AND x <= -89.5E0")
def _(spark, d):
    lines = _printed(spark, "datalists", f"{_datalist(spark, d)}/list.datalist", "-R", "-89.75/-89.5/0/90")
    return lines.agg(F.count("*").alias("n"), F.sum(F.element_at(F.split("line", " "), 3).cast("double")).cast("bigint").alias("z"))


@q("ct10_grid_tools", f"WITH {CELLS} SELECT 'upper' AS tool, count(*) AS n FROM cells WHERE n >= 15 UNION ALL SELECT 'lower', count(*) FROM cells WHERE n < 15 UNION ALL SELECT 'cut', count(*) FROM cells WHERE row BETWEEN 10 AND 19 AND col BETWEEN 0 AND 9 UNION ALL SELECT 'points', count(*) FROM cells UNION ALL SELECT 'crop', count(*) FROM cells UNION ALL SELECT 'chunk', count(*) FROM cells")
def _(spark, d):
    from functools import reduce

    root = fresh_path(spark, "ct10")
    sinks.write_grid(C.count(pts(spark, d), SPEC), SPEC, f"{root}/grid")
    run = lambda what, *more: cli.main(["tool", what, f"{root}/grid", "-O", f"{root}/{what}", *more])
    run("split", "-V", "15")
    run("cut", "-R", "-90/-89.5/29/29.5")
    run("points")
    run("crop")
    run("chunk", "-V", "5")
    grid = lambda p: sinks.read_grid(spark, f"{root}/{p}")[0]
    made = {"upper": grid("split/upper"), "lower": grid("split/lower"), "cut": grid("cut"), "points": spark.read.text(f"{root}/points"), "crop": grid("crop"), "chunk": spark.read.parquet(f"{root}/chunk")}
    return reduce(lambda a, b: a.unionByName(b), [t.agg(F.lit(k).alias("tool"), F.count("*").alias("n")) for k, t in made.items()])


@q("ct11_create_datalist", "SELECT n_nationkey || '.xyz 168 1.0' AS line FROM nation")
def _(spark, d):
    path = fresh_path(spark, "ct11")
    sinks.write_files(table(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".xyz")).alias("name"), F.encode("n_name", "UTF-8").alias("content")), path)
    return _printed(spark, "datalists", path, "--glob").select(F.element_at(F.split("line", "/"), -1).alias("line"))


def _headers(spark, d):
    """The headers of the points' LAS files."""
    p = las_points(spark, d)
    files = p.select("path").distinct()
    raw = spark.read.format("binaryFile").load(materialize(files, "las-names").first()["path"].rpartition("/")[0])

    def read(batches):
        for b in batches:
            h = [las.parse_header(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({k: [x[k] for x in h] for k in ("numptrecords", "pointformat", "headersize", "offset", "numvlrecords", "xscale", "zscale", "xmin", "ymax")} | {"returns": [sum(x["numptbyreturn"]) for x in h]})

    return raw.select("content").mapInPandas(read, "numptrecords bigint, pointformat int, headersize int, offset int, numvlrecords int, xscale double, zscale double, xmin double, ymax double, returns bigint")


@q("ct12_las_headers", f"WITH {PTS} SELECT count(*) AS n, count(*) AS returns, round(min(x), 4) AS x0, round(max(y), 4) AS y1 FROM pts")
def _(spark, d):
    return _headers(spark, d).agg(F.sum("numptrecords").alias("n"), F.sum("returns").alias("returns"), F.round(F.min("xmin"), 4).alias("x0"), F.round(F.max("ymax"), 4).alias("y1"))


@q("ct13_las_fields", "SELECT 1 AS pointformat, 227 AS headersize, 227 AS start, 0 AS records, 1.0E-7 AS xscale, 0.001E0 AS zscale")
def _(spark, d):
    return _headers(spark, d).select("pointformat", "headersize", F.col("offset").alias("start"), F.col("numvlrecords").alias("records"), "xscale", "zscale").distinct()


@q("ct04_job_defaults", "SELECT 'num' AS module, 'node' AS registration, 20 AS extend_proc, 0 AS extend, -91.0E0 AS xmin, -88.0E0 AS xmax")
def _(spark, d):
    job = GridJob.from_json(GridJob().to_json())
    r = job.proc_region
    return spark.createDataFrame([(job.module, job.registration, job.extend_proc, job.extend, r.xmin, r.xmax)], "module string, registration string, extend_proc int, extend int, xmin double, xmax double")


QUERIES, SQL = q.queries, q.sql
