"""The rest of the inventory: metadata, conversions, connectors, extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondegrid import geom, sinks
from sondegrid.functions import scalars as S
from sondegrid.grid import GridSpec
from sondegrid.operators import algebra as A, cells as C, focal as N, joins as J, uncertainty as U
from sondegrid.queries._base import BOXES, CELLS, KEPT, LATTICE, PTS, SPEC, Registry, boxes, kept, pts, table
from sondegrid.region import Region

q = Registry()
K = ["row", "col"]
_R = Region(179.2, 180.4, -40.0, 20.0)
_MEETS = "xmin <= 180.4E0 AND xmax >= 179.2E0 AND ymin <= 20.0E0 AND ymax >= -40.0E0"
B4 = ["xmin", "xmax", "ymin", "ymax"]


def one(spark, schema, *values):
    return spark.createDataFrame([values], schema)


def ringed(spark, d):
    return boxes(spark, d).where("xmin is not null and xmin <= xmax and ymin <= ymax").withColumn("rings", F.array(geom.box_ring(*[F.col(c) for c in B4])))


@q("pr10_polygon_intersect", f"WITH {BOXES}, regs(rid, xmin, xmax, ymin, ymax) AS (VALUES (1, 179.0E0, 179.5E0, -60.0E0, 60.0E0), (2, -180.0E0, -179.2E0, -20.0E0, 70.0E0)) SELECT file_id, rid FROM boxes b, regs r WHERE b.xmin <= r.xmax AND b.xmax >= r.xmin AND b.ymin <= r.ymax AND b.ymax >= r.ymin AND b.xmin < b.xmax AND b.ymin < b.ymax")
def _(spark, d):
    regs = spark.createDataFrame([(1, 179.0, 179.5, -60.0, 60.0), (2, -180.0, -179.2, -20.0, 70.0)], "rid int, xmin double, xmax double, ymin double, ymax double")
    regs = regs.withColumn("rings", F.array(geom.box_ring(*[F.col(c) for c in B4])))
    return J.polygon_join(ringed(spark, d).where("xmin < xmax and ymin < ymax"), regs, 2.0, "file_id", "rid")


@q("pr12_entry_polygon", f"WITH {BOXES} SELECT file_id FROM boxes WHERE {_MEETS} AND xmin < xmax AND ymin < ymax")
def _(spark, d):
    r = one(spark, "rid int, xmin double, xmax double, ymin double, ymax double", 1, 179.2, 180.4, -40.0, 20.0)
    r = r.withColumn("rings", geom.wkt_rings(F.lit("POLYGON ((179.2 -40,179.2 20,180.4 20,180.4 -40,179.2 -40))")))
    return J.polygon_join(ringed(spark, d).where("xmin < xmax and ymin < ymax"), r, 2.0, "file_id", "rid").select("file_id")


@q("pr19_job_valid", "SELECT true AS ok, false AS bad")
def _(spark, d):
    from sondegrid.plans.modules import MODULES, GridJob

    ok = lambda j: j.module in MODULES and j.region.valid and j.inc > 0
    return one(spark, "ok boolean, bad boolean", ok(GridJob()), ok(GridJob("none")))


@q("fn03_inverse_transform", f"WITH {PTS} SELECT pid, (x + 90.0E0) / 0.05E0 AS c, (y - 30.0E0) / -0.05E0 AS r FROM pts")
def _(spark, d):
    c, r = (F.col("x") - F.lit(SPEC.xmin)) / F.lit(SPEC.dx), (F.col("y") - F.lit(SPEC.ymax)) / F.lit(SPEC.dy)
    return pts(spark, d).select("pid", c.alias("c"), r.alias("r"))


@q("fn05_region2gt", "SELECT 20 AS nx, 40 AS ny, -90.0E0 AS x0, 30.0E0 AS y0, -0.025E0 AS dy")
def _(spark, d):
    s = GridSpec.from_region(Region(-90.0, -89.0, 29.0, 30.0), 0.05, -0.025)
    return one(spark, "nx int, ny int, x0 double, y0 double, dy double", s.nx, s.ny, s.xmin, s.ymax, s.dy)


@q("fn06_gt2region", "SELECT 0.0E0 AS xmin, 10.0E0 AS xmax, 0.0E0 AS ymin, 10.0E0 AS ymax")
def _(spark, d):
    r = GridSpec.from_region(Region(0.0, 10.0, 0.0, 10.0), 2.0).region()
    return one(spark, "xmin double, xmax double, ymin double, ymax double", r.xmin, r.xmax, r.ymin, r.ymax)


@q("fn15_region_warp", f"WITH {BOXES} SELECT file_id, round(6378137.0E0 * radians(xmin), 3) AS xmin, round(6378137.0E0 * radians(xmax), 3) AS xmax FROM boxes WHERE xmin IS NOT NULL")
def _(spark, d):
    b = boxes(spark, d).where("xmin is not null")
    (x0, _), (x1, _) = S.mercator(F.col("xmin"), F.col("ymin")), S.mercator(F.col("xmax"), F.col("ymax"))
    return b.select("file_id", F.round(x0, 3).alias("xmin"), F.round(x1, 3).alias("xmax"))


@q("fn18_increment_name", "SELECT '13' AS third, '1' AS one, '19' AS ninth")
def _(spark, d):
    return one(spark, "third string, one string, ninth string", *[S.increment_name(v / 3600) for v in (1 / 3, 1.0, 1 / 9)])


@q("fn19_grid_name", "SELECT 'x13_n30x00_w090x00_2024v1' AS name")
def _(spark, d):
    return one(spark, "name string", S.grid_name("x", 1 / 10800, "n30x00_w090x00", 2024))


@q("fn32_iso_metadata", "SELECT o_orderkey, o_orderpriority AS title, '1996' AS date FROM orders")
def _(spark, d):
    from sondegrid.sources.catalog import iso_metadata

    xml = F.concat(F.lit("<m><MD_DataIdentification><title>"), "o_orderpriority", F.lit("</title></MD_DataIdentification><CI_Date><date>1996-01</date></CI_Date><abstract>"), F.col("o_orderkey").cast("string"), F.lit("</abstract></m>"))
    return iso_metadata(table(spark, d, "orders").select(xml.alias("xml"))).select(F.col("abstract").cast("bigint").alias("o_orderkey"), "title", "date")


@q("fn38_grid_metadata", "SELECT 3857 AS epsg, -1.0E0 AS ndv")
def _(spark, d):
    from dataclasses import replace

    s = GridSpec.from_json(replace(SPEC, epsg=3857, ndv=-1.0).to_json())
    return one(spark, "epsg int, ndv double", s.epsg, s.ndv)


@q("fn40_job_regions", "SELECT -0.25E0 AS grid, -0.5E0 AS proc, 0.0E0 AS dist")
def _(spark, d):
    from sondegrid.plans.modules import GridJob

    j = GridJob(region=Region(0.0, 4.0, 0.0, 4.0), inc=0.5, extend_proc=1)
    return one(spark, "grid double, proc double, dist double", j.grid_region.xmin, j.proc_region.xmin, j.dist_region.xmin)


@q("sc08_archive_entries", "SELECT 2 AS members, 168 AS fmt")
def _(spark, d):
    import io
    import zipfile

    from sondegrid.sources.archive import members
    from sondegrid.sources.datalist import format_of

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n in ("a.xyz", "b.xyz", "c.txt"):
            z.writestr(n, "1 2 3")
    m = members(one(spark, "path string, content binary", "x.zip", buf.getvalue()), ["xyz"])
    return m.agg(F.count("*").cast("int").alias("members"), F.max(format_of(F.col("member"))).alias("fmt"))


@q("sc28_feature_polygons", f"WITH {BOXES} SELECT file_id, true AS ok FROM boxes WHERE xmin IS NOT NULL AND xmin <= xmax AND ymin <= ymax")
def _(spark, d):
    w = ringed(spark, d).select("file_id", geom.polygon_wkt(F.col("rings")).alias("w"))
    return w.select("file_id", F.col("w").rlike(r"^POLYGON \(\(.*\)\)$").alias("ok"))


@q("sc30_fields", "SELECT 'n_nationkey,n_name,n_regionkey' AS fields")
def _(spark, d):
    return one(spark, "fields string", ",".join(c for c in table(spark, d, "nation").columns if c in ("n_nationkey", "n_name", "n_regionkey")))


@q("sc35_gunzip", "SELECT 'a.xyz' AS member, 5 AS size")
def _(spark, d):
    import gzip

    from sondegrid.sources.archive import members

    return members(one(spark, "path string, content binary", "p/a.xyz.gz", gzip.compress(b"1 2 3")), ["xyz"]).select("member", F.length("content").alias("size"))


@q("sk06_append_entry", "SELECT 'a.xyz 168 1' AS value UNION ALL SELECT 'b.xyz 168 0.5'")
def _(spark, d):
    from sondegrid.session import fresh_path

    path = fresh_path(spark, "datalist")
    sinks.append_entry(spark, path, ("a.xyz", 168, 1))
    sinks.append_entry(spark, path, ("b.xyz", 168, 0.5))
    return spark.read.text(path)


@q("sk13_point_view", f"WITH {PTS} SELECT count(*) AS n, min(zc) AS elev FROM pts")
def _(spark, d):
    pts(spark, d).select(F.col("x").alias("long"), F.col("y").alias("lat"), F.col("zc").alias("elev")).createOrReplaceTempView("sondegrid_points")
    return spark.sql("SELECT count(*) AS n, min(elev) AS elev FROM sondegrid_points")


@q("sk20_grid_tags", "SELECT 'Point' AS area_or_point, 'x' AS note")
def _(spark, d):
    import json

    from sondegrid.session import fresh_path

    path = fresh_path(spark, "tags")
    sinks.write_grid(C.count(pts(spark, d), SPEC), SPEC, path, tags={"note": "x"})
    t = json.loads(spark.read.text(f"{path}/grid").first()["value"])["tags"]
    return one(spark, "area_or_point string, note string", t["AREA_OR_POINT"], t["note"])


@q("sk23_transform", f"WITH {PTS} SELECT printf('%.4f', x) || ' ' || printf('%.4f', y) || ' ' || CAST(-zc AS VARCHAR) AS line FROM pts WHERE x >= -89.5E0")
def _(spark, d):
    from sondegrid.sources.xyz import XyzConfig, parse_xyz

    fixed = lambda c: F.format_string("%.4f", F.col(c))
    lines = pts(spark, d).select(sinks.xyz_text(fixed("x"), fixed("y"), F.col("zc"), sep=",").alias("line"))
    p = parse_xyz(lines, XyzConfig(z_scale=-1.0), region=Region(-89.5, 0.0, -90.0, 90.0))
    return p.select(sinks.xyz_text(fixed("x"), fixed("y"), F.col("z").cast("bigint")).alias("line"))


_KERNEL = "k AS (SELECT CAST(a.range AS INT) - 1 AS i, CAST(b.range AS INT) - 1 AS j FROM range(3) a, range(3) b), w AS (SELECT i, j, exp(-(i * i + j * j) / 1.0E0) / (SELECT sum(exp(-(i * i + j * j) / 1.0E0)) FROM k) AS w FROM k)"


@q("wn03_blur_below_zero", f"WITH {CELLS}, {LATTICE}, {_KERNEL}, e AS (SELECT * FROM cells WHERE s < 0), t AS (SELECT l.row, l.col, CASE WHEN l.row + i < 0 THEN -1 - (l.row + i) WHEN l.row + i > 19 THEN 39 - (l.row + i) ELSE l.row + i END AS r, CASE WHEN l.col + j < 0 THEN -1 - (l.col + j) WHEN l.col + j > 19 THEN 39 - (l.col + j) ELSE l.col + j END AS c, w FROM e l, w), b AS (SELECT t.row, t.col, sum(coalesce(c.s, 0) * w) AS v FROM t LEFT JOIN e c ON t.r = c.row AND t.c = c.col GROUP BY t.row, t.col) SELECT row, col, round(v, 2) AS v FROM b UNION ALL SELECT row, col, round(CAST(s AS DOUBLE), 2) FROM cells WHERE s >= 0")
def _(spark, d):
    u, low = A.split(C.aggregate(pts(spark, d), SPEC, F.sum("zc").cast("double").alias("v")), 0)
    return A.recombine(u, N.blur(low, SPEC, 1)).select(*K, F.round("v", 2).alias("v"))


@q("wn14_next_breakpoint", "SELECT * FROM (VALUES (-11000.0E0, -10500.0E0), (-0.001E0, 0.0E0), (7500.0E0, 8000.0E0)) t(v, nxt)")
def _(spark, d):
    from pyspark.sql import Window

    t = spark.createDataFrame([(float(v),) for v in S.RELIEF_TARGETS], "v double")
    return t.withColumn("nxt", F.lead("v").over(Window.orderBy("v"))).where("v in (-11000, -0.001, 7500)")


@q("so02_apart_order", "SELECT 9 AS n, 9 AS differing")
def _(spark, d):
    o = U.sort_apart([(float(i), 0.0) for i in range(9)], 9, 3)
    return one(spark, "n int, differing int", len(o), len(set(o)))


@q("ra12_chunked_run", f"WITH {CELLS} SELECT row, col, n AS v FROM cells")
def _(spark, d):
    p = kept(spark, d)
    parts = [p.where(F.col("row") < 10), p.where(F.col("row") >= 10)]
    return A.mosaic(parts[0].groupBy(*K).agg(F.count("*").alias("v")).withColumn("part", F.lit(0)).unionByName(parts[1].groupBy(*K).agg(F.count("*").alias("v")).withColumn("part", F.lit(1))))


@q("gr09_blocked_input", f"WITH {CELLS} SELECT count(*) AS n FROM cells")
def _(spark, d):
    return C.block(pts(spark, d), SPEC, "zc").agg(F.count("*").alias("n"))


@q("gr12_offset_grid", f"WITH {CELLS} SELECT row, col, s + 7 AS v FROM cells")
def _(spark, d):
    offs = SPEC.lattice(spark).withColumn("v", F.lit(7))
    return J.grid_difference(C.aggregate(pts(spark, d), SPEC, F.sum("zc").alias("v")), offs, 1)


@q("gr18_vertices", f"WITH {BOXES}, b AS (SELECT * FROM boxes WHERE xmin IS NOT NULL AND xmin <= xmax AND ymin <= ymax), v AS (SELECT file_id, xmin AS x, ymin AS y FROM b UNION ALL SELECT file_id, xmin, ymax FROM b UNION ALL SELECT file_id, xmax, ymax FROM b UNION ALL SELECT file_id, xmax, ymin FROM b UNION ALL SELECT file_id, xmin, ymin FROM b) SELECT file_id, x, y, 0.0E0 AS z FROM v")
def _(spark, d):
    v = ringed(spark, d).select("file_id", F.explode(geom.points_of(F.col("rings"))).alias("p"))
    return v.select("file_id", "p.x", "p.y", F.lit(0.0).alias("z"))


@q("ve04_emptiness", "SELECT true AS none, false AS some")
def _(spark, d):
    b = ringed(spark, d)
    return one(spark, "none boolean, some boolean", b.limit(0).isEmpty(), b.isEmpty())


@q("ve07_way_geometry", "SELECT o_orderkey AS way, 2 AS points FROM orders")
def _(spark, d):
    from sondegrid.sources.catalog import overpass

    k = F.col("o_orderkey").cast("string")
    js = F.concat(F.lit('{"elements":[{"type":"way","id":'), k, F.lit(',"nodes":[1,2]}]}'))
    ways, _n = overpass(table(spark, d, "orders").select(js.alias("json")))
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "id bigint, lon double, lat double")
    return J.ordered_lookup(ways, nodes).groupBy("way").agg(F.count("*").cast("int").alias("points"))


@q("ve08_tile_lists", f"WITH {KEPT} SELECT row // 10 AS trow, src, count(*) AS n FROM kept GROUP BY 1, 2")
def _(spark, d):
    return kept(spark, d).groupBy(F.floor(F.col("row") / 10).cast("int").alias("trow"), "src").agg(F.count("*").alias("n"))


@q("un01_prerequisites", f"WITH {CELLS}, {LATTICE} SELECT count(*) AS cells, CAST(sum(CASE WHEN c.n IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS masked FROM lattice l LEFT JOIN cells c ON l.row = c.row AND l.col = c.col")
def _(spark, d):
    m = C.mask(pts(spark, d), SPEC)
    near = N.proximity(m, SPEC)
    return near.agg(F.count("*").alias("cells"), F.sum((F.col("d2") == 0).cast("bigint")).alias("masked"))


@q("un10_convergence", f"WITH {PTS}, n AS (SELECT pid % 7 AS k, count(*) AS n FROM pts GROUP BY 1), c AS (SELECT k, sum(n) OVER (ORDER BY k) AS upto FROM n) SELECT CAST(min(k) + 1 AS INT) AS rounds FROM c WHERE upto >= 2000")
def _(spark, d):
    p = pts(spark, d).select("pid", F.col("w").cast("double").alias("distance"), F.pow("w", F.lit(0.5)).alias("error"))
    _, n = U.converge(lambda sim: p.where(F.col("pid") % 7 == sim), 7, tolerance=0.0, enough=2000)
    return one(spark, "rounds int", n)


@q("cn02_tile_urls", f"WITH {BOXES} SELECT 'http://h/' || name AS url, CASE WHEN name LIKE '%.las' THEN 'lidar' ELSE 'raster' END AS kind FROM boxes WHERE {_MEETS}")
def _(spark, d):
    from sondegrid.sources.connectors import connectors

    t = boxes(spark, d).withColumn("url", F.concat(F.lit("http://h/"), "name"))
    return connectors()["dc"].urls(t, _R).select("url", "kind")


@q("cn04_chart_soundings", f"WITH {PTS} SELECT count(*) AS n, CAST(sum(-zc) AS BIGINT) AS s FROM pts")
def _(spark, d):
    from sondegrid.sources.connectors import chart_points

    js = F.to_json(F.struct(F.struct(F.lit("MultiPoint").alias("type"), F.array(F.array("x", "y", F.col("zc").cast("double"))).alias("coordinates")).alias("geometry")))
    return chart_points(pts(spark, d).select(js.alias("json"))).agg(F.count("*").alias("n"), F.sum(F.col("z").cast("bigint")).alias("s"))


@q("cn05_catalog_documents", "SELECT 'b/' || CAST(o_orderkey AS VARCHAR) || '.nc' AS url FROM orders")
def _(spark, d):
    from sondegrid.sources.connectors import thredds

    xml = F.concat(F.lit('<catalog><dataset urlPath="'), F.col("o_orderkey").cast("string"), F.lit('.nc"/></catalog>'))
    return thredds(table(spark, d, "orders").select(xml.alias("xml")), base="b/").select("url")


@q("cn11_bounded_urls", f"WITH {BOXES} SELECT 'https://s/srtm_plus?west=' || xmin || '&east=' || xmax || '&south=' || ymin || '&north=' || ymax AS url FROM boxes")
def _(spark, d):
    from sondegrid.sources.connectors import connectors

    return connectors("https://s")["srtm_plus"].urls(boxes(spark, d)).select("url")


@q("cn12_coverage_urls", f"WITH {BOXES} SELECT name || '.tif' AS file_name, 'https://s/wcs?service=WCS&version=2.0.1&request=GetCoverage&coverageID=' || replace(url_encode(name), '%20', '+') || '&subset=Long(179.2,180.4)&subset=Lat(-40.0,20.0)' AS url FROM boxes WHERE {_MEETS}")
def _(spark, d):
    from sondegrid.sources.connectors import connectors

    return connectors("https://s")["emodnet"].urls(boxes(spark, d).withColumnRenamed("name", "id"), _R).select("file_name", "url")


@q("cn13_footprints", f"WITH {BOXES} SELECT name AS url FROM boxes WHERE {_MEETS}")
def _(spark, d):
    from sondegrid.sources.connectors import connectors

    return connectors()["hrdem"].urls(boxes(spark, d).withColumnRenamed("name", "url"), _R).select("url")


@q("cn20_fetch_job", "SELECT 'u' || CAST(o_orderkey AS VARCHAR) || '.xyz' AS url FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    from sondegrid.plans.modules import FetchJob

    url = F.concat(F.lit("u"), F.col("o_orderkey").cast("string"), F.lit(".xyz,n.txt"))
    c = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("ID"), url.alias("DataLink"), "o_orderstatus", F.lit("nos").alias("DataSource"), *[F.lit(v).alias(n) for n, v in zip(B4, (0.0, 1.0, 0.0, 1.0))])
    return FetchJob(Region(0.0, 1.0, 0.0, 1.0), ("o_orderstatus = 'F'",), {"nos": []}).urls(c).select("url")


@q("cn18_fetch_file", "SELECT true AS ok, 5 AS size")
def _(spark, d):
    from sondegrid.session import fresh_path
    from sondegrid.sources.catalog import fetch_all

    path = fresh_path(spark, "fetch")
    one(spark, "value string", "byte").coalesce(1).write.text(path)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.regexp_replace("path", "^file:/+", "file:///").alias("url"))
    return fetch_all(files).select("ok", F.length("content").alias("size"))


@q("ud01_module_registry", "SELECT * FROM (VALUES ('IDW'), ('average'), ('coastline'), ('composite'), ('invdst'), ('landmask'), ('linear'), ('mbgrid'), ('nearest'), ('num'), ('spat-meta'), ('surface'), ('triangulate'), ('uncertainty'), ('vdatum')) t(name)")
def _(spark, d):
    from sondegrid.plans.modules import MODULES

    return spark.createDataFrame([(n,) for n in MODULES], "name string")


@q("ud04_source_registry", "SELECT * FROM (VALUES ('charts'), ('chs'), ('dc'), ('emodnet'), ('gmrt'), ('hrdem'), ('mar_grav'), ('mb'), ('ncei_thredds'), ('ngs'), ('nos'), ('osm'), ('srtm_plus'), ('tnm'), ('usace')) t(name)")
def _(spark, d):
    from sondegrid.sources.connectors import connectors

    return spark.createDataFrame([(n,) for n in connectors()], "name string")


@q("ud06_letters", f"WITH {CELLS} SELECT k.x, k.y, k.zc - c.s AS d FROM kept k JOIN cells c ON k.row = c.row AND k.col = c.col")
def _(spark, d):
    p = kept(spark, d).drop(*K).withColumnRenamed("zc", "z")
    return J.query_grid(p, C.aggregate(p, SPEC, F.sum("z").alias("v")), SPEC, "xyd")


@q("vd01_datum_shift", f"WITH {CELLS} SELECT k.pid, k.zc + c.n AS z FROM kept k JOIN cells c ON k.row = c.row AND k.col = c.col")
def _(spark, d):
    p = kept(spark, d).drop(*K).withColumnRenamed("zc", "z")
    return J.query_grid(p, C.count(p, SPEC), SPEC).select("pid", F.col("m").alias("z"))


QUERIES, SQL = q.queries, q.sql
