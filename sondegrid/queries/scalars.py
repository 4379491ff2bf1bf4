"""Regions, entries, scalar functions and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondegrid import geom, region as R
from sondegrid.functions import scalars as S
from sondegrid.operators import filters as P, joins as J
from sondegrid.queries._base import BOXES, ENTRIES, PTS, Registry, boxes, entries, pts, table
from sondegrid.region import Region
from sondegrid.sources import datalist as D, xyz as X

q = Registry()
B4 = ["xmin", "xmax", "ymin", "ymax"]


# --- boxes -----------------------------------------------------------------------------------------------------------
@q("pr03_region_valid", f"WITH {BOXES} SELECT file_id, xmin <= xmax AND ymin <= ymax AS ok FROM boxes")
def _(spark, d):
    return boxes(spark, d).select("file_id", R.valid().alias("ok"))


@q("pr04_region_zeros", f"WITH {BOXES} SELECT file_id FROM boxes WHERE xmin = 0 AND xmax = 0 AND ymin = 0 AND ymax = 0")
def _(spark, d):
    return boxes(spark, d).where(R.zeros()).select("file_id")


@q("pr06_z_region", f"WITH {BOXES} SELECT file_id FROM boxes WHERE zmin < 0 AND zmax > -500")
def _(spark, d):
    return boxes(spark, d).where(P.z_region_pass(0.0, -500.0)).select("file_id")


@q("pr07_z_region_valid", "SELECT source_id, coalesce(lower_limit <= upper_limit, false) AS ok FROM xyz_sources")
def _(spark, d):
    return table(spark, d, "xyz_sources").select("source_id", F.coalesce(F.col("lower_limit") <= F.col("upper_limit"), F.lit(False)).alias("ok"))


@q("pr08_weight", f"WITH {ENTRIES} SELECT entry_id FROM entries WHERE weight IS NULL OR (weight > 0.5 AND weight < 2)")
def _(spark, d):
    return entries(spark, d).where(P.weight_pass("weight", 2.0, 0.5)).select("entry_id")


_R = Region(179.2, 180.4, -40.0, 20.0)
_MEETS = "xmin <= 180.4E0 AND xmax >= 179.2E0 AND ymin <= 20.0E0 AND ymax >= -40.0E0"


@q("pr09_intersect", f"WITH {BOXES} SELECT file_id FROM boxes WHERE {_MEETS}")
def _(spark, d):
    return boxes(spark, d).where(_R.intersects()).select("file_id")


@q("pr11_entry_intersects", f"WITH {BOXES}, {ENTRIES} SELECT DISTINCT e.entry_id FROM entries e JOIN boxes b ON e.path = b.name WHERE {_MEETS}")
def _(spark, d):
    keep = boxes(spark, d).where(_R.intersects()).select(F.col("name").alias("path"))
    return entries(spark, d).join(keep, "path", "left_semi").select("entry_id")


@q("pr13_hooks", f"WITH {BOXES}, {ENTRIES} SELECT DISTINCT e.entry_id FROM entries e JOIN boxes b ON e.path = b.name WHERE {_MEETS} AND zmin < 0 AND (weight IS NULL OR weight > 0.5)")
def _(spark, d):
    j = entries(spark, d).join(boxes(spark, d).withColumnRenamed("name", "path"), "path")
    return j.where(P.all_hooks(_R.intersects(), P.z_region_pass(0.0), P.weight_pass("weight", None, 0.5))).select("entry_id").distinct()


@q("pr18_attribute_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def _(spark, d):
    return P.attribute_filter(table(spark, d, "orders"), ["o_orderstatus = 'O'", "o_orderpriority = '1-URGENT'"]).select("o_orderkey")


@q("pr20_wkt", "SELECT DISTINCT file_id FROM inf_files WHERE wkt LIKE 'POLYGON%' OR wkt LIKE 'MULTIPOLYGON%'")
def _(spark, d):
    return table(spark, d, "inf_files").where(P.is_polygon_text("wkt")).select("file_id").distinct()


@q("fn08_region_center", f"WITH {BOXES} SELECT file_id, (xmin + xmax) / 2 AS xc, (ymin + ymax) / 2 AS yc FROM boxes")
def _(spark, d):
    return boxes(spark, d).select("file_id", *R.center())


@q("fn08_region_center_compat", f"WITH {BOXES} SELECT file_id, xmin + (xmax - xmin / 2) AS xc, ymin + (ymax - ymin / 2) AS yc FROM boxes")
def _(spark, d):
    return boxes(spark, d).select("file_id", *R.center(compat=True))


@q("fn09_region_pct", f"WITH {BOXES} SELECT file_id, ((xmax - xmin) * 0.05E0 + (ymax - ymin) * 0.05E0) / 2 AS v FROM boxes")
def _(spark, d):
    return boxes(spark, d).select("file_id", R.percent(5).alias("v"))


@q("fn10_region_buffer", f"WITH {BOXES} SELECT file_id, xmin - 0.25E0 AS xmin, xmax + 0.25E0 AS xmax, ymin - 0.25E0 AS ymin, ymax + 0.25E0 AS ymax FROM boxes")
def _(spark, d):
    return boxes(spark, d).select("file_id", *R.buffered(0.25))


@q("fn11_region_format", f"WITH {BOXES} SELECT file_id, concat_ws('/', xmin, xmax, ymin, ymax) AS str, '-R' || concat_ws('/', xmin, xmax, ymin, ymax) AS gmt, concat_ws(',', xmin, ymin, xmax, ymax) AS bbox, concat_ws(',', ymin, xmin, ymax, xmax) AS osm, concat_ws(' ', xmin, ymin, xmax, ymax) AS te, concat_ws(' ', xmin, ymax, xmax, ymin) AS ul_lr FROM boxes")
def _(spark, d):
    b = boxes(spark, d)
    return b.select("file_id", *[R.formatted(s).alias(n) for s, n in (("str", "str"), ("gmt", "gmt"), ("bbox", "bbox"), ("osm_bbox", "osm"), ("te", "te"), ("ul_lr", "ul_lr"))])


@q("fn11_region_name", f"WITH {BOXES} SELECT file_id, CASE WHEN ymax < 0 THEN 's' ELSE 'n' END || printf('%02d', abs(CAST(trunc(ymax) AS INT))) || 'x' || printf('%02d', abs(CAST(trunc(ymax * 100) AS INT)) % 100) || '_' || CASE WHEN xmin > 0 THEN 'e' ELSE 'w' END || printf('%03d', abs(CAST(trunc(xmin) AS INT))) || 'x' || printf('%02d', abs(CAST(trunc(xmin * 100) AS INT)) % 100) AS name FROM boxes")
def _(spark, d):
    return boxes(spark, d).select("file_id", R.formatted("fn").alias("name"))


@q("fn12_parse_region", f"WITH {BOXES} SELECT file_id, xmin, xmax, ymin, ymax FROM boxes")
def _(spark, d):
    v = F.transform(F.split(F.regexp_replace(R.formatted("gmt"), "^-R", ""), "/"), lambda x: x.cast("double"))
    return boxes(spark, d).withColumn("v", v).select("file_id", *[F.element_at("v", i + 1).alias(n) for i, n in enumerate(B4)])


@q("fn13_region_of_wkt", "SELECT file_id, count(*) AS points FROM (SELECT DISTINCT file_id, unnest(regexp_extract_all(wkt, '[(,] ?(-?[0-9.]+ -?[0-9.]+)', 1)) AS p, generate_subscripts(regexp_extract_all(wkt, '[(,] ?(-?[0-9.]+ -?[0-9.]+)', 1), 1) AS i FROM inf_files WHERE wkt LIKE 'POLYGON ((%))') GROUP BY file_id")
def _(spark, d):
    w = table(spark, d, "inf_files").where("wkt like 'POLYGON ((%))'").select("file_id", "wkt").distinct()
    return w.select("file_id", F.size(geom.points_of(geom.wkt_rings(F.col("wkt")))).cast("bigint").alias("points"))


@q("fn14_region2wkt", f"WITH {BOXES} SELECT file_id, 'POLYGON ((' || xmin || ' ' || ymin || ',' || xmin || ' ' || ymax || ',' || xmax || ' ' || ymax || ',' || xmax || ' ' || ymin || ',' || xmin || ' ' || ymin || '))' AS wkt FROM boxes")
def _(spark, d):
    b = boxes(spark, d)
    return b.select("file_id", geom.polygon_wkt(F.array(geom.box_ring(*[F.col(c) for c in B4]))).alias("wkt"))


@q("fn14_wkt2region", f"WITH {BOXES} SELECT file_id, xmin, xmax, ymin, ymax FROM boxes ")
def _(spark, d):
    b = boxes(spark, d)
    rings = geom.wkt_rings(geom.polygon_wkt(F.array(geom.box_ring(*[F.col(c) for c in B4]))))
    return b.select("file_id", *[v.alias(k) for k, v in geom.envelope(rings).items()])


@q("ag14_list_rollup", f"WITH {BOXES}, {ENTRIES} SELECT parent, min(xmin) AS xmin, min(ymin) AS ymin, min(zmin) AS zmin, max(xmax) AS xmax, max(ymax) AS ymax, max(zmax) AS zmax, CAST(sum(numpts) AS BIGINT) AS numpts FROM entries e JOIN boxes b ON e.path = b.name GROUP BY parent")
def _(spark, d):
    j = entries(spark, d).join(boxes(spark, d).withColumnRenamed("name", "path"), "path")
    return D.roll_up(j)


@q("ag15_regions_merge", f"WITH {BOXES} SELECT source_id, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax FROM boxes GROUP BY source_id")
def _(spark, d):
    return boxes(spark, d).groupBy("source_id").agg(*R.merged())


@q("ag16_regions_reduce", f"WITH {BOXES} SELECT source_id, max(xmin) AS xmin, min(xmax) AS xmax, max(ymin) AS ymin, min(ymax) AS ymax FROM boxes GROUP BY source_id")
def _(spark, d):
    return boxes(spark, d).groupBy("source_id").agg(*R.reduced())


@q("ag17_catalog_region", f"WITH {BOXES}, {ENTRIES} SELECT CAST(fmt AS INT) AS fmt, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax FROM entries e JOIN boxes b ON e.path = b.name GROUP BY fmt")
def _(spark, d):
    return entries(spark, d).join(boxes(spark, d).withColumnRenamed("name", "path"), "path").groupBy("fmt").agg(*R.merged())


@q("jn06_entry_region", f"WITH {BOXES}, regs(rid, xmin, xmax, ymin, ymax) AS (VALUES (1, 179.0E0, 179.5E0, -60.0E0, 60.0E0), (2, 179.4E0, 181.0E0, 0.0E0, 10.0E0), (3, -180.0E0, -179.2E0, -20.0E0, 70.0E0)) SELECT file_id, rid FROM boxes b, regs r WHERE b.xmin <= r.xmax AND b.xmax >= r.xmin AND b.ymin <= r.ymax AND b.ymax >= r.ymin AND b.xmin <= b.xmax AND b.ymin <= b.ymax")
def _(spark, d):
    regs = spark.createDataFrame([(1, 179.0, 179.5, -60.0, 60.0), (2, 179.4, 181.0, 0.0, 10.0), (3, -180.0, -179.2, -20.0, 70.0)], "rid int, xmin double, xmax double, ymin double, ymax double")
    return J.overlap_join(boxes(spark, d), regs, 2.0, "file_id", "rid")


@q("jn07_catalog_filter", f"WITH {BOXES}, {ENTRIES} SELECT e.entry_id, b.file_id FROM entries e JOIN boxes b ON e.path = b.name WHERE e.fmt = 168 AND {_MEETS}")
def _(spark, d):
    cat = entries(spark, d).join(boxes(spark, d).withColumnRenamed("name", "path"), "path")
    return P.attribute_filter(cat, ["fmt = 168"]).where(_R.intersects()).select("entry_id", "file_id")


@q("jn13_zone_lookup", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '26929' WHEN 1 THEN '2205' WHEN 2 THEN '32161' END AS epsg FROM orders")
def _(spark, d):
    zone = F.element_at(F.array(*map(F.lit, ("0101", "1601", "5200", "9999"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    zones = spark.createDataFrame(list(S.FIPS_TO_EPSG.items()), "zone string, epsg string")
    return J.zone_lookup(table(spark, d, "orders").select("o_orderkey", zone.alias("z")), zones, "z").select("o_orderkey", "epsg")


@q("jn14_tile_footprints", f"WITH {BOXES} SELECT a.file_id, b.file_id AS other FROM boxes a, boxes b WHERE a.file_id < b.file_id AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin AND a.xmin <= a.xmax AND a.ymin <= a.ymax AND b.xmin <= b.xmax AND b.ymin <= b.ymax")
def _(spark, d):
    b = boxes(spark, d)
    return J.overlap_join(b, b.withColumnRenamed("file_id", "other"), 0.5, "file_id", "other").where("file_id < other")


@q("jn15_way_nodes", "WITH ways AS (SELECT o_orderkey AS way, list(l_partkey ORDER BY l_linenumber, l_partkey) AS nodes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey), e AS (SELECT way, unnest(nodes) AS id, generate_subscripts(nodes, 1) - 1 AS pos FROM ways) SELECT way, CAST(pos AS INT) AS pos, id, p_size FROM e JOIN part ON id = p_partkey")
def _(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ways = li.groupBy(F.col("o_orderkey").alias("way")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("nodes"))
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return J.ordered_lookup(ways, nodes).select("way", "pos", "id", "p_size")


@q("jn16_attribute_merge", f"WITH {ENTRIES} SELECT e.entry_id, s.source_id, s.name FROM entries e LEFT JOIN (SELECT DISTINCT name AS path, source_id FROM inf_files) f ON e.path = f.path LEFT JOIN xyz_sources s ON f.source_id = s.source_id")
def _(spark, d):
    f = table(spark, d, "inf_files").select(F.col("name").alias("path"), "source_id").distinct()
    s = table(spark, d, "xyz_sources").select("source_id", "name")
    return entries(spark, d).select("entry_id", "path").join(f, "path", "left").join(s, "source_id", "left").select("entry_id", "source_id", "name")


# --- scalars ---------------------------------------------------------------------------------------------------------
@q("fn01_geo2pixel", f"WITH {PTS} SELECT pid, CAST(floor((x + 90.0E0)/0.05E0 + 0.5E0) AS INT) AS col, CAST(floor((y - 30.0E0)/-0.05E0 + 0.5E0) AS INT) AS row FROM pts")
def _(spark, d):
    from sondegrid.queries._base import SPEC

    return pts(spark, d).select("pid", SPEC.col().alias("col"), SPEC.row().alias("row"))


@q("fn02_pixel2geo", "SELECT l_orderkey, l_linenumber, -90.0E0 + (l_partkey % 20) * 0.05E0 AS x, 30.0E0 + (l_suppkey % 20) * -0.05E0 AS y FROM lineitem")
def _(spark, d):
    from sondegrid.queries._base import SPEC

    li = table(spark, d, "lineitem").withColumn("col", F.col("l_partkey") % 20).withColumn("row", F.col("l_suppkey") % 20)
    return li.select("l_orderkey", "l_linenumber", SPEC.x().alias("x"), SPEC.y().alias("y"))


@q("fn04_pixel_floor", f"WITH {PTS} SELECT pid, CAST(floor((x + 90.0E0)/0.05E0) AS INT) AS col, CAST(floor((y - 30.0E0)/-0.05E0) AS INT) AS row FROM pts")
def _(spark, d):
    from dataclasses import replace

    from sondegrid.queries._base import SPEC

    s = replace(SPEC, registration="pixel")
    return pts(spark, d).select("pid", s.col().alias("col"), s.row().alias("row"))


@q("fn07_srcwin", f"WITH {BOXES}, e AS (SELECT file_id, floor((xmin - 179.0E0) / 0.05E0 + 0.5E0) AS c0, floor((xmax - 179.0E0) / 0.05E0 + 0.5E0) AS c1, floor((ymax - 60.0E0) / -0.05E0 + 0.5E0) AS r0, floor((ymin - 60.0E0) / -0.05E0 + 0.5E0) AS r1 FROM boxes WHERE xmin IS NOT NULL) SELECT file_id, CAST(greatest(c0, 0) AS INT) AS xoff, CAST(greatest(r0, 0) AS INT) AS yoff, CAST(greatest(least(c1, 40) - greatest(c0, 0), 0) AS INT) AS xsize, CAST(greatest(least(r1, 2400) - greatest(r0, 0), 0) AS INT) AS ysize FROM e")
def _(spark, d):
    at = lambda c, o, s: F.floor((F.col(c) - F.lit(o)) / F.lit(s) + F.lit(0.5))
    c0, c1, r0, r1 = at("xmin", 179.0, 0.05), at("xmax", 179.0, 0.05), at("ymax", 60.0, -0.05), at("ymin", 60.0, -0.05)
    zero = F.lit(0).cast("bigint")
    x, y = F.greatest(c0, zero), F.greatest(r0, zero)
    w = lambda e, n, s: F.greatest(F.least(e, F.lit(n).cast("bigint")) - s, zero)
    return boxes(spark, d).where("xmin is not null").select("file_id", x.cast("int").alias("xoff"), y.cast("int").alias("yoff"), w(c1, 40, x).cast("int").alias("xsize"), w(r1, 2400, y).cast("int").alias("ysize"))


_INCS = "(VALUES ('1s'), ('0.5c'), ('3m'), ('.25'), ('abc'), ('10'))"


@q("fn17_increment", f"SELECT s, CASE WHEN right(s, 1) IN ('s', 'c') THEN TRY_CAST(left(s, length(s) - 1) AS DOUBLE) / 3600 WHEN right(s, 1) = 'm' THEN TRY_CAST(left(s, length(s) - 1) AS DOUBLE) / 60 ELSE TRY_CAST(s AS DOUBLE) END AS inc, CASE WHEN right(s, 1) = 'm' THEN TRY_CAST(left(s, length(s) - 1) AS DOUBLE) / 360 END AS compat FROM {_INCS} t(s)")
def _(spark, d):
    t = spark.createDataFrame([(v,) for v in ("1s", "0.5c", "3m", ".25", "abc", "10")], "s string")
    return t.select("s", S.increment(F.col("s")).alias("inc"), F.when(F.right("s", F.lit(1)) == "m", S.increment(F.col("s"), compat=True)).alias("compat"))


@q("fn20_euclid", f"WITH {PTS} SELECT pid, sqrt(pow(x + 89.5E0, 2) + pow(y - 29.5E0, 2)) * 637100.0E0 AS v FROM pts")
def _(spark, d):
    return pts(spark, d).select("pid", S.euclid(F.lit(-89.5), F.lit(29.5), F.col("x"), F.col("y"), S.EARTH_COMPAT).alias("v"))


@q("fn21_haversine", f"WITH {PTS}, a AS (SELECT pid, pow(sin(radians(y - 29.5E0) / 2), 2) + cos(radians(29.5E0)) * cos(radians(y)) * pow(sin(radians(x + 89.5E0) / 2), 2) AS a FROM pts) SELECT pid, round(2 * 6371000.0E0 * atan2(sqrt(a), sqrt(1 - a)), 3) AS v FROM a")
def _(spark, d):
    return pts(spark, d).select("pid", F.round(S.haversine(F.lit(29.5), F.lit(-89.5), F.col("y"), F.col("x")), 3).alias("v"))


@q("fn22_degree_length", f"WITH {PTS} SELECT pid, round(cos(radians(y)) * 111321.543E0, 6) AS v FROM pts")
def _(spark, d):
    return pts(spark, d).select("pid", F.round(S.degree_length(F.col("y")), 6).alias("v"))


@q("fn23_turn360", f"WITH {PTS} SELECT pid, x - 360.0E0 AS west, x + 360.0E0 AS east FROM pts")
def _(spark, d):
    return pts(spark, d).select("pid", S.turn360(F.col("x")).alias("west"), S.turn360(F.col("x"), "east").alias("east"))


@q("fn24_scale_shift", f"WITH {PTS} SELECT pid, x - 360.0E0 AS x, zc * -1 AS z FROM pts")
def _(spark, d):
    return pts(spark, d).select("pid", S.turn360(F.col("x")).alias("x"), (F.col("zc") * -1).alias("z"))


@q("fn25_relief_band", "WITH t(i, v) AS (VALUES (1, -11000.0E0), (2, -5000.0E0), (3, 0.0E0), (4, 500.0E0), (5, 8000.0E0)) SELECT i, CASE WHEN v > 0 THEN 120.0E0 * v / 8000 WHEN v < 0 THEN -80.0E0 * v / -11000 ELSE 0 END AS elev, lead(CASE WHEN v > 0 THEN 120.0E0 * v / 8000 WHEN v < 0 THEN -80.0E0 * v / -11000 ELSE 0 END) OVER (ORDER BY i) AS nxt FROM t")
def _(spark, d):
    from pyspark.sql import Window

    t = spark.createDataFrame([(1, -11000.0), (2, -5000.0), (3, 0.0), (4, 500.0), (5, 8000.0)], "i int, v double")
    e = t.select("i", S.relief_elevation(F.col("v"), F.col("v"), -80.0, 120.0).alias("elev"))
    return e.withColumn("nxt", F.lead("elev").over(Window.orderBy("i")))


@q("fn26_fixed_text", f"WITH {PTS} SELECT pid, printf('%.4f', x) AS x, printf('%.2f', CAST(zc AS DOUBLE) / 100) AS z FROM pts")
def _(spark, d):
    return pts(spark, d).select("pid", S.fixed_text(F.col("x"), 4).alias("x"), S.fixed_text(F.col("zc") / F.lit(100.0), 2).alias("z"))


@q("fn27_options", "WITH t(s) AS (VALUES ('a=1:b=two'), ('c=x')), p AS (SELECT s, unnest(string_split(s, ':')) AS kv FROM t) SELECT s, split_part(kv, '=', 1) AS k, split_part(kv, '=', 2) AS v FROM p")
def _(spark, d):
    t = spark.createDataFrame([("a=1:b=two",), ("c=x",)], "s string")
    return t.select("s", F.explode(S.options_map(F.col("s"))).alias("k", "v"))


@q("fn28_int_float_or", f"WITH {ENTRIES}, t AS (SELECT entry_id, trim(split_part(metadata, ';', 3), ' ') AS t FROM entries WHERE metadata IS NOT NULL) SELECT entry_id, CASE WHEN regexp_full_match(t, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(t AS DOUBLE) ELSE -1 END AS f FROM t")
def _(spark, d):
    third = F.trim(F.split_part(F.col("metadata"), F.lit(";"), F.lit(3)))
    return entries(spark, d).where("metadata is not null").select("entry_id", S.float_or(third, -1.0).alias("f"))


@q("fn29_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp, strftime(o_orderdate, '%Y') AS year FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("stamp"), F.date_format("o_orderdate", "yyyy").alias("year"))


@q("fn30_suffix", "SELECT raw_id, regexp_replace(file_name, '[.]xyz$', '') AS base FROM raw_files")
def _(spark, d):
    return table(spark, d, "raw_files").select("raw_id", S.without_suffix(F.col("file_name"), ".xyz").alias("base"))


@q("fn31_xml_nodes", "SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS texts, o_orderstatus AS status FROM orders")
def _(spark, d):
    doc = F.concat(F.lit("<order><s>"), "o_orderstatus", F.lit("</s><s>"), "o_orderpriority", F.lit("</s></order>"))
    o = table(spark, d, "orders").select("o_orderkey", doc.alias("x"))
    return o.select("o_orderkey", F.array_join(F.xpath("x", F.lit("order/s/text()")), "|").alias("texts"), F.xpath_string("x", F.lit("order/s[1]")).alias("status"))


@q("fn33_links", "SELECT o_orderkey, 2 AS n, CAST(o_custkey AS VARCHAR) || '.xml' AS first FROM orders")
def _(spark, d):
    page = F.concat(F.lit('<a href="'), F.col("o_custkey").cast("string"), F.lit('.xml">x</a><a class="y" href="b.html">'))
    o = table(spark, d, "orders").select("o_orderkey", S.links(page).alias("l"))
    return o.select("o_orderkey", F.size("l").alias("n"), F.element_at("l", 1).alias("first"))


@q("fn35_survey_kind", "SELECT raw_id, CASE WHEN regexp_extract(file_name, '[^/]*$') LIKE '%.%.%' THEN CASE split_part(regexp_extract(file_name, '[^/]*$'), '.', -2) WHEN 'bag' THEN 'grid_bag' WHEN 'xyz' THEN 'geodas_xyz' END WHEN regexp_extract(file_name, '[^/]*$') LIKE '%.%' THEN CASE split_part(regexp_extract(file_name, '[^/]*$'), '.', -1) WHEN 'bag' THEN 'grid_bag' WHEN 'xyz' THEN 'geodas_xyz' END END AS kind FROM raw_files")
def _(spark, d):
    return table(spark, d, "raw_files").select("raw_id", S.survey_kind(F.col("file_name")).alias("kind"))


@q("fn36_query_string", f"WITH {BOXES} SELECT file_id, 'west=' || xmin || '&east=' || xmax || '&format=geotiff' AS url FROM boxes ")
def _(spark, d):
    return boxes(spark, d).select("file_id", S.query_string({"west": F.col("xmin"), "east": F.col("xmax"), "format": F.lit("geotiff")}).alias("url"))


_LISTING = "listing AS (SELECT o_orderkey, 'a/b/c/d/e/f/s' || CAST(o_custkey AS VARCHAR) || '/m/n/version' || CAST(o_orderkey % 3 + 1 AS VARCHAR) || '/file' AS url FROM orders)"


def _listing(spark, d):
    url = F.concat(F.lit("a/b/c/d/e/f/s"), F.col("o_custkey").cast("string"), F.lit("/m/n/version"), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit("/file"))
    return table(spark, d, "orders").select("o_orderkey", url.alias("url"))


@q("fn37_survey_keys", f"WITH {_LISTING} SELECT o_orderkey, split_part(url, '/', 7) AS survey, right(split_part(url, '/', 10), 1) AS version FROM listing")
def _(spark, d):
    return _listing(spark, d).select("o_orderkey", S.survey_of(F.col("url")).alias("survey"), S.version_of(F.col("url")).alias("version"))


@q("ag33_version_choice", f"WITH {_LISTING}, k AS (SELECT url, o_orderkey, split_part(url, '/', 7) AS survey, right(split_part(url, '/', 10), 1) AS version FROM listing), b AS (SELECT survey, max(version) AS best FROM k WHERE version IN ('1', '2') GROUP BY survey) SELECT k.o_orderkey, k.survey, k.version FROM k JOIN b ON k.survey = b.survey AND k.version = b.best")
def _(spark, d):
    from sondegrid.sources.catalog import best_version

    k = _listing(spark, d).select("o_orderkey", S.survey_of(F.col("url")).alias("survey"), S.version_of(F.col("url")).alias("version"))
    return best_version(k)


@q("fn34_zone_epsg", "SELECT z, e FROM (VALUES ('0101', '26929'), ('3701', '32128'), ('x', NULL)) t(z, e)")
def _(spark, d):
    t = spark.createDataFrame([("0101",), ("3701",), ("x",)], "z string")
    return t.select("z", S.zone_epsg(F.col("z")).alias("e"))


@q("fn39_grid_infos", f"WITH {PTS} SELECT 20 AS nx, 20 AS ny, count(*) AS n, min(zc) AS zmin, max(zc) AS zmax FROM pts")
def _(spark, d):
    from sondegrid.queries._base import SPEC

    return pts(spark, d).agg(F.lit(SPEC.nx).alias("nx"), F.lit(SPEC.ny).alias("ny"), F.count("*").alias("n"), F.min("zc").alias("zmin"), F.max("zc").alias("zmax"))


@q("fn16_warp_mercator", f"WITH {PTS} SELECT pid, round(6378137.0E0 * radians(x), 3) AS mx, round(6378137.0E0 * ln(tan(radians(y) / 2 + 0.7853981633974483E0)), 3) AS my FROM pts")
def _(spark, d):
    mx, my = S.mercator(F.col("x"), F.col("y"))
    return pts(spark, d).select("pid", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"))


# --- scans -----------------------------------------------------------------------------------------------------------
@q("sc01_format_registry", "SELECT * FROM (VALUES (-1, 2), (-2, 2), (-4, 13), (168, 4), (200, 6), (300, 2)) t(fmt, exts)")
def _(spark, d):
    return D.format_table(spark).groupBy("fmt").agg(F.count("*").cast("int").alias("exts"))


_LIST = "raw AS (SELECT l.raw_id, l.line_no, trim(l.line) AS line FROM raw_lines l JOIN raw_files f ON l.raw_id = f.raw_id WHERE f.fmt = -1)"


@q("sc02_entry_parse", f"WITH {_LIST}, w AS (SELECT raw_id, line_no, string_split_regex(line, '\\s+') AS w FROM raw WHERE line <> '' AND line NOT LIKE '#%'), e AS (SELECT raw_id, line_no, w[1] AS path, CASE WHEN len(w) < 2 THEN CASE WHEN w[1] LIKE '%.xyz' THEN 168 END ELSE CASE WHEN regexp_matches(w[2], '^[+-]?[0-9]+$') THEN CAST(w[2] AS INT) END END AS fmt, CASE WHEN len(w) < 3 THEN 1.0E0 WHEN regexp_matches(w[3], '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(w[3] AS DOUBLE) END AS weight FROM w) SELECT * FROM e WHERE fmt IS NOT NULL AND weight IS NOT NULL")
def _(spark, d):
    files = table(spark, d, "raw_files").where("fmt = -1").select("raw_id")
    lines = table(spark, d, "raw_lines").join(files, "raw_id").withColumn("line", F.trim("line"))
    e = D.parse_entries(lines).drop("meta")
    # forms that only a cast takes (a suffix of type, nan, infinity) are no weights here
    return e.where("not isnan(weight) and abs(weight) < double('infinity')")


@q("sc03_list_lines", f"WITH {_LIST} SELECT raw_id, line_no, 'dir/' || split_part(line, ' ', 1) AS path FROM raw WHERE line <> '' AND line NOT LIKE '#%'")
def _(spark, d):
    files = table(spark, d, "raw_files").where("fmt = -1").select("raw_id")
    lines = table(spark, d, "raw_lines").join(files, "raw_id").withColumn("line", F.trim("line")).where("line <> '' and line not like '#%'")
    return lines.select("raw_id", "line_no", F.concat(F.lit("dir/"), F.split_part("line", F.lit(" "), F.lit(1))).alias("path"))


@q("sc04_list_walk", "WITH RECURSIVE e AS (SELECT 'root' AS parent, 'r' || r_regionkey AS path, -1 AS fmt, 0.5E0 AS weight FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, -1, 2.0E0 FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 168, (s_suppkey % 5) * 0.25E0 FROM supplier), w AS (SELECT parent, path, fmt, weight, 1 AS depth FROM e WHERE parent = 'root' UNION ALL SELECT e.parent, e.path, e.fmt, w.weight * e.weight, w.depth + 1 FROM w JOIN e ON w.path = e.parent AND w.fmt = -1) SELECT parent, path, fmt, weight, depth FROM w WHERE fmt <> -1")
def _(spark, d):
    s = F.lit
    text = lambda p, c: F.concat(s(p), F.col(c).cast("string"))
    e = table(spark, d, "region").select(s("root").alias("parent"), text("r", "r_regionkey").alias("path"), s(-1).alias("fmt"), s(0.5).alias("weight"))
    e = e.unionByName(table(spark, d, "nation").select(text("r", "n_regionkey").alias("parent"), text("n", "n_nationkey").alias("path"), s(-1).alias("fmt"), s(2.0).alias("weight")))
    e = e.unionByName(table(spark, d, "supplier").select(text("n", "s_nationkey").alias("parent"), text("s", "s_suppkey").alias("path"), s(168).alias("fmt"), ((F.col("s_suppkey") % 5) * s(0.25)).alias("weight")))
    return D.walk(e, "root")


@q("sc05_major", "SELECT path, CAST(fmt AS INT) AS fmt FROM datalist_entries WHERE fmt = 168 UNION ALL SELECT path, CAST(fmt AS INT) FROM datalist_entries WHERE fmt <> 168")
def _(spark, d):
    e = table(spark, d, "datalist_entries").select("path", "fmt")
    return D.major([e.where("fmt = 168"), e.where("fmt <> 168")])


@q("sc06_dispatch", f"WITH {ENTRIES} SELECT entry_id, CASE fmt WHEN -2 THEN 'archive' WHEN -4 THEN 'remote' WHEN 168 THEN 'xyz' WHEN 200 THEN 'gdal' WHEN 300 THEN 'lasf' END AS reader FROM entries WHERE fmt <> -1")
def _(spark, d):
    names = D.format_table(spark).select("fmt", F.col("name").alias("reader")).distinct()
    return entries(spark, d).where("fmt <> -1").join(names, "fmt", "left").select("entry_id", "reader")


@q("sc10_line_delim", "SELECT raw_id, line_no, CASE WHEN line LIKE '%,%' THEN ',' WHEN line LIKE '%/%' THEN '/' WHEN line LIKE '%:%' THEN ':' END AS delim FROM raw_lines")
def _(spark, d):
    return table(spark, d, "raw_lines").select("raw_id", "line_no", X.line_delim(F.col("line")).alias("delim"))


_NUM = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


@q("sc11_parse_line", f"WITH l AS (SELECT l.raw_id, l.line_no, string_split(l.line, ',') AS f FROM raw_lines l JOIN raw_files r ON l.raw_id = r.raw_id WHERE r.cols = 'x,y,z' AND r.delim = ','), t AS (SELECT raw_id, line_no, trim(f[1]) AS a, trim(f[2]) AS b, trim(f[3]) AS c FROM l) SELECT raw_id, line_no, CAST(a AS DOUBLE) - 360 AS x, CAST(b AS DOUBLE) AS y, CAST(c AS DOUBLE) * -1 AS z FROM t WHERE regexp_matches(a, {_NUM}) AND regexp_matches(b, {_NUM}) AND regexp_matches(c, {_NUM})")
def _(spark, d):
    f = table(spark, d, "raw_files").where("cols = 'x,y,z' and delim = ','").select("raw_id")
    p = X.parse_xyz(table(spark, d, "raw_lines").join(f, "raw_id"), X.XyzConfig(delim=",", x_off=-360.0, z_scale=-1.0))
    finite = " and ".join(f"not isnan({c}) and abs({c}) < double('infinity')" for c in "xyz")
    return p.where(finite)


@q("sc12_parse_limits", f"WITH l AS (SELECT l.raw_id, l.line_no, string_split(l.line, ',') AS f FROM raw_lines l JOIN raw_files r ON l.raw_id = r.raw_id WHERE r.cols = 'x,y,z' AND r.delim = ',' AND l.line_no > 1), t AS (SELECT raw_id, line_no, trim(f[1]) AS a, trim(f[2]) AS b, trim(f[3]) AS c FROM l), v AS (SELECT raw_id, line_no, CAST(a AS DOUBLE) AS x, CAST(b AS DOUBLE) AS y, CAST(c AS DOUBLE) AS z FROM t WHERE regexp_matches(a, {_NUM}) AND regexp_matches(b, {_NUM}) AND regexp_matches(c, {_NUM})) SELECT * FROM v WHERE x BETWEEN 178 AND 181 AND y BETWEEN -60 AND 60 AND z > -2000 AND z < 0")
def _(spark, d):
    f = table(spark, d, "raw_files").where("cols = 'x,y,z' and delim = ','").select("raw_id")
    lines = X.skip_lines(table(spark, d, "raw_lines").join(f, "raw_id"), 1, "raw_id", "line_no")
    return X.parse_xyz(lines, X.XyzConfig(delim=",", upper_limit=0.0, lower_limit=-2000.0), region=Region(178.0, 181.0, -60.0, 60.0))


@q("sc13_entry_weight", f"WITH {BOXES}, {ENTRIES} SELECT e.entry_id, b.file_id, coalesce(e.weight, 1.0E0) AS w FROM entries e JOIN boxes b ON e.path = b.name")
def _(spark, d):
    j = entries(spark, d).join(boxes(spark, d).withColumnRenamed("name", "path"), "path")
    return j.select("entry_id", "file_id", F.coalesce("weight", F.lit(1.0)).alias("w"))


@q("sc17_las_magic", "SELECT raw_id, left(file_name, 4) = 'LASF' AS las FROM raw_files")
def _(spark, d):
    from sondegrid.sources.las import is_las

    return table(spark, d, "raw_files").select("raw_id", is_las(F.encode("file_name", "UTF-8")).alias("las"))


@q("sc21_class_subset", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (2, 29)")
def _(spark, d):
    return P.keep_classes(table(spark, d, "lineitem"), column="l_linenumber").select("l_orderkey", "l_linenumber")


@q("sc26_world_inf", "SELECT -180.0E0 AS xmin, 180.0E0 AS xmax, -90.0E0 AS ymin, 90.0E0 AS ymax, CAST(NULL AS BIGINT) AS numpts")
def _(spark, d):
    from sondegrid.sources.catalog import world_inf

    return world_inf(spark).select("xmin", "xmax", "ymin", "ymax", "numpts")


@q("sc27_feature_envelopes", f"WITH {BOXES} SELECT file_id, xmin, xmax, ymin, ymax FROM boxes")
def _(spark, d):
    b = boxes(spark, d)
    return b.select("file_id", *[v.alias(k) for k, v in geom.envelope(F.array(geom.box_ring(*[F.col(c) for c in B4]))).items()])


@q("sc29_multi_polygon", f"WITH {BOXES} SELECT source_id, count(*) AS polygons FROM boxes GROUP BY source_id")
def _(spark, d):
    from sondegrid.operators.vector import collect_polygons

    b = boxes(spark, d).withColumn("rings", F.array(geom.box_ring(*[F.col(c) for c in B4])))
    return collect_polygons(b, ["source_id"]).select("source_id", F.size(F.split("wkt", r"\)\),\(\(")).cast("bigint").alias("polygons"))


@q("sc31_typed_rows", "SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS q, l_returnflag FROM lineitem")
def _(spark, d):
    line = F.concat_ws(",", "l_orderkey", "l_quantity", "l_returnflag")
    t = table(spark, d, "lineitem").select(F.from_csv(line, "l_orderkey bigint, q double, l_returnflag string").alias("r"))
    return t.select("r.*")


@q("sc36_glob", "SELECT raw_id, CASE WHEN regexp_matches(file_name, '[.](xyz|csv|dat|ascii)$') THEN 168 WHEN file_name LIKE '%.datalist' THEN -1 WHEN file_name LIKE '%.gz' OR file_name LIKE '%.zip' THEN -2 END AS fmt FROM raw_files WHERE file_name IS NOT NULL")
def _(spark, d):
    return table(spark, d, "raw_files").where("file_name is not null").select("raw_id", D.format_of(F.col("file_name")).alias("fmt"))


@q("sc37_entry_exists", f"WITH {ENTRIES} SELECT entry_id FROM entries e WHERE EXISTS (SELECT 1 FROM inf_files f WHERE f.name = e.path AND f.numpts > 0) OR path LIKE 'http%'")
def _(spark, d):
    e, f = entries(spark, d), table(spark, d, "inf_files").where("numpts > 0").select(F.col("name").alias("path"))
    there = e.join(f, "path", "left_semi").select("entry_id")
    return there.union(e.where("path like 'http%'").select("entry_id")).distinct()


@q("sk15_region_feature", f"""WITH {BOXES} SELECT file_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || xmin || ',' || ymin || '],[' || xmin || ',' || ymax || '],[' || xmax || ',' || ymax || '],[' || xmax || ',' || ymin || '],[' || xmin || ',' || ymin || ']]]}}}}' AS feature FROM boxes""")
def _(spark, d):
    from sondegrid.sinks import region_feature

    return boxes(spark, d).select("file_id", region_feature().alias("feature"))


@q("sk18_inf_rows", f"WITH {BOXES} SELECT name, numpts, zmin FROM boxes")
def _(spark, d):
    from sondegrid.sinks import inf_json

    j = boxes(spark, d).withColumn("wkt", F.lit("")).select(F.from_json(inf_json(), "name string, numpts bigint, minmax array<double>, wkt string").alias("i"))
    return j.select("i.name", "i.numpts", F.element_at("i.minmax", 5).alias("zmin"))


@q("st05_distinct_links", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS links FROM orders GROUP BY o_custkey")
def _(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("l"))
    return o.select("o_custkey", F.array_join(F.array_sort(F.array_distinct("l")), ",").alias("links"))


@q("st07_upsert_absent", "SELECT o_custkey AS id, 'old' AS src FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    from sondegrid.sources.catalog import add_absent

    old = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct().withColumn("src", F.lit("old"))
    return add_absent(old, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("new").alias("src")), "id")


@q("so05_paging", "SELECT o_custkey, count(*) AS total, unnest(range(0, count(*), 5)) AS at FROM orders GROUP BY o_custkey")
def _(spark, d):
    from sondegrid.sources.catalog import pages

    return pages(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total")), "total", 5)


@q("so04_first_of_group", "SELECT o_custkey, o_orderkey, CAST(r AS INT) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(spark, d):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", r.alias("r")).where("r <= 3")


QUERIES, SQL = q.queries, q.sql
