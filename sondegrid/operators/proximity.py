"""Points near other points, and the regions that contain them.

Near: points on the sphere are put in cubes four times as wide as the distance; a point asks in each cube that its
surroundings reach into, three or four on average, and each point stands in one cube, so a pair meets once. Nothing special
is needed at the poles or the date line.

Inside: regions come as rings in plane longitude and latitude. The circle of longitudes is halved again and again; a region
is listed under the cells of the finest halving that is as wide as it, so under at most four, modulo 360. A point asks once
for each halving in use; the list of cells is sent to all executors if it is small. Points in the box of a region, at any
turn of the circle, meet the edges in their latitude strip of that region; crossings of the ray to the east are counted by
point, region and polygon, an odd number meaning inside, and a point on an edge is on the boundary. A region wider than the
circle is met once for each turn.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sondegrid.session import checked_broadcast

RADIUS = 6_371_008.8
STRIPS = 32
WIDE = 4
FINEST = 15  # halvings of the circle: the smallest cells of regions are of 0.011 degrees
#: Bytes of the list of cells that is sent to all executors; a longer one is joined by shuffle.
LISTED = 64 << 20


def located(points: DataFrame, id_col: str = "mark_id", x: str = "xpos", y: str = "ypos") -> DataFrame:
    """(id, lon in -180..180, lat) of the points that have a location; rows that repeat an id count once."""
    lon, lat = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    p = points.select(F.col(f"`{id_col}`").alias("id"), lon.alias("lon"), lat.alias("lat")).where(F.col("id").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    p = p.where(~F.isnan("lon") & ~F.isnan("lat") & (F.abs("lat") <= 90) & (F.abs("lon") < float("inf")))
    p = p.groupBy("id").agg(F.min(F.struct("lon", "lat")).alias("p")).select("id", "p.*")
    rest = F.col("lon") % 360
    return p.withColumn("lon", F.when((F.col("lon") >= -180) & (F.col("lon") < 180), F.col("lon")).when(rest < -180, rest + 360).when(rest >= 180, rest - 360).otherwise(rest))


def near_pairs(points: DataFrame, metres: float, id_col: str = "mark_id", x: str = "xpos", y: str = "ypos", radius: float = RADIUS) -> DataFrame:
    """(a, b): ids, smaller first, at most so far apart on the sphere. Points without a location (null, NaN or infinite
    coordinates, latitudes beyond 90) and without id are in no pair; repeated ids count once; an empty table has none."""
    rad = lambda c: F.radians(F.col(c))
    p = located(points, id_col, x, y)
    reach, side = metres * 1.0001, metres * WIDE  # a chord is shorter than its arc
    axes = {"cx": F.cos(rad("lat")) * F.cos(rad("lon")), "cy": F.cos(rad("lat")) * F.sin(rad("lon")), "cz": F.sin(rad("lat"))}
    cube = lambda c, off: F.floor((c * F.lit(radius) + F.lit(off)) / F.lit(side)).cast("int")
    b = p.select(F.col("id").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), *[cube(c, 0.0).alias(n) for n, c in axes.items()])
    a = p.select(F.col("id").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), *[F.sequence(cube(c, -reach), cube(c, reach)).alias(n) for n, c in axes.items()])
    for n in axes:
        a = a.withColumn(n, F.explode(n))
    met = a.join(b, list(axes)).where("a < b")
    half = F.pow(F.sin((rad("lat2") - rad("lat1")) / 2), 2) + F.cos(rad("lat1")) * F.cos(rad("lat2")) * F.pow(F.sin((rad("lon2") - rad("lon1")) / 2), 2)
    met = met.where(F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(half))) <= F.lit(metres))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


_HEAD = re.compile(r"\s*(?:srid\s*=\s*\d+\s*;)?\s*(multi)?polygon\s*(?:z|m|zm)?\s*", re.I)
_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
_POINT = re.compile(rf"\s*({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER}){{0,2}}\s*")


def parse_wkt(text: str | None) -> list[list[list[tuple[float, float]]]] | None:
    """Polygons of rings of points, or None if the text is no whole polygon or multipolygon. A ring without its last point
    is closed; keywords in any case, with SRID, Z and any spacing."""
    if not text or not (m := _HEAD.match(text)):
        return None
    at = m.end()

    def token(c: str) -> bool:
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1
        if text[at : at + 1] == c:
            at += 1
            return True
        return False

    def many(item):
        if not token("("):
            return None
        out = []
        while True:
            if (one := item()) is None:
                return None
            out.append(one)
            if token(")"):
                return out
            if not token(","):
                return None

    def point():
        nonlocal at
        if not (p := _POINT.match(text, at)):
            return None
        at = p.end()
        return float(p[1]), float(p[2])

    def ring():
        pts = many(point)
        return pts if pts and len(set(pts)) >= 3 else None

    polygon = lambda: many(ring)
    out = many(polygon) if m[1] else (one := polygon()) and [one]
    return out if out and not text[at:].strip().strip(";") else None


def regions(files: DataFrame, id_col: str = "file_id", wkt: str = "wkt", box: str = "minmax") -> DataFrame:
    """(region, part, x1, y1, x2, y2, strip, bounds): the edges of each region, once for each of its latitude strips.

    The region is the polygon text if it is whole, else the box if it has four finite numbers in order that aren't all
    zero, else none. Rows that repeat an id count once."""
    d = files.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("region")).agg(F.max(F.col(f"`{wkt}`")).alias("wkt"), F.max(F.col(f"`{box}`")).alias("box"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for region, text, limits in zip(b["region"], b["wkt"], b["box"]):
                polygons = parse_wkt(text)
                if polygons is None and limits is not None and len(limits) >= 4:
                    x0, x1, y0, y1 = (float("nan") if v is None else float(v) for v in limits[:4])
                    if all(map(math.isfinite, (x0, x1, y0, y1))) and x0 <= x1 and y0 <= y1 and any(v for v in limits if v is not None):
                        x1 = min(x1, x0 + 720)  # a box wider than two turns holds no more longitudes than one of two
                        polygons = [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]]
                if not polygons:
                    continue
                pts = [p for poly in polygons for r in poly for p in r]
                xs, ys = [p[0] for p in pts], [p[1] for p in pts]
                turn = 360.0 * math.floor((min(xs) + 180) / 360)
                x0, x1, y0, y1 = min(xs) - turn, max(xs) - turn, min(ys), max(ys)
                high = max((y1 - y0) / min(STRIPS, max(1, len(pts) // 4)), 1e-9)
                for part, poly in enumerate(polygons):
                    for r in poly:
                        for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
                            if (ax, ay) != (bx, by):
                                lo, hi = sorted((ay, by))
                                for strip in range(int((lo - y0) / high), int((hi - y0) / high) + 1):
                                    out.append((region, part, ax - turn, ay, bx - turn, by, strip, x0, x1, y0, y1, high))
            yield pd.DataFrame(out, columns="region part x1 y1 x2 y2 strip xmin xmax ymin ymax high".split())

    return d.mapInPandas(run, f"region {d.schema['region'].dataType.simpleString()}, part int, x1 double, y1 double, x2 double, y2 double, strip int, xmin double, xmax double, ymin double, ymax double, high double")


def _place(c: Column, level: Column) -> Column:
    return F.floor(c * F.pow(F.lit(2.0), level) / 360).cast("int")


def inside(points: DataFrame, edges: DataFrame, id_col: str = "mark_id", x: str = "xpos", y: str = "ypos", boundary: bool = False, listed_bytes: int = LISTED) -> DataFrame:
    """(id, region): points in the interior of a region; on its boundary too if ``boundary``."""
    box = edges.groupBy("region").agg(*[F.first(c).alias(c) for c in ("xmin", "xmax", "ymin", "ymax", "high")])
    wide = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    fine = F.floor(F.log2(F.lit(360.0) / F.greatest(wide, F.lit(1e-9)))).cast("int")
    box = box.withColumn("level", F.least(F.lit(FINEST), F.greatest(F.lit(0), fine))).withColumn("lat0", F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("ymin")))).withColumn("lat1", F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("ymax"))))
    count = F.pow(F.lit(2.0), F.col("level")).cast("int")
    round_ = F.array_distinct(F.transform(F.sequence(_place(F.col("xmin") + 180, F.col("level")), _place(F.col("xmax") + 180, F.col("level"))), lambda i: F.pmod(i, count)))
    listed = box.withColumn("gx", F.explode(F.when(F.col("level") == 0, F.array(F.lit(0))).otherwise(round_)))
    listed = listed.withColumn("gy", F.explode(F.sequence(_place(F.col("lat0") + 90, F.col("level")), _place(F.col("lat1") + 90, F.col("level"))))).drop("lat0", "lat1")
    listed = checked_broadcast(listed, "region-cells", listed_bytes)
    p = located(points, id_col, x, y)
    levels = sorted(r["level"] for r in listed.select("level").distinct().collect())  # at most 16 numbers
    p = p.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = p.withColumn("gx", F.pmod(_place(F.col("lon") + 180, F.col("level")), F.pow(F.lit(2.0), F.col("level")).cast("int"))).withColumn("gy", _place(F.col("lat") + 90, F.col("level")))
    near = p.join(listed, ["level", "gx", "gy"]).where("lat >= ymin and lat <= ymax")
    turns = F.transform(F.sequence(F.floor((F.col("xmin") - F.col("lon")) / 360), F.ceil((F.col("xmax") - F.col("lon")) / 360)), lambda t: F.col("lon") + t * 360)
    near = near.withColumn("lon", F.explode(F.filter(turns, lambda v: (v >= F.col("xmin")) & (v <= F.col("xmax")))))
    near = near.select("id", "lon", "lat", "region", F.floor((F.col("lat") - F.col("ymin")) / F.col("high")).cast("int").alias("strip"))
    e = edges.select("region", "part", "x1", "y1", "x2", "y2", "strip")
    met = near.join(e, ["region", "strip"])
    cross = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("lon") - F.col("x1"))
    on = (cross == 0) & F.col("lon").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("lat").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    west = F.when(F.col("y2") > F.col("y1"), cross < 0).otherwise(cross > 0)  # the edge lies west of the point
    counted = met.groupBy("id", "lon", "region", "part").agg(F.sum((spans & ~west).cast("int")).alias("crossings"), F.max(on).alias("on"))
    hit = counted.groupBy("id", "region").agg(F.max((F.col("crossings") % 2 == 1) & ~F.col("on")).alias("within"), F.max("on").alias("on"))
    return hit.where((F.col("within") & ~F.col("on")) | F.lit(boundary) & F.col("on")).select("id", "region")
