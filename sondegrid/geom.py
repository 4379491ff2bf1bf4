"""Polygons as columns: rings are arrays of (x, y); predicates are higher-order functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RING = "array<struct<x:double,y:double>>"
_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"


def box_ring(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """The closed ring of a box, from the south-west corner by the north-west one."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(pt(xmin, ymin), pt(xmin, ymax), pt(xmax, ymax), pt(xmax, ymin), pt(xmin, ymin))


def ring_text(ring: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")"))


def polygon_wkt(rings: Column) -> Column:
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring_text), ","), F.lit(")"))


def multipolygon_wkt(polygons: Column) -> Column:
    """From an array of arrays of rings."""
    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(polygons, lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring_text), ","), F.lit(")"))), ","), F.lit(")"))


def wkt_rings(wkt: Column) -> Column:
    """All rings of a polygon or multipolygon text; malformed points become nulls."""
    bodies = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)
    point = lambda s: F.struct(F.try_element_at(F.split(F.trim(s), r"\s+"), F.lit(1)).try_cast("double").alias("x"), F.try_element_at(F.split(F.trim(s), r"\s+"), F.lit(2)).try_cast("double").alias("y"))
    return F.transform(bodies, lambda b: F.transform(F.split(b, ","), point))


def points_of(rings: Column) -> Column:
    return F.flatten(rings)


def envelope(rings: Column) -> dict[str, Column]:
    xs, ys = F.transform(F.flatten(rings), lambda p: p["x"]), F.transform(F.flatten(rings), lambda p: p["y"])
    return {"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)}


def _pairs(ring: Column) -> Column:
    """(a, b) of neighbouring points; a ring without its last point is closed."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i % n + 1).alias("b")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_pairs(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]), lambda s: s / 2)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """Edges that a ray to the east crosses."""
    def add(n, e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        spans = (ay > y) != (by > y)
        at = ax + (y - ay) * (bx - ax) / F.nullif(by - ay, F.lit(0.0))
        return n + F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(_pairs(ring), F.lit(0), add)


def on_edge(ring: Column, x: Column, y: Column) -> Column:
    def test(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))

    return F.exists(_pairs(ring), test)


def within(rings: Column, x: Column, y: Column) -> Column:
    """In the interior: an odd number of crossings over all rings, and on no edge."""
    odd = F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(r, x, y)) % 2 == 1
    return odd & ~F.exists(rings, lambda r: on_edge(r, x, y))


def polygons_meet(a, b) -> bool:
    """Polygons (lists of rings of (x, y)) have a point in common: an edge of one meets an edge of the other, or one lies in the other."""
    import numpy as np

    def edges(p):
        return np.array([(*s, *e) for r in p for s, e in zip(r, [*r[1:], r[0]]) if tuple(s) != tuple(e)], float)

    def inside(x, y, e):
        spans = (e[:, 1] > y) != (e[:, 3] > y)
        e = e[spans]
        return bool(np.count_nonzero(x < e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])) % 2)

    ea, eb = edges(a), edges(b)
    if not len(ea) or not len(eb):
        return False
    p, q = ea[:, None, :], eb[None, :, :]

    def side(s, t):
        d = (s[..., 2] - s[..., 0]) * (t[..., 1] - s[..., 1]) - (s[..., 3] - s[..., 1]) * (t[..., 0] - s[..., 0])
        f = (s[..., 2] - s[..., 0]) * (t[..., 3] - s[..., 1]) - (s[..., 3] - s[..., 1]) * (t[..., 2] - s[..., 0])
        return d * f <= 0

    overlap = (np.maximum(p[..., 0], p[..., 2]) >= np.minimum(q[..., 0], q[..., 2])) & (np.minimum(p[..., 0], p[..., 2]) <= np.maximum(q[..., 0], q[..., 2]))
    overlap &= (np.maximum(p[..., 1], p[..., 3]) >= np.minimum(q[..., 1], q[..., 3])) & (np.minimum(p[..., 1], p[..., 3]) <= np.maximum(q[..., 1], q[..., 3]))
    if (side(p, q) & side(q, p) & overlap).any():
        return True
    return inside(ea[0, 0], ea[0, 1], eb) or inside(eb[0, 0], eb[0, 1], ea)
