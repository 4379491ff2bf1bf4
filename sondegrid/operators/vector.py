"""Polygons from cells and of points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sondegrid import geom
from sondegrid.session import materialize

K = ["row", "col"]


def components(cells: DataFrame) -> DataFrame:
    """(row, col, v, label): 4-connected parts of equal value, labelled by their least row * 2^32 + col.

    Labels travel along edges by least label, and each round also jumps to the label of the label, so rounds grow with the
    logarithm of a part's length; they end when no label changes. Every round is written to the shared folder."""
    key = lambda r, c: F.col(r).cast("bigint") * F.lit(1 << 32) + F.col(c)
    base = cells.where("v is not null").select(*K, "v", key("row", "col").alias("id"))
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 1), (1, 0))]))
    moved = base.withColumn("s", shift).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), F.col("v").alias("w"), F.col("id").alias("a"))
    e = moved.join(base.select(*K, "v", F.col("id").alias("b")), K).where("v = w").select("a", "b")
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "parts-edges")
    lab = materialize(base.select("id", F.col("id").alias("label")), "parts-labels")
    while True:
        near = e.join(lab, e["b"] == lab["id"]).select(F.col("a").alias("id"), "label")
        new = lab.unionByName(near).groupBy("id").agg(F.min("label").alias("label"))
        # the roots learn what their members found, then all jump
        roots = new.join(lab.withColumnRenamed("label", "old"), "id").where("label < old").groupBy(F.col("old").alias("id")).agg(F.min("label").alias("to"))
        new = new.join(roots, "id", "left").select("id", F.least("label", F.coalesce("to", "label")).alias("label"))
        far = new.select(F.col("id").alias("label"), F.col("label").alias("to"))
        new = materialize(new.join(far, "label", "left").select("id", F.least("label", F.coalesce("to", "label")).alias("label")), "parts-labels")
        if new.join(lab.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty():
            break
        lab = new
    return base.join(lab, "id").select(*K, "v", "label")


def _chain(edges: np.ndarray) -> list[list[tuple[int, int]]]:
    """Rings of directed unit edges (x1, y1, x2, y2) that have the interior to their left, y growing northwards. Where four edges
    meet, a ring turns left, so that areas which only touch at a corner stay apart. Points on straight lines are left out."""
    onward: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x1, y1, x2, y2 in edges.tolist():
        onward.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    for start in sorted(onward):
        while onward[start]:
            at, to = start, onward[start].pop()
            ring, first = [], (to[0] - at[0], to[1] - at[1])
            way = first
            while True:
                at = to
                out = onward[at]
                if at == start and (not out or len(out) == 1 and (way[0], way[1]) and _left(way, (out[0][0] - at[0], out[0][1] - at[1])) <= _left(way, first)):
                    if way != first:
                        ring.append(at)
                    break
                k = max(range(len(out)), key=lambda i: _left(way, (out[i][0] - at[0], out[i][1] - at[1])))
                to = out.pop(k)
                turn = (to[0] - at[0], to[1] - at[1])
                if turn != way:
                    ring.append(at)
                way = turn
            rings.append(ring)
    return rings


def _left(a: tuple[int, int], b: tuple[int, int]) -> int:
    return a[0] * b[1] - a[1] * b[0]


def _twice(ring: list[tuple[int, int]]) -> int:
    """Twice the signed area."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def _holds(ring: list[tuple[int, int]], x: float, y: float) -> bool:
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def polygonize(cells: DataFrame, spec, by: list[str]) -> DataFrame:
    """(by, polygons, holes, area, rings, wkt): the outlines of each group's cells as a multipolygon, one polygon for each
    4-connected part, in coordinates of the grid. Cells are told apart by (row, col); rows of one cell count once.

    Edges between two cells of a group cancel out in one aggregate, so only the outline of a group comes to one task; like the
    polygon it must fit in memory. ``rings`` has for each polygon its shell, counter-clockwise, and its holes."""
    kinds = dict(cells.dtypes)
    r, c = F.col("row"), F.col("col")
    pt = lambda x, y: (x.cast("int"), (-y).cast("int"))
    sides = [(pt(c, r + 1), pt(c + 1, r + 1)), (pt(c + 1, r + 1), pt(c + 1, r)), (pt(c + 1, r), pt(c, r)), (pt(c, r), pt(c, r + 1))]
    edge = lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    e = cells.select(*by, *K).distinct().select(*by, F.explode(F.array(*[F.struct(F.least(edge(a, b), edge(b, a)).alias("k"), edge(a, b).alias("e")) for a, b in sides])).alias("s"))
    rim = e.groupBy(*by, F.col("s.k").alias("_k")).agg(F.count("*").alias("_n"), F.first("s.e").alias("_e")).where("_n = 1").select(*by, "_e.x1", "_e.y1", "_e.x2", "_e.y2")
    half, x0, dx, y0, dy = spec.half, spec.xmin, spec.dx, spec.ymax, -spec.dy

    def trace(p: pd.DataFrame) -> pd.DataFrame:
        rings = _chain(p[["x1", "y1", "x2", "y2"]].to_numpy(np.int64))
        shells = sorted((x for x in rings if _twice(x) > 0), key=lambda x: (_twice(x), min(x)))
        parts = [[s] for s in shells]
        for h in (x for x in rings if _twice(x) < 0):
            (ax, ay), (bx, by_) = h[0], h[1]  # the hole's own side of its first edge lies to its right
            n = max(abs(bx - ax), abs(by_ - ay))
            ux, uy = (bx - ax) / n, (by_ - ay) / n
            x, y = ax + 0.5 * ux + 0.5 * uy, ay + 0.5 * uy - 0.5 * ux
            parts[next(i for i, s in enumerate(shells) if _holds(s, x, y))].append(h)
        at = lambda q: {"x": x0 + (q[0] - half) * dx, "y": y0 + (q[1] + half) * dy}
        closed = [[[at(q) for q in [*ring, ring[0]]] for ring in part] for part in parts]
        area = sum(_twice(x) for x in rings) / 2 * dx * dy
        return pd.DataFrame({k: [p[k].iloc[0]] for k in by} | {"polygons": [len(parts)], "holes": [len(rings) - len(parts)], "area": [area], "rings": [closed]})

    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", polygons int, holes int, area double, rings array<array<array<struct<x: double, y: double>>>>"
    return rim.groupBy(*by).applyInPandas(trace, schema).withColumn("wkt", geom.multipolygon_wkt(F.col("rings")))


def collect_polygons(features: DataFrame, by: list[str], rings: str = "rings") -> DataFrame:
    """(by, wkt): the polygons of a group as one multipolygon text, without dissolving."""
    return features.groupBy(*by).agg(geom.multipolygon_wkt(F.array_sort(F.collect_list(rings))).alias("wkt"))


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull of points (n, 2), counter-clockwise, without the points on its sides."""
    p = np.unique(p, axis=0)
    if len(p) <= 2:
        return p

    def half(pts):
        out: list = []
        for q in pts:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def _small_hulls(x: np.ndarray, y: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the corners, group after group, and their numbers, of groups of at least 3 sorted points; the steps are those of
    ``hull``, of all groups at once: in each a group drops its last point or takes its next one."""

    def half(first: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(n), n.max()), np.int64)
        out[:, 0], out[:, 1] = first, first + way
        m, i, at = np.full(len(n), 2), np.full(len(n), 2), np.arange(len(n))
        while len(at):
            q, k = first[at] + way * i[at], m[at]
            u, v = out[at, np.maximum(k - 2, 0)], out[at, k - 1]
            drop = (k >= 2) & ((x[v] - x[u]) * (y[q] - y[u]) - (y[v] - y[u]) * (x[q] - x[u]) <= 0)
            m[at[drop]] -= 1
            to = at[~drop]
            out[to, m[to]] = q[~drop]
            m[to] += 1
            i[to] += 1
            at = at[i[at] < n[at]]
        return out, np.arange(out.shape[1]) < m[:, None] - 1

    (low, of_low), (up, of_up) = half(start, 1), half(start + n - 1, -1)
    of = np.hstack([of_low, of_up])
    return np.hstack([low, up])[of], of.sum(axis=1)


def _outside(x: np.ndarray, y: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether points, group after group, are not strictly inside the octagon of their group's extreme points in eight directions."""
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(g)]))
    ends = []
    for w in (x, x + y, y, y - x, -x, -x - y, -y, x - y):  # counter-clockwise
        top = np.flatnonzero(w == np.maximum.reduceat(w, start)[group])
        ends.append(top[np.searchsorted(top, start)])
    inside = np.ones(len(x), bool)
    for a, b in zip(ends, ends[1:] + ends[:1]):
        same = (x[a] == x[b]) & (y[a] == y[b])
        dx, dy = x[b] - x[a], y[b] - y[a]
        inside &= (dx[group] * (y - y[a][group]) - dy[group] * (x - x[a][group]) > 0) | same[group]
    flat = (x[ends[0]] == x[ends[4]]) | (y[ends[2]] == y[ends[6]])
    return ~inside | flat[group]


def hulls(x: np.ndarray, y: np.ndarray, g: np.ndarray, small: int = 32) -> np.ndarray:
    """Places of the corners of each group's hull, groups (whole numbers) in order and corners in that of ``hull``. Groups of up to
    ``small`` points are done together; of larger ones, what is not inside their octagon comes to ``hull`` one by one."""
    o = np.lexsort((y, x, g))
    o = o[np.r_[True, (x[o][1:] != x[o][:-1]) | (y[o][1:] != y[o][:-1]) | (g[o][1:] != g[o][:-1])]] if len(o) else o
    n = np.bincount(g[o]) if len(o) else np.zeros(0, np.int64)
    if (big := n[g[o]] > small).any():
        stay = ~big
        stay[big] = _outside(*(v[o][big] for v in (x, y, g)))
        o = o[stay]
        n = np.bincount(g[o], minlength=len(n))
    x, y, start = x[o], y[o], np.cumsum(n) - n
    at = [np.flatnonzero(n[g[o]] <= 2)]
    if len(k := np.flatnonzero((n > 2) & (n <= small))):
        at.append(_small_hulls(x, y, start[k], n[k])[0])
    for k in np.flatnonzero(n > small).tolist():
        own = slice(start[k], start[k] + n[k])
        h = hull(np.column_stack([x[own], y[own]]))
        place = {c: i for i, c in enumerate(zip(x[own].tolist(), y[own].tolist()), int(start[k]))}
        at.append(np.array([place[c] for c in map(tuple, h.tolist())], np.int64))
    at = o[np.concatenate(at)]
    return at[np.argsort(g[at], kind="stable")]


def _numbered(t: pa.Table, by: list[str]) -> np.ndarray:
    """Numbers of the groups of rows sorted by their keys, from 0; nulls are equal, and so are NaN."""
    new = np.zeros(len(t), bool)
    for c in by:
        v = t.column(c).combine_chunks()
        if pa.types.is_floating(v.type):
            f, null = v.to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= ((f[1:] != f[:-1]) & ~(np.isnan(f[1:]) & np.isnan(f[:-1]))) | (null[1:] != null[:-1])
        elif pa.types.is_nested(v.type):
            p = v.to_pylist()
            new[1:] |= np.array([a != b for a, b in zip(p[1:], p)], bool)
        else:
            i = v.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= i[1:] != i[:-1]
    return np.cumsum(new)


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows with the corners of whole groups, many groups at a time, and the groups' numbers. Of the group that goes on in the next
    batch only the corners so far are kept. A group without points has one row, with NaN."""

    def corners(t: pa.Table, g: np.ndarray) -> np.ndarray:
        x, y = (t.column(c).to_numpy() for c in "xy")
        ok = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
        h = ok[hulls(x[ok], y[ok], g[ok])]
        none = np.setdiff1d(np.arange(g[-1] + 1), g[h])
        at = np.r_[h, np.searchsorted(g, none)]
        return at[np.argsort(g[at], kind="stable")]

    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held, rows = [*held, pa.Table.from_batches([b])], rows + b.num_rows
        if rows < most:
            continue
        t = pa.concat_tables(held).combine_chunks()
        g = _numbered(t, by)
        at = corners(t, g)
        t, g = t.take(at), g[at]
        if (end := int(np.searchsorted(g, g[-1]))) > 0:
            yield t.slice(0, end), g[:end]
        held, rows = [t.slice(end)], 0
    if held:
        t = pa.concat_tables(held).combine_chunks()
        g = _numbered(t, by)
        at = corners(t, g)
        yield t.take(at), g[at]


def convex_hull(points: DataFrame, by: list[str], empty: bool = False, most: int = 1 << 17) -> DataFrame:
    """(by, corners, wkt) of the hull of each group.

    Each partition, sorted by group, sends only the corners of its part of a group; the corners of all parts have the group's hull.
    Many groups are done at once, some ``most`` rows, so that small groups don't cost a call each. Rows with a null or NaN coordinate
    are left out; with ``empty``, a group that has no others counts, with 0 corners and without text."""
    nan = F.lit(float("nan"))
    d = points.select(*by, *[F.coalesce(F.col(c).cast("double"), nan).alias(c) for c in "xy"])
    d = d if empty else d.where("not isnan(x) and not isnan(y)")
    keys = list(d.select(*by).schema)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _groups(batches, by, most):
            yield from t.combine_chunks().to_batches()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in _groups(batches, by, most):
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            x, y = (t.column(c).to_numpy() for c in "xy")
            none = np.isnan(x[start]) | np.isnan(y[start])
            end = np.r_[start[1:], len(g)]
            at = [f"{a} {b}" for a, b in zip(x.tolist(), y.tolist())]
            wkt = [None if no else f"POLYGON (({','.join(at[i:j])},{at[i]}))" for i, j, no in zip(start.tolist(), end.tolist(), none.tolist())]
            out = t.select(by).take(start).append_column("corners", pa.array(np.where(none, 0, end - start), pa.int32())).append_column("wkt", pa.array(wkt, pa.string()))
            yield from out.combine_chunks().to_batches()

    parts = d.sortWithinPartitions(*by).mapInArrow(part, d.schema)
    schema = T.StructType([*keys, T.StructField("corners", T.IntegerType()), T.StructField("wkt", T.StringType())])
    return parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(whole, schema)


def clip_ring(ring: list[tuple[float, float]], box) -> list[tuple[float, float]]:
    """Part of a ring inside a box, one side after the other (Sutherland and Hodgman); without a repeated last point."""
    pts = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    for axis, limit, sign in ((0, box.xmin, 1), (0, box.xmax, -1), (1, box.ymin, 1), (1, box.ymax, -1)):
        out: list = []
        for a, b in zip(pts, pts[1:] + pts[:1]):
            ia, ib = (a[axis] - limit) * sign >= 0, (b[axis] - limit) * sign >= 0
            if ia != ib:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                at = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
                out.append((limit, at) if axis == 0 else (at, limit))
            if ib:
                out.append(b)
        pts = out
    return pts


def clip_features(features: DataFrame, box, rings: str = "rings") -> DataFrame:
    """Rings cut to a box; features of which nothing is left are dropped."""
    kind = "array<array<struct<x:double,y:double>>>"

    @F.pandas_udf(kind)
    def cut(col: pd.Series) -> pd.Series:
        out = []
        for polygon in col:
            cut_rings = [clip_ring([(p["x"], p["y"]) for p in r], box) for r in polygon] if polygon is not None else []
            out.append([[{"x": x, "y": y} for x, y in r] for r in cut_rings if len(r) > 2])
        return pd.Series(out)

    return features.withColumn(rings, cut(F.col(rings))).where(F.size(rings) > 0)


def largest(features: DataFrame, n: int = 8, area: str = "area") -> DataFrame:
    """The n features of the greatest area with value 1."""
    return features.where("dn = 1").orderBy(F.col(area).desc(), "fid").limit(n)
