"""Joins of points, cells, boxes and dimension tables. All are equi-joins; overlap of boxes goes through tile keys."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sondegrid.grid import GridSpec
from sondegrid.region import overlap

K = ["row", "col"]
LETTERS = {"x": "x", "y": "y", "z": "z", "g": "g", "d": "d", "m": "m", "c": "c", "s": "s"}


def query_grid(points: DataFrame, cells: DataFrame, spec: GridSpec, form: str | None = None) -> DataFrame:
    """Grid value g at each point, d = z - g and m = z + g; points east of the west and south of the north border, where
    the grid has data. ``form`` picks output columns by letters."""
    p = points.where((F.col("x") > F.lit(spec.xmin)) & (F.col("y") < F.lit(spec.ymax))).withColumn("row", spec.row()).withColumn("col", spec.col())
    out = p.join(cells.select(*K, F.col("v").alias("g")), K).withColumn("d", F.col("z") - F.col("g")).withColumn("m", F.col("z") + F.col("g"))
    return out.select(*[LETTERS[c] for c in form]) if form else out.drop(*K)


def query_grid_all(points: DataFrame, cells: DataFrame, spec: GridSpec) -> DataFrame:
    """As query_grid in the pixel convention for every point: without data the sentinel stands for g. c is the difference in
    percent of g and s the one to the sum, both made safe by a small term."""
    at = lambda v, o, step: F.floor((F.col(v) - F.lit(float(o))) / F.lit(float(step))).cast("int")
    p = points.withColumn("col", at("x", spec.xmin, spec.dx)).withColumn("row", at("y", spec.ymax, spec.dy))
    g = F.coalesce(F.col("g").cast("double"), F.lit(spec.ndv))
    out = p.join(cells.select(*K, F.col("v").alias("g")), K, "left").withColumn("g", g)
    d = F.col("z") - F.col("g")
    out = out.withColumn("d", d)
    out = out.withColumn("c", F.abs(F.round(d / F.nullif(F.col("g") + F.lit(1e-8), F.lit(0.0)) * 100, 2)))
    return out.withColumn("s", F.abs(F.round(d / F.nullif(F.col("z") + F.col("g") + F.lit(1e-8), F.lit(0.0)), 4))).drop(*K)


def grid_difference(a: DataFrame, b: DataFrame, sign: int = -1) -> DataFrame:
    """Cells in both: a - b, or a + b."""
    j = a.join(b.select(*K, F.col("v").alias("_b")), K)
    return j.select(*K, (F.col("v") + F.col("_b") * sign).alias("v"))


def clip_by_mask(points: DataFrame, mask: DataFrame, remove=0, invert: bool = False) -> DataFrame:
    """Indexed points where the mask has a value other than ``remove``; inverted, all others."""
    keep = mask.where(F.col("v").isNotNull() & (F.col("v") != F.lit(remove))).select(*K)
    return points.join(keep, K, "left_anti" if invert else "left_semi")


def mask_out(cells: DataFrame, mask: DataFrame, ndv) -> DataFrame:
    """Cells that the mask has lose their value."""
    j = cells.join(mask.select(*K).withColumn("_m", F.lit(1)), K, "left")
    return j.select(*K, F.when(F.col("_m").isNotNull(), F.lit(ndv)).otherwise(F.col("v")).alias("v"))


def priority_fill(spec: GridSpec, layers: list[DataFrame], default=None) -> DataFrame:
    """Every cell of the lattice with the value of the first layer that has one."""
    d = spec.lattice(layers[0].sparkSession)
    for i, layer in enumerate(layers):
        d = d.join(layer.select(*K, F.col("v").alias(f"_{i}")), K, "left")
    return d.select(*K, F.coalesce(*[F.col(f"_{i}") for i in range(len(layers))], F.lit(default)).alias("v"))


def vote_mask(spec: GridSpec, layers: list[DataFrame]) -> DataFrame:
    """Every cell of the lattice with the sum of the layers' votes."""
    d = spec.lattice(layers[0].sparkSession)
    for i, layer in enumerate(layers):
        d = d.join(layer.select(*K, F.col("v").alias(f"_{i}")), K, "left")
    return d.select(*K, reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_{i}"), F.lit(0)) for i in range(len(layers))]).cast("int").alias("v"))


def overlap_join(a: DataFrame, b: DataFrame, tile: float, a_id: str, b_id: str) -> DataFrame:
    """(a_id, b_id) of boxes that meet, touching included. Both sides are listed under the tiles they cover and joined by
    tile; a pair is kept in one tile only, that of the south-west corner of its common part. Invalid boxes meet nothing.
    The tile should be about as large as the larger boxes; a box over n tiles is listed n times."""
    cover = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.lit(tile)), F.floor(F.col(hi) / F.lit(tile)))
    box = ["xmin", "xmax", "ymin", "ymax"]

    def listed(t, i):
        t = t.where("xmin <= xmax and ymin <= ymax").select(F.col(i).alias("id"), *box)
        return t.withColumn("tx", F.explode(cover("xmin", "xmax"))).withColumn("ty", F.explode(cover("ymin", "ymax")))

    j = listed(a, a_id).alias("a").join(listed(b, b_id).alias("b"), ["tx", "ty"]).where(overlap())
    first = (F.col("tx") == F.floor(F.greatest("a.xmin", "b.xmin") / F.lit(tile))) & (F.col("ty") == F.floor(F.greatest("a.ymin", "b.ymin") / F.lit(tile)))
    return j.where(first).select(F.col("a.id").alias(a_id), F.col("b.id").alias(b_id))


def zone_lookup(rows: DataFrame, zones: DataFrame, key: str, fallback: DataFrame | None = None) -> DataFrame:
    """Left join to a table (zone, epsg); rows without one take epsg from a table (key, epsg) found otherwise."""
    out = rows.join(zones.select(F.col("zone").alias(key), "epsg"), key, "left")
    if fallback is None:
        return out
    out = out.join(fallback.select(F.col("id"), F.col("epsg").alias("_f")), "id", "left")
    return out.withColumn("epsg", F.coalesce("epsg", "_f")).drop("_f")


def ordered_lookup(ways: DataFrame, nodes: DataFrame, way: str = "way", refs: str = "nodes", node: str = "id") -> DataFrame:
    """(way, pos, node columns): each way's nodes in order; ways keep nodes that repeat, unknown ones are dropped."""
    w = ways.select(way, F.posexplode(refs).alias("pos", node))
    return w.join(nodes, node)


def polygon_join(a: DataFrame, b: DataFrame, tile: float, a_id: str, b_id: str, rings: str = "rings") -> DataFrame:
    """(a_id, b_id) of features (box and rings) whose polygons meet: boxes by tile keys first, polygons only of those pairs."""
    from sondegrid.geom import polygons_meet

    pairs = overlap_join(a, b, tile, a_id, b_id)
    j = pairs.join(a.select(a_id, F.col(rings).alias("_ra")), a_id).join(b.select(b_id, F.col(rings).alias("_rb")), b_id)

    @F.pandas_udf("boolean")
    def meet(x: pd.Series, y: pd.Series) -> pd.Series:
        plain = lambda p: [[(v["x"], v["y"]) for v in r] for r in p]
        return pd.Series([polygons_meet(plain(p), plain(r)) for p, r in zip(x, y)], dtype=bool)

    return j.where(meet("_ra", "_rb")).select(a_id, b_id)
