"""Fixtures of the queries, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from sondegrid.grid import GridSpec
from sondegrid.region import Region

BOX = Region(-90.0, -89.0, 29.0, 30.0)
SPEC = GridSpec.from_region(BOX, 0.05)

#: Points in a box of one degree, made of whole-number arithmetic so that both engines agree; zc is in hundredths.
_PTS = """SELECT l_orderkey * 8 + l_linenumber AS pid,
 -90.0E0 + ((l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 10000)/10000.0E0 AS x,
 29.0E0 + ((l_orderkey*15485863 + l_suppkey*3571 + l_linenumber*7) % 10000)/10000.0E0 AS y,
 CAST(floor(l_extendedprice*100 + 0.5E0) AS BIGINT) - 5000000 AS zc, l_quantity AS w, l_suppkey AS src FROM """
PTS = f"pts AS ({_PTS} lineitem)"
KEPT = (
    PTS
    + """, binned AS (SELECT *, CAST(floor((x + 90.0E0)/0.05E0 + 0.5E0) AS INT) AS col, CAST(floor((y - 30.0E0)/-0.05E0 + 0.5E0) AS INT) AS row
 FROM pts WHERE x > -90 AND x < -89 AND y > 29 AND y < 30), kept AS (SELECT * FROM binned WHERE col < 20 AND row < 20)"""
)
CELLS = KEPT + ", cells AS (SELECT row, col, CAST(sum(zc) AS BIGINT) AS s, count(*) AS n, min(zc) AS lo, max(zc) AS hi FROM kept GROUP BY row, col)"
LATTICE = "lattice AS (SELECT CAST(r.range AS INT) AS row, CAST(c.range AS INT) AS col FROM range(20) r, range(20) c)"
#: Side-car boxes of the data files, each once.
BOXES = """boxes AS (SELECT DISTINCT file_id, name, source_id, numpts, minmax[1] AS xmin, minmax[2] AS xmax, minmax[3] AS ymin, minmax[4] AS ymax,
 minmax[5] AS zmin, minmax[6] AS zmax FROM inf_files WHERE minmax IS NOT NULL)"""
#: Datalist entries, each once.
ENTRIES = "entries AS (SELECT entry_id, min(parent) AS parent, min(path) AS path, min(fmt) AS fmt, min(weight) AS weight, min(metadata) AS metadata FROM datalist_entries GROUP BY entry_id)"


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def pts(spark, d):
    return table(spark, d, "lineitem").selectExpr(*_split(_PTS))


def _split(sql: str) -> list[str]:
    """Column expressions of the fixture's SELECT."""
    body = sql.strip().removeprefix("SELECT").rsplit(" FROM", 1)[0]
    out, depth, last = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(body[last:i])
            last = i + 1
    return [x.strip() for x in [*out, body[last:]]]


def kept(spark, d):
    return SPEC.index(pts(spark, d))


def boxes(spark, d):
    at = lambda i, n: f"element_at(minmax, {i}) AS {n}"
    cols = [at(i + 1, n) for i, n in enumerate(("xmin", "xmax", "ymin", "ymax", "zmin", "zmax"))]
    return table(spark, d, "inf_files").where("minmax is not null").selectExpr("file_id", "name", "source_id", "numpts", *cols).distinct()


def entries(spark, d):
    from pyspark.sql import functions as F

    return table(spark, d, "datalist_entries").groupBy("entry_id").agg(*[F.min(c).alias(c) for c in ("parent", "path", "fmt", "weight", "metadata")])


class Registry:
    """Collects queries and their SQL by a decorator."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
