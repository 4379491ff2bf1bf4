"""Grids: where a point falls, where a cell lies. A grid is a few numbers on the driver; its methods give Column expressions.

Two conventions: ``node`` rounds half up to the nearest node, ``pixel`` takes the cell the point is in. Cells are rows
(row, col, v); a cell without data has no row, or a null where an operator needs the whole lattice.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sondegrid.region import Region


def _d(v: float) -> Column:
    return F.lit(float(v))


@dataclass(frozen=True)
class GridSpec:
    xmin: float
    ymax: float
    dx: float
    dy: float  # negative, as rows go south
    nx: int
    ny: int
    registration: str = "node"
    ndv: float = -9999.0
    epsg: int = 4326
    border: bool = False  # do points on the border of the region count? those at the places of cells need it

    @classmethod
    def from_region(cls, region: Region, inc: float, y_inc: float | None = None, **kw) -> GridSpec:
        """Size by rounding the extents half up; ``y_inc`` is negative, the same as -inc if left out."""
        dy = -inc if y_inc is None else y_inc
        nx = math.floor((region.xmax - region.xmin) / inc + 0.5)
        ny = math.floor((region.ymin - region.ymax) / dy + 0.5)
        return cls(region.xmin, region.ymax, inc, dy, nx, ny, **kw)

    @property
    def geotransform(self) -> tuple[float, ...]:
        return (self.xmin, self.dx, 0.0, self.ymax, 0.0, self.dy)

    @property
    def half(self) -> float:
        return 0.5 if self.registration == "node" else 0.0

    def region(self) -> Region:
        return Region(self.xmin, self.xmin + self.dx * self.nx, self.ymax + self.dy * self.ny, self.ymax)

    def col(self, x: Column | str = "x") -> Column:
        x = F.col(x) if isinstance(x, str) else x
        return F.floor((x - _d(self.xmin)) / _d(self.dx) + _d(self.half)).cast("int")

    def row(self, y: Column | str = "y") -> Column:
        y = F.col(y) if isinstance(y, str) else y
        return F.floor((y - _d(self.ymax)) / _d(self.dy) + _d(self.half)).cast("int")

    def x(self, col: Column | str = "col") -> Column:
        return _d(self.xmin) + F.col(col) * _d(self.dx) if isinstance(col, str) else _d(self.xmin) + col * _d(self.dx)

    def y(self, row: Column | str = "row") -> Column:
        return _d(self.ymax) + F.col(row) * _d(self.dy) if isinstance(row, str) else _d(self.ymax) + row * _d(self.dy)

    def index(self, points: DataFrame, strict: bool = True) -> DataFrame:
        """Adds row and col; points outside, and those whose index is beyond the last cell, are dropped."""
        d = points.where(self.region().contains(strict=not self.border)) if strict else points
        d = d.withColumn("row", self.row()).withColumn("col", self.col())
        return d.where(f"row >= 0 and row < {self.ny} and col >= 0 and col < {self.nx}")

    def lattice(self, spark: SparkSession) -> DataFrame:
        """All cells; made by a range, never on the driver."""
        d = spark.range(self.nx * self.ny)
        return d.select(F.expr(f"cast(id div {self.nx} as int)").alias("row"), (F.col("id") % self.nx).cast("int").alias("col"))

    def srcwin(self, region: Region) -> tuple[int, int, int, int]:
        """(xoff, yoff, xsize, ysize) of a region: negative starts become 0, ends are clipped to the grid."""
        c0, c1 = ((v - self.xmin) / self.dx for v in (region.xmin, region.xmax))
        r0, r1 = ((v - self.ymax) / self.dy for v in (region.ymax, region.ymin))
        x0, x1, y0, y1 = (math.floor(v + 0.5) for v in (c0, c1, r0, r1))
        x0, y0 = max(0, x0), max(0, y0)
        return x0, y0, max(0, min(x1, self.nx) - x0), max(0, min(y1, self.ny) - y0)

    def cut(self, region: Region) -> GridSpec:
        x, y, nx, ny = self.srcwin(region)
        return replace(self, xmin=self.xmin + x * self.dx, ymax=self.ymax + y * self.dy, nx=nx, ny=ny)

    def invert(self, x: float, y: float) -> tuple[float, float]:
        """Fractional (col, row); the affine inverse, here without rotation."""
        return (x - self.xmin) / self.dx, (y - self.ymax) / self.dy

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> GridSpec:
        return cls(**json.loads(text))
