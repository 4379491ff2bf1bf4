"""Regions: boxes of longitude and latitude, on the driver and as columns xmin, xmax, ymin, ymax."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Region:
    xmin: float
    xmax: float
    ymin: float
    ymax: float

    @classmethod
    def parse(cls, text: str) -> Region:
        """From text such as -R-90/-89/29/30."""
        v = [float(x) for x in text.removeprefix("-R").split("/")]
        return cls(*v[:4])

    @property
    def valid(self) -> bool:
        return self.xmin <= self.xmax and self.ymin <= self.ymax

    @property
    def center(self) -> tuple[float, float]:
        return (self.xmin + self.xmax) / 2, (self.ymin + self.ymax) / 2

    def buffer(self, by: float, percent: bool = False) -> Region:
        by = ((self.xmax - self.xmin) + (self.ymax - self.ymin)) / 2 * by / 100 if percent else by
        return Region(self.xmin - by, self.xmax + by, self.ymin - by, self.ymax + by)

    def contains(self, strict: bool = False, x: str = "x", y: str = "y") -> Column:
        x, y = F.col(x), F.col(y)
        b = [F.lit(float(v)) for v in (self.xmin, self.xmax, self.ymin, self.ymax)]
        if strict:
            return (x > b[0]) & (x < b[1]) & (y > b[2]) & (y < b[3])
        return (x >= b[0]) & (x <= b[1]) & (y >= b[2]) & (y <= b[3])

    def intersects(self) -> Column:
        """Of rows with a box; touching counts."""
        return (F.col("xmin") <= F.lit(self.xmax)) & (F.col("xmax") >= F.lit(self.xmin)) & (F.col("ymin") <= F.lit(self.ymax)) & (F.col("ymax") >= F.lit(self.ymin))

    def merge(self, o: Region) -> Region:
        return Region(min(self.xmin, o.xmin), max(self.xmax, o.xmax), min(self.ymin, o.ymin), max(self.ymax, o.ymax))

    def reduce(self, o: Region) -> Region:
        return Region(max(self.xmin, o.xmin), min(self.xmax, o.xmax), max(self.ymin, o.ymin), min(self.ymax, o.ymax))


def valid() -> Column:
    return F.coalesce((F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax")), F.lit(False))


def zeros() -> Column:
    return (F.col("xmin") == 0) & (F.col("xmax") == 0) & (F.col("ymin") == 0) & (F.col("ymax") == 0)


def center(compat: bool = False) -> list[Column]:
    """xc and yc; ``compat`` adds half of the greater bound's coordinate instead of half of the extent."""
    out = []
    for a, b, n in (("xmin", "xmax", "xc"), ("ymin", "ymax", "yc")):
        a, b = F.col(a), F.col(b)
        out.append((a + (b - a / 2) if compat else (a + b) / 2).alias(n))
    return out


def percent(p: float) -> Column:
    return ((F.col("xmax") - F.col("xmin")) * F.lit(p / 100) + (F.col("ymax") - F.col("ymin")) * F.lit(p / 100)) / 2


def buffered(by: Column | float) -> list[Column]:
    by = F.lit(by) if isinstance(by, (int, float)) else by
    return [(F.col(c) + by * s).alias(c) for c, s in (("xmin", -1), ("xmax", 1), ("ymin", -1), ("ymax", 1))]


def overlap(a: str = "a", b: str = "b") -> Column:
    """Boxes of two aliased tables meet; touching counts, nulls don't."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "xmin") <= c(b, "xmax")) & (c(a, "xmax") >= c(b, "xmin")) & (c(a, "ymin") <= c(b, "ymax")) & (c(a, "ymax") >= c(b, "ymin"))


def merged(*groups: str) -> list[Column]:
    """Aggregates of the common envelope."""
    return [F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax")]


def reduced() -> list[Column]:
    """Aggregates of the common part, which may be no valid box."""
    return [F.max("xmin").alias("xmin"), F.min("xmax").alias("xmax"), F.max("ymin").alias("ymin"), F.min("ymax").alias("ymax")]


def formatted(style: str) -> Column:
    """The box as text: str, sstr, gmt, bbox, osm_bbox, te, ul_lr or fn (a file name part of the north-west corner)."""
    orders = {"str": ("/", "xmin xmax ymin ymax"), "sstr": (" ", "xmin xmax ymin ymax"), "gmt": ("/", "xmin xmax ymin ymax"), "bbox": (",", "xmin ymin xmax ymax"), "osm_bbox": (",", "ymin xmin ymax xmax"), "te": (" ", "xmin ymin xmax ymax"), "ul_lr": (" ", "xmin ymax xmax ymin")}
    if style == "fn":
        whole = lambda c: F.abs(F.col(c).cast("int"))
        part = lambda c: F.abs((F.col(c) * 100).cast("int")) % 100
        return F.format_string("%s%02dx%02d_%s%03dx%02d", F.when(F.col("ymax") < 0, "s").otherwise("n"), whole("ymax"), part("ymax"), F.when(F.col("xmin") > 0, "e").otherwise("w"), whole("xmin"), part("xmin"))
    sep, cols = orders[style]
    text = F.concat_ws(sep, *[F.col(c).cast("string") for c in cols.split()])
    return F.concat(F.lit("-R"), text) if style == "gmt" else text


def chunks(spark: SparkSession, region: Region, inc: float, cells: int, buffer: float = 0.0) -> DataFrame:
    """(chunk, xmin, xmax, ymin, ymax): boxes of so many cells, column by column from the south-west, clipped to the region."""
    step = inc * cells
    nx, ny = (math.ceil((b - a) / step - 1e-9) for a, b in ((region.xmin, region.xmax), (region.ymin, region.ymax)))
    d = spark.range(nx * ny).select(F.col("id").alias("chunk"), F.expr(f"cast(id div {ny} as double)").alias("i"), (F.col("id") % ny).cast("double").alias("j"))
    lo = lambda a, k: F.lit(float(a)) + F.col(k) * F.lit(float(step))
    hi = lambda a, k, top: F.least(F.lit(float(a)) + (F.col(k) + 1) * F.lit(float(step)), F.lit(float(top)))
    d = d.select("chunk", lo(region.xmin, "i").alias("xmin"), hi(region.xmin, "i", region.xmax).alias("xmax"), lo(region.ymin, "j").alias("ymin"), hi(region.ymin, "j", region.ymax).alias("ymax"))
    return d.select("chunk", *buffered(float(buffer))) if buffer else d
