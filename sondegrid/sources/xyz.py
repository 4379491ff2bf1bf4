"""Text of points: x y z lines with any of several delimiters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sondegrid.operators.filters import z_pass
from sondegrid.region import Region


@dataclass(frozen=True)
class XyzConfig:
    """Layout of a source: places of the columns, delimiter (None: found in each line), lines to skip, shift and scale."""

    xpos: int = 0
    ypos: int = 1
    zpos: int = 2
    wpos: int | None = None
    delim: str | None = None
    skip: int = 0
    x_off: float = 0.0
    z_scale: float = 1.0
    lower_limit: float | None = None
    upper_limit: float | None = None


def line_delim(line: Column) -> Column:
    """The first of , / : in that order that the line has, else null (blanks)."""
    return F.when(F.contains(line, F.lit(",")), ",").when(F.contains(line, F.lit("/")), "/").when(F.contains(line, F.lit(":")), ":")


def fields(line: Column, delim: str | None = None) -> Column:
    t = F.trim(line)
    if delim is not None:
        return F.split(t, r"\s+" if delim in (" ", "space") else f"[{delim}]")
    return F.when(line_delim(t).isNull(), F.split(t, r"\s+")).otherwise(F.split(t, F.concat(F.lit("["), line_delim(t), F.lit("]"))))


def parse_xyz(lines: DataFrame, config: XyzConfig = XyzConfig(), line: str = "line", region: Region | None = None) -> DataFrame:
    """(x, y, z[, w], other columns): lines that don't parse are dropped. The region includes its border; limits of z are strict."""
    f = F.col("_f")
    at = lambda i: F.trim(F.try_element_at(f, F.lit(i + 1))).try_cast("double")
    rest = [c for c in lines.columns if c not in (line, "x", "y", "z", "w")]
    d = lines.withColumn("_f", fields(F.col(line), config.delim))
    cols = [(at(config.xpos) + F.lit(config.x_off)).alias("x"), at(config.ypos).alias("y"), (at(config.zpos) * F.lit(config.z_scale)).alias("z")]
    if config.wpos is not None:
        cols.append(at(config.wpos).alias("w"))
    d = d.select(*rest, *cols).where("x is not null and y is not null and z is not null")
    if region is not None:
        d = d.where(region.contains())
    return d.where(z_pass("z", config.upper_limit, config.lower_limit))


def skip_lines(numbered: DataFrame, n: int, by: str, number: str) -> DataFrame:
    """Without the first n lines of each file; lines come numbered from 1, so nothing is ordered."""
    return numbered.where(F.col(number) > n)


def read_xyz(spark: SparkSession, path: str, config: XyzConfig = XyzConfig(), region: Region | None = None, weight: float | None = None) -> DataFrame:
    """Points of text files (.gz too), with path. Header lines: one is dropped by its not being numbers; more are found by
    their order within the file's first split, which holds them."""
    d = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    if config.skip:
        # only lines of the first split are numbered, in the order they are read
        head = d.where("block = 0").withColumn("_k", F.monotonically_increasing_id())
        first = head.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("_k"))).where(F.col("_n") > config.skip).drop("_k", "_n")
        d = first.unionByName(d.where("block > 0"))
    p = parse_xyz(d.drop("block"), config, region=region)
    return p if weight is None else p.withColumn("w", F.lit(float(weight)))
