"""Datalists: trees of entries ``path format weight metadata``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sondegrid.session import materialize

#: Format codes and their file suffixes or module names (fixed values).
FORMATS = {
    -1: ("datalist", "datalist mb-1"),
    -2: ("archive", "zip gz"),
    -4: ("remote", "nos dc gmrt srtm_cgiar srtm_plus mar_grav charts mb tnm emodnet chs hrdem cudem"),
    168: ("xyz", "xyz csv dat ascii"),
    200: ("gdal", "tif img grd nc vrt bag"),
    300: ("lasf", "las laz"),
}


def format_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, e) for k, (n, exts) in FORMATS.items() for e in exts.split()], "fmt int, name string, ext string")


def format_of(path: Column) -> Column:
    """Code by the suffix, or by the module name before a colon where there is none."""
    return _lookup(_key(path))


def _lookup(key: Column) -> Column:
    out = None
    for k, (_, exts) in FORMATS.items():
        test = key.isin(*exts.split())
        out = F.when(test, k) if out is None else out.when(test, k)
    return out


def parse_entries(lines: DataFrame, line: str = "line", weight: float = 1.0) -> DataFrame:
    """(path, fmt, weight, meta): blank lines, comments and lines whose format or weight is no number are dropped; a missing
    format comes from the path, a missing weight is ``weight``."""
    d = lines.where(F.col(line).rlike(r"^[^#\s]")).withColumn("_w", F.split(F.trim(F.col(line)), r"\s+"))
    at = lambda i: F.try_element_at("_w", F.lit(i))
    rest = [c for c in lines.columns if c != line]
    meta = F.when(F.size("_w") > 3, F.split(F.array_join(F.slice("_w", 4, F.greatest(F.lit(1), F.size("_w"))), " "), ","))
    d = d.select(*rest, at(1).alias("path"), F.coalesce(at(2).try_cast("int"), F.when(at(2).isNull(), _lookup(_key(at(1))))).alias("fmt"), F.when(at(3).isNull(), F.lit(weight)).otherwise(at(3).try_cast("double")).alias("weight"), meta.alias("meta"))
    return d.where("fmt is not null and weight is not null")


def _key(path: Column) -> Column:
    parts = F.split(path, "[.]")
    return F.when(F.size(parts) == 1, F.element_at(F.split(path, ":"), 1)).otherwise(F.element_at(parts, -1))


def walk(edges: DataFrame, root) -> DataFrame:
    """(parent, path, fmt, weight, depth) of all entries below a root, weights multiplied along the way; ``edges`` has parent,
    path, fmt, weight. One join a level, to any depth. A list that is named several times is walked for each naming, with its
    weight; one that names itself, directly or by others, isn't walked again below itself."""
    level = edges.where(F.col("parent") == F.lit(root)).withColumn("depth", F.lit(1)).withColumn("_above", F.array(F.col("parent")))
    out = [level.drop("_above")]
    e = edges.select(F.col("parent").alias("_p"), F.col("path").alias("_c"), F.col("fmt").alias("_f"), F.col("weight").alias("_w"))
    depth = 1
    while True:
        depth += 1
        lists = level.where((F.col("fmt") == -1) & ~F.array_contains("_above", F.col("path"))).select("path", F.col("weight").alias("w"), F.array_append("_above", F.col("path")).alias("_above"))
        level = lists.join(e, F.col("path") == F.col("_p")).select(F.col("_p").alias("parent"), F.col("_c").alias("path"), F.col("_f").alias("fmt"), (F.col("w") * F.col("_w")).alias("weight"), F.lit(depth).alias("depth"), "_above")
        level = materialize(level, "datalist-level")
        if level.isEmpty():
            break
        out.append(level.drop("_above"))
    return union_all(out).where("fmt <> -1")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def major(parts: list[DataFrame]) -> DataFrame:
    """All entries of several lists as one."""
    return union_all(parts)


def roll_up(inf: DataFrame, parent: str = "parent") -> DataFrame:
    """Zone map of a list from those of its entries."""
    lo, hi = ("xmin", "ymin", "zmin"), ("xmax", "ymax", "zmax")
    return inf.groupBy(parent).agg(*[F.min(c).alias(c) for c in lo], *[F.max(c).alias(c) for c in hi], F.sum("numpts").alias("numpts"))


def list_files(spark: SparkSession, folder: str, suffixes: dict[str, int] | None = None) -> DataFrame:
    """(path, fmt, weight) of the files below a folder whose suffix is known; contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return d.where("length > 0").select("path", _lookup(_key(F.element_at(F.split("path", "/"), -1))).alias("fmt"), F.lit(1.0).alias("weight")).where("fmt is not null")
