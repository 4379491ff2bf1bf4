"""Queries p1 to p5 and p7 over their whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sondegrid.operators.compaction import compact, consolidate, data_records, landed, redundant, redundant_sets, without_redundant
from sondegrid.operators.lineparse import parse_lines
from sondegrid.operators.packed import split_packed
from sondegrid.operators.proximity import inside, near_pairs, regions
from sondegrid.operators.spikes import faulty
from sondegrid.operators.units import to_millimetres
from sondegrid.queries._problem_sql import P1, P2, P2_COMPACTED, P2_SMALL_FILES, P2_SOUNDINGS, P3, P4, P4_FAULTS, P5, P5_NUMBERS, P7
from sondegrid.session import fresh_path, materialize


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    return split_packed(_table(spark, d, "datalist_entries"), "entry_id", "metadata")


def p2_found(spark, d):
    return redundant(landed(spark, f"{d}/raw_lines.parquet"), _table(spark, d, "raw_files"))


def p2_compacted(spark, d):
    """Every record of the files that don't only repeat another one's."""
    return without_redundant(landed(spark, f"{d}/raw_lines.parquet"), _table(spark, d, "raw_files"))


def p2_files(spark, d):
    """The consolidated files: records and characters of each."""
    t = consolidate(spark, f"{d}/raw_lines.parquet", _table(spark, d, "raw_files"), fresh_path(spark, "consolidated"))
    return t.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("records"), F.sum(F.length("line")).alias("chars"))


def p2_small_files(spark, d):
    """Lines that arrive twice as files of at most 2,000 lines: records and characters after the first arrival, after another run
    without new files, and after the second arrival, always with one checkpoint."""
    root = fresh_path(spark, "arrivals")
    src, out, mark = (f"{root}/{x}" for x in ("files", "data", "checkpoint"))
    lines = _table(spark, d, "raw_lines").select("raw_id", "line_no", "line")
    points = _table(spark, d, "raw_files").where("fmt = 168").select("raw_id").distinct()
    steps = []
    for name, arrival in (("first", lines.join(points, "raw_id", "left_semi")), ("again", None), ("all", lines.join(points, "raw_id", "left_anti"))):
        if arrival is not None:
            arrival.write.mode("append").option("maxRecordsPerFile", 2000).parquet(src)
        kept = compact(spark, src, out, mark, lines.schema, files_per_batch=200)
        steps.append(materialize(kept.agg(F.lit(name).alias("step"), F.count("*").alias("records"), F.sum(F.length("line")).alias("chars")), "arrival"))
    return reduce(DataFrame.unionByName, steps)


def p2_soundings(spark, d):
    """Records that remain of each data file: each sounding once, without the files that only repeat another one's."""
    values = ["xpos", "ypos", "zpos", "weight"]
    once = landed(spark, f"{d}/soundings.parquet", ("sounding_id", "file_id", *values)).dropDuplicates(["sounding_id"])
    spare = redundant_sets(data_records(once, _table(spark, d, "inf_files"), "file_id", values, "loaded_at"))
    return once.join(spare.withColumnRenamed("raw_id", "file_id"), "file_id", "left_anti").groupBy("file_id").agg(F.count("*").alias("records"))


def p3_found(spark, d):
    return to_millimetres(_table(spark, d, "spot_heights"), _table(spark, d, "crs_units"))


def _parsed(spark, d):
    return parse_lines(_table(spark, d, "raw_files"), _table(spark, d, "raw_lines"))


def p5_found(spark, d):
    return _parsed(spark, d).where("reason is not null").select("raw_id", "line_no", "reason")


def p5_valid(spark, d):
    """The valid records, typed."""
    return _parsed(spark, d).where("reason is null").select("raw_id", "line_no", "x", "y", "z", "w", F.to_json("rest").alias("rest"))


def p5_numbers(spark, d):
    """The numbers of every valid record."""
    return _parsed(spark, d).where("reason is null").select("raw_id", "line_no", "x", "y", "z", "w")


def _faulty(spark, d, **how):
    return faulty(_table(spark, d, "soundings"), _table(spark, d, "xyz_sources"), **how)


def p4_unusual(spark, d):
    """Every sounding beyond the tail cutoff of its source, spikes among them."""
    return _faulty(spark, d, time="measured_at").where("unusual").select("sounding_id", "excursion", "cutoff", "spike")


def p4_faults(spark, d):
    """Every faulty sounding with its kinds of fault; these need no tail."""
    return _faulty(spark, d, risk=None).where("impossible or spike or stuck").select("sounding_id", "impossible", "spike", "stuck")


def p4_found(spark, d):
    return p4_faults(spark, d).select("sounding_id")


def p7_found(spark, d):
    marks = _table(spark, d, "spot_heights")
    near = near_pairs(marks, 100.0).select(F.lit("near").alias("kind"), F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    edges = materialize(regions(_table(spark, d, "inf_files")), "region-edges")
    held = inside(marks, edges).select(F.lit("inside").alias("kind"), F.col("id").alias("id_a"), F.col("region").alias("id_b"))
    return near.unionByName(held)


QUERIES = {"p2_found": p2_found, "p2_compacted": p2_compacted, "p2_files": p2_files, "p2_soundings": p2_soundings, "p2_small_files": p2_small_files, "p7_found": p7_found, "p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p4_faults": p4_faults, "p4_unusual": p4_unusual, "p5_found": p5_found, "p5_valid": p5_valid, "p5_numbers": p5_numbers}

SQL = {
    "p1_found": P1,
    "p2_found": P2,
    "p2_compacted": P2_COMPACTED,
    "p2_soundings": P2_SOUNDINGS,
    "p2_small_files": P2_SMALL_FILES,
    "p3_found": P3,
    "p4_found": P4,
    "p4_faults": P4_FAULTS,
    "p5_found": P5,
    "p5_numbers": P5_NUMBERS,
    "p7_found": P7,
}
