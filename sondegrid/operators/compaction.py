"""Far too many small files: a checkpointed streaming compactor.

A file source discovers each input file once (its log is in the checkpoint); the available ones are taken in batches, each
written by replacement under the number of its batch, so that a retried batch replaces what it wrote before. Rows are
rebalanced to well-sized files by the engine's advisory partition size. Small batches that follow one another, as from a
trickle of arrivals, are merged under the range of their numbers. A folder counts once it is complete, and no longer once a
complete folder covers its range, so a merge that is cut off neither loses nor doubles a record.

Files that only repeat another one's lines are found on the compacted records. Sets of lines are compared by their size and
two parities (bitwise exclusive or) of line hashes for equality, and, between different sets, by probing the rarest line of
each set for larger sets that hold it too; what is left is counted line by line. Where a rarest line is that of many sets and
held by many, the probe goes on to pairs, triples and so on of rarest lines, so that no such line multiplies its sets with
its holders. No set is ever gathered in one place.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sondegrid.session import materialize, shared_dir

BLANKS = " \t\r\n\f\x0b"
#: Bytes below which a batch is merged with its neighbours, up to about as many together.
SMALL = 64 << 20
#: Sets that ask by a line, times sets that hold it, beyond which the probe takes a further line.
PROBES = 100_000
_FOLDER = re.compile(r"batch=(\d+)(?:-(\d+))?")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def live(spark: SparkSession, target: str) -> list[tuple[int, int, str, int]]:
    """(first batch, last batch, folder, bytes) of the complete folders at ``target`` that no other covers, in order."""
    fs, path = _fs(spark, target)
    if not fs.exists(path):
        return []
    found = []
    for f in fs.listStatus(path):  # one entry a batch or merge
        if m := _FOLDER.fullmatch(f.getPath().getName()):
            where = f.getPath().toString()
            if fs.exists(_fs(spark, f"{where}/_SUCCESS")[1]):
                found.append((int(m[1]), int(m[2] or m[1]), where, fs.getContentSummary(f.getPath()).getLength()))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, int]] = []
    for x in found:
        if not out or x[1] > out[-1][1]:
            out.append(x)
    return out


def merge_small(spark: SparkSession, target: str, schema, small: int = SMALL) -> int:
    """Merges neighbouring small batches; returns the number of merges. May be cut off and run again at any time between batches."""
    groups: list[list[tuple[int, int, str, int]]] = [[]]
    for x in live(spark, target):
        if groups[-1] and (x[3] >= small or sum(y[3] for y in groups[-1]) >= small):
            groups.append([])
        groups[-1].append(x)
        if x[3] >= small:
            groups.append([])
    groups = [g for g in groups if len(g) > 1]
    for g in groups:
        rows = spark.read.schema(schema).parquet(*[x[2] for x in g])
        rows.hint("rebalance").write.mode("overwrite").parquet(f"{target}/batch={g[0][0]:012d}-{g[-1][1]:012d}")
    kept = {x[2] for x in live(spark, target)}
    fs, path = _fs(spark, target)
    for x in (x for g in groups for x in g):
        if x[2] not in kept:
            fs.delete(_fs(spark, x[2])[1], True)
    return len(groups)


def compact(spark: SparkSession, source: str, target: str, checkpoint: str, schema, files_per_batch: int = 1000, columns: list[str] | None = None, small: int = SMALL) -> DataFrame:
    """Consolidates the parquet files at ``source`` that haven't been taken yet; returns all records compacted so far.

    Run again with the same checkpoint it takes new files only, and repeats a batch that was cut off under the same number.
    An empty source gives no rows; rows are never dropped or changed."""
    source = source.rstrip("/")
    source = f"{source[:-1]}[{source[-1]}]"  # as a pattern, it may be a folder or a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if columns:
        stream = stream.select(*columns)
    kept = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.hint("rebalance").write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    merge_small(spark, target, kept, small)
    folders = [x[2] for x in live(spark, target)]
    return spark.read.schema(kept).parquet(*folders) if folders else spark.createDataFrame([], kept)


def data_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(raw_id, fetched_at, h) for each different data line of each file: beyond the file's skip, neither blank nor a comment."""
    f = files.where("raw_id is not null").groupBy("raw_id").agg(F.min(F.struct("fetched_at", "skip")).alias("f")).select("raw_id", "f.fetched_at", F.coalesce("f.skip", F.lit(0)).alias("skip"))
    text = F.btrim("line", F.lit(BLANKS))
    d = lines.select("raw_id", "line_no", text.alias("t")).where((F.col("t") != "") & ~F.startswith("t", F.lit("#")))
    return d.join(f, "raw_id").where("line_no > skip").select("raw_id", "fetched_at", F.xxhash64("t").alias("h")).distinct()


def _mixed(c: str, salt: int) -> Column:
    return F.xxhash64(F.col(c), F.lit(salt))


def redundant(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(raw_id) of files whose set of data lines another file's holds, which is larger or, being equal, was fetched earlier
    (of equal times the lesser raw_id; a null time is the latest).

    Null lines are blank; lines of no file and files without data lines count for nothing; rows that repeat a line change
    nothing; lines are compared whole, by 64-bit hashes; empty tables give no rows."""
    return redundant_sets(data_lines(lines, files))


def data_records(records: DataFrame, files: DataFrame, file: str, values: list[str], time: str) -> DataFrame:
    """(raw_id, fetched_at, h) for each different record of each file, for records that come in columns."""
    f = files.where(F.col(file).isNotNull()).groupBy(F.col(file).alias("raw_id")).agg(F.min(time).alias("fetched_at"))
    return records.select(F.col(file).alias("raw_id"), F.xxhash64(*[x for v in values for x in (F.col(v), F.col(v).isNull())]).alias("h")).join(f, "raw_id").select("raw_id", "fetched_at", "h").distinct()


def redundant_sets(sets_of: DataFrame, probes: int = PROBES) -> DataFrame:
    """As redundant, from a table (raw_id, fetched_at, h) of the different records of each file."""
    d = materialize(sets_of, "compact-lines")
    parity = lambda salt: F.bit_xor(_mixed("h", salt))
    sets = d.groupBy("raw_id").agg(F.count("*").alias("n"), parity(1).alias("s1"), parity(2).alias("s2"), F.first("fetched_at").alias("at"))
    at = F.coalesce(F.col("at"), F.to_timestamp(F.lit("9999-01-01 00:00:00")))
    sets = materialize(sets.select("raw_id", "n", "s1", "s2", at.alias("at")), "compact-sets")
    first = sets.groupBy("n", "s1", "s2").agg(F.min_by("raw_id", F.struct("at", "raw_id")).alias("raw_id"))
    equal = sets.join(first.select("raw_id"), "raw_id", "left_anti").select("raw_id")
    # one file for each different set
    own = d.join(first.select("raw_id", "n"), "raw_id").select("raw_id", "n", "h")
    often = own.groupBy("h").agg(F.count("*").alias("files"), F.max("n").alias("largest"))
    counted = materialize(own.join(often, "h").where("files > 1"), "compact-counted")
    # a set with a line of its own is in no other; its rarest line leads to the sets that may hold it
    probe = materialize(counted.groupBy("raw_id", "n").agg(F.count("*").alias("common"), F.min(F.struct("files", "h", "largest")).alias("r")).where("common = n and r.largest > n"), "compact-probes")
    alone = probe.where("n = 1").select("raw_id")
    asks = probe.where("n > 1").select(F.col("raw_id").alias("a"), F.col("n").alias("need"), F.col("r.h").alias("key"), F.struct("r.files", "r.h").alias("last"), F.col("r.files").alias("held"))
    pairs, contained = _candidates(asks, counted, probes)
    every = pairs.join(counted.select(F.col("raw_id").alias("a"), "h"), "a")
    held = every.join(counted.select(F.col("raw_id").alias("b"), "h"), ["b", "h"]).groupBy("a", "b", "need").agg(F.count("*").alias("got")).where("got = need")
    found = held.select("a").unionByName(contained).distinct()
    return equal.unionByName(alone).unionByName(found.select(F.col("a").alias("raw_id")))


def _candidates(asks: DataFrame, counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, need) of sets that share the rarest lines of a, and sets (a) that are found contained without a pair.

    A key stands for the rarest lines of the sets that ask by it. While a key has too many pairs, its sets take their next
    rarest line; a set without a further one is contained in every larger holder of its key."""
    holders = counted.select(F.col("h").alias("key"), F.col("raw_id").alias("b"), "n")
    own = counted.select(F.col("raw_id").alias("a"), F.struct("files", "h").alias("next"))
    pairs, contained = [], []
    while True:
        hot = asks.groupBy("key").agg(F.count("*").alias("sets"), F.first("held").alias("held")).where(F.col("sets") * F.col("held") > F.lit(most)).select("key")
        hot = materialize(hot, "compact-hot")
        pairs.append(asks.join(hot, "key", "left_anti").join(holders, "key").where("n > need").select("a", "b", "need"))
        if hot.isEmpty():
            break
        many = asks.join(hot, "key", "left_semi")
        onward = many.join(own, "a").where(F.col("next") > F.col("last")).groupBy("a").agg(F.min("next").alias("next"))
        many = materialize(many.join(onward, "a", "left"), "compact-asks")
        largest = holders.groupBy("key").agg(F.max("n").alias("n"))
        contained.append(many.where("next is null").join(largest, "key").where("n > need").select("a"))
        asks = many.where("next is not null").select("a", "need", F.xxhash64("key", "next.h").alias("key"), F.col("next").alias("last"), F.col("key").alias("before"), "next.h")
        wanted = asks.select("before", "h", "key").distinct()
        with_line = holders.withColumnRenamed("key", "before").join(hot.withColumnRenamed("key", "before"), "before", "left_semi").join(counted.select(F.col("raw_id").alias("b"), "h"), "b")
        holders = materialize(with_line.join(wanted, ["before", "h"]).select("key", "b", "n"), "compact-holders")
        asks = asks.select("a", "need", "key", "last").join(holders.groupBy("key").agg(F.count("*").alias("held")), "key")
    none = pairs[0].select("a").limit(0)
    return reduce(DataFrame.unionByName, pairs), reduce(DataFrame.unionByName, contained, none)


def landed(spark: SparkSession, path: str, columns: tuple[str, ...] = ("raw_id", "line_no", "line")) -> DataFrame:
    """The records at a path, compacted into a folder of the shared one. The folder and its checkpoint go by the path, so each
    of its files is taken once in an application, whatever queries ask for it."""
    root = f"{shared_dir(spark)}/compact-{hashlib.sha256(repr((path, columns)).encode()).hexdigest()[:24]}"
    schema = spark.read.parquet(path).schema
    return compact(spark, path, f"{root}/data", f"{root}/checkpoint", schema, columns=list(columns))


def without_redundant(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The lines of all files but the redundant ones, every record once."""
    return lines.join(redundant(lines, files), "raw_id", "left_anti")


def consolidate(spark: SparkSession, lines_path: str, files: DataFrame, target: str) -> DataFrame:
    """Writes every record of the files that don't only repeat another one's once to few well-sized files at ``target``, those
    of a file together, and returns what was written. Written by replacement, so it may be run again."""
    out = without_redundant(landed(spark, lines_path), files).hint("rebalance", "raw_id").sortWithinPartitions("raw_id", "line_no")
    out.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
