"""Percentiles of very large columns from signed logarithmic buckets.

A value belongs to the bucket of its sign and of the logarithm of its size, to a fixed relative width; zero has a bucket of
its own. A sketch is a table (group, day, bucket, n, lo, hi). Sketches of partitions or days are written to storage and
combined by adding up the counts of equal buckets; nothing else is needed, and no order matters. A percentile is the value
at either end of the bucket that holds its rank: it occurs among the values, and differs from the exact percentile by no
more than the relative width. A group has a bounded number of buckets, whatever its rows: with the default width 23,000 for
each power of ten and sign.

``exact`` reads again only the values in buckets that hold an asked rank and several different values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sondegrid.functions.buckets import bucket
from sondegrid.operators.ranks import order_statistics
from sondegrid.session import checked_broadcast, materialize

#: Relative width of a bucket.
WIDTH = 1e-4
#: Rows of a group beyond which each of its buckets is spread over several tasks.
HOT = 1 << 20
#: Bytes of the keys of buckets to look up again that are sent to all executors; more are joined by shuffle.
KEYS = 32 << 20


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def sketch(df: DataFrame, groups: list[str], value: str, width: float = WIDTH) -> DataFrame:
    """(groups, bucket, n, lo, hi) of the finite values; null, NaN and infinite ones are left out."""
    v = F.col(f"`{value}`").cast("double")
    return df.where(_finite(v)).groupBy(*groups, bucket(v, width).alias("bucket")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def combine(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches added up by coarser groups."""
    return sketches.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _daily(df: DataFrame, id_col: str, group: str, value: str, loaded: str, width: float, hot: int) -> DataFrame:
    v = F.col(f"`{value}`").cast("double")
    d = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group}`").alias("g"), v.alias("v"), F.col(f"`{loaded}`").alias("at")).where(_finite(F.col("v")))
    many = df.groupBy(F.col(f"`{group}`").alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") > F.lit(hot))
    d = d.join(checked_broadcast(many, "hot-groups"), F.col("g").eqNullSafe(F.col("_g")), "left").withColumn("bucket", bucket(F.col("v"), width))
    d = d.withColumn("salt", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / F.lit(hot)))).otherwise(F.lit(0)).cast("int"))
    once = d.repartition("g", "bucket", "salt").groupBy("g", "bucket", "salt", "id", "v").agg(F.min("at").alias("at"))
    days = once.groupBy("g", "bucket", "salt", F.to_date("at").alias("day")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return days.select("g", "day", "bucket", "n", "lo", "hi")


def daily_sketches(df: DataFrame, id_col: str, group: str, value: str, loaded: str, width: float = WIDTH, hot: int = HOT) -> DataFrame:
    """(group, day, bucket, n, lo, hi), the day being that of the first load of a row.

    Rows that repeat (id, group, value) count once. They share their bucket, so one exchange by group and bucket both removes
    them and adds up the sketches of the days. Groups of more than ``hot`` rows are counted first; their buckets are spread by
    a salt of the id, so that no hot bucket falls to one task, and may come in several rows of a day."""
    return _daily(df, id_col, group, value, loaded, width, hot).withColumnRenamed("g", group)


def located(sketches: DataFrame, groups: list[str], percents: list[int]) -> DataFrame:
    """(groups, n, least, greatest, p, r, bucket, below, held, lo, hi): for each percent p the rank ceil(p n / 100) and the bucket
    that holds it, with the number of values below the bucket and in it. Sketches of the groups are combined here."""
    s = combine(sketches, groups)
    w = Window.partitionBy(*(groups or [F.lit(0)]))
    s = s.withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumns({"total": F.sum("n").over(w), "least": F.min("lo").over(w), "greatest": F.max("hi").over(w)})
    ranks = F.array(*[F.struct(F.lit(p).alias("p"), F.floor((F.col("total") * F.lit(p) + F.lit(99)) / F.lit(100)).cast("bigint").alias("r")) for p in percents])
    s = s.select(*groups, "bucket", "n", "lo", "hi", "upto", "total", "least", "greatest", F.explode(ranks).alias("a")).where((F.col("a.r") > F.col("upto") - F.col("n")) & (F.col("a.r") <= F.col("upto")))
    return s.select(*groups, F.col("total").alias("n"), "least", "greatest", F.col("a.p").alias("p"), F.col("a.r").alias("r"), "bucket", (F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("held"), "lo", "hi")


def _table(found: DataFrame, groups: list[str], percents: list[int]) -> DataFrame:
    return found.groupBy(*groups).agg(F.max("n").alias("n"), F.max("least").alias("least"), F.max("greatest").alias("greatest"), *[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p:02d}") for p in percents])


def percentiles(sketches: DataFrame, groups: list[str], percents: list[int]) -> DataFrame:
    """(groups, n, least, greatest, p05 ...): for each percent p the value of rank ceil(p n / 100), to the relative width of the
    sketches. Null group values are a group; groups without values have no row; an empty table gives none."""
    at = located(sketches, groups, percents)
    nearer = F.when((F.col("r") - F.col("below")) * 2 <= F.col("held"), F.col("lo")).otherwise(F.col("hi"))
    return _table(at.withColumn("v", nearer), groups, percents)


def daily_percentiles(df: DataFrame, id_col: str, group: str, value: str, loaded: str, percents: list[int], width: float = WIDTH, hot: int = HOT, exact: bool = True) -> DataFrame:
    """(group, n, least, greatest, p..) from sketches per day, written to storage and combined from there.

    Rows that repeat (id, group, value) count once. Without ``exact`` values are within the relative width; with it, a bucket
    that holds a rank and several values is looked up again among the rows."""
    stored = materialize(_daily(df, id_col, group, value, loaded, width, hot), "day-sketches")
    if not exact:
        return percentiles(stored, ["g"], percents).withColumnRenamed("g", group)
    at = materialize(located(stored, ["g"], percents), "ranks")
    rank = F.struct(F.col("p").cast("string").alias("name"), (F.col("r") - F.col("below")).alias("r"))
    asked = at.where("lo < hi").groupBy("g", "bucket").agg(F.collect_list(rank).alias("ranks"))
    keys = checked_broadcast(asked.select(F.col("g").alias("_g"), F.col("bucket").alias("_b")), "asked-buckets", KEYS)
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(_finite(F.col("v"))).withColumn("bucket", bucket(F.col("v"), width))
    # such rows are few beside the group's, but unbounded in number, so they aren't ordered in one place
    near = rows.join(keys, F.col("g").eqNullSafe(F.col("_g")) & (F.col("bucket") == F.col("_b")), "left_semi").distinct().select(F.struct("g", "bucket").alias("k"), "v")
    asked = asked.select(F.struct("g", "bucket").alias("k"), "ranks")
    inner = order_statistics(near, ["k"], "v", asked, width=width * 1e-4)
    inner = inner.select(F.col("k")["g"].alias("g"), F.col("name").cast("int").alias("p"), F.col("v").alias("found"))
    found = at.join(inner, at["g"].eqNullSafe(inner["g"]) & (at["p"] == inner["p"]), "left").select(at["g"], "n", "least", "greatest", at["p"], F.coalesce("found", "lo").alias("v"))
    return _table(found, ["g"], percents).withColumnRenamed("g", group)
