"""Exact percentiles without holding a group's values in one place.

Values are counted in narrow logarithmic cells, partially before the exchange; the running sums of a group's cells, bounded
in number whatever the rows, tell which cell holds a rank. Only the different values of those few cells are counted again,
and give the value of the rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sondegrid.functions.buckets import bucket

WIDTH = 1e-5


def order_statistics(df: DataFrame, groups: list[str], value: str | Column, ranks: Callable[[Column], Column] | DataFrame, width: float = WIDTH) -> DataFrame:
    """(groups, total, name, v): the values of ranks. ``ranks`` gives, for the number of values of a group, an array of structs
    (name, r), r from 1; or it is a table (groups, ranks) with such an array for each group.

    Null and NaN are no values; null group values are a group; a group without values has no row; ties are counted each."""
    v = (F.col(f"`{value}`") if isinstance(value, str) else value).cast("double")
    own = [F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(groups)]
    base = df.select(F.struct(*own, v.alias("v")).alias("_")).where(F.col("_.v").isNotNull() & ~F.isnan("_.v"))
    # one key of group and cell: a struct is never null, so the join is a plain one
    base = base.select(F.struct(*[F.col("_")[f"g{i}"].alias(f"g{i}") for i in range(len(groups))], bucket(F.col("_.v"), width).alias("cell")).alias("k"), F.col("_.v").alias("v"))
    w = Window.partitionBy(*([F.col("k")[f"g{i}"] for i in range(len(groups))] or [F.lit(0)]))
    cells = base.groupBy("k").agg(F.count("*").alias("m"))
    cells = cells.withColumn("upto", F.sum("m").over(w.orderBy(F.col("k")["cell"]).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("m").over(w))
    if isinstance(ranks, DataFrame):
        each = ranks.select(F.struct(*[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(groups)]).alias("_g"), F.col("ranks"))
        cells = cells.join(each, F.struct(*[F.col("k")[f"g{i}"].alias(f"g{i}") for i in range(len(groups))]) == F.col("_g"))
    hit = F.filter(F.col("ranks") if isinstance(ranks, DataFrame) else ranks(F.col("total")), lambda x: (x["r"] > F.col("upto") - F.col("m")) & (x["r"] <= F.col("upto")))
    asked = cells.withColumn("asked", hit).where(F.size("asked") > 0).select("k", (F.col("upto") - F.col("m")).alias("below"), "total", "asked")
    values = base.join(asked, "k").groupBy("k", "v").agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("below", "total", "asked")])
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = values.withColumn("upto", upto).select("k", "v", "n", "upto", "total", F.explode("asked").alias("a")).where((F.col("a.r") > F.col("upto") - F.col("n")) & (F.col("a.r") <= F.col("upto")))
    return found.select(*[F.col("k")[f"g{i}"].alias(c) for i, c in enumerate(groups)], "total", F.col("a.name").alias("name"), "v")


def percentiles(df: DataFrame, groups: list[str], value: str | Column, at: dict[str, float], width: float = WIDTH) -> DataFrame:
    """(groups, one column for each name in ``at``): exact percentiles (0..1), interpolated between neighbours. Without groups
    there is one row, of nulls if there are no values; otherwise as order_statistics."""

    def ranks(total: Column) -> Column:
        place = [(n, F.lit(p) * (total - 1)) for n, p in at.items()]
        return F.array(*[F.struct(F.lit(f"{n}:{end}").alias("name"), (f(x) + 1).cast("bigint").alias("r")) for n, x in place for end, f in (("lo", F.floor), ("hi", F.ceil))])

    found = order_statistics(df, groups, value, ranks, width)
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("v")))
    each = found.groupBy(*[F.col(f"`{c}`") for c in groups]).agg(F.max("total").alias("_total"), *[part(f"{n}:{e}").alias(f"_{n}:{e}") for n in at for e in ("lo", "hi")])
    out = []
    for n, p in at.items():
        place, lo, hi = F.lit(p) * (F.col("_total") - 1), F.col(f"`_{n}:lo`"), F.col(f"`_{n}:hi`")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(n))
    return each.select(*[F.col(f"`{c}`") for c in groups], *out)
