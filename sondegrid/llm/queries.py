"""Queries on documents, and of percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondegrid.llm.bpe import count_column, encode_column
from sondegrid.llm.packing import pack
from sondegrid.llm.quantiles import daily_percentiles
from sondegrid.llm.spans import shared_chars
from sondegrid.session import materialize


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _table(spark, d, "documents").select("doc_id", "text")


def p6_percentiles(spark, d):
    """Percentiles, least and greatest zpos of each data file; files without readings have null percentiles."""
    readings = _table(spark, d, "soundings").where("file_id is not null")  # others are in no file
    got = daily_percentiles(readings, "sounding_id", "file_id", "zpos", "loaded_at", [5, 25, 50, 75, 95])
    names = _table(spark, d, "inf_files").groupBy("file_id").agg(F.min("name").alias("name"))
    return names.join(got, "file_id", "left").select("file_id", "name", F.coalesce("n", F.lit(0)).alias("n"), "least", "greatest", "p05", "p25", "p50", "p75", "p95")


def p8_ids(spark, d):
    """Token ids of every document."""
    return encode_column(_docs(spark, d))


def p9_bins(spark, d):
    """Every text in containers of 2,048 tokens."""
    return pack(count_column(_docs(spark, d)), 2048)


def p9_loads(spark, d):
    """Every text in containers of 8,192, sized in characters: what went in, and whether any container is too full."""
    sizes = _docs(spark, d).select("doc_id", F.length("text").alias("n"))
    bins = materialize(pack(sizes, 8192, size_col="n"), "loads")
    load = bins.groupBy("bin").agg(F.sum("n").alias("load"), F.count("*").alias("pieces"))
    per = bins.groupBy("doc_id").agg(F.count("*").alias("pieces")).agg(F.count("*").alias("docs"), F.sum((F.col("pieces") > 1).cast("bigint")).alias("split"))
    total = load.agg(F.sum("load").alias("chars"), F.sum("pieces").alias("pieces"), F.sum((F.col("load") > 8192).cast("bigint")).alias("overfull"), (F.count("*") <= F.ceil(F.sum("load") / 8192 * 1.02) + 1).alias("tight"))
    return per.unionByName(total, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("docs", "split", "chars", "pieces", "overfull", "tight")])


def p10_found(spark, d):
    """Characters of each document in passages of 160 or more that another holds."""
    return shared_chars(_docs(spark, d))


def queries() -> dict:
    return {"p6_percentiles": p6_percentiles, "p8_ids": p8_ids, "p9_bins": p9_bins, "p9_loads": p9_loads, "p10_found": p10_found}


P6 = """
WITH once AS (SELECT DISTINCT sounding_id, file_id, zpos FROM soundings WHERE zpos IS NOT NULL AND NOT isnan(zpos) AND NOT isinf(zpos)),
ranked AS (SELECT file_id, zpos, row_number() OVER (PARTITION BY file_id ORDER BY zpos) AS r, count(*) OVER (PARTITION BY file_id) AS n FROM once),
got AS (SELECT file_id, max(n) AS n, min(zpos) AS least, max(zpos) AS greatest, max(CASE WHEN r = (n * 5 + 99) // 100 THEN zpos END) AS p05, max(CASE WHEN r = (n * 25 + 99) // 100 THEN zpos END) AS p25,
  max(CASE WHEN r = (n * 50 + 99) // 100 THEN zpos END) AS p50, max(CASE WHEN r = (n * 75 + 99) // 100 THEN zpos END) AS p75, max(CASE WHEN r = (n * 95 + 99) // 100 THEN zpos END) AS p95
  FROM ranked GROUP BY file_id),
names AS (SELECT file_id, min(name) AS name FROM inf_files GROUP BY file_id)
SELECT names.file_id, names.name, coalesce(got.n, 0) AS n, least, greatest, p05, p25, p50, p75, p95 FROM names LEFT JOIN got ON names.file_id = got.file_id
"""

P9_LOADS = """WITH d AS (SELECT length(text) AS n FROM documents WHERE length(text) > 0)
SELECT count(*) AS docs, CAST(sum(CASE WHEN n > 8192 THEN 1 ELSE 0 END) AS BIGINT) AS split, CAST(sum(n) AS BIGINT) AS chars, CAST(sum((n + 8191) // 8192) AS BIGINT) AS pieces, CAST(0 AS BIGINT) AS overfull, true AS tight FROM d"""

P10 = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 160),
w AS (SELECT doc_id, i, md5(substr(text, i, 160)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE h IN (SELECT h FROM s))
SELECT doc_id, CAST(sum(least(160, i - coalesce(p, i - 160))) AS BIGINT) AS shared_chars FROM f GROUP BY doc_id
"""


def oracle_sql() -> dict:
    """For percentiles, loads and passages: SQL has no byte-pair merges and no packing; tests/llm compares those with a library and brute force."""
    return {"p6_percentiles": P6, "p9_loads": P9_LOADS, "p10_found": P10}
