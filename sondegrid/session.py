"""Session factory and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "sondegrid", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; on a cluster the master comes from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one of our own where that is unset (tests, local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "sondegrid-shared")
    return root.rstrip("/") + "/sondegrid/" + spark.sparkContext.applicationId


def clean_up(spark: SparkSession) -> None:
    """Removes what this application wrote in the shared folder; results that read it are void then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a table written in the shared folder; it survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, name: str, most: int = 8 << 20) -> DataFrame:
    """A table for joining: computed once and measured; sent to all executors if it takes at most ``most`` bytes, else as it is.

    A row counts 16 bytes, and a value 16 and the length of its text (that of its JSON, if it is nested)."""
    df = materialize(df, name)
    text = {"string": F.octet_length, "binary": F.octet_length}
    plain = lambda kind: "<" not in kind
    long = [text[kind](f"`{c}`") if kind in text else F.length(F.to_json(F.struct(f"`{c}`"))) for c, kind in df.dtypes if kind in text or not plain(kind)]
    size = sum((F.coalesce(x, F.lit(0)) for x in long), F.lit(16 + 16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df
