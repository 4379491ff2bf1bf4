"""Archives of data files: members become rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def members(archives: DataFrame, suffixes: list[str]) -> DataFrame:
    """(path, member, content) of (path, content): members of zip and gz files with one of the suffixes; a plain file passes
    if its own suffix is one; what can't be opened gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                ok = lambda n: n.rsplit(".", 1)[-1].lower() in suffixes
                name = path.rsplit("/", 1)[-1]
                try:
                    if name.endswith(".zip"):
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            out += [(path, n, z.read(n)) for n in z.namelist() if ok(n)]
                    elif name.endswith(".gz"):
                        if ok(name[:-3]):
                            out.append((path, name[:-3], gzip.decompress(content)))
                    elif ok(name):
                        out.append((path, name, content))
                except (zipfile.BadZipFile, OSError, EOFError):
                    continue
            yield pd.DataFrame(out, columns=["path", "member", "content"])

    return archives.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def archive_points(spark: SparkSession, path: str, weight: float | None = None, suffixes=("xyz", "csv", "dat", "ascii")) -> DataFrame:
    """Points of all text members of the archives at a path, with the archive's weight."""
    from sondegrid.sources.xyz import parse_xyz

    m = members(spark.read.format("binaryFile").load(path), list(suffixes))
    lines = m.select("path", "member", F.explode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("line"))
    p = parse_xyz(lines)
    return p if weight is None else p.withColumn("w", F.lit(float(weight)))
