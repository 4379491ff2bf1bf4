"""Writers: text of points, features, zone maps, grids, LAS."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sondegrid.grid import GridSpec


def xyz_text(*cols: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[c.cast("string") for c in cols])


def write_xyz(points: DataFrame, path: str, weight: bool = False, sep: str = " ") -> None:
    cols = [F.col(c) for c in ("x", "y", "z", *(["w"] if weight else []))]
    points.select(xyz_text(*cols, sep=sep).alias("value")).write.text(path)


def append_entry(spark, path: str, entry: tuple) -> None:
    """One more line of a datalist folder."""
    spark.createDataFrame([(" ".join(map(str, entry)),)], "value string").write.mode("append").text(path)


def tee(points: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Writes the points by group and goes on with what was written, so that the source is read once.

    The number of files goes by the bytes, not by the groups: a file holds many groups in order, so that who asks for a group reads
    its pages alone. A group lies in one file, or in the few that its share of a large exchange is cut into, which a hot group
    needs. A folder for each group would take a file for each, and its name would not keep the key: an empty text comes back as
    null, 01 as 1."""
    points.hint("rebalance", *by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    return points.sparkSession.read.schema(points.schema).parquet(path)


def point_feature(*coords: Column) -> Column:
    """A point feature as text."""
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), F.concat_ws(",", *[c.cast("string") for c in coords]), F.lit("]}}"))


def region_feature() -> Column:
    """Of rows with a box: a polygon feature as text."""
    pt = lambda x, y: F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]"))
    ring = F.concat_ws(",", pt("xmin", "ymin"), pt("xmin", "ymax"), pt("xmax", "ymax"), pt("xmax", "ymin"), pt("xmin", "ymin"))
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[['), ring, F.lit("]]}}"))


def inf_json() -> Column:
    """Of rows of a zone map: the side-car's text."""
    return F.to_json(F.struct("name", "numpts", F.array("xmin", "xmax", "ymin", "ymax", "zmin", "zmax").alias("minmax"), "wkt"))


def write_inf(inf: DataFrame, path: str) -> None:
    """Zone maps by file; those of the files in ``inf`` replace older ones."""
    spark = inf.sparkSession
    try:
        old = spark.read.parquet(path).join(inf.select("name"), "name", "left_anti")
        from sondegrid.session import materialize

        inf = inf.unionByName(materialize(old, "inf"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    inf.write.mode("overwrite").parquet(path)


def write_grid(cells: DataFrame, spec: GridSpec, path: str, tile: int = 256, tags: dict | None = None) -> None:
    """Cells by tile, with the grid's numbers and tags beside them."""
    t = cells.withColumn("tile", F.floor(F.col("row") / tile) * F.lit((spec.nx + tile - 1) // tile) + F.floor(F.col("col") / tile))
    t.repartitionByRange("tile").sortWithinPartitions("tile", "row", "col").write.mode("overwrite").parquet(f"{path}/cells")
    meta = json.loads(spec.to_json()) | {"tags": {"AREA_OR_POINT": "Point" if spec.registration == "node" else "Area"} | (tags or {})}
    cells.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/grid")


def read_grid(spark, path: str) -> tuple[DataFrame, GridSpec]:
    meta = json.loads(spark.read.text(f"{path}/grid").first()["value"])
    meta.pop("tags")
    return spark.read.parquet(f"{path}/cells").drop("tile"), GridSpec(**meta)


def grid_rows(cells: DataFrame, spec: GridSpec) -> DataFrame:
    """(row, line): the rows of an ASCII grid, north to south, sentinel where there is no data. A row must fit in memory."""
    full = spec.lattice(cells.sparkSession).join(cells, ["row", "col"], "left")
    v = F.coalesce(F.col("v").cast("string"), F.lit(f"{spec.ndv:g}"))
    return full.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", v.alias("v")))).alias("c")).select("row", F.array_join(F.transform("c", lambda x: x["v"]), " ").alias("line"))


def ascii_header(spec: GridSpec) -> list[str]:
    r = spec.region()
    return [f"ncols {spec.nx}", f"nrows {spec.ny}", f"xllcorner {r.xmin:.10g}", f"yllcorner {r.ymin:.10g}", f"cellsize {spec.dx:.10g}", f"NODATA_value {spec.ndv:g}"]


#: Sizes of the public header block and of a point record of formats 0 and 1 (fixed values).
HEADER, RECORD = 227, {0: 20, 1: 28}
#: Fields of a point record after its coordinates.
FIELDS = {"intensity": "<u2", "return_num": "u1", "classification": "u1", "scan_angle": "i1", "user_data": "u1", "point_source": "<u2", "gps_time": "<f8"}


def las_header(n: int, box: tuple[float, ...], returns: list[int], fmt: int = 1, scale=(1e-7, 1e-7, 1e-3), offset=(0.0, 0.0, 0.0)) -> bytes:
    """A version 1.1 header; box is xmin, xmax, ymin, ymax, zmin, zmax."""
    x0, x1, y0, y1, z0, z1 = box
    h = struct.pack("<4sHHLHH8sBB32s32sHHHLLBHL5L", b"LASF", 0, 0, 0, 0, 0, b"", 1, 1, b"sondegrid", b"sondegrid", 1, 2024, HEADER, HEADER, 0, fmt, RECORD[fmt], n, *returns)
    return h + struct.pack("<12d", *scale, *offset, x1, x0, y1, y0, z1, z0)


def las_holds(points: DataFrame, scale=(1e-7, 1e-7, 1e-3)) -> Column:
    """Whether a LAS file holds a point as it is: it knows no nulls, and a number must fit its field (of a return number, three bits)."""
    ok = F.lit(True)
    for c, s in zip("xyz", scale):
        ok &= F.abs(F.col(c) / F.lit(s)) <= F.lit(float(2**31 - 1))
    for c in [c for c in FIELDS if c in points.columns]:
        if c == "gps_time":
            ok &= F.col(c).isNotNull()
        else:
            kind = np.iinfo(FIELDS[c])
            ok &= F.col(c).between(int(kind.min), 7 if c == "return_num" else int(kind.max))
    return F.coalesce(ok, F.lit(False))


def _las_columns(points: DataFrame) -> list[str]:
    return ["x", "y", "z", *[c for c in FIELDS if c in points.columns]]


def _las_contents(batches: Iterator[pa.RecordBatch], cols: list[str], scale, most: int) -> Iterator[tuple[int, bytes]]:
    """Numbers of points and contents of LAS files with ``most`` points in each but the last."""
    rec = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), *FIELDS.items()])

    def pieces():
        t, n = [], 0
        for b in batches:
            while n + b.num_rows >= most:
                yield [*t, b.slice(0, most - n)]
                b, t, n = b.slice(most - n), [], 0
            if b.num_rows:
                t.append(b)
                n += b.num_rows
        if t:
            yield t

    for t in pieces():
        d = pa.Table.from_batches(t).to_pandas()
        a = np.zeros(len(d), rec)
        for c, s in zip("xyz", scale):
            a[c] = np.round(d[c] / s)
        for c in cols[3:]:
            a[c] = d[c]
        counts = [int((np.maximum(a["return_num"] & 7, 1) == k).sum()) for k in range(1, 6)]
        box = tuple(float(v) for c in "xyz" for v in (d[c].min(), d[c].max()))
        yield len(d), las_header(len(d), box, counts, 1, scale) + a.tobytes()


def las_files(points: DataFrame, scale=(1e-7, 1e-7, 1e-3), most: int = 1 << 18) -> DataFrame:
    """(n, content): LAS files, format 1, of the points of each partition, with ``most`` in each but the last; columns x, y, z and,
    where there are, those of the reader. Nothing comes to the driver. Points must be such as ``las_holds``."""
    cols = _las_columns(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, content in _las_contents(batches, cols, scale, most):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([content], pa.binary())], ["n", "content"])

    return points.select(*cols).mapInArrow(run, "n bigint, content binary")


def write_las(points: DataFrame, folder: str, scale=(1e-7, 1e-7, 1e-3), most: int = 1 << 18) -> int:
    """Writes the files of ``las_files`` into a folder as write_files does, without passing them through Spark; returns their number.
    They are named by partition and place in it: a retried task replaces its files, so a partition's points must keep their order."""
    cols = _las_columns(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for k, (_, content) in enumerate(_las_contents(batches, cols, scale, most), 1):
            _save(folder, f"{part}-{k}.las", content)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["n"])

    return points.select(*cols).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _save(folder: str, name: str, content: bytes) -> None:
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    aside = f"{root}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        f.write(content)
    fs.move(aside, f"{root}/{name}")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (name, content) as files of a folder on any file system that pyarrow knows; returns their number. Each is written
    aside and then moved, so a retried task replaces what it wrote."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _save(folder, name, content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return files.select("name", "content").mapInArrow(save, "n bigint").agg(F.sum("n")).first()[0] or 0
