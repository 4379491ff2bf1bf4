"""LAS files (point formats 0 to 10): a data source that reads shares of files as Arrow batches.

The driver only lists files and their sizes; each task opens its file, reads the header, and takes its share of the points.
Paths may be of any file system that pyarrow knows."""

from __future__ import annotations

import fnmatch
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fields of the public header block (fixed values): name, struct code, number.
HEADER_FIELDS = [
    ("filesig", "4s", 1), ("filesourceid", "H", 1), ("reserved", "H", 1), ("guid1", "L", 1), ("guid2", "H", 1), ("guid3", "H", 1), ("guid4", "8s", 1),
    ("vermajor", "B", 1), ("verminor", "B", 1), ("sysid", "32s", 1), ("gensoftware", "32s", 1), ("fileday", "H", 1), ("fileyear", "H", 1),
    ("headersize", "H", 1), ("offset", "L", 1), ("numvlrecords", "L", 1), ("pointformat", "B", 1), ("pointreclen", "H", 1), ("numptrecords", "L", 1),
    ("numptbyreturn", "5L", 5), ("xscale", "d", 1), ("yscale", "d", 1), ("zscale", "d", 1), ("xoffset", "d", 1), ("yoffset", "d", 1), ("zoffset", "d", 1),
    ("xmax", "d", 1), ("xmin", "d", 1), ("ymax", "d", 1), ("ymin", "d", 1), ("zmax", "d", 1), ("zmin", "d", 1),
]
_HEADER = struct.Struct("<" + "".join(code for _, code, _ in HEADER_FIELDS))
_VLR = struct.Struct("<H16sHH32s")
BASE = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("i", "<u2"), ("r", "u1"), ("c", "u1"), ("s", "i1"), ("u", "u1"), ("p", "<u2")]
LATER = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("i", "<u2"), ("r", "u1"), ("f", "u1"), ("c", "u1"), ("u", "u1"), ("s", "<i2"), ("p", "<u2"), ("g", "<f8")]
#: The leading fields of each point format; what follows them (colours, wave packets) is passed over.
FORMATS = {0: np.dtype(BASE), 1: np.dtype([*BASE, ("g", "<f8")]), 2: np.dtype(BASE)} | dict.fromkeys((3, 4, 5), np.dtype([*BASE, ("g", "<f8")])) | dict.fromkeys(range(6, 11), np.dtype(LATER))
SCHEMA = "x double, y double, z double, intensity int, return_num int, classification int, scan_angle int, user_data int, point_source int, gps_time double, path string"
SHARE = 32 << 20  # bytes of a partition
_COUNT = struct.Struct("<Q")  # number of points, at byte 247 of headers from version 1.4 on


def is_las(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"LASF")


def parse_header(raw: bytes) -> dict:
    if len(raw) < _HEADER.size or raw[:4] != b"LASF":
        raise ValueError("no LAS file")
    values, out = list(_HEADER.unpack(raw[: _HEADER.size])), {}
    for name, _, n in HEADER_FIELDS:
        out[name] = values.pop(0) if n == 1 else [values.pop(0) for _ in range(n)]
    return out


def parse_vlrs(raw: bytes, header: dict) -> list[dict]:
    """Headers and payloads of the variable length records."""
    at, out = header["headersize"], []
    for _ in range(header["numvlrecords"]):
        reserved, user, record, size, text = _VLR.unpack(raw[at : at + _VLR.size])
        at += _VLR.size
        out.append({"userid": user.rstrip(b"\0").decode("latin-1"), "recordid": record, "desc": text.rstrip(b"\0").decode("latin-1"), "data": raw[at : at + size]})
        at += size
    return out


def _open(path: str):
    from pyarrow import fs as pafs  # in the tasks only: it starts threads

    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def listed(path: str) -> list[tuple[str, int]]:
    """(path with its scheme, size) of the files at a path: a folder, of which those named *.las count, a pattern, or one file."""
    from pyarrow import fs as pafs

    path = path if "://" in path else f"file://{path.removeprefix('file:')}"
    fs, name = pafs.FileSystem.from_uri(path.split("*")[0].split("?")[0].split("[")[0])
    prefix = path[: path.index(name)]
    whole, pattern = path[len(prefix) :], name != path[len(prefix) :]
    if pattern:
        name = name.rpartition("/")[0]
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        found = [f for f in fs.get_file_info(pafs.FileSelector(name, allow_not_found=True, recursive=True)) if f.type == pafs.FileType.File]
        found = [f for f in found if (fnmatch.fnmatch(f.path, whole) if pattern else f.path.lower().endswith(".las"))]
    return sorted((prefix + f.path, f.size) for f in found)


class LasShare(InputPartition):
    def __init__(self, path: str, k: int, n: int):
        self.path, self.k, self.n = path, k, n  # the k-th of n shares


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.lo, self.hi = ({c: float(options[c + end]) for c in "xyz" if options.get(c + end)} for end in ("min", "max"))
        self.classes = [int(c) for c in options["classes"].split(",")] if options.get("classes") else None

    def partitions(self):
        return [LasShare(p, k, n) for p, size in listed(self.path) for n in [max(1, -(-size // SHARE))] for k in range(n)] or [LasShare("", 0, 1)]

    def read(self, part):
        if not part.path:
            return
        with _open(part.path) as f:
            first = f.read(375)
            h = parse_header(first)
            if any(h[f"{c}max"] < v for c, v in self.lo.items()) or any(h[f"{c}min"] > v for c, v in self.hi.items()):
                return
            if (form := h["pointformat"] & 63) not in FORMATS:
                raise ValueError(f"unknown point format {form} in {part.path}")
            n = h["numptrecords"]
            if (h["vermajor"], h["verminor"]) >= (1, 4) and h["headersize"] >= 375:
                n = _COUNT.unpack_from(first, 247)[0] or n
            kind, width = FORMATS[form], h["pointreclen"]
            begin, end = n * part.k // part.n, n * (part.k + 1) // part.n
            f.seek(h["offset"] + begin * width)
            raw = np.frombuffer(f.read((end - begin) * width), np.uint8).reshape(end - begin, width)[:, : kind.itemsize]
        if not len(raw):
            return
        a = np.ascontiguousarray(raw).view(kind)[:, 0]
        keep = np.ones(len(a), bool)
        xyz = {}
        for c in "xyz":
            xyz[c] = a[c] * h[f"{c}scale"] + h[f"{c}offset"]
            if c in self.lo:
                keep &= xyz[c] >= self.lo[c]
            if c in self.hi:
                keep &= xyz[c] <= self.hi[c]
        if self.classes is not None:
            keep &= np.isin(a["c"], self.classes)
        a = a[keep]
        whole = lambda v: pa.array(v.astype(np.int32))
        gps = pa.array(a["g"]) if "g" in kind.names else pa.nulls(len(a), pa.float64())
        cols = [pa.array(xyz[c][keep]) for c in "xyz"] + [whole(a["i"]), whole(a["r"] & (15 if form > 5 else 7)), whole(a["c"]), whole(a["s"]), whole(a["u"]), whole(a["p"]), gps, pa.array([part.path] * len(a), pa.string())]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])


class LasSource(DataSource):
    """spark.read.format("las").load(path)

    The options xmin, xmax, ymin, ymax, zmin, zmax (bounds that count as inside) and classes ("2,29") keep other points from
    Spark; files whose header excludes them aren't read. Filters are not pushed: a session rejects a reader that takes them
    unless it is set to, and Spark reads a table again as it was filtered before, so d.count() after d.where() would lose rows."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LasReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)
