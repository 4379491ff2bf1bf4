"""Grids, regions, jobs, files, plans."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sondegrid import sinks
from sondegrid.functions import scalars as S
from sondegrid.grid import GridSpec
from sondegrid.operators import algebra, cells, focal, interp, uncertainty, vector
from sondegrid.plans.modules import MODULES, FetchJob, GridJob
from sondegrid.region import Region, chunks
from sondegrid.sources import archive, catalog, datalist, las, xyz

MICRO = [(0.5, 9.5, 1.0, 1.0), (1.2, 9.1, 3.0, 2.0), (4.9, 5.1, -2.0, 1.0), (5.0, 5.0, 4.0, 1.0), (9.2, 9.5, 7.0, 1.0), (3.0, 0.5, 6.0, 1.0), (10.0, 5.0, 9.0, 1.0), (8.9, 1.1, 5.0, 4.0)]
SPEC = GridSpec.from_region(Region(0, 10, 0, 10), 2)


@pytest.fixture(scope="module")
def micro(spark):
    return spark.createDataFrame(MICRO, "x double, y double, z double, w double")


def test_binning(micro):
    assert (SPEC.nx, SPEC.ny) == (5, 5)
    r = {(x["row"], x["col"]): x["v"] for x in cells.mean(micro, SPEC).collect()}
    assert r == {(0, 0): 1.0, (0, 1): 3.0, (2, 2): -2.0, (3, 3): 4.0, (4, 4): 5.0}
    w = {(x["row"], x["col"]): (x["x"], x["y"], x["z"]) for x in cells.block(micro, SPEC, w="w", compat=True).collect()}
    assert w[(0, 1)] == (2.0, 10.0, 1.5) and w[(4, 4)] == (8.0, 2.0, 1.25)
    assert {x["v"] for x in cells.block(micro, SPEC, w="w").select(F.col("z").alias("v")).collect()} == {1.0, 3.0, -2.0, 4.0, 5.0}
    assert cells.dense(cells.count(micro, SPEC), SPEC, 0).agg(F.sum("v"), F.count("*")).first() == (5, 25)


def test_scalars(spark):
    assert Region(2, 6, 10, 20).center == (4, 15) and S.increment_name(0.00009259259) == "13"
    assert chunks(spark, Region(0, 10, 0, 10), 1, 4).count() == 9 and chunks(spark, Region(0, 8, 0, 8), 1, 4).count() == 4
    assert focal.windows(8, 8, 4, 4, spark).count() == 4 and focal.windows(10, 10, 4, 4, spark).count() == 9
    k = {(i, j): w for i, j, w in focal.gaussian_kernel(1)}
    assert round(k[0, 0], 6) == 0.331911 and round(k[0, 1], 6) == 0.122103 and round(k[1, 1], 6) == 0.044919
    assert Region.parse("-R-90/-89/29/30") == Region(-90, -89, 29, 30)
    d = spark.createDataFrame([(-122.0, 37.0)], "lon double, lat double")
    mx, my = S.mercator(F.col("lon"), F.col("lat"))
    back = d.select(*[c.alias(n) for c, n in zip(S.unmercator(mx, my), ("a", "b"))]).first()
    assert math.isclose(back["a"], -122.0) and math.isclose(back["b"], 37.0)


def test_split_keeps_or_drops_ties(spark):
    c = spark.createDataFrame([(0, 0, -1), (0, 1, 0), (0, 2, 2)], "row int, col int, v int")
    u, low = algebra.split(c, 0)
    assert (u.count(), low.count()) == (2, 1)
    u, low = algebra.split(c, 0, compat=True)
    assert (u.count(), low.count()) == (1, 1)


@given(st.lists(st.floats(-1, 1, allow_nan=False), min_size=4, max_size=4), st.lists(st.floats(-1, 1, allow_nan=False), min_size=4, max_size=4))
@settings(max_examples=100, deadline=None)
def test_regions_merge_and_reduce(a, b):
    mk = lambda v: Region(min(v[:2]), max(v[:2]), min(v[2:]), max(v[2:]))
    a, b = mk(a), mk(b)
    m, r = a.merge(b), a.reduce(b)
    assert m.merge(a) == m and m.reduce(a) == a and (not r.valid or (a.reduce(r) == r and b.reduce(r) == r))


def test_spec_round_trip_and_windows():
    assert GridSpec.from_json(SPEC.to_json()) == SPEC
    assert SPEC.srcwin(Region(-5, 5, 5, 15)) == (0, 0, 3, 3) and SPEC.cut(Region(2, 6, 2, 6)).nx == 2


def test_surfaces_reproduce_a_plane(spark):
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0.1, 9.9, 300), rng.uniform(0.1, 9.9, 300)
    spec = GridSpec.from_region(Region(0, 10, 0, 10), 0.5)
    col, row = np.floor(x / 0.5 + 0.5), np.floor((y - 10) / -0.5 + 0.5)
    p = spark.createDataFrame([(float(a), float(b), float(1 + 2 * c - r)) for a, b, c, r in zip(x, y, col, row)], "x double, y double, z double")
    for f in (interp.surface, interp.triangulate):
        e = f(p, spec, tile=8, halo=6).select(F.abs(F.col("v") - (1 + 2 * F.col("col") - F.col("row"))).alias("e")).agg(F.max("e"), F.count("*")).first()
        assert e[0] < 0.05 and e[1] > 330


def test_surfaces_cross_wide_gaps(spark):
    """Corners and centre of a grid many halos wide: every cell is there, and values are those of one tile over the whole grid."""
    spec = GridSpec(0.0, 100.0, 1.0, -1.0, 100, 100)
    at = [(1, 1, 0.0), (1, 98, 10.0), (98, 1, 20.0), (98, 98, 5.0), (50, 50, 40.0)]
    p = spark.createDataFrame([(float(c), 100.0 - r, z) for r, c, z in at], "x double, y double, z double")
    grid = lambda d: {(r["row"], r["col"]): r["v"] for r in d.collect()}
    got, whole = grid(interp.surface(p, spec, tile=25)), grid(interp.surface(p, spec, tile=128))
    assert len(got) == len(whole) == 10_000 and max(abs(got[k] - whole[k]) for k in whole) < 1.0
    assert all(abs(got[r, c] - z) < 1e-6 for r, c, z in at)
    got = grid(interp.triangulate(p, spec, tile=16))
    assert len(got) == 98 * 98 and all(abs(got[r, c] - z) < 1e-9 for r, c, z in at)
    one = grid(interp.triangulate(p, spec, tile=128))
    assert max(abs(got[k] - one[k]) for k in one) < 1e-9


def test_delaunay_is_empty_of_other_points():
    rng = np.random.default_rng(4)
    x, y = rng.random(60), rng.random(60)
    t = interp.delaunay(x, y)
    area = 0.5 * np.abs((x[t[:, 1]] - x[t[:, 0]]) * (y[t[:, 2]] - y[t[:, 0]]) - (x[t[:, 2]] - x[t[:, 0]]) * (y[t[:, 1]] - y[t[:, 0]]))
    h = vector.hull(np.column_stack([x, y]))
    whole = 0.5 * abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1)))
    assert abs(area.sum() - whole) < 1e-9
    # on a grid every point is a corner, and the triangles fill the hull, however they lie
    for seed in range(8):
        g = np.random.default_rng(seed)
        at = np.array(sorted({(int(a), int(b)) for a, b in g.integers(0, 20, (150, 2))} | {(0, 0), (19, 0), (0, 19), (19, 19)}))[:: g.choice([-1, 1])]
        x, y = at.T.astype(float)
        t = interp.delaunay(x, y)
        area = 0.5 * ((x[t[:, 1]] - x[t[:, 0]]) * (y[t[:, 2]] - y[t[:, 0]]) - (x[t[:, 2]] - x[t[:, 0]]) * (y[t[:, 1]] - y[t[:, 0]]))
        assert (area > 0).all() and abs(area.sum() - 19 * 19) < 1e-9 and set(t.ravel()) == set(range(len(x)))
    assert len(interp.delaunay(np.arange(5.0), np.arange(5.0))) == 0


def test_nearest_by_hand(spark):
    rng = np.random.default_rng(6)
    for reg, n, radius in (("node", 40, 3.2), ("pixel", 25, 4.0), ("node", 400, 2.5)):
        spec = GridSpec(0.0, 15.0, 1.0, -1.0, 20, 15, registration=reg)
        at = [(float(x), float(y), float(i % 7)) for i, (x, y) in enumerate(rng.uniform([0.01, 0.01], [19.9, 14.9], (n, 2)).round(1))]
        inner = [q for q in at if 0 <= np.floor(q[0] + spec.half) < 20 and 0 <= np.floor(15 - q[1] + spec.half) < 15 and 0 < q[0] < 20 and 0 < q[1] < 15]
        want = {}
        for r in range(15):
            for c in range(20):
                d = min((np.sqrt((x - c) ** 2 + (y - (15 - r)) ** 2), z) for x, y, z in inner)
                if d[0] <= radius:
                    want[r, c] = d[1]
        got = {(x["row"], x["col"]): x["v"] for x in interp.nearest(spark.createDataFrame(at, "x double, y double, z double"), spec, radius).collect()}
        # the window of cells reaches a cell less to the south and east
        assert set(got) <= set(want) and len(want) - len(got) <= 0.05 * len(want) and all(abs(want[q] - v) < 1e-9 for q, v in got.items())


def test_outlines_of_cells(spark):
    from sondegrid import geom

    art = ["####.", "#.##.", "####.", "....#", "#.#.#"]
    cells = [(r, c, 1) for r, line in enumerate(art) for c, x in enumerate(line) if x == "#"] + [(0, 9, 2), (1, 10, 2), (0, 9, 2)]
    spec = GridSpec(0.0, 5.0, 1.0, -1.0, 12, 5, registration="pixel")
    d = vector.polygonize(spark.createDataFrame(cells, "row int, col int, k int"), spec, ["k"])
    got = {r["k"]: r for r in d.withColumn("sum", F.aggregate(F.flatten("rings"), F.lit(0.0), lambda s, x: s + geom.signed_area(x))).collect()}
    # cells that meet at a corner only are polygons of their own; a hole stays within its shell
    assert (got[1]["polygons"], got[1]["holes"], got[1]["area"], got[1]["sum"]) == (4, 1, 15.0, 15.0)
    assert (got[2]["polygons"], got[2]["holes"], got[2]["area"]) == (2, 0, 2.0)
    assert got[2]["wkt"] == "MULTIPOLYGON (((10.0 4.0,10.0 5.0,9.0 5.0,9.0 4.0,10.0 4.0)),((11.0 3.0,11.0 4.0,10.0 4.0,10.0 3.0,11.0 3.0)))"
    # every cell is inside, every other place outside
    rings = [[[(q["x"], q["y"]) for q in ring] for ring in part] for part in got[1]["rings"]]
    for r in range(5):
        for c in range(5):
            n = sum((a[1] > 4.5 - r) != (b[1] > 4.5 - r) and c + 0.5 < a[0] + (4.5 - r - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for part in rings for ring in part for a, b in zip(ring, ring[1:]))
            assert (n % 2 == 1) == (art[r][c] == "#")


def test_outliers_iterated(spark):
    rng = np.random.default_rng(1)
    spec = GridSpec.from_region(Region(0, 12, 0, 12), 1)
    high = {(5, 5), (6, 5), (8, 2), (9, 2)}  # central differences don't see a single cell
    rows = [(r, c, float(rng.normal() + (80 if (r, c) in high else 0))) for r in range(12) for c in range(12)]
    d = spark.createDataFrame(rows, "row int, col int, v double")
    left = {(x["row"], x["col"]) for x in focal.outliers_iterated(d, spec, 6, 3).collect()}
    assert not high & left and len(left) > 120


def test_outliers_by_hand(spark):
    """Windows, gates and fences read off one after the other."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(23, 17)).round(2)
    for r, c, v in ((4, 3, 30), (5, 9, -25), (12, 9, 40), (20, 15, 60), (22, 2, 50)):
        a[r : r + 2, c] += v  # central differences don't see a single cell
    a[7, 7] = np.nan
    spec = GridSpec(0.0, 23.0, 1.0, -1.0, 17, 23)
    for n, step in ((10, 2), (8, 3), (30, 5)):
        gone = set()
        limit = np.nanstd(a)
        for r0 in range(0, max(23 - n, 0) + step, step) if n < 23 else [0]:
            for c0 in range(0, max(17 - n, 0) + step, step) if n < 17 else [0]:
                w = a[r0 : r0 + n, c0 : c0 + n].copy()
                while True:
                    g = np.gradient(w, axis=0)
                    if np.nanstd(w) < limit and np.nanstd(g) < limit:
                        break
                    out = np.ones(w.shape, bool)
                    for m in (w, g):
                        q1, q3 = np.nanpercentile(m, [25, 75])
                        out &= (m > q3 + 1.5 * (q3 - q1)) | (m < q1 - 1.5 * (q3 - q1))
                    if not out.any():
                        break
                    gone |= {(r0 + int(i), c0 + int(j)) for i, j in zip(*np.nonzero(out))}
                    w[out] = np.nan
        d = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(23) for j in range(17) if not np.isnan(a[i, j])], "row int, col int, v double")
        left = {(x["row"], x["col"]) for x in focal.outliers_iterated(d, spec, n, step).collect()}
        assert gone and left == {(i, j) for i in range(23) for j in range(17) if not np.isnan(a[i, j])} - gone


def test_lists_named_twice_and_in_circles(spark):
    rows = [("top", "a", -1, 2.0), ("top", "b", -1, 3.0), ("a", "c", -1, 1.0), ("b", "c", -1, 10.0), ("c", "x.xyz", 168, 1.0), ("c", "top", -1, 1.0), ("a", "y.xyz", 168, 1.0)]
    rows += [(f"d{i}", f"d{i + 1}", -1, 1.0) for i in range(40)] + [("top", "d0", -1, 1.0), ("d40", "deep.xyz", 168, 0.5)]
    got = sorted((r["path"], r["weight"], r["depth"]) for r in datalist.walk(spark.createDataFrame(rows, "parent string, path string, fmt int, weight double"), "top").collect())
    assert got == [("deep.xyz", 0.5, 42), ("x.xyz", 2.0, 3), ("x.xyz", 30.0, 3), ("y.xyz", 2.0, 2)]


def test_error_curve_bins(spark):
    rng = np.random.default_rng(5)
    x, e = rng.uniform(1, 30, 4000), rng.normal(size=4000)
    got = uncertainty.error_curve(spark.createDataFrame([(float(a), float(b * 0.3 * a**0.6)) for a, b in zip(x, e)], "distance double, error double"))
    assert abs(got[1] * 16 ** got[2] + got[0] - 0.3 * 16**0.6) < 0.1
    few = spark.createDataFrame([(1.0, 0.5), (2.0, -0.5), (2.0, 0.5)], "distance double, error double")
    assert len(uncertainty.error_curve(few)) == 3 and uncertainty.error_curve(few.limit(0)) == uncertainty.GUESS


def test_error_fit():
    x = np.linspace(0.5, 20, 10)
    c0, c1, c2 = uncertainty.fit_power(x, 0.3 * x**0.6)
    assert abs(c0) < 0.05 and abs(c1 - 0.3) < 0.05 and abs(c2 - 0.6) < 0.05
    assert sorted(uncertainty.sort_apart([(i, 0.0) for i in range(9)], 9, 1)) == list(range(9))


def test_modules_and_jobs(spark, micro):
    job = GridJob("num", Region(0, 10, 0, 10), 2, extend_proc=0, options={"mode": "m"})
    assert GridJob.from_json(job.to_json()) == job and job.run(micro)["dem"].count() == 5
    smooth = GridJob("num", Region(0, 10, 0, 10), 2, extend_proc=0, options={"mode": "m"}, blur=1, split=0.0)
    assert smooth.run(micro)["dem"].count() == 5
    assert GridJob("num", Region(0, 10, 0, 10), 2, extend_proc=0, sample=1.0, options={"mode": "m"}).run(micro)["dem"].count() > 5
    assert {"surface", "triangulate", "nearest", "num", "IDW", "invdst", "average", "linear", "mbgrid", "composite", "vdatum", "spat-meta", "coastline", "landmask", "uncertainty"} == set(MODULES)
    with pytest.raises(ValueError):
        MODULES["vdatum"](micro, SPEC)
    c = spark.createDataFrame([("a", "1", "x/y.xyz,z.txt", "nos", 0.0, 1.0, 0.0, 1.0), ("b", "2", "q.bag", "dc", 5.0, 6.0, 5.0, 6.0)], "Name string, ID string, DataLink string, DataSource string, xmin double, xmax double, ymin double, ymax double")
    f = FetchJob(Region(0.5, 2, 0.5, 2), ("Name = 'a'",), {"nos": []})
    assert FetchJob.from_json(f.to_json()) == f and [r["url"] for r in f.urls(c).collect()] == ["x/y.xyz"]


def test_las_pruning_and_types(spark, tmp_path):
    p = spark.createDataFrame([(float(i), 1.0, float(-i), 2 + 27 * (i % 2)) for i in range(10)], "x double, y double, z double, classification int")
    for i, r in enumerate(sinks.las_files(p.repartition(2)).collect()):
        (tmp_path / f"{i}.las").write_bytes(r["content"])
    las.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    d = spark.read.format("las").load(str(tmp_path))
    assert d.count() == 10 and d.where("classification = 29").count() == 5 and d.where("x >= 4 and z > -8").count() == 4
    assert d.where("x > 100").count() == 0
    assert spark.read.format("las").load(f"file://{tmp_path}/*.las").count() == 10 and sum(spark.read.format("las").load(f"{tmp_path}/{i}.las").count() for i in (0, 1)) == 10


def test_las_files_are_of_bounded_size_and_replaced(spark, tmp_path):
    las.register(spark)
    for rows, most, sizes in ((10, 4, [4, 4, 2]), (8, 4, [4, 4]), (3, 4, [3]), (25_000, 12_345, [12_345, 12_345, 310]), (0, 4, [])):
        p = spark.range(rows).selectExpr("cast(id % 100 as double) x", "1.0D y", "cast(id as double) z", "cast(id % 5 as int) classification").coalesce(1).sortWithinPartitions("z")
        folder = tmp_path / f"{rows}"
        for _ in range(2):  # as a retry does
            assert sinks.write_las(p, f"file://{folder}", most=most) == len(sizes)
        assert sorted((f.stat().st_size - sinks.HEADER) // sinks.RECORD[1] for f in folder.glob("*")) == sorted(sizes)
        got = spark.read.format("las").load(str(folder)).select(F.round("x").alias("x"), F.round("z").alias("z"), "classification").collect()
        assert sorted((r["z"], r["x"], r["classification"]) for r in got) == [(float(i), float(i % 100), i % 5) for i in range(rows)]
        assert [r["n"] for r in sinks.las_files(p, most=most).collect()] == sizes


def test_las_is_read_whole_after_a_filter_and_less_by_options(spark, tmp_path):
    for name, x in (("a", 1), ("b", 9)):
        header = sinks.las_header(1, (float(x), float(x), 0.0, 0.0, 0.0, 0.0), [1, 0, 0, 0, 0], scale=(1.0, 1.0, 1.0))
        (tmp_path / f"{name}.las").write_bytes(header + np.array([x, 0, 0], "<i4").tobytes() + bytes([0, 0, 0, x, 0, 0, 0, 0]) + b"\0" * 8)
    las.register(spark)
    read = lambda **o: [r["x"] for r in spark.read.format("las").options(**o).load(str(tmp_path)).orderBy("x").collect()]
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        for pushed in ("true", "false"):
            spark.conf.set(key, pushed)
            d = spark.read.format("las").load(str(tmp_path))
            assert [r["x"] for r in d.where("x < 5").collect()] == [1.0] and d.count() == 2
            assert read(classes="9") == [9.0] and read(classes="1,9", xmin=1.0, xmax=9.0) == [1.0, 9.0] and read(xmin=1.5, zmax=0) == [9.0]
    finally:
        spark.conf.set(key, before)
    (tmp_path / "b.las").write_bytes(header)  # no points: an error to whoever reads it
    assert read(xmax=5) == [1.0]


def test_las_later_formats(spark, tmp_path):
    import struct

    n = 7
    for fmt in range(11):
        kind = las.FORMATS[fmt]
        width = kind.itemsize + {2: 6, 3: 6, 4: 29, 5: 35, 7: 6, 8: 8, 9: 29, 10: 37}.get(fmt, 0)
        a = np.zeros(n, kind)
        a["x"], a["z"], a["c"], a["r"] = np.arange(n) * 1000, -np.arange(n), 2, 9
        body = b"".join(r.tobytes() + b"\xff" * (width - kind.itemsize) for r in a)
        raw = bytearray(sinks.las_header(n, (0.0, 1.0, 0.0, 0.0, -1.0, 0.0), [n, 0, 0, 0, 0], 1, (1e-3, 1e-3, 1e-3)))
        struct.pack_into("<BH", raw, 104, fmt, width)
        if fmt > 5:  # a header of version 1.4, whose older count is 0
            raw += b"\0" * (375 - len(raw))
            struct.pack_into("<BB", raw, 24, 1, 4)
            struct.pack_into("<HL", raw, 94, 375, 375)
            struct.pack_into("<L", raw, 107, 0)
            struct.pack_into("<Q", raw, 247, n)
        (tmp_path / f"{fmt}.las").write_bytes(bytes(raw) + body)
    las.register(spark)
    got = spark.read.format("las").load(str(tmp_path)).collect()
    assert len(got) == 11 * n and {(r["x"], round(r["z"], 3), r["classification"]) for r in got} == {(float(i), round(-i / 1000, 3), 2) for i in range(n)}
    assert {r["path"].rsplit("/", 1)[-1]: r["return_num"] for r in got} == {f"{f}.las": 9 if f > 5 else 1 for f in range(11)}


def test_text_archives_and_lists(spark, tmp_path):
    import gzip
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("p.xyz", "1 2 3\n4,5,6\nbad\n")
        z.writestr("n.txt", "1 2 3")
    (tmp_path / "b.xyz.gz").write_bytes(gzip.compress(b"7/8/9\n"))
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    assert sorted((r["x"], r["z"], r["w"]) for r in archive.archive_points(spark, f"file://{tmp_path}/*", 2.0).collect()) == [(1.0, 3.0, 2.0), (4.0, 6.0, 2.0), (7.0, 9.0, 2.0)]
    (tmp_path / "c.xyz").write_text("x y z\n1 2 3\n2 3 4\n")
    assert xyz.read_xyz(spark, f"file://{tmp_path}/c.xyz", xyz.XyzConfig(skip=2)).count() == 1
    assert sorted(r["fmt"] for r in datalist.list_files(spark, f"file://{tmp_path}").collect()) == [-2, -2, -2, 168]
    e = datalist.parse_entries(spark.createDataFrame([("a.xyz",), ("b 168 2 m,n o",), ("# x",), ("c x 1",), ("nos:datatype=xyz",), ("",)], "line string"))
    assert sorted((r["path"], r["fmt"], r["weight"], tuple(r["meta"] or ())) for r in e.collect()) == [("a.xyz", 168, 1.0, ()), ("b", 168, 2.0, ("m", "n o")), ("nos:datatype=xyz", -4, 1.0, ())]
    sinks.append_entry(spark, f"file://{tmp_path}/dl", ("a.xyz", 168, 1))
    sinks.append_entry(spark, f"file://{tmp_path}/dl", ("b.xyz", 168, 1))
    assert spark.read.text(f"file://{tmp_path}/dl").count() == 2


def test_tee_has_files_by_size_and_keeps_keys(spark, tmp_path):
    key = F.when(F.col("id") % 50 == 0, F.lit("")).when(F.col("id") % 50 == 1, F.lit("01")).when(F.col("id") % 50 > 2, (F.col("id") % 401).cast("string"))
    d = spark.range(0, 12000, 1, 6).select("id", key.alias("k"), (F.col("id") % 3).alias("j"))
    t = sinks.tee(d, f"file://{tmp_path}/tee", ["k", "j"])
    assert t.dtypes == d.dtypes and t.exceptAll(d).count() == d.exceptAll(t).count() == 0
    assert len(list((tmp_path / "tee").rglob("*.parquet"))) <= 8  # of over a thousand groups
    at = t.select("k", "j", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    of = at.groupBy("k", "j").agg(F.countDistinct("f").alias("files"), F.count("*").alias("n"), (F.max("n") - F.min("n") + 1).alias("span"))
    assert of.count() > 1000 and of.where("files > 1 or n <> span").isEmpty()  # each in one file, together


def test_zone_maps_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/inf"
    sinks.write_inf(spark.createDataFrame([("a", 1), ("b", 2)], "name string, numpts int"), path)
    sinks.write_inf(spark.createDataFrame([("b", 5), ("c", 6)], "name string, numpts int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 5), ("c", 6)]


def test_service_answers(spark, tmp_path):
    xml = """<m xmlns:g='u'><g:MD_DataIdentification><g:citation><g:title>T</g:title><g:CI_Date><g:date>2019-03</g:date></g:CI_Date></g:citation><g:abstract>A</g:abstract></g:MD_DataIdentification>
    <g:EX_GeographicBoundingBox><g:westBoundLongitude>-1</g:westBoundLongitude><g:eastBoundLongitude>2</g:eastBoundLongitude><g:southBoundLatitude>3</g:southBoundLatitude><g:northBoundLatitude>4</g:northBoundLatitude></g:EX_GeographicBoundingBox></m>"""
    r = catalog.iso_metadata(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (r["title"], r["xmin"], r["ymax"], r["date"], r["abstract"]) == ("T", -1.0, 4.0, "2019", "A")
    ways, nodes = catalog.overpass(spark.createDataFrame([('{"elements":[{"type":"way","id":1,"nodes":[3,2]},{"type":"node","id":2,"lon":1.5,"lat":2.5}]}',)], "json string"))
    assert ways.first()["nodes"] == [3, 2] and nodes.first()["lat"] == 2.5
    (tmp_path / "x").write_bytes(b"data")
    f = catalog.fetch_all(spark.createDataFrame([(f"file://{tmp_path}/x",), (f"file://{tmp_path}/y",)], "url string")).collect()
    assert sorted(r["ok"] for r in f) == [False, True]
    assert catalog.wcs_contents(spark.createDataFrame([("<a><CoverageSummary><CoverageId>c1</CoverageId></CoverageSummary></a>",)], "xml string")).first()["coverage"] == "c1"
    assert catalog.empty_catalog(spark).dtypes[2] == ("Date", "int")


def test_plans_have_no_nested_loops(spark, sf):
    from sondegrid.queries import queries

    for name in ("jn01_point_raster_lookup", "jn06_entry_region", "jn07_catalog_filter", "jn12_bucket_join", "gr05_idw", "ag02_grid_mean", "p7_found"):
        plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    plan = queries()["ag02_grid_mean"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "l_comment" not in plan


def test_components_of_a_snake(spark):
    path = [(0, c) for c in range(9)] + [(1, 8)] + [(2, c) for c in range(9)] + [(3, 0)] + [(4, c) for c in range(9)]
    d = spark.createDataFrame([(r, c, 1) for r, c in path] + [(1, 0, 2)], "row int, col int, v int")
    assert vector.components(d).groupBy("label").count().orderBy("count").select("count").collect()[0][0] == 1
    assert vector.components(d).select("label").distinct().count() == 2


def test_streaming_extension(spark, tmp_path):
    from sondegrid.streaming.points import grid_counts, hourly

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xyz").write_text("0.5 9.5 1\n1.2 9.1 3\nx\n")
    s = grid_counts(spark.readStream.text(f"file://{tmp_path}/in"), SPEC)
    qy = s.writeStream.format("memory").queryName("grid_counts").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    qy.awaitTermination()
    assert sorted((r["row"], r["col"], r["n"]) for r in spark.table("grid_counts").collect()) == [(0, 0, 1), (0, 1, 1)]
    ev = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parque[t]")
    qy = hourly(ev).writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp2").trigger(availableNow=True).start()
    qy.awaitTermination()
    assert spark.table("hourly").columns == ["start", "event_type", "n"]


def test_command_line(spark, tmp_path, capsys):
    from sondegrid import cli

    (tmp_path / "p.xyz").write_text("0.5 9.5 1\n1.2 9.1 3\n4.9 5.1 -2\n")
    (tmp_path / "l.datalist").write_text(f"file://{tmp_path}/p.xyz 168 1 a,b\n")
    cli.main(["grid", "-M", "num:mode=m", "-R", "0/10/0/10", "-E", "2", "-O", f"file://{tmp_path}/g", f"file://{tmp_path}/p.xyz"])
    c, s = sinks.read_grid(spark, f"file://{tmp_path}/g/dem")
    assert c.count() == 3 and s.nx == 5
    cli.main(["tool", "split", f"file://{tmp_path}/g/dem", "-O", f"file://{tmp_path}/s"])
    assert sinks.read_grid(spark, f"file://{tmp_path}/s/lower")[0].count() == 1
    for what in ("crop", "chunk", "points"):
        cli.main(["tool", what, f"file://{tmp_path}/g/dem", "-V", "2", "-O", f"file://{tmp_path}/{what}"])
    cli.main(["tool", "cut", f"file://{tmp_path}/g/dem", "-R", "0/6/4/10", "-O", f"file://{tmp_path}/cut"])
    cli.main(["tool", "query", f"file://{tmp_path}/g/dem", f"file://{tmp_path}/p.xyz", "-O", f"file://{tmp_path}/q"])
    assert spark.read.text(f"file://{tmp_path}/q").count() == 3
    capsys.readouterr()
    for flag in (["--list"], ["--inf"], []):
        cli.main(["datalists", f"file://{tmp_path}/l.datalist", *flag])
    out = capsys.readouterr().out
    assert f"file://{tmp_path}/p.xyz 168 1.0 a,b" in out and "0.5 9.5 1.0" in out
    cli.main(["grid", "--save-config"])
    assert '"module": "num"' in capsys.readouterr().out
    assert cli.options("IDW:power=2:x=1.5:b=true:c=none:d=t") == ("IDW", {"power": 2, "x": 1.5, "b": True, "c": None, "d": "t"})


def test_hull_of_groups(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(a), float(b)) for g in (1, 2) for a, b in rng.normal(size=(400, 2)).round(1)] + [(3, 1.0, 1.0), (4, 0.0, 0.0), (4, 1.0, 1.0), (4, 2.0, 2.0), (None, 0.0, 0.0), (5, None, 1.0)]
    got = {r["k"]: r["wkt"] for r in vector.convex_hull(spark.createDataFrame(rows, "k int, x double, y double"), ["k"]).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for g in (1, 2):
        h = vector.hull(np.array([r[1:] for r in rows if r[0] == g]))
        corners = [tuple(map(float, p.split())) for p in got[g][10:-2].split(",")[:-1]]
        assert sorted(corners) == sorted(map(tuple, h.tolist()))


@pytest.mark.parametrize("most", [7, 1 << 17])
def test_hulls_of_many_groups_are_made_together(spark, most):
    rng = np.random.default_rng(3)
    keys = [(k, s) for k in (None, float("nan"), -1.5, 0.0, *map(float, range(9))) for s in (None, "a", "b")]
    rows = [(*k, float(a), float(b)) for k in dict.fromkeys(keys) for a, b in rng.integers(0, 12, (int(rng.integers(1, 90)), 2))]
    rows += [(99.0, "none", None, 1.0), (99.0, "none", float("nan"), 1.0), (98.0, "one", None, 1.0), (98.0, "one", 2.0, 3.0)]
    rng.shuffle(order := list(range(len(rows))))
    d = spark.createDataFrame([rows[i] for i in order], "k double, s string, x double, y double").repartition(3)
    h = vector.convex_hull(d, ["k", "s"], empty=True, most=most)
    assert "FlatMapGroups" not in h._jdf.queryExecution().toString()  # no call for each group
    name = lambda k, s: (repr(k), s)
    got = {name(r["k"], r["s"]): r for r in h.collect()}
    want = {}
    for k, s, x, y in rows:
        want.setdefault(name(k, s), []).extend([(x, y)] if x is not None and x == x else [])
    assert set(got) == set(want) and (got[name(99.0, "none")]["corners"], got[name(99.0, "none")]["wkt"]) == (0, None)
    for k, p in want.items():
        c = [tuple(map(float, v.split())) for v in got[k]["wkt"][10:-2].split(",")] if p else []
        assert c[:-1] == (list(map(tuple, vector.hull(np.array(p)).tolist())) if p else []) and len(c[:-1]) == got[k]["corners"]


def test_hulls_by_nested_keys(spark):
    rows = [((g % 3, [g % 2]), float(g), float(g * g)) for g in range(60)]
    h = vector.convex_hull(spark.createDataFrame(rows, "k struct<a: int, b: array<int>>, x double, y double"), ["k"], most=8)
    assert sorted((r["k"]["a"], r["k"]["b"][0], r["corners"]) for r in h.collect()) == [(a, b, 10) for a in range(3) for b in range(2)]


def test_report_numbers_with_exponents(spark):
    d = spark.createDataFrame([(1, "Minimum Depth: -1.5e+3 Maximum Depth: 2E2"), (1, "Number of Records: 12")], "f int, line string")
    r = catalog.mb_inf(d, ["f"]).first()
    assert (r["zmin"], r["zmax"], r["numpts"]) == (-200.0, 1500.0, 12)


def test_zones_and_held_out_cells(spark):
    t = spark.createDataFrame([(i, 0, float(i), float(10 - i)) for i in range(10)] + [(10, 0, 3.0, None)], "trow int, tcol int, density double, slope double")
    z = uncertainty.slope_zones(t, 2.0, 7.0)
    assert {r["slope"]: r["slope_zone"] for r in z.collect()} == {None: None} | {float(v): "low-slp" if v <= 2 else "mid-slp" if v < 7 else "high-slp" for v in range(1, 11)}
    got = sorted((r["slope_zone"], r["slope"]) for r in uncertainty.training(z, 2, zone="slope_zone", by="slope").collect())
    assert got == [("high-slp", 7.0), ("high-slp", 8.0), ("low-slp", 1.0), ("mid-slp", 3.0), ("mid-slp", 4.0)]
    c = spark.createDataFrame([(i % 3, i, 2 * (i % 3)) for i in range(30)], "tile int, pid int, keep int")
    a, b = ({r["pid"] for r in uncertainty.hold_out(c, ["tile"], s).collect()} for s in (1, 2))
    assert a != b and [sum(i % 3 == k for i in a) for k in range(3)] == [10, 8, 6] and a == {r["pid"] for r in uncertainty.hold_out(c, ["tile"], 1).collect()}


def test_uncertainty_grids_again_with_its_module(spark, monkeypatch):
    """The error is of the module asked for: gridded once with all data and once for each split sample."""
    rng = np.random.default_rng(2)
    spec = GridSpec(0.0, 20.0, 1.0, -1.0, 20, 20)
    p = spark.createDataFrame([(float(x), float(y), float(x * y)) for x, y in rng.uniform(1, 19, (60, 2))], "x double, y double, z double")
    sizes = []

    def probe(q, s, **_):
        sizes.append(q.count())
        return {"dem": interp.nearest(q, s, 8.0)}

    monkeypatch.setitem(MODULES, "probe", probe)
    v = MODULES["uncertainty"](p, spec, module="probe", sims=2)["dem"].agg(F.count("v"), F.min("v"), F.max("v")).first()
    assert len(sizes) >= 2 and max(sizes[1:]) < sizes[0]
    assert v[0] == 400 and v[1] >= 0 and v[2] > 0
