"""The operators of problems 1 to 5 and 7 on small cases, and against brute force on the small tables."""

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings, strategies as st

from sondegrid.operators import compaction, lineparse, packed, proximity, spikes, units

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- 1: packed fields ------------------------------------------------------------------------------------------------
def by_hand(s):
    """The rule read character by character."""
    out, i, n = [], 0, len(s)
    while True:
        while i < n and s[i] == " ":
            i += 1
        done = False
        if i < n and s[i] in "\"'":
            q, j, v = s[i], i + 1, ""
            while j < n:
                if s[j] == q and s[j + 1 : j + 2] == q:
                    v, j = v + q, j + 2
                elif s[j] == q:
                    k = j + 1
                    while k < n and s[k] == " ":
                        k += 1
                    if k == n or s[k] in ",;|\t":
                        out.append(v)
                        i, done = k, True
                    break
                else:
                    v, j = v + s[j], j + 1
        if not done:
            k = i
            while k < n and s[k] not in ",;|\t":
                k += 1
            out.append(s[i:k].rstrip(" "))
            i = k
        if i >= n:
            return out
        i += 1


@given(st.text(alphabet="ab ,;|\t\"'\0", max_size=24))
@settings(max_examples=400, deadline=None)
def test_parse_as_by_hand(s):
    assert packed.parse(s) == by_hand(s)
    first = packed.dialects(s)[0]
    assert (first[2], first[3]) == (by_hand(s), 0)


def test_packed_cases(spark):
    rows = [(1, 'a, "b; c" |d', 0), (1, 'a, "b; c" |d', 1), (2, None, 0), (3, "   ", 0), (4, "x,", 0), (5, "'it''s';\"\"", 0), (None, "q", 0), (6, "z" * 100_000 + "," + " " * 50_000 + "y", 0)]
    df = spark.createDataFrame(rows, "entry_id bigint, metadata string, val int")
    r = got(packed.split_packed(df, "entry_id", "metadata"))
    assert [x for x in r if x[0] == 1] == [(1, 1, "a"), (1, 2, "b; c"), (1, 3, "d")]
    assert [x for x in r if x[0] in (2, 3)] == []
    assert [x for x in r if x[0] == 4] == [(4, 1, "x"), (4, 2, "")]
    assert [x for x in r if x[0] == 5] == [(5, 1, "it's"), (5, 2, "")]
    assert (None, 1, "q") in r
    assert [len(x[2]) for x in r if x[0] == 6] == [100_000, 1]
    assert got(packed.split_packed(df.limit(0), "entry_id", "metadata")) == []


def test_code_lengths_decide(spark):
    # two apostrophes that happen to enclose a whole list: the widest dialect reads one quoted value, which is right only
    # as long as the pieces are no known values
    odd = "'Tis,bag,WGS84,MLLW,NAVD88,sounding,'"
    split = lambda rows, **how: [x[2] for x in got(packed.split_packed(spark.createDataFrame(rows, "entry_id bigint, metadata string"), "entry_id", "metadata", **how)) if x[0] == 99]
    known = [(i, f"bag,WGS84,MLLW,NAVD88,sounding,n{i}") for i in range(40)]
    unknown = [(i, f"grab{i},n{i}") for i in range(40)]
    assert split([*unknown, (99, odd)]) == [odd[1:-1]]
    assert split([*known, (99, odd)]) == ["'Tis", "bag", "WGS84", "MLLW", "NAVD88", "sounding", "'"]
    assert split([*known, (99, odd)], escape_bits=1000.0) == [odd[1:-1]]
    # a combination that many fields hold is a word of its own only if standing characters are free
    both = [(i, f"x{i},a{i} | Sand;Gravel") for i in range(40)] + [(99, "y,Sand;Gravel")]
    assert split(both) == ["y", "Sand", "Gravel"]


def test_pruned_dialects_as_all_dialects(spark):
    """Against scoring every dialect of every field."""
    rng = random.Random(12)
    words = ["a", "b c", "Sand;Gravel", "x,y", "u|v", "NOAA", "1,2,3", "it's", "'Tis", '"q', "", "long unique "]
    fields = set()
    while len(fields) < 400:
        n = rng.randint(1, 5)
        vals = [w + (str(rng.randint(0, 999)) if w.startswith("long") else "") for w in rng.choices(words, k=n)]
        vals = [f'"{v}"' if rng.random() < 0.35 else v for v in vals]
        fields.add(vals[0] + "".join(rng.choice([",", ";", "|", " , "]) + v for v in vals[1:]))
    fields = sorted(f for f in fields if f.strip())
    count = {}
    for f in fields:
        for v in set(packed.parse(f)):
            count[v] = count.get(v, 0) + 1
    total = sum(count.values())
    spelt = lambda v: 8.0 * (len(v) + 1)
    bits = {v: min(spelt(v), math.log2(total / n) + spelt(v) / n) for v, n in count.items() if n > 1}
    for charge in (0.0, 16.0):
        want = {}
        for k, f in enumerate(fields):
            scored = [(round(sum(bits.get(v, spelt(v)) for v in vals) + left * charge, 6), -len(d), -len(q), i, vals) for i, (d, q, vals, left) in enumerate(packed.dialects(f))]
            want[k] = min(scored)[4]
        r = {}
        for k, _, v in sorted(got(packed.split_packed(spark.createDataFrame([*enumerate(fields)], "entry_id bigint, metadata string"), "entry_id", "metadata", escape_bits=charge)), key=lambda x: x[:2]):
            r.setdefault(k, []).append(v)
        assert r == want
        assert charge or any(want[k] != packed.parse(f) for k, f in enumerate(fields))


def test_fields_count_once_however_often_repeated(spark):
    rows = [(i, "Hazel Sound,sand") for i in range(300)] + [(1000 + i, f"n{i},sand") for i in range(5)]
    r = got(packed.split_packed(spark.createDataFrame(rows, "entry_id bigint, metadata string"), "entry_id", "metadata"))
    assert [x[2] for x in r if x[0] == 7] == ["Hazel Sound", "sand"] and len(r) == 610


# --- 2: small files --------------------------------------------------------------------------------------------------
FILES = "raw_id bigint, file_name string, fmt int, delim string, skip int, cols string, fetched_at timestamp"


def file(i, at=0, skip=0):
    return (i, "f", 168, ",", skip, "x,y,z", None if at is None else T0 + dt.timedelta(seconds=at))


def test_redundant_cases(spark):
    text = {1: ["a", "b"], 2: [" b ", "a", "# note"], 3: ["a", "b", "c"], 4: ["c"], 5: [], 6: ["#x"], 7: ["head", "z"], 8: ["z"], 9: ["u"], 10: ["u"], 11: [None, "w"]}
    skip = {7: 1}
    files = spark.createDataFrame([file(i, {9: None}.get(i, i), skip.get(i, 0)) for i in text], FILES)
    lines = spark.createDataFrame([(i, n + 1, t, "x") for i, ls in text.items() for n, t in enumerate(ls)], "raw_id bigint, line_no int, line string, h string")
    # 1 and 2 are in 3; 4 is in 3; 8 equals 7 and is later; 9 has no time, so 10 is the earlier
    assert got(compaction.redundant(lines, files)) == [(1,), (2,), (4,), (8,), (9,)]
    assert got(compaction.redundant(lines.limit(0), files)) == []
    kept = compaction.without_redundant(lines, files)
    assert {r["raw_id"] for r in kept.collect()} == {3, 6, 7, 10, 11}


def test_redundant_random(spark):
    rng = random.Random(3)
    sets = {i: {rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))} for i in range(120)}
    files = spark.createDataFrame([file(i, i) for i in sets], FILES)
    lines = spark.createDataFrame([(i, n + 1, t) for i, s in sets.items() for n, t in enumerate(sorted(s))], "raw_id bigint, line_no int, line string")
    want = sorted((i,) for i, s in sets.items() if any(s <= o and (s != o or j < i) for j, o in sets.items() if j != i))
    assert sorted(got(compaction.redundant(lines, files))) == want
    d = compaction.data_lines(lines, files)
    for probes in (0, 50):
        assert sorted(got(compaction.redundant_sets(d, probes))) == want


def test_redundant_sets_with_one_rarest_line(spark):
    # 400 sets whose rarest line is the same: their probes go on to further lines instead of meeting each other
    sets = {i: {0, 10_000 + i // 2, 20_000 + i // 4, 30_000 + i % 3} for i in range(400)} | {1000 + i: {0, 10_000 + i, 20_000 + i // 2, 30_000, 30_001, 30_002, 5} for i in range(0, 100, 7)}
    rows = [(i, T0 + dt.timedelta(seconds=i), h) for i, s in sets.items() for h in s]
    want = sorted((i,) for i, s in sets.items() if any(s <= o and (s != o or j < i) for j, o in sets.items() if j != i))
    assert sorted(got(compaction.redundant_sets(spark.createDataFrame(rows, "raw_id bigint, fetched_at timestamp, h bigint"), 100))) == want


def test_small_batches_are_merged(spark, tmp_path):
    src, out, cp = (f"file://{tmp_path}/{n}" for n in ("src", "out", "cp"))
    schema = "raw_id bigint, line_no int, line string"
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).selectExpr("id AS raw_id", "cast(id as int) AS line_no", "string(id) AS line").coalesce(1).write.mode("append").parquet(src)
        r = compaction.compact(spark, src, out, cp, schema)
        assert (r.count(), r.distinct().count()) == (10 * k + 10,) * 2
    assert [x[:2] for x in compaction.live(spark, out)] == [(0, 4)] and len(r.inputFiles()) == 1
    # a merge that was cut off: without its sign of completion it counts for nothing, and is made again
    import os

    os.remove(f"{tmp_path}/out/batch=000000000000-000000000004/_SUCCESS")
    assert compaction.live(spark, out) == []
    os.rename(f"{tmp_path}/out/batch=000000000000-000000000004", f"{tmp_path}/out/batch=000000000000-000000000003")
    open(f"{tmp_path}/out/batch=000000000000-000000000003/_SUCCESS", "w").close()
    spark.range(50, 60).selectExpr("id AS raw_id", "cast(id as int) AS line_no", "string(id) AS line").write.parquet(f"{out}/batch=000000000004")
    assert compaction.compact(spark, src, out, cp, schema, small=0).count() == 60
    assert compaction.compact(spark, src, out, cp, schema).count() == 60 and [x[:2] for x in compaction.live(spark, out)] == [(0, 4)]
    # a folder that a complete merge covers no longer counts, should its removal have been cut off
    spark.range(3).selectExpr("id AS raw_id", "1 AS line_no", "'x' AS line").write.parquet(f"{out}/batch=000000000002")
    assert compaction.compact(spark, src, out, cp, schema).count() == 60


def test_compactor_resumes_without_repeats(spark, tmp_path):
    src, out, cp = (f"file://{tmp_path}/{n}" for n in ("src", "out", "cp"))
    write = lambda a, b: spark.range(a, b).selectExpr("id AS raw_id", "cast(id as int) AS line_no", "string(id) AS line").repartition(7).write.mode("append").parquet(src)
    write(0, 100)
    schema = "raw_id bigint, line_no int, line string"
    assert compaction.compact(spark, src, out, cp, schema, files_per_batch=3).count() == 100
    write(100, 130)
    r = compaction.compact(spark, src, out, cp, schema, files_per_batch=3)
    assert (r.count(), r.distinct().count()) == (130, 130)
    # a batch that was cut off after writing, before its commit, is written again in its place
    import glob
    import os

    last = max(glob.glob(f"{tmp_path}/cp/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    r = compaction.compact(spark, src, out, cp, schema, files_per_batch=3)
    assert (r.count(), r.distinct().count()) == (130, 130)


# --- 3: units --------------------------------------------------------------------------------------------------------
MARKS = "mark_id bigint, xpos double, zpos double, h_unc double, z_scale string, epsg string, vdatum string, hdatum string, unit string"
CODES = [(4326, "horizontal", "degree", None), (2263, "horizontal", "us_foot", None), (5703, "vertical", "metre", "up"), (8051, "vertical", "foot", "down")]


def test_units_cases(spark):
    u = spark.createDataFrame(CODES, "epsg int, axis string, unit string, positive string")
    m = lambda i, z, h, s=None, e=None, v=None, hd=None: (i, 0.0, z, h, s, e, v, hd, "x")
    rows = [
        m(1, 10.0, 1.0, "-0,1", "EPSG:4326+8051", "MLLW (fathoms, depth)", "NAD83, cm"),
        m(2, 10.0, 1.0, "", "EPSG:4326+8051", "mllw:us_ft:sounding", "WGS84"),
        m(3, 10.0, 1.0, None, "2263,8051", "NAVD88", None),
        m(4, 10.0, 1.0, "survey ft (US) up", "x", None, "NAD27 (US survey feet)"),
        m(5, 10.0, 1.0, "1200/3937"),
        m(6, None, 1.0), m(7, 1.0, math.nan), m(8, math.inf, 1.0),
        m(9, 10.0, 1.0, "centimetrs"), m(10, 10.0, 1.0, "dpeth"), m(10, 10.0, 1.0, "dpeth"),
        m(11, 10.0, 1.0, "positive up [Feet]"),
    ]
    r = {x[0]: x[1:] for x in units.to_millimetres(spark.createDataFrame(rows, MARKS), u).collect()}
    assert r[1] == (-1000, 10)
    assert r[2] == (round(-10 * 1200 / 3937 * 1000), 1000)
    assert r[3] == (-3048, round(1200 / 3937 * 1000))
    assert r[4] == (round(10 * 1200 / 3937 * 1000), round(1200 / 3937 * 1000))
    assert r[5] == (round(10 * 1200 / 3937 * 1000), 1000)
    assert not {6, 7, 8} & set(r)
    assert r[9] == (100, 1000) and r[10] == (-10_000, 1000) and r[11] == (3048, 1000)
    assert units.to_millimetres(spark.createDataFrame(rows, MARKS).limit(0), u).count() == 0


def test_distance():
    assert units.distance("meter", "metre") == 0.5 and units.distance("foot", "feet") == 1.0 and units.distance("fathom", "fathoms") == 1.0
    assert units.unlikeness("up feet", "us feet") is None and units.unlikeness("m", "mm") is None


def test_no_accepted_spelling_is_left_out_by_the_index(spark):
    rng = random.Random(8)
    aliases = [r["alias"] for r in units.lexicon(spark).collect()]
    spelt = set()
    while len(spelt) < 3000:
        a = rng.choice([x for x in aliases if len(x) > 4])
        w = list(a)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w))
            kind = rng.randrange(4)
            if kind == 0 and i:
                w[i - 1], w[i] = w[i], w[i - 1]
            elif kind == 1:
                w[i] = rng.choice("aeioumtr")
            elif kind == 2 and len(w) > 3:
                del w[i]
            else:
                w.insert(i, w[i])
        t = "".join(w)
        if " " not in t.strip() and t not in aliases and any(units.unlikeness(t, x) is not None for x in aliases):
            spelt.add(t)
    d = {r["text"] for r in units.alias_dictionary(spark.createDataFrame([(t,) for t in spelt], "t string"), "t").collect()}
    assert d == spelt


def test_units_of_huge_values(spark):
    u = spark.createDataFrame(CODES, "epsg int, axis string, unit string, positive string")
    m = spark.createDataFrame([(1, 0.0, 1e15, 1e300, "1", None, None, None, "x")], MARKS)
    assert got(units.to_millimetres(m, u)) == [(1, 10**18, None)]


# --- 4: spikes -------------------------------------------------------------------------------------------------------
SOUND = "sounding_id bigint, file_id bigint, source_id int, line_no int, zpos double, z double"
SRC = "source_id int, lower_limit double, upper_limit double"


def series(values, file=1, source=1, start=0):
    return [(start + i, file, source, i + 1, v, 0.0) for i, v in enumerate(values)]


def brute(rows, limits):
    import numpy as np

    rows = sorted({r[:5] for r in rows if r[4] is not None and not math.isnan(r[4])}, key=lambda r: (r[1], r[3]))
    diffs, lens, runs = {}, {}, []
    for k, r in enumerate(rows):
        if k and rows[k - 1][1] == r[1]:
            diffs.setdefault(r[2], []).append(abs(r[4] - rows[k - 1][4]))
        if k and rows[k - 1][1] == r[1] and rows[k - 1][4] == r[4]:
            runs[-1].append(k)
        else:
            runs.append([k])
    for run in runs:
        lens.setdefault(rows[run[0]][2], []).append(len(run))
    q = {s: np.quantile(v, 0.75, method="inverted_cdf") for s, v in diffs.items()}
    u = {s: np.quantile(v, 0.95, method="inverted_cdf") for s, v in lens.items()}
    bad = set()
    for run in runs:
        s = rows[run[0]][2]
        if len(run) >= 10 and len(run) > 3 * u[s]:
            bad |= {rows[k][0] for k in run}
    for k, r in enumerate(rows):
        lo, hi = limits.get(r[2], (None, None))
        lo, hi = (hi, lo) if lo is not None and hi is not None and lo > hi else (lo, hi)
        if not -11000 <= r[4] <= 9000 or (lo is not None and r[4] <= lo) or (hi is not None and r[4] >= hi):
            bad.add(r[0])
        for n in (1, 2, 3):
            if k and k + n < len(rows) and rows[k - 1][1] == rows[k + n][1]:
                z = [x[4] for x in rows[k : k + n]]
                a, b, t = rows[k - 1][4], rows[k + n][4], 8 * q[r[2]]
                if min(z) - max(a, b) > t or min(a, b) - max(z) > t:
                    bad |= {x[0] for x in rows[k : k + n]}
    return bad


@pytest.mark.parametrize("chunk", [1 << 16, 16, 5])
def test_spikes_across_chunks(spark, chunk):
    rng = random.Random(5)
    v = [-50 + math.sin(i / 9) + rng.uniform(-0.5, 0.5) for i in range(400)]
    for i, n in ((14, 1), (15, 3), (31, 2), (100, 3), (159, 2), (320, 1)):
        for k in range(n):
            v[i + k] += 60
    v[200:245] = [-51.25] * 45
    v[47] = v[48] = None
    v[60], v[61] = math.nan, 20000.0
    rows = series(v) + series([-49 + rng.uniform(-0.5, 0.5) for _ in range(90)], 2, 1, 1000) + series([5.0, 5.1, 99.0, 5.2, 5.1] * 6, 3, 2, 2000)
    rows += rows[:20] + rows[210:230]  # delivered again
    limits = {1: (10.0, -200.0)}
    src = spark.createDataFrame([(1, 10.0, -200.0), (2, None, None), (3, 0.0, 1.0)], SRC)
    r = spikes.faulty(spark.createDataFrame(rows, SOUND), src, chunk=chunk)
    assert {x["sounding_id"] for x in r.where("impossible or spike or stuck").collect()} == brute(rows, limits)


def test_spikes_without_rows_or_sources(spark):
    df = spark.createDataFrame(series([1.0, 2.0, None, math.inf, 1.5]), SOUND)
    none = spark.createDataFrame([], SRC)
    assert spikes.faulty(df.limit(0), none).count() == 0
    r = spikes.faulty(df, none).collect()
    assert [(x["sounding_id"], x["impossible"]) for x in r if x["impossible"]] == [(3, True)]
    nulls = spark.createDataFrame([(1, None, None, None, 5.0, 0.0), (None, 1, 1, 1, 99999.0, 0.0)], SOUND)
    assert [x["sounding_id"] for x in spikes.faulty(nulls, none).collect()] == [None]


def test_tail_fit():
    import numpy as np

    rng = np.random.default_rng(7)
    for shape, scale in ((0.2, 1.0), (0.0, 3.0), (-0.3, 0.01)):
        u = rng.uniform(size=40_000)
        x = -scale * np.log(u) if not shape else scale * (u**-shape - 1) / shape
        x[:200] = 500 * scale  # faults among the peaks
        got_scale, got_shape = spikes.pareto(x, np.ones(len(x), np.int64))
        assert abs(got_scale / scale - 1) < 0.1 and abs(got_shape - shape) < 0.1
    assert spikes.pareto(np.zeros(3), np.ones(3, np.int64)) == (0.0, 0.0)


def test_faults_come_without_the_tail(spark, sf, monkeypatch):
    from sondegrid.queries import problems

    kinds = ["sounding_id", "impossible", "spike", "stuck"]
    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    fitted = spikes.faulty(table("soundings"), table("xyz_sources"), time="measured_at").where("impossible or spike or stuck").select(kinds).collect()
    monkeypatch.setattr(spikes, "tails", None)
    got = problems.p4_faults(spark, sf).collect()
    assert got and sorted(got) == sorted(fitted) and problems.p4_found(spark, sf).count() == len(got)


def test_bound_is_that_of_the_exact_quantile(spark):
    v = [0.0]
    for i in range(101):  # all in one bucket; three of four stay within 1.000675
        v.append(v[-1] + (1 + 0.000009 * i) * (-1) ** i)
    v += [v[-1] - 0.0001, v[-1] + 8.0065, v[-1] - 0.0002, v[-1]]
    got = spikes.faulty(spark.createDataFrame(series(v), SOUND), spark.createDataFrame([], SRC)).where("impossible or spike or stuck").collect()
    assert [(r["sounding_id"], r["spike"]) for r in got] == [(103, True)] and brute(series(v), {}) == {103}


def test_readings_delivered_again_at_another_hour_count_once(spark):
    rng = random.Random(2)
    v = [rng.gauss(0, 1) for _ in range(200)]
    v[50:56] = [0.5] * 6
    rows = [(*r, f"2024-01-01 {hour:02}:00:00") for r in series(v) for hour in (3, 5)]
    got = spikes.faulty(spark.createDataFrame(rows, SOUND + ", at string"), spark.createDataFrame([], SRC), time="at").where("impossible or spike or stuck")
    assert got.count() == 0 and not brute(series(v), {})


def test_risk_decides_what_is_unusual(spark):
    rng = random.Random(11)
    rows = series([rng.gauss(0, 1) for _ in range(4000)])
    none = spark.createDataFrame([], SRC)
    n = {risk: spikes.faulty(spark.createDataFrame(rows, SOUND), none, risk=risk).where("unusual").count() for risk in (0.05, 0.01, 1e-4)}
    assert n[0.05] > n[0.01] > n[1e-4] >= 0


# --- 5: lines that fail ----------------------------------------------------------------------------------------------
def one(line, delim=",", cols="id,lat,lon,depth,note"):
    try:
        lineparse.xyz_record(line, delim, cols.split(","))
    except lineparse.Broken as e:
        return e.reason


def test_reasons():
    assert one("1,2,3,4,ok") is None and one('1, "2" ,3,4,"a, ""b"""') is None
    assert one('1,2,3,4,"open') == "quoting" and one('1,2,3,4,"a"b') == "quoting" and one('1,2,3,4,"near buoy".') == "quoting"
    assert one("1,2,3,4") == "columns" and one("1,2,3,4,a,b") == "columns"
    assert one("x,2,3,4,a") == "value" and one("1,91,3,4,a") == "value" and one("1,2,361,4,a") == "value" and one("1,2,3,1e999,a") == "value"
    assert one("1,2,3,١,a") == "value" and one("1,2,3,nan,a") == "value" and one("-1,2,3,4,a") == "value" and one("1,2,3,,a") == "value"
    assert one(" 1 \t 2 3", "space", "x,y,z") is None and one('1 "2"x 3', "space", "x,y,z") == "quoting" and one("1 2", "space", "x,y,z") == "columns"
    assert one("1\t 2 \t3", "\t", "x,y,z") is None and one("1\t\t3", "\t", "x,y,z") == "value"

    def listed(line):
        try:
            lineparse.datalist_record(line)
        except lineparse.Broken as e:
            return e.reason

    assert listed("a.xyz 168 1") is None and listed('a -1 .5 "x, y",z') is None and listed("a 168") == "columns"
    assert listed('a 7 1 "x') == "quoting" and listed("a 7 1") == "value" and listed("a 168 -1") == "value" and listed("a 168 1e") == "value"


def test_errors_are_located():
    def at(line, delim=",", cols="x,y,z"):
        got = dict(lineparse.records(["1,2,3", line, "4,5,6"], lambda g, k: (setattr(g, "delim", delim if k == 1 else ","), g.xyz(cols.split(",")))[1]))
        assert got[0]["x"] == 1.0 and got[2]["z"] == 6.0  # nothing is lost before or behind the error
        return got[1].reason, got[1].at + 1

    assert at("12.5,3,bad") == ("value", 8) and at(" 1 , 91 ,3") == ("value", 6) and at("361,2,3") == ("value", 1)
    assert at('1,2,"3') == ("quoting", 5) and at('1,"2"x,3') == ("quoting", 6) and at('"1,2,3') == ("quoting", 1)
    assert at("1,2") == ("columns", 4) and at("1,2,3,4") == ("columns", 7) and at("1 2 x", "space") == ("value", 5)


def test_plain_lines_are_judged_as_by_the_grammar(spark):
    rng = random.Random(9)
    delims = [",", "tab", "space", "|", "/", ":", ";", "."]
    files = [(i, "f", rng.choice([168, 168, -1]), rng.choice(delims), 0, rng.choice(["x,y,z", "id,lon,lat,depth,note", "lon, lat ,Z,w,qc", "x,lon,z", "x,x,y"]), T0) for i in range(200)]
    lines = []
    for f in files:
        d = {"tab": "\t", "space": " "}.get(f[3], f[3])
        for k in range(12):
            n = f[5].count(",") + 1 + rng.choice([0] * 8 + [1, -1])
            words = [rng.choice(["1", "-2.5", "3e1", "+4.", ".5", "400", "91", "", " 7 ", "x", '"8"', '"9', "1e999", "\t6", "6\r", "6\x01", "١", "-1", "168"]) if rng.random() < 0.3 else str(rng.randint(0, 80)) for _ in range(n)]
            lines.append((f[0], k + 1, (d * rng.choice([1, 1, 1, 2]) if d == " " else d).join(words)))
    r = lineparse.parse_lines(spark.createDataFrame(files, FILES), spark.createDataFrame(lines, "raw_id bigint, line_no int, line string")).collect()
    by = {f[0]: f for f in files}
    text = {(a, b): t for a, b, t in lines if t.strip() and t.strip()[0] != "#"}
    assert {(x["raw_id"], x["line_no"]) for x in r} == set(text)
    for x in r:
        f, line = by[x["raw_id"]], text[x["raw_id"], x["line_no"]]
        try:
            want = lineparse.datalist_record(line) if f[2] == -1 else lineparse.xyz_record(line, {"tab": "\t"}.get(f[3], f[3]), [c.strip() for c in f[5].lower().split(",")])
            assert (x["reason"], x["x"], x["y"], x["z"], x["w"], x["rest"]) == (None, *(want.get(c) for c in "xyzw"), want["rest"]), line
        except lineparse.Broken as e:
            assert (x["reason"], x["col"]) == (e.reason, e.at + 1), line


def test_lines_of_files(spark):
    files = [(1, "f", 168, None, 1, "x,y,z", T0), (2, "f", 168, None, 0, "x,y,z", T0), (3, "d", -1, "space", 0, None, T0), (4, "q", 7, ",", 0, None, T0), (5, "n", 168, "tab", None, None, T0)]
    lines = [(1, 1, "a,b"), (1, 2, " # c"), (1, 3, "1/2/3"), (1, 4, "1,2,3"), (2, 1, "1:2:3"), (2, 2, None), (2, 3, " "), (2, 4, "1:2"), (3, 1, "p 168 1"), (3, 2, "p 168"), (4, 1, "x"), (5, 1, "1\t2\t3"), (9, 1, "x"), (2, 5, "1:2:" + "9" * 200_000)]
    r = lineparse.parse_lines(spark.createDataFrame(files, FILES), spark.createDataFrame(lines, "raw_id bigint, line_no int, line string"))
    out = {(x["raw_id"], x["line_no"]): (x["reason"], x["x"], x["z"]) for x in r.collect()}
    assert out == {(1, 3): (None, 1.0, 3.0), (1, 4): ("columns", None, None), (2, 1): (None, 1.0, 3.0), (2, 4): ("columns", None, None), (3, 1): (None, None, None), (3, 2): ("columns", None, None), (5, 1): (None, 1.0, 3.0), (2, 5): ("value", None, None)}
    empty = lineparse.parse_lines(spark.createDataFrame([], FILES), spark.createDataFrame(lines, "raw_id bigint, line_no int, line string"))
    assert empty.count() == 0


# --- exact percentiles -------------------------------------------------------------------------------------------------
def test_exact_percentiles(spark):
    from pyspark.sql import functions as F

    from sondegrid.operators import ranks

    rng = random.Random(4)
    rows = [(g, round(rng.gauss(-50, 40), 2)) for g in (1, 2, None) for _ in range(500)] + [(1, 7.0)] * 400 + [(3, None), (3, math.nan), (4, math.inf), (4, -math.inf), (4, 0.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    at = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}
    want = df.where("not isnan(v)").groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in at.items()]).where("a is not null")
    for width in (1e-5, 0.5):
        assert got(ranks.percentiles(df, ["g"], "v", at, width)) == got(want)
    alone = got(df.where("g = 1").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in at.items()]))
    assert got(ranks.percentiles(df.where("g = 1"), [], "v", at)) == alone
    assert got(ranks.percentiles(df.limit(0), [], "v", at)) == [(None,) * 5] and got(ranks.percentiles(df.limit(0), ["g"], "v", at)) == []


# --- 7: near and inside ----------------------------------------------------------------------------------------------
PTS = "mark_id bigint, xpos double, ypos double, lon double"


def test_near_at_poles_and_date_line(spark):
    p = [(1, 179.9996, 0.0, 0.0), (2, -179.9999, 0.0, 0.0), (3, 540.0001, 0.0, 0.0), (4, 10.0, 89.9999, 0.0), (5, -170.0, 89.9999, 0.0), (6, 0.0, 90.5, 0.0), (7, math.nan, 0.0, 0.0), (8, None, 0.0, 0.0), (9, 50.0, 10.0, 0.0), (10, 50.0, 10.0, 0.0), (10, 50.0, 10.0, 0.0), (11, 50.002, 10.0, 0.0), (None, 50.0, 10.0, 0.0)]
    r = got(proximity.near_pairs(spark.createDataFrame(p, PTS), 100.0))
    assert r == [(1, 2), (1, 3), (2, 3), (4, 5), (9, 10)] or set(r) == {(1, 2), (1, 3), (2, 3), (4, 5), (9, 10)}
    assert got(proximity.near_pairs(spark.createDataFrame(p, PTS).limit(0), 100.0)) == []


def test_near_random(spark):
    rng = random.Random(2)
    p = [(i, rng.choice([0, 360]) + rng.uniform(-0.004, 0.004), rng.choice([60.0, -89.999]) + rng.uniform(-0.004, 0.0009), 0.0) for i in range(300)]

    def d(a, b):
        f, g = math.radians(a[2]), math.radians(b[2])
        h = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    p = [x for x in p if abs(x[2]) <= 90]
    want = {(a[0], b[0]) for a in p for b in p if a[0] < b[0] and d(a, b) <= 100}
    assert set(got(proximity.near_pairs(spark.createDataFrame(p, PTS), 100.0))) == want


def test_wkt():
    p = proximity.parse_wkt
    square = [[[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]]]
    assert p("POLYGON((0 0,0 1,1 1,0 0))") == square and p("srid=4326; polygon z (( 0 0 5, 0 1 5 ,1 1 5,0 0 5 ))") == square
    assert p("MULTIPOLYGON(((0 0,0 1,1 1,0 0)))") == square and p("POLYGON((0 0,0 1,1 1))") is not None
    for bad in (None, "", "  ", "POLYGON((0 0,0 1,1 1,0 0)", "POLYGON((0 0,0 1,1", "POLYGON 0 0, 0 1", "POLYGON EMPTY", "POINT(0 0)", "POLYGON((0 0,0 1))", "MULTIPOLYGON((0 0,0 1,1 1,0 0))", "POLYGON((0 0,0 1,1 1,0 0)) x"):
        assert p(bad) is None, bad


def test_inside_holes_boxes_and_turns(spark):
    files = [(1, "POLYGON((0 0,0 10,10 10,10 0,0 0),(4 4,4 6,6 6,6 4,4 4))", None), (2, "POLYGON((0 0,0 10", [350.0, 365.0, -5.0, 5.0, 0.0, 1.0]), (3, None, [0.0] * 6), (4, None, None), (5, "MULTIPOLYGON(((179 0,179 1,181 1,181 0,179 0)),((-170 0,-170 1,-169 1,-169 0,-170 0)))", None), (6, None, [1.0, None, 2.0, 3.0, 0.0, 0.0]), (1, "POLYGON((0 0,0 10,10 10,10 0,0 0),(4 4,4 6,6 6,6 4,4 4))", None)]
    r = proximity.regions(spark.createDataFrame(files, "file_id bigint, wkt string, minmax array<double>"))
    p = [(1, 2.0, 2.0, 0.0), (2, 5.0, 5.5, 0.0), (3, 362.0, 2.0, 0.0), (4, -180.0, 0.5, 0.0), (5, -169.5, 0.5, 0.0), (6, 10.0, 5.0, 0.0), (7, 4.0, 5.0, 0.0), (8, -9.0, 0.0, 0.0), (9, 3.0, 4.0, 0.0)]
    pts = spark.createDataFrame(p, PTS)
    assert got(proximity.inside(pts, r)) == [(1, 1), (1, 2), (3, 1), (3, 2), (4, 5), (5, 5), (8, 2), (9, 1), (9, 2)]
    assert {(6, 1), (7, 1)} <= set(got(proximity.inside(pts, r, boundary=True)))
    assert got(proximity.inside(pts, r, listed_bytes=0)) == got(proximity.inside(pts, r))
    assert got(proximity.inside(pts.limit(0), r)) == [] and got(proximity.inside(pts, r.limit(0))) == []


def test_inside_far_and_wide_regions(spark):
    files = [(1, None, [-1e12, 1e12, -10.0, 10.0, 0.0, 1.0]), (2, "POLYGON((-300 20,400 20,400 30,-300 30,-300 20))", None), (3, None, [1e6, 1e6 + 1, 40.0, 41.0, 0.0, 1.0]), (4, None, [-170.0, 190.0, -1e9, 1e9, 0.0, 1.0]), (5, None, [0.5, 0.6, 0.5, 0.5001, 0.0, 1.0])]
    r = proximity.regions(spark.createDataFrame(files, "file_id bigint, wkt string, minmax array<double>"))
    # 1e6 is 280 beyond whole turns
    p = [(11, 5.0, 5.0, 0.0), (12, 1e10 + 7, 25.0, 0.0), (13, -79.5, 40.5, 0.0), (14, 179.0, -80.0, 0.0), (15, 0.55, 0.50005, 0.0), (16, -79.5 + 360 * 1e6, 40.5, 0.0)]
    want = [(11, 1), (11, 4), (12, 2), (12, 4), (13, 3), (13, 4), (14, 4), (15, 1), (15, 4), (15, 5), (16, 3), (16, 4)]
    assert got(proximity.inside(spark.createDataFrame(p, PTS), r)) == want
