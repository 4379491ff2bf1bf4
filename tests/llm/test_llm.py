"""Encoding, packing and shared passages against a library tokenizer and brute force."""

import datetime as dt
import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sondegrid.llm import bpe, packing, quantiles, spans

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
RANKS = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids_of(enc, texts):
    ids, n = enc.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_hard_texts(ranks, library):
    texts = ["", " ", "  a", "it's 's ''s  'll we've\n's \n\n x\t\tz  ", "a" * 5000, "'", "don'", "\0a\0", "日本語 の", "५६7 ½²", "<|endoftext|>", "\x1c a", "'sta 'rex", "ﬁ İ  x", "\U0001f600‍\U0001f600", "x" + " " * 3000 + "y"]
    enc = bpe.Encoder(ranks)
    assert ids_of(enc, texts) == [library.encode_ordinary(t) for t in texts]
    assert enc.lengths(texts).tolist() == [len(library.encode_ordinary(t)) for t in texts]


ENCODERS = {}


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs", "Cn")), max_size=40), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_random_texts(texts):
    if not ENCODERS:
        import tiktoken

        r = bpe.load_ranks(RANKS)
        ENCODERS["own"] = bpe.Encoder(r)
        ENCODERS["lib"] = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=r, special_tokens={})
    assert ids_of(ENCODERS["own"], texts) == [ENCODERS["lib"].encode_ordinary(t) for t in texts]


def test_small_table_starts_anew(ranks, library):
    enc = bpe.Encoder(ranks, table=50)
    rng = random.Random(0)
    for _ in range(6):
        texts = [" ".join(str(rng.randint(0, 10**6)) for _ in range(40)) for _ in range(3)]
        assert ids_of(enc, texts) == [library.encode_ordinary(t) for t in texts]


def test_whole_table_and_edges(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_column(docs).collect()}
    assert got == {k: library.encode_ordinary(v or "") for k, v in text.items()}
    df = spark.createDataFrame([(None, "a", 1), (1, None, 2), (1, "", 3), (1, "b", 4)], "doc_id bigint, text string, ids int")
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in bpe.encode_column(df).collect()) == [(0, 1), (1, 0), (1, 0), (1, 1)]
    assert bpe.encode_column(df.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in bpe.count_column(df).collect()) == [0, 0, 1, 1]


def test_words_of_one_hash(ranks, library, monkeypatch):
    # Thue-Morse words have one polynomial hash modulo a power of two, whatever the base
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [w[:n] for n in (1024, 2048) for w in (word, word.translate(str.maketrans("ab", "ba")))] + ["x y"]
    want = [library.encode_ordinary(t) for t in texts]
    assert want[0] != want[1]
    assert ids_of(bpe.Encoder(ranks), texts) == want
    # and where hashes do collide, the characters decide
    monkeypatch.setattr(bpe, "mix", lambda x: x * np.uint64(0))
    enc = bpe.Encoder(ranks)
    for _ in range(2):
        assert ids_of(enc, texts) == want
        assert ids_of(enc, ["ab cd", "cd", " cd efg", "gfe"]) == [library.encode_ordinary(t) for t in ("ab cd", "cd", " cd efg", "gfe")]


# --- containers ------------------------------------------------------------------------------------------------------
def fill(histogram, capacity):
    steps, bins = packing.plan(histogram, capacity)
    load, count, seen = np.zeros(bins, int), np.zeros(bins, int), dict.fromkeys(histogram, 0)
    by = {}
    for s, first, each, at in steps:
        by.setdefault(int(s), []).append((int(first), int(each), int(at)))
    for s, runs in by.items():
        ends = [r[0] for r in runs[1:]] + [histogram[s]]
        assert runs[0][0] == 0
        for (first, each, at), end in zip(runs, ends):
            for k in range(end - first):
                load[at + k // each] += s
                count[at + k // each] += 1
                seen[s] += 1
    assert seen == histogram and (load <= capacity).all() and (load > 0).all()
    return load, bins


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1, max_size=25))
@settings(max_examples=200, deadline=None)
def test_every_item_fits(histogram):
    load, bins = fill(histogram, 60)
    total = sum(k * v for k, v in histogram.items())
    # never worse than the bound of any-fit packings
    assert bins <= max(1, -(-2 * total // 60)) + sum(v for k, v in histogram.items() if 2 * k > 60)


def test_little_is_left_unused():
    rng = np.random.default_rng(0)
    sizes = np.clip(rng.lognormal(6, 0.8, 20_000).astype(int), 1, 2048)
    h = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}
    load, bins = fill(h, 2048)
    assert load.sum() / (bins * 2048) > 0.99
    assert packing.plan({}, 10)[1] == 0 and fill({10: 3}, 10)[1] == 3 and fill({4: 5}, 10)[1] == 3


def test_pack(spark):
    rows = [(i, n, "x") for i, n in enumerate([25, 10, 9, 1, 5, 5, 4, 4, 3, 0, -1])] + [(3, 1, "x"), (None, 2, "y"), (99, None, "z")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int, bin string"), 10).collect()
    load = {}
    for r in out:
        load[r["bin"]] = load.get(r["bin"], 0) + r["n_tokens"]
    assert sum(load.values()) == sum(n for _, n, _ in rows if n and n > 0) and max(load.values()) <= 10
    assert sorted((r["piece"], r["n_tokens"]) for r in out if r["doc_id"] == 0) == [(0, 10), (1, 10), (2, 5)]
    assert all(r["piece"] == 0 for r in out if r["doc_id"] != 0) and len(out) == 3 + 8 + 2
    assert packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int, bin string").limit(0), 10).count() == 0


# --- shared passages -------------------------------------------------------------------------------------------------
def brute(docs, span):
    where = {}
    for k, t in docs:
        if k is not None and t:
            for i in range(len(t) - span + 1):
                where.setdefault(t[i : i + span], set()).add(k)
    out = {}
    for k, t in docs:
        if k is None or not t:
            continue
        hit = set()
        for i in range(len(t) - span + 1):
            if len(where[t[i : i + span]]) > 1:
                hit.update(range(i, i + span))
        if hit:
            out[k] = max(out.get(k, 0), len(hit))
    return out


def found(spark, docs, span, anchor):
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id bigint, text string, k int")
    return {r["doc_id"]: r["shared_chars"] for r in spans.shared_chars(df, span=span, anchor=anchor).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_shared_random(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(10, 60))) for _ in range(6)]
    docs = []
    for i in range(60):
        t = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            a = rng.randint(0, 8)
            t += p[a : len(p) - rng.randint(0, 8)] + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 10)))
        docs.append((i, t))
    docs += [(100, docs[5][1]), (101, docs[5][1]), (102, None), (103, ""), (None, docs[7][1]), (104, "xy" * 40), (104, "xy" * 40)]
    assert found(spark, docs, 20, 5) == brute(docs, 20)


def test_shared_edges(spark):
    base = "".join(chr(97 + (i * i) % 26) for i in range(500))
    docs = [(1, base), (2, "#" + base[100:260]), (3, base[101:260]), (4, "\U0001f600" * 160), (5, "z" + "\U0001f600" * 160)]
    assert found(spark, docs, 160, 32) == brute(docs, 160)
    assert found(spark, [(1, None)], 160, 32) == {}
    same = "c" * 300_000  # one run of equal windows
    assert found(spark, [(1, same), (2, "q" + same[:1000] + "q")], 160, 32) == {1: 300_000, 2: 1000}
    rng = random.Random(1)
    long = "".join(rng.choice("abcdef ") for _ in range(300_000))
    assert found(spark, [(1, long), (2, "q" + long[1000:2000] + "q")], 160, 32) == {1: 1000, 2: 1000}


def test_shared_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, docs, 160, 32) == brute(docs, 160)


@pytest.mark.parametrize("n", [160, 230, 300])
def test_shared_again_elsewhere(spark, n):
    """The document that stands for a shared block has the passage a second time, in a block of its own."""
    rng = random.Random(n)
    left, p, m, x, y, u, v = ("".join(rng.choice("abcdefghij ") for _ in range(k)) for k in (200, n, 200, 200, 200, 200, 200))
    docs = [(1, left + p + m + x + "#" + p + "#" + y), (2, u + "!" + left + p + m + "!" + v)]
    got = found(spark, docs, 160, 32)
    assert got == brute(docs, 160) and got[1] == 400 + 2 * n


# --- percentiles --------------------------------------------------------------------------------------------------
def test_percentiles_exact_on_short_values(spark):
    rng = random.Random(1)
    rows = [(i, g, round(rng.gauss(-50, 40), 2), T0 + dt.timedelta(days=rng.randint(0, 5))) for g in (1, 2, None) for i in range(g or 9, 3000, 3)]
    rows += rows[:500] + [(-1, 1, math.nan, T0), (-2, 1, math.inf, T0), (-3, 1, None, T0), (-4, 7, 0.0, T0), (-5, 8, None, T0)]
    df = spark.createDataFrame(rows, "id bigint, g int, v double, at timestamp")
    r = {x["g"]: x for x in quantiles.daily_percentiles(df, "id", "g", "v", "at", [5, 50, 95]).collect()}
    for g in (1, 2, None):
        v = sorted(x[2] for x in {x[:3] for x in rows if x[1] == g and x[2] is not None and math.isfinite(x[2])})
        assert r[g]["n"] == len(v) and r[g]["least"] == v[0]
        assert [r[g][f"p{p:02d}"] for p in (5, 50, 95)] == [v[-(-len(v) * p // 100) - 1] for p in (5, 50, 95)]
    assert r[7]["p50"] == 0.0 and 8 not in r
    clash = df.selectExpr("id AS lo", "g AS bucket", "v AS n", "at AS day", "id AS g", "v")
    assert rows_of(quantiles.daily_percentiles(clash, "lo", "bucket", "n", "day", [5, 50, 95])) == rows_of(quantiles.daily_percentiles(df, "id", "g", "v", "at", [5, 50, 95]))
    spread = quantiles.daily_percentiles(df, "id", "g", "v", "at", [5, 50, 95], hot=100)
    assert rows_of(spread) == rows_of(quantiles.daily_percentiles(df, "id", "g", "v", "at", [5, 50, 95]))
    assert quantiles.daily_percentiles(df.limit(0), "id", "g", "v", "at", [50]).count() == 0


@given(st.floats(allow_nan=False, allow_infinity=False), st.floats(allow_nan=False, allow_infinity=False))
@settings(max_examples=200, deadline=None)
def test_bucket_rule(a, b):
    scale = 1.0 / math.log1p(quantiles.WIDTH)
    shift = math.ceil(-math.log(5e-324) * scale) + 1
    f = lambda v: 0 if v == 0 else int(math.copysign(math.floor(math.log(abs(v)) * scale) + shift, v))
    if a < b:
        assert f(a) <= f(b)
    if f(a) == f(b) and a != b:
        assert abs(a - b) <= max(abs(a), abs(b)) * quantiles.WIDTH * 1.01 + 1e-300


def test_sketches_add_up(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "id % 7 AS day", "pow(id % 997 + 1, 1.5) AS v")
    whole = quantiles.percentiles(quantiles.sketch(df, ["g"], "v"), ["g"], [25, 50])
    parts = quantiles.combine(quantiles.sketch(df, ["g", "day"], "v"), ["g"])
    assert rows_of(whole) == rows_of(quantiles.percentiles(parts, ["g"], [25, 50]))
    true = rows_of(quantiles.daily_percentiles(df.selectExpr("monotonically_increasing_id() AS id", "g", "v", "timestamp_seconds(day * 86400) AS at"), "id", "g", "v", "at", [25, 50]))
    for width in (1e-3, 0.01):
        wide = quantiles.percentiles(quantiles.sketch(df, ["g"], "v", width), ["g"], [25, 50])
        for a, b in zip(true, rows_of(wide)):
            assert a[:4] == b[:4] and all(abs(x - y) <= width * abs(x) for x, y in zip(a[4:], b[4:]))


def test_ranks_of_stored_day_sketches(spark, sf):
    df = spark.read.parquet(f"{sf}/soundings.parquet").where("file_id is not null")
    asked = [5, 25, 50, 75, 95]
    got = quantiles.daily_percentiles(df, "sounding_id", "file_id", "zpos", "loaded_at", asked, exact=False).collect()
    v = {}
    for r in df.where("zpos is not null and not isnan(zpos) and abs(zpos) < double('inf')").select("sounding_id", "file_id", "zpos").distinct().collect():
        v.setdefault(r["file_id"], []).append(r["zpos"])
    assert len(got) == len(v)
    for r in got:
        x = sorted(v[r["file_id"]])
        for p in asked:
            exact = x[-(-len(x) * p // 100) - 1]
            assert r[f"p{p:02d}"] in x and abs(r[f"p{p:02d}"] - exact) <= quantiles.WIDTH * abs(exact)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_plans_have_no_nested_loops(spark, sf):
    from sondegrid.llm.queries import queries

    for name in ("p6_percentiles", "p9_bins", "p10_found"):
        plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
