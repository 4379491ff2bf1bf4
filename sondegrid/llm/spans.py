"""Passages that documents share verbatim.

Every window of ``span`` code points has a Rabin-Karp hash. A window belongs to the least hash of the shorter windows of
``anchor`` code points in it (its anchor), so equal windows have equal anchors, wherever they stand. Consecutive windows
with one anchor form a run; the hash of all characters of a run is its block. Counted in Spark are, in turn:

1. anchors: those of a single document are done with;
2. blocks: where several documents hold a block, all its windows are shared, and one document stands for the others;
3. windows, only of anchors with several different blocks, one document for each block. A window of a block that (2) found
   shared counts as held by several documents, whichever document stands for the block.

The windows found in (2) and (3) are merged into maximal intervals. Documents of which exact copies exist are shared whole
and only one of them takes part in (1) to (3). Equality is that of 64-bit hashes (of positions' values drawn by a mixing
function, so no text has a special form under it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sondegrid.llm.bpe import mix, text_slices
from sondegrid.session import checked_broadcast, materialize

SPAN, ANCHOR = 160, 32
#: Bytes of a set of keys that is sent to all executors.
KEYS = 32 << 20
_MUL = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        _POWERS.clear()
        for base in (_MUL, pow(_MUL, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


class Windows:
    """Hashes over the joined code points of several texts."""

    def __init__(self, texts: list[str], span: int, anchor: int):
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        n = len(cp)
        power, self.inverse = _powers(n + 1)
        self.head = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(cp.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * power[:n], out=self.head[1:])
        self.span = span
        last = np.maximum(self.size - span + 1, 0)  # windows of each text
        self.text = np.repeat(np.arange(len(texts)), last)
        self.at = np.arange(len(self.text)) - np.repeat(np.cumsum(last) - last, last)  # place in its text
        where = self.at + self.begin[self.text]
        if not len(where):
            self.least, self.first = np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        short = mix((self.head[anchor:] - self.head[: n + 1 - anchor]) * self.inverse[: n + 1 - anchor])
        width, least = 1, short
        while 2 * width <= span - anchor + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := span - anchor + 1 - width:
            least = np.minimum(least[:-rest], least[rest:])
        self.least = least[where]
        self.first = np.ones(len(where), bool)  # begins a run
        self.first[1:] = (self.least[1:] != self.least[:-1]) | (self.text[1:] != self.text[:-1])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.head[end] - self.head[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))

    def runs(self) -> tuple[np.ndarray, ...]:
        """Text, anchor, block, first and last window of each run."""
        a = np.flatnonzero(self.first)
        z = np.append(a[1:], len(self.first)) - 1
        t = self.text[a]
        return t, self.least[a], self.hash(self.at[a] + self.begin[t], self.at[z] + self.begin[t] + self.span), self.at[a], self.at[z]


def shared_chars(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(id, shared_chars): documents with a character in a passage of at least ``span`` code points that another document holds.

    Null, empty and shorter texts, and rows without an id, have none and are no partners; rows that repeat an id are one
    document, whose repeats don't count as another; other columns are left out; an empty table gives no rows. Texts are
    taken whole, whatever their length."""
    docs = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t")).where(F.col("k").isNotNull() & (F.length("t") >= span))
    kind = docs.schema["k"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, texts in text_slices(b.column(1)):
                w = Windows(texts, span, anchor)
                t, least, block, lo, hi = w.runs()
                whole = w.hash(w.begin, w.end)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.concatenate([t, np.arange(z - a)]) + a)),
                        pa.array(np.concatenate([least, whole]).view(np.int64)),
                        pa.array(np.concatenate([block, np.zeros(z - a, np.uint64)]).view(np.int64)),
                        pa.array(np.concatenate([lo, np.full(z - a, -1)]), pa.int32()),
                        pa.array(np.concatenate([hi, w.size]), pa.int32()),
                    ],
                    ["k", "h", "block", "lo", "hi"],
                )

    runs = materialize(docs.mapInArrow(first, f"k {kind}, h bigint, block bigint, lo int, hi int"), "span-runs")
    whole, runs = runs.where("lo < 0"), runs.where("lo >= 0").select("k", F.col("h").alias("anchor"), "block", "lo", "hi")
    # documents of which exact copies exist, and of them all but the one that stands for the others
    classes = whole.groupBy("h", "hi").agg(F.min("k").alias("one"), F.max("k").alias("other")).where("one <> other")
    copies = whole.join(classes, ["h", "hi"]).select("k", "one", "hi")
    # what most runs are tested against is small as a rule: sent to all executors if it is, else joined by shuffle
    spare = checked_broadcast(copies.where("k <> one").select("k"), "span-spare", KEYS)
    several = checked_broadcast(runs.groupBy("anchor").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a <> z").select("anchor"), "span-several", KEYS)
    live = materialize(runs.join(several, "anchor", "left_semi").join(spare, "k", "left_anti"), "span-live")
    blocks = live.groupBy("anchor", "block").agg(F.min("k").alias("one"), F.max("k").alias("other"))
    mixed = blocks.groupBy("anchor").agg(F.count("*").alias("n"), F.min("one").alias("a"), F.max("other").alias("z")).where("n > 1 and a <> z").select("anchor")
    known = live.join(blocks, ["anchor", "block"])
    held = known.where("one <> other").select("k", "lo", "hi")
    wanted = known.where("k = one").join(mixed, "anchor", "left_semi").groupBy("k").agg(F.array_sort(F.collect_set(F.struct("lo", "hi", (F.col("one") != F.col("other")).cast("int").alias("held")))).alias("parts"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, texts in text_slices(b.column(1)):
                w = Windows(texts, span, anchor)
                parts = b.column(2).slice(a, z - a).to_pylist()
                n = list(map(len, parts))
                text = np.repeat(np.arange(z - a), n)
                lo, hi, several = (np.fromiter((x[c] for p in parts for x in p), np.int64, sum(n)) for c in ("lo", "hi", "held"))
                each = hi - lo + 1
                text, at = np.repeat(text, each), np.arange(each.sum()) + np.repeat(lo - (np.cumsum(each) - each), each)
                begin = at + w.begin[text]
                columns = [b.column(0).take(pa.array(text + a)), pa.array(w.hash(begin, begin + span).view(np.int64)), pa.array(at, pa.int32()), pa.array(np.repeat(several, each) > 0)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "h", "lo", "held"])

    windows = materialize(docs.join(wanted, "k").mapInArrow(second, f"k {kind}, h bigint, lo int, held boolean"), "span-windows")
    equal = windows.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("z"), F.max("held").alias("held")).where("held or a <> z").select("h")
    found = held.unionByName(windows.where("not held").join(equal, "h", "left_semi").select("k", "lo", F.col("lo").alias("hi")))
    found = found.join(copies.select("k").distinct(), "k", "left_anti")
    # maximal intervals: each window run adds the characters beyond what the earlier ones reach
    before = F.max("hi").over(Window.partitionBy("k").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)) + F.lit(span)
    end = F.col("hi") + F.lit(span)
    added = found.select("k", F.greatest(F.lit(0), end - F.greatest(F.col("lo"), F.coalesce(before, F.lit(0)))).alias("n"))
    out = added.groupBy("k").agg(F.sum("n").alias("n")).unionByName(copies.groupBy("k").agg(F.max("hi").cast("bigint").alias("n")))
    return out.toDF(id_col, "shared_chars")
