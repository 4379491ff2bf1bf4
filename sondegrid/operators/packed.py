"""Several values packed in one field: dialects chosen by description length.

A dialect is a set of delimiters and a set of quote marks. The description of a field under a dialect is the sum of the code
lengths of the values it yields, plus ``escape_bits`` for each structural character of the full grammar (all delimiters, all
marks) that it leaves standing unescaped: a delimiter outside quotes, or a well closed pair of marks around a whole value.

Code lengths are those of a dictionary of values fitted on all fields, read in the widest dialect. A value that c of the
different fields hold takes ``log2(total / c)`` bits and its share of the entry that spells it, ``8 (characters + 1) / c``;
one that no other field holds is spelt where it stands. Fields count once however often they are repeated, so that a field
delivered often doesn't become a word of its own. The cheapest dialect parses the field, and ties go to the wider one.

All sets of marks are scored for each field. A set of fewer delimiters yields other values only by leaving neighbouring pieces
together, and costs more than the full set unless one of those is a known word, since a text costs as much in one as in two.
So it is scored just for the fields in which two neighbouring pieces begin a known word that holds a delimiter; for all others
the full set is certain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sondegrid.session import checked_broadcast, materialize

DELIMITERS, QUOTES = ",;|\t", "\"'"
ESCAPE_BITS = 16.0


def _subsets(chars: str) -> list[str]:
    return ["".join(c) for n in range(len(chars), -1, -1) for c in combinations(chars, n)]


@lru_cache(maxsize=256)
def _value(delims: str, quotes: str, end: str) -> re.Pattern:
    """A value and what ends it; a mark that isn't closed before a delimiter or the end is literal."""
    after = f"[{re.escape(delims + end)}]"
    marked = [rf"{q}((?:[^{q}{re.escape(end)}]|{q}{q})*+){q} *+(?={after})" for q in quotes]
    return re.compile(rf" *+(?:{'|'.join([*marked, rf'([^{re.escape(delims + end)}]*+)'])}){after}", re.S)


@lru_cache(maxsize=64)
def _opening(delims: str, mark: str) -> re.Pattern:
    return re.compile(rf"(?:\A|[{re.escape(delims)}]) *{mark}")


def _end(field: str, delims: str, quotes: str) -> str:
    """A sign for the end: a character that the field doesn't hold."""
    return next(c for c in map(chr, range(0x110000)) if c not in field and c not in " " + delims + quotes)


def parse(field: str, delims: str = DELIMITERS, quotes: str = QUOTES) -> list[str]:
    """The values of a field under a dialect, in order."""
    end = _end(field, delims, quotes)
    found = _value(delims, quotes, end).findall(field + end)
    if not quotes:
        return [v.rstrip(" ") for v in found]
    out = []
    for *marked, plain in found:
        value = plain.rstrip(" ")
        if not value:
            for q, v in zip(quotes, marked):
                if v:
                    value = v.replace(q * 2, q)
        out.append(value)
    return out


def dialects(field: str, delims: str = DELIMITERS, quotes: str = QUOTES, narrow: bool = True) -> list[tuple[str, str, list[str], int]]:
    """Every different parse of a field: delimiters, marks, values, structural characters left standing (with all delimiters
    only, unless ``narrow``). The widest comes first; dialects that differ in characters the field doesn't hold, or holds within values only, parse it alike.

    Left standing are the delimiters outside quotes that a narrower dialect doesn't split at, and the pairs of marks closed
    around values that it doesn't take for marks."""
    here = "".join(c for c in delims if c in field)
    marks = "".join(c for c in quotes if c in field and (_opening(here, c) if here else _opening(c, c)).search(field))
    all_ = {(d, q): parse(field, d, q) for d in (_subsets(here) if narrow else [here]) for q in _subsets(marks)}
    n = len(all_[here, marks])
    end = _end(field, here, marks)
    pairs = [m.lastindex for m in _value(here, marks, end).finditer(field + end)] if marks else []
    found: dict[tuple, tuple] = {}
    for (d, q), values in all_.items():
        if (key := (*values,)) not in found:
            found[key] = (d, q, values, max(0, n - len(all_[d, marks])) + sum(pairs.count(i) for i, c in enumerate(marks, 1) if c not in q))
    return [*found.values()]


_PARSES = "h1 bigint, h2 bigint, c array<struct<d: string, q: string, vals: array<string>, left: int>>"


def _parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many characters, since a field is held once for each dialect."""
    a = size = 0
    for z, n in enumerate(pc.utf8_length(batch.column(2)).to_pylist(), 1):
        size += n
        if size >= most or z == batch.num_rows:
            yield batch.slice(a, z - a)
            a, size = z, 0


def _all_dialects(delims: str, quotes: str, narrow: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in _parts(batch)):
            found = [dialects(f, delims, quotes, narrow) for f in b.column(2).to_pylist()]
            flat = [x for c in found for x in c]
            lists = lambda sizes, inner: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), inner)
            vals = lists([len(x[2]) for x in flat], pa.array([v for x in flat for v in x[2]], pa.string()))
            each = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), vals, pa.array([x[3] for x in flat], pa.int32())], ["d", "q", "vals", "left"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists([len(c) for c in found], each)], ["h1", "h2", "c"])

    return each


def _spelt(v: str) -> Column:
    return F.lit(8.0) * (F.length(v) + 1)


def value_codes(parses: DataFrame) -> DataFrame:
    """(h, bits): hash and code length of each value that several of the different fields hold in the widest dialect."""
    held = parses.select(F.explode(F.array_distinct(F.col("c")[0]["vals"])).alias("v")).groupBy(F.xxhash64("v").alias("h")).agg(F.count("*").alias("n"), F.max(_spelt("v")).alias("spelt"))
    held = materialize(held, "packed-values")
    total = held.agg(F.sum("n")).scalar()
    return held.where("n > 1").select("h", F.least("spelt", F.log2(total / F.col("n")) + F.col("spelt") / F.col("n")).alias("bits"))


def _doubtful(fields: DataFrame, wide: DataFrame, delims: str) -> DataFrame:
    """(h1, h2) of the fields with two neighbouring pieces that begin a word which holds a delimiter and which several fields
    hold. Such words come from quoted values, so they are few."""
    any_ = "[" + "".join("\\" + c for c in delims) + "]"
    pair = lambda a, b: F.xxhash64(F.btrim(a, F.lit(" ")), F.btrim(b, F.lit(" ")))
    words = wide.select(F.explode(F.filter(F.array_distinct(F.col("c")[0]["vals"]), lambda v: v.rlike(any_))).alias("v")).groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    begin = words.select(F.split("v", any_).alias("p")).select(pair(F.col("p")[0], F.col("p")[1]).alias("pair")).distinct()
    pieces = fields.select("h1", "h2", F.split("f", any_).alias("p")).where(F.size("p") > 1)
    pairs = pieces.select("h1", "h2", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: pair(F.get("p", i - 1), F.get("p", i)))).alias("pair"))
    return pairs.join(checked_broadcast(begin, "packed-words"), "pair", "left_semi").select("h1", "h2").distinct()


def split_packed(df: DataFrame, id_col: str, field_col: str, delims: str = DELIMITERS, quotes: str = QUOTES, escape_bits: float = ESCAPE_BITS) -> DataFrame:
    """(id, pos, val): one row per value, pos from 1.

    Null and blank fields give no rows; empty values count, also after a last delimiter; spaces around a value are dropped;
    rows that repeat an id count once (with the least field, should they differ), a null id being one id; other columns are
    left out; an empty table gives no rows; fields of any length are parsed whole. Fields are told apart by two 64-bit hashes."""
    rows = df.groupBy(F.col(f"`{id_col}`").alias("k")).agg(F.min(F.col(f"`{field_col}`")).alias("f"))
    rows = rows.where(F.col("f").rlike(r"\S")).select("k", F.xxhash64("f").alias("h1"), F.xxhash64(F.lit(1), "f").alias("h2"), "f")
    fields = materialize(rows.groupBy("h1", "h2").agg(F.any_value("f").alias("f")), "packed-fields")
    wide = materialize(fields.mapInArrow(_all_dialects(delims, quotes, False), _PARSES), "packed-parses")
    doubtful = materialize(_doubtful(fields, wide, delims), "packed-doubtful")
    narrow = materialize(fields.join(doubtful, ["h1", "h2"], "left_semi").mapInArrow(_all_dialects(delims, quotes, True), _PARSES), "packed-narrow")
    parses = wide.join(doubtful, ["h1", "h2"], "left_anti").unionByName(narrow)
    tried = parses.where(F.size("c") > 1).select("h1", "h2", F.posexplode("c").alias("i", "p")).select("h1", "h2", "i", F.length("p.d").alias("nd"), F.length("p.q").alias("nq"), F.col("p.left").alias("left"), F.explode("p.vals").alias("v"))
    # code lengths are joined by 8-byte hashes; sent to all executors if few, else joined by shuffle
    priced = tried.select("h1", "h2", "i", "nd", "nq", "left", F.xxhash64("v").alias("h"), _spelt("v").alias("spelt")).join(checked_broadcast(value_codes(wide), "packed-codes"), "h", "left")
    cost = priced.groupBy("h1", "h2", "i").agg(F.sum(F.coalesce(F.least("bits", "spelt"), "spelt")).alias("bits"), *[F.first(c).alias(c) for c in ("left", "nd", "nq")])
    order = F.struct(F.round(F.col("bits") + F.col("left") * F.lit(escape_bits), 6), -F.col("nd"), -F.col("nq"), F.col("i"))
    best = cost.groupBy("h1", "h2").agg(F.min_by("i", order).alias("i"))
    chosen = parses.join(best, ["h1", "h2"], "left").select("h1", "h2", F.col("c")[F.coalesce("i", F.lit(0))]["vals"].alias("vals"))
    out = rows.drop("f").join(chosen, ["h1", "h2"]).select("k", F.posexplode("vals").alias("p", "val"))
    return out.select(F.col("k").alias(id_col), (F.col("p") + 1).alias("pos"), "val")
