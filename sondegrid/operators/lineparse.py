"""Lines that fail to parse, apart from the valid records.

Lines that a few built-in expressions can tell to be valid (no quotes, the right number of values, plain numbers within
their bounds) are taken as they are. All others go through a recursive-descent grammar. It reads the lines that come together
as one text, whose record starts, the anchors, are the starts of data lines: a record ends with its line, so no other place
can begin one. On an error, a broken quote above all, the parser notes kind, line and column, and resumes at the next anchor
behind it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

XYZ, DATALIST = 168, -1
#: Formats a datalist entry may name, and the columns with numbers (fixed values).
FORMATS = (-1, -2, -4, 168, 200, 300)
BOUNDS = {"x": (-180.0, 360.0), "lon": (-180.0, 360.0), "y": (-90.0, 90.0), "lat": (-90.0, 90.0), "z": None, "w": None, "depth": None}
SAME = {"lon": "x", "lat": "y", "depth": "z"}
_NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_WHOLE = re.compile(r"[0-9]+")
_INTEGER = re.compile(r"[+-]?[0-9]+")
_BLANKS = " \t"
_WORD = re.compile(r"[^ \t]*")


class Broken(Exception):
    """A syntax error: reason, place in the text, what was expected."""

    def __init__(self, reason: str, at: int, text: str):
        super().__init__(text)
        self.reason, self.at, self.text = reason, at, text


@dataclass
class Grammar:
    """Productions over the records of a text; ``at`` is the place reached, ``end`` that of the record's end."""

    text: str
    delim: str = ","  # one character, or "space" for runs of blanks
    anchors: list[int] = field(default_factory=lambda: [0])
    at: int = 0
    end: int = -1

    def __post_init__(self):
        self.begin(0)

    def begin(self, k: int) -> None:
        """Goes to a record start."""
        self.at = self.anchors[k]
        self.end = self.anchors[k + 1] - 1 if k + 1 < len(self.anchors) else len(self.text)

    def behind(self, at: int) -> int:
        """The next record start behind a place."""
        return bisect_right(self.anchors, at)

    def blanks(self) -> None:
        while self.at < self.end and self.text[self.at] in _BLANKS and self.text[self.at] != self.delim:
            self.at += 1

    def ends(self) -> bool:
        return self.at >= self.end

    def quoted(self) -> str:
        begin, out = self.at, []
        self.at += 1
        while True:
            close = self.text.find('"', self.at, self.end)
            if close < 0:
                raise Broken("quoting", begin, "mark isn't closed")
            out.append(self.text[self.at : close])
            self.at = close + 1
            if self.at >= self.end or self.text[self.at] != '"':
                return "".join(out)
            out.append('"')
            self.at += 1

    def plain(self) -> str:
        if self.delim == "space":
            m = _WORD.match(self.text, self.at, self.end)
            self.at = m.end()
            return m[0]
        close = self.text.find(self.delim, self.at, self.end)
        close = self.end if close < 0 else close
        value = self.text[self.at : close]
        self.at = close
        return value.rstrip(_BLANKS)

    def value(self) -> tuple[str, int]:
        """A value and its place."""
        self.blanks()
        begin = self.at
        if self.ends() or self.text[self.at] != '"':
            return self.plain(), begin
        value, end = self.quoted(), self.at
        self.blanks()
        if not self.ends() and (self.at == end if self.delim == "space" else self.text[self.at] != self.delim):
            raise Broken("quoting", self.at, "text after the closing mark")
        return value, begin

    def values(self) -> list[tuple[str, int]]:
        out = []
        if self.delim == "space":
            self.blanks()
            while not self.ends():
                out.append(self.value())
                self.blanks()
            return out
        while True:
            out.append(self.value())
            if self.ends():
                return out
            self.at += 1

    def word(self, what: str) -> tuple[str, int]:
        self.blanks()
        if self.ends():
            raise Broken("columns", self.at, f"{what} is missing")
        begin = self.at
        return self.plain(), begin

    def xyz(self, cols: list[str]) -> dict:
        values = self.values()
        if len(values) != len(cols):
            raise Broken("columns", values[len(cols)][1] if len(values) > len(cols) else self.end, f"{len(values)} values for {len(cols)} columns")
        out: dict = {"rest": {}}
        for name, (text, at) in zip(cols, values):
            if name == "id":
                if not _WHOLE.fullmatch(text):
                    raise Broken("value", at, f"id is no whole number: {text[:40]}")
                out["rest"][name] = text
            elif name in BOUNDS:
                v = _number(name, text, at)
                if (b := BOUNDS[name]) and not b[0] <= v <= b[1]:
                    raise Broken("value", at, f"{name} is beyond its bounds: {text[:40]}")
                out[SAME.get(name, name)] = -v if name == "depth" else v
            else:
                out["rest"][name] = text
        return out

    def entry(self) -> dict:
        self.delim = "space"
        (path, _), (fmt, fmt_at), (weight, weight_at) = self.word("path"), self.word("fmt"), self.word("weight")
        self.blanks()
        rest = {"path": path, "fmt": fmt}
        if not self.ends():
            self.delim = ","
            rest["metadata"] = "\x1f".join(v for v, _ in self.values())
        if not _INTEGER.fullmatch(fmt) or int(fmt) not in FORMATS:
            raise Broken("value", fmt_at, f"fmt is unknown: {fmt[:40]}")
        w = _number("weight", weight, weight_at)
        if w < 0:
            raise Broken("value", weight_at, "weight is negative")
        return {"w": w, "rest": rest}


def _number(name: str, text: str, at: int) -> float:
    if not _NUMBER.fullmatch(text) or (v := float(text)) in (float("inf"), float("-inf")):
        raise Broken("value", at, f"{name} is no number: {text[:40]}")
    return v


def records(lines: list[str], rule: Callable[[Grammar, int], dict]) -> Iterator[tuple[int, dict | Broken]]:
    """(number of the line, record or error) of every line, read as one text. ``rule`` is applied at each record start; the place
    of an error counts from its line's start."""
    anchors, at = [], 0
    for line in lines:
        anchors.append(at)
        at += len(line) + 1
    g, k = Grammar("\n".join(lines), anchors=anchors), 0
    while k < len(anchors):
        g.begin(k)
        try:
            yield k, rule(g, k)
            k += 1
        except Broken as e:
            after = g.behind(max(min(e.at, g.end), anchors[k]))  # resumes at the next anchor
            e.at -= anchors[k]
            yield k, e
            k = after


def xyz_record(line: str, delim: str, cols: list[str]) -> dict:
    return Grammar(line, delim).xyz(cols)


def datalist_record(line: str) -> dict:
    return Grammar(line).entry()


SCHEMA = "raw_id bigint, line_no int, reason string, col int, detail string, x double, y double, z double, w double, rest map<string,string>"

def _split() -> Column:
    """The values of a line without quotes: between delimiters, or words."""
    sign = F.lit("\x01")
    between = F.transform(F.split(F.replace("line", "delim", sign), "\x01"), lambda v: F.btrim(v, F.lit(_BLANKS)))
    words = F.filter(F.split(F.translate("line", "\t", " "), " "), lambda v: v != "")
    return F.when((F.col("delim") == "space") | (F.col("fmt") == DATALIST), words).otherwise(between)


def _in(v: Column, low: float | None = None, high: float | None = None) -> Column:
    n = v.try_cast("double")
    ok = v.rlike(rf"\A(?:{_NUMBER.pattern})\z") & (F.abs(n) < float("inf"))
    return ok if low is None else ok & n.between(low, float("inf") if high is None else high)


def _valid() -> Column:
    """Is the line surely a valid record? Whatever has quotes or isn't plain is left to the grammar."""
    each = lambda n, v: (
        F.when(n == "id", v.rlike(rf"\A{_WHOLE.pattern}\z")).when(n.isin("x", "lon"), _in(v, *BOUNDS["x"])).when(n.isin("y", "lat"), _in(v, *BOUNDS["y"])).when(n.isin("z", "w", "depth"), _in(v)).otherwise(F.lit(True))
    )
    meaning = F.transform("names", lambda n: F.when(n == "lon", "x").when(n == "lat", "y").when(n == "depth", "z").otherwise(n))
    xyz = (F.size("vals") == F.size("names")) & (F.size(F.array_distinct(meaning)) == F.size("names")) & F.forall(F.zip_with("names", "vals", each), lambda ok: ok)
    entry = (F.size("vals") == 3) & F.get("vals", F.lit(1)).isin(*map(str, FORMATS)) & _in(F.get("vals", F.lit(2)), 0.0)
    plain = ~F.contains("line", F.lit('"')) & ~F.contains("line", F.lit("\x01"))
    return plain & F.when(F.col("fmt") == DATALIST, entry).otherwise(xyz)


def _record() -> list[Column]:
    """The typed record of a line that is surely valid."""
    values = F.map_from_arrays("names", "vals")
    number = lambda *names: F.coalesce(*[values[n].try_cast("double") * s for n, s in names])
    xyz = lambda c: F.when(F.col("fmt") == XYZ, c)
    entry = F.map_from_arrays(F.array(F.lit("path"), F.lit("fmt")), F.slice("vals", 1, 2))
    rest = F.when(F.col("fmt") == DATALIST, entry).otherwise(F.map_filter(values, lambda k, v: ~k.isin(*BOUNDS)))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    weight = F.when(F.col("fmt") == DATALIST, F.get("vals", F.lit(2)).try_cast("double")).otherwise(number(("w", 1)))
    return [none("reason", "string"), none("col", "int"), none("detail", "string"), xyz(number(("x", 1), ("lon", 1))).alias("x"), xyz(number(("y", 1), ("lat", 1))).alias("y"), xyz(number(("z", 1), ("depth", -1))).alias("z"), weight.alias("w"), rest.alias("rest")]


def parse_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per data line of the files: raw_id, line_no, then either reason, col and detail of its error or the typed record
    (x, y, z up, w, rest: other values by name, a datalist's metadata joined by unit separators).

    A null line is a blank one; lines of no known file, and of files with another fmt, have no grammar and give no rows; a
    null skip is 0; an xyz file whose cols are null takes x,y,z; a line of any length is parsed whole. Rows that repeat
    (raw_id, line_no) are parsed each; of rows that repeat a raw_id in files the least counts. Other columns are left out."""
    f = files.groupBy("raw_id").agg(F.min(F.struct("fmt", "delim", "skip", "cols")).alias("f")).select("raw_id", "f.*").where(F.col("raw_id").isNotNull() & F.col("fmt").isin(XYZ, DATALIST))
    data = lines.select("raw_id", "line_no", "line").where(F.col("line").rlike(r"^\s*[^\s#]"))
    # the delimiter of a file without one is found in its first data line
    unknown = f.where("fmt = 168 and delim is null").select("raw_id", "skip")
    first = data.join(unknown, "raw_id").where(F.col("line_no") > F.coalesce("skip", F.lit(0))).groupBy("raw_id").agg(F.min_by("line", "line_no").alias("head"))
    place = lambda c: F.expr(f"nullif(instr(head, '{c}'), 0) is not null")
    found = F.when(place(","), ",").when(place("/"), "/").when(place(":"), ":").otherwise("space")
    f = f.join(first.select("raw_id", found.alias("found")), "raw_id", "left")
    f = f.select("raw_id", "fmt", F.coalesce(F.when(F.col("delim") == "tab", "\t").otherwise(F.col("delim")), "found", F.lit("space")).alias("delim"), F.coalesce("skip", F.lit(0)).alias("skip"), F.coalesce("cols", F.lit("x,y,z")).alias("cols"))
    work = data.join(f, "raw_id").where("line_no > skip").select("raw_id", "line_no", "line", "fmt", "delim", "cols")
    names = F.transform(F.split(F.lower("cols"), ","), lambda n: F.btrim(n, F.lit(_BLANKS)))
    work = work.withColumns({"names": names, "vals": _split()}).withColumn("plain", F.coalesce(_valid(), F.lit(False)))
    taken = work.where("plain").select("raw_id", "line_no", *_record())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[str, list[str]] = {}
        for b in batches:
            fmt, delim, cols = b["fmt"].tolist(), b["delim"].tolist(), b["cols"].tolist()

            def rule(g: Grammar, k: int) -> dict:
                if fmt[k] == DATALIST:
                    return g.entry()
                g.delim = delim[k]
                return g.xyz(names.get(cols[k]) or names.setdefault(cols[k], [c.strip(_BLANKS) for c in cols[k].lower().split(",")]))

            out = []
            for k, r in records(b["line"].tolist(), rule):
                if isinstance(r, Broken):
                    out.append((r.reason, r.at + 1, r.text, None, None, None, None, None))
                else:
                    out.append((None, None, None, r.get("x"), r.get("y"), r.get("z"), r.get("w"), r["rest"]))
            d = pd.DataFrame(out, columns=["reason", "col", "detail", "x", "y", "z", "w", "rest"])
            d.insert(0, "raw_id", b["raw_id"].tolist())
            d.insert(1, "line_no", b["line_no"].astype("Int32").tolist())
            yield d.astype({"line_no": "Int32", "col": "Int32", "x": "float64", "y": "float64", "z": "float64", "w": "float64"})

    doubtful = work.where("not plain").select("raw_id", "line_no", "line", "fmt", "delim", "cols")
    return taken.unionByName(doubtful.mapInPandas(run, SCHEMA))
