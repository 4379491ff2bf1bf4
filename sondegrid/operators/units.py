"""Quantities in different units: an alias dictionary of the distinct spellings, joined to all rows.

Distinct texts are cut into phrases of one to three words. Each distinct phrase is looked up in a lexicon through an
inverted index of character n-grams; candidates are verified by a weighted edit distance. The n-grams are single characters
numbered by occurrence, because of them an edit destroys at most one (a swap of neighbours destroys every 2-gram around it,
so that no count of 2-grams follows from the distance); an alias is a candidate unless more are missing than the distance
allows edits, which leaves no spelling out that the verification would accept. A text means the unit and the
direction of its longest phrase that is known, the earliest of equally long ones.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sondegrid.session import checked_broadcast, materialize

#: Spellings of units and directions (fixed values); others are found by likeness.
LEXICON = {
    "metre": "m metre metres meter meters",
    "decimetre": "dm decimetre decimetres decimeter decimeters",
    "centimetre": "cm centimetre centimetres centimeter centimeters",
    "millimetre": "mm millimetre millimetres millimeter millimeters",
    "foot": "ft foot feet",
    "us_foot": "usft ftus",
    "fathom": "fm fathom fathoms",
    "up": "up height heights elevation elevations",
    "down": "down depth depths sounding soundings",
}
PHRASES = {
    "foot": ["intl ft", "international foot", "international feet"],
    "us_foot": ["us ft", "us foot", "us feet", "us survey foot", "us survey feet", "survey ft us", "survey foot us", "survey feet us", "survey foot", "survey feet", "survey ft", "us survey ft"],
}
DIRECTIONS = ("up", "down")
#: Metres a unit (fixed values).
METRES = {"metre": 1.0, "degree": 1.0, "decimetre": 0.1, "centimetre": 0.01, "millimetre": 0.001, "foot": 0.3048, "us_foot": 1200 / 3937, "fathom": 1.8288}
LIKENESS = 0.2
#: The least cost of an edit, and the letters below which a word must be spelt exactly.
EDIT, SHORT = 0.5, 5


def distance(a: str, b: str) -> float:
    """Edit distance: 1 an edit, half for a vowel against a vowel, a doubled letter and a swap of neighbours."""
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                rows[i][j] = float(i + j)
                continue
            x, y = a[i - 1], b[j - 1]
            swap = 0.0 if x == y else 0.5 if x in "aeiou" and y in "aeiou" else 1.0
            drop = 0.5 if i > 1 and a[i - 2] == x else 1.0
            add = 0.5 if j > 1 and b[j - 2] == y else 1.0
            least = min(rows[i - 1][j - 1] + swap, rows[i - 1][j] + drop, rows[i][j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                least = min(least, rows[i - 2][j - 2] + 0.5)
            rows[i][j] = least
    return rows[-1][-1]


def unlikeness(phrase: str, alias: str) -> float | None:
    """Sum of the words' distances, or None: short words must be equal, others alike."""
    a, b = phrase.split(" "), alias.split(" ")
    if len(a) != len(b):
        return None
    total = 0.0
    for x, y in zip(a, b):
        if x != y:
            if len(y) < SHORT or abs(len(x) - len(y)) > 2 or (d := distance(x, y)) > LIKENESS * len(y):
                return None
            total += d
    return total


def lexicon(spark) -> DataFrame:
    """(alias, meaning, need): the fixed list above, some 50 rows, and the characters a spelling of the alias has at least."""
    pairs = [(a, m) for m, words in LEXICON.items() for a in words.split()] + [(a, m) for m, all_ in PHRASES.items() for a in all_]
    need = lambda a: sum(len(w) - (int(LIKENESS * len(w) / EDIT + 1e-9) if len(w) >= SHORT else 0) for w in a.split(" "))
    return spark.createDataFrame([(a, m, need(a)) for a, m in pairs], "alias string, meaning string, need int")


def _grams(c: str) -> Column:
    """The characters of a phrase, each with the number of its occurrence."""
    chars = F.split(F.replace(F.col(c), F.lit(" "), F.lit("")), "")
    chars = F.filter(chars, lambda x: x != "")
    return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string")))


def alias_dictionary(texts: DataFrame, text_col: str) -> DataFrame:
    """(text, unit, direction) of each distinct text that names either; null texts have no row."""
    spark = texts.sparkSession
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    d = texts.select(F.col(f"`{text_col}`").alias("text")).where("text is not null").distinct().withColumn("w", words).where(F.size("w") > 0)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i + n - 1 <= F.size("w")), lambda i: F.struct(n.alias("n"), i.alias("i"), F.array_join(F.slice("w", i, n), " ").alias("phrase")))))
    said = d.select("text", F.explode(spans).alias("s")).select("text", "s.n", "s.i", "s.phrase")
    phrases = said.select("phrase").distinct()
    index = lexicon(spark).withColumn("g", F.explode(_grams("alias")))
    asked = phrases.withColumn("g", F.explode(_grams("phrase")))
    near = asked.join(index, "g").groupBy("phrase", "alias", "meaning").agg(F.count("*").alias("common"), F.max("need").alias("need"))
    near = near.where("common >= need")

    @F.pandas_udf("double")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([unlikeness(x, y) for x, y in zip(a, b)], dtype="float64")

    near = near.withColumn("apart", apart("phrase", "alias"))
    near = near.where(F.col("apart").isNotNull())
    known = near.groupBy("phrase").agg(F.min(F.struct("apart", "alias", "meaning")).alias("m")).select("phrase", "m.meaning")
    found = said.join(known, "phrase").withColumn("at", F.struct((-F.col("n")).alias("n"), "i"))
    way = F.col("meaning").isin(*DIRECTIONS)
    return found.groupBy("text").agg(F.min_by(F.when(~way, F.col("meaning")), F.when(~way, F.col("at"))).alias("unit"), F.min_by(F.when(way, F.col("meaning")), F.when(way, F.col("at"))).alias("direction"))


def number(c: Column) -> Column:
    """A numeric text (decimal comma, exponent, fraction) as double, else null."""
    one = r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?"
    t = F.trim(c)
    part = lambda i: F.regexp_replace(F.element_at(F.split(t, "/"), i), ",", ".").try_cast("double")
    return F.when(t.rlike(f"^{one}$"), part(1)).when(t.rlike(rf"^{one}\s*/\s*{one}$"), part(1) / F.nullif(part(-1), F.lit(0.0)))


def code_dictionary(texts: DataFrame, text_col: str, units: DataFrame) -> DataFrame:
    """(text, vertical unit and direction, horizontal unit) of each distinct text with codes of the table of units; of several
    codes of an axis the first counts."""
    d = texts.select(F.col(f"`{text_col}`").alias("code_text")).where("code_text is not null").distinct()
    codes = d.select("code_text", F.posexplode(F.regexp_extract_all("code_text", F.lit(r"(\d+)"), 1)).alias("p", "c"))
    u = units.select(F.col("epsg").cast("string").alias("c"), "axis", "unit", "positive").distinct()
    got = codes.withColumn("c", F.regexp_replace("c", "^0+", "")).join(u, "c")
    first = lambda axis, c: F.min_by(F.when(F.col("axis") == axis, F.col(c)), F.when(F.col("axis") == axis, F.col("p")))
    return got.groupBy("code_text").agg(first("vertical", "unit").alias("v_unit"), first("vertical", "positive").alias("v_way"), first("horizontal", "unit").alias("h_unit"))


def _factor(unit: Column) -> Column:
    return reduce(lambda e, kv: e.when(unit == kv[0], F.lit(kv[1])), METRES.items(), F.when(F.lit(False), F.lit(1.0)))


def to_millimetres(marks: DataFrame, units: DataFrame) -> DataFrame:
    """(mark_id, z_mm, h_mm) of each mark with finite zpos and h_unc; a result beyond the range of a bigint is null.

    Null, NaN and infinite values give no row; a text that names no known unit counts as missing; rows that repeat a mark_id
    count once; a null mark_id is one mark; other columns are left out; an empty table gives no rows."""
    cols = ["zpos", "h_unc", "z_scale", "epsg", "vdatum", "hdatum"]
    m = marks.select("mark_id", *cols).groupBy("mark_id").agg(F.min(F.struct(*cols)).alias("r")).select("mark_id", "r.*")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    m = m.where(finite("zpos") & finite("h_unc")).withColumn("number", number(F.col("z_scale")))
    m = materialize(m, "unit-marks")  # read three times below
    said = [m.where("number is null").select(F.col("z_scale").alias("t")), m.select(F.col("vdatum").alias("t")), m.select(F.col("hdatum").alias("t"))]
    # distinct spellings are few whatever the rows; sent to all executors if so, and joined by shuffle if not
    words = checked_broadcast(alias_dictionary(reduce(DataFrame.unionByName, said), "t"), "unit-aliases")
    codes = checked_broadcast(code_dictionary(m, "epsg", units), "unit-codes")
    for c in ("z_scale", "vdatum", "hdatum"):
        m = m.join(words.select(F.col("text").alias(c), F.col("unit").alias(f"{c}_unit"), F.col("direction").alias(f"{c}_way")), c, "left")
    m = m.join(codes.withColumnRenamed("code_text", "epsg"), "epsg", "left")
    unit = F.coalesce("z_scale_unit", "vdatum_unit", "v_unit", F.lit("metre"))
    way = F.coalesce("z_scale_way", "vdatum_way", "v_way", F.lit("up"))
    z = F.when(F.col("number").isNotNull(), F.col("zpos") * F.col("number")).otherwise(F.col("zpos") * F.coalesce(_factor(unit), F.lit(1.0)) * F.when(way == "down", -1).otherwise(1))
    h = F.col("h_unc") * F.coalesce(_factor(F.coalesce("hdatum_unit", "h_unit", F.lit("metre"))), F.lit(1.0))
    return m.select("mark_id", F.round(z * 1000).try_cast("bigint").alias("z_mm"), F.round(h * 1000).try_cast("bigint").alias("h_mm"))
