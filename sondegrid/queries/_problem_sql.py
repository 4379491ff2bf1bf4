"""SQL of the problems' queries: the rules of the task written down again, apart from the operators."""

from __future__ import annotations

# --- 1 ---------------------------------------------------------------------------------------------------------------
P1 = r"""
WITH e AS (SELECT entry_id, min(metadata) AS m FROM datalist_entries GROUP BY entry_id),
t AS (SELECT entry_id, regexp_extract_all(m || ',', ' *(?:"(?:[^"]|"")*" *|''(?:[^'']|'''')*'' *|[^,;|\t]*)[,;|\t]') AS v FROM e WHERE regexp_matches(m, '\S')),
u AS (SELECT entry_id, unnest(v) AS v, generate_subscripts(v, 1) AS pos FROM t),
s AS (SELECT entry_id, pos, trim(left(v, length(v) - 1), ' ') AS v FROM u)
SELECT entry_id, CAST(pos AS INT) AS pos, CASE
 WHEN length(v) > 1 AND left(v, 1) = '"' AND right(v, 1) = '"' THEN replace(substr(v, 2, length(v) - 2), '""', '"')
 WHEN length(v) > 1 AND left(v, 1) = '''' AND right(v, 1) = '''' THEN replace(substr(v, 2, length(v) - 2), '''''', '''')
 ELSE v END AS val FROM s
"""

# --- 2 ---------------------------------------------------------------------------------------------------------------
_P2 = r"""WITH d AS (SELECT DISTINCT l.raw_id, f.fetched_at AS got, regexp_replace(l.line, '^\s+|\s+$', '', 'g') AS t
 FROM raw_lines l JOIN raw_files f ON l.raw_id = f.raw_id WHERE l.line_no > coalesce(f.skip, 0) AND regexp_matches(l.line, '^\s*[^\s#]')),
n AS (SELECT raw_id, got, count(*) AS n FROM d GROUP BY raw_id, got),
p AS (SELECT a.raw_id AS a, b.raw_id AS b, count(*) AS c FROM d a JOIN d b ON a.t = b.t AND a.raw_id <> b.raw_id GROUP BY 1, 2),
found AS (SELECT DISTINCT a AS raw_id FROM p JOIN n x ON p.a = x.raw_id JOIN n y ON p.b = y.raw_id
 WHERE c = x.n AND (y.n > x.n OR (y.n = x.n AND (y.got < x.got OR (y.got = x.got AND y.raw_id < x.raw_id))))) """
P2 = _P2 + "SELECT raw_id FROM found"
P2_COMPACTED = _P2 + "SELECT raw_id, line_no, line FROM raw_lines WHERE raw_id NOT IN (SELECT raw_id FROM found)"

P2_SMALL_FILES = """WITH a AS (SELECT count(*) AS records, CAST(sum(length(line)) AS BIGINT) AS chars FROM raw_lines WHERE raw_id IN (SELECT raw_id FROM raw_files WHERE fmt = 168))
SELECT 'first' AS step, records, chars FROM a UNION ALL SELECT 'again', records, chars FROM a UNION ALL SELECT 'all', count(*), CAST(sum(length(line)) AS BIGINT) FROM raw_lines"""

P2_SOUNDINGS = """WITH once AS (SELECT DISTINCT sounding_id, file_id, xpos, ypos, zpos, weight FROM soundings),
f AS (SELECT file_id, min(loaded_at) AS got FROM inf_files GROUP BY file_id),
d AS (SELECT DISTINCT o.file_id, f.got, coalesce(CAST(xpos AS VARCHAR), '') || ' ' || coalesce(CAST(ypos AS VARCHAR), '') || ' ' || coalesce(CAST(zpos AS VARCHAR), '') || ' ' || coalesce(CAST(weight AS VARCHAR), '') AS t FROM once o JOIN f ON o.file_id = f.file_id),
n AS (SELECT file_id, got, count(*) AS n FROM d GROUP BY file_id, got),
p AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS c FROM d a JOIN d b ON a.t = b.t AND a.file_id <> b.file_id GROUP BY 1, 2),
found AS (SELECT DISTINCT a AS file_id FROM p JOIN n x ON p.a = x.file_id JOIN n y ON p.b = y.file_id
 WHERE c = x.n AND (y.n > x.n OR (y.n = x.n AND (y.got < x.got OR (y.got = x.got AND y.file_id < x.file_id)))))
SELECT file_id, count(*) AS records FROM once WHERE file_id NOT IN (SELECT file_id FROM found) GROUP BY file_id"""

# --- 3 ---------------------------------------------------------------------------------------------------------------
_UNITS = [("1200.0E0 / 3937", r"us survey f(?:ee|oo)t|survey ft \(us\)|us[_ ]?ft|ftus"), ("0.3048E0", "intl ft|ft|feet|foot"), ("1.8288E0", "fm|fathoms?"), ("0.01E0", "cm|centimet(?:re|er)s?"), ("0.001E0", "mm|millimet(?:re|er)s?"), ("0.1E0", "dm|decimet(?:re|er)s?"), ("1.0E0", "m|met(?:re|er)s?")]


def _unit(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '(^|[^a-z0-9_])({p})($|[^a-z0-9_])') THEN {f}" for f, p in _UNITS) + " END"


def _way(c: str) -> str:
    return rf"CASE WHEN regexp_matches(lower({c}), '\b(down|depth|soundings?)\b') THEN -1 WHEN regexp_matches(lower({c}), '\b(up|height|elevation)\b') THEN 1 END"


_ONE = r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?"
_CODE_UNIT = "CASE unit WHEN 'foot' THEN 0.3048E0 WHEN 'us_foot' THEN 1200.0E0 / 3937 ELSE 1 END"
P3 = rf"""
WITH m AS (SELECT DISTINCT mark_id, zpos, h_unc, trim(z_scale) AS zs, epsg, vdatum, hdatum FROM spot_heights WHERE zpos IS NOT NULL AND h_unc IS NOT NULL AND NOT isnan(zpos) AND NOT isnan(h_unc)),
c AS (SELECT DISTINCT mark_id, CAST(unnest(regexp_extract_all(epsg, '\d+')) AS INT) AS code FROM m),
v AS (SELECT mark_id, max(CASE WHEN axis = 'vertical' THEN {_CODE_UNIT} END) AS vu, max(CASE WHEN axis = 'vertical' THEN CASE positive WHEN 'down' THEN -1 ELSE 1 END END) AS vw, max(CASE WHEN axis = 'horizontal' THEN {_CODE_UNIT} END) AS hu FROM c JOIN crs_units u ON c.code = u.epsg GROUP BY mark_id),
n AS (SELECT m.*, v.vu, v.vw, v.hu, CASE WHEN regexp_full_match(zs, '{_ONE}') THEN CAST(replace(zs, ',', '.') AS DOUBLE)
 WHEN regexp_full_match(zs, '{_ONE}/{_ONE}') THEN CAST(replace(split_part(zs, '/', 1), ',', '.') AS DOUBLE) / CAST(replace(split_part(zs, '/', 2), ',', '.') AS DOUBLE) END AS num FROM m LEFT JOIN v ON m.mark_id = v.mark_id)
SELECT mark_id, CAST(round(1000 * CASE WHEN num IS NOT NULL THEN zpos * num ELSE zpos * coalesce({_unit("zs")}, {_unit("vdatum")}, vu, 1) * coalesce({_way("zs")}, {_way("vdatum")}, vw, 1) END) AS BIGINT) AS z_mm,
 CAST(round(1000 * h_unc * coalesce({_unit("hdatum")}, hu, 1)) AS BIGINT) AS h_mm FROM n
"""


# --- 4 ---------------------------------------------------------------------------------------------------------------
def _spike() -> str:
    at = {0: "z"} | {-k: f"a{k}" for k in (1, 2, 3)} | {k: f"b{k}" for k in (1, 2, 3)}
    out = []
    for n in (1, 2, 3):
        for first in range(1 - n, 1):
            run, a, b = [at[first + i] for i in range(n)], at[first - 1], at[first + n]
            whole = " AND ".join(f"{c} IS NOT NULL" for c in (a, b, *run))
            low, high = (run[0], run[0]) if n == 1 else (f"least({', '.join(run)})", f"greatest({', '.join(run)})")
            out.append(f"({whole} AND ({low} > greatest({a}, {b}) + t OR {high} < least({a}, {b}) - t))")
    return " OR ".join(out)


P4_FAULTS = f"""
WITH r AS (SELECT DISTINCT sounding_id, file_id, line_no, source_id, zpos AS z FROM soundings WHERE zpos IS NOT NULL AND NOT isnan(zpos)),
w AS (SELECT *, {", ".join(f"lag(z, {k}) OVER o AS a{k}, lead(z, {k}) OVER o AS b{k}" for k in (1, 2, 3))} FROM r WINDOW o AS (PARTITION BY file_id ORDER BY line_no)),
q AS (SELECT source_id, 8 * quantile_disc(abs(z - a1), 0.75) AS t FROM w WHERE a1 IS NOT NULL AND NOT isinf(z) AND NOT isinf(a1) GROUP BY source_id),
g AS (SELECT *, sum(CASE WHEN a1 IS NULL OR a1 <> z THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS run FROM w),
l AS (SELECT file_id, run, min(source_id) AS source_id, count(*) AS n FROM g GROUP BY file_id, run),
u AS (SELECT source_id, quantile_disc(n, 0.95) AS usual FROM l GROUP BY source_id),
s AS (SELECT source_id, CASE WHEN lower_limit > upper_limit THEN upper_limit ELSE lower_limit END AS lo, CASE WHEN lower_limit > upper_limit THEN lower_limit ELSE upper_limit END AS hi FROM xyz_sources)
SELECT * FROM (SELECT g.sounding_id, coalesce(z < -11000 OR z > 9000 OR z <= lo OR z >= hi, false) AS impossible, coalesce({_spike()}, false) AS spike, coalesce(l.n >= 10 AND l.n > 3 * usual, false) AS stuck FROM g LEFT JOIN q ON g.source_id = q.source_id LEFT JOIN s ON g.source_id = s.source_id LEFT JOIN u ON g.source_id = u.source_id
 JOIN l ON g.file_id = l.file_id AND g.run = l.run) WHERE impossible OR spike OR stuck
"""
P4 = f"SELECT sounding_id FROM ({P4_FAULTS})"

# --- 5 ---------------------------------------------------------------------------------------------------------------
_NUM = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _delimited(d: str) -> str:
    """Lines of files with one delimiter: well quoted?, values."""
    blank = " " if d == "\t" else r" \t"
    c = r"\t" if d == "\t" else "\\|" if d == "|" else d
    value = rf'[{blank}]*(?:"(?:[^"]|"")*"[{blank}]*|[^"{blank}{c}][^{c}]*|)'
    lit = "chr(9)" if d == "\t" else f"'{d}'"
    return rf"""SELECT raw_id, line_no, cols, regexp_full_match(line, '(?:{value}{c})*{value}') AS well,
 list_transform(regexp_extract_all(line || {lit}, '{value}{c}'), lambda v: regexp_replace(left(v, length(v) - 1), '^[{blank}]+|[{blank}]+$', '', 'g')) AS v FROM x WHERE dl = {lit}"""


_SPACED = r'(?:"(?:[^"]|"")*"|[^" \t][^ \t]*)'
_P5 = rf"""
WITH d AS (SELECT l.raw_id, l.line_no, l.line, f.fmt, f.delim, f.cols, coalesce(f.skip, 0) AS skip FROM raw_lines l JOIN raw_files f ON l.raw_id = f.raw_id
 WHERE l.line_no > coalesce(f.skip, 0) AND regexp_matches(l.line, '^\s*[^\s#]')),
h AS (SELECT raw_id, arg_min(line, line_no) AS head FROM d GROUP BY raw_id),
x AS (SELECT d.raw_id, line_no, line, cols, CASE WHEN delim = 'tab' THEN chr(9) WHEN delim IS NOT NULL THEN delim WHEN head LIKE '%,%' THEN ',' WHEN head LIKE '%/%' THEN '/' WHEN head LIKE '%:%' THEN ':' ELSE 'space' END AS dl
 FROM d JOIN h ON d.raw_id = h.raw_id WHERE fmt = 168),
v AS ({" UNION ALL ".join(_delimited(c) for c in (",", ";", "|", ":", "/", chr(9)))}
 UNION ALL SELECT raw_id, line_no, cols, regexp_full_match(line, '[ \t]*{_SPACED}(?:[ \t]+{_SPACED})*[ \t]*'), regexp_extract_all(line, '{_SPACED}') FROM x WHERE dl = 'space'),
n AS (SELECT *, string_split(cols, ',') AS c FROM v),
e AS (SELECT raw_id, line_no, unnest(c) AS name, unnest(v) AS t FROM n WHERE well AND len(v) = len(c)),
k AS (SELECT raw_id, line_no, name, CASE WHEN left(t, 1) = '"' THEN replace(substr(t, 2, length(t) - 2), '""', '"') ELSE t END AS t FROM e),
b AS (SELECT DISTINCT raw_id, line_no FROM k WHERE CASE
 WHEN name = 'id' THEN NOT regexp_matches(t, '^[0-9]+$')
 WHEN name IN ('x', 'lon') THEN NOT regexp_matches(t, '{_NUM}') OR NOT coalesce(TRY_CAST(t AS DOUBLE) BETWEEN -180 AND 360, false)
 WHEN name IN ('y', 'lat') THEN NOT regexp_matches(t, '{_NUM}') OR NOT coalesce(TRY_CAST(t AS DOUBLE) BETWEEN -90 AND 90, false)
 WHEN name IN ('z', 'w', 'depth') THEN NOT regexp_matches(t, '{_NUM}') OR TRY_CAST(t AS DOUBLE) IS NULL OR isinf(TRY_CAST(t AS DOUBLE)) ELSE false END),
g AS (SELECT raw_id, line_no, regexp_extract(line, '^\s*(\S+)[ \t]+(\S+)[ \t]+(\S+)[ \t]*(.*)$', ['p', 'f', 'w', 'm']) AS r FROM d WHERE fmt = -1),
y AS (SELECT raw_id, line_no, CASE WHEN r.w = '' THEN 'columns'
 WHEN NOT regexp_full_match(r.m, '(?:[ \t]*(?:"(?:[^"]|"")*"[ \t]*|[^" \t,][^,]*|),)*[ \t]*(?:"(?:[^"]|"")*"[ \t]*|[^" \t,][^,]*|)') THEN 'quoting'
 WHEN r.f NOT IN ('-1', '-2', '-4', '168', '200', '300') OR NOT regexp_matches(r.w, '{_NUM}') OR coalesce(TRY_CAST(r.w AS DOUBLE) < 0, true) OR isinf(TRY_CAST(r.w AS DOUBLE)) THEN 'value' END AS reason FROM g)
"""
P5 = (
    _P5
    + """SELECT raw_id, line_no, 'quoting' AS reason FROM n WHERE NOT well UNION ALL SELECT raw_id, line_no, 'columns' FROM n WHERE well AND len(v) <> len(c)
 UNION ALL SELECT raw_id, line_no, 'value' FROM b UNION ALL SELECT raw_id, line_no, reason FROM y WHERE reason IS NOT NULL
"""
)
P5_NUMBERS = (
    _P5
    + """SELECT k.raw_id, k.line_no, CAST(max(CASE WHEN name IN ('x', 'lon') THEN TRY_CAST(t AS DOUBLE) END) AS DOUBLE) AS x, max(CASE WHEN name IN ('y', 'lat') THEN TRY_CAST(t AS DOUBLE) END) AS y,
 max(CASE WHEN name = 'z' THEN TRY_CAST(t AS DOUBLE) WHEN name = 'depth' THEN -TRY_CAST(t AS DOUBLE) END) AS z, max(CASE WHEN name = 'w' THEN TRY_CAST(t AS DOUBLE) END) AS w
 FROM k LEFT JOIN b ON k.raw_id = b.raw_id AND k.line_no = b.line_no WHERE b.raw_id IS NULL GROUP BY k.raw_id, k.line_no
 UNION ALL SELECT y.raw_id, y.line_no, NULL, NULL, NULL, CAST(g.r.w AS DOUBLE) FROM y JOIN g ON y.raw_id = g.raw_id AND y.line_no = g.line_no WHERE reason IS NULL"""
)

# --- 7 ---------------------------------------------------------------------------------------------------------------
_N = r"[+-]?\d+(?:\.\d*)?"
_PT = rf"\s*{_N}\s+{_N}(?:\s+{_N})?\s*"
_RING = rf"\s*\({_PT}(?:,{_PT})*\)\s*"
_POLY = rf"\s*\({_RING}(?:,{_RING})*\)\s*"
P7 = rf"""
WITH m AS (SELECT DISTINCT mark_id, xpos - 360 * floor((xpos + 180) / 360) AS x, ypos AS y FROM spot_heights WHERE xpos IS NOT NULL AND ypos IS NOT NULL AND NOT isnan(xpos) AND NOT isnan(ypos) AND abs(ypos) <= 90),
near AS (SELECT a.mark_id AS a, b.mark_id AS b FROM m a JOIN m b ON a.mark_id < b.mark_id AND b.y BETWEEN a.y - 0.001 AND a.y + 0.001
 WHERE 2 * 6371008.8E0 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) <= 100),
f AS (SELECT DISTINCT file_id, wkt, minmax AS b FROM inf_files),
g AS (SELECT file_id, b, regexp_full_match(wkt, '(?i)\s*(?:srid=\d+;)?\s*(?:polygon\s*z?{_POLY}|multipolygon\s*z?\s*\({_POLY}(?:,{_POLY})*\)\s*)') AS whole, regexp_extract_all(wkt, '\(([^()]+)\)', 1) AS rings FROM f),
r AS (SELECT file_id, unnest(rings) AS ring, generate_subscripts(rings, 1) AS k FROM g WHERE whole
 UNION ALL SELECT file_id, b[1] || ' ' || b[3] || ',' || b[2] || ' ' || b[3] || ',' || b[2] || ' ' || b[4] || ',' || b[1] || ' ' || b[4], 1 FROM g WHERE NOT coalesce(whole, false) AND b IS NOT NULL AND NOT (b[1] = 0 AND b[2] = 0 AND b[3] = 0 AND b[4] = 0)),
p AS (SELECT file_id, k, unnest(string_split(ring, ',')) AS t, generate_subscripts(string_split(ring, ','), 1) AS i, len(string_split(ring, ',')) AS n FROM r),
c AS (SELECT file_id, k, i, n, CAST(regexp_extract(t, '({_N})\s+({_N})', 1) AS DOUBLE) AS x, CAST(regexp_extract(t, '({_N})\s+({_N})', 2) AS DOUBLE) AS y FROM p),
e AS (SELECT a.file_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON a.file_id = b.file_id AND a.k = b.k AND b.i = a.i % a.n + 1),
box AS (SELECT file_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY file_id),
t AS (SELECT mark_id, x + 360 * s.range - 360 AS x, y FROM m, range(4) s),
z AS (SELECT t.mark_id, t.x, t.y, box.file_id FROM t JOIN box ON t.y BETWEEN y0 AND y1 AND t.x BETWEEN x0 AND x1),
held AS (SELECT z.mark_id, z.x, z.file_id FROM z JOIN e ON z.file_id = e.file_id WHERE (y1 > y) <> (y2 > y) AND z.x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
SELECT 'near' AS kind, a AS id_a, b AS id_b FROM near UNION ALL SELECT DISTINCT 'inside', mark_id, file_id FROM held
"""
