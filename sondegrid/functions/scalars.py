"""Scalar functions as Column builders."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, functions as F

EARTH = 6_371_000.0
EARTH_COMPAT = 637_100.0

#: State plane zone to EPSG code (fixed values).
FIPS_TO_EPSG = {
    "0101": "26929", "0102": "26930", "0201": "26948", "0202": "26949", "0203": "26950", "0301": "26951", "0302": "26952", "0401": "26941",
    "0402": "26942", "0403": "26943", "0404": "26944", "0405": "26945", "0406": "26946", "0501": "26953", "0502": "26954", "0503": "26955",
    "0600": "26956", "0700": "26957", "0901": "26958", "0902": "26959", "0903": "26960", "1001": "26966", "1002": "26967", "1101": "26968",
    "1102": "26969", "1103": "26970", "1201": "26971", "1202": "26972", "1301": "26973", "1302": "26974", "1401": "26975", "1402": "26976",
    "1501": "26977", "1502": "26978", "1600": "03088", "1601": "2205", "1602": "26980", "1701": "26981", "1702": "26982", "1703": "32199",
    "1801": "26983", "1802": "26984", "1900": "26985", "2001": "26986", "2002": "26987", "2111": "26988", "2112": "26989", "2113": "26990",
    "2201": "26991", "2202": "26992", "2203": "26993", "2301": "26994", "2302": "26995", "2401": "26996", "2402": "26997", "2403": "26998",
    "2500": "32100", "2600": "32104", "2701": "32107", "2702": "32108", "2703": "32109", "2800": "32110", "2900": "32111", "3001": "32112",
    "3002": "32113", "3003": "32114", "3101": "32115", "3102": "32116", "3103": "32117", "3104": "32118", "3200": "32119", "3301": "32120",
    "3302": "32121", "3401": "32122", "3402": "32123", "3501": "32124", "3502": "32125", "3601": "32126", "3602": "32127", "3701": "32128",
    "3702": "32129", "3800": "32130", "3900": "32133", "4001": "32134", "4002": "32135", "4100": "32136", "4201": "32137", "4202": "32138",
    "4203": "32139", "4204": "32140", "4205": "32141", "4301": "32142", "4302": "32143", "4303": "32144", "4400": "32145", "4501": "32146",
    "4502": "32147", "4601": "32148", "4602": "32149", "4701": "32150", "4702": "32151", "4801": "32152", "4802": "32153", "4803": "32154",
    "4901": "32155", "4902": "32156", "4903": "32157", "4904": "32158", "5001": "26931", "5002": "26932", "5003": "26933", "5004": "26934",
    "5005": "26935", "5006": "26936", "5007": "26937", "5008": "26938", "5009": "26939", "5010": "26940", "5101": "26961", "5102": "26962",
    "5103": "26963", "5104": "26964", "5105": "26965", "5200": "32161",
}

#: Breakpoints of the global relief colours, and red, green and blue of each (fixed values).
RELIEF_TARGETS = [-11000, -10500, -10000, -9500, -9000, -8500, -8000, -7500, -7000, -6500, -6000, -5500, -5000, -4500, -4000, -3500, -3000, -2500, -2000, -1500, -1000, -500, -0.001, 0, 100, 200, 500, 1000, 1500, 2000, 2500, 3000, 3500, 4000, 4500, 5000, 5500, 6000, 6500, 7000, 7500, 8000]
RELIEF_COLORS = [
    (10, 0, 121), (26, 0, 137), (38, 0, 152), (27, 3, 166), (16, 6, 180), (5, 9, 193), (0, 14, 203), (0, 22, 210),
    (0, 30, 216), (0, 39, 223), (12, 68, 231), (26, 102, 240), (19, 117, 244), (14, 133, 249), (21, 158, 252), (30, 178, 255),
    (43, 186, 255), (55, 193, 255), (65, 200, 255), (79, 210, 255), (94, 223, 255), (138, 227, 255), (138, 227, 255), (51, 102, 0),
    (51, 204, 102), (187, 228, 146), (255, 220, 185), (243, 202, 137), (230, 184, 88), (217, 166, 39), (168, 154, 31), (164, 144, 25),
    (162, 134, 19), (159, 123, 13), (156, 113, 7), (153, 102, 0), (162, 89, 89), (178, 118, 118), (183, 147, 147), (194, 176, 176),
    (204, 204, 204), (229, 229, 229), (138, 227, 255), (51, 102, 0),
]
#: Driver name to file suffix (fixed values).
SUFFIXES = {"GTiff": "tif", "HFA": "img", "GMT": "grd", "netCDF": "nc", "AAIGrid": "asc", "VRT": "vrt", "BAG": "bag", "LAS": "las"}


def euclid(x0, y0, x1, y1, radius: float = EARTH) -> Column:
    """Plane distance in degrees times a radius."""
    return F.sqrt(F.pow(x1 - x0, F.lit(2.0)) + F.pow(y1 - y0, F.lit(2.0))) * F.lit(radius)


def haversine(lat0, lon0, lat1, lon1, radius: float = EARTH) -> Column:
    dlat, dlon = F.radians(lat1 - lat0) / 2, F.radians(lon1 - lon0) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def degree_length(lat: Column) -> Column:
    """Metres a degree of longitude."""
    return F.cos(F.radians(lat)) * F.lit(111321.543)


def turn360(x: Column, to: str = "west") -> Column:
    return x - F.lit(360.0) if to == "west" else x + F.lit(360.0)


def increment(text: Column, compat: bool = False) -> Column:
    """Degrees of 1s, 1c (seconds), 1m (minutes) or a plain number; anything else is null."""
    unit = F.right(text, F.lit(1))
    head = F.regexp_replace(text, "[scm]$", "").try_cast("double")
    return F.when(unit.isin("s", "c"), head / F.lit(3600.0)).when(unit == "m", head / F.lit(360.0 if compat else 60.0)).otherwise(text.try_cast("double"))


def increment_name(inc: float) -> str:
    """Arc seconds as a fraction of at most tenths, without its stroke: 1/3 s is 13."""
    f = Fraction(str(inc * 3600)).limit_denominator(10)
    return f"{f.numerator}" if f.denominator == 1 else f"{f.numerator}{f.denominator}"


def grid_name(base: str, inc: float, tile: str, year: int, version: int = 1) -> str:
    return f"{base}{increment_name(inc)}_{tile}_{year}v{version}"


def relief_elevation(value: Column, target: Column, low: Column | float, high: Column | float) -> Column:
    """A breakpoint scaled to the data's range; null beyond it."""
    low, high = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (low, high))
    return F.when((value > 0) & (high > 0), high * target / F.lit(8000.0)).when((value < 0) & (low < 0), low * target / F.lit(-11000.0)).when(value == 0, F.lit(0.0))


def fixed_text(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x)


def options_map(text: Column) -> Column:
    """k=v:k=v as a map."""
    return F.str_to_map(text, F.lit(":"), F.lit("="))


def int_or(text: Column, other=None) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(other).cast("int"))


def float_or(text: Column, other=None) -> Column:
    """A decimal number, an infinity or NaN in any case; whatever else a cast would take (as 1d or 2f) is no number."""
    number = text.rlike(r"(?i)\A\s*[+-]?(?:(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?|nan)\s*\z")
    return F.coalesce(F.when(number, text.try_cast("double")), F.lit(other).cast("double"))


def suffix_of(driver: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in SUFFIXES.items() for v in kv]), driver), F.lower(driver))


def without_suffix(path: Column, suffix: str) -> Column:
    return F.regexp_replace(path, f"{suffix.replace('.', '[.]')}$", "")


def links(html: Column) -> Column:
    """Targets of the anchors of a page."""
    return F.regexp_extract_all(html, F.lit('href="([^"]+)"'), 1)


def survey_kind(path: Column) -> Column:
    """Kind of a survey file by the last two parts of its name."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), "[.]")
    n = F.size(parts)
    part = F.when(n > 2, F.try_element_at(parts, F.lit(-2))).when(n == 2, F.try_element_at(parts, F.lit(-1)))
    return F.when(part == "bag", "grid_bag").when(part == "xyz", "geodas_xyz")


def query_string(pairs: dict[str, Column]) -> Column:
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in pairs.items()])


def survey_of(url: Column) -> Column:
    return F.try_element_at(F.split(url, "/"), F.lit(7))


def version_of(url: Column) -> Column:
    return F.right(F.try_element_at(F.split(url, "/"), F.lit(10)), F.lit(1))


def zone_epsg(zone: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in FIPS_TO_EPSG.items() for v in kv]), zone)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG 4326 to 3857."""
    r = F.lit(6378137.0)
    return r * F.radians(lon), r * F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483)))


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG 3857 to 4326."""
    r = F.lit(6378137.0)
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - F.lit(1.5707963267948966))
