"""The catalog of remote data: attributes and boxes, url rows, and parsers of what the services answer. Fetching is apart, so
that all else can be tested on files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sondegrid.functions import scalars as S
from sondegrid.operators.filters import attribute_filter
from sondegrid.region import Region

#: Attributes of a catalog row (fixed values); Date is a whole number.
FIELDS = "Name ID Date Agency MetadataLink MetadataDate DataLink IndexLink Link DataType DataSource Resolution HorizontalDatum VerticalDatum LastUpdate Etcetra Info".split()
SCHEMA = ", ".join(f"{f} {'int' if f == 'Date' else 'string'}" for f in FIELDS) + ", xmin double, xmax double, ymin double, ymax double"


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def add_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key the catalog doesn't have yet are added."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def find(catalog: DataFrame, region: Region | None = None, where=None, sources: list[str] | None = None) -> DataFrame:
    """Rows of any of the sources that meet the region and all predicates."""
    out = attribute_filter(catalog, where)
    if sources:
        out = out.where(F.col("DataSource").isin(*sources))
    return out if region is None else out.where(region.intersects())


def world_inf(spark: SparkSession) -> DataFrame:
    """Zone map of a remote source: the world, number of points unknown."""
    return spark.range(1).select(F.lit(-180.0).alias("xmin"), F.lit(180.0).alias("xmax"), F.lit(-90.0).alias("ymin"), F.lit(90.0).alias("ymax"), F.lit(None).cast("bigint").alias("numpts"))


def best_version(rows: DataFrame, survey: str = "survey", version: str = "version") -> DataFrame:
    """Of each survey the rows of version 2, or 1 where there is none; surveys with neither are dropped."""
    best = F.max(F.when(F.col(version).isin("1", "2"), F.col(version))).over(Window.partitionBy(survey))
    return rows.withColumn("_b", best).where(F.col(version) == F.col("_b")).drop("_b")


def pages(totals: DataFrame, total: str, size: int) -> DataFrame:
    """One row a page, with the place of its first item."""
    return totals.where(F.col(total) > 0).withColumn("at", F.explode(F.expr(f"sequence(0L, cast({total} - 1 as bigint), {size}L)")))


def data_links(catalog: DataFrame) -> DataFrame:
    """(ID, url, kind) of each link of a comma-separated list; links of no known kind are dropped."""
    d = catalog.select("ID", F.explode(F.split("DataLink", ",")).alias("url")).where("url <> ''")
    return d.withColumn("kind", S.survey_kind(F.col("url"))).where("kind is not null")


def nos_points(lines: DataFrame) -> DataFrame:
    """Sounding lists: id, lat, lon, depth below; the header doesn't parse and falls out."""
    from sondegrid.sources.xyz import XyzConfig, parse_xyz

    return parse_xyz(lines, XyzConfig(xpos=2, ypos=1, zpos=3, delim=",", z_scale=-1.0))


def altimetry_points(lines: DataFrame) -> DataFrame:
    """Longitudes of 0..360; one line of header."""
    from sondegrid.sources.xyz import XyzConfig, parse_xyz

    return parse_xyz(lines, XyzConfig(x_off=-360.0))


def usace_rows(answers: DataFrame, survey: str | None = None, col: str = "json") -> DataFrame:
    """(url, kind) of a feature service's answer."""
    schema = "features array<struct<attributes: struct<SOURCEDATALOCATION: string, SURVEYTYPE: string>>>"
    d = answers.select(F.explode(F.from_json(col, schema)["features"]).alias("f")).select(F.col("f.attributes.SOURCEDATALOCATION").alias("url"), F.col("f.attributes.SURVEYTYPE").alias("kind"))
    return d.where("url is not null") if survey is None else d.where(F.col("kind") == survey)


def tnm_rows(answers: DataFrame, formats: list[str], extent: str | None = None, col: str = "json") -> DataFrame:
    """(title, url, boxes) of a page's items: the first format that has a link, else the download link."""
    schema = "total int, items array<struct<title: string, extent: string, format: string, urls: map<string,string>, downloadURL: string, boundingBox: struct<minX: double, maxX: double, minY: double, maxY: double>>>"
    d = answers.select(F.explode(F.from_json(col, schema)["items"]).alias("i")).select("i.*")
    if extent:
        d = d.where(F.col("extent") == extent)
    url = F.coalesce(*[F.try_element_at("urls", F.lit(f)) for f in formats], F.col("downloadURL"))
    return d.select("title", url.alias("url"), *[F.col(f"boundingBox.{a}").alias(b) for a, b in (("minX", "xmin"), ("maxX", "xmax"), ("minY", "ymin"), ("maxY", "ymax"))])


def ngs_points(answers: DataFrame, col: str = "json") -> DataFrame:
    d = answers.select(F.explode(F.from_json(col, "array<struct<lon: double, lat: double, geoidHt: double>>")).alias("m"))
    return d.select(F.col("m.lon").alias("x"), F.col("m.lat").alias("y"), F.col("m.geoidHt").alias("z"))


def gmrt_urls(answers: DataFrame, layer: str = "topo", col: str = "json") -> DataFrame:
    """Urls of the answer with the layer put into their options, and a file name of the bounds."""
    d = answers.select(F.explode(F.from_json(col, "array<string>")).alias("url"))
    base, opts = F.split_part("url", F.lit("?"), F.lit(1)), F.str_to_map(F.split_part("url", F.lit("?"), F.lit(2)), F.lit("&"), F.lit("="))
    o = F.map_concat(F.map_filter(opts, lambda k, v: k != "layer"), F.create_map(F.lit("layer"), F.lit(layer)))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(o), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&")
    return d.select(F.concat(base, F.lit("?"), text).alias("url"), F.concat_ws("_", F.lit("gmrt"), F.lit(layer), *[F.try_element_at(opts, F.lit(k)) for k in ("west", "east", "south", "north")]).alias("file_name"))


def bbox_url(base: str, options: dict[str, Column]) -> Column:
    return F.concat(F.lit(base + "?"), S.query_string(options))


def chs_id(name: Column, to: str = "wcs") -> Column:
    """Coverage ids write the colon of a name as two underscores."""
    return F.replace(name, F.lit(":"), F.lit("__")) if to == "wcs" else F.replace(name, F.lit("__"), F.lit(":"))


def overpass(answers: DataFrame, col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Ways (way, nodes) and nodes (id, lon, lat) of an answer."""
    e = answers.select(F.explode(F.from_json(col, "elements array<struct<type: string, id: bigint, nodes: array<bigint>, lon: double, lat: double>>")["elements"]).alias("e")).select("e.*")
    return e.where("type = 'way'").select(F.col("id").alias("way"), "nodes"), e.where("type = 'node'").select("id", "lon", "lat")


def wcs_coverage(docs: DataFrame, col: str = "xml") -> DataFrame:
    """Box and resolution of a described coverage; corners come as latitude, longitude, the grid's limits as highest index."""
    at = lambda path: F.xpath_string(col, F.lit(path))
    d = docs.select(at("//*[local-name()='lowerCorner']").alias("lo"), at("//*[local-name()='upperCorner']").alias("hi"), at("//*[local-name()='GridEnvelope']/*[local-name()='high']").alias("high"), at("//*[local-name()='nativeFormat']").alias("format"))
    n = lambda c, i: F.try_element_at(F.split(F.trim(c), r"\s+"), F.lit(i)).try_cast("double")
    d = d.select(n("lo", 2).alias("xmin"), n("hi", 2).alias("xmax"), n("lo", 1).alias("ymin"), n("hi", 1).alias("ymax"), n("high", 1).alias("nx"), n("high", 2).alias("ny"), "format")
    return d.select("xmin", "xmax", "ymin", "ymax", F.try_divide(F.col("xmax") - F.col("xmin"), F.col("nx")).alias("xres"), F.try_divide(F.col("ymax") - F.col("ymin"), F.col("ny")).alias("yres"), "format")


def wcs_contents(docs: DataFrame, col: str = "xml") -> DataFrame:
    return docs.select(F.explode(F.xpath(col, F.lit("//*[local-name()='CoverageSummary']/*[local-name()='CoverageId']/text()"))).alias("coverage"))


def iso_metadata(docs: DataFrame, col: str = "xml") -> DataFrame:
    """Title, bounds, date, reference system codes, abstract and links of ISO metadata."""
    t = lambda p: F.nullif(F.trim(F.xpath_string(col, F.lit(p))), F.lit(""))
    b = lambda k: t(f"//*[local-name()='EX_GeographicBoundingBox']/*[local-name()='{k}']").try_cast("double")
    return docs.select(
        t("//*[local-name()='MD_DataIdentification']//*[local-name()='title']").alias("title"),
        b("westBoundLongitude").alias("xmin"), b("eastBoundLongitude").alias("xmax"), b("southBoundLatitude").alias("ymin"), b("northBoundLatitude").alias("ymax"),
        F.left(t("//*[local-name()='CI_Date']/*[local-name()='date']"), F.lit(4)).alias("date"),
        F.xpath(col, F.lit("//*[local-name()='referenceSystemIdentifier']//*[local-name()='code']//text()")).alias("codes"),
        t("//*[local-name()='abstract']").alias("abstract"),
        F.xpath(col, F.lit("//*[local-name()='linkage']//*[local-name()='URL']/text()")).alias("links"),
    )


def mb_inf(reports: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """Bounds of multibeam reports; depths are below, so z is their negative with least and greatest exchanged."""
    num = lambda label, i: F.regexp_extract(line, rf"{label}:\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)", i).try_cast("double")
    aggs = []
    for label, a, b in (("Longitude", "xmin", "xmax"), ("Latitude", "ymin", "ymax"), ("Depth", "dmin", "dmax")):
        aggs += [F.min(num(f"Minimum {label}", 1)).alias(a), F.max(num(f"Maximum {label}", 1)).alias(b)]
    aggs.append(F.max(num("Number of Records", 1)).cast("bigint").alias("numpts"))
    d = reports.groupBy(*by).agg(*aggs)
    return d.select(*by, "xmin", "xmax", "ymin", "ymax", (-F.col("dmax")).alias("zmin"), (-F.col("dmin")).alias("zmax"), "numpts")


def gmt_inf(lines: DataFrame, line: str = "line") -> DataFrame:
    """Six numbers on a line."""
    f = F.split(F.trim(F.col(line)), r"\s+")
    return lines.select(*[c for c in lines.columns if c != line], *[F.try_element_at(f, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(("xmin", "xmax", "ymin", "ymax", "zmin", "zmax"))])


def fetch_all(urls: DataFrame, tries: int = 5, partitions: int | None = None) -> DataFrame:
    """(url, ok, error, content): bytes of each url, fetched where its partition is; tries again after growing pauses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        import urllib.request

        for b in batches:
            out = []
            for url in b["url"]:
                data = error = None
                for k in range(tries):
                    try:
                        with urllib.request.urlopen(url, timeout=10 * (k + 1)) as r:  # noqa: S310
                            data, error = r.read(), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)[:200]
                        if url.startswith("file:"):
                            break
                        time.sleep(k)
                out.append((url, data is not None, error, data))
            yield pd.DataFrame(out, columns=["url", "ok", "error", "content"])

    u = urls.select("url")
    return (u.repartition(partitions) if partitions else u).mapInPandas(run, "url string, ok boolean, error string, content binary")
