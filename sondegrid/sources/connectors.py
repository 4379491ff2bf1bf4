"""Remote sources by name. Each has a function from rows (catalog rows, footprints or service answers) and a region to url
rows (url, file_name, kind), and one from lines or answers to points. Service addresses are parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sondegrid.functions import scalars as S
from sondegrid.region import Region
from sondegrid.sources import catalog as C
from sondegrid.sources.xyz import XyzConfig, parse_xyz


@dataclass(frozen=True)
class Connector:
    urls: Callable[..., DataFrame]
    points: Callable[[DataFrame], DataFrame] | None = None


def _rows(d: DataFrame, url: str | Column, kind: str | Column) -> DataFrame:
    u = F.col(url) if isinstance(url, str) else url
    k = F.lit(kind) if isinstance(kind, str) else kind
    return d.select(u.alias("url"), F.element_at(F.split(F.regexp_replace(u, r"[?].*$", ""), "/"), -1).alias("file_name"), k.alias("kind"))


def footprints(tiles: DataFrame, region: Region, url: str = "url") -> DataFrame:
    """Tiles whose box meets the region; point clouds are lidar, others rasters."""
    return _rows(tiles.where(region.intersects()), url, F.when(F.lower(F.col(url)).rlike("[.]la[sz]$"), "lidar").otherwise("raster"))


def linked(rows: DataFrame, region: Region) -> DataFrame:
    d = C.data_links(rows.where(region.intersects()))
    return _rows(d, "url", F.col("kind"))


def bounded(base: str, kind: str, **options) -> Callable[..., DataFrame]:
    """One url a region, with its bounds as options."""

    def urls(regions: DataFrame, region: Region | None = None) -> DataFrame:
        d = regions if region is None else regions.where(region.intersects())
        o = {"west": F.col("xmin"), "east": F.col("xmax"), "south": F.col("ymin"), "north": F.col("ymax")} | {k: F.lit(v) for k, v in options.items()}
        return _rows(d, C.bbox_url(base, o), kind)

    return urls


def coverage(base: str, rewrite: bool = False) -> Callable[..., DataFrame]:
    """Coverages (id and box) that meet the region, cut to it."""

    def urls(coverages: DataFrame, region: Region) -> DataFrame:
        d = coverages.where(region.intersects())
        name = C.chs_id(F.col("id")) if rewrite else F.col("id")
        u = F.concat(F.lit(base + "?service=WCS&version=2.0.1&request=GetCoverage&coverageID="), F.url_encode(name), F.lit(f"&subset=Long({region.xmin},{region.xmax})&subset=Lat({region.ymin},{region.ymax})"))
        return d.select(u.alias("url"), F.concat("id", F.lit(".tif")).alias("file_name"), F.lit("raster").alias("kind"))

    return urls


def thredds(docs: DataFrame, region: Region | None = None, base: str = "", col: str = "xml") -> DataFrame:
    """Datasets of catalog documents."""
    path = F.explode(F.xpath(col, F.lit("//*[local-name()='dataset']/@urlPath")))
    return _rows(docs.select(path.alias("p")), F.concat(F.lit(base), F.col("p")), "raster")


def chart_points(features: DataFrame, col: str = "json") -> DataFrame:
    """Soundings of chart features: coordinates with depth below."""
    g = F.from_json(col, "geometry struct<type: string, coordinates: array<array<double>>>")["geometry"]["coordinates"]
    d = features.select(F.explode(g).alias("c"))
    return d.select(F.col("c")[0].alias("x"), F.col("c")[1].alias("y"), (F.col("c")[2] * F.lit(-1.0)).alias("z")).where("x is not null and y is not null and z is not null")


def swath_points(lines: DataFrame) -> DataFrame:
    return parse_xyz(lines, XyzConfig(delim="\t"))


def nonzero(points: DataFrame) -> DataFrame:
    return points.where("z <> 0")


def listing(lines: DataFrame, region: Region | None = None, line: str = "line") -> DataFrame:
    """Survey files of a listing, best version of each."""
    u = F.split_part(F.trim(F.col(line)), F.lit(" "), F.lit(1))
    d = lines.select(u.alias("url")).withColumn("survey", S.survey_of(F.col("url"))).withColumn("version", S.version_of(F.col("url")))
    return _rows(C.best_version(d), "url", "mb")


def connectors(base: str = "https://example.invalid") -> dict[str, Connector]:
    """All sources; ``base`` stands for the services' addresses, which the user sets."""
    return {
        "dc": Connector(footprints),
        "nos": Connector(linked, C.nos_points),
        "charts": Connector(lambda d, r: _rows(d.where(r.intersects()), "url", "enc"), chart_points),
        "ncei_thredds": Connector(thredds),
        "usace": Connector(lambda d, r=None, survey=None: _rows(C.usace_rows(d, survey), "url", "usace"), parse_xyz),
        "tnm": Connector(lambda d, r=None, formats=("IMG",), extent=None: _rows(C.tnm_rows(d, list(formats), extent), "url", "raster"), nonzero),
        "gmrt": Connector(lambda d, r=None, layer="topo": C.gmrt_urls(d, layer).withColumn("kind", F.lit("gmrt"))),
        "mb": Connector(listing, swath_points),
        "mar_grav": Connector(bounded(f"{base}/mar_grav", "mar_grav", mag=1), C.altimetry_points),
        "srtm_plus": Connector(bounded(f"{base}/srtm_plus", "srtm_plus"), C.altimetry_points),
        "emodnet": Connector(coverage(f"{base}/wcs")),
        "ngs": Connector(bounded(f"{base}/ngs", "ngs"), C.ngs_points),
        "chs": Connector(coverage(f"{base}/wcs", rewrite=True)),
        "hrdem": Connector(footprints),
        "osm": Connector(bounded(f"{base}/osm", "osm")),
    }
