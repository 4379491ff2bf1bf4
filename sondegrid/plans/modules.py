"""Gridding modules by name, and the pipeline around them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sondegrid.grid import GridSpec
from sondegrid.operators import algebra as A, cells as C, focal as N, interp as I, joins as J, ranks, uncertainty as U, vector as V
from sondegrid.operators.filters import z_pass
from sondegrid.region import Region
from sondegrid.session import materialize

K = ["row", "col"]
MODULES: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def gridder(name: str):
    """Registers f(points, spec, **options) -> tables by name."""

    def add(f):
        MODULES[name] = f
        return f

    return add


@gridder("surface")
def _surface(p, spec, tension=0.85, lower_limit=None, upper_limit=None, **_):
    return {"dem": I.surface(p, spec, float(tension), lower_limit, upper_limit)}


@gridder("triangulate")
def _triangulate(p, spec, **_):
    return {"dem": I.triangulate(p, spec)}


@gridder("nearest")
def _nearest(p, spec, radius=None, **_):
    return {"dem": I.nearest(p, spec, radius)}


@gridder("num")
def _num(p, spec, mode="n", **_):
    """n count, m mean, k mask, w wet or dry, Al/Au/As/Ar least, greatest, sum, root mean square."""
    z = F.col("z").cast("double")
    modes = {"n": lambda: C.count(p, spec), "m": lambda: C.mean(p, spec), "k": lambda: C.mask(p, spec), "w": lambda: C.wet_dry(p, spec), "Al": lambda: C.aggregate(p, spec, F.min("z").alias("v")), "Au": lambda: C.aggregate(p, spec, F.max("z").alias("v")), "As": lambda: C.aggregate(p, spec, F.sum("z").alias("v")), "Ar": lambda: C.aggregate(p, spec, F.sqrt(F.avg(z * z)).alias("v"))}
    return {"dem": modes[mode]()}


@gridder("IDW")
def _idw(p, spec, radius=1 / 3600, power=2.0, compat=False, **_):
    return {"dem": I.idw(p, spec, max(float(radius), spec.dx), float(power), w="w" if "w" in p.columns else None, compat=compat)}


@gridder("invdst")
def _invdst(p, spec, **o):
    return {"dem": I.invdst(p, spec, **o)}


@gridder("average")
def _average(p, spec, **o):
    return {"dem": I.moving_average(p, spec, **o).select(*K, "v")}


@gridder("linear")
def _linear(p, spec, radius=None, **_):
    return {"dem": I.linear(p, spec, radius)}


@gridder("mbgrid")
def _mbgrid(p, spec, reach=10, tension=0.35, **_):
    return {"dem": I.masked_spline(p, spec, int(reach), float(tension))}


@gridder("vdatum")
def _vdatum(p, spec, offsets: DataFrame | None = None, **_):
    """Differences of vertical datums, from a grid of offsets that the user brings."""
    if offsets is None:
        raise ValueError("vdatum needs a table of offsets (row, col, v)")
    return {"dem": J.priority_fill(spec, [offsets])}


@gridder("spat-meta")
def _spat_meta(p, spec, by="src", **_):
    return {"sm": spatial_metadata(p, spec, by)}


@gridder("coastline")
def _coastline(p, spec, layers: list[DataFrame] | None = None, most=8, **_):
    """Wet 0 and dry 1 by the first layer that says, the data's own mean last; its parts; and the polygons of the ``most``
    largest dry ones."""
    own = C.wet_dry(p.where(z_pass("z", 1.0, -1.0)), spec)
    mask = J.priority_fill(spec, [*(layers or []), own])
    parts = materialize(V.components(mask), "coast-parts")
    sizes = parts.groupBy("label").agg(F.count("*").alias("area"), F.first("v").alias("dn")).withColumnRenamed("label", "fid")
    land = V.largest(sizes, int(most)).select(F.col("fid").alias("label"))
    return {"dem": mask, "parts": parts, "coast": V.polygonize(parts.join(F.broadcast(land), "label"), spec, ["label"])}


@gridder("landmask")
def _landmask(p, spec, layers: list[DataFrame] | None = None, **_):
    votes = C.wet_dry(p, spec).withColumn("v", F.when(F.col("v") == 1, -1).otherwise(1))
    return {"dem": J.vote_mask(spec, [*(layers or []), votes])}


@gridder("composite")
def _composite(p, spec, coast: DataFrame | None = None, upper_limit=-0.1, **_):
    """A bathymetric surface on cells three times as wide, held below a limit and clipped to the wet cells, takes part with
    little weight in a last surface of the data; coast points at height 0 help the first."""
    wide = GridSpec(spec.xmin, spec.ymax, spec.dx * 3, spec.dy * 3, -(-spec.nx // 3), -(-spec.ny // 3))
    bathy_in = p.select("x", "y", "z").where("z < 0.4")
    if coast is not None:
        bathy_in = bathy_in.unionByName(coast.select("x", "y", F.lit(0.0).alias("z")))
    bathy = N.resample(I.surface(bathy_in, wide, upper=float(upper_limit)), wide, spec)
    wet = C.wet_dry(p, spec).where("v = 1").select(*K)
    bathy_points = A.grid_points(bathy.join(wet, K, "left_anti"), spec).withColumn("w", F.lit(0.5))
    own = p.select("x", "y", "z", F.lit(1.0).alias("w"))
    held = replace(spec, border=True)
    best = J.priority_fill(spec, [C.block(own, spec).select(*K, F.col("z").alias("v")), C.block(bathy_points, held).select(*K, F.col("z").alias("v"))]).where("v is not null")
    return {"dem": I.surface(A.grid_points(best, spec), held), "bathy": bathy}


@gridder("uncertainty")
def _uncertainty(p, spec, tile=5, seed=0, sims=10, module="surface", options=None, **_):
    """Error by distance to data and by slope, from repeated split samples of training tiles, applied to the whole grid.

    Tiles are sorted into zones by the 95th percentile of their distances to data and of their slopes, against the quartiles
    of the region; training tiles are those of little density, or slope, in each zone. Each round draws from every training
    tile as many block means as the sampling density (the 5th percentile of the tiles' densities) gives it, holds the others
    out, all tiles at once, and grids the region again with the module; a tile has the rest of the region as buffer. Errors
    count where 0 < distance < p95 and slope < p95. The two curves' errors are averaged, slope counting only where there is no
    data; cells at the rim, which have no slope, have the error by distance."""
    options, held, n = options or {}, replace(spec, border=True), int(tile)
    cells = materialize(C.block(p, spec).where("z is not null").withColumn("pid", F.xxhash64(*K)), "unc-cells")
    near = lambda c: N.proximity(c.select(*K, F.lit(1).alias("v")), spec).select(*K, F.sqrt(F.col("d2").cast("double")).alias("distance"))
    whole = materialize(near(cells), "unc-distance")
    slope = materialize(N.slope(MODULES[module](cells, held, **options)["dem"], spec).withColumnRenamed("v", "slope"), "unc-slope")
    at = [F.floor(F.col(c) / n).cast("int").alias(t) for c, t in zip(K, ("trow", "tcol"))]
    steep = slope.groupBy(*at).agg(F.percentile("slope", F.lit(0.95)).alias("slope"))  # of the cells of a tile
    tiles = U.tile_stats(whole.select(*K, (F.col("distance") == 0).cast("int").alias("mask"), F.col("distance").alias("prox")), n)
    tiles = materialize(tiles.join(steep, ["trow", "tcol"], "left"), "unc-tiles")
    quarters = {"low": 0.25, "high": 0.75, "most": 0.95}
    d, s = (ranks.percentiles(t, [], c, quarters).first().asDict() for t, c in ((whole, "distance"), (slope, "slope")))
    d, s = ({k: v or 0.0 for k, v in x.items()} for x in (d, s))
    tiles = U.slope_zones(U.zones(tiles, d["low"], d["high"]), s["low"], s["high"])
    density = ranks.percentiles(tiles, [], "density", {"p5": 0.05}).first()["p5"] or 0.0
    train = U.training(tiles).select("trow", "tcol").unionByName(U.training(tiles, zone="slope_zone", by="slope").select("trow", "tcol")).distinct()
    keep = F.when(F.col("density") < F.lit(density), 1).otherwise((F.col("cells") * F.lit(density / 100)).cast("int") + 1).alias("keep")
    train = tiles.join(train, ["trow", "tcol"], "left_semi").select("trow", "tcol", keep)
    inner = materialize(cells.select("*", *at).join(train, ["trow", "tcol"]), "unc-inner")
    errors = []

    def sample(sim):
        out = U.hold_out(inner, ["trow", "tcol"], int(seed) + sim).select(*K, "z")
        kept = materialize(cells.join(out, K, "left_anti"), "unc-kept")
        e = out.join(MODULES[module](kept, held, **options)["dem"], K).join(near(kept), K).join(slope, K, "left")
        e = e.select((F.col("z") - F.col("v")).alias("error"), "distance", "slope")
        e = e.where((F.col("distance") > 0) & (F.col("distance") < F.lit(d["most"])) & (F.col("slope").isNull() | (F.col("slope") < F.lit(s["most"]))))
        errors.append(materialize(e, "unc-errors"))
        return errors[-1]

    by_distance, _n = U.converge(sample, int(sims), enough=max(1, spec.nx * spec.ny // 10))
    by_slope = U.error_curve(reduce(DataFrame.unionByName, errors).where("slope is not null"), "slope")
    a = U.apply_curve(whole.withColumnRenamed("distance", "v"), by_distance).withColumnRenamed("v", "a")
    free = slope.join(whole, K).select(*K, F.when(F.col("distance") == 0, 0.0).otherwise(F.col("slope")).alias("v"))
    both = a.join(U.apply_curve(free, by_slope).withColumnRenamed("v", "b"), K, "left")
    return {"dem": both.select(*K, ((F.col("a") + F.coalesce("b", "a")) / 2).alias("v")), "tiles": tiles}


#: Attributes of a list in the order of its packed metadata (fixed values).
ATTRIBUTES = ("name", "agency", "date", "type", "resolution", "hdatum", "vdatum", "url")


def spatial_metadata(points: DataFrame, spec: GridSpec, by: str, metadata: DataFrame | None = None) -> DataFrame:
    """(by, cells, polygons, area, wkt, the eight attributes): the area that each list covers. ``metadata`` (by, meta) has the
    values of a list's packed metadata as an array; a list without eight of them has its own name and unknown attributes."""
    c = spec.index(points).select(by, *K).distinct()
    out = c.groupBy(by).agg(F.count("*").alias("cells")).join(V.polygonize(c, spec, [by]).select(by, "polygons", "area", "wkt"), by)
    if metadata is not None:
        out = out.join(metadata.select(by, "meta"), by, "left")
    else:
        out = out.withColumn("meta", F.lit(None).cast("array<string>"))
    whole = F.size("meta") == len(ATTRIBUTES)
    default = lambda a: F.col(by).cast("string") if a == "name" else F.lit("unknown")
    return out.select(by, "cells", "polygons", "area", "wkt", *[F.when(whole, F.get("meta", F.lit(i))).otherwise(default(a)).alias(a) for i, a in enumerate(ATTRIBUTES)])


@dataclass(frozen=True)
class GridJob:
    """A grid to make: module and options, region, increment, filters."""

    module: str = "num"
    region: Region = Region(-90.0, -89.0, 29.0, 30.0)
    inc: float = 0.05
    registration: str = "node"
    extend: int = 0
    extend_proc: int = 20
    options: dict = field(default_factory=dict)
    blur: int = 0
    split: float | None = None
    sample: float | None = None
    z_range: tuple | None = None
    w_range: tuple | None = None

    @classmethod
    def from_json(cls, text: str) -> GridJob:
        d = json.loads(text)
        d["region"] = Region(**d["region"])
        for k in ("z_range", "w_range"):
            d[k] = tuple(d[k]) if d.get(k) else None
        return cls(**d)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @property
    def dist_region(self) -> Region:
        return self.region.buffer((self.sample or self.inc) * self.extend)

    @property
    def proc_region(self) -> Region:
        return self.region.buffer(self.inc * (self.extend_proc + self.extend))

    @property
    def grid_region(self) -> Region:
        return self.dist_region.buffer(self.inc / 2) if self.registration == "node" else self.dist_region

    @property
    def spec(self) -> GridSpec:
        return GridSpec.from_region(self.dist_region, self.inc, registration=self.registration)

    def run(self, points: DataFrame) -> dict[str, DataFrame]:
        """Filter, grid with a margin, smooth below a split, resample, cut to the region. Lazy up to what the modules need."""
        p = points.where(self.proc_region.contains())
        if self.z_range:
            p = p.where(z_pass("z", *self.z_range))
        if self.w_range and "w" in p.columns:
            p = p.where(z_pass("w", *self.w_range))
        proc = GridSpec.from_region(self.proc_region, self.inc, registration=self.registration)
        out = MODULES[self.module](p, proc, **self.options)
        if "dem" in out:
            d = out["dem"]
            if self.blur:
                if self.split is None:
                    d = N.blur(d, proc, self.blur)
                else:
                    u, low = A.split(d, self.split)
                    d = A.recombine(u.select(*K, F.col("v").cast("double").alias("v")), N.blur(low, proc, self.blur))
            if self.sample:
                fine = GridSpec.from_region(self.dist_region, self.sample, registration=self.registration)
                out["dem"] = N.resample(d, proc, fine)
            else:
                out["dem"] = A.cut(d, proc, self.dist_region)[0]
        return out


@dataclass(frozen=True)
class FetchJob:
    """Catalog rows to list or fetch: region (grown by 5 percent for the search), predicates, sources with options."""

    region: Region | None = None
    where: tuple[str, ...] = ()
    sources: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> FetchJob:
        d = json.loads(text)
        return cls(Region(**d["region"]) if d.get("region") else None, tuple(d.get("where", ())), d.get("sources", {}))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def rows(self, catalog: DataFrame) -> DataFrame:
        from sondegrid.sources.catalog import find

        return find(catalog, self.region.buffer(5, percent=True) if self.region else None, list(self.where), list(self.sources) or None)

    def urls(self, catalog: DataFrame) -> DataFrame:
        from sondegrid.sources.catalog import data_links

        return data_links(self.rows(catalog))
