"""Command line: grid, fetch, datalists and grid tools, as thin calls of the library.

    python -m sondegrid.cli grid -M num:mode=m -R -90/-89/29/30 -E 0.05 points.xyz -O out
    python -m sondegrid.cli datalists --list my.datalist
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import functions as F

from sondegrid import sinks
from sondegrid.operators import algebra as A, cells as C, joins as J
from sondegrid.plans.modules import MODULES, FetchJob, GridJob
from sondegrid.region import Region
from sondegrid.session import get_session
from sondegrid.sources import datalist as D, xyz as X

log = logging.getLogger("sondegrid")


def options(text: str) -> tuple[str, dict]:
    """name:key=value:key=value; numbers, true, false and none are taken as such."""
    name, *rest = text.split(":")
    words = {"true": True, "false": False, "none": None}

    def value(v: str):
        if v.lower() in words:
            return words[v.lower()]
        try:
            return float(v) if any(c in v for c in ".eE") else int(v)
        except ValueError:
            return v

    return name, {k: value(v) for k, v in (o.split("=", 1) for o in rest)}


def _points(spark, paths):
    return D.union_all([X.read_xyz(spark, p, X.XyzConfig()).drop("path") for p in paths])


def grid(spark, a) -> None:
    if a.config:
        with open(a.config) as f:
            job = GridJob.from_json(f.read())
    else:
        name, opts = options(a.module)
        if name not in MODULES:
            raise SystemExit(f"no module {name}; there are {', '.join(sorted(MODULES))}")
        job = GridJob(name, Region.parse(a.region), a.increment, extend=a.extend, options=opts, blur=a.blur, split=a.split, sample=a.sample)
    if a.save_config:
        print(job.to_json())
        return
    for k, t in job.run(_points(spark, a.data)).items():
        if k == "dem":
            sinks.write_grid(t, job.spec, f"{a.output}/{k}")
        else:
            t.write.mode("overwrite").parquet(f"{a.output}/{k}")
        log.info("wrote %s/%s", a.output, k)


def fetch(spark, a) -> None:
    job = FetchJob(Region.parse(a.region) if a.region else None, tuple(a.where), {m: o for m, o in map(options, a.sources)})
    cat = spark.read.parquet(a.catalog)
    if a.index:
        job.rows(cat).show(1000, False)
    else:
        for r in job.urls(cat).toLocalIterator():
            print(r["url"])


def datalists(spark, a) -> None:
    if a.glob:
        for r in D.list_files(spark, a.lists[0]).toLocalIterator():
            print(r["path"], r["fmt"], r["weight"])
        return
    entries = D.union_all([D.parse_entries(spark.read.text(p).withColumnRenamed("value", "line")) for p in a.lists])
    if a.list:
        for r in entries.toLocalIterator():
            print(r["path"], r["fmt"], r["weight"], ",".join(r["meta"] or ()))
        return
    paths = [r["path"] for r in entries.where("fmt = 168").select("path").collect()]
    pts = D.union_all([X.read_xyz(spark, p) for p in paths])
    if a.region:
        pts = pts.where(Region.parse(a.region).contains())
    if a.inf:
        C.envelope(pts, ["path"]).show(1000, False)
    else:
        for r in pts.select(sinks.xyz_text(F.col("x"), F.col("y"), F.col("z")).alias("l")).toLocalIterator():
            print(r["l"])


def tool(spark, a) -> None:
    cells, spec = sinks.read_grid(spark, a.grid)
    if a.what == "split":
        u, low = A.split(cells, a.value)
        sinks.write_grid(u, spec, f"{a.output}/upper")
        sinks.write_grid(low, spec, f"{a.output}/lower")
    elif a.what == "cut":
        sinks.write_grid(*A.cut(cells, spec, Region.parse(a.region)), a.output)
    elif a.what == "crop":
        sinks.write_grid(A.crop(cells), spec, a.output)
    elif a.what == "chunk":
        A.tiles(cells, int(a.value)).write.partitionBy("trow", "tcol").parquet(a.output)
    elif a.what == "points":
        sinks.write_xyz(A.grid_points(cells, spec), a.output)
    elif a.what == "query":
        J.query_grid(_points(spark, a.data), cells, spec).write.csv(a.output, sep=" ")


def _joined(argv: list[str]) -> list[str]:
    """A region that begins with a minus sign belongs to the option before it."""
    out: list[str] = []
    for x in argv:
        if out and out[-1] in ("-R", "--region") and x.startswith("-"):
            out[-1] = f"--region={x}"
        else:
            out.append(x)
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sondegrid", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(required=True)
    g = sub.add_parser("grid")
    g.add_argument("data", nargs="*")
    g.add_argument("-M", "--module", default="num")
    g.add_argument("-R", "--region", default="-90/-89/29/30")
    g.add_argument("-E", "--increment", type=float, default=0.05)
    g.add_argument("-O", "--output", default="grid")
    g.add_argument("-X", "--extend", type=int, default=0)
    g.add_argument("--blur", type=int, default=0)
    g.add_argument("--split", type=float)
    g.add_argument("--sample", type=float)
    g.add_argument("-G", "--config")
    g.add_argument("--save-config", action="store_true")
    g.set_defaults(run=grid)
    f = sub.add_parser("fetch")
    f.add_argument("catalog")
    f.add_argument("sources", nargs="*")
    f.add_argument("-R", "--region")
    f.add_argument("-W", "--where", action="append", default=[])
    f.add_argument("-i", "--index", action="store_true")
    f.set_defaults(run=fetch)
    d = sub.add_parser("datalists")
    d.add_argument("lists", nargs="+")
    for flag in ("list", "inf", "glob"):
        d.add_argument(f"--{flag}", action="store_true")
    d.add_argument("-R", "--region")
    d.set_defaults(run=datalists)
    t = sub.add_parser("tool")
    t.add_argument("what", choices=["split", "cut", "crop", "chunk", "points", "query"])
    t.add_argument("grid")
    t.add_argument("data", nargs="*")
    t.add_argument("-O", "--output", default="out")
    t.add_argument("-R", "--region")
    t.add_argument("-V", "--value", type=float, default=0.0)
    t.set_defaults(run=tool)
    a = p.parse_args(_joined(sys.argv[1:] if argv is None else argv))
    logging.basicConfig(level=logging.INFO)
    a.run(get_session(master=a.master), a)


if __name__ == "__main__":
    main()
