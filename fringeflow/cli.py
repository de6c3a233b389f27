"""Command line: run, config, unwrap, timeseries, filter, geocode over Parquet tables."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fringeflow", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="the displacement workflow of a settings file")
    run.add_argument("config")
    config = sub.add_parser("config", help="write a settings file")
    config.add_argument("--stack", required=True)
    config.add_argument("--dates", required=True)
    config.add_argument("--work-directory", default=".")
    config.add_argument("--out", default="fringeflow.yaml")
    unwrap = sub.add_parser("unwrap", help="unwrap images of phase and correlation (scene, ref_t, sec_t, row, col)")
    series = sub.add_parser("timeseries", help="invert unwrapped phases (scene, ref_t, sec_t, row, col, phase, and a weight)")
    filt = sub.add_parser("filter", help="remove long wavelengths from images (scene, t, row, col, phase)")
    geocode = sub.add_parser("geocode", help="bring images (scene, row, col, value) to a lon/lat grid")
    for one in (unwrap, series, filt, geocode):
        one.add_argument("input")
        one.add_argument("output")
    unwrap.add_argument("--method", default="least_squares")
    series.add_argument("--method", choices=("L1", "L2"), default="L2")
    series.add_argument("--weight", help="a column to weight L2 by")
    series.add_argument("--censored", action="store_true", help="L2 over the interferograms that a pixel has a phase in")
    filt.add_argument("--cutoff", type=float, default=25_000)
    filt.add_argument("--spacing", type=float, required=True)
    geocode.add_argument("--locations", required=True, help="row, col, lon, lat")
    geocode.add_argument("--origin", type=float, nargs=2, required=True)
    geocode.add_argument("--pixel", type=float, nargs=2, required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from fringeflow.plans.config import InputOptions, Workflow

    if args.command == "config":
        Workflow(work_directory=args.work_directory, inputs=InputOptions(stack=args.stack, dates=args.dates)).to_yaml(args.out)
        return 0
    from fringeflow.operators import geometry, images
    from fringeflow.plans import workflow
    from fringeflow.session import get_session

    spark = get_session()
    if args.command == "run":
        workflow.displacement(spark, Workflow.from_yaml(args.config))
        return 0
    rows = spark.read.parquet(args.input)
    if args.command == "unwrap":
        out = images.unwrapped_images(rows, ["scene", "ref_t", "sec_t"], args.method)
    elif args.command == "timeseries":
        edges = rows.select("scene", "ref_t", "sec_t").distinct()
        out = workflow.inverted(rows, edges, args.method, args.weight, args.censored)
    elif args.command == "filter":
        out = workflow.filtered(rows, ["scene", "t"], args.cutoff, args.spacing)
    else:
        out = geometry.geocoded(rows, spark.read.parquet(args.locations), ["scene"], tuple(args.origin), tuple(args.pixel))
    out.write.mode("overwrite").parquet(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
