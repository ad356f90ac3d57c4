"""Command line: one site, a sweep, a batch, a download, or the atlas of a batch."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from . import jobs, site
from .operators import transport
from .sources import files, osm


def number_list(text: str) -> tuple[float, ...]:
    """Numbers between commas; none is an error."""
    values = tuple(float(x) for x in text.split(",") if x.strip())
    if not values:
        raise argparse.ArgumentTypeError("at least one number is needed")
    return values


def name_list(text: str) -> tuple[str, ...]:
    values = tuple(x.strip() for x in text.split(",") if x.strip())
    if not values:
        raise argparse.ArgumentTypeError("at least one value is needed")
    return values


#: Options whose name is not the setting's own.
SHORT = {"pixel_size_m": "pixel", "output_dir": "out", "city_name": "city", "buildings_path": "buildings", "boundary_path": "boundary", "floor_height_m": "floor-height", "default_height_m": "default-height", "height_scenarios_m": "height-scenarios", "buffer_m": "buffer", "scaling_scale_min_m": "scaling-min-m", "scaling_scale_max_m": "scaling-max-m", "lacunarity_windows_px": "lacunarity-windows", "topology_radii_px": "topology-radii"}


def add_settings(parser: argparse.ArgumentParser) -> None:
    """An option for each setting of the analysis."""
    for f in fields(site.AnalysisConfig):
        option = "--" + SHORT.get(f.name, f.name).replace("_", "-")
        kind = str(f.type)
        if kind == "bool":
            parser.add_argument(option, dest=f.name, action="store_true")
        elif "tuple" in kind:
            parser.add_argument(option, dest=f.name, default=f.default, type=name_list if "str" in kind else (lambda t: tuple(int(x) for x in number_list(t))) if "int" in kind else number_list)
        else:
            parser.add_argument(option, dest=f.name, default=f.default, type=int if kind == "int" else float if kind == "float" else str)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridmorph", description="Spatial morphology of sites on Spark.")
    commands = p.add_subparsers(dest="command", required=True)
    one = commands.add_parser("site", help="analyse one site")
    add_settings(one)
    one.add_argument("--resolution-sweep", type=float, nargs="+")
    one.add_argument("--resolution-sweep-continue-on-error", action="store_true")
    for name, default in (("max-area-error", 0.05), ("min-r2", 0.95), ("d-cv-threshold", 0.05), ("rc-cv-threshold", 0.10)):
        one.add_argument(f"--sweep-{name}", type=float, default=default)
    batch = commands.add_parser("batch", help="run a catalog")
    for name in ("catalog", "data-root", "results-root"):
        batch.add_argument(f"--{name}", required=True)
    batch.add_argument("--mode", choices=sorted(jobs.MODES), default="final")
    batch.add_argument("--preset", choices=sorted(jobs.PRESETS))
    batch.add_argument("--subset", default="all")
    batch.add_argument("--slugs", type=name_list, default=())
    batch.add_argument("--start", type=int, default=0)
    batch.add_argument("--limit", type=int)
    add_settings(batch)
    for name, text in (("download", "fetch a catalog's data"), ("atlas", "audit, statistics and report of a batch"), ("collect", "all results as one table")):
        c = commands.add_parser(name, help=text)
        c.add_argument("--catalog")
        c.add_argument("--data-root")
        c.add_argument("--results-root")
        c.add_argument("--out")
        c.add_argument("--mode", default="final")
        c.add_argument("--endpoints", default="")
        c.add_argument("--boundaries-only", action="store_true")
    return p


def configuration(args: argparse.Namespace) -> site.AnalysisConfig:
    given = {f.name: getattr(args, f.name) for f in fields(site.AnalysisConfig)}
    if bad := sorted(set(given["transport_phases"]) - set(transport.PHASES)):
        raise SystemExit(f"unsupported transport phases: {bad}")
    return site.AnalysisConfig(**given)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("gridmorph").getOrCreate()
    if args.command == "site":
        cfg = configuration(args)
        if bool(cfg.city_name) == bool(cfg.buildings_path):
            raise SystemExit("either --city or --buildings is needed")
        if args.resolution_sweep:
            limits = {"area_error": args.sweep_max_area_error, "r2": args.sweep_min_r2, "dimension_cv": args.sweep_d_cv_threshold, "radius_cv": args.sweep_rc_cv_threshold}
            runs, verdict = site.resolution_sweep(spark, *site.load_inputs(spark, cfg), cfg, tuple(args.resolution_sweep), args.resolution_sweep_continue_on_error, **limits)
            files.write_csv(runs, f"{cfg.output_dir}/resolution_sweep_summary")
            files.write_document(verdict, f"{cfg.output_dir}/resolution_sweep_summary.json")
        else:
            site.analyze(spark, cfg)
    elif args.command == "batch":
        cfg = configuration(args)
        batch = jobs.Batch(args.catalog, args.data_root, args.results_root, args.mode, args.subset, args.slugs, args.start, args.limit)
        if args.preset:
            batch = replace(batch, **jobs.PRESETS[args.preset])
            cfg = replace(cfg, pixel_size_m=jobs.PRESET_PIXELS.get(args.preset, cfg.pixel_size_m))
        jobs.run(spark, batch, cfg).show(1000, False)
    elif args.command == "download":
        manifest = osm.download(spark, files.read_catalog(spark, args.catalog, True), args.data_root, args.boundaries_only, endpoints=args.endpoints)
        files.write_manifest(manifest, f"{args.data_root.rstrip('/')}/download_manifest")
    elif args.command == "atlas":
        jobs.postprocess(spark, files.read_catalog(spark, args.catalog), args.data_root, args.results_root, args.out, args.mode)
    else:
        files.write_csv(jobs.collected(spark, args.results_root), args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
