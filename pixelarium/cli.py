"""Command line: ``python -m pixelarium.cli build|coarse|histogram|diagnose ...``."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

from pixelarium.operators import build, coarse, diagnostics
from pixelarium.operators.build import SCHEMA
from pixelarium.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pixelarium")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="pixel table from rasters and a boundary")
    b.add_argument("data_dir")
    b.add_argument("boundary_kml")
    b.add_argument("folder")
    b.add_argument("--year", type=int, default=2024)
    b.add_argument("--block-size", type=int, default=512)
    c = sub.add_parser("coarse", help="coarse index of a pixel table")
    c.add_argument("folder")
    c.add_argument("--stride", type=int, default=coarse.STRIDE)
    c.add_argument("--reduced-dim", type=int, default=coarse.REDUCED)
    c.add_argument("--projection-seed", type=int, default=coarse.SEED)
    h = sub.add_parser("histogram", help="density picture and report")
    h.add_argument("folder")
    d = sub.add_parser("diagnose", help="reports over a pixel table or a raster folder")
    d.add_argument("report", choices=["points", "boxes", "tif-overview", "tif-pixels"])
    d.add_argument("folder")
    return top


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = SparkSession.builder.appName("pixelarium").getOrCreate()
    folder = args.folder
    if args.command == "build":
        r = build.build_index(spark, args.data_dir, args.boundary_kml, folder, year=args.year, block_size=args.block_size)
        out = {"tile_count": r.tile_count, "vector_count": r.vector_count, "folder": r.folder, "index_type": r.index_type}
    elif args.command == "diagnose" and args.report.startswith("tif"):
        out = diagnostics.tif_overview(spark, folder) if args.report == "tif-overview" else diagnostics.tif_pixel_sampling(spark, folder)
    else:
        if not files.exists(spark, f"{folder}/pixels.parquet"):
            raise FileNotFoundError(f"Missing pixel table: {folder}/pixels.parquet")
        pixels, info = spark.read.schema(SCHEMA).parquet(f"{folder}/pixels.parquet"), files.read_json(spark, f"{folder}/build_info.json")
        if args.command == "coarse":
            out = coarse.save_coarse(coarse.build_coarse(pixels, stride=args.stride, reduced=args.reduced_dim, seed=args.projection_seed, source_info=info), folder)
        elif args.command == "histogram":
            out = diagnostics.distribution_report(pixels, folder, info)
        else:
            out = diagnostics.point_sampling(pixels, info=info) if args.report == "points" else diagnostics.box_report(pixels, info)
        if args.command != "coarse":
            files.write_json(spark, f"{folder}/diagnostics/{args.command if args.command != 'diagnose' else args.report}.json", out)
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
