"""The flows from the command line: python -m carpalake prepare|predict|analyze|parity ... (-h shows their options)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .operators import images, observed, score
from .operators.shipped import ShippedModel
from .plans import pipelines
from .plans.ship import ship
from .sources import files


def options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="carpalake")
    flows = top.add_subparsers(dest="flow", required=True)
    prepare = flows.add_parser("prepare", help="clean, guard and split a cohort; keep the statistics of its train split; print its description")
    prepare.add_argument("--cohort", required=True, help="CSV with id, boneage and male")
    prepare.add_argument("--stats", default="preprocess_stats.json")
    for name, what in (("predict", "score images as they are"), ("analyze", "score images cropped to one hand")):
        flow = flows.add_parser(name, help=what)
        flow.add_argument("--requests", required=True, help="CSV with id, male (0 or 1) and ic_months (may be empty)")
        flow.add_argument("--model", required=True, help="model file with the inputs image and meta")
        flow.add_argument("--stats", default="preprocess_stats.json")
        flow.add_argument("--images", required=True, help="folder of <id>.png or <id>.jpg")
    parity = flows.add_parser("parity", help="how far two models are apart on the same images")
    parity.add_argument("--requests", required=True)
    parity.add_argument("--images", required=True)
    parity.add_argument("--models", nargs=2, required=True)
    parity.add_argument("--stats", default="preprocess_stats.json")
    for flow in flows.choices.values():
        flow.add_argument("--out", required=True, help="folder of the resulting Parquet table")
        flow.add_argument("--size", type=int, default=images.SIZE)
        flow.add_argument("--least-bytes", type=int, default=100_000, help="a model file has so many at least")
    return top


def requests(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The rows of the requests, each with its image; nulls where there is none or it can't be decoded, which scoring makes the row's error."""
    rows = spark.read.option("header", True).schema("id BIGINT, male INT, ic_months DOUBLE").csv(args.requests)
    return files.with_images(rows, files.bgr_to_rgb(files.read_images(spark, args.images, keep_invalid=True)), how="left")


def main(argv: list[str] | None = None) -> None:
    args = options().parse_args(argv)
    spark = SparkSession.builder.appName("carpalake").getOrCreate()
    ship(spark)
    if args.flow == "prepare":
        print(json.dumps(observed.write_described(pipelines.load_and_prepare(spark, args.cohort, args.stats), args.out)))
        return
    stats = files.read_stats(spark, args.stats)
    load = lambda path: ShippedModel(spark, path, least=args.least_bytes)
    if args.flow == "parity":
        out = pipelines.scorer_parity(requests(spark, args), stats, *map(load, args.models), size=args.size)
    else:
        flow = score.predict if args.flow == "predict" else score.analyze
        out = flow(requests(spark, args), stats, load(args.model), size=args.size)
    out.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
