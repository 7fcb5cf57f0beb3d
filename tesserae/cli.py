"""Command line: evaluate runs against a baseline, compare profiles, vectorise a raster file.

Exit codes: 0 done, 1 a run failed its baseline, 2 wrong input. Reports are one JSON document on standard output.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .errors import TesseraeError
from .operators import evaluation
from .plans import vectorize
from .sources import rasters


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    with open(args.baseline, encoding="utf-8") as f:
        baseline = json.load(f)
    if not isinstance(baseline, dict):
        raise ValueError("a baseline is a JSON object")
    told = evaluation.report(evaluation.read_runs(spark, *args.inputs), baseline)
    if not told["run_count"]:
        raise ValueError("no runs were found")
    print(json.dumps(told, indent=2))
    return 1 if told["status"] == "fail" else 0


def _compare(spark: SparkSession, args: argparse.Namespace) -> int:
    runs = evaluation.read_runs(spark, *args.inputs).filter("metrics IS NOT NULL AND profile IS NOT NULL")
    ranked = [r.asDict() for r in evaluation.profile_scores(runs).orderBy("rank").collect()]  # a row for each profile
    if not ranked:
        raise ValueError("no runs with metrics and a profile were found")
    print(json.dumps({"profiles": ranked, "winner": ranked[0]["profile"]}, indent=2))
    return 0


def _vectorize(spark: SparkSession, args: argparse.Namespace) -> int:
    parameters = json.loads(args.parameters)
    done = vectorize.run(rasters.read_raster(spark, args.raster), args.profile, parameters, args.output)
    print(json.dumps({"output": done.path, "warnings": done.warnings, "stages": [r.stage for r in done.reports]}, indent=2))
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tesserae", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for name, run in (("evaluate", _evaluate), ("compare", _compare)):
        own = commands.add_parser(name)
        own.add_argument("inputs", nargs="+", help="JSON files, or folders that hold them")
        own.set_defaults(run=run)
        if name == "evaluate":
            own.add_argument("--baseline", required=True)
    own = commands.add_parser("vectorize")
    own.add_argument("raster")
    own.add_argument("output")
    own.add_argument("--profile", default="regional")
    own.add_argument("--parameters", default="{}", help="a JSON object")
    own.set_defaults(run=_vectorize)
    args = parser.parse_args(argv)
    try:
        for path in getattr(args, "inputs", []):
            if "://" not in path and not os.path.exists(path):
                raise FileNotFoundError(path)
        return args.run(spark or SparkSession.builder.getOrCreate(), args)
    except (OSError, ValueError, TesseraeError, PySparkException) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
