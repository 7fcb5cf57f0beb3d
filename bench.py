"""Headline queries, timed: one JSON line. BENCH_SF_DIR is the input, BENCH_CPUS the number of threads."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from tesserae import catalog  # noqa: E402

HEADLINES = ("region_area", "gray_rgb", "otsu", "sobel", "morph_close", "majority", "components_4", "boundary_edges", "polyline_length", "eval_checks", "vectorize_edge", "vectorize_linear", "vectorize_regional")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["px_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the workers
    took = {}
    for name in HEADLINES:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
