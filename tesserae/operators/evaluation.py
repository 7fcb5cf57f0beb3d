"""Runs scored, checked against thresholds and ranked.

A run is ``run_id, profile, dataset_id, metrics map<string,double>``; a rule ``metric, direction, threshold, unit``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError

#: The weight of each metric in a profile's score.
WEIGHTS = {"mean_iou": 0.35, "boundary_f1": 0.30, "precision": 0.20, "recall": 0.10, "geometry_valid_ratio": 0.05}
#: Names of directions.
DIRECTIONS = {
    "ge": "gte", "gte": "gte", "greater_or_equal": "gte", "greater_equal": "gte",
    "le": "lte", "lte": "lte", "less_or_equal": "lte", "less_equal": "lte",
    "gt": "gt", "lt": "lt", "eq": "eq",
}


def canonical_direction(name: Column) -> Column:
    """The direction that a name stands for, null if none."""
    names = F.create_map(*(F.lit(x) for kv in DIRECTIONS.items() for x in kv))
    return F.try_element_at(names, F.lower(F.trim(name)))


def _numbers(text: Column) -> tuple[Column, Column, Column]:
    """Of an object in JSON: its numbers, the names of values that are none (booleans among them), whether every value is a bare number."""
    entries = F.from_json(text, "map<string,variant>")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    said = lambda v: F.when(~kind(v).isin("BOOLEAN", "VOID"), F.trim(F.try_variant_get(v, "$", "string")).try_cast("double"))
    bare = F.forall(F.map_values(entries), lambda v: kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
    numbers = F.map_filter(F.transform_values(entries, lambda k, v: said(v)), lambda k, v: v.isNotNull())
    bad = F.map_keys(F.map_filter(entries, lambda k, v: said(v).isNull()))
    return numbers, bad, (F.size(entries) > 0) & bare


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """Run documents under ``paths`` (files, or folders with ``*.json`` at any depth) as runs; a file named twice counts once.

    A document is one object, a list, or ``{"runs": [...]}``, whose profile and dataset its runs inherit. Metrics are those of
    ``summary.metrics``, else ``summary`` if all its values are numbers, else ``metrics``, else ``results``; null if there are none.
    ``bad`` names metrics that are no numbers.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(list(paths))
    files = files.select(F.input_file_name().alias("source"), "value").groupBy("source").agg(F.first("value").alias("value"))
    value = F.col("value")
    whole = F.from_json(value, "struct<profile:string,dataset_id:string,runs:array<string>>")
    listed = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")).otherwise(F.coalesce(whole["runs"], F.array(value)))
    each = files.select("source", whole["profile"].alias("p"), whole["dataset_id"].alias("d"), F.posexplode(listed).alias("i", "r"))
    at = lambda path: F.get_json_object("r", f"$.{path}")
    places = {n: F.when(F.ltrim(at(n)).startswith("{"), at(n)) for n in ("summary.metrics", "summary", "metrics", "results")}
    plain = F.coalesce(_numbers(places["summary"])[2], F.lit(False))
    chosen = F.coalesce(places["summary.metrics"], F.when(plain, places["summary"]), places["metrics"], places["results"])
    rows = each.withColumn("chosen", chosen)
    numbers, bad, _ = _numbers(F.col("chosen"))
    stem = F.regexp_extract("source", r"([^/]+)\.json$", 1)
    return rows.select(
        "source",
        F.coalesce(at("run_id"), at("id"), F.concat(stem, F.lit("#"), F.col("i") + 1)).alias("run_id"),
        F.coalesce(at("profile"), at("profile_name"), "p").alias("profile"),
        F.coalesce(at("dataset_id"), "d").alias("dataset_id"),
        numbers.alias("metrics"),
        bad.alias("bad"),
    )


def _number(value: object) -> float | None:
    """A number, or one written as text; booleans are none."""
    try:
        return None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None


def rules_frame(spark: SparkSession, baseline: Mapping) -> DataFrame:
    """A checked baseline document as rules; a handful of rows."""
    metrics = baseline.get("metrics")
    if baseline.get("schema_version") != 1 or not isinstance(metrics, Mapping) or not metrics:
        raise ConfigurationError("a baseline has schema_version 1 and metrics")
    rows = []
    for name, rule in metrics.items():
        if not isinstance(rule, Mapping):
            raise ConfigurationError(f"{name}: a rule is an object")
        direction = DIRECTIONS.get(str(rule.get("direction")).strip().lower())
        if direction is None or (threshold := _number(rule.get("threshold"))) is None:
            raise ConfigurationError(f"{name}: {json.dumps(dict(rule))} is no rule")
        rows.append((name, direction, threshold, rule.get("unit")))
    return spark.createDataFrame(rows, "metric string, direction string, threshold double, unit string")


def passes(direction: Column, actual: Column, threshold: Column) -> Column:
    return (
        F.when(direction == "gte", actual >= threshold)
        .when(direction == "gt", actual > threshold)
        .when(direction == "lte", actual <= threshold)
        .when(direction == "lt", actual < threshold)
        .otherwise(actual == threshold)
    )


def checks(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each run and rule with ``status``, ``delta`` and ``reason``; a missing metric fails. Rules are broadcast:
    they are the handful of entries of one baseline document."""
    each = runs.crossJoin(F.broadcast(rules)).withColumn("actual", F.element_at("metrics", F.col("metric")))
    up = F.col("direction").isin("gte", "gt", "eq")
    delta = F.when(up, F.col("actual") - F.col("threshold")).otherwise(F.col("threshold") - F.col("actual"))
    good = F.coalesce(passes(F.col("direction"), F.col("actual"), F.col("threshold")), F.lit(False))
    return each.select(
        "run_id", "profile", "dataset_id", "metric", "direction", "threshold", "actual", F.bround(delta, 6).alias("delta"),
        F.when(good, "pass").otherwise("fail").alias("status"),
        F.when(F.col("actual").isNull(), "missing").when(~good, "threshold").alias("reason"),
    )


def identity_checks(runs: DataFrame, baseline: Mapping) -> DataFrame:
    """A failed row for each run of another profile or dataset than the baseline names, in the columns of ``checks``."""
    rows = []
    for name in ("profile", "dataset_id"):
        if (expected := baseline.get(name)) is not None:
            other = runs.filter(~F.col(name).eqNullSafe(F.lit(expected)))
            none = [F.lit(None).cast(t).alias(c) for c, t in (("direction", "string"), ("threshold", "double"), ("actual", "double"), ("delta", "double"))]
            rows.append(other.select("run_id", "profile", "dataset_id", F.lit(name).alias("metric"), *none, F.lit("fail").alias("status"), F.lit(name).alias("reason")))
    return reduce(DataFrame.unionByName, rows) if rows else None


def report(runs: DataFrame, baseline: Mapping) -> dict:
    """The outcome of all runs against a baseline, as a document: status, runs with their checks, and what failed.

    ``ConfigurationError`` where a run has no metrics or a value that a rule asks for is no number.
    """
    rules = rules_frame(runs.sparkSession, baseline)
    asked = list(baseline["metrics"])
    wrong = runs.filter(F.col("metrics").isNull() | F.arrays_overlap("bad", F.array(*map(F.lit, asked)))).select("source", "run_id", "bad").limit(5).collect()
    if wrong:
        raise ConfigurationError("; ".join(f"{r['source']} {r['run_id']}: " + (f"no numbers: {', '.join(r['bad'])}" if r["bad"] else "no metrics") for r in wrong))
    all_checks, others = checks(runs, rules), identity_checks(runs, baseline)
    all_checks = all_checks if others is None else others.unionByName(all_checks)
    found: dict[str, dict] = {}
    for r in runs.select("source", "run_id", "profile", "dataset_id").orderBy("source", "run_id").collect():
        found[r["run_id"]] = {**r.asDict(), "status": "pass", "checks": [], "regressions": []}
    for r in all_checks.orderBy("run_id", "metric").collect():
        row = {k: v for k, v in r.asDict().items() if k not in ("run_id", "profile", "dataset_id") and v is not None}
        own = found[r["run_id"]]
        own["checks"].append(row)
        if r["status"] == "fail":
            own["status"] = "fail"
            own["regressions"].append({k: v for k, v in row.items() if k != "status"})
    lost = [{**x, "run_id": run["run_id"], "source": run["source"]} for run in found.values() for x in run["regressions"]]
    named = {k: baseline.get(k) for k in ("baseline_name", "profile", "dataset_id")}
    return {"schema_version": 1, "status": "fail" if lost else "pass", "baseline": named, "run_count": len(found), "runs": list(found.values()), "regressions": lost}


def run_status(checked: DataFrame) -> DataFrame:
    return checked.groupBy("run_id", "profile").agg(
        F.count("*").alias("n_rules"), F.count_if(F.col("status") == "fail").alias("n_failed"),
        F.when(F.count_if(F.col("status") == "fail") > 0, "fail").otherwise("pass").alias("status"),
    )


def regressions(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("status") == "fail").drop("status")


def profile_means(runs: DataFrame) -> DataFrame:
    each = runs.filter(F.col("profile").isNotNull()).select("profile", F.explode("metrics").alias("metric", "value"))
    return each.groupBy("profile", "metric").agg(F.bround(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def profile_scores(runs: DataFrame) -> DataFrame:
    """``profile, score, rank``: weighted means, a missing metric counting 0; equal scores by name."""
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("metric") == name, F.lit(w)).otherwise(weight)
    scored = profile_means(runs).groupBy("profile").agg(F.bround(F.sum(F.col("mean") * weight), 6).alias("score"))
    # One row for each profile: a window without partitions is small here.
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "profile")))


def winner(runs: DataFrame) -> DataFrame:
    return profile_scores(runs).orderBy("rank").limit(1).select("profile", "score")
