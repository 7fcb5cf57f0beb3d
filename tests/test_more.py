"""Command line, run documents, engines, headers, stored state and several rasters at once."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tesserae import cli
from tesserae.errors import ConfigurationError, DependencyError
from tesserae.functions import geometry as G
from tesserae.functions import text
from tesserae.operators import evaluation, stencils
from tesserae.plans import engines, jobs, profiles, vectorize
from tesserae.sources import rasters, state_tables

BASELINE = {"schema_version": 1, "baseline_name": "b", "profile": "regional", "dataset_id": "d", "metrics": {"recall": {"direction": "ge", "threshold": "0.9"}, "n": {"direction": "less_equal", "threshold": 3}}}


def runs(tmp_path, **documents):
    for name, doc in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    return str(tmp_path)


def test_which_metrics_a_run_has(spark, tmp_path):
    folder = runs(
        tmp_path,
        a={"run_id": "nested", "summary": {"metrics": {"recall": "0.5"}, "note": "x"}, "metrics": {"recall": 1}},
        b={"run_id": "plain", "summary": {"recall": 0.75, "n": 2}, "metrics": {"recall": 1}},
        c={"run_id": "text", "summary": {"recall": "0.75"}, "metrics": {"recall": 0.25}},
        d={"run_id": "results", "results": {"recall": 1e-1, "flag": True, "empty": None}},
        e={"runs": [{}, {"profile_name": "edge", "metrics": {}}], "profile": "regional", "dataset_id": "d"},
    )
    got = {r.run_id: r for r in evaluation.read_runs(spark, folder, f"{folder}/a.json").collect()}
    assert {k: r.metrics for k, r in got.items()} == {"nested": {"recall": 0.5}, "plain": {"recall": 0.75, "n": 2.0}, "text": {"recall": 0.25}, "results": {"recall": 0.1}, "e#1": None, "e#2": {}}
    assert sorted(got["results"].bad) == ["empty", "flag"] and (got["e#1"].profile, got["e#2"].profile, got["e#2"].dataset_id) == ("regional", "edge", "d")


def test_evaluation_from_the_command_line(spark, tmp_path, capsys):
    baseline = tmp_path / "baseline.txt"
    baseline.write_text(json.dumps(BASELINE))
    good = {"run_id": "good", "profile": "regional", "dataset_id": "d", "metrics": {"recall": 0.95, "n": 3}}
    folder = runs(tmp_path, good=good)
    ask = lambda *more: cli.main(["evaluate", *more, "--baseline", str(baseline)], spark)
    assert ask(folder) == 0 and json.loads(capsys.readouterr().out)["status"] == "pass"
    runs(tmp_path, bad={"run_id": "bad", "profile": "edge", "dataset_id": "d", "metrics": {"recall": 0.5}})
    assert ask(folder) == 1
    told = json.loads(capsys.readouterr().out)
    assert [(r["run_id"], r["metric"], r["reason"]) for r in told["regressions"]] == [("bad", "n", "missing"), ("bad", "profile", "profile"), ("bad", "recall", "threshold")]
    assert {r["run_id"]: r["status"] for r in told["runs"]} == {"good": "pass", "bad": "fail"}
    runs(tmp_path, bad={"run_id": "bad", "metrics": {"recall": True, "n": 1}})
    assert ask(folder) == 2 and ask(f"{folder}/none.json") == 2
    runs(tmp_path, bad={"run_id": "bad", "profile": "edge", "metrics": {"recall": 0.5}})
    assert cli.main(["compare", folder], spark) == 0
    baseline.write_text("[]")
    assert ask(folder) == 2


def test_engines():
    assert engines.choose(profiles.resolve("edge")).name == "classic"
    assert engines.choose(profiles.resolve("edge", {"engine_name": "kernel"})).name == "kernel"
    with pytest.raises(ConfigurationError):
        engines.choose(profiles.resolve("edge", {"engine_name": "other"}))
    with pytest.raises(ConfigurationError):
        profiles.resolve("edge", {"canny_low": 10})
    own = engines.Engine("own", frozenset(("edge",)), *[lambda df, p: df] * 3)
    engines.register(own)
    try:
        assert engines.choose(profiles.resolve("edge", {"engine_name": "own"})) is own
        with pytest.raises(ConfigurationError):
            engines.choose(profiles.resolve("linear", {"engine_name": "own"}))
    finally:
        del engines._ENGINES["own"]


def test_rasters_of_different_sizes_each_have_their_own_frame(spark):
    pictures = {"a": [[0] * 9 for _ in range(9)], "b": [[0] * 15 for _ in range(5)]}
    for p in pictures.values():
        for y in range(1, len(p) - 1):
            for x in range(1, len(p[0]) - 1):
                p[y][x] = 255
    one = {k: rasters.read_raster(spark, {"pixels": v, "name": k}) for k, v in pictures.items()}
    ask = lambda df: sorted((r.raster_id, r.geometry_type, str(r.parts)) for r in vectorize.run(df, "linear", {"foreground_polarity": "high", "foreground_threshold": 100, "open_radius": 0, "close_radius": 0}).features.collect())
    assert ask(one["a"].unionByName(one["b"])) == sorted(ask(one["a"]) + ask(one["b"]))


def test_kernel_engine(spark):
    square = [[200 if 4 <= x < 12 and 4 <= y < 12 else 10 for x in range(16)] for y in range(16)]
    gray = rasters.read_raster(spark, square)
    edges = {(r.y, r.x) for r in stencils.canny(gray).filter("bit = 1").collect()}
    assert edges and all(min(abs(y - 3.5), abs(y - 11.5), abs(x - 3.5), abs(x - 11.5)) <= 1.5 for y, x in edges)
    assert not stencils.canny(rasters.read_raster(spark, [[7] * 6] * 6)).filter("bit = 1").count()
    assert vectorize.run(gray, "edge", {"engine_name": "kernel"}).features.count() >= 1
    assert vectorize.run(gray, "regional", {"engine_name": "kernel", "max_colors": 2}).features.count() == 1


def test_headers_and_refusals(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5 # a comment\n3 2\n255\n" + bytes(6))
    (tmp_path / "b.bmp").write_bytes(b"BM" + bytes(16) + struct.pack("<ii", 7, -5) + bytes(30))
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">IIBB", 50_000, 50_000, 8, 2))
    (tmp_path / "d.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    got = {r.path[-5:]: (r.width, r.height, r.bands) for r in rasters.probe(spark, str(tmp_path)).collect()}
    assert got == {"a.pgm": (3, 2, 1), "b.bmp": (7, 5, 3), "c.png": (50_000, 50_000, 3), "d.jpg": (None, None, None)}
    with pytest.raises(ConfigurationError):  # a bomb, told by its header: there are no pixels to inflate
        rasters.preflight((tmp_path / "c.png").read_bytes(), "c.png", 500_000_000, 16 << 30)
    with pytest.raises(ConfigurationError):
        rasters.preflight((tmp_path / "a.pgm").read_bytes(), "a.pgm", 100, 5)
    with pytest.raises(DependencyError, match="JPEG"):
        rasters.decode((tmp_path / "d.jpg").read_bytes())
    with pytest.raises(DependencyError):
        rasters.preflight(b"\x89PNG\r\n\x1a\n", "short", 1, 1)
    with pytest.raises(ConfigurationError):
        rasters.read_raster(spark, str(tmp_path / "none.png"))
    assert rasters.read_raster(spark, str(tmp_path / "a.pgm")).count() == 6


def test_state_that_is_kept(spark, tmp_path):
    log = state_tables.History(spark, str(tmp_path / "history"))
    assert log.read().count() == 0
    entry = lambda source, at, status="success": spark.createDataFrame([(source, "o", "p", status, 1, None)], state_tables.HISTORY.rsplit(", ", 1)[0]).withColumn("timestamp", F.lit(at).cast("timestamp"))
    for i in range(4):
        log.record(entry(f"s{i % 2}", f"2024-01-0{i + 1} 00:00:00", "failed" if i == 3 else "success"))
    log.record(entry("s1", "2024-01-04 00:00:00", "failed"))  # once more
    assert log.read().count() == 4 and tuple(log.statistics().first()) == (4, 3, 1, 0) and len(log.versions()) == 2
    assert [r.timestamp.day for r in log.of_source("s1").collect()] == [4, 2]
    log.remove(F.col("status") == "failed")
    assert log.read().count() == 3
    log.clear()
    assert log.read().count() == 0
    cache = state_tables.ResultCache(spark, str(tmp_path / "cache"))
    (tmp_path / "made").write_text("x")
    rows = spark.createDataFrame([("k1", str(tmp_path / "made"), "p", 3), ("k2", str(tmp_path / "gone"), None, 4)], "key string, output string, profile_id string, feature_count long").withColumn("timestamp", F.current_timestamp())
    cache.put(rows)
    assert cache.has("k1") and not cache.has("k2") and cache.get("k1").feature_count == 3
    assert cache.prune("output") == 1 and cache.read().count() == 1 and cache.prune("output") == 0
    cache.invalidate("k1")
    assert not cache.has("k1") and cache.statistics().count() == 0


def test_names_and_numbers_in_odd_cases(spark):
    row = spark.range(1).select(
        text.is_newer(F.lit("v1.10"), F.lit("1.9.9")).alias("ten"), text.is_newer(F.lit("2.0"), F.lit("2")).alias("same"), text.is_newer(F.lit(""), F.lit("x")).alias("none"),
        text.safe_name(F.lit("é/ü: 1-2_3 ")).alias("name"), text.json_safe(F.lit('a"\n')).alias("quoted"), text.strict_number(F.lit("NaN")).alias("nan"),
        text.stem(F.lit("C:\\d\\x.y.tif")).alias("stem"), text.stem(F.lit(".hidden")).alias("hidden"), text.is_semver(F.lit("1.2.3\n")).alias("line"),
    ).first()
    assert (row.ten, row.same, row.none, row.name, row.quoted, row.nan, row.stem, row.hidden, row.line) == (True, False, False, "é_ü_ 1-2_3", '"a\\"\\n"', None, "x.y", ".hidden", False)
    p = spark.range(1).select(G.probe(F.array(*(G.point(x, y) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))).alias("p"), G.drop_collinear_ring(F.array(G.point(0, 0), G.point(1, 0), G.point(2, 0))).alias("flat")).first()
    assert tuple(p.p) == (2, 2) and len(p.flat) == 3


def test_dissolve_is_built(spark):
    picture = [[0, 0, 9, 0, 0]] * 3
    done = vectorize.run(rasters.read_raster(spark, picture), "regional", {"drop_background": False, "simplify_tolerance": 0, "min_region_area": 1, "min_hole_area": 1, "dissolve_adjacent": True}).features.collect()
    assert sorted((r.geometry_type, len(r.parts), r.properties["pixel_area"], r.properties["dissolved"]) for r in done) == [("MultiPolygon", 2, "12", "true"), ("Polygon", 1, "3", "true")]


def test_batches_and_tasks(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.pgm").write_bytes(b"P5 8 8 255\n" + bytes([10] * 32 + [200] * 32))
    (tmp_path / "bad.pgm").write_bytes(b"not a picture")
    paths = [str(tmp_path / n) for n in ("a.pgm", "bad.pgm", "b.pgm")]
    shares = []
    done = jobs.batch(spark, paths, str(tmp_path), told=lambda share, _: shares.append(share)).collect()
    assert [(r.status, r.feature_count) for r in done] == [("success", 1), ("failed", 0), ("success", 1)] and shares[-1] == 1
    assert json.loads((tmp_path / "b_vectorized.geojson").read_text())["type"] == "FeatureCollection"
    assert [r.status for r in jobs.batch(spark, paths, str(tmp_path), stop_on_error=True).collect()] == ["success", "failed", "cancelled"]
    task = jobs.Task(spark, lambda token: spark.range(10).count()).start()
    assert task.wait(60) == "success" and task.result == 10
    stopped = jobs.Task(spark, lambda token: 1)
    stopped.cancel()
    assert stopped.start().wait(60) == "cancelled"
    wrong = jobs.Task(spark, lambda token: 1 / 0).start()
    assert wrong.wait(60) == "failed" and isinstance(wrong.error, ZeroDivisionError)
