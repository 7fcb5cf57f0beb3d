"""Kernels against small pictures and hand-worked values; queries against their SQL on the smallest tables."""

import json
import math
import sqlite3
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesserae import catalog
from tesserae.errors import ConfigurationError
from tesserae.functions import geometry as G
from tesserae.functions import pixels
from tesserae.operators import evaluation, lines, regions
from tesserae.plans import profiles, vectorize
from tesserae.sources import rasters, sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def line(*points):
    return F.array(*(G.point(x, y) for x, y in points))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_areas_and_transforms(spark):
    got = one(
        spark,
        G.area(line((0, 0), (1, 0), (1, 1), (0, 1))).alias("unit"),
        G.area(line((0, 0), (4, 0), (0, 1))).alias("tri"),
        G.affine(line((10, 20)), (100, 0.5, 0, 200, 0, -0.5))[0].alias("p"),
        G.affine(line((100, 50)), (500000, 30, 0.5, 2000000, 0.5, -30))[0].alias("q"),
        G.snap(line((0.15, 0.25), (2.37, 3.82)), 0.5).alias("s"),
        G.inside(G.point(5, 5), line((0, 0), (10, 0), (10, 10), (0, 10))).alias("inside"),
        G.inside(G.point(15, 5), line((0, 0), (10, 0), (10, 10), (0, 10))).alias("outside"),
        G.drop_collinear(line((0, 0), (1, 0), (2, 0), (2, 2))).alias("d"),
        G.centroid(line((0, 0), (4, 0), (4, 2), (0, 2))).alias("c"),
    )
    assert got["unit"] == 1 and got["tri"] == 2
    assert tuple(got["p"]) == (105, 190) and tuple(got["q"]) == (503025, 1998550)
    assert [tuple(p) for p in got["s"]] == [(0, 0), (2.5, 4)]
    assert got["inside"] and not got["outside"]
    assert [tuple(p) for p in got["d"]] == [(0, 0), (2, 0), (2, 2)] and tuple(got["c"]) == (2, 1)


def test_ring_issues_and_repair(spark):
    bow = line((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))
    got = one(spark, G.ring_issues(bow).alias("bow"), G.ring_issues(line((0, 0), (1, 0))).alias("few"), G.repair_rings(F.array(line((0, 0), (0, 2), (2, 2), (2, 0)))).alias("r"))
    assert got["bow"] == ["self-intersection"] and got["few"] == ["fewer than 4 points"]
    assert [tuple(p) for p in got["r"][0]][0] == tuple(got["r"][0][-1])


def test_grayscale_rounds_halves_to_even(spark):
    assert one(spark, pixels.grayscale(F.lit(100), F.lit(50), F.lit(0)).alias("v"))["v"] == 59
    with pytest.raises(ConfigurationError):
        pixels.threshold(F.lit(1), 1, "sideways")


def test_matrix_sources(spark):
    got = {(r.y, r.x): r.v for r in rasters.read_raster(spark, [[0, 128], [(1), 32]]).collect()}
    assert got == {(0, 0): 0, (0, 1): 128, (1, 0): 1, (1, 1): 32}
    assert rasters.read_raster(spark, {"pixels": [[(100, 50)]]}).first()["v"] == 59
    for bad in ([], [[1], [1, 2]], [[()]]):
        with pytest.raises(ConfigurationError):
            rasters.from_matrix(spark, bad)


def test_decoders(tmp_path, spark):
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    pgm = b"P5\n# c\n4 3\n255\n" + image.tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    up = np.diff(image.astype(int), axis=0, prepend=0).astype(np.uint8)
    raw = b"".join(b"\2" + r.tobytes() for r in up)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    for data in (pgm, png):
        assert (rasters.decode(data)[0][:, :, 0] == image).all()
    (tmp_path / "a.pgm").write_bytes(pgm)
    got = {(r.y, r.x): r.v for r in rasters.read_raster(spark, str(tmp_path), tile=2).collect()}
    assert got == {(y, x): int(image[y, x]) for y in range(3) for x in range(4)}


def label_by_search(grid, connectivity):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * (connectivity == 8)
    seen = {}
    for y, x in zip(*np.nonzero(grid), strict=True):
        if (y, x) not in seen:
            todo = [(y, x)]
            seen[y, x] = (int(y) << 32) + int(x)
            while todo:
                a, b = todo.pop()
                for dy, dx in steps:
                    p = (a + dy, b + dx)
                    if 0 <= p[0] < grid.shape[0] and 0 <= p[1] < grid.shape[1] and grid[p] and p not in seen:
                        seen[p] = seen[y, x]
                        todo.append(p)
    return seen


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_do_not_see_tiles(spark, connectivity):
    grid = (np.random.default_rng(1).random((20, 23)) < 0.55).astype(int)
    df = rasters.read_raster(spark, grid.tolist()).withColumn("label", F.when(F.col("v") == 1, 1))
    for tile in (5, 64):
        got = {(r.y, r.x): r.component for r in regions.label_components(df, connectivity, tile=tile).collect()}
        assert got == label_by_search(grid, connectivity)


def test_polygons_with_holes_and_pinches(spark):
    grid = [[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 0, 1], [0, 0, 1, 1]]
    df = rasters.read_raster(spark, grid).withColumn("label", F.when(F.col("v") == 1, 1))
    found = regions.polygonize(regions.label_components(df, 4)).collect()
    area = lambda r: regions.ring_area([(p["x"], p["y"]) for p in r[:-1]])
    assert sorted(r.area for r in found) == [3, 7]
    assert all(sum(map(area, r.rings)) == r.area for r in found)


def test_thinning_and_tracing():
    bar = np.zeros((7, 12), np.uint8)
    bar[2:5, 1:11] = 1
    thin = lines.thin(bar)
    assert thin.sum() < bar.sum() and (thin <= bar).all()
    ys, xs = np.nonzero(thin)
    paths = lines.trace(set(zip(xs.tolist(), ys.tolist(), strict=True)))
    assert len(paths) == 1 and all(y == 3.5 for _, y in paths[0])


def test_simplify_merge():
    assert lines.simplify([(0, 0), (5, 5), (10, 5), (15, 5), (20, 0)], 1)[0] == (0, 0)
    assert lines.simplify([(0, 0), (1, 0.1), (2, 0)], 0.5) == [(0, 0), (2, 0)]
    assert lines.merge([[(0, 0), (1, 0)], [(2, 0), (1, 0)]], 0.1) == [[(0, 0), (1, 0), (2, 0)]]


def test_evaluation_documents(spark, tmp_path):
    metrics = {"mean_iou": 0.95, "precision": 0.96, "recall": True and 0.8}
    (tmp_path / "a.json").write_text(json.dumps({"profile": "regional", "dataset_id": "d", "runs": [{"id": "one", "metrics": metrics}, {"results": {"recall": 1}}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"run_id": "x", "profile": "edge", "summary": {"metrics": {"recall": 0.5}}}]))
    runs = evaluation.read_runs(spark, str(tmp_path))
    assert sorted(r.run_id for r in runs.collect()) == ["a#2", "one", "x"]
    rules = evaluation.rules_frame(spark, {"schema_version": 1, "metrics": {"recall": {"direction": " GREATER_EQUAL ", "threshold": 0.9}}})
    assert {r.run_id: r.status for r in evaluation.run_status(evaluation.checks(runs, rules)).collect()} == {"one": "fail", "a#2": "pass", "x": "fail"}
    with pytest.raises(ConfigurationError):
        evaluation.rules_frame(spark, {"schema_version": 2})


def test_sinks(spark, tmp_path):
    result = vectorize.run(rasters.read_raster(spark, [[50] * 4 + [200] * 4] * 8), "regional", {"drop_background": False, "simplify_tolerance": 0}, str(tmp_path / "a.geojson"), (100, 1, 0, 200, 0, -1))
    doc = json.loads((tmp_path / "a.geojson").read_text())
    assert doc["type"] == "FeatureCollection" and len(doc["features"]) == 2 and [r.status for r in result.reports] == ["completed"] * 4
    ring = doc["features"][0]["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and {tuple(p) for p in ring} == {(100, 200), (104, 200), (104, 192), (100, 192)}
    sinks.export(result.features, str(tmp_path / "a.gpkg"))
    with sqlite3.connect(tmp_path / "a.gpkg") as db:
        assert db.execute("SELECT count(*), max(pixel_area) FROM features").fetchone() == (2, "32")


def test_profiles():
    with pytest.raises(ConfigurationError):
        profiles.resolve("aerial")
    with pytest.raises(ConfigurationError):
        profiles.execution_policy(profiles.resolve("regional"), 50_000, 50_000, 4)
    assert profiles.execution_policy(profiles.resolve("regional", {"memory_policy": "auto"}), 20_000, 20_000)[0] == "tiled"
    assert len(profiles.tile_plan(4, 4, 2)) == 4


@pytest.mark.parametrize("mode, key, value", [("regional", "background_policy", "border"), ("edge", "edge_to_polygon", True), ("linear", "extract_topology", True)])
def test_unbuilt_parameters_are_refused(mode, key, value):
    with pytest.raises(ConfigurationError):
        profiles.resolve(mode, {key: value})
    assert profiles.resolve(mode, {key: profiles.DEFAULTS[mode][key]})[key] == profiles.DEFAULTS[mode][key]


def test_rings_that_cross_do_not_pass(spark):
    box = [(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)]
    bow, small = [(2, 2), (9, 9), (9, 2), (2, 12), (2, 2)], [(12, 12), (12, 13), (14, 13), (14, 12), (12, 12)]
    good = [(2, 14), (2, 18), (6, 18), (6, 14), (2, 14)]
    real = lambda *rings: [[(float(x), float(y)) for x, y in ring] for ring in rings]
    rows = [("r", 1, 1, 9, real(box, bow, good, small)), ("r", 1, 2, 9, real(bow, good))]
    found = spark.createDataFrame(rows, "raster_id string, label int, component long, area long, rings array<array<struct<x:double,y:double>>>")
    kept = vectorize.postprocess(found, profiles.resolve("regional")).collect()
    assert [[sorted({tuple(p) for p in r}) for r in part] for k in kept for part in k.parts] == [[sorted(set(box)), sorted(set(good))]]
    dip = [(0, 0), (10, -1.8), (20, 0), (20, 10), (10.5, 10), (10, -1), (9.5, 10), (0, 10), (0, 0)]
    deep = spark.createDataFrame([("r", 1, 1, 9, real(dip))], found.schema)
    ring = vectorize._rings(deep, 2.0, 4.0).select(F.col("rings")[0].alias("r"), G.ring_issues(F.col("rings")[0]).alias("bad")).first()
    assert ring["bad"] == [] and [tuple(p) for p in ring["r"]] == dip


def rows_of(columns, rows):
    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_match_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    expected = duck.sql(catalog.SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
