"""Inputs on which time once grew with the square of a column, a ring or a cell."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae import catalog, storage
from tesserae.functions import crossings
from tesserae.functions import geometry as G
from tesserae.operators import features, graph, regions, stencils
from tesserae.sources import rasters


def striped(spark, height, width=3, band=10):
    """``raster_id, y, x, v``: bands of rows, dark and light in turn."""
    cells = spark.range(height).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return cells.select(F.lit("r").alias("raster_id"), "y", "x", (F.expr(f"y div {band}") % 2 * 200).cast("int").alias("v"))


def test_canny_of_tall_columns(spark):
    """a tall picture has the edges of a short one again and again, and takes no time that grows with its square."""
    def inner(height):
        rows = stencils.canny(striped(spark, height)).filter("bit = 1").collect()
        return [(r.y % 20, r.x) for r in rows if 20 <= r.y < height - 20]

    short, began = inner(100), time.time()
    tall = inner(50_000)
    assert time.time() - began < 60
    assert short and set(tall) == set(short) and len(tall) == len(set(short)) * 49_960 // 20


def open_frames(df) -> bool:
    """Whether the plan has a window frame that runs to the end of its partition."""
    return "unboundedfollowing" in df._jdf.queryExecution().optimizedPlan().toString().lower()


def plain_blur(v, weights):
    """Weighted sums along both axes, the border repeated, halves to the even number."""
    r, n = len(weights) // 2, sum(weights) ** 2
    wide = np.pad(v, r, mode="edge")
    sums = sum(w * u * wide[i : i + v.shape[0], j : j + v.shape[1]] for i, w in enumerate(weights) for j, u in enumerate(weights))
    return np.rint(sums / n).astype(int)


def picture(spark, shape, seed):
    v = np.random.default_rng(seed).integers(0, 256, shape)
    return v, rasters.gray(rasters.from_matrix(spark, v.tolist()))


def test_wide_gaussians(spark):
    """by widths of 5 and 7, pictures narrower than the kernel too, each step by a look at one neighbour."""
    for size, shape in ((5, (9, 7)), (5, (1, 2)), (7, (2, 11)), (7, (8, 1))):
        v, df = picture(spark, shape, size)
        blurred = stencils.gaussian_blur(df, size)
        assert not open_frames(blurred)
        assert {(r.y, r.x): r.v for r in blurred.collect()} == dict(np.ndenumerate(plain_blur(v, stencils.KERNELS[size])))


def exchanges(df) -> int:
    """How often the plan deals pixels out by a key."""
    return df._jdf.queryExecution().executedPlan().toString().partition("Generate posexplode")[0].count("Exchange hashpartitioning")


def vectors(spark, folder) -> str:
    """A table of ``embeddings`` with a gap, vectors of several lengths, none and without a component."""
    rows = [(7, [0.5, -0.5, 0.1, 0.0, -0.2]), (0, [0.4] * 3), (1, None), (2, []), (3, [-0.1, 0.3]), (12, [0.2, None, 0.3, 0.5, 0.5, -0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_wide_gaussian_of_vectors(spark, tmp_path):
    """pixels are dealt out once, by columns, as their vectors were dealt out by rows; values are those of pixels that were not."""
    got = catalog.QUERIES["gaussian_blur_5"](spark, vectors(spark, tmp_path))
    want = stencils.gaussian_blur(rasters.embedding_raster(spark, str(tmp_path)), 5).drop("raster_id").collect()
    assert len(want) == 16 and sorted(got.collect()) == sorted(want)
    assert exchanges(got) == 1


def test_containment_of_copies(spark):
    """copies of a point are asked about once, and rings whose box misses it not at all."""
    n, double = 6_000, lambda v: F.lit(v).cast("double")
    points = spark.range(n).select(F.col("id").alias("point_id"), double(8.5).alias("x"), double(8.5).alias("y"))
    points = points.unionByName(spark.createDataFrame([(-1, 1.0, 1.0), (-2, 9.0, 8.0), (-2, 9.0, 8.0), (-3, None, 1.0)], "point_id long, x double, y double"))
    corners = lambda *p: F.array(*(G.point(double(x), double(y)) for x, y in p))
    diamond = spark.range(1).select(F.lit(-1).cast("long").alias("id"), corners((8, 0), (16, 8), (8, 16), (0, 8)).alias("ring"))
    small = spark.range(n).select("id", corners((0, 0), (2, 0), (2, 2), (0, 2)).alias("ring"))
    began = time.time()
    found = features.contained(points, diamond.unionByName(small)).groupBy("point_id", (F.col("id") < 0).alias("diamond")).count().collect()
    assert time.time() - began < 30
    assert {(r.point_id, r.diamond): r["count"] for r in found} == {(i, True): 1 for i in range(n)} | {(-1, False): n, (-2, True): 2}


def test_gaussian_of_thin_pictures(spark):
    """by the width of 3, of pictures of one row, of one column and of one pixel too, without a frame open to its end."""
    for shape in ((6, 5), (1, 9), (9, 1), (1, 1)):
        v, df = picture(spark, shape, 3)
        blurred = stencils.gaussian_blur(df)
        assert not open_frames(blurred)
        assert {(r.y, r.x): r.v for r in blurred.collect()} == dict(np.ndenumerate(plain_blur(v, stencils.KERNELS[3])))


def test_gaussian_of_vectors(spark, tmp_path):
    """by the width of 3, pixels are dealt out once, by columns, and values are those of pixels that were not dealt by rows."""
    got = catalog.QUERIES["gaussian_blur"](spark, vectors(spark, tmp_path))
    want = stencils.gaussian_blur(rasters.embedding_raster(spark, str(tmp_path))).drop("raster_id").collect()
    assert len(want) == 16 and sorted(got.collect()) == sorted(want)
    assert exchanges(got) == 1


def test_classes_of_a_step(spark):
    """of two equally steep columns the first is an edge, in every row; no frame is open to its end."""
    df = rasters.gray(rasters.from_matrix(spark, [[0] * 4 + [200] * 4] * 5))
    classes = stencils.canny_classes(stencils.gaussian_blur(df), 160, 260)
    assert not open_frames(classes)
    assert {(r.y, r.x, r["class"]) for r in classes.collect()} == {(y, x, 2 * (x == 3)) for y in range(5) for x in range(8)}


def test_classes_of_vectors(spark, tmp_path):
    """pixels are dealt out three times, and not anew for each of six steps; classes are those of plain arrays, at borders too."""
    v = np.random.default_rng(8).integers(0, 256, (23, 17))
    v[:, 8:] //= 4
    rows = [(y, [(int(c) - 0.25) / 255 - 0.5 for c in row]) for y, row in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    b = np.pad(plain_blur(v, stencils.KERNELS[3]), 1, mode="edge")
    d, s = b[:, 2:] - b[:, :-2], b[:, :-2] + 2 * b[:, 1:-1] + b[:, 2:]
    gx, gy = d[:-2] + 2 * d[1:-1] + d[2:], s[2:] - s[:-2]
    m = np.pad(abs(gx) + abs(gy), 1)
    want = {}
    for (y, x), g in np.ndenumerate(m[1:-1, 1:-1]):
        h, w = abs(gx[y, x]), abs(gy[y, x]) * 32_768
        flat, steep, sign = w < h * 13_573, w > h * (13_573 + 65_536), 1 if (gx[y, x] < 0) == (gy[y, x] < 0) else -1
        dy, dx = (0, 1) if flat else (1, 0) if steep else (1, sign)
        before, after = m[y + 1 - dy, x + 1 - dx], m[y + 1 + dy, x + 1 + dx]
        top = g > before and (g >= after if flat or steep else g > after)
        want[y, x] = int(top and g > 160) + int(top and g > 260)
    got = catalog.QUERIES["canny_classes"](spark, str(tmp_path))
    assert {(r.y, r.x): r["class"] for r in got.collect()} == want and set(want.values()) == {0, 1, 2}
    assert exchanges(got) == 3


def random_labels(shape, seed, kinds=3):
    return np.random.default_rng(seed).integers(0, kinds, shape)


def edges_of(cells):
    """Directed unit edges around a set of pixels (y, x)."""
    out = []
    for y, x in sorted(cells):
        for dy, dx, e in ((-1, 0, (x, y, x + 1, y)), (0, 1, (x + 1, y, x + 1, y + 1)), (1, 0, (x + 1, y + 1, x, y + 1)), (0, -1, (x, y + 1, x, y))):
            if (y + dy, x + dx) not in cells:
                out.append(e)
    return out


def test_groups_are_traced_as_alone():
    """rings of many groups at once are those that tracing gives of each, in the same order."""
    groups = [{(y, x) for (y, x), v in np.ndenumerate(random_labels(shape, seed, 2)) if v} for seed, shape in enumerate([(1, 1), (2, 2), (7, 5), (12, 12), (3, 40), (30, 30)] * 3)]
    groups = [g for g in groups if g]
    rows = [(i, *e) for i, g in enumerate(groups) for e in edges_of(g)]
    np.random.default_rng(1).shuffle(rows)
    group, size, x, y = regions.trace_groups(*np.array(rows).T)
    got, at = [], 0
    for g, n in zip(group, size, strict=True):
        got.append((g, list(zip(x[at : at + n].tolist(), y[at : at + n].tolist(), strict=True))))
        at += n
    want = []
    for i, g in enumerate(groups):
        want += [(i, r) for r in sorted(regions.trace_rings(edges_of(g)), key=lambda r: (-abs(regions.ring_area(r)), r))]
    assert got == want


def test_faults_of_many_rings(spark):
    """what numpy says of rings is what the expression says, for sound, open, short, repeated and crossing ones of all scales."""
    r = np.random.default_rng(5)
    rings = [[], [(0.0, 0.0)], [(0.0, 0.0)] * 5, [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)], [(0.0, 0.0), (2.0, 0.0), (2.0, float("nan")), (0.0, 2.0), (0.0, 0.0)]]
    for k in range(400):
        n = int(r.integers(2, 9))
        p = r.integers(-3, 4, (n, 2)) * (1.0, 1e6, 0.1)[k % 3] if k % 2 else r.normal(size=(n, 2)) ** 5
        angle = np.sort(r.uniform(0, 6.28, n))
        p = np.stack([np.cos(angle), np.sin(angle)], 1) * (1 + 100 * (k % 7 == 0)) if k % 4 == 0 else p
        ring = [tuple(map(float, q)) for q in p]
        rings.append(ring + ring[: k % 5 > 0])
    parts = [[rings[i : i + 2], [rings[i]]][: 1 + i % 2] for i in range(len(rings))] + [[], [[]]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], f"i int, parts array<array<{G.POINTS}>>")
    got = df.select(features.all_sound("parts").alias("a"), F.forall("parts", features.sound).alias("b")).collect()
    assert all(g.a == g.b for g in got) and len({g.a for g in got}) == 2
    points = df.select(F.explode(F.flatten("parts")).alias("ring")).select(F.size(G.ring_issues(F.col("ring"))) > 0, "ring").collect()
    faults = crossings.faulty(pa.array([[{"x": q.x, "y": q.y} for q in p.ring] for p in points], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    assert faults.tolist() == [p[0] for p in points]


def test_dissolve_of_a_long_ring(spark):
    """a class with a ring of 80,000 corners is dissolved without comparing each edge with each."""
    n = 20_000
    teeth = [(float(2 * i + a), float(b)) for i in range(n) for a, b in ((0, 1), (0, 0), (1, 0), (1, 1))]
    ring = [*teeth, (2.0 * n, 1.0), (2.0 * n, 2.0), (0.0, 2.0)]
    kinds = {"a": ring, "b": [*ring[:-3], (2.0 * n, 1.0), (2.0 * n, 0.5), (0.0, 0.5)]}
    rows = [("r", i, "Polygon", [[[*p, p[0]]]], {"class_id": k, "pixel_area": "7"}) for i, (k, p) in enumerate(kinds.items())]
    polygons = spark.createDataFrame(rows, f"raster_id string, feature_index long, geometry_type string, parts array<array<{G.POINTS}>>, properties map<string,string>")
    began = time.time()
    done = features.dissolve(polygons).select(F.element_at("properties", "class_id").alias("c"), F.size(F.flatten("parts")[0]).alias("n")).collect()
    assert time.time() - began < 60
    assert [(d.c, d.n) for d in done] == [("a", len(ring) + 1)]


def test_components_of_a_long_chain_of_tiles(spark, monkeypatch):
    """a component through 60 tiles in a row is joined in rounds that halve it, not one tile a round."""
    tables = []
    monkeypatch.setattr(graph, "saved", lambda df, name: tables.append(name) or storage.saved(df, name))
    column = spark.range(120).select(F.lit("r").alias("raster_id"), F.col("id").cast("int").alias("y"), F.lit(3).alias("x"), F.when(F.col("id") != 90, 1).alias("label"))
    found = regions.label_components(column, 4, tile=2).collect()
    assert {r.y: r.component for r in found} == {y: (0 if y < 90 else 91) << 32 | 3 for y in range(120) if y != 90}
    assert tables.count("cc-step") < 20
