"""The engine's queries, each beside the SQL that gives the same rows.

The pictures are made of tables: ``emb`` has a row of pixels for each vector of ``embeddings``; ``li`` is an RGB heat map of
``lineitem``; lines are each user's ``events`` in order; run metrics come from ``labels`` and ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import pixels
from .operators import aggregates, evaluation, lines, regions, state, stencils
from .plans import profiles, vectorize
from .sources import rasters, sinks
from .streaming import runs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PX = """px AS (SELECT vec_id::INT AS y, (i - 1)::INT AS x,
  greatest(0, least(255, round_even((c::DOUBLE + 0.5) * 255, 0)))::INT AS v
  FROM (SELECT vec_id, unnest(embedding) AS c, generate_subscripts(embedding, 1) AS i FROM embeddings))"""
MASK = "mask AS (SELECT y, x, (v >= 150)::INT AS bit FROM px)"
LABELS = "labels_ AS (SELECT y, x, least(7, v // 85)::INT AS label FROM px)"
NEXT = "WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def emb(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return rasters.embedding_raster(spark, sf_dir, dealt)


def mask(spark: SparkSession, sf_dir: str, at: int = 150) -> DataFrame:
    return emb(spark, sf_dir).select("raster_id", "y", "x", pixels.threshold(F.col("v"), at).alias("bit"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb(spark, sf_dir).select("raster_id", "y", "x", pixels.bucket_label(F.col("v")).alias("label"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, points``: each user's events as a line (event id over 10, value)."""
    rows = rasters.table(spark, sf_dir, "events").filter(F.col("user_id").isNotNull())
    p = F.struct("event_id", (F.col("event_id") / 10).alias("x"), F.col("value").cast("double").alias("y"))
    own = rows.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(p)).alias("p"))
    return own.select("id", F.transform("p", lambda q: G.point(q["x"], q["y"])).alias("points"))


EV = """ev AS (SELECT user_id AS id, event_id, event_id / 10 AS x, value::DOUBLE AS y,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE user_id IS NOT NULL)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ring``: a rectangle for each part, by its key and size."""
    rows = rasters.table(spark, sf_dir, "part")
    x, y = F.col("p_partkey") % 100, F.col("p_partkey") % 37
    w, h = F.col("p_size") + 1, F.col("p_size") % 7 + 1
    ring = F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h))
    return rows.select(F.col("p_partkey").alias("id"), ring.alias("ring"))


BOX = """box AS (SELECT p_partkey AS id, (p_partkey % 100)::DOUBLE AS x, (p_partkey % 37)::DOUBLE AS y,
  (p_size + 1)::DOUBLE AS w, (p_size % 7 + 1)::DOUBLE AS h FROM part)"""


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each source with labelled documents: quality is the truth, a document that isn't toxic the prediction."""
    rows = rasters.table(spark, sf_dir, "labels").join(rasters.table(spark, sf_dir, "documents"), "doc_id")
    t, p = F.col("quality") == 1, F.col("toxic") == 0
    n = rows.groupBy(F.col("source").alias("run_id"), F.col("lang").alias("profile")).agg(
        F.count_if(t & p).alias("both"), F.count_if(t | p).alias("any"), F.count_if(t).alias("t"), F.count_if(p).alias("p")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.bround(F.col(a) / F.col(b), 6)).otherwise(0.0)
    metrics = F.create_map(F.lit("mean_iou"), ratio("both", "any"), F.lit("precision"), ratio("both", "p"), F.lit("recall"), ratio("both", "t"))
    return n.select("run_id", "profile", F.lit("labels").alias("dataset_id"), metrics.alias("metrics"))


LB = """n AS (SELECT source AS run_id, lang AS profile, count(*) FILTER (quality = 1 AND toxic = 0) AS both_,
  count(*) FILTER (quality = 1 OR toxic = 0) AS any_, count(*) FILTER (quality = 1) AS t, count(*) FILTER (toxic = 0) AS p
  FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
m AS (SELECT run_id, profile, 'mean_iou' AS metric, CASE WHEN any_ > 0 THEN round_even(both_ / any_, 6) ELSE 0 END AS actual FROM n
  UNION ALL SELECT run_id, profile, 'precision', CASE WHEN p > 0 THEN round_even(both_ / p, 6) ELSE 0 END FROM n
  UNION ALL SELECT run_id, profile, 'recall', CASE WHEN t > 0 THEN round_even(both_ / t, 6) ELSE 0 END FROM n)"""
RULES = "rules AS (SELECT * FROM (VALUES ('mean_iou', 'gte', 0.9), ('precision', 'gte', 0.95), ('recall', 'gte', 0.9), ('boundary_f1', 'gte', 0.88)) AS r(metric, direction, threshold))"
BASELINE = {
    "schema_version": 1,
    "metrics": {k: {"direction": "gte", "threshold": v} for k, v in (("mean_iou", 0.9), ("precision", 0.95), ("recall", 0.9), ("boundary_f1", 0.88))},
}


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log of runs."""
    kind = F.col("event_id") % 5
    status = F.when(kind == 0, "failed").when(kind == 1, "cancelled").otherwise("success")
    return rasters.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("source_path"), F.col("event_type").alias("profile_id"), status.alias("status"), (F.col("event_id") % 11).alias("feature_count")
    )


HI = """h AS (SELECT event_id, ts AS timestamp, user_id::VARCHAR AS source_path, event_type AS profile_id,
  CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' ELSE 'success' END AS status, event_id % 11 AS feature_count FROM events)"""

# Scans and projections


@query(f"WITH {PX} SELECT y, x, v FROM px")
def px_scan(spark, sf_dir):
    return emb(spark, sf_dir).select("y", "x", "v")


@query(f"WITH {PX} SELECT y, x, v FROM px")
def tile_round_trip(spark, sf_dir):
    return rasters.from_tiles(rasters.to_tiles(emb(spark, sf_dir))).select("y", "x", "v")


@query("""WITH c AS (SELECT (l_partkey % 64)::INT AS y, (l_suppkey % 64)::INT AS x, count(*) FILTER (l_returnflag = 'A') AS a,
  count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL),
g AS (SELECT (i // 64)::INT AS y, (i % 64)::INT AS x FROM range(4096) t(i)),
p AS (SELECT g.y, g.x, least(255, coalesce(a, 0) * 4) AS r, least(255, coalesce(n, 0) * 4) AS g, least(255, coalesce(b, 0) * 4) AS b FROM g LEFT JOIN c ON g.y = c.y AND g.x = c.x)
SELECT y, x, round_even(r::DOUBLE * 0.299::DOUBLE + g::DOUBLE * 0.587::DOUBLE + b::DOUBLE * 0.114::DOUBLE, 0)::INT AS v FROM p""")
def gray_rgb(spark, sf_dir):
    li = rasters.lineitem_raster(spark, sf_dir)
    return li.select("y", "x", pixels.grayscale(F.col("r"), F.col("g"), F.col("b")).alias("v"))


@query(f"WITH {PX} SELECT y, x, v AS r, v AS g, v AS b FROM px")
def rgb_expand(spark, sf_dir):
    rgb = emb(spark, sf_dir).select("y", "x", pixels.as_rgb(F.col("v")).alias("c"))
    return rgb.select("y", "x", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate("rgb")))


@query(f"WITH {PX} SELECT y, x, (v >= 150)::INT AS bit FROM px")
def threshold_high(spark, sf_dir):
    return mask(spark, sf_dir).select("y", "x", "bit")


@query(f"WITH {PX} SELECT y, x, (v <= 100)::INT AS bit FROM px")
def threshold_low(spark, sf_dir):
    return emb(spark, sf_dir).select("y", "x", pixels.threshold(F.col("v"), 100, "low").alias("bit"))


@query(f"WITH {PX}, {LABELS} SELECT y, x, label FROM labels_")
def quantize_bucket(spark, sf_dir):
    return labels(spark, sf_dir).select("y", "x", "label")


@query(f"""WITH {PX}, {MASK}, e AS (SELECT bit, count(*) AS n, min(y * 100000::BIGINT + x) AS place FROM mask GROUP BY bit),
k AS (SELECT bit, (row_number() OVER (ORDER BY n DESC, place) - 1)::INT AS label FROM e) SELECT y, x, label FROM mask JOIN k USING (bit)""")
def quantize_rank(spark, sf_dir):
    return aggregates.quantize(mask(spark, sf_dir).withColumnRenamed("bit", "v")).select("y", "x", "label")


# Aggregates and thresholds


@query(f"WITH {PX} SELECT v, count(*) AS n FROM px GROUP BY v")
def histogram(spark, sf_dir):
    return aggregates.histogram(emb(spark, sf_dir)).select("v", "n")


@query(f"WITH {PX} SELECT v, count(*) AS n FROM px GROUP BY v ORDER BY n DESC, min(y * 100000::BIGINT + x) LIMIT 1")
def dominant_value(spark, sf_dir):
    return aggregates.dominant(emb(spark, sf_dir)).select("v", "n")


OTSU = """b AS (SELECT v, count(*)::DOUBLE AS n FROM px GROUP BY v),
s AS (SELECT v, sum(n) OVER (ORDER BY v) AS wb, sum(v * n) OVER (ORDER BY v) AS sb, sum(n) OVER () AS w, sum(v * n) OVER () AS s FROM b),
t AS (SELECT v, CASE WHEN w > wb THEN wb * (w - wb) * (sb / wb - (s - sb) / (w - wb)) * (sb / wb - (s - sb) / (w - wb)) ELSE 0 END AS q FROM s),
o AS (SELECT CASE WHEN q > 0 THEN v ELSE 0 END::INT AS threshold FROM t ORDER BY q DESC, v LIMIT 1)"""
MEDIAN = "md AS (SELECT min(v)::INT AS threshold FROM (SELECT v, sum(count(*)) OVER (ORDER BY v) AS c, sum(count(*)) OVER () AS total FROM px GROUP BY v) WHERE c > total // 2)"


@query(f"WITH {PX}, {OTSU} SELECT threshold FROM o")
def otsu(spark, sf_dir):
    return aggregates.otsu(emb(spark, sf_dir)).select("threshold")


@query(f"WITH {PX}, {MEDIAN} SELECT threshold FROM md")
def auto_threshold(spark, sf_dir):
    return aggregates.upper_median(emb(spark, sf_dir)).select("threshold")


@query(f"WITH {PX}, {OTSU}, {MEDIAN} SELECT CASE WHEN o.threshold <> 0 THEN o.threshold ELSE md.threshold END AS threshold FROM o, md")
def threshold_cascade(spark, sf_dir):
    return aggregates.auto_threshold(emb(spark, sf_dir)).select("threshold")


@query(f"WITH {PX} SELECT (y // 32)::INT AS ty, (x // 32)::INT AS tx, count(*) AS n, min(v) AS low, max(v) AS high, sum(v)::BIGINT AS total FROM px GROUP BY ALL")
def tile_stats(spark, sf_dir):
    return aggregates.tile_statistics(emb(spark, sf_dir), 32).drop("raster_id")


KMEANS = ["b AS MATERIALIZED (SELECT v, count(*) AS n FROM px GROUP BY v)", "c0 AS (SELECT i AS k, low + (high - low) * (i + 0.5) / 8 AS c FROM range(8) t(i), (SELECT min(v) AS low, max(v) AS high FROM b))"]
for _i in range(11):
    KMEANS.append(f"a{_i} AS MATERIALIZED (SELECT v, n, arg_min(k, (abs(c - v), k)) AS k FROM b, c{_i} GROUP BY v, n)")
    KMEANS.append(f"c{_i + 1} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY m) - 1 AS k, m AS c FROM (SELECT c.k, coalesce(sum(a.n * a.v) / sum(a.n), c.c) AS m FROM c{_i} c LEFT JOIN a{_i} a ON a.k = c.k GROUP BY c.k, c.c))")


@query(f"WITH {PX}, {', '.join(KMEANS)} SELECT k::INT AS label, sum(n)::BIGINT AS n FROM a10 GROUP BY k")
def kmeans_1d(spark, sf_dir):
    return aggregates.kmeans_1d(emb(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {PX}, c AS (SELECT count(*) FILTER (v >= 150 AND v >= 140) AS intersection, count(*) FILTER (v >= 150 OR v >= 140) AS union_n,
  count(*) FILTER (v >= 150) AS p, count(*) FILTER (v >= 140) AS t FROM px)
SELECT intersection, union_n, round_even(intersection / union_n, 6) AS iou, round_even(intersection / p, 6) AS precision, round_even(intersection / t, 6) AS recall FROM c""")
def iou_matrix(spark, sf_dir):
    return aggregates.iou(mask(spark, sf_dir), mask(spark, sf_dir, 140)).drop("raster_id")


# Neighbourhoods


@query(f"""WITH {PX}, a AS (SELECT y, x, coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v) AS d,
  coalesce(lag(v) OVER r, v) + 2 * v + coalesce(lead(v) OVER r, v) AS s FROM px WINDOW r AS (PARTITION BY y ORDER BY x))
SELECT y, x, (abs(coalesce(lag(d) OVER c, d) + 2 * d + coalesce(lead(d) OVER c, d)) + abs(coalesce(lead(s) OVER c, s) - coalesce(lag(s) OVER c, s)))::INT AS mag
FROM a WINDOW c AS (PARTITION BY x ORDER BY y)""")
def sobel(spark, sf_dir):
    return stencils.sobel(emb(spark, sf_dir)).drop("raster_id")


@query(f"""WITH {PX}, a AS (SELECT y, x, coalesce(lag(v) OVER r, v) + 2 * v + coalesce(lead(v) OVER r, v) AS s FROM px WINDOW r AS (PARTITION BY y ORDER BY x))
SELECT y, x, round_even((coalesce(lag(s) OVER c, s) + 2 * s + coalesce(lead(s) OVER c, s)) / 16, 0)::INT AS v FROM a WINDOW c AS (PARTITION BY x ORDER BY y)""")
def gaussian_blur(spark, sf_dir):
    return stencils.gaussian_blur(emb(spark, sf_dir, dealt=True)).drop("raster_id")


def _morph(f: str, source: str, name: str) -> str:
    frame = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
    return f"""{name}_r AS (SELECT y, x, {f}(bit) OVER (PARTITION BY y ORDER BY x {frame}) AS bit FROM {source}),
{name} AS (SELECT y, x, {f}(bit) OVER (PARTITION BY x ORDER BY y {frame}) AS bit FROM {name}_r)"""


@query(f"WITH {PX}, {MASK}, {_morph('max', 'mask', 'd')} SELECT y, x, bit FROM d")
def dilate(spark, sf_dir):
    return stencils.dilate(mask(spark, sf_dir)).drop("raster_id")


@query(f"WITH {PX}, {MASK}, {_morph('min', 'mask', 'd')} SELECT y, x, bit FROM d")
def erode(spark, sf_dir):
    return stencils.erode(mask(spark, sf_dir)).drop("raster_id")


@query(f"WITH {PX}, {MASK}, {_morph('min', 'mask', 'e')}, {_morph('max', 'e', 'd')} SELECT y, x, bit FROM d")
def morph_open(spark, sf_dir):
    return stencils.opened(mask(spark, sf_dir)).drop("raster_id")


@query(f"WITH {PX}, {MASK}, {_morph('max', 'mask', 'e')}, {_morph('min', 'e', 'd')} SELECT y, x, bit FROM d")
def morph_close(spark, sf_dir):
    return stencils.closed(mask(spark, sf_dir)).drop("raster_id")


@query(f"""WITH {PX}, {LABELS}, o AS (SELECT i - 1 AS d FROM range(3) t(i)),
n AS (SELECT p.y, p.x, p.label AS own, q.label, count(*) AS c FROM labels_ p, o a, o b, labels_ q WHERE q.y = p.y + a.d AND q.x = p.x + b.d GROUP BY ALL)
SELECT y, x, label FROM n QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY c DESC, (label = own) DESC, label) = 1""")
def majority(spark, sf_dir):
    return stencils.majority(labels(spark, sf_dir)).drop("raster_id")


@query(f"""WITH {PX}, o AS (SELECT i - 1 AS d FROM range(3) t(i)),
n AS (SELECT p.y, p.x, list_sort(list(q.v)) AS l FROM px p, o a, o b, px q WHERE q.y = p.y + a.d AND q.x = p.x + b.d GROUP BY ALL)
SELECT y, x, l[len(l) // 2 + 1] AS v FROM n""")
def median_blur(spark, sf_dir):
    return stencils.median(emb(spark, sf_dir)).drop("raster_id")


@query(f"""WITH {PX}, {MASK}, f AS (SELECT y, x FROM mask WHERE bit = 1), s AS (SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) t(dy, dx))
SELECT f.y, f.x, count(*) AS n FROM f, s, f g WHERE g.y = f.y + s.dy AND g.x = f.x + s.dx GROUP BY ALL""")
def neighbor_equi(spark, sf_dir):
    ones = mask(spark, sf_dir).filter("bit = 1").select("y", "x")
    steps = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    moved = ones.select(F.col("y").alias("oy"), F.col("x").alias("ox"), F.explode(steps).alias("s"))
    moved = moved.select("oy", "ox", (F.col("oy") + F.col("s.dy")).alias("y"), (F.col("ox") + F.col("s.dx")).alias("x"))
    return moved.join(ones, ["y", "x"]).groupBy("oy", "ox").agg(F.count("*").alias("n")).select(F.col("oy").alias("y"), F.col("ox").alias("x"), "n")


@query(f"WITH {PX}, {MASK}, f AS (SELECT y, x FROM mask WHERE bit = 1) SELECT y, x FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.y = f.y AND g.x = f.x + 1)")
def neighbor_anti(spark, sf_dir):
    ones = mask(spark, sf_dir).filter("bit = 1").select("y", "x")
    return ones.join(ones.select("y", (F.col("x") - 1).alias("x")), ["y", "x"], "left_anti")


@query(f"WITH {PX}, {MASK}, f AS (SELECT y, x FROM mask WHERE bit = 1) SELECT y, x FROM f WHERE EXISTS (SELECT 1 FROM f g WHERE g.y = f.y + 1 AND g.x = f.x)")
def neighbor_semi(spark, sf_dir):
    ones = mask(spark, sf_dir).filter("bit = 1").select("y", "x")
    return ones.join(ones.select((F.col("y") - 1).alias("y"), "x"), ["y", "x"], "left_semi")


# Components, boundaries, polygons

_STEPS4, _STEPS8 = "(0, 1), (1, 0), (0, -1), (-1, 0)", "(0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)"


def _components_sql(steps: str) -> str:
    return f"""{PX}, {MASK}, f AS MATERIALIZED (SELECT y, x, y * 4294967296::BIGINT + x AS id FROM mask WHERE bit = 1),
g AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM f a, (VALUES {steps}) s(dy, dx), f b WHERE b.y = a.y + s.dy AND b.x = a.x + s.dx),
w AS (SELECT id AS root, id AS node FROM f UNION SELECT w.root, g.b FROM w JOIN g ON g.a = w.node WHERE g.b > w.root),
k AS (SELECT node, min(root) AS component FROM w GROUP BY node)"""


@query(f"WITH RECURSIVE {_components_sql(_STEPS4)} SELECT y, x, component FROM k JOIN f ON f.id = k.node")
def components_4(spark, sf_dir):
    ones = mask(spark, sf_dir).withColumn("label", F.when(F.col("bit") == 1, 1))
    return regions.label_components(ones, 4, tile=48).select("y", "x", "component")


@query(f"WITH RECURSIVE {_components_sql(_STEPS8)} SELECT y, x, component FROM k JOIN f ON f.id = k.node")
def components_8(spark, sf_dir):
    ones = mask(spark, sf_dir).withColumn("label", F.when(F.col("bit") == 1, 1))
    return regions.label_components(ones, 8, tile=48).select("y", "x", "component")


@query(f"WITH RECURSIVE {_components_sql(_STEPS4)} SELECT component, count(*) AS area FROM k GROUP BY component HAVING count(*) >= 4")
def component_area(spark, sf_dir):
    ones = mask(spark, sf_dir).withColumn("label", F.when(F.col("bit") == 1, 1))
    return regions.component_areas(regions.label_components(ones, 4), 4).select("component", "area")


@query(f"WITH RECURSIVE {_components_sql(_STEPS4)} SELECT component, count(*) AS area, count(*)::DOUBLE AS ring_area FROM k GROUP BY component HAVING count(*) >= 4")
def polygonize(spark, sf_dir):
    """The signed areas of a component's rings, holes being negative, sum to its pixels."""
    ones = mask(spark, sf_dir).withColumn("label", F.when(F.col("bit") == 1, 1))
    found = regions.polygonize(regions.label_components(ones, 4), 4)
    total = F.aggregate(F.transform("rings", G.signed_area), F.lit(0.0), lambda s, a: s + a)
    return found.select("component", "area", total.alias("ring_area"))


EDGES = """e AS (SELECT label, x AS x0, y AS y0, x + 1 AS x1, y AS y1, lag(label) OVER c AS o FROM labels_ WINDOW c AS (PARTITION BY x ORDER BY y)
  UNION ALL SELECT label, x + 1, y, x + 1, y + 1, lead(label) OVER r FROM labels_ WINDOW r AS (PARTITION BY y ORDER BY x)
  UNION ALL SELECT label, x + 1, y + 1, x, y + 1, lead(label) OVER c FROM labels_ WINDOW c AS (PARTITION BY x ORDER BY y)
  UNION ALL SELECT label, x, y + 1, x, y, lag(label) OVER r FROM labels_ WINDOW r AS (PARTITION BY y ORDER BY x)),
edges AS (SELECT label, x0, y0, x1, y1 FROM e WHERE o IS DISTINCT FROM label)"""


@query(f"WITH {PX}, {LABELS}, {EDGES} SELECT label, x0, y0, x1, y1 FROM edges")
def boundary_edges(spark, sf_dir):
    return regions.boundary_edges(labels(spark, sf_dir)).drop("raster_id")


@query(f"WITH {PX}, {LABELS}, {EDGES} SELECT label, x0, y0, x1, y1 FROM edges")
def dissolve_edges(spark, sf_dir):
    return regions.dissolve(labels(spark, sf_dir)).drop("raster_id")


@query(f"""WITH {PX}, {LABELS}, {EDGES}, a AS (SELECT label, count(*) AS area FROM labels_ GROUP BY label),
b AS (SELECT label, count(*) AS perimeter, (sum(x0::BIGINT * y1 - x1::BIGINT * y0) / 2)::BIGINT AS edge_area FROM edges GROUP BY label) SELECT * FROM a JOIN b USING (label)""")
def region_area(spark, sf_dir):
    return regions.region_measures(labels(spark, sf_dir)).drop("raster_id")


# Geometry


@query(f"WITH {EV} SELECT id, k - 1 AS i, 100 + x * 0.5 + y * 0.25 AS px, 200 - x * 0.25 - y * 0.5 AS py FROM ev")
def geotransform(spark, sf_dir):
    moved = paths(spark, sf_dir).select("id", F.posexplode(G.affine(F.col("points"), (100, 0.5, 0.25, 200, -0.25, -0.5))).alias("i", "p"))
    return moved.select("id", F.col("i").cast("long").alias("i"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query(f"WITH {EV} SELECT id, k - 1 AS i, x + 16 AS px, y + 32 AS py FROM ev")
def tile_offset(spark, sf_dir):
    moved = paths(spark, sf_dir).select("id", F.posexplode(G.offset(F.col("points"), 16, 32)).alias("i", "p"))
    return moved.select("id", F.col("i").cast("long").alias("i"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query(f"WITH {EV} SELECT id, k - 1 AS i, round_even(x / 0.5, 0) * 0.5 AS px, round_even(y / 0.5, 0) * 0.5 AS py FROM ev")
def snap_grid(spark, sf_dir):
    moved = paths(spark, sf_dir).select("id", F.posexplode(G.snap(F.col("points"), 0.5)).alias("i", "p"))
    return moved.select("id", F.col("i").cast("long").alias("i"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query(f"WITH {BOX} SELECT id, w * h AS area, 2 * (w + h) AS length, round(x + w / 2, 6) AS cx, round(y + h / 2, 6) AS cy FROM box")
def ring_measures(spark, sf_dir):
    r = F.col("ring")
    c = G.centroid(r)
    return boxes(spark, sf_dir).select("id", G.signed_area(r).alias("area"), G.ring_length(r).alias("length"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query(f"""WITH {EV}, s AS (SELECT id, n, sqrt((lead(x) OVER o - x) ** 2 + (lead(y) OVER o - y) ** 2) AS d FROM ev WINDOW o AS (PARTITION BY id ORDER BY k))
SELECT id, max(n)::INT AS n, round(coalesce(sum(d), 0), 3) AS length FROM s GROUP BY id""")
def polyline_length(spark, sf_dir):
    return paths(spark, sf_dir).select("id", F.size("points").alias("n"), F.round(G.line_length(F.col("points")), 3).alias("length"))


@query(f"""WITH {EV}, b AS (SELECT (event_id % 100)::DOUBLE + 0.5 AS px, (event_id % 37)::DOUBLE + 0.5 AS py, event_id FROM events), {BOX}
SELECT event_id, id, (px > x AND px < x + w AND py > y AND py < y + h) AS inside FROM b JOIN box ON id = 1 + event_id % (SELECT max(p_partkey) FROM part)""")
def point_in_polygon(spark, sf_dir):
    most = rasters.table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("most"))
    points = rasters.table(spark, sf_dir, "events").crossJoin(F.broadcast(most)).select("event_id", (F.col("event_id") % F.col("most") + 1).alias("id"), G.point(F.col("event_id") % 100 + 0.5, F.col("event_id") % 37 + 0.5).alias("p"))
    return points.join(boxes(spark, sf_dir), "id").select("event_id", "id", G.inside(F.col("p"), F.col("ring")).alias("inside"))


@query(f"""WITH {EV}, s AS (SELECT id, k, x AS ax, y AS ay, lead(x) OVER o AS bx, lead(y) OVER o AS by_, lead(x, 2) OVER o AS cx, lead(y, 2) OVER o AS cy, lead(x, 3) OVER o AS dx, lead(y, 3) OVER o AS dy FROM ev WINDOW o AS (PARTITION BY id ORDER BY k)),
t AS (SELECT *, (bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) AS d FROM s WHERE dx IS NOT NULL),
u AS (SELECT id, k, d, CASE WHEN d <> 0 THEN ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / d END AS t, CASE WHEN d <> 0 THEN ((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / d END AS u FROM t)
SELECT id, k - 1 AS i, coalesce(t > 0 AND t < 1 AND u > 0 AND u < 1, false) AS crosses FROM u""")
def segment_intersect(spark, sf_dir):
    p = F.col("points")
    four = F.transform(F.sequence(F.lit(0), F.size(p) - 4), lambda i: F.struct(*(F.get(p, i + j).alias(n) for j, n in enumerate("abcd"))))
    each = paths(spark, sf_dir).filter(F.size("points") >= 4).select("id", F.posexplode(four).alias("i", "q"))
    xy = [F.col(f"q.{n}.{c}") for n in "abcd" for c in "xy"]
    return each.select("id", F.col("i").cast("long").alias("i"), G.segments_cross(*xy).alias("crosses"))


@query(f"""WITH RECURSIVE {EV}, p AS MATERIALIZED (SELECT id, k, n, x, y FROM ev),
seg AS (SELECT DISTINCT id, 1::BIGINT AS i, n AS j FROM p WHERE n > 1
  UNION ALL SELECT id, CASE s WHEN 0 THEN i ELSE k END, CASE s WHEN 0 THEN k ELSE j END FROM (
    SELECT seg.id, seg.i, seg.j, arg_max(p.k, (abs((b.x - a.x) * (a.y - p.y) - (a.x - p.x) * (b.y - a.y)) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), -p.k)) AS k,
      max(abs((b.x - a.x) * (a.y - p.y) - (a.x - p.x) * (b.y - a.y)) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) AS d
    FROM seg JOIN p a ON a.id = seg.id AND a.k = seg.i JOIN p b ON b.id = seg.id AND b.k = seg.j JOIN p ON p.id = seg.id AND p.k > seg.i AND p.k < seg.j GROUP BY seg.id, seg.i, seg.j
  ), (VALUES (0), (1)) t(s) WHERE d > 5),
kept AS (SELECT DISTINCT id, k FROM (SELECT id, i AS k FROM seg UNION ALL SELECT id, j FROM seg UNION ALL SELECT id, k FROM p WHERE n = 1)),
s AS (SELECT p.*, lag(p.x) OVER w AS px, lag(p.y) OVER w AS py FROM kept JOIN p USING (id, k) WINDOW w AS (PARTITION BY p.id ORDER BY p.k))
SELECT id, max(n)::INT AS n, count(*)::INT AS kept, round(coalesce(sum(sqrt((x - px) ** 2 + (y - py) ** 2)), 0), 3) AS length FROM s GROUP BY id""")
def rdp(spark, sf_dir):
    own = paths(spark, sf_dir).select("id", F.size("points").alias("n"), lines.simplified(F.col("points"), 5.0).alias("s"))
    return own.select("id", "n", F.size("s").alias("kept"), F.round(G.line_length(F.col("s")), 3).alias("length"))


@query(f"WITH {BOX} SELECT id, 0::INT AS issues, 5::INT AS vertices, w * h AS area FROM box")
def repair_rings(spark, sf_dir):
    fixed = boxes(spark, sf_dir).select("id", F.get(G.repair_rings(F.array(F.reverse("ring"))), F.lit(0)).alias("r"))
    return fixed.select("id", F.size(G.ring_issues(F.col("r"))).alias("issues"), F.size("r").alias("vertices"), G.signed_area(F.col("r")).alias("area"))


@query(f"""WITH {EV}, g AS (SELECT id, max(n) AS n, sqrt((arg_max(x, k) - arg_min(x, k)) ** 2 + (arg_max(y, k) - arg_min(y, k)) ** 2) AS gap FROM ev GROUP BY id)
SELECT id, (n >= 3 AND gap <= 200) AS closable FROM g""")
def close_contours(spark, sf_dir):
    return paths(spark, sf_dir).select("id", G.close_contour(F.col("points"), 200.0).isNotNull().alias("closable"))


def short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-point line for each supplier, on a lattice, so that ends meet."""
    k = F.col("s_suppkey")
    ends = F.array(G.point(k % 20, k % 7), G.point((k + 1) % 20, (k * 3) % 7))
    return rasters.table(spark, sf_dir, "supplier").select(k.alias("id"), ends.alias("points"))


@query("""WITH e AS (SELECT s_suppkey AS id, 0 AS end_, s_suppkey % 20 AS x, s_suppkey % 7 AS y FROM supplier
  UNION ALL SELECT s_suppkey, 1, (s_suppkey + 1) % 20, (s_suppkey * 3) % 7 FROM supplier)
SELECT a.id AS id_a, a.end_::INT AS end_a, b.id AS id_b, b.end_::INT AS end_b FROM e a JOIN e b ON a.x = b.x AND a.y = b.y AND (a.id, a.end_) < (b.id, b.end_)""")
def endpoint_links(spark, sf_dir):
    return lines.endpoint_links(short_lines(spark, sf_dir), 0.5)


@query("""WITH e AS (SELECT s_suppkey AS id, s_suppkey % 20 AS x, s_suppkey % 7 AS y FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey + 1) % 20, (s_suppkey * 3) % 7 FROM supplier)
SELECT count(*) AS ends, count(DISTINCT id)::INT AS lines FROM e GROUP BY x, y HAVING count(DISTINCT id) >= 2""")
def junctions(spark, sf_dir):
    return lines.junctions(short_lines(spark, sf_dir), 0.5).select("ends", "lines")


@query()
def stitch_lines(spark, sf_dir):
    done = lines.stitch(short_lines(spark, sf_dir), 0.5)
    return done.select("id", F.size("points").alias("n"), F.round(G.line_length(F.col("points")), 3).alias("length"))


@query()
def skeleton_paths(spark, sf_dir):
    found = lines.centre_lines(mask(spark, sf_dir))
    return found.select("component", "line", F.size("points").alias("n"), F.round(G.line_length(F.col("points")), 3).alias("length"))


# Evaluation


@query(f"""WITH {LB}, {RULES}, r AS (SELECT DISTINCT run_id, profile FROM n), j AS (SELECT r.run_id, r.profile, rules.*, m.actual FROM r CROSS JOIN rules LEFT JOIN m ON m.run_id = r.run_id AND m.profile IS NOT DISTINCT FROM r.profile AND m.metric = rules.metric)
SELECT run_id, profile, metric, direction, threshold::DOUBLE AS threshold, actual, round_even(actual - threshold::DOUBLE, 6) AS delta,
  CASE WHEN actual >= threshold THEN 'pass' ELSE 'fail' END AS status, CASE WHEN actual IS NULL THEN 'missing' WHEN actual < threshold THEN 'threshold' END AS reason FROM j""")
def eval_checks(spark, sf_dir):
    return evaluation.checks(run_metrics(spark, sf_dir), evaluation.rules_frame(spark, BASELINE)).drop("dataset_id")


@query(f"""WITH {LB}, {RULES}, r AS (SELECT DISTINCT run_id, profile FROM n), j AS (SELECT r.run_id, r.profile, rules.*, m.actual FROM r CROSS JOIN rules LEFT JOIN m ON m.run_id = r.run_id AND m.profile IS NOT DISTINCT FROM r.profile AND m.metric = rules.metric)
SELECT run_id, profile, count(*) AS n_rules, count(*) FILTER (actual IS NULL OR actual < threshold) AS n_failed, CASE WHEN count(*) FILTER (actual IS NULL OR actual < threshold) > 0 THEN 'fail' ELSE 'pass' END AS status FROM j GROUP BY ALL""")
def eval_run_status(spark, sf_dir):
    return evaluation.run_status(evaluation.checks(run_metrics(spark, sf_dir), evaluation.rules_frame(spark, BASELINE)))


@query(f"""WITH {LB}, {RULES}, r AS (SELECT DISTINCT run_id, profile FROM n), j AS (SELECT r.run_id, r.profile, rules.metric, rules.threshold, m.actual FROM r CROSS JOIN rules LEFT JOIN m ON m.run_id = r.run_id AND m.profile IS NOT DISTINCT FROM r.profile AND m.metric = rules.metric)
SELECT run_id, profile, metric, actual FROM j WHERE actual IS NULL OR actual < threshold""")
def eval_regressions(spark, sf_dir):
    bad = evaluation.regressions(evaluation.checks(run_metrics(spark, sf_dir), evaluation.rules_frame(spark, BASELINE)))
    return bad.select("run_id", "profile", "metric", "actual")


MEANS = "means AS (SELECT profile, metric, round_even(avg(actual), 6) AS mean, count(*) AS n FROM m WHERE profile IS NOT NULL GROUP BY ALL)"
SCORES = "scores AS (SELECT profile, round_even(sum(mean * CASE metric WHEN 'mean_iou' THEN 0.35::DOUBLE WHEN 'precision' THEN 0.2::DOUBLE WHEN 'recall' THEN 0.1::DOUBLE ELSE 0 END), 6) AS score FROM means GROUP BY profile)"


@query(f"WITH {LB}, {MEANS} SELECT * FROM means")
def profile_means(spark, sf_dir):
    return evaluation.profile_means(run_metrics(spark, sf_dir))


@query(f"WITH {LB}, {MEANS}, {SCORES} SELECT profile, score, row_number() OVER (ORDER BY score DESC, profile)::INT AS rank FROM scores")
def profile_rank(spark, sf_dir):
    return evaluation.profile_scores(run_metrics(spark, sf_dir))


@query(f"WITH {LB}, {MEANS}, {SCORES} SELECT profile, score FROM scores ORDER BY score DESC, profile LIMIT 1")
def profile_winner(spark, sf_dir):
    return evaluation.winner(run_metrics(spark, sf_dir))


# State


@query(f"""WITH {HI} SELECT event_id, source_path, status, row_number() OVER (ORDER BY timestamp DESC, event_id, feature_count, profile_id, source_path, status)::INT AS position FROM h QUALIFY position <= 50""")
def history_newest(spark, sf_dir):
    return state.newest(history(spark, sf_dir), state.HISTORY).select("event_id", "source_path", "status", "position")


@query(f"WITH {HI} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled FROM h")
def history_stats(spark, sf_dir):
    return state.history_statistics(history(spark, sf_dir))


@query(f"WITH {HI} SELECT source_path, max(timestamp) AS timestamp, count(*) AS n FROM h WHERE status = 'success' GROUP BY source_path")
def history_latest(spark, sf_dir):
    return state.latest_success(history(spark, sf_dir))


@query(f"""WITH {HI} SELECT source_path, event_id, row_number() OVER (PARTITION BY source_path ORDER BY timestamp DESC, event_id, feature_count, profile_id, source_path, status)::INT AS position FROM h QUALIFY position <= 5""")
def recent_top5(spark, sf_dir):
    return state.newest(history(spark, sf_dir), state.RECENT, within=["source_path"]).select("source_path", "event_id", "position")


@query(f"""WITH {HI} SELECT event_id, substr(sha256('["' || source_path || '",' || coalesce('"' || profile_id || '"', 'null') || ',"' || status || '"]'), 1, 16) AS cache_key FROM h""")
def cache_key(spark, sf_dir):
    return history(spark, sf_dir).select("event_id", state.cache_key(F.col("source_path"), F.col("profile_id"), F.col("status")).alias("cache_key"))


@query(f"WITH {HI} SELECT coalesce(profile_id, 'unknown') AS profile_id, count(*) AS entries, sum(feature_count)::BIGINT AS features FROM h GROUP BY 1 UNION ALL SELECT NULL, count(*), sum(feature_count)::BIGINT FROM h")
def cache_stats(spark, sf_dir):
    return state.cache_statistics(history(spark, sf_dir))


@query(f"""WITH {HI}, t AS (SELECT count(*) AS total, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, sum(feature_count)::BIGINT AS features FROM h)
SELECT *, succeeded || '/' || total || ' processed, ' || failed || ' failed, ' || cancelled || ' cancelled' AS summary FROM t""")
def batch_rollup(spark, sf_dir):
    return state.batch_summary(history(spark, sf_dir))


@query("SELECT s_suppkey AS id, [(s_suppkey % 5)::INT, (s_suppkey % 7)::INT, 0] AS parts FROM supplier")
def version_compare(spark, sf_dir):
    v = F.concat(F.lit("v"), F.col("s_suppkey") % 5, F.lit("."), F.col("s_suppkey") % 7, F.lit("-rc1"))
    return rasters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), state.version_parts(v).alias("parts"))


@query("""WITH s AS (SELECT event_id, event_id * 37 % 9000 AS s FROM events)
SELECT event_id, CASE WHEN s < 3600 THEN (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS clock FROM s""")
def eta_clock(spark, sf_dir):
    return rasters.table(spark, sf_dir, "events").select("event_id", state.clock(F.col("event_id") * 37 % 9000).alias("clock"))


@query("SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) IN ('tif', 'tiff', 'png', 'jpg', 'jpeg', 'bmp', 'gif', 'webp') AS raster FROM pages")
def raster_paths(spark, sf_dir):
    return rasters.table(spark, sf_dir, "pages").select("page_id", rasters.is_raster_path(F.col("url")).alias("raster"))


# Plans, sinks and streams


@query("""WITH s AS (SELECT max(vec_id) + 1 AS h, 64 AS w FROM embeddings), t AS (SELECT unnest(range(0, (ceil(h / 48.0) * 2)::BIGINT)) AS i, h, w FROM s)
SELECT i AS tile, (i % 2) * 48 AS x, (i // 2) * 48 AS y, least(48, w - (i % 2) * 48) AS width, least(48, h - (i // 2) * 48) AS height FROM t""")
def tile_plan(spark, sf_dir):
    size = rasters.table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("y")).first()
    return spark.createDataFrame(profiles.tile_plan(64, size["y"] + 1, 48), "tile long, x long, y long, width long, height long")


def _features(spark, sf_dir, mode: str, **parameters) -> DataFrame:
    return vectorize.run(emb(spark, sf_dir), mode, parameters).features


@query()
def vectorize_regional(spark, sf_dir):
    done = _features(spark, sf_dir, "regional")
    return done.select("feature_index", "geometry_type", F.element_at("properties", "class_id").alias("class_id"), F.element_at("properties", "pixel_area").alias("pixel_area"), sinks.coordinates_json(F.col("geometry_type"), F.col("parts")).alias("coordinates"))


@query()
def vectorize_edge(spark, sf_dir):
    done = _features(spark, sf_dir, "edge")
    return done.select("feature_index", "geometry_type", F.element_at("properties", "path_length_px").alias("length"), sinks.coordinates_json(F.col("geometry_type"), F.col("parts")).alias("coordinates"))


@query()
def vectorize_linear(spark, sf_dir):
    done = _features(spark, sf_dir, "linear")
    return done.select("feature_index", "geometry_type", F.element_at("properties", "path_length_px").alias("length"), sinks.coordinates_json(F.col("geometry_type"), F.col("parts")).alias("coordinates"))


@query(f"""WITH {BOX}, c AS (SELECT id, x, y, x + w AS x1, y + h AS y1 FROM box)
SELECT id, '[[[' || x || ',' || y || '],[' || x1 || ',' || y || '],[' || x1 || ',' || y1 || '],[' || x || ',' || y1 || '],[' || x || ',' || y || ']]]' AS coordinates FROM c""")
def geojson_coordinates(spark, sf_dir):
    rings = boxes(spark, sf_dir).select("id", F.array(F.array(G.close_ring(F.col("ring")))).alias("parts"))
    return rings.select("id", sinks.coordinates_json(F.lit("Polygon"), F.col("parts")).alias("coordinates"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def windowed_runs(spark, sf_dir):
    """A stream over the file of events, run until all that is there is read."""
    own = rasters.table(spark, sf_dir, "events").schema
    runs = spark.readStream.schema(own).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    done = streams.run_available(streams.windowed_counts(runs), "windowed-runs", "complete")
    return done.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {PX} SELECT v, count(*) AS n FROM px GROUP BY v")
def streamed_tiles(spark, sf_dir):
    """Tiles that arrive as files, each counted by itself, and the counts summed."""
    folder = streams.landing(rasters.to_tiles(emb(spark, sf_dir), 48), "tiles")
    tiles = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 2).parquet(folder)
    done = streams.run_available(streams.tile_histograms(tiles), "tile-histograms", "append")
    return done.groupBy("v").agg(F.sum("n").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_area(spark, sf_dir)


from . import catalog_more  # noqa: E402, F401  its queries register themselves
