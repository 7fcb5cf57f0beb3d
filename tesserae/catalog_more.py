"""More of the engine's queries beside their SQL: edges, round kernels, features, rings with faults, names, versions and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import HI, LABELS, MASK, PX, boxes, emb, history, labels, mask, query, short_lines
from .functions import geometry as G
from .functions import pixels, text
from .operators import aggregates, evaluation, features, lines, regions, state, stencils
from .sources import rasters

# Neighbourhoods

_AROUND = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) s(dy, dx)"


def _weights(name: str, source: str, value: str, out: str, axis: str, weights: tuple[int, ...]) -> str:
    """Weighted sums along an axis as a self join on clamped places."""
    other = "x" if axis == "y" else "y"
    rows = ", ".join(f"({i - len(weights) // 2}, {w})" for i, w in enumerate(weights))
    return f"""{name} AS (SELECT a.y, a.x, sum(k.w * b.{value})::BIGINT AS {out} FROM {source} a, (VALUES {rows}) k(d, w), (SELECT max({axis}) AS top FROM {source}) t, {source} b
  WHERE b.{other} = a.{other} AND b.{axis} = greatest(0, least(t.top, a.{axis} + k.d)) GROUP BY a.y, a.x)"""


def _blur(weights: tuple[int, ...]) -> str:
    total = sum(weights) ** 2
    return f"{_weights('bx', 'px', 'v', 's', 'x', weights)}, {_weights('by_', 'bx', 's', 's', 'y', weights)}, bl AS (SELECT y, x, round_even(s / {total}, 0)::INT AS v FROM by_)"


@query(f"WITH {PX}, {_blur(stencils.KERNELS[5])} SELECT y, x, v FROM bl")
def gaussian_blur_5(spark, sf_dir):
    return stencils.gaussian_blur(emb(spark, sf_dir, dealt=True), 5).drop("raster_id")


_CANNY = f"""{PX}, {_blur(stencils.KERNELS[3])}, {_weights('sx', 'bl', 'v', 's', 'x', (1, 2, 1))}, {_weights('dx', 'bl', 'v', 'd', 'x', (-1, 0, 1))},
{_weights('gx', 'dx', 'd', 'g', 'y', (1, 2, 1))}, {_weights('gy', 'sx', 's', 'g', 'y', (-1, 0, 1))},
gr AS MATERIALIZED (SELECT y, x, gx.g AS gx, gy.g AS gy, abs(gx.g) + abs(gy.g) AS m FROM gx JOIN gy USING (y, x)),
side AS (SELECT *, CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN 0 WHEN abs(gy) * 32768 > abs(gx) * (13573 + 65536) THEN 1 ELSE 2 END AS way, CASE WHEN (gx < 0) = (gy < 0) THEN 1 ELSE -1 END AS sg FROM gr),
nb AS (SELECT a.*, coalesce(b.m, 0) AS before, coalesce(c.m, 0) AS after FROM side a
  LEFT JOIN gr b ON b.y = a.y - (a.way <> 0)::INT AND b.x = a.x - CASE a.way WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE a.sg END
  LEFT JOIN gr c ON c.y = a.y + (a.way <> 0)::INT AND c.x = a.x + CASE a.way WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE a.sg END),
cls AS MATERIALIZED (SELECT y, x, CASE WHEN NOT (m > before AND (m > after OR (way < 2 AND m = after))) THEN 0 WHEN m > 260 THEN 2 WHEN m > 160 THEN 1 ELSE 0 END AS class FROM nb)"""


@query(f"WITH {_CANNY} SELECT y, x, class::INT AS class FROM cls")
def canny_classes(spark, sf_dir):
    return stencils.canny_classes(stencils.gaussian_blur(emb(spark, sf_dir, dealt=True)), 160, 260).drop("raster_id")


@query(f"""WITH RECURSIVE {_CANNY}, e AS (SELECT y, x FROM cls WHERE class = 2 UNION SELECT n.y, n.x FROM e, {_AROUND}, cls n WHERE n.y = e.y + s.dy AND n.x = e.x + s.dx AND n.class > 0)
SELECT y, x, (e.y IS NOT NULL)::INT AS bit FROM cls LEFT JOIN e USING (y, x)""".replace("(e.y IS NOT NULL)::INT AS bit FROM cls LEFT JOIN e USING (y, x)", "coalesce(one, 0)::INT AS bit FROM cls LEFT JOIN (SELECT y, x, 1 AS one FROM e) e USING (y, x)"))
def canny(spark, sf_dir):
    return stencils.canny(emb(spark, sf_dir), 160, 260).drop("raster_id")


_ROUND2 = ", ".join(f"({dy}, {dx})" for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) < 2 or dx == 0)


@query(f"WITH {PX}, {MASK} SELECT a.y, a.x, max(b.bit) AS bit FROM mask a, (VALUES {_ROUND2}) s(dy, dx), mask b WHERE b.y = a.y + s.dy AND b.x = a.x + s.dx GROUP BY a.y, a.x")
def dilate_round(spark, sf_dir):
    return stencils.dilate_round(mask(spark, sf_dir), 2).drop("raster_id")


_CROSS = "(VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) s(dy, dx)"


@query(f"""WITH {PX}, {MASK}, e AS (SELECT a.y, a.x, min(b.bit) AS bit FROM mask a, {_CROSS}, mask b WHERE b.y = a.y + s.dy AND b.x = a.x + s.dx GROUP BY a.y, a.x)
SELECT a.y, a.x, max(b.bit) AS bit FROM e a, {_CROSS}, e b WHERE b.y = a.y + s.dy AND b.x = a.x + s.dx GROUP BY a.y, a.x""")
def open_round(spark, sf_dir):
    return stencils.opened_round(mask(spark, sf_dir), 1).drop("raster_id")


@query(f"WITH {PX} SELECT y, x, (v > 150)::INT AS high, (v <= 150)::INT AS low FROM px")
def threshold_strict(spark, sf_dir):
    v = F.col("v")
    return emb(spark, sf_dir).select("y", "x", pixels.threshold_strict(v, 150).alias("high"), pixels.threshold_strict(v, 150, "low").alias("low"))


@query("SELECT DISTINCT l_quantity::INT AS a, (l_linenumber * 9)::INT AS b, l_quantity::INT AS v FROM lineitem")
def gray_two_bands(spark, sf_dir):
    a, b = F.col("l_quantity").cast("int"), (F.col("l_linenumber") * 9).cast("int")
    return rasters.table(spark, sf_dir, "lineitem").select(a.alias("a"), b.alias("b"), pixels.first_band(a, b).alias("v")).distinct()


# Rings with faults

_BOX = "box AS (SELECT p_partkey AS id, (p_partkey % 100)::DOUBLE AS x, (p_partkey % 37)::DOUBLE AS y, (p_size + 1)::DOUBLE AS w, (p_size % 7 + 1)::DOUBLE AS h FROM part)"


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ring``: boxes that are sound, crossed like a bow, left open, or cut to three corners, by their ids."""
    r = lambda i: F.get("ring", F.lit(i))
    k = F.col("id") % 4
    ring = (
        F.when(k == 0, F.array(r(0), r(1), r(2), r(3), r(0)))
        .when(k == 1, F.array(r(0), r(2), r(1), r(3), r(0)))
        .when(k == 2, F.array(r(0), r(1), r(2), r(3)))
        .otherwise(F.array(r(0), r(1), r(2)))
    )
    return boxes(spark, sf_dir).select("id", ring.alias("ring"))


@query(f"""WITH {_BOX} SELECT id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'self-intersection' WHEN 2 THEN 'not closed' ELSE 'fewer than 4 points' END AS issues FROM box""")
def ring_faults(spark, sf_dir):
    return faulty(spark, sf_dir).select("id", F.array_join(G.ring_issues(F.col("ring")), ",").alias("issues"))


@query(f"WITH {_BOX} SELECT id, w * h AS area FROM box WHERE id % 4 = 0")
def sound_polygons(spark, sf_dir):
    rings = faulty(spark, sf_dir).select("id", F.array("ring").alias("rings"))
    return rings.filter(features.sound(F.col("rings"))).select("id", G.area(F.get("rings", F.lit(0))).alias("area"))


@query(f"WITH {_BOX} SELECT id, CASE WHEN id % 4 = 3 THEN 0 ELSE 1 END::INT AS rings, CASE WHEN id % 4 IN (0, 2) THEN w * h WHEN id % 4 = 3 THEN NULL ELSE 0 END AS area FROM box")
def repair_faults(spark, sf_dir):
    """Open rings are closed, triangles' remains dropped, bows stay (their signed area cancels)."""
    fixed = faulty(spark, sf_dir).withColumn("ring", F.when(F.col("id") % 4 == 3, F.slice("ring", 1, 2)).otherwise(F.col("ring")))
    fixed = fixed.select("id", G.repair_rings(F.array("ring")).alias("r"))
    return fixed.select("id", F.size("r").alias("rings"), F.abs(G.signed_area(F.get("r", F.lit(0)))).alias("area"))


def dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ring``: closed boxes with the first corner twice and a vertex in the middle of two edges."""
    r = lambda i: F.get("ring", F.lit(i))
    mid = lambda a, b: F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    return boxes(spark, sf_dir).select("id", F.array(r(0), r(0), mid(r(0), r(1)), r(1), r(2), r(3), mid(r(3), r(0)), r(0)).alias("ring"))


@query(f"WITH {_BOX} SELECT id, 6::INT AS opened, 7::INT AS closed, 4::INT AS corners, x || ',' || y || ' ' || (x + w) || ',' || y || ' ' || (x + w) || ',' || (y + h) || ' ' || x || ',' || (y + h) AS ring FROM box")
def ring_cleaning(spark, sf_dir):
    ring, own = F.col("ring"), F.col("corners")
    told = F.array_join(F.transform(own, lambda p: F.concat_ws(",", p["x"], p["y"])), " ")
    rows = dotted(spark, sf_dir).select("id", F.size(G.open_ring(ring)).alias("opened"), F.size(G.close_ring(ring)).alias("closed"), G.drop_collinear_ring(ring).alias("corners"))
    return rows.select("id", "opened", "closed", F.size(own).alias("corners"), told.alias("ring"))


@query(f"""WITH {_BOX} SELECT id, CASE WHEN id % 2 = 0 THEN x + w / 2 ELSE x + 15 END AS px, CASE WHEN id % 2 = 0 THEN y + h / 2 ELSE y END AS py FROM box""")
def ring_probe(spark, sf_dir):
    """Boxes, and U shapes whose centroid and middle lie outside."""
    a = F.get("ring", F.lit(0))
    u = F.array(*(G.point(a["x"] + i, a["y"] + j) for i, j in ((0, 0), (30, 0), (30, 30), (28, 30), (28, 1), (2, 1), (2, 30), (0, 30))))
    p = G.probe(F.when(F.col("id") % 2 == 0, F.col("ring")).otherwise(u))
    return boxes(spark, sf_dir).select("id", p["x"].alias("px"), p["y"].alias("py"))


@query(f"WITH {_BOX} SELECT round_even(count(*) FILTER (id % 4 = 0) / count(*), 6) AS geometry_valid_ratio, count(*) FILTER (id % 4 <> 0) AS invalid_geometry_count FROM box")
def geometry_validity(spark, sf_dir):
    return features.validity(faulty(spark, sf_dir).select(F.array("ring").alias("rings")))


_RIM = """{0}_rim AS (SELECT a.y, a.x FROM {0} a WHERE a.bit = 1 AND (a.y, a.x) IN (SELECT (b.y + s.dy, b.x + s.dx) FROM {0} b, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(dy, dx) WHERE b.bit = 0)),
{0}_near AS (SELECT DISTINCT r.y + s.dy AS y, r.x + s.dx AS x FROM {0}_rim r, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) s(dy, dx))"""


@query(f"""WITH {PX}, {MASK}, t AS (SELECT y, x, (v >= 140)::INT AS bit FROM px), {_RIM.format('mask')}, {_RIM.format('t')},
c AS (SELECT (SELECT count(*) FROM mask_rim SEMI JOIN t_near USING (y, x)) / (SELECT count(*) FROM mask_rim) AS p, (SELECT count(*) FROM t_rim SEMI JOIN mask_near USING (y, x)) / (SELECT count(*) FROM t_rim) AS r)
SELECT round_even(2 * p * r / (p + r), 6) AS boundary_f1 FROM c""")
def boundary_f1(spark, sf_dir):
    return aggregates.boundary_f1(mask(spark, sf_dir), mask(spark, sf_dir, 140)).drop("raster_id")


# Features and regions as sets


def mixed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as polygons and short lines as lines, numbered by their ids, lines first."""
    line = short_lines(spark, sf_dir).select((F.col("id") * 2).alias("feature_index"), F.lit("LineString").alias("geometry_type"), F.array(F.array("points")).alias("parts"))
    box = boxes(spark, sf_dir).select((F.col("id") * 2 + 1).alias("feature_index"), F.lit("Polygon").alias("geometry_type"), F.array(F.array(G.close_ring(F.col("ring")))).alias("parts"))
    return line.unionByName(box)


_FEATURES = "f AS (SELECT s_suppkey * 2 AS i, 'LineString' AS t FROM supplier UNION ALL SELECT p_partkey * 2 + 1, 'Polygon' FROM part)"


@query(f"WITH {_FEATURES}, g AS (SELECT t AS geometry_type, count(*) AS n, min(i) AS i FROM f GROUP BY t) SELECT geometry_type, n, (row_number() OVER (ORDER BY i, geometry_type))::INT AS position FROM g")
def geometry_types(spark, sf_dir):
    return features.type_counts(mixed_features(spark, sf_dir))


@query("SELECT 'Polygon' AS geometry_type, true AS mixed")
def layer_type(spark, sf_dir):
    return features.output_type(mixed_features(spark, sf_dir))


@query(f"WITH {_FEATURES} SELECT i AS feature_index FROM f WHERE t = 'LineString'")
def features_of_type(spark, sf_dir):
    return features.of_types(mixed_features(spark, sf_dir), "LineString").select("feature_index")


@query("""WITH f AS (SELECT 0 AS s, s_suppkey AS i, s_suppkey AS id FROM supplier UNION ALL SELECT 1, p_partkey, p_partkey FROM part)
SELECT row_number() OVER (ORDER BY s, i) - 1 AS feature_index, CASE s WHEN 0 THEN 'LineString' ELSE 'Polygon' END AS geometry_type, id FROM f""")
def concat_features(spark, sf_dir):
    line = short_lines(spark, sf_dir).select(F.col("id").alias("feature_index"), F.lit("LineString").alias("geometry_type"), "id", "points")
    box = boxes(spark, sf_dir).select(F.col("id").alias("feature_index"), F.lit("Polygon").alias("geometry_type"), "id")
    return features.concat(line, box).select("feature_index", "geometry_type", "id")


@query(f"""WITH {_BOX}, p AS (SELECT s_suppkey AS point_id, s_suppkey % 120 + 0.5 AS x, s_suppkey * 7 % 45 + 0.5 AS y FROM supplier)
SELECT point_id, id FROM p JOIN box b ON p.x > b.x AND p.x < b.x + b.w AND p.y > b.y AND p.y < b.y + b.h""")
def containment_join(spark, sf_dir):
    k = F.col("s_suppkey")
    points = rasters.table(spark, sf_dir, "supplier").select(k.alias("point_id"), (k % 120 + 0.5).alias("x"), (k * 7 % 45 + 0.5).alias("y"))
    return features.contained(points, boxes(spark, sf_dir))


@query(f"""WITH {PX}, {LABELS}, e AS (SELECT a.label AS l, b.label AS r FROM labels_ a JOIN labels_ b ON (b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1))
SELECT least(l, r) AS a, greatest(l, r) AS b, count(*) AS edges FROM e WHERE l <> r GROUP BY ALL""".replace("FROM labels_ a JOIN labels_ b ON (b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1)", "FROM labels_ a JOIN labels_ b ON b.y = a.y AND b.x = a.x + 1 UNION ALL SELECT a.label, b.label FROM labels_ a JOIN labels_ b ON b.x = a.x AND b.y = a.y + 1"))
def adjacent_regions(spark, sf_dir):
    return features.adjacent(labels(spark, sf_dir)).drop("raster_id")


@query(f"WITH {PX} SELECT (y // 32)::INT AS ty, (x // 32)::INT AS tx, 'EPSG:4326' AS crs, count(*) AS n FROM px GROUP BY ALL")
def tiles_with_layer(spark, sf_dir):
    pixels_ = emb(spark, sf_dir)
    layer = pixels_.select("raster_id").distinct().withColumn("crs", F.lit("EPSG:4326"))
    return features.with_layer(aggregates.tile_statistics(pixels_, 32), layer).select("ty", "tx", "crs", "n")


@query(f"""WITH {PX}, {LABELS}, u AS (SELECT label, count(*) AS area FROM labels_ GROUP BY label) SELECT label::VARCHAR AS class_id, area::VARCHAR AS pixel_area, true AS closed, area::DOUBLE AS ring_area FROM u""")
def dissolved_classes(spark, sf_dir):
    """Component polygons of each class as one feature, whose signed ring areas sum to its pixels."""
    found = regions.polygonize(regions.label_components(labels(spark, sf_dir), 4))
    ring = F.create_map(F.lit("class_id"), F.col("label").cast("string"), F.lit("pixel_area"), F.col("area").cast("string"))
    polygons = found.select("raster_id", F.col("component").alias("feature_index"), F.lit("Polygon").alias("geometry_type"), F.array("rings").alias("parts"), ring.alias("properties"))
    done = features.dissolve(polygons)
    all_rings = F.flatten("parts")
    area = F.aggregate(all_rings, F.lit(0.0), lambda s, r: s + G.signed_area(r))
    return done.select(
        F.element_at("properties", "class_id").alias("class_id"), F.element_at("properties", "pixel_area").alias("pixel_area"),
        F.forall(all_rings, G.is_closed).alias("closed"), area.alias("ring_area"),
    )


@query("""WITH e AS (SELECT s_suppkey AS id, s_suppkey % 20 AS x, s_suppkey % 7 AS y FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey + 1) % 20, (s_suppkey * 3) % 7 FROM supplier),
j AS (SELECT x, y FROM e GROUP BY x, y HAVING count(DISTINCT id) >= 2), c AS (SELECT id, count(DISTINCT (x, y)) AS n FROM e JOIN j USING (x, y) GROUP BY id)
SELECT s_suppkey AS id, coalesce(n, 0) AS junction_connections FROM supplier LEFT JOIN c ON id = s_suppkey""")
def junction_annotation(spark, sf_dir):
    return lines.annotate_junctions(short_lines(spark, sf_dir), 0.5).select("id", "junction_connections")


# Names, versions, numbers, times


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    core = F.concat_ws(".", k % 5, k % 3, k % 2)
    v = F.when(k % 6 == 0, F.concat(F.lit("v"), core)).when(k % 6 == 1, F.concat(core, F.lit("-rc.1+b7"))).when(k % 6 == 2, F.concat_ws(".", k % 5, k % 3)).when(k % 6 == 3, F.concat(F.lit("0"), core)).when(k % 6 == 4, F.lit("latest")).otherwise(core)
    return rasters.table(spark, sf_dir, "supplier").select(k.alias("id"), v.alias("version"))


_VERSIONS = """vs AS (SELECT s_suppkey AS id, (s_suppkey % 5) || '.' || (s_suppkey % 3) || '.' || (s_suppkey % 2) AS core, s_suppkey % 6 AS k, s_suppkey % 5 AS a, s_suppkey % 3 AS b, s_suppkey % 2 AS c FROM supplier),
v AS (SELECT *, CASE k WHEN 0 THEN 'v' || core WHEN 1 THEN core || '-rc.1+b7' WHEN 2 THEN a || '.' || b WHEN 3 THEN '0' || core WHEN 4 THEN 'latest' ELSE core END AS version FROM vs)"""


@query(f"WITH {_VERSIONS} SELECT id, version, k IN (1, 5) AS semver FROM v")
def semver(spark, sf_dir):
    return versions(spark, sf_dir).select("id", "version", text.is_semver(F.col("version")).alias("semver"))


@query(f"""WITH {_VERSIONS} SELECT id, CASE WHEN k = 4 THEN 'latest' > 'v2.1' ELSE (a, b, CASE WHEN k = 2 THEN 0 ELSE c END) > (2, 1, 0) END AS newer, CASE WHEN k = 4 THEN 'v2.1' > 'latest' ELSE (a, b, CASE WHEN k = 2 THEN 0 ELSE c END) < (2, 1, 0) END AS older FROM v
WHERE NOT (k <> 4 AND a = 0 AND b = 0 AND c = 0)""")
def version_newer(spark, sf_dir):
    """Versions against v2.1 both ways; a version of zeros alone stands for none at all and is compared as text (left out)."""
    v, at = F.col("version"), F.lit("v2.1")
    rows = versions(spark, sf_dir).filter(~((F.col("version") != "latest") & (F.col("id") % 30 == 0)))
    return rows.select("id", text.is_newer(v, at).alias("newer"), text.is_newer(at, v).alias("older"))


_JSON = """j AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN '"1.5"' WHEN 2 THEN '-2' WHEN 3 THEN '"x"' WHEN 4 THEN NULL WHEN 5 THEN '" 7 "' ELSE '[1]' END AS value FROM orders)"""


@query(f"WITH {_JSON} SELECT id, CASE id % 7 WHEN 1 THEN 1.5 WHEN 2 THEN -2 WHEN 5 THEN 7 END::DOUBLE AS number FROM j")
def json_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.element_at(F.array(*map(F.lit, ("true", '"1.5"', "-2", '"x"', None, '" 7 "', "[1]"))), (k % 7 + 1).cast("int"))
    return rasters.table(spark, sf_dir, "orders").select(k.alias("id"), text.strict_number(value).alias("number"))


@query("SELECT o_orderkey AS id, '\"' || o_orderstatus || '\"' AS status, o_totalprice IS NULL AS missing, '[' || o_orderkey || ',null]' AS list FROM orders")
def json_values(spark, sf_dir):
    k = F.col("o_orderkey")
    safe = text.json_safe
    return rasters.table(spark, sf_dir, "orders").select(k.alias("id"), safe(F.col("o_orderstatus")).alias("status"), safe(F.col("o_totalprice")).isNull().alias("missing"), safe(F.array(k, F.lit(None).cast("long"))).alias("list"))


@query(r"SELECT p_partkey AS id, regexp_replace(p_name || '/é*', '[^\pL\pN _-]', '_', 'g') AS safe, 'preset' AS empty, 'part_' || p_partkey || '_' || (p_size + 1) AS layer FROM part")
def output_names(spark, sf_dir):
    path = F.concat(F.lit("/data/in.d/part_"), F.col("p_partkey"), F.lit(".tif"))
    return rasters.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.safe_name(F.concat("p_name", F.lit("/é*"))).alias("safe"), text.safe_name(F.lit("  ")).alias("empty"), text.fill_template("{stem}_{index}", path, F.col("p_size")).alias("layer")
    )


@query("SELECT event_id, coalesce(epoch(TIMESTAMP '2024-01-15 00:00:00') - epoch(ts) < 86400, false) AS held FROM events")
def throttle(spark, sf_dir):
    return rasters.table(spark, sf_dir, "events").select("event_id", text.throttled(F.col("ts"), F.lit("2024-01-15 00:00:00")).alias("held"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 1 THEN 'EPSG:4326' WHEN 2 THEN 'EPSG:3857' WHEN 3 THEN 'EPSG:32618' WHEN 4 THEN 'EPSG:32619' WHEN 5 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'EPSG:1' ELSE 'EPSG:31370' END ELSE 'EPSG:1' END AS crs FROM supplier""")
def crs_choice(spark, sf_dir):
    k = F.col("s_suppkey")
    custom = F.when(k % 3 == 0, "  ").otherwise(" EPSG:31370 ")
    return rasters.table(spark, sf_dir, "supplier").select(k.alias("id"), text.crs_choice(k % 8, custom, F.lit("EPSG:1")).alias("crs"))


@query("SELECT s_suppkey AS id, 'en' AS lang, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 9)::VARCHAR ELSE '8' END AS colors, 2 AS n FROM supplier")
def parameter_maps(spark, sf_dir):
    k = F.col("s_suppkey")
    given = F.when(k % 2 == 0, F.create_map(F.lit("colors"), (k % 9).cast("string"), F.lit("unheard_of"), F.lit("1")))
    rows = rasters.table(spark, sf_dir, "supplier").select(k.alias("id"), text.with_defaults(given, {"lang": "en", "colors": "8"}).alias("m"))
    return rows.select("id", F.element_at("m", "lang").alias("lang"), F.element_at("m", "colors").alias("colors"), F.size("m").alias("n"))


# State and evaluation


@query(f"WITH {HI}, d AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY source_path, status ORDER BY timestamp DESC, event_id) = 1) SELECT source_path, status, max(timestamp) AS timestamp FROM d GROUP BY ALL")
def history_distinct(spark, sf_dir):
    rows = state.newest(history(spark, sf_dir), 1 << 30, key=["source_path", "status"])
    return rows.select("source_path", "status", "timestamp")


@query(f"WITH {HI} SELECT DISTINCT source_path AS name, dense_rank() OVER (ORDER BY lower(source_path), source_path)::INT AS position FROM h")
def presets_by_name(spark, sf_dir):
    presets = history(spark, sf_dir).select(F.col("source_path").alias("name"), F.col("profile_id").alias("parameters"), F.col("timestamp").alias("saved"))
    return state.presets(presets).select("name", "position")


@query("""SELECT direction, canonical FROM (VALUES ('ge', 'gte'), ('gte', 'gte'), ('greater_or_equal', 'gte'), ('greater_equal', 'gte'), ('le', 'lte'), ('lte', 'lte'), ('less_or_equal', 'lte'), ('less_equal', 'lte'), ('gt', 'gt'), ('lt', 'lt'), ('eq', 'eq'), (' GTE ', 'gte'), ('above', NULL)) t(direction, canonical)""")
def direction_names(spark, sf_dir):
    names = spark.createDataFrame([(x,) for x in (*evaluation.DIRECTIONS, " GTE ", "above")], "direction string")
    return names.select("direction", evaluation.canonical_direction(F.col("direction")).alias("canonical"))
