"""Geometry on ``array<struct<x double, y double>>`` as column expressions.

Rings have their vertices on pixel corners; with y pointing down an exterior has a positive signed area.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
TINY = 1e-12


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def same_point(a: Column, b: Column) -> Column:
    return (a["x"] == b["x"]) & (a["y"] == b["y"])


def first(points: Column) -> Column:
    return F.get(points, F.lit(0))


def last(points: Column) -> Column:
    return F.get(points, F.size(points) - 1)


def is_closed(ring: Column) -> Column:
    return (F.size(ring) > 0) & same_point(first(ring), last(ring))


def open_ring(points: Column) -> Column:
    """Without repeated neighbours, and without the last vertex if it is the first again."""
    def trimmed(own: Column) -> Column:
        again = (F.size(own) > 1) & same_point(first(own), last(own))
        return F.when(again, F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(own)

    return let(points, lambda q: let(F.filter(q, lambda p, i: (i == 0) | ~same_point(p, F.get(q, i - 1))), trimmed))


def close_ring(points: Column) -> Column:
    return let(open_ring(points), lambda ring: F.concat(ring, F.slice(ring, 1, 1)))


def segments(points: Column) -> Column:
    """array<struct<a, b>> of neighbouring vertices."""
    def pairs(p: Column) -> Column:
        n = F.greatest(F.size(p) - 1, F.lit(0))
        return F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(points, pairs)


def _total(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + term(x))


def _cross(s: Column) -> Column:
    return s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]


def signed_area(ring: Column) -> Column:
    """Shoelace area of the closed ring; of fewer than three corners 0."""
    return let(close_ring(ring), lambda closed: F.when(F.size(closed) < 4, 0.0).otherwise(_total(segments(closed), _cross) / 2))


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def line_length(points: Column) -> Column:
    return _total(segments(points), lambda s: distance(s["a"], s["b"]))


def ring_length(ring: Column) -> Column:
    return line_length(close_ring(ring))


def centroid(ring: Column) -> Column:
    """Weighted by area; the mean of the vertices if there is no area."""
    def mean(own: Column) -> Column:
        return point(_total(own, lambda p: p["x"]) / F.size(own), _total(own, lambda p: p["y"]) / F.size(own))

    def weighed(cuts: Column) -> Column:
        zero = F.struct(*(F.lit(0.0).alias(n) for n in ("twice", "x", "y")))

        def add(t: Column, s: Column) -> Column:
            c = _cross(s)
            return F.struct((t["twice"] + c).alias("twice"), (t["x"] + (s["a"]["x"] + s["b"]["x"]) * c).alias("x"), (t["y"] + (s["a"]["y"] + s["b"]["y"]) * c).alias("y"))

        return F.aggregate(cuts, zero, add)

    def chosen(own: Column) -> Column:
        whole = weighed(segments(F.concat(own, F.slice(own, 1, 1))))
        flat = lambda t: (F.size(own) < 3) | (t["twice"] == 0)
        return let(whole, lambda t: F.when(flat(t), mean(own)).otherwise(point(t["x"] / (3 * t["twice"]), t["y"] / (3 * t["twice"]))))

    return let(open_ring(ring), chosen)


def inside(p: Column, ring: Column) -> Column:
    """Even-odd rule by a ray to the right."""
    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        rise = b["y"] - a["y"]
        at = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.when(rise == 0, TINY).otherwise(rise) + a["x"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < at)

    return F.size(F.filter(segments(close_ring(ring)), crosses)) % 2 == 1


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments cross properly, in the inside of both; parallel ones don't."""
    ax, ay, bx, by, cx, cy, dx, dy = (c.cast("double") for c in (ax, ay, bx, by, cx, cy, dx, dy))
    turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.nullif(turn, F.lit(0.0))
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / F.nullif(turn, F.lit(0.0))
    return F.coalesce((t > 0) & (t < 1) & (u > 0) & (u < 1), F.lit(False))


def affine(points: Column, transform: Sequence[float] | None) -> Column:
    """World coordinates by six numbers (origin x, pixel width, row rotation, origin y, column rotation, pixel height)."""
    if transform is None or len(transform) < 6:
        return points
    ox, pw, rx, oy, ry, ph = map(float, transform[:6])
    bad = lambda p: F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf"))
    nan = point(float("nan"), float("nan"))
    return F.transform(points, lambda p: F.when(bad(p), nan).otherwise(point(F.lit(ox) + p["x"] * pw + p["y"] * rx, F.lit(oy) + p["x"] * ry + p["y"] * ph)))


def offset(points: Column, dx, dy) -> Column:
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def snap(points: Column, grid: float) -> Column:
    """Each coordinate at the nearest multiple of ``grid``, halves to the even one."""
    if grid <= 0:
        return points
    return F.transform(points, lambda p: point(F.rint(p["x"] / grid) * grid, F.rint(p["y"] / grid) * grid))


def drop_collinear(points: Column) -> Column:
    """Vertices of an open line that turn, seen from the last one kept; both ends stay."""
    def kept(p: Column) -> Column:
        def step(own: Column, i: Column) -> Column:
            def turn(a: Column, b: Column, c: Column) -> Column:
                return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

            b = F.get(p, i)
            return F.when(F.abs(turn(last(own), b, F.get(p, i + 1))) > 1e-10, F.concat(own, F.array(b))).otherwise(own)

        inner = F.aggregate(F.sequence(F.lit(1), F.size(p) - 2), F.slice(p, 1, 1), step)
        return F.when(F.size(p) <= 2, p).otherwise(F.concat(inner, F.array(last(p))))

    return let(points, kept)


def drop_collinear_ring(points: Column) -> Column:
    """Corners of a ring (open): vertices where it turns, seen from both neighbours, the ends' included; without any, all."""
    def corners(p: Column) -> Column:
        n = F.size(p)

        def turns(b: Column, i: Column) -> Column:
            a, c = F.get(p, (i + n - 1) % n), F.get(p, (i + 1) % n)
            return (b["x"] - a["x"]) * (c["y"] - b["y"]) != (b["y"] - a["y"]) * (c["x"] - b["x"])

        return let(F.filter(p, turns), lambda q: F.when((n <= 3) | (F.size(q) == 0), p).otherwise(q))

    return let(open_ring(points), corners)


def probe(ring: Column) -> Column:
    """A point to ask whether a ring lies in another: the centroid if that is inside, else the middle of its box if inside, else
    the middle of its first edge."""
    def chosen(own: Column) -> Column:
        axis = lambda n: F.transform(own, lambda p: p[n])
        middle = lambda n: (F.array_min(axis(n)) + F.array_max(axis(n))) / 2
        a, b = first(own), F.get(own, F.lit(1))
        edge = point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)
        box = point(middle("x"), middle("y"))
        return let(centroid(own), lambda c: F.when(inside(c, own), c).when(inside(box, own), box).otherwise(edge))

    return let(close_ring(ring), chosen)


def close_contour(points: Column, max_gap: float = 2.0) -> Column:
    """A ring from a line whose ends lie within ``max_gap``, else null; the first vertex is always appended."""
    near = (F.size(points) >= 3) & (distance(first(points), last(points)) <= max_gap)
    return F.when(near, F.concat(points, F.slice(points, 1, 1)))


def ring_issues(ring: Column) -> Column:
    """What is wrong with a ring: too few vertices, an open end, crossing edges."""
    def crossing(cuts: Column) -> Column:
        def crossed(s: Column, i: Column) -> Column:
            later = F.slice(cuts, i + 3, F.size(cuts))
            return F.exists(later, lambda o: segments_cross(*(e[n][c] for e in (s, o) for n in "ab" for c in "xy")))

        return F.size(F.filter(cuts, crossed)) > 0

    def told(r: Column) -> Column:
        enough = F.size(r) >= 4
        hit = let(segments(close_ring(r)), crossing)
        return F.array_compact(
            F.array(F.when(~enough, "fewer than 4 points"), F.when(enough & ~is_closed(r), "not closed"), F.when(enough & hit, "self-intersection"))
        )

    return let(ring, told)


def repair_rings(rings: Column) -> Column:
    """Rings closed and without repeated vertices, those too short dropped, the first positive and the others negative."""
    closed = F.filter(F.transform(rings, close_ring), lambda r: F.size(r) >= 4)
    return F.transform(closed, lambda r, i: F.when((signed_area(r) < 0) == (i == 0), F.reverse(r)).otherwise(r))
