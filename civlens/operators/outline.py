"""SP-12: the union of polygons as rows: edge cancellation and ring assembly.

Interiors of the parts of a key do not overlap (districts), so their union is bounded by the edges that
no two parts share:

  1. edges are directed so that the interior lies on their left;
  2. an edge is cut wherever a vertex of another part lies on it. Candidates meet in grid cells whose
     size follows the length of the edge (one grid a power of two), so that an edge of any length
     touches a few cells;
  3. the pieces between two points are counted with their direction; those of both directions cancel.

That leaves the outline as rows, by plain grouping. Rings are then found by pointer doubling over the
edges: each edge points to the next one (the sharpest left turn where several begin), and after log2 of
the longest ring's length every edge knows the smallest edge of its ring and how far away it is, which
numbers the vertices. Only ``merged_polygons`` gathers a key's geometry, up to a stated number of
vertices.

Null and empty geometries have no edges; equal parts count once. A hole that touches its shell in one
vertex stays part of the shell's ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civlens.functions import geo
from civlens.operators.components import fixed

EDGE = ["ax", "ay", "bx", "by"]
#: A vertex lies on an edge if it is no farther away than this, relative to the edge's length.
TOLERANCE = 1e-12


def _cross(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    return ux * vy - uy * vx


def directed_edges(polygons: DataFrame, key: Column, geom: str) -> DataFrame:
    """key, ax, ay, bx, by, n: edges with the interior on their left; shells run anticlockwise."""
    parts = polygons.select(key.alias("key"), F.explode(geom).alias("polygon"))
    rings = parts.select("key", F.posexplode("polygon").alias("k", "ring"))
    left = (F.col("k") == 0) == (geo.ring_signed_area(F.col("ring")) > 0)
    turned = rings.where(F.size("ring") > 2).select("key", F.when(left, F.col("ring")).otherwise(F.reverse("ring")).alias("ring"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", i + 1).alias("b"))
    )
    edges = turned.select("key", F.explode(pairs).alias("e"))
    # + 0.0: minus zero becomes zero
    ends = [(F.col(f"e.{end}.{c}") + F.lit(0.0)).alias(end + c) for end in "ab" for c in "xy"]
    return edges.select("key", *ends).where("ax <> bx or ay <> by").groupBy("key", *EDGE).agg(F.count(F.lit(1)).alias("n"))


def _noded(edges: DataFrame) -> DataFrame:
    """The edges cut at the vertices (of the same key) that lie on them."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    long = F.sqrt(dx * dx + dy * dy)
    sized = edges.withColumn("level", F.ceil(F.log2(long)).cast("int"))
    side = F.pow(F.lit(2.0), F.col("level"))
    slack = F.lit(1e-9)
    span = lambda a, b: F.sequence(
        F.floor(F.least(a, b) / side - slack), F.floor(F.greatest(a, b) / side + slack)
    )
    spread = sized.withColumn("cx", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by"))))
    vertices = edges.select("key", F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    levels = sized.select("key", "level").distinct()
    placed = vertices.join(levels, "key").withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    ux, uy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    along = (ux * dx + uy * dy) / (dx * dx + dy * dy)
    off = F.abs(_cross(dx, dy, ux, uy)) / long
    inner = ~((F.col("x") == F.col("ax")) & (F.col("y") == F.col("ay"))) & ~((F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")))
    hits = (
        spread.join(placed, ["key", "level", "cx", "cy"])
        .where(inner & (along > 0) & (along < 1) & (off <= F.lit(TOLERANCE) * (1 + long)))
        .select("key", *EDGE, "n", along.alias("t"), "x", "y")
    )
    start = edges.select("key", *EDGE, "n", F.lit(0.0).alias("t"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    on_edge = Window.partitionBy("key", *EDGE).orderBy("t", "x", "y")
    stops = start.unionByName(hits).select(
        "key", "n", "x", "y",
        F.lead("x", 1).over(on_edge).alias("x2"), F.lead("y", 1).over(on_edge).alias("y2"), "bx", "by",
    )
    return stops.select(
        "key", F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce("x2", "bx").alias("bx"), F.coalesce("y2", "by").alias("by"), "n"
    )


def outline(polygons: DataFrame, key: Column, geom: str = "geometry") -> DataFrame:
    """key, ax, ay, bx, by: the edges that bound the union of each key's polygons, interior on the
    left."""
    pieces = _noded(directed_edges(polygons, key, geom))
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    ways = pieces.groupBy("key", F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(
        F.sum(F.when(a < b, F.col("n")).otherwise(-F.col("n"))).alias("net")
    )
    end = lambda up, down, c: F.when(F.col("net") > 0, F.col(f"{up}.{c}")).otherwise(F.col(f"{down}.{c}"))
    return ways.where("net <> 0").select(
        "key", end("low", "high", "x").alias("ax"), end("low", "high", "y").alias("ay"),
        end("high", "low", "x").alias("bx"), end("high", "low", "y").alias("by"),
    )


def measures(edges: DataFrame) -> DataFrame:
    """key, area, perimeter, n_edges of outlines: sums over the edges, whatever rings they form."""
    cross = _cross(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return edges.groupBy("key").agg(
        (F.sum(cross) / 2).alias("area"),
        F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("perimeter"),
        F.count(F.lit(1)).alias("n_edges"),
    )


def rings(edges: DataFrame) -> DataFrame:
    """key, ring, position, x, y, size: the vertices of the rings of outlines in order. ``ring`` is the
    ring's smallest edge, at whose start position 0 lies. Runs a few jobs for each doubling."""
    edge = F.struct(*EDGE)
    of = edges.select("key", edge.alias("e"))
    begins = edges.select("key", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    ux, uy, vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("bx"), F.col("cy") - F.col("by")
    turn = F.atan2(_cross(ux, uy, vx, vy), ux * vx + uy * vy)
    sharpest = Window.partitionBy("key", "e").orderBy(F.desc("turn"))
    met = edges.join(begins, ["key", "bx", "by"]).select(
        "key", edge.alias("e"), F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("cx").alias("bx"), F.col("cy").alias("by")).alias("next"), turn.alias("turn"),
    )
    follow = met.withColumn("__rn", F.row_number().over(sharpest)).where("__rn = 1").select("key", "e", "next")
    table = fixed(of.join(follow, ["key", "e"]).select("key", "e", "next", F.col("e").alias("best"), F.lit(0).cast("long").alias("off")))
    span = 1
    while True:
        ahead = table.select("key", F.col("e").alias("next"), F.col("next").alias("next2"), F.col("best").alias("best2"), F.col("off").alias("off2"))
        better = F.col("best2") < F.col("best")
        table = fixed(
            table.join(ahead, ["key", "next"]).select(
                "key", "e", F.col("next2").alias("next"),
                F.when(better, F.col("best2")).otherwise(F.col("best")).alias("best"),
                F.when(better, F.col("off2") + span).otherwise(F.col("off")).alias("off"),
                better.alias("moved"),
            )
        )
        span *= 2
        if table.where("moved").isEmpty():
            break
    sizes = table.groupBy("key", "best").agg(F.count(F.lit(1)).alias("size"))
    return table.join(sizes, ["key", "best"]).select(
        "key", F.col("best").alias("ring"), F.pmod(F.col("size") - F.col("off"), F.col("size")).alias("position"),
        F.col("e.ax").alias("x"), F.col("e.ay").alias("y"), "size",
    )


def merged_polygons(polygons: DataFrame, key: Column, geom: str = "geometry", max_vertices: int = 1_000_000) -> DataFrame:
    """key, geometry: the union of each key's polygons as one multipolygon, holes with the smallest
    shell around them. A key whose outline has more than ``max_vertices`` fails the query; ``rings``
    has its vertices as rows."""
    lines = rings(outline(polygons, key, geom))
    totals = lines.groupBy("key").agg(F.count(F.lit(1)).alias("total"))
    told = F.concat(F.lit(f"an outline has more than {max_vertices} vertices: "), F.col("total").cast("string"))
    bounded = lines.join(totals, "key").withColumn(
        "position", F.when(F.col("total") > max_vertices, F.raise_error(told).cast("long")).otherwise(F.col("position"))
    )
    points = F.array_sort(F.collect_list(F.struct("position", "x", "y")))
    ring = bounded.groupBy("key", "ring").agg(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))
    closed = ring.select("key", F.concat("pts", F.slice("pts", 1, 1)).alias("line"))
    signed = closed.withColumn("signed", geo.ring_signed_area(F.col("line")))
    holes = F.collect_list(F.when(F.col("signed") < 0, F.col("line")))
    shells = F.array_sort(F.collect_list(F.when(F.col("signed") > 0, F.struct("signed", "line"))))
    # a hole belongs to the first shell, by size, that holds a point just inside the hole's first edge
    gathered = signed.groupBy("key").agg(shells.alias("shells"), holes.alias("holes"))
    inside = lambda shell, hole: geo.contains_point(F.array(F.array(shell)), F.get(hole, 0)["x"], F.get(hole, 0)["y"], strict=False)
    home = lambda hole: F.array_position(F.transform("shells", lambda s: inside(s["line"], hole)), True)
    homes = gathered.withColumn("homes", F.transform("holes", home))
    nested = F.transform(
        "shells",
        lambda s, k: F.concat(F.array(s["line"]), F.filter("holes", lambda h, j: F.get("homes", j) == k + 1)),
    )
    return homes.select("key", nested.alias("geometry"))


def merge_features(features: DataFrame, key: str, old: list, merged_key: str, merged: dict[str, str], area: str, geom: str = "geometry") -> DataFrame:
    """S-18: the features, those whose ``key`` (text) is in ``old`` renamed to ``<key>_OLD``, and one
    further feature: the union of those, with the key ``merged_key``, the texts ``merged``, the sum of
    ``area`` and the centroid as lon, lat. Other properties of it are null."""
    gone = F.col(key).isin(*old)
    renamed = features.withColumn(key, F.when(gone, F.concat(key, F.lit("_OLD"))).otherwise(F.col(key)))
    chosen = features.where(gone)
    shape = merged_polygons(chosen, F.lit(merged_key), geom).join(
        chosen.groupBy(F.lit(merged_key).alias("key")).agg(F.sum(area).alias(area)), "key"
    )
    centre = geo.centroid(F.col(geom))
    new = shape.select(
        F.col("key").alias(key), *[F.lit(v).alias(c) for c, v in merged.items()], F.col(area), F.col(geom),
        centre.x.alias("lon"), centre.y.alias("lat"),
    )
    return renamed.unionByName(new, allowMissingColumns=True)
