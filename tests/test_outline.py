"""Unions of polygons: outlines, rings and merged features with known shapes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from civlens.functions import geo
from civlens.operators import outline as O
from civlens.sources.sinks import write_geojson_features

SCHEMA = "k string, name string, surface double, geometry array<array<array<struct<x:double,y:double>>>>"


def box(x, y, w=1.0, h=1.0, clockwise=False):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return ring[::-1] if clockwise else ring


def ell(x, y):
    return [(x, y), (x + 1, y), (x + 1, y + 0.5), (x + 0.5, y + 0.5), (x + 0.5, y + 1), (x, y + 1), (x, y)]


def table(spark, parts):
    """parts: (key, rings of one polygon)."""
    rows = [(k, f"n{i}", 1.0, None if rings is None else [[[(float(a), float(b)) for a, b in r] for r in rings]]) for i, (k, rings) in enumerate(parts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def edges_of(spark, parts):
    return {(r.key, (r.ax, r.ay), (r.bx, r.by)) for r in O.outline(table(spark, parts), F.col("k")).collect()}


def ring_lists(spark, parts):
    found = {}
    for r in O.rings(O.outline(table(spark, parts), F.col("k"))).collect():
        found.setdefault((r.key, tuple(r.ring)), []).append((r.position, (r.x, r.y), r["size"]))
    out = []
    for (key, _), points in found.items():
        points.sort()
        assert [p for p, *_ in points] == list(range(len(points))) and {s for *_, s in points} == {len(points)}
        out.append((key, [v for _, v, _ in points]))
    return sorted(out)


def test_two_squares_either_way_round(spark):
    for flip in (False, True):
        got = ring_lists(spark, [("a", [box(0, 0, clockwise=flip)]), ("a", [box(1, 0, clockwise=not flip)]), ("b", [box(1, 0)])])
        assert got == [("a", [(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1)]), ("b", [(1, 0), (2, 0), (2, 1), (1, 1)])]


def test_vertices_on_longer_edges(spark):
    # the lower side of the upper shape is cut where the notch of the lower one begins
    got = ring_lists(spark, [("a", [ell(0, 0)]), ("a", [ell(0, 1)])])
    assert got == [("a", [(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (1, 1), (1, 1.5), (0.5, 1.5), (0.5, 2), (0, 2), (0, 1)])]
    many = [("a", [box(0, 0, 64, 1)])] + [("a", [box(k, 1, 1, 1)]) for k in range(64)]
    (_, ring), = ring_lists(spark, many)
    assert set(ring) == {(0, 0), (64, 0), (64, 1), (0, 1)} | {(k, 2) for k in range(65)}


def test_holes_corners_and_separate_parts(spark):
    around = [("h", [box(0, 0, 3, 1)]), ("h", [box(0, 2, 3, 1)]), ("h", [box(0, 1)]), ("h", [box(2, 1)])]
    got = ring_lists(spark, around + [("c", [box(0, 0)]), ("c", [box(1, 1)])])
    assert [len(r) for k, r in got if k == "c"] == [4, 4]
    assert sorted(len(r) for k, r in got if k == "h")[0] == 4 and len([1 for k, _ in got if k == "h"]) == 2
    shape = O.merged_polygons(table(spark, around), F.col("k"))
    row = shape.select(geo.area(F.col("geometry")).alias("a"), F.size("geometry").alias("n"), F.size(F.get("geometry", 0)).alias("r")).first()
    assert tuple(row) == (8.0, 1, 2)
    ringed = [("z", [box(0, 0, 9, 9), box(1, 1, 7, 7)]), ("z", [box(3, 3, 3, 3), box(4, 4)]), ("z", [box(20, 0)])]
    (row,) = O.merged_polygons(table(spark, ringed), F.col("k")).collect()
    assert sorted(len(p) for p in row.geometry) == [1, 2, 2]
    first = lambda p: (min(p[0], key=lambda v: (v.x, v.y)).x, [min(h, key=lambda v: (v.x, v.y)).x for h in p[1:]])
    assert sorted(map(first, row.geometry)) == [(0, [1]), (3, [4]), (20, [])]


def test_equal_parts_holes_filled_null_and_empty(spark):
    got = edges_of(spark, [("a", [box(0, 0)]), ("a", [box(0, 0)]), ("n", None)])
    assert got == {("a", p, q) for p, q in zip(box(0, 0), box(0, 0)[1:], strict=False)}
    assert len(edges_of(spark, [("f", [box(0, 0, 3, 3), box(1, 1)]), ("f", [box(1, 1)])])) == 4
    assert edges_of(spark, []) == set() and ring_lists(spark, []) == []


@pytest.mark.parametrize("seed", range(2))
def test_random_cells_of_a_grid(spark, seed):
    """Cells of a unit grid, some merged to wider boxes: edges between a chosen and another cell."""
    rng = random.Random(seed)
    n = 9
    chosen = {(x, y) for x in range(n) for y in range(n) if rng.random() < 0.55}
    parts, left = [], set(chosen)
    for x, y in sorted(chosen):
        if (x, y) in left:
            w = 1
            while (x + w, y) in left and rng.random() < 0.5:
                w += 1
            left -= {(x + k, y) for k in range(w)}
            parts.append(("g", [box(x, y, w, 1, clockwise=rng.random() < 0.5)]))
    sides = 0
    for x, y in chosen:
        sides += sum(c not in chosen for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)))
    edges = O.outline(table(spark, parts), F.col("k"))
    (m,) = O.measures(edges).collect()
    assert (m.area, m.perimeter) == (len(chosen), sides)
    lines = ring_lists(spark, parts)
    doubled = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True))
    assert sum(len(r) for _, r in lines) == m.n_edges and sum(doubled(r) for _, r in lines) == 2 * len(chosen)
    (row,) = O.merged_polygons(table(spark, parts), F.col("k")).select(geo.area(F.col("geometry")).alias("a")).collect()
    assert row.a == len(chosen)


def test_too_many_vertices_are_told(spark):
    with pytest.raises(Exception, match="more than 3 vertices"):
        O.merged_polygons(table(spark, [("a", [box(0, 0)])]), F.col("k"), max_vertices=3).collect()


def test_merged_feature_is_written(spark, tmp_path):
    districts = table(spark, [("1", [box(0, 0)]), ("2", [box(1, 0)]), ("3", [box(0, 1)]), ("5", [box(5, 5)])])
    out = O.merge_features(districts, "k", ["1", "2", "3", "4"], "1", {"name": "Centre"}, "surface")
    path = str(tmp_path / "features")
    as_json = out.withColumn("geometry", geo.multipolygon_to_geojson(F.col("geometry")))
    write_geojson_features(as_json, "geometry", ["k", "name", "surface", "lon", "lat"], path)
    got = {f["properties"]["k"]: f for f in (json.loads(r.value) for r in spark.read.text(path).collect())}
    assert set(got) == {"1_OLD", "2_OLD", "3_OLD", "5", "1"}
    new = got["1"]
    assert new["properties"]["name"] == "Centre" and new["properties"]["surface"] == 3.0
    assert abs(new["properties"]["lon"] - 5 / 6) < 1e-12 and abs(new["properties"]["lat"] - 5 / 6) < 1e-12
    assert new["geometry"]["coordinates"] == [[[[0, 0], [1, 0], [2, 0], [2, 1], [1, 1], [1, 2], [0, 2], [0, 1], [0, 0]]]]
