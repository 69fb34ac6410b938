"""Clipping of many lines at once, and overlaps that carry no geometry through a shuffle."""

import numpy as np
from pyspark.sql import functions as F

from civlens.functions import geo
from civlens.operators import spatial as S


def ring(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def shapes(spark):
    rows = [(0, [[ring(0.0, 0.0, 4.0), ring(1.0, 1.0, 1.0)], [ring(6.0, 0.0, 2.0)]]), (1, [[ring(3.0, 1.0, 4.0)]]), (2, None), (None, [[ring(0.0, 0.0, 9.0)]])]
    return spark.createDataFrame(rows, f"q int, geometry {geo.MULTIPOLYGON_T}")


def test_clipped_lengths_equal_clipped_length(spark):
    rng = np.random.default_rng(2)
    lines = [[(float(x), float(y)) for x, y in rng.uniform(-1, 9, (n, 2))] for n in (2, 3, 5, 2, 4) * 8] + [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)], [(1.0, 1.0)], []]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], f"k int, line {geo.LINE_T}")
    flat = shapes(spark).where("geometry is not null").select("*", geo.flat_edges(F.col("geometry")).alias("edges"))
    both = df.select("*", geo.flat_points(F.col("line")).alias("points")).crossJoin(flat)
    out = both.select(
        geo.clipped_length(F.col("line"), F.col("geometry")).alias("one"),
        geo.clipped_lengths(F.col("points"), F.col("edges")).alias("many"),
    ).collect()
    assert len(out) == 3 * len(lines) and sum(r.one > 0 for r in out) > 60
    assert np.allclose([r.one for r in out], [r.many for r in out], rtol=1e-12, atol=1e-12)


def test_lines_and_samples_find_their_polygons(spark):
    lines = [(1, [(3.5, 0.5), (3.5, 3.0)]), (1, [(3.5, 0.5), (3.5, 3.0)]), (2, [(20.0, 1.0), (21.0, 1.0)]), (3, None), (None, [(0.5, 0.5), (0.5, 0.9)])]
    df = spark.createDataFrame(lines, f"k int, line {geo.LINE_T}")
    for pick, want in (("last", (1, 2.0)), ("first", (0, 2.5))):
        got = S.line_length_in_polygons(df, shapes(spark), "k", "line", ["q"], cell=0.5, pick=pick, project=False).collect()
        assert sorted((r.k or 0, r.poly_q, r.length_in) for r in got if r.k == 1) == [(1, *want)] * 2
        assert [(r.poly_q, r.length_in) for r in got if r.k != 1] == [(None, None)] * 3
    items = spark.createDataFrame([(1, [[ring(3.2, 1.2, 0.5)]]), (2, [[ring(30.0, 0.0, 1.0)]]), (3, [[ring(0.2, 0.2, 0.5)]]), (4, None)], f"k int, g {geo.MULTIPOLYGON_T}")
    found = S.sampled_overlap(items, shapes(spark), "k", F.col("g"), ["q"], cell=0.5)
    assert sorted((r.k, r.poly_q) for r in found.collect()) == [(1, 1), (2, None), (3, 0), (4, None)]
    for out in (found, S.assign_geometries(items, shapes(spark), "k", F.col("g"), ["q"], cell=0.5)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        hits = next(line for line in plan.split("\n") if "Aggregate [k#" in line)
        assert "max_by" not in hits and "min_by" not in hits
