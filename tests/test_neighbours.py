"""Nearest neighbours, k-NN and SMOTE against brute force."""

from collections import Counter

import numpy as np
import pytest

from civlens.operators import neighbours as N

SCHEMA = "id long, label int, far int, v array<float>"


def frame(spark, vectors, labels=None, first=0):
    rows = [(first + i, int(labels[i]) if labels is not None else 0, 7, None if v is None else [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def vectors_of(df):
    return [(r.id, r.label, np.array(r.v, np.float64)) for r in df.collect() if r.v is not None]


def brute(queries, points, k, by=False, exclude=False):
    held = vectors_of(points)
    for q, g, v in vectors_of(queries):
        near = sorted((float(((v - w) ** 2).sum()), i) for i, h, w in held if (not by or h == g) and not (exclude and i == q))
        yield from ((q, r, i) for r, (_, i) in enumerate(near[:k], 1))


def found(*args, **more):
    out = N.nearest(*args, **more)
    return sorted((r.id, r.rank, r.neighbour) for r in out.collect())


@pytest.mark.parametrize("by, exclude", [(False, False), (False, True), (True, True)])
def test_equal_brute_force_with_a_hot_part(spark, monkeypatch, by, exclude):
    monkeypatch.setattr(N, "CHUNK", 40)
    rng = np.random.default_rng(5)
    spread = np.concatenate([rng.normal(0, 0.01, (150, 5)), rng.normal(0, 3, (150, 5)), rng.normal(9, 1, (100, 5))])
    spread = np.concatenate([spread, spread[:30], spread[:5], spread[:5]])  # copies: ties by key
    points = frame(spark, spread, rng.integers(0, 3, len(spread)))
    queries = points if exclude else frame(spark, np.concatenate([rng.normal(0, 4, (60, 5)), spread[:20]]), rng.integers(0, 4, 80), first=5000)
    got = found(queries, points, "id", "v", 6, by="label" if by else None, exclude_self=exclude)
    assert got == sorted(brute(queries, points, 6, by, exclude))


def test_few_null_and_no_points(spark):
    points = frame(spark, [[1, 2], None, [1, 2], [5, float("nan")]])
    assert found(points, points, "id", "v", 5) == [(0, 1, 0), (0, 2, 2), (2, 1, 0), (2, 2, 2)]
    assert found(points, points, "id", "v", 5, exclude_self=True) == [(0, 1, 2), (2, 1, 0)]
    none = points.where("id < 0")
    assert found(points, none, "id", "v", 3) == [] and found(none, points, "id", "v", 3) == []


def test_parts_that_bounds_exclude_are_not_asked(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(0, 100, (30, 4))
    points = np.concatenate([m + rng.normal(0, 0.1, (40, 4)) for m in middles])
    pivots = middles
    far = np.sqrt(N.squares(points, pivots))
    part = far.argmin(axis=1)
    rows = []
    for p in range(30):
        own = np.sort(far[part == p, p])
        rows.append(type("Row", (), {"part": p, "low": own[0], "high": own[-1], "least": own[:8].tolist(), "__getitem__": lambda s, c: getattr(s, c)})())
    asked = N.Bounds(rows, 8).parts(far)
    assert asked[np.arange(len(points)), part].all() and asked.sum() < 1.2 * len(points)


def test_votes_and_ties(spark):
    points = frame(spark, [[0, 0], [0, 1], [1, 0], [9, 9], [9, 8], [5, 5]], [2, 1, 1, 3, 0, 4])
    said = N.knn_classify(points, frame(spark, [[0.1, 0.1], [9, 8.4]], first=100), "id", "v", "label", 3)
    assert sorted(map(tuple, said.collect())) == [(100, 1), (101, 0)]


def test_smote_levels_classes_on_segments(spark):
    rng = np.random.default_rng(7)
    labels = np.repeat([0, 1, 2, 3], [90, 17, 3, 1])
    df = frame(spark, rng.normal(0, 1, (111, 3)), labels)
    held = {i: (g, v) for i, g, v in vectors_of(df)}
    near = {}
    for q, r, i in brute(df, df, 5, by=True, exclude=True):
        near.setdefault(q, []).append(i)
    out = N.smote(df, "id", "v", "label", 5, seed=3).collect()
    assert Counter(r.label for r in out) == {1: 73, 2: 87}  # the class of one row stays
    assert len({(r.base, r.copy) for r in out}) == len(out)
    for r in out:
        a, b = held[r.base][1], held[r.neighbour][1]
        assert held[r.base][0] == held[r.neighbour][0] == r.label and r.neighbour in near[r.base] and 0 <= r.u < 1
        assert np.allclose(r.v, a + r.u * (b - a), atol=1e-12)
    made = Counter(r.base for r in out if r.label == 1)
    assert set(made.values()) == {4, 5} and len({r.neighbour for r in out if r.label == 1}) > 5
    again = N.smote(df.repartition(7), "id", "v", "label", 5, seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_closest_equals_exact_distances():
    rng = np.random.default_rng(8)
    b = np.concatenate([rng.normal(0, 1, (5000, 6)), rng.normal(0, 1e-3, (300, 6))]) + 1e6
    b = np.concatenate([b, b[:40], b[:40], np.full((1, 6), np.inf), np.full((2, 6), 1e200)])
    ids = rng.permutation(len(b))
    a = np.concatenate([b[::90], rng.normal(1e6, 2, (50, 6)), np.full((1, 6), np.inf)])
    for own in (None, np.concatenate([ids[::90], np.full(51, -1)])):
        i, j, far = N.closest(a, b, 7, ids, own)
        with np.errstate(all="ignore"):
            exact = N.squares(a, b)
        if own is not None:
            exact[own[:, None] == ids] = np.inf
        for q, d in enumerate(exact):
            want = np.lexsort((ids, d))[:7]
            want = want[np.isfinite(d[want])]
            assert (ids[j[i == q]] == ids[want]).all() and (far[i == q] == d[want]).all()


def test_queries_travel_once_a_chunk(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = frame(spark, rng.normal(0, 1, (700, 32)))  # bounds exclude nothing: a row for each part would be 26 * 700
    seen, asked = [], N._asked
    monkeypatch.setattr(N, "_asked", lambda *a: seen.append(asked(*a)) or seen[-1])
    assert N.nearest(points, points, "id", "v", 3, exclude_self=True).count() == 2100
    assert seen[0].selectExpr("sum(length(id)) div 8").first()[0] == 700


def test_smote_asks_for_rows_with_copies_only(spark, monkeypatch):
    rng = np.random.default_rng(10)
    df = frame(spark, rng.normal(0, 1, (110, 3)), np.repeat([0, 1], [60, 50]))
    asked, near = [], N.nearest
    monkeypatch.setattr(N, "nearest", lambda queries, *a, **more: asked.append(queries.count()) or near(queries, *a, **more))
    assert N.smote(df, "id", "v", "label", 5, seed=3).count() == 10 and asked == [10]
