"""DBSCAN and connected components against brute force."""

import numpy as np
import pytest

from civlens.operators import clustering as C
from civlens.operators.components import components


def brute(points, eps_km, min_samples):
    ids, lat, lon = (np.array([p[k] for p in points]) for k in range(3))
    lat, lon = np.radians(lat), np.radians(lon)
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = h <= np.sin(min(eps_km / C.RADIUS_KM, np.pi) / 2) ** 2
    core, none = near.sum(1) >= min_samples, 1 << 40
    name, links = np.where(core, ids, none), near & core[:, None] & core
    while (new := np.where(core, np.where(links, name, none).min(1), none)).tolist() != name.tolist():
        name = new
    label = np.where(near & core, name, none).min(1)
    return {int(i): int(-1 if x == none else x) for i, x in zip(ids, label, strict=True)}


def clusters(spark, points, eps_km, min_samples):
    rows = [(int(i), None if a is None else float(a), None if b is None else float(b), 7) for i, a, b in points]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, weight int").repartition(3)
    out = C.dbscan(df, "id", "lat", "lon", eps_km, min_samples)
    assert out.columns == [*df.columns, "cluster"]
    got = out.collect()
    assert len(got) == len(points)
    return {r.id: r.cluster for r in got}


def around(rng, lat, lon, spread, n):
    return rng.normal([lat, lon], spread, (n, 2))


@pytest.mark.parametrize("eps_km, min_samples", [(0.5, 5), (2.0, 30)])
def test_two_thousand_points_a_third_in_one_cell(spark, monkeypatch, eps_km, min_samples):
    monkeypatch.setattr(C, "CHUNK", 50)
    monkeypatch.setattr(C, "PAIRS", 40)
    rng = np.random.default_rng(1)
    spots = np.concatenate([around(rng, 48.85, 2.35, 0.0004, 700), around(rng, 48.9, 2.4, 0.02, 600), rng.uniform([48.7, 2.1], [49, 2.6], (700, 2))])
    points = [(i, *p) for i, p in enumerate(spots)]
    want = brute(points, eps_km, min_samples)
    assert clusters(spark, points, eps_km, min_samples) == want and len(set(want.values())) > 1


def test_crowded_cells_on_both_sides_of_a_gap(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIRS", 16)
    rng = np.random.default_rng(2)
    eps, width = 1.0, 0.002
    gap = np.degrees(eps / C.RADIUS_KM)
    strip = lambda lat: np.column_stack([lat + rng.uniform(0, width, 200), rng.uniform(2, 2.02, 200)])
    points = [(i, *p) for i, p in enumerate(np.concatenate([strip(48.0), strip(48.0 + width + gap * 1.001), strip(48.1), strip(48.1 + width + gap * 0.97)]))]
    want = brute(points, eps, 6)
    assert clusters(spark, points, eps, 6) == want and len(set(want.values())) >= 3


def test_date_line_and_poles(spark):
    rng = np.random.default_rng(3)
    areas = [([-1, 179.5], [1, 180], 150), ([-1, -180], [1, -179.5], 150), ([88.5, -180], [90, 180], 200), ([-90, -180], [-88.8, 180], 120)]
    spots = np.concatenate([rng.uniform(a, b, (n, 2)) for a, b, n in areas])
    points = [(i, *p) for i, p in enumerate(spots)] + [(5000, 90.0, 12.0), (5001, 90.0, -100.0), (5002, 0.0, 180.0), (5003, 0.0, -180.0)]
    assert clusters(spark, points, 25.0, 4) == brute(points, 25.0, 4)


def test_ties_copies_and_missing_coordinates(spark):
    grid = [(i, round(48 + 0.01 * (i % 12), 4), round(2 + 0.01 * (i // 12), 4)) for i in range(100)]
    copies = [(1000 + i, 48.05, 2.05) for i in range(60)]
    lost = [(2000, None, 2.0), (2001, 48.0, None), (2002, float("nan"), 2.0)]
    got = clusters(spark, grid + copies + lost, 1.2, 4)
    assert {i: got.pop(i) for i in (2000, 2001, 2002)} == dict.fromkeys((2000, 2001, 2002))
    assert got == brute(grid + copies, 1.2, 4)
    assert clusters(spark, [], 1.0, 3) == {}
    assert clusters(spark, [(5, 1.0, 2.0)], 1.0, 1) == {5: 5} and clusters(spark, [(5, 1.0, 2.0)], 1.0, 2) == {5: -1}


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(4)
    path = rng.permutation(400).tolist()
    chain = list(zip(path, path[1:], strict=False))
    star = [(1000, 1000 + k) for k in range(1, 500)]
    nodes = [*range(400), *range(1000, 1500), 7777]
    edges = chain + star + [(5, 5), (1000, 1000), star[0]]
    got = components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {n: 0 if n < 400 else 1000 if n < 1500 else n for n in nodes}
