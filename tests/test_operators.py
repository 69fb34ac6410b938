"""Hand-written micro-tables for the operator semantics and quirks (FIXTURES part C)."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civlens.functions import dates, geo, text
from civlens.operators import aggregates as A
from civlens.operators import columns as P
from civlens.operators import ml as ML
from civlens.operators import quality as Q
from civlens.operators import ranking as RK
from civlens.operators import spatial as S
from civlens.operators import windows as W


def test_dates_all_or_nothing(spark):
    rows = [("a", "2021-01-02 10:00:00"), ("a", None), ("b", "02/01/2021 10:00:00"), ("b", "2021-01-02 10:00:00"),
            ("c", "02/01/2021 10:00")]
    df = spark.createDataFrame(rows, "src string, d string")
    out = dates.convert_date_format(df, "d", out="t", group_by=["src"]).orderBy("src", "d").collect()
    got = {(r.src, r.d): r.t for r in out}
    assert got[("a", "2021-01-02 10:00:00")] == dt.datetime(2021, 1, 2, 10, 0)
    assert got[("a", None)] is None
    # mixed layouts in one source: no layout parses all of it -> all null
    assert got[("b", "02/01/2021 10:00:00")] is None and got[("b", "2021-01-02 10:00:00")] is None
    assert got[("c", "02/01/2021 10:00")] == dt.datetime(2021, 1, 2, 10, 0)


def test_parse_soustype(spark):
    rows = [("Propreté:Déchets [] : x",), ("a:b:c",), ("\tTabs \t: x\t",), (None,), ("no colon",)]
    df = spark.createDataFrame(rows, "s string").select(text.parse_soustype(F.col("s")).alias("p"))
    got = [(r.p.main, r.p.extra) for r in df.collect()]
    assert got == [("Propreté", "Déchets"), ("a", "b"), ("Tabs", "x"), (None, None), ("no colon", None)]


def test_translate_and_postcode(spark):
    df = spark.createDataFrame([(" Eau ",), ("Unknown",), (None,)], "c string")
    got = [r[0] for r in df.select(text.translate_category(F.col("c"))).collect()]
    assert got == ["water_service", None, None]
    codes = spark.createDataFrame([(5,), (12,), (75015,)], "c int").select(text.postcode_long(F.col("c")))
    assert [r[0] for r in codes.collect()] == ["75005", "75012", "75015"]


def test_bbox_keeps_null_and_nan(spark):
    rows = [(2.3, 48.85), (None, 48.85), (float("nan"), float("nan")), (2.219067, 48.812629), (3.0, 48.85)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    kept = P.bbox_filter(df).collect()
    assert len(kept) == 4  # the point at lon 3.0 is the only one outside
    assert len(P.bbox_filter(df, keep_null=False).collect()) == 2


def test_not_equal_keeps_null(spark):
    df = spark.createDataFrame([("Rejeté",), ("ok",), (None,)], "etat string")
    assert sorted(str(r.etat) for r in P.not_equal_keep_null(df, "etat", "Rejeté").collect()) == ["None", "ok"]


def _poly(*rings):
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]]


def test_point_in_polygon_rules(spark):
    concave = _poly([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)])
    holed = _poly([(10, 0), (14, 0), (14, 4), (10, 4), (10, 0)], [(11, 1), (13, 1), (13, 3), (11, 3), (11, 1)])
    polys = spark.createDataFrame([(1, concave), (2, holed), (0, _poly([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]))],
                                  f"pid int, geometry {geo.MULTIPOLYGON_T}")
    pts = spark.createDataFrame(
        [(1, 2.0, 3.0), (2, 1.0, 0.5), (3, 12.0, 2.0), (4, 10.5, 2.0), (5, 4.0, 2.0), (6, 0.5, 0.5)],
        "id int, lon double, lat double")
    out = S.assign_points(pts, polys, ["pid"], cell=1.0, rank=F.col("pid"))
    got = {r.id: r.poly_pid for r in out.collect()}
    assert got[1] is None  # in the notch of the concave ring
    assert got[2] == 1
    assert got[3] is None  # in the hole
    assert got[4] == 2
    assert got[5] is None  # on the boundary: strict contains says outside
    assert got[6] == 0  # inside two polygons: the first by rank wins
    lenient = S.assign_points(pts, polys, ["pid"], cell=1.0, strict=False).where("id = 5").collect()
    assert lenient[0].poly_pid == 1


def test_spatial_join_equals_brute_force(spark):
    random.seed(3)
    sq = []
    for i in range(30):
        x, y, h = random.uniform(0, 10), random.uniform(0, 10), random.uniform(0.2, 1.5)
        sq.append((i, _poly([(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]), x, y, h))
    pts = [(j, random.uniform(-1, 11), random.uniform(-1, 11)) for j in range(2000)]
    polys = spark.createDataFrame([(i, g) for i, g, *_ in sq], f"pid int, geometry {geo.MULTIPOLYGON_T}")
    got = {r.id: r.poly_pid for r in S.assign_points(
        spark.createDataFrame(pts, "id int, lon double, lat double"), polys, ["pid"], cell=0.7).collect()}
    for j, px, py in pts:
        want = next((i for i, _, x, y, h in sq if x - h < px < x + h and y - h < py < y + h), None)
        assert got[j] == want


def test_clipped_length(spark):
    square = _poly([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)])
    lines = [[(-1, 1), (3, 1)], [(0.5, 0.5), (1.5, 0.5)], [(-1, -1), (0, 0)], [(-1, 1), (1, 1), (1, 3)]]
    df = spark.createDataFrame([(i, [{"x": float(a), "y": float(b)} for a, b in ln], square) for i, ln in enumerate(lines)],
                               f"i int, line {geo.LINE_T}, g {geo.MULTIPOLYGON_T}")
    got = [round(r[0], 9) for r in df.orderBy("i").select(geo.clipped_length(F.col("line"), F.col("g"))).collect()]
    assert got == [2.0, 1.0, 0.0, 2.0]


def test_area_centroid_bounds(spark):
    holed = _poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)])
    df = spark.createDataFrame([(holed,)], f"g {geo.MULTIPOLYGON_T}")
    r = df.select(geo.area(F.col("g")).alias("a"), geo.centroid(F.col("g")).alias("c"), geo.bounds(F.col("g")).alias("b")).first()
    assert r.a == pytest.approx(12.0)
    assert (r.c.x, r.c.y) == (pytest.approx(7 / 3), pytest.approx(7 / 3))
    assert (r.b.minx, r.b.maxy) == (0.0, 4.0)


def test_utm_and_haversine(spark):
    df = spark.createDataFrame([(3.0, 45.0, 2.3522, 48.8566)], "lon double, lat double, lon2 double, lat2 double")
    r = df.select(geo.utm31(F.col("lon"), F.col("lat")).alias("p"),
                  geo.haversine_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("d")).first()
    assert r.p.x == pytest.approx(500000.0, abs=1e-6)
    assert r.p.y == pytest.approx(4982950.4, abs=1.0)  # 0.9996 x meridian arc at 45 degrees
    assert 425 < r.d < 435


def test_geojson_and_wkt_roundtrip(spark):
    gj = '{"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]]}'
    df = spark.createDataFrame([(gj,), ("not json",)], "t string")
    g = geo.geojson_to_multipolygon(F.col("t"))
    r = df.select(geo.area(g).alias("a"), geo.area(geo.wkt_polygon(geo.multipolygon_to_wkt(g))).alias("a2")).collect()
    assert r[0].a == pytest.approx(2.0) and r[0].a2 == pytest.approx(2.0)
    assert r[1].a is None


def test_week_sunday_first_matches_strftime(spark):
    days = [dt.date(y, 1, 1) + dt.timedelta(days=k) for y in range(2014, 2024) for k in range(0, 370, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", dates.week_sunday_first(F.col("d")).alias("w"))
    for r in df.collect():
        assert r.w == int(r.d.strftime("%U"))


def test_weekend_and_dayofweek(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 7),), (dt.date(2023, 1, 9),)], "d date")
    got = df.select(dates.is_weekend(F.col("d")), dates.day_of_week_monday0(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(1, 5), (0, 0)]


def test_leads_partitioned_and_global(spark):
    rows = [(d, q, d * 10 + q) for d in range(1, 6) for q in (1, 2)]
    df = spark.createDataFrame(rows, "date int, q int, v int")
    part = W.lead_features(df, "v", 3, ["date"], ["q"]).orderBy("q", "date").collect()
    assert [(r.date, r.q, r.f_1, r.f_2, r.f_0) for r in part] == [(1, 1, 21, 31, 41), (2, 1, 31, 41, 51),
                                                                  (1, 2, 22, 32, 42), (2, 2, 32, 42, 52)]
    glob = W.lead_features(df, "v", 3, ["date", "q"]).orderBy("date", "q").collect()
    assert len(glob) == 7 and (glob[0].f_1, glob[0].f_0) == (12, 22)


def test_dedup_keeps_last(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "id int, seq int, v string")
    got = sorted((r.id, r.v) for r in W.dedup_keep_last(df, "id", "seq").collect())
    assert got == [(1, "c"), (2, "x")]


def test_top_value_ties_break_by_name(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 1)], "g int, cat string, count long")
    assert {r.top_category for r in W.top_value_per_group(df, ["g"], "cat").collect()} == {"a"}


def test_margin_counts_complete_rows(spark):
    df = spark.createDataFrame([("q1", "s1", 1), ("q1", None, 2), (None, "s1", 3), ("q2", "s2", 4)],
                               "q string, s string, id int")
    got = {r.q: r.All for r in A.margin_count(df, "q", "id").collect()}
    assert got == {"q1": 1, "q2": 1}


def test_rank_and_quantiles_match_pandas(spark):
    random.seed(1)
    vals = [(random.choice("abc"), random.random() * 100) for _ in range(3000)]
    pdf = pd.DataFrame(vals, columns=["g", "v"])
    df = spark.createDataFrame(pdf)
    q = RK.exact_quantiles(df, "v", [0.1, 0.5, 0.9], by=["g"], names=["a", "b", "c"]).toPandas().set_index("g")
    for g, grp in pdf.groupby("g"):
        assert q.loc[g, "a"] == pytest.approx(grp.v.quantile(0.1))
        assert q.loc[g, "b"] == pytest.approx(grp.v.quantile(0.5))
        assert q.loc[g, "c"] == pytest.approx(grp.v.quantile(0.9))
def test_quantiles_with_ties_nulls_and_many_columns(spark):
    random.seed(2)
    pdf = pd.DataFrame({"a": [float(random.randrange(9)) for _ in range(5000)], "b'x|": [random.random() for _ in range(5000)]})
    pdf.loc[::7, "a"] = None
    df = spark.createDataFrame(pdf).repartition(8)
    got = RK.quantiles_of(df, ["a", "b'x|"], [0.0, 0.25, 0.5, 1.0], ["p0", "p25", "p50", "p100"]).toPandas().set_index("column")
    for c in pdf:
        for name, p in (("p0", 0), ("p25", 0.25), ("p50", 0.5), ("p100", 1)):
            assert got.loc[c, name] == pytest.approx(pdf[c].quantile(p))


def test_tied_values_are_one_row_before_the_window(spark):
    """9 distinct values of many rows: what is dealt out after counting is one row a value."""
    df = spark.range(20000).selectExpr("id", "cast(id % 9 as double) v")
    counts = df.groupBy(F.struct(F.lit("v").alias("column")).alias("g"), F.col("v")).agg(F.count("*").alias("n"))
    ranks = {r.v: (r.before, r.total) for r in RK.value_ranks(counts).collect()}
    assert len(ranks) == 9 and {t for _, t in ranks.values()} == {20000}
    assert [ranks[float(k)][0] for k in range(9)] == [sum(len(range(j, 20000, 9)) for j in range(k)) for k in range(9)]


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1003).withColumn("g", F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b"))
    for part in (1, 8):
        train, test = ML.split_data(df.repartition(part), "id", 0.25, seed=3)
        ids = sorted(r.id for r in test.collect())
        assert len(ids) == 251 and train.count() == 752
        sizes = {r.g: r["count"] for r in ML.downsample(df.repartition(part), "g", "id").groupBy("g").count().collect()}
        assert sizes == {"a": 100, "b": 100, None: 100}
    assert ML.sample_fraction(df.limit(6), "id", 0.25).count() == 1


def test_names_with_an_apostrophe(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y"), (4, 1.0, "z")], "`l'a` int, `b|c` double, `d``e` string")
    assert {r["column"]: r.n_null for r in Q.null_profile(df).collect()} == {"l'a": 0, "b|c": 1, "d`e": 0}
    assert {r["column"]: r["count"] for r in Q.describe(df, ["l'a", "b|c"]).collect()} == {"l'a": 3, "b|c": 2}
    assert len(Q.correlation_matrix(df, ["l'a", "b|c"]).collect()) == 4
    assert {r["column"] for r in Q.infer_types(df).collect()} == {"l'a", "b|c", "d`e"}


def test_minmax_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    st = ML.minmax_fit(df, ["a", "b"])
    got = [tuple(r) for r in ML.minmax_apply(df, st, ["a", "b"]).orderBy("a").collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0)]


def test_downsample_imbalanced(spark):
    rows = [(i, 0) for i in range(5)] + [(100 + i, 1) for i in range(20)] + [(200 + i, 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, y int")
    out = ML.downsample(df, "y", "id", seed=2)
    assert sorted((r.y, r["count"]) for r in out.groupBy("y").count().collect()) == [(0, 5), (1, 5), (2, 5)]
    assert ML.downsample(df, "y", "id", seed=2).select("id").subtract(out.select("id")).count() == 0


def test_metrics_with_class_never_predicted(spark):
    rows = [(0, 0), (0, 0), (1, 0), (1, 1), (2, 1)]
    df = spark.createDataFrame(rows, "y int, p int")
    m = ML.classification_metrics(df, "y", "p").first()
    assert m.accuracy == pytest.approx(3 / 5)
    assert m.precision_macro == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)
    assert m.recall_macro == pytest.approx((1 + 1 / 2 + 0) / 3)
    auc = {r["class"]: r.auc for r in ML.ovr_auc_hard(df, "y", "p").collect()}
    assert auc[2] == pytest.approx((0 + 1) / 2)


def test_type_inference_order_free(spark):
    cols = {"i": ["123456", "1_0", None], "f": ["1.5", "nan", "3"], "j": ['{"a": 1}', "[1, 2]", "true"],
            "v": ["123456", "ab", "1d"]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} string" for c in cols))
    got = {r.column: r.sql_type for r in Q.infer_types(df).collect()}
    assert got == {"i": "INT", "f": "FLOAT", "j": "JSON", "v": "VARCHAR(6)"}


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    got = {r.column: (r.n_null, round(r.pct_null, 3)) for r in Q.null_profile(df).collect()}
    assert got == {"x": (2, 66.667), "s": (1, 33.333)}


def test_relabel_rare(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "y int")
    assert [r[0] for r in df.select(P.relabel_rare(F.col("y"))).collect()] == [0, 1, 9, 3, 9, 9, 9, 9, 8, 9]


def test_hexbin_min_count(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.1, 0.12), (5.0, 5.0)], "lon double, lat double")
    out = S.hexbin_counts(df, "lon", "lat", (0, 0, 10, 10), nx_hexagon=10, min_count=2).collect()
    assert len(out) == 1 and out[0]["count"] == 2


def test_spatial_plans_have_no_nested_loop_join(spark):
    from civlens.plans import catalog

    catalog.load_all()
    for name in ["sp01_assign_reports", "sp02_georef_shops", "sp04_parks_intersect_district"]:
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_line_length_in_polygons_pick(spark):
    polys = spark.createDataFrame(
        [(1, _poly([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])), (2, _poly([(1, 0), (2, 0), (2, 1), (1, 1), (1, 0)]))],
        f"pid int, geometry {geo.MULTIPOLYGON_T}")
    lines = spark.createDataFrame([(7, [{"x": 0.5, "y": 0.5}, {"x": 1.8, "y": 0.5}]), (8, [{"x": 5.0, "y": 5.0},
                                                                                         {"x": 6.0, "y": 5.0}])],
                                  f"k int, line {geo.LINE_T}")
    last = {r.k: (r.poly_pid, r.length_in) for r in S.line_length_in_polygons(
        lines, polys, "k", "line", ["pid"], cell=0.5, pick="last", project=False).collect()}
    first = {r.k: (r.poly_pid, r.length_in) for r in S.line_length_in_polygons(
        lines, polys, "k", "line", ["pid"], cell=0.5, pick="first", project=False).collect()}
    assert last[7][0] == 2 and last[7][1] == pytest.approx(0.8)
    assert first[7][0] == 1 and first[7][1] == pytest.approx(0.5)
    assert last[8] == (None, None)


def _shape(*polygons):
    """Multipolygon literal from rings of corner pairs."""
    def ring(points):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [*points, points[0]]])
    return F.array(*[F.array(*[ring(r) for r in rings]) for rings in polygons])


def test_within_sees_holes_and_notches(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (3, 1), (3, 3), (1, 3)]
    ell = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    small = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)]
    cases = [
        (_shape([small]), _shape([square]), True), (_shape([square]), _shape([square]), True),
        (_shape([[(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5)]]), _shape([square, hole]), False),
        (_shape([small]), _shape([square, hole]), True),
        (_shape([[(4, 1), (4, 2), (2, 4)]]), _shape([ell]), False),
        (_shape([[(0, 0), (4, 0), (0, 4)]]), _shape([ell]), True),
        (_shape([small], [[(9, 9), (9.5, 9), (9, 9.5)]]), _shape([square]), False),
        (_shape([small], [[(9, 9), (9.5, 9), (9, 9.5)]]), _shape([square], [[(8, 8), (10, 8), (10, 10), (8, 10)]]), True),
    ]
    row = spark.range(1).select(*[geo.polygon_within(a, b).alias(str(k)) for k, (a, b, _) in enumerate(cases)]).first()
    assert [bool(v) for v in row] == [w for *_, w in cases]


def test_multi_part_lines_and_wkt(spark):
    text = F.lit('{"type": "MultiLineString", "coordinates": [[[0, 0], [0, 1]], [[10, 1], [10, 2]]]}')
    two = _shape([[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]], [[(8, 8), (9.5, 8), (8, -1e-3)]])
    one = _shape([[(0, 0), (1, 0), (0, 1)]])
    row = spark.range(1).select(
        geo.lines_length(geo.geojson_to_lines(text)).alias("n"),
        (geo.wkt_polygon(geo.multipolygon_to_wkt(two)) == two).alias("two"),
        (geo.wkt_polygon(geo.multipolygon_to_wkt(one)) == one).alias("one"),
        geo.wkt_polygon(F.lit("POINT (1 2)")).isNull().alias("point"),
    ).first()
    assert (row.n, row.two, row.one, row.point) == (2.0, True, True, True)
