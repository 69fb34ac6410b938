"""Feature, model-dataset, training and evaluation jobs (M-01..M-27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from civlens.functions import dates, geo
from civlens.operators import features as FE
from civlens.operators import ml as ML
from civlens.operators import neighbours as N
from civlens.operators import power as PW
from civlens.operators import windows as W
from civlens.operators.aggregates import count_by
from civlens.operators.joins import chain_left_joins, left_join_dim
from civlens.plans.catalog import register
from civlens.plans.spatial_queries import (
    CELL,
    GEOREF_SHOPS_SQL,
    _PARKING_SQL,
    georef_shops,
    parking,
)
from civlens.operators import spatial as S
from civlens.sources import tables
from civlens.sources.tables import REPORTS_SQL, with_ctes

rt = tables.read_table
R = REPORTS_SQL


@register("m01_ordinal_encode", with_ctes(R) + """
SELECT category_FR, CAST(dense_rank() OVER (ORDER BY category_FR) - 1 AS BIGINT) AS code, COUNT(*) AS count
FROM reports GROUP BY category_FR""")
def m01_ordinal_encode(spark, d):
    """M-01: categories coded 0..n-1 in sorted order (fitted StringIndexer)."""
    _, enc = FE.ordinal_encode(tables.reports(spark, d), "category_FR", "code")
    return enc.groupBy("category_FR", "code").agg(F.count(F.lit(1)).alias("count"))


@register("m02_one_hot_drop_first", with_ctes(R) + "SELECT id_dmr, " + ", ".join(
    [f"CAST(isodow(date_input) - 1 = {k} AS BIGINT) AS dayofweek_{k}" for k in range(1, 7)]
    + [f"CAST(month(date_input) = {m} AS BIGINT) AS month_{m}" for m in range(2, 13)]) + " FROM reports")
def m02_one_hot_drop_first(spark, d):
    """M-02: day-of-week and month one-hot columns, first present level dropped."""
    r = tables.reports(spark, d).select("id_dmr", dates.day_of_week_monday0(F.col("date_input")).alias("dayofweek"),
                                        F.month("date_input").alias("month"))
    r = FE.one_hot_drop_first(r, "dayofweek", list(range(7)))
    r = FE.one_hot_drop_first(r, "month", list(range(1, 13)))
    return r.drop("dayofweek", "month")


def district_features(spark, d):
    """M-27 / J-05 / M-03 / M-04: one row per district with area, shops, population,
    parking and densities; ``zti`` = the district holds at least one parking lot."""
    dist = tables.districts(spark, d).select("quartier_id", "name", geo.area(F.col("geometry")).alias("surface_km2"))
    shops = count_by(georef_shops(spark, d), ["quartier_id"], "number_shops", "id_")
    pop = rt(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("quartier_id")).agg(
        F.count(F.lit(1)).alias("pop_2021"))
    pk = S.assign_geometries(parking(spark, d), tables.districts(spark, d), "s_suppkey", F.col("geometry"),
                             ["quartier_id"], predicate="within", cell=CELL)
    pk = pk.where(F.col("poly_quartier_id").isNotNull()).select(F.col("poly_quartier_id").alias("quartier_id"))
    n_pk = count_by(pk, ["quartier_id"], "n_parking")
    out = chain_left_joins(dist, [shops, pop, n_pk], "quartier_id")
    out = FE.membership_flag(out, pk, "quartier_id", "zti")
    out = out.fillna(0, subset=["number_shops", "pop_2021", "n_parking"])
    return FE.per_area(out, ["number_shops", "pop_2021"], "surface_km2")


_FEATURES_SQL = """
w AS (SELECT s_suppkey, floor(lon - h) AS x, floor(lat - h) AS y, lon, lat, h FROM pk),
pw AS (SELECT CAST(x + 5 * y AS BIGINT) AS quartier_id FROM w
       WHERE x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4 AND lon + h <= x + 1 AND lat + h <= y + 1
         AND NOT (lon + h > x + 0.5 AND lat + h > y + 0.5)),
sc AS (SELECT quartier_id, COUNT(id_) AS number_shops FROM shop_georef GROUP BY 1),
po AS (SELECT CAST(c_nationkey AS BIGINT) AS quartier_id, COUNT(*) AS pop_2021 FROM customer GROUP BY 1),
np AS (SELECT quartier_id, COUNT(*) AS n_parking FROM pw GROUP BY 1),
feats AS (
SELECT CAST(n.n_nationkey AS BIGINT) AS quartier_id, n.n_name AS name, CAST(0.75 AS DOUBLE) AS surface_km2,
       coalesce(sc.number_shops, 0) AS number_shops, coalesce(po.pop_2021, 0) AS pop_2021,
       coalesce(np.n_parking, 0) AS n_parking, CAST(np.n_parking IS NOT NULL AS BIGINT) AS zti,
       round(coalesce(sc.number_shops, 0) / 0.75, 6) AS number_shops_p_km2,
       round(coalesce(po.pop_2021, 0) / 0.75, 6) AS pop_2021_p_km2
FROM nation n LEFT JOIN sc ON n.n_nationkey = sc.quartier_id LEFT JOIN po ON n.n_nationkey = po.quartier_id
     LEFT JOIN np ON n.n_nationkey = np.quartier_id)"""


@register("m27_district_features", with_ctes(GEOREF_SHOPS_SQL, _PARKING_SQL, _FEATURES_SQL) + "SELECT * FROM feats")
def m27_district_features(spark, d):
    """M-27: district feature table end to end (joins, densities, zone flag)."""
    return district_features(spark, d)


_SCALE_SQL = with_ctes(R, """
t AS (SELECT * FROM reports WHERE year(date_input) < 2000)""")


@register("m09_minmax_scale", _SCALE_SQL + """
SELECT id_dmr, CAST(year(date_input) >= 2000 AS BIGINT) AS is_test,
       round(CASE WHEN (SELECT MAX(lon) - MIN(lon) FROM t) = 0 THEN 0
                  ELSE (lon - (SELECT MIN(lon) FROM t)) / (SELECT MAX(lon) - MIN(lon) FROM t) END, 6) AS lon,
       round(CASE WHEN (SELECT MAX(lat) - MIN(lat) FROM t) = 0 THEN 0
                  ELSE (lat - (SELECT MIN(lat) FROM t)) / (SELECT MAX(lat) - MIN(lat) FROM t) END, 6) AS lat
FROM reports""")
def m09_minmax_scale(spark, d):
    """M-09: min-max scaling fitted on the train years, applied to all rows."""
    r = tables.reports(spark, d).select("id_dmr", "date_input", "lon", "lat")
    stats = ML.minmax_fit(r.where(F.year("date_input") < 2000), ["lon", "lat"])
    out = ML.minmax_apply(r, stats, ["lon", "lat"])
    return out.select("id_dmr", (F.year("date_input") >= 2000).cast("bigint").alias("is_test"), "lon", "lat")


@register("m10_standard_scale", _SCALE_SQL + """
SELECT id_dmr, round((lon - (SELECT AVG(lon) FROM t)) / (SELECT stddev_pop(lon) FROM t), 6) AS lon,
       round((lat - (SELECT AVG(lat) FROM t)) / (SELECT stddev_pop(lat) FROM t), 6) AS lat
FROM reports""")
def m10_standard_scale(spark, d):
    """M-10: standard scaling (population std) fitted on the train years."""
    r = tables.reports(spark, d).select("id_dmr", "date_input", "lon", "lat")
    stats = ML.standard_fit(r.where(F.year("date_input") < 2000), ["lon", "lat"])
    return ML.standard_apply(r, stats, ["lon", "lat"]).select("id_dmr", "lon", "lat")


def _hash_sql(seed, key):
    return f"('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 15))::BIGINT"


@register("m07_sample_quarter", f"""
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_hash_sql(11, 'o_orderkey')}) AS r,
                               COUNT(*) OVER () AS n FROM orders)
WHERE r <= floor(n * 0.25)""")
def m07_sample_quarter(spark, d):
    """M-07: exact-size random quarter of the rows (hash order)."""
    return ML.sample_fraction(rt(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.25, seed=11)


@register("m08_split_data", f"""
SELECT CASE WHEN r <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split, o_orderkey
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_hash_sql(3, 'o_orderkey')}) AS r,
             COUNT(*) OVER () AS n FROM orders)""")
def m08_split_data(spark, d):
    """M-08: exact-size 75/25 shuffle split."""
    o = rt(spark, d, "orders").select("o_orderkey")
    train, test = ML.split_data(o, "o_orderkey", 0.25, seed=3)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@register("m12_downsample", f"""
SELECT CAST(label AS BIGINT) AS label, vec_id
FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {_hash_sql(5, 'vec_id')}) AS r FROM embeddings)
WHERE r <= (SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM embeddings GROUP BY label))""")
def m12_downsample(spark, d):
    """M-12: every class sampled down to the smallest class size."""
    return ML.downsample(rt(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", seed=5)


_CM_SQL = "WITH cc AS (SELECT quality AS label, toxic AS pred, COUNT(*) AS n FROM labels GROUP BY 1, 2),\n" \
          "cl AS (SELECT label AS c FROM cc UNION SELECT pred FROM cc),\n" \
          "per AS (SELECT cl.c, coalesce((SELECT SUM(n) FROM cc WHERE label = cl.c AND pred = cl.c), 0) AS tp,\n" \
          "  coalesce((SELECT SUM(n) FROM cc WHERE label = cl.c), 0) AS n_actual,\n" \
          "  coalesce((SELECT SUM(n) FROM cc WHERE pred = cl.c), 0) AS n_pred FROM cl)\n"


@register("m21_classification_metrics", _CM_SQL + """
SELECT round(SUM(tp) / SUM(n_actual), 6) AS accuracy,
       round(AVG(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END), 6) AS precision_macro,
       round(AVG(CASE WHEN n_actual > 0 THEN tp / n_actual ELSE 0 END), 6) AS recall_macro FROM per""")
def m21_classification_metrics(spark, d):
    """M-21: accuracy, macro precision and recall from one confusion aggregate."""
    return ML.classification_metrics(rt(spark, d, "labels"), "quality", "toxic")


@register("m22_confusion_matrix", """
SELECT CAST(quality AS BIGINT) AS label, COUNT(*) FILTER (WHERE toxic = 0) AS pred_0,
       COUNT(*) FILTER (WHERE toxic = 1) AS pred_1 FROM labels GROUP BY 1""")
def m22_confusion_matrix(spark, d):
    """M-22: confusion matrix, labels x predictions."""
    return ML.confusion_matrix(rt(spark, d, "labels"), "quality", "toxic", [0, 1])


@register("m23_ovr_auc", _CM_SQL + """
SELECT CAST(c AS BIGINT) AS class,
       round((tp / n_actual + ((SELECT SUM(n) FROM cc) - n_actual - (n_pred - tp)) / ((SELECT SUM(n) FROM cc) - n_actual)) / 2, 6)
       AS auc
FROM per WHERE n_actual > 0""")
def m23_ovr_auc(spark, d):
    """M-23: one-vs-rest AUC of hard predictions per class."""
    return ML.ovr_auc_hard(rt(spark, d, "labels"), "quality", "toxic")


@register("m24_regression_metrics", """
WITH t AS (SELECT l_quantity AS y, l_discount * 500 AS p FROM lineitem)
SELECT round(sqrt(AVG((y - p) * (y - p))), 6) AS rmse,
       round(1 - SUM((y - p) * (y - p)) / SUM((y - (SELECT AVG(y) FROM t)) * (y - (SELECT AVG(y) FROM t))), 6) AS r2,
       round(AVG((y - p) / y), 6) AS bias, round(AVG(abs((y - p) / y)) * 100, 6) AS mape FROM t""")
def m24_regression_metrics(spark, d):
    """M-24: rmse, r2, bias and mape of a prediction column."""
    li = rt(spark, d, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_discount") * 500).alias("p"))
    return ML.regression_metrics(li, "y", "p")


def _embedding_split(spark, d):
    e = rt(spark, d, "embeddings")
    e = ML.assemble(e, "embedding").withColumn("label", F.col("label").cast("double"))
    return ML.split_data(e, "vec_id", 0.25, seed=1)


def _predictions(model, test):
    return model.transform(test).select("vec_id", F.col("label").cast("bigint").alias("label"),
                                        F.col("prediction").cast("bigint").alias("prediction"))


@register("m15_random_forest")
def m15_random_forest(spark, d):
    """M-15 / M-26: 300-tree forest on the embedding features; test predictions exported."""
    train, test = _embedding_split(spark, d)
    return _predictions(ML.random_forest(num_trees=300, seed=0).fit(train), test)


@register("m16_logistic_regression")
def m16_logistic_regression(spark, d):
    """M-16: multinomial logistic regression; test predictions."""
    train, test = _embedding_split(spark, d)
    return _predictions(ML.logistic_multinomial().fit(train), test)


@register("m17_decision_tree")
def m17_decision_tree(spark, d):
    """M-17: decision tree; test predictions."""
    train, test = _embedding_split(spark, d)
    return _predictions(ML.decision_tree().fit(train), test)


@register("m21_forest_test_metrics")
def m21_forest_test_metrics(spark, d):
    """M-15 + M-21: forest accuracy and macro precision / recall on the test split."""
    return ML.classification_metrics(m15_random_forest(spark, d), "label", "prediction")


@register("m19_grid_search")
def m19_grid_search(spark, d):
    """M-19 / M-20: 5-fold grid search (trees 600/500/400 x depth 8/10, balanced weights);
    cross-validated accuracy per parameter set."""
    train, _ = _embedding_split(spark, d)
    cv = ML.grid_search(train, parallelism=4)
    rows = [(int(pm[cv.getEstimator().numTrees]), int(pm[cv.getEstimator().maxDepth]), float(m))
            for pm, m in zip(cv.getEstimatorParamMaps(), cv.avgMetrics)]
    return spark.createDataFrame(rows, "num_trees bigint, max_depth bigint, cv_accuracy double")


@register("m18_stacking")
def m18_stacking(spark, d):
    """M-18: stacked forest + linear SVC -> logistic regression; test predictions."""
    train, test = _embedding_split(spark, d)
    out = ML.stacking(train, test, "vec_id")
    return _predictions_from(out)


def _predictions_from(df):
    return df.select("vec_id", F.col("label").cast("bigint").alias("label"),
                     F.col("prediction").cast("bigint").alias("prediction"))


# Fixed role: status 'P' stands for rejected reports.
REJECTED = "P"
_ONE_HOT_SQL = ", ".join(
    [f"CAST(isodow(r.date_input) - 1 = {k} AS BIGINT) AS dayofweek_{k}" for k in range(1, 7)]
    + [f"CAST(month(r.date_input) = {m} AS BIGINT) AS month_{m}" for m in range(2, 13)])


@register("m06_class_dataset", with_ctes(R, tables.REPORT_LINES_SQL, GEOREF_SHOPS_SQL, _PARKING_SQL, _FEATURES_SQL, f"""
kept AS (SELECT * FROM reports WHERE etat <> '{REJECTED}'),
st AS (SELECT id_dmr, MIN(date_etat_ts) AS first_status FROM report_lines GROUP BY 1),
codes AS (SELECT category_FR, CAST(row_number() OVER (ORDER BY category_FR) - 1 AS BIGINT) AS category_code
          FROM (SELECT DISTINCT category_FR FROM kept WHERE category_FR IS NOT NULL))""") + f"""
SELECT r.lon, r.lat,
       round((epoch(st.first_status) - epoch(CAST(r.date_input AS TIMESTAMP))) / 86400.0, 6) AS deltadays_signal_etat,
       c.category_code, {_ONE_HOT_SQL}, f.surface_km2, f.number_shops, f.pop_2021, f.n_parking, f.zti,
       f.number_shops_p_km2, f.pop_2021_p_km2
FROM kept r JOIN st ON r.id_dmr = st.id_dmr JOIN codes c ON r.category_FR = c.category_FR
     JOIN feats f ON r.quartier_id = f.quartier_id
WHERE r.lon IS NOT NULL AND r.lat IS NOT NULL AND st.first_status IS NOT NULL""")
def m06_class_dataset(spark, d):
    """M-06: report-level class dataset without rejected reports: location, delay, encoded
    category, one-hot day and month, district features. The count of parking lots, the one feature
    that is missing where there is none, is filled with 0; then incomplete rows are dropped."""
    r = tables.reports(spark, d).where(F.col("etat") != REJECTED)
    lines = tables.report_lines(spark, d).groupBy("id_dmr").agg(F.min("date_etat_ts").alias("first_status"))
    r = r.join(lines, "id_dmr", "left").withColumn(
        "deltadays_signal_etat", dates.elapsed_days(F.col("date_input").cast("timestamp"), F.col("first_status")))
    _, r = FE.ordinal_encode(r.where("category_FR is not null"), "category_FR", "category_code")
    r = r.withColumn("dayofweek", dates.day_of_week_monday0(F.col("date_input"))).withColumn(
        "month", F.month("date_input"))
    r = FE.one_hot_drop_first(r, "dayofweek", levels=list(range(7)))
    r = FE.one_hot_drop_first(r, "month", levels=list(range(1, 13)))
    feats = district_features(spark, d).drop("name")
    out = left_join_dim(r, feats, "quartier_id")
    out = out.drop("date_input", "first_status", "etat", "category_FR", "dayofweek", "month", "code_postal_id",
                   "id_dmr", "quartier_id")
    return out.fillna(0, subset=["n_parking"]).dropna()


def daily_traffic(spark, d):
    """M-28: states counted by (day, arc), the arc's district joined, summed by (day, district)."""
    from civlens.plans.scalar_queries import EVENT_STATES

    e = rt(spark, d, "events").select(F.to_date("ts").alias("date"), "user_id", "event_type")
    states = [F.count_if(F.col("event_type") == s).alias(f"etat_trafic_{k}") for k, s in enumerate(EVENT_STATES)]
    by_arc = e.groupBy("date", "user_id").agg(*states, F.count(F.lit(1)).alias("n_states"))
    arcs = rt(spark, d, "customer").select(F.col("c_custkey").alias("user_id"),
                                           F.col("c_nationkey").cast("bigint").alias("quartier_id"))
    names = [f"etat_trafic_{k}" for k in range(len(EVENT_STATES))] + ["n_states"]
    return by_arc.join(arcs, "user_id").groupBy("date", "quartier_id").agg(*[F.sum(c).alias(c) for c in names])


_TRAFFIC_SQL = """
traffic AS (SELECT CAST(e.ts AS DATE) AS date, CAST(c.c_nationkey AS BIGINT) AS quartier_id,
       COUNT(*) FILTER (WHERE event_type = 'click') AS etat_trafic_0,
       COUNT(*) FILTER (WHERE event_type = 'error') AS etat_trafic_1,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS etat_trafic_2,
       COUNT(*) FILTER (WHERE event_type = 'signup') AS etat_trafic_3,
       COUNT(*) FILTER (WHERE event_type = 'view') AS etat_trafic_4, COUNT(*) AS n_states
     FROM events e JOIN customer c ON e.user_id = c.c_custkey GROUP BY 1, 2)"""


@register("m28_daily_traffic", with_ctes(_TRAFFIC_SQL) + """
SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date) FROM traffic""")
def m28_daily_traffic(spark, d):
    """M-28: daily traffic states per district."""
    return daily_traffic(spark, d)


COUNT_WINDOW = 7
_LEADS_SQL = ", ".join(f"LEAD(count, {k}) OVER w AS f_{k % COUNT_WINDOW}" for k in range(1, COUNT_WINDOW + 1))
_COMPLETE_SQL = " AND ".join(f"l.f_{k} IS NOT NULL" for k in range(COUNT_WINDOW))


@register("m05_count_dataset", with_ctes(R, GEOREF_SHOPS_SQL, _PARKING_SQL, _FEATURES_SQL, _TRAFFIC_SQL, f"""
dd AS (SELECT date_input AS date, quartier_id, COUNT(*) AS count FROM reports GROUP BY 1, 2),
leads AS (SELECT *, {_LEADS_SQL} FROM dd WINDOW w AS (PARTITION BY quartier_id ORDER BY date))""") + f"""
SELECT l.* REPLACE (strftime(l.date, '%Y-%m-%d') AS date), CAST(isodow(l.date) - 1 AS BIGINT) AS dayofweek,
       CAST(month(l.date) AS BIGINT) AS month, f.* EXCLUDE (quartier_id, name),
       t.* EXCLUDE (date, quartier_id)
FROM leads l LEFT JOIN feats f ON l.quartier_id = f.quartier_id
     LEFT JOIN traffic t ON l.date = t.date AND l.quartier_id = t.quartier_id
WHERE {_COMPLETE_SQL}""")
def m05_count_dataset(spark, d):
    """M-05: daily counts per district with 7 lead features, weekday, month, district features and
    the day's traffic (kept with nulls where no traffic was measured)."""
    daily = tables.reports(spark, d).groupBy(F.col("date_input").alias("date"), "quartier_id").agg(
        F.count(F.lit(1)).alias("count"))
    leads = W.lead_features(daily, "count", COUNT_WINDOW, ["date"], ["quartier_id"])
    leads = leads.withColumn("dayofweek", dates.day_of_week_monday0(F.col("date"))).withColumn("month", F.month("date"))
    out = left_join_dim(leads, district_features(spark, d).drop("name"), "quartier_id")
    return out.join(daily_traffic(spark, d), ["date", "quartier_id"], "left")


_PAIR_SQL = "list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(a.embedding, b.embedding)])"


@register("m14_knn", f"""
WITH near AS (
  SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_PAIR_SQL}, b.vec_id) AS r
  FROM embeddings a, embeddings b WHERE b.vec_id % 4 <> 0),
votes AS (
  SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY COUNT(*) DESC, label) AS r
  FROM near WHERE near.r <= 8 GROUP BY vec_id, label)
SELECT e.vec_id, CAST(e.vec_id % 4 = 0 AS BIGINT) AS is_test, CAST(e.label AS BIGINT) AS label, CAST(v.label AS BIGINT) AS predicted
FROM embeddings e JOIN votes v ON v.vec_id = e.vec_id AND v.r = 1""")
def m14_knn(spark, d):
    """M-14: k-NN classifier (k = 8): predictions for the train and the test rows."""
    e = rt(spark, d, "embeddings").select("vec_id", "embedding", "label")
    said = N.knn_classify(e.where("vec_id % 4 <> 0"), e, "vec_id", "embedding", "label", 8)
    return e.join(said, "vec_id").select("vec_id", (F.col("vec_id") % 4 == 0).alias("is_test"), "label", "predicted")


def _draw_sql(seed, what):
    return f"('0x' || substr(md5('{seed}:{what}:' || base || ':' || copy), 1, 15))::BIGINT"


@register("m13_smote", f"""
WITH sized AS (
  SELECT vec_id AS base, label, COUNT(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY {_hash_sql(9, 'vec_id')}) AS r FROM embeddings),
lack AS (SELECT *, (SELECT MAX(n) FROM sized) - n AS m FROM sized),
copies AS (
  SELECT base, label, n, unnest(generate_series(1, m // n + CAST(r <= m % n AS BIGINT))) AS copy FROM lack),
drawn AS (
  SELECT *, {_draw_sql(9, 'neighbour')} % least(5, n - 1) + 1 AS rank, {_draw_sql(9, 'share')} / 1152921504606846976.0 AS u FROM copies),
near AS (
  SELECT a.vec_id AS base, b.vec_id AS neighbour, a.embedding AS ea, b.embedding AS eb,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {_PAIR_SQL}, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT CAST(d.label AS BIGINT) AS label, d.base, CAST(d.copy AS BIGINT) AS copy, n.neighbour, round(d.u, 6) AS u,
       round(list_sum([x[3] * (x[1]::DOUBLE + x[4] * (x[2]::DOUBLE - x[1]::DOUBLE))
                       for x in list_zip(n.ea, n.eb, range(1, len(n.ea) + 1), list_resize([d.u], len(n.ea), d.u))]), 6) AS weighted_sum
FROM drawn d JOIN near n ON n.base = d.base AND n.rank = d.rank""")
def m13_smote(spark, d):
    """M-13: synthetic rows that level the classes; weighted_sum digests their vectors."""
    new = N.smote(rt(spark, d, "embeddings"), "vec_id", "embedding", "label", 5, seed=9)
    digest = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return new.select("label", "base", "copy", "neighbour", "u", digest.alias("weighted_sum"))


def _yj_sql(v, lam):
    up = f"CASE WHEN {lam} = 0 THEN ln(1 + {v}) ELSE (pow({v} + 1, {lam}) - 1) / {lam} END"
    down = f"CASE WHEN {lam} = 2 THEN -ln(1 - {v}) ELSE -(pow(1 - {v}, 2 - {lam}) - 1) / (2 - {lam}) END"
    return f"CASE WHEN {v} >= 0 THEN {up} ELSE {down} END"


_POWER_COLUMNS = ["l_extendedprice", "l_discount"]


def _power_sql():
    ctes = ["x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in _POWER_COLUMNS) + ")"]
    grid = f"SELECT c, v, unnest(generate_series({-PW.BOUND}, {PW.BOUND}, {PW.SPACINGS[0]})) AS k FROM x"
    for r, _ in enumerate(PW.SPACINGS):
        if r:
            grid = f"SELECT c, v, k + unnest(generate_series(-10, 10)) * {PW.SPACINGS[r]} AS k FROM x JOIN best{r - 1} USING (c)"
        ctes.append(f"""best{r} AS MATERIALIZED (
  SELECT c, arg_max(k, ll) AS k FROM (
    SELECT c, k, -n / 2.0 * ln(var) + (k * {PW.STEP} - 1) * s AS ll FROM (
      SELECT c, k, COUNT(v) AS n, AVG(y) AS m, AVG(y * y) AS m2, SUM(sign(v) * ln(1 + abs(v))) AS s,
             CASE WHEN isfinite(AVG(y * y)) THEN var_pop(y) FILTER (WHERE abs(y) < 1e150) END AS var
      FROM (SELECT c, v, k, {_yj_sql('v', f'(k * {PW.STEP})')} AS y FROM ({grid})) GROUP BY c, k)
    WHERE var > {PW.FLAT} * greatest(1, m * m) AND isfinite(var)) GROUP BY c)""")
    last = f"best{len(PW.SPACINGS) - 1}"
    ys = ", ".join(
        f"{_yj_sql(c, f'{c}_lam')} AS {c}_y" for c in _POWER_COLUMNS
    )
    lams = ", ".join(f"(SELECT k * {PW.STEP} FROM {last} WHERE c = '{c}') AS {c}_lam" for c in _POWER_COLUMNS)
    ctes.append(f"t AS (SELECT *, {ys} FROM (SELECT l_orderkey, l_linenumber, {', '.join(_POWER_COLUMNS)}, {lams} FROM lineitem))")
    out = ", ".join(
        f"round(({c}_y - (SELECT AVG({c}_y) FROM t)) / (SELECT stddev_pop({c}_y) FROM t), 6) AS {c}, round({c}_lam, 6) AS {c}_lambda"
        for c in _POWER_COLUMNS
    )
    return "WITH " + ",\n".join(ctes) + f"\nSELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {out} FROM t"


@register("m11_power_transform", _power_sql())
def m11_power_transform(spark, d):
    """M-11: Yeo-Johnson transform, most likely lambdas, standardised."""
    li = rt(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_POWER_COLUMNS)
    lambdas = PW.fit_lambdas(li, _POWER_COLUMNS)
    return PW.power_apply(li, li, lambdas).select("*", *[F.lit(v).alias(f"{c}_lambda") for c, v in lambdas.items()])
