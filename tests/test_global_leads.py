"""Leads over the whole table equal a window without partitions, whatever the ranges hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from civlens.operators import windows as W

STEPS = {"f_1": 1, "f_2": 2, "f_0": 5}


def both(df, order, ranges):
    w = Window.orderBy(*order)
    want = df.select("*", *[F.lead("v", i).over(w).alias(n) for n, i in STEPS.items()])
    got = W.global_leads(df, "v", STEPS, order, ranges)
    assert got.columns == want.columns
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    return rows(got), rows(want), got


@pytest.mark.parametrize("ranges", [2, 64])
@pytest.mark.parametrize("n", [0, 4, 300])
def test_equal_a_global_window(spark, n, ranges):
    rng = random.Random(n)
    rows = [(rng.randint(0, max(1, n // 3)) if rng.random() < 0.9 else None, k, rng.randint(0, 99)) for k in range(n)]
    got, want, _ = both(spark.createDataFrame(rows, "k long, id long, v long").repartition(3), ["k", "id"], ranges)
    assert got == want


def test_tiny_ranges_around_a_hot_value(spark):
    rows = [(50, k, k) for k in range(600)] + [(k, 1000 + k, -k) for k in range(100)]
    got, want, _ = both(spark.createDataFrame(rows, "k long, id long, v long"), ["k", "id"], 90)
    assert got == want


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "double"])
def test_kinds_of_order_columns(spark, kind):
    day = dt.date(2020, 1, 1)
    rows = [(k % 50 / 7 if kind == "double" else (day + dt.timedelta(days=k % 50)).isoformat(), k, k * k % 31) for k in range(300)]
    df = spark.createDataFrame(rows, "k double, id long, v long" if kind == "double" else "k string, id long, v long")
    got, want, _ = both(df.withColumn("k", F.col("k").cast(kind)), ["k", "id"], 16)
    assert got == want


def test_text_is_refused_and_no_window_holds_all_rows(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    with pytest.raises(TypeError):
        W.global_leads(df, "v", STEPS, ["k"])
    df = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("v"))
    plan = W.lead_features(df, "v", 3, ["k"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line and "lead(" in line]
    assert windows and all("[__to" in line or "__range" in line for line in windows)
    assert "Exchange SinglePartition" not in "".join(line for line in plan.splitlines() if "__place" in line)
