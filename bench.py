"""Benchmark: run the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each job runs to completion through the no-op sink (no driver collect); "build" is the part of its
time that went into building the DataFrame.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w01_yearly_change",
    "a12_avg_weekly_count",
    "a02_count_ym_district_category",
    "a05_top_category_year_postcode",
    "a07_count_weekend_subcategory",
    "a33_pivot_years_total",
    "d01_convert_date_format",
    "t01_parse_soustype",
    "w05_lead_features",
    "w06_dedup_keep_last",
    "sp01_count_by_district",
    "j11_reports_join_shops",
    "sp04_parks_intersect_district",
    "a27_null_profile",
    "a30_iqr_outliers",
    "s12_infer_types",
    "m27_district_features",
    "m12_downsample",
    "a25_median_delay_days",
    "a29_describe",
    "sp08_line_length_in_district",
    "t06_fuzzy_correction",
    "c01_clean_reports",
]
#: Run once before the clock starts: starts the JVM's threads and compiles the common code.
WARM_UP = ["a13_count_by_etat", "w05_lead_features"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from civlens.plans import catalog
    from civlens.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          app="civlens-bench")
    catalog.load_all()
    for name in WARM_UP:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, build = {}, {}
    for name in HEADLINE:
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        build[name] = round(time.time() - t0, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "headline_jobs_total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "build": build, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
