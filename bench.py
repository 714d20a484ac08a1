"""Benchmark: wall time of the headline queries, one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run once to warm up and once for the record; the result is fully
computed into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = (
    "e1_strict_daily_flux", "e8_weighted_mean", "e15_distribution", "e16_percentile_blocks", "e21_binned_events",
    "e30_histogram2d", "f2_signed_loss", "f7_disappearance", "f16_flagged_log", "d8_nearest_cells",
    "d10_polygon_weights", "d11_center_mask", "d12_regrid", "q1_decomposition", "q3_cell_accumulation",
    "q5_station_annual", "q6_energy", "q7_timing_linkage", "q8_streamflow", "q9_multiplicative",
    "q10_observation_qc", "q12_band_statistics", "q13_separation_daily", "q16_spatial_daily",
    "q17_model_year_summary", "q20_climatology_suite", "q21_additional_forcing", "e20_spearman",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from nivalgrid.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total_wall_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
