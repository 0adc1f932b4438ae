"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; one JSON line. Each query is run once to warm up and then timed once, written to a sink that keeps nothing."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: bulk forms of what the published figures measure row by row
HEADLINES = ["r07_range", "r12_iter_keys", "r13_table_info", "r20_compose", "r23_compose_many", "r24_read_from", "r29_compose_many_keys", "i01_get_by_index", "i06_keys_by_dictionary", "i09_range_by", "i11_parents_by_index", "f11_many", "w01_explode", "w03_upsert", "w05_delete_cascade", "w02_store_many", "w06_remove", "w12_births", "w17_resolve", "s08_weight_batches", "s09_contiguous", "s19_validate_chain", "s28_block_weights", "c04_addresses"]


def main() -> None:
    from pyspark.sql import SparkSession

    from arborel.plans import catalog_queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog_queries.queries()
    times = {}
    for name in HEADLINES:
        for _ in range(2):
            began = time.time()
            df = found[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(m[1]) if m else None}))


if __name__ == "__main__":
    main()
