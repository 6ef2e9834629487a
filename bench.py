"""Time the headline queries on the benchmark tables and print one JSON line.

BENCH_SF_DIR  folder of parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from cloakframe.queries import QUERIES

HEADLINE = (
    "detect_all redact_email redact_all anonymize_text anonymize_payload mapping_rows restore_by_id restore_payload "
    "round_trip fuzzy_hits fuzzy_redact dict_exact detect_gazetteer mapping_lru asof_latest_mapping ttl_interval_join "
    "agg_by_type agg_profile_compare leaves_variant stream_redact stream_restore"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cloakframe-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", os.environ.get("SPARK_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    n_docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    QUERIES["redact_all"](spark, folder).limit(1).collect()  # start-up cost is not a query's
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rates = {q: round(n_docs / seconds[q], 1) for q in ("detect_all", "redact_all", "restore_by_id", "fuzzy_hits")}
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "documents_per_second": rates,
                "sf": os.path.basename(os.path.normpath(folder)),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
