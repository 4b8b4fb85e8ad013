"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   folder with the tables      (default /root/testdata/sf0.1)
BENCH_CPUS     local cores                 (default 8)
BENCH_QUERIES  comma-separated names       (default: the headline list below)

Every query is built and run whole (noop sink, so all columns are computed),
twice; the second run counts, so that JVM warm-up is not measured.
"""

from __future__ import annotations

import json
import os
import re
import time

import pyarrow.parquet as pq

from deskline.session import build_session
from registered.queries import all_queries

# Query -> the table whose rows it processes.
HEADLINE = {
    "accuracy_metrics": "events",
    "category_distribution": "events",
    "api_distribution": "events",
    "overview": "events",
    "accuracy_trend": "events",
    "list_page": "events",
    "page_totals": "events",
    "ticket_by_id": "events",
    "intake_texts": "documents",
    "memo_keys": "documents",
    "support_keywords": "documents",
    "keyword_classify": "documents",
    "answers_repaired": "documents",
    "similar_topk": "embeddings",
    "similar_asof": "embeddings",
    "prompt_context": "embeddings",
    "vector_upsert": "embeddings",
    "corrections_applied": "lineitem",
    "feedback_log": "lineitem",
    "cascade_delete": "lineitem",
    "memo_hits": "events",
    "memo_lookup": "events",
    "classify_end_to_end": "documents",
    "stream_intake": "documents",
    "stream_memo": "events",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    names = chosen.split(",") if chosen else list(HEADLINE)
    seconds: dict[str, float] = {}
    rates: dict[str, int] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        if name in HEADLINE:
            rows = pq.read_metadata(f"{folder}/{HEADLINE[name]}.parquet").num_rows
            rates[name] = int(rows / seconds[name])
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": rates,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
