"""Benchmark the headline query keys.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built and fully executed (``noop`` sink, so the whole plan runs without
collecting to the driver). After one warm-up pass over all keys (at the smallest driver scale
next to ``$BENCH_SF_DIR`` when present: JVM code generation and Python workers are warm), each
key is timed ``$BENCH_REPEAT`` times (default 3) and the median is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "page_split", "embed_pages", "retrieve_topk", "chat_retrieve", "chat_context", "chat_answer",
    "new_chunks", "page_window", "collection_text", "extract_topics", "generate_level_1",
    "generate_level_2", "instruct_open", "merge_instruct",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    os.environ["BENCH_CPUS"] = str(cpus)
    from folio.plans.queries import QUERIES
    from folio.session import get_session
    spark = get_session(master=f"local[{cpus}]", app="folio-bench")
    keys = sys.argv[1:] or HEADLINE
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    warm_dir = small if os.path.isdir(small) else sf_dir
    for k in keys:
        QUERIES[k](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        runs = []
        for _ in range(repeat):
            spark.catalog.clearCache()
            t0 = time.perf_counter()
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[k] = round(sorted(runs)[len(runs) // 2], 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))


if __name__ == "__main__":
    main()
