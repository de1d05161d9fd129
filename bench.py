"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is planned and fully executed (``write.format("noop")`` forces
every row through the plan without collecting it on the driver); the time is
the best of ``BENCH_REPEATS`` runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.registry import QUERIES, load_all  # noqa: E402
from quarry.session import get_spark  # noqa: E402

# Headline queries: one per operator family (filters with relation subqueries,
# includes, paging, group/having, upsert, profile, payload normalisation, the
# full ingest and what it maintains).
HEADLINE = (
    "g4_g8_group_having_lineitem",
    "w26_w28_to_many_some_none_every",
    "j2_include_to_many_lineitems",
    "l6_find_many_composed_orders",
    "m3_p8_n6_upsert_part_shifted_keys",
    "g13_profile_part",
    "p1_store_records_part",
    "e1_full_ingest_entities",
    "e1_j5_review_rows",
    "m15_g11_developer_counters_after_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    only = os.environ.get("BENCH_QUERIES")
    load_all()
    names = [n for n in (only.split(",") if only else HEADLINE) if n in QUERIES]
    spark = get_spark(f"local[{cpus}]", app="quarry-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    times: dict[str, float] = {}
    for name in names:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        best = None
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
