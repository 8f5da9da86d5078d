"""Benchmark: run the registered queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is forced to completion with the ``noop`` sink (full execution, nothing collected) and
timed on its own. Prints one JSON line:
``{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.
``BENCH_QUERIES`` (comma-separated) restricts the set; by default every registered query runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from provenance_spark.plans import REGISTRY
    from provenance_spark.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name, q in REGISTRY.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        try:
            q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - a failing query is reported, the bench goes on
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{name}: {times.get(name, 'error')}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
