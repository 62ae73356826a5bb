"""Benchmark the headline queries.

/root/testdata/sf0.1) on ``local[$BENCH_CPUS]``: one warm-up, best of
``$BENCH_REPS`` (default 3), results sunk to the ``noop`` writer (full
execution, no output cost). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
# the Python workers import the package, too
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    os.environ.setdefault("QUARRY_MASTER", f"local[{cpus}]")

    from quarry.plans.registry import HEADLINE, QUERIES, load_all
    from quarry.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", partitions=cpus)
    load_all()
    names = only or list(HEADLINE)
    timings: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        best = None
        for i in range(reps + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:  # the first run is the warm-up
                best = dt if best is None else min(best, dt)
        timings[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_best_of_%d" % reps,
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
