"""Benchmark: the full refresh over the driver tables plus headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line. ``value`` is the full refresh (build + persist the normalised table,
compute and write every mart, document and the validation report), the counterpart of the
reference's 58.9 s refresh. ``queries`` adds per-stage times and headline registered
queries, each executed completely (``noop`` sink, no collect).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["ministry_funding", "yearly_totals", "entity_trends_recipient", "keyword_trends",
            "document_keyword_top", "duration_histogram", "forecast_trend", "snapshot_positions",
            "conservation_checks", "joint_top", "sponsor_top"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from fundlens.session import get_session
    from fundlens.plans import refresh as R
    from fundlens.plans.params import DRIVER_PARAMS
    from fundlens.plans.registry import driver_population, registry

    spark = get_session("fundlens-bench", master=f"local[{cpus}]", shuffle_partitions=cpus * 2,
                        extra={"spark.driver.memory": "16g"})
    out_root = tempfile.mkdtemp(prefix="fundlens-bench-", dir=os.environ.get("FUNDLENS_SCRATCH", "/tmp"))
    times: dict[str, float] = {}

    # warm-up: JVM class loading and file listing, not part of any timing
    spark.read.parquet(f"{sf_dir}/orders.parquet").limit(1).collect()

    t0 = time.time()
    from fundlens.sources import tables
    run = R.run_id_now()
    out = f"{out_root}/{run}"
    tables.projects(spark, sf_dir).write.mode("overwrite").parquet(f"{out}/projects")
    times["build_projects"] = time.time() - t0
    t1 = time.time()
    pop = driver_population(spark, sf_dir)
    R.analyse_and_publish(spark, f"{out}/projects", out, DRIVER_PARAMS, pop)
    times["analyse_publish"] = time.time() - t1
    total = time.time() - t0

    qs = registry()
    for name in HEADLINE:
        t = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = time.time() - t

    print(json.dumps({"metric": "full_refresh", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()},
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
