"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.plans import driver_tables, headline  # noqa: E402
from tidemark.session import session  # noqa: E402


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", int(cpus), {"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    names, queries = headline.NAMES, dict(driver_tables.QUERIES)
    for name in names:  # compiles and touches the tables
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 4)
    evaluated = sum(r.rows_evaluated for r in driver_tables.dq_rule_results(spark, sf_dir).collect())
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "row_rule_evaluations_per_sec": round(evaluated / took["dq_rule_results"])}))
    spark.stop()


if __name__ == "__main__":
    main()
