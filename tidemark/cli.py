"""python -m tidemark.cli STAGE [options]; exit code 0 if the stage succeeded."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .plans import stages
from .session import session

LAYERS = {"lineage": stages.lineage_tables, "traceability": stages.traces, "observability": stages.history, "metrics": stages.metric_tables, "governance": stages.governance_tables, "reporting": stages.report_tables}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--root", default=".")
    s = p.add_subparsers(dest="stage", required=True)
    s.add_parser("ingestion").add_argument("--source", required=True)
    demo = s.add_parser("demo")
    demo.add_argument("--source", required=True)
    demo.add_argument("--years", type=int, nargs="+", default=list(range(1993, 1999)))
    s.add_parser("profiling").add_argument("--raw")
    dq = s.add_parser("dq")
    dq.add_argument("--data-zone", default="raw")
    dq.add_argument("--data-path")
    dq.add_argument("--snapshot-cutoff")
    s.add_parser("replay").add_argument("--cutoff", required=True)
    for name in ("catalog", "standardization", *LAYERS):
        s.add_parser(name)
    a = p.parse_args(args)
    project, spark = stages.Project(Path(a.root)), session()
    if a.stage in LAYERS:
        try:
            out = stages.publish_layer(project, a.stage, LAYERS[a.stage](spark, project), stages.KEYS if a.stage == "reporting" else None)
        except (ValueError, OSError) as e:
            out = {"status": "FAILED", "errors": [str(e)]}
    elif a.stage == "demo":
        done = stages.demo(spark, project, a.source, tuple(a.years))
        for name, record in done:
            print(name, record["status"])
        out = done[-1][1]
    else:
        out = {
            "ingestion": lambda: stages.ingest(project, a.source), "profiling": lambda: stages.profile(spark, project, a.raw), "catalog": lambda: stages.check_catalog(project), "dq": lambda: stages.check_quality(spark, project, a.data_zone, a.data_path, a.snapshot_cutoff),
            "standardization": lambda: stages.standardize_zone(spark, project), "replay": lambda: stages.snapshot_at(spark, project, a.cutoff),
        }[a.stage]()
    print(a.stage, out["status"], *out.get("errors", ()), *out.get("execution_errors", ()))
    return int(out["status"] != "SUCCESS")


if __name__ == "__main__":
    sys.exit(main())
