"""Checks of what was recorded or derived before anything builds on it.

Tables are checked by DataFrames of (constraint, violations): all conditions on the
rows of one table are one aggregate, conditions between tables are anti joins. A
record, an evidence file and the code registry are single documents and are checked
on the driver.
"""

from __future__ import annotations

import importlib
import json
import math
from datetime import date, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constraints import duplicate_grain, foreign_key
from .lineage import CATEGORIES, FLOWS

#: Zones of data, statuses of runs and of rules, texts that a rule's result has.
ZONES, RUN_STATUS, RULE_STATUS = ("raw", "trusted", "snapshot"), ("SUCCESS", "FAILED"), ("PASSED", "FAILED")
RESULT_TEXTS = ("rule_id", "asset", "column", "dimension", "expectation_type", "empty_policy", "status")
RESULT_COUNTS = ("rows_total", "rows_evaluated", "violations")
RATIO_ERROR = 1e-12


def counted(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """constraint, violations: rows that meet each condition, in one pass. A condition that is null is not met."""
    names = list(conditions)
    rows = [F.struct(F.lit(n).alias("constraint"), F.col(f"n{k}").alias("violations")) for k, n in enumerate(names)]
    return df.agg(*[F.count_if(conditions[n]).alias(f"n{k}") for k, n in enumerate(names)]).select(F.inline(F.array(*rows)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def result_conditions() -> dict[str, Column]:
    """What may be wrong with one rule's result."""
    t, e, v, r = (F.col(c) for c in (*RESULT_COUNTS, "compliance_ratio"))
    expected = (e - v).cast("double") / e
    return {
        "result: rule, asset or dimension is blank": blank("rule_id") | blank("asset") | blank("dimension"),
        "result: unknown status": F.coalesce(~F.col("status").isin(*RULE_STATUS), F.lit(True)),
        "result: a count is missing or negative": t.isNull() | e.isNull() | v.isNull() | (t < 0) | (e < 0) | (v < 0),
        "result: violations, evaluated and total rows are out of order": (e > t) | (v > e),
        "result: status and violations disagree": (F.col("status") == "PASSED") != (v == 0),
        "result: ratio is no number from 0 to 1": r.isNotNull() & (F.isnan(r) | ~r.between(0, 1)),
        "result: ratio without evaluated rows": (e == 0) & r.isNotNull(),
        "result: ratio differs from its counts": (e > 0) & (r.isNull() | (F.abs(r - F.when(e != 0, expected)) > RATIO_ERROR)),
    }


def evaluation_checks(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs (run_id, started_at, data_zone, snapshot_cutoff) and results of rules in them."""
    zone, cutoff = F.col("data_zone"), F.col("snapshot_cutoff")
    heads = {
        "run: blank run_id": blank("run_id"), "run: no start": F.col("started_at").isNull(), "run: blank or unknown zone": zone.isNotNull() & ~zone.isin(*ZONES),
        "run: a snapshot without cutoff, or a cutoff elsewhere": (F.coalesce(zone, F.lit("")) == "snapshot") != cutoff.isNotNull(),
    }
    return _union([
        counted(runs, heads), duplicate_grain(runs, ["run_id"], "run: run_id twice"), counted(results, result_conditions()),
        duplicate_grain(results, ["run_id", "rule_id"], "result: rule twice in a run"), foreign_key(results, "run_id", runs, "run_id", "result: unknown run"),
    ])


def run_checks(records: DataFrame) -> DataFrame:
    """Quality runs as records (run_id, status, started_at, completed_at, elapsed_seconds, data_zone, data_path, snapshot_cutoff, rules_total, rules_passed, rules_failed, execution_errors, rule_results); times are ISO text with any offset."""
    began, ended = F.try_to_timestamp("started_at"), F.try_to_timestamp("completed_at")
    n, ok = F.size("rule_results"), F.size(F.filter("rule_results", lambda x: x["status"] == "PASSED"))
    zone, cutoff = F.col("data_zone"), F.col("snapshot_cutoff")
    nothing = (F.col("status") == "FAILED") & (n == 0) & (F.col("rules_total") == 0) & (F.size("execution_errors") > 0)
    heads = {
        "record: blank run_id": blank("run_id"), "record: unknown status": F.coalesce(~F.col("status").isin(*RUN_STATUS), F.lit(True)),
        "record: a time is no timestamp": began.isNull() | ended.isNull(), "record: it ends before it starts": ended < began,
        "record: negative or missing duration": F.coalesce((F.col("elapsed_seconds") < 0) | F.isnan("elapsed_seconds"), F.lit(True)),
        "record: zone without path, or path without zone": (zone.isNull() != F.col("data_path").isNull()) & ~(nothing & (zone == "snapshot")), "record: unknown zone": zone.isNotNull() & ~zone.isin(*ZONES),
        "record: a snapshot without cutoff": (zone == "snapshot") & cutoff.isNull() & ~nothing, "record: a cutoff outside a snapshot": cutoff.isNotNull() & (F.coalesce(zone, F.lit("")) != "snapshot"),
        "record: cutoff is no ISO date": cutoff.isNotNull() & (~cutoff.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") | F.try_to_date(cutoff, "yyyy-MM-dd").isNull()),
        "record: counts of a successful run differ from its results": (F.col("status") == "SUCCESS") & ((F.col("rules_total") != n) | (F.col("rules_passed") != ok) | (F.col("rules_failed") != n - ok)),
        "record: a rule twice": F.size(F.array_distinct(F.transform("rule_results", lambda x: x["rule_id"]))) != n,
    }
    return _union([counted(records, heads), duplicate_grain(records, ["run_id"], "record: run_id twice")])


def graph_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A lineage graph: kinds, zones and identities of nodes; ends, context, scope and evidence of edges."""
    kind, zone = F.col("node_type"), F.col("zone")
    places = F.coalesce(zone.isin("source", *ZONES), F.lit(False))
    of_nodes = {
        "node: unknown type": F.coalesce(~kind.isin("asset", "column", "dq_rule", "standardization_policy"), F.lit(True)),
        "node: an asset or column without asset": kind.isin("asset", "column") & blank("asset"),
        "node: unknown zone": ((kind == "asset") & ~places) | ((kind == "column") & ~(places | F.coalesce(zone == "logical", F.lit(False)))),
        "node: a column without name": (kind == "column") & blank("column_name"),
        "node: a rule or policy in a zone, or without identity": kind.isin("dq_rule", "standardization_policy") & (zone.isNotNull() | blank("semantic_id")),
    }
    facts = ("node_type", "zone", "asset", "column_name")
    end = lambda p, key: nodes.select(F.col("node_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in facts])
    joined = edges.join(end("s", "source_node_id"), "source_node_id", "left").join(end("t", "target_node_id"), "target_node_id", "left").join(end("c", "context_node_id"), "context_node_id", "left")
    c = F.col
    same = lambda a, b: c(f"{a}_asset").eqNullSafe(c(f"{b}_asset")) & c(f"{a}_column_name").eqNullSafe(c(f"{b}_column_name"))
    is_ = lambda p, what: F.coalesce(c(f"{p}_node_type") == what, F.lit(False))
    at = lambda p, *z: F.coalesce(c(f"{p}_zone").isin(*z), F.lit(False))
    edge = c("edge_type")
    flow = reduce(lambda x, y: x | y, [(edge == k) & at("s", a) & at("t", b) for a, b, k in FLOWS])
    category = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[edge]
    of_edges = {
        "edge: an end is no node": c("s_node_type").isNull() | c("t_node_type").isNull(),
        "edge: type and category disagree": ~category.eqNullSafe(c("edge_category")),
        "edge: a flow between other assets or zones": edge.isin(*[k for *_, k in FLOWS]) & ~(flow & is_("s", "asset") & is_("t", "asset") & c("s_asset").eqNullSafe(c("t_asset"))),
        "edge: a transformation of another scope than its policy": (edge == "transformed_by") & ~(is_("c", "standardization_policy") & is_("s", "column") & is_("t", "column") & at("s", "raw") & at("t", "trusted") & same("s", "t") & same("s", "c")),
        "edge: an evaluation of another column than its rule": (edge == "evaluated_by") & ~(is_("s", "column") & at("s", *ZONES) & is_("t", "dq_rule") & same("s", "t")),
        "edge: a reference between other than logical columns": (edge == "references") & ~(is_("s", "column") & is_("t", "column") & at("s", "logical") & at("t", "logical")),
        "edge: context without transformation": (edge != "transformed_by") & c("context_node_id").isNotNull(),
        "edge: no evidence": F.coalesce(c("evidence").isin("", "[]"), F.lit(True)),
    }
    return _union([counted(nodes, of_nodes), duplicate_grain(nodes, ["node_id"], "node: identity twice"), counted(joined, of_edges), duplicate_grain(edges, ["edge_id"], "edge: identity twice")])


def instant(text: object) -> datetime:
    """An ISO time with its offset; without one it is UTC."""
    from datetime import UTC

    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def _count(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def _number(x: object) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def record_errors(r: object, process: str) -> list[str]:
    """What is wrong with one run record."""
    if not isinstance(r, dict):
        return ["it is no object"]
    bad = [f"{k} is missing or blank" for k in ("run_id", "started_at", "completed_at", "status") if not isinstance(r.get(k), str) or not r[k].strip()]
    if bad:
        return bad
    if r["status"] not in RUN_STATUS:
        bad.append(f"unknown status {r['status']}")
    try:
        if instant(r["completed_at"]) < instant(r["started_at"]):
            bad.append("it ends before it starts")
    except ValueError as e:
        bad.append(f"a time is no timestamp: {e}")
    if not _number(r.get("elapsed_seconds")) or r["elapsed_seconds"] < 0:
        bad.append("elapsed_seconds is no duration")
    return bad + (_quality_errors(r) if process == "dq" and not bad else [])


def _quality_errors(r: dict) -> list[str]:
    results, faults = r.get("rule_results"), r.get("execution_errors")
    if not isinstance(results, list) or not isinstance(faults, list):
        return ["rule_results and execution_errors are lists"]
    if not all(_count(r.get(k)) for k in ("rules_total", "rules_passed", "rules_failed")):
        return ["a count of rules is no count"]
    bad, zone, cutoff = [], r.get("data_zone"), r.get("snapshot_cutoff")
    early = r["status"] == "FAILED" and not results and faults and not (r["rules_total"] or r["rules_passed"] or r["rules_failed"])
    if ("data_zone" in r) != ("data_path" in r):
        bad.append("zone and path belong together")
    elif "data_zone" in r and not early:
        if zone not in ZONES:
            bad.append(f"unknown zone {zone}")
        if not isinstance(r["data_path"], str) or not r["data_path"].strip():
            bad.append("data_path is blank")
    if zone == "snapshot":
        try:
            if (cutoff is not None or not early) and date.fromisoformat(cutoff).isoformat() != cutoff:
                raise ValueError
        except (TypeError, ValueError):
            bad.append("a snapshot needs a cutoff in ISO form")
    elif cutoff is not None and not early:
        bad.append("only a snapshot has a cutoff")
    for k, x in enumerate(results):
        bad += [f"rule_results[{k}]: {what}" for what in _result_errors(x)]
    if bad:
        return bad
    if len({x["rule_id"] for x in results}) != len(results):
        bad.append("a rule is there twice")
    passed = sum(x["status"] == "PASSED" for x in results)
    if r["status"] == "SUCCESS" and (r["rules_total"], r["rules_passed"], r["rules_failed"]) != (len(results), passed, len(results) - passed):
        bad.append("counts of rules differ from the results")
    return bad


def _result_errors(x: object) -> list[str]:
    if not isinstance(x, dict):
        return ["no object"]
    bad = [f"{k} is missing or blank" for k in RESULT_TEXTS if not isinstance(x.get(k), str) or not x[k].strip()]
    bad += [f"{k} is no count" for k in RESULT_COUNTS if not _count(x.get(k))]
    samples = x.get("sample_violations", [])
    if not isinstance(samples, list) or not all(isinstance(v, str) for v in samples):
        bad.append("sample_violations is no list of texts")
    if bad:
        return bad
    t, e, v, share = (x.get(k) for k in (*RESULT_COUNTS, "compliance_ratio"))
    if x["status"] not in RULE_STATUS:
        bad.append(f"unknown status {x['status']}")
    if not t >= e >= v:
        bad.append("counts are out of order")
    if share is not None and (not _number(share) or not 0 <= share <= 1):
        bad.append("the ratio is no number from 0 to 1")
    elif (share is None) != (e == 0) or e and abs(share - (e - v) / e) > RATIO_ERROR:
        bad.append("the ratio differs from its counts")
    return bad


#: What the lineage takes for granted of the code: module, name, and the value that a constant must have.
CONTRACTS = (
    ("tidemark.plans.stages", "ingest", None), ("tidemark.plans.stages", "standardize_zone", None), ("tidemark.plans.stages", "snapshot_at", None),
    ("tidemark.plans.stages", "check_quality", None), ("tidemark.plans.stages", "ZONES", ZONES), ("tidemark.operators.rules", "rule_results", None), ("tidemark.operators.standardize", "standardize", None),
)


def contract_errors(contracts=CONTRACTS) -> list[str]:
    """Contracts that the code does not keep."""
    bad = []
    for module, name, value in contracts:
        try:
            there = getattr(importlib.import_module(module), name)
        except (ImportError, AttributeError):
            bad.append(f"{module}:{name} is not there")
            continue
        if value is not None and tuple(there) != tuple(value):
            bad.append(f"{module}:{name} has another value")
    return bad


def require_contracts(contracts=CONTRACTS) -> None:
    if bad := contract_errors(contracts):
        raise ValueError("; ".join(bad))


def evidence_errors(path: Path, reference: dict, scope: dict) -> list[str]:
    """Does a run record that is named as evidence hold the run, rule or policy of the reference, in the issue's scope?"""
    if path.suffix != ".json":
        return []
    try:
        r = json.loads(path.read_text(encoding="utf-8"))
    except (UnicodeError, json.JSONDecodeError) as e:
        return [f"evidence {path.name} is no record: {e}"]
    if not isinstance(r, dict):
        return [f"evidence {path.name} is no record"]
    bad = []
    if reference.get("run_id") is not None and r.get("run_id") != reference["run_id"]:
        bad.append(f"evidence {path.name} is another run than {reference['run_id']}")
    for key, array in (("rule_id", "rule_results"), ("policy_id", "policy_results")):
        wanted = reference.get(key)
        if wanted is None:
            continue
        if scope.get(key) not in (None, wanted):
            bad.append(f"evidence names {wanted}, its parent {scope[key]}")
        found = [x for x in r.get(array) or () if x.get(key) == wanted]
        if len(found) != 1:
            bad.append(f"evidence {path.name} has {len(found)} results of {wanted}")
        elif (found[0].get("asset"), found[0].get("column")) != (scope["asset"], scope["column"]):
            bad.append(f"evidence {path.name}: {wanted} has another scope")
    return bad
