"""Validators of records, evaluations, graphs, contracts and evidence, and the key families of quality rules."""

import copy
import json

import pytest

from tidemark.operators import rules, validators
from tidemark.operators.rules import Rule
from tidemark.plans import stages

RESULT = {"rule_id": "R1", "asset": "a", "column": "c", "dimension": "validity", "expectation_type": "unique", "empty_policy": "evaluate", "status": "FAILED", "rows_total": 10, "rows_evaluated": 8, "violations": 2, "compliance_ratio": 0.75, "sample_violations": ["x"]}
RECORD = {"run_id": "r", "status": "SUCCESS", "started_at": "2026-01-01T00:00:00Z", "completed_at": "2026-01-01T00:00:00.500000Z", "elapsed_seconds": 0.5, "rules_total": 1, "rules_passed": 0, "rules_failed": 1, "execution_errors": [], "rule_results": [RESULT], "data_zone": "snapshot", "data_path": "d", "snapshot_cutoff": "1995-12-31"}


def changed(result=None, **fields):
    r = copy.deepcopy(RECORD) | fields
    if result:
        r["rule_results"][0] |= result
    return r


def test_good_records():
    assert validators.record_errors(RECORD, "dq") == []
    early = changed(status="FAILED", rules_total=0, rules_failed=0, rule_results=[], execution_errors=["no path"], data_path=None, snapshot_cutoff=None)
    assert validators.record_errors(early, "dq") == []
    legacy = {k: v for k, v in RECORD.items() if not k.startswith("data_")} | {"snapshot_cutoff": None}
    assert validators.record_errors(legacy, "dq") == []
    assert validators.record_errors(changed(completed_at="2026-01-01T05:00:01+05:00"), "dq") == []


@pytest.mark.parametrize("bad", [
    [], changed(run_id=" "), changed(status="DONE"), changed(completed_at="2026-01-01T04:00:00+05:00"), changed(started_at="yesterday"), changed(elapsed_seconds=-1), changed(elapsed_seconds=float("nan")), changed(rules_total=2), changed(rules_passed=True),
    changed(execution_errors=None), changed(data_zone="lake"), changed(data_path=" "), changed(snapshot_cutoff="1995-2-1"), changed(snapshot_cutoff=None), changed(data_zone="raw"), changed(rule_results=[RESULT, RESULT], rules_total=2, rules_failed=2), {k: v for k, v in RECORD.items() if k != "data_path"},
    changed({"status": "WARN"}), changed({"violations": 9}), changed({"rows_total": 1.5}), changed({"compliance_ratio": 0.7}), changed({"compliance_ratio": None}), changed({"sample_violations": [1]}), changed({"asset": ""}),
], ids=range(24))
def test_bad_records(bad):
    assert validators.record_errors(bad, "dq")


def test_evidence_of_a_run_is_opened(tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps(RECORD))
    scope = {"asset": "a", "column": "c", "rule_id": "R1"}
    assert validators.evidence_errors(path, {"run_id": "r", "rule_id": "R1"}, scope) == []
    for ref, of in (({"run_id": "s"}, scope), ({"rule_id": "R2"}, {**scope, "rule_id": None}), ({"rule_id": "R1"}, {**scope, "column": "d"}), ({"rule_id": "R1"}, {**scope, "rule_id": "R3"}), ({"policy_id": "P"}, scope)):
        assert validators.evidence_errors(path, ref, of)
    path.write_text("[")
    assert validators.evidence_errors(path, {}, scope)


def test_contracts_hold():
    assert validators.contract_errors() == []
    with pytest.raises(ValueError, match="no_such"):
        validators.require_contracts([("tidemark.plans.stages", "no_such", None)])


def test_a_missing_layer_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="publish metrics first"):
        stages.published(spark, stages.Project(tmp_path), "metrics", "dq_evaluation_metrics")
    with pytest.raises(FileNotFoundError, match="relationships"):
        stages.preflight(stages.Project(tmp_path), tmp_path / "none")


def test_families_of_keys(spark):
    tables = {"a": spark.createDataFrame([(1,), (1,), (2,), (None,), (9,)], "k int"), "b": spark.createDataFrame([("1",), ("2",), ("",), ("3",)], "k string"), "c": spark.createDataFrame([(2.0,), (2.0,)], "k double")}
    some = [Rule("U-A", "a", "k", "uniqueness", "unique"), Rule("A-B", "a", "k", "referential_integrity", "reference_exists", target=("b", "k")), Rule("B-A", "b", "k", "referential_integrity", "reference_exists", target=("a", "k"), empty_policy="ignore"), Rule("U-C", "c", "k", "uniqueness", "unique")]
    assert [len(f.rules) for f in rules.families(some)] == [3, 1]
    got = {r.rule_id: (r.rows_total, r.rows_evaluated, r.violations) for r in rules.rule_results(tables, some).collect()}
    assert got == {"U-A": (5, 5, 2), "A-B": (5, 5, 2), "B-A": (4, 3, 1), "U-C": (2, 2, 2)}
    first = sorted((r.rule_id, r.rank, r.value) for r in rules.samples(tables, some).collect())
    assert first == [("A-B", 1, "<PARSER_NULL>"), ("A-B", 2, "9"), ("B-A", 1, "3"), ("U-A", 1, "1"), ("U-C", 1, "2.0")]
