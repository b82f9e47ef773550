"""Rule, standardization and metric semantics on small frames, and every query against its SQL."""

import datetime
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.functions.expressions import full_match, java_replacement, node_id, node_text, short_date
from tidemark.operators import constraints, metrics, rules, standardize
from tidemark.operators.rules import Rule
from tidemark.plans import driver_tables

SF = "/root/testdata/sf0.001"


def judge(spark, found, **rule):
    df = spark.createDataFrame([(v,) for v in found], "value string")
    ref = spark.createDataFrame([("A",), ("B",)], "id string")
    r = Rule("R", "alpha", "value", "validity", **rule)
    out = rules.rule_results({"alpha": df, "reference": ref}, [r]).first()
    first = [x.value for x in rules.samples({"alpha": df, "reference": ref}, [r]).orderBy("rank").collect()]
    return out.status, out.rows_total, out.rows_evaluated, out.violations, out.compliance_ratio, first


@pytest.mark.parametrize("values, rule, want", [
    (["A", "C"], {"kind": "allowed_values", "values": ("A", "B")}, ("FAILED", 2, 2, 1, 0.5, ["C"])),
    (["A", ""], {"kind": "allowed_values", "values": ("A", "B"), "empty_policy": "ignore"}, ("PASSED", 2, 1, 0, 1.0, [])),
    (["A", None], {"kind": "allowed_values", "values": ("A",), "empty_policy": "ignore"}, ("FAILED", 2, 2, 1, 0.5, ["<PARSER_NULL>"])),
    (["240101", "2024-01", " 240101", "240101\n"], {"kind": "regex_format", "pattern": r"^\d{6}$"}, ("FAILED", 4, 4, 3, 0.25, [" 240101", "2024-01", "240101\n"])),
    (["A", "A", "B", None, None], {"kind": "unique"}, ("FAILED", 5, 5, 4, 0.2, ["<PARSER_NULL>", "A"])),
    (["A", "C", None], {"kind": "reference_exists", "target": ("reference", "id")}, ("FAILED", 3, 3, 2, 1 / 3, ["<PARSER_NULL>", "C"])),
    ([], {"kind": "unique"}, ("PASSED", 0, 0, 0, None, [])),
    ([], {"kind": "regex_format", "pattern": "x"}, ("PASSED", 0, 0, 0, None, [])),
])
def test_rule_semantics(spark, values, rule, want):
    assert judge(spark, values, **rule) == want


def test_policies_apply_in_order(spark):
    df = spark.createDataFrame([("931107 00:00:00",), ("x931107 00:00:00",), ("٩٣١١٠٧ 00:00:00",), (None,)], "v string")
    ps = [standardize.Policy("P1", "a", "v", r"^(\d{6}) 00:00:00$", r"\1"), standardize.Policy("P2", "a", "v", r"(9)(\d+)", r"$\g<2>-\1")]
    assert [r.v for r in standardize.standardize(df, ps).collect()] == ["$31107-9", "x931107 00:00:00", "٩٣١١٠٧", None]
    assert java_replacement(r"a\1$") == r"a$1\$"
    m = {r.policy_id: (r.rows_total, r.rows_changed) for r in standardize.policy_metrics(standardize.changes(df, ps)).collect()}
    assert m == {"P1": (4, 2), "P2": (4, 1)}


def test_dates_and_identities(spark):
    df = spark.createDataFrame([("931231",), ("000101",), ("940230",), ("93123",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(short_date(F.col("v"))).collect()] == [datetime.date(1993, 12, 31), datetime.date(1900, 1, 1), None, None, None, None]
    odd = "a b/c~d*é:+%"
    assert spark.range(1).select(node_id("column", F.lit("raw"), F.lit(odd))).first()[0] == node_text("column", "raw", odd)
    assert not spark.range(1).select(full_match(F.lit("a\n"), "^a$")).first()[0]


def test_levels_and_wide_sums(spark):
    rows = [(run, rule, zone, cut, a, d, "PASSED" if v == 0 else "FAILED", 10, e, v) for run, zone, cut in (("legacy", None, None), ("trusted", "trusted", None), ("snap", "snapshot", "1998-12-31")) for rule, a, d, e, v in (("CAR", "card", "validity", 8, 2), ("LOA", "loan", "uniqueness", 10, 0))]
    df = spark.createDataFrame(rows, "run_id string, rule_id string, data_zone string, cutoff string, asset string, dimension string, status string, rows_total long, rows_evaluated long, violations long").withColumns({"snapshot_cutoff": F.to_date("cutoff"), "conforming_evaluations": F.expr("rows_evaluated - violations")})
    got = metrics.aggregate(df)
    assert dict(got.groupBy("aggregation_level").count().collect()) == {"RUN": 3, "RUN_ASSET": 6, "RUN_DIMENSION": 6, "SNAPSHOT": 1, "SNAPSHOT_ASSET": 2, "SNAPSHOT_DIMENSION": 2}
    top = got.where("aggregation_level = 'SNAPSHOT'").first()
    assert (top.run_id, top.data_zone, top.evaluations, top.pass_ratio, int(top.row_rule_evaluations), top.weighted_violation_ratio) == (None, "snapshot", 2, 0.5, 18, 2 / 18)
    big = df.withColumn("rows_evaluated", F.lit(2**62)).withColumn("conforming_evaluations", F.lit(0).cast("long"))
    assert int(metrics.aggregate(big).where("aggregation_level = 'RUN'").first().row_rule_evaluations) == 2**63
    e = metrics.evaluations(spark.createDataFrame([("r", None, None, None)], "run_id string, started_at timestamp_ntz, data_zone string, snapshot_cutoff date"), spark.createDataFrame([("r", "q", "a", "c", "d", "t", "p", "PASSED", 0, 0, 0, None)], "run_id string, rule_id string, asset string, column_name string, dimension string, expectation_type string, empty_policy string, status string, rows_total long, rows_evaluated long, violations long, compliance_ratio double")).first()
    assert (e.evaluation_ratio, e.violation_ratio, e.rows_not_evaluated) == (None, None, 0)


def test_constraints(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    n = lambda df: df.first().violations
    assert n(constraints.duplicate_grain(a, ["k", "v"], "g")) == 1 and n(constraints.null_keys(a, ["k"], "n")) == 1 and n(constraints.foreign_key(a, "k", b, "k", "f")) == 1
    assert n(constraints.scope_mismatch(a, b, "k", ["v"], "s")) == 0 and constraints.round_trip(a, b).count() == 4
    with pytest.raises(ValueError, match="g: 1"):
        constraints.require_none(constraints.duplicate_grain(a, ["k", "v"], "g"))


def test_queries_equal_their_sql(spark):
    import duckdb

    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    key = lambda r: [(x is None, str(x)) for x in r]
    names = ["dq_rule_results", "dq_samples", "profile_table", "standardize_sample_changes", "replay_counts", "metrics_all_levels", "view_rule_history", "trace_details", "lineage_edges", "gov_evidence_or_join", "report_fk_violations"]
    for name in names:
        df, want = driver_tables.QUERIES[name](spark, SF), db.sql(driver_tables.SQL[name])
        cols = sorted(df.columns)
        assert cols == sorted(want.columns), name
        rows = sorted(([value(r[c]) for c in cols] for r in df.collect()), key=key)
        assert rows == sorted(([value(r[want.columns.index(c)]) for c in cols] for r in want.fetchall()), key=key), name


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import importlib

    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "tidemark.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "dq_rule_results" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    sys.modules.pop("__spark_entry__", None)
