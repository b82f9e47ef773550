"""Acceptance questions about metrics, histories, lineage, executions and governance, and the validators, over the driver's tables with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance, lineage, metrics, replay, standardize, trace, validators
from . import driver_tables as base
from .driver_tables import _GOV, _HISTORY, _LIN, _M, _ONLY, RUNS, _gov, _level_sql, _narrow, evaluated, levels, read, records

#: What the questions are bound to.
RUN, RULE, ASSET, DIMENSION = "snap-1995", "ORD-VAL-001", "orders", "validity"


def ask(name: str, sql: str):
    """Register a question under a name, with its SQL."""

    def add(f):
        f.__name__ = name
        return base.query(sql)(f)

    return add


# metrics

_A = "rule_id, asset, dimension, status, rows_total, rows_evaluated, rows_not_evaluated, evaluation_ratio, violations, conforming_evaluations, violation_ratio, compliance_ratio"
_OF_RUN = "evaluations, passed_evaluations, failed_evaluations, pass_ratio, row_rule_evaluations, row_rule_violations, weighted_compliance_ratio"


def _pick(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*columns.split(", "))


@ask("metrics_of_a_run", f"{_HISTORY} SELECT {_A} FROM m WHERE run_id = '{RUN}'")
def _(spark, d):
    return _pick(evaluated(spark, d).where(F.col("run_id") == RUN), _A)


@ask("metrics_failed_rules", f"{_HISTORY} SELECT run_id, asset, rule_id, rows_evaluated, violations, compliance_ratio FROM m WHERE status = 'FAILED'")
def _(spark, d):
    return _pick(evaluated(spark, d).where("status = 'FAILED'"), "run_id, asset, rule_id, rows_evaluated, violations, compliance_ratio")


@ask("metrics_dimensions_of_a_run", f"{_HISTORY} SELECT dimension, {_OF_RUN} FROM ({_level_sql('RUN_DIMENSION')}) WHERE run_id = '{RUN}'")
def _(spark, d):
    return _pick(_narrow(levels(spark, d).where((F.col("aggregation_level") == "RUN_DIMENSION") & (F.col("run_id") == RUN))), f"dimension, {_OF_RUN}")


@ask("metrics_assets_of_a_run", f"{_HISTORY} SELECT asset, {_OF_RUN} FROM ({_level_sql('RUN_ASSET')}) WHERE run_id = '{RUN}'")
def _(spark, d):
    return _pick(_narrow(levels(spark, d).where((F.col("aggregation_level") == "RUN_ASSET") & (F.col("run_id") == RUN))), f"asset, {_OF_RUN}")


_E = "snapshot_cutoff, evaluations, distinct_rules, row_rule_evaluations, row_rule_violations, weighted_violation_ratio, weighted_compliance_ratio"


@ask("metrics_cutoff_summaries", f"{_HISTORY} SELECT {_E} FROM ({_level_sql('SNAPSHOT')})")
def _(spark, d):
    return _pick(_narrow(levels(spark, d).where("aggregation_level = 'SNAPSHOT'")), _E)


_F = "run_id, snapshot_cutoff, rule_id, status, rows_evaluated, violations, compliance_ratio"


@ask("metrics_rule_across_snapshots", f"{_HISTORY} SELECT {_F} FROM m WHERE data_zone = 'snapshot' AND rule_id = '{RULE}'")
def _(spark, d):
    return _pick(evaluated(spark, d).where((F.col("data_zone") == "snapshot") & (F.col("rule_id") == RULE)), _F)


@ask("metrics_unknown_zone", f"{_HISTORY} SELECT DISTINCT run_id, data_zone, snapshot_cutoff FROM m WHERE data_zone IS NULL")
def _(spark, d):
    return _pick(evaluated(spark, d).where("data_zone is null"), "run_id, data_zone, snapshot_cutoff").distinct()


_H = "run_id, data_zone, rule_id, status, rows_evaluated, violations, compliance_ratio"


@ask("metrics_unknown_and_trusted", f"{_HISTORY} SELECT {_H} FROM m WHERE rule_id = '{RULE}' AND (data_zone IS NULL OR data_zone = 'trusted')")
def _(spark, d):
    return _pick(evaluated(spark, d).where((F.col("rule_id") == RULE) & (F.col("data_zone").isNull() | (F.col("data_zone") == "trusted"))), _H)


# histories


def _views(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    rows = evaluated(spark, d)
    return metrics.snapshot_views(rows, metrics.aggregate(rows))


_RULE_HISTORY = "snapshot_cutoff, run_id, rule_id, asset, dimension, status, rows_total, rows_evaluated, rows_not_evaluated, evaluation_ratio, violations, conforming_evaluations, violation_ratio, compliance_ratio"


@ask("temporal_rule_history", f"{_HISTORY} SELECT {_RULE_HISTORY} FROM m WHERE {_ONLY} AND rule_id = '{RULE}'")
def _(spark, d):
    return _pick(_views(spark, d)["dq_snapshot_rule_history"].where(F.col("rule_id") == RULE), _RULE_HISTORY)


@ask("temporal_asset_history", f"{_HISTORY} SELECT snapshot_cutoff, run_id, asset, {_M} FROM ({_level_sql('RUN_ASSET')}) WHERE {_ONLY} AND asset = '{ASSET}'")
def _(spark, d):
    return _narrow(_views(spark, d)["dq_snapshot_asset_history"].where(F.col("asset") == ASSET))


@ask("temporal_dimension_history", f"{_HISTORY} SELECT snapshot_cutoff, run_id, dimension, {_M} FROM ({_level_sql('RUN_DIMENSION')}) WHERE {_ONLY} AND dimension = '{DIMENSION}'")
def _(spark, d):
    return _narrow(_views(spark, d)["dq_snapshot_dimension_history"].where(F.col("dimension") == DIMENSION))


@ask("temporal_summaries", f"{_HISTORY} SELECT snapshot_cutoff, run_id, {_M} FROM ({_level_sql('RUN')}) WHERE {_ONLY}")
def _(spark, d):
    return _narrow(_views(spark, d)["dq_snapshot_evaluation_summary"])


_POPULATION = "snapshot_cutoff, run_id, rows_evaluated, violations, compliance_ratio, status"


@ask("temporal_changing_population", f"{_HISTORY} SELECT {_POPULATION} FROM m WHERE {_ONLY} AND rule_id = 'CUS-VAL-001'")
def _(spark, d):
    return _pick(_views(spark, d)["dq_snapshot_rule_history"].where("rule_id = 'CUS-VAL-001'"), _POPULATION)


@ask("temporal_violations_of_a_rule", f"{_HISTORY} SELECT {_POPULATION}, violation_ratio FROM m WHERE {_ONLY} AND rule_id = 'ORD-UNI-001'")
def _(spark, d):
    return _pick(_views(spark, d)["dq_snapshot_rule_history"].where("rule_id = 'ORD-UNI-001'"), f"{_POPULATION}, violation_ratio")


# lineage


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = base.metadata(spark, d)
    return lineage.nodes(*m), lineage.edges(*m)


def _bound(spark: SparkSession, d: str):
    """The column of one rule; a question is bound to it."""
    return base.metadata(spark, d)[1].where("rule_id = 'RUL-0'").first()


_ENDS = "e JOIN n s ON s.node_id = source_node_id JOIN n t ON t.node_id = target_node_id LEFT JOIN n p ON p.node_id = context_node_id"
_SCOPE = "(SELECT asset, column_name FROM r WHERE rule_id = 'RUL-0')"


@ask("lineage_around_a_column", f"{_LIN} SELECT edge_category, edge_type, s.node_id AS source, t.node_id AS target, context_node_id, p.semantic_id AS policy_id FROM {_ENDS} JOIN {_SCOPE} b ON s.asset = b.asset AND (s.node_type = 'asset' OR s.column_name = b.column_name)")
def _(spark, d):
    b = _bound(spark, d)
    return lineage.around_column(*_graph(spark, d), b.asset, b.column_name)


@ask("lineage_rules_of_a_column", f"{_LIN} SELECT DISTINCT t.semantic_id AS rule_id FROM {_ENDS} JOIN {_SCOPE} b ON s.asset = b.asset AND s.column_name = b.column_name WHERE edge_type = 'evaluated_by'")
def _(spark, d):
    b = _bound(spark, d)
    return lineage.rules_of_column(*_graph(spark, d), b.asset, b.column_name)


@ask("lineage_transformed_columns", f"{_LIN} SELECT s.asset, s.column_name, s.zone AS source_zone, t.zone AS target_zone, p.semantic_id AS policy_id FROM {_ENDS} WHERE edge_type = 'transformed_by' AND p.node_id IS NOT NULL")
def _(spark, d):
    return lineage.transformed_columns(*_graph(spark, d))


@ask("lineage_snapshot_flows", f"{_LIN} SELECT s.asset, s.zone AS source_zone, t.zone AS target_zone FROM {_ENDS} WHERE edge_type = 'replayed_to'")
def _(spark, d):
    return lineage.snapshot_flows(*_graph(spark, d))


@ask("lineage_references_of_an_asset", f"{_LIN} SELECT s.node_id AS source, t.node_id AS target FROM {_ENDS} WHERE edge_type = 'references' AND 'NATION 2' IN (s.asset, t.asset)")
def _(spark, d):
    return lineage.references_of(*_graph(spark, d), "NATION 2")


@ask("lineage_evidence_of_edges", f"{_LIN} SELECT edge_id, edge_category, edge_type, evidence FROM e")
def _(spark, d):
    return _pick(_graph(spark, d)[1], "edge_id, edge_category, edge_type, evidence")


def _checks_sql(name: str, parts: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"constraint\", ({q}) AS violations" for c, q in parts)


def broken_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph with faults: nodes of one asset lack it, some edges have a wrong category, end or context."""
    n, e = _graph(spark, d)
    n = n.withColumn("asset", F.when(F.col("asset") == "NATION 1", F.lit("")).otherwise(F.col("asset"))).withColumn("zone", F.when((F.col("node_type") == "asset") & (F.col("asset") == "NATION 4") & (F.col("zone") == "raw"), "lake").otherwise(F.col("zone")))
    e = e.withColumn("edge_category", F.when(F.col("source_node_id") == "asset:raw:NATION%202", "NONE").otherwise(F.col("edge_category")))
    return n, e.withColumn("context_node_id", F.when(F.col("edge_type") == "references", "policy:none").otherwise(F.col("context_node_id")))


_BROKEN = f"""{_LIN}, bn AS (SELECT * REPLACE (CASE WHEN asset = 'NATION 1' THEN '' ELSE asset END AS asset, CASE WHEN node_type = 'asset' AND asset = 'NATION 4' AND zone = 'raw' THEN 'lake' ELSE zone END AS zone) FROM n),
    be AS (SELECT * REPLACE (CASE WHEN source_node_id = 'asset:raw:NATION%202' THEN 'NONE' ELSE edge_category END AS edge_category, CASE WHEN edge_type = 'references' THEN 'policy:none' ELSE context_node_id END AS context_node_id) FROM e),
    j AS (SELECT be.*, s.node_type AS s_type, s.zone AS s_zone, s.asset AS s_asset, s.column_name AS s_column, t.node_type AS t_type, t.zone AS t_zone, t.asset AS t_asset, t.column_name AS t_column, c.node_type AS c_type, c.asset AS c_asset, c.column_name AS c_column
        FROM be LEFT JOIN bn s ON s.node_id = source_node_id LEFT JOIN bn t ON t.node_id = target_node_id LEFT JOIN bn c ON c.node_id = context_node_id)"""
_GRAPH_SQL = [
    ("node: an asset or column without asset", "SELECT count(*) FROM bn WHERE node_type IN ('asset', 'column') AND coalesce(trim(asset), '') = ''"),
    ("node: unknown zone", "SELECT count(*) FROM bn WHERE (node_type = 'asset' AND coalesce(zone, '') NOT IN ('source', 'raw', 'trusted', 'snapshot')) OR (node_type = 'column' AND coalesce(zone, '') NOT IN ('source', 'raw', 'trusted', 'snapshot', 'logical'))"),
    ("edge: an end is no node", "SELECT count(*) FROM j WHERE s_type IS NULL OR t_type IS NULL"),
    ("edge: type and category disagree", "SELECT count(*) FROM j WHERE edge_category IS DISTINCT FROM CASE edge_type WHEN 'transformed_by' THEN 'TRANSFORMATION' WHEN 'evaluated_by' THEN 'EVALUATION' WHEN 'references' THEN 'DATA_RELATIONSHIP' ELSE 'DATA_FLOW' END"),
    ("edge: a flow between other assets or zones", "SELECT count(*) FROM j WHERE edge_type IN ('ingested_to', 'published_to', 'replayed_to') AND NOT coalesce((edge_type, s_zone, t_zone) IN (('ingested_to', 'source', 'raw'), ('published_to', 'raw', 'trusted'), ('replayed_to', 'trusted', 'snapshot')) AND s_type = 'asset' AND t_type = 'asset' AND s_asset = t_asset, false)"),
    ("edge: a transformation of another scope than its policy", "SELECT count(*) FROM j WHERE edge_type = 'transformed_by' AND NOT coalesce(c_type = 'standardization_policy' AND s_zone = 'raw' AND t_zone = 'trusted' AND s_asset = t_asset AND s_column = t_column AND s_asset = c_asset AND s_column = c_column, false)"),
    ("edge: an evaluation of another column than its rule", "SELECT count(*) FROM j WHERE edge_type = 'evaluated_by' AND NOT coalesce(s_type = 'column' AND s_zone IN ('raw', 'trusted', 'snapshot') AND t_type = 'dq_rule' AND s_asset = t_asset AND s_column = t_column, false)"),
    ("edge: context without transformation", "SELECT count(*) FROM j WHERE edge_type <> 'transformed_by' AND context_node_id IS NOT NULL"),
]


@ask("lineage_graph_violations", f"{_BROKEN} {_checks_sql('graph', _GRAPH_SQL)}")
def _(spark, d):
    return validators.graph_checks(*broken_graph(spark, d)).where(F.col("constraint").isin([c for c, _ in _GRAPH_SQL]))


@ask("lineage_graph_is_valid", f"{_LIN} SELECT 0::BIGINT AS violations, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def _(spark, d):
    n, e = _graph(spark, d)
    total = validators.graph_checks(n, e).agg(F.sum("violations").alias("violations"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return total.crossJoin(count(n, "nodes")).crossJoin(count(e, "edges"))  # one row each


# executions

_AT = "2026-01-01 00:00:00"
#: Executions of three kinds: run, process, zone, cutoff, hours after the first; the replay of 1998 is there twice.
EXECUTIONS = [*((r, "dq", z, c, k) for k, (r, z, c) in enumerate(RUNS)), ("std-1", "standardization", None, None, 20), *((f"replay-{y}{s}", "replay", "trusted", f"{y}-12-31", 30 + k) for k, (y, s) in enumerate([(1993, ""), (1995, ""), (1998, ""), (1998, "-b")]))]


def execution_runs(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(EXECUTIONS, "run_id string, process_type string, data_zone string, cutoff string, hours int")
    began = F.lit(_AT).cast("timestamp_ntz") + F.expr("make_dt_interval(0, hours)")
    path = lambda process, x: F.when(F.col("process_type") == process, x)
    return rows.select(
        "run_id", "process_type", F.lit("SUCCESS").alias("status"), began.alias("started_at"), (began + F.expr("make_dt_interval(0, 0, 5)")).alias("completed_at"), "data_zone", F.col("cutoff").cast("date").alias("snapshot_cutoff"),
        path("dq", F.concat(F.lit("data/"), "data_zone")).alias("source_path"), path("replay", F.concat(F.lit("data/snapshots/"), "cutoff")).alias("output_path"), F.concat(F.lit("data/results/"), "process_type", F.lit("/"), "run_id", F.lit(".json")).alias("execution_record_path"),
    )


def execution_details(spark: SparkSession, d: str) -> DataFrame:
    """Details of the executions: rules, policies and replayed assets, as their records hold them."""
    policies = standardize.policy_metrics(standardize.changes(read(spark, d, "customer"), base.POLICIES))
    item = F.struct("policy_id", F.lit("customer").alias("asset"), F.lit("c_name").alias("column"), F.lit("regex_replace").alias("transformation_type"), "rows_total", "rows_evaluated", "rows_changed", "rows_unchanged")
    std = policies.agg(F.collect_list(item).alias("policy_results")).withColumn("run_id", F.lit("std-1"))
    parts = [trace.details(records(spark, d), "dq"), trace.details(std, "standardization")]
    # rows of two assets up to each cutoff, in one pass over each
    for asset, day in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        runs = [(r, c) for r, p, _, c, _ in EXECUTIONS if p == "replay"]
        n = read(spark, d, asset).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(day).cast("date") <= F.lit(c).cast("date")).alias(f"n{k}") for k, (_, c) in enumerate(runs)])
        rows = [F.struct(F.lit(r).alias("run_id"), F.array(F.struct(F.lit(asset).alias("asset"), F.lit("temporal").alias("strategy"), F.col("n").alias("input_rows"), F.col(f"n{k}").alias("output_rows"))).alias("assets")) for k, (r, _) in enumerate(runs)]
        parts.append(trace.details(n.select(F.inline(F.array(*rows))), "replay"))
    return base._union(parts)


_X = "(VALUES " + ", ".join(f"('{r}', '{p}', {'NULL' if z is None else repr(z)}, {'NULL' if c is None else repr(c)}, {h})" for r, p, z, c, h in EXECUTIONS) + ") v(run_id, process_type, data_zone, cutoff, hours)"
_XRUNS = f"""SELECT run_id, process_type, 'SUCCESS' AS status, TIMESTAMP '{_AT}' + to_hours(hours) AS started_at, TIMESTAMP '{_AT}' + to_hours(hours) + to_minutes(5) AS completed_at, data_zone::VARCHAR AS data_zone, cutoff::DATE AS snapshot_cutoff,
    CASE WHEN process_type = 'dq' THEN 'data/' || data_zone END AS source_path, CASE WHEN process_type = 'replay' THEN 'data/snapshots/' || cutoff END AS output_path, 'data/results/' || process_type || '/' || run_id || '.json' AS execution_record_path FROM {_X}"""


@ask("trace_chronology", f"SELECT run_id, process_type, status, started_at, completed_at FROM ({_XRUNS})")
def _(spark, d):
    return _pick(execution_runs(spark), "run_id, process_type, status, started_at, completed_at")


@ask("trace_zones_and_cutoffs", f"SELECT run_id, data_zone, snapshot_cutoff, source_path FROM ({_XRUNS}) WHERE process_type = 'dq'")
def _(spark, d):
    return _pick(execution_runs(spark).where("process_type = 'dq'"), "run_id, data_zone, snapshot_cutoff, source_path")


@ask("trace_failed_rules_of_a_run", f"{_HISTORY} SELECT rule_id, asset, CASE rule_id WHEN 'ORD-VAL-001' THEN 'o_orderpriority' WHEN 'CUS-VAL-001' THEN 'c_name' ELSE 'o_orderkey' END AS column_name, violations, compliance_ratio FROM m WHERE status = 'FAILED' AND run_id = '{RUN}'")
def _(spark, d):
    x = execution_details(spark, d).where((F.col("detail_type") == "DQ_RULE") & (F.col("status") == "FAILED") & (F.col("run_id") == RUN))
    return x.select(F.col("semantic_id").alias("rule_id"), "asset", "column_name", "violations", "compliance_ratio")


@ask("trace_changing_policies", f"{base._CHANGES} SELECT 'std-1' AS run_id, policy_id, 'customer' AS asset, 'c_name' AS column_name, count(*) FILTER (before IS DISTINCT FROM after) AS rows_changed FROM c GROUP BY policy_id HAVING rows_changed > 0")
def _(spark, d):
    x = execution_details(spark, d).where("detail_type = 'STANDARDIZATION_POLICY' and rows_changed > 0")
    return x.select("run_id", F.col("semantic_id").alias("policy_id"), "asset", "column_name", "rows_changed")


@ask("trace_replayed_rows", f"""WITH x AS ({_XRUNS}) SELECT run_id, snapshot_cutoff, 'orders' AS asset, (SELECT count(*) FROM orders) AS input_rows, (SELECT count(*) FROM orders WHERE o_orderdate::DATE <= snapshot_cutoff) AS output_rows FROM x WHERE process_type = 'replay'
    UNION ALL SELECT run_id, snapshot_cutoff, 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_shipdate::DATE <= snapshot_cutoff) FROM x WHERE process_type = 'replay'""")
def _(spark, d):
    x = execution_details(spark, d).where("detail_type = 'REPLAY_ASSET'").select("run_id", "asset", "input_rows", "output_rows")
    return execution_runs(spark).select("run_id", "snapshot_cutoff").join(x, "run_id").select("run_id", "snapshot_cutoff", "asset", "input_rows", "output_rows")


@ask("trace_replays_of_a_cutoff", f"SELECT run_id, snapshot_cutoff, output_path FROM ({_XRUNS}) WHERE process_type = 'replay' AND snapshot_cutoff = DATE '1998-12-31'")
def _(spark, d):
    return _pick(execution_runs(spark).where("process_type = 'replay' and snapshot_cutoff = date '1998-12-31'"), "run_id, snapshot_cutoff, output_path")


@ask("trace_unknown_zone", f"SELECT run_id, data_zone, source_path, snapshot_cutoff, execution_record_path FROM ({_XRUNS}) WHERE process_type = 'dq' AND data_zone IS NULL")
def _(spark, d):
    return _pick(execution_runs(spark).where("process_type = 'dq' and data_zone is null"), "run_id, data_zone, source_path, snapshot_cutoff, execution_record_path")


@ask("trace_runs_and_rules", f"{_HISTORY}, x AS ({_XRUNS}) SELECT run_id, process_type, x.snapshot_cutoff, count(*) AS rules, sum(violations)::BIGINT AS violations FROM x JOIN m USING (run_id) GROUP BY ALL")
def _(spark, d):
    x = execution_details(spark, d).where("detail_type = 'DQ_RULE'").select("run_id", "violations")
    return execution_runs(spark).join(x, "run_id").groupBy("run_id", "process_type", "snapshot_cutoff").agg(F.count(F.lit(1)).alias("rules"), F.sum("violations").alias("violations"))


# governance


@ask("governance_issues", f"{_GOV} SELECT issue_id, asset, column_name, rule_id, status FROM i")
def _(spark, d):
    return _pick(_gov(spark, d)[0], "issue_id, asset, column_name, rule_id, status")


@ask("governance_open_issues", f"{_GOV} SELECT issue_id, asset, column_name, status FROM i WHERE status = 'OPEN'")
def _(spark, d):
    return _pick(_gov(spark, d)[0].where("status = 'OPEN'"), "issue_id, asset, column_name, status")


@ask("governance_decisions_of_issues", f"{_GOV} SELECT issue_id, decision_id, decision_type, d.status, policy_id FROM i JOIN d USING (issue_id)")
def _(spark, d):
    return governance.decisions_of_issues(*_gov(spark, d)[:2])


@ask("governance_evidence_of_an_issue", f"{_GOV} SELECT e.* FROM e WHERE (parent_type = 'ISSUE' AND parent_id = 'GOV-ISS-003') OR (parent_type = 'DECISION' AND EXISTS (SELECT 1 FROM d WHERE decision_id = parent_id AND issue_id = 'GOV-ISS-003'))")
def _(spark, d):
    return governance.evidence_of_issue(*_gov(spark, d)[1:], "GOV-ISS-003")


@ask("governance_without_policy", f"{_GOV} SELECT issue_id, asset, column_name FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.issue_id = i.issue_id AND decision_type = 'REMEDIATION_AUTHORIZED' AND policy_id IS NOT NULL)")
def _(spark, d):
    return governance.without_policy(*_gov(spark, d)[:2])


@ask("governance_withheld", f"{_GOV} SELECT decision_id, issue_id, status, policy_id FROM d WHERE decision_type = 'REMEDIATION_WITHHELD'")
def _(spark, d):
    return governance.withheld(_gov(spark, d)[1])


@ask("governance_actors", f"{_GOV} SELECT decision_id, actor, decision_date FROM d")
def _(spark, d):
    return _pick(_gov(spark, d)[1], "decision_id, actor, decision_date")


@ask("governance_rule_and_policy", f"""{_GOV} SELECT i.issue_id, i.rule_id, d.policy_id AS authorized_policy_id, evidence_id, evidence_type, path, run_id, e.rule_id AS evidence_rule_id, e.policy_id AS evidence_policy_id FROM i JOIN d USING (issue_id)
    JOIN e ON (parent_type = 'ISSUE' AND parent_id = i.issue_id) OR (parent_type = 'DECISION' AND parent_id = decision_id) WHERE i.rule_id = 'RUL-0' AND d.policy_id = 'POL-0'""")
def _(spark, d):
    return governance.rule_and_policy_evidence(*_gov(spark, d), "RUL-0", "POL-0")


# validators of runs and evaluations, over tables with faults

_FAULTY = "SELECT CASE WHEN o_orderkey % 1000 = 7 THEN '' ELSE concat('R', o_orderkey % 500) END AS rule_id, concat('run-', o_orderkey % 40) AS run_id, 'orders' AS asset, 'validity' AS dimension, CASE o_orderkey % 9 WHEN 0 THEN 'PASSED' WHEN 1 THEN 'DONE' ELSE 'FAILED' END AS status, cast(o_orderkey % 90 + 1 AS BIGINT) AS rows_total, cast(o_orderkey % 50 AS BIGINT) AS rows_evaluated, cast(o_orderkey % 6 - 1 AS BIGINT) AS violations, CASE WHEN o_orderkey % 50 > 0 THEN cast(o_orderkey % 50 - (o_orderkey % 6 - 1) AS DOUBLE) / cast(o_orderkey % 50 AS DOUBLE) + CASE WHEN o_orderkey % 11 = 0 THEN 0.25 ELSE 0 END END AS compliance_ratio FROM {orders}"
_FAULTY_RUNS = "SELECT concat('run-', n_nationkey % 24) AS run_id, TIMESTAMP '2026-01-01 00:00:00' AS started_at, CASE n_nationkey % 5 WHEN 0 THEN 'snapshot' WHEN 1 THEN 'lake' WHEN 2 THEN 'raw' END AS data_zone, CASE WHEN n_nationkey % 4 = 0 THEN DATE '1995-12-31' END AS snapshot_cutoff FROM {nation}"
_EVALUATION_SQL = [
    ("run: blank or unknown zone", "SELECT count(*) FROM q WHERE data_zone NOT IN ('raw', 'trusted', 'snapshot')"),
    ("run: a snapshot without cutoff, or a cutoff elsewhere", "SELECT count(*) FROM q WHERE (coalesce(data_zone, '') = 'snapshot') <> (snapshot_cutoff IS NOT NULL)"),
    ("run: run_id twice", "SELECT count(*) FROM (SELECT run_id FROM q GROUP BY 1 HAVING count(*) > 1)"),
    ("result: rule, asset or dimension is blank", "SELECT count(*) FROM f WHERE trim(rule_id) = ''"),
    ("result: unknown status", "SELECT count(*) FROM f WHERE status NOT IN ('PASSED', 'FAILED')"),
    ("result: a count is missing or negative", "SELECT count(*) FROM f WHERE least(rows_total, rows_evaluated, violations) < 0"),
    ("result: violations, evaluated and total rows are out of order", "SELECT count(*) FROM f WHERE rows_evaluated > rows_total OR violations > rows_evaluated"),
    ("result: status and violations disagree", "SELECT count(*) FROM f WHERE (status = 'PASSED') <> (violations = 0)"),
    ("result: ratio is no number from 0 to 1", "SELECT count(*) FROM f WHERE compliance_ratio NOT BETWEEN 0 AND 1"),
    ("result: ratio without evaluated rows", "SELECT count(*) FROM f WHERE rows_evaluated = 0 AND compliance_ratio IS NOT NULL"),
    ("result: ratio differs from its counts", "SELECT count(*) FROM f WHERE rows_evaluated > 0 AND (compliance_ratio IS NULL OR abs(compliance_ratio - (rows_evaluated - violations)::DOUBLE / rows_evaluated) > 1e-12)"),
    ("result: rule twice in a run", "SELECT count(*) FROM (SELECT 1 FROM f GROUP BY run_id, rule_id HAVING count(*) > 1)"),
    ("result: unknown run", "SELECT count(*) FROM f WHERE run_id NOT IN (SELECT run_id FROM q)"),
]
_FAULTS = f"WITH f AS ({_FAULTY.format(orders='orders')}), q AS ({_FAULTY_RUNS.format(nation='nation')})"


def _faulty(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spark.sql(_FAULTY_RUNS, nation=read(spark, d, "nation")), spark.sql(_FAULTY, orders=read(spark, d, "orders"))


@ask("evaluation_violations", f"{_FAULTS} {_checks_sql('evaluations', _EVALUATION_SQL)}")
def _(spark, d):
    return validators.evaluation_checks(*_faulty(spark, d)).where(F.col("constraint").isin([c for c, _ in _EVALUATION_SQL]))


_ENDED = "CASE WHEN k % 11 = 3 THEN '2026-01-01T00:00:00+05:00' ELSE '2026-01-01T00:00:00.500000Z' END"
_CUT = "CASE k % 8 WHEN 0 THEN '1995-12-31' WHEN 1 THEN '1995-13-31' WHEN 2 THEN '95-12-31' END"
_RECORD_SQL = [
    ("record: unknown status", "SELECT count(*) FROM h WHERE status NOT IN ('SUCCESS', 'FAILED')"),
    ("record: it ends before it starts", "SELECT count(*) FROM h WHERE k % 11 = 3"),
    ("record: negative or missing duration", "SELECT count(*) FROM h WHERE elapsed_seconds IS NULL OR elapsed_seconds < 0"),
    ("record: zone without path, or path without zone", "SELECT count(*) FROM h WHERE (data_zone IS NULL) <> (data_path IS NULL)"),
    ("record: unknown zone", "SELECT count(*) FROM h WHERE data_zone NOT IN ('raw', 'trusted', 'snapshot')"),
    ("record: a snapshot without cutoff", "SELECT count(*) FROM h WHERE data_zone = 'snapshot' AND snapshot_cutoff IS NULL"),
    ("record: a cutoff outside a snapshot", "SELECT count(*) FROM h WHERE snapshot_cutoff IS NOT NULL AND coalesce(data_zone, '') <> 'snapshot'"),
    ("record: cutoff is no ISO date", "SELECT count(*) FROM h WHERE snapshot_cutoff IS NOT NULL AND (NOT regexp_full_match(snapshot_cutoff, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR TRY_CAST(snapshot_cutoff AS DATE) IS NULL)"),
    ("record: counts of a successful run differ from its results", "SELECT count(*) FROM h WHERE status = 'SUCCESS' AND (rules_total <> n OR rules_passed <> ok OR rules_failed <> n - ok)"),
    ("record: a rule twice", "SELECT count(*) FROM h WHERE ids <> n"),
    ("record: run_id twice", "SELECT count(*) FROM (SELECT 1 FROM h GROUP BY run_id HAVING count(*) > 1)"),
]
_HEADS = """SELECT c_custkey AS k, concat('run-', c_custkey % 1200) AS run_id, CASE c_custkey % 7 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN c_custkey % 13 > 0 THEN cast(c_custkey % 13 - 2 AS DOUBLE) END AS elapsed_seconds,
    CASE c_custkey % 5 WHEN 0 THEN 'snapshot' WHEN 1 THEN 'lake' WHEN 2 THEN 'raw' END AS data_zone, CASE WHEN c_custkey % 3 > 0 THEN 'data/x' END AS data_path, cast(c_custkey % 6 AS BIGINT) AS rules_total, cast(c_custkey % 3 AS BIGINT) AS rules_passed, cast(c_custkey % 6 - c_custkey % 3 AS BIGINT) AS rules_failed FROM {customer}"""
_RECORDS = f"""WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS ok, count(DISTINCT o_orderpriority) AS ids FROM orders GROUP BY 1),
    h AS (SELECT z.*, {_CUT} AS snapshot_cutoff, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, coalesce(ids, 0) AS ids FROM ({_HEADS.format(customer='customer')}) z LEFT JOIN o ON o_custkey = k)"""


@ask("record_violations", f"{_RECORDS} {_checks_sql('records', _RECORD_SQL)}")
def _(spark, d):
    item = F.struct(F.col("o_orderpriority").alias("rule_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "PASSED").otherwise("FAILED").alias("status"))
    some = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(item).alias("rule_results"))
    h = spark.sql(_HEADS, customer=read(spark, d, "customer")).join(some, "k", "left")
    h = h.withColumns({"rule_results": F.coalesce("rule_results", F.array().cast("array<struct<rule_id:string,status:string>>")), "snapshot_cutoff": F.expr(_CUT), "started_at": F.lit("2026-01-01T00:00:00Z"), "completed_at": F.expr(_ENDED), "execution_errors": F.array().cast("array<string>")})
    return validators.run_checks(h).where(F.col("constraint").isin([c for c, _ in _RECORD_SQL]))


@ask("contract_violations", "SELECT 'tidemark.plans.stages:no_such_stage is not there' AS fault UNION ALL SELECT 'tidemark.plans.stages:ZONES has another value'")
def _(spark, d):
    found = validators.contract_errors((*validators.CONTRACTS, ("tidemark.plans.stages", "no_such_stage", None), ("tidemark.plans.stages", "ZONES", ("raw",))))
    return spark.createDataFrame([(x,) for x in found], "fault string")
