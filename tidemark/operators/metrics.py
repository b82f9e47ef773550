"""Evaluation metrics, six aggregation levels in one pass, and snapshot views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ratio

#: Levels, and whether run, asset and dimension are grouped; measures of a level; columns of an evaluation.
LEVELS = {"RUN": (1, 0, 0), "RUN_ASSET": (1, 1, 0), "RUN_DIMENSION": (1, 0, 1), "SNAPSHOT": (0, 0, 0), "SNAPSHOT_ASSET": (0, 1, 0), "SNAPSHOT_DIMENSION": (0, 0, 1)}
MEASURES = ["evaluations", "distinct_rules", "passed_evaluations", "failed_evaluations", "pass_ratio", "row_rule_evaluations", "row_rule_violations", "row_rule_conforming", "weighted_violation_ratio", "weighted_compliance_ratio"]
EVALUATION = ["run_id", "rule_id", "started_at", "data_zone", "snapshot_cutoff", "asset", "column_name", "dimension", "expectation_type", "empty_policy", "status", "rows_total", "rows_evaluated", "rows_not_evaluated", "evaluation_ratio", "violations", "conforming_evaluations", "violation_ratio", "compliance_ratio"]


def evaluations(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Results of runs with derived counts and ratios (null over zero)."""
    t, e, v = F.col("rows_total"), F.col("rows_evaluated"), F.col("violations")
    joined = results.join(runs.select("run_id", "started_at", "data_zone", "snapshot_cutoff"), "run_id")
    return joined.withColumns({"rows_not_evaluated": t - e, "evaluation_ratio": ratio(e, t), "conforming_evaluations": e - v, "violation_ratio": ratio(v, e)}).select(*EVALUATION)


def aggregate(rows: DataFrame) -> DataFrame:
    """All six levels by grouping sets; snapshot levels count snapshot evaluations only. Levels are told by grouping_id, since a run's zone and cutoff may be null."""
    snap = F.when((F.col("data_zone") == "snapshot") & F.col("snapshot_cutoff").isNotNull(), F.col("snapshot_cutoff"))
    exact = lambda c: f"sum(cast({c} as decimal(38,0)))"
    out = rows.sparkSession.sql(f"""
        SELECT grouping_id(run_id, data_zone, snapshot_cutoff, snap, asset, dimension) AS g, run_id, data_zone, snapshot_cutoff, snap, asset, dimension,
            count(*) AS evaluations, count(DISTINCT rule_id) AS distinct_rules, count_if(status = 'PASSED') AS passed_evaluations, count_if(status = 'FAILED') AS failed_evaluations,
            {exact("rows_evaluated")} AS row_rule_evaluations, {exact("violations")} AS row_rule_violations, {exact("conforming_evaluations")} AS row_rule_conforming
        FROM {{evaluations}}
        GROUP BY run_id, data_zone, snapshot_cutoff, snap, asset, dimension GROUPING SETS ((run_id, data_zone, snapshot_cutoff), (run_id, data_zone, snapshot_cutoff, asset), (run_id, data_zone, snapshot_cutoff, dimension), (snap), (snap, asset), (snap, dimension))""", evaluations=rows.withColumn("snap", snap))
    bits = {name: (0b000100 if run else 0b111000) | (0 if asset else 2) | (0 if dimension else 1) for name, (run, asset, dimension) in LEVELS.items()}
    level = F.coalesce(*[F.when(F.col("g") == b, F.lit(name)) for name, b in bits.items()])
    out = out.withColumn("aggregation_level", level).where("snap is not null or aggregation_level like 'RUN%'")
    is_snap = F.col("aggregation_level").startswith("SNAPSHOT")
    return out.select(
        "aggregation_level", "run_id", F.when(is_snap, "snapshot").otherwise(F.col("data_zone")).alias("data_zone"), F.when(is_snap, F.col("snap")).otherwise(F.col("snapshot_cutoff")).alias("snapshot_cutoff"), "asset", "dimension",
        "evaluations", "distinct_rules", "passed_evaluations", "failed_evaluations", ratio(F.col("passed_evaluations"), F.col("evaluations")).alias("pass_ratio"),
        "row_rule_evaluations", "row_rule_violations", "row_rule_conforming", ratio(F.col("row_rule_violations"), F.col("row_rule_evaluations")).alias("weighted_violation_ratio"), ratio(F.col("row_rule_conforming"), F.col("row_rule_evaluations")).alias("weighted_compliance_ratio"),
    )


def snapshot_views(rows: DataFrame, levels: DataFrame) -> dict[str, DataFrame]:
    """Four histories over snapshot runs; no deltas or trends, on purpose."""
    only = "data_zone = 'snapshot' and snapshot_cutoff is not null"
    names = ["snapshot_cutoff", "run_id", "started_at", "rule_id"]
    views = {"dq_snapshot_rule_history": rows.where(only).select(*names, *[c for c in EVALUATION if c not in names and c != "data_zone"])}
    for name, level, scope in (("dq_snapshot_asset_history", "RUN_ASSET", ["asset"]), ("dq_snapshot_dimension_history", "RUN_DIMENSION", ["dimension"]), ("dq_snapshot_evaluation_summary", "RUN", [])):
        views[name] = levels.where(only).where(F.col("aggregation_level") == level).select("snapshot_cutoff", "run_id", *scope, *MEASURES)
    return views
