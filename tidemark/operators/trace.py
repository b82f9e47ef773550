"""Execution evidence: runs, metrics and details projected from run records of several processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import identity

#: Per process: explicit metrics; the array of details, its kind and its identity. Fixed values.
METRICS = {"ingestion": ("files_expected", "files_processed"), "dq": ("rules_total", "rules_passed", "rules_failed"), "standardization": ("policies_total", "policies_applied", "assets_total", "assets_copied", "assets_transformed"), "replay": ()}
DETAILS = {"ingestion": ("files", "INGESTION_FILE", "file_name"), "dq": ("rule_results", "DQ_RULE", "rule_id"), "standardization": ("policy_results", "STANDARDIZATION_POLICY", "policy_id"), "replay": ("assets", "REPLAY_ASSET", "asset")}


def metrics(records: DataFrame, process: str) -> DataFrame:
    """run_id, metric_name, metric_value of the explicit numbers that a record has."""
    names = [n for n in METRICS[process] if n in records.columns]
    if not names:
        return records.sparkSession.createDataFrame([], "run_id string, metric_name string, metric_value double")
    pairs = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("metric_value")) for n in names])
    return records.select("run_id", F.inline(pairs)).where("metric_value is not null")


def attributes(**values: Column) -> Column:
    """Canonical JSON of the values that are there, by name."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(values.items())]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def text(value: Column) -> Column:
    """A string as JSON text; null stays null."""
    return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1))


def details(records: DataFrame, process: str) -> DataFrame:
    """One row per element of a process's array, with typed columns and the rest as canonical JSON."""
    array, kind, key = DETAILS[process]
    item = records.select("run_id", F.explode(array).alias("i"))
    have = set(item.schema["i"].dataType.names)
    get = lambda name, kind="string": F.col(f"i.{name}").cast(kind) if name in have else F.lit(None).cast(kind)
    number = lambda name: get(name).cast("string")
    extra = {
        "ingestion": {"expected_sha256": text(get("expected_sha256")), "actual_sha256": text(get("actual_sha256")), "expected_record_count": number("expected_record_count"), "actual_record_count": number("actual_record_count")},
        "dq": {"dimension": text(get("dimension")), "expectation_type": text(get("expectation_type")), "empty_policy": text(get("empty_policy")), "sample_violations": F.to_json("i.sample_violations") if "sample_violations" in have else F.lit(None).cast("string")},
        "standardization": {"transformation_type": text(get("transformation_type")), "rows_unchanged": number("rows_unchanged"), "sample_changes": F.to_json(F.transform("i.sample_changes", lambda x: F.struct(x["after"].alias("after"), x["before"].alias("before")))) if "sample_changes" in have else F.lit(None).cast("string")},
        "replay": {"strategy": text(get("strategy"))},
    }[process]
    asset = F.lit(None).cast("string") if process == "ingestion" else get("asset")
    column = get("column") if process in ("dq", "standardization") else F.lit(None).cast("string")
    status = get("validation_status") if process == "ingestion" else get("status") if process == "dq" else F.lit(None).cast("string")
    return item.select(
        identity("detail:", F.lit(process), F.col("run_id"), F.lit(kind), get(key)).alias("detail_id"), "run_id", F.lit(kind).alias("detail_type"), get(key).alias("semantic_id"), asset.alias("asset"), column.alias("column_name"), status.alias("status"),
        *[get(c, "long").alias(c) for c in ("rows_total", "rows_evaluated", "rows_changed", "violations")], get("compliance_ratio", "double").alias("compliance_ratio"), get("input_rows", "long").alias("input_rows"), get("output_rows", "long").alias("output_rows"), attributes(**extra).alias("attributes"),
    )
