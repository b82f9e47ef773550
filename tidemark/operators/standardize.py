"""Authorized text standardization: full-match replacements, in declaration order, with change accounting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import full_match, java_replacement


@dataclass(frozen=True)
class Policy:
    """A replacement of whole values of one column that match a pattern."""

    policy_id: str
    asset: str
    column: str
    pattern: str
    replacement: str

    @classmethod
    def declared(cls, d: dict) -> Policy:
        return cls(d["id"], d["asset"], d["column"], d["transformation"]["pattern"], d["transformation"]["replacement"])


def replaced(column: str, policy: Policy):
    """The value after one policy; values that do not match as a whole stay."""
    value = F.col(f"`{column}`")
    whole = rf"(?U)\A(?:{policy.pattern})\z"
    return F.when(full_match(value, policy.pattern, True), F.regexp_replace(value, whole, java_replacement(policy.replacement))).otherwise(value)


def standardize(table: DataFrame, policies: list[Policy]) -> DataFrame:
    """Each policy sees what the ones before it left."""
    for p in policies:
        table = table.withColumn(p.column, replaced(p.column, p))
    return table


def changes(table: DataFrame, policies: list[Policy]) -> DataFrame:
    """policy_id, before, after of every row, each policy after the ones before it."""
    out = None
    for p in policies:
        part = table.select(F.lit(p.policy_id).alias("policy_id"), F.col(f"`{p.column}`").alias("before"), replaced(p.column, p).alias("after"))
        out = part if out is None else out.unionByName(part)
        table = table.withColumn(p.column, replaced(p.column, p))
    return out


def policy_metrics(changed: DataFrame) -> DataFrame:
    """policy_id, rows_total, rows_evaluated, rows_changed, rows_unchanged; changed means different, not matched."""
    differs = ~F.col("before").eqNullSafe(F.col("after"))
    return changed.groupBy("policy_id").agg(F.count(F.lit(1)).alias("rows_total"), F.count(F.lit(1)).alias("rows_evaluated"), F.count_if(differs).alias("rows_changed"), F.count_if(~differs).alias("rows_unchanged"))


def sample_changes(changed: DataFrame, limit: int = 5) -> DataFrame:
    """policy_id, rank, before, after: the smallest distinct pairs of each policy."""
    pairs = changed.where(~F.col("before").eqNullSafe(F.col("after"))).distinct()
    rank = F.row_number().over(Window.partitionBy("policy_id").orderBy("before", "after"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select("policy_id", "rank", "before", "after")
