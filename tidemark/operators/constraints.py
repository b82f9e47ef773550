"""Constraints that files do not enforce, as DataFrames of violation counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("constraint"), "violations")


def duplicate_grain(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys that more than one row has."""
    return _count(df.groupBy(*keys).count().where("count > 1"), name)


def null_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return _count(df.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])), name)


def foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Non-null references without a parent, by an anti join."""
    keys = parent.select(F.col(key).alias("_k")).distinct()
    return _count(child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_k"), "left_anti"), name)


def scope_mismatch(child: DataFrame, parent: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Rows that share a key but differ in a column; nulls are equal to nulls."""
    p = parent.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return _count(child.join(p, key).where(reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])), name)


def round_trip(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, repeats counted."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def require_none(checks: DataFrame) -> None:
    """Raise with the names of all constraints that are violated."""
    if bad := checks.where("violations > 0").orderBy("constraint").collect():
        raise ValueError("; ".join(f"{r.constraint}: {r.violations}" for r in bad))
