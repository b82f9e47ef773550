"""Column profiles of text: counts, distinct values, lexical bounds and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio

SAMPLES = 5


def profile(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column; one aggregate gives all plain counts and bounds, a grouping of (column, filled value) the distinct ones."""
    columns = columns or table.columns
    text = lambda c: F.col(f"`{c}`").cast("string")
    filled = lambda c: text(c).isNotNull() & (text(c) != "")
    aggs, rows = [F.count(F.lit(1)).alias("t")], []
    for k, c in enumerate(columns):
        aggs += [F.count_if(text(c) == "").alias(f"e{k}"), F.count_if(text(c).isNull()).alias(f"p{k}"), F.min(F.when(filled(c), text(c))).alias(f"a{k}"), F.max(F.when(filled(c), text(c))).alias(f"b{k}")]
        rows.append(F.struct(F.lit(k).alias("position"), F.lit(c).alias("column_name"), F.col("t").alias("total_count"), F.col(f"e{k}").alias("empty_count"), F.col(f"p{k}").alias("parser_null_count"), (F.col("t") - F.col(f"e{k}") - F.col(f"p{k}")).alias("non_empty_count"), F.col(f"a{k}").alias("min_observed"), F.col(f"b{k}").alias("max_observed")))
    plain = table.agg(*aggs).select(F.inline(F.array(*rows)))
    long = table.select(F.inline(F.array(*[F.struct(F.lit(k).alias("position"), text(c).alias("value")) for k, c in enumerate(columns)]))).where("value <> ''")
    distinct = long.distinct().groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    out = plain.join(distinct, "position", "left").withColumn("distinct_count", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("column_name", "total_count", "empty_count", "parser_null_count", "non_empty_count", "distinct_count", ratio(F.col("distinct_count"), F.col("non_empty_count")).alias("uniqueness_ratio"), "min_observed", "max_observed")


def profile_samples(table: DataFrame, columns: list[str] | None = None, limit: int = SAMPLES) -> DataFrame:
    """column_name, rank, value: the first distinct filled values in order; one scan, ranks limited before the shuffle as well."""
    names = columns or table.columns
    long = table.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]))).where("value <> ''")
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("value")).cast("long")
    return long.distinct().withColumn("rank", rank).where(F.col("rank") <= limit).select("column_name", "rank", "value")
