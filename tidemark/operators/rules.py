"""Quality rules over text columns, compiled so that an asset is scanned once for all its value rules.

allowed_values, regex_format: conditional counts, all rules of an asset in one
aggregate. unique, reference_exists: columns that reference rules connect share their
values, so they are counted together, each value once with its rows in every column;
all rules of such a family are sums over that one aggregate, without a join, and a
frequent value is one row after the map side. Nothing is collected; the result is one
row per rule.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import full_match, ratio

SAMPLES = 5
PARSER_NULL = "<PARSER_NULL>"


@dataclass(frozen=True)
class Rule:
    """A declared expectation on one column of one asset."""

    rule_id: str
    asset: str
    column: str
    dimension: str
    kind: str
    values: tuple[str, ...] = ()
    pattern: str = ""
    target: tuple[str, str] = ("", "")
    empty_policy: str = "evaluate"

    @classmethod
    def declared(cls, d: dict) -> Rule:
        """From a metadata declaration."""
        e = d["expectation"]
        ref = e.get("reference") or {k: e.get(k) for k in ("asset", "column")}
        return cls(d["id"], d["asset"], d["column"], d["dimension"], e["type"], tuple(e.get("values") or ()), e.get("pattern") or "", (ref.get("asset") or "", ref.get("column") or ""), d["empty_policy"])


def evaluated(value: Column, rule: Rule) -> Column:
    """Rows that the empty policy leaves to the rule; nulls always are."""
    return value.isNull() | (value != "") if rule.empty_policy == "ignore" else F.lit(True)


def violated(value: Column, rule: Rule) -> Column:
    """Violation of a value rule."""
    if rule.kind == "allowed_values":
        return value.isNull() | ~value.isin(*rule.values)
    return value.isNull() | ~full_match(value, rule.pattern)


def _row(r: Rule, total: str, evaluated_: str, violations: str) -> Column:
    """A rule's facts as declared, and its counts."""
    facts = {"rule_id": r.rule_id, "asset": r.asset, "column_name": r.column, "dimension": r.dimension, "expectation_type": r.kind, "empty_policy": r.empty_policy}
    return F.struct(*[F.lit(v).alias(k) for k, v in facts.items()], F.col(total).alias("rows_total"), F.col(evaluated_).alias("rows_evaluated"), F.col(violations).alias("violations"))


def _value_counts(table: DataFrame, rules: list[Rule]) -> DataFrame:
    """One aggregate for all value rules of an asset, turned into a row per rule."""
    aggs = [F.count(F.lit(1)).alias("t")]
    for k, r in enumerate(rules):
        value = F.col(f"`{r.column}`").cast("string")
        on = evaluated(value, r)
        aggs += [F.count_if(on).alias(f"e{k}"), F.count_if(on & violated(value, r)).alias(f"v{k}")]
    rows = [_row(r, "t", f"e{k}", f"v{k}") for k, r in enumerate(rules)]
    return table.agg(*aggs).select(F.inline(F.array(*rows)))


#: Types whose equality is that of their texts; columns of other or of different types are compared as text.
EXACT = ("byte", "short", "integer", "long", "string", "date", "boolean")


@dataclass
class Family:
    """Columns that reference rules connect, and the rules on them."""

    columns: list[tuple[str, str]]
    rules: list[Rule]

    def place(self, column: tuple[str, str]) -> str:
        return f"n{self.columns.index(column)}"

    def counts(self, tables: dict[str, DataFrame]) -> DataFrame:
        """value, and its rows in each column: one shuffle of pre-aggregated values."""
        types = {tables[a].schema[c].dataType.typeName() for a, c in self.columns}
        kind = next(iter(types)) if len(types) == 1 and types <= set(EXACT) else None
        cell = lambda c: F.col(f"`{c}`") if kind else F.col(f"`{c}`").cast("string")
        parts = [tables[a].select(cell(c).alias("value"), F.lit(k).alias("k")) for k, (a, c) in enumerate(self.columns)]
        return reduce(DataFrame.unionByName, parts).groupBy("value").agg(*[F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(len(self.columns))])

    def bad(self, rule: Rule) -> Column:
        """Does a value violate the rule in the rows that hold it?"""
        if rule.kind == "unique":
            return F.col(self.place((rule.asset, rule.column))) > 1
        return F.col("value").isNull() | (F.col(self.place(rule.target)) == 0)


def families(rules: list[Rule]) -> list[Family]:
    out: list[Family] = []
    for r in rules:
        columns = [(r.asset, r.column)] + ([r.target] if r.kind == "reference_exists" else [])
        met = [f for f in out if set(f.columns) & set(columns)]
        out = [f for f in out if f not in met]
        out.append(Family(list(dict.fromkeys([c for f in met for c in f.columns] + columns)), [x for f in met for x in f.rules] + [r]))
    return out


def _family_counts(family: Family, tables: dict[str, DataFrame]) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    aggs, rows = [], []
    for k, r in enumerate(family.rules):
        n, on = F.col(family.place((r.asset, r.column))), evaluated(F.col("value").cast("string"), r)
        aggs += [total(n).alias(f"t{k}"), total(F.when(on, n)).alias(f"e{k}"), total(F.when(on & family.bad(r), n)).alias(f"v{k}")]
        rows.append(_row(r, f"t{k}", f"e{k}", f"v{k}"))
    return family.counts(tables).agg(*aggs).select(F.inline(F.array(*rows)))


def rule_counts(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """Facts and counts of every rule: one row for each."""
    by_asset, grouped = defaultdict(list), []
    for r in rules:
        (by_asset[r.asset] if r.kind in ("allowed_values", "regex_format") else grouped).append(r)
    parts = [_family_counts(f, tables) for f in families(grouped)] + [_value_counts(tables[a], some) for a, some in by_asset.items()]
    return reduce(DataFrame.unionByName, parts)


def rule_results(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """The verdict of every rule: passed without violations; the ratio is null where nothing was evaluated."""
    counted = rule_counts(tables, rules)
    return counted.select(
        "rule_id", "asset", "column_name", "dimension", "expectation_type", "empty_policy",
        F.when(F.col("violations") == 0, "PASSED").otherwise("FAILED").alias("status"),
        "rows_total", "rows_evaluated", "violations", ratio(F.col("rows_evaluated") - F.col("violations"), F.col("rows_evaluated")).alias("compliance_ratio"),
    )


def samples(tables: dict[str, DataFrame], rules: list[Rule], limit: int = SAMPLES) -> DataFrame:
    """rule_id, rank, value: the first distinct violating values in order, a null before all others."""
    value, found = F.col("value"), []
    for f in families([r for r in rules if r.kind in ("unique", "reference_exists")]):
        counts = f.counts(tables)
        # each value once, with the rules that it violates
        broken = [F.when(evaluated(value.cast("string"), r) & f.bad(r) & (F.col(f.place((r.asset, r.column))) > 0), F.lit(r.rule_id)) for r in f.rules]
        found.append(counts.select(value.cast("string").alias("value"), F.explode(F.array_compact(F.array(*broken))).alias("rule_id")))
    for r in rules:
        if r.kind in ("allowed_values", "regex_format"):
            bad = tables[r.asset].select(F.col(f"`{r.column}`").cast("string").alias("value")).where(evaluated(value, r) & violated(value, r)).distinct()
            found.append(bad.withColumn("rule_id", F.lit(r.rule_id)))
    # the first few of each rule: ranks are limited before the shuffle as well as after it
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(value.asc_nulls_first())).cast("long")
    first = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= limit)
    return first.select("rule_id", "rank", F.coalesce(value, F.lit(PARSER_NULL)).alias("value"))


def run_summary(results: DataFrame) -> DataFrame:
    """rules_total, rules_passed, rules_failed."""
    return results.agg(F.count(F.lit(1)).alias("rules_total"), F.count_if(F.col("status") == "PASSED").alias("rules_passed"), F.count_if(F.col("status") == "FAILED").alias("rules_failed"))
