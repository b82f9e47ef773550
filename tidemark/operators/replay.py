"""Historical snapshots: rows up to an inclusive cutoff, closed under references to rows that stay."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Selection:
    """How one asset is selected: by a date expression, by references (column, asset, its column), by both or not at all."""

    asset: str
    date: Column | None = None
    references: tuple[tuple[str, str, str], ...] = ()

    @property
    def strategy(self) -> str:
        if self.date is not None:
            return "temporal_and_reference" if self.references else "temporal"
        return "reference" if self.references else "static"


def order(selections: list[Selection]) -> list[Selection]:
    """Referenced assets first; a cycle is an error."""
    by_name, done, open_, out = {s.asset: s for s in selections}, set(), set(), []

    def visit(name: str) -> None:
        if name in done:
            return
        if name in open_:
            raise ValueError(f"replay references form a cycle at {name}")
        open_.add(name)
        for _, target, _ in by_name[name].references:
            if target not in by_name:
                raise ValueError(f"{name} refers to {target}, which has no policy")
            visit(target)
        done.add(name)
        out.append(by_name[name])

    for name in sorted(by_name):
        visit(name)
    return out


def snapshot(tables: dict[str, DataFrame], selections: list[Selection], cutoff: str) -> dict[str, DataFrame]:
    """The selected rows of every asset: filters and left-semi joins, lazily, in dependency order."""
    selected: dict[str, DataFrame] = {}
    for s in order(selections):
        df = tables[s.asset]
        if s.date is not None:
            df = df.where(s.date <= F.lit(cutoff).cast("date"))
        for column, target, key in s.references:
            keys = selected[target].select(F.col(f"`{key}`").alias("_key")).distinct()
            df = df.join(keys, df[column] == keys["_key"], "left_semi")
        selected[s.asset] = df
    return selected


def counts(tables: dict[str, DataFrame], selected: dict[str, DataFrame], selections: list[Selection]) -> DataFrame:
    """asset, strategy, input_rows, output_rows."""
    parts = []
    for s in selections:
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        parts.append(n(tables[s.asset], "input_rows").crossJoin(n(selected[s.asset], "output_rows")).select(F.lit(s.asset).alias("asset"), F.lit(s.strategy).alias("strategy"), "input_rows", "output_rows"))
    return reduce(DataFrame.unionByName, parts)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct values of a reference column that no parent row has; nulls are orphans too."""
    keys = parent.select(F.col(f"`{key}`").alias("value")).distinct()
    return child.select(F.col(f"`{column}`").alias("value")).distinct().join(keys, "value", "left_anti")
