"""Structural lineage: nodes and edges derived by joins over metadata tables.

Metadata tables: assets(asset, evidence), rules(rule_id, asset, column_name,
evidence), policies(policy_id, asset, column_name, evidence), relationships(name,
from_asset, from_column, to_asset, to_column, evidence); evidence is an array of
canonical JSON strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import identity, node_id

#: Edge types and their categories; fixed values.
CATEGORIES = {"ingested_to": "DATA_FLOW", "published_to": "DATA_FLOW", "replayed_to": "DATA_FLOW", "transformed_by": "TRANSFORMATION", "evaluated_by": "EVALUATION", "references": "DATA_RELATIONSHIP"}
FLOWS = (("source", "raw", "ingested_to"), ("raw", "trusted", "published_to"), ("trusted", "snapshot", "replayed_to"))
#: Columns of a node.
NODE = ["node_id", "node_type", "zone", "asset", "column_name", "semantic_id"]


def _none():
    return F.lit(None).cast("string")


def _asset(zone, asset="asset"):
    return node_id("asset", zone, F.col(asset))


def _column(zone, asset="asset", column="column_name"):
    return node_id("column", zone, F.col(asset), F.col(column))


def nodes(assets: DataFrame, rules: DataFrame, policies: DataFrame, relationships: DataFrame) -> DataFrame:
    """Assets in four zones, rules with their columns in three, policies with theirs in two, and endpoints of relationships."""
    zoned = assets.select("asset", F.explode(F.array(*map(F.lit, ("source", "raw", "trusted", "snapshot")))).alias("zone"))
    of_assets = zoned.select(_asset(F.col("zone")).alias("node_id"), F.lit("asset").alias("node_type"), "zone", "asset", _none().alias("column_name"), _none().alias("semantic_id"))
    of_rules = rules.select(node_id("rule", F.col("rule_id")).alias("node_id"), F.lit("dq_rule").alias("node_type"), _none().alias("zone"), "asset", "column_name", F.col("rule_id").alias("semantic_id"))
    of_policies = policies.select(node_id("policy", F.col("policy_id")).alias("node_id"), F.lit("standardization_policy").alias("node_type"), _none().alias("zone"), "asset", "column_name", F.col("policy_id").alias("semantic_id"))
    placed = rules.select("asset", "column_name", F.explode(F.array(*map(F.lit, ("raw", "trusted", "snapshot")))).alias("zone"))
    placed = placed.unionByName(policies.select("asset", "column_name", F.explode(F.array(F.lit("raw"), F.lit("trusted"))).alias("zone")))
    for side in ("from", "to"):
        placed = placed.unionByName(relationships.select(F.col(f"{side}_asset").alias("asset"), F.col(f"{side}_column").alias("column_name"), F.lit("logical").alias("zone")))
    of_columns = placed.distinct().select(_column(F.col("zone")).alias("node_id"), F.lit("column").alias("node_type"), "zone", "asset", "column_name", _none().alias("semantic_id"))
    return of_assets.unionByName(of_rules).unionByName(of_policies).unionByName(of_columns).select(*NODE)


def edges(assets: DataFrame, rules: DataFrame, policies: DataFrame, relationships: DataFrame) -> DataFrame:
    """Flow, evaluation, transformation and reference edges; equal endpoints of relationships are one edge with all their evidence."""
    flow = None
    for a, b, kind in FLOWS:
        part = assets.select(_asset(F.lit(a)).alias("source_node_id"), _asset(F.lit(b)).alias("target_node_id"), F.lit(kind).alias("edge_type"), _none().alias("context_node_id"), "evidence")
        flow = part if flow is None else flow.unionByName(part)
    placed = rules.select("*", F.explode(F.array(*map(F.lit, ("raw", "trusted", "snapshot")))).alias("zone"))
    evaluation = placed.select(_column(F.col("zone")).alias("source_node_id"), node_id("rule", F.col("rule_id")).alias("target_node_id"), F.lit("evaluated_by").alias("edge_type"), _none().alias("context_node_id"), "evidence")
    transformation = policies.select(_column(F.lit("raw")).alias("source_node_id"), _column(F.lit("trusted")).alias("target_node_id"), F.lit("transformed_by").alias("edge_type"), node_id("policy", F.col("policy_id")).alias("context_node_id"), "evidence")
    reference = relationships.select(_column(F.lit("logical"), "from_asset", "from_column").alias("source_node_id"), _column(F.lit("logical"), "to_asset", "to_column").alias("target_node_id"), F.lit("references").alias("edge_type"), _none().alias("context_node_id"), "evidence")
    every = flow.unionByName(evaluation).unionByName(transformation).unionByName(reference)
    keys = ["source_node_id", "target_node_id", "edge_type", "context_node_id"]
    merged = every.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("refs"))
    category = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[F.col("edge_type")]
    return merged.select(identity("edge:", *map(F.col, keys)).alias("edge_id"), "source_node_id", "target_node_id", category.alias("edge_category"), "edge_type", "context_node_id", F.concat(F.lit("["), F.array_join("refs", ","), F.lit("]")).alias("evidence"))


def paths(nodes_: DataFrame, edges_: DataFrame, asset: str, column: str) -> DataFrame:
    """Edges that touch a column, with the identities at both ends and in context."""
    touching = nodes_.where((F.col("asset") == asset) & (F.col("column_name") == column)).select(F.col("node_id").alias("touched"))
    ends = edges_.select("edge_id", F.explode(F.array("source_node_id", "target_node_id", "context_node_id")).alias("touched"))
    hit = edges_.join(ends.join(touching, "touched", "left_semi").select("edge_id"), "edge_id", "left_semi")
    return hit.select("edge_type", "source_node_id", "target_node_id", "context_node_id").distinct()


def with_ends(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Edges with the identities, zones and columns at both ends (s_, t_) and the context's semantic identity as policy_id."""
    end = lambda p: nodes_.select(F.col("node_id").alias(f"{p}_node"), *[F.col(c).alias(f"{p}_{c}") for c in NODE[1:]])
    context = nodes_.select(F.col("node_id").alias("context_node_id"), F.col("semantic_id").alias("policy_id"))
    return edges_.join(end("s"), F.col("source_node_id") == F.col("s_node")).join(end("t"), F.col("target_node_id") == F.col("t_node")).join(context, "context_node_id", "left")


def around_column(nodes_: DataFrame, edges_: DataFrame, asset: str, column: str) -> DataFrame:
    """Flows of an asset and edges that begin at one of its columns."""
    e = with_ends(nodes_, edges_).where((F.col("s_asset") == asset) & ((F.col("s_node_type") == "asset") | (F.col("s_column_name") == column)))
    return e.select("edge_category", "edge_type", F.col("s_node").alias("source"), F.col("t_node").alias("target"), "context_node_id", "policy_id")


def rules_of_column(nodes_: DataFrame, edges_: DataFrame, asset: str, column: str) -> DataFrame:
    e = with_ends(nodes_, edges_.where("edge_type = 'evaluated_by'")).where((F.col("s_asset") == asset) & (F.col("s_column_name") == column))
    return e.select(F.col("t_semantic_id").alias("rule_id")).distinct()


def transformed_columns(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    e = with_ends(nodes_, edges_.where("edge_type = 'transformed_by'")).where("policy_id is not null")
    return e.select(F.col("s_asset").alias("asset"), F.col("s_column_name").alias("column_name"), F.col("s_zone").alias("source_zone"), F.col("t_zone").alias("target_zone"), "policy_id")


def snapshot_flows(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    e = with_ends(nodes_, edges_.where("edge_type = 'replayed_to'"))
    return e.select(F.col("s_asset").alias("asset"), F.col("s_zone").alias("source_zone"), F.col("t_zone").alias("target_zone"))


def references_of(nodes_: DataFrame, edges_: DataFrame, asset: str) -> DataFrame:
    e = with_ends(nodes_, edges_.where("edge_type = 'references'")).where((F.col("s_asset") == asset) | (F.col("t_asset") == asset))
    return e.select(F.col("s_node").alias("source"), F.col("t_node").alias("target"))
