"""Governance views: open issues, decisions, authorization and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def issue_decisions(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    d = decisions.select("issue_id", "decision_id", "decision_type", F.col("status").alias("decision_status"))
    return issues.select("issue_id", "rule_id", F.col("status").alias("issue_status")).join(d, "issue_id")


def unauthorized(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues without an effective authorization."""
    ok = decisions.where("decision_type = 'REMEDIATION_AUTHORIZED' and status = 'EFFECTIVE'").select("issue_id")
    return issues.join(ok, "issue_id", "left_anti")


def issue_evidence(issues: DataFrame, decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of an issue or of one of its decisions: two equi-joins instead of one join on either."""
    e = evidence.select("evidence_id", "parent_type", "parent_id", "evidence_type", "path")
    own = issues.select("issue_id").join(e.where("parent_type = 'ISSUE'"), F.col("issue_id") == F.col("parent_id"))
    via = decisions.select("issue_id", "decision_id").join(e.where("parent_type = 'DECISION'"), F.col("decision_id") == F.col("parent_id"))
    columns = ["issue_id", "evidence_id", "parent_type", "evidence_type", "path"]
    return own.select(*columns).unionByName(via.join(issues.select("issue_id"), "issue_id", "left_semi").select(*columns))


def parentless(issues: DataFrame, decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence whose parent does not exist."""
    parents = issues.select(F.lit("ISSUE").alias("parent_type"), F.col("issue_id").alias("parent_id")).unionByName(decisions.select(F.lit("DECISION").alias("parent_type"), F.col("decision_id").alias("parent_id")))
    return evidence.join(parents, ["parent_type", "parent_id"], "left_anti")


def decisions_of_issues(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    return issues.select("issue_id").join(decisions, "issue_id").select("issue_id", "decision_id", "decision_type", "status", "policy_id")


def evidence_of_issue(decisions: DataFrame, evidence: DataFrame, issue: str) -> DataFrame:
    """Evidence of one issue and of its decisions, all columns."""
    own = evidence.where((F.col("parent_type") == "ISSUE") & (F.col("parent_id") == issue))
    of = decisions.where(F.col("issue_id") == issue).select(F.col("decision_id").alias("parent_id")).distinct()
    return own.unionByName(evidence.where("parent_type = 'DECISION'").join(of, "parent_id", "left_semi"))


def without_policy(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues that no decision authorizes a policy for."""
    ok = decisions.where("decision_type = 'REMEDIATION_AUTHORIZED' and policy_id is not null").select("issue_id")
    return issues.join(ok, "issue_id", "left_anti").select("issue_id", "asset", "column_name")


def withheld(decisions: DataFrame) -> DataFrame:
    return decisions.where("decision_type = 'REMEDIATION_WITHHELD'").select("decision_id", "issue_id", "status", "policy_id")


def rule_and_policy_evidence(issues: DataFrame, decisions: DataFrame, evidence: DataFrame, rule: str, policy: str) -> DataFrame:
    """Evidence on either side of a rule's issue and a policy's decision; one row a decision."""
    pair = issues.where(F.col("rule_id") == rule).select("issue_id", "rule_id").join(decisions.where(F.col("policy_id") == policy).select("issue_id", "decision_id", F.col("policy_id").alias("authorized_policy_id")), "issue_id")
    e = evidence.select("parent_type", "parent_id", "evidence_id", "evidence_type", "path", "run_id", F.col("rule_id").alias("evidence_rule_id"), F.col("policy_id").alias("evidence_policy_id"))
    own = pair.join(e.where("parent_type = 'ISSUE'"), F.col("issue_id") == F.col("parent_id"))
    via = pair.join(e.where("parent_type = 'DECISION'"), F.col("decision_id") == F.col("parent_id"))
    return own.unionByName(via).select("issue_id", "rule_id", "authorized_policy_id", "evidence_id", "evidence_type", "path", "run_id", "evidence_rule_id", "evidence_policy_id")
