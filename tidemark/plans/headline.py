"""Queries that the benchmark times."""

NAMES = ["dq_rule_results", "dq_allowed_values", "dq_regex_format", "dq_unique", "dq_reference_exists", "dq_samples", "profile_table", "standardize_policy_metrics", "replay_temporal_and_reference", "replay_reverse_reference", "replay_counts", "metrics_all_levels", "trace_details", "lineage_edges", "report_fk_violations"]
