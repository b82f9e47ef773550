"""The operators over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import identity, ratio
from ..operators import constraints, governance, lineage, metrics, profiling, replay, rules, standardize, trace
from ..operators.rules import Rule
from ..operators.replay import Selection
from ..operators.standardize import Policy

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


RULES = [
    Rule("ORD-VAL-001", "orders", "o_orderpriority", "validity", "allowed_values", ("1-URGENT", "2-HIGH")),
    Rule("EVT-VAL-001", "events", "kind", "validity", "allowed_values", ("click", "view"), empty_policy="ignore"),
    Rule("PRT-VAL-001", "part", "p_brand", "validity", "regex_format", pattern=r"^Brand#\d{2}$"),
    Rule("ORD-UNI-001", "orders", "o_orderkey", "uniqueness", "unique"),
    Rule("LIN-UNI-001", "lineitem", "l_orderkey", "uniqueness", "unique"),
    Rule("LIN-RI-001", "lineitem", "l_orderkey", "referential_integrity", "reference_exists", target=("orders", "o_orderkey")),
    Rule("ORD-RI-001", "orders", "o_orderkey", "referential_integrity", "reference_exists", target=("lineitem", "l_orderkey")),
    Rule("ORD-RI-002", "orders", "region_code", "referential_integrity", "reference_exists", target=("nation", "n_nationkey")),
]


def rule_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Driver tables; a column with empty fields and one with nulls are derived, since the tables have neither."""
    t = {n: read(spark, d, n) for n in ("orders", "events", "part", "lineitem", "nation")}
    t["events"] = t["events"].withColumn("kind", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")))
    t["orders"] = t["orders"].withColumn("region_code", F.expr("nullif(o_custkey % 7, 0)"))
    return t


#: Facts of each rule in SQL: (id, asset, column, dimension, kind, empty policy, counts).
_COUNTS = {
    "ORD-VAL-001": "SELECT count(*) t, count(*) e, count(*) FILTER (o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT','2-HIGH')) v FROM orders",
    "EVT-VAL-001": "SELECT count(*) t, count(*) FILTER (k IS NULL OR k <> '') e, count(*) FILTER ((k IS NULL OR k <> '') AND (k IS NULL OR k NOT IN ('click','view'))) v FROM (SELECT CASE WHEN event_type = 'error' THEN '' ELSE event_type END k FROM events)",
    "PRT-VAL-001": r"SELECT count(*) t, count(*) e, count(*) FILTER (p_brand IS NULL OR NOT regexp_full_match(p_brand, '^Brand#\d{2}$')) v FROM part",
    "ORD-UNI-001": "SELECT coalesce(sum(n), 0) t, coalesce(sum(n), 0) e, coalesce(sum(n) FILTER (n > 1), 0) v FROM (SELECT o_orderkey, count(*) n FROM orders GROUP BY 1)",
    "LIN-UNI-001": "SELECT coalesce(sum(n), 0) t, coalesce(sum(n), 0) e, coalesce(sum(n) FILTER (n > 1), 0) v FROM (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1)",
    "LIN-RI-001": "SELECT count(*) t, count(*) e, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) v FROM lineitem",
    "ORD-RI-001": "SELECT count(*) t, count(*) e, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) v FROM orders",
    "ORD-RI-002": "SELECT count(*) t, count(*) e, count(*) FILTER (NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = k)) v FROM (SELECT nullif(o_custkey % 7, 0) k FROM orders)",
}


def _rule_sql(r: Rule) -> str:
    return f"""SELECT '{r.rule_id}' AS rule_id, '{r.asset}' AS asset, '{r.column}' AS column_name, '{r.dimension}' AS dimension, '{r.kind}' AS expectation_type, '{r.empty_policy}' AS empty_policy,
        CASE WHEN v = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, t::BIGINT AS rows_total, e::BIGINT AS rows_evaluated, v::BIGINT AS violations, (e - v)::DOUBLE / nullif(e, 0) AS compliance_ratio FROM ({_COUNTS[r.rule_id]})"""


ALL_RULES_SQL = " UNION ALL ".join(_rule_sql(r) for r in RULES)


def _one(name: str, rule: Rule) -> None:
    """A query of a single rule."""

    def f(spark: SparkSession, d: str) -> DataFrame:
        return rules.rule_results(rule_tables(spark, d), [rule])

    f.__name__ = name
    query(_rule_sql(rule))(f)


for _name, _id in (("dq_allowed_values", 0), ("dq_allowed_values_ignore_empty", 1), ("dq_regex_format", 2), ("dq_unique_pass", 3), ("dq_unique", 4), ("dq_reference_exists", 5), ("dq_reference_orphans", 6), ("dq_reference_null_source", 7)):
    _one(_name, RULES[_id])


@query(ALL_RULES_SQL)
def dq_rule_results(spark, d):
    return rules.rule_results(rule_tables(spark, d), RULES)


@query(f"SELECT count(*) AS rules_total, count(*) FILTER (status = 'PASSED') AS rules_passed, count(*) FILTER (status = 'FAILED') AS rules_failed FROM ({ALL_RULES_SQL})")
def dq_run_summary(spark, d):
    return rules.run_summary(dq_rule_results(spark, d))


@query("""WITH v AS (
    SELECT DISTINCT 'ORD-VAL-001' AS rule_id, o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH')
    UNION ALL SELECT DISTINCT 'PRT-VAL-001', p_brand FROM part WHERE NOT regexp_full_match(p_brand, '^Brand#\\d{2}$')
    UNION ALL SELECT 'LIN-UNI-001', l_orderkey::VARCHAR FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'ORD-RI-001', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT DISTINCT 'ORD-RI-002', nullif(o_custkey % 7, 0)::VARCHAR FROM orders o WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = nullif(o.o_custkey % 7, 0)))
    SELECT rule_id, rank, coalesce(value, '<PARSER_NULL>') AS value FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY value NULLS FIRST) AS rank FROM v) WHERE rank <= 5""")
def dq_samples(spark, d):
    return rules.samples(rule_tables(spark, d), [RULES[i] for i in (0, 2, 4, 6, 7)])


@query("SELECT 'HDR-VAL-001' AS rule_id, 'part' AS asset, 'p_brand' AS column_name, 'validity' AS dimension, 'allowed_values' AS expectation_type, 'evaluate' AS empty_policy, 'PASSED' AS status, 0::BIGINT AS rows_total, 0::BIGINT AS rows_evaluated, 0::BIGINT AS violations, NULL::DOUBLE AS compliance_ratio")
def dq_header_only(spark, d):
    return rules.rule_results({"part": read(spark, d, "part").where("false")}, [Rule("HDR-VAL-001", "part", "p_brand", "validity", "allowed_values", ("x",))])


def _profile_sql(table: str, columns: list[str]) -> str:
    one = lambda c: f"""SELECT '{c}' AS column_name, count(*) AS total_count, count(*) FILTER (v = '') AS empty_count, count(*) FILTER (v IS NULL) AS parser_null_count, count(*) FILTER (v <> '') AS non_empty_count,
        count(DISTINCT v) FILTER (v <> '') AS distinct_count, count(DISTINCT v) FILTER (v <> '')::DOUBLE / nullif(count(*) FILTER (v <> ''), 0) AS uniqueness_ratio, min(v) FILTER (v <> '') AS min_observed, max(v) FILTER (v <> '') AS max_observed FROM (SELECT {c}::VARCHAR AS v FROM {table})"""  # noqa: E731
    return " UNION ALL ".join(map(one, columns))


@query(_profile_sql("documents", ["lang", "source"]))
def profile_column(spark, d):
    return profiling.profile(read(spark, d, "documents"), ["lang", "source"])


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(_profile_sql("customer", CUSTOMER))
def profile_table(spark, d):
    return profiling.profile(read(spark, d, "customer"), CUSTOMER)


@query("SELECT 'p_type' AS column_name, row_number() OVER (ORDER BY p_type) AS rank, p_type AS value FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> '') QUALIFY rank <= 5")
def profile_samples(spark, d):
    return profiling.profile_samples(read(spark, d, "part"), ["p_type"])


POLICIES = [Policy("CUS-STD-001", "customer", "c_name", r"^Customer#(\d{9})$", r"\1"), Policy("CUS-STD-002", "customer", "c_name", r"0{8}(\d)", r"C-\1")]
_STEP1 = r"CASE WHEN regexp_full_match(c_name, '^Customer#(\d{9})$') THEN regexp_replace(c_name, '^Customer#(\d{9})$', '\1') ELSE c_name END"
_STEP2 = r"CASE WHEN regexp_full_match(b, '0{8}(\d)') THEN regexp_replace(b, '^0{8}(\d)$', 'C-\1') ELSE b END"
_CHANGES = f"WITH s AS (SELECT *, c_name AS a, {_STEP1} AS b FROM customer), c AS (SELECT 'CUS-STD-001' AS policy_id, a AS before, b AS after FROM s UNION ALL SELECT 'CUS-STD-002', b, {_STEP2} FROM s)"


@query(f"WITH s AS (SELECT *, {_STEP1} AS b FROM customer) SELECT c_custkey, {_STEP2} AS c_name FROM s")
def standardize_regex_replace(spark, d):
    return standardize.standardize(read(spark, d, "customer"), POLICIES).select("c_custkey", "c_name")


@query(f"{_CHANGES} SELECT policy_id, count(*) AS rows_total, count(*) AS rows_evaluated, count(*) FILTER (before IS DISTINCT FROM after) AS rows_changed, count(*) FILTER (before IS NOT DISTINCT FROM after) AS rows_unchanged FROM c GROUP BY 1")
def standardize_policy_metrics(spark, d):
    return standardize.policy_metrics(standardize.changes(read(spark, d, "customer"), POLICIES))


@query(f"{_CHANGES} SELECT policy_id, row_number() OVER (PARTITION BY policy_id ORDER BY before, after) AS rank, before, after FROM (SELECT DISTINCT * FROM c WHERE before IS DISTINCT FROM after) QUALIFY rank <= 5")
def standardize_sample_changes(spark, d):
    return standardize.sample_changes(standardize.changes(read(spark, d, "customer"), POLICIES))


CUTOFF = "1995-12-31"
_day = lambda c: F.col(c).cast("date")


def selections() -> list[Selection]:
    return [
        Selection("orders", _day("o_orderdate")), Selection("customer", references=(("c_custkey", "orders", "o_custkey"),)), Selection("nation"),
        Selection("lineitem", _day("l_shipdate"), (("l_orderkey", "orders", "o_orderkey"),)), Selection("supplier", references=(("s_suppkey", "lineitem", "l_suppkey"),)),
    ]


def replayed(spark, d) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    tables = {s.asset: read(spark, d, s.asset) for s in selections()}
    return tables, replay.snapshot(tables, selections(), CUTOFF)


_O = f"SELECT * FROM orders WHERE o_orderdate::DATE <= DATE '{CUTOFF}'"
_C = f"SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM ({_O}))"
_L = f"SELECT * FROM lineitem WHERE l_shipdate::DATE <= DATE '{CUTOFF}' AND l_orderkey IN (SELECT o_orderkey FROM ({_O}))"
_S = f"SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM ({_L}))"


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM ({_O})")
def replay_temporal(spark, d):
    return replayed(spark, d)[1]["orders"].select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT c_custkey, c_name FROM ({_C})")
def replay_reference(spark, d):
    return replayed(spark, d)[1]["customer"].select("c_custkey", "c_name")


@query(f"SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM ({_L})")
def replay_temporal_and_reference(spark, d):
    return replayed(spark, d)[1]["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def replay_static(spark, d):
    return replayed(spark, d)[1]["nation"].select("n_nationkey", "n_name", "n_regionkey")


@query(f"SELECT s_suppkey, s_name FROM ({_S})")
def replay_reverse_reference(spark, d):
    return replayed(spark, d)[1]["supplier"].select("s_suppkey", "s_name")


@query(" UNION ALL ".join(f"SELECT '{a}' AS asset, '{k}' AS strategy, (SELECT count(*) FROM {a}) AS input_rows, (SELECT count(*) FROM ({q})) AS output_rows" for a, k, q in (("orders", "temporal", _O), ("customer", "reference", _C), ("nation", "static", "SELECT * FROM nation"), ("lineitem", "temporal_and_reference", _L), ("supplier", "reference", _S))))
def replay_counts(spark, d):
    tables, selected = replayed(spark, d)
    return replay.counts(tables, selected, selections())


@query("SELECT DISTINCT o_custkey AS value FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def replay_orphans(spark, d):
    return replay.orphans(read(spark, d, "orders"), "o_custkey", read(spark, d, "supplier"), "s_suppkey").unionByName(replay.orphans(read(spark, d, "documents"), "doc_id", read(spark, d, "labels"), "doc_id"))


#: Runs over six year-end cutoffs, one of them twice, and two that are no snapshots; the orders of a run are those up to its cutoff.
RUNS = [("legacy", None, None), ("trusted", "trusted", None), *((f"snap-{y}", "snapshot", f"{y}-12-31") for y in range(1993, 1999)), ("snap-1998-b", "snapshot", "1998-12-31")]
_RUNS = "(VALUES " + ", ".join(f"('{r}', {'NULL' if z is None else repr(z)}, {'NULL' if c is None else f'''DATE '{c}' '''})" for r, z, c in RUNS) + ") r(run_id, data_zone, snapshot_cutoff)"
_HISTORY = f"""WITH runs AS (SELECT run_id, data_zone::VARCHAR AS data_zone, snapshot_cutoff::DATE AS snapshot_cutoff FROM {_RUNS}),
    o AS (SELECT r.*, x.o_orderpriority, x.o_custkey FROM runs r LEFT JOIN orders x ON r.snapshot_cutoff IS NULL OR x.o_orderdate::DATE <= r.snapshot_cutoff),
    h AS (SELECT run_id, data_zone, snapshot_cutoff, 'ORD-VAL-001' AS rule_id, 'orders' AS asset, 'validity' AS dimension, count(o_custkey) AS t, count(o_custkey) AS e, count(o_custkey) FILTER (o_orderpriority NOT IN ('1-URGENT','2-HIGH')) AS v FROM o GROUP BY 1, 2, 3
        UNION ALL SELECT run_id, data_zone, snapshot_cutoff, 'CUS-VAL-001', 'customer', 'validity', count(o_custkey), count(o_custkey) FILTER (o_custkey % 3 = 0), 0 FROM o GROUP BY 1, 2, 3
        UNION ALL SELECT run_id, data_zone, snapshot_cutoff, 'ORD-UNI-001', 'orders', 'uniqueness', count(o_custkey), count(o_custkey), count(o_custkey) FILTER (o_custkey % 5 = 0) FROM o GROUP BY 1, 2, 3),
    m AS (SELECT run_id, rule_id, data_zone, snapshot_cutoff, asset, dimension, CASE WHEN v = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, t AS rows_total, e AS rows_evaluated, t - e AS rows_not_evaluated, e::DOUBLE / nullif(t, 0) AS evaluation_ratio,
        v::BIGINT AS violations, (e - v)::BIGINT AS conforming_evaluations, v::DOUBLE / nullif(e, 0) AS violation_ratio, (e - v)::DOUBLE / nullif(e, 0) AS compliance_ratio FROM h)"""


def history(spark, d) -> DataFrame:
    """Evaluations of the runs: one conditional aggregate over orders for all runs together."""
    o = read(spark, d, "orders").select("o_orderdate", "o_orderpriority", "o_custkey")
    aggs, rows = [], []
    key = F.col("o_custkey")
    for k, (run, zone, cut) in enumerate(RUNS):
        inside = F.lit(True) if cut is None else F.col("o_orderdate").cast("date") <= F.lit(cut).cast("date")
        n = F.count_if(inside & key.isNotNull())
        aggs += [n.alias(f"t{k}"), F.count_if(inside & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias(f"p{k}"), F.count_if(inside & (key % 3 == 0)).alias(f"c{k}"), F.count_if(inside & (key % 5 == 0)).alias(f"u{k}")]
        zero = F.lit(0).cast("long")
        for rule, asset, column, dimension, kind, t, e, v in (("ORD-VAL-001", "orders", "o_orderpriority", "validity", "allowed_values", f"t{k}", f"t{k}", F.col(f"p{k}")), ("CUS-VAL-001", "customer", "c_name", "validity", "regex_format", f"t{k}", f"c{k}", zero), ("ORD-UNI-001", "orders", "o_orderkey", "uniqueness", "unique", f"t{k}", f"t{k}", F.col(f"u{k}"))):
            rows.append(F.struct(F.lit(run).alias("run_id"), F.lit(zone).cast("string").alias("data_zone"), F.lit(cut).cast("date").alias("snapshot_cutoff"), F.lit(rule).alias("rule_id"), F.lit(asset).alias("asset"), F.lit(column).alias("column_name"), F.lit(dimension).alias("dimension"), F.lit(kind).alias("expectation_type"), F.lit("evaluate").alias("empty_policy"), F.when(v == 0, "PASSED").otherwise("FAILED").alias("status"), F.col(t).alias("rows_total"), F.col(e).alias("rows_evaluated"), v.alias("violations"), ratio(F.col(e) - v, F.col(e)).alias("compliance_ratio")))
    return o.agg(*aggs).select(F.inline(F.array(*rows)))


def evaluated(spark, d) -> DataFrame:
    h = history(spark, d)
    runs = spark.createDataFrame([(r, z, c) for r, z, c in RUNS], "run_id string, data_zone string, cutoff string").select("run_id", F.expr("timestamp_ntz '2026-01-01 00:00:00'").alias("started_at"), "data_zone", F.col("cutoff").cast("date").alias("snapshot_cutoff"))
    return metrics.evaluations(runs, h.drop("data_zone", "snapshot_cutoff"))


@query(f"{_HISTORY} SELECT run_id, rule_id, data_zone, snapshot_cutoff, asset, dimension, status, rows_total, rows_evaluated, violations, compliance_ratio FROM m")
def history_rule_results(spark, d):
    return history(spark, d).select("run_id", "rule_id", "data_zone", "snapshot_cutoff", "asset", "dimension", "status", "rows_total", "rows_evaluated", "violations", "compliance_ratio")


@query(f"{_HISTORY} SELECT * FROM m")
def metrics_evaluation(spark, d):
    return evaluated(spark, d).drop("started_at", "column_name", "expectation_type", "empty_policy")


def _level_sql(level: str) -> str:
    run, asset, dimension = metrics.LEVELS[level]
    keys = [*(["run_id", "data_zone"] if run else []), "snapshot_cutoff", *(["asset"] if asset else []), *(["dimension"] if dimension else [])]
    return f"""SELECT '{level}' AS aggregation_level, {"run_id" if run else "NULL::VARCHAR AS run_id"}, {"data_zone" if run else "'snapshot' AS data_zone"}, snapshot_cutoff, {"asset" if asset else "NULL::VARCHAR AS asset"}, {"dimension" if dimension else "NULL::VARCHAR AS dimension"},
        count(*) AS evaluations, count(DISTINCT rule_id) AS distinct_rules, count(*) FILTER (status = 'PASSED') AS passed_evaluations, count(*) FILTER (status = 'FAILED') AS failed_evaluations, count(*) FILTER (status = 'PASSED')::DOUBLE / count(*) AS pass_ratio,
        sum(rows_evaluated)::BIGINT AS row_rule_evaluations, sum(violations)::BIGINT AS row_rule_violations, sum(conforming_evaluations)::BIGINT AS row_rule_conforming, sum(violations)::DOUBLE / nullif(sum(rows_evaluated), 0) AS weighted_violation_ratio, sum(conforming_evaluations)::DOUBLE / nullif(sum(rows_evaluated), 0) AS weighted_compliance_ratio
        FROM m {"" if run else "WHERE data_zone = 'snapshot' AND snapshot_cutoff IS NOT NULL"} GROUP BY {", ".join(keys)}"""


def _narrow(df: DataFrame) -> DataFrame:
    """Exact wide sums as long, for comparison with SQL."""
    return df.withColumns({c: F.col(c).cast("long") for c in ("row_rule_evaluations", "row_rule_violations", "row_rule_conforming")})


def levels(spark, d) -> DataFrame:
    return metrics.aggregate(evaluated(spark, d))


@query(f"{_HISTORY} " + " UNION ALL ".join(map(_level_sql, metrics.LEVELS)))
def metrics_all_levels(spark, d):
    return _narrow(levels(spark, d))


def _level(level: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _narrow(levels(spark, d).where(F.col("aggregation_level") == level))

    f.__name__ = f"metrics_{level.lower()}"
    query(f"{_HISTORY} {_level_sql(level)}")(f)


for _name in metrics.LEVELS:
    _level(_name)


def _view(name: str, view: str, sql: str, drop: tuple[str, ...] = ()) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        rows = evaluated(spark, d)
        out = metrics.snapshot_views(rows, metrics.aggregate(rows))[view]
        return _narrow(out) if "row_rule_evaluations" in out.columns else out.drop(*drop)

    f.__name__ = name
    query(sql)(f)


_M = ", ".join(metrics.MEASURES)
_ONLY = "data_zone = 'snapshot' AND snapshot_cutoff IS NOT NULL"
_view("view_rule_history", "dq_snapshot_rule_history", f"{_HISTORY} SELECT * EXCLUDE (data_zone) FROM m WHERE {_ONLY}", ("started_at", "column_name", "expectation_type", "empty_policy"))
_view("view_asset_history", "dq_snapshot_asset_history", f"{_HISTORY} SELECT snapshot_cutoff, run_id, asset, {_M} FROM ({_level_sql('RUN_ASSET')}) WHERE {_ONLY}")
_view("view_dimension_history", "dq_snapshot_dimension_history", f"{_HISTORY} SELECT snapshot_cutoff, run_id, dimension, {_M} FROM ({_level_sql('RUN_DIMENSION')}) WHERE {_ONLY}")
_view("view_evaluation_summary", "dq_snapshot_evaluation_summary", f"{_HISTORY} SELECT snapshot_cutoff, run_id, {_M} FROM ({_level_sql('RUN')}) WHERE {_ONLY}")


@query(f"{_HISTORY} SELECT snapshot_cutoff, count(DISTINCT run_id) AS runs, string_agg(DISTINCT run_id, ',' ORDER BY run_id) AS run_ids FROM m WHERE {_ONLY} GROUP BY 1 HAVING count(DISTINCT run_id) > 1")
def snapshot_multi_run(spark, d):
    runs = evaluated(spark, d).where(_ONLY).groupBy("snapshot_cutoff").agg(F.array_sort(F.collect_set("run_id")).alias("r"))
    return runs.where(F.size("r") > 1).select("snapshot_cutoff", F.size("r").cast("long").alias("runs"), F.array_join("r", ",").alias("run_ids"))


def records(spark, d) -> DataFrame:
    """The runs as records with nested rule results."""
    item = F.struct("rule_id", "asset", F.col("column_name").alias("column"), "dimension", "expectation_type", "empty_policy", "status", "rows_total", "rows_evaluated", "violations", "compliance_ratio")
    return history(spark, d).groupBy("run_id", "data_zone", "snapshot_cutoff").agg(F.collect_list(item).alias("rule_results"), F.count(F.lit(1)).alias("rules_total"), F.count_if(F.col("status") == "PASSED").alias("rules_passed"), F.count_if(F.col("status") == "FAILED").alias("rules_failed"))


@query(f"{_HISTORY} SELECT DISTINCT run_id, 'dq' AS process_type, data_zone, snapshot_cutoff FROM m")
def trace_runs(spark, d):
    return records(spark, d).select("run_id", F.lit("dq").alias("process_type"), "data_zone", "snapshot_cutoff")


@query(f"{_HISTORY} SELECT run_id, unnest(['rules_total', 'rules_passed', 'rules_failed']) AS metric_name, unnest([count(*), count(*) FILTER (status = 'PASSED'), count(*) FILTER (status = 'FAILED')])::DOUBLE AS metric_value FROM m GROUP BY run_id")
def trace_metrics(spark, d):
    return trace.metrics(records(spark, d), "dq")


@query(f"""{_HISTORY} SELECT 'detail:' || sha256(to_json(['dq', run_id, 'DQ_RULE', rule_id])) AS detail_id, run_id, 'DQ_RULE' AS detail_type, rule_id AS semantic_id, asset, status, rows_total, rows_evaluated, violations, compliance_ratio,
    '{{"dimension":"' || dimension || '","empty_policy":"evaluate","expectation_type":"' || CASE rule_id WHEN 'ORD-VAL-001' THEN 'allowed_values' WHEN 'CUS-VAL-001' THEN 'regex_format' ELSE 'unique' END || '"}}' AS attributes FROM m""")
def trace_details(spark, d):
    return trace.details(records(spark, d), "dq").select("detail_id", "run_id", "detail_type", "semantic_id", "asset", "status", "rows_total", "rows_evaluated", "violations", "compliance_ratio", "attributes")


def metadata(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Metadata for lineage, derived from the tables: assets are nations, rules and policies belong to suppliers, relationships lead to a region's first nation."""
    name = lambda: F.translate("n_name", "_", " ")
    refs = F.array(F.lit("{}")).alias("evidence")
    nation, supplier = read(spark, d, "nation"), read(spark, d, "supplier")
    scoped = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", name().alias("asset"), F.concat(F.lit("c"), F.col("s_suppkey") % 5).alias("column_name"))
    first = nation.select(F.col("n_nationkey").alias("k"), name().alias("to_asset"))
    links = nation.join(first, F.col("n_regionkey") == F.col("k"))
    return (
        nation.select(name().alias("asset"), refs), scoped.select(F.concat(F.lit("RUL-"), "s_suppkey").alias("rule_id"), "asset", "column_name", refs), scoped.where("s_suppkey % 4 = 0").select(F.concat(F.lit("POL-"), "s_suppkey").alias("policy_id"), "asset", "column_name", refs),
        links.select(F.concat(F.lit("rel_"), "n_nationkey").alias("name"), name().alias("from_asset"), F.lit("region").alias("from_column"), "to_asset", F.lit("key").alias("to_column"), refs),
    )


_enc = lambda c: f"replace({c}, ' ', '%20')"
_LIN = f"""WITH a AS (SELECT replace(n_name, '_', ' ') AS asset FROM nation), r0 AS (SELECT s_suppkey, replace(n_name, '_', ' ') AS asset, 'c' || (s_suppkey % 5) AS column_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    r AS (SELECT 'RUL-' || s_suppkey AS rule_id, asset, column_name FROM r0), p AS (SELECT 'POL-' || s_suppkey AS policy_id, asset, column_name FROM r0 WHERE s_suppkey % 4 = 0),
    x AS (SELECT 'rel_' || f.n_nationkey AS name, replace(f.n_name, '_', ' ') AS from_asset, 'region' AS from_column, replace(t.n_name, '_', ' ') AS to_asset, 'key' AS to_column FROM nation f JOIN nation t ON t.n_nationkey = f.n_regionkey),
    n AS (SELECT 'asset:' || zone || ':' || {_enc("asset")} AS node_id, 'asset' AS node_type, zone, asset, NULL::VARCHAR AS column_name, NULL::VARCHAR AS semantic_id FROM a, (VALUES ('source'), ('raw'), ('trusted'), ('snapshot')) z(zone)
        UNION ALL SELECT 'rule:' || rule_id, 'dq_rule', NULL, asset, column_name, rule_id FROM r
        UNION ALL SELECT 'policy:' || policy_id, 'standardization_policy', NULL, asset, column_name, policy_id FROM p
        UNION ALL SELECT 'column:' || zone || ':' || {_enc("asset")} || ':' || column_name, 'column', zone, asset, column_name, NULL FROM (
            SELECT zone, asset, column_name FROM r, (VALUES ('raw'), ('trusted'), ('snapshot')) z(zone) UNION SELECT zone, asset, column_name FROM p, (VALUES ('raw'), ('trusted')) z(zone)
            UNION SELECT 'logical', from_asset, from_column FROM x UNION SELECT 'logical', to_asset, to_column FROM x)),
    e0 AS (SELECT 'asset:' || f || ':' || {_enc("asset")} AS s, 'asset:' || t || ':' || {_enc("asset")} AS g, 'DATA_FLOW' AS c, k, NULL::VARCHAR AS y FROM a, (VALUES ('source', 'raw', 'ingested_to'), ('raw', 'trusted', 'published_to'), ('trusted', 'snapshot', 'replayed_to')) z(f, t, k)
        UNION ALL SELECT 'column:' || zone || ':' || {_enc("asset")} || ':' || column_name, 'rule:' || rule_id, 'EVALUATION', 'evaluated_by', NULL FROM r, (VALUES ('raw'), ('trusted'), ('snapshot')) z(zone)
        UNION ALL SELECT 'column:raw:' || {_enc("asset")} || ':' || column_name, 'column:trusted:' || {_enc("asset")} || ':' || column_name, 'TRANSFORMATION', 'transformed_by', 'policy:' || policy_id FROM p
        UNION ALL SELECT 'column:logical:' || {_enc("from_asset")} || ':' || from_column, 'column:logical:' || {_enc("to_asset")} || ':' || to_column, 'DATA_RELATIONSHIP', 'references', NULL FROM x),
    e AS (SELECT 'edge:' || sha256(to_json([s, g, k, y])) AS edge_id, s AS source_node_id, g AS target_node_id, c AS edge_category, k AS edge_type, y AS context_node_id, '[{{}}]' AS evidence FROM e0)"""


@query(f"{_LIN} SELECT * FROM n")
def lineage_nodes(spark, d):
    return lineage.nodes(*metadata(spark, d))


@query(f"{_LIN} SELECT * FROM e")
def lineage_edges(spark, d):
    return lineage.edges(*metadata(spark, d))


@query(f"{_LIN} SELECT DISTINCT edge_type, source_node_id, target_node_id, context_node_id FROM e JOIN (SELECT node_id FROM n JOIN (SELECT asset, column_name FROM r WHERE rule_id = 'RUL-0') b USING (asset, column_name)) n ON (n.node_id = source_node_id OR n.node_id = target_node_id OR n.node_id = context_node_id)")
def lineage_card_paths(spark, d):
    """Edges that touch the column of one rule."""
    m = metadata(spark, d)
    bound = m[1].where("rule_id = 'RUL-0'").first()
    return lineage.paths(lineage.nodes(*m), lineage.edges(*m), bound.asset, bound.column_name)


#: Governance over the tables, in both languages: an issue for each nation, decisions by suppliers, evidence from customers; some parents do not exist.
_ISSUES = "SELECT concat('GOV-ISS-', lpad(cast(n_nationkey AS {text}), 3, '0')) AS issue_id, concat('asset_', n_regionkey) AS asset, concat('c', n_nationkey % 4) AS column_name, concat('RUL-', n_nationkey % 7) AS rule_id, CASE WHEN n_nationkey % 3 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM nation"
_DECISIONS = "SELECT concat('GOV-DEC-', s_suppkey) AS decision_id, concat('GOV-ISS-', lpad(cast(s_nationkey AS {text}), 3, '0')) AS issue_id, CASE WHEN s_suppkey % 3 = 0 THEN 'REMEDIATION_AUTHORIZED' ELSE 'REMEDIATION_WITHHELD' END AS decision_type, CASE WHEN s_suppkey % 2 = 0 THEN 'EFFECTIVE' ELSE 'ACTIVE' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN concat('POL-', s_suppkey % 5) END AS policy_id, concat('actor', s_suppkey % 4) AS actor, DATE '2026-01-01' + cast(s_suppkey % 28 AS INT) AS decision_date FROM supplier"
_EVIDENCE = "SELECT concat('E', c_custkey) AS evidence_id, CASE WHEN c_custkey % 2 = 0 THEN 'ISSUE' ELSE 'DECISION' END AS parent_type, CASE WHEN c_custkey % 2 = 0 THEN concat('GOV-ISS-', lpad(cast(c_nationkey + CASE WHEN c_custkey % 5 = 0 THEN 20 ELSE 0 END AS {text}), 3, '0')) ELSE concat('GOV-DEC-', c_custkey % 150) END AS parent_id, CASE WHEN c_custkey % 4 < 2 THEN 'DQ_EXECUTION' ELSE 'METADATA' END AS evidence_type, concat('results/', c_custkey, '.json') AS path, concat('run-', c_custkey % 9) AS run_id, concat('RUL-', c_custkey % 7) AS rule_id, concat('POL-', c_custkey % 5) AS policy_id FROM customer"


def _gov(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Issues, decisions and evidence."""
    out = []
    for text, name in ((_ISSUES, "nation"), (_DECISIONS, "supplier"), (_EVIDENCE, "customer")):
        head, _, _ = text.format(text="string").rpartition(" FROM ")
        out.append(spark.sql(head + " FROM {t}", t=read(spark, d, name)))
    return tuple(out)


_GOV = f"WITH i AS ({_ISSUES}), d AS ({_DECISIONS}), e AS ({_EVIDENCE})".format(text="VARCHAR")


@query(f"{_GOV} SELECT * FROM i")
def gov_issues(spark, d):
    return _gov(spark, d)[0]


@query(f"{_GOV} SELECT * FROM i WHERE status = 'OPEN'")
def gov_open_issues(spark, d):
    return _gov(spark, d)[0].where("status = 'OPEN'")


@query(f"{_GOV} SELECT i.issue_id, rule_id, i.status AS issue_status, decision_id, decision_type, d.status AS decision_status FROM i JOIN d USING (issue_id)")
def gov_issue_decisions(spark, d):
    return governance.issue_decisions(*_gov(spark, d)[:2])


@query(f"{_GOV} SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.issue_id = i.issue_id AND d.decision_type = 'REMEDIATION_AUTHORIZED' AND d.status = 'EFFECTIVE')")
def gov_unauthorized(spark, d):
    return governance.unauthorized(*_gov(spark, d)[:2])


@query(f"{_GOV} SELECT DISTINCT i.issue_id, evidence_id, parent_type, evidence_type, path FROM i LEFT JOIN d USING (issue_id) JOIN e ON (parent_type = 'ISSUE' AND parent_id = i.issue_id) OR (parent_type = 'DECISION' AND parent_id = decision_id)")
def gov_evidence_or_join(spark, d):
    return governance.issue_evidence(*_gov(spark, d))


@query(f"{_GOV} SELECT e.* FROM e LEFT JOIN i ON parent_type = 'ISSUE' AND parent_id = i.issue_id LEFT JOIN d ON parent_type = 'DECISION' AND parent_id = decision_id WHERE i.issue_id IS NULL AND decision_id IS NULL")
def gov_parentless_evidence(spark, d):
    return governance.parentless(*_gov(spark, d))


_union = lambda parts: reduce(DataFrame.unionByName, parts)


@query("SELECT 'lineitem.l_orderkey' AS \"constraint\", count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'events.user_id', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def report_fk_violations(spark, d):
    return _union([constraints.foreign_key(read(spark, d, "lineitem"), "l_orderkey", read(spark, d, "orders"), "o_orderkey", "lineitem.l_orderkey"), constraints.foreign_key(read(spark, d, "events"), "user_id", read(spark, d, "customer"), "c_custkey", "events.user_id")])


@query("SELECT 'orders' AS \"constraint\", count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'lineitem', count(*) FROM (SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'customer.null', count(*) FROM customer WHERE c_custkey IS NULL")
def report_grain_violations(spark, d):
    return _union([constraints.duplicate_grain(read(spark, d, "orders"), ["o_orderkey"], "orders"), constraints.duplicate_grain(read(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], "lineitem"), constraints.null_keys(read(spark, d, "customer"), ["c_custkey"], "customer.null")])


@query("SELECT 'nation' AS \"constraint\", count(*) AS violations FROM customer c JOIN supplier s ON c_custkey = s_suppkey WHERE nullif(c_nationkey % 3, 0) IS DISTINCT FROM nullif(s_nationkey % 3, 0)")
def report_scope_mismatch(spark, d):
    third = lambda t, k, n: read(spark, d, t).select(F.col(k).alias("key"), F.expr(f"nullif({n} % 3, 0)").alias("third"))
    return constraints.scope_mismatch(third("customer", "c_custkey", "c_nationkey"), third("supplier", "s_suppkey", "s_nationkey"), "key", ["third"], "nation")


@query("(SELECT n_nationkey % 5 AS k, n_regionkey AS r FROM nation EXCEPT ALL SELECT r_regionkey, r_regionkey FROM region) UNION ALL (SELECT r_regionkey, r_regionkey FROM region EXCEPT ALL SELECT n_nationkey % 5, n_regionkey FROM nation)")
def report_roundtrip_diff(spark, d):
    return constraints.round_trip(read(spark, d, "nation").selectExpr("n_nationkey % 5 as k", "n_regionkey as r"), read(spark, d, "region").selectExpr("r_regionkey as k", "r_regionkey as r"))


@query(f"{_HISTORY} SELECT sha256(to_json([aggregation_level, run_id, asset, dimension])) AS summary_id, aggregation_level, run_id, asset, dimension, evaluations FROM ({' UNION ALL '.join(map(_level_sql, ('RUN', 'RUN_ASSET', 'RUN_DIMENSION')))})")
def summary_id_hash(spark, d):
    return levels(spark, d).where("aggregation_level like 'RUN%'").select(identity("", *map(F.col, ("aggregation_level", "run_id", "asset", "dimension"))).alias("summary_id"), "aggregation_level", "run_id", "asset", "dimension", "evaluations")


HEADER = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_phone"]}


@query("SELECT 'customer' AS asset, 'catalog_columns_in_raw' AS \"check\", 'c_phone' AS column_name UNION ALL SELECT 'customer', 'raw_columns_in_catalog', 'c_mktsegment'")
def catalog_header_diff(spark, d):
    """Declared columns against those that are there, in both directions."""
    rows = []
    for asset, declared in HEADER.items():
        there = read(spark, d, asset).columns
        rows += [(asset, "catalog_columns_in_raw", c) for c in declared if c not in there] + [(asset, "raw_columns_in_catalog", c) for c in there if c not in declared]
    return spark.createDataFrame(rows, "asset string, check string, column_name string")


EXPECTED = [("region", 5), ("nation", 25), ("customer", 1)]


@query("SELECT a.name, a.expected::BIGINT AS expected, n AS actual, CASE WHEN n = expected THEN 'PASSED' ELSE 'FAILED' END AS status FROM (VALUES ('region', 5), ('nation', 25), ('customer', 1)) a(name, expected) JOIN (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer) USING (name)")
def file_integrity(spark, d):
    found = _union([read(spark, d, n).agg(F.count(F.lit(1)).alias("actual")).select(F.lit(n).alias("name"), "actual") for n, _ in EXPECTED])
    return spark.createDataFrame(EXPECTED, "name string, expected long").join(found, "name").select("name", "expected", "actual", F.when(F.col("actual") == F.col("expected"), "PASSED").otherwise("FAILED").alias("status"))


DOCUMENTED = ["click", "error", "purchase", "signup", "refund"]


@query(f"WITH c AS (SELECT unnest({DOCUMENTED}) AS value), v AS (SELECT DISTINCT event_type AS value FROM events) SELECT value, c.value IS NOT NULL AS documented, v.value IS NOT NULL AS observed FROM c FULL JOIN v USING (value) WHERE c.value IS NULL OR v.value IS NULL")
def catalog_allowed_set_equality(spark, d):
    """Documented values and observed ones that have no counterpart."""
    c = spark.createDataFrame([(x,) for x in DOCUMENTED], "value string").withColumn("documented", F.lit(True))
    v = read(spark, d, "events").select(F.col("event_type").alias("value")).distinct().withColumn("observed", F.lit(True))
    no = lambda x: F.coalesce(F.col(x), F.lit(False))
    return c.join(v, "value", "full").select("value", no("documented").alias("documented"), no("observed").alias("observed")).where("not documented or not observed")


