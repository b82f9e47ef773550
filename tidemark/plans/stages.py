"""The stages as functions of a project folder: each returns its run record and writes it, whatever happens."""

from __future__ import annotations

import shutil
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import canonical, short_date
from ..operators import constraints, lineage, metrics, profiling, replay, rules, standardize, trace, validators
from ..operators.replay import Selection
from ..operators.rules import Rule
from ..operators.standardize import Policy
from ..sources import delimited, metadata, publication

ZONES = ("raw", "trusted", "snapshot")


@dataclass(frozen=True)
class Project:
    """Folders of a project; results of each process lie in results/<process>."""

    root: Path

    def path(self, *parts: str) -> Path:
        return Path(self.root).joinpath(*parts)

    def results(self, process: str) -> Path:
        return self.path("data/results", process)


def recorded(project: Project, process: str, prefix: str, head: dict, work: Callable[[dict], None]) -> dict:
    """Run a stage's work on a record; failures are recorded, and a record that cannot be written is a failure."""
    began = time.monotonic()
    errors = "execution_errors" if process == "dq" else "errors"
    record = {"run_id": publication.run_id(prefix), "started_at": publication.now(), "status": "SUCCESS", **head, errors: []}
    try:
        work(record)
    except Exception as e:
        record["status"] = "FAILED"
        record[errors].append(str(e))
    record |= {"completed_at": publication.now(), "elapsed_seconds": round(time.monotonic() - began, 6)}
    if not record.pop("_written", False):
        try:
            publication.write_record(record, project.results(process))
        except OSError as e:
            record["status"] = "FAILED"
            record[errors].append(f"record: {e}")
    return record


def ingest(project: Project, source: str | Path) -> dict:
    """Check existence, checksum and count of every file, then publish all or none."""

    def work(record: dict) -> None:
        _, files = metadata.load_manifest(project.path("config/dataset_manifest.yaml"))
        record |= {"files_expected": len(files), "files_processed": 0, "files": []}
        for f in files:
            path, bad = Path(source) / f["name"], []
            item = {"file_name": f["name"], "expected_sha256": f["sha256"], "expected_record_count": f["expected_record_count"]}
            if not path.is_file():
                bad.append("file is missing")
            else:
                item |= {"actual_sha256": delimited.sha256(path), "actual_record_count": delimited.record_count(path)}
                if item["actual_sha256"] != str(f["sha256"]).upper():
                    bad.append("sha256 differs")
                if item["actual_record_count"] != f["expected_record_count"]:
                    bad.append("record count differs")
            item |= {"validation_status": "FAILED" if bad else "PASSED"} | ({"message": "; ".join(bad)} if bad else {})
            record["files"].append(item)
        if bad := [x["file_name"] + ": " + x["message"] for x in record["files"] if "message" in x]:
            raise ValueError("; ".join(bad))
        publication.publish(project.path("data/raw"), lambda to: [shutil.copyfile(Path(source) / f["name"], to / f["name"]) for f in files])
        record["files_processed"] = len(files)

    return recorded(project, "ingestion", "", {"source_path": str(source), "raw_path": "data/raw"}, work)


def tables_of(spark: SparkSession, m: metadata.Metadata, folder: Path, names: set[str] | None = None) -> dict[str, DataFrame]:
    """Lazy scans of the named assets; a missing file is an error now."""
    out = {}
    for a in m.assets.values():
        if names is None or a.name in names:
            if not (folder / a.source_file).is_file():
                raise FileNotFoundError(f"{a.source_file} is missing")
            out[a.name] = delimited.scan(spark, folder / a.source_file, a.columns, m.format)
    return out


def profile(spark: SparkSession, project: Project, raw: str | Path | None = None) -> dict:
    def work(record: dict) -> None:
        m = metadata.load(project.root)
        record["tables"] = []
        for name, df in tables_of(spark, m, Path(raw or project.path("data/raw"))).items():
            found = [r.asDict() for r in profiling.profile(df).collect()]
            first: dict[str, list[str]] = {c: [] for c in df.columns}
            for r in profiling.profile_samples(df).orderBy("column_name", "rank").collect():
                first[r.column_name].append(r.value)
            by_name = {r["column_name"]: r | {"sample_values": first[r["column_name"]]} for r in found}
            record["tables"].append({"file_name": m.assets[name].source_file, "row_count": found[0]["total_count"] if found else 0, "column_count": len(df.columns), "columns": [by_name[c] for c in df.columns]})
        record |= {"files_expected": len(m.files), "files_profiled": len(record["tables"])}

    return recorded(project, "profiling", "", {"raw_path": str(raw or "data/raw")}, work)


def check_catalog(project: Project) -> dict:
    def work(record: dict) -> None:
        m = metadata.load(project.root)
        found = metadata.catalog_checks(m, project.path("data/raw"))
        record |= {"checks": [{"name": k, "status": "FAILED" if v else "PASSED"} for k, v in found.items()], "assets_expected": len(m.files), "assets_validated": len(m.assets), "relationships_validated": len(m.relationships)}
        record["errors"] += [{"check": k, "message": x} for k, v in found.items() for x in v]
        if record["errors"]:
            record["status"] = "FAILED"

    return recorded(project, "catalog", "", {}, work)


def cutoff_of(zone: str, cutoff: str | None) -> None:
    """A cutoff belongs to snapshots alone; it labels a run and never filters rows."""
    if zone not in ZONES:
        raise ValueError(f"unknown zone: {zone}")
    if zone == "snapshot":
        if not cutoff or date.fromisoformat(cutoff).isoformat() != cutoff:
            raise ValueError("a snapshot needs a cutoff in ISO form")
    elif cutoff is not None:
        raise ValueError("only a snapshot has a cutoff")


def check_quality(spark: SparkSession, project: Project, zone: str = "raw", path: str | Path | None = None, cutoff: str | None = None) -> dict:
    """All declared rules over a zone; a rule that fails is a result, not a failed run."""
    folder = Path(path) if path else None if zone == "snapshot" else project.path("data", zone)

    def work(record: dict) -> None:
        cutoff_of(zone, cutoff)
        if folder is None:
            raise ValueError("a snapshot needs its data path")
        m = metadata.load(project.root)
        declared = metadata.load_list(project.path("metadata/dq_rules"), "rules")
        if bad := metadata.rule_errors(declared, m):
            raise ValueError("; ".join(bad))
        some = [Rule.declared(d) for d in declared]
        tables = tables_of(spark, m, folder, {r.asset for r in some} | {r.target[0] for r in some if r.target[0]})
        results = {r.rule_id: r.asDict() for r in rules.rule_results(tables, some).collect()}
        first: dict[str, list[str]] = {r.rule_id: [] for r in some}
        failing = [r for r in some if results[r.rule_id]["violations"]]
        for r in rules.samples(tables, failing).orderBy("rule_id", "rank").collect() if failing else ():
            first[r.rule_id].append(r.value)
        for r in some:
            x = results[r.rule_id]
            record["rule_results"].append({k: x[k] for k in ("rule_id", "asset")} | {"column": x["column_name"]} | {k: x[k] for k in ("dimension", "expectation_type", "empty_policy", "status", "rows_total", "rows_evaluated", "violations", "compliance_ratio")} | {"sample_violations": first[r.rule_id]})
        passed = sum(x["status"] == "PASSED" for x in record["rule_results"])
        record |= {"rules_total": len(some), "rules_passed": passed, "rules_failed": len(some) - passed}

    head = {"data_zone": zone, "data_path": str(folder) if folder else None, "snapshot_cutoff": cutoff, "rules_total": 0, "rules_passed": 0, "rules_failed": 0, "rule_results": []}
    return recorded(project, "dq", "", head, work)


def _write_lines(head: bytes, df: DataFrame, column: str, source: Path, target: Path) -> None:
    """Lines in their order, streamed; the last line ends as the source's does."""
    with open(source, "rb") as f:
        f.seek(0, 2)
        size = f.tell()
        f.seek(max(0, size - 1))
        ended = f.read(1) == b"\n"
    last = df.sparkSession.read.option("lineSep", "\n").text(str(source)).count() - 1
    with open(target, "wb") as out:
        out.write(head)
        for r in df.orderBy("_line_no").select("_line_no", column).toLocalIterator():
            out.write(r[1].encode() + (b"" if r[0] == last and not ended else b"\n"))


def _head(path: Path) -> bytes:
    with open(path, "rb") as f:
        return f.readline()


def standardize_zone(spark: SparkSession, project: Project) -> dict:
    """RAW to TRUSTED: authorized replacements token by token, all else byte for byte."""

    def work(record: dict) -> None:
        m, raw = metadata.load(project.root), project.path("data/raw")
        declared = metadata.load_list(project.path("metadata/standardization"), "policies")
        if bad := metadata.policy_errors(declared, m):
            raise ValueError("; ".join(bad))
        policies = [Policy.declared(d) for d in declared]
        touched = {p.asset for p in policies}

        def fill(to: Path) -> None:
            for a in m.assets.values():
                if a.name not in touched:
                    shutil.copyfile(raw / a.source_file, to / a.source_file)
                    if delimited.sha256(raw / a.source_file) != delimited.sha256(to / a.source_file):
                        raise ValueError(f"{a.source_file} differs after copying")
                    continue
                own = [p for p in policies if p.asset == a.name]
                rows = delimited.lines(spark, raw / a.source_file, a.columns, m.format)
                after = standardize.standardize(rows.select("*", *[F.col(c).alias(f"_old_{c}") for c in a.columns]), own)
                changed = [F.when(F.col(c).eqNullSafe(F.col(f"_old_{c}")), F.col("_t")[i]).otherwise(delimited.encoded(F.col(c), F.col("_t")[i], m.format)) for i, c in enumerate(a.columns)]
                line = F.concat(F.concat_ws(m.format.delimiter, *changed), F.when(F.col("_raw_line").endswith("\r"), "\r").otherwise(""))
                _write_lines(_head(raw / a.source_file), after.withColumn("_line", line), "_line", raw / a.source_file, to / a.source_file)
                if delimited.record_count(to / a.source_file) != delimited.record_count(raw / a.source_file) or delimited.header(to / a.source_file, m.format) != a.columns:
                    raise ValueError(f"{a.source_file} has other rows or columns after standardization")
                seen = standardize.changes(rows, own)
                pairs: dict[str, list[dict]] = {p.policy_id: [] for p in own}
                for r in standardize.sample_changes(seen).orderBy("policy_id", "rank").collect():
                    pairs[r.policy_id].append({"before": r.before, "after": r.after})
                counts = {r.policy_id: r.asDict() for r in standardize.policy_metrics(seen).collect()}
                for p in own:
                    n = counts.get(p.policy_id, dict.fromkeys(("rows_total", "rows_evaluated", "rows_changed", "rows_unchanged"), 0))
                    record["policy_results"].append({"policy_id": p.policy_id, "asset": p.asset, "column": p.column, "transformation_type": "regex_replace", **{k: n[k] for k in ("rows_total", "rows_evaluated", "rows_changed", "rows_unchanged")}, "sample_changes": pairs[p.policy_id]})

        publication.publish(project.path("data/trusted"), fill)
        record |= {"policies_applied": len(policies), "policies_total": len(policies), "assets_total": len(m.assets), "assets_transformed": len(touched), "assets_copied": len(m.assets) - len(touched)}

    return recorded(project, "standardization", "std-", {"trusted_path": "data/trusted", "policy_results": []}, work)


def replay_selections(m: metadata.Metadata, doc: dict) -> tuple[list[Selection], dict[str, str]]:
    """Declared selections over text columns; dates are YYMMDD of the 1900s."""
    if set(doc) != set(m.assets):
        raise ValueError("replay policies must name exactly the catalog's assets")
    known = {frozenset(((r["from"]["asset"], r["from"]["column"]), (r["to"]["asset"], r["to"]["column"]))) for r in m.relationships}
    out, dates = [], {}
    for name, p in doc.items():
        strategy, when = p.get("strategy"), p.get("temporal")
        if strategy not in ("temporal", "reference", "temporal_and_reference", "static") or ("temporal" in strategy) != bool(when) or ("reference" in strategy) != bool(p.get("references")):
            raise ValueError(f"{name}: strategy and its parts disagree")
        if when:
            if when.get("format") != "YYMMDD" or when.get("century") != 1900 or when.get("column") not in m.assets[name].columns or not m.assets[name].facts[when["column"]].get("documented_format"):
                raise ValueError(f"{name}: only documented YYMMDD columns of the 1900s are dates")
            dates[name] = when["column"]
        refs = []
        for r in p.get("references") or ():
            if frozenset(((name, r["column"]), (r["asset"], r["target_column"]))) not in known:
                raise ValueError(f"{name}.{r['column']}: no such relationship")
            refs.append((r["column"], r["asset"], r["target_column"]))
        out.append(Selection(name, short_date(F.col(dates[name])) if when else None, tuple(refs)))
    replay.order(out)
    return out, dates


def snapshot_at(spark: SparkSession, project: Project, cutoff: str, zone: str = "trusted") -> dict:
    """A snapshot of a zone: rows are checked before they are filtered, and the record is written before the old snapshot goes."""
    target = project.path("data/snapshots", cutoff)

    began = time.monotonic()

    def work(record: dict) -> None:
        if date.fromisoformat(cutoff).isoformat() != cutoff:
            raise ValueError("the cutoff must be in ISO form")
        m, source = metadata.load(project.root), project.path("data", zone)
        selections, dates = replay_selections(m, metadata.load_yaml(project.path("metadata/replay/historical_snapshot.yaml"))["assets"])
        before = {a.source_file: delimited.sha256(source / a.source_file) for a in m.assets.values()}
        tables = {a.name: delimited.lines(spark, source / a.source_file, a.columns, m.format) for a in m.assets.values()}
        checks = [constraints._count(tables[n].where(short_date(F.col(c)).isNull()), f"{n}.{c}: invalid date") for n, c in dates.items()]
        for r in m.relationships:
            (a, c), (b, k) = (r["from"]["asset"], r["from"]["column"]), (r["to"]["asset"], r["to"]["column"])
            checks.append(constraints._count(replay.orphans(tables[a], c, tables[b], k), f"{a}.{c}: orphans"))
        if checks:
            constraints.require_none(reduce(DataFrame.unionByName, checks))
        selected = replay.snapshot(tables, selections, cutoff)
        counted = {r.asset: r for r in replay.counts(tables, selected, selections).collect()}
        record["assets"] = [{"asset": s.asset, "strategy": s.strategy, "input_rows": counted[s.asset].input_rows, "output_rows": counted[s.asset].output_rows} for s in selections]

        def fill(to: Path) -> None:
            for s in selections:
                f = m.assets[s.asset].source_file
                if s.strategy == "static" or counted[s.asset].input_rows == counted[s.asset].output_rows:
                    shutil.copyfile(source / f, to / f)
                else:
                    _write_lines(_head(source / f), selected[s.asset], "_raw_line", source / f, to / f)
                if delimited.record_count(to / f) != counted[s.asset].output_rows:
                    raise ValueError(f"{f}: another number of rows than selected")
            if before != {f: delimited.sha256(source / f) for f in before}:
                raise ValueError("the source changed meanwhile")

        def commit() -> None:
            publication.write_record({k: v for k, v in record.items() if k != "_written"} | {"completed_at": publication.now(), "elapsed_seconds": round(time.monotonic() - began, 6)}, project.results("replay"))
            record["_written"] = True

        publication.publish(target, fill, commit)

    return recorded(project, "replay", "replay-", {"cutoff": cutoff, "source_zone": zone, "source_path": f"data/{zone}", "snapshot_path": f"data/snapshots/{cutoff}", "assets": []}, work)


def run_records(project: Project, process: str) -> list[dict]:
    """Records of a process, strictly read: unique keys, a name that is the run's, known status, ordered times, and the fields of a quality run."""
    out, seen = [], {}
    for path in sorted(project.results(process).glob("*.json")):
        r = metadata.load_json(path)
        if bad := validators.record_errors(r, process):
            raise ValueError(f"{path.name}: {bad[0]}")
        if path.stem != r["run_id"]:
            raise ValueError(f"{path.name}: its run_id is {r['run_id']}")
        if r["run_id"] in seen:
            raise ValueError(f"{path.name}: run_id {r['run_id']} is that of {seen[r['run_id']]}")
        seen[r["run_id"]] = path.name
        out.append(r | {"source_record": path.name})
    return out


_RESULT = "rule_id string, asset string, column string, dimension string, expectation_type string, empty_policy string, status string, rows_total long, rows_evaluated long, violations long, compliance_ratio double, sample_violations array<string>"
SCHEMAS = {
    "ingestion": "run_id string, started_at string, completed_at string, elapsed_seconds double, status string, source_path string, raw_path string, files_expected long, files_processed long, files array<struct<file_name:string,expected_sha256:string,actual_sha256:string,expected_record_count:bigint,actual_record_count:bigint,validation_status:string>>, source_record string",
    "dq": f"run_id string, started_at string, completed_at string, elapsed_seconds double, status string, rules_total long, rules_passed long, rules_failed long, data_zone string, data_path string, snapshot_cutoff string, execution_errors array<string>, rule_results array<struct<{_RESULT.replace(' long', ':bigint').replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>, source_record string",
    "standardization": "run_id string, started_at string, completed_at string, elapsed_seconds double, status string, policies_total long, policies_applied long, assets_total long, assets_copied long, assets_transformed long, trusted_path string, policy_results array<struct<policy_id:string,asset:string,column:string,transformation_type:string,rows_total:bigint,rows_evaluated:bigint,rows_changed:bigint,rows_unchanged:bigint,sample_changes:array<struct<before:string,after:string>>>>, source_record string",
    "replay": "run_id string, started_at string, completed_at string, elapsed_seconds double, status string, cutoff string, source_zone string, source_path string, snapshot_path string, assets array<struct<asset:string,strategy:string,input_rows:bigint,output_rows:bigint>>, source_record string",
}


def frame(spark: SparkSession, project: Project, process: str) -> DataFrame:
    """Records of a process with explicit types; absent fields are null."""
    import json

    rows = [(json.dumps(r),) for r in run_records(project, process)]
    return spark.createDataFrame(rows, "j string").select(F.from_json("j", SCHEMAS[process]).alias("r")).select("r.*")


_ntz = lambda c: F.to_timestamp(F.col(c)).cast("timestamp_ntz")


def history(spark: SparkSession, project: Project) -> dict[str, DataFrame]:
    """dq_runs and dq_rule_results."""
    r = frame(spark, project, "dq")
    head = r.select("run_id", _ntz("started_at").alias("started_at"), _ntz("completed_at").alias("completed_at"), "elapsed_seconds", "status", "rules_total", "rules_passed", "rules_failed", F.coalesce(F.size("execution_errors"), F.lit(0)).cast("long").alias("execution_error_count"), "source_record", "data_zone", "data_path", F.to_date("snapshot_cutoff").alias("snapshot_cutoff"))
    x = r.select("run_id", F.explode("rule_results").alias("x"), "source_record")
    return {"dq_runs": head, "dq_rule_results": x.select("run_id", "x.rule_id", "x.asset", F.col("x.column").alias("column_name"), "x.dimension", "x.expectation_type", "x.empty_policy", "x.status", "x.rows_total", "x.rows_evaluated", "x.violations", "x.compliance_ratio", F.to_json("x.sample_violations").alias("sample_violations"), "source_record")}


def metric_tables(spark: SparkSession, project: Project) -> dict[str, DataFrame]:
    h = history(spark, project)
    results = h["dq_rule_results"].drop("source_record", "sample_violations")
    constraints.require_none(validators.evaluation_checks(h["dq_runs"], results))
    rows = metrics.evaluations(h["dq_runs"], results)
    levels = metrics.aggregate(rows)
    return {"dq_evaluation_metrics": rows, "dq_aggregate_metrics": levels, **metrics.snapshot_views(rows, levels)}


def traces(spark: SparkSession, project: Project) -> dict[str, DataFrame]:
    """execution_runs, execution_metrics, execution_details over four processes."""
    runs, numbers, details = [], [], []
    for process in SCHEMAS:
        r = frame(spark, project, process)
        col = lambda c, r=r: F.col(c) if c in r.columns else F.lit(None).cast("string")
        zone, cut = (("data_zone", "snapshot_cutoff") if process == "dq" else ("source_zone", "cutoff") if process == "replay" else ("-", "-"))
        source = col({"dq": "data_path"}.get(process, "source_path"))
        output = col({"ingestion": "raw_path", "standardization": "trusted_path", "replay": "snapshot_path"}.get(process, "-"))
        runs.append(r.select("run_id", F.lit(process).alias("process_type"), "status", _ntz("started_at").alias("started_at"), _ntz("completed_at").alias("completed_at"), "elapsed_seconds", col(zone).alias("data_zone"), F.to_date(col(cut)).alias("snapshot_cutoff"), source.alias("source_path"), output.alias("output_path"), F.concat(F.lit(f"data/results/{process}/"), "source_record").alias("execution_record_path")))
        numbers.append(trace.metrics(r, process))
        details.append(trace.details(r, process))
    union = lambda x: reduce(DataFrame.unionByName, x)
    return {"execution_runs": union(runs), "execution_metrics": union(numbers), "execution_details": union(details)}


def lineage_tables(spark: SparkSession, project: Project) -> dict[str, DataFrame]:
    """Nodes and edges of the declared metadata, valid as a graph; the code that flows stand for must be there."""
    validators.require_contracts()
    m = metadata.load(project.root)
    declared, policies = metadata.load_list(project.path("metadata/dq_rules"), "rules"), metadata.load_list(project.path("metadata/standardization"), "policies")
    ref = lambda kind, name: [canonical({"kind": kind, "name": name})]
    make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", evidence array<string>")
    parts = (
        make([(a, ref("asset", a)) for a in m.assets], ["asset"]), make([(r["id"], r["asset"], r["column"], ref("rule", r["id"])) for r in declared], ["rule_id", "asset", "column_name"]), make([(p["id"], p["asset"], p["column"], ref("policy", p["id"])) for p in policies], ["policy_id", "asset", "column_name"]),
        make([(r["name"], r["from"]["asset"], r["from"]["column"], r["to"]["asset"], r["to"]["column"], ref("relationship", r["name"])) for r in m.relationships], ["name", "from_asset", "from_column", "to_asset", "to_column"]),
    )
    n, e = lineage.nodes(*parts), lineage.edges(*parts)
    constraints.require_none(validators.graph_checks(n, e))
    return {"lineage_nodes": n, "lineage_edges": e}


def published(spark: SparkSession, project: Project, layer: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a published layer; a missing one is an error."""
    out = {}
    for name in names:
        path = project.path("data", layer, name)
        if not path.is_dir():
            raise FileNotFoundError(f"data/{layer}/{name} is missing: publish {layer} first")
        out[name] = spark.read.parquet(str(path))
    return out


#: Statuses and kinds of governance declarations; fixed values.
ISSUE_STATUS, DECISION_TYPE, DECISION_STATUS = {"OPEN", "RESOLVED"}, {"REMEDIATION_AUTHORIZED", "REMEDIATION_WITHHELD"}, {"EFFECTIVE", "ACTIVE"}


def governance_tables(spark: SparkSession, project: Project) -> dict[str, DataFrame]:
    """Issues, decisions and evidence; scopes, statuses and evidence paths are checked first."""
    import hashlib

    rules_ = {r["id"]: r for r in metadata.load_list(project.path("metadata/dq_rules"), "rules")}
    policies = {p["id"]: p for p in metadata.load_list(project.path("metadata/standardization"), "policies")}
    issues = metadata.load_yaml(project.path("metadata/governance/issues.yaml"))["issues"]
    decisions = metadata.load_yaml(project.path("metadata/governance/decisions.yaml"))["decisions"]
    by_id, evidence, rows, ruled = {}, {}, [], []

    def require(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(what)

    def add(kind: str, name: str, refs: list[dict], scope: dict) -> None:
        for e in refs:
            path = metadata.need_text(e.get("path"), f"{name}: evidence path")
            require(not path.startswith("/") and "\\" not in path and ":" not in path and ".." not in path.split("/") and project.path(path).is_file(), f"{name}: unsafe or missing evidence {path}")
            fields = [kind, name, e.get("type"), path, e.get("run_id"), e.get("rule_id"), e.get("policy_id")]
            if bad := validators.evidence_errors(project.path(path), e, scope):
                raise ValueError(f"{name}: {bad[0]}")
            key = "evidence:" + hashlib.sha256(canonical(fields).encode()).hexdigest()
            require(key not in evidence, f"{name}: evidence twice")
            evidence[key] = (key, *fields, e.get("description") or "")

    for i in issues:
        require(i["issue_id"] not in by_id and i.get("status") in ISSUE_STATUS, f"{i['issue_id']}: duplicate or unknown status")
        r = rules_.get(i.get("rule_id"))
        require(r is not None and (r["asset"], r["column"]) == (i["asset"], i["column"]), f"{i['issue_id']}: its rule has another scope")
        by_id[i["issue_id"]] = i
        rows.append((i["issue_id"], i["asset"], i["column"], i["rule_id"], i["status"], metadata.need_text(i.get("description"), "description")))
        add("ISSUE", i["issue_id"], i.get("evidence") or [], {"asset": i["asset"], "column": i["column"], "rule_id": i["rule_id"]})
    for d in decisions:
        name, p = d["decision_id"], d.get("policy_id")
        require(d.get("issue_id") in by_id and d.get("decision_type") in DECISION_TYPE and d.get("status") in DECISION_STATUS, f"{name}: unknown issue, type or status")
        require(d["decision_type"] != "REMEDIATION_AUTHORIZED" or p is not None, f"{name}: an authorization names its policy")
        if p is not None:
            i = by_id[d["issue_id"]]
            require(p in policies and (policies[p]["asset"], policies[p]["column"]) == (i["asset"], i["column"]), f"{name}: its policy has another scope")
        ruled.append((name, d["issue_id"], d["decision_type"], d["status"], p, d.get("decision_date") and date.fromisoformat(str(d["decision_date"])), d.get("actor"), metadata.need_text(d.get("rationale"), "rationale")))
        i = by_id[d["issue_id"]]
        add("DECISION", name, d.get("evidence") or [], {"asset": i["asset"], "column": i["column"], "rule_id": i["rule_id"], "policy_id": p})
    require(len({r[0] for r in ruled}) == len(ruled), "duplicate decision_id")
    for i in by_id.values():
        require(i["status"] != "RESOLVED" or any(r[1] == i["issue_id"] and r[3] == "EFFECTIVE" for r in ruled), f"{i['issue_id']}: resolved without an effective decision")
    make = spark.createDataFrame
    return {
        "governance_issues": make(rows, "issue_id string, asset string, column_name string, rule_id string, status string, description string"),
        "governance_decisions": make(ruled, "decision_id string, issue_id string, decision_type string, status string, policy_id string, decision_date date, actor string, rationale string"),
        "governance_evidence": make(list(evidence.values()), "evidence_id string, parent_type string, parent_id string, evidence_type string, path string, run_id string, rule_id string, policy_id string, description string"),
    }


KEYS = {"assets": ["asset"], "rules": ["rule_id"], "dq_evaluations": ["run_id", "rule_id"], "dq_summaries": ["summary_id"], "governance_issues": ["issue_id"], "governance_decisions": ["decision_id"], "execution_runs": ["run_id"], "execution_details": ["detail_id"]}
FOREIGN = [("rules", "asset", "assets"), ("dq_evaluations", "asset", "assets"), ("dq_evaluations", "rule_id", "rules"), ("governance_issues", "asset", "assets"), ("governance_issues", "rule_id", "rules"), ("governance_decisions", "issue_id", "governance_issues"), ("dq_evaluations", "run_id", "execution_runs"), ("dq_summaries", "run_id", "execution_runs"), ("execution_details", "run_id", "execution_runs"), ("execution_details", "asset", "assets"), ("dq_summaries", "asset", "assets")]


def report_tables(spark: SparkSession, project: Project) -> dict[str, DataFrame]:
    """Eight reporting tables over four published layers, cross-validated."""
    from ..functions.expressions import identity

    n, g = published(spark, project, "lineage", "lineage_nodes")["lineage_nodes"], published(spark, project, "governance", "governance_issues", "governance_decisions")
    m, t = published(spark, project, "metrics", "dq_evaluation_metrics", "dq_aggregate_metrics"), published(spark, project, "traceability", "execution_runs", "execution_details")
    policies = n.where("node_type = 'standardization_policy'").select(F.col("semantic_id").alias("policy_id"), F.col("asset").alias("policy_asset"), F.col("column_name").alias("policy_column"))
    levels = m["dq_aggregate_metrics"].where("aggregation_level in ('RUN', 'RUN_ASSET', 'RUN_DIMENSION')")
    out = {
        "assets": n.where("node_type = 'asset' and zone = 'source'").select("asset", "node_id"), "rules": n.where("node_type = 'dq_rule'").select(F.col("semantic_id").alias("rule_id"), "asset", "column_name", "node_id"), "dq_evaluations": m["dq_evaluation_metrics"],
        "dq_summaries": levels.select(identity("", *map(F.col, ("aggregation_level", "run_id", "asset", "dimension"))).alias("summary_id"), "*"), "governance_issues": g["governance_issues"], "governance_decisions": g["governance_decisions"].join(policies, "policy_id", "left").select(*g["governance_decisions"].columns, "policy_asset", "policy_column"),
        "execution_runs": t["execution_runs"], "execution_details": t["execution_details"],
    }
    checks = [constraints.null_keys(out[k], v, f"{k}: null key") for k, v in KEYS.items()] + [constraints.duplicate_grain(out[k], v, f"{k}: duplicate grain") for k, v in KEYS.items()]
    checks += [constraints.foreign_key(out[c], fk, out[p], fk, f"{c}.{fk}") for c, fk, p in FOREIGN]
    checks += [constraints.scope_mismatch(out[c], out["rules"], "rule_id", ["asset", "column_name"], f"{c}: rule scope") for c in ("dq_evaluations", "governance_issues")]
    scope = out["governance_issues"].select("issue_id", F.col("asset").alias("policy_asset"), F.col("column_name").alias("policy_column"))
    checks.append(constraints.scope_mismatch(out["governance_decisions"].where("policy_id is not null"), scope, "issue_id", ["policy_asset", "policy_column"], "decision: policy scope"))
    identity_of = out["execution_runs"].where("process_type = 'dq'")
    checks += [constraints.scope_mismatch(out["dq_evaluations"], identity_of, "run_id", ["started_at", "data_zone", "snapshot_cutoff"], "evaluations: run identity"), constraints.scope_mismatch(out["dq_summaries"], identity_of, "run_id", ["data_zone", "snapshot_cutoff"], "summaries: run identity")]
    constraints.require_none(reduce(DataFrame.unionByName, checks))
    return out


def publish_layer(project: Project, name: str, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> dict:
    """Write a layer's tables below data/<name>, whole or not at all."""
    publication.publish_tables(tables, project.path("data", name), keys)
    return {"status": "SUCCESS", "tables": sorted(tables)}


#: Metadata that a project cannot do without; fixed values.
REQUIRED = ("config/dataset_manifest.yaml", "metadata/relationships.yaml", "metadata/replay/historical_snapshot.yaml", "metadata/governance/issues.yaml", "metadata/governance/decisions.yaml")


def preflight(project: Project, source: str | Path) -> None:
    """Raise with the name of every folder, file, catalog or evidence that the stages would miss."""
    lacking = [x for x in REQUIRED if not project.path(x).is_file()] + [f"metadata/{x}" for x in ("dq_rules", "standardization") if not any(project.path("metadata", x).glob("*.yaml"))]
    if not Path(source).is_dir():
        lacking.append(f"source folder {source}")
    if project.path(REQUIRED[0]).is_file():
        _, files = metadata.load_manifest(project.path(REQUIRED[0]))
        for f in files:
            if Path(f["name"]).name != f["name"]:
                lacking.append(f"a plain file name instead of {f['name']}")
            elif not (Path(source) / f["name"]).is_file():
                lacking.append(f"source file {f['name']}")
            if not project.path("metadata/catalog", f"{Path(f['name']).stem}.yaml").is_file():
                lacking.append(f"metadata/catalog/{Path(f['name']).stem}.yaml")
    if lacking:
        raise FileNotFoundError("missing: " + ", ".join(lacking))


def demo(spark: SparkSession, project: Project, source: str | Path, years: tuple[int, ...] = (1993, 1994, 1995, 1996, 1997, 1998)) -> list[tuple[str, dict]]:
    """Every stage in order; the first that fails is the last. What all of them need is looked for before the first."""
    preflight(project, source)
    steps: list[tuple[str, Callable[[], dict]]] = [("ingestion", lambda: ingest(project, source)), ("profiling", lambda: profile(spark, project)), ("catalog", lambda: check_catalog(project)), ("dq raw", lambda: check_quality(spark, project)), ("standardization", lambda: standardize_zone(spark, project)), ("dq trusted", lambda: check_quality(spark, project, "trusted"))]
    for y in years:
        cut = f"{y}-12-31"
        steps += [(f"replay {cut}", lambda cut=cut: snapshot_at(spark, project, cut)), (f"dq {cut}", lambda cut=cut: check_quality(spark, project, "snapshot", project.path("data/snapshots", cut), cut))]
    layers = (("lineage", lineage_tables, None), ("traceability", traces, None), ("observability", history, None), ("metrics", metric_tables, None), ("governance", governance_tables, None), ("reporting", report_tables, KEYS))
    steps += [(name, lambda name=name, f=f, keys=keys: publish_layer(project, name, f(spark, project), keys)) for name, f, keys in layers]
    done = []
    for name, step in steps:
        done.append((name, step()))
        if done[-1][1]["status"] != "SUCCESS":
            break
    return done
