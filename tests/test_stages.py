"""All stages over a small project folder: bytes, counts, failures and published tables."""

import json
import os

import pytest
import yaml

from tidemark.plans import stages
from tidemark.sources import delimited, metadata, publication

#: A harbour: voyages, their crates and berths, pilots of berths, permits whose dates need a standard form.
FILES = {
    "voyage.asc": b'"voyage_no";"sailed"\n501;870314\n502;880229\n503;"871130"\n',
    "crate.asc": b'crate_no;voyage_no;loaded;contents\r\nC1;501;870310;"tea; green"\r\nC2;503;871201;salt\r\nC3;502;880227;" rope "\r\nC4;503;871129;""\r\n',
    "berth.asc": b"berth_no;voyage_no\nB1;503\nB2;502\nB3;501",
    "pilot.asc": b'"berth_no";"name"\r\nB1;"Noor"\r\nB2;Ruth\r\nB3;"Lee ""Jr"""\r\n',
    "tariff.asc": b'code;text\nT1;"per ton, or part"\n',
    "permit.asc": b'"permit_no";"issued"\nP7;880101T0000\nP8;"870704T0000"\nP9;870705T1200\n',
}
COLUMNS = {"voyage": ["voyage_no", "sailed"], "crate": ["crate_no", "voyage_no", "loaded", "contents"], "berth": ["berth_no", "voyage_no"], "pilot": ["berth_no", "name"], "tariff": ["code", "text"], "permit": ["permit_no", "issued"]}
DATES = ("sailed", "loaded", "issued")
CUT = "1987-12-31"


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(value, sort_keys=False))


@pytest.fixture
def project(tmp_path):
    root, source = tmp_path / "p", tmp_path / "source"
    source.mkdir()
    for name, data in FILES.items():
        (source / name).write_bytes(data)
    dump(root / "config/dataset_manifest.yaml", {"dataset": {"physical_format": {"delimiter": ";", "text_qualifier": '"', "header": True}, "files": [{"name": f, "sha256": delimited.sha256(source / f), "expected_record_count": delimited.record_count(source / f)} for f in FILES]}})
    for a, columns in COLUMNS.items():
        facts = [{"name": c, "description": c} | ({"documented_format": "YYMMDD"} if c in DATES else {}) for c in columns]
        dump(root / f"metadata/catalog/{a}.yaml", {"asset": {"name": a, "source_file": f"{a}.asc"}, "columns": facts})
    link = lambda n, a, c, b, k: {"name": n, "from": {"asset": a, "column": c}, "to": {"asset": b, "column": k}}
    dump(root / "metadata/relationships.yaml", {"relationships": [link("crate_on_voyage", "crate", "voyage_no", "voyage", "voyage_no"), link("berth_of_voyage", "berth", "voyage_no", "voyage", "voyage_no"), link("berth_has_pilot", "berth", "berth_no", "pilot", "berth_no")]})
    rule = lambda i, a, c, d, e, p="evaluate": {"id": i, "asset": a, "column": c, "dimension": d, "expectation": e, "empty_policy": p, "evidence": {"type": "catalog"}}
    dump(root / "metadata/dq_rules/harbour.yaml", {"rules": [rule("PMT-VAL-001", "permit", "issued", "validity", {"type": "regex_format", "pattern": r"^\d{6}$"}), rule("PLT-VAL-001", "pilot", "name", "validity", {"type": "allowed_values", "values": ["Ruth"]}), rule("VOY-UNI-001", "voyage", "voyage_no", "uniqueness", {"type": "unique"}), rule("CRT-RI-001", "crate", "voyage_no", "referential_integrity", {"type": "reference_exists", "asset": "voyage", "column": "voyage_no"})]})
    dump(root / "metadata/standardization/permit.yaml", {"policies": [{"id": "PMT-STD-001", "asset": "permit", "column": "issued", "transformation": {"type": "regex_replace", "pattern": r"^(\d{6})T0000$", "replacement": r"\1"}, "evidence": {"type": "catalog", "reference": "permit.issued"}}]})
    when, ref = lambda c: {"column": c, "format": "YYMMDD", "century": 1900}, lambda c, a, k: {"column": c, "asset": a, "target_column": k}
    dump(root / "metadata/replay/historical_snapshot.yaml", {"assets": {"tariff": {"strategy": "static"}, "pilot": {"strategy": "reference", "references": [ref("berth_no", "berth", "berth_no")]}, "berth": {"strategy": "reference", "references": [ref("voyage_no", "voyage", "voyage_no")]}, "crate": {"strategy": "temporal_and_reference", "temporal": when("loaded"), "references": [ref("voyage_no", "voyage", "voyage_no")]}, "permit": {"strategy": "static"}, "voyage": {"strategy": "temporal", "temporal": when("sailed")}}})
    dump(root / "metadata/governance/issues.yaml", {"issues": [{"issue_id": "H-1", "asset": "permit", "column": "issued", "rule_id": "PMT-VAL-001", "status": "RESOLVED", "description": "times in dates", "evidence": [{"type": "METADATA", "path": "metadata/dq_rules/harbour.yaml", "description": "rule"}]}, {"issue_id": "H-2", "asset": "pilot", "column": "name", "rule_id": "PLT-VAL-001", "status": "OPEN", "description": "unknown pilots"}]})
    dump(root / "metadata/governance/decisions.yaml", {"decisions": [{"decision_id": "H-D1", "issue_id": "H-1", "decision_type": "REMEDIATION_AUTHORIZED", "status": "EFFECTIVE", "policy_id": "PMT-STD-001", "decision_date": "2026-02-03", "rationale": "one form"}]})
    return stages.Project(root), source


def test_every_stage_in_order(spark, project):
    p, source = project
    done = stages.demo(spark, p, source, years=(1987,))
    assert [r["status"] for _, r in done] == ["SUCCESS"] * 14, done[-1]
    raw, trusted, snap = p.path("data/raw"), p.path("data/trusted"), p.path("data/snapshots", CUT)
    assert all((raw / f).read_bytes() == b for f, b in FILES.items())
    assert (trusted / "permit.asc").read_bytes() == FILES["permit.asc"].replace(b"880101T0000", b"880101").replace(b"870704T0000", b"870704")
    assert all((trusted / f).read_bytes() == b for f, b in FILES.items() if f != "permit.asc")
    without = lambda f, line: FILES[f].replace(line, b"")
    assert (snap / "voyage.asc").read_bytes() == without("voyage.asc", b"502;880229\n")
    assert (snap / "crate.asc").read_bytes() == without("crate.asc", b'C3;502;880227;" rope "\r\n')
    assert (snap / "berth.asc").read_bytes() == without("berth.asc", b"B2;502\n") and (snap / "pilot.asc").read_bytes() == without("pilot.asc", b"B2;Ruth\r\n")
    assert (snap / "tariff.asc").read_bytes() == FILES["tariff.asc"]
    steps = dict(done)
    dq = {x["rule_id"]: x for x in steps["dq raw"]["rule_results"]}
    assert (dq["PMT-VAL-001"]["violations"], dq["PLT-VAL-001"]["violations"], dq["PLT-VAL-001"]["sample_violations"], dq["VOY-UNI-001"]["status"]) == (3, 2, ['Lee "Jr"', "Noor"], "PASSED")
    assert {x["rule_id"]: x["violations"] for x in steps["dq trusted"]["rule_results"]}["PMT-VAL-001"] == 1
    policy = steps["standardization"]["policy_results"][0]
    assert (policy["rows_total"], policy["rows_changed"], policy["rows_unchanged"]) == (3, 2, 1) and len(policy["sample_changes"]) == 2
    read = lambda layer, t: spark.read.parquet(str(p.path("data", layer, t)))
    assert read("observability", "dq_runs").count() == 3 and read("observability", "dq_rule_results").count() == 12
    assert read("metrics", "dq_aggregate_metrics").where("aggregation_level = 'SNAPSHOT'").count() == 1
    assert read("metrics", "dq_snapshot_rule_history").count() == 4 and read("metrics", "dq_snapshot_evaluation_summary").count() == 1
    assert read("lineage", "lineage_nodes").count() == 6 * 4 + 4 + 4 * 3 + 1 + 5 and read("lineage", "lineage_edges").count() == 18 + 12 + 1 + 3
    assert read("traceability", "execution_details").count() == 6 + 12 + 1 + 6
    r = read("reporting", "governance_decisions").first()
    assert (r.policy_asset, r.policy_column) == ("permit", "issued")
    assert dict(read("reporting", "dq_summaries").dtypes)["row_rule_evaluations"] == "decimal(38,0)"
    detail = read("traceability", "execution_details").where("detail_type = 'STANDARDIZATION_POLICY'").first()
    assert json.loads(detail.attributes)["rows_unchanged"] == 1 and list(json.loads(detail.attributes)) == sorted(json.loads(detail.attributes))


def test_ingestion_is_all_or_nothing(project):
    p, source = project
    assert stages.ingest(p, source)["status"] == "SUCCESS"
    (source / "permit.asc").write_bytes(b'"permit_no";"issued"\n')
    bad = stages.ingest(p, source)
    assert bad["status"] == "FAILED" and "sha256 differs; record count differs" in bad["errors"][0]
    assert (p.path("data/raw") / "permit.asc").read_bytes() == FILES["permit.asc"]
    (source / "permit.asc").unlink()
    assert "file is missing" in stages.ingest(p, source)["errors"][0]


@pytest.mark.parametrize("value", [b"871131", b"8712", b"87-12-01", b"1987121", b"871201 ", b""])
def test_replay_rejects_bad_dates_even_of_rows_that_go(spark, project, value):
    p, source = project
    p.path("data/trusted").mkdir(parents=True)
    for f, b in FILES.items():
        (p.path("data/trusted") / f).write_bytes(b.replace(b"C3;502;880227", b"C3;502;" + value) if f == "crate.asc" else b)
    out = stages.snapshot_at(spark, p, CUT)
    assert out["status"] == "FAILED" and "invalid date" in out["errors"][0] and not p.path("data/snapshots/1993-12-31").exists()


def test_replay_rejects_orphans(spark, project):
    p, _ = project
    p.path("data/trusted").mkdir(parents=True)
    for f, b in FILES.items():
        (p.path("data/trusted") / f).write_bytes(b + b"C9;777;990101;coal\r\n" if f == "crate.asc" else b)
    assert "orphans" in stages.snapshot_at(spark, p, CUT)["errors"][0]


def test_zone_and_cutoff_rules(spark, project):
    p, source = project
    stages.ingest(p, source)
    for zone, cutoff in (("raw", ""), ("raw", CUT), ("snapshot", None), ("snapshot", "1987-2-1"), ("gold", None)):
        assert stages.check_quality(spark, p, zone, p.path("data/raw"), cutoff)["status"] == "FAILED"
    assert stages.check_quality(spark, p, "snapshot", None, CUT)["status"] == "FAILED"
    assert stages.check_quality(spark, p, "snapshot", p.path("data/raw"), "1980-06-30")["rule_results"][0]["rows_evaluated"] == 3


def test_metadata_that_is_rejected(project):
    m = metadata.load(project[0].root)
    good = metadata.load_list(project[0].path("metadata/dq_rules"), "rules")
    assert metadata.rule_errors(good, m) == []
    change = lambda k, **x: [{**r, **x} if i == k else r for i, r in enumerate(good)]
    for bad in (change(0, id="PLT-VAL-001"), change(0, asset="none"), change(0, dimension="uniqueness"), change(0, empty_policy="skip"), change(0, expectation={"type": "regex_format", "pattern": "("}), change(1, expectation={"type": "allowed_values", "values": []}), change(3, expectation={"type": "reference_exists", "asset": "pilot", "column": "berth_no"}), [{"id": "X"}]):
        assert metadata.rule_errors(bad, m)
    with pytest.raises(ValueError, match="duplicate key"):
        metadata.unique_pairs([("a", 1), ("a", 2)])
    doc = yaml.safe_load(project[0].path("metadata/replay/historical_snapshot.yaml").read_text())["assets"]
    doc["voyage"] = {"strategy": "temporal_and_reference", "temporal": doc["voyage"]["temporal"], "references": [{"column": "voyage_no", "asset": "crate", "target_column": "voyage_no"}]}
    with pytest.raises(ValueError, match="cycle"):
        stages.replay_selections(m, doc)


def test_catalog_checks_name_what_is_missing(project):
    p, source = project
    stages.ingest(p, source)
    assert stages.check_catalog(p)["status"] == "SUCCESS"
    (p.path("data/raw") / "permit.asc").write_bytes(b'"permit_no";"granted"\n')
    out = stages.check_catalog(p)
    assert {x["name"] for x in out["checks"] if x["status"] == "FAILED"} == {"catalog_columns_in_raw", "raw_columns_in_catalog"} and len(out["checks"]) == 11


def test_publication_keeps_the_old_on_failure(tmp_path, monkeypatch):
    target = tmp_path / "t"
    publication.publish(target, lambda d: (d / "a").write_text("1"))

    def fail(d):
        (d / "a").write_text("2")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        publication.publish(target, fail)

    def late():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        publication.publish(target, lambda d: (d / "a").write_text("3"), late)
    assert (target / "a").read_text() == "1" and os.listdir(tmp_path) == ["t"]
    publication.write_record({"run_id": "r"}, tmp_path / "r")
    with pytest.raises(FileExistsError):
        publication.write_record({"run_id": "r"}, tmp_path / "r")


def test_profile_tells_empty_from_null(spark, project, tmp_path):
    (tmp_path / "f.asc").write_bytes('pier;flag;gap\n7;red;\n8;blue;""\n8;red;\n9;"re""d";\n6;\0;\n'.encode())
    from tidemark.operators import profiling

    df = delimited.scan(spark, tmp_path / "f.asc", ["pier", "flag", "gap"], delimited.Format())
    got = {r.column_name: r for r in profiling.profile(df).collect()}
    assert (got["pier"].distinct_count, got["pier"].total_count, got["pier"].uniqueness_ratio) == (4, 5, 0.8)
    assert (got["flag"].parser_null_count, got["flag"].max_observed, got["gap"].empty_count, got["gap"].uniqueness_ratio, got["gap"].min_observed) == (1, "red", 5, None, None)
    assert [r.value for r in profiling.profile_samples(df, ["flag"]).collect()] == ["blue", 're"d', "red"]
    (tmp_path / "bad.asc").write_bytes(b"pier;flag\n4;red;blue\n")
    with pytest.raises(Exception):  # noqa: B017
        delimited.scan(spark, tmp_path / "bad.asc", ["pier", "flag"], delimited.Format()).count()


def test_new_records_rebuild_the_history(spark, project, tmp_path):
    from tidemark.streaming.history import watch

    p, source = project
    stages.ingest(p, source)
    for n in (1, 2):
        assert stages.check_quality(spark, p)["status"] == "SUCCESS"
        watch(spark, p, tmp_path / "stream").awaitTermination(120)
        assert spark.read.parquet(str(p.path("data/observability/dq_runs"))).count() == n
