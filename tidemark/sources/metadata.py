"""Metadata files: strict YAML and JSON, catalog, manifest, and everything that is rejected before data is read."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from .delimited import Format


class _Unique(yaml.SafeLoader):
    """A loader that takes a key once."""


def _mapping(loader, node, deep=False):
    keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
    if twice := [k for k, n in Counter(map(str, keys)).items() if n > 1]:
        raise ValueError(f"duplicate key: {twice[0]}")
    return dict(zip(keys, (loader.construct_object(v, deep=True) for _, v in node.value), strict=True))


_Unique.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def load_yaml(path: str | Path):
    with open(path, encoding="utf-8") as f:
        return yaml.load(f, _Unique)  # noqa: S506  a safe loader


def unique_pairs(pairs: list[tuple[str, object]]) -> dict:
    """For json: a repeated key is an error, not a silent last one."""
    if twice := [k for k, n in Counter(k for k, _ in pairs).items() if n > 1]:
        raise ValueError(f"duplicate key: {twice[0]}")
    return dict(pairs)


def load_json(path: str | Path):
    return json.loads(Path(path).read_text(encoding="utf-8"), object_pairs_hook=unique_pairs)


def need_text(value, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must be a non-empty text")
    return value


@dataclass
class Asset:
    name: str
    source_file: str
    columns: list[str]
    facts: dict[str, dict] = field(default_factory=dict)


@dataclass
class Metadata:
    """Manifest, catalog and relationships of a project, with the errors found in them."""

    format: Format
    files: list[dict]
    assets: dict[str, Asset]
    relationships: list[dict]


def load_manifest(path: str | Path) -> tuple[Format, list[dict]]:
    """Physical format and files; names without folders, a checksum and a count each."""
    doc = load_yaml(path)
    dataset = doc.get("dataset") if isinstance(doc, dict) else None
    if not isinstance(dataset, dict) or not isinstance(dataset.get("files"), list) or not dataset["files"]:
        raise ValueError("dataset.files must be a non-empty list")
    for f in dataset["files"]:
        if not isinstance(f, dict) or not {"name", "sha256", "expected_record_count"} <= set(f):
            raise ValueError("a manifest file needs name, sha256 and expected_record_count")
        if Path(f["name"]).name != f["name"]:
            raise ValueError(f"{f['name']}: a file name has no folder")
    return Format.declared(dataset.get("physical_format")), dataset["files"]


def load_catalog(directory: str | Path) -> dict[str, Asset]:
    out = {}
    for path in sorted(Path(directory).glob("*.yaml")):
        doc = load_yaml(path)
        a, columns = doc["asset"], doc["columns"]
        if a["name"] in out:
            raise ValueError(f"duplicate asset: {a['name']}")
        names = [c["name"] for c in columns]
        if len(set(names)) != len(names):
            raise ValueError(f"{a['name']}: duplicate columns")
        out[a["name"]] = Asset(a["name"], a["source_file"], names, {c["name"]: c for c in columns})
    return out


def load(root: str | Path) -> Metadata:
    """A project's folders: config/dataset_manifest.yaml, metadata/catalog, metadata/relationships.yaml."""
    root = Path(root)
    fmt, files = load_manifest(root / "config/dataset_manifest.yaml")
    rel = root / "metadata/relationships.yaml"
    return Metadata(fmt, files, load_catalog(root / "metadata/catalog"), (load_yaml(rel) or {}).get("relationships") or [] if rel.exists() else [])


def load_list(directory: str | Path, key: str) -> list[dict]:
    """Declarations below a key of every file in a folder."""
    return [x for p in sorted(Path(directory).glob("*.yaml")) for x in (load_yaml(p).get(key) or [])]


#: What a dimension allows; fixed values.
PAIRS = {"validity": {"allowed_values", "regex_format"}, "uniqueness": {"unique"}, "referential_integrity": {"reference_exists"}}


def java_pattern(pattern: str) -> None:
    """Reject what the engine's own dialect rejects."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    if sc is None:
        re.compile(pattern)
        return
    try:
        sc._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ValueError(f"invalid pattern: {pattern}") from e


def rule_errors(rules: list[dict], m: Metadata) -> list[str]:
    """Everything wrong with rule declarations; an empty list lets them run."""
    out = []
    listed = {f["name"] for f in m.files}
    relations = {(r["from"]["asset"], r["from"]["column"], r["to"]["asset"], r["to"]["column"]) for r in m.relationships}
    for rid, n in Counter(r.get("id") for r in rules if isinstance(r, dict)).items():
        if n > 1:
            out.append(f"{rid}: duplicate id")
    for r in rules:
        rid = r.get("id") if isinstance(r, dict) else None
        say = lambda x, rid=rid: out.append(f"{rid}: {x}")
        if not isinstance(r, dict) or (missing := [k for k in ("id", "asset", "column", "dimension", "expectation", "empty_policy", "evidence") if k not in r]):
            say(f"missing {', '.join(missing) if isinstance(r, dict) else 'mapping'}")
            continue
        asset, e = m.assets.get(r["asset"]), r["expectation"]
        if asset is None or r["column"] not in asset.columns:
            say("unknown asset or column")
            continue
        if asset.source_file not in listed:
            say("its file is not in the manifest")
        kind = e.get("type") if isinstance(e, dict) else None
        if kind not in PAIRS.get(r["dimension"], ()):
            say(f"{kind} is no {r['dimension']} expectation")
            continue
        if r["empty_policy"] not in ("evaluate", "ignore"):
            say("empty_policy must be evaluate or ignore")
        facts = asset.facts[r["column"]]
        if kind == "allowed_values":
            values = e.get("values")
            if not isinstance(values, list) or not values or not all(isinstance(v, str) for v in values) or len(set(values)) != len(values):
                say("values must be distinct texts")
            elif "documented_values" in facts and set(map(str, facts["documented_values"])) != set(values):
                say("values differ from the documented ones")
        elif kind == "regex_format":
            try:
                java_pattern(need_text(e.get("pattern"), "pattern"))
            except ValueError as x:
                say(str(x))
            if not facts.get("documented_format"):
                say("the column documents no format")
        elif kind == "reference_exists":
            ref = e.get("reference") or e
            if (r["asset"], r["column"], ref.get("asset"), ref.get("column")) not in relations:
                say("no such relationship")
            elif ref.get("asset") not in m.assets or ref.get("column") not in m.assets[ref["asset"]].columns:
                say("unknown reference")
    return out


def policy_errors(policies: list[dict], m: Metadata) -> list[str]:
    out = [f"{k}: duplicate id" for k, n in Counter(p.get("id") for p in policies).items() if n > 1]
    for p in policies:
        asset, t = m.assets.get(p.get("asset")), p.get("transformation") or {}
        if asset is None or p.get("column") not in asset.columns:
            out.append(f"{p.get('id')}: unknown asset or column")
            continue
        if t.get("type") != "regex_replace":
            out.append(f"{p['id']}: only regex_replace is allowed")
        try:
            java_pattern(need_text(t.get("pattern"), "pattern"))
        except ValueError as x:
            out.append(f"{p['id']}: {x}")
        if not isinstance(t.get("replacement"), str):
            out.append(f"{p['id']}: replacement must be a text")
        if not asset.facts[p["column"]].get("documented_format"):
            out.append(f"{p['id']}: the column documents no format")
        e = p.get("evidence") or {}
        if e.get("type") == "catalog" and e.get("reference") not in (None, f"{p['asset']}.{p['column']}"):
            out.append(f"{p['id']}: evidence names another column")
    return out


def catalog_checks(m: Metadata, raw: str | Path) -> dict[str, list[str]]:
    """Eleven named checks of the catalog against manifest, headers and relationships; a check passes without errors."""
    from .delimited import header

    names = ("catalog_structure", "manifest_asset_coverage", "source_file_declaration", "unique_asset_names", "unique_columns", "raw_headers_available", "catalog_columns_in_raw", "raw_columns_in_catalog", "relationship_structure", "relationship_assets", "relationship_columns")
    errors: dict[str, list[str]] = {n: [] for n in names}
    listed, declared = [f["name"] for f in m.files], [a.source_file for a in m.assets.values()]
    errors["manifest_asset_coverage"] += [f"{f} has no asset" for f in listed if f not in declared] + [f"{f} is not in the manifest" for f in declared if f not in listed]
    errors["source_file_declaration"] += [f"{f} has several assets" for f, n in Counter(declared).items() if n > 1]
    for a in m.assets.values():
        if not a.columns or not all(need and isinstance(need, str) for need in a.columns):
            errors["catalog_structure"].append(f"{a.name}: columns need names")
        try:
            there = header(Path(raw) / a.source_file, m.format)
        except (OSError, ValueError) as e:
            errors["raw_headers_available"].append(f"{a.name}: {e}")
            continue
        errors["catalog_columns_in_raw"] += [f"{a.name}.{c}" for c in a.columns if c not in there]
        errors["raw_columns_in_catalog"] += [f"{a.name}.{c}" for c in there if c not in a.columns]
    errors["relationship_structure"] += [f"{n}: duplicate name" for n, k in Counter(r.get("name") for r in m.relationships).items() if k > 1]
    for r in m.relationships:
        for end in ("from", "to"):
            side = r.get(end)
            if not isinstance(side, dict) or not {"asset", "column"} <= set(side):
                errors["relationship_structure"].append(f"{r.get('name')}: {end} needs asset and column")
            elif side["asset"] not in m.assets:
                errors["relationship_assets"].append(f"{r['name']}: {side['asset']}")
            elif side["column"] not in m.assets[side["asset"]].columns:
                errors["relationship_columns"].append(f"{r['name']}: {side['asset']}.{side['column']}")
    return errors
