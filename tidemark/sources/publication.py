"""Publication without half-written results: staged folders, exclusive records, verified Parquet."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators.constraints import round_trip


def now() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


def run_id(prefix: str = "") -> str:
    return f"{prefix}{datetime.now(UTC).strftime('%Y%m%dT%H%M%S.%fZ')}-{uuid.uuid4().hex[:8]}"


def publish(target: str | Path, fill: Callable[[Path], None], commit: Callable[[], None] | None = None) -> None:
    """Fill a staging folder beside the target and swap it in; any failure leaves the old target. ``commit`` runs after the swap and before the old one goes. Single writer."""
    target = Path(target).resolve()
    target.parent.mkdir(parents=True, exist_ok=True)
    staging, backup = (target.with_name(f".{target.name}.{x}-{uuid.uuid4().hex[:8]}") for x in ("staging", "backup"))
    had = target.exists()
    try:
        staging.mkdir()
        if (keep := target / ".gitkeep").exists():
            shutil.copy2(keep, staging / ".gitkeep")
        fill(staging)
        if had:
            os.replace(target, backup)
        try:
            os.replace(staging, target)
            if commit:
                commit()
        except BaseException:
            if target.exists() and (backup.exists() or not had):
                shutil.rmtree(target)
            if backup.exists():
                os.replace(backup, target)
            raise
    finally:
        shutil.rmtree(staging, ignore_errors=True)
        shutil.rmtree(backup, ignore_errors=True)


def write_record(record: dict, directory: str | Path) -> Path:
    """One file for a run, never overwritten; it appears complete or not at all."""
    directory = Path(directory)
    directory.mkdir(parents=True, exist_ok=True)
    path = directory / f"{record['run_id']}.json"
    part = path.with_suffix(f".{uuid.uuid4().hex[:8]}.part")
    try:
        part.write_text(json.dumps(record, ensure_ascii=False, indent=2), encoding="utf-8")
        os.link(part, path)  # fails if it is there
    finally:
        part.unlink(missing_ok=True)
    return path


def publish_tables(tables: dict[str, DataFrame], target: str | Path, keys: dict[str, list[str]] | None = None) -> None:
    """Typed Parquet (zstd), ordered by key, read again and compared in both directions before the swap."""

    def fill(staging: Path) -> None:
        for name, df in tables.items():
            ordered = df.orderBy(*keys[name]) if keys and name in keys else df
            ordered.write.option("compression", "zstd").parquet(str(staging / name))
            back = df.sparkSession.read.schema(df.schema).parquet(str(staging / name))
            if not round_trip(df, back).isEmpty():
                raise ValueError(f"{name} differs after writing")

    publish(target, fill)
