"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", master: str | None = None, partitions: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; master and partitions are the cluster's unless given."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()
