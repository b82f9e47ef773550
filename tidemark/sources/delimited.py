"""Delimited text: logical scans with every column as text, physical lines, headers, checksums and counts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import present


@dataclass(frozen=True)
class Format:
    """Delimiter and text qualifier; a header line always comes first."""

    delimiter: str = ";"
    quote: str = '"'

    @classmethod
    def declared(cls, d: dict) -> Format:
        if not isinstance(d, dict) or d.get("header") is not True:
            raise ValueError("physical_format.header must be true")
        for k in ("delimiter", "text_qualifier"):
            if not isinstance(d.get(k), str) or len(d[k].encode()) != 1:
                raise ValueError(f"physical_format.{k} must be a single byte")
        return cls(d["delimiter"], d["text_qualifier"])


def header(path: str | Path, fmt: Format) -> list[str]:
    """Column names of the first line; a byte-order mark is no part of the first name."""
    import csv

    with open(path, encoding="utf-8-sig", newline="") as f:
        row = next(csv.reader(f, delimiter=fmt.delimiter, quotechar=fmt.quote, strict=True), None)
    if not row:
        raise ValueError(f"{Path(path).name} has no header")
    return row


def scan(spark: SparkSession, path: str | Path, columns: list[str], fmt: Format, multiline: bool = True) -> DataFrame:
    """All columns as text; empty fields are empty strings, a field of one NUL is null; malformed rows and other headers fail.

    Quoted line ends need ``multiline``, at the price of one task per file; without
    it the file is split and a quoted line end is an error.
    """
    spark.conf.set("spark.sql.csv.parser.columnPruning.enabled", "false")  # else unread columns are not checked
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(header=True, sep=fmt.delimiter, quote=fmt.quote, escape=fmt.quote, mode="FAILFAST", enforceSchema=False, multiLine=multiline).csv(str(path))
    return df.select(*[present(F.col(f"`{c}`")).alias(c) for c in columns])


def tokens(line: Column, fmt: Format) -> Column:
    """Physical tokens of a line, qualifiers included: cut at delimiters outside qualifiers."""
    import re

    d, q = re.escape(fmt.delimiter), re.escape(fmt.quote)
    return F.split(line, rf"{d}(?=(?:[^{q}]*{q}[^{q}]*{q})*[^{q}]*$)", -1)


def unquoted(token: Column, fmt: Format) -> Column:
    """Logical value of a token: outer qualifiers go, doubled ones are one."""
    q = fmt.quote
    inner = F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit(q + q), F.lit(q))
    return F.when(token.startswith(q) & token.endswith(q) & (F.length(token) >= 2), inner).otherwise(token)


def encoded(value: Column, token: Column, fmt: Format) -> Column:
    """A token for a new value: quoted if the old one was, or if it must be."""
    q = fmt.quote
    must = token.startswith(q) | value.contains(fmt.delimiter) | value.contains(q) | value.contains("\n") | value.contains("\r")
    return F.when(must, F.concat(F.lit(q), F.replace(value, F.lit(q), F.lit(q + q)), F.lit(q))).otherwise(value)


def lines(spark: SparkSession, path: str | Path, columns: list[str], fmt: Format) -> DataFrame:
    """_line_no, _raw_line (carriage return kept, line feed not) and the logical columns of every data line. Rows with another number of fields fail."""
    raw = spark.read.option("lineSep", "\n").text(str(path)).select(F.monotonically_increasing_id().alias("_line_no"), F.col("value").alias("_raw_line"))
    t = raw.where("_line_no > 0").withColumn("_t", tokens(F.regexp_replace("_raw_line", r"\r\z", ""), fmt))
    checked = F.when(F.size("_t") == len(columns), F.col("_t")).otherwise(F.raise_error(F.concat(F.lit(f"{Path(path).name}: {len(columns)} fields expected: "), F.col("_raw_line"))))
    t = t.select("_line_no", "_raw_line", checked.alias("_t"))
    return t.select("_line_no", "_raw_line", "_t", *[unquoted(F.col("_t")[i], fmt).alias(c) for i, c in enumerate(columns)])


def sha256(path: str | Path, upper: bool = True, chunk: int = 1 << 20) -> str:
    """SHA-256 of a file in chunks, so that its size does not matter."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest().upper() if upper else h.hexdigest()


def record_count(path: str | Path) -> int:
    """Physical lines but the header's; never below zero."""
    n, last = 0, b"\n"
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            n, last = n + block.count(b"\n"), block[-1:]
    return max(0, n + (last != b"\n") - 1)


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, sha256 (upper case) of files by Spark's binary reader, for many files of moderate size."""
    return spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.upper(F.sha2("content", 256)).alias("sha256"))
