"""Column expressions shared by the operators: exact text predicates, ratios, canonical identities, dates."""

from __future__ import annotations

import json
import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(value: Column, pattern: str, unicode_classes: bool = False) -> Column:
    """Does the pattern match the whole value? A trailing line end is part of the value."""
    return value.rlike(("(?U)" if unicode_classes else "") + rf"\A(?:{pattern})\z")


def java_replacement(template: str) -> str:
    r"""A replacement with \1 or \g<1> groups in Java's notation."""
    out = template.replace("\\\\", "\0").replace("$", r"\$")
    out = re.sub(r"\\g<(\w+)>", lambda m: "${" + m[1] + "}" if not m[1].isdigit() else f"${m[1]}", out)
    return re.sub(r"\\(\d+)", r"$\1", out).replace("\0", "\\\\")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null where whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def canonical(value: object) -> str:
    """JSON text with sorted keys and no spaces; non-ASCII text stays."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def identity(prefix: str, *parts: Column) -> Column:
    """prefix and the SHA-256 of the parts as a JSON array, nulls included."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.array(*parts)), 256))


def node_id(prefix: str, *parts: Column) -> Column:
    """prefix:part:part, each part percent-encoded; null parts are left out."""
    encoded = [F.replace(F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")) for p in parts]
    return F.concat_ws(":", F.lit(prefix), *encoded)


def node_text(prefix: str, *parts: str) -> str:
    """The same identity on the driver."""
    return ":".join([prefix, *(quote(p, safe="") for p in parts)])


def short_date(value: Column, century: int = 19) -> Column:
    """YYMMDD of a fixed century as a date; null where it is none."""
    return F.when(full_match(value, "[0-9]{6}"), F.try_to_date(F.concat(F.lit(str(century)), value), "yyyyMMdd"))


def present(value: Column) -> Column:
    """Parser nulls and empty fields told apart: null from the reader is an empty field, a NUL alone is a null."""
    return F.when(value.isNull(), F.lit("")).when(value == F.lit("\0"), F.lit(None)).otherwise(value)
