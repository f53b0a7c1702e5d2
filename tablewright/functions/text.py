"""String column expressions: semantic patterns and structural sub-features."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, words and limits that results depend on.
EMAIL_PATTERN = r"^[\w\.-]+@[\w\.-]+\.\w+$"
IP_PATTERN = (
    r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
)
URL_PATTERN = r"^https?://[^\s/$.?#].[^\s]*$"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
PHONE_PATTERN = (
    r"^\+?[0-9]{1,4}?[-.\s]?\(?[0-9]{1,3}?\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}$"
)
ID_NAME_PATTERN = (
    r"^(id|uuid|index|row_?num|row_?id|unnamed:\s*0)$" r"|.+(_|-|\s)id$" r"|.+[a-z0-9](Id|ID)$"
)
DATE_NAME_HINTS = (
    "date", "time", "year", "month", "day", "dt", "timestamp", "ts", "created", "updated", "modified", "dob",
)
LATITUDE_NAMES = ("lat", "latitude")
LONGITUDE_NAMES = ("lon", "lng", "longitude")
PRIVATE_IP_PREFIXES = ("10.", "192.168.", "172.16.")

_id_name = re.compile(ID_NAME_PATTERN, re.IGNORECASE)


def is_id_name(name: str, target: str | None = None) -> bool:
    """Whether a column is an identifier by its name; the target never is."""
    return name != target and bool(_id_name.match(name.strip()))


def has_date_hint(name: str) -> bool:
    return any(hint in name.lower() for hint in DATE_NAME_HINTS)


def matches(c: Column, kind: str) -> Column:
    pattern = {
        "email": "(?U)" + EMAIL_PATTERN,
        "ip_address": IP_PATTERN,
        "url": "(?iU)" + URL_PATTERN,
        "uuid": UUID_PATTERN,
        "phone_number": "(?U)" + PHONE_PATTERN,
    }[kind]
    return c.rlike(pattern)


def word_count(c: Column) -> Column:
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"(?U)\s+")))


def text_features(c: Column, semantic_type: str) -> dict[str, Column]:
    """Structural features of a semantic string column, as DOUBLE columns by suffix."""
    s = F.coalesce(c.cast("string"), F.lit("None"))
    if semantic_type == "email":
        at = s.contains("@")
        pieces = F.split(s, "@")
        features = {
            "user_len": F.when(at, F.length(pieces[0])).otherwise(F.length(s)),
            "domain_len": F.when(at, F.length(F.get(pieces, F.lit(1)))).otherwise(0),
        }
    elif semantic_type == "url":
        pieces = F.split(s, "/")
        hosted = s.contains("://") & (F.size(pieces) > 2)
        features = {
            "host_len": F.when(hosted, F.length(F.get(pieces, F.lit(2)))).otherwise(F.length(s)),
            "total_len": F.length(s),
        }
    elif semantic_type == "ip_address":
        first = F.split(s, r"\.")[0]
        private = F.lit(False)
        for prefix in PRIVATE_IP_PREFIXES:
            private = private | s.startswith(prefix)
        features = {
            "first_octet": F.when(s.contains(".") & first.rlike("^[0-9]+$"), first.try_cast("double")).otherwise(0.0),
            "is_private": private.cast("int"),
        }
    else:
        features = {"len": F.length(s)}
    return {suffix: F.coalesce(expr.cast("double"), F.lit(0.0)) for suffix, expr in features.items()}
