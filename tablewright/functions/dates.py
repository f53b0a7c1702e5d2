"""Date column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts known to the extractor, in output order.
DATE_PARTS = ("year", "month", "day", "quarter", "dayofweek", "is_weekend")


def as_timestamp(c: Column, dtype: str) -> Column:
    """Timestamps stay; strings are parsed and become NULL when they cannot be."""
    return c if dtype in ("timestamp", "timestamp_ntz", "date") else F.try_to_timestamp(c.cast("string"))


def date_part(ts: Column, part: str) -> Column:
    """One calendar part as DOUBLE. Monday is day 0; a missing date gives 0."""
    expr = {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "quarter": F.quarter(ts),
        "dayofweek": F.weekday(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }[part]
    return F.coalesce(expr.cast("double"), F.lit(0.0))
