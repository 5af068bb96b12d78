"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """'' and all-space strings become NULL (one notion of "absent" everywhere)."""
    c = col(c)
    return F.when(F.trim(c) == "", F.lit(None).cast("string")).otherwise(c)


def is_present(c: str | Column) -> Column:
    c = col(c)
    return c.isNotNull() & (F.trim(c) != "")


def customer_key(user_id: str | Column = "user_id", visitor_id: str | Column = "visitor_id") -> Column:
    """user id when present, else the visitor id."""
    return F.when(is_present(user_id), col(user_id)).otherwise(col(visitor_id))


def id_type(user_id: str | Column = "user_id") -> Column:
    return F.when(is_present(user_id), F.lit("user")).otherwise(F.lit("visitor"))


def parse_event_time(ts: str | Column) -> Column:
    """Text timestamp -> timestamp_ntz; unparsable text gives NULL instead of an error."""
    return F.try_to_timestamp(col(ts)).cast("timestamp_ntz")


def positive_long(c: str | Column) -> Column:
    """True when the text is an integer > 0 (NULL-safe, never throws)."""
    return F.coalesce(F.expr("try_cast({} as bigint)".format(_sql(c))) > 0, F.lit(False))


def _sql(c: str | Column) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name")


def count_if(cond: Column) -> Column:
    """Conditional count as bigint (0 when nothing matches)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den is 0 or NULL."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def normalise_product_id(c: str | Column) -> Column:
    """NULL -> '', text form, trailing '.0' removed (float-ified ids)."""
    return F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"\.0$", "")


def user_from_session(session_id: str | Column) -> Column:
    """'u1204-2026-07-10-s0' -> '1204'; NULL when the pattern is absent."""
    return blank_to_null(F.regexp_extract(col(session_id), r"^u([0-9]+)-", 1))


def parse_basket(text: str | Column) -> Column:
    """Tolerant basket parse: a JSON list, else comma separated values with []'" and
    spaces stripped; empty entries dropped."""
    t = col(text)
    as_json = F.from_json(t, "array<string>")
    stripped = F.transform(F.split(t, ","), lambda x: F.regexp_replace(x, r"^[\[\]'\" ]+|[\[\]'\" ]+$", ""))
    loose = F.filter(stripped, lambda x: x != "")
    chosen = F.coalesce(F.when(F.try_parse_json(t).isNotNull() & as_json.isNotNull(), as_json), loose)
    return F.filter(F.transform(chosen, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed 24-hour days between two timestamps (floor), like a timedelta's .days."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)  # wall-clock, no time zone involved
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")
