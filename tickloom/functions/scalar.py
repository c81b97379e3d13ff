"""Scalar functions of time, names and numbers that Spark lacks or spells differently."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPORT_NAME = r"^([A-Z]{6})_ticks_(\d{6})\.csv$"


def at_ms(ms: Column | str) -> Column:
    return F.timestamp_millis(ms)


def local(ms: Column | str, zone: str) -> Column:
    """The wall-clock time in a zone of an instant in epoch milliseconds."""
    return F.from_utc_timestamp(F.timestamp_millis(ms), zone)


def month_key(ts: Column | str) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def months_between(first: Column, last: Column) -> Column:
    """All YYYYMM from first to last, as an array; NULL if reversed."""
    months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH"))
    return F.when(first <= last, F.transform(months, lambda m: month_key(m)))


def padded_month(ym: Column, by: int) -> Column:
    """YYYYMM moved by a number of months."""
    n = F.floor(ym / 100) * 12 + ym % 100 - 1 + by
    return (F.floor(n / 12) * 100 + n % 12 + 1).cast("int")


def month_end(ym: Column) -> Column:
    """The last microsecond of a month YYYYMM."""
    first = F.make_date(F.floor(ym / 100).cast("int"), (ym % 100).cast("int"), F.lit(1))
    return F.add_months(first, 1).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")


def export_pair(name: Column | str) -> Column:
    """The pair in an export file's name, NULL for other names."""
    found = F.regexp_extract(name, EXPORT_NAME, 1)
    return F.when(found != "", found)


def export_month(name: Column | str) -> Column:
    found = F.regexp_extract(name, EXPORT_NAME, 2)
    return F.when(found != "", found.cast("int"))


def is_export_name(name: str) -> bool:
    return bool(re.match(EXPORT_NAME, name))


def summer_time(ts: Column, zone: str) -> Column:
    """Whether the zone's offset at a UTC time differs from its offset in January of that year."""
    winter = F.make_timestamp_ntz(F.year(ts), F.lit(1), F.lit(15), F.lit(12), F.lit(0), F.lit(0)).cast("timestamp")
    offset = lambda t: F.unix_micros(F.from_utc_timestamp(t, zone)) - F.unix_micros(t)
    return offset(ts) != offset(winter)


def is_close(a: Column, b: Column, atol: float, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """The two-sided normal p-value of z; Spark has no erfc."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def p_value(z: float | None) -> float | None:
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def interval_text(ci: tuple[float, float] | None, scale: float = 1.0, digits: int = 3) -> str:
    return "n/a" if ci is None else f"[{ci[0] * scale:+.{digits}f}, {ci[1] * scale:+.{digits}f}]"
