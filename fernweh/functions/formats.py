"""Numbers, sizes, ages and stamps as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("KB", "MB", "GB", "TB")


def bytes_text(n: Column) -> Column:
    out = F.format_string("%d B", n)
    for k, unit in enumerate(UNITS, 1):
        v = n / float(1024**k)
        shown = F.when(v < 10, F.concat(F.format_string("%.1f", F.round(v, 1)), F.lit(f" {unit}"))).otherwise(F.concat(F.round(v).cast("bigint").cast("string"), F.lit(f" {unit}")))
        out = F.when(n >= 1024**k, shown).otherwise(out)
    return out


def stamp(seconds: Column) -> Column:
    """[hh:mm:ss]."""
    s = seconds.cast("bigint")
    return F.format_string("[%02d:%02d:%02d]", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"))


def stamp_seconds(line: Column) -> Column:
    part = lambda k: F.regexp_extract(line, r"^\[(\d{2,}):(\d{2}):(\d{2})\]", k)
    return F.when(part(1) != "", part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int"))


def age(now_ms: int, ms: Column) -> Column:
    """'5m', '3h', '2d', '4mo' or '1y' ago."""
    s = (F.lit(now_ms) - ms) / 1000.0
    f = lambda d, u: F.concat(F.floor(s / d).cast("string"), F.lit(u))
    return F.when(s < 60, "now").when(s < 3600, f(60, "m")).when(s < 86400, f(3600, "h")).when(s < 30 * 86400, f(86400, "d")).when(s < 365 * 86400, f(30 * 86400, "mo")).otherwise(f(365 * 86400, "y"))


def day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
