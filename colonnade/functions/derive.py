"""Column expressions for time, delay and status features; all stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class bounds in minutes, day-part hours, long-delay bound.
EARLY_BELOW = -0.5
LATE_ABOVE = 0.5
DAY_PARTS = (("morning", 5, 12), ("afternoon", 12, 17), ("evening", 17, 21))
LONG_DELAY = 5.0
STATUS_CODES = {"early": 1, "on-time": 2, "late": 3}
DAY_PART_CODES = {"morning": 1, "afternoon": 2, "evening": 3, "night": 4}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(c: Column | str, strict: bool = False) -> Column:
    """Text to timestamp; text that is no timestamp gives null, or an error when strict."""
    return _col(c).cast("timestamp_ntz") if strict else _col(c).try_cast("timestamp_ntz")


def to_number(c: Column | str) -> Column:
    return _col(c).try_cast("double")


def elapsed_minutes(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)).cast("double") / F.lit(6e7)


def delay_class(minutes: Column | str, low: float = EARLY_BELOW, high: float = LATE_ABOVE) -> Column:
    """early below ``low``, on-time up to and including ``high``, late otherwise and for null."""
    m = _col(minutes)
    return F.when(m < low, "early").when(m <= high, "on-time").otherwise("late")


def day_part(ts: Column | str) -> Column:
    hour = F.hour(_col(ts))
    out = F
    for name, start, stop in DAY_PARTS:
        out = out.when((hour >= start) & (hour < stop), name)
    return out.otherwise("night")


def exceeds(c: Column | str, bound: float = LONG_DELAY) -> Column:
    """True above the bound; null and NaN count as false."""
    value = F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))
    return F.coalesce(value > F.lit(bound), F.lit(False))


def weekday_name(d: Column | str) -> Column:
    return F.date_format(_col(d), "EEEE")


def calendar(df: DataFrame, ts: str, keep: bool = True) -> DataFrame:
    """Year, month, day, hour, weekday (Monday is 0) and weekend flag of a timestamp column."""
    t = F.col(ts)
    out = df.withColumns(
        {
            "year": F.year(t),
            "month": F.month(t),
            "day": F.dayofmonth(t),
            "hour": F.hour(t),
            "day_of_week": F.weekday(t),
            "is_weekend": F.weekday(t) >= 5,
        }
    )
    return out if keep else out.drop(ts)


def recode(c: Column | str, codes: Mapping, default: Column | None = None) -> Column:
    """Replace mapped values; anything else keeps its value unless a default is given."""
    source = _col(c)
    lookup = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    mapped = F.element_at(lookup, source)
    if default is None:
        default = source.cast("string")
        mapped = mapped.cast("string")
    return F.coalesce(mapped, default)
