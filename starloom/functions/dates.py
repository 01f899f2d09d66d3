"""Date parts, durations in days and cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000.0
# Fixed day that profile tenure is measured against.
TENURE_REFERENCE = "2026-01-01"


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY_MICROS)


def days_from_micros(later: Column, earlier_micros: int) -> Column:
    return (F.unix_micros(later) - F.lit(earlier_micros)) / F.lit(DAY_MICROS)


def date_parts(ts: Column, prefix: str = "review_") -> dict[str, Column]:
    """Year, month, weekday (Monday is 0), hour, weekend and evening flags; no date gives zeros."""
    part = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    weekday, hour = part(F.weekday(ts)), part(F.hour(ts))
    return {
        f"{prefix}year": part(F.year(ts)),
        f"{prefix}month": part(F.month(ts)),
        f"{prefix}weekday": weekday,
        f"{prefix}hour": hour,
        f"{prefix}weekend_flag": weekday.isin(5.0, 6.0).cast("double"),
        f"{prefix}evening_flag": hour.between(18.0, 23.0).cast("double"),
    }


def tenure_days(since: Column, end_micros: int) -> Column:
    """Days from ``since`` to the end, never negative; unknown gives 0."""
    days = (F.lit(end_micros) - F.unix_micros(since)) / F.lit(DAY_MICROS)
    return F.greatest(F.coalesce(days, F.lit(0.0)), F.lit(0.0))


def whole_tenure_years(since: Column, reference: str = TENURE_REFERENCE) -> Column:
    """Whole days up to a fixed reference day, in years of 365.25 days."""
    days = F.floor((F.unix_micros(F.lit(reference).cast("timestamp")) - F.unix_micros(since)) / F.lit(DAY_MICROS))
    return days / F.lit(365.25)


def cyclic(k: Column, period: int, name: str) -> dict[str, Column]:
    angle = F.lit(2.0 * math.pi) * k / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def review_context(ts: str, start_micros: int) -> dict[str, Column]:
    """The ten context columns of a review before scaling: votes, recency and cyclic date parts."""
    t = F.col(ts)
    votes = {f"{v}_log1p": F.log1p(F.greatest(F.coalesce(F.col(v).cast("double"), F.lit(0.0)), F.lit(0.0))) for v in ("useful", "funny", "cool")}
    part = lambda c, missing: F.coalesce(c.cast("double"), F.lit(missing))
    return {
        **votes,
        "recency_days": days_from_micros(t, start_micros),
        **cyclic(part(F.month(t), 1.0) - 1.0, 12, "month"),
        **cyclic(part(F.weekday(t), 0.0), 7, "weekday"),
        **cyclic(part(F.hour(t), 0.0), 24, "hour"),
    }
