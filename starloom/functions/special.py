"""The digamma function as a column expression (recurrence plus asymptotic series)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digamma(x: Column) -> Column:
    """Derivative of log-gamma for positive ``x``, to about 1e-10: shifted by six, then the series."""
    shift = sum((F.lit(1.0) / (x + float(k)) for k in range(1, 6)), F.lit(1.0) / x)
    y = x + 6.0
    r = F.lit(1.0) / y
    s = r * r
    series = F.log(y) - 0.5 * r - s * (
        F.lit(1 / 12) - s * (F.lit(1 / 120) - s * (F.lit(1 / 252) - s * (F.lit(1 / 240) - s * F.lit(1 / 132))))
    )
    return series - shift
