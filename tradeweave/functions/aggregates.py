"""Aggregate expressions with explicit missing-value rules.

All of them split into a map-side partial and a final step, so a hot group never
moves more than one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeweave.functions.columns import ColumnLike, as_col

# Years are shifted before squaring: the slope does not change, and the sums stay
# small enough to be exact in double precision.
YEAR_ORIGIN = 2000


def strict_sum(c: ColumnLike) -> Column:
    """Sum that is missing as soon as one input is missing."""
    c = as_col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def narm_sum(c: ColumnLike) -> Column:
    """Sum that skips missing inputs; zero when all are missing."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def sum_where(condition: Column, c: ColumnLike) -> Column:
    """Sum over the matching rows, zero when none matches."""
    return narm_sum(F.when(condition, as_col(c)))


def year_slope(y: ColumnLike, year: ColumnLike = "year") -> Column:
    """Least-squares slope of ``y`` over years; missing for a single year.

    Closed form over plain sums: with decimal weights the sums are exact, so the
    slope does not depend on row order. Rows with a missing side do not count.
    """
    y, x = as_col(y), as_col(year) - F.lit(YEAR_ORIGIN)
    both = y.isNotNull() & x.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x)
    sx, sy, sxx, sxy = F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * x)
    numerator = n.cast("double") * sxy.cast("double") - sx.cast("double") * sy.cast("double")
    return F.try_divide(numerator, (n * sxx - sx * sx).cast("double"))
