"""Functions over ordered frames: differences, fills, smoothing and robust filters, as column expressions over a window.

A missing value is NULL; nothing here sees NaN (sources turn it into NULL).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def step(x, w: WindowSpec) -> Column:
    """x[t] - x[t-1]."""
    return _c(x) - F.lag(_c(x)).over(w)


def half_difference(x, w: WindowSpec) -> Column:
    """(x[t+1] - x[t-1]) / 2; NULL at the ends."""
    return (F.lead(_c(x)).over(w) - F.lag(_c(x)).over(w)) / 2


def second_difference(x, w: WindowSpec) -> Column:
    return F.lead(_c(x)).over(w) - 2 * _c(x) + F.lag(_c(x)).over(w)


def third_difference(x, w: WindowSpec) -> Column:
    """x[t] - 3 x[t-1] + 3 x[t-2] - x[t-3]."""
    at = [F.lag(_c(x), k).over(w) for k in (1, 2, 3)]
    return _c(x) - 3 * at[0] + 3 * at[1] - at[2]


def forward_fill(x, w: WindowSpec) -> Column:
    return F.last(_c(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(x, w: WindowSpec) -> Column:
    return F.first(_c(x), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def interpolate(x, position, w: WindowSpec) -> Column:
    """Linear between the neighbours that are known; the nearest known value beyond the ends."""
    x, position = _c(x), _c(position)
    here = F.when(x.isNotNull(), position)
    x0, x1, p0, p1 = forward_fill(x, w), backward_fill(x, w), forward_fill(here, w), backward_fill(here, w)
    between = x0 + (x1 - x0) * F.try_divide(position - p0, p1 - p0)
    return F.coalesce(x, between, x0, x1)


def gated(x, confidence, least: float, w: WindowSpec) -> Column:
    """x where confidence reaches `least`, else the last such x; the first row stands for itself."""
    first = F.row_number().over(w) == 1
    return forward_fill(F.when((_c(confidence) >= least) | first, _c(x)), w)


def savgol_weights(width: int, order: int) -> list[float]:
    """Weights of the centred least-squares polynomial at its middle."""
    h = width // 2
    a = np.vander(np.arange(-h, h + 1), order + 1, increasing=True).astype(float)
    return np.linalg.pinv(a)[0].tolist()


def savgol(x, w: WindowSpec, width: int = 9, order: int = 3, rows: Column | None = None) -> Column:
    """Savitzky-Golay smoothing; beyond the ends the nearest value stands. Series shorter than width (rows: their
    length) stay as they are. x must be filled."""
    x, h = _c(x), width // 2
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = F.first(x).over(everything), F.last(x).over(everything)
    n, at = F.count(F.lit(1)).over(everything), F.row_number().over(w)
    total = F.lit(0.0)
    for k, c in zip(range(-h, h + 1), savgol_weights(width, order)):
        if k < 0:
            v = F.when(at + k < 1, ends[0]).otherwise(F.lag(x, -k).over(w))
        elif k > 0:
            v = F.when(at + k > n, ends[1]).otherwise(F.lead(x, k).over(w))
        else:
            v = x
        total = total + v * F.lit(c)
    return F.when((rows if rows is not None else n) < width, x).otherwise(total)


def _let(value: Column, of) -> Column:
    """of(value), with the value computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def array_median(a: Column) -> Column:
    """Median of an array's non-null values, NULL if there are none."""

    def middle(s):
        n = F.size(s)
        return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)

    return _let(F.sort_array(F.array_compact(a)), middle)


def hampel(x, w: WindowSpec, k: int = 3, limit: float = 3.0) -> Column:
    """x, or the median of its 2k+1 neighbours where it is further than limit * 1.4826 * MAD from it. The k rows at each
    end, windows with fewer than 3 known values and those with MAD 0 stay as they are."""
    x = _c(x)
    near = F.collect_list(x).over(w.rowsBetween(-k, k))
    whole = F.lag(F.lit(1), k).over(w).isNotNull() & F.lead(F.lit(1), k).over(w).isNotNull()

    def judged(s):
        def by(med):
            mad = array_median(F.transform(s, lambda v: F.abs(v - med)))
            return _let(mad, lambda m: F.when((m > 0) & (F.abs(x - med) > limit * 1.4826 * m), med).otherwise(x))

        return _let(array_median(s), by)

    return F.when(whole & x.isNotNull() & (F.size(near) >= 3), _let(near, judged)).otherwise(x)


def context_means(x, w: WindowSpec, k: int) -> tuple[Column, Column]:
    """Mean of the k rows before and after, less the value itself; 0 at the ends."""
    x = _c(x)
    past, coming = F.avg(x).over(w.rowsBetween(-k, -1)), F.avg(x).over(w.rowsBetween(1, k))
    return F.coalesce(past - x, F.lit(0.0)), F.coalesce(coming - x, F.lit(0.0))


def moving_average(x, w: WindowSpec, width: int) -> Column:
    """Sum of the window over its width: rows beyond the ends count as 0."""
    h = width // 2
    return F.sum(_c(x)).over(w.rowsBetween(-h, h)) / F.lit(float(2 * h + 1))


def run_id(changed: Column, w: WindowSpec) -> Column:
    """Number of the run that a row is in; changed: true where a run begins (NULL: the first row)."""
    return F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
