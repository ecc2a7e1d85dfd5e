"""Plane geometry on columns."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signal import _c

#: The edges of the skeleton.
EDGES = [("nose", "neck"), ("neck", "ear_left"), ("neck", "ear_right"), ("neck", "hip_left"), ("neck", "hip_right"), ("hip_left", "tail_base"), ("hip_right", "tail_base")]
#: Default edge lengths, in body lengths, in the order of EDGES.
DEFAULT_LENGTHS = [0.22, 0.14, 0.14, 0.55, 0.55, 0.30, 0.30]


def distance(ax, ay, bx, by) -> Column:
    dx, dy = _c(ax) - _c(bx), _c(ay) - _c(by)
    return F.sqrt(dx * dx + dy * dy)


def apart(a: str, b: str, of_a: str = "", of_b: str = "") -> Column:
    """Distance of two keypoints' columns, each with a prefix."""
    return distance(f"{of_a}{a}_x", f"{of_a}{a}_y", f"{of_b}{b}_x", f"{of_b}{b}_y")


def wrap(angle: Column) -> Column:
    """Into [-pi, pi), as a floored remainder does it."""
    return F.pmod(angle + pi, F.lit(2 * pi)) - pi


def mean_of(*columns) -> Column:
    """Mean of the values that are known; plain sums, so that it is compiled."""
    every = list(map(_c, columns))
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in every])
    return F.when(n > 0, reduce(lambda a, c: a + F.coalesce(c, F.lit(0.0)), every, F.lit(0.0)) / n)


def heading(from_x, from_y, to_x, to_y) -> Column:
    return F.atan2(_c(to_y) - _c(from_y), _c(to_x) - _c(from_x))


def vertex_angle(a: str, b: str, c: str) -> Column:
    """Angle at b between a and c, in radians."""
    ux, uy = F.col(f"{a}_x") - F.col(f"{b}_x"), F.col(f"{a}_y") - F.col(f"{b}_y")
    vx, vy = F.col(f"{c}_x") - F.col(f"{b}_x"), F.col(f"{c}_y") - F.col(f"{b}_y")
    cos = (ux * vx + uy * vy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy) + 1e-8)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))


def cross_sine(a: str, b: str, c: str) -> Column:
    """Sine of the turn from b-a to c-a, by the normalised cross product."""
    ux, uy = F.col(f"{b}_x") - F.col(f"{a}_x"), F.col(f"{b}_y") - F.col(f"{a}_y")
    vx, vy = F.col(f"{c}_x") - F.col(f"{a}_x"), F.col(f"{c}_y") - F.col(f"{a}_y")
    return F.try_divide(ux * vy - uy * vx, F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))


def depth_steps(lengths: list[float] = DEFAULT_LENGTHS, unit: float = 1.0) -> list[Column]:
    """sqrt(max(0, L^2 - d^2)) of each edge: the depth that a shortened edge implies."""
    return [F.sqrt(F.greatest(F.lit(0.0), F.lit((n * unit) ** 2) - apart(a, b) * apart(a, b))) for (a, b), n in zip(EDGES, lengths)]


def to_frame(angle: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Forward and lateral parts of (dx, dy) in a frame turned by angle."""
    return F.cos(angle) * dx + F.sin(angle) * dy, -F.sin(angle) * dx + F.cos(angle) * dy


def margin(p: Column) -> Column:
    s = F.sort_array(p, asc=False)
    return F.get(s, 0) - F.get(s, 1)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, v: a - v * F.ln(v + 1e-12))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean_distance(a: Column, b: Column) -> Column:
    """Of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def normal_tail(z: Column) -> Column:
    """2 * P(Z > z) of the normal distribution for z >= 0, by a rational approximation (error below 2e-7)."""
    #: Coefficients of the approximation.
    a = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return poly * F.exp(-x * x)


def clipped_confidence(severity: Column, sigma: float, low: float = 0.05) -> Column:
    """exp(-severity / sigma), within [low, 1]."""
    return F.greatest(F.lit(low), F.least(F.lit(1.0), F.exp(-severity / sigma)))


def probit(p: Column) -> Column:
    """The normal quantile of p in (0, 1): Hastings' rational form, right to 4.5e-4."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(q))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)
