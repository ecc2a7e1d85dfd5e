"""Parameter search by density ratios: each trial is a Spark job, and the next one is drawn where good trials are dense and
other trials are not. Draws are hashes of (seed, trial, parameter), so a search repeats itself exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (low, high), (low, high, "log") or a list of choices.
Space = dict[str, tuple | list]


def uniform(*parts) -> float:
    """A number in [0, 1) by the hash of parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def to_unit(spec, value) -> float:
    if isinstance(spec, list):
        return (spec.index(value) + 0.5) / len(spec)
    low, high = (math.log(x) for x in spec[:2]) if spec[2:] == ("log",) else spec[:2]
    return ((math.log(value) if spec[2:] == ("log",) else value) - low) / (high - low)


def from_unit(spec, u: float):
    if isinstance(spec, list):
        return spec[min(int(u * len(spec)), len(spec) - 1)]
    low, high = (math.log(x) for x in spec[:2]) if spec[2:] == ("log",) else spec[:2]
    x = low + u * (high - low)
    return math.exp(x) if spec[2:] == ("log",) else x


def density(points: list[float], u: float) -> float:
    """A mixture of a bell around each point, as wide as points are far from each other, and of an even part."""
    width = max(0.05, 1.0 / (1 + len(points)))
    bells = sum(math.exp(-(((u - p) / width) ** 2) / 2) for p in points) / (width * math.sqrt(2 * math.pi))
    return (bells + 1.0) / (len(points) + 1)


def proposed(history: list[tuple[dict, float]], space: Space, trial: int, seed: int = 0, first: int = 8, share: float = 0.25, candidates: int = 24) -> dict:
    """The parameters of the next trial: even draws for the `first` ones; then, per parameter, of `candidates` draws around
    the best `share` of trials the one with the largest ratio of their density to that of the others."""
    if trial < first or len(history) < 2:
        return {n: from_unit(spec, uniform(seed, trial, n)) for n, spec in space.items()}
    order = sorted(range(len(history)), key=lambda i: (-history[i][1], i))
    top = order[: max(1, math.ceil(share * len(history)))]
    good, rest = [history[i][0] for i in top], [history[i][0] for i in order[len(top) :]]
    out = {}
    for n, spec in space.items():
        a, b = [to_unit(spec, h[n]) for h in good], [to_unit(spec, h[n]) for h in rest]
        best = None
        for c in range(candidates):
            if c % 6 == 0:  # some from anywhere
                u = uniform(seed, trial, n, c)
            else:  # a bell around a good trial
                p, width = a[int(uniform(seed, trial, n, c, "of") * len(a))], max(0.05, 1.0 / (1 + len(a)))
                r = math.sqrt(-2 * math.log(1 - uniform(seed, trial, n, c, "r"))) * math.cos(2 * math.pi * uniform(seed, trial, n, c, "t"))
                u = min(max(p + width * r, 0.0), 1.0 - 1e-9)
            ratio = density(a, u) / density(b, u)
            if best is None or ratio > best[0]:
                best = (ratio, u)
        out[n] = from_unit(spec, best[1])
    return out


def searched(spark: SparkSession, space: Space, objective: Callable[[dict], float], trials: int = 50, seed: int = 0, **how) -> DataFrame:
    """trial, params (map of text), score, best (the highest score so far) of every trial; objective(params) runs a Spark job
    and gives a number, more being better; one that is not a number counts as the worst."""
    history: list[tuple[dict, float]] = []
    for t in range(trials):  # each draw depends on the trials before
        params = proposed(history, space, t, seed, **how)
        score = float(objective(params))
        history.append((params, score if score == score else -math.inf))
    rows, best = [], -math.inf
    for t, (params, score) in enumerate(history):
        best = max(best, score)
        rows.append((t, {n: str(v) for n, v in params.items()}, score, best))
    return spark.createDataFrame(rows, "trial int, params map<string,string>, score double, best double")
