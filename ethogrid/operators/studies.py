"""Studies over videos and animals in few passes: a quality gate by nested leave-one-out, distances between all pairs of
animals, detector settings from cumulated counts, and the coherence and lag of two signals."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import welch
from .stats import ks_p

# ---- quality gate ----------------------------------------------------------------------------------------------------


def quality_gate(videos: DataFrame, *by: str) -> DataFrame:
    """by, video_id, q, tau, raw, cor, gated, routed: each video's score if it takes `cor` where its q is above tau and `raw`
    else, tau being chosen on the other videos of its group: the smallest of (just below their least q, their values of q)
    with the best mean score. videos: by, video_id, q, raw, cor, a row a video; those with a null are left out, and so are
    videos without others.

    The gain of a threshold is one running sum over the sorted values of q, and leaving a video out takes its own share off
    the thresholds below its q: the best threshold of each side is a running maximum, so no fold is looped over."""
    keys = list(by) or [F.lit(0).alias("_all")]
    names = list(by) or ["_all"]
    d = videos.where("q IS NOT NULL AND raw IS NOT NULL AND cor IS NOT NULL").select(*keys, "video_id", "q", "raw", "cor", (F.col("cor") - F.col("raw")).alias("gain"))
    steps = d.groupBy(*names, "q").agg(F.sum("gain").alias("gain"), F.count("*").alias("same"))
    w = Window.partitionBy(*names).orderBy("q")
    whole = Window.partitionBy(*names)
    # what the videos above q gain; rounded, so that sums in another order tie alike
    steps = steps.withColumns({"total": F.round(F.sum("gain").over(whole), 9), "g": F.round(F.sum("gain").over(whole) - F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9)})
    best = F.struct("g", (-F.col("q")).alias("below"))
    none = F.struct(F.col("total").alias("g"), F.lit(float("inf")).alias("below"))
    # the first of equal ones: the largest negative threshold
    steps = steps.withColumns({"lower": F.greatest(none, F.max(best).over(w.rowsBetween(Window.unboundedPreceding, -1))), "upper": F.max(best).over(w.rowsBetween(0, Window.unboundedFollowing))})
    least = steps.withColumn("least", F.min("q").over(whole))
    least = least.withColumn("second", F.min(F.when(F.col("q") > F.col("least"), F.col("q"))).over(whole))
    j = d.join(least.drop("gain"), [*names, "q"])
    alone = (F.col("q") == F.col("least")) & (F.col("same") == 1)
    low = F.when(alone, F.col("second")).otherwise(F.col("least")) - 1e-9
    under = F.round(F.col("lower.g") - F.col("gain"), 9) >= F.col("upper.g")
    tau = F.when(under, F.when(F.col("lower.below") == float("inf"), low).otherwise(-F.col("lower.below"))).otherwise(-F.col("upper.below"))
    out = j.withColumn("tau", tau).where("tau IS NOT NULL").withColumn("routed", F.when(F.col("q") > F.col("tau"), "cor").otherwise("raw"))
    return out.select(*by, "video_id", "q", "tau", "raw", "cor", F.when(F.col("routed") == "cor", F.col("cor")).otherwise(F.col("raw")).alias("gated"), "routed")


# ---- distances between animals ---------------------------------------------------------------------------------------


def ks_between(values: DataFrame, value: str, animal: str, animals: list, *by: str) -> DataFrame:
    """by, a, b, n_a, n_b, ks, p: the Kolmogorov-Smirnov distance of each pair of animals of a group (pairs of which one has
    no value are left out). One ordered table of counts by value and animal: running sums give all animals' distributions
    at once, so no pair of rows is formed. animals: all that may occur."""
    d = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).alias("_v")).agg(*[F.count_if(F.col(animal) == a).alias(f"_{i}") for i, a in enumerate(animals)])
    w = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    columns = [f"_{i}" for i in range(len(animals))]
    d = d.select(*by, *[F.try_divide(F.sum(c).over(w), F.sum(c).over(whole)).alias(f"{c}f") for c in columns], *[F.sum(c).over(whole).alias(c) for c in columns])
    pairs = list(combinations(range(len(animals)), 2))
    g = d.groupBy(*by).agg(*[F.max(F.abs(F.col(f"_{i}f") - F.col(f"_{j}f"))).alias(f"k{i}_{j}") for i, j in pairs], *[F.max(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(animals[i]).alias("a"), F.lit(animals[j]).alias("b"), F.col(f"_{i}").alias("n_a"), F.col(f"_{j}").alias("n_b"), F.col(f"k{i}_{j}").alias("ks")) for i, j in pairs])
    out = g.select(*by, F.inline(rows)).where("ks IS NOT NULL")
    return out.withColumn("p", ks_p(F.col("ks"), F.col("n_a"), F.col("n_b")))


# ---- detector settings -----------------------------------------------------------------------------------------------


def detector_settings(frames: DataFrame, cues: dict[str, tuple[float, ...]], group: str = "video_id") -> DataFrame:
    """One row for each combination of the cues' thresholds: the thresholds, <cue>_share (frames that the cue flags) and flagged
    (frames that any flags), shares of a group's frames averaged over groups. A cue flags what is above its threshold, so a
    frame is reduced to how many of the cue's rising thresholds it passes; frames of equal numbers are counted, and every
    combination is a sum of these counts. frames: group and a column per cue (null: not flagged)."""
    names = list(cues)
    if any(list(v) != sorted(v) for v in cues.values()):
        raise ValueError("thresholds must rise")
    passed = {n: reduce(lambda a, b: a + b, [F.coalesce((F.col(n) > t).cast("int"), F.lit(0)) for t in cues[n]]).alias(n) for n in names}
    cells = frames.select(group, *passed.values()).groupBy(group, *names).agg(F.count("*").alias("n"))
    combos = list(product(*[range(len(cues[n])) for n in names]))
    share = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0)) / F.sum("n")
    singles = [(n, i) for n in names for i in range(len(cues[n]))]
    each = [share(F.col(n) > i).alias(f"{n}_{i}") for n, i in singles]
    each += [share(reduce(lambda a, b: a | b, [F.col(n) > i for n, i in zip(names, c)])).alias("any_" + "_".join(map(str, c))) for c in combos]
    one = cells.groupBy(group).agg(*each)
    one = one.agg(*[F.avg(c).alias(c) for c in one.columns if c != group])
    row = lambda c: F.struct(*[F.lit(float(cues[n][i])).alias(n) for n, i in zip(names, c)], *[F.col(f"{n}_{i}").alias(f"{n}_share") for n, i in zip(names, c)], F.col("any_" + "_".join(map(str, c))).alias("flagged"))
    return one.select(F.inline(F.array(*[row(c) for c in combos])))


def calibrated(settings: DataFrame, cap: tuple[str, float], band: tuple[str, float, float], target: float) -> DataFrame:
    """The setting whose flagged share is nearest to target among those whose share of cap's cue is at most its limit and
    that of band's within its limits; if there is none, without the band, then without both. Ties: the smaller flagged
    share, then the smaller thresholds."""
    ok = F.col(f"{cap[0]}_share") <= cap[1]
    both = ok & F.col(f"{band[0]}_share").between(band[1], band[2])
    rank = F.when(both, 0).when(ok, 1).otherwise(2)
    order = [c for c in settings.columns if not c.endswith("_share") and c != "flagged"]
    return settings.orderBy(rank, F.round(F.abs(F.col("flagged") - target), 9), F.round("flagged", 9), *order).limit(1)


# ---- two signals -----------------------------------------------------------------------------------------------------


def signal_agreement(a: np.ndarray, b: np.ndarray, fps: float, top: float = 2.0, few: int = 16) -> tuple:
    """(correlation of both power spectra up to `top` Hz, mean coherence there, lag of b behind a in frames, that lag in
    degrees of the length); a and b on the same frames, NaN where a signal is missing. None where there are `few` common
    frames or fewer.

    Spectra: common frames as they follow each other. Lag: the peak of the cross-correlation of the means' deviations, with
    missing frames as 0, by transforms; the smallest lag of equal peaks."""
    both = np.isfinite(a) & np.isfinite(b)
    x, y = a[both], b[both]
    if len(x) <= few or x.std() == 0 or y.std() == 0:
        return None, None, None, None
    size = min(64, max(4, len(x) // 4))
    f, p = welch(x, size)
    _, q = welch(y, size)
    low = f * fps <= min(top, fps / 4)
    like = float(np.corrcoef(p[low], q[low])[0, 1]) if low.sum() > 1 and p[low].std() > 0 and q[low].std() > 0 else None
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = lambda v: np.array([np.fft.rfft((v[i : i + size] - v[i : i + size].mean()) * w) for i in range(0, len(v) - size + 1, max(size // 2, 1))])
    fx, fy = parts(x), parts(y)
    power = (np.abs(fx) ** 2).mean(0) * (np.abs(fy) ** 2).mean(0)
    coherence = np.abs((fx * np.conj(fy)).mean(0)) ** 2 / np.maximum(power, 1e-300)
    da, db = np.where(both, a - x.mean(), 0), np.where(both, b - y.mean(), 0)
    n = 1 << (2 * len(a) - 1).bit_length()
    cross = np.fft.irfft(np.conj(np.fft.rfft(da, n)) * np.fft.rfft(db, n), n)
    lags = np.r_[0, np.ravel([(-k, k) for k in range(1, len(a))]).astype(int)]
    lag = int(lags[np.argmax(np.round(cross[lags % n] / max(np.abs(cross).max(), 1e-300), 9))])
    return like, float(coherence[low & (f > 0)].mean()) if (low & (f > 0)).any() else None, lag, abs(lag) / len(x) * 360


def agreement(pairs: DataFrame, a: str, b: str, fps: float, keys: tuple[str, ...] = ("video_id", "mouse_id")) -> DataFrame:
    """keys, spectra, coherence, lag, lag_degrees of columns a and b of each group, in order of video_frame; groups are as long
    as a video."""

    def of(key, pdf):
        pdf = pdf.sort_values("video_frame")
        return pd.DataFrame([(*key, *signal_agreement(pdf[a].to_numpy(float), pdf[b].to_numpy(float), fps))], columns=[*keys, "spectra", "coherence", "lag", "lag_degrees"])

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", spectra double, coherence double, lag long, lag_degrees double"
    return pairs.select(*keys, "video_frame", a, b).groupBy(*keys).applyInPandas(of, schema)
