"""Motion: normalised speeds, fidelity and preservation reports, corruption by hashes, and recovery from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import signal as S
from .frames import MOUSE, by_mouse, paired

GROUPS = {"head": ("nose", "ear_left", "ear_right"), "torso": ("neck",), "pelvis": ("hip_left", "hip_right", "tail_base")}


def uniform(tag: str, *keys: str) -> Column:
    """A number in [0, 1) from the hash of a tag and the row's keys, alike at every partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(tag), *keys)), 1, 8), 16, 10).cast("double") / 2.0**32


def normalised_speeds(wide: DataFrame, keypoint: str, fps: float, diagonal: float) -> DataFrame:
    """Steps of a keypoint in arena diagonals per second; the first of a mouse has none."""
    w = by_mouse()
    x, y = f"{keypoint}_x", f"{keypoint}_y"
    v = G.distance(x, y, F.lag(x).over(w), F.lag(y).over(w)) * fps / max(diagonal, 1e-6)
    return wide.select(*MOUSE, "video_frame", v.alias("speed"))


def fidelity(wide: DataFrame, keypoint: str, fps: float, *by: str) -> DataFrame:
    """Median and 99th percentile of speed, mean acceleration and root mean square of jerk of a keypoint, in seconds."""
    w = by_mouse()
    x, y = f"{keypoint}_x", f"{keypoint}_y"
    norm = lambda f, k: F.sqrt(F.pow(f(x, w), F.lit(2)) + F.pow(f(y, w), F.lit(2))) * fps**k
    d = wide.select(*MOUSE, "video_frame", norm(S.step, 1).alias("v"), norm(S.second_difference, 2).alias("a"), norm(S.third_difference, 3).alias("j"))
    p = F.percentile("v", F.array(F.lit(0.5), F.lit(0.99)))
    return d.groupBy(*by).agg(F.get(p, F.lit(0)).alias("speed_median"), F.get(p, F.lit(1)).alias("speed_p99"), F.avg("a").alias("accel_mean"), F.sqrt(F.avg(F.col("j") * F.col("j"))).alias("jerk_rms"))


def preservation(before: DataFrame, after: DataFrame, keypoint: str, fps: float, *by: str) -> DataFrame:
    """The figures of fidelity before and after a correction in long form, and their ratio."""
    names = ["speed_median", "speed_p99", "accel_mean", "jerk_rms"]
    long = lambda df, n: fidelity(df, keypoint, fps, *by).select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias(n)) for c in names])))
    return long(before, "before").join(long(after, "after"), [*by, "metric"]).withColumn("ratio", F.try_divide("after", "before"))


def displaced(before: DataFrame, after: DataFrame, keypoints: list[str], far: float, *by: str) -> DataFrame:
    """Per group and keypoint: how far a correction moved it (mean, largest), the share moved further than `far`, gaps
    filled and values lost."""
    keys = [*MOUSE, "video_frame"]
    cols = [f"{k}_{a}" for k in keypoints for a in "xy"]
    j = before.select(*keys, *cols).join(after.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols]), keys)
    parts = F.array(*[F.struct(F.lit(k).alias("keypoint"), G.distance(f"{k}_x", f"{k}_y", f"_{k}_x", f"_{k}_y").alias("e"), F.col(f"{k}_x").isNull().alias("was"), F.col(f"_{k}_x").isNull().alias("now")) for k in keypoints])
    d = j.select(*by, F.inline(parts))
    return d.groupBy(*by, "keypoint").agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.max("e").alias("largest"), F.avg((F.col("e") > far).cast("int")).alias("far"), F.count_if(F.col("was") & ~F.col("now")).alias("filled"), F.count_if(~F.col("was") & F.col("now")).alias("lost"))


def _length(wide: DataFrame) -> DataFrame:
    return wide.withColumn("_n", F.count("*").over(Window.partitionBy(*MOUSE))).withColumn("_at", F.row_number().over(by_mouse()) - 1)


def occluded(wide: DataFrame, segments: int = 3, low: int = 10, high: int = 50, seed: int = 0) -> DataFrame:
    """Spells of low .. high frames in which a group of keypoints is lost (both coordinates 0), for head and pelvis."""
    d = _length(wide)
    out = {}
    for g in ("head", "pelvis"):
        hit = F.lit(False)
        for s in range(segments):
            size = low + F.floor(uniform(f"{seed}size{g}{s}", *MOUSE) * (high - low + 1))
            first = F.floor(uniform(f"{seed}first{g}{s}", *MOUSE) * (F.col("_n") - size))
            hit = hit | ((F.col("_n") > size) & (F.col("_at") >= first) & (F.col("_at") < first + size))
        out |= {f"{k}_{a}": F.when(hit, 0.0).otherwise(F.col(f"{k}_{a}")) for k in GROUPS[g] for a in "xy"}
    return d.withColumns(out).select(*wide.columns)


def correlated(wide: DataFrame, share: float = 0.05, noise: float = 10.0, seed: int = 0) -> DataFrame:
    """Frames in which all keypoints of a group are displaced alike, by up to `noise` each way."""
    key = [*MOUSE, "video_frame"]
    out = {}
    for g, points in GROUPS.items():
        hit = uniform(f"{seed}hit{g}", *key) < share
        out |= {f"{k}_{a}": F.when(hit, F.col(f"{k}_{a}") + noise * (2 * uniform(f"{seed}{a}{g}", *key) - 1)).otherwise(F.col(f"{k}_{a}")) for k in points for a in "xy"}
    return wide.withColumns(out)


def spiked(wide: DataFrame, keypoint: str, share: float = 0.01, size: float = 60.0, seed: int = 0) -> DataFrame:
    """Single frames in which a keypoint jumps by `size` in some direction."""
    key = [*MOUSE, "video_frame"]
    turn = 2 * F.pi() * uniform(f"{seed}turn{keypoint}", *key)
    hit = uniform(f"{seed}spike{keypoint}", *key) < share
    step = {"x": F.cos(turn), "y": F.sin(turn)}
    return wide.withColumns({f"{keypoint}_{a}": F.when(hit, F.col(f"{keypoint}_{a}") + size * step[a]).otherwise(F.col(f"{keypoint}_{a}")) for a in "xy"})


def drifting(wide: DataFrame, keypoint: str, size: float = 5.0, period: float = 200.0) -> DataFrame:
    """A slow circle added to a keypoint."""
    turn = 2 * F.pi() * F.col("video_frame") / period
    return wide.withColumns({f"{keypoint}_x": F.col(f"{keypoint}_x") + size * F.sin(turn), f"{keypoint}_y": F.col(f"{keypoint}_y") + size * F.cos(turn)})


def swapped_ends(wide: DataFrame, share: float = 0.05, seed: int = 0) -> DataFrame:
    """Frames in which left and right of ears and hips are exchanged."""
    hit = uniform(f"{seed}swap", *MOUSE, "video_frame") < share
    pairs = [(f"{p}_left_{a}", f"{p}_right_{a}") for p in ("ear", "hip") for a in "xy"]
    return wide.withColumns({a: F.when(hit, F.col(b)).otherwise(F.col(a)) for p in pairs for a, b in (p, p[::-1])})


def burst(wide: DataFrame, frames: int = 20, low: float = 20.0, high: float = 40.0, seed: int = 0) -> DataFrame:
    """One spell of a mouse in which the head swings (grooming)."""
    d = _length(wide)
    first = F.floor(uniform(f"{seed}burst", *MOUSE) * (F.col("_n") - frames))
    i = F.col("_at") - first
    hit = (F.col("_n") > frames) & (i >= 0) & (i < frames)
    size = low + (high - low) * uniform(f"{seed}size", *MOUSE)
    turn = 2 * F.pi() * (3 + 5 * uniform(f"{seed}rate", *MOUSE)) * i / frames
    step = {"x": size * F.sin(turn), "y": size * 0.3 * F.cos(turn * 1.3)}
    return d.withColumns({f"{k}_{a}": F.when(hit, F.col(f"{k}_{a}") + step[a]).otherwise(F.col(f"{k}_{a}")) for k in GROUPS["head"] for a in "xy"}).select(*wide.columns)


def recovery(clean: DataFrame, corrupt: DataFrame, repaired: DataFrame, keypoints: list[str], *by: str) -> DataFrame:
    """Root mean square distance to the clean places before and after a repair, and the share of the error that went."""
    keys = [*MOUSE, "video_frame"]
    cols = [f"{k}_{a}" for k in keypoints for a in "xy"]
    j = clean.select(*keys, *[c for c in by if c not in keys], *cols)
    for df, n in ((corrupt, "c"), (repaired, "r")):
        j = j.join(df.select(*keys, *[F.col(c).alias(f"{n}_{c}") for c in cols]), keys)
    return recovered(j, keypoints, *by)


def recovered(j: DataFrame, keypoints: list[str], *by: str) -> DataFrame:
    """recovery of rows that hold a keypoint's clean places (<keypoint>_x), corrupt (c_<keypoint>_x) and repaired ones (r_)."""
    parts = F.array(*[F.struct(F.lit(k).alias("keypoint"), *[G.distance(f"{k}_x", f"{k}_y", f"{n}_{k}_x", f"{n}_{k}_y").alias(n) for n in "cr"]) for k in keypoints])
    d = j.select(*by, F.inline(parts))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return d.groupBy(*by, "keypoint").agg(rms("c").alias("before"), rms("r").alias("after"), (1 - F.try_divide(rms("r"), rms("c"))).alias("recovered"))


def nodes(features: DataFrame, keypoints: list[str], each: tuple[str, ...]) -> DataFrame:
    """Per frame a matrix of keypoints by features, for models on the skeleton's graph; missing ones are 0."""
    row = lambda k: F.array(*[F.coalesce(F.col(f"{k}_{e}"), F.lit(0.0)) for e in each])
    return features.select(*MOUSE, "video_frame", F.array(*[row(k) for k in keypoints]).alias("nodes"))


def symmetric_swaps(wide: DataFrame, back: int = 3, pairs: tuple[str, ...] = ("ear", "hip")) -> DataFrame:
    """Left and right of a pair exchanged where that fits the places `back` frames and less ago better, frame by frame; a
    frame is judged against the frames as already mended, so each mouse is one grouped function over its own frames."""
    import numpy as np

    cols = [f"{p}_{s}_{a}" for p in pairs for s in ("left", "right") for a in "xy"]

    def of(pdf):
        pdf = pdf.sort_values("video_frame", ignore_index=True)
        v = pdf[cols].to_numpy(float).reshape(len(pdf), len(pairs), 2, 2)
        flag = np.zeros((len(pdf), len(pairs)), bool)
        for t in range(1, len(v)):
            past = v[max(0, t - back) : t]
            known = np.isfinite(past).all(axis=(2, 3))
            mean = np.where(known[:, :, None, None], past, 0).sum(0) / np.maximum(known.sum(0), 1)[:, None, None]
            stay, cross = (np.sqrt(((x - mean) ** 2).sum(-1)).sum(-1) for x in (v[t], v[t][:, ::-1]))
            flag[t] = known.any(0) & np.isfinite(stay) & (cross < stay)
            v[t][flag[t]] = v[t][flag[t]][:, ::-1]
        pdf[cols] = v.reshape(len(pdf), -1)
        for k, p in enumerate(pairs):
            pdf[f"{p}_swapped"] = flag[:, k]
        return pdf

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema)
    return wide.groupBy(*MOUSE).applyInPandas(of, types + "".join(f", {p}_swapped boolean" for p in pairs))


def identity_check(wide: DataFrame, near: float, around: int = 12, ratio: float = 1.15, most: int = 60) -> DataFrame:
    """Spells in which two mice of a video (each pair, a < b) are nearer than `near` (huddles) of at most `most` frames, after which the crossed
    assignment fits better: with median places in the `around` frames before and after, staying costs more than `ratio`
    times crossing. One row per huddle: video_id, a, b, first, last, stay, cross, inverted."""
    pair = ["video_id", "a", "b"]
    w = Window.partitionBy(*pair).orderBy("video_frame")
    mid = lambda a: G.mean_of("neck_" + a, "tail_base_" + a)
    d = paired(wide.select("video_id", "video_frame", "mouse_id", mid("x").alias("x"), mid("y").alias("y")), ["x", "y"])
    d = d.toDF(*pair, "video_frame", "x1", "y1", "x2", "y2")
    med = lambda c, a, b: S.array_median(F.collect_list(c).over(w.rowsBetween(a, b)))
    d = d.withColumns({f"b{c}": med(c, -around, -1) for c in ("x1", "y1", "x2", "y2")} | {f"a{c}": med(c, 1, around) for c in ("x1", "y1", "x2", "y2")})
    d = d.withColumn("huddle", F.coalesce(G.distance("x1", "y1", "x2", "y2") < near, F.lit(False)))
    d = d.withColumn("run", S.run_id(F.col("huddle") != F.lag("huddle").over(w), w)).where("huddle")
    first, last = F.min_by, F.max_by
    g = d.groupBy(*pair, "run").agg(F.min("video_frame").alias("first"), F.max("video_frame").alias("last"), F.count("*").alias("n"), *[first(f"b{c}", "video_frame").alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")], *[last(f"a{c}", "video_frame").alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    cost = lambda p, q: G.distance(f"bx{p}", f"by{p}", f"ax{q}", f"ay{q}")
    g = g.where(F.col("n") <= most).withColumns({"stay": cost(1, 1) + cost(2, 2), "cross": cost(1, 2) + cost(2, 1)})
    return g.select(*pair, "first", "last", "stay", "cross", F.coalesce(F.col("stay") > ratio * F.col("cross"), F.lit(False)).alias("inverted"))

