"""Per-frame features: pivot, cleaning, kinematics, angles, implied depth, and relations of ordered pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import signal as S
from ..sources.adapters import KEYPOINTS, XY
from ..sources.readers import null_if_not_finite

MOUSE = ["video_id", "mouse_id"]


def by_mouse(frame: str = "video_frame"):
    return Window.partitionBy(*MOUSE).orderBy(frame)


def to_wide(long: DataFrame, keypoints: list[str] = KEYPOINTS) -> DataFrame:
    """One row per frame and mouse, by one aggregate with a condition per column: a pivot shuffles every keypoint's row, and all
    columns a second time."""
    value = lambda k, a: F.first(F.when(F.col("bodypart") == k, F.col(a)), ignorenulls=True).alias(f"{k}_{a}")
    return long.groupBy(*MOUSE, "video_frame").agg(*[value(k, a) for k in keypoints for a in "xy"])


def without_zero_frames(wide: DataFrame, keypoints: list[str] = KEYPOINTS) -> DataFrame:
    """Drop rows whose coordinates are all exactly 0; a row with a missing one stays."""
    cols = [c for c in (f"{k}_{a}" for k in keypoints for a in "xy") if c in wide.columns]
    return wide.where(~reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(0.0)) for c in cols]))


def scaled(wide: DataFrame, body: Column | float, center: str = "none", keypoints: list[str] = KEYPOINTS) -> DataFrame:
    """Coordinates over the body length; center='centroid' also takes off the mean of the row's non-zero ones."""
    out = wide.withColumns({c: F.col(c) / body for c in (f"{k}_{a}" for k in keypoints for a in "xy")})
    if center == "none":
        return out
    for a in "xy":
        mid = G.mean_of(*[F.nullif(F.col(f"{k}_{a}"), F.lit(0.0)) for k in keypoints])
        out = out.withColumn(f"_m{a}", mid)
    return out.withColumns({f"{k}_{a}": F.col(f"{k}_{a}") - F.coalesce(f"_m{a}", F.lit(0.0)) for k in keypoints for a in "xy"}).drop("_mx", "_my")


def smoothed(wide: DataFrame, columns: list[str] = XY, width: int = 9, order: int = 3) -> DataFrame:
    """Savitzky-Golay over each mouse's frames; gaps are filled linearly for it and stay gaps. All columns of a mouse are
    smoothed at once in one grouped function: as window expressions each column takes a dozen frames of its own."""
    weights, h = np.array(S.savgol_weights(width, order)), width // 2

    def of(pdf):
        pdf = pdf.sort_values("video_frame", ignore_index=True)
        n = len(pdf)
        if n < width:
            return pdf
        v = pdf[columns].to_numpy(float)
        known = np.isfinite(v)
        for k in np.flatnonzero(known.any(axis=0)):
            v[:, k] = np.interp(np.arange(n), np.flatnonzero(known[:, k]), v[known[:, k], k])
        v = np.pad(v, ((h, h), (0, 0)), mode="edge")
        smooth = sum(w * v[k : k + n] for k, w in enumerate(weights))
        pdf[columns] = np.where(known, smooth, np.nan)
        return pdf

    types = ", ".join(f"`{f.name}` {'double' if f.name in columns else f.dataType.simpleString()}" for f in wide.schema)
    out = wide.groupBy(*MOUSE).applyInPandas(of, types)
    return out.withColumns({c: null_if_not_finite(F.col(c)) for c in columns})


def with_centroid(wide: DataFrame, keypoints: list[str] = KEYPOINTS) -> DataFrame:
    return wide.withColumns({f"centroid_{a}": G.mean_of(*[f"{k}_{a}" for k in keypoints]) for a in "xy"})


def kinematics(wide: DataFrame, keypoints: list[str] = KEYPOINTS, smooth: int = 9) -> DataFrame:
    """Centroid and keypoint velocities, accelerations, jerk, body angle, its rate, and body length, of positions smoothed
    over `smooth` frames (0: as they are)."""
    w = by_mouse()
    if smooth:
        xy = [f"{k}_{a}" for k in keypoints for a in "xy"]
        wide = smoothed(wide.select(*MOUSE, "video_frame", *xy), xy, smooth)
    d = with_centroid(wide, keypoints)
    out = {f"centroid_v{a}": S.half_difference(f"centroid_{a}", w) for a in "xy"}
    out |= {f"centroid_a{a}": S.second_difference(f"centroid_{a}", w) for a in "xy"}
    for k in keypoints:
        out |= {f"{k}_v{a}": S.half_difference(f"{k}_{a}", w) for a in "xy"}
        out |= {f"_{k}_a{a}": S.second_difference(f"{k}_{a}", w) for a in "xy"}
    out |= {"body_angle": G.heading("nose_x", "nose_y", "tail_base_x", "tail_base_y"), "body_length": G.apart("nose", "tail_base")}
    d = d.withColumns(out)
    norm = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    more = {"centroid_speed": norm("centroid_vx", "centroid_vy"), "centroid_accel": norm("centroid_ax", "centroid_ay"), "body_angle_vel": G.wrap(S.half_difference("body_angle", w))}
    more |= {f"_j{a}": S.half_difference(f"centroid_a{a}", w) for a in "xy"}
    for k in keypoints:
        more |= {f"{k}_speed": norm(f"{k}_vx", f"{k}_vy"), f"{k}_accel": norm(f"_{k}_ax", f"_{k}_ay")}
    d = d.withColumns(more).withColumn("centroid_jerk", norm("_jx", "_jy"))
    names = ["centroid_x", "centroid_y", "centroid_vx", "centroid_vy", "centroid_speed", "centroid_ax", "centroid_ay", "centroid_accel", "centroid_jerk"]
    names += [f"{k}_{x}" for k in keypoints for x in ("vx", "vy", "speed", "accel")] + ["body_angle", "body_angle_vel", "body_length"]
    return d.select(*MOUSE, "video_frame", *names)


def segment_angles(wide: DataFrame) -> DataFrame:
    """Angles at the neck (nose to the middle of the hips) and at each hip (neck to tail)."""
    d = wide.withColumns({f"hips_{a}": G.mean_of(f"hip_left_{a}", f"hip_right_{a}") for a in "xy"})
    return d.select(*MOUSE, "video_frame", G.vertex_angle("nose", "neck", "hips").alias("neck_spine"), G.vertex_angle("neck", "hip_left", "tail_base").alias("hip_tail_left"), G.vertex_angle("neck", "hip_right", "tail_base").alias("hip_tail_right"))


def implied_depth(wide: DataFrame, unit: float = 1.0) -> DataFrame:
    """dz of each edge and their sum (missing ones count 0)."""
    steps = G.depth_steps(unit=unit)
    names = [f"dz_{a}_{b}" for a, b in G.EDGES]
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in steps])
    return wide.select(*MOUSE, "video_frame", *[s.alias(n) for s, n in zip(steps, names)], total.alias("dz_sum"))


def ordered_pairs(mice: DataFrame) -> DataFrame:
    """agent, target of all ordered pairs of a video's mice; a lone mouse is paired with none."""
    m = mice.select(*MOUSE).distinct()
    other = m.select("video_id", F.col("mouse_id").alias("target"))
    pairs = m.withColumnRenamed("mouse_id", "agent").join(other, "video_id").where("agent <> target")
    alone = m.groupBy("video_id").agg(F.count("*").alias("n"), F.first("mouse_id").alias("agent")).where("n = 1")
    return pairs.unionByName(alone.select("video_id", "agent", F.lit(None).cast("int").alias("target")))


def paired(wide: DataFrame, columns: list[str]) -> DataFrame:
    """video_id, a, b, video_frame, and each column of both (a_*, b_*; null where one lacks the frame): a row for each pair of a
    video's mice (a < b) and each frame that either has."""
    mice = wide.select(*MOUSE).distinct()
    pairs = mice.withColumnRenamed("mouse_id", "a").join(mice.withColumnRenamed("mouse_id", "b"), "video_id").where("a < b")  # of one video
    d = wide.select(*MOUSE, "video_frame", *columns).join(pairs, "video_id").where("mouse_id = a OR mouse_id = b")
    return d.groupBy("video_id", "a", "b", "video_frame").agg(*[F.max(F.when(F.col("mouse_id") == F.col(s), F.col(c))).alias(f"{s}_{c}") for s in "ab" for c in columns])


def aligned(wide: DataFrame) -> DataFrame:
    """Frames that both mice of an ordered pair have: a_* and b_* columns. Rows are dealt by video once; a frame's mice then meet
    within a task, and windows over a pair need no other shuffle."""
    keep = [c for c in wide.columns if c not in (*MOUSE, "video_frame")]
    known = wide.where("video_id IS NOT NULL AND video_frame IS NOT NULL").select(*MOUSE, "video_frame", *keep).repartition("video_id")
    frames = known.groupBy("video_id", "video_frame").agg(F.collect_list(F.struct("mouse_id", *keep)).alias("_all"))
    pairs = frames.select("video_id", "video_frame", "_all", F.explode("_all").alias("_a")).select("video_id", "video_frame", "_a", F.explode("_all").alias("_b"))
    side = lambda s, name: [F.col(f"_{s}.mouse_id").alias(name), *[F.col(f"_{s}")[c].alias(f"{s}_{c}") for c in keep]]
    return pairs.where("_a.mouse_id <> _b.mouse_id").select("video_id", "video_frame", *side("a", "agent"), *side("b", "target"))


def relations(wide: DataFrame, keypoints: list[str] = KEYPOINTS) -> DataFrame:
    """Distances, angles, rates and egocentric positions of each ordered pair, per common frame."""
    d = aligned(with_centroid(wide, keypoints))
    w = Window.partitionBy("video_id", "agent", "target").orderBy("video_frame")
    for side in "ab":
        for part in ("ear", "hip"):
            d = d.withColumns({f"{side}_{part}_{x}": G.mean_of(f"{side}_{part}_left_{x}", f"{side}_{part}_right_{x}") for x in "xy"})
    far = lambda p, q, ab=("a_", "b_"): G.apart(p, q, *ab)
    head = {"dist_centroid": far("centroid", "centroid"), "dist_nose_nose": far("nose", "nose"), "dist_nose_a_tail_b": far("nose", "tail_base"), "dist_nose_b_tail_a": far("nose", "tail_base", ("b_", "a_")), "dist_nose_a_neck_b": far("nose", "neck"), "dist_nose_a_ear_b": far("nose", "ear"), "dist_nose_a_hip_b": far("nose", "hip")}
    for s in "ab":
        head[f"_ang_{s}"] = G.heading(f"{s}_nose_x", f"{s}_nose_y", f"{s}_tail_base_x", f"{s}_tail_base_y")
        head[f"_head_{s}"] = G.heading(f"{s}_tail_base_x", f"{s}_tail_base_y", f"{s}_nose_x", f"{s}_nose_y")
        vx, vy = (S.half_difference(f"{s}_centroid_{x}", w) for x in "xy")
        head[f"speed_{s}"] = F.sqrt(vx * vx + vy * vy)
    # written out and sorted without a comparator, so that all of it is compiled
    apart = [G.distance(f"a_{p}_x", f"a_{p}_y", f"b_{q}_x", f"b_{q}_y") for p in keypoints for q in keypoints]
    head["_gaps"] = F.sort_array(F.array_compact(F.array(*apart)))
    d = d.withColumns(head)
    facing = F.col("_ang_a") - G.heading("a_centroid_x", "a_centroid_y", "b_centroid_x", "b_centroid_y")
    fwd, lat = G.to_frame(F.col("_head_a"), F.col("b_centroid_x") - F.col("a_centroid_x"), F.col("b_centroid_y") - F.col("a_centroid_y"))
    nfwd, nlat = G.to_frame(F.col("_head_b"), F.col("a_nose_x") - F.col("b_centroid_x"), F.col("a_nose_y") - F.col("b_centroid_y"))
    near, tail = F.col("dist_nose_a_neck_b"), F.col("dist_nose_a_tail_b")
    rate = S.half_difference("dist_centroid", w)
    more = {"sniff_site_ratio": (tail - near) / (tail + near + 1e-6), "angle_relative": G.wrap(F.col("_ang_a") - F.col("_ang_b")), "approach_rate": rate, "facing_b": F.cos(G.wrap(facing)), "speed_relative": F.col("speed_a") - F.col("speed_b"), "min_kp_dist": F.get("_gaps", F.lit(0)), "mean_k3_kp_dist": F.when(F.size("_gaps") >= 3, (F.get("_gaps", F.lit(0)) + F.get("_gaps", F.lit(1)) + F.get("_gaps", F.lit(2))) / 3), "rel_fwd": fwd, "rel_lat": lat, "nose_a_in_b_fwd": nfwd, "nose_a_in_b_lat": nlat, "closing_speed": -rate}
    names = [n for n in [*head, *more] if not n.startswith("_")]
    return d.withColumns(more).select("video_id", "agent", "target", "video_frame", *names)


def features(wide: DataFrame, smooth: int = 9, unit: float = 1.0, keypoints: list[str] = KEYPOINTS) -> DataFrame:
    """All features of each mouse's frames towards each other mouse (a lone mouse: towards none): its kinematics, segment
    angles and implied depths, and the relations, which are empty on frames that the other mouse lacks."""
    keys = [*MOUSE, "video_frame"]
    own = kinematics(wide, keypoints, smooth).join(segment_angles(wide), keys).join(implied_depth(wide, unit), keys)
    own = own.withColumnRenamed("mouse_id", "agent").join(ordered_pairs(wide), ["video_id", "agent"])
    return own.join(relations(wide, keypoints), ["video_id", "agent", "target", "video_frame"], "left")


def occlusion(wide: DataFrame, near: float = 0.25, keypoints: list[str] = KEYPOINTS) -> DataFrame:
    """Box overlap of each ordered pair, and the shares of the agent's keypoints inside the other's box and near it."""
    d = aligned(wide)
    side = {}
    for s in "ab":
        for x in "xy":
            a = F.array(*[f"{s}_{k}_{x}" for k in keypoints])
            side |= {f"_{s}{x}0": F.array_min(a), f"_{s}{x}1": F.array_max(a)}
    d = d.withColumns(side)
    c = F.col
    cut = [F.greatest(F.least(c(f"_a{x}1"), c(f"_b{x}1")) - F.greatest(c(f"_a{x}0"), c(f"_b{x}0")), F.lit(0.0)) for x in "xy"]
    area = {s: (c(f"_{s}x1") - c(f"_{s}x0")) * (c(f"_{s}y1") - c(f"_{s}y0")) for s in "ab"}
    diagonal = {s: G.distance(f"_{s}x0", f"_{s}y0", f"_{s}x1", f"_{s}y1") for s in "ab"}
    inter = cut[0] * cut[1]
    union = area["a"] + area["b"] - inter
    points = {s: F.array(*[F.struct(c(f"{s}_{k}_x").alias("x"), c(f"{s}_{k}_y").alias("y")) for k in keypoints]) for s in "ab"}
    valid = F.filter(points["a"], lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    inside = F.filter(valid, lambda p: p["x"].between(c("_bx0"), c("_bx1")) & p["y"].between(c("_by0"), c("_by1")))
    close = F.filter(valid, lambda p: F.exists(points["b"], lambda q: F.coalesce((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) < near * near, F.lit(False))))
    return d.select("video_id", "agent", "target", "video_frame", F.when(union > 0, inter / union).otherwise(0.0).alias("bbox_iou"), F.when(area["b"] > 0, area["a"] / area["b"]).alias("area_ratio"), F.when(diagonal["b"] > 0, diagonal["a"] / diagonal["b"]).alias("body_len_ratio"), F.try_divide(F.size(inside), F.size(valid)).alias("frac_kp_inside"), F.try_divide(F.size(close), F.size(valid)).alias("frac_kp_close"))
