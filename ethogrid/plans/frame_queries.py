"""Queries on frames: sources, cleaning, features, signals, windows; and their SQL. Floats are rounded to 4 digits, or
to 8 where short decimals would make ties of the 4th."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import signal as S
from ..operators import frames as P
from ..operators import windows as Wn
from ..sources import readers as R
from ..sources import sinks
from ..sources.adapters import KEYPOINTS, LONG_SQL, META_SQL, POSE_SQL, XY, meta_raw, pose, to_long

W = "OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame)"
KEYS = "video_id, mouse_id, video_frame"


def r4(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rs(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


# ---- sources and cleaning ----


def fr_metadata(spark, d):
    m = R.with_metadata(meta_raw(spark, d))
    return m.select("video_id", "lab_id", F.array_join("body_parts_tracked", ";").alias("parts"), F.array_join("behaviors_labeled", ";").alias("behaviors"), "n_body_parts", "n_behaviors_labeled", "n_mice")


def fr_tracking_normalised(spark, d):
    long = to_long(pose(spark, d).select("video_id", "mouse_id", "video_frame", "nose_x", "nose_y"), ["nose"])
    meta = meta_raw(spark, d).select("video_id", "video_width_pix", "video_height_pix")
    return r4(R.normalised(long, meta, "video_id"), 8)


def fr_long_to_wide(spark, d):
    return r4(P.to_wide(to_long(pose(spark, d)).where("x IS NOT NULL")).select("video_id", "mouse_id", "video_frame", "nose_x", "tail_base_x", "hip_left_y"), 8)


def fr_zero_frames(spark, d):
    return P.without_zero_frames(pose(spark, d)).groupBy("video_id").agg(F.count("*").alias("n"))


def fr_scaled_centroid(spark, d):
    return r4(P.scaled(pose(spark, d), 10.0, "centroid").select("video_id", "mouse_id", "video_frame", "nose_x", "nose_y", "tail_base_x"), 8)


def fr_frame_limit(spark, d):
    return pose(spark, d).where("video_frame < 100").groupBy("video_id", "mouse_id").agg(F.count("*").alias("n"), F.max("video_frame").alias("last"))


def fr_fingerprint(spark, d):
    return sinks.fingerprint(pose(spark, d))


def fr_confidence_gate(spark, d):
    p = pose(spark, d).withColumn("confidence", F.pmod(F.col("video_frame") * 7, F.lit(10)) / 10)
    return r4(p.select("video_id", "mouse_id", "video_frame", S.gated("nose_x", "confidence", 0.4, P.by_mouse()).alias("x")))


def fr_dropout_masks(spark, d):
    p = pose(spark, d)
    zero = F.forall(F.array(*XY), lambda v: F.coalesce(v == 0, F.lit(False)))
    near = F.coalesce((F.abs("tail_base_x") < 2) & (F.abs("tail_base_y") < 2), F.lit(False)) & ~zero
    return p.groupBy("video_id").agg(F.count_if(F.col("tail_base_x").isNull()).alias("missing"), F.count_if(near).alias("near_zero"), F.count_if(zero).alias("zero_frames"))


def fr_impute(spark, d):
    """Gaps: 0, forward then backward, and linear."""
    w = P.by_mouse()
    x = F.col("tail_base_x")
    both = F.coalesce(S.forward_fill(x, w), S.backward_fill(x, w))
    return r4(pose(spark, d).select("video_id", "mouse_id", "video_frame", F.coalesce(x, F.lit(0.0)).alias("zero"), both.alias("filled"), S.interpolate(x, "video_frame", w).alias("linear")))


def fr_mean_impute(spark, d):
    p = pose(spark, d)
    mean = F.avg("tail_base_x").over(Window.partitionBy("video_id"))
    return r4(p.select("video_id", "mouse_id", "video_frame", F.coalesce("tail_base_x", mean, F.lit(0.0)).alias("x")))


def fr_circular_encode(spark, d):
    k = P.kinematics(pose(spark, d), smooth=0).select("video_id", "mouse_id", "video_frame", "body_angle")
    return r4(Wn.circular(k, ["body_angle"]))


def fr_validate_features(spark, d):
    """Share of missing values per column."""
    return r4(Wn.missing_shares(pose(spark, d), XY))


def fr_decimate(spark, d):
    return Wn.decimated(pose(spark, d).select("video_id", "mouse_id", "video_frame"), ["video_id"], ["mouse_id", "video_frame"], 40)


def fr_cap_per_group(spark, d):
    return Wn.capped(pose(spark, d).select("video_id", "mouse_id", "video_frame"), ["video_id"], ["mouse_id", "video_frame"], 10)


def fr_union_reindex(spark, d):
    p = pose(spark, d)
    a = p.where("mouse_id = 1").select("video_id", "nose_x", "neck_x")
    b = p.where("mouse_id = 2").select("video_id", "nose_x", "tail_base_x")
    return r4(a.unionByName(b, allowMissingColumns=True).na.fill(0.0).groupBy("video_id").agg(*[F.sum(c).alias(c) for c in ("nose_x", "neck_x", "tail_base_x")]))


def fr_behaviour_state(spark, d):
    k = P.kinematics(pose(spark, d), smooth=0).select("video_id", "mouse_id", "video_frame", "centroid_speed").join(P.implied_depth(pose(spark, d), 100.0).select("video_id", "mouse_id", "video_frame", "dz_sum"), ["video_id", "mouse_id", "video_frame"])
    cut = k.groupBy("video_id").agg(F.percentile("dz_sum", F.lit(0.75)).alias("q"), F.percentile("centroid_speed", F.lit(0.9)).alias("s"))
    state = F.when(F.col("dz_sum") > F.col("q"), "rearing").when(F.col("centroid_speed") > F.col("s"), "locomotion").otherwise("static")
    return k.join(cut, "video_id").groupBy("video_id", state.alias("state")).agg(F.count("*").alias("n"))


def fr_best_frames(spark, d):
    """The three best frames of each video: whole ones first, then those with most keypoints, the longest body first."""
    p = pose(spark, d)
    known = F.size(F.array_compact(F.array(*[F.col(c) for c in XY])))
    tier = F.when(known == len(XY), 0).when(known >= 12, 1).otherwise(2)
    body = F.coalesce(F.round(G.apart("nose", "tail_base"), 4), F.lit(-1.0))
    rn = F.row_number().over(Window.partitionBy("video_id").orderBy("tier", F.desc("body"), "mouse_id", "video_frame"))
    return p.select("video_id", "mouse_id", "video_frame", tier.alias("tier"), body.alias("body")).withColumn("rn", rn).where("rn <= 3")


# ---- features ----


def fr_body_length(spark, d):
    """Nose and tail met by one conditional aggregate instead of a self join."""
    long = to_long(pose(spark, d).select("video_id", "mouse_id", "video_frame", "nose_x", "nose_y", "tail_base_x", "tail_base_y"), ["nose", "tail_base"])
    pick = lambda k, a: F.max(F.when(F.col("bodypart") == k, F.col(a))).alias(f"{k}_{a}")
    w = long.groupBy("video_id", "mouse_id", "video_frame").agg(*[pick(k, a) for k in ("nose", "tail_base") for a in "xy"])
    return r4(w.select("video_id", "mouse_id", "video_frame", G.apart("nose", "tail_base").alias("body_length")), 8)


def fr_kinematics(spark, d):
    k = P.kinematics(pose(spark, d))  # of smoothed positions
    return r4(k.select("video_id", "mouse_id", "video_frame", "centroid_x", "centroid_speed", "centroid_accel", "centroid_jerk", "nose_speed", "nose_accel", "hip_left_vx", "body_angle", "body_angle_vel", "body_length"), 8)


def fr_segment_angles(spark, d):
    return r4(P.segment_angles(pose(spark, d)))


def fr_implied_depth(spark, d):
    return r4(P.implied_depth(pose(spark, d), 100.0).select("video_id", "mouse_id", "video_frame", "dz_nose_neck", "dz_sum"))


def fr_ordered_pairs(spark, d):
    return P.ordered_pairs(pose(spark, d))


def fr_relations(spark, d):
    return r4(P.relations(pose(spark, d)), 8)


def fr_occlusion(spark, d):
    return r4(P.occlusion(pose(spark, d), near=1.0))


def fr_cross_sine(spark, d):
    return r4(pose(spark, d).select("video_id", "mouse_id", "video_frame", G.cross_sine("tail_base", "neck", "nose").alias("s")))


# ---- signals ----


def fr_savgol(spark, d):
    return r4(P.smoothed(pose(spark, d).select("video_id", "mouse_id", "video_frame", "nose_x", "tail_base_x"), ["nose_x", "tail_base_x"]))


def fr_hampel(spark, d):
    return r4(pose(spark, d).select("video_id", "mouse_id", "video_frame", S.hampel("tail_base_y", P.by_mouse(), 3, 2.0).alias("y")))


def fr_differences(spark, d):
    w = P.by_mouse()
    return r4(pose(spark, d).select("video_id", "mouse_id", "video_frame", S.step("nose_x", w).alias("d1"), S.half_difference("nose_x", w).alias("v"), S.second_difference("nose_x", w).alias("a"), S.third_difference("nose_x", w).alias("d3")))


def fr_gap_speed(spark, d):
    """Speed per elapsed frame over the rows that are known."""
    w = P.by_mouse()
    p = pose(spark, d).where("tail_base_x IS NOT NULL")
    v = F.try_divide(G.distance("tail_base_x", "tail_base_y", F.lag("tail_base_x").over(w), F.lag("tail_base_y").over(w)), S.step("video_frame", w))
    return r4(p.select("video_id", "mouse_id", "video_frame", v.alias("speed")))


def fr_context(spark, d):
    past, coming = S.context_means("nose_x", P.by_mouse(), 3)
    return r4(pose(spark, d).select("video_id", "mouse_id", "video_frame", past.alias("past"), coming.alias("coming")))


def fr_moving_average(spark, d):
    return r4(pose(spark, d).select("video_id", "mouse_id", "video_frame", S.moving_average("nose_x", P.by_mouse(), 5).alias("m")))


def fr_missing_runs(spark, d):
    """Longest run of frames without a tail."""
    w = P.by_mouse()
    gap = F.col("tail_base_x").isNull()
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", gap.alias("gap")).withColumn("run", S.run_id(F.col("gap") != F.lag("gap").over(w), w))
    return p.where("gap").groupBy("video_id", "mouse_id", "run").agg(F.count("*").alias("n")).groupBy("video_id").agg(F.max("n").alias("longest"), F.count("*").alias("runs"))


def fr_autocorrelation(spark, d):
    return r4(Wn.autocorrelation(pose(spark, d), "nose_x", ["video_id", "mouse_id"], "video_frame", (1, 5, 10, 20)))


def fr_halves(spark, d):
    """Means of the first and the last fifth of each mouse's frames."""
    w = P.by_mouse()
    n, at = F.count("*").over(Window.partitionBy("video_id", "mouse_id")), F.row_number().over(w)
    fifth = F.floor(n / 5)
    p = pose(spark, d).select("video_id", "mouse_id", "nose_x", (at <= fifth).alias("a"), (at > n - fifth).alias("b"))
    return r4(p.groupBy("video_id", "mouse_id").agg(F.avg(F.when(F.col("a"), F.col("nose_x"))).alias("first"), F.avg(F.when(F.col("b"), F.col("nose_x"))).alias("last")))


def fr_group_windows(spark, d):
    """Outlier frames joined over gaps of 4 and padded by 12, within the video."""
    p = pose(spark, d)
    last = p.groupBy("video_id", "mouse_id").agg(F.max("video_frame").alias("end"))
    out = Wn.outlier_windows(p.where("nose_x > 48").select("video_id", "mouse_id", "video_frame"), ["video_id", "mouse_id"], 4, 12)
    return out.join(last, ["video_id", "mouse_id"]).select("video_id", "mouse_id", "first", F.least("stop", F.col("end") + 1).alias("stop"))


# ---- windows ----


def fr_windows(spark, d):
    return Wn.spans(pose(spark, d).select("video_id", "mouse_id", "video_frame"), ["video_id", "mouse_id"], 16, 8, core=4)


def fr_window_fill(spark, d):
    p = pose(spark, d).withColumn("whole", F.col("tail_base_x").isNotNull().cast("double"))
    m = Wn.members(p, ["video_id", "mouse_id"], 16, 8).groupBy("video_id", "mouse_id", "win").agg(F.avg("whole").alias("fill"))
    return r4(m.where("fill >= 0.8"))


def fr_window_forward_fill(spark, d):
    m = Wn.members(pose(spark, d), ["video_id", "mouse_id"], 16, 8)
    w = Window.partitionBy("video_id", "mouse_id", "win").orderBy("pos")
    return r4(m.select("video_id", "mouse_id", "win", S.forward_fill("tail_base_x", w).alias("x")).groupBy("video_id", "mouse_id", "win").agg(F.count("x").alias("n"), F.sum("x").alias("s")))


def fr_window_statistics(spark, d):
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", "nose_x", "tail_base_x")
    return r4(Wn.statistics(Wn.members(p, ["video_id", "mouse_id"], 16, 8), ["video_id", "mouse_id", "win"], ["nose_x", "tail_base_x"]))


def fr_window_moments(spark, d):
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", "nose_y")
    return r4(Wn.members(p, ["video_id", "mouse_id"], 32, 16).groupBy("video_id", "mouse_id", "win").agg(F.skewness("nose_y").alias("skew"), F.kurtosis("nose_y").alias("kurt")))


def fr_centred_vote(spark, d):
    """Most frequent class of 5 rows around each; ties to the smaller class."""
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", (F.floor("nose_x").cast("int") % 4).alias("cls"))
    return Wn.centred_vote(p, ["video_id", "mouse_id"], "video_frame", "cls", 5)


def fr_split_videos(spark, d):
    return Wn.held_out_groups(pose(spark, d).select("video_id").distinct().withColumn("lab_id", F.col("video_id") % 5), "lab_id", "video_id", 0.25)


def fr_temporal_split(spark, d):
    return Wn.temporal_split(pose(spark, d).select("video_id", "mouse_id", "video_frame"), ["video_id", "mouse_id"], "video_frame", 0.2, 0.2, 5).groupBy("video_id", "mouse_id", "part").agg(F.count("*").alias("n"), F.min("video_frame").alias("a"), F.max("video_frame").alias("b"))


def fr_stratified_split(spark, d):
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", (F.floor("nose_x").cast("int") % 4).alias("cls"))
    return Wn.stratified(p, "cls", ["video_id", "mouse_id", "video_frame"], 0.3).groupBy("cls").agg(F.count("*").alias("n"), F.count_if("held").alias("held"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("fr_")}

# ---- SQL ----

_C = {a: "(" + " + ".join(f"coalesce({k}_{a}, 0)" for k in KEYPOINTS) + ") / nullif(" + " + ".join(f"({k}_{a} IS NOT NULL)::INT" for k in KEYPOINTS) + ", 0)" for a in "xy"}
_CEN = f"{POSE_SQL}, cen AS (SELECT *, {_C['x']} AS cx, {_C['y']} AS cy, atan2(tail_base_y - nose_y, tail_base_x - nose_x) AS ang FROM pose)"
_WRAP = lambda e: f"(({e}) + pi()) - 2 * pi() * floor((({e}) + pi()) / (2 * pi())) - pi()"
_HALF = lambda c, w=W: f"(lead({c}) {w} - lag({c}) {w}) / 2"
_SEC = lambda c: f"(lead({c}) {W} - 2 * {c} + lag({c}) {W})"
_D = lambda a, b, s="", t="": f"sqrt(({s}{a}_x - {t}{b}_x) ** 2 + ({s}{a}_y - {t}{b}_y) ** 2)"
_MEM = lambda n, s, cols: f"{POSE_SQL}, n AS (SELECT *, row_number() {W} - 1 AS pos, count(*) OVER (PARTITION BY video_id, mouse_id) AS tt FROM pose), mem AS (SELECT video_id, mouse_id, video_frame, pos, {cols}, unnest(range(greatest(0, ceil((pos - {n} + 1) / {s}.0))::BIGINT, (pos // {s}) + 1)) AS win, tt FROM n), win AS (SELECT * FROM mem WHERE win * {s} + {n} <= tt)"


def _angle_sql(a, b, c):
    u, v = f"({a}_x - {b}_x)", f"({a}_y - {b}_y)"
    p, q = f"({c}_x - {b}_x)", f"({c}_y - {b}_y)"
    return f"acos(least(1.0, greatest(-1.0, ({u} * {p} + {v} * {q}) / (sqrt({u} ** 2 + {v} ** 2) * sqrt({p} ** 2 + {q} ** 2) + 1e-8))))"


def _interp_sql(c, pos):
    ff, bf = f"last_value({c} IGNORE NULLS) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS UNBOUNDED PRECEDING)", f"first_value({c} IGNORE NULLS) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    k = f"CASE WHEN {c} IS NOT NULL THEN {pos} END"
    fp, bp = ff.replace(f"({c} IGN", f"({k} IGN"), bf.replace(f"({c} IGN", f"({k} IGN")
    return f"coalesce({c}, {ff} + ({bf} - {ff}) * ({pos} - {fp}) / nullif({bp} - {fp}, 0), {ff}, {bf})"


def _savgol_sql(c, n=9, o=3):
    h = n // 2
    total = " + ".join(f"{w!r} * CASE WHEN rn + {k} < 1 THEN fst WHEN rn + {k} > tt THEN lst ELSE {'lag' if k < 0 else 'lead'}({c}, {abs(k)}) {W} END" for k, w in zip(range(-h, h + 1), S.savgol_weights(n, o)))
    return f"CASE WHEN tt < {n} THEN {c} ELSE {total} END"


_ALL = "OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_DZ = [f"sqrt(greatest(0.0, {(n * 100) ** 2!r} - ({_D(a, b)}) * ({_D(a, b)})))" for (a, b), n in zip(G.EDGES, G.DEFAULT_LENGTHS)]
_DZSUM = " + ".join(f"coalesce({z}, 0)" for z in [f"CASE WHEN {a}_x IS NOT NULL AND {b}_x IS NOT NULL THEN {e} END" for (a, b), e in zip(G.EDGES, _DZ)])
_MID = lambda s, p, a: f"(coalesce({s}{p}_left_{a}, 0) + coalesce({s}{p}_right_{a}, 0)) / nullif(({s}{p}_left_{a} IS NOT NULL)::INT + ({s}{p}_right_{a} IS NOT NULL)::INT, 0)"
_PAIR = f"{_CEN}, pr AS (SELECT a.video_id, a.video_frame, a.mouse_id AS agent, b.mouse_id AS target, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in [*XY, 'cx', 'cy', 'ang'])} FROM cen AS a JOIN cen AS b ON a.video_id = b.video_id AND a.video_frame = b.video_frame AND a.mouse_id <> b.mouse_id)"
_PW = "OVER (PARTITION BY video_id, agent, target ORDER BY video_frame)"
_GAPS = "list_sort(list_filter([" + ", ".join(_D(p, q, "a_", "b_") for p in KEYPOINTS for q in KEYPOINTS) + "], lambda x: x IS NOT NULL))"
_REL = f"""{_PAIR}, m AS (SELECT *, {', '.join(f"{_MID(s + '_', p, a)} AS {s}_{p}_{a}" for s in 'ab' for p in ('ear', 'hip') for a in 'xy')} FROM pr),
g AS (SELECT *, sqrt((a_cx - b_cx) ** 2 + (a_cy - b_cy) ** 2) AS dist_centroid, {_D('nose', 'nose', 'a_', 'b_')} AS dist_nose_nose, {_D('nose', 'tail_base', 'a_', 'b_')} AS dist_nose_a_tail_b, {_D('nose', 'tail_base', 'b_', 'a_')} AS dist_nose_b_tail_a, {_D('nose', 'neck', 'a_', 'b_')} AS dist_nose_a_neck_b, {_D('nose', 'ear', 'a_', 'b_')} AS dist_nose_a_ear_b, {_D('nose', 'hip', 'a_', 'b_')} AS dist_nose_a_hip_b,
  sqrt(({_HALF('a_cx', _PW)}) ** 2 + ({_HALF('a_cy', _PW)}) ** 2) AS speed_a, sqrt(({_HALF('b_cx', _PW)}) ** 2 + ({_HALF('b_cy', _PW)}) ** 2) AS speed_b, {_GAPS} AS gaps, atan2(a_nose_y - a_tail_base_y, a_nose_x - a_tail_base_x) AS ha, atan2(b_nose_y - b_tail_base_y, b_nose_x - b_tail_base_x) AS hb FROM m),
rel AS (SELECT *, (dist_nose_a_tail_b - dist_nose_a_neck_b) / (dist_nose_a_tail_b + dist_nose_a_neck_b + 1e-6) AS sniff_site_ratio, {_WRAP('a_ang - b_ang')} AS angle_relative, {_HALF('dist_centroid', _PW)} AS approach_rate, cos({_WRAP('a_ang - atan2(b_cy - a_cy, b_cx - a_cx)')}) AS facing_b, speed_a - speed_b AS speed_relative, gaps[1] AS min_kp_dist, CASE WHEN len(gaps) >= 3 THEN (gaps[1] + gaps[2] + gaps[3]) / 3 END AS mean_k3_kp_dist,
  cos(ha) * (b_cx - a_cx) + sin(ha) * (b_cy - a_cy) AS rel_fwd, -sin(ha) * (b_cx - a_cx) + cos(ha) * (b_cy - a_cy) AS rel_lat, cos(hb) * (a_nose_x - b_cx) + sin(hb) * (a_nose_y - b_cy) AS nose_a_in_b_fwd, -sin(hb) * (a_nose_x - b_cx) + cos(hb) * (a_nose_y - b_cy) AS nose_a_in_b_lat FROM g)"""
_RELCOLS = "dist_centroid dist_nose_nose dist_nose_a_tail_b dist_nose_b_tail_a dist_nose_a_neck_b dist_nose_a_ear_b dist_nose_a_hip_b speed_a speed_b sniff_site_ratio angle_relative approach_rate facing_b speed_relative min_kp_dist mean_k3_kp_dist rel_fwd rel_lat nose_a_in_b_fwd nose_a_in_b_lat".split()
_KNOWN = {k: f"(a_{k}_x IS NOT NULL AND a_{k}_y IS NOT NULL)" for k in KEYPOINTS}
_OCC = f"""{_PAIR}, o AS MATERIALIZED (SELECT *, {', '.join(f"{'least' if e == 0 else 'greatest'}({', '.join(f'{s}_{k}_{x}' for k in KEYPOINTS)}) AS {s}{x}{e}" for s in 'ab' for x in 'xy' for e in (0, 1))},
  {' + '.join(f'{v}::INT' for v in _KNOWN.values())} AS nv, {' + '.join(f"({v} AND (" + ' OR '.join(f"coalesce((a_{k}_x - b_{j}_x) ** 2 + (a_{k}_y - b_{j}_y) ** 2 < 1, false)" for j in KEYPOINTS) + "))::INT" for k, v in _KNOWN.items())} AS nc FROM pr),
q AS MATERIALIZED (SELECT *, {' + '.join(f"coalesce({v} AND a_{k}_x BETWEEN bx0 AND bx1 AND a_{k}_y BETWEEN by0 AND by1, false)::INT" for k, v in _KNOWN.items())} AS ni, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) AS inter, (ax1 - ax0) * (ay1 - ay0) AS sa, (bx1 - bx0) * (by1 - by0) AS sb, sqrt((ax1 - ax0) ** 2 + (ay1 - ay0) ** 2) AS da, sqrt((bx1 - bx0) ** 2 + (by1 - by0) ** 2) AS db FROM o)"""

_SMOOTH = (
    f"{POSE_SQL}, i0 AS (SELECT *, row_number() {W} AS rn, count(*) OVER (PARTITION BY video_id, mouse_id) AS tt FROM pose), "
    + "i1 AS (SELECT *, " + ", ".join(f"{_interp_sql(c, 'rn')} AS f_{c}" for c in XY) + " FROM i0), "
    + "i2 AS (SELECT *, " + ", ".join(f"first_value(f_{c}) {_ALL} AS f_{c}fst, last_value(f_{c}) {_ALL} AS f_{c}lst" for c in XY) + " FROM i1), "
    + f"sm AS (SELECT {KEYS}, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {_savgol_sql(f'f_{c}').replace('fst', f'f_{c}fst').replace('lst', f'f_{c}lst')} END AS {c}" for c in XY) + " FROM i2)"
)
SQL = {
    "fr_metadata": f"WITH {META_SQL} SELECT video_id, lab_id, array_to_string(body_parts, ';') AS parts, array_to_string(behaviors, ';') AS behaviors, len(body_parts)::INT AS n_body_parts, len(behaviors)::INT AS n_behaviors_labeled, n_mice::INT AS n_mice FROM meta",
    "fr_tracking_normalised": f"WITH {POSE_SQL}, {META_SQL} SELECT {KEYS}, 'nose' AS bodypart, {rs('nose_x / video_width_pix', 'x', 8)}, {rs('nose_y / video_height_pix', 'y', 8)} FROM pose LEFT JOIN meta USING (video_id)",
    "fr_long_to_wide": f"WITH {LONG_SQL} SELECT {KEYS}, {rs(chr(10) + 'max(x) FILTER (WHERE bodypart = ' + chr(39) + 'nose' + chr(39) + ')', 'nose_x', 8)}, {rs('max(x) FILTER (WHERE bodypart = ' + chr(39) + 'tail_base' + chr(39) + ')', 'tail_base_x', 8)}, {rs('max(y) FILTER (WHERE bodypart = ' + chr(39) + 'hip_left' + chr(39) + ')', 'hip_left_y', 8)} FROM long WHERE x IS NOT NULL GROUP BY ALL",
    "fr_zero_frames": f"WITH {POSE_SQL} SELECT video_id, count(*) AS n FROM pose WHERE NOT ({' AND '.join(f'{c} IS NOT DISTINCT FROM 0' for c in XY)}) GROUP BY video_id",
    "fr_scaled_centroid": f"WITH {POSE_SQL}, s AS (SELECT {KEYS}, {', '.join(f'{c} / 10 AS {c}' for c in XY)} FROM pose), m AS (SELECT *, " + ", ".join("(" + " + ".join(f"coalesce({k}_{a}, 0)" for k in KEYPOINTS) + ") / nullif(" + " + ".join(f"coalesce(({k}_{a} <> 0)::INT, 0)" for k in KEYPOINTS) + f", 0) AS m{a}" for a in "xy") + f" FROM s) SELECT {KEYS}, {rs('nose_x - coalesce(mx, 0)', 'nose_x', 8)}, {rs('nose_y - coalesce(my, 0)', 'nose_y', 8)}, {rs('tail_base_x - coalesce(mx, 0)', 'tail_base_x', 8)} FROM m",
    "fr_frame_limit": f"WITH {POSE_SQL} SELECT video_id, mouse_id, count(*) AS n, max(video_frame)::INT AS last FROM pose WHERE video_frame < 100 GROUP BY ALL",
    "fr_fingerprint": f"WITH {POSE_SQL} SELECT count(*) AS n_rows, count(DISTINCT video_frame) AS n_frames, min(video_frame)::INT AS f_min, max(video_frame)::INT AS f_max FROM pose",
    "fr_confidence_gate": f"WITH {POSE_SQL}, g AS (SELECT *, CASE WHEN (video_frame * 7) % 10 / 10.0 >= 0.4 OR row_number() {W} = 1 THEN nose_x END AS g FROM pose) SELECT {KEYS}, {rs('last_value(g IGNORE NULLS) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS UNBOUNDED PRECEDING)', 'x')} FROM g",
    "fr_dropout_masks": f"WITH {POSE_SQL}, z AS (SELECT *, {' AND '.join(f'coalesce({c} = 0, false)' for c in XY)} AS zero FROM pose) SELECT video_id, count_if(tail_base_x IS NULL)::BIGINT AS missing, count_if(abs(tail_base_x) < 2 AND abs(tail_base_y) < 2 AND NOT zero)::BIGINT AS near_zero, count_if(zero)::BIGINT AS zero_frames FROM z GROUP BY video_id",
    "fr_impute": f"WITH {POSE_SQL} SELECT {KEYS}, {rs('coalesce(tail_base_x, 0)', 'zero')}, {rs('coalesce(last_value(tail_base_x IGNORE NULLS) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS UNBOUNDED PRECEDING), first_value(tail_base_x IGNORE NULLS) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'filled')}, {rs(_interp_sql('tail_base_x', 'video_frame'), 'linear')} FROM pose",
    "fr_mean_impute": f"WITH {POSE_SQL} SELECT {KEYS}, {rs('coalesce(tail_base_x, avg(tail_base_x) OVER (PARTITION BY video_id), 0)', 'x')} FROM pose",
    "fr_circular_encode": f"WITH {_CEN} SELECT {KEYS}, {rs('sin(ang)', 'body_angle_sin')}, {rs('cos(ang)', 'body_angle_cos')} FROM cen",
    "fr_validate_features": f"WITH {POSE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INT), 4) + 0.0 AS missing, avg(({c} IS NULL)::INT) > 0.05 AS flagged FROM pose" for c in XY),
    "fr_decimate": f"WITH {POSE_SQL}, r AS (SELECT {KEYS}, row_number() OVER (PARTITION BY video_id ORDER BY mouse_id, video_frame) AS rn, count(*) OVER (PARTITION BY video_id) AS n FROM pose) SELECT {KEYS} FROM r WHERE (rn - 1) % ceil(n / 40.0)::BIGINT = 0 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY mouse_id, video_frame) <= 40",
    "fr_cap_per_group": f"WITH {POSE_SQL} SELECT {KEYS} FROM pose QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY md5(concat_ws('|', 0, mouse_id, video_frame)), mouse_id, video_frame) <= 10",
    "fr_union_reindex": f"WITH {POSE_SQL}, u AS (SELECT video_id, nose_x, neck_x, 0 AS tail_base_x FROM pose WHERE mouse_id = 1 UNION ALL SELECT video_id, nose_x, 0, coalesce(tail_base_x, 0) FROM pose WHERE mouse_id = 2) SELECT video_id, {rs('sum(nose_x)', 'nose_x')}, {rs('sum(neck_x)', 'neck_x')}, {rs('sum(tail_base_x)', 'tail_base_x')} FROM u GROUP BY video_id",
    "fr_behaviour_state": f"WITH {_CEN}, k AS (SELECT video_id, sqrt(({_HALF('cx')}) ** 2 + ({_HALF('cy')}) ** 2) AS s, {_DZSUM} AS z FROM cen), c AS (SELECT video_id, quantile_cont(z, 0.75) AS qz, quantile_cont(s, 0.9) AS qs FROM k GROUP BY video_id) SELECT video_id, CASE WHEN z > qz THEN 'rearing' WHEN s > qs THEN 'locomotion' ELSE 'static' END AS state, count(*) AS n FROM k JOIN c USING (video_id) GROUP BY ALL",
    "fr_best_frames": f"WITH {POSE_SQL}, t AS (SELECT {KEYS}, {' + '.join(f'({c} IS NOT NULL)::INT' for c in XY)} AS k, coalesce(round({_D('nose', 'tail_base')}, 4), -1) AS body FROM pose), u AS (SELECT {KEYS}, CASE WHEN k = 14 THEN 0 WHEN k >= 12 THEN 1 ELSE 2 END AS tier, body FROM t) SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY tier, body DESC, mouse_id, video_frame)::INT AS rn FROM u QUALIFY rn <= 3",
    "fr_body_length": f"WITH {POSE_SQL} SELECT {KEYS}, {rs(_D('nose', 'tail_base'), 'body_length', 8)} FROM pose",
    "fr_kinematics": f"WITH {_SMOOTH}, cen AS (SELECT *, {_C['x']} AS cx, {_C['y']} AS cy, atan2(tail_base_y - nose_y, tail_base_x - nose_x) AS ang FROM sm), k AS (SELECT *, {_HALF('cx')} AS vx, {_HALF('cy')} AS vy, {_SEC('cx')} AS ax, {_SEC('cy')} AS ay FROM cen) SELECT {KEYS}, {rs('cx', 'centroid_x', 8)}, {rs('sqrt(vx ** 2 + vy ** 2)', 'centroid_speed', 8)}, {rs('sqrt(ax ** 2 + ay ** 2)', 'centroid_accel', 8)}, {rs(f'sqrt(({_HALF('ax')}) ** 2 + ({_HALF('ay')}) ** 2)', 'centroid_jerk', 8)}, {rs(f'sqrt(({_HALF('nose_x')}) ** 2 + ({_HALF('nose_y')}) ** 2)', 'nose_speed', 8)}, {rs(f'sqrt({_SEC('nose_x')} ** 2 + {_SEC('nose_y')} ** 2)', 'nose_accel', 8)}, {rs(_HALF('hip_left_x'), 'hip_left_vx', 8)}, {rs('ang', 'body_angle', 8)}, {rs(_WRAP(_HALF('ang')), 'body_angle_vel', 8)}, {rs(_D('nose', 'tail_base'), 'body_length', 8)} FROM k",
    "fr_segment_angles": f"WITH {POSE_SQL}, h AS (SELECT *, {_MID('', 'hip', 'x')} AS hips_x, {_MID('', 'hip', 'y')} AS hips_y FROM pose) SELECT {KEYS}, {rs(_angle_sql('nose', 'neck', 'hips'), 'neck_spine')}, {rs(_angle_sql('neck', 'hip_left', 'tail_base'), 'hip_tail_left')}, {rs(_angle_sql('neck', 'hip_right', 'tail_base'), 'hip_tail_right')} FROM h",
    "fr_implied_depth": f"WITH {POSE_SQL} SELECT {KEYS}, {rs(_DZ[0], 'dz_nose_neck')}, {rs(_DZSUM, 'dz_sum')} FROM pose",
    "fr_ordered_pairs": f"WITH {POSE_SQL}, m AS (SELECT DISTINCT video_id, mouse_id FROM pose) SELECT a.video_id, a.mouse_id AS agent, b.mouse_id AS target FROM m AS a LEFT JOIN m AS b ON a.video_id = b.video_id AND a.mouse_id <> b.mouse_id",
    "fr_relations": f"WITH {_REL} SELECT video_id, agent, target, video_frame, {', '.join(rs(c, c, 8) for c in _RELCOLS)}, {rs('-approach_rate', 'closing_speed', 8)} FROM rel",
    "fr_occlusion": f"WITH {_OCC} SELECT video_id, agent, target, video_frame, {rs('CASE WHEN sa + sb - inter > 0 THEN inter / (sa + sb - inter) ELSE 0 END', 'bbox_iou')}, {rs('CASE WHEN sb > 0 THEN sa / sb END', 'area_ratio')}, {rs('CASE WHEN db > 0 THEN da / db END', 'body_len_ratio')}, {rs('ni / nullif(nv, 0)', 'frac_kp_inside')}, {rs('nc / nullif(nv, 0)', 'frac_kp_close')} FROM q",
    "fr_cross_sine": f"WITH {POSE_SQL}, e AS (SELECT *, neck_x - tail_base_x AS ux, neck_y - tail_base_y AS uy, nose_x - tail_base_x AS vx, nose_y - tail_base_y AS vy FROM pose) SELECT {KEYS}, {rs('(ux * vy - uy * vx) / nullif(sqrt(ux ** 2 + uy ** 2) * sqrt(vx ** 2 + vy ** 2), 0)', 's')} FROM e",
    "fr_savgol": f"WITH {POSE_SQL}, i0 AS (SELECT *, row_number() {W} AS rn, count(*) OVER (PARTITION BY video_id, mouse_id) AS tt FROM pose), i1 AS (SELECT *, {_interp_sql('nose_x', 'rn')} AS nf, {_interp_sql('tail_base_x', 'rn')} AS tf FROM i0), i2 AS (SELECT *, first_value(nf) {_ALL} AS nfst, last_value(nf) {_ALL} AS nlst, first_value(tf) {_ALL} AS tfst, last_value(tf) {_ALL} AS tlst FROM i1), i3 AS (SELECT *, {_savgol_sql('nf').replace('fst', 'nfst').replace('lst', 'nlst')} AS a, {_savgol_sql('tf').replace('fst', 'tfst').replace('lst', 'tlst')} AS b FROM i2) SELECT {KEYS}, {rs('CASE WHEN nose_x IS NOT NULL THEN a END', 'nose_x')}, {rs('CASE WHEN tail_base_x IS NOT NULL THEN b END', 'tail_base_x')} FROM i3",
    "fr_hampel": f"WITH {POSE_SQL}, h AS (SELECT {KEYS}, tail_base_y AS y, list_filter(list(tail_base_y) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), lambda v: v IS NOT NULL) AS l, lag(1, 3) {W} IS NOT NULL AND lead(1, 3) {W} IS NOT NULL AS w FROM pose), m AS (SELECT *, list_median(l) AS med FROM h), d AS (SELECT *, list_median(list_transform(l, lambda v: abs(v - med))) AS mad FROM m) SELECT {KEYS}, {rs('CASE WHEN w AND y IS NOT NULL AND len(l) >= 3 AND mad > 0 AND abs(y - med) > 2.0 * 1.4826 * mad THEN med ELSE y END', 'y')} FROM d",
    "fr_differences": f"WITH {POSE_SQL} SELECT {KEYS}, {rs(f'nose_x - lag(nose_x) {W}', 'd1')}, {rs(_HALF('nose_x'), 'v')}, {rs(_SEC('nose_x'), 'a')}, {rs(f'nose_x - 3 * lag(nose_x) {W} + 3 * lag(nose_x, 2) {W} - lag(nose_x, 3) {W}', 'd3')} FROM pose",
    "fr_gap_speed": f"WITH {POSE_SQL} SELECT {KEYS}, {rs(f'sqrt((tail_base_x - lag(tail_base_x) {W}) ** 2 + (tail_base_y - lag(tail_base_y) {W}) ** 2) / nullif(video_frame - lag(video_frame) {W}, 0)', 'speed')} FROM pose WHERE tail_base_x IS NOT NULL",
    "fr_context": f"WITH {POSE_SQL} SELECT {KEYS}, {rs('coalesce(avg(nose_x) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - nose_x, 0)', 'past')}, {rs('coalesce(avg(nose_x) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) - nose_x, 0)', 'coming')} FROM pose",
    "fr_moving_average": f"WITH {POSE_SQL} SELECT {KEYS}, {rs('sum(nose_x) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5', 'm')} FROM pose",
    "fr_missing_runs": f"WITH {POSE_SQL}, g AS (SELECT *, tail_base_x IS NULL AS gap, row_number() {W} - row_number() OVER (PARTITION BY video_id, mouse_id, tail_base_x IS NULL ORDER BY video_frame) AS k FROM pose), r AS (SELECT video_id, mouse_id, k, count(*) AS n FROM g WHERE gap GROUP BY ALL) SELECT video_id, max(n) AS longest, count(*) AS runs FROM r GROUP BY video_id",
    "fr_autocorrelation": f"WITH {POSE_SQL}, l AS (SELECT *, lag(nose_x, 1) {W} AS l1, lag(nose_x, 5) {W} AS l5, lag(nose_x, 10) {W} AS l10, lag(nose_x, 20) {W} AS l20 FROM pose) SELECT video_id, mouse_id, {rs('corr(nose_x, l1)', 'lag_1')}, {rs('corr(nose_x, l5)', 'lag_5')}, {rs('corr(nose_x, l10)', 'lag_10')}, {rs('corr(nose_x, l20)', 'lag_20')} FROM l GROUP BY ALL",
    "fr_halves": f"WITH {POSE_SQL}, h AS (SELECT *, row_number() {W} AS rn, count(*) OVER (PARTITION BY video_id, mouse_id) AS n FROM pose) SELECT video_id, mouse_id, {rs('avg(nose_x) FILTER (WHERE rn <= n // 5)', 'first')}, {rs('avg(nose_x) FILTER (WHERE rn > n - n // 5)', 'last')} FROM h GROUP BY ALL",
    "fr_group_windows": f"WITH {POSE_SQL}, e AS (SELECT video_id, mouse_id, max(video_frame) AS ed FROM pose GROUP BY ALL), o AS (SELECT *, coalesce(video_frame - lag(video_frame) {W} > 4, true) AS b FROM pose WHERE nose_x > 48), i AS (SELECT *, sum(b::INT) {W} AS k FROM o) SELECT video_id, mouse_id, greatest(min(video_frame) - 12, 0)::BIGINT AS first, least(max(video_frame) + 13, any_value(ed) + 1)::BIGINT AS stop FROM i JOIN e USING (video_id, mouse_id) GROUP BY video_id, mouse_id, k",
    "fr_windows": f"WITH {_MEM(16, 8, '1 AS one')} SELECT video_id, mouse_id, win, min(video_frame)::INT AS start_frame, max(video_frame)::INT + 1 AS stop_frame, min(video_frame)::INT + 6 AS core_start, min(video_frame)::INT + 10 AS core_stop FROM win GROUP BY video_id, mouse_id, win",
    "fr_window_fill": f"WITH {_MEM(16, 8, 'tail_base_x')} SELECT video_id, mouse_id, win, {rs('avg((tail_base_x IS NOT NULL)::INT)', 'fill')} FROM win GROUP BY video_id, mouse_id, win HAVING avg((tail_base_x IS NOT NULL)::INT) >= 0.8",
    "fr_window_forward_fill": f"WITH {_MEM(16, 8, 'tail_base_x')}, f2 AS (SELECT *, last_value(tail_base_x IGNORE NULLS) OVER (PARTITION BY video_id, mouse_id, win ORDER BY pos ROWS UNBOUNDED PRECEDING) AS x FROM win) SELECT video_id, mouse_id, win, count(x) AS n, {rs('sum(x)', 's')} FROM f2 GROUP BY video_id, mouse_id, win",
    "fr_window_statistics": f"WITH {_MEM(16, 8, 'nose_x, tail_base_x')} SELECT video_id, mouse_id, win, " + ", ".join(rs(e.format(c=c), f"{c}_{n}") for c in ("nose_x", "tail_base_x") for n, e in {"mean": "avg({c})", "std": "stddev_pop({c})", "min": "min({c})", "max": "max({c})", "p25": "quantile_cont({c}, 0.25)", "p75": "quantile_cont({c}, 0.75)", "iqr": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"}.items()) + " FROM win GROUP BY video_id, mouse_id, win",
    "fr_window_moments": f"WITH {_MEM(32, 16, 'nose_y')}, mm AS (SELECT *, avg(nose_y) OVER (PARTITION BY video_id, mouse_id, win) AS mu FROM win), z AS (SELECT video_id, mouse_id, win, avg((nose_y - mu) ** 2) AS m2, avg((nose_y - mu) ** 3) AS m3, avg((nose_y - mu) ** 4) AS m4 FROM mm GROUP BY ALL) SELECT video_id, mouse_id, win, {rs('m3 / nullif(m2 ** 1.5, 0)', 'skew')}, {rs('m4 / nullif(m2 ** 2, 0) - 3', 'kurt')} FROM z",
    "fr_centred_vote": f"WITH {POSE_SQL}, v AS (SELECT {KEYS}, row_number() {W} AS rn, floor(nose_x)::INT % 4 AS cls FROM pose), c AS (SELECT a.video_id, a.mouse_id, a.video_frame, b.cls, count(*) AS n FROM v AS a JOIN v AS b ON a.video_id = b.video_id AND a.mouse_id = b.mouse_id AND b.rn BETWEEN a.rn - 2 AND a.rn + 2 GROUP BY ALL) SELECT {KEYS}, cls AS vote FROM c QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY n DESC, cls) = 1",
    "fr_split_videos": "WITH v AS (SELECT DISTINCT l_suppkey AS video_id, l_suppkey % 5 AS lab_id FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY lab_id ORDER BY md5('0|' || video_id), video_id) AS rn, count(*) OVER (PARTITION BY lab_id) AS n FROM v) SELECT lab_id, video_id, rn <= greatest(1, round_even(n * 0.25::DOUBLE, 0)) AS held_out FROM r",
    "fr_temporal_split": f"WITH {POSE_SQL}, r AS (SELECT *, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY video_id, mouse_id) AS n FROM pose), s AS (SELECT *, n - floor(n * 0.2::DOUBLE)::BIGINT AS te, n - floor(n * 0.2::DOUBLE)::BIGINT - floor(n * 0.2::DOUBLE)::BIGINT AS va FROM r), p AS (SELECT *, CASE WHEN i < va - 5 THEN 'train' WHEN i >= va + 5 AND i < te - 5 THEN 'val' WHEN i >= te + 5 THEN 'test' END AS part FROM s) SELECT video_id, mouse_id, part, count(*) AS n, min(video_frame)::INT AS a, max(video_frame)::INT AS b FROM p WHERE part IS NOT NULL GROUP BY ALL",
    "fr_stratified_split": f"WITH {POSE_SQL}, v AS (SELECT {KEYS}, floor(nose_x)::INT % 4 AS cls FROM pose), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(concat_ws('|', 0, video_id, mouse_id, video_frame)), video_id, mouse_id, video_frame) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM v) SELECT cls, count(*) AS n, count_if(rn <= round_even(n * 0.3::DOUBLE, 0))::BIGINT AS held FROM r GROUP BY cls",
}
