"""Queries on quality, decisions and statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import decide as D
from ..operators import frames as P
from ..operators import intervals as I
from ..operators import quality as Q
from ..operators import stats as T
from ..session import written
from ..sources.adapters import LONG_SQL, META_SQL, POSE_SQL, PROBA_LONG_SQL, PROBA_SQL, meta_raw, pose, proba, proba_long, to_long
from .frame_queries import _CEN, _D, _DZSUM, _HALF, _SMOOTH, _savgol_sql, W, r4, rs
from .interval_queries import CLEAN_SQL, _clean

REFS = {f"{a}→{b}": n * 100 for (a, b), n in zip(G.EDGES, G.DEFAULT_LENGTHS)}


def _refs(spark):
    return spark.createDataFrame(list(REFS.items()), "edge string, l_ref double")


def _r6(df):
    return r4(df, 6)


def _lab(df):
    """Videos are dealt to four labs."""
    return df.withColumn("lab_id", F.col("video_id") % 4)


# ---- tracking and annotation quality ----


def ql_keypoint_report(spark, d):
    return _r6(Q.keypoint_report(to_long(pose(spark, d)), "bodypart"))


def ql_value_counts(spark, d):
    """Labs, methods and strains with their counts, in one long table."""
    m = meta_raw(spark, d)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("lab", "lab_id"), ("method", "tracking_method"), *((f"mouse{i}", f"mouse{i}_strain") for i in range(1, 5)))])
    return m.select(F.inline(kinds)).where("value IS NOT NULL").groupBy("kind", "value").agg(F.count("*").alias("n"))


def ql_keypoints_per_lab(spark, d):
    from ..sources.readers import with_metadata

    m = with_metadata(meta_raw(spark, d))
    return m.groupBy("lab_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("body_parts_tracked")))), ";").alias("keypoints"))


def ql_keypoint_intersection(spark, d):
    from ..sources.readers import with_metadata

    m = with_metadata(meta_raw(spark, d)).where("n_body_parts > 0")
    n = m.groupBy("lab_id").agg(F.count_distinct("video_id").alias("videos"))
    k = m.select("lab_id", "video_id", F.explode("body_parts_tracked").alias("keypoint")).groupBy("lab_id", "keypoint").agg(F.count_distinct("video_id").alias("n"))
    return k.join(n, "lab_id").where("n = videos").select("lab_id", "keypoint")


def ql_duration_describe(spark, d):
    a = _clean(spark, d)
    q = F.percentile("duration_frames", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95))))
    g = a.groupBy("action").agg(F.count("*").alias("n"), F.avg("duration_frames").alias("mean"), F.stddev_samp("duration_frames").alias("std"), F.min("duration_frames").alias("min"), F.max("duration_frames").alias("max"), q.alias("q"), F.sum("duration_frames").alias("total"))
    return _r6(g.select("action", "n", "mean", "std", "min", "max", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("p25", "p50", "p75", "p95"))], "total"))


def ql_action_entropy(spark, d):
    n = _clean(spark, d).groupBy("action").agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("t"), F.max("n").alias("most"), F.min("n").alias("least"))
    p = F.col("n") / F.col("t")
    g = n.crossJoin(F.broadcast(t)).agg((-F.sum(p * F.log2(p))).alias("entropy"), (F.max("most") / F.max("least")).alias("imbalance"))  # one row
    return _r6(g.withColumn("effective", F.pow(F.lit(2.0), "entropy")))


def ql_lab_action_pivot(spark, d):
    a = _clean(spark, d).withColumn("lab_id", F.col("video_id") % 4)
    names = ["click", "error", "purchase", "signup", "view"]
    p = a.groupBy("lab_id").pivot("action", names).count().na.fill(0)
    total = sum((F.col(n) for n in names), F.lit(0))
    return _r6(p.select("lab_id", *[F.try_divide(F.col(n).cast("double"), total).alias(n) for n in names]))


def ql_transitions(spark, d):
    return _r6(T.transitions(_clean(spark, d), ["video_id"], ["start_frame", "stop_frame", "event_id"], "action"))


def ql_transitions_roles(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role").where("conv_id IS NOT NULL AND role IS NOT NULL").distinct()
    return _r6(T.transitions(c, ["conv_id"], ["turn", "role"], "role"))


def ql_missing_rate(spark, d):
    """Per lab and body part: missing x, y and either."""
    g = _lab(to_long(pose(spark, d))).groupBy("lab_id", "bodypart").agg(*[F.avg(x.isNull().cast("int")).alias(n) for n, x in (("x", F.col("x")), ("y", F.col("y")), ("any", F.col("x") + F.col("y")))])
    return _r6(g)


def ql_outlier_rates(spark, d):
    """Shares of speeds and accelerations above median + 6 MAD, per lab and body part."""
    return _r6(Q.outlier_rates(_lab(to_long(pose(spark, d))), 6.0, "lab_id", "bodypart"))


def ql_recording_report(spark, d):
    return _r6(Q.recording_report(pose(spark, d), "video_id"))


def ql_length_and_jumps(spark, d):
    """Shares of body lengths off the mouse's median by 25 %, and of heading steps above pi / 2."""
    w = P.by_mouse()
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", G.apart("nose", "tail_base").alias("l"), G.heading("nose_x", "nose_y", "tail_base_x", "tail_base_y").alias("a"))
    med = p.groupBy("video_id", "mouse_id").agg(F.percentile("l", F.lit(0.5)).alias("m"))
    p = p.withColumn("jump", F.abs(G.wrap(F.col("a") - F.lag("a").over(w))) > 1.5707963267948966).join(med, ["video_id", "mouse_id"])
    return _r6(p.groupBy("video_id").agg(F.avg((F.abs(F.col("l") - F.col("m")) / F.col("m") > 0.25).cast("int")).alias("length_violations"), F.avg(F.col("jump").cast("int")).alias("angle_jumps")))


def ql_fit_skeleton(spark, d):
    return _r6(Q.fit_skeleton(pose(spark, d)))


def ql_fit_skeleton_per_mouse(spark, d):
    return _r6(Q.fit_skeleton(pose(spark, d), "mouse_id"))


def ql_violations(spark, d):
    return _r6(Q.violations(Q.edge_lengths(pose(spark, d), "mouse_id"), _refs(spark), 0.25, "mouse_id"))


def ql_keypoint_violations(spark, d):
    return _r6(Q.keypoint_violations(Q.violations(Q.edge_lengths(pose(spark, d), "mouse_id"), _refs(spark), 0.9)))


def ql_any_violation_rate(spark, d):
    return _r6(Q.any_violation_rate(pose(spark, d), REFS, 0.95, "video_id"))


def ql_adaptive_thresholds(spark, d):
    e = Q.edge_lengths(pose(spark, d), "video_id").join(_refs(spark), "edge").withColumn("r", F.abs(F.col("length") - F.col("l_ref")) / F.col("l_ref"))
    return _r6(Q.adaptive_thresholds(e))


def ql_reestimated(spark, d):
    return _r6(Q.reestimated(Q.edge_lengths(pose(spark, d), "mouse_id"), _refs(spark)))


def ql_outlier_flags(spark, d):
    o = Q.outliers(pose(spark, d), "tail_base", ("hip_left", "tail_base"), REFS)
    return _r6(o.groupBy("video_id").agg(*[F.count_if(F.col(c)).alias(c) for c in ("missing", "speed", "accel", "length", "near_zero")], F.sum("severity").alias("severity")))


def ql_speed_spikes(spark, d):
    return _r6(Q.speed_spikes(pose(spark, d), "nose", 2.0).groupBy("video_id").agg(F.count("nose_x").alias("kept"), F.sum("nose_x").alias("s")))


def ql_overlap_mask(spark, d):
    return Q.overlap_mask(P.with_centroid(pose(spark, d)), 5.0).groupBy("video_id").agg(F.count_if("overlap").alias("n"))


def ql_corrupted(spark, d):
    """How many coordinates dropout and noise moved, and the size of the change."""
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", "nose_x")
    c = Q.corrupted(p, ["nose_x"]).withColumnRenamed("nose_x", "after")
    j = p.join(c, ["video_id", "mouse_id", "video_frame"])
    return _r6(j.groupBy("video_id").agg(F.count_if(F.col("after") == 0).alias("dropped"), F.sqrt(F.avg(F.pow(F.col("after") - F.col("nose_x"), F.lit(2)))).alias("rmse")))


# ---- decisions ----


def _active(spark, d):
    return proba(spark, d).where("window_id % 3 <> 1").select("video_id", "agent", F.when(F.col("agent") != F.col("target"), F.col("target")).alias("target"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cls")).where("(video_id + cls) % 4 <> 0").distinct()


def _thresholds(spark, d):
    return T.exact_percentiles(proba_long(proba(spark, d)), ["p"], (0.6,), "lab_id", "cls").select("lab_id", "cls", F.get("v", F.lit(0)).alias("t"))


def _decided(spark, d, mode):
    return D.decide(D.active_mask(proba_long(proba(spark, d)), _active(spark, d)), _thresholds(spark, d), mode)


def dc_active_mask(spark, d):
    return D.active_mask(proba_long(proba(spark, d)), _active(spark, d)).where("allowed").groupBy("video_id", "cls").agg(F.count("*").alias("n"))


def dc_residual(spark, d):
    return _decided(spark, d, "residual").select("window_id", "cls")


def dc_ratio(spark, d):
    return _decided(spark, d, "ratio").select("window_id", "cls")


def dc_intervals(spark, d):
    """Decided windows as intervals."""
    w = _decided(spark, d, "residual").select("window_id", "video_id", F.col("agent").alias("agent_id"), F.col("target").alias("target_id"), F.when(F.col("cls") == 0, "background").otherwise(F.concat(F.lit("c"), "cls")).alias("action"), F.col("core_start").alias("start_frame"), F.col("core_stop").alias("stop_frame"))
    return I.windows_to_intervals(w)


def dc_smoothed(spark, d):
    s = D.smoothed(proba_long(proba(spark, d)), 9, 2)
    return _r6(s.groupBy("video_id", "agent", "cls").agg(F.sum("p").alias("s"), F.max("p").alias("m")))


def dc_decode_frames(spark, d):
    f = proba(spark, d).select("video_id", F.col("agent").alias("agent_id"), F.col("agent").alias("target_id"), F.col("core_start").alias("video_frame"), "p")
    return I.decode_intervals(f, F.array_repeat(F.lit(0.2), 10))


def dc_revived(spark, d):
    dec = _decided(spark, d, "residual")
    dead = proba(spark, d).select("lab_id").distinct().withColumn("cls", F.lit(4))
    return _r6(D.revived(proba_long(proba(spark, d)), dec, dead, 5).select("lab_id", "cls", "window_id", "rn", "p"))


def _argmax(spark, d):
    return proba(spark, d).select("window_id", "video_id", "y", (F.array_position("p", F.array_max("p")).cast("int") - 1).alias("pred"), F.array_max("p").alias("p"), "p").toDF("window_id", "video_id", "y", "pred", "p", "all")


def dc_confusion(spark, d):
    return D.confusion(_argmax(spark, d), "y", "pred")


def dc_class_report(spark, d):
    return _r6(D.class_report(_argmax(spark, d)))


def dc_summary(spark, d):
    return _r6(D.summary(D.class_report(_argmax(spark, d))))


def dc_calibration(spark, d):
    return _r6(D.calibration_error(_argmax(spark, d).withColumn("correct", F.col("y") == F.col("pred"))))


def dc_class_weights(spark, d):
    return _r6(D.class_weights(proba(spark, d)))


def dc_evaluable(spark, d):
    return D.evaluable(proba(spark, d), "y", "video_id")


def dc_top_pairs(spark, d):
    c = D.confusion(_argmax(spark, d).where("y <> pred"), "y", "pred")
    return c.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("n"), "y", "pred"))).where("rn <= 10")


def dc_fuse_models(spark, d):
    """Left join of a second model's probabilities where it has them; their mean, else the first's."""
    a = proba_long(proba(spark, d)).select("window_id", "cls", "p")
    b = a.where("window_id % 3 = 0").select("window_id", "cls", (F.lit(1) - F.col("p")).alias("q"))
    return _r6(a.join(b, ["window_id", "cls"], "left").select("window_id", "cls", F.coalesce((F.col("p") + F.col("q") * 3) / 4, "p").alias("p")).groupBy("window_id").agg(F.max("p").alias("p"), F.max_by("cls", F.struct("p", -F.col("cls"))).alias("cls")))


def dc_uncertainty_top(spark, d):
    """The 20 windows with most entropy, least margin and least confidence, by mean rank."""
    p = proba(spark, d).select("window_id", F.round(G.entropy(F.col("p")), 6).alias("entropy"), F.round(G.margin(F.col("p")), 6).alias("margin"), F.round(F.array_max("p"), 6).alias("top"))
    p = p.withColumn("a", -F.col("entropy"))
    for x in ("a", "margin", "top"):
        k = T.ranks_by_range(p, x, 0.001, f"rank_{x}").withColumnRenamed(x, "k")
        p = p.join(k, p[x].eqNullSafe(k["k"])).drop("k")
    r = p.select("window_id", "entropy", "margin", "top", ((F.col("rank_a") + F.col("rank_margin") + F.col("rank_top")) / 3).alias("rank"))
    return _r6(r.orderBy("rank", "window_id").limit(20))


# ---- statistics and motion ----


def _halves(spark, d):
    k = P.kinematics(pose(spark, d), smooth=0).select("video_id", "mouse_id", "video_frame", "centroid_speed", "body_angle", "body_length")
    return k.withColumn("early", F.col("video_frame") < 150)


def st_ks_speed(spark, d):
    return _r6(T.ks_statistic(_halves(spark, d).where("centroid_speed IS NOT NULL").withColumn("v", F.round("centroid_speed", 6)), "v", "early", "video_id"))


def st_cohens_d(spark, d):
    return _r6(T.cohens_d(_halves(spark, d).where("centroid_speed IS NOT NULL"), "centroid_speed", "early", "mouse_id"))


def st_kl_speed(spark, d):
    return _r6(T.kl_divergence(_halves(spark, d), "centroid_speed", "early", 0.0, 60.0))


def st_wilcoxon(spark, d):
    """Mean tail x of the two mice, paired by video."""
    m = pose(spark, d).groupBy("video_id").agg(*[F.round(F.avg(F.when(F.col("mouse_id") == i, F.col("nose_x"))), 2).alias(f"m{i}") for i in (1, 2)])
    return _r6(T.wilcoxon(m.withColumn("lab_id", F.col("video_id") % 3), "m1", "m2", "lab_id"))


def st_bootstrap(spark, d):
    m = pose(spark, d).groupBy("video_id").agg(F.avg("nose_x").alias("x"))
    return _r6(T.bootstrap_mean(m, "x", "video_id", 50))


def st_aulc(spark, d):
    """Area under the curve of mean noses by spells of 25 frames, over all frames."""
    c = pose(spark, d).groupBy("mouse_id", F.floor(F.col("video_frame") / 25).alias("spell")).agg(F.avg("nose_x").alias("x"))
    return _r6(T.aulc(c, "spell", "x", "mouse_id"))


def st_drift(spark, d):
    return _r6(D.drift(pose(spark, d), ["nose_x", "nose_y", "tail_base_x"], "video_id"))


def st_correlations(spark, d):
    """Pearson correlations of column pairs, in one pass."""
    c = ["nose_x", "neck_x", "tail_base_x", "tail_base_y"]
    one = pose(spark, d).agg(*[F.corr(a, b).alias(f"{a}|{b}") for i, a in enumerate(c) for b in c[i + 1 :]])
    return _r6(one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for i, a in enumerate(c) for b in c[i + 1 :]]))))


def st_displacement(spark, d):
    """Distance of smoothed from raw noses: mean, percentile, share above 5."""
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", "nose_x", "nose_y")
    s = P.smoothed(p, ["nose_x", "nose_y"]).toDF("video_id", "mouse_id", "video_frame", "sx", "sy")
    j = written(p.join(s, ["video_id", "mouse_id", "video_frame"]).select("mouse_id", G.distance("nose_x", "nose_y", "sx", "sy").alias("e")), "displacement")
    p95 = T.exact_percentiles(j, ["e"], (0.95,), "mouse_id").select("mouse_id", F.get("v", F.lit(0)).alias("p95"))
    return _r6(p95.join(j.groupBy("mouse_id").agg(F.avg("e").alias("mean"), F.max("e").alias("max"), F.avg((F.col("e") > 5).cast("int")).alias("above_5"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")), "mouse_id"))


def st_jerk(spark, d):
    from ..functions import signal as S

    w = P.by_mouse()
    p = pose(spark, d).select("video_id", "mouse_id", *[S.third_difference(f"nose_{a}", w).alias(f"j{a}") for a in "xy"]).withColumn("j", F.sqrt(F.col("jx") * F.col("jx") + F.col("jy") * F.col("jy")))
    return _r6(p.groupBy("video_id", "mouse_id").agg(F.avg("j").alias("mean_jerk"), F.percentile("j", F.lit(0.95)).alias("p95_jerk"), F.avg(F.col("j") * F.col("j")).alias("energy")))


def st_turning(spark, d):
    """Turning angles of the nose where both steps are longer than 0.5: number, mean and largest."""
    w = P.by_mouse()
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", *[(F.col(f"nose_{a}") - F.lag(f"nose_{a}").over(w)).alias(f"d{a}") for a in "xy"])
    p = p.withColumns({"n": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "a": F.atan2("dy", "dx")})
    t = F.abs(G.wrap(F.col("a") - F.lag("a").over(w)))
    p = p.withColumn("t", F.when((F.col("n") > 0.5) & (F.lag("n").over(w) > 0.5), t))
    return _r6(p.groupBy("video_id").agg(F.count("t").alias("n"), F.avg("t").alias("mean"), F.max("t").alias("largest")))


def st_alignment(spark, d):
    """Mean |sin| between the body axis and the head."""
    return _r6(pose(spark, d).withColumn("s", G.cross_sine("tail_base", "neck", "nose")).groupBy("video_id").agg(F.avg(F.abs("s")).alias("score")))


def st_bone_variance(spark, d):
    return _r6(Q.edge_lengths(pose(spark, d), "mouse_id").groupBy("mouse_id", "edge").agg((F.stddev_samp("length") / F.avg("length")).alias("cv")))


def st_dz_by_action(spark, d):
    """Implied depth during annotated frames: per interval, then per action."""
    z = P.implied_depth(pose(spark, d), 100.0).select("video_id", F.col("mouse_id").alias("agent_id"), F.col("video_frame").cast("long").alias("video_frame"), "dz_sum")
    f = I.covered(_clean(spark, d), z, ["video_id", "agent_id"], inclusive=True)
    one = f.groupBy("action", "event_id").agg(F.avg("dz_sum").alias("mean"), F.max("dz_sum").alias("most"), F.count("*").alias("n"))
    return _r6(one.groupBy("action").agg(F.avg("mean").alias("mean"), F.max("most").alias("most"), F.sum("n").alias("frames")))


QUERIES = {k: v for k, v in globals().items() if k[:3] in ("ql_", "dc_", "st_")}

# ---- SQL ----

r6 = lambda e, n: rs(e, n, 6)
_EDGE = POSE_SQL + ", edge AS (" + " UNION ALL ".join(f"SELECT video_id, mouse_id, '{a}→{b}' AS edge, {_D(a, b)} AS length, {n * 100!r}::DOUBLE AS l_ref FROM pose" for (a, b), n in zip(G.EDGES, G.DEFAULT_LENGTHS)) + ")"
_SPEED = LONG_SQL + """, lw AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS speed FROM long WINDOW w AS (PARTITION BY video_id, mouse_id, bodypart ORDER BY video_frame)),
sp AS (SELECT *, abs(speed - lag(speed) OVER (PARTITION BY video_id, mouse_id, bodypart ORDER BY video_frame)) AS accel FROM lw)"""
_VIO = lambda by: f"SELECT {by}edge, avg(coalesce((abs(length - l_ref) / l_ref > {{t}})::INT, 0)) AS violation_rate, avg(abs(length - l_ref) / l_ref) AS mean_rel_err, avg(abs(length - l_ref)) AS mean_dev, max(abs(length - l_ref)) AS max_dev, quantile_cont(abs(length - l_ref), 0.5) AS p50, quantile_cont(abs(length - l_ref), 0.75) AS p75, quantile_cont(abs(length - l_ref), 0.95) AS p95, quantile_cont(abs(length - l_ref), 0.99) AS p99, stddev_pop(abs(length - l_ref)) AS std_dev FROM edge GROUP BY ALL"
_VCOLS = "violation_rate mean_rel_err mean_dev max_dev p50 p75 p95 p99 std_dev".split()
_FIT = lambda by: f"WITH {_EDGE}, b AS (SELECT {by}quantile_cont({_D('nose', 'tail_base')}, 0.5) AS lb FROM pose WHERE {_D('nose', 'tail_base')} > 0 GROUP BY ALL), r AS (SELECT {by}edge, length / lb AS r FROM edge {'JOIN b USING (mouse_id)' if by else ', b'} WHERE length > 0) SELECT {by}edge, {r6('quantile_cont(r, 0.5)', 'l_ref')}, {r6('stddev_samp(r)', 'l_std')}, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 10"
_ACT = f"""{PROBA_LONG_SQL}, act AS (SELECT DISTINCT video_id, agent, CASE WHEN agent <> target THEN target END AS target, c.cls FROM proba, (SELECT unnest(range(0, 10))::INT AS cls) AS c WHERE window_id % 3 <> 1 AND (video_id + c.cls) % 4 <> 0),
thr AS (SELECT lab_id, cls, quantile_cont(p, 0.6) AS t FROM pl GROUP BY ALL),
al AS (SELECT pl.*, EXISTS (SELECT 1 FROM act AS a WHERE a.video_id = pl.video_id AND a.agent = pl.agent AND a.cls = pl.cls AND (a.target IS NULL OR a.target = pl.target)) AS allowed FROM pl)"""
_DEC = lambda m: f"{_ACT}, dd AS (SELECT al.*, t, row_number() OVER (PARTITION BY window_id ORDER BY (CASE WHEN allowed AND al.cls <> 0 THEN {m} END) DESC NULLS LAST, al.cls) AS rn FROM al JOIN thr ON thr.lab_id = al.lab_id AND thr.cls = al.cls), dec AS (SELECT window_id, lab_id, video_id, agent, target, core_start, core_stop, CASE WHEN allowed AND cls <> 0 AND p > t THEN cls ELSE 0 END AS cls FROM dd WHERE rn = 1)"
_AM = f"{PROBA_SQL}, am AS (SELECT window_id, video_id, y, list_position(p, list_max(p))::INT - 1 AS pred, list_max(p) AS p FROM proba), cf AS (SELECT y, pred, count(*) AS n FROM am GROUP BY ALL), cls AS (SELECT cls, coalesce(sum(CASE WHEN y = cls AND pred = cls THEN n END), 0) AS tp, coalesce(sum(CASE WHEN y = cls THEN n END), 0) AS t, coalesce(sum(CASE WHEN pred = cls THEN n END), 0) AS pp FROM (SELECT y AS cls FROM cf UNION SELECT pred FROM cf), cf GROUP BY cls), rep AS (SELECT cls, coalesce(tp / nullif(pp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(t, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(t + pp, 0), 0)::DOUBLE AS f1, t::BIGINT AS support FROM cls)"
_HV = f"{_CEN}, k AS (SELECT video_id, mouse_id, video_frame, sqrt(({_HALF('cx')}) ** 2 + ({_HALF('cy')}) ** 2) AS v, video_frame < 150 AS early FROM cen)"
_FLAGS = f"{POSE_SQL}, s AS (SELECT *, sqrt((tail_base_x - lag(tail_base_x) {W}) ** 2 + (tail_base_y - lag(tail_base_y) {W}) ** 2) AS s FROM pose), a AS (SELECT *, abs(s - lag(s) {W}) AS a FROM s), q AS (SELECT video_id, mouse_id, quantile_cont(s, 0.25) AS s1, quantile_cont(s, 0.75) AS s3, quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.75) AS a3 FROM a GROUP BY ALL), f2 AS (SELECT video_id, tail_base_x IS NULL OR tail_base_y IS NULL AS missing, coalesce(s > s3 + 1.5 * (s3 - s1), false) AS speed, coalesce(a > a3 + 1.5 * (a3 - a1), false) AS accel, coalesce(abs({_D('hip_left', 'tail_base')} - {0.3 * 100!r}) / {0.3 * 100!r} > 0.25, false) AS length, coalesce(abs(tail_base_x) < 2 AND abs(tail_base_y) < 2, false) AS near_zero FROM a JOIN q USING (video_id, mouse_id))"
_SEVERITY = "missing::INT + speed::INT + 0.75::DOUBLE * accel::INT + length::INT + near_zero::INT"
_PS = f"{PROBA_LONG_SQL}, ps AS (SELECT video_id, agent, cls, video_id AS v, agent * 10 + cls AS mouse, core_start, window_id, p, row_number() OVER g AS rn, count(*) OVER (PARTITION BY video_id, agent, cls) AS tt, first_value(p) OVER f AS fst, last_value(p) OVER f AS lst FROM pl WINDOW g AS (PARTITION BY video_id, agent, cls ORDER BY core_start, window_id), f AS (PARTITION BY video_id, agent, cls ORDER BY core_start, window_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_WEIGHT = " + ".join(f"(u >= {c})::INT" for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183))

SQL = {
    "ql_keypoint_report": f"WITH {_SPEED}, c AS (SELECT avg(speed) + 3 * stddev_samp(speed) AS cut FROM sp) SELECT bodypart, count(DISTINCT video_frame) AS n_frames, count(DISTINCT mouse_id) AS n_mice, {r6('avg((x IS NULL)::INT)', 'missing')}, {r6('avg((speed > cut)::INT)', 'speed_outliers')} FROM sp, c GROUP BY bodypart",
    "ql_value_counts": f"WITH {META_SQL}, u AS (SELECT 'lab' AS kind, lab_id AS value FROM meta UNION ALL SELECT 'method', tracking_method FROM meta UNION ALL SELECT 'mouse1', strain FROM meta UNION ALL SELECT 'mouse2', strain FROM meta WHERE video_id % 2 = 0 UNION ALL SELECT 'mouse3', strain FROM meta WHERE video_id % 3 = 0 UNION ALL SELECT 'mouse4', strain FROM meta WHERE video_id % 5 = 0) SELECT kind, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL",
    "ql_keypoints_per_lab": f"WITH {META_SQL} SELECT lab_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(body_parts)))), ';'), '') AS keypoints FROM meta GROUP BY lab_id",
    "ql_keypoint_intersection": f"WITH {META_SQL}, m AS (SELECT * FROM meta WHERE len(body_parts) > 0), n AS (SELECT lab_id, count(*) AS v FROM m GROUP BY lab_id), k AS (SELECT lab_id, keypoint, count(*) AS c FROM (SELECT lab_id, unnest(body_parts) AS keypoint FROM m) GROUP BY ALL) SELECT lab_id, keypoint FROM k JOIN n USING (lab_id) WHERE c = v",
    "ql_duration_describe": f"WITH {CLEAN_SQL} SELECT action, count(*) AS n, {r6('avg(duration_frames)', 'mean')}, {r6('stddev_samp(duration_frames)', 'std')}, min(duration_frames) AS min, max(duration_frames) AS max, {', '.join(r6(f'quantile_cont(duration_frames::DOUBLE, {q})', n) for n, q in (('p25', .25), ('p50', .5), ('p75', .75), ('p95', .95)))}, sum(duration_frames)::BIGINT AS total FROM clean GROUP BY action",
    "ql_action_entropy": f"WITH {CLEAN_SQL}, n AS (SELECT action, count(*) AS n FROM clean GROUP BY action), e AS (SELECT -sum(n / t * log2(n / t)) AS entropy, max(n) / min(n) AS imbalance FROM n, (SELECT sum(n)::DOUBLE AS t FROM n)) SELECT {r6('entropy', 'entropy')}, {r6('imbalance', 'imbalance')}, {r6('pow(2.0, entropy)', 'effective')} FROM e",
    "ql_lab_action_pivot": f"WITH {CLEAN_SQL} SELECT video_id % 4 AS lab_id, " + ", ".join(r6(f"count_if(action = '{n}')::DOUBLE / count(*)", n) for n in ("click", "error", "purchase", "signup", "view")) + " FROM clean GROUP BY 1",
    "ql_transitions": f"WITH {CLEAN_SQL}, x AS (SELECT action, lead(action) OVER (PARTITION BY video_id ORDER BY start_frame, stop_frame, event_id) AS next FROM clean), n AS (SELECT action, next, count(*) AS n FROM x WHERE next IS NOT NULL GROUP BY ALL) SELECT action, next, n, {r6('n::DOUBLE / sum(n) OVER (PARTITION BY action)', 'share')} FROM n",
    "ql_transitions_roles": f"WITH x AS (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS next FROM (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL)), n AS (SELECT role, next, count(*) AS n FROM x WHERE next IS NOT NULL GROUP BY ALL) SELECT role, next, n, {r6('n::DOUBLE / sum(n) OVER (PARTITION BY role)', 'share')} FROM n",
    "ql_missing_rate": f"WITH {LONG_SQL} SELECT video_id % 4 AS lab_id, bodypart, {r6('avg((x IS NULL)::INT)', 'x')}, {r6('avg((y IS NULL)::INT)', 'y')}, {r6('avg((x IS NULL OR y IS NULL)::INT)', '\"any\"')} FROM long GROUP BY ALL",
    "ql_outlier_rates": f"WITH {_SPEED}, sl AS (SELECT *, video_id % 4 AS lab_id FROM sp), m AS (SELECT lab_id, bodypart, median(speed) AS ms, median(accel) AS ma FROM sl GROUP BY ALL), d AS (SELECT lab_id, bodypart, any_value(ms) + 6 * 1.4826 * median(abs(speed - ms)) AS ts, any_value(ma) + 6 * 1.4826 * median(abs(accel - ma)) AS ta FROM sl JOIN m USING (lab_id, bodypart) GROUP BY ALL) SELECT lab_id, bodypart, {r6('avg((speed > ts)::INT)', 'speed_outliers')}, {r6('avg((accel > ta)::INT)', 'accel_outliers')} FROM sl JOIN d USING (lab_id, bodypart) GROUP BY ALL",
    "ql_recording_report": f"WITH {_SPEED}, c AS (SELECT video_id, avg(speed) + 3 * stddev_samp(speed) AS cut FROM sp GROUP BY video_id), a AS (SELECT video_id, count(DISTINCT video_frame) AS n_frames, count(DISTINCT mouse_id) AS n_mice, avg((x IS NULL OR y IS NULL)::INT) AS nan_rate, avg(coalesce(speed > cut, false)::INT) AS so FROM sp JOIN c USING (video_id) GROUP BY video_id), l AS (SELECT video_id, mouse_id, {_D('nose', 'tail_base')} AS l FROM pose), m AS (SELECT video_id, mouse_id, median(l) AS m FROM l GROUP BY ALL), v AS (SELECT video_id, avg(coalesce(abs(l - m) / m > 0.25, false)::INT) AS lv FROM l JOIN m USING (video_id, mouse_id) GROUP BY video_id) SELECT video_id, n_frames, n_mice, {r6('nan_rate', 'nan_rate')}, {r6('so', 'speed_outlier_rate')}, {r6('lv', 'length_violation_rate')} FROM a JOIN v USING (video_id)",
    "ql_length_and_jumps": f"WITH {_CEN}, a AS (SELECT video_id, mouse_id, {_D('nose', 'tail_base')} AS l, ang - lag(ang) {W} AS s FROM cen), m AS (SELECT video_id, mouse_id, median(l) AS m FROM a GROUP BY ALL) SELECT video_id, {r6('avg((abs(l - m) / m > 0.25)::INT)', 'length_violations')}, {r6('avg((abs((s + pi()) - 2 * pi() * floor((s + pi()) / (2 * pi())) - pi()) > 1.5707963267948966)::INT)', 'angle_jumps')} FROM a JOIN m USING (video_id, mouse_id) GROUP BY video_id",
    "ql_fit_skeleton": _FIT(""),
    "ql_fit_skeleton_per_mouse": _FIT("mouse_id, "),
    "ql_violations": f"WITH {_EDGE}, v AS ({_VIO('mouse_id, ').format(t=0.25)}) SELECT mouse_id, edge, {', '.join(r6(c, c) for c in _VCOLS)} FROM v",
    "ql_keypoint_violations": f"WITH {_EDGE}, v AS ({_VIO('').format(t=0.9)}), e AS (SELECT unnest(string_split(edge, '→')) AS keypoint, * FROM v) SELECT keypoint, {r6('violation_rate', 'violation_rate')}, {r6('mean_rel_err', 'mean_rel_err')} FROM e QUALIFY row_number() OVER (PARTITION BY keypoint ORDER BY violation_rate DESC, edge DESC) = 1",
    "ql_any_violation_rate": f"WITH {POSE_SQL} SELECT video_id, {r6('avg((' + ' OR '.join(f'coalesce(abs({_D(a, b)} - {n * 100!r}) / {n * 100!r} > 0.95, false)' for (a, b), n in zip(G.EDGES, G.DEFAULT_LENGTHS)) + ')::INT)', 'rate')} FROM pose GROUP BY video_id",
    "ql_adaptive_thresholds": f"WITH {_EDGE}, r AS (SELECT edge, abs(length - l_ref) / l_ref AS r FROM edge WHERE length IS NOT NULL), q AS (SELECT edge, quantile_cont(r, 0.75) AS q FROM r GROUP BY edge) SELECT edge, {r6('greatest(0.05, avg(r) + 3 * stddev_pop(r))', 'tau')} FROM r JOIN q USING (edge) WHERE r <= q GROUP BY edge",
    "ql_reestimated": f"WITH {_EDGE}, r AS (SELECT edge, length, abs(length - l_ref) AS dev FROM edge WHERE length IS NOT NULL), q AS (SELECT edge, quantile_cont(dev, 0.5) AS m FROM r GROUP BY edge), h AS (SELECT edge, quantile_cont(length, 0.25) AS a, quantile_cont(length, 0.5) AS b, quantile_cont(length, 0.75) AS c FROM r JOIN q USING (edge) WHERE dev <= m GROUP BY edge) SELECT edge, {r6('b', 'l_ref')}, {r6('least(0.2, greatest(0.02, (c - a) / 1.35 / b))', 'sigma')} FROM h",
    "ql_outlier_flags": f"WITH {_FLAGS} SELECT video_id, {', '.join(f'count_if({c})::BIGINT AS {c}' for c in ('missing', 'speed', 'accel', 'length', 'near_zero'))}, {r6(f'sum({_SEVERITY})', 'severity')} FROM f2 GROUP BY video_id",
    "ql_speed_spikes": f"WITH {POSE_SQL}, s AS (SELECT *, sqrt((nose_x - lag(nose_x) {W}) ** 2 + (nose_y - lag(nose_y) {W}) ** 2) AS s FROM pose), m AS (SELECT video_id, mouse_id, median(s) AS m FROM s GROUP BY ALL), t AS (SELECT video_id, mouse_id, any_value(m) + 2.0 / 0.6745 * median(abs(s - m)) AS t FROM s JOIN m USING (video_id, mouse_id) GROUP BY ALL) SELECT video_id, count(nose_x) FILTER (WHERE coalesce(s <= t, true)) AS kept, {r6('sum(nose_x) FILTER (WHERE coalesce(s <= t, true))', 's')} FROM s JOIN t USING (video_id, mouse_id) GROUP BY video_id",
    "ql_overlap_mask": f"WITH {_CEN} SELECT video_id, count_if(o)::BIGINT AS n FROM (SELECT a.video_id, a.video_frame, bool_or(coalesce(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 0) < 5) AS o FROM cen AS a JOIN cen AS b ON a.video_id = b.video_id AND a.video_frame = b.video_frame AND a.mouse_id < b.mouse_id GROUP BY ALL) GROUP BY video_id",
    "ql_corrupted": f"WITH {POSE_SQL}, u AS (SELECT video_id, nose_x, ('0x' || substr(md5(concat_ws('|', '0dropnose_x', video_id, mouse_id, video_frame)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS a, ('0x' || substr(md5(concat_ws('|', '0noisenose_x', video_id, mouse_id, video_frame)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS b FROM pose), c AS (SELECT *, CASE WHEN a < 0.05 THEN 0 ELSE nose_x + 5.0 * (2 * b - 1) END AS z FROM u) SELECT video_id, count_if(z = 0)::BIGINT AS dropped, {r6('sqrt(avg((z - nose_x) ** 2))', 'rmse')} FROM c GROUP BY video_id",
    "dc_active_mask": f"WITH {_ACT} SELECT video_id, cls, count(*) AS n FROM al WHERE allowed GROUP BY ALL",
    "dc_residual": f"WITH {_DEC('p - t')} SELECT window_id, cls FROM dec",
    "dc_ratio": f"WITH {_DEC('p / greatest(t, 1e-6)')} SELECT window_id, cls FROM dec",
    "dc_intervals": f"WITH {_DEC('p - t')}, o AS (SELECT *, coalesce(cls <> lag(cls) OVER w OR core_start > lag(core_stop) OVER w, true) AS b FROM dec WINDOW w AS (PARTITION BY video_id, agent, target ORDER BY core_start, window_id)), g AS (SELECT *, sum(b::INT) OVER (PARTITION BY video_id, agent, target ORDER BY core_start, window_id) AS i FROM o) SELECT video_id, agent AS agent_id, target AS target_id, 'c' || cls AS action, min(core_start) AS start_frame, max(core_stop) AS stop_frame FROM g WHERE cls <> 0 GROUP BY video_id, agent, target, cls, i",
    "dc_decode_frames": f"WITH {PROBA_SQL}, b AS (SELECT video_id, agent, core_start, CASE WHEN list_max(p) >= 0.2 THEN list_position(p, list_max(p))::INT - 1 ELSE -1 END AS cls FROM proba), c AS (SELECT * FROM (SELECT *, coalesce(cls <> lag(cls) OVER (PARTITION BY video_id, agent ORDER BY core_start), true) AS ch FROM b) WHERE ch), n AS (SELECT *, lead(core_start) OVER (PARTITION BY video_id, agent ORDER BY core_start) AS stop FROM c) SELECT video_id, agent AS agent_id, agent AS target_id, cls, core_start AS start_frame, stop AS stop_frame FROM n WHERE cls >= 0 AND stop IS NOT NULL",
    "dc_revived": f"WITH {_DEC('p - t')} SELECT lab_id, cls, window_id, row_number() OVER (PARTITION BY lab_id ORDER BY p DESC, window_id)::INT AS rn, {r6('p', 'p')} FROM pl WHERE cls = 4 AND window_id IN (SELECT window_id FROM dec WHERE cls = 0) QUALIFY rn <= 5",
    "dc_confusion": f"WITH {_AM} SELECT * FROM cf",
    "dc_class_report": f"WITH {_AM} SELECT cls, {', '.join(r6(c, c) for c in ('precision', 'recall', 'f1'))}, support FROM rep",
    "dc_summary": f"WITH {_AM} SELECT {r6('avg(f1)', 'macro_f1')}, {r6('avg(precision)', 'macro_precision')}, {r6('avg(recall)', 'macro_recall')}, {r6('sum(f1 * support) / sum(support)', 'weighted_f1')}, count(*) AS classes FROM rep WHERE support > 0",
    "dc_calibration": f"WITH {_AM}, b AS (SELECT floor(p * 10) AS b, count(*) AS n, avg(p) AS c, avg((y = pred)::INT) AS a FROM am WHERE p < 1 GROUP BY 1) SELECT {r6('sum(n::DOUBLE / (SELECT count(*) FROM am) * abs(a - c))', 'ece')} FROM b",
    "dc_class_weights": f"WITH {PROBA_SQL}, n AS (SELECT y, count(*) AS n FROM proba GROUP BY y) SELECT y, n, {r6('(SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * n)', 'balanced')}, {r6('1.0::DOUBLE / n / (SELECT avg(1.0::DOUBLE / n) FROM n)', 'inverse')} FROM n",
    "dc_evaluable": f"WITH {PROBA_SQL} SELECT y, count(DISTINCT video_id) AS groups FROM proba GROUP BY y HAVING count(DISTINCT video_id) >= 2",
    "dc_top_pairs": f"WITH {_AM} SELECT y, pred, n, row_number() OVER (ORDER BY n DESC, y, pred)::INT AS rn FROM cf WHERE y <> pred QUALIFY rn <= 10",
    "dc_fuse_models": f"WITH {PROBA_LONG_SQL}, j AS (SELECT window_id, cls, CASE WHEN window_id % 3 = 0 THEN (p + (1 - p) * 3) / 4 ELSE p END AS p FROM pl) SELECT window_id, {r6('p', 'p')}, cls FROM j QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY p DESC, cls) = 1",
    "dc_uncertainty_top": f"WITH {PROBA_SQL}, u AS (SELECT window_id, round(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-12))), 6) AS entropy, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 6) AS margin, round(list_max(p), 6) AS top FROM proba), k AS (SELECT *, rank() OVER (ORDER BY -entropy) + (count(*) OVER (PARTITION BY entropy) - 1) / 2.0 AS a, rank() OVER (ORDER BY margin) + (count(*) OVER (PARTITION BY margin) - 1) / 2.0 AS b, rank() OVER (ORDER BY top) + (count(*) OVER (PARTITION BY top) - 1) / 2.0 AS c FROM u) SELECT window_id, entropy, margin, top, {r6('(a + b + c) / 3', 'rank')} FROM k ORDER BY (a + b + c) / 3, window_id LIMIT 20",
    "st_ks_speed": f"WITH {_HV}, n AS (SELECT video_id, round(v, 6) AS v, count_if(early) AS a, count_if(NOT early) AS b FROM k WHERE v IS NOT NULL GROUP BY ALL), g AS (SELECT *, abs(sum(a) OVER w::DOUBLE / nullif(sum(a) OVER p, 0) - sum(b) OVER w::DOUBLE / nullif(sum(b) OVER p, 0)) AS gap FROM n WINDOW w AS (PARTITION BY video_id ORDER BY v), p AS (PARTITION BY video_id)) SELECT video_id, {r6('max(gap)', 'ks')}, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM g GROUP BY video_id".replace("sum(a) OVER w::DOUBLE", "(sum(a) OVER w)::DOUBLE").replace("sum(b) OVER w::DOUBLE", "(sum(b) OVER w)::DOUBLE"),
    "st_cohens_d": f"WITH {_HV}, g AS (SELECT mouse_id, avg(v) FILTER (WHERE early) AS ma, avg(v) FILTER (WHERE NOT early) AS mb, var_pop(v) FILTER (WHERE early) AS va, var_pop(v) FILTER (WHERE NOT early) AS vb, count(v) FILTER (WHERE early) AS na, count(v) FILTER (WHERE NOT early) AS nb FROM k GROUP BY mouse_id), e AS (SELECT mouse_id, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM g) SELECT mouse_id, {r6('d', 'd')}, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS size FROM e",
    "st_kl_speed": f"WITH {_HV}, n AS (SELECT least(floor(v / 60 * 50), 49) AS b, count_if(early)::DOUBLE AS a, count_if(NOT early)::DOUBLE AS c FROM k WHERE v BETWEEN 0 AND 60 GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(c) AS tc FROM n) SELECT {r6('sum((a / ta + 1e-10) * ln((a / ta + 1e-10) / (c / tc + 1e-10)))', 'kl')} FROM n, t",
    "st_wilcoxon": f"WITH {POSE_SQL}, m AS (SELECT video_id % 3 AS lab_id, round(avg(nose_x) FILTER (WHERE mouse_id = 1), 2) - round(avg(nose_x) FILTER (WHERE mouse_id = 2), 2) AS d FROM pose GROUP BY video_id), z AS (SELECT *, abs(d) AS a FROM m WHERE d <> 0), k AS (SELECT *, rank() OVER (PARTITION BY lab_id ORDER BY a) + (count(*) OVER (PARTITION BY lab_id, a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY lab_id, a) AS t FROM z), g AS (SELECT lab_id, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0)::DOUBLE AS wp, coalesce(sum(r) FILTER (WHERE d < 0), 0)::DOUBLE AS wm, sum(t * t - 1)::DOUBLE AS tie FROM k GROUP BY lab_id) SELECT lab_id, n, {r6('wp', 'w_plus')}, {r6('wm', 'w_minus')}, {r6('least(wp, wm)', 'w')}, {r6('(least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie / 48)', 'z')}, {r6('1 - 2 * least(wp, wm) / (n * (n + 1))', 'effect')} FROM g",
    "st_bootstrap": f"WITH {POSE_SQL}, m AS (SELECT video_id, avg(nose_x) AS x FROM pose GROUP BY video_id), u AS (SELECT x, b, ('0x' || substr(md5(concat_ws('|', '0', video_id, b)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM m, (SELECT unnest(range(0, 50)) AS b)), w AS (SELECT b, sum(x * ({_WEIGHT})) / nullif(sum({_WEIGHT}), 0) AS m FROM u GROUP BY b) SELECT {r6('(SELECT avg(x) FROM m)', 'mean')}, {r6('quantile_cont(m, 0.025)', 'low')}, {r6('quantile_cont(m, 0.975)', 'high')} FROM w",
    "st_displacement": f"WITH {_SMOOTH}, e AS (SELECT a.mouse_id, sqrt((a.nose_x - b.nose_x) ** 2 + (a.nose_y - b.nose_y) ** 2) AS e FROM pose AS a JOIN sm AS b USING (video_id, mouse_id, video_frame)) SELECT mouse_id, {r6('avg(e)', 'mean')}, {r6('quantile_cont(e, 0.95)', 'p95')}, {r6('max(e)', 'max')}, {r6('avg((e > 5)::INT)', 'above_5')}, {r6('sqrt(avg(e * e))', 'rmse')} FROM e GROUP BY mouse_id",
    "dc_smoothed": f"WITH {_PS}, sv AS (SELECT video_id, agent, cls, {_savgol_sql('p', 9, 2).replace(W, 'OVER (PARTITION BY video_id, agent, cls ORDER BY core_start, window_id)')} AS p FROM ps) SELECT video_id, agent, cls, {r6('sum(coalesce(p, 0))', 's')}, {r6('max(coalesce(p, 0))', 'm')} FROM sv GROUP BY ALL",
    "st_aulc": f"WITH {POSE_SQL}, c AS (SELECT mouse_id, video_frame // 25 AS n, avg(nose_x) AS x FROM pose GROUP BY ALL), p AS (SELECT *, (n - lag(n) OVER w) * (x + lag(x) OVER w) / 2 AS a FROM c WINDOW w AS (PARTITION BY mouse_id ORDER BY n)) SELECT mouse_id, {r6('sum(a) / nullif(max(n) - min(n), 0)', 'aulc')} FROM p GROUP BY mouse_id",
    "st_drift": f"WITH {POSE_SQL}, g AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, var_pop({c}) AS {c}_v" for c in ("nose_x", "nose_y", "tail_base_x")) + " FROM pose GROUP BY video_id) SELECT " + ", ".join(r6(f"var_pop({c}_m) / avg({c}_v)", c) for c in ("nose_x", "nose_y", "tail_base_x")) + " FROM g",
    "st_correlations": f"WITH {POSE_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})', 'r')} FROM pose" for i, a in enumerate(("nose_x", "neck_x", "tail_base_x", "tail_base_y")) for b in ("nose_x", "neck_x", "tail_base_x", "tail_base_y")[i + 1 :]),
    "st_jerk": f"WITH {POSE_SQL}, j AS (SELECT video_id, mouse_id, sqrt(" + " + ".join(f"(nose_{a} - 3 * lag(nose_{a}) {W} + 3 * lag(nose_{a}, 2) {W} - lag(nose_{a}, 3) {W}) ** 2" for a in "xy") + f") AS j FROM pose) SELECT video_id, mouse_id, {r6('avg(j)', 'mean_jerk')}, {r6('quantile_cont(j, 0.95)', 'p95_jerk')}, {r6('avg(j * j)', 'energy')} FROM j GROUP BY ALL",
    "st_turning": f"WITH {POSE_SQL}, s AS (SELECT *, nose_x - lag(nose_x) {W} AS dx, nose_y - lag(nose_y) {W} AS dy FROM pose), n AS (SELECT *, sqrt(dx ** 2 + dy ** 2) AS n, atan2(dy, dx) AS a FROM s), t AS (SELECT video_id, CASE WHEN n > 0.5 AND lag(n) {W} > 0.5 THEN a - lag(a) {W} + pi() END AS t FROM n) SELECT video_id, count(t) AS n, {r6('avg(abs(t - 2 * pi() * floor(t / (2 * pi())) - pi()))', 'mean')}, {r6('max(abs(t - 2 * pi() * floor(t / (2 * pi())) - pi()))', 'largest')} FROM t GROUP BY video_id",
    "st_alignment": f"WITH {POSE_SQL}, e AS (SELECT video_id, neck_x - tail_base_x AS ux, neck_y - tail_base_y AS uy, nose_x - tail_base_x AS vx, nose_y - tail_base_y AS vy FROM pose) SELECT video_id, {r6('avg(abs((ux * vy - uy * vx) / nullif(sqrt(ux ** 2 + uy ** 2) * sqrt(vx ** 2 + vy ** 2), 0)))', 'score')} FROM e GROUP BY video_id",
    "st_bone_variance": f"WITH {_EDGE} SELECT mouse_id, edge, {r6('stddev_samp(length) / avg(length)', 'cv')} FROM edge GROUP BY ALL",
    "st_dz_by_action": f"WITH {POSE_SQL}, {CLEAN_SQL}, z AS (SELECT video_id, mouse_id, video_frame, {_DZSUM} AS dz FROM pose), o AS (SELECT action, event_id, avg(dz) AS m, max(dz) AS x, count(*) AS n FROM clean JOIN z ON z.video_id = clean.video_id AND mouse_id = agent_id AND video_frame >= start_frame AND video_frame <= stop_frame GROUP BY ALL) SELECT action, {r6('avg(m)', 'mean')}, {r6('max(x)', 'most')}, sum(n)::BIGINT AS frames FROM o GROUP BY action",
}
SQL = {k: v for k, v in SQL.items() if v}
