"""Queries on evaluation, prediction, motion, identity and selection, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import signal as Sg
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import frames as P
from ..operators import intervals as I
from ..operators import motion as Mo
from ..operators import quality as Q
from ..operators import repair as Re
from ..operators import selection as Se
from ..operators import stats as T
from ..sources import readers as R
from ..sources import sinks
from ..sources.adapters import KEYPOINTS, META_SQL, POSE_SQL, PROBA_LONG_SQL, PROBA_SQL, meta_raw, pose, proba, proba_long, to_long
from .frame_queries import _DZSUM, _HALF, _REL, _SMOOTH, _angle_sql, _MID, W, r4, rs
from .interval_queries import CLEAN_SQL, SCORE_SQL, _active as _annotated, _clean, _solution, _submission
from .quality_queries import _AM, _DEC, _EDGE, REFS, SQL as _RULES, _active, _argmax, _decided, _lab, _refs, _thresholds

r6 = lambda e, n: rs(e, n, 6)
CLASSES = ["click", "purchase", "view"]


def _r6(df):
    return r4(df, 6)


# ---- evaluation ----


def ev_label_codes(spark, d):
    """Actions as codes and back; those outside the classes are background."""
    c = _clean(spark, d).withColumn("code", E.encoded(F.col("action"), CLASSES))
    return c.groupBy("action", "code", E.decoded(F.col("code"), CLASSES).alias("label")).agg(F.count("*").alias("n"))


def ev_vocabulary(spark, d):
    return E.vocabulary(_clean(spark, d), 100)


def ev_paired_windows(spark, d):
    """Windows that a second variant also lets through, with its probability beside the first's."""
    a = proba(spark, d).select("video_id", "agent", "core_start", "y", F.array_max("p").alias("top"))
    b = a.where("top > 0.15").withColumn("top", F.col("top") / 2)
    return _r6(E.paired(a, b, ["video_id", "agent", "core_start"]).select("video_id", "agent", "core_start", "y", (F.col("a.top") - F.col("b.top")).alias("gap")))


def ev_reattached(spark, d):
    """The first body part, by name, that each frame has a place for."""
    p = pose(spark, d)
    keys = ["video_id", "mouse_id", "video_frame"]
    return E.reattached(p.select(*keys), to_long(p).where("x IS NOT NULL"), keys, ["bodypart"])


def ev_enriched_report(spark, d):
    m = meta_raw(spark, d).select("video_id", F.col("lab_id").alias("lab"), "tracking_method")
    return _r6(Q.recording_report(pose(spark, d), "video_id").join(m, "video_id", "left").select("video_id", "lab", "tracking_method", "n_frames", "nan_rate"))


def ev_fold_metrics(spark, d):
    p = _argmax(spark, d)
    return _r6(E.fold_metrics(p.withColumnRenamed("video_id", "fold"), D.evaluable(p, "y", "video_id")))


def ev_fold_event_score(spark, d):
    """Interval F-beta of each video apart."""
    by = lambda x: x.withColumn("lab_id", F.col("video_id"))
    return _r6(I.lab_scores(by(_solution(spark, d)), _submission(spark, d), _annotated(spark, d)).withColumnRenamed("lab_id", "video_id"))


def ev_fold_variants(spark, d):
    """Fold metrics of the largest probability and of the decision layer, side by side."""
    top = _argmax(spark, d)
    ok = D.evaluable(top, "y", "video_id")
    ruled = _decided(spark, d, "residual").select("window_id", F.col("video_id").alias("fold"), F.col("cls").alias("pred")).join(proba(spark, d).select("window_id", "y"), "window_id")
    m = [E.fold_metrics(x, ok).select("fold", "macro_full") for x in (top.withColumnRenamed("video_id", "fold"), ruled)]
    return _r6(E.with_suffixes(m[0], m[1], ["fold"], ("_top", "_ruled")))


def ev_variant_tests(spark, d):
    """Places of three keypoints against the nose's, by 20 groups of videos."""
    g = pose(spark, d).groupBy((F.col("video_id") % 20).alias("g")).agg(*[F.round(F.avg(c), 3).alias(c) for c in ("nose_x", "neck_x", "hip_left_x", "tail_base_x")])
    return _r6(E.compared(g, "nose_x", ["neck_x", "hip_left_x", "tail_base_x"]))


def ev_spearman(spark, d):
    """Per lab: the videos' missing tails against their mean noses."""
    v = _lab(pose(spark, d)).groupBy("lab_id", "video_id").agg(F.round(F.avg(F.col("tail_base_x").isNull().cast("int")), 6).alias("q"), F.round(F.avg("nose_x"), 6).alias("x"))
    return _r6(E.spearman(v, "q", "x", "lab_id"))


def _curve(spark, d):
    return proba_long(proba(spark, d)).where("cls = y").groupBy("lab_id", "agent", "core_start").agg(F.avg("p").alias("score"))


def ev_against_random(spark, d):
    c = _curve(spark, d).groupBy("lab_id", "agent").agg(F.avg("score").alias("score"))
    return _r6(E.against_random(c, "lab_id", "agent", "score", 0))


def ev_first_reaching(spark, d):
    c = _curve(spark, d).groupBy("lab_id", "core_start").agg(F.round(F.avg("score"), 9).alias("score"))
    return _r6(E.first_reaching(c, "lab_id", "core_start", "score"))


def ev_cross_labs(spark, d):
    """Share of a lab's windows above the mean top probability of another lab."""
    p = proba(spark, d).select("lab_id", F.array_max("p").alias("top"))
    m = E.shares_above(p, "lab_id", "top", p.groupBy(F.col("lab_id").alias("train")).agg(F.avg("top").alias("cut")))
    return _r6(E.cross_mean(m, "train", "test", "score"))


def ev_lab_thresholds(spark, d):
    s = _lab(Q.edge_lengths(pose(spark, d), "video_id")).groupBy("lab_id", "edge").agg((F.stddev_samp("length") / F.avg("length")).alias("sigma"))
    return _r6(E.lab_thresholds(s, "lab_id", 0.6))


def ev_population(spark, d):
    return _r6(E.population(pose(spark, d), "video_id", ["nose_x", "tail_base_x"]))


def _grid(spark, d):
    m = D.active_mask(proba_long(proba(spark, d)), _active(spark, d))
    return E.decision_grid(m, _thresholds(spark, d), ("residual", "ratio"), (0.8, 1.0, 1.25))


def ev_decision_grid(spark, d):
    return _r6(_grid(spark, d))


def ev_best_setting(spark, d):
    return _r6(E.best_setting(_grid(spark, d)))


def ev_ks_p(spark, d):
    """Gap between early and late noses of a video, and its chance."""
    p = pose(spark, d).select("video_id", F.round("nose_x", 3).alias("v"), (F.col("video_frame") < 150).alias("early"))
    k = T.ks_statistic(p, "v", "early", "video_id")
    return _r6(k.select("video_id", "ks", T.ks_p(F.col("ks"), F.col("n_a"), F.col("n_b")).alias("p")))


def ev_bootstrap_delta(spark, d):
    m = pose(spark, d).groupBy("video_id").agg(F.avg("nose_x").alias("a"), F.avg("neck_x").alias("b"))
    return _r6(T.bootstrap_delta(m, "a", "b", "video_id", 40))


def ev_subsampled(spark, d):
    m = pose(spark, d).groupBy("video_id").agg(F.avg("nose_x").alias("a"))
    return _r6(T.subsampled(m, "a", "video_id", 0.5, 40))


def ev_residuals(spark, d):
    return _r6(Q.residuals(Q.edge_lengths(pose(spark, d), "mouse_id"), _refs(spark), "mouse_id"))


def ev_violation_magnitudes(spark, d):
    return _r6(Q.violation_magnitudes(Q.edge_lengths(pose(spark, d), "mouse_id"), _refs(spark), 0.5, "mouse_id"))


def ev_orientation_flips(spark, d):
    return Q.orientation_flips(pose(spark, d)).groupBy("video_id").agg(F.count_if("flip").alias("flips"))


def ev_every_outlier(spark, d):
    """Severity of two keypoints, flips included."""
    o = Q.every_outlier(pose(spark, d), REFS, {"tail_base": ("hip_left", "tail_base"), "nose": ("nose", "neck")})
    return _r6(o.groupBy("keypoint").agg(F.count("*").alias("n"), F.sum("severity").alias("severity"), F.count_if("flip").alias("flips")))


def ev_existence(spark, d):
    """Which of the customers' videos have tracking."""
    asked = meta_raw(spark, d).select("video_id")
    return R.existence(asked, to_long(pose(spark, d)), "video_id")


def ev_lab_videos(spark, d):
    m = meta_raw(spark, d).select("video_id", "tracking_method")
    return R.lab_videos(_lab(to_long(pose(spark, d))), m)


def ev_context_scales(spark, d):
    """Means of 2, 5 and 10 frames before and after, less the frame."""
    w = P.by_mouse()
    cols = [c.alias(f"{n}{k}") for k in (2, 5, 10) for n, c in zip(("past", "coming"), Sg.context_means("nose_x", w, k))]
    return _r6(pose(spark, d).select("video_id", "mouse_id", "video_frame", *cols))


def ev_interval_depths(spark, d):
    """Implied depth of each annotated interval: mean, largest, deviation, median."""
    z = P.implied_depth(pose(spark, d), 100.0).select("video_id", F.col("mouse_id").alias("agent_id"), F.col("video_frame").cast("long").alias("video_frame"), "dz_sum")
    f = I.covered(_clean(spark, d), z, ["video_id", "agent_id"], inclusive=True)
    g = f.groupBy("event_id").agg(F.avg("dz_sum").alias("mean"), F.max("dz_sum").alias("most"), F.stddev_pop("dz_sum").alias("std"), F.percentile("dz_sum", F.lit(0.5)).alias("median"))
    return _r6(g)


def ev_grid_over_seeds(spark, d):
    """Curves of the mice of a lab read off at a grid: mean and deviation over them."""
    c = _lab(pose(spark, d)).groupBy("lab_id", "mouse_id", F.floor(F.col("video_frame") / 25).alias("spell")).agg(F.avg("nose_x").alias("x"))
    g = T.on_grid(c, "spell", "x", [0, 0.5, 2.25, 5], "lab_id", "mouse_id")
    return _r6(g.groupBy("lab_id", "g").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")))


def _members(spark, d):
    """Three members: the probabilities, and two softened forms of them."""
    p = proba_long(proba(spark, d)).select("window_id", "y", "cls", "p")
    soft = lambda m, k: p.select("window_id", "y", F.lit(m).alias("member"), "cls", ((F.col("p") + k * (F.col("cls") % 3)) / (1 + 9 * k)).alias("p"))
    return soft(0, 0.0).unionByName(soft(1, 0.02)).unionByName(soft(2, 0.2))


def ev_weighted_ensemble(spark, d):
    """Members weighted by the mean probability that they give the true class."""
    m = _members(spark, d)
    w = m.where("cls = y").groupBy("member").agg(F.avg("p").alias("w"))
    return _r6(E.weighted_ensemble(m, w))


def ev_blend_sweep(spark, d):
    q = F.transform("p", lambda x, i: F.when(i % 2 == 0, x * 1.1).otherwise(x * 0.9))
    return _r6(E.blend_sweep(proba(spark, d).select("y", "p", q.alias("q")), (0.0, 0.25, 0.5, 0.75, 1.0)))


def _detector(spark, d):
    """Steps of noses, some of which jump."""
    p = Mo.spiked(pose(spark, d), "nose", 0.03)
    w = P.by_mouse()
    step = G.distance("nose_x", "nose_y", F.lag("nose_x").over(w), F.lag("nose_y").over(w))
    bad = Mo.uniform("0spikenose", "video_id", "mouse_id", "video_frame") < 0.03
    return E.detector_grid(p.select("video_id", "mouse_id", step.alias("step"), bad.alias("bad")).where("step IS NOT NULL"), (0.5, 1.0, 1.5, 2.0, 3.0, 5.0), ["video_id", "mouse_id"])


def ev_detector_grid(spark, d):
    return _r6(_detector(spark, d))


def ev_detector(spark, d):
    return _r6(E.calibrated_detector(_detector(spark, d), 0.1))


# ---- prediction ----


def _routed(spark, d):
    return E.routed(_decided(spark, d, "residual"), _active(spark, d))


def pr_routed(spark, d):
    return _routed(spark, d).select("window_id", "target_id")


def pr_predicted(spark, d):
    """From probabilities to a submission: masks, thresholds, routing, intervals, row ids."""
    w = _routed(spark, d).select("window_id", "video_id", F.col("agent").alias("agent_id"), "target_id", F.when(F.col("cls") == 0, "background").otherwise(F.concat(F.lit("c"), "cls")).alias("action"), F.col("core_start").alias("start_frame"), F.col("core_stop").alias("stop_frame"))
    return sinks.with_row_ids(I.windows_to_intervals(w))


def pr_features(spark, d):
    """All features of each frame and pair; frames that the other mouse lacks have none of the relations."""
    f = P.features(pose(spark, d), smooth=0, unit=100.0)
    return r4(f.select("video_id", "agent", "target", "video_frame", "centroid_speed", "neck_spine", "dz_sum", "dist_centroid", "min_kp_dist"), 8)


def pr_nodes(spark, d):
    n = Mo.nodes(P.kinematics(pose(spark, d), smooth=0), KEYPOINTS, ("vx", "vy", "speed", "accel"))
    total = F.aggregate(F.flatten("nodes"), F.lit(0.0), lambda a, x: a + x)
    return r4(n.select("video_id", "mouse_id", "video_frame", F.size("nodes").alias("rows"), F.size(F.get("nodes", F.lit(0))).alias("columns"), total.alias("total")))


# ---- motion ----


def mo_normalised_speeds(spark, d):
    return _r6(Mo.normalised_speeds(pose(spark, d), "nose", 30.0, 100.0).groupBy("video_id").agg(F.count("speed").alias("n"), F.avg("speed").alias("mean"), F.max("speed").alias("most")))


def mo_fidelity(spark, d):
    return _r6(Mo.fidelity(pose(spark, d), "nose", 30.0, "video_id"))


def mo_preservation(spark, d):
    p = pose(spark, d)
    return _r6(Mo.preservation(p, P.smoothed(p, ["nose_x", "nose_y"]), "nose", 1.0, "video_id"))


def mo_displaced(spark, d):
    p = pose(spark, d)
    return _r6(Mo.displaced(p, P.smoothed(p, ["nose_x", "nose_y", "tail_base_x", "tail_base_y"]), ["nose", "tail_base"], 5.0, "mouse_id"))


def mo_corruptions(spark, d):
    """Per kind of corruption: frames whose left ear or nose moved, and how far on average."""
    p = pose(spark, d)
    kinds = {"occluded": Mo.occluded(p), "correlated": Mo.correlated(p), "spiked": Mo.spiked(p, "nose"), "drifting": Mo.drifting(p, "nose"), "swapped": Mo.swapped_ends(p), "burst": Mo.burst(p)}
    keys = ["video_id", "mouse_id", "video_frame"]
    base = p.select(*keys, "nose_x", "ear_left_x")
    out = None
    for kind, c in kinds.items():
        j = base.join(c.select(*keys, F.col("nose_x").alias("n"), F.col("ear_left_x").alias("e")), keys)
        g = j.agg(F.count_if((F.col("n") != F.col("nose_x")) | (F.col("e") != F.col("ear_left_x"))).alias("moved"), F.avg(F.abs(F.col("n") - F.col("nose_x"))).alias("nose"), F.avg(F.abs(F.col("e") - F.col("ear_left_x"))).alias("ear")).withColumn("kind", F.lit(kind))
        out = g if out is None else out.unionByName(g)
    return _r6(out)


def mo_recovery(spark, d):
    """Medians of five frames against jumps of single frames."""
    p = pose(spark, d)
    c = Mo.spiked(p, "nose", 0.03)
    near = P.by_mouse().rowsBetween(-2, 2)
    fixed = c.withColumns({f"nose_{a}": Sg.array_median(F.collect_list(f"nose_{a}").over(near)) for a in "xy"})
    return _r6(Mo.recovery(p, c, fixed, ["nose"], "video_id"))


def mo_similar_filled(spark, d):
    """Missing tails from the five frames of the mouse whose noses are nearest."""
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", "nose_x", "nose_y", "tail_base_x")
    gap = F.col("tail_base_x").isNull()
    f = Re.similar_filled(p.withColumn("gap", gap), ["nose_x", "nose_y", "tail_base_x"])
    return _r6(f.where("gap").select("video_id", "mouse_id", "video_frame", "tail_base_x"))


# ---- identity ----


def id_symmetric_swaps(spark, d):
    """Left and right exchanged in some frames: how many of those frames are mended."""
    p = pose(spark, d)
    m = Mo.symmetric_swaps(Mo.swapped_ends(p))
    return m.groupBy("video_id").agg(F.count_if("ear_swapped").alias("ears"), F.count_if("hip_swapped").alias("hips"))


def id_huddles(spark, d):
    return _r6(Mo.identity_check(pose(spark, d), 6.0).drop("a", "b"))


# ---- selection ----


def _columns():
    return ["nose_x", "neck_x", "ear_left_x", "ear_right_x", "hip_left_x", "tail_base_x", "nose_y", "neck_y"]


def _labelled(spark, d):
    return pose(spark, d).withColumn("y", (F.col("nose_x") > 25).cast("int") + (F.col("nose_y") > 30).cast("int"))


def se_collinear_pairs(spark, d):
    return _r6(Se.collinear_pairs(pose(spark, d), _columns(), 0.9))


def se_mutual_information(spark, d):
    return _r6(Se.mutual_information(_labelled(spark, d), _columns(), "y"))


def se_drift(spark, d):
    return _r6(Se.drift_scores(pose(spark, d), _columns(), "video_id"))


def se_selected(spark, d):
    return _r6(Se.select_features(_labelled(spark, d), _columns(), "y", "video_id"))


def se_percentiles(spark, d):
    """Exact percentiles of three columns per mouse."""
    return _r6(T.exact_percentiles(pose(spark, d), ["nose_x", "nose_y", "tail_base_x"], (0.0, 0.05, 0.5, 0.99), "mouse_id").select("mouse_id", "column", "n", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("p0", "p5", "p50", "p99"))]))


QUERIES = {k: v for k, v in globals().items() if k[:3] in ("ev_", "pr_", "mo_", "id_", "se_")}

# ---- SQL ----

_RT = _DEC("p - t") + ", own AS (SELECT DISTINCT video_id, agent, cls FROM act WHERE target IS NULL), rt AS (SELECT dec.* EXCLUDE (target), CASE WHEN own.cls IS NOT NULL THEN dec.agent ELSE dec.target END AS target FROM dec LEFT JOIN own ON own.video_id = dec.video_id AND own.agent = dec.agent AND own.cls = dec.cls)"
_FOLD = lambda src, fold: f"""SELECT fold, avg(f1) FILTER (WHERE ok AND t > 0) AS macro_eval, avg(f1) AS macro_full, sum(t)::BIGINT AS support FROM (SELECT fold, cls, sum(t) AS t, 2.0 * sum(tp) / (sum(t) + sum(p)) AS f1, cls IN (SELECT y FROM proba GROUP BY y HAVING count(DISTINCT video_id) >= 2) AS ok
  FROM (SELECT {fold} AS fold, y AS cls, 1 AS t, 0 AS p, (y = pred)::INT AS tp FROM {src} UNION ALL SELECT {fold}, pred, 0, 1, 0 FROM {src}) GROUP BY fold, cls) GROUP BY fold"""  # noqa: E731
_CURVE = f"WITH {PROBA_LONG_SQL}, cv AS (SELECT lab_id, agent, core_start, avg(p) AS score FROM pl WHERE cls = y GROUP BY ALL)"
_U = lambda tag, keys="video_id, mouse_id, video_frame": f"(('0x' || substr(md5(concat_ws('|', '{tag}', {keys})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_M = "video_id, mouse_id"
_HID = " OR ".join(f"(nn > s{i} AND pos >= floor({_U(f'0firsthead{i}', _M)} * (nn - s{i})) AND pos < floor({_U(f'0firsthead{i}', _M)} * (nn - s{i})) + s{i})" for i in range(3))
_HITS = {
    "occluded": (f"CASE WHEN {_HID} THEN 0 ELSE nose_x END", f"CASE WHEN {_HID} THEN 0 ELSE ear_left_x END"),
    "correlated": tuple(f"CASE WHEN {_U('0hithead')} < 0.05 THEN {c} + 10.0 * (2 * {_U('0xhead')} - 1) ELSE {c} END" for c in ("nose_x", "ear_left_x")),
    "spiked": (f"CASE WHEN {_U('0spikenose')} < 0.01 THEN nose_x + 60.0 * cos(2 * pi() * {_U('0turnnose')}) ELSE nose_x END", "ear_left_x"),
    "drifting": ("nose_x + 5.0 * sin(2 * pi() * video_frame / 200.0::DOUBLE)", "ear_left_x"),
    "swapped": ("nose_x", f"CASE WHEN {_U('0swap')} < 0.05 THEN ear_right_x ELSE ear_left_x END"),
    "burst": tuple(f"CASE WHEN nn > 20 AND bi >= 0 AND bi < 20 THEN {c} + (20 + 20 * {_U('0size', _M)}) * sin(2 * pi() * (3 + 5 * {_U('0rate', _M)}) * bi / 20) ELSE {c} END" for c in ("nose_x", "ear_left_x")),
}
_BURST = f"b AS (SELECT *, row_number() {W} - 1 AS pos, count(*) OVER (PARTITION BY {_M}) AS nn FROM pose), q AS (SELECT *, pos - floor({_U('0burst', _M)} * (nn - 20)) AS bi, " + ", ".join(f"10 + floor({_U(f'0sizehead{i}', _M)} * 41) AS s{i}" for i in range(3)) + " FROM b)"
_NORM = lambda f, k=0: f"sqrt(({f('nose_x')}) ** 2 + ({f('nose_y')}) ** 2)"
_D1 = lambda c: f"{c} - lag({c}) {W}"
_D2 = lambda c: f"lead({c}) {W} - 2 * {c} + lag({c}) {W}"
_D3 = lambda c: f"{c} - 3 * lag({c}) {W} + 3 * lag({c}, 2) {W} - lag({c}, 3) {W}"
_FID = lambda src, fps: f"SELECT video_id, quantile_cont(v, 0.5) AS speed_median, quantile_cont(v, 0.99) AS speed_p99, avg(a) AS accel_mean, sqrt(avg(j * j)) AS jerk_rms FROM (SELECT video_id, {_NORM(_D1)} * {fps} AS v, {_NORM(_D2)} * {fps} ** 2 AS a, {_NORM(_D3)} * {fps} ** 3 AS j FROM {src}) GROUP BY video_id"
_FNAMES = ("speed_median", "speed_p99", "accel_mean", "jerk_rms")
_WAYS = "list_reduce(list_prepend(list_transform(range(0, (n * (n + 1) // 2)::BIGINT + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), list_transform(range(1, n + 1), lambda r: [r::DOUBLE])), lambda acc, r: list_transform(range(1, len(acc) + 1), lambda i: acc[i] + CASE WHEN i > r[1] THEN acc[(i - r[1])::BIGINT] ELSE 0 END))"
_MED = lambda c, a, b: f"median({c}) OVER (PARTITION BY video_id ORDER BY video_frame ROWS BETWEEN {a} AND {b})"
_FOUR = ("x1", "y1", "x2", "y2")
_MIX = lambda mode, s: ("p - %s * t" if mode == "residual" else "p / greatest(%s * t, 1e-6)") % s
_SETTINGS = [(m, s, k) for m in ("residual", "ratio") for s in (0.8, 1.0, 1.25) for k in (True, False)]
_GRID = "WITH " + _DEC("p - t") + ", dg AS (" + " UNION ALL ".join(f"SELECT window_id, al.lab_id, y, '{m}' AS mode, {s}::DOUBLE AS scale, {k} AS mask, coalesce(arg_max(al.cls, ({_MIX(m, s)}, -al.cls)) FILTER (WHERE al.cls <> 0 AND p > {s} * t{' AND allowed' if k else ''}), 0) AS pred FROM al JOIN thr ON thr.lab_id = al.lab_id AND thr.cls = al.cls GROUP BY window_id, al.lab_id, y" for m, s, k in _SETTINGS) + "), gs AS (SELECT lab_id, mode, scale, mask, avg(f1) AS score FROM (SELECT lab_id, mode, scale, mask, cls, 2.0 * sum(tp) / count(*) AS f1 FROM (SELECT lab_id, mode, scale, mask, y AS cls, (y = pred)::INT AS tp FROM dg UNION ALL SELECT lab_id, mode, scale, mask, pred, 0 FROM dg) WHERE cls <> 0 GROUP BY ALL) GROUP BY ALL)"
_COLS = _columns()

_REL_ERR = f"{_EDGE}, r AS (SELECT mouse_id, edge, abs(length - l_ref) / l_ref AS r FROM edge WHERE length IS NOT NULL)"
_FLIP = f"h AS (SELECT video_id, mouse_id, video_frame, atan2(nose_y - tail_base_y, nose_x - tail_base_x) AS a FROM pose), fl AS (SELECT video_id, mouse_id, video_frame, coalesce(abs(a - lag(a) {W} - 2 * pi() * floor((a - lag(a) {W} + pi()) / (2 * pi()))) > 1 AND abs(lead(a) {W} - a - 2 * pi() * floor((lead(a) {W} - a + pi()) / (2 * pi()))) > 1, false) AS flip FROM h)"
_BOOT = " + ".join(f"(u >= {c})::INT" for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183))
_UB = "('0x' || substr(md5(concat_ws('|', '0', video_id, b)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_CTX = lambda k, way: f"coalesce(avg(nose_x) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN {way.format(k)}) - nose_x, 0)"
_MEM = f"WITH {PROBA_LONG_SQL}, mb AS (" + " UNION ALL ".join(f"SELECT window_id, y, {m} AS member, cls, (p + {k}::DOUBLE * (cls % 3)) / {1 + 9 * k!r}::DOUBLE AS p FROM pl" for m, k in ((0, 0.0), (1, 0.02), (2, 0.2))) + ")"
_KS = (0.5, 1.0, 1.5, 2.0, 3.0, 5.0)
_DET = f"WITH {POSE_SQL}, c AS (SELECT *, {_U('0spikenose')} < 0.03 AS bad, " + ", ".join(f"CASE WHEN {_U('0spikenose')} < 0.03 THEN nose_{a} + 60.0 * {f}(2 * pi() * {_U('0turnnose')}) ELSE nose_{a} END AS c{a}" for a, f in (("x", "cos"), ("y", "sin"))) + f" FROM pose), s AS (SELECT video_id, mouse_id, bad, sqrt((cx - lag(cx) {W}) ** 2 + (cy - lag(cy) {W}) ** 2) AS step FROM c), q AS (SELECT video_id, mouse_id, quantile_cont(step, 0.25) AS q1, quantile_cont(step, 0.75) AS q3 FROM s WHERE step IS NOT NULL GROUP BY ALL), o AS (SELECT bad, (step - q3) / nullif(q3 - q1, 0) AS o FROM s JOIN q USING (video_id, mouse_id) WHERE step IS NOT NULL), dt AS (" + " UNION ALL ".join(f"SELECT {k}::DOUBLE AS k, avg(coalesce(o > {k}, false)::INT) FILTER (WHERE bad) AS caught, avg(coalesce(o > {k}, false)::INT) FILTER (WHERE NOT bad) AS \"false\" FROM o" for k in _KS) + ")"
_MIXED = lambda s: f"list_transform(range(1, 11), lambda i: round(p[i] * {s}::DOUBLE + p[i] * (CASE WHEN i % 2 = 1 THEN 1.1 ELSE 0.9 END)::DOUBLE * {1 - s}::DOUBLE, 9))"
SQL = {
    "ev_weighted_ensemble": f"{_MEM}, w AS (SELECT member, avg(p) AS w FROM mb WHERE cls = y GROUP BY member) SELECT window_id, cls, {r6('sum(p * w) / sum(w)', 'p')} FROM mb JOIN w USING (member) GROUP BY ALL",
    "ev_blend_sweep": f"WITH {PROBA_SQL} " + " UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, {r6(f'avg((list_position({_MIXED(s)}, list_max({_MIXED(s)})) - 1 = y)::INT)', 'accuracy')} FROM proba" for s in (0.0, 0.25, 0.5, 0.75, 1.0)),
    "ev_detector_grid": f"{_DET} SELECT k, {r6('caught', 'caught')}, {r6('\"false\"', '\"false\"')} FROM dt",
    "ev_detector": f"{_DET} SELECT k, {r6('caught', 'caught')}, {r6('\"false\"', '\"false\"')} FROM dt WHERE \"false\" <= 0.1 ORDER BY round(caught, 9) DESC, k DESC LIMIT 1",
    "ev_ks_p": f"WITH {POSE_SQL}, n AS (SELECT video_id, round(nose_x, 3) AS v, count_if(video_frame < 150) AS a, count_if(video_frame >= 150) AS b FROM pose GROUP BY ALL), g AS (SELECT video_id, a, b, abs(sum(a) OVER w::DOUBLE / nullif(sum(a) OVER p, 0) - sum(b) OVER w::DOUBLE / nullif(sum(b) OVER p, 0)) AS gap FROM n WINDOW w AS (PARTITION BY video_id ORDER BY v), p AS (PARTITION BY video_id)), k AS (SELECT video_id, max(gap) AS ks, sum(a) AS na, sum(b) AS nb FROM g GROUP BY video_id), x AS (SELECT video_id, ks, ks * sqrt((na * nb)::DOUBLE / (na + nb)) AS x FROM k) SELECT video_id, {r6('ks', 'ks')}, {r6('CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 21), lambda i: (CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE * exp(-2.0 * i * i * x * x))))) END', 'p')} FROM x",
    "ev_bootstrap_delta": f"WITH {POSE_SQL}, m AS (SELECT video_id, avg(nose_x) - avg(neck_x) AS x FROM pose GROUP BY video_id), u AS (SELECT x, b, {_UB} AS u FROM m, (SELECT unnest(range(0, 40)) AS b)), w AS (SELECT b, sum(x * ({_BOOT})) / nullif(sum({_BOOT}), 0) AS m FROM u GROUP BY b) SELECT {r6('(SELECT avg(x) FROM m)', 'mean')}, {r6('quantile_cont(m, 0.025)', 'low')}, {r6('quantile_cont(m, 0.975)', 'high')} FROM w",
    "ev_subsampled": f"WITH {POSE_SQL}, m AS (SELECT video_id, avg(nose_x) AS x FROM pose GROUP BY video_id), u AS (SELECT x, b, {_UB} AS u FROM m, (SELECT unnest(range(0, 40)) AS b)), w AS (SELECT b, avg(x) AS m FROM u WHERE u < 0.5 GROUP BY b) SELECT {r6('avg(m)', 'mean')}, {r6('quantile_cont(m, 0.025)', 'low')}, {r6('quantile_cont(m, 0.975)', 'high')} FROM w",
    "ev_residuals": f"WITH {_REL_ERR} SELECT mouse_id, edge, {r6('avg(r)', 'mean')}, {r6('stddev_pop(r)', 'std')}, {r6('max(r)', 'most')}, {', '.join(r6(f'quantile_cont(r, {q})', n) for q, n in ((0.5, 'p50'), (0.9, 'p90'), (0.95, 'p95'), (0.99, 'p99')))} FROM r GROUP BY ALL",
    "ev_violation_magnitudes": f"WITH {_EDGE}, r AS (SELECT mouse_id, edge, CASE WHEN abs(length - l_ref) / l_ref > 0.5 THEN abs(length - l_ref) / l_ref - 0.5 END AS o FROM edge) SELECT mouse_id, edge, count(o) AS violations, {r6('avg(o)', 'mean_excess')}, {r6('max(o)', 'max_excess')} FROM r GROUP BY ALL",
    "ev_orientation_flips": f"WITH {POSE_SQL}, {_FLIP} SELECT video_id, count_if(flip)::BIGINT AS flips FROM fl GROUP BY video_id",
    "ev_existence": f"WITH {POSE_SQL}, {META_SQL}, n AS (SELECT video_id, count(*) * 7 AS n FROM pose GROUP BY video_id) SELECT meta.video_id, coalesce(n, 0)::BIGINT AS rows, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status FROM meta LEFT JOIN n ON n.video_id = meta.video_id",
    "ev_lab_videos": f"WITH {POSE_SQL}, {META_SQL}, n AS (SELECT video_id % 4 AS lab_id, video_id, count(*) * 7 AS n_rows, max(video_frame) + 1 AS n_frames FROM pose GROUP BY ALL) SELECT n.lab_id, n.video_id::VARCHAR AS video_id, n_rows, n_frames, tracking_method FROM n LEFT JOIN meta ON meta.video_id = n.video_id",
    "ev_context_scales": f"WITH {POSE_SQL} SELECT video_id, mouse_id, video_frame, " + ", ".join(rs(_CTX(k, way), f"{n}{k}", 6) for k in (2, 5, 10) for n, way in (("past", "{} PRECEDING AND 1 PRECEDING"), ("coming", "1 FOLLOWING AND {} FOLLOWING"))) + " FROM pose",
    "ev_interval_depths": f"WITH {POSE_SQL}, {CLEAN_SQL}, z AS (SELECT video_id, mouse_id, video_frame, {_DZSUM} AS dz FROM pose) SELECT event_id, {r6('avg(dz)', 'mean')}, {r6('max(dz)', 'most')}, {r6('stddev_pop(dz)', 'std')}, {r6('quantile_cont(dz, 0.5)', 'median')} FROM clean JOIN z ON z.video_id = clean.video_id AND mouse_id = agent_id AND video_frame >= start_frame AND video_frame <= stop_frame GROUP BY event_id",
    "ev_grid_over_seeds": f"WITH {POSE_SQL}, c AS (SELECT video_id % 4 AS lab_id, mouse_id, video_frame // 25 AS f, avg(nose_x) AS x FROM pose GROUP BY ALL), q AS (SELECT k.lab_id, k.mouse_id, g, (SELECT max(f) FROM c WHERE c.lab_id = k.lab_id AND c.mouse_id = k.mouse_id AND f <= g) AS f0, (SELECT min(f) FROM c WHERE c.lab_id = k.lab_id AND c.mouse_id = k.mouse_id AND f > g) AS f1 FROM (SELECT DISTINCT lab_id, mouse_id FROM c) AS k, (SELECT unnest([0, 0.5, 2.25, 5])::DOUBLE AS g)), y AS (SELECT q.lab_id, q.g, CASE WHEN a.x IS NULL THEN b.x WHEN b.x IS NULL THEN a.x ELSE a.x + (b.x - a.x) * (g - f0) / (f1 - f0) END AS y FROM q LEFT JOIN c AS a ON a.lab_id = q.lab_id AND a.mouse_id = q.mouse_id AND a.f = f0 LEFT JOIN c AS b ON b.lab_id = q.lab_id AND b.mouse_id = q.mouse_id AND b.f = f1) SELECT lab_id, g, {r6('avg(y)', 'mean')}, {r6('stddev_pop(y)', 'std')} FROM y GROUP BY ALL",
    "ev_label_codes": f"WITH {CLEAN_SQL}, c AS (SELECT action, coalesce(list_position({CLASSES!r}, action), 0)::INT - 1 AS code FROM clean) SELECT action, code, CASE WHEN code >= 0 THEN {CLASSES!r}[code + 1] ELSE 'background' END AS label, count(*) AS n FROM c GROUP BY ALL",
    "ev_vocabulary": f"WITH {CLEAN_SQL} SELECT DISTINCT action FROM clean WHERE start_frame < 100",
    "ev_paired_windows": f"WITH {PROBA_SQL} SELECT video_id, agent, core_start, y, {r6('list_max(p) - list_max(p) / 2', 'gap')} FROM proba WHERE list_max(p) > 0.15",
    "ev_reattached": f"WITH {POSE_SQL}, long AS (" + " UNION ALL ".join(f"SELECT video_id, mouse_id, video_frame, '{k}' AS bodypart FROM pose WHERE {k}_x IS NOT NULL" for k in KEYPOINTS) + ") SELECT video_id, mouse_id, video_frame, min(bodypart) AS bodypart FROM pose LEFT JOIN long USING (video_id, mouse_id, video_frame) GROUP BY ALL",
    "ev_enriched_report": f"WITH {POSE_SQL}, {META_SQL}, long AS (" + " UNION ALL ".join(f"SELECT video_id, video_frame, ({k}_x IS NULL OR {k}_y IS NULL)::INT AS gone FROM pose" for k in KEYPOINTS) + f"), a AS (SELECT video_id, count(DISTINCT video_frame) AS n_frames, avg(gone) AS g FROM long GROUP BY video_id) SELECT a.video_id, lab_id AS lab, tracking_method, n_frames, {r6('g', 'nan_rate')} FROM a LEFT JOIN meta ON meta.video_id = a.video_id",
    "ev_fold_metrics": f"WITH {_AM}, fm AS ({_FOLD('am', 'video_id')}) SELECT fold, {r6('macro_eval', 'macro_eval')}, {r6('macro_full', 'macro_full')}, support FROM fm",
    "ev_fold_event_score": f"WITH {SCORE_SQL.replace('video_id % 4 AS lab_id', 'video_id AS lab_id')} SELECT lab_id AS video_id, {r6('avg(f)', 'score')} FROM sc GROUP BY lab_id",
    "ev_fold_variants": f"WITH {_DEC('p - t')}, am AS (SELECT video_id, y, list_position(p, list_max(p))::INT - 1 AS pred FROM proba), rl AS (SELECT dec.video_id, y, cls AS pred FROM dec JOIN proba USING (window_id)), a AS ({_FOLD('am', 'video_id')}), b AS ({_FOLD('rl', 'video_id')}) SELECT fold, {r6('a.macro_full', 'macro_full_top')}, {r6('b.macro_full', 'macro_full_ruled')} FROM a JOIN b USING (fold)",
    "ev_variant_tests": f"WITH {POSE_SQL}, g AS (SELECT video_id % 20 AS g, " + ", ".join(f"round(avg({c}), 3) AS {c}" for c in ("nose_x", "neck_x", "hip_left_x", "tail_base_x")) + " FROM pose GROUP BY 1), l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variant, nose_x - {c} AS d FROM g" for c in ("neck_x", "hip_left_x", "tail_base_x")) + f"), k AS (SELECT variant, d, abs(d) AS a, rank() OVER (PARTITION BY variant ORDER BY abs(d)) + (count(*) OVER (PARTITION BY variant, abs(d)) - 1) / 2.0 AS r FROM l WHERE d <> 0), s AS (SELECT variant, count(*) AS n, count(DISTINCT a) AS k, coalesce(sum(r) FILTER (WHERE d > 0), 0)::DOUBLE AS up, coalesce(sum(r) FILTER (WHERE d < 0), 0)::DOUBLE AS down FROM k GROUP BY variant), w AS (SELECT *, least(up, down) AS w, CASE WHEN n = k AND n <= 25 THEN {_WAYS} END AS ways FROM s), p AS (SELECT *, least(1.0, 2 * list_sum(ways[1 : floor(w)::BIGINT + 1]) / pow(2.0, n)) AS pv FROM w) SELECT variant, n, {r6('w', 'w')}, {r6('CASE WHEN ways IS NOT NULL THEN pv END', 'p')}, {r6('1 - 2 * w / (n * (n + 1))', 'effect')}, CASE WHEN ways IS NOT NULL AND pv < 0.05 THEN CASE WHEN up > down THEN 'nose_x' ELSE variant END ELSE 'none' END AS better FROM p",
    "ev_spearman": f"WITH {POSE_SQL}, v AS (SELECT video_id % 4 AS lab_id, video_id, round(avg((tail_base_x IS NULL)::INT), 6) AS q, round(avg(nose_x), 6) AS x FROM pose GROUP BY ALL), k AS (SELECT lab_id, rank() OVER (PARTITION BY lab_id ORDER BY q) + (count(*) OVER (PARTITION BY lab_id, q) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lab_id ORDER BY x) + (count(*) OVER (PARTITION BY lab_id, x) - 1) / 2.0 AS b FROM v) SELECT lab_id, count(*) AS n, {r6('corr(a, b)', 'rho')} FROM k GROUP BY lab_id",
    "ev_against_random": f"{_CURVE}, c AS (SELECT lab_id, agent, avg(score) AS score FROM cv GROUP BY ALL), b AS (SELECT agent, score AS ref FROM c WHERE lab_id = 0) SELECT lab_id, {r6('avg(score)', 'mean')}, {r6('stddev_samp(score)', 'std')}, {r6('avg(score - ref)', 'delta')} FROM c JOIN b USING (agent) GROUP BY lab_id",
    "ev_first_reaching": f"{_CURVE}, c AS (SELECT lab_id, core_start, round(avg(score), 9) AS score FROM cv GROUP BY ALL), b AS (SELECT lab_id, max(score) AS best FROM c GROUP BY lab_id) SELECT lab_id, {r6('best', 'best')}, min(core_start) AS labels FROM c JOIN b USING (lab_id) WHERE score >= 0.9 * best GROUP BY lab_id, best",
    "ev_cross_labs": f"WITH {PROBA_SQL}, c AS (SELECT lab_id AS train, avg(list_max(p)) AS cut FROM proba GROUP BY 1), m AS (SELECT train, lab_id AS test, avg((list_max(p) > cut)::INT) AS score FROM proba, c GROUP BY ALL), g AS (SELECT train, avg(score) FILTER (WHERE train = test) AS own, avg(score) FILTER (WHERE train <> test) AS others FROM m GROUP BY train) SELECT train, {r6('own', 'own')}, {r6('others', 'others')}, {r6('own - others', 'gap')} FROM g",
    "ev_lab_thresholds": f"WITH {_EDGE}, s AS (SELECT video_id % 4 AS lab_id, edge, stddev_samp(length) / avg(length) AS sigma FROM edge GROUP BY ALL) SELECT lab_id, {r6('least(1.2, greatest(0.3, avg(3 * sigma)))', 'threshold')} FROM s GROUP BY lab_id",
    "ev_population": f"WITH {POSE_SQL}, l AS (" + " UNION ALL ".join(f"SELECT video_id, '{c}' AS feature, {c} AS x FROM pose" for c in ("nose_x", "tail_base_x")) + f") SELECT video_id, feature, count(*) AS frames, {r6('avg((x IS NOT NULL)::INT)', 'known')}, {r6('avg(x)', 'mean')}, {r6('stddev_samp(x)', 'std')}, {r6('min(x)', 'low')}, {r6('max(x)', 'high')} FROM l GROUP BY ALL",
    "ev_decision_grid": f"{_GRID} SELECT lab_id, mode, scale, mask, {r6('score', 'score')} FROM gs",
    "ev_best_setting": f"{_GRID} SELECT lab_id, mode, scale, mask, {r6('score', 'score')} FROM gs QUALIFY row_number() OVER (PARTITION BY lab_id ORDER BY round(score, 9) DESC, mode, scale, mask DESC) = 1",
    "pr_routed": f"WITH {_RT} SELECT window_id, target AS target_id FROM rt",
    "pr_predicted": "WITH iv AS (" + _RULES["dc_intervals"].replace(_DEC("p - t"), _RT).replace(" FROM dec WINDOW", " FROM rt WINDOW") + ") SELECT *, row_number() OVER (ORDER BY video_id, agent_id, target_id, start_frame, stop_frame, action) - 1 AS row_id FROM iv",
    "pr_features": f"WITH {_REL}, po AS (SELECT *, {_MID('', 'hip', 'x')} AS hips_x, {_MID('', 'hip', 'y')} AS hips_y FROM pose), ce AS (SELECT video_id, mouse_id, video_frame, sqrt(({_HALF('cx')}) ** 2 + ({_HALF('cy')}) ** 2) AS v FROM cen), mm AS (SELECT DISTINCT video_id, mouse_id FROM pose) SELECT ce.video_id, ce.mouse_id AS agent, o.mouse_id AS target, ce.video_frame, {rs('v', 'centroid_speed', 8)}, {rs(_angle_sql('nose', 'neck', 'hips'), 'neck_spine', 8)}, {rs(_DZSUM, 'dz_sum', 8)}, {rs('dist_centroid', 'dist_centroid', 8)}, {rs('min_kp_dist', 'min_kp_dist', 8)} FROM ce JOIN po USING (video_id, mouse_id, video_frame) LEFT JOIN mm AS o ON o.video_id = ce.video_id AND o.mouse_id <> ce.mouse_id LEFT JOIN rel ON rel.video_id = ce.video_id AND rel.agent = ce.mouse_id AND rel.target = o.mouse_id AND rel.video_frame = ce.video_frame",
    "pr_nodes": f"WITH {POSE_SQL}, v AS (SELECT video_id, mouse_id, video_frame, " + ", ".join(f"({_HALF(f'{k}_{a}')}) AS {k}_v{a}, ({_D2(f'{k}_{a}')}) AS {k}_a{a}" for k in KEYPOINTS for a in "xy") + " FROM pose) SELECT video_id, mouse_id, video_frame, 7::INT AS rows, 4::INT AS columns, " + rs(" + ".join(f"coalesce({k}_vx, 0) + coalesce({k}_vy, 0) + coalesce(sqrt({k}_vx ** 2 + {k}_vy ** 2), 0) + coalesce(sqrt({k}_ax ** 2 + {k}_ay ** 2), 0)" for k in KEYPOINTS), "total") + " FROM v",
    "mo_normalised_speeds": f"WITH {POSE_SQL}, s AS (SELECT video_id, {_NORM(_D1)} * 30 / 100 AS v FROM pose) SELECT video_id, count(v) AS n, {r6('avg(v)', 'mean')}, {r6('max(v)', 'most')} FROM s GROUP BY video_id",
    "mo_fidelity": f"WITH {POSE_SQL}, fi AS ({_FID('pose', 30.0)}) SELECT video_id, {', '.join(r6(c, c) for c in _FNAMES)} FROM fi",
    "mo_preservation": f"WITH {_SMOOTH}, b AS ({_FID('pose', 1.0)}), a AS ({_FID('sm', 1.0)}), l AS (" + " UNION ALL ".join(f"SELECT b.video_id, '{c}' AS metric, b.{c} AS before, a.{c} AS after FROM b JOIN a USING (video_id)" for c in _FNAMES) + f") SELECT video_id, metric, {r6('before', 'before')}, {r6('after', 'after')}, {r6('after / nullif(before, 0)', 'ratio')} FROM l",
    "mo_displaced": f"WITH {_SMOOTH}, l AS (" + " UNION ALL ".join(f"SELECT a.mouse_id, '{k}' AS keypoint, sqrt((a.{k}_x - b.{k}_x) ** 2 + (a.{k}_y - b.{k}_y) ** 2) AS e, a.{k}_x IS NULL AS was, b.{k}_x IS NULL AS gone FROM pose AS a JOIN sm AS b USING (video_id, mouse_id, video_frame)" for k in ("nose", "tail_base")) + f") SELECT mouse_id, keypoint, count(e) AS n, {r6('avg(e)', 'mean')}, {r6('max(e)', 'largest')}, {r6('avg((e > 5)::INT)', 'far')}, count_if(was AND NOT gone)::BIGINT AS filled, count_if(NOT was AND gone)::BIGINT AS lost FROM l GROUP BY ALL",
    "mo_similar_filled": f"WITH {POSE_SQL}, j AS (SELECT a.video_id, a.mouse_id, a.video_frame, b.video_frame AS other, b.tail_base_x AS t, round((a.nose_x ** 2 + a.nose_y ** 2 + (b.nose_x ** 2 + b.nose_y ** 2) - 2 * (a.nose_x * b.nose_x + a.nose_y * b.nose_y)) * 3 / 2, 6) AS far FROM pose AS a JOIN pose AS b ON a.video_id = b.video_id AND a.mouse_id = b.mouse_id WHERE a.tail_base_x IS NULL AND b.tail_base_x IS NOT NULL), k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY video_id, mouse_id, video_frame ORDER BY greatest(far, 0), other) <= 5) SELECT video_id, mouse_id, video_frame, {r6('avg(t)', 'tail_base_x')} FROM k GROUP BY ALL",
    "mo_corruptions": f"WITH {POSE_SQL}, {_BURST} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count_if(n <> nose_x OR e <> ear_left_x)::BIGINT AS moved, {r6('avg(abs(n - nose_x))', 'nose')}, {r6('avg(abs(e - ear_left_x))', 'ear')} FROM (SELECT nose_x, ear_left_x, {a} AS n, {b} AS e FROM q)" for k, (a, b) in _HITS.items()),
    "mo_recovery": f"WITH {POSE_SQL}, c AS (SELECT *, " + ", ".join(f"CASE WHEN {_U('0spikenose')} < 0.03 THEN nose_{a} + 60.0 * {f}(2 * pi() * {_U('0turnnose')}) ELSE nose_{a} END AS c{a}" for a, f in (("x", "cos"), ("y", "sin"))) + " FROM pose), m AS (SELECT *, " + ", ".join(f"median(c{a}) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m{a}" for a in "xy") + f" FROM c), g AS (SELECT video_id, sqrt(avg((nose_x - cx) ** 2 + (nose_y - cy) ** 2)) AS b, sqrt(avg((nose_x - mx) ** 2 + (nose_y - my) ** 2)) AS a FROM m GROUP BY video_id) SELECT video_id, 'nose' AS keypoint, {r6('b', 'before')}, {r6('a', 'after')}, {r6('1 - a / nullif(b, 0)', 'recovered')} FROM g",
    "id_huddles": f"WITH {POSE_SQL}, c AS (SELECT video_id, video_frame, mouse_id, {_MID('', 'neck_tail', 'x').replace('neck_tail_left', 'neck').replace('neck_tail_right', 'tail_base')} AS x, {_MID('', 'neck_tail', 'y').replace('neck_tail_left', 'neck').replace('neck_tail_right', 'tail_base')} AS y FROM pose), w AS (SELECT video_id, video_frame, " + ", ".join(f"any_value({a}) FILTER (WHERE mouse_id = {i}) AS {a}{i}" for i in (1, 2) for a in "xy") + " FROM c GROUP BY ALL), m AS (SELECT *, " + ", ".join(f"{_MED(c, '12 PRECEDING', '1 PRECEDING')} AS b{c}, {_MED(c, '1 FOLLOWING', '12 FOLLOWING')} AS a{c}" for c in _FOUR) + ", coalesce(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) < 6, false) AS h FROM w), r AS (SELECT *, h <> lag(h) OVER (PARTITION BY video_id ORDER BY video_frame) AS ch FROM m), n AS (SELECT *, sum(coalesce(ch, true)::INT) OVER (PARTITION BY video_id ORDER BY video_frame) AS run FROM r), g AS (SELECT video_id, run, min(video_frame) AS first, max(video_frame) AS last, " + ", ".join(f"arg_min_null(b{c}, video_frame) AS b{c}, arg_max_null(a{c}, video_frame) AS a{c}" for c in _FOUR) + f" FROM n WHERE h GROUP BY video_id, run HAVING count(*) <= 60), z AS (SELECT video_id, first, last, sqrt((bx1 - ax1) ** 2 + (by1 - ay1) ** 2) + sqrt((bx2 - ax2) ** 2 + (by2 - ay2) ** 2) AS stay, sqrt((bx1 - ax2) ** 2 + (by1 - ay2) ** 2) + sqrt((bx2 - ax1) ** 2 + (by2 - ay1) ** 2) AS \"cross\" FROM g) SELECT video_id, first, last, {r6('stay', 'stay')}, {r6('\"cross\"', '\"cross\"')}, coalesce(stay > 1.15 * \"cross\", false) AS inverted FROM z",
    "se_collinear_pairs": f"WITH {POSE_SQL}, r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM pose" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]) + f") SELECT a, b, {r6('r', 'r')} FROM r WHERE abs(r) > 0.9",
    "se_mutual_information": f"WITH {POSE_SQL}, yl AS (SELECT *, (nose_x > 25)::INT + (nose_y > 30)::INT AS y FROM pose), e AS (SELECT " + ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in _COLS) + " FROM pose), l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, y, coalesce(least(floor(({c} - a_{c}) / nullif(b_{c} - a_{c}, 0) * 16), 15), -1) AS bin FROM yl, e" for c in _COLS) + f"), n AS (SELECT col, bin, y, count(*)::DOUBLE AS n FROM l GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY col) AS t, sum(n) OVER (PARTITION BY col, bin) AS nb, sum(n) OVER (PARTITION BY col, y) AS ny FROM n) SELECT col AS \"column\", {r6('sum(n / t * ln(n * t / (nb * ny)))', 'mi')} FROM s GROUP BY col",
    "se_drift": f"WITH {POSE_SQL}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, video_id AS g, coalesce({c}, 0)::DOUBLE AS x FROM pose" for c in _COLS) + f"), g AS (SELECT col, g, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY ALL), h AS (SELECT *, sum(n * m) OVER (PARTITION BY col) / sum(n) OVER (PARTITION BY col) AS grand FROM g) SELECT col AS \"column\", {r6('(sum(n * (m - grand) ** 2) / (count(*) - 1)) / greatest(sum(n * v) / greatest(sum(n) - count(*), 1), 1e-12)', 'drift')} FROM h GROUP BY col",
    "se_percentiles": f"WITH {POSE_SQL}, l AS (" + " UNION ALL ".join(f"SELECT mouse_id, '{c}' AS col, {c}::DOUBLE AS x FROM pose" for c in ("nose_x", "nose_y", "tail_base_x")) + f") SELECT mouse_id, col AS \"column\", count(x) AS n, {', '.join(r6(f'quantile_cont(x, {q})', n) for q, n in ((0.0, 'p0'), (0.05, 'p5'), (0.5, 'p50'), (0.99, 'p99')))} FROM l GROUP BY ALL",
}
