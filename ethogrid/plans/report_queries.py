"""Queries on reports, bundles, learning cycles and the remaining scalar functions, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import signal as Sg
from ..operators import active as A
from ..operators import frames as P
from ..operators import intervals as I
from ..operators import models as M
from ..operators import quality as Q
from ..operators import sequence as S
from ..operators import stats as T
from ..session import shared_folder
from ..sources.adapters import POSE_SQL, PROBA_LONG_SQL, PROBA_SQL, pose, proba, proba_long
from .frame_queries import W, r4, rs
from .interval_queries import SCORE_SQL, _active, _solution, _submission
from .model_queries import COLUMNS, _features, _windows
from .quality_queries import _EDGE, _FLAGS, _SEVERITY, REFS

r6 = lambda e, n: rs(e, n, 6)


def rp_lab_condition_pivot(spark, d):
    """Scores by lab and condition (all predictions, or those of one kind), and their spread."""
    sol, act = _solution(spark, d), _active(spark, d)
    runs = {"whole": _submission(spark, d), "half": _submission(spark, d).where("start_frame % 2 = 0")}
    s = [I.lab_scores(sol, r, act).withColumn("condition", F.lit(k)) for k, r in runs.items()]
    p = s[0].unionByName(s[1]).groupBy("lab_id").pivot("condition", list(runs)).agg(F.first("score"))
    return r4(p.withColumn("spread", F.greatest(*runs) - F.least(*runs)), 6)


def rp_best_arm(spark, d):
    """The run with the best score of each lab; the base run wins ties."""
    sol, act = _solution(spark, d), _active(spark, d)
    runs = [(_submission(spark, d), 0), (_submission(spark, d).where("start_frame % 2 = 0"), 1), (_submission(spark, d).where("action <> 'view'"), 2)]
    s = [I.lab_scores(sol, r, act).withColumn("run", F.lit(k)) for r, k in runs]
    every = s[0].unionByName(s[1]).unionByName(s[2]).withColumn("score", F.round("score", 6))
    return every.groupBy("lab_id").agg(F.max_by("run", F.struct("score", -F.col("run"))).alias("run"), F.max("score").alias("score"))


def rp_action_overlap(spark, d):
    """Actions that two labs share."""
    a = _solution(spark, d).where("duration_frames % 7 > 3 OR lab_id <> 2 OR action <> 'error'").groupBy("lab_id").agg(F.collect_set("action").alias("s"))
    b = a.select(F.col("lab_id").alias("other"), F.col("s").alias("t"))
    j = a.join(b, F.col("lab_id") < F.col("other"))  # labs are a handful of rows
    return j.select("lab_id", "other", F.size(F.array_intersect("s", "t")).alias("shared"))


def rp_coverage(spark, d):
    """Windows and distinct videos per lab."""
    return proba(spark, d).groupBy("lab_id").agg(F.count("*").alias("windows"), F.count_distinct("video_id").alias("videos"), F.max("core_stop").alias("coverage"))


def rp_prevalence_thresholds(spark, d):
    """Per lab and class the grid threshold whose predicted number is nearest, in log1p, to the number of true windows."""
    p = proba_long(proba(spark, d))
    grid = p.withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.08, 0.1, 0.12, 0.15, 0.2)])))
    g = grid.groupBy("lab_id", "cls", "t").agg(F.count_if(F.col("p") > F.col("t")).alias("pred"), F.count_if(F.col("y") == F.col("cls")).alias("true"))
    g = g.withColumn("gap", F.round(F.abs(F.log1p("pred") - F.log1p("true")), 9))
    w = Window.partitionBy("lab_id", "cls").orderBy("gap", "t")
    return g.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("lab_id", "cls", "t", "pred", "true")


def rp_irreducible_floor(spark, d):
    """Share of violations that noise alone explains: 2 P(Z > threshold / sigma), per edge."""
    e = Q.edge_lengths(pose(spark, d), "mouse_id").groupBy("edge").agg((F.stddev_samp("length") / F.avg("length")).alias("sigma"))
    return r4(e.select("edge", "sigma", G.normal_tail(0.25 / F.col("sigma")).alias("floor")), 6)


def fn_edge_weights(spark, d):
    return r4(T.edge_weights(Q.edge_lengths(pose(spark, d), "mouse_id")), 6)


def fn_min_max(spark, d):
    m = pose(spark, d).groupBy("video_id", "mouse_id").agg(F.avg("nose_x").alias("x"))
    return r4(m.select("video_id", "mouse_id", T.min_max("x", "mouse_id").alias("x")), 6)


def fn_confidence(spark, d):
    o = Q.outliers(pose(spark, d), "tail_base", ("hip_left", "tail_base"), REFS)
    return r4(o.groupBy("video_id").agg(F.avg(G.clipped_confidence(F.col("severity"), 1.0)).alias("confidence")), 6)


def fn_interp_grid(spark, d):
    """Mean noses by spells of 25 frames, over all frames, read off at a grid."""
    c = pose(spark, d).groupBy("mouse_id", F.floor(F.col("video_frame") / 25).alias("spell")).agg(F.avg("nose_x").alias("x"))
    return r4(T.on_grid(c, "spell", "x", [0, 0.5, 1.25, 3, 4.75, 1e6], "mouse_id"), 6)


def fn_curvature(spark, d):
    """Curvature of the nose's path, |v x a| / |v|^3, per mouse: number, mean and median."""
    w = P.by_mouse()
    p = pose(spark, d).select("video_id", "mouse_id", *[f("nose_" + a, w).alias(n + a) for a in "xy" for n, f in (("v", Sg.half_difference), ("a", Sg.second_difference))])
    k = F.try_divide(F.abs(F.col("vx") * F.col("ay") - F.col("vy") * F.col("ax")), F.pow(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"), F.lit(1.5)))
    return r4(p.withColumn("k", k).groupBy("video_id", "mouse_id").agg(F.count("k").alias("n"), F.percentile("k", F.lit(0.5)).alias("median")), 6)


def fn_identity_runs(spark, d):
    """Runs of two frames or more in which the crossed assignment of two mice is nearer to their last places, of all pairs
    of a video's mice."""
    pair = ["video_id", "a", "b"]
    x = P.paired(pose(spark, d), ["neck_x", "neck_y"]).toDF(*pair, "video_frame", "1_x", "1_y", "2_x", "2_y")
    x = x.where("`1_x` IS NOT NULL AND `2_x` IS NOT NULL")
    w = Window.partitionBy(*pair).orderBy("video_frame")
    far = lambda a, b: G.distance(f"{a}_x", f"{a}_y", F.lag(f"{b}_x").over(w), F.lag(f"{b}_y").over(w))
    x = x.withColumn("crossed", F.coalesce(far(1, 1) + far(2, 2) > far(1, 2) + far(2, 1), F.lit(False)))
    x = x.withColumn("run", Sg.run_id(F.col("crossed") != F.lag("crossed").over(w), w))
    runs = x.where("crossed").groupBy(*pair, "run").agg(F.count("*").alias("n")).where("n >= 2")
    return runs.groupBy("video_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


def fn_recovery(spark, d):
    """Frames from a missing tail to the next frame that has one, within 50: mean and share recovered."""
    w = P.by_mouse()
    t = pose(spark, d).select("video_id", "mouse_id", "video_frame", F.col("tail_base_x").alias("x"))
    nxt = F.first(F.when(F.col("x").isNotNull(), F.col("video_frame")), ignorenulls=True).over(w.rowsBetween(1, 50))
    g = t.withColumn("lag", nxt - F.col("video_frame")).where("x IS NULL")
    return r4(g.groupBy("video_id").agg(F.count("*").alias("gaps"), F.avg("lag").alias("mean_lag"), F.avg(F.col("lag").isNotNull().cast("int")).alias("recovered")), 6)


def fn_vector_distances(spark, d):
    """Cosine and Euclidean distances of probabilities to those of the first window of their video."""
    p = proba(spark, d).select("video_id", "window_id", "p")
    first = p.groupBy("video_id").agg(F.min_by("p", "window_id").alias("q"))
    j = p.join(first, "video_id")
    return r4(j.select("window_id", G.cosine_distance(F.col("p"), F.col("q")).alias("cosine"), G.euclidean_distance(F.col("p"), F.col("q")).alias("euclidean")), 6)


def fn_vif(spark, d):
    return r4(T.vif(pose(spark, d), ["nose_x", "nose_y", "tail_base_x", "tail_base_y"]), 4)


def fn_spline_fill(spark, d):
    f = S.spline_filled(pose(spark, d).select("video_id", "mouse_id", "video_frame", "tail_base_x", "tail_base_y"), ["tail_base_x", "tail_base_y"])
    return r4(f.groupBy("video_id", "mouse_id").agg(F.count("tail_base_x").alias("n"), F.sum("tail_base_x").alias("s"), F.min("tail_base_x").alias("low"), F.max("tail_base_x").alias("high")))


def ml_bundle(spark, d):
    """A fitted forest written, read again and applied."""
    f = _features(spark, d)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    M.forest(10, 5).fit(M.weighted(f)).write().overwrite().save(path)
    back = RandomForestClassificationModel.load(path)
    return back.transform(f).groupBy("fold", F.col("prediction").cast("int").alias("pred")).agg(F.count("*").alias("n"))


def ml_learning_cycle(spark, d):
    """Three rounds of a forest that asks for the windows it is least sure of, and one that asks at random; both are fitted
    anew each round and scored on the videos of fold 0."""
    w = _windows(spark, d).withColumn("id", F.xxhash64("video_id", "mouse_id", "win"))
    runs = [A.cycle(w, COLUMNS, "y", F.col("fold") == 0, 10, 20, 3, k, M.forest(5, 4), "id", 0.0).withColumn("strategy", F.lit(k)) for k in ("margin", "random")]
    return r4(runs[0].unionByName(runs[1]), 6)


QUERIES = {k: v for k, v in globals().items() if k[:3] in ("rp_", "fn_") or k in ("ml_bundle", "ml_learning_cycle")}

_ARM = lambda cond, run: f"SELECT lab_id, {run} AS run, avg(coalesce(2.0 * tp / nullif(2 * tp + fn + fp, 0), 0)) AS s FROM (SELECT lab_id, action, count_if(a IS NOT NULL AND b IS NOT NULL) AS tp, count_if(b IS NULL) AS fn, count_if(a IS NULL) AS fp FROM (SELECT coalesce(l.lab_id, p.lab_id) AS lab_id, coalesce(l.action, p.action) AS action, l.fr AS a, p.fr AS b FROM lf AS l FULL JOIN (SELECT DISTINCT lab_id, video_id, agent_id, target_id, action, unnest(range(start_frame, stop_frame)) AS fr FROM (SELECT * FROM sub WHERE {cond}) SEMI JOIN active USING (video_id, agent_id, target_id, action) JOIN (SELECT DISTINCT lab_id, video_id FROM sol) USING (video_id)) AS p ON l.lab_id = p.lab_id AND l.video_id = p.video_id AND l.agent_id = p.agent_id AND l.target_id = p.target_id AND l.action = p.action AND l.fr = p.fr) SEMI JOIN sol USING (lab_id, action) GROUP BY ALL) GROUP BY lab_id"
_H = lambda c: f"(lead({c}) {W} - lag({c}) {W}) / 2"
_S2 = lambda c: f"(lead({c}) {W} - 2 * {c} + lag({c}) {W})"
_V4 = ("nose_x", "nose_y", "tail_base_x", "tail_base_y")


def _det(at: tuple[int, ...], columns: tuple[int, ...] | None = None) -> str:
    """The determinant of the correlations r<i><j> at these rows and columns, by its first row."""
    columns = at if columns is None else columns
    cell = lambda i, j: "1.0::DOUBLE" if i == j else f"r{min(i, j)}{max(i, j)}"
    if len(at) == 1:
        return cell(at[0], columns[0])
    parts = [f"{'-' if k % 2 else '+'} {cell(at[0], j)} * ({_det(at[1:], columns[:k] + columns[k + 1 :])})" for k, j in enumerate(columns)]
    return "(" + " ".join(parts).removeprefix("+ ") + ")"


SQL = {
    "rp_lab_condition_pivot": f"WITH {SCORE_SQL}, w AS ({_ARM('true', 0)}), h AS ({_ARM('start_frame % 2 = 0', 1)}) SELECT lab_id, {r6('w.s', 'whole')}, {r6('h.s', 'half')}, {r6('abs(w.s - h.s)', 'spread')} FROM w JOIN h USING (lab_id)",
    "rp_best_arm": f"WITH {SCORE_SQL}, u AS ({_ARM('true', 0)} UNION ALL {_ARM('start_frame % 2 = 0', 1)} UNION ALL {_ARM(chr(97) + 'ction <> ' + chr(39) + 'view' + chr(39), 2)}) SELECT lab_id, run, round(s, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY lab_id ORDER BY round(s, 6) DESC, run) = 1",
    "rp_action_overlap": f"WITH {SCORE_SQL}, s AS (SELECT DISTINCT lab_id, action FROM sol WHERE duration_frames % 7 > 3 OR lab_id <> 2 OR action <> 'error') SELECT a.lab_id, b.lab_id AS other, count(*)::INT AS shared FROM s AS a JOIN s AS b ON a.action = b.action AND a.lab_id < b.lab_id GROUP BY ALL",
    "rp_coverage": f"WITH {PROBA_SQL} SELECT lab_id, count(*) AS windows, count(DISTINCT video_id) AS videos, max(core_stop) AS coverage FROM proba GROUP BY lab_id",
    "rp_prevalence_thresholds": f"WITH {PROBA_LONG_SQL}, g AS (SELECT lab_id, cls, t, count_if(p > t) AS pred, count_if(y = cls) AS \"true\" FROM pl, (SELECT unnest([0.05, 0.08, 0.1, 0.12, 0.15, 0.2])::DOUBLE AS t) GROUP BY ALL) SELECT lab_id, cls, t, pred::BIGINT AS pred, \"true\"::BIGINT AS \"true\" FROM g QUALIFY row_number() OVER (PARTITION BY lab_id, cls ORDER BY round(abs(ln(1 + pred) - ln(1 + \"true\")), 9), t) = 1",
    "rp_irreducible_floor": f"WITH {_EDGE}, s AS (SELECT edge, stddev_samp(length) / avg(length) AS sigma FROM edge GROUP BY edge), x AS (SELECT *, 0.25 / sigma / sqrt(2.0) AS x FROM s), t AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM x) SELECT edge, {r6('sigma', 'sigma')}, {r6('t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)', 'floor')} FROM t",
    "fn_confidence": f"WITH {_FLAGS} SELECT video_id, {r6(f'avg(greatest(0.05, least(1.0, exp(-({_SEVERITY})))))', 'confidence')} FROM f2 GROUP BY video_id",
    "fn_vector_distances": f"WITH {PROBA_SQL}, q AS (SELECT video_id, arg_min(p, window_id) AS q FROM proba GROUP BY video_id) SELECT window_id, {r6('1 - list_sum(list_transform(range(1, 11), lambda i: p[i] * q[i])) / (sqrt(list_sum(list_transform(p, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))', 'cosine')}, {r6('sqrt(list_sum(list_transform(range(1, 11), lambda i: (p[i] - q[i]) * (p[i] - q[i]))))', 'euclidean')} FROM proba JOIN q USING (video_id)",
    "fn_vif": f"WITH {POSE_SQL}, r AS (SELECT " + ", ".join(f"coalesce(corr({_V4[i]}, {_V4[j]}), 0) AS r{i}{j}" for i in range(4) for j in range(i + 1, 4)) + " FROM pose), d AS (SELECT *, " + f"{_det((0, 1, 2, 3))} AS d FROM r) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {rs(_det(tuple(k for k in range(4) if k != i)) + ' / d', 'vif')} FROM d" for i, c in enumerate(_V4)),
    "fn_edge_weights": f"WITH {_EDGE}, v AS (SELECT edge, 1 / var_samp(length) AS inv FROM edge GROUP BY edge HAVING var_samp(length) > 0) SELECT edge, {r6('least(5.0, greatest(0.2, inv / (SELECT median(inv) FROM v)))', 'weight')} FROM v",
    "fn_min_max": f"WITH {POSE_SQL}, m AS (SELECT video_id, mouse_id, avg(nose_x) AS x FROM pose GROUP BY ALL) SELECT video_id, mouse_id, {r6('CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0.5 END', 'x')} FROM m WINDOW w AS (PARTITION BY mouse_id)",
    "fn_interp_grid": f"WITH {POSE_SQL}, c AS (SELECT mouse_id, video_frame // 25 AS f, avg(nose_x) AS x FROM pose GROUP BY ALL), q AS (SELECT m.mouse_id, g, (SELECT max(f) FROM c WHERE c.mouse_id = m.mouse_id AND f <= g) AS f0, (SELECT min(f) FROM c WHERE c.mouse_id = m.mouse_id AND f > g) AS f1 FROM (SELECT DISTINCT mouse_id FROM c) AS m, (SELECT unnest([0, 0.5, 1.25, 3, 4.75, 1e6])::DOUBLE AS g)) SELECT q.mouse_id, g, {r6('CASE WHEN a.x IS NULL THEN b.x WHEN b.x IS NULL THEN a.x ELSE a.x + (b.x - a.x) * (g - f0) / (f1 - f0) END', 'y')} FROM q LEFT JOIN c AS a ON a.mouse_id = q.mouse_id AND a.f = f0 LEFT JOIN c AS b ON b.mouse_id = q.mouse_id AND b.f = f1",
    "fn_curvature": f"WITH {POSE_SQL}, v AS (SELECT video_id, mouse_id, {_H('nose_x')} AS vx, {_H('nose_y')} AS vy, {_S2('nose_x')} AS ax, {_S2('nose_y')} AS ay FROM pose), k AS (SELECT video_id, mouse_id, abs(vx * ay - vy * ax) / nullif(pow(vx * vx + vy * vy, 1.5), 0) AS k FROM v) SELECT video_id, mouse_id, count(k) AS n, {r6('quantile_cont(k, 0.5)', 'median')} FROM k GROUP BY ALL",
    "fn_identity_runs": f"WITH {POSE_SQL}, p AS (SELECT a.video_id, a.video_frame, a.neck_x AS x1, a.neck_y AS y1, b.neck_x AS x2, b.neck_y AS y2 FROM pose AS a JOIN pose AS b ON a.video_id = b.video_id AND a.video_frame = b.video_frame AND a.mouse_id = 1 AND b.mouse_id = 2), c AS (SELECT video_id, video_frame, coalesce(sqrt((x1 - lag(x1) OVER w) ** 2 + (y1 - lag(y1) OVER w) ** 2) + sqrt((x2 - lag(x2) OVER w) ** 2 + (y2 - lag(y2) OVER w) ** 2) > sqrt((x1 - lag(x2) OVER w) ** 2 + (y1 - lag(y2) OVER w) ** 2) + sqrt((x2 - lag(x1) OVER w) ** 2 + (y2 - lag(y1) OVER w) ** 2), false) AS c FROM p WINDOW w AS (PARTITION BY video_id ORDER BY video_frame)), g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY video_frame) - row_number() OVER (PARTITION BY video_id, c ORDER BY video_frame) AS k FROM c), r AS (SELECT video_id, k, count(*) AS n FROM g WHERE c GROUP BY ALL HAVING count(*) >= 2) SELECT video_id, count(*) AS runs, max(n) AS longest FROM r GROUP BY video_id",
    "fn_recovery": f"WITH {POSE_SQL}, t AS (SELECT video_id, tail_base_x AS x, min(CASE WHEN tail_base_x IS NOT NULL THEN video_frame END) OVER (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING) - video_frame AS lag FROM pose) SELECT video_id, count(*) AS gaps, {r6('avg(lag)', 'mean_lag')}, {r6('avg((lag IS NOT NULL)::INT)', 'recovered')} FROM t WHERE x IS NULL GROUP BY video_id",
}
