"""Queries on sequences, models and streams, and their SQL where it can say them."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import active as A
from ..operators import decide as D
from ..operators import frames as P
from ..operators import intervals as I
from ..operators import models as M
from ..operators import quality as Q
from ..operators import sequence as S
from ..operators import windows as Wn
from ..session import shared_folder, unbroadcast, written
from ..sources.adapters import KEYPOINTS, POSE_SQL, PROBA_SQL, ann, pose, proba, proba_long
from ..streaming import online
from .frame_queries import r4, rs
from .quality_queries import _ACT, SQL as _RULES, _active, _thresholds

UNIT = 40.0


def _labels(spark, d):
    return proba(spark, d).select("video_id", "agent", "window_id", "core_start", F.col("y").cast("int").alias("cls"))


def _decoding(spark, d):
    """Windows with arrays of p, thresholds and permissions."""
    m = D.active_mask(proba_long(proba(spark, d)), _active(spark, d)).join(_thresholds(spark, d), ["lab_id", "cls"])
    g = m.groupBy("video_id", "agent", "window_id", "core_start").agg(F.sort_array(F.collect_list(F.struct("cls", "p", "t", (F.col("allowed") | (F.col("cls") == 0)).alias("allowed")))).alias("x"))
    return g.select("video_id", "agent", "window_id", "core_start", F.col("x.p").alias("p"), F.col("x.t").alias("t"), F.col("x.allowed").alias("allowed"))


def sq_transition_log_probs(spark, d):
    return r4(S.transition_log_probs(_labels(spark, d), ["video_id", "agent"], ["core_start", "window_id"], 10), 6)


def sq_viterbi(spark, d):
    trans = S.transition_log_probs(_labels(spark, d), ["video_id", "agent"], ["core_start", "window_id"], 10)
    return S.viterbi(_decoding(spark, d), trans, 10)


def sq_viterbi_uniform(spark, d):
    """With equal transitions each window gets its best allowed ratio p / t."""
    even = spark.range(100).select((F.col("id") / 10).cast("int").alias("a"), (F.col("id") % 10).cast("int").alias("b"), F.lit(-2.302585092994046).alias("lp"))
    return S.viterbi(_decoding(spark, d), even, 10)


def sq_swaps(spark, d):
    return S.swap_flags(pose(spark, d)).groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if("swapped").alias("swapped"))


def sq_spectra(spark, d):
    return r4(S.spectral_metrics(pose(spark, d), "nose_x"))


def sq_corrected(spark, d):
    """Edge violations before and after the joint correction, per edge."""
    p = P.without_zero_frames(pose(spark, d))
    c = S.corrected(p, KEYPOINTS, UNIT)
    refs = spark.createDataFrame([(f"{a}→{b}", n * UNIT) for (a, b), n in zip(G.EDGES, G.DEFAULT_LENGTHS)], "edge string, l_ref double")
    v = [Q.violation_rate(Q.edge_lengths(x), refs, 0.25).withColumnRenamed("violation_rate", n) for x, n in ((p, "before"), (c, "after"))]
    return r4(v[0].join(v[1], "edge"))


def sq_tuned_thresholds(spark, d):
    return r4(S.tuned_thresholds(proba_long(proba(spark, d))))


def _windows(spark, d):
    """Window statistics; the class is what the intervals say of the window: nothing (0), an action towards the other mouse
    (1) or one at itself (2), by the more frames."""
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", "nose_x", "nose_y", "tail_base_x")
    keys = ["video_id", "mouse_id", "win"]
    s = Wn.statistics(Wn.members(p, ["video_id", "mouse_id"], 32, 32), keys, ["nose_x", "nose_y", "tail_base_x"])
    n = _frames_by_window(ann(spark, d), 32)
    y = F.when(F.col("_own") > F.col("_other"), 2.0).when(F.col("_other") > 0, 1.0).otherwise(0.0)
    return s.join(unbroadcast(n), keys, "left").withColumn("y", y).drop("_own", "_other").withColumn("fold", (F.col("video_id") % 3).cast("int"))


def _frames_by_window(a, size):
    """video_id, mouse_id, win, and the frames from 0 on that intervals towards the mouse itself (_own) and another one
    (_other) cover in it, counted from the intervals' ends."""
    a = a.withColumn("start_frame", F.greatest("start_frame", F.lit(0).cast("long"))).where("stop_frame > start_frame")
    a = a.withColumn("win", F.explode(F.sequence(F.floor(F.col("start_frame") / size), F.floor((F.col("stop_frame") - 1) / size))))
    n = F.least(F.col("stop_frame"), (F.col("win") + 1) * size) - F.greatest(F.col("start_frame"), F.col("win") * size)
    own = F.col("agent_id") == F.col("target_id")
    return a.groupBy("video_id", F.col("agent_id").alias("mouse_id"), "win").agg(F.sum(F.when(own, n).otherwise(0)).alias("_own"), F.sum(F.when(~own, n).otherwise(0)).alias("_other"))


COLUMNS = ["nose_x_mean", "nose_x_std", "nose_y_mean", "nose_y_std", "tail_base_x_mean", "tail_base_x_iqr"]


def _features(spark, d):
    """Vectors; gaps get the means of the folds 1 and 2."""
    w = written(_windows(spark, d), "windows")  # a forest reads them many times
    return M.assembled(w, COLUMNS, train=w.where("fold <> 0"))


def _left_out(spark, d, model):
    w = written(_windows(spark, d), "windows")
    rows = [M.left_out(w, COLUMNS, "fold", k, model).select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred")) for k in range(3)]
    return D.class_report(rows[0].unionByName(rows[1]).unionByName(rows[2]))


def ml_forest_left_out(spark, d):
    """Report of forests that each predict the videos left out of them."""
    return r4(_left_out(spark, d, M.forest(20, 6)))


def ml_boosted(spark, d):
    """Report of boosted trees that each predict the videos left out of them."""
    return r4(_left_out(spark, d, M.boosted(5)))


def ml_svm(spark, d):
    """Report of calibrated linear machines on the videos of fold 0, which they do not see."""
    w = written(_windows(spark, d), "windows")
    p = M.calibrated_svm(w.where("fold <> 0"), w.where("fold = 0"), COLUMNS, [0.0, 1.0, 2.0], F.col("fold") == 1)
    return r4(D.class_report(p.select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))))


def ml_feature_sets(spark, d):
    """Macro F1 over left-out videos with all columns and with those of the nose."""
    w = written(_windows(spark, d), "windows")
    out = None
    for name, columns in (("all", COLUMNS), ("nose", COLUMNS[:4])):
        rows = [M.left_out(w, columns, "fold", k, M.forest(8, 4)).select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred")) for k in range(3)]
        s = D.summary(D.class_report(rows[0].unionByName(rows[1]).unionByName(rows[2]))).withColumn("columns", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return r4(out)


def ml_per_lab(spark, d):
    """Reports of models fitted per lab; labs with too few rows of a class use the model of all."""
    w = _windows(spark, d).withColumn("lab_id", F.col("video_id") % 2)
    return M.per_group(w, COLUMNS, "lab_id", "fold", M.forest(5, 4)).groupBy("lab_id", "fallback").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("y")).alias("right"))


def ml_importances(spark, d):
    return r4(M.importances(_windows(spark, d), COLUMNS, M.forest(10, 5)), 6)


def ml_permuted(spark, d):
    return r4(M.permuted_importances(written(_windows(spark, d), "windows"), COLUMNS, F.col("fold") == 0, M.forest(5, 4)), 6)


def ml_resampled(spark, d):
    """Windows drawn by the balanced weight of their class."""
    p = proba(spark, d).select("window_id", "y")
    return M.resampled(p.join(F.broadcast(D.class_weights(p).select("y", "balanced")), "y"), "balanced", "window_id").groupBy("y").agg(F.count("*").alias("n"))  # one row a class


def ml_quantile_scaled(spark, d):
    w = _windows(spark, d).select("video_id", "mouse_id", "win", "fold", "nose_x_mean", "nose_y_mean")
    return r4(M.quantile_scaled(w.where("fold <> 0"), w, ["nose_x_mean", "nose_y_mean"]).drop("fold"), 3)


def ml_random_batch(spark, d):
    p = proba(spark, d)
    return A.random_batch(p, p.where("array_max(p) > 0.3"), 25)


def ml_combined_batch(spark, d):
    p = proba(spark, d)
    counts = p.groupBy(F.col("y").alias("cls")).agg(F.count("*").alias("n"))
    return r4(A.combined_batch(p, p.where("array_max(p) > 0.3"), counts, 25, F.get("p", F.lit(0)) < 0.1), 6)


def ml_hybrid_batch(spark, d):
    p = proba(spark, d)
    return A.hybrid_batch(p, p.where("array_max(p) > 0.3"), 10, "p")


def ml_gradient_batch(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("window_id"), F.slice("embedding", 1, 8).alias("h"))
    p = proba(spark, d).join(e, "window_id")
    return A.gradient_batch(p, p.where("array_max(p) > 0.3"), 6, "h")


def ml_oracle(spark, d):
    """An oracle's answers to the 25 least sure windows, 10 at most."""
    p = proba(spark, d)
    known = p.where("array_max(p) > 0.3")
    return A.revealed(p.select("window_id", "y"), M.query_batch(p, known, 25, "entropy"), known, 10)


def ml_scaled(spark, d):
    f = _features(spark, d)
    s = M.scaled(f.where("fold <> 0"), f)
    return r4(s.select("video_id", "mouse_id", "win", F.get(vector_to_array("scaled"), F.lit(0)).alias("x")))


def ml_pca(spark, d):
    f = _features(spark, d)
    return M.projected(f, 2).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.get("pca", F.lit(0)))), 3).alias("m"))


def ml_query_entropy(spark, d):
    p = proba(spark, d)
    return M.query_batch(p, p.where("window_id % 5 = 0"), 25, "entropy")


def ml_query_margin(spark, d):
    p = proba(spark, d)
    return M.query_batch(p, p.where("window_id % 5 = 0"), 25, "margin")


def _members(spark, d):
    """Three members: the probabilities, and two softened forms of them."""
    p = proba(spark, d).select("window_id", "p")
    soft = lambda k: p.select("window_id", F.transform("p", lambda v: (v + k) / (1 + 10 * k)).alias("p"))
    return p.unionByName(soft(0.1)).unionByName(soft(0.5))


def ml_bald(spark, d):
    return r4(M.bald(_members(spark, d), "window_id"), 6)


def ml_scheduled_batch(spark, d):
    """What the last round before the switch asks for, and the first one after it, when the first answers are known."""
    p = proba(spark, d)
    known = p.where("array_max(p) > 0.3")
    early = written(A.scheduled_batch(p, _members(spark, d), known, 15, 2), "early")
    late = A.scheduled_batch(p, _members(spark, d), known.select("window_id").unionByName(early.select("window_id")), 15, 3)
    return early.withColumn("round", F.lit(2)).unionByName(late.withColumn("round", F.lit(3)))


def ml_seed_set(spark, d):
    return M.seed_set(proba(spark, d).select("window_id", "y"), 5)


def ml_k_center(spark, d):
    return M.k_center(proba(spark, d), 6, "p", "window_id", 0)


def _stream(spark, d):
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d)


def _ran(spark, df):
    """The stream run over all that is there, into the shared folder, in append mode."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def sm_hourly_rates(spark, d):
    return r4(_ran(spark, online.windowed_rates(_stream(spark, d), "ts", ["event_type"])))


def sm_sessions(spark, d):
    return _ran(spark, online.sessions(_stream(spark, d), "ts", ["user_id"], "6 hours"))


QUERIES = {k: v for k, v in globals().items() if k[:3] in ("sq_", "ml_", "sm_")}
_ENT = "round(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-12))), 6)"
_LP = "n AS (SELECT y AS a, lead(y) OVER (PARTITION BY video_id, agent ORDER BY core_start, window_id) AS b FROM proba), c AS (SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY ALL), g AS (SELECT x.a, y.b, coalesce(n, 0) + 1.0 AS n FROM (SELECT unnest(range(0, 10))::INT AS a) AS x, (SELECT unnest(range(0, 10))::INT AS b) AS y LEFT JOIN c ON c.a = x.a AND c.b = y.b), lp AS (SELECT b, list(lp ORDER BY a) AS row FROM (SELECT a, b, ln((n / sum(n) OVER (PARTITION BY a))::DOUBLE) AS lp FROM g) GROUP BY b), m AS (SELECT list(row ORDER BY b) AS m FROM lp)"
_VITERBI = f"""WITH RECURSIVE {_ACT.removeprefix('WITH ')}, {_LP},
em AS (SELECT al.video_id, al.agent, window_id, core_start, list(CASE WHEN al.cls = 0 THEN 0.0 WHEN NOT allowed THEN -1e9 ELSE ln(greatest(p, 1e-12)) - ln(greatest(t, 1e-6)) END ORDER BY al.cls) AS e FROM al JOIN thr ON thr.lab_id = al.lab_id AND thr.cls = al.cls GROUP BY ALL),
es AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id, agent ORDER BY core_start, window_id) AS k FROM em),
fw AS (SELECT video_id, agent, window_id, k, e AS s, []::INT[] AS back FROM es WHERE k = 1 UNION ALL
  SELECT es.video_id, es.agent, es.window_id, es.k, list_transform(range(1, 11), lambda j: es.e[j] + list_max(list_transform(range(1, 11), lambda i: fw.s[i] + m.m[j][i]))),
    list_transform(range(1, 11), lambda j: list_position(list_transform(range(1, 11), lambda i: fw.s[i] + m.m[j][i]), list_max(list_transform(range(1, 11), lambda i: fw.s[i] + m.m[j][i])))::INT)
  FROM fw JOIN es ON es.video_id = fw.video_id AND es.agent = fw.agent AND es.k = fw.k + 1, m),
fx AS MATERIALIZED (SELECT * FROM fw),
bw AS (SELECT video_id, agent, window_id, k, list_position(s, list_max(s))::INT AS spot, back FROM fx WHERE (video_id, agent, k) IN (SELECT (video_id, agent, max(k)) FROM fx GROUP BY video_id, agent) UNION ALL
  SELECT fx.video_id, fx.agent, fx.window_id, fx.k, bw.back[bw.spot], fx.back FROM bw JOIN fx ON fx.video_id = bw.video_id AND fx.agent = bw.agent AND fx.k = bw.k - 1)
SELECT window_id, spot - 1 AS cls FROM bw"""
_BALD = f"WITH {PROBA_SQL}, m AS (SELECT window_id, p FROM proba UNION ALL SELECT window_id, list_transform(p, lambda v: (v + 0.1) / 2.0) FROM proba UNION ALL SELECT window_id, list_transform(p, lambda v: (v + 0.5) / 6.0) FROM proba), e AS (SELECT window_id, avg(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-12)))) AS mean FROM m GROUP BY window_id), u AS (SELECT window_id, unnest(range(0, 10)) AS c, unnest(p) AS v FROM m), t AS (SELECT window_id, sum(-v * ln(v + 1e-12)) AS h FROM (SELECT window_id, c, avg(v) AS v FROM u GROUP BY ALL) GROUP BY window_id)"
SQL = {
    "sq_spectra": f"""WITH {POSE_SQL}, s AS (SELECT video_id, mouse_id, nose_x::DOUBLE AS x, row_number() OVER w - 1 AS i, count(*) OVER v AS len, min(nose_x) OVER v AS lo, max(nose_x) OVER v AS hi FROM pose WHERE nose_x IS NOT NULL WINDOW w AS (PARTITION BY video_id, mouse_id ORDER BY video_frame), v AS (PARTITION BY video_id, mouse_id)),
k AS (SELECT *, least(64, len) AS n, unnest(range(0, (len - least(64, len)) // (least(64, len) // 2) + 1)) AS seg FROM s WHERE len >= 8 AND lo < hi), g AS (SELECT *, i - seg * (n // 2) AS j FROM k WHERE i >= seg * (n // 2) AND i < seg * (n // 2) + n),
d AS (SELECT video_id, mouse_id, seg, n, j, (x - avg(x) OVER (PARTITION BY video_id, mouse_id, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / n)) AS y, unnest(range(0, n // 2 + 1)) AS f FROM g),
p AS (SELECT video_id, mouse_id, seg, n, f, (sum(y * cos(2 * pi() * f * j / n)) ** 2 + sum(y * sin(2 * pi() * f * j / n)) ** 2) * CASE WHEN f = 0 OR 2 * f = n THEN 1 ELSE 2 END AS p FROM d GROUP BY video_id, mouse_id, seg, n, f),
a AS (SELECT video_id, mouse_id, n, f, sum(p) AS p FROM p GROUP BY ALL), q AS (SELECT video_id, mouse_id, f::DOUBLE / n AS f, p / sum(p) OVER v AS q, count(*) OVER v AS parts FROM a WINDOW v AS (PARTITION BY video_id, mouse_id)),
c AS (SELECT *, sum(q) OVER (PARTITION BY video_id, mouse_id ORDER BY f) AS up FROM q),
t AS (SELECT video_id, mouse_id, sum(CASE WHEN f > 0.2 THEN q ELSE 0 END) AS h, -sum(q * ln(q + 1e-12)) / ln(max(parts)) AS e, min(f) FILTER (WHERE up >= 0.95) AS b FROM c GROUP BY ALL)
SELECT video_id, mouse_id, {rs('h', 'high_share')}, {rs('e', 'entropy')}, {rs('b', 'bandwidth')} FROM (SELECT DISTINCT video_id, mouse_id FROM pose) LEFT JOIN t USING (video_id, mouse_id)""",
    "ml_hybrid_batch": f"""WITH RECURSIVE {PROBA_SQL}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, window_id) AS rn FROM (SELECT window_id, p, {_ENT} AS score FROM proba WHERE list_max(p) <= 0.3) QUALIFY rn <= 100),
r AS (SELECT 0 AS step, window_id, p, list_distance(p, (SELECT p FROM top WHERE rn = 1)) AS d, (SELECT window_id FROM top WHERE rn = 1) AS c FROM top UNION ALL SELECT step + 1, r.window_id, r.p, least(r.d, list_distance(r.p, n.p)), n.window_id FROM r, (SELECT window_id, p FROM r ORDER BY d DESC, window_id LIMIT 1) AS n WHERE step < 9),
s AS (SELECT DISTINCT step, c AS window_id FROM r) SELECT window_id FROM top WHERE rn <= 5 UNION ALL (SELECT window_id FROM s WHERE window_id NOT IN (SELECT window_id FROM top WHERE rn <= 5) ORDER BY step LIMIT 5)""",
    "sq_viterbi": _VITERBI,
    "sq_viterbi_uniform": _RULES["dc_ratio"],
    "sq_transition_log_probs": f"WITH {PROBA_SQL}, n AS (SELECT y AS a, lead(y) OVER (PARTITION BY video_id, agent ORDER BY core_start, window_id) AS b FROM proba), c AS (SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY ALL), g AS (SELECT x.a, y.b, coalesce(n, 0) + 1.0 AS n FROM (SELECT unnest(range(0, 10))::INT AS a) AS x, (SELECT unnest(range(0, 10))::INT AS b) AS y LEFT JOIN c ON c.a = x.a AND c.b = y.b) SELECT a, b, {rs('ln((n / sum(n) OVER (PARTITION BY a))::DOUBLE)', 'lp', 6)} FROM g",
    "ml_query_entropy": f"WITH {PROBA_SQL} SELECT window_id, {_ENT} AS score FROM proba WHERE window_id % 5 <> 0 ORDER BY 2 DESC, 1 LIMIT 25",
    "ml_query_margin": f"WITH {PROBA_SQL} SELECT window_id, round(list_sort(p, 'DESC')[2] - list_sort(p, 'DESC')[1], 6) AS score FROM proba WHERE window_id % 5 <> 0 ORDER BY 2 DESC, 1 LIMIT 25",
    "ml_k_center": f"WITH RECURSIVE {PROBA_SQL}, r AS (SELECT 0 AS step, window_id, p, list_distance(p, (SELECT p FROM proba WHERE window_id = 0)) AS d, 0::BIGINT AS c FROM proba UNION ALL SELECT step + 1, r.window_id, r.p, least(r.d, list_distance(r.p, n.p)), n.window_id FROM r, (SELECT window_id, p FROM r ORDER BY d DESC, window_id LIMIT 1) AS n WHERE step < 5) SELECT DISTINCT step, c AS window_id FROM r",
    "ml_resampled": f"WITH {PROBA_SQL}, n AS (SELECT y, count(*) AS n FROM proba GROUP BY y), b AS (SELECT window_id, y, (SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * n) AS w FROM proba JOIN n USING (y)) SELECT y, sum(floor(w) + (('0x' || substr(md5('0|' || window_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < w - floor(w))::INT)::BIGINT AS n FROM b GROUP BY y HAVING sum(floor(w) + (('0x' || substr(md5('0|' || window_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < w - floor(w))::INT) > 0",
    "ml_random_batch": f"WITH {PROBA_SQL} SELECT window_id FROM proba WHERE list_max(p) <= 0.3 ORDER BY md5('0|' || window_id), window_id LIMIT 25",
    "ml_combined_batch": f"WITH {PROBA_SQL}, i AS (SELECT y AS cls, 1.0::DOUBLE / count(*) AS i FROM proba GROUP BY y), u AS (SELECT window_id, -round(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-12))), 6) AS a, -coalesce((SELECT round(i / (SELECT avg(i) FROM i), 6) FROM i WHERE cls = list_position(p, list_max(p)) - 1), 1.0) AS b, -(p[1] < 0.1)::INT AS c FROM proba WHERE list_max(p) <= 0.3), k AS (SELECT window_id, " + ", ".join(f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS r{x}" for x in "abc") + f", count(*) OVER () AS n FROM u) SELECT window_id, {rs('round((0.5 * ra + 0.3 * rb + 0.2 * rc) / n, 9)', 'score', 6)} FROM k ORDER BY round((0.5 * ra + 0.3 * rb + 0.2 * rc) / n, 9) DESC, window_id LIMIT 25",
    "ml_oracle": f"WITH {PROBA_SQL}, q AS (SELECT window_id, y FROM proba WHERE list_max(p) <= 0.3 ORDER BY {_ENT} DESC, window_id LIMIT 25) SELECT window_id, y FROM q ORDER BY window_id LIMIT 10",
    "ml_bald": f"{_BALD} SELECT window_id, {rs('h - mean', 'bald', 6)} FROM t JOIN e USING (window_id)",
    "ml_scheduled_batch": f"{_BALD}, a AS (SELECT window_id, {rs('h - mean', 'score', 6)} FROM t JOIN e USING (window_id) JOIN proba USING (window_id) WHERE list_max(p) <= 0.3 ORDER BY 2 DESC, 1 LIMIT 15), b AS (SELECT window_id, round(list_sort(p, 'DESC')[2] - list_sort(p, 'DESC')[1], 6) AS score FROM proba WHERE list_max(p) <= 0.3 AND window_id NOT IN (SELECT window_id FROM a) ORDER BY 2 DESC, 1 LIMIT 15) SELECT window_id, score, 2 AS round FROM a UNION ALL SELECT window_id, score, 3 FROM b",
    "ml_seed_set": f"WITH {PROBA_SQL} SELECT window_id, y FROM proba QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5('0|' || window_id), window_id) <= 5",
    "sm_hourly_rates": f"WITH b AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, value FROM events), g AS (SELECT start, event_type, count(*) AS n, avg(value) AS m FROM b GROUP BY start, event_type) SELECT start, start + INTERVAL 1 hour AS stop, event_type, n, {rs('m', 'mean')} FROM g WHERE start + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 2 hour FROM events)",
    "sm_sessions": "WITH o AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 hour, true) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT min(ts) AS start, max(ts) + INTERVAL 6 hour AS stop, user_id, count(*) AS n FROM i GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 hour <= (SELECT max(ts) - INTERVAL 2 hour FROM events)",
}
