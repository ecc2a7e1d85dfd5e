"""Queries on prediction with lab bundles and on calibration, and their SQL."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import functions as F

from ..operators import inference as In
from ..sources.adapters import POSE_SQL, PROBA_SQL, pose, proba
from .frame_queries import r4, rs

COLUMNS = ["nose_x_mean", "nose_y_std", "tail_mean"]
NAMES = ["background", "sniff", "mount", "chase"]
LABS = (0, 1, 2)  # of four: the last one has no bundle of its own


def _blocks(spark, d):
    """Windows of 32 frames of each mouse towards the other."""
    p = pose(spark, d).withColumn("win", F.floor(F.col("video_frame") / 32))
    g = p.groupBy("video_id", "mouse_id", "win").agg(F.round(F.avg("nose_x"), 6).alias("nose_x_mean"), F.round(F.stddev_pop("nose_y"), 6).alias("nose_y_std"), F.round(F.avg("tail_base_x"), 6).alias("tail_mean"))
    number = F.col("video_id") * 100000 + F.col("mouse_id") * 10000 + F.col("win")
    return g.select((F.col("video_id") % 4).alias("lab_id"), "video_id", F.col("mouse_id").alias("agent"), (3 - F.col("mouse_id")).alias("target"), number.alias("window_id"), (F.col("win") * 32).alias("core_start"), (F.col("win") * 32 + 32).alias("core_stop"), *COLUMNS)


def _model(lab: int) -> dict:
    """Weights by rule, so that SQL can have them too."""
    k = 5 if lab is None else lab
    w = [[((k * 7 + c * 3 + j * 5) % 11 - 5) / 4 for j in range(3)] for c in range(4)]
    return {"means": [25.0, 25.0, 4.0 + k / 10], "scales": [2.0, 3.0, 1.5], "weights": w, "bias": [((k + c) % 3) / 4 for c in range(4)], "t": [0.5, *(0.2 + ((k + c) % 4) / 20 for c in (1, 2, 3))]}


def _bundles(spark):
    rows = [(lab, *_model(lab).values()) for lab in (*LABS, None)]
    return spark.createDataFrame(rows, In.BUNDLE + ", t array<double>")


def _active(spark, d):
    """Sniffs are directed at oneself; odd videos have no chases."""
    w = _blocks(spark, d).select("video_id", "agent", "target").distinct()
    c = w.select("video_id", "agent", "target", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("cls")).where("cls <> 3 OR video_id % 2 = 0")
    return c.withColumn("target", F.when(F.col("cls") != 1, F.col("target")))


def pr_bundled_probabilities(spark, d):
    """The probabilities of windows by the bundles of their labs."""
    s = In.scored(_blocks(spark, d), COLUMNS, _bundles(spark))
    return r4(s.select("window_id", *[F.get("p", F.lit(c)).alias(f"p{c}") for c in range(4)]), 6)


def pr_bundled_submission(spark, d):
    """Raw poses to intervals: windows, bundles of all labs in one job, masks, thresholds, routing, durations."""
    stats = spark.createDataFrame([(lab, n, 64.0 * (lab == 1), 32.0 * (n == "mount")) for lab in range(4) for n in NAMES[1:]], "lab_id long, action string, min_dur double, max_gap double")
    return In.submission(_blocks(spark, d), COLUMNS, _bundles(spark), _active(spark, d), NAMES, stats)


def pr_trained_submission(spark, d):
    """The same with models that are trained on the windows' own place among their mouse's (early, middle, late)."""
    b = _blocks(spark, d).withColumn("y", F.least(F.floor(F.col("core_start") / 96), F.lit(3)).cast("int"))
    models = In.lab_bundles(b.where("lab_id <> 3"), COLUMNS, 4).withColumn("t", F.array(*[F.lit(0.2)] * 4))
    return In.submission(b, COLUMNS, models, _active(spark, d), NAMES)


def cb_calibrators(spark, d):
    """Isotonic calibration of each lab and class, by hundredths."""
    return r4(In.calibrators(proba(spark, d).select("lab_id", "y", "p"), 2), 6)


def cb_calibrated(spark, d):
    """Windows' probabilities before and after, of their true class."""
    p = proba(spark, d).select("window_id", "lab_id", "y", "p")
    c = In.calibrated(p, In.calibrators(p, 2), 2)
    return r4(c.select("window_id", F.get("p", F.col("y").cast("int")).alias("before"), F.get("q", F.col("y").cast("int")).alias("after")), 6)


def cb_out_of_fold(spark, d):
    """How well out-of-fold models tell windows' classes, before and after calibration, by lab."""
    b = _blocks(spark, d).withColumns({"y": F.least(F.floor(F.col("core_start") / 96), F.lit(3)).cast("int"), "fold": F.col("video_id") % 3})
    oof = In.out_of_fold(b, COLUMNS, 4).select("window_id", "lab_id", "y", "p")
    c = In.calibrated(oof, In.calibrators(oof, 2), 2)
    loss = lambda x: -F.avg(F.ln(F.greatest(F.get(x, F.col("y")), F.lit(1e-6))))
    return r4(c.groupBy("lab_id").agg(F.count("*").alias("n"), loss("p").alias("before"), loss("q").alias("after")))


def cb_bags(spark, d):
    """Rows and weights of five resamples."""
    w = In.bag_weights(proba(spark, d).select("window_id"), 5, ["window_id"])
    return w.groupBy("bag").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"))


QUERIES = {k: v for k, v in globals().items() if k[:3] in ("pr_", "cb_")}

# ---- SQL ----

r6 = lambda e, n: rs(e, n, 6)
_MODELS = "md AS (" + " UNION ALL ".join(f"SELECT {-1 if lab is None else lab} AS own, {m['means']}::DOUBLE[] AS means, {m['scales']}::DOUBLE[] AS scales, {m['weights']}::DOUBLE[][] AS weights, {m['bias']}::DOUBLE[] AS bias, {m['t']}::DOUBLE[] AS t" for lab in (*LABS, None) for m in [_model(lab)]) + ")"
_BLOCKS = f"""{POSE_SQL}, bl AS (SELECT video_id % 4 AS lab_id, video_id, mouse_id AS agent, 3 - mouse_id AS target, video_id * 100000 + mouse_id * 10000 + video_frame // 32 AS window_id, (video_frame // 32) * 32 AS core_start, (video_frame // 32) * 32 + 32 AS core_stop,
  round(avg(nose_x), 6) AS a, round(stddev_pop(nose_y), 6) AS b, round(avg(tail_base_x), 6) AS c FROM pose GROUP BY video_id, mouse_id, video_frame // 32),
{_MODELS}, x AS (SELECT bl.*, t, weights, bias, [coalesce((a - means[1]) / scales[1], 0), coalesce((b - means[2]) / scales[2], 0), coalesce((c - means[3]) / scales[3], 0)] AS x FROM bl JOIN md ON own = CASE WHEN lab_id IN {LABS} THEN lab_id ELSE -1 END),
z AS (SELECT *, [weights[k][1] * x[1] + weights[k][2] * x[2] + weights[k][3] * x[3] + bias[k] FOR k IN [1, 2, 3, 4]] AS z FROM x),
e AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z), p AS (SELECT * EXCLUDE (e), list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)"""
_SUB = f"""{_BLOCKS}, m AS (SELECT *, [CASE WHEN k <> 4 OR video_id % 2 = 0 THEN p[k] - t[k] END FOR k IN [2, 3, 4]] AS m FROM p),
dc AS (SELECT *, CASE WHEN list_max(m) > 0 THEN list_position(m, list_max(m)) ELSE 0 END AS cls FROM m),
iv AS (SELECT lab_id, video_id, agent AS agent_id, CASE WHEN cls = 1 THEN agent ELSE target END AS target_id, ['sniff', 'mount', 'chase'][cls] AS action, core_start AS s, core_stop AS f FROM dc WHERE cls > 0),
r0 AS (SELECT *, coalesce(s > max(f) OVER (PARTITION BY video_id, agent_id, target_id, action ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS b FROM iv),
r1 AS (SELECT *, sum(b) OVER (PARTITION BY video_id, agent_id, target_id, action ORDER BY s) AS i FROM r0),
r2 AS (SELECT lab_id, video_id, agent_id, target_id, action, min(s) AS s, max(f) AS f FROM r1 GROUP BY lab_id, video_id, agent_id, target_id, action, i),
f0 AS (SELECT *, coalesce(s - max(f) OVER (PARTITION BY video_id, agent_id, target_id, action ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > CASE WHEN action = 'mount' THEN 32 ELSE 0 END, true)::INT AS b FROM r2),
f1 AS (SELECT *, sum(b) OVER (PARTITION BY video_id, agent_id, target_id, action ORDER BY s) AS i FROM f0)
SELECT lab_id, video_id, agent_id, target_id, action, min(s)::BIGINT AS start_frame, max(f)::BIGINT AS stop_frame FROM f1 GROUP BY lab_id, video_id, agent_id, target_id, action, i HAVING max(f) - min(s) >= CASE WHEN lab_id = 1 THEN 64 ELSE 0 END"""
_ISO = f"""{PROBA_SQL}, l AS (SELECT window_id, lab_id, y, unnest(range(0, 10))::INT AS cls, unnest(p) AS p FROM proba),
n AS (SELECT lab_id, cls, round(p * 100)::INT AS ix, count(*) AS n, count_if(y = cls) AS s FROM l GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM n WINDOW w AS (PARTITION BY lab_id, cls ORDER BY ix)),
ab AS (SELECT a.lab_id, a.cls, a.ix AS a, b.ix AS b, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n) AS m FROM c AS a JOIN c AS b ON a.lab_id = b.lab_id AND a.cls = b.cls AND b.ix >= a.ix),
lo AS (SELECT *, min(m) OVER (PARTITION BY lab_id, cls, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM ab),
iso AS (SELECT lab_id, cls, b AS ix, max(low) AS q FROM lo GROUP BY ALL),
g AS (SELECT DISTINCT lab_id, cls, unnest(range(0, 101))::INT AS ix FROM n),
j AS (SELECT g.*, max(CASE WHEN q IS NOT NULL THEN g.ix END) OVER (PARTITION BY g.lab_id, g.cls ORDER BY g.ix) AS below, min(CASE WHEN q IS NOT NULL THEN g.ix END) OVER (PARTITION BY g.lab_id, g.cls ORDER BY g.ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over FROM g LEFT JOIN iso USING (lab_id, cls, ix)),
cal AS (SELECT j.lab_id, j.cls, j.ix, CASE WHEN below IS NULL THEN o.q WHEN over IS NULL OR over = below THEN u.q ELSE u.q + (o.q - u.q) * (j.ix - below) / (over - below) END AS q
  FROM j LEFT JOIN iso AS u ON u.lab_id = j.lab_id AND u.cls = j.cls AND u.ix = below LEFT JOIN iso AS o ON o.lab_id = j.lab_id AND o.cls = j.cls AND o.ix = over)"""
_STEPS = [sum(exp(-1.0) / factorial(j) for j in range(k + 1)) for k in range(18)]
SQL = {
    "cb_bags": f"WITH {PROBA_SQL}, u AS (SELECT bag, ('0x' || substr(md5('0|' || window_id || '|' || bag), 1, 13))::BIGINT / pow(2.0, 52) AS u FROM proba, (SELECT unnest(range(0, 5))::INT AS bag)), w AS (SELECT bag, len(list_filter({_STEPS}::DOUBLE[], lambda c: c <= u)) AS w FROM u) SELECT bag, count(*) AS rows, sum(w)::BIGINT AS weight FROM w WHERE w > 0 GROUP BY bag",
    "pr_bundled_probabilities": f"WITH {_BLOCKS} SELECT window_id, " + ", ".join(r6(f"p[{c + 1}]", f"p{c}") for c in range(4)) + " FROM p",
    "pr_bundled_submission": f"WITH {_SUB}",
    "cb_calibrators": f"WITH {_ISO} SELECT lab_id, cls, ix AS \"at\", {r6('q', 'q')} FROM cal",
    "cb_calibrated": f"WITH {_ISO}, q AS (SELECT window_id, y, l.cls, p, greatest(coalesce(q, p), 1e-6) AS q FROM l LEFT JOIN cal ON cal.lab_id = l.lab_id AND cal.cls = l.cls AND cal.ix = round(p * 100)::INT), t AS (SELECT *, q / sum(q) OVER (PARTITION BY window_id) AS r FROM q) SELECT window_id, {r6('p', 'before')}, {r6('r', 'after')} FROM t WHERE cls = y",
}
