"""Queries on benchmarks of repairs and trackings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import signal as Sg
from ..operators import active as A
from ..operators import benchmarks as B
from ..operators import evaluate as E
from ..operators import frames as P
from ..operators import inference as In
from ..operators import models as M
from ..operators import motion as Mo
from ..operators import quality as Q
from ..sources.adapters import POSE_SQL, PROBA_SQL, XY, pose, proba
from .frame_queries import KEYS, W, r4, rs
from .inference_queries import COLUMNS, _blocks
from .study_queries import _U

CORRUPTIONS = {"spiked": lambda p: Mo.spiked(p, "nose", 0.03), "drifting": lambda p: Mo.drifting(p, "nose"), "correlated": Mo.correlated}


def _over(name: str):
    """The nose replaced by a statistic of five frames around."""
    near = P.by_mouse().rowsBetween(-2, 2)
    one = {"median": lambda c: Sg.array_median(F.collect_list(c).over(near)), "mean": lambda c: F.avg(c).over(near)}[name]
    return lambda df: df.withColumns({f"nose_{a}": one(f"nose_{a}") for a in "xy"})


def bk_recovery(spark, d):
    """Three corruptions of noses against medians and means of five frames."""
    p = pose(spark, d).select("video_id", "mouse_id", "video_frame", *XY)
    return r4(B.recovery_grid(p, CORRUPTIONS, {n: _over(n) for n in ("median", "mean")}, ["nose"], columns=["nose_x", "nose_y"], in_rows=True), 6)


def bk_swap_recovery(spark, d):
    """Left and right exchanged in some frames, and mended."""
    p = P.without_zero_frames(pose(spark, d))
    c = Mo.swapped_ends(p)
    return r4(B.swap_recovery(p, c, Mo.symmetric_swaps(c), [f"{k}_{s}_{a}" for k in ("ear", "hip") for s in ("left", "right") for a in "xy"], "video_id"), 6)


def bk_identity(spark, d):
    return r4(B.identity_metrics(pose(spark, d), 30.0), 6)


def bk_turning(spark, d):
    """Turning angles of noses, and of noses that are means of three frames."""
    p = pose(spark, d)
    near = P.by_mouse().rowsBetween(-1, 1)
    soft = p.withColumns({f"nose_{a}": F.round(F.avg(f"nose_{a}").over(near), 6) for a in "xy"})
    return r4(B.turning_shift(p, soft, "nose", "video_id", digits=5), 5)


def bk_smoothness(spark, d):
    return r4(B.smoothness(pose(spark, d), ["nose_x", "tail_base_y"], 30.0, 6.1), 5)


def bk_phases(spark, d):
    """Lengths of edges in all frames, in those that are not zero, and in those of them with a tail."""
    mean = lambda p: Q.edge_lengths(p).groupBy("edge").agg(F.avg("length").alias("length"))
    p = pose(spark, d)
    real = P.without_zero_frames(p)
    return r4(B.phase_chain({"raw": mean(p), "real": mean(real), "tailed": mean(real.where("tail_base_x IS NOT NULL"))}, ["edge"], "length"), 6)


def bk_silhouette(spark, d):
    """How well labels group the windows' probabilities."""
    return r4(B.silhouette(proba(spark, d), "p", "y"), 6)


def bk_class_mix(spark, d):
    """Classes of the 50 windows that confidence and chance ask for."""
    p = proba(spark, d)
    known = p.where("window_id % 5 = 0")
    asked = M.query_batch(p, known, 50, "confidence").select(F.lit("confidence").alias("strategy"), "window_id")
    return r4(B.class_mix(asked.unionByName(A.random_batch(p, known, 50).select(F.lit("random").alias("strategy"), "window_id")), p), 6)


def bk_cross_labs(spark, d):
    """Models of one lab on the windows of another, which tell early, middle and late windows apart: mean score at home and
    elsewhere. Half of each lab's videos are held out."""
    b = _blocks(spark, d).withColumns({"y": F.least(F.floor(F.col("core_start") / 96), F.lit(3)).cast("int"), "fold": F.floor(F.col("video_id") / 4) % 2})
    return r4(E.cross_mean(In.cross_accuracy(b, COLUMNS, 4, "fold = 1", few=10), "train", "test", "score"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("bk_")}

# ---- SQL ----

r6 = lambda e, n: rs(e, n, 6)
_SPIKE = {a: f"CASE WHEN {_U('0spikenose')} < 0.03 THEN nose_{a} + 60.0 * {f}(2 * pi() * {_U('0turnnose')}) ELSE nose_{a} END" for a, f in (("x", "cos"), ("y", "sin"))}
_SLOW = {a: f"nose_{a} + 5.0 * {f}(2 * pi() * video_frame / 200.0)" for a, f in (("x", "sin"), ("y", "cos"))}
_ALIKE = {a: f"CASE WHEN {_U('0hithead')} < 0.05 THEN nose_{a} + 10.0 * (2 * {_U(f'0{a}head')} - 1) ELSE nose_{a} END" for a in "xy"}
_KIND = " UNION ALL ".join(f"SELECT '{n}' AS corruption, {KEYS}, nose_x, nose_y, {k['x']} AS cx, {k['y']} AS cy FROM pose" for n, k in (("spiked", _SPIKE), ("drifting", _SLOW), ("correlated", _ALIKE)))
_NEAR = "OVER (PARTITION BY corruption, video_id, mouse_id ORDER BY video_frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_REP = " UNION ALL ".join(f"SELECT corruption, '{n}' AS repair, nose_x, nose_y, cx, cy, {n}(cx) {_NEAR} AS rx, {n}(cy) {_NEAR} AS ry FROM c" for n in ("median", "mean"))
_EDGES = lambda t: " UNION ALL ".join(f"SELECT '{a}→{b}' AS edge, avg(sqrt(({a}_x - {b}_x) ** 2 + ({a}_y - {b}_y) ** 2)) AS l FROM {t}" for a, b in G.EDGES)
_SIGNED = " OR ".join(f"coalesce({c}, 0) <> 0" for c in XY)
_TURN = lambda t: f"(SELECT video_id, {'true' if t == 'raw' else 'false'} AS side, CASE WHEN n > 0.5 AND lag(n) {W} > 0.5 THEN a - lag(a) {W} + pi() END AS t FROM (SELECT *, sqrt(dx ** 2 + dy ** 2) AS n, atan2(dy, dx) AS a FROM (SELECT {KEYS}, nx - lag(nx) {W} AS dx, ny - lag(ny) {W} AS dy FROM {t})))"
SQL = {
    "bk_recovery": f"WITH {POSE_SQL}, c AS ({_KIND}), m AS ({_REP}), g AS (SELECT corruption, repair, sqrt(avg((nose_x - cx) ** 2 + (nose_y - cy) ** 2)) AS b, sqrt(avg((nose_x - rx) ** 2 + (nose_y - ry) ** 2)) AS a FROM m GROUP BY ALL) SELECT corruption, repair, 'nose' AS keypoint, {r6('b', 'before')}, {r6('a', 'after')}, {r6('1 - a / nullif(b, 0)', 'recovered')} FROM g",
    "bk_identity": f"""WITH {POSE_SQL}, x AS (SELECT video_id, mouse_id, video_frame, tail_base_x - nose_x AS dx, tail_base_y - nose_y AS dy FROM pose), ps AS (SELECT DISTINCT p.video_id, p.mouse_id AS a, q.mouse_id AS b FROM pose AS p JOIN pose AS q ON p.video_id = q.video_id AND p.mouse_id < q.mouse_id),
s AS (SELECT p.video_id, p.mouse_id AS a, q.mouse_id AS b, p.video_frame AS f, sign(p.dx * q.dy - p.dy * q.dx) AS side FROM x AS p JOIN x AS q ON p.video_id = q.video_id AND p.video_frame = q.video_frame AND p.mouse_id < q.mouse_id),
n AS (SELECT *, coalesce((side <> lag(side) OVER w)::INT, 0) AS c FROM s WHERE side <> 0 WINDOW w AS (PARTITION BY video_id, a, b ORDER BY f)), r AS (SELECT *, sum(c) OVER (PARTITION BY video_id, a, b ORDER BY f) AS run FROM n),
g AS (SELECT video_id, a, b, run, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT video_id, a, b, sum(n) AS valid, count_if(run > 0 AND n >= 2) AS swaps, coalesce(sum(n) FILTER (WHERE run > 0 AND n >= 2), 0) AS inside, count(*) AS fragments FROM g GROUP BY ALL)
SELECT video_id, a, b, CASE WHEN coalesce(valid, 0) < 2 THEN 0 ELSE swaps END::BIGINT AS swaps, {r6('CASE WHEN coalesce(valid, 0) < 2 OR swaps = 0 THEN 0 ELSE inside / swaps / 30.0::DOUBLE END', 'mean_s')}, {r6('CASE WHEN coalesce(valid, 0) < 2 THEN 1 ELSE 1 - inside / valid END', 'persistence')}, CASE WHEN coalesce(valid, 0) < 2 THEN 0 ELSE fragments END::BIGINT AS fragments FROM ps LEFT JOIN t USING (video_id, a, b)""",
    "bk_turning": f"""WITH {POSE_SQL}, raw AS (SELECT {KEYS}, nose_x AS nx, nose_y AS ny FROM pose), soft AS (SELECT {KEYS}, round(avg(nose_x) OVER v, 6) AS nx, round(avg(nose_y) OVER v, 6) AS ny FROM pose WINDOW v AS (PARTITION BY video_id, mouse_id ORDER BY video_frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
t AS (SELECT video_id, side, round(abs(t - 2 * pi() * floor(t / (2 * pi())) - pi()), 5) AS v FROM ({_TURN('raw')} UNION ALL {_TURN('soft')}) WHERE t IS NOT NULL), n AS (SELECT video_id, v, count_if(side) AS a, count_if(NOT side) AS b FROM t GROUP BY ALL),
c AS (SELECT *, sum(a) OVER w / sum(a) OVER (PARTITION BY video_id) AS ca, sum(b) OVER w / sum(b) OVER (PARTITION BY video_id) AS cb FROM n WINDOW w AS (PARTITION BY video_id ORDER BY v))
SELECT video_id, {rs('sum(a * v) / nullif(sum(a), 0)', 'before', 5)}, {rs('sum(b * v) / nullif(sum(b), 0)', 'after', 5)}, {rs('max(abs(ca - cb))', 'ks', 5)}, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM c GROUP BY video_id""",
    "bk_smoothness": f"""WITH {POSE_SQL}, l AS (SELECT {KEYS}, 'a' AS c, nose_x::DOUBLE AS x FROM pose UNION ALL SELECT {KEYS}, 'b', tail_base_y::DOUBLE FROM pose), s AS (SELECT video_id, mouse_id, c, x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY video_id, mouse_id, c) AS len, min(x) OVER (PARTITION BY video_id, mouse_id, c) AS lo, max(x) OVER (PARTITION BY video_id, mouse_id, c) AS hi FROM l WHERE x IS NOT NULL WINDOW w AS (PARTITION BY video_id, mouse_id, c ORDER BY video_frame)),
k AS (SELECT *, least(256, len) AS n, unnest(range(0, (len - least(256, len)) // (least(256, len) // 2) + 1)) AS seg FROM s WHERE len >= 16 AND lo < hi), g AS (SELECT *, i - seg * (n // 2) AS j FROM k WHERE i >= seg * (n // 2) AND i < seg * (n // 2) + n),
d AS (SELECT video_id, mouse_id, c, seg, n, j, (x - avg(x) OVER (PARTITION BY video_id, mouse_id, c, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / n)) AS y, unnest(range(0, n // 2 + 1)) AS f FROM g),
p AS (SELECT video_id, mouse_id, c, seg, n, f, sum(y * cos(2 * pi() * f * j / n)) ** 2 + sum(y * sin(2 * pi() * f * j / n)) ** 2 AS p FROM d GROUP BY ALL), t AS (SELECT video_id, mouse_id, c, sum(CASE WHEN f * 30.0::DOUBLE / n > 6.1 THEN p * CASE WHEN f = 0 OR 2 * f = n THEN 1 ELSE 2 END ELSE 0 END) / sum(p * CASE WHEN f = 0 OR 2 * f = n THEN 1 ELSE 2 END) AS q FROM p GROUP BY ALL)
SELECT video_id, mouse_id, {rs('avg(q)', 'high_share', 5)} FROM (SELECT DISTINCT video_id, mouse_id FROM pose) LEFT JOIN t USING (video_id, mouse_id) GROUP BY ALL""",
    "bk_phases": f"WITH {POSE_SQL}, rl AS (SELECT * FROM pose WHERE {_SIGNED}), tl AS (SELECT * FROM rl WHERE tail_base_x IS NOT NULL), a AS ({_EDGES('pose')}), b AS ({_EDGES('rl')}), c AS ({_EDGES('tl')}) SELECT edge, {r6('a.l', 'raw')}, {r6('b.l', 'real')}, {r6('c.l', 'tailed')}, {r6('b.l - a.l', 'real_change')}, {r6('c.l - b.l', 'tailed_change')} FROM a LEFT JOIN b USING (edge) LEFT JOIN c USING (edge)",
    "bk_silhouette": f"WITH {PROBA_SQL}, m AS (SELECT a.window_id, a.y, b.y AS o, count(*) AS n, sum(list_distance(a.p, b.p) ** 2) AS s FROM proba AS a CROSS JOIN proba AS b GROUP BY ALL), g AS (SELECT window_id, y, max(n) FILTER (WHERE o = y) AS n, max(s / nullif(n - 1, 0)) FILTER (WHERE o = y) AS a, min(s / n) FILTER (WHERE o <> y) AS b FROM m GROUP BY ALL) SELECT y AS \"cluster\", count(*) AS n, {r6('avg(CASE WHEN n > 1 THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0) ELSE 0 END)', 'silhouette')} FROM g GROUP BY y",
    "bk_class_mix": f"WITH {PROBA_SQL}, f AS (SELECT * FROM proba WHERE window_id % 5 <> 0), q AS ((SELECT 'confidence' AS strategy, window_id, y FROM f ORDER BY round(1 - list_max(p), 6) DESC, window_id LIMIT 50) UNION ALL (SELECT 'random', window_id, y FROM f ORDER BY md5('0|' || window_id), window_id LIMIT 50)), n AS (SELECT strategy, y, count(*) AS n FROM q GROUP BY ALL), b AS (SELECT y, count(*) / sum(count(*)) OVER () AS base FROM proba GROUP BY y), s AS (SELECT *, n / sum(n) OVER (PARTITION BY strategy) AS share, coalesce(sum(n) FILTER (WHERE y = 0) OVER (PARTITION BY strategy), 0) / sum(n) OVER (PARTITION BY strategy) AS wasted FROM n) SELECT strategy, y, n, {r6('share', 'share')}, {r6('share / base', 'lift')}, {r6('wasted', 'wasted')} FROM s JOIN b USING (y)",
}
