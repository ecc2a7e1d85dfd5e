"""Queries of studies over videos and animals, and their SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import frames as P
from ..operators import search as Se
from ..operators import studies as St
from ..session import written
from ..sources.adapters import POSE_SQL, pose
from .frame_queries import W, r4, rs

ANIMALS = [2, 3, 4, 5]
CUES = {"step": (5.0, 15.0, 25.0, 35.0), "length": (0.1, 0.5, 1.0, 2.0), "turn": (2.0, 8.0, 20.0, 40.0)}


def _videos(spark, d):
    """Scores of each video with and without its neck's pull, and how often its nose is far out; videos of three labs."""
    p = pose(spark, d).groupBy("video_id").agg(F.round(F.avg((F.col("nose_x") > 45).cast("int")), 2).alias("q"), F.round(F.avg("nose_x") / 50, 4).alias("raw"), F.round(F.avg("neck_x") / 40, 4).alias("cor"))
    return p.withColumn("lab_id", F.col("video_id") % 3)


def sd_gate(spark, d):
    """Which videos take the corrected score, by a threshold chosen on the others of their lab."""
    return r4(St.quality_gate(_videos(spark, d), "lab_id"), 6)


def sd_gate_all(spark, d):
    """The same over all videos, and what it gains."""
    g = St.quality_gate(_videos(spark, d).drop("lab_id"))
    return r4(g.agg(F.count("*").alias("videos"), F.count_if(F.col("routed") == "cor").alias("routed"), F.avg(F.col("gated") - F.col("raw")).alias("gain")), 6)


def sd_between(spark, d):
    """Distances of the noses' places between four animals of a video (mice, by odd and even frames)."""
    p = pose(spark, d).select("video_id", (F.col("mouse_id") * 2 + F.col("video_frame") % 2).alias("animal"), F.round("nose_x", 3).alias("v"))
    return r4(St.ks_between(p, "v", "animal", ANIMALS, "video_id"), 6)


def _cues(spark, d):
    w = P.by_mouse()
    p = pose(spark, d)
    p = p.withColumn("step", G.distance("nose_x", "nose_y", F.lag("nose_x").over(w), F.lag("nose_y").over(w)))
    p = p.withColumn("turn", F.abs(F.col("step") - F.lag("step").over(w)))
    return p.select("video_id", "step", F.abs(G.apart("neck", "hip_left") / 10 - 1).alias("length"), "turn")


def sd_settings(spark, d):
    """Shares of frames that each of 64 detector settings flags."""
    return r4(St.detector_settings(_cues(spark, d), CUES), 6)


def sd_calibrated(spark, d):
    """The setting nearest to flagging two thirds, under limits of two cues' shares."""
    return r4(St.calibrated(St.detector_settings(_cues(spark, d), CUES), ("step", 0.6), ("length", 0.2, 0.9), 0.66), 6)


def sd_agreement(spark, d):
    """Noses against themselves three frames later: spectra, coherence and lag of each mouse."""
    p = pose(spark, d)
    return r4(St.agreement(p.withColumn("later", F.lag("nose_x", 3).over(P.by_mouse())), "nose_x", "later", 30.0))


def sd_search(spark, d):
    """Thresholds of two cues that flag a third of all frames by each, found by search over counts of the frames."""
    c = written(_cues(spark, d).groupBy(F.round("step", 1).alias("step"), F.round("length", 2).alias("length")).agg(F.count("*").alias("n")), "cues")

    def objective(p):
        part = lambda x, t: F.abs(F.sum(F.when(F.col(x) > t, F.col("n")).otherwise(0)) / F.sum("n") - 1 / 3)
        return -(c.agg((part("step", p["step"]) + part("length", p["length"])).alias("x")).first()["x"] or 0.0)

    return r4(Se.searched(spark, {"step": (0.0, 60.0), "length": (0.01, 10.0, "log")}, objective, trials=20, first=6).select("trial", "score", "best"), 6)


QUERIES = {k: v for k, v in globals().items() if k[:3] == "sd_"}

# ---- SQL ----

r6 = lambda e, n: rs(e, n, 6)
_VIDEOS = f"{POSE_SQL}, v AS (SELECT video_id, video_id % 3 AS lab_id, round(avg((nose_x > 45)::INT), 2) AS q, round(avg(nose_x) / 50, 4) AS raw, round(avg(neck_x) / 40, 4) AS cor FROM pose GROUP BY video_id)"


def _gate(same: str) -> str:
    """Every fold and every threshold, from pairs of videos."""
    return f"""{_VIDEOS}, o AS (SELECT a.video_id, b.q, b.raw, b.cor FROM v AS a JOIN v AS b ON a.video_id <> b.video_id AND {same}),
t AS (SELECT video_id, min(q) - 1e-9 AS tau FROM o GROUP BY video_id UNION SELECT video_id, q FROM o),
m AS (SELECT t.video_id, tau, round(sum(CASE WHEN o.q > tau THEN cor - raw ELSE 0 END), 9) AS g FROM t JOIN o USING (video_id) GROUP BY ALL),
b AS (SELECT video_id, tau FROM m QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY g DESC, tau) = 1),
gate AS (SELECT lab_id, v.video_id, q, tau, raw, cor, CASE WHEN q > tau THEN cor ELSE raw END AS gated, CASE WHEN q > tau THEN 'cor' ELSE 'raw' END AS routed FROM v JOIN b USING (video_id))"""


_PAIRS = " UNION ALL ".join(f"SELECT video_id, {a} AS a, {b} AS b, n{a} AS n_a, n{b} AS n_b, k{a}_{b} AS ks FROM g" for i, a in enumerate(ANIMALS) for b in ANIMALS[i + 1 :])
_CUES = f"s0 AS (SELECT *, sqrt((nose_x - lag(nose_x) {W}) ** 2 + (nose_y - lag(nose_y) {W}) ** 2) AS step FROM pose), s AS (SELECT video_id, step, abs(step - lag(step) {W}) AS turn, abs(sqrt((neck_x - hip_left_x) ** 2 + (neck_y - hip_left_y) ** 2) / 10 - 1) AS length FROM s0)"
_FLAG = {n: f"coalesce({n} > t_{n}, false)" for n in CUES}
_GRID = "grid AS (" + " UNION ALL ".join(f"SELECT {a}::DOUBLE AS t_step, {b}::DOUBLE AS t_length, {c}::DOUBLE AS t_turn" for a, b, c in product(*CUES.values())) + ")"
_SETTINGS = f"{POSE_SQL}, {_CUES}, {_GRID}, e AS (SELECT video_id, t_step, t_length, t_turn, " + ", ".join(f"avg(({f})::INT) AS {n}_share" for n, f in _FLAG.items()) + f", avg(({' OR '.join(_FLAG.values())})::INT) AS flagged FROM s, grid GROUP BY ALL), st AS (SELECT t_step AS step, t_length AS length, t_turn AS turn, avg(step_share) AS step_share, avg(length_share) AS length_share, avg(turn_share) AS turn_share, avg(flagged) AS flagged FROM e GROUP BY ALL)"
_COLUMNS = ", ".join(r6(c, c) for c in ("step", "length", "turn", "step_share", "length_share", "turn_share", "flagged"))
SQL = {
    "sd_gate": f"WITH {_gate('a.lab_id = b.lab_id')} SELECT lab_id, video_id, {r6('q', 'q')}, {r6('tau', 'tau')}, {r6('raw', 'raw')}, {r6('cor', 'cor')}, {r6('gated', 'gated')}, routed FROM gate",
    "sd_gate_all": f"WITH {_gate('true')} SELECT count(*) AS videos, count_if(routed = 'cor')::BIGINT AS routed, {r6('avg(gated - raw)', 'gain')} FROM gate",
    "sd_between": f"WITH {POSE_SQL}, c AS (SELECT video_id, round(nose_x, 3) AS v, " + ", ".join(f"count_if(mouse_id * 2 + video_frame % 2 = {a}) AS c{a}" for a in ANIMALS) + " FROM pose GROUP BY ALL), fd AS (SELECT video_id, " + ", ".join(f"sum(c{a}) OVER w::DOUBLE / nullif(sum(c{a}) OVER p, 0) AS f{a}, sum(c{a}) OVER p AS n{a}" for a in ANIMALS) + " FROM c WINDOW w AS (PARTITION BY video_id ORDER BY v), p AS (PARTITION BY video_id)), g AS (SELECT video_id, " + ", ".join([f"max(n{a})::BIGINT AS n{a}" for a in ANIMALS] + [f"max(abs(f{a} - f{b})) AS k{a}_{b}" for i, a in enumerate(ANIMALS) for b in ANIMALS[i + 1 :]]) + f" FROM fd GROUP BY video_id), r AS ({_PAIRS}), x AS (SELECT *, ks * sqrt((n_a * n_b)::DOUBLE / (n_a + n_b)) AS x FROM r WHERE ks IS NOT NULL) SELECT video_id, a, b, n_a, n_b, {r6('ks', 'ks')}, {r6('CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 21), lambda i: (CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE * exp(-2.0 * i * i * x * x))))) END', 'p')} FROM x",
    "sd_settings": f"WITH {_SETTINGS} SELECT {_COLUMNS} FROM st",
    "sd_calibrated": f"WITH {_SETTINGS} SELECT {_COLUMNS} FROM st ORDER BY CASE WHEN step_share <= 0.6 AND length_share BETWEEN 0.2 AND 0.9 THEN 0 WHEN step_share <= 0.6 THEN 1 ELSE 2 END, round(abs(flagged - 0.66), 9), round(flagged, 9), step, length, turn LIMIT 1",
}
