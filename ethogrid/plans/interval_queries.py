"""Queries on intervals, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..sources import readers as R
from ..sources import sinks
from ..sources.adapters import ANN_SQL, META_SQL, ann, meta_raw

MAX = 4000
CLEAN_SQL = (
    ANN_SQL
    + f""",
c1 AS (SELECT event_id, video_id, agent_id, target_id, action, greatest(start_frame, 0) AS start_frame, least(stop_frame, {MAX}) AS stop_frame, start_frame < 0 AS neg, stop_frame > {MAX} AS ov FROM ann),
c2 AS (SELECT *, start_frame > stop_frame AS inv FROM c1),
c3 AS (SELECT *, lead(start_frame) OVER (PARTITION BY video_id, agent_id, inv ORDER BY start_frame, stop_frame, event_id) AS nx FROM c2),
c4 AS (SELECT * EXCLUDE (stop_frame, nx), coalesce(NOT inv AND stop_frame > nx, false) AS cut, CASE WHEN NOT inv AND stop_frame > nx THEN nx ELSE stop_frame END AS stop_frame FROM c3),
clean AS (SELECT event_id, video_id, agent_id, target_id, action, start_frame, stop_frame, stop_frame - start_frame AS duration_frames FROM c4 WHERE NOT inv AND start_frame < stop_frame)"""
)


def _clean(spark, d):
    return I.clean_annotations(ann(spark, d), MAX)


def _solution(spark, d):
    """Cleaned annotations as a solution, videos dealt to four labs."""
    return _clean(spark, d).withColumn("lab_id", F.col("video_id") % 4)


def _submission(spark, d):
    """Predictions: the annotations shifted by a few frames, with some actions renamed."""
    a = _clean(spark, d)
    move = F.col("event_id") % 3
    return a.select("video_id", "agent_id", "target_id", F.when(F.col("event_id") % 7 == 0, "click").otherwise(F.col("action")).alias("action"), (F.col("start_frame") + move).alias("start_frame"), (F.col("stop_frame") + move).alias("stop_frame"))


def _active(spark, d):
    return _clean(spark, d).where("event_id % 4 <> 1").select(*I.KEY, "action").distinct()


SCORE_SQL = (
    CLEAN_SQL
    + """,
sol AS (SELECT *, video_id % 4 AS lab_id FROM clean),
sub AS (SELECT video_id, agent_id, target_id, CASE WHEN event_id % 7 = 0 THEN 'click' ELSE action END AS action, start_frame + event_id % 3 AS start_frame, stop_frame + event_id % 3 AS stop_frame FROM clean),
active AS (SELECT DISTINCT video_id, agent_id, target_id, action FROM clean WHERE event_id % 4 <> 1),
lf AS (SELECT DISTINCT lab_id, video_id, agent_id, target_id, action, unnest(range(start_frame, stop_frame)) AS fr FROM sol),
pf AS (SELECT DISTINCT lab_id, video_id, agent_id, target_id, action, unnest(range(start_frame, stop_frame)) AS fr FROM sub SEMI JOIN active USING (video_id, agent_id, target_id, action) JOIN (SELECT DISTINCT lab_id, video_id FROM sol) USING (video_id)),
m AS (SELECT coalesce(l.lab_id, p.lab_id) AS lab_id, coalesce(l.action, p.action) AS action, l.fr AS a, p.fr AS b FROM lf AS l FULL JOIN pf AS p ON l.lab_id = p.lab_id AND l.video_id = p.video_id AND l.agent_id = p.agent_id AND l.target_id = p.target_id AND l.action = p.action AND l.fr = p.fr),
act AS (SELECT lab_id, action, count_if(a IS NOT NULL AND b IS NOT NULL) AS tp, count_if(b IS NULL) AS fn, count_if(a IS NULL) AS fp FROM m SEMI JOIN sol USING (lab_id, action) GROUP BY ALL),
sc AS (SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fn + fp, 0), 0) AS f FROM act)"""
)


def iv_clean(spark, d):
    return _clean(spark, d)


def iv_clean_report(spark, d):
    return I.repair_report(ann(spark, d), MAX, by=("action",))


def iv_consistency(spark, d):
    return I.consistency(ann(spark, d), F.lit(MAX))


def iv_bridge(spark, d):
    return I.merged(ann(spark, d).where("stop_frame > start_frame"), ["video_id", "action"], 3)


def iv_duration_stats(spark, d):
    return I.duration_stats(_solution(spark, d), "lab_id", "action")


def iv_min_duration(spark, d):
    sol = _solution(spark, d)
    return I.min_duration_filter(sol.drop("duration_frames", "event_id"), I.duration_stats(sol, "lab_id", "action"))


def iv_robustify(spark, d):
    return I.robustify(ann(spark, d))


def _labelled(spark, d, precedence):
    """Frames by label, and the sum of their numbers."""
    x = I.label_spells(_clean(spark, d), ann(spark, d), precedence).withColumn("_n", F.col("stop_frame") - F.col("start_frame"))
    numbers = ((F.col("start_frame") + F.col("stop_frame") - 1) * F.col("_n") / 2).cast("long")
    return x.groupBy("label").agg(F.sum("_n").alias("n"), F.sum(numbers).alias("s"))


def iv_label_longest(spark, d):
    return _labelled(spark, d, "longest")


def iv_label_shortest(spark, d):
    return _labelled(spark, d, "shortest")


def _label_sql(order: str) -> str:
    return f"""WITH {CLEAN_SQL},
fr AS (SELECT DISTINCT video_id, agent_id, target_id, unnest(range(start_frame, stop_frame)) AS f FROM clean),
j AS (SELECT fr.*, a.action, row_number() OVER (PARTITION BY fr.video_id, fr.agent_id, fr.target_id, f ORDER BY {order}(a.stop_frame - a.start_frame), a.start_frame DESC, a.action DESC) AS rn
  FROM fr LEFT JOIN (SELECT * FROM ann WHERE stop_frame > start_frame) AS a ON a.video_id = fr.video_id AND a.agent_id = fr.agent_id AND f >= a.start_frame AND f < a.stop_frame AND (a.target_id = fr.target_id OR a.target_id = fr.agent_id))
SELECT coalesce(action, 'background') AS label, count(*) AS n, sum(f)::BIGINT AS s FROM j WHERE rn = 1 GROUP BY ALL"""


def iv_frame_union(spark, d):
    return I.frames_of(_clean(spark, d)).select("video_id", "action", "video_frame").distinct().groupBy("video_id", "action").agg(F.count("*").alias("frames"))


def iv_density_inclusive(spark, d):
    """64 x 64 counts of covered frames, stops included, on clipped coordinates."""
    f = I.frames_of(_clean(spark, d), inclusive=True)
    gx = F.least(F.floor(F.least(F.col("video_frame") / MAX, F.lit(1.0)) * 64), F.lit(63))
    gy = F.least(F.floor(F.least(F.col("video_id") / 1000, F.lit(1.0)) * 64), F.lit(63))
    return f.groupBy(gx.cast("long").alias("gx"), gy.cast("long").alias("gy")).agg(F.count("*").alias("n"))


def iv_action_scores(spark, d):
    return I.action_scores(_solution(spark, d), _submission(spark, d), _active(spark, d)).withColumn("f", F.round("f", 6))


def iv_lab_scores(spark, d):
    return I.lab_scores(_solution(spark, d), _submission(spark, d), _active(spark, d)).withColumn("score", F.round("score", 6))


def iv_official_score(spark, d):
    return I.official_score(_solution(spark, d), _submission(spark, d), _active(spark, d)).withColumn("score", F.round("score", 6))


def iv_self_score(spark, d):
    sol = _solution(spark, d)
    return I.official_score(sol, sol, sol).withColumn("score", F.round("score", 6))


def iv_subset_score(spark, d):
    sol = _solution(spark, d).where("video_id % 2 = 0")
    return I.lab_scores(sol, _submission(spark, d), _active(spark, d), beta=2.0).withColumn("score", F.round("score", 6))


def iv_diagnose(spark, d):
    """Predicted over annotated frames per action, with a verdict."""
    sol, sub = (I.merged(x, [*I.KEY, "action"]).groupBy("action").agg(F.sum(F.col("stop_frame") - F.col("start_frame")).alias(n)) for x, n in ((_clean(spark, d), "true_frames"), (_submission(spark, d).where("action <> 'view'"), "pred_frames")))
    r = sol.join(sub, "action", "full").na.fill(0)
    ratio = F.try_divide(F.col("pred_frames").cast("double"), F.col("true_frames"))
    return r.withColumn("ratio", F.round(ratio, 4)).withColumn("verdict", F.when(F.col("pred_frames") == 0, "dead").when(ratio > 1.05, "over").when(ratio < 0.95, "under").otherwise("ok"))


def iv_train_rates(spark, d):
    """Annotated over covered frames per lab and action."""
    sol = _solution(spark, d)
    cov = sol.groupBy("lab_id", "video_id").agg(F.max("stop_frame").alias("c")).groupBy("lab_id").agg(F.sum("c").alias("c"))
    return sol.groupBy("lab_id", "action").agg(F.sum("duration_frames").alias("n")).join(cov, "lab_id").select("lab_id", "action", "n", F.round(F.try_divide(F.col("n").cast("double"), "c"), 6).alias("rate"))


def iv_build_solution(spark, d):
    """Clipped to each video's coverage, with the video's active triples."""
    a = _clean(spark, d)
    cov = a.where("event_id % 2 = 0").groupBy("video_id").agg(F.max("stop_frame").alias("cover"))
    s = a.join(cov, "video_id").withColumn("stop_frame", F.least("stop_frame", "cover")).where("stop_frame > start_frame")
    triple = F.concat_ws(",", "agent_id", F.when(F.col("agent_id") == F.col("target_id"), "self").otherwise(F.col("target_id").cast("string")), "action")
    return s.groupBy("video_id").agg(F.count("*").alias("n"), F.sum(F.col("stop_frame") - F.col("start_frame")).alias("frames"), F.array_join(F.array_sort(F.collect_set(triple)), ";").alias("active"))


def iv_format_ids(spark, d):
    a = _clean(spark, d)
    return a.select("event_id", F.concat(F.lit("mouse"), "agent_id").alias("agent"), F.when(F.col("target_id") == F.col("agent_id"), "self").otherwise(F.concat(F.lit("mouse"), "target_id")).alias("target"))


def iv_active_guard(spark, d):
    return _submission(spark, d).join(_active(spark, d), [*I.KEY, "action"], "left_semi")


def iv_submission(spark, d):
    """Row ids in key order."""
    return sinks.with_row_ids(_submission(spark, d).distinct())


def iv_submission_checks(spark, d):
    return sinks.checked(sinks.with_row_ids(_submission(spark, d).distinct()))


def iv_greedy_union_revive(spark, d):
    """The submission and, for actions that it lacks in a video, the longest annotation of that action."""
    from pyspark.sql import Window

    sub = _submission(spark, d).where("action <> 'purchase'")
    dead = _clean(spark, d).select("video_id", "action").distinct().join(sub.select("video_id", "action").distinct(), ["video_id", "action"], "left_anti")
    best = _clean(spark, d).join(dead, ["video_id", "action"], "left_semi").withColumn("rn", F.row_number().over(Window.partitionBy("video_id", "action").orderBy(F.desc("duration_frames"), "event_id"))).where("rn <= 2")
    return sub.unionByName(best.select(*sub.columns)).groupBy("action").agg(F.count("*").alias("n"), F.sum("start_frame").alias("s"))


def iv_tracking_missing(spark, d):
    from ..sources.adapters import pose

    return R.missing(ann(spark, d), pose(spark, d), "video_id")


def iv_select_videos(spark, d):
    m = meta_raw(spark, d).select("lab_id", "video_id")
    return R.annotated_videos(m, ann(spark, d), 3).select("lab_id", "video_id", "rn")


def iv_annotations_scan(spark, d):
    m = meta_raw(spark, d).select("lab_id", "video_id")
    a = R.with_duration(ann(spark, d))
    return m.join(a, "video_id", "left").groupBy("lab_id").agg(F.count("event_id").alias("n"), F.sum("duration_frames").alias("frames"), F.count_distinct(F.when(F.col("event_id").isNull(), F.col("video_id"))).alias("videos_without"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("iv_")}
SQL = {
    "iv_clean": f"WITH {CLEAN_SQL} SELECT * FROM clean",
    "iv_clean_report": f"WITH {CLEAN_SQL} SELECT action, count_if(neg)::BIGINT AS negative_start, count_if(ov)::BIGINT AS stop_exceeds_duration, count_if(inv)::BIGINT AS inverted_dropped, count_if(cut)::BIGINT AS overlaps_truncated, count_if(NOT inv AND start_frame >= stop_frame)::BIGINT AS degenerate_dropped, count(*) AS n_before, count_if(NOT inv AND start_frame < stop_frame)::BIGINT AS n_after FROM c4 GROUP BY action",
    "iv_consistency": f"WITH {ANN_SQL}, p AS (SELECT *, lag(stop_frame) OVER (PARTITION BY video_id, agent_id ORDER BY start_frame, stop_frame, event_id) AS b FROM ann) SELECT video_id, count(*) AS n, count_if(start_frame < 0)::BIGINT AS negative_start, count_if(start_frame > stop_frame)::BIGINT AS inverted, count_if(stop_frame > {MAX})::BIGINT AS beyond_end, count_if(start_frame < b)::BIGINT AS overlaps_previous FROM p GROUP BY video_id",
    "iv_bridge": f"WITH {ANN_SQL}, a AS (SELECT *, max(stop_frame) OVER (PARTITION BY video_id, action ORDER BY start_frame, stop_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ann WHERE stop_frame > start_frame), b AS (SELECT *, sum(CASE WHEN r IS NULL OR start_frame - r > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, action ORDER BY start_frame, stop_frame ROWS UNBOUNDED PRECEDING) AS i FROM a) SELECT video_id, action, min(start_frame) AS start_frame, max(stop_frame) AS stop_frame FROM b GROUP BY video_id, action, i",
    "iv_duration_stats": f"WITH {CLEAN_SQL} SELECT video_id % 4 AS lab_id, action, quantile_cont(duration_frames::DOUBLE, 0.1) AS min_dur, quantile_cont(duration_frames::DOUBLE, 0.25) AS max_gap FROM clean GROUP BY ALL",
    "iv_min_duration": f"WITH {CLEAN_SQL}, s AS (SELECT video_id % 4 AS lab_id, action, quantile_cont(duration_frames::DOUBLE, 0.1) AS md, quantile_cont(duration_frames::DOUBLE, 0.25) AS g FROM clean GROUP BY ALL), a AS (SELECT c.*, c.video_id % 4 AS lab_id, md, g, max(stop_frame) OVER (PARTITION BY video_id, agent_id, target_id, c.action ORDER BY start_frame, stop_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM clean AS c JOIN s ON s.lab_id = c.video_id % 4 AND s.action = c.action), b AS (SELECT *, sum(CASE WHEN r IS NULL OR start_frame - r > g THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, agent_id, target_id, action ORDER BY start_frame, stop_frame ROWS UNBOUNDED PRECEDING) AS i FROM a) SELECT lab_id, video_id, agent_id, target_id, action, min(start_frame) AS start_frame, max(stop_frame) AS stop_frame FROM b GROUP BY lab_id, video_id, agent_id, target_id, action, i, md HAVING max(stop_frame) - min(start_frame) >= md",
    "iv_label_longest": _label_sql("-"),
    "iv_label_shortest": _label_sql(""),
    "iv_robustify": f"WITH RECURSIVE {ANN_SQL}, o AS (SELECT video_id, agent_id, target_id, start_frame, stop_frame, action, row_number() OVER (PARTITION BY video_id, agent_id, target_id ORDER BY start_frame, stop_frame, action) AS rn FROM ann WHERE start_frame < stop_frame), r AS (SELECT *, CASE WHEN start_frame >= -1 THEN stop_frame ELSE -1 END AS last, start_frame >= -1 AS k FROM o WHERE rn = 1 UNION ALL SELECT o.*, CASE WHEN o.start_frame >= r.last THEN o.stop_frame ELSE r.last END, o.start_frame >= r.last FROM r JOIN o ON o.video_id = r.video_id AND o.agent_id = r.agent_id AND o.target_id = r.target_id AND o.rn = r.rn + 1) SELECT video_id, agent_id, target_id, start_frame, stop_frame, action FROM r WHERE k",
    "iv_frame_union": f"WITH {CLEAN_SQL} SELECT video_id, action, count(DISTINCT f) AS frames FROM (SELECT video_id, action, unnest(range(start_frame, stop_frame)) AS f FROM clean) GROUP BY ALL",
    "iv_density_inclusive": f"WITH {CLEAN_SQL} SELECT least(floor(least(f / {MAX}, 1.0) * 64), 63)::BIGINT AS gx, least(floor(least(video_id / 1000, 1.0) * 64), 63)::BIGINT AS gy, count(*) AS n FROM (SELECT video_id, unnest(range(start_frame, stop_frame + 1)) AS f FROM clean) GROUP BY ALL",
    "iv_action_scores": f"WITH {SCORE_SQL} SELECT lab_id, action, tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp, round(f, 6) AS f FROM sc",
    "iv_lab_scores": f"WITH {SCORE_SQL} SELECT lab_id, round(avg(f), 6) AS score FROM sc GROUP BY lab_id",
    "iv_official_score": f"WITH {SCORE_SQL} SELECT round(avg(s), 6) AS score FROM (SELECT avg(f) AS s FROM sc GROUP BY lab_id)",
    "iv_self_score": "SELECT 1.0::DOUBLE AS score",
    "iv_subset_score": f"WITH {SCORE_SQL.replace('FROM clean),', 'FROM clean WHERE video_id % 2 = 0),', 1)} SELECT lab_id, round(avg(coalesce(5.0 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0)), 6) AS score FROM sc GROUP BY lab_id",
    "iv_diagnose": f"WITH {SCORE_SQL}, a AS (SELECT action, count(*) AS t FROM (SELECT DISTINCT video_id, agent_id, target_id, action, unnest(range(start_frame, stop_frame)) AS f FROM clean) GROUP BY action), b AS (SELECT action, count(*) AS p FROM (SELECT DISTINCT video_id, agent_id, target_id, action, unnest(range(start_frame, stop_frame)) AS f FROM sub WHERE action <> 'view') GROUP BY action), c AS (SELECT action, coalesce(t, 0) AS true_frames, coalesce(p, 0) AS pred_frames, coalesce(p, 0)::DOUBLE / nullif(coalesce(t, 0), 0) AS q FROM a FULL JOIN b USING (action)) SELECT action, true_frames::BIGINT AS true_frames, pred_frames::BIGINT AS pred_frames, round(q, 4) AS ratio, CASE WHEN pred_frames = 0 THEN 'dead' WHEN q > 1.05 THEN 'over' WHEN q < 0.95 THEN 'under' ELSE 'ok' END AS verdict FROM c",
    "iv_train_rates": f"WITH {SCORE_SQL}, cov AS (SELECT lab_id, sum(c) AS c FROM (SELECT lab_id, video_id, max(stop_frame) AS c FROM sol GROUP BY ALL) GROUP BY lab_id) SELECT lab_id, action, sum(duration_frames)::BIGINT AS n, round(sum(duration_frames)::DOUBLE / any_value(c), 6) AS rate FROM sol JOIN cov USING (lab_id) GROUP BY lab_id, action",
    "iv_build_solution": f"WITH {CLEAN_SQL}, cov AS (SELECT video_id, max(stop_frame) AS c FROM clean WHERE event_id % 2 = 0 GROUP BY video_id), s AS (SELECT clean.*, least(stop_frame, c) AS st FROM clean JOIN cov USING (video_id)) SELECT video_id, count(*) AS n, sum(st - start_frame)::BIGINT AS frames, array_to_string(list_sort(list_distinct(list(agent_id || ',' || CASE WHEN agent_id = target_id THEN 'self' ELSE target_id::VARCHAR END || ',' || action))), ';') AS active FROM s WHERE st > start_frame GROUP BY video_id",
    "iv_format_ids": f"WITH {CLEAN_SQL} SELECT event_id, 'mouse' || agent_id AS agent, CASE WHEN agent_id = target_id THEN 'self' ELSE 'mouse' || target_id END AS target FROM clean",
    "iv_active_guard": f"WITH {SCORE_SQL} SELECT * FROM sub SEMI JOIN active USING (video_id, agent_id, target_id, action)",
    "iv_submission": f"WITH {SCORE_SQL} SELECT row_number() OVER (ORDER BY video_id, agent_id, target_id, start_frame, stop_frame, action) - 1 AS row_id, * FROM (SELECT DISTINCT * FROM sub)",
    "iv_submission_checks": f"WITH {SCORE_SQL} SELECT count_if(stop_frame <= start_frame)::BIGINT AS empty_intervals, 0::BIGINT AS repeated_row_ids, count_if(action IS NULL)::BIGINT AS null_actions FROM sub",
    "iv_greedy_union_revive": f"WITH {SCORE_SQL}, s AS (SELECT * FROM sub WHERE action <> 'purchase'), b AS (SELECT *, row_number() OVER (PARTITION BY video_id, action ORDER BY duration_frames DESC, event_id) AS rn FROM clean ANTI JOIN s USING (video_id, action)), u AS (SELECT action, start_frame FROM s UNION ALL SELECT action, start_frame FROM b WHERE rn <= 2) SELECT action, count(*) AS n, sum(start_frame)::BIGINT AS s FROM u GROUP BY action",
    "iv_tracking_missing": f"WITH {ANN_SQL} SELECT DISTINCT video_id FROM ann WHERE video_id NOT IN (SELECT l_suppkey FROM lineitem)",
    "iv_select_videos": f"WITH {ANN_SQL}, {META_SQL}, r AS (SELECT lab_id, video_id, row_number() OVER (PARTITION BY lab_id ORDER BY video_id)::INT AS rn FROM meta WHERE video_id IN (SELECT video_id FROM ann)) SELECT * FROM r WHERE rn <= 3",
    "iv_annotations_scan": f"WITH {ANN_SQL}, {META_SQL} SELECT lab_id, count(event_id) AS n, sum(stop_frame - start_frame)::BIGINT AS frames, count(DISTINCT CASE WHEN event_id IS NULL THEN meta.video_id END) AS videos_without FROM meta LEFT JOIN ann USING (video_id) GROUP BY lab_id",
}
