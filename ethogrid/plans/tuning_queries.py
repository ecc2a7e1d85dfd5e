"""Queries on tuning by the interval score, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import intervals as I
from ..operators import sequence as S
from ..operators import tuning as T
from ..sources.adapters import proba, proba_long
from .quality_queries import _ACT, _PS, _active, _r6, _savgol_sql, _thresholds, W, r6

NAMES = ["background", *(f"c{k}" for k in range(1, 10))]
TUNED = 3  # the class whose values tn_value_scores compares


def _truth(spark, d):
    """True intervals: those of the windows' classes, with ends moved a little."""
    own = _active(spark, d).where("target IS NULL").select("video_id", "agent", F.col("cls").alias("y")).withColumn("own", F.lit(True))
    p = proba(spark, d).where("y > 0").join(own, ["video_id", "agent", "y"], "left")
    target = F.when(F.col("own"), F.col("agent")).otherwise(F.col("target"))
    return p.select("lab_id", "video_id", F.col("agent").alias("agent_id"), target.alias("target_id"), F.concat(F.lit("c"), F.col("y").cast("string")).alias("action"), (F.col("core_start") + F.col("window_id") % 3).alias("start_frame"), (F.col("core_stop") - F.col("window_id") % 2).alias("stop_frame"))


def _scorable(spark, d):
    a = _active(spark, d)
    return a.select("video_id", F.col("agent").alias("agent_id"), F.coalesce("target", "agent").alias("target_id"), F.concat(F.lit("c"), F.col("cls").cast("string")).alias("action"))


def _per_lab(spark, d):
    return _thresholds(spark, d).groupBy("lab_id").agg(F.array_sort(F.collect_list(F.struct("cls", "t"))).alias("x")).select("lab_id", F.col("x.t").alias("t"))


def _windows(spark, d):
    """Windows with p, q (smoothed) and the thresholds of their lab."""
    long = proba_long(proba(spark, d))
    q = D.smoothed(long).select("window_id", "cls", F.col("p").alias("q"))
    w = T.as_windows(long.join(q, ["window_id", "cls"]), _active(spark, d))
    return w.join(F.broadcast(_per_lab(spark, d)), "lab_id")  # a row a lab


def _stats(spark, d):
    return I.duration_stats(_truth(spark, d), "lab_id", "action")


def _trans(spark, d):
    """Class transitions of each lab."""
    t = [S.transition_log_probs(proba(spark, d).where(F.col("lab_id") == lab).select("video_id", "agent", "core_start", "window_id", F.col("y").cast("int").alias("cls")), ["video_id", "agent"], ["core_start", "window_id"], 10).withColumn("lab_id", F.lit(lab).cast("long")) for lab in range(4)]
    return t[0].unionByName(t[1]).unionByName(t[2]).unionByName(t[3])


def tn_value_scores(spark, d):
    """Each lab's interval score for every value of one class's threshold, in one sweep."""
    p = T.value_intervals(_windows(spark, d), TUNED, S.GRID, NAMES)
    s = T.setting_scores(_truth(spark, d), p, _scorable(spark, d), len(S.GRID))
    return _r6(s.select("lab_id", F.get(F.array(*[F.lit(v) for v in S.GRID]), F.col("setting")).alias("t"), "score"))


def tn_value_counts(spark, d):
    """tp, fn and fp behind these scores, for the ratio rule."""
    p = T.value_intervals(_windows(spark, d), TUNED, S.GRID[::5], NAMES, "ratio")
    return T.scored(_truth(spark, d), p, _scorable(spark, d), len(S.GRID[::5])).select("lab_id", "action", "setting", "tp", "fn", "fp")


def tn_thresholds(spark, d):
    """Thresholds per lab and class by coordinate ascent of the interval score."""
    return _r6(T.tuned(_windows(spark, d).drop("t"), _truth(spark, d), _scorable(spark, d), NAMES, S.GRID[::3], passes=1))


def tn_arm_scores(spark, d):
    """Each lab's interval score under mask x smoothing x rule x duration filter."""
    s = T.arm_scores(_windows(spark, d), _truth(spark, d), _scorable(spark, d), T.settings(), NAMES, _stats(spark, d))
    return _r6(s.drop("weight"))


def _viterbi_arms(spark, d):
    return T.arm_scores(_windows(spark, d), _truth(spark, d), _scorable(spark, d), T.settings(weights=(0.5, 1.0)), NAMES, _stats(spark, d), _trans(spark, d))


def tn_viterbi_arms(spark, d):
    """The same with Viterbi decoding under two weights beside."""
    return _r6(_viterbi_arms(spark, d))


def tn_best_arms(spark, d):
    return _r6(T.best_arms(T.arm_scores(_windows(spark, d), _truth(spark, d), _scorable(spark, d), T.settings(), NAMES, _stats(spark, d)))).drop("weight")


def tn_prevalence(spark, d):
    """Thresholds at which decoded, filtered frames match those of the truth."""
    target = _truth(spark, d).groupBy("lab_id", "action").agg(F.sum(F.col("stop_frame") - F.col("start_frame")).alias("frames"))
    w = _windows(spark, d)
    return _r6(T.prevalence_matched(w.drop("t"), target.where(F.col("action") == f"c{TUNED}"), NAMES, _thresholds(spark, d), stats=_stats(spark, d)))


QUERIES = {k: v for k, v in globals().items() if k[:3] == "tn_"}

# ---- SQL ----

_GRID = ", ".join(map(repr, S.GRID))
_TRUE = """own AS (SELECT DISTINCT video_id, agent, cls FROM act WHERE target IS NULL),
truth AS (SELECT lab_id, p.video_id, p.agent, CASE WHEN own.cls IS NOT NULL THEN p.agent ELSE p.target END AS target, 'c' || y AS action, core_start + window_id % 3 AS a, core_stop - window_id % 2 AS b
  FROM proba AS p LEFT JOIN own ON own.video_id = p.video_id AND own.agent = p.agent AND own.cls = p.y WHERE y > 0),
scorable AS (SELECT DISTINCT video_id, agent, coalesce(target, agent) AS target, 'c' || cls AS action FROM act),
st AS (SELECT lab_id, action, quantile_cont((b - a)::DOUBLE, 0.1) AS md, quantile_cont((b - a)::DOUBLE, 0.25) AS mg FROM truth WHERE b > a GROUP BY ALL)"""
#: dec (s, window_id, lab_id, video_id, agent, target, core_start, core_stop, cls) to pred, then counts and scores by setting s.
_ROUTED = """pred AS (SELECT s, lab_id, dec.video_id, dec.agent, CASE WHEN own.cls IS NOT NULL THEN dec.agent ELSE dec.target END AS target, 'c' || dec.cls AS action, core_start AS a, core_stop AS b
  FROM dec LEFT JOIN own ON own.video_id = dec.video_id AND own.agent = dec.agent AND own.cls = dec.cls WHERE dec.cls > 0)"""
_RUNS = lambda src, gap, to: f"""{to}0 AS (SELECT *, max(b) OVER (PARTITION BY s, lab_id, video_id, agent, target, action ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
{to}1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY s, lab_id, video_id, agent, target, action ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM {to}0)"""  # noqa: E731
_FILTER = f"""{_RUNS('pred', '0', 'u')}, ur AS (SELECT s, lab_id, video_id, agent, target, action, min(a) AS a, max(b) AS b FROM u1 GROUP BY s, lab_id, video_id, agent, target, action, island),
us AS (SELECT ur.*, coalesce(md, 0) AS md, coalesce(mg, 0) AS mg FROM ur LEFT JOIN st USING (lab_id, action)), {_RUNS('us', 'mg', 'v')},
kept AS (SELECT s, lab_id, video_id, agent, target, action, min(a) AS a, max(b) AS b FROM v1 GROUP BY s, lab_id, video_id, agent, target, action, island, md HAVING max(b) - min(a) >= md)"""
_COUNTS = """lf AS (SELECT DISTINCT lab_id, video_id, agent, target, action, unnest(range(a, b)) AS fr FROM truth),
pf AS (SELECT DISTINCT s, lab_id, video_id, agent, target, action, unnest(range(a, b)) AS fr FROM pred SEMI JOIN scorable USING (video_id, agent, target, action) SEMI JOIN truth USING (video_id)),
hit AS (SELECT s, lab_id, action, count(*) AS n, count_if(lf.fr IS NOT NULL) AS tp FROM pf LEFT JOIN lf USING (lab_id, video_id, agent, target, action, fr) GROUP BY ALL),
sol AS (SELECT lab_id, action, count(*) AS held FROM lf GROUP BY ALL),
cnt AS (SELECT s, lab_id, action, coalesce(tp, 0) AS tp, held - coalesce(tp, 0) AS fn, coalesce(n, 0) - coalesce(tp, 0) AS fp FROM sol CROSS JOIN every LEFT JOIN hit USING (s, lab_id, action))"""
_SCORE = "SELECT lab_id, s, avg(coalesce(2.0 * tp / nullif(2 * tp + fn + fp, 0), 0)) AS score FROM cnt GROUP BY ALL"


def _values(rule: str, grid: str) -> str:
    """dec by the values of class TUNED's threshold."""
    return f"""{_ACT}, {_TRUE}, every AS (SELECT (unnest(range(0, len(x))))::INT AS s, unnest(x)::DOUBLE AS v FROM (SELECT [{grid}] AS x)),
av AS (SELECT al.*, s, CASE WHEN al.cls = {TUNED} THEN v ELSE t END AS t FROM al JOIN thr ON thr.lab_id = al.lab_id AND thr.cls = al.cls, every),
dd AS (SELECT *, row_number() OVER (PARTITION BY window_id, s ORDER BY (CASE WHEN allowed AND cls <> 0 THEN {rule} END) DESC NULLS LAST, cls) AS rn FROM av),
dec AS (SELECT s, window_id, lab_id, video_id, agent, target, core_start, core_stop, CASE WHEN allowed AND cls <> 0 AND {rule} > 0 THEN cls ELSE 0 END AS cls FROM dd WHERE rn = 1), {_ROUTED}"""


_RATIO = "p / greatest(t, 1e-6) - 1"
_SV = _savgol_sql("p", 9, 2).replace(W, "OVER (PARTITION BY video_id, agent, cls ORDER BY core_start, window_id)")
_ARMS = f"""{_ACT}, {_PS.replace(_PS[: _PS.index(', ps AS') + 2], '')}, sq AS (SELECT window_id, cls, coalesce({_SV}, 0) AS q FROM ps), {_TRUE},
arm AS (SELECT mask, smooth, mode, (row_number() OVER (ORDER BY mask, smooth, mode) - 1)::INT AS s FROM (SELECT unnest([false, true]) AS mask), (SELECT unnest([false, true]) AS smooth), (SELECT unnest(['residual', 'ratio']) AS mode)),
ap AS (SELECT al.* EXCLUDE (p), arm.s, (allowed OR NOT mask) AND al.cls <> 0 AS ok, CASE WHEN mode = 'residual' THEN (CASE WHEN smooth THEN q ELSE p END) - t ELSE (CASE WHEN smooth THEN q ELSE p END) / greatest(t, 1e-6) - 1 END AS m
  FROM al JOIN sq ON sq.window_id = al.window_id AND sq.cls = al.cls JOIN thr ON thr.lab_id = al.lab_id AND thr.cls = al.cls, arm),
dd AS (SELECT *, row_number() OVER (PARTITION BY window_id, s ORDER BY (CASE WHEN ok THEN m END) DESC NULLS LAST, cls) AS rn FROM ap),
dec AS (SELECT s, window_id, lab_id, video_id, agent, target, core_start, core_stop, CASE WHEN ok AND m > 0 THEN cls ELSE 0 END AS cls FROM dd WHERE rn = 1),
{_ROUTED.replace('pred AS', 'plain AS')}, {_FILTER.replace('FROM pred', 'FROM plain')},
pred AS (SELECT 2 * s AS s, lab_id, video_id, agent, target, action, a, b FROM plain UNION ALL SELECT 2 * s + 1, lab_id, video_id, agent, target, action, a, b FROM kept),
every AS (SELECT unnest(range(0, 16))::INT AS s), {_COUNTS},
sc AS ({_SCORE}), arms AS (SELECT lab_id, mask, smooth, mode, sc.s % 2 = 1 AS filtered, score FROM sc JOIN arm ON arm.s = sc.s // 2)"""
SQL = {
    "tn_value_scores": f"WITH {_values('p - t', _GRID)}, {_COUNTS}, sc AS ({_SCORE}) SELECT lab_id, v AS t, {r6('score', 'score')} FROM sc JOIN every USING (s)",
    "tn_value_counts": f"WITH {_values(_RATIO, ', '.join(map(repr, S.GRID[::5])))}, {_COUNTS} SELECT lab_id, action, s AS setting, tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp FROM cnt",
    "tn_arm_scores": f"WITH {_ARMS} SELECT lab_id, mask, smooth, mode, filtered, {r6('score', 'score')} FROM arms",
    "tn_best_arms": f"WITH {_ARMS} SELECT lab_id, mask, smooth, mode, filtered, {r6('score', 'score')} FROM arms QUALIFY row_number() OVER (PARTITION BY lab_id ORDER BY round(score, 9) DESC, filtered, smooth, mode, mask DESC) = 1",
    "tn_prevalence": f"""WITH {_values('p - t', _GRID).replace('WHERE dec.cls > 0', f'WHERE dec.cls = {TUNED}')}, {_FILTER},
n AS (SELECT lab_id, s, sum(b - a) AS n FROM kept GROUP BY ALL), want AS (SELECT lab_id, sum(b - a) AS w FROM truth WHERE action = 'c{TUNED}' GROUP BY lab_id HAVING sum(b - a) > 0),
g AS (SELECT lab_id, v AS t, coalesce(n, 0) AS frames FROM want CROSS JOIN every LEFT JOIN n USING (lab_id, s) QUALIFY row_number() OVER (PARTITION BY lab_id ORDER BY round(abs(ln(1 + coalesce(n, 0)) - ln(1 + w)), 9), s) = 1)
SELECT thr.lab_id, thr.cls, {r6(f'CASE WHEN thr.cls = {TUNED} AND g.t IS NOT NULL THEN g.t ELSE thr.t END', 't')}, CASE WHEN thr.cls = {TUNED} THEN g.frames END::BIGINT AS frames FROM thr LEFT JOIN g USING (lab_id)""",
}
