"""Intervals of frames: repair, islands, merging, frame labels, and the interval F-beta. Stops are exclusive."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import unbroadcast
from .minimise import changes, whole

KEY = ["video_id", "agent_id", "target_id"]


# ---- repair ----------------------------------------------------------------------------------------------------------


def _repair_steps(ann: DataFrame, max_frame: Column | int | None, group: list[str]) -> DataFrame:
    """ann with the flags of each repair; the steps run in a fixed order: clip, drop inverted, truncate, drop empty."""
    negative = F.col("start_frame") < 0
    over = F.lit(False) if max_frame is None else F.coalesce(F.col("stop_frame") > max_frame, F.lit(False))
    d = ann.withColumns({"_negative": negative, "_over": over})
    d = d.withColumns({"start_frame": F.greatest("start_frame", F.lit(0).cast("long")), "stop_frame": F.col("stop_frame") if max_frame is None else F.least("stop_frame", max_frame if isinstance(max_frame, Column) else F.lit(max_frame).cast("long"))})
    d = d.withColumn("_inverted", F.col("start_frame") > F.col("stop_frame"))
    tie = [c for c in ("stop_frame", "event_id") if c in ann.columns]
    following = F.lead("start_frame").over(Window.partitionBy(*group, "_inverted").orderBy("start_frame", *tie))
    d = d.withColumn("_cut", ~F.col("_inverted") & F.coalesce(F.col("stop_frame") > following, F.lit(False)))
    d = d.withColumn("stop_frame", F.when(F.col("_cut"), following).otherwise(F.col("stop_frame")))
    return d.withColumn("_empty", ~F.col("_inverted") & (F.col("start_frame") >= F.col("stop_frame")))


def clean_annotations(ann: DataFrame, max_frame: Column | int | None = None, group: tuple[str, ...] = ("video_id", "agent_id")) -> DataFrame:
    """Repaired intervals with duration_frames: overlaps of one actor end where the next interval starts."""
    d = _repair_steps(ann, max_frame, list(group)).where("NOT _inverted AND NOT _empty")
    return d.select(*ann.columns, (F.col("stop_frame") - F.col("start_frame")).alias("duration_frames"))


def repair_report(ann: DataFrame, max_frame: Column | int | None = None, group: tuple[str, ...] = ("video_id", "agent_id"), by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each repair, one row (or one per `by`)."""
    d = _repair_steps(ann, max_frame, list(group))
    flags = {"negative_start": "_negative", "stop_exceeds_duration": "_over", "inverted_dropped": "_inverted", "overlaps_truncated": "_cut", "degenerate_dropped": "_empty"}
    left = F.count_if(~F.col("_inverted") & ~F.col("_empty"))
    return d.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in flags.items()], F.count("*").alias("n_before"), left.alias("n_after"))


def consistency(ann: DataFrame, frames_in: Column, by: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Counts of negative starts, inverted and overlong intervals, and overlaps with the previous stop, per video."""
    before = F.lag("stop_frame").over(Window.partitionBy(*by, "agent_id").orderBy("start_frame", "stop_frame", "event_id"))
    d = ann.withColumn("_before", before)
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("start_frame") < 0).alias("negative_start"), F.count_if(F.col("start_frame") > F.col("stop_frame")).alias("inverted"), F.count_if(F.col("stop_frame") > frames_in).alias("beyond_end"), F.count_if(F.col("start_frame") < F.col("_before")).alias("overlaps_previous"))


# ---- islands ---------------------------------------------------------------------------------------------------------


def merged(df: DataFrame, keys: list[str], gap: Column | int = 0, start: str = "start_frame", stop: str = "stop_frame") -> DataFrame:
    """Intervals of each key joined where start - (largest stop so far) <= gap."""
    w = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) - reach > gap), F.lit(True)).cast("int")
    d = df.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_island")


def windows_to_intervals(win: DataFrame, background: str = "background") -> DataFrame:
    """Consecutive windows of one action that touch, per video, agent and target; background windows end a run."""
    w = Window.partitionBy(*KEY).orderBy("start_frame", "window_id")
    d = win.withColumn("_run", F.coalesce((F.col("action") != F.lag("action").over(w)), F.lit(True)).cast("int"))
    d = d.withColumn("_run", F.sum("_run").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("action") != background)
    return merged(d, [*KEY, "action", "_run"]).drop("_run")


def min_duration_filter(sub: DataFrame, stats: DataFrame, keys: tuple[str, ...] = ("lab_id",)) -> DataFrame:
    """Gaps of at most max_gap bridged, then intervals shorter than min_dur dropped; stats: keys, action, min_dur,
    max_gap (0 where missing)."""
    known = sub.join(stats.select(*keys, "action", "min_dur", "max_gap"), [*keys, "action"], "left").na.fill(0.0, ["min_dur", "max_gap"])
    every = [*keys, *KEY, "action", "min_dur", "max_gap"]
    return merged(known, every, F.col("max_gap")).where(F.col("stop_frame") - F.col("start_frame") >= F.col("min_dur")).drop("min_dur", "max_gap")


def duration_stats(ann: DataFrame, *keys: str) -> DataFrame:
    d = ann.where("stop_frame > start_frame").withColumn("d", F.col("stop_frame") - F.col("start_frame"))
    return d.groupBy(*keys).agg(F.percentile("d", F.lit(0.1)).alias("min_dur"), F.percentile("d", F.lit(0.25)).alias("max_gap"))


def robustify(sub: DataFrame) -> DataFrame:
    """Non-empty intervals of each video, agent and target, greedily kept in order if they start at or after the last
    kept stop: a fold over sorted intervals. It starts afresh wherever an interval starts at or after all stops before it,
    so each such island is folded for itself, and arrays stay as short as overlaps are."""
    item = "array<struct<start_frame:bigint,stop_frame:bigint,action:string>>"
    one = F.struct(F.col("start_frame").cast("long").alias("start_frame"), F.col("stop_frame").cast("long").alias("stop_frame"), "action")
    w = Window.partitionBy(*KEY).orderBy("start_frame", "stop_frame", "action")
    reach = F.max("stop_frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = sub.where("start_frame < stop_frame").withColumn("_new", F.coalesce(F.col("start_frame") >= reach, F.lit(True)).cast("int"))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(*KEY, "_island").agg(F.array_sort(F.collect_list(one)).alias("rows"))

    def step(acc, x):
        fits = x["start_frame"] >= acc["last"]
        return F.struct(F.when(fits, x["stop_frame"]).otherwise(acc["last"]).alias("last"), F.when(fits, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"))

    # -1: intervals that start below 0 are not kept, as before the first stop
    kept = F.aggregate("rows", F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast(item).alias("kept")), step, lambda a: a["kept"])
    return g.select(*KEY, F.inline(kept))


def decode_intervals(prob: DataFrame, thresholds: Column, frame: str = "video_frame") -> DataFrame:
    """Intervals from per-frame class probabilities (array p), per video, agent and target; thresholds: an array."""
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    d = prob.withColumn("cls", best).withColumn("cls", F.when(F.array_max("p") >= F.get(thresholds, F.col("cls")), F.col("cls")).otherwise(-1))
    w = Window.partitionBy(*KEY).orderBy(frame)
    d = d.withColumn("_change", F.coalesce(F.col("cls") != F.lag("cls").over(w), F.lit(True))).where("_change")
    d = d.withColumn("stop_frame", F.lead(frame).over(w))
    return d.where("cls >= 0 AND stop_frame IS NOT NULL").select(*KEY, "cls", F.col(frame).alias("start_frame"), "stop_frame")


# ---- frames ----------------------------------------------------------------------------------------------------------


def frames_of(intervals: DataFrame, inclusive: bool = False, name: str = "video_frame") -> DataFrame:
    """One row per covered frame of non-empty intervals. Spark takes them for as few as the intervals: a join of them needs
    the hint of a merge (unbroadcast), or all frames may be broadcast."""
    last = F.col("stop_frame") - (0 if inclusive else 1)
    return intervals.where(last >= F.col("start_frame")).withColumn(name, F.explode(F.sequence(F.col("start_frame"), last)))


def label_frames(frames: DataFrame, ann: DataFrame, precedence: str = "longest", background: str = "background") -> DataFrame:
    """frames (video_id, agent_id, target_id, video_frame) with the action of the covering interval; the longest or the
    shortest one wins, then the later start, then the name. Intervals are exploded to frames, so that the join is on
    equal keys. An interval covers a frame of its agent if the target is the frame's target or the agent itself."""
    if precedence not in ("longest", "shortest"):
        raise ValueError(precedence)
    d = frames_of(ann.withColumn("_len", F.col("stop_frame") - F.col("start_frame"))).select("video_id", "agent_id", F.col("target_id").alias("_target"), "video_frame", "action", "_len", "start_frame")
    both = unbroadcast(frames).join(unbroadcast(d), ["video_id", "agent_id", "video_frame"], "left").withColumn("_fits", (F.col("_target") == F.col("target_id")) | (F.col("_target") == F.col("agent_id")))
    size = F.col("_len") if precedence == "longest" else -F.col("_len")
    picked = F.max_by("action", F.when(F.col("_fits"), F.struct(size, F.col("start_frame"), F.col("action"))))
    return both.groupBy(*frames.columns).agg(F.coalesce(picked, F.lit(background)).alias("label"))


def label_spells(spans: DataFrame, ann: DataFrame, precedence: str = "longest", background: str = "background") -> DataFrame:
    """What label_frames says of the frames that spans (KEY, start_frame, stop_frame) cover, as spells of one label: KEY,
    start_frame, stop_frame, label; spells of a key do not overlap. A sweep over the ends of an agent's intervals, so no
    frame is materialised."""
    if precedence not in ("longest", "shortest"):
        raise ValueError(precedence)
    sign = 1 if precedence == "longest" else -1
    row = lambda df, action: df.where("stop_frame > start_frame").select(*KEY, F.col("start_frame").cast("long"), F.col("stop_frame").cast("long"), action.alias("action"), F.lit(df is spans).alias("asked"))
    every = row(spans, F.lit(None).cast("string")).unionByName(row(ann, F.col("action")))

    def spells(asked: list, known: list):
        """start, stop, action of the frames in asked (start, stop); known: start, stop, order (the least wins), action."""
        points = sorted({p for x in (asked, known) for r in x for p in r[:2]})
        asked, known, heap, a, k, until = sorted(asked), sorted(known, key=lambda r: r[0]), [], 0, 0, None
        for at, to in zip(points, points[1:]):
            while a < len(asked) and asked[a][0] <= at:
                until = asked[a][1] if until is None else max(until, asked[a][1])
                a += 1
            while k < len(known) and known[k][0] <= at:
                heapq.heappush(heap, (known[k][2], known[k][1], known[k][3]))
                k += 1
            while heap and heap[0][1] <= at:
                heapq.heappop(heap)
            if until is not None and at < until:
                yield at, to, heap[0][2] if heap else None

    def of(batches):
        for pdf in whole(batches, ["video_id", "agent_id"]):
            names = sorted(pdf["action"].dropna().unique())
            rank = {n: i for i, n in enumerate(names)}
            new = changes(pdf, ["video_id", "agent_id"])
            starts = [*np.flatnonzero(new), len(pdf)]
            cols = [[None if x is None or x != x else x for x in pdf[c].tolist()] for c in (*KEY, "start_frame", "stop_frame", "action")]
            is_asked = pdf["asked"].tolist()
            out = []
            for i, j in zip(starts, starts[1:]):
                video, agent = cols[0][i], cols[1][i]
                asked: dict = {}
                known: dict = {}
                for r in range(i, j):
                    start, stop, action = cols[3][r], cols[4][r], cols[5][r]
                    if is_asked[r]:
                        asked.setdefault(cols[2][r], []).append((start, stop))
                    elif video is not None and agent is not None and cols[2][r] is not None:
                        known.setdefault(cols[2][r], []).append((start, stop, (-sign * (stop - start), -start, -rank.get(action, -1)), action))
                for target, x in asked.items():
                    near = known.get(agent, []) + (known.get(target, []) if target != agent else [])
                    out += [(video, agent, target, *s) for s in spells(x, near)]
            d = pd.DataFrame(out, columns=[*KEY, "start_frame", "stop_frame", "label"])
            d["label"] = d["label"].where(d["label"].notna(), background)
            yield d.astype({k: "Int64" for k in KEY}) if all(t in ("int", "bigint") for t in kinds) else d

    kinds = [every.schema[k].dataType.simpleString() for k in KEY]
    schema = ", ".join(f"{k} {t}" for k, t in zip(KEY, kinds)) + ", start_frame long, stop_frame long, label string"
    return every.repartition("video_id", "agent_id").sortWithinPartitions("video_id", "agent_id").mapInPandas(of, schema)


def covered(intervals: DataFrame, rows: DataFrame, keys: list[str], inclusive: bool = False, block: int = 64) -> DataFrame:
    """intervals joined with the rows (keys, video_frame and more) of the frames that they cover. Both meet by keys and
    blocks of frames, of which an interval has few: its frames are not materialised."""
    last = F.col("stop_frame") - (0 if inclusive else 1)
    number = lambda c: F.floor(c / block)
    i = intervals.where(last >= F.col("start_frame")).withColumn("_block", F.explode(F.sequence(number(F.col("start_frame")), number(last))))
    both = unbroadcast(i).join(rows.withColumn("_block", number(F.col("video_frame"))), [*keys, "_block"])
    return both.where((F.col("video_frame") >= F.col("start_frame")) & (F.col("video_frame") <= last)).drop("_block")


# ---- score -----------------------------------------------------------------------------------------------------------


def overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Frames in both (tp), only in left (fn), only in right (fp), per key: a sweep over interval ends. No frame is
    materialised, and overlapping intervals of one side count once."""

    def ends(df: DataFrame, l: int, r: int) -> DataFrame:
        d = df.where("stop_frame > start_frame").select(*keys, F.explode(F.array(F.struct(F.col("start_frame").alias("at"), F.lit(1).alias("by")), F.struct(F.col("stop_frame").alias("at"), F.lit(-1).alias("by")))).alias("x"))
        return d.select(*keys, "x.at", (F.col("x.by") * l).alias("l"), (F.col("x.by") * r).alias("r"))

    e = ends(left, 1, 0).unionByName(ends(right, 0, 1)).groupBy(*keys, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    w = Window.partitionBy(*keys).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(*keys, F.sum("l").over(so_far).alias("l"), F.sum("r").over(so_far).alias("r"), (F.lead("at").over(w) - F.col("at")).alias("n"))

    def total(on: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias(name)

    return e.groupBy(*keys).agg(total((F.col("l") > 0) & (F.col("r") > 0), "tp"), total((F.col("l") > 0) & (F.col("r") == 0), "fn"), total((F.col("l") == 0) & (F.col("r") > 0), "fp"))


def action_scores(solution: DataFrame, submission: DataFrame, active: DataFrame, beta: float = 1.0) -> DataFrame:
    """tp, fn, fp and F-beta of each action that the solution of a lab holds. Predictions count only for the solution's
    videos and active (video, agent, target, action)."""
    labs = solution.select("lab_id", "video_id").distinct()
    mine = submission.drop("lab_id").join(active.select(*KEY, "action").distinct(), [*KEY, "action"], "left_semi").join(labs, "video_id")
    keys = ["lab_id", *KEY, "action"]
    each = overlap(solution, mine, keys).groupBy("lab_id", "action").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")])
    each = solution.select("lab_id", "action").distinct().join(each, ["lab_id", "action"], "left").na.fill(0, ["tp", "fn", "fp"])
    b = beta * beta
    f = F.try_divide((1 + b) * F.col("tp"), (1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp"))
    return each.withColumn("f", F.coalesce(f, F.lit(0.0)))


def lab_scores(solution: DataFrame, submission: DataFrame, active: DataFrame, beta: float = 1.0) -> DataFrame:
    return action_scores(solution, submission, active, beta).groupBy("lab_id").agg(F.avg("f").alias("score"))


def official_score(solution: DataFrame, submission: DataFrame, active: DataFrame, beta: float = 1.0) -> DataFrame:
    return lab_scores(solution, submission, active, beta).agg(F.avg("score").alias("score"))
