"""Choosing the decision layer by the interval score: all settings of a grid are scored in one sweep over interval ends.

Predicted intervals carry the settings under which they are predicted (`on`, an array of setting numbers), so the truth is
read once whatever the number of settings: each boundary has one running count per setting, and each stretch between two
boundaries adds its frames to the settings that are on there. Thresholds and settings are small tables, a row per lab."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import decide as D
from . import intervals as I
from .sequence import GRID, viterbi_path

WINDOW = ["lab_id", "video_id", "agent", "target", "window_id", "core_start", "core_stop"]

# ---- the sweep -------------------------------------------------------------------------------------------------------


def swept(solution: DataFrame, predicted: DataFrame, keys: list[str], settings: int) -> DataFrame:
    """keys, held (frames of the solution), tp and pred (arrays by setting): the frames of both sides per key, overlapping
    intervals of one side counted once. predicted: keys, start_frame, stop_frame, on (array<int>). One window per key."""

    def ends(df: DataFrame, on: Column, left: int) -> DataFrame:
        two = F.array(F.struct(F.col("start_frame").alias("at"), F.lit(1).alias("by")), F.struct(F.col("stop_frame").alias("at"), F.lit(-1).alias("by")))
        d = df.where("stop_frame > start_frame").select(*keys, on.alias("on"), F.explode(two).alias("x"))
        return d.select(*keys, "on", "x.at", (F.col("x.by") * left).alias("l"), (F.col("x.by") * (1 - left)).alias("r"))

    e = ends(solution, F.array().cast("array<int>"), 1).unionByName(ends(predicted, F.col("on"), 0))
    each = [F.sum(F.when(F.array_contains("on", s), F.col("r")).otherwise(0)).alias(f"r{s}") for s in range(settings)]
    e = e.groupBy(*keys, "at").agg(F.sum("l").alias("l"), *each)
    w = Window.partitionBy(*keys).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(*keys, (F.lead("at").over(w) - F.col("at")).alias("n"), *[(F.sum(c).over(so_far) > 0).alias(c) for c in ("l", *[f"r{s}" for s in range(settings)])])
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0))
    tp, pred = ([total(F.col(f"r{s}") & more) for s in range(settings)] for more in (F.col("l"), F.lit(True)))
    return e.groupBy(*keys).agg(total(F.col("l")).alias("held"), F.array(*tp).alias("tp"), F.array(*pred).alias("pred"))


def scored(solution: DataFrame, predicted: DataFrame, active: DataFrame, settings: int, beta: float = 1.0) -> DataFrame:
    """lab_id, action, setting, tp, fn, fp, f: as intervals.action_scores, of every setting."""
    labs = solution.select("lab_id", "video_id").distinct()
    mine = predicted.drop("lab_id").join(active.select(*I.KEY, "action").distinct(), [*I.KEY, "action"], "left_semi").join(labs, "video_id")
    each = swept(solution, mine, ["lab_id", *I.KEY, "action"], settings)
    sums = lambda c: F.array(*[F.sum(F.get(c, F.lit(s))) for s in range(settings)]).alias(c)
    each = each.groupBy("lab_id", "action").agg(F.sum("held").alias("held"), sums("tp"), sums("pred"))
    known = solution.select("lab_id", "action").distinct().join(each, ["lab_id", "action"], "left")
    # an action of the solution whose intervals are all empty has no ends
    of = lambda c: F.coalesce(F.get(F.col(c), F.col("setting")), F.lit(0))
    rows = known.withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(settings - 1))))
    rows = rows.select("lab_id", "action", "setting", of("tp").alias("tp"), F.coalesce("held", F.lit(0)).alias("held"), of("pred").alias("pred"))
    rows = rows.select("lab_id", "action", "setting", "tp", (F.col("held") - F.col("tp")).alias("fn"), (F.col("pred") - F.col("tp")).alias("fp"))
    b = beta * beta
    f = F.try_divide((1 + b) * F.col("tp"), (1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp"))
    return rows.withColumn("f", F.coalesce(f, F.lit(0.0)))


def setting_scores(solution: DataFrame, predicted: DataFrame, active: DataFrame, settings: int, beta: float = 1.0) -> DataFrame:
    """lab_id, setting, score: mean F over the lab's actions."""
    return scored(solution, predicted, active, settings, beta).groupBy("lab_id", "setting").agg(F.avg("f").alias("score"))


# ---- windows ---------------------------------------------------------------------------------------------------------


def as_windows(long: DataFrame, active: DataFrame) -> DataFrame:
    """One row a window: WINDOW, p, allowed and own (arrays by class): whether the video annotates the class for the
    window's mice, and whether as directed at oneself. long: WINDOW, cls, p; active: video_id, agent, target (NULL: self),
    cls."""
    own = active.where("target IS NULL").select("video_id", "agent", "cls").distinct().withColumn("own", F.lit(True))
    d = D.active_mask(long, active).join(own, ["video_id", "agent", "cls"], "left")
    values = [c for c in ("p", "q") if c in long.columns]
    each = F.struct("cls", *values, "allowed", F.coalesce("own", F.lit(False)).alias("own"))
    g = d.groupBy(*WINDOW).agg(F.array_sort(F.collect_list(each)).alias("c"))
    return g.select(*WINDOW, *[F.col(f"c.{c}").alias(c) for c in (*values, "allowed", "own")])


def labelled(windows: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Decided windows (cls, own) as intervals of lab_id, KEY, action; windows of the background (class 0) are left out."""
    action = F.get(F.array(*[F.lit(n) for n in names]), F.col("cls"))
    target = F.when(F.get("own", F.col("cls")), F.col("agent")).otherwise(F.col("target"))
    return windows.where("cls > 0").select("lab_id", "video_id", F.col("agent").alias("agent_id"), target.alias("target_id"), action.alias("action"), F.col("core_start").alias("start_frame"), F.col("core_stop").alias("stop_frame"), *more)


def merit(p: str, t: str, mode: str, allowed: str | None) -> Column:
    """Array by class of how far p is above t (difference, or ratio less 1); null for the background and what is not
    allowed."""
    gap = (lambda p, t: p - t) if mode == "residual" else (lambda p, t: p / F.greatest(t, F.lit(1e-6)) - 1)
    m = F.transform(F.zip_with(p, t, gap), lambda g, i: F.when(i > 0, g))
    return F.zip_with(m, allowed, lambda g, a: F.when(a, g)) if allowed else m


def chosen(m: Column) -> Column:
    """The first class of largest merit, if that is above 0; else the background."""
    return F.coalesce(F.get(F.transform(F.array(m), lambda m: F.when(F.array_max(m) > 0, F.array_position(m, F.array_max(m)).cast("int") - 1)), 0), F.lit(0))


def held(spark, by_lab: dict, name: str) -> DataFrame:
    """A driver's table of arrays by lab: a row a lab, so it may be broadcast."""
    kind = "string" if any(isinstance(k, str) for k in by_lab) else "long"
    return F.broadcast(spark.createDataFrame([(k, [float(x) for x in v]) for k, v in by_lab.items()], f"lab_id {kind}, {name} array<double>"))


# ---- thresholds ------------------------------------------------------------------------------------------------------


def value_intervals(windows: DataFrame, k: int, grid: tuple[float, ...], names: list[str], mode: str = "residual", probability: str = "p") -> DataFrame:
    """Predicted intervals with the settings `on` under which they hold, class k's threshold taking each value of grid while
    the others keep theirs. windows: as_windows' with t (array). A window's class is k or its best other class: two rows."""
    others = F.transform(merit(probability, "t", mode, "allowed"), lambda g, i: F.when(i != k, g))
    d = windows.select("*", others.alias("_o")).withColumns({"_other": chosen(F.col("_o")), "_bar": F.greatest(F.array_max("_o"), F.lit(0.0))})
    p = F.get(probability, F.lit(k))
    gap = (lambda v: p - v) if mode == "residual" else (lambda v: p / F.greatest(v, F.lit(1e-6)) - 1)
    # the first class wins a tie: k before a larger number, after a smaller one and after none at all
    beats = lambda v: F.get("allowed", F.lit(k)) & ((gap(v) > F.col("_bar")) | ((gap(v) == F.col("_bar")) & (F.col("_other") > k)))
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(grid)])
    on = F.transform(F.filter(values, lambda s: beats(s["v"])), lambda s: s["i"])
    d = d.withColumn("_on", on)
    rest = F.array_except(F.sequence(F.lit(0), F.lit(len(grid) - 1)), F.col("_on"))
    two = F.array(F.struct(F.lit(k).alias("cls"), F.col("_on").alias("on")), F.struct(F.col("_other").alias("cls"), rest.alias("on")))
    d = d.select(*WINDOW, "own", F.inline(two)).where(F.size("on") > 0)
    return labelled(d, names, "on")


def tuned(windows: DataFrame, solution: DataFrame, active: DataFrame, names: list[str], grid: tuple[float, ...] = GRID, passes: int = 2, mode: str = "residual", start: float = 0.5, probability: str = "p") -> DataFrame:
    """lab_id, cls, t, score: thresholds of each lab by coordinate ascent of its interval score, all labs at once and one
    job for each class and pass, which scores all values of grid. A value replaces the one held if it is better by more
    than 1e-9, so the first such value in grid order; only classes of the lab's solution are tuned, and a lab ends early
    when no class gains. windows: as_windows'; names: the action of each class; solution: lab_id, KEY, action, start_frame,
    stop_frame; active: KEY, action. Labs without windows or without a solution get no rows."""
    spark = windows.sparkSession
    windows, solution = written(windows, "windows"), written(solution.select("lab_id", *I.KEY, "action", "start_frame", "stop_frame"), "solution")
    acts: dict = {}
    for r in solution.select("lab_id", "action").distinct().join(windows.select("lab_id").distinct(), "lab_id", "left_semi").collect():  # a row per lab and class
        acts.setdefault(r["lab_id"], set()).add(r["action"])
    now = {lab: [float(start)] * len(names) for lab in acts}
    best: dict = {}
    live = set(acts)
    for _ in range(passes):
        gained = set()
        for k in range(1, len(names)):
            mine = [lab for lab in live if names[k] in acts[lab]]
            if not mine:
                continue
            d = windows.join(held(spark, {lab: now[lab] for lab in mine}, "t"), "lab_id")
            # one more setting: the value held, which gives the score so far of labs that have none yet
            p = value_intervals(d, k, grid, names, mode, probability).unionByName(_as_held(d, names, mode, probability, len(grid)))
            got = {(r["lab_id"], r["setting"]): r["score"] for r in setting_scores(solution.where(F.col("lab_id").isin(mine)), p, active, len(grid) + 1).collect()}
            for lab in mine:
                score = best.setdefault(lab, got[lab, len(grid)])
                for i, v in enumerate(grid):
                    if got[lab, i] > score + 1e-9:
                        score, now[lab][k] = got[lab, i], float(v)
                if score > best[lab] + 1e-9:
                    best[lab] = score
                    gained.add(lab)
        live = gained
        if not live:
            break
    rows = [(lab, k, now[lab][k], float(best.get(lab, 0.0))) for lab in acts for k in range(len(names))]
    return spark.createDataFrame(rows, f"lab_id {solution.schema['lab_id'].dataType.simpleString()}, cls int, t double, score double")


def _as_held(windows: DataFrame, names: list[str], mode: str, probability: str, setting: int) -> DataFrame:
    """Intervals of the thresholds as they are, on under one setting."""
    d = windows.withColumn("cls", chosen(merit(probability, "t", mode, "allowed"))).withColumn("on", F.array(F.lit(setting)))
    return labelled(d, names, "on")


def prevalence_matched(windows: DataFrame, target: DataFrame, names: list[str], thresholds: DataFrame, grid: tuple[float, ...] = GRID, passes: int = 1, stats: DataFrame | None = None) -> DataFrame:
    """lab_id, cls, t, frames: each class's threshold at which the frames of its predicted intervals come nearest, in
    log1p, to the target (lab_id, action, frames), class by class while the others keep theirs; ties to the first value of
    grid. stats (lab_id, action, min_dur, max_gap): the filter that predictions pass before frames are counted. Classes
    without a target, or with one of 0, keep theirs. thresholds: lab_id, cls, t, a row per lab and class."""
    spark, windows = windows.sparkSession, written(windows, "windows")
    now: dict = {}
    for r in thresholds.orderBy("lab_id", "cls").collect():  # a row per lab and class
        now.setdefault(r["lab_id"], []).append(r["t"])
    want = {(r["lab_id"], r["action"]): r["frames"] for r in target.collect() if r["frames"] > 0}
    frames: dict = {}
    for _ in range(passes):
        for k in range(1, len(names)):
            mine = [lab for lab in now if (lab, names[k]) in want]
            if not mine:
                continue
            p = value_intervals(windows.join(held(spark, {lab: now[lab] for lab in mine}, "t"), "lab_id"), k, grid, names).where(F.col("action") == names[k])
            p = runs(p.withColumn("setting", F.explode("on")).drop("on"), ["setting"])
            if stats is not None:
                p = filtered(p, stats, ["setting"])
            n = p.groupBy("lab_id", "setting").agg(F.sum(F.col("stop_frame") - F.col("start_frame")).alias("n"))
            got = {(r["lab_id"], r["setting"]): r["n"] for r in n.collect()}  # a row per lab and value
            for lab in mine:
                gap = [round(abs(np.log1p(got.get((lab, i), 0)) - np.log1p(want[lab, names[k]])), 9) for i in range(len(grid))]
                i = int(np.argmin(gap))
                now[lab][k], frames[lab, k] = float(grid[i]), int(got.get((lab, i), 0))
    rows = [(lab, k, t, frames.get((lab, k))) for lab, ts in now.items() for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, f"lab_id {windows.schema['lab_id'].dataType.simpleString()}, cls int, t double, frames long")


# ---- the grid of settings --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Setting:
    """One arm of the decision layer. weight: of the emissions in Viterbi decoding, with mode `ratio`; None: each window
    for itself."""

    mask: bool
    smooth: bool
    mode: str
    filtered: bool
    weight: float | None = None


def settings(masks: Iterable[bool] = (False, True), smooths: Iterable[bool] = (False, True), modes: Iterable[str] = ("residual", "ratio"), filters: Iterable[bool] = (False, True), weights: Iterable[float] = ()) -> list[Setting]:
    """All arms, those of Viterbi (always masked) last."""
    out = [Setting(*x) for x in product(masks, smooths, modes, filters)]
    return out + [Setting(True, s, "ratio", f, float(w)) for w, s, f in product(weights, smooths, filters)]


def runs(sub: DataFrame, more: list[str]) -> DataFrame:
    """Intervals of one key and action that touch or overlap become one."""
    return I.merged(sub, ["lab_id", *more, *I.KEY, "action"])


def filtered(sub: DataFrame, stats: DataFrame, more: list[str]) -> DataFrame:
    """intervals.min_duration_filter of every value of the columns in more at once."""
    known = sub.join(stats.select("lab_id", "action", "min_dur", "max_gap"), ["lab_id", "action"], "left").na.fill(0.0, ["min_dur", "max_gap"])
    m = I.merged(known, ["lab_id", *more, *I.KEY, "action", "min_dur", "max_gap"], F.col("max_gap"))
    return m.where(F.col("stop_frame") - F.col("start_frame") >= F.col("min_dur")).drop("min_dur", "max_gap")


def decisions(windows: DataFrame, arms: list[Setting], trans: DataFrame | None = None) -> tuple[DataFrame, list[Setting]]:
    """(windows with arm and cls, a row per window and arm that differs before the filter; those arms). windows:
    as_windows' with q (smoothed p) and t, and for smoothed arms tq (thresholds tuned on q; t, if there is none)."""
    before = list(dict.fromkeys(Setting(a.mask, a.smooth, a.mode, False, a.weight) for a in arms))
    t = {False: "t", True: "tq" if "tq" in windows.columns else "t"}
    plain = [(i, a) for i, a in enumerate(before) if a.weight is None]
    each = [F.struct(F.lit(i).alias("arm"), chosen(merit("q" if a.smooth else "p", t[a.smooth], a.mode, "allowed" if a.mask else None)).alias("cls")) for i, a in plain]
    keep = [*WINDOW, "own"]
    out = windows.select(*keep, F.inline(F.array(*each))) if each else None
    joint = [(i, a.smooth, a.weight) for i, a in enumerate(before) if a.weight is not None]
    if joint:
        v = decoded(windows, trans, joint, t)
        v = windows.select(*keep).join(v, ["window_id"]).select(*keep, "arm", "cls")
        out = v if out is None else out.unionByName(v)
    return out, before


def decoded(windows: DataFrame, trans: DataFrame, arms: list[tuple[int, bool, float]], thresholds: dict[bool, str]) -> DataFrame:
    """window_id, arm, cls: the best path of each (video_id, agent) under each arm (number, smoothed, weight of emissions),
    with the lab's transitions (lab_id, a, b, lp); groups are as long as one video, and all arms are decoded in one call."""
    classes = F.array_sort(F.collect_list(F.struct("a", "b", "lp")))
    flat = trans.groupBy("lab_id").agg(classes.alias("x")).select("lab_id", F.col("x.lp").alias("lp"))
    d = windows.join(F.broadcast(flat), "lab_id")  # a row a lab

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["core_start", "window_id"])
        lp = np.array(pdf["lp"].iloc[0], float)
        lp = lp.reshape(int(round(len(lp) ** 0.5)), -1)
        out = ~np.stack(pdf["allowed"]).astype(bool)
        out[:, 0] = False
        rows = []
        for arm, smooth, weight in arms:
            p, t = np.stack(pdf["q" if smooth else "p"]).astype(float), np.stack(pdf[thresholds[smooth]]).astype(float)
            e = np.log(np.maximum(p, 1e-12)) - np.log(np.maximum(t, 1e-6))
            e[:, 0] = 0
            e[out] = -1e9
            rows.append(pd.DataFrame({"window_id": pdf["window_id"], "arm": arm, "cls": viterbi_path(weight * e, lp)}))
        return pd.concat(rows)

    columns = dict.fromkeys(["video_id", "agent", "window_id", "core_start", "p", "q", "allowed", "lp", *thresholds.values()])
    return d.select(*columns).groupBy("video_id", "agent").applyInPandas(of, "window_id long, arm int, cls int")


def arm_intervals(windows: DataFrame, arms: list[Setting], names: list[str], stats: DataFrame, trans: DataFrame | None = None) -> DataFrame:
    """Predicted intervals of all arms, each with the arms `on` under which it is predicted."""
    each, before = decisions(windows, arms, trans)
    number = {(a.mask, a.smooth, a.mode, a.filtered, a.weight): i for i, a in enumerate(arms)}
    at = lambda f: F.get(F.array(*[F.lit(number.get((b.mask, b.smooth, b.mode, f, b.weight))).cast("int") for b in before]), F.col("arm"))
    r = written(runs(labelled(each, names, "arm"), ["arm"]), "runs")
    both = r.withColumn("on", at(False)).unionByName(filtered(r, stats, ["arm"]).withColumn("on", at(True)))
    return both.where("on IS NOT NULL").select("lab_id", *I.KEY, "action", "start_frame", "stop_frame", F.array("on").alias("on"))


def arm_scores(windows: DataFrame, solution: DataFrame, active: DataFrame, arms: list[Setting], names: list[str], stats: DataFrame, trans: DataFrame | None = None) -> DataFrame:
    """lab_id, mask, smooth, mode, filtered, weight (null: no Viterbi), score: the interval score of every arm per lab."""
    s = setting_scores(solution, arm_intervals(windows, arms, names, stats, trans), active, len(arms))
    what = windows.sparkSession.createDataFrame([(i, a.mask, a.smooth, a.mode, a.filtered, a.weight) for i, a in enumerate(arms)], "setting int, mask boolean, smooth boolean, mode string, filtered boolean, weight double")
    return s.join(F.broadcast(what), "setting").drop("setting")  # a row per arm


def best_arms(scores: DataFrame) -> DataFrame:
    """The best arm of each lab; of equal ones the plainest: no Viterbi, no filter, not smoothed, the first mode by name,
    the mask."""
    w = Window.partitionBy("lab_id").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_first("weight"), "filtered", "smooth", "mode", F.desc("mask"))
    return scores.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
