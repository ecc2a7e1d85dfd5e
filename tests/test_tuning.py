"""Tuning by the interval score against plain Python over frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethogrid.operators import sequence as S
from ethogrid.operators import tuning as T

NAMES = ["background", "c1", "c2", "c3"]
SOL = "lab_id long, video_id long, agent_id int, target_id int, action string, start_frame long, stop_frame long"


@pytest.fixture(scope="module")
def study(spark):
    """Windows of 2 labs, 2 videos each, agents 1 and 2, 3 classes; class 3 is directed at oneself; video 3 lacks class 2."""
    rng = random.Random(5)
    rows, truth = [], []
    for v in range(4):
        for agent in (1, 2):
            for i in range(30):
                raw = [rng.random() ** 2 for _ in NAMES]
                p = [x / sum(raw) for x in raw]
                allowed = [True, True, v != 3, True]
                rows.append((v % 2, v, agent, 3 - agent, len(rows), 8 * i, 8 * i + 8, p, allowed, [False, False, False, True]))
                k = max(range(4), key=lambda j: p[j] + 0.3 * rng.random())
                if k:
                    truth.append((v % 2, v, agent, agent if k == 3 else 3 - agent, NAMES[k], 8 * i + rng.randint(0, 3), 8 * i + rng.randint(3, 9)))
    windows = spark.createDataFrame(rows, "lab_id long, video_id long, agent int, target int, window_id long, core_start long, core_stop long, p array<double>, allowed array<boolean>, own array<boolean>")
    active = spark.createDataFrame([(v, a, a if k == 3 else 3 - a, NAMES[k]) for v in range(4) for a in (1, 2) for k in (1, 2, 3) if (v, k) != (3, 2)], "video_id long, agent_id int, target_id int, action string")
    return rows, truth, windows, spark.createDataFrame(truth, SOL), active


def brute_decide(row, t, mode="residual"):
    p, allowed = row[7], row[8]
    best = None
    for k in range(1, len(p)):
        gap = p[k] - t[k] if mode == "residual" else p[k] / max(t[k], 1e-6) - 1
        if allowed[k] and gap > 0 and (best is None or gap > best[0]):
            best = (gap, k)
    return best[1] if best else 0


def brute_score(lab, truth, rows, decided):
    frames = lambda x: set(range(x[-2], x[-1]))
    have, want = {}, {}
    for r in truth:
        if r[0] == lab:
            want.setdefault(r[4], set()).update((r[1], r[2], r[3], f) for f in frames(r))
    for r, k in zip(rows, decided):
        if r[0] == lab and k and r[8][k]:
            have.setdefault(NAMES[k], set()).update((r[1], r[2], r[2] if r[9][k] else r[3], f) for f in range(r[5], r[6]))
    one = [2 * len(want[a] & have.get(a, set())) / (len(want[a]) + len(have.get(a, ()))) if want[a] or have.get(a) else 0 for a in want]
    return sum(one) / len(one)


def test_sweep_of_many_settings(spark):
    rng = random.Random(1)
    part = lambda: (rng.randint(0, 2), (s := rng.randint(0, 60)), s + rng.randint(-2, 15))
    left, right = [part() for _ in range(30)], [(*part(), rng.sample(range(5), rng.randint(0, 5))) for _ in range(60)]
    kind = "k int, start_frame long, stop_frame long"
    got = {r.k: r for r in T.swept(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind + ", on array<int>"), ["k"], 5).collect()}
    for k in range(3):
        a = {f for x, s, e in left if x == k for f in range(s, e)}
        b = [{f for x, s, e, on in right if x == k and n in on for f in range(s, e)} for n in range(5)]
        assert (got[k].held, got[k].tp, got[k].pred) == (len(a), [len(a & x) for x in b], [len(x) for x in b])
    assert T.swept(spark.createDataFrame([], kind), spark.createDataFrame([], kind + ", on array<int>"), ["k"], 5).count() == 0


@pytest.mark.parametrize("mode", ["residual", "ratio"])
def test_every_value_of_a_threshold(spark, study, mode):
    rows, truth, windows, sol, active = study
    grid, t = (0.05, 0.2, 0.35, 0.6), [0.5, 0.3, 0.25, 0.2]
    w = windows.withColumn("t", F.array(*map(F.lit, t)))
    for k in (1, 2, 3):
        got = {(r.lab_id, r.setting): r.score for r in T.setting_scores(sol, T.value_intervals(w, k, grid, NAMES, mode), active, len(grid)).collect()}
        for i, v in enumerate(grid):
            tt = [v if j == k else x for j, x in enumerate(t)]
            for lab in (0, 1):
                assert got[lab, i] == pytest.approx(brute_score(lab, truth, rows, [brute_decide(r, tt, mode) for r in rows]))


def test_a_tie_goes_to_the_first_class(spark, study):
    *_, windows, sol, active = study
    one = windows.limit(1).withColumns({"p": F.array(*map(F.lit, [0.1, 0.3, 0.3, 0.3])), "allowed": F.array(*[F.lit(True)] * 4), "t": F.array(*map(F.lit, [0.5, 0.2, 0.2, 0.2]))})
    for k, want in ((1, {("c1", 0), ("c1", 1), ("c2", 2)}), (2, {("c2", 0), ("c1", 1), ("c1", 2)}), (3, {("c3", 0), ("c1", 1), ("c1", 2)})):
        got = T.value_intervals(one, k, (0.1, 0.2, 0.3), NAMES).withColumn("s", F.explode("on")).collect()
        assert {(r.action, r.s) for r in got} == want


def test_coordinate_ascent(spark, study):
    rows, truth, windows, sol, active = study
    grid = (0.1, 0.2, 0.3, 0.45, 0.7)
    got = T.tuned(windows, sol, active, NAMES, grid, passes=2).collect()
    for lab in (0, 1):
        t = [0.5] * 4
        score = lambda t: brute_score(lab, truth, rows, [brute_decide(r, t) for r in rows])  # noqa: B023, E731
        best = score(t)
        first = best
        for _ in range(2):
            was = best
            for k in (1, 2, 3):
                if not any(r[0] == lab and r[4] == NAMES[k] for r in truth):
                    continue
                keep, top = t[k], best
                for v in grid:
                    if (s := score([v if j == k else x for j, x in enumerate(t)])) > top + 1e-9:
                        top, keep = s, v
                t[k] = keep
                best = max(best, top)
            if best <= was + 1e-9:
                break
        mine = sorted((r.cls, r.t, r.score) for r in got if r.lab_id == lab)
        assert [x[1] for x in mine] == t and mine[0][2] == pytest.approx(best) and best > first
    assert T.tuned(windows.limit(0), sol, active, NAMES, grid).count() == 0


def test_arms(spark, study):
    """Arms of the grid equal the same arm alone; Viterbi with even transitions and weight 1 equals the ratio rule."""
    rows, truth, windows, sol, active = study
    w = windows.withColumns({"t": F.array(*map(F.lit, [0.5, 0.3, 0.25, 0.2])), "q": F.reverse("p")})
    stats = sol.groupBy("lab_id", "action").agg(F.lit(10.0).alias("min_dur"), F.lit(8.0).alias("max_gap"))
    even = spark.createDataFrame([(lab, a, b, -1.0) for lab in (0, 1) for a in range(4) for b in range(4)], "lab_id long, a int, b int, lp double")
    arms = T.settings(weights=(1.0, 0.25))
    got = T.arm_scores(w, sol, active, arms, NAMES, stats, even).collect()
    by = {(r.lab_id, r.mask, r.smooth, r.mode, r.filtered, r.weight): r.score for r in got}
    assert len(by) == 2 * len(arms) == 48
    for lab in (0, 1):
        assert by[lab, True, False, "residual", False, None] == pytest.approx(brute_score(lab, truth, rows, [brute_decide(r, [0.5, 0.3, 0.25, 0.2]) for r in rows]))
        for smooth in (False, True):
            for f in (False, True):
                assert by[lab, True, smooth, "ratio", f, None] == pytest.approx(by[lab, True, smooth, "ratio", f, 1.0])
        assert any(by[lab, True, s, m, False, None] != by[lab, True, s, m, True, None] for s in (False, True) for m in ("residual", "ratio"))
    for arm in (T.Setting(False, True, "residual", True), T.Setting(True, True, "ratio", True, 0.25)):
        for r in T.arm_scores(w, sol, active, [arm], NAMES, stats, even).collect():
            assert r.score == pytest.approx(by[r.lab_id, arm.mask, arm.smooth, arm.mode, arm.filtered, arm.weight])
    best = {r.lab_id: r.score for r in T.best_arms(spark.createDataFrame(got)).collect()}
    assert all(best[lab] == max(v for k, v in by.items() if k[0] == lab) for lab in (0, 1))


def test_strong_transitions_smooth_the_path(spark, study):
    *_, windows, sol, active = study
    w = windows.withColumns({"t": F.array(*[F.lit(0.25)] * 4), "q": F.col("p")})
    sticky = spark.createDataFrame([(lab, a, b, float(np.log(0.97 if a == b else 0.01))) for lab in (0, 1) for a in range(4) for b in range(4)], "lab_id long, a int, b int, lp double")
    d, before = T.decisions(w, T.settings(masks=(True,), smooths=(False,), filters=(False,), weights=(0.5,)), sticky)
    changes = {a: sum(x != y for x, y in zip(c, c[1:])) for a, c in {r.arm: r.c for r in d.groupBy("arm").agg(F.transform(F.array_sort(F.collect_list(F.struct("window_id", "cls"))), lambda s: s["cls"]).alias("c")).collect()}.items()}
    path = [i for i, a in enumerate(before) if a.weight][0]
    assert changes[path] < changes[0] / 2
    first = windows.where("video_id = 0 AND agent = 1").orderBy("core_start").collect()
    e = np.array([[0.0 if k == 0 else np.log(max(x, 1e-12)) - np.log(0.25) for k, x in enumerate(r.p)] for r in first])
    lp = np.where(np.eye(4) > 0, np.log(0.97), np.log(0.01))
    want = dict(zip([r.window_id for r in first], S.viterbi_path(0.5 * e, lp).tolist()))
    assert {r.window_id: r.cls for r in d.where(F.col("arm") == path).collect() if r.window_id in want} == want
