"""Interval repair, merging and the interval F-beta on cases worked out by hand, and against sets of frames."""

import random

import pytest

from ethogrid.operators import intervals as I

ANN = "agent_id int, action string, start_frame long, stop_frame long"
SOL = "lab_id string, video_id long, agent_id string, target_id string, action string, start_frame long, stop_frame long"


def test_repair(spark):
    """Of mouse 7: one starts before the video, one runs into the next, one is beyond the end. Of mouse 8: one is inverted,
    two touch, one starts where the next one does."""
    rows = [(7, "dig", -12, 33), (7, "rear", 30, 81), (7, "dig", 300, 999), (8, "rear", 90, 70), (8, "dig", 5, 25), (8, "rear", 25, 26), (8, "dig", 140, 160), (8, "rear", 140, 170)]
    df = spark.createDataFrame(rows, ANN)
    r = I.repair_report(df, 350, ("agent_id",)).first()
    assert (r.negative_start, r.stop_exceeds_duration, r.inverted_dropped, r.overlaps_truncated, r.degenerate_dropped) == (1, 1, 1, 2, 1)
    assert (r.n_before, r.n_after) == (8, 6)
    got = sorted((x.agent_id, x.start_frame, x.stop_frame) for x in I.clean_annotations(df, 350, ("agent_id",)).collect())
    assert got == [(7, 0, 30), (7, 30, 81), (7, 300, 350), (8, 5, 25), (8, 25, 26), (8, 140, 170)]
    assert I.repair_report(df, None, ("agent_id",)).first().stop_exceeds_duration == 0
    assert I.clean_annotations(df.limit(0), 350, ("agent_id",)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_official_score(spark, seed):
    """Random intervals of two labs: mean F1 over a lab's actions, then over labs, from sets of frames."""
    rng = random.Random(seed)
    part = lambda: (s := rng.randint(0, 40), s + rng.randint(1, 12))
    sol = [(lab, 10 * k + v, "m1", rng.choice(["m1", "m2"]), a, *part()) for k, lab in enumerate(("north", "south")) for v in (1, 2) for a in ("dig", "rear") for _ in range(rng.randint(1, 3))]
    sub = [(v, m, t, a, s + rng.randint(-3, 3), e + rng.randint(-3, 3)) for _, v, m, t, a, s, e in sol if rng.random() < 0.7] + [(1, "m1", "m2", "sleep", 0, 50), (99, "m1", "m2", "dig", 0, 9)]
    active = {(v, m, t, a) for _, v, m, t, a, _, _ in sol if rng.random() < 0.8} | {(1, "m1", "m2", "sleep")}
    want = []
    for lab in ("north", "south"):
        mine = [r for r in sol if r[0] == lab]
        one = []
        for a in sorted({r[4] for r in mine}):
            x = {(r[1:4], f) for r in mine if r[4] == a for f in range(r[5], r[6])}
            y = {(r[:3], f) for r in sub if r[3] == a and r[:4] in active and r[0] in {q[1] for q in mine} for f in range(r[4], r[5])}
            one.append(2 * len(x & y) / (len(x) + len(y)))
        want.append(sum(one) / len(one))
    keys = "video_id long, agent_id string, target_id string, action string"
    got = I.official_score(spark.createDataFrame(sol, SOL), spark.createDataFrame(sub, SOL.split(", ", 1)[1]), spark.createDataFrame(sorted(active), keys))
    assert got.first().score == pytest.approx(sum(want) / 2)


def test_windows_to_intervals(spark):
    """Runs end at another action, at a gap, and at the background."""
    kind = "window_id int, video_id string, agent_id int, target_id int, action string, start_frame long, stop_frame long"
    win = [(1, "v", 3, 4, "dig", 0, 6), (2, "v", 3, 4, "dig", 6, 12), (3, "v", 3, 4, "rear", 12, 18), (4, "v", 3, 4, "dig", 18, 24), (5, "v", 3, 4, "dig", 30, 36), (6, "v", 3, 4, "background", 36, 42), (7, "v", 3, 3, "dig", 12, 18)]
    got = sorted((r.target_id, r.action, r.start_frame, r.stop_frame) for r in I.windows_to_intervals(spark.createDataFrame(win, kind)).collect())
    assert got == [(3, "dig", 12, 18), (4, "dig", 0, 12), (4, "dig", 18, 24), (4, "dig", 30, 36), (4, "rear", 12, 18)]
    assert I.windows_to_intervals(spark.createDataFrame(win[5:6], kind)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_robustify_is_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(v, 1, 2, rng.choice("ab"), s, s + rng.randint(0, 9)) for v in (1, 2) for s in [rng.randint(-3, 80) for _ in range(40)]]
    want = []
    for v in (1, 2):
        last = -1
        for s, e, a in sorted((r[4], r[5], r[3]) for r in rows if r[0] == v and r[4] < r[5]):
            if s >= last:
                want.append((v, s, e, a))
                last = e
    df = spark.createDataFrame(rows, "video_id int, agent_id int, target_id int, action string, start_frame long, stop_frame long")
    assert sorted((r.video_id, r.start_frame, r.stop_frame, r.action) for r in I.robustify(df).collect()) == sorted(want)
