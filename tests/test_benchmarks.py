"""Benchmarks against plain loops and planted faults."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethogrid.operators import benchmarks as B
from ethogrid.operators import inference as In
from ethogrid.operators import motion as Mo
from ethogrid.sources.adapters import XY

KEYS = "video_id long, mouse_id int, video_frame int"


@pytest.fixture(scope="module")
def walks(spark):
    """Two videos of three mice and one of a lone mouse, with gaps."""
    rng = np.random.default_rng(11)
    rows = []
    for v, mice in ((1, 3), (2, 2), (3, 1)):
        for m in range(1, mice + 1):
            at = rng.normal(size=(60, len(XY))).cumsum(axis=0)
            rows += [(v, m, t, *[None if rng.random() < 0.03 else float(x) for x in at[t]]) for t in range(60)]
    return spark.createDataFrame(rows, f"{KEYS}, " + ", ".join(f"{c} double" for c in XY)).cache()


def test_every_pair_is_the_single_recovery(spark, walks):
    bad = {"spiked": lambda p: Mo.spiked(p, "nose", 0.2), "drifting": lambda p: Mo.drifting(p, "nose")}
    fix = {"none": lambda p: p, "back": lambda p: p.withColumn("nose_x", F.col("nose_x") - 1)}
    got = {(r.corruption, r.repair): (r.before, r.after) for r in B.recovery_grid(walks, bad, fix, ["nose"]).collect()}
    assert len(got) == 4
    for b in bad:
        for f in fix:
            one = Mo.recovery(walks, bad[b](walks), fix[f](bad[b](walks)), ["nose"]).first()
            assert got[(b, f)] == pytest.approx((one.before, one.after))


def test_swaps_counted(spark, walks):
    bad = Mo.swapped_ends(walks, 0.3)
    cols = [f"{k}_{s}_{a}" for k in ("ear", "hip") for s in ("left", "right") for a in "xy"]
    all_back = B.swap_recovery(walks, bad, walks, cols).first()
    assert all_back.changed == all_back.touched == all_back.mended > 0 and all_back.recall == all_back.precision == 1 and all_back.spoiled == 0
    none = B.swap_recovery(walks, bad, bad, cols).first()
    assert none.mended == none.touched == 0 and none.precision is None and none.recall == 0
    worse = B.swap_recovery(walks, walks, bad, cols).first()
    assert worse.changed == 0 and worse.spoiled == all_back.changed


def test_identity_over_time(spark, walks):
    got = {(r.video_id, r.a, r.b): (r.swaps, r.mean_s, r.persistence, r.fragments) for r in B.identity_metrics(walks, 10.0).collect()}
    at = {(r.video_id, r.mouse_id, r.video_frame): r for r in walks.collect()}
    want = {}
    for v, a, b in ((1, 1, 2), (1, 1, 3), (1, 2, 3), (2, 1, 2)):
        signs = []
        for t in range(60):
            p, q = at[(v, a, t)], at[(v, b, t)]
            if all(x is not None for r in (p, q) for x in (r.nose_x, r.nose_y, r.tail_base_x, r.tail_base_y)):
                c = (p.tail_base_x - p.nose_x) * (q.tail_base_y - q.nose_y) - (p.tail_base_y - p.nose_y) * (q.tail_base_x - q.nose_x)
                signs.append(c > 0)
        runs = [1]
        for x, y in zip(signs, signs[1:]):
            runs = runs[:-1] + [runs[-1] + 1] if x == y else runs + [1]
        swaps = [n for n in runs[1:] if n >= 2]
        want[(v, a, b)] = (len(swaps), sum(swaps) / len(swaps) / 10 if swaps else 0, 1 - sum(swaps) / len(signs), len(runs))
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k])
    still = spark.createDataFrame([(1, m, t, 0.0, 0.0, 1.0, 1.0) for m in (1, 2) for t in range(4)], f"{KEYS}, nose_x double, nose_y double, tail_base_x double, tail_base_y double")
    assert tuple(B.identity_metrics(still, 10.0).first())[3:] == (0, 0.0, 1.0, 0)


def test_turning(spark):
    square = [(1, 1, t, *[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)][t % 4]) for t in range(20)] + [(2, 1, t, 3.0 * t, 0.0) for t in range(20)]
    df = spark.createDataFrame(square, f"{KEYS}, nose_x double, nose_y double")
    got = B.turning_angles(df, "nose").groupBy("video_id").agg(F.count("*").alias("n"), F.min("angle").alias("a"), F.max("angle").alias("b")).orderBy("video_id").collect()
    assert [(r.n, round(r.a, 6), round(r.b, 6)) for r in got] == [(18, 1.570796, 1.570796), (18, 0.0, 0.0)]
    same = B.turning_shift(df, df, "nose").first()
    assert same.ks == 0 and same.before == same.after and same.n_a == same.n_b == 36
    moved = B.turning_shift(df.where("video_id = 1"), df.where("video_id = 2"), "nose").first()
    assert moved.ks == 1


def test_smoothness(spark):
    t = np.arange(400)
    slow, fast = np.sin(t * 2 * np.pi / 100), np.sin(t * 2 * np.pi / 3)
    rows = [(1, 1, int(i), float(slow[i]), 1.0) for i in t] + [(1, 2, int(i), float(fast[i]), float(slow[i])) for i in t] + [(1, 3, int(i), 1.0, None) for i in t]
    got = {r.mouse_id: r.high_share for r in B.smoothness(spark.createDataFrame(rows, f"{KEYS}, a double, b double"), ["a", "b"], 30.0, 6.0).collect()}
    assert got[1] < 0.01 and got[2] == pytest.approx(0.5, abs=0.01) and got[3] is None


def test_phases_side_by_side(spark):
    t = lambda *rows: spark.createDataFrame(rows, "edge string, v double")
    got = B.phase_chain({"raw": t(("a", 1.0), ("b", 2.0)), "mid": t(("a", 4.0), ("c", 9.0)), "end": t(("a", 2.5), ("b", 1.0))}, ["edge"], "v").orderBy("edge").collect()
    assert [tuple(r) for r in got] == [("a", 1.0, 4.0, 2.5, 3.0, -1.5), ("b", 2.0, None, 1.0, None, None)]


def test_silhouette(spark):
    rng = np.random.default_rng(12)
    v, c = rng.normal(size=(40, 3)), np.r_[np.zeros(20), np.ones(15), np.full(4, 2), 3].astype(int)
    rows = [(int(k), x.tolist()) for k, x in zip(c, v)]
    df = spark.createDataFrame([*rows, (None, [0.0] * 3), (1, None)], "c int, v array<double>")
    d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    want = {}
    for k in range(4):
        s = []
        for i in np.flatnonzero(c == k):
            if (c == k).sum() == 1:
                s.append(0.0)
                continue
            a, b = d[i, c == k].sum() / ((c == k).sum() - 1), min(d[i, c == o].mean() for o in range(4) if o != k)
            s.append((b - a) / max(a, b))
        want[k] = np.mean(s)
    assert {r.cluster: r.silhouette for r in B.silhouette(df, "v", "c").collect()} == pytest.approx(want)
    assert [r.silhouette for r in B.silhouette(df.where("c = 0"), "v", "c").collect()] == [0.0]
    assert B.silhouette(df.where("c = 9"), "v", "c").count() == 0


def test_class_mix(spark):
    pool = spark.createDataFrame([(i, i % 2) for i in range(100)], "window_id long, y int")
    asked = spark.createDataFrame([("a", i) for i in (0, 2, 4, 1)] + [("b", 1)], "strategy string, window_id long")
    got = {(r.strategy, r.y): (r.n, r.share, r.lift, r.wasted) for r in B.class_mix(asked, pool).collect()}
    assert got == {("a", 0): (3, 0.75, 1.5, 0.75), ("a", 1): (1, 0.25, 0.5, 0.75), ("b", 1): (1, 1.0, 2.0, 0.0)}


def test_models_of_one_lab_on_another(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 2))
    rows = [(i % 3, i % 2, int((a > 0) != (i % 3 == 2)), float(a), float(b)) for i, (a, b) in enumerate(x)]  # the last lab turns the rule round
    got = {(r.train, r.test): (r.n, r.score) for r in In.cross_accuracy(spark.createDataFrame(rows, "lab_id long, fold int, y int, a double, b double"), ["a", "b"], 2, "fold = 1").collect()}
    assert len(got) == 9 and all(n == 100 for n, _ in got.values())
    for (a, b), (_, s) in got.items():
        assert s > 0.9 if (a == 2) == (b == 2) else s < 0.1
