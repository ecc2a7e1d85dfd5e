"""Sequential operators against small references."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethogrid.functions import geometry as G
from ethogrid.operators import sequence as S
from ethogrid.operators import stats as T
from ethogrid.plans import model_queries as Q
from ethogrid.sources import readers as R
from ethogrid.sources import sinks

DATA = "/root/testdata/sf0.001"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(6, 3)), np.log(rng.dirichlet(np.ones(3), 3))
    paths = np.array(np.meshgrid(*[range(3)] * 6)).reshape(6, -1).T
    score = [e[np.arange(6), p].sum() + t[p[:-1], p[1:]].sum() for p in paths]
    assert (S.viterbi_path(e, t) == paths[int(np.argmax(score))]).all()
    assert (S.viterbi_path(e, np.full((3, 3), -np.log(3))) == e.argmax(axis=1)).all()  # equal transitions: the ratio rule
    sticky = np.log(np.full((3, 3), 0.02) + np.eye(3) * 0.94)
    assert (np.diff(S.viterbi_path(e, sticky)) != 0).sum() <= (np.diff(e.argmax(axis=1)) != 0).sum()


def test_transition_rows_sum_to_one(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([0, 0, 1, 1, 0])], "k int, i int, cls int")
    got = S.transition_log_probs(df, ["k"], ["i"], 3).groupBy("a").agg(F.sum(F.exp("lp")).alias("s"), F.min("lp").alias("m")).collect()
    assert all(abs(r.s - 1) < 1e-12 and np.isfinite(r.m) for r in got) and len(got) == 3


def test_correction_gradient_and_descent():
    rng = np.random.default_rng(1)
    seen = rng.normal(size=(9, 4, 2)) * 3
    seen[2, 1] = np.nan
    edges, lengths = np.array([[0, 1], [1, 2], [2, 3]]), np.array([1.0, 2.0, 1.5])
    x = np.nan_to_num(seen) + rng.normal(size=seen.shape) * 0.1

    def fun(v):
        c, g = S.correction_cost(v.reshape(x.shape), seen, np.ones(x.shape[:2]), edges, lengths, 0.7, (0.3, 0.2, 0.1), 5.0, np.array([[0, 1, 2], [1, 2, 3]]), 0.4)
        return c, g.ravel()

    c, g = fun(x.ravel())
    for k in rng.integers(0, x.size, 12):
        e = np.zeros(x.size)
        e[k] = 1e-6
        assert abs((fun(x.ravel() + e)[0] - fun(x.ravel() - e)[0]) / 2e-6 - g[k]) < 1e-5
    assert fun(S.lbfgs(fun, x.ravel()))[0] < c


def test_correction_lowers_violations_and_fills_gaps(spark):
    rng = np.random.default_rng(2)
    names = ["nose", "neck", "ear_left", "ear_right", "hip_left", "hip_right", "tail_base"]
    place = np.array([[0, 0], [0, 22], [-9, 11], [9, 11], [-20, 72], [20, 72], [0, 92]], float)
    rows = []
    for f in range(40):
        at = place + f * 0.5 + rng.normal(size=place.shape) * 6
        rows.append((1, 1, f, *[None if f % 9 == 4 and i // 2 == 6 else float(v) for i, v in enumerate(at.ravel())]))
    df = spark.createDataFrame(rows, "video_id long, mouse_id int, video_frame int, " + ", ".join(f"{k}_{a} double" for k in names for a in "xy"))
    out = S.corrected(df, names, 100.0).toPandas().sort_values("video_frame")
    wrong = lambda d: np.nanmean([(np.abs(np.hypot(d[f"{a}_x"] - d[f"{b}_x"], d[f"{a}_y"] - d[f"{b}_y"]) / (n * 100) - 1)).mean() for (a, b), n in zip(G.EDGES, G.DEFAULT_LENGTHS)])
    assert wrong(out) < wrong(df.toPandas()) and not out.isna().any().any()


def test_points_of_little_weight_give_way(spark):
    """A jump of one frame: with a small weight of its own it is smoothed away, with a full one less so."""
    rows = [(1, 1, f, 0.0, 40.0 if f == 15 else 0.0, 22.0, 0.0, w) for f in range(30) for w in [0.05 if f == 15 else 1.0]]
    names = "video_id long, mouse_id int, video_frame int, nose_x double, nose_y double, neck_x double, neck_y double, nose_w double"
    df = spark.createDataFrame(rows, names)
    at = [S.corrected(d, ["nose", "neck"], 100.0).where("video_frame = 15").first().nose_y for d in (df, df.drop("nose_w"))]
    assert at[0] < at[1] < 40 and at[0] < 25


def test_swaps_are_found_and_undone(spark):
    rows = []
    for f in range(60):
        a, b = (f * 1.0, 0.0), (60.0 - f, 40.0)
        one, two = (b, a) if 20 <= f < 40 else (a, b)
        rows += [(1, 1, f, *one), (1, 2, f, *two)]
    df = spark.createDataFrame(rows, "video_id long, mouse_id int, video_frame long, neck_x double, neck_y double")
    flags = S.swap_flags(df)
    got = {r.video_frame: r.swapped for r in flags.collect()}
    assert sum(got[f] != (20 <= f < 40) for f in range(60)) <= 6
    back = S.unswapped(df, flags).where("mouse_id = 1 AND video_frame BETWEEN 25 AND 35").collect()
    assert all(r.neck_y == 0 for r in back)


def test_pchip_keeps_shape_and_points():
    x, y = np.array([0, 1, 3, 4, 7.0]), np.array([0, 2, 2, 5, 5.5])
    at = np.linspace(0, 7, 200)
    got = S.pchip(x, y, at)
    assert np.allclose(S.pchip(x, y, x), y) and (np.diff(got) > -1e-12).all()
    assert np.allclose(S.pchip(x[:2], y[:2], np.array([0.5, 9.0])), [1.0, 2.0])


def test_welch_finds_the_tone():
    f, p = S.welch(np.sin(2 * np.pi * 0.125 * np.arange(512)))
    assert f[p.argmax()] == 0.125


def test_wilcoxon_by_hand(spark):
    d = [125 - 110, 115 - 122, 130 - 125, 140 - 120, 140 - 140, 115 - 124, 140 - 123, 125 - 137, 140 - 135, 135 - 145]
    df = spark.createDataFrame([(1, float(x), 0.0) for x in d], "k int, a double, b double")
    r = T.wilcoxon(df, "a", "b", "k").first()
    assert (r.n, r.w_plus, r.w_minus, r.w) == (9, 27.0, 18.0, 18.0)


def test_vif_and_normal_tail(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 300))
    rows = [(float(x), float(y), float(x + y + e)) for x, y, e in zip(a, b, rng.normal(size=300) * 0.01)]
    got = {r.column_name: r.vif for r in T.vif(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert max(got.values()) > 100
    assert spark.range(1).select(G.normal_tail(F.lit(1.959964)).alias("p")).first().p == pytest.approx(0.05, abs=1e-5)


def test_lists_and_keys(spark, tmp_path):
    rows = [('["a","b"]',), ("['a', 'b']",), ("[]",), (None,), ("nonsense",), ("[broken",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(R.parse_list(F.col("t")).alias("x")).collect()]
    assert got == [["a", "b"], ["a", "b"], [], [], [], []]
    assert sinks.parameter_hash(a=1, lab="x") == sinks.parameter_hash(lab="x", a=1) != sinks.parameter_hash(a=2, lab="x")
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert sinks.kept(make, str(tmp_path), spark, a=1).count() == 3
    assert len(calls) == 1
    t = spark.createDataFrame([(f,) for f in range(10, 60)], "video_frame int")
    assert tuple(sinks.fingerprint(t).first()) == (50, 50, 10, 59)
    bad = spark.createDataFrame([(0, 1, "1", "2", "a", 5, 5)], "row_id int, video_id int, agent_id string, target_id string, action string, start_frame int, stop_frame int")
    with pytest.raises(ValueError):
        sinks.write_submission(bad, f"{tmp_path}/s")


def test_ranks_by_range_are_average_ranks(spark):
    x = np.random.default_rng(5).integers(-40, 40, 500) / 1000
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 3, "x double")
    want = {r.x: r.r for r in df.withColumn("one", F.lit(1)).select("x", T.average_rank("x", ["one"]).alias("r")).collect()}
    assert {r.x: r.r for r in T.ranks_by_range(df, "x", 0.007, "r").collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_boosted_trees_predict_every_fold(spark, monkeypatch):
    monkeypatch.setattr(Q.M, "boosted", lambda rounds: Q.M.forest(2, 2))  # the folds count here, not the model
    assert sum(r.support for r in Q.ml_boosted(spark, DATA).collect()) == Q._windows(spark, DATA).count()
