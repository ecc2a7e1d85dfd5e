"""Operators whose layout follows the data give what their plain forms give."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethogrid.operators import active as A
from ethogrid.operators import evaluate as E
from ethogrid.operators import models as M
from ethogrid.operators import repair as Re
from ethogrid.operators import stats as T
from ethogrid.operators import windows as Wn


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_stratified_holds_the_smallest_hashes(spark, share):
    rows = [(i, i % 3 if i % 7 else None) for i in range(500)] + [(1000, 9)]
    got = {r.id: r.held for r in Wn.stratified(spark.createDataFrame(rows, "id long, cls int"), "cls", ["id"], share).collect()}
    for c in {c for _, c in rows}:
        ids = sorted((i for i, k in rows if k == c), key=lambda i: hashlib.md5(f"0|{i}".encode()).hexdigest())
        want = set(ids[: round(len(ids) * share)])
        assert {i for i in ids if got[i]} == want
    assert Wn.stratified(spark.createDataFrame([], "id long, cls int"), "cls", ["id"], 0.3).count() == 0


def test_farthest_rows_are_alike_with_few_and_many_brought(spark):
    rng = np.random.default_rng(1)
    v = np.vstack([rng.integers(0, 6, (80, 2)), np.zeros((4, 2))]).astype(float)  # ties and repeated rows
    pool = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "window_id long, v array<double>")
    d, want = np.full(len(v), np.inf), [3]
    while len(want) < 20:
        d = np.minimum(d, np.sqrt(((v - v[want[-1]]) ** 2).sum(axis=1)))
        want.append(int(np.argmax(d)))
    for near in (4, 512):
        assert [r.window_id for r in M.k_center(pool, 20, "v", "window_id", 3, near).orderBy("step").collect()] == want


def test_draws_are_alike_with_few_and_many_brought(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.dirichlet(np.ones(3))], [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    pool = spark.createDataFrame(rows, "window_id long, p array<double>, h array<double>")
    got = [[r.window_id for r in A.gradient_batch(pool, pool.limit(0), 20, "h", near=k).orderBy("step").collect()] for k in (2, 256)]
    assert got[0] == got[1] and len(set(got[0])) == 20
    assert A.gradient_batch(pool.limit(5), pool.limit(0), 20, "h").count() == 5


def test_shares_above(spark):
    rng = np.random.default_rng(3)
    x = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 200), rng.integers(0, 10, 200))]
    df, cuts = spark.createDataFrame(x, "lab long, x double"), {0: 2.0, 1: 5.0, 2: 5.0, 3: 20.0}
    got = {(r.train, r.test): r.score for r in E.shares_above(df, "lab", "x", spark.createDataFrame(list(cuts.items()), "train long, cut double")).collect()}
    want = {(a, b): np.mean([v > c for g, v in x if g == b]) for a, c in cuts.items() for b in range(4)}
    assert got == pytest.approx(want)


def test_similar_frames_over_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 30, (5000, 3)).astype(float)
    hole = rng.random((5000, 3)) < 0.15
    rows = [(1, 1, t, *[None if h else float(x) for x, h in zip(a, b)]) for t, (a, b) in enumerate(zip(v, hole))]
    df = spark.createDataFrame(rows, "video_id int, mouse_id int, video_frame int, a double, b double, c double")
    got = {r.video_frame: (r.a, r.b, r.c) for r in Re.similar_filled(df, ["a", "b", "c"], 3).collect()}
    known, zero = ~hole, np.where(hole, 0, v)
    for t in [t for t in range(5000) if hole[t].any()][::97]:
        both = (known & known[t]).sum(axis=1)
        far = np.where(both > 0, (((v - v[t]) ** 2) * (known & known[t])).sum(axis=1) * 3 / np.maximum(both, 1), np.inf).round(6)
        for c in np.flatnonzero(hole[t]):
            donors = [i for i in np.argsort(far, kind="stable") if known[i, c] and np.isfinite(far[i])][:3]
            assert got[t][c] is None if not donors else got[t][c] == pytest.approx(zero[donors, c].mean())


def test_only_the_column_that_decides_loses(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(a > 0), i % 3 == 0) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y double, held boolean")
    for size in (50, 65536):
        got = {r.feature: r.loss for r in M.permuted_importances(df, ["a", "b"], F.col("held"), M.forest(5, 4), rows=size).collect()}
        assert got["a"] > 0.3 and abs(got["b"]) < 0.1


def test_every_row_of_a_group_is_predicted_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, i % 2, float(x), float(x > 0)) for i, x in enumerate(rng.normal(size=300))] + [(1000 + i, 7, i % 2, 1.0, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, lab long, fold int, x double, y double")
    got = M.per_group(df, ["x"], "lab", "fold", M.forest(3, 3, leaf=1)).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows) and all(r.fallback == (r.lab == 7) for r in got)
    assert np.mean([r.prediction == r.y for r in got]) > 0.9


def test_percentiles_of_skewed_groups(spark):
    rows = [(0, float(i % 9)) for i in range(900)] + [(1, 4.5)] + [(2, None)]
    got = {r.g: (r.n, list(r.v)) for r in T.exact_percentiles(spark.createDataFrame(rows, "g int, x double"), ["x"], (0.25, 0.6), "g").collect()}
    assert got == {0: (900, [pytest.approx(np.percentile([i % 9 for i in range(900)], q)) for q in (25, 60)]), 1: (1, [4.5, 4.5])}
