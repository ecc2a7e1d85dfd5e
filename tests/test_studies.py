"""Evaluation, motion, identity, selection, active learning, sources and sinks, by hand and against golden values."""

import itertools
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ethogrid.functions import geometry as G
from ethogrid.operators import active as A
from ethogrid.operators import decide as D
from ethogrid.operators import evaluate as E
from ethogrid.operators import frames as P
from ethogrid.operators import models as M
from ethogrid.operators import motion as Mo
from ethogrid.operators import repair as Re
from ethogrid.operators import selection as Se
from ethogrid.operators import sequence as S
from ethogrid.operators import stats as T
from ethogrid.sources import readers as R
from ethogrid.sources import sinks
from ethogrid.sources.adapters import XY, pose

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_labels_become_codes_and_back(spark):
    classes = ["sniff", "mount", "approach"]
    df = spark.createDataFrame([(x,) for x in ("mount", "approach", "sniff", "nope", "background", None)], "a string")
    got = df.select(E.encoded(F.col("a"), classes).alias("c")).select("c", E.decoded(F.col("c"), classes).alias("b")).collect()
    assert [r.c for r in got] == [1, 2, 0, -1, -1, -1] and [r.b for r in got] == ["mount", "approach", "sniff"] + ["background"] * 3


def test_pairs_with_other_labels_stop_the_job(spark):
    a = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.6), (3, 1, 0.1)], "k int, y int, p double")
    b = spark.createDataFrame([(1, 0, 0.4), (2, 1, 0.2)], "k int, y int, p double")
    assert sorted((r.k, r.a.p, r.b.p) for r in E.paired(a, b, ["k"]).collect()) == [(1, 0.5, 0.4), (2, 0.6, 0.2)]
    with pytest.raises(PySparkException):
        E.paired(a, b.withColumn("y", F.lit(0)), ["k"]).collect()


def test_fold_metrics(spark):
    known = spark.createDataFrame([("a", 0), ("b", 0), ("a", 1), ("b", 2), ("c", 2)], "v string, y int")
    ok = D.evaluable(known, "y", "v")
    assert sorted(r.y for r in ok.collect()) == [0, 2]
    rows = [(1, y, y) for y in (0, 0, 1, 1, 2, 2)] + [(2, 0, 0), (2, 1, 0)]
    got = {r.fold: r for r in E.fold_metrics(spark.createDataFrame(rows, "fold int, y int, pred int"), ok).collect()}
    assert (got[1].macro_eval, got[1].macro_full, got[1].support) == (1.0, 1.0, 6)
    assert got[2].macro_eval == pytest.approx(2 / 3) and got[2].macro_full == pytest.approx(1 / 3)  # class 2 is absent there


def test_exact_p_counts_all_signs(spark):
    for n, w in ((5, 0), (5, 3), (7, 6), (10, 14)):
        below = sum(sum(r for r, s in zip(range(1, n + 1), signs) if s) <= w for signs in itertools.product((0, 1), repeat=n))
        got = spark.createDataFrame([(float(w), n)], "w double, n long").select(E.exact_p(F.col("w"), F.col("n")).alias("p")).first().p
        assert got == pytest.approx(min(1.0, 2 * below / 2**n))


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=900) * 10.0 ** rng.integers(-6, 6, 900), np.zeros(40), np.full(60, 7.25), -np.arange(50.0)]
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, len(x)), x)] + [(0, None), (5, None), (6, 1.5)]
    qs = (0.0, 0.1, 0.5, 0.75, 0.999, 1.0)
    got = {r.g: r for r in T.exact_percentiles(spark.createDataFrame(rows, "g int, x double"), ["x"], qs, "g").collect()}
    assert set(got) == {0, 1, 2, 6}
    for g, r in got.items():
        mine = [v for k, v in rows if k == g and v is not None]
        assert r.n == len(mine) and np.allclose(r.v, np.quantile(mine, qs), rtol=1e-12, atol=1e-12)


def test_spearman_and_settings(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 80), rng.integers(0, 9, 80)
    df = spark.createDataFrame([(0, float(x), float(y)) for x, y in zip(a, b)], "g int, a double, b double")
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert E.spearman(df, "a", "b", "g").first().rho == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    config = {"smooth": {"window": 9, "order": None}, "edges": {"tau": 0.2}}
    assert R.keyword_arguments(config, {"smooth.window": "width", "smooth.order": "order", "edges.tau": "tau", "no.such": "x"}, {"order": 3}) == {"width": 9, "order": 3, "tau": 0.2}


def test_selection_drops_clusters_inflation_and_drift(spark):
    rng = np.random.default_rng(2)
    n = 600
    a, b, d = rng.normal(size=(3, n))
    video = np.repeat([0, 1, 2], n // 3)
    data = {"a": a, "b": b, "c": a + b, "near": a * 2 + rng.normal(size=n) * 0.01, "calm": d, "drifting": rng.normal(size=n) + video * 10.0}
    y = (a > 0).astype(int)
    df = spark.createDataFrame([tuple(float(data[c][i]) for c in data) + (int(y[i]), int(video[i])) for i in range(n)], ", ".join(f"{c} double" for c in data) + ", y int, video int")
    drift = {r["column"]: r.drift for r in Se.drift_scores(df, list(data), "video").collect()}
    assert drift["drifting"] > 10 * drift["calm"]
    r = Se.correlations(df, ["a", "b", "c"])
    assert Se.inflation(r).max() > 100 and Se.inflation(Se.correlations(df, ["a", "b", "calm"])).max() < 5
    got = {x.feature: x for x in Se.select_features(df, list(data), "y", "video").collect()}
    assert sum(got[c].kept for c in ("a", "near")) == 1 and [got[c].reason for c in ("a", "near") if not got[c].kept][0].startswith("collinear")
    assert sum(got[c].reason == "inflated" for c in ("a", "near", "b", "c")) >= 1 and not got["drifting"].kept and got["drifting"].reason == "unstable"


@needs_data
def test_symmetric_swaps_are_mended(spark):
    rows = []
    for t in range(60):
        side = -1 if t in (20, 21, 40) else 1
        at = {"nose": (0, t + 9), "neck": (0, t + 6), "ear_left": (-side, t + 8), "ear_right": (side, t + 8), "hip_left": (-side * 2, t + 2), "hip_right": (side * 2, t + 2), "tail_base": (0, t)}
        rows.append((1, 1, t, *[float(at[c.rsplit("_", 1)[0]]["xy".index(c[-1])]) for c in XY]))
    df = spark.createDataFrame(rows, "video_id int, mouse_id int, video_frame int, " + ", ".join(f"{c} double" for c in XY))
    got = Mo.symmetric_swaps(df).orderBy("video_frame").collect()
    assert [r.video_frame for r in got if r.ear_swapped] == [20, 21, 40] == [r.video_frame for r in got if r.hip_swapped]
    assert all(r.ear_left_x < r.ear_right_x for r in got)


def test_huddles_that_end_crossed_are_seen(spark):
    rows = []
    for t in range(90):
        a, b = abs(t - 45) + 0.5, -abs(t - 45) - 0.5
        if t > 45:
            a, b = b, a  # the tracker takes them for each other after they met
        for m, x in ((1, a), (2, b)):
            rows.append((1, m, t, *[x if c.endswith("_x") else 0.0 for c in XY]))
    df = spark.createDataFrame(rows, "video_id int, mouse_id int, video_frame int, " + ", ".join(f"{c} double" for c in XY))
    got = Mo.identity_check(df, 6.0).collect()
    assert len(got) == 1 and got[0].inverted and got[0].first <= 45 <= got[0].last
    straight = df.withColumn("mouse_id", F.when(F.col("video_frame") > 45, 3 - F.col("mouse_id")).otherwise(F.col("mouse_id")))
    assert [r.inverted for r in Mo.identity_check(straight, 6.0).collect()] == [False]


@needs_data
def test_corruption_is_the_same_at_every_partitioning(spark):
    p = pose(spark, DATA)
    for f in (Mo.occluded, Mo.correlated, Mo.swapped_ends, Mo.burst):
        one, two = (f(x).agg(F.sum(F.xxhash64("video_id", "mouse_id", "video_frame", *[F.round(c, 6) for c in XY]) % 1000003)).first()[0] for x in (p, p.repartition(7)))
        assert one == two
    lost = Mo.occluded(p).where("nose_x = 0 AND ear_left_x = 0 AND neck_x <> 0").count()
    assert lost > 20


def test_smoothing_keeps_lines_and_gaps(spark):
    rows = [(1, 1, t, None if t in (5, 6) else 2.0 * t + 1) for t in range(30)] + [(1, 2, t, float(t)) for t in range(4)] + [(2, 1, t, None) for t in range(12)]
    got = P.smoothed(spark.createDataFrame(rows, "video_id int, mouse_id int, video_frame int, x double"), ["x"]).collect()
    by = {(r.video_id, r.mouse_id, r.video_frame): r.x for r in got}
    assert by[(1, 1, 5)] is None and by[(1, 2, 3)] == 3.0 and by[(2, 1, 0)] is None
    assert all(by[(1, 1, t)] == pytest.approx(2 * t + 1) for t in range(4, 26) if t not in (5, 6))


@needs_data
def test_the_chain_of_repairs_lowers_violations(spark):
    rng = np.random.default_rng(8)
    place = {"nose": (0, 0), "neck": (0, 22), "ear_left": (-9, 11), "ear_right": (9, 11), "hip_left": (-20, 72), "hip_right": (20, 72), "tail_base": (0, 92)}
    rows = []
    for t in range(50):
        for m in (1, 2):
            at = {k: np.array(xy) + [t * 0.5 + 300 * m, 10 * m] + rng.normal(size=2) * 4 for k, xy in place.items()}
            if t == 30 and m == 1:
                at["nose"] = at["nose"] + [80, 0]
            rows.append((1, m, t, *[None if t == 12 and c[:4] == "nose" else float(at[c.rsplit("_", 1)[0]]["xy".index(c[-1])]) for c in XY]))
    df = spark.createDataFrame(rows, "video_id int, mouse_id int, video_frame int, " + ", ".join(f"{c} double" for c in XY))
    refs = {f"{a}→{b}": n * 100 for (a, b), n in zip(G.EDGES, G.DEFAULT_LENGTHS)}
    got = Re.repaired(df, refs, 100.0).orderBy("mouse_id", "video_frame").collect()
    assert len(got) == 100 and all(r[c] is not None for r in got for c in XY)
    wrong = lambda rs: np.nanmean([abs(np.hypot(r[f"{a}_x"] - r[f"{b}_x"], r[f"{a}_y"] - r[f"{b}_y"]) / (n * 100) - 1) for r in rs if r["nose_x"] is not None for (a, b), n in zip(G.EDGES, G.DEFAULT_LENGTHS)])
    assert wrong(got) < wrong(df.collect())
    jump = [r for r in got if r.mouse_id == 1 and r.video_frame == 30][0]
    assert abs(jump.nose_x - (300 + 15)) < 40  # it was seen 80 away


def test_gaps_take_the_nearest_frames(spark):
    rows = [(1, 1, t, float(t), None if t == 10 else float(t * 2)) for t in range(20)] + [(1, 2, t, float(t), None) for t in range(3)]
    df = spark.createDataFrame(rows, "video_id int, mouse_id int, video_frame int, a double, b double")
    got = {(r.mouse_id, r.video_frame): r.b for r in Re.similar_filled(df, ["a", "b"], 2).collect()}
    assert got[(1, 10)] == 20.0 and got[(2, 0)] is None


def test_viterbi_with_equal_transitions_is_the_ratio_rule():
    rng = np.random.default_rng(4)
    e = np.log(rng.random((40, 5)))
    e[:, 0] = 0
    flat = np.full((5, 5), np.log(0.2))
    assert (S.viterbi_path(e, flat) == e.argmax(axis=1)).all()
    sticky = np.log(np.full((5, 5), 0.01) + np.eye(5) * 0.95)
    assert (np.diff(S.viterbi_path(e, sticky)) != 0).sum() <= (np.diff(e.argmax(axis=1)) != 0).sum()


def test_thresholds_rise_to_what_splits_the_classes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lab in (0, 1):
        for w in range(120):
            y = w % 3
            p = rng.random(3) * 0.2
            p[y] += 0.1 * (lab + 1) if y else 0
            rows += [(lab, lab * 1000 + w, c, float(p[c]), y) for c in range(3)]
    long = spark.createDataFrame(rows, "lab_id long, window_id long, cls int, p double, y int")
    got = S.tuned_thresholds(long, passes=1).collect()
    assert len(got) == 6 and all(r.t == 0.5 for r in got if r.cls == 0)
    score = {r.lab_id: r.score for r in got}
    assert score[1] > score[0] > 0.5 and score[1] > 0.8


def test_no_value_of_the_held_fold_fills_a_gap(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 100.0), (1, None)], "fold int, x double")
    train = df.where("fold = 0")
    got = M.assembled(df.where("fold = 1"), ["x"], train=train).select(F.get(M.vector_to_array("features"), F.lit(0)).alias("v")).collect()
    assert sorted(r.v for r in got) == [2.0, 100.0]


def test_learning_cycle_gains_and_counts(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 2))
    rows = [(i, float(a), float(b), float(int(a + b > 0) + int(a - b > 1)), i % 4 == 0) for i, (a, b) in enumerate(x)]
    pool = spark.createDataFrame(rows, "id long, a double, b double, y double, held boolean")
    got = A.cycle(pool, ["a", "b"], "y", F.col("held"), 3, 20, 3, "entropy", M.forest(5, 4, leaf=1), "id", 0.0).collect()
    assert [r.labels for r in got] == [9, 29, 49] and got[-1].accuracy >= 0.7 and got[0].wasted == 0 and 0 <= got[1].wasted <= 20


def test_gradient_batch_is_spread_and_repeatable(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [0.5, 0.3, 0.2], [float(v) for v in rng.normal(size=4) + (20 if i < 5 else 0)]) for i in range(60)]
    pool = spark.createDataFrame(rows, "window_id long, p array<double>, h array<double>")
    got = [[r.window_id for r in A.gradient_batch(pool, pool.limit(0), 4, "h").collect()] for _ in range(2)]
    assert got[0] == got[1] and len(set(got[0])) == 4 and got[0][0] < 5


def test_missing_paths_pools_reports_and_bundles(spark, tmp_path):
    assert R.load_annotations(spark, f"{tmp_path}/none").columns[-1] == "duration_frames" and R.load_annotations(spark, f"{tmp_path}/none").count() == 0
    w = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.25)], "window_id int, lab_id string, x double")
    sinks.write_windows(w, f"{tmp_path}/w")
    assert R.load_windows(spark, f"{tmp_path}/w", "b").count() == 1
    sinks.write_pool(w, f"{tmp_path}/p", classes=["x", "y"], version=2)
    back, facts = R.load_pool(spark, f"{tmp_path}/p")
    assert back.count() == 2 and facts == {"classes": ["x", "y"], "version": 2}
    sinks.write_report(w, f"{tmp_path}/r")
    assert spark.read.csv(f"{tmp_path}/r/csv", header=True).count() == spark.read.json(f"{tmp_path}/r/json").count() == 2
    assert sinks.markdown(w.orderBy("window_id")).splitlines() == ["| window_id | lab_id | x |", "| - | - | - |", "| 1 | a | 0.500 |", "| 2 | b | 0.250 |"]
    with pytest.raises(ValueError):
        sinks.markdown(w, rows=1)
    t = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4), ("b", 1, 0.3)], "lab_id string, cls int, t double")
    new = spark.createDataFrame([("a", 2, 0.9), ("c", 1, 0.1)], "lab_id string, cls int, t double")
    assert sorted(map(tuple, sinks.patched(t, new).collect())) == [("a", 1, 0.5), ("a", 2, 0.9), ("b", 1, 0.3), ("c", 1, 0.1)]
    pick = spark.createDataFrame([("a", "old"), ("c", "new")], "lab_id string, bundle string")
    assert sorted((r.lab_id, r.cls, r.t) for r in sinks.composed({"old": t, "new": new}, pick).collect()) == [("a", 1, 0.5), ("a", 2, 0.4), ("c", 1, 0.1)]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    frames = spark.range(10).withColumnRenamed("id", "video_frame")
    for version, source in ((1, frames), (1, frames), (2, frames), (2, frames.limit(5))):
        sinks.kept(make, f"{tmp_path}/k", spark, version=version, source=source, a=1)
    assert len(calls) == 3


def test_broken_videos_stop_no_other(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "video_id int")
    t = spark.createDataFrame([(1, 0.5, 1.0), (1, None, None), (2, None, None)], "video_id int, x double, y double")
    assert sorted(map(tuple, R.existence(asked, t, "video_id").collect())) == [(1, 2, "ok"), (2, 1, "broken"), (3, 0, "missing")]


def test_row_ids_are_gapless(spark):
    rows = [(v, 1, 2, "a" if s % 2 else "b", s, s + 1) for v in range(5) for s in range(40)]
    df = spark.createDataFrame(rows, "video_id int, agent_id int, target_id int, action string, start_frame int, stop_frame int")
    got = sinks.with_row_ids(df.repartition(5)).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(200)) and [(r.video_id, r.start_frame) for r in got] == [(v, s) for v in range(5) for s in range(40)]
