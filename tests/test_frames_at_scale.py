"""Intervals meet frames without their frames being materialised or broadcast; results are those of the frames."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ethogrid.functions import geometry as G
from ethogrid.operators import benchmarks as B
from ethogrid.operators import correction as C
from ethogrid.operators import frames as P
from ethogrid.operators import identity as Id
from ethogrid.operators import intervals as I
from ethogrid.operators import quality as Q
from ethogrid.operators import repair as Re
from ethogrid.plans import benchmark_queries as BQ
from ethogrid.plans import model_queries as MQ
from ethogrid.plans.frame_queries import r4
from ethogrid.session import written
from ethogrid.sources.adapters import KEYPOINTS, XY

DATA = "/root/testdata/sf0.001"
ANN = "video_id long, agent_id int, target_id int, action string, start_frame long, stop_frame long"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def some(n, seed, nulls=False):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, s = rng.randint(1, 3), rng.randint(-5, 60)
        r = [rng.randint(1, 3), a, rng.choice([a, 1, 2, 3]), rng.choice("uvwx"), s, s + rng.randint(-2, 25)]
        if nulls and rng.random() < 0.2:
            r[rng.randint(0, 3)] = None
        out.append(tuple(r))
    return out


@pytest.mark.parametrize("precedence", ["longest", "shortest"])
@pytest.mark.parametrize("nulls", [False, True])
def test_spells_have_the_labels_of_their_frames(spark, precedence, nulls):
    spans = spark.createDataFrame(some(60, 1, nulls), ANN).select(*I.KEY, "start_frame", "stop_frame")
    known = spark.createDataFrame(some(120, 2, nulls), ANN)
    got = I.label_spells(spans, known, precedence).select(*I.KEY, F.explode(F.sequence("start_frame", F.col("stop_frame") - 1)).alias("video_frame"), "label")
    want = I.label_frames(I.frames_of(spans).select(*I.KEY, "video_frame").distinct(), known.where("stop_frame > start_frame"), precedence)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    # frames of a key with a missing part are grouped whatever the join says
    assert rows(got) == rows(want) and len(rows(got)) > 500


def test_spells_of_long_intervals_and_of_none(spark):
    spans = spark.createDataFrame([(1, 1, 2, "u", 0, 10**9)], ANN)
    known = spark.createDataFrame([(1, 1, 2, "u", 5, 10**8), (1, 1, 1, "v", 7, 9), (1, 2, 1, "w", 0, 50)], ANN)
    got = sorted((r.start_frame, r.stop_frame, r.label) for r in I.label_spells(spans, known, "shortest").collect())
    assert got == [(0, 5, "background"), (5, 7, "u"), (7, 9, "v"), (9, 10**8, "u"), (10**8, 10**9, "background")]
    assert I.label_spells(spans.limit(0), known.limit(0)).count() == 0


@pytest.mark.parametrize("inclusive", [False, True])
def test_covered_is_the_join_of_frames(spark, inclusive):
    spans = spark.createDataFrame([(*r[:4], r[4] * 7, r[4] * 7 + 9 * (r[5] - r[4])) for r in some(60, 3)], ANN)
    rows = spark.createDataFrame([(v, a, t, v * t) for v in (1, 2) for a in (1, 2, 3) for t in range(0, 400)], "video_id long, agent_id int, video_frame long, z long")
    got = I.covered(spans, rows, ["video_id", "agent_id"], inclusive)
    want = I.frames_of(spans, inclusive).join(rows, ["video_id", "agent_id", "video_frame"])
    cols = want.columns
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["iv_label_longest", "iv_label_shortest", "ev_interval_depths", "st_dz_by_action"])
def test_no_frames_are_broadcast(spark, name):
    """Explosions are taken for as small as what is exploded: 0.1 GB of tables broke the driver."""
    plan = plan_of(entry.queries()[name](spark, DATA))
    assert "Broadcast" not in plan


def test_labels_are_not_broadcast(spark):
    spans = spark.createDataFrame(some(20, 1), ANN)
    frames = I.frames_of(spans).select(*I.KEY, "video_frame").distinct()
    assert "Broadcast" not in plan_of(I.label_frames(frames, spans))


def test_flags_of_the_chain_are_not_broadcast(spark):
    """A stored table of few values is far larger than its files: the chain's flags broke the driver at 0.1 GB."""
    p = spark.createDataFrame([(1, m, t, *([float(t % 7), 1.0] * 7)) for m in (1, 2) for t in range(40)], "video_id long, mouse_id int, video_frame int, " + ", ".join(f"{c} double" for c in XY))
    w = Re.weighted_points(p, {f"{a}→{b}": 1.0 for a, b in G.EDGES})
    assert w.count() == 80 and "Broadcast" not in plan_of(w)
    fixed = C.corrected_windows(w.withColumn("nose_w", F.when(F.col("video_frame") % 9 == 4, 0.1).otherwise(1.0)), KEYPOINTS, 10.0)
    assert "Broadcast" not in plan_of(C.with_corrections(p, fixed, XY))
    assert "Broadcast" not in plan_of(Id.exchanged(p, p.select("video_id", "video_frame", F.lit(1).alias("a"), F.lit(2).alias("b"), F.col("video_frame").alias("order"))))


def exchanges(spark, name):
    """Shuffles of rows by key in the query's plan, as run."""
    done = plan_of(entry.queries()[name](spark, DATA)).split("== Initial Plan ==")[0]
    return [x for x in done.split("\n") if "Exchange hashpartitioning" in x and "Reused" not in x]


def test_long_to_wide_is_one_aggregate(spark):
    """A pivot shuffled each keypoint's row, and then every column."""
    by = exchanges(spark, "fr_long_to_wide")
    assert len(by) == 2 and not any("bodypart" in x for x in by)  # the poses' own, and one by frame


def test_wide_keeps_what_a_frame_lacks(spark):
    long = spark.createDataFrame([(1, 1, 0, "nose", 1.0, None), (1, 1, 0, "neck", 2.0, 3.0), (1, 1, 1, "other", 9.0, 9.0)], "video_id long, mouse_id int, video_frame int, bodypart string, x double, y double")
    got = sorted(tuple(r) for r in P.to_wide(long, ["nose", "neck"]).collect())
    assert got == [(1, 1, 0, 1.0, None, 2.0, 3.0), (1, 1, 1, None, None, None, None)]


def test_relations_are_dealt_by_video_once(spark):
    """The join of both mice and the windows of a pair shuffled all columns three times."""
    by = exchanges(spark, "fr_relations")
    assert len(by) == 2


def test_aligned_pairs_are_those_of_a_join(spark):
    rows = [(v, m, t, float((v or 0) + 10 * m + 100 * (t or 0))) for v in (1, 2, None) for m in (1, 2, 3) for t in (0, 1, 2, None) if (m, t) != (2, 1)]
    df = spark.createDataFrame([*rows, (1, 1, 0, 7.0)], "video_id long, mouse_id int, video_frame int, x double")
    one = lambda n, c: df.select("video_id", "video_frame", F.col("mouse_id").alias(n), F.col("x").alias(c))
    want = one("agent", "a_x").join(one("target", "b_x"), ["video_id", "video_frame"]).where("agent <> target")
    got = P.aligned(df)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_references_are_broadcast_to_lengths(spark, monkeypatch):
    """A few edges are never a reason to shuffle every length by its edge."""
    seen = []
    monkeypatch.setattr(Q, "written", lambda df, name: (seen.append((name, plan_of(df))), written(df, name))[1])
    entry.queries()["ql_reestimated"](spark, DATA)
    plan = dict(seen)["lengths"].split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "hashpartitioning(edge" not in plan


def test_places_that_travel_in_rows_are_those_joined(spark):
    rows = [(v, m, t, *[float((7 * t + 3 * i + m) % 11) if (t, i) != (4, 0) else None for i in range(14)]) for v in (1, 2) for m in (1, 2) for t in range(60)]
    df = spark.createDataFrame(rows, "video_id long, mouse_id int, video_frame int, " + ", ".join(f"{c} double" for c in XY))
    repairs = {n: BQ._over(n) for n in ("median", "mean")}
    got, want = (sorted(map(tuple, r4(B.recovery_grid(df, BQ.CORRUPTIONS, repairs, ["nose"], **how), 6).select("corruption", "repair", "keypoint", "before", "after", "recovered").collect())) for how in ({"columns": ["nose_x", "nose_y"], "in_rows": True}, {}))
    assert got == want and len(got) == 6


def test_recovery_joins_nothing(spark):
    """Clean, corrupt and repaired frames were three tables, joined for each repair: 21 times the tables on disk."""
    plan = plan_of(entry.queries()["bk_recovery"](spark, DATA))
    assert "Join" not in plan


def test_frames_by_window_from_ends(spark):
    a = spark.createDataFrame([r for r in some(80, 4) if r[5] > r[4]] + [(1, 1, 2, "u", -9, 0), (1, 1, None, "u", 3, 90)], ANN)
    f = I.frames_of(a).where("video_frame >= 0").select("video_id", F.col("agent_id").alias("mouse_id"), F.floor(F.col("video_frame") / 8).alias("win"), (F.col("agent_id") == F.col("target_id")).alias("own"))
    want = f.groupBy("video_id", "mouse_id", "win").agg(F.count_if("own").alias("_own"), F.count_if(~F.col("own")).alias("_other"))
    assert sorted(map(tuple, MQ._frames_by_window(a, 8).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["ml_bundle", "ml_permuted"])
def test_windows_are_made_once(spark, monkeypatch, name):
    """A fit reads its rows a dozen times; each time the poses were shuffled again, and classes were broadcast."""
    seen = []
    monkeypatch.setattr(MQ, "written", lambda df, n: (seen.append((n, plan_of(df))), written(df, n))[1])
    entry.queries()[name](spark, DATA).count()
    assert [n for n, _ in seen] == ["windows"] and "Broadcast" not in seen[0][1]
