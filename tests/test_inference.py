"""Lab bundles, out-of-fold predictions and calibration against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethogrid.operators import inference as In

WIN = "lab_id long, video_id long, agent int, target int, window_id long, core_start long, core_stop long, a double, b double, y int, fold int"
NAMES = ["background", "x", "y"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for v in range(6):
        for i in range(60):
            y = rng.choice([0, 0, 1, 2])
            sign = 1 if v % 3 != 1 else -1  # lab 1 works the other way round: its own model is needed
            out.append((v % 3, v, 1 + i % 2, 2 - i % 2, len(out), i // 2 * 8, i // 2 * 8 + 8, sign * (y == 1) * 2 + rng.gauss(0, 0.5), None if rng.random() < 0.05 else sign * (y == 2) * 2 + rng.gauss(0, 0.5), y, v // 3))
    return out


def brute(row, bundle):
    x = [((v if v is not None else m) - m) / s for v, m, s in zip(row[7:9], bundle.means, bundle.scales)]
    z = np.array([np.dot(w, x) + b for w, b in zip(bundle.weights, bundle.bias)])
    e = np.exp(z - z.max())
    return e / e.sum()


def test_one_job_equals_lab_by_lab(spark, rows):
    df = spark.createDataFrame(rows, WIN)
    bundles = In.lab_bundles(df.where("lab_id < 2"), ["a", "b"], 3)
    by = {r.lab_id: r for r in bundles.collect()}
    assert set(by) == {0, 1, None}
    got = {r.window_id: r.p for r in In.scored(df, ["a", "b"], bundles).collect()}
    for r in rows:
        assert got[r[4]] == pytest.approx(brute(r, by.get(r[0], by[None])), abs=1e-9)
    right = np.mean([np.argmax(got[r[4]]) == r[9] for r in rows if r[0] < 2])
    assert right > 0.85
    active = spark.createDataFrame([(v, a, None if c == 1 else 3 - a, c) for v in range(6) for a in (1, 2) for c in (1, 2)], "video_id long, agent int, target int, cls int")
    withs = bundles.withColumn("t", F.array(F.lit(0.5), F.lit(0.4), F.lit(0.3)))
    stats = spark.createDataFrame([(0, "x", 16.0, 8.0), (1, "y", 0.0, 16.0)], "lab_id long, action string, min_dur double, max_gap double")
    every = sorted(In.submission(df, ["a", "b"], withs, active, NAMES, stats).collect())
    each = []
    for lab in (0, 1, 2):
        each += In.submission(df.where(F.col("lab_id") == lab), ["a", "b"], withs.where("lab_id IS NULL" if lab == 2 else f"lab_id = {lab}"), active, NAMES, stats.where(F.col("lab_id") == lab)).collect()
    assert every == sorted(each) and len(every) > 20
    assert all(r.target_id == (r.agent_id if r.action == "x" else 3 - r.agent_id) for r in every)
    assert all(r.stop_frame - r.start_frame >= 16 for r in every if (r.lab_id, r.action) == (0, "x"))
    assert In.submission(df.limit(0), ["a", "b"], withs, active, NAMES).count() == 0


def test_out_of_fold_rows_are_by_models_of_other_folds(spark, rows):
    df = spark.createDataFrame(rows, WIN)
    got = In.out_of_fold(df, ["a", "b"], 3)
    assert got.count() == len(rows)
    other = {r.lab_id: r for r in In.lab_bundles(df.where("fold <> 0"), ["a", "b"], 3).collect()}
    for r in got.where("fold = 0").collect():
        assert r.p == pytest.approx(brute(rows[r.window_id], other[r.lab_id]), abs=1e-6)


def brute_isotonic(n, s):
    """The max-min form of isotonic regression."""
    k = len(n)
    mean = lambda a, b: sum(s[a : b + 1]) / sum(n[a : b + 1])
    return [max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]


@pytest.mark.parametrize("seed", range(5))
def test_pooling(seed):
    rng = random.Random(seed)
    n = [rng.randint(1, 9) for _ in range(30)]
    s = [rng.randint(0, x) for x in n]
    assert In.pooled(np.array(n, float), np.array(s, float)) == pytest.approx(brute_isotonic(n, s))


def test_calibration(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        p = rng.random()
        rows.append((i, i % 2, int(rng.random() < p**3), [1 - p, p]))  # class 1 comes less often than p says
    df = spark.createDataFrame(rows, "window_id long, lab_id long, y int, p array<double>")
    table = In.calibrators(df, 2)
    q = {(r.lab_id, r.cls, r["at"]): r.q for r in table.collect()}
    assert len(q) == 2 * 2 * 101 and all(q[lab, c, k] <= q[lab, c, k + 1] + 1e-12 for lab in (0, 1) for c in (0, 1) for k in range(100))
    assert abs(q[0, 1, 50] - 0.125) < 0.12 and abs(q[1, 1, 80] - 0.512) < 0.15
    out = In.calibrated(df, table, 2).collect()
    assert all(sum(r.q) == pytest.approx(1) for r in out) and len(out) == 3000
    loss = lambda key: -np.mean([np.log(max(r[key][r.y], 1e-6)) for r in out])
    assert loss("q") < loss("p")
    other = In.calibrated(df.withColumn("lab_id", F.lit(9).cast("long")), table, 2).first()
    assert other.q == pytest.approx(other.p, abs=1e-6)
    assert In.calibrators(df.limit(0)).count() == 0


def test_bags(spark):
    df = spark.range(2000)
    one, two = (sorted(map(tuple, In.bag_weights(x, 3, ["id"]).collect())) for x in (df, df.repartition(5)))
    assert one == two and len({b for _, b, _ in one}) == 3
    assert abs(sum(w for *_, w in one) / 6000 - 1) < 0.06 and abs(len(one) / 6000 - (1 - np.exp(-1))) < 0.03
