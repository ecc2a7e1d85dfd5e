"""The gate, distances, settings and signals of studies against plain Python."""

import random
from itertools import combinations, product

import numpy as np
import pytest

from ethogrid.operators import search as Se
from ethogrid.operators import studies as St


@pytest.mark.parametrize("seed", range(4))
def test_gate_equals_every_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(g, 10 * g + v, round(rng.random(), 1), round(rng.random(), 2), round(rng.random(), 2)) for g in (0, 1) for v in range(rng.choice([2, 9, 10]))] + [(2, 99, 0.5, 0.1, 0.9), (0, 77, None, 0.5, 0.6)]
    got = {(r.lab_id, r.video_id): r for r in St.quality_gate(spark.createDataFrame(rows, "lab_id int, video_id int, q double, raw double, cor double"), "lab_id").collect()}
    known = [r for r in rows if r[2] is not None and r[0] != 2]
    assert set(got) == {r[:2] for r in known}
    for g, v, q, raw, cor in known:
        others = [r for r in known if r[0] == g and r[1] != v]
        taus = sorted({r[2] for r in others})
        best, tau = -9.0, None
        for t in [taus[0] - 1e-9, *taus]:
            mean = round(sum((r[4] if r[2] > t else r[3]) for r in others) / len(others), 9)
            if mean > best:
                best, tau = mean, t
        assert got[g, v].tau == pytest.approx(tau, abs=1e-12) and got[g, v].gated == (cor if q > tau else raw)


def test_distances_of_all_pairs(spark):
    rng = random.Random(1)
    rows = [(v, a, float(rng.randint(0, 6 + a))) for v in (1, 2) for a in (1, 2, 3) for _ in range(20 * a) if (v, a) != (2, 3)] + [(1, 1, None), (1, 2, float("nan"))]
    got = {(r.video_id, r.a, r.b): (r.n_a, r.n_b, r.ks) for r in St.ks_between(spark.createDataFrame(rows, "video_id int, animal int, v double"), "v", "animal", [1, 2, 3, 4], "video_id").collect()}
    for v in (1, 2):
        for a, b in combinations((1, 2, 3, 4), 2):
            x, y = ([r[2] for r in rows if r[:2] == (v, k) and r[2] is not None and r[2] == r[2]] for k in (a, b))
            if not x or not y:
                assert (v, a, b) not in got
                continue
            ks = max(abs(np.mean(np.array(x) <= t) - np.mean(np.array(y) <= t)) for t in [*x, *y])
            assert got[v, a, b] == (len(x), len(y), pytest.approx(ks))


def test_all_settings_from_counts(spark):
    rng = random.Random(2)
    rows = [(v, rng.choice([None, rng.random()]), rng.random(), rng.random()) for v in (1, 2, 3) for _ in range(10 * v)]
    cues = {"a": (0.2, 0.5, 0.8), "b": (0.5, 0.9), "c": (0.9,)}
    s = St.detector_settings(spark.createDataFrame(rows, "video_id int, a double, b double, c double"), cues)
    got = {(r.a, r.b, r.c): r for r in s.collect()}
    assert len(got) == 6
    for t in product(*cues.values()):
        flag = lambda r: [x is not None and x > y for x, y in zip(r[1:], t)]  # noqa: B023, E731
        mean = lambda f: np.mean([np.mean([f(r) for r in rows if r[0] == v]) for v in (1, 2, 3)])
        assert got[t].flagged == pytest.approx(mean(lambda r: any(flag(r)))) and got[t].a_share == pytest.approx(mean(lambda r: flag(r)[0])) and got[t].c_share == pytest.approx(mean(lambda r: flag(r)[2]))
    best = St.calibrated(s, ("a", 0.3), ("b", 0.0, 0.4), 0.5).first()
    fit = [r for r in got.values() if r.a_share <= 0.3 and 0 <= r.b_share <= 0.4] or [r for r in got.values() if r.a_share <= 0.3]
    assert best.flagged == pytest.approx(min(fit, key=lambda r: abs(r.flagged - 0.5)).flagged)
    with pytest.raises(ValueError):
        St.detector_settings(spark.createDataFrame(rows, "video_id int, a double, b double, c double"), {"a": (0.5, 0.2)})


def test_lag_and_coherence(spark):
    rng = np.random.default_rng(3)
    x = np.convolve(rng.normal(size=420), np.ones(9) / 9, "valid")
    for shift in (0, 4, -7):
        y = np.roll(x, shift) + rng.normal(size=len(x)) * 0.01
        like, coherence, lag, degrees = St.signal_agreement(x, y, 30.0)
        assert lag == shift and degrees == pytest.approx(abs(shift) / len(x) * 360) and like > 0.99 and coherence > 0.7
    noise = St.signal_agreement(x, rng.normal(size=len(x)), 30.0)
    assert noise[1] < 0.5
    a, b = x.copy(), np.roll(x, 5)
    a[40:60], b[200:210] = np.nan, np.nan
    both = np.isfinite(a) & np.isfinite(b)
    da, db = np.where(both, a - a[both].mean(), 0), np.where(both, b - b[both].mean(), 0)
    plain = np.correlate(db, da, "full")
    assert St.signal_agreement(a, b, 30.0)[2] == plain.argmax() - (len(a) - 1) == 5
    assert St.signal_agreement(x[:10], x[:10], 30.0) == (None,) * 4 == St.signal_agreement(np.ones(50), x[:50], 30.0)
    rows = [(1, 1, t, float(x[t]), float(x[t - 3]) if t >= 3 else None) for t in range(100)]
    r = St.agreement(spark.createDataFrame(rows, "video_id int, mouse_id int, video_frame int, a double, b double"), "a", "b", 30.0).first()
    assert r.lag == 3


def test_search_beats_even_draws_and_repeats_itself(spark):
    space = {"a": (0.0, 1.0), "b": (0.001, 1000.0, "log"), "c": ["x", "y", "z"]}

    def planted(p):
        return -((p["a"] - 0.7) ** 2) * 4 - (np.log10(p["b"]) - 1) ** 2 / 4 - 0.5 * (p["c"] != "y")

    def best(trials, first, seed):
        history = []
        for t in range(trials):
            p = Se.proposed(history, space, t, seed, first)
            assert 0 <= p["a"] <= 1 and 0.001 <= p["b"] <= 1000.0001 and p["c"] in "xyz"
            history.append((p, planted(p)))
        return max(h[1] for h in history)

    found, even = ([best(40, first, seed) for seed in range(12)] for first in (8, 40))
    assert np.mean(found) > np.mean(even) and sum(f > e for f, e in zip(found, even)) >= 8
    one, two = (Se.searched(spark, space, planted, trials=12, seed=3).collect() for _ in range(2))
    assert one == two and one[-1].best == max(r.score for r in one) and len(one) == 12
    assert Se.searched(spark, space, lambda p: float("nan"), trials=3).count() == 3
