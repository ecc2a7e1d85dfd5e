"""Sequential operators: Viterbi decoding, identity-swap repair, spectra, and the joint keypoint correction. Each runs per
group of rows (a video and an agent or mouse) as a grouped pandas function, the correction on many groups at once; groups are
as long as one video."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import tasks, written
from .frames import MOUSE, paired
from .identity import exchanged
from .minimise import Poses, changes, lbfgs_many, whole

# ---- Viterbi ---------------------------------------------------------------------------------------------------------


def transition_log_probs(labels: DataFrame, keys: list[str], order: list[str], classes: int, laplace: float = 1.0) -> DataFrame:
    """a, b, lp for all pairs of classes: Laplace-smoothed log transition probabilities; each row of a sums to 1."""
    nxt = labels.withColumn("b", F.lead("cls").over(Window.partitionBy(*keys).orderBy(*order))).where("b IS NOT NULL")
    n = nxt.groupBy(F.col("cls").alias("a"), "b").agg(F.count("*").alias("n"))
    grid = labels.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias("a"), (F.col("id") % classes).cast("int").alias("b"))
    n = grid.join(n, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + laplace)
    return n.select("a", "b", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("a"))).alias("lp"))


def viterbi_path(emission: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best path; emission: (steps, classes) log scores, trans: (classes, classes) log probabilities."""
    score, back = emission[0].copy(), np.zeros(emission.shape, np.int64)
    for t in range(1, len(emission)):
        step = score[:, None] + trans
        back[t] = step.argmax(axis=0)
        score = step[back[t], np.arange(len(score))] + emission[t]
    path = [int(score.argmax())]
    for t in range(len(emission) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def viterbi(windows: DataFrame, trans: DataFrame, classes: int, weight: float = 1.0, background: int = 0) -> DataFrame:
    """window_id and cls of the best path of each (video_id, agent), in order of core_start. windows: p and t (arrays of
    probabilities and thresholds) and allowed (array of booleans). Emissions are log(p / t), and 0 for the background;
    other classes that are not allowed are out; emissions count with `weight`. trans is a table of classes * classes rows.
    With equal transitions each window gets what the ratio rule gives it."""
    lp = np.zeros((classes, classes))
    for r in trans.collect():
        lp[r.a, r.b] = r.lp

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["core_start", "window_id"])
        p, t = np.stack(pdf["p"]).astype(float), np.stack(pdf["t"]).astype(float)
        e = np.log(np.maximum(p, 1e-12)) - np.log(np.maximum(t, 1e-6))
        e[:, background] = 0
        out = ~np.stack(pdf["allowed"]).astype(bool)
        out[:, background] = False
        e[out] = -1e9
        return pd.DataFrame({"window_id": pdf["window_id"], "cls": viterbi_path(weight * e, lp)})

    return windows.select("video_id", "agent", "window_id", "core_start", "p", "t", "allowed").groupBy("video_id", "agent").applyInPandas(of, "window_id long, cls int")


# ---- identity swaps --------------------------------------------------------------------------------------------------


def swap_flags(wide: DataFrame, keypoint: str = "neck", alpha: float = 0.4, vote: int = 7) -> DataFrame:
    """video_id, a, b, video_frame, swapped: whether two mice of a video (each pair, a < b) seem to carry each other's
    identity, by one keypoint's places alone (identity.pair_scores has more cues).

    Each mouse's place is predicted by an exponential mean of its steps (recursive, so per video and pair in one task); a
    frame that fits the crossed assignment better flips the state; a centred vote of `vote` frames smooths it."""
    places = [f"{s}_{keypoint}_{x}" for s in "ab" for x in "xy"]
    d = paired(wide, [f"{keypoint}_x", f"{keypoint}_y"])

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("video_frame")
        at = pdf[places].to_numpy(float).reshape(-1, 2, 2)
        last, speed, state, out = None, np.zeros((2, 2)), False, []
        for now in at:
            if not np.isfinite(now).all():
                out.append(state)
                continue
            if last is None:
                last = now
                out.append(state)
                continue
            guess = last + speed
            mine = now[::-1] if state else now
            stay, cross = (np.hypot(*(guess - m).T).sum() for m in (mine, mine[::-1]))
            if np.log((stay + 1e-6) / (cross + 1e-6)) > np.log(2):
                state, mine = not state, mine[::-1]
            speed = alpha * (mine - last) + (1 - alpha) * speed
            last = mine
            out.append(state)
        h, flags = vote // 2, np.array(out, float)
        total = np.cumsum(np.r_[0, flags])
        n = len(flags)
        lo, hi = np.maximum(np.arange(n) - h, 0), np.minimum(np.arange(n) + h + 1, n)
        return pdf[["video_id", "a", "b", "video_frame"]].assign(swapped=(total[hi] - total[lo]) * 2 > hi - lo)

    mouse = wide.schema["mouse_id"].dataType.simpleString()
    return d.groupBy("video_id", "a", "b").applyInPandas(of, f"video_id long, a {mouse}, b {mouse}, video_frame long, swapped boolean")


def unswapped(wide: DataFrame, flags: DataFrame) -> DataFrame:
    """wide with the mice of a pair exchanged on its flagged frames; several pairs of a frame in their order."""
    return exchanged(wide, flags.where("swapped").select("video_id", "video_frame", "a", "b", F.struct("a", "b").alias("order")))


# ---- spectra ---------------------------------------------------------------------------------------------------------


def welch(x: np.ndarray, size: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power spectrum: Hann windows, half overlapping, means taken off; frequencies in cycles per frame."""
    size = min(size, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = [x[i : i + size] for i in range(0, len(x) - size + 1, max(size // 2, 1))]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * w)) ** 2 for p in parts], axis=0) / (w**2).sum()
    power[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size), power


def spectral_metrics(wide: DataFrame, column: str, keys: tuple[str, ...] = ("video_id", "mouse_id"), high: float = 0.2) -> DataFrame:
    """Per mouse: share of power above `high`, spectral entropy, and the frequency below which 95 % of the power lies."""

    def of(key, pdf):
        x = pdf.sort_values("video_frame")[column].dropna().to_numpy(float)
        if len(x) < 8 or x.std() == 0:
            return pd.DataFrame([[*key, None, None, None]], columns=[*keys, "high_share", "entropy", "bandwidth"])
        f, p = welch(x)
        q = p / p.sum()
        return pd.DataFrame([[*key, q[f > high].sum(), -(q * np.log(q + 1e-12)).sum() / np.log(len(q)), f[np.searchsorted(q.cumsum(), 0.95)]]], columns=[*keys, "high_share", "entropy", "bandwidth"])

    schema = ", ".join(f"{k} {wide.schema[k].dataType.simpleString()}" for k in keys) + ", high_share double, entropy double, bandwidth double"
    return wide.select(*keys, "video_frame", column).groupBy(*keys).applyInPandas(of, schema)


# ---- joint correction ------------------------------------------------------------------------------------------------


def lbfgs(fun, x: np.ndarray, rounds: int = 60, memory: int = 8, gtol: float = 1e-6) -> np.ndarray:
    """Minimise fun (value, gradient) by limited-memory BFGS with a backtracking line search; never raises the value."""
    f, g = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < gtol:
            break
        d, kept = g.copy(), []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            kept.append(a)
            d -= a * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            d += s * (a - y @ d / (s @ y))
        slope = g @ d
        if slope <= 0:
            d, slope, steps = g.copy(), g @ g, []
        size = 1.0 if steps else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
        for _ in range(25):
            fn, gn = fun(x - size * d)
            if fn <= f - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = -size * d, gn - g
        x = x + s
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = f - fn < 1e-9 * max(abs(f), 1)
        f, g = fn, gn
        if done:
            break
    return x


#: Body lengths at which adhesion turns linear, relative length at which an edge's error does, what is added
#: under the roots of velocity, acceleration and jerk, and the weights of the terms.
ADHESION_TURN, EDGE_TURN, UNDER_ROOTS = 0.5, 0.3, (0.05, 0.02, 0.01)
EDGE_WEIGHT, SMOOTH_WEIGHTS, ANGLE_WEIGHT = 6.5, (1.8, 0.6, 0.35), 4.0
#: Joints (a, b, c) that resist bending at b.
JOINTS = (
    ("nose", "neck", "tail_base"), ("ear_left", "neck", "ear_right"), ("hip_left", "tail_base", "hip_right"),
    ("nose", "neck", "hip_left"), ("nose", "neck", "hip_right"), ("neck", "hip_left", "tail_base"), ("neck", "hip_right", "tail_base"),
    ("nose", "neck", "ear_left"), ("nose", "neck", "ear_right"), ("hip_left", "neck", "hip_right"),
)


def correction_cost(x: np.ndarray, seen: np.ndarray, weight: np.ndarray, edges: np.ndarray, lengths: np.ndarray, edge_weight: float, smooth: tuple[float, ...], body: float, joints: np.ndarray | None = None, angle_weight: float = 0.0):
    """Cost and gradient of poses x (frames, keypoints, 2): Huber adhesion to what was seen (weight: per frame and
    keypoint), Huber relative edge lengths, roots of squared velocity, acceleration and jerk, and squared areas at joints."""
    g = np.zeros_like(x)
    square = body**2
    ok = np.isfinite(seen).all(-1)
    r = np.where(ok[..., None], x - np.where(ok[..., None], seen, 0), 0)
    n, turn = np.sqrt((r**2).sum(-1)), ADHESION_TURN * body
    w = weight * ok
    cost = (w * np.where(n > turn, turn * (2 * n - turn), n**2)).sum() / square
    g += 2 * (w * np.where(n > turn, turn / np.maximum(n, 1e-12), 1))[..., None] * r / square
    v = x[:, edges[:, 0]] - x[:, edges[:, 1]]
    d = np.sqrt((v**2).sum(-1) + 1e-12)
    e = d / lengths - 1
    far = np.abs(e) > EDGE_TURN
    cost += edge_weight * np.where(far, EDGE_TURN * (2 * np.abs(e) - EDGE_TURN), e**2).sum()
    push = 2 * (edge_weight * np.where(far, EDGE_TURN * np.sign(e), e) / (lengths * d))[..., None] * v
    for k, (a, b) in enumerate(edges):
        g[:, a] += push[:, k]
        g[:, b] -= push[:, k]
    if joints is not None and len(joints) and angle_weight:
        a, b, c = joints.T
        u, v = x[:, a] - x[:, b], x[:, c] - x[:, b]
        area = (u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]) / square
        cost += angle_weight * (area**2).sum()
        pull = (2 * angle_weight / square * area)[..., None]
        to_u, to_v = pull * np.stack([v[..., 1], -v[..., 0]], -1), pull * np.stack([-u[..., 1], u[..., 0]], -1)
        for k in range(len(joints)):
            g[:, a[k]] += to_u[:, k]
            g[:, c[k]] += to_v[:, k]
            g[:, b[k]] -= to_u[:, k] + to_v[:, k]
    for order, (lam, eps) in enumerate(zip(smooth, UNDER_ROOTS), 1):
        if len(x) <= order or not lam:
            continue
        z = np.diff(x, order, axis=0)
        root = np.sqrt((z**2).sum(-1) + eps)
        cost += lam * root.sum() / square
        h = lam * z / root[..., None] / square
        for k in range(order + 1):
            g[k : len(x) - order + k] += (-1) ** (order - k) * comb(order, k) * h
    return cost, g


#: Frames that are minimised in step, about.
CHUNK = 4096


def filled(seen: np.ndarray, starts: list[int]) -> np.ndarray:
    """seen with gaps between the rows before and after, of the same run (from one start to the next); the nearest row
    beyond its first and last one, 0 where it has none."""
    out = seen.copy()
    for i, j in zip(starts, starts[1:]):
        at = np.arange(j - i)
        for c in np.flatnonzero(np.isnan(seen[i:j]).any(0)):
            ok = np.isfinite(seen[i:j, c])
            out[i:j, c] = np.interp(at, at[ok], seen[i:j, c][ok]) if ok.any() else 0.0
    return out


def corrected(wide: DataFrame, keypoints: list[str], unit: float, edge_weight: float = EDGE_WEIGHT, smooth: tuple[float, ...] = SMOOTH_WEIGHTS, angle_weight: float = ANGLE_WEIGHT, window: int = 64, reach: float = 1.0) -> DataFrame:
    """Keypoints of each mouse moved to the least cost, window by window, the windows of many mice in step; gaps are filled
    on the way. A point moves at most reach * unit from where it was seen. Same columns as wide's keys and keypoints. Columns <keypoint>_w, where wide has
    them, weigh how far a point is to stay where it was seen (1 where not given)."""
    at = {k: i for i, k in enumerate(keypoints)}
    pairs = [(at[a], at[b], n * unit) for (a, b), n in zip(G.EDGES, G.DEFAULT_LENGTHS) if a in at and b in at]
    edges, lengths = np.array([p[:2] for p in pairs]).reshape(-1, 2), np.array([p[2] for p in pairs])
    joints = np.array([[at[k] for k in j] for j in JOINTS if all(k in at for k in j)]).reshape(-1, 3)
    cols = [f"{k}_{a}" for k in keypoints for a in "xy"]
    given = [f"{k}_w" for k in keypoints if f"{k}_w" in wide.columns]
    keys = [*MOUSE, "video_frame"]

    def of(batches):
        for pdf in whole(batches, MOUSE):
            starts = [*np.flatnonzero(changes(pdf, MOUSE)), len(pdf)]
            seen, weight = pdf[cols].to_numpy(float), np.ones((len(pdf), len(keypoints)))
            for c in given:
                weight[:, at[c[:-2]]] = pdf[c].fillna(1.0)
            start = filled(seen, starts)
            out = np.empty_like(start)
            spans = [(k, min(k + window, j)) for i, j in zip(starts, starts[1:]) for k in range(i, j, window)]
            for size in {j - i for i, j in spans}:  # whole windows, and the ends of mice
                firsts = np.array([i for i, j in spans if j - i == size])
                many = max(1, CHUNK // size)
                for rows in (firsts[k : k + many] + np.arange(size)[:, None] for k in range(0, len(firsts), many)):
                    out[rows] = moved(seen[rows], start[rows], weight[rows])
            yield pd.concat([pdf[keys], pd.DataFrame(out, columns=cols)], axis=1)

    def moved(seen, start, weight):
        """Places (frames, windows, columns) of least cost, at most reach * unit from start."""
        points = lambda v: np.ascontiguousarray(np.moveaxis(v.reshape(*v.shape[:2], -1, 2), (3, 2), (0, 1)))
        s, x0 = points(seen), points(start)
        ok = np.isfinite(s).all(0)
        one = np.ones((1, 1))
        problem = Poses(x0, np.where(ok, s, 0.0), np.moveaxis(weight, 2, 0) * ok, {"edges": edges, "lengths": lengths, "joints": joints if angle_weight else joints[:0], "unit": unit}, edge_weight * one[None], angle_weight * one, [lam * one for lam in smooth], (ADHESION_TURN, EDGE_TURN), UNDER_ROOTS)
        move = problem.filled(lbfgs_many(problem, problem.first())) - x0
        n = np.sqrt((move**2).sum(0))
        x = x0 + move * np.minimum(1, reach * unit / np.maximum(n, 1e-12))
        return np.moveaxis(x, (0, 1), (3, 2)).reshape(seen.shape)

    types = ", ".join(f"{k} {wide.schema[k].dataType.simpleString()}" for k in keys) + ", " + ", ".join(f"{c} double" for c in cols)
    dealt = wide.select(*keys, *cols, *given).repartition(tasks(wide.sparkSession), *MOUSE).sortWithinPartitions(*keys)
    return dealt.mapInPandas(of, types)


# ---- thresholds ------------------------------------------------------------------------------------------------------


#: 0.02 to 0.28 by 0.02, and 0.30 to 0.90 by 0.05.
GRID = (*(round(0.02 * i, 2) for i in range(1, 15)), *(round(0.30 + 0.05 * i, 2) for i in range(13)))


def tuned_thresholds(long: DataFrame, grid: tuple[float, ...] = GRID, passes: int = 2, background: int = 0, start: float = 0.5) -> DataFrame:
    """lab_id, cls, t, score: thresholds by coordinate ascent of the mean window F1 of a lab, all labs at once. For each
    class in turn every window decides under all grid values, and only counts by (lab, value, class) leave the tasks; a
    value replaces the old one only if it is better, the smallest such value first. Ends early when no lab gains. long:
    lab_id, window_id, cls, p, y. One job a class and pass; thresholds are a row per lab and class."""
    names = sorted(r[0] for r in long.select("cls").distinct().collect())  # one row a class
    d = long.groupBy("lab_id", "window_id").agg(F.first("y").cast("int").alias("y"), F.sort_array(F.collect_list(F.struct("cls", "p"))).alias("x"))
    d = written(d.select("lab_id", "y", F.col("x.p").alias("p")), "probabilities")
    labs = [r[0] for r in d.select("lab_id").distinct().collect()]  # one row a lab
    now = {lab: [start] * len(names) for lab in labs}
    bg = names.index(background)

    def scores(k: int, values: tuple[float, ...]) -> dict:
        """Mean F1 of (lab, value), class k's threshold being value."""
        held = d.sparkSession.createDataFrame([(lab, t) for lab, t in now.items()], "lab_id long, t array<double>")
        each = d.join(F.broadcast(held), "lab_id").withColumn("v", F.explode(F.array(*[F.lit(float(v)) for v in values])))
        gap = F.zip_with("p", F.transform("t", lambda t, i: F.when(i == k, F.col("v")).otherwise(t)), lambda p, t: p - t)
        gap = F.transform(gap, lambda g, i: F.when(i == bg, 0.0).otherwise(g))
        pred = F.get(F.array(*map(F.lit, names)), F.array_position(gap, F.array_max(gap)).cast("int") - 1)
        c = each.select("lab_id", "v", "y", F.when(F.array_max(gap) > 0, pred).otherwise(background).alias("c")).groupBy("lab_id", "v", "y", "c").agg(F.count("*").alias("n"))
        ends = F.array(F.struct(F.col("y").alias("cls"), F.col("n").alias("s"), F.when(F.col("y") == F.col("c"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("c").alias("cls"), F.col("n").alias("s"), F.lit(0).cast("long").alias("tp")))
        f = c.select("lab_id", "v", F.inline(ends)).where(F.col("cls") != background).groupBy("lab_id", "v", "cls").agg((2.0 * F.sum("tp") / F.sum("s")).alias("f1"))
        total = f.groupBy("lab_id", "v").agg((F.sum("f1") / (len(names) - 1)).alias("score"))
        return {(r["lab_id"], r["v"]): r["score"] for r in total.collect()}  # a row per lab and value

    first = scores(bg, (start,))
    best = {lab: first.get((lab, float(start)), 0.0) for lab in labs}
    for _ in range(passes):
        was = dict(best)
        for k in range(len(names)):
            if k == bg:
                continue
            got = scores(k, grid)
            for lab in labs:
                for v in grid:
                    if (s := got.get((lab, float(v)), 0.0)) > best[lab] + 1e-12:
                        best[lab], now[lab][k] = s, float(v)
        if best == was:
            break
    rows = [(lab, c, now[lab][k], best[lab]) for lab in labs for k, c in enumerate(names)]
    return d.sparkSession.createDataFrame(rows, "lab_id long, cls int, t double, score double")


# ---- shape-preserving fill -------------------------------------------------------------------------------------------


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation through (x, y), x rising; the end values beyond the ends."""
    if len(x) == 1:
        return np.full(len(at), y[0])
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    d = np.zeros(len(x))
    if len(x) == 2:
        d[:] = s[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = s[1:] * s[:-1] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            d[1:-1] = np.where(same, (w1 + w2) / (w1 / s[:-1] + w2 / s[1:]), 0)
        for k, (h0, h1, s0, s1) in ((0, (h[0], h[1], s[0], s[1])), (-1, (h[-1], h[-2], s[-1], s[-2]))):
            e = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
            d[k] = 0 if e * s0 <= 0 else 3 * s0 if s0 * s1 <= 0 and abs(e) > 3 * abs(s0) else e
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    t = (np.clip(at, x[0], x[-1]) - x[i]) / h[i]
    return y[i] * (1 + 2 * t) * (1 - t) ** 2 + h[i] * d[i] * t * (1 - t) ** 2 + y[i + 1] * t**2 * (3 - 2 * t) + h[i] * d[i + 1] * t**2 * (t - 1)


def spline_filled(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps of each mouse's columns filled by monotone cubics; a column without any value stays empty."""
    keys = ["video_id", "mouse_id", "video_frame"]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("video_frame").reset_index(drop=True)
        f = pdf["video_frame"].to_numpy(float)
        for c in columns:
            v = pdf[c].to_numpy(float)
            ok = np.isfinite(v)
            if ok.any() and not ok.all():
                pdf[c] = np.where(ok, v, pchip(f[ok], v[ok], f))
        return pdf

    types = ", ".join(f"{c} {wide.schema[c].dataType.simpleString()}" for c in [*keys, *columns])
    return wide.select(*keys, *columns).groupBy("video_id", "mouse_id").applyInPandas(of, types)
