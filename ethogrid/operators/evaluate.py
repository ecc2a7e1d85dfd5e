"""Evaluation: label codes, pairing of variants, folds of left-out videos, paired tests, and report rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .stats import average_rank


def encoded(label: Column, classes: list[str]) -> Column:
    """Place of the label among the classes; -1 for others (the background, NULL)."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, classes)), label), F.lit(0)).cast("int") - 1


def decoded(code: Column, classes: list[str], background: str = "background") -> Column:
    return F.coalesce(F.when(code >= 0, F.get(F.array(*map(F.lit, classes)), code)), F.lit(background))


def vocabulary(ann: DataFrame, max_frame: int | None = None) -> DataFrame:
    """The actions of all videos, or of those intervals that begin before max_frame."""
    return (ann if max_frame is None else ann.where(F.col("start_frame") < max_frame)).select("action").distinct()


def paired(a: DataFrame, b: DataFrame, keys: list[str], label: str = "y") -> DataFrame:
    """The rows that both variants have, keys being unique in each: keys, label and structs a, b of their other columns.
    A pair with different labels ends the job."""
    side = lambda df, n: df.select(*keys, F.col(label).alias(f"_{n}"), F.struct(*[c for c in df.columns if c not in (*keys, label)]).alias(n))
    both = side(a, "a").join(side(b, "b"), keys)
    same = F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("_a")).otherwise(F.raise_error(F.lit("labels differ between paired rows")))
    return both.select(*keys, same.alias(label), "a", "b")


def reattached(df: DataFrame, extra: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with further columns of extra, of which one row a key counts (that with the smallest values)."""
    one = extra.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_x"))
    return df.join(one, keys, "left").select(*df.columns, *[F.col(f"_x.{c}").alias(c) for c in columns])


def fold_metrics(df: DataFrame, evaluable: DataFrame, fold: str = "fold", true: str = "y", pred: str = "pred") -> DataFrame:
    """Per fold: macro F1 over evaluable classes with support in the fold, and over all classes that are true or predicted
    there. evaluable: a column of `true`."""
    c = df.groupBy(fold, true, pred).agg(F.count("*").alias("n"))
    ends = F.array(F.struct(F.col(true).alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col(pred).alias("cls"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))
    g = c.select(fold, F.inline(ends)).groupBy(fold, "cls").agg(*[F.sum(k).alias(k) for k in ("t", "p", "tp")])
    g = g.withColumn("f1", 2.0 * F.col("tp") / (F.col("t") + F.col("p")))
    known = evaluable.select(F.col(true).alias("cls"), F.lit(True).alias("_known"))
    g = g.join(known, "cls", "left")
    counted = F.col("_known") & (F.col("t") > 0)
    return g.groupBy(fold).agg(F.avg(F.when(counted, F.col("f1"))).alias("macro_eval"), F.avg("f1").alias("macro_full"), F.sum("t").alias("support"))


def with_suffixes(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Results of two variants side by side, for keys that both have with values everywhere."""
    named = lambda df, s: df.select(*keys, *[F.col(c).alias(c + s) for c in df.columns if c not in keys])
    return named(a, suffixes[0]).join(named(b, suffixes[1]), keys).dropna()


def exact_p(w: Column, n: Column) -> Column:
    """Two-sided p of a signed-rank sum w (the smaller one) of n untied differences: the share of the 2 ** n signs whose
    sum is as small, twice. For n up to 30 or so."""
    size = (n * (n + 1) / 2).cast("int")
    one = F.transform(F.sequence(F.lit(0), size), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), one, lambda acc, r: F.transform(acc, lambda x, i: x + F.coalesce(F.when(i >= r, F.get(acc, i - r)), F.lit(0.0))))
    below = F.aggregate(F.slice(ways, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def compared(pairs: DataFrame, base: str, variants: list[str]) -> DataFrame:
    """Signed-rank test of base against each variant over the rows of pairs: w, n, exact p (no ties and n up to 25, else
    null), effect 1 - 2w / n(n+1), better (the sign of the median difference, if p < 0.05)."""
    long = pairs.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), (F.col(base) - F.col(v)).alias("d")) for v in variants]))).where("d <> 0")
    long = long.withColumn("a", F.abs("d")).withColumn("r", average_rank("a", ["variant"]))
    g = long.groupBy("variant").agg(F.count("*").alias("n"), F.count_distinct("a").alias("k"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0)).alias("down"))
    g = g.withColumn("w", F.least("up", "down"))
    p = F.when((F.col("n") == F.col("k")) & F.col("n").between(1, 25), exact_p(F.col("w"), F.col("n")))
    effect = 1 - 2 * F.col("w") / (F.col("n") * (F.col("n") + 1))
    g = g.select("variant", "n", "w", p.alias("p"), effect.alias("effect"), "up", "down")
    verdict = F.when(F.col("p") < 0.05, F.when(F.col("up") > F.col("down"), base).otherwise(F.col("variant"))).otherwise("none")
    return g.select("variant", "n", "w", "p", "effect", verdict.alias("better"))


def spearman(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Correlation of average ranks, per group."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = d.withColumn("_a", average_rank(a, list(by))).withColumn("_b", average_rank(b, list(by)))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("rho"))


def against_random(curves: DataFrame, strategy: str, seed: str, score: str, base: str) -> DataFrame:
    """Mean and sample deviation of each strategy's score over seeds, and its mean difference to `base`, seed by seed."""
    ref = curves.where(F.col(strategy) == base).select(seed, F.col(score).alias("_ref"))
    d = curves.join(ref, seed)
    return d.groupBy(strategy).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.avg(F.col(score) - F.col("_ref")).alias("delta"))


def first_reaching(curves: DataFrame, strategy: str, n: str, score: str, share: float = 0.9) -> DataFrame:
    """Labels that a strategy needs to reach `share` of its own best score."""
    best = curves.groupBy(strategy).agg(F.max(score).alias("best"))
    return curves.join(best, strategy).where(F.col(score) >= share * F.col("best")).groupBy(strategy, "best").agg(F.min(n).alias("labels"))


def shares_above(rows: DataFrame, group: str, x: str, cuts: DataFrame) -> DataFrame:
    """train, test, score: the share of group test's rows whose x exceeds train's cut. Each row counts the cuts below it,
    once; the rest is running sums over groups times cuts. cuts: train, cut (a row a group)."""
    one = cuts.agg(F.sort_array(F.collect_list(F.struct("cut", "train"))).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c["cut"] < F.col(x)))
    n = rows.crossJoin(F.broadcast(one)).groupBy(F.col(group).alias("test"), (below - 1).alias("pos")).agg(F.count("*").alias("n"), F.first("_cuts").alias("_cuts"))  # one row
    places = n.groupBy("test").agg(F.first("_cuts").alias("_cuts")).select("test", F.posexplode("_cuts").alias("pos", "c"))
    both = n.select("test", "pos", "n", F.lit(None).alias("train")).unionByName(places.select("test", "pos", F.lit(0).alias("n"), "c.train"))
    w = Window.partitionBy("test").orderBy(F.desc("pos"))
    above = both.withColumns({"a": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("test"))})
    return above.where("train IS NOT NULL").select("train", "test", (F.col("a") / F.col("all")).alias("score"))


def cross_mean(matrix: DataFrame, train: str, test: str, score: str) -> DataFrame:
    """Mean score on the own lab and on the others, and the gap."""
    own = F.avg(F.when(F.col(train) == F.col(test), F.col(score)))
    other = F.avg(F.when(F.col(train) != F.col(test), F.col(score)))
    return matrix.groupBy(train).agg(own.alias("own"), other.alias("others"), (own - other).alias("gap"))


def lab_thresholds(sigma: DataFrame, lab: str, overall: float, k: float = 3.0, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Mean of k sigma over a lab's edges, within [low, high] times the overall threshold. sigma: lab, edge, sigma."""
    return sigma.groupBy(lab).agg(F.least(F.lit(high * overall), F.greatest(F.lit(low * overall), F.avg(k * F.col("sigma")))).alias("threshold"))


def routed(decided: DataFrame, active: DataFrame) -> DataFrame:
    """target_id of each decided window: the agent itself where the video annotates the class as directed at oneself, else
    the other mouse. active: video_id, agent, target (NULL: self), cls."""
    own = active.where("target IS NULL").select("video_id", "agent", "cls").distinct().withColumn("_own", F.lit(True))
    d = decided.join(own, ["video_id", "agent", "cls"], "left")
    return d.withColumn("target_id", F.when(F.col("_own"), F.col("agent")).otherwise(F.col("target"))).drop("_own")


def population(frames: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per group: frames, known share, mean, sample deviation, least and most of each column, in long form."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = frames.select(group, F.inline(parts))
    return long.groupBy(group, "feature").agg(F.count("*").alias("frames"), F.avg(F.col("x").isNotNull().cast("int")).alias("known"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))


def decision_grid(masked: DataFrame, thresholds: DataFrame, modes: tuple[str, ...], scales: tuple[float, ...], background: int = 0) -> DataFrame:
    """lab_id, mode, scale, mask, score: mean F1 over the classes (but the background) of every setting of the decision
    layer, in one pass: each window decides under all settings, and only confusion counts meet. masked: window_id, lab_id,
    y, cls, p, allowed; thresholds: lab_id, cls, t."""
    d = masked.join(thresholds, ["lab_id", "cls"]).where(F.col("cls") != background)
    t = F.col("t")
    best = []
    for mode in modes:
        for s in scales:
            for mask in (True, False):
                merit = F.col("p") - s * t if mode == "residual" else F.col("p") / F.greatest(s * t, F.lit(1e-6))
                ok = (F.col("p") > s * t) & (F.col("allowed") if mask else F.lit(True))
                best.append((mode, s, mask, F.max_by("cls", F.when(ok, F.struct(merit.alias("m"), (-F.col("cls")).alias("c"))))))
    g = d.groupBy("window_id", "lab_id", "y").agg(*[b[3].alias(f"_{i}") for i, b in enumerate(best)])
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(float(s)).alias("scale"), F.lit(k).alias("mask"), F.coalesce(F.col(f"_{i}"), F.lit(background)).alias("pred")) for i, (m, s, k, _) in enumerate(best)])
    c = g.select("lab_id", "y", F.inline(rows)).groupBy("lab_id", "mode", "scale", "mask", "y", "pred").agg(F.count("*").alias("n"))
    keys = ["lab_id", "mode", "scale", "mask"]
    ends = F.array(F.struct(F.col("y").cast("int").alias("cls"), F.col("n").alias("s"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("pred").cast("int").alias("cls"), F.col("n").alias("s"), F.lit(0).cast("long").alias("tp")))
    f = c.select(*keys, F.inline(ends)).where(F.col("cls") != background).groupBy(*keys, "cls").agg((2.0 * F.sum("tp") / F.sum("s")).alias("f1"))
    return f.groupBy(*keys).agg(F.avg("f1").alias("score"))


def best_setting(grid: DataFrame) -> DataFrame:
    """The best setting of each lab; ties to the first mode by name, the smaller scale, the mask."""
    w = Window.partitionBy("lab_id").orderBy(F.desc(F.round("score", 9)), "mode", "scale", F.desc("mask"))
    return grid.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def weighted_ensemble(members: DataFrame, weights: DataFrame) -> DataFrame:
    """window_id, cls, p: mean of the members' probabilities by their weights. members: window_id, member, cls, p; weights:
    member, w (a row per member)."""
    d = members.join(bounded_broadcast(weights), "member")
    return d.groupBy("window_id", "cls").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))


def blend_sweep(pairs: DataFrame, shares: tuple[float, ...], y: str = "y") -> DataFrame:
    """share, accuracy of share * p + (1 - share) * q for rows with arrays p and q, all shares in one pass; of equal
    probabilities the first class counts."""

    def right(s: float):
        mix = F.zip_with("p", "q", lambda a, b: F.round(a * s + b * (1 - s), 9))
        return F.avg((F.array_position(mix, F.array_max(mix)) - 1 == F.col(y)).cast("int"))

    one = pairs.agg(*[right(s).alias(f"_{i}") for i, s in enumerate(shares)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"_{i}").alias("accuracy")) for i, s in enumerate(shares)])))


def detector_grid(steps: DataFrame, ks: tuple[float, ...], keys: list[str]) -> DataFrame:
    """k, caught, false: share of the frames known to be bad whose step exceeds q3 + k IQR of its mouse, and of the others.
    steps: keys, step, bad. All k in one pass over the rows."""
    q = steps.groupBy(*keys).agg(F.percentile("step", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    d = steps.join(q, keys).withColumn("_over", (F.col("step") - F.get("_q", F.lit(1))) / (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))))
    share = lambda k, on: F.avg(F.when(on, F.coalesce(F.col("_over") > k, F.lit(False)).cast("int")))
    one = d.agg(*[x for i, k in enumerate(ks) for x in (share(k, F.col("bad")).alias(f"c{i}"), share(k, ~F.col("bad")).alias(f"f{i}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"c{i}").alias("caught"), F.col(f"f{i}").alias("false")) for i, k in enumerate(ks)])))


def calibrated_detector(grid: DataFrame, most_false: float) -> DataFrame:
    """The setting that catches most with at most most_false false alarms; of equal ones the largest k."""
    return grid.where(F.col("false") <= most_false).orderBy(F.desc(F.round("caught", 9)), F.desc("k")).limit(1)
