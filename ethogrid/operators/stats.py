"""Two-sample and paired statistics, motion metrics, and active-learning scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, written


def ks_statistic(df: DataFrame, x: str, side: str, *by: str) -> DataFrame:
    """Largest gap between the two empirical distributions of x; side: boolean. Ties are counted once, after them."""
    n = df.groupBy(*by, x).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    w, every = Window.partitionBy(*by).orderBy(x), Window.partitionBy(*by)
    gap = F.abs(F.sum("a").over(w) / F.sum("a").over(every) - F.sum("b").over(w) / F.sum("b").over(every))
    return n.withColumn("gap", gap).groupBy(*by).agg(F.max("gap").alias("ks"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def ks_p(ks: Column, n_a: Column, n_b: Column, terms: int = 20) -> Column:
    """The chance of a larger gap under one distribution, by Kolmogorov's series."""
    x = ks * F.sqrt(n_a * n_b / (n_a + n_b))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total)))


def bootstrap_delta(pairs: DataFrame, a: str, b: str, identity: str, rounds: int = 100, seed: int = 0) -> DataFrame:
    """Mean of a - b with its 2.5 and 97.5 percentiles; both sides of a pair are drawn together."""
    return bootstrap_mean(pairs.withColumn("_delta", F.col(a) - F.col(b)), "_delta", identity, rounds, seed)


def subsampled(df: DataFrame, x: str, identity: str, share: float = 0.32, rounds: int = 100, seed: int = 0) -> DataFrame:
    """Mean of x and the 2.5 and 97.5 percentiles of its means over subsamples without replacement, by hashes."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(identity).cast("string"), F.col("_b").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    d = df.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).where(u < share)
    m = d.groupBy("_b").agg(F.avg(x).alias("m"))
    return m.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def exact_percentiles(df: DataFrame, columns: list[str], qs: tuple[float, ...], *by: str) -> DataFrame:
    """by, column, n, and array v of the exact percentiles (linear between ranks) of each column's values.

    For few groups of very many rows: no task holds a group. Values are counted by narrow ranges (an eighth of a power of
    two and less, so some thousand a group), the ranges that hold the wanted ranks are found from those counts, and only
    their values are sorted. df is read twice; pass a written table if it is dear."""
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))).where("x IS NOT NULL")
    size = F.log2(F.abs("x") + 2.0**-40) + 41
    long = long.withColumn("range", F.when(F.col("x") == 0, 0).otherwise(F.signum("x") * (1 + F.floor(size * 128))).cast("int"))
    keys = [*by, "column"]
    n = long.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    w, every = Window.partitionBy(*keys).orderBy("range"), Window.partitionBy(*keys)
    n = n.select(*keys, "range", "n", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(every).alias("all"))
    q = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p"), F.lit(s).alias("side")) for i, p in enumerate(qs) for s in (0, 1)]))
    rank = F.floor(F.col("p") * (F.col("all") - 1)) + F.when((F.col("side") == 1) & (F.col("p") * (F.col("all") - 1) > F.floor(F.col("p") * (F.col("all") - 1))), 1).otherwise(0)
    asked = n.withColumn("q", q).select(*keys, "range", "before", "all", "n", "q.*").withColumn("rank", rank).where("rank >= before AND rank < before + n")
    asked = written(asked.drop("n"), "ranks")  # two rows at most for each group, column and percentile
    some = bounded_broadcast(asked.select(*keys, "range").distinct())
    values = long.join(some, [*keys, "range"]).groupBy(*keys, "range", "x").agg(F.count("*").alias("m"))
    up_to = F.sum("m").over(Window.partitionBy(*keys, "range").orderBy("x"))
    values = values.withColumn("to", up_to)
    got = asked.join(values, [*keys, "range"]).where("rank >= before + to - m AND rank < before + to")
    part = F.col("p") * (F.col("all") - 1) - F.floor(F.col("p") * (F.col("all") - 1))
    one = got.groupBy(*keys, "all", "q").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("b"), F.first(part).alias("part"))
    return one.groupBy(*keys, F.col("all").alias("n")).agg(F.transform(F.sort_array(F.collect_list(F.struct("q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("v")))), lambda s: s["v"]).alias("v"))


def average_rank(x: str, w_by: list[str]) -> Column:
    """Rank of x among w_by, ties sharing the mean of their ranks."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*w_by, x))
    return F.rank().over(Window.partitionBy(*w_by).orderBy(x)) + (ties - 1) / 2


def ranks_by_range(df: DataFrame, x: str, step: float, rank: str) -> DataFrame:
    """x, rank: each distinct value of x and its average rank among all rows, as average_rank has it. Values are counted
    and dealt by ranges of width step, so no task sorts all rows. x must be bounded and rounded, so that ranges, and
    the values of one, are few."""
    n = df.groupBy(x).agg(F.count("*").alias("_n")).withColumn("_r", F.floor(F.col(x) / step))
    sizes = n.groupBy("_r").agg(F.sum("_n").alias("_all"))
    before = sizes.select(F.col("_r").alias("_s"), F.coalesce(F.sum("_all").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    before = bounded_broadcast(written(before, "ranges"))  # a row a range
    up_to = F.sum("_n").over(Window.partitionBy("_r").orderBy(x))
    dealt = n.join(before, n["_r"].eqNullSafe(before["_s"]))
    return dealt.select(x, (F.col("_before") + up_to - F.col("_n") + 1 + (F.col("_n") - 1) / 2).alias(rank))


def wilcoxon(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Signed-rank sums of a - b (zeros dropped), their smaller one, the normal z with tie correction, and the
    rank-biserial effect."""
    d = pairs.withColumn("_d", F.col(a) - F.col(b)).where("_d <> 0").withColumn("_abs", F.abs("_d"))
    d = d.withColumn("_r", average_rank("_abs", list(by)))
    ties = d.groupBy(*by, "_abs").agg(F.count("*").alias("t"), F.sum(F.when(F.col("_d") > 0, F.col("_r"))).alias("p"), F.sum(F.when(F.col("_d") < 0, F.col("_r"))).alias("m"))
    g = ties.groupBy(*by).agg(F.sum("t").alias("n"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("w_minus"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie"))
    n, w = F.col("n"), F.least("w_plus", "w_minus")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    return g.select(*by, "n", "w_plus", "w_minus", w.alias("w"), F.try_divide(w - n * (n + 1) / 4, sd).alias("z"), (1 - F.try_divide(2 * w, (n * (n + 1)).cast("double"))).alias("effect"))


def cohens_d(df: DataFrame, x: str, side: str, *by: str) -> DataFrame:
    """Difference of means over the pooled deviation, with a word for its size."""
    one = lambda c, on: [F.avg(F.when(on, F.col(x))).alias(f"m{c}"), F.var_pop(F.when(on, F.col(x))).alias(f"v{c}"), F.count(F.when(on, F.col(x))).alias(f"n{c}")]
    g = df.groupBy(*by).agg(*one("a", F.col(side)), *one("b", ~F.col(side)))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    g = g.withColumn("d", F.try_divide(F.col("ma") - F.col("mb"), pooled))
    size = F.abs("d")
    return g.select(*by, "d", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large").alias("size"))


def kl_divergence(df: DataFrame, x: str, side: str, low: float, high: float, bins: int = 50, eps: float = 1e-10) -> DataFrame:
    """KL(a || b) of histograms with `bins` bins on [low, high]."""
    b = F.least(F.floor((F.col(x) - low) / (high - low) * bins), F.lit(bins - 1))
    n = df.where(F.col(x).between(low, high)).groupBy(b.alias("bin")).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    t = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("a") / F.col("ta") + eps, F.col("b") / F.col("tb") + eps
    return n.crossJoin(F.broadcast(t)).agg(F.sum(p * F.ln(p / q)).alias("kl"))  # one row


def bootstrap_mean(df: DataFrame, x: str, identity: str, rounds: int = 100, seed: int = 0, *by: str) -> DataFrame:
    """Mean, and the 2.5 and 97.5 percentiles of Poisson bootstrap means; weights come from hashes, in one pass."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(identity).cast("string"), F.col("_b").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))  # the draws of 7 and more, one in 12,000, count as 6
    d = df.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_w", weight)
    m = d.groupBy(*by, "_b").agg(F.try_divide(F.sum(F.col(x) * F.col("_w")), F.sum("_w")).alias("m"))
    ci = m.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    mean = df.groupBy(*by).agg(F.avg(x).alias("mean"))
    return mean.join(ci, list(by)) if by else mean.crossJoin(ci)  # one row each


def aulc(curve: DataFrame, n: str, score: str, *by: str, span: bool = True) -> DataFrame:
    """Area under the learning curve over the span of n (or its maximum)."""
    w = Window.partitionBy(*by).orderBy(n)
    part = (F.col(n) - F.lag(n).over(w)) * (F.col(score) + F.lag(score).over(w)) / 2
    width = (F.max(n) - F.min(n)) if span else F.max(n)
    return curve.withColumn("_p", part).groupBy(*by).agg(F.try_divide(F.sum("_p"), width).alias("aulc"))


def transitions(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Counts and shares of each label's next label."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = df.withColumn("next", F.lead(label).over(w)).where("next IS NOT NULL").groupBy(label, "next").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def min_max(x: str, *by: str) -> Column:
    """x scaled to [0, 1] within `by`; 0.5 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (F.col(x) - low) / (high - low)).otherwise(0.5)


def edge_weights(lengths: DataFrame, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Inverse-variance weights of edges over their median, clipped."""
    v = lengths.groupBy("edge").agg(F.var_samp("length").alias("v")).where("v > 0").withColumn("inv", 1 / F.col("v"))
    med = v.agg(F.percentile("inv", F.lit(0.5)).alias("m"))
    return v.crossJoin(F.broadcast(med)).select("edge", F.least(F.lit(high), F.greatest(F.lit(low), F.col("inv") / F.col("m"))).alias("weight"))  # one row


def on_grid(points: DataFrame, x: str, y: str, grid: list[float], *by: str) -> DataFrame:
    """y at each grid value, linear between its neighbours, the nearest one beyond the ends."""
    w = Window.partitionBy(*by).orderBy(x)
    seg = points.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), (F.row_number().over(w) == 1).alias("first"))
    at = seg.withColumn("g", F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    inside = (F.col("g") >= F.col("x0")) & (F.col("x1").isNull() | (F.col("g") < F.col("x1")))
    at = at.where(inside | (F.col("first") & (F.col("g") < F.col("x0"))))
    value = F.when((F.col("g") <= F.col("x0")) | F.col("x1").isNull(), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("g") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return at.select(*by, "g", value.alias("y"))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation of each column: the diagonal of the inverse correlation matrix, which one pass gives."""
    import numpy as np

    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    r = df.agg(*[F.corr(columns[i], columns[j]) for i, j in pairs]).first()
    m = np.eye(len(columns))
    for (i, j), v in zip(pairs, r):
        m[i, j] = m[j, i] = 0.0 if v is None else v
    d = np.diag(np.linalg.pinv(m, hermitian=True)) if np.linalg.cond(m) < 1e12 else np.diag(np.linalg.inv(m + 1e-9 * np.eye(len(m))))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, d)], "column_name string, vif double")
