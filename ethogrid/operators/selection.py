"""Feature selection: binned mutual information, drift, clusters of collinear features, and stepwise variance inflation.

Spark reduces the rows to correlations and counts; what is left is a matrix of features by features on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson correlations of all pairs, in one pass; undefined ones are 0."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    m = np.eye(len(columns))
    for (i, j), r in zip(pairs, df.agg(*[F.corr(columns[i], columns[j]) for i, j in pairs]).first() if pairs else []):
        m[i, j] = m[j, i] = 0.0 if r is None or np.isnan(r) else r
    return m


def inflation(r: np.ndarray) -> np.ndarray:
    """Variance inflation of each feature from their correlations, at most 1e9."""
    if len(r) < 2:
        return np.ones(len(r))
    return np.clip(np.diag(np.linalg.inv(r + 1e-10 * np.eye(len(r)))), 1, 1e9)


def mutual_information(df: DataFrame, columns: list[str], y: str, bins: int = 16) -> DataFrame:
    """column, mi: information in nats of y and each column cut in `bins` even parts of its range (missing ones are a part
    of their own)."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))])
    cut = lambda c: F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - F.col(f"a_{c}"), F.col(f"b_{c}") - F.col(f"a_{c}")) * bins), F.lit(bins - 1)), F.lit(-1))
    long = df.crossJoin(F.broadcast(ends)).select(F.col(y).alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), cut(c).alias("bin")) for c in columns])))  # one row
    n = long.groupBy("column", "bin", "y").agg(F.count("*").alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy("column", *k))
    n = n.withColumns({"all": by(), "nb": by("bin"), "ny": by("y")})
    return n.groupBy("column").agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("nb") * F.col("ny")))).alias("mi"))


def drift_scores(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """column, drift: variance between groups (k - 1 degrees) over that within (n - k)."""
    long = df.select(F.col(group).alias("g"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("x")) for c in columns])))
    g = long.groupBy("column", "g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    grand = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("column")) / F.sum("n").over(Window.partitionBy("column"))
    g = g.withColumn("grand", grand)
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2))) / (F.count("*") - 1)
    within = F.sum(F.col("n") * F.col("v")) / F.greatest(F.sum("n") - F.count("*"), F.lit(1))
    return g.groupBy("column").agg((between / F.greatest(within, F.lit(1e-12))).alias("drift"))


def collinear_pairs(df: DataFrame, columns: list[str], above: float) -> DataFrame:
    r = correlations(df, columns)
    rows = [(columns[i], columns[j], float(r[i, j])) for i in range(len(columns)) for j in range(i + 1, len(columns)) if abs(r[i, j]) > above]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def choose(columns: list[str], r: np.ndarray, mi: dict[str, float], drift: dict[str, float], most_r: float = 0.95, most_vif: float = 10.0) -> dict[str, str]:
    """Why each feature goes ("" if it stays): of each cluster joined by correlations above most_r only the feature with
    the most information stays; then the one with the largest inflation goes while that exceeds most_vif; then those in
    the upper quarter of drift and the lower quarter of information."""
    why = dict.fromkeys(columns, "")
    near = abs(r) > most_r
    left = set(range(len(columns)))
    while left:
        cluster, new = set(), {min(left)}
        while new:
            cluster |= new
            new = {j for i in new for j in np.flatnonzero(near[i])} - cluster
        left -= cluster
        best = max(sorted(cluster), key=lambda i: mi[columns[i]])
        for i in cluster - {best}:
            why[columns[i]] = f"collinear with {columns[best]}"
    while len(kept := [i for i, c in enumerate(columns) if not why[c]]) > 1:
        v = inflation(r[np.ix_(kept, kept)])
        if v.max() <= most_vif:
            break
        why[columns[kept[int(v.argmax())]]] = "inflated"
    high, low = np.quantile(list(drift.values()), 0.75), np.quantile(list(mi.values()), 0.25)
    for c in columns:
        if not why[c] and drift[c] >= high and mi[c] <= low:
            why[c] = "unstable"
    return why


def select_features(df: DataFrame, columns: list[str], y: str, group: str, most_r: float = 0.95, most_vif: float = 10.0) -> DataFrame:
    """feature, mi, drift, vif, max_abs_corr, kept, reason: one row per feature."""
    filled = df.select(y, group, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    r = correlations(filled, columns)
    mi = {x["column"]: x["mi"] for x in mutual_information(filled, columns, y).collect()}  # one row per feature
    drift = {x["column"]: x["drift"] for x in drift_scores(filled, columns, group).collect()}
    why, vif, off = choose(columns, r, mi, drift, most_r, most_vif), inflation(r), abs(r - np.eye(len(r))).max(axis=1)
    rows = [(c, float(mi[c]), float(drift[c]), float(vif[i]), float(off[i]), not why[c], why[c]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature string, mi double, drift double, vif double, max_abs_corr double, kept boolean, reason string")
