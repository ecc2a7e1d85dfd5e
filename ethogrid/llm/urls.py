"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for what no rule fits.

The trees are trained from labelled URLs, here those that the rules decide: on at most `sample` of them (the smallest
hashes), both verdicts weighing alike. Features are Spark columns: lengths, depth, digit ratio, entropy, counts of
parameters and signs, and the suffix's statistics over all rows. A suffix's share of blocked labels, as a labelled row
sees it, leaves out the labels of the row's own fold, so no row sees its own label. `learn` also fits without one fold
and returns what that model scores there. Training is a small numpy job on the driver; URLs that no rule fits are scored
in tasks.

Defined results. Null url or no "://": empty host and path, judged by the model on its other features. Null and repeated
ids: one result row each. If all labelled URLs have one verdict, that is the verdict of the rest; without any, allow.
Very long URLs are judged whole. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, spread, stored

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url) -> tuple:
    """host and path columns."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, rest, 1), UPPER, LOWER), F.regexp_extract(u, rest, 2)


def fitting_rule(host, path, rules=RULES):
    """The longest rule (host and path together) that fits: struct(rule, verdict), or null."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


FOLDS = 5
FEATURES = "length host_length path_length depth digits entropy parameters assigned labels longest_label hyphens host_digits fragment signs suffix_n suffix_rate".split()


def lexical(url, host, path) -> dict:
    """The lexical features, as columns."""
    u = F.coalesce(url, F.lit(""))
    size = F.length(u)

    def count(of, signs: str):
        return F.length(of) - F.length(F.translate(of, signs, ""))

    letters = F.filter(F.array_distinct(F.split(u, "")), lambda c: c != "")
    share = F.transform(letters, lambda c: (size - F.length(F.replace(u, c))) / size)
    query = F.regexp_extract(u, r"(?s)^[^?]*\?([^#]*)", 1)
    return {
        "length": size,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count(path, "/"),
        "digits": count(u, "0123456789") / F.greatest(size, F.lit(1)),
        "entropy": F.aggregate(share, F.lit(0.0), lambda t, p: t - p * F.log2(p)),
        "parameters": count(query, "&") + (query != "").cast("int"),
        "assigned": count(query, "="),
        "labels": count(host, ".") + 1,
        "longest_label": F.array_max(F.transform(F.split(host, "[.]"), F.length)),
        "hyphens": count(host, "-"),
        "host_digits": count(host, "0123456789"),
        "fragment": u.contains("#").cast("int"),
        "signs": count(u, "%_"),
    }


class Trees:
    """Boosted regression trees on the logistic loss, grown level by level on binned features."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees, self.edges = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        weight = np.ones(len(y)) if weight is None else weight
        share = np.average(y, weights=weight) if len(y) else 0.0
        self.base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        if not 0 < share < 1:
            return self
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = weight * (p - y), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            levels = []
            for level in range(self.depth):
                width = 1 << level
                best = np.full(width, 0.0)
                split = [(-1, 0)] * width
                for f in range(x.shape[1]):
                    size = len(self.edges[f]) + 1
                    key = node * size + code[:, f]
                    g = np.bincount(key, grad, width * size).reshape(width, size).cumsum(1)
                    h = np.bincount(key, hess, width * size).reshape(width, size).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.least) + (gt - g) ** 2 / (ht - h + self.least) - gt**2 / (ht + self.least)
                    at = gain.argmax(axis=1)
                    for k in np.flatnonzero(gain[np.arange(width), at] > best + 1e-9):
                        best[k], split[k] = gain[k, at[k]], (f, int(at[k]))
                levels.append(split)
                f, b = np.array(split).T
                node = node * 2 + ((f[node] >= 0) & (code[np.arange(len(y)), np.maximum(f[node], 0)] > b[node]))
            width = 1 << self.depth
            leaf = -self.rate * np.bincount(node, grad, width) / (np.bincount(node, hess, width) + self.least)
            self.trees.append((levels, leaf))
            score += leaf[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        if self.trees:
            code = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)
        for levels, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for split in levels:
                f, b = np.array(split).T
                node = node * 2 + ((f[node] >= 0) & (code[np.arange(len(x)), np.maximum(f[node], 0)] > b[node]))
            score += leaf[node]
        return 1 / (1 + np.exp(-score))


def prepared(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, hit (rule, verdict) and the features; suffix_rate of labelled rows is out of their fold."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    fold = F.pmod(F.xxhash64("url", "id"), F.lit(FOLDS)).cast("int")
    rows = rows.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("hit"), fold.alias("fold"), F.regexp_extract("host", r"([^.:@]*)(?::\d*)?$", 1).alias("suffix"))
    count = {v: F.array(*[F.count_if((F.col("hit.verdict") == v) & (F.col("fold") == k)) for k in range(FOLDS)]).alias(v) for v in ("block", "allow")}
    stats = rows.groupBy("suffix").agg(F.count("*").alias("n"), count["block"], count["allow"])
    rows = rows.join(bounded_broadcast(stored(stats, "suffixes"), 100_000), "suffix")

    def seen(v: str):
        every = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
        return every - F.when(F.col("hit").isNotNull(), F.get(v, F.col("fold"))).otherwise(0)

    named = lexical(F.col("url"), F.col("host"), F.col("path")) | {"suffix_n": F.log1p("n"), "suffix_rate": (seen("block") + 1) / (seen("block") + seen("allow") + 2)}
    return rows.select("id", "url", "host", "path", "hit", "fold", *[named[c].cast("double").alias(c) for c in FEATURES])


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights by which both labels weigh alike."""
    return np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (len(y) - y.sum()), 1))


def learn(rows: DataFrame, sample: int = 20_000) -> tuple[Trees, dict]:
    """Trees from the labelled rows of prepared(), and the figures of trees fitted without fold 0 on that fold: n,
    balanced accuracy and the chance that a blocked URL scores above an allowed one (auc); none if it lacks a label."""
    labelled = rows.where(F.col("hit").isNotNull()).withColumn("y", (F.col("hit.verdict") == "block").cast("int"))
    # a share by hash first, so that about `sample` rows reach the driver from however many partitions
    share = min(1.0, 1.5 * sample / max(labelled.count(), 1))
    drawn = labelled.where(F.pmod(F.xxhash64("id", "url"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    train = drawn.orderBy(F.xxhash64("url", "id"), "url").limit(sample).select("fold", "y", *FEATURES).toPandas()
    x, y, out = train[FEATURES].to_numpy(float), train["y"].to_numpy(float), train["fold"].to_numpy() == 0
    figures = {}
    if 0 < y[out].sum() < out.sum():
        p, t = Trees().fit(x[~out], y[~out], balanced(y[~out])).predict(x[out]), y[out] == 1
        rank = pd.Series(p).rank().to_numpy()
        auc = (rank[t].sum() - t.sum() * (t.sum() + 1) / 2) / (t.sum() * (~t).sum())
        figures = {"n": int(out.sum()), "balanced_accuracy": float(((p >= 0.5)[t].mean() + (p < 0.5)[~t].mean()) / 2), "auc": float(auc)}
    return Trees().fit(x, y, balanced(y)), figures


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", sample: int = 20_000) -> DataFrame:
    """id, host, path, rule, score (of blocking; null where a rule decides), verdict."""
    rows = prepared(pages, rules, id_col, url_col)
    model, _ = learn(rows, sample)

    def score(batches):
        for pdf in batches:
            yield pdf[["id", "host", "path"]].assign(rule=None, score=model.predict(pdf[FEATURES].to_numpy(float)))

    ruled = rows.where(F.col("hit").isNotNull()).select("id", "host", "path", F.col("hit.rule").alias("rule"), F.lit(None).cast("double").alias("score"), F.col("hit.verdict").alias("verdict"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.where(F.col("hit").isNull()).select("id", "host", "path", *FEATURES).mapInPandas(score, f"id {kind}, host string, path string, rule string, score double")
    return ruled.unionByName(scored.withColumn("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    r = filter_urls(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")))
    return r.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
