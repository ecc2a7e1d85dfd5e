"""Active learning: batches by rank fusion, spread and chance, an oracle with a budget, and cycles that fit anew."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import written
from . import models as M
from .stats import ranks_by_range


def unlabelled(pool: DataFrame, labelled: DataFrame, identity: str = "window_id") -> DataFrame:
    return pool.join(labelled.select(identity), identity, "left_anti")


def random_batch(pool: DataFrame, labelled: DataFrame, n: int, seed: int = 0, identity: str = "window_id") -> DataFrame:
    """n rows by the hash of seed and id."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(identity).cast("string")))
    return unlabelled(pool, labelled, identity).orderBy(key, identity).limit(n).select(identity)


def combined_batch(pool: DataFrame, labelled: DataFrame, counts: DataFrame, n: int, near: Column, identity: str = "window_id") -> DataFrame:
    """n rows by weighted average ranks, over the number of rows: half for -entropy, 0.3 for minus the inverse frequency of
    the predicted class (over the mean of the classes), 0.2 for minus `near` (0 or 1); the largest sums first, ties to the
    smaller id. counts: cls, n of the labels known (one row a class)."""
    inverse = counts.select("cls", (1 / F.greatest(F.col("n"), F.lit(1))).alias("_i"))
    mean = inverse.agg(F.avg("_i").alias("_mean"))
    rarity = inverse.crossJoin(F.broadcast(mean)).select("cls", F.round(F.col("_i") / F.col("_mean"), 6).alias("_rare"))  # one row
    d = unlabelled(pool, labelled, identity).withColumn("cls", F.array_position("p", F.array_max("p")).cast("int") - 1)
    d = d.join(F.broadcast(rarity), "cls", "left").select(identity, (-F.round(G.entropy(F.col("p")), 6)).alias("a"), (-F.coalesce("_rare", F.lit(1.0))).alias("b"), (-F.coalesce(near.cast("double"), F.lit(0.0))).alias("c"))
    d = written(d, "ranked")
    for x in "abc":
        k = ranks_by_range(d, x, 0.001, f"rank_{x}").withColumnRenamed(x, "_k")
        d = d.join(k, d[x].eqNullSafe(k["_k"])).drop("_k")
    every = d.agg(F.count("*").alias("_all"))
    score = (0.5 * F.col("rank_a") + 0.3 * F.col("rank_b") + 0.2 * F.col("rank_c")) / F.col("_all")
    return d.crossJoin(F.broadcast(every)).select(identity, F.round(score, 9).alias("score")).orderBy(F.desc("score"), identity).limit(n)  # one row


def hybrid_batch(pool: DataFrame, labelled: DataFrame, n: int, vector: str, share: float = 0.5, identity: str = "window_id") -> DataFrame:
    """A share of the batch by entropy; the rest spread out among the 10 n rows of most entropy, from the first on."""
    by = M.query_batch(pool, labelled, 10 * n, "entropy", identity)
    top = by.orderBy(F.desc("score"), identity).limit(int(n * share)).select(identity)
    near = written(pool.join(by, identity), "uncertain")
    first = near.orderBy(F.desc("score"), identity).first()
    spread = M.k_center(near, n, vector, identity, first[identity])
    rest = spread.join(top, identity, "left_anti").orderBy("step").limit(n - int(n * share)).select(identity)
    return top.unionByName(rest)


def scheduled_batch(pool: DataFrame, members: DataFrame, labelled: DataFrame, n: int, step: int, switch: int = 3, identity: str = "window_id") -> DataFrame:
    """id, score of the n rows that round `step` (from 0) asks for: before round `switch` those on which the members of an
    ensemble disagree most (bald), from then on those of least margin; ties to the smaller id. members: id, p."""
    if step >= switch:
        return M.query_batch(pool, labelled, n, "margin", identity)
    d = unlabelled(M.bald(members, identity), labelled, identity).withColumn("score", F.round("bald", 6))
    return d.orderBy(F.desc("score"), identity).limit(n).select(identity, "score")


def gradient_batch(pool: DataFrame, labelled: DataFrame, n: int, vector: str, seed: int = 0, identity: str = "window_id", near: int = 256) -> DataFrame:
    """n rows by k-means++ on loss gradients: a row's gradient towards its predicted class is (p - one-hot) times its
    vector, so a squared distance needs both factors alone. A draw weighted by the squared distance is the largest
    ln(distance) + Gumbel number from a hash; the first row has the longest gradient. A pass brings the `near` best rows of
    each of the next 16 draws to the driver; distances only fall, so a draw is decided there while its best row stands
    above the first one left behind."""
    top = F.array_position("p", F.array_max("p")).cast("int") - 1
    left = F.transform("p", lambda v, i: v - (i == top).cast("double"))
    d = written(unlabelled(pool, labelled, identity).select(identity, left.alias("g"), F.transform(vector, lambda v: v.cast("double")).alias("h")), "gradients")

    def dot(a, b) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    own = dot("g", "g") * dot("h", "h")
    first = d.orderBy(F.desc(own), identity).first()
    chosen, new, d = [first[identity]], [first], d.withColumn("_d", F.lit(float("inf")))
    key = lambda step: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), step, F.col(identity).cast("string"))), 1, 12), 16, 10).cast("double")
    while len(chosen) < n:
        marks = F.array(*[F.struct(*[F.array(*[F.lit(float(x)) for x in c[k]]).alias(k) for k in "gh"]) for c in new])
        gone = F.array(*[F.lit(c[identity]) for c in new])  # earlier ones are out of d already
        away = lambda c: F.greatest(own + dot(c["g"], c["g"]) * dot(c["h"], c["h"]) - 2 * dot("g", c["g"]) * dot("h", c["h"]), F.lit(0.0))
        d = written(d.where(~F.array_contains(gone, F.col(identity))).withColumn("_d", F.least("_d", F.array_min(F.transform(marks, away)))), "gradients")
        steps = range(len(chosen), min(n, len(chosen) + 16))
        draws = d.withColumn("_s", F.explode(F.array(*map(F.lit, steps)))).withColumn("_u", (key(F.col("_s").cast("string")) + 0.5) / 2.0**48)
        draws = draws.withColumn("_v", F.ln("_d") - F.ln(-F.ln("_u")))
        top = draws.withColumn("_rn", F.row_number().over(Window.partitionBy("_s").orderBy(F.desc("_v"), identity))).where(F.col("_rn") <= near + 1).collect()
        new = []
        for step in steps:
            mine = sorted((r for r in top if r["_s"] == step), key=lambda r: r["_rn"])
            rest, mine = (mine[near]["_v"] if len(mine) > near else -np.inf), [r for r in mine[:near] if r[identity] not in chosen]
            best = max(((_drawn(r, new), -r[identity], r) for r in mine), default=None, key=lambda x: x[:2])
            if best is None or best[0] <= rest and rest > -np.inf:
                break
            chosen.append(best[2][identity])
            new.append(best[2])
        if not new:
            break  # fewer rows than n
    return pool.sparkSession.createDataFrame(list(enumerate(chosen)), f"step int, {identity} long")


def _drawn(r, new: list) -> float:
    """The row's number in a draw once the rows in new are chosen as well."""
    g, h, d = np.array(r["g"]), np.array(r["h"]), r["_d"]
    for c in new:
        a, b = np.array(c["g"]), np.array(c["h"])
        d = min(d, max((g @ g) * (h @ h) + (a @ a) * (b @ b) - 2 * (g @ a) * (h @ b), 0.0))
    return np.log(d) - np.log(-np.log(r["_u"])) if d > 0 else -np.inf


def revealed(truth: DataFrame, asked: DataFrame, known: DataFrame, budget: int, identity: str = "window_id") -> DataFrame:
    """What an oracle answers: the labels of rows asked that are not known yet, the smaller ids first, within a budget."""
    new = asked.select(identity).distinct().join(known.select(identity), identity, "left_anti")
    return truth.join(new, identity, "left_semi").orderBy(identity).limit(budget)


def cycle(pool: DataFrame, columns: list[str], y: str, held: Column, seed_rows: int, batch: int, rounds: int, kind: str, model, identity: str, background: float | None = None, patience: int = 3) -> DataFrame:
    """step, labels, accuracy, wasted: a model is fitted on the labels known, scored on the held rows, and asks for the
    `batch` rows of the others that it is least sure of (random: by hash). wasted: asked rows of the background. It stops
    when accuracy has not risen for `patience` rounds. `rounds` jobs at most; the driver gets counts alone."""
    pool = written(pool.select(identity, y, held.alias("_held"), *columns), "pool")
    free, test = pool.where("NOT _held"), pool.where("_held")
    known = written(M.seed_set(free, seed_rows, y, identity).select(identity), "known")
    out, best, since, wasted = [], -1.0, 0, 0
    for step in range(rounds):
        train = free.join(known, identity, "left_semi").withColumnRenamed(y, "y")
        fitted = model.fit(M.weighted(M.assembled(train, columns)))
        right = fitted.transform(M.assembled(test, columns, train=train)).agg(F.avg((F.col("prediction") == F.col(y)).cast("int"))).first()[0]
        out.append((step, known.count(), float(right or 0.0), wasted))
        since = 0 if (right or 0.0) > best else since + 1
        best = max(best, right or 0.0)
        if since >= patience or step == rounds - 1:
            break
        if kind == "random":
            asked = random_batch(free, known, batch, step, identity)
        else:
            p = fitted.transform(M.assembled(free, columns, train=train)).select(identity, M.vector_to_array("probability").alias("p"))
            asked = M.query_batch(p, known, batch, kind, identity).select(identity)
        asked = written(asked, "asked")
        wasted = 0 if background is None else free.join(asked, identity, "left_semi").where(F.col(y) == background).count()
        known = written(known.unionByName(asked), "known")
    return pool.sparkSession.createDataFrame(out, "step int, labels long, accuracy double, wasted long")
