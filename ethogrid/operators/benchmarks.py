"""Benchmarks of repairs and trackings: every corruption against every repair, swaps, identity over time, turning angles,
smoothness, phases side by side, groups of vectors, and what a strategy asks for."""

from __future__ import annotations

from functools import reduce
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import written
from .frames import MOUSE, by_mouse, paired
from .motion import recovered, recovery
from .sequence import welch
from .stats import ks_statistic

Change = Callable[[DataFrame], DataFrame]


def recovery_grid(clean: DataFrame, corruptions: dict[str, Change], repairs: dict[str, Change], keypoints: list[str], number: str = "video_id", columns: list[str] | None = None, in_rows: bool = False) -> DataFrame:
    """corruption, repair, keypoint, before, after, recovered (see recovery) of every pair. All corruptions are one table,
    in which a video has a number for each of them, so a repair runs once over everything and no job is made per pair.
    Repairs work within videos; `number` is an integer. columns: the coordinates that repairs read, if not all. in_rows: repairs
    change values of the keypoints only, and no row's key, so that clean and corrupt places travel in the row and nothing is
    joined."""
    kinds = list(corruptions)
    keys, cols = [*MOUSE, "video_frame"], [f"{k}_{a}" for k in keypoints for a in "xy"]
    if in_rows:
        kept = [c for c in clean.columns if c in keys or columns is None or c in columns]
        known = clean.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).withColumns({f"_t_{c}": F.col(c) for c in cols})
        every = [corruptions[k](known).select(*kept, *[f"_t_{c}" for c in cols]) for k in kinds]
        every = [d.withColumn(number, F.col(number).cast("long") * len(kinds) + i) for i, d in enumerate(every)]
        spoiled = written(reduce(DataFrame.unionByName, every), "spoiled").withColumns({f"_c_{c}": F.col(c) for c in cols})
        name = F.get(F.array(*map(F.lit, kinds)), F.pmod(F.col(number), F.lit(len(kinds))).cast("int")).alias("corruption")
        each = lambda d: d.select(name, *[F.col(p + c).alias(to + c) for p, to in (("_t_", ""), ("_c_", "c_"), ("", "r_")) for c in cols])
        return reduce(DataFrame.unionByName, [recovered(each(fix(spoiled)), keypoints, "corruption").withColumn("repair", F.lit(n)) for n, fix in repairs.items()])
    as_kind = lambda df, k: df.withColumn(number, F.col(number).cast("long") * len(kinds) + k)
    spoiled = written(reduce(DataFrame.unionByName, [as_kind(corruptions[k](clean).select(clean.columns), i) for i, k in enumerate(kinds)]), "spoiled")
    truth = as_kind(clean.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(kinds) - 1)))), F.col("_k"))
    truth = truth.withColumn("corruption", F.get(F.array(*map(F.lit, kinds)), F.col("_k"))).drop("_k")
    rows = [recovery(truth, spoiled, fix(spoiled), keypoints, "corruption").withColumn("repair", F.lit(name)) for name, fix in repairs.items()]
    return reduce(DataFrame.unionByName, rows)


def swap_recovery(clean: DataFrame, corrupt: DataFrame, repaired: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Frames of mice that a corruption changed, those of them that a repair made whole again, and those that it spoiled,
    with precision (whole among touched) and recall (whole among changed)."""
    keys = [*MOUSE, "video_frame"]
    row = lambda df, n: df.select(*keys, F.struct(*columns).alias(n))
    j = clean.select(*keys, *[c for c in by if c not in keys], F.struct(*columns).alias("a")).join(row(corrupt, "b"), keys).join(row(repaired, "c"), keys)
    differ = lambda x, y: ~F.col(x).eqNullSafe(F.col(y))
    g = j.groupBy(*by).agg(F.count_if(differ("a", "b")).alias("changed"), F.count_if(differ("b", "c")).alias("touched"), F.count_if(differ("a", "b") & ~differ("a", "c")).alias("mended"), F.count_if(~differ("a", "b") & differ("a", "c")).alias("spoiled"))
    return g.withColumns({"precision": F.try_divide("mended", "touched"), "recall": F.try_divide("mended", "changed")})


def identity_metrics(wide: DataFrame, rate: float, head: str = "nose", tail: str = "tail_base") -> DataFrame:
    """Per pair of a video's mice (a < b): swaps, mean_s, persistence, fragments. The side on which one body axis lies of
    the other is a run as long as its sign stays (frames without a sign do not count); each run after the first of two
    frames or more is a swap; persistence is the share of frames outside of swaps."""
    pair = ["video_id", "a", "b"]
    axis = wide.select(*MOUSE, "video_frame", *[(F.col(f"{tail}_{c}") - F.col(f"{head}_{c}")).alias(f"d{c}") for c in "xy"])
    x = paired(axis, ["dx", "dy"])
    x = x.toDF(*pair, "video_frame", "ax", "ay", "bx", "by").withColumn("side", F.signum(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx")))
    signed = F.col("side").isNotNull() & (F.col("side") != 0)
    w = Window.partitionBy(*pair).orderBy("video_frame")
    runs = x.where(signed).withColumn("_new", F.coalesce((F.col("side") != F.lag("side").over(w)).cast("int"), F.lit(0)))
    runs = runs.withColumn("run", F.sum("_new").over(w)).groupBy(*pair, "run").agg(F.count("*").alias("n"))
    swap = (F.col("run") > 0) & (F.col("n") >= 2)
    g = runs.groupBy(*pair).agg(F.sum("n").alias("valid"), F.count_if(swap).alias("swaps"), F.sum(F.when(swap, F.col("n")).otherwise(0)).alias("_in"), F.count("*").alias("fragments"))
    g = x.select(*pair).distinct().join(g, pair, "left")
    few = F.coalesce(F.col("valid") < 2, F.lit(True))
    none = lambda c, v: F.when(few, v).otherwise(c)
    return g.select(*pair, none(F.col("swaps"), 0).alias("swaps"), none(F.coalesce(F.try_divide("_in", "swaps") / rate, F.lit(0.0)), 0.0).alias("mean_s"), none(1 - F.col("_in") / F.col("valid"), 1.0).alias("persistence"), none(F.col("fragments"), 0).alias("fragments"))


def turning_angles(wide: DataFrame, keypoint: str, least: float = 0.5) -> DataFrame:
    """angle: by how much a keypoint's steps turn, in [0, pi], where a step and the one before are longer than `least`."""
    w = by_mouse()
    p = wide.select(*MOUSE, "video_frame", *[(F.col(f"{keypoint}_{a}") - F.lag(f"{keypoint}_{a}").over(w)).alias(f"_d{a}") for a in "xy"])
    p = p.withColumns({"_n": F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")), "_a": F.atan2("_dy", "_dx")})
    turn = F.abs(G.wrap(F.col("_a") - F.lag("_a").over(w)))
    p = p.withColumn("angle", F.when((F.col("_n") > least) & (F.lag("_n").over(w) > least), turn))
    return p.select(*MOUSE, "video_frame", "angle").where("angle IS NOT NULL")


def turning_shift(before: DataFrame, after: DataFrame, keypoint: str, *by: str, least: float = 0.5, digits: int = 6) -> DataFrame:
    """Mean turning angles of two trackings, and the largest gap between their distributions (angles rounded, so that
    their counts are few)."""
    a, b = (turning_angles(df, keypoint, least).select(*by, F.round("angle", digits).alias("angle"), F.lit(side).alias("side")) for df, side in ((before, True), (after, False)))
    both = a.unionByName(b)
    mean = both.groupBy(*by).agg(F.avg(F.when(F.col("side"), F.col("angle"))).alias("before"), F.avg(F.when(~F.col("side"), F.col("angle"))).alias("after"))
    return mean.join(ks_statistic(both, "angle", "side", *by), list(by)) if by else mean.crossJoin(ks_statistic(both, "angle", "side"))  # one row


def smoothness(wide: DataFrame, columns: list[str], rate: float, cutoff: float, size: int = 256, least: int = 16) -> DataFrame:
    """Per mouse: the share of power above `cutoff` (in the unit of rate), averaged over columns of `least` values or more
    that are not constant; null if there are none. A mouse's columns are one group."""

    def of(key, pdf):
        pdf, got = pdf.sort_values("video_frame"), []
        for c in columns:
            x = pdf[c].dropna().to_numpy(float)
            if len(x) >= least and x.min() < x.max():
                f, p = welch(x, size)
                got.append(p[f * rate > cutoff].sum() / p.sum())
        return pd.DataFrame([[*key, float(np.mean(got)) if got else None]], columns=[*MOUSE, "high_share"])

    kinds = ", ".join(f"{k} {wide.schema[k].dataType.simpleString()}" for k in MOUSE)
    return wide.select(*MOUSE, "video_frame", *columns).groupBy(*MOUSE).applyInPandas(of, f"{kinds}, high_share double")


def phase_chain(phases: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """keys of the first phase with each phase's value and, from the second on, its change from the phase before it (null
    where either lacks the key)."""
    names = list(phases)
    named = lambda n: phases[n].select(*keys, F.col(value).alias(n))
    d = reduce(lambda a, n: a.join(named(n), keys, "left"), names[1:], named(names[0]))
    return d.select(*keys, *names, *[(F.col(b) - F.col(a)).alias(f"{b}_change") for a, b in zip(names, names[1:])])


def silhouette(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """cluster, n, silhouette: the mean over a cluster's rows of (b - a) / max(a, b), a being the mean squared distance to
    the others of the own cluster and b the least one to another cluster; rows alone in their cluster count 0. Means of
    squared distances follow from each cluster's count, sum and sum of squares, so no pairs are formed. Clusters are few
    (a row each in one array); rows without a vector or cluster do not count."""
    d = df.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(F.col(cluster).alias("cluster"), F.transform(vector, lambda v: v.cast("double")).alias("_v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    d = d.withColumn("_q", dot("_v", "_v"))
    sums = d.select("cluster", F.posexplode("_v").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("s"))
    sums = sums.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda e: e["s"]).alias("s"))
    facts = d.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("_q").alias("q")).join(sums, "cluster")
    one = facts.agg(F.collect_list(F.struct("cluster", "n", "q", "s")).alias("_all"))
    d = d.crossJoin(F.broadcast(one))  # one row
    total = lambda c: F.greatest(c["n"] * F.col("_q") - 2 * dot("_v", c["s"]) + c["q"], F.lit(0.0))
    mine = F.get(F.filter("_all", lambda c: c["cluster"] == F.col("cluster")), F.lit(0))
    d = d.withColumns({"_n": mine["n"], "_a": F.try_divide(total(mine), mine["n"] - 1), "_b": F.array_min(F.transform(F.filter("_all", lambda c: c["cluster"] != F.col("cluster")), lambda c: total(c) / c["n"]))})
    score = F.when(F.col("_n") > 1, F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))).otherwise(0.0)
    return d.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(score).alias("silhouette"))


def class_mix(asked: DataFrame, pool: DataFrame, identity: str = "window_id", y: str = "y", background: int | None = 0) -> DataFrame:
    """strategy, y, n, share, lift, wasted: the classes of what each strategy asked for, their share over that in the pool,
    and the share of the strategy's questions that the background took. asked: strategy, id."""
    base = pool.groupBy(y).agg(F.count("*").alias("_n")).withColumn("_base", F.col("_n") / F.sum("_n").over(Window.partitionBy()))  # a row a class
    got = asked.join(pool.select(identity, y), identity).groupBy("strategy", y).agg(F.count("*").alias("n"))
    w = Window.partitionBy("strategy")
    share = F.col("n") / F.sum("n").over(w)
    lost: Column = F.sum(F.when(F.col(y) == background, F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w) if background is not None else F.lit(0.0)
    return got.withColumns({"share": share, "wasted": lost}).join(base, y).select("strategy", y, "n", "share", (F.col("share") / F.col("_base")).alias("lift"), "wasted")
