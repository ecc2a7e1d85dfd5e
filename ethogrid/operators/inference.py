"""From tracking to a submission with one model per lab, all labs in one job, and calibration on out-of-fold predictions.

A lab's bundle is a row: a linear softmax model on standardised features, thresholds, class names and duration rules. Rows
meet their lab's bundle in a join, those of labs without one meet the fallback (lab null); no lab is looped over."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import tuning as T

# ---- models ----------------------------------------------------------------------------------------------------------

BUNDLE = "lab_id long, means array<double>, scales array<double>, weights array<array<double>>, bias array<double>"


def fitted(train: DataFrame, columns: list[str], classes: int, lab: int | None, strength: float = 0.01) -> tuple:
    """A BUNDLE row of a softmax model of class y (int) on train's columns; gaps count as the column's mean. Rows are
    weighted alike by class. A distributed fit."""
    one = train.agg(*[x for c in columns for x in (F.avg(c), F.stddev_pop(c))]).first()
    means, scales = [float(x or 0.0) for x in one[::2]], [float(x or 0.0) or 1.0 for x in one[1::2]]
    n = train.groupBy("y").agg(F.count("*").alias("n"))
    d = train.join(F.broadcast(n.select("y", (1.0 / F.col("n")).alias("w"))), "y")  # a row a class
    x = d.select(F.col("y").cast("double").alias("label"), "w", *[F.coalesce((F.col(c) - m) / s, F.lit(0.0)).alias(f"f{i}") for i, (c, m, s) in enumerate(zip(columns, means, scales))])
    model = LogisticRegression(family="multinomial", regParam=strength, weightCol="w", standardization=False).fit(VectorAssembler(inputCols=[f"f{i}" for i in range(len(columns))], outputCol="features").transform(x))
    w, b = np.full((classes, len(columns)), 0.0), np.full(classes, -30.0)  # classes that train lacks get next to nothing
    have = model.coefficientMatrix.toArray()
    known = {int(r["y"]) for r in n.collect()}  # a row a class
    for c in range(min(classes, len(have))):
        if c in known:
            w[c], b[c] = have[c], model.interceptVector[c]
    return lab, means, scales, w.tolist(), b.tolist()


def lab_bundles(train: DataFrame, columns: list[str], classes: int, few: int = 50) -> DataFrame:
    """BUNDLE rows: a model of each lab with `few` rows and two classes at least, and one of all labs (lab null)."""
    spark = train.sparkSession
    train = written(train.select("lab_id", "y", *columns), "train")
    sizes = train.groupBy("lab_id").agg(F.count("*").alias("n"), F.count_distinct("y").alias("k")).where((F.col("n") >= few) & (F.col("k") > 1))
    labs = sorted(r["lab_id"] for r in sizes.collect())  # a row a lab
    rows = [fitted(train.where(F.col("lab_id") == lab), columns, classes, lab) for lab in labs]  # each fit is a job of its own
    return spark.createDataFrame([*rows, fitted(train, columns, classes, None)], BUNDLE)


def scored(rows: DataFrame, columns: list[str], bundles: DataFrame) -> DataFrame:
    """rows (lab_id, columns, others) with p (array by class) of their lab's bundle, or of the fallback, and the bundle's
    other columns. Missing features count as the bundle's means."""
    mine = bundles.select("lab_id").where("lab_id IS NOT NULL").distinct().withColumn("_own", F.col("lab_id"))
    d = rows.join(mine, "lab_id", "left").withColumn("_own", F.coalesce("_own", F.lit(-1)))
    b = bundles.withColumn("_own", F.coalesce("lab_id", F.lit(-1))).drop("lab_id")
    d = d.join(b, "_own").drop("_own")
    x = F.array(*[F.col(c).cast("double") for c in columns])
    z = F.zip_with(F.zip_with(x, "means", lambda a, m: a - m), "scales", lambda a, s: F.coalesce(a / s, F.lit(0.0)))
    dot = lambda w, x: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    d = d.withColumn("_x", z)
    d = d.withColumn("_z", F.zip_with(F.transform("weights", lambda w: dot(w, F.col("_x"))), "bias", lambda a, b: a + b))
    d = d.withColumn("_e", F.transform("_z", lambda v: F.exp(v - F.array_max("_z"))))
    total = F.aggregate("_e", F.lit(0.0), lambda s, v: s + v)
    return d.withColumn("p", F.transform("_e", lambda v: v / total)).drop("_x", "_z", "_e", "means", "scales", "weights", "bias")


def out_of_fold(train: DataFrame, columns: list[str], classes: int, fold: str = "fold") -> DataFrame:
    """train with p, each row's by models of the other folds (per lab, else of all labs), all folds in one table."""
    folds = sorted(r[0] for r in train.select(fold).distinct().collect())  # a few folds
    train, out = written(train, "train"), None
    for k in folds:
        p = scored(train.where(F.col(fold) == k), columns, lab_bundles(train.where(F.col(fold) != k), columns, classes))
        out = p if out is None else out.unionByName(p)
    return written(out, "out_of_fold")


def cross_scored(rows: DataFrame, columns: list[str], bundles: DataFrame) -> DataFrame:
    """rows with p by every lab's own bundle in turn: train is the bundle's lab, test the row's. A row per row and lab."""
    labs = [r[0] for r in bundles.where("lab_id IS NOT NULL").select("lab_id").distinct().collect()]  # a row a lab
    each = rows.withColumn("test", F.col("lab_id")).withColumn("lab_id", F.explode(F.array(*[F.lit(k) for k in sorted(labs)])))
    return scored(each, columns, bundles).withColumnRenamed("lab_id", "train")


def cross_accuracy(rows: DataFrame, columns: list[str], classes: int, held: str, few: int = 50) -> DataFrame:
    """train, test, n, score: how often a model fitted on one lab's rows that are not held is right on the held rows of
    another, for all pairs of labs in one job after the fits; a lab's score on itself is on its own held rows."""
    bundles = lab_bundles(rows.where(f"NOT ({held})"), columns, classes, few)
    p = cross_scored(rows.where(held), columns, bundles)
    right = F.array_position("p", F.array_max("p")) - 1 == F.col("y")
    return p.groupBy("train", "test").agg(F.count("*").alias("n"), F.avg(right.cast("int")).alias("score"))


def submission(windows: DataFrame, columns: list[str], bundles: DataFrame, active: DataFrame, names: list[str], stats: DataFrame | None = None) -> DataFrame:
    """lab_id, KEY, action, start_frame, stop_frame: what the windows' bundles predict: probabilities, masks, the bundle's
    thresholds (column t, array by class), routing, merging, and the duration filter of the lab where stats has one.
    windows: tuning.WINDOW and columns; active: video_id, agent, target (NULL: self), cls."""
    s = scored(windows.select(*T.WINDOW, *columns), columns, bundles)
    long = s.select(*T.WINDOW, F.posexplode("p").alias("cls", "p"))
    w = T.as_windows(long, active).join(s.select("window_id", "t"), "window_id")
    decided = w.withColumn("cls", T.chosen(T.merit("p", "t", "residual", "allowed")))
    r = T.runs(T.labelled(decided, names), [])
    return r if stats is None else T.filtered(r, stats, [])


# ---- calibration -----------------------------------------------------------------------------------------------------


def pooled(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The rising means nearest to s / n, by pooling adjacent violators: blocks on a stack are merged while one is not above
    the one before it."""
    size, total, count = [], [], []
    for a, b in zip(n.tolist(), s.tolist()):
        w, v, k = a, b, 1
        while size and total[-1] * w >= v * size[-1]:
            w, v, k = w + size.pop(), v + total.pop(), k + count.pop()
        size.append(w)
        total.append(v)
        count.append(k)
    return np.repeat(np.array(total) / np.array(size), count)


def calibrators(oof: DataFrame, digits: int = 3) -> DataFrame:
    """lab_id, cls, at, q: per lab and class the isotonic regression of being the class on the probability, for each value
    of `digits` digits from 0 to 1, linear between the values seen and level beyond them. oof: lab_id, y, p (array).
    Probabilities are counted by value first, so that a group has 10 ** digits + 1 rows at most, whatever the lab's size."""
    long = oof.select("lab_id", "y", F.posexplode("p").alias("cls", "p")).where("p IS NOT NULL")
    n = long.groupBy("lab_id", "cls", F.round(F.col("p") * 10**digits).cast("int").alias("at")).agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("cls")).alias("s"))

    def of(key, pdf):
        pdf = pdf.sort_values("at")
        grid = np.arange(10**digits + 1)
        q = np.interp(grid, pdf["at"], pooled(pdf["n"].to_numpy(float), pdf["s"].to_numpy(float)))
        return pd.DataFrame({"lab_id": key[0], "cls": key[1], "at": grid, "q": q})

    return n.groupBy("lab_id", "cls").applyInPandas(of, f"lab_id {oof.schema['lab_id'].dataType.simpleString()}, cls int, at int, q double")


def calibrated(rows: DataFrame, table: DataFrame, digits: int = 3, least: float = 1e-6) -> DataFrame:
    """rows (window_id, lab_id, p) with the calibrated probabilities in q, scaled to sum 1 (each `least` at least before). A
    class of a lab without a calibrator keeps its probability."""
    long = rows.select("window_id", "lab_id", F.posexplode("p").alias("cls", "p")).withColumn("at", F.round(F.col("p") * 10**digits).cast("int"))
    j = long.join(table, ["lab_id", "cls", "at"], "left").withColumn("q", F.greatest(F.coalesce("q", "p"), F.lit(least)))
    g = j.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("cls", "q"))).alias("c"), F.sum("q").alias("total"))
    return rows.join(g.select("window_id", F.transform("c", lambda c: c["q"] / F.col("total")).alias("q")), "window_id")


def bag_weights(rows: DataFrame, bags: int, identity: list[str], seed: int = 0) -> DataFrame:
    """rows with bag and weight: how often a row is in each of `bags` resamples, a Poisson number of mean 1 by the hash of its
    identity, so alike under retries; rows of weight 0 are left out."""
    steps, mass = [], np.exp(-1.0)
    total, k = mass, 0
    while total < 1 - 2.0**-53 and k < 30:
        steps.append(float(total))
        k += 1
        mass /= k
        total += mass
    d = rows.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity], F.col("bag").cast("string")))
    u = F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / 2.0**52
    return d.withColumn("weight", F.size(F.filter(F.array(*map(F.lit, steps)), lambda c: c <= u))).where("weight > 0")
