"""Models with pyspark.ml: forests and boosted trees per lab or left-out video, scalers, embeddings, active learning."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import shared_folder, written
from .decide import class_weights
from .stats import exact_percentiles


def assembled(df: DataFrame, columns: list[str], out: str = "features", train: DataFrame | None = None) -> DataFrame:
    """df with a vector of the columns; gaps get the means of train (df itself without one)."""
    filled = Imputer(inputCols=columns, outputCols=columns, strategy="mean").fit(df if train is None else train).transform(df)
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(filled)


def weighted(df: DataFrame, y: str = "y") -> DataFrame:
    """df with the balanced class weight of each row; the weights are one row per class."""
    return df.join(F.broadcast(class_weights(df, y).select(y, F.col("balanced").alias("weight"))), y)


def forest(trees: int = 50, depth: int = 8, leaf: int = 4, seed: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="y", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)


def boosted(rounds: int = 20, seed: int = 1) -> OneVsRest:
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, seed=seed), labelCol="y", featuresCol="features", weightCol="weight")


def left_out(df: DataFrame, columns: list[str], fold: str, held, model) -> DataFrame:
    """Predictions for the rows of fold `held` by a model of the others, which alone give the means for gaps."""
    train = df.where(F.col(fold) != held)
    fitted = model.fit(weighted(assembled(train, columns)))
    return fitted.transform(assembled(df.where(F.col(fold) == held), columns, train=train))


def scaled(train: DataFrame, both: DataFrame, kind: str = "robust", features: str = "features") -> DataFrame:
    """Scaler fitted on train alone, applied to both."""
    s = RobustScaler(inputCol=features, outputCol="scaled", withCentering=True) if kind == "robust" else StandardScaler(inputCol=features, outputCol="scaled", withMean=True)
    return s.fit(train).transform(both)


def quantile_scaled(train: DataFrame, both: DataFrame, columns: list[str], parts: int = 100) -> DataFrame:
    """both with each column turned into a normal score by the quantiles of train (linear between `parts` of them)."""
    q = exact_percentiles(train, columns, tuple(i / parts for i in range(parts + 1))).select("column", "v").collect()  # one row a column
    marks = {r["column"]: r["v"] for r in q}

    def score(c: str) -> Column:
        v = F.array(*[F.lit(float(x)) for x in marks[c]])
        below = F.size(F.filter(v, lambda m: m <= F.col(c)))
        low, high = F.get(v, below - 1), F.get(v, below)
        part = F.when(below == 0, 0.0).when(below > parts, 1.0).otherwise((below - 1 + F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))) / parts)
        return F.when(F.col(c).isNotNull(), G.probit(F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), part))))

    return both.withColumns({c: score(c) for c in columns})


def calibrated_svm(train: DataFrame, test: DataFrame, columns: list[str], classes: list[float], fold: Column) -> DataFrame:
    """test with prediction and p (an array): one linear machine a class, its margins turned into probabilities by isotonic
    regression on the part of train where fold is true, which the machine does not see; p sums to 1."""
    fit, rest = train.where(~fold), train.where(fold)
    fit, rest, out = assembled(fit, columns), assembled(rest, columns, train=fit), assembled(test, columns, train=fit)
    margin = lambda m, df: m.transform(df).withColumn("_m", F.get(vector_to_array("rawPrediction"), F.lit(1))).drop("rawPrediction", "prediction")
    for k, c in enumerate(classes):
        machine = LinearSVC(labelCol="_y", featuresCol="features", maxIter=20).fit(fit.withColumn("_y", (F.col("y") == c).cast("double")))
        curve = IsotonicRegression(labelCol="_y", featuresCol="_m", predictionCol="_p").fit(margin(machine, rest.withColumn("_y", (F.col("y") == c).cast("double"))))
        out = curve.transform(margin(machine, out)).withColumnRenamed("_p", f"_p{k}").drop("_m")
    p = F.array(*[F.greatest(F.col(f"_p{k}"), F.lit(1e-6)) for k in range(len(classes))])
    out = out.withColumn("p", p).withColumn("_t", F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).withColumn("p", F.transform("p", lambda x: x / F.col("_t")))
    best = F.get(F.array(*map(F.lit, classes)), F.array_position("p", F.array_max("p")).cast("int") - 1)
    return out.withColumn("prediction", best).drop("_t", *[f"_p{k}" for k in range(len(classes))])


def per_group(df: DataFrame, columns: list[str], group: str, fold: str, model, least: int = 20) -> DataFrame:
    """Predictions for each row by a model of its group, fitted on the other folds; groups that have fewer than `least`
    rows of some class that they hold, or one class alone, get the model of all groups. One fit a group and fold; each
    one's predictions are written at once, so that no plan grows with the groups."""
    df = written(df, "grouped")
    n = df.groupBy(group, "y").agg(F.count("*").alias("n")).groupBy(group).agg(F.min("n").alias("least"), F.count("*").alias("classes"))
    plan, folds = n.collect(), [r[0] for r in df.select(fold).distinct().collect()]  # one row a group, one a fold
    small = [r[group] for r in plan if r["least"] < least or r["classes"] < 2]
    keep, path = [*df.columns, "prediction", "fallback"], f"{shared_folder(df.sparkSession)}/predicted-{uuid.uuid4().hex}"
    for k in folds:
        for g in [r[group] for r in plan if r[group] not in small]:
            left_out(df.where(F.col(group) == g), columns, fold, k, model).withColumn("fallback", F.lit(False)).select(keep).write.mode("append").parquet(path)
        if small:
            left_out(df, columns, fold, k, model).where(F.col(group).isin(small)).withColumn("fallback", F.lit(True)).select(keep).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def importances(df: DataFrame, columns: list[str], model) -> DataFrame:
    """feature, importance: the impurity importances of a fitted forest."""
    fitted = model.fit(weighted(assembled(df, columns)))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, fitted.featureImportances.toArray())], "feature string, importance double")


def permuted_importances(df: DataFrame, columns: list[str], held: Column, model, seed: int = 0, rows: int = 65536) -> DataFrame:
    """feature, loss: what accuracy on the held rows loses if a column takes another held row's value, by a rotation of the
    rows in hash order of one place. Held rows are dealt by hash to groups of about `rows`, whose number follows from
    their count; each row is predicted as it is and with each column exchanged, all in one job."""
    train, test = df.where(~held), written(df.where(held), "held")
    fitted = model.fit(weighted(assembled(train, columns)))
    groups = max(1, -(-test.count() // rows))
    order = Window.partitionBy(F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(groups))).orderBy(F.xxhash64(F.lit(seed + 1), *columns))
    mine = F.struct(*columns)
    d = test.select("y", mine.alias("m"), F.coalesce(F.lag(mine).over(order), F.last(mine).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("o"))
    one = lambda name: F.struct(F.lit(name).alias("feature"), *[F.col(f"{'o' if c == name else 'm'}.{c}").cast("double").alias(c) for c in columns])
    long = d.select("y", F.inline(F.array(*[one(c) for c in ["", *columns]])))
    right = fitted.transform(assembled(long, columns, train=train)).groupBy("feature").agg(F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("a"))
    base = right.where("feature = ''").select(F.col("a").alias("base"))
    return right.where("feature <> ''").crossJoin(F.broadcast(base)).select("feature", (F.col("base") - F.col("a")).alias("loss"))  # one row


def resampled(df: DataFrame, weight: str, identity: str, seed: int = 0) -> DataFrame:
    """Rows repeated floor(weight) times, and once more with the chance of what is left, by the hash of the id."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(identity).cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    n = (F.floor(weight) + (u < F.col(weight) - F.floor(weight)).cast("long")).cast("int")
    return df.withColumn("_n", n).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def projected(df: DataFrame, k: int = 2, features: str = "features") -> DataFrame:
    """First k principal components as an array."""
    p = PCA(k=k, inputCol=features, outputCol="_pca").fit(df).transform(df)
    return p.withColumn("pca", vector_to_array("_pca")).drop("_pca")


def uncertainty(p: Column, kind: str) -> Column:
    """Higher: asked first."""
    return {"confidence": 1 - F.array_max(p), "margin": -G.margin(p), "entropy": G.entropy(p)}[kind]


def bald(members: DataFrame, identity: str, p: str = "p") -> DataFrame:
    """Mutual information of each row's class and the ensemble member: entropy of the mean less the mean entropy."""
    each = members.select(identity, F.posexplode(p).alias("cls", "v")).groupBy(identity, "cls").agg(F.avg("v").alias("v"))
    total = each.groupBy(identity).agg(F.sum(-F.col("v") * F.ln(F.col("v") + 1e-12)).alias("h"))
    mean = members.groupBy(identity).agg(F.avg(G.entropy(F.col(p))).alias("m"))
    return total.join(mean, identity).select(identity, (F.col("h") - F.col("m")).alias("bald"))


def query_batch(pool: DataFrame, labelled: DataFrame, n: int, kind: str, identity: str = "window_id") -> DataFrame:
    """The n most uncertain rows of the pool that are not labelled; ties to the smaller id."""
    left = pool.join(labelled.select(identity), identity, "left_anti")
    return left.withColumn("score", F.round(uncertainty(F.col("p"), kind), 6)).orderBy(F.desc("score"), identity).limit(n).select(identity, "score")


def k_center(pool: DataFrame, n: int, vector: str, identity: str, first, near: int = 512) -> DataFrame:
    """n rows, each the farthest from those chosen so far (core-set), ties to the smaller id. Distances stay with the rows.
    Each pass brings the `near` farthest rows to the driver. Distances only fall, so their best one is the farthest row of
    all as long as it stands before the last row brought; many are chosen in a pass, and the result is that of one pass
    per choice."""
    start = pool.where(F.col(identity) == first).select(identity, vector).first()
    chosen, new = [start[0]], [[float(x) for x in start[1]]]
    d = pool.select(identity, F.transform(vector, lambda x: x.cast("double")).alias("_v"), F.lit(float("inf")).alias("_d"))

    def away(v) -> Column:
        return F.sqrt(F.aggregate(F.zip_with("_v", v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

    while len(chosen) < n:
        marks = F.array(*[F.array(*[F.lit(x) for x in v]) for v in new])
        d = written(d.withColumn("_d", F.least("_d", F.array_min(F.transform(marks, away)))), "distances")
        top = d.orderBy(F.desc("_d"), identity).limit(near + 1).collect()
        last = (-top[near]["_d"], top[near][identity]) if len(top) > near else (np.inf, 0)
        ids, far, v = [r[identity] for r in top[:near]], np.array([r["_d"] for r in top[:near]]), np.array([r["_v"] for r in top[:near]])
        new = []
        while len(chosen) < n:
            k = min(range(len(ids)), key=lambda i: (-far[i], ids[i]))
            if (-far[k], ids[k]) >= last:
                break
            chosen.append(ids[k])
            new.append(v[k].tolist())
            total = np.zeros(len(ids))
            for c in range(v.shape[1]):  # in the order of the rows' own sums
                total = total + (v[:, c] - v[k, c]) * (v[:, c] - v[k, c])
            far = np.minimum(far, np.sqrt(total))
    return pool.sparkSession.createDataFrame(list(enumerate(chosen)), f"step int, {identity} long")


def seed_set(pool: DataFrame, per_class: int, y: str = "y", identity: str = "window_id", seed: int = 0) -> DataFrame:
    """A stratified first batch: per_class rows of each class, by hash."""
    w = Window.partitionBy(y).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(identity).cast("string"))), identity)
    return pool.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_class).drop("_rn")
