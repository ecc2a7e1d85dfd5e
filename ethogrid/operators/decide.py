"""From window probabilities to actions: masks, thresholds, smoothing, revival, selection, and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal as S


def active_mask(long: DataFrame, active: DataFrame) -> DataFrame:
    """Rows (window, cls) whose class the video annotates for the agent with itself or with the target.
    active: video_id, agent, target (NULL: self), cls."""
    own = active.where("target IS NULL").select("video_id", "agent", "cls").distinct().withColumn("_own", F.lit(True))
    pair = active.where("target IS NOT NULL").select("video_id", "agent", "target", "cls").distinct().withColumn("_pair", F.lit(True))
    d = long.join(own, ["video_id", "agent", "cls"], "left").join(pair, ["video_id", "agent", "target", "cls"], "left")
    return d.withColumn("allowed", F.coalesce("_own", F.lit(False)) | F.coalesce("_pair", F.lit(False))).drop("_own", "_pair")


def decide(masked: DataFrame, thresholds: DataFrame, mode: str = "residual", background: int = 0) -> DataFrame:
    """cls of each window: the allowed class with the largest p - t (or p / t), if its p exceeds t; else background.
    thresholds: lab_id, cls, t."""
    t = F.col("t")
    merit = F.col("p") - t if mode == "residual" else F.col("p") / F.greatest(t, F.lit(1e-6))
    d = masked.join(thresholds, ["lab_id", "cls"])
    ok = F.col("allowed") & (F.col("cls") != background)
    best = F.max_by(F.struct("cls", "p", "t"), F.when(ok, F.struct(merit, -F.col("cls"))))
    g = d.groupBy("window_id", "lab_id", "video_id", "agent", "target", "core_start", "core_stop").agg(best.alias("b"))
    return g.withColumn("cls", F.when(F.col("b.p") > F.col("b.t"), F.col("b.cls")).otherwise(background)).drop("b")


def smoothed(long: DataFrame, width: int = 9, order: int = 2) -> DataFrame:
    """Savitzky-Golay over each (video, agent, class) sequence, missing values as 0."""
    w = Window.partitionBy("video_id", "agent", "cls").orderBy("core_start", "window_id")
    return long.withColumn("p", F.coalesce(S.savgol("p", w, width, order), F.lit(0.0)))


def revived(long: DataFrame, decided: DataFrame, dead: DataFrame, n: int) -> DataFrame:
    """The n background windows with the largest p of each dead (lab_id, cls)."""
    idle = decided.where("cls = 0").select("window_id")
    d = long.join(dead, ["lab_id", "cls"], "left_semi").join(idle, "window_id", "left_semi")
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("lab_id", "cls").orderBy(F.desc("p"), "window_id"))).where(F.col("rn") <= n)


def confusion(df: DataFrame, true: str, pred: str, *by: str) -> DataFrame:
    return df.groupBy(*by, true, pred).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, true: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of each true or predicted class, from one count per pair."""
    c = confusion(df, true, pred)
    rows = c.select(F.explode(F.array(F.struct(F.col(true).alias("cls"), F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col(pred).alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x")).select("x.*")
    g = rows.groupBy("cls").agg(*[F.sum(k).alias(k) for k in ("tp", "t", "p")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    d = lambda k: F.col(k).cast("double")
    return g.select("cls", ratio(d("tp"), d("p")).alias("precision"), ratio(d("tp"), d("t")).alias("recall"), ratio(2 * d("tp"), d("t") + d("p")).alias("f1"), F.col("t").alias("support"))


def summary(report: DataFrame) -> DataFrame:
    """Macro and support-weighted means over classes with support."""
    r = report.where("support > 0")
    return r.agg(F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.count("*").alias("classes"))


def calibration_error(df: DataFrame, p: str = "p", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Expected calibration error over half-open bins; p = 1 is in none."""
    b = df.where(F.col(p) < 1).groupBy(F.floor(F.col(p) * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))
    total = df.agg(F.count("*").alias("total"))
    return b.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("acc") - F.col("conf"))).alias("ece"))  # one row


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Balanced n / (k n_c), and 1 / n_c scaled to mean 1."""
    n = df.groupBy(y).agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("all"), F.count("*").alias("k"), F.avg(1 / F.col("n")).alias("inv"))
    return n.crossJoin(F.broadcast(t)).select(y, "n", (F.col("all") / (F.col("k") * F.col("n"))).alias("balanced"), (1 / F.col("n") / F.col("inv")).alias("inverse"))  # one row


def evaluable(df: DataFrame, y: str, group: str, least: int = 2) -> DataFrame:
    return df.groupBy(y).agg(F.count_distinct(group).alias("groups")).where(F.col("groups") >= least)


def drift(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Between-group over within-group variance of each column."""
    g = df.groupBy(group).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.var_pop(c).alias(f"{c}_v"))])
    return g.agg(*[F.try_divide(F.var_pop(f"{c}_m"), F.avg(f"{c}_v")).alias(c) for c in columns])
