"""Row-count windows, their labels and statistics, splits, caps and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, written


def _hash(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def members(rows: DataFrame, keys: list[str], size: int, stride: int, order: str = "video_frame") -> DataFrame:
    """rows with pos (from 0) and win, once for each full window of `size` rows that holds them; windows start every
    `stride` rows. Positions count rows, so gaps in the order column close up."""
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = rows.withColumns({"pos": pos, "_n": n})
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / stride)).cast("long")
    return d.withColumn("win", F.explode(F.sequence(first, F.floor(F.col("pos") / stride)))).where(F.col("win") * stride + size <= F.col("_n")).drop("_n")


def spans(rows: DataFrame, keys: list[str], size: int, stride: int, core: int | None = None, order: str = "video_frame") -> DataFrame:
    """First frame, frame after the last, and the core of each full window (the stride's width unless given)."""
    core = core or stride
    g = members(rows, keys, size, stride, order).groupBy(*keys, "win").agg(F.min(order).alias("start_frame"), (F.max(order) + 1).alias("stop_frame"))
    at = F.col("start_frame") + (size - core) // 2
    return g.withColumns({"core_start": at, "core_stop": at + core})


def statistics(win: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """mean, std (population), min, max, quartiles and their range of each column, missing values left out."""
    out = []
    for c in columns:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.get(q, F.lit(0)).alias(f"{c}_p25"), F.get(q, F.lit(1)).alias(f"{c}_p75"), (F.get(q, F.lit(1)) - F.get(q, F.lit(0))).alias(f"{c}_iqr")]
    return win.groupBy(*keys).agg(*out)


def window_labels(win: DataFrame, keys: list[str], label: str = "label", background: str = "background", ignore_background: bool = True) -> DataFrame:
    """Most frequent label of each window, ties to the first name; with ignore_background, background only where it is
    all there is."""
    n = win.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    rank = F.col("_n") if not ignore_background else F.when(F.col(label) == background, -1).otherwise(F.col("_n"))
    w = Window.partitionBy(*keys).orderBy(rank.desc(), label)
    return n.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*keys, F.col(label).alias("y"))


def centred_vote(rows: DataFrame, keys: list[str], order: str, cls: str, size: int) -> DataFrame:
    """Most frequent class among the rows around each (fewer at the ends), ties to the smaller class."""
    h = size // 2
    near = F.collect_list(cls).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-h, h))
    d = rows.withColumn("_near", near)
    best = F.array_max(F.transform(F.array_distinct("_near"), lambda c: F.struct(F.size(F.filter("_near", lambda x: x == c)).alias("n"), (-c).alias("c"))))
    return d.select(*keys, order, (-best["c"]).alias("vote"))


def circular(df: DataFrame, columns: list[str]) -> DataFrame:
    """Angles replaced by their sine and cosine."""
    return df.withColumns({f"{c}_{n}": f(F.col(c)) for c in columns for n, f in (("sin", F.sin), ("cos", F.cos))}).drop(*columns)


def missing_shares(df: DataFrame, columns: list[str], limit: float = 0.05) -> DataFrame:
    """column_name, missing (share of NULLs) and whether it exceeds the limit, from one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns])))
    return rows.withColumn("flagged", F.col("missing") > limit)


def decimated(rows: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """Every ceil(n / cap)-th row of each key, at most cap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = rows.withColumns({"_rn": F.row_number().over(w), "_n": n}).where((F.col("_rn") - 1) % F.ceil(F.col("_n") / cap) == 0)
    return d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn", "_n")


def capped(rows: DataFrame, keys: list[str], identity: list[str], cap: int, seed: int = 0) -> DataFrame:
    """At most cap rows of each key, those with the smallest seeded hashes."""
    w = Window.partitionBy(*keys).orderBy(_hash(seed, *identity), *identity)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def held_out_groups(groups: DataFrame, lab: str, group: str, share: float, seed: int = 0) -> DataFrame:
    """Of each lab, max(1, round(share * n)) groups held out by hash."""
    w = Window.partitionBy(lab).orderBy(_hash(seed, group), group)
    n = F.count(F.lit(1)).over(Window.partitionBy(lab))
    return groups.select(lab, group, (F.row_number().over(w) <= F.greatest(F.lit(1.0), F.bround(n * F.lit(share)))).alias("held_out"))


def temporal_split(rows: DataFrame, keys: list[str], order: str, val: float, test: float, purge: int) -> DataFrame:
    """part: train, val or test in time; `purge` rows on both sides of each boundary belong to none."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = rows.withColumns({"_i": i, "_n": n})
    te = F.col("_n") - F.floor(F.col("_n") * F.lit(test))
    va = te - F.floor(F.col("_n") * F.lit(val))
    i = F.col("_i")
    part = F.when(i < va - purge, "train").when((i >= va + purge) & (i < te - purge), "val").when(i >= te + purge, "test")
    return d.withColumn("part", part).where("part IS NOT NULL").drop("_i", "_n")


def stratified(rows: DataFrame, cls: str, identity: list[str], share: float, seed: int = 0) -> DataFrame:
    """rows with held: of each class the bround(share * n) rows with the smallest hashes of their identity, which is
    unique. Hashes are counted by 65,536 ranges; only the range of each class in which the cut falls is sorted, and rows
    meet one threshold per class, so that no class is sorted and no row is shuffled."""
    h = _hash(seed, *identity)
    d = rows.withColumn("_h", F.struct(h.alias("h"), *identity)).withColumn("_r", F.conv(F.substring("_h.h", 1, 4), 16, 10).cast("int"))
    n = d.groupBy(cls, "_r").agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(cls).orderBy("_r"))
    n = n.withColumns({"_to": up_to, "_want": F.bround(F.sum("_n").over(Window.partitionBy(cls)) * F.lit(share))})
    over = F.col("_to") > F.col("_want")  # from the range on in which the cut falls
    cuts = n.groupBy(cls).agg(F.min(F.when(over, F.struct("_r", (F.col("_want") - F.col("_to") + F.col("_n")).alias("left")))).alias("_c")).select(F.col(cls).alias("_cls"), "_c.*")
    cuts = bounded_broadcast(written(cuts.withColumnRenamed("_r", "_cut"), "cuts"))  # a row a class
    inside = d.join(cuts, d[cls].eqNullSafe(cuts["_cls"]) & (d["_r"] == cuts["_cut"]))
    inside = inside.withColumn("_rn", F.row_number().over(Window.partitionBy(cls).orderBy("_h"))).where("_rn <= left")
    last = inside.groupBy(F.col("_cls").alias("_k")).agg(F.max("_h").alias("_last"))
    ends = bounded_broadcast(written(cuts.join(last, F.col("_cls").eqNullSafe(F.col("_k")), "left").select("_cls", "_cut", "_last"), "ends"))
    held = F.coalesce(F.col("_r") < F.col("_cut"), F.lit(True)) | F.coalesce((F.col("_r") == F.col("_cut")) & (F.col("_h") <= F.col("_last")), F.lit(False))
    return d.join(ends, d[cls].eqNullSafe(ends["_cls"]), "left").select(*[d[c] for c in rows.columns], held.alias("held"))


def autocorrelation(rows: DataFrame, x: str, keys: list[str], order: str, lags: tuple[int, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    d = rows.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"), *[F.lag(x, k).over(w).alias(f"_{k}") for k in lags])
    return d.groupBy(*keys).agg(*[F.corr("_x", f"_{k}").alias(f"lag_{k}") for k in lags])


def outlier_windows(frames: DataFrame, keys: list[str], gap: int, pad: int, frame: str = "video_frame") -> DataFrame:
    """Flagged frames joined where they are at most `gap` apart, padded by `pad` frames (from 0): first, stop."""
    w = Window.partitionBy(*keys).orderBy(frame)
    new = F.coalesce(F.col(frame) - F.lag(frame).over(w) > gap, F.lit(True)).cast("int")
    d = frames.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_run").agg(F.greatest(F.min(frame) - pad, F.lit(0)).cast("long").alias("first"), (F.max(frame) + pad + 1).cast("long").alias("stop")).drop("_run")
