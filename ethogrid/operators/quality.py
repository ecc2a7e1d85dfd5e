"""Quality of tracking and annotation: rates, thresholds, skeleton lengths, violations, outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import bounded_broadcast, unbroadcast, written
from ..sources.adapters import XY, to_long
from .stats import exact_percentiles


def edge_lengths(wide: DataFrame, *keys: str) -> DataFrame:
    """keys, edge, length: one row per edge of each frame."""
    parts = F.array(*[F.struct(F.lit(f"{a}→{b}").alias("edge"), G.apart(a, b).alias("length")) for a, b in G.EDGES])
    return wide.select(*keys, F.inline(parts))


def fit_skeleton(wide: DataFrame, *by: str, least: int = 10, q: float = 0.5) -> DataFrame:
    """Per edge (and `by`): the q-th percentile and sample std of length over body length; body length is the q-th
    percentile of nose-tail distances above 0. Edges with fewer than `least` positive lengths are left out."""
    wide = written(wide.select(*by, G.apart("nose", "tail_base").alias("_l"), *XY), "skeleton")
    body = exact_percentiles(wide.where("_l > 0"), ["_l"], (q,), *by).select(*by, F.get("v", F.lit(0)).alias("l_body"))
    e = edge_lengths(wide, *by).where("length > 0")
    e = e.join(body, list(by)) if by else e.crossJoin(F.broadcast(body))  # one row
    e = e.withColumn("r", F.col("length") / F.col("l_body"))
    mid = exact_percentiles(e, ["r"], (q,), *by, "edge").select(*by, "edge", F.get("v", F.lit(0)).alias("l_ref"))
    rest = e.groupBy(*by, "edge").agg(F.stddev_samp("r").alias("l_std"), F.count("*").alias("n")).where(F.col("n") >= least)
    return mid.join(rest, [*by, "edge"]).select(*by, "edge", "l_ref", "l_std", "n")


def violations(lengths: DataFrame, refs: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Per edge: violation rate, mean relative error, and the deviation's mean, max and percentiles; lengths without a
    value count as no violation. refs: edge, l_ref in the lengths' unit (a small table)."""
    d = written(lengths.join(refs.select("edge", "l_ref"), "edge").withColumn("dev", F.abs(F.col("length") - F.col("l_ref"))), "deviations")
    rel = F.col("dev") / F.col("l_ref")
    p = F.col("_v")
    q = exact_percentiles(d, ["dev"], (0.5, 0.75, 0.95, 0.99), *by, "edge").select(*[F.col(c).alias(f"_{c}") for c in (*by, "edge")], F.col("v").alias("_v"))
    g = d.groupBy(*by, "edge").agg(F.avg(F.coalesce((rel > threshold).cast("int"), F.lit(0))).alias("violation_rate"), F.avg(rel).alias("mean_rel_err"), F.avg("dev").alias("mean_dev"), F.max("dev").alias("max_dev"), F.stddev_pop("dev").alias("std_dev"))
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "edge")])
    return g.join(q, on, "left").select(*by, "edge", "violation_rate", "mean_rel_err", "mean_dev", "max_dev", F.get(p, F.lit(0)).alias("p50"), F.get(p, F.lit(1)).alias("p75"), F.get(p, F.lit(2)).alias("p95"), F.get(p, F.lit(3)).alias("p99"), "std_dev")


def violation_rate(lengths: DataFrame, refs: DataFrame, threshold: float) -> DataFrame:
    """edge and the violation rate that violations has, in one pass and without a written table."""
    rel = F.abs(F.col("length") - F.col("l_ref")) / F.col("l_ref")
    return lengths.join(refs.select("edge", "l_ref"), "edge").groupBy("edge").agg(F.avg(F.coalesce((rel > threshold).cast("int"), F.lit(0))).alias("violation_rate"))


def residuals(lengths: DataFrame, refs: DataFrame, *by: str) -> DataFrame:
    """Per edge: mean, deviation, percentiles and largest relative error of its length."""
    keys = [*by, "edge"]
    d = lengths.join(refs.select("edge", "l_ref"), "edge").select(*keys, (F.abs(F.col("length") - F.col("l_ref")) / F.col("l_ref")).alias("r")).where("r IS NOT NULL")
    d = written(d, "residuals")
    q = exact_percentiles(d, ["r"], (0.5, 0.9, 0.95, 0.99), *keys).select(*keys, *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))])
    return d.groupBy(*keys).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.max("r").alias("most")).join(q, keys)


def violation_magnitudes(lengths: DataFrame, refs: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Per edge: violations, and how far beyond the threshold they are on average and at most."""
    d = lengths.join(refs.select("edge", "l_ref"), "edge").withColumn("_r", F.abs(F.col("length") - F.col("l_ref")) / F.col("l_ref"))
    over = F.when(F.col("_r") > threshold, F.col("_r") - threshold)
    return d.groupBy(*by, "edge").agg(F.count(over).alias("violations"), F.avg(over).alias("mean_excess"), F.max(over).alias("max_excess"))


def orientation_flips(wide: DataFrame, most: float = 1.0) -> DataFrame:
    """Frames whose heading (tail to nose) turns by more than `most` radians against the frame before and turns back by as
    much in the next."""
    w = Window.partitionBy("video_id", "mouse_id").orderBy("video_frame")
    d = wide.select("video_id", "mouse_id", "video_frame", G.heading("tail_base_x", "tail_base_y", "nose_x", "nose_y").alias("a"))
    turn = lambda x, y: F.abs(G.wrap(x - y))
    flip = (turn(F.col("a"), F.lag("a").over(w)) > most) & (turn(F.lead("a").over(w), F.col("a")) > most)
    return d.select("video_id", "mouse_id", "video_frame", F.coalesce(flip, F.lit(False)).alias("flip"))


def every_outlier(wide: DataFrame, refs: dict[str, float], ends: dict[str, tuple[str, str]], k: float = 1.5, threshold: float = 0.25) -> DataFrame:
    """Flags and severity of all keypoints in `ends` (each with an edge that it ends), orientation flips counting 1 for the
    whole frame: video_id, mouse_id, video_frame, keypoint, flags, severity."""
    flips = orientation_flips(wide)
    out = None
    for point, edge in ends.items():
        o = outliers(wide, point, edge, refs, k, threshold).withColumn("keypoint", F.lit(point))
        out = o if out is None else out.unionByName(o)
    # as a table: the union's branches are partitioned alike, which a join above it would take for one partitioning
    d = unbroadcast(written(out, "outliers")).join(flips, ["video_id", "mouse_id", "video_frame"])
    return d.withColumn("severity", F.col("severity") + F.col("flip").cast("int"))


def keypoint_violations(per_edge: DataFrame) -> DataFrame:
    """Worst edge of each keypoint: its rate and mean relative error."""
    ends = per_edge.withColumn("keypoint", F.explode(F.split("edge", "→")))
    return ends.groupBy("keypoint").agg(F.max("violation_rate").alias("violation_rate"), F.max_by("mean_rel_err", F.struct("violation_rate", "edge")).alias("mean_rel_err"))


def any_violation_rate(wide: DataFrame, refs: dict[str, float], threshold: float, *by: str) -> DataFrame:
    """Share of frames with any violated edge."""
    bad = [F.coalesce(F.abs(G.apart(a, b) - refs[f"{a}→{b}"]) / refs[f"{a}→{b}"] > threshold, F.lit(False)) for a, b in G.EDGES]
    return wide.groupBy(*by).agg(F.avg(reduce(lambda x, y: x | y, bad).cast("int")).alias("rate"))


def adaptive_thresholds(residuals: DataFrame, k: float = 3.0, floor: float = 0.05, few: int = 5, *by: str) -> DataFrame:
    """Mean + k std of each edge's residuals up to their 75th percentile, at least floor; floor where there are few."""
    keys = [*by, "edge"]
    residuals = written(residuals.select(*keys, "r").where("r IS NOT NULL"), "residuals")
    cut = exact_percentiles(residuals, ["r"], (0.75,), *keys).select(*keys, F.get("v", F.lit(0)).alias("q"), "n")
    low = residuals.join(cut, keys).where("r <= q")
    return low.groupBy(*keys).agg(F.when(F.max("n") < few, F.lit(floor)).otherwise(F.greatest(F.lit(floor), F.avg("r") + k * F.stddev_pop("r"))).alias("tau"))


def reestimated(lengths: DataFrame, refs: DataFrame, *by: str) -> DataFrame:
    """Per edge: median of the half that deviates least from its reference, and IQR / 1.35 of it, within [.02, .2]."""
    keys = [*by, "edge"]
    d = lengths.where("length IS NOT NULL").join(F.broadcast(refs.select("edge", "l_ref")), "edge").withColumn("dev", F.abs(F.col("length") - F.col("l_ref")))  # one row an edge
    d = written(d.select(*keys, "length", "dev"), "lengths")
    half = exact_percentiles(d, ["dev"], (0.5,), *keys).select(*keys, F.get("v", F.lit(0)).alias("m"))
    half = bounded_broadcast(written(half, "halves"))  # one row per group and edge
    q = exact_percentiles(d.join(half, keys).where("dev <= m"), ["length"], (0.25, 0.5, 0.75), *keys)
    spread = (F.get("v", F.lit(2)) - F.get("v", F.lit(0))) / 1.35 / F.get("v", F.lit(1))
    return q.select(*keys, F.get("v", F.lit(1)).alias("l_ref"), F.least(F.lit(0.2), F.greatest(F.lit(0.02), spread)).alias("sigma"))


def robust_threshold(df: DataFrame, x: str, k: float, *by: str) -> DataFrame:
    """median + k * 1.4826 * MAD: two passes, the median joined back."""
    med = df.groupBy(*by).agg(F.percentile(x, F.lit(0.5)).alias("med"))
    back = df.join(med, list(by)) if by else df.crossJoin(F.broadcast(med))  # one row
    mad = back.groupBy(*by, "med").agg(F.percentile(F.abs(F.col(x) - F.col("med")), F.lit(0.5)).alias("mad"))
    return mad.withColumn("threshold", F.col("med") + k * 1.4826 * F.col("mad"))


def outlier_rates(long: DataFrame, k: float, *by: str) -> DataFrame:
    """Shares of speeds and accelerations above median + k * 1.4826 * MAD of their group. Speeds are written once; both
    medians, then both MADs, come from one count of values each."""
    names = ["speed", "accel"]
    s = written(with_speeds(long).select(*by, *names), "speeds")

    def joined(df: DataFrame, columns: list[str], out: list[str]) -> DataFrame:
        p = exact_percentiles(df, columns, (0.5,), *by).groupBy(*by).pivot("column", columns).agg(F.first(F.get("v", F.lit(0))))
        return s.join(bounded_broadcast(written(p.toDF(*by, *out), "middles")), list(by))  # one row per group

    med = joined(s, names, ["m_speed", "m_accel"])
    off = med.select(*by, *[F.abs(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])
    p = exact_percentiles(off, names, (0.5,), *by).groupBy(*by).pivot("column", names).agg(F.first(F.get("v", F.lit(0)))).toDF(*by, "d_speed", "d_accel")
    every = med.join(bounded_broadcast(written(p, "spreads")), list(by))
    return every.groupBy(*by).agg(*[F.avg((F.col(c) > F.col(f"m_{c}") + k * 1.4826 * F.col(f"d_{c}")).cast("int")).alias(f"{c}_outliers") for c in names])


def with_speeds(long: DataFrame) -> DataFrame:
    """Steps of each keypoint from row to row, and steps of those."""
    w = Window.partitionBy("video_id", "mouse_id", "bodypart").orderBy("video_frame")
    d = long.withColumn("speed", G.distance("x", "y", F.lag("x").over(w), F.lag("y").over(w)))
    return d.withColumn("accel", F.abs(F.col("speed") - F.lag("speed").over(w)))


def keypoint_report(long: DataFrame, *by: str) -> DataFrame:
    """Frames, mice, missing share, and the share of speeds above mean + 3 sample std."""
    d = with_speeds(long)
    cut = d.agg((F.avg("speed") + 3 * F.stddev_samp("speed")).alias("cut"))
    d = d.crossJoin(F.broadcast(cut))  # one row
    return d.groupBy(*by).agg(F.count_distinct("video_frame").alias("n_frames"), F.count_distinct("mouse_id").alias("n_mice"), F.avg(F.col("x").isNull().cast("int")).alias("missing"), F.avg((F.col("speed") > F.col("cut")).cast("int")).alias("speed_outliers"))


def recording_report(wide: DataFrame, *by: str, sigma: float = 3.0, off: float = 0.25) -> DataFrame:
    """Per recording: frames, mice, share of keypoints without place, of steps above the mean + sigma sample deviations of
    the recording, and of body lengths further than `off` from the median of their mouse."""
    steps = with_speeds(to_long(wide))
    cut = steps.groupBy(*by).agg(F.count_distinct("video_frame").alias("n_frames"), F.count_distinct("mouse_id").alias("n_mice"), F.avg((F.col("x").isNull() | F.col("y").isNull()).cast("int")).alias("nan_rate"), F.avg("speed").alias("_m"), F.stddev_samp("speed").alias("_s"))
    fast = steps.join(cut.select(*by, "_m", "_s"), list(by)).groupBy(*by).agg(F.avg(F.coalesce((F.col("_s") > 0) & (F.col("speed") > F.col("_m") + sigma * F.col("_s")), F.lit(False)).cast("int")).alias("speed_outlier_rate"))
    keys = [*by, *(["mouse_id"] if "mouse_id" not in by else [])]
    body = wide.select(*keys, G.apart("nose", "tail_base").alias("l"))
    med = body.groupBy(*keys).agg(F.percentile("l", F.lit(0.5)).alias("m"))
    bad = body.join(med, keys).groupBy(*by).agg(F.avg(F.coalesce(F.abs(F.col("l") - F.col("m")) / F.col("m") > off, F.lit(False)).cast("int")).alias("length_violation_rate"))
    return cut.drop("_m", "_s").join(fast, list(by)).join(bad, list(by))


def outliers(wide: DataFrame, keypoint: str, length_of: tuple[str, str], refs: dict[str, float], k: float = 1.5, threshold: float = 0.25) -> DataFrame:
    """Flags of one keypoint's frames: missing, speed and acceleration above q3 + k IQR of the mouse, an edge of wrong
    length, near zero; severity is their number, accelerations counting 0.75."""
    keys = ["video_id", "mouse_id"]
    w = Window.partitionBy(*keys).orderBy("video_frame")
    x, y = f"{keypoint}_x", f"{keypoint}_y"
    d = wide.withColumn("_s", G.distance(x, y, F.lag(x).over(w), F.lag(y).over(w))).withColumn("_a", F.abs(F.col("_s") - F.lag("_s").over(w)))
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    cut = d.groupBy(*keys).agg(q("_s").alias("qs"), q("_a").alias("qa"))
    d = d.join(cut, keys)
    above = lambda c, b: F.coalesce(F.col(c) > F.get(b, F.lit(1)) + k * (F.get(b, F.lit(1)) - F.get(b, F.lit(0))), F.lit(False))
    a, b = length_of
    ref = refs[f"{a}→{b}"]
    flags = {"missing": F.col(x).isNull() | F.col(y).isNull(), "speed": above("_s", F.col("qs")), "accel": above("_a", F.col("qa")), "length": F.coalesce(F.abs(G.apart(a, b) - ref) / ref > threshold, F.lit(False)), "near_zero": F.coalesce((F.abs(x) < 2) & (F.abs(y) < 2), F.lit(False))}
    severity = reduce(lambda p, r: p + r, [f.cast("int") * (0.75 if n == "accel" else 1.0) for n, f in flags.items()])
    return d.select(*keys, "video_frame", *[f.alias(n) for n, f in flags.items()], severity.alias("severity"))


def speed_spikes(wide: DataFrame, keypoint: str, k: float) -> DataFrame:
    """The keypoint's x and y, NULL where it arrives faster than median + k * MAD / 0.6745 of its mouse."""
    keys = ["video_id", "mouse_id"]
    w = Window.partitionBy(*keys).orderBy("video_frame")
    x, y = f"{keypoint}_x", f"{keypoint}_y"
    d = wide.select(*keys, "video_frame", x, y).withColumn("_s", G.distance(x, y, F.lag(x).over(w), F.lag(y).over(w)))
    t = robust_threshold(d.where("_s IS NOT NULL"), "_s", k / 1.4826 / 0.6745, *keys).select(*keys, "threshold")
    ok = F.coalesce(F.col("_s") <= F.col("threshold"), F.lit(True))
    return d.join(t, keys, "left").select(*keys, "video_frame", F.when(ok, F.col(x)).alias(x), F.when(ok, F.col(y)).alias(y))


def overlap_mask(centroids: DataFrame, near: float) -> DataFrame:
    """Frames in which two mice's centroids are nearer than `near`; a missing distance counts as 0."""
    o = centroids.select("video_id", "video_frame", F.col("mouse_id").alias("other"), F.col("centroid_x").alias("ox"), F.col("centroid_y").alias("oy"))
    d = centroids.join(o, ["video_id", "video_frame"]).where("mouse_id < other")
    return d.groupBy("video_id", "video_frame").agg(F.bool_or(F.coalesce(G.distance("centroid_x", "centroid_y", "ox", "oy"), F.lit(0.0)) < near).alias("overlap"))


def corrupted(wide: DataFrame, columns: list[str], noise: float = 5.0, dropout: float = 0.05, seed: int = 0) -> DataFrame:
    """Seeded dropout to 0 and uniform noise of the given scale, from hashes of the key, alike at every partitioning."""

    def uniform(tag: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{tag}"), "video_id", "mouse_id", "video_frame")), 1, 8), 16, 10).cast("double") / 2.0**32

    return wide.withColumns({c: F.when(uniform("drop" + c) < dropout, 0.0).otherwise(F.col(c) + noise * (2 * uniform("noise" + c) - 1)) for c in columns})
