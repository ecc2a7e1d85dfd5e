"""Deterministic views of relational tables as pose, annotation, probability and metadata tables, each with its SQL.

pose: line items of a supplier are the frames of a video, the parity of the order is the mouse. ann: events of a user are
the intervals of a video. proba: embeddings are windows. meta: customers are videos, their nations the labs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYPOINTS = ["nose", "neck", "ear_left", "ear_right", "hip_left", "hip_right", "tail_base"]
XY = [f"{k}_{a}" for k in KEYPOINTS for a in "xy"]


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide: video_id, mouse_id, video_frame and x, y of seven keypoints; tails of some frames are missing, some frames
    are all zero."""
    w = Window.partitionBy("l_suppkey", F.col("l_orderkey") % 2).orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    f = line.select(F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") % 2 + 1).cast("int").alias("mouse_id"), (F.row_number().over(w) - 1).alias("video_frame"), "l_linenumber", *[F.expr(e) for e in ("l_quantity AS nx", "l_extendedprice / 1000 AS ny", "CASE WHEN l_linenumber < 7 THEN l_discount * 100 END AS tx", "CASE WHEN l_linenumber < 7 THEN l_tax * 100 END AS ty")])
    zero = "l_linenumber = 1 AND nx = 50"
    at = {"nose": ("nx", "ny"), "neck": ("(nx * 3 + coalesce(tx, 0)) / 4", "(ny * 3 + coalesce(ty, 0)) / 4"), "ear_left": ("nx - 1 - l_linenumber * 0.125", "ny - 2"), "ear_right": ("nx + 1", "ny - 2 - l_linenumber * 0.125"), "hip_left": ("(nx + coalesce(tx, 0) * 3) / 4 - 1", "(ny + coalesce(ty, 0) * 3) / 4"), "hip_right": ("(nx + coalesce(tx, 0) * 3) / 4 + 1", "(ny + coalesce(ty, 0) * 3) / 4"), "tail_base": ("tx", "ty")}
    return f.select("video_id", "mouse_id", "video_frame", *[F.expr(f"CASE WHEN {zero} THEN 0D ELSE {e} END").alias(f"{k}_{a}") for k, xy in at.items() for a, e in zip("xy", xy)])


POSE_SQL = """f AS (SELECT l_suppkey AS video_id, (l_orderkey % 2 + 1)::INT AS mouse_id, row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 2 ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS video_frame,
  l_linenumber, l_quantity AS nx, l_extendedprice / 1000 AS ny, CASE WHEN l_linenumber < 7 THEN l_discount * 100 END AS tx, CASE WHEN l_linenumber < 7 THEN l_tax * 100 END AS ty, l_linenumber = 1 AND l_quantity = 50 AS z FROM lineitem),
pose AS (SELECT video_id, mouse_id, video_frame, if(z, 0, nx) AS nose_x, if(z, 0, ny) AS nose_y, if(z, 0, (nx * 3 + coalesce(tx, 0)) / 4) AS neck_x, if(z, 0, (ny * 3 + coalesce(ty, 0)) / 4) AS neck_y,
  if(z, 0, nx - 1 - l_linenumber * 0.125::DOUBLE) AS ear_left_x, if(z, 0, ny - 2) AS ear_left_y, if(z, 0, nx + 1) AS ear_right_x, if(z, 0, ny - 2 - l_linenumber * 0.125::DOUBLE) AS ear_right_y,
  if(z, 0, (nx + coalesce(tx, 0) * 3) / 4 - 1) AS hip_left_x, if(z, 0, (ny + coalesce(ty, 0) * 3) / 4) AS hip_left_y, if(z, 0, (nx + coalesce(tx, 0) * 3) / 4 + 1) AS hip_right_x, if(z, 0, (ny + coalesce(ty, 0) * 3) / 4) AS hip_right_y,
  if(z, 0, tx) AS tail_base_x, if(z, 0, ty) AS tail_base_y FROM f)"""


def to_long(wide: DataFrame, keypoints: list[str] = KEYPOINTS) -> DataFrame:
    """One row per keypoint: the columns that aren't coordinates, bodypart, x, y."""
    keys = [c for c in wide.columns if not any(c in (f"{k}_x", f"{k}_y") for k in keypoints)]
    parts = F.array(*[F.struct(F.lit(k).alias("bodypart"), F.col(f"{k}_x").alias("x"), F.col(f"{k}_y").alias("y")) for k in keypoints])
    return wide.select(*keys, F.inline(parts))


LONG_SQL = POSE_SQL + ",\nlong AS (" + " UNION ALL ".join(f"SELECT video_id, mouse_id, video_frame, '{k}' AS bodypart, {k}_x AS x, {k}_y AS y FROM pose" for k in KEYPOINTS) + ")"


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals: video_id, agent_id, target_id, action, start_frame, stop_frame; some are inverted or start below 0."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    e = e.select(F.col("user_id").alias("video_id"), (F.col("event_id") % 2 + 1).cast("int").alias("agent_id"), "event_id", F.col("event_type").alias("action"), (F.floor((F.unix_timestamp("ts") - 1704067200) / 600) - 5).cast("long").alias("start_frame"), "value")
    target = F.when(F.col("event_id") % 5 == 0, F.col("agent_id")).otherwise(3 - F.col("agent_id"))
    stop = F.col("start_frame") + F.when(F.col("event_id") % 31 == 0, -2).otherwise(1 + F.floor("value"))
    return e.select("event_id", "video_id", "agent_id", target.alias("target_id"), "action", "start_frame", stop.alias("stop_frame"))


ANN_SQL = """ev AS (SELECT event_id, user_id AS video_id, (event_id % 2 + 1)::INT AS agent_id, event_type AS action, floor((floor(epoch(ts)) - 1704067200) / 600)::BIGINT - 5 AS start_frame, value FROM events),
ann AS (SELECT event_id, video_id, agent_id, CASE WHEN event_id % 5 = 0 THEN agent_id ELSE 3 - agent_id END AS target_id, action, start_frame, start_frame + CASE WHEN event_id % 31 = 0 THEN -2 ELSE 1 + floor(value)::BIGINT END AS stop_frame FROM ev)"""


def proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows: window_id, lab_id, video_id, agent, target, core_start, core_stop, y, p (softmax of the first dimensions)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    raw = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(8 * x.cast("double")))
    e = e.withColumn("raw", raw).withColumn("total", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x))
    v = F.floor(F.col("vec_id") / 50)
    i = F.col("vec_id") % 50
    return e.select(F.col("vec_id").alias("window_id"), (v % 4).alias("lab_id"), v.alias("video_id"), (i % 2 + 1).cast("int").alias("agent"), F.when(F.col("vec_id") % 3 == 0, i % 2 + 1).otherwise(2 - i % 2).cast("int").alias("target"), (F.floor(i / 2) * 8).alias("core_start"), (F.floor(i / 2) * 8 + 8).alias("core_stop"), F.col("label").alias("y"), F.transform("raw", lambda x: x / F.col("total")).alias("p"))


PROBA_SQL = """er AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: exp(8 * x::DOUBLE)) AS raw FROM embeddings),
proba AS (SELECT vec_id AS window_id, (vec_id // 50) % 4 AS lab_id, vec_id // 50 AS video_id, (vec_id % 50 % 2 + 1)::INT AS agent, CASE WHEN vec_id % 3 = 0 THEN vec_id % 50 % 2 + 1 ELSE 2 - vec_id % 50 % 2 END::INT AS target,
  (vec_id % 50 // 2) * 8 AS core_start, (vec_id % 50 // 2) * 8 + 8 AS core_stop, label AS y, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM er)"""


def proba_long(p: DataFrame) -> DataFrame:
    return p.select("window_id", "lab_id", "video_id", "agent", "target", "core_start", "core_stop", "y", F.posexplode("p").alias("cls", "p"))


PROBA_LONG_SQL = PROBA_SQL + """,
pl AS (SELECT window_id, lab_id, video_id, agent, target, core_start, core_stop, y, unnest(range(0, 10))::INT AS cls, unnest(p) AS p FROM proba)"""


def meta_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as it comes from a CSV: lists are JSON text, some with single quotes, some broken or missing."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    strains = [F.when(k % d == 0, seg).alias(f"mouse{i}_strain") for i, d in zip(range(1, 5), (1, 2, 3, 5))]
    parts = F.when(k % 4 == 0, F.lit("['nose', 'tail_base']")).when(k % 7 == 0, F.lit("nose")).when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit('["nose","neck"'), F.when(k % 3 == 0, F.lit(',"tail_base"')).otherwise(F.lit("")), F.lit("]")))
    behaviors = F.when(k % 5 == 0, F.lit("[]")).otherwise(F.concat(F.lit('["1,2,click","2,1,'), F.lower(seg), F.lit('"]')))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("video_id"), F.col("n_name").alias("lab_id"), (25 + k % 6).cast("double").alias("frames_per_second"), (60 + k % 100).cast("double").alias("video_duration_sec"), (800 + k % 5 * 100).cast("double").alias("video_width_pix"), (600 + k % 3 * 100).cast("double").alias("video_height_pix"), seg.alias("tracking_method"), *strains, parts.alias("body_parts_tracked"), behaviors.alias("behaviors_labeled"))


META_SQL = """meta AS (SELECT c_custkey AS video_id, n_name AS lab_id, (25 + c_custkey % 6)::DOUBLE AS frames_per_second, (60 + c_custkey % 100)::DOUBLE AS video_duration_sec, (800 + c_custkey % 5 * 100)::DOUBLE AS video_width_pix, (600 + c_custkey % 3 * 100)::DOUBLE AS video_height_pix,
  c_mktsegment AS tracking_method, CASE WHEN c_custkey % 4 = 0 THEN ['nose', 'tail_base'] WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN []::VARCHAR[] WHEN c_custkey % 3 = 0 THEN ['nose', 'neck', 'tail_base'] ELSE ['nose', 'neck'] END AS body_parts,
  CASE WHEN c_custkey % 5 = 0 THEN []::VARCHAR[] ELSE ['1,2,click', '2,1,' || lower(c_mktsegment)] END AS behaviors, c_mktsegment AS strain, 1 + (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT AS n_mice FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
