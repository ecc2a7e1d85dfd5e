"""Sources: video metadata, tracking and annotations."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKING = "video_frame int, mouse_id tinyint, bodypart string, x float, y float, lab_id string, video_id string"
ANNOTATION = "agent_id tinyint, target_id tinyint, action string, start_frame int, stop_frame int, lab_id string, video_id string"


def null_if_not_finite(x: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def parse_list(text: Column) -> Column:
    """A JSON list of strings; else the same with single quotes; else the empty list. Null: the empty list."""
    kind = T.ArrayType(T.StringType())
    first, second = F.from_json(text, kind), F.from_json(F.replace(text, F.lit("'"), F.lit('"')), kind)
    return F.coalesce(F.when(text.startswith("["), F.coalesce(first, second)), F.array().cast("array<string>"))


def with_metadata(raw: DataFrame) -> DataFrame:
    """Parsed lists and n_body_parts, n_behaviors_labeled, n_mice (strains given) of raw metadata rows."""
    parts, behaviors = parse_list(F.col("body_parts_tracked")), parse_list(F.col("behaviors_labeled"))
    mice = reduce(lambda a, b: a + b, [F.col(f"mouse{i}_strain").isNotNull().cast("int") for i in range(1, 5)])
    return raw.withColumns({"body_parts_tracked": parts, "behaviors_labeled": behaviors, "n_body_parts": F.size(parts), "n_behaviors_labeled": F.size(behaviors), "n_mice": mice})


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A header CSV, one row per video."""
    return with_metadata(spark.read.csv(path, header=True, quote='"', escape='"'))


def load_tracking(spark: SparkSession, path: str, lab: str | None = None, video: str | None = None) -> DataFrame:
    """Long tracking rows below path/lab_id=*/video_id=*; lab and video prune partitions."""
    df = spark.read.schema(TRACKING).parquet(path)
    if lab is not None:
        df = df.where(F.col("lab_id") == lab)
    return df if video is None else df.where(F.col("video_id") == video)


def normalised(tracking: DataFrame, meta: DataFrame, *keys: str) -> DataFrame:
    """x over the arena's width and y over its height; unknown or zero sizes leave NULL. meta is one row per video."""
    m = meta.select(*keys, "video_width_pix", "video_height_pix")
    out = tracking.join(m, list(keys), "left")
    return out.withColumns({"x": F.try_divide("x", "video_width_pix"), "y": F.try_divide("y", "video_height_pix")}).drop("video_width_pix", "video_height_pix")


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path; an empty one of that schema if nothing is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Intervals with their durations; a missing path gives none."""
    return with_duration(or_empty(spark, path, ANNOTATION))


def lab_videos(tracking: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """The videos of each lab with their rows and frames, with metadata where there is some (video ids as text)."""
    v = tracking.groupBy("lab_id", F.col("video_id").cast("string").alias("video_id")).agg(F.count("*").alias("n_rows"), (F.max("video_frame") + 1).alias("n_frames"))
    if meta is None:
        return v
    m = meta.withColumn("video_id", F.col("video_id").cast("string"))
    return v.join(m.drop(*[c for c in m.columns if c in v.columns and c != "video_id"]), "video_id", "left")


def existence(asked: DataFrame, tracking: DataFrame, *keys: str) -> DataFrame:
    """asked with `rows` found and a status: ok, missing, or broken (rows, but no place in any of them). One broken video
    stops no other."""
    n = tracking.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("_known"))
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("_known") == 0, "broken").otherwise("ok")
    return asked.select(*keys).distinct().join(n, list(keys), "left").select(*keys, F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def load_windows(spark: SparkSession, path: str, lab: str | None = None) -> DataFrame:
    """What write_windows wrote; lab prunes partitions."""
    df = spark.read.parquet(path)
    return df if lab is None else df.where(F.col("lab_id") == lab)


def load_pool(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """What write_pool wrote: windows and the facts about them."""
    facts = spark.read.text(f"{path}/facts").first()[0]
    return spark.read.parquet(f"{path}/windows"), json.loads(facts)


def load_config(path: str, section: str | None = None) -> dict:
    """A JSON file of settings, or one section of it."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    return config if section is None else config.get(section, {})


def keyword_arguments(config: dict, names: dict[str, str], defaults: dict | None = None) -> dict:
    """Settings as keyword arguments: names maps dotted paths to arguments; settings that are missing or null take the
    default, if there is one, and are left out otherwise."""
    out = dict(defaults or {})
    for path, name in names.items():
        value = config
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value is not None:
            out[name] = value
    return out


def with_duration(ann: DataFrame) -> DataFrame:
    return ann.withColumn("duration_frames", F.col("stop_frame") - F.col("start_frame"))


def annotated_videos(videos: DataFrame, ann: DataFrame, n: int, lab: str = "lab_id", video: str = "video_id") -> DataFrame:
    """The first n annotated videos of each lab, by id."""
    some = videos.join(ann.select(video).distinct(), video, "left_semi")
    return some.withColumn("rn", F.row_number().over(Window.partitionBy(lab).orderBy(video))).where(F.col("rn") <= n)


def missing(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")
