"""Sinks: windows, models' tables, submissions, and results kept by a hash of their parameters."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SUBMISSION = ["row_id", "video_id", "agent_id", "target_id", "action", "start_frame", "stop_frame"]


def write_windows(windows: DataFrame, path: str) -> None:
    windows.write.mode("overwrite").partitionBy("lab_id").parquet(path)


def write_pool(windows: DataFrame, path: str, **facts) -> None:
    """Windows, and facts about them (classes, columns, versions) as one line of JSON."""
    windows.write.mode("overwrite").parquet(f"{path}/windows")
    windows.sparkSession.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def write_report(report: DataFrame, path: str) -> None:
    """A report as CSV, JSON and Parquet, below path."""
    report = written(report, "report")
    report.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
    report.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    report.write.mode("overwrite").parquet(f"{path}/parquet")


def markdown(report: DataFrame, rows: int = 100, digits: int = 3) -> str:
    """A small report as a Markdown table; more than `rows` rows are an error."""
    got = report.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows")
    text = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "/")
    lines = [report.columns, ["-"] * len(report.columns), *[[text(v) for v in r] for r in got]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def write_bundle(model, thresholds: DataFrame, path: str, **facts) -> None:
    """A fitted model with its thresholds (lab_id, cls, t) and facts."""
    model.write().overwrite().save(f"{path}/model")
    write_pool(thresholds, f"{path}/rules", **facts)


def patched(thresholds: DataFrame, changes: DataFrame) -> DataFrame:
    """Thresholds with those of changes in their place; new (lab_id, cls) are added."""
    return thresholds.join(changes, ["lab_id", "cls"], "left_anti").unionByName(changes.select(*thresholds.columns))


def composed(parts: dict[str, DataFrame], choice: DataFrame) -> DataFrame:
    """The thresholds of several bundles put together: each lab's from the bundle that choice (lab_id, bundle) names."""
    every = None
    for name, t in parts.items():
        t = t.withColumn("bundle", F.lit(name))
        every = t if every is None else every.unionByName(t)
    return every.join(choice, ["lab_id", "bundle"], "left_semi")


def parameter_hash(**parameters) -> str:
    """Ten hexadecimal digits that change with any parameter."""
    return hashlib.sha1(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:10]


def fingerprint(tracking: DataFrame) -> DataFrame:
    """Rows, distinct frames and the frame range of a tracking table, in one pass."""
    return tracking.agg(F.count("*").alias("n_rows"), F.count_distinct("video_frame").alias("n_frames"), F.min("video_frame").alias("f_min"), F.max("video_frame").alias("f_max"))


def kept(df_of, path: str, spark, version: int = 1, source: DataFrame | None = None, **parameters) -> DataFrame:
    """The table under path/<hash>, made by df_of() if it isn't there. The hash covers the parameters, the version of the
    algorithm and the fingerprint of source. A marker is written after the table, so that half a table is made again."""
    seen = source and list(fingerprint(source).first())
    where = f"{path}/{parameter_hash(_version=version, _source=seen, **parameters)}"
    if not _there(spark, f"{where}/done"):
        df_of().write.mode("overwrite").parquet(f"{where}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{where}/done")
    return spark.read.parquet(f"{where}/rows")


def _there(spark, path: str) -> bool:
    try:
        return spark.read.schema("id long").parquet(path).count() == 1
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def with_row_ids(submission: DataFrame) -> DataFrame:
    """Gapless row ids in the order of the key. Ids within a partition are counted there; only partition sizes meet. The
    ranged rows are written first, so that both branches see the same partitions, whatever is retried or coalesced."""
    order = ["video_id", "agent_id", "target_id", "start_frame", "stop_frame", "action"]
    ranged = written(submission.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    within = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = within.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = within.join(F.broadcast(before.select("_p", "_before")), "_p")  # one row per partition
    return out.withColumn("row_id", F.col("_before") + F.col("_i") - 1).select(*SUBMISSION)


def checked(submission: DataFrame) -> DataFrame:
    """Counts that must be 0 before a submission is written."""
    return submission.agg(F.count_if(F.col("stop_frame") <= F.col("start_frame")).alias("empty_intervals"), (F.count("*") - F.count_distinct("row_id")).alias("repeated_row_ids"), F.count_if(F.col("action").isNull()).alias("null_actions"))


def write_submission(submission: DataFrame, path: str) -> None:
    bad = checked(submission).first()
    if any(bad):
        raise ValueError(f"not written: {bad.asDict()}")
    submission.select(*SUBMISSION).write.mode("overwrite").csv(path, header=True)
