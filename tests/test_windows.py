"""Window counts, smoothing against numpy, and label rules."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ethogrid.functions import signal as S
from ethogrid.operators import windows as W


@pytest.mark.parametrize("stride, n", [(16, 357), (32, 179)])
def test_window_counts(spark, stride, n):
    rows = spark.range(5760).select(F.lit(1).alias("k"), F.col("id").alias("video_frame"))
    assert W.spans(rows, ["k"], 64, stride).count() == n


def test_savgol_matches_polynomial_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").withColumn("k", F.lit(1))
    got = np.array([r.s for r in df.select("i", S.savgol("x", Window.partitionBy("k").orderBy("i")).alias("s")).orderBy("i").collect()])
    padded = np.r_[[x[0]] * 4, x, [x[-1]] * 4]
    want = [np.polyval(np.polyfit(np.arange(-4, 5), padded[i : i + 9], 3), 0) for i in range(40)]
    assert np.allclose(got, want, atol=1e-9)


def test_labels_ignore_background_on_request(spark):
    rows = [(1, "background")] * 3 + [(1, "b")] * 2 + [(1, "a")] * 2 + [(2, "background")]
    df = spark.createDataFrame(rows, "win int, label string")
    assert {r.win: r.y for r in W.window_labels(df, ["win"]).collect()} == {1: "a", 2: "background"}
    assert {r.win: r.y for r in W.window_labels(df, ["win"], ignore_background=False).collect()} == {1: "background", 2: "background"}


def test_temporal_split_purges(spark):
    rows = spark.range(100).select(F.lit(1).alias("k"), F.col("id"))
    got = {p: sorted(r.id for r in W.temporal_split(rows, ["k"], "id", 0.2, 0.2, 5).where(F.col("part") == p).collect()) for p in ("train", "val", "test")}
    assert (got["train"], got["val"], got["test"]) == (list(range(55)), list(range(65, 75)), list(range(85, 100)))
