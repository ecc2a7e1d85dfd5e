"""Huddles and exchanges of a video in one fold: the same as lists of lengths by huddle, without their shuffle."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ethogrid.operators import identity as Id
from ethogrid.sources.adapters import XY

SCHEMA = "video_id long, mouse_id int, video_frame int, " + ", ".join(f"{c} double" for c in XY)


def walks(seed):
    """Three mice of different lengths near each other, frames and places missing here and there, of two videos."""
    rng = random.Random(seed)
    rows = []
    for v in (1, 2):
        for t in range(150):
            for m in (1, 2, 3)[: v + 1]:
                if rng.random() < 0.1:
                    continue
                n, size = (rng.uniform(0, 6), rng.uniform(0, 6)), 4 + 2 * m * rng.random()
                p = [c for k in range(7) for c in (n[0] + size * k / 6, n[1])]
                rows.append((v, m, 3 * t, *[None if rng.random() < 0.02 else c for c in p]))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_is_that_of_the_lists(spark, seed):
    df = spark.createDataFrame(walks(seed), SCHEMA)
    done = Id.crossed_huddles(Id.huddles(df, 0.6), 0.05)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(Id.crossings(df, 0.6, change=0.05)) == rows(done) and done.count() > 2
    frames = df.select("video_id", "video_frame").distinct().withColumn("i", F.row_number().over(Window.partitionBy("video_id").orderBy("video_frame")) - 1)
    flags = done.withColumn("i", F.explode(F.sequence("start", F.col("stop") - 1))).join(frames, ["video_id", "i"])
    want = Id.exchanged(df, flags.select("video_id", "video_frame", "a", "b", F.col("n").alias("order")))
    key = lambda d: sorted(map(repr, map(tuple, d.select(df.columns).collect())))
    assert key(Id.identities_checked(df, 0.6, change=0.05)) == key(want) != key(df)


def test_a_video_is_shuffled_once_for_its_huddles(spark):
    """Each join and list of huddles was a shuffle: 17 times the tables on disk."""
    q = entry.queries()["id_crossed"](spark, "/root/testdata/sf0.001")
    plan = q._jdf.queryExecution().sparkPlan().toString()
    q.collect()
    done = q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by = [x for x in done.split("\n") if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert "collect_list(struct(i" not in plan and len(by) <= 4
