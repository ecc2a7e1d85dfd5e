"""Models find a planted rule on rows that they were not fitted on, and nothing where there is none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethogrid.operators import models as M

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(600, 3))
    y = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] > 0, 1, 0))
    got = [(int(i), i % 3, float(y[i]), float(rng.integers(3)), *[None if rng.random() < 0.02 else float(v) for v in x[i]]) for i in range(600)]
    return spark.createDataFrame(got, "id long, fold int, y double, chance double, a double, b double, c double").cache()


def right(df):
    return df.agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]


@pytest.mark.parametrize("make", [lambda: M.forest(10, 6), lambda: M.boosted(5)])
def test_rule_is_found_on_rows_left_out(rows, make):
    got = M.left_out(rows, COLUMNS, "fold", 0, make())
    assert got.count() == 200 and right(got) > 0.85


def test_nothing_is_found_in_chance(rows):
    got = M.left_out(rows.withColumn("y", F.col("chance")), COLUMNS, "fold", 0, M.forest(10, 6))
    assert right(got) < 0.5


def test_machines_and_their_probabilities(rows):
    got = M.calibrated_svm(rows.where("fold <> 0"), rows.where("fold = 0"), COLUMNS, [0.0, 1.0, 2.0], F.col("fold") == 1)
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    assert right(got) > 0.75 and got.agg(F.max(F.abs(total - 1))).first()[0] < 1e-9


def test_what_decides_is_important(rows):
    got = {r.feature: r.importance for r in M.importances(rows, COLUMNS, M.forest(10, 6)).collect()}
    assert got["c"] < 0.15 and got["a"] > 0.25 and got["b"] > 0.25 and sum(got.values()) == pytest.approx(1)


def test_quantiles_of_train_alone(spark):
    train = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    both = spark.createDataFrame([(50.0,), (-5.0,), (500.0,), (None,), (97.5,)], "x double")
    got = [r.x for r in M.quantile_scaled(train, both, ["x"]).collect()]
    assert got[0] == pytest.approx(0, abs=1e-6) and got[1] == pytest.approx(-5.2, abs=0.01) and got[2] == pytest.approx(5.2, abs=0.01) and got[3] is None
    assert got[4] == pytest.approx(1.96, abs=0.01)
