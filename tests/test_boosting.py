"""H7: boosted trees against Spark ML's on the same rows, however the rows are dealt; candidates, missing values, ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import boosting
from riskflow.operators.models import model_scores, staged_losses, train_gbt

COLS = ["a", "b", "c"]
SCHEMA = "tie long, a double, b double, c double, y int, split int"


def rows(n: int, seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:, 2] = rng.integers(0, 5, n)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 2) + rng.normal(size=n) * 0.5 > 1.2).astype(int)
    return [(i, *map(float, x[i]), int(y[i]), 0 if i < n * 0.8 else 2) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(3000), SCHEMA).repartition(3).cache()


def by_tie(df) -> list[float]:
    return [r["score"] for r in df.orderBy("tie").collect()]


@pytest.mark.parametrize("local_rows", [0, 100_000])
def test_scores_and_losses_are_those_of_spark_ml(spark, table, monkeypatch, local_rows):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    monkeypatch.setattr(boosting, "LOCAL_ROWS", local_rows)
    model = train_gbt(table, COLS, trees=6, depth=3, rate=0.1)
    pos, n = table.where("split = 0 and y = 1").count(), table.where("split = 0").count()
    data = VectorAssembler(inputCols=COLS, outputCol="features").transform(
        table.withColumn("w", F.when(F.col("y") == 1, (n - pos) / pos).otherwise(1.0)).withColumn("label", F.col("y").cast("double")))
    theirs = GBTClassifier(weightCol="w", maxIter=6, maxDepth=3, stepSize=0.1, seed=42).fit(data.where("split = 0"))
    assert by_tie(model_scores(model, table, COLS)) == pytest.approx(by_tie(model_scores(theirs, table.withColumn("a", F.col("a")), COLS)), abs=1e-9)
    assert staged_losses(model, table, COLS) == pytest.approx(theirs.evaluateEachIteration(data.where("split = 0")), abs=1e-9)


def test_trees_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    """Also where every column comes twice, so that each split has an equal one, and across a checkpoint of the margins."""
    monkeypatch.setattr(boosting, "CHECKPOINT_TREES", 2)
    data = spark.createDataFrame(rows(2000, 1), SCHEMA).withColumn("d", F.col("a"))
    one = train_gbt(data.coalesce(1), [*COLS, "d"], trees=5, depth=4)
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 0)
    monkeypatch.setattr(boosting, "PART_ROWS", 150)
    many = train_gbt(data.repartition(7), [*COLS, "d"], trees=5, depth=4)
    assert (one.feature == many.feature).all() and (one.threshold == many.threshold).all() and 3 not in one.feature
    assert np.allclose(one.leaf, many.leaf, rtol=0, atol=1e-10) and one.leaf.shape == (5, 16)


def test_a_tree_costs_one_job_a_level(spark, table, monkeypatch):
    """The bookkeeping beside the levels does not grow with the trees."""
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 0)

    def jobs(trees: int) -> int:
        group = f"gbt-{trees}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            train_gbt(table, COLS, trees=trees, depth=3)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(6) - jobs(2) == 4 * 3


def test_candidates():
    few = boosting.candidates(np.array([3.0, 1.0, 2.0, 1.0]), np.ones(4), 31)
    assert few.tolist() == [1.5, 2.5]
    many = boosting.candidates(np.arange(1000.0), np.ones(1000), 3)
    assert len(many) == 3 and np.allclose(many, [249.5, 499.5, 749.5])
    heavy = boosting.candidates(np.arange(4.0), np.array([97.0, 1.0, 1.0, 1.0]), 1)
    assert len(heavy) <= 1
    assert boosting.candidates(np.full(5, 2.0), np.ones(5), 31).size == 0


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_missing_values_in_training_are_an_error(spark, bad):
    data = spark.createDataFrame([(i, bad if i == 7 else float(i % 7), 0.0, 1.0, int(i % 4 == 0), 0) for i in range(400)], SCHEMA)
    with pytest.raises(Exception, match="must not be null"):
        train_gbt(data, COLS, trees=3, depth=2)


def test_one_class_and_no_rows(spark, table):
    low = train_gbt(table.withColumn("y", F.lit(0)), COLS, trees=2, depth=2)
    assert (low.leaf[0] == -1).all() and by_tie(model_scores(low, table.limit(5), COLS)) == pytest.approx([1 / (1 + np.exp(2 * -low.leaf[:, 0].sum()))] * 5)
    with pytest.raises(ValueError, match="no rows"):
        train_gbt(table.where("split = 9"), COLS, trees=2)
