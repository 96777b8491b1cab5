import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import attack as AT
from tidemark.operators import perceptron as P


@pytest.fixture(scope="module")
def rows(spark):
    """700 rows in five parts, none of them a multiple of a stack."""
    x = F.array(*[F.randn(i) for i in range(6)])
    df = spark.range(700, numPartitions=5).withColumn("x", x)
    return df.select("id", array_to_vector("x").alias("features"), (F.get("x", F.lit(0)) * F.get("x", F.lit(1)) + F.randn(9) > 0).cast("double").alias("label")).cache()


def test_weights_are_those_of_sparks_own_training(rows, tmp_path):
    """Spark's optimiser ends at the same weights, whether it runs out of iterations or converges."""
    for kw in ({"layers": [6, 2], "maxIter": 200}, {"layers": [6, 9, 4, 2], "maxIter": 25}, {"layers": [6, 5, 2], "maxIter": 40, "blockSize": 7}):
        want = MultilayerPerceptronClassifier(seed=7, **kw).fit(rows)
        got = P.Perceptron(seed=7, **kw).fit(rows)
        assert np.allclose(got.weights.toArray(), want.weights.toArray(), atol=1e-5)
        assert got.getMaxIter() == kw["maxIter"] and got.getLayers() == kw["layers"] and not got.isDefined("initialWeights")
        raw = [np.array([list(r[0]) for r in m.transform(rows.limit(5)).select("rawPrediction").collect()]) for m in (got, want)]
        assert np.allclose(*raw, atol=1e-4)


def test_iterations_take_one_matrix_job_and_no_row_of_the_jvm(spark, rows, monkeypatch):
    """Every evaluation is one pass of numpy over packed rows; Spark's own trainer sees a single row."""
    seen, fit = [], MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, df: (seen.append(df.count()), fit(self, df))[1])
    df = rows.select("id", F.col("label").cast("int").alias("label"), F.array(F.col("id") % 7, F.col("id") % 3).cast("array<double>").alias("features"))
    model = AT.train(df, 2, hidden=(4,), max_iter=5)
    assert seen == [1, 1] and model.stages[1].getMaxIter() == 5
    assert np.isfinite(model.stages[1].weights.toArray()).all()


def test_rows_that_cannot_be_trained_on_raise(spark):
    df = spark.createDataFrame([(0.0, [1.0, 2.0]), (2.0, [0.0, 1.0])], "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    with pytest.raises(Exception, match="labels to train on"):
        P.Perceptron(layers=[2, 2], maxIter=2).fit(df)
    with pytest.raises(ValueError, match="no rows"):
        P.Perceptron(layers=[2, 2], maxIter=2).fit(df.limit(0))


def test_gradient_equals_differences():
    rng, sizes = np.random.default_rng(2), [3, 4, 2]
    flat = rng.normal(size=26)
    x, y, share = rng.normal(size=(9, 3)), rng.integers(0, 2, 9), rng.uniform(0.1, 1, 9)

    def cost(w):
        total = np.zeros(26)
        return P.add_gradient(P.unpacked(w, sizes), x, y, share, P.unpacked(total, sizes)), total

    grad, h = cost(flat)[1], 1e-6
    near = [(cost(flat + h * e)[0] - cost(flat - h * e)[0]) / (2 * h) for e in np.eye(26)]
    assert np.allclose(grad, near, atol=1e-6)
