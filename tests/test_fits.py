import threading

from pyspark.ml.functions import vector_to_array

from tidemark.operators import attack as AT
from tidemark.operators import classifiers as CL


def test_fits_run_side_by_side_in_order(spark):
    """Two fits that wait for each other end only if both are running."""
    meet = threading.Barrier(2, timeout=60)

    class Est:
        def __init__(self, name):
            self.name = name

        def fit(self, rows):
            meet.wait()
            return self.name, rows.count()

    assert CL.fit_at_once([(Est("a"), spark.range(3)), (Est("b"), spark.range(5))]) == [("a", 3), ("b", 5)]


def test_many_training_rows_are_dealt_to_all_cores(spark, monkeypatch):
    seen = []

    class Fits:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), sorted((r["y"], tuple(r["x"])) for r in rows.select(
                rows["_y"].alias("y"), vector_to_array("_vec").alias("x")).collect())))
            return None

    monkeypatch.setattr(AT, "attack_pipeline", lambda *a, **k: Fits())
    monkeypatch.setattr(AT, "SPREAD_ROWS", 10)
    df = spark.createDataFrame([(i % 2, [float(i), 1.0]) for i in range(40)], "label int, features array<double>").coalesce(1)
    AT.train(df, 2)
    AT.train(df.limit(5), 2)
    assert seen[0][0] > 1 and seen[1][0] == 1
    assert [len(x) for _, x in seen] == [40, 5]
