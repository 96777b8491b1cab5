from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators import loss as LO


def test_tokens_after_the_last_marker(spark):
    texts = {0: "<|user|> a b <|assistant|> c d", 1: "a b", 2: "", 3: "<|assistant|>", 4: "<|assistant|> x <|assistant|> y z"}
    df = spark.createDataFrame([*texts.items()], "id int, text string")
    got = {r["id"]: r["t"] for r in df.select("id", LO.mask_prefix(tokens("text")).alias("t")).collect()}
    assert got == {0: ["c", "d"], 1: ["a", "b"], 2: [], 3: [], 4: ["y", "z"]}


def test_tokens_are_split_once_a_row(spark):
    """Within a lambda the tokens would be split again for every token, in time quadratic in the text."""
    df = spark.createDataFrame([(1, "x " * 10)], "id int, text string")
    plan = df.select(F.size(LO.mask_prefix(tokens("text"))).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
