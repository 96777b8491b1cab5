"""Attack model, scoring and attribution.

The attack network is a Spark ML pipeline: standardise the assembled delta
features, then a multilayer perceptron with the reference's hidden sizes
(the reference's two input branches are fused into one input layer). Raw
predictions are the two logits that the R-operators turn into sample scores.
Attribution uses a linear attack model, whose integrated gradients from a
zero baseline have the closed form ``x · w`` (exact completeness), computed
with native array functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import l2_norm, linf_norm
from tidemark.operators.perceptron import Perceptron
from tidemark.session import spread

# Hidden layer sizes and named architectures of the reference.
HIDDEN = (512, 256, 128, 64, 32)
MODELS = {
    "BaseLine": {"sigmas": "none", "modality": False, "periodic": False},
    "ModalityAll": {"sigmas": "none", "modality": True, "periodic": False},
    "BaseLineLossNormSTD": {"sigmas": "std", "modality": False, "periodic": False},
    "ModalityAllLossNormSTD": {"sigmas": "std", "modality": True, "periodic": False},
    "BaseLineLossNormLinear": {"sigmas": "linear", "modality": False, "periodic": False},
    "ModalityAllLossNormLinear": {"sigmas": "linear", "modality": True, "periodic": False},
    "PeriodicBaseLine": {"sigmas": "none", "modality": False, "periodic": True},
    "PeriodicModalityAll": {"sigmas": "none", "modality": True, "periodic": True},
}
SPREAD_ROWS = 10_000
SMOOTHGRAD_SAMPLES = 250
SMOOTHGRAD_SIGMA = 0.02


# --------------------------------------------------------------------------- M05
def loglinear_coefs(n: int) -> list[float]:
    """Deterministic periodic coefficients ``10^(i/n)``, i = 0…n−1."""
    return [10.0 ** (i / n) for i in range(n)]


def periodic(x: Column | str, coefs: Sequence[float]) -> Column:
    """``[cos(2π c x)…, sin(2π c x)…]`` of a scalar loss."""
    xc = F.col(x) if isinstance(x, str) else x
    arr = F.array(*[F.lit(float(c)) for c in coefs])
    cos = F.transform(arr, lambda c: F.cos(2.0 * math.pi * c * xc))
    sin = F.transform(arr, lambda c: F.sin(2.0 * math.pi * c * xc))
    return F.concat(cos, sin)


# --------------------------------------------------------------------------- M02–M04, M06
def attack_pipeline(input_dim: int, hidden: Sequence[int] = HIDDEN, max_iter: int = 100, seed: int = 42,
                    features: str = "features", label: str = "label", packed: Callable | None = None) -> Pipeline:
    """Scaler + MLP ``[input_dim, *hidden, 2]``; ``packed`` is called when the MLP has its own copy of the rows."""
    scaler = StandardScaler(inputCol="_vec", outputCol="_scaled", withMean=True, withStd=True)
    mlp = Perceptron(featuresCol="_scaled", labelCol="_y", layers=[input_dim, *hidden, 2], maxIter=max_iter, seed=seed,
                     rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred")
    mlp.packed = packed
    return Pipeline(stages=[scaler, mlp])


def _ml_in(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.withColumn("_vec", array_to_vector(F.col(features))).withColumn("_y", F.col(label).cast("double"))


def train(df: DataFrame, input_dim: int, features: str = "features", label: str = "label",
          path: str | None = None, **kw) -> PipelineModel:
    """Fit the attack pipeline; optionally save it (reload with ``PipelineModel.load``).

    Every iteration costs much time a row, so more than ``SPREAD_ROWS`` rows are dealt to all cores first, once for all
    stages of the pipeline. They are let go when they are packed for the iterations.
    """
    rows = _ml_in(df, features, label).select("_vec", "_y")
    many = rows.count() > SPREAD_ROWS
    if many:
        rows = spread(rows).persist()
    model = attack_pipeline(input_dim, packed=rows.unpersist if many else None, **kw).fit(rows)
    if path:
        model.write().overwrite().save(path)
    return model


def predict(model: PipelineModel, df: DataFrame, keys: Sequence[str], features: str = "features",
            label: str = "label") -> DataFrame:
    """``(keys…, label, score array<double>)`` with the two logits."""
    out = model.transform(_ml_in(df, features, label))
    return out.select(*keys, label, vector_to_array(F.col("_raw")).alias("score"))


# --------------------------------------------------------------------------- A01–A04
def fit_linear(df: DataFrame, features: str = "features", label: str = "label"):
    """Linear attack model (logistic regression) used for exact attributions."""
    return LogisticRegression(featuresCol="_vec", labelCol="_y", maxIter=100).fit(_ml_in(df, features, label))


def _toward(label: str | None) -> Column:
    """The sign of the class-1 logit in the logit of the row's own class."""
    return F.lit(1.0) if label is None else F.when(F.col(label) == 1, 1.0).otherwise(-1.0)


def integrated_gradients_linear(df: DataFrame, coef: Sequence[float], features: str = "features",
                                label: str | None = None) -> DataFrame:
    """Per-feature attribution ``x_i · w_i`` (zero baseline); ``attr_sum`` = f(x) − f(0).

    With ``label`` f is the logit of the row's own class, else that of class 1.
    """
    w = F.array(*[F.lit(float(c)) for c in coef])
    attr = F.zip_with(F.col(features), w, lambda x, c: x * c * _toward(label))
    return df.withColumn("attr", attr).withColumn(
        "attr_sum", F.aggregate(F.col("attr"), F.lit(0.0), lambda a, v: a + v))


def smoothgrad_linear(df: DataFrame, coef: Sequence[float], id_col: str, samples: int = SMOOTHGRAD_SAMPLES,
                      sigma: float = SMOOTHGRAD_SIGMA, seed: int = 42, features: str = "features") -> DataFrame:
    """Mean attribution over ``samples`` noisy copies (seeded Gaussian noise) of every row.

    A linear attribution of a noisy copy is ``(x + σ·e) · w``, so the mean is that of the noise, no copies are made. The
    noise hangs on the id and the place only: it is drawn once for each id, a row for each draw, and joined back.
    """
    w = F.array(*[F.lit(float(c)) for c in coef])
    ids = spread(df.select(F.col(id_col).alias("_id"), F.size(features).alias("_n")), "_id").groupBy("_id").agg(F.max("_n").alias("_n"))
    places = ids.filter(F.col("_n") > 0).select("_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    draws = places.select("_id", "_i", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("_s"))
    mean = draws.groupBy("_id", "_i").agg((F.sum(_gauss(F.col("_id"), F.col("_s"), F.col("_i"), seed)) / samples).alias("_e"))
    noise = mean.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_i", "_e"))).alias("_noise"))
    rows = df.select(id_col, F.col(features).alias("_x")).join(noise, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    noisy = F.transform("_x", lambda x, i: x + sigma * F.get(F.col("_noise"), i)["_e"])
    return rows.select(id_col, F.zip_with(noisy, w, lambda x, c: x * c).alias("attr"))


def _gauss(id_col: Column, s: Column, i: Column, seed: int) -> Column:
    """Deterministic standard normal from a hash (Box–Muller on two md5-derived uniforms)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), id_col.cast("string"), s.cast("string"), i.cast("string")))
    u1 = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 1.0) / 4294967297.0
    u2 = F.conv(F.substring(h, 9, 8), 16, 10).cast("double") / 4294967296.0
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def attr_norms(df: DataFrame, attr: str = "attr") -> DataFrame:
    """∞-norm and 2-norm of attribution vectors."""
    return df.withColumn("attr_linf", linf_norm(attr)).withColumn("attr_l2", l2_norm(attr))


def attr_quantiles(df: DataFrame, value: str, label: str = "label",
                   probabilities: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Per-label exact quantiles (linear between neighbours) of a scalar attribution, ``(label, q, value)``."""
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    got = df.groupBy(label).agg(F.percentile(F.col(value), ps).alias("v"))
    return got.select(label, F.inline(F.arrays_zip(ps.alias("q"), F.col("v").alias("value"))))


def attr_summary(df: DataFrame, value: str, label: str = "label", bins: int = 20, lo: float | None = None,
                 hi: float | None = None) -> DataFrame:
    """Per-label histogram of a scalar attribution (equal-width bins over [lo, hi])."""
    if lo is None or hi is None:
        r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()  # one row
        lo, hi = float(r["lo"]), float(r["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return df.groupBy(label, b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "bin_start", F.lit(lo) + F.col("bin") * F.lit(width))
