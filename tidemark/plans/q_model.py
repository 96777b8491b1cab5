"""Queries for the attack model, periodic features and attributions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array  # noqa: F401
from pyspark.sql import functions as F

from tidemark.functions.arrays import vec_dot
from tidemark.operators import attack as AT
from tidemark.operators import metrics as M
from tidemark.operators import named_models as NM
from tidemark.operators import normalize as NZ
from tidemark.operators.folds import train_test_split
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.q_pipeline import EVENTS_SQL, _deltas, _modal_deltas
from tidemark.session import stored

COEFS = AT.loglinear_coefs(4)


def _periodic_sum_sql() -> str:
    terms = [f"cos(2 * pi() * {c!r} * loss_delta) + sin(2 * pi() * {c!r} * loss_delta)" for c in COEFS]
    return " + ".join(terms)


@query(
    "m05_periodic",
    f"WITH {EVENTS_SQL} SELECT sample_id, k, CAST({2 * len(COEFS)} AS BIGINT) AS n_features, "
    f"round({_periodic_sum_sql()}, 6) AS feature_sum FROM el",
)
def m05(spark, sf_dir):
    ev = V.event_losses(spark, sf_dir).withColumn("p", AT.periodic("loss_delta", COEFS))
    return ev.select("sample_id", "k", F.size("p").alias("n_features"),
                     F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("feature_sum"))


@query("m06_train_predict")
def m06(spark, sf_dir):
    """End to end: deltas → assembled features (loss normalised by group) → MLP on the training samples →
    logits of the test samples → sample scores → metrics per dataset."""
    d = stored(_deltas(spark, sf_dir))
    feats = NZ.assemble(d, "BaseLineLossNormSTD", "std", stored(NZ.loss_mean_var(d)))
    split = train_test_split(feats, "sample_id", 0.3)
    dim = 1 + 64
    model = AT.train(split.filter(~F.col("is_test")), dim)
    preds = AT.predict(model, split.filter(F.col("is_test")), ["sample_id", "k", "ds_name", "model_name"])
    scores = M.sample_scores(preds, ["ds_name", "model_name", "sample_id"], "score", "label")
    return M.metrics_table(scores, by=["ds_name"])


def _named(name: str):
    """Deltas with media → features of the variant → fit on the training samples → validation metrics per dataset."""

    def run(spark, sf_dir):
        d = _modal_deltas(spark, sf_dir)
        split = train_test_split(d, "sample_id", 0.3)
        model = NM.train_named(name, split.filter(~F.col("is_test")), modality_dim=64, max_iter=20)
        return NM.validate(model, split.filter(F.col("is_test")))

    run.__doc__ = f"{name}: {_named.__doc__}"
    return run


#: One query for every named variant.
for _query, _name in {
    "m02_baseline": "BaseLine", "m03_modality_all": "ModalityAll",
    "m04_baseline_std": "BaseLineLossNormSTD", "m04_modality_std": "ModalityAllLossNormSTD",
    "m04_baseline_linear": "BaseLineLossNormLinear", "m04_modality_linear": "ModalityAllLossNormLinear",
    "m05_periodic_baseline": "PeriodicBaseLine", "m05_periodic_modality": "PeriodicModalityAll",
}.items():
    query(_query)(_named(_name))


def _network(spark, sf_dir):
    f = V.features(spark, sf_dir)
    return f, AT.train(f, 64, hidden=(32, 16), max_iter=60)


@query("a01b_network_gradients")
def a01b(spark, sf_dir):
    """Integrated gradients through the fitted network (100 nodes); ``gap`` = Σattr − (f(x) − f(0))."""
    f, model = _network(spark, sf_dir)
    return NM.network_attributions(model, f, "vec_id").select("vec_id", "label", "attr_sum", "gap")


@query("a02b_network_smoothgrad")
def a02b(spark, sf_dir):
    """Mean attribution through the network over 250 noisy copies of every row (σ = 0.02), norms of its halves."""
    f, model = _network(spark, sf_dir)
    got = NM.network_attributions(model, f, "vec_id", noise_samples=AT.SMOOTHGRAD_SAMPLES)
    return NM.block_norms(got, {"first": (0, 32), "second": (32, 32)}).drop("attr")


def _linear(spark, sf_dir):
    f = V.features(spark, sf_dir)
    model = AT.fit_linear(f)
    coef = [float(x) for x in model.coefficients.toArray()]  # 64 weights
    return f, model, coef


@query("a01_integrated_gradients")
def a01(spark, sf_dir):
    """Closed-form integrated gradients of a linear attack model; ``gap`` = Σattr − (f(x) − f(0)) ≈ 0."""
    f, model, coef = _linear(spark, sf_dir)
    ig = AT.integrated_gradients_linear(f, coef, label="label")
    w = F.array(*[F.lit(c) for c in coef])
    own = F.when(F.col("label") == 1, 1.0).otherwise(-1.0) * vec_dot("features", w)
    return ig.select("vec_id", "label", "attr_sum", (F.col("attr_sum") - own).alias("gap"))


@query("a02_smoothgrad")
def a02(spark, sf_dir):
    """Mean attribution over seeded noisy copies (250 per row, σ = 0.02)."""
    f, _, coef = _linear(spark, sf_dir)
    sg = AT.smoothgrad_linear(f, coef, "vec_id")
    return AT.attr_norms(sg).select("vec_id", "attr_linf", "attr_l2")


@query("a03_attr_norms")
def a03(spark, sf_dir):
    f, _, coef = _linear(spark, sf_dir)
    return AT.attr_norms(AT.integrated_gradients_linear(f, coef)).select("vec_id", "label", "attr_linf", "attr_l2")


@query("a04_attr_summary")
def a04(spark, sf_dir):
    """Per-label histogram of the attribution 2-norm."""
    f, _, coef = _linear(spark, sf_dir)
    n = AT.attr_norms(AT.integrated_gradients_linear(f, coef))
    return AT.attr_summary(n, "attr_l2", "label", bins=20)


@query("a04b_attr_quantiles")
def a04b(spark, sf_dir):
    """Per-label quantiles of the attribution 2-norm."""
    f, _, coef = _linear(spark, sf_dir)
    return AT.attr_quantiles(AT.attr_norms(AT.integrated_gradients_linear(f, coef)), "attr_l2", "label")
