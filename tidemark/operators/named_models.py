"""Attack models by name, with validation, saving and attributions through the network.

A variant says which loss normalisation, which blocks of features and which loss encoding a model takes; statistics
for the normalisation come from its training rows and travel with it. A saved model is a folder with the fitted Spark
ML pipeline, the statistics and the variant. Attributions read the layer weights from the fitted pipeline once, send
them to the tasks (their size is that of the architecture) and run batched forward and reverse passes there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.arrays import l2_norm, linf_norm, softmax
from tidemark.operators import attack as AT
from tidemark.operators import metrics as M
from tidemark.operators import normalize as NZ
from tidemark.operators.perceptron import sigmoid, unpacked
from tidemark.session import spread, stored


@dataclass(frozen=True)
class Variant:
    """``sigmas``: none, std or linear; ``modality``: whether a media delta is among the features; ``periodic``: loss encoding."""

    name: str
    sigmas: str = "none"
    modality: bool = False
    periodic: bool = False


VARIANTS: dict[str, Variant] = {name: Variant(name, **spec) for name, spec in AT.MODELS.items()}


def register(variant: Variant) -> Variant:
    """Add a variant under its name; the name of a variant without the media block holds "baseline"."""
    if variant.modality == ("baseline" in variant.name.lower()):
        raise ValueError(f"{variant.name}: exactly the variants without a media block are baselines by name")
    VARIANTS[variant.name] = variant
    return variant


def variant(name: str) -> Variant:
    if name not in VARIANTS:
        raise ValueError(f"unknown model {name}; known are {', '.join(sorted(VARIANTS))}")
    return VARIANTS[name]


def _stats(df: DataFrame, sigmas: str) -> DataFrame | None:
    return {"none": lambda d: None, "std": NZ.loss_mean_var, "linear": NZ.loss_min_range}[sigmas](df)


class NamedAttack:
    """A fitted variant: features from delta rows, logits, saving and loading."""

    def __init__(self, spec: Variant, pipeline: PipelineModel, stats: DataFrame | None, modality_dim: int, coefs: Sequence[float]):
        self.spec, self.pipeline, self.stats, self.modality_dim, self.coefs = spec, pipeline, stats, modality_dim, list(coefs)

    def features(self, df: DataFrame) -> DataFrame:
        """Delta rows with the ``features`` of this variant; a row without a media delta gets zeros for it."""
        out = NZ.assemble(df, self.spec.name, self.spec.sigmas, self.stats, modality_dim=self.modality_dim)
        if self.spec.periodic:
            rest = F.slice("features", 2, F.size("features") - 1)
            out = out.withColumn("features", F.concat(AT.periodic("loss_feature", self.coefs), rest))
        return out

    def predict(self, df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
        """``(keys…, label, score array<double>)``, the two logits of every row."""
        return AT.predict(self.pipeline, self.features(df), keys, label=label)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        told = {"variant": asdict(self.spec), "modality_dim": self.modality_dim, "coefs": self.coefs}
        spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode("overwrite").text(f"{path}/variant")
        if self.stats is not None:
            self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NamedAttack:
        told = json.loads(spark.read.text(f"{path}/variant").first().value)
        spec = Variant(**told["variant"])
        stats = None if spec.sigmas == "none" else spark.read.parquet(f"{path}/stats")
        return cls(spec, PipelineModel.load(f"{path}/pipeline"), stats, told["modality_dim"], told["coefs"])


def train_named(name: str, df: DataFrame, modality_dim: int = 0, n_coefs: int = 4, label: str = "label", **kw) -> NamedAttack:
    """Fit the variant ``name`` on delta rows ``(loss_delta, embedding_delta, <media>_delta, …)``.

    Statistics for the loss are those of ``df``. ``kw`` goes to :func:`attack.attack_pipeline` (hidden sizes, iterations).
    """
    spec = variant(name)
    stats = _stats(df, spec.sigmas)
    # taken once; a stored table's size is known, so a small one is joined without shuffling the rows
    model = NamedAttack(spec, None, None if stats is None else stored(stats), modality_dim, AT.loglinear_coefs(n_coefs))
    rows = model.features(df)
    width = rows.select(F.size("features").alias("n")).first()
    if width is None:
        raise ValueError("no rows to train on")
    model.pipeline = AT.train(rows, width.n, label=label, **kw)
    return model


def log_loss(preds: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """M06 validation: mean cross-entropy of the logits ``score``, ``(by…, log_loss, n)``."""
    top = F.array_max("score")
    spread = F.log(F.aggregate(F.transform("score", lambda s: F.exp(s - top)), F.lit(0.0), lambda a, x: a + x))
    cost = top + spread - F.get("score", F.col(label).cast("int"))
    return preds.groupBy(*by).agg(F.avg(cost).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def validate(model: NamedAttack, df: DataFrame, by: Sequence[str] = ("ds_name",), sample: Sequence[str] = ("ds_name", "model_name", "sample_id")) -> DataFrame:
    """Metrics of the sample scores and the cross-entropy of the rows of a validation table, per ``by``."""
    preds = stored(model.predict(df, [*sample, "k"]))  # both summaries read them
    scores = M.sample_scores(preds, list(sample), "score", "label")
    return M.metrics_table(scores, by=list(by)).join(log_loss(preds, by).drop("n"), list(by))


# --------------------------------------------------------------------------- A01, A02 through the network
class Network:
    """The layers of a fitted pipeline: a scaler, then sigmoid layers, then two logits."""

    def __init__(self, pipeline: PipelineModel):
        scaler, mlp = pipeline.stages
        std = scaler.std.toArray()
        self.mean, self.scale = scaler.mean.toArray(), np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0)
        self.layers = unpacked(mlp.weights.toArray(), list(mlp.getLayers()))

    def _states(self, x: np.ndarray) -> list[np.ndarray]:
        states = [(x - self.mean) * self.scale]
        for k, (w, b) in enumerate(self.layers):
            z = states[-1] @ w + b
            states.append(z if k + 1 == len(self.layers) else sigmoid(z))
        return states

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._states(x)[-1]

    def gradient(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Derivative of each row's ``target`` logit by its features."""
        states = self._states(x)
        back = self.layers[-1][0].T[target]
        for (w, _), state in zip(self.layers[-2::-1], states[-2:0:-1]):
            back = (back * state * (1.0 - state)) @ w.T
        return back * self.scale

    def integrated(self, x: np.ndarray, target: np.ndarray, steps: int, rows: int = 64) -> np.ndarray:
        """Path integral from zero to each row, by Gauss–Legendre nodes; sums to the difference of the logits.

        The first layer is linear along the path and its transpose in the sum over the nodes, so both run once a row.
        """
        (first, bias), rest = self.layers[0], self.layers[1:]
        if not rest:
            return x * (first.T[target] * self.scale)
        node, weight = np.polynomial.legendre.leggauss(steps)
        node, weight = (node + 1) / 2, weight / 2
        start = bias - (self.mean * self.scale) @ first
        out = np.empty_like(x)
        for i in range(0, len(x), rows):
            part = x[i : i + rows]
            along = (part * self.scale) @ first
            z = (node[:, None, None] * along + start).reshape(-1, first.shape[1])
            states = [sigmoid(z)]
            for w, b in rest[:-1]:
                states.append(sigmoid(states[-1] @ w + b))
            back = np.tile(rest[-1][0].T[target[i : i + rows]], (steps, 1))
            for k in range(len(states) - 1, -1, -1):
                state = states[k]
                back = back * state * (1.0 - state)
                if k:
                    back = back @ rest[k - 1][0].T
            total = np.tensordot(weight, back.reshape(steps, len(part), -1), 1)
            out[i : i + rows] = part * ((total @ first.T) * self.scale)
        return out


def network_attributions(model: PipelineModel, df: DataFrame, id_col: str, features: str = "features", label: str = "label", steps: int = 100,
                         noise_samples: int = 0, sigma: float = AT.SMOOTHGRAD_SIGMA, seed: int = 42) -> DataFrame:
    """``(id, label, attr array<double>, attr_sum, gap)`` of the logit of the row's own class, baseline zero.

    ``gap`` is the sum of the attributions less the difference of the logits at the row and at zero. With
    ``noise_samples`` the attribution is the mean over so many copies with seeded Gaussian noise (the same for equal ids
    in every run); ``gap`` is then that of the mean. Rows without features give null arrays.
    """
    sent = df.sparkSession.sparkContext.broadcast(Network(model))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = sent.value
        for batch in batches:
            has = batch["x"].notna().to_numpy()
            part = batch[has]
            attr, sums, gaps = [None] * len(batch), np.full(len(batch), np.nan), np.full(len(batch), np.nan)
            if len(part):
                x = np.stack(part["x"].to_numpy()).astype(float)
                target = part["label"].to_numpy().astype(int)
                if noise_samples:
                    found, ends = np.zeros_like(x), np.zeros(len(x))
                    for k, key in enumerate(part["id"].tolist()):
                        rng = np.random.default_rng([seed, 0 if key is None else int(key) & (2**63 - 1)])
                        copies = x[k] + sigma * rng.standard_normal((noise_samples, x.shape[1]))
                        own = np.full(noise_samples, target[k])
                        found[k] = net.integrated(copies, own, steps).mean(axis=0)
                        ends[k] = net.logits(copies)[:, target[k]].mean()
                else:
                    found, ends = net.integrated(x, target, steps), net.logits(x)[np.arange(len(x)), target]
                start = net.logits(np.zeros((1, x.shape[1])))[0][target]
                sums[has] = found.sum(axis=1)
                gaps[has] = sums[has] - (ends - start)
                for i, row in zip(np.flatnonzero(has), found):
                    attr[i] = row
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "attr": attr, "attr_sum": sums, "gap": gaps})

    rows = df.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"), F.col(features).alias("x"))
    out = spread(rows).mapInPandas(run, f"id {kind}, label int, attr array<double>, attr_sum double, gap double")
    return out.withColumnRenamed("id", id_col)


def block_norms(df: DataFrame, blocks: dict[str, tuple[int, int]], attr: str = "attr") -> DataFrame:
    """A03 by block: the ∞-norm and 2-norm of ``attr[start : start + size]`` for every named block."""
    out = df
    for name, (start, size) in blocks.items():
        part = F.slice(attr, start + 1, size)
        out = out.withColumn(f"{name}_linf", linf_norm(part)).withColumn(f"{name}_l2", l2_norm(part))
    return out


def probabilities(preds: DataFrame) -> DataFrame:
    """The class probabilities of predicted logits, ``proba array<double>``."""
    return preds.withColumn("proba", softmax("score"))
