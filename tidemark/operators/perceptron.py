"""Training of Spark ML's multilayer perceptron with matrix products in the tasks.

The model, its objective, start weights and optimiser are those of ``MultilayerPerceptronClassifier``: sigmoid layers,
softmax with cross-entropy, L-BFGS with ten corrections and a strong Wolfe line search. Spark's gradient multiplies
matrices in the JVM without a native library, many times slower than numpy, and sends one gradient for each partition.
Here rows are packed once into matrices, every evaluation is one job over them, and at most one gradient a core leaves
the tasks. The fitted weights go back into Spark's own model, which predicts, is saved and loaded as before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STACKS = 4  # stacks of ``blockSize`` rows that are multiplied at once; changes the time, not the model
DIRECT = 32  # gradients that go to the driver without being added up in tasks first
CORRECTIONS, VALUES, TRIES = 10, 20, 10  # of L-BFGS, as Spark has them


def sigmoid(z: np.ndarray) -> np.ndarray:
    """The logistic function of ``z``, which is overwritten."""
    np.clip(z, -500, 500, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1.0
    return np.reciprocal(z, out=z)


def unpacked(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the weights ``(in, out)`` and biases of each layer in Spark's flat vector."""
    layers, at = [], 0
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        end = at + n_in * n_out
        layers.append((flat[at:end].reshape(n_in, n_out), flat[end : end + n_out]))  # stored by column of the (out, in) matrix
        at = end + n_out
    return layers


def add_gradient(layers: list, x: np.ndarray, y: np.ndarray, share: np.ndarray, into: list) -> float:
    """Add the gradient of the rows' cross-entropy, weighted by ``share``, to ``into``; the weighted cross-entropy."""
    states = [x]
    for k, (w, b) in enumerate(layers):
        z = states[-1] @ w
        z += b
        states.append(sigmoid(z) if k + 1 < len(layers) else z)
    z = states[-1]
    z -= z.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    rows = np.arange(len(x))
    back = np.exp(log_p)
    back[rows, y] -= 1.0
    back *= share[:, None]
    for k in range(len(layers) - 1, -1, -1):
        gw, gb = into[k]
        gw += states[k].T @ back
        gb += back.sum(axis=0)
        if k:
            back = back @ layers[k][0].T
            back *= states[k]
            back *= 1.0 - states[k]
    return float(-(log_p[rows, y] * share).sum())


# --------------------------------------------------------------------------- L-BFGS
class SearchFailed(Exception):
    pass


def _between(left: tuple, right: tuple) -> float:
    """Minimum of the cubic through two points ``(t, value, slope, …)``, kept off both ends; ``left`` has the smaller t."""
    (t0, v0, s0), (t1, v1, s1) = left[:3], right[:3]
    low, high = t0 + 0.1 * (t1 - t0), t0 + 0.9 * (t1 - t0)
    d1 = s0 + s1 - 3 * (v0 - v1) / (t0 - t1)
    root = d1 * d1 - s0 * s1
    d2 = math.sqrt(root) if root >= 0 else math.nan
    below = s1 - s0 + 2 * d2
    t = t1 - (t1 - t0) * (s1 + d2 - d1) / below if below else math.nan
    return low if t < low else high if t > high else t


def _wolfe(at: Callable[[float], tuple], start: tuple, first: float) -> tuple:
    """The point ``(t, value, slope, …)`` of a strong Wolfe search from ``start`` (t = 0), tried at ``first`` first."""
    value, slope = start[1:3]
    if slope > 0:
        raise SearchFailed

    def falls(p: tuple) -> bool:
        return not p[1] > value + 1e-4 * p[0] * slope

    def zoom(low: tuple, high: tuple) -> tuple:
        for _ in range(TRIES):
            p = at(_between(high, low) if low[0] > high[0] else _between(low, high))
            if not falls(p) or p[1] >= low[1]:
                high = p
                continue
            if abs(p[2]) <= 0.9 * abs(slope):
                return p
            if p[2] * (high[0] - low[0]) >= 0:
                high = low
            low = p
        raise SearchFailed

    low, t = start, first
    for i in range(TRIES):
        p = at(t)
        if not math.isfinite(p[1]):
            t /= 2.0
            continue
        if not falls(p) or (p[1] >= low[1] and i > 0):
            return zoom(low, p)
        if abs(p[2]) <= 0.9 * abs(slope):
            return p
        if p[2] >= 0:
            return zoom(p, low)
        low = p
        t *= 1.5
    raise SearchFailed


def _direction(grad: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two-loop recursion; ``history`` has the newest ``(step, change of the gradient)`` first."""
    out, scale, used = grad.copy(), 1.0, []
    if history:
        step, change = history[0]
        scale = step.dot(change) / change.dot(change) if change.any() else math.nan
        if not scale >= 0:
            raise SearchFailed
    for step, change in history:
        rho = step.dot(change)
        a = step.dot(out) / rho if rho else math.nan
        if math.isnan(a):
            raise SearchFailed
        out -= a * change
        used.append((a, rho))
    out *= scale
    for (step, change), (a, rho) in zip(reversed(history), reversed(used)):
        out += (a - change.dot(out) / rho) * step
    return -out


def minimise(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS as Spark's optimiser has it: its steps, its line search and its three tests for the end."""
    value, grad = cost(x)
    first, values, history, done, failed = value, [math.inf], [], 0, False
    while done < max_iter:
        if len(values) >= 2 and abs(value - max(values)) <= tol * abs(first):
            break
        if np.linalg.norm(grad) <= max(tol * abs(value), 1e-8):
            break
        try:
            ahead = _direction(grad, history)

            def at(t: float) -> tuple:
                there = x + ahead * t
                v, g = cost(there)
                return t, v, float(g.dot(ahead)), there, g

            found = _wolfe(at, (0.0, value, float(grad.dot(ahead))), 1.0 / np.linalg.norm(ahead) if done == 0 else 1.0)
            if found[0] * np.linalg.norm(grad) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            failed, history = True, []
            continue
        failed = False
        _, value, _, there, g = found
        history = [(there - x, g - grad), *history][:CORRECTIONS]
        x, grad = there, g
        values = [*values, value][-VALUES:]
        done += 1
    return x


# --------------------------------------------------------------------------- the rows of all tasks
def _packed(rows: DataFrame, stack: int) -> DataFrame:
    """Rows ``(x array<double>, y double)`` as matrices, ``(x, y, share binary, stacks long)``.

    Spark's objective is the mean over stacks of ``stack`` rows of a partition, so a row's share is one by its stack's size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            stacks = -(-len(y) // stack)
            sizes = np.full(stacks, stack)
            sizes[-1] = len(y) - stack * (stacks - 1)
            parts = [x.tobytes(), y.tobytes(), np.repeat(1.0 / sizes, sizes).tobytes()]
            return pa.RecordBatch.from_arrays([*[pa.array([p], pa.binary()) for p in parts], pa.array([stacks], pa.int64())],
                                              names=["x", "y", "share", "stacks"])

        held_x, held_y, held, most = [], [], 0, STACKS * stack
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column(0).null_count or batch.column(1).null_count:
                raise ValueError("a row to train on has no features or no label")
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            if not np.isin(labels, (0.0, 1.0)).all():
                raise ValueError("labels to train on are 0 and 1")
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            held_x.append(x)
            held_y.append(labels.astype(np.int64))
            held += batch.num_rows
            if held >= most:
                x, y = np.concatenate(held_x), np.concatenate(held_y)
                for i in range(0, held - held % most, most):
                    yield block(x[i : i + most], y[i : i + most])
                held %= most
                held_x, held_y = [x[len(x) - held :]], [y[len(y) - held :]]
        if held:
            yield block(np.concatenate(held_x), np.concatenate(held_y))

    return rows.mapInArrow(run, "x binary, y binary, share binary, stacks long")


class Perceptron(MultilayerPerceptronClassifier):
    """Spark's two-class perceptron, trained by :func:`minimise`; everything else is Spark's.

    ``packed`` is called when the rows are packed and the ones given are not read again.
    """

    packed = None

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        sizes = self.getLayers()
        if self.getSolver() != "l-bfgs" or sizes[-1] != 2:
            return super()._fit(dataset)
        spark, cores = dataset.sparkSession, dataset.sparkSession.sparkContext.defaultParallelism
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        blocks = _packed(rows, self.getBlockSize()).rdd.map(tuple)
        blocks = blocks.coalesce(max(1, min(blocks.getNumPartitions(), cores))).persist(StorageLevel.MEMORY_AND_DISK)
        depth = 1 if blocks.getNumPartitions() <= DIRECT else 2
        try:
            stacks = blocks.map(lambda b: b[3]).sum()
            if not stacks:
                raise ValueError("no rows to train on")
            if self.packed is not None:
                self.packed()

            def cost(flat: np.ndarray) -> tuple[float, np.ndarray]:
                sent = spark.sparkContext.broadcast(flat)

                def part(held: Iterator[tuple]) -> Iterator[np.ndarray]:
                    layers, total = unpacked(sent.value, sizes), np.zeros(len(sent.value) + 1)
                    into, some = unpacked(total[:-1], sizes), False
                    for x, y, share, _ in held:
                        total[-1] += add_gradient(layers, np.frombuffer(x).reshape(-1, sizes[0]), np.frombuffer(y, np.int64), np.frombuffer(share), into)
                        some = True
                    if some:
                        yield total

                total = blocks.mapPartitions(part).treeReduce(np.add, depth) / stacks
                sent.destroy()
                return float(total[-1]), total[:-1]

            start = self._with(spark, 0, None)
            fitted = minimise(cost, start.weights.toArray(), self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        return self._with(spark, self.getMaxIter(), fitted)

    def _with(self, spark, max_iter: int, weights: np.ndarray | None) -> MultilayerPerceptronClassificationModel:
        """Spark's model with the start weights of the seed, or with those given: a fit without an iteration on one row."""
        extra = {self.maxIter: 0}
        if weights is None and self.isDefined(self.initialWeights):
            weights = self.getInitialWeights().toArray()
        if weights is not None:
            extra[self.initialWeights] = Vectors.dense(weights)
        row = spark.createDataFrame([(Vectors.dense(np.zeros(self.getLayers()[0])), 0.0)], [self.getFeaturesCol(), self.getLabelCol()])
        model = super(Perceptron, self.copy(extra))._fit(row)
        for one in (model, model._java_obj):  # the weights are the model's own; as a parameter they would be saved once more
            name = "initialWeights"
            if not self.isDefined(self.initialWeights):
                one.clear(one.getParam(name))
        model._set(maxIter=max_iter)
        model._transfer_params_to_java()
        return model
