"""Dense head trained by mini-batch Adam with early stopping on valid (M3, M8).

A network of GELU layers with dropout and one sigmoid output. Each epoch is one Spark job over *replicas*: replica ``r`` of ``R``
holds the train rows whose position in the order of their hash is ``r`` modulo ``R``, takes its own mini-batches through Adam from
the common weights, and the weights and moments of all replicas are averaged by their numbers of rows (local SGD). ``R`` follows the
table (one replica for each ``replica_rows`` rows), never the cluster: partitions and tasks may be any number, and what a replica
draws (order, dropout) is seeded by its number and the epoch, so the result doesn't depend on them. With one replica this is plain Adam.

A task holds one replica's rows; the driver holds three vectors as long as the weights. Rows are
packed once, stay where they are between epochs, and partitions hold as many replicas each.
A step for each all-reduce of a barrier stage was tried first: Spark's all-gather takes 0.9 s whatever it carries, 750 steps 11 minutes.

Early stopping follows the accuracy on valid after each epoch: ``patience`` epochs without a new best end the training, and the
weights of the best epoch (the first of equals) are the model. Rows with null features or label take no part; an empty train or
valid split is an error. Rows that repeat count as often as they stand. The GELU is its tanh form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenance_spark.operators.chunks import chunks, total_of
from provenance_spark.operators.heads import LABEL, GridPoint, SearchResult
from provenance_spark.operators.positions import with_positions
from provenance_spark.session import cut_lineage, shuffle_partitions

BATCH, DROPOUT, RATE, DECAY, PATIENCE, EPOCHS = 32, 0.1, 1e-3, 0.9, 10, 150
#: Rows of one replica: 16,384 rows of 768 numbers are 100 MB in a task.
REPLICA_ROWS = 1 << 14
#: Adam's constants as published.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7

Layer = tuple[np.ndarray, np.ndarray]


def n_weights(layers: Sequence[int]) -> int:
    return sum((a + 1) * b for a, b in zip(layers, layers[1:]))


def unpack(theta: np.ndarray, layers: Sequence[int]) -> list[Layer]:
    """Views of each layer's matrix and bias in the flat vector ``theta``."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((theta[at:at + a * b].reshape(a, b), theta[at + a * b:at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def initial_weights(layers: Sequence[int], seed: int) -> np.ndarray:
    """He-normal matrices before GELU, Glorot before the output; biases zero."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(n_weights(layers))
    for w, _ in (parts := unpack(theta, layers)):
        w[:] = rng.normal(scale=math.sqrt(2 / (w.shape[0] + (w.shape[1] if w is parts[-1][0] else 0))), size=w.shape)
    return theta


def gelu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes."""
    c = math.sqrt(2 / math.pi)
    t = np.tanh(c * (z + 0.044715 * z ** 3))
    return 0.5 * z * (1 + t), 0.5 * (1 + t) + 0.5 * z * (1 - t * t) * c * (1 + 3 * 0.044715 * z * z)


def probabilities(x: np.ndarray, theta: np.ndarray, layers: Sequence[int]) -> np.ndarray:
    parts = unpack(theta, layers)
    for w, b in parts[:-1]:
        x = gelu(x @ w + b)[0]
    return _sigmoid((x @ parts[-1][0] + parts[-1][1])[:, 0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def gradient(x: np.ndarray, y: np.ndarray, theta: np.ndarray, layers: Sequence[int], masks: Sequence[np.ndarray] = ()) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of a batch and its gradient; ``masks`` scale the outputs of the hidden layers (dropout)."""
    parts = unpack(theta, layers)
    inputs, slopes = [x], []
    for i, (w, b) in enumerate(parts[:-1]):
        h, s = gelu(inputs[-1] @ w + b)
        if masks:
            h, s = h * masks[i], s * masks[i]
        inputs.append(h)
        slopes.append(s)
    z = (inputs[-1] @ parts[-1][0] + parts[-1][1])[:, 0]
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    grad = np.empty_like(theta)
    back = ((_sigmoid(z) - y) / len(y))[:, None]
    for i, (gw, gb) in reversed(list(enumerate(unpack(grad, layers)))):
        gw[:], gb[:] = inputs[i].T @ back, back.sum(0)
        if i:
            back = (back @ parts[i][0].T) * slopes[i - 1]
    return loss, grad


@dataclass
class AdamState:
    """Weights, first and second moments, and the steps taken."""
    theta: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0

    def take(self, grad: np.ndarray, rate: float) -> None:
        self.step += 1
        self.m += (1 - BETA1) * (grad - self.m)
        self.v += (1 - BETA2) * (grad * grad - self.v)
        size = rate * math.sqrt(1 - BETA2 ** self.step) / (1 - BETA1 ** self.step)
        self.theta -= size * self.m / (np.sqrt(self.v) + EPSILON)


def replica_epoch(x: np.ndarray, y: np.ndarray, state: AdamState, layers: Sequence[int], rate: float, decay: float, batch: int,
                  dropout: float, seed: Sequence[int]) -> float:
    """One pass of a replica over its rows in a seeded order; the rate falls by ``decay`` an epoch, smoothly. Returns the summed loss."""
    rng = np.random.default_rng(list(seed))
    order, total = rng.permutation(len(y)), 0.0
    decay_steps = max(1, len(y) // batch)
    for at in range(0, len(y), batch):
        rows = order[at:at + batch]
        masks = [(rng.random((len(rows), n)) >= dropout) / (1 - dropout) for n in layers[1:-1]] if dropout else []
        loss, grad = gradient(x[rows], y[rows], state.theta, layers, masks)
        state.take(grad, rate * decay ** (state.step / decay_steps))
        total += loss * len(rows)
    return total


@dataclass
class DenseModel:
    """A trained network; ``transform`` adds ``probability`` (of both classes) and ``prediction``."""
    layers: tuple[int, ...]
    theta: np.ndarray
    history: list[float] = field(default_factory=list)

    def probability(self, features: Column) -> Column:
        theta, layers = self.theta, self.layers

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for col in batches:
                known = col.notna().to_numpy()
                out = np.full(len(col), np.nan)
                if known.any():
                    out[known] = probabilities(np.stack(col[known].to_numpy()).astype(np.float64), theta, layers)
                yield pd.Series(out).where(pd.Series(known), None)

        return score(features)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        scored = df.withColumn("_p", self.probability(as_array(df, features)))
        return (scored.withColumn("probability", F.when(F.col("_p").isNotNull(), array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))))
                .withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p"))


def as_array(df: DataFrame, col: str) -> Column:
    return F.col(col) if dict(df.dtypes)[col].startswith("array") else vector_to_array(F.col(col))


def model_accuracy(df: DataFrame, model: DenseModel, features: str = "x", label: str = "y") -> float:
    got = df.agg(F.avg(((model.probability(F.col(features)) > 0.5).cast("int") == F.col(label)).cast("double"))).first()[0]
    if got is None:
        raise ValueError("no rows to score: the valid or test split is empty")
    return float(got)


def _rows(df: DataFrame, features: str, label: str) -> DataFrame:
    rows = df.select(as_array(df, features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def replicas(train: DataFrame, replica_rows: int = REPLICA_ROWS) -> tuple[DataFrame, int]:
    """``(x, y, _pos, _replica)``: rows dealt evenly by their position in hash order, equal rows next to each other, and the number of replicas."""
    rows = cut_lineage(with_positions(train.withColumn("_h", F.xxhash64("x", "y")), ["_h"], pos_col="_pos"))
    n = rows.count()
    if not n:
        raise ValueError("no rows to train on")
    r = -(-n // replica_rows)
    dealt = rows.select("x", "y", "_pos", (F.col("_pos") % r).cast("int").alias("_replica"))
    return dealt.repartition(min(r, shuffle_partitions(train.sparkSession)), "_replica"), r


def held(dealt: DataFrame, r: int) -> RDD:
    """``(replica, features, labels)``: each replica's rows in their order as the bytes of two arrays, as many replicas in every partition."""
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        return pd.DataFrame([(key[0], np.stack(pdf["x"].to_numpy()).tobytes(), pdf["y"].to_numpy().tobytes())], columns=["_replica", "x", "y"])

    parts = min(r, shuffle_partitions(dealt.sparkSession))
    blocks = dealt.groupBy("_replica").applyInPandas(pack, "_replica int, x binary, y binary").rdd
    return blocks.map(lambda b: (b[0], (b[1], b[2]))).partitionBy(parts, lambda replica: replica % parts)


def epoch_sum(blocks: RDD, sent: Broadcast, layers: Sequence[int], rate: float, decay: float, batch: int, dropout: float,
              seed: tuple[int, int]) -> np.ndarray:
    """An epoch of every replica from the state ``sent``: sums of weights, moments and steps, each times the replica's rows, then the rows."""
    size = 3 * n_weights(layers) + 2

    def run(part: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        s, total = sent.value, np.zeros(size)
        for replica, (x, y) in part:  # one at a time
            y = np.frombuffer(y)
            mine = AdamState(s.theta.copy(), s.m.copy(), s.v.copy(), s.step)
            replica_epoch(np.frombuffer(x).reshape(len(y), -1), y, mine, layers, rate, decay, batch, dropout, (*seed, int(replica)))
            total += len(y) * np.concatenate([mine.theta, mine.m, mine.v, [mine.step, 1.0]])
        yield from chunks(total)

    return total_of(blocks.mapPartitions(run), size, blocks.getNumPartitions())


def fit(train: DataFrame, valid: DataFrame, hidden: Sequence[int], *, dropout: float = DROPOUT, rate: float = RATE, decay: float = DECAY,
        batch: int = BATCH, patience: int = PATIENCE, epochs: int = EPOCHS, seed: int = 1, replica_rows: int = REPLICA_ROWS,
        features: str = "features", label: str = LABEL) -> DenseModel:
    """The network of the best epoch; ``history`` has the accuracy on valid after each epoch, as many as were run."""
    blocks = held(*replicas(_rows(train, features, label), replica_rows)).persist(StorageLevel.MEMORY_AND_DISK)
    held_out = _rows(valid, features, label).persist()
    sc = train.sparkSession.sparkContext
    try:
        layers = (blocks.map(lambda b: len(b[1][0]) // len(b[1][1])).first(), *hidden, 1)
        theta = initial_weights(layers, seed)
        state, best = AdamState(theta, np.zeros_like(theta), np.zeros_like(theta)), None
        history: list[float] = []
        for epoch in range(epochs):
            sent = sc.broadcast(state)
            vec = epoch_sum(blocks, sent, layers, rate, decay, batch, dropout, (seed, epoch))
            sent.destroy()
            theta, m, v = (vec[:-2] / vec[-1]).reshape(3, -1)
            state = AdamState(theta, m, v, round(vec[-2] / vec[-1]))
            model = DenseModel(layers, theta)
            history.append(model_accuracy(held_out, model))
            if best is None or history[-1] > max(history[:-1]):
                best = model
            elif len(history) - 1 - history.index(max(history)) >= patience:
                break
        best.history = history
        return best
    finally:
        blocks.unpersist()
        held_out.unpersist()


def adam_head(train: DataFrame, valid: DataFrame, test: DataFrame, hidden: Sequence[int] = (64, 64), head: str = "nn",
              features: str = "features", label: str = LABEL, **settings) -> SearchResult:
    """M3 / M8: fit with patience on valid, scored once on test; the point names the epochs run and the best of them."""
    model = fit(train, valid, hidden, features=features, label=label, **settings)
    top = max(model.history)
    param = f"layers={list(hidden)},epochs={len(model.history)},best={model.history.index(top) + 1}"
    return SearchResult(head, [GridPoint(head, param, top, model_accuracy(_rows(test, features, label), model), True)], model)
