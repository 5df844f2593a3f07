"""The two dense networks, fitted on all rows and applied in batches.

A task runs mini-batch Adam on ``ROWS_PER_PIECE`` rows at most.  More rows are fitted in pieces side by side, whose weights
are averaged after each epoch.  Scoring covers all rows, too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.operators.series import number_by_sort
from tapewatch.session import cut, ship_package

# Layer widths, dropout, batch size, patience, learning rates.
AUTOENCODER = (20, 20, 10, 20, 20)
AUTOENCODER_DROPOUT = (0.2, 0.0, 0.2)
CLASSIFIER = (20, 128, 64, 32, 16, 1)
CLASSIFIER_DROPOUT = (0.3, 0.3, 0.2, 0.2)
BATCH = 64
RATE, RATE_FACTOR = 0.001, 0.2
AUTOENCODER_PATIENCE, AUTOENCODER_RATE_PATIENCE, AUTOENCODER_MIN_RATE = 15, 7, 0.0001
CLASSIFIER_PATIENCE, CLASSIFIER_RATE_PATIENCE, CLASSIFIER_MIN_RATE = 20, 10, 0.00001


# Rows that one task fits or holds against at most; of more, pieces are fitted side by side.
ROWS_PER_PIECE = 100_000
# Rows that go through a network at once where losses are summed up.
STRIPE = 8_192


@dataclass(frozen=True)
class Network:
    """Dense layers with ReLU between them; ``head`` is 'mse' or 'bce'."""

    widths: tuple[int, ...]
    head: str
    flat: np.ndarray

    @staticmethod
    def fresh(widths: tuple[int, ...], head: str, seed: int = 42) -> "Network":
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(widths, widths[1:]):
            limit = np.sqrt(6 / (a + b))
            parts += [rng.uniform(-limit, limit, a * b), np.zeros(b)]
        return Network(widths, head, np.concatenate(parts))

    @staticmethod
    def from_layers(head: str, layers) -> "Network":
        widths = (layers[0][0][0], *[shape[1] for shape, _, _ in layers])
        return Network(tuple(widths), head, np.concatenate([np.concatenate([w, b]) for _, w, b in layers]))

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.widths, self.widths[1:]):
            out.append((self.flat[at:at + a * b].reshape(a, b), self.flat[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        layers = self.layers()
        for weight, bias in layers[:-1]:
            x = np.maximum(x @ weight + bias, 0.0)
        x = x @ layers[-1][0] + layers[-1][1]
        return 1 / (1 + np.exp(-np.clip(x, -500, 500))) if self.head == "bce" else x

    def loss(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Loss per row."""
        out = self.forward(x)
        if self.head == "mse":
            return ((out - y) ** 2).mean(axis=1)
        p = np.clip(out, 1e-7, 1 - 1e-7)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p))[:, 0]

    def gradient(self, x, y, weight, dropout, rng) -> np.ndarray:
        """Gradient of the weighted mean loss, with inverted dropout."""
        layers, inputs, masks = self.layers(), [x], []
        for i, (w, b) in enumerate(layers[:-1]):
            hidden = np.maximum(inputs[-1] @ w + b, 0.0)
            rate = dropout[i] if i < len(dropout) else 0.0
            mask = (rng.random(hidden.shape) >= rate) / (1 - rate) if rate else 1.0
            masks.append((hidden > 0) * mask)
            inputs.append(hidden * mask)
        out = inputs[-1] @ layers[-1][0] + layers[-1][1]
        if self.head == "bce":
            delta = 1 / (1 + np.exp(-np.clip(out, -500, 500))) - y
        else:
            delta = 2 * (out - y) / y.shape[1]
        delta = delta * weight[:, None] / len(x)
        parts = []
        for i in range(len(layers) - 1, -1, -1):
            parts = [(inputs[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
            if i:
                delta = (delta @ layers[i][0].T) * masks[i - 1]
        return np.concatenate(parts)


def _descend(network: Network, x, y, w, rate: float, dropout, state: tuple, rng) -> tuple[Network, tuple]:
    """One epoch of mini-batch Adam; ``state`` holds both moments and the step."""
    flat, (first, second, step) = network.flat.copy(), state
    order = rng.permutation(len(x))
    for at in range(0, len(x), BATCH):
        pick = order[at:at + BATCH]
        step += 1
        g = Network(network.widths, network.head, flat).gradient(x[pick], y[pick], w[pick], dropout, rng)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        flat = flat - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-7)
    return Network(network.widths, network.head, flat), (first, second, step)


def _course(network: Network, epoch: Callable, held_loss: Callable[[Network], float], epochs: int, patience: int, rate_patience: int,
            min_rate: float, rate: float) -> tuple[Network, list[float]]:
    """Epochs until the held rows stop gaining; the best weights and the losses.

    ``epoch`` makes the next network and state (both moments and the step) of a network, its state, the rate and the epoch's number.
    """
    zeros = np.zeros_like(network.flat)
    state, best, best_loss, waited, stalled, history = (zeros, zeros, 0), network, float("inf"), 0, 0, []
    for at in range(epochs):
        network, state = epoch(network, state, rate, at)
        loss = held_loss(network)
        history.append(loss)
        if loss < best_loss:
            best, best_loss, waited, stalled = network, loss, 0, 0
            continue
        waited, stalled = waited + 1, stalled + 1
        if stalled >= rate_patience:
            rate, stalled = max(rate * RATE_FACTOR, min_rate), 0
        if waited >= patience:
            break
    return best, history


def fit(
    network: Network, train: DataFrame, held: DataFrame, epochs: int, dropout=(),
    patience: int = 15, rate_patience: int = 7, min_rate: float = 0.0001, rate: float = RATE,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> tuple[Network, list[float]]:
    """Fit on all rows (x, y, w); stops early, by the loss over all held rows, and keeps the best weights.

    Up to ``rows_per_piece`` rows of either kind are fitted by one task, which runs all epochs.  More of them lie in pieces of
    equal size: in each epoch every piece goes on from the same weights and moments in a task of its own, and the next ones are
    the mean over the pieces, by their rows.  Rows are dealt and ordered by a hash of their values, so the result depends
    neither on the partitions nor on the order of the input.  No rows of either kind is an error.
    """
    ship_package(train.sparkSession)
    train, held = (rows.select("x", "y", "w", F.xxhash64("x", "y").alias("key")) for rows in (train, held))
    sizes = train.count(), held.count()
    for n, kind in zip(sizes, ("no training rows to fit on", "no validation rows to fit with"), strict=True):
        if not n:
            raise ValueError(kind)
    rules = (epochs, patience, rate_patience, min_rate, rate)
    if max(sizes) <= rows_per_piece:
        return _fit_in_one_task(network, train, held, dropout, rules)
    pieces = [_pieces(rows, n, rows_per_piece) for rows, n in zip((train, held), sizes, strict=True)]
    return _course(network, _epoch_over(pieces[0], dropout), _loss_over(pieces[1]), *rules)


def _fit_in_one_task(network: Network, train: DataFrame, held: DataFrame, dropout, rules: tuple) -> tuple[Network, list[float]]:
    both = train.withColumn("held", F.lit(False)).union(held.withColumn("held", F.lit(True)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["held", "key", "w"], ignore_index=True)
        parts = []
        for which in (False, True):
            some = frame[frame["held"] == which]
            x = np.stack(some["x"].to_numpy())
            y = x if network.head == "mse" else some["y"].to_numpy(dtype=float)[:, None]
            parts.append((x, y, some["w"].to_numpy(dtype=float)))
        rng, (x, y, _) = np.random.default_rng(1000), parts[1]
        best, history = _course(
            network, lambda now, state, rate, at: _descend(now, *parts[0], rate, dropout, state, rng),
            lambda now: float(now.loss(x, y).mean()), *rules)
        return pd.DataFrame({"flat": [best.flat.tolist()], "history": [history]})

    found = both.groupBy().applyInPandas(run, "flat array<double>, history array<double>").head()
    return Network(network.widths, network.head, np.array(found.flat)), list(found.history)


def _pieces(rows: DataFrame, n: int, rows_per_piece: int) -> DataFrame:
    """The ``n`` rows (x, y, w, key) as piece, rn, x, y, w, in the order of their key, written out; each piece is a partition."""
    count = -(-n // rows_per_piece)
    numbered = number_by_sort(rows, [], ["key", "w"])
    piece = F.floor((F.col("rn") - 1) / -(-n // count)).cast("int")
    return cut(numbered.select(piece.alias("piece"), "rn", "x", "y", "w").repartitionById(count, "piece").sortWithinPartitions("rn"))


def _piece(batches: Iterator[pa.RecordBatch], head: str) -> tuple[int, tuple] | None:
    """The number of a task's piece and its x, y, w."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if not table:
        return None
    x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
    y = x if head == "mse" else table["y"].to_numpy()[:, None]
    return table["piece"][0].as_py(), (x, y, table["w"].to_numpy())


def _epoch_over(pieces: DataFrame, dropout) -> Callable:
    """An epoch in which each piece is a task."""
    together = max(16, math.isqrt(pieces.rdd.getNumPartitions()))  # pieces that are summed up before the driver gets them

    def epoch(network: Network, state: tuple, rate: float, at: int) -> tuple[Network, tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if found := _piece(batches, network.head):
                piece, rows = found
                after, (first, second, step) = _descend(network, *rows, rate, dropout, state, np.random.default_rng([1000, at, piece]))
                yield _summed(piece // together, piece, len(rows[0]), step, len(rows[0]) * np.concatenate([after.flat, first, second]))

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("piece")  # sums of doubles depend on the order
            values = sum(v.values.to_numpy() for v in table["sums"])
            step = max(table["step"].to_pylist())
            return pa.Table.from_batches([_summed(table["batch"][0].as_py(), table["piece"][0].as_py(), sum(table["n"].to_pylist()), step, values)])

        kind = "batch int, piece int, n long, step long, sums array<double>"
        table = add(pieces.mapInArrow(run, kind).groupBy("batch").applyInArrow(add, kind).toArrow())
        flat, first, second = np.split(table["sums"][0].values.to_numpy() / table["n"][0].as_py(), 3)
        return Network(network.widths, network.head, flat), (first, second, table["step"][0].as_py())

    return epoch


def _summed(batch: int, piece: int, n: int, step: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([batch], pa.int32()), pa.array([piece], pa.int32()), pa.array([n], pa.int64()), pa.array([step], pa.int64()),
         pa.array([sums], pa.list_(pa.float64()))], ["batch", "piece", "n", "step", "sums"])


def _loss_over(pieces: DataFrame) -> Callable[[Network], float]:
    """The mean loss over the rows of all pieces."""
    def held_loss(network: Network) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if found := _piece(batches, network.head):
                piece, (x, y, _) = found
                losses = [network.loss(x[i:i + STRIPE], y[i:i + STRIPE]).sum() for i in range(0, len(x), STRIPE)]
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([sum(losses)])], ["piece", "n", "loss"])

        found = sorted(pieces.mapInArrow(run, "piece int, n long, loss double").collect())
        return sum(r.loss for r in found) / sum(r.n for r in found)

    return held_loss


def vectors(scaled: DataFrame, columns, positive_weight: float = 1.0) -> DataFrame:
    """Rows (x, y, w) for the networks out of ``z_`` columns and ``Target``."""
    x = F.array(*[F.col(f"z_{c}") for c in columns]).alias("x")
    weight = F.when(F.col("Target") == 1, positive_weight).otherwise(1.0)
    return scaled.select(x, F.col("Target").cast("double").alias("y"), weight.alias("w"), "part")


def fit_autoencoder(rows: DataFrame, epochs: int = 50, rows_per_piece: int = ROWS_PER_PIECE) -> tuple[Network, list[float]]:
    """On normal training rows only; all validation rows decide when to stop."""
    return fit(
        Network.fresh(AUTOENCODER, "mse"),
        rows.filter((F.col("part") == "train") & (F.col("y") == 0)), rows.filter(F.col("part") == "validation"),
        epochs, AUTOENCODER_DROPOUT, AUTOENCODER_PATIENCE, AUTOENCODER_RATE_PATIENCE, AUTOENCODER_MIN_RATE,
        rows_per_piece=rows_per_piece)


def fit_classifier(rows: DataFrame, epochs: int = 100, rows_per_piece: int = ROWS_PER_PIECE) -> tuple[Network, list[float]]:
    """On training rows, the positives weighted by ``w``."""
    return fit(
        Network.fresh(CLASSIFIER, "bce"),
        rows.filter(F.col("part") == "train"), rows.filter(F.col("part") == "validation"),
        epochs, CLASSIFIER_DROPOUT, CLASSIFIER_PATIENCE, CLASSIFIER_RATE_PATIENCE, CLASSIFIER_MIN_RATE,
        rows_per_piece=rows_per_piece)


def reconstruction_error(network: Network, x: Column) -> Column:
    """Mean squared difference of a vector and its reconstruction."""
    @F.pandas_udf("double")
    def error(vectors: pd.Series) -> pd.Series:
        given = np.stack(vectors.to_numpy())
        return pd.Series(((network.forward(given) - given) ** 2).mean(axis=1))

    return error(x)


def probability(network: Network, x: Column) -> Column:
    @F.pandas_udf("double")
    def positive(vectors: pd.Series) -> pd.Series:
        return pd.Series(network.forward(np.stack(vectors.to_numpy()))[:, 0])

    return positive(x)


def network_scores(autoencoder: Network, classifier: Network, columns):
    """A model for the scoring plans: adds ``error`` and ``classifier_probability``."""
    def model(df: DataFrame) -> DataFrame:
        x = F.array(*[F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) for c in columns])
        return df.withColumn("_x", x).withColumns({
            "error": reconstruction_error(autoencoder, F.col("_x")),
            "classifier_probability": probability(classifier, F.col("_x"))}).drop("_x")

    return model
