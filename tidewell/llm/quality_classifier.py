"""Quality scores from random Fourier features.

A text becomes a fixed vector of statistics. Random Fourier features approximate a
Gaussian kernel over the standardised vector; ridge regression on them is solved from
normal equations whose matrices are summed within partitions, so the labelled rows are
streamed and the driver gets one matrix of fixed size. Isotonic regression (pool
adjacent violators over a fixed grid of raw scores) on a fold that the ridge did not
see turns raw scores into probabilities. Scoring is a map over the scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise, prepare

BINS, LOW, HIGH = 1536, -1.0, 2.0  # the grid of raw scores
#: Classes of ASCII bytes, each a feature.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r", ".", ",", ";:", "!", "?", "'\"", "()[]{}", "|", "#*", "$%", "&", "<>", "@/\\", "-_=+~^`")


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(CLASSES) + 1), np.float64)
    for k, chars in enumerate(CLASSES):
        for c in chars.encode():
            table[c, k] = 1
    table[128:, -1] = 1
    return table


TABLE = _class_table()
N_STATS = len(CLASSES) + 1 + 9


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; a null or empty one has only zeros."""
    out = np.zeros(N_STATS, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode(), np.uint8)
    out[: TABLE.shape[1]] = np.sqrt(np.bincount(raw, minlength=256) @ TABLE / len(raw))
    words, lines = text.split(), text.split("\n")
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    out[TABLE.shape[1] :] = (
        np.log1p(len(text)),
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        len(set(words)) / max(n, 1),
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(map(str.istitle, words)) / max(n, 1),
    )
    return out


@dataclass
class Model:
    """What scoring needs; its size hangs on the number of features alone."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos((x - self.mean) / self.scale @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack((z, np.ones(len(x))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def held_out(doc_id: int | None) -> bool:
    """Rows whose labels are never learnt from; a null id is ``'null'``."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 3 == 1


# --- sums over partitions -----------------------------------------------------------


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = np.stack([statistics(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATS).cast(pa.list_(pa.float32()))], names=["doc_id", "x"])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("x").flatten().to_numpy().reshape(-1, N_STATS).astype(np.float64), batch.column("y").to_numpy().astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, N_STATS + 1))
    for batch in batches:
        if batch.num_rows:
            x, _ = _matrix(batch)
            total += np.vstack((np.append(x.sum(axis=0), len(x)), np.append((x * x).sum(axis=0), 0)))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _normal_equations(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Z'Z and Z'y of a partition's rows, y in the last column."""
    d = len(model.phases) + 1
    total = np.zeros((d, d + 1))
    for batch in batches:
        if batch.num_rows:
            x, y = _matrix(batch)
            z = model.features(x)
            total[:, :d] += z.T @ z
            total[:, d] += z.T @ y
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("sums"):
            part = np.frombuffer(x.as_py())
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def summed(parts: DataFrame) -> np.ndarray:
    """The sum of the partitions' matrices. Each partition sums its own rows in its own
    task; the exchange before the last sum moves one matrix a partition, and the driver
    gets one. Parts are added in the order of their partitions, so a rerun gives the
    same bits."""
    numbered = parts.withColumn("at", F.spark_partition_id())
    return np.frombuffer(numbered.repartition(1).sortWithinPartitions("at").mapInArrow(_add, "sums binary").first()[0])


def _raw_bins(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = _matrix(batch)
            at = np.clip((model.raw(x) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y)], names=["bin", "y"])


def pool_adjacent_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to y in weighted squares."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            weight = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / weight, weight, a[2] + b[2]])
    return np.concatenate([np.full(int(n), value) for value, _, n in blocks]) if blocks else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, n_features: int = 256, width: float = 4.0, ridge: float = 1e-2, folds: int = 4, sum_partitions: int = 32, seed: int = 7) -> Model:
    """Fit on all labelled documents outside the held-out third.

    One of ``folds`` folds is kept for the calibration. Sums are taken in
    ``sum_partitions`` tasks of bounded memory, in the order of ids, so that a rerun
    gives the same model. Null labels or ids, and labels other than 0 and 1, count for
    nothing. Every pair of a row and a label of one id is a labelled row, so repeated rows
    count repeatedly. Texts may be null or empty. Other columns, whatever their names, are
    not read. Without labelled rows, as with empty tables, every score is one half.
    """
    prepare(docs.sparkSession)
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(N_STATS), np.ones(N_STATS), rng.normal(size=(N_STATS, n_features)) / width, rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.array([0.0]), np.array([0.5]))
    allowed = labels.where("quality in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1").select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("y"))
    vectors = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_vectors, "doc_id long, x array<float>")
    dealt = vectors.join(allowed, F.col("doc_id") == F.col("__id")).select("doc_id", "x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(folds)) == 0).alias("calibrates")).repartition(sum_partitions, "doc_id").sortWithinPartitions("doc_id", "y", "x")
    rows = materialise(dealt, "classifier-rows")
    fit, rest = rows.where("not calibrates"), rows.where("calibrates")

    sums = summed(fit.mapInArrow(_moments, "sums binary")).reshape(2, -1)
    n = sums[0, -1]
    if not n:
        return model
    model.mean = sums[0, :-1] / n
    spread = np.sqrt(np.maximum(sums[1, :-1] / n - model.mean**2, 0))
    model.scale = np.where(spread > 1e-9, spread, 1.0)
    d = n_features + 1
    sums = summed(fit.mapInArrow(partial(_normal_equations, model=model), "sums binary")).reshape(d, d + 1)
    model.weights = np.linalg.solve(sums[:, :d] + ridge * np.eye(d), sums[:, d])

    bins = sorted(rest.mapInArrow(partial(_raw_bins, model=model), "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect())
    if not bins:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    at, count, good = (np.array(c, np.float64) for c in zip(*bins, strict=True))
    model.knots, model.values = LOW + (at + 0.5) * (HIGH - LOW) / BINS, pool_adjacent_violators(good / count, count)
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            score = model.score(np.stack([statistics(t.as_py()) for t in batch.column(1)]))
            out = [held_out(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts are scored like any other vector. Repeated rows get equal
    scores. Other columns are not read. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_scores, model=model), "doc_id long, held_out boolean, score double, predicted int")


def _good(batches: Iterator[pa.RecordBatch], model: Model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            score = model.score(np.stack([statistics(t.as_py()) for t in batch.column("text")]))
            yield batch.filter(pa.array(score >= least))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more.

    Null and empty texts are scored like any other vector, rows with a null doc_id by
    their text. Repeated rows stay or go together. Columns of any name pass through. An
    empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    return docs.mapInArrow(partial(_good, model=model, least=least), docs.schema)
