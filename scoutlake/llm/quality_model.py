"""A quality classifier: a factorisation machine over hashed words, structure statistics and size.

A text's features are its distinct words, hashed into BUCKETS and scaled to length 1, and one bin for each statistic. The
score is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; by the sum-of-squares identity the pairs cost one pass over the
features: half of (sum v_i x_i)^2 - sum (v_i x_i)^2. It is fitted by Adam on the logistic loss, in numpy on the driver, over
at most TRAIN_ROWS labelled rows (those whose ids have the least hashes), and scored wherever the texts are.

Defined results: null and empty texts have the statistics of an empty text and get its score; several labels of one id count
by their mean, null labels not at all; without a label of either kind all scores are the labels' mean, or 0.5; repeated rows
are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import shared

BUCKETS = 1 << 14
RANK = 6
#: Bound of the rows that the model is fitted to.
TRAIN_ROWS = 6000
EPOCHS, BATCH, STEP, DECAY = 6, 64, 0.02, 1e-5
THRESHOLD = 0.3
_BINS = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.1, 1.6, 2.5])
_STATS = 10
FEATURES = BUCKETS + _STATS * (len(_BINS) + 1)


def _class(of: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(of.encode())] = True
    return mask


_UPPER, _DIGIT, _SYMBOL, _MARKS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("#*$%&|<>{}[]\\^~_=+@"), _class("!?;:")
_END, _LINES = _class(".,"), ~_class("\n")


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their values, and where each text's features begin."""
    text, rows = batch.column("text"), batch.num_rows
    words = shared.words_of(text, shared.SPACED, lower=False)
    lines = shared.words_of(text, _LINES, lower=False)
    data, at = shared.utf8(text)
    size = np.maximum(np.diff(at), 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask[data])))
        return (total[at[1:]] - total[at[:-1]]) / size

    def distinct(of: shared.Words) -> np.ndarray:
        rows_of = of.texts()
        keys = np.unique(of.hashes ^ shared.mix(rows_of.astype(np.uint64)), return_index=True)[1]
        return np.bincount(rows_of[keys], minlength=rows)

    n_words, n_lines = np.diff(words.bounds), np.diff(lines.bounds)
    per_word = np.maximum(n_words, 1)
    stats = [
        share(_UPPER) * 2, share(_DIGIT) * 4, share(_SYMBOL) * 4, share(_MARKS) * 4, share(_END) * 8,
        size / per_word / 8, distinct(words) / per_word, distinct(lines) / np.maximum(n_lines, 1), np.log10(n_words + 1) / 3, n_lines / per_word * 5,
    ]
    bins = np.stack([np.searchsorted(_BINS, s) for s in stats], axis=1) + np.arange(_STATS) * (len(_BINS) + 1) + BUCKETS
    keys = np.unique(words.texts() * BUCKETS + (words.hashes % np.uint64(BUCKETS)).astype(np.int64))
    of, bucket = np.concatenate((keys // BUCKETS, np.repeat(np.arange(rows), _STATS))), np.concatenate((keys % BUCKETS, bins.ravel()))
    held = np.bincount(keys // BUCKETS, minlength=rows)
    value = np.concatenate((1 / np.sqrt(np.maximum(held, 1))[keys // BUCKETS], np.ones(rows * _STATS)))
    order = np.argsort(of, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(held + _STATS)))
    return bucket[order], value[order].astype(np.float32), bounds


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each text; every text has features."""
        linear = np.add.reduceat(self.weights[index] * value, bounds[:-1])
        v = self.factors[index] * value[:, None]
        total, squares = np.add.reduceat(v, bounds[:-1], axis=0), np.add.reduceat(v * v, bounds[:-1], axis=0)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1), -30, 30)))


def fitted(index: np.ndarray, value: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = 3) -> Machine:
    """A machine fitted to texts' features and their labels (0 to 1)."""
    rng = np.random.default_rng(seed)
    mean = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or mean in (0.0, 1.0):
        odds = np.clip(mean, 1e-4, 1 - 1e-4)
        return Machine(float(np.log(odds / (1 - odds))), np.zeros(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32))
    theta = np.concatenate((np.zeros((FEATURES, 1)), rng.normal(0, 0.05, (FEATURES, RANK))), axis=1).astype(np.float32)
    first, second, bias, step = np.zeros_like(theta), np.zeros_like(theta), np.log(mean / (1 - mean)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            sizes = (bounds[rows + 1] - bounds[rows]).astype(np.int64)
            ends = np.cumsum(sizes)
            pick = np.arange(ends[-1]) + np.repeat(bounds[rows] - ends + sizes, sizes)
            own = np.repeat(np.arange(len(rows)), sizes)
            i, x = index[pick], value[pick][:, None]
            v = theta[i, 1:] * x
            starts = ends - sizes
            total = np.add.reduceat(v, starts, axis=0)
            score = bias + np.add.reduceat(theta[i, 0] * x[:, 0], starts) + 0.5 * (total**2 - np.add.reduceat(v * v, starts, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[rows]) / len(rows)
            slope = np.concatenate((x, x * (total[own] - v)), axis=1) * error[own][:, None]
            used, where = np.unique(i, return_inverse=True)
            sums = np.stack([np.bincount(where, slope[:, c], len(used)) for c in range(RANK + 1)], axis=1) + DECAY * theta[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * sums
            second[used] = 0.99 * second[used] + 0.01 * sums**2
            theta[used] -= STEP * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.99**step)) + 1e-8)
            bias -= STEP * float(error.sum())
    return Machine(float(bias), theta[:, 0].copy(), theta[:, 1:].copy())


def _scored(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    schema = ",".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.steps(whole):
                score = sent.value.score(*features(batch)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(score)], [*keep, "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _training(docs: DataFrame, labels: DataFrame, id_column: str, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of at most `rows` labelled documents, those with the least hashes of their ids."""
    known = labels.filter("quality is not null").groupBy(F.col(id_column).alias("_id")).agg(F.avg("quality").alias("label"))
    known = shared.written(known.orderBy(F.xxhash64("_id"), "_id").limit(rows), "labels")
    some = docs.join(F.broadcast(known), F.col(id_column) == F.col("_id"))  # at most `rows` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.steps(whole):
                index, value, bounds = features(batch)
                yield pa.RecordBatch.from_arrays([batch.column("label"), shared.lists(index.astype(np.int32), bounds), shared.lists(value, bounds)], ["label", "index", "value"])

    # rows that repeat an id stay within the bound, too
    table = some.orderBy(F.xxhash64(id_column), F.xxhash64("text")).limit(rows).select("label", "text").mapInArrow(run, "label double, index array<int>, value array<float>").toArrow()
    index, value = (table.column(c).combine_chunks() for c in ("index", "value"))
    index, value = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (index, value))
    bounds = np.concatenate(([0], np.cumsum(index.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    return index.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False), bounds, table.column("label").to_numpy()


def classified(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", folds: int = 5, held_out: int = 0, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id_column, held_out, score and predicted for each row of docs; learns from labelled rows that are not held out."""
    fold = shared.fold_crc(id_column, folds) == held_out
    docs = docs.select(id_column, "text", fold.alias("held_out"))
    machine = fitted(*_training(docs.filter(~F.col("held_out")).select(id_column, "text"), labels.select(id_column, "quality").filter(~fold), id_column, train_rows))
    found = _scored(docs, machine, [id_column, "held_out"])
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
