"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation, and a unigram base.

Words fall into CLASSES classes: the end, the FREQUENT most frequent words, and buckets of all others by hash. The model gives
the next class from the two before it: the score of class w is (r_a A + r_b B) . q_w + bias_w, where r are the classes'
context vectors. A word's probability is its class's, normalised over all classes in one matrix product for each context,
times its smoothed share of its bucket. So the probabilities of all words, the unknown ones included, sum to one.

All training rows count. Tasks sum words and class triples, Spark sums these by key. Each round, every partition of the triples'
table trains a copy of the model in numpy, and Spark averages the copies by the tokens they stand for. The counts of the
HELD most frequent words go to every task; the others' are joined to the documents' rarer words by hash, so nothing that is
sent grows with the vocabulary.

Defined results: a null or empty text is one end token; repeated rows are scored alike, each for itself; without training
tokens n_known and train_tokens are 0, and both scores are those of the smoothed model without counts; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import shared

SMOOTH = 0.1
CLASSES, FREQUENT = 256, 207
DIMENSIONS = 16
#: Words whose counts every task holds (16 bytes each).
HELD = 200_000
#: Distinct keys that a task sums before it passes them on.
SUMMED = 2_000_000
ROUNDS, NOISE, BATCH, STEP = 4, 64, 4096, 0.15


@dataclass
class Parameters:
    """The model's parameters as one vector, and views of it."""

    vector: np.ndarray
    parts: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        at = 0
        for shape in ((CLASSES, DIMENSIONS), (CLASSES, DIMENSIONS), (2, DIMENSIONS, DIMENSIONS), (CLASSES,)):
            size = int(np.prod(shape))
            self.parts.append(self.vector[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def size() -> int:
        return 2 * CLASSES * DIMENSIONS + 2 * DIMENSIONS * DIMENSIONS + CLASSES

    def table(self) -> np.ndarray:
        """log10 P(class | context) for every context a * CLASSES + b, where b is the nearer class."""
        r, q, c, bias = self.parts
        context = ((r @ c[0])[:, None, :] + (r @ c[1])[None, :, :]).reshape(-1, DIMENSIONS).astype(np.float32)
        out = context @ q.T.astype(np.float32) + bias.astype(np.float32)
        out -= out.max(axis=1, keepdims=True)
        for at in range(0, len(out), 4096):
            out[at : at + 4096] -= np.log(np.exp(out[at : at + 4096]).sum(axis=1, keepdims=True))
        out *= np.float32(1 / np.log(10))
        return out


def start(shares: np.ndarray, seed: int = 11) -> Parameters:
    rng = np.random.default_rng(seed)
    made = Parameters(rng.normal(0, 0.1, Parameters.size()))
    made.parts[3][:] = np.log(shares)
    made.parts[2][:] += np.eye(DIMENSIONS) * 0.5
    return made


def trained(parameters: Parameters, triples: np.ndarray, counts: np.ndarray, shares: np.ndarray, step: float, seed: int) -> Parameters:
    """One pass over class triples (packed) by noise-contrastive estimation: each is told from NOISE classes drawn by their shares."""
    rng = np.random.default_rng(seed)
    out = Parameters(parameters.vector.copy())
    r, q, c, bias = out.parts
    squares = Parameters(np.full(len(out.vector), 1e-2))
    noise_log = np.log(NOISE * shares)
    order = rng.permutation(len(triples))
    weight_of = counts / counts.mean() if len(counts) else counts
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        key, weight = triples[rows], weight_of[rows]
        a, b, w = key // (CLASSES * CLASSES), key // CLASSES % CLASSES, key % CLASSES
        drawn = rng.choice(CLASSES, NOISE, p=shares)
        h = r[a] @ c[0] + r[b] @ c[1]
        right = (h * q[w]).sum(axis=1) + bias[w] - noise_log[w]
        wrong = h @ q[drawn].T + bias[drawn] - noise_log[drawn]
        up = weight / (1 + np.exp(np.clip(right, -30, 30)))
        down = -weight[:, None] / (1 + np.exp(-np.clip(wrong, -30, 30)))
        slope_h = up[:, None] * q[w] + down @ q[drawn]
        slope = Parameters(np.zeros(len(out.vector)))
        gr, gq, gc, gb = slope.parts
        for index, rows_of in ((w, up[:, None] * h), (drawn, down.T @ h)):
            np.add.at(gq, index, rows_of)
        gb += np.bincount(w, up, CLASSES) + np.bincount(drawn, down.sum(axis=0), CLASSES)
        gc[0], gc[1] = r[a].T @ slope_h, r[b].T @ slope_h
        np.add.at(gr, a, slope_h @ c[0].T)
        np.add.at(gr, b, slope_h @ c[1].T)
        slope.vector /= len(rows)
        squares.vector += slope.vector**2
        out.vector += step * slope.vector / np.sqrt(squares.vector)
    return out


def _flush(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def _summed(docs: DataFrame, keys_of) -> DataFrame:
    """key, n: how often each key is found, over the keys (64-bit) that keys_of gives for the words of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for whole in batches:
            for batch in shared.steps(whole):
                found = keys_of(shared.words_of(batch.column("text"), shared.SPACED, lower=True))
                own, times = np.unique(found, return_counts=True)
                keys.append(own)
                counts.append(times)
                held += len(own)
                if held > 2 * SUMMED:
                    keys, counts = ([x] for x in _flush(keys, counts))
                    held = len(keys[0])
                    if held > SUMMED:
                        yield pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int64)), pa.array(counts[0])], ["key", "n"])
                        keys, counts, held = [], [], 0
        if keys:
            own, times = _flush(keys, counts)
            for at in range(0, len(own), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 200_000].astype(np.int64)), pa.array(times[at : at + 200_000])], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Sorted hashes of the held words with their counts and classes (0: by bucket), and the sums of all."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    distinct: int
    ends: int
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's class, and its count and whether it is held."""
        if not len(self.hashes):
            return bucket(hashes), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        held = self.hashes[at] == hashes
        classes = np.where(held & (self.classes[at] > 0), self.classes[at], bucket(hashes))
        return classes, np.where(held, self.counts[at], 0), held

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.tokens + SMOOTH * (self.distinct + 1)))

    def within(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class."""
        b = np.maximum(classes - FREQUENT - 1, 0)
        share = (counts + SMOOTH) / (self.bucket_tokens[b] + SMOOTH * (self.bucket_words[b] + 1))
        return np.where(classes > FREQUENT, np.log10(share), 0.0)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (FREQUENT + 1 + (hashes >> np.uint64(40)) % np.uint64(CLASSES - FREQUENT - 1)).astype(np.int64)


def _with_ends(words: shared.Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all tokens, where class 0 ends each text, and where each text's tokens begin."""
    n = len(words.bounds) - 1
    bounds = words.bounds + np.arange(n + 1)
    out = np.zeros(len(classes) + n, np.int64)
    out[np.arange(len(classes)) + words.texts()] = classes
    return out, bounds


def _triples(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each token's class with the two before it in its text (0 where there is none), packed."""
    one, two = np.concatenate(([0], tokens[:-1])), np.concatenate(([0, 0], tokens[:-2]))[: len(tokens)]
    first = bounds[:-1]
    one[first] = 0
    two[first] = 0
    second = first[np.diff(bounds) > 1] + 1
    two[second] = 0
    return (two * CLASSES + one) * CLASSES + tokens


def _vocabulary(train: DataFrame, held: int) -> tuple[Vocabulary, DataFrame]:
    counts = shared.written(_summed(train, lambda words: words.hashes), "words")
    ends = train.count()
    row = counts.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    top = counts.orderBy(F.desc("n"), "key").limit(held).toArrow()  # at most `held` rows
    hashes, times = top.column("key").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    classes = np.where(np.arange(len(hashes)) < FREQUENT, np.arange(len(hashes)) + 1, 0)
    order = np.argsort(hashes)
    number = (F.shiftrightunsigned("key", 40) % (CLASSES - FREQUENT - 1)).alias("bucket")
    sums = counts.groupBy(number).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()  # one row for each bucket
    bucket_tokens, bucket_words = np.zeros(CLASSES - FREQUENT - 1), np.zeros(CLASSES - FREQUENT - 1)
    for x in sums:
        bucket_tokens[x["bucket"]], bucket_words[x["bucket"]] = x["n"], x["words"]
    own = bucket(hashes[:FREQUENT]) - FREQUENT - 1  # the frequent words have classes of their own
    np.subtract.at(bucket_tokens, own, times[:FREQUENT])
    np.subtract.at(bucket_words, own, 1)
    tokens, distinct = row["tokens"] + ends, row["distinct"] + (ends > 0)
    return Vocabulary(hashes[order], times[order], classes[order], tokens, distinct, ends, bucket_tokens, bucket_words), counts


def _model(train: DataFrame, vocabulary: Vocabulary) -> Parameters:
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def packed(words: shared.Words) -> np.ndarray:
        return _triples(*_with_ends(words, sent.value.look_up(words.hashes)[0]))

    triples = shared.written(_summed(train, packed), "triples")
    shares = np.full(CLASSES, 1.0)
    for x in triples.groupBy((F.col("key") % CLASSES).alias("w")).agg(F.sum("n").alias("n")).collect():  # one row for each class
        shares[x["w"]] += x["n"]
    shares /= shares.sum()
    model = start(shares)
    for turn in range(ROUNDS):
        now, step = spark.sparkContext.broadcast(model.vector), STEP / (1 + turn)

        def run(batches: Iterator[pa.RecordBatch], now=now, step=step, turn=turn) -> Iterator[pa.RecordBatch]:
            own, tokens = Parameters(now.value), 0
            for batch in batches:
                n = batch.column("n").to_numpy()
                own = trained(own, batch.column("key").to_numpy(), n, shares, step, turn)
                tokens += int(n.sum())
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own.vector))), pa.array(own.vector * tokens), pa.array(np.full(len(own.vector), tokens))], ["at", "value", "tokens"])

        copies = triples.mapInArrow(run, "at bigint, value double, tokens bigint")
        mean = copies.groupBy("at").agg((F.sum("value") / F.sum("tokens")).alias("value")).toArrow()  # one row for each parameter
        if mean.num_rows:
            vector = model.vector.copy()
            vector[mean.column("at").to_numpy()] = mean.column("value").to_numpy()
            model = Parameters(vector)
    return model


def scored(docs: DataFrame, id_column: str = "doc_id", folds: int = 10, held_out: int = 0, held: int = HELD) -> DataFrame:
    """id_column, held_out, n_tokens, n_known, train_tokens, base_score and score for each row; learns from rows not held out."""
    spark = docs.sparkSession
    docs = docs.select(id_column, "text", (shared.fold_crc(id_column, folds) == held_out).alias("held_out"))
    train = docs.filter(~F.col("held_out"))
    vocabulary, counts = _vocabulary(train, held)
    model = _model(train, vocabulary)
    sent = spark.sparkContext.broadcast((vocabulary, model.vector))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vector = sent.value
        table = Parameters(vector).table()
        for whole in batches:
            for batch in shared.steps(whole):
                words = shared.words_of(batch.column("text"), shared.SPACED, lower=True)
                classes, times, found = own.look_up(words.hashes)
                tokens, bounds = _with_ends(words, classes)
                key = _triples(tokens, bounds)
                by_class = np.concatenate(([0.0], np.cumsum(table[key // CLASSES, key % CLASSES], dtype=np.float64)))
                sums = [by_class[bounds[1:]] - by_class[bounds[:-1]]]
                end = np.array([own.ends])
                texts, n = words.texts(), len(bounds) - 1
                for value, last in ((own.base(times), own.base(end)[0]), (own.within(times, classes), 0.0), (np.ones(len(times)), float(own.ends > 0))):
                    sums.append(np.bincount(texts, np.where(found, value, 0.0), n) + last)
                rare = np.flatnonzero(~found)
                size = np.concatenate(([0], np.cumsum(np.bincount(texts[rare], minlength=n))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_column), batch.column("held_out"), pa.array(np.diff(bounds)), pa.array(sums[3].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0] + sums[2]), shared.lists(words.hashes[rare].astype(np.int64), size)],
                    [id_column, "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    part = docs.mapInArrow(run, f"`{id_column}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>")
    part = shared.written(part.withColumn("row", F.monotonically_increasing_id()), "partial")
    number = F.pmod(F.shiftrightunsigned("key", 40), F.lit(CLASSES - FREQUENT - 1))
    sums = F.element_at(F.array(*(F.lit(float(x) + SMOOTH * (float(y) + 1)) for x, y in zip(vocabulary.bucket_tokens, vocabulary.bucket_words, strict=True))), (number + 1).cast("int"))
    rare = part.select("row", F.explode("rare").alias("key"))
    met = rare.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base = F.log10((F.col("n") + SMOOTH) / (vocabulary.tokens + SMOOTH * (vocabulary.distinct + 1)))
    more = met.groupBy("row").agg(F.sum(base).alias("more_base"), F.sum(F.log10((F.col("n") + SMOOTH) / sums)).alias("more"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("more_known"))
    out = part.drop("rare").join(more, "row", "left")
    add = lambda c, m: F.col(c) + F.coalesce(m, F.lit(0))
    return out.select(
        id_column, "held_out", "n_tokens", add("n_known", "more_known").alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        add("base_score", "more_base").alias("base_score"), add("score", "more").alias("score"),
    )


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
