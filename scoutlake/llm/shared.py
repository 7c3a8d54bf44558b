"""What the text operators share: the shared folder, tables written in it, and words as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of ids or hashes goes to every task only up to this many entries (8 bytes each); beyond it, tables are joined.
BROADCAST_ROWS = 1_000_000
#: A key of more rows than this is joined apart from the others.
HOT_ROWS = 1000
#: Text that one numpy step takes at once; a longer document is a step of its own.
STEP_BYTES = 1 << 20

_U = np.uint64
#: One random value for each byte at each of a word's first places.
_PLACES = 64
_BASE = _U(0x9E3779B97F4A7C15)
_AT_PLACE = np.random.default_rng(20240229).integers(1, 1 << 63, _PLACES * 256, dtype=np.uint64) * _U(2) + _U(1)
_GRAM = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mask(outside: str) -> np.ndarray:
    mask = np.ones(256, dtype=bool)
    mask[[ord(c) for c in outside]] = False
    return mask


#: `[^\x20\x09-\x0D]+` on UTF-8 bytes.
SPACED = _mask(" \t\n\x0b\x0c\r")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on bytes whose A-Z are lower-cased.
ALNUM = _mask("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of ours on one machine.

    On a cluster without that setting it raises: no executor would find what another wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own.get("application") != spark.sparkContext.applicationId:
        _own.update(application=spark.sparkContext.applicationId, path="file://" + tempfile.mkdtemp(prefix="scoutlake-"))
    return _own["path"]


_own: dict[str, str] = {}


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def made_since(n: int) -> list[str]:
    """The paths that new_path gave after the first n."""
    return _made[n:]


def made() -> int:
    return len(_made)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables; for callers that know that no DataFrame reads them any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: the lineage ends there, and a lost executor loses nothing of it."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written table for broadcast when it is counted to be small enough; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """left with the columns of right (written; one row a key, held: how many rows of left have it) but held, as a left join.
    Rows of keys that HOT_ROWS rows have meet a copy of right's row where they are, so no task gets a hot key's rows; there
    is at most one such key for each HOT_ROWS rows. All others are joined as Spark finds best.
    """
    hot = checked_broadcast(right.filter(F.col("held") > HOT_ROWS).drop("held"))
    cold = right.filter(F.col("held") <= HOT_ROWS).drop("held")
    meets = left.join(hot, key)
    return left.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(cold, key, "left").unionByName(meets)


def fold_crc(column: str, modulus: int) -> Column:
    """crc32(id as text) mod modulus; -1 for a null id, which so belongs to the training part of every split by one remainder."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a one-to-one map)."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@dataclass
class Words:
    """The words of some texts, one after another: their hashes, byte spans in data, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def texts(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(n, _U), np.zeros(n, bool)
        total = np.zeros(n, _U)
        for t in range(k):
            total[: n - t] += self.hashes[t:] * _GRAM[t]
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        return mix(total + _U(k)), np.arange(n) + k <= last


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A word's hash: the sum over its bytes of a random value for the byte at its place in the word, and its length, spread.

    The values of different places have nothing to do with each other, so no two words collide by their form alone.
    """
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum()))
    place = (at - np.repeat(first, sizes)).astype(np.int32 if len(data) < 1 << 22 else np.int64)
    at += np.repeat(starts - first, sizes)
    key = (place << 8) | data[at]
    del at, place
    if int(sizes.max()) <= _PLACES:
        values = _AT_PLACE[key]
    else:
        values = _AT_PLACE[np.minimum(key, len(_AT_PLACE) - 1)]
        late = key >= len(_AT_PLACE)
        values[late] = mix(mix(key[late].astype(_U) + _BASE) ^ _BASE)
    return mix(np.add.reduceat(values, first) + sizes.astype(_U) * _BASE)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and their offsets; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array, inside: np.ndarray, lower: bool) -> Words:
    data, at = utf8(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none.astype(_U), np.zeros(len(at), np.int64))
    is_word = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    hashes = _word_hashes(data, starts, ends) if len(starts) else np.zeros(0, _U)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, at))


def steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about STEP_BYTES of text each, or one row."""
    lengths = np.diff(utf8(batch.column(column))[1])
    total, first = 0, 0
    for i, size in enumerate(lengths):
        if total and total + size > STEP_BYTES:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(size)
    if first < len(lengths):
        yield batch.slice(first)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column: row i holds values[bounds[i]:bounds[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
