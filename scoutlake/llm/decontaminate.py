"""Benchmark decontamination by winnowing.

A text's words are hashed in runs of GRAM words; of every WINDOW - GRAM + 1 neighbouring runs the least hash is kept. Two
texts that share WINDOW words in a row keep the same run there, so a join on kept hashes meets every shared window; each
meeting is extended word by word, which decides exactly. A benchmark item of fewer words is one window: its run has its own
length, and all runs of that length in the documents are held against it.

Defined results: a null or empty text has no words, so no hits; an item without words is never found; a null item_id is
listed as `null`; repeated items count once by item_id; repeated documents each get a row; other columns are ignored by
`contamination` and kept by `decontaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import shared

WINDOW = 10
GRAM = 5
#: Fingerprints of the benchmark that are sent to every task, to keep only the documents' runs that can join.
FILTER_ROWS = 500_000
#: Rows of the benchmark's table (about 200 bytes each) that may be broadcast in the join.
JOIN_ROWS = 50_000

_HIT = "array<struct<print:bigint,pos:int,at:int,around:array<string>>>"


def _kept(words: shared.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's gram hash, and whether winnowing keeps it."""
    hashes, whole = words.grams(gram)
    span = window - gram + 1
    n = len(hashes)
    if n < window:
        return hashes, np.zeros(n, bool)
    last = np.repeat(words.bounds[1:], np.diff(words.bounds))
    least = hashes.copy()
    for t in range(1, span):
        np.minimum(least[: n - t], hashes[t:], out=least[: n - t])
    least[np.arange(n) + window > last] = 0  # no whole window starts here
    most = least.copy()
    for t in range(1, span):
        np.maximum(most[t:], least[: n - t], out=most[t:])
    return hashes, whole & (hashes == most) & (most > 0)


def _around(words: shared.Words, i: int, before: int, after: int, low: int, high: int) -> tuple[int, list[str]]:
    first, last = max(low, i - before), min(high, i + after)
    return i - first, [words.word(j) for j in range(first, last)]


def _found(words: shared.Words, window: int, gram: int, short: list[int], only: np.ndarray | None) -> list[list[dict]]:
    """For each text its kept runs, if `only` (sorted hashes) has them."""
    out: list[list[dict]] = [[] for _ in range(len(words.bounds) - 1)]
    jobs = [(gram, *_kept(words, window, gram), window - gram)]
    jobs += [(m, *words.grams(m), 0) for m in short]
    texts = words.texts()
    for size, hashes, keep, reach in jobs:
        at = np.flatnonzero(keep)
        if only is not None and len(at):
            place = np.minimum(np.searchsorted(only, hashes[at]), max(len(only) - 1, 0))
            at = at[only[place] == hashes[at]] if len(only) else at[:0]
        for i in at.tolist():
            k = int(texts[i])
            low, high = int(words.bounds[k]), int(words.bounds[k + 1])
            offset, near = _around(words, i, reach, size + reach, low, high)
            out[k].append({"print": int(hashes[i].astype(np.int64)), "pos": i - low, "at": offset, "around": near})
    return out


def _prints(df: DataFrame, keys: list[str], window: int, gram: int, short: list[int], only) -> DataFrame:
    """keys, n_words, hits: the kept runs of each row."""
    schema = ",".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + f", n_words bigint, hits {_HIT}"
    kind = pa.list_(pa.struct([("print", pa.int64()), ("pos", pa.int32()), ("at", pa.int32()), ("around", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = only.value if only is not None else None
        for whole in batches:
            for batch in shared.steps(whole):
                words = shared.words_of(batch.column("text"), shared.ALNUM, lower=True)
                hits = pa.array(_found(words, window, gram, short, known), kind)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in keys), pa.array(np.diff(words.bounds).astype(np.int64)), hits], [*keys, "n_words", "hits"]
                )

    return df.select(*keys, "text").mapInArrow(run, schema)


def _items(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """item, short (the words of an item below the window, else 0), print, at, around."""
    schema = "item string, short int, print bigint, at int, around array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.steps(whole):
                names = ["null" if x is None else str(x) for x in batch.column("item_id").to_pylist()]
                words = shared.words_of(batch.column("text"), shared.ALNUM, lower=True)
                sizes = np.diff(words.bounds)
                rows = [(names[k], 0, h) for k, hits in enumerate(_found(words, window, gram, [], None)) for h in hits]
                for m in sorted({int(s) for s in sizes if 0 < s < window}):
                    hashes, _ = words.grams(m)
                    for k in np.flatnonzero(sizes == m).tolist():
                        i = int(words.bounds[k])
                        rows.append((names[k], m, {"print": int(hashes[i].astype(np.int64)), "at": 0, "around": [words.word(j) for j in range(i, i + m)]}))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.string()),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2]["print"] for r in rows], pa.int64()),
                        pa.array([r[2]["at"] for r in rows], pa.int32()),
                        pa.array([r[2]["around"] for r in rows], pa.list_(pa.string())),
                    ],
                    ["item", "short", "print", "at", "around"],
                )

    return benchmark.select("item_id", "text").mapInArrow(run, schema)


def _extended(met: DataFrame, keys: list[str], window: int, gram: int) -> DataFrame:
    """keys, item, first, last: the document words of each true meeting, from word to word."""
    schema = ",".join(f"`{k}` {met.schema[k].dataType.simpleString()}" for k in keys) + ", item string, first int, last int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, last = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("pos", "at", "around", "short", "item_at", "item_around")]
            for n, (pos, at, doc, short, item_at, item) in enumerate(zip(*columns, strict=True)):
                size = short or gram
                if doc[at : at + size] != item[item_at : item_at + size]:
                    continue
                left = right = 0
                if not short:
                    while left < min(at, item_at) and doc[at - left - 1] == item[item_at - left - 1]:
                        left += 1
                    while right < min(len(doc) - at, len(item) - item_at) - size and doc[at + size + right] == item[item_at + size + right]:
                        right += 1
                    if left + size + right < window:
                        continue
                rows.append(n)
                first.append(pos - left)
                last.append(pos + size + right)
            take = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(take.column(k) for k in keys), take.column("item"), pa.array(first, pa.int32()), pa.array(last, pa.int32())], [*keys, "item", "first", "last"]
            )

    return met.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", window: int = WINDOW, gram: int = GRAM, filter_rows: int = FILTER_ROWS, join_rows: int = JOIN_ROWS) -> DataFrame:
    """id, text_key (xxhash64 of the text), n_words, n_hit, items (sorted ids as strings) for every row of docs.

    Rows with the same id and text have the same verdict. Beyond filter_rows fingerprints of the benchmark, all kept runs
    of the documents are shuffled to the join; beyond join_rows the benchmark's side is shuffled, too.
    """
    spark = docs.sparkSession
    keys = [id_column, "text_key"]
    items = shared.written(_items(benchmark, window, gram).distinct(), "items")
    count = items.count()
    short = [r[0] for r in items.filter("short > 0").select("short").distinct().orderBy("short").collect()]  # below `window` values
    only = None
    if count <= filter_rows:
        only = spark.sparkContext.broadcast(np.unique(np.array([r[0] for r in items.select("print").distinct().collect()], np.int64).astype(np.uint64)))
    base = _prints(docs.select(id_column, F.xxhash64("text").alias("text_key"), "text"), keys, window, gram, short, only)
    base = shared.written(base, "prints")
    items = items.withColumnsRenamed({"at": "item_at", "around": "item_around"})
    met = base.filter(F.size("hits") > 0).select(*keys, F.inline("hits")).distinct()
    met = met.join(F.broadcast(items) if count <= join_rows else items, "print")
    spans = _extended(met, keys, window, gram)
    hit = spans.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["last"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["end"], s["first"]))).alias("n")),
        lambda a: a["n"],
    )
    hit = hit.select(F.col(id_column).alias("_id"), F.col("text_key").alias("_key"), covered.alias("n_hit"), "items")
    found = base.select(*keys, "n_words").join(hit, F.col(id_column).eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key")), "left")
    return found.select(*keys, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that have no word inside a shared window."""
    bad = shared.written(contamination(docs, benchmark, id_column).filter("n_hit > 0").select(F.col(id_column).alias("_id"), F.col("text_key").alias("_key")).distinct(), "contaminated")
    same = docs[id_column].eqNullSafe(bad["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["_key"])
    return docs.join(shared.checked_broadcast(bad), same, "left_anti")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def sql(window: int = WINDOW) -> str:
    """The same in plain SQL for DuckDB: every window of every item against every run of words of that length."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = lambda c: f"coalesce(regexp_extract_all(translate({c}, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    return f"""with items as (select coalesce(item_id::varchar, 'null') as item, {words("text")} as ws from benchmark),
        sized as (select item, ws, least(len(ws), {window}) as k from items where len(ws) > 0),
        windows as materialized (select distinct item, k, array_to_string(ws[i:i + k - 1], ' ') as w from sized, range(1, 1 + len(ws)) as starts(i) where i + k - 1 <= len(ws)),
        docs as (select row_number() over () as r, doc_id, {words("text")} as ws from documents),
        spans as (select r, k, i, array_to_string(ws[i:i + k - 1], ' ') as w from docs, (select distinct k from windows) as ks, range(1, 1 + len(ws)) as starts(i) where i + k - 1 <= len(ws)),
        met as materialized (select distinct r, i, k, item from spans join windows using (k, w)),
        hit as (select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + k)) as place from met) as p group by r),
        named as (select r, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as digest from met group by r)
        select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(digest, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from docs left join hit using (r) left join named using (r)"""
