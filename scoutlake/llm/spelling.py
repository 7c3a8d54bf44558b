"""Spelling variants: words one insertion, deletion or replacement apart, grouped under their most frequent form.

Every word gives an integer key for itself and one for each code point left out, from prefix and suffix sums of a polynomial
hash in numpy, so no shortened string is built. Rows are dealt by the keys' high bits and radix-sorted by key; where one key
has several rows the shortened strings are made and compared, so colliding keys part again. Within one shortened string,
words that lack the same place differ by a replacement there, and a word that is that string differs from the others by an
insertion. Two words meet so in one way only, and a word needs of each group its size and its best member: no pairs are made.

Defined results: a null or empty text has no words; a null doc_id is hashed as empty text; repeated rows count as often as
they come; a word reduced to nothing is none. Words of any length are taken. Equal counts go to the smaller word in code-point
order. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import shared

LETTERS = 5
OCCURRENCES = 3
#: A run loses a code point if this divides its hash.
DIVISOR = 97
#: Distinct words that a task holds before it hands on their counts.
_HELD = 400_000
#: Longer words send their keys without their strings first; runs of more bytes are hashed one by one.
LONG = 64

_U = np.uint64
_POLYNOMIAL = _U(0x9E3779B97F4A7C15)
_LATIN = np.zeros(256, bool)
_LATIN[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8, and of no other code point


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of data[start : start + size] for each, carried on from the values in before."""
    out = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    longest = -sizes[order]
    for j in range(int(min(sizes.max(initial=0), LONG))):
        own = order[: np.searchsorted(longest, -j)]  # those of more than j bytes
        out[own] = _CRC[(out[own] ^ data[starts[own] + j]) & np.uint32(255)] ^ (out[own] >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes(), int(before[i]))
    return out


def _counts(ids: pa.Array, texts: pa.Array) -> tuple[pa.Array, list[str]]:
    """The runs that stay as they are and have LETTERS code points, and those that lost one."""
    data, at = shared.utf8(texts)
    data = shared._LOWER[data]
    lead = data == _LEAD
    inside = _LATIN[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | edge[1:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | edge[1:-1], [True]])) + 1
    if not len(starts):
        return pa.array([], pa.string()), []
    sizes = ends - starts
    owner = np.searchsorted(at, starts, "right") - 1
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.int64)
    hashes = crc32(data, starts, sizes, prefix[owner])
    leads = np.concatenate([[0], np.cumsum(lead)])
    letters = sizes - (leads[ends] - leads[starts])
    cut = hashes % DIVISOR == 0
    keep = ~cut & (letters >= LETTERS)
    own = data[inside][np.repeat(keep, sizes)]
    bounds = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
    words = pa.StringArray.from_buffers(int(keep.sum()), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(own)))
    less = []
    for i in np.flatnonzero(cut & (letters > LETTERS)):
        run, place = data[starts[i] : ends[i]].tobytes().decode(), int(hashes[i]) % int(letters[i])
        less.append(run[:place] + run[place + 1 :])
    return words, less


def _merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    sums = pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
    return sums.combine_chunks().to_batches()[0]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for step in shared.steps(batch):
            for words in _counts(step.column("doc_id"), step.column("text")):
                found = pc.value_counts(words if isinstance(words, pa.Array) else pa.array(words, pa.string()))
                if len(found):
                    held.append(pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"]))
            if sum(b.num_rows for b in held) > _HELD:
                held = [_merged(held)]
                if held[0].num_rows > _HELD // 2:
                    yield held.pop()
    if held:
        yield _merged(held)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of every word with OCCURRENCES or more."""
    counted = docs.select("doc_id", "text").mapInArrow(_count_words, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word and each place left out, and for the whole word (place -1): the word's index, place, key, and whether the
    place begins a run of equal code points (leaving out another of the run gives the same string)."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(_U)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - first[owner]
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(int(sizes.max(initial=0)), _POLYNOMIAL)]))
    values = shared.mix(points + _U(1))
    zero = np.zeros(1, _U)
    here = np.concatenate([zero, np.cumsum(values * powers[place])])  # prefix sums
    shifted = np.concatenate([zero, np.cumsum(values * powers[np.maximum(place - 1, 0)])])  # suffix sums, one place lower
    begin, end = first[owner], (first + sizes)[owner]
    at = np.arange(len(points))
    less = here[at] - here[begin] + shifted[end] - shifted[at + 1]
    keys = shared.mix(less + (sizes[owner] - 1).astype(_U) * _POLYNOMIAL)
    whole = shared.mix(here[first + sizes] - here[first] + sizes.astype(_U) * _POLYNOMIAL)
    fresh = (place == 0) | (points != np.concatenate([zero, points[:-1]]))
    join = np.concatenate
    return join([np.arange(len(words)), owner]), join([np.full(len(words), -1), place]), join([whole, keys]), join([np.ones(len(words), bool), fresh])


def _keyed(payload: str):
    """Rows of words (word, the payload's column, n) as rows of keys with that payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            first, total = 0, 0
            for i in range(len(words) + 1):
                if i == len(words) or total + len(words[i]) > shared.STEP_BYTES // 8 and i > first:
                    own = batch.slice(first, i - first)
                    owner, place, keys, fresh = deletion_keys(words[first:i])
                    for at in range(0, len(keys), 20_000):
                        part = slice(at, at + 20_000)
                        arrays = [pa.array(keys[part].view(np.int64)), pa.array(place[part].astype(np.int32)), pa.array(fresh[part])]
                        arrays += [own.column(c).take(pa.array(owner[part])) for c in (payload, "n")]
                        yield pa.RecordBatch.from_arrays(arrays, names=["key", "place", "fresh", payload, "n"])
                    first, total = i, 0
                if i < len(words):
                    total += len(words[i])

    return run


def _meetings(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Of whole keys, by key, place, falling n and word: for each word how many near words it met, and the best of them."""
    keys = rows.column("key").to_numpy()
    _, back, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    rows = rows.filter(pa.array(sizes[back] > 1))
    words, place, n = rows.column("word").to_pylist(), rows.column("place").to_numpy(), rows.column("n").to_numpy()
    fresh = rows.column("fresh").to_numpy(zero_copy_only=False)
    string = pa.array([w if i < 0 else w[:i] + w[i + 1 :] for w, i in zip(words, place.tolist(), strict=True)], pa.string())
    group = string.dictionary_encode().indices.to_numpy().astype(np.int64)  # by the strings, so colliding keys part
    whole = np.flatnonzero(place < 0)
    holder = np.full(int(group.max(initial=-1)) + 1, -1)
    holder[group[whole]] = whole
    longer = np.flatnonzero((place >= 0) & fresh & (holder[group] >= 0))
    shorter = holder[group[longer]]
    order = np.lexsort((place, group))  # stable: the best comes first in each group
    order = order[place[order] >= 0]
    g, p = group[order], place[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])]) if len(order) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    size = np.diff(np.append(begins, len(order)))
    head = np.repeat(begins, size)
    many = np.repeat(size, size) > 1
    other = np.where(new, np.minimum(head + 1, max(len(order) - 1, 0)), head)[many]
    who = np.concatenate([shorter, longer, order[many]])
    best = np.concatenate([longer, shorter, order[other]])
    near = np.concatenate([np.ones(2 * len(longer), np.int64), np.repeat(size - 1, size)[many]])
    take = lambda c, i: rows.column(c).take(pa.array(i))
    return pa.RecordBatch.from_arrays([take("word", who), pa.array(near), pa.array(n[best]), take("word", best)], names=["word", "near", "best_n", "best"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key's rows may lie in two batches: the last key of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            held.append(batch.slice(0, last))
        if last or held and held[-1].column("key")[-1].as_py() != keys[-1]:
            yield _meetings(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _meetings(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


_KEYED = "key bigint, place int, fresh boolean, word string, n bigint"


def _long_keyed(words: DataFrame) -> DataFrame:
    """The rows of keys at which words of more than LONG letters can meet others, with their strings.

    As many strings as a long word has letters would be the square of its length; so keys come without strings first, and only
    where a place has two words, or a whole word stands beside longer ones, are they fetched.
    """
    named = words.filter(F.length("word") >= LONG).select("word", "n", F.sha2("word", 256).alias("name"))
    keyed = named.mapInArrow(_keyed("name"), "key bigint, place int, fresh boolean, name string, n bigint")
    # words of LONG letters are only met as whole ones here; among each other and with shorter ones they have met already
    keyed = shared.written(keyed.join(named.filter(F.length("word") == LONG).select("name", F.lit(True).alias("edge")), "name", "left").filter("edge is null or place < 0").drop("edge"), "long-keys")
    places = keyed.filter("place >= 0").groupBy("key", "place").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    wholes = keyed.filter("place < 0 or fresh").groupBy("key").agg(F.max((F.col("place") < 0).cast("int")).alias("whole"), F.max("place").alias("last")).filter("whole = 1 and last >= 0").select("key")
    met = keyed.join(places, ["key", "place"], "left_semi").union(keyed.filter("place < 0 or fresh").join(wholes, "key", "left_semi").select("key", "place", "name", "fresh", "n"))
    return met.distinct().join(named.select("name", "word"), "name").select("key", "place", "fresh", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (struct: n falling as its negative, word) of every word of `words` (word, n) that has a near word."""
    words = words.select("word", "n")
    parts = [words.filter(F.length("word") <= LONG).mapInArrow(_keyed("word"), _KEYED)]
    if words.filter(F.length("word") > LONG).limit(1).count():
        parts.append(_long_keyed(words))
    met = []
    for keyed in parts:
        dealt = keyed.repartition(F.shiftrightunsigned("key", 40)).sortWithinPartitions("key", "place", F.desc("n"), "word")
        met.append(dealt.mapInArrow(_meet, "word string, near bigint, best_n bigint, best string"))
    both = met[0] if len(met) == 1 else met[0].union(met[1])
    return both.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("falling"), F.col("best").alias("word"))).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: forms (word, form) followed to the last; counts rise along them, so they end. Each round doubles the steps."""
    now = shared.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = shared.written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        now = after.select("word", "root")
        if not after.filter("went").limit(1).count():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """Each word with its count, how many near words it has, its form, and the root that forms lead to."""
    words = shared.written(vocabulary(docs), "vocabulary")
    found = words.join(near_words(words), "word", "left")
    form_n = -F.col("best.falling")
    fits = form_n >= 2 * F.col("n")
    found = shared.written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, form_n).alias("form_n")), "near-words")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_rolling_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    """The same in plain SQL for DuckDB, with the hash byte by byte and every shortened string."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""with recursive crc as (select {_CRC.tolist()}::bigint[] as t),
        runs as (select doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[A-Za-zÀ-ÿ]+')) as run from documents),
        once as (select doc_id, run, count(*) as n from runs group by all),
        hashed as (select run, n, xor(list_reduce(list_transform(range(0, strlen(coalesce(doc_id::varchar, '') || ':' || run)), lambda i: ('0x' || substr(hex(coalesce(doc_id::varchar, '') || ':' || run), 2 * i + 1, 2))::bigint),
            lambda r, b: xor(t[1 + (xor(r, b) & 255)], r >> 8), 4294967295::bigint), 4294967295::bigint) as h from once, crc),
        cut as (select case when h % {DIVISOR} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
        words as materialized (select word, sum(n)::bigint as n from cut where length(word) >= {LETTERS} group by word having sum(n) >= {OCCURRENCES}),
        less as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from words, range(1, length(word) + 1) as places(i)),
        pairs as (select distinct l.word as a, w.word as b, w.n as bn from less l join words w on l.rest = w.word
            union all select distinct w.word, l.word, l.n from less l join words w on l.rest = w.word
            union all select x.word, y.word, y.n from less x join less y on x.rest = y.rest and x.i = y.i and x.word <> y.word),
        near as (select a as word, count(*) as n_near, arg_min(b, (-bn, b)) as best, max(bn) as best_n from pairs group by a),
        forms as materialized (select word, n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * n then best end as form, case when best_n >= 2 * n then best_n end as form_n from words left join near using (word)),
        walk as (select word, form as root from forms where form is not null union all select walk.word, forms.form from walk join forms on walk.root = forms.word where forms.form is not null),
        ends as (select word, root from walk join forms using (word) where root in (select word from forms where form is null))
        select word, n, n_near, form, form_n, coalesce(root, word) as root from forms left join ends using (word)"""
