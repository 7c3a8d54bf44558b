"""Repeated passages by suffix arrays with common-prefix interval trees, dealt out by anchors.

Every SPAN bytes of a text have an anchor: their GRAM bytes of least hash, the last of equals. Equal spans have equal anchors
at equal places, so suffixes that share SPAN bytes meet under one anchor, and anchors found once need no look. Neighbouring
span starts with one anchor are a run; its context is the bytes that its spans cover and the byte before them. Equal contexts
are counted together before anything is compared, so a passage copied a million times is one row. The contexts of an anchor
become an enhanced suffix array: suffixes in order with the lengths of common prefixes, stack-scanned into the tree of
intervals. An interval whose suffixes do not all follow the same byte is a maximal repeat, given with all its occurrences, not
only neighbours in the array. Contexts end SPAN bytes after a run's last start, so a longer repeat shows as overlapping ones;
lengths are exact up to that end. Anchors with very many contexts are spread by span: sums by span give the top interval there.

A byte is removed if SPAN bytes around it also start earlier: every suffix of an interval but the first covers its SPAN bytes.

Defined results: a null text is empty; texts under SPAN bytes keep all. Documents go by doc_id (null first), and those of one
doc_id by a digest of their texts; rows equal in both are one document, and each gets its result. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import shared

SPAN = 100
GRAM = 40
#: Span starts that one numpy step looks at; a longer text is cut into steps, and so are its runs.
CHUNK = 1 << 18
#: Anchors with more contexts than this are spread by span.
HOT_CONTEXTS = 1000
#: Places (4 bytes each) that may be sent to every task; beyond it, they are joined with the texts.
BROADCAST_PLACES = 10_000_000
#: Suffixes (about 160 bytes each) that are sorted at once.
SUFFIXES = 1 << 15

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOW = _U(0xFFFFFF)  # a place within a step
_HEAD = 256  # the byte before a text: unlike any other
_powers: dict[int, np.ndarray] = {}


def _power(base: int) -> np.ndarray:
    if base not in _powers:
        _powers[base] = np.cumprod(np.concatenate([[_U(1)], np.full(CHUNK + SPAN, base % (1 << 64), _U)]))
    return _powers[base]


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts that at cuts out of data: first and last span start, anchor and the anchor's hash of every run, in order."""
    out = []
    ends = np.repeat(at[1:], np.diff(at))
    for low in range(0, len(data) - SPAN + 1, CHUNK):
        part = data[low : low + CHUNK + SPAN - 1]
        n = len(part)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUES[part] * _power(_BASE)[:n])])
        grams = shared.mix((sums[GRAM:] - sums[:-GRAM]) * _power(pow(_BASE, -1, 1 << 64))[: n - GRAM + 1])
        least = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=_U))  # of equal hashes the last is least
        wide, size = SPAN - GRAM + 1, 1
        while size < wide:
            step = min(size, wide - size)
            least = np.minimum(least[: len(least) - step], least[step:])
            size += step
        anchor = (_LOW - (least & _LOW)).astype(np.int64)
        anchor[np.arange(low, low + len(anchor)) + SPAN > ends[low : low + len(anchor)]] = -1
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        real = anchor[first] >= 0
        first, last = first[real], last[real]
        out.append((first + low, last + low, anchor[first] + low, grams[anchor[first]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in shared.steps(batch):
            data, at = shared.utf8(step.column("text"))
            _, _, anchor, prints = runs(data, at)
            owner = np.searchsorted(at, anchor, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), step.column("row").take(pa.array(owner)), pa.array((anchor - at[owner]).astype(np.int32))], names=["print", "row", "at"])


_CONTEXT = "print bigint, doc_id {}, part binary, at int, before int, after int, head boolean, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs whose anchors are listed: print, document, anchor, starts before and after it, and the context."""
    for batch in batches:
        for step in shared.steps(batch):
            data, at = shared.utf8(step.column("text"))
            first, last, anchor, prints = runs(data, at)
            owner = np.searchsorted(at, anchor, "right") - 1
            listed = step.column("places")
            places = listed.flatten().to_numpy() + np.repeat(at[:-1], pc.list_value_length(listed).to_numpy())
            own = np.isin(anchor, places)
            first, last, anchor, prints, owner = (x[own] for x in (first, last, anchor, prints, owner))
            raw, begin = data.tobytes(), at[owner]
            for low in range(0, len(first), 5000):
                some = slice(low, low + 5000)
                held = [raw[max(s - 1, b) : e + SPAN] for s, e, b in zip(first[some].tolist(), last[some].tolist(), begin[some].tolist(), strict=True)]
                numbers = [(anchor - begin)[some], (anchor - first)[some], (last - anchor)[some]]
                arrays = [pa.array(prints[some].view(np.int64)), *(step.column(c).take(pa.array(owner[some])) for c in ("doc_id", "part")), *(pa.array(x.astype(np.int32)) for x in numbers), pa.array((first == begin)[some]), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["print", "doc_id", "part", "at", "before", "after", "head", "context"])


def intervals(prefix: list[int]) -> list[tuple[int, int, int]]:
    """The tree of an enhanced suffix array, children before parents: (length, first, last) of each interval of two or more
    suffixes; prefix[i] is what suffixes i - 1 and i have in common (prefix[0] is not looked at)."""
    found, stack = [], []
    for i in range(1, len(prefix) + 1):
        now, low = prefix[i] if i < len(prefix) else -1, i - 1
        while stack and stack[-1][0] > now:
            length, low = stack.pop()
            found.append((length, low, i - 1))
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, low))
    return found


class Suffixes:
    """The enhanced suffix array of some contexts (whole anchors): suffixes at span starts, in order, and their blocks, which
    share SPAN bytes or more. `context` and `shift` tell a suffix's row and start, `left` the byte before it."""

    def __init__(self, contexts: list[bytes], heads: np.ndarray):
        skip = (~heads).astype(np.int64)
        sizes = np.array([len(c) for c in contexts], np.int64) - skip
        starts = sizes - SPAN + 1
        wide = int(sizes.max())
        padded = np.zeros((len(contexts), 1 + 2 * wide), np.uint8)  # text bytes are one higher, so 0 ends a text: 255 is in no UTF-8
        flat = np.frombuffer(b"".join(contexts), np.uint8) + np.uint8(1)
        row = np.repeat(np.arange(len(contexts)), sizes + skip)
        first = np.cumsum(sizes + skip) - (sizes + skip)
        padded[row, np.arange(len(flat)) - first[row] + 1 - skip[row]] = flat
        self.context = np.repeat(np.arange(len(contexts)), starts)
        self.shift = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
        windows = np.lib.stride_tricks.sliding_window_view(padded, wide, 1)
        rows = np.ascontiguousarray(windows[self.context, self.shift + 1])
        order = np.argsort(rows.view(f"S{wide}").ravel(), kind="stable")
        self.context, self.shift, rows = self.context[order], self.shift[order], rows[order]
        self.left = padded[self.context, self.shift].astype(np.int64) - 1
        self.left[self.left < 0] = _HEAD
        self.size = (sizes[self.context] - self.shift).astype(np.int64)
        unlike = rows[1:] != rows[:-1]
        common = np.where(unlike.any(1), unlike.argmax(1), wide)
        self.prefix = np.concatenate([[0], np.minimum(common, np.minimum(self.size[1:], self.size[:-1]))]).astype(np.int64)
        self.block = np.cumsum(self.prefix < SPAN) - 1

    def groups(self, copies: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The maximal repeats: (length, first, last) over the suffixes. copies: how often each suffix's context occurs."""
        begins = np.flatnonzero(np.diff(self.block, prepend=-1))
        sizes = np.diff(np.append(begins, len(self.block)))
        pair = begins[sizes == 2]
        for i in pair[(self.left[pair] != self.left[pair + 1]) | (self.left[pair] == _HEAD)].tolist():
            yield int(self.prefix[i + 1]), i, i + 1
        for low, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            left = self.left[low : low + n]
            for length, a, b in intervals(self.prefix[low : low + n].tolist()):
                if left[a : b + 1].min() != left[a : b + 1].max() or left[a] == _HEAD:
                    yield length, low + a, low + b
        alone = np.flatnonzero((copies > 1) & (self.left == _HEAD))  # copies of a text's beginning, to the end of the context
        for i in alone.tolist():
            longest = max(int(self.prefix[i]), int(self.prefix[i + 1]) if i + 1 < len(self.prefix) else 0)
            if longest < self.size[i]:
                yield int(self.size[i]), i, i


def _ranks(docs: pa.Array, parts: pa.Array) -> np.ndarray:
    """The place of each document in their order."""
    table = pa.table({"known": pc.is_valid(docs), "doc": pc.fill_null(docs, 0), "part": parts})
    order = pc.sort_indices(table, [("known", "ascending"), ("doc", "ascending"), ("part", "ascending")]).to_numpy()
    sorted_ = table.take(pa.array(order))
    same = np.ones(len(order), bool)
    for c in table.column_names:
        x = sorted_.column(c).combine_chunks()
        same[1:] &= pc.equal(x.slice(1), x.slice(0, max(len(x) - 1, 0))).to_numpy(zero_copy_only=False)
    same[:1] = False
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~same)
    return out


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole anchors (rows come sorted by print), of about SUFFIXES suffixes."""
    held, ready, total = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        prints = batch.column("print").to_numpy()
        if held and held[-1].column("print")[-1].as_py() != prints[0]:
            ready, held = ready + held, []
        sums = np.concatenate([[0], np.cumsum(batch.column("before").to_numpy().astype(np.int64) + batch.column("after").to_numpy() + 1)])
        cuts, low = (np.flatnonzero(prints[1:] != prints[:-1]) + 1).tolist(), 0
        for cut in cuts:
            if total + sums[cut] - sums[low] > SUFFIXES or cut == cuts[-1]:
                ready, held, total, low = [*ready, *held, batch.slice(low, cut - low)], [], total + int(sums[cut] - sums[low]), cut
            if total > SUFFIXES:
                yield pa.Table.from_batches(ready)
                ready, total = [], 0
        held.append(batch.slice(low))
        total += int(sums[-1] - sums[low])
    if ready or held:
        yield pa.Table.from_batches(ready + held)


def _array(table: pa.Table) -> tuple[Suffixes, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of a table of whole anchors; each suffix's copies, its place among all starts, and the first of its block."""
    table = table.combine_chunks()
    one = lambda c: table.column(c).combine_chunks()
    array = Suffixes(one("context").to_pylist(), one("head").to_numpy(zero_copy_only=False))
    first = one("first")
    ranks = _ranks(first.field("doc_id"), first.field("part"))
    start = first.field("at").to_numpy().astype(np.int64) - one("before").to_numpy()
    place = (ranks[array.context] << 31) + start[array.context] + array.shift
    begins = np.flatnonzero(np.diff(array.block, prepend=-1))
    least = np.minimum.reduceat(place, begins)[array.block]
    return array, one("n").to_numpy()[array.context], place, least


_COVERED = "doc_id {}, part binary, start int, mask bigint, repeats bigint"


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the first document of each context: which of its starts have an earlier equal span, and how many maximal repeats
    begin there first."""
    for table in _by_anchor(batches):
        array, copies, place, least = _array(table)
        masks, repeats = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
        later = place != least
        np.bitwise_or.at(masks, array.context[later], np.int64(1) << array.shift[later])
        for _, low, high in array.groups(copies):
            repeats[array.context[low + int(place[low : high + 1].argmin())]] += 1
        first = table.column("first").combine_chunks()
        start = first.field("at").to_numpy() - table.column("before").to_numpy()
        out = pa.RecordBatch.from_arrays([first.field("doc_id"), first.field("part"), pa.array(start.astype(np.int32)), pa.array(masks), pa.array(repeats)], names=["doc_id", "part", "start", "mask", "repeats"])
        yield out.filter(pa.array((masks != 0) | (repeats > 0)))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each context of each maximal repeat: the repeat (anchor, number), its length, and where in the context it begins."""
    for table in _by_anchor(batches):
        array, copies, _, _ = _array(table)
        number, length, who, shift = [], [], [], []
        for i, (size, low, high) in enumerate(array.groups(copies)):
            number += [i] * (high + 1 - low)
            length += [size] * (high + 1 - low)
            who += array.context[low : high + 1].tolist()
            shift += array.shift[low : high + 1].tolist()
        take = lambda c: table.column(c).combine_chunks().take(pa.array(who, pa.int64()))
        yield pa.RecordBatch.from_arrays([take("print"), take("key"), pa.array(number, pa.int32()), pa.array(length, pa.int32()), pa.array(shift, pa.int32())], names=["print", "key", "number", "length", "shift"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's removed runs from its covered starts."""
    for batch in batches:
        begins, ends = [], []
        for starts, masks in zip(batch.column("starts"), batch.column("masks"), strict=True):
            first, mask = starts.values.to_numpy(zero_copy_only=False).astype(np.int64), masks.values.to_numpy(zero_copy_only=False)
            bits = np.unpackbits(np.ascontiguousarray(mask).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, shift = np.nonzero(bits)
            at = np.unique(first[row] + shift)
            new = np.flatnonzero(np.diff(at, prepend=-SPAN - 1) > SPAN)
            begins.append(at[new])
            ends.append(at[np.append(new[1:], len(at)) - 1] + SPAN if len(at) else at)
        arrays = [batch.column(c) for c in ("doc_id", "part", "repeats")]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([x.astype(np.int32) for x in xs], pa.list_(pa.int32())) for xs in (begins, ends))], names=["doc_id", "part", "repeats", "begins", "ends"])


class Repeats:
    """The tables of one corpus: `copies` (documents whose text an earlier one has whole), `found` (runs of repeated anchors),
    `classes` (their distinct contexts) and `held` (how many contexts an anchor has)."""

    def __init__(self, docs: DataFrame):
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        text = F.coalesce("text", F.lit(""))
        self.docs = docs.select("doc_id", text.alias("text"), F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("part"))
        long = self.docs.filter(F.octet_length("text") >= SPAN)
        ids = shared.written(long.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("times")), "documents")
        owners = ids.groupBy("part").agg(F.min(F.struct("doc_id")).alias("owner"), F.count(F.lit(1)).alias("held")).filter("held > 1")
        owned = shared.spread_join(ids.select("doc_id", "part"), shared.written(owners, "owners"), "part")
        self.copies = shared.written(owned.filter(F.col("owner").isNotNull() & ~F.col("owner.doc_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "part"), "copies")
        once = _without(long, shared.checked_broadcast(self.copies))
        if ids.filter("times > 1").limit(1).count():
            once = once.dropDuplicates(["doc_id", "part"])  # only where a row comes again
        once = once.withColumn("row", F.xxhash64("doc_id", "part"))

        before = shared.made()
        every = shared.written(once.select("row", "text").mapInArrow(_find, "print bigint, row bigint, at int"), "anchors")
        again = shared.written(every.groupBy("print").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "repeated-anchors")
        every = shared.spread_join(every, again.withColumn("again", F.lit(True)), "print").filter("again")
        used = shared.made_since(before)
        places = shared.written(every.groupBy("row").agg(F.collect_list("at").alias("places")), "places")  # a document's own
        shared.discard(docs.sparkSession, used)
        size = places.agg(F.sum(F.size("places"))).first()[0] or 0
        listed = once.join(F.broadcast(places) if size <= BROADCAST_PLACES else places, "row").select("doc_id", "part", "text", "places")
        found = listed.mapInArrow(_contexts, _CONTEXT.format(self.kind))
        self.found = shared.written(found.withColumn("key", F.xxhash64("print", "context", "before", "head")), "contexts")
        classes = self.found.groupBy("print", "key", "context", "before", "after", "head").agg(F.min(F.struct("doc_id", "part", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        self.classes = shared.written(classes, "classes")
        self.held = shared.written(self.classes.groupBy("print").agg(F.count(F.lit(1)).alias("contexts"), F.max(F.col("head") & (F.col("n") > 1)).alias("begun")).filter("contexts > 1 or begun"), "shared-anchors")
        hot = self.held.filter(F.col("contexts") > HOT_CONTEXTS).select("print")  # a row for HOT_CONTEXTS contexts
        self.hot = shared.checked_broadcast(shared.written(hot, "hot-anchors"))

    def _cold(self) -> DataFrame:
        """The contexts of anchors with HOT_CONTEXTS at most, an anchor's together."""
        own = self.classes.join(self.hot, "print", "left_anti").join(self.held.filter(F.col("contexts") <= HOT_CONTEXTS).select("print"), "print")
        return own.repartition("print").sortWithinPartitions("print")

    def _spans(self) -> tuple[DataFrame, DataFrame]:
        """Of the other anchors: every span of their contexts, and sums by span for those in two contexts or more."""
        own = self.classes.join(self.hot, "print")
        rows = own.select("print", "key", "first", "before", "head", "n", "context", F.explode(F.sequence(F.lit(0), F.col("before") + F.col("after"))).alias("shift"))
        begin = F.col("shift") + F.when(F.col("head"), 1).otherwise(2)
        span = F.col("context").substr(begin, F.lit(SPAN))
        left = F.when(begin > 1, F.col("context").substr(begin - 1, F.lit(1)))
        rest = F.col("context").substr(begin + SPAN, F.lit(SPAN))
        start = F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.part").alias("part"), (F.col("first.at") - F.col("before") + F.col("shift")).alias("start"))
        named = [F.xxhash64("print", F.col("before") - F.col("shift"), span).alias("one"), F.xxhash64(F.lit(1), span, "print").alias("two")]
        rows = shared.written(rows.select(*named, "print", "key", "shift", start.alias("at"), "n", left.alias("left"), rest.alias("rest")), "spans")
        sums = rows.groupBy("one", "two").agg(
            F.count(F.lit(1)).alias("held"), F.min("at").alias("least"), F.sum("n").alias("copies"), F.min("rest").alias("low"), F.max("rest").alias("high"),
            (F.max(F.col("left").isNull()) | (F.min("left") != F.max("left"))).alias("diverse"),
        )
        return rows, shared.written(sums.filter("held > 1 or (diverse and copies > 1)"), "span-sums")

    def covered(self) -> DataFrame:
        """doc_id, part, repeats, begins, ends: the removed runs of every document that has any (or begins a maximal repeat)."""
        same = ["print", "key"]
        cold = self._cold().mapInArrow(_covered, _COVERED.format(self.kind))
        rows, sums = self._spans()
        met = shared.spread_join(rows.select("one", "two", "at"), sums.select("one", "two", "held", "least", F.col("diverse").cast("bigint").alias("diverse")), ["one", "two"]).filter("least is not null")
        first = F.col("least") == F.col("at")
        hot = met.select("at.doc_id", "at.part", "at.start", F.when(first, 0).otherwise(1).cast("bigint").alias("mask"), F.when(first, F.coalesce("diverse", F.lit(0))).otherwise(0).cast("bigint").alias("repeats"))
        many = shared.written(self.classes.filter("n > 1").select(*same, "first", F.col("n").alias("held")), "copied-contexts")
        rest = shared.spread_join(self.found.select(*same, "doc_id", "part", "at", "before", "after"), many, same).filter("first is not null")
        rest = rest.filter(F.struct("doc_id", "part", "at") != F.col("first"))
        whole = F.expr("shiftleft(1L, before + after + 1) - 1")
        copied = rest.select("doc_id", "part", (F.col("at") - F.col("before")).alias("start"), whole.alias("mask"), F.lit(0).cast("bigint").alias("repeats"))
        every = cold.union(hot).union(copied)
        by = every.groupBy("doc_id", "part").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"), F.sum("repeats").alias("repeats"))  # a document's own
        merged = by.mapInArrow(_merged, f"doc_id {self.kind}, part binary, repeats bigint, begins array<int>, ends array<int>")
        whole_texts = self.copies.select("doc_id", "part", F.lit(0).cast("bigint").alias("repeats"), F.array(F.lit(0)).alias("begins"), F.array(F.lit((1 << 31) - 1)).alias("ends"))
        return merged.union(whole_texts)

    def maximal_repeats(self) -> DataFrame:
        """A row for each occurrence of each maximal repeat: repeat, length, doc_id, part, start. Documents that are whole copies
        of another stand in `copies`. Of an anchor in more than HOT_CONTEXTS contexts, the longest prefix that all share."""
        cold = self._cold().mapInArrow(_grouped, "print bigint, key bigint, number int, length int, shift int")
        cold = cold.select(F.xxhash64("print", "number").alias("repeat"), "print", "key", "length", "shift")
        rows, sums = self._spans()
        byte = lambda c, i: F.col(c).substr(i, F.lit(1))
        alike = F.aggregate(F.sequence(F.lit(1), F.octet_length("low")), F.lit(0), lambda n, i: F.when((n == i - 1) & (byte("low", i) == byte("high", i)), i).otherwise(n))
        length = F.lit(SPAN) + F.when(F.octet_length("low") > 0, alike).otherwise(0)
        tops = sums.filter("diverse").select("one", "two", "held", length.cast("int").alias("length"))
        hot = shared.spread_join(rows.select("one", "two", "print", "key", "shift"), tops, ["one", "two"]).filter("length is not null")
        groups = shared.written(cold.union(hot.select(F.xxhash64("one", "two").alias("repeat"), "print", "key", "length", "shift")), "maximal-repeats")
        same = ["print", "key"]
        own = self.found.select(*same, "doc_id", "part", "at", "before")
        many = shared.checked_broadcast(shared.written(self.classes.filter(F.col("n") > shared.HOT_ROWS).select(*same), "hot-contexts"))
        few = own.join(groups.join(many, same, "left_anti"), same)
        rest = own.join(many, same, "left_semi").join(shared.checked_broadcast(shared.written(groups.join(many, same, "left_semi"), "hot-repeats")), same)
        return few.unionByName(rest).select("repeat", "length", "doc_id", "part", (F.col("at") - F.col("before") + F.col("shift")).alias("start"))


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["part"] == b["part"])


def _without(docs: DataFrame, copies: DataFrame) -> DataFrame:
    return docs.join(copies, _same_document(docs, copies), "left_anti")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, digests = [], [], [], []
        for text, begins, ends in zip(batch.column("text"), batch.column("begins"), batch.column("ends"), strict=True):
            raw = text.as_buffer()
            begins, ends = (begins.as_py() or [], [min(e, len(raw)) for e in ends.as_py() or []])
            kept, at = hashlib.sha256(), 0
            for b, e in zip(begins, ends, strict=True):
                kept.update(raw[at:b])
                at = e
            kept.update(raw[at:])
            sizes.append(len(raw))
            removed.append(sum(ends) - sum(begins))
            spans.append(len(begins))
            digests.append(kept.hexdigest())
        arrays = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string()), batch.column("repeats")]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeats"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of what is left, and the maximal repeats that begin in it first."""
    tables = Repeats(docs)
    spans = shared.written(tables.covered(), "removed")
    spans = shared.checked_broadcast(spans) if (spans.agg(F.sum(F.size("begins"))).first()[0] or 0) <= shared.BROADCAST_ROWS * 2 else spans
    rows = tables.docs.join(spans, _same_document(tables.docs, spans), "left").select(tables.docs["doc_id"], "text", "begins", "ends", F.coalesce("repeats", F.lit(0)).cast("bigint").alias("repeats"))
    return rows.mapInArrow(_kept, f"doc_id {tables.kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_repeats bigint")


def op11_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_repeats")


def sql() -> str:
    """The same in plain SQL for DuckDB: every SPAN bytes of every text."""
    return f"""with docs as (select row_number() over () as r, doc_id, hex(coalesce(text, '')) as h, strlen(coalesce(text, '')) as n from documents),
        starts as (select r, doc_id, unnest(range(0, n - {SPAN} + 1)) as p, h from docs where n >= {SPAN}),
        spans as (select r, doc_id, p, md5_number(substr(h, 2 * p + 1, {2 * SPAN})) as w from starts),
        later as (select r, p from spans qualify row_number() over (partition by w order by doc_id, p) > 1),
        marked as (select r, p, case when p - lag(p) over (partition by r order by p) <= {SPAN} then 0 else 1 end as new from later),
        numbered as (select r, p, sum(new) over (partition by r order by p) as k from marked),
        removed as (select r, min(p) as b, max(p) + {SPAN} as e from numbered group by r, k),
        gaps as (select r, coalesce(lag(e) over (partition by r order by b), 0) as f, b as t, e - b as size from removed),
        sums as (select docs.r, count(*) as n_spans, sum(size) as n_removed, string_agg(substr(h, (2 * f + 1)::int, (2 * (t - f))::int), '' order by t) || substr(any_value(h), (2 * max(t + size) + 1)::int) as kept from gaps join docs using (r) group by docs.r)
        select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from docs left join sums using (r)"""
