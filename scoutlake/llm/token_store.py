"""Token ids as files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Model. A frame lists its ids by falling frequency; an id's rank in this list is its symbol. Within a block a symbol is one of
16 events: the symbol that last followed the two before it (order 2), the one that last followed the one before it (order 1),
or its rank's bit length (order 0), whose lower bits follow. Three predictors give the event's probability: its frequency in
the block, its frequency after the order-1 state and after the order-2 state (no candidate, candidate that failed last,
candidate that held last). They are mixed by weights that follow how much probability each gave to what came. All is integer
arithmetic, so any machine decodes what another wrote.

Blocks of one frame are coded side by side as numpy vectors, one symbol of every block a step. A block starts with an empty
model, and carries its number of words and their crc32, which is checked before it is decoded; the list of ids has its own.
Ids beyond the 65535 commonest of a frame share one symbol and follow in whole beside the list.

Files. Documents are dealt by ascending id over partitions (shards); a shard is a sequence of frames, rows of a Parquet table
with whole documents: ids, token counts, the tokens before them in the shard, and the blocks. Frames are bounded by
FRAME tokens (or one document), and steps by GROUP blocks, so memory is bounded whatever the documents' sizes.

Defined results: a null text is empty and has the end id alone; rows with equal ids lie side by side in the order of their
texts' hashes; rows with a null id come first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import pretokens, shared

END_ID = 0
#: Tokens of a frame, and blocks that are coded side by side.
FRAME, GROUP = 8 << 20, 2048
#: Pre-tokens that a worker remembers; then it forgets them all.
REMEMBERED = 2_000_000

_SYMBOLS, _STATES, _BITS = 16, 3, 15
_HIT2, _HIT1, _RANK = 0, 1, 2
#: Bits that follow each event: none for hits and rank 0, all 16 of ranks of more than 12 bits.
_EXTRA = np.array([0, 0, 0, *range(12), 16], np.uint64)
_LENGTH_OF = np.frexp(np.arange(1 << 16))[1].astype(np.int8)  # the bit length; exact for small whole numbers
#: For each rank its event and the bits that follow.
_EVENT_OF = (_RANK + np.minimum(_LENGTH_OF, 13)).astype(np.int8)
_LOW_OF = np.where(_LENGTH_OF > 12, np.arange(1 << 16), np.arange(1 << 16) - np.where(_LENGTH_OF > 0, 1 << np.maximum(_LENGTH_OF.astype(np.int64) - 1, 0), 0)).astype(np.uint16)
#: The symbol of ids that are not listed.
_RARE = (1 << 16) - 1
#: A block's model is renewed after so many symbols at most.
_RENEWED = 512
_SLOTS = 12
_WORD = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)
_U = np.uint64
_BYTES = np.uint64(0x0101010101010101)
#: What a slot holds above its id: its state after a candidate that failed, and after one that held.
_HELD = np.array([1 << 17, 2 << 17], np.int32)


def _letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: 0x100 + i for i, b in enumerate(others)}


_LETTERS = _letters()


class TextEncoder:
    """A tokenizer file's ids of whole texts: each distinct pre-token goes through the library once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        steps = self.library.pre_tokenizer
        #: A pre-token is one word of the library's model, in its letters for bytes, if nothing else comes before the model.
        self.plain = self.library.normalizer is None and isinstance(steps, ByteLevel) and not steps.add_prefix_space
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memory = pretokens.Memory([np.uint32], REMEMBERED)

    def _ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of some texts by the library, and where each text's begin."""
        if self.plain:
            word = self.library.model.tokenize
            flat, sizes = array.array("I"), []
            for x in texts:
                made = word(x.encode().decode("latin-1").translate(_LETTERS))
                sizes.append(len(made))
                flat.extend([t.id for t in made])
            return [(np.array(flat, np.uint32), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))]
        found = self._ids_whole(texts)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        return [(np.fromiter((i for x in found for i in x), np.uint32, int(bounds[-1])), bounds)]

    def _ids_whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for at in range(0, len(texts), 20_000) for x in self.library.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, and where each text's begin."""
        tokens = pretokens.pretokens(texts, lowered=False, marks=self.special)
        ids, sizes = self.memory.values(0, self.memory.find(tokens, self._ids))
        bounds = np.concatenate(([0], np.cumsum(sizes)))[tokens.bounds]
        odd = np.flatnonzero(tokens.unusual).tolist()
        return pretokens.put_in(ids, bounds, odd, [self.library.encode(texts[i].as_py(), add_special_tokens=False).ids for i in odd])


@functools.lru_cache(2)
def _encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


class _Mixer:
    """The events' counts of each block by order, and the weights of the orders."""

    def __init__(self, blocks: int):
        self.counts = [np.zeros((blocks, *((_STATES,) * (k > 0)), _SYMBOLS), np.int64) for k in range(3)]
        self.gave = [np.full(blocks, 1 << 10, np.int64) for _ in range(3)]
        self.shares = [self._share(c) for c in self.counts]

    @staticmethod
    def _share(counts: np.ndarray) -> np.ndarray:
        return ((counts * 32 + 1) << 16) // (counts.sum(axis=-1, keepdims=True) * 32 + _SYMBOLS)

    def table(self) -> np.ndarray:
        """For each block and pair of states (order 2 * 3 + order 1) the events' cumulative frequencies, 17 in a row."""
        weight = [(g * g >> 10) + 1 for g in self.gave]
        zero, one, two = (s * w.reshape(-1, *(1,) * (s.ndim - 1)) for s, w in zip(self.shares, weight, strict=True))
        mixed = (zero[:, None, None, :] + one[:, None, :, :] + two[:, :, None, :]) // sum(weight)[:, None, None, None]
        freq = (mixed * ((1 << _BITS) - _SYMBOLS) >> 16) + 1
        out = np.zeros((*freq.shape[:3], _SYMBOLS + 1), np.uint64)
        np.cumsum(freq, axis=-1, out=out[..., 1:], dtype=np.uint64)
        return out.reshape(len(freq), _STATES * _STATES, _SYMBOLS + 1)

    def update(self, states: np.ndarray, events: np.ndarray) -> None:
        """Counts what each block (a row) has shown since the last table."""
        n = len(states)
        key = (np.arange(n)[:, None] * _STATES * _STATES + states) * _SYMBOLS + events
        new = np.bincount(key.ravel(), minlength=n * _STATES * _STATES * _SYMBOLS).reshape(n, _STATES, _STATES, _SYMBOLS)
        for k, more in enumerate((new.sum(axis=(1, 2)), new.sum(axis=1), new.sum(axis=2))):
            gave = (more * self.shares[k]).reshape(n, -1).sum(axis=1) // max(1, events.shape[1])
            self.gave[k] = (self.gave[k] + gave) >> 1
            self.counts[k] += more
            self.shares[k] = self._share(self.counts[k])


def _windows(length: int) -> list[tuple[int, int]]:
    """The spans between which the model is renewed: short at first."""
    edges = [0, 32, 64]
    while edges[-1] < length:
        edges += [edges[-1] * 3 // 2, edges[-1] * 2] if edges[-1] < _RENEWED else [edges[-1] + _RENEWED]
    edges = sorted({min(e, length) for e in edges})
    return list(zip(edges, edges[1:], strict=False))


def _slot(one: np.ndarray, two: np.ndarray | None) -> np.ndarray:
    mixed = one.astype(np.uint32) * np.uint32(0x9E3779B1)
    if two is not None:
        mixed = (mixed ^ two.astype(np.uint32)) * np.uint32(0x85EBCA6B)
    return (mixed >> np.uint32(32 - _SLOTS)).astype(np.uint16)


def _before(slots: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of each block the id that last followed its slot (-1: none), and the slot's state."""
    rows, length = ids.shape
    order = np.argsort(slots, axis=1, kind="stable")
    sorted_slots, sorted_ids = np.take_along_axis(slots, order, 1), np.take_along_axis(ids, order, 1)
    same = np.zeros((rows, length), bool)
    same[:, 1:] = sorted_slots[:, 1:] == sorted_slots[:, :-1]
    last = np.full((rows, length), -1, np.int32)
    last[:, 1:] = np.where(same[:, 1:], sorted_ids[:, :-1], -1)
    held = last == sorted_ids
    state = same.astype(np.int8)
    state[:, 1:] += same[:, 1:] & held[:, :-1]
    candidate, states = np.empty_like(last), np.empty_like(state)
    np.put_along_axis(candidate, order, last, 1)
    np.put_along_axis(states, order, state, 1)
    return candidate, states


def _shifted(ids: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(ids)
    out[:, by:] = ids[:, :-by] if by < ids.shape[1] else 0
    return out


def _events(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of some blocks its event, the lower bits of its rank (0 after a hit), and the pair of states before it."""
    one, two = _shifted(ids, 1), _shifted(ids, 2)
    candidate1, state1 = _before(_slot(one, None), ids)
    candidate2, state2 = _before(_slot(one, two), ids)
    events = np.where(candidate2 == ids, np.int8(_HIT2), np.where(candidate1 == ids, np.int8(_HIT1), _EVENT_OF.take(ids)))
    return events, np.where(events >= _RANK, _LOW_OF.take(ids), np.uint16(0)), state2 * np.int8(_STATES) + state1


def _encode_group(ids: np.ndarray) -> list[bytes]:
    """The blocks of symbols (rows of one length, below 2 ** 16)."""
    rows, length = ids.shape
    ids = ids.astype(np.int32)
    # some blocks at a time, so that what is made on the way stays small
    events, value, states = (np.concatenate(x) for x in zip(*(_events(ids[r : r + 64]) for r in range(0, rows, 64)), strict=True))
    mixer, at = _Mixer(rows), np.arange(rows)[:, None] * (_STATES * _STATES)
    below, width = np.empty((length, rows), np.uint16), np.empty((length, rows), np.uint16)
    for first, last in _windows(length):
        table, s, e = mixer.table(), states[:, first:last], events[:, first:last]
        place, flat = (at + s) * (_SYMBOLS + 1) + e, table.astype(np.uint16).ravel()
        low_edge = flat.take(place)
        below[first:last], width[first:last] = low_edge.T, (flat.take(place + 1) - low_edge).T
        mixer.update(s, e)
    extra, value = _EXTRA.astype(np.uint8).take(events.T), np.ascontiguousarray(value.T)
    words, used = np.zeros((rows, length + 2), np.uint32), np.zeros(rows, np.int64)
    base, size = np.zeros(rows, _U), np.full(rows, (1 << 64) - 1, _U)
    for t in range(length):
        part = size >> _U(_BITS)
        size = (part * width[t]) >> extra[t]
        base += part * below[t] + size * value[t]
        small = np.flatnonzero(size <= _LOW)
        if len(small):
            b, s = base[small], size[small]
            s = np.where((b ^ (b + s - _U(1))) > _LOW, _LOW + _U(1) - (b & _LOW), s)
            words[small, used[small]] = b >> _WORD
            used[small] += 1
            base[small], size[small] = b << _WORD, s << _WORD
    each = np.arange(rows)
    words[each, used], words[each, used + 1] = base >> _WORD, base & _LOW
    return [words[r, : used[r] + 2].astype("<u4").tobytes() for r in range(rows)]


def _decode_group(blocks: list[bytes], length: int) -> np.ndarray:
    """What _encode_group was given."""
    rows = len(blocks)
    sizes = np.array([len(b) // 4 for b in blocks])
    words = np.zeros((rows, sizes.max() + 2), _U)
    for r, b in enumerate(blocks):
        words[r, : sizes[r]] = np.frombuffer(b, "<u4")
    each, used = np.arange(rows), np.full(rows, 2)
    base, size = np.zeros(rows, _U), np.full(rows, (1 << 64) - 1, _U)
    off = (words[:, 0] << _WORD) | words[:, 1]
    tables = [np.zeros(rows << _SLOTS, np.int32) for _ in range(2)]  # state << 17 | id + 1
    first_of = np.concatenate((np.zeros(_RANK + 1, np.int32), 1 << np.arange(12, dtype=np.int32), [0]))  # the least rank of an event
    slot_row = each << _SLOTS
    one, two = np.zeros(rows, np.int32), np.zeros(rows, np.int32)
    mixer, out = _Mixer(rows), np.empty((length, rows), np.int32)
    row_of = each * (_STATES * _STATES)
    for first, last in _windows(length):
        table = mixer.table().reshape(-1, _SYMBOLS + 1)
        edges, flat = table[:, 1:].astype(np.uint16), table.ravel()
        edges[:, -1] = np.iinfo(np.uint16).max  # beyond every target
        states, events = np.empty((last - first, rows), np.int64), np.empty((last - first, rows), np.int64)
        for t in range(first, last):
            at1 = slot_row + _slot(one, None)
            at2 = slot_row + _slot(one, two)
            held1, held2 = tables[0].take(at1), tables[1].take(at2)
            state = (held2 >> 17) * _STATES + (held1 >> 17)
            row = row_of + state
            part = size >> _U(_BITS)
            target = (off // part).astype(np.uint16)
            # a row's 16 comparisons are bytes of 0 or 1, which two words add up
            passed = (edges.take(row, axis=0) <= target[:, None]).view(_U)
            event = (((passed[:, 0] + passed[:, 1]) * _BYTES) >> _U(56)).astype(np.int64)
            place = row * (_SYMBOLS + 1) + event
            below = flat.take(place)
            extra = _EXTRA.take(event)
            size = (part * (flat.take(place + 1) - below)) >> extra
            moved = part * below
            value = (off - moved) // size
            moved += size * value
            off -= moved
            base += moved
            known1, known2 = held1 & 0x1FFFF, held2 & 0x1FFFF
            kept = value.astype(np.int32) + first_of.take(event) + np.int32(1)
            kept = np.where(event >= _RANK, kept, np.where(event == _HIT2, known2, known1))
            tables[0].put(at1, kept + _HELD.take(known1 == kept))
            tables[1].put(at2, kept + _HELD.take(known2 == kept))
            ids = kept - np.int32(1)
            out[t] = ids
            states[t - first], events[t - first] = state, event
            one, two = ids, one
            small = np.flatnonzero(size <= _LOW)
            if len(small):
                b, s = base[small], size[small]
                s = np.where((b ^ (b + s - _U(1))) > _LOW, _LOW + _U(1) - (b & _LOW), s)
                off[small] = (off[small] << _WORD) | words[small, np.minimum(used[small], words.shape[1] - 1)]
                used[small] += 1
                base[small], size[small] = b << _WORD, s << _WORD
        mixer.update(states.T, events.T)
    return out.T


def block_length(tokens: int) -> int:
    """Long blocks compress better; a small frame has shorter ones, so that many are coded side by side."""
    return min(max(tokens, 1), 4096 if tokens >= 1 << 20 else 2048 if tokens >= 1 << 18 else 1024)


def _groups(blocks):
    """Blocks to be coded side by side: groups of about one size, none above GROUP."""
    n = len(blocks)
    k = -(-n // GROUP)
    return [blocks[n * i // k : n * (i + 1) // k] for i in range(k)]


def encode_ids(ids: np.ndarray) -> tuple[int, bytes, bytes]:
    """The length of a block, the list of ids, and the blocks of ids (each: its number of bytes, their crc32, its bytes)."""
    most = int(ids.max()) if len(ids) else 0
    if most < 1 << 22:
        values, where = np.arange(most + 1, dtype=np.uint32), ids
        counts = np.bincount(ids, minlength=most + 1)
    else:
        values, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))[: np.count_nonzero(counts)]
    rank = np.zeros(len(values), np.int32)
    rank[order] = np.arange(len(order))
    symbols = np.minimum(rank, _RARE)[where]
    rare = ids[symbols == _RARE]
    listed = zlib.compress(np.concatenate(([min(len(order), _RARE)], values[order][:_RARE], rare)).astype("<u4").tobytes(), 1)
    length = block_length(len(ids))
    padded = np.zeros(-(-len(ids) // length) * length, np.int32)
    padded[: len(ids)] = symbols
    padded = padded.reshape(-1, length)
    made = [b for group in _groups(padded) for b in _encode_group(group)]
    return length, zlib.crc32(listed).to_bytes(4, "little") + listed, b"".join(len(b).to_bytes(4, "little") + zlib.crc32(b).to_bytes(4, "little") + b for b in made)


def decode_ids(listed: bytes, data: bytes, length: int, tokens: int) -> np.ndarray:
    """The ids of encode_ids' list and blocks; ValueError where a checksum is wrong."""
    if zlib.crc32(listed[4:]) != int.from_bytes(listed[:4], "little"):
        raise ValueError("the list of ids is damaged")
    values = np.frombuffer(zlib.decompress(listed[4:]), "<u4")
    known, rare = values[1 : values[0] + 1], values[values[0] + 1 :]
    blocks, at = [], 0
    while at < len(data):
        size, crc = (int.from_bytes(data[i : i + 4], "little") for i in (at, at + 4))
        block = data[at + 8 : at + 8 + size]
        if len(block) != size or zlib.crc32(block) != crc:
            raise ValueError(f"block {len(blocks)} is damaged")
        blocks.append(block)
        at += 8 + size
    parts = [_decode_group(group, length).ravel() for group in _groups(blocks)]
    symbols = np.concatenate([*parts, np.zeros(0, np.int32)])[:tokens]
    out = np.append(known, np.uint32(0))[np.minimum(symbols, len(known))]
    out[symbols == _RARE] = rare
    return out


_FRAME = "shard int, nth int, before bigint, docs array<{id}>, sizes array<int>, n_tokens bigint, length int, listed binary, blocks binary"


def token_files(docs: DataFrame, vocabulary: str, path: str, id_column: str = "doc_id", end_id: int = END_ID, frame: int = FRAME) -> None:
    """Writes the ids of all texts of docs, in ascending order of their ids, as a table of frames at path."""
    kind = docs.schema[id_column].dataType
    order = ["doc", "_hash"]
    dealt = docs.select(F.col(id_column).alias("doc"), F.xxhash64("text").alias("_hash"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _FRAME.format(id=kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder, end = TaskContext.get().partitionId(), _encoder(vocabulary), np.uint32(end_id)
        nth = before = total = 0
        held: list[np.ndarray] = []
        sizes_held: list[np.ndarray] = []
        docs_held: list = []

        def made() -> pa.RecordBatch:
            length, listed, blocks = encode_ids(np.concatenate(held))
            names = pa.concat_arrays(docs_held)
            columns = [pa.array([shard], pa.int32()), pa.array([nth], pa.int32()), pa.array([before], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)]
            sizes = np.concatenate(sizes_held)
            columns += [shared.lists(sizes, np.array([0, len(sizes)]), pa.int32()), pa.array([total], pa.int64()), pa.array([length], pa.int32()), pa.array([listed], pa.binary()), pa.array([blocks], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "nth", "before", "docs", "sizes", "n_tokens", "length", "listed", "blocks"])

        for whole in batches:
            for batch in shared.steps(whole):
                ids, bounds = encoder.encode(batch.column("text"))
                ids = np.insert(ids, bounds[1:], end)
                bounds = bounds + np.arange(len(bounds))
                sizes, names = np.diff(bounds), batch.column("doc")
                first = 0
                while first < len(sizes):
                    # as many documents as the frame has room for, one at least
                    last = int(np.searchsorted(bounds, bounds[first] + frame - total, "right")) - 1
                    last = max(last, first + (total == 0))
                    if last > first:
                        held.append(ids[bounds[first] : bounds[last]])
                        sizes_held.append(sizes[first:last].astype(np.int32))
                        docs_held.append(names.slice(first, last - first))
                        total += int(bounds[last] - bounds[first])
                    if last < len(sizes):
                        yield made()
                        before, nth, total, held, sizes_held, docs_held = before + total, nth + 1, 0, [], [], []
                    first = last
        if held:
            yield made()

    dealt.select("doc", "text").mapInArrow(run, schema).write.parquet(path)


def read_files(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """id_column, start, n_tokens, ids_crc32 for each document of the files at path, from their decoded ids."""
    frames = spark.read.parquet(path)
    kind = frames.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, before, tokens, length = (batch.column(c)[i].as_py() for c in ("shard", "before", "n_tokens", "length"))
                ids = decode_ids(*(batch.column(c)[i].as_buffer().to_pybytes() for c in ("listed", "blocks")), length, tokens).astype("<u4")
                sizes = batch.column("sizes")[i].values.to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                columns = [batch.column("docs")[i].values, pa.array(np.full(len(sizes), shard, np.int32)), pa.array(before + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "shard", "at", "n_tokens", "ids_crc32"])

    read = frames.select("shard", "before", "docs", "sizes", "n_tokens", "length", "listed", "blocks").mapInArrow(run, f"doc {kind}, shard int, at bigint, n_tokens bigint, ids_crc32 bigint")
    totals = sorted((r["shard"], r["n"]) for r in frames.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())  # one row for each shard
    starts, total = [], 0
    for shard, n in totals:
        starts.append((shard, total))
        total += n
    starts = spark.createDataFrame(starts, "shard int, first bigint")
    out = read.join(F.broadcast(starts), "shard")
    return out.select(F.col("doc").alias(id_column), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "tokens")
    token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), path)
    return read_files(spark, path)
