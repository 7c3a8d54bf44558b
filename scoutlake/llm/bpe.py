"""BPE encoding by backtracking over longest matches, and decoding from an offset table.

A pre-token's ids are the one split into tokens in which every neighbouring pair is compatible: merging the two tokens'
symbols by rank gives these two tokens again. An Aho-Corasick automaton finds the tokens that begin at each place; the
encoder takes the longest, steps back to a shorter one where no compatible token follows, and marks places that lead
nowhere, so each place is left once. Compatible pairs are kept in a table as they are met.

The vocabulary's file is a parameter. Its normaliser and pre-tokeniser are followed exactly: for letters up to U+024F by
`pretokens`, for all others by the file's own steps (the library runs these two, never the merges). A worker remembers
bounded numbers of pre-tokens and pairs, then forgets them all.

Defined results: a null text is empty and has no ids; special tokens in a text are found as the library finds them; an empty
table gives an empty table; repeated rows are encoded alike; other columns are kept by `encoded`.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutlake.llm import pretokens, shared

#: Pre-tokens that a worker remembers, and pairs of tokens; then it forgets them all.
REMEMBERED, PAIRS = 1_000_000, 1_000_000
#: One character for the end of a pre-token, outside the 256 that stand for bytes.
_END = ""
_NEVER = 1 << 60

def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from U+0100 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A tokenizer file with BPE merges and a word-end suffix, as tables."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        made = json.loads(text)
        model = made["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_str(text)
        self.ids = {self._own(t): i for t, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(self._own(a), self._own(b)): r for r, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.pieces = self._table([names.get(i, "") + " " for i in range(max(names) + 1)])
        self.decimals = self._table([f"{i} " for i in range(max(names) + 1)])
        self.automaton = ahocorasick.Automaton()
        for token in self.ids:
            self.automaton.add_word(token, token)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.memory = pretokens.Memory([np.int32], REMEMBERED)

    @staticmethod
    def _table(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces as one array of bytes, and where each begins (and ends)."""
        made = [p.encode() for p in pieces]
        return np.frombuffer(b"".join(made), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in made])))

    def _own(self, token: str) -> str:
        return token[: -len(self.suffix)] + _END if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else token

    def _symbols(self, text: str) -> list[str]:
        return [*text[:-2], text[-2:]] if text.endswith(_END) else list(text)

    def merged(self, text: str) -> list[str]:
        """The tokens of a text by applying the lowest-ranked merge until none is left (the definition; used for pairs)."""
        parts, rank = self._symbols(text), self.ranks.get
        ranks = [rank(p, _NEVER) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != _NEVER:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), _NEVER)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), _NEVER)
        return parts

    def compatible(self, left: str | None, right: str) -> bool:
        if left is None:
            if (found := self.whole.get(right)) is None:
                found = self.whole[right] = self.merged(right) == [right]
            return found
        if (found := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.compatible(None, right) and self.merged(left + right) == [left, right]
        return found

    def split(self, text: str) -> list[str]:
        """The tokens of one pre-token (mapped bytes, then _END)."""
        longest = [t for _, t in self.automaton.iter_long(text)]
        if sum(map(len, longest)) == len(text) and all(map(self.compatible, [None, *longest[:-1]], longest)):
            return longest  # no step back
        begin: list[list[str]] = [[] for _ in text]
        for end, token in self.automaton.iter(text):
            begin[end - len(token) + 1].append(token)  # shorter tokens of a place end earlier, so each list is by length
        path: list[str] = []
        left = [begin[0].copy()]
        dead: set[int] = set()
        at = 0
        while at < len(text):
            choices = left[-1]
            while choices:
                token = choices.pop()
                if at + len(token) not in dead and self.compatible(path[-1] if path else None, token):
                    path.append(token)
                    at += len(token)
                    left.append(begin[at].copy() if at < len(text) else [])
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary cannot spell this text")
                dead.add(at)
                left.pop()
                at -= len(path.pop())
        return path

    def encode_word(self, word: str) -> list[int]:
        """The ids of a pre-token given as mapped bytes."""
        return [self.ids[t] for t in self.split(word + _END if self.suffix else word)]

    def _new(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        found = [self.encode_word("".join(map(self.letters.__getitem__, w.encode()))) for w in words]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in found])))
        return [(np.fromiter((i for x in found for i in x), np.int32, int(bounds[-1])), bounds)]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, by the file's own normaliser and pre-tokeniser."""
        ids: list[int] = []
        at = 0
        parts = [(m.start(), m.end()) for m in (self.special_pattern.finditer(text) if self.special_pattern else ())]
        for first, last in [*parts, (len(text), len(text))]:
            for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text[at:first])):
                ids += self.encode_word(word)
            if last > first:
                ids.append(self.special[text[first:last]])
            at = last
        return ids

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, and where each text's begin."""
        tokens = pretokens.pretokens(texts, lowered=True, marks=list(self.special))
        ids, sizes = self.memory.values(0, self.memory.find(tokens, self._new))
        bounds = np.concatenate(([0], np.cumsum(sizes)))[tokens.bounds]
        odd = np.flatnonzero(tokens.unusual).tolist()
        return pretokens.put_in(ids, bounds, odd, [self.encode(texts[i].as_py()) for i in odd])

    def texts(self, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """For each text its ids' pieces, cut from a table by their offsets, joined by spaces."""
        flat, offsets = table
        sizes = offsets[ids + 1] - offsets[ids]
        out = pretokens.laid_out(flat, offsets[ids], sizes)
        at = np.concatenate(([0], np.cumsum(sizes)))[bounds].tolist()
        return [out[a : max(a, b - 1)].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts joined by spaces."""
        return self.texts(self.pieces, ids, np.array([0, len(ids)]))[0]


@functools.lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode_batches(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for whole in batches:
            for batch in shared.steps(whole, "_text"):
                ids, bounds = vocabulary.encode_all(batch.column("_text"))
                columns = [batch.column(k) for k in keep] + [pa.array(np.diff(bounds), pa.int64())]
                for table in (vocabulary.decimals, vocabulary.pieces):
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in vocabulary.texts(table, ids, bounds)], pa.string()))
                columns.append(shared.lists(ids, bounds))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return run


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all unless given), n_tokens, ids_sha256, decoded_sha256 and ids; the added ones replace others of their name."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string("n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>")])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(_encode_batches(vocabulary, keep), schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, vocabulary_path(), keep=["doc_id"]).drop("ids")
