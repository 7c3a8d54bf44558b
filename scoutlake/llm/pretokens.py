"""Pre-tokens of many texts at once: their byte spans and hashes, by numpy, for texts of ASCII and Latin letters up to U+024F.

Two styles are known by the names of what they keep: `spaced` (a space goes with what follows it, all bytes are kept, as in
the pattern `'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`) and `lowered` (lower-cased, white
space is dropped, each number stands alone: `'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+`).

A text with any other character, or with one of the given marks, is `unusual`: its spans mean nothing, and the caller takes
the tokenizer file's own steps for it. A null text is empty and has no pre-tokens.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from scoutlake.llm import shared

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_LIMIT = 0x250


def _kind(point: int) -> int:
    if point in (0x20, 0x09, 0x0A, 0x0D, 0xA0):
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(point))[0], _OTHER)


_KINDS = np.array([_kind(p) for p in range(_LIMIT)], np.uint8)
_BYTE_KINDS = np.concatenate((_KINDS[:128], np.full(128, _OTHER, np.uint8)))
#: Bytes that no usual text has: controls but tab and line ends, and what begins characters from U+0280 on.
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[b for b in (*range(0x20), 0x7F) if b not in (0x09, 0x0A, 0x0D)]] = True
_ODD_BYTES[0xCA:] = True
_LOWERED = np.array([ord(chr(p).lower()) if len(chr(p).lower()) == 1 else p for p in range(_LIMIT)], np.int64)
#: Code points without a lower-case form of two bytes are odd where texts are lower-cased.
_ODD_LOWER = np.array([len(chr(p).lower().encode()) != len(chr(p).encode()) for p in range(_LIMIT)])
_ASCII_LOWER = np.concatenate((_LOWERED[:128], np.arange(128, 256))).astype(np.uint8)


@dataclass
class Pretokens:
    """The pre-tokens of some texts, one after another, in data; bounds: where each text's begin; unusual: texts without any."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    unusual: np.ndarray
    hashes: np.ndarray

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()


def _marked(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Where mark begins in data."""
    at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    for k, b in enumerate(mark[1:], 1):
        at = at[data[at + k] == b]
    return at


def pretokens(texts: pa.Array, lowered: bool, marks: list[str] = ()) -> Pretokens:
    data, at = shared.utf8(texts)
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return Pretokens(data, none, none, np.zeros(len(at), np.int64), np.zeros(len(at) - 1, bool), none.astype(np.uint64))
    odd = [np.flatnonzero(_ODD_BYTES[data]), *(_marked(data, m.encode()) for m in marks)]
    kinds = _BYTE_KINDS[data]
    if lowered:
        data = _ASCII_LOWER[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
    if len(lead):
        points = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        wrong = (points >= _LIMIT) | (points < 0xA0)
        points[wrong] = 0xA0
        if lowered:
            wrong |= _ODD_LOWER[points]
            small = _LOWERED[points]
            same = ~wrong
            data[lead[same]], data[lead[same] + 1] = (0xC0 | (small >> 6))[same], (0x80 | (small & 0x3F))[same]
        odd.append(lead[wrong])
        kinds[lead] = kinds[lead + 1] = _KINDS[points]
    unusual = np.zeros(len(at) - 1, bool)
    unusual[np.searchsorted(at, np.concatenate(odd), "right") - 1] = True

    cut = np.zeros(n + 1, bool)
    cut[at] = True
    begins = cut.copy()
    begins[1:n] |= kinds[1:] != kinds[:-1]
    runs = np.flatnonzero(begins[:n])
    ends = np.append(runs[1:], n)
    blank = kinds[runs] == _SPACE
    start = begins.copy()
    if lowered:
        numbers = (kinds == _NUMBER) & ((data & 0xC0) != 0x80)
        start[:n] |= numbers
    else:
        # the last character of white space before something else: a space goes with that, any other stands alone
        after = ends[blank & ~cut[ends]]
        last = after - 1
        last = last - ((data[last] & 0xC0) == 0x80)
        start[last] = True
        start[after[data[last] == 0x20]] = False
    quote = np.flatnonzero(start[:n] & (data == 39))
    padded = np.append(data, np.zeros(2, np.uint8))
    ended = np.append(cut, True)
    one, two = padded[quote + 1], padded[quote + 2]
    near = ~ended[quote + 1]
    short = near & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = near & ~ended[np.minimum(quote + 2, n)] & (((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)))
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[np.minimum(quote[long] + 3, n)] = True
    start[n] = True
    found = np.flatnonzero(start)
    starts, ends = found[:-1], found[1:]
    if lowered:
        kept = kinds[starts] != _SPACE
        starts, ends = starts[kept], ends[kept]
    if unusual.any():
        kept = ~unusual[np.searchsorted(at, starts, "right") - 1]
        starts, ends = starts[kept], ends[kept]
    hashes = shared._word_hashes(data, starts, ends) if len(starts) else none.astype(np.uint64)
    return Pretokens(data, starts, ends, np.searchsorted(starts, at), unusual, hashes)


def laid_out(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] for every i, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def put_in(flat: np.ndarray, bounds: np.ndarray, odd: list[int], parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """flat and bounds with the values of the texts `odd`, which had none."""
    if not odd:
        return flat, bounds
    sizes = np.diff(bounds)
    sizes[odd] = [len(x) for x in parts]
    more = np.fromiter((i for x in parts for i in x), flat.dtype, int(sizes[odd].sum()))
    return np.insert(flat, np.repeat(bounds[odd], sizes[odd]), more), np.concatenate(([0], np.cumsum(sizes)))


class Memory:
    """What was made of pre-tokens, by their hashes: some arrays of values for each, of any lengths."""

    def __init__(self, kinds: list[type], most: int):
        self.kinds, self.most = kinds, most
        self.forget()

    def forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat = [np.zeros(0, k) for k in self.kinds]
        self.starts = [np.zeros(1, np.int64) for _ in self.kinds]

    def find(self, tokens: Pretokens, make) -> np.ndarray:
        """The number of each pre-token; make gives for a list of new ones each kind's values and where they begin (and end)."""
        unique, first, where = np.unique(tokens.hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > self.most:
            self.forget()
        at = np.searchsorted(self.hashes, unique)
        inside = at < len(self.hashes)
        new = np.ones(len(unique), bool)
        new[inside] = self.hashes[at[inside]] != unique[inside]
        if new.any():
            made = make([tokens.word(i) for i in first[new].tolist()])
            numbers = len(self.hashes) + np.arange(int(new.sum()))
            for k, (values, bounds) in enumerate(made):
                self.starts[k] = np.concatenate((self.starts[k], len(self.flat[k]) + bounds[1:]))
                self.flat[k] = np.concatenate((self.flat[k], values))
            self.hashes, self.numbers = np.insert(self.hashes, at[new], unique[new]), np.insert(self.numbers, at[new], numbers)
        return self.numbers[np.searchsorted(self.hashes, unique)][where]

    def values(self, k: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of kind k of the numbered pre-tokens, one after another, and how many each has."""
        starts = self.starts[k][numbers]
        sizes = self.starts[k][numbers + 1] - starts
        return laid_out(self.flat[k], starts, sizes), sizes
