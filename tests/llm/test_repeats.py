"""Repeated passages against every span of every text."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutlake.llm import repeats, shared

SCHEMA = "doc_id bigint, text string"
SPAN = repeats.SPAN


def digest(text):
    return hashlib.sha256((text or "").encode()).digest()[:16]


def plain(docs):
    """Per row: doc_id, bytes, removed bytes, runs, digest of the rest."""
    own = sorted({((i is not None, i or 0), digest(t), (t or "").encode()) for i, t in docs})
    seen, results = set(), {}
    for key, part, raw in own:
        gone = bytearray(len(raw))
        for p in range(len(raw) - SPAN + 1):
            span = raw[p : p + SPAN]
            if span in seen:
                gone[p : p + SPAN] = b"\1" * SPAN
            seen.add(span)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (not p or not gone[p - 1]))
        results[key, part] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return sorted(((i, *results[(i is not None, i or 0), digest(t)]) for i, t in docs), key=str)


def made():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(1, 200)) for _ in range(20)]
    passage, line = prose(60), prose(25)
    texts += [f"{prose(rng.randint(0, 20))}{passage[rng.randint(0, 40) : 300 + rng.randint(0, 60)]}{prose(rng.randint(0, 20))}" for _ in range(25)]
    for i in range(10):  # near copies
        copy = texts[3].split()
        copy[i * 7 % len(copy)] = f"x{i}"
        texts.append(" ".join(copy))
    texts += [texts[5]] * 3 + ["\n".join([line] * 12), line, "a" * 3000, "ab" * 900 + "c", "a" * 500, "b" + "a" * 400, "q" * 99, "q" * 100, "q" * 101, "", None, "\x00" * 150 + "z", "\x00" * 140]
    texts += [passage[:200], passage[:180] + "!" + prose(10), texts[2] + texts[3][:150] + texts[2]]
    rows = list(enumerate(texts))
    rows += [(4, texts[4])] * 2 + [(4, texts[6] + "!"), (None, texts[7]), (None, texts[7] + "?"), (-5, texts[8])]
    return rows


@pytest.fixture(scope="module")
def docs():
    return made()


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("way", ["plain", "spread", "small steps"])
def test_removed(spark, docs, monkeypatch, way):
    if way == "spread":
        monkeypatch.setattr(repeats, "HOT_CONTEXTS", 1)
        monkeypatch.setattr(repeats, "BROADCAST_PLACES", 0)
        monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(shared, "HOT_ROWS", 3)
    if way == "small steps":
        monkeypatch.setattr(repeats, "CHUNK", 170)
        monkeypatch.setattr(repeats, "SUFFIXES", 50)
        monkeypatch.setattr(shared, "STEP_BYTES", 900)
        monkeypatch.setattr(repeats, "_powers", {})
    df = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit("x") for c in ("part", "print", "places", "first", "row", "a.b")})
    assert got(repeats.deduplicated(df.repartition(3))) == plain(docs)


def places(raw, found):
    at = found.find(raw)
    while at >= 0:
        yield at
        at = found.find(raw, at + 1)


@pytest.mark.parametrize("hot", [2000, 3])
def test_maximal_repeats_are_whole(spark, docs, monkeypatch, hot):
    """Each has all its occurrences, which do not all follow one byte; every span so found again begins one."""
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    some = [d for d in docs if d[0] is not None and d[0] not in (4, -5)]
    tables = repeats.Repeats(spark.createDataFrame(some, SCHEMA))
    copies = {r["doc_id"] for r in tables.copies.collect()}
    texts = {i: (t or "").encode() for i, t in some if i not in copies}
    by = {}
    for r in tables.maximal_repeats().collect():
        by.setdefault((r["repeat"], r["length"]), set()).add((r["doc_id"], r["start"]))
    begun = set()
    for (_, length), occurrences in by.items():
        strings = {texts[i][p : p + length] for i, p in occurrences}
        assert len(strings) == 1 and length >= SPAN
        string = strings.pop()
        assert len(string) == length and len(occurrences) > 1
        assert occurrences == {(i, p) for i, raw in texts.items() for p in places(string, raw)}
        before = [texts[i][p - 1] if p else None for i, p in occurrences]
        assert None in before or len(set(before)) > 1
        begun.add(string[:SPAN])
    spans = {}
    for i, raw in texts.items():
        for p in range(len(raw) - SPAN + 1):
            spans.setdefault(raw[p : p + SPAN], []).append(raw[p - 1] if p else None)
    assert begun == {s for s, before in spans.items() if len(before) > 1 and (None in before or len(set(before)) > 1)}


def test_intervals_are_those_of_the_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        text = bytes(rng.integers(97, 99, n).tolist())
        order = sorted(range(n), key=lambda p: text[p:])
        common = lambda a, b: next((k for k in range(n) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= n or b + k >= n), n)
        prefix = [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]
        want = set()
        for low in range(n):
            for high in range(low + 1, n):
                length = min(prefix[low + 1 : high + 1])
                if (low == 0 or prefix[low] < length) and (high + 1 == n or prefix[high + 1] < length):
                    want.add((length, low, high))
        assert set(repeats.intervals(prefix)) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(repeats.deduplicated(empty)) == []
    few = [(1, "x"), (2, None), (3, "")]
    assert got(repeats.deduplicated(spark.createDataFrame(few, SCHEMA))) == plain(few)


def test_equal_spans_have_equal_anchors():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    raw[3000:3400] = raw[1000:1400]
    first, last, anchor, prints = repeats.runs(raw, np.array([0, 2000, 2050, 5000]))
    starts = {p: (int(a) - p, int(h)) for f, l, a, h in zip(first, last, anchor, prints, strict=True) for p in range(f, l + 1)}
    assert sorted(starts) == [*range(1901), *range(2050, 4901)]
    assert all(starts[1000 + k] == starts[3000 + k] for k in range(301))
    assert all(0 <= d <= SPAN - repeats.GRAM for d, _ in starts.values())
