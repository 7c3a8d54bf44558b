"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoutlake.llm import shared, spelling

SCHEMA = "doc_id bigint, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by = {}
    for w, n in words.items():
        close = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        by[w] = (n, len(close), best if best and words[best] >= 2 * n else None)
    out = []
    for w, (n, close, form) in by.items():
        root = w
        while by[root][2]:
            root = by[root][2]
        out.append((w, n, close, form, by[form][0] if form else None, root))
    return sorted(out)


def made():
    rng = random.Random(4)
    letters = "abcdeABCé×ÿ"
    roots = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ab" * 32, "x" * 300, "x" * 301, "x" * 150 + "d" + "x" * 149, "é" * 64, "é" * 65, "é" * 63, "a" + "é" * 63, "ab" * 32 + "c"]
    words = list(roots)
    for w in roots:
        for _ in range(3):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    docs = [(i, " ".join(f"{w}{rng.choice(' ,9_')}" for w in rng.choices(words, range(len(words), 0, -1), k=rng.randint(1, 300)))) for i in range(25)]
    docs += [(3, docs[3][1])] * 2 + [(None, docs[4][1]), (90, None), (91, ""), (92, "…漢字 12 \n"), (93, ("y" * 70_000 + " ") * 3), (95, "steps " * 4 + "stepss " * 9 + "stepsss " * 20), (94, "".join(rng.choice("abc") for _ in range(9000)))]
    return docs


@pytest.fixture(scope="module")
def docs():
    return made()


def got(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_variants(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit("x") for c in ("word", "n", "key", "place", "root", "best", "a.b")})
    want = plain(docs)
    assert got(spelling.variants(df.repartition(3))) == want
    assert any(r[3] and r[5] != r[3] for r in want) and any(r[2] > 3 for r in want)


def test_variants_in_small_batches(spark, docs, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(spelling.variants(spark.createDataFrame(docs[:12], SCHEMA))) == plain(docs[:12])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_colliding_keys_part_again(docs, monkeypatch):
    """With all keys equal, the strings decide."""
    counts = plain(docs[:6])
    words = pa.RecordBatch.from_pydict({"word": [r[0] for r in counts], "n": [r[1] for r in counts]})
    rows = pa.Table.from_batches(spelling._keyed("word")(iter([words])))
    rows = rows.set_column(0, "key", pa.array(np.zeros(rows.num_rows, np.int64)))
    rows = rows.sort_by([("key", "ascending"), ("place", "ascending"), ("n", "descending"), ("word", "ascending")]).combine_chunks()
    met = pa.Table.from_batches(spelling._meet(iter(rows.to_batches(max_chunksize=50)))).to_pylist()
    found = Counter()
    for r in met:
        found[r["word"]] += r["near"]
    assert found == {r[0]: r[2] for r in counts if r[2]}


def test_no_rows(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    assert got(spelling.variants(df.filter("doc_id = 1000"))) == []
    assert got(spelling.variants(df.filter("doc_id in (90, 91, 92)"))) == []


def test_crc32():
    data = np.frombuffer(b"abc" * 60 + b"d", np.uint8)
    starts, sizes = np.array([0, 0, 5, 180, 9]), np.array([181, 1, 64, 1, 0])
    before = np.array([zlib.crc32(b"7:"), 0, 9, 1 << 31, 5])
    assert spelling.crc32(data, starts, sizes, before).tolist() == [zlib.crc32(data[s : s + n].tobytes(), int(b)) for s, n, b in zip(starts, sizes, before, strict=True)]


def test_keys_are_those_of_the_shortened_strings():
    words = ["", "a", "aab", "éÿab", "x" * 40]
    owner, place, keys, fresh = spelling.deletion_keys(words)
    short = [words[o] if p < 0 else words[o][:p] + words[o][p + 1 :] for o, p in zip(owner, place, strict=True)]
    whole = dict(zip(short[: len(words)], keys[: len(words)], strict=True))
    _, at, again, _ = spelling.deletion_keys(short)
    assert (again[at < 0] == keys).all() and whole[""] == keys[short.index("", len(words))]
    assert [tuple(x) for x in zip(owner, place, strict=True) if words[x[0]] == "aab"] == [(2, -1), (2, 0), (2, 1), (2, 2)]
    assert fresh[owner == 2].tolist() == [True, True, False, True]
    assert shared.STEP_BYTES
