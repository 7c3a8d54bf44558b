"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def token_files(docs, library):
    """docs: (doc_id, text). (doc_id, start, n_tokens, crc) by the library alone."""
    out, start = [], 0
    for i, text in sorted(docs, key=lambda d: d[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def contamination(docs, items, window=10):
    """(doc_id, n_words, n_hit, n_items, sha of ids, contaminated)."""
    windows: dict[tuple, set] = {}
    for i, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        if words:
            n = min(window, len(words))
            for at in range(len(words) - n + 1):
                windows.setdefault(tuple(words[at : at + n]), set()).add("null" if i is None else str(i))
    sizes = sorted({len(w) for w in windows})
    out = []
    for i, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for at in range(len(words) - n + 1):
                if (who := windows.get(tuple(words[at : at + n]))) is not None:
                    hit.update(range(at, at + n))
                    found |= who
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def encoded(docs, library):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by the library alone."""
    out = []
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return out


def counts(docs):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = []
    for i, text in docs:
        words = SPACED.findall(text or "")
        seen: set[str] = set()
        dup = 0
        for line in (text or "").split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        repeat = {at + k for at in range(len(words) - 2) if grams[tuple(words[at : at + 3])] > 1 for k in range(3)}
        n = len(words)
        out.append((i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat), n < 50 or 100 * len(repeat) > 50 * n))
    return out


def base_scores(docs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = [(i, [*SPACED.findall((text or "").translate(LOWER)), None]) for i, text in docs]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    c = Counter(t for i, ts in tokens if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    return [(i, held[i], len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) for i, ts in tokens]


BASE = {
    "assign": (re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12, 1),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    "hex": (re.compile(r"[0-9a-f]+"), 16, 0),
}


def secrets(docs):
    """(doc_id, n_assign, n_access, n_hex, base_sha256)."""
    out = []
    for i, text in docs:
        spans = [(m.start(), k, kind, m.end()) for k, (kind, (p, least, g)) in enumerate(BASE.items()) for m in p.finditer(text or "") if len(m.group(g)) >= least]
        n = Counter(s[2] for s in spans)
        out.append((i, n["assign"], n["access"], n["hex"], sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)))))
    return out


def shingles(text):
    words = SPACED.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(docs, percent=80):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where: dict[tuple, list[int]] = {}
    for n, s in enumerate(sets):
        met = Counter(m for g in s for m in where.get(g, ()))
        for m, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[m]) - both):
                root[find(n)] = find(m)
        for g in s:
            where.setdefault(g, []).append(n)
    least: dict[int, int] = {}
    for n, (i, _) in enumerate(docs):
        least[find(n)] = min(i, least.get(find(n), i))
    return [(i, len(sets[n]), least[find(n)]) for n, (i, _) in enumerate(docs)]


def rule_of(url, rules):
    """(host, path, rule, verdict) by the rules alone."""
    _, found, rest = (url or "").partition("://")
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest if found else "").groups()
    host = host.translate(LOWER)
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0]) + len(r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def kneser_ney(texts, letters, order=4):
    """The natural log probability of a word, by interpolated Kneser-Ney over the characters of the texts' words."""
    counts: list[Counter] = [Counter() for _ in range(order + 1)]
    for t in texts:
        for w in SPACED.findall(t.translate(LOWER)):
            padded = " " * (order - 1) + w + " "
            for at in range(order - 1, len(padded)):
                counts[order][padded[at - order + 1 : at + 1]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, totals, types = [0.0] * (order + 1), [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        ones, twos = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        discounts[k] = min(max((ones + 0.5) / (ones + 2 * twos + 1), 0.1), 0.9)
        for g, n in counts[k].items():
            totals[k][g[:-1]] += n
            types[k][g[:-1]] += 1

    def p(gram):
        k, context = len(gram), gram[:-1]
        lower = p(gram[1:]) if k > 1 else 1 / letters
        if not totals[k][context]:
            return lower
        return (max(counts[k][gram] - discounts[k], 0) + discounts[k] * types[k][context] * lower) / totals[k][context]

    def word(w):
        padded = " " * (order - 1) + w + " "
        return sum(math.log(p(padded[at - order + 1 : at + 1])) for at in range(order - 1, len(padded)))

    return word
