"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains (0). How far each rule is to be trusted is not
set by hand: expectation maximisation over the counts of vote patterns estimates how often it votes on good and on bad
documents, and so how often its vote is right. A document's posterior probability of being good weighs votes and
abstentions by these rates. The
patterns are at most 2 ** len(rules()) rows whatever the number of documents; all documents count.

Defined results: a null or empty text has no words, so every count is 0 and base_failed is true; repeated rows are judged
alike, each for itself; an empty table gives an empty table; other columns are kept, and the added ones replace those of
the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import shared

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The columns that are added; they replace those of the same name.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals"]
#: A document stays when it is at least so probable that it is good.
KEEP = 0.5
#: Estimation ends after so many rounds, or when nothing changes by more.
ROUNDS, SETTLED = 15, 0.001
#: Where estimation starts: the share of good documents, and how often the rule for plain prose and the rules against faults
#: vote on good ones.
PRIOR, LIKELY, UNLIKELY = 0.8, 0.9, 0.01
#: Bounds of a rule's rates. A rule votes this many times as often on the documents it is meant for, so none turns round.
LEAST, MOST, APART = 0.0005, 0.9995, 2.0


def _per_word(n: Column) -> Column:
    return n / F.greatest(F.col("n_words"), F.lit(1))


def rules() -> dict[str, Column]:
    """The rules' votes, from the counts of `counted`. Rules against a fault abstain where they don't see it; one speaks for plain prose."""
    symbols, bangs, repeats = (_per_word(F.col(c)) for c in ("n_symbols", "n_bangs", "n_repeat_words"))
    length, capitals = _per_word(F.col("word_chars")), F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))
    again = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    plain = (symbols < 0.02) & (bangs < 0.05) & (capitals < 0.2) & (repeats < 0.3) & (length > 3) & (length < 8.5)
    against = {
        "symbols": symbols > 0.1,
        "bangs": bangs > 0.2,
        "capitals": capitals > 0.3,
        "dup_lines": (again > 0.3) & (F.col("n_lines") > 2),
        "repeats": repeats > 0.3,
        "word_length": (length < 2) | (length > 10),
        "words": F.col("n_words") < 20,
    }
    return {"plain": F.when(plain, 1).otherwise(0)} | {r: F.when(fault, -1).otherwise(0) for r, fault in against.items()}


def _repeat_words(hashes: Column) -> Column:
    """How many words lie in windows of three whose hash, in document order, is found twice; from the sorted (hash, place)."""
    twice = F.filter(hashes, lambda x, j: (F.get(F.col("_sorted"), j - 1)["h"] == x["h"]) | (F.get(F.col("_sorted"), j + 1)["h"] == x["h"]))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n")), lambda a: a["n"])


def counted(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the other counts that the rules use."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    rows = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2))))
    rows = rows.withColumn("_hashes", F.slice("_hashes", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))))
    rows = rows.withColumn("_twice", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    rows = rows.withColumn("_sorted", F.when(F.col("_twice"), F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    size = F.length(text)
    without = lambda marks: size - F.length(F.translate(text, marks, ""))
    made = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate(text, SPACES, "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(_repeat_words(F.col("_sorted")), F.lit(0)),
        "n_lines": F.size("_lines"),
        "n_bangs": without("!"),
        "n_capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    }
    return rows.withColumns({k: v.cast("long") for k, v in made.items()}).drop("_words", "_lines", "_hashes", "_twice", "_sorted")


def _posterior(names: list[str], prior: float, good: dict[str, float], bad: dict[str, float]) -> Column:
    """P(good | votes), when a rule votes on a good (bad) document with probability good (bad)."""
    total = F.lit(math.log(prior / (1 - prior)))
    for r in names:
        total = total + F.when(F.col(r) != 0, math.log(good[r] / bad[r])).otherwise(math.log((1 - good[r]) / (1 - bad[r])))
    return 1 / (1 + F.exp(-total))


def _apart(high: float, low: float) -> tuple[float, float]:
    """The two rates within bounds, the first at least APART times the second."""
    high, low = (min(MOST, max(LEAST, x)) for x in (high, low))
    return max(high, min(MOST, low * APART)), min(low, high / APART) if high / APART >= LEAST else low


def estimated(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, float], dict[str, float]]:
    """The share of good documents and each rule's rates of voting on good and on bad ones, by expectation maximisation.

    One row a round comes back. The first of names speaks for a document, the others against it.
    """
    prior = PRIOR
    good = {r: LIKELY if r == names[0] else UNLIKELY for r in names}
    bad = {r: 1 - LIKELY if r == names[0] else 1 - PRIOR for r in names}
    for _ in range(rounds):
        p = _posterior(names, prior, good, bad)
        weight = F.col("count") * p
        sums = [F.sum(weight).alias("good"), F.sum("count").alias("all")]
        for r in names:
            sums += [F.sum(F.when(F.col(r) != 0, weight)).alias(f"{r}_good"), F.sum(F.when(F.col(r) != 0, F.col("count") - weight)).alias(f"{r}_bad")]
        row = patterns.agg(*sums).first()
        if not row["all"]:
            break
        share, before = min(0.999, max(0.001, row["good"] / row["all"])), (prior, good, bad)
        # the rates so far count as one more document of each kind, so that few documents say little
        good = {r: ((row[f"{r}_good"] or 0) + good[r]) / (row["good"] + 1) for r in names}
        bad = {r: ((row[f"{r}_bad"] or 0) + bad[r]) / (row["all"] - row["good"] + 1) for r in names}
        for r in names:
            if r == names[0]:
                good[r], bad[r] = _apart(good[r], bad[r])
            else:
                bad[r], good[r] = _apart(bad[r], good[r])
        prior = share
        if max(abs(prior - before[0]), *(abs(x[r] - y[r]) for x, y in ((good, before[1]), (bad, before[2])) for r in names)) < SETTLED:
            break
    return prior, good, bad


def quality(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with the counts of `counted`, base_failed, the posterior `good` (0 to 1) and kept.

    Texts are counted once: what is written for the estimate and the verdicts has the counts, not the texts.
    """
    votes = rules()
    names = {r: f"_vote_{r}" for r in votes}
    rows = shared.written(counted(docs.select(*(F.col(k) for k in keep if k not in COUNTS), "text")).drop("text"), "counted")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    voted = rows.withColumns({names[r]: v for r, v in votes.items()})
    patterns = shared.written(voted.groupBy(*names.values()).count(), "patterns")
    good = _posterior(list(names.values()), *estimated(patterns, list(names.values())))
    return voted.withColumns({"base_failed": failed, "good": good, "kept": ~failed & (good >= KEEP)}).drop(*names.values())


def _text_key(text: Column) -> list[Column]:
    """Two hashes of a text that together stand for it."""
    known = F.coalesce(text, F.lit(""))
    return [F.xxhash64(known).alias("_key"), F.xxhash64(known, F.lit(1)).alias("_key2")]


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that are kept. A verdict is its text's, so rows join it by their texts' hashes."""
    judged = quality(docs.select("text", *_text_key(F.col("text"))), ["_key", "_key2"])
    bad = shared.written(judged.filter(~F.col("kept")).select("_key", "_key2").distinct(), "rejected")
    one, two = _text_key(docs["text"])
    return docs.join(shared.checked_broadcast(bad), (one == bad["_key"]) & (two == bad["_key2"]), "left_anti")


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")
