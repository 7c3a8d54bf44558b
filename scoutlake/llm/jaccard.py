"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its 5-word shingles, as 64-bit hashes; two documents link when 100 * intersection >= 80 * union.
Documents with one set are first taken together by a 128-bit digest, so copies cost one row.

Order. Shingles that many sets hold are `frequent`, all others `rare`; rare ones come first, then by hash. Of n shingles a
partner may lack n - t, where t = ceil(0.8 n). Take a prefix in this order: shared shingles within the shorter prefix are in
both. A rare shingle is a signature alone; frequent ones are dealt by hash into small classes, and each pair in a class is a
signature, so a class can hide one shared shingle. The prefix is extended until the shingles in it, less one for each class
that occurs, outnumber n - t: then two linked documents must share a signature.

Work. A document's first shingles by hash are enough while they hold n - t + 1 rare ones; only the others are read again, in
whole. A document is first held against one head of its signatures, then against those heads that lie in other components;
then only pairs from different components of one signature are verified, and of these only those whose sizes, less the
shingles that nobody else has, leave room for a link. No link that could join two components is left out.

Large signatures. The members of a signature of more than LARGE members do not meet in it if they are of one family, see
`_families`: its sets are written as differences from the shingles that most of it hold. Two sets link when their differences
differ in at most 1 / 9 of their sizes' sum. Sets near enough to the family's center link with its nearest set, one row each;
any other link needs differences that both sets share, and those are joined by prefixes again. So the members of a large
group of near copies do not meet pairwise, and none of their links is lost. Members of different families meet.

Defined results: a null or empty text has an empty set and links with nothing; fewer than five words are one shingle;
documents with one id are rows of their own, and each goes with its text; a null id is never a component's id unless all
ids of the component are null; other columns are ignored by `link_components` and kept by `one_of_each`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import shared
from scoutlake.llm.components import components

SHINGLE = 5
PERCENT = 80
#: A shingle is frequent when more sets than this show it.
FREQUENT = 16
#: About how many frequent shingles of a prefix fall into one class.
CLASS_SIZE = 6
#: A signature of more members is looked at by differences; within a smaller one members may meet.
LARGE = 2 * FREQUENT


def needed(n, percent: int = PERCENT):
    """t: what a partner of a set of n must share with it at least."""
    return -(-n * percent // 100)


def _looked_at(want):
    """The first shingles by hash among which a set should have `want` rare ones."""
    return want + want // 3 + 2


def _emitted(n: int, percent: int) -> int:
    """How many first shingles a set shows. Two more than are looked at: before the first rare shingle that linked sets share
    there are the shingles of one set alone and shared frequent ones, so the other set shows that shingle, too."""
    return min(n, _looked_at(n - needed(n, percent) + 1) + 2)


def _sets(batch: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    words = shared.words_of(batch.column("text"), shared.SPACED, lower=True)
    hashes, _ = words.grams(shingle)
    out = []
    for low, high in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if high - low >= shingle:
            found = np.sort(hashes[low : high - shingle + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif high > low:
            total = np.cumsum(words.hashes[low:high] * shared._GRAM[: high - low], dtype=np.uint64)[-1]
            out.append(shared.mix(np.array([total + np.uint64(high - low)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _listed(sets: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    return shared.lists(np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.int64), bounds)


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _hashed(docs: DataFrame, shingle: int, percent: int, whole: bool) -> DataFrame:
    """id, text_key, n, digest, and the set's first hashes (all of them if whole)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in shared.steps(big):
                sets = _sets(batch, shingle)
                shown = sets if whole else [x[: _emitted(len(x), percent)] for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text_key"), pa.array([len(x) for x in sets], pa.int32()), pa.array([_digest(x) for x in sets], pa.binary()), _listed(shown)],
                    ["id", "text_key", "n", "digest", "hashes"],
                )

    return docs.select("id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"id {kind}, text_key bigint, n int, digest binary, hashes array<bigint>")


def _whole_sets(docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, what: str) -> DataFrame:
    """node, n, hashes: the whole sets of some nodes (node, id, digest), from the texts of the rows with their ids."""
    ids = shared.checked_broadcast(shared.written(nodes.select("id").distinct(), "ids"))
    rows = docs.join(ids, docs["id"].eqNullSafe(ids["id"]), "left_semi")
    sets = _hashed(rows, shingle, percent, whole=True)
    nodes = nodes.select("node", F.col("id").alias("node_id"), F.col("digest").alias("node_digest"))
    same = (F.col("digest") == F.col("node_digest")) & F.col("id").eqNullSafe(F.col("node_id"))
    return shared.written(sets.join(nodes, same).dropDuplicates(["node"]).select("node", "n", "hashes"), what)


def _pairs_in_class(hashes: np.ndarray, level: int) -> np.ndarray:
    """The signatures of frequent hashes (in order): one for each pair in a class of the level."""
    classes = _classes(hashes, level)
    order = np.argsort(classes, kind="stable")
    made = []
    for group in np.split(hashes[order], np.flatnonzero(np.diff(classes[order])) + 1):
        i, j = np.triu_indices(len(group), 1)
        made.append(shared.mix(group[i] * np.uint64(3) + shared.mix(group[j]) + np.uint64(level + 1)))
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


def _classes(hashes: np.ndarray, level: int) -> np.ndarray:
    """A hash's class at a level; sets of up to 2 ** (level + 1) shingles have about CLASS_SIZE prefix shingles in each."""
    count = max(1, (1 << (level + 1)) // (5 * CLASS_SIZE))
    return (shared.mix(hashes) >> np.uint64(16)) % np.uint64(count)


def signatures(hashes: np.ndarray, frequent: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The signatures of a set, from its hashes in order, if they hold its prefix. frequent: marks for the hashes."""
    want = n - needed(n, percent) + 1
    rare = hashes[~frequent]
    if len(rare) >= want:
        return rare[:want]
    often = hashes[frequent]
    made = [rare]
    smallest = needed(n, percent)
    for level in sorted({n.bit_length(), smallest.bit_length()}):
        classes = _classes(often, level)
        seen: set[int] = set()
        got, end = len(rare), 0
        for c in classes.tolist():
            if got >= want:
                break
            end += 1
            if c in seen:
                got += 1
            seen.add(c)
        made.append(_pairs_in_class(often[:end], level))
    return np.concatenate(made)


def _signed(rows: DataFrame, percent: int) -> DataFrame:
    """node, n, most, score (over 0), sign: from node, n, most, hashes, and the places of the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            made, scores = [], []
            for r in range(batch.num_rows):
                hashes = batch.column("hashes")[r].values.to_numpy(zero_copy_only=False).astype(np.uint64)
                marks = np.zeros(len(hashes), bool)
                marks[batch.column("often")[r].values.to_numpy(zero_copy_only=False).astype(np.int64)] = True
                made.append(np.unique(signatures(hashes, marks, int(sizes[r]), percent)).astype(np.int64))
                scores.append(int(marks.sum()))
            counts = [len(x) for x in made]
            most = batch.column("most").to_numpy()
            columns = [np.repeat(x, counts) for x in (nodes, sizes, most, np.array(scores, np.int32))]
            columns.append(np.concatenate([*made, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "n", "most", "score", "sign"])

    return rows.select("node", "n", "most", "hashes", "often").mapInArrow(run, "node bigint, n int, most int, score int, sign bigint")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. The set of a is shuffled beside each pair, the set of b only once."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    together = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - together
    return both.filter(100 * together >= percent * union).select("a", "b")


def link_components(docs: DataFrame, id_column: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """id_column, text_key (xxhash64 of the text), n_shingles, component_id, and row (a number of the row), for each row of docs."""
    docs = docs.select(F.col(id_column).alias("id"), "text")
    base = _hashed(docs, shingle, percent, whole=False)
    base = shared.written(base.withColumn("row", F.monotonically_increasing_id()), "sets")
    sets = base.filter("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    sets = shared.written(sets.select("digest", F.col("least.row").alias("node"), F.col("least.id").alias("id"), "n", "copies"), "nodes")
    copies = shared.written(base.filter("n > 0").select("row").join(sets.select(F.col("node").alias("row")), "row", "left_anti"), "copies")
    firsts = base.filter("n > 0").join(shared.checked_broadcast(copies), "row", "left_anti").withColumnRenamed("row", "node")
    nodes = firsts.select("node", "n", F.posexplode("hashes").alias("pos", "hash"))

    # shingles that two sets show at least; those that more than `frequent` show are frequent
    dealt = nodes.repartition("hash")
    shown = dealt.groupBy("hash").agg(F.count(F.lit(1)).alias("shown")).filter("shown > 1")
    common = dealt.join(shown, "hash").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "shown"))).alias("common"))
    common = shared.written(common, "common")
    often = shared.written(common.select(F.inline("common")).filter(F.col("shown") > frequent).select("hash").distinct(), "often")

    # what has too few rare shingles among its first ones is read again in whole; its shingles may show more frequent ones
    want = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = F.least(F.col("n"), want + F.floor(want / 3) + 2)  # as _looked_at
    few = common.filter(first - F.size(F.filter("common", lambda c: (c["pos"] < first) & (c["shown"] > frequent))) < want)
    few = shared.written(few.select("node").join(sets.drop("copies"), "node"), "few")
    full = _whole_sets(docs, few, shingle, percent, "whole")
    more = full.select(F.explode("hashes").alias("hash")).groupBy("hash").count().filter(F.col("count") > frequent).select("hash")
    often = shared.written(often.union(more).distinct().select("hash", F.lit(True).alias("is_often")), "often")

    # the marks of all first shingles under the final classes; who then has too few is read again, too
    marked = common.select("node", "n", F.inline("common")).join(often, "hash", "left").groupBy("node", "n")
    marked = marked.agg(F.sort_array(F.collect_list(F.struct("pos", "hash", F.coalesce("is_often", F.lit(False)).alias("is_often")))).alias("common"))
    marked = shared.written(marked, "marked")
    short = first - F.size(F.filter("common", lambda c: (c["pos"] < first) & c["is_often"])) < want
    late = marked.filter(short).join(few.select("node"), "node", "left_anti").select("node").join(sets, "node")
    late = shared.written(late, "late")
    if late.limit(1).count():
        full = full.union(_whole_sets(docs, late, shingle, percent, "whole"))

    heavy = full.select("node", "n", F.posexplode("hashes").alias("pos", "hash")).join(often, "hash").groupBy("node").agg(F.collect_list("pos").alias("often"))
    # a shingle that only one of these sets has is missing in every other: what is left bounds what two of them share
    alone = full.select("node", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("held"), F.max("node").alias("node")).filter("held = 1")
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("alone"))
    heavy = full.join(heavy, "node").join(alone, "node", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0)))
    light = marked.filter(~short).join(full.select("node"), "node", "left_anti")
    light = _light_signatures(light, percent)
    signed = shared.written(_signed(heavy, percent).unionByName(light), "signed")

    linked = _verified_links(docs, sets, firsts.select("node", "n", "hashes"), signed, full, shingle, percent)
    roots = components(linked)
    named = sets.join(roots, "node", "left").select("digest", "id", "copies", F.coalesce("root", "node").alias("root"))
    named = shared.written(named, "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("held"))
    named = shared.spread_join(named, shared.written(least, "least"), "root")
    named = shared.written(named.select("digest", "component_id", "root", F.col("copies").alias("held")), "named")
    texts = base.select("id", "text_key", "n", "digest", "row")
    out = shared.spread_join(texts.filter("n > 0"), named, "digest").unionByName(texts.filter("n = 0"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_column), "text_key", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "row", F.coalesce("root", "row").alias("root"))


def _light_signatures(light: DataFrame, percent: int) -> DataFrame:
    """Signatures of nodes with enough rare shingles among their first: the rare ones within the prefix that others show, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, common = batch.column("n").to_numpy().astype(np.int64), batch.column("common")
            counts, found = common.value_lengths().to_numpy(), common.flatten()
            pos, often = found.field("pos").to_numpy(), found.field("is_often").to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(counts)))
            seen = np.concatenate(([0], np.cumsum(often)))
            before = seen[:-1] - np.repeat(seen[at[:-1]], counts)  # frequent ones of the same node before each
            keep = ~often & (pos - before < np.repeat(sizes - needed(sizes, percent) + 1, counts))
            nodes, n = (np.repeat(batch.column(c).to_numpy(), counts)[keep] for c in ("node", "n"))
            columns = [nodes, n, n, np.zeros(len(n), np.int32), found.field("hash").to_numpy()[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "n", "most", "score", "sign"])

    # one row for each node: batches end between rows, at any row, so what is counted by node has to lie within one
    return light.select("node", "n", "common").mapInArrow(run, "node bigint, n int, most int, score int, sign bigint")


def _possible(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose first shingles leave it open that they link.

    Below a bound that neither's shown shingles end before, a set of n can lack n - o shingles of the other at most, if they
    share o in all. The shingles' upper 32 bits are compared: equal shingles stay equal, so no link is lost.
    """
    wanted = shared.written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    short = firsts.join(shared.checked_broadcast(wanted), "node", "left_semi")
    short = short.select("node", "n", F.transform("hashes", lambda h: (F.shiftrightunsigned(h, 32) - F.lit(1 << 31)).cast("int")).alias("top"))
    left, right = (short.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("top").alias(f"top_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, n_a, n_b = [], batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            for r in range(batch.num_rows):
                x = batch.column("top_a")[r].values.to_numpy(zero_copy_only=False)
                y = batch.column("top_b")[r].values.to_numpy(zero_copy_only=False)
                bound = min(x[-1] if len(x) < n_a[r] else 1 << 40, y[-1] if len(y) < n_b[r] else 1 << 40)
                x, y = x[: np.searchsorted(x, bound)], y[: np.searchsorted(y, bound)]
                share = -(-percent * (n_a[r] + n_b[r]) // (100 + percent))
                if np.isin(x, y).sum() >= len(x) - (n_a[r] - share) and np.isin(y, x).sum() >= len(y) - (n_b[r] - share):
                    keep.append(r)
            take = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([take.column("a"), take.column("b")], ["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "top_a", "top_b").mapInArrow(run, "a bigint, b bigint")


def _links_of(docs: DataFrame, sets: DataFrame, firsts: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs that link: first by their first shingles, then by their whole sets."""
    open_pairs = shared.written(_possible(pairs, firsts, percent), "possible")
    wanted = shared.written(open_pairs.select(F.col("a").alias("node")).union(open_pairs.select("b")).distinct().join(sets, "node"), "wanted")
    whole = _whole_sets(docs, wanted, shingle, percent, "candidates")
    return shared.written(_linked(open_pairs, whole, percent), "links")


@dataclass
class Families:
    """What large signatures give: links, pairs to verify, and the rows of signatures of several families: node, family, main."""

    links: DataFrame
    pairs: DataFrame
    mixed: DataFrame


def _families(signed: DataFrame, large: DataFrame, whole: DataFrame, percent: int) -> Families:
    """Links and pairs enough for all components within the families of large signatures (sign, head: score, most, n, node).

    A set's family is the best head of its large signatures. The family's base holds the shingles of most of its sets; a set's
    change is what it has beyond the base or lacks of it, r shingles. With a = 100 + percent and b = 100 - percent, x and y
    link when a * |difference of x and y| <= b * (n_x + n_y). Let f = a * r - b * n.
    * f(x) + f(y) <= 0 is a link, whatever they share. Then both link with the set of least f as well: one link a set.
    * Otherwise they must share (f(x) + f(y)) / 2a of their changes. Changes that one set has alone are shared with none: with
      q = a * (r - 2 * shared ones) - b * n, also q(x) + f(y) <= 0 and f(x) + q(y) <= 0. Sets for which no partner in the
      family can satisfy that leave; the others meet where prefixes of their changes, rarest first, have one in common.
    * A set further from the base than half its size is a family of its own beside that, and so meets all others.
    """
    a, b = 100 + percent, 100 - percent
    inside = signed.join(large, "sign").select("sign", "node", "n", "most", "score", "head")
    family = shared.written(inside.groupBy("node").agg(F.max("head").alias("head")).select("node", F.col("head.node").alias("family")), "families")
    members = whole.join(shared.checked_broadcast(family), "node").select("family", "node", "n", "hashes")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    held = members.select("family", F.explode("hashes").alias("hash")).groupBy("family", "hash").agg(F.count(F.lit(1)).alias("held"))
    base = held.join(sizes, "family").filter(F.col("held") * 2 > F.col("members")).groupBy("family").agg(F.collect_list("hash").alias("base"))
    base = shared.written(sizes.join(base, "family", "left").select("family", F.coalesce("base", F.array().cast("array<bigint>")).alias("base")), "bases")
    entries = base.agg(F.sum(F.size("base") + 10)).first()[0] or 0

    def sent(of_families: DataFrame) -> DataFrame:
        return F.broadcast(of_families) if entries <= shared.BROADCAST_ROWS else of_families

    change = F.concat(F.array_except("hashes", "base"), F.array_except("base", "hashes"))
    placed = members.join(sent(base), "family").select("family", "node", "n", change.alias("change"), F.size("base").alias("b"))
    placed = placed.withColumn("r", F.size("change")).withColumn("f", a * F.col("r") - b * F.col("n"))
    placed = shared.written(placed.withColumn("far", 2 * F.col("r") > F.col("b")), "placed")
    near = placed.filter(2 * percent * F.col("r") <= percent * F.col("b") + 2 * b * F.col("n"))

    changes = near.select("family", "node", F.explode("change").alias("token"))
    often = shared.written(changes.groupBy("family", "token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "changes")
    common = changes.join(shared.checked_broadcast(often), ["family", "token"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("common"))
    near = near.drop("change").join(common, "node", "left").withColumn("m", F.when(F.col("common").isNull(), 0).otherwise(F.size("common")))
    near = shared.written(near.withColumn("q", a * (F.col("r") - 2 * F.col("m")) - b * F.col("n")), "near")
    lead = near.groupBy("family").agg(F.min(F.struct("f", "node")).alias("lead"), F.min("q").alias("q_min"))
    led = near.join(sent(lead.select("family", F.col("lead.f").alias("f_min"), F.col("lead.node").alias("lead"), "q_min")), "family")
    links = led.filter((F.col("f") + F.col("f_min") <= 0) & (F.col("node") != F.col("lead"))).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    alive = (F.col("f") + F.col("f_min") > 0) & (F.col("f") + F.col("q_min") <= 0) & (F.col("q") + F.col("f_min") <= 0)
    led = led.withColumn("alive", alive)
    led = led.join(sent(led.filter("alive").groupBy("family").agg(F.min("f").alias("f_alive"), F.min("q").alias("q_alive"))), "family")
    partner = (F.col("f") + F.col("q_alive") <= 0) & (F.col("q") + F.col("f_alive") <= 0)

    def prefixes(some: DataFrame, bound: str) -> DataFrame:
        share = F.greatest(F.lit(1), F.ceil((F.col("f") + F.col(bound)) / (2 * a))).cast("int")
        some = some.withColumn("length", F.col("m") - share + 1).filter("length > 0")
        return some.select("family", "node", "f", "q", "alive", F.explode(F.slice("common", 1, F.col("length"))).alias("x")).withColumn("token", F.col("x.token")).drop("x")

    right = prefixes(led.filter(partner), "f_alive").select("family", "token", *(F.col(c).alias(f"other_{c}") for c in ("node", "f", "q", "alive")))
    possible = (F.col("q") + F.col("other_f") <= 0) & (F.col("f") + F.col("other_q") <= 0)
    once = F.when(F.col("other_alive"), F.col("node") < F.col("other_node")).otherwise(True)
    pairs = prefixes(led.filter("alive"), "f_min").join(right, ["family", "token"]).filter(possible & once)
    pairs = pairs.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()

    own = placed.select("node", F.when(F.col("far"), F.col("node")).otherwise(F.col("family")).alias("family"))
    several = inside.drop("head").join(shared.checked_broadcast(shared.written(own, "own")), "node")
    counted = several.groupBy("sign", "family").agg(F.count(F.lit(1)).alias("times")).groupBy("sign").agg(F.max(F.struct("times", "family")).alias("main"), F.count(F.lit(1)).alias("families"))
    mixed = several.join(shared.checked_broadcast(shared.written(counted.filter("families > 1").select("sign", F.col("main.family").alias("main")), "mains")), "sign")
    return Families(shared.written(links, "family-links"), shared.written(pairs, "family-pairs"), shared.written(mixed, "mixed"))


def _verified_links(docs: DataFrame, sets: DataFrame, firsts: DataFrame, signed: DataFrame, whole: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links enough to join every component: those within families of large signatures; in the other signatures each candidate
    against the first of all its signatures' heads, then against those heads that lie in other components, then candidates of
    one signature across components."""
    near = F.col("n") * 100 >= F.col("other_n") * percent
    near = near & (F.col("other_n") * 100 >= F.col("n") * percent)
    both = F.col("n") + F.col("other_n")
    enough = F.least("most", "other_most") * (100 + percent) >= both * percent
    enough = enough & ((both - F.col("most") - F.col("other_most")) * (100 + percent) <= both * (100 - percent))
    near = near & ((F.col("score") == 0) | (F.col("other_score") == 0) | enough)

    def beside(rows: DataFrame, *more: str) -> DataFrame:
        names = {"node": "other", "n": "other_n", "most": "other_most", "score": "other_score", "root": "other_root", "family": "other_family"}
        return rows.select("sign", *(F.col(c).alias(names[c]) for c in ("node", "n", "most", "score", *more)))

    heads = signed.groupBy("sign").agg(F.max(F.struct("score", "most", "n", "node")).alias("head"), F.count(F.lit(1)).alias("members"), F.min("score").alias("least")).filter("members > 1")
    heads = shared.written(heads, "heads")
    # light sets, of score 0, are not at hand in whole; their signatures are rare shingles, so they are few
    is_large = (F.col("members") > LARGE) & (F.col("least") > 0)
    large = shared.checked_broadcast(shared.written(heads.filter(is_large).select("sign", "head"), "large"))
    families = _families(signed, large, whole, percent)
    shown = shared.written(signed.join(beside(heads.filter(~is_large).select("sign", "head.*")), "sign"), "shown")
    met = shown.filter(near & (F.col("node") != F.col("other")))
    best = met.groupBy("node").agg(F.max(F.struct("other_score", "other_most", "other_n", "other")).alias("head"))
    firstly = shared.written(best.select(F.col("node").alias("a"), F.col("head.other").alias("b")).union(families.pairs), "firstly")
    links = families.links.union(_links_of(docs, sets, firsts, firstly, shingle, percent))

    roots = shared.checked_broadcast(components(links))
    others = roots.select(F.col("node").alias("other"), F.col("root").alias("other_root"))
    rest = met.join(roots, "node", "left").join(others, "other", "left").filter(F.coalesce("root", "node") != F.coalesce("other_root", "other"))
    rest = rest.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct().join(firstly, ["a", "b"], "left_anti")
    rest = shared.written(rest, "pairs")
    links = links.union(_links_of(docs, sets, firsts, rest, shingle, percent))

    roots = shared.checked_broadcast(components(links))

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    placed = shared.written(rooted(shown.select("sign", "node", "n", "most", "score")), "rooted")
    apart = placed.groupBy("sign").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("sign")
    placed = placed.join(apart, "sign")
    across = placed.join(beside(placed, "root"), "sign").filter((F.col("root") < F.col("other_root")) & near)
    mixed = rooted(families.mixed)
    beyond = mixed.filter("family <> main").join(beside(mixed, "root", "family"), "sign")
    beyond = beyond.filter((F.col("family") != F.col("other_family")) & (F.col("root") != F.col("other_root")) & near)
    across = across.select(F.col("node").alias("a"), F.col("other").alias("b")).union(beyond.select(F.least("node", "other"), F.greatest("node", "other"))).distinct()
    tried = firstly.union(rest)
    across = shared.written(across.join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti"), "across")
    return links.union(_links_of(docs, sets, firsts, across, shingle, percent))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", **settings) -> DataFrame:
    """The rows of docs, with all their columns, of which no linked row has a lesser id; one of equal rows. Rows without words stay."""
    found = shared.written(link_components(docs, id_column, **settings).filter("n_shingles > 0"), "components")
    key = F.struct(F.col(id_column).isNull(), F.col(id_column).alias("id"), F.col("text_key").alias("key"))
    first = shared.written(found.groupBy("root").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1"), "first")
    named = shared.spread_join(found, first, "root").withColumn("first", F.coalesce("first", key))
    named = named.withColumn("stays", (F.col("first.key") == F.col("text_key")) & F.col("first.id").eqNullSafe(F.col(id_column)))
    named = named.groupBy(F.col(id_column).alias("_id"), F.col("text_key").alias("_key")).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    named = shared.written(named.filter(~F.col("stays") | (F.col("times") > 1)), "others")
    same = docs[id_column].eqNullSafe(named["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(named["_key"])
    out = docs.join(shared.checked_broadcast(named), same, "left_anti")
    again = shared.written(named.filter("stays"), "repeated")
    if again.limit(1).count():
        same = docs[id_column].eqNullSafe(again["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(again["_key"])
        out = out.union(docs.join(shared.checked_broadcast(again), same, "left_semi").dropDuplicates([id_column, "text"]))
    return out


def op8_combination_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")


def sql(shingle: int = 5, percent: int = 80) -> str:
    """The same in plain SQL for DuckDB: all pairs of documents with a shingle in common, and what links reach."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""with recursive words as (select doc_id, coalesce(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+'), []) as ws from documents),
        shingles as materialized (select distinct doc_id, array_to_string(ws[i:i + {shingle - 1}], ' ') as s from words, range(1, greatest(len(ws) - {shingle - 1}, 1) + 1) as starts(i) where len(ws) > 0),
        sizes as materialized (select doc_id, count(*) as n from shingles group by all),
        pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingles as a join shingles as b on a.s = b.s and a.doc_id < b.doc_id group by all),
        links as materialized (select a, b from pairs join sizes as x on x.doc_id = a join sizes as y on y.doc_id = b where 100 * common >= {percent} * (x.n + y.n - common)),
        both_ways as (select a, b from links union all select b, a from links),
        reach as (select a as node, b as other from both_ways union select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a)
        select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id from words left join sizes using (doc_id) left join (select node, min(other) as low from reach group by node) as r on r.node = doc_id"""
