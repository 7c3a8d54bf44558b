"""URL filters: fixed rules first, then a tree of path templates for each host.

Segments of a host's paths form a tree. Level by level, a segment that looks like an id (a number, a hash) or has few pages
goes into its parent's wildcard `*`, unless its labelled pages, and those of the same branch on other hosts, draw its share of
blocked pages far from that of the wildcard's others. Named segments are held against those of their parent that mostly go on to the same next segments: where a segment's next
segments share out as theirs do and its labels do not draw it away either, it is merged into one branch with them. A
path's template is its way down this tree. Beyond DEPTH, segments are one `**`, so every path has a template.

The pages that a rule names are the labels. A template's purity, its share of blocked labelled pages, is smoothed: on a host it
is drawn towards the same template's purity on all hosts of the domain (the last two names), this towards its purity on all
hosts, and this towards EXPECTED, each with the weight of SMOOTH pages. So labels reach the pages that no rule names. A template
is rejected from REJECT on; `evidence` says how far its labels are from it: host, domain, all or none.

All counts are sums over (host, template, segment), no two branches are compared in pairs, and keys of many rows are joined
where their rows are. Defined results: a url without `://` or a null one has an empty host and path, fits no rule, and is
judged by the template of empty paths; repeated pages are rows of their own; other columns, of any names, are kept by `judged`
but for those that it makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import shared

#: (host, path prefix, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEPTH = 6
#: A segment of fewer pages goes into the wildcard.
BRANCH_PAGES = 5
#: Next segments that hold this share of a segment's pages say which others it is held against.
MAIN_SHARE = 0.1
#: Branches whose next segments share out this alike (1: the same) are merged.
ALIKE = 0.9
#: They are not merged if their smoothed shares of blocked pages differ by more.
SAME_SHARE = 0.2
#: The share of blocked pages that a template without labelled pages is taken to have, and its weight in pages.
EXPECTED, SMOOTH = 0.3, 5.0
#: A template is rejected from this share of blocked pages on.
REJECT = 0.6
_ID_LIKE = r"^(\d+|[0-9a-f]{8,}|[0-9a-fA-F-]{32,36}|.*\d{3,}.*)(\.[A-Za-z0-9]{1,5})?$"


def _split(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty if it has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls; of equally long ones the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for where, start, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, where + start).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _segments(path: Column, depth: int) -> Column:
    """A path's first segments, then `**` for the others together, then `$` for its end."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    head = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)
    return F.concat(head, F.array(F.lit("$")))


_COUNTS = ["pages", "blocked", "labelled", "held"]
_PARENT = ["host", "template"]
_CHILD = [*_PARENT, "segment"]


def _purity(prior: Column | float = EXPECTED, blocked: str = "blocked", labelled: str = "labelled") -> Column:
    return (F.col(blocked) + SMOOTH * (F.lit(prior) if isinstance(prior, float) else prior)) / (F.col(labelled) + SMOOTH)


def _as_others() -> Column:
    """Whether a member's labels leave its purity about where its group's other members have it."""
    others = (F.col("all_blocked") - F.col("blocked") + SMOOTH * EXPECTED) / (F.col("all_labelled") - F.col("labelled") + SMOOTH)
    return F.abs(_purity(others, "like_blocked", "like_labelled") - others) <= SAME_SHARE


def _branches(paths: DataFrame) -> DataFrame:
    """host, template, segment, branch, held: where each segment leads, from host, template (so far), segment, next and counts."""
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    children = shared.written(paths.groupBy(*_CHILD, "next").agg(*sums), "children")
    own = shared.written(children.groupBy(*_CHILD).agg(*sums), "own")
    elsewhere = own.groupBy("template", "segment").agg(F.sum("blocked").alias("blocked_a"), F.sum("labelled").alias("labelled_a"), F.count(F.lit(1)).alias("held"))
    own = shared.spread_join(own, shared.written(elsewhere, "elsewhere"), ["template", "segment"])
    weight = SMOOTH / (F.col("labelled_a") + SMOOTH)  # the same branch on all hosts counts as up to SMOOTH labelled pages
    own = own.withColumns({"like_blocked": F.col("blocked") + weight * F.col("blocked_a"), "like_labelled": F.col("labelled") + weight * F.col("labelled_a")}).drop("blocked_a", "labelled_a")
    fixed, variable = F.col("segment").isin("$", "**"), F.col("segment").rlike(_ID_LIKE) | (F.col("pages") < BRANCH_PAGES)
    own = shared.written(own.withColumns({"fixed": fixed, "variable": ~fixed & variable}), "own")

    pool = own.filter("variable").groupBy(*_PARENT).agg(F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled"), F.count(F.lit(1)).alias("held"))
    wild = shared.spread_join(own.filter("variable"), shared.written(pool, "pools"), _PARENT)
    wild = wild.select(*_CHILD, F.when(_as_others(), "*").otherwise(F.col("segment")).alias("branch"), "held")

    named = own.filter("not fixed and not variable").select(*_CHILD, "like_blocked", "like_labelled", "blocked", "labelled", F.col("pages").alias("all_pages"))
    like = F.when(F.col("next").rlike(_ID_LIKE), "*").otherwise(F.col("next"))
    shares = children.join(named, _CHILD).groupBy(*_CHILD, like.alias("next")).agg(F.sum("pages").alias("n"), F.first("all_pages").alias("all_pages"))
    shares = shared.written(shares.withColumn("share", F.col("n") / F.col("all_pages")), "shares")
    main = shares.groupBy(*_CHILD).agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("share") >= MAIN_SHARE, F.col("next")))), "/").alias("main"))
    shares = shares.join(main, _CHILD)
    group = [*_PARENT, "main"]
    pooled = shares.groupBy(*group, "next").agg(F.sum("n").alias("group_n"))
    sizes = main.join(own.drop("held"), _CHILD).groupBy(*group).agg(F.sum("pages").alias("group_pages"), F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled"))
    pooled = pooled.join(sizes, group)
    overlap = F.sum(F.least(F.col("share"), F.col("group_n") / F.col("group_pages"))).alias("overlap")
    alike = shares.join(pooled, [*group, "next"]).groupBy(*_CHILD, "main").agg(overlap, *(F.first(c).alias(c) for c in ("all_blocked", "all_labelled")))
    alike = alike.filter(F.col("overlap") >= ALIKE).join(named, _CHILD).filter(_as_others())
    alike = shared.written(alike.select(*_CHILD, "main"), "alike")
    first = alike.groupBy(*group).agg(F.min("segment").alias("branch"))
    merged = alike.join(first, group).select(*_CHILD, "branch")
    stays = own.filter("not variable").select(*_CHILD, "held").join(merged, _CHILD, "left")
    return wild.unionByName(stays.withColumn("branch", F.coalesce("branch", "segment")))


def templates(paths: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, path, counts, template from distinct host and path with their counts of pages, blocked and labelled ones."""
    paths = paths.withColumns({"held": F.lit(1).cast("bigint"), "segments": _segments(F.col("path"), depth), "template": F.lit("")})
    paths = shared.written(paths, "paths")
    for level in range(depth + 2):
        rest = paths.filter(F.size("segments") > level)
        if not rest.limit(1).count():
            break
        segment, following = F.get("segments", F.lit(level)), F.coalesce(F.get("segments", F.lit(level + 1)), F.lit(""))
        lead = shared.written(_branches(rest.select(*_PARENT, segment.alias("segment"), following.alias("next"), *_COUNTS)), "branches")
        now = shared.spread_join(paths.withColumn("segment", F.coalesce(segment, F.lit(""))), lead, _CHILD)
        step = F.when(F.col("branch").isNull() | (F.col("branch") == "$"), "").otherwise(F.concat(F.lit("/"), F.col("branch")))
        paths = shared.written(now.select("host", "path", *_COUNTS, "segments", F.concat("template", step).alias("template")), "paths")
    return paths.select("host", "path", "pages", "blocked", "labelled", "template")


def purities(known: DataFrame) -> DataFrame:
    """host, template, purity and evidence, from the counts of paths: each level is drawn towards the one above it."""
    domain = F.substring_index("host", ".", -2)
    sums = lambda x: [F.sum(c).alias(f"{c}_{x}") for c in ("blocked", "labelled")]
    by_host = known.groupBy("host", domain.alias("domain"), "template").agg(*sums("h"))
    by_host = shared.written(by_host, "by-host")
    by_domain = by_host.groupBy("domain", "template").agg(*(F.sum(f"{c}_h").alias(f"{c}_d") for c in ("blocked", "labelled")), F.count(F.lit(1)).alias("held"))
    by_domain = shared.written(by_domain, "by-domain")
    everywhere = by_domain.groupBy("template").agg(*(F.sum(f"{c}_d").alias(f"{c}_a") for c in ("blocked", "labelled")), F.count(F.lit(1)).alias("held"))
    domains = shared.spread_join(by_domain, shared.written(everywhere, "everywhere"), ["template"])
    prior = _purity(_purity(blocked="blocked_a", labelled="labelled_a"), "blocked_d", "labelled_d")
    domains = shared.written(domains.select("domain", "template", "held", prior.alias("prior"), "labelled_d", "labelled_a"), "domains")
    hosts = shared.spread_join(by_host, domains, ["domain", "template"])
    evidence = F.when(F.col("labelled_h") > 0, "host").when(F.col("labelled_d") > 0, "domain").when(F.col("labelled_a") > 0, "all").otherwise("none")
    return hosts.select("host", "template", _purity(F.col("prior"), "blocked_h", "labelled_h").alias("purity"), evidence.alias("evidence"))


_MADE = ["host", "path", "rule", "verdict", "template", "purity", "evidence"]


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url: str = "url", depth: int = DEPTH) -> DataFrame:
    """pages with host, path, rule, verdict, template, purity (the smoothed share of blocked pages) and evidence."""
    kept = [c for c in pages.columns if c not in _MADE]
    host, path = _split(F.col(f"`{url}`"))
    pages = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("page"), host.alias("host"), path.alias("path"))
    name, says = _longest_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    pages = pages.withColumns({"rule": name, "says": says})
    count = lambda kept: F.sum(F.when(kept, 1).otherwise(0))
    paths = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), count(F.col("says") == "block").alias("blocked"), count(F.col("says").isNotNull()).alias("labelled"))
    known = shared.written(templates(paths, depth), "templates")
    held = known.groupBy(*_PARENT).agg(F.count(F.lit(1)).alias("held"))
    found = shared.written(purities(known).join(held, _PARENT), "purities")
    verdicts = shared.spread_join(known.select("host", "path", "template", "pages"), found, _PARENT)
    verdicts = shared.written(verdicts.withColumnRenamed("pages", "held"), "verdicts")
    out = shared.spread_join(pages, verdicts, ["host", "path"])
    verdict = F.coalesce("says", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select("page.*", "host", "path", "rule", verdict.alias("verdict"), "template", "purity", "evidence")


def op7_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity", "evidence")
