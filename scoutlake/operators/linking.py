"""Opponent links that are made or undone by hand, with all that follows in other tables.

A snapshot is a dict of tables: teams (id, name, membership_type, public_id, season_year, is_active), links (id, our_team_id,
opponent_name, public_id, resolution_method, resolved_team_id, resolved_at), opponents (our_team_id, opponent_team_id,
first_seen_year), and any table of REASSIGNED. A batch of requests is judged by the snapshot before it: of requests for one
link the last (by seq) counts, of slugs for one team the last, and of new ids for one old stub the first. What a batch decides is used by
every table, so it is written down once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.operators import identity, tables
from scoutlake.operators.merges import Rule

#: Where a stub's id stands. Rows whose key the new team has already keep the stub's id, but in DROPPED they go.
REASSIGNED = {
    "home_games": Rule(("home_team_id",), ("home_team_id", "game_stream_id")),
    "away_games": Rule(("away_team_id",), ("away_team_id", "game_stream_id")),
    "batting": Rule(("team_id",), ("team_id", "game_id", "player_id", "perspective_team_id")),
    "pitching": Rule(("team_id",), ("team_id", "game_id", "player_id", "perspective_team_id")),
    "season_batting": Rule(("team_id",), ("team_id", "player_id", "season_id")),
    "season_pitching": Rule(("team_id",), ("team_id", "player_id", "season_id")),
    "rosters": Rule(("team_id",), ("team_id", "player_id", "season_id")),
    "balls": Rule(("team_id",)),
    "plays": Rule(("batting_team_id",)),
}
DROPPED = {
    "balls": Rule(("perspective_team_id",), ("event_id", "perspective_team_id")),
    "plays": Rule(("perspective_team_id",), ("game_id", "play_order", "perspective_team_id")),
    "perspectives": Rule(("perspective_team_id",), ("game_id", "perspective_team_id")),
}

#: Over so many tasks one team's or one name's links are dealt, where a run of the resolver joins them.
PLACES = 16


def tracked_stubs(wanted: DataFrame, teams: DataFrame, opponents: DataFrame) -> DataFrame:
    """wanted (our_team_id, opponent_name) with stub_id: a tracked team of that name among our opponents, else among all. One
    without a slug comes first, of these the highest id; several with slugs are none."""
    wanted = wanted.select("our_team_id", "opponent_name").distinct()
    named = teams.filter("membership_type = 'tracked'").select("id", F.col("name").alias("opponent_name"), "public_id")
    pick = [F.max(F.when(F.col("public_id").isNull(), F.col("id"))).alias("bare"), F.max("id").alias("one"), F.count(F.lit(1)).alias("n")]
    chosen = F.coalesce("bare", F.when(F.col("n") == 1, F.col("one")))
    # names are few beside teams: each tier is one aggregation, no team meets another
    ours = opponents.select("our_team_id", F.col("opponent_team_id").alias("id")).join(named, "id").join(wanted, ["our_team_id", "opponent_name"], "left_semi")
    near = ours.groupBy("our_team_id", "opponent_name").agg(*pick).select("our_team_id", "opponent_name", F.lit(True).alias("near"), chosen.alias("near_id"))
    far = named.groupBy("opponent_name").agg(*pick).select("opponent_name", chosen.alias("far_id"))
    rows = wanted.join(near, ["our_team_id", "opponent_name"], "left").join(far, "opponent_name", "left")
    return rows.select("our_team_id", "opponent_name", F.when(F.col("near"), F.col("near_id")).otherwise(F.col("far_id")).alias("stub_id"))


def reassigned(rows: DataFrame, names: DataFrame, rule: Rule, drop: bool = False) -> tuple[DataFrame, DataFrame]:
    """rows with the new ids of names (old_id, new_id; one column), and how many rows each old id lost to its new one. Rows
    whose key is taken keep the old id, or go."""
    (column,) = rule.columns
    out = rows.withColumn("_was", F.col(column)).join(names.select(F.col("old_id").alias(column), "new_id"), column, "left")
    out = out.withColumns({"_moves": F.col("new_id").isNotNull() & (F.col("new_id") != F.col(column)), column: F.coalesce("new_id", column)})
    if rule.keys:
        keys = list(rule.keys)
        whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in keys))
        taken = rows.select(*keys).filter(whole).distinct().withColumn("_taken", F.lit(True))
        first = Window.partitionBy(*keys).orderBy("_was")
        moving = out.filter(F.col("_moves") & whole).join(taken, keys, "left").withColumn("_nth", F.dense_rank().over(first))
        lost = F.coalesce("_taken", F.lit(False)) | (F.col("_nth") > 1)
        late = moving.filter(lost).drop("_taken", "_nth")
        late = late.limit(0) if drop else late.withColumns({column: F.col("_was"), "_moves": F.lit(False)})
        out = out.filter(~(F.col("_moves") & whole)).unionByName(moving.filter(~lost).drop("_taken", "_nth")).unionByName(late)
    counts = out.filter("_moves").groupBy(F.col("_was").alias("old_id")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*rows.columns), counts


def reassign_all(snapshot: dict[str, DataFrame], names: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table of the snapshot with the new ids, and rows moved by old id."""
    out, counts = dict(snapshot), []
    for rules, drop in ((REASSIGNED, False), (DROPPED, True)):
        for t, rule in rules.items():
            table = "games" if t.endswith("_games") else t
            if table in out:
                out[table], n = reassigned(out[table], names, rule, drop)
                counts.append(n)
    if not counts:
        return out, names.select("old_id", F.lit(0).cast("bigint").alias("rows_moved")).limit(0)
    return out, reduce(DataFrame.unionByName, counts).groupBy("old_id").agg(F.sum("n").alias("rows_moved"))


def _decided(requests: DataFrame, teams: DataFrame, opponents: DataFrame) -> DataFrame:
    """Requests with their stub, the owner of the slug, and the team that the link will name."""
    last = requests.groupBy("link_id").agg(F.max_by(F.struct(*(c for c in requests.columns if c != "link_id")), "seq").alias("_r")).select("link_id", "_r.*")
    rows = last.join(tracked_stubs(last, teams, opponents), ["our_team_id", "opponent_name"])
    owners = teams.filter("public_id is not null").groupBy("public_id").agg(F.min_by(F.struct(F.col("id").alias("owner_id"), F.col("name").alias("owner_name")), "id").alias("_o")).select("public_id", "_o.*")
    rows = rows.join(owners, "public_id", "left").join(teams.select(F.col("id").alias("stub_id"), F.col("public_id").alias("stub_slug")), "stub_id", "left")
    merged = F.col("stub_id").isNotNull() & F.col("owner_id").isNotNull() & (F.col("owner_id") != F.col("stub_id"))
    highest = teams.agg(F.coalesce(F.max("id"), F.lit(0)).alias("highest"))  # one row
    fresh = rows.filter("stub_id is null and owner_id is null").select("public_id").distinct()
    fresh = fresh.withColumn("_n", F.row_number().over(Window.orderBy("public_id"))).join(F.broadcast(highest)).select("public_id", (F.col("highest") + F.col("_n")).alias("fresh_id"))  # a batch's new slugs
    rows = rows.join(fresh, "public_id", "left")
    resolved = F.when(merged | F.col("stub_id").isNull(), F.coalesce("owner_id", "fresh_id")).otherwise(F.col("stub_id"))
    return rows.select("link_id", "seq", "our_team_id", "opponent_name", "public_id", "stub_id", "fresh_id", merged.alias("merged"), F.when(merged, F.col("owner_name")).alias("merged_team_name"), resolved.alias("resolved_team_id"))


def finalized(snapshot: dict[str, DataFrame], resolved: DataFrame, this_year: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The snapshot after resolutions (seq, our_team_id, opponent_name, resolved_team_id) are written through: opponents, active
    teams, and the old stubs' rows; and for each resolution its old stub, if that is another team."""
    teams, opponents = snapshot["teams"], snapshot["opponents"]
    rows = resolved.join(tracked_stubs(resolved, teams, opponents), ["our_team_id", "opponent_name"])
    rows = tables.settled(rows.withColumn("old_id", F.when(F.col("stub_id") != F.col("resolved_team_id"), F.col("stub_id"))).drop("stub_id"))
    years = teams.select(F.col("id").alias("our_team_id"), "season_year")
    pairs = rows.join(years, "our_team_id", "left").withColumn("_year", F.coalesce("season_year", F.lit(this_year)))
    was = opponents.select("our_team_id", F.col("opponent_team_id").alias("old_id"), F.col("first_seen_year").alias("_old_year"), F.lit(True).alias("_known"))
    pairs = pairs.join(was, ["our_team_id", "old_id"], "left")
    gone = pairs.filter("old_id is not null").select("our_team_id", F.col("old_id").alias("opponent_team_id")).distinct()
    new = pairs.groupBy("our_team_id", F.col("resolved_team_id").alias("opponent_team_id")).agg(F.min_by(F.coalesce("_old_year", "_year"), "seq").cast(opponents.schema["first_seen_year"].dataType).alias("first_seen_year"))
    key = ["our_team_id", "opponent_team_id"]
    left = opponents.join(gone, key, "left_anti")
    out = snapshot | {"opponents": left.unionByName(new.join(opponents.select(*key), key, "left_anti").select(*opponents.columns))}
    active = rows.select(F.col("resolved_team_id").alias("id"), F.lit(True).alias("_on")).distinct()
    out["teams"] = teams.join(active, "id", "left").withColumn("is_active", F.when(F.col("_on"), F.lit(1).cast(teams.schema["is_active"].dataType)).otherwise(F.col("is_active"))).select(*teams.columns)
    names = tables.settled(rows.filter("old_id is not null").groupBy("old_id").agg(F.min_by("resolved_team_id", "seq").alias("new_id")))
    out, moved = reassign_all(out, names)
    return out, rows.join(moved, "old_id", "left").withColumn("rows_moved", F.coalesce("rows_moved", F.lit(0)))


def save_manual_links(snapshot: dict[str, DataFrame], requests: DataFrame, now: Column, this_year: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The snapshot after requests (seq, link_id, public_id, our_team_id, opponent_name), and what became of each link.

    The slug goes to the opponent's stub, unless another team owns it: then the link names that team (merged) and the stub keeps
    what it has. Without a stub the link names the slug's team, which is made if there is none.
    """
    teams, links = snapshot["teams"], snapshot["links"]
    decided = tables.settled(_decided(requests, teams, snapshot["opponents"]))
    slugs = decided.filter("stub_id is not null and not merged").groupBy(F.col("stub_id").alias("id")).agg(F.max_by("public_id", "seq").alias("_slug"))
    fresh = decided.filter("fresh_id is not null").groupBy(F.col("fresh_id").alias("id")).agg(F.min_by("opponent_name", "seq").alias("name"), F.first("public_id").alias("public_id"))
    made = fresh.withColumns({"membership_type": F.lit("tracked"), "is_active": F.lit(0), "season_year": F.lit(None)})
    made = made.select(*(F.col(f.name).cast(f.dataType) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in teams.schema))
    named = teams.join(slugs, "id", "left").withColumn("public_id", F.coalesce("_slug", "public_id")).select(*teams.columns).unionByName(made)
    said = decided.select(F.col("link_id").alias("id"), F.col("public_id").alias("_slug"), F.col("resolved_team_id").alias("_team"), F.lit(True).alias("_said"))
    put = links.join(said, "id", "left")
    for c, value in (("public_id", F.col("_slug")), ("resolution_method", F.lit("manual")), ("resolved_team_id", F.col("_team")), ("resolved_at", now)):
        put = put.withColumn(c, F.when(F.col("_said"), value).otherwise(F.col(c)))
    out, through = finalized(snapshot | {"teams": named, "links": put.select(*links.columns)}, decided.select("seq", "link_id", "our_team_id", "opponent_name", "resolved_team_id"), this_year)
    slug = out["teams"].select(F.col("id").alias("resolved_team_id"), F.col("public_id").alias("effective_public_id"))
    result = decided.select("link_id", "merged", "merged_team_name", "resolved_team_id").join(through.select("link_id", F.col("old_id").alias("old_stub_team_id"), "rows_moved"), "link_id").join(slug, "resolved_team_id", "left")
    return out, result


def disconnected(snapshot: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The snapshot after links (id) are undone, and for each whether it was. Only manual links are. The team loses its slug
    unless another link names it, or the last of the links took the slug from a team that had it before (a merge)."""
    teams, links = snapshot["teams"], snapshot["links"]
    asked = ids.select("id").distinct().join(links, "id", "left")
    manual = asked.filter("resolution_method = 'manual'")
    stubs = tracked_stubs(manual, teams, snapshot["opponents"])
    judged = manual.join(stubs, ["our_team_id", "opponent_name"]).filter("resolved_team_id is not null")
    own = ~F.coalesce(F.col("stub_id") != F.col("resolved_team_id"), F.lit(False))
    last = judged.groupBy("resolved_team_id").agg(F.max_by(own, "id").alias("own")).filter("own").select("resolved_team_id")
    others = links.join(manual.select("id"), "id", "left_anti").select("resolved_team_id")
    bare = last.join(others, "resolved_team_id", "left_anti").select(F.col("resolved_team_id").alias("id"), F.lit(True).alias("_bare"))
    undone = links.join(manual.select("id", F.lit(True).alias("_undone")), "id", "left")
    for c in ("public_id", "resolution_method", "resolved_team_id", "resolved_at"):
        undone = undone.withColumn(c, F.when(F.col("_undone").isNull(), F.col(c)))
    out = snapshot | {"links": undone.select(*links.columns)}
    out["teams"] = teams.join(bare, "id", "left").withColumn("public_id", F.when(F.col("_bare").isNull(), F.col("public_id"))).select(*teams.columns)
    return out, asked.select("id", F.coalesce(F.col("resolution_method") == "manual", F.lit(False)).alias("disconnected"))


def repairs(snapshot: dict[str, DataFrame]) -> DataFrame:
    """What writing every resolved link through would do: link_id, our_team_id, resolved_team_id, action, activates."""
    teams, key = snapshot["teams"], ["our_team_id", "resolved_team_id"]
    rows = snapshot["links"].filter("resolved_team_id is not null").select(F.col("id").alias("link_id"), *key, "opponent_name")
    rows = rows.join(teams.select(F.col("id").alias("our_team_id")), "our_team_id", "left_semi")
    known = snapshot["opponents"].select("our_team_id", F.col("opponent_team_id").alias("resolved_team_id"), F.lit(True).alias("_known")).distinct()
    active = teams.select(F.col("id").alias("resolved_team_id"), (F.col("is_active") == 1).alias("_active"))
    rows = rows.join(known, key, "left").join(active, "resolved_team_id", "left").join(tracked_stubs(rows, teams, snapshot["opponents"]), ["our_team_id", "opponent_name"])
    idle = ~F.coalesce("_active", F.lit(False))
    action = F.when(F.col("stub_id") != F.col("resolved_team_id"), F.format_string("REPLACE stub (team %d)", "stub_id")).when(F.col("_known").isNull(), "CREATE").when(idle, "ACTIVATE").otherwise("VERIFY")
    return rows.select("link_id", *key, action.alias("action"), idle.alias("activates"))


def repaired(snapshot: dict[str, DataFrame], this_year: int) -> dict[str, DataFrame]:
    """The snapshot after every resolved link is written through, in the order of the links."""
    rows = snapshot["links"].filter("resolved_team_id is not null").select(F.col("id").alias("seq"), "our_team_id", "opponent_name", "resolved_team_id")
    rows = rows.join(snapshot["teams"].select(F.col("id").alias("our_team_id")), "our_team_id", "left_semi")
    return finalized(snapshot, rows, this_year)[0]


def _joined_evenly(rows: DataFrame, others: DataFrame, keys: list[str], by: str, places: int = 1) -> DataFrame:
    """rows left joined with others. Rows without a key meet none, and are dealt over all tasks by the column `by`; a key's are
    dealt over so many places, each with its copy of others."""
    keyed, place = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in keys)), F.xxhash64(by)
    copied = others.withColumn("_place", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(places)))))
    return rows.withColumn("_place", F.when(keyed, F.pmod(place, F.lit(places))).otherwise(place)).join(copied, [*keys, "_place"], "left").drop("_place")


def resolve_opponents(links: DataFrame, feed: DataFrame, details: DataFrame, hits: DataFrame, teams: DataFrame, now: Column, this_year: int) -> tuple[DataFrame, DataFrame]:
    """Links after a run of the resolver, and for every link that it looked at the method and the reason.

    feed: seq, our_team_id, root_team_id, name, progenitor_team_id, is_hidden; of repeated keys the last counts. details: what the
    service said of a progenitor (progenitor_team_id, public_id, name, season_year). hits: what a search for an opponent's name
    found (query, gc_uuid, public_id, name, season_year). Hidden opponents are skipped; one with a progenitor is resolved by it,
    or an error without details; any other is kept by name. Then each visible link without a method is searched for: exactly one
    hit must have its name (any case) and our team's year. A manual link keeps what it names. Teams are found by uuid, slug, or
    name and year, else made.
    """
    key = ["our_team_id", "root_team_id"]
    ours = links.select("our_team_id").union(feed.select("our_team_id")).distinct()
    feed = feed.groupBy(*key).agg(F.max_by(F.struct("name", "progenitor_team_id", "is_hidden"), "seq").alias("_f")).select(*key, "_f.*")
    known = details.select("progenitor_team_id", F.col("public_id").alias("slug"), F.coalesce("name", "progenitor_team_id").alias("team_name"), "season_year", F.lit(True).alias("told"))
    feed = _joined_evenly(feed, known, ["progenitor_team_id"], "root_team_id")
    shown = ~F.coalesce(F.col("is_hidden"), F.lit(False))
    reason = F.when(~shown, "hidden").when(F.col("progenitor_team_id").isNull(), "no progenitor").when(F.col("told").isNull(), "no details").otherwise("progenitor")
    feed = feed.withColumn("why", reason)

    # the first pass: names are always taken over, what a link names only where it is not manual
    seen = feed.filter("why in ('no progenitor', 'progenitor')").select(*key, F.col("name").alias("_name"), F.col("why"), "progenitor_team_id", "slug", "team_name", F.col("season_year").alias("_year"))
    both = links.join(seen, key, "full_outer")
    manual = F.coalesce(F.col("resolution_method") == "manual", F.lit(False))
    both = both.withColumns({"opponent_name": F.coalesce("_name", "opponent_name"), "is_hidden": F.when(F.col("why").isNotNull(), 0).otherwise(F.col("is_hidden")), "auto": (F.col("why") == "progenitor") & ~manual, "kept": (F.col("why") == "progenitor") & manual})

    # the second: links that no method has resolved
    open_ = F.col("resolution_method").isNull() & ~F.coalesce("auto", F.lit(False)) & (F.col("is_hidden") == 0)
    years = teams.select(F.col("id").alias("our_team_id"), F.coalesce("season_year", F.lit(this_year)).alias("our_year")).join(ours, "our_team_id", "left_semi")
    found = hits.select(F.lower("query").alias("_q"), F.lower("name").alias("_hit"), F.struct("gc_uuid", F.col("public_id").alias("slug"), F.col("name").alias("team_name"), "season_year").alias("hit"))
    found = found.filter("_q = _hit").groupBy("_q", F.col("hit.season_year").alias("our_year")).agg(F.count(F.lit(1)).alias("n_hits"), F.min("hit").alias("hit"))
    # teams and names are few beside links
    both = _joined_evenly(both, years, ["our_team_id"], "root_team_id", PLACES).withColumns({"our_year": F.coalesce("our_year", F.lit(this_year)), "_q": F.when(open_, F.lower("opponent_name"))})
    both = _joined_evenly(both, found, ["_q", "our_year"], "root_team_id", PLACES)
    by_search = open_ & F.coalesce(F.col("n_hits") == 1, F.lit(False))
    both = both.withColumn("method", F.when(F.col("auto"), "auto").when(by_search, "search"))

    # their teams
    uuid = F.when(F.col("auto"), F.col("progenitor_team_id")).otherwise(F.col("hit.gc_uuid"))
    pick = lambda c, d: F.when(F.col("auto"), F.col(c)).otherwise(F.col(d))
    both = both.withColumns({"gc_uuid": F.when(F.col("method").isNotNull(), uuid), "_slug": pick("slug", "hit.slug"), "_team": pick("team_name", "hit.team_name"), "_y": pick("_year", "hit.season_year")})
    wanted = both.filter("gc_uuid is not null").groupBy("gc_uuid").agg(F.min(F.struct(F.col("_slug").alias("public_id"), F.col("_team").alias("name"), F.col("_y").alias("season_year"))).alias("_w")).select("gc_uuid", F.col("gc_uuid").alias("seq"), "_w.*")
    ids = identity.resolved_teams(wanted, teams).select(F.col("seq").alias("gc_uuid"), "team_id", "how").join(wanted.select("gc_uuid", "public_id"), "gc_uuid")
    highest = teams.agg(F.coalesce(F.max("id"), F.lit(0)).alias("highest"))  # one row
    fresh = ids.filter("team_id is null").withColumn("_n", F.row_number().over(Window.orderBy("gc_uuid"))).join(F.broadcast(highest)).select("gc_uuid", (F.col("highest") + F.col("_n")).alias("_fresh"))  # a run's new teams
    slugs = teams.select(F.col("id").alias("team_id"), F.col("public_id").alias("_has"))
    ids = ids.join(fresh, "gc_uuid", "left").join(slugs, "team_id", "left").select("gc_uuid", F.coalesce("team_id", "_fresh").alias("_id"), F.when(F.col("team_id").isNull(), F.col("public_id")).otherwise(F.col("_has")).alias("_has"), F.col("public_id").alias("_says"), "how")
    both = _joined_evenly(both, ids, ["gc_uuid"], "root_team_id")
    slug = F.when(F.col("method") == "search", F.coalesce("_has", "_says")).otherwise(F.col("_has"))
    done = F.col("method").isNotNull()
    put = both.withColumns({c: F.when(done, value).otherwise(F.col(c)) for c, value in (("resolved_team_id", F.col("_id")), ("public_id", slug), ("resolution_method", F.col("method")), ("resolved_at", now))})
    searched = F.when(F.col("n_hits").isNull(), "no exact match").otherwise(F.concat(F.col("n_hits").cast("string"), F.lit(" matches")))
    why = F.when(F.col("kept"), "manual link kept").when(F.col("method") == "auto", F.concat(F.lit("progenitor, team by "), F.col("how"))).when(F.col("method") == "search", F.concat(F.lit("one match, team by "), F.col("how"))).when(open_, searched)
    log = both.filter(F.col("why").isNotNull() | F.col("_q").isNotNull()).select(*key, "method", why.alias("reason"))
    passed = feed.filter("why in ('hidden', 'no details')").select(*key, F.lit(None).cast("string").alias("method"), F.col("why").alias("reason"))
    log = log.join(passed.select(*key), key, "left_anti").unionByName(passed)
    return put.select(*links.columns), log
