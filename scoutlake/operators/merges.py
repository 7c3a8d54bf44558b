"""Merges of players and of teams over a snapshot: ids rewritten in every table, collisions settled table by table, and the
season rows that a merge touches computed anew.

A snapshot is a dict of tables by name. names (duplicate_id, canonical_id) says which id becomes which; many merges are one
pass. A table's rows are unique by its rule's keys. Only rows of merged ids and those that they collide with are compared;
all others pass through, so a merge of a few ids reads a table but shuffles little of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.operators import identity, tables


@dataclass(frozen=True)
class Rule:
    """columns: where ids stand. keys: what may fall together (nothing if empty); a null key collides with nothing. ranks: by
    which column and order a row beats another before the canonical id's own does. apart: two columns that must not become one."""

    columns: tuple[str, ...]
    keys: tuple[str, ...] = ()
    ranks: tuple[str, dict[str, int]] | None = None
    apart: tuple[str, str] | None = None


_COMPLETE = ("stat_completeness", identity.COMPLETENESS)
PLAYER_RULES = {
    "plays": Rule(("batter_id", "pitcher_id")),
    "balls": Rule(("player_id", "pitcher_id")),
    "discrepancies": Rule(("player_id",), ("run_id", "game_id", "perspective_team_id", "team_id", "player_id", "signal_name")),
    "batting": Rule(("player_id",), ("game_id", "player_id", "perspective_team_id"), _COMPLETE),
    "pitching": Rule(("player_id",), ("game_id", "player_id", "perspective_team_id"), _COMPLETE),
    "rosters": Rule(("player_id",), ("team_id", "player_id", "season_id")),
}
TEAM_RULES = {
    "opponents": Rule(("our_team_id", "opponent_team_id"), ("our_team_id", "opponent_team_id"), apart=("our_team_id", "opponent_team_id")),
    "rosters": Rule(("team_id",), ("team_id", "player_id", "season_id")),
    "season_batting": Rule(("team_id",), ("player_id", "team_id", "season_id")),
    "season_pitching": Rule(("team_id",), ("player_id", "team_id", "season_id")),
    "links": Rule(("our_team_id", "resolved_team_id"), ("our_team_id", "root_team_id"), apart=("our_team_id", "resolved_team_id")),
    "scouting_runs": Rule(("team_id",), ("team_id", "season_id", "run_type")),
    "access": Rule(("team_id",), ("user_id", "team_id")),
    "assignments": Rule(("team_id",), ("user_id", "team_id")),
    "games": Rule(("home_team_id", "away_team_id")),
    "batting": Rule(("team_id", "perspective_team_id"), ("game_id", "player_id", "perspective_team_id")),
    "pitching": Rule(("team_id", "perspective_team_id"), ("game_id", "player_id", "perspective_team_id")),
    "balls": Rule(("team_id", "perspective_team_id"), ("event_id", "perspective_team_id")),
    "plays": Rule(("batting_team_id", "perspective_team_id"), ("game_id", "play_order", "perspective_team_id")),
    "perspectives": Rule(("perspective_team_id",), ("game_id", "perspective_team_id")),
    "jobs": Rule(("team_id",)),
}


def final_names(pairs: DataFrame) -> DataFrame:
    """Pairs (duplicate_id, canonical_id) as names: each duplicate once (its least canonical id), with where the chain of
    merges ends. A pair of one id with itself is none; pairs must not run in a circle. Names are written down: every table needs them."""
    names = tables.settled(pairs.filter("duplicate_id <> canonical_id").groupBy("duplicate_id").agg(F.min("canonical_id").alias("canonical_id")))
    on = names.select(F.col("duplicate_id").alias("canonical_id"), F.col("canonical_id").alias("next"))
    while not names.join(on.select("canonical_id"), "canonical_id", "left_semi").isEmpty():  # each round doubles the steps
        names = tables.settled(names.join(on, "canonical_id", "left").select("duplicate_id", F.coalesce("next", "canonical_id").alias("canonical_id")))
        on = names.select(F.col("duplicate_id").alias("canonical_id"), F.col("canonical_id").alias("next"))
    return names


def rewritten(rows: DataFrame, names: DataFrame, rule: Rule) -> DataFrame:
    """rows with canonical ids. Of rows that fall together the best ranked stays, then one whose key was canonical before, then
    the one of the least ids."""
    was = [c for c in rule.columns if c in rule.keys]
    out = rows.withColumns({f"_was_{c}": F.col(c) for c in rule.columns})
    for c in rule.columns:
        out = identity.renamed(out, names, c)
    moved = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_was_{c}")) for c in was), F.lit(False))
    if rule.apart:
        touched = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_was_{c}")) for c in rule.columns))
        one, two = rule.apart
        out = out.filter(~F.coalesce(touched & (F.col(one) == F.col(two)), F.lit(False)))
    if not was:
        return out.select(*rows.columns)
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in rule.keys))
    out = out.withColumn("_moved", moved & whole)
    fresh, still, keys = out.filter("_moved"), out.filter("not _moved"), list(rule.keys)
    places = fresh.select(*keys).distinct()
    stake = still.join(places, keys, "left_semi").unionByName(fresh)
    order = [F.col("_moved"), *(f"_was_{c}" for c in was)]
    if rule.ranks:
        column, ranks = rule.ranks
        order.insert(0, F.desc(reduce(lambda a, w: F.when(F.col(column) == w, ranks[w]).otherwise(a), ranks, F.lit(0))))
    best = stake.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1")
    return still.join(places, keys, "left_anti").select(*rows.columns).unionByName(best.select(*rows.columns))


def rewritten_all(snapshot: dict[str, DataFrame], names: DataFrame, rules: dict[str, Rule]) -> dict[str, DataFrame]:
    return snapshot | {t: rewritten(snapshot[t], names, rule) for t, rule in rules.items() if t in snapshot}


def preview(snapshot: dict[str, DataFrame], names: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """How many rows of each table name each duplicate, counted once for each column: duplicate_id, table, n."""
    counts = []
    for t, rule in rules.items():
        if t in snapshot:
            ids = F.explode(F.array(*(F.col(c) for c in rule.columns))).alias("duplicate_id")
            counts.append(snapshot[t].select(ids).join(names.select("duplicate_id"), "duplicate_id", "left_semi").groupBy("duplicate_id").agg(F.count(F.lit(1)).alias("n")).select("duplicate_id", F.lit(t).alias("table"), "n"))
    return reduce(DataFrame.unionByName, counts)


# season rows

SEASON_KEYS = ["player_id", "team_id", "season_id"]
BATTING = ["ab", "h", "doubles", "triples", "hr", "rbi", "r", "bb", "so", "hbp", "shf", "sb", "cs", "tb"]
PITCHING = ["ip_outs", "h", "r", "er", "bb", "so", "wp", "hbp", "pitches", "total_strikes", "bf"]
DECISIONS = {"w": "W", "l": "L", "sv": "SV"}


def season_batting(lines: DataFrame) -> DataFrame:
    """Season rows from game rows (season_id among them) that the player's own team saw."""
    n = F.count(F.lit(1))
    sums = lines.filter("perspective_team_id = team_id").groupBy(*SEASON_KEYS).agg(F.lit("boxscore_only").alias("stat_completeness"), n.alias("games_tracked"), n.alias("gp"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in BATTING))
    hits = F.col("doubles") + F.col("triples") + F.col("hr")
    return sums.withColumns({"pa": F.col("ab") + F.col("bb") + F.col("hbp") + F.col("shf"), "singles": F.col("h") - hits, "xbh": hits})


def season_pitching(lines: DataFrame) -> DataFrame:
    """As season_batting, with wins, losses and saves."""
    n = F.count(F.lit(1))
    decided = [F.sum(F.when(F.col("decision") == word, 1).otherwise(0)).cast("bigint").alias(c) for c, word in DECISIONS.items()]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in PITCHING]
    return lines.filter("perspective_team_id = team_id").groupBy(*SEASON_KEYS).agg(F.lit("boxscore_only").alias("stat_completeness"), n.alias("games_tracked"), n.alias("gp_pitcher"), *sums, *decided)


ROLLUPS = {"season_batting": ("batting", season_batting), "season_pitching": ("pitching", season_pitching)}


def affected_seasons(snapshot: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """player_id (canonical), team_id, season_id of every game or season row of a merged player, from before the merge."""
    ids = names.select("canonical_id", F.explode(F.array("duplicate_id", "canonical_id")).alias("player_id")).distinct()
    seasons = snapshot["games"].select("game_id", "season_id")
    parts = []
    for season, (lines, _) in ROLLUPS.items():
        parts.append(snapshot[lines].select("game_id", "player_id", "team_id").join(ids, "player_id").join(seasons, "game_id"))
        parts.append(snapshot[season].select(*SEASON_KEYS).join(ids, "player_id"))
    rows = [p.select(F.col("canonical_id").alias("player_id"), "team_id", "season_id") for p in parts]
    return reduce(DataFrame.unionByName, rows).distinct()


def recomputed(season: DataFrame, lines: DataFrame, games: DataFrame, affected: DataFrame, rollup) -> DataFrame:
    """season with the rows of the affected keys made anew from game rows; a key without game rows has none. Other rows stay
    as they are, right or not."""
    own = lines.join(affected.select("player_id", "team_id").distinct(), ["player_id", "team_id"], "left_semi")
    fresh = rollup(own.join(games.select("game_id", "season_id"), "game_id")).join(affected, SEASON_KEYS, "left_semi")
    return season.join(affected, SEASON_KEYS, "left_anti").unionByName(fresh.select(*season.columns))


def merge_players(snapshot: dict[str, DataFrame], names: DataFrame) -> dict[str, DataFrame]:
    """The snapshot after the merges: best names, ids, collisions, and season rows of the merged players made anew."""
    affected = affected_seasons(snapshot, names)
    out = rewritten_all(snapshot, names, PLAYER_RULES)
    gone = names.select(F.col("duplicate_id").alias("player_id"))
    merged = names.select("canonical_id", F.explode(F.array("duplicate_id", "canonical_id")).alias("player_id")).distinct()
    for season, (lines, rollup) in ROLLUPS.items():
        rest = out[season].join(merged.select("player_id").distinct(), "player_id", "left_anti")
        out[season] = recomputed(rest, out[lines], out["games"], affected, rollup)
    if "players" in snapshot:
        players = snapshot["players"]
        told = players.join(merged, "player_id").select(F.col("canonical_id").alias("player_id"), "first_name", "last_name", F.struct(F.col("player_id") != F.col("canonical_id"), "player_id").alias("_by"))
        seq = told.withColumn("seq", F.row_number().over(Window.partitionBy("player_id").orderBy("_by")))
        best = tables.longest_names(seq).join(players.select("player_id"), "player_id", "left_semi")
        kept = players.join(gone, "player_id", "left_anti").join(best.select("player_id", F.col("first_name").alias("_first"), F.col("last_name").alias("_last"), F.lit(True).alias("_met")), "player_id", "left")
        for c, to in (("first_name", "_first"), ("last_name", "_last")):
            kept = kept.withColumn(c, F.when(F.col("_met"), F.col(to)).otherwise(F.col(c)))
        out["players"] = kept.select(*players.columns)
    return out


def merge_teams(snapshot: dict[str, DataFrame], pairs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The snapshot after the merges of teams (id, gc_uuid, public_id, membership_type), and the pairs that were refused, with why.

    A canonical team's own identifiers stay, and those that it lacks come from its duplicates, the least id first. Events of
    plays that go are gone with them.
    """
    teams = snapshot["teams"]
    has = lambda c: teams.select(F.col("id").alias(c), F.col("membership_type").alias(f"_{c}"), F.lit(True).alias(f"_has_{c}"))
    asked = pairs.join(has("canonical_id"), "canonical_id", "left").join(has("duplicate_id"), "duplicate_id", "left")
    why = F.when(F.col("canonical_id") == F.col("duplicate_id"), "same team").when(F.col("_has_canonical_id").isNull(), "no canonical team").when(F.col("_has_duplicate_id").isNull(), "no duplicate team").when(F.col("_duplicate_id") == "member", "duplicate is a member")
    asked = asked.select("duplicate_id", "canonical_id", why.alias("reason"))
    names = final_names(asked.filter("reason is null"))
    out = rewritten_all(snapshot, names, TEAM_RULES)
    lent = teams.join(names.select(F.col("duplicate_id").alias("id"), "canonical_id"), "id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"_{c}")
    given = lent.groupBy(F.col("canonical_id").alias("id")).agg(first("gc_uuid"), first("public_id"))
    kept = teams.join(names.select(F.col("duplicate_id").alias("id")), "id", "left_anti").join(given, "id", "left")
    out["teams"] = kept.withColumns({c: F.coalesce(c, f"_{c}") for c in ("gc_uuid", "public_id")}).select(*teams.columns)
    if "events" in snapshot:  # an event's perspective is its play's
        key = ["game_id", "play_order", "perspective_team_id"]
        left = rewritten(snapshot["plays"].withColumn("_from", F.col("perspective_team_id")), names, TEAM_RULES["plays"])
        left = left.select("game_id", "play_order", F.col("_from").alias("perspective_team_id"), F.col("perspective_team_id").alias("_to"))
        out["events"] = snapshot["events"].join(left, key).withColumn("perspective_team_id", F.col("_to")).select(*snapshot["events"].columns)
    return out, asked.filter("reason is not null")


def dedupe_recent(snapshot: dict[str, DataFrame], runs: DataFrame, since: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merges duplicate players of the teams and seasons that a scouting run has checked since a time (runs: team_id, season_id,
    last_checked); the snapshot and the names."""
    recent = runs.filter(F.col("last_checked") >= since).select("team_id", "season_id").distinct()
    rosters = snapshot["rosters"].join(recent, ["team_id", "season_id"], "left_semi").select("team_id", "season_id", "player_id")
    named = rosters.join(snapshot["players"].select("player_id", "first_name", "last_name"), "player_id").join(stat_rows(snapshot), "player_id", "left").withColumn("stat_rows", F.coalesce("stat_rows", F.lit(0)))
    names = final_names(identity.duplicate_players(named).select("duplicate_id", "canonical_id"))
    return merge_players(snapshot, names), names


def stat_rows(snapshot: dict[str, DataFrame]) -> DataFrame:
    """How many rows of statistics each player has over the game and season tables: player_id, stat_rows."""
    parts = [snapshot[t].select("player_id") for t in ("batting", "pitching", "season_batting", "season_pitching") if t in snapshot]
    counts = [p.groupBy("player_id").agg(F.count(F.lit(1)).alias("n")) for p in parts]
    return reduce(DataFrame.unionByName, counts).groupBy("player_id").agg(F.sum("n").alias("stat_rows"))
