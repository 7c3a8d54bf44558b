"""Opponent links, access, reports and what an administrator sees: joins and grouped counts over small keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.operators.games import by_team
from scoutlake.operators.tables import latest

#: Fields of a link that a manual resolution keeps.
RESOLVED = ("resolved_team_id", "resolution_method", "public_id")


def upsert_protecting_manual(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """old with new's last rows put over it; where a link was resolved by hand, what it was resolved to stays."""
    names = [c for c in old.columns if c not in keys]
    left = old.select(*keys, F.struct(*names).alias("old"))
    right = latest(new, keys, seq).select(*keys, F.struct(*names).alias("new"))
    by_hand = F.coalesce(F.col("old.resolution_method") == "manual", F.lit(False))
    choice = [F.when(F.col("new").isNull() | (by_hand if c in RESOLVED else F.lit(False)), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in names]
    return left.join(right, keys, "full_outer").select(*keys, *choice)


def seeded(registry: DataFrame, schedule: DataFrame, links: DataFrame) -> DataFrame:
    """Links (our_team_id, opponent_id, name) to add: visible opponents of the registry, then those that only the schedule names.

    Of several rows of an id the one of least seq counts; ids that links has already are left alone.
    """
    first = lambda rows: rows.filter("opponent_id is not null").groupBy("our_team_id", "opponent_id").agg(F.min_by("name", "seq").alias("name"))
    hidden = registry.filter("is_hidden = 1").select("our_team_id", "opponent_id").distinct()
    shown = first(registry.filter("is_hidden = 0"))
    others = first(schedule).join(shown, ["our_team_id", "opponent_id"], "left_anti")
    return shown.unionByName(others).join(hidden, ["our_team_id", "opponent_id"], "left_anti").join(links.select("our_team_id", "opponent_id"), ["our_team_id", "opponent_id"], "left_anti")


def latest_jobs(rows: DataFrame, jobs: DataFrame, key: str = "team_id") -> DataFrame:
    """rows, each with the state of its team's latest job (started_at, then job_id), if it has one."""
    last = jobs.groupBy(key).agg(F.max_by("state", F.struct("started_at", "job_id")).alias("job_state"))
    return rows.join(last, key, "left")


def pipeline_status(links: DataFrame, with_stats: DataFrame, jobs: DataFrame) -> DataFrame:
    """link_id, pipeline_status: stats, syncing or failed for a visible resolved link, else null."""
    rows = latest_jobs(links.withColumn("team_id", F.col("resolved_team_id")), jobs)
    rows = rows.join(with_stats.select("team_id", F.lit(True).alias("has_stats")).distinct(), "team_id", "left")
    status = F.when(F.col("resolved_team_id").isNull() | (F.col("is_hidden") == 1), None).when(F.col("has_stats"), "stats").when(F.col("job_state") == "running", "syncing").when(F.col("job_state") == "failed", "failed")
    return rows.select("link_id", status.alias("pipeline_status"))


def reachable_opponents(games: DataFrame, access: DataFrame) -> DataFrame:
    """user_id, team_id: whom a user may look at, teams of their own (access: user_id, team_id) and those that play them."""
    met = by_team(games).select("team_id", "opponent_id").distinct()
    return access.select("user_id", "team_id").union(access.join(met, "team_id").select("user_id", "opponent_id")).distinct()


def games_of_teams(games: DataFrame, teams: DataFrame) -> DataFrame:
    """id, games: how many games each team has, at home or away; 0 for none."""
    counts = by_team(games).select("game_id", "team_id").distinct().groupBy(F.col("team_id").alias("id")).agg(F.count(F.lit(1)).alias("games"))
    return teams.select("id").join(counts, "id", "left").withColumn("games", F.coalesce("games", F.lit(0)))


def delete_preview(tables: dict[str, DataFrame], owner: str = "team_id") -> DataFrame:
    """Per owner: the rows that each table holds of it, and all together."""
    parts = [rows.groupBy(owner).agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name)) for name, rows in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = [F.coalesce(F.sum(F.when(F.col("table") == t, F.col("n"))), F.lit(0)).alias(t) for t in tables]
    return every.groupBy(owner).agg(*sums, F.sum("n").alias("total"))


def distinct_where(rows: DataFrame, key: str, value: str, **conditions: Column) -> DataFrame:
    """Per key: how many different values there are under each condition."""
    return rows.groupBy(key).agg(*(F.count_distinct(F.when(c, F.col(value))).alias(name) for name, c in conditions.items()))


def joined_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Per key: its different names in order, comma-joined."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(name)), ", ").alias("names"))


def supplemented(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """rows, and those of more whose key none of rows has."""
    return rows.unionByName(more.join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns))


def profile_rows(batting: DataFrame, pitching: DataFrame, keys: list[str]) -> DataFrame:
    """Batting and pitching lines as one table, padded with nulls; equal rows are one."""
    left, right = (rows.select(*keys, *(F.col(c) for c in rows.columns if c not in keys)) for rows in (batting, pitching))
    return left.unionByName(right, allowMissingColumns=True).distinct()


def live_reports(reports: DataFrame, now: Column) -> DataFrame:
    """reports with is_expired, and whether each may be served: ready and not expired."""
    expired = F.col("expires_at") < now
    return reports.withColumns({"is_expired": expired, "is_served": (F.col("status") == "ready") & ~expired})


def removable_teams(teams: DataFrame, reports: DataFrame, links: DataFrame, access: DataFrame, games: DataFrame) -> DataFrame:
    """id of tracked teams that nothing needs: no report, no link to or from them, no user, no game with a member's team."""
    members = teams.filter("membership_type = 'member'").select(F.col("id").alias("opponent_id"))
    used = reports.select(F.col("team_id").alias("id")).union(links.select("resolved_team_id")).union(links.select("our_team_id")).union(access.select("team_id"))
    sides = games.select(F.col("home_team_id").alias("id"), F.col("away_team_id").alias("opponent_id")).union(games.select("away_team_id", "home_team_id"))
    used = used.union(sides.join(members, "opponent_id", "left_semi").select("id"))
    return teams.filter("membership_type = 'tracked'").select("id").join(used.filter("id is not null").distinct(), "id", "left_anti")


def overlapping(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (canonical_id, duplicate_id) of players who both have a line in one game, as their own team saw it, with the games."""
    own = lines.filter("perspective_team_id = team_id").select("game_id", "player_id").distinct()
    left = pairs.join(own.withColumnRenamed("player_id", "canonical_id"), "canonical_id")
    both = left.join(own.withColumnRenamed("player_id", "duplicate_id"), ["duplicate_id", "game_id"])
    return both.groupBy("canonical_id", "duplicate_id").agg(F.count(F.lit(1)).alias("games"))


def never_met(pairs: DataFrame, games: DataFrame) -> DataFrame:
    """Pairs of teams (canonical_id, duplicate_id) that never played each other: two that did cannot be one."""
    met = by_team(games).select(F.col("team_id").alias("canonical_id"), F.col("opponent_id").alias("duplicate_id")).distinct()
    return pairs.join(met, ["canonical_id", "duplicate_id"], "left_anti")


def top_rows(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, numbered from 1."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).filter(F.col("nth") <= n)


def linked_by_name(links: DataFrame, teams: DataFrame) -> DataFrame:
    """link_id with the least id of the teams of exactly its name; null where no team has it."""
    named = teams.groupBy("name").agg(F.min("id").alias("named_team_id"))
    return links.join(named, "name", "left").select("link_id", "named_team_id")


def events_by_player(balls: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """player_id, events: a player's batted balls as an array of structs, in order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, *(c for c in fields if c not in order))))
    return balls.groupBy("player_id").agg(F.transform(listed, lambda e: F.struct(*(e[c].alias(c) for c in fields))).alias("events"))


LINK_FILTERS = ("all", "full", "unresolved", "hidden")
LINK_ORDERS = {"opponent": "opponent_name", "resolved": "resolved_at", "method": "resolution_method"}


def listed_links(links: DataFrame, season_lines: DataFrame, status: str | None = None, our_team: int | None = None, order: str | None = None, descending: bool = False) -> DataFrame:
    """Links by composed conditions, in an order from a whitelist: `nth`. Hidden links only where they are asked for; `full`
    wants season rows of the resolved team (season_lines: team_id). What is not allowed is as if it were not given."""
    status = status if status in LINK_FILTERS else "all"
    shown = links.filter(F.col("is_hidden") == (1 if status == "hidden" else 0))
    if our_team is not None:
        shown = shown.filter(F.col("our_team_id") == our_team)
    if status == "unresolved":
        shown = shown.filter("resolved_team_id is null")
    if status == "full":
        shown = shown.join(season_lines.select(F.col("team_id").alias("resolved_team_id")).distinct(), "resolved_team_id", "left_semi").select(*links.columns)
    by = F.col(LINK_ORDERS.get(order, LINK_ORDERS["opponent"]))
    rank = Window.partitionBy("our_team_id").orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), "id")
    return shown.withColumn("nth", F.row_number().over(rank).cast("bigint"))


def chosen_season(wanted: DataFrame, permitted: DataFrame, seasons: DataFrame, current_year: Column) -> DataFrame:
    """For each user the team, year and season that a page shows.

    wanted: user_id, team_id, year (either may be null); permitted: user_id, place (the order of the user's teams), team_id,
    year (null: no data); seasons: team_id, season_id (`2025-spring-hs`). The team that is asked for, if permitted, with its year;
    else the first team of the year asked for, of the current year, of the latest year with a team; else the first team.
    One pass: each permitted team is ranked by the first of these that it meets.
    """
    rows = wanted.select("user_id", F.col("team_id").alias("asked"), F.col("year").alias("asked_year")).join(permitted, "user_id")
    latest = F.max("year").over(Window.partitionBy("user_id"))
    rank = F.when(F.col("team_id") == F.col("asked"), 1).when(F.col("year") == F.col("asked_year"), 2).when(F.col("year") == current_year, 3).when(F.col("year") == latest, 4).otherwise(5)
    best = rows.withColumn("rank", rank).groupBy("user_id").agg(F.min(F.struct("rank", "place", "team_id", "year")).alias("b"))
    shown = F.when(F.col("b.rank").isin(1, 2, 3, 4), F.coalesce("b.year", current_year)).otherwise(current_year)
    rows = best.select("user_id", F.col("b.team_id").alias("team_id"), shown.cast("bigint").alias("year"), F.col("b.rank").cast("bigint").alias("path"))
    own = rows.select("user_id", "team_id", "year").join(seasons, "team_id")
    fits = F.col("season_id").startswith(F.col("year").cast("string"))
    named = own.groupBy("user_id").agg(F.max(F.when(fits, F.col("season_id"))).alias("of_year"), F.max("season_id").alias("newest"))
    return rows.join(named, "user_id", "left").select("user_id", "team_id", "year", "path", F.coalesce("of_year", "newest", F.concat(F.col("year").cast("string"), F.lit("-spring-hs"))).alias("season_id"))
