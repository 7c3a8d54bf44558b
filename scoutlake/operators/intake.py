"""What a load decides before it writes: sides of a game, keys of a box score, new opponents, rosters, years, and small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.operators import tables

RECENT_HOURS = 24


def sided(summaries: DataFrame) -> DataFrame:
    """summaries (home_away, own_team_id, opponent_team_id, own_score, opponent_score) as home and away; without a side our team is home."""
    away = F.coalesce(F.col("home_away") == "away", F.lit(False))
    pick = lambda a, b: F.when(away, F.col(b)).otherwise(F.col(a))
    made = {"home_team_id": pick("own_team_id", "opponent_team_id"), "away_team_id": pick("opponent_team_id", "own_team_id"), "home_score": pick("own_score", "opponent_score"), "away_score": pick("opponent_score", "own_score")}
    return summaries.withColumns(made).drop("home_away", "own_team_id", "opponent_team_id", "own_score", "opponent_score")


def box_keys(keys: Column, own_uuid: Column) -> Column:
    """Which key of a box score (an array of them, in order) is ours and which the opponent's: struct own, opponent.

    Ours is the first that is no UUID, the opponent's the first that is. Where two or more keys are all UUIDs, ours is the last
    that is our team's in any case, and the opponent's the last other; without our UUID ours is null.
    """
    uuid = F.filter(keys, lambda k: k.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))
    slugs = F.array_except(keys, uuid)
    only = (F.size(slugs) == 0) & (F.size(uuid) >= 2) & own_uuid.isNotNull()
    mine = F.filter(uuid, lambda k: F.lower(k) == F.lower(own_uuid))
    others = F.filter(uuid, lambda k: F.lower(k) != F.lower(own_uuid))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    first = lambda a: F.get(a, F.lit(0))
    return F.struct(F.when(only, last(mine)).otherwise(first(slugs)).alias("own"), F.when(only & (F.size(others) > 0), last(others)).otherwise(first(uuid)).alias("opponent"))


def discovered(rows: DataFrame, column: str) -> DataFrame:
    """The distinct names of a column that are not empty, trimmed: name."""
    return rows.select(F.trim(column).alias("name")).filter("name <> ''").distinct()


def placeholders(names: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams to make for names (seq, name) that no team has in any case; of names alike the first."""
    first = names.filter("name is not null").groupBy(F.lower("name").alias("_low")).agg(F.min_by("name", "seq").alias("name"))
    fresh = first.join(teams.select(F.lower("name").alias("_low")), "_low", "left_anti")
    return fresh.select("name", F.lit("tracked").alias("membership_type"), F.lit(0).cast("bigint").alias("is_active"), F.lit("discovered").alias("source"))


def rosters_after(old: DataFrame, new: DataFrame, scouting: bool = False) -> DataFrame:
    """Rosters (team_id, player_id, season_id, jersey_number, position) with the new rows (and seq) put over them; a scouting load
    knows no positions and leaves them."""
    keep = {"position": F.col("old_position")} if scouting else None
    return tables.upsert(old, new, ["team_id", "player_id", "season_id"], keep)


def years_healed(teams: DataFrame, told: DataFrame) -> DataFrame:
    """teams whose null season_year is filled from what the service told (id, season_year); a known year stays."""
    known = told.filter("season_year is not null").groupBy("id").agg(F.max("season_year").alias("_year"))
    return teams.join(known, "id", "left").withColumn("season_year", F.coalesce("season_year", "_year")).select(*teams.columns)


def league_info(wanted: DataFrame, teams: DataFrame, programs: DataFrame) -> DataFrame:
    """For each id wanted the program_type and classification; null where there is no team or it has no program."""
    own = teams.select("id", "program_id", "classification").join(programs.select(F.col("id").alias("program_id"), "program_type"), "program_id", "left")
    return wanted.select("id").join(own, "id", "left").select("id", "program_type", "classification")


def newest_season(rows: DataFrame, own: Column) -> DataFrame:
    """The rows of each team's newest season among those that count (own)."""
    kept = rows.filter(own)
    last = F.max("season_id").over(Window.partitionBy("team_id"))
    return kept.withColumn("_last", last).filter(F.col("season_id") == F.col("_last")).drop("_last")


def scouted_lately(runs: DataFrame, now: Column, hours: int = RECENT_HOURS) -> DataFrame:
    """team_id, season_id and whether the newest run that completed is less than some hours old."""
    last = runs.filter("status = 'completed'").groupBy("team_id", "season_id").agg(F.max("last_checked").alias("last"))
    return runs.select("team_id", "season_id").distinct().join(last, ["team_id", "season_id"], "left").select("team_id", "season_id", F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("last") < hours * 3600, F.lit(False)).alias("lately"))


def expires(now: Column, days: int = 7) -> Column:
    """A time some days on, as ISO text in UTC."""
    return F.date_format(now + F.make_dt_interval(days=F.lit(days)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def match_rate(compared: DataFrame) -> DataFrame:
    """How many comparisons are within tolerance, in percent; 100 if there are none (compared: within)."""
    n, good = F.count(F.lit(1)), F.sum(F.col("within").cast("bigint"))
    return compared.agg(n.alias("compared"), F.coalesce(good, F.lit(0)).alias("matched"), F.when(n == 0, 100.0).otherwise(good * 100.0 / n).cast("double").alias("match_rate"))
