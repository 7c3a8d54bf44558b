"""Readers of the nested JSON feeds: rosters, schedules, games, box scores, plays, season statistics, batted balls.

Each reader takes a path or a glob and gives flat rows with the file they are from. A file that is no valid JSON of its kind
gives one row in `broken`, so one bad file stops nothing. Schemas are written out: no pass over the data to infer them, and
columns that nobody asks for are not parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROSTER = "id string, first_name string, last_name string, number string, position string"
SCHEDULE = "event struct<id string, event_type string, status string, timezone string, start struct<datetime string, date string>>, pregame_data struct<opponent_id string, opponent_name string, home_away string>"
SUMMARIES = "event_id string, home_away string, owning_team_score bigint, opponent_team_score bigint, last_scoring_update string, game_stream struct<id string, opponent_id string>"
PUBLIC_GAMES = "id string, game_status string, home_away string, start_ts string, end_ts string, timezone string, score struct<team bigint, opponent_team bigint>, opponent_team struct<name string>"
OPPONENTS = "root_team_id string, name string, progenitor_team_id string, is_hidden boolean"
BOXSCORE = """map<string, struct<players array<struct<id string, first_name string, last_name string, number string>>,
    groups array<struct<category string, stats array<struct<player_id string, player_text string, is_primary boolean, stats map<string, double>>>,
        extra array<struct<stat_name string, stats array<struct<player_id string, value bigint>>>>>>>>"""
PLAYS = """sport string, plays array<struct<order bigint, inning bigint, half string, name_template struct<template string>, home_score bigint, away_score bigint, did_score_change boolean, outs bigint,
    did_outs_change boolean, at_plate_details array<struct<template string>>, final_details array<struct<template string>>>>"""
SEASON_STATS = "stats_data struct<players map<string, struct<stats struct<offense map<string, double>, defense map<string, double>>>>>"
SPRAY = """spray_chart_data struct<offense map<string, array<struct<id string, createdAt bigint, attributes struct<playResult string, playType string, defenders array<struct<error boolean, position string, location struct<x double, y double>>>>>>>,
    defense map<string, array<struct<id string, createdAt bigint, attributes struct<playResult string, playType string, defenders array<struct<error boolean, position string, location struct<x double, y double>>>>>>>>"""
#: Extras of a batter that are null where the box score lacks them; all others are then 0.
NULL_EXTRAS = ("SHF", "E")


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, doc, broken: each file's document under a schema (one document a file)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    made = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return files.select("file", made.alias("doc"), F.coalesce(F.try_parse_json("value").isNull(), F.lit(True)).alias("broken"))


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """The files at path that are no JSON."""
    return _whole(spark, path, "map<string, string>").filter("broken").select("file")


def _listed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = _whole(spark, path, f"array<struct<{schema}>>").filter("not broken")
    return rows.select("file", F.posexplode("doc").alias("nth", "row")).select("file", "nth", "row.*")


def team_of_path(file: Column) -> Column:
    """The team that a file's folder names, as `.../teams/<id>/...`."""
    return F.nullif(F.regexp_extract(file, r"/teams/([^/]+)/", 1), F.lit(""))


def year_of_path(file: Column) -> Column:
    """The first four-digit year that begins a folder's name."""
    return F.nullif(F.regexp_extract(file, r"/(\d{4})(?:-[^/]*)?/", 1), F.lit("")).cast("bigint")


def rosters(spark: SparkSession, path: str) -> DataFrame:
    """file, player_id, first_name, last_name, jersey_number, position; rows without an id are left out."""
    rows = _listed(spark, path, ROSTER).filter("id is not null")
    return rows.select("file", F.col("id").alias("player_id"), F.coalesce("first_name", F.lit("Unknown")).alias("first_name"), F.coalesce("last_name", F.lit("Unknown")).alias("last_name"), F.col("number").alias("jersey_number"), "position")


def schedule(spark: SparkSession, path: str) -> DataFrame:
    """Games of a schedule that are not canceled and have an opponent."""
    rows = _listed(spark, path, SCHEDULE).filter("event.event_type = 'game' and coalesce(event.status, '') <> 'canceled' and pregame_data is not null")
    day = F.coalesce("event.start.date", F.substring("event.start.datetime", 1, 10))
    return rows.select("file", F.col("event.id").alias("game_id"), day.cast("date").alias("game_date"), F.col("event.start.datetime").alias("start_time"), F.col("event.timezone").alias("timezone"), F.col("pregame_data.opponent_id").alias("opponent_id"), F.col("pregame_data.opponent_name").alias("opponent_name"), F.col("pregame_data.home_away").alias("home_away"))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Game summaries under both of their keys: the event's id and its stream's."""
    keys = F.explode(F.array_compact(F.array_distinct(F.array("event_id", "game_stream.id"))))
    return _listed(spark, path, SUMMARIES).select("*", keys.alias("key"))


def public_games(spark: SparkSession, path: str) -> DataFrame:
    """Completed games of a public list."""
    rows = _listed(spark, path, PUBLIC_GAMES).filter("game_status = 'completed'")
    day = F.substring(F.coalesce("start_ts", "end_ts", F.lit("1900-01-01")), 1, 10).cast("date")
    return rows.select("file", F.col("id").alias("game_id"), day.alias("game_date"), F.col("start_ts").alias("start_time"), "timezone", "home_away", F.col("score.team").alias("own_score"), F.col("score.opponent_team").alias("opponent_score"), F.col("opponent_team.name").alias("opponent_name"))


def opponents(spark: SparkSession, path: str) -> DataFrame:
    """Opponents that are not hidden; the first row of an id counts."""
    rows = _listed(spark, path, OPPONENTS).filter("root_team_id is not null and not coalesce(is_hidden, false)")
    return rows.groupBy("root_team_id").agg(F.min_by(F.struct("name", "progenitor_team_id"), F.struct("file", "nth")).alias("r")).select("root_team_id", "r.*")


def _box_groups(spark: SparkSession, path: str) -> DataFrame:
    rows = _whole(spark, path, BOXSCORE).filter("not broken").select("file", F.explode("doc").alias("team_key", "team"))
    return rows.select("file", "team_key", F.explode("team.groups").alias("g"))


def box_players(spark: SparkSession, path: str) -> DataFrame:
    """file, team_key, player_id, first_name, last_name, jersey_number of all box scores."""
    rows = _whole(spark, path, BOXSCORE).filter("not broken").select("file", F.explode("doc").alias("team_key", "team"))
    return rows.select("file", "team_key", F.inline("team.players")).withColumnsRenamed({"id": "player_id", "number": "jersey_number"})


def _lines(spark: SparkSession, path: str, category: str) -> DataFrame:
    rows = _box_groups(spark, path).filter(F.col("g.category") == category)
    rows = rows.select("file", "team_key", F.posexplode("g.stats").alias("at", "s"), F.col("g.extra").alias("extra"))
    mine = F.filter(F.transform("extra", lambda e: F.struct(e["stat_name"].alias("key"), F.get(F.filter(e["stats"], lambda x: x["player_id"] == F.col("s.player_id")), F.lit(0))["value"].alias("value"))), lambda e: e["value"].isNotNull())
    return rows.withColumn("more", F.map_from_entries(F.coalesce(mine, F.array().cast("array<struct<key:string,value:bigint>>"))))


def _extra(name: str) -> Column:
    value = F.try_element_at("more", F.lit(name))
    return value if name in NULL_EXTRAS else F.coalesce(value, F.lit(0).cast("bigint"))


def batting_lines(spark: SparkSession, path: str) -> DataFrame:
    """A batter's line in each box score. Missing extras are 0, but SHF and E are then unknown."""
    stat = lambda k: F.try_element_at("s.stats", F.lit(k)).cast("bigint").alias(k.lower())
    extras = {"doubles": "2B", "triples": "3B", "hr": "HR", "tb": "TB", "hbp": "HBP", "shf": "SHF", "sb": "SB", "cs": "CS", "e": "E"}
    return _lines(spark, path, "lineup").select("file", "team_key", F.col("s.player_id").alias("player_id"), *map(stat, ("AB", "R", "H", "RBI", "BB", "SO")), *(_extra(k).alias(c) for c, k in extras.items()))


def outs(innings: Column) -> Column:
    """Innings as whole outs."""
    return F.round(innings.cast("double") * 3).cast("bigint")


def pitching_lines(spark: SparkSession, path: str) -> DataFrame:
    """A pitcher's line in each box score; appearance_order counts from 1 as listed."""
    stat = lambda k: F.try_element_at("s.stats", F.lit(k)).cast("bigint").alias(k.lower())
    extras = {"wp": "WP", "hbp": "HBP"}
    unknown = {"pitches": "#P", "total_strikes": "TS", "bf": "BF"}
    return _lines(spark, path, "pitching").select(
        "file", "team_key", F.col("s.player_id").alias("player_id"), (F.col("at") + 1).cast("bigint").alias("appearance_order"), outs(F.try_element_at("s.stats", F.lit("IP"))).alias("ip_outs"),
        *map(stat, ("H", "R", "ER", "BB", "SO")), *(_extra(k).alias(c) for c, k in extras.items()), *(F.try_element_at("more", F.lit(k)).alias(c) for c, k in unknown.items()),
    )


def games_with_plays(spark: SparkSession, path: str) -> DataFrame:
    """file, game_id (the file's stem), plays: for `plays.parsed`."""
    rows = _whole(spark, path, PLAYS).filter("not broken")
    return rows.select("file", F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("game_id"), F.coalesce("doc.plays", F.expr("array()")).alias("plays"))


def season_stats(spark: SparkSession, path: str) -> DataFrame:
    """file, player_id, offense, defense (maps of counters), is_pitcher (has pitched in a game)."""
    rows = _whole(spark, path, SEASON_STATS).filter("not broken").select("file", F.explode("doc.stats_data.players").alias("player_id", "p"))
    pitched = F.coalesce(F.try_element_at("p.stats.defense", F.lit("GP:P")), F.lit(0.0)) > 0
    return rows.select("file", "player_id", F.col("p.stats.offense").alias("offense"), F.col("p.stats.defense").alias("defense"), F.coalesce(pitched, F.lit(False)).alias("is_pitcher"))


def batted_balls(spark: SparkSession, path: str) -> DataFrame:
    """One row for each batted ball: the first defender's place; none for a home run over the fence. A defender without a place is left out."""
    rows = _whole(spark, path, SPRAY).filter("not broken")
    sections = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.col(f"doc.spray_chart_data.{s}").alias("players")) for s in ("offense", "defense"))))
    rows = rows.select("file", sections.alias("p")).select("file", "p.section", F.explode("p.players").alias("player_id", "events")).select("file", "section", "player_id", F.explode("events").alias("e"))
    first = F.get("e.attributes.defenders", F.lit(0))
    rows = rows.select("file", "section", "player_id", F.col("e.id").alias("event_id"), F.col("e.createdAt").alias("created_at_ms"), F.col("e.attributes.playResult").alias("play_result"), F.col("e.attributes.playType").alias("play_type"), first.isNotNull().alias("fielded"), first["position"].alias("fielder_position"), first["error"].cast("bigint").alias("error"), first["location"]["x"].alias("x"), first["location"]["y"].alias("y"))
    return rows.filter("not fielded or (x is not null and y is not null)").drop("fielded")
