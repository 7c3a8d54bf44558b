"""Whole answers of pages, for every game, team and player at once: box scores, scouting reports and player profiles.

A row holds its page: scalars, and arrays of structs in the order in which they are shown. Lists are a team's in a game or a season,
or a player's, so an array stays small. players: player_id, first_name, last_name; rosters: team_id, season_id, player_id,
jersey_number; teams: id, name; games: game_id, season_id, game_date, start_time, home_team_id, away_team_id, home_score, away_score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.functions import rates, text
from scoutlake.operators.games import one_perspective

BOX_BATTING = ["ab", "h", "doubles", "triples", "hr", "rbi", "bb", "so", "sb"]
BOX_PITCHING = ["ip_outs", "h", "er", "bb", "so", "pitches", "total_strikes"]
REPORT_BATTING = [*BOX_BATTING, "hbp", "shf", "tb"]
PROFILE_BATTING = [*BOX_BATTING, "hbp", "shf"]
RECENT = 5


def _name() -> list[Column]:
    """The name to show, and whether it stands for an unknown one."""
    full = text.full_name()
    unknown = F.coalesce(full == "Unknown Unknown", F.lit(False))
    number = F.when(F.coalesce("jersey_number", F.lit("")) != "", F.concat(F.lit("Player #"), F.col("jersey_number"))).otherwise("Unknown Player")
    return [F.when(unknown, number).otherwise(full).alias("name"), unknown.alias("name_unresolved")]


def _zeros(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in columns]


def _listed(rows: DataFrame, keys: list[str], order: list[Column], line: list[str], name: str) -> DataFrame:
    """keys and an array of the lines in order; nothing of the order is left in the lines."""
    one = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), F.struct(*line).alias("line"))
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(one)), lambda r: r["line"]).alias(name))


def _last(c: Column | str) -> list[Column]:
    """Order by a column whose nulls come last."""
    c = F.col(c) if isinstance(c, str) else c
    return [c.isNull(), c]


def _first(c: str) -> list[Column]:
    """Order by a column whose nulls come first."""
    return [F.col(c).isNotNull(), F.col(c)]


def _with_people(lines: DataFrame, players: DataFrame, rosters: DataFrame) -> DataFrame:
    named = lines.join(players.select("player_id", "first_name", "last_name"), "player_id")
    return named.join(rosters.select("team_id", "season_id", "player_id", "jersey_number"), ["team_id", "season_id", "player_id"], "left")


def box_scores(games: DataFrame, batting: DataFrame, pitching: DataFrame, players: DataFrame, rosters: DataFrame, teams: DataFrame) -> DataFrame:
    """Two rows for each game, home and away: team, name, score, batting_lines by last name and pitching_lines by appearance.

    A team's lines are those of one perspective, its own if there is one, judged for batting and pitching apart. A name that no
    team has is its id; a player without a row in players has no line.
    """
    home = F.struct(F.lit("home").alias("side"), F.col("home_team_id").alias("team_id"), F.col("home_score").alias("score"))
    away = F.struct(F.lit("away").alias("side"), F.col("away_team_id").alias("team_id"), F.col("away_score").alias("score"))
    sides = games.select("game_id", "season_id", "game_date", F.explode(F.array(home, away)).alias("_s")).select("game_id", "season_id", "game_date", "_s.*")
    seasons, key = games.select("game_id", "season_id"), ["game_id", "team_id"]
    out = sides.join(teams.select(F.col("id").alias("team_id"), "name"), "team_id", "left").withColumn("team_name", F.coalesce("name", F.col("team_id").cast("string"))).drop("name")
    for lines, columns, order, name in ((batting, BOX_BATTING, [], "batting_lines"), (pitching, BOX_PITCHING, _last("appearance_order"), "pitching_lines")):
        rows = _with_people(one_perspective(lines).drop("season_id").join(seasons, "game_id"), players, rosters)
        kept = [*key, "player_id", *_name(), *_zeros(columns), "jersey_number", "last_name", *(["appearance_order"] if order else [])]
        listed = _listed(rows.select(*kept), key, [*order, *_first("last_name"), F.col("player_id")], ["player_id", "name", "name_unresolved", *columns, "jersey_number"], name)
        out = out.join(listed, key, "left")
    return out


def scouting_reports(season_batting: DataFrame, season_pitching: DataFrame, games: DataFrame, players: DataFrame, rosters: DataFrame, teams: DataFrame) -> DataFrame:
    """A row for each team and season with season rows: name, wins and losses, batting by average and pitching by earned runs, each
    with its rates. Those without at-bats or outs come last; ties go by last name."""
    key = ["team_id", "season_id"]
    side = lambda mine, own, other: games.select(F.col(mine).alias("team_id"), "season_id", (F.col(own) > F.col(other)).alias("won"), (F.col(own) < F.col(other)).alias("lost"))
    played = side("home_team_id", "home_score", "away_score").union(side("away_team_id", "away_score", "home_score"))
    record = played.groupBy(*key).agg(*(F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint")).alias(n) for c, n in (("won", "wins"), ("lost", "losses"))))
    out = season_batting.select(*key).union(season_pitching.select(*key)).distinct()
    out = out.join(teams.select(F.col("id").alias("team_id"), "name"), "team_id", "left").withColumn("team_name", F.coalesce("name", F.col("team_id").cast("string"))).drop("name")
    out = out.join(record, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("wins", "losses")})
    rows = _with_people(season_batting, players, rosters).select(*key, "player_id", *_name(), F.coalesce("gp", F.lit(0)).alias("games"), *_zeros(REPORT_BATTING), "jersey_number", "last_name")
    rows = rows.withColumns({"avg": rates.avg(), "obp": rates.obp(), "slg": rates.slg()})
    line = ["player_id", "name", "name_unresolved", "games", *REPORT_BATTING, "jersey_number", "avg", "obp", "slg"]
    out = out.join(_listed(rows, key, [F.col("ab") == 0, *_last(-F.col("avg")), *_first("last_name"), F.col("player_id")], line, "batting"), key, "left")
    rows = _with_people(season_pitching, players, rosters).select(*key, "player_id", *_name(), F.coalesce("gp_pitcher", F.lit(0)).alias("games"), *_zeros(BOX_PITCHING), "jersey_number", "last_name")
    rows = rows.withColumns({"era": rates.era(), "k9": rates.per_nine("so"), "whip": rates.whip()})
    line = ["player_id", "name", "name_unresolved", "games", *BOX_PITCHING, "jersey_number", "era", "k9", "whip"]
    return out.join(_listed(rows, key, [F.col("ip_outs") == 0, *_last("era"), *_first("last_name"), F.col("player_id")], line, "pitching"), key, "left")


def player_profiles(players: DataFrame, season_batting: DataFrame, season_pitching: DataFrame, batting: DataFrame, pitching: DataFrame, games: DataFrame, rosters: DataFrame, teams: DataFrame) -> DataFrame:
    """A row for each player: jersey_number of the latest season, batting_seasons and pitching_seasons (latest first), and
    recent_games: all rows, batting or pitching, of the last five games that the player's own team saw."""
    latest = rosters.groupBy("player_id").agg(F.max_by("jersey_number", F.struct("season_id", "team_id")).alias("jersey_number"))
    named = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    out = players.select("player_id", "first_name", "last_name").join(latest, "player_id", "left")
    for season, gp, columns, name in ((season_batting, "gp", PROFILE_BATTING, "batting_seasons"), (season_pitching, "gp_pitcher", BOX_PITCHING, "pitching_seasons")):
        rows = season.join(named, "team_id").select("player_id", "season_id", "team_id", "team_name", F.coalesce(gp, F.lit(0)).alias("games"), *_zeros(columns))
        line = F.struct("season_id", "team_id", "team_name", "games", *columns)
        out = out.join(rows.groupBy("player_id").agg(F.sort_array(F.collect_list(line), False).alias(name)), "player_id", "left")
    null = lambda c: F.lit(None).cast("bigint").alias(c)
    at_bat = [F.col("ab").cast("bigint").alias("ab"), F.col("h").cast("bigint").alias("h"), *_zeros(["hr", "rbi"]), null("ip_outs"), null("er"), null("so_pitched"), F.lit("batting").alias("appearance_type")]
    thrown = [null("ab"), null("h"), null("hr"), null("rbi"), F.col("ip_outs").cast("bigint").alias("ip_outs"), F.col("er").cast("bigint").alias("er"), F.col("so").cast("bigint").alias("so_pitched"), F.lit("pitching").alias("appearance_type")]
    own = lambda lines, columns: lines.filter("perspective_team_id = team_id").select("player_id", "game_id", "team_id", *columns)
    rows = own(batting, at_bat).union(own(pitching, thrown)).join(games.select("game_id", "game_date", "start_time", "home_team_id", "away_team_id"), "game_id")
    other = F.when(F.col("team_id") == F.col("home_team_id"), F.col("away_team_id")).otherwise(F.col("home_team_id"))
    rows = rows.withColumn("_other", other).join(named.select(F.col("team_id").alias("_other"), F.col("team_name").alias("opponent_name")), "_other", "left")
    columns = ["game_id", "game_date", "start_time", "opponent_name", "ab", "h", "hr", "rbi", "ip_outs", "er", "so_pitched", "appearance_type"]
    rows = rows.select("player_id", *columns).distinct()
    order = [F.desc("game_date"), F.desc_nulls_last("start_time"), F.desc("game_id")]
    rows = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("player_id").orderBy(*order))).filter(F.col("nth") <= RECENT)
    recent = _listed(rows, ["player_id"], [F.col("nth"), F.col("appearance_type"), *_last("ab")], columns, "recent_games")
    return out.join(recent, "player_id", "left")
