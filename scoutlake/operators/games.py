"""Games and schedules: records, opponents, meetings, box scores, coverage.

games: game_id, season_id, game_date, start_time, status, home_team_id, away_team_id, home_score, away_score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_team(games: DataFrame) -> DataFrame:
    """Each game once for each of its teams: team_id, opponent_id, is_home, scored, allowed, and the game's columns."""
    sides = F.explode(
        F.array(
            F.struct(F.col("home_team_id").alias("team_id"), F.col("away_team_id").alias("opponent_id"), F.lit(True).alias("is_home"), F.col("home_score").alias("scored"), F.col("away_score").alias("allowed")),
            F.struct(F.col("away_team_id").alias("team_id"), F.col("home_team_id").alias("opponent_id"), F.lit(False).alias("is_home"), F.col("away_score").alias("scored"), F.col("home_score").alias("allowed")),
        )
    )
    return games.withColumn("_side", sides).select("_side.*", "game_id", "season_id", "game_date", "start_time", "status")


def _known() -> Column:
    return F.col("scored").isNotNull() & F.col("allowed").isNotNull()


def result() -> Column:
    """W, L, T, or - without both scores."""
    return F.when(~_known(), "-").when(F.col("scored") > F.col("allowed"), "W").when(F.col("scored") < F.col("allowed"), "L").otherwise("T")


def records(games: DataFrame, completed_only: bool = False) -> DataFrame:
    """Wins, losses, ties, games and mean runs per team and season, over games with both scores."""
    rows = by_team(games).filter(_known())
    if completed_only:
        rows = rows.filter("status = 'completed'")
    count = lambda c: F.sum(c.cast("bigint"))
    return rows.groupBy("team_id", "season_id").agg(
        count(F.col("scored") > F.col("allowed")).alias("wins"),
        count(F.col("scored") < F.col("allowed")).alias("losses"),
        count(F.col("scored") == F.col("allowed")).alias("ties"),
        F.count(F.lit(1)).alias("games"),
        F.avg("scored").alias("mean_scored"),
        F.avg("allowed").alias("mean_allowed"),
    )


def schedule(games: DataFrame, teams: DataFrame, with_stats: DataFrame, today: Column) -> DataFrame:
    """A team's games with opponent's name, record and whether it has statistics; the next game is marked.

    teams and with_stats (team_id) are small dimensions: Spark broadcasts them by their own sizes.
    """
    rows = by_team(games).join(teams.select(F.col("id").alias("opponent_id"), F.col("name").alias("opponent")), "opponent_id", "left")
    record = records(games, completed_only=True).select(F.col("team_id").alias("opponent_id"), "season_id", F.col("wins").alias("opponent_wins"), F.col("losses").alias("opponent_losses"))
    rows = rows.join(record, ["opponent_id", "season_id"], "left")
    rows = rows.join(with_stats.select(F.col("team_id").alias("opponent_id"), F.lit(True).alias("has_stats")).distinct(), "opponent_id", "left")
    waits = (F.col("status") == "scheduled") & (F.col("game_date") >= today)
    first = F.row_number().over(Window.partitionBy("team_id", "season_id", waits).orderBy("game_date", F.col("start_time").asc_nulls_last(), "game_id"))
    return rows.withColumns(
        {
            "has_stats": F.coalesce("has_stats", F.lit(False)),
            "result": result(),
            "days_until": F.when(waits, F.datediff("game_date", today)).cast("bigint"),
            "is_next": waits & (first == 1),
        }
    )


def opponents(games: DataFrame, today: Column) -> DataFrame:
    """Per team, season and opponent: games, wins, losses, next and last date."""
    rows = by_team(games)
    done = F.col("status") == "completed"
    return rows.groupBy("team_id", "season_id", "opponent_id").agg(
        F.count(F.lit(1)).alias("games"),
        F.sum((done & (F.col("scored") > F.col("allowed"))).cast("bigint")).alias("wins"),
        F.sum((done & (F.col("scored") < F.col("allowed"))).cast("bigint")).alias("losses"),
        F.min(F.when(F.col("game_date") >= today, F.col("game_date"))).alias("next_date"),
        F.max(F.when(done, F.col("game_date"))).alias("last_date"),
    )


def last_meetings(games: DataFrame) -> DataFrame:
    """The latest completed game with both scores of each pair of teams and season, from each side."""
    order = Window.partitionBy("team_id", "opponent_id", "season_id").orderBy(F.desc("game_date"), F.col("start_time").desc_nulls_last(), F.desc("game_id"))
    rows = by_team(games).filter((F.col("status") == "completed") & _known())
    return rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth").withColumn("result", result())


def form(games: DataFrame, n: int = 5) -> DataFrame:
    """A team's last n results, latest first."""
    order = Window.partitionBy("team_id", "season_id").orderBy(F.desc("game_date"), F.col("start_time").desc_nulls_last(), F.desc("game_id"))
    rows = by_team(games).filter((F.col("status") == "completed") & _known()).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", result().alias("r")))), lambda s: s["r"]), "")
    return rows.groupBy("team_id", "season_id").agg(listed.alias("form"))


def coverage(games: DataFrame) -> DataFrame:
    """Latest date and number of completed games per team, over all seasons."""
    return by_team(games).filter("status = 'completed'").groupBy("team_id").agg(F.max("game_date").alias("through"), F.count(F.lit(1)).alias("games"))


def one_perspective(lines: DataFrame) -> DataFrame:
    """The rows of one perspective for each game and team: the team's own if there is one, else the least."""
    side = Window.partitionBy("game_id", "team_id")
    own = F.max(F.when(F.col("perspective_team_id") == F.col("team_id"), F.col("team_id"))).over(side)
    chosen = F.coalesce(own, F.min("perspective_team_id").over(side))
    return lines.withColumn("chosen", chosen).filter("perspective_team_id = chosen").drop("chosen")


def recent_games(lines: DataFrame, n: int = 5) -> DataFrame:
    """All rows of each player's last n games."""
    order = Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    return lines.distinct().withColumn("nth", F.dense_rank().over(order).cast("bigint")).filter(F.col("nth") <= n)


def seasons(*tables: DataFrame) -> DataFrame:
    """The seasons that any of the tables has, by team."""
    out = tables[0].select("team_id", "season_id")
    for t in tables[1:]:
        out = out.union(t.select("team_id", "season_id"))
    return out.distinct()


def data_status(teams: DataFrame, with_stats: DataFrame, links: DataFrame) -> DataFrame:
    """id, status of each team: stats if there are statistics, else syncing if a link is under way, else scoresheet."""
    stats = with_stats.select(F.col("team_id").alias("id"), F.lit(True).alias("has_stats")).distinct()
    linked = links.groupBy(F.col("team_id").alias("id")).agg(F.max((F.col("state") == "running").cast("int")).alias("running"))
    rows = teams.join(stats, "id", "left").join(linked, "id", "left")
    return rows.select("id", F.when(F.col("has_stats"), "stats").when(F.col("running") == 1, "syncing").otherwise("scoresheet").alias("status"))


def duplicate_games(games: DataFrame) -> DataFrame:
    """Dates on which a pair of teams has more than one game, whoever was at home."""
    low, high = F.least("home_team_id", "away_team_id"), F.greatest("home_team_id", "away_team_id")
    return games.groupBy("season_id", "game_date", low.alias("low_team"), high.alias("high_team")).agg(F.count(F.lit(1)).alias("games")).filter("games > 1")


def same_games(games: DataFrame) -> DataFrame:
    """Pairs of completed games that are one: same date and teams, and the same start, or the same total where a start is unknown."""
    keyed = games.filter("status = 'completed'").select("game_id", "game_date", F.least("home_team_id", "away_team_id").alias("low"), F.greatest("home_team_id", "away_team_id").alias("high"), "start_time", (F.col("home_score") + F.col("away_score")).alias("total"))
    # many games of one key (a postponed date, say) are grouped by start or total before they are paired with the least
    keys = ["game_date", "low", "high"]
    started = keyed.filter("start_time is not null")
    first = started.groupBy(*keys, "start_time").agg(F.min("game_id").alias("first_id"))
    by_start = started.join(first, [*keys, "start_time"]).filter("game_id <> first_id").select(F.col("first_id").alias("canonical_id"), F.col("game_id").alias("duplicate_id"), F.lit("start").alias("rule"))
    firsts = first.select(*keys, F.col("first_id").alias("game_id")).join(keyed.select("game_id", "total"), "game_id").groupBy(*keys, "total").agg(F.min("game_id").alias("with_start"))
    open_games = keyed.filter("start_time is null and total is not null").join(firsts, [*keys, "total"], "left")
    least = F.min("game_id").over(Window.partitionBy(*keys, "total"))
    open_games = open_games.withColumn("canonical_id", F.coalesce("with_start", least)).filter("game_id <> canonical_id")
    return by_start.union(open_games.select("canonical_id", F.col("game_id").alias("duplicate_id"), F.lit("total")))
