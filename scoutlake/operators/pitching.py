"""Pitching over time: workload, history, rest, profiles, density of games, eligibility.

appearances: game_id, game_date, start_time, status, season_id, team_id, perspective_team_id, player_id, appearance_order,
ip_outs, so, pitches, seq (a number of the row, unique within a game and player). Windows are by team or player and season,
so no window holds more than one team's season.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.functions import rates

#: Rest tiers: least pitches, most pitches, days of rest (fixed values of the rule sets).
RULES = {
    "early": [(1, 30, 0), (31, 50, 1), (51, 70, 2), (71, 90, 3)],
    "late": [(1, 30, 0), (31, 50, 1), (51, 70, 2), (71, 90, 3), (91, 110, 4)],
    "subvarsity": [(1, 30, 0), (31, 50, 1), (51, 70, 2), (71, 90, 3)],
    "legion": [(1, 30, 0), (31, 45, 1), (46, 60, 2), (61, 80, 3), (81, 105, 4)],
}


def own(appearances: DataFrame) -> DataFrame:
    """The rows from the team's own perspective."""
    return appearances.filter(F.col("perspective_team_id") == F.col("team_id"))


def workload(appearances: DataFrame, reference: Column, days: int = 7) -> DataFrame:
    """Per team, season and pitcher: last outing of the season, and pitches, appearances and span of the last `days` days.

    Without an appearance in the window pitches are 0 and the other two null; with unknown pitches only, pitches are null.
    """
    keys = ["team_id", "season_id", "player_id"]
    inside = F.col("game_date").between(F.date_sub(reference, days - 1), reference)
    # one pass: the window's sums are conditional sums of the season's
    sums = own(appearances).groupBy(*keys).agg(
        F.max("game_date").alias("last_outing"),
        F.count(F.when(inside, 1)).alias("n"),
        F.count(F.when(inside, F.col("pitches"))).alias("n_known"),
        F.sum(F.when(inside, F.col("pitches"))).alias("sum_pitches"),
        F.min(F.when(inside, F.col("game_date"))).alias("first_in"),
        F.max(F.when(inside, F.col("game_date"))).alias("last_in"),
    )
    some = F.col("n") > 0
    return sums.select(
        *keys,
        "last_outing",
        F.datediff(reference, "last_outing").cast("bigint").alias("days_since"),
        F.when(~some, F.lit(0)).otherwise(F.col("sum_pitches")).cast("bigint").alias("pitches_7d"),
        F.when(some, F.datediff("last_in", "first_in") + 1).cast("bigint").alias("span_days"),
        F.when(some, F.col("n")).alias("appearances_7d"),
        F.when(some, F.col("n") - F.col("n_known")).alias("unknown_7d"),
    )


def history(appearances: DataFrame) -> DataFrame:
    """Completed appearances with rest_days since the pitcher's last one and the team's game number."""
    order = [F.col("game_date"), F.col("start_time").asc_nulls_last()]
    by_pitcher = Window.partitionBy("team_id", "season_id", "player_id").orderBy(*order, "game_id", "seq")
    by_team = Window.partitionBy("team_id", "season_id").orderBy(*order)
    done = own(appearances).filter(F.col("status") == "completed")
    return done.withColumns(
        {
            "rest_days": F.datediff("game_date", F.lag("game_date").over(by_pitcher)).cast("bigint"),
            "team_game_number": F.dense_rank().over(by_team).cast("bigint"),
        }
    )


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds is_start: order 1 where a pitcher has any order; else most outs (above 0) of the team in the game, first row wins."""
    pitcher = Window.partitionBy("team_id", "season_id", "player_id")
    game = Window.partitionBy("team_id", "season_id", "game_id").orderBy(F.desc("ip_outs"), "seq", "player_id")
    ordered = F.max("appearance_order").over(pitcher).isNotNull()
    most = (F.row_number().over(game) == 1) & (F.col("ip_outs") > 0)
    return rows.withColumn("is_start", F.when(ordered, F.coalesce(F.col("appearance_order") == 1, F.lit(False))).otherwise(most))


def start_intervals(appearances: DataFrame) -> DataFrame:
    """Each start with the days since the pitcher's last start."""
    starts = with_starts(history(appearances)).filter("is_start")
    order = Window.partitionBy("team_id", "season_id", "player_id").orderBy("game_date", F.col("start_time").asc_nulls_last(), "game_id", "seq")
    return starts.withColumn("start_rest", F.datediff("game_date", F.lag("game_date").over(order)).cast("bigint"))


def profiles(appearances: DataFrame) -> DataFrame:
    """Per pitcher: games, outs, strikeouts, k9, starts, and the mean rest between starts."""
    keys = ["team_id", "season_id", "player_id"]
    rows = with_starts(history(appearances))
    started = Window.partitionBy(*keys, "is_start").orderBy("game_date", F.col("start_time").asc_nulls_last(), "game_id", "seq")
    rows = rows.withColumn("start_rest", F.when(F.col("is_start"), F.datediff("game_date", F.lag("game_date").over(started))))
    made = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"),
        F.sum(rates.zero("ip_outs")).alias("ip_outs"),
        F.sum(rates.zero("so")).alias("so"),
        F.sum(F.col("is_start").cast("bigint")).alias("starts"),
        F.avg("start_rest").alias("mean_start_rest"),
    )
    return made.withColumn("k9", rates.per_nine("so"))


def run_density(games: DataFrame, window_days: int = 7, least: int = 3) -> DataFrame:
    """Per team and season: the longest run of game dates not more than a day apart, within window_days of the last date."""
    dates = games.select("team_id", "season_id", "game_date").distinct()
    team = Window.partitionBy("team_id", "season_id")
    dates = dates.filter("game_date is not null").withColumn("latest", F.max("game_date").over(team))
    dates = dates.filter(F.datediff("latest", "game_date") <= window_days)
    order = team.orderBy("game_date")
    begins = F.coalesce(F.datediff("game_date", F.lag("game_date").over(order)) > 1, F.lit(True))
    runs = dates.withColumn("run", F.sum(begins.cast("bigint")).over(order)).groupBy("team_id", "season_id", "run").agg(F.count(F.lit(1)).alias("n"))
    longest = runs.groupBy("team_id", "season_id").agg(F.max("n").alias("longest_run"))
    return longest.withColumn("is_dense", F.col("longest_run") >= least)


def rest_needed(pitches: Column, rules: Column) -> Column:
    """Days of rest after so many pitches under a rule set; beyond the top tier its rest, 0 for none."""
    out = F.lit(None).cast("bigint")
    for name, tiers in RULES.items():
        days = F.lit(tiers[-1][2])
        for low, high, rest in reversed(tiers):
            days = F.when(pitches <= high, rest).otherwise(days)
        out = F.when(rules == name, F.when(pitches < tiers[0][0], 0).otherwise(days)).otherwise(out)
    return out.cast("bigint")


def rule_set(league: Column, reference: Column) -> Column:
    """The rule set of a league on a date; null for a league without one."""
    early = F.month(reference) < 4
    return F.when(league == "legion", "legion").when(league == "subvarsity", "subvarsity").when(league == "varsity", F.when(early, "early").otherwise("late"))


def eligibility(appearances: DataFrame, reference: Column, rules: Column) -> DataFrame:
    """Per pitcher: whether the rules let them pitch on the reference date, and the reason if not.

    The pitches of the last date count together; if any of them is unknown the pitcher is left out. Two appearances on the two
    days before leave a pitcher out, too. A last date after the reference leaves nobody out.
    """
    keys = ["team_id", "season_id", "player_id"]
    rows = own(appearances).filter(F.col("status") == "completed")
    rows = rows.withColumn("last", F.max("game_date").over(Window.partitionBy(*keys)))
    on_last = F.col("game_date") == F.col("last")
    made = rows.groupBy(*keys).agg(
        F.max("last").alias("last_date"),
        F.sum(F.when(on_last, F.col("pitches"))).cast("bigint").alias("last_pitches"),
        F.count(F.when(on_last & F.col("pitches").isNull(), 1)).alias("unknown"),
        F.count(F.when(F.datediff(reference, "game_date").isin(1, 2), 1)).alias("two_days"),
    )
    needed = rest_needed(F.col("last_pitches"), rules)
    rested = F.datediff(reference, "last_date")
    reason = (
        F.when(F.col("last_date") > reference, F.lit(None))
        .when(F.col("unknown") > 0, "unknown pitches")
        .when(rested < needed, "rest")
        .when(F.col("two_days") >= 2, "consecutive days")
    )
    return made.select(*keys, "last_date", F.when(F.col("unknown") == 0, F.col("last_pitches")).alias("last_pitches"), rested.cast("bigint").alias("rested"), reason.alias("reason"), reason.isNull().alias("eligible"))


def rest_table(made: DataFrame) -> DataFrame:
    """Per team and season: the two with most starts, then relievers with most games, three in all."""
    keys = ["team_id", "season_id"]
    starter = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.col("starts") > 0), F.desc("starts"), F.desc("games"), "player_id"))
    rows = made.withColumn("as_starter", (F.col("starts") > 0) & (starter <= 2))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("as_starter"), F.when(F.col("as_starter"), F.col("starts")).desc_nulls_last(), F.desc("games"), "player_id"))
    kept = rows.filter(F.col("as_starter") | (F.col("starts") == 0))
    return kept.withColumn("nth", nth.cast("bigint")).filter("nth <= 3").select(*keys, "player_id", "starts", "games", "nth")


def with_order_filled(lines: DataFrame, listed: DataFrame) -> DataFrame:
    """lines whose null appearance_order is the place at which a box score lists the pitcher (game_id, team_id, pitchers: in order).

    A pitcher that is listed twice has the first place; an order that is known stays.
    """
    places = listed.select("game_id", "team_id", F.posexplode("pitchers").alias("_at", "player_id")).groupBy("game_id", "team_id", "player_id").agg((F.min("_at") + 1).cast("bigint").alias("_order"))
    rows = lines.join(places, ["game_id", "team_id", "player_id"], "left")
    return rows.withColumn("appearance_order", F.coalesce("appearance_order", "_order")).drop("_order").select(*lines.columns)
