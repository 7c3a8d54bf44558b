"""Season rollups, leaderboards, percentile heat, key players and team cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.functions import rates
from scoutlake.operators.pitching import own

BATTING = ["ab", "h", "doubles", "triples", "hr", "rbi", "bb", "so", "hbp", "shf"]
PITCHING = ["ip_outs", "h", "er", "bb", "so", "pitches", "total_strikes"]
#: Qualified players from here on get at most this heat (fixed values).
BATTING_DEPTH = [(9, 4), (7, 3), (5, 2), (3, 1)]
PITCHING_DEPTH = [(6, 4), (4, 3), (3, 2), (2, 1)]
LEAST_PA, LEAST_OUTS = 5, 18
KEYS = ["team_id", "season_id", "player_id"]


def season_batting(games: DataFrame) -> DataFrame:
    """Sums of own-perspective game rows, with games, pa, singles and xbh."""
    sums = own(games).groupBy(*KEYS).agg(F.count_distinct("game_id").alias("games"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in BATTING))
    return sums.withColumns({"pa": rates.plate_appearances(), "xbh": rates.extra_bases(), "singles": rates.singles()})


def season_pitching(games: DataFrame) -> DataFrame:
    """Sums of own-perspective game rows, with games and gs; gs is null where no order is known."""
    starts = F.when(F.max("appearance_order").isNotNull(), F.sum(F.when(F.col("appearance_order") == 1, 1).otherwise(0)))
    sums = [F.sum(c).cast("bigint").alias(c) for c in PITCHING]
    return own(games).groupBy(*KEYS).agg(F.count_distinct("game_id").alias("games"), *sums, starts.cast("bigint").alias("gs"))


def batting_leaders(season: DataFrame, players: DataFrame, rosters: DataFrame) -> DataFrame:
    """Season rows with names, jersey numbers and rates, and their rank in the team: without at-bats last, then by average."""
    rows = season.join(players, "player_id").join(rosters, KEYS, "left")
    rows = rows.withColumns({"avg": rates.avg(), "obp": rates.obp(), "slg": rates.slg(), "k_pct": rates.percent(F.col("so"), F.col("pa"))})
    order = Window.partitionBy("team_id", "season_id").orderBy(F.when(F.col("ab") == 0, 1).otherwise(0), F.col("avg").desc_nulls_last(), "last_name", "player_id")
    return rows.withColumn("nth", F.row_number().over(order).cast("bigint"))


def pitching_leaders(season: DataFrame, players: DataFrame, rosters: DataFrame) -> DataFrame:
    """Season rows with names and rates, and their rank in the team: without outs last, then by earned-run average."""
    rows = season.join(players, "player_id").join(rosters, KEYS, "left")
    rows = rows.withColumns({"era": rates.era(), "k9": rates.per_nine("so"), "bb9": rates.per_nine("bb"), "whip": rates.whip(), "strike_pct": rates.strike_percent(), "innings": rates.innings(rates.zero("ip_outs"))})
    order = Window.partitionBy("team_id", "season_id").orderBy(F.when(rates.zero("ip_outs") == 0, 1).otherwise(0), F.col("era").asc_nulls_last(), "last_name", "player_id")
    return rows.withColumn("nth", F.row_number().over(order).cast("bigint"))


def _level(share: Column, qualified: Column, depth: list[tuple[int, int]]) -> Column:
    level = F.when(share >= 0.70, 4).when(share >= 0.40, 3).when(share >= 0.20, 2).otherwise(1)
    cap = F.lit(0)
    for least, most in sorted(depth):
        cap = F.when(qualified >= least, most).otherwise(cap)
    return F.least(level, cap).cast("bigint")


def _heat(rows: DataFrame, metrics: dict[str, bool], depth: list[tuple[int, int]]) -> DataFrame:
    """rows with qualified, and pr_ and heat_ of each metric (True: less is better); 0 for who does not qualify."""
    team = Window.partitionBy("team_id", "season_id", "qualified")
    size = F.count(F.lit(1)).over(team)
    for m, less in metrics.items():
        share = F.cume_dist().over(team.orderBy(F.col(m).desc() if less else F.col(m)))
        rows = rows.withColumn(f"pr_{m}", F.when(F.col("qualified"), share))
        rows = rows.withColumn(f"heat_{m}", F.when(F.col("qualified"), _level(F.col(f"pr_{m}"), size, depth)).otherwise(F.lit(0).cast("bigint")))
    return rows


def batting_heat(season: DataFrame) -> DataFrame:
    rows = season.withColumns({"qualified": F.col("pa") >= LEAST_PA, "avg": F.coalesce(rates.avg(), F.lit(0.0)), "obp": F.coalesce(rates.obp(), F.lit(0.0)), "slg": F.coalesce(rates.slg(), F.lit(0.0)), "composite": rates.batting_composite()})
    return _heat(rows, {"avg": False, "obp": False, "slg": False, "composite": False}, BATTING_DEPTH)


def pitching_heat(season: DataFrame) -> DataFrame:
    """Heat of era, whip and k9, and of the composite of their percentile ranks."""
    rows = season.withColumns({"qualified": rates.zero("ip_outs") >= LEAST_OUTS, "era": F.coalesce(rates.era(), F.lit(0.0)), "whip": F.coalesce(rates.whip(), F.lit(0.0)), "k9": F.coalesce(rates.per_nine("so"), F.lit(0.0))})
    rows = _heat(rows, {"era": True, "k9": False, "whip": True}, PITCHING_DEPTH)
    rows = rows.withColumn("composite", F.when(F.col("qualified"), 0.40 * F.col("pr_era") + 0.30 * F.col("pr_k9") + 0.30 * F.col("pr_whip")).otherwise(0.0))
    return _heat(rows, {"composite": False}, PITCHING_DEPTH)


def key_players(batting: DataFrame, pitching: DataFrame) -> DataFrame:
    """Per team and season: the pitcher with most outs and the batter with the best on-base percentage, among the qualified."""
    team = Window.partitionBy("team_id", "season_id")
    arm = pitching.filter(rates.zero("ip_outs") >= LEAST_OUTS).withColumn("nth", F.row_number().over(team.orderBy(F.desc("ip_outs"), "player_id")))
    bat = batting.filter(F.col("pa") >= LEAST_PA).withColumn("obp", rates.obp()).withColumn("nth", F.row_number().over(team.orderBy(F.desc("obp"), "player_id")))
    arm = arm.filter("nth = 1").select("team_id", "season_id", F.col("player_id").alias("pitcher_id"), F.col("ip_outs").alias("pitcher_outs"))
    bat = bat.filter("nth = 1").select("team_id", "season_id", F.col("player_id").alias("batter_id"), F.col("obp").alias("batter_obp"))
    return arm.join(bat, ["team_id", "season_id"], "full_outer")


def team_batting(season: DataFrame) -> DataFrame:
    """A team's season as one batter."""
    sums = season.groupBy("team_id", "season_id").agg(*(F.sum(c).cast("bigint").alias(c) for c in BATTING)).withColumn("pa", rates.plate_appearances())
    return sums.withColumns({"avg": rates.avg(), "obp": rates.obp(), "slg": rates.slg(), "k_pct": rates.percent(F.col("so"), F.col("pa")), "bb_pct": rates.percent(F.col("bb"), F.col("pa"))})


def leaders(rows: DataFrame, by: str, descending: bool = True, n: int | None = None, allowed: tuple[str, ...] = ("avg", "obp", "slg", "era", "k9", "whip", "last_name")) -> DataFrame:
    """Rows in a chosen order, nulls last either way; an unknown column falls back to the first allowed one that there is."""
    if by not in allowed or by not in rows.columns:
        by, descending = next(c for c in allowed if c in rows.columns), True
    key = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    out = rows.orderBy(key, "player_id")
    return out.limit(n) if n is not None else out
