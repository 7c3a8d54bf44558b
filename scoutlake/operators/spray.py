"""Batted balls: zones, contact and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.functions import text

# fixed values of the field's drawing: two anchor points map raw places to the chart
X_SCALE, Y_SCALE = (160 - 211.25) / (160 - 234), (295 - 246) / (296 - 220)
HOME_X, HOME_Y = 160, 295
THIRD = 0.206
HITS = ("single", "double", "triple", "home_run", "dropped_third_strike")
LEFT_OF, RIGHT_OF = 109.0, 211.0
CONTACT = {"ground_ball": "gb", "hard_ground_ball": "gb", "line_drive": "ld", "hard_line_drive": "ld", "fly_ball": "fb", "popup": "pu", "pop_fly": "pu", "pop_up": "pu", "bunt": "bu"}
LEAST_PLAYER, LEAST_TEAM = 3, 20


def chart_x(x: Column) -> Column:
    return F.lit(160 - 160 * X_SCALE) + x * X_SCALE


def chart_y(y: Column) -> Column:
    return F.lit(295 - 296 * Y_SCALE) + y * Y_SCALE


def zone(x: Column, y: Column) -> Column:
    """left, center or right by the angle seen from home; null without a place."""
    angle = F.atan2(chart_x(x) - HOME_X, -(chart_y(y) - HOME_Y))
    return F.when(x.isNull() | y.isNull(), None).when(angle < -THIRD, "left").when(angle > THIRD, "right").otherwise("center")


def home_run_zone(x: Column, y: Column) -> Column:
    """The side of a home run; one over the fence has no place and counts as center."""
    return F.when(x.isNull() | y.isNull(), "center").when(chart_x(x) < LEFT_OF, "left").when(chart_x(x) > RIGHT_OF, "right").otherwise("center")


def is_hit(result: Column) -> Column:
    return F.coalesce(result.isin(*HITS), F.lit(False))


def zone_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Batted balls, hits and zones per key."""
    rows = events.withColumn("zone", zone(F.col("x"), F.col("y")))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("bip"), count(is_hit(F.col("play_result"))).alias("hits"), *(count(F.col("zone") == z).alias(f"n_{z}") for z in ("left", "center", "right")))


def contact(play_type: Column) -> Column:
    """How a ball was hit: gb, ld, fb, pu or bu; null for other types."""
    return text.lookup(play_type, CONTACT)


def summaries(events: DataFrame, keys: list[str], least: int = LEAST_PLAYER) -> DataFrame:
    """Per key: balls in play, hits, zones (a home run's by its own rule), contact classes, and whether there are enough for a chart."""
    out = F.col("play_result") == "home_run"
    place = F.when(F.coalesce(out, F.lit(False)), home_run_zone(F.col("x"), F.col("y"))).otherwise(zone(F.col("x"), F.col("y")))
    rows = events.withColumns({"_zone": place, "_contact": contact(F.col("play_type"))})
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    made = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bip"), count(is_hit(F.col("play_result"))).alias("hits"), *(count(F.col("_zone") == z).alias(f"n_{z}") for z in ("left", "center", "right")), *(count(F.col("_contact") == c).alias(f"n_{c}") for c in dict.fromkeys(CONTACT.values()))
    )
    return made.withColumn("charted", F.col("bip") >= least)


def load(events: DataFrame, teams: DataFrame, games: DataFrame, rosters: DataFrame, old: DataFrame, guess: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows that a load of batted balls adds to old, and per game and perspective how many events it loaded and skipped.

    events: seq, game_id, gc_uuid (whose data it is), season_id, section (offense, defense), player_id, event_id, created_at_ms,
    play_result, play_type, fielded (there is a defender), x, y, fielder_position, error (of the first defender). A ball is its
    player's team's: on the roster of home, else of away, in that season. Nobody's ball goes to the team across from whose
    data it is (away if it is neither side), or with guess off is skipped. An event is skipped without an id, with a defender
    but no place, or if its id comes again from a perspective. A game that a perspective has loaded already is one skip; of
    games or teams that are not known nothing is said.
    """
    pair = ["game_id", "perspective_team_id"]
    rows = events.join(teams.select("gc_uuid", F.col("id").alias("perspective_team_id")), "gc_uuid").join(games.select("game_id", "home_team_id", "away_team_id"), "game_id")
    seen = old.select(*pair).distinct().withColumn("_seen", F.lit(True))
    rows = rows.join(seen, pair, "left")
    again = rows.filter("_seen").select(*pair).distinct().select(*pair, F.lit(0).cast("bigint").alias("loaded"), F.lit(1).cast("bigint").alias("skipped"))
    rows = rows.filter("_seen is null").drop("_seen")
    on = rosters.select("player_id", "season_id", F.col("team_id").alias("_t")).distinct()
    for side in ("home", "away"):
        rows = rows.join(on.withColumnRenamed("_t", f"{side}_team_id").withColumn(f"_on_{side}", F.lit(True)), ["player_id", "season_id", f"{side}_team_id"], "left")
    across = F.when(F.col("perspective_team_id") == F.col("away_team_id"), F.col("home_team_id")).otherwise(F.col("away_team_id"))
    rows = rows.withColumn("team_id", F.when(F.col("_on_home"), F.col("home_team_id")).when(F.col("_on_away"), F.col("away_team_id")).otherwise(across if guess else F.lit(None)))
    whole = F.col("team_id").isNotNull() & (F.coalesce("event_id", F.lit("")) != "") & (~F.col("fielded") | (F.col("x").isNotNull() & F.col("y").isNotNull()))
    first = Window.partitionBy("event_id", "perspective_team_id").orderBy(F.desc("whole"), F.desc("section"), "seq")  # offense first
    rows = rows.withColumn("whole", whole).withColumn("nth", F.row_number().over(first))
    known = old.filter("event_id is not null").select("event_id", "perspective_team_id").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, ["event_id", "perspective_team_id"], "left").withColumn("new", F.col("whole") & (F.col("nth") == 1) & F.col("_known").isNull())
    counts = rows.groupBy(*pair).agg(F.sum(F.col("new").cast("bigint")).alias("loaded"), F.sum((~F.col("new")).cast("bigint")).alias("skipped"))
    placed = lambda c: F.when(F.col("fielded"), F.col(c)).alias(c)
    chart = F.when(F.col("section") == "offense", "offensive").otherwise("defensive").alias("chart_type")
    made = rows.filter("new").select("game_id", "player_id", "team_id", chart, "play_type", "play_result", *(placed(c) for c in ("x", "y", "fielder_position", "error")), "event_id", "created_at_ms", "season_id", "perspective_team_id")
    return made, counts.unionByName(again)
