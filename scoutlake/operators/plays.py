"""Plate appearances: parsing play-by-play, first-pitch and quality flags, rates, and reconciliation with box scores.

plays: game_id, perspective_team_id, play_order, half, batting_team_id, batter_id, pitcher_id, outcome, pitch_count,
is_first_pitch_strike, is_qab, did_outs_change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scoutlake.functions import rates, text

# fixed values of the play-by-play format
PITCHES = {
    "Ball 1": "ball", "Ball 2": "ball", "Ball 3": "ball", "Ball 4": "ball",
    "Strike 1 looking": "strike_looking", "Strike 2 looking": "strike_looking", "Strike 3 looking": "strike_looking",
    "Strike 1 swinging": "strike_swinging", "Strike 2 swinging": "strike_swinging", "Strike 3 swinging": "strike_swinging",
    "Foul": "foul", "Foul tip": "foul_tip", "In play": "in_play", "Foul bunt": "foul",
}
NO_APPEARANCE = ("Runner Out", "Inning Ended")
FIRST_STRIKES = ("strike_looking", "strike_swinging", "foul", "foul_tip", "in_play")
NOT_QUALITY = ("Intentional Walk", "Dropped 3rd Strike", "Catcher's Interference")
QUALITY = ("Double", "Triple", "Home Run", "Walk", "Sacrifice Bunt", "Sacrifice Fly")
HITS = ("Single", "Double", "Triple", "Home Run")
STRIKEOUTS = ("Strikeout", "Dropped 3rd Strike")
WALKS = ("Walk", "Intentional Walk")
QUALITY_PITCHES = 6
#: Rows of plate appearances that a worker gathers before it hands them on.
ROWS_AT_ONCE = 5000


def pitch_result(template: Column) -> Column:
    """The pitch that a template names; null for other events."""
    return text.lookup(template, PITCHES)


def event_type(template: Column) -> Column:
    """pitch, substitution, baserunner or other."""
    runner = template.rlike(r"\$\{[0-9a-f-]{36}\}") & template.rlike("advances to|scores|steals|remains at|Pickoff attempt|caught stealing|picked off|Balk|gets placed|out at|out due to|Outs changed")
    change = template.startswith("Lineup changed:") | template.startswith("(Play Edit)") | template.contains("in for pitcher") | template.contains("Courtesy runner")
    return F.when(pitch_result(template).isNotNull(), "pitch").when(change, "substitution").when(runner, "baserunner").otherwise("other")


def after_two_strikes(pitches: Column) -> Column:
    """How many pitches of an ordered array come once two strikes are counted."""
    start = F.struct(F.lit(0).alias("strikes"), F.lit(0).alias("after"))

    def step(s, p):
        strike = p.isin("strike_looking", "strike_swinging", "foul", "foul_tip").cast("int")
        full = s["strikes"] >= 2
        return F.struct(F.when(full, s["strikes"]).otherwise(s["strikes"] + strike).alias("strikes"), (s["after"] + full.cast("int")).alias("after"))

    return F.aggregate(pitches, start, step, lambda s: s["after"]).cast("bigint")


def first_pitch_strike(pitches: Column) -> Column:
    return F.coalesce(F.get(pitches, F.lit(0)).isin(*FIRST_STRIKES), F.lit(False)).cast("bigint")


def quality(outcome: Column, pitches: Column, details: Column) -> Column:
    """1 for a quality plate appearance: many pitches, three after two strikes, hard contact or a good outcome."""
    hard = F.exists(details, lambda d: F.lower(d).contains("line drive") | F.lower(d).contains("hard ground ball"))
    good = (F.size(pitches) >= QUALITY_PITCHES) | ((F.size(pitches) >= 5) & (after_two_strikes(pitches) >= 3)) | hard | outcome.isin(*QUALITY)
    return (F.coalesce(good, F.lit(False)) & ~F.coalesce(outcome.isin(*NOT_QUALITY), F.lit(False))).cast("bigint")


def parsed(games: DataFrame) -> DataFrame:
    """One row for each plate appearance of games (game_id, home_team_id, away_team_id, plays: the JSON array of the format).

    Who pitches depends on earlier decisions within a half-inning label, so one fold runs over a game's plays; one game after
    another goes through it, and a game is never split. A worker holds the plays of one game as Python values, and at most
    ROWS_AT_ONCE rows and a game's besides. All else is Column expressions. Null plays, details and templates
    are empty ones; perspective_team_id and season_id stay if games has them. `events` holds the appearance's events in order; strikes are
    those of its pitches.
    """
    told = "inning bigint, half string, batting_team_id bigint, batter_id string, pitcher_id string, outcome string, home_score bigint, away_score bigint, did_score_change bigint, outs_after bigint, did_outs_change bigint"
    seen = [c for c in ("perspective_team_id", "season_id") if c in games.columns]
    kept = ["game_id", *seen]
    schema = ", ".join(f"{c} {games.schema[c].dataType.simpleString()}" for c in kept) + f", play_order bigint, {told}, templates array<string>, details array<string>"
    names = [c.split()[0] for c in schema.split(", ")]

    kinds = to_arrow_schema(StructType.fromDDL(schema)).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                *head, home, away, listed = (c[i].as_py() for c in batch.columns)
                rows += game_rows(head, home, away, listed)
                if len(rows) >= ROWS_AT_ONCE:
                    yield made()
                    rows.clear()
        if rows:
            yield made()

    rows = games.select(*kept, "home_team_id", "away_team_id", "plays").mapInArrow(run, schema)
    pitches = F.filter(F.transform("templates", pitch_result), lambda x: x.isNotNull())
    rows = rows.withColumn("pitches", pitches)
    made = {"pitch_count": F.size("pitches").cast("bigint"), "is_first_pitch_strike": first_pitch_strike(F.col("pitches")), "is_qab": quality(F.col("outcome"), F.col("pitches"), F.col("details"))}
    made["strikes"] = F.size(F.filter("pitches", lambda x: x.isin(*FIRST_STRIKES))).cast("bigint")
    made["events"] = F.transform("templates", lambda t, i: F.struct(i.cast("bigint").alias("event_order"), event_type(t).alias("event_type"), pitch_result(t).alias("pitch_result"), t.alias("template")))
    return rows.withColumns(made).drop("pitches", "details", "templates")


def play_events(appearances: DataFrame) -> DataFrame:
    """One row for each event of `parsed` appearances, with the keys of its appearance; the first pitch is marked."""
    keys = [c for c in ("game_id", "perspective_team_id", "play_order") if c in appearances.columns]
    first = F.array_position(F.transform("events", lambda e: e["event_type"]), "pitch") - 1
    rows = appearances.select(*keys, first.alias("_first"), F.explode("events").alias("e")).select(*keys, "_first", "e.*")
    return rows.withColumn("is_first_pitch", (F.col("event_order") == F.col("_first")).cast("bigint")).drop("_first")


def _templates(listed) -> list[str]:
    return [(d and d["template"]) or "" for d in (listed if listed is not None else [])]


def game_rows(keys: list, home, away, plays) -> list[tuple]:
    """The plate appearances of one game, with their pitchers; keys begin each row."""
    import re

    ref, explicit = re.compile(text.UUID), re.compile(text.UUID + r"\s+pitching")
    now: dict[str, str | None] = {}
    rows = []
    number = lambda play, c: int(play[c]) if c in play and pd.notna(play[c]) else 0
    for play in plays if plays is not None else []:
        final = _templates(play and play["final_details"])
        if not final:
            continue
        half, told = play["half"] or "top", _templates(play["at_plate_details"])
        begun, thrown = now.get(half), False
        for t in told:
            if ("in at pitcher" in t or "in for pitcher" in t) and (found := ref.search(t)):
                now[half] = found[1]
            elif t in PITCHES and not thrown:
                begun, thrown = now.get(half), True
        outcome, batter = (play["name_template"] and play["name_template"]["template"]) or "", ref.search(final[0])
        if outcome in NO_APPEARANCE or not batter:
            continue
        named = next((m[1] for t in final if (m := explicit.search(t))), None)
        if now.get(half) != begun:
            pitcher = begun
        elif named:
            pitcher = now[half] = named
        else:
            pitcher = begun or now.get(half)
        numbers = [number(play, c) for c in ("home_score", "away_score", "did_score_change", "outs", "did_outs_change")]
        rows.append([*keys, number(play, "order"), number(play, "inning"), half, away if half == "top" else home, batter[1], pitcher, outcome, *numbers, told, final])
    at_half, at_pitcher = len(keys) + 2, len(keys) + 5
    for half in {r[at_half] for r in rows}:
        own = [r for r in rows if r[at_half] == half]
        known = next((r[at_pitcher] for r in own if r[at_pitcher]), None)
        for r in own:
            if r[at_pitcher]:
                break
            r[at_pitcher] = known
    return [tuple(r) for r in rows]


def first_appearances(plays: DataFrame) -> DataFrame:
    """Pitchers of each game, perspective and batting team in the order in which they first appear: nth, and who comes before."""
    key = ["game_id", "perspective_team_id", "batting_team_id"]
    first = plays.filter("pitcher_id is not null").groupBy(*key, "pitcher_id").agg(F.min("play_order").alias("first_play"), F.count(F.lit(1)).alias("bf"))
    order = Window.partitionBy(*key).orderBy("first_play", "pitcher_id")
    return first.withColumns({"nth": F.row_number().over(order).cast("bigint"), "before": F.lag("pitcher_id").over(order)})


def pitcher_rates(plays: DataFrame) -> DataFrame:
    """First-pitch-strike percentage over all batters faced, and pitches a batter."""
    sums = plays.filter("pitcher_id is not null").groupBy("pitcher_id").agg(F.count(F.lit(1)).alias("bf"), F.sum("is_first_pitch_strike").cast("bigint").alias("fps"), F.sum("pitch_count").cast("bigint").alias("pitches"))
    return sums.withColumns({"fps_pct": rates.percent(F.col("fps"), F.col("bf")), "pitches_per_bf": rates.per(F.col("pitches"), F.col("bf"))})


def batter_rates(plays: DataFrame) -> DataFrame:
    """Quality-appearance percentage and pitches an appearance."""
    sums = plays.groupBy("batter_id").agg(F.count(F.lit(1)).alias("pa"), F.sum("is_qab").cast("bigint").alias("qab"), F.sum("pitch_count").cast("bigint").alias("pitches"))
    return sums.withColumns({"qab_pct": rates.percent(F.col("qab"), F.col("pa")), "pitches_per_pa": rates.per(F.col("pitches"), F.col("pa"))})


def team_rates(plays: DataFrame) -> DataFrame:
    """Per batting team: games with plays, appearances, quality percentage, pitches an appearance."""
    sums = plays.groupBy("batting_team_id").agg(F.count_distinct("game_id").alias("games"), F.count(F.lit(1)).alias("pa"), F.sum("is_qab").cast("bigint").alias("qab"), F.sum("pitch_count").cast("bigint").alias("pitches"))
    return sums.withColumns({"qab_pct": rates.percent(F.col("qab"), F.col("pa")), "pitches_per_pa": rates.per(F.col("pitches"), F.col("pa"))})


SIGNALS = ["bf", "ip_outs", "so", "bb", "hbp", "h", "pitches", "total_strikes"]
NOT_CORRECTABLE = ("ip_outs", "wp")


def plays_by_pitcher(plays: DataFrame) -> DataFrame:
    """The pitchers' counters from plays, by the names of box scores."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    outcome = F.col("outcome")
    return plays.filter("pitcher_id is not null").groupBy("game_id", "perspective_team_id", F.col("pitcher_id").alias("player_id")).agg(
        F.count(F.lit(1)).alias("bf"),
        F.sum("did_outs_change").cast("bigint").alias("ip_outs"),
        count(outcome.isin(*STRIKEOUTS)).alias("so"),
        count(outcome.isin(*WALKS)).alias("bb"),
        count(outcome == "Hit By Pitch").alias("hbp"),
        count(outcome.isin(*HITS)).alias("h"),
        F.sum("pitch_count").cast("bigint").alias("pitches"),
        F.sum("strikes").cast("bigint").alias("total_strikes"),
    )


def reconciled(box: DataFrame, derived: DataFrame, keys: list[str], signals: list[str]) -> DataFrame:
    """One row for each key and signal: both values, their difference and status. Either side may lack a key.

    Where batters, strikeouts and walks agree, the box score's pitches and strikes replace those of the plays.
    """
    left = box.select(*keys, *(F.col(s).alias(f"box_{s}") for s in signals), F.lit(True).alias("in_box"))
    right = derived.select(*keys, *(F.col(s).alias(f"plays_{s}") for s in signals), F.lit(True).alias("in_plays"))
    both = left.join(right, keys, "full_outer")
    gate = [s for s in ("bf", "so", "bb") if s in signals]
    agree = F.lit(bool(gate))
    for s in gate:
        agree = agree & (F.col(f"box_{s}") == F.col(f"plays_{s}"))
    rows = []
    for s in signals:
        plays = F.col(f"plays_{s}")
        if s in ("pitches", "total_strikes"):
            plays = F.when(agree & F.col("box_pitches").isNotNull() & F.col("box_total_strikes").isNotNull(), F.col(f"box_{s}")).otherwise(plays)
        rows.append(F.struct(F.lit(s).alias("signal"), F.col(f"box_{s}").alias("boxscore_value"), plays.alias("plays_value")))
    out = both.select(*keys, "in_box", "in_plays", F.explode(F.array(*rows)).alias("_s")).select(*keys, "in_box", "in_plays", "_s.*")
    delta = F.col("plays_value") - F.col("boxscore_value")
    status = F.when(F.col("in_box").isNull() | F.col("in_plays").isNull() | delta.isNull(), "UNCORRECTABLE").when(delta == 0, "MATCH").when(F.col("signal").isin(*NOT_CORRECTABLE), "UNCORRECTABLE").otherwise("CORRECTABLE")
    return out.select(*keys, "signal", "boxscore_value", "plays_value", delta.alias("delta"), status.alias("status"))


def attributed(plays: DataFrame, box: DataFrame) -> DataFrame:
    """Each play with the pitcher that the box score's batters faced, in order, give it (box: game_id, player_id, nth, bf).

    Games are left alone unless they have two pitchers or more, none twice, and as many plays as batters faced. Pitchers of a
    game are an array of bounds, so a play finds its own without a range join.
    """
    before = Window.partitionBy("game_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    bounds = box.withColumn("last", F.sum("bf").over(before)).groupBy("game_id").agg(
        F.sort_array(F.collect_list(F.struct("last", "player_id"))).alias("bounds"), F.sum("bf").alias("batters"), F.count(F.lit(1)).alias("pitchers"), F.count_distinct("player_id").alias("different")
    )
    rows = plays.withColumn("n", F.row_number().over(Window.partitionBy("game_id").orderBy("play_order")).cast("bigint"))
    rows = rows.withColumn("plays", F.count(F.lit(1)).over(Window.partitionBy("game_id")))
    fits = (F.col("pitchers") >= 2) & (F.col("pitchers") == F.col("different")) & (F.col("batters") == F.col("plays"))
    given = F.get(F.filter("bounds", lambda b: b["last"] >= F.col("n")), F.lit(0))["player_id"]
    return rows.join(bounds, "game_id", "left").select("game_id", "play_order", F.when(fits, given).alias("given_pitcher"), F.coalesce(fits, F.lit(False)).alias("corrected"))


def status_counts(discrepancies: DataFrame) -> DataFrame:
    """Signals by status, over the latest row of each key (created_at, then ingest_seq)."""
    key = ["game_id", "perspective_team_id", "player_id", "signal"]
    latest = Window.partitionBy(*key).orderBy(F.desc("created_at"), F.desc("ingest_seq"))
    rows = discrepancies.withColumn("nth", F.row_number().over(latest)).filter("nth = 1")
    return rows.groupBy("signal", "status").agg(F.count(F.lit(1)).alias("n"))


def compared(derived: DataFrame, official: DataFrame, keys: list[str], value: str, tolerance: float = 5.0) -> DataFrame:
    """Keys that both have, with both values, by how many percent the derived one is off, and whether that is within tolerance."""
    both = derived.select(*keys, F.col(value).alias("derived")).join(official.select(*keys, F.col(value).alias("official")).filter("official is not null"), keys)
    off = rates.tolerance_percent(F.col("derived"), F.col("official"))
    return both.withColumn("off_pct", off).withColumn("within", F.col("off_pct") <= tolerance)


def outliers(plays: DataFrame, games: DataFrame, comparisons: DataFrame, player: str, flag: str, samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """Of the players whose comparison is not within tolerance (comparisons: player_id, within): their flagged plays by game, and
    their first plays. player is the column of plays that names them."""
    off = comparisons.filter(~F.col("within")).select("player_id").distinct()
    rows = plays.withColumn("player_id", F.col(player)).join(off, "player_id", "left_semi")
    by_game = rows.groupBy("player_id", "game_id").agg(F.count(F.lit(1)).alias("plays"), F.sum(flag).cast("bigint").alias("flagged"))
    dated = by_game.join(games.select("game_id", "game_date"), "game_id", "left")
    share = rates.percent(F.col("flagged"), F.col("plays"))
    first = Window.partitionBy("player_id").orderBy("game_id", "play_order")
    sample = rows.withColumn("nth", F.row_number().over(first).cast("bigint")).filter(F.col("nth") <= samples)
    by_game = dated.select("player_id", "game_id", F.coalesce(F.col("game_date").cast("string"), F.lit("unknown")).alias("game_date"), "plays", "flagged", share.alias("flagged_pct"))
    return by_game, sample.select("player_id", "nth", "game_id", "play_order", "half", "outcome", "pitch_count", F.col(flag).alias("flag_value"))
