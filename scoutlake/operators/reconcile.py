"""Reconciliation of plate appearances with box scores, for every game and perspective in one plan.

plays: game_id, perspective_team_id, play_order, half, batter_id, pitcher_id, outcome, pitch_count, did_outs_change, strikes,
wild_pitches (the last two by `with_event_counts`). games: game_id, home_team_id, away_team_id, home_score, away_score.
pitching: game_id, perspective_team_id, team_id, player_id, appearance_order, bf, ip_outs, so, bb, hbp, h, pitches,
total_strikes, wp, seq (the order of insertion). batting: the same keys, ab, h, so, bb, hbp.

A row says what one signal of a player or a team has in the box score and in the plays: category, boxscore_value, plays_value,
delta (box score less plays), status and correction_detail. MATCH agrees; CORRECTABLE may be mended by giving plays to other
pitchers; UNCORRECTABLE lacks a pitcher on one side; AMBIGUOUS cannot be told from plays; CORRECTED was CORRECTABLE before.
Games that are not in games, or without plays from a perspective, have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutlake.operators.plays import FIRST_STRIKES, HITS, STRIKEOUTS, WALKS

# fixed values
NO_AT_BAT = ("Walk", "Hit By Pitch", "Sacrifice Fly", "Sacrifice Bunt", "Catcher's Interference", "Intentional Walk")
HIT_BATTERS = ("Hit By Pitch",)
WHOLE_GAME = "__game__"
GATE = "BF+SO+BB match"

KEYS = ["game_id", "perspective_team_id", "team_id"]
PITCHER = ["bf", "ip_outs", "so", "bb", "hbp", "pitches", "total_strikes", "h", "wp"]
BATTER = ["ab", "h", "so", "bb", "hbp"]
SUPPLEMENTED = ("pitches", "total_strikes")
UNCLEAR = ("ip_outs", "wp")


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("bigint")), F.lit(0))


def _whole(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("bigint")


def with_event_counts(plays: DataFrame, events: DataFrame) -> DataFrame:
    """plays with strikes and wild_pitches, counted in events (the keys of plays, pitch_result, template)."""
    keys = ["game_id", "perspective_team_id", "play_order"]
    sums = events.groupBy(*keys).agg(_count(F.col("pitch_result").isin(*FIRST_STRIKES)).alias("strikes"), _count(F.lower("template").contains("wild pitch")).alias("wild_pitches"))
    rows = plays.drop("strikes", "wild_pitches").join(sums, keys, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("strikes", "wild_pitches")})


def default_perspective(plays: DataFrame, games: DataFrame) -> DataFrame:
    """Per game the perspective to read if none is named: home's, else away's, else the least that has plays."""
    seen = plays.select("game_id", "perspective_team_id").distinct().join(games.select("game_id", "home_team_id", "away_team_id"), "game_id")
    own = F.col("perspective_team_id")
    rank = F.when(own == F.col("home_team_id"), 0).when(own == F.col("away_team_id"), 1).otherwise(2)
    return seen.groupBy("game_id").agg(F.min_by(own, F.struct(rank, own)).alias("perspective_team_id"))


def sides(plays: DataFrame, games: DataFrame) -> DataFrame:
    """Two rows for each game and perspective with plays: a team, the half it pitches in, the half it bats in, its score."""
    home = F.struct(F.col("home_team_id").alias("team_id"), F.lit("top").alias("pitching_half"), F.lit("bottom").alias("batting_half"), F.col("home_score").alias("score"))
    away = F.struct(F.col("away_team_id").alias("team_id"), F.lit("bottom").alias("pitching_half"), F.lit("top").alias("batting_half"), F.col("away_score").alias("score"))
    seen = plays.select("game_id", "perspective_team_id").distinct().join(games, "game_id")
    scored = (F.col("home_score").isNotNull() & F.col("away_score").isNotNull()).alias("scored")
    return seen.select("game_id", "perspective_team_id", scored, F.explode(F.array(home, away)).alias("_s")).select("game_id", "perspective_team_id", "scored", "_s.*")


def _thrown(plays: DataFrame, of: DataFrame) -> DataFrame:
    """Plays with the team that pitches."""
    return plays.join(of.select(*KEYS, F.col("pitching_half").alias("half")), ["game_id", "perspective_team_id", "half"])


def _from_plays(thrown: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    return thrown.filter("pitcher_id is not null").groupBy(*KEYS, F.col("pitcher_id").alias("player_id")).agg(
        F.count(F.lit(1)).alias("bf"),
        _count(F.col("did_outs_change") != 0).alias("ip_outs"),
        _count(outcome.isin(*STRIKEOUTS)).alias("so"),
        _count(outcome.isin(*WALKS)).alias("bb"),
        _count(outcome.isin(*HIT_BATTERS)).alias("hbp"),
        F.sum(_whole("pitch_count")).alias("pitches"),
        F.sum(_whole("strikes")).alias("total_strikes"),
        _count(outcome.isin(*HITS)).alias("h"),
        F.sum(_whole("wild_pitches")).alias("wp"),
        F.min("play_order").alias("first_play"),
    )


def _from_box(pitching: DataFrame, of: DataFrame) -> DataFrame:
    """A row for each pitcher; of rows for one pitcher the last one counts."""
    own = pitching.join(of.select(*KEYS), KEYS, "left_semi")
    last = own.groupBy(*KEYS, "player_id").agg(F.max_by(F.struct(*PITCHER), "seq").alias("_b"))
    return last.select(*KEYS, "player_id", *(F.coalesce(F.col(f"_b.{c}"), F.lit(0)).cast("bigint").alias(c) for c in PITCHER), (F.col("_b.pitches").isNotNull() & F.col("_b.total_strikes").isNotNull()).alias("counted"))


def box_order(pitching: DataFrame) -> DataFrame:
    """Per game, perspective and team: the pitchers in order of appearance (unknown places last, by insertion)."""
    row = F.struct(F.col("appearance_order").isNull().alias("late"), "appearance_order", "seq", F.col("player_id").alias("player"))
    return pitching.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["player"]).alias("box_order"))  # a team's pitchers in a game


def _rows(*kept: Column) -> list[Column]:
    names = ["player_id", "signal_name", "category", "boxscore_value", "plays_value", "delta", "status", "correction_detail"]
    return [*KEYS, *(c.alias(n) for n, c in zip(names, kept, strict=True))]


def _json(*parts: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in parts)), {"ignoreNullFields": "false"})


def pitcher_signals(thrown: DataFrame, of: DataFrame, pitching: DataFrame) -> DataFrame:
    """Nine counters for each pitcher of either side, and the starter and the order of each team."""
    mine = _from_plays(thrown)
    left = _from_box(pitching, of).select(*KEYS, "player_id", "counted", *(F.col(c).alias(f"box_{c}") for c in PITCHER))
    right = mine.select(*KEYS, "player_id", *(F.col(c).alias(f"plays_{c}") for c in PITCHER))
    both = left.withColumn("in_box", F.lit(True)).join(right.withColumn("in_plays", F.lit(True)), [*KEYS, "player_id"], "full_outer")
    lacks = F.col("in_box").isNull() | F.col("in_plays").isNull()
    agree = ~lacks & F.col("counted")
    for c in ("bf", "so", "bb"):
        agree = agree & (F.col(f"box_{c}") == F.col(f"plays_{c}"))
    signals = []
    for c in PITCHER:
        box, plays, detail = _whole(f"box_{c}"), _whole(f"plays_{c}"), F.lit(None).cast("string")
        if c in SUPPLEMENTED:
            detail = F.when(agree, _json(("boxscore_supplement", F.lit(True)), (f"plays_{c}", plays), (f"boxscore_{c}", box), ("gate", F.lit(GATE))))
            plays = F.when(agree, box).otherwise(plays)
        off = F.lit("AMBIGUOUS") if c in UNCLEAR else F.when(lacks, "UNCORRECTABLE").otherwise("CORRECTABLE")
        signals.append(F.struct(F.lit(f"pitcher_{c}").alias("signal"), box.alias("box"), plays.alias("plays"), F.when(box == plays, "MATCH").otherwise(off).alias("status"), detail.alias("detail")))
    each = both.select(*KEYS, "player_id", F.explode(F.array(*signals)).alias("s"))
    counters = each.select(*_rows(F.col("player_id").cast("string"), F.col("s.signal"), F.lit("pitcher"), F.col("s.box"), F.col("s.plays"), F.col("s.box") - F.col("s.plays"), F.col("s.status"), F.col("s.detail")))

    seen = mine.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("first_play", F.col("player_id").alias("player")))), lambda r: r["player"]).alias("plays_order"))
    text = lambda c: F.coalesce(F.transform(c, lambda p: p.cast("string")), F.array().cast("array<string>"))
    teams = of.select(*KEYS).join(box_order(pitching), KEYS, "left").join(seen, KEYS, "left").select(*KEYS, text("box_order").alias("b"), text("plays_order").alias("p"))
    first = lambda c: F.get(c, F.lit(0))
    starters, same = [first("b"), first("p")], first("b").eqNullSafe(first("p"))
    verdict = lambda ok: F.when(ok, "MATCH").otherwise("CORRECTABLE")
    off = lambda ok: F.when(ok, 0).otherwise(1).cast("bigint")
    starter = teams.filter((F.size("b") > 0) | (F.size("p") > 0)).select(
        *_rows(F.coalesce(*starters), F.lit("pitcher_starter_id"), F.lit("pitcher"), *(s.isNotNull().cast("bigint") for s in starters), off(same), verdict(same), F.when(~same, _json(("boxscore_starter", starters[0]), ("plays_starter", starters[1]))))
    )
    alike = F.col("b") == F.col("p")
    order = teams.select(*_rows(F.coalesce(first("b"), F.lit(WHOLE_GAME)), F.lit("pitcher_order"), F.lit("pitcher"), F.size("b").cast("bigint"), F.size("p").cast("bigint"), off(alike), verdict(alike), F.when(~alike, _json(("boxscore_order", F.col("b")), ("plays_order", F.col("p"))))))
    return counters.union(starter).union(order)


def batter_signals(plays: DataFrame, of: DataFrame, batting: DataFrame) -> DataFrame:
    """Five counters for each batter of either side; plays cannot say which side errs."""
    hits = plays.filter("batter_id is not null").join(of.select(*KEYS, F.col("batting_half").alias("half")), ["game_id", "perspective_team_id", "half"])
    outcome = F.col("outcome")
    sums = {"ab": ~F.coalesce(outcome.isin(*NO_AT_BAT), F.lit(False)), "h": outcome.isin(*HITS), "so": outcome.isin(*STRIKEOUTS), "bb": outcome.isin(*WALKS), "hbp": outcome.isin(*HIT_BATTERS)}
    right = hits.groupBy(*KEYS, F.col("batter_id").alias("player_id")).agg(*(_count(c).alias(f"plays_{n}") for n, c in sums.items()))
    left = batting.join(of.select(*KEYS), KEYS, "left_semi").select(*KEYS, "player_id", *(F.col(c).alias(f"box_{c}") for c in BATTER))
    both = left.join(right, [*KEYS, "player_id"], "full_outer")
    signals = F.array(*(F.struct(F.lit(f"batter_{c}").alias("signal"), _whole(f"box_{c}").alias("box"), _whole(f"plays_{c}").alias("plays")) for c in BATTER))
    each = both.select(*KEYS, "player_id", F.explode(signals).alias("s"))
    delta = F.col("s.box") - F.col("s.plays")
    return each.select(*_rows(F.col("player_id").cast("string"), F.col("s.signal"), F.lit("batter"), F.col("s.box"), F.col("s.plays"), delta, F.when(delta == 0, "MATCH").otherwise("AMBIGUOUS"), F.lit(None).cast("string")))


def game_signals(plays: DataFrame, of: DataFrame, pitching: DataFrame, batting: DataFrame) -> DataFrame:
    """Per team: whether appearances and scores are there, and the hits of both sides."""
    faced = pitching.groupBy(*KEYS).agg(F.sum(_whole("bf")).alias("faced"))
    made = batting.groupBy(*KEYS).agg(F.sum(_whole("h")).alias("box_hits"))
    hits = plays.groupBy("game_id", "perspective_team_id", F.col("half").alias("batting_half")).agg(_count(F.col("outcome").isin(*HITS)).alias("plays_hits"))
    rows = of.join(faced, KEYS, "left").join(made, KEYS, "left").join(hits, ["game_id", "perspective_team_id", "batting_half"], "left")
    one = lambda name, there, box, plays: F.when(there, F.struct(F.lit(name).alias("signal"), box.alias("box"), plays.alias("plays")))
    score = F.col("score").cast("bigint")
    signals = F.array_compact(F.array(one("game_pa_count", _whole("faced") > 0, F.col("faced"), F.col("faced")), one("game_runs", F.col("scored"), score, score), one("game_hits", F.lit(True), _whole("box_hits"), _whole("plays_hits"))))
    each = rows.select(*KEYS, F.explode(signals).alias("s"))
    delta = F.col("s.box") - F.col("s.plays")
    return each.select(*_rows(F.lit(WHOLE_GAME), F.col("s.signal"), F.lit("game_level"), F.col("s.box"), F.col("s.plays"), delta, F.when(delta == 0, "MATCH").otherwise("AMBIGUOUS"), F.lit(None).cast("string")))


def corrected(thrown: DataFrame, of: DataFrame, pitching: DataFrame) -> DataFrame:
    """thrown with old_pitcher_id, and pitcher_id by the batters that the box score's pitchers faced, in order.

    A team's plays are left alone unless its pitchers are two or more, none twice, and faced as many batters as it has plays.
    A team's pitchers in a game are an array of bounds, so a play finds its own without a range join.
    """
    last = Window.partitionBy(*KEYS, "player_id").orderBy(F.desc("seq"))
    lines = pitching.withColumn("bf", F.first(_whole("bf")).over(last))  # of rows for one pitcher the last one counts
    place = Window.partitionBy(*KEYS).orderBy(F.col("appearance_order").asc_nulls_last(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    bounds = lines.withColumn("last", F.sum("bf").over(place)).groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.when(F.col("bf") > 0, F.struct("last", "player_id")))).alias("bounds"), F.sum("bf").alias("faced"), F.count(F.lit(1)).alias("pitchers"), F.count_distinct("player_id").alias("different")
    )
    team = Window.partitionBy(*KEYS)
    rows = thrown.withColumns({"_n": F.row_number().over(team.orderBy("play_order")), "_plays": F.count(F.lit(1)).over(team)}).join(bounds, KEYS, "left")
    fits = (F.col("pitchers") > 1) & (F.col("pitchers") == F.col("different")) & (F.col("faced") == F.col("_plays"))
    given = F.get(F.filter("bounds", lambda b: b["last"] >= F.col("_n")), F.lit(0))["player_id"]
    return rows.withColumns({"old_pitcher_id": F.col("pitcher_id"), "pitcher_id": F.when(fits, given).otherwise(F.col("pitcher_id"))}).drop("_n", "_plays", "bounds", "faced", "pitchers", "different")


def corrections(moved: DataFrame) -> DataFrame:
    """The plays that `corrected` gave to another pitcher."""
    changed = ~F.col("pitcher_id").eqNullSafe(F.col("old_pitcher_id"))
    return moved.filter(changed).select(*KEYS, "half", "play_order", "old_pitcher_id", F.col("pitcher_id").alias("new_pitcher_id"))


def detected(plays: DataFrame, games: DataFrame, pitching: DataFrame, batting: DataFrame) -> DataFrame:
    """All signals as they are; nothing is corrected."""
    of = sides(plays, games)
    return pitcher_signals(_thrown(plays, of), of, pitching).union(batter_signals(plays, of, batting)).union(game_signals(plays, of, pitching, batting))


def executed(plays: DataFrame, games: DataFrame, pitching: DataFrame, batting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All signals after correction, with the status before (pre_status), and the corrections.

    Only pitchers' signals depend on who pitched, so only those are derived twice. A signal that the correction brought to
    agree says so, and lists the game's corrections.
    """
    of = sides(plays, games)
    thrown = _thrown(plays, of)
    moved = corrected(thrown, of, pitching)
    changes = corrections(moved)
    one = F.struct((F.col("half") != "top").alias("late"), "play_order", F.struct("play_order", F.col("old_pitcher_id").cast("string").alias("old_pitcher_id"), F.col("new_pitcher_id").cast("string").alias("new_pitcher_id")).alias("change"))
    listed = changes.groupBy("game_id", "perspective_team_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["change"]).alias("changes"))  # a game's own; home's pitchers throw in the top half
    listed = listed.select("game_id", "perspective_team_id", F.to_json("changes", {"ignoreNullFields": "false"}).alias("changes"))
    key = [*KEYS, "player_id", "signal_name"]
    before = pitcher_signals(thrown, of, pitching).select(*key, F.col("status").alias("pre_status"))
    after = pitcher_signals(moved, of, pitching).join(before, key, "left").join(listed, ["game_id", "perspective_team_id"], "left")
    mended = (F.col("status") == "MATCH") & F.coalesce(F.col("pre_status") == "CORRECTABLE", F.lit(False))
    detail = F.col("correction_detail")
    joined = F.when(F.col("changes").isNull(), detail).when(detail.isNull(), F.col("changes")).otherwise(F.concat(F.expr("left(correction_detail, length(correction_detail) - 1)"), F.lit(',"reassignments":'), F.col("changes"), F.lit("}")))
    pitchers = after.withColumns({"status": F.when(mended, "CORRECTED").otherwise(F.col("status")), "correction_detail": F.when(mended, joined).otherwise(detail)}).drop("changes")
    others = batter_signals(plays, of, batting).union(game_signals(plays, of, pitching, batting)).withColumn("pre_status", F.col("status"))
    return pitchers.unionByName(others), changes


def by_game(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Per game and perspective: signals, plays given to others, and how it stands."""
    pair = ["game_id", "perspective_team_id"]
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    sums = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("signals"), (F.min((F.col("status") == "MATCH").cast("int")) == 1).alias("all_match"), has("CORRECTABLE").alias("correctable"), has("AMBIGUOUS").alias("ambiguous"))
    moved = changes.groupBy(*pair).agg(F.count(F.lit(1)).alias("reassigned"))
    return sums.join(moved, pair, "left").withColumn("reassigned", F.coalesce("reassigned", F.lit(0)))


def run_totals(plays: DataFrame, rows: DataFrame, changes: DataFrame) -> DataFrame:
    """One row for a run over all games and perspectives with plays."""
    seen = plays.select("game_id", "perspective_team_id").distinct()
    each = seen.join(by_game(rows, changes), ["game_id", "perspective_team_id"], "left")
    done = F.col("signals").isNotNull()
    return each.agg(
        _count(done).alias("games_processed"), _count(~done).alias("games_skipped"), _count(F.col("all_match")).alias("games_all_match"), _count(F.col("correctable")).alias("games_with_correctable"),
        _count(F.col("ambiguous")).alias("games_with_ambiguous"), _count(F.col("reassigned") > 0).alias("games_corrected"), _count(F.col("reassigned") == 0).alias("games_unchanged"), F.coalesce(F.sum("reassigned"), F.lit(0)).alias("plays_reassigned"),
    )


def signal_counts(rows: DataFrame) -> DataFrame:
    """How many of each signal had and have each status."""
    return rows.groupBy("category", "signal_name", "pre_status", "status").agg(F.count(F.lit(1)).alias("n"))


def latest_counts(kept: DataFrame) -> DataFrame:
    """Over the rows of many runs (created_at, ingest_seq): the status that each signal had last, counted; a signal is told
    by game, team and player, from whatever perspective."""
    key = ["game_id", "team_id", "player_id", "category", "signal_name"]
    last = F.max_by("status", F.struct("created_at", "ingest_seq")).alias("status")
    # a signal's rows come from different perspectives and runs, so none meet before the shuffle: sorting them there first is in vain
    rows = kept.select(*key, "status", "created_at", "ingest_seq").repartition(*key).groupBy(*key).agg(last)
    return rows.groupBy("category", "signal_name", "status").agg(F.count(F.lit(1)).alias("n"))
