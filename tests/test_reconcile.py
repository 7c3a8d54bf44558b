"""Reconciliation on games made by hand."""

import json

import pytest

from scoutlake.operators import reconcile

PLAYS = "game_id string, perspective_team_id bigint, play_order bigint, half string, batter_id string, pitcher_id string, outcome string, pitch_count bigint, did_outs_change bigint, strikes bigint, wild_pitches bigint"
GAMES = "game_id string, home_team_id bigint, away_team_id bigint, home_score bigint, away_score bigint"
PITCHING = "game_id string, perspective_team_id bigint, team_id bigint, player_id string, appearance_order bigint, bf bigint, ip_outs bigint, so bigint, bb bigint, hbp bigint, h bigint, pitches bigint, total_strikes bigint, wp bigint, seq bigint"
BATTING = "game_id string, perspective_team_id bigint, team_id bigint, player_id string, ab bigint, h bigint, so bigint, bb bigint, hbp bigint"


@pytest.fixture(scope="module")
def tables(spark):
    play = lambda n, half, pitcher, outcome, batter="b": ("g", 1, n, half, batter, pitcher, outcome, 3, int(outcome == "Strikeout"), 2, 0)
    # home (1) pitches in the top half: a faced two, c faced two; the plays give a the third, too
    plays = [play(1, "top", "a", "Single"), play(2, "top", "a", "Strikeout"), play(3, "top", "a", "Walk"), play(4, "top", "c", "Strikeout", None)]
    plays += [play(5, "bottom", None, "Single"), play(6, "bottom", "z", None)]
    plays += [("lost", 1, 1, "top", "b", "a", "Single", 1, 0, 0, 0)]
    pitching = [("g", 1, 1, "c", 2, 2, 1, 1, 1, 0, 0, 6, 4, 0, 1), ("g", 1, 1, "a", 1, 2, 1, 1, 0, 0, 1, 9, None, 1, 2)]
    pitching += [("g", 1, 2, "x", None, 1, 0, 0, 0, 0, 1, None, None, None, 5), ("g", 1, 2, "y", None, 1, 0, 0, 0, 0, None, None, None, None, 4), ("g", 1, 2, "x", None, 0, 0, 0, 0, 0, 0, 1, 1, 0, 9)]
    pitching += [("g", 8, 1, "a", 1, 2, 1, 1, 0, 0, 1, 9, None, 1, 2)]
    batting = [("g", 1, 2, "b", 3, 1, 1, None, 0), ("g", 1, 1, "q", 0, 1, 0, 0, 0)]
    games = [("g", 1, 2, 3, None)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return make(plays, PLAYS), make(games, GAMES), make(pitching, PITCHING), make(batting, BATTING)


def by_signal(df):
    return {(r["team_id"], r["player_id"], r["signal_name"]): r for r in df.collect()}


def test_detected(tables):
    rows = by_signal(reconcile.detected(*tables))
    status = lambda *k: rows[k]["status"]
    assert (status(1, "a", "pitcher_bf"), rows[1, "a", "pitcher_bf"]["delta"]) == ("CORRECTABLE", -1)
    assert status(1, "a", "pitcher_wp") == "AMBIGUOUS" and status(1, "a", "pitcher_so") == "MATCH"
    assert status(1, "a", "pitcher_order") == "MATCH" and status(1, "a", "pitcher_starter_id") == "MATCH"
    assert status(2, "z", "pitcher_bf") == "UNCORRECTABLE" and status(2, "z", "pitcher_so") == "MATCH"
    # without places the order is that of insertion, and a pitcher listed again stands there again
    order = rows[2, "y", "pitcher_order"]
    assert (order["boxscore_value"], order["plays_value"], order["status"]) == (3, 1, "CORRECTABLE")
    assert json.loads(order["correction_detail"]) == {"boxscore_order": ["y", "x", "x"], "plays_order": ["z"]}
    assert json.loads(rows[2, "y", "pitcher_starter_id"]["correction_detail"]) == {"boxscore_starter": "y", "plays_starter": "z"}
    assert rows[2, "x", "pitcher_bf"]["boxscore_value"] == 0  # its last row counts
    # batters: an unknown outcome is an at-bat; a null one of the box score is 0; an unknown batter is nobody
    assert rows[2, "b", "batter_ab"]["plays_value"] == 2 and status(2, "b", "batter_ab") == "AMBIGUOUS"
    assert rows[2, "b", "batter_bb"]["plays_value"] == 1 and status(2, "b", "batter_so") == "MATCH"
    assert rows[1, "b", "batter_ab"]["plays_value"] == 2 and status(1, "q", "batter_h") == "AMBIGUOUS"
    assert rows[2, "__game__", "game_hits"]["plays_value"] == 1 and rows[1, "__game__", "game_hits"]["plays_value"] == 1
    assert rows[1, "__game__", "game_pa_count"]["boxscore_value"] == 4 and (1, "__game__", "game_runs") not in rows
    assert {r["game_id"] for r in rows.values()} == {"g"} and {r["perspective_team_id"] for r in rows.values()} == {1}


def test_executed(tables):
    rows, changes = reconcile.executed(*tables)
    assert [tuple(r) for r in changes.collect()] == [("g", 1, 1, "top", 3, "a", "c")]  # the other team's pitcher comes twice
    rows = by_signal(rows)
    moved = [{"play_order": 3, "old_pitcher_id": "a", "new_pitcher_id": "c"}]
    mended = rows[1, "c", "pitcher_bb"]
    assert (mended["status"], mended["pre_status"], json.loads(mended["correction_detail"])) == ("CORRECTED", "CORRECTABLE", moved)
    # the gate opens after the correction: the box score's pitches stand in, and the reason is kept beside the corrections
    pitches = rows[1, "c", "pitcher_total_strikes"]
    assert pitches["status"] == "CORRECTED"
    assert json.loads(pitches["correction_detail"]) == {"boxscore_supplement": True, "plays_total_strikes": 4, "boxscore_total_strikes": 4, "gate": reconcile.GATE, "reassignments": moved}
    assert rows[1, "a", "pitcher_pitches"]["status"] == "CORRECTABLE"  # the box score has no strikes, so its pitches do not stand in
    assert rows[1, "a", "pitcher_so"]["status"] == "MATCH" and rows[1, "a", "pitcher_so"]["pre_status"] == "MATCH"
    assert rows[2, "b", "batter_ab"]["status"] == "AMBIGUOUS"


def test_totals(tables):
    plays, *rest = tables
    out = reconcile.run_totals(plays, *reconcile.executed(plays, *rest)).first().asDict()
    assert out == {"games_processed": 1, "games_skipped": 1, "games_all_match": 0, "games_with_correctable": 1, "games_with_ambiguous": 1, "games_corrected": 1, "games_unchanged": 0, "plays_reassigned": 1}


def test_no_rows(tables):
    none = [t.limit(0) for t in tables]
    rows, changes = reconcile.executed(*none)
    assert rows.collect() == [] and changes.collect() == []
    plays, games, *box = tables
    rows = by_signal(reconcile.detected(plays, games, *(t.limit(0) for t in box)))
    assert rows[1, "__game__", "pitcher_order"]["boxscore_value"] == 0 and rows[1, "a", "pitcher_starter_id"]["status"] == "CORRECTABLE"
    assert (1, "__game__", "game_pa_count") not in rows


def test_event_counts(spark, tables):
    events = spark.createDataFrame([("g", 1, 1, "foul", None), ("g", 1, 1, "ball", None), ("g", 1, 1, None, "Runner scores on Wild Pitch"), ("g", 9, 1, "foul", None)], "game_id string, perspective_team_id bigint, play_order bigint, pitch_result string, template string")
    rows = {r["play_order"]: (r["strikes"], r["wild_pitches"]) for r in reconcile.with_event_counts(tables[0].filter("game_id = 'g'"), events).collect()}
    assert rows[1] == (1, 1) and rows[2] == (0, 0)


def test_signals_of_runs_are_not_sorted_before_they_meet(spark):
    rows = [("g", 1, 1, "p", "pitcher", "pitcher_bf", "CORRECTABLE", 1, 9), ("g", 2, 1, "p", "pitcher", "pitcher_bf", "CORRECTED", 2, 1), ("g", 1, 1, "q", "pitcher", "pitcher_bf", "MATCH", 1, 1), ("g", 2, 1, "q", "pitcher", "pitcher_bf", "AMBIGUOUS", 1, 2)]
    kept = spark.createDataFrame(rows, "game_id string, perspective_team_id bigint, team_id bigint, player_id string, category string, signal_name string, status string, created_at bigint, ingest_seq bigint")
    counts = reconcile.latest_counts(kept)
    assert sorted(map(tuple, counts.collect())) == [("pitcher", "pitcher_bf", "AMBIGUOUS", 1), ("pitcher", "pitcher_bf", "CORRECTED", 1)]
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert "partial_max_by" in plan and "partial_max_by" not in plan[plan.rindex("RepartitionByExpression" if "RepartitionByExpression" in plan else "REPARTITION_BY_COL") :]
