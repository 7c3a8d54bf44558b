import json

import pytest

from scoutlake.operators import plays
from scoutlake.sources import feeds

A, B, P, Q = (f"{c * 8}-0000-0000-0000-{'0' * 12}" for c in "abcd")


@pytest.fixture
def put(tmp_path):
    def write(name, doc):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(doc if isinstance(doc, str) else json.dumps(doc))
        return str(f)

    return write


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_rosters_and_broken_files(spark, put, tmp_path):
    put("teams/t1/roster.json", [{"id": "p1", "first_name": "Al", "last_name": "X", "number": "7"}, {"first_name": "no id"}])
    put("teams/t2/roster.json", "{not json")
    found = feeds.rosters(spark, f"{tmp_path}/teams/*/roster.json")
    assert rows(found, "player_id", "jersey_number", "position") == [("p1", "7", None)]
    assert rows(found.select(feeds.team_of_path(found["file"]).alias("t")), "t") == [("t1",)]
    assert feeds.broken_files(spark, f"{tmp_path}/teams/*/roster.json").count() == 1


def test_schedule_keeps_games_only(spark, put):
    event = {"id": "g1", "event_type": "game", "status": "scheduled", "start": {"datetime": "2026-04-01T18:00:00Z"}}
    path = put("schedule.json", [{"event": event, "pregame_data": {"opponent_id": "o", "opponent_name": "N"}}, {"event": event | {"status": "canceled"}, "pregame_data": {}}, {"event": event | {"event_type": "practice"}, "pregame_data": {}}, {"event": event}])
    assert rows(feeds.schedule(spark, path).selectExpr("game_id", "string(game_date) as d"), "game_id", "d") == [("g1", "2026-04-01")]


def test_box_score_lines(spark, put):
    box = {"slug": {"players": [{"id": A, "first_name": "Al", "last_name": "X", "number": "3"}], "groups": [
        {"category": "lineup", "stats": [{"player_id": A, "stats": {"AB": 4, "H": 2}}], "extra": [{"stat_name": "2B", "stats": [{"player_id": A, "value": 1}]}]},
        {"category": "pitching", "stats": [{"player_id": P, "stats": {"IP": 5, "SO": 3}}, {"player_id": Q, "stats": {"IP": 3.3333333333333335}}], "extra": [{"stat_name": "#P", "stats": [{"player_id": P, "value": 61}]}]},
    ]}}
    path = put("g1.json", box)
    assert rows(feeds.batting_lines(spark, path), "player_id", "ab", "h", "doubles", "hr", "shf", "e") == [(A, 4, 2, 1, 0, None, None)]
    assert rows(feeds.pitching_lines(spark, path), "player_id", "appearance_order", "ip_outs", "so", "pitches", "wp") == [(P, 1, 15, 3, 61, 0), (Q, 2, 10, None, None, 0)]
    assert rows(feeds.box_players(spark, path), "team_key", "player_id", "jersey_number") == [("slug", A, "3")]


def play(name, details, final, half="top", inning=1):
    return {"inning": inning, "half": half, "name_template": {"template": name}, "at_plate_details": [{"template": t} for t in details], "final_details": [{"template": t} for t in final]}


def test_plays_fold(spark, put):
    told = [
        play("Strikeout", ["Strike 1 looking", "Strike 2 looking", "Ball 1", "Foul", "Ball 2", "Strike 3 swinging"], [f"${{{A}}} strikes out"]),
        play("Single", [f"Lineup changed: ${{{P}}} in at pitcher", "Ball 1", "In play"], [f"${{{B}}} singles on a line drive"]),
        play("Walk", ["Ball 1", f"${{{Q}}} in for pitcher ${{{P}}}", "Ball 2"], [f"${{{A}}} walks, ${{{Q}}} pitching"]),
        play("Runner Out", [], [f"${{{A}}} out"]),
        play("Fly Out", ["In play"], [f"${{{B}}} flies out"]),
        play("Double", ["Ball 1"], []),
    ]
    path = put("g1.json", {"sport": "x", "plays": [t | {"order": i} for i, t in enumerate(told)]})
    from pyspark.sql import functions as F

    games = feeds.games_with_plays(spark, path).withColumns({"home_team_id": F.lit(1).cast("bigint"), "away_team_id": F.lit(2).cast("bigint")})
    found = rows(plays.parsed(games), "play_order", "batter_id", "pitcher_id", "outcome", "pitch_count", "is_first_pitch_strike", "is_qab", "batting_team_id")
    assert found == [
        (0, A, P, "Strikeout", 6, 1, 1, 2),  # nobody was named before: the half's first known pitcher
        (1, B, P, "Single", 2, 0, 1, 2),
        (2, A, P, "Walk", 2, 0, 1, 2),  # changed within the appearance: the pitcher of the first pitch
        (4, B, Q, "Fly Out", 1, 1, 0, 2),
    ]


def test_plays_chain_to_reconciliation(spark, put):
    """Feed, fold, pitchers' counters, box score: scores, outs, strikes and own order numbers come through; nulls stop nothing."""
    from pyspark.sql import functions as F

    told = [
        play("Strikeout", ["Strike 1 looking", "Foul", "Strike 3 swinging"], [f"${{{A}}} strikes out, ${{{P}}} pitching"]) | {"order": 7, "did_outs_change": True, "outs": 1},
        play("Single", [f"${{{B}}} in for batter", "Ball 1", f"${{{B}}} steals 2nd", "In play"], [f"${{{B}}} singles"]) | {"order": 9, "home_score": 2, "did_score_change": True},
        {"order": 10, "inning": 1, "half": "top", "name_template": None, "at_plate_details": None, "final_details": [{"template": f"${{{A}}} x"}, None]},
        {"order": 11, "half": "top", "name_template": {"template": "Walk"}, "final_details": None},
    ]
    games = feeds.games_with_plays(spark, put("g7.json", {"plays": told})).withColumns({c: F.lit(i).cast("bigint") for i, c in enumerate(("home_team_id", "away_team_id", "perspective_team_id"), 1)})
    found = plays.parsed(games.unionByName(games.withColumns({"game_id": F.lit("none"), "plays": F.lit(None).cast(games.schema["plays"].dataType)})))
    assert rows(found, "play_order", "outcome", "did_outs_change", "outs_after", "home_score", "did_score_change", "strikes", "pitcher_id") == [(7, "Strikeout", 1, 1, 0, 0, 3, P), (9, "Single", 0, 0, 2, 1, 1, P), (10, "", 0, 0, 0, 0, 0, P)]
    events = plays.play_events(found)
    assert rows(events.filter("play_order = 9"), "event_order", "event_type", "pitch_result", "is_first_pitch") == [(0, "other", None, 0), (1, "pitch", "ball", 1), (2, "baserunner", None, 0), (3, "pitch", "in_play", 0)]
    derived = plays.plays_by_pitcher(found)
    box = spark.createDataFrame([("g7", 3, P, 3, 1, 1, 0, 0, 1, 5, 4)], "game_id string, perspective_team_id bigint, player_id string, bf bigint, ip_outs bigint, so bigint, bb bigint, hbp bigint, h bigint, pitches bigint, total_strikes bigint")
    assert rows(plays.reconciled(box, derived, ["game_id", "perspective_team_id", "player_id"], plays.SIGNALS).filter("status <> 'MATCH'"), "signal") == []


def test_balls_and_season(spark, put):
    ball = lambda i, d: {"id": i, "createdAt": 5, "attributes": {"playResult": "single", "playType": "line_drive", "defenders": d}}
    path = put("s.json", {"spray_chart_data": {"offense": {A: [ball("1", [{"position": "CF", "location": {"x": 1.0, "y": 2.0}}]), ball("2", []), ball("3", [{"position": "CF"}])]}, "defense": {}}})
    assert rows(feeds.batted_balls(spark, path), "event_id", "x", "fielder_position") == [("1", 1.0, "CF"), ("2", None, None)]
    path = put("st.json", {"stats_data": {"players": {A: {"stats": {"offense": {"AB": 3}, "defense": {"GP:P": 1}}}, B: {"stats": {"offense": {"AB": 1}}}}}})
    assert rows(feeds.season_stats(spark, path), "player_id", "is_pitcher") == [(A, True), (B, False)]


def test_parsed_games_are_handed_on_a_few_at_a_time(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(plays, "ROWS_AT_ONCE", 7)
    part = lambda s: F.struct(F.lit(s).alias("template"))
    final = F.array(part("${00000000-0000-0000-0000-000000000001} grounds out"))
    one = lambda n: F.struct(F.lit(n).alias("order"), F.lit(1).alias("inning"), F.lit("top").alias("half"), part("Ground Out").alias("name_template"), F.array(part("Ball 1"), part("In play")).alias("at_plate_details"), final.alias("final_details"))
    games = spark.range(20).coalesce(1).select(F.col("id").cast("string").alias("game_id"), F.lit(1).alias("home_team_id"), F.lit(2).alias("away_team_id"), F.array(*map(one, range(5))).alias("plays"))
    found = plays.parsed(games)
    assert sorted((int(r["game_id"]), r["play_order"]) for r in found.collect()) == [(g, n) for g in range(20) for n in range(5)]
