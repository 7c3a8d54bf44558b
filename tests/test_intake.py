"""Small decisions of loads, and whole answers, on tables with nulls and ties."""

import datetime

from pyspark.sql import functions as F

from scoutlake.operators import answers, intake, merges, spray

UUID = "00000000-0000-0000-0000-00000000000"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_box_keys(spark):
    cases = [(["slug", UUID + "1"], None), ([UUID + "1", "slug", "other"], UUID + "9"), ([UUID + "1", UUID + "2"], (UUID + "2").upper()), ([UUID + "1", UUID + "2"], None), ([UUID + "1", UUID + "2"], UUID + "7"), ([UUID + "1"], UUID + "1"), ([], None), ([UUID.upper() + "A", UUID + "1"], None)]
    df = spark.createDataFrame([(i, k, u) for i, (k, u) in enumerate(cases)], "i bigint, keys array<string>, own string")
    got = [tuple(r["k"]) for r in df.orderBy("i").select(intake.box_keys(F.col("keys"), F.col("own")).alias("k")).collect()]
    assert got == [("slug", UUID + "1"), ("slug", UUID + "1"), (UUID + "2", UUID + "1"), (None, UUID + "1"), (None, UUID + "2"), (None, UUID + "1"), (None, None), (UUID.upper() + "A", UUID + "1")]


def test_sides_names_years(spark):
    df = spark.createDataFrame([("home", 1, 2, 5, None), ("away", 1, 2, 5, 3), (None, 1, 2, 5, 3)], "home_away string, own_team_id bigint, opponent_team_id bigint, own_score bigint, opponent_score bigint")
    assert rows(intake.sided(df), "home_team_id", "away_team_id", "home_score", "away_score") == [(1, 2, 5, 3), (1, 2, 5, None), (2, 1, 3, 5)]
    teams = spark.createDataFrame([(1, "Reds", None), (2, "blues", 2024), (3, None, None)], "id bigint, name string, season_year bigint")
    names = spark.createDataFrame([(1, "REDS"), (2, "Greens"), (3, "greens"), (4, None), (5, "Golds")], "seq bigint, name string")
    assert rows(intake.placeholders(names, teams), "name", "membership_type", "is_active") == [("Golds", "tracked", 0), ("Greens", "tracked", 0)]
    assert rows(intake.discovered(names.union(spark.createDataFrame([(6, " Golds "), (7, " ")], names.schema)), "name"), "name") == [("Golds",), ("Greens",), ("REDS",), ("greens",)]
    told = spark.createDataFrame([(1, 2025), (1, None), (2, 2030)], "id bigint, season_year bigint")
    assert rows(intake.years_healed(teams, told), "id", "season_year") == [(1, 2025), (2, 2024), (3, None)]


def test_times_and_rates(spark):
    now = F.lit(datetime.datetime(2024, 2, 28, 12, 0, 0, 5000)).cast("timestamp")
    assert spark.range(1).select(intake.expires(now)).first()[0] == "2024-03-06T12:00:00.005Z"
    runs = spark.createDataFrame([(1, 1, "completed", datetime.datetime(2024, 2, 27, 12, 0, 1)), (1, 1, "failed", datetime.datetime(2024, 2, 28)), (2, 1, "completed", datetime.datetime(2024, 2, 27, 12, 0)), (3, 1, "running", None)], "team_id bigint, season_id bigint, status string, last_checked timestamp")
    assert rows(intake.scouted_lately(runs, now), "team_id", "lately") == [(1, True), (2, False), (3, False)]
    some = spark.createDataFrame([(True,), (False,), (True,), (None,)], "within boolean")
    assert intake.match_rate(some.filter("within is not null")).first()["match_rate"] == 200.0 / 3 and intake.match_rate(some.limit(0)).first()["match_rate"] == 100.0


def test_summaries_of_batted_balls(spark):
    balls = spark.createDataFrame([("p", "home_run", "fly_ball", None, None), ("p", "home_run", "fly_ball", 20.0, 50.0), ("p", None, None, 160.0, 200.0), ("q", "out", "bunt", None, None)], "player_id string, play_result string, play_type string, x double, y double")
    got = {r["player_id"]: r.asDict() for r in spray.summaries(balls, ["player_id"]).collect()}
    assert (got["p"]["bip"], got["p"]["hits"], got["p"]["n_center"], got["p"]["n_left"], got["p"]["n_fb"], got["p"]["charted"]) == (3, 2, 2, 1, 2, True)
    assert (got["q"]["n_bu"], got["q"]["n_center"], got["q"]["charted"]) == (1, 0, False)


def test_answers(spark):
    make = lambda data, schema: spark.createDataFrame(data, schema)
    games = make([("g1", 1, datetime.date(2024, 5, 1), "10", 1, 2, 5, 3), ("g2", 1, datetime.date(2024, 5, 2), None, 2, 1, 4, 4), ("g3", 1, datetime.date(2024, 5, 3), None, 2, 1, None, 4)], "game_id string, season_id bigint, game_date date, start_time string, home_team_id bigint, away_team_id bigint, home_score bigint, away_score bigint")
    players = make([("a", "Unknown", "Unknown"), ("b", "Bo", "Li"), ("c", "Unknown", "Unknown"), ("d", None, "X")], "player_id string, first_name string, last_name string")
    rosters = make([(1, 1, "a", "7"), (1, 1, "c", ""), (1, 0, "a", "8")], "team_id bigint, season_id bigint, player_id string, jersey_number string")
    teams = make([(1, "Us")], "id bigint, name string")
    stat = ", ".join(f"{c} bigint" for c in dict.fromkeys([*merges.BATTING, *merges.PITCHING]))
    n = len(stat.split(", "))
    head = "game_id string, season_id bigint, team_id bigint, perspective_team_id bigint, player_id string, appearance_order bigint, "
    line = lambda g, team, seen, player, order=None, v=1: (g, None, team, seen, player, order, *([v] * n))
    batting = make([line("g1", 1, 1, "b"), line("g1", 1, 1, "a", v=None), line("g1", 1, 2, "c"), line("g1", 2, 9, "d"), line("g1", 2, 7, "d", v=2), line("g1", 1, 1, "nobody")], head + stat)
    pitching = make([line("g1", 1, 1, "b", None), line("g1", 1, 1, "a", 2), line("g2", 1, 1, "a", 1)], head + stat)
    box = {(r["game_id"], r["side"]): r for r in answers.box_scores(games, batting, pitching, players, rosters, teams).collect()}
    assert len(box) == 6 and box["g1", "away"]["team_name"] == "2" and box["g3", "home"]["batting_lines"] is None
    assert [(r["name"], r["name_unresolved"], r["ab"], r["jersey_number"]) for r in box["g1", "home"]["batting_lines"]] == [("Bo Li", False, 1, None), ("Player #7", True, 0, "7")]
    assert [(r["player_id"], r["name"], r["ab"]) for r in box["g1", "away"]["batting_lines"]] == [("d", None, 2)]
    assert [r["player_id"] for r in box["g1", "home"]["pitching_lines"]] == ["a", "b"]
    season = lambda lines, rollup: rollup(lines.withColumns({"season_id": F.lit(1).cast("bigint"), "decision": F.lit("W")}))
    sb, sp = season(batting, merges.season_batting), season(pitching, merges.season_pitching)
    report = answers.scouting_reports(sb, sp, games, players, rosters, teams).collect()
    assert [(r["team_id"], r["team_name"], r["wins"], r["losses"]) for r in report] == [(1, "Us", 1, 0)]
    assert [(r["player_id"], r["avg"]) for r in report[0]["batting"]] == [("b", 1.0), ("a", None)] and [r["games"] for r in report[0]["pitching"]] == [1, 2]
    pages = {r["player_id"]: r for r in answers.player_profiles(players, sb, sp, batting, pitching, games, rosters, teams).collect()}
    assert set(pages) == {"a", "b", "c", "d"} and pages["a"]["jersey_number"] == "7" and pages["d"]["recent_games"] is None
    assert [(r["game_id"], r["appearance_type"], r["opponent_name"]) for r in pages["a"]["recent_games"]] == [("g2", "pitching", None), ("g1", "batting", None), ("g1", "pitching", None)]
    assert [(s["season_id"], s["ab"]) for s in pages["a"]["batting_seasons"]] == [(1, 0)]
