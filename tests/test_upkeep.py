"""Removal, loads of batted balls, and what a page lists, on small tables."""

from pyspark.sql import functions as F

from scoutlake.operators import links, removal, spray


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_a_removed_team_leaves_what_others_saw(spark):
    make = lambda data, schema: spark.createDataFrame(data, schema)
    plays = make([("g1", 1, 1, 1), ("g1", 1, 2, 1), ("g1", 2, 2, 2), ("g2", 1, 1, 9), ("g3", 1, 1, 1)], "game_id string, play_order bigint, perspective_team_id bigint, batting_team_id bigint")
    snapshot = {
        "teams": make([(1, "tracked"), (2, "member"), (3, "tracked"), (9, "tracked")], "id bigint, membership_type string"),
        "games": make([("g1", 1, 2), ("g2", 1, 9), ("g3", 3, 9)], "game_id string, home_team_id bigint, away_team_id bigint"),
        "plays": plays,
        "events": plays.select("game_id", "play_order", "perspective_team_id", F.lit(0).alias("event_order")),
        "perspectives": plays.select("game_id", "perspective_team_id").distinct(),
        "links": make([(1, 1, 2, "auto", "t"), (2, 2, 1, "manual", "t"), (3, 2, None, None, None)], "id bigint, our_team_id bigint, resolved_team_id bigint, resolution_method string, resolved_at string"),
        "rosters": make([(1, "p"), (2, "p")], "team_id bigint, player_id string"),
        "opponents": make([(1, 2), (2, 1), (2, 3)], "our_team_id bigint, opponent_team_id bigint"),
    }
    out = removal.without_teams(snapshot, make([(1,), (1,), (77,)], "id bigint"))
    assert rows(out["plays"], "game_id", "play_order", "perspective_team_id") == [("g1", 2, 2)]  # batted by 1 is gone, seen by whomever
    assert rows(out["events"], "game_id", "play_order", "perspective_team_id") == [("g1", 2, 2)]
    assert rows(out["games"], "game_id") == [("g1",), ("g3",)]  # g2 has no perspective left; g3 is not theirs
    assert rows(out["links"], "id", "resolved_team_id", "resolution_method") == [(2, None, None), (3, None, None)]
    assert rows(out["rosters"], "team_id") == [(2,)] and rows(out["opponents"], "our_team_id", "opponent_team_id") == [(2, 3)]
    assert rows(out["teams"], "id") == [(1,), (2,), (3,), (9,)]  # g1 still names it
    assert rows(removal.without_teams(snapshot | {"perspectives": snapshot["perspectives"].filter("perspective_team_id = 1")}, make([(1,)], "id bigint"))["teams"], "id") == [(2,), (3,), (9,)]


def test_report_goes_first(spark):
    make = lambda data, schema: spark.createDataFrame(data, schema)
    snapshot = {
        "teams": make([(1, "tracked"), (2, "tracked"), (3, "tracked")], "id bigint, membership_type string"),
        "reports": make([("a", 1), ("b", 2), ("c", 2)], "slug string, team_id bigint"),
        "links": make([], "id bigint, our_team_id bigint, resolved_team_id bigint, resolution_method string, resolved_at string"),
        "access": make([], "user_id bigint, team_id bigint"),
        "games": make([], "game_id string, home_team_id bigint, away_team_id bigint"),
        "perspectives": make([], "game_id string, perspective_team_id bigint"),
    }
    out, gone = removal.without_reports(snapshot, make([("a",), ("b",), ("z",)], "slug string"))
    assert rows(out["reports"], "slug") == [("c",)] and rows(gone, "id") == [(1,)] and rows(out["teams"], "id") == [(2,), (3,)]


def test_batted_balls(spark):
    schema = "seq bigint, game_id string, gc_uuid string, season_id bigint, section string, player_id string, event_id string, created_at_ms bigint, play_result string, play_type string, fielded boolean, x double, y double, fielder_position string, error bigint"
    ball = lambda seq, player, event, section="offense", fielded=True, x=1.0, game="g", uuid="u1": (seq, game, uuid, 1, section, player, event, 0, "single", None, fielded, x, 2.0, "SS", None)
    events = spark.createDataFrame([ball(1, "h", "e1"), ball(2, "a", "e2", "defense"), ball(3, "both", "e3"), ball(4, "who", "e4"), ball(5, "h", ""), ball(6, "h", "e5", x=None), ball(7, "h", "e6", fielded=False, x=None), ball(0, "a", "e1", "defense"), ball(8, "h", "old"), ball(9, "h", "e9", game="before"), ball(10, "h", "e9", game="none"), ball(11, "h", "e9", uuid="?")], schema)
    teams = spark.createDataFrame([("u1", 1), ("u2", 2)], "gc_uuid string, id bigint")
    games = spark.createDataFrame([("g", 1, 2), ("before", 1, 2)], "game_id string, home_team_id bigint, away_team_id bigint")
    rosters = spark.createDataFrame([("h", 1, 1), ("a", 2, 1), ("both", 2, 1), ("both", 1, 1), ("who", 1, 7)], "player_id string, team_id bigint, season_id bigint")
    old = spark.createDataFrame([("before", 1, "x"), ("other", 1, "old")], "game_id string, perspective_team_id bigint, event_id string")
    made, counts = spray.load(events, teams, games, rosters, old)
    assert rows(made, "event_id", "team_id", "chart_type", "x") == [("e1", 1, "offensive", 1.0), ("e2", 2, "defensive", 1.0), ("e3", 1, "offensive", 1.0), ("e4", 2, "offensive", 1.0), ("e6", 1, "offensive", None)]
    assert rows(counts, "game_id", "loaded", "skipped") == [("before", 0, 1), ("g", 5, 4)]
    made, counts = spray.load(events, teams, games, rosters, old, guess=False)
    assert "e4" not in [r[0] for r in rows(made, "event_id")] and ("g", 4, 5) in rows(counts, "game_id", "loaded", "skipped")
    assert spray.load(events.limit(0), teams, games, rosters, old)[1].collect() == []


def test_filters_not_allowed_are_as_if_not_given(spark):
    df = spark.createDataFrame([(1, 1, 5, "b", "x", "m", 0), (2, 1, None, "a", None, None, 0), (3, 2, 6, "c", "y", "m", 0), (4, 1, 5, "d", "z", "m", 1)], "id bigint, our_team_id bigint, resolved_team_id bigint, opponent_name string, resolved_at string, resolution_method string, is_hidden bigint")
    lines = spark.createDataFrame([(5,), (5,)], "team_id bigint")
    got = lambda *a, **k: rows(links.listed_links(df, lines, *a, **k), "id", "nth")
    assert got() == got("1 = 1", order="; drop table") == [(1, 2), (2, 1), (3, 1)]
    assert got("hidden") == [(4, 1)] and got("unresolved") == [(2, 1)] and got("full") == [(1, 1)] and got("all", our_team=2) == [(3, 1)]
    assert got(order="resolved", descending=True) == [(1, 1), (2, 2), (3, 1)]
