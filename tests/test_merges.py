"""Merges on small tables with chains, collisions and nulls."""

from pyspark.sql import functions as F

from scoutlake.operators import merges


def names_of(spark, *pairs):
    return merges.final_names(spark.createDataFrame(pairs, "duplicate_id string, canonical_id string"))


def test_chains_end(spark):
    names = names_of(spark, ("d", "c"), ("c", "b"), ("b", "a"), ("x", "x"), ("y", "q"), ("y", "p"))
    assert sorted(map(tuple, names.collect())) == [("b", "a"), ("c", "a"), ("d", "a"), ("y", "p")]
    assert names_of(spark, ("x", "x")).collect() == []


def test_the_more_complete_row_stays_then_the_canonical_one(spark):
    rows = [("g1", "a", 1, "boxscore_only", 1), ("g1", "b", 1, "full", 2), ("g2", "a", 1, "supplemented", 3), ("g2", "b", 1, "supplemented", 4), ("g2", "b", 2, None, 5), ("g3", "c", 1, None, 6), ("g3", "b", 1, None, 7), ("g4", "z", 1, "full", 8), (None, "b", 1, "full", 9), (None, "a", 1, "full", 10)]
    lines = spark.createDataFrame(rows, "game_id string, player_id string, perspective_team_id bigint, stat_completeness string, n bigint")
    got = merges.rewritten(lines, names_of(spark, ("b", "a"), ("c", "a")), merges.PLAYER_RULES["batting"])
    assert got.columns == lines.columns
    assert sorted((r["n"], r["player_id"]) for r in got.collect()) == [(2, "a"), (3, "a"), (5, "a"), (7, "a"), (8, "z"), (9, "a"), (10, "a")]


def test_only_affected_seasons_are_made_anew(spark):
    games = spark.createDataFrame([("g1", 2024), ("g2", 2024), ("g3", 2025)], "game_id string, season_id bigint")
    stat = lambda *head: (*head, "full", *([1] * len(merges.BATTING)))
    lines = spark.createDataFrame([stat("g1", "a", 1, 1), stat("g2", "b", 1, 1), stat("g2", "b", 1, 2), stat("g3", "z", 1, 1)], "game_id string, player_id string, team_id bigint, perspective_team_id bigint, stat_completeness string, " + ", ".join(f"{c} bigint" for c in merges.BATTING))
    season = merges.season_batting(lines.join(games, "game_id")).withColumn("games_tracked", F.lit(99).cast("bigint"))
    season = season.unionByName(season.filter("player_id = 'a'").withColumn("season_id", F.lit(1999).cast("bigint")))
    pitching = lines.limit(0).select("game_id", "player_id", "team_id", "perspective_team_id", "stat_completeness").withColumns({c: F.lit(0).cast("bigint") for c in merges.PITCHING}).withColumn("decision", F.lit("W"))
    snapshot = {"games": games, "batting": lines, "pitching": pitching, "season_batting": season, "season_pitching": merges.season_pitching(pitching.join(games, "game_id"))}
    names = names_of(spark, ("b", "a"))
    assert sorted(map(tuple, merges.affected_seasons(snapshot, names).collect())) == [("a", 1, 1999), ("a", 1, 2024)]
    after = {(r["player_id"], r["season_id"]): r for r in merges.merge_players(snapshot, names)["season_batting"].collect()}
    assert set(after) == {("a", 2024), ("z", 2025)}  # 1999 has no game rows
    assert after["a", 2024]["games_tracked"] == 2 and after["a", 2024]["pa"] == 8 and after["a", 2024]["singles"] == -4
    assert after["z", 2025]["games_tracked"] == 99  # left as it was


def test_players_take_the_best_names(spark):
    rows = [("a", "Jo", None), ("b", "Joan", "Unknown"), ("c", "Unknown", "Li"), ("z", "Unknown", None)]
    snapshot = {"players": spark.createDataFrame(rows, "player_id string, first_name string, last_name string")}
    none = spark.createDataFrame([], "game_id string, player_id string, team_id bigint, perspective_team_id bigint, season_id bigint, decision string")
    for t in ("batting", "pitching"):
        snapshot[t] = none.withColumns({c: F.lit(0).cast("bigint") for c in {*merges.BATTING, *merges.PITCHING}}).withColumn("stat_completeness", F.lit("full")).drop("season_id")
    snapshot |= {"games": none.select("game_id", "season_id"), "season_batting": merges.season_batting(snapshot["batting"].withColumn("season_id", F.lit(1).cast("bigint"))), "season_pitching": merges.season_pitching(snapshot["pitching"].withColumn("season_id", F.lit(1).cast("bigint")))}
    out = merges.merge_players(snapshot, names_of(spark, ("b", "a"), ("c", "a")))["players"]
    assert sorted(map(tuple, out.collect())) == [("a", "Joan", "Li"), ("z", "Unknown", None)]


def test_discrepancies_of_the_whole_game_stay(spark):
    key = ["run_id", "game_id", "perspective_team_id", "team_id", "player_id", "signal_name"]
    rows = [("r", "g", 1, 1, "a", "s", 1), ("r", "g", 1, 1, "b", "s", 2), ("r", "g", 2, 1, "b", "s", 3), ("r", "g", 1, 1, "__game__", "s", 4)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if 'team' in c else 'string'}" for c in key) + ", n bigint")
    got = merges.rewritten(df, names_of(spark, ("b", "a")), merges.PLAYER_RULES["discrepancies"])
    assert sorted((r["n"], r["player_id"]) for r in got.collect()) == [(1, "a"), (3, "a"), (4, "__game__")]


def test_teams(spark):
    teams = spark.createDataFrame([(1, None, "s1", "member"), (2, "u2", "s2", "tracked"), (3, "u3", None, "tracked"), (4, None, None, "member")], "id bigint, gc_uuid string, public_id string, membership_type string")
    opponents = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (2, 5), (1, 5), (5, 3), (6, 2), (7, 7)], "our_team_id bigint, opponent_team_id bigint")
    balls = spark.createDataFrame([(None, 2, 2), (None, 1, 1), ("e", 2, 2), ("e", 1, 1), ("f", 5, 3)], "event_id string, team_id bigint, perspective_team_id bigint")
    pairs = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (9, 1), (1, 8), (5, 5)], "duplicate_id bigint, canonical_id bigint")
    out, refused = merges.merge_teams({"teams": teams, "opponents": opponents, "balls": balls}, pairs)
    assert {r["duplicate_id"]: r["reason"] for r in refused.collect()} == {4: "duplicate is a member", 9: "no duplicate team", 1: "no canonical team", 5: "same team"}
    assert sorted(map(tuple, out["teams"].collect())) == [(1, "u2", "s1", "member"), (4, None, None, "member")]
    assert sorted(map(tuple, out["opponents"].collect())) == [(1, 5), (5, 1), (6, 1), (7, 7)]
    assert sorted(map(tuple, out["balls"].collect()), key=str) == [("e", 1, 1), ("f", 5, 1), (None, 1, 1), (None, 1, 1)]


def test_preview(spark):
    plays = spark.createDataFrame([("b", "b"), ("a", "b"), (None, "z")], "batter_id string, pitcher_id string")
    got = merges.preview({"plays": plays}, names_of(spark, ("b", "a"), ("q", "a")), merges.PLAYER_RULES)
    assert list(map(tuple, got.collect())) == [("b", "plays", 3)]


def test_pairs_of_players_are_found_once_and_not_shuffled(spark):
    from scoutlake.operators import identity

    rows = [(1, 1, 1, "Jo", "X", 5), (1, 1, 2, "joan", "x", 5), (1, 1, 3, "Jo", "x", 9), (1, 1, 4, "Jo", "x", 1), (1, 1, 4, "JO", "X", 1), (1, 1, 5, "Al", "y", 1), (1, 1, 5, "Alf", "y", 1), (1, 1, 6, "A", "y", 1)]
    found = identity.duplicate_players(spark.createDataFrame(rows, "team_id int, season_id int, player_id int, first_name string, last_name string, stat_rows bigint"))
    assert sorted((r[2], r[3]) for r in found.collect()) == [(1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 4), (5, 6)]
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # pairs of players listed once pass no aggregation
