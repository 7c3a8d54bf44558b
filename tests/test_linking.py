"""Links by hand: stubs, merges, rows that move, and links undone."""

import pytest
from pyspark.sql import functions as F

from scoutlake.operators import linking

TEAMS = "id bigint, name string, membership_type string, public_id string, gc_uuid string, season_year bigint, is_active bigint"
LINKS = "id bigint, our_team_id bigint, root_team_id string, opponent_name string, is_hidden bigint, public_id string, resolution_method string, resolved_team_id bigint, resolved_at string"


@pytest.fixture()
def snapshot(spark):
    teams = [(1, "Us", "member", None, None, 2025, 1), (2, "Reds", "tracked", None, None, None, 0), (3, "Reds", "tracked", None, None, None, 0), (4, "Blues", "tracked", "blue", None, 2024, 0), (5, "Greens", "tracked", "g1", None, None, 0), (6, "Greens", "tracked", "g2", None, None, 0), (7, "Reds", "member", None, None, None, 0)]
    links = [(10, 1, "a", "Reds", 0, None, None, None, None), (11, 1, "b", "Blues", 0, "blue", "auto", 4, "t"), (12, 1, "c", "Nobody", 0, None, None, None, None), (13, 1, "d", "Reds", 0, "red", "manual", 2, "t"), (14, 1, "e", "Blues", 0, "blue", "manual", 4, "t")]
    games = [("g1", 2, 1, "s1"), ("g2", 3, 1, "s1"), ("g3", 3, 1, None)]
    return {
        "teams": spark.createDataFrame(teams, TEAMS),
        "links": spark.createDataFrame(links, LINKS),
        "opponents": spark.createDataFrame([(1, 2, 2019), (1, 3, None)], "our_team_id bigint, opponent_team_id bigint, first_seen_year bigint"),
        "games": spark.createDataFrame(games, "game_id string, home_team_id bigint, away_team_id bigint, game_stream_id string"),
        "perspectives": spark.createDataFrame([("g1", 2), ("g1", 3), ("g2", 3)], "game_id string, perspective_team_id bigint"),
    }


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_stubs(spark, snapshot):
    wanted = spark.createDataFrame([(1, "Reds"), (9, "Reds"), (1, "Blues"), (1, "Greens"), (1, "Us")], "our_team_id bigint, opponent_name string")
    got = {(r[0], r[1]): r[2] for r in linking.tracked_stubs(wanted, snapshot["teams"], snapshot["opponents"]).collect()}
    assert got == {(1, "Reds"): 3, (9, "Reds"): 3, (1, "Blues"): 4, (1, "Greens"): None, (1, "Us"): None}


def save(spark, snapshot, *requests):
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], "seq bigint, link_id bigint, public_id string, our_team_id bigint, opponent_name string")
    out, result = linking.save_manual_links(snapshot, asked, F.lit("now"), 2026)
    return out, {r["link_id"]: r.asDict() for r in result.collect()}


def test_a_slug_goes_to_the_stub(spark, snapshot):
    out, result = save(spark, snapshot, (10, "old", 1, "Reds"), (10, "red", 1, "Reds"))
    # the other stub of that name is taken for an old one, and its rows move where their place is free
    assert result[10] == {"link_id": 10, "merged": False, "merged_team_name": None, "resolved_team_id": 3, "old_stub_team_id": 2, "rows_moved": 0, "effective_public_id": "red"}
    assert rows(out["links"].filter("id = 10"), "public_id", "resolution_method", "resolved_team_id", "resolved_at") == [("red", "manual", 3, "now")]
    assert rows(out["teams"].filter("id in (2, 3)"), "id", "public_id", "is_active") == [(2, None, 0), (3, "red", 1)]
    assert rows(out["opponents"], "opponent_team_id", "first_seen_year") == [(3, None)]
    assert rows(out["games"], "game_id", "home_team_id") == [("g1", 2), ("g2", 3), ("g3", 3)]
    assert rows(out["perspectives"], "game_id", "perspective_team_id") == [("g1", 3), ("g2", 3)]


def test_a_slug_of_another_team_merges(spark, snapshot):
    out, result = save(spark, snapshot, (10, "blue", 1, "Reds"))
    assert (result[10]["merged"], result[10]["merged_team_name"], result[10]["resolved_team_id"], result[10]["old_stub_team_id"], result[10]["rows_moved"]) == (True, "Blues", 4, 3, 4)
    assert rows(out["opponents"], "opponent_team_id", "first_seen_year") == [(2, 2019), (4, 2025)]
    assert rows(out["games"], "game_id", "home_team_id") == [("g1", 2), ("g2", 4), ("g3", 4)]
    assert rows(out["perspectives"], "game_id", "perspective_team_id") == [("g1", 2), ("g1", 4), ("g2", 4)]
    assert rows(out["teams"].filter("id = 3"), "public_id") == [(None,)]


def test_without_a_stub_a_team_is_made(spark, snapshot):
    out, result = save(spark, snapshot, (12, "new", 1, "Nobody"), (11, "g1", 1, "Greens"))
    assert (result[12]["resolved_team_id"], result[12]["effective_public_id"], result[11]["resolved_team_id"]) == (8, "new", 5)
    assert rows(out["teams"].filter("id = 8"), "name", "membership_type", "public_id", "is_active") == [("Nobody", "tracked", "new", 1)]
    assert (1, 8, 2025) in rows(out["opponents"], "our_team_id", "opponent_team_id", "first_seen_year")


def test_undone(spark, snapshot):
    out, said = linking.disconnected(snapshot, spark.createDataFrame([(11,), (13,), (14,), (99,)], "id bigint"))
    assert rows(said, "id", "disconnected") == [(11, False), (13, True), (14, True), (99, False)]
    assert rows(out["links"].filter("resolution_method is not null"), "id") == [(11,)]
    # Blues keep their slug, since the automatic link names them; team 2 was named by a merge, as 3 is the stub
    assert rows(out["teams"].filter("id = 4"), "public_id") == [("blue",)]


def test_resolver(spark, snapshot):
    feed = spark.createDataFrame([(1, 1, "a", "Reds!", None, False), (2, 1, "b", "Blues", "u4", False), (3, 1, "e", "Azure", "u4", False), (4, 1, "x", "Hid", "u9", True), (5, 1, "y", "Lost", "u8", False), (6, 1, "z", "Pinks", None, False), (7, 1, "z", "Golds", None, False)], "seq bigint, our_team_id bigint, root_team_id string, name string, progenitor_team_id string, is_hidden boolean")
    details = spark.createDataFrame([("u4", "blue", None, 2025)], "progenitor_team_id string, public_id string, name string, season_year bigint")
    hits = spark.createDataFrame([("Golds", "v1", "gold", "GOLDS", 2025), ("Golds", "v2", "old", "Golds", 2024), ("Reds!", "v3", "r", "reds!", 2025), ("Reds!", "v4", "r2", "Reds!", 2025), ("Nobody", "v5", "n", "Nobody else", 2025)], "query string, gc_uuid string, public_id string, name string, season_year bigint")
    out, log = linking.resolve_opponents(snapshot["links"], feed, details, hits, snapshot["teams"], F.lit("now"), 2026)
    assert dict(rows(log, "root_team_id", "reason")) == {"a": "2 matches", "b": "progenitor, team by slug", "c": "no exact match", "e": "manual link kept", "x": "hidden", "y": "no details", "z": "one match, team by new"}
    got = {r["root_team_id"]: (r["opponent_name"], r["resolution_method"], r["resolved_team_id"], r["public_id"]) for r in out.collect()}
    assert got == {"a": ("Reds!", None, None, None), "b": ("Blues", "auto", 4, "blue"), "c": ("Nobody", None, None, None), "d": ("Reds", "manual", 2, "red"), "e": ("Azure", "manual", 4, "blue"), "z": ("Golds", "search", 8, "gold")}


@pytest.fixture()
def plain_joins(spark):
    """Joins by sorting alone, their tasks as dealt."""
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    yield
    for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(name)


def test_links_without_a_team_are_dealt_over_all_tasks(spark, snapshot, plain_joins):
    links = spark.createDataFrame([(i, 1, f"r{i}", "Nobody", 0, None, None, None, None) for i in range(400)], LINKS)
    feed = spark.createDataFrame([(1, 1, "r7", "Blues", "u4", False)], "seq bigint, our_team_id bigint, root_team_id string, name string, progenitor_team_id string, is_hidden boolean")
    details = spark.createDataFrame([("u4", "blue", None, 2025)], "progenitor_team_id string, public_id string, name string, season_year bigint")
    hits = spark.createDataFrame([("Golds", "v1", "gold", "Golds", 2025)], "query string, gc_uuid string, public_id string, name string, season_year bigint")
    out, _ = linking.resolve_opponents(links, feed, details, hits, snapshot["teams"], F.lit("now"), 2026)
    assert rows(out.filter("resolved_team_id is not null"), "root_team_id", "resolved_team_id") == [("r7", 4)]
    tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 400 and max(tasks) < 200


def test_a_team_of_many_links_is_dealt_over_tasks(spark, plain_joins):
    links = spark.createDataFrame([(1 if i % 4 else None, i) for i in range(400)], "our bigint, root bigint")
    years = spark.createDataFrame([(1, 2025), (2, 2024)], "our bigint, year bigint")
    out = linking._joined_evenly(links, years, ["our"], "root", linking.PLACES)
    assert rows(out, "root", "year") == sorted(((i, 2025 if i % 4 else None) for i in range(400)), key=str)
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 200
