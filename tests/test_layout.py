"""Layouts that lookups prune, due files, and small rules of names, paths and keyed writes."""

import os
import time

from pyspark.sql import functions as F

from scoutlake.functions import text
from scoutlake.operators import tables, text_scan
from scoutlake.sources import layout


def test_lookups_read_one_folder_and_few_files(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 4 + 2020).alias("season_id"), (F.col("id") % 25).alias("team_id"), F.col("id").alias("player_id"), (F.col("id") * 7).alias("game_id"))
    path = str(tmp_path / "batting")
    layout.write(rows, path, "batting", rows_a_file=100)
    found = layout.lookup(spark, path, season_id=2021, team_id=5, player_id=(0, 1000))
    assert sorted(r["player_id"] for r in found.collect()) == [i for i in range(1001) if i % 4 == 1 and i % 25 == 5]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(season_id" in plan and "EqualTo(team_id,5)" in plan and "GreaterThanOrEqual(player_id,0)" in plan
    # no folder of another season is opened, and files of a season hold narrow ranges of teams
    scanned = found.select(F.input_file_name().alias("f")).distinct().collect()
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) >= 40 and 1 <= len(scanned) <= 2 and all("season_id=2021" in r["f"] for r in scanned)
    assert layout.lookup(spark, path, season_id=[2020, 2023], team_id=3).count() == 80


def test_due_files(spark, tmp_path):
    now = time.time()
    for name, age in (("schedule.json", 2), ("roster.json", 2), ("stats.json", 25), ("opponents.json", 23.9)):
        (tmp_path / "teams").mkdir(exist_ok=True)
        path = tmp_path / "teams" / name
        path.write_text("not json")
        os.utime(path, (now - age * 3600, now - age * 3600))
    due = layout.due_files(spark, f"{tmp_path}/teams/*.json", F.timestamp_seconds(F.lit(int(now))))
    assert sorted(r["kind"] for r in due.collect()) == ["schedule", "stats"]
    assert sorted(r["kind"] for r in layout.due_files(spark, f"{tmp_path}/teams/*.json", F.timestamp_seconds(F.lit(int(now))), {"roster": 0, "schedule": 99}).collect()) == ["roster", "stats"]


def test_scannable(spark):
    paths = ["src/a.py", "A.JSON", ".env", ".env.local", "x/.env", "Makefile", "a.tar.gz", ".git/config.txt", "epics/a.md", "docs/epics/a.md", "requirements.txt", "my-requirements.txt", "dir.py/", None, "a.", ".bash"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r[0]: r[1] for r in df.select("path", text_scan.scannable(F.col("path"))).collect()}
    assert {p for p, ok in got.items() if ok} == {"src/a.py", "A.JSON", ".env", "x/.env", "docs/epics/a.md", "my-requirements.txt", "dir.py/", ".bash"}


def test_every_level_word_goes(spark):
    names = ["Lincoln JV", "East Varsity Reserve JV 14U Legion ", "West Junior Varsity", "JV", "Varsity Blues", " Post 5 "]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(text.without_level(F.col("name"))).collect()] == ["Lincoln", "East", "West", "JV", "Varsity Blues", "Post 5"]


def test_only_nulls_are_filled(spark):
    old = spark.createDataFrame([(1, "7", "a"), (2, None, "b")], "k bigint, jersey string, name string")
    new = spark.createDataFrame([(1, 1, "8", "c"), (2, 2, "9", "d"), (3, 2, "10", "e"), (4, 3, None, "f")], "seq bigint, k bigint, jersey string, name string")
    assert sorted(map(tuple, tables.upsert_if_null(old, new, ["k"], ["jersey"]).select("k", "jersey", "name").collect())) == [(1, "7", "c"), (2, "10", "e"), (3, None, "f")]
