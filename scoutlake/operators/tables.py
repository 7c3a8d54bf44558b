"""Keyed writes as DataFrames: what a table holds after an upsert, an insert that ignores, or a delete.

Spark tables are snapshots: each function returns the new snapshot, and the caller writes it beside the old one and swaps
the path. `seq` numbers the incoming rows; ties of a key are settled by it, so a repeated run gives the same table.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df computed once, its rows in the checkpoint folder: what is built on it has a short plan, and no executor's loss undoes it.

    The folder is the session's; where none is set, one of this machine's under a local master, and an error on a cluster.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="scoutlake-"))
    return df.checkpoint()


def latest(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key. One aggregation, so a key with many rows is summed before it is shuffled."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("_last"))
    return last.select(*keys, "_last.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: dict[str, Column] | None = None, seq: str = "seq") -> DataFrame:
    """old with new's last rows put over it. keep: columns whose new value is given by an expression over `old_c` and `new_c`."""
    names = [c for c in old.columns if c not in keys]
    left = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in names), F.lit(True).alias("in_old"))
    right = latest(new, keys, seq).select(*keys, *(F.col(c).alias(f"new_{c}") for c in names), F.lit(True).alias("in_new"))
    both = left.join(right, keys, "full_outer")
    rule = keep or {}
    choice = [F.when(F.col("in_new").isNull(), F.col(f"old_{c}")).when(F.col("in_old").isNull(), F.col(f"new_{c}")).otherwise(rule.get(c, F.col(f"new_{c}"))).alias(c) for c in names]
    return both.select(*keys, *choice)


def upsert_filling(old: DataFrame, new: DataFrame, keys: list[str], fill: list[str], seq: str = "seq") -> DataFrame:
    """As upsert, but a null in `fill` does not overwrite."""
    return upsert(old, new, keys, {c: F.coalesce(f"new_{c}", f"old_{c}") for c in fill}, seq)


def upsert_if_null(old: DataFrame, new: DataFrame, keys: list[str], fill: list[str], seq: str = "seq") -> DataFrame:
    """As upsert, but a value in `fill` that is known stays; only nulls are filled."""
    return upsert(old, new, keys, {c: F.coalesce(f"old_{c}", f"new_{c}") for c in fill}, seq)


def upsert_guarded(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """As upsert, but a completed game's status stays completed."""
    return upsert(old, new, keys, {"status": F.when(F.col("old_status") == "completed", F.col("old_status")).otherwise(F.col("new_status"))}, seq)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """old with new's first rows for keys that it lacks; rows with a null key never collide."""
    names = [c for c in new.columns if c not in keys]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    first = new.filter(whole).groupBy(*keys).agg(F.min_by(F.struct(*names), seq).alias("_first")).select(*keys, "_first.*").select(*new.columns)
    added = first.join(old.select(*keys), keys, "left_anti")
    return old.unionByName(added.select(*old.columns)).unionByName(new.filter(~whole).select(*old.columns))


def longest_names(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """player_id with its longest first and last name, each for itself; `Unknown` counts as empty, the earlier wins a tie."""
    size = lambda c: F.when(F.col(c) == "Unknown", 0).otherwise(F.coalesce(F.length(c), F.lit(0)))
    best = lambda c: F.max_by(c, F.struct(size(c), -F.col(seq))).alias(c)
    return rows.groupBy("player_id").agg(best("first_name"), best("last_name"))


def not_loaded(rows: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups that no earlier run has loaded."""
    return rows.join(loaded.select(*keys).distinct(), keys, "left_anti")


def without_perspectives(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """lines without the rows of removed (game_id, perspective_team_id)."""
    return lines.join(removed.select("game_id", "perspective_team_id").distinct(), ["game_id", "perspective_team_id"], "left_anti")


def surviving_games(games: DataFrame, lines: DataFrame, removed: DataFrame) -> DataFrame:
    """The games of which, after the removal, a perspective is left, and those that the removal does not touch."""
    left = without_perspectives(lines, removed).select("game_id").distinct()
    touched = removed.select("game_id").distinct()
    return games.join(touched, "game_id", "left_anti").unionByName(games.join(touched, "game_id", "left_semi").join(left, "game_id", "left_semi"))


def without_team(lines: DataFrame, team: Column) -> DataFrame:
    """lines without those of a team, be it theirs or seen by them."""
    return lines.filter(~F.coalesce((F.col("perspective_team_id") == team) | (F.col("team_id") == team), F.lit(False)))


def orphan_games(games: DataFrame, orphans: DataFrame) -> DataFrame:
    """The games of which both teams are orphans."""
    home = orphans.select(F.col("id").alias("home_team_id")).distinct()
    away = orphans.select(F.col("id").alias("away_team_id")).distinct()
    return games.join(home, "home_team_id", "left_semi").join(away, "away_team_id", "left_semi")


def key_faults(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a table holds more than once: what a unique index would forbid."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_parents(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key no parent has: what a foreign key would forbid."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
