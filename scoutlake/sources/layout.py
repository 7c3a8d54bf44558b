"""How tables lie on disk so that lookups read little, and which feed files are due.

A table is partitioned by the columns that most questions name (a season, a team) and sorted within by those that name one row, so
a point or range lookup prunes folders by name and row groups by their least and greatest values. This stands for the indexes of a
database: the planner uses it by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: By table: the columns of its folders and the order within them.
LAYOUTS = {
    "games": (["season_id"], ["game_date", "game_id"]),
    "batting": (["season_id"], ["team_id", "player_id", "game_id"]),
    "pitching": (["season_id"], ["team_id", "player_id", "game_id"]),
    "season_batting": (["season_id"], ["team_id", "player_id"]),
    "season_pitching": (["season_id"], ["team_id", "player_id"]),
    "rosters": (["season_id"], ["team_id", "player_id"]),
    "plays": (["perspective_team_id"], ["game_id", "play_order"]),
    "balls": (["season_id"], ["player_id", "game_id"]),
}
#: After how many hours a file of a kind is due again.
HOURS = {"schedule": 1}
DUE_HOURS = 24


def write(df: DataFrame, path: str, table: str, rows_a_file: int = 1_000_000) -> None:
    """df as the Parquet table `path` in its layout. Each folder's rows are dealt by range of their order, so a file holds a
    narrow range; a folder of many rows has many files, and no task gets a whole folder."""
    folders, order = LAYOUTS[table]
    dealt = df.repartitionByRange(*folders, *order).sortWithinPartitions(*folders, *order)
    dealt.write.partitionBy(*folders).option("maxRecordsPerFile", rows_a_file).parquet(path)


def lookup(spark: SparkSession, path: str, **values) -> DataFrame:
    """The rows whose columns have these values; a list asks for any of its values, a tuple for a range with both ends."""
    rows = spark.read.parquet(path)
    for column, value in values.items():
        c = F.col(column)
        rows = rows.filter(c.isin(value) if isinstance(value, list) else c.between(*value) if isinstance(value, tuple) else c == value)
    return rows


def due_files(spark: SparkSession, path: str, now: Column, hours: dict[str, int] | None = None) -> DataFrame:
    """file, kind (its name without ending) and modified of every file at path that is as old as its kind may get. Only the
    listing is read, no file."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"))
    kind = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    allowed = F.lit(DUE_HOURS)
    for name, n in (HOURS if hours is None else hours).items():
        allowed = F.when(kind == name, n).otherwise(allowed)
    return files.select("file", kind.alias("kind"), "modified").filter(F.unix_timestamp(now) - F.unix_timestamp("modified") >= allowed * 3600)
