"""Who is who: duplicate players and teams, the choice of one of them, and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_players(rosters: DataFrame) -> DataFrame:
    """Pairs of one team and season with one last name (any case) whose first names begin alike: canonical_id, duplicate_id.

    rosters: team_id, season_id, player_id, first_name, last_name, stat_rows. The longer first name is canonical, then more
    rows, then the lesser id. First names are joined by each of their prefixes, which are few, so players of one common last
    name never meet pairwise. There are as many pairs as the names give, which is the square of a common one's players: each
    is found once, and none is shuffled, but those of players that a team lists several times.
    """
    rows = rosters.select("team_id", "season_id", "player_id", "stat_rows", F.lower("last_name").alias("last"), F.lower("first_name").alias("first")).filter("first <> ''").distinct()
    rows = rows.withColumn("listed", F.count(F.lit(1)).over(Window.partitionBy("team_id", "season_id", "player_id")) > 1)
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda n: F.substring("first", 1, n)))
    longer = rows.select("team_id", "season_id", "last", prefixes.alias("first"), *(F.col(c).alias(f"long_{c}") for c in ("player_id", "stat_rows", "first", "listed")))
    # equal first names meet from both sides: the lesser id's is the one that counts
    once = (F.col("first") != F.col("long_first")) | (F.col("player_id") < F.col("long_player_id"))
    both = rows.join(longer, ["team_id", "season_id", "last", "first"]).filter((F.col("player_id") != F.col("long_player_id")) & once)
    mine = F.struct(-F.length("first"), -F.col("stat_rows"), F.col("player_id"))
    theirs = F.struct(-F.length("long_first"), -F.col("long_stat_rows"), F.col("long_player_id"))
    one = F.when(mine < theirs, F.col("player_id")).otherwise(F.col("long_player_id"))
    two = F.when(mine < theirs, F.col("long_player_id")).otherwise(F.col("player_id"))
    pairs = lambda which: both.filter(which).select("team_id", "season_id", one.alias("canonical_id"), two.alias("duplicate_id"))
    several = F.col("listed") | F.col("long_listed")
    return pairs(~several).unionByName(pairs(several).distinct())


def duplicate_teams(teams: DataFrame) -> DataFrame:
    """Tracked teams of one name (any case): pass 1 with one year, pass 2 a year and none, of teams that pass 1 left."""
    rows = teams.filter("membership_type = 'tracked'").select("id", F.lower("name").alias("name"), "season_year")
    year = Window.partitionBy("name", "season_year")
    rows = rows.withColumn("same", F.when(F.col("season_year").isNotNull(), F.count(F.lit(1)).over(year)).otherwise(1))
    first = rows.filter("same > 1").select("id", "name", "season_year", F.lit(1).cast("bigint").alias("pass"))
    left = rows.filter("same = 1")
    name = Window.partitionBy("name")
    left = left.withColumn("dated", F.count("season_year").over(name)).withColumn("all", F.count(F.lit(1)).over(name))
    second = left.filter("dated > 0 and all > dated").select("id", "name", "season_year", F.lit(2).cast("bigint").alias("pass"))
    return first.union(second)


def canonical_teams(groups: DataFrame) -> DataFrame:
    """The team of each group (name, pass) that stays: with statistics, then most games, then the least id."""
    order = Window.partitionBy("name", "pass").orderBy(F.desc("has_stats"), F.desc("games"), "id")
    return groups.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("name", "pass", F.col("id").alias("canonical_id"))


def renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """rows in which a duplicate's id in a column is the canonical one (names: duplicate_id, canonical_id)."""
    map_ = names.select(F.col("duplicate_id").alias(column), F.col("canonical_id").alias("_canonical"))
    return rows.join(map_, column, "left").withColumn(column, F.coalesce("_canonical", column)).drop("_canonical").select(*rows.columns)


COMPLETENESS = {"full": 3, "supplemented": 2, "boxscore_only": 1}


def merged_players(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Game rows after a merge: of rows that fall together the more complete one stays, then the canonical player's."""
    rank = F.lit(0)
    for word, value in COMPLETENESS.items():
        rank = F.when(F.col("stat_completeness") == word, value).otherwise(rank)
    rows = lines.withColumn("_was", F.col("player_id"))
    rows = renamed(rows, names, "player_id").withColumn("_rank", rank).withColumn("_own", F.col("_was") == F.col("player_id"))
    order = Window.partitionBy("game_id", "player_id", "perspective_team_id").orderBy(F.desc("_rank"), F.desc("_own"), "_was")
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select(*lines.columns)


def merged_teams(rows: DataFrame, names: DataFrame, keys: list[str], columns: tuple[str, ...] = ("team_id", "perspective_team_id")) -> DataFrame:
    """Rows after a merge of teams; of rows that fall together on keys the one that was canonical before stays."""
    out = rows.withColumn("_before", F.concat_ws("|", *columns))
    for c in columns:
        out = renamed(out, names, c)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.concat_ws("|", *columns) == F.col("_before")), "_before")
    return out.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select(*rows.columns)


def resolved_teams(wanted: DataFrame, teams: DataFrame) -> DataFrame:
    """wanted (seq, gc_uuid, public_id, name, season_year) with the id of its team: by uuid, else slug, else name and year.

    The name and the year (null is a year) must be a tracked team's; the least id wins.
    """
    by = lambda c, rows=teams: rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias(f"by_{c}"))
    tracked = teams.filter("membership_type = 'tracked'").groupBy(F.lower("name").alias("_name"), F.col("season_year").alias("_year")).agg(F.min("id").alias("by_name"))
    out = wanted.join(by("gc_uuid"), "gc_uuid", "left").join(by("public_id"), "public_id", "left")
    out = out.join(tracked, (F.lower("name") == F.col("_name")) & F.col("season_year").eqNullSafe(F.col("_year")), "left")
    how = F.when(F.col("by_gc_uuid").isNotNull(), "uuid").when(F.col("by_public_id").isNotNull(), "slug").when(F.col("by_name").isNotNull(), "name").otherwise("new")
    return out.select("seq", F.coalesce("by_gc_uuid", "by_public_id", "by_name").alias("team_id"), how.alias("how"))


def link_counts(links: DataFrame) -> DataFrame:
    """Links of each team: all, resolved, unresolved, hidden."""
    count = lambda c: F.sum(c.cast("bigint"))
    hidden, resolved = F.col("is_hidden") == 1, F.col("resolved_team_id").isNotNull()
    return links.groupBy("our_team_id").agg(F.count(F.lit(1)).alias("total"), count(resolved & ~hidden).alias("resolved"), count(~resolved & ~hidden).alias("unresolved"), count(hidden).alias("hidden"))


def to_scout(links: DataFrame, jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Teams of resolved links without a running job and without one that ended within some hours."""
    fresh = jobs.filter((F.col("state") == "running") | (F.col("ended_at") >= now - F.make_interval(hours=F.lit(hours))))
    return links.filter("resolved_team_id is not null and is_hidden = 0").select(F.col("resolved_team_id").alias("team_id")).distinct().join(fresh.select("team_id"), "team_id", "left_anti")
