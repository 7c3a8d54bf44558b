"""Queries of `operators.intake` and of summaries of batted balls."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.operators import intake, plays, spray
from scoutlake.plans.catalog import query

_X, _Y = f"({160 - 160 * spray.X_SCALE!r}::double + x * {spray.X_SCALE!r}::double)", f"({295 - 296 * spray.Y_SCALE!r}::double + y * {spray.Y_SCALE!r}::double)"
_ANGLE = f"atan2({_X} - 160, -({_Y} - 295))"
_ZONE = f"""case when play_result = 'home_run' then case when x is null or y is null then 'center' when {_X} < 109 then 'left' when {_X} > 211 then 'right' else 'center' end
    when x is null or y is null then null when {_ANGLE} < -0.206 then 'left' when {_ANGLE} > 0.206 then 'right' else 'center' end"""
_CONTACT = "case play_type " + " ".join(f"when '{k}' then '{v}'" for k, v in spray.CONTACT.items()) + " end"
_COUNTS = f"count(*) as bip, count(*) filter (play_result in ('single', 'double', 'triple', 'home_run', 'dropped_third_strike')) as hits, {', '.join(f'count(*) filter (zone = {z!r}) as n_{z}' for z in ('left', 'center', 'right'))}, {', '.join(f'count(*) filter (contact = {c!r}) as n_{c}' for c in dict.fromkeys(spray.CONTACT.values()))}"


def _sums(key: str, least: int, source: str) -> str:
    return f"select {key}, {_COUNTS}, count(*) >= {least} as charted from (select *, {_ZONE} as zone, {_CONTACT} as contact from {source}) as z group by all"


@query("spray_by_player", _sums("player_id", spray.LEAST_PLAYER, "typed_balls"))
def spray_by_player(t):
    return spray.summaries(t("typed_balls"), ["player_id"])


_NEWEST = "(select * from typed_balls where perspective_team_id = team_id qualify season_id = max(season_id) over (partition by team_id)) as newest"


@query("spray_by_team", _sums("team_id, season_id", spray.LEAST_TEAM, _NEWEST))
def spray_by_team(t):
    """Each team's newest season, from its own perspective."""
    rows = intake.newest_season(t("typed_balls"), F.col("perspective_team_id") == F.col("team_id"))
    return spray.summaries(rows, ["team_id", "season_id"], spray.LEAST_TEAM)


@query("sided_games", """select game_id, case when home_away = 'away' then opponent_team_id else own_team_id end as home_team_id, case when home_away = 'away' then own_team_id else opponent_team_id end as away_team_id,
    case when home_away = 'away' then opponent_score else own_score end as home_score, case when home_away = 'away' then own_score else opponent_score end as away_score from summaries""")  # fmt: skip
def sided_games(t):
    return intake.sided(t("summaries"))


@query("box_keys", """select id, case when two like 'slug%' then two when own_uuid is null then null when two = lower(own_uuid) then two when one = lower(own_uuid) then one end as own,
    case when two like 'slug%' then one when own_uuid is null or one = two then one when one = lower(own_uuid) then two else one end as opponent from box_teams""")  # fmt: skip
def box_keys(t):
    return t("box_teams").select("id", intake.box_keys(F.array("one", "two"), F.col("own_uuid")).alias("k")).select("id", "k.*")


@query("new_opponents", "select arg_min(name, seq) as name, 'tracked' as membership_type, 0 as is_active, 'discovered' as source from new_names where name is not null and lower(name) not in (select lower(c_name) from customer) group by lower(name)")
def new_opponents(t):
    return intake.placeholders(t("new_names"), t("customer").select(F.col("c_name").alias("name")))


@query("opponent_names", "select distinct trim(name) as name from new_names where trim(name) <> ''")
def opponent_names(t):
    return intake.discovered(t("new_names"), "name")


def _rosters(scouting: bool) -> str:
    position = "case when o.p is not null then o.position else n.position end" if scouting else "case when n.p is not null then n.position else o.position end"
    return f"""with o as (select player_id, team_id, season_id, jersey_number, 'P' || player_id % 3 as position, 1 as p from merge_rosters), n as (select player_id, team_id, season_id + 1 as season_id, case when player_id % 4 = 0 then null else '0' end as jersey_number, 'C' as position, 1 as p from merge_rosters)
        select team_id, player_id, season_id, case when n.p is not null then n.jersey_number else o.jersey_number end as jersey_number, {position} as position from o full join n using (team_id, player_id, season_id)"""


def _put(t, scouting):
    n = F.col("player_id")
    old = t("merge_rosters").select("team_id", "player_id", "season_id", "jersey_number", F.concat(F.lit("P"), (n % 3).cast("string")).alias("position"))
    new = old.select("team_id", "player_id", (F.col("season_id") + 1).alias("season_id"), F.when(n % 4 == 0, None).otherwise("0").alias("jersey_number"), F.lit("C").alias("position"), n.alias("seq"))
    return intake.rosters_after(old, new, scouting)


@query("rosters_loaded", _rosters(False))
def rosters_loaded(t):
    return _put(t, False)


@query("rosters_scouted", _rosters(True))
def rosters_scouted(t):
    return _put(t, True)


@query("years_healed", "select id, name, coalesce(season_year, case when id % 4 > 0 then 2030 + id % 2 end) as season_year from link_teams")
def years_healed(t):
    told = t("link_teams").select("id", F.when(F.col("id") % 4 > 0, 2030 + F.col("id") % 2).alias("season_year"))
    return intake.years_healed(t("link_teams").select("id", "name", "season_year"), told)


@query("league_info", """select c_custkey as id, program_type, case when n_nationkey % 2 = 0 then 'jv' end as classification from customer left join nation on n_nationkey = c_custkey left join (select id as program_id, program_type from programs) as p on program_id = n_regionkey + 1""")
def league_info(t):
    teams = t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), (F.col("n_regionkey") + 1).cast("bigint").alias("program_id"), F.when(F.col("n_nationkey") % 2 == 0, "jv").alias("classification"))
    return intake.league_info(t("customer").select(F.col("c_custkey").alias("id")), teams, t("programs"))


@query("play_match_rate", """with d as (select pitcher_id as player_id, sum(is_first_pitch_strike)::bigint as derived from plays where pitcher_id is not null group by all), b as (select *, case when official = 0 then derived = 0 else abs(derived - official) * 100.0::double / official <= 5 end as within from d join (select c_custkey as player_id, c_custkey % 7 as official from customer) as o using (player_id))
    select count(*) as compared, coalesce(sum(within::int), 0)::bigint as matched, case when count(*) = 0 then 100.0::double else sum(within::int) * 100.0::double / count(*) end as match_rate from b""")  # fmt: skip
def play_match_rate(t):
    mine = t("plays").filter("pitcher_id is not null").groupBy(F.col("pitcher_id").alias("player_id")).agg(F.sum("is_first_pitch_strike").cast("bigint").alias("so"))
    theirs = t("customer").select(F.col("c_custkey").alias("player_id"), (F.col("c_custkey") % 7).alias("so"))
    return intake.match_rate(plays.compared(mine, theirs, ["player_id"], "so"))
