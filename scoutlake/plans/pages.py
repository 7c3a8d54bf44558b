"""Queries of `operators.answers`: box scores, scouting reports and player profiles, list by list."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.operators import answers
from scoutlake.plans.catalog import query

_NAME = "case when first_name || ' ' || last_name = 'Unknown Unknown' then case when coalesce(jersey_number, '') <> '' then 'Player #' || jersey_number else 'Unknown Player' end else first_name || ' ' || last_name end as name, coalesce(first_name || ' ' || last_name = 'Unknown Unknown', false) as name_unresolved"
_PEOPLE = "join page_players using (player_id) left join merge_rosters using (team_id, season_id, player_id)"
_ZERO = lambda cs: ", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in cs)


def _flat(rows, keys, column):
    return rows.select(*keys, F.posexplode(column).alias("_n", "r")).select(*keys, (F.col("_n") + 1).cast("bigint").alias("nth"), "r.*")


def _box(t):
    return answers.box_scores(t("page_games"), t("merge_batting"), t("merge_pitching").withColumn("appearance_order", F.when(F.col("bf") % 3 > 0, F.col("bf"))).withColumn("season_id", F.lit(0)), t("page_players"), t("merge_rosters"), t("page_teams"))


def _lines(table: str, columns: list[str], order: str) -> str:
    return f"""with lines as (select *, {order or 'null'} as place, coalesce(max(case when perspective_team_id = team_id then team_id end) over (partition by game_id, team_id), min(perspective_team_id) over (partition by game_id, team_id)) as chosen from {table}),
        sides as (select distinct game_id, season_id, unnest([{{'side': 'home', 'team_id': home_team_id}}, {{'side': 'away', 'team_id': away_team_id}}], recursive := true) from page_games)
        select game_id, side, team_id, row_number() over (partition by game_id, side order by place nulls last, last_name nulls first, player_id) as nth, player_id, {_NAME}, {_ZERO(columns)}, jersey_number from lines join sides using (game_id, team_id) {_PEOPLE} where perspective_team_id = chosen"""


@query("box_batting", _lines("merge_batting", answers.BOX_BATTING, ""))
def box_batting(t):
    return _flat(_box(t), ["game_id", "side", "team_id"], "batting_lines")


@query("box_pitching", _lines("merge_pitching", answers.BOX_PITCHING, "case when bf % 3 > 0 then bf end"))
def box_pitching(t):
    return _flat(_box(t), ["game_id", "side", "team_id"], "pitching_lines")


@query("box_games", """select game_id, season_id, game_date::string as game_date, side, team_id, score, coalesce(name, team_id::varchar) as team_name from (
    select game_id, season_id, game_date, 'home' as side, home_team_id as team_id, home_score as score from page_games union all select game_id, season_id, game_date, 'away', away_team_id, away_score from page_games) as s left join page_teams on id = team_id""")  # fmt: skip
def box_games(t):
    return _box(t).drop("batting_lines", "pitching_lines")


def _report(t):
    return answers.scouting_reports(t("merge_season_batting"), t("merge_season_pitching"), t("page_games"), t("page_players"), t("merge_rosters"), t("page_teams"))


@query("report_teams", """
    select team_id, season_id, coalesce(name, team_id::varchar) as team_name, coalesce((select count(*) from page_games as g where g.season_id = k.season_id and (home_team_id = team_id and home_score > away_score)), 0) + coalesce((select count(*) from page_games as g where g.season_id = k.season_id and (away_team_id = team_id and home_score < away_score)), 0) as wins,
        coalesce((select count(*) from page_games as g where g.season_id = k.season_id and (home_team_id = team_id and home_score < away_score)), 0) + coalesce((select count(*) from page_games as g where g.season_id = k.season_id and (away_team_id = team_id and home_score > away_score)), 0) as losses
    from (select team_id, season_id from merge_season_batting union select team_id, season_id from merge_season_pitching) as k left join page_teams on id = team_id""")  # fmt: skip
def report_teams(t):
    return _report(t).drop("batting", "pitching")


@query("report_batting", f"""
    select team_id, season_id, row_number() over (partition by team_id, season_id order by ab = 0, h::double / nullif(ab, 0) desc nulls last, last_name nulls first, player_id) as nth, player_id, {_NAME}, gp as games, {_ZERO(answers.REPORT_BATTING)}, jersey_number,
        h::double / nullif(ab, 0) as avg, (h + bb + hbp)::double / nullif(ab + bb + hbp + shf, 0) as obp, (h + doubles + 2 * triples + 3 * hr)::double / nullif(ab, 0) as slg from merge_season_batting {_PEOPLE}""")  # fmt: skip
def report_batting(t):
    return _flat(_report(t), ["team_id", "season_id"], "batting")


@query("report_pitching", f"""
    select team_id, season_id, row_number() over (partition by team_id, season_id order by ip_outs = 0, er * 27.0::double / nullif(ip_outs, 0) nulls last, last_name nulls first, player_id) as nth, player_id, {_NAME}, gp_pitcher as games, {_ZERO(answers.BOX_PITCHING)}, jersey_number,
        (er * 27)::double / nullif(ip_outs, 0) as era, (so * 27)::double / nullif(ip_outs, 0) as k9, ((bb + h) * 3)::double / nullif(ip_outs, 0) as whip from merge_season_pitching {_PEOPLE}""")  # fmt: skip
def report_pitching(t):
    return _flat(_report(t), ["team_id", "season_id"], "pitching")


def _profiles(t):
    return answers.player_profiles(t("page_players"), t("merge_season_batting"), t("merge_season_pitching"), t("merge_batting"), t("merge_pitching"), t("page_games"), t("merge_rosters"), t("page_teams"))


@query("profile_players", """select player_id, first_name, last_name, (select arg_max(jersey_number, (season_id, team_id)) from merge_rosters as r where r.player_id = p.player_id) as jersey_number,
    (select count(*) from merge_season_batting as s join page_teams on id = s.team_id where s.player_id = p.player_id) as n_batting, (select count(*) from merge_season_pitching as s join page_teams on id = s.team_id where s.player_id = p.player_id) as n_pitching from page_players as p""")  # fmt: skip
def profile_players(t):
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return _profiles(t).select("player_id", "first_name", "last_name", "jersey_number", size("batting_seasons").alias("n_batting"), size("pitching_seasons").alias("n_pitching"))


@query("profile_recent_games", """
    with r as (select player_id, game_id, team_id, ab, h, coalesce(hr, 0) as hr, coalesce(rbi, 0) as rbi, null::bigint as ip_outs, null::bigint as er, null::bigint as so_pitched, 'batting' as appearance_type from merge_batting where perspective_team_id = team_id
        union all select player_id, game_id, team_id, null, null, null, null, ip_outs, er, so, 'pitching' from merge_pitching where perspective_team_id = team_id),
    n as (select distinct r.player_id, g.game_id, game_date, start_time, t.name as opponent_name, ab, h, hr, rbi, ip_outs, er, so_pitched, appearance_type from r join page_games as g using (game_id) join page_players using (player_id) left join page_teams as t on t.id = case when r.team_id = home_team_id then away_team_id else home_team_id end),
    w as (select *, dense_rank() over (partition by player_id order by game_date desc, start_time desc nulls last, game_id desc) as place from n)
    select player_id, row_number() over (partition by player_id order by place, appearance_type, ab nulls last) as nth, game_id, game_date::string as game_date, start_time, opponent_name, ab, h, hr, rbi, ip_outs, er, so_pitched, appearance_type from w where place <= 5""")  # fmt: skip
def profile_recent_games(t):
    return _flat(_profiles(t), ["player_id"], "recent_games")
