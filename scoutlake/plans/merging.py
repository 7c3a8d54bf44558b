"""Queries of `operators.merges`: snapshots after merges of players and of teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.operators import merges
from scoutlake.plans.catalog import query

_NAMES = """names as (select duplicate_id, duplicate_id - duplicate_id % 3 as canonical_id from merge_pairs),
    ids as (select duplicate_id as id, canonical_id from names union all select distinct canonical_id, canonical_id from names)"""
_RANK = "case stat_completeness when 'full' then 3 when 'supplemented' then 2 when 'boxscore_only' then 1 else 0 end"


def _after(table: str) -> str:
    return f"""(select * exclude (id, canonical_id) replace (coalesce(canonical_id, player_id) as player_id) from {table} left join ids on id = player_id
        qualify row_number() over (partition by game_id, coalesce(canonical_id, player_id), perspective_team_id order by {_RANK} desc, player_id) = 1)"""


def _snapshot(t):
    names = ("batting", "pitching", "rosters", "season_batting", "season_pitching", "players")
    return {n: t(f"merge_{n}") for n in names} | {"games": t("games"), "plays": t("plays")}


def _names(t):
    return merges.final_names(t("merge_pairs"))


@query("merge_names", f"with {_NAMES} select * from names")
def merge_names(t):
    return _names(t)


@query("merge_game_rows", f"with {_NAMES} select * from {_after('merge_batting')} as r")
def merge_game_rows(t):
    return merges.merge_players(_snapshot(t), _names(t))["batting"]


@query("merge_rosters_after", f"""with {_NAMES} select coalesce(canonical_id, player_id) as player_id, team_id, season_id, jersey_number from merge_rosters left join ids on id = player_id
    qualify row_number() over (partition by team_id, season_id, coalesce(canonical_id, player_id) order by player_id) = 1""")  # fmt: skip
def merge_rosters_after(t):
    return merges.merge_players(_snapshot(t), _names(t))["rosters"]


_AFFECTED = """affected as (select canonical_id as player_id, team_id, season_id from ids join (select player_id, team_id, season_id from merge_batting join games using (game_id) union all select player_id, team_id, season_id from merge_pitching join games using (game_id)
    union all select player_id, team_id, season_id from merge_season_batting union all select player_id, team_id, season_id from merge_season_pitching) as r on id = player_id group by all)"""


@query("merge_affected", f"with {_NAMES}, {_AFFECTED} select * from affected")
def merge_affected(t):
    return merges.affected_seasons(_snapshot(t), _names(t))


_B = ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in merges.BATTING)
_SEASON_B = f"""select player_id, team_id, season_id, 'boxscore_only' as stat_completeness, n as games_tracked, n as gp, ab + bb + hbp + shf as pa, ab, h, h - doubles - triples - hr as singles, doubles, triples, hr, rbi, r, bb, so, hbp, shf, sb, cs, tb, doubles + triples + hr as xbh
    from (select player_id, team_id, season_id, count(*) as n, {_B} from (select p.*, season_id from {_after('merge_batting')} as p join games using (game_id)) as l where perspective_team_id = team_id group by all) as s"""


@query("merge_season_batting_after", f"""with {_NAMES} select merge_season_batting.* from merge_season_batting where player_id not in (select id from ids)
    union all select * from ({_SEASON_B}) as f where player_id in (select canonical_id from ids)""")  # fmt: skip
def merge_season_batting_after(t):
    """The oracle makes every merged player's rows anew, the query only those of the affected keys."""
    return merges.merge_players(_snapshot(t), _names(t))["season_batting"]


@query("merge_season_pitching_after", f"""with {_NAMES} select merge_season_pitching.* from merge_season_pitching where player_id not in (select id from ids)
    union all select player_id, team_id, season_id, 'boxscore_only', count(*), count(*), {", ".join(f"coalesce(sum({c}), 0)::bigint" for c in merges.PITCHING)}, {", ".join(f"count(*) filter (decision = '{d}')" for d in merges.DECISIONS.values())}
    from (select p.*, season_id from {_after('merge_pitching')} as p join games using (game_id)) as l where perspective_team_id = team_id and player_id in (select canonical_id from ids) group by player_id, team_id, season_id""")  # fmt: skip
def merge_season_pitching_after(t):
    return merges.merge_players(_snapshot(t), _names(t))["season_pitching"]


_SIZE = "case when {0} is null or {0} = 'Unknown' then 0 else length({0}) end"


@query("merge_players_after", f"""with {_NAMES}, told as (select canonical_id, player_id, first_name, last_name from merge_players join ids on id = player_id)
    select player_id, case when player_id in (select canonical_id from ids) then (select arg_max(first_name, ({_SIZE.format('first_name')}, -told.player_id)) from told where told.canonical_id = p.player_id) else first_name end as first_name,
        case when player_id in (select canonical_id from ids) then (select x.last_name from told as x where x.canonical_id = p.player_id order by {_SIZE.format('x.last_name')} desc, x.player_id limit 1) else last_name end as last_name
    from merge_players as p where player_id not in (select duplicate_id from names)""")  # fmt: skip
def merge_players_after(t):
    return merges.merge_players(_snapshot(t), _names(t))["players"]


@query("merge_preview", f"""with {_NAMES}, r as (select player_id, 'batting' as "table" from merge_batting union all select player_id, 'pitching' from merge_pitching union all select player_id, 'rosters' from merge_rosters
    union all select batter_id, 'plays' from plays union all select pitcher_id, 'plays' from plays) select player_id as duplicate_id, "table", count(*) as n from r where player_id in (select duplicate_id from names) group by all""")  # fmt: skip
def merge_preview(t):
    return merges.preview(_snapshot(t), _names(t), merges.PLAYER_RULES)


@query("merge_stat_rows", """select player_id, count(*) as stat_rows from (select player_id from merge_batting union all select player_id from merge_pitching union all select player_id from merge_season_batting union all select player_id from merge_season_pitching) as r group by all""")
def merge_stat_rows(t):
    return merges.stat_rows(_snapshot(t))


@query("merge_recent", """
    with recursive recent as (select distinct team_id, season_id from merge_runs where last_checked >= 3), n as (select player_id, count(*) as n from (select player_id from merge_batting union all select player_id from merge_pitching union all select player_id from merge_season_batting union all select player_id from merge_season_pitching) as r group by all),
    r as (select team_id, season_id, player_id, lower(first_name) as f, lower(substring(last_name, 1, 8)) as l, coalesce(n, 0) as n from merge_rosters semi join recent using (team_id, season_id) join merge_players using (player_id) left join n using (player_id)),
    pairs as (select distinct case when (-length(a.f), -a.n, a.player_id) < (-length(b.f), -b.n, b.player_id) then a.player_id else b.player_id end as canonical_id, case when (-length(a.f), -a.n, a.player_id) < (-length(b.f), -b.n, b.player_id) then b.player_id else a.player_id end as duplicate_id
        from r as a join r as b on a.team_id = b.team_id and a.season_id = b.season_id and a.l = b.l and a.player_id < b.player_id and (starts_with(a.f, b.f) or starts_with(b.f, a.f)) and a.f <> '' and b.f <> ''),
    one as (select duplicate_id, min(canonical_id) as canonical_id from pairs group by all),
    walk as (select duplicate_id, canonical_id from one union all select w.duplicate_id, one.canonical_id from walk as w join one on one.duplicate_id = w.canonical_id),
    names as (select * from walk where canonical_id not in (select duplicate_id from one))
    select duplicate_id, canonical_id from names""")  # fmt: skip
def merge_recent(t):
    players = t("merge_players").withColumn("last_name", F.substring("last_name", 1, 8))
    return merges.dedupe_recent(_snapshot(t) | {"players": players}, t("merge_runs"), F.lit(3))[1]


# teams

_TEAM_NAMES = """asked as (select p.duplicate_id, p.canonical_id, case when p.canonical_id = p.duplicate_id then 'same team' when c.id is null then 'no canonical team' when d.id is null then 'no duplicate team' when d.membership_type = 'member' then 'duplicate is a member' end as reason
        from team_pairs as p left join team_rows as c on c.id = p.canonical_id left join team_rows as d on d.id = p.duplicate_id),
    one as (select duplicate_id, canonical_id from asked where reason is null), two as (select o.duplicate_id, coalesce(p.canonical_id, o.canonical_id) as canonical_id from one as o left join one as p on p.duplicate_id = o.canonical_id),
    names as (select o.duplicate_id, coalesce(p.canonical_id, o.canonical_id) as canonical_id from two as o left join one as p on p.duplicate_id = o.canonical_id)"""


def _teams(t):
    tables = {"teams": t("team_rows"), "opponents": t("team_opponents"), "links": t("team_links"), "plays": t("team_plays"), "events": t("team_plays").select("game_id", "play_order", "perspective_team_id").withColumn("event_order", F.lit(0))}
    return merges.merge_teams(tables, t("team_pairs"))


@query("team_merge_refused", f"with {_TEAM_NAMES} select * from asked where reason is not null")
def team_merge_refused(t):
    return _teams(t)[1]


@query("team_merge_rows", f"""with {_TEAM_NAMES} select id, name, membership_type, coalesce(gc_uuid, (select arg_min(x.gc_uuid, x.id) from team_rows as x join names on duplicate_id = x.id where canonical_id = r.id and x.gc_uuid is not null)) as gc_uuid,
    coalesce(public_id, (select arg_min(x.public_id, x.id) from team_rows as x join names on duplicate_id = x.id where canonical_id = r.id and x.public_id is not null)) as public_id from team_rows as r where id not in (select duplicate_id from names)""")  # fmt: skip
def team_merge_rows(t):
    return _teams(t)[0]["teams"]


def _moved(column: str) -> str:
    return f"coalesce((select canonical_id from names where duplicate_id = {column}), {column})"


@query("team_merge_opponents", f"with {_TEAM_NAMES} select distinct {_moved('our_team_id')} as our_team_id, {_moved('opponent_team_id')} as opponent_team_id from team_opponents where {_moved('our_team_id')} <> {_moved('opponent_team_id')}")
def team_merge_opponents(t):
    return _teams(t)[0]["opponents"]


@query("team_merge_links", f"""with {_TEAM_NAMES}, m as (select {_moved('our_team_id')} as our, root_team_id, {_moved('resolved_team_id')} as resolved, our_team_id, resolved_team_id from team_links)
    select our as our_team_id, root_team_id, resolved as resolved_team_id from m where not coalesce(our = resolved and (our <> our_team_id or resolved <> resolved_team_id), false) qualify row_number() over (partition by our, root_team_id order by our <> our_team_id, our_team_id) = 1""")  # fmt: skip
def team_merge_links(t):
    return _teams(t)[0]["links"]


_PLAYS = f"""m as (select game_id, play_order, {_moved('perspective_team_id')} as seen, {_moved('batting_team_id')} as bats, perspective_team_id as was from team_plays),
    left_ as (select * from m qualify row_number() over (partition by game_id, play_order, seen order by seen <> was, was) = 1)"""


@query("team_merge_plays", f"with {_TEAM_NAMES}, {_PLAYS} select game_id, play_order, seen as perspective_team_id, bats as batting_team_id from left_")
def team_merge_plays(t):
    return _teams(t)[0]["plays"]


@query("team_merge_events", f"with {_TEAM_NAMES}, {_PLAYS} select game_id, play_order, seen as perspective_team_id, 0 as event_order from left_")
def team_merge_events(t):
    return _teams(t)[0]["events"]
