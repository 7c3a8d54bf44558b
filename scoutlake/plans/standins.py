"""The domain's tables, made from the driver's. One text serves Spark and the oracle; `{orders}` stands for the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS = {
    "teams": "select cast(n_nationkey as bigint) as id, n_name as name from {nation}",
    "games": """
        select o_orderkey as game_id, cast(extract(year from o_orderdate) as bigint) as season_id, cast(o_orderdate as date) as game_date,
            case when o_orderkey % 5 = 0 then null else cast(10 + o_orderkey % 9 as string) end as start_time,
            case when o_orderstatus = 'F' then 'completed' else 'scheduled' end as status,
            cast(c_nationkey as bigint) as home_team_id, cast((c_nationkey + 1 + o_orderkey % 24) % 25 as bigint) as away_team_id,
            case when o_orderkey % 17 = 0 then null else cast(o_orderkey % 11 as bigint) end as home_score, cast(o_custkey % 10 as bigint) as away_score
        from {orders} join {customer} on o_custkey = c_custkey""",
    "pitching": """
        select l_orderkey as game_id, cast(o_orderdate as date) as game_date,
            case when o_orderkey % 5 = 0 then null else cast(10 + o_orderkey % 9 as string) end as start_time,
            case when o_orderstatus = 'F' then 'completed' else 'scheduled' end as status,
            cast(extract(year from o_orderdate) as bigint) as season_id, cast(s_nationkey as bigint) as team_id,
            cast(case when l_linenumber % 4 = 0 then (s_nationkey + 1) % 25 else s_nationkey end as bigint) as perspective_team_id,
            l_suppkey as player_id, case when l_suppkey % 3 = 0 then null else cast(l_linenumber as bigint) end as appearance_order,
            cast(l_quantity as bigint) % 22 as ip_outs, l_partkey % 9 as so, l_partkey % 5 as bb, (l_partkey + l_linenumber) % 8 as h, l_partkey % 4 as er,
            case when l_quantity = 13 then null else 2 * cast(l_quantity as bigint) end as pitches, cast(l_quantity as bigint) as total_strikes,
            l_partkey * 10 + l_linenumber as seq
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey""",
    "batting": """
        select l_orderkey as game_id, cast(o_orderdate as date) as game_date, cast(extract(year from o_orderdate) as bigint) as season_id,
            cast(c_nationkey as bigint) as team_id, cast(case when l_linenumber % 4 = 0 then (c_nationkey + 1) % 25 else c_nationkey end as bigint) as perspective_team_id,
            o_custkey as player_id, cast(l_quantity as bigint) % 6 as ab, l_partkey % 4 as h, l_partkey % 2 as doubles, l_suppkey % 2 as triples, (l_partkey + l_suppkey) % 3 as hr,
            l_partkey % 5 as rbi, l_suppkey % 3 as bb, l_partkey % 3 as so, case when l_partkey % 7 = 0 then null else l_suppkey % 2 end as hbp,
            case when l_linenumber = 2 then null else cast(l_linenumber % 2 as bigint) end as shf
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey""",
    "pitchers": "select s_suppkey as player_id, 'P' || cast(s_suppkey % 7 as string) as first_name, s_name as last_name from {supplier}",
    "batters": "select c_custkey as player_id, 'B' || cast(c_custkey % 7 as string) as first_name, c_name as last_name from {customer}",
    "plays": """
        select user_id as game_id, user_id % 25 as perspective_team_id, event_id as play_order, case when event_id % 2 = 0 then 'top' else 'bottom' end as half,
            user_id % 25 as batting_team_id, event_id % 40 as batter_id, case when event_id % 13 = 0 then null else user_id * 10 + event_id % 3 end as pitcher_id,
            case event_id % 9 when 0 then 'Single' when 1 then 'Strikeout' when 2 then 'Walk' when 3 then 'Fly Out' when 4 then 'Double' when 5 then 'Ground Out'
                when 6 then 'Hit By Pitch' when 7 then 'Home Run' else 'Intentional Walk' end as outcome,
            1 + event_id % 8 as pitch_count, event_id % 2 as is_first_pitch_strike, case when event_id % 3 = 0 then 1 else 0 end as is_qab,
            case when event_id % 3 = 1 then 1 else 0 end as did_outs_change, event_id % 4 as strikes
        from {events}""",
    "balls": """
        select user_id as player_id, case event_type when 'click' then 'single' when 'purchase' then 'home_run' when 'view' then 'out' else event_type end as play_result,
            case when event_id % 11 = 0 then null else cast(100 + event_id % 131 as double) end as x, cast(60 + event_id % 173 as double) as y
        from {events}""",
}

#: Plate appearances of a game with their true pitchers: nth of the half-inning side, k the pitcher's number.
_TRUE = """(select *, case when 2 * n <= m then 0 when 4 * n <= 3 * m then 1 else 2 end as k, case when half = 'top' then home else away end as throws, case when half = 'top' then away else home end as bats,
            case (event_id * 7 + user_id) % 13 when 0 then 'Single' when 1 then 'Strikeout' when 2 then 'Walk' when 3 then 'Fly Out' when 4 then 'Double' when 6 then 'Hit By Pitch' when 7 then 'Home Run' when 8 then 'Intentional Walk'
                when 9 then 'Sacrifice Fly' when 10 then 'Dropped 3rd Strike' when 11 then 'Triple' else 'Ground Out' end as outcome
        from (select user_id, event_id, user_id % 25 as home, (user_id + 7) % 25 as away, case when event_id % 2 = 0 then 'top' else 'bottom' end as half,
            row_number() over (partition by user_id, event_id % 2 order by event_id) as n, count(*) over (partition by user_id, event_id % 2) as m from {events}) as e) as t"""
_SEEN = "(select 0 as away_sees union all select 1 as away_sees) as seen"
_SEES = "(away_sees = 0 or user_id % 3 = 0)"
_SEER = "case when away_sees = 1 then away else home end as perspective_team_id"

VIEWS |= {
    "recon_games": """
        select distinct user_id as game_id, user_id % 25 as home_team_id, (user_id + 7) % 25 as away_team_id, case when user_id % 11 = 3 then null else user_id % 9 end as home_score, user_id % 6 as away_score
        from {events} where user_id % 29 <> 5""",
    "recon_plays": f"""
        select user_id as game_id, {_SEER}, event_id as play_order, half, bats as batting_team_id, case when event_id % 31 = 0 then null else bats * 1000 + n % 9 end as batter_id,
            case when user_id % 4 = 2 and n % 9 = 0 then null when user_id % 4 = 3 and n % 10 = 3 then throws * 100 + 7 when user_id % 4 <> 1 then throws * 100 + k
                when 2 * (n - 2) <= m then throws * 100 when 4 * (n - 2) <= 3 * m then throws * 100 + 1 else throws * 100 + 2 end as pitcher_id,
            outcome, 1 + event_id % 6 as pitch_count, case when outcome like '%Out' or outcome in ('Strikeout', 'Sacrifice Fly') then 1 else 0 end as did_outs_change
        from {_TRUE}, {_SEEN} where {_SEES}""",
    "recon_events": f"""
        select user_id as game_id, {_SEER}, event_id as play_order, j as event_order, case (event_id + j) % 5 when 0 then 'strike_looking' when 1 then 'ball' when 2 then 'foul' when 3 then 'in_play' end as pitch_result,
            case when (event_id + j) % 5 < 4 then null when event_id % 17 = 0 then 'Runner advances on Wild Pitch' else 'Runner steals' end as template
        from {_TRUE}, {_SEEN}, (select 0 as j union all select 1 as j union all select 2 as j) as js where {_SEES}""",
    "recon_pitching": f"""
        select user_id as game_id, {_SEER}, throws as team_id, throws * 100 + k as player_id, case when c_nationkey % 7 = 3 then null else cast(k + 1 as bigint) end as appearance_order,
            cast(count(*) + case when c_nationkey % 5 = 2 and k = 2 then 1 else 0 end as bigint) as bf, cast(sum(case when outcome like '%Out' or outcome in ('Strikeout', 'Sacrifice Fly') then 1 else 0 end) as bigint) as ip_outs,
            cast(sum(case when outcome in ('Strikeout', 'Dropped 3rd Strike') then 1 else 0 end) + case when c_nationkey % 5 = 0 and k = 1 then 1 else 0 end as bigint) as so, cast(sum(case when outcome in ('Walk', 'Intentional Walk') then 1 else 0 end) as bigint) as bb,
            cast(sum(case when outcome = 'Hit By Pitch' then 1 else 0 end) as bigint) as hbp, cast(sum(case when outcome in ('Single', 'Double', 'Triple', 'Home Run') then 1 else 0 end) as bigint) as h,
            case when c_nationkey % 5 = 1 then null else cast(sum(1 + event_id % 6) + c_nationkey % 3 as bigint) end as pitches, cast(sum(case when event_id % 5 in (0, 4) then 1 else 2 end) as bigint) as total_strikes,
            cast(sum(case when event_id % 17 = 0 then 1 else 0 end) as bigint) as wp, cast(case when user_id % 5 = 0 then 10 - k else k end as bigint) as seq
        from {_TRUE} join {{customer}} on c_custkey = user_id + 1, {_SEEN} where {_SEES} group by user_id, home, away, away_sees, throws, k, c_nationkey
        union all select c_custkey - 1, case when away_sees = 1 then (c_custkey + 6) % 25 else (c_custkey - 1) % 25 end, (c_custkey - 1) % 25, (c_custkey - 1) % 25 * 100 + case when c_nationkey % 6 = 5 then 5 else 0 end, 9, 0, 1, 1, 0, 0, 0, null, 3, null, 90
        from {{customer}}, {_SEEN} where (away_sees = 0 or (c_custkey - 1) % 3 = 0) and (c_nationkey % 6 = 5 or c_custkey % 23 = 4)""",
    "recon_batting": f"""
        select user_id as game_id, {_SEER}, bats as team_id, bats * 1000 + n % 9 as player_id,
            cast(sum(case when outcome in ('Walk', 'Hit By Pitch', 'Sacrifice Fly', 'Intentional Walk') then 0 else 1 end) as bigint) as ab, cast(sum(case when outcome in ('Single', 'Double', 'Triple', 'Home Run') then 1 else 0 end) as bigint) as h,
            case when c_nationkey % 4 = 1 and n % 9 = 2 then null else cast(sum(case when outcome in ('Strikeout', 'Dropped 3rd Strike') then 1 else 0 end) as bigint) end as so, cast(sum(case when outcome in ('Walk', 'Intentional Walk') then 1 else 0 end) as bigint) as bb, cast(c_nationkey % 2 as bigint) as hbp
        from {_TRUE} join {{customer}} on c_custkey = user_id + 1, {_SEEN} where {_SEES} and n % 9 <> user_id % 10 group by user_id, home, away, away_sees, bats, n % 9, c_nationkey""",
}

_SUPPLIED = "{lineitem} join {orders} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey"
_SEEN_BY = "cast(case when l_partkey % 3 = 0 then (s_nationkey + 1) % 25 else s_nationkey end as bigint)"
_COMPLETE = "case max(l_linenumber) % 3 when 0 then 'full' when 1 then 'boxscore_only' else 'supplemented' end"
VIEWS |= {
    # suppliers as players, three neighbours being one: the first is canonical, the third a duplicate of the second
    "merge_pairs": "select s_suppkey as duplicate_id, s_suppkey - 1 as canonical_id from {supplier} where s_suppkey % 3 > 0",
    "merge_players": "select s_suppkey as player_id, case s_suppkey % 4 when 0 then 'Unknown' when 1 then 'Jo' when 2 then 'Joan' else 'J' end as first_name, case when s_suppkey % 5 = 0 then null else substring(s_name, 1, 9 + cast(s_suppkey % 7 as int)) end as last_name from {supplier}",
    "merge_rosters": "select s_suppkey as player_id, cast(case when s_suppkey % 2 = 0 then s_nationkey else 3 end as bigint) as team_id, y as season_id, cast(s_suppkey % 99 as string) as jersey_number from {supplier}, (select 1995 as y union all select 1996 as y) as years",
    "merge_batting": f"""
        select l_orderkey as game_id, l_suppkey as player_id, cast(s_nationkey as bigint) as team_id, {_SEEN_BY} as perspective_team_id, {_COMPLETE} as stat_completeness,
            {", ".join(f"cast(sum((l_partkey + {i}) % {m}) as bigint) as {c}" for i, (c, m) in enumerate({"ab": 6, "h": 4, "doubles": 2, "triples": 2, "hr": 2, "rbi": 5, "r": 3, "bb": 3, "so": 4, "hbp": 2, "sb": 3, "cs": 2, "tb": 7}.items()))}, cast(sum(case when l_partkey % 4 = 0 then null else 1 end) as bigint) as shf
        from {_SUPPLIED} where l_linenumber % 2 = 1 group by l_orderkey, l_suppkey, s_nationkey, {_SEEN_BY}""",
    "merge_pitching": f"""
        select l_orderkey as game_id, l_suppkey as player_id, cast(s_nationkey as bigint) as team_id, {_SEEN_BY} as perspective_team_id, {_COMPLETE} as stat_completeness,
            {", ".join(f"cast(sum((l_partkey + {i}) % {m}) as bigint) as {c}" for i, (c, m) in enumerate({"ip_outs": 9, "h": 4, "r": 3, "er": 2, "bb": 3, "so": 5, "wp": 2, "hbp": 2, "pitches": 40, "total_strikes": 30, "bf": 8}.items()))}, case max(l_partkey) % 5 when 0 then 'W' when 1 then 'L' when 2 then 'SV' end as decision
        from {_SUPPLIED} where l_linenumber % 2 = 0 group by l_orderkey, l_suppkey, s_nationkey, {_SEEN_BY}""",
    "merge_season_batting": """
        select s_suppkey as player_id, cast(case when s_suppkey % 2 = 0 then s_nationkey else 3 end as bigint) as team_id, y as season_id, 'full' as stat_completeness, cast(-1 as bigint) as games_tracked, cast(7 as bigint) as gp, cast(40 as bigint) as pa,
            cast(30 as bigint) as ab, cast(9 as bigint) as h, cast(5 as bigint) as singles, cast(2 as bigint) as doubles, cast(1 as bigint) as triples, cast(1 as bigint) as hr, cast(5 as bigint) as rbi, cast(6 as bigint) as r, cast(s_suppkey as bigint) as bb, cast(3 as bigint) as so, cast(1 as bigint) as hbp,
            cast(2 as bigint) as shf, cast(0 as bigint) as sb, cast(0 as bigint) as cs, cast(17 as bigint) as tb, cast(4 as bigint) as xbh from {supplier}, (select 1995 as y union all select 1999 as y) as years""",
    "merge_season_pitching": """
        select s_suppkey as player_id, cast(s_nationkey as bigint) as team_id, y as season_id, 'full' as stat_completeness, cast(-1 as bigint) as games_tracked, cast(7 as bigint) as gp_pitcher, cast(40 as bigint) as ip_outs, cast(30 as bigint) as h, cast(9 as bigint) as r, cast(5 as bigint) as er, cast(2 as bigint) as bb,
            cast(s_suppkey as bigint) as so, cast(1 as bigint) as wp, cast(1 as bigint) as hbp, cast(5 as bigint) as pitches, cast(6 as bigint) as total_strikes, cast(3 as bigint) as bf, cast(1 as bigint) as w, cast(0 as bigint) as l, cast(0 as bigint) as sv from {supplier}, (select 1996 as y union all select 1999 as y) as years""",
    "merge_runs": "select cast(n_nationkey as bigint) as team_id, y as season_id, cast(n_nationkey * 3 % 7 as bigint) as last_checked from {nation}, (select 1995 as y union all select 1996 as y) as years",
    # nations as teams, those from 12 on duplicates of lower ones; some pairs are refused
    "team_pairs": "select cast(n_nationkey as bigint) as duplicate_id, cast(case when n_nationkey = 13 then 99 else n_nationkey - 6 end as bigint) as canonical_id from {nation} where n_nationkey >= 12 union all select 77, 1 union all select 3, 3",
    "team_rows": "select cast(n_nationkey as bigint) as id, n_name as name, case when n_nationkey = 15 then 'member' else 'tracked' end as membership_type, case when n_nationkey % 4 = 0 then null else 'u' || cast(n_nationkey as string) end as gc_uuid, case when n_nationkey % 3 = 0 then null else 's' || cast(n_nationkey as string) end as public_id from {nation}",
    "team_opponents": "select distinct cast(c_nationkey as bigint) as our_team_id, cast((c_nationkey + c_custkey % 11) % 25 as bigint) as opponent_team_id from {customer} where c_custkey % 11 > 0",
    "team_links": "select cast(c_nationkey as bigint) as our_team_id, c_custkey % 10 as root_team_id, cast(max(case when c_custkey % 4 = 0 then null else (c_nationkey + c_custkey) % 25 end) as bigint) as resolved_team_id from {customer} group by c_nationkey, c_custkey % 10",
    "team_plays": "select distinct user_id as game_id, cast(event_id % 40 as bigint) as play_order, cast(case when event_id % 2 = 0 then user_id % 25 else (user_id + 6) % 25 end as bigint) as perspective_team_id, cast((user_id + 6 * (event_id % 40 % 2)) % 25 as bigint) as batting_team_id from {events}",
}

VIEWS |= {
    # short seasons, so that there are many kinds of rotations
    "predict_pitching": """
        select l_orderkey as game_id, cast(o_orderdate as date) as game_date, case when o_orderkey % 5 = 0 then null else cast(10 + o_orderkey % 9 as string) end as start_time, case when o_orderkey % 8 = 3 then 'scheduled' else 'completed' end as status,
            cast(extract(year from o_orderdate) * 10 + o_orderkey % 7 as bigint) as season_id, cast(s_nationkey as bigint) as team_id, cast(case when l_partkey % 6 = 0 then (s_nationkey + 1) % 25 else s_nationkey end as bigint) as perspective_team_id,
            cast(s_nationkey * 10 + case when l_partkey % 4 < 2 then 0 else l_partkey % 4 + l_linenumber % 2 end as bigint) as player_id, case when s_nationkey % 4 = 1 then null else cast(l_linenumber as bigint) end as appearance_order,
            cast(l_quantity as bigint) % 22 as ip_outs, l_partkey % 19 as so, l_partkey % 5 as bb, case when l_quantity = 13 then null else 2 * cast(l_quantity as bigint) end as pitches, case l_partkey % 6 when 0 then 'W' when 1 then 'L' end as decision, l_partkey * 10 + l_linenumber as seq
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey""",
    "predict_players": "select cast(n_nationkey * 10 + k as bigint) as player_id, case when k = 3 then null else 'P' || cast(k as string) end as first_name, n_name as last_name from {nation}, (select 0 as k union all select 1 as k union all select 2 as k union all select 3 as k union all select 4 as k) as ks",
    "predict_asked": """
        select cast(n_nationkey as bigint) as team_id, cast(y * 10 + k as bigint) as season_id, cast(cast(y as string) || case when k % 2 = 0 then '-12-01' else '-03-20' end as date) as reference,
            case n_nationkey % 7 when 3 then 'nsaa_subvarsity' when 4 then 'legion' when 5 then 'usssa' when 6 then case when k = 0 then 'unknown' else 'other' end else 'nsaa_varsity' end as league
        from {nation}, (select 1992 as y union all select 1993 as y union all select 1994 as y union all select 1995 as y union all select 1996 as y union all select 1997 as y union all select 1998 as y) as ys,
            (select 0 as k union all select 1 as k union all select 2 as k union all select 3 as k union all select 4 as k union all select 5 as k union all select 6 as k union all select 7 as k) as ks""",
    "league_teams": """
        select p_partkey as id, case p_size % 6 when 0 then 'hs' when 1 then 'legion' when 2 then '' when 3 then 'travel' when 4 then 'usssa' end as program_type, case p_partkey % 4 when 0 then 'jv' when 1 then 'varsity' when 2 then 'reserve' end as classification,
            case p_partkey % 9 when 0 then '["usssa"]' when 1 then '["Perfect_Game", "NFHS"]' when 2 then '[]' when 3 then 'usssa' when 4 then '["other", 5]' when 5 then '["american_legion", "usssa"]' when 6 then '["nsaa"]' end as ngb,
            case p_partkey % 5 when 0 then '14U' when 1 then 'High School' when 2 then 'u14' end as age_group,
            case p_partkey % 11 when 0 then 'Lincoln JV' when 1 then 'Post 12 Reds' when 2 then 'Omaha Seniors' when 3 then '12u Juniors' when 4 then 'East Varsity' when 5 then 'West Junior  Varsity' when 6 then 'Sophomores' when 7 then 'American Legion' when 8 then 'Frosh Reserve' when 9 then p_name end as name
        from {part}""",
}

VIEWS |= {
    # customers as teams: several have one name, a tenth are members
    "link_teams": "select c_custkey as id, 'T' || cast(c_custkey % 40 as string) as name, case when c_custkey % 10 = 0 then 'member' else 'tracked' end as membership_type, case when c_custkey % 3 = 0 or c_custkey % 7 = 1 then null else 's' || cast(c_custkey as string) end as public_id, case when c_custkey % 5 = 0 then null else 'u' || cast(c_custkey as string) end as gc_uuid, case when c_custkey % 20 = 0 then null else cast(2024 + c_custkey % 2 as bigint) end as season_year, cast(c_nationkey % 2 as bigint) as is_active from {customer}",
    "link_opponents": "select cast(10 + 10 * (c_custkey % 9) as bigint) as our_team_id, c_custkey as opponent_team_id, case when c_custkey % 4 = 0 then null else cast(2020 + c_custkey % 4 as bigint) end as first_seen_year from {customer} where c_custkey % 10 > 0",
    "link_rows": "select o_orderkey as id, cast(10 + 10 * (o_orderkey % 12) as bigint) as our_team_id, o_orderkey as root_team_id, 'T' || cast(o_custkey % 43 as string) as opponent_name, cast(0 as bigint) as is_hidden, case when o_orderkey % 3 = 0 then 's' || cast(o_custkey as string) end as public_id, case o_orderkey % 3 when 0 then 'manual' when 1 then 'auto' end as resolution_method, case when o_orderkey % 3 < 2 then o_custkey end as resolved_team_id, case when o_orderkey % 3 < 2 then 'before' end as resolved_at from {orders}",
    "link_requests": "select s_suppkey as seq, s_suppkey * 3 + 3 as link_id, 's' || cast(s_suppkey * 7 % 200 + 2 as string) as public_id, cast(10 + 10 * (s_suppkey % 9) as bigint) as our_team_id, 'T' || cast(case when s_suppkey % 4 = 0 then 90 + s_suppkey else s_suppkey * 11 % 40 end as string) as opponent_name from {supplier}",
    "link_games": "select o_orderkey as game_id, o_custkey as home_team_id, cast(1 + o_custkey * 7 % 140 as bigint) as away_team_id, case when o_orderkey % 4 > 0 then cast(o_orderkey % 50 as string) end as game_stream_id from {orders}",
    "link_perspectives": "select distinct o_orderkey % 500 as game_id, o_custkey as perspective_team_id from {orders}",
    "link_feed": "select o_orderkey as seq, cast(10 + 10 * (o_orderkey % 12) as bigint) as our_team_id, o_orderkey + case when o_orderkey % 6 = 5 then 9000000 else 0 end as root_team_id, 'T' || cast(o_custkey % 43 as string) as name, case when o_orderkey % 4 < 2 then null else 'u' || cast(o_custkey % 170 as string) end as progenitor_team_id, o_orderkey % 11 = 0 as is_hidden from {orders} where o_orderpriority <> '5-LOW'",
    "link_details": "select 'u' || cast(c_custkey as string) as progenitor_team_id, case when c_custkey % 4 = 0 then null else 's' || cast(c_custkey as string) end as public_id, case when c_custkey % 9 = 0 then null else 'T' || cast(c_custkey % 40 as string) end as name, cast(2024 + c_custkey % 3 as bigint) as season_year from {customer} where c_custkey % 8 > 0",
    "link_hits": "select 'T' || cast(s_suppkey % 43 as string) as query, 'v' || cast(s_suppkey as string) as gc_uuid, 's' || cast(s_suppkey + 30 as string) as public_id, case when s_suppkey % 5 = 0 then 'Team' else 't' || cast(s_suppkey % 43 as string) end as name, case when s_suppkey % 7 = 0 then null else cast(2024 + s_suppkey % 2 as bigint) end as season_year from {supplier}",
}

VIEWS |= {
    "gone_reports": "select s_suppkey as slug, cast(s_nationkey as bigint) as team_id, s_acctbal < 6000 as dropped from {supplier}",
    "gone_links": "select cast(n_nationkey as bigint) as id, cast(case when n_nationkey = 24 then 23 else n_regionkey end as bigint) as our_team_id, cast(n_regionkey + 5 as bigint) as resolved_team_id, 'auto' as resolution_method, 'x' as resolved_at from {nation}",
    "gone_access": "select cast(r_regionkey as bigint) as user_id, cast(r_regionkey + 10 as bigint) as team_id from {region}",
    "gone_teams": "select cast(n_nationkey as bigint) as id, 'tracked' as membership_type from {nation}",
    "ball_teams": "select cast(n_nationkey as bigint) as id, 'u' || cast(n_nationkey as string) as gc_uuid from {nation} where n_nationkey <> 5",
    "ball_rosters": "select cast(c_custkey % 60 as bigint) as player_id, cast(c_nationkey as bigint) as team_id, cast(2024 + c_custkey % 2 as bigint) as season_id from {customer} where c_custkey % 4 = 0",
    "ball_events": """
        select event_id as seq, user_id as game_id, 'u' || cast(case event_id % 7 when 0 then (user_id + 7) % 25 when 1 then (user_id + 3) % 25 else user_id % 25 end as string) as gc_uuid, cast(2024 + user_id % 2 as bigint) as season_id, case when event_id % 3 = 0 then 'defense' else 'offense' end as section,
            event_id % 60 as player_id, case when event_id % 23 = 0 then null when event_id % 29 = 0 then '' else 'e' || cast(event_id % 900 as string) end as event_id, event_id * 1000 as created_at_ms, event_type as play_result, case when event_id % 2 = 0 then 'line_drive' end as play_type,
            event_id % 8 > 0 as fielded, case when event_id % 19 = 0 then null else value end as x, case when event_id % 31 = 0 then null else value + 1 end as y, case when event_id % 4 = 0 then 'SS' end as fielder_position, cast(case when event_id % 6 = 0 then 1 when event_id % 6 = 1 then 0 end as bigint) as error
        from {events}""",
    "ball_old": "select c_custkey as game_id, cast(c_custkey % 25 as bigint) as perspective_team_id, 'e' || cast(c_custkey * 3 % 900 as string) as event_id from {customer} where c_custkey % 5 = 0",
    "season_wanted": "select c_custkey as user_id, case when c_custkey % 3 = 0 then cast(c_custkey % 25 as bigint) end as team_id, case when c_custkey % 4 > 1 then cast(2020 + c_custkey % 7 as bigint) end as year from {customer}",
    "season_permitted": "select c_custkey as user_id, cast(k as bigint) as place, cast((c_custkey * 3 + k * 5) % 25 as bigint) as team_id, case when (c_custkey + k) % 4 = 0 then null else cast(2020 + (c_custkey * k) % 6 as bigint) end as year from {customer}, (select 0 as k union all select 1 as k union all select 2 as k) as ks where c_custkey % 3 >= k",
    "team_seasons": "select cast(n_nationkey as bigint) as team_id, cast(y as string) || case when n_regionkey % 2 = 0 then '-spring-hs' else '-summer-legion' end as season_id from {nation}, (select 2020 as y union all select 2022 as y union all select 2023 as y union all select 2024 as y) as ys where n_nationkey % 6 > 0",
}

VIEWS |= {
    "page_players": "select s_suppkey as player_id, case s_suppkey % 4 when 0 then 'Unknown' when 1 then 'Jo' else 'Joan' end as first_name, case when s_suppkey % 8 = 0 then 'Unknown' when s_suppkey % 5 = 0 then null else substring(s_name, 12, 7) end as last_name from {supplier} where s_suppkey % 11 > 0",
    "page_games": "select l_orderkey as game_id, cast(extract(year from min(o_orderdate)) as bigint) as season_id, cast(min(o_orderdate) as date) as game_date, case when l_orderkey % 5 = 0 then null else cast(10 + l_orderkey % 9 as string) end as start_time, cast(min(s_nationkey) as bigint) as home_team_id, cast(max(s_nationkey) as bigint) as away_team_id, case when l_orderkey % 17 = 0 then null else l_orderkey % 11 end as home_score, l_orderkey % 7 as away_score from {lineitem} join {orders} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey group by l_orderkey",
    "page_teams": "select cast(n_nationkey as bigint) as id, n_name as name from {nation} where n_nationkey % 9 > 0",
}

VIEWS |= {
    "typed_balls": """
        select event_id, user_id as player_id, user_id % 25 as team_id, cast(2020 + (user_id * 7 + event_id) % 4 as bigint) as season_id, cast(case when event_id % 5 = 0 then 99 else user_id % 25 end as bigint) as perspective_team_id, case event_type when 'click' then 'single' when 'purchase' then 'home_run' when 'view' then 'dropped_third_strike' else 'out' end as play_result,
            case event_id % 10 when 0 then 'ground_ball' when 1 then 'hard_ground_ball' when 2 then 'line_drive' when 3 then 'hard_line_drive' when 4 then 'fly_ball' when 5 then 'popup' when 6 then 'pop_fly' when 7 then 'bunt' when 8 then 'other' end as play_type,
            case when event_id % 11 = 0 then null else cast(100 + event_id % 131 as double) end as x, cast(60 + event_id % 173 as double) as y from {events}""",
    "summaries": "select o_orderkey as game_id, case o_orderkey % 3 when 0 then 'home' when 1 then 'away' end as home_away, o_custkey as own_team_id, o_custkey + 1 as opponent_team_id, o_orderkey % 9 as own_score, case when o_orderkey % 5 = 0 then null else o_custkey % 7 end as opponent_score from {orders}",
    "box_teams": """
        select c_custkey as id, case when c_custkey % 4 = 0 then null else upper('00000000-0000-0000-0000-' || lpad(cast(c_custkey as string), 12, '0')) end as own_uuid, '00000000-0000-0000-0000-' || lpad(cast(c_custkey as string), 12, '0') as one,
            case when c_custkey % 3 = 0 then 'slug' || cast(c_custkey as string) else '00000000-0000-0000-0000-' || lpad(cast(c_custkey + case when c_custkey % 5 = 0 then 0 else 1 end as string), 12, '0') end as two from {customer}""",
    "new_names": "select o_orderkey as seq, case o_orderkey % 5 when 0 then upper(c_name) when 1 then 'New ' || cast(o_custkey % 50 as string) when 2 then 'NEW ' || cast(o_custkey % 50 as string) when 3 then null else '  ' end as name from {orders} join {customer} on o_custkey = c_custkey",
    "programs": "select cast(r_regionkey as bigint) as id, case r_regionkey when 0 then 'hs' when 1 then 'legion' when 2 then null else 'usssa' end as program_type from {region}",
}


def sql(text: str) -> str:
    """A query over the stand-ins, for the oracle: `with` the ones that it names."""
    used = [n for n in VIEWS if f" {n}" in text.replace("\n", " ")]
    names = {t: t for t in TABLES}
    own = ", ".join(f"{n} as ({VIEWS[n].format(**names)})" for n in used)
    rest = text.strip()
    if used and rest.startswith("with recursive "):
        return f"with recursive {own}, {rest[15:]}"
    return f"with {own}, {rest[5:]}" if used and rest.startswith("with ") else f"with {own} {rest}" if used else text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in, or a table of the driver."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)
