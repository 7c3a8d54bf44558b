"""The queries by name, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutlake.functions import rates, text
from scoutlake.operators import batting, games, identity, links, pitching, plays, spray, tables, text_scan
from scoutlake.plans import intakes, linked, merging, pages, predicting, reconciliation, upkeep  # noqa: F401  they register their queries
from scoutlake.plans.catalog import QUERIES, REFERENCE_DAY, SQL, query  # noqa: F401
from scoutlake.plans.catalog import day as _day

_OWN = "perspective_team_id = team_id"
_SIDES = """(select home_team_id as team_id, away_team_id as opponent_id, true as is_home, home_score as scored, away_score as allowed, game_id, season_id, game_date, start_time, status from games
    union all select away_team_id, home_team_id, false, away_score, home_score, game_id, season_id, game_date, start_time, status from games) as sides"""
_RESULT = "case when scored is null or allowed is null then '-' when scored > allowed then 'W' when scored < allowed then 'L' else 'T' end"
_HISTORY = f"""(select *, date_diff('day', lag(game_date) over (partition by team_id, season_id, player_id order by game_date, start_time nulls last, game_id, seq), game_date) as rest_days,
    dense_rank() over (partition by team_id, season_id order by game_date, start_time nulls last) as team_game_number,
    max(appearance_order) over (partition by team_id, season_id, player_id) as any_order,
    row_number() over (partition by team_id, season_id, game_id order by ip_outs desc, seq, player_id) as by_outs
    from pitching where {_OWN} and status = 'completed') as history"""
_STARTS = f"(select *, case when any_order is not null then coalesce(appearance_order = 1, false) else by_outs = 1 and ip_outs > 0 end as is_start from {_HISTORY}) as marked"
_START_REST = f"""(select *, date_diff('day', lag(game_date) over (partition by team_id, season_id, player_id, is_start order by game_date, start_time nulls last, game_id, seq), game_date) as between_starts from {_STARTS}) as rested"""
_PROFILES = f"""(select team_id, season_id, player_id, count(*) as games, sum(ip_outs)::bigint as ip_outs, sum(so)::bigint as so, sum(case when is_start then 1 else 0 end)::bigint as starts,
    avg(case when is_start then between_starts end) as mean_start_rest from {_START_REST} group by all) as profiles"""
_SEASON_BATTING = f"""(select *, ab + bb + hbp + shf as pa, doubles + triples + hr as xbh, h - doubles - triples - hr as singles from (
    select team_id, season_id, player_id, count(distinct game_id) as games, {", ".join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in batting.BATTING)} from batting where {_OWN} group by all) as sums) as season"""
_SEASON_PITCHING = f"""(select team_id, season_id, player_id, count(distinct game_id) as games, {", ".join(f"sum({c})::bigint as {c}" for c in batting.PITCHING)},
    case when max(appearance_order) is not null then sum(case when appearance_order = 1 then 1 else 0 end)::bigint end as gs from pitching where {_OWN} group by all) as season"""
_OBP, _SLG, _AVG = "(h + bb + hbp)::double / nullif(pa, 0)", "(h + doubles + 2 * triples + 3 * hr)::double / nullif(ab, 0)", "h::double / nullif(ab, 0)"


@query("workload_7d", f"""
    select team_id, season_id, player_id, max(game_date)::string as last_outing, date_diff('day', max(game_date), date '{REFERENCE_DAY}') as days_since,
        case when count(*) filter (inside) = 0 then 0 else sum(pitches) filter (inside) end::bigint as pitches_7d,
        date_diff('day', min(game_date) filter (inside), max(game_date) filter (inside)) + 1 as span_days,
        nullif(count(*) filter (inside), 0) as appearances_7d,
        case when count(*) filter (inside) > 0 then count(*) filter (inside and pitches is null) end as unknown_7d
    from (select *, game_date between date '{REFERENCE_DAY}' - 6 and date '{REFERENCE_DAY}' as inside from pitching where {_OWN}) as own group by all""")  # fmt: skip
def workload_7d(t):
    return pitching.workload(t("pitching"), _day())


@query("appearance_history", f"select team_id, season_id, player_id, game_id, seq, game_date::string as game_date, rest_days, team_game_number from {_HISTORY}")
def appearance_history(t):
    return pitching.history(t("pitching")).select("team_id", "season_id", "player_id", "game_id", "seq", "game_date", "rest_days", "team_game_number")


@query("start_intervals", f"select team_id, season_id, player_id, game_id, seq, game_date::string as game_date, between_starts as start_rest from {_START_REST} where is_start")
def start_intervals(t):
    return pitching.start_intervals(t("pitching")).select("team_id", "season_id", "player_id", "game_id", "seq", "game_date", "start_rest")


@query("pitcher_profiles", f"select *, so * 27.0::double / nullif(ip_outs, 0) as k9 from {_PROFILES}")
def pitcher_profiles(t):
    return pitching.profiles(t("pitching"))


@query("rest_table", f"""
    select team_id, season_id, player_id, starts, games, nth from (
        select *, row_number() over (partition by team_id, season_id order by as_starter desc, case when as_starter then starts end desc nulls last, games desc, player_id) as nth from (
            select *, starts > 0 and row_number() over (partition by team_id, season_id order by starts > 0 desc, starts desc, games desc, player_id) <= 2 as as_starter from {_PROFILES}) as a
        where as_starter or starts = 0) as b where nth <= 3""")  # fmt: skip
def rest_table(t):
    return pitching.rest_table(pitching.profiles(t("pitching")))


@query("run_density", f"""
    select team_id, season_id, max(n) as longest_run, max(n) >= 3 as is_dense from (
        select team_id, season_id, run, count(*) as n from (
            select *, sum(begins) over (partition by team_id, season_id order by game_date) as run from (
                select *, case when date_diff('day', lag(game_date) over (partition by team_id, season_id order by game_date), game_date) <= 1 then 0 else 1 end as begins from (
                    select distinct team_id, season_id, game_date, max(game_date) over (partition by team_id, season_id) as latest from {_SIDES}) as d
                where date_diff('day', game_date, latest) <= 7) as b) as r group by all) as n group by all""")  # fmt: skip
def run_density(t):
    return pitching.run_density(games.by_team(t("games")))


@query("pitch_eligibility", f"""
    select team_id, season_id, player_id, last_date::string as last_date, case when unknown = 0 then last_pitches end as last_pitches, rested, reason, reason is null as eligible from (
        select *, case when last_date > date '{REFERENCE_DAY}' then null when unknown > 0 then 'unknown pitches'
            when rested < case when last_pitches < 1 then 0 when last_pitches <= 30 then 0 when last_pitches <= 50 then 1 when last_pitches <= 70 then 2 when last_pitches <= 90 then 3 else 4 end then 'rest'
            when two_days >= 2 then 'consecutive days' end as reason from (
            select team_id, season_id, player_id, max(last) as last_date, sum(case when game_date = last then pitches end)::bigint as last_pitches,
                count(case when game_date = last and pitches is null then 1 end) as unknown,
                count(case when date_diff('day', game_date, date '{REFERENCE_DAY}') in (1, 2) then 1 end) as two_days, date_diff('day', max(last), date '{REFERENCE_DAY}') as rested
            from (select *, max(game_date) over (partition by team_id, season_id, player_id) as last from pitching where {_OWN} and status = 'completed') as own group by all) as made) as judged""")  # fmt: skip
def pitch_eligibility(t):
    return pitching.eligibility(t("pitching"), _day(), pitching.rule_set(F.lit("varsity"), _day()))


@query("season_batting", f"select * from {_SEASON_BATTING}")
def season_batting(t):
    return batting.season_batting(t("batting"))


@query("season_pitching", f"select * from {_SEASON_PITCHING}")
def season_pitching(t):
    return batting.season_pitching(t("pitching"))


def _rosters(season: DataFrame) -> DataFrame:
    return season.filter("player_id % 2 = 0").select(*batting.KEYS, (F.col("player_id") % 99).cast("string").alias("jersey_number"))


@query("batting_leaders", f"""
    select team_id, season_id, player_id, first_name || ' ' || last_name as name, case when player_id % 2 = 0 then (player_id % 99)::string end as jersey_number, pa, avg, obp, slg, k_pct,
        row_number() over (partition by team_id, season_id order by case when ab = 0 then 1 else 0 end, avg desc nulls last, last_name, player_id) as nth
    from (select *, {_AVG} as avg, {_OBP} as obp, {_SLG} as slg, (so * 100)::double / nullif(pa, 0) as k_pct from {_SEASON_BATTING}) as r join batters using (player_id)""")  # fmt: skip
def batting_leaders(t):
    season = batting.season_batting(t("batting"))
    rows = batting.batting_leaders(season, t("batters"), _rosters(season))
    return rows.select("team_id", "season_id", "player_id", text.full_name().alias("name"), "jersey_number", "pa", "avg", "obp", "slg", "k_pct", "nth")


@query("pitching_leaders", f"""
    select team_id, season_id, player_id, era, k9, bb9, whip, strike_pct, (ip_outs // 3)::string || '.' || (ip_outs % 3)::string as innings, gs,
        row_number() over (partition by team_id, season_id order by case when ip_outs = 0 then 1 else 0 end, era nulls last, last_name, player_id) as nth
    from (select *, (er * 27)::double / nullif(ip_outs, 0) as era, (so * 27)::double / nullif(ip_outs, 0) as k9, (bb * 27)::double / nullif(ip_outs, 0) as bb9, ((bb + h) * 3)::double / nullif(ip_outs, 0) as whip,
        (coalesce(total_strikes, 0) * 100)::double / nullif(coalesce(pitches, 0), 0) as strike_pct from {_SEASON_PITCHING}) as r join pitchers using (player_id)""")  # fmt: skip
def pitching_leaders(t):
    season = batting.season_pitching(t("pitching"))
    rows = batting.pitching_leaders(season, t("pitchers"), _rosters(season))
    return rows.select("team_id", "season_id", "player_id", "era", "k9", "bb9", "whip", "strike_pct", "innings", "gs", "nth")


def _level_sql(pr: str, depth: list[tuple[int, int]]) -> str:
    caps = " ".join(f"when size >= {n} then {m}" for n, m in depth)
    return f"case when qualified then least(case when {pr} >= 0.70 then 4 when {pr} >= 0.40 then 3 when {pr} >= 0.20 then 2 else 1 end, case {caps} else 0 end) else 0 end::bigint"


_BATTING_HEAT = ", ".join(f"cume_dist() over (partition by team_id, season_id, qualified order by {m}) as c_{m}" for m in ("avg", "obp", "slg", "composite"))


@query("percentile_heat", f"""
    select team_id, season_id, player_id, qualified, composite, {", ".join(f"{_level_sql('c_' + m, batting.BATTING_DEPTH)} as heat_{m}" for m in ("avg", "obp", "slg", "composite"))}
    from (select *, count(*) over (partition by team_id, season_id, qualified) as size, {_BATTING_HEAT} from (
        select *, 0.40::double * obp + 0.35::double * slg + 0.25::double * avg as composite from (
            select *, pa >= 5 as qualified, coalesce({_AVG}, 0.0) as avg, coalesce({_OBP}, 0.0) as obp, coalesce({_SLG}, 0.0) as slg from {_SEASON_BATTING}) as a) as b) as c""")  # fmt: skip
def percentile_heat(t):
    rows = batting.batting_heat(batting.season_batting(t("batting")))
    return rows.select("team_id", "season_id", "player_id", "qualified", "composite", *(f"heat_{m}" for m in ("avg", "obp", "slg", "composite")))


@query("composite_score", f"""
    select team_id, season_id, player_id, composite, case when qualified then least(case when c >= 0.70 then 4 when c >= 0.40 then 3 when c >= 0.20 then 2 else 1 end, case when size >= 6 then 4 when size >= 4 then 3 when size >= 3 then 2 when size >= 2 then 1 else 0 end) else 0 end::bigint as heat_composite from (
        select *, cume_dist() over (partition by team_id, season_id, qualified order by composite) as c from (
            select *, case when qualified then 0.40::double * c_era + 0.30::double * c_k9 + 0.30::double * c_whip else 0.0 end as composite from (
                select *, count(*) over (partition by team_id, season_id, qualified) as size, cume_dist() over (partition by team_id, season_id, qualified order by era desc) as c_era,
                    cume_dist() over (partition by team_id, season_id, qualified order by k9) as c_k9, cume_dist() over (partition by team_id, season_id, qualified order by whip desc) as c_whip from (
                    select *, ip_outs >= 18 as qualified, coalesce((er * 27)::double / nullif(ip_outs, 0), 0.0) as era, coalesce((so * 27)::double / nullif(ip_outs, 0), 0.0) as k9, coalesce(((bb + h) * 3)::double / nullif(ip_outs, 0), 0.0) as whip from {_SEASON_PITCHING}) as a) as b) as d) as e""")  # fmt: skip
def composite_score(t):
    return batting.pitching_heat(batting.season_pitching(t("pitching"))).select("team_id", "season_id", "player_id", "composite", "heat_composite")


@query("key_players", f"""
    select coalesce(a.team_id, b.team_id) as team_id, coalesce(a.season_id, b.season_id) as season_id, pitcher_id, pitcher_outs, batter_id, batter_obp from
        (select team_id, season_id, player_id as pitcher_id, ip_outs as pitcher_outs from {_SEASON_PITCHING} where ip_outs >= 18 qualify row_number() over (partition by team_id, season_id order by ip_outs desc, player_id) = 1) as a
        full join (select team_id, season_id, player_id as batter_id, {_OBP} as batter_obp from {_SEASON_BATTING} where pa >= 5 qualify row_number() over (partition by team_id, season_id order by {_OBP} desc nulls last, player_id) = 1) as b
        on a.team_id = b.team_id and a.season_id = b.season_id""")  # fmt: skip
def key_players(t):
    return batting.key_players(batting.season_batting(t("batting")), batting.season_pitching(t("pitching")))


@query("team_batting_card", f"""
    select team_id, season_id, pa, {_AVG} as avg, {_OBP} as obp, {_SLG} as slg, (so * 100)::double / nullif(pa, 0) as k_pct, (bb * 100)::double / nullif(pa, 0) as bb_pct from (
        select team_id, season_id, {", ".join(f"sum({c})::bigint as {c}" for c in [*batting.BATTING, "pa"])} from {_SEASON_BATTING} group by all) as sums""")  # fmt: skip
def team_batting_card(t):
    return batting.team_batting(batting.season_batting(t("batting"))).select("team_id", "season_id", "pa", "avg", "obp", "slg", "k_pct", "bb_pct")


def _record_sql(only: str) -> str:
    return f"""select team_id, season_id, sum((scored > allowed)::int)::bigint as wins, sum((scored < allowed)::int)::bigint as losses, sum((scored = allowed)::int)::bigint as ties, count(*) as games,
        avg(scored) as mean_scored, avg(allowed) as mean_allowed from {_SIDES} where scored is not null and allowed is not null {only} group by all"""


@query("win_loss_record", _record_sql(""))
def win_loss_record(t):
    return games.records(t("games"))


@query("all_team_records", _record_sql("and status = 'completed'"))
def all_team_records(t):
    return games.records(t("games"), completed_only=True)


@query("schedule_enriched", f"""
    select sides.team_id, sides.season_id, game_id, sides.opponent_id, is_home, {_RESULT} as result, name as opponent, r.wins as opponent_wins, r.losses as opponent_losses,
        sides.opponent_id in (select team_id from pitching) as has_stats, case when waits then date_diff('day', date '{REFERENCE_DAY}', game_date) end as days_until,
        waits and row_number() over (partition by sides.team_id, sides.season_id, waits order by game_date, start_time nulls last, game_id) = 1 as is_next
    from (select *, status = 'scheduled' and game_date >= date '{REFERENCE_DAY}' as waits from {_SIDES}) as sides left join teams on id = opponent_id
        left join ({_record_sql("and status = 'completed'")}) as r on r.team_id = sides.opponent_id and r.season_id = sides.season_id""")  # fmt: skip
def schedule_enriched(t):
    rows = games.schedule(t("games"), t("teams"), t("pitching").select("team_id").distinct(), _day())
    return rows.select("team_id", "season_id", "game_id", "opponent_id", "is_home", "result", "opponent", "opponent_wins", "opponent_losses", "has_stats", "days_until", "is_next")


@query("opponent_summary", f"""
    select team_id, season_id, opponent_id, count(*) as games, sum(coalesce((status = 'completed' and scored > allowed), null)::int)::bigint as wins, sum((status = 'completed' and scored < allowed)::int)::bigint as losses,
        min(case when game_date >= date '{REFERENCE_DAY}' then game_date end)::string as next_date, max(case when status = 'completed' then game_date end)::string as last_date from {_SIDES} group by all""")  # fmt: skip
def opponent_summary(t):
    return games.opponents(t("games"), _day())


@query("last_meetings", f"""
    select team_id, opponent_id, season_id, game_id, {_RESULT} as result from {_SIDES} where status = 'completed' and scored is not null and allowed is not null
    qualify row_number() over (partition by team_id, opponent_id, season_id order by game_date desc, start_time desc nulls last, game_id desc) = 1""")  # fmt: skip
def last_meetings(t):
    return games.last_meetings(t("games")).select("team_id", "opponent_id", "season_id", "game_id", "result")


@query("recent_form", f"""
    select team_id, season_id, string_agg(result, '' order by nth) as form from (select team_id, season_id, {_RESULT} as result, row_number() over (partition by team_id, season_id order by game_date desc, start_time desc nulls last, game_id desc) as nth
        from {_SIDES} where status = 'completed' and scored is not null and allowed is not null) as n where nth <= 5 group by all""")  # fmt: skip
def recent_form(t):
    return games.form(t("games"))


@query("game_coverage", f"select team_id, max(game_date)::string as through, count(*) as games from {_SIDES} where status = 'completed' group by all")
def game_coverage(t):
    return games.coverage(t("games"))


@query("prefer_own_perspective", """
    select game_id, team_id, perspective_team_id, player_id, seq from (
        select *, coalesce(max(case when perspective_team_id = team_id then team_id end) over (partition by game_id, team_id), min(perspective_team_id) over (partition by game_id, team_id)) as chosen from pitching) as p
    where perspective_team_id = chosen""")  # fmt: skip
def prefer_own_perspective(t):
    return games.one_perspective(t("pitching")).select("game_id", "team_id", "perspective_team_id", "player_id", "seq")


@query("recent_groups_top5", """
    select player_id, game_id, nth, ip_outs, so from (select *, dense_rank() over (partition by player_id order by game_date desc, game_id desc) as nth from (select distinct player_id, game_id, game_date, ip_outs, so from pitching) as d) as r where nth <= 5""")  # fmt: skip
def recent_groups_top5(t):
    return games.recent_games(t("pitching").select("player_id", "game_id", "game_date", "ip_outs", "so")).select("player_id", "game_id", "nth", "ip_outs", "so")


@query("union_seasons", "select team_id, season_id from pitching union select team_id, season_id from batting")
def union_seasons(t):
    return games.seasons(t("pitching"), t("batting"))


@query("stats_presence", """
    select id, case when exists (select 1 from pitching where team_id = id) then 'stats' when exists (select 1 from supplier where s_nationkey = id and s_acctbal > 9000) then 'syncing' else 'scoresheet' end as status from teams""")  # fmt: skip
def stats_presence(t):
    links = t("supplier").select(F.col("s_nationkey").cast("bigint").alias("team_id"), F.when(F.col("s_acctbal") > 9000, "running").otherwise("done").alias("state"))
    return games.data_status(t("teams"), t("pitching"), links)


@query("unordered_pair_dupes", """
    select season_id, game_date::string as game_date, least(home_team_id, away_team_id) as low_team, greatest(home_team_id, away_team_id) as high_team, count(*) as games from games group by all having count(*) > 1""")  # fmt: skip
def unordered_pair_dupes(t):
    return games.duplicate_games(t("games"))


@query("same_games", """
    select canonical_id, duplicate_id, rule from (
        select min(game_id) over (partition by game_date, low, high, start_time) as canonical_id, game_id as duplicate_id, 'start' as rule from keyed where start_time is not null
        union all
        select coalesce(f.with_start, min(k.game_id) over (partition by k.game_date, k.low, k.high, k.total)), k.game_id, 'total' from (select * from keyed where start_time is null and total is not null) as k
            left join (select game_date, low, high, total, min(game_id) as with_start from (
                select game_date, low, high, start_time, min(game_id) as game_id, arg_min(total, game_id) filter (true) as ignored from keyed where start_time is not null group by all) as m
                join (select game_id, total from keyed) as own using (game_id) group by all) as f
            on f.game_date = k.game_date and f.low = k.low and f.high = k.high and f.total = k.total) as pairs
    where canonical_id <> duplicate_id""".replace("from keyed", "from (select game_id, game_date, least(home_team_id, away_team_id) as low, greatest(home_team_id, away_team_id) as high, start_time, home_score + away_score as total from games where status = 'completed') as keyed").replace(", arg_min(total, game_id) filter (true) as ignored", ""))  # fmt: skip
def same_games(t):
    return games.same_games(t("games"))


_RATES = """select {key}, {sums}, ({n} * 100)::double / nullif({d}, 0) as {n}_pct, pitches::double / nullif({d}, 0) as pitches_per_{d} from (
    select {key}, {more}count(*) as {d}, sum({flag})::bigint as {n}, sum(pitch_count)::bigint as pitches from plays {where} group by all) as sums"""


@query("first_event_rate", _RATES.format(key="pitcher_id", sums="bf, fps, pitches", n="fps", d="bf", flag="is_first_pitch_strike", more="", where="where pitcher_id is not null"))
def first_event_rate(t):
    return plays.pitcher_rates(t("plays"))


@query("quality_rate", _RATES.format(key="batter_id", sums="pa, qab, pitches", n="qab", d="pa", flag="is_qab", more="", where=""))
def quality_rate(t):
    return plays.batter_rates(t("plays"))


@query("team_plays_rate", _RATES.format(key="batting_team_id", sums="games, pa, qab, pitches", n="qab", d="pa", flag="is_qab", more="count(distinct game_id) as games, ", where=""))
def team_plays_rate(t):
    return plays.team_rates(t("plays"))


_TOLD = """(select user_id::string as game_id, event_id as play_order, case when event_id % 2 = 0 then 'top' else 'bottom' end as half, event_id % 5 as batter,
    case when event_id % 3 = 0 then event_id % 4 end as named, event_id % 4 as balls, event_id % 7 = 0 as has_out, event_id % 6 as score, event_id % 11 > 0 as ended from events)"""


def _uuid(n):
    return F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(n.cast("string"), 12, "0"))


@query("parse_fold", f"""
    select game_id, play_order, half, '00000000-0000-0000-0000-' || lpad(batter::string, 12, '0') as batter_id,
        '00000000-0000-0000-0000-' || lpad(coalesce(last_value(named ignore nulls) over (partition by game_id, half order by play_order),
            first_value(named ignore nulls) over (partition by game_id, half order by play_order rows between current row and unbounded following))::string, 12, '0') as pitcher_id,
        balls + 1 as pitch_count, 1::bigint as strikes, (balls = 0)::bigint as is_first_pitch_strike, has_out::bigint as did_outs_change, score as home_score
    from {_TOLD} as told where ended""")  # fmt: skip
def parse_fold(t):
    n = F.col("event_id")
    part = lambda c: F.struct(c.alias("template"))
    told = F.concat(F.array_repeat(F.lit("Ball 1"), (n % 4).cast("int")), F.array(F.lit("In play")))
    named = F.when(n % 3 == 0, F.concat(F.lit(", ${"), _uuid(n % 4), F.lit("} pitching"))).otherwise("")
    final = F.when(n % 11 > 0, F.array(part(F.concat(F.lit("${"), _uuid(n % 5), F.lit("} grounds out"), named)))).otherwise(F.array().cast("array<struct<template:string>>"))
    one = F.struct(n.alias("order"), F.lit(1).cast("bigint").alias("inning"), F.when(n % 2 == 0, "top").otherwise("bottom").alias("half"), part(F.lit("Ground Out")).alias("name_template"), (n % 6).alias("home_score"), F.lit(0).cast("bigint").alias("away_score"), F.lit(False).alias("did_score_change"), F.lit(0).cast("bigint").alias("outs"), (n % 7 == 0).alias("did_outs_change"), F.transform(told, part).alias("at_plate_details"), final.alias("final_details"))
    found = t("events").groupBy(F.col("user_id").cast("string").alias("game_id")).agg(F.sort_array(F.collect_list(one)).alias("plays")).withColumns({"home_team_id": F.lit(1).cast("bigint"), "away_team_id": F.lit(2).cast("bigint")})
    return plays.parsed(found).select("game_id", "play_order", "half", "batter_id", "pitcher_id", "pitch_count", "strikes", "is_first_pitch_strike", "did_outs_change", "home_score")


@query("pitcher_order", """
    select *, row_number() over (partition by game_id, perspective_team_id, batting_team_id order by first_play, pitcher_id) as nth, lag(pitcher_id) over (partition by game_id, perspective_team_id, batting_team_id order by first_play, pitcher_id) as before from (
        select game_id, perspective_team_id, batting_team_id, pitcher_id, min(play_order) as first_play, count(*) as bf from plays where pitcher_id is not null group by all) as f""")  # fmt: skip
def pitcher_order(t):
    return plays.first_appearances(t("plays"))


_DERIVED = """(select game_id, perspective_team_id, pitcher_id as player_id, count(*) as bf, sum(did_outs_change)::bigint as ip_outs, sum((outcome in ('Strikeout', 'Dropped 3rd Strike'))::int)::bigint as so,
    sum((outcome in ('Walk', 'Intentional Walk'))::int)::bigint as bb, sum((outcome = 'Hit By Pitch')::int)::bigint as hbp, sum((outcome in ('Single', 'Double', 'Triple', 'Home Run'))::int)::bigint as h,
    sum(pitch_count)::bigint as pitches, sum(strikes)::bigint as total_strikes from plays where pitcher_id is not null group by all)"""
_BOX = f"(select game_id, perspective_team_id, player_id, bf, ip_outs, so + game_id % 2 as so, bb, hbp, h, pitches + 3 as pitches, total_strikes - 1 as total_strikes from {_DERIVED} as d where player_id % 10 < 2)"


def _box(derived: DataFrame) -> DataFrame:
    """Stands for official box scores: some differ, some are missing."""
    return derived.filter("player_id % 10 < 2").withColumns({"so": F.col("so") + F.col("game_id") % 2, "pitches": F.col("pitches") + 3, "total_strikes": F.col("total_strikes") - 1})


def _signal_sql(s: str) -> str:
    value = f"p.{s}" if s not in ("pitches", "total_strikes") else f"case when b.bf = p.bf and b.so = p.so and b.bb = p.bb and b.pitches is not null and b.total_strikes is not null then b.{s} else p.{s} end"
    return f"select coalesce(b.game_id, p.game_id) as game_id, coalesce(b.perspective_team_id, p.perspective_team_id) as perspective_team_id, coalesce(b.player_id, p.player_id) as player_id, '{s}' as signal, b.{s} as boxscore_value, {value} as plays_value from {_BOX} as b full join {_DERIVED} as p on b.game_id = p.game_id and b.perspective_team_id = p.perspective_team_id and b.player_id = p.player_id"


@query("two_source_recon", "select *, plays_value - boxscore_value as delta, case when plays_value - boxscore_value is null then 'UNCORRECTABLE' when plays_value = boxscore_value then 'MATCH' when signal = 'ip_outs' then 'UNCORRECTABLE' else 'CORRECTABLE' end as status from (" + " union all ".join(map(_signal_sql, plays.SIGNALS)) + ") as s")
def two_source_recon(t):
    derived = plays.plays_by_pitcher(t("plays"))
    return plays.reconciled(_box(derived), derived, ["game_id", "perspective_team_id", "player_id"], plays.SIGNALS)


@query("range_attribution", """
    select p.game_id, p.play_order, b.player_id as given_pitcher, b.player_id is not null as corrected from
        (select *, row_number() over (partition by game_id order by play_order) as n from plays) as p left join
        (select game_id, player_id, coalesce(lag(last) over (partition by game_id order by nth), 0) as before, last from (
            select *, sum(bf) over (partition by game_id order by nth) as last from (
                select game_id, game_id * 10 + play_order % 3 as player_id, play_order % 3 as nth, count(*) as bf from plays group by all) as a) as c
            where game_id in (select game_id from plays group by game_id having count(distinct play_order % 3) >= 2)) as b
        on p.game_id = b.game_id and p.n > b.before and p.n <= b.last""")  # fmt: skip
def range_attribution(t):
    rows = t("plays")
    box = rows.groupBy("game_id", (F.col("play_order") % 3).alias("nth")).agg(F.count(F.lit(1)).alias("bf")).withColumn("player_id", F.col("game_id") * 10 + F.col("nth"))
    return plays.attributed(rows, box)


@query("status_counts_latest", """
    select signal, status, count(*) as n from (
        select l_returnflag as signal, l_linestatus as status, row_number() over (partition by l_suppkey, l_returnflag order by l_shipdate desc, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber desc) as nth from lineitem) as r where nth = 1 group by all""")  # fmt: skip
def status_counts_latest(t):
    rows = t("lineitem").select(F.lit(1).alias("game_id"), F.lit(1).alias("perspective_team_id"), F.col("l_suppkey").alias("player_id"), F.col("l_returnflag").alias("signal"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("created_at"), (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"))
    return plays.status_counts(rows)


@query("tolerance_compare", f"""
    select game_id, player_id, derived, official, case when official = 0 then case when derived > 0 then 100.0 else 0.0 end::double else abs(derived - official) * 100.0::double / official end as off_pct,
        case when official = 0 then derived = 0 else abs(derived - official) * 100.0::double / official <= 5 end as within
    from (select p.game_id, p.player_id, p.so as derived, b.so as official from {_DERIVED} as p join {_BOX} as b on p.game_id = b.game_id and p.player_id = b.player_id and p.perspective_team_id = b.perspective_team_id) as both_""")  # fmt: skip
def tolerance_compare(t):
    derived = plays.plays_by_pitcher(t("plays"))
    return plays.compared(derived, _box(derived), ["game_id", "player_id"], "so")


@query("two_strike_fold", """
    select user_id, count(*) filter (before >= 2) as after_two from (
        select user_id, coalesce(sum(strike) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as before from (
            select user_id, ts, event_id, case when event_id % 4 in (1, 2) then 1 else 0 end as strike from events) as e) as w group by all""")  # fmt: skip
def two_strike_fold(t):
    kind = F.when(F.col("event_id") % 4 == 1, "foul").when(F.col("event_id") % 4 == 2, "strike_looking").otherwise("ball")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", kind.alias("kind")))), lambda s: s["kind"])
    return t("events").groupBy("user_id").agg(plays.after_two_strikes(ordered).alias("after_two"))


@query("zone_counts", f"""
    select player_id, count(*) as bip, sum((play_result in ('single', 'double', 'triple', 'home_run', 'dropped_third_strike'))::int)::bigint as hits,
        {", ".join(f"sum((x is not null and {c})::int)::bigint as n_{z}" for z, c in (("left", "a < -0.206"), ("center", "a between -0.206 and 0.206"), ("right", "a > 0.206")))}
    from (select *, atan2({160 - 160 * spray.X_SCALE!r}::double + x * {spray.X_SCALE!r}::double - 160, -({295 - 296 * spray.Y_SCALE!r}::double + y * {spray.Y_SCALE!r}::double - 295)) as a from balls) as b group by all""")  # fmt: skip
def zone_counts(t):
    return spray.zone_counts(t("balls"), ["player_id"])


def _halves(t):
    """Old rows and incoming ones, as a keyed table sees them."""
    rows = t("lineitem").select(F.col("l_suppkey").alias("player_id"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_quantity").cast("bigint").alias("value"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_returnflag")).alias("note"), (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))
    old = tables.latest(rows.filter("seq % 2 = 0"), ["player_id", "line"]).filter("player_id % 3 > 0")
    return old.drop("seq"), rows.filter("seq % 2 = 1 and player_id % 5 > 0")


_HALVES = """rows_ as (select l_suppkey as player_id, l_linenumber::bigint as line, l_quantity::bigint as value, case when l_partkey % 3 > 0 then l_returnflag end as note, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber as seq from lineitem),
    old_ as (select * from rows_ where seq % 2 = 0 and player_id % 3 > 0 qualify row_number() over (partition by player_id, line order by seq desc) = 1),
    new_ as (select * from rows_ where seq % 2 = 1 and player_id % 5 > 0 qualify row_number() over (partition by player_id, line order by seq {order}) = 1)"""


@query("upsert_latest", f"with {_HALVES.format(order='desc')} select player_id, line, value, note from new_ union all select player_id, line, value, note from old_ where not exists (select 1 from new_ where new_.player_id = old_.player_id and new_.line = old_.line)")
def upsert_latest(t):
    return tables.upsert(*_halves(t), ["player_id", "line"])


@query("upsert_coalesce", f"with {_HALVES.format(order='desc')} select player_id, line, coalesce(n.value, o.value) as value, coalesce(n.note, o.note) as note from old_ as o full join new_ as n using (player_id, line)")
def upsert_coalesce(t):
    return tables.upsert_filling(*_halves(t), ["player_id", "line"], fill=["note"])


@query("insert_ignore", f"with {_HALVES.format(order='asc')} select player_id, line, value, note from old_ union all select player_id, line, value, note from new_ where not exists (select 1 from old_ where new_.player_id = old_.player_id and new_.line = old_.line)")
def insert_ignore(t):
    old, new = _halves(t)
    return tables.insert_ignore(old, new, ["player_id", "line"]).select("player_id", "line", "value", "note")


@query("longest_names", """
    select player_id, max_by(first_name, struct_pack(a := case when first_name = 'Unknown' then 0 else length(first_name) end, b := -seq)) as first_name, max_by(last_name, struct_pack(a := length(last_name), b := -seq)) as last_name from (
        select l_suppkey as player_id, case when l_linenumber = 1 then 'Unknown' else left(p_name, (l_linenumber + 2)::int) end as first_name, p_brand as last_name, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber as seq from lineitem join part on l_partkey = p_partkey) as n group by all""")  # fmt: skip
def longest_names(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("l_suppkey").alias("player_id"), F.when(F.col("l_linenumber") == 1, "Unknown").otherwise(F.substring("p_name", F.lit(1), F.col("l_linenumber") + 2)).alias("first_name"), F.col("p_brand").alias("last_name"), (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return tables.longest_names(rows)


@query("cascade_delete_survivors", """
    select game_id from games where game_id not in (select game_id from pitching where team_id = 3)
        or exists (select 1 from pitching as p where p.game_id = games.game_id and not exists (select 1 from pitching as r where r.team_id = 3 and r.game_id = p.game_id and r.perspective_team_id = p.perspective_team_id))""")  # fmt: skip
def cascade_delete_survivors(t):
    lines = t("pitching")
    return tables.surviving_games(t("games"), lines, lines.filter("team_id = 3")).select("game_id")


@query("orphan_games", "select game_id from games where home_team_id in (2, 4, 6, 8) and away_team_id in (2, 4, 6, 8)")
def orphan_games(t):
    return tables.orphan_games(t("games"), t("teams").filter("id in (2, 4, 6, 8)")).select("game_id")


@query("key_faults", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def key_faults(t):
    return tables.key_faults(t("lineitem"), ["l_orderkey", "l_linenumber"])


def _named(t):
    words = F.split("p_name", " ")
    return t("part").select((F.col("p_partkey") % 7).alias("team_id"), F.lit(1).alias("season_id"), F.col("p_partkey").alias("player_id"), F.substring(F.get(words, F.lit(0)), F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int")).alias("first_name"), F.col("p_brand").alias("last_name"), F.col("p_size").cast("bigint").alias("stat_rows"))


@query("prefix_dupes", """
    with r as (select p_partkey % 7 as team_id, p_partkey as id, lower(left(split_part(p_name, ' ', 1), (p_partkey % 4 + 1)::int)) as first, lower(p_brand) as last, p_size::bigint as n from part)
    select a.team_id, 1 as season_id, case when (-length(a.first), -a.n, a.id) < (-length(b.first), -b.n, b.id) then a.id else b.id end as canonical_id,
        case when (-length(a.first), -a.n, a.id) < (-length(b.first), -b.n, b.id) then b.id else a.id end as duplicate_id
    from r as a join r as b on a.team_id = b.team_id and a.last = b.last and a.id < b.id and a.first <> '' and b.first <> '' and (starts_with(a.first, b.first) or starts_with(b.first, a.first))""")  # fmt: skip
def prefix_dupes(t):
    return identity.duplicate_players(_named(t))


_TEAMS = "(select p_partkey as id, lower(p_brand) as name, case when p_partkey % 4 = 0 then null else 2000 + p_size end::bigint as season_year from part where p_partkey % 3 > 0)"


@query("name_dupes_two_pass", f"""
    with r as (select *, case when season_year is null then 1 else count(*) over (partition by name, season_year) end as same from {_TEAMS} as t), l as (select *, count(season_year) over (partition by name) as dated, count(*) over (partition by name) as every from r where same = 1)
    select id, name, season_year, 1::bigint as pass from r where same > 1 union all select id, name, season_year, 2 from l where dated > 0 and every > dated""")  # fmt: skip
def name_dupes_two_pass(t):
    year = F.when(F.col("p_partkey") % 4 != 0, 2000 + F.col("p_size")).cast("bigint")
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), year.alias("season_year"), F.when(F.col("p_partkey") % 3 > 0, "tracked").otherwise("member").alias("membership_type"))
    return identity.duplicate_teams(rows)


@query("link_counts", """
    select s_nationkey::bigint as our_team_id, count(*) as total, sum((s_acctbal > 0 and s_suppkey % 5 > 0)::int)::bigint as resolved, sum((s_acctbal <= 0 and s_suppkey % 5 > 0)::int)::bigint as unresolved, sum((s_suppkey % 5 = 0)::int)::bigint as hidden from supplier group by all""")  # fmt: skip
def link_counts(t):
    rows = t("supplier").select(F.col("s_nationkey").cast("bigint").alias("our_team_id"), F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).alias("resolved_team_id"), (F.col("s_suppkey") % 5 == 0).cast("int").alias("is_hidden"))
    return identity.link_counts(rows)


@query("json_extract_stats", "select user_id, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as sum_k from events group by all")
def json_extract_stats(t):
    k = F.from_json("props", "k bigint")["k"]
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k"))


@query("season_display", "select o_orderkey, 'Spring ' || extract(year from o_orderdate)::string as shown from orders")
def season_display(t):
    season = text.season_id(F.year("o_orderdate"), F.lit("hs"), 2026)
    return t("orders").select("o_orderkey", text.season_display(season).alias("shown"))


@query("name_classify", """
    select c_custkey, case when c_custkey % 6 = 0 then 'jv' when c_custkey % 6 = 1 then 'varsity' when c_custkey % 6 = 2 then 'freshman' when c_custkey % 6 = 3 and c_custkey % 20 between 8 and 14 then (c_custkey % 20)::string || 'U' when c_custkey % 6 = 4 then 'legion' end as level from customer""")  # fmt: skip
def name_classify(t):
    key = F.col("c_custkey") % 6
    tail = F.when(key == 0, " Junior Varsity").when(key == 1, " VARSITY 12U").when(key == 2, " Frosh").when(key == 3, F.concat(F.lit(" "), (F.col("c_custkey") % 20).cast("string"), F.lit("u"))).when(key == 4, " Legion Post 5").otherwise(" Club")
    return t("customer").select("c_custkey", text.classification(F.concat("c_name", tail)).alias("level"))


_LINES = r"""(select doc_id, body, line from (select doc_id, unnest(parts) as body, unnest(range(1, len(parts) + 1)) as line from (
    select doc_id, regexp_split_to_array({text}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') as parts from documents) as p) as l where not contains(body, 'pii-ok'))"""
_FOUND = "select doc_id, line, '{kind}' as kind, unnest(regexp_extract_all(body, '{pattern}')) as match from {lines} as t"


def _found(kind: str, text: str = "text") -> str:
    return _FOUND.format(kind=kind, pattern=text_scan.PATTERNS[kind].replace("'", "''"), lines=_LINES.replace("{text}", text))


@query("pii_email_hits", f"""
    select * from ({_found("email", "replace(text, 'example.', 'school.')")}) as m
    where not regexp_matches(lower(match), '@(.*\\.)?(example\\.com|example\\.net|example\\.org|test|example|invalid|localhost)$')""")  # fmt: skip
def pii_email_hits(t):
    return text_scan.findings(t("documents").withColumn("text", F.replace("text", F.lit("example."), F.lit("school."))), "doc_id", kinds=("email",))


@query("email_lines", _found("email"))
def email_lines(t):
    return text_scan.findings(t("documents"), "doc_id", kinds=("email",), reserved=())


_KEYS = "replace(replace(text, 'token', 'access_token'), 'password: ', 'Bearer ')"


@query("pii_credentials", _found("bearer_token", _KEYS) + " union all " + _found("api_key_assignment", _KEYS))
def pii_credentials(t):
    renamed = F.replace(F.replace("text", F.lit("token"), F.lit("access_token")), F.lit("password: "), F.lit("Bearer "))
    return text_scan.findings(t("documents").withColumn("text", renamed), "doc_id", kinds=("bearer_token", "api_key_assignment"))


@query("pii_scan")
def pii_scan(t):
    return text_scan.findings(t("documents"), "doc_id")


_LINKS = "(select s_suppkey as link_id, s_nationkey::bigint as our_team_id, case when s_acctbal > 0 then s_suppkey % 25 end as resolved_team_id, case when s_suppkey % 4 = 0 then 'manual' else 'auto' end as resolution_method, 'p' || s_name as public_id, s_name as name, (s_suppkey % 5 = 0)::int as is_hidden from supplier)"
_JOBS = "(select c_custkey as job_id, c_nationkey::bigint as team_id, c_custkey % 97 as started_at, case c_custkey % 3 when 0 then 'running' when 1 then 'failed' else 'done' end as state from customer where c_nationkey % 5 > 0)"


def _links(t):
    n = F.col("s_suppkey")
    return t("supplier").select(n.alias("link_id"), F.col("s_nationkey").cast("bigint").alias("our_team_id"), F.when(F.col("s_acctbal") > 0, n % 25).alias("resolved_team_id"), F.when(n % 4 == 0, "manual").otherwise("auto").alias("resolution_method"), F.concat(F.lit("p"), "s_name").alias("public_id"), F.col("s_name").alias("name"), (n % 5 == 0).cast("int").alias("is_hidden"))


def _jobs(t):
    n = F.col("c_custkey")
    return t("customer").filter("c_nationkey % 5 > 0").select(n.alias("job_id"), F.col("c_nationkey").cast("bigint").alias("team_id"), (n % 97).alias("started_at"), F.when(n % 3 == 0, "running").when(n % 3 == 1, "failed").otherwise("done").alias("state"))


@query("latest_job_join", f"select id as team_id, state as job_state from teams left join (select * from {_JOBS} as j qualify row_number() over (partition by team_id order by started_at desc, job_id desc) = 1) as l on l.team_id = id")
def latest_job_join(t):
    return links.latest_jobs(t("teams").select(F.col("id").alias("team_id")), _jobs(t))


@query("pipeline_status", f"""
    select link_id, case when resolved_team_id is null or is_hidden = 1 then null when resolved_team_id % 4 = 0 then 'stats' when state = 'running' then 'syncing' when state = 'failed' then 'failed' end as pipeline_status
    from {_LINKS} as l left join (select * from {_JOBS} as j qualify row_number() over (partition by team_id order by started_at desc, job_id desc) = 1) as k on k.team_id = resolved_team_id""")  # fmt: skip
def pipeline_status(t):
    return links.pipeline_status(_links(t), t("teams").filter("id % 4 = 0").select(F.col("id").alias("team_id")), _jobs(t))


@query("manual_link_upsert", f"""
    with o as (select * from {_LINKS} as l where link_id % 3 > 0), n as (select link_id, our_team_id, link_id % 7 as resolved_team_id, 'search' as resolution_method, 'new' || name as public_id, 'new ' || name as name, 1 - is_hidden as is_hidden from {_LINKS} as l where link_id % 2 = 0)
    select link_id, case when n.link_id is null then o.our_team_id else n.our_team_id end as our_team_id, {", ".join(f"case when n.link_id is null or coalesce(o.resolution_method = 'manual', false) then o.{c} else n.{c} end as {c}" for c in links.RESOLVED)},
        case when n.link_id is null then o.name else n.name end as name, case when n.link_id is null then o.is_hidden else n.is_hidden end as is_hidden from o full join n using (link_id)""")  # fmt: skip
def manual_link_upsert(t):
    rows = _links(t)
    new = rows.filter("link_id % 2 = 0").withColumns({"resolved_team_id": F.col("link_id") % 7, "resolution_method": F.lit("search"), "public_id": F.concat(F.lit("new"), "name"), "name": F.concat(F.lit("new "), "name"), "is_hidden": 1 - F.col("is_hidden"), "seq": F.col("link_id")})
    return links.upsert_protecting_manual(rows.filter("link_id % 3 > 0"), new, ["link_id"])


@query("opponent_seeding", """
    with reg as (select s_nationkey::bigint as our_team_id, s_suppkey % 40 as opponent_id, s_name as name, (s_suppkey % 5 = 0)::int as is_hidden, s_suppkey as seq from supplier),
        sch as (select c_nationkey::bigint as our_team_id, case when c_custkey % 9 = 0 then null else c_custkey % 40 end as opponent_id, c_name as name, c_custkey as seq from customer),
        shown as (select our_team_id, opponent_id, arg_min(name, seq) as name from reg where is_hidden = 0 group by all),
        named as (select our_team_id, opponent_id, arg_min(name, seq) as name from sch where opponent_id is not null group by all),
        every as (select * from shown union all select * from named as n where not exists (select 1 from shown as s where s.our_team_id = n.our_team_id and s.opponent_id = n.opponent_id))
    select * from every as e where not exists (select 1 from reg as r where is_hidden = 1 and r.our_team_id = e.our_team_id and r.opponent_id = e.opponent_id) and e.opponent_id % 10 <> 3""")  # fmt: skip
def opponent_seeding(t):
    reg = t("supplier").select(F.col("s_nationkey").cast("bigint").alias("our_team_id"), (F.col("s_suppkey") % 40).alias("opponent_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 5 == 0).cast("int").alias("is_hidden"), F.col("s_suppkey").alias("seq"))
    sch = t("customer").select(F.col("c_nationkey").cast("bigint").alias("our_team_id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 40).alias("opponent_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    had = reg.select("our_team_id", "opponent_id").union(sch.select("our_team_id", "opponent_id")).filter("opponent_id % 10 = 3")
    return links.seeded(reg, sch, had)


@query("opponent_access", f"""
    with access as (select distinct c_custkey % 50 as user_id, c_nationkey::bigint as team_id from customer where c_custkey % 20 = 1)
    select user_id, team_id from access union select a.user_id, s.opponent_id from access as a join {_SIDES} on s.team_id = a.team_id""".replace("as sides on s.", "as s on s."))  # fmt: skip
def opponent_access(t):
    access = t("customer").filter("c_custkey % 20 = 1").select((F.col("c_custkey") % 50).alias("user_id"), F.col("c_nationkey").cast("bigint").alias("team_id")).distinct()
    return links.reachable_opponents(t("games"), access)


@query("games_of_teams", f"select id, count(distinct game_id) as games from (select n_nationkey::bigint + 5 as id from nation) as t left join {_SIDES} on team_id = id group by all")
def games_of_teams(t):
    return links.games_of_teams(t("games"), t("nation").select((F.col("n_nationkey").cast("bigint") + 5).alias("id")))


@query("delete_preview", """
    select team_id, sum(b)::bigint as batting, sum(p)::bigint as pitching, sum(l)::bigint as links, sum(b + p + l)::bigint as total from (
        select team_id, count(*) as b, 0 as p, 0 as l from batting group by all union all select team_id, 0, count(*), 0 from pitching group by all union all
        select s_nationkey::bigint, 0, 0, count(*) from supplier group by all) as c group by all""")  # fmt: skip
def delete_preview(t):
    return links.delete_preview({"batting": t("batting"), "pitching": t("pitching"), "links": t("supplier").select(F.col("s_nationkey").cast("bigint").alias("team_id"))})


@query("distinct_where", "select team_id, count(distinct case when perspective_team_id = team_id then game_id end) as own_games, count(distinct case when perspective_team_id <> team_id then game_id end) as others_games from pitching group by all")
def distinct_where(t):
    own = F.col("perspective_team_id") == F.col("team_id")
    return links.distinct_where(t("pitching"), "team_id", "game_id", own_games=own, others_games=~own)


@query("joined_names", "select s_nationkey, string_agg(distinct s_name, ', ' order by s_name) as names from supplier group by all")
def joined_names(t):
    return links.joined_names(t("supplier"), "s_nationkey", "s_name")


@query("supplemented_opponents", """
    select s_suppkey as id, s_name as name from supplier where s_suppkey % 3 = 0 union all select c_custkey, c_name from customer where not exists (select 1 from supplier where s_suppkey % 3 = 0 and s_suppkey = c_custkey)""")  # fmt: skip
def supplemented_opponents(t):
    return links.supplemented(t("supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")


@query("profile_union", """
    select distinct player_id % 50 as player_id, season_id, team_id, ab % 3 as ab, null::bigint as ip_outs from batting union select player_id % 50, season_id, team_id, null, ip_outs % 3 from pitching""")  # fmt: skip
def profile_union(t):
    key = (F.col("player_id") % 50).alias("player_id")
    return links.profile_rows(t("batting").select(key, "season_id", "team_id", (F.col("ab") % 3).alias("ab")), t("pitching").select(key, "season_id", "team_id", (F.col("ip_outs") % 3).alias("ip_outs")), ["player_id", "season_id", "team_id"])


@query("live_reports", "select o_orderkey as report_id, o_orderdate::date < date '1997-06-15' as is_expired, o_orderstatus = 'F' and not o_orderdate::date < date '1997-06-15' as is_served from orders")
def live_reports(t):
    rows = t("orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").cast("date").alias("expires_at"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("failed").alias("status"))
    return links.live_reports(rows, _day()).select("report_id", "is_expired", "is_served")


_SOME_TEAMS = "(select p_partkey as id, case when p_partkey % 6 = 0 then 'member' else 'tracked' end as membership_type from part)"


@query("removable_teams", f"""
    select id from {_SOME_TEAMS} as t where membership_type = 'tracked' and not exists (select 1 from customer where c_custkey * 7 = id) and not exists (select 1 from supplier where s_suppkey * 3 = id or s_suppkey * 5 = id)
        and not exists (select 1 from nation where n_nationkey = id) and not exists (select 1 from events where user_id % 1000 + 1 = id and (user_id % 500) % 6 = 0) and not exists (select 1 from events where user_id % 500 = id and (user_id % 1000 + 1) % 6 = 0 and user_id % 1000 + 1 <= (select max(p_partkey) from part))""")  # fmt: skip
def removable_teams(t):
    teams = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 6 == 0, "member").otherwise("tracked").alias("membership_type"))
    # member teams are those of the table of teams; a team 0 stands for one as well
    teams = teams.union(teams.limit(1).select(F.lit(0).cast("bigint"), F.lit("member")))
    null = F.lit(None)
    games_ = t("events").select(F.col("event_id").alias("game_id"), F.lit(1).alias("season_id"), null.alias("game_date"), null.alias("start_time"), null.alias("status"), (F.col("user_id") % 1000 + 1).alias("home_team_id"), (F.col("user_id") % 500).alias("away_team_id"), null.alias("home_score"), null.alias("away_score"))
    link = t("supplier").select((F.col("s_suppkey") * 3).alias("resolved_team_id"), (F.col("s_suppkey") * 5).alias("our_team_id"))
    return links.removable_teams(teams, t("customer").select((F.col("c_custkey") * 7).alias("team_id")), link, t("nation").select(F.col("n_nationkey").cast("bigint").alias("team_id")), games_)


@query("game_overlaps", f"""
    with own as (select distinct game_id, player_id from pitching where {_OWN}), pairs as (select s_suppkey as canonical_id, s_suppkey + 1 as duplicate_id from supplier)
    select canonical_id, duplicate_id, count(*) as games from pairs join own as a on a.player_id = canonical_id join own as b on b.player_id = duplicate_id and a.game_id = b.game_id group by all""")  # fmt: skip
def game_overlaps(t):
    return links.overlapping(t("supplier").select(F.col("s_suppkey").alias("canonical_id"), (F.col("s_suppkey") + 1).alias("duplicate_id")), t("pitching"))


@query("never_met", f"""
    select * from (select a.id as canonical_id, a.id + 3 as duplicate_id from teams as a) as p where not exists (select 1 from (select * from {_SIDES} where season_id = 1997 and game_id % 50 = 1) as m where m.team_id = canonical_id and m.opponent_id = duplicate_id)""")  # fmt: skip
def never_met(t):
    pairs = t("teams").select(F.col("id").alias("canonical_id"), (F.col("id") + 3).alias("duplicate_id"))
    return links.never_met(pairs, t("games").filter("season_id = 1997 and game_id % 50 = 1"))


@query("top_pitchers", f"select team_id, season_id, player_id, ip_outs, nth from (select *, row_number() over (partition by team_id, season_id order by ip_outs desc, player_id) as nth from {_SEASON_PITCHING} where ip_outs > 0) as r where nth <= 3")
def top_pitchers(t):
    rows = batting.season_pitching(t("pitching")).filter("ip_outs > 0").select("team_id", "season_id", "player_id", "ip_outs")
    return links.top_rows(rows, ["team_id", "season_id"], [F.desc("ip_outs"), F.asc("player_id")], 3)


@query("latest_seasons", "select team_id, max(season_id::string) as season_id, min(extract(year from game_date))::string || '-spring' as crawl_season from pitching group by all")
def latest_seasons(t):
    return t("pitching").groupBy("team_id").agg(F.max(F.col("season_id").cast("string")).alias("season_id"), F.concat(F.min(F.year("game_date")).cast("string"), F.lit("-spring")).alias("crawl_season"))


@query("team_keys", r"""
    select c_custkey, case when c_custkey % 4 = 0 then 'abc' || c_custkey || 'xyz' when c_custkey % 4 = 1 then '01234567-89ab-cdef-0123-' || lpad(c_custkey::string, 12, '0') when c_custkey % 4 = 2 then null else 'AbCdEf' || c_custkey end as team_key,
        case when c_custkey % 4 = 1 then 'uuid' when c_custkey % 4 = 2 then null else 'slug' end as kind, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then c_name else c_name || ' Post 5' end as bare,
        case when c_custkey % 3 = 0 then 'long' when c_custkey % 3 = 1 then 'short' end as program from customer""")  # fmt: skip
def team_keys(t):
    n, text_n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    given = F.when(n % 4 == 0, F.concat(F.lit("https://x.test/teams/abc"), text_n, F.lit("xyz/schedule?q=1"))).when(n % 4 == 1, F.concat(F.lit(" 01234567-89ab-cdef-0123-"), F.lpad(text_n, 12, "0"))).when(n % 4 == 2, F.concat(F.lit("a/b"), text_n)).otherwise(F.concat(F.lit("AbCdEf"), text_n))
    key, kind = text.team_key(given)
    name = F.when(n % 3 == 0, F.concat("c_name", F.lit(" Junior  Varsity 12U".replace("  ", " ")))).when(n % 3 == 1, F.concat("c_name", F.lit(" JV Frosh "))).otherwise(F.concat("c_name", F.lit(" Post 5 Legion")))
    program = text.program_of(F.when(n % 3 == 0, F.lit("The NORTH side High")).when(n % 3 == 1, F.lit("north")).otherwise("south"), {"North": "short", "North Side": "long"})
    return t("customer").select("c_custkey", key.alias("team_key"), kind.alias("kind"), text.without_level(name).alias("bare"), program.alias("program"))


@query("shown_texts", r"""
    select player_id, team_id, season_id, case when pitches is null then '?' else pitches::string end || 'p (' || games || 'g)' as workload, case when so = 0 then '-' when bb >= so and bb % so = 0 and bb = so then '1.000' else regexp_replace(printf('%.3f', bb::double / so), '^0', '') end as rate,
        case when games = 1 then '—' else printf('%.1f', (so * 100)::double / (so + bb)) || '%' end as share, case when games % 3 = 0 then 'Today' when games % 3 = 1 then '—' else '2d' end as last, so::double / nullif(bb, 0) as k_per_bb, pitches // games as mean_pitches
    from (select team_id, season_id, player_id, count(distinct game_id) as games, sum(so)::bigint as so, sum(bb)::bigint as bb, sum(pitches)::bigint as pitches from pitching where perspective_team_id = team_id group by all having sum(so) + sum(bb) > 0) as s""")  # fmt: skip
def shown_texts(t):
    own = t("pitching").filter("perspective_team_id = team_id").groupBy("team_id", "season_id", "player_id").agg(F.count_distinct("game_id").alias("games"), *(F.sum(c).cast("bigint").alias(c) for c in ("so", "bb", "pitches")))
    own = own.filter("so + bb > 0")
    share = F.when(F.col("games") > 1, rates.percent(F.col("so"), F.col("so") + F.col("bb")))
    days = F.when(F.col("games") % 3 == 0, 0).when(F.col("games") % 3 == 2, 2)
    return own.select(
        "player_id", "team_id", "season_id", text.workload_text(F.col("pitches"), F.col("games")).alias("workload"), text.rate_text(F.try_divide(F.col("bb").cast("double"), F.col("so").cast("double"))).alias("rate"), text.percent_text(share).alias("share"), text.last_outing_text(days).alias("last"),
        rates.per(F.col("so"), F.col("bb")).alias("k_per_bb"), F.expr("pitches div games").alias("mean_pitches"),
    )


@query("guarded_upsert", """
    with o as (select o_orderkey as game_id, case when o_orderstatus = 'F' then 'completed' else 'scheduled' end as status, o_custkey as score from orders where o_orderkey % 3 > 0),
        n as (select o_orderkey as game_id, case when o_orderkey % 5 = 0 then 'completed' else 'scheduled' end as status, o_custkey + 1 as score from orders where o_orderkey % 2 = 0)
    select game_id, case when n.game_id is null or o.status = 'completed' then o.status else n.status end as status, case when n.game_id is null then o.score else n.score end as score from o full join n using (game_id)""")  # fmt: skip
def guarded_upsert(t):
    key, status = F.col("o_orderkey").alias("game_id"), lambda c: F.when(c, "completed").otherwise("scheduled").alias("status")
    old = t("orders").filter("o_orderkey % 3 > 0").select(key, status(F.col("o_orderstatus") == "F"), F.col("o_custkey").alias("score"))
    new = t("orders").filter("o_orderkey % 2 = 0").select(key, status(F.col("o_orderkey") % 5 == 0), (F.col("o_custkey") + 1).alias("score"), F.col("o_orderkey").alias("seq"))
    return tables.upsert_guarded(old, new, ["game_id"])


@query("games_not_loaded", "select game_id, perspective_team_id, player_id from pitching as p where not exists (select 1 from pitching as l where l.ip_outs = 3 and l.game_id = p.game_id and l.perspective_team_id = p.perspective_team_id)")
def games_not_loaded(t):
    rows = t("pitching")
    return tables.not_loaded(rows, rows.filter("ip_outs = 3"), ["game_id", "perspective_team_id"]).select("game_id", "perspective_team_id", "player_id")


@query("team_delete", "select game_id, team_id, perspective_team_id, player_id from pitching where team_id <> 3 and perspective_team_id <> 3")
def team_delete(t):
    return tables.without_team(t("pitching"), F.lit(3)).select("game_id", "team_id", "perspective_team_id", "player_id")


@query("canonical_teams", """
    select name, pass, id as canonical_id from (select p_brand as name, (p_partkey % 2)::bigint as pass, p_partkey as id, row_number() over (partition by p_brand, p_partkey % 2 order by p_partkey % 4 = 0 desc, p_size desc, p_partkey) as nth from part) as r where nth = 1""")  # fmt: skip
def canonical_teams(t):
    n = F.col("p_partkey")
    return identity.canonical_teams(t("part").select(F.col("p_brand").alias("name"), (n % 2).alias("pass"), n.alias("id"), (n % 4 == 0).alias("has_stats"), F.col("p_size").alias("games")))


@query("teams_to_scout", f"""
    select distinct resolved_team_id as team_id from {_LINKS} as l where resolved_team_id is not null and is_hidden = 0
        and not exists (select 1 from customer where c_nationkey = resolved_team_id and c_custkey % 60 = 7) and not exists (select 1 from supplier where s_suppkey % 25 = resolved_team_id and s_suppkey % 8 = 1 and s_suppkey % 48 <= 24)""")  # fmt: skip
def teams_to_scout(t):
    now = F.lit("2026-04-02 00:00:00").cast("timestamp")
    running = t("customer").filter("c_custkey % 60 = 7").select(F.col("c_nationkey").cast("bigint").alias("team_id"), F.lit("running").alias("state"), F.lit(None).cast("timestamp").alias("ended_at"))
    ended = t("supplier").filter("s_suppkey % 8 = 1").select((F.col("s_suppkey") % 25).alias("team_id"), F.lit("done").alias("state"), (now - F.make_interval(hours=(F.col("s_suppkey") % 48).cast("int"))).alias("ended_at"))
    return identity.to_scout(_links(t), running.union(ended), now)


@query("merged_players", """
    with r as (select game_id, perspective_team_id, player_id as was, player_id - player_id % 3 as player_id, seq, case player_id % 4 when 0 then 'full' when 1 then 'supplemented' else 'boxscore_only' end as stat_completeness from (select game_id, perspective_team_id, player_id, min(seq) as seq from pitching group by all) as p)
    select game_id, perspective_team_id, player_id, stat_completeness, seq from r qualify row_number() over (partition by game_id, player_id, perspective_team_id
        order by case stat_completeness when 'full' then 3 when 'supplemented' then 2 else 1 end desc, was = player_id desc, was) = 1""")  # fmt: skip
def merged_players(t):
    kind = F.when(F.col("player_id") % 4 == 0, "full").when(F.col("player_id") % 4 == 1, "supplemented").otherwise("boxscore_only")
    # one line for each player, so that ties of a line with itself do not matter
    lines = t("pitching").withColumn("stat_completeness", kind).groupBy("game_id", "perspective_team_id", "player_id", "stat_completeness").agg(F.min("seq").alias("seq"))
    n = F.col("player_id")
    names = lines.filter("player_id % 3 > 0").select(n.alias("duplicate_id"), (n - n % 3).alias("canonical_id")).distinct()
    return identity.merged_players(lines, names)


@query("order_backfill", """
    with b as (select game_id, team_id, player_id, min(nth) as nth from (select *, row_number() over (partition by game_id, team_id order by seq) as nth from pitching where player_id % 5 > 0) as l group by all)
    select p.game_id, p.team_id, p.player_id, p.seq, coalesce(p.appearance_order, b.nth) as appearance_order from pitching as p left join b on b.game_id = p.game_id and b.team_id = p.team_id and b.player_id = p.player_id""")  # fmt: skip
def order_backfill(t):
    rows = t("pitching")
    listed = rows.filter("player_id % 5 > 0").groupBy("game_id", "team_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "player_id"))), lambda s: s["player_id"]).alias("pitchers"))
    return pitching.with_order_filled(rows, listed).select("game_id", "team_id", "player_id", "seq", "appearance_order")


@query("links_by_name", """
    select c_custkey as link_id, (select min(p_partkey) from part where p_brand = 'Brand#' || (c_custkey % 60)) as named_team_id from customer""")  # fmt: skip
def links_by_name(t):
    rows = t("customer").select(F.col("c_custkey").alias("link_id"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 60).cast("string")).alias("name"))
    return links.linked_by_name(rows, t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")))


@query("balls_by_player", """
    select player_id, string_agg(play_result || ':' || y::int::string, ',' order by y, play_result) as events from balls group by all""")  # fmt: skip
def balls_by_player(t):
    found = links.events_by_player(t("balls"), ["y", "play_result"], ["play_result", "y"])
    return found.select("player_id", F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["play_result"], e["y"].cast("int").cast("string"))), ",").alias("events"))


@query("opponents_ordered", f"""
    select team_id, season_id, opponent_id, row_number() over (partition by team_id, season_id order by next_date nulls last, lower(name), opponent_id) as nth from (
        select team_id, season_id, opponent_id, min(case when game_date >= date '1997-06-15' then game_date end) as next_date from {_SIDES} group by all) as o left join teams on id = opponent_id""")  # fmt: skip
def opponents_ordered(t):
    rows = games.opponents(t("games"), _day()).join(t("teams").select(F.col("id").alias("opponent_id"), "name"), "opponent_id", "left")
    return links.top_rows(rows, ["team_id", "season_id"], [F.col("next_date").asc_nulls_last(), F.lower("name").asc_nulls_last(), F.asc("opponent_id")], 1 << 30).select("team_id", "season_id", "opponent_id", "nth")
