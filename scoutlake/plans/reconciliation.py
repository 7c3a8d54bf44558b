"""Queries of `operators.reconcile`: signals found, signals after correction, corrections and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.operators import reconcile
from scoutlake.plans.catalog import query

_PAIR = "game_id, perspective_team_id"
_KEYS = f"{_PAIR}, team_id"
_HITS, _OUTS, _WALKS = "outcome in ('Single', 'Double', 'Triple', 'Home Run')", "outcome in ('Strikeout', 'Dropped 3rd Strike')", "outcome in ('Walk', 'Intentional Walk')"
_NO_AT_BAT = "outcome in ('Walk', 'Hit By Pitch', 'Sacrifice Fly', 'Sacrifice Bunt', 'Catcher''s Interference', 'Intentional Walk')"
_COLUMNS = f"{_KEYS}, player_id, signal_name, category, boxscore_value, plays_value, boxscore_value - plays_value as delta"

_BASE = f"""
    pairs as (select distinct {_PAIR} from recon_plays),
    side as (select {_PAIR}, home_team_id as team_id, 'top' as half, 'bottom' as bat_half, home_score as score, home_score is not null and away_score is not null as scored from pairs join recon_games using (game_id)
        union all select {_PAIR}, away_team_id, 'bottom', 'top', away_score, home_score is not null and away_score is not null from pairs join recon_games using (game_id)),
    seen as (select {_PAIR}, play_order, count(*) filter (pitch_result in ('strike_looking', 'strike_swinging', 'foul', 'foul_tip', 'in_play')) as strikes, count(*) filter (lower(template) like '%wild pitch%') as wild from recon_events group by all),
    thrown as (select side.team_id, p.*, coalesce(strikes, 0) as strikes, coalesce(wild, 0) as wild, row_number() over (partition by {_PAIR}, half order by play_order) as n, count(*) over (partition by {_PAIR}, half) as plays from recon_plays as p join side using ({_PAIR}, half) left join seen using ({_PAIR}, play_order)),
    listed as (select recon_pitching.*, row_number() over (partition by {_KEYS} order by appearance_order nulls last, seq) as nth, row_number() over (partition by {_KEYS}, player_id order by seq desc) as latest from recon_pitching semi join side using ({_KEYS})),
    box as (select * from listed where latest = 1),
    orders as (select {_KEYS}, list(player_id::varchar order by nth) as b, count(*) as pitchers, count(distinct player_id) as different from listed group by all),
    bounds as (select {_KEYS}, player_id, sum(bf) over (partition by {_KEYS} order by nth) - bf as low, sum(bf) over (partition by {_KEYS} order by nth) as high, sum(bf) over (partition by {_KEYS}) as faced from box join listed using ({_KEYS}, player_id, bf, nth)),
    given as (select {_PAIR}, play_order, player_id as new_id from thrown join orders using ({_KEYS}) join bounds using ({_KEYS}) where pitchers > 1 and pitchers = different and faced = plays and n > low and n <= high),
    moved as (select thrown.* exclude (pitcher_id), pitcher_id as old_id, coalesce(new_id, pitcher_id) as pitcher_id from thrown left join given using ({_PAIR}, play_order)),
    changes as (select * from moved where pitcher_id is distinct from old_id)"""


def _pitchers(name: str, source: str) -> str:
    """The pitchers' signals over the plays in `source`."""
    values = {"bf": "count(*)", "ip_outs": "sum((did_outs_change <> 0)::int)", "so": f"sum(({_OUTS})::int)", "bb": f"sum(({_WALKS})::int)", "hbp": "sum((outcome = 'Hit By Pitch')::int)", "pitches": "sum(pitch_count)", "total_strikes": "sum(strikes)", "h": f"sum(({_HITS})::int)", "wp": "sum(wild)"}
    rows = []
    for s in values:
        box, plays, detail = f"coalesce(x_{s}, 0)::bigint", f"coalesce(d_{s}, 0)::bigint", "null::varchar"
        if s in reconcile.SUPPLEMENTED:
            detail = f"case when agree then to_json({{'boxscore_supplement': true, 'plays_{s}': {plays}, 'boxscore_{s}': {box}, 'gate': '{reconcile.GATE}'}})::varchar end"
            plays = f"case when agree then {box} else {plays} end"
        off = "'AMBIGUOUS'" if s in reconcile.UNCLEAR else "case when in_box is null or in_plays is null then 'UNCORRECTABLE' else 'CORRECTABLE' end"
        rows.append(f"select {_KEYS}, player_id::varchar as player_id, 'pitcher_{s}' as signal_name, {box} as boxscore_value, {plays} as plays_value, case when {box} = {plays} then 'MATCH' else {off} end as status, {detail} as correction_detail from {name}_both")
    return f"""
    {name}_d as (select {_KEYS}, pitcher_id as player_id, {", ".join(f"{v} as d_{s}" for s, v in values.items())}, min(play_order) as first_play, true as in_plays from {source} where pitcher_id is not null group by all),
    {name}_x as (select {_KEYS}, player_id, {", ".join(f"{s} as x_{s}" for s in values)}, true as in_box from box),
    {name}_both as (select *, coalesce(x_bf, 0) = d_bf and coalesce(x_so, 0) = d_so and coalesce(x_bb, 0) = d_bb and x_pitches is not null and x_total_strikes is not null and in_box and in_plays as agree from {name}_x full join {name}_d using ({_KEYS}, player_id)),
    {name}_order as (select {_KEYS}, coalesce(b, []::varchar[]) as b, coalesce(p, []::varchar[]) as p from side left join orders using ({_KEYS}) left join (select {_KEYS}, list(player_id::varchar order by first_play) as p from {name}_d group by all) as o using ({_KEYS})),
    {name} as ({" union all ".join(rows)}
        union all select {_KEYS}, coalesce(b[1], p[1]), 'pitcher_starter_id', (b[1] is not null)::bigint, (p[1] is not null)::bigint, case when b[1] is not distinct from p[1] then 'MATCH' else 'CORRECTABLE' end,
            case when b[1] is distinct from p[1] then to_json({{'boxscore_starter': b[1], 'plays_starter': p[1]}})::varchar end from {name}_order where len(b) + len(p) > 0
        union all select {_KEYS}, coalesce(b[1], '{reconcile.WHOLE_GAME}'), 'pitcher_order', len(b), len(p), case when b = p then 'MATCH' else 'CORRECTABLE' end, case when b <> p then to_json({{'boxscore_order': b, 'plays_order': p}})::varchar end from {name}_order)"""


_FOR_BATTERS = {"ab": f"sum((not ({_NO_AT_BAT}))::int)", "h": f"sum(({_HITS})::int)", "so": f"sum(({_OUTS})::int)", "bb": f"sum(({_WALKS})::int)", "hbp": "sum((outcome = 'Hit By Pitch')::int)"}
_OTHERS = f"""
    hit as (select side.team_id, p.* from recon_plays as p join side on p.game_id = side.game_id and p.perspective_team_id = side.perspective_team_id and p.half = side.bat_half),
    hit_d as (select {_KEYS}, batter_id as player_id, {", ".join(f"{v} as d_{s}" for s, v in _FOR_BATTERS.items())} from hit where batter_id is not null group by all),
    hit_x as (select {_KEYS}, player_id, {", ".join(f"{s} as x_{s}" for s in _FOR_BATTERS)} from recon_batting semi join side using ({_KEYS})),
    hitters as (select * from hit_x full join hit_d using ({_KEYS}, player_id)),
    whole as (select {_KEYS}, scored, score, (select sum(bf) from recon_pitching as x where x.game_id = side.game_id and x.perspective_team_id = side.perspective_team_id and x.team_id = side.team_id) as faced,
        coalesce((select sum(h) from recon_batting as x where x.game_id = side.game_id and x.perspective_team_id = side.perspective_team_id and x.team_id = side.team_id), 0)::bigint as xh,
        coalesce((select sum(({_HITS})::int) from hit as x where x.game_id = side.game_id and x.perspective_team_id = side.perspective_team_id and x.team_id = side.team_id), 0)::bigint as dh from side),
    others as ({" union all ".join(f"select {_KEYS}, player_id::varchar as player_id, 'batter_{s}' as signal_name, 'batter' as category, coalesce(x_{s}, 0)::bigint as boxscore_value, coalesce(d_{s}, 0)::bigint as plays_value from hitters" for s in _FOR_BATTERS)}
        union all select {_KEYS}, '{reconcile.WHOLE_GAME}', 'game_pa_count', 'game_level', faced, faced from whole where faced > 0
        union all select {_KEYS}, '{reconcile.WHOLE_GAME}', 'game_runs', 'game_level', score, score from whole where scored
        union all select {_KEYS}, '{reconcile.WHOLE_GAME}', 'game_hits', 'game_level', xh, dh from whole)"""
_AMBIGUOUS = "case when boxscore_value = plays_value then 'MATCH' else 'AMBIGUOUS' end"
_DELTA = "case when signal_name in ('pitcher_starter_id', 'pitcher_order') then (status <> 'MATCH')::bigint else boxscore_value - plays_value end"
_DETECTED = f"""{_BASE}, {_pitchers("found", "thrown")}, {_OTHERS},
    detected as (select {_KEYS}, player_id, signal_name, 'pitcher' as category, boxscore_value, plays_value, {_DELTA} as delta, status, correction_detail from found
        union all select {_COLUMNS}, {_AMBIGUOUS}, null from others)"""
_EXECUTED = f"""{_DETECTED}, {_pitchers("again", "moved")},
    lists as (select {_PAIR}, to_json(list({{'play_order': play_order, 'old_pitcher_id': old_id::varchar, 'new_pitcher_id': pitcher_id::varchar}} order by half desc, play_order))::varchar as changes from changes group by all),
    joined as (select again.*, found.status as pre_status, changes, again.status = 'MATCH' and coalesce(found.status = 'CORRECTABLE', false) as mended from again left join found using ({_KEYS}, player_id, signal_name) left join lists using ({_PAIR})),
    executed as (select {_KEYS}, player_id, signal_name, 'pitcher' as category, boxscore_value, plays_value, {_DELTA} as delta, case when mended then 'CORRECTED' else status end as status,
            case when not mended or changes is null then correction_detail when correction_detail is null then changes else left(correction_detail, length(correction_detail) - 1) || ',"reassignments":' || changes || '}}' end as correction_detail, pre_status from joined
        union all select {_COLUMNS}, {_AMBIGUOUS}, null, {_AMBIGUOUS} from others)"""


def _tables(t):
    return reconcile.with_event_counts(t("recon_plays"), t("recon_events")), t("recon_games"), t("recon_pitching"), t("recon_batting")


@query("recon_signals", f"with {_DETECTED} select * from detected")
def recon_signals(t):
    return reconcile.detected(*_tables(t))


@query("recon_executed", f"with {_EXECUTED} select * from executed")
def recon_executed(t):
    return reconcile.executed(*_tables(t))[0]


@query("recon_corrections", f"with {_BASE} select {_KEYS}, half, play_order, old_id as old_pitcher_id, pitcher_id as new_pitcher_id from changes")
def recon_corrections(t):
    return reconcile.executed(*_tables(t))[1]


_BY_GAME = f"""select {_PAIR}, count(*) as signals, bool_and(status = 'MATCH') as all_match, bool_or(status = 'CORRECTABLE') as correctable, bool_or(status = 'AMBIGUOUS') as ambiguous,
    any_value((select count(*) from changes as c where c.game_id = executed.game_id and c.perspective_team_id = executed.perspective_team_id)) as reassigned from executed group by {_PAIR}"""


@query("recon_by_game", f"with {_EXECUTED} {_BY_GAME}")
def recon_by_game(t):
    return reconcile.by_game(*reconcile.executed(*_tables(t)))


@query("recon_totals", f"""with {_EXECUTED}, each as ({_BY_GAME}) select count(signals) as games_processed, count(*) - count(signals) as games_skipped, sum(all_match::int)::bigint as games_all_match, sum(correctable::int)::bigint as games_with_correctable,
    sum(ambiguous::int)::bigint as games_with_ambiguous, sum((reassigned > 0)::int)::bigint as games_corrected, sum((reassigned = 0)::int)::bigint as games_unchanged, sum(reassigned)::bigint as plays_reassigned from pairs left join each using ({_PAIR})""")  # fmt: skip
def recon_totals(t):
    plays, *rest = _tables(t)
    return reconcile.run_totals(plays, *reconcile.executed(plays, *rest))


@query("recon_signal_counts", f"with {_EXECUTED} select category, signal_name, pre_status, status, count(*) as n from executed group by all")
def recon_signal_counts(t):
    return reconcile.signal_counts(reconcile.executed(*_tables(t))[0])


@query("recon_latest", f"""with {_EXECUTED}, runs as (select 1 as run, perspective_team_id, game_id, team_id, player_id, signal_name, category, status from detected union all select 2, perspective_team_id, game_id, team_id, player_id, signal_name, category, status from executed where game_id % 2 = 0)
    select category, signal_name, status, count(*) as n from (select * from runs qualify row_number() over (partition by game_id, team_id, player_id, signal_name order by run desc, perspective_team_id desc) = 1) as r group by all""")  # fmt: skip
def recon_latest(t):
    """A first run that only looks, and a second that corrects the games with even numbers."""
    tables = _tables(t)
    seq = F.col("perspective_team_id").alias("ingest_seq")
    first = reconcile.detected(*tables).select("*", F.lit(1).alias("created_at"), seq)
    second = reconcile.executed(*tables)[0].filter("game_id % 2 = 0").select("*", F.lit(2).alias("created_at"), seq).drop("pre_status")
    return reconcile.latest_counts(first.unionByName(second))


@query("recon_perspective", """select game_id, min_by(perspective_team_id, case when perspective_team_id = home_team_id then 0 when perspective_team_id = away_team_id then 1 else 2 end * 1000 + perspective_team_id) as perspective_team_id
    from recon_plays join recon_games using (game_id) group by game_id""")  # fmt: skip
def recon_perspective(t):
    return reconcile.default_perspective(t("recon_plays"), t("recon_games"))
