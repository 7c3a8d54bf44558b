"""Queries of `operators.prediction`: leagues, who starts next and why, rest tables, bullpens, and all of it as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.operators import prediction
from scoutlake.plans.catalog import REFERENCE_DAY, day, query

_T = "team_id, season_id"
_RE = lambda p: p.replace("(?i)", "").replace("'", "''")
_BODY = " ".join(f"when list_contains(listed, '{b}') then " + (f"case when {' or '.join(f'contains(lower(name), {w!r})' for w in prediction.BELOW_VARSITY)} then 'nsaa_subvarsity' else 'nsaa_varsity' end" if n == "nsaa" else f"'{n}'") for b, n in prediction.BODIES)
_WORDS = " ".join(f"when regexp_matches(name, '{_RE(p)}', 'i') then '{n}'" for p, n in prediction.NAME_WORDS)


@query("league_levels", f"""
    select id, case when program_type = 'hs' then case when classification in ('jv', 'freshman', 'reserve') then 'nsaa_subvarsity' else 'nsaa_varsity' end when program_type in ('legion', 'usssa') then program_type
        when len(listed) > 0 then case {_BODY} else 'unknown' end when regexp_matches(age_group, '\\d+U\\b', 'i') then 'youth_travel' else case {_WORDS} else 'unknown' end end as league
    from (select *, case when json_valid(ngb) and json_type(ngb) = 'ARRAY' then list_transform(json_extract_string(ngb, '$[*]'), lambda x: lower(x)) else [] end as listed from league_teams) as r""")  # fmt: skip
def league_levels(t):
    named = prediction.league(*(F.col(c) for c in ("program_type", "classification", "ngb", "age_group", "name")))
    return t("league_teams").select("id", named.alias("league"))


def _tiers(rules: str) -> str:
    """Days of rest after `total` pitches."""
    from scoutlake.operators import pitching

    tiers = pitching.RULES[rules]
    return "case when total < 1 then 0 " + " ".join(f"when total <= {high} then {rest}" for _, high, rest in tiers) + f" else {tiers[-1][2]} end"


_BASE = f"""
    asked as (select *, case league when 'legion' then 'legion' when 'nsaa_subvarsity' then 'subvarsity' when 'nsaa_varsity' then case when month(reference) < 4 then 'early' else 'late' end end as rules from predict_asked),
    numbered as (select *, row_number() over (partition by {_T} order by game_date, start_time nulls last, appearance_order nulls last, game_id, seq) as pos from predict_pitching where perspective_team_id = team_id and status = 'completed'),
    hist as (select *, case when max(appearance_order) over (partition by {_T}, player_id) is not null then coalesce(appearance_order = 1, false) else row_number() over (partition by {_T}, game_id order by ip_outs desc, pos) = 1 and ip_outs > 0 end as is_start from numbered),
    started as (select *, date_diff('day', lag(game_date) over (partition by {_T}, player_id order by pos), game_date) as rest, row_number() over (partition by {_T}, player_id order by pos desc) as back from hist where is_start),
    logs as (select {_T}, player_id, list({{'game_date': game_date, 'ip_outs': ip_outs, 'pitches': pitches, 'so': so, 'bb': bb, 'decision': decision, 'rest': rest}} order by pos) as recent from started where back <= 5 group by all),
    played as (select {_T}, game_id, min(pos) as pos, min(game_date) as game_date, arg_min(player_id, (appearance_order is distinct from 1, case when appearance_order = 1 then 0 else -ip_outs end, pos)) as starter, bool_or(appearance_order = 2) as second from hist group by all),
    sea as (select {_T}, count(*) as team_games, count(*) filter (second) as sampled, list(starter order by pos) as seq from played group by all),
    cyc as (select *, list_distinct_ordered[-1] as x from (select *, null as list_distinct_ordered from sea) as z),
    recent as (select {_T}, unnest(seq[-(2 * len(list_distinct(seq))):]) as starter, unnest(range(1, len(seq[-(2 * len(list_distinct(seq))):]) + 1)) as i, seq[-1] as final from sea),
    places as (select {_T}, starter as player_id, any_value(final) as final, row_number() over (partition by {_T} order by min(i)) as place, count(*) over (partition by {_T}) as size from recent group by {_T}, starter),
    weights as (select {_T}, player_id, place, size, case when place = (max(case when player_id = final then place end) over (partition by {_T})) % size + 1 then 0.70::double else {0.70 * 0.1!r}::double / greatest(size - 1, 1) end as base from places),
    p as (select {_T}, player_id, count(*) as games, count(*) filter (is_start) as starts, sum(ip_outs) as outs, sum(so) as so, avg(pitches) as mean_pitches, min(pos) as first_pos, count(*) filter (appearance_order = 2) as relieved, min(pos) filter (appearance_order = 2) as first_relief,
        max(game_date) as last_date, list(pitches order by pos)[-1] as last_pitches from hist group by all),
    lastly as (select {_T}, player_id, sum(pitches)::bigint as total, bool_or(pitches is null) as gap from (select hist.*, max(game_date) over (partition by {_T}, player_id) as last_date from hist) as h where game_date = last_date group by all),
    lately as (select {_T}, player_id, count(*) as lately from hist join asked using ({_T}) where date_diff('day', game_date, reference) in (1, 2) group by all),
    work as (select {_T}, player_id, max(game_date) as last_outing, date_diff('day', max(game_date), any_value(reference)) as days_since, case when count(*) filter (game_date between reference - 6 and reference) = 0 then 0 else sum(pitches) filter (game_date between reference - 6 and reference) end::bigint as pitches_7d
        from predict_pitching join asked using ({_T}) where perspective_team_id = team_id group by all),
    full_ as (select p.*, asked.* exclude ({_T}), team_games, sampled, place, coalesce(base, 0.0) as base, total, gap, coalesce(lately, 0) as lately, last_outing, days_since, pitches_7d, trim(coalesce(first_name, '') || ' ' || last_name, '') as name, coalesce(round_even(so * 27.0::double / nullif(outs, 0), 2), 0.0) as k9, recent,
            date_diff('day', last_date, reference) as rested, case rules when 'early' then {_tiers("early")} when 'late' then {_tiers("late")} when 'subvarsity' then {_tiers("subvarsity")} when 'legion' then {_tiers("legion")} end as needed
        from p join asked using ({_T}) join sea using ({_T}) left join weights using ({_T}, player_id) join lastly using ({_T}, player_id) left join lately using ({_T}, player_id) left join work using ({_T}, player_id) left join predict_players using (player_id) left join logs using ({_T}, player_id)),
    judged as (select *, case when rules is null or rested < 0 then null when gap then '{prediction.UNKNOWN_PITCHES}' when rested < needed then rested || 'd rest -- needs ' || needed || ' (threw ' || total || ' pitches on ' || last_date::varchar || ')'
            when lately >= 2 then lately || ' appearances in last 3 days -- max 2 per 3-day period' end as reason, base + least(greatest(rested, 0)::double / 7.0::double, 1.0::double) * 0.30::double as score,
        row_number() over (partition by {_T} order by starts desc, first_pos) as by_starts, row_number() over (partition by {_T} order by (starts = 0) desc, games desc, first_pos) as by_games, row_number() over (partition by {_T} order by relieved desc, first_relief) as by_relief from full_),
    shares as (select {_T}, max(case when by_starts = 1 then starts end) as most, count(*) filter (starts > 0) as starters, coalesce(max(case when by_starts = 1 then starts end)::double / any_value(team_games), 0) as s1, coalesce(max(case when by_starts = 2 then starts end)::double / any_value(team_games), 0) as s2,
        coalesce(max(case when by_starts = 3 then starts end)::double / any_value(team_games), 0) as s3 from judged group by all),
    kinds as (select {_T}, most, least(starters, 2) as firsts, case when s1 >= 0.6 then 'ace-dominant' when s1 >= 0.3 and s2 >= 0.3 then case when s3 >= 0.2 then '3-man rotation' else '2-man rotation' end else 'committee' end as kind from shares),
    picked as (select *, row_number() over (partition by {_T} order by score desc, place nulls last, first_pos) as nth from judged join kinds using ({_T}) where starts > 0 and reason is null and rules is not null and team_games >= 4),
    cands as (select {_T}, nth, player_id, name, round_even(score, 3) as likelihood, starts as games_started, k9, coalesce(recent, []) as recent, array_to_string(list_filter([
            case when kind = 'ace-dominant' then case when nth > 1 then null when starts = most then 'Ace starter' else 'Next available starter' end when kind = 'committee' then 'Committee candidate' else 'Next in ' || kind end, rested || ' days rest', last_pitches || ' pitches last outing',
            case when not (starts::double / games >= 0.6 and starts >= 2) then 'spot starter -- recent start is anomalous' end, case when rested >= 10 then 'availability unknown' end, case when last_pitches < 50 then 'low pitch count last outing' when last_pitches > mean_pitches then 'high pitch count last outing' end,
            case when starts::double / team_games >= 0.70 then 'heavy usage' end], lambda x: x is not null), ', ') as reasoning from picked where nth <= 3),
    rests as (select {_T}, case when starts > 0 then by_starts else by_games + firsts end as nth, player_id, name, starts as games_started, last_outing, days_since, last_pitches, pitches_7d from judged join kinds using ({_T}) where starts > 0 and by_starts <= 2 or starts = 0 and by_games + firsts <= 3),
    pens as (select {_T}, row_number() over (partition by {_T} order by reason is not null, by_relief) as nth, player_id, name, relieved as frequency, sampled as games_sampled, reason from judged where relieved > 0 and by_relief <= 3 and rules is not null)""".replace("cyc as (select *, list_distinct_ordered[-1] as x from (select *, null as list_distinct_ordered from sea) as z),\n    ", "")
_SUMMARY = f"""
    tops as (select {_T}, count(*) as few, max(case when nth = 1 then player_id end) as top, max(case when nth = 1 then likelihood end) as l1, max(case when nth = 2 then likelihood end) as l2, max(case when nth = 2 then player_id end) as next_id, max(case when nth = 1 then games_started end) as gs, max(case when nth = 1 then k9 end) as k from cands group by all),
    fast as (select c.team_id, c.season_id, arg_min(player_id, nth) as faster from cands as c join tops on tops.team_id = c.team_id and tops.season_id = c.season_id where nth > 1 and k9 - k > 2.0 group by all),
    near as (select {_T}, game_date, date_diff('day', lag(game_date, 2) over (partition by {_T} order by game_date), game_date) as span, date_diff('day', lag(game_date) over (partition by {_T} order by game_date), game_date) as one, date_diff('day', lag(game_date, 2) over (partition by {_T} order by game_date), lag(game_date) over (partition by {_T} order by game_date)) as two
        from (select distinct {_T}, game_date, max(game_date) over (partition by {_T}) as final from played) as d where date_diff('day', game_date, final) < 7),
    dense as (select distinct {_T}, true as dense from near where one <= 1 and two <= 1),
    summed as (select asked.*, coalesce(team_games, 0) as team_games, kind, coalesce(few, 0) as few, top, l1, l2, next_id, gs, faster, dense, rules is null or coalesce(team_games, 0) < 4 as held from asked left join sea using ({_T}) left join kinds using ({_T}) left join tops using ({_T}) left join fast using ({_T}) left join dense using ({_T})),
    sure as (select *, case when held then 'suppress' when few = 0 then 'low' when few = 1 then 'high' when gs::double / team_games <= 0.30 then 'low' when l1 >= 2.0 * l2 then case when faster is not null then 'moderate' else 'high' end when kind <> 'committee' then 'moderate' else 'low' end as confidence from summed),
    whole as (select {_T}, league, reference::varchar as reference, confidence, case when confidence in ('high', 'moderate') then top end as predicted_starter, case when confidence in ('high', 'moderate') and few > 1 then case when l1 >= 2.0 * l2 then faster else coalesce(faster, next_id) end end as alternative,
        case when held then 'committee' else kind end as rotation_pattern, case when rules is null then case league {" ".join(f"when '{k}' then '{v}'" for k, v in prediction.WARNINGS.items())} else '{prediction.WARNINGS["unknown"]}' end
            when held then case when team_games <= 2 then 'Rest intervals not yet available -- ' || team_games || ' game(s) played' else 'Rotation pattern unclear -- 3 games played, rest data accumulating' end when dense then 'Compressed schedule detected -- rotation predictions less reliable.' end as data_note, team_games from sure)"""


def _over(sql: str, appearances: str, players: str, asked: str) -> str:
    """The same SQL over other tables."""
    return sql.replace("predict_pitching", appearances).replace("predict_players", players).replace("predict_asked", asked).replace("decision", "null::varchar")


_ALL = f"select distinct team_id, season_id, 'legion' as league, date '{REFERENCE_DAY}' as reference from pitching"


@query("starter_predict", f"""with every as ({_ALL}), {_over(_BASE + ", " + _SUMMARY, "pitching", "pitchers", "every").replace("'null::varchar': null::varchar", "'decision': null::varchar")}
    select {_T}, nth, player_id, likelihood, games_started as starts, reasoning, rotation_pattern as pattern, team_games, confidence from cands join whole using ({_T})""")  # fmt: skip
def starter_predict(t):
    """The candidates of every team's season on one day, all by one league's rules."""
    rows = t("pitching")
    asked = rows.select("team_id", "season_id").distinct().select("*", F.lit("legion").alias("league"), day().alias("reference"))
    made = prediction.predictions(rows, t("pitchers"), asked)
    each = made.select("team_id", "season_id", "rotation_pattern", "team_games", "confidence", F.explode("candidates").alias("c"))
    return each.select("team_id", "season_id", F.col("c.nth").cast("bigint").alias("nth"), "c.player_id", "c.likelihood", F.col("c.games_started").alias("starts"), "c.reasoning", F.col("rotation_pattern").alias("pattern"), "team_games", "confidence")


def _made(t):
    return prediction.predictions(t("predict_pitching"), t("predict_players"), t("predict_asked"))


def _flat(rows, column: str):
    return rows.select("team_id", "season_id", F.posexplode(column).alias("_n", "r")).select("team_id", "season_id", (F.col("_n") + 1).cast("bigint").alias("nth"), "r.*")


@query("prediction_summary", f"with {_BASE}, {_SUMMARY} select * from whole")
def prediction_summary(t):
    return _made(t).drop("candidates", "rest_table", "bullpen_order")


@query("prediction_candidates", f"with {_BASE} select {_T}, nth, player_id, name, likelihood, games_started, reasoning, len(recent) as n_recent from cands")
def prediction_candidates(t):
    rows = _made(t).select("team_id", "season_id", F.explode("candidates").alias("r")).select("team_id", "season_id", "r.*")
    return rows.withColumn("nth", F.col("nth").cast("bigint")).withColumn("n_recent", F.size("recent_starts").cast("bigint")).drop("recent_starts", "k9")


@query("prediction_recent_starts", f"with {_BASE} select {_T}, nth, r.game_date::varchar as game_date, r.ip_outs as ip_outs, r.pitches as pitches, r.so as so, r.bb as bb, r.decision as decision, r.rest as rest from (select {_T}, nth, unnest(recent) as r from cands) as x")
def prediction_recent_starts(t):
    rows = _made(t).select("team_id", "season_id", F.explode("candidates").alias("c")).select("team_id", "season_id", F.col("c.nth").cast("bigint").alias("nth"), F.explode("c.recent_starts").alias("r"))
    return rows.select("team_id", "season_id", "nth", "r.*").withColumn("rest", F.col("rest").cast("bigint"))


@query("prediction_rest", f"with {_BASE} select {_T}, nth, player_id, name, games_started, last_outing::varchar as last_outing, days_since, last_pitches, pitches_7d from rests")
def prediction_rest(t):
    return _flat(_made(t), "rest_table").drop("as_rest").withColumn("days_since", F.col("days_since").cast("bigint"))


@query("prediction_bullpen", f"with {_BASE} select {_T}, nth, player_id, name, frequency, games_sampled, reason from pens")
def prediction_bullpen(t):
    return _flat(_made(t), "bullpen_order").drop("away", "as_second")


def _lines(table: str, line: str, title: list[str], rule: int) -> str:
    head = " || chr(10) || ".join("'" + x + "'" for x in [*title, "-" * rule])
    return f"(select {_T}, {head} || chr(10) || string_agg({line}, chr(10) order by nth) as lines from {table} group by all)"


_DECIMAL = "lpad(printf('%.1f%%', likelihood * 100), 10, ' ')"
_STARTS = f"(select whole.team_id, whole.season_id, name, unnest(recent) as r, unnest(range(1, len(recent) + 1)) as nth from whole join cands on cands.team_id = whole.team_id and cands.season_id = whole.season_id and player_id = predicted_starter)"
_W = lambda c, n: f"case when length({c}) < {n} then lpad({c}, {n}, ' ') else {c} end"
_NAME = "case when length(name) < 20 then rpad(name, 20, ' ') else name end"
_TEXT = f"""
    a as {_lines("cands", f"{_NAME} || ' ' || {_W('games_started::varchar', 3)} || ' ' || {_DECIMAL} || ' ' || reasoning", ["## Top Starter Candidates", f"{'Name':<20} {'GS':>3} {'Likelihood':>10} Reasoning"], 70)},
    b as {_lines("rests", f"{_NAME} || ' ' || {_W('games_started::varchar', 3)} || ' ' || {_W('last_outing::varchar', 12)} || ' ' || {_W('days_since::varchar', 9)} || ' ' || " + _W("coalesce(last_pitches::varchar, '?')", 12) + " || ' ' || " + _W("coalesce(pitches_7d::varchar, '?')", 11), ["", "## Rest & Availability Table", f"{'Name':<20} {'GS':>3} {'Last Outing':>12} {'Days Rest':>9} {'Last Pitches':>12} {'7d Workload':>11}"], 80)},
    c as {_lines("pens", f"{_NAME} || ' ' || {_W('frequency::varchar', 4)} || ' ' || {_W('games_sampled::varchar', 13)} || ' ' || case when reason is null then 'available' else '(unavailable: ' || reason || ')' end", ["", "## Bullpen Order (by first-relief frequency)", f"{'Name':<20} {'Freq':>4} {'Games Sampled':>13} {'Status':<30}"], 70)},
    d as (select {_T}, chr(10) || '## Predicted Starter Recent Game Log' || chr(10) || 'Name: ' || any_value(name) || chr(10) || '{f"{'Date':<12} {'IP Outs':>7} {'Pitches':>7} {'K':>3} {'BB':>3} {'Dec':>3} {'Rest':>4}"}' || chr(10) || '{"-" * 50}' || chr(10)
        || string_agg(rpad(r.game_date::varchar, 12, ' ') || ' ' || {_W("r.ip_outs::varchar", 7)} || ' ' || {_W("coalesce(r.pitches::varchar, '?')", 7)} || ' ' || {_W("r.so::varchar", 3)} || ' ' || {_W("r.bb::varchar", 3)} || ' ' || {_W("coalesce(r.decision, '-')", 3)} || ' ' || {_W("coalesce(r.rest::varchar, '-')", 4)}, chr(10) order by nth) as lines from {_STARTS} as s group by all)"""


@query("prediction_text", f"""with {_BASE}, {_SUMMARY}, {_TEXT} select {_T}, concat_ws(chr(10), a.lines, b.lines, c.lines, d.lines) as text from whole left join a using ({_T}) left join b using ({_T}) left join c using ({_T}) left join d using ({_T})""")
def prediction_text(t):
    return prediction.as_text(_made(t))
