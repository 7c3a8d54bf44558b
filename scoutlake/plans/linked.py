"""Queries of `operators.linking`: links made, undone, repaired and resolved, with what follows in other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.operators import linking
from scoutlake.plans.catalog import query

YEAR = 2026


def _snapshot(t):
    return {"teams": t("link_teams"), "links": t("link_rows"), "opponents": t("link_opponents"), "games": t("link_games"), "perspectives": t("link_perspectives")}


def _stub(our: str, name: str, teams: str, opponents: str) -> str:
    pick = "coalesce(max(id) filter (public_id is null), case when count(*) = 1 then max(id) end)"
    near = f"{teams} as s join {opponents} as o on o.opponent_team_id = s.id where s.name = {name} and s.membership_type = 'tracked' and o.our_team_id = {our}"
    return f"case when exists (select 1 from {near}) then (select {pick.replace('id)', 's.id)')} from {near}) else (select {pick} from {teams} as s where s.name = {name} and s.membership_type = 'tracked') end"


_SAVED = f"""
    stubbed as (select r.*, {_stub('r.our_team_id', 'r.opponent_name', 'link_teams', 'link_opponents')} as stub_id from link_requests as r),
    owned as (select s.*, o.id as owner_id, o.name as owner_name from stubbed as s left join link_teams as o on o.public_id = s.public_id),
    numbered as (select public_id, row_number() over (order by public_id) + (select max(id) from link_teams) as fresh_id from (select distinct public_id from owned where stub_id is null and owner_id is null) as f),
    decided as (select o.*, fresh_id, stub_id is not null and owner_id is not null and owner_id <> stub_id as merged, case when stub_id is null or owner_id <> stub_id then coalesce(owner_id, fresh_id, stub_id) else stub_id end as resolved_team_id from owned as o left join numbered using (public_id)),
    slugs as (select stub_id as id, arg_max(public_id, seq) as slug from decided where stub_id is not null and not merged group by all),
    named as (select t.id, name, membership_type, coalesce(slug, public_id) as public_id, gc_uuid, season_year, is_active from link_teams as t left join slugs using (id) union all select fresh_id, arg_min(opponent_name, seq), 'tracked', public_id, null, null, 0 from decided where fresh_id is not null group by fresh_id, public_id),
    again as (select d.*, {_stub('d.our_team_id', 'd.opponent_name', 'named', 'link_opponents')} as found from decided as d),
    final as (select *, case when found <> resolved_team_id then found end as old_id from again),
    names as (select old_id, arg_min(resolved_team_id, seq) as new_id from final where old_id is not null group by all),
    fresh_pairs as (select f.our_team_id, f.resolved_team_id as opponent_team_id, arg_min(coalesce(o.first_seen_year, t.season_year, {YEAR}), f.seq) as first_seen_year from final as f left join link_opponents as o on o.our_team_id = f.our_team_id and o.opponent_team_id = f.old_id left join named as t on t.id = f.our_team_id group by all)"""


def _saved(t):
    return linking.save_manual_links(_snapshot(t), t("link_requests"), F.lit("now"), YEAR)


@query("link_saved_teams", f"with {_SAVED} select id, name, membership_type, public_id, gc_uuid, season_year, case when id in (select resolved_team_id from final) then 1 else is_active end as is_active from named")
def link_saved_teams(t):
    return _saved(t)[0]["teams"]


@query("link_saved_links", f"with {_SAVED} select r.* replace (case when d.link_id is null then r.public_id else d.public_id end as public_id, case when d.link_id is null then resolution_method else 'manual' end as resolution_method, case when d.link_id is null then r.resolved_team_id else d.resolved_team_id end as resolved_team_id, case when d.link_id is null then resolved_at else 'now' end as resolved_at) from link_rows as r left join decided as d on d.link_id = r.id")
def link_saved_links(t):
    return _saved(t)[0]["links"]


@query("link_saved_opponents", f"""with {_SAVED} select * from link_opponents as o where not exists (select 1 from final as f where f.our_team_id = o.our_team_id and f.old_id = o.opponent_team_id)
    union all select * from fresh_pairs as p where not exists (select 1 from link_opponents as o where o.our_team_id = p.our_team_id and o.opponent_team_id = p.opponent_team_id)""")  # fmt: skip
def link_saved_opponents(t):
    return _saved(t)[0]["opponents"]


_GAMES = f"""home as (select game_id, case when new_id is null or game_stream_id is not null and (taken or nth > 1) then home_team_id else new_id end as home_team_id, away_team_id, game_stream_id from (
        select g.*, new_id, dense_rank() over (partition by new_id, game_stream_id order by g.home_team_id) as nth, exists (select 1 from link_games as y where y.home_team_id = new_id and y.game_stream_id = g.game_stream_id) as taken from link_games as g left join names on old_id = g.home_team_id) as z),
    away as (select game_id, home_team_id, case when new_id is null or game_stream_id is not null and (taken or nth > 1) then away_team_id else new_id end as away_team_id, game_stream_id from (
        select g.*, new_id, dense_rank() over (partition by new_id, game_stream_id order by g.away_team_id) as nth, exists (select 1 from home as y where y.away_team_id = new_id and y.game_stream_id = g.game_stream_id) as taken from home as g left join names on old_id = g.away_team_id) as z),
    seen as (select game_id, coalesce(new_id, perspective_team_id) as perspective_team_id, perspective_team_id as was from (select p.*, new_id, row_number() over (partition by game_id, new_id order by perspective_team_id) as nth, exists (select 1 from link_perspectives as y where y.game_id = p.game_id and y.perspective_team_id = new_id) as taken
        from link_perspectives as p left join names on old_id = p.perspective_team_id) as z where new_id is null or nth = 1 and not taken)"""


@query("link_saved_games", f"with {_SAVED}, {_GAMES} select * from away")
def link_saved_games(t):
    return _saved(t)[0]["games"]


@query("link_saved_perspectives", f"with {_SAVED}, {_GAMES} select game_id, perspective_team_id from seen")
def link_saved_perspectives(t):
    return _saved(t)[0]["perspectives"]


_DISCONNECTED = f"""asked as (select s_suppkey * 2 as id from supplier), manual as (select l.* from link_rows as l join asked using (id) where resolution_method = 'manual'),
    judged as (select m.*, coalesce({_stub('m.our_team_id', 'm.opponent_name', 'link_teams', 'link_opponents')} <> resolved_team_id, false) as is_merge from manual as m where resolved_team_id is not null),
    bare as (select resolved_team_id from judged group by all having not arg_max(is_merge, id) and resolved_team_id not in (select resolved_team_id from link_rows where resolved_team_id is not null and id not in (select id from manual)))"""


def _undone(t):
    ids = t("supplier").select((F.col("s_suppkey") * 2).alias("id"))
    return linking.disconnected(_snapshot(t), ids)


@query("link_undone", f"with {_DISCONNECTED} select id, id in (select id from manual) as disconnected from asked")
def link_undone(t):
    return _undone(t)[1]


@query("link_undone_teams", f"with {_DISCONNECTED} select * replace (case when id in (select resolved_team_id from bare) then null else public_id end as public_id) from link_teams")
def link_undone_teams(t):
    return _undone(t)[0]["teams"]


@query("link_stubs", f"select our_team_id, opponent_name, {_stub('r.our_team_id', 'r.opponent_name', 'link_teams', 'link_opponents')} as stub_id from (select distinct our_team_id, opponent_name from link_rows) as r")
def link_stubs(t):
    return linking.tracked_stubs(t("link_rows"), t("link_teams"), t("link_opponents"))


@query("link_repairs", f"""
    with stubs as (select our_team_id, opponent_name, {_stub('r.our_team_id', 'r.opponent_name', 'link_teams', 'link_opponents')} as stub_id from (select distinct our_team_id, opponent_name from link_rows) as r)
    select l.id as link_id, l.our_team_id, resolved_team_id, case when stub_id <> resolved_team_id then 'REPLACE stub (team ' || stub_id || ')' when o.our_team_id is null then 'CREATE' when coalesce(t.is_active, 0) <> 1 then 'ACTIVATE' else 'VERIFY' end as action, coalesce(t.is_active, 0) <> 1 as activates
    from link_rows as l join link_teams as our on our.id = l.our_team_id join stubs using (our_team_id, opponent_name) left join link_opponents as o on o.our_team_id = l.our_team_id and o.opponent_team_id = resolved_team_id left join link_teams as t on t.id = resolved_team_id where resolved_team_id is not null""")  # fmt: skip
def link_repairs(t):
    return linking.repairs(_snapshot(t))


_RESOLVED = f"""
    feed as (select * from link_feed qualify row_number() over (partition by our_team_id, root_team_id order by seq desc) = 1),
    told as (select f.*, d.progenitor_team_id is not null as told, d.public_id as slug, coalesce(d.name, d.progenitor_team_id) as team_name, d.season_year as y, case when is_hidden then 'hidden' when f.progenitor_team_id is null then 'no progenitor' when d.progenitor_team_id is null then 'no details' else 'progenitor' end as why from feed as f left join link_details as d using (progenitor_team_id)),
    both_ as (select coalesce(l.our_team_id, n.our_team_id) as our_team_id, coalesce(l.root_team_id, n.root_team_id) as root_team_id, l.* exclude (our_team_id, root_team_id, opponent_name), coalesce(n.name, l.opponent_name) as opponent_name, n.why, n.progenitor_team_id, n.slug, n.team_name, n.y, coalesce(n.why = 'progenitor' and l.resolution_method is distinct from 'manual', false) as auto, coalesce(n.why = 'progenitor' and l.resolution_method = 'manual', false) as kept
        from link_rows as l full join (select * from told where why in ('no progenitor', 'progenitor')) as n on l.our_team_id = n.our_team_id and l.root_team_id = n.root_team_id),
    open_ as (select b.*, b.resolution_method is null and not b.auto as is_open, coalesce(t.season_year, {YEAR}) as our_year from both_ as b left join link_teams as t on t.id = b.our_team_id),
    hit as (select lower(query) as q, season_year, count(*) as n, min({{'u': gc_uuid, 's': public_id, 't': name}}) as h from link_hits where lower(query) = lower(name) group by all),
    looked as (select o.*, n, h, case when auto then 'auto' when is_open and n = 1 then 'search' end as method from open_ as o left join hit on is_open and q = lower(opponent_name) and hit.season_year = our_year),
    want as (select *, case when auto then progenitor_team_id when method = 'search' then h.u end as uuid, case when auto then slug else h.s end as ws, case when auto then team_name else h.t end as wn, case when auto then y else our_year end as wy from looked),
    wants as (select uuid, min({{'s': coalesce(ws, ''), 'n': wn, 'y': wy}}) as w from want where uuid is not null group by all),
    found as (select uuid, nullif(w.s, '') as ws, (select min(id) from link_teams where gc_uuid = uuid) as a, (select min(id) from link_teams where public_id = nullif(w.s, '')) as b, (select min(id) from link_teams as t where membership_type = 'tracked' and lower(t.name) = lower(w.n) and t.season_year is not distinct from w.y) as c from wants),
    fresh as (select uuid, row_number() over (order by uuid) + (select max(id) from link_teams) as fresh_id from found where coalesce(a, b, c) is null),
    ids as (select uuid, coalesce(a, b, c, fresh_id) as team_id, case when coalesce(a, b, c) is null then ws else t.public_id end as has, ws, case when a is not null then 'uuid' when b is not null then 'slug' when c is not null then 'name' else 'new' end as how from found left join fresh using (uuid) left join link_teams as t on t.id = coalesce(a, b, c))"""


def _resolved(t):
    return linking.resolve_opponents(t("link_rows"), t("link_feed"), t("link_details"), t("link_hits"), t("link_teams"), F.lit("now"), YEAR)


@query("link_resolved", f"""with {_RESOLVED} select id, our_team_id, root_team_id, opponent_name, coalesce(is_hidden, 0) as is_hidden, case when method is null then public_id when method = 'search' then coalesce(has, ids.ws) else has end as public_id,
    coalesce(method, resolution_method) as resolution_method, case when method is null then resolved_team_id else team_id end as resolved_team_id, case when method is null then resolved_at else 'now' end as resolved_at from want left join ids using (uuid)""")  # fmt: skip
def link_resolved(t):
    return _resolved(t)[0].withColumn("is_hidden", F.col("is_hidden").cast("bigint"))


@query("link_resolved_log", f"""with {_RESOLVED} select our_team_id, root_team_id, method, case when kept then 'manual link kept' when method = 'auto' then 'progenitor, team by ' || how when method = 'search' then 'one match, team by ' || how when is_open then case when n is null then 'no exact match' else n || ' matches' end end as reason
    from want left join ids using (uuid) where (why is not null or is_open) and not exists (select 1 from told as x where x.our_team_id = want.our_team_id and x.root_team_id = want.root_team_id and x.why in ('hidden', 'no details'))
    union all select our_team_id, root_team_id, null, why from told where why in ('hidden', 'no details')""")  # fmt: skip
def link_resolved_log(t):
    return _resolved(t)[1]
