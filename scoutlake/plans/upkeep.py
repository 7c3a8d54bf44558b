"""Queries of `operators.removal`, of the load of batted balls, of outliers, and of what a page lists and chooses."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.operators import links, plays, removal, spray
from scoutlake.plans.catalog import query

_FREE = """free as (select id from gone_teams where id in (select team_id from gone_reports where dropped) and id not in (select team_id from gone_reports where not dropped) and id not in (select our_team_id from gone_links)
    and id not in (select resolved_team_id from gone_links) and id not in (select team_id from gone_access)),
    seen as (select distinct game_id, perspective_team_id from recon_plays), left_seen as (select * from seen where perspective_team_id not in (select id from free)),
    left_games as (select * from recon_games as g where not ((home_team_id in (select id from free) or away_team_id in (select id from free)) and game_id not in (select game_id from left_seen)))"""


def _snapshot(t):
    out = {n: t(f"recon_{n}") for n in ("games", "plays", "events", "batting", "pitching")} | {n: t(f"gone_{n}") for n in ("reports", "links", "access", "teams")}
    return out | {"perspectives": out["plays"].select("game_id", "perspective_team_id").distinct()}


def _removed(t):
    return removal.without_reports(_snapshot(t), t("gone_reports").filter("dropped").select("slug"))


@query("removed_teams", f"with {_FREE} select id from free")
def removed_teams(t):
    return _removed(t)[1]


@query("removal_teams", f"with {_FREE} select * from gone_teams where id not in (select id from free) or id in (select home_team_id from left_games union all select away_team_id from left_games)")
def removal_teams(t):
    """Those that games of others' perspectives still name stay."""
    return _removed(t)[0]["teams"]


@query("removal_games", f"with {_FREE} select * from left_games")
def removal_games(t):
    return _removed(t)[0]["games"]


@query("removal_plays", f"with {_FREE} select * from recon_plays where perspective_team_id not in (select id from free) and batting_team_id not in (select id from free)")
def removal_plays(t):
    return _removed(t)[0]["plays"]


@query("removal_events", f"with {_FREE} select e.* from recon_events as e join recon_plays as p using (game_id, perspective_team_id, play_order) where p.perspective_team_id not in (select id from free) and batting_team_id not in (select id from free)")
def removal_events(t):
    return _removed(t)[0]["events"]


@query("removal_pitching", f"with {_FREE} select * from recon_pitching where perspective_team_id not in (select id from free) and team_id not in (select id from free)")
def removal_pitching(t):
    return _removed(t)[0]["pitching"]


def _load(guess: bool) -> str:
    return f"""
    rows as (select e.*, t.id as perspective_team_id, home_team_id, away_team_id, exists (select 1 from ball_old as o where o.game_id = e.game_id and o.perspective_team_id = t.id) as seen_before,
        coalesce((select home_team_id from ball_rosters as r where r.player_id = e.player_id and r.season_id = e.season_id and r.team_id = home_team_id limit 1), (select away_team_id from ball_rosters as r where r.player_id = e.player_id and r.season_id = e.season_id and r.team_id = away_team_id limit 1),
            {"case when t.id = away_team_id then home_team_id else away_team_id end" if guess else "null"}) as team_id
        from ball_events as e join ball_teams as t using (gc_uuid) join recon_games using (game_id)),
    judged as (select *, team_id is not null and coalesce(event_id, '') <> '' and (not fielded or x is not null and y is not null) as whole from rows where not seen_before),
    numbered as (select *, whole and row_number() over (partition by event_id, perspective_team_id order by whole desc, section desc, seq) = 1 and not exists (select 1 from ball_old as o where o.event_id = judged.event_id and o.perspective_team_id = judged.perspective_team_id) as new from judged)"""


def _loaded(t, guess):
    return spray.load(t("ball_events"), t("ball_teams"), t("recon_games"), t("ball_rosters"), t("ball_old"), guess)


@query("balls_loaded", f"""with {_load(True)} select game_id, player_id, team_id, case section when 'offense' then 'offensive' else 'defensive' end as chart_type, play_type, play_result, case when fielded then x end as x, case when fielded then y end as y,
    case when fielded then fielder_position end as fielder_position, case when fielded then error end as error, event_id, created_at_ms, season_id, perspective_team_id from numbered where new""")  # fmt: skip
def balls_loaded(t):
    return _loaded(t, True)[0]


_COUNTS = "select game_id, perspective_team_id, sum(new::int)::bigint as loaded, sum((not new)::int)::bigint as skipped from numbered group by all union all select distinct game_id, perspective_team_id, 0, 1 from rows where seen_before"


@query("balls_load_counts", f"with {_load(True)} {_COUNTS}")
def balls_load_counts(t):
    return _loaded(t, True)[1]


@query("balls_scouted_counts", f"with {_load(False)} {_COUNTS}")
def balls_scouted_counts(t):
    """The scouting load, which does not guess whose a ball is."""
    return _loaded(t, False)[1]


# whose rates are off by more than the tolerance, against a box of another making
_OFF = """derived as (select pitcher_id as player_id, sum(is_first_pitch_strike)::bigint as derived from plays where pitcher_id is not null group by all),
    official as (select c_custkey as player_id, c_custkey % 7 as official from customer),
    off as (select player_id from derived join official using (player_id) where case when official = 0 then derived > 0 else abs(derived - official) * 100.0::double / official > 5 end)"""


def _outliers(t):
    mine = t("plays").filter("pitcher_id is not null").groupBy(F.col("pitcher_id").alias("player_id")).agg(F.sum("is_first_pitch_strike").cast("bigint").alias("so"))
    theirs = t("customer").select(F.col("c_custkey").alias("player_id"), (F.col("c_custkey") % 7).alias("so"))
    return plays.outliers(t("plays"), t("games"), plays.compared(mine, theirs, ["player_id"], "so"), "pitcher_id", "is_first_pitch_strike")


@query("outlier_games", f"""with {_OFF} select pitcher_id as player_id, game_id, coalesce(any_value(game_date)::varchar, 'unknown') as game_date, count(*) as plays, sum(is_first_pitch_strike)::bigint as flagged, (sum(is_first_pitch_strike) * 100)::double / count(*) as flagged_pct
    from plays left join games using (game_id) where pitcher_id in (select player_id from off) group by all""")  # fmt: skip
def outlier_games(t):
    return _outliers(t)[0]


@query("outlier_samples", f"""with {_OFF} select pitcher_id as player_id, row_number() over (partition by pitcher_id order by game_id, play_order) as nth, game_id, play_order, half, outcome, pitch_count, is_first_pitch_strike as flag_value
    from plays where pitcher_id in (select player_id from off) qualify nth <= 5""")  # fmt: skip
def outlier_samples(t):
    return _outliers(t)[1]


_LINKS = "(select id, our_team_id, resolved_team_id, opponent_name, resolved_at, resolution_method, cast(id % 10 = 0 as bigint) as is_hidden from link_rows) as shown_links"
_STATUS = {"all": "is_hidden = 0", "hidden": "is_hidden = 1", "unresolved": "is_hidden = 0 and resolved_team_id is null", "full": "is_hidden = 0 and resolved_team_id in (select s_suppkey * 3 from supplier)"}


def _register(status: str) -> None:
    def make(t):
        rows = t("link_rows").withColumn("is_hidden", (F.col("id") % 10 == 0).cast("bigint")).select("id", "our_team_id", "resolved_team_id", "opponent_name", "resolved_at", "resolution_method", "is_hidden")
        return links.listed_links(rows, t("supplier").select((F.col("s_suppkey") * 3).alias("team_id")), "nothing" if status == "all" else status, order="resolved" if status == "full" else "drop table", descending=status == "full").select("id", "our_team_id", "resolved_team_id", "nth")

    order = "resolved_at desc nulls last" if status == "full" else "opponent_name nulls last"
    query(f"links_{status}", f"select id, our_team_id, resolved_team_id, row_number() over (partition by our_team_id order by {order}, id) as nth from {_LINKS} where {_STATUS[status]}")(make)


for _status in _STATUS:
    _register(_status)


@query("season_choice", """
    with p as (select w.user_id, w.team_id as asked, w.year as asked_year, p.place, p.team_id, p.year, max(p.year) over (partition by w.user_id) as latest from season_wanted as w join season_permitted as p using (user_id)),
    one as (select user_id, team_id, coalesce(year, 2023) as year, 1 as path from p where team_id = asked qualify row_number() over (partition by user_id order by place) = 1),
    two as (select user_id, team_id, year, 2 as path from p where year = asked_year and user_id not in (select user_id from one) qualify row_number() over (partition by user_id order by place) = 1),
    three as (select user_id, team_id, year, 3 as path from p where year = 2023 and user_id not in (select user_id from one union all select user_id from two) qualify row_number() over (partition by user_id order by place) = 1),
    four as (select user_id, team_id, year, 4 as path from p where year = latest and user_id not in (select user_id from one union all select user_id from two union all select user_id from three) qualify row_number() over (partition by user_id order by place) = 1),
    five as (select user_id, team_id, 2023 as year, 5 as path from p where user_id not in (select user_id from one union all select user_id from two union all select user_id from three union all select user_id from four) qualify row_number() over (partition by user_id order by place) = 1),
    picked as (select * from one union all select * from two union all select * from three union all select * from four union all select * from five)
    select user_id, team_id, year::bigint as year, path::bigint as path, coalesce((select max(season_id) from team_seasons as s where s.team_id = picked.team_id and starts_with(season_id, year::varchar)), (select max(season_id) from team_seasons as s where s.team_id = picked.team_id), year || '-spring-hs') as season_id from picked""")  # fmt: skip
def season_choice(t):
    return links.chosen_season(t("season_wanted"), t("season_permitted"), t("team_seasons"), F.lit(2023))
