"""Teams removed from a snapshot, with what hangs on them; what another team has seen of their games stays.

A snapshot is a dict of tables; those it lacks are passed over. A batch of teams is removed together: first every row that one
of them saw or that is anchored to one, then the games that no perspective is left of, then what is kept by team alone, and
last the teams that no game names any more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutlake.operators import links

#: Columns that name a team a row is seen by or anchored to.
ANCHORS = {
    "batting": ("perspective_team_id", "team_id"),
    "pitching": ("perspective_team_id", "team_id"),
    "balls": ("perspective_team_id", "team_id"),
    "discrepancies": ("perspective_team_id", "team_id"),
    "plays": ("perspective_team_id", "batting_team_id"),
    "perspectives": ("perspective_team_id",),
}
#: Tables that are kept by team alone.
OWNED = {t: ("team_id",) for t in ("rosters", "season_batting", "season_pitching", "scouting_runs", "jobs", "assignments", "access")} | {"opponents": ("our_team_id", "opponent_team_id")}


def without(rows: DataFrame, ids: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """rows in which none of the columns names one of ids (id)."""
    return reduce(lambda out, c: out.join(ids.select(F.col("id").alias(c)), c, "left_anti"), columns, rows).select(*rows.columns)


def without_teams(snapshot: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The snapshot after the teams ids (id) are removed."""
    ids = ids.select("id").distinct()
    out = snapshot | {t: without(snapshot[t], ids, columns) for t, columns in (ANCHORS | OWNED).items() if t in snapshot}
    if "events" in snapshot:
        key = ["game_id", "play_order", "perspective_team_id"]
        gone = snapshot["plays"].select(*key).join(out["plays"].select(*key), key, "left_anti")
        out["events"] = snapshot["events"].join(gone, key, "left_anti").select(*snapshot["events"].columns)
    games = snapshot["games"]
    touched = games.select("game_id", F.explode(F.array("home_team_id", "away_team_id")).alias("id")).join(ids, "id", "left_semi").select("game_id").distinct()
    lost = touched.join(out["perspectives"].select("game_id"), "game_id", "left_anti")
    out["games"] = games.join(lost, "game_id", "left_anti").select(*games.columns)
    if "links" in snapshot:
        rows = without(snapshot["links"], ids, ("our_team_id",)).join(ids.select(F.col("id").alias("resolved_team_id"), F.lit(True).alias("_gone")), "resolved_team_id", "left")
        out["links"] = rows.withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in ("resolved_team_id", "resolution_method", "resolved_at")}).select(*snapshot["links"].columns)
    held = out["games"].select(F.explode(F.array("home_team_id", "away_team_id")).alias("id"))
    out["teams"] = snapshot["teams"].join(ids.join(held, "id", "left_anti"), "id", "left_anti").select(*snapshot["teams"].columns)
    return out


def without_reports(snapshot: dict[str, DataFrame], slugs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The snapshot without reports (slug), and without their teams that nothing else needs; and those teams (id). Whether a
    team is needed is judged before anything goes but the reports."""
    reports = snapshot["reports"]
    left = reports.join(slugs.select("slug"), "slug", "left_anti").select(*reports.columns)
    asked = reports.join(slugs.select("slug"), "slug", "left_semi").select(F.col("team_id").alias("id")).distinct()
    free = links.removable_teams(snapshot["teams"], left, snapshot["links"], snapshot["access"], snapshot["games"]).join(asked, "id", "left_semi")
    return without_teams(snapshot | {"reports": left}, free), free
