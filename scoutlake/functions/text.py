"""Names, seasons, templates and other text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the input formats
UUID = r"\$\{([0-9a-f-]{36})\}"
SEASON_WORDS = {"spring": "Spring", "summer": "Summer", "fall": "Fall", "winter": "Winter"}
PROGRAM_SUFFIX = {"hs": "spring-hs", "usssa": "summer-usssa", "legion": "summer-legion"}


def lookup(key: Column, values: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for k, v in values.items():
        found = F.when(key == k, v).otherwise(found)
    return found


def full_name(first: str = "first_name", last: str = "last_name") -> Column:
    """`first last`, null where either is."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def shown_name(name: Column, jersey: Column) -> Column:
    """`Unknown Unknown` and null become `Player #NN`, or `Unknown Player` without a jersey number."""
    absent = name.isNull() | (F.trim(name) == "") | (name == "Unknown Unknown")
    number = F.when(F.trim(jersey) != "", F.concat(F.lit("Player #"), jersey)).otherwise("Unknown Player")
    return F.when(absent, number).otherwise(name)


def season_display(season: Column) -> Column:
    """`2026-spring-hs` as `Spring 2026`; what has no such form is shown as it is."""
    parts = F.split(season, "-", 3)
    word = F.get(parts, F.lit(1))
    return F.when(F.size(parts) >= 2, F.concat(F.initcap(word), F.lit(" "), F.get(parts, F.lit(0)))).otherwise(season)


def season_id(year: Column, program_type: Column, current_year: int) -> Column:
    """The season of a program's year; `default` where the program has no type."""
    suffix = F.coalesce(lookup(program_type, PROGRAM_SUFFIX), F.lit("default"))
    return F.concat(F.coalesce(year, F.lit(current_year)).cast("string"), F.lit("-"), suffix)


def jersey_number(jersey: Column) -> Column:
    """Leading digits as a number; 0 for other text, 9999 for null."""
    digits = F.regexp_extract(jersey, r"^\s*([+-]?\d+)", 1)
    return F.when(jersey.isNull(), F.lit(9999)).otherwise(F.coalesce(F.try_to_number(F.nullif(digits, F.lit("")), F.lit("S999999999")).cast("bigint"), F.lit(0)))


def normalised_name(name: Column) -> Column:
    """Marks become spaces, spaces are single, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def classification(name: Column) -> Column:
    """A team's level from its name: the first level that it mentions, else an age group from 8U to 14U; null if none."""
    low = F.lower(name)
    age = F.regexp_extract(name, r"\b(\d{1,2})[uU]\b", 1)
    return (
        F.when(low.contains("junior varsity") | low.contains(" jv ") | low.endswith(" jv"), "jv")
        .when(low.contains("varsity"), "varsity")
        .when(low.contains("freshman") | low.contains("frosh"), "freshman")
        .when(low.contains("reserve"), "reserve")
        .when(low.contains("legion"), "legion")
        .when(age.isin(*map(str, range(8, 15))), F.concat(age, F.lit("U")))
    )


def first_uuid(template: Column) -> Column:
    return F.nullif(F.regexp_extract(template, UUID, 1), F.lit(""))


def relative_day(date: Column, today: Column) -> Column:
    """`Today`, `1d ago`, `Nd ago`."""
    days = F.datediff(today, date)
    return F.when(days == 0, "Today").when(days > 0, F.concat(days.cast("string"), F.lit("d ago")))


def parsed_list(text: Column) -> Column:
    """A JSON list of strings in lower case; empty where it is none."""
    return F.coalesce(F.transform(F.from_json(text, "array<string>"), F.lower), F.array().cast("array<string>"))


# fixed values: what a team's name may end with beside the name itself
LEVEL_WORDS = ("varsity", "junior varsity", "jv", "freshman", "frosh", "reserve", "legion")


def without_level(name: Column) -> Column:
    """A team's name without all level words at its end, and ages such as 12U."""
    return F.regexp_replace(F.trim(name), r"(?i)(\s+(" + "|".join(LEVEL_WORDS) + r"|\d{1,2}u))+\s*$", "")


def team_key(given: Column) -> tuple[Column, Column]:
    """The identifier in an address `.../teams/{id}...` or given as it is, and its kind: uuid, slug (6 to 20 letters or digits) or null."""
    trimmed = F.trim(given)
    named = F.regexp_extract(trimmed, r"/teams/([A-Za-z0-9-]+)", 1)
    found = F.when(named != "", named).when(~trimmed.contains("/"), trimmed)
    kind = F.when(F.lower(found).rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "uuid").when(found.rlike(r"^[A-Za-z0-9]{6,20}$"), "slug")
    return F.when(kind.isNotNull(), found), kind


def program_of(name: Column, programs: dict[str, str]) -> Column:
    """The id of the longest program name that a team's name contains, any case; null for none (programs: name to id)."""
    out = F.lit(None).cast("string")
    for program in sorted(programs, key=lambda p: (len(p), p)):
        out = F.when(F.contains(F.lower(name), F.lit(program.lower())), programs[program]).otherwise(out)
    return out


def _rounded(value: Column, digits: int) -> Column:
    """A double rounded by its exact binary value, ties to even, as Python's and C's formats round; Java's do not.

    The value is split into halves of its bits, so that twice its multiple is compared with an odd number without an error.
    """
    scale = float(10**digits)
    low = F.floor(value * scale).cast("double")
    big = value * 134217729.0
    high = big - (big - value)
    over = (high * (2 * scale) - (2 * low + 1)) + (value - high) * (2 * scale)
    up = (over > 0) | ((over == 0) & (low % 2 == 1))
    return (low + F.when(up, 1.0).otherwise(0.0)) / scale


def percent_text(value: Column) -> Column:
    """62.5%, or a dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.concat(F.format_string("%.1f", _rounded(value, 1)), F.lit("%")))


def rate_text(value: Column) -> Column:
    """.342, 1.000, or - for null."""
    shown = F.format_string("%.3f", _rounded(value, 3))
    return F.when(value.isNull(), "-").when(shown.startswith("0."), F.substring(shown, 2, 10)).otherwise(shown)


def workload_text(pitches: Column, games: Column) -> Column:
    """85p (2g); ?p (1g) where pitches are unknown; a dash without games."""
    return F.when(F.coalesce(games, F.lit(0)) == 0, "—").otherwise(F.concat(F.coalesce(pitches.cast("string"), F.lit("?")), F.lit("p ("), games.cast("string"), F.lit("g)")))


def last_outing_text(days: Column) -> Column:
    """Today, 3d, or a dash for null."""
    return F.when(days.isNull(), "—").when(days == 0, "Today").otherwise(F.concat(days.cast("string"), F.lit("d")))
