"""Rates from counters. Numerators and denominators stay whole numbers; a zero or null denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero(c: str | Column) -> Column:
    """A counter, 0 where it is null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def per(n: Column, d: Column) -> Column:
    """n / d as a double; null where d is 0 or null."""
    return n.cast("double") / F.nullif(d, F.lit(0)).cast("double")


def avg() -> Column:
    return per(zero("h"), zero("ab"))


def plate_appearances() -> Column:
    return zero("ab") + zero("bb") + zero("hbp") + zero("shf")


def obp() -> Column:
    return per(zero("h") + zero("bb") + zero("hbp"), plate_appearances())


def slg() -> Column:
    return per(zero("h") + zero("doubles") + 2 * zero("triples") + 3 * zero("hr"), zero("ab"))


def extra_bases() -> Column:
    return zero("doubles") + zero("triples") + zero("hr")


def singles() -> Column:
    return zero("h") - extra_bases()


def percent(n: Column, d: Column) -> Column:
    return per(n * 100, d)


def era() -> Column:
    return per(zero("er") * 27, zero("ip_outs"))


def per_nine(c: str) -> Column:
    return per(zero(c) * 27, zero("ip_outs"))


def whip() -> Column:
    return per((zero("bb") + zero("h")) * 3, zero("ip_outs"))


def strike_percent() -> Column:
    return percent(zero("total_strikes"), zero("pitches"))


def innings(outs: Column) -> Column:
    """Outs as `W.T`: whole innings and thirds."""
    return F.concat(F.floor(outs / 3).cast("bigint").cast("string"), F.lit("."), (outs % 3).cast("string"))


def tolerance_percent(derived: Column, official: Column) -> Column:
    """By how many percent a derived count is off; 100 where the official one is 0 and the derived is not, 0 where both are."""
    off = F.abs(derived - official).cast("double") * 100 / F.nullif(official, F.lit(0)).cast("double")
    return F.when(official == 0, F.when(derived > 0, 100.0).otherwise(0.0)).otherwise(off)


def batting_composite() -> Column:
    """The batters' ordering score."""
    return 0.40 * F.coalesce(obp(), F.lit(0.0)) + 0.35 * F.coalesce(slg(), F.lit(0.0)) + 0.25 * F.coalesce(avg(), F.lit(0.0))
