"""Where queries are registered by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.plans import standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

REFERENCE_DAY = "1997-06-15"


def day():
    return F.lit(REFERENCE_DAY).cast("date")


def query(name: str, oracle: str | None = None):
    """Registers a function of a table reader; dates come out as text, so both engines print them alike."""

    def add(make: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = make(lambda t: standins.table(spark, sf_dir, t))
            return out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "date"})

        QUERIES[name] = run
        if oracle is not None:
            SQL[name] = standins.sql(oracle)
        return make

    return add
