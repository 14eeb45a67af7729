"""Normalising time texts of tables to one UTC instant (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postkiln.functions.instants import with_instant

#: The form YYYY-MM-DDTHH:MM:SS.ffffff+00:00.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}\+00:00$"


def normalise_instants(rows: DataFrame, text: str, zones: DataFrame, key: str, zone: str, locale: str = "locale", base_date: str | None = None, ambiguous: str = "null", nonexistent: str = "null", name: str = "utc_us") -> DataFrame:
    """All rows, with ``name`` (bigint microseconds, UTC, null where the text names no single instant).

    The default zone and the locale are looked up in ``zones`` by ``key`` (unique there; Spark broadcasts it only while it is
    small). Rows whose key is null or unknown keep their instants with offsets; their wall-clock times are null. Columns of
    ``zones`` do not enter the result, so clashing names do no harm. Null and empty texts give null, and texts of
    any length that no anchored pattern matches; an empty table
    gives no rows; repeated rows stay repeated.
    """
    side = zones.select(F.col(key).alias("_zone_key"), F.col(zone).alias("_zone"), F.col(locale).alias("_locale"))
    joined = rows.join(side, rows[key] == F.col("_zone_key"), "left")
    timed = with_instant(joined, F.col(text), F.col("_zone"), F.col("_locale"), F.col(base_date) if base_date else None, name, ambiguous, nonexistent)
    return timed.drop("_zone_key", "_zone", "_locale")


def nonstandard_instants(rows: DataFrame, key: str, text: str, source_table: str) -> DataFrame:
    """(source_table, row_key, utc_us) of each readable text that is not yet in the canonical form."""
    return rows.filter(F.col("utc_us").isNotNull() & ~F.col(text).rlike(CANONICAL)).select(F.lit(source_table).alias("source_table"), F.col(key).cast("bigint").alias("row_key"), "utc_us")
