"""Messages delivered more than once: exactly one row of each mail is kept (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postkiln.operators.skew import HOT_KEYS, routed_join, salt


def cleaned_id(column: str | Column) -> Column:
    """An identifier without surrounding blanks, then without one pair of angle brackets, in lower case; null where nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    bare = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = F.when(bare.startswith("<") & bare.endswith(">") & (F.length(bare) >= 2), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return F.nullif(F.lower(bare), F.lit(""))


def _split(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of repeated ids, as (first of each id, all others). ``rows`` has _id and the order columns."""
    frequency = rows.filter("_id IS NOT NULL").groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = frequency.filter("_n > 1")
    grouped = routed_join(rows.filter("_id IS NOT NULL"), repeated, "_id", "_n").withColumn("_salt", salt("_n", *order))
    first = [F.col(c).asc_nulls_last() for c in order]
    local = grouped.withColumn("_rn", F.row_number().over(Window.partitionBy("_id", "_salt").orderBy(*first)))
    # at most one row per salt is left to rank for the whole id
    heads = local.filter("_rn = 1").withColumn("_rn", F.row_number().over(Window.partitionBy("_id").orderBy(*first)))
    drop = ["_n", "_salt", "_rn"]
    return heads.filter("_rn = 1").drop(*drop), local.filter("_rn > 1").unionByName(heads.filter("_rn > 1")).drop(*drop)


def surplus_deliveries(messages: DataFrame, id_column: str = "msg_id", order: tuple[str, ...] = ("batch_no", "row_id")) -> DataFrame:
    """The order columns of every row that is not the first delivery of its identifier.

    Identifiers are split by counted frequency: single ones never reach a sort, repeated ones are ranked, salted by their own
    size. Null and empty identifiers identify nothing, so their rows are never surplus; null order values come last; of wholly
    equal rows one counts as first. An empty table gives no rows. Only the identifier and the order columns are read.
    """
    rows = messages.select(cleaned_id(id_column).alias("_id"), *order)
    return _split(rows, list(order))[1].drop("_id")


def keep_first_delivery(messages: DataFrame, id_column: str = "msg_id", order: tuple[str, ...] = ("batch_no", "row_id")) -> DataFrame:
    """All columns of exactly one row of each mail: rows of single identifiers and rows without identifier pass directly,
    repeated identifiers give their first row in ``order``; both are put together again. Same cases as surplus_deliveries.
    """
    rows = messages.withColumn("_id", cleaned_id(id_column))
    named = rows.filter("_id IS NOT NULL")
    repeated = named.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # the heaviest identifiers leave by a broadcast of bounded size, so that none of them fills a task of the shuffled join
    heaviest = repeated.orderBy(F.desc("_n"), "_id").limit(HOT_KEYS).select("_id")
    singles = named.join(F.broadcast(heaviest), "_id", "left_anti").join(repeated.select("_id"), "_id", "left_anti")
    return rows.filter("_id IS NULL").unionByName(singles).unionByName(_split(rows, list(order))[0]).drop("_id")


def newly_arrived(stored: DataFrame, batch: DataFrame, id_column: str = "msg_id", order: tuple[str, ...] = ("batch_no", "row_id")) -> DataFrame:
    """The rows of a new batch to append to a store that already holds one row of each mail: first deliveries within the batch
    whose identifier the store does not hold."""
    fresh = keep_first_delivery(batch, id_column, order).withColumn("_id", cleaned_id(id_column))
    held = stored.select(cleaned_id(id_column).alias("_id")).filter("_id IS NOT NULL").distinct()
    return fresh.join(held, "_id", "left_anti").drop("_id")
