"""Queries of the core operators for training data: times (problem 1) and repeated deliveries (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkiln.operators.deliveries import keep_first_delivery, surplus_deliveries
from postkiln.operators.instants import nonstandard_instants, normalise_instants
from postkiln.sources.tables import table


def message_instants(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Messages (the named columns) with utc_us, the instant of datetime_received."""
    rows = table(spark, d, "messages", *dict.fromkeys([*columns, "row_id", "mailbox_id", "datetime_received"]))
    return normalise_instants(rows, "datetime_received", table(spark, d, "mailboxes"), "mailbox_id", "mailbox_tz")


def due_instants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "action_items", "item_id", "mailbox_id", "digest_date", "due_date")
    return normalise_instants(rows, "due_date", table(spark, d, "mailboxes"), "mailbox_id", "user_timezone", base_date="digest_date")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    mails = nonstandard_instants(message_instants(spark, d), "row_id", "datetime_received", "messages")
    return mails.unionByName(nonstandard_instants(due_instants(spark, d), "item_id", "due_date", "action_items"))


def p1_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every row of both tables with its instant, or null."""
    mails = message_instants(spark, d).select(F.lit("messages").alias("source_table"), F.col("row_id").alias("row_key"), "utc_us")
    return mails.unionByName(due_instants(spark, d).select(F.lit("action_items").alias("source_table"), F.col("item_id").alias("row_key"), "utc_us"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return surplus_deliveries(table(spark, d, "messages", "msg_id", "batch_no", "row_id")).select("row_id")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """Row, batch and subject of the one delivery of each mail that is kept."""
    return keep_first_delivery(table(spark, d, "messages", "msg_id", "batch_no", "row_id", "conversation_id", "subject"))


_ID = r"""nullif(lower(CASE WHEN length(b) >= 2 AND starts_with(b, '<') AND ends_with(b, '>') THEN substr(b, 2, length(b) - 2) ELSE b END), '')"""
_RANKED = rf"""SELECT *, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY id ORDER BY batch_no, row_id) END AS rn FROM (
  SELECT *, {_ID} AS id FROM (SELECT *, regexp_replace(regexp_replace(msg_id, '^[\s\x{{a0}}]+', ''), '[\s\x{{a0}}]+$', '') AS b FROM messages))"""

QUERIES = {"p1_found": p1_found, "p1_instants": p1_instants, "p5_found": p5_found, "p5_kept": p5_kept}
SQL = {
    "p5_found": f"SELECT row_id FROM ({_RANKED}) WHERE rn > 1",
    "p5_kept": f"SELECT msg_id, batch_no, row_id, conversation_id, subject FROM ({_RANKED}) WHERE rn = 1",
}
