"""Queries of the operators on text (problems 2 to 4 and 6 to 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkiln.llm import conversations, mixing, mojibake, newtext, pii, spans, split, tokens
from postkiln.plans.core_queries import message_instants
from postkiln.session import written
from postkiln.sources.tables import table

TEXT_FIELDS = ("text_body", "subject")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = mojibake.garbled_fields(table(spark, d, "messages", "row_id", *TEXT_FIELDS), "row_id", TEXT_FIELDS)
    return found.select("row_id", "field_name")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """The restored text of each garbled field, and whether nothing was lost."""
    return mojibake.garbled_fields(table(spark, d, "messages", "row_id", *TEXT_FIELDS), "row_id", TEXT_FIELDS)


def p3_new_text(spark: SparkSession, d: str) -> DataFrame:
    """The newly written text of every message that has a body, and the kinds of what was left out."""
    columns = ("conversation_id", "msg_id", "in_reply_to", "ingested_at", "sender_email", "text_body", "from_name")
    return newtext.with_new_text(message_instants(spark, d, *columns), table(spark, d, "messages", "row_id", "conversation_id", "text_body", "from_name"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_new_text(spark, d).select("row_id", F.explode("left_out").alias("part_kind"))


_CHAT = ("batch_no", "msg_id", "conversation_id", "in_reply_to", "sender_email", "from_email", "from_name", "text_body")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of every whole conversation with role, likeliest parent and the first turn of their link tree."""
    return conversations.linked_turns(message_instants(spark, d, *_CHAT), table(spark, d, "mailboxes"), table(spark, d, "messages", "row_id", "conversation_id", "text_body", "from_name"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The turns, of the rows that went through the links."""
    return p4_turns(spark, d).select("conversation_id", "turn_no", "msg_id")


def p4_trees(spark: SparkSession, d: str) -> DataFrame:
    """(conversation_id, tree_id, first_turn, n_turns, n_speakers) of each link tree."""
    return p4_turns(spark, d).groupBy("conversation_id", "tree_id").agg(F.min("turn_no").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"), F.count_distinct("speaker").alias("n_speakers"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    mails = table(spark, d, "messages", "row_id", "text_body").select(F.lit("message").alias("item_kind"), F.col("row_id").alias("item_key"), F.col("text_body").alias("content"))
    chunks = table(spark, d, "evidence_chunks", "chunk_id", "content").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "content")
    return split.oversized_pieces(mails.unionByName(chunks), table(spark, d, "split_limits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every item that is cut has a second piece, and only one."""
    return p6_pieces(spark, d).filter("piece_no = 2").select("item_kind", "item_key")


def p7_masked(spark: SparkSession, d: str) -> DataFrame:
    """Each field with personal information, with placeholders in its place."""
    words = pii.name_words(table(spark, d, "messages", "from_name"), "from_name")
    return pii.tagged_fields(table(spark, d, "messages", "row_id", *TEXT_FIELDS), words, "row_id", TEXT_FIELDS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_masked(spark, d).select("row_id", "field_name", F.explode("kinds").alias("pii_kind"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents", "doc_id", "text"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Copies of each document in the mix."""
    sized = table(spark, d, "documents", "doc_id", "source", "text").select("doc_id", "source", tokens.token_count(F.col("text")).alias("tokens"))
    return mixing.mixed(written(sized, "p9-sizes"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """For each document with a shared passage, its length and the characters inside such passages."""
    return spans.shared_spans(table(spark, d, "documents", "doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_shared(spark, d).select("doc_id")


QUERIES = {"p7_found": p7_found, "p7_masked": p7_masked, "p3_found": p3_found, "p3_new_text": p3_new_text, "p4_found": p4_found, "p4_turns": p4_turns, "p4_trees": p4_trees, "p10_found": p10_found, "p10_shared": p10_shared, "p2_found": p2_found, "p2_restored": p2_restored, "p6_found": p6_found, "p6_pieces": p6_pieces, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares}
SQL = {
    "p6_found": """SELECT 'message' AS item_kind, row_id AS item_key FROM messages WHERE length(text_body) > (SELECT max_chars FROM split_limits WHERE item_kind = 'message')
UNION ALL SELECT 'chunk', chunk_id FROM evidence_chunks WHERE length(content) > (SELECT max_chars FROM split_limits WHERE item_kind = 'chunk')""",
}
