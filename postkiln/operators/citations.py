"""Citations: where a chunk stands in the body it was cut from, and whether a given place still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIEW = 200


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Characters that patterns hold special.
_SPECIAL = r"([\\.\^\$\|\?\*\+\(\)\[\]\{\}])"


def loose_match(body: Column, content: Column) -> Column:
    """The stretch of the body that is the content but for white space; empty where there is none.

    The words of the content, taken literally, with any white space between them, are looked for in the body itself, so the
    stretch and its place are those of the body.
    """
    pattern = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(content, r"(?U)\s+", " ")), _SPECIAL, r"\\$1"), " ", r"\\s+")
    return F.call_function("regexp_substr", body, F.concat(F.lit("(?U)"), pattern))


def cited(chunks: DataFrame, messages: DataFrame, key: str, content: str, body: str) -> DataFrame:
    """chunks with start_at, end_at (code points from 0), exact, preview and checksum of the body; start_at is null where the body
    does not hold the content. A content that differs in white space only is found as the stretch of the body it stands for, is
    marked inexact and previewed as the body has it. Null and empty contents have no place."""
    bodies = messages.select(F.col(key).alias("_k"), F.col(body).alias("_body"), F.sha2(body, 256).alias("checksum"))
    joined = chunks.join(bodies, chunks[key] == F.col("_k"), "left")
    usable = F.char_length(F.trim(F.regexp_replace(F.col(content), r"(?U)\s+", " "))) > 0
    out = joined.withColumn("_at", F.when(usable, F.instr(F.col("_body"), F.col(content))))
    out = out.withColumn("_loose", F.when(usable & (F.col("_at") == 0), loose_match(F.col("_body"), F.col(content))))
    found = F.when(F.col("_at") > 0, F.col(content)).when(F.coalesce(F.char_length("_loose"), F.lit(0)) > 0, F.col("_loose"))
    out = out.withColumn("_found", found).withColumn("start_at", F.when(F.col("_found").isNotNull(), F.instr(F.col("_body"), F.col("_found")) - 1))
    out = out.withColumns({"exact": F.col("_at") > 0, "end_at": F.col("start_at") + F.char_length("_found"), "preview": F.substring("_found", 1, PREVIEW)})
    return out.drop("_k", "_body", "_at", "_loose", "_found")


def checked(citations: DataFrame, messages: DataFrame, key: str, body: str) -> DataFrame:
    """citations with problem: null where the place holds, else the first test that fails."""
    bodies = messages.select(F.col(key).alias("_k"), F.col(body).alias("_body"), F.sha2(body, 256).alias("_sum"))
    joined = citations.join(bodies, citations[key] == F.col("_k"), "left")
    part = F.substring(F.col("_body"), (F.col("start_at") + 1).cast("int"), (F.col("end_at") - F.col("start_at")).cast("int"))
    same = F.substring(part, 1, PREVIEW) == F.col("preview")
    problem = (
        F.when(F.col("_body").isNull(), "no body").when(F.coalesce(F.col("start_at") < 0, F.lit(True)), "bad start").when(F.coalesce(F.col("end_at") <= F.col("start_at"), F.lit(True)), "bad end")
        .when(F.col("end_at") > F.char_length("_body"), "beyond the body").when(~F.coalesce(same | (collapsed(F.substring(part, 1, PREVIEW)) == collapsed(F.col("preview"))), F.lit(False)), "other text")
        .when(F.col("checksum") != F.col("_sum"), "other body")
    )
    return joined.withColumn("problem", problem).drop("_k", "_body", "_sum")


def attached(items: DataFrame, citations: DataFrame, most: int = 5) -> DataFrame:
    """items with citations, an array of at most ``most`` places of their evidence in order (chunk_id), and citation_ok.

    citations: evidence_id, chunk_id, msg_id, start_at, end_at, preview, checksum, problem. An item is ok when it cites the system, or
    when its evidence has places and none of them has a problem; all places are looked at, the first ones are kept.
    """
    placed = citations.filter("start_at IS NOT NULL")
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("evidence_id").orderBy("chunk_id")))
    fields = ["msg_id", "start_at", "end_at", "preview", "checksum"]
    lists = ranked.filter(F.col("_r") <= most).groupBy("evidence_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.struct(*fields).alias("c")))), lambda x: x["c"]).alias("citations"))
    sound = placed.groupBy("evidence_id").agg(F.min(F.col("problem").isNull()).alias("_sound"))
    per = lists.join(sound, "evidence_id")
    out = items.join(per, "evidence_id", "left")
    ok = (F.col("evidence_id") == "system") | F.coalesce("_sound", F.lit(False))
    return out.withColumn("citation_ok", F.coalesce(ok, F.lit(False))).drop("_sound")


def digest_verdicts(items: DataFrame, digest: str, key: str) -> DataFrame:
    """(digest, ok, n_items, n_bad, first_bad): whether every item of a digest is ok, and the least key of those that are not.
    Strict readers stop at first_bad, lenient ones count n_bad."""
    bad = ~F.col("citation_ok")
    return items.groupBy(digest).agg(F.min("citation_ok").alias("ok"), F.count(F.lit(1)).alias("n_items"), F.sum(F.when(bad, 1).otherwise(0)).alias("n_bad"), F.min(F.when(bad, F.col(key))).alias("first_bad"))
