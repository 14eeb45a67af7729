"""Sources and sinks of messages: snapshots with their bad records, windows, watermarks, recorded replies and changelogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("msg_id", T.StringType()), T.StructField("conversation_id", T.StringType()), T.StructField("datetime_received", T.StringType()), T.StructField("sender_email", T.StringType()),
    T.StructField("from_email", T.StringType()), T.StructField("from_name", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("text_body", T.StringType()),
    T.StructField("to_recipients", T.ArrayType(T.StringType())), T.StructField("cc_recipients", T.ArrayType(T.StringType())), T.StructField("importance", T.StringType()),
    T.StructField("is_flagged", T.BooleanType()), T.StructField("has_attachments", T.BooleanType()), T.StructField("attachment_types", T.ArrayType(T.StringType())),
])


#: A record of a snapshot file as it is read: the fields of a message, those that older files have instead, and what did not parse.
RECORD = T.StructType([*MESSAGE.fields, *[T.StructField(n, T.StringType()) for n in ("sender", "body")], *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("to_emails", "cc_emails", "attachment_names")], T.StructField("_bad", T.StringType())])


def canonical(messages: DataFrame) -> DataFrame:
    """Defaults and aliases of message fields: cleaned ids, lower-case addresses, sender and text from the first field that has
    one, recipients from to_emails and cc_emails where their own field is empty, kinds of attachments from their names.

    Fields that the table lacks are not looked for; empty texts and lists count as missing.
    """
    from postkiln.operators.deliveries import cleaned_id

    have = set(messages.columns)
    first = lambda *c: F.coalesce(*[F.nullif(F.trim(F.col(x)), F.lit("")) for x in c if x in have])
    none = F.array().cast("array<string>")
    some = lambda *c: F.coalesce(*[F.when(F.size(F.col(x)) > 0, F.col(x)) for x in c if x in have], none)
    low = lambda *c: F.transform(some(*c), lambda x: F.lower(F.trim(x)))
    body = F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in ("text_body", "body") if x in have])
    types = low("attachment_types")
    if "attachment_names" in have:
        types = F.when(F.size(types) > 0, types).otherwise(attachment_types(some("attachment_names")))
    return messages.withColumns({
        "msg_id": cleaned_id("msg_id"), "sender_email": F.lower(first("sender_email", "sender", "from_email")), "from_email": F.lower(first("from_email", "sender_email")), "text_body": body,
        "to_recipients": low("to_recipients", "to_emails"), "cc_recipients": low("cc_recipients", "cc_emails"), "importance": F.coalesce(F.initcap(first("importance")), F.lit("Normal")),
        "is_flagged": F.coalesce("is_flagged", F.lit(False)), "has_attachments": F.coalesce("has_attachments", F.lit(False)), "attachment_types": F.array_distinct(types),
    })


def attachment_types(names: Column) -> Column:
    """Distinct lower-case endings of file names, in order of appearance."""
    return F.array_distinct(F.transform(F.filter(names, lambda n: n.contains(".")), lambda n: F.lower(F.substring_index(n, ".", -1))))


def write_snapshot(messages: DataFrame, path: str) -> None:
    """Messages as JSON lines, one per message, so that a snapshot of any size is written in parallel."""
    messages.write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """The messages of a snapshot: JSON lines, or one document that is a list of messages or has one under ``messages``."""
    return read_records(spark, path, one_document)[0].select(*MESSAGE.fieldNames())


def read_records(spark: SparkSession, path: str, one_document: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, bad): records with the fields of a message and their older names; bad has one row (source, record) for each line
    or document that does not parse, so that nothing is lost without a trace."""
    text = spark.read.text(path, wholetext=one_document).select(F.col("_metadata.file_path").alias("source"), "value").filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    fields = [n for n in RECORD.fieldNames() if n != "_bad"]
    if not one_document:
        parsed = text.withColumn("_r", F.from_json("value", RECORD, options))
        good = F.col("_r").isNotNull() & F.col("_r._bad").isNull() & F.trim("value").startswith("{")
        return parsed.filter(good).select(*[F.col(f"_r.{n}") for n in fields]), parsed.filter(~F.coalesce(good, F.lit(False))).select("source", F.col("value").alias("record"))
    plain = T.StructType([f for f in RECORD.fields if f.name != "_bad"])
    nested = F.from_json("value", T.StructType([T.StructField("messages", T.ArrayType(plain))]))["messages"]
    whole = text.withColumn("_m", F.when(F.ltrim("value").startswith("["), F.from_json("value", T.ArrayType(plain))).otherwise(nested))
    return whole.select(F.inline("_m")), whole.filter("_m IS NULL").select("source", F.col("value").alias("record"))


def ingested(spark: SparkSession, live: Callable[[], DataFrame] | None = None, replay: str | None = None, dump: str | None = None, one_document: bool = False) -> DataFrame:
    """The messages of a run: those of a snapshot where ``replay`` names one, else what ``live`` gives, in canonical form. With
    ``dump`` they are written as a snapshot, which is then read, so that the run and its replay see the same."""
    if replay is None and live is None:
        raise ValueError("give a snapshot to replay or a live source")
    messages = canonical(read_snapshot(spark, replay, one_document) if replay is not None else live())
    if dump is None:
        return messages
    write_snapshot(messages.select(*[c for c in MESSAGE.fieldNames() if c in messages.columns]), dump)
    return canonical(read_snapshot(spark, dump))


def snapshot_meta(messages: DataFrame, source: str, digest_date: str, fetched_at: str) -> DataFrame:
    """One row (meta): the JSON object that says where a snapshot comes from, for which day, when, and how many messages it holds."""
    n = messages.agg(F.count(F.lit(1)).alias("count"))
    return n.select(F.to_json(F.struct(F.lit(source).alias("source"), F.lit(digest_date).alias("digest_date"), F.lit(fetched_at).alias("fetch_timestamp"), "count")).alias("meta"))


def load_watermark(spark: SparkSession, path: str) -> str | None:
    """The watermark that was stored last, as text; None where there is none or it does not parse."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    row = spark.read.schema("watermark string").json(path).agg(F.max(F.col("watermark").try_cast("timestamp")).cast("string")).first()
    return row[0] if row else None


def store_watermark(mark: DataFrame, path: str) -> None:
    """Stores the one row (watermark) of ``after_watermark``; a null one keeps what is stored."""
    if not mark.filter("watermark IS NOT NULL").isEmpty():
        mark.select(F.col("watermark").cast("string").alias("watermark")).coalesce(1).write.mode("overwrite").json(path)


def recorded_replies(spark: SparkSession, path: str) -> DataFrame:
    """(call_no, reply) of a recording: replies in the order they were given."""
    reply = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("responses", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
    return spark.read.schema(reply).option("multiLine", True).json(path).select(F.posexplode("responses").alias("call_no", "reply"))


def time_window(day: Column, zone: Column | str, lookback_hours: int | None = None, now: Column | None = None) -> tuple[Column, Column]:
    """Bounds (UTC) of a calendar day in a zone, or of the last hours before ``now``."""
    if lookback_hours is not None and now is not None:
        return now - F.expr(f"INTERVAL {lookback_hours} HOURS"), now
    zone_c = F.lit(zone) if isinstance(zone, str) else zone
    start = F.to_utc_timestamp(day.cast("timestamp"), zone_c)
    end = F.to_utc_timestamp(F.date_add(day.cast("date"), 1).cast("timestamp"), zone_c)
    return start, end


def after_watermark(messages: DataFrame, at: str, watermark: str | None, lateness: str = "INTERVAL 48 HOURS") -> tuple[DataFrame, DataFrame]:
    """(messages newer than the watermark less the lateness allowed, one row with the next watermark: the latest time seen)."""
    fresh = messages if watermark is None else messages.filter(F.col(at) > F.lit(watermark).cast("timestamp") - F.expr(lateness))
    return fresh, fresh.agg(F.max(at).alias("watermark"))


def changelog(text: str) -> list[tuple[str, str, str]]:
    """(version, date, note) of lines "version - date - note"; the last is current."""
    import re

    return [m.groups() for m in re.finditer(r"^\s*[-*]?\s*(v?\d+(?:\.\d+)*)\s*[-–—|]\s*(\d{4}-\d{2}-\d{2})\s*[-–—|:]\s*(.+?)\s*$", text, re.M)]


def changelog_table(entries: list[tuple[str, str, str]]) -> str:
    """The versions of ``changelog`` as a table of Markdown, the current one first."""
    rows = [f"| {version} | {day} | {note} |" for version, day, note in reversed(entries)]
    return "\n".join(["| version | date | note |", "|-|-|-|", *rows])
