"""Digests: extractive items from evidence, validation, sections, reports and their delivery in parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkiln.functions import text as tx

# Most items of each category of the extractive digest, and the order of sections.
LIMITS = {"my_actions": 5, "others_actions": 5, "deadlines": 5, "risks": 3, "fyi": 10}
SECTION_ORDER = {"Мои действия": 1, "Срочно": 2, "К сведению": 3}
QUOTE, PER_SECTION = 300, 10


def category(n_verbs: Column, n_dates: Column, addressed: Column, score: Column) -> Column:
    return F.when(n_verbs > 0, F.when(F.coalesce(addressed, F.lit(False)), "my_actions").otherwise("others_actions")).when(n_dates > 0, "deadlines").when(score >= 2.0, "risks").otherwise("fyi")


def extractive(chunks: DataFrame, group: str) -> DataFrame:
    """(group, category, place, evidence_id, title, quote, score): the best evidence of each category of each group.

    chunks has evidence_id, content, action_verbs, dates, addressed_to_me, score. The row_number limit keeps no more than the
    largest limit per group in any task.
    """
    kind = category(F.size("action_verbs"), F.size("dates"), F.col("addressed_to_me"), F.col("score"))
    most = F.expr("CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LIMITS.items()) + " END")
    title = F.expr("CASE category WHEN 'my_actions' THEN concat('Action: ', action_verbs[0]) WHEN 'others_actions' THEN concat('Action: ', action_verbs[0]) WHEN 'deadlines' THEN concat('Deadline: ', dates[0]) WHEN 'risks' THEN 'High priority item' ELSE 'FYI' END")
    quote = F.when(F.char_length("content") > QUOTE, F.concat(F.substring("content", 1, QUOTE), F.lit("..."))).otherwise(F.col("content"))
    w = Window.partitionBy(group, "category").orderBy(F.col("score").desc_nulls_last(), "evidence_id")
    placed = chunks.withColumn("category", kind).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max(LIMITS.values())).filter(F.col("place") <= most)
    return placed.select(group, "category", "place", "evidence_id", title.alias("title"), quote.alias("quote"), "score")


def valid_items(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Items with a title, a confidence from 0 to 1 and an evidence_id that exists."""
    sound = items.filter((F.coalesce(F.trim("title"), F.lit("")) != "") & F.col("confidence").between(0, 1))
    return sound.join(evidence.select("evidence_id").filter("evidence_id IS NOT NULL").distinct(), "evidence_id", "left_semi")


def unknown_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Items whose evidence_id is missing from the evidence, or null."""
    known = evidence.select("evidence_id").filter("evidence_id IS NOT NULL").distinct()
    return items.filter("evidence_id IS NOT NULL").join(known, "evidence_id", "left_anti").unionByName(items.filter("evidence_id IS NULL"))


def section_place(title: Column) -> Column:
    out = F.lit(99)
    for name, at in SECTION_ORDER.items():
        out = F.when(title == name, at).otherwise(out)
    return out


def markdown(items: DataFrame, group: str, section: str, place: str, title: str, note: str) -> DataFrame:
    """(group, section, report): the first PER_SECTION items of each section as a numbered list, in order."""
    line = F.format_string("%d. **%s** - %s", F.col(place), F.col(title), F.coalesce(F.col(note), F.lit("")))
    kept = items.filter(F.col(place) <= PER_SECTION)
    parts = kept.groupBy(group, section).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), line.alias("l")))).alias("_x"))
    return parts.select(group, section, F.concat(F.lit("## "), F.col(section), F.lit("\n"), F.array_join(F.transform("_x", lambda x: x["l"]), "\n")).alias("report"))


def as_json(items: DataFrame, group: str) -> DataFrame:
    """(group, digest): one JSON document per group; null fields are left out."""
    fields = [c for c in items.columns if c != group]
    return items.groupBy(group).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))).alias("digest"))


#: The written form of a digest.
DOCUMENT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("schema_version", "prompt_version", "digest_date", "trace_id")],
    T.StructField("sections", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("items", T.ArrayType(T.StructType([
        *[T.StructField(n, T.StringType()) for n in ("title", "due", "evidence_id")], T.StructField("confidence", T.DoubleType()), T.StructField("source_ref", T.MapType(T.StringType(), T.StringType())), T.StructField("email_subject", T.StringType()),
    ])))]))),
    T.StructField("total_emails_processed", T.LongType()), T.StructField("emails_with_actions", T.LongType()),
])


def schema_description() -> str:
    """The written form of a digest, as JSON."""
    return DOCUMENT.json()


def read_documents(documents: DataFrame, key: str, text: str) -> DataFrame:
    """documents with digest, the parsed document or null, and problem: the first reason for which it is not of the written form.

    The four head fields are not empty, the date is a day, sections and items have titles, items have evidence, a confidence
    from 0 to 1 and a source_ref with a type. Null texts do not parse.
    """
    d = F.from_json(F.col(text), DOCUMENT)
    out = documents.withColumn("digest", d)
    c = F.col("digest")
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    sections = F.coalesce(c["sections"], F.array().cast(DOCUMENT["sections"].dataType))
    bad_item = lambda i: blank(i["title"]) | blank(i["evidence_id"]) | ~F.coalesce(i["confidence"].between(0, 1), F.lit(False)) | ~F.coalesce(F.map_contains_key(i["source_ref"], F.lit("type")), F.lit(False))
    problem = (
        F.when(c.isNull() | (c["schema_version"].isNull() & c["sections"].isNull() & c["digest_date"].isNull()), "not a digest").when(blank(c["schema_version"]) | blank(c["prompt_version"]), "version missing").when(blank(c["digest_date"]) | blank(c["trace_id"]), "date or trace missing")
        .when(~c["digest_date"].rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_timestamp(c["digest_date"], F.lit("yyyy-MM-dd")).isNull(), "date form").when(c["sections"].isNull(), "sections missing")
        .when(F.exists(sections, lambda s: blank(s["title"]) | s["items"].isNull()), "section").when(F.exists(sections, lambda s: F.exists(F.coalesce(s["items"], F.array().cast(DOCUMENT["sections"].dataType.elementType["items"].dataType)), bad_item)), "item")
    )
    return out.withColumn("problem", problem)


def without_empty_sections(sections: Column) -> Column:
    """The sections of a digest that have items, in the fixed order of sections, then by title."""
    filled = F.filter(sections, lambda s: F.coalesce(F.size(s["items"]), F.lit(0)) > 0)
    place = lambda s: F.struct(section_place(s["title"]), F.coalesce(s["title"], F.lit("")))
    return F.array_sort(filled, lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0))


def message_parts(text: str, limit: int = 16383) -> list[str]:
    """A long report in parts of at most ``limit`` characters, each with its number: cut at blank lines, then lines, then anywhere."""
    if len(text) <= limit:
        return [text]
    room = limit - len("(99999/99999)\n")
    out: list[str] = []
    current = ""

    def put(piece: str, glue: str) -> None:
        nonlocal current
        joined = current + glue + piece if current else piece
        if len(joined) <= room:
            current = joined
            return
        if current:
            out.append(current)
            current = ""
        if len(piece) <= room:
            current = piece
        elif glue == "\n\n":
            for line in piece.split("\n"):
                put(line, "\n")
        else:
            out.extend(piece[i : i + room] for i in range(0, len(piece), room))

    for block in text.split("\n\n"):
        put(block, "\n\n")
    if current:
        out.append(current)
    return [f"({i}/{len(out)})\n{p}" for i, p in enumerate(out, 1)]


def parts_column(text: Column, limit: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: message_parts(t, limit) if isinstance(t, str) else None)

    return cut(text)


def delivered(reports: DataFrame, key: str, report: str, send: Callable[[str], object], limit: int = 16383) -> DataFrame:
    """(key, n_parts, status, error): each report sent in parts of at most ``limit`` characters, in order, by ``send`` in the tasks.

    A part that fails stops its report and is a warning with the error, not a failure of the job; null reports are skipped.
    """
    kind = reports.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in batch.itertuples(index=False, name=None):
                if not isinstance(text, str):
                    out.append((k, 0, "skipped", None))
                    continue
                parts, sent, error = message_parts(text, limit), 0, None
                try:
                    for part in parts:
                        send(part)
                        sent += 1
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                out.append((k, sent, "warning" if error else "sent", error))
            yield pd.DataFrame(out, columns=[key, "n_parts", "status", "error"])

    return reports.select(key, report).mapInPandas(run, f"{key} {kind}, n_parts int, status string, error string")


def confidence_number(label: Column) -> Column:
    """Words and spellings of confidence as a number: High 0.9, Medium 0.7, Low 0.4; numbers stay; null otherwise."""
    low = F.lower(F.trim(label))
    return F.when(low.isin("high", "высокая", "hoch", "alta"), 0.9).when(low.isin("medium", "средняя", "mittel", "média", "media", "med"), 0.7).when(low.isin("low", "низкая", "niedrig", "baixa"), 0.4).otherwise(low.try_cast("double"))


def summary_counts(items: DataFrame, section: str) -> DataFrame:
    return items.groupBy(section).agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("evidence_id").alias("n_evidence"), (F.sum(F.when(F.col("due_date").isNotNull(), 1).otherwise(0)) * 100 / F.count(F.lit(1))).cast("int").alias("percent_due"))


def word_limited(text: Column) -> Column:
    return tx.limit_words(text, 400, 390)
