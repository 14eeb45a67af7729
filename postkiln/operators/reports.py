"""Reports: digests as Markdown of one or five kinds of sections, texts for chat, summaries, and reports of grading.

Every report is built from lines that carry their place, which are put together once per digest. Sections are cut to their first
items before that, so the lines of a digest are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postkiln.functions import text as tx

# Wording of the reports.
NOTHING = "За период релевантных действий не найдено."
SECTIONS = {"my_actions": "Мои действия", "others_actions": "Действия других", "deadlines_meetings": "Дедлайны и встречи", "risks_blockers": "Риски и блокеры", "fyi": "К сведению (FYI)"}
CONFIDENCE_RU = ((0.9, "Очень высокая"), (0.7, "Высокая"), (0.5, "Средняя"), (0.3, "Низкая"))
LOWEST_RU = "Очень низкая"
PARTIAL = {
    "llm_json_error": ("⚠️ **ЧАСТИЧНЫЙ ОТЧЁТ: LLM дал невалидный JSON**", "Данный дайджест создан в резервном режиме (extractive fallback) из-за ошибки парсинга JSON от LLM."),
    "llm_processing_failed": ("⚠️ **ЧАСТИЧНЫЙ ОТЧЁТ: Ошибка обработки LLM**", "Данный дайджест создан в резервном режиме (extractive fallback) из-за сбоя LLM."),
    "": ("⚠️ **ЧАСТИЧНЫЙ ОТЧЁТ**", "Данный дайджест создан в резервном режиме (extractive fallback)."),
}
PARTIAL_END = "Информация может быть неполной или менее точной, чем обычно."
BULLETED = ("К сведению", "Статус")
CUT_NOTE = "*[Содержимое обрезано для соблюдения лимита слов]*"
ICONS = {"error": "✗", "warn": "⚠", "info": "ℹ"}
PER_SECTION, MAX_WORDS = 10, 400


def confidence_ru(c: Column) -> Column:
    out = F.lit(LOWEST_RU)
    for least, name in reversed(CONFIDENCE_RU):
        out = F.when(c >= least, name).otherwise(out)
    return out


def evidence_reference(source_type: Column, evidence_id: Column, subject: Column | None = None) -> Column:
    """Where an item comes from, in the form that ``is_valid_markdown`` looks for."""
    head = F.concat(F.lit("**Источник:** "), F.coalesce(source_type, F.lit("unknown")))
    topic = F.when(F.coalesce(subject, F.lit("")) != "", F.concat(F.lit(', тема "'), subject, F.lit('"'))).otherwise("") if subject is not None else F.lit("")
    return F.concat(head, topic, F.lit(", evidence "), F.coalesce(evidence_id, F.lit("")))


def joined_lines(lines: DataFrame, key: str, place: list[str], line: str = "line", name: str = "report") -> DataFrame:
    """(key, report): the lines of each key in the order of place."""
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*place, F.col(line).alias("_l")))), lambda x: x["_l"]), "\n").alias(name))


def limited_words(report: Column, most: int = MAX_WORDS) -> Column:
    """The report, or its first words on one line and a note where it has more than ``most``."""
    w = tx.words(report)
    return F.when(F.size(w) <= most, report).otherwise(F.concat(F.array_join(F.slice(w, 1, most - 10), " "), F.lit("\n\n" + CUT_NOTE)))


def plain_markdown(digests: DataFrame, items: DataFrame, key: str, max_words: int | None = MAX_WORDS) -> DataFrame:
    """(key, report) of every digest (key, digest_date, trace_id, total_emails, emails_with_actions).

    items: key, section_place, section, place (from 1), title, due, confidence (number), source_type, evidence_id, subject. The first
    PER_SECTION items of a section are shown and the others counted; all evidence is listed once, in order.
    """
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    heads = digests.join(counts, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    line = lambda df, order, text: df.select(key, *[F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.cast("int").alias(n) for n, x in zip(("a", "b", "c"), order)], F.coalesce("_tie", F.lit("")).alias("d"), text.alias("line"))
    plain = lambda df: df.withColumn("_tie", F.lit(""))
    head = F.concat(F.lit("# Дайджест действий - "), F.coalesce("digest_date", F.lit("")), F.lit("\n\n*Trace ID: "), F.coalesce("trace_id", F.lit("")), F.lit("*\n"))
    parts = line(plain(heads), (0, 0, 0), F.concat(head, F.when(F.col("_n") == 0, F.lit("\n" + NOTHING)).otherwise("")))
    sections = items.groupBy(key, "section_place", "section").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.unionByName(line(sections.withColumn("_tie", F.lit("")), (1, F.col("section_place"), 0), F.concat(F.lit("## "), F.col("section"), F.lit("\n"))))
    shown = items.filter(F.col("place") <= PER_SECTION)
    due = F.when(F.coalesce("due", F.lit("")) != "", F.concat(F.lit("\n**Срок:** "), F.col("due"))).otherwise("")
    body = F.concat(F.lit("### "), F.col("place").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), due, F.lit("\n**Уверенность:** "), confidence_ru(F.coalesce(F.col("confidence"), F.lit(0.0))), F.lit("\n"), evidence_reference(F.col("source_type"), F.col("evidence_id"), F.col("subject")), F.lit("\n"))
    parts = parts.unionByName(line(plain(shown), (1, F.col("section_place"), F.col("place")), body))
    more = sections.filter(F.col("_n") > PER_SECTION)
    parts = parts.unionByName(line(plain(more), (1, F.col("section_place"), PER_SECTION + 1), F.concat(F.lit("*... и еще "), (F.col("_n") - PER_SECTION).cast("string"), F.lit(" элементов*\n"))))
    full = heads.filter("_n > 0")
    percent = F.floor(F.col("emails_with_actions") * 100 / F.col("total_emails")).cast("string")
    stats = F.concat(F.lit("## Статистика\n\nОбработано "), F.col("total_emails").cast("string"), F.lit(" писем, "), F.col("emails_with_actions").cast("string"), F.lit(" ("), percent, F.lit("%) содержали действия\n"))
    parts = parts.unionByName(line(plain(full.filter("total_emails > 0")), (2, 0, 0), stats)).unionByName(line(plain(full), (3, 0, 0), F.lit("## Источники\n")))
    sources = items.select(key, F.coalesce("evidence_id", F.lit("")).alias("_tie")).distinct()
    parts = parts.unionByName(line(sources, (4, 0, 0), F.concat(F.lit("### Evidence "), F.col("_tie"), F.lit("\n*ID: "), F.col("_tie"), F.lit("*\n"))))
    out = joined_lines(parts, key, ["a", "b", "c", "d"])
    return out if max_words is None else out.withColumn("report", limited_words(F.col("report"), max_words))


def typed_block(c: dict[str, Column]) -> Column:
    """The lines of one item of a typed section; lines of fields that it lacks are left out. Fields: section, place, title,
    description, due_date, due_date_label, due_date_normalized, confidence, owners, response_channel, date_time, date_label, location,
    participants, severity, impact, category, subject, evidence_id, quote."""
    some = lambda name: F.coalesce(c[name], F.lit("")) != ""
    row = lambda label, value, when: F.when(when, F.concat(F.lit(f"**{label}:** "), F.coalesce(value, F.lit(""))))
    actions, mine = c["section"].isin("my_actions", "others_actions"), c["section"] == "my_actions"
    deadline, risk, fyi = c["section"] == "deadlines_meetings", c["section"] == "risks_blockers", c["section"] == "fyi"
    label = lambda name: F.when(some(name), F.concat(F.lit(" ("), c[name], F.lit(")"))).otherwise("")
    source = F.when(some("subject"), F.concat(F.lit('тема "'), c["subject"], F.lit('", evidence '), F.coalesce(c["evidence_id"], F.lit("")))).otherwise(F.concat(F.lit("Evidence "), F.coalesce(c["evidence_id"], F.lit(""))))
    owners = F.array_join(c["owners"], ", ")
    lines = F.array(
        F.concat(F.lit("### "), c["place"].cast("string"), F.lit(". "), F.coalesce(c["title"], F.lit(""))), row("Описание", c["description"], actions), row("Срок", F.concat(c["due_date"], label("due_date_label")), actions & some("due_date")),
        row("Дата (ISO)", c["due_date_normalized"], mine & some("due_date_normalized")), row("Уверенность", c["confidence"], actions), row("Дата/время", F.concat(F.coalesce(c["date_time"], F.lit("")), label("date_label")), deadline),
        row("Место", c["location"], deadline & some("location")), row("Участники", F.array_join(c["participants"], ", "), deadline & (F.size(c["participants"]) > 0)), row("Серьёзность", c["severity"], risk), row("Влияние", c["impact"], risk),
        row("Ответственные", owners, (actions | risk) & (F.size(c["owners"]) > 0)), row("Канал ответа", c["response_channel"], mine & some("response_channel")), row("Категория", c["category"], fyi & some("category")),
        F.concat(F.lit("**Источник:** "), source), F.concat(F.lit('**Цитата:** "'), F.coalesce(c["quote"], F.lit("")), F.lit('"')), F.lit(""),
    )
    return F.array_join(F.array_compact(lines), "\n")


def typed_markdown(digests: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, report) of every digest (key, digest_date, trace_id, timezone, schema_version, partial: null or a reason).

    blocks: key, section (a key of SECTIONS), place, block (of ``typed_block``). Sections stand in the order of SECTIONS.
    """
    counts = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    heads = digests.join(counts, key, "left")
    banner = F.lit("")
    for reason, (first, second) in reversed(PARTIAL.items()):
        text = F.lit(f"---\n{first}\n\n{second}\n{PARTIAL_END}\n---\n\n")
        banner = F.when(F.col("partial") == reason, text).otherwise(banner) if reason else F.when(F.col("partial").isNotNull(), text).otherwise("")
    head = F.concat(F.lit("# Дайджест действий - "), F.coalesce("digest_date", F.lit("")), F.lit("\n*Trace ID: "), F.coalesce("trace_id", F.lit("")), F.lit("*\n*Timezone: "), F.coalesce("timezone", F.lit("")), F.lit("*\n*Schema version: "), F.coalesce("schema_version", F.lit("")), F.lit("*\n\n"), banner)
    order = F.coalesce(*[F.when(F.col("section") == s, n) for n, s in enumerate(SECTIONS, 1)])
    title = F.coalesce(*[F.when(F.col("section") == s, F.lit(f"## {t}\n")) for s, t in SECTIONS.items()])
    parts = heads.select(key, F.lit(0).alias("a"), F.lit(0).alias("b"), F.rtrim(F.concat(head, F.when(F.col("_n").isNull(), NOTHING).otherwise("")), F.lit("\n")).alias("line"))
    parts = parts.unionByName(heads.filter("_n IS NOT NULL").select(key, F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit("").alias("line")))
    parts = parts.unionByName(blocks.select(key, "section").distinct().select(key, order.alias("a"), F.lit(0).alias("b"), title.alias("line")))
    parts = parts.unionByName(blocks.select(key, order.alias("a"), F.col("place").cast("int").alias("b"), F.col("block").alias("line")))
    return joined_lines(parts, key, ["a", "b"])


def chat_text(digests: DataFrame, items: DataFrame, key: str, footer: bool = True) -> DataFrame:
    """(key, report): a digest as a text for a chat, one block per section, and a footer with the trace and the count of items.

    items as in ``plain_markdown``. Items of sections for information have bullets instead of numbers.
    """
    bullet = F.when(F.col("section").isin(*BULLETED), "-").otherwise(F.concat(F.col("place").cast("string"), F.lit(".")))
    due = F.when(F.coalesce("due", F.lit("")) != "", F.concat(F.lit(" | срок: "), F.col("due"))).otherwise("")
    line = F.concat(bullet, F.lit(" "), F.coalesce("title", F.lit("")), due, F.lit(" | уверенность: "), F.lower(confidence_ru(F.coalesce(F.col("confidence"), F.lit(0.0)))))
    rows = items.select(key, F.lit(1).alias("a"), F.col("section_place").cast("int").alias("b"), F.col("place").cast("int").alias("c"), line.alias("line"))
    titles = items.select(key, "section_place", "section").distinct().select(key, F.lit(1).alias("a"), F.col("section_place").cast("int").alias("b"), F.lit(0).alias("c"), F.concat(F.lit("\n**"), F.col("section"), F.lit("**")).alias("line"))
    heads = digests.select(key, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.concat(F.lit("## Дайджест действий — "), F.coalesce("digest_date", F.lit(""))).alias("line"))
    parts = heads.unionByName(titles).unionByName(rows)
    if footer:
        counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        ends = digests.join(counts, key, "left").select(key, F.lit(2).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.concat(F.lit("\n_trace: "), F.coalesce("trace_id", F.lit("")), F.lit(" | items: "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit("_")).alias("line"))
        parts = parts.unionByName(ends)
    return joined_lines(parts, key, ["a", "b", "c"])


def summary_text(digests: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, summary): how many items a digest has, in all and by section."""
    per = items.groupBy(key, "section_place", "section").agg(F.count(F.lit(1)).alias("_n"))
    lists = per.groupBy(key).agg(F.sum("_n").alias("_all"), F.sort_array(F.collect_list(F.struct(F.col("section_place"), F.concat(F.lit("- "), F.col("section"), F.lit(": "), F.col("_n").cast("string")).alias("l")))).alias("_x"))
    text = F.concat(F.lit("Найдено "), F.col("_all").cast("string"), F.lit(" действий: "), F.array_join(F.transform("_x", lambda x: x["l"]), " "))
    return digests.select(key).join(lists, key, "left").select(key, F.coalesce(text, F.lit(NOTHING)).alias("summary"))


def is_valid_markdown(report: Column) -> Column:
    """A title, a section and a reference to evidence, each at the head or in a line of its own."""
    return F.coalesce(report.rlike(r"(?m)^# ") & report.rlike(r"(?m)^## ") & report.rlike(r"(?m)^.*(?:Источник:.*evidence|evidence.*Источник:).*$"), F.lit(False))


def evidence_ids(items: DataFrame, key: str) -> DataFrame:
    """(key, place, evidence_id): the evidence of each digest, each once, in order."""
    distinct = items.filter("evidence_id IS NOT NULL").select(key, "evidence_id").distinct()
    return distinct.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("evidence_id")))


def grade_report(graded: DataFrame, issues: DataFrame, digest: str, prompt_version: str, checked: bool) -> DataFrame:
    """(digest, report): the grading of each digest as text. graded as of ``evaluation.graded``; issues have severity, check and key."""
    percent = F.concat(F.round(F.try_divide(F.col("clean_items"), F.col("n_items")) * 100).cast("int").cast("string"), F.lit("%"))
    head = F.concat(
        F.lit("## Prompt Eval — "), F.col(digest), F.lit(f"\nPrompt version: `{prompt_version}`\nScore: **"), F.col("score").cast("string"), F.lit("/100** (grade "), F.col("grade"), F.lit(") | Items: "), F.col("n_items").cast("string"),
        F.lit(" | Clean items: "), percent, F.lit(" | Errors: "), F.col("errors").cast("string"), F.lit(" | Warnings: "), F.col("warnings").cast("string"), F.lit("\nEvidence IDs: validated against ingest snapshot ✓" if checked else ""), F.lit("\n\n### Issues"),
    )
    icon = F.coalesce(*[F.when(F.col("severity") == s, i) for s, i in ICONS.items()], F.lit("-"))
    lines = graded.select(digest, F.lit(0).alias("a"), F.lit("").alias("b"), head.alias("line"))
    lines = lines.unionByName(graded.filter("errors + warnings = 0").select(digest, F.lit(1).alias("a"), F.lit("").alias("b"), F.lit("✓ No issues found.").alias("line")))
    said = F.concat(icon, F.lit(" "), F.col("check"), F.lit(": "), F.col("n").cast("string"))
    # issues of a kind are counted, so that a digest of any size has a report of a few lines
    lines = lines.unionByName(issues.groupBy(digest, "severity", "check").agg(F.count(F.lit(1)).alias("n")).select(digest, F.lit(2).alias("a"), F.concat("severity", F.lit("|"), "check").alias("b"), said.alias("line")))
    return joined_lines(lines, digest, ["a", "b"])


def grade_document(graded: DataFrame, digest: str, prompt_version: str) -> DataFrame:
    """(digest, document): the figures of the grading as one JSON object."""
    rate = F.round(F.try_divide(F.col("clean_items"), F.col("n_items")), 3).alias("quality_rate")
    return graded.select(digest, F.to_json(F.struct(F.lit(prompt_version).alias("prompt_version"), F.col(digest).alias("digest_date"), "score", "grade", F.col("n_items").alias("total_items"), rate, "errors", "warnings")).alias("document"))
