"""Queries of prompts, replies, reports and runs over the digest tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkiln.operators import citations, digest, evaluation, hierarchy, ranking, replies, reports
from postkiln.plans.digest_queries import _BODY, _CONF, _FIRST_CHUNK, _FLAGS, _ISSUES, _bodies, _chunks, _issues, _items, _scored
from postkiln.sources import runs
from postkiln.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# prompts and calls

_SHOWN = "CASE WHEN coalesce(len({c}), 0) = 0 THEN 'none' ELSE array_to_string({c}[1:{n}], ', ') || CASE WHEN len({c}) > {n} THEN ' (+' || (len({c}) - {n}) || ')' ELSE '' END END"
_SUBJECT = "coalesce(message_metadata.subject, 'N/A')"


@query(f"""SELECT chunk_id, 'Evidence 1 (ID: ' || evidence_id || ', Msg: ' || coalesce(msg_id, 'N/A') || ', Thread: ' || coalesce(conversation_id, 'N/A') || ')' || chr(10) || 'From: ' || coalesce(message_metadata.sender, 'N/A') || ' | To: N/A | Cc: N/A' || chr(10)
|| 'Subject: ' || CASE WHEN length({_SUBJECT}) > 80 THEN substr({_SUBJECT}, 1, 80) || '...' ELSE {_SUBJECT} END || chr(10) || 'ReceivedAt: ' || coalesce(message_metadata.received_at, 'N/A') || ' | Importance: ' || coalesce(message_metadata.importance, 'Normal')
|| ' | Flag: ' || CASE WHEN message_metadata.is_flagged THEN 'True' ELSE 'False' END || ' | HasAttachments: none' || chr(10) || 'AddressedToMe: ' || CASE WHEN addressed_to_me THEN 'True' ELSE 'False' END || ' (aliases: ' || CASE WHEN coalesce(len(user_aliases_matched), 0) > 0 THEN array_to_string(user_aliases_matched, ', ') ELSE 'none' END || ')' || chr(10)
|| 'Signals: action_verbs=[' || {_SHOWN.format(c='signals.action_verbs', n=5)} || ']; dates=[' || {_SHOWN.format(c='signals.dates', n=3)} || ']; contains_question=' || CASE WHEN signals.contains_question THEN 'True' ELSE 'False' END || '; sender_rank=' || coalesce(signals.sender_rank, 1) || '; attachments=[none]' || chr(10) || '---' || chr(10) || content || chr(10) || chr(10) AS block
FROM {_FIRST_CHUNK} WHERE rn = 1""")
def evidence_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The text of each piece of evidence as a prompt shows it."""
    rows = _chunks(spark, d)
    m, s, none = F.col("message_metadata"), F.col("signals"), F.array().cast("array<string>")
    c = {"evidence_id": F.col("evidence_id"), "msg_id": F.col("msg_id"), "conversation_id": F.col("conversation_id"), "sender": m["sender"], "to": none, "cc": none, "subject": m["subject"], "received_at": m["received_at"], "importance": m["importance"], "is_flagged": m["is_flagged"], "attachment_types": none, "addressed_to_me": F.col("addressed_to_me"), "aliases": F.col("user_aliases_matched"), "action_verbs": s["action_verbs"], "dates": s["dates"], "contains_question": s["contains_question"], "sender_rank": s["sender_rank"], "content": F.col("content")}
    return rows.select("chunk_id", replies.evidence_block(F.lit(1), c).alias("block"))


_CALLS = "(SELECT item_id, mailbox_id, coalesce(length(title), 0) AS tin, coalesce(length(description), 0) AS tout FROM action_items)"


@query(f"""SELECT item_id, CAST(s AS BIGINT) AS run_tokens_used, s <= 3000 AS within FROM (SELECT *, sum(tin + tout) OVER (PARTITION BY mailbox_id ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS s FROM {_CALLS}) WHERE s - tin - tout <= 3000""")
def call_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Calls of a run until its budget of tokens is used up; here an item stands for a call and characters for tokens."""
    calls = table(spark, d, "action_items", "item_id", "mailbox_id", "title", "description").withColumns({"tin": F.char_length("title"), "tout": F.char_length("description")})
    return replies.within_run_budget(calls, "mailbox_id", "item_id", "tin", "tout", 3000).select("item_id", F.col("run_tokens_used").cast("bigint").alias("run_tokens_used"), "within")


@query("SELECT event_id, max(w - n * 4.0) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 4.0 AS starts_s FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS DOUBLE) AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)")
def call_starts(spark: SparkSession, d: str) -> DataFrame:
    """Earliest starts of calls, four seconds apart; here an event of a user stands for a call."""
    calls = table(spark, d, "events", "event_id", "user_id", "ts").withColumn("wanted", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return replies.spaced_starts(calls, "user_id", "event_id", "wanted").select("event_id", "starts_s")


@query(f"""SELECT c.conversation_id FROM (SELECT conversation_id, max(priority_score) AS best, count(a.item_id) AS n FROM ({_FLAGS}) f LEFT JOIN action_items a ON a.evidence_id = f.evidence_id WHERE conversation_id IS NOT NULL GROUP BY 1) c WHERE n = 0 AND best >= 1.5""")
def quality_retries(spark: SparkSession, d: str) -> DataFrame:
    """Conversations without a single item although their evidence is promising."""
    rows = _scored(spark, d).filter("conversation_id IS NOT NULL").select("conversation_id", "evidence_id", "priority_score")
    items = table(spark, d, "action_items", "item_id", "evidence_id")
    made = rows.join(items, "evidence_id", "left").groupBy("conversation_id").agg(F.count("item_id").alias("n_sections")).withColumn("n_calls", F.lit(1))
    return replies.quality_retries(made, rows, "conversation_id", "priority_score").select("conversation_id")


# replies


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """A reply for each written item, with fences, text after it and a trailing comma, as models give them."""
    i = table(spark, d, "action_items", "item_id", "title", "due_date", "evidence_id", "confidence", "email_subject", "actors")
    number = F.col("confidence").try_cast("double")
    confidence = F.when(F.col("confidence").isNull(), F.lit("")).when(number.isNotNull(), F.concat(F.lit(',"confidence":'), number.cast("string"))).otherwise(F.concat(F.lit(',"confidence":'), F.to_json(F.struct(F.col("confidence").alias("c"))).substr(F.lit(6), F.lit(10_000))))
    confidence = F.regexp_replace(confidence, r"\}$", "")
    source = F.when(F.coalesce(F.size("actors"), F.lit(0)) > 0, F.lit(',"source_ref":{"type":"email"}')).otherwise(F.lit(',"source_ref":{"kind":"email"}'))
    fields = F.regexp_replace(F.to_json(F.struct("title", F.col("due_date").alias("due"), "evidence_id", "email_subject")), r"^\{|\}$", "")
    item = F.concat(F.lit("{"), F.when(fields == "", F.lit('"x":1')).otherwise(fields), confidence, source, F.lit("}"))
    return i.select("item_id", F.concat(F.lit('```json\n{"sections":[{"title":"Actions","items":['), item, F.lit(',]},{"items":[]}],}\nThat is all.\n```')).alias("reply"))


_KNOWN = f"(SELECT DISTINCT evidence_id FROM ({_FLAGS}))"
_CHECKED = f"""SELECT item_id, CASE WHEN title IS NULL OR a.evidence_id IS NULL OR confidence IS NULL THEN 'field missing' WHEN k.evidence_id IS NULL THEN 'evidence unknown' WHEN NOT coalesce(try_cast(confidence AS DOUBLE) BETWEEN 0 AND 1, false) THEN 'confidence' WHEN coalesce(len(actors), 0) = 0 THEN 'source_ref' END AS problem FROM action_items a LEFT JOIN {_KNOWN} k ON a.evidence_id = k.evidence_id"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return replies.checked_items(replies.sections_of(_replies(spark, d), "reply", ["item_id"]), _chunks(spark, d))


@query(_CHECKED)
def reply_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of the replies, each with the first thing that is wrong with it."""
    return _checked(spark, d).select("item_id", "problem")


@query(f"SELECT item_id, 1 AS n_items, CASE WHEN problem IS NULL THEN 1 ELSE 0 END AS n_valid, CASE WHEN problem IS NULL THEN 0 ELSE 1 END AS validation_errors FROM ({_CHECKED})")
def reply_summaries(spark: SparkSession, d: str) -> DataFrame:
    return replies.reply_summary(_replies(spark, d), _checked(spark, d), ["item_id"])


_TYPED = """CASE WHEN coalesce(title, '') = '' THEN 'title missing' WHEN description IS NULL THEN 'description missing' WHEN coalesce(evidence_id, '') = '' THEN 'evidence_id missing' WHEN quote IS NULL THEN 'quote missing' WHEN confidence IS NULL THEN 'confidence missing' WHEN length(quote) < 10 THEN 'quote short' WHEN confidence NOT IN ('High', 'Medium', 'Low') THEN 'confidence unknown' END"""


@query(f"SELECT item_id, {_TYPED} AS problem FROM action_items")
def typed_items(spark: SparkSession, d: str) -> DataFrame:
    """Written items held against the schema of the typed reply."""
    rows = table(spark, d, "action_items", "item_id", "title", "description", "evidence_id", "quote", "confidence")
    item = F.struct("title", "description", "evidence_id", "quote", "confidence")
    return rows.select("item_id", replies.typed_problem("my_actions", item).alias("problem"))


@query("""SELECT item_id, CASE WHEN confidence IS NOT NULL AND confidence NOT IN ('v1', '1.0') THEN 'version' WHEN quote IS NULL OR length(quote) > 4000 THEN 'evidence' WHEN title IS NULL OR description IS NULL THEN 'summary' END AS strict_problem, CASE WHEN confidence IS NOT NULL AND confidence NOT IN ('v1', '1.0') THEN 'not json' WHEN quote IS NULL THEN 'not json' ELSE 'not json' END AS fenced_strict FROM action_items""")
def strict_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of the strict form, once plain and once behind a fence, which the strict reader refuses and the lenient one mends."""
    rows = table(spark, d, "action_items", "item_id", "title", "description", "quote", "confidence")
    evidence = F.array(F.struct(F.col("item_id").cast("string").alias("id"), "quote"))
    text = F.to_json(F.struct(F.col("confidence").alias("version"), evidence.alias("evidence"), F.array(F.struct("title", F.col("description").alias("detail"))).alias("summary")))
    fenced = F.concat(F.lit("```json\n"), text, F.lit("\n```"))
    said = rows.select("item_id", text.alias("t"), fenced.alias("f"))
    plain, mended = replies.strict_problem(F.col("t")), replies.strict_problem(F.col("f"), strict=False)
    return said.select("item_id", F.when(plain.eqNullSafe(mended), plain).otherwise("differs").alias("strict_problem"), replies.strict_problem(F.col("f")).alias("fenced_strict"))


@query(f"""WITH valid AS (SELECT a.item_id, a.evidence_id, f.conversation_id FROM ({_CHECKED}) c JOIN action_items a USING (item_id) JOIN ({_FLAGS}) f ON f.evidence_id = a.evidence_id WHERE problem IS NULL AND f.conversation_id IS NOT NULL)
SELECT conversation_id, evidence_id, 'reply' AS origin FROM valid UNION ALL SELECT conversation_id, evidence_id, 'extractive' FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, category ORDER BY priority_score DESC, evidence_id) AS place FROM (SELECT *, CASE WHEN n_verbs > 0 THEN CASE WHEN coalesce(addressed_to_me, false) THEN 'my_actions' ELSE 'others_actions' END WHEN n_dates > 0 THEN 'deadlines' WHEN priority_score >= 2 THEN 'risks' ELSE 'fyi' END AS category FROM ({_FLAGS}) WHERE conversation_id IS NOT NULL)) WHERE place <= CASE category WHEN 'risks' THEN 3 WHEN 'fyi' THEN 10 ELSE 5 END AND conversation_id NOT IN (SELECT conversation_id FROM valid)""")
def fallback_items(spark: SparkSession, d: str) -> DataFrame:
    """The valid items of the replies of each conversation, or its extractive ones where there are none."""
    rows = _scored(spark, d).filter("conversation_id IS NOT NULL").drop("score").withColumnRenamed("priority_score", "score")
    valid = _checked(spark, d).filter("problem IS NULL").select("item_id", F.col("item.evidence_id").alias("evidence_id")).join(rows.select("evidence_id", "conversation_id"), "evidence_id").select("conversation_id", "evidence_id")
    extractive = digest.extractive(rows, "conversation_id").select("conversation_id", "evidence_id")
    return replies.with_fallback(valid, extractive, rows.select("conversation_id"), "conversation_id")


# digests as documents and reports

_DIGEST = "digest_date || '@' || mailbox_id"
#: Items in two sections: those with a mark of action and the others.
_PLACED = f"""SELECT *, row_number() OVER (PARTITION BY digest, section ORDER BY confidence DESC NULLS LAST, item_id) AS place, CASE WHEN section = 'Мои действия' THEN 1 ELSE 3 END AS section_place FROM (SELECT item_id, {_DIGEST} AS digest, digest_date, title, due_date AS due, evidence_id, email_subject AS subject, {_CONF} AS confidence, CASE WHEN coalesce({" OR ".join(f"contains(lower(title), '{m}')" for m in ranking.MARKERS)}, false) THEN 'Мои действия' ELSE 'К сведению' END AS section FROM action_items)"""


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(digests, items) of the written items, by day and mailbox, in two sections."""
    rows = table(spark, d, "action_items", "item_id", "digest_date", "mailbox_id", "title", "due_date", "evidence_id", "confidence", "email_subject")
    section = F.when(ranking.has_marker(F.col("title")), "Мои действия").otherwise("К сведению")
    items = rows.select("item_id", F.concat_ws("@", "digest_date", F.col("mailbox_id").cast("string")).alias("digest"), "digest_date", "title", F.col("due_date").alias("due"), "evidence_id", F.col("email_subject").alias("subject"), digest.confidence_number(F.col("confidence")).alias("confidence"), section.alias("section"), F.lit("email").alias("source_type"))
    items = items.withColumns({"_section": F.concat_ws("|", "digest", "section"), "section_place": digest.section_place(F.col("section"))})
    placed = ranking.ranked(items, "_section", "confidence", "item_id").drop("_section")
    heads = placed.groupBy("digest").agg(F.min("digest_date").alias("digest_date"), F.count(F.lit(1)).alias("total_emails"), F.sum(F.when(F.col("section_place") == 1, 1).otherwise(0)).alias("emails_with_actions")).withColumn("trace_id", F.concat(F.lit("t-"), F.col("digest")))
    return heads, placed


_RU_CONF = "CASE WHEN coalesce(confidence, 0) >= 0.9 THEN 'Очень высокая' WHEN coalesce(confidence, 0) >= 0.7 THEN 'Высокая' WHEN coalesce(confidence, 0) >= 0.5 THEN 'Средняя' WHEN coalesce(confidence, 0) >= 0.3 THEN 'Низкая' ELSE 'Очень низкая' END"
_PLAIN = f"""WITH p AS ({_PLACED}), h AS (SELECT digest, min(digest_date) AS day, count(*) AS n, sum(CASE WHEN section_place = 1 THEN 1 ELSE 0 END) AS acts FROM p GROUP BY 1),
lines AS (SELECT digest, 0 AS a, 0 AS b, 0 AS c, '' AS e, '# Дайджест действий - ' || day || chr(10) || chr(10) || '*Trace ID: t-' || digest || '*' || chr(10) AS l FROM h
UNION ALL SELECT digest, 1, section_place, 0, '', '## ' || section || chr(10) FROM p GROUP BY 1, 3, section
UNION ALL SELECT digest, 1, section_place, place, '', '### ' || place || '. ' || coalesce(title, '') || CASE WHEN coalesce(due, '') <> '' THEN chr(10) || '**Срок:** ' || due ELSE '' END || chr(10) || '**Уверенность:** ' || {_RU_CONF} || chr(10) || '**Источник:** email' || CASE WHEN coalesce(subject, '') <> '' THEN ', тема "' || subject || '"' ELSE '' END || ', evidence ' || coalesce(evidence_id, '') || chr(10) FROM p WHERE place <= 10
UNION ALL SELECT digest, 1, section_place, 11, '', '*... и еще ' || (count(*) - 10) || ' элементов*' || chr(10) FROM p GROUP BY 1, 3 HAVING count(*) > 10
UNION ALL SELECT digest, 2, 0, 0, '', '## Статистика' || chr(10) || chr(10) || 'Обработано ' || n || ' писем, ' || acts || ' (' || CAST(floor(acts * 100 / n) AS BIGINT) || '%) содержали действия' || chr(10) FROM h
UNION ALL SELECT digest, 3, 0, 0, '', '## Источники' || chr(10) FROM h
UNION ALL SELECT DISTINCT digest, 4, 0, 0, coalesce(evidence_id, ''), '### Evidence ' || coalesce(evidence_id, '') || chr(10) || '*ID: ' || coalesce(evidence_id, '') || '*' || chr(10) FROM p)
SELECT digest, string_agg(l, chr(10) ORDER BY a, b, c, e) AS report FROM lines GROUP BY 1"""


@query(_PLAIN)
def plain_reports(spark: SparkSession, d: str) -> DataFrame:
    """Each digest as Markdown, with statistics and sources."""
    heads, items = _placed(spark, d)
    return reports.plain_markdown(heads, items, "digest", max_words=None)


_WORDS = "list_filter(regexp_split_to_array(report, '\\s+'), lambda w: w <> '')"


@query(rf"""SELECT digest, regexp_matches(report, '(?m)^# ') AND regexp_matches(report, '(?m)^## ') AND regexp_matches(report, '(?m)^.*Источник:.*evidence.*$') AS valid, CASE WHEN len({_WORDS}) <= 400 THEN len({_WORDS}) ELSE 396 END AS n_words FROM ({_PLAIN})""")
def reports_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether each report is well formed, and its words once it is cut to the limit."""
    heads, items = _placed(spark, d)
    rows = reports.plain_markdown(heads, items, "digest", max_words=None)
    return rows.select("digest", reports.is_valid_markdown(F.col("report")).alias("valid"), F.size(F.filter(F.split(reports.limited_words(F.col("report")), r"\s+"), lambda w: w != "")).alias("n_words"))


@query(f"""WITH p AS ({_PLACED}), lines AS (SELECT digest, 0 AS a, 0 AS b, 0 AS c, '## Дайджест действий — ' || min(digest_date) AS l FROM p GROUP BY 1 UNION ALL SELECT digest, 1, section_place, 0, chr(10) || '**' || section || '**' FROM p GROUP BY 1, 3, section
UNION ALL SELECT digest, 1, section_place, place, CASE WHEN section = 'К сведению' THEN '-' ELSE place || '.' END || ' ' || coalesce(title, '') || CASE WHEN coalesce(due, '') <> '' THEN ' | срок: ' || due ELSE '' END || ' | уверенность: ' || lower({_RU_CONF}) FROM p UNION ALL SELECT digest, 2, 0, 0, chr(10) || '_trace: t-' || digest || ' | items: ' || count(*) || '_' FROM p GROUP BY 1)
SELECT digest, string_agg(l, chr(10) ORDER BY a, b, c) AS report FROM lines GROUP BY 1""")
def chat_reports(spark: SparkSession, d: str) -> DataFrame:
    heads, items = _placed(spark, d)
    return reports.chat_text(heads, items, "digest")


@query(f"""SELECT digest, 'Найдено ' || CAST(sum(n) AS BIGINT) || ' действий: ' || string_agg('- ' || section || ': ' || n, ' ' ORDER BY section_place) AS summary FROM (SELECT digest, section, section_place, count(*) AS n FROM ({_PLACED}) GROUP BY ALL) GROUP BY 1""")
def digest_summaries(spark: SparkSession, d: str) -> DataFrame:
    heads, items = _placed(spark, d)
    return reports.summary_text(heads, items, "digest")


@query(f"SELECT DISTINCT digest, evidence_id, CAST(dense_rank() OVER (PARTITION BY digest ORDER BY evidence_id) AS INTEGER) AS place FROM ({_PLACED}) WHERE evidence_id IS NOT NULL")
def digest_evidence(spark: SparkSession, d: str) -> DataFrame:
    return reports.evidence_ids(_placed(spark, d)[1], "digest")


_SECTION5 = "CASE WHEN item_id % 5 = 0 THEN 'my_actions' WHEN item_id % 5 = 1 THEN 'others_actions' WHEN item_id % 5 = 2 THEN 'deadlines_meetings' WHEN item_id % 5 = 3 THEN 'risks_blockers' ELSE 'fyi' END"
_SRC = """'**Источник:** ' || CASE WHEN coalesce(email_subject, '') <> '' THEN 'тема "' || email_subject || '", evidence ' || coalesce(evidence_id, '') ELSE 'Evidence ' || coalesce(evidence_id, '') END || chr(10) || '**Цитата:** "' || coalesce(quote, '') || '"' || chr(10)"""
_DUE = "CASE WHEN coalesce(due_date_label, '') <> '' THEN ' (' || due_date_label || ')' ELSE '' END"
_OWN = "CASE WHEN coalesce(len(actors), 0) > 0 THEN '**Ответственные:** ' || array_to_string(actors, ', ') || chr(10) ELSE '' END"


@query(f"""WITH p AS (SELECT *, {_DIGEST} AS digest, {_SECTION5} AS section FROM action_items), q AS (SELECT *, row_number() OVER (PARTITION BY digest, section ORDER BY item_id) AS place, CASE section WHEN 'my_actions' THEN 1 WHEN 'others_actions' THEN 2 WHEN 'deadlines_meetings' THEN 3 WHEN 'risks_blockers' THEN 4 ELSE 5 END AS a FROM p),
lines AS (SELECT digest, 0 AS a, 0 AS b, '# Дайджест действий - ' || min(digest_date) || chr(10) || '*Trace ID: t-' || digest || '*' || chr(10) || '*Timezone: UTC*' || chr(10) || '*Schema version: 2.0*' || CASE WHEN min(mailbox_id) % 2 = 0 THEN chr(10) || chr(10) || '---' || chr(10) || '⚠️ **ЧАСТИЧНЫЙ ОТЧЁТ: Ошибка обработки LLM**' || chr(10) || chr(10) || 'Данный дайджест создан в резервном режиме (extractive fallback) из-за сбоя LLM.' || chr(10) || 'Информация может быть неполной или менее точной, чем обычно.' || chr(10) || '---' ELSE '' END AS l FROM q GROUP BY digest
UNION ALL SELECT DISTINCT digest, 0, 1, '' FROM q UNION ALL SELECT DISTINCT digest, a, 0, '## ' || CASE a WHEN 1 THEN 'Мои действия' WHEN 2 THEN 'Действия других' WHEN 3 THEN 'Дедлайны и встречи' WHEN 4 THEN 'Риски и блокеры' ELSE 'К сведению (FYI)' END || chr(10) FROM q
UNION ALL SELECT digest, a, place, '### ' || place || '. ' || coalesce(title, '') || chr(10) || CASE
WHEN a <= 2 THEN '**Описание:** ' || coalesce(description, '') || chr(10) || CASE WHEN coalesce(due_date, '') <> '' THEN '**Срок:** ' || due_date || {_DUE} || chr(10) ELSE '' END || '**Уверенность:** ' || coalesce(confidence, '') || chr(10) || {_OWN} || CASE WHEN a = 1 AND coalesce(response_channel, '') <> '' THEN '**Канал ответа:** ' || response_channel || chr(10) ELSE '' END
WHEN a = 3 THEN '**Дата/время:** ' || coalesce(due_date, '') || {_DUE} || chr(10) || CASE WHEN coalesce(response_channel, '') <> '' THEN '**Место:** ' || response_channel || chr(10) ELSE '' END || CASE WHEN coalesce(len(actors), 0) > 0 THEN '**Участники:** ' || array_to_string(actors, ', ') || chr(10) ELSE '' END
WHEN a = 4 THEN '**Серьёзность:** ' || coalesce(confidence, '') || chr(10) || '**Влияние:** ' || coalesce(description, '') || chr(10) || {_OWN} ELSE CASE WHEN coalesce(response_channel, '') <> '' THEN '**Категория:** ' || response_channel || chr(10) ELSE '' END END || {_SRC} FROM q)
SELECT digest, string_agg(l, chr(10) ORDER BY a, b) AS report FROM lines GROUP BY 1""")
def typed_reports(spark: SparkSession, d: str) -> DataFrame:
    """Digests of five kinds of sections; here an item's number says which, and every other mailbox has a partial digest."""
    rows = table(spark, d, "action_items").withColumns({"digest": F.concat_ws("@", "digest_date", F.col("mailbox_id").cast("string")), "section": F.expr(_SECTION5)})
    rows = rows.withColumn("_s", F.concat_ws("|", "digest", "section")).withColumn("_first", -F.col("item_id"))
    placed = ranking.ranked(rows, "_s", "_first", "item_id")
    c = {n: F.col(n) for n in ("section", "place", "title", "description", "due_date", "due_date_label", "confidence", "response_channel", "evidence_id", "quote")}
    c |= {"due_date_normalized": F.lit(None).cast("string"), "owners": F.col("actors"), "date_time": F.col("due_date"), "date_label": F.col("due_date_label"), "location": F.col("response_channel"), "participants": F.col("actors"), "severity": F.col("confidence"), "impact": F.col("description"), "category": F.col("response_channel"), "subject": F.col("email_subject")}
    blocks = placed.select("digest", "section", "place", reports.typed_block(c).alias("block"))
    heads = rows.groupBy("digest").agg(F.min("digest_date").alias("digest_date"), F.min("mailbox_id").alias("_m")).select("digest", "digest_date", F.concat(F.lit("t-"), F.col("digest")).alias("trace_id"), F.lit("UTC").alias("timezone"), F.lit("2.0").alias("schema_version"), F.when(F.col("_m") % 2 == 0, "llm_processing_failed").alias("partial"))
    return reports.typed_markdown(heads, blocks, "digest")


@query(f"""SELECT item_id, CASE WHEN coalesce(digest_date, '') = '' THEN 'date or trace missing' WHEN NOT regexp_matches(digest_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR try_strptime(digest_date, '%Y-%m-%d') IS NULL THEN 'date form' WHEN coalesce(title, '') = '' OR coalesce(evidence_id, '') = '' OR NOT coalesce(c BETWEEN 0 AND 1, false) THEN 'item' END AS problem FROM (SELECT *, {_CONF} AS c FROM action_items)""")
def documents_checked(spark: SparkSession, d: str) -> DataFrame:
    """Digests of one item each, written as documents and read again."""
    rows = table(spark, d, "action_items", "item_id", "digest_date", "title", "due_date", "evidence_id", "confidence")
    item = F.struct("title", F.col("due_date").alias("due"), "evidence_id", digest.confidence_number(F.col("confidence")).alias("confidence"), F.create_map(F.lit("type"), F.lit("email")).alias("source_ref"))
    sections = F.array(F.struct(F.lit("Мои действия").alias("title"), F.array(item).alias("items")), F.struct(F.lit("Срочно").alias("title"), F.filter(F.array(item), lambda i: F.lit(False)).alias("items")))
    written = rows.select("item_id", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit("p.v1").alias("prompt_version"), "digest_date", F.lit("t").alias("trace_id"), digest.without_empty_sections(sections).alias("sections"))).alias("document"))
    return digest.read_documents(written, "item_id", "document").select("item_id", "problem")


# grading


@query(f"""WITH i AS (SELECT digest, item_id, split_part(issue, ':', 1) AS severity, split_part(issue, ':', 2) AS chk FROM ({_ISSUES})), g AS (SELECT n.digest, n.n, coalesce(e, 0) AS e, coalesce(w, 0) AS w, n.n - coalesce(b, 0) AS clean, greatest(0, 100 - 10 * coalesce(e, 0) - 3 * coalesce(w, 0)) AS s FROM (SELECT {_DIGEST} AS digest, count(*) AS n FROM action_items GROUP BY 1) n LEFT JOIN (SELECT digest, CAST(sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS e, CAST(sum(CASE WHEN severity = 'warn' THEN 1 ELSE 0 END) AS BIGINT) AS w, count(DISTINCT CASE WHEN severity = 'error' THEN item_id END) AS b FROM i GROUP BY 1) x USING (digest)),
lines AS (SELECT digest, 0 AS a, '' AS b, '## Prompt Eval — ' || digest || chr(10) || 'Prompt version: `v1`' || chr(10) || 'Score: **' || s || '/100** (grade ' || CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' ELSE 'D' END || ') | Items: ' || n || ' | Clean items: ' || CAST(round(clean * 100.0 / n) AS INTEGER) || '% | Errors: ' || e || ' | Warnings: ' || w || chr(10) || 'Evidence IDs: validated against ingest snapshot ✓' || chr(10) || chr(10) || '### Issues' AS l FROM g
UNION ALL SELECT digest, 1, '', '✓ No issues found.' FROM g WHERE e + w = 0 UNION ALL SELECT digest, 2, severity || '|' || chk, CASE severity WHEN 'error' THEN '✗' ELSE '⚠' END || ' ' || chk || ': ' || count(*) FROM i GROUP BY digest, severity, chk)
SELECT digest, string_agg(l, chr(10) ORDER BY a, b) AS report FROM lines GROUP BY 1""")
def grade_reports(spark: SparkSession, d: str) -> DataFrame:
    items, found = _issues(spark, d)
    return reports.grade_report(evaluation.graded(items, found, "digest", "item_id"), found, "digest", "v1", True)


@query(f"SELECT {_DIGEST} AS digest, coalesce(response_channel, 'none') AS section, count(*) AS n_items FROM action_items GROUP BY ALL")
def digest_section_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "action_items", "digest_date", "mailbox_id", "response_channel").select(F.concat_ws("@", "digest_date", F.col("mailbox_id").cast("string")).alias("digest"), F.coalesce("response_channel", F.lit("none")).alias("section"))
    return evaluation.section_counts(rows, "digest", "section")


@query("""SELECT item_id, evidence_id, CASE item_id % 4 WHEN 0 THEN 'list' WHEN 1 THEN 'chunks' WHEN 3 THEN 'reply' END AS form FROM action_items WHERE item_id % 4 <> 2 AND coalesce(evidence_id, '') <> '' UNION ALL SELECT item_id, 'ev-' || format('{:x}', item_id), 'prompt' FROM action_items WHERE item_id % 4 = 2""")
def snapshot_ids(spark: SparkSession, d: str) -> DataFrame:
    """Evidence named by snapshots in the four forms that there are; an item's number says which form its snapshot has."""
    rows = table(spark, d, "action_items", "item_id", "evidence_id")
    named = F.array(F.struct("evidence_id"))
    sent = F.concat(F.lit("Evidence 1 (ID: ev-"), F.lower(F.hex("item_id")), F.lit(", Msg: m, Thread: t)"))
    kind = F.col("item_id") % 4
    document = F.when(kind == 0, F.to_json(F.struct(F.array("evidence_id").alias("evidence_ids")))).when(kind == 1, F.to_json(F.struct(named.alias("chunks")))).when(kind == 2, F.to_json(F.struct(F.array(F.struct(F.array(F.struct(sent.alias("content"))).alias("messages"))).alias("responses"))))
    document = document.otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(named.alias("items"))).alias("sections")).alias("data"))).alias("responses"))))
    return evaluation.snapshot_evidence(rows.select("item_id", document.alias("document")), "item_id", "document")


# citations attached to items

_FOUND = rf"""SELECT c.evidence_id, c.chunk_id, strpos(b.text_body, c.content) > 0 OR (length(trim(regexp_replace(c.content, '[\s\x{{85}}\x{{a0}}\p{{Z}}]+', ' ', 'g'))) > 0 AND contains(trim(regexp_replace(b.text_body, '[\s\x{{85}}\x{{a0}}\p{{Z}}]+', ' ', 'g')), trim(regexp_replace(c.content, '[\s\x{{85}}\x{{a0}}\p{{Z}}]+', ' ', 'g')))) AS ok FROM evidence_chunks c JOIN {_BODY} b ON b.id = c.msg_id WHERE c.content IS NOT NULL AND length(trim(c.content)) > 0 AND c.evidence_id IS NOT NULL"""


def _attached(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence_chunks", "chunk_id", "evidence_id", "msg_id", "content").filter("content IS NOT NULL AND trim(content) <> '' AND evidence_id IS NOT NULL")
    bodies = _bodies(spark, d)
    placed = citations.checked(citations.cited(rows, bodies, "msg_id", "content", "text_body").filter("start_at IS NOT NULL"), bodies, "msg_id", "text_body")
    items = table(spark, d, "action_items", "item_id", "digest_date", "mailbox_id", "evidence_id").withColumn("digest", F.concat_ws("@", "digest_date", F.col("mailbox_id").cast("string")))
    return citations.attached(items, placed)


@query(f"SELECT item_id, CASE WHEN n > 5 THEN 5 ELSE coalesce(n, 0) END AS n_citations, coalesce(n > 0, false) AS citation_ok FROM action_items a LEFT JOIN (SELECT evidence_id, count(*) AS n FROM ({_FOUND}) WHERE ok GROUP BY 1) f ON f.evidence_id = a.evidence_id")
def items_cited(spark: SparkSession, d: str) -> DataFrame:
    """Items with the places of their evidence in the bodies."""
    return _attached(spark, d).select("item_id", F.coalesce(F.greatest(F.size("citations"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_citations"), "citation_ok")


@query(f"SELECT {_DIGEST} AS digest, bool_and(ok) AS ok, count(*) AS n_items, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_bad, min(CASE WHEN NOT ok THEN item_id END) AS first_bad FROM (SELECT a.*, coalesce(n > 0, false) AS ok FROM action_items a LEFT JOIN (SELECT evidence_id, count(*) AS n FROM ({_FOUND}) WHERE ok GROUP BY 1) f ON f.evidence_id = a.evidence_id) GROUP BY 1")
def digests_cited(spark: SparkSession, d: str) -> DataFrame:
    """Whether all items of each digest are backed by places that hold."""
    return citations.digest_verdicts(_attached(spark, d), "digest", "item_id")


# hierarchy and runs

_THREADS = f"(SELECT conversation_id, msg_id, count(*) AS n, max(priority_score) AS best, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS t FROM ({_FLAGS}) WHERE conversation_id IS NOT NULL GROUP BY ALL)"


@query(f"SELECT CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS threads_summarized, CAST(sum(CASE WHEN n >= 3 THEN 0 ELSE 1 END) AS BIGINT) AS threads_skipped_small, round(coalesce(avg(CASE WHEN n >= 3 THEN t END), 0), 6) AS per_thread_avg_tokens, CAST(coalesce(sum(CASE WHEN n >= 3 THEN t END), 0) AS BIGINT) AS final_input_tokens FROM (SELECT conversation_id, sum(n) AS n, sum(t) AS t FROM {_THREADS} GROUP BY 1)")
def hierarchy_averages(spark: SparkSession, d: str) -> DataFrame:
    per = _scored(spark, d).filter("conversation_id IS NOT NULL").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("token_count", F.lit(0))).alias("t"))
    return hierarchy.averages(per.withColumn("on", F.col("n") >= hierarchy.LEAST_CHUNKS), "on", "t")


@query(f"""WITH c AS (SELECT * FROM ({_FLAGS}) WHERE conversation_id IS NOT NULL), s AS (SELECT conversation_id AS run, msg_id AS thread, 'summary' AS kind, max(priority_score) AS score, 0 AS r, 40 AS tokens FROM c GROUP BY ALL HAVING count(*) >= 3), k AS (SELECT conversation_id AS run, msg_id AS thread, 'chunk' AS kind, priority_score AS score, row_number() OVER (PARTITION BY conversation_id, msg_id ORDER BY priority_score DESC, chunk_id) AS r, coalesce(token_count, 0) AS tokens FROM c WHERE (conversation_id, msg_id) NOT IN (SELECT (run, thread) FROM s)),
u AS (SELECT * FROM s UNION ALL SELECT * FROM k WHERE r <= 3) SELECT run, thread, kind, CAST(row_number() OVER w AS INTEGER) AS place, CAST(tokens AS BIGINT) AS tokens, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) <= 4000 AS kept FROM u WINDOW w AS (PARTITION BY run ORDER BY kind DESC, score DESC, thread, r)""")
def final_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What the last call of a run reads; here a conversation stands for a run and a mail of it for a thread."""
    rows = _scored(spark, d).filter("conversation_id IS NOT NULL").select(F.col("conversation_id").alias("run"), F.col("msg_id").alias("thread"), F.col("chunk_id").alias("key"), F.col("priority_score").alias("score"), F.coalesce("token_count", F.lit(0)).cast("bigint").alias("tokens"))
    per = rows.groupBy("run", "thread").agg(F.count(F.lit(1)).alias("_n"), F.max("score").alias("score"))
    summaries = per.filter(F.col("_n") >= hierarchy.LEAST_CHUNKS).select("run", "thread", "score", F.lit(40).cast("bigint").alias("tokens"))
    small = rows.join(summaries.select("run", "thread"), ["run", "thread"], "left_anti")
    return hierarchy.combined(summaries, small, "run", "thread", "tokens")


@query(f"SELECT conversation_id, CAST(place AS INTEGER) AS place, chunk_id, substr(content, 1, 150) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY priority_score DESC, chunk_id) AS place FROM ({_FLAGS}) WHERE conversation_id IS NOT NULL) WHERE place <= 5")
def thread_snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter("conversation_id IS NOT NULL")
    return hierarchy.snippets(rows, "conversation_id", "chunk_id", "priority_score", "content")


@query("SELECT event_type, le, n FROM (SELECT event_type, unnest([10, 50, 100, 250, 500, 1000, 2500, 5000, NULL]) AS le, unnest([" + ", ".join(f"CAST(sum(CASE WHEN value <= {b} THEN 1 ELSE 0 END) AS BIGINT)" for b in (10, 50, 100, 250, 500, 1000, 2500, 5000)) + ", count(*)]) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)")
def latency_buckets(spark: SparkSession, d: str) -> DataFrame:
    return runs.latency_histogram(table(spark, d, "events", "event_type", "value"), "event_type", "value")
