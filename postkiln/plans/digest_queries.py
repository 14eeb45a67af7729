"""Queries of threads, evidence, selection, citations, ranking, digests and grading, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkiln.functions import signals
from postkiln.functions.text import same_subject
from postkiln.operators import actions, citations, digest, evaluation, evidence, hierarchy, ranking, selection, threads
from postkiln.operators.deliveries import cleaned_id, keep_first_delivery
from postkiln.plans.core_queries import _RANKED
from postkiln.plans.text_queries import _SUBJECT_SQL, ALIASES, AS_OF
from postkiln.sources import snapshots
from postkiln.sources.tables import table
from postkiln.streaming import mail

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# threads


@query("SELECT doc_id, n AS n_copies FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1 UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NULL")
def unique_bodies(spark: SparkSession, d: str) -> DataFrame:
    return threads.unique_bodies(table(spark, d, "documents", "doc_id", "text"), "text", "doc_id").select("doc_id", "n_copies")


@query("SELECT min(row_id) AS primary_key, count(*) - 1 AS duplicates, max(row_id) AS last_duplicate FROM messages WHERE text_body IS NOT NULL GROUP BY text_body HAVING count(*) > 1")
def duplicate_bodies(spark: SparkSession, d: str) -> DataFrame:
    return threads.duplicate_counts(table(spark, d, "messages", "row_id", "text_body"), "text_body", "row_id")


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, round(1 - count(*) / sum(n), 6) AS redundancy FROM (SELECT count(*) AS n FROM messages GROUP BY coalesce(text_body, ''))")
def redundancy_index(spark: SparkSession, d: str) -> DataFrame:
    return threads.redundancy(table(spark, d, "messages", "text_body"), "text_body")


_THREAD = rf"""coalesce('conv_' || nullif(trim(conversation_id), ''), CASE WHEN {_SUBJECT_SQL} <> '' THEN 'subj_' || substr(sha256({_SUBJECT_SQL}), 1, 16) END, 'single_' || row_id)"""


def _threaded(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = table(spark, d, "messages", *dict.fromkeys(["row_id", "conversation_id", "subject", "ingested_at", "sender_email", *columns]))
    return rows.withColumn("thread", threads.thread_key(F.col("conversation_id"), F.col("subject"), F.col("row_id").cast("string")))


_SUMMARY = f"""SELECT thread, count(*) AS n_messages, least(count(*), 50) AS n_kept, max(ingested_at) AS latest, count(DISTINCT nullif(lower(trim(sender_email)), '')) AS participants FROM (SELECT *, {_THREAD} AS thread FROM messages) GROUP BY thread"""


@query(_SUMMARY)
def thread_summaries(spark: SparkSession, d: str) -> DataFrame:
    return threads.thread_summary(_threaded(spark, d), "thread", "ingested_at", "sender_email")


@query(f"""SELECT thread, row_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY ingested_at DESC, row_id DESC) AS rn FROM (SELECT *, {_THREAD} AS thread FROM messages)) WHERE rn <= 50""")
def thread_latest(spark: SparkSession, d: str) -> DataFrame:
    return threads.latest_of_thread(_threaded(spark, d), "thread", "ingested_at", "row_id").select("thread", "row_id", "rank")


@query(f"""SELECT *, CASE WHEN h < 1 THEN 10.0 WHEN h < 6 THEN 5.0 WHEN h < 24 THEN 2.0 ELSE 0.0 END + CASE WHEN participants > 5 THEN 2.0 WHEN participants > 2 THEN 1.0 ELSE 0.0 END + CASE WHEN n_messages > 10 THEN 1.0 WHEN n_messages > 5 THEN 0.5 ELSE 0.0 END AS priority FROM (SELECT thread, n_messages, latest, participants, (epoch(TIMESTAMP '2025-06-15 12:00:00') - floor(epoch(latest))) / 3600 AS h FROM ({_SUMMARY}))""".replace("SELECT *, CASE", "SELECT thread, n_messages, participants, CASE", 1))
def thread_priorities(spark: SparkSession, d: str) -> DataFrame:
    summary = threads.thread_summary(_threaded(spark, d), "thread", "ingested_at", "sender_email")
    return threads.prioritised(summary, "2025-06-15 12:00:00").select("thread", "n_messages", "participants", "priority")


@query(f"SELECT thread FROM ({_SUMMARY}) WHERE latest >= TIMESTAMP '2025-06-15 12:00:00' - INTERVAL 48 HOURS")
def threads_recent(spark: SparkSession, d: str) -> DataFrame:
    summary = threads.thread_summary(_threaded(spark, d), "thread", "ingested_at", "sender_email")
    return threads.recent(summary, "2025-06-15 12:00:00").select("thread")


@query(f"SELECT thread, CAST(row_number() OVER (ORDER BY latest DESC NULLS LAST, thread) AS INTEGER) AS place FROM ({_SUMMARY})")
def threads_by_latest(spark: SparkSession, d: str) -> DataFrame:
    return threads.by_latest(threads.thread_summary(_threaded(spark, d), "thread", "ingested_at", "sender_email"), "thread").select("thread", "place")


@query("SELECT c.conversation_id, n_messages, coalesce(n, 0) AS n_chunks FROM (SELECT conversation_id, count(*) AS n_messages FROM messages WHERE conversation_id IS NOT NULL GROUP BY 1) c LEFT JOIN (SELECT conversation_id, count(*) AS n FROM evidence_chunks GROUP BY 1) k USING (conversation_id)")
def threads_with_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Messages and chunks of each conversation; conversations without evidence have 0."""
    talks = table(spark, d, "messages", "conversation_id").filter("conversation_id IS NOT NULL").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return threads.with_chunk_counts(talks, table(spark, d, "evidence_chunks", "conversation_id"), "conversation_id")


@query(f"SELECT id, row_id, subject FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch_no DESC, row_id DESC) AS last FROM ({_RANKED}) WHERE id IS NOT NULL) WHERE last = 1")
def last_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each identifier, as an index of messages holds it."""
    rows = table(spark, d, "messages", "msg_id", "batch_no", "row_id", "subject").withColumn("id", cleaned_id("msg_id"))
    return threads.latest_by_id(rows, "id", ["batch_no", "row_id"], ["row_id", "subject"])


@query(f"""SELECT thread, participant, string_agg(DISTINCT role, '|' ORDER BY role) AS roles FROM (SELECT thread, nullif(lower(trim(who)), '') AS participant, role FROM (SELECT thread, sender_email AS who, 'from' AS role FROM (SELECT *, {_THREAD} AS thread FROM messages) UNION ALL SELECT thread, unnest(to_recipients), 'to' FROM (SELECT *, {_THREAD} AS thread FROM messages) UNION ALL SELECT thread, unnest(cc_recipients), 'cc' FROM (SELECT *, {_THREAD} AS thread FROM messages))) WHERE participant IS NOT NULL GROUP BY ALL""")
def thread_people(spark: SparkSession, d: str) -> DataFrame:
    """Everyone in a thread, once, and in what part."""
    return threads.participants(_threaded(spark, d, "to_recipients", "cc_recipients"), "thread", "sender_email", "to_recipients", "cc_recipients")


@query(f"""SELECT m.messages, m.unique_bodies, count(*) AS threads, {", ".join(f"CAST(sum(CASE WHEN thread LIKE '{k}|_%' ESCAPE '|' THEN 1 ELSE 0 END) AS BIGINT) AS by_{k}" for k in ("conv", "subj", "single"))}, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS with_replies FROM (SELECT {_THREAD} AS thread, count(*) AS n FROM messages GROUP BY 1) t, (SELECT count(*) AS messages, count(DISTINCT coalesce(text_body, '')) AS unique_bodies FROM messages) m GROUP BY ALL""")
def thread_statistics(spark: SparkSession, d: str) -> DataFrame:
    return threads.thread_statistics(_threaded(spark, d, "text_body"), "thread", "text_body")


_TRIGRAMS = "CASE WHEN length({t}) >= 3 THEN list_distinct(list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3))) ELSE [] END"


@query(f"""WITH RECURSIVE heads AS (SELECT thread, arg_min({{'s': subject, 'b': text_body}}, {{'a': ingested_at, 'r': row_id}}) AS h FROM (SELECT *, {_THREAD} AS thread FROM messages) WHERE text_body IS NOT NULL GROUP BY 1),
keyed AS (SELECT thread, {_SUBJECT_SQL} AS s, {_TRIGRAMS.format(t="lower(substr(b, 1, 200))")} AS g FROM (SELECT thread, h.s AS subject, h.b AS b FROM heads)), rows AS MATERIALIZED (SELECT * FROM keyed WHERE s <> '' AND len(g) > 0),
edges AS MATERIALIZED (SELECT a.thread AS x, b.thread AS y FROM rows a JOIN rows b ON a.s = b.s AND a.thread <> b.thread WHERE len(list_intersect(a.g, b.g)) >= 0.7 * len(list_distinct(list_concat(a.g, b.g)))),
reach AS (SELECT thread AS x, thread AS c FROM rows UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.c = e.x)
SELECT x AS thread, min(c) AS merged_into FROM reach GROUP BY 1""")
def merged_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads of one subject with like first messages, as classes; tested against brute force."""
    heads = _threaded(spark, d, "text_body").filter("text_body IS NOT NULL").groupBy("thread").agg(F.min_by(F.struct("subject", "text_body"), F.struct("ingested_at", "row_id")).alias("h"))
    return threads.merged_threads(heads.select("thread", "h.subject", "h.text_body"), "thread", "subject", "text_body")


@query(f"SELECT a.row_id, b.row_id AS parent_row FROM (SELECT * FROM ({_RANKED}) WHERE rn = 1 AND id IS NOT NULL) a JOIN (SELECT * FROM ({_RANKED}) WHERE rn = 1 AND id IS NOT NULL) b ON b.id = nullif(lower(regexp_replace(trim(a.in_reply_to), '^<(.*)>$', '\\1')), '')")
def reply_parents(spark: SparkSession, d: str) -> DataFrame:
    """Each mail with the mail it answers, by reply header."""
    rows = keep_first_delivery(table(spark, d, "messages", "row_id", "batch_no", "msg_id", "in_reply_to")).select("row_id", cleaned_id("msg_id").alias("id"), cleaned_id("in_reply_to").alias("parent"))
    parents = rows.filter("id IS NOT NULL").select(F.col("id").alias("parent"), F.col("row_id").alias("parent_row"))
    return rows.filter("id IS NOT NULL AND parent IS NOT NULL").join(parents, "parent").select("row_id", "parent_row")


@query(f"SELECT a.row_id, coalesce({_SUBJECT_SQL.replace('subject', 'a.subject')} = {_SUBJECT_SQL.replace('subject', 'b.subject')} AND {_SUBJECT_SQL.replace('subject', 'a.subject')} <> '', false) AS same FROM (SELECT * FROM ({_RANKED}) WHERE rn = 1 AND id IS NOT NULL) a JOIN (SELECT * FROM ({_RANKED}) WHERE rn = 1 AND id IS NOT NULL) b ON b.id = nullif(lower(regexp_replace(trim(a.in_reply_to), '^<(.*)>$', '\\1')), '')")
def reply_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Whether each reply has the subject of the mail it answers."""
    rows = keep_first_delivery(table(spark, d, "messages", "row_id", "batch_no", "msg_id", "in_reply_to", "subject")).select("row_id", cleaned_id("msg_id").alias("id"), cleaned_id("in_reply_to").alias("parent"), "subject").filter("id IS NOT NULL")
    parents = rows.select(F.col("id").alias("parent"), F.col("subject").alias("_above"))
    return rows.filter("parent IS NOT NULL").join(parents, "parent").select("row_id", same_subject(F.col("subject"), F.col("_above")).alias("same"))


_LOW = "lower(coalesce(subject, '') || ' ' || coalesce(sender_email, ''))"
_SERVICE = f"regexp_matches(coalesce(subject, '') || ' ' || coalesce(sender_email, ''), '(?i)(\\b(noreply@|no-reply@|donotreply@)|(^|[^\\p{{L}}\\p{{N}}_])(unsubscribe|отписаться)($|[^\\p{{L}}\\p{{N}}_])|(^|[^\\p{{L}}\\p{{N}}_])(auto-submitted|автоответ)($|[^\\p{{L}}\\p{{N}}_])|\\bpostmaster@|(^|[^\\p{{L}}\\p{{N}}_])(delivery status|статус доставки)($|[^\\p{{L}}\\p{{N}}_])|\\b(out of office|auto-reply|automatic reply)\\b)')"


@query(f"""SELECT row_id, {_SERVICE} AS service, {" + ".join(f"CASE WHEN contains({_LOW}, '{m}') THEN 1.0 ELSE 0.0 END" for m in selection.PLAIN_MARKERS)} - CASE WHEN {_SERVICE} THEN 1.0 ELSE 0.0 END + CASE WHEN regexp_matches(lower(coalesce(sender_email, '')), 'ceo@|director@') THEN 2.0 WHEN regexp_matches(lower(coalesce(sender_email, '')), 'manager@|lead@') THEN 1.0 ELSE 0.0 END + CASE WHEN len(coalesce(to_recipients, [])) > 1 THEN 1.0 ELSE 0.0 END AS score FROM messages""")
def plain_scores(spark: SparkSession, d: str) -> DataFrame:
    """The plain scorer of mails; here its recipients stand for the messages of its thread."""
    rows = table(spark, d, "messages", "row_id", "subject", "sender_email", "to_recipients")
    who, what = F.col("sender_email"), F.col("subject")
    return rows.select("row_id", selection.is_service_mail(what, who).alias("service"), selection.plain_score(what, who, F.coalesce(F.size("to_recipients"), F.lit(0))).alias("score"))


# evidence and selection


@query()
def evidence_chunks_cut(spark: SparkSession, d: str) -> DataFrame:
    return evidence.chunks(table(spark, d, "messages", "row_id", "text_body"), "row_id", "text_body")


_FIRST_CHUNK = "(SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY chunk_id) AS rn FROM evidence_chunks WHERE content IS NOT NULL AND evidence_id IS NOT NULL)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per evidence_id with content: the first of those written twice."""
    rows = table(spark, d, "evidence_chunks").filter("content IS NOT NULL AND evidence_id IS NOT NULL")
    first = rows.groupBy("evidence_id").agg(F.min("chunk_id").alias("chunk_id"))
    return rows.join(first.select("chunk_id"), "chunk_id", "left_semi")


_FLAGS = f"""SELECT chunk_id, evidence_id, conversation_id, content, token_count, addressed_to_me, chunk_idx, coalesce(priority_score, 0) AS priority_score, coalesce(len(signals.action_verbs), 0) AS n_verbs, coalesce(len(signals.dates), 0) AS n_dates, coalesce(signals.contains_question, false) AS question, coalesce(signals.sender_rank, 1) AS sender_rank, coalesce(message_metadata.importance, 'Normal') AS importance, coalesce(message_metadata.is_flagged, false) AS flagged, message_metadata.sender AS sender, msg_id FROM {_FIRST_CHUNK} WHERE rn = 1"""
_ENHANCED = """round(0.2 * 2 + CASE WHEN coalesce(addressed_to_me, false) THEN 3 ELSE 0 END + n_verbs * 1.5 + CASE WHEN question THEN 1 ELSE 0 END + n_dates * 1.5 + CASE WHEN importance = 'High' THEN 2 ELSE 0 END + CASE WHEN flagged THEN 1.5 ELSE 0 END + sender_rank + priority_score * 0.1 + CASE WHEN coalesce(regexp_matches(sender, '(?i)\\b(noreply@|no-reply@|donotreply@)|\\bpostmaster@'), false) THEN -2 ELSE 0 END, 6)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    m, s = F.col("message_metadata"), F.col("signals")
    flat = rows.select(
        "chunk_id", "evidence_id", "conversation_id", "content", "token_count", "addressed_to_me", "chunk_idx", "msg_id", F.coalesce("priority_score", F.lit(0.0)).alias("priority_score"), F.coalesce(F.size(s["action_verbs"]), F.lit(0)).alias("_nv"), F.coalesce(F.size(s["dates"]), F.lit(0)).alias("_nd"),
        F.coalesce(s["contains_question"], F.lit(False)).alias("question"), F.coalesce(s["sender_rank"], F.lit(1)).alias("sender_rank"), F.coalesce(m["importance"], F.lit("Normal")).alias("importance"), F.coalesce(m["is_flagged"], F.lit(False)).alias("flagged"), m["sender"].alias("sender"), s["action_verbs"].alias("action_verbs"), s["dates"].alias("dates"),
    )
    flat = flat.withColumns({"n_verbs": F.greatest(F.col("_nv"), F.lit(0)), "n_dates": F.greatest(F.col("_nd"), F.lit(0))}).drop("_nv", "_nd")
    negative = F.coalesce(F.col("sender").rlike(r"(?i)\b(noreply@|no-reply@|donotreply@)|\bpostmaster@"), F.lit(False))
    # the digest is written long after these mails: all of them are older than a day
    score = selection.enhanced_score(F.lit(1000.0), F.col("addressed_to_me"), F.col("n_verbs"), F.col("question"), F.col("n_dates"), F.col("importance"), F.col("flagged"), F.lit(False), F.col("sender_rank"), F.col("priority_score"), negative)
    return flat.withColumn("score", F.round(score, 6))


NOW = "2025-02-01 00:00:00"
_MAIL = f"(SELECT id, ingested_at, attachment_types, to_recipients, cc_recipients, has_attachments, subject AS mail_subject FROM ({_RANKED}) WHERE rn = 1 AND id IS NOT NULL)"
_HOURS = f"(epoch(TIMESTAMP '{NOW}') - floor(epoch(ingested_at))) / 3600.0"


def _mails(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The kept delivery of each mail by its cleaned identifier (mail_id)."""
    rows = keep_first_delivery(table(spark, d, "messages", *dict.fromkeys(["row_id", "batch_no", "msg_id", *columns])))
    return rows.select(cleaned_id("msg_id").alias("mail_id"), *columns).filter("mail_id IS NOT NULL")


@query(f"""SELECT chunk_id, round({_ENHANCED.replace("round(0.2 * 2", f"(CASE WHEN {_HOURS} < 1 THEN 1.0 WHEN {_HOURS} < 6 THEN 0.8 WHEN {_HOURS} < 24 THEN 0.5 ELSE 0.2 END * 2").replace(", 6)", ")")} + CASE WHEN len(list_filter(coalesce(attachment_types, []), lambda x: lower(x) IN ('pdf', 'doc', 'docx', 'xlsx', 'xls', 'ppt', 'pptx'))) > 0 THEN 1 ELSE 0 END, 6) AS score, CASE WHEN sender_rank >= 2 THEN 'critical' WHEN n_dates > 0 THEN 'dates' WHEN coalesce(addressed_to_me, false) THEN 'addressed' ELSE 'remainder' END AS bucket FROM ({_FLAGS}) f LEFT JOIN {_MAIL} m ON m.id = f.msg_id""")
def enhanced_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores with the age and the attachments of the mail behind each chunk."""
    rows = _scored(spark, d).join(_mails(spark, d, "ingested_at", "attachment_types"), F.col("msg_id") == F.col("mail_id"), "left")
    hours = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("ingested_at").cast("timestamp"))) / 3600.0
    negative = F.coalesce(F.col("sender").rlike(r"(?i)\b(noreply@|no-reply@|donotreply@)|\bpostmaster@"), F.lit(False))
    score = selection.enhanced_score(hours, F.col("addressed_to_me"), F.col("n_verbs"), F.col("question"), F.col("n_dates"), F.col("importance"), F.col("flagged"), selection.has_documents(F.col("attachment_types")), F.col("sender_rank"), F.col("priority_score"), negative)
    return rows.select("chunk_id", F.round(score, 6).alias("score"), selection.bucket_of(F.col("sender_rank"), F.col("n_dates"), F.col("addressed_to_me")).alias("bucket"))


@query(f"""SELECT conversation_id, chunk_id, CAST(CASE WHEN s <= 900 THEN t ELSE 900 - (s - t) END AS BIGINT) AS kept_tokens FROM (SELECT conversation_id, chunk_id, coalesce(token_count, 0) AS t, sum(coalesce(token_count, 0)) OVER (PARTITION BY conversation_id ORDER BY priority_score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS s FROM ({_FLAGS}) WHERE conversation_id IS NOT NULL) WHERE s <= 900 OR 900 - (s - t) >= 64""")
def token_budgets(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter("conversation_id IS NOT NULL")
    return evidence.within_budget(rows, "conversation_id", "priority_score", "token_count", "chunk_id", 900).select("conversation_id", "chunk_id", "kept_tokens")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the digest runs: one run per mailbox and day."""
    mails = keep_first_delivery(table(spark, d, "messages", "row_id", "batch_no", "msg_id", "mailbox_id", "ingested_at")).select(cleaned_id("msg_id").alias("msg_id"), F.concat_ws("@", F.to_date("ingested_at").cast("string"), F.col("mailbox_id").cast("string")).alias("run")).filter("msg_id IS NOT NULL")
    return _scored(spark, d).join(mails, "msg_id")


@query()
def bucket_selection(spark: SparkSession, d: str) -> DataFrame:
    """Chosen evidence of every run; a fold that SQL does not express, tested against its invariants."""
    return selection.selected(_runs(spark, d), "run", "evidence_id", "conversation_id", "score")


@query()
def bucket_selection_shrunk(spark: SparkSession, d: str) -> DataFrame:
    return selection.selected(_runs(spark, d), "run", "evidence_id", "conversation_id", "score", shrink_to=1500)


@query()
def selection_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the selection of every run."""
    runs = _runs(spark, d)
    return selection.selection_metrics(runs, selection.selected(runs, "run", "evidence_id", "conversation_id", "score"), "run", "evidence_id", "conversation_id")


@query()
def sentence_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages", "row_id", "text_body").filter("text_body IS NOT NULL")
    return actions.actions(rows, "row_id", "text_body", signals.mention_aliases(ALIASES))


@query()
def actions_backed(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).select(F.col("msg_id").alias("id"), "evidence_id", "chunk_idx", "content")
    mails = keep_first_delivery(table(spark, d, "messages", "row_id", "batch_no", "msg_id", "text_body")).withColumn("id", cleaned_id("msg_id")).filter("text_body IS NOT NULL AND id IS NOT NULL")
    return actions.backed(actions.actions(mails, "id", "text_body", signals.mention_aliases(ALIASES)), rows, "id")


@query()
def action_confidences(spark: SparkSession, d: str) -> DataFrame:
    """Confidence that a chunk asks for something, from all six features; tested against a plain reading of the rule."""
    t = F.col("content")
    has = lambda *p: F.greatest(*[t.rlike(x) for x in p], F.lit(False))
    mention = F.coalesce(F.col("addressed_to_me"), F.lit(False)) | actions.mentions(t, signals.mention_aliases(ALIASES))
    c = signals.action_confidence(mention, has(signals.IMPERATIVE_RU, signals.IMPERATIVE_EN), has(signals.MARKER_RU, signals.MARKER_EN), has(signals.QUESTION), has(signals.DEADLINE), F.coalesce(F.col("signals.sender_rank"), F.lit(1)))
    return table(spark, d, "evidence_chunks").filter("content IS NOT NULL").select("chunk_id", F.round(c, 6).alias("confidence"))


# citations

_BODY = f"(SELECT id, text_body FROM ({_RANKED}) WHERE rn = 1 AND id IS NOT NULL)"


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return keep_first_delivery(table(spark, d, "messages", "row_id", "batch_no", "msg_id", "text_body")).select(cleaned_id("msg_id").alias("msg_id"), "text_body").filter("msg_id IS NOT NULL")


_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\p{Z}]"
#: Where the k-th word of a body begins and ends, from runs of white space and of other characters.
_PLACES = rf"""SELECT chunk_id, content, checksum, body, x, list_filter(regexp_split_to_array(content, '{_WS}+'), lambda w: w <> '') AS cw, list_filter(regexp_split_to_array(body, '{_WS}+'), lambda w: w <> '') AS bw, regexp_extract_all(body, '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\p{{Z}}]+|{_WS}+') AS runs FROM (SELECT c.chunk_id, c.content, b.text_body AS body, strpos(b.text_body, c.content) AS x, sha256(b.text_body) AS checksum FROM evidence_chunks c LEFT JOIN {_BODY} b ON b.id = c.msg_id WHERE c.content IS NOT NULL)"""


@query(rf"""SELECT chunk_id, CAST(CASE WHEN len(cw) = 0 THEN NULL WHEN x > 0 THEN x - 1 ELSE strpos(body, stretch) - 1 END AS BIGINT) AS start_at, CAST(CASE WHEN len(cw) = 0 THEN NULL WHEN x > 0 THEN x - 1 + length(content) ELSE strpos(body, stretch) - 1 + length(stretch) END AS BIGINT) AS end_at, substr(CASE WHEN len(cw) = 0 THEN NULL WHEN x > 0 THEN content ELSE stretch END, 1, 200) AS preview, checksum
FROM (SELECT *, CASE WHEN x = 0 AND len(cw) > 0 AND contains(' ' || array_to_string(bw, ' ') || ' ', array_to_string(cw, ' ')) THEN (SELECT nullif(regexp_extract(body, array_to_string(list_transform(cw, lambda w: regexp_escape(w)), '{_WS}+')), '')) END AS stretch FROM ({_PLACES}))""")
def citations_built(spark: SparkSession, d: str) -> DataFrame:
    built = citations.cited(table(spark, d, "evidence_chunks", "chunk_id", "msg_id", "content").filter("content IS NOT NULL"), _bodies(spark, d), "msg_id", "content", "text_body")
    return built.select("chunk_id", F.col("start_at").cast("bigint").alias("start_at"), F.col("end_at").cast("bigint").alias("end_at"), "preview", "checksum")


@query(f"""SELECT chunk_id, CASE WHEN b.text_body IS NULL THEN 'no body' WHEN coalesce(s < 0, true) THEN 'bad start' WHEN coalesce(e <= s, true) THEN 'bad end' WHEN e > length(b.text_body) THEN 'beyond the body' WHEN NOT coalesce(substr(substr(b.text_body, s + 1, e - s), 1, 200) = preview OR trim(regexp_replace(substr(substr(b.text_body, s + 1, e - s), 1, 200), '\\s+', ' ', 'g')) = trim(regexp_replace(preview, '\\s+', ' ', 'g')), false) THEN 'other text' END AS problem
FROM (SELECT chunk_id, msg_id, source_ref.start_at AS s, source_ref.end_at AS e, substr(content, 1, 200) AS preview FROM evidence_chunks) c LEFT JOIN {_BODY} b ON b.id = c.msg_id""")
def citations_checked(spark: SparkSession, d: str) -> DataFrame:
    """The stored places of chunks, held against the bodies."""
    given = table(spark, d, "evidence_chunks").select("chunk_id", "msg_id", F.col("source_ref.start_at").alias("start_at"), F.col("source_ref.end_at").alias("end_at"), F.substring("content", 1, citations.PREVIEW).alias("preview"), F.lit(None).cast("string").alias("checksum"))
    return citations.checked(given, _bodies(spark, d), "msg_id", "text_body").select("chunk_id", "problem")


# items, ranking, digests

_CONF = "CASE WHEN lower(trim(confidence)) IN ('high', 'высокая', 'hoch', 'alta') THEN 0.9 WHEN lower(trim(confidence)) IN ('medium', 'средняя', 'mittel', 'média', 'media', 'med') THEN 0.7 WHEN lower(trim(confidence)) IN ('low', 'низкая', 'niedrig', 'baixa') THEN 0.4 ELSE try_cast(lower(trim(confidence)) AS DOUBLE) END"
_MARK = " OR ".join(f"contains(lower(title), '{m}')" for m in ranking.MARKERS)
_ITEM = f"""SELECT a.item_id, a.digest_date, a.mailbox_id, a.title, a.description, a.due_date, a.evidence_id, {_CONF} AS confidence, coalesce({_MARK}, false) AS has_action, c.sender, c.conversation_id, c.evidence_id AS found FROM action_items a LEFT JOIN ({_FLAGS}) c ON a.evidence_id = c.evidence_id"""
_RANK = "round(least(greatest((CASE WHEN has_action THEN 0.2 ELSE 0 END + CASE WHEN due_date IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN found IS NULL THEN 0 WHEN lower(sender) = 'brucheychenko@lumenbay.example' THEN 0.1 WHEN lower(split_part(sender, '@', -1)) = 'tarnfold.test' THEN 0.08 WHEN contains(lower(split_part(sender, '@', -1)), 'saltmarsh') THEN 0.07 ELSE 0.05 END), 0), 1), 6)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "action_items", "item_id", "digest_date", "mailbox_id", "title", "description", "due_date", "evidence_id", "confidence")
    known = _scored(spark, d).select(F.col("evidence_id").alias("found"), "sender", F.col("conversation_id").alias("thread"))
    joined = items.join(known, items["evidence_id"] == F.col("found"), "left")
    importance = F.when(F.col("found").isNotNull(), ranking.sender_importance(F.col("sender"), ["brucheychenko@lumenbay.example", "@tarnfold.test", "saltmarsh"]))
    score = ranking.item_score({"has_action": ranking.has_marker(F.col("title")), "has_due_date": F.col("due_date").isNotNull(), "sender_importance": importance})
    section = F.concat_ws("@", "digest_date", F.col("mailbox_id").cast("string"))
    return joined.withColumns({"confidence": digest.confidence_number(F.col("confidence")), "has_action": ranking.has_marker(F.col("title")), "score": F.round(score, 6), "digest": section})


_ALIAS = ["brucheychenko", "velimir-drozd@tarnfold.test", "mhexley"]
_IN = "len(list_filter(coalesce({c}, []), lambda r: " + " OR ".join(f"contains(lower(r), '{a}')" for a in _ALIAS) + ")) > 0"
_MARKS = "(" + " OR ".join(f"contains(lower(coalesce({{c}}, '')), '{m}')" for m in ranking.MARKERS) + ")"
_KIND = "CASE WHEN response_channel IS NULL THEN 'item' WHEN coalesce(len(actors), 0) = 0 THEN 'mention' ELSE 'typed' END"
_AGE = "(epoch(CAST(digest_date AS TIMESTAMP)) + 86400 - floor(epoch(ingested_at))) / 3600.0"
_TEN = rf"""CASE WHEN found IS NULL THEN 0.0 ELSE least(greatest(CASE WHEN {_IN.format(c="to_recipients")} THEN 0.15 WHEN {_IN.format(c="cc_recipients")} THEN 0.05 ELSE 0.0 END + CASE WHEN kind = 'item' AND {_MARKS.format(c="title")} OR kind = 'typed' AND {_MARKS.format(c="coalesce(description, quote)")} THEN 0.2 ELSE 0.0 END + CASE WHEN kind = 'mention' THEN 0.1 ELSE 0.0 END + CASE WHEN coalesce(due_date, '') <> '' THEN 0.15 ELSE 0.0 END
+ 0.1 * CASE WHEN coalesce(sender, '') = '' THEN 0.5 WHEN lower(sender) = 'brucheychenko@lumenbay.example' THEN 1.0 WHEN lower(split_part(sender, '@', -1)) = 'tarnfold.test' THEN 0.8 WHEN contains(lower(split_part(sender, '@', -1)), 'saltmarsh') THEN 0.7 ELSE 0.5 END + 0.05 * least(coalesce(n_thread, 1) / 10.0, 1.0) + 0.1 * greatest(0.0, 1 - coalesce({_AGE}, 24.0) / 48.0)
+ CASE WHEN has_attachments THEN 0.05 ELSE 0.0 END + CASE WHEN regexp_matches(coalesce(email_subject, subject, ''), '\[(?:(?:JIRA|PROJ|TASK|BUG|TICKET)-|#)\d+\]') THEN 0.05 ELSE 0.0 END, 0.0), 1.0) END"""
_FULL = f"""SELECT a.*, {_KIND} AS kind, c.evidence_id AS found, c.sender, c.subject, n_thread, m.ingested_at, m.to_recipients, m.cc_recipients, m.has_attachments FROM action_items a LEFT JOIN (SELECT f.*, e.message_metadata.subject AS subject FROM ({_FLAGS}) f JOIN evidence_chunks e USING (chunk_id)) c ON a.evidence_id = c.evidence_id LEFT JOIN (SELECT conversation_id, count(*) AS n_thread FROM ({_FLAGS}) GROUP BY 1) t ON t.conversation_id = c.conversation_id LEFT JOIN {_MAIL} m ON m.id = c.msg_id"""


@query(f"SELECT item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY digest_date, mailbox_id ORDER BY round(score, 6) DESC, item_id) AS INTEGER) AS place FROM (SELECT item_id, digest_date, mailbox_id, {_TEN} AS score FROM ({_FULL}))")
def items_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Items of each digest by all ten features of the mail and the thread behind their evidence."""
    items = table(spark, d, "action_items", "item_id", "digest_date", "mailbox_id", "title", "description", "quote", "due_date", "evidence_id", "response_channel", "actors", "email_subject")
    chunks = _chunks(spark, d).select(F.col("evidence_id").alias("found"), "conversation_id", "msg_id", F.col("message_metadata.sender").alias("sender"), F.col("message_metadata.subject").alias("subject"))
    sizes = chunks.filter("conversation_id IS NOT NULL").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_thread"))
    mails = _mails(spark, d, "ingested_at", "to_recipients", "cc_recipients", "has_attachments")
    known = chunks.join(sizes, "conversation_id", "left").join(mails, F.col("msg_id") == F.col("mail_id"), "left")
    rows = items.join(known, items["evidence_id"] == F.col("found"), "left")
    kind = F.when(F.col("response_channel").isNull(), "item").when(F.coalesce(F.size("actors"), F.lit(0)) <= 0, "mention").otherwise("typed")
    hours = (F.unix_timestamp(F.col("digest_date").cast("timestamp")) + 86400 - F.unix_timestamp(F.col("ingested_at").cast("timestamp"))) / 3600.0
    c = {"found": F.col("found").isNotNull(), "to": F.col("to_recipients"), "cc": F.col("cc_recipients"), "title": F.col("title"), "kind": kind, "text": F.coalesce("description", "quote"), "due": F.col("due_date"), "sender": F.col("sender"), "n_thread": F.col("n_thread"), "hours_old": hours, "has_attachments": F.col("has_attachments"), "subject": F.coalesce("email_subject", "subject")}
    score = F.round(ranking.item_score(ranking.features(c, _ALIAS, ["brucheychenko@lumenbay.example", "@tarnfold.test", "saltmarsh"])), 6)
    scored = rows.select("item_id", F.concat_ws("@", "digest_date", F.col("mailbox_id").cast("string")).alias("digest"), score.alias("score"))
    return ranking.ranked(scored, "digest", "score", "item_id").select("item_id", "score", "place")


@query(f"SELECT CAST(mailbox_id AS INTEGER) AS mailbox_id, round(avg(CASE WHEN has_action THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY mailbox_id ORDER BY score DESC, item_id) AS place FROM (SELECT item_id, mailbox_id, has_action, {_RANK} AS score FROM ({_ITEM}))) WHERE place <= 10 GROUP BY 1")
def top_action_share(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_share(ranking.ranked(_items(spark, d), "mailbox_id", "score", "item_id"), "mailbox_id", "place", "has_action", 10)


@query(f"SELECT item_id FROM ({_ITEM}) WHERE trim(coalesce(title, '')) <> '' AND confidence BETWEEN 0 AND 1 AND found IS NOT NULL")
def items_valid(spark: SparkSession, d: str) -> DataFrame:
    return digest.valid_items(_items(spark, d), _chunks(spark, d)).select("item_id")


@query("SELECT item_id FROM action_items WHERE evidence_id IS NULL OR evidence_id NOT IN (SELECT evidence_id FROM evidence_chunks WHERE evidence_id IS NOT NULL AND content IS NOT NULL)")
def items_unknown_evidence(spark: SparkSession, d: str) -> DataFrame:
    return digest.unknown_evidence(table(spark, d, "action_items", "item_id", "evidence_id"), _chunks(spark, d)).select("item_id")


_CAT = "CASE WHEN n_verbs > 0 THEN CASE WHEN coalesce(addressed_to_me, false) THEN 'my_actions' ELSE 'others_actions' END WHEN n_dates > 0 THEN 'deadlines' WHEN priority_score >= 2 THEN 'risks' ELSE 'fyi' END"


@query(f"""SELECT conversation_id, category, CAST(place AS INTEGER) AS place, evidence_id, CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END AS quote FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, category ORDER BY priority_score DESC, evidence_id) AS place FROM (SELECT *, {_CAT} AS category FROM ({_FLAGS}) WHERE conversation_id IS NOT NULL)) WHERE place <= CASE category WHEN 'risks' THEN 3 WHEN 'fyi' THEN 10 ELSE 5 END""")
def extractive_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter("conversation_id IS NOT NULL").drop("score").withColumnRenamed("priority_score", "score")
    return digest.extractive(rows, "conversation_id").select("conversation_id", "category", "place", "evidence_id", "quote")


@query(f"""SELECT digest_date || '@' || mailbox_id AS digest, 'Actions' AS section, '## Actions' || chr(10) || string_agg(place || '. **' || title || '** - ' || coalesce(due_date, ''), chr(10) ORDER BY place) AS report FROM (SELECT *, row_number() OVER (PARTITION BY digest_date, mailbox_id ORDER BY score DESC, item_id) AS place FROM (SELECT item_id, digest_date, mailbox_id, coalesce(title, '') AS title, due_date, {_RANK} AS score FROM ({_ITEM}))) WHERE place <= 10 GROUP BY 1""")
def digest_reports(spark: SparkSession, d: str) -> DataFrame:
    placed = ranking.ranked(_items(spark, d), "digest", "score", "item_id").withColumns({"section": F.lit("Actions"), "title": F.coalesce("title", F.lit(""))})
    return digest.markdown(placed, "digest", "section", "place", "title", "due_date")


@query("""SELECT item_id, json_extract_string(doc, '$.title') AS title, json_extract_string(doc, '$.due_date') AS due_date, json_extract_string(doc, '$.evidence_id') AS evidence_id FROM (SELECT item_id, to_json({'title': title, 'due_date': due_date, 'evidence_id': evidence_id}) AS doc FROM action_items)""")
def digest_documents(spark: SparkSession, d: str) -> DataFrame:
    """The items of each digest as one document without null fields, read again."""
    rows = table(spark, d, "action_items", "digest_date", "mailbox_id", "item_id", "title", "due_date", "evidence_id")
    documents = digest.as_json(rows.withColumn("run", F.concat_ws("@", "digest_date", F.col("mailbox_id").cast("string"))).drop("digest_date", "mailbox_id"), "run")
    kind = "items array<struct<item_id:bigint,title:string,due_date:string,evidence_id:string>>"
    return documents.select(F.inline(F.from_json("digest", kind)["items"]))


@query()
def report_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every body in parts of at most 1,000 characters; tested for size and for nothing lost."""
    parts = table(spark, d, "messages", "row_id", "text_body").filter("text_body IS NOT NULL").select("row_id", digest.parts_column(F.col("text_body"), 1000).alias("p"))
    return parts.select("row_id", F.posexplode("p").alias("part_no", "part"))


@query("SELECT mailbox_id, count(*) AS n_items, count(DISTINCT evidence_id) AS n_evidence, CAST(floor(sum(CASE WHEN due_date IS NOT NULL THEN 1 ELSE 0 END) * 100 / count(*)) AS INTEGER) AS percent_due FROM action_items GROUP BY 1")
def item_summaries(spark: SparkSession, d: str) -> DataFrame:
    return digest.summary_counts(table(spark, d, "action_items", "mailbox_id", "evidence_id", "due_date"), "mailbox_id")


_ISSUES = f"""SELECT digest, item_id, unnest(list_filter([
CASE WHEN trim(coalesce(evidence_id, '')) = '' THEN 'error:evidence_id missing' END, CASE WHEN trim(coalesce(evidence_id, '')) <> '' AND found IS NULL THEN 'error:evidence_id unknown' END,
CASE WHEN confidence IS NULL THEN 'error:confidence missing' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'error:confidence out of range' END, CASE WHEN confidence BETWEEN 0 AND 1 AND confidence < 0.5 THEN 'warn:confidence low' END,
CASE WHEN confidence BETWEEN 0.5 AND 1 AND confidence < 0.7 AND has_action THEN 'warn:confidence low for an action' END, CASE WHEN t IS NOT NULL AND rn > 1 THEN 'warn:title repeated' END,
CASE WHEN due_date IS NOT NULL AND NOT regexp_matches(due_date, '^(?:today|tomorrow|\\d{{4}}-\\d{{2}}-\\d{{2}})$') THEN 'warn:due date form' END], lambda x: x IS NOT NULL)) AS issue
FROM (SELECT *, row_number() OVER (PARTITION BY digest, t ORDER BY item_id) AS rn FROM (SELECT *, digest_date || '@' || mailbox_id AS digest, nullif(lower(trim(title)), '') AS t FROM ({_ITEM})))"""


def _issues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = _items(spark, d).select("digest", "item_id", "title", "evidence_id", "confidence", "has_action", F.col("due_date").alias("due"))
    return items, evaluation.issues(items, _chunks(spark, d), "digest", "item_id", F.col("has_action"))


@query(f"""SELECT digest, item_id, split_part(issue, ':', 1) AS severity, split_part(issue, ':', 2) AS "check" FROM ({_ISSUES})""")
def digest_issues(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d)[1]


@query(f"""SELECT n.digest, n_items, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, n_items - coalesce(b, 0) AS clean_items, s AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' ELSE 'D' END AS grade, round((n_items - coalesce(b, 0)) / n_items, 3) AS quality_rate FROM (SELECT a.digest, n_items, e, w, b, greatest(0, 100 - 10 * coalesce(e, 0) - 3 * coalesce(w, 0)) AS s FROM (SELECT digest_date || '@' || mailbox_id AS digest, count(*) AS n_items FROM action_items GROUP BY 1) a LEFT JOIN (SELECT digest, CAST(sum(CASE WHEN issue LIKE 'error%' THEN 1 ELSE 0 END) AS BIGINT) AS e, CAST(sum(CASE WHEN issue LIKE 'warn%' THEN 1 ELSE 0 END) AS BIGINT) AS w, count(DISTINCT CASE WHEN issue LIKE 'error%' THEN item_id END) AS b FROM ({_ISSUES}) GROUP BY 1) i ON a.digest = i.digest) n""")
def digest_grades(spark: SparkSession, d: str) -> DataFrame:
    items, found = _issues(spark, d)
    return evaluation.graded(items, found, "digest", "item_id")


# hierarchy


@query(f"SELECT count(*) AS threads, CAST(sum(n_messages) AS BIGINT) AS messages, count(*) >= 6 AND (count(*) >= 40 OR sum(n_messages) >= 200) AS hierarchical FROM ({_SUMMARY})")
def hierarchy_gate(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.gate(threads.thread_summary(_threaded(spark, d), "thread", "ingested_at", "sender_email"))


@query(f"SELECT conversation_id, count(*) AS n_chunks FROM ({_FLAGS}) WHERE conversation_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def threads_to_summarise(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.qualifying(_scored(spark, d).filter("conversation_id IS NOT NULL"), "conversation_id")


@query(f"SELECT conversation_id, count(*) AS n_chunks FROM ({_FLAGS}) WHERE conversation_id IS NOT NULL GROUP BY 1 HAVING count(*) < 3")
def threads_read_directly(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter("conversation_id IS NOT NULL")
    return rows.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_chunks")).join(hierarchy.qualifying(rows, "conversation_id").select("conversation_id"), "conversation_id", "left_anti")


_TO_READ = f"""WITH c AS (SELECT * FROM ({_FLAGS}) WHERE conversation_id IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY priority_score DESC, chunk_id) AS r, row_number() OVER (PARTITION BY conversation_id ORDER BY chunk_idx DESC, chunk_id DESC) AS l FROM c), m AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY priority_score DESC, chunk_id) AS mr FROM c WHERE coalesce(addressed_to_me, false)),
must AS (SELECT conversation_id, chunk_id, min(reason) AS reason FROM (SELECT conversation_id, chunk_id, 'latest' AS reason FROM b WHERE l = 1 UNION ALL SELECT conversation_id, chunk_id, 'mention' FROM m WHERE mr <= 11) GROUP BY 1, 2), n AS (SELECT conversation_id, count(*) AS k FROM must GROUP BY 1),
o AS (SELECT b.conversation_id, b.chunk_id, row_number() OVER (PARTITION BY b.conversation_id ORDER BY b.r) AS p FROM b ANTI JOIN must USING (conversation_id, chunk_id) WHERE b.r <= 20)
SELECT conversation_id, chunk_id, reason FROM must UNION ALL SELECT o.conversation_id, o.chunk_id, 'score' FROM o JOIN n USING (conversation_id) WHERE p <= greatest(0, 8 - k)"""


@query(_TO_READ)
def chunks_to_read(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter("conversation_id IS NOT NULL")
    return hierarchy.must_include(rows, "conversation_id", "chunk_id", "priority_score", "chunk_idx", "addressed_to_me")


@query(rf"""SELECT conversation_id, string_agg('- ' || substr(regexp_replace(content, '[\s\x{{0b}}]+', ' ', 'g'), 1, 150), chr(10) ORDER BY chunk_id) AS prompt FROM ({_TO_READ}) JOIN evidence_chunks USING (conversation_id, chunk_id) GROUP BY 1""")
def thread_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).filter("conversation_id IS NOT NULL")
    picked = hierarchy.must_include(rows, "conversation_id", "chunk_id", "priority_score", "chunk_idx", "addressed_to_me")
    return hierarchy.thread_text(picked.join(rows.select("chunk_id", "content"), "chunk_id"), "conversation_id", "chunk_id", "content")


# sources and streams


@query(r"""SELECT row_id, coalesce(nullif(trim(lower(coalesce(nullif(trim(sender_email), ''), nullif(trim(from_email), '')))), ''), NULL) AS sender_email, array_to_string(list_transform(coalesce(to_recipients, []), lambda x: lower(trim(x))), '|') AS recipients, upper(substr(coalesce(nullif(trim(importance), ''), 'Normal'), 1, 1)) || lower(substr(coalesce(nullif(trim(importance), ''), 'Normal'), 2)) AS importance FROM messages""")
def canonical_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshots.canonical(table(spark, d, "messages"))
    return rows.select("row_id", "sender_email", F.array_join("to_recipients", "|").alias("recipients"), "importance")


@query("SELECT m.row_id FROM messages m JOIN mailboxes b USING (mailbox_id) WHERE m.ingested_at >= timezone('UTC', timezone(b.mailbox_tz, TIMESTAMP '2025-01-15 00:00:00')) AND m.ingested_at < timezone('UTC', timezone(b.mailbox_tz, TIMESTAMP '2025-02-15 00:00:00'))")
def messages_of_days(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "mailboxes", "mailbox_id", "mailbox_tz")
    start, _ = snapshots.time_window(F.lit("2025-01-15"), F.col("mailbox_tz"))
    _, end = snapshots.time_window(F.lit("2025-02-14"), F.col("mailbox_tz"))
    at = F.col("ingested_at").cast("timestamp")
    # no zone is a day from UTC: plain bounds reach the scan, the exact ones are those of each mailbox
    near = table(spark, d, "messages", "row_id", "mailbox_id", "ingested_at").filter("ingested_at >= TIMESTAMP_NTZ '2025-01-14 00:00:00' AND ingested_at < TIMESTAMP_NTZ '2025-02-16 00:00:00'")
    return near.join(boxes, "mailbox_id").filter((at >= start) & (at < end)).select("row_id")


@query("SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n_events FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    out = mail.sessions(rows, "user_id", "ts")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n_events FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_type", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    return mail.hourly(rows, "event_type", "ts").select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "n_events")


