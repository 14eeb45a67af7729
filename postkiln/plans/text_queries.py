"""Queries of the text operators over the message and digest tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkiln.functions import cleaner, html, lemmas, lines, quotes, signals
from postkiln.functions import text as tx
from postkiln.operators.evidence import aliases_matched
from postkiln.sources.tables import table

AS_OF = "2025-12-31 00:00:00"
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


@query(r"""SELECT row_id, trim(regexp_replace(text_body, '\s+', ' ', 'g'), ' ') AS one_line,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text_body, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\n ]+|[\n ]+$', '', 'g') AS tidy FROM messages""")
def text_tidy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages", "row_id", "text_body").select("row_id", tx.one_line(F.col("text_body")).alias("one_line"), tx.tidy_lines(F.col("text_body")).alias("tidy"))


@query(r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 13 // 10 AS INTEGER) AS tokens, CAST(length(text) // 4 AS INTEGER) AS tokens_by_chars FROM documents""")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), tx.char_token_estimate(F.col("text")).alias("tokens_by_chars"))


_SUBJECT_SQL = r"""lower(trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(subject), '(?i)^(?:(?:re|fwd?|ответ|отв|пересл|пер)(?:\[\d+\])?:\s*)+', ''), '(?i)[(\[](?:external|внешний)[)\]]', '', 'g'), '\[[^\]]{1,50}\]|\([^)]{1,50}\)', '', 'g'), '[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F190}-\x{1F1FF}\x{2600}-\x{27BF}\x{1F900}-\x{1F9FF}]+', '', 'g'), '[«»“”„]', '"', 'g'), '‘’—–', '''''--'), '\s+', ' ', 'g')))"""


@query(f"SELECT row_id, nfc_normalize({_SUBJECT_SQL}) AS subject_key FROM messages WHERE subject IS NOT NULL")
def subject_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages", "row_id", "subject").filter("subject IS NOT NULL").select("row_id", tx.composed_subject_key(F.col("subject")).alias("subject_key"))


@query("SELECT item_id, CASE WHEN rank_score >= 0.9 THEN 'very high' WHEN rank_score >= 0.7 THEN 'high' WHEN rank_score >= 0.5 THEN 'medium' WHEN rank_score >= 0.3 THEN 'low' ELSE 'very low' END AS label FROM action_items")
def confidence_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "action_items", "item_id", "rank_score").select("item_id", tx.confidence_label(F.col("rank_score")).alias("label"))


@query(r"""SELECT doc_id, CASE WHEN len(w) <= 40 THEN text ELSE array_to_string(w[1:30], ' ') || ' [cut]' END AS short FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE text IS NOT NULL""")
def word_limits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", tx.limit_words(F.col("text"), 40, 30, "[cut]").alias("short"))


@query(r"""SELECT row_id, regexp_replace(regexp_replace(regexp_replace(text_body, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[[REDACTED]]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[[REDACTED]]', 'g'), '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b', '[[REDACTED]]', 'g') AS redacted FROM messages WHERE text_body IS NOT NULL""")
def redacted_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages", "row_id", "text_body").filter("text_body IS NOT NULL").select("row_id", tx.redact(F.col("text_body")).alias("redacted"))


@query("SELECT login, domain, count(*) AS n FROM (SELECT lower(split_part(sender_email, '@', 1)) AS login, CASE WHEN contains(sender_email, '@') THEN lower(split_part(sender_email, '@', -1)) END AS domain FROM messages WHERE sender_email IS NOT NULL) GROUP BY ALL")
def sender_logins(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sender_email")
    return table(spark, d, "messages", "sender_email").filter(s.isNotNull()).groupBy(tx.login_of(s).alias("login"), tx.domain_of(s).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""SELECT chunk_id, array_to_string(list_filter({_list(signals.ACTION_WORDS_RU + signals.ACTION_WORDS_EN)}, lambda w: regexp_matches(lower(content), '{_B}' || w || '{_E}')), '|') AS words FROM evidence_chunks WHERE content IS NOT NULL""")
def action_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_chunks", "chunk_id", "content").filter("content IS NOT NULL").select("chunk_id", F.array_join(signals.action_words(F.col("content")), "|").alias("words"))


_RU = r"январ[ья]|феврал[ья]|марта|апрел[ья]|ма[яй]|июн[ья]|июл[ья]|августа?|сентябр[ья]|октябр[ья]|ноябр[ья]|декабр[ья]"
_RU_DATES = rf"regexp_extract_all(content, '(?i)(?:^|[^\p{{L}}\p{{N}}_])((?:до|к|не позднее)\s+\d{{1,2}}\s+(?:{_RU}))(?:$|[^\p{{L}}\p{{N}}_])', 1)"


@query(rf"""SELECT chunk_id, array_to_string(list_concat(list_concat(list_concat(regexp_extract_all(content, '\b\d{{1,2}}[./]\d{{1,2}}[./]\d{{2,4}}\b'), regexp_extract_all(content, '\b\d{{4}}-\d{{2}}-\d{{2}}\b')), list_transform(list_filter(list_zip(range(len(r)), r), lambda z: NOT list_contains(r[1:z[1]], z[2])), lambda z: z[2])), list_filter({_list(signals.RELATIVE_DAYS)}, lambda w: contains(lower(content), w))), '|') AS dates
FROM (SELECT *, list_transform({_RU_DATES}, lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS r FROM evidence_chunks WHERE content IS NOT NULL)""")
def chunk_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence_chunks", "chunk_id", "content").filter("content IS NOT NULL")
    return rows.select("chunk_id", F.array_join(signals.dates_found(F.col("content")), "|").alias("dates"))


@query(r"""SELECT row_id, contains(text_body, '?') AS question, coalesce(regexp_matches(coalesce(sender_email, '') || ' ' || coalesce(subject, '') || ' ' || coalesce(text_body, ''), '(?i)(\b(noreply@|no-reply@|donotreply@)|(^|[^\p{L}\p{N}_])(unsubscribe|отписаться)($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])(auto-submitted|автоответ)($|[^\p{L}\p{N}_])|\bpostmaster@|(^|[^\p{L}\p{N}_])(delivery status|статус доставки)($|[^\p{L}\p{N}_])|\b(out of office|auto-reply|automatic reply)\b)'), false) AS negative FROM messages WHERE text_body IS NOT NULL""")
def question_and_negative(spark: SparkSession, d: str) -> DataFrame:
    everything = F.concat_ws(" ", F.coalesce("sender_email", F.lit("")), F.coalesce("subject", F.lit("")), F.coalesce("text_body", F.lit("")))
    return table(spark, d, "messages", "row_id", "sender_email", "subject", "text_body").filter("text_body IS NOT NULL").select("row_id", signals.has_question(F.col("text_body")).alias("question"), signals.is_negative(everything).alias("negative"))


_SCORE = " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1.0 ELSE 0.0 END" for w in signals.PRIORITY_WORDS)


@query(rf"""SELECT row_id, round({_SCORE} + CASE WHEN regexp_matches(low, '\b\d{{1,2}}[./]\d{{1,2}}[./]\d{{2,4}}\b') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(low, '\b\d{{4}}-\d{{2}}-\d{{2}}\b') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(low, '{_B}(today|tomorrow|yesterday|сегодня|завтра|вчера){_E}') THEN 0.5 ELSE 0 END
+ CASE WHEN contains(low, '?') THEN 0.5 ELSE 0 END + CASE WHEN contains(low, '!') THEN 0.3 ELSE 0 END + CASE WHEN h < 1 THEN 2.0 WHEN h < 6 THEN 1.0 WHEN h < 24 THEN 0.5 ELSE 0 END, 6) AS score
FROM (SELECT row_id, lower(text_body) AS low, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ingested_at))) / 3600.0 AS h FROM messages WHERE text_body IS NOT NULL)""")
def base_scores(spark: SparkSession, d: str) -> DataFrame:
    hours = (F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.col("ingested_at").cast("timestamp"))) / 3600.0
    return table(spark, d, "messages", "row_id", "text_body", "ingested_at").filter("text_body IS NOT NULL").select("row_id", F.round(signals.base_score(F.col("text_body"), hours), 6).alias("score"))


@query(r"""SELECT row_id, CAST(i AS INTEGER) AS sentence_no, s[i + 1] AS sentence FROM (SELECT row_id, s, unnest(range(len(s))) AS i FROM (SELECT row_id, list_filter(string_split(regexp_replace(regexp_replace(text_body, '([.!?])\s+([A-ZА-ЯЁ])', '\1' || chr(1) || '\2', 'g'), '([.!?])\n+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) >= 10) AS s FROM messages WHERE text_body IS NOT NULL))""")
def body_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages", "row_id", "text_body").filter("text_body IS NOT NULL").select("row_id", F.posexplode(signals.sentences(F.col("text_body"))).alias("sentence_no", "sentence"))


def _cut_sql(pattern: str, guard: bool) -> str:
    hit = "p IS NOT NULL" + (f" AND length(array_to_string(l[p:], chr(10))) <= {lines.LONGEST}" if guard else "")
    return rf"""CASE WHEN {hit} THEN array_to_string(l[1:p - 1], chr(10)) ELSE text_body END AS kept, CASE WHEN {hit} THEN array_to_string(l[p:], chr(10)) END AS removed
FROM (SELECT row_id, text_body, l, list_position(list_transform(l, lambda x: regexp_matches(x, '{pattern}')), true) AS p FROM (SELECT row_id, text_body, string_split(text_body, chr(10)) AS l FROM messages WHERE text_body IS NOT NULL))"""


def _lines_query(name: str, cut, pattern: str, guard: bool) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        kept, removed = cut(F.col("text_body"))
        return table(spark, d, "messages", "row_id", "text_body").filter("text_body IS NOT NULL").select("row_id", kept.alias("kept"), removed.alias("removed"))

    QUERIES[name] = run
    SQL[name] = "SELECT row_id, " + _cut_sql(pattern.replace("(?iu)", "(?i)"), guard)


_lines_query("cut_signatures", lines.cut_signature, lines.SIGNATURE, False)
_lines_query("cut_disclaimers", lines.cut_disclaimer, lines.DISCLAIMER, True)
_lines_query("cut_quotes", lines.cut_quote, lines.QUOTE_HEAD, True)


@query(r"""SELECT row_id, array_to_string(list_filter(string_split(text_body, chr(10)), lambda x: NOT regexp_matches(x, '^\d\d:\d\d:\d\d (DEBUG|INFO|WARN) ')), chr(10)) AS kept FROM messages WHERE text_body IS NOT NULL""")
def blacklisted_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages", "row_id", "text_body").filter("text_body IS NOT NULL").select("row_id", lines.drop_lines(F.col("text_body"), r"^\d\d:\d\d:\d\d (DEBUG|INFO|WARN) ").alias("kept"))


@query(r"""SELECT row_id, regexp_replace(text_body, '""" + lines.AUTORESPONSE.replace("(?iu)(?m)", "(?im)") + r"""', '', 'g') AS kept FROM messages WHERE text_body IS NOT NULL""")
def autoresponses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages", "row_id", "text_body").filter("text_body IS NOT NULL").select("row_id", lines.drop_autoresponse(F.col("text_body")).alias("kept"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(range(len(l)), lambda i: CASE WHEN regexp_matches(l[i + 1], '^#{1,6}\s|^[\p{Lu}][\p{Lu}\s]{3,}:?\s*$|^\s*\d+[.)]\s|^(?:From|To|Subject|Date|От|Кому|Тема|Дата):|^\s*(?:-{3,}|={3,}|\*{3,})\s*$') THEN i END), lambda i: i IS NOT NULL), ',') AS breaks FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)""")
def document_breaks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.array_join(lines.structural_breaks(F.col("text")).cast("array<string>"), ",").alias("breaks"))


ALIASES = ["brucheychenko@lumenbay.example", "velimir-drozd@tarnfold.test", "mhexley-marr@pewterly.invalid", "garrin-mctar@wrenbox.example"]


@query(f"""SELECT row_id, array_to_string(m, '|') AS matched FROM (SELECT row_id, list_filter({_list(ALIASES)}, lambda a: list_contains(list_transform(list_concat(coalesce(to_recipients, []), coalesce(cc_recipients, [])), lambda x: lower(x)), a)) AS m FROM messages) WHERE len(m) > 0""")
def addressed_to_me(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages", "row_id", "to_recipients", "cc_recipients").select("row_id", aliases_matched(F.col("to_recipients"), F.col("cc_recipients"), ALIASES).alias("m"))
    return rows.filter(F.size("m") > 0).select("row_id", F.array_join("m", "|").alias("matched"))


_EN, _RU_BASE = _list(lemmas.EN_BASE), _list(lemmas.RU_BASE)
#: Endings of Russian forms and what stands there in the base form, in the order in which they are tried.
_ENDINGS = [("йте", "ть"), ("йте", "ать"), ("й", "ть"), ("й", "ать"), ("уйте", "овать"), ("уй", "овать"), ("ите", "ить"), ("ите", "еть"), ("ите", "ать"), ("и", "ить"), ("и", "еть"), ("и", "ать"), ("ил", "ить"), ("ила", "ить"), ("или", "ить"), ("ал", "ать"), ("ала", "ать"), ("али", "ать"), ("ить", "ить"), ("вьте", "вить"), ("вь", "вить"), ("рьте", "рить"), ("рь", "рить"), ("тьте", "тить"), ("ть", "тить")]
_TRIES_RU = "[" + ", ".join(f"CASE WHEN w LIKE '%{e}' AND length(w) > {len(e) + 1} THEN w[:-{len(e) + 1}] || '{b}' END" for e, b in _ENDINGS) + "]"
_TRIES_EN = """list_concat(list_concat(list_concat(list_concat(CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN [w[:-4], w[:-4] || 'e', w[:-5]] ELSE [] END, CASE WHEN w LIKE '%ied' OR w LIKE '%ies' THEN [w[:-4] || 'y'] ELSE [] END), CASE WHEN w LIKE '%ed' AND length(w) > 4 THEN [w[:-3], w[:-2], w[:-4]] ELSE [] END), CASE WHEN w LIKE '%es' THEN [w[:-3], w[:-2]] ELSE [] END), CASE WHEN w LIKE '%s' THEN [w[:-2]] ELSE [] END)"""


_LEMMA = f"""coalesce(CASE w WHEN 'sent' THEN 'send' WHEN 'met' THEN 'meet' WHEN 'пришлите' THEN 'прислать' WHEN 'пришли' THEN 'прислать' WHEN 'рассмотрите' THEN 'рассмотреть' WHEN 'рассмотри' THEN 'рассмотреть' WHEN 'закройте' THEN 'закрыть' WHEN 'закрой' THEN 'закрыть' END, CASE WHEN list_contains({_EN}, w) OR list_contains({_RU_BASE}, w) THEN w END,
list_filter({_TRIES_EN}, lambda x: list_contains({_EN}, x))[1], list_filter({_TRIES_RU}, lambda x: x IS NOT NULL AND list_contains({_RU_BASE}, x))[1], w)"""


@query(f"""SELECT {_LEMMA} AS lemma, CAST(sum(k) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(translate(text, 'İ', 'i')), '[\\p{{L}}]+')) AS w, count(*) AS k FROM documents GROUP BY 1) GROUP BY 1""")
def lemma_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lemmas of all tokens of documents; forms are counted before they are read."""
    tokens = table(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all(F.lower(F.translate("text", "İ", "i")), F.lit(r"(\p{L}+)"), F.lit(1))).alias("form"))
    return tokens.groupBy("form").agg(F.count(F.lit(1)).alias("k")).groupBy(lemmas.lemma_of(F.col("form")).alias("lemma")).agg(F.sum("k").alias("n"))


@query(f"""SELECT lemma, list_sort(list(w)) AS forms, CAST(sum(k) AS BIGINT) AS n FROM (SELECT w, k, {_LEMMA} AS lemma FROM (SELECT unnest(regexp_extract_all(lower(translate(text, 'İ', 'i')), '[\\p{{L}}]+')) AS w, count(*) AS k FROM documents GROUP BY 1)) WHERE list_contains({_EN}, lemma) OR list_contains({_RU_BASE}, lemma) GROUP BY 1""".replace("list_sort(list(w)) AS forms", "array_to_string(list_sort(list(w)), '|') AS forms"))
def lemma_forms(spark: SparkSession, d: str) -> DataFrame:
    """The forms of each known base that documents hold."""
    tokens = table(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all(F.lower(F.translate("text", "İ", "i")), F.lit(r"(\p{L}+)"), F.lit(1))).alias("form"))
    return lemmas.known_forms(tokens, "form").withColumn("forms", F.array_join("forms", "|"))


@query(f"""SELECT item_id, coalesce(string_agg({_LEMMA}, ' ' ORDER BY i), CASE WHEN any_value(title) IS NOT NULL THEN '' END) AS lemmas FROM (SELECT item_id, title, i, lower(w0) AS w FROM (SELECT item_id, title, unnest(range(len(t))) AS i, unnest(t) AS w0 FROM (SELECT item_id, title, CASE WHEN len(t0) > 0 THEN t0 ELSE [NULL] END AS t FROM (SELECT item_id, title, list_filter(list_transform(regexp_split_to_array(coalesce(title, ''), '[\\s\\x{{85}}\\x{{a0}}\\p{{Z}}]+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}_-]', '', 'g')), lambda x: x <> '') AS t0 FROM action_items)))) GROUP BY item_id""")
def title_lemmas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "action_items", "item_id", "title").select("item_id", F.array_join(lemmas.lemmas_of_phrase(F.col("title")), " ").alias("lemmas"))


@query(r"""SELECT item_id, '- ' || trim(regexp_replace(title, '[\s\x{85}\x{a0}\p{Z}]+', ' ', 'g')) || chr(10) || '- ' || digest_date AS page_text FROM action_items WHERE trim(regexp_replace(coalesce(title, ''), '[\s\x{85}\x{a0}\p{Z}]+', ' ', 'g')) <> ''""")
def html_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "action_items", "item_id", "title", "digest_date").filter(F.coalesce(F.col("title"), F.lit("")).rlike(r"(?U)\S"))
    escaped = F.replace(F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>x</title><style>p{}</style></head><body><div style='display: none'>hidden</div><ul><li>"), escaped, F.lit("</li><li> </li><li><b>"), F.col("digest_date"), F.lit("</b></li></ul><img src='cid:1' width=1 height=1></body></html>"))
    return rows.select("item_id", html.html_to_text(page).alias("page_text"))


@query()
def quotes_removed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages", "row_id", "text_body").select("row_id", quotes.quotes_removed(F.col("text_body")).alias("kept"))


@query("""SELECT event_id, CAST(json_extract_string(regexp_replace(regexp_extract('```json' || chr(10) || props || chr(10) || '```', '(?s)(\\{.*\\})', 1), ',\\s*([}\\]])', '\\1', 'g'), '$.k') AS BIGINT) AS k FROM events""")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events", "event_id", "props").select("event_id", F.get_json_object(tx.json_part(fenced), "$.k").cast("bigint").alias("k"))


@query(r"""SELECT m.row_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS likeness FROM (
SELECT row_id, CASE WHEN length(s) >= 3 THEN list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) ELSE [] END AS a, CASE WHEN length(n) >= 3 THEN list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))) ELSE [] END AS b
FROM (SELECT row_id, lower(substr(subject, 1, 200)) AS s, lower(substr(text_body, 1, 200)) AS n FROM messages WHERE subject IS NOT NULL AND text_body IS NOT NULL)) m""")
def subject_body_likeness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages", "row_id", "subject", "text_body").filter("subject IS NOT NULL AND text_body IS NOT NULL")
    sets = rows.select("row_id", tx.trigrams(F.col("subject")).alias("a"), tx.trigrams(F.col("text_body")).alias("b"))
    return sets.select("row_id", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("likeness"))


@query("""SELECT row_id, CASE WHEN strlen(text_body) <= 3000 THEN text_body ELSE left(text_body, list_max(list_filter(range(750, 3001), lambda k: strlen(left(text_body, k)) <= 3000))) || chr(10) || '[TRUNCATED]' END AS short FROM messages""")
def truncated_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages", "row_id", "text_body").select("row_id", tx.truncate_bytes(F.col("text_body"), 3000).alias("short"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN s <> '' THEN s WHEN w <> '' THEN w || '...' ELSE substr(text, 1, 297) || '...' END AS short FROM (SELECT doc_id, text, regexp_extract(substr(text, 1, 300), '(?s)^(.*[.!?…])(?:\s|$)', 1) AS s, regexp_extract(substr(text, 1, 297), '(?s)^(.*[^\s\x0b])[\s\x0b]+[^\s\x0b]*$', 1) AS w FROM documents WHERE text IS NOT NULL)""")
def sentence_cuts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", tx.cut_at_sentence(F.col("text"), 300).alias("short"))


_PLAIN = 'translate(text, \'“”‘’„‚«»–−\' || chr(160) || chr(8194) || chr(8195) || chr(8201) || chr(8239), \'""\'\'\'\'"\'\'""--     \')'


@query(f"SELECT doc_id, nfc_normalize(replace(replace(replace(replace(replace({_PLAIN}, '—', '--'), '―', '--'), chr(8203), ''), chr(65279), ''), '…', '...')) AS plain FROM documents")
def composed_text(spark: SparkSession, d: str) -> DataFrame:
    """Typography made plain and canonically composed."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.nfc(tx.plain_punctuation(F.col("text"))).alias("plain"))


# the composed cleaner

_BLACKLIST = [r"^\d\d:\d\d:\d\d (?:DEBUG|INFO|WARN) "]


def _sql(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


_TAIL = "length(array_to_string({l}[p:], chr(10)))"
_CLEAN = rf"""WITH t0 AS (SELECT row_id, regexp_replace(text_body, '\r\n?', chr(10), 'g') AS t FROM messages WHERE text_body IS NOT NULL),
t1 AS (SELECT row_id, regexp_replace(t, '{_sql(lines.AUTORESPONSE).replace("(?i)(?m)", "(?im)")}', '', 'g') AS t, list_sum(list_transform(list_filter(regexp_extract_all(t, '{_sql(lines.AUTORESPONSE).replace("(?i)(?m)", "(?im)")}'), lambda x: x <> ''), lambda x: length(x))) AS gone FROM t0),
d0 AS (SELECT *, string_split(t, chr(10)) AS l FROM t1), d1 AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(trim(l[i]), '{_sql(lines.DISCLAIMER)}') AND length(array_to_string(l[CASE WHEN i > 1 AND trim(l[i - 1]) IN ('---', '--') THEN i - 1 ELSE i END:], chr(10))) <= {lines.LONGEST})[1] AS i FROM d0),
d2 AS (SELECT *, CASE WHEN i > 1 AND trim(l[i - 1]) IN ('---', '--') THEN i - 1 ELSE i END AS p FROM d1), t2 AS (SELECT row_id, gone, CASE WHEN p IS NULL THEN t ELSE rtrim(array_to_string(l[1:p - 1], chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS t, CASE WHEN p IS NOT NULL THEN {_TAIL.format(l="l")} END AS notice FROM d2),
s0 AS (SELECT *, string_split(t, chr(10)) AS l FROM t2), s1 AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(trim(x), '{_sql(lines.SIGNATURE)}')), true) AS p FROM s0), t3 AS (SELECT row_id, gone, notice, CASE WHEN p IS NULL THEN t ELSE rtrim(array_to_string(l[1:p - 1], chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS t, CASE WHEN p IS NOT NULL THEN {_TAIL.format(l="l")} END AS signed FROM s1),
q0 AS (SELECT *, string_split(t, chr(10)) AS l FROM t3), q1 AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(ltrim(x), '{_sql(lines.QUOTE_HEAD)}')), true) AS p FROM q0), t4 AS (SELECT row_id, gone, notice, signed, CASE WHEN p IS NULL OR {_TAIL.format(l="l")} > {lines.LONGEST} THEN t ELSE rtrim(array_to_string(l[1:p - 1], chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS t, CASE WHEN p IS NOT NULL AND {_TAIL.format(l="l")} <= {lines.LONGEST} THEN {_TAIL.format(l="l")} END AS quoted FROM q1),
t5 AS (SELECT row_id, gone, notice, signed, quoted, t AS t0, list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '(?i){_BLACKLIST[0]}')) AS k, string_split(t, chr(10)) AS l FROM t4), t6 AS (SELECT row_id, gone, notice, signed, quoted, CASE WHEN len(k) < len(l) THEN rtrim(array_to_string(k, chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE t0 END AS t, len(l) - len(k) AS listed FROM t5)
SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\n ]+|[\n ]+$', '', 'g') AS clean, concat_ws('|', 'autoresponse:' || gone, 'disclaimer:' || notice, 'signature:' || signed, 'quote:' || quoted, CASE WHEN listed > 0 THEN 'blacklist:' || listed END) AS removed FROM t6"""


@query(_CLEAN)
def clean_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies after all six steps of the cleaner, and by step how much it removed (characters; lines of the blacklist)."""
    rows = cleaner.with_clean_body(table(spark, d, "messages", "row_id", "text_body").filter("text_body IS NOT NULL"), "text_body", blacklist=_BLACKLIST)
    of = lambda kind: F.filter("removed_spans", lambda x: x["type"] == kind)
    size = lambda kind: F.aggregate(of(kind), F.lit(0), lambda a, x: a + x["end"] - x["start"])
    said = [F.when(F.size(of(k)) > 0, F.concat(F.lit(k + ":"), size(k).cast("string"))) for k in ("autoresponse", "disclaimer", "signature", "quote")]
    listed = F.when(F.size(of("blacklist")) > 0, F.concat(F.lit("blacklist:"), F.size(of("blacklist")).cast("string")))
    return rows.select("row_id", "clean", F.concat_ws("|", *said, listed).alias("removed"))


@query()
def plain_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Bodies after the plain cleaner; its machine over lines is tested by itself."""
    return table(spark, d, "messages", "row_id", "text_body").filter("text_body IS NOT NULL").select("row_id", cleaner.without_marks(F.col("text_body")).alias("kept"))


@query()
def main_contents(spark: SparkSession, d: str) -> DataFrame:
    """What is new in each body, without leading header lines."""
    return table(spark, d, "messages", "row_id", "text_body").select("row_id", quotes.main_contents(F.col("text_body")).alias("kept"))


# pages, headers, instants as text


@query(r"""SELECT doc_id, trim(text, ' ') = '' OR regexp_matches(text, '[<>]') OR NOT regexp_matches(regexp_replace(text, '<[^>]*>', '', 'g'), '\p{L}{2}') AS unparsed, trim(regexp_replace(regexp_replace(text, '(?is)<(?:script\b.*?</script|style\b.*?</style|svg\b.*?</svg)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), ' ') AS stripped FROM documents WHERE text IS NOT NULL""")
def page_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text looks as if it had not been parsed, and the text without markup."""
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", tx.looks_unparsed(t, t).alias("unparsed"), tx.strip_tags(t).alias("stripped"))


@query(r"""SELECT row_id, len(list_filter(string_split(text_body, chr(10)), lambda x: regexp_matches(x, '^[\p{Lu}\p{Cyrillic}][\p{Lu}\p{Cyrillic}\s\x{85}\x{a0}\p{Z}]{3,}:[\s\x{85}\x{a0}\p{Z}]*$'))) AS headers FROM messages WHERE text_body IS NOT NULL""")
def caps_headers(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each body that are headers in capitals."""
    return table(spark, d, "messages", "row_id", "text_body").filter("text_body IS NOT NULL").select("row_id", F.size(F.filter(F.split("text_body", "\n"), tx.is_caps_header)).alias("headers"))


_LOCAL = "timezone(b.mailbox_tz, timezone('UTC', m.ingested_at))"
_MINUTES = f"CAST(round((epoch({_LOCAL}) - epoch(m.ingested_at)) / 60) AS INTEGER)"


@query(f"""SELECT row_id, strftime({_LOCAL}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(m.ingested_at) % 1000000 > 0 THEN '.' || lpad(CAST(microsecond(m.ingested_at) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || CASE WHEN {_MINUTES} < 0 THEN '-' ELSE '+' END || lpad(CAST(abs({_MINUTES}) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs({_MINUTES}) % 60 AS VARCHAR), 2, '0') AS local_iso,
CASE datediff('day', DATE '2025-06-15', CAST(m.ingested_at AS DATE)) WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' WHEN -1 THEN 'yesterday' END AS label FROM messages m JOIN mailboxes b USING (mailbox_id) WHERE m.ingested_at IS NOT NULL""")
def arrivals_in_zone(spark: SparkSession, d: str) -> DataFrame:
    """Arrival of each message as text in the zone of its mailbox, and a word for its day."""
    boxes = table(spark, d, "mailboxes", "mailbox_id", "mailbox_tz")
    rows = table(spark, d, "messages", "row_id", "mailbox_id", "ingested_at").filter("ingested_at IS NOT NULL").join(boxes, "mailbox_id")
    at = F.col("ingested_at").cast("timestamp")
    return rows.select("row_id", tx.iso_in_zone(at, F.col("mailbox_tz")).alias("local_iso"), tx.day_label(F.to_date("ingested_at"), F.lit("2025-06-15").cast("date")).alias("label"))


@query("SELECT event_id, props AS json, event_type AS rest FROM events")
def reply_splits(spark: SparkSession, d: str) -> DataFrame:
    """Replies of an object and a text after it, taken apart."""
    said = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```\n"), F.col("event_type"))
    return table(spark, d, "events", "event_id", "props", "event_type").select("event_id", tx.reply_parts(said).alias("p")).select("event_id", "p.json", "p.rest")


@query("SELECT doc_id, array_to_string(regexp_extract_all(text || ' ID: ev-' || format('{:x}', doc_id) || ', ID:  ev-a-1', '\\bID:\\s*(ev-[a-f0-9-]+)', 1), '|') AS ids FROM documents WHERE text IS NOT NULL")
def named_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL")
    said = F.concat(F.col("text"), F.lit(" ID: ev-"), F.lower(F.hex("doc_id")), F.lit(", ID:  ev-a-1"))
    return rows.select("doc_id", F.array_join(tx.evidence_ids(said), "|").alias("ids"))
