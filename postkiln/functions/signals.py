"""Signals of action, date and question in text. Lexicons are literals, so that their patterns are compiled once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of action, Russian then English; results follow this order.
ACTION_WORDS_RU = ["пожалуйста", "прошу", "просьба", "можете", "могли бы", "не могли бы", "нужно", "требуется", "необходимо", "должны", "обязательно", "одобрить", "одобрите", "согласовать", "согласуйте", "утвердить", "утвердите", "проверить", "проверьте", "подтвердить", "подтвердите", "завершить", "завершите", "выполнить", "выполните", "сделать", "сделайте", "подготовить", "подготовьте", "доработать", "доработайте", "ответить", "ответьте", "уточнить", "уточните", "срочно", "срок", "дедлайн", "не позднее", "обновить", "обновите", "актуализировать", "актуализируйте"]
ACTION_WORDS_EN = ["please", "need", "required", "necessary", "approve", "review", "complete", "finish", "prepare", "urgent", "deadline", "due", "asap", "request", "could you", "can you", "would you", "update", "confirm", "verify", "respond", "reply"]
# Words whose mere presence raises a chunk's base score.
PRIORITY_WORDS = ["please", "пожалуйста", "need", "нужно", "required", "требуется", "approve", "одобрить", "review", "проверить", "complete", "завершить", "urgent", "срочно", "asap", "deadline", "срок", "due", "до"]
RELATIVE_DAYS = ["сегодня", "завтра", "вчера", "послезавтра", "today", "tomorrow", "yesterday"]
# Months of Russian deadlines.
_RU_MONTH = "январ[ья]|феврал[ья]|марта|апрел[ья]|ма[яй]|июн[ья]|июл[ья]|августа?|сентябр[ья]|октябр[ья]|ноябр[ья]|декабр[ья]"
# Markers of automatic or unwanted mail.
NEGATIVE = r"(?iu)(?:\b(?:noreply@|no-reply@|donotreply@)|\b(?:unsubscribe|отписаться)\b|\b(?:auto-submitted|автоответ)\b|\bpostmaster@|\b(?:delivery status|статус доставки)\b|\b(?:out of office|auto-reply|automatic reply)\b)"
DOCUMENT_TYPES = ["pdf", "doc", "docx", "xlsx", "xls", "ppt", "pptx"]
# Imperative and request patterns, question words and deadlines of the sentence extractor.
IMPERATIVE_EN = r"(?i)\b(?:please|could you|can you|would you|will you|need you to|want you to|asking you to|request you to|make sure|ensure|verify|confirm|check|review|approve|sign off|validate|examine|send|provide|submit|deliver|share|update|fix|correct|change|modify|complete|finish|finalize|wrap up|prepare|create|draft|develop)\b"
IMPERATIVE_RU = r"(?iuU)\b(?:сделай(?:те)?|выполни(?:те)?|проверь(?:те)?|отправь(?:те)?|пришли(?:те)?|подготовь(?:те)?|согласуй(?:те)?|утверди(?:те)?|одобри(?:те)?|посмотри(?:те)?|изучи(?:те)?|рассмотри(?:те)?|оцени(?:те)?|ответь(?:те)?|напиши(?:те)?|сообщи(?:те)?|уведоми(?:те)?|передай(?:те)?|дай(?:те)?|предоставь(?:те)?|подай(?:те)?|исправь(?:те)?|поправь(?:те)?|обнови(?:те)?|измени(?:те)?|завершите?|закончите?|доделай(?:те)?|финализируй(?:те)?)"
MARKER_RU = r"(?iuU)\b(?:нужно|необходимо|требуется|надо|прошу|можешь|можете|сможешь|сможете|давай(?:те)?)\s+|\bпожалуйста\s*[,:]"
MARKER_EN = r"(?i)\bneed to\s+|\bneed\b.{0,40}\bto\b|\bhave to\s+|\bmust\s+|\bshould\s+|\bplease\s+"
QUESTION = r"(?iuU)\?|\b(?:когда|где|как|что|кто|почему|зачем)\b|\b(?:можно|возможно|получится)\s+ли\b|\b(?:what|when|where|how|who|why|which)\b|\b(?:can|could|would|will|should|is|are|do|does)\s+"
DEADLINE = r"(?iuU)\b(?:до|к|не позднее)\s+\d{1,2}[./]\d{1,2}|\b(?:by|until|before)\s+\d{1,2}[./]\d{1,2}|\b(?:сегодня|завтра|послезавтра|вчера)\b|\b(?:today|tomorrow|monday|tuesday|wednesday|thursday|friday)\b|\b(?:понедельник|вторник|среда|четверг|пятница|суббота|воскресенье)\b|\b(?:deadline|дедлайн|срок)\s*:?\s*\d|\b(?:eod|end of day|конец дня)\b"
PROJECT_TAG = r"\[(?:(?:JIRA|PROJ|TASK|BUG|TICKET)-|#)\d+\]"
#: Weights of a sentence's features, and the shift of the logistic curve.
CONFIDENCE_WEIGHTS, CONFIDENCE_SHIFT = {"mention": 1.5, "imperative": 1.2, "marker": 1.0, "question": 0.8, "deadline": 0.6, "sender_rank": 0.5}, 1.5


def words_found(text: Column, lexicon: list[str]) -> Column:
    """Words of the lexicon that stand in the text as whole words, in the lexicon's order, each once."""
    pattern = r"(?iuU)(?<![\p{L}\p{N}_])(" + "|".join(sorted(lexicon, key=lambda w: (-len(w), w))) + r")(?![\p{L}\p{N}_])"
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: F.lower(w))
    # a word inside a longer one of the lexicon stands there as well
    for longer in lexicon:
        inner = [w for w in lexicon if w != longer and f" {w} " in f" {longer} "]
        if inner:
            hits = F.concat(hits, F.when(F.array_contains(hits, longer), F.array(*[F.lit(w) for w in inner])).otherwise(F.array().cast("array<string>")))
    return F.array_intersect(F.array(*[F.lit(w) for w in lexicon]), hits)


def action_words(text: Column) -> Column:
    return words_found(text, ACTION_WORDS_RU + ACTION_WORDS_EN)


def dates_found(text: Column) -> Column:
    """Dates in the order day-month-year, ISO, Russian deadlines (each once), words for a day (as substrings, each once)."""
    dmy = F.regexp_extract_all(text, F.lit(r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b"), F.lit(0))
    iso = F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))
    russian = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?iuU)\b(?:до|к|не позднее)\s+\d{{1,2}}\s+(?:{_RU_MONTH})\b"), F.lit(0)), lambda d: F.regexp_replace(d, r"\s+", " ")))
    lowered = F.lower(text)
    relative = F.filter(F.array(*[F.lit(w) for w in RELATIVE_DAYS]), lambda w: lowered.contains(w))
    return F.concat(dmy, iso, russian, relative)


def has_question(text: Column) -> Column:
    return text.contains("?")


def base_score(text: Column, hours_old: Column) -> Column:
    """A chunk's score from its text and age: words, dates, marks, recency."""
    low = F.lower(text)
    score = sum((F.when(low.contains(w), 1.0).otherwise(0.0) for w in PRIORITY_WORDS), F.lit(0.0))
    for pattern in (r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"(?U)\b(today|tomorrow|yesterday|сегодня|завтра|вчера)\b"):
        score = score + F.when(low.rlike(pattern), 0.5).otherwise(0.0)
    score = score + F.when(text.contains("?"), 0.5).otherwise(0.0) + F.when(text.contains("!"), 0.3).otherwise(0.0)
    return score + F.when(hours_old < 1, 2.0).when(hours_old < 6, 1.0).when(hours_old < 24, 0.5).otherwise(0.0)


def is_negative(text: Column) -> Column:
    return F.coalesce(text.rlike(NEGATIVE), F.lit(False))


def sentences(text: Column) -> Column:
    """Sentences of at least ten characters: they end with a closing sign before a capital, or with one at a line's end."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ])|(?<=[.!?])\n+"), lambda s: F.char_length(F.trim(s)) >= 10)


def action_confidence(mention: Column, imperative: Column, marker: Column, question: Column, deadline: Column, sender_rank: Column) -> Column:
    w = CONFIDENCE_WEIGHTS
    on = lambda c, k: F.when(c, w[k]).otherwise(0.0)
    score = on(mention, "mention") + on(imperative, "imperative") + on(marker, "marker") + on(question, "question") + on(deadline, "deadline") + sender_rank * w["sender_rank"]
    return 1 / (1 + F.exp(F.lit(CONFIDENCE_SHIFT) - score))


def mention_aliases(addresses: list[str]) -> list[str]:
    """Ways to name a person: the address, its local part, the parts of that from three letters on; longest first."""
    out = set()
    for a in addresses:
        low = a.lower().strip()
        if "@" in low:
            local = low.split("@")[0]
            out |= {low, local, *(p for p in local.replace("_", ".").replace("-", ".").split(".") if len(p) >= 3)}
        else:
            out |= {low, *(p for p in low.split() if len(p) >= 3)}
    return sorted(out - {""}, key=lambda x: (-len(x), x))
