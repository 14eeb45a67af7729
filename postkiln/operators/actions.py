"""Actions in sentences, with confidence, and the evidence that backs each of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postkiln.functions import lemmas, signals


# Verbs of action whose forms open a request, words before them, and signs of what is past.
VERBS = frozenset((*lemmas.EN_BASE, *lemmas.RU_BASE))
POLITE = r"^(?:(?:please|пожалуйста|прошу)(?![\p{L}\p{N}_])[^\p{L}\p{N}_]*)+"
PAST = r"(?iuU)\b(?:был|была|было|были)\b|\b(?:was|were|has been|have been)\b|\b\w+(?:ли|ла|ло)\s+(?:вчера|утром|сегодня|уже)\b|\b\w+ed\s+(?:yesterday|today|already)\b"


def _alias_hit(low: Column, alias: str) -> Column:
    """Whether an alias names somebody: a part of the text where it has an @ or a blank, else a word whose first place is not the
    beginning of the name of a group."""
    if "@" in alias or " " in alias:
        return low.contains(alias)
    word = r"(?U)(?<![\p{L}\p{N}_])" + re.escape(alias) + r"(?:'s)?(?![\p{L}\p{N}_])"
    behind = F.regexp_extract(low, r"(?Us)^.*?" + word + r"(.*)$", 1)
    return low.rlike(word) & ~F.ltrim(behind).rlike("^(?:team|group|dept)")


def mentions(text: Column, aliases: list[str]) -> Column:
    """Whether the text names one of the aliases as a word, but not as the name of a group."""
    low = F.lower(text)
    out = F.lit(False)
    for a in aliases:
        out = out | F.coalesce(_alias_hit(low, a.lower()), F.lit(False))
    return out


def without_leading_mention(text: Column, aliases: list[str]) -> Column:
    """The text, in lower case, without the alias that it begins with and the signs after that; longer aliases are tried first."""
    low = F.lower(text)
    out = F.when(F.lit(False), low)
    for a in aliases:
        if "@" not in a:
            lead = r"^\s*" + re.escape(a.lower()) + r"[,:;\s-]+"
            out = out.when(low.rlike(lead), F.regexp_replace(low, lead, ""))
    return out.otherwise(low)


def is_imperative_like(word: Column) -> Column:
    """Letters only, and no ending of a past or progressive form."""
    english = word.rlike("^[a-z]+$") & ~word.rlike("(?:ed|ing)$")
    return F.coalesce(english | (word.rlike("[а-яё]") & ~word.rlike("(?:л|ла|ли|ло)$")), F.lit(False))


def verb_by_lemma(text: Column, aliases: list[str]) -> Column:
    """The lemma of one of the first two words that is a verb of action, where the sentence opens like a request and nothing in it
    says that it is past; null otherwise."""
    opening = F.regexp_replace(without_leading_mention(text, aliases), POLITE, "")
    first_two = F.slice(F.regexp_extract_all(opening, F.lit(r"(?U)(\w+)"), F.lit(1)), 1, 2)
    fit = is_imperative_like(F.get(first_two, F.lit(0))) & ~F.lower(text).rlike(PAST)
    found = F.filter(lemmas.lemmas_of_phrase(F.when(fit, F.array_join(first_two, " "))), lambda w: w.isin(*sorted(VERBS)))
    return F.get(found, F.lit(0))


def _first(text: Column, *patterns: str) -> Column:
    """What the first of the patterns that matches finds."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns])


def actions(messages: DataFrame, key: str, text: str, aliases: list[str], sender_rank: Column | None = None, ranks: DataFrame | None = None, sender: str | None = None) -> DataFrame:
    """(key, sentence_no, sentence, action_type, verb, deadline, confidence, start_at, end_at) of each sentence that mentions the
    user, orders, asks for or questions something.

    A question comes before an action, an action before a mention. start_at and end_at are code points from 0 in the text: each
    sentence is looked for from the end of the one before. The rank of the sender is a column, or looked up in ``ranks``
    (sender, sender_rank) by the column ``sender``; senders that are not in it rank 0. Null texts give no rows.
    """
    rows = messages
    rank = sender_rank if sender_rank is not None else F.lit(0.0)
    if ranks is not None and sender is not None:
        side = ranks.groupBy(F.lower(F.trim("sender")).alias("_who")).agg(F.max("sender_rank").alias("_their_rank"))
        rows = rows.join(side, F.lower(F.trim(sender)) == F.col("_who"), "left")
        rank = F.coalesce("_their_rank", F.lit(0.0))
    found = rows.select(key, F.col(text).alias("_text"), signals.sentences(F.col(text)).alias("_s"), rank.alias("_rank"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("places"))

    def step(state: Column, s: Column) -> Column:
        at = F.call_function("locate", s, F.col("_text"), state["next"])
        at = F.when(at > 0, at).otherwise(state["next"])
        return F.struct((at + F.char_length(s)).cast("int").alias("next"), F.concat(state["places"], F.array((at - 1).cast("int"))).alias("places"))

    placed = found.withColumn("_at", F.aggregate("_s", start, step)["places"])
    exploded = placed.select(key, "_rank", F.posexplode(F.arrays_zip(F.col("_s").alias("s"), F.col("_at").alias("at"))).alias("sentence_no", "_z")).select(key, "_rank", "sentence_no", F.col("_z.s").alias("sentence"), F.col("_z.at").alias("start_at"))
    s = F.col("sentence")
    imperative = F.coalesce(_first(s, signals.IMPERATIVE_RU, signals.IMPERATIVE_EN), F.col("_lemma"))
    flagged = exploded.withColumn("_lemma", verb_by_lemma(s, aliases)).withColumns({
        "mention": mentions(s, aliases), "imperative": imperative, "marker": _first(s, signals.MARKER_RU, signals.MARKER_EN),
        "question": s.rlike(signals.QUESTION), "deadline": F.nullif(F.regexp_extract(s, signals.DEADLINE, 0), F.lit("")),
    })
    kept = flagged.filter("imperative IS NOT NULL OR marker IS NOT NULL OR question OR mention")
    kind = F.when(F.col("question"), "question").when(F.col("imperative").isNotNull() | F.col("marker").isNotNull(), "action").otherwise("mention")
    verb = F.when(F.col("question"), "answer").otherwise(F.coalesce("imperative", "marker", F.lit("mentioned")))
    confidence = signals.action_confidence(F.col("mention"), F.col("imperative").isNotNull(), F.col("marker").isNotNull(), F.col("question"), F.col("deadline").isNotNull(), F.col("_rank"))
    return kept.select(key, "sentence_no", F.trim("sentence").alias("sentence"), kind.alias("action_type"), verb.alias("verb"), "deadline", F.round(confidence, 6).alias("confidence"), "start_at", (F.col("start_at") + F.char_length("sentence")).alias("end_at"))


def backed(acts: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Each action with the chunk of its message that contains it or is contained in it, the longest overlap first, else the
    message's first chunk; evidence_id is null for messages without chunks. Chunks of a message are few."""
    joined = acts.join(chunks.select(key, "evidence_id", "chunk_idx", "content"), key, "left")
    overlap = F.when(F.col("content").contains(F.col("sentence")), F.char_length("sentence")).when(F.col("sentence").contains(F.col("content")), F.char_length("content")).otherwise(0)
    best = F.row_number().over(Window.partitionBy(key, "sentence_no").orderBy(overlap.desc(), "chunk_idx", "evidence_id"))
    return joined.withColumn("_r", best).filter("_r = 1").drop("_r", "content", "chunk_idx")
