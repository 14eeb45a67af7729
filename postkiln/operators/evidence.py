"""Evidence chunks: cutting message bodies by paragraphs and sentences, scoring and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postkiln.functions import signals, text as tx
from postkiln.operators.skew import HOT_KEYS, ROWS_PER_SALT, salt

#: Tokens of a chunk, from and to; chunks of a message, usual and for messages above LONG tokens.
MIN_TOKENS, MAX_TOKENS, MAX_CHUNKS, MAX_CHUNKS_LONG, LONG = 64, 512, 12, 3, 1000
#: Messages or threads from which a run is heavily loaded, and the part of its chunks that messages then keep.
LOAD_MESSAGES, LOAD_THREADS, LOADED = 200, 60, 0.75


def estimate(text: str) -> int:
    return len(text.split()) * 13 // 10


def chunk_body(body: str, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS, most: int | None = None) -> list[tuple[int, str]]:
    """(start, chunk) of a body: paragraphs are gathered up to max_tokens, longer ones are cut at sentences, and parts under
    min_tokens join their neighbour; a body under min_tokens has no chunk. Chunks are slices of the body, so their places hold."""
    if not body or estimate(body) < min_tokens:
        return []
    if most is None:
        most = MAX_CHUNKS_LONG if estimate(body) > LONG else MAX_CHUNKS
    spans: list[tuple[int, int]] = []
    at = 0
    for part in body.split("\n\n"):
        end = at + len(part)
        if estimate(part) <= max_tokens:
            spans.append((at, end))
        else:
            begin = at
            for i in range(at, end):
                if body[i] in ".!?" and (i + 1 == end or body[i + 1].isspace()) and estimate(body[begin : i + 1]) >= min_tokens:
                    spans.append((begin, i + 1))
                    begin = i + 1
            if begin < end:
                spans.append((begin, end))
        at = end + 2
    out: list[list[int]] = []
    for a, b in spans:
        if out and estimate(body[out[-1][0] : b]) <= max_tokens or out and estimate(body[a:b]) < min_tokens:
            out[-1][1] = b
        else:
            out.append([a, b])
    if len(out) > 1 and estimate(body[out[0][0] : out[0][1]]) < min_tokens:
        out[1][0] = out[0][0]
        out.pop(0)
    return [(a, body[a:b]) for a, b in out if body[a:b].strip()][:most]


def chunks(messages: DataFrame, key: str, body: str, min_tokens: int = MIN_TOKENS, n_messages: int = 0, n_threads: int = 0) -> DataFrame:
    """(key, chunk_idx, total_chunks, start_at, end_at, content, token_count, evidence_id). The identifier is a hash of message
    and place, so a second run gives the same. Null and short bodies give no rows. n_messages and n_threads are those of the run."""
    rows = messages.select(key, body).filter(F.col(body).isNotNull() & (tx.token_estimate(F.col(body)) >= min_tokens))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in batch.itertuples(index=False):
                parts = chunk_body(t, min_tokens, most=most_chunks(n_messages, n_threads, estimate(t)))
                out += [(k, i, len(parts), a, a + len(c), c, estimate(c)) for i, (a, c) in enumerate(parts)]
            yield pd.DataFrame(out, columns=[key, "chunk_idx", "total_chunks", "start_at", "end_at", "content", "token_count"])

    kind = messages.schema[key].dataType.simpleString()
    cut_rows = rows.mapInPandas(cut, f"{key} {kind}, chunk_idx int, total_chunks int, start_at int, end_at int, content string, token_count int")
    return cut_rows.withColumn("evidence_id", F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("chunk_idx").cast("string")), 256), 1, 16)))


def aliases_matched(to: Column, cc: Column, aliases: list[str]) -> Column:
    """Aliases, in their order, that are exactly one of the recipients."""
    everyone = F.transform(F.concat(F.coalesce(to, F.array().cast("array<string>")), F.coalesce(cc, F.array().cast("array<string>"))), lambda x: F.lower(x))
    return F.array_intersect(F.array(*[F.lit(a.lower()) for a in aliases]), everyone)


def with_signals(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({"action_verbs": signals.action_words(F.col(text)), "dates": signals.dates_found(F.col(text)), "contains_question": signals.has_question(F.col(text))})


def within_budget(df: DataFrame, group: str, score: str, tokens: str, tie: str, budget: int, least: int = MIN_TOKENS, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The best rows of each group up to a budget of tokens: a prefix by score; the first row that does not fit is cut to what
    is left if that is at least ``least``. Adds kept_tokens. Null counts are 0; ties are settled by ``tie``.

    A group of any size is sorted in salted parts first: a row that is beyond the budget among the rows of its own part is beyond
    it among all, so only rows within the budget of their part are sorted together.
    """
    amount = F.greatest(F.lit(0), F.coalesce(F.col(tokens), F.lit(0)))
    order = [F.col(score).desc_nulls_last(), F.col(tie)]
    upto = lambda *keys: F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - amount
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_salt)
    large = df.join(F.broadcast(sizes.orderBy(F.desc("_n")).limit(HOT_KEYS)), group, "left")  # at most HOT_KEYS rows
    salted = large.withColumn("_salt", F.coalesce(salt(F.col("_n"), tie, rows_per_salt=rows_per_salt), F.lit(0)))
    few = salted.withColumn("_before", upto(group, "_salt")).filter(F.col("_before") < budget).drop("_before", "_salt", "_n")
    total = few.withColumn("_before", upto(group))
    left = F.lit(budget) - F.col("_before")
    kept = F.when(amount <= left, amount).when(left >= least, left)
    return total.withColumn("kept_tokens", kept.cast("bigint")).filter(F.col("kept_tokens").isNotNull()).drop("_before")


def most_chunks(n_messages: int, n_threads: int, tokens: int) -> int:
    """Chunks of a message: fewer for long ones, three quarters and at least two where a run is heavily loaded."""
    most = MAX_CHUNKS_LONG if tokens > LONG else MAX_CHUNKS
    return max(2, int(most * LOADED)) if n_messages >= LOAD_MESSAGES or n_threads >= LOAD_THREADS else most


def with_metadata(chunks_of: DataFrame, messages: DataFrame, key: str, aliases: list[str]) -> DataFrame:
    """Chunks with what is known of their mail (message_metadata), their place (source_ref), whom they address, their signals and
    their score. messages: key, sender_email, to_recipients, cc_recipients, subject, importance, is_flagged, hours_old."""
    head = messages.select(
        F.col(key).alias("_k"), F.struct(F.col("sender_email").alias("sender"), F.col("to_recipients").alias("to"), F.col("cc_recipients").alias("cc"), "subject", "importance", "is_flagged").alias("message_metadata"),
        aliases_matched(F.col("to_recipients"), F.col("cc_recipients"), aliases).alias("user_aliases_matched"), "hours_old",
    )
    joined = chunks_of.join(head, F.col(key) == F.col("_k"), "left").drop("_k")
    out = with_signals(joined, "content")
    return out.withColumns({
        "source_ref": F.struct(F.col(key).cast("string").alias("msg_id"), "start_at", "end_at"), "addressed_to_me": F.coalesce(F.size("user_aliases_matched") > 0, F.lit(False)),
        "priority_score": signals.base_score(F.col("content"), F.coalesce("hours_old", F.lit(1e9))),
    }).drop("hours_old")
