"""Summarising by threads: which threads qualify, which of their chunks must be read, and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chunks of a thread worth summarising, and chunks read of it, usually and at most.
LEAST_CHUNKS, USUAL, MOST = 3, 8, 12


def gate(threads: DataFrame, n_threads: int = 40, n_messages: int = 200, least: int = 6) -> DataFrame:
    """One row: whether the load calls for summaries by thread. ``threads`` has n_messages."""
    counts = threads.agg(F.count(F.lit(1)).alias("threads"), F.coalesce(F.sum("n_messages"), F.lit(0)).alias("messages"))
    return counts.withColumn("hierarchical", (F.col("threads") >= least) & ((F.col("threads") >= n_threads) | (F.col("messages") >= n_messages)))


def qualifying(chunks: DataFrame, thread: str) -> DataFrame:
    """Threads with enough chunks to summarise."""
    return chunks.groupBy(thread).agg(F.count(F.lit(1)).alias("n_chunks")).filter(F.col("n_chunks") >= LEAST_CHUNKS)


def must_include(chunks: DataFrame, thread: str, key: str, score: str, at: str, mention: str) -> DataFrame:
    """(thread, key, reason): the thread's latest chunk, its mentions up to MOST, and its best others up to USUAL in all.

    Three ranks within a thread; each keeps at most MOST rows, so the sorts are bounded by WindowGroupLimit.
    """
    best = Window.partitionBy(thread).orderBy(F.col(score).desc_nulls_last(), key)
    latest = Window.partitionBy(thread).orderBy(F.col(at).desc_nulls_last(), F.col(key).desc())
    named = F.coalesce(F.col(mention), F.lit(False))
    last = chunks.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").select(thread, key, F.lit("latest").alias("reason"))
    mentions = chunks.filter(named).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= MOST - 1).select(thread, key, F.lit("mention").alias("reason"))
    must = last.unionByName(mentions).groupBy(thread, key).agg(F.min("reason").alias("reason"))
    counts = must.groupBy(thread).agg(F.count(F.lit(1)).alias("_must"))
    top = chunks.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= USUAL + MOST).select(thread, key, "_r")
    others = top.join(must.select(thread, key), [thread, key], "left_anti").withColumn("_place", F.row_number().over(Window.partitionBy(thread).orderBy("_r")))
    fill = others.join(counts, thread, "left").filter(F.col("_place") <= F.greatest(F.lit(0), USUAL - F.coalesce("_must", F.lit(0)))).select(thread, key, F.lit("score").alias("reason"))
    return must.unionByName(fill)


def thread_text(picked: DataFrame, thread: str, order: str, content: str, snippet: int = 150) -> DataFrame:
    """(thread, prompt): the chosen chunks of a thread in order, each cut to a snippet; at most MOST chunks, so the list is bounded."""
    line = F.concat(F.lit("- "), F.substring(F.regexp_replace(content, r"\s+", " "), 1, snippet))
    return picked.groupBy(thread).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))


def averages(threads: DataFrame, summarised: str, tokens: str) -> DataFrame:
    """One row: threads summarised and passed by, mean tokens of the summarised, tokens in all."""
    on = F.coalesce(F.col(summarised), F.lit(False))
    return threads.agg(F.sum(F.when(on, 1).otherwise(0)).alias("threads_summarized"), F.sum(F.when(on, 0).otherwise(1)).alias("threads_skipped_small"), F.round(F.coalesce(F.avg(F.when(on, F.col(tokens))), F.lit(0.0)), 6).alias("per_thread_avg_tokens"), F.coalesce(F.sum(F.when(on, F.col(tokens)).otherwise(0)), F.lit(0)).alias("final_input_tokens"))


def combined(summaries: DataFrame, small: DataFrame, run: str, thread: str, tokens: str, budget: int = 4000, top: int = 3) -> DataFrame:
    """What the last call of a run reads: (run, thread, kind, place, tokens, kept) of thread summaries and of the chunks of small
    threads, within a budget.

    summaries: run, thread, score, tokens. small: run, thread, key, score, tokens. Summaries come first, best first, then the
    ``top`` chunks of each small thread; the longest prefix within the budget is kept. Summaries of a run are as many as its
    threads and its small threads give ``top`` rows each, so a row_number limit bounds what is sorted.
    """
    best = Window.partitionBy(run, thread).orderBy(F.col("score").desc_nulls_last(), "key")
    few = small.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top).select(run, thread, F.lit("chunk").alias("kind"), "score", F.col("_r"), F.col(tokens).alias("tokens"))
    rows = summaries.select(run, thread, F.lit("summary").alias("kind"), "score", F.lit(0).alias("_r"), F.col(tokens).alias("tokens")).unionByName(few)
    order = Window.partitionBy(run).orderBy(F.col("kind").desc(), F.col("score").desc_nulls_last(), thread, "_r")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("_sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.select(run, thread, "kind", "place", "tokens", (F.col("_sum") <= budget).alias("kept"))


def snippets(chunks: DataFrame, thread: str, key: str, score: str, content: str, most: int = 5, length: int = 150) -> DataFrame:
    """(thread, place, key, snippet): the beginnings of the best chunks of each thread."""
    w = Window.partitionBy(thread).orderBy(F.col(score).desc_nulls_last(), key)
    return chunks.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(thread, "place", key, F.substring(content, 1, length).alias("snippet"))
