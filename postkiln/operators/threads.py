"""Threads of messages: duplicates by body, thread keys, summaries, priorities and merging of like threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postkiln.functions.text import jaccard, subject_key, trigrams
from postkiln.operators.skew import ranked_by_range, routed_join
from postkiln.session import written

#: Messages kept per thread, and least trigram overlap of two threads with one subject that are merged.
KEPT_PER_THREAD, LIKE = 50, 0.7


def unique_bodies(messages: DataFrame, body: str, order: str) -> DataFrame:
    """One row per distinct body, the first in order, with n_copies and the checksum; null bodies stay as they are."""
    keyed = messages.withColumn("checksum", F.sha2(body, 256))
    first = keyed.filter("checksum IS NOT NULL").groupBy("checksum").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("n_copies"))
    kept = keyed.join(first, (keyed[order] == first["_first"]) & (keyed["checksum"] == first["checksum"])).drop(first["checksum"]).drop("_first")
    nulls = keyed.filter("checksum IS NULL").withColumn("n_copies", F.lit(1).cast("bigint"))
    return kept.unionByName(nulls)


def duplicate_counts(messages: DataFrame, body: str, key: str) -> DataFrame:
    """(primary, duplicates, last_duplicate) of each body that stands in several rows. Copies are counted, not gathered."""
    return messages.filter(F.col(body).isNotNull()).groupBy(F.sha2(body, 256).alias("checksum")).agg(F.min(key).alias("primary_key"), (F.count(F.lit(1)) - 1).alias("duplicates"), F.max(key).alias("last_duplicate")).filter("duplicates > 0").drop("checksum")


def redundancy(messages: DataFrame, body: str) -> DataFrame:
    """One row: rows, distinct bodies and the share of rows that repeat another; 0 for an empty table."""
    counts = messages.groupBy(F.sha2(F.coalesce(body, F.lit("")), 256).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique")).withColumn("redundancy", F.round(F.coalesce(1 - F.try_divide("n_unique", "n_rows"), F.lit(0.0)), 6))


def thread_key(conversation: Column, subject: Column, message: Column) -> Column:
    """Key of a message's thread: its conversation, else its normalised subject, else itself."""
    key = subject_key(subject)
    return F.coalesce(
        F.concat(F.lit("conv_"), F.nullif(F.trim(conversation), F.lit(""))),
        F.when(key != "", F.concat(F.lit("subj_"), F.substring(F.sha2(key, 256), 1, 16))),
        F.concat(F.lit("single_"), message),
    )


def thread_summary(messages: DataFrame, key: str, at: str, sender: str) -> DataFrame:
    """(thread, n_messages, n_kept, latest, participants) per thread; participants are distinct non-empty senders."""
    return messages.groupBy(key).agg(F.count(F.lit(1)).alias("n_messages"), F.least(F.count(F.lit(1)), F.lit(KEPT_PER_THREAD)).cast("bigint").alias("n_kept"), F.max(at).alias("latest"), F.count_distinct(F.nullif(F.lower(F.trim(sender)), F.lit(""))).alias("participants"))


def latest_of_thread(messages: DataFrame, key: str, at: str, tie: str, most: int = KEPT_PER_THREAD) -> DataFrame:
    """The latest ``most`` messages of every thread, ranked from 1; the sort keeps no more than that per task."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    return messages.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def recent(threads: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    """Threads whose latest message is at most so many hours old."""
    return threads.filter(F.col("latest").cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"))


def by_latest(threads: DataFrame, thread: str) -> DataFrame:
    """Threads in order of their latest message, newest first, with their place. Threads of one minute are sorted together and the
    places of minutes are counted, so the table is never sorted in one task."""
    shifted = threads.withColumn("_neg", -F.unix_micros(F.col("latest").cast("timestamp"))).withColumn("_all", F.lit(0))
    minute = F.coalesce(F.floor(F.col("_neg") / 60_000_000), F.lit(2**62)).cast("bigint")
    return ranked_by_range(shifted.withColumn("_minute", minute), "_all", "_minute", [F.col("_neg").asc_nulls_last(), F.col(thread)], "place").drop("_neg", "_all", "_minute")


def with_chunk_counts(threads: DataFrame, chunks: DataFrame, thread: str) -> DataFrame:
    """threads with n_chunks, 0 for those without evidence."""
    counts = chunks.groupBy(thread).agg(F.count(F.lit(1)).alias("n_chunks"))
    return threads.join(counts, thread, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def latest_by_id(messages: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, columns) of the last row of each identifier in ``order``; rows without identifier are left out. An aggregate, so
    repeated identifiers are put together before the shuffle."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return messages.filter(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, "_last.*")


def participants(messages: DataFrame, key: str, sender: str, to: str, cc: str) -> DataFrame:
    """(thread, participant, roles): everyone who wrote or received a message of a thread, once, and as what. One row each, so the
    people of a thread of any size are never gathered."""
    as_a = lambda role: lambda x: F.struct(x.alias("who"), F.lit(role).alias("as"))
    people = F.concat(F.array(as_a("from")(F.col(sender))), *[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), as_a(n)) for c, n in ((to, "to"), (cc, "cc"))])
    rows = messages.select(key, F.inline(people)).select(key, F.nullif(F.lower(F.trim("who")), F.lit("")).alias("participant"), "as").filter("participant IS NOT NULL")
    return rows.groupBy(key, "participant").agg(F.array_join(F.sort_array(F.collect_set("as")), "|").alias("roles"))


def thread_statistics(messages: DataFrame, thread: str, body: str) -> DataFrame:
    """One row: messages, distinct bodies, threads by the kind of their key, and threads of more than one message."""
    per = messages.groupBy(thread).agg(F.count(F.lit(1)).alias("n"))
    kind = F.substring_index(thread, "_", 1)
    shapes = per.agg(F.count(F.lit(1)).alias("threads"), *[F.sum(F.when(kind == k, 1).otherwise(0)).alias(f"by_{k}") for k in ("conv", "subj", "single")], F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("with_replies"))
    return redundancy(messages, body).select(F.col("n_rows").alias("messages"), F.col("n_unique").alias("unique_bodies")).crossJoin(F.broadcast(shapes))  # one row each


def prioritised(threads: DataFrame, as_of: str) -> DataFrame:
    """Threads with a priority from recency, participants and messages."""
    hours = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("latest").cast("timestamp"))) / 3600
    score = F.when(hours < 1, 10.0).when(hours < 6, 5.0).when(hours < 24, 2.0).otherwise(0.0)
    score = score + F.when(F.col("participants") > 5, 2.0).when(F.col("participants") > 2, 1.0).otherwise(0.0)
    return threads.withColumn("priority", score + F.when(F.col("n_messages") > 10, 1.0).when(F.col("n_messages") > 5, 0.5).otherwise(0.0))


def components(edges: DataFrame, label: DataFrame) -> DataFrame:
    """label (x, c) with c the least class of the connected component; edges (x, y) stand in one direction.

    Each class is hooked to the least class beside it and the hooks are followed by doubling, until no class has a lesser one
    beside it. Every round at least halves the classes that can still be joined. Only tables of classes are joined, and hooks
    have one row per class.
    """
    both = written(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "merge-edges")
    while True:
        across = both.join(label, "x").join(label.select(F.col("x").alias("y"), F.col("c").alias("d")), "y").filter("d < c")
        hooks = written(across.groupBy("c").agg(F.min("d").alias("up")), "merge-hooks")
        if hooks.isEmpty():
            return label
        while True:
            further = hooks.select(F.col("c").alias("up"), F.col("up").alias("_next"))
            if hooks.join(further, "up", "left_semi").isEmpty():
                break
            hooks = written(hooks.join(further, "up", "left").select("c", F.coalesce("_next", "up").alias("up")), "merge-hooks")
        label = written(label.join(hooks, "c", "left").select("x", F.coalesce("up", "c").alias("c")), "merge-labels")


def merged_threads(heads: DataFrame, thread: str, subject: str, text: str) -> DataFrame:
    """(thread, merged_into): threads of one subject whose first texts share at least LIKE of their trigrams, joined in groups.

    Candidates are not all pairs of a subject: two sets that share LIKE of their trigrams share one among the first trigrams of
    each in the order of rarity (prefix filter), so only threads that meet in such a trigram are compared, exactly. Exact copies
    are one representative. Of those that meet in a trigram each is compared with the least one first; those that are like it are
    one class already, so only pairs with one that is not, and that lie in different classes, are compared after that. So a
    subject with very many like texts costs as many comparisons as it has texts. Groups are the connected components.
    """
    rows = heads.select(F.col(thread).alias("t"), subject_key(F.col(subject)).alias("s"), trigrams(F.col(text)).alias("g")).filter("s != '' AND size(g) > 0")
    same = rows.withColumn("h", F.xxhash64("s", F.array_sort("g"))).groupBy("s", "h").agg(F.min("t").alias("rep"), F.first("g").alias("g"))
    reps = written(same, "merge-reps")
    rarity = reps.select("s", F.explode("g").alias("q")).groupBy("s", "q").agg(F.count(F.lit(1)).alias("n"))
    ranked = reps.select("s", "rep", F.size("g").alias("size"), F.explode("g").alias("q")).join(rarity, ["s", "q"])
    w = Window.partitionBy("s", "rep").orderBy("n", "q")
    prefix = written(ranked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.col("size") - F.ceil(F.col("size") * LIKE) + 1).select(F.struct("s", "q").alias("meet"), "rep"), "merge-prefix")
    sets = reps.select("rep", "g")

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that are as like as they must be."""
        both = pairs.join(sets.select(F.col("rep").alias("x"), F.col("g").alias("gx")), "x").join(sets.select(F.col("rep").alias("y"), F.col("g").alias("gy")), "y")
        return both.filter(jaccard(F.col("gx"), F.col("gy")) >= LIKE).select("x", "y")

    leaders = prefix.groupBy("meet").agg(F.min("rep").alias("x"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    members = written(routed_join(prefix, leaders, "meet", "_n").filter("rep != x").select("meet", "x", F.col("rep").alias("y")), "merge-members")
    near = written(alike(members.select("x", "y").distinct()), "merge-near")
    label = written(components(near, reps.select(F.col("rep").alias("x"), F.col("rep").alias("c"))), "merge-labels")
    alone = members.join(near, ["x", "y"], "left_anti").select("meet", F.col("y").alias("u"))
    others = alone.join(prefix, "meet").filter("u != rep").select(F.least("u", "rep").alias("x"), F.greatest("u", "rep").alias("y")).distinct()
    apart = others.join(label, "x").join(label.select(F.col("x").alias("y"), F.col("c").alias("d")), "y").filter("c != d").select("x", "y")
    label = components(alike(apart), label)
    member = rows.withColumn("h", F.xxhash64("s", F.array_sort("g"))).select("t", "s", "h").join(reps.select("s", "h", "rep"), ["s", "h"])
    return member.join(label.select(F.col("x").alias("rep"), F.col("c").alias("merged_into")), "rep").select(F.col("t").alias(thread), "merged_into")
