"""Selecting evidence for a digest: enhanced scores, buckets with quotas, per-thread caps, a token budget, and shrinking."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postkiln.functions import signals


@dataclass(frozen=True)
class Weights:
    recency: float = 2.0
    addressed: float = 3.0
    verbs: float = 1.5
    question: float = 1.0
    dates: float = 1.5
    high: float = 2.0
    flagged: float = 1.5
    documents: float = 1.0
    rank: float = 1.0
    negative: float = -2.0


@dataclass(frozen=True)
class Quotas:
    """Places of each bucket in the order of filling, and the bounds of the whole."""

    threads_top: int = 10
    addressed: int = 8
    dates: int = 6
    critical: int = 4
    total: int = 20
    per_thread: int = 3
    tokens: int = 7000
    guaranteed: tuple[str, ...] = ("addressed", "dates")

    @property
    def reach(self) -> int:
        """Rows of one class (equal tokens and flags) that can matter: as many as can be chosen, as can lie in threads that are
        full, and as can lie in threads that the first bucket has covered."""
        chosen = self.threads_top + self.addressed + self.dates + self.critical + self.total
        return 2 * chosen + self.threads_top * self.per_thread + 1


def recency(hours: Column) -> Column:
    return F.when(hours < 1, 1.0).when(hours < 6, 0.8).when(hours < 24, 0.5).otherwise(0.2)


def enhanced_score(hours: Column, addressed: Column, n_verbs: Column, question: Column, n_dates: Column, importance: Column, flagged: Column, documents: Column, rank: Column, base: Column, negative: Column, w: Weights = Weights()) -> Column:
    on = lambda c, x: F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    return (
        recency(hours) * w.recency + on(addressed, w.addressed) + F.coalesce(n_verbs, F.lit(0)) * w.verbs + on(question, w.question) + F.coalesce(n_dates, F.lit(0)) * w.dates
        + on(importance == "High", w.high) + on(flagged, w.flagged) + on(documents, w.documents) + F.coalesce(rank, F.lit(1)) * w.rank + F.coalesce(base, F.lit(0.0)) * 0.1 + on(negative, w.negative)
    )


def has_documents(types: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(types, lambda x: F.lower(x)), F.array(*[F.lit(x) for x in signals.DOCUMENT_TYPES])), F.lit(False))


def bucket_of(rank: Column, n_dates: Column, addressed: Column) -> Column:
    """Bucket of a chunk by itself; threads_top is a matter of the whole selection."""
    return F.when(rank >= 2, "critical").when(n_dates > 0, "dates").when(F.coalesce(addressed, F.lit(False)), "addressed").otherwise("remainder")


#: (key, thread, tokens, addressed, n_dates, rank, score) of a row of evidence.
Row = tuple[object, object, int, bool, int, int, float]


def choose(rows: list[Row], q: Quotas) -> list[tuple[Row, str]]:
    """(row, bucket) of the chosen among rows in order of score; keys name a place of a message, and each is chosen once.

    Buckets are filled in turn; a row that does not fit the budget is passed over; the first of a guaranteed bucket enters even
    beyond the budget, and then costs nothing; rows chosen before count in a later bucket's quota.
    """
    chosen: dict[object, tuple[Row, str]] = {}
    per_thread: dict[object, int] = {}
    left = q.tokens

    def take(row: Row, bucket: str, beyond: bool = False, capped: bool = True) -> bool:
        nonlocal left
        key, thread, tokens = row[:3]
        if key in chosen or (capped and per_thread.get(thread, 0) >= q.per_thread) or (tokens > left and not beyond):
            return False
        chosen[key] = (row, bucket)
        per_thread[thread] = per_thread.get(thread, 0) + 1
        left -= tokens if tokens <= left else 0
        return True

    covered: set = set()
    for row in rows:
        if len(covered) >= q.threads_top:
            break
        if row[1] not in covered and take(row, "threads_top", capped=False):
            covered.add(row[1])
    for bucket, quota, fits in (("addressed", q.addressed, lambda r: r[3]), ("dates", q.dates, lambda r: r[4] > 0), ("critical", q.critical, lambda r: r[5] >= 2)):
        count = 0
        for row in rows:
            if not fits(row):
                continue
            if row[0] in chosen:
                count = min(quota, count + 1)
            elif count >= quota:
                break
            elif take(row, bucket, beyond=count == 0 and bucket in q.guaranteed):
                count += 1
    for row in rows:
        if len(chosen) >= q.total:
            break
        take(row, "remainder")
    return list(chosen.values())


def own_bucket(row: Row) -> str:
    """Bucket of a row by itself, as in ``bucket_of``."""
    return "critical" if row[5] >= 2 else "dates" if row[4] > 0 else "addressed" if row[3] else "remainder"


def shrink(chosen: list[tuple[Row, str]], tokens: int, q: Quotas) -> list[tuple[Row, str]]:
    """The chosen rows cut down to a smaller budget, in four stages, each only while they are beyond it.

    The remainder gives way first and comes back, best first, where it fits; then rows beyond the cap of their thread go; then
    those beyond their bucket's quota, critical before dates before addressed; then the lowest of all whose bucket stays at its
    quota. Buckets are those of the rows by themselves.
    """
    size = lambda some: sum(r[2] for r, _ in some)
    if size(chosen) <= tokens:
        return list(chosen)
    best = lambda c: (-c[0][6], str(c[0][0]))
    kept = [c for c in chosen if own_bucket(c[0]) != "remainder"]
    for c in sorted((c for c in chosen if own_bucket(c[0]) == "remainder"), key=best):
        if size(kept) + c[0][2] <= tokens:
            kept.append(c)
    if size(kept) > tokens:
        seen: dict[object, int] = {}
        for c in sorted(kept, key=best):
            seen[c[0][1]] = seen.get(c[0][1], 0) + 1
            if seen[c[0][1]] > q.per_thread:
                kept.remove(c)
    quota = {"critical": q.critical, "dates": q.dates, "addressed": q.addressed, "remainder": 0}
    for bucket in ("critical", "dates", "addressed"):
        for c in sorted((c for c in kept if own_bucket(c[0]) == bucket), key=best)[quota[bucket] :][::-1]:
            if size(kept) > tokens:
                kept.remove(c)
    for c in sorted(kept, key=best)[::-1]:
        bucket = own_bucket(c[0])
        if size(kept) > tokens and sum(own_bucket(x[0]) == bucket for x in kept) > quota[bucket]:
            kept.remove(c)
    return kept


def contenders(df: DataFrame, group: str, key: str, thread: str, score: str, q: Quotas) -> DataFrame:
    """The rows that ``choose`` can reach, found natively, so that the fold of a run of any size holds few rows.

    Rows of one class (tokens, flags) are passed over for the same reasons: if one does not fit the budget no later one will.
    So of a class and thread only the first per_thread rows can be chosen, and of a class only the first ``reach`` rows. Token
    counts beyond the budget are one class. The limits are row_number limits, which keep no more than that in any task.
    """
    tokens = F.greatest(F.lit(0), F.coalesce(F.col("token_count"), F.lit(0)))
    flags = [F.coalesce(F.col("addressed_to_me"), F.lit(False)), F.coalesce(F.col("n_dates") > 0, F.lit(False)), F.coalesce(F.col("sender_rank") >= 2, F.lit(False))]
    classed = df.withColumn("_class", F.struct(F.least(tokens, F.lit(q.tokens + 1)), *flags))
    order = [F.col(score).desc_nulls_last(), F.col(key)]
    unique = classed.withColumn("_n", F.row_number().over(Window.partitionBy(group, key).orderBy(F.col(score).desc_nulls_last()))).filter("_n = 1")
    near = unique.withColumn("_n", F.row_number().over(Window.partitionBy(group, thread, "_class").orderBy(*order))).filter(F.col("_n") <= q.per_thread)
    return near.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_class").orderBy(*order))).filter(F.col("_n") <= q.reach).drop("_n", "_class")


def selected(df: DataFrame, group: str, key: str, thread: str, score: str, quotas: Quotas = Quotas(), shrink_to: int | None = None) -> DataFrame:
    """(group, key, bucket) of the evidence chosen for each group (a mailbox's run).

    The choice is a fold in order of score, then key, over the ``contenders`` of a group, without their texts. Rows without key
    are left out; null scores come last; null counts and flags are 0 and false; a group in which nothing is chosen gives no rows.
    """
    few = contenders(df.filter(F.col(key).isNotNull()).select(group, key, thread, score, "token_count", "addressed_to_me", "n_dates", "sender_rank"), group, key, thread, score, quotas)
    clean = few.select(
        group, key, thread, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("_score"), F.greatest(F.lit(0), F.coalesce("token_count", F.lit(0))).cast("int").alias("_tokens"),
        F.coalesce("addressed_to_me", F.lit(False)).alias("_me"), F.coalesce("n_dates", F.lit(0)).cast("int").alias("_dates"), F.coalesce("sender_rank", F.lit(1)).cast("int").alias("_rank"),
    )
    g_kind, k_kind = (df.schema[c].dataType.simpleString() for c in (group, key))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_score", key], ascending=[False, True])
        rows = list(zip(*(pdf[c].tolist() for c in (key, thread, "_tokens", "_me", "_dates", "_rank", "_score"))))
        chosen = choose(rows, quotas)
        if shrink_to is not None:
            chosen = shrink(chosen, shrink_to, quotas)
        return pd.DataFrame({group: pdf[group].iloc[: len(chosen)].to_numpy(), key: pd.Series([r[0] for r, _ in chosen], dtype=pdf[key].dtype), "bucket": pd.Series([b for _, b in chosen], dtype=object)})

    return clean.groupBy(group).applyInPandas(run, f"{group} {g_kind}, {key} {k_kind}, bucket string")


def selection_metrics(considered: DataFrame, chosen: DataFrame, group: str, key: str, thread: str) -> DataFrame:
    """(group, n_considered, n_selected, one count per bucket, covered_threads, budget_used, discarded_action_like) of each run.

    Considered rows that were not chosen and hold an action word, a date or an address to the user are discarded as action-like.
    """
    marked = considered.join(chosen.select(group, key, "bucket"), [group, key], "left")
    on = lambda c: F.sum(F.when(c, 1).otherwise(0))
    picked = F.col("bucket").isNotNull()
    like = F.coalesce((F.col("n_verbs") > 0) | (F.col("n_dates") > 0) | F.col("addressed_to_me"), F.lit(False))
    return marked.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_considered"), on(picked).alias("n_selected"), *[on(F.coalesce(F.col("bucket") == b, F.lit(False))).alias(f"in_{b}") for b in ("threads_top", "addressed", "dates", "critical", "remainder")],
        F.count_distinct(F.when(picked, F.col(thread))).alias("covered_threads"), F.sum(F.when(picked, F.coalesce("token_count", F.lit(0))).otherwise(0)).alias("budget_used"), on(~picked & like).alias("discarded_action_like"),
    )


# Markers of the plain scorer, and local parts of senders with their weights.
PLAIN_MARKERS = ["urgent", "важно", "meeting", "встреч", "review", "approve", "action", "please"]
PLAIN_SENDERS = {"ceo@": 2.0, "director@": 2.0, "manager@": 1.0, "lead@": 1.0}


def is_service_mail(subject: Column, sender: Column) -> Column:
    return signals.is_negative(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(sender, F.lit(""))))


def plain_score(subject: Column, sender: Column, n_messages: Column) -> Column:
    """Markers found in subject and sender, less one for service mail, plus the sender's weight, plus one for a live thread."""
    low = F.lower(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(sender, F.lit(""))))
    score = sum((F.when(low.contains(m), 1.0).otherwise(0.0) for m in PLAIN_MARKERS), F.lit(0.0)) - F.when(is_service_mail(subject, sender), 1.0).otherwise(0.0)
    who = F.lower(F.coalesce(sender, F.lit("")))
    weight = F.lit(0.0)
    for part, worth in reversed(PLAIN_SENDERS.items()):
        weight = F.when(who.contains(part), worth).otherwise(weight)
    return score + weight + F.when(n_messages > 1, 1.0).otherwise(0.0)
