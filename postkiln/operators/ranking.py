"""Ranking of digest items by weighted features of the evidence behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postkiln.functions import signals

# Weights of the features; they are scaled to sum to 1.
WEIGHTS = {"user_in_to": 0.15, "user_in_cc": 0.05, "has_action": 0.20, "has_mention": 0.10, "has_due_date": 0.15, "sender_importance": 0.10, "thread_length": 0.05, "recency": 0.10, "has_attachments": 0.05, "has_project_tag": 0.05}
# Markers of action in titles.
MARKERS = ["please", "need to", "must", "should", "can you", "could you", "review", "approve", "пожалуйста", "нужно", "необходимо", "прошу", "сделайте", "проверьте"]


def scaled(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total else dict.fromkeys(weights, 0.0)


def has_marker(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for m in MARKERS:
        out = out | F.coalesce(low.contains(m), F.lit(False))
    return out


def has_project_tag(subject: Column) -> Column:
    return F.coalesce(subject.rlike(signals.PROJECT_TAG), F.lit(False))


def sender_importance(sender: Column, important: list[str]) -> Column:
    """1 for a listed address, 0.8 for its listed domain (@domain), 0.7 for a listed local part (name@) or a keyword of the domain, else 0.5."""
    low = F.lower(sender)
    domain = F.substring_index(low, "@", -1)
    exact = [x.lower() for x in important if "@" in x and not x.startswith("@") and not x.endswith("@")]
    out = F.when(low.isin(exact), 1.0) if exact else F.when(F.lit(False), 1.0)
    for x in (x.lower() for x in important):
        if x.endswith("@"):
            out = out.when(low.contains(x), 0.7)
    for x in (x.lower() for x in important):
        if x.startswith("@"):
            out = out.when(domain == x[1:], 0.8)
        elif "@" not in x:
            out = out.when(domain.contains(x), 0.7)
    return out.otherwise(0.5)


def item_score(features: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum of features (booleans or numbers from 0 to 1), kept within 0 and 1."""
    w = scaled(weights)
    total = F.lit(0.0)
    for name, c in features.items():
        total = total + F.coalesce(c.cast("double"), F.lit(0.0)) * w[name]
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def any_alias(recipients: Column, aliases: list[str]) -> Column:
    """Whether one of the aliases stands in one of the recipients (as a part of it)."""
    return F.coalesce(F.exists(recipients, lambda r: F.greatest(*[F.lower(r).contains(a.lower()) for a in aliases], F.lit(False))), F.lit(False)) if aliases else F.lit(False)


def features(c: dict[str, Column], aliases: list[str], important: list[str]) -> dict[str, Column]:
    """The ten features of an item: c holds found (whether its evidence is known), to, cc, title, kind ('item', 'action', 'mention' or
    another typed item), text (description or quote of typed items), due, sender, n_thread (chunks of the thread), hours_old,
    has_attachments, subject. Without known evidence an item has no features at all."""
    found = F.coalesce(c["found"], F.lit(False))
    on = lambda x: found & F.coalesce(x, F.lit(False))
    value = lambda x: F.when(found, x).otherwise(0.0)
    to = any_alias(c["to"], aliases)
    acts = F.when(c["kind"] == "item", has_marker(c["title"])).when(c["kind"] == "action", True).when(c["kind"] == "mention", False).otherwise(has_marker(c["text"]))
    return {
        "user_in_to": on(to), "user_in_cc": on(~to & any_alias(c["cc"], aliases)), "has_action": on(acts), "has_mention": on(c["kind"] == "mention"), "has_due_date": on(F.coalesce(c["due"], F.lit("")) != ""),
        "sender_importance": value(F.coalesce(F.when(F.coalesce(c["sender"], F.lit("")) != "", sender_importance(c["sender"], important)), F.lit(0.5))), "thread_length": value(F.least(F.coalesce(c["n_thread"], F.lit(1)) / 10.0, F.lit(1.0))),
        "recency": value(F.greatest(F.lit(0.0), 1 - F.coalesce(c["hours_old"], F.lit(24.0)) / 48.0)), "has_attachments": on(c["has_attachments"]), "has_project_tag": on(has_project_tag(c["subject"])),
    }


def ranked(items: DataFrame, section: str, score: str, key: str) -> DataFrame:
    """Items with their place within the section, from 1."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy(F.col(score).desc_nulls_last(), key)))


def top_share(items: DataFrame, section: str, place: str, flag: str, n: int) -> DataFrame:
    """Share of flagged items among the first n of each section."""
    return items.filter(F.col(place) <= n).groupBy(section).agg(F.round(F.avg(F.when(F.col(flag), 1.0).otherwise(0.0)), 6).alias("share"))
