"""Grading digests: issues per item, score and grade per digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of confidence, points off per severity, and least scores of the grades.
LEAST_CONFIDENCE, WARN_ACTIONS, POINTS, GRADES = 0.5, 0.7, {"error": 10, "warn": 3}, ((90, "A"), (75, "B"), (60, "C"))


def _issue(when: Column, severity: str, check: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check")))


def issues(items: DataFrame, evidence: DataFrame, digest: str, key: str, action_section: Column) -> DataFrame:
    """(digest, key, severity, check) of every fault of every item.

    items has evidence_id, confidence (number), title, due and the key, which also orders them. A repeated title is a fault of
    all but the first item of a digest; the first is found by an aggregate, so that a large digest is not sorted.
    """
    known = evidence.select(F.col("evidence_id").alias("_e")).filter("_e IS NOT NULL").distinct()
    named = F.nullif(F.lower(F.trim("title")), F.lit(""))
    rows = items.withColumn("_title", named)
    firsts = rows.filter("_title IS NOT NULL").groupBy(digest, "_title").agg(F.min(key).alias("_first"))
    joined = rows.join(known, rows["evidence_id"] == F.col("_e"), "left").join(firsts, [digest, "_title"], "left")
    c = F.col("confidence")
    faults = F.array_compact(F.array(
        _issue(F.coalesce(F.trim("evidence_id"), F.lit("")) == "", "error", "evidence_id missing"),
        _issue((F.coalesce(F.trim("evidence_id"), F.lit("")) != "") & F.col("_e").isNull(), "error", "evidence_id unknown"),
        _issue(c.isNull(), "error", "confidence missing"),
        _issue((c < 0) | (c > 1), "error", "confidence out of range"),
        _issue(c.between(0, 1) & (c < LEAST_CONFIDENCE), "warn", "confidence low"),
        _issue(c.between(LEAST_CONFIDENCE, 1) & (c < WARN_ACTIONS) & action_section, "warn", "confidence low for an action"),
        _issue(F.col("_first") != F.col(key), "warn", "title repeated"),
        _issue(F.col("due").isNotNull() & ~F.col("due").rlike(r"^(?:today|tomorrow|\d{4}-\d{2}-\d{2})$"), "warn", "due date form"),
    ))
    return joined.select(digest, key, F.inline(faults))


def graded(items: DataFrame, found: DataFrame, digest: str, key: str) -> DataFrame:
    """(digest, n_items, errors, warnings, clean_items, score, grade); digests without issues get 100."""
    n = items.groupBy(digest).agg(F.count(F.lit(1)).alias("n_items"))
    per = found.groupBy(digest).agg(F.sum(F.when(F.col("severity") == "error", 1).otherwise(0)).alias("errors"), F.sum(F.when(F.col("severity") == "warn", 1).otherwise(0)).alias("warnings"), F.count_distinct(F.when(F.col("severity") == "error", F.col(key))).alias("bad_items"))
    out = n.join(per, digest, "left").na.fill(0, ["errors", "warnings", "bad_items"])
    out = out.withColumn("clean_items", F.col("n_items") - F.col("bad_items")).withColumn("score", F.greatest(F.lit(0), 100 - POINTS["error"] * F.col("errors") - POINTS["warn"] * F.col("warnings")))
    grade = F.lit("D")
    for least, name in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return out.withColumn("grade", grade).withColumn("quality_rate", F.round(F.try_divide("clean_items", "n_items"), 3)).drop("bad_items")


def section_counts(items: DataFrame, digest: str, section: str) -> DataFrame:
    """(digest, section, n_items) of each section that has items."""
    return items.groupBy(digest, section).agg(F.count(F.lit(1)).alias("n_items"))


def section_issues(sections: DataFrame, digest: str, section: str, place: str, known: list[str]) -> DataFrame:
    """(digest, section, severity, check) of sections (digest, section, place, n_items) that are unknown, empty or repeated."""
    firsts = sections.groupBy(digest, section).agg(F.min(place).alias("_first"))
    joined = sections.join(firsts, [digest, section])
    faults = F.array_compact(F.array(
        _issue(~F.col(section).isin(*known), "warn", "section unknown"), _issue(F.coalesce(F.col("n_items"), F.lit(0)) == 0, "warn", "section empty"), _issue(F.col(place) > F.col("_first"), "warn", "section repeated"),
    ))
    return joined.select(digest, section, F.inline(faults))


def snapshot_evidence(snapshots: DataFrame, key: str, document: str) -> DataFrame:
    """(key, evidence_id, form): the identifiers that a snapshot (a JSON document) names, in the first form that it has.

    A list under evidence_ids, chunks with evidence_id, the texts sent to a model (ID: ev-...), and last the items of its replies.
    """
    doc = F.from_json(F.col(document), "evidence_ids array<string>, chunks array<struct<evidence_id:string>>, responses array<struct<messages:array<struct<content:string>>,data:struct<sections:array<struct<items:array<struct<evidence_id:string>>>>>>>")
    some = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    listed = some(doc["evidence_ids"])
    chunks = some(F.transform(doc["chunks"], lambda c: c["evidence_id"]))
    sent = some(F.flatten(F.transform(doc["responses"], lambda r: F.flatten(F.transform(F.filter(F.coalesce(r["messages"], F.array().cast("array<struct<content:string>>")), lambda m: m["content"].isNotNull()), lambda m: F.regexp_extract_all(m["content"], F.lit(r"\bID:\s*(ev-[a-f0-9-]+)"), F.lit(1)))))))
    replied = some(F.flatten(F.transform(F.filter(doc["responses"], lambda r: r["data"]["sections"].isNotNull()), lambda r: F.flatten(F.transform(F.filter(r["data"]["sections"], lambda s: s["items"].isNotNull()), lambda s: F.transform(s["items"], lambda i: i["evidence_id"]))))))
    forms = F.coalesce(*[F.when(F.size(a) > 0, F.struct(F.array_distinct(a).alias("ids"), F.lit(n).alias("form"))) for a, n in ((listed, "list"), (chunks, "chunks"), (sent, "prompt"), (replied, "reply"))])
    return snapshots.select(key, forms.alias("_f")).filter("_f IS NOT NULL").select(key, F.explode("_f.ids").alias("evidence_id"), F.col("_f.form").alias("form"))
