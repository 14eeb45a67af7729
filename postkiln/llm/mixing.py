"""Mixing sources to target weights (problem 9): capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the seeded hash within a source; only one of them per source is ever sorted.
RANGES = 4096


def water_fill(available: dict[str, float], share: dict[str, float], most: dict[str, int], budget: float | None = None) -> dict[str, float]:
    """Size to take from each source.

    Without a budget: the largest mix in which all sources that have data stand in their target proportions and none repeats
    more than its cap. With one: sources whose part exceeds their cap are clamped there and the excess goes to the others in
    proportion to their weights, until it fits or every source is at its cap.
    """
    open_ = {s for s in share if available.get(s, 0) > 0 and share[s] > 0 and most[s] > 0}
    cap = {s: available[s] * most[s] for s in open_}
    total = sum(share[s] for s in open_)
    if not open_:
        return {}
    if budget is None:
        size = min(cap[s] / (share[s] / total) for s in open_)
        return {s: min(cap[s], size * share[s] / total) for s in open_}
    taken: dict[str, float] = {}
    left = budget
    while open_:
        total = sum(share[s] for s in open_)
        over = {s for s in open_ if left * share[s] / total >= cap[s]}
        if not over:
            return taken | {s: left * share[s] / total for s in open_}
        taken |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        open_ -= over
    return taken


def mixed(sized: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "tokens", budget: float | None = None, seed: int = 7) -> DataFrame:
    """(key, source, tokens, copies) of the rows in the mix: copies is at least 1 and at most max_repeats of the source.

    ``sized`` should be a written table: it is read three times. Every row of a source appears the whole number of times; the
    fraction that remains goes to the rows first in a seeded order, up to the row that comes nearest to the size wanted. Rows of
    other or no source stay out; rows without size count as 0. Targets are a handful of rows by definition (one per source) and
    only their sums reach the driver. A source of any size is ordered in RANGES pieces of its hash: sums by piece say where the
    fraction ends, and only that piece is sorted.
    """
    wanted = targets.filter("target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most"))
    rows = sized.select(F.col(key), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("tokens"))
    rows = rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_range", F.shiftrightunsigned("_h", 52).cast("int"))
    sums = rows.join(wanted.select("source"), "source").groupBy("source", "_range").agg(F.sum("tokens").alias("_sum"))
    totals = {r["source"]: r for r in sums.groupBy("source").agg(F.sum("_sum").alias("tokens")).join(wanted, "source").collect()}
    taken = water_fill({s: float(r["tokens"]) for s, r in totals.items()}, {s: float(r["share"]) for s, r in totals.items()}, {s: int(r["most"]) for s, r in totals.items()}, budget)
    plan = []
    for s, take in taken.items():
        available = totals[s]["tokens"]
        whole = min(int(totals[s]["most"]), math.floor(take / available + 1e-12))
        plan.append((s, whole, max(0.0, take - whole * available)))
    spark = sized.sparkSession
    plan_df = spark.createDataFrame(plan, "source string, _whole int, _rest double")
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = before.join(plan_df, "source").select("source", "_range", "_before", "_whole", "_rest", (F.col("_before") + F.col("_sum") <= F.col("_rest")).alias("_in"), (F.col("_before") >= F.col("_rest")).alias("_out"))
    joined = rows.join(F.broadcast(placed), ["source", "_range"])  # at most RANGES rows for each row of targets
    clear = joined.filter("_in OR _out").withColumn("copies", F.col("_whole") + F.when(F.col("_in") & (F.col("_rest") > 0), 1).otherwise(0))
    order = Window.partitionBy("source").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.filter("NOT (_in OR _out)").withColumn("_to", F.col("_before") + F.sum("tokens").over(order))
    edge = edge.withColumn("copies", F.col("_whole") + F.when(F.col("_to") - F.col("tokens") / 2 <= F.col("_rest"), 1).otherwise(0)).drop("_to")
    return clear.unionByName(edge).filter("copies > 0").select(key, "source", "tokens", "copies")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_copies, mixed_tokens, actual_share) of every row of targets."""
    per = mix.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    out = targets.join(per, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # a handful of rows, one per target
    return out.withColumn("actual_share", F.round(F.try_divide(F.col("mixed_tokens"), whole), 6))
