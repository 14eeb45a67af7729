"""Runs: what is known of each, finding one again, whether it need be done, retries of what the outside refuses."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkiln.functions.text import sanitized

#: Attempts, first and longest wait in seconds of a retried call; hours within which a finished run is not done again.
ATTEMPTS, FIRST_WAIT_S, LONGEST_WAIT_S, FRESH_HOURS = 8, 0.5, 60.0, 48

RUN = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("trace_id", "digest_date", "status")], T.StructField("partial", T.BooleanType()), T.StructField("citation_validation_ok", T.BooleanType()), T.StructField("finished_at", T.TimestampType()),
    T.StructField("stage_durations_ms", T.MapType(T.StringType(), T.LongType())), T.StructField("pipeline_metrics", T.MapType(T.StringType(), T.LongType())), T.StructField("artifacts", T.MapType(T.StringType(), T.StringType())), T.StructField("config", T.StringType()),
])


def run_record(spark: SparkSession, trace_id: str, digest_date: str, finished_at: object, stages: dict[str, int], counts: dict[str, int], artifacts: dict[str, str], config: dict, partial: bool = False, citations_ok: bool = True, failed: bool = False) -> DataFrame:
    """One row of the table of runs; secrets of the settings are hidden."""
    import json

    status = "failed" if failed else "partial" if partial else "ok"
    return spark.createDataFrame([(trace_id, digest_date, status, partial, citations_ok, finished_at, stages, counts, artifacts, json.dumps(sanitized(config), ensure_ascii=False, sort_keys=True))], RUN)


def append_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)


def latest_run(runs: DataFrame, trace_id: str | None = None, digest_date: str | None = None) -> DataFrame:
    """The newest run of a trace, of a day, or of all; no row where there is none."""
    found = runs if trace_id is None else runs.filter(F.col("trace_id") == trace_id)
    found = found if digest_date is None else found.filter(F.col("digest_date") == digest_date)
    return found.orderBy(F.col("finished_at").desc_nulls_last(), F.col("trace_id")).limit(1)


def days_to_do(days: DataFrame, runs: DataFrame, as_of: str, fresh_hours: int = FRESH_HOURS) -> DataFrame:
    """Days (digest_date) that have no whole run younger than ``fresh_hours``."""
    young = F.col("finished_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(fresh_hours)} HOURS")
    return days.join(runs.filter(young & (F.col("status") != "failed")).select("digest_date").distinct(), "digest_date", "left_anti")


def resolved_date(day: str, today: str) -> str:
    """A day as YYYY-MM-DD; 'today' is the day given as such. Anything else is an error."""
    import datetime

    return today if day == "today" else datetime.datetime.strptime(day, "%Y-%m-%d").strftime("%Y-%m-%d")


def retried(call: Callable[[], object], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT_S, longest: float = LONGEST_WAIT_S, errors: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep, seed: int | None = None) -> object:
    """The result of a call that may fail for a while; waits double up to the longest. Within jobs Spark's own retries of tasks do this."""
    spread = random.Random(seed)
    for n in range(attempts):
        try:
            return call()
        except errors:
            if n + 1 == attempts:
                raise
            sleep(min(longest, first_wait * 2**n) * (1.0 if seed is None else 0.5 + spread.random() / 2))
    raise ValueError("attempts must be at least 1")


def observed(df: DataFrame, stage: str, **counters: object) -> tuple[DataFrame, Observation]:
    """df and an observation of it: rows, and further aggregates by name, counted while the stage runs and not by a pass of their own."""
    watch = Observation(stage)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counters.items()]), watch


# Upper bounds of the buckets of latencies, in milliseconds.
LATENCY_MS = (10, 50, 100, 250, 500, 1000, 2500, 5000)


def latency_histogram(calls: DataFrame, group: str, latency: str) -> DataFrame:
    """(group, le, n): calls of at most so many milliseconds, one row per bound and one for all of them (le null)."""
    counts = [F.sum(F.when(F.col(latency) <= b, 1).otherwise(0)).alias(str(b)) for b in LATENCY_MS]
    wide = calls.filter(F.col(latency).isNotNull()).groupBy(group).agg(*counts, F.count(F.lit(1)).alias("all"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(str(b)).alias("n")) for b in LATENCY_MS], F.struct(F.lit(None).cast("int").alias("le"), F.col("all").alias("n")))
    return wide.select(group, F.inline(rows))
