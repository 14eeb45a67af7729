"""Building blocks for keys that may hold a large part of all rows.

A key is *hot* when it is among the ``HOT_KEYS`` most frequent ones. At most that many rows are ever broadcast, so the bound
holds at any input size, and every key outside the set holds less than one HOT_KEYS-th of all rows. Routing only decides
where a row is joined; no row is dropped, capped or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most keys that are joined by broadcast.
HOT_KEYS = 256
#: Rows that one salt of a group holds on average.
ROWS_PER_SALT = 250_000


def routed_join(left: DataFrame, groups: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of left with groups (one row per key) on key; ``weight`` is a column of groups with the rows of the key in left.

    Rows of the heaviest keys meet a broadcast of at most HOT_KEYS rows, all others a shuffled join. Null keys match nothing.
    """
    hot = groups.orderBy(F.desc(weight), F.col(key)).limit(HOT_KEYS)
    mark = hot.select(F.col(key), F.lit(True).alias("_hot"))
    routed = left.join(F.broadcast(mark), key, "left")
    in_hot = routed.filter("_hot").drop("_hot").join(F.broadcast(hot), key)
    in_cold = routed.filter("_hot IS NULL").drop("_hot").join(groups, key)
    return in_hot.unionByName(in_cold)


def salt(size: str | Column, *spread: str, rows_per_salt: int = ROWS_PER_SALT) -> Column:
    """A salt from 0 for a row of a group of ``size`` rows: as many values as the group needs, by hash of the spread columns."""
    n = F.col(size) if isinstance(size, str) else size
    return F.pmod(F.xxhash64(*spread), F.greatest(F.lit(1), F.ceil(n / F.lit(rows_per_salt)))).cast("int")


def salted_join(left: DataFrame, right: DataFrame, key: str, *spread: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Inner join of left with right on key, where very many rows of left may share a key and rows of right may be wide.

    The rows of a key in left are counted; they are spread over as many salts as they need, by hash of the spread columns, and the
    rows of right are copied to those salts. So no task holds all rows of a key, and nothing wide is broadcast. Null keys match
    nothing.
    """
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    salted = routed_join(left, counts, key, "_n").withColumn("_salt", salt("_n", *spread, rows_per_salt=rows_per_salt)).drop("_n")
    last = (F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(rows_per_salt))) - 1).cast("int")
    copies = right.join(counts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_n")
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def ranked_by_range(df: DataFrame, key: str, bucket: str, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 within key, where ``bucket`` is a value that never decreases along ``order``.

    Only the rows of one (key, bucket) are sorted together; the ranks of a bucket start after the rows of the earlier buckets,
    taken from a table of counts. So a key that holds a third of all rows is still sorted in pieces of one bucket.
    """
    counts = df.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(key, bucket, (F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    within = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order)))
    return within.join(before, [key, bucket]).withColumn(name, (F.col("_before") + F.col("_rn")).cast("int")).drop("_before", "_rn")
