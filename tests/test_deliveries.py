import random

from postkiln.operators import skew
from postkiln.operators.deliveries import keep_first_delivery, newly_arrived, surplus_deliveries

SCHEMA = "row_id bigint, batch_no int, msg_id string, extra string"


def clean(s):
    if s is None:
        return None
    s = s.strip()
    if len(s) >= 2 and s[0] == "<" and s[-1] == ">":
        s = s[1:-1]
    return s.lower() or None


def brute(rows):
    best = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        k = clean(r[2])
        if k is not None:
            best.setdefault(k, r[0])
    return {r[0] for r in rows if clean(r[2]) is not None and best[clean(r[2])] != r[0]}


def rows(seed=1, n=400):
    r = random.Random(seed)
    forms = [lambda i: f"<M{i}@X.example>", lambda i: f" m{i}@x.example", lambda i: f"m{i}@x.example\t", lambda i: None, lambda i: "", lambda i: "<>", lambda i: "<hot@x>"]
    return [(i, r.randrange(5), r.choice(forms)(r.randrange(60)), "e") for i in range(n)]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    lost = {x["row_id"] for x in surplus_deliveries(df).collect()}
    assert lost == brute(data)
    kept = keep_first_delivery(df)
    assert kept.columns == df.columns
    assert sorted(x["row_id"] for x in kept.collect()) == sorted(r[0] for r in data if r[0] not in lost)


def test_hot_key_is_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    monkeypatch.setattr(skew.salt, "__defaults__", None, raising=False)
    monkeypatch.setattr(skew.salt, "__kwdefaults__", {"rows_per_salt": 20})
    data = [(i, i % 7, "<hot>", "") for i in range(300)] + rows(2, 200)
    data = [(i, *r[1:]) for i, r in enumerate(data)]
    df = spark.createDataFrame(data, SCHEMA)
    assert {x["row_id"] for x in surplus_deliveries(df).collect()} == brute(data)


def test_equal_rows_empty_tables_and_batches(spark):
    twice = spark.createDataFrame([(1, 1, "a", "x"), (1, 1, "a", "x")], SCHEMA)
    assert keep_first_delivery(twice).count() == 1
    assert keep_first_delivery(twice.limit(0)).count() == 0
    batch = spark.createDataFrame([(5, 2, "<A>", ""), (6, 2, "b", ""), (7, 2, "B ", ""), (8, 2, None, "")], SCHEMA)
    assert sorted(r["row_id"] for r in newly_arrived(twice, batch).collect()) == [6, 8]


def test_ranks_by_range(spark):
    r = random.Random(3)
    data = [(r.choice("ab"), r.randrange(1000), i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, v int, i int").selectExpr("*", "v div 100 AS bucket")
    from pyspark.sql import functions as F

    got = {x["i"]: x["n"] for x in skew.ranked_by_range(df, "k", "bucket", [F.col("v"), F.col("i")], "n").collect()}
    for k in "ab":
        assert [got[i] for _, v, i in sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[2]))] == list(range(1, sum(x[0] == k for x in data) + 1))
