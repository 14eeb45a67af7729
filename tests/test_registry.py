"""Registered functions, budgets over split groups, deliveries with a heavy identifier, chunks with what is known of their mail."""

import random

from pyspark.sql import functions as F

from postkiln.functions import registry
from postkiln.functions import text as tx
from postkiln.operators import deliveries, evidence
from postkiln.session import intermediate_tables, remove_written, written


def test_sql_functions(spark):
    names = registry.register(spark)
    assert len(names) == len(set(names)) >= 10
    spark.createDataFrame([("Re:  a b c\n d@E.org",), ("x",), (None,)], "t string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT t, pk_token_estimate(t) AS n, pk_one_line(t) AS o, pk_domain(t) AS d, pk_lemma(t) AS l, pk_html_text(t) AS h FROM texts").collect()
    direct = spark.table("texts").select(tx.token_estimate(F.col("t")).alias("n"), tx.one_line(F.col("t")).alias("o"), tx.domain_of(F.col("t")).alias("d")).collect()
    assert [(r["n"], r["o"], r["d"]) for r in rows] == [tuple(r) for r in direct]
    assert spark.sql("SELECT pk_lemmas('Please review, approved!') AS l").first()["l"] == ["please", "review", "approve"]
    assert spark.sql("SELECT pk_confidence('High') AS c, pk_confidence('0.25') AS n, pk_confidence('x') AS z").first() == (0.9, 0.25, None)


def test_budget_over_split_groups(spark):
    r = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, r.choice([None, 1.0, 2.0, 3.0]), r.choice([None, 0, 10, 64, 300])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, s double, n int")
    want = {}
    for g in {x[0] for x in rows}:
        spent = 0
        for _, k, s, n in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[1])):
            n = n or 0
            if spent >= 2000:
                break
            if spent + n <= 2000:
                want[k] = n
            elif 2000 - spent >= evidence.MIN_TOKENS:
                want[k] = 2000 - spent
            spent += n
    for per_salt in (7, 250_000):
        got = {x["k"]: x["kept_tokens"] for x in evidence.within_budget(df, "g", "s", "n", "k", 2000, rows_per_salt=per_salt).collect()}
        assert got == want


def test_one_identifier_holds_a_third(spark):
    rows = [(i, 1 + i % 3, "<HOT@x>" if i % 3 == 0 else f"m{i // 4}" if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id int, batch_no int, msg_id string")
    kept = {r["row_id"] for r in deliveries.keep_first_delivery(df).collect()}
    surplus = {r["row_id"] for r in deliveries.surplus_deliveries(df).collect()}
    best = {}
    for i, b, m in rows:
        if m:
            best[m.strip("<>").lower()] = min(best.get(m.strip("<>").lower(), (b, i)), (b, i))
    want = {i for _, i in best.values()} | {i for i, _, m in rows if m is None}
    assert kept == want and kept | surplus == set(range(300)) and not kept & surplus


def test_chunks_of_a_loaded_run_and_their_mail(spark):
    body = "\n\n".join("alpha beta gamma delta epsilon zeta eta theta iota kappa please review by 01/02/2024 " * 8 for _ in range(14))
    mails = spark.createDataFrame([(1, body, "A@x", ["Me@x"], None, "s", "High", True, 3.0)], "k int, b string, sender_email string, to_recipients array<string>, cc_recipients array<string>, subject string, importance string, is_flagged boolean, hours_old double")
    usual, loaded = evidence.chunks(mails, "k", "b"), evidence.chunks(mails, "k", "b", n_messages=300)
    assert (usual.count(), loaded.count()) == (3, 2)
    assert evidence.most_chunks(0, 0, 10) == 12 and evidence.most_chunks(0, 60, 10) == 9
    got = evidence.with_metadata(usual, mails, "k", ["me@x"]).first()
    assert got["addressed_to_me"] and got["message_metadata"]["sender"] == "A@x" and "please" in got["action_verbs"] and got["source_ref"]["start_at"] == got["start_at"] and got["priority_score"] > 2


def test_intermediate_tables_are_removed(spark):
    remove_written(spark)
    with intermediate_tables(spark):
        df = written(spark.range(3), "a-label")
        assert df.count() == 3
        path = df.inputFiles()[0]
    import os

    assert not os.path.exists(path.removeprefix("file://").rsplit("/", 1)[0]) and remove_written(spark) == 0


def test_salted_join(spark):
    from postkiln.operators.skew import salted_join

    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 5}" if i % 3 else None) for i in range(200)], "i int, k string")
    right = spark.createDataFrame([("hot", [1, 2]), ("k1", [3]), ("k1", [4]), ("none", [5])], "k string, wide array<int>")
    want = sorted((r["i"], r["k"], tuple(r["wide"])) for r in left.join(right, "k").collect())
    for per_salt in (3, 1000):
        assert sorted((r["i"], r["k"], tuple(r["wide"])) for r in salted_join(left, right, "k", "i", rows_per_salt=per_salt).collect()) == want
