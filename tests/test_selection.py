"""Selection against a plain reading of its rules: budgets that bite, full threads, repeated places, groups that choose nothing."""

import random

from postkiln.operators import selection
from postkiln.operators.selection import Quotas

SCHEMA = "g int, k int, t string, s double, token_count int, addressed_to_me boolean, n_dates int, sender_rank int"


def plain_choice(rows, q):
    """Every bucket over every row, as the rules say it; rows are (key, thread, tokens, addressed, n_dates, rank, score)."""
    taken, order, left, threads = {}, [], q.tokens, {}

    def enter(r, bucket, free):
        nonlocal left
        taken[r[0]] = bucket
        order.append(r[0])
        threads[r[1]] = threads.get(r[1], 0) + 1
        if r[2] <= left:
            left -= r[2]

    seen = []
    for r in rows:
        if len(seen) < q.threads_top and r[1] not in seen and r[0] not in taken and r[2] <= left:
            enter(r, "threads_top", False)
            seen.append(r[1])
    for name, most, test, sure in (("addressed", q.addressed, lambda r: r[3], True), ("dates", q.dates, lambda r: r[4] > 0, True), ("critical", q.critical, lambda r: r[5] >= 2, False)):
        n = 0
        for r in filter(test, rows):
            if r[0] in taken:
                n += n < most
                continue
            if n >= most:
                break
            if threads.get(r[1], 0) < q.per_thread and (r[2] <= left or (sure and n == 0)):
                enter(r, name, True)
                n += 1
    for r in rows:
        if len(taken) < q.total and r[0] not in taken and threads.get(r[1], 0) < q.per_thread and r[2] <= left:
            enter(r, "remainder", False)
    return taken


def random_rows(r, n, sizes):
    rows = []
    for i in range(n):
        rows.append((i, f"t{r.randrange(max(1, n // 6))}", r.choice(sizes), r.random() < 0.2, r.randrange(3) * (r.random() < 0.2), 1 + (r.random() < 0.1), float(r.randrange(40))))
    return rows


def test_runs_equal_a_plain_reading(spark):
    r = random.Random(4)
    data, want = [], {}
    for g in range(40):
        q = Quotas(tokens=700, threads_top=4, addressed=3, dates=3, critical=2, total=9, per_thread=2)
        rows = random_rows(r, r.choice([0, 1, 7, 60, 400]), r.choice([[50, 60], [40, 90, 300, 650], [900], list(range(1, 400))]))
        if g % 5 == 0:
            rows = [(k, t, n, a, d, c, 1.0) for k, t, n, a, d, c, _ in rows]  # ties throughout
        ordered = sorted(rows, key=lambda x: (-x[6], x[0]))
        want[g] = plain_choice(ordered, q)
        data += [(g, k, t, s, n, a, d, c) for k, t, n, a, d, c, s in rows]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {}
    for x in selection.selected(df, "g", "k", "t", "s", q).collect():
        got.setdefault(x["g"], {})[x["k"]] = x["bucket"]
    assert got == {g: w for g, w in want.items() if w}
    few = selection.contenders(df, "g", "k", "t", "s", q).count()
    assert few < df.count()


def test_shrinking_stages():
    q = Quotas(critical=1, dates=1, addressed=1, per_thread=2)
    row = lambda k, t, n, me=False, d=0, rank=1, s=0.0: ((k, t, n, me, d, rank, s), "x")
    chosen = [row(1, "a", 100, s=9), row(2, "b", 100, s=8), row(3, "c", 100, me=True, s=1), row(4, "d", 100, me=True, s=2), row(5, "e", 100, d=1, s=0.5)]
    keys = lambda some: {r[0] for r, _ in some}
    assert keys(selection.shrink(chosen, 500, q)) == {1, 2, 3, 4, 5}
    assert keys(selection.shrink(chosen, 400, q)) == {1, 3, 4, 5}  # the remainder gives way, best first back
    assert keys(selection.shrink(chosen, 250, q)) == {4, 5}  # then those beyond a quota, lowest first
    assert keys(selection.shrink(chosen, 50, q)) == {4, 5}  # quotas are kept even beyond the budget
    same = [row(k, "t", 100, me=True, s=float(k)) for k in range(4)]
    assert keys(selection.shrink(same, 250, Quotas(per_thread=2, addressed=8))) == {2, 3}  # the cap of a thread


def test_odd_rows(spark):
    rows = [(1, 1, "t", 5.0, 9000, False, 0, 1), (2, 1, None, None, None, None, None, None), (2, None, "t", 1.0, 10, True, 1, 2), (3, 1, "t", 2.0, 10, True, 0, 1), (3, 1, "t", 2.0, 10, True, 0, 1)]
    got = {(x["g"], x["k"]) for x in selection.selected(spark.createDataFrame(rows, SCHEMA), "g", "k", "t", "s").collect()}
    assert got == {(2, 1), (3, 1)}
    assert selection.selected(spark.createDataFrame([], SCHEMA), "g", "k", "t", "s").count() == 0
    text = spark.createDataFrame([("run", "ev-1", "t", 1.0, 9000, False, 0, 1)], SCHEMA.replace("g int, k int", "g string, k string"))
    assert selection.selected(text, "g", "k", "t", "s").count() == 0


def test_selection_reaches_past_oversized_rows(spark):
    """The fourth row of a thread enters where the first three do not fit the budget."""
    rows = [(1, k, "t", 10.0 - k, 9000 if k < 3 else 100, False, 0, 1) for k in range(4)]
    assert [r["k"] for r in selection.selected(spark.createDataFrame(rows, SCHEMA), "g", "k", "t", "s").collect()] == [3]


def test_metrics(spark):
    rows = [(1, k, f"t{k}", 10.0 - k, 100, k == 1, 0, 1) for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_verbs")
    q = Quotas(tokens=150)
    m = selection.selection_metrics(df, selection.selected(df, "g", "k", "t", "s", q), "g", "k", "t").first()
    assert (m["n_considered"], m["n_selected"], m["in_threads_top"], m["in_addressed"], m["covered_threads"], m["discarded_action_like"]) == (3, 2, 1, 1, 2, 1)
