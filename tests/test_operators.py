import random

import pytest
from pyspark.sql import functions as F

from postkiln.functions import html, lemmas, quotes, signals
from postkiln.functions import text as tx
from postkiln.operators import actions, digest, evaluation, evidence, threads
from postkiln.sources import snapshots
from postkiln.streaming import mail


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("subject,key", [("RE: Fwd: Ответ: [JIRA-1] План (срочно)", "план"), ("Re[2]: a  b", "a b"), ("[External] Note", "note"), ("“Q” — x", '"q" - x'), ("", ""), (None, None)])
def test_subject_key(spark, subject, key):
    assert one(spark, subject, tx.subject_key) == key


def test_truncation_keeps_characters_whole(spark):
    for n in range(4, 12):
        out = one(spark, "жжжжжжжж", lambda c, n=n: tx.truncate_bytes(c, n, ""))
        assert out == "ж" * (n // 2)


def test_sentence_cut(spark):
    assert one(spark, "One two. Three four five six", lambda c: tx.cut_at_sentence(c, 14)) == "One two."
    assert one(spark, "One two three four", lambda c: tx.cut_at_sentence(c, 14)) == "One two..."


def test_reply_parts():
    assert tx.split_reply('ok {"a": "}{", "b": {"c": 1}} rest') == ('{"a": "}{", "b": {"c": 1}}', "rest")


def test_action_words(spark):
    assert one(spark, "Не могли бы вы проверить срок? Please REVIEW overdue", signals.action_words) == ["могли бы", "не могли бы", "проверить", "срок", "please", "review"]


def test_lemmas():
    assert [lemmas.lemma(w) for w in ("checking", "studied", "merged", "fixes", "проверьте", "сделайте", "согласуйте", "стол")] == ["check", "study", "merge", "fix", "проверить", "сделать", "согласовать", "стол"]


def test_html():
    page = "<div>A<script>x</script><p style='visibility:hidden'>no</p><ol><li>one</li><li></li><li>two</li></ol><table><tr><th>h</th><th>k</th></tr><tr><td>1</td></tr></table></div>"
    assert html.to_text(page) == "A\n1. one\n3. two\n\n| h | k |\n|---|---|\n| 1 |  |"


def test_quotes():
    note = quotes.HEAD_NOTE
    assert quotes.without_quotes("New\n\nOn 1 May A wrote:\n> first\n> second\n>> deep\n") == f"New\n\n{note}\n> first\n> second"
    # header lines between the head and its prefixes, a second level, and a long line that is new again
    text = "Hi\nFrom: A\nTo: B\n\n> one\n> \n> two\n> > three\nshort rest\nthis line is long enough to be something that was newly written below it"
    assert quotes.without_quotes(text) == f"Hi\n{note}\n> one\n> two\n\nthis line is long enough to be something that was newly written below it"
    # two paragraphs, ten lines, orphan prefixes, a forwarding mark
    assert quotes.without_quotes("On 1 May A wrote:\n> a\n>\n> b\n>\n> c") == f"{note}\n> a\n> b"
    assert quotes.without_quotes("On 1 May A wrote:\n" + "\n".join(f"> l{i}" for i in range(15))).count("> l") == quotes.HEAD_LINES
    assert quotes.without_quotes("x\n> orphan\ny") == "x" and quotes.without_quotes("x\n-----Original Message-----\nFrom: q\nbody") == "x"
    assert quotes.without_quotes("a\n> b\n>>> c\nfirst after\nkept", keep_head=False) == "a\nkept"
    assert quotes.without_quotes("a\n> b\n>>>>>> too deep\nnext", keep_head=False) == "a\n>>>>>> too deep\nnext"
    assert quotes.main_content("From: a\nTo: b\n\nBody that is new\n> q").endswith("Body that is new")


def test_chunks_are_slices(spark):
    r = random.Random(1)
    body = "\n\n".join(" ".join(r.choice(["alpha", "beta.", "gamma"]) for _ in range(r.randrange(5, 600))) for _ in range(9))
    for start, part in evidence.chunk_body(body, most=100):
        assert body[start : start + len(part)] == part
    assert evidence.chunk_body("short") == []
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "k int, b string")
    assert {x["k"] for x in evidence.chunks(df, "k", "b").collect()} == {1}


def test_merged_threads_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    heads = [(f"t{i}", "Re: S%d" % (i % 3), " ".join(r.choice(words) for _ in range(6)) if i % 4 else "the same long text again and again") for i in range(60)] + [("n1", None, "x y z"), ("n2", "S1", None), ("n3", "S1", "")]
    sets = {t: ({x.lower()[i : i + 3] for i in range(len(x) - 2)}, s) for t, s, x in ((t, s, (x or "")[:200]) for t, s, x in heads) if x and s}
    group = {t: t for t in sets}

    def root(t):
        while group[t] != t:
            t = group[t]
        return t

    for a in sets:
        for b in sets:
            if a < b and sets[a][1] == sets[b][1] and len(sets[a][0] & sets[b][0]) / len(sets[a][0] | sets[b][0]) >= threads.LIKE:
                group[max(root(a), root(b))] = min(root(a), root(b))
    got = {x["t"]: x["merged_into"] for x in threads.merged_threads(spark.createDataFrame(heads, "t string, s string, x string"), "t", "s", "x").collect()}
    assert {t: root(t) for t in sets} == got


def test_merged_threads_joins_a_long_chain(spark):
    """Sixty heads of which only neighbours are alike, with shuffled names, are one class."""
    text = "".join(chr(0x4E00 + i) for i in range(160))
    names = [f"t{i:02}" for i in range(60)]
    random.Random(3).shuffle(names)
    heads = [(n, "S", text[i : i + 12]) for i, n in enumerate(names)]
    got = {x["merged_into"] for x in threads.merged_threads(spark.createDataFrame(heads, "t string, s string, x string"), "t", "s", "x").collect()}
    assert got == {"t00"}


def test_actions_and_backing(spark):
    mails = spark.createDataFrame([(1, "Hello Bob. Could you review the plan by 01/15? We met today in the hall."), (2, None)], "k int, b string")
    got = actions.actions(mails, "k", "b", signals.mention_aliases(["bob@x.example"]))
    rows = {x["sentence_no"]: x for x in got.collect()}
    assert rows[1]["action_type"] == "question" and rows[1]["verb"] == "answer" and rows[1]["deadline"].lower() == "by 01/15"
    chunks = spark.createDataFrame([(1, "ev-1", 0, "Hello Bob."), (1, "ev-2", 1, "Could you review the plan by 01/15?")], "k int, evidence_id string, chunk_idx int, content string")
    assert {x["sentence_no"]: x["evidence_id"] for x in actions.backed(got, chunks, "k").collect()}[1] == "ev-2"


def test_grades(spark):
    items = spark.createDataFrame([("d", 1, "a", "e1", 0.9, None), ("d", 2, "A ", "zz", 1.4, "soon"), ("d", 3, None, None, None, "today")], "digest string, id int, title string, evidence_id string, confidence double, due string")
    found = evaluation.issues(items, spark.createDataFrame([("e1",)], "evidence_id string"), "digest", "id", F.lit(True))
    checks = sorted((r["id"], r["check"]) for r in found.collect())
    assert checks == [(2, "confidence out of range"), (2, "due date form"), (2, "evidence_id unknown"), (2, "title repeated"), (3, "confidence missing"), (3, "evidence_id missing")]
    g = evaluation.graded(items, found, "digest", "id").first()
    assert (g["errors"], g["warnings"], g["clean_items"], g["score"], g["grade"]) == (4, 2, 1, 54, "D")


def test_message_parts():
    r = random.Random(2)
    text = "\n\n".join("x" * r.randrange(1, 90) for _ in range(40))
    parts = digest.message_parts(text, 60)
    assert all(len(p) <= 60 for p in parts) and "".join(p.split("\n", 1)[1].replace("\n", "") for p in parts) == text.replace("\n", "")


def test_snapshots_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m1", "c", "2024-01-01", "A@x", None, None, "s", "b", ["X"], None, None, None, None, ["PDF", "pdf"])], snapshots.MESSAGE)
    snapshots.write_snapshot(df, str(tmp_path / "s"))
    assert snapshots.read_snapshot(spark, str(tmp_path / "s")).first()["msg_id"] == "m1"
    (tmp_path / "one.json").write_text('{"meta": {}, "messages": [{"msg_id": "a"}, {"msg_id": "b"}]}')
    (tmp_path / "bare.json").write_text('[{"msg_id": "a"}]')
    assert snapshots.read_snapshot(spark, str(tmp_path / "one.json"), True).count() == 2
    assert snapshots.read_snapshot(spark, str(tmp_path / "bare.json"), True).count() == 1
    c = snapshots.canonical(df).first()
    assert (c["sender_email"], c["importance"], c["attachment_types"]) == ("a@x", "Normal", ["pdf"])
    assert snapshots.changelog("- v1 - 2024-01-01 - first\nx\n- v1.1 | 2024-02-01: second")[-1] == ("v1.1", "2024-02-01", "second")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, f"2024-01-0{1 + i % 3} 0{i % 7}:00:00", i) for i in range(60)], "k int, t string, i int").selectExpr("k", "cast(t as timestamp) AS ts", "i")
    rows.write.parquet(str(tmp_path / "in"))
    stream = mail.deduplicated(mail.message_stream(spark, str(tmp_path / "in"), rows), "k", "ts")
    mail.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).select("k").distinct().count() == 5
    again = mail.deduplicated(mail.message_stream(spark, str(tmp_path / "in"), rows), "k", "ts")
    before = spark.read.parquet(str(tmp_path / "out")).count()
    mail.run_once(again, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == before
    fresh, mark = snapshots.after_watermark(rows, "ts", "2024-01-03 00:00:00", "INTERVAL 0 HOURS")
    assert fresh.count() == rows.filter("ts > '2024-01-03'").count() and mark.first()[0] is not None


def test_lemmas_of_all_tokens(spark, tmp_path):
    import re
    from collections import Counter

    from postkiln.functions.lemmas import lemma
    from postkiln.plans.text_queries import lemma_counts

    texts = ["Review the test, reviewed and approved.", "Tests approve; проверьте письмо", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter(lemma(w) for t in texts for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
    assert {r["lemma"]: r["n"] for r in lemma_counts(spark, str(tmp_path)).collect()} == want
    assert want["review"] == want["test"] == want["approve"] == 2


def test_many_like_threads_cost_few_comparisons(spark, monkeypatch):
    """Eighty near copies of one text: pairs are as many as texts, not as their square."""
    r = random.Random(6)
    base = "status report of the nightly export of invoices to the northern warehouse with all totals listed below"
    texts = [base[:20] + "".join(r.choice("abcdefgh") for _ in range(3)) + base[23:] for _ in range(80)] + ["nothing like the others at all, a different letter"]
    df = spark.createDataFrame([(f"t{i:02}", "S", x) for i, x in enumerate(texts)], "t string, s string, x string")
    seen, kept = {}, threads.written
    monkeypatch.setattr(threads, "written", lambda d, label: seen.setdefault(label, []).append(out := kept(d, label)) or out)
    got = {x["t"]: x["merged_into"] for x in threads.merged_threads(df, "t", "s", "x").collect()}
    assert got == {f"t{i:02}": "t00" for i in range(80)} | {"t80": "t80"}
    assert sum(e.count() for e in seen["merge-edges"]) < 8 * 80
