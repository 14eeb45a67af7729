"""Cleaning, citations, actions, replies, reports and runs on small cases."""

import datetime
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from postkiln.functions import cleaner, signals
from postkiln.functions import text as tx
from postkiln.operators import actions, citations, evaluation, replies, reports, threads
from postkiln.sources import runs, snapshots


def test_cleaner_steps(spark):
    rows = [
        (1, "Hi\r\nOut of Office until Monday\nBody\n\n\nThanks\n---\nConfidentiality note\nrest"), (2, "A\nBest regards,\nBob\n> q"), (3, "Text\nOn 1 May A wrote:\n> old"), (4, None), (5, ""), (6, "x\n12:00:00 DEBUG z\ny  z"),
        (7, "Unsubscribe " + "z" * 50 + "\nkept\nPrivacy policy"), (8, "automatic reply " + "y" * 60 + "\nfine"),
    ]
    got = {r["k"]: r for r in cleaner.with_clean_body(spark.createDataFrame(rows, "k int, t string"), "t", blacklist=[r"^\d\d:\d\d:\d\d DEBUG"], longest=40).collect()}
    assert got[1]["clean"] == "Hi\n\nBody\n\nThanks" and [s["type"] for s in got[1]["removed_spans"]] == ["autoresponse", "disclaimer"]
    assert (got[2]["clean"], got[2]["removed_spans"][0]["content"]) == ("A", "Best regards,\nBob\n> q")
    assert (got[3]["clean"], got[3]["removed_spans"][0]["start"]) == ("Text", 5)
    assert got[4]["clean"] is None and got[4]["removed_spans"] == [] and got[5]["clean"] == ""
    assert got[6]["clean"] == "x\ny z"
    assert got[7]["clean"].endswith("kept") and got[7]["clean"].startswith("Unsubscribe")  # the first block is too long, the next is not
    assert got[8]["clean"].startswith("automatic reply")


def test_citations_map_back(spark):
    mails = spark.createDataFrame([("m", "😀 one\ntwo  three alpha \n beta (x)"), ("n", "")], "id string, body string")
    rows = [("m", "one\ntwo"), ("m", "alpha beta (x)"), ("m", "one   two three"), ("m", "absent"), ("x", "one"), ("m", None), ("m", " "), ("n", "q")]
    cited = citations.cited(spark.createDataFrame(rows, "id string, c string"), mails, "id", "c", "body")
    got = {r["c"]: r for r in cited.collect()}
    body = "😀 one\ntwo  three alpha \n beta (x)"
    assert (got["one\ntwo"]["start_at"], got["one\ntwo"]["exact"]) == (2, True)
    for c in ("alpha beta (x)", "one   two three"):
        r = got[c]
        assert not r["exact"] and body[r["start_at"] : r["end_at"]].split() == c.split() and r["preview"] == body[r["start_at"] : r["end_at"]]
    assert got["absent"]["start_at"] is None and got[None]["start_at"] is None and got[" "]["start_at"] is None
    checked = citations.checked(cited.filter("start_at IS NOT NULL"), mails, "id", "body")
    assert {r["problem"] for r in checked.collect()} == {None}
    bad = checked.withColumn("end_at", F.lit(900)).drop("problem")
    assert {r["problem"] for r in citations.checked(bad, mails, "id", "body").collect()} == {"beyond the body"}
    with_ids = checked.withColumns({"evidence_id": F.lit("e1"), "chunk_id": F.monotonically_increasing_id()}).withColumnRenamed("id", "msg_id")
    items = spark.createDataFrame([("d", 1, "e1"), ("d", 2, "system"), ("d", 3, "e9"), ("e", 4, "system"), ("e", 5, None)], "digest string, item_id int, evidence_id string")
    attached = citations.attached(items, with_ids)
    assert {r["item_id"]: (len(r["citations"] or []), r["citation_ok"]) for r in attached.collect()} == {1: (3, True), 2: (0, True), 3: (0, False), 4: (0, True), 5: (0, False)}
    assert {r["digest"]: (r["ok"], r["n_bad"], r["first_bad"]) for r in citations.digest_verdicts(attached, "digest", "item_id").collect()} == {"d": (False, 1, 3), "e": (False, 1, 5)}


def test_actions_gold(spark):
    aliases = signals.mention_aliases(["ivan.petrov@x.example"])
    cases = {
        "Please review the contract before Friday": ("action", "Please"), "Ivan, review the numbers again.": ("action", "review"), "Where is the report now": ("question", "answer"), "Нужно обновить отчёт до 15.01": ("action", "обнови"),
        "Проверьте договор сегодня.": ("action", "Проверьте"), "Checked yesterday, all fine here.": None, "Petrov joined the call late.": ("mention", "mentioned"), "The petrov team joined late.": None, "Schedules the quarterly catch-up": ("action", "schedule"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {r["k"]: r for r in actions.actions(df, "k", "t", aliases).collect()}
    for k, (sentence, want) in enumerate(cases.items()):
        assert (k in got) == (want is not None), sentence
        if want:
            assert (got[k]["action_type"], got[k]["verb"]) == want, sentence
            assert (got[k]["start_at"], got[k]["end_at"]) == (0, len(sentence))


def test_action_offsets_ranks_and_confidence(spark):
    text = "We met today in the hall.  Please send it!\nPlease send it! Ещё раз: пришлите файл 😀. Please send it!"
    df = spark.createDataFrame([(1, text, " Boss@x "), (2, None, "boss@x")], "k int, t string, s string")
    ranks = spark.createDataFrame([("boss@x", 0.9), ("boss@X", 0.4)], "sender string, sender_rank double")
    got = actions.actions(df, "k", "t", [], ranks=ranks, sender="s").orderBy("start_at").collect()
    assert len({r["start_at"] for r in got}) == len(got) >= 3
    for r in got:
        assert text[r["start_at"] : r["end_at"]].strip() == r["sentence"]
    first = next(r for r in got if r["sentence"].startswith("Please"))
    assert first["confidence"] == pytest.approx(1 / (1 + math.exp(1.5 - (1.2 + 1.0 + 0.5 * 0.9))), abs=1e-6)


def test_replayed_calls_and_budget(spark):
    calls = spark.createDataFrame([(0, "a"), (1, "b")], "call_no int, run string")
    said = spark.createDataFrame([(0, "x"), (1, None)], "call_no int, reply string")
    assert {r["call_no"]: r["reply"] for r in replies.replayed(calls, said).collect()} == {0: "x", 1: None}
    with pytest.raises(Exception, match="recording exhausted"):
        replies.replayed(calls, said.limit(1)).collect()
    used = replies.within_run_budget(spark.createDataFrame([("r", i, 40, 10) for i in range(5)], "run string, n int, a int, b int"), "run", "n", "a", "b", 120)
    assert [(r["n"], r["run_tokens_used"], r["within"]) for r in used.orderBy("n").collect()] == [(0, 50, True), (1, 100, True), (2, 150, False)]
    assert [r[0] for r in spark.createDataFrame([("7",), ("x",), (None,)], "h string").select(replies.retry_after(F.col("h"))).collect()] == [7.0, 60.0, 60.0]


def test_partial_digest_and_sections(spark):
    runs_df = spark.createDataFrame([("r",)], "run string")
    assert replies.system_item(runs_df, "run", F.lit("llm_json_error")).first()["evidence_id"] == "system"
    text = '```json\n{"sections": [{"title": "A", "items": [{"title": "t", "evidence_id": "e", "confidence": 0.5, "source_ref": {"type": "m"}, "citations": [{"msg_id": "m", "start": 0, "end": 3, "preview": "abc"}, {"start": -1}]}, {"title": "u"}]}, {"title": "B", "items": []}, {"items": []}],}\n```'
    df = spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "k int, r string")
    items = replies.sections_of(df, "r", ["k"])
    assert sorted((r["section_title"], r["item_no"]) for r in items.collect() if r["item"]) == [("A", 0), ("A", 1)] and items.count() == 3
    checked = replies.checked_items(items, spark.createDataFrame([("e",)], "evidence_id string")).orderBy("item_no").collect()
    assert [(r["problem"], len(r["citations"])) for r in checked] == [(None, 1), ("field missing", 0)]
    assert replies.sections_of(df, "r", ["k"], strict=True).count() == 0


def test_prompt_lists(spark):
    one = spark.range(1).select(replies.shown(F.array(*[F.lit(x) for x in "abcd"]), 3, "N/A", " more").alias("m"), replies.shown(F.array().cast("array<string>"), 3, "N/A").alias("n")).first()
    assert (one["m"], one["n"]) == ("a, b, c (+1 more)", "N/A")


def test_empty_and_cut_reports(spark):
    heads = spark.createDataFrame([("d1", "2024-01-01", "t1", 4, 1), ("d2", "2024-01-02", "t2", 0, 0)], "digest string, digest_date string, trace_id string, total_emails long, emails_with_actions long")
    items = spark.createDataFrame([("d1", 1, "A", i, f"title {i}", None, 0.8, "email", f"e{i:02}", None) for i in range(1, 13)], "digest string, section_place int, section string, place int, title string, due string, confidence double, source_type string, evidence_id string, subject string")
    got = {r["digest"]: r["report"] for r in reports.plain_markdown(heads, items, "digest", None).collect()}
    assert got["d2"].endswith(reports.NOTHING) and "... и еще 2 элементов" in got["d1"] and got["d1"].count("### Evidence") == 12 and "4 писем, 1 (25%)" in got["d1"]
    short = {r["digest"]: r["report"] for r in reports.plain_markdown(heads, items, "digest", 30).collect()}
    assert short["d1"].endswith(reports.CUT_NOTE)
    assert [r["v"] for r in spark.createDataFrame([(got["d1"],), (got["d2"],), (None,)], "r string").select(reports.is_valid_markdown(F.col("r")).alias("v")).collect()] == [True, False, False]


def test_snapshot_with_bad_records(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"msg_id": "<A>", "sender": "X@y", "body": "b", "to_emails": ["Q@z"], "attachment_names": ["a.PDF", "b", "c.pdf"]}\n{"msg_id": \nnot json\n{"msg_id": "c", "sender_email": "", "from_email": "F@g"}\n')
    records, bad = snapshots.read_records(spark, str(tmp_path / "s.json"))
    assert bad.count() == 2 and records.count() == 2
    got = {r["msg_id"]: r for r in snapshots.canonical(records).collect()}
    assert (got["a"]["sender_email"], got["a"]["text_body"], got["a"]["to_recipients"], got["a"]["attachment_types"]) == ("x@y", "b", ["q@z"], ["pdf"])
    assert got["c"]["sender_email"] == "f@g"
    meta = json.loads(snapshots.snapshot_meta(records, "mail", "2024-01-01", "now").first()["meta"])
    assert meta["count"] == 2
    (tmp_path / "w.json").write_text("[broken")
    assert snapshots.read_records(spark, str(tmp_path / "w.json"), True)[1].count() == 1


def test_watermark_is_kept(spark, tmp_path):
    path = str(tmp_path / "mark")
    assert snapshots.load_watermark(spark, path) is None
    rows = spark.createDataFrame([("2024-01-02 00:00:00",), ("2024-01-05 10:00:00",)], "t string").selectExpr("cast(t AS timestamp) AS ts")
    fresh, mark = snapshots.after_watermark(rows, "ts", None)
    snapshots.store_watermark(mark, path)
    assert fresh.count() == 2 and snapshots.load_watermark(spark, path).startswith("2024-01-05 10:00:00")
    snapshots.store_watermark(rows.filter("false").selectExpr("max(ts) AS watermark"), path)
    assert snapshots.load_watermark(spark, path).startswith("2024-01-05 10:00:00")


def test_runs(spark, tmp_path):
    at = datetime.datetime(2024, 1, 5, 12)
    config = {"llm": {"headers": {"Authorization": "abc"}, "model": "m"}, "mail": [{"password": "p", "user": "u"}]}
    for n, (day, failed) in enumerate((("2024-01-01", False), ("2024-01-02", True), ("2024-01-01", False))):
        runs.append_run(runs.run_record(spark, f"t{n}", day, at + datetime.timedelta(hours=n), {"ingest": 5}, {"items": n}, {"json": "x"}, config, failed=failed), str(tmp_path / "runs"))
    table = spark.read.schema(runs.RUN).parquet(str(tmp_path / "runs"))
    assert runs.latest_run(table).first()["trace_id"] == "t2" and runs.latest_run(table, digest_date="2024-01-02").first()["status"] == "failed" and runs.latest_run(table, trace_id="none").count() == 0
    assert "abc" not in runs.latest_run(table).first()["config"] and '"user": "u"' in runs.latest_run(table).first()["config"]
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "digest_date string")
    assert [r[0] for r in runs.days_to_do(days, table, "2024-01-06 00:00:00").collect()] == ["2024-01-02"]
    assert runs.days_to_do(days, table, "2024-02-06 00:00:00").count() == 2
    assert runs.resolved_date("today", "2024-03-03") == "2024-03-03"
    with pytest.raises(ValueError):
        runs.resolved_date("soon", "2024-03-03")


def test_retries():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 4:
            raise ConnectionError
        return "ok"

    assert runs.retried(call, sleep=waits.append) == "ok" and waits == [0.5, 1.0, 2.0]
    tries.clear()
    with pytest.raises(ConnectionError):
        runs.retried(call, attempts=3, sleep=waits.append)


def test_observed(spark):
    df, watch = runs.observed(spark.range(5), "stage", odd=F.sum(F.when(F.col("id") % 2 == 1, 1).otherwise(0)))
    df.collect()
    assert watch.get == {"rows": 5, "odd": 2}


def test_places_of_threads(spark):
    rows = [("a", "2024-01-02 00:00:00"), ("b", "2024-01-03 00:00:00"), ("c", None), ("d", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "thread string, t string").selectExpr("thread", "cast(t AS timestamp) AS latest")
    assert [r["thread"] for r in threads.by_latest(df, "thread").orderBy("place").collect()] == ["b", "d", "a", "c"]


def test_section_issues(spark):
    df = spark.createDataFrame([("d", "A", 1, 2), ("d", "A", 2, 1), ("d", "B", 3, 0), ("d", "Z", 4, 1)], "digest string, section string, place int, n_items int")
    assert sorted((r["section"], r["check"]) for r in evaluation.section_issues(df, "digest", "section", "place", ["A", "B"]).collect()) == [("A", "section repeated"), ("B", "section empty"), ("Z", "section unknown")]


def test_iso_text_in_zones(spark):
    df = spark.createDataFrame([("2024-07-01 10:00:00.5", "Europe/Berlin"), ("2024-01-01 00:00:00", "America/St_Johns"), ("2024-01-01 00:00:00", None), (None, "UTC")], "t string, z string")
    got = [r[0] for r in df.select(tx.iso_in_zone(F.col("t").cast("timestamp"), F.col("z"))).collect()]
    assert got == ["2024-07-01T12:00:00.500000+02:00", "2023-12-31T20:30:00-03:30", "2024-01-01T00:00:00+00:00", None]


def test_confidences_by_a_plain_reading(spark):
    from postkiln.plans.digest_queries import ALIASES, action_confidences

    folder = "/root/testdata/sf0.001"
    import os

    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    chunks = {r["chunk_id"]: r for r in spark.read.parquet(f"{folder}/evidence_chunks.parquet").filter("content IS NOT NULL").collect()}
    patterns = {k: re.compile(getattr(signals, k).replace("(?iuU)", "(?i)")) for k in ("IMPERATIVE_RU", "IMPERATIVE_EN", "MARKER_RU", "MARKER_EN", "QUESTION", "DEADLINE")}
    names = signals.mention_aliases(ALIASES)

    def mentioned(t):
        for a in names:
            if "@" in a or " " in a:
                if a in t.lower():
                    return True
            elif (m := re.search(rf"(?<!\w){re.escape(a)}(?:'s)?(?!\w)", t.lower())) and not re.match("team|group|dept", t.lower()[m.end() :].lstrip()):
                return True
        return False

    for r in action_confidences(spark, folder).collect():
        c = chunks[r["chunk_id"]]
        t = c["content"]
        has = {k: bool(p.search(t)) for k, p in patterns.items()}
        rank = c["signals"]["sender_rank"] if c["signals"] and c["signals"]["sender_rank"] is not None else 1
        score = 1.5 * (bool(c["addressed_to_me"]) or mentioned(t)) + 1.2 * (has["IMPERATIVE_RU"] or has["IMPERATIVE_EN"]) + 1.0 * (has["MARKER_RU"] or has["MARKER_EN"]) + 0.8 * has["QUESTION"] + 0.6 * has["DEADLINE"] + 0.5 * rank
        assert r["confidence"] == pytest.approx(1 / (1 + math.exp(1.5 - score)), abs=2e-6)


def test_called_delivered_and_ingested(spark, tmp_path):
    from postkiln.operators import digest

    prompts = spark.createDataFrame([("a", "ok"), ("b", "down"), ("c", "empty")], "run string, prompt string")

    def call(prompt):
        if prompt == "down":
            raise ConnectionError
        return "" if prompt == "empty" else "{}"

    got = {r["run"]: (r["reply"], r["n_calls"], r["error"]) for r in replies.called(prompts, "run", call, first_wait=0).collect()}
    assert got == {"a": ("{}", 1, None), "b": (None, 2, "ConnectionError"), "c": (None, 2, "unusable reply")}
    assert replies.prompt_named("x", {"x": "text"}) == "text"
    with pytest.raises(KeyError, match="there are x"):
        replies.prompt_named("y", {"x": "text"})

    def send(part):
        if "bad" in part:
            raise ValueError("refused")

    texts = spark.createDataFrame([(1, "one\n\n" + "two " * 20), (2, "fine\n\n" + "x" * 50 + "\n\nbad"), (3, None)], "k int, r string")
    sent = {r["k"]: (r["n_parts"], r["status"]) for r in digest.delivered(texts, "k", "r", send, 60).collect()}
    assert sent[1][1] == "sent" and sent[1][0] >= 2 and sent[2][1] == "warning" and sent[3] == (0, "skipped")

    live = spark.createDataFrame([("<M1>", "A@x", "b")], "msg_id string, sender_email string, text_body string")
    full = live.select(*[F.col(f.name) if f.name in live.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in snapshots.MESSAGE.fields])
    out = snapshots.ingested(spark, live=lambda: full, dump=str(tmp_path / "dump"))
    again = snapshots.ingested(spark, replay=str(tmp_path / "dump"))
    assert out.select("msg_id", "sender_email").collect() == again.select("msg_id", "sender_email").collect() == [("m1", "a@x")]
    with pytest.raises(ValueError):
        snapshots.ingested(spark)
    table = snapshots.changelog_table([("v1", "2024-01-01", "first"), ("v2", "2024-02-01", "second")])
    assert table.split("\n")[2].startswith("| v2 |")
