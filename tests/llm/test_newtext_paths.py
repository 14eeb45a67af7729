"""Newly written text: conversations that are gathered and those that meet in joins come out alike, and repeated lines stay cheap."""

import os
import random
import time

import pytest

from postkiln.llm import newtext

SCHEMA = "row_id bigint, conversation_id string, msg_id string, in_reply_to string, utc_us bigint, ingested_at timestamp_ntz, sender_email string, text_body string, from_name string"


def rows_of(seed=8):
    r = random.Random(seed)
    words = "the budget plan for warehouse scanners needs review before friday because totals differ in two rows of this sheet again".split()
    said, rows = {}, []
    for conv in ("c1", "c2", "c3", None, "", "alerts"):
        said[conv] = []
        for i in range(14):
            n = len(rows)
            own = " ".join(r.choice(words) for _ in range(r.randrange(9, 30)))
            body = f"Hello,\n\n{own}.\n\nKind regards,\nAda Quill"
            if said[conv] and r.random() < 0.7:
                old = r.choice(said[conv])
                body += "\n\n" + r.choice(["On 3 May 2024 at 10:00 Bo wrote:\n" + "\n".join("> " + x for x in old.split("\n")), old])
            said[conv].append(body)
            if r.random() < 0.1:
                body = None
            parent = f"<m{n - r.randrange(1, 4)}>" if i > 3 and r.random() < 0.6 else None
            sender = "bot@x" if conv == "alerts" else r.choice(["a@x", "b@x"])
            rows.append((n, conv, f"<M{n}>" if r.random() < 0.95 else None, parent, r.randrange(10**12) if r.random() < 0.9 else None, None, sender, body, "Ada Quill"))
    rows += [(900 + i, "c1", "<M3>", None, 5, None, "a@x", rows[3][7], "Ada Quill") for i in range(2)]  # other deliveries of one mail
    return rows


def result(df, largest):
    bodies = df.select("row_id", "conversation_id", "text_body", "from_name")
    return sorted((x["row_id"], x["new_text"], tuple(x["left_out"])) for x in newtext.with_new_text(df, bodies, largest).collect())


def test_small_and_large_ways_agree(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    small, large = result(df, 2000), result(df, 3)
    assert small == large
    assert sum("quoted" in k for _, _, k in small) > 20 and sum("signature" in k for _, _, k in small) > 40


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_ways_agree_on_the_tables(spark):
    from postkiln.plans.core_queries import message_instants

    d = "/root/testdata/sf0.001"
    df = message_instants(spark, d, "conversation_id", "msg_id", "in_reply_to", "ingested_at", "sender_email", "text_body", "from_name")
    assert result(df, 2000) == result(df, 1)


def test_equal_lines_are_linear():
    took = []
    for n in (400, 1600):
        text = "the same line stands here again and again\n" * n
        began = time.process_time()
        newtext.newly_written("Fresh words of mine come first here.\n" + text, text)
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.01)
