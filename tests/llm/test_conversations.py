import random

from postkiln.llm.conversations import linked_turns, roots_of, tree_roots

SCHEMA = "row_id bigint, batch_no int, msg_id string, mailbox_id int, conversation_id string, in_reply_to string, utc_us bigint, sender_email string, from_email string, from_name string, text_body string"


def row(i, conv, reply, at, who, body="text about deadlines", batch=1, name=None, mid=None):
    return (i, batch, mid or f"<M{i}@x>", 1, conv, reply, at, who, None, name, body)


def build(spark, rows, **options):
    owners = spark.createDataFrame([(1, "Me@x")], "mailbox_id int, user_upn string")
    return linked_turns(spark.createDataFrame(rows, SCHEMA), owners, **options)


def test_whole_and_broken(spark):
    hour = 3_600_000_000
    rows = [
        row(1, "a", None, 3 * hour, "me@x"), row(2, "a", "<m1@X>", 2 * hour, " You@x "), row(3, "a", None, 40 * hour, "you@x"), row(4, "a", None, 1, "you@x", batch=2, mid="<m3@x>"),
        row(10, "one", None, 1, "me@x"), row(11, "one", None, 2, "ME@x"),
        row(20, "lost", None, 1, "me@x"), row(21, "lost", "<gone@x>", 2, "you@x"),
        row(30, "blank", None, 1, "me@x"), row(31, "blank", None, 2, "you@x", body="  \n"),
        row(40, "timeless", None, None, "me@x"), row(41, "timeless", None, 2, "you@x"),
        row(50, "nobody", None, 1, None), row(51, "nobody", None, 2, "you@x"),
        row(60, None, None, 1, "me@x"), row(61, "", None, 1, "me@x"),
    ]
    got = build(spark, rows).orderBy("conversation_id", "turn_no").collect()
    assert [(r["conversation_id"], r["turn_no"], r["msg_id"], r["role"]) for r in got] == [("a", 1, "m2@x", "other"), ("a", 2, "m1@x", "owner"), ("a", 3, "m3@x", "other")]
    assert got[0]["parent_id"] == "m1@x"
    assert build(spark, []).count() == 0


def test_likeliest_parent_by_shared_words(spark):
    minute = 60_000_000
    rows = [
        row(1, "c", None, 1 * minute, "me@x", "The warehouse scanner firmware needs another review tomorrow"), row(2, "c", None, 2 * minute, "you@x", "Holiday calendar published yesterday evening"),
        row(3, "c", None, 3 * minute, "you@x", "Warehouse scanner firmware review finished"),
    ]
    links = build(spark, rows)
    parents = {r["msg_id"]: r["parent_id"] for r in links.collect()}
    assert parents["m3@x"] == "m1@x" and parents["m1@x"] is None
    roots = {r["msg_id"]: r["tree_id"] for r in links.collect()}
    assert roots["m3@x"] == "m1@x"
    assert {r["msg_id"]: r["tree_id"] for r in tree_roots(links.drop("tree_id")).collect()} == roots


def test_every_word_and_mention_votes(spark):
    """Shared words after 4,000 characters, a few shared words of hundreds, and names after character 120 all link."""
    minute, far = 60_000_000, "x y z " * 800
    many = " ".join(a + b + c for a in ("alpha", "bravo", "delta", "gamma") for b in "abcdefghij" for c in "klmnopqrst")
    rows = [
        row(1, "f", None, 1 * minute, "me@x", far + "scanner firmware warehouse pallets inventory review"), row(2, "f", None, 2 * minute, "you@x", "calendar"), row(3, "f", None, 3 * minute, "you@x", far + "scanner firmware warehouse pallets inventory review"),
        row(11, "w", None, 1 * minute, "me@x", many), row(12, "w", None, 2 * minute, "you@x", "calendar"), row(13, "w", None, 3 * minute, "you@x", "alphaak alphabl bravoak bravobl deltaak deltabl"),
        row(21, "n", None, 1 * minute, "me@x", "one", name="Ada Quill"), row(22, "n", None, 2 * minute, "you@x", "two", name="Bo Tern"), row(23, "n", None, 3 * minute, "you@x", "a b c d " * 40 + "as Ada Quill said"),
    ]
    parents = {r["msg_id"]: r["parent_id"] for r in build(spark, rows).collect()}
    assert (parents["m3@x"], parents["m13@x"], parents["m23@x"]) == ("m1@x", "m11@x", "m21@x")


def test_both_ways_give_the_same(spark, monkeypatch):
    """Folded and joined: all in one range of time, named replies that close circles, mentions, much-answered mails."""
    from postkiln.llm import conversations

    monkeypatch.setattr(conversations, "TOGETHER", 7)
    r = random.Random(4)
    vocabulary = ["warehouse", "scanner", "firmware", "calendar", "holiday", "invoice", "pallets", "Ада", "проверка", "договор"]
    people = [("me@x", "Ada Quill"), ("you@x", "Bo-Lin Tern"), ("they@x", None)]
    rows, n = [], 0
    for conv, size in (("p", 90), ("q", 12), ("r", 2), ("s", 40)):
        first = n
        for k in range(size):
            who, name = people[k] if k < 2 else r.choice(people)
            reply = f"m{first if r.random() < 0.5 else r.randrange(first, first + size)}@x" if r.random() < 0.4 else None
            body = " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 6))) + r.choice(["", " Ada", " as Tern said", " Quill"])
            rows.append(row(n, conv, reply, r.randrange(20) * 1_000_000, who, body, name=name))
            n += 1
    folded = sorted(tuple(x) for x in build(spark, rows).collect())
    joined = sorted(tuple(x) for x in build(spark, rows, largest=10).collect())
    assert len(folded) == n and joined == folded
    assert len({x[6] for x in folded}) > 5


def test_roots_of_circles_and_chains():
    assert roots_of([None, 0, 1, 2]) == [0, 0, 0, 0]
    assert roots_of([1, 0, 1]) == [0, 0, 0]
    assert roots_of([3, 2, 1, None, 1]) == [3, 1, 1, 3, 1]
    assert roots_of([]) == []
    assert roots_of([0]) == [0]


def test_found_rows_pass_through_the_links(spark):
    """Projected to order and identifier, the plan still holds the fold that scores the links."""
    rows = [row(1, "c", None, 1, "me@x"), row(2, "c", None, 2, "you@x")]
    plan = build(spark, rows).select("conversation_id", "turn_no", "msg_id")._jdf.queryExecution().executedPlan().toString()
    assert "_fold" in plan
