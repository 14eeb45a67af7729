"""Shared passages: saturated sketches, long texts in pieces, edges of passages, repeats within one text."""

import random

import numpy as np

from postkiln.llm import spans
from tests.llm.test_text import brute_spans


def _texts(seed=5, n=50):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh ij") for _ in range(n))
    notice, passage = text(330), text(700)
    docs = []
    for i in range(n):
        cut = r.randrange(0, 300)
        middle = (notice, passage[cut : cut + r.randrange(300, 420)], passage, "")[i % 4]
        docs.append((i, text(r.randrange(0, 900)) + middle + text(r.randrange(0, 700))))
    docs += [(900, docs[0][1] + notice + notice), (901, passage[:400] + "|" + passage[:400]), (902, passage[100:]), (903, docs[2][1]), (904, docs[2][1])]
    return docs


def test_marks_do_not_depend_on_pieces_or_neighbours(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("abcd") for _ in range(n)) for n in (320, 5000, 321, 2600)]
    alone = [{(p, h) for _, p, h in zip(*spans.marks([t]))} for t in texts]
    for piece in (1 << 17, 1000, 700):
        monkeypatch.setattr(spans, "PIECE", piece)
        owner, at, hashes = spans.marks(texts)
        assert [{(p, h) for o, p, h in zip(owner, at, hashes) if o == n} for n in range(4)] == alone
        assert all(np.all(np.diff(at[owner == n]) > 0) for n in range(4))
    for t, found in zip(texts, alone):  # any SPAN characters hold one
        places = sorted(p for p, _ in found)
        assert all(any(i <= p <= i + spans.SPAN - spans.MARK for p in places) for i in range(len(t) - spans.SPAN + 1))


def test_a_full_sketch_loses_nothing_and_passes_only_repeated_marks(spark, monkeypatch):
    docs = _texts()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    want = brute_spans(docs)
    n_marks = len(spans.marks([t for _, t in docs if len(t) >= spans.SPAN])[0])
    monkeypatch.setattr(spans, "LEAST_CELLS", 5)
    assert n_marks > 10 * (1 << 5)
    # runs of windows are sent for repeated marks alone, whatever the sketch let through
    counts, kept = {}, spans.written
    for cells in (5, spans.MOST_CELLS):
        seen = {}
        monkeypatch.setattr(spans, "written", lambda d, label: seen.setdefault(label, kept(d, label)))
        assert {x["doc_id"]: x["shared_chars"] for x in spans.shared_spans(df, most_cells=cells).collect()} == want
        counts[cells] = {label: seen[label].count() for label in ("span-likely", "span-runs")}
        monkeypatch.setattr(spans, "LEAST_CELLS", 17)
    assert counts[5]["span-likely"] > 0.8 * n_marks > counts[spans.MOST_CELLS]["span-likely"]
    assert counts[5]["span-runs"] == counts[spans.MOST_CELLS]["span-runs"]


def test_long_texts_in_pieces(spark, monkeypatch):
    docs = _texts(seed=9, n=24)
    docs.append((500, "".join(t for _, t in docs[:6])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {x["doc_id"]: x["shared_chars"] for x in spans.shared_spans(df).collect()} == brute_spans(docs)


def test_null_keys_clashing_columns_and_copies(spark):
    t = "".join(random.Random(2).choice("xyzuvw") for _ in range(400))
    rows = [(1, t, 5, "p"), (2, t, 6, "q"), (None, t, 7, "r"), (3, t[:320], 8, "s"), (3, t[:320], 8, "s"), (4, None, 9, None), (5, "", 1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, a int, h string")
    got = {tuple(x) for x in spans.shared_spans(df).collect()}
    assert got == {(1, 400, 400), (2, 400, 400), (3, 320, 320)}
    assert spans.shared_spans(df.filter("doc_id = 1")).count() == 0
