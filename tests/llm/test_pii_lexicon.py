"""The lexicon of name words, sent along or joined, gives the same fields."""

from postkiln.llm import pii


def test_both_ways_give_the_same(spark, monkeypatch):
    names = spark.createDataFrame([("Zaphira Quillmoor",), ("Ostrava Benn",), (None,), ("Жанна Веткина",), ("b c",)], "from_name string")
    words = pii.name_words(names, "from_name")
    assert {r["w"] for r in words.collect()} == {"Zaphira", "Quillmoor", "Ostrava", "Benn", "Жанна", "Веткина"}
    rows = [(1, "Zaphira asked me to pass it on.", None), (2, "Ask Quillmoor, please", "From Ostrava Benn"), (2, "Ask Quillmoor, please", "From Ostrava Benn"), (3, "Жанна просит передать документы.", ""), (None, "Call Zaphira on +1 202 555 0101.", "x"), (5, "nothing in here", "at all")]
    df = spark.createDataFrame(rows, "row_id bigint, text_body string, subject string")
    whole = sorted(map(str, pii.tagged_fields(df, words, "row_id", ("text_body", "subject")).collect()))
    monkeypatch.setattr(pii, "LEXICON", 3)
    joined = sorted(map(str, pii.tagged_fields(df, words, "row_id", ("text_body", "subject")).collect()))
    assert joined == whole and len(whole) >= 4
