"""Repair of garbled text does not depend on its neighbours, and undoes any number of layers."""

import random

from postkiln.llm import mojibake
from postkiln.llm.mojibake import repair

CLEAN = ["Проверьте ещё раз договор, пожалуйста.", "Расчётный центр всё ещё открыт.", "Viele Grüße aus München – bis später!", "O relatório já está pronto… até amanhã.", "Ship it 👩‍🔧 📦 today", "plain"]


def garble(text, read="cp1252"):
    raw = text.encode("utf-8")
    return "".join(bytes([b]).decode(read, "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)


def test_clean_text_stays():
    for t in CLEAN:
        assert repair(t) == (t, False, True)


def test_any_number_of_layers():
    for t in CLEAN[:4]:
        bad = t
        for _ in range(7):
            bad = garble(bad)
            fixed, found, complete = repair(bad)
            assert found and complete and fixed == t


def test_neighbours_do_not_matter():
    r = random.Random(6)
    legacy = [("koi8-r", "cp1251"), ("cp866", "cp1251"), ("mac-roman", "cp1252"), ("cp850", "cp1252")]
    texts = [garble(t) for t in CLEAN[:4]]
    for t in CLEAN[:4] + ["Reicht die Größe für übermäßig große Fässer?", "Não há previsão às três."]:
        for read, meant in legacy:
            try:
                texts.append(t.encode(meant).decode(read))
            except UnicodeError:
                pass
    want = [repair(t) for t in texts]
    for _ in range(3):
        order = list(range(len(texts)))
        r.shuffle(order)
        mojibake._steps.cache_clear()
        assert {i: repair(texts[i]) for i in order} == dict(enumerate(want))


def test_any_partitioning(spark):
    rows = [(i, garble(CLEAN[i % 5]) if i % 3 else CLEAN[i % 5], None if i % 7 else "") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, text_body string, subject string")
    results = [sorted(map(tuple, mojibake.garbled_fields(df.repartition(n), "row_id", ("text_body", "subject")).collect())) for n in (1, 3, 7)]
    assert results[0] == results[1] == results[2] and len(results[0]) > 20
