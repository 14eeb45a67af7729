from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postkiln.operators.instants import normalise_instants, nonstandard_instants

ZONES = [(1, "Europe/Berlin", "de_DE"), (2, "America/New_York", "en_US"), (3, "Asia/Tokyo", "ja_JP"), (4, "Europe/Moscow", "ru_RU"), (5, None, None), (6, "Nowhere/Else", "en_GB"), (7, "America/Sao_Paulo", "pt_BR")]


def us(y, mo, d, h=0, mi=0, s=0, f=0):
    return int((datetime(y, mo, d, h, mi, s, f, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000 + f


CASES = [
    ("2024-01-03T04:05:06.123456+00:00", 1, us(2024, 1, 3, 4, 5, 6, 123456)),
    ("2024-01-03T04:05:06.1234567Z", 1, us(2024, 1, 3, 4, 5, 6, 123456)),
    ("  2024-01-03t04:05:06z ", 1, us(2024, 1, 3, 4, 5, 6)),
    ("2024-01-03 04:05:06−05:00", 1, us(2024, 1, 3, 9, 5, 6)),
    ("2024-01-03 04:05", 2, us(2024, 1, 3, 9, 5)),
    ("Wed, 3 Jan 2024 17:42:36 -0330 (St Johns)", 1, us(2024, 1, 3, 21, 12, 36)),
    ("03.01.24  08:47", 4, us(2024, 1, 3, 5, 47)),
    ("1/2/2024, 4:17:14 PM", 2, us(2024, 1, 2, 21, 17, 14)),
    ("1/2/2024 12:17:14 AM", 2, us(2024, 1, 2, 5, 17, 14)),
    ("2024/01/03, 08:55", 3, us(2024, 1, 2, 23, 55)),
    ("3 января 2024 г. в 04:22", 4, us(2024, 1, 3, 1, 22)),
    ("22. März 2024 um 17:48 Uhr", 1, us(2024, 3, 22, 16, 48)),
    ("13 de janeiro de 2024 às 07:46", 7, us(2024, 1, 13, 10, 46)),
    ("January 12, 2024 at 10:06 AM", 2, us(2024, 1, 12, 15, 6)),
    ("1704142784", 1, 1704142784000000), ("1704142784560", 1, 1704142784560000), ("1704206322733422", 1, 1704206322733422),
    ("20240105120703", 1, us(2024, 1, 5, 11, 7, 3)), ("20240102T160826Z", 2, us(2024, 1, 2, 16, 8, 26)),
    ("2024-01-12 23:35:06 GMT-3", 1, us(2024, 1, 13, 2, 35, 6)), ("2024-04-24 20:34:35 CEST", 2, us(2024, 4, 24, 18, 34, 35)),
    ("2024-01-03T14:23:16[Europe/Moscow]", 5, us(2024, 1, 3, 11, 23, 16)),
    ("2024-01-03T14:23:16+01:00", 5, us(2024, 1, 3, 13, 23, 16)),
    # a time that occurs twice, one that never occurs, and neighbours of both
    ("2024-10-27 02:30:00", 1, None), ("2024-10-27 01:59:59", 1, us(2024, 10, 26, 23, 59, 59)), ("2024-10-27 03:00:00", 1, us(2024, 10, 27, 2)),
    ("2024-03-31 02:30:00", 1, None), ("2024-03-31 03:00:00", 1, us(2024, 3, 31, 1)),
    ("2024-01-03 04:05", 5, None), ("2024-01-03 04:05", 6, None), ("03.01.2024 10:00", 5, None),
    ("2024-02-30T10:15:00Z", 1, None), ("31.11.2024 09:40", 1, None), ("2024-01-03 24:00:00", 1, None), ("n/a", 1, None), ("", 1, None), (None, 1, None), ("x" * 100000, 1, None), (" " * 150 + "2024-01-03 04:05" + " " * 90, 2, us(2024, 1, 3, 9, 5)), ("2024-01-03 04:05", None, None),
]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(ZONES, "mailbox_id int, tz string, locale string")


def test_formats(spark, zones):
    rows = spark.createDataFrame([(i, t, m) for i, (t, m, _) in enumerate(CASES)], "id int, t string, mailbox_id int")
    got = {r["id"]: r["utc_us"] for r in normalise_instants(rows, "t", zones, "mailbox_id", "tz").collect()}
    assert {CASES[i][0]: v for i, v in got.items() if v != CASES[i][2]} == {}


def test_policies(spark, zones):
    rows = spark.createDataFrame([("2024-10-27 02:30:00", 1), ("2024-03-31 02:30:00", 1)], "t string, mailbox_id int")
    for a, n, want in (("earlier", "shift_forward", [us(2024, 10, 27, 0, 30), us(2024, 3, 31, 1, 30)]), ("later", "shift_backward", [us(2024, 10, 27, 1, 30), us(2024, 3, 31, 0, 30)])):
        assert [r["utc_us"] for r in normalise_instants(rows, "t", zones, "mailbox_id", "tz", ambiguous=a, nonexistent=n).orderBy(F.desc("t")).collect()] == want


def test_words_count_from_the_base_date(spark, zones):
    rows = spark.createDataFrame([("завтра", 4), ("amanhã 02:18", 7), ("TODAY ", 2), ("gestern", 1), ("next sprint", 2), ("2024-05-01", 4)], "t string, mailbox_id int").selectExpr("*", "'2024-05-10' AS day")
    by = {r["t"]: r["utc_us"] for r in normalise_instants(rows, "t", zones, "mailbox_id", "tz", base_date="day").collect()}
    got = [by[t] for t in ("завтра", "amanhã 02:18", "TODAY ", "gestern", "next sprint", "2024-05-01")]
    assert got == [us(2024, 5, 10, 21), us(2024, 5, 11, 5, 18), us(2024, 5, 10, 4), us(2024, 5, 8, 22), None, us(2024, 4, 30, 21)]


def test_clashing_columns_empty_tables_and_repeats(spark, zones):
    rows = spark.createDataFrame([(1, "2024-01-03T00:00:00Z", 1, "mine", "mine")] * 2, "id int, t string, mailbox_id int, tz string, locale string")
    got = normalise_instants(rows, "t", zones, "mailbox_id", "tz").collect()
    assert len(got) == 2 and got[0]["tz"] == "mine" and got[0]["utc_us"] == us(2024, 1, 3)
    assert normalise_instants(rows.limit(0), "t", zones, "mailbox_id", "tz").count() == 0
    found = nonstandard_instants(normalise_instants(rows, "t", zones, "mailbox_id", "tz"), "id", "t", "x").columns
    assert found == ["source_table", "row_key", "utc_us"]
