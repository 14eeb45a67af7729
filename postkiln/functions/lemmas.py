"""Lemmas of verbs of action: a rule over regular endings checked against the base forms, with few exceptions."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Base forms; all their other forms come from the rules below.
EN_BASE = "approve review send provide submit confirm verify check update complete finish prepare create draft share sign ask request respond reply fix change validate deliver schedule discuss arrange ensure examine study review call meet close open test compare merge".split()
RU_BASE = "сделать проверить подготовить отправить согласовать подтвердить обновить завершить утвердить ответить уточнить одобрить выполнить доработать прислать направить предоставить рассмотреть организовать назначить закрыть".split()
# Irregular forms.
IRREGULAR = {"sent": "send", "met": "meet", "пришлите": "прислать", "пришли": "прислать", "рассмотрите": "рассмотреть", "рассмотри": "рассмотреть", "закройте": "закрыть", "закрой": "закрыть"}


def lemma(token: str, custom: dict[str, str] | None = None) -> str:
    """Base form of a token in lower case; the token itself where no rule leads to a known base."""
    w = token.lower()
    if custom and w in custom:
        return custom[w]
    if w in IRREGULAR:
        return IRREGULAR[w]
    en, ru = frozenset(EN_BASE), frozenset(RU_BASE)
    if w in en or w in ru:
        return w
    tries: list[str] = []
    if w.endswith("ing") and len(w) > 5:
        stem = w[:-3]
        tries += [stem, stem + "e", stem[:-1]]
    if w.endswith("ied") or w.endswith("ies"):
        tries.append(w[:-3] + "y")
    if w.endswith("ed") and len(w) > 4:
        tries += [w[:-2], w[:-1], w[:-3]]
    if w.endswith("es"):
        tries += [w[:-2], w[:-1]]
    if w.endswith("s"):
        tries.append(w[:-1])
    for t in tries:
        if t in en:
            return t
    for ending, bases in (("йте", ("ть", "ать")), ("й", ("ть", "ать")), ("уйте", ("овать",)), ("уй", ("овать",)), ("ите", ("ить", "еть", "ать")), ("и", ("ить", "еть", "ать")), ("ил", ("ить",)), ("ила", ("ить",)), ("или", ("ить",)), ("ал", ("ать",)), ("ала", ("ать",)), ("али", ("ать",)), ("ить", ("ить",)), ("вьте", ("вить",)), ("вь", ("вить",)), ("рьте", ("рить",)), ("рь", ("рить",)), ("тьте", ("тить",)), ("ть", ("тить",))):
        if w.endswith(ending) and len(w) > len(ending) + 1:
            stem = w[: -len(ending)]
            for b in bases:
                if stem + b in ru:
                    return stem + b
    return w


@lru_cache(maxsize=200_000)
def _lemma(token: str) -> str:
    return lemma(token)


@F.pandas_udf(T.StringType())
def lemma_of(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: _lemma(t) if isinstance(t, str) else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def lemmas_of_phrase(phrases: pd.Series) -> pd.Series:
    """Lemmas of the words of a phrase, in order, without their punctuation."""
    return phrases.map(lambda p: [_lemma(w) for w in (re.sub(r"[^\w\s-]", "", t) for t in p.split()) if w] if isinstance(p, str) else None)


def known_forms(tokens: DataFrame, form: str) -> DataFrame:
    """(lemma, forms, n): of each known base form, the forms that a column of tokens holds and how often. Tokens are counted
    before they are read, and forms of a base are few by grammar."""
    counted = tokens.groupBy(F.lower(form).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("lemma", lemma_of(F.col("form"))).filter(F.col("lemma").isin(*EN_BASE, *RU_BASE)).groupBy("lemma").agg(F.sort_array(F.collect_set("form")).alias("forms"), F.sum("n").alias("n"))


def lemma_table(spark: SparkSession, forms: list[str]) -> DataFrame:
    """(form, lemma) of given forms, for joins with tokens."""
    return spark.createDataFrame([(f, lemma(f)) for f in forms], "form string, lemma string")
