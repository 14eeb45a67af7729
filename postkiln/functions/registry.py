"""Functions under stable names, for queries that are written in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkiln.functions import html, lemmas, quotes, text

#: Functions that Python computes, in Arrow batches.
BATCHED = {"pk_nfc": text.nfc, "pk_lemma": lemmas.lemma_of, "pk_lemmas": lemmas.lemmas_of_phrase}
PLAIN = {"pk_html_text": html.to_text, "pk_main_content": quotes.main_content, "pk_without_quotes": quotes.without_quotes}
#: Functions of one text t that are SQL themselves, so that the optimizer inlines them: (type, expression).
NATIVE = {
    "pk_token_estimate": ("INT", r"CAST(floor(size(filter(split(t, '\\s+'), w -> w <> '')) * 13 / 10) AS INT)"), "pk_one_line": ("STRING", r"trim(regexp_replace(t, '\\s+', ' '))"),
    "pk_login": ("STRING", "lower(substring_index(t, '@', 1))"), "pk_domain": ("STRING", "CASE WHEN contains(t, '@') THEN lower(substring_index(t, '@', -1)) END"),
    "pk_confidence": ("DOUBLE", "CASE lower(trim(t)) WHEN 'high' THEN 0.9D WHEN 'medium' THEN 0.7D WHEN 'low' THEN 0.4D ELSE try_cast(t AS DOUBLE) END"),
}


def _batched(f):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: f(t) if isinstance(t, str) else None)

    return run


def register(spark: SparkSession) -> list[str]:
    """Registers the functions with a session and returns their names."""
    for name, f in BATCHED.items():
        spark.udf.register(name, f)
    for name, f in PLAIN.items():
        spark.udf.register(name, _batched(f))
    for name, (kind, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return [*BATCHED, *PLAIN, *NATIVE]
