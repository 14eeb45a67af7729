"""Replies of a language model: prompts from evidence, recorded calls, budgets and spacing, parsing and validation.

The call itself stays outside: replies come from a table of recorded ones, and runs without a usable reply fall back to the
extractive digest.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkiln.functions.text import json_part

#: Tokens that the calls of one run may use, seconds between the starts of two calls, calls of a run, and the least score of
#: evidence that makes an empty reply worth a second call.
RUN_TOKENS, SPACING_S, CALLS, PROMISING = 30_000, 4.0, 2, 1.5
#: Entries that lists show in a prompt, and characters of its subjects.
SHOWN_PEOPLE, SHOWN_WORDS, SHOWN_DATES, SHOWN_SUBJECT = 3, 5, 3, 80
#: Seconds to wait where an answer does not say how long.
RETRY_AFTER_S = 60.0
# What a second call adds to the prompt.
QUALITY_HINT = "\n\nIMPORTANT: If there are actionable requests or deadlines, return items accordingly. Return strict JSON per schema only."
# Required fields, labels of confidence and the least length of quotes of the typed reply.
CONFIDENCES, LEAST_QUOTE = ("High", "Medium", "Low"), 10
REQUIRED = {
    "my_actions": ("title", "description", "evidence_id", "quote", "confidence"), "others_actions": ("title", "description", "evidence_id", "quote", "confidence"),
    "deadlines_meetings": ("title", "evidence_id", "quote", "date_time"), "risks_blockers": ("title", "evidence_id", "quote", "severity", "impact"), "fyi": ("title", "evidence_id", "quote"),
}
#: Longest quotes and the versions of the strict form.
LONGEST_QUOTE, VERSIONS = 4000, ("v1", "1.0")

_S = T.StringType()
CITATION = T.StructType([T.StructField("msg_id", _S), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("preview", _S), T.StructField("checksum", _S)])
#: Items keep confidence as text: whether it is a number is a matter of validation.
ITEM = T.StructType([T.StructField("title", _S), T.StructField("due", _S), T.StructField("evidence_id", _S), T.StructField("confidence", _S), T.StructField("source_ref", T.MapType(_S, _S)), T.StructField("email_subject", _S), T.StructField("citations", T.ArrayType(CITATION))])
SECTIONS = T.StructType([T.StructField("sections", T.ArrayType(T.StructType([T.StructField("title", _S), T.StructField("items", T.ArrayType(ITEM))])))])
STRICT = T.StructType([
    T.StructField("version", _S), T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("id", _S), T.StructField("quote", _S)]))),
    T.StructField("summary", T.ArrayType(T.StructType([T.StructField("title", _S), T.StructField("detail", _S), T.StructField("evidence_ref", _S)]))), T.StructField("notes", _S), T.StructField("_bad", _S),
])


def shown(values: Column, most: int, none: str, unit: str = "") -> Column:
    """The first values of a list, separated by commas, and how many more there are."""
    n = F.coalesce(F.size(values), F.lit(0))
    more = F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.lit(unit + ")"))).otherwise("")
    return F.when(n > 0, F.concat(F.array_join(F.slice(values, 1, most), ", "), more)).otherwise(none)


def evidence_block(number: Column, c: dict[str, Column]) -> Column:
    """The text of one piece of evidence in a prompt: a head of what is known of its mail and signals, a rule, the content."""
    text = lambda name, default: F.coalesce(c[name].cast("string"), F.lit(default))
    truth = lambda name: F.when(F.coalesce(c[name], F.lit(False)), "True").otherwise("False")
    subject = text("subject", "N/A")
    subject = F.when(F.char_length(subject) > SHOWN_SUBJECT, F.concat(F.substring(subject, 1, SHOWN_SUBJECT), F.lit("..."))).otherwise(subject)
    files = F.when(F.coalesce(F.size(c["attachment_types"]), F.lit(0)) > 0, F.array_join(c["attachment_types"], ", ")).otherwise("none")
    aliases = F.when(F.coalesce(F.size(c["aliases"]), F.lit(0)) > 0, F.array_join(c["aliases"], ", ")).otherwise("none")
    return F.format_string(
        "Evidence %d (ID: %s, Msg: %s, Thread: %s)\nFrom: %s | To: %s | Cc: %s\nSubject: %s\nReceivedAt: %s | Importance: %s | Flag: %s | HasAttachments: %s\n"
        "AddressedToMe: %s (aliases: %s)\nSignals: action_verbs=[%s]; dates=[%s]; contains_question=%s; sender_rank=%s; attachments=[%s]\n---\n%s\n\n",
        number, c["evidence_id"], text("msg_id", "N/A"), text("conversation_id", "N/A"), text("sender", "N/A"), shown(c["to"], SHOWN_PEOPLE, "N/A", " more"), shown(c["cc"], SHOWN_PEOPLE, "N/A", " more"), subject,
        text("received_at", "N/A"), text("importance", "Normal"), truth("is_flagged"), files, truth("addressed_to_me"), aliases,
        shown(c["action_verbs"], SHOWN_WORDS, "none"), shown(c["dates"], SHOWN_DATES, "none"), truth("contains_question"), text("sender_rank", "1"), files, text("content", ""),
    )


def prompts(blocks: DataFrame, run: str, place: str, block: str) -> DataFrame:
    """(run, prompt): the evidence blocks of each run in their order. Runs hold selected evidence, which the quotas bound."""
    return blocks.groupBy(run).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.col(block).alias("b")))), lambda x: x["b"]), "\n").alias("prompt"))


def prompt_named(name: str, registry: dict[str, str]) -> str:
    """The text of a prompt; an unknown name is an error that lists the known ones."""
    if name not in registry:
        raise KeyError(f"no prompt {name!r}; there are {', '.join(sorted(registry))}")
    return registry[name]


def called(prompts_of: DataFrame, run: str, call: Callable[[str], str], attempts: int = CALLS, first_wait: float = SPACING_S, usable: Callable[[str], bool] = bool) -> DataFrame:
    """(run, reply, n_calls, error): the reply of a model to the prompt of each run.

    ``call`` is whatever reaches the model and runs in the tasks; what raises ConnectionError or TimeoutError, or is not usable, is
    asked again, and the last error stands beside a null reply. Prompts are read as they come, one after the other in each task.
    """
    kind = prompts_of.schema[run].dataType.simpleString()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, prompt in batch.itertuples(index=False, name=None):
                reply = error = None
                for n in range(1, attempts + 1):
                    try:
                        reply = call(prompt)
                        error = None if usable(reply) else "unusable reply"
                    except (ConnectionError, TimeoutError) as e:
                        reply, error = None, type(e).__name__
                    if error is None or n == attempts:
                        break
                    time.sleep(first_wait * n)
                out.append((key, reply if error is None else None, n, error))
            yield pd.DataFrame(out, columns=[run, "reply", "n_calls", "error"])

    return prompts_of.select(run, "prompt").mapInPandas(ask, f"{run} {kind}, reply string, n_calls int, error string")


def replayed(calls: DataFrame, replies: DataFrame, call_no: str = "call_no") -> DataFrame:
    """Each call with the recorded reply of its number; a call beyond the recording is an error, as it would be on the wire."""
    n = replies.groupBy().agg(F.coalesce(F.max(call_no), F.lit(-1)).alias("_last"))
    joined = calls.crossJoin(F.broadcast(n)).join(replies, call_no, "left")  # one row
    spent = F.concat(F.lit("recording exhausted: call "), F.col(call_no).cast("string"), F.lit(" of "), (F.col("_last") + 1).cast("string"))
    return joined.withColumn("reply", F.when(F.col(call_no) <= F.col("_last"), F.col("reply")).otherwise(F.raise_error(spent))).drop("_last")


def within_run_budget(calls: DataFrame, run: str, call_no: str, tokens_in: str, tokens_out: str, most: int = RUN_TOKENS) -> DataFrame:
    """calls with run_tokens_used, the tokens of the run up to and with the call, and within: whether that is in the budget. The
    first call beyond it was made and paid; whatever follows it was not, so those rows are left out."""
    used = F.coalesce(tokens_in, F.lit(0)) + F.coalesce(tokens_out, F.lit(0))
    order = Window.partitionBy(run).orderBy(call_no).rowsBetween(Window.unboundedPreceding, 0)
    out = calls.withColumn("run_tokens_used", F.sum(used).over(order)).withColumn("within", F.col("run_tokens_used") <= most)
    return out.filter(F.col("run_tokens_used") - used <= most)


def spaced_starts(calls: DataFrame, run: str, call_no: str, wanted_s: str, spacing: float = SPACING_S) -> DataFrame:
    """calls with starts_s: the earliest second at which each may start, no sooner than wanted and ``spacing`` after the one before."""
    w = Window.partitionBy(run).orderBy(call_no)
    n = F.row_number().over(w) - 1
    slack = F.max(F.col("_wanted") - F.col("_n") * spacing).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = calls.withColumn("_n", n).withColumn("_wanted", F.col(wanted_s).cast("double"))
    return placed.withColumn("starts_s", slack + F.col("_n") * spacing).drop("_n", "_wanted")


def retry_after(header: Column) -> Column:
    """Seconds that an answer asks to wait; RETRY_AFTER_S where it names no number."""
    return F.coalesce(F.trim(header).try_cast("double"), F.lit(RETRY_AFTER_S))


def quality_retries(runs: DataFrame, evidence: DataFrame, run: str, score: str) -> DataFrame:
    """Runs (run, n_sections, n_calls) whose reply is empty although their evidence is promising, and that may call once more."""
    best = evidence.groupBy(run).agg(F.max(score).alias("_best"))
    return runs.filter((F.col("n_sections") == 0) & (F.col("n_calls") < CALLS)).join(best.filter(F.col("_best") >= PROMISING).select(run), run, "left_semi")


def sections_of(replies: DataFrame, text: str, keys: list[str], strict: bool = False) -> DataFrame:
    """(keys, section_no, section_title, item_no, item): the items of the replies; not strict, fences and trailing commas are mended.

    Sections without title or items are dropped; a section without items keeps one row with a null item. A reply that does not
    parse gives no rows.
    """
    parsed = F.from_json(F.col(text) if strict else json_part(F.col(text)), SECTIONS)["sections"]
    sections = replies.select(*keys, F.posexplode(parsed).alias("section_no", "_s")).filter("_s.title IS NOT NULL AND _s.items IS NOT NULL")
    return sections.select(*keys, "section_no", F.col("_s.title").alias("section_title"), F.posexplode_outer("_s.items").alias("item_no", "item"))


def checked_items(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """items of ``sections_of`` with problem, null for sound ones: a required field is missing, the evidence is unknown, the
    confidence is no number from 0 to 1, or source_ref has no type. Evidence of any size: a join, not a list. Citations that
    are not sound are left out of sound items."""
    known = evidence.select(F.col("evidence_id").alias("_e")).filter("_e IS NOT NULL").distinct()
    i = F.col("item")
    number = i["confidence"].try_cast("double")
    problem = (
        F.when(i["title"].isNull() | i["evidence_id"].isNull() | i["confidence"].isNull() | i["source_ref"].isNull(), "field missing").when(F.col("_e").isNull(), "evidence unknown")
        .when(~F.coalesce(number.between(0, 1), F.lit(False)), "confidence").when(~F.map_contains_key(i["source_ref"], F.lit("type")), "source_ref")
    )
    sound = lambda c: F.coalesce((c["start"] >= 0) & (c["end"] > 0) & (F.char_length(c["preview"]) <= 200) & c["msg_id"].isNotNull(), F.lit(False))
    joined = items.filter("item IS NOT NULL").join(known, i["evidence_id"] == F.col("_e"), "left")
    return joined.withColumn("problem", problem).withColumn("citations", F.filter(F.coalesce(i["citations"], F.array().cast(T.ArrayType(CITATION))), sound)).drop("_e")


def reply_summary(replies: DataFrame, checked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_items, n_valid, validation_errors) of every reply, of those without items too."""
    per = checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.when(F.col("problem").isNull(), 1).otherwise(0)).alias("n_valid"))
    out = replies.select(*keys).join(per, keys, "left").na.fill(0, ["n_items", "n_valid"])
    return out.withColumn("validation_errors", F.col("n_items") - F.col("n_valid"))


def typed_problem(section: str, item: Column) -> Column:
    """First fault of an item (a struct of strings) of a typed section: a required field missing, a short quote, an unknown
    confidence; null for a sound one."""
    problem = F.when(F.lit(False), "")
    for name in REQUIRED[section]:
        problem = problem.when(item[name].isNull() | ((item[name] == "") if name in ("title", "evidence_id") else F.lit(False)), f"{name} missing")
    problem = problem.when(F.char_length(item["quote"]) < LEAST_QUOTE, "quote short")
    return problem.when(~item["confidence"].isin(*CONFIDENCES), "confidence unknown") if "confidence" in REQUIRED[section] else problem


def strict_problem(text: Column, strict: bool = True) -> Column:
    """Why a reply does not have the strict form (version, evidence, summary, notes); null where it has. Not strict, fences, text
    after the last brace and trailing commas are mended first."""
    body = text if strict else json_part(text)
    r = F.from_json(body, STRICT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    long_quote = F.exists(F.coalesce(r["evidence"], F.array().cast(STRICT["evidence"].dataType)), lambda e: e["quote"].isNull() | (F.char_length(e["quote"]) > LONGEST_QUOTE))
    bare = F.exists(F.coalesce(r["summary"], F.array().cast(STRICT["summary"].dataType)), lambda s: s["title"].isNull() | s["detail"].isNull())
    return F.when(text.isNull() | r["_bad"].isNotNull() | r.isNull() | ~F.trim(body).startswith("{"), "not json").when(~F.coalesce(r["version"], F.lit("v1")).isin(*VERSIONS), "version").when(long_quote, "evidence").when(bare, "summary")


def with_fallback(valid: DataFrame, extractive: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """The valid items of each run, and the extractive items of runs that have none; origin says which. Columns of both are united."""
    without = runs.select(run).distinct().join(valid.select(run).distinct(), run, "left_anti")
    return valid.withColumn("origin", F.lit("reply")).unionByName(extractive.join(without, run, "left_semi").withColumn("origin", F.lit("extractive")), allowMissingColumns=True)


def system_item(runs: DataFrame, run: str, reason: Column) -> DataFrame:
    """(run, section_title, title, evidence_id, confidence, reason): the one item of a partial digest, which cites the system."""
    return runs.select(run, F.lit("Статус").alias("section_title"), F.concat(F.lit("Digest is partial: "), reason).alias("title"), F.lit("system").alias("evidence_id"), F.lit(0.0).alias("confidence"), reason.alias("reason"))
