"""Rebuilding conversations from message rows (problem 4).

Interleaved channels are disentangled by reply links. A named reply is a certain link. For other turns the candidates are scored:
every earlier turn that was the latest to use one of the turn's words collects a vote for that word, the latest turn of a speaker
whose name is mentioned collects a larger one, and the turn just before collects one that fades with the time between. All votes
are as many as the words of the whole bodies, so no pairs are formed, however long a conversation is; the turn with the most votes
is the parent, and the links form trees.

Conversations of up to ``LARGEST`` rows are folded one after the other in sorted partitions; larger ones never meet in one task:
their turns are numbered over counted ranges and their votes meet in joins by word. Votes are integers, so both give the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postkiln.operators.deliveries import cleaned_id, keep_first_delivery
from postkiln.operators.skew import ranked_by_range, routed_join
from postkiln.session import written

#: Votes: of a shared word, of a mention, and of the turn just before at no distance in time; least votes of a parent.
WORD, MENTION, BEFORE, LEAST = 250, 3000, 1000, 500
#: Time after which the vote of the turn just before is halved.
HALVED_US = 86_400_000_000
#: Most rows of a conversation that one task gathers, most rows of the list of larger ones that is broadcast, and turns of a
#: larger one that are sorted together.
LARGEST, BROADCAST_ROWS, TOGETHER = 2000, 50_000, 10_000

_WORDS = re.compile(r"[^\W\d_]{5,}")
_MENTIONS = regex.compile(r"\p{Lu}\p{Ll}{2,}")
_NAME_ENDS = re.compile(r"[\s.\-]+")


class _Turn(NamedTuple):
    row_id: int
    utc_us: int
    msg_id: str
    reply_to: str | None
    role: str
    speaker: str


def words_of(body: str | None) -> set[str]:
    return set(_WORDS.findall(body.lower())) if isinstance(body, str) else set()


def mentions_of(body: str | None) -> set[str]:
    return {m.lower() for m in _MENTIONS.findall(body)} if isinstance(body, str) else set()


def names_of(name: str | None) -> set[str]:
    return {w for w in _NAME_ENDS.split(name.lower()) if len(w) > 2} if isinstance(name, str) else set()


def _blank_to_null(c: Column) -> Column:
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.nullif(trimmed, F.lit(""))


def turns(messages: DataFrame, owners: DataFrame) -> DataFrame:
    """One narrow row per message that can be part of a conversation; texts stay behind.

    ``messages`` has utc_us (the instant of its time, or null). Only the first delivery of each mail counts; rows without
    identifier or conversation are left out.
    """
    speaker = F.lower(F.coalesce(_blank_to_null(F.col("sender_email")), _blank_to_null(F.col("from_email"))))
    has_body = F.coalesce(F.col("text_body").rlike(r"(?U)\S"), F.lit(False))
    narrow = messages.select("row_id", "batch_no", "msg_id", "mailbox_id", F.nullif(F.trim("conversation_id"), F.lit("")).alias("_trimmed"), "conversation_id", cleaned_id("in_reply_to").alias("reply_to"), "utc_us", speaker.alias("speaker"), has_body.alias("has_body"))
    # written once: the steps below read these narrow rows several times, and should not parse times or bodies again
    kept = keep_first_delivery(written(narrow, "turn-rows")).withColumn("msg_id", cleaned_id("msg_id")).filter("msg_id IS NOT NULL AND _trimmed IS NOT NULL").drop("_trimmed")
    owner = owners.select(F.col("mailbox_id").alias("_mailbox"), F.lower(F.trim("user_upn")).alias("_upn"))
    return kept.join(owner, F.col("mailbox_id") == F.col("_mailbox"), "left").withColumn("role", F.when(F.col("speaker") == F.col("_upn"), "owner").otherwise("other")).drop("_mailbox", "_upn")


def whole_conversations(rows: DataFrame) -> DataFrame:
    """(conversation_id, n_turns) of conversations that are neither broken nor empty nor without a reply.

    At least two speakers; every turn with a speaker, an instant and a body; every named parent among the turns. All by
    aggregates with a map side, so a conversation of any size is never gathered.
    """
    sound = rows.groupBy("conversation_id").agg(
        (F.min("speaker") != F.max("speaker")).alias("_two"), F.min(F.col("speaker").isNotNull() & F.col("utc_us").isNotNull() & F.col("has_body")).alias("_full"), F.count(F.lit(1)).alias("n_turns")
    ).filter("_two AND _full").select("conversation_id", "n_turns")
    replies = rows.filter("reply_to IS NOT NULL").select("conversation_id", F.col("reply_to").alias("msg_id")).distinct()
    broken = replies.join(rows.select("conversation_id", "msg_id"), ["conversation_id", "msg_id"], "left_anti").select("conversation_id").distinct()
    return sound.join(broken, "conversation_id", "left_anti")


def likeliest_parents(rows: list[tuple[_Turn, str | None, str | None]]) -> list[int | None]:
    """For each turn of a conversation, in order, the number of its parent. Rows are (turn, body, name of the speaker)."""
    at = {t.msg_id: i for i, (t, _, _) in enumerate(rows)}
    last_use: dict[str, int] = {}
    last_name: dict[str, int] = {}
    out: list[int | None] = []
    for i, (turn, body, name) in enumerate(rows):
        words = words_of(body)
        if turn.reply_to is not None:
            out.append(at[turn.reply_to])
        else:
            votes: dict[int, int] = {}
            for j in map(last_use.get, words):
                if j is not None:
                    votes[j] = votes.get(j, 0) + WORD
            for m in mentions_of(body) if last_name else ():
                if (j := last_name.get(m)) is not None:
                    votes[j] = votes.get(j, 0) + MENTION
            if i:
                votes[i - 1] = votes.get(i - 1, 0) + BEFORE * HALVED_US // (HALVED_US + turn.utc_us - rows[i - 1][0].utc_us)
            best = max(votes.items(), key=lambda v: (v[1], v[0]), default=(None, 0))
            out.append(best[0] if best[1] >= LEAST else None)
        last_use.update(dict.fromkeys(words, i))
        last_name.update(dict.fromkeys(names_of(name), i))
    return out


def roots_of(parents: list[int | None]) -> list[int]:
    """The first turn of each turn's link tree; where replies close a circle, the earliest turn of the circle."""
    root: list[int | None] = [None] * len(parents)
    for i in range(len(parents)):
        path: list[int] = []
        place: dict[int, int] = {}
        j = i
        while root[j] is None and j not in place and parents[j] is not None:
            place[j] = len(path)
            path.append(j)
            j = parents[j]
        end = root[j] if root[j] is not None else min(path[place[j] :]) if j in place else j
        root[j] = end
        for k in path:
            root[k] = end
    return root  # type: ignore[return-value]


_LINKED = "conversation_id string, turn_no int, msg_id string, role string, speaker string, utc_us bigint, parent_id string, tree_id string"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversation after conversation of a partition sorted by conversation and row; only one is held."""
    current: str | None = None
    facts: dict[int, _Turn] = {}
    texts: dict[int, tuple] = {}
    out: list[tuple] = []

    def close() -> None:
        ordered = sorted(facts.values(), key=lambda t: (t.utc_us, t.msg_id))
        parents = likeliest_parents([(t, *texts.get(t.row_id, (None, None))) for t in ordered])
        roots = roots_of(parents)
        for i, t in enumerate(ordered):
            out.append((current, i + 1, t.msg_id, t.role, t.speaker, t.utc_us, None if parents[i] is None else ordered[parents[i]].msg_id, ordered[roots[i]].msg_id))

    columns = ["conversation_id", "row_id", "msg_id", "utc_us", "reply_to", "role", "speaker", "text_body", "from_name"]
    for batch in batches:
        for conversation, row, msg_id, utc, reply_to, role, speaker, body, name in zip(*(batch[c].tolist() for c in columns)):
            if conversation != current:
                if facts:
                    close()
                current, facts, texts = conversation, {}, {}
            if msg_id is None:
                texts[row] = (body, name)
            else:
                facts[row] = _Turn(row, int(utc), msg_id, reply_to, role, speaker)
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _LINKED.split(", ")])
            out = []
    if facts:
        close()
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _LINKED.split(", ")])


def linked_turns(messages: DataFrame, owners: DataFrame, bodies: DataFrame | None = None, largest: int = LARGEST) -> DataFrame:
    """(conversation_id, turn_no, msg_id, role, speaker, utc_us, parent_id, tree_id) of the turns of every whole conversation.

    turn_no counts from 1 in order of the instant, then of msg_id. parent_id is the turn's likeliest parent, null for the first
    turn of a tree; tree_id is that first turn. ``bodies`` is the plain table (row_id, conversation_id, text_body, from_name), so
    that the texts are read without computing instants; by default it is taken from ``messages``. Repeated deliveries count once;
    nulls as in ``turns``; an empty table gives no rows.
    """
    bodies = (messages if bodies is None else bodies).select("conversation_id", "row_id", "text_body", "from_name")
    named = F.nullif(F.trim("conversation_id"), F.lit("")).isNotNull()
    rows = written(turns(messages, owners), "turns")
    whole = whole_conversations(rows)
    sizes = bodies.filter(named).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > largest)
    large = written(sizes.select("conversation_id", F.lit(True).alias("_large")), "large-conversations")
    n_large = large.limit(BROADCAST_ROWS + 1).count()
    side = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    live = routed_join(rows, whole, "conversation_id", "n_turns").select("conversation_id", "row_id", "msg_id", "utc_us", "reply_to", "role", "speaker")
    small = live.join(side, "conversation_id", "left_anti") if n_large else live
    texts = bodies.filter(named)
    texts = texts.join(side, "conversation_id", "left_anti") if n_large else texts
    both = small.unionByName(texts, allowMissingColumns=True)
    folded = both.repartition("conversation_id").sortWithinPartitions("conversation_id", "row_id").mapInPandas(_fold, _LINKED)
    if not n_large:
        return folded
    return folded.unionByName(_linked_by_joins(live.join(side, "conversation_id", "left_semi"), bodies.join(side, "conversation_id", "left_semi")))


def _uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(conversation_id, turn_no, word, votes, uses): words and mentions that ask, words and names that are used."""
    for batch in batches:
        convs, numbers, words, votes, uses = [], [], [], [], []
        for conversation, n, body, name, asks in zip(*(batch[c].tolist() for c in ("conversation_id", "turn_no", "text_body", "from_name", "asks"))):
            kinds = [(w, WORD if asks else 0, True) for w in words_of(body)] + [("@" + w, 0, True) for w in names_of(name)]
            kinds += [("@" + w, MENTION, False) for w in mentions_of(body)] if asks else []
            convs += [conversation] * len(kinds)
            numbers += [n] * len(kinds)
            words += [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w, _, _ in kinds]
            votes += [v for _, v, _ in kinds]
            uses += [u for _, _, u in kinds]
        yield pd.DataFrame({"conversation_id": convs, "turn_no": numbers, "word": words, "votes": votes, "uses": uses})


def _linked_by_joins(live: DataFrame, bodies: DataFrame) -> DataFrame:
    """``linked_turns`` of large conversations: turns are sorted in ranges that hold equally many rows, votes meet by word."""
    ranges = written(live.repartitionByRange("conversation_id", "utc_us", "msg_id").withColumn("_range", F.spark_partition_id()), "large-ranges")
    numbered = written(ranked_by_range(ranges, "conversation_id", "_range", [F.col("utc_us"), F.col("msg_id")], "turn_no").drop("_range"), "large-turns")
    asked = numbered.select("row_id", "turn_no", F.col("reply_to").isNull().alias("asks")).join(bodies, "row_id")
    uses = asked.select("conversation_id", "turn_no", "text_body", "from_name", "asks").mapInPandas(_uses, "conversation_id string, turn_no int, word bigint, votes int, uses boolean")
    latest = _latest_of_uses(written(uses, "large-uses"))
    before = numbered.select("conversation_id", (F.col("turn_no") + 1).alias("turn_no"), F.col("utc_us").alias("_before"))
    fading = F.expr(f"{BEFORE} * {HALVED_US} DIV ({HALVED_US} + utc_us - _before)").cast("bigint")
    near = numbered.filter("reply_to IS NULL").join(before, ["conversation_id", "turn_no"]).select("conversation_id", "turn_no", (F.col("turn_no") - 1).alias("candidate"), fading.alias("votes"))
    votes = latest.filter("_prev IS NOT NULL AND votes > 0").select("conversation_id", "turn_no", F.col("_prev").alias("candidate"), F.col("votes").cast("bigint").alias("votes")).unionByName(near)
    scored = votes.groupBy("conversation_id", "turn_no", "candidate").agg(F.sum("votes").alias("score"))
    best = scored.groupBy("conversation_id", "turn_no").agg(F.max(F.struct("score", "candidate")).alias("_best")).filter(F.col("_best.score") >= LEAST)
    guess = best.select("conversation_id", "turn_no", F.col("_best.candidate").alias("_up"))
    guessed = guess.withColumn("_at", F.struct("conversation_id", "_up"))
    found = routed_join(guessed, guessed.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).join(numbered.select(F.struct("conversation_id", F.col("turn_no").alias("_up")).alias("_at"), F.col("msg_id").alias("guess")), "_at"), "_at", "_n").select("conversation_id", "turn_no", "guess")
    out = numbered.join(found, ["conversation_id", "turn_no"], "left").select("conversation_id", "turn_no", "msg_id", "role", "speaker", "utc_us", F.coalesce("reply_to", "guess").alias("parent_id"))
    return tree_roots(written(out, "large-links")).select(*[c.split()[0] for c in _LINKED.split(", ")])


def _latest_of_uses(uses: DataFrame) -> DataFrame:
    """uses with _prev, the number of the latest earlier turn of the same word that uses it (other rows only ask)."""
    keys = ["conversation_id", "word"]
    rows = uses.withColumn("_range", F.floor(F.col("turn_no") / TOGETHER))
    value = F.when(F.col("uses"), F.col("turn_no"))
    last = rows.groupBy(*keys, "_range").agg(F.max(value).alias("_last"))
    carry = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    near = F.max(value).over(Window.partitionBy(*keys, "_range").orderBy("turn_no").rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_near", near).join(carry, [*keys, "_range"]).withColumn("_prev", F.coalesce("_near", "_carry")).drop("_near", "_carry", "_range")


def tree_roots(links: DataFrame) -> DataFrame:
    """links with tree_id, the msg_id of the first turn of each turn's link tree, by pointer doubling.

    Each round looks twice as far up, and turns whose root is found leave. Turns that point to one and the same turn are joined
    by the routed way, so a much-answered mail is no hot key. Where replies close a circle, its earliest turn is the root: once
    the rounds have gone around, the least number seen from a turn of the circle is that of the whole circle.
    """
    own = links.select("conversation_id", F.col("msg_id").alias("parent_id"), F.col("turn_no").alias("up"))
    state = _at_hot(links.select("conversation_id", "turn_no", "parent_id"), own, "parent_id", "left")
    state = written(state.select("conversation_id", "turn_no", "up", F.least("turn_no", F.coalesce("up", "turn_no")).alias("low")), "tree-state")
    longest = links.agg(F.max("turn_no")).first()[0] or 1
    done = state.filter("up IS NULL").select("conversation_id", "turn_no", F.col("turn_no").alias("root"))
    active = state.filter("up IS NOT NULL")
    for _ in range(int(longest).bit_length() + 1):
        if active.isEmpty():
            break
        target = active.select("conversation_id", F.col("turn_no").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"), F.lit(None).cast("int").alias("root"))
        target = target.unionByName(done.select("conversation_id", F.col("turn_no").alias("up"), F.lit(None).cast("int").alias("_up"), F.lit(None).cast("int").alias("_low"), "root"))
        moved = written(_at_hot(active, target, "up").select("conversation_id", "turn_no", F.col("_up").alias("up"), F.least("low", "_low").alias("low"), "root"), "tree-state")
        done = written(done.unionByName(moved.filter("root IS NOT NULL").select("conversation_id", "turn_no", "root")), "tree-done")
        active = moved.filter("root IS NULL").drop("root")
    rest = _at_hot(active, active.select("conversation_id", F.col("turn_no").alias("up"), F.col("low").alias("root")), "up").select("conversation_id", "turn_no", "root")
    named = _at_hot(done.unionByName(rest), links.select("conversation_id", F.col("turn_no").alias("root"), F.col("msg_id").alias("tree_id")), "root")
    return links.join(named.select("conversation_id", "turn_no", "tree_id"), ["conversation_id", "turn_no"])


def _at_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left with the columns of the row of right at (conversation_id, key), which may be the same for very many rows of left."""
    at = F.struct("conversation_id", key).alias("_at")
    wanted = left.filter(F.col(key).isNotNull()).groupBy(at).agg(F.count(F.lit(1)).alias("_n"))
    groups = wanted.join(right.withColumn("_at", F.struct("conversation_id", key)).drop("conversation_id", key), "_at")
    out = routed_join(left.filter(F.col(key).isNotNull()).withColumn("_at", F.struct("conversation_id", key)), groups, "_at", "_n").drop("_at", "_n")
    return out.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out
