"""Personal information in free text (problem 7): a linear-chain conditional random field over word shapes.

The model is trained here, on the driver, from the small labelled table of ``pii_table``. Every feature of a token depends on
one token of its neighbourhood only, so the weights fold into one row per token type and offset; a batch is scored by gathers
and decoded by Viterbi over all of its lines at once. Lines in which no label can win are set aside by an exact bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postkiln.llm import mojibake
from postkiln.llm.pii_table import KINDS, labelled_table
from postkiln.operators.skew import routed_join
from postkiln.session import written

LABELS = ("", *KINDS)
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
#: Most name words that are sent along as a whole; of more, each text is joined with those that stand in it.
LEXICON = 50_000
#: Token types whose scores a worker remembers; a full memory is emptied, which costs time only.
REMEMBERED = 300_000
# Small words inside surnames.
PARTICLES = frozenset(("da", "de", "do", "dos", "das", "e", "von", "van", "vom", "zu", "zur", "der", "den", "la", "le", "del", "di"))
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_TOKEN = re.compile(r"\n|[^\W\d_]++(?:['’\-][^\W\d_]++)*+(?!\d)|\d++(?![^\W\d_])|[^\W_]+|[^\w\s]|_+")
_LETTERS = re.compile(r"[^\W\d_]")
_BOUND = "\n"


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _shape(w: str) -> str:
    if any(c.isdigit() for c in w):
        if w.isdigit():
            return "d" + str(len(w)) if len(w) <= 12 else "d+"
        parts = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" for c in w))
        return f"m{parts[:6]}:{min(len(w) // 3, 5)}"
    if not _LETTERS.match(w):
        return "p" + w[0]
    cased = "X" if w.isupper() and len(w) > 1 else "Xx" if w[0].isupper() else "x"
    script = "c" if "Ѐ" <= w[0] <= "ӿ" else "l"
    return cased + script + ("-" if "-" in w or "'" in w or "’" in w else "") + ("1" if len(w) == 1 else "")


def features(w: str, in_lexicon: bool) -> list[str]:
    """What the model sees of a token: its shape, its word and the end of it, and whether it is a known name word."""
    if w == _BOUND:
        return ["<line>"]
    low = w.lower()
    out = ["s:" + _shape(w), "w:" + low]
    if _LETTERS.match(w):
        out += ["e:" + low[-3:], "e:" + low[-5:] if len(low) > 5 else "e<5"]
        if in_lexicon:
            out.append("lexicon")
            out.append("lexicon:" + _shape(w))
    elif w[0] == "0":
        out.append("zero:" + _shape(w))
    return out


class Model:
    """Weights of the field: per offset and feature a row over the labels, and the transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights, moves

    def rows(self, w: str, in_lexicon: bool) -> np.ndarray:
        known = [self.names[f] for f in features(w, in_lexicon) if f in self.names]
        return self.weights[:, known, :].sum(axis=1) if known else np.zeros((len(OFFSETS), len(LABELS)), dtype=np.float32)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=2)
def trained(rounds: int = 8, epochs: int = 24, seed: int = 11) -> Model:
    """The model fitted to the labelled table by Adam on the exact likelihood (forward and backward passes over all lines)."""
    table = labelled_table(rounds, seed)
    rng = np.random.default_rng(seed)
    lines, labels, flags = [], [], []
    for parts in table:
        words, ys, known = [], [], []
        for text, kind in parts:
            for w in tokens(text):
                words.append(w)
                ys.append(LABELS.index(kind))
                # some names are in the lexicon and some are not; hardly any other word is
                is_word = bool(_LETTERS.match(w)) and w[0].isupper() and len(w) > 1
                known.append(is_word and ((kind == "name" and rng.random() < 0.85) or (kind != "name" and rng.random() < 0.003)))
        if words:
            lines.append(words)
            labels.append(ys)
            flags.append(known)
    names: dict[str, int] = {}
    counts: dict[str, int] = {}
    for words, known in zip(lines, flags):
        for w, k in zip(words, known):
            for f in features(w, k):
                counts[f] = counts.get(f, 0) + 1
    for f in ["<line>", *sorted(f for f, c in counts.items() if c >= 3)]:
        names.setdefault(f, len(names))
    n_lines, longest, reach = len(lines), max(map(len, lines)), max(OFFSETS)
    width, none = 8, len(names)
    ids = np.full((n_lines, longest + 2 * reach, width), none, dtype=np.int32)
    ids[:, :, 0] = names["<line>"]
    y = np.zeros((n_lines, longest), dtype=np.int64)
    mask = np.zeros((n_lines, longest), dtype=bool)
    for i, (words, ys, known) in enumerate(zip(lines, labels, flags)):
        for t, (w, k) in enumerate(zip(words, known)):
            found = [names[f] for f in features(w, k) if f in names][:width]
            ids[i, t + reach, :] = none
            ids[i, t + reach, : len(found)] = found
        y[i, : len(ys)] = ys
        mask[i, : len(ys)] = True
    n_labels, n_off = len(LABELS), len(OFFSETS)
    params = {"w": np.zeros((n_off, none + 1, n_labels)), "m": np.zeros((n_labels, n_labels))}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    order = np.argsort([-len(x) for x in lines])
    ids, y, mask = ids[order], y[order], mask[order]
    lengths = mask.sum(1)
    step = 0
    for epoch in range(epochs):
        shuffled = rng.permutation(n_lines)
        for chunk in np.array_split(shuffled, 16):
            chunk = np.sort(chunk)
            top = int(lengths[chunk].max())
            x, gold, m = ids[chunk], y[chunk, :top], mask[chunk, :top]
            scores = sum(params["w"][k][x[:, reach + o : reach + o + top]].sum(axis=2) for k, o in enumerate(OFFSETS))
            moves = params["m"]
            alpha = np.zeros_like(scores)
            alpha[:, 0] = scores[:, 0]
            for t in range(1, top):
                nxt = scores[:, t] + _logsumexp(alpha[:, t - 1][:, :, None] + moves[None], 1)
                alpha[:, t] = np.where(m[:, t, None], nxt, alpha[:, t - 1])
            total = _logsumexp(alpha[:, top - 1], 1)
            beta = np.zeros_like(scores)
            for t in range(top - 2, -1, -1):
                prev = _logsumexp(moves[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(m[:, t + 1, None], prev, 0.0)
            grad_scores = np.exp(alpha + beta - total[:, None, None]) * m[:, :, None]
            np.subtract.at(grad_scores, (np.arange(len(chunk))[:, None], np.arange(top)[None], gold), m.astype(float))
            grad_moves = np.zeros_like(moves)
            for t in range(1, top):
                live = m[:, t]
                pair = np.exp(alpha[live, t - 1][:, :, None] + moves[None] + (scores[live, t] + beta[live, t])[:, None, :] - total[live, None, None])
                grad_moves += pair.sum(0)
                np.subtract.at(grad_moves, (gold[live, t - 1], gold[live, t]), 1.0)
            grad_w = np.zeros_like(params["w"])
            for k, o in enumerate(OFFSETS):
                at = x[:, reach + o : reach + o + top].reshape(-1, width)
                flat = grad_scores.reshape(-1, n_labels)
                for lab in range(n_labels):
                    grad_w[k, :, lab] = np.bincount(at.ravel(), weights=np.repeat(flat[:, lab], width), minlength=none + 1)
            grads = {"w": grad_w / len(chunk) + 2e-5 * params["w"], "m": grad_moves / len(chunk)}
            grads["w"][:, none] = 0
            step += 1
            for key, g in grads.items():
                first[key] = 0.9 * first[key] + 0.1 * g
                second[key] = 0.999 * second[key] + 0.001 * g * g
                params[key] -= 0.06 * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)
    return Model(names, params["w"][:, :none].astype(np.float32), params["m"].astype(np.float32))


class _Types(dict):
    """Numbers of token types in order of arrival; 0 is the line's end."""

    def __missing__(self, w: str) -> int:
        self[w] = at = len(self)
        return at


class Tagger:
    """Decodes batches of texts; keeps the scores of token types it has met."""

    def __init__(self, model: Model, lexicon: frozenset[str] | set[str]) -> None:
        self.model, self.lexicon = model, set(lexicon)
        moves = model.moves
        # most that the moves into and out of one token can be worth against those of an ordinary token in its place
        self.gain = 2 * float(moves.max() - min(moves[0].min(), moves[:, 0].min()))
        self._forget()

    def _forget(self) -> None:
        self.types = _Types({_BOUND: 0})
        self.known = 0
        self.tables = [np.zeros((4096, len(LABELS)), dtype=np.float32) for _ in OFFSETS]
        self._learn()

    def _learn(self) -> None:
        """Scores of the types that are new."""
        new = list(self.types)[self.known :] if self.known < len(self.types) else []
        while len(self.types) > len(self.tables[0]):
            self.tables = [np.concatenate([t, np.zeros_like(t)]) for t in self.tables]
        for at, w in enumerate(new, self.known):
            rows = self.model.rows(w, w in self.lexicon)
            for k, table in enumerate(self.tables):
                table[at] = rows[k]
        self.known = len(self.types)

    def labels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(type of every token of all texts, its label, start of each text); a newline ends each text and is always ordinary."""
        if len(self.types) > REMEMBERED:
            self._forget()
        split = [tokens(t) for t in texts]
        starts = np.zeros(len(texts) + 1, dtype=np.int64)
        starts[1:] = np.cumsum([len(words) + 1 for words in split])
        flat: list[int] = []
        number = self.types.__getitem__
        for words in split:
            flat.extend(map(number, words))
            flat.append(0)
        self._learn()
        ids = np.array(flat, dtype=np.int32)
        out = np.zeros(len(ids), dtype=np.int8)
        if not len(ids):
            return ids, out, starts
        # every line's end is widened so that no neighbour lies in another line
        reach = max(OFFSETS)
        wide = np.where(ids == 0, reach, 1)
        place = reach + np.cumsum(wide) - wide
        padded = np.concatenate([np.zeros(reach, np.int32), np.repeat(ids, wide), np.zeros(reach, np.int32)])
        scores = self.tables[0][padded[place + OFFSETS[0]]]
        for table, o in zip(self.tables[1:], OFFSETS[1:]):
            scores += table[padded[place + o]]
        # exact bound: with any label, all other tokens are worse than ordinary whatever stands beside them
        hopeful = (scores[:, 1:].max(axis=1) - scores[:, 0] + self.gain > 0) & (ids != 0)
        if hopeful.any():
            edge = np.diff(np.concatenate([[0], hopeful.astype(np.int8), [0]]))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            inside = np.concatenate([[True], ids[:-1] == 0])
            self._viterbi(scores, first, last, ~inside[first], ids[np.minimum(last, len(ids) - 1)] != 0, out)
        return ids, out, starts

    def _viterbi(self, scores: np.ndarray, first: np.ndarray, last: np.ndarray, after: np.ndarray, before: np.ndarray, out: np.ndarray) -> None:
        """Labels of the runs [first, last); after and before say whether an ordinary token stands before and behind a run."""
        length = last - first
        order = np.argsort(-length, kind="stable")
        moves = self.model.moves
        for a in range(0, len(order), 8192):
            rows = order[a : a + 8192]
            size, start = length[rows], first[rows]
            top = int(size[0])
            longer = np.searchsorted(-size, -np.arange(top + 1), "left")  # runs longer than t
            best = scores[start] + after[rows, None] * moves[0]
            back = np.zeros((top, len(rows), len(LABELS)), dtype=np.int8)
            for t in range(1, top):
                live = longer[t]
                reach = best[:live, :, None] + moves[None]
                back[t, :live] = reach.argmax(axis=1)
                best[:live] = reach.max(axis=1) + scores[start[:live] + t]
            label = (best + before[rows, None] * moves[:, 0]).argmax(axis=1).astype(np.int8)
            for t in range(top - 1, -1, -1):
                live = longer[t]
                out[start[:live] + t] = label[:live]
                if t:
                    label[:live] = back[t, np.arange(live), label[:live]]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the items of each text, in order."""
        ids, labels, starts = self.labels(texts)
        result: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        hits = np.flatnonzero(labels)
        owner = np.searchsorted(starts, hits, "right") - 1
        for i in np.unique(owner):
            text, begin = texts[i], int(starts[i])
            at = hits[owner == i] - begin if len(hits) < 64 else hits[np.searchsorted(owner, i, "left") : np.searchsorted(owner, i, "right")] - begin
            ends = np.flatnonzero(ids[begin : int(starts[i + 1])] == 0)
            line_of = np.searchsorted(ends, at, "left")
            offsets = [0]
            for line in text.split("\n"):
                offsets.append(offsets[-1] + len(line) + 1)
            found: list[tuple[int, int, str]] = []
            for n in np.unique(line_of):
                first = 0 if n == 0 else int(ends[n - 1]) + 1
                row = labels[begin + first : begin + int(ends[n])].tolist()
                spot = 0
                for m, y in zip(_TOKEN.finditer(text, offsets[n], offsets[n + 1] - 1), row):
                    if not y:
                        continue
                    kind = LABELS[y]
                    if spot and found[-1][2] == kind and text[found[-1][1] : m.start()].strip(" \t\r") == "":
                        found[-1] = (found[-1][0], m.end(), kind)
                    else:
                        found.append((m.start(), m.end(), kind))
                    spot += 1
            result[i] = [s for s in (trimmed(text, *f) for f in found) if plausible(text[s[0] : s[1]], s[2])]
        return result


def trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int, str]:
    """The item without signs at its ends that belong to the sentence."""
    if kind == "email" and (sign := text.find("@", start, end)) >= 0:  # the whole of an address that the field found in part
        while start and (text[start - 1].isalnum() or text[start - 1] in "._+-'"):
            start -= 1
        while end < len(text) and text[end].isalnum():
            end += 1
        if sign and sign + 1 < end and not text[sign - 1].isspace() and not text[sign + 1].isspace():  # and no word beside it
            while end > sign and any(c.isspace() for c in text[sign:end]):
                end -= 1
            start = max([start, *(i + 1 for i in range(start, sign) if text[i].isspace())])
    keep_open = "+(" if kind == "phone" else ""
    while start < end and text[start] in "<>|»:;,.!?\"'*[]() -_" and text[start] not in keep_open:
        start += 1
    while end > start and text[end - 1] in "<>|»:;,!?\"'*[( -_" + ("" if kind in ("name", "address") else "."):
        end -= 1
    return start, end, kind


def plausible(item: str, kind: str) -> bool:
    """An exact check of what the field found: an item has the parts that its kind cannot be without."""
    n_digits = sum(c.isdigit() for c in item)
    if kind == "email":
        return "@" in item or bool(re.search(r"\bat\b", item, re.I))
    if kind == "phone":
        return 7 <= n_digits <= 16
    if kind == "id_number":
        return 6 <= n_digits <= 14
    if kind == "address":
        return n_digits >= 1 and len(item) >= 8 and " " in item and bool(_LETTERS.search(item))
    words = re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", item)
    return bool(words) and len(item) > 1 and words[-1][0].isupper() and all(w[0].isupper() or w in PARTICLES for w in words)


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


_NAME_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’\-]){2,}")


def name_words(names: DataFrame, column: str) -> DataFrame:
    """(w): the distinct words of a column of person names that begin with a capital, read as restored where garbled."""
    words = names.select(F.explode(F.split(F.col(column), r"\s+")).alias("w")).filter(F.col("w").rlike(r"^\p{Lu}[\p{L}'’\-]{2,}$")).distinct()
    return mojibake.with_restored(words, "w").distinct()


def _whole_fields(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    long = df.select(F.col(key), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("_text")) for f in fields])))
    return long.filter(F.col("_text").isNotNull() & _may_hold(F.col("_text")))


def _may_hold(text: Column) -> Column:
    """A name begins with a capital, everything else holds a digit or an at: texts without any of them are clean."""
    return (F.lower(text) != text) | text.contains("@") | text.rlike("[0-9]| at |[(\\[]at[)\\]]")


def _name_words_of(text: str) -> list[str]:
    return list({w for w in tokens(text) if w[0].isupper() and _NAME_WORD.fullmatch(w)})


def tagged_fields(df: DataFrame, lexicon: DataFrame | frozenset[str], key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field_name, kinds, clean_text) of each field that holds personal information.

    clean_text is the field, read as restored where it was garbled, with every item replaced by a placeholder of its kind. Null and
    empty fields hold nothing; repeated rows stay repeated; other columns are not read. The model is trained once and sent along,
    and with it the lexicon (a set, or a table of words) while it has at most LEXICON words. Of a larger one each text is joined
    with the words that stand in it, so that every word counts in both ways.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, field_name string, kinds array<string>, clean_text string"
    rows = _whole_fields(df, key, fields)
    if isinstance(lexicon, DataFrame):
        few = [r["w"] for r in lexicon.limit(LEXICON + 1).collect()]
        if len(few) > LEXICON:
            return _tagged_beside(rows, lexicon, key, kind).mapInPandas(_finder(spark.sparkContext.broadcast((trained(), frozenset())), key), out)
        lexicon = frozenset(few)
    return rows.mapInPandas(_finder(spark.sparkContext.broadcast((trained(), lexicon)), key), out)


def _finder(shared, key: str):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(*shared.value)
        for batch in batches:
            if "known" in batch:
                texts = list(batch["_text"])
                if len(tagger.types) > REMEMBERED:
                    tagger.lexicon.clear()
                    tagger._forget()
                tagger.lexicon.update(w for known in batch["known"] if known is not None for w in known)
            else:
                texts = [mojibake.repair(t)[0] for t in batch["_text"]]
            out = []
            for k, f, t, spans in zip(batch[key], batch["field_name"], texts, tagger.spans(texts)):
                if spans:
                    out.append((k, f, sorted({s[2] for s in spans}), replaced(t, spans)))
            yield pd.DataFrame(out, columns=[key, "field_name", "kinds", "clean_text"])

    return find


def _tagged_beside(rows: DataFrame, lexicon: DataFrame, key: str, kind: str) -> DataFrame:
    """rows, restored, with known: the words of each text that the lexicon holds. Common words meet it by the routed way."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [mojibake.repair(t)[0] for t in batch["_text"]]
            yield pd.DataFrame({key: batch[key], "field_name": batch["field_name"], "_text": texts, "words": [_name_words_of(t) for t in texts]})

    read_rows = rows.mapInPandas(read, f"{key} {kind}, field_name string, _text string, words array<string>").withColumn("_h", F.xxhash64("_text"))
    restored = written(read_rows, "restored-fields")
    asked = restored.select(key, "field_name", "_h", F.explode("words").alias("w")).distinct()
    counted = asked.groupBy("w").agg(F.count(F.lit(1)).alias("_n")).join(lexicon.select("w").distinct(), "w")
    known = routed_join(asked, counted, "w", "_n").groupBy(F.col(key).alias("_k"), F.col("field_name").alias("_f"), F.col("_h").alias("_kh")).agg(F.collect_set("w").alias("known"))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("field_name") == F.col("_f")) & (F.col("_h") == F.col("_kh"))
    return restored.join(known, same, "left").select(key, "field_name", "_text", "known")
