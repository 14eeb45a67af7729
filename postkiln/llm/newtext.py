"""Only the text newly written in each mail (problem 3).

Each mail is compared with all earlier mails of its conversation, of whatever branch: every run of LEAST_RUN words is hashed, an
index holds the earliest mail of each hash, and a word is inherited where it lies in a run whose earliest mail is an earlier one.
Mails stand in order of time, but never before the mail they answer; deliveries of one mail, and equal texts, are one mail.
Where all mails have one sender, nobody's text is carried on and a sender repeats their own phrases (alerts): there only the named
parent, else the mail before, is compared. Inherited spans are removed, marked or not; the rest of a copy is recognised by the lines of the mails that hit.
Marks of quoting (prefixes, attributions, header blocks) name what came from mails that are no longer in the store. Signatures
and notices are then looked for in what remains.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postkiln.llm import mojibake
from postkiln.operators.deliveries import cleaned_id
from postkiln.operators.skew import ranked_by_range
from postkiln.session import written

#: Words of a run that counts as inherited where an earlier mail holds it.
LEAST_RUN = 8
#: Most messages of a conversation that one task gathers, and most rows of the list of larger ones that is broadcast.
LARGEST, BROADCAST_ROWS = 2000, 50_000

_WORD = re.compile(r"\w+")
_PREFIX = re.compile(r"^[ \t]{0,8}(?:(?:>|\||»)[ \t]?)+")
_BARE_PREFIX = re.compile(r"^[ \t]{0,8}(?:[>|»][ \t]?)")
_TIME = re.compile(r"\d{1,2}[:.h]\d{2}")
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b|\d{1,2}[./-]\d{1,2}[./-]\d{2}")
_LAST_WORD = re.compile(r"(?:wrote|writes|schrieb(?: [^:]{1,80})?|escreveu|написал[аи]?|пишет|пиш[еу]т|said)\s*:\s*$", re.I)
# Words that stand between dashes or stars above an earlier mail, in the four languages.
_SEPARATOR = re.compile(
    r"^[ \t>|»]*(?:[-_*=]{2,} ?(?:original message|forwarded message|исходное сообщение|пересылаемое сообщение|пересланное сообщение|ursprüngliche nachricht|originalnachricht|"
    r"weitergeleitete nachricht|mensagem original|mensagem encaminhada|earlier in this thread|ранее в переписке|früher im verlauf|antes nesta conversa)[^\n]{0,60}?[-_*=]{2,}|begin forwarded message:)\s*$",
    re.I,
)
# Names of mail header lines in the four languages.
_HEADER = re.compile(r"^[ \t>|»]*\*?(from|sent|to|cc|date|subject|от|отправлено|кому|копия|дата|тема|von|gesendet|an|datum|betreff|kopie|de|enviad[oa](?: em)?|para|data|assunto)\*?\s*:\*?(?:\s|$)", re.I)
_RULE = re.compile(r"^[ \t]*[_-]{5,}[ \t]*$")
# Closing formulas of the four languages, each alone in its line.
_CLOSING = re.compile(
    r"^[ \t]*(?:best|best wishes|all the best|cheers|thanks|many thanks|thank you|thanks and regards|thanks & regards|kind regards|best regards|warm regards|warmly|regards|sincerely|yours sincerely|yours truly|yours|br|"
    r"с наилучшими(?: пожеланиями)?|с уважением|всего доброго|всего хорошего|спасибо|заранее спасибо|с благодарностью|хорошего дня|"
    r"viele grüße|viele grüsse|beste grüße|beste grüsse|mit freundlichen grüßen|mit freundlichen grüssen|freundliche grüße|liebe grüße|schöne grüße|herzliche grüße|grüße|gruß|vg|mfg|lg|danke|vielen dank|"
    r"atenciosamente|cordialmente|att|abraços|abraço|um abraço|obrigad[oa]|grat[oa]|cumprimentos|com os melhores cumprimentos|melhores cumprimentos|saudações)[ \t]*[,.!]{0,2}[ \t]*$",
    re.I,
)
# Lines that a mail program of a phone adds.
_DEVICE = re.compile(
    r"^[ \t]*(?:\(?(?:sent|written|typed) (?:from|with|on|via) (?:my|the|a|pocketmail|mobile|[\w ]{0,20}(?:phone|mail|handset|tablet))[^\n]{0,60}|sent from [^\n]{1,40}|get [\w ]+ for (?:ios|android)|\(typed on the go[^\n]{0,40}\)|"
    r"отправлено (?:с|из|от|через) [^\n]{1,40}|von (?:unterwegs|meinem [^\n]{1,30}) gesendet|gesendet (?:von|mit) [^\n]{1,40}|enviad[oa] (?:do|da|pelo|de|a partir d[oe]) [^\n]{1,40})[.!)]*[ \t]*$",
    re.I,
)
# Wording of notices to readers in the four languages.
_NOTICE = re.compile(
    r"(?:\[outside sender\]|\[external\]|\[extern\]|\[remetente externo\]|^\s*caution:|^\s*warning: external|внешний отправитель|externer absender|remetente externo|"
    r"you get this (?:mail|e-mail|message) (?:as|because)|to leave the list|unsubscribe|^\s*confidential(?:ity)?\b ?[-:–—]|^\s*notice ?:|meant for its addressees only|intended (?:only )?for (?:the|its)|"
    r"reached you in error|received (?:this|it) in error|contents are private|without written (?:leave|consent|permission)|unaudited and bind nobody|"
    r"предназначено только|получили (?:его|это|данное)[^.]{0,20} по ошибке|не являются офертой|не подлежат передаче|конфиденциальн[оы][^.]{0,40}(?:сообщени|информаци)|отписаться|"
    r"nur für die genannten empfänger|irrtümlich (?:erhalten|zugegangen)|^\s*vertraulich ?[:-]|weitergabe nur mit|bestimmt\. falls sie|"
    r"destinada apenas|recebeu por engano|^\s*aviso ?:|conteúdo reservado|sem autorização por escrito|confidencial ?[:-])",
    re.I,
)
_CARD = re.compile(r"^[^|\n]{3,60} \| [^|\n]{2,60}(?: \| [^|\n]{2,60}){0,3}$")


def _bare(line: str) -> str:
    return _PREFIX.sub("", line, count=1) if line[:9].lstrip()[:1] in (">", "|", "»") else line


_NO_HASHES = np.zeros(0, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolling(words: list[str], size: int = LEAST_RUN, code: Callable[[str], int] = hash) -> np.ndarray:
    """Hash of each ``size`` consecutive words: one polynomial, rolled over the whole text at once."""
    if len(words) < size:
        return _NO_HASHES
    codes = np.fromiter(map(code, words), dtype=np.int64, count=len(words)).view(np.uint64)
    n = len(codes) - size + 1
    out = codes[:n].copy()
    for k in range(1, size):
        out *= _BASE
        out += codes[k : k + n]
    return out ^ (out >> np.uint64(29))


def _code(text: str) -> int:
    """A hash that is the same in every process."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_word_code = lru_cache(maxsize=100_000)(_code)


def _runs(text: str, code: Callable[[str], int] = hash) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(lines, line of each word, hash of each run of LEAST_RUN words) of a text."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    found = [_WORD.findall(_bare(line).lower()) for line in lines]
    owner = np.repeat(np.arange(len(lines)), [len(f) for f in found])
    return lines, owner, _rolling([w for f in found for w in f], LEAST_RUN, code)


def _shares(n_lines: int, owner: np.ndarray, inherited: np.ndarray) -> list[float]:
    """For each line the share of its words that lie in inherited runs; -1 without words."""
    hit = np.zeros(len(owner), dtype=bool)
    for k in range(LEAST_RUN if len(inherited) else 0):
        hit[k : k + len(inherited)] |= inherited
    total = np.bincount(owner, minlength=n_lines)
    hits = np.bincount(owner, weights=hit, minlength=n_lines)
    return np.where(total > 0, hits / np.maximum(total, 1), -1.0).tolist()


def _stripped(lines: list[str]) -> set[str]:
    return {x.strip() for x in lines if x.strip()}


# One of these stands in every notice; they spare most paragraphs the search.
_NOTICE_KEYS = ("outside sender", "extern", "caution:", "внешний отправитель", "you get this", "to leave the list", "unsubscribe", "confiden", "notice", "addressees only", "intended", "in error", "you in error", "contents are private", "without written", "unaudited", "предназначено только", "по ошибке", "офертой", "не подлежат", "конфиденциальн", "отписаться", "genannten empfänger", "irrtümlich", "vertraulich", "weitergabe nur", "falls sie", "destinada apenas", "por engano", "aviso", "conteúdo reservado", "sem autorização")


def _is_notice(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in _NOTICE_KEYS) and bool(_NOTICE.search(text))


def _is_attribution(line: str) -> bool:
    """A line that names the date and the writer of the mail quoted below it."""
    s = line.strip().lstrip(">|» \t")
    return len(s) < 200 and s.endswith(":") and bool(_TIME.search(s) and (_YEAR.search(s) or _LAST_WORD.search(s)) or _LAST_WORD.search(s) and _YEAR.search(s))


def classify(text: str, ancestor: str | None, names: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """``classified`` beside one earlier mail, or none."""
    lines, owner, runs = _runs(text)
    theirs, _, their_runs = _runs(ancestor or "")
    return lines, classified(lines, _shares(len(lines), owner, np.isin(runs, their_runs)), _stripped(theirs).__contains__, names)


def classified(lines: list[str], share: list[float], is_theirs: Callable[[str], bool], names: tuple[str, ...] = ()) -> list[str]:
    """The kind of each line: '' for newly written text, 'quoted', 'signature' or 'disclaimer'.

    ``share`` is the inherited share of each line's words, ``is_theirs`` whether a line stands in a mail it is inherited from.
    """
    n = len(lines)
    kind = [""] * n
    blank = [not _bare(x).strip() for x in lines]
    # from a separator, a header block or an attribution without prefixes below it, everything is quoted
    i = 0
    while i < n:
        line = lines[i]
        if kind[i]:
            i += 1
            continue
        if _SEPARATOR.match(line):
            kind[i:] = ["quoted"] * (n - i)
            break
        if _HEADER.match(line):
            j = i
            labels = set()
            while j < n and (m := _HEADER.match(lines[j])):
                labels.add(m[1].lower())
                j += 1
            if len(labels) >= 3:
                start = i - 1 if i and _RULE.match(lines[i - 1]) else i
                kind[start:] = ["quoted"] * (n - start)
                break
            i = j
            continue
        if _is_attribution(line) or (i + 1 < n and not blank[i] and lines[i + 1].rstrip().endswith(":") and len(line) < 120 and _TIME.search(line) and _LAST_WORD.search(lines[i + 1]) and _is_attribution(line.rstrip() + " " + lines[i + 1].lstrip())):
            j = i + 1 if _is_attribution(line) else i + 2
            k = j
            while k < n and blank[k] and not _BARE_PREFIX.match(lines[k]):
                k += 1
            if k < n and _BARE_PREFIX.match(lines[k]):
                kind[i:k] = ["quoted"] * (k - i)
                i = k
                continue
            if k < n:
                kind[i:] = ["quoted"] * (n - i)
                break
        i += 1
    prefixed = [bool(_BARE_PREFIX.match(x)) for x in lines]
    n_prefixed = sum(prefixed)
    for i in range(n):
        if kind[i] or not prefixed[i]:
            continue
        mark = lines[i].lstrip()[0]
        alone = n_prefixed == 1 or not ((i and prefixed[i - 1]) or (i + 1 < n and prefixed[i + 1]))
        carries_on = i and not blank[i - 1] and not prefixed[i - 1] and lines[i - 1].rstrip()[-1:] not in ".:!?…»\"“”)," and not kind[i - 1]
        if share[i] >= 0.5 or (mark == ">" and not (alone and carries_on) and not re.match(r"\s*>\s*=?\s*\d+\s*(?:ms|%|s|kb|mb|gb)\b", lines[i], re.I)) or (mark in "|»" and n_prefixed >= 2):
            kind[i] = "quoted"
    # unmarked text of earlier mails: whole lines that are aligned with it, and what stands between such lines
    copied = [i for i in range(n) if not kind[i] and share[i] >= 0.6 and not (_is_notice(lines[i]) or _CLOSING.match(lines[i]) or _DEVICE.match(lines[i]) or _CARD.match(lines[i]))]
    # a name block is not a quotation: lines shorter than a sentence count only beside longer ones
    solid = [i for i in copied if len(_WORD.findall(lines[i])) >= LEAST_RUN]
    for i in solid:
        kind[i] = "quoted"
    beside = {s + k for s in solid for k in range(-2, 3)}
    for i in copied:
        if not kind[i] and i in beside:
            kind[i] = "quoted"
    if solid:
        # the rest of an appended copy: greeting above it, signature and notices below it
        first, last = solid[0], solid[-1]
        for step, at in ((-1, first - 1), (1, last + 1)):
            while 0 <= at < n and (blank[at] or is_theirs(_bare(lines[at]).strip())) and kind[at] in ("", "quoted"):
                if not blank[at]:
                    kind[at] = "quoted"
                at += step
    live = [i for i in range(n) if not kind[i] and lines[i].strip()]
    if live:
        _notices(lines, kind, live)
        _signature(lines, kind, [i for i in live if not kind[i]], names)
    return kind


def _notices(lines: list[str], kind: list[str], live: list[int]) -> None:
    """Notices stand at the top or at the bottom of what is not quoted; each is a paragraph of its own."""

    def paragraph(at: int) -> tuple[int, int]:
        a = b = at
        while a - 1 >= 0 and lines[a - 1].strip() and not kind[a - 1]:
            a -= 1
        while b + 1 < len(lines) and lines[b + 1].strip() and not kind[b + 1]:
            b += 1
        return a, b

    for order in (live, live[::-1]):
        for at in order:
            if kind[at]:
                continue
            a, b = paragraph(at)
            block = " ".join(x.strip() for x in lines[a : b + 1])
            m = _is_notice(lines[at]) or (b - a < 6 and _is_notice(block))
            if m and len(block) < 1200:
                lo, hi = (a, b) if _is_notice(lines[a]) or b - a < 3 and not _CLOSING.match(lines[a]) else (at, at)
                if _is_notice(lines[at]):
                    lo, hi = (at, at) if any(_CLOSING.match(x) or _DEVICE.match(x) for x in lines[a : b + 1]) else (at, b)
                kind[lo : hi + 1] = ["disclaimer"] * (hi - lo + 1)
                continue
            break


def _signature(lines: list[str], kind: list[str], live: list[int], names: tuple[str, ...]) -> None:
    wanted = {x for name in names for x in (name.lower(), name.lower().split(" ")[0]) if x}

    def short_until_end(at: int) -> bool:
        rest = [i for i in live if i > at and not kind[i]]
        stop = []
        for i in rest:
            if len(stop) and i - stop[-1] > 2:
                break
            stop.append(i)
        return bool(rest) and all(len(lines[i]) <= 90 for i in stop) and len(stop) <= 7 and not lines[rest[0]].rstrip().endswith((".", ";"))

    for at in live:
        s = lines[at].strip()
        if kind[at]:
            continue
        if _DEVICE.match(s):
            kind[at] = "signature"
            continue
        starts = (
            _CLOSING.match(s)
            or (s in ("--", "—", "-- ") or re.fullmatch(r"[_-]{5,}|-{2,4}", s)) and short_until_end(at)
            or s.lower() in wanted and at != live[0]
            or _CARD.match(s) and ("tel" in s.lower() or re.search(r"\d{3}", s) or "@" in s or any(w and s.lower().startswith(w) for w in wanted))
        )
        if starts and (not _CLOSING.match(s) or at != live[0] or len(live) <= 3):
            end = at
            for i in live:
                if i > at and i - end <= 2 and not kind[i] and len(lines[i]) <= 90 and not _HEADER.match(lines[i]):
                    end = i
            for i in live:
                if at <= i <= end and not kind[i]:
                    kind[i] = "signature"


def newly_written(text: str | None, ancestor: str | None, names: tuple[str, ...] = ()) -> tuple[str | None, list[str]]:
    """(the newly written text, the kinds of what was left out). Null stays null, without kinds."""
    if text is None:
        return None, []
    if ancestor is not None and ancestor.split() == text.split():
        ancestor = None  # another delivery of the same mail, not an earlier one
    return _split(*classify(text, ancestor, names))


def _split(lines: list[str], kind: list[str]) -> tuple[str, list[str]]:
    kept = "\n".join(x for x, k in zip(lines, kind) if not k)
    return re.sub(r"\n{3,}", "\n\n", kept).strip(), [k for k in ("quoted", "signature", "disclaimer") if k in kind]


def ancestors(rows: DataFrame) -> DataFrame:
    """(row_id, ancestor_row): the nearest mail above each message that is in the store.

    ``rows`` is narrow: row_id, conversation_id, id, parent, when. The ancestor is the named parent if the same conversation has
    it, else the mail before it in the conversation. That second way is sorted by day, so a conversation of any size is never
    sorted in one task.
    """
    firsts = rows.filter("id IS NOT NULL").groupBy("conversation_id", F.col("id").alias("parent")).agg(F.min("row_id").alias("named"))
    rows = rows.withColumn("_day", F.to_date("when"))
    value = F.struct("row_id", "id", "parent")
    near = F.lag(value).over(Window.partitionBy("conversation_id", "_day").orderBy("when", "row_id"))
    last = rows.groupBy("conversation_id", "_day").agg(F.max_by(value, F.struct("when", "row_id")).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("conversation_id").orderBy("_day"))).drop("_last")
    timed = rows.withColumn("_near", near).join(carry, ["conversation_id", "_day"], "left").withColumn("_before", F.coalesce("_near", "_carry"))
    both = timed.join(firsts, ["conversation_id", "parent"], "left")
    # neither another delivery of the same mail nor an answer to it
    other = F.when(F.coalesce(F.col("_before.id") != F.col("id"), F.lit(True)) & F.coalesce(F.col("_before.parent") != F.col("id"), F.lit(True)), F.col("_before.row_id"))
    return both.select("row_id", F.coalesce(F.when(F.col("named") != F.col("row_id"), F.col("named")), other).alias("ancestor_row")).filter("ancestor_row IS NOT NULL")


def places(keys: DataFrame) -> DataFrame:
    """(conversation_id, row_id, id, place): rows numbered within their conversation by time, but after the mail they answer.

    A row that does not stand after its parent takes the parent's time, one step deeper. That is passed down until nothing
    changes, so it takes as many rounds as rows out of order follow each other. A circle of replies ends where the time came from.
    """
    firsts = keys.filter("id IS NOT NULL").groupBy("conversation_id", F.col("id").alias("parent")).agg(F.min("row_id").alias("_above"))
    state = keys.join(firsts, ["conversation_id", "parent"], "left").withColumn("_above", F.nullif("_above", "row_id")).withColumn("_at", F.struct("when", "row_id")).withColumn("_depth", F.lit(0))
    while True:
        state = written(state, "large-places")
        above = state.select(F.col("row_id").alias("_above"), F.col("_at").alias("_their_at"), (F.col("_depth") + 1).alias("_their_depth"))
        late = (F.col("_their_at.row_id") != F.col("row_id")) & (F.struct("_their_at", "_their_depth") > F.struct("_at", "_depth"))
        moved = written(state.join(above, "_above").filter(late).select("row_id", "_their_at", "_their_depth"), "large-moved")
        if moved.isEmpty():
            break
        state = state.join(moved, "row_id", "left").withColumn("_at", F.coalesce("_their_at", "_at")).withColumn("_depth", F.coalesce("_their_depth", "_depth")).drop("_their_at", "_their_depth")
    days = state.withColumn("_day", F.coalesce(F.unix_date(F.to_date("_at.when")), F.lit(-(2**31))).cast("bigint"))
    return ranked_by_range(days, "conversation_id", "_day", [F.col("_at.when"), F.col("_at.row_id"), F.col("_depth"), F.col("row_id")], "place").select("conversation_id", "row_id", "id", F.col("place").cast("bigint").alias("place"))


_OUT = "row_id bigint, new_text string, left_out array<string>"
_READ = "row_id bigint, conversation_id string, text_body string, from_name string, same bigint, runs array<bigint>, lines array<bigint>"


def _names(name: object) -> tuple[str, ...]:
    return (name,) if isinstance(name, str) and name else ()


def _in_place(rows: list[tuple], above: list[int | None]) -> list[int]:
    """The numbers of ``places``, for rows in order of time with the index of each one's parent."""
    at = [(i, 0) for i in range(len(rows))]
    moved = True
    while moved:
        moved = False
        for i, up in enumerate(above):
            if up is not None and at[up][0] != i and (at[up][0], at[up][1] + 1) > at[i]:
                at[i], moved = (at[up][0], at[up][1] + 1), True
    out = [0] * len(rows)
    for place, i in enumerate(sorted(range(len(rows)), key=lambda i: (at[i], rows[i][0]))):
        out[i] = place
    return out


def _conversation(rows: list[tuple]) -> list[tuple]:
    """The mails of a conversation, (row_id, id, parent, text_body, from_name, sender) in order of time, each beside all earlier ones."""
    if not rows:
        return []
    bodies = [mojibake.repair(r[3])[0] if isinstance(r[3], str) else None for r in rows]
    at = {r[0]: i for i, r in enumerate(rows)}
    firsts: dict[str, int] = {}
    for row, key, *_ in rows:
        if isinstance(key, str):
            firsts[key] = min(row, firsts.get(key, row))
    named = [at[firsts[r[2]]] if isinstance(r[2], str) and r[2] in firsts and firsts[r[2]] != r[0] else None for r in rows]
    place = _in_place(rows, named)
    by_id: dict[str, int] = {}
    by_text: dict[str, int] = {}
    same = [None if b is None else " ".join(b.split()) for b in bodies]
    for (_, key, *_), text, n in zip(rows, same, place):
        if isinstance(key, str):
            by_id[key] = min(n, by_id.get(key, n))
        if text is not None:
            by_text[text] = min(n, by_text.get(text, n))
    mail = [min(n, by_id.get(r[1], n) if isinstance(r[1], str) else n, by_text.get(t, n)) for r, t, n in zip(rows, same, place)]
    read = [None if b is None else _runs(b) for b in bodies]
    runs = [_NO_HASHES if x is None else x[2] for x in read]
    _, which = np.unique(np.concatenate(runs), return_inverse=True)
    first = np.full(len(which), len(rows), dtype=np.int64)
    np.minimum.at(first, which, np.repeat(np.array(mail, dtype=np.int64), [len(x) for x in runs]))
    of_mail: dict[int, list[int]] = {}
    for i, n in enumerate(mail):
        of_mail.setdefault(n, []).append(i)
    alone = len({r[5] for r in rows if isinstance(r[5], str) and r[5]}) < 2
    known: dict[int, set[str]] = {}

    def lines_of(n: int) -> set[str]:
        if n not in known:
            known[n] = set().union(*(_stripped(read[i][0]) for i in of_mail[n] if read[i] is not None))
        return known[n]

    out, start = [], 0
    for i, (row, key, _, _, name, _) in enumerate(rows):
        source = first[which[start : start + len(runs[i])]]
        start += len(runs[i])
        if read[i] is None:
            continue
        up = named[i]
        if up is None and i and not (isinstance(key, str) and key in rows[i - 1][1:3]):
            up = i - 1
        lines, owner, _ = read[i]
        if up is not None and mail[up] >= mail[i]:
            up = None
        inherited = np.isin(runs[i], runs[up] if up is not None else _NO_HASHES) if alone else source < mail[i]
        near = (set() if alone else {int(n) for n in np.unique(source[inherited])}) | (set() if up is None else {mail[up]})
        kind = classified(lines, _shares(len(lines), owner, inherited), lambda x: any(x in lines_of(n) for n in near), _names(name))
        out.append((row, *_split(lines, kind)))
    return out


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversation after conversation of a partition sorted by conversation and time; only one is held."""
    current, rows, out = None, [], []
    for batch in batches:
        for conversation, *rest in batch[["conversation_id", "row_id", "id", "parent", "text_body", "from_name", "sender"]].itertuples(index=False, name=None):
            if conversation != current:
                out += _conversation(rows)
                current, rows = conversation, []
            rows.append(tuple(rest))
        if len(out) > 1000:
            yield pd.DataFrame(out, columns=["row_id", "new_text", "left_out"])
            out = []
    yield pd.DataFrame(out + _conversation(rows), columns=["row_id", "new_text", "left_out"])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each body as restored, with a key of its words and the hashes of its runs and lines."""
    for batch in batches:
        out = []
        for row, conversation, text, name in batch[["row_id", "conversation_id", "text_body", "from_name"]].itertuples(index=False, name=None):
            body = mojibake.repair(text)[0]
            lines, _, runs = _runs(body, _word_code)
            out.append((row, conversation, body, name if isinstance(name, str) else None, _code(" ".join(body.split())), np.unique(runs.view(np.int64)), [_code(x) for x in _stripped(lines)]))
        yield pd.DataFrame(out, columns=["row_id", "conversation_id", "text_body", "from_name", "same", "runs", "lines"])


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kinds of the lines of each restored body, beside the hashes of its inherited runs and of the lines of the mails that hit."""
    for batch in batches:
        out = []
        for row, text, name, hits, theirs in batch[["row_id", "text_body", "from_name", "hits", "theirs"]].itertuples(index=False, name=None):
            lines, owner, runs = _runs(text, _word_code)
            inherited = np.zeros(len(runs), dtype=bool) if hits is None else np.isin(runs.view(np.int64), np.asarray(hits, dtype=np.int64))
            known = frozenset(() if theirs is None else np.asarray(theirs, dtype=np.int64).tolist())
            out.append((row, *_split(lines, classified(lines, _shares(len(lines), owner, inherited), lambda x: _code(x) in known, _names(name)))))
        yield pd.DataFrame(out, columns=["row_id", "new_text", "left_out"])


def _beside_earlier(read: DataFrame, keys: DataFrame) -> DataFrame:
    """(row_id, hits, theirs) of rows of large conversations: hashes of their inherited runs, and of the lines of the mails that hit.

    All by keys of many values (conversation and hash, row), so no task gathers a conversation.
    """
    placed = written(places(keys), "large-order")
    by_id = placed.filter("id IS NOT NULL").groupBy("conversation_id", "id").agg(F.min("place").alias("_by_id"))
    with_same = placed.join(read.select("row_id", "same"), "row_id")
    by_text = with_same.groupBy("conversation_id", "same").agg(F.min("place").alias("_by_text"))
    mails = written(with_same.join(by_id, ["conversation_id", "id"], "left").join(by_text, ["conversation_id", "same"]).select("conversation_id", "row_id", F.least("place", "_by_id", "_by_text").alias("mail")), "large-mails")
    talks = written(keys.groupBy("conversation_id").agg((F.min("sender") != F.max("sender")).alias("_talk")).filter("_talk").select("conversation_id"), "large-talks")
    runs = read.select("row_id", "runs").join(mails.join(talks, "conversation_id", "left_semi"), "row_id").select("conversation_id", "row_id", "mail", F.explode("runs").alias("run"))
    firsts = runs.groupBy("conversation_id", "run").agg(F.min("mail").alias("first"), F.max("mail").alias("_last")).filter("first < _last").drop("_last")
    among = written(runs.join(firsts, ["conversation_id", "run"]).filter("first < mail").groupBy("conversation_id", "row_id").agg(F.collect_list("run").alias("hits"), F.collect_set("first").alias("sources")), "large-hits")
    mine, theirs = mails.select("row_id", "mail"), mails.select(F.col("row_id").alias("ancestor_row"), F.col("mail").alias("_theirs"))
    near = ancestors(keys).join(mine, "row_id").join(theirs, "ancestor_row").filter("_theirs < mail").select("row_id", "ancestor_row")
    theirs_runs = read.select(F.col("row_id").alias("ancestor_row"), F.col("runs").alias("_runs"))
    before = near.join(mails.join(talks, "conversation_id", "left_anti").select("row_id"), "row_id", "left_semi").join(read.select("row_id", "runs"), "row_id").join(theirs_runs, "ancestor_row")
    hits = among.select("row_id", "hits").unionByName(before.select("row_id", F.array_intersect("runs", "_runs").alias("hits")))
    hit = among.select("conversation_id", "row_id", F.explode("sources").alias("mail")).join(mails.withColumnRenamed("row_id", "ancestor_row"), ["conversation_id", "mail"]).select("row_id", "ancestor_row")
    lines = near.unionByName(hit).distinct().join(read.select(F.col("row_id").alias("ancestor_row"), "lines"), "ancestor_row").groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("theirs"))
    return hits.select("row_id", "hits").join(lines, "row_id")


def with_new_text(messages: DataFrame, bodies: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(row_id, new_text, left_out) of each message: its newly written text and the kinds of what was left out.

    ``messages`` has utc_us, the instant of each mail or null (then its time of storage stands in) and sender_email; ``bodies`` is the plain table
    (row_id, conversation_id, text_body, from_name), so that what needs no instants does not compute them. Garbled bodies are read
    as restored. Null and blank bodies have nothing left out; messages without conversation have no ancestor and are judged by
    marks alone; repeated deliveries are judged each by itself. row_id must be unique.

    Bodies are shuffled once, by conversation. Conversations of more than ``largest`` messages never are: hashes of their runs
    meet in joins, so no task gathers such a conversation.
    """
    when = F.coalesce(F.timestamp_micros("utc_us"), F.col("ingested_at").cast("timestamp")).alias("when")
    named = F.col("conversation_id").isNotNull() & (F.col("conversation_id") != "")
    sender = F.nullif(F.lower(F.trim("sender_email")), F.lit("")).alias("sender")
    keys = ["conversation_id", "row_id", sender, cleaned_id("msg_id").alias("id"), cleaned_id("in_reply_to").alias("parent"), when]
    plain = bodies.filter(named)
    sizes = written(plain.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > largest).select("conversation_id", F.lit(True).alias("_large")), "large-conversations")
    side = F.broadcast(sizes) if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else sizes
    cold = messages.filter(named).select(*keys, "text_body", "from_name").join(side, "conversation_id", "left_anti")
    small = cold.repartition("conversation_id").sortWithinPartitions("conversation_id", "when", "row_id").mapInPandas(_conversations, _OUT)

    keys_of_large = written(messages.filter(named).select(*keys).join(side, "conversation_id", "left_semi"), "large-keys")
    read = written(plain.filter("text_body IS NOT NULL").join(side, "conversation_id", "left_semi").mapInPandas(_read, _READ), "large-bodies")
    large = read.select("row_id", "text_body", "from_name").join(_beside_earlier(read, keys_of_large), "row_id", "left").mapInPandas(_judged, _OUT)
    alone = bodies.filter(~named | F.col("conversation_id").isNull()).filter("text_body IS NOT NULL").select("row_id", "text_body", "from_name")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(row, *newly_written(mojibake.repair(text)[0], None, _names(name))) for row, text, name in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["row_id", "new_text", "left_out"])

    return small.unionByName(large).unionByName(alone.mapInPandas(judge, _OUT))
