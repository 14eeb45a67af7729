"""Text decoded with the wrong character encoding: finding it and putting the original back (problem 2).

Round trip: the text is encoded again with a candidate legacy encoding and strictly decoded with the intended one; nested
layers are undone by repeating that; a step counts only when a garbling cost drops. Plain ASCII is set aside natively, and most
of the rest by a look at the characters that a text uses (``suspicious``).
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legacy encodings that text was read with by mistake.
READ_AS = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "cp1250")
#: One-byte confusions, as (read with, meant).
ONE_BYTE = (
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp866"), ("cp866", "koi8-r"),
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1252", "cp866"), ("latin-1", "cp866"),
    ("mac-roman", "cp1251"), ("cp437", "cp1251"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac-roman", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"),
    ("cp1252", "mac-roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("latin-1", "cp850"), ("latin-1", "mac-roman"),
)

# Share of each letter in Russian text, in thousandths.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4, 4)))
#: Letters with marks that the four languages use (English has none of its own).
LETTERS = "äöüßÄÖÜáàâãçéêíóôõúÁÀÂÃÇÉÊÍÓÔÕÚñÑ"
#: Signs that clean mail uses now and then.
SIGNS = "«»“”„‘’‚‹›–—…•·€£¥¢§©®™°±²³¼½¾№×÷≈≤≥→←↑↓✓✔✅⚠☎☺\xa0  ​‍️¿¡ºª¹"

_SAFE = frozenset(map(chr, range(128))) | frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ") | frozenset(LETTERS) - {"Ñ"} | frozenset(SIGNS) | {"\u0301", "\u0303", "\u0308"}
_CYRILLIC_CAPITALS = frozenset("АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
_LEADS, _ACCENTS = frozenset("ÂÃâãÔ"), frozenset(LETTERS)
# what a search begins with is the rarer character, so that most places are passed over at once
_TURNED = re.compile("(?<=[а-яё])[А-ЯЁ]|[А-ЯЁ]{3}")
_MIXED = re.compile("[A-Za-z][А-Яа-яЁё]|(?<=[А-Яа-яЁё])[A-Za-z]")
_LATIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_CYRILLIC = frozenset("АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдеёжзийклмнопрстуфхцчшщъыьэюя")
_LED = re.compile("Ô[À-ÿ]|[ÂÃâã][^\x00-\x7fA-Za-zà-üÀ-Ü]|Â(?= )")
_ODD_PLACE = re.compile("(?<=[a-z])[ÀÁÂÃÄÇÉÊÍÓÔÕÖÚÜ]|(?<![aeiouyäöüAEIOUÄÖÜ])(?<=.)ß|[À-ÖØ-öø-ÿ]{3}", re.S)
_INSIDE = frozenset("¡¢£¥§©®°±²³¼½¾×÷‚„‘“”‹›€™•¿ºª¹")
_SIGN_INSIDE = re.compile("(?<=[^\\W\\d_])[¡¢£¥§©®°±²³¼½¾×÷‚„‘“”‹›€™•¿ºª¹][^\\W\\d_]")


def suspicious(text: str) -> bool:
    """Whether a text may hold garbled parts: true for every text that ``repair`` would change, and for some clean ones.

    Most texts are settled by their set of characters: those that a legacy encoding can produce and the four languages do not use
    (controls, boxes, letters of neighbouring alphabets, typesetting signs). Characters that no such encoding has, emoji among
    them, are no sign of a wrong one. The rest is looked through for turned case, mixed alphabets, a lead byte with a sign
    after it, and accents or signs in odd places.
    """
    if text.isascii():
        return False
    used = set(text)
    if not used.isdisjoint(_ODD):
        return True
    if not used.isdisjoint(_CYRILLIC_CAPITALS) and _TURNED.search(text):
        return True
    if not used.isdisjoint(_LATIN) and not used.isdisjoint(_CYRILLIC) and _MIXED.search(text):
        return True
    if not used.isdisjoint(_ACCENTS) and (_ODD_PLACE.search(text) or (not used.isdisjoint(_LEADS) and _LED.search(text))):
        return True
    return not used.isdisjoint(_INSIDE) and bool(_SIGN_INSIDE.search(text))


def not_ascii(text: Column) -> Column:
    """Native test that sets plain ASCII aside: as many bytes as characters."""
    return F.octet_length(text) != F.char_length(text)


def _table(name: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out.setdefault(bytes([b]).decode(name), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)  # bytes without a meaning often pass as control characters
    if name == "mac-roman":
        out.setdefault("¤", 0xDB)
    return out


_ENCODE = {name: {ord(c): b for c, b in _table(name).items()} for name in dict.fromkeys((*READ_AS, *(a for a, _ in ONE_BYTE)))}
_ASCII = {i: i for i in range(128)}
_ENCODE = {name: _ASCII | table for name, table in _ENCODE.items()}
_ODD = frozenset(chr(o) for table in _ENCODE.values() for o in table) - _SAFE | {"\ufffd"}
_RUN = re.compile(r"[^\x00-\x7f]+")


def _utf8_pattern(name: str) -> re.Pattern:
    """Stretches of characters that are valid multi-byte UTF-8 once they are bytes of ``name`` again."""
    chars = {b: chr(o) for o, b in _ENCODE[name].items()}
    of = lambda low, high: "[" + "".join(re.escape(chars[b]) for b in range(low, high + 1) if b in chars) + "]"
    more = of(0x80, 0xBF)
    three = f"{of(0xE0, 0xE0)}{of(0xA0, 0xBF)}{more}|{of(0xE1, 0xEC)}{more}{more}|{of(0xED, 0xED)}{of(0x80, 0x9F)}{more}|{of(0xEE, 0xEF)}{more}{more}"
    four = f"{of(0xF0, 0xF0)}{of(0x90, 0xBF)}{more}{more}|{of(0xF1, 0xF3)}{more}{more}{more}|{of(0xF4, 0xF4)}{of(0x80, 0x8F)}{more}{more}"
    return re.compile(f"(?:{of(0xC2, 0xDF)}{more}|{three}|{four})+")


_UTF8 = {name: _utf8_pattern(name) for name in READ_AS}
_SEGMENT = re.compile(r"[^\n.!?]*[.!?]*[ \t]*\n*")
#: Words with a letter outside ASCII, and signs outside ASCII between letters.
_MARKED_WORD = re.compile(r"[A-Za-z]*[^\W\d_A-Za-z][^\W\d_]*")
_INNER = re.compile(r"(?<=[^\W\d_])[^\w\s\x00-\x7f’–—]+(?=[^\W\d_])")


def _char_cost(c: str) -> float:
    o = ord(c)
    if o < 128:
        return 0.0
    low = c.lower()
    if low in RUSSIAN:
        return math.log2(55 / max(RUSSIAN[low], 1)) * 0.45
    if c in LETTERS:
        return 0.35
    if c in SIGNS:
        return 0.7
    if 0x80 <= o < 0xA0:
        return 5.0
    if c == "\ufffd":
        return 4.0
    if 0x2500 <= o <= 0x25A0 or 0x2300 <= o < 0x2400:
        return 3.0
    if 0x400 <= o < 0x500:
        return 2.5
    if o >= 0x1F000 or 0x2600 <= o < 0x27C0 or 0xFE00 <= o <= 0xFE0F or 0x300 <= o <= 0x36F:
        return 0.5
    if 0xC0 <= o <= 0x24F:
        return 1.8
    if c.isalpha() and o >= 0x500:
        return 6.0  # a letter of another script, which chance makes of two letters
    return 2.6


class _Costs(dict):
    def __missing__(self, c: str) -> float:
        self[c] = value = _char_cost(c)
        return value


_COSTS = _Costs()


@lru_cache(maxsize=200_000)
def _word_cost(w: str) -> float:
    cost = 0.0
    latin = cyrillic = False
    marked = 0
    for c in w:
        o = ord(c)
        if 0x400 <= o < 0x500:
            cyrillic = True
        elif o < 0x250:
            latin = True
            marked += o > 127
    if latin and cyrillic:
        cost += 3.0
    if len(w) > 1:
        body = w[1:]
        if cyrillic and not w.islower() and not w.istitle():
            cost += 0.8 * min(len(w), 4) if w.isupper() else 3.0
        elif latin and marked:
            # an accented capital after a small letter, or words made of accents
            if any(a.islower() and b.isupper() and ord(b) > 127 for a, b in zip(w, body)):
                cost += 3.0
            if marked >= 3 and marked * 2 > len(w):
                cost += 1.2 * marked
            if "ß" in w and (w.startswith("ß") or (len(w) < 4 and w != "aß")):
                cost += 1.5
    return cost


def cost(text: str) -> float:
    """How garbled a text looks: 0 for ASCII, about 0 for clean text of the four languages, above it for garbled text."""
    if text.isascii():
        return 0.0
    total = sum(map(_COSTS.__getitem__, "".join(_RUN.findall(text))))
    total += sum(map(_word_cost, _MARKED_WORD.findall(text)))
    return total + 1.5 * len(_INNER.findall(text))


def _to_bytes(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _ENCODE[name])[0]
    except UnicodeEncodeError:
        return None


def _utf8_runs(text: str, name: str) -> str:
    """The text with every stretch of ``name`` characters that is valid multi-byte UTF-8 decoded."""
    table = _ENCODE[name]
    return _UTF8[name].sub(lambda m: codecs.charmap_encode(m.group(), "strict", table)[0].decode("utf-8"), text)


#: Candidates in a fixed order; of equal drops the first wins.
_CANDIDATES: tuple[tuple[str, str], ...] = (*((name, "utf-8") for name in READ_AS), *ONE_BYTE)


def _below(text: str, read: str, meant: str) -> str | None:
    if meant == "utf-8":
        return _utf8_runs(text, read)
    raw = _to_bytes(text, read)
    try:
        return raw.decode(meant) if raw is not None else None
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=20_000)
def _steps(text: str) -> tuple[tuple[float, int, str], ...]:
    """(drop of the cost, number of the candidate, text one layer below) of every candidate by which the cost drops enough."""
    now = cost(text)
    if now <= 0.6:
        return ()
    out = []
    for n, (read, meant) in enumerate(_CANDIDATES):
        fixed = _below(text, read, meant)
        if fixed is None or fixed == text:
            continue
        strict = meant == "utf-8"
        gain = now - cost(fixed) + 0.5 * strict  # valid UTF-8 is strong evidence by itself
        if gain >= (0.6 if strict else 1.4):
            out.append((round(gain, 6), n, fixed))
    return tuple(out)


def _one_layer(text: str) -> str:
    """The text with one layer undone in each segment where that lowers the cost. The largest drop of a segment wins; of equal
    drops that of the candidate which helps most in the whole text, then the first in the fixed order. So a text is restored
    alike whatever stands beside it."""
    segments = [(segment, _steps(segment) if segment and suspicious(segment) else ()) for segment in _SEGMENT.findall(text)]
    helped: dict[int, float] = {}
    for _, steps in segments:
        for gain, n, _ in steps:
            helped[n] = helped.get(n, 0.0) + gain
    return "".join(max(steps, key=lambda s: (s[0], helped[s[1]], -s[1]))[2] if steps else segment for segment, steps in segments)


def repair(text: str | None) -> tuple[str | None, bool, bool]:
    """(text with garbled parts restored, whether any part was garbled, whether everything could be restored).

    Works segment by segment (sentences, lines): ASCII is the same in all these encodings, so their bounds are never garbled.
    Lost characters (U+FFFD) are garbled and stay. Layers are undone as long as the cost drops; every step lowers it by a tenth
    at least, so this ends. Null stays null, empty stays empty; both are clean.
    """
    if not text or not suspicious(text):
        return text, False, True
    whole = _one_layer(text)
    changed = whole != text
    while changed and (below := _one_layer(whole)) != whole:
        whole = below
    lost = "\ufffd" in whole
    return whole, changed or lost, not lost


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: repair(t)[0] if t is not None else None).astype(object)


def with_restored(df: DataFrame, *columns: str) -> DataFrame:
    """df with garbled parts of the columns restored. Only texts beyond ASCII go through Python; nulls stay null."""
    for c in columns:
        fixed = _repaired(F.when(not_ascii(F.col(c)), F.col(c)))
        df = df.withColumn(c, F.coalesce(fixed, F.col(c)))
    return df


def garbled_fields(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field_name, restored, complete) of each text field with a garbled part.

    restored is the repaired text and complete whether no character was lost. Null and empty fields are clean; repeated rows
    stay repeated; other columns are not read.
    """
    long = df.select(F.col(key), F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("_text")) for f in fields])))
    long = long.filter(not_ascii(F.col("_text")))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, f, *repair(t)) for k, f, t in batch.itertuples(index=False)]
            yield pd.DataFrame([(k, f, s, ok) for k, f, s, bad, ok in out if bad], columns=[key, "field_name", "restored", "complete"])

    kind = df.schema[key].dataType.simpleString()
    return long.mapInPandas(find, f"{key} {kind}, field_name string, restored string, complete boolean")
