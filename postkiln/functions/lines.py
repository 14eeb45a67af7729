"""Cleaning of mail bodies by lines: what each step removes is kept as spans, native throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First lines of signatures, notices and quotations, and automatic answers.
SIGNATURE = r"(?iu)^\s*--\s*$|best regards,?\s*$|с уважением,?\s*$|sent from my (?:iphone|android)|отправлено с (?:iphone|android)|get outlook for (?:ios|android)|microsoft outlook"
DISCLAIMER = r"(?iu)disclaimer|legal notice|confidentiality|конфиденциальность|this email originated from|this message is confidential|это письмо является конфиденциальным|this email and any attachments|the information contained in this|if you are not the intended recipient|если вы не являетесь адресатом|please consider the environment|пожалуйста, подумайте об экологии|click here to unsubscribe|нажмите здесь.*отписаться|unsubscribe|отписаться|privacy policy|политика конфиденциальности"
QUOTE_HEAD = r"(?iu)^\s*>|^-+\s*(?:original message|исходное сообщение)\s*-+|^on .+ wrote:|^.+ <.+@.+> wrote:|^(?:от|дата|from|date|sent|отправлено): .+"
AUTORESPONSE = r"(?iu)(?m)^out of office.*|^автоответ.*|^automatic reply.*|^автоматический ответ.*|i am currently out of office.*|я сейчас в отпуске.*|i will be unavailable.*|меня не будет.*|delivery status notification.*|уведомление о доставке.*|mail delivery system.*|this is an automatically generated.*|это автоматически сгенерированное.*"
#: Confidence of each kind of removed span, and the longest block that a guarded step removes.
CONFIDENCE = {"autoresponse": 0.95, "disclaimer": 0.9, "signature": 0.85, "quote": 0.88, "blacklist": 0.92}
LONGEST = 10_000


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _first(lines: Column, pattern: str) -> Column:
    """Place of the first line that matches, from 1; 0 where none does."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), F.lit(True)), F.lit(0)).cast("int")


def cut_from(c: Column, pattern: str, longest: int | None) -> tuple[Column, Column]:
    """(text before the first matching line, text from it on); nothing is cut where the rest is longer than ``longest``."""
    lines = _lines(c)
    at = _first(lines, pattern)
    head = F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0))), "\n")
    tail = F.array_join(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)), "\n")
    hit = at > 0
    if longest is not None:
        hit = hit & (F.char_length(tail) <= longest)
    return F.when(hit, head).otherwise(c), F.when(hit, tail)


def cut_signature(c: Column) -> tuple[Column, Column]:
    return cut_from(c, SIGNATURE, None)


def cut_disclaimer(c: Column) -> tuple[Column, Column]:
    return cut_from(c, DISCLAIMER, LONGEST)


def cut_quote(c: Column) -> tuple[Column, Column]:
    return cut_from(c, QUOTE_HEAD, LONGEST)


def drop_autoresponse(c: Column) -> Column:
    return F.regexp_replace(c, AUTORESPONSE, "")


def drop_lines(c: Column, pattern: str) -> Column:
    """The text without the lines that match."""
    return F.array_join(F.filter(_lines(c), lambda x: ~x.rlike(pattern)), "\n")


def structural_breaks(c: Column) -> Column:
    """Numbers, from 0, of lines that open a part: headings, capitals, numbered items, mail headers, rules."""
    pattern = r"(?U)^#{1,6}\s|^[\p{Lu}][\p{Lu}\s]{3,}:?\s*$|^\s*\d+[.)]\s|^(?:From|To|Subject|Date|От|Кому|Тема|Дата):|^\s*(?:-{3,}|={3,}|\*{3,})\s*$"
    lines = _lines(c)
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())
