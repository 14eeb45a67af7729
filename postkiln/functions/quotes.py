"""Removing quotations while keeping the head of the latest one, by a small machine over lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The note above a kept head; lines and paragraphs kept, words of a line that ends a deep quotation, lines looked
# ahead for prefixes.
HEAD_NOTE, HEAD_LINES, HEAD_PARAGRAPHS, LEAST_WORDS, AHEAD = "[Quoted head retained]", 10, 2, 10, 4
# Marks of forwarded mail, heads of quotations, mail header lines, words of closings, and all marks of the plain remover.
_MARK = re.compile(r"-----Original Message-----|----- Переадресованное сообщение -----", re.I)
_HEAD = re.compile(r"^On .+ wrote:|^On .+ at .+ wrote:|^.+ <.+@.+> wrote:|^От: .+|^Дата: .+|^From: .+|^Date: .+|^Sent: .+|^Отправлено: .+", re.I)
_FIELD = re.compile(r"^(?:From|To|Cc|Date|Sent|Received|Subject|От|Кому|Дата|Тема):", re.I)
_CLOSING = ("thanks", "regards", "best", "спасибо", "уважением")
_ANY_MARK = re.compile(r"-----Original Message-----|----- Переадресованное сообщение -----|From:|От:|Переадресовано:|Forwarded:|Re:|^>", re.I)


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip(">"))


class _Machine:
    """One pass over the lines of a body. Each state is a method that takes a line and says whether it has dealt with it; else the
    line goes to the state that the method has set."""

    def __init__(self, lines: list[str]) -> None:
        self.lines, self.kept, self.state = lines, [], self.outside
        self.head: list[str] = []
        self.paragraphs = self.blanks = 0

    def run(self) -> str:
        for self.at, line in enumerate(self.lines):
            while not self.state(line, _depth(line)):
                pass
        if self.state == self.inside_head:
            self.flush()
        return "\n".join(self.kept)

    def flush(self) -> None:
        if self.head:
            self.kept += [HEAD_NOTE, *("> " + h for h in self.head), ""]
        self.head = []

    def outside(self, line: str, depth: int) -> bool:
        if depth or _MARK.search(line):
            self.state = self.deep
        elif _HEAD.search(line):
            near = (x.strip() for x in self.lines[self.at + 1 : self.at + 1 + AHEAD])
            self.state = self.before_prefix if any(x.startswith(">") for x in near) else self.inside_head
            self.head, self.paragraphs, self.blanks = [], 0, 0
        else:
            self.kept.append(line)
        return True

    def before_prefix(self, line: str, depth: int) -> bool:
        """Between the head of a quotation and its first prefixed line."""
        if depth:
            self.state = self.inside_head
            return False
        if line.strip() and not _FIELD.match(line.strip()):
            self.state = self.outside
            self.kept.append(line)
        return True

    def inside_head(self, line: str, depth: int) -> bool:
        """In the first level of a quotation, whose beginning is kept."""
        if len(self.head) >= HEAD_LINES:
            self.flush()
            self.state = self.deep
            return False
        text = line.lstrip(">").strip()
        if not depth:
            self.flush()
            self.state = self.outside
            if text and not _MARK.search(line):
                self.kept.append(line)
        elif depth > 1 or text.startswith(">"):
            self.flush()
            self.state = self.deep
        elif text:
            self.head.append(text)
            self.blanks = 0
        else:
            self.paragraphs += bool(self.head) and not self.blanks
            self.blanks += 1
            if self.paragraphs >= HEAD_PARAGRAPHS or self.blanks >= 2:
                self.flush()
                self.state = self.deep
        return True

    def deep(self, line: str, depth: int) -> bool:
        """Where nothing is kept until a line that is long enough to be new."""
        text = line.strip()
        quoted = depth or _MARK.search(line) or not text or _FIELD.match(text) or any(w in line.lower() for w in _CLOSING)
        if not quoted and len(text.split()) >= LEAST_WORDS:
            self.state = self.outside
            self.kept.append(line)
        return True


def without_quotes(text: str, keep_head: bool = True, max_levels: int = 5) -> str:
    """The text without quotations; with keep_head the beginning of the first level of each stays behind a note."""
    lines = text.replace("\r\n", "\n").split("\n")
    if keep_head:
        return _Machine(lines).run().rstrip("\n")
    return without_any_quotes(lines, max_levels)


def without_any_quotes(lines: list[str], max_levels: int = 5) -> str:
    """The plain remover: lines with a mark go, prefixed lines behind one go while they are at most ``max_levels`` deep, and so does
    the first line that is not prefixed."""
    kept, inside = [], False
    for line in lines:
        if _depth(line) > max_levels and inside:
            inside = False
            kept.append(line)
        elif _ANY_MARK.search(line):
            inside = True
        elif inside:
            inside = _depth(line) > 0
        else:
            kept.append(line)
    return "\n".join(kept)


def main_content(text: str) -> str:
    """What is new in a body, without leading header lines and blank ends."""
    lines = without_quotes(text).split("\n")
    while lines and (not lines[0].strip() or _FIELD.match(lines[0].strip())):
        lines.pop(0)
    return "\n".join(lines).rstrip()


def _column(c: Column, f) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: f(t) if isinstance(t, str) else None)

    return run(c)


def quotes_removed(c: Column, keep_head: bool = True, max_levels: int = 5) -> Column:
    """``without_quotes`` of a column; null for null."""
    return _column(c, lambda t: without_quotes(t, keep_head, max_levels))


def main_contents(c: Column) -> Column:
    """``main_content`` of a column; null for null."""
    return _column(c, main_content)
