"""Cutting oversized items at natural boundaries, with overlap (problem 6).

An item is parsed into a tree: headings own what follows up to the next heading of their rank or a higher one, marks of quoted
mail and rules open sections, paragraphs, blocks of markup, list items by their indentation, lines, and below them sentences,
words and characters. Subtrees of siblings are merged bottom-up while they stay under the limit; only oversized nodes are
descended into.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ranks of nodes: 1 to 6 headings (rules and marks of quoted mail as 1), then blocks of markup, paragraphs, list items, lines.
_BLOCK, _PARAGRAPH, _ITEM, _LINE = 7, 8, 9, 16
#: A piece under the limit by this factor is merged across the bounds of its subtree.
SMALL = 8
_HEADING = re.compile(r"(#{1,6})[ \t]")
_RULE = re.compile(r"-{3,}[^\n-]|\*{3} |_{8,}|-- ?\r?$|={3,}")
_TAG = re.compile(r"[ \t]*<(?:h([1-6])|(section|article|div|table|ul|ol|p|pre|blockquote)|(li|tr|dt|dd))\b", re.I)
_LIST = re.compile(r"([ \t]*)(?:[-*+•‣–]|\d{1,3}[.)]|[a-zа-я][.)])[ \t]+\S")
_BLANK = re.compile(r"[ \t>|]*\r?$")
#: Where sentences and words begin.
_FINER = (re.compile(r"(?<=[.!?…;])(?= )|(?<=[。！？])"), re.compile(r"(?<=\S)(?=\s)"))
_JOINED = re.compile("[̀-ͯ‍︀-️\U0001f3fb-\U0001f3ff]")


def structure(text: str) -> tuple[list[int], list[int]]:
    """(places, ranks) of the nodes of a text: the beginnings of its lines and what each of them opens."""
    places, ranks = [], []
    at, after_blank = 0, False
    for line in text.split("\n"):
        if at:
            places.append(at)
            ranks.append(_rank(line, after_blank))
        after_blank = bool(_BLANK.match(line))
        at += len(line) + 1
    return places, ranks


def _rank(line: str, after_blank: bool) -> int:
    if m := _HEADING.match(line):
        return len(m[1])
    if _RULE.match(line):
        return 1
    if m := _TAG.match(line):
        return int(m[1]) if m[1] else _BLOCK if m[2] else _ITEM
    if m := _LIST.match(line):
        # an item under another belongs to it, whatever blank lines stand between
        return _ITEM + min(len(m[1].expandtabs(4)) // 2, _LINE - _ITEM - 1)
    if after_blank and not _BLANK.match(line):
        return _PARAGRAPH if line[:1] not in (" ", "\t") else _LINE
    return _LINE


def cuts(text: str, limit: int) -> list[int]:
    """Ends of consecutive pieces of at most ``limit`` characters."""
    places, ranks = structure(text)

    def children(start: int, end: int, finer: int) -> tuple[list[int], int]:
        """(ends of the children of a node, how far below lines they are)."""
        a, b = bisect_right(places, start), bisect_left(places, end)
        if a < b:
            top = min(ranks[a:b])
            return [*(places[i] for i in range(a, b) if ranks[i] == top), end], 0
        for k in range(finer, len(_FINER)):
            found = [m.start() for m in _FINER[k].finditer(text, start, end) if start < m.start() < end]
            if found:
                return [*found, end], k + 1
        ends, at = [], start
        while end - at > limit:
            cut = at + limit
            # not inside a character made of several code points, nor inside a line end
            while cut > at + max(1, limit // 2) and (_JOINED.match(text, cut) or text[cut - 1] == "‍" or text[cut - 1 : cut + 1] == "\r\n"):
                cut -= 1
            ends.append(cut)
            at = cut
        return [*ends, end], len(_FINER)

    def pack(start: int, end: int, finer: int, opened: int | None = None) -> list[int]:
        """Ends of the pieces of a node; with ``opened``, the start of a small open piece before it, which the first may carry on."""
        if end - start <= limit:
            return [end]
        ends: list[int] = [] if opened is None else [start]
        begun = at = start  # begun: start of the piece that is still open
        if opened is not None:
            begun = opened
        inside, finer = children(start, end, finer)
        whole = True  # whether the open piece holds whole siblings only
        for child in inside:
            fits = child - at <= limit
            if not fits and ends and at - begun <= limit // SMALL:
                # a heading or a short opening goes on into the node below it
                parts = pack(at, child, finer, begun)
                begun = parts[-2] if len(parts) > 1 else begun
                ends[-1:] = parts
                whole, at = False, child
                continue
            for piece_end in [child] if fits else pack(at, child, finer):
                # whole siblings are merged; a rest that is hardly a piece also with a part of a larger one
                if ends and piece_end - begun <= limit and ((fits and whole) or piece_end - ends[-1] <= limit // SMALL):
                    ends[-1] = piece_end
                else:
                    begun = ends[-1] if ends else start
                    ends.append(piece_end)
                whole = fits
            at = child
        return ends

    return pack(0, len(text), 0)


def pieces(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, str]]:
    """(start, piece) of consecutive pieces: each next one begins with the last overlap_chars characters of the one before (with
    all of it where it is shorter, which only the first piece can be).

    No piece is longer than max_chars; the pieces without their overlaps are the text. A text within the limit is one piece. An
    overlap that leaves no room for anything new (max_chars or more) cannot be had: then there are no pieces.
    """
    if len(text) <= max_chars:
        return [(0, text)]
    overlap = max(0, overlap_chars)
    if overlap >= max_chars:
        return []
    out, at = [], 0
    for end in cuts(text, max_chars - overlap):
        start = max(0, at - min(overlap, len(out[-1][1]))) if out else 0
        out.append((start, text[start:end]))
        at = end
    return out


def oversized_pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, item_key, piece_no, n_pieces, start_at, content) for items (item_kind, item_key, content) above their limit.

    ``limits`` has one row per item_kind (item_kind, max_chars, overlap_chars). Items of an unknown kind, null or short items give
    no rows: they need no cutting. Where the limits of a kind cannot be kept (an overlap as long as a piece), its oversized items
    come out uncut as one row each with piece_no and n_pieces 0 and null content. Lengths are code points. Only oversized items leave the scan; there is no shuffle unless
    the limits are too many to broadcast.
    """
    rows = items.join(limits.select("item_kind", "max_chars", "overlap_chars"), "item_kind").filter((F.char_length("content") > F.col("max_chars")) & (F.col("max_chars") >= 1))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, key, content, most, overlap in batch.itertuples(index=False):
                parts = pieces(content, int(most), int(overlap) if overlap == overlap and overlap is not None else 0)
                out += [(kind, key, n, len(parts), start, piece) for n, (start, piece) in enumerate(parts, 1)] or [(kind, key, 0, 0, 0, None)]
            yield pd.DataFrame(out, columns=["item_kind", "item_key", "piece_no", "n_pieces", "start_at", "content"])

    return rows.select("item_kind", "item_key", "content", "max_chars", "overlap_chars").mapInPandas(cut, "item_kind string, item_key bigint, piece_no int, n_pieces int, start_at int, content string")
