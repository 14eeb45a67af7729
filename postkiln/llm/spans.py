"""Long passages that stand verbatim in more than one text (problem 10).

Every passage of ``SPAN`` characters holds at least one *mark*: a short window whose hash is least among its neighbours, chosen
by content alone, so both copies of a passage choose the same one. The marks of each distinct text are written once. Partition
sketches (count-min rows of counters that stop at two, sized by the counted marks) are merged; they overestimate, so no repeated
mark is missed. What they let through is grouped exactly, and only truly repeated marks are expanded: the windows of SPAN
characters around a mark go in ``SEGMENTS`` runs, each sent as one row with a hash of what all its windows share (core) and of
what they cover together (reach). A run whose reach stands in another text is shared as a whole; only runs with a shared core but
another reach, the edges of passages, are compared window by window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postkiln.operators.skew import routed_join
from postkiln.session import written

#: Least length of a passage, and of the windows the marks are chosen from; any SPAN characters hold a mark.
SPAN, MARK = 320, 160
#: Runs of windows around a mark, and windows of a run: SEGMENTS * RUN = SPAN - MARK + 1.
SEGMENTS, RUN = 7, 23
#: Sketch rows; cells for each counted mark; least and most cells of a row as powers of two. Merged it is DEPTH * 2^MOST_CELLS
#: bits (32 MB) at most. Beyond that the sketch filters less; the exact grouping of marks (28 bytes each) then does the work.
DEPTH, CELLS_PER_MARK, LEAST_CELLS, MOST_CELLS = 2, 8, 17, 27
#: Bytes of one block of a sketch row, the unit of merging.
BLOCK = 16_384
#: Characters that are hashed at once; longer texts are read in pieces of this size that overlap by SPAN.
PIECE = 1 << 17

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_REACH = SPAN - MARK + 1


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, grown as pieces need."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, self.base, dtype=_U))])
                self.down = np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, self.inverse, dtype=_U))])
        return self.up[:n], self.down[:n]


_POWERS = tuple(_Powers(b) for b in _BASES)


def codes(text: str) -> np.ndarray:
    return _scramble(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U) + _U(0x632BE59BD9B4E019))


class _Hasher:
    """Hashes of any windows of a piece: rolling polynomials over prefix sums, shifted to the same place."""

    def __init__(self, code: np.ndarray, which: int = 0) -> None:
        up, self.down = _POWERS[which].upto(len(code) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(code * up[: len(code)], dtype=_U)])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _scramble((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _scramble((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each run of width values, in a logarithmic number of passes."""
    done, out = 1, values
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return best(out[:-rest], out[rest:]) if rest else out


def marks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place, hash) of the marks of texts of at least SPAN characters each, hashed many texts at a time.

    A mark is a window of MARK characters that is least in some run of _REACH neighbours it belongs to. Whether a place is a
    mark depends on SPAN characters to each side, so the pieces of a long text overlap by that and give the same marks.
    """
    # (text, first character, end, places kept: from, to)
    pieces: list[tuple[int, int, int, int, int]] = []
    for n, text in enumerate(texts):
        for first in range(0, max(1, len(text) - MARK + 1), PIECE):
            pieces.append((n, max(0, first - SPAN), min(len(text), first + PIECE + 2 * SPAN), first, first + PIECE))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    begin = 0
    while begin < len(pieces):
        stop, size = begin, 0
        while stop < len(pieces) and (stop == begin or size + pieces[stop][2] - pieces[stop][1] <= PIECE):
            size += pieces[stop][2] - pieces[stop][1]
            stop += 1
        out.append(_marks_of(texts, pieces[begin:stop]))
        begin = stop
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*out))


def _marks_of(texts: list[str], pieces: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner, first, end, low_kept, high_kept = (np.array(x, dtype=np.int64) for x in zip(*pieces))
    ends = np.cumsum(end - first)
    hashes = _Hasher(codes("".join(texts[n][a:b] for n, a, b, _, _ in pieces))).every(MARK)
    low = _sliding(hashes, _REACH, np.minimum)
    for e in ends[:-1]:  # runs that cross from one text into the next do not count
        low[max(0, e - SPAN + 1) : e] = 0
    pad = np.zeros(_REACH - 1, dtype=_U)
    at = np.flatnonzero(hashes == _sliding(np.concatenate([pad, low, pad]), _REACH, np.maximum))
    piece = np.searchsorted(ends, at, "right")
    place = at - (ends[piece] - (end - first)[piece]) + first[piece]
    inside = (at + MARK <= ends[piece]) & (place >= low_kept[piece]) & (place < high_kept[piece])
    return owner[piece][inside], place[inside], hashes[at[inside]]


def _cells(hashes: np.ndarray, row: int, power: int) -> np.ndarray:
    return ((hashes >> _U(32 * row)) & _U((1 << power) - 1)).astype(np.int64)


def _partition_sketch(batches: Iterator[pd.DataFrame], power: int) -> Iterator[pd.DataFrame]:
    once, twice = (np.zeros((DEPTH, 1 << (power - 3)), dtype=np.uint8) for _ in range(2))
    for batch in batches:
        held = [np.asarray(h, dtype=np.int64) for h in batch["h"] if len(h)]
        if not held:
            continue
        hashes = np.concatenate(held).view(_U)
        for row in range(DEPTH):
            cells, counts = np.unique(_cells(hashes, row, power), return_counts=True)
            byte, bit = cells >> 3, (1 << (cells & 7)).astype(np.uint8)
            many = ((once[row, byte] & bit) > 0) | (counts > 1)
            np.bitwise_or.at(twice[row], byte[many], bit[many])
            np.bitwise_or.at(once[row], byte, bit)
    out = []
    block = min(BLOCK, once.shape[1])
    for row in range(DEPTH):
        for n in range(once.shape[1] // block):
            part = slice(n * block, (n + 1) * block)
            if once[row, part].any():
                out.append((row, n, zlib.compress(once[row, part].tobytes(), 1), zlib.compress(twice[row, part].tobytes(), 1)))
    yield pd.DataFrame(out, columns=["row", "block", "once", "twice"])


def _merge_blocks(group: pd.DataFrame) -> pd.DataFrame:
    head = group.iloc[0]
    once, twice = (np.zeros(len(zlib.decompress(head["once"])), dtype=np.uint8) for _ in range(2))
    for one, two in zip(group["once"], group["twice"]):
        a, b = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (one, two))
        twice |= b | (once & a)
        once |= a
    return pd.DataFrame([(head["row"], head["block"], zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1))], columns=["row", "block", "once", "twice"])


def sketch_power(n_marks: int, most: int = MOST_CELLS) -> int:
    """Cells of a sketch row, as a power of two, for so many marks."""
    return min(most, max(LEAST_CELLS, (CELLS_PER_MARK * max(1, n_marks) - 1).bit_length()))


def repeated_cells(marked: DataFrame, power: int) -> np.ndarray:
    """The merged sketch of a table of marks: bits of the cells that hold at least two. Partitions merge in two steps, by blocks."""
    schema = "row int, block int, once binary, twice binary"
    parts = marked.select("h").mapInPandas(lambda batches: _partition_sketch(batches, power), schema).withColumn("few", F.pmod(F.xxhash64("once"), F.lit(32)).cast("int"))
    some = parts.groupBy("row", "block", "few").applyInPandas(lambda g: _merge_blocks(g[["row", "block", "once", "twice"]]), schema)
    merged = some.groupBy("row", "block").applyInPandas(_merge_blocks, schema).select("row", "block", "twice")
    bits = np.zeros((DEPTH, 1 << (power - 3)), dtype=np.uint8)
    for r in merged.collect():  # DEPTH * 2^power bits at most
        part = np.frombuffer(zlib.decompress(r["twice"]), dtype=np.uint8)
        bits[r["row"], r["block"] * len(part) : (r["block"] + 1) * len(part)] = part
    return bits


def _marked(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        owner, at, hashes = marks(list(batch["_text"]))
        cut = np.searchsorted(owner, np.arange(1, len(batch)))
        out = batch[[key, "a", "b", "n_chars"]].copy()
        out["at"], out["h"] = np.split(at.astype(np.int32), cut), np.split(hashes.view(np.int64), cut)
        yield out


def _runs(text: str, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(first start, core hashes, reach hashes, whether the reach lies in the text) of the runs of windows around marks."""
    for some in _near(at):
        base = max(0, int(some[0]) - SPAN)
        piece = codes(text[base : int(some[-1]) + 2 * SPAN])
        low = (some[:, None] - (SPAN - MARK) + RUN * np.arange(SEGMENTS)[None]).ravel()
        high = low + RUN - 1
        live = (high >= 0) & (low + SPAN <= len(text))  # at least one of the windows lies in the text
        low, high = low[live], high[live]
        whole = (low >= 0) & (high + SPAN <= len(text))
        start, end = np.where(whole, low, high), np.where(whole, high, low) + SPAN
        both = [_Hasher(piece, k) for k in (0, 1)]
        core = [h.at(high - base, low + SPAN - base).view(np.int64) for h in both]
        reach = [h.at(start - base, end - base).view(np.int64) for h in both]
        yield low, *core, *reach, whole


def _near(at: np.ndarray) -> list[np.ndarray]:
    """Sorted places in groups that one piece holds."""
    return [g for g in np.split(at, np.flatnonzero(np.diff(at // PIECE)) + 1) if len(g)]


def _expanded(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    names = ("low", "c1", "c2", "u1", "u2", "whole")
    for batch in batches:
        keys, parts = [], []
        for k, text, at in batch[[key, "_text", "at"]].itertuples(index=False, name=None):
            for run in _runs(text, np.asarray(at, dtype=np.int64)):
                keys += [k] * len(run[0])
                parts.append(run)
        if parts:
            yield pd.DataFrame({key: keys} | {name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(names)})


def _windows(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, parts = [], []
        for k, text, lows in batch[[key, "_text", "lows"]].itertuples(index=False, name=None):
            starts = np.unique((np.asarray(lows, dtype=np.int64)[:, None] + np.arange(RUN)[None]).ravel())
            starts = starts[(starts >= 0) & (starts + SPAN <= len(text))]
            for some in _near(starts):
                base = int(some[0])
                piece = codes(text[base : int(some[-1]) + SPAN])
                keys += [k] * len(some)
                parts.append((some, *(_Hasher(piece, w).at(some - base, some - base + SPAN).view(np.int64) for w in (0, 1))))
        if parts:
            yield pd.DataFrame({key: keys} | {name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(("start", "w1", "w2"))})


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", most_cells: int = MOST_CELLS) -> DataFrame:
    """(key, n_chars, shared_chars) of each row with a passage of at least SPAN characters that another row holds as well.

    shared_chars counts the characters inside such passages. Rows whose whole text is that of another row are shared as a whole;
    such copies are one text here and never paired. Null, empty and short texts have no such passage; rows without a key are not
    read. Rows with equal keys count as different rows only if their keys differ. Extra columns are not read.
    """
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.filter(F.col(key).isNotNull() & (F.char_length(text) >= SPAN)).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"), F.char_length(text).cast("bigint").alias("n_chars"))
    every = rows.mapInPandas(lambda batches: _marked(batches, "_key"), f"_key {kind}, a bigint, b bigint, n_chars bigint, at array<int>, h array<bigint>")
    # one row for each distinct text; copies are put together before the shuffle
    one = F.min(F.struct("_key", "at", "h"))
    texts = written(every.groupBy("a", "b").agg(one.alias("_one"), F.max("_key").alias("_last"), F.count(F.lit(1)).alias("_n")).select("a", "b", F.inline(F.array("_one")), "_last", "_n"), "span-marks")
    power = sketch_power(texts.agg(F.sum(F.size("h"))).first()[0] or 0, most_cells)
    sketch = rows.sparkSession.sparkContext.broadcast(repeated_cells(texts, power))

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sketch.value
        for batch in batches:
            sizes = [len(x) for x in batch["h"]]
            if not sum(sizes):
                continue
            hashes = np.concatenate(list(batch["h"])).astype(np.int64).view(_U)
            hit = np.ones(len(hashes), dtype=bool)
            for row in range(DEPTH):
                cells = _cells(hashes, row, power)
                hit &= (bits[row, cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0
            yield pd.DataFrame({"_key": np.repeat(batch["_key"].to_numpy(), sizes)[hit], "at": np.concatenate(list(batch["at"])).astype(np.int32)[hit], "h": hashes[hit].view(np.int64)})

    maybe = written(texts.select("_key", "at", "h").mapInPandas(likely, f"_key {kind}, at int, h bigint"), "span-likely")
    repeated = maybe.groupBy("h").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.count(F.lit(1)).alias("_n")).filter("_low != _high").select("h", "_n")
    seeds = routed_join(maybe, repeated, "h", "_n").groupBy("_key").agg(F.sort_array(F.collect_set("at")).alias("at"))
    seeds = seeds.join(texts.select("_key", "a", "b"), "_key")
    # the text of one row of each distinct text, and only of those with a repeated mark
    held = written(rows.select("_key", "_text", "a", "b").join(seeds, ["_key", "a", "b"]).select("_key", "_text", "at"), "span-texts")
    runs = held.mapInPandas(lambda batches: _expanded(batches, "_key"), f"_key {kind}, low int, c1 bigint, c2 bigint, u1 bigint, u2 bigint, whole boolean")
    runs = written(runs.select("_key", "low", F.struct("c1", "c2").alias("core"), F.when(F.col("whole"), F.struct("u1", "u2")).alias("reach")), "span-runs")
    # runs of one core and reach are a class; a run cut by an end of its text is compared window by window
    at, of_class = F.struct("_key", "low"), F.struct("core", "reach").alias("class")
    classes = runs.filter("reach IS NOT NULL").groupBy("core", "reach").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n"))
    classes = written(classes.withColumn("many", F.col("_first._key") != F.col("_last._key")), "span-classes")
    classed = runs.filter("reach IS NOT NULL").select("core", "_key", "low", of_class)
    again = routed_join(classed, classes.filter("NOT many AND _n > 1").select(of_class, "_n"), "class", "_n").select("core", "_key", "low")
    edges = runs.filter("reach IS NULL").select("core", "_key", "low").unionByName(classes.filter("NOT many AND _n = 1").select("core", F.inline(F.array("_first")))).unionByName(again)
    edges = written(edges, "span-edges")
    per_core = edges.groupBy("core").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b"), F.count(F.lit(1)).alias("_n"))
    of_many = classes.filter("many").groupBy("core").agg(F.count(F.lit(1)).alias("_m"))
    open_cores = per_core.join(of_many, "core", "left").filter("_a != _b OR _m IS NOT NULL").select("core", (F.col("_n") + 2 * F.coalesce("_m", F.lit(0))).alias("_n"))
    # two runs, of the least and the greatest key, stand for each class of many texts
    sides = edges.unionByName(classes.filter("many").select("core", F.inline(F.array("_first", "_last"))))
    lows = routed_join(sides, open_cores, "core", "_n").groupBy("_key").agg(F.collect_set("low").alias("lows"))
    windows = held.select("_key", "_text").join(lows, "_key").mapInPandas(lambda batches: _windows(batches, "_key"), f"_key {kind}, start int, w1 bigint, w2 bigint")
    windows = written(windows.select("_key", "start", F.struct("w1", "w2").alias("w")), "span-windows")
    same = windows.groupBy("w").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.count(F.lit(1)).alias("_n")).filter("_low != _high").select("w", "_n")
    by_window = routed_join(windows, same, "w", "_n").select("_key", F.col("start").alias("_from"), (F.col("start") + SPAN).alias("_to"))
    by_run = routed_join(classed, classes.filter("many").select(of_class, "_n"), "class", "_n").select("_key", F.col("low").alias("_from"), (F.col("low") + SPAN + RUN - 1).alias("_to"))
    covered = by_window.unionByName(by_run)
    upto = F.coalesce(F.max("_to").over(Window.partitionBy("_key").orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = covered.withColumn("_new", F.greatest(F.lit(0), F.col("_to") - F.greatest(F.col("_from"), upto))).groupBy("_key").agg(F.sum("_new").alias("_shared"))
    facts = texts.select("a", "b", "_key", "_n", (F.col("_key") != F.col("_last")).alias("_copied")).join(lengths, "_key", "left").filter("_copied OR _shared IS NOT NULL")
    facts = facts.select(F.struct("a", "b").alias("ab"), "_n", "_copied", "_shared")
    joined = routed_join(rows.select("_key", F.struct("a", "b").alias("ab"), "n_chars"), facts, "ab", "_n")
    return joined.select(F.col("_key").alias(key), "n_chars", F.when(F.col("_copied"), F.col("n_chars")).otherwise(F.col("_shared")).alias("shared_chars")).distinct()
