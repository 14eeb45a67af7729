"""The composed cleaner of mail bodies: six steps, each with the spans that it removes, native throughout.

Lines end in \\n here; other line ends become that first. Offsets are code points from 0 and refer to the text that the step reads.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postkiln.functions import lines as L
from postkiln.functions.text import tidy_lines

SPAN = "struct<type:string,start:int,end:int,content:string,confidence:double>"
#: Characters of a removed part that its span keeps.
KEPT = 200


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _span(kind: str, start: Column, content: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), start.cast("int").alias("start"), (start + F.char_length(content)).cast("int").alias("end"), F.substring(content, 1, KEPT).alias("content"), F.lit(L.CONFIDENCE[kind]).alias("confidence"))


def _result(clean: Column, spans: Column) -> Column:
    return F.struct(clean.alias("clean"), spans.alias("spans"))


def without_autoresponses(text: Column, longest: int = L.LONGEST) -> Column:
    """struct<clean, spans>: phrases of automatic answers to the end of their line removed; longer ones than ``longest`` stay."""
    pieces = F.regexp_extract_all(text, F.lit("(?iumd)(" + L.AUTORESPONSE.removeprefix("(?iu)(?m)") + ")"), F.lit(1))
    # where each of them stands: found from the end of the one before
    start = F.struct(F.lit(1).alias("at"), no_spans().alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        at = F.locate(piece, text, state["at"]) if isinstance(piece, str) else F.call_function("locate", piece, text, state["at"])
        span = F.when(F.char_length(piece) <= longest, F.array(_span("autoresponse", at - 1, piece))).otherwise(no_spans())
        return F.struct((at + F.greatest(F.char_length(piece), F.lit(1))).cast("int").alias("at"), F.concat(state["spans"], span).alias("spans"))

    spans = F.aggregate(F.filter(pieces, lambda p: p != ""), start, step)["spans"]
    # each phrase runs to the end of its line; what would be longer than the limit does not match at all
    phrases = [p.removesuffix(".*") for p in L.AUTORESPONSE.removeprefix("(?iu)(?m)").split("|")]
    guarded = "|".join(p + r".{0," + str(max(0, longest - len(p.removeprefix("^")))) + "}+(?!.)" for p in phrases)
    return _result(F.regexp_replace(text, "(?iumd)" + guarded, ""), spans)


def _cut(text: Column, kind: str, at: Column) -> Column:
    """struct<clean, spans> with everything from line ``at`` (from 1; 0 for none) removed."""
    lines = F.split(text, "\n")
    head = F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0))), "\n")
    tail = F.array_join(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)), "\n")
    start = F.when(at > 1, F.char_length(head) + 1).otherwise(0)
    return F.when(at > 0, _result(F.regexp_replace(head, r"\s+$", ""), F.array(_span(kind, start, tail)))).otherwise(_result(text, no_spans()))


def disclaimer_line(text: Column, longest: int = L.LONGEST) -> Column:
    """The first line that opens a notice, or the rule above it; where the rest is longer than ``longest``, the next such line is
    tried. 0 where there is none."""
    lines = F.split(text, "\n")
    total = F.char_length(text)
    # (line, line before it, characters from it to the end) of every line that opens a notice
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("above"), F.array().cast("array<struct<i:int,above:string,left:int>>").alias("hits"))

    def step(s: Column, e: Column) -> Column:
        hit = F.array(F.struct(e["i"].cast("int").alias("i"), s["above"].alias("above"), (total - s["at"]).cast("int").alias("left")))
        return F.struct((s["at"] + F.char_length(e["x"]) + 1).alias("at"), e["x"].alias("above"), F.when(F.trim(e["x"]).rlike(L.DISCLAIMER), F.concat(s["hits"], hit)).otherwise(s["hits"]).alias("hits"))

    hits = F.aggregate(F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), empty, step)["hits"]
    ruled = lambda h: (h["i"] > 1) & F.trim(h["above"]).isin("---", "--")
    places = F.transform(hits, lambda h: F.struct(F.when(ruled(h), h["i"] - 1).otherwise(h["i"]).alias("i"), F.when(ruled(h), h["left"] + F.char_length(h["above"]) + 1).otherwise(h["left"]).alias("left")))
    return F.coalesce(F.get(F.filter(places, lambda h: h["left"] <= longest), F.lit(0))["i"], F.lit(0)).cast("int")


def signature_line(text: Column) -> Column:
    return F.coalesce(F.array_position(F.transform(F.split(text, "\n"), lambda x: F.trim(x).rlike(L.SIGNATURE)), F.lit(True)), F.lit(0)).cast("int")


def quote_line(text: Column, longest: int = L.LONGEST) -> Column:
    """The first line that opens a quotation; 0 where there is none or the rest is longer than ``longest``."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.ltrim(x).rlike(L.QUOTE_HEAD)), F.lit(True))
    # a fold of one step, so that the place is found once
    fits = lambda a: F.char_length(F.array_join(F.slice(lines, F.greatest(a, F.lit(1)).cast("int"), F.size(lines)), "\n")) <= longest
    return F.coalesce(F.get(F.filter(F.array(at), lambda a: (a > 0) & fits(a)), F.lit(0)), F.lit(0)).cast("int")


def without_disclaimer(text: Column, longest: int = L.LONGEST) -> Column:
    """struct<clean, spans>: from the first line that opens a notice, and the rule above it, to the end."""
    return _cut(text, "disclaimer", disclaimer_line(text, longest))


def without_signature(text: Column) -> Column:
    """From the first line that opens a signature to the end, whatever its length."""
    return _cut(text, "signature", signature_line(text))


def without_quote(text: Column, longest: int = L.LONGEST) -> Column:
    """From the first line that opens a quotation to the end, unless that is longer than ``longest``."""
    return _cut(text, "quote", quote_line(text, longest))


def without_blacklisted(text: Column, patterns: list[str]) -> Column:
    """Lines that match any of the patterns removed, each with its span."""
    if not patterns:
        return _result(text, no_spans())
    bad = "(?iu)" + "|".join(f"(?:{p})" for p in patterns)
    lines = F.split(text, "\n")
    spans = F.aggregate(
        lines, F.struct(F.lit(0).alias("at"), no_spans().alias("spans")),
        lambda s, x: F.struct((s["at"] + F.char_length(x) + 1).alias("at"), F.when(x.rlike(bad), F.concat(s["spans"], F.array(_span("blacklist", s["at"], x)))).otherwise(s["spans"]).alias("spans")),
    )["spans"]
    kept = F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~x.rlike(bad)), "\n"), r"\s+$", "")
    return F.when(F.size(spans) > 0, _result(kept, spans)).otherwise(_result(text, no_spans()))


def with_clean_body(df, text: str, name: str = "clean", spans: str = "removed_spans", blacklist: list[str] | None = None, longest: int = L.LONGEST):
    """df with the cleaned text and the spans that each step removed: automatic answers, notices, signatures, quotations,
    blacklisted lines, then white space. Null texts stay null without spans; empty ones stay empty."""
    out = df.withColumn("_c0", F.struct(F.regexp_replace(F.col(text), r"\r\n?", "\n").alias("clean"), no_spans().alias("spans")))
    places = {"disclaimer": lambda c: disclaimer_line(c, longest), "signature": signature_line, "quote": lambda c: quote_line(c, longest)}
    out = out.withColumn("_c1", without_autoresponses(F.col("_c0.clean"), longest))
    for n, (kind, place) in enumerate(places.items(), 2):  # projections of their own, so that no step is written out in the next
        out = out.withColumn("_at", place(F.col(f"_c{n - 1}.clean"))).withColumn(f"_c{n}", _cut(F.col(f"_c{n - 1}.clean"), kind, F.col("_at")))
    out = out.withColumn("_c5", without_blacklisted(F.col("_c4.clean"), blacklist or []))
    removed = F.concat(*[F.coalesce(F.col(f"_c{n}.spans"), no_spans()) for n in range(1, 6)])
    return out.withColumns({name: tidy_lines(F.col("_c5.clean")), spans: removed}).drop("_at", *[f"_c{n}" for n in range(6)])


def without_marks(text: Column) -> Column:
    """The plain cleaner without spans: notices and signature lines removed where they stand, then quotations (a machine over
    lines, ``quotes.quotes_removed``), then white space."""
    from postkiln.functions.quotes import quotes_removed

    notices = F.regexp_replace(text, "(?iu)(?m)" + "|".join(f"(?:{p}).*" for p in L.DISCLAIMER.removeprefix("(?iu)").split("|")), "")
    signs = F.regexp_replace(notices, "(?iu)(?m)" + "|".join(p for p in L.SIGNATURE.removeprefix("(?iu)").split("|") if not p.startswith(r"^\s*--")), "")
    return tidy_lines(quotes_removed(signs))
