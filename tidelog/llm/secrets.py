"""Secret scans with built-in functions only.

Base kinds are found by their patterns. The method adds candidates by entropy: over each long string of token
characters a window slides, character counts of its class alphabet are updated by the one character that enters and the
one that leaves, and with them the sum of c * log2(c), from which the window's Shannon entropy follows. A candidate whose
highest window entropy reaches the threshold of its class is a span, unless the allow-list knows it (placeholders,
alphabets, runs of one character). Only the ``entropy`` kind is suppressed; base spans stay. Windows that lie in a run of
hexadecimal digits, of either case, have a class of their own. The values of ``name=value`` are candidates by themselves
as well, so that a name neither hides nor excuses its value; a value within a longer span is no further span.

Positions come from splitting a text at the matches: the lengths of the parts and of the matches alternate.

Results for special input: null and empty texts have no spans; ids, null or repeated, are passed through; an empty table
gives an empty result; other columns are ignored. Spans are ordered by start, then kind as listed; kinds may overlap.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, need

KINDS = ("assign", "access", "hex", "entropy")
BASE = KINDS[:3]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX_RUN = r"([0-9A-Fa-f]{20,})"
VALUE = r"[A-Za-z0-9+/_-]{20,}"

WINDOW = 20
#: Threshold in bits over WINDOW characters by class: runs of hexadecimal digits, and the characters of CANDIDATE.
CLASSES = {"hex": 3.0, "token": 3.75}
ALLOW = r"(?i)example|sample|placeholder|change_?me|your[_-]|0123456789|1234567890|abcdefghij|(.)\1{7}"

#: Elements that one fold appends to; texts and candidates are worked through in pieces of PIECE characters.
RUN, PIECE = 256, 512

SPAN = "struct<start:long,rank:int,end:long,kind:string>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often and wherever in lambdas it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs, op over zero and all elements before it; one entry more, for the end.

    Runs of RUN elements are folded apart, so the work is RUN / 2 a value, not the number of values.
    """
    zero = F.lit(0).cast("long")
    scan = lambda v, first: F.aggregate(v, F.array(first), lambda out, x: F.array_append(out, op(F.element_at(out, -1), x)))
    runs = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / RUN).cast("int")), lambda k: F.slice(v, k * RUN + 1, F.lit(RUN)))
    each = lambda r, top: F.flatten(F.transform(r, lambda run, k: F.slice(scan(run, F.get(top, k)), F.when(k == 0, 1).otherwise(2), F.lit(RUN + 1))))
    joined = lambda r: bound(scan(F.transform(r, lambda run: F.aggregate(run, zero, op)), zero), lambda top: each(r, top))
    return bound(bound(values, runs), joined)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of the matches of pattern, value being a group; linear in the text and the matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value") if group else None
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("part"), whole.alias("whole"), *([value] if group else []))
    size = lambda c: F.coalesce(F.char_length(c), F.lit(0)).cast("long")

    def placed(r: Column) -> Column:
        begins = before(F.transform(r, lambda x: size(x["part"]) + size(x["whole"])), lambda a, b: a + b)

        def spans_of(at: Column) -> Column:
            def one(x: Column, k: Column) -> Column:
                start = F.get(at, k) + size(x["part"])
                return F.struct(start.alias("start"), (start + size(x["whole"])).alias("end"), x["value" if group else "whole"].alias("value"))

            return F.slice(F.transform(r, one), F.lit(1), F.size(r) - 1)  # after the last part there is no match

        return bound(begins, spans_of)

    return bound(rows, placed)


def marked(found: Column, kind: str) -> Column:
    """Spans of (start, end) elements as SPAN."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).cast("int").alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def located(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """Spans of the matches of pattern whose group has at least so many characters."""
    return marked(F.filter(matches(text, pattern, group), lambda m: F.char_length(m["value"]) >= least), kind)


def pieces(text: Column, size: int = PIECE) -> Column:
    """The text in pieces of so many characters; an empty text has none."""
    return F.when(F.octet_length(text) <= size, F.filter(F.array(text), lambda p: p != "")).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def peak_entropy(value: Column) -> Column:
    """Highest Shannon entropy, in bits, of WINDOW neighbouring characters of value; zero if it is shorter.

    Every step changes two counts: that of the character that enters the window and that of the one that leaves. What they
    change in the sum of c * log2(c) is carried on from window to window, and the least sum is the highest entropy.
    """
    log = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1)]
    gain = lambda n: F.get(F.array(*(F.lit(b - a) for a, b in pairwise(log))), n)  # noqa: E731 - what one more than n adds; one literal

    def changes(chars: Column) -> Column:
        """By character: the change of the sum when it enters. It enters a window of the WINDOW characters before it, or of all there are."""

        def one(into: Column, i: Column) -> Column:
            held = F.least(i, F.lit(WINDOW))
            window = F.substr(value, i - held + 1, held)
            count = lambda c: held - F.octet_length(F.replace(window, c, F.lit("")))
            out = F.get(chars, i - WINDOW)
            return F.when(i < WINDOW, gain(count(into))).when(into == out, F.lit(0.0)).otherwise(gain(count(into)) - gain(count(out) - 1))

        return F.transform(chars, one)

    def least(d: Column) -> Column:
        start = F.aggregate(F.slice(d, 1, WINDOW), F.lit(0.0), lambda s, x: s + x)
        pair = lambda s, low: F.struct(s.alias("s"), F.least(low, s).alias("low"))
        return F.aggregate(F.slice(d, F.lit(WINDOW + 1), F.size(d)), bound(start, lambda s: pair(s, s)), lambda acc, x: pair(acc["s"] + x, acc["low"]), lambda acc: acc["low"])

    bits = F.lit(math.log2(WINDOW)) - bound(bound(F.split(value, ""), changes), least) / WINDOW
    return F.when(F.char_length(value) >= WINDOW, bits).otherwise(F.lit(0.0))


def reaches(value: Column, least: Column) -> Column:
    """Whether a window of value has so much entropy. Long values are worked through in pieces that share WINDOW - 1 characters, up to the first that has."""
    enough = lambda v: F.size(F.array_distinct(F.split(v, ""))) >= F.pow(F.lit(2.0), least)  # noqa: E731 - fewer characters have no such entropy
    tail = lambda p, k: F.when(k > 0, F.right(F.get(p, k - 1), F.lit(WINDOW - 1))).otherwise(F.lit(""))
    parts = lambda p: F.exists(F.transform(p, lambda x, k: F.concat(tail(p, k), x)), lambda v: enough(v) & (peak_entropy(v) >= least))
    return bound(pieces(value), parts)


def random_looking(value: Column) -> Column:
    """Whether a candidate string is not on the allow-list and it, or a run of hexadecimal digits in it, reaches its class's threshold."""
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    of = lambda v, name: F.struct(v.alias("v"), F.lit(CLASSES[name]).alias("least"))
    runs = F.transform(F.filter(F.regexp_extract_all(value, F.lit(HEX_RUN), F.lit(1)), mixed), lambda r: of(r, "hex"))
    return F.when(~mixed(value) | value.rlike(ALLOW), F.lit(False)).otherwise(F.exists(F.concat(runs, F.array(of(value, "token"))), lambda t: reaches(t["v"], t["least"])))


def entropy_spans(text: Column) -> Column:
    """Candidates that look random; of one that does not, its ``=``-parts that do. Candidates do not overlap, so no span lies in another."""
    inside = lambda c: F.transform(matches(c["value"], VALUE), lambda v: F.struct((c["start"] + v["start"]).alias("start"), (c["start"] + v["end"]).alias("end"), v["value"].alias("value")))
    family = lambda c: F.when(c["value"].contains("="), F.concat(F.array(c), inside(c))).otherwise(F.array(c))
    first = lambda good, c: F.when(F.get(good, F.lit(0))["end"] - F.get(good, F.lit(0))["start"] == c["end"] - c["start"], F.slice(good, F.lit(1), F.lit(1))).otherwise(good)
    one = lambda c: bound(F.filter(family(c), lambda v: random_looking(v["value"])), lambda good: first(good, c))
    return marked(F.flatten(F.transform(matches(text, CANDIDATE), one)), "entropy")


def spans(text: Column) -> Column:
    """Array of spans of a text column, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    low = F.lower(text)
    cue = F.lit(False)
    for word in ("passw", "secret", "token", "api"):
        cue = cue | low.contains(word)
    return F.array_sort(
        F.concat(
            F.when(cue, located(text, ASSIGN, "assign", 2, 8)).otherwise(none),
            F.when(text.contains("AKIA"), located(text, ACCESS, "access", 0, 16)).otherwise(none),
            F.when(text.rlike("[0-9a-f]{32}"), located(text, HEX, "hex", 0, 32)).otherwise(none),
            F.when(text.rlike(CANDIDATE) & text.rlike("[0-9]"), entropy_spans(text)).otherwise(none),
        )
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``spans`` of (start, rank, end, kind)."""
    source = need(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return source.select(id_col, spans(text).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans by one. Linear: what stays is cut from pieces of the text."""

    def between(p: Column, low: Column, high: Column) -> Column:
        """Characters [low, high) of the text whose pieces are p."""
        first, last = F.floor(low / PIECE).cast("int"), F.floor((high - 1) / PIECE).cast("int")
        cut = lambda k, a, b: F.substr(F.get(p, k), (a - k * PIECE + 1).cast("int"), (b - a).cast("int"))
        several = F.concat(cut(first, low, (first + 1) * PIECE), F.array_join(F.slice(p, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), cut(last, last * PIECE, high))
        return F.when(high <= low, F.lit("")).when(first == last, cut(first, low, high)).otherwise(several)

    def built(p: Column, ends: Column) -> Column:
        """ends: for each span, the largest end of those before it; at last that of all."""
        parts = F.transform(found, lambda s, i: F.when(s["start"] >= F.get(ends, i), F.concat(between(p, F.get(ends, i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), between(p, F.get(ends, F.size(found)), F.char_length(text).cast("long")))

    return bound(pieces(text), lambda p: bound(before(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda ends: built(p, ends)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with secrets replaced in the text; all other columns and the rows stay."""
    name = fresh(docs, "found")
    found = docs.withColumn(name, spans(F.coalesce(F.col(text_col), F.lit(""))))
    return found.withColumn(text_col, F.when(F.size(name) > 0, redacted(F.col(text_col), F.col(name))).otherwise(F.col(text_col))).drop(name)


def query(docs: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return find_secrets(docs).select(
        "doc_id", *(of(k) for k in BASE), F.sha2(text(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )
