"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, URL schemes and
identifier cues. From each anchor a local parser expands to the boundaries of the value and validates it, so the
cost is linear in the text; no pattern is searched for from every position.

Results for special input: a null or empty text has no spans; a null id is passed through; repeated rows each get
their own result row; an empty table gives an empty result; columns other than the two named ones are ignored.
Of two values of one kind that overlap, the leftmost wins; values of different kinds may overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, slices

#: Base kinds in their contract order, then the kinds this method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "address", "login")

ACCOUNT_CUES = ("account number", "account no", "acct no", "acct", "iban", "ssn", "social security", "passport", "routing number", "customer id")
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "drive")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[ ]{0,2}[#:=]?[ ]{0,2}([0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])")
_LEAD = re.compile(r"[ ]{0,2}[:=]?[ ]{0,2}")
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]++(?::[^\s@/]++)?@[A-Za-z0-9.-]+")
#: A street address has one to so many capitalised words between its number, of up to so many digits, and its cue.
STREET_WORDS, HOUSE_DIGITS = 3, 5


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c if c in "@+" else "0", 1))
    for cues, tag in ((ACCOUNT_CUES, "A"), (STREET_CUES, "S"), (SCHEMES, "U")):
        for cue in cues:
            for form in {cue, cue.title(), cue.upper(), cue.capitalize()}:
                a.add_word(form, (tag, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i & 1:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def iban(value: str) -> bool:
    s = value.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def house(text: str, end: int) -> int:
    """Where a house number begins that capitalised words, each with a space before and after, lead from to end; -1 if there is none."""
    if text[end - 1 : end] != " ":
        return -1
    end -= 1
    for _ in range(STREET_WORDS):
        at = end
        while at and "a" <= text[at - 1] <= "z":
            at -= 1
        if at in (0, end) or not "A" <= text[at - 1] <= "Z" or text[at - 2 : at - 1] != " ":
            return -1
        end = at = at - 2
        while at and "0" <= text[at - 1] <= "9":
            at -= 1
        if at < end:
            before = text[at - 1 : at] if at else ""
            return at if end - at <= HOUSE_DIGITS and not (before.isascii() and before.isalnum()) else -1
    return -1


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) sorted by kind, then start; code points, end exclusive."""
    found: list[tuple[int, int, int]] = []
    free = [0] * len(KINDS)  # by kind: where the next value may begin

    def put(kind: int, start: int, end: int) -> None:
        found.append((kind, start, end))
        free[kind] = end

    for last, (tag, length) in anchors.iter(text):
        if tag == "0":
            if last >= free[2]:
                m = _CHAIN.match(text, last)
                free[2] = m.end() if m else last + 1
                if m:
                    digits = re.sub("[ -]", "", m[0])
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found.append((2, last, m.end()))
            if last >= free[1]:
                m = _QUAD.match(text, last)
                if m:
                    free[1] = m.end()
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                        found.append((1, last, m.end()))
                else:
                    free[1] = _DIGITS.match(text, last).end()
        elif tag == "@":
            start, low = last, free[0]
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                put(0, start, m.end())
        elif tag == "+":
            if last >= free[3] and (m := _PHONE.match(text, last)):
                free[3] = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((3, last, m.end()))
        elif tag == "A":
            at = last + 1
            m = _LEAD.match(text, at)
            if (n := _IBAN.match(text, m.end())) and n.start() >= free[4] and iban(n[0]):
                put(4, *n.span())
            elif (n := _ACCOUNT.match(text, at)) and n.start(1) >= free[5]:
                put(5, *n.span(1))
        elif tag == "S":
            at = last + 1 - length
            if not text[last + 1 : last + 2].isalnum() and (start := house(text, at)) >= free[6]:
                put(6, start, last + 1)
        elif (m := _LOGIN.match(text, last + 1)) and ":" in m[0] and last + 1 - length >= free[7]:
            put(7, last + 1 - length, m.end())
    found.sort()
    return found


SPANS = "array<struct<kind:string,start:long,end:long,value:string>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``spans`` of (kind, start, end, value), sorted by kind as listed in KINDS, then start."""
    source = need(docs, id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        typed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                out.append([{"kind": KINDS[k], "start": s, "end": e, "value": text[s:e]} for k, s, e in spans(text, anchors)] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, typed)], [id_col, "spans"])

    return source.mapInArrow(scan, f"`{id_col}` {kind}, spans {SPANS}")


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest of find_pii."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return find_pii(docs).select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in BASE),
        F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
