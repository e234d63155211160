"""Quality rules: a learned decision list over text statistics, as ordered Spark conditional expressions.

Statistics of whole texts are built-in expressions. A bounded sample of labelled rows (``rows``, a parameter; picked by a
hash of the id) is collected with its statistics, and sequential covering learns rules from it: a rule grows by the
threshold condition with the best information gain, is pruned against rows kept aside, and is accepted if it is precise
there; the rows it covers leave, and the next rule is learned. The list becomes one CASE expression, first rule first.

Results for special input: null text counts as empty (no words, so it fails the base rules); null labels are not learned
from; ids, null or repeated, are passed through; with no labelled rows the list is empty and the base rules alone decide;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, need

FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio")
SPAN = 5  # words in a repeated window

Rule = list[tuple[str, str, float]]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, the counts n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, and the FEATURES."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    spaced = t
    for ws in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(ws), F.lit(" "))

    def bytes_of(chars: str) -> Column:
        return sum((F.octet_length("t") - F.octet_length(F.replace("t", F.lit(c), F.lit(""))) for c in chars[1:]), F.octet_length("t") - F.octet_length(F.replace("t", F.lit(chars[0]), F.lit(""))))

    d = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), t.alias("t"), spaced.alias("spaced"))
    d = d.select(
        "id",
        F.array_remove(F.split("spaced", " "), "").alias("words"),
        (F.char_length("spaced") - (F.octet_length("spaced") - F.octet_length(F.replace("spaced", F.lit(" "), F.lit(""))))).cast("long").alias("word_chars"),
        bytes_of("#*$%&|<>").cast("long").alias("n_symbols"),
        bytes_of("!").cast("long").alias("n_bangs"),
        (F.octet_length("t") - F.octet_length(F.regexp_replace("t", "[A-Z]+", ""))).cast("long").alias("n_upper"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(f"[^{WORD_SPACE}]")).alias("lines"),
    )
    window = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(SPAN)))
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "h", F.when(F.col("n_words") >= SPAN, F.transform(F.sequence(F.lit(0), F.size("words") - SPAN), window)).otherwise(F.array().cast("array<bigint>"))
    )
    pairs = F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("z", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("words", "h")
    twin = lambda e, j: (F.get("z", j - 1)["h"] == e["h"]) | (F.get("z", j + 1)["h"] == e["h"])
    d = d.withColumn("at", F.array_sort(F.transform(F.filter("z", lambda e, j: F.coalesce(twin(e, j), F.get("z", j + 1)["h"] == e["h"], F.get("z", j - 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"]))).drop("z")
    covered = F.aggregate(F.transform("at", lambda i, k: F.least(F.lit(SPAN), F.coalesce(F.get("at", k + 1) - i, F.lit(SPAN)))), F.lit(0), lambda a, x: a + x)
    d = d.select(
        "id", "n_words", "word_chars", "n_symbols", "n_bangs", "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    per = lambda c, of: (F.col(c) / F.greatest(F.col(of), F.lit(1))).cast("double")
    return d.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        per("word_chars", "n_words").alias("mean_word"), per("n_symbols", "n_words").alias("symbol_ratio"), per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"), per("n_upper", "word_chars").alias("upper_ratio"), per("n_bangs", "n_words").alias("bang_ratio"),
    )


def conditions(rows: list[tuple], most: int = 48) -> list[tuple[tuple[str, str, float], int]]:
    """Threshold conditions with the rows each covers, as bits of an integer; thresholds lie between neighbouring quantiles."""
    out = []
    for f, name in enumerate(FEATURES):
        values = sorted({float(r[f]) for r in rows})
        step = max(1, len(values) // most)
        for a, b in zip(values[::step], values[step::step], strict=False):
            cut = round((a + b) / 2, 6)
            low = int("".join("1" if r[f] <= cut else "0" for r in reversed(rows)), 2)
            out += [((name, "<=", cut), low), ((name, ">", cut), ((1 << len(rows)) - 1) & ~low)]
    return out


def learn_list(rows: list[tuple], labels: list[int], most_rules: int = 12, precision: float = 0.9, most_conditions: int = 4) -> list[Rule]:
    """Sequential covering: ordered rules for label 0 (poor text)."""
    if not rows:
        return []
    n = len(rows)
    every = (1 << n) - 1
    bad = sum(1 << i for i, y in enumerate(labels) if y == 0)
    aside = sum(1 << i for i in range(n) if i % 3 == 2)  # for pruning
    tests, left, rules = conditions(rows), every, []
    count = int.bit_count
    while len(rules) < most_rules and left & bad:
        grow, held = left & ~aside, left & aside
        rule, covered = [], grow
        while len(rule) < most_conditions and covered & ~bad:
            p0, n0 = count(covered & bad), count(covered & ~bad)
            if not p0:
                break
            best = None
            for test, bits in tests:
                p = count(covered & bits & bad)
                if not p:
                    continue
                q = count(covered & bits & ~bad)
                gain = p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + n0)))
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, test, bits)
            if best is None:
                break
            rule.append((best[1], best[2]))
            covered &= best[2]
        worth, kept, bits = -2.0, 0, every
        for k in range(1, len(rule) + 1):  # prune: the prefix that does best on the rows kept aside
            bits &= rule[k - 1][1]
            p, q = count(held & bits & bad), count(held & bits & ~bad)
            v = (p - q) / (p + q) if p + q else -1.0
            if v > worth:
                worth, kept = v, k
        bits = every
        for _, b in rule[:kept]:
            bits &= b
        p, q = count(left & bits & bad), count(left & bits & ~bad)
        hp, hq = count(held & bits & bad), count(held & bits & ~bad)
        if not kept or p < 3 or p < precision * (p + q) or hp < precision * (hp + hq):
            break
        rules.append([test for test, _ in rule[:kept]])
        left &= ~bits
    return rules


def verdict(rules: list[Rule]) -> Column:
    """False where a rule of the list holds, true elsewhere: conditions in order."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for name, op, cut in rule:
            holds = holds & (F.col(name) <= cut if op == "<=" else F.col(name) > cut)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> list[Rule]:
    """A decision list from at most so many labelled documents. The sample of labels is bounded, so it is broadcast."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    found = need(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    got = statistics(found).select("doc_id", *FEATURES).join(F.broadcast(chosen), "doc_id").select("quality", *FEATURES, "doc_id").collect()
    got = sorted((tuple(r) for r in got), key=lambda r: (r[-1], r))
    return learn_list([r[1:-1] for r in got], [r[0] for r in got])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def apply_list(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """statistics with base_failed and kept."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply_list(docs, learn(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
