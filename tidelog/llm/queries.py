"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language, minhash, mixing, packing, pii, quality, secrets, substrings, tokens, vectors
from .common import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.query(table(spark, sf_dir, "embeddings"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.query(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.query(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_vector_dedup, op3_minhash_dedup, op4_token_counts, op5_language_id, op6_packing, op7_quality_rules, op8_substring_dedup, op9_secret_scan, op10_mixing)
}

# SQL building blocks
WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: From nodes(id) and links(a, b): comp(id, component).
REACH = """sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT id, id AS root FROM nodes UNION SELECT sym.b, reach.root FROM reach JOIN sym ON reach.id = sym.a),
comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""

OP2 = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM nodes WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id < y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95), {REACH}
SELECT nodes.id AS vec_id, (SELECT count(*) FROM sym WHERE sym.a = nodes.id) AS n_links, component AS component_id, component = nodes.id AS kept FROM nodes JOIN comp ON comp.id = nodes.id"""

OP3 = f"""WITH RECURSIVE nodes AS (SELECT doc_id AS id, {WORDS.format(text=LOWER)} AS w FROM documents),
shingles AS (SELECT DISTINCT id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM nodes WHERE len(w) > 0)),
sets AS (SELECT id, count(*) AS n FROM shingles GROUP BY id), shared AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM shared JOIN sets p ON p.id = a JOIN sets q ON q.id = b WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)), {REACH}
SELECT nodes.id AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, component = nodes.id AS kept FROM nodes JOIN comp ON comp.id = nodes.id LEFT JOIN sets ON sets.id = nodes.id"""

OP8 = f"""WITH d AS (SELECT doc_id, {WORDS.format(text="text")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(20)) AS j FROM later)), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _found(kind: str, pattern: str, text: str = "t") -> str:
    """A list of structs (s, e, v, kind): the matches of pattern, from the parts between them."""
    quoted = pattern.replace("'", "''")
    starts = "list_sum(list_transform(p[1:k], lambda x: length(x)))"
    before = "coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)"
    one = f"{{'s': CAST({starts} + {before} AS BIGINT), 'e': CAST({starts} + {before} + length(m[k]) AS BIGINT), 'v': m[k], 'rank': {secrets.KINDS.index(kind)}, 'kind': '{kind}'}}"
    return f"list_transform(list_transform([{{'p': string_split_regex({text}, '{quoted}'), 'm': regexp_extract_all({text}, '{quoted}')}}], lambda y: list_transform(range(1, len(y.m) + 1), lambda k: {one.replace('p[', 'y.p[').replace('m[', 'y.m[')})), lambda z: z)[1]"


def _looks_random(v: str) -> str:
    entropy = f"coalesce(list_max(list_transform(range(1, length({{x}}) - {secrets.WINDOW - 2}), lambda i: list_aggregate(string_split(substr({{x}}, i, {secrets.WINDOW}), ''), 'entropy'))), 0)"
    mixed = "(regexp_matches({x}, '[0-9]') AND regexp_matches({x}, '[A-Za-z]'))"
    plain = secrets.ALLOW.removesuffix(r"|(.)\1{7}")
    run = f"len(list_filter(list_distinct(string_split(lower({v}), '')), lambda c: contains(lower({v}), repeat(c, 8)))) > 0"
    runs = f"len(list_filter(regexp_extract_all({v}, '{secrets.HEX_RUN}'), lambda r: {mixed.format(x='r')} AND {entropy.format(x='r')} >= {secrets.CLASSES['hex']})) > 0"
    return f"({mixed.format(x=v)} AND NOT regexp_matches({v}, '{plain}') AND NOT ({run}) AND ({runs} OR {entropy.format(x=v)} >= {secrets.CLASSES['token']}))"


ASSIGN_SQL = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
VALUE_OF = ASSIGN_SQL.replace("'", "''")
SPELLED = "coalesce(list_aggregate(list_transform({x}, lambda y: y.kind || ':' || y.s || ':' || y.e), 'string_agg', ','), '')"
OP9 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id,
list_filter({_found("assign", ASSIGN_SQL)}, lambda x: length(regexp_extract(x.v, '{VALUE_OF}', 2)) >= 8) AS a, list_filter({_found("access", secrets.ACCESS)}, lambda x: length(x.v) >= 16) AS b, {_found("hex", secrets.HEX)} AS c,
{_found("entropy", secrets.CANDIDATE)} AS q FROM d),
each AS (SELECT doc_id, unnest(q) AS x FROM f),
good AS (SELECT doc_id, CASE WHEN {_looks_random("x.v")} THEN [x] ELSE list_transform(list_filter({_found("entropy", secrets.VALUE, "x.v")}, lambda y: contains(x.v, '=') AND {_looks_random("y.v")}),
lambda y: {{'s': x.s + y.s, 'e': x.s + y.e, 'v': y.v, 'rank': y.rank, 'kind': y.kind}}) END AS g FROM each),
added AS (SELECT doc_id, flatten(list(g)) AS g FROM good GROUP BY doc_id),
sorted AS (SELECT f.doc_id, a, b, c, list_sort(list_transform(a || b || c, lambda x: {{'s': x.s, 'rank': x.rank, 'e': x.e, 'kind': x.kind}})) AS base,
list_sort(list_transform(a || b || c || coalesce(g, []), lambda x: {{'s': x.s, 'rank': x.rank, 'e': x.e, 'kind': x.kind}})) AS every FROM f LEFT JOIN added ON added.doc_id = f.doc_id)
SELECT doc_id, len(a) AS n_assign, len(b) AS n_access, len(c) AS n_hex, sha256({SPELLED.format(x="base")}) AS base_sha256, {SPELLED.format(x="every")} AS spans FROM sorted"""

#: SQL of the queries that SQL can express on whole tables. The others learn, tokenize, draw at random or parse by steps; tests compare those with plain versions.
ORACLE_SQL: dict[str, str] = {"op2_vector_dedup": OP2, "op3_minhash_dedup": OP3, "op8_substring_dedup": OP8, "op9_secret_scan": OP9}
