"""The pipeline's chain against plain versions of its stages."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import language, mixing
from tidelog.llm.queries import tokenizer

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, sf, tmp_path_factory):
    """A folder with the documents, every tenth also as a text turned round, with a secret."""
    at, docs = str(tmp_path_factory.mktemp("planted")), spark.read.parquet(f"{sf}/documents.parquet")
    words = F.reverse(F.split("text", " "))
    more = docs.where("doc_id % 10 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat(F.array_join(words, " "), F.lit(" password: hunter2hunter2 end")).alias("text"), "lang", "source", "n_chars")
    docs.unionByName(more).coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def chain(spark, planted):
    """The rows after each stage, each stage run on what its predecessor kept."""
    docs, out = spark.read.parquet(f"{planted}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs))
        rows = stage(spark, docs, planted).collect()
        if name != "packing":
            docs = spark.createDataFrame(rows, docs.schema)
    return dict([*out, ("end", rows)])


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_language_stage(chain):
    docs, kept = chain["language_id"], chain["minhash_dedup"]
    found = {r.doc_id: r for r in language.identify(docs, language.learn(docs)).collect()}
    assert rows(kept) == sorted(tuple(r) for r in docs.collect() if found[r.doc_id].lang_pred != "und" and found[r.doc_id].score >= corpus_pipeline.LEAST_SCORE)
    assert kept.count() > 0.8 * docs.where("text rlike '[a-z]'").count()


def test_near_duplicate_stage(chain):
    before = chain["minhash_dedup"].collect()
    near = brute.near([(r.doc_id, r.text) for r in before], 5)
    assert rows(chain["secret_scan"]) == sorted(tuple(r) for r in before if near[r.doc_id][2])


def test_secret_stage(chain):
    before, after = ({r.doc_id: r for r in chain[k].collect()} for k in ("secret_scan", "mixing"))
    assert before.keys() == after.keys()
    for d, r in after.items():
        assert (r.lang, r.source, r.n_chars) == (before[d].lang, before[d].source, len(r.text))
        assert not brute.secrets(r.text)
        if "[SECRET]" not in r.text:
            assert r.text == before[d].text
    assert any(brute.secrets(r.text) for r in before.values())


def test_mixing_stage(chain):
    before, after = chain["mixing"].collect(), chain["packing"].collect()
    known, size = {tuple(r) for r in before}, lambda r: len(brute.words(r.text))
    assert {tuple(r) for r in after} <= known
    total, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        total[r.source] += size(r)
        most[r.source] = max(most[r.source], size(r))
    for r in after:
        taken[r.source] += size(r)
    for s, want in mixing.targets(list(total.items())).items():
        assert abs(taken[s] - want) <= most[s]


def test_packing_stage(chain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    ids, times, got = {}, defaultdict(int), defaultdict(int)
    for r in chain["packing"].collect():
        ids[r.doc_id] = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        times[r.doc_id] += 1
    for p in chain["end"]:
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length]
        got[p.doc_id] += p.length
    assert got == {d: n * len(ids[d]) for d, n in times.items()}


def test_run_is_the_chain(spark, planted, chain):
    assert sorted(map(tuple, corpus_pipeline.run(spark, planted).collect())) == sorted(map(tuple, chain["end"]))


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows and ids, and clashing names pass every stage."""
    long = " ".join(f"w{i}" for i in range(300))
    some = [(1, long, "en", "a", 9), (1, long, "en", "a", 9), (2, long + " more", "en", None, 9), (None, "other words here", None, "a", None), (None, None, None, None, None), (3, "", "de", "b", 0), (4, "x token = abcdefgh12 y", "en", "b", 3)]
    docs = spark.createDataFrame(some, DOC)
    for c in ("copies", "kept", "rows", "score", "lang_pred", "component_id", "found"):
        docs = docs.withColumn(c, F.lit("x"))
    near = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted([(1, long), (3, ""), (4, some[6][1]), (None, "other words here"), (None, None)], key=str)
    mixed = corpus_pipeline.mixed(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in mixed} <= {r[:2] for r in some} and len(mixed) <= 3 * len(some)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), "").collect() == []
    assert corpus_pipeline.packed(spark, docs, "").count() >= len(some)


@pytest.mark.parametrize("shared", (None, 7))
def test_mixing_decides_for_each_row(spark, shared):
    """Rows with a null id, or one id, meet the targets as others do."""
    some = [(shared, f"t{i} " + "w " * (i % 7), "en", "abcd"[i % 4 if i % 3 else 0], i) for i in range(400)]
    docs = spark.createDataFrame(some, DOC)
    size, total, most, taken = (lambda t: len(brute.words(t))), defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in some:
        total[s], most[s] = total[s] + size(t), max(most[s], size(t))
    after = corpus_pipeline.mixed(spark, docs, "").collect()
    for r in after:
        taken[r.source] += size(r.text)
    want = mixing.targets(list(total.items()))
    assert any(0.1 < want[s] / total[s] < 0.5 for s in total)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in total), (dict(taken), want)
    assert {tuple(r) for r in after} <= set(some)
    again = corpus_pipeline.mixed(spark, docs.repartition(5, "n_chars"), "")
    assert rows(again) == sorted(map(tuple, after))


def test_near_duplicates_among_null_and_shared_ids(spark):
    """Exact and near copies go whether their ids are null, shared or their own; the smallest id stays."""
    some, group = [], {}
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(200)]
        for k in range(6):
            words = base if k < 2 else [*base[:-1], f"end{k}"]
            i = (None, 5, 5, 1000 + 10 * g + k)[(g + k) % 4] if g % 2 else None
            some.append((i, " ".join(words), "en", "a", len(some)))
            group[len(some) - 1] = g
    some += [(5, " ", "en", "a", 100), (5, " ", "en", "a", 100), (5, None, "en", "a", 101), (None, "", "en", "a", 102), (None, "", "en", "a", 102)]
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(some, DOC), "").collect()
    assert sorted(r.n_chars for r in kept if r.n_chars >= 100) == [100, 101, 102, 102]
    one = {group[r.n_chars]: r.doc_id for r in kept if r.n_chars < 100}
    assert len(kept) == 4 + 8 and one == {g: min((some[k][0] for k in group if group[k] == g and some[k][0]), default=None) for g in range(8)}


def test_documents_in_several_languages_stay(spark):
    """Three languages in like parts, each told with certainty, leave no label a half."""
    words = {"aa": "the cat sat on mat", "bb": "der hund und katze", "cc": "пёс кот дом лес"}
    alone = [(i, " ".join([words[k]] * 30), k, "a", 0) for i, k in enumerate(sorted(words) * 20)]
    several = (1000, "".join((" ".join([words[k]] * 300)).encode()[:2560].decode("utf-8", "ignore").ljust(10) for k in sorted(words)), None, "a", 0)
    docs = spark.createDataFrame([*alone, several, (1001, "123 456", None, "a", 0)], DOC)
    found = {r.doc_id: r for r in language.identify(docs, language.learn(docs)).collect()}
    assert found[1000].score < corpus_pipeline.LEAST_SCORE
    assert rows(corpus_pipeline.by_language(spark, docs, "").select("doc_id")) == [(i,) for i in (*range(60), 1000)]
