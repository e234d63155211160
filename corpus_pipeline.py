"""From raw documents to packed training sequences: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import language, minhash, mixing, packing, secrets
from tidelog.llm.common import WORD_SPACE, durable, fresh
from tidelog.llm.queries import tokenizer
from tidelog.sources.shared import shared_folder

#: A document whose language is unknown, or whose windows are each told with less than this score in the mean, goes.
LEAST_SCORE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose windows are in languages that the model tells, be they several; ``und`` and unsure ones go."""
    pred, score, sure = "lang_pred", "score", fresh(docs, "sure")
    clash = {c: fresh(docs, f"{c}_") for c in (pred, score) if c in docs.columns}
    found = language.identify(docs.withColumnsRenamed(clash), language.learn(docs), keep=tuple(clash.get(c, c) for c in docs.columns), sure=sure)
    kept = found.where((F.col(pred) != language.UNKNOWN) & (F.col(sure) >= LEAST_SCORE)).drop(pred, score, sure)
    return kept.withColumnsRenamed({v: k for k, v in clash.items()}).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate rows, whatever their ids, the one with the smallest id (null last), then the smallest hash of the text.

    Rows without words are near nothing; of those with the same id and text one stays, and all with a null id.
    """
    row = fresh(docs, "row")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    text, blank = F.col("text"), ~F.coalesce(F.col("text").rlike(rf"[^{WORD_SPACE}]"), F.lit(False)) & F.col("doc_id").isNotNull()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(row).alias("row"))
    keys = numbered.select(F.col(row).alias("r"), order.alias("order"), F.when(blank, F.col("doc_id")).alias("same_id"), F.when(blank, text).alias("same_text"), blank.alias("blank"))
    found = minhash.near_duplicates(numbered, id_col=row).select(F.col(row).alias("n"), "component_id")
    group = (F.when(~F.col("blank"), F.col("component_id")).alias("group"), "same_id", "same_text")
    first = found.join(keys, F.col("n") == F.col("r")).groupBy(*group).agg(F.min("order").alias("first"))
    return numbered.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark; n_chars follows."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))).select(docs.columns) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each row by its own choice whatever its id."""
    row, copies = fresh(docs, "row"), fresh(docs, "copies")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mixing.mix_sources(numbered, id_col=row, tie_cols=("doc_id", "source", "text")).where("copies > 0").select(row, F.col("copies").cast("int").alias(copies))
    return numbered.join(taken, row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces with their token ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", by_language),
    ("minhash_dedup", one_of_each_group),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages hash, learn and tokenize, which SQL cannot express; tests hold operators and chain against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again, and deleted once the next one is written. The last one stays, as it is the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove(spark, before)
        before = f"{at}/{name}"
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
