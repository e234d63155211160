"""Shared pieces: durable cut points, column checks, hashing of words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Whitespace that ends a word, as a character class body for Java and RE2 patterns.
WORD_SPACE = r"\x20\x09-\x0D"

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints that nothing refers to any more; it finds them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def need(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only: other columns, whatever their names, are ignored by an operator."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*columns)


def whole_ids(df: DataFrame, column: str) -> Column:
    """The column as long; ids that are no integers are an error."""
    if df.schema[column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{column} must be of an integer type, not {df.schema[column].dataType.simpleString()}")
    return F.col(column).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory of this worker to the system: workers stay for later tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def returning(scan):
    """A mapInArrow function that gives its memory back when its batches are done."""

    @functools.wraps(scan)
    def run(batches):
        try:
            yield from scan(batches)
        finally:
            give_back()

    return run


#: Bytes and rows of a batch that a worker turns into Python objects at once; Spark bounds the batches themselves by bytes.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES bytes, and SLICE_ROWS rows at most; a row of more bytes is a slice of its own."""
    for batch in batches:
        size = sum(c.nbytes for c in batch.columns)
        rows = max(1, min(SLICE_ROWS, len(batch) * SLICE_BYTES // max(1, size)))
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text) -> F.Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0), without a regular expression."""
    c = F.col(text) if isinstance(text, str) else text
    for ws in "\t\n\x0b\x0c\r":
        c = F.replace(c, F.lit(ws), F.lit(" "))
    return F.coalesce(F.size(F.array_remove(F.split(c, " "), "")).cast("long"), F.lit(0).cast("long"))


#: Longer words (in bytes or characters) are not remembered, so that what is remembered is bounded in bytes.
REMEMBERED = 64


class Words(dict):
    """Word (bytes) -> 64-bit hash, remembered up to a fixed number of entries of REMEMBERED bytes at most."""

    LIMIT = 250_000

    def __init__(self, seed: int = 0) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= REMEMBERED:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent hash of two arrays of hashes."""
    h = a * _C1
    h ^= ((b << np.uint64(31)) | (b >> np.uint64(33))) * _C2
    h ^= h >> np.uint64(29)
    h *= _C3
    h ^= h >> np.uint64(32)
    return h
