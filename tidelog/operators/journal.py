"""Bounded change journals over commits, ordered by (txn, touch_seq)."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold

ORDER = ("txn", "touch_seq")


def keep_newest(changes: DataFrame, capacity: int, order: Sequence[str] = ORDER) -> DataFrame:
    """Overwrite-oldest ring: the last ``capacity`` entries (a top-k, never a single-partition sort)."""
    return changes.orderBy(*(F.col(c).desc() for c in order)).limit(capacity)


def keep_oldest(changes: DataFrame, capacity: int, order: Sequence[str] = ORDER) -> DataFrame:
    """Reject-newest journal: the first ``capacity`` entries; commits themselves are not affected."""
    return changes.orderBy(*order).limit(capacity)


def loss(changes: DataFrame, capacity: int, name: str) -> DataFrame:
    """One row: entries overwritten or rejected, and the utilisation of the ring."""
    n = F.count("*")
    return changes.agg(
        F.least(n, F.lit(capacity)).cast("long").alias("length"),
        F.greatest(n - capacity, F.lit(0)).cast("long").alias(name),
        (F.least(n, F.lit(capacity)) / capacity).cast("double").alias("utilization"),
    )


def running_total(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value up to and including their own in order, which is unique; sorted by ranges, never in one task."""
    ranged = rows.repartitionByRange(order).select("*", F.spark_partition_id().alias("_piece"))
    sums = ranged.groupBy("_piece").agg(F.min(order).alias("_low"), F.sum(value).alias("_sum"))  # a row per partition
    before = Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_piece", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_piece").orderBy(order))
    return ranged.join(F.broadcast(sums), "_piece").withColumn(name, (F.col("_before") + own).cast("long")).drop("_piece", "_before")


def sample_and_clear(changes: DataFrame, epoch: str, capacity: int, order: Sequence[str] = ORDER) -> DataFrame:
    """Rings that are read and cleared once per epoch; ``overwritten`` counts each epoch's losses, ``overwritten_total`` all until then."""
    w = Window.partitionBy(epoch)
    ranked = changes.withColumn("_n", F.row_number().over(w.orderBy(*(F.col(c).desc() for c in order)))).withColumn("_all", F.count("*").over(w))
    losses = F.greatest(F.col("_all") - capacity, F.lit(0)).cast("long").alias("overwritten")
    kept = ranked.where(F.col("_n") <= capacity).select(*changes.columns, "_n", losses)
    totals = running_total(kept.where("_n = 1").select(epoch, "overwritten"), epoch, "overwritten", "overwritten_total")
    return kept.drop("_n").join(totals.select(epoch, "overwritten_total"), epoch)


def merge(entries: DataFrame, keys: Sequence[str] = ("rec",)) -> DataFrame:
    """Entries of a key as one: newest version, union of fields."""
    return entries.groupBy(*keys).agg(F.max("version").alias("version"), F.bit_or("mask").alias("mask"))


def merged_pair(version_a: Column, mask_a: Column, version_b: Column, mask_b: Column) -> Column:
    """One entry from an older and a newer one; a newer entry with a lower version is an error."""
    ok = F.struct(version_b.alias("version"), mask_a.bitwiseOR(mask_b).alias("mask"))
    return F.when(version_b >= version_a, ok).otherwise(F.raise_error(F.lit("journal entries out of order")))


def with_takes(entries: DataFrame, store: str, capacity: int, overwrite: bool) -> DataFrame:
    """Rings read while they fill. entries: store, ord, op ('append' or 'take'), value long.

    One ordered fold per store. Returns store, ord, op, value (what a take returned; null if the ring was empty),
    accepted, length, and the overwritten and rejected counts so far. Counters survive takes.
    """

    def step(state: dict, at: int, op: str, value: int | None) -> tuple:
        ring, accepted = state["ring"], True
        if op == "take":
            value = ring.popleft() if ring else None
        elif len(ring) < capacity:
            ring.append(value)
        elif overwrite:
            ring.popleft()
            ring.append(value)
            state["lost"] += 1
        else:
            state["refused"], accepted = state["refused"] + 1, False
        return at, op, value, accepted, len(ring), state["lost"], state["refused"]

    out = {"ord": "long", "op": "string", "value": "long", "accepted": "boolean", "length": "long", "overwritten": "long", "rejected": "long"}
    return ordered_fold(entries, store, ["ord", "op", "value"], out, lambda: {"ring": deque(), "lost": 0, "refused": 0}, step)
