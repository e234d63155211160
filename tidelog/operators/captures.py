"""Record lifecycle, checkpoints, captures and replay.

Lifecycle operations: rec, ord (unique), op ('write' or 'release') and values. A write to a record that is not live
allocates it anew: its generation is one more than the releases before. Captures: sequence, op_idx, kind ('checkpoint' or
'incremental'), op ('snapshot' or 'release'), the record key and the image's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def generations(ops: DataFrame) -> DataFrame:
    """Operations with the generation they belong to: 1 + releases before."""
    before = Window.partitionBy("rec").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return ops.withColumn("generation", (1 + F.coalesce(F.sum((F.col("op") == "release").cast("long")).over(before), F.lit(0))).cast("long"))


def live(ops: DataFrame, values: list[str]) -> DataFrame:
    """Records that are live: current generation, writes in it, last values."""
    g = generations(ops).groupBy("rec", "generation").agg(
        F.count_if(F.col("op") == "release").alias("_gone"), F.count_if(F.col("op") == "write").alias("writes"), *(F.max_by(v, "ord").alias(v) for v in values)
    )
    return g.where("_gone = 0 and writes > 0").drop("_gone")


def stale(ops: DataFrame) -> DataFrame:
    """Handles (rec, generation) that once were given out and are no longer live."""
    given = generations(ops).select("rec", "generation").distinct()
    return given.join(live(ops, []).select("rec", "generation"), ["rec", "generation"], "left_anti")


def checkpoint(changes: DataFrame, values: list[str]) -> DataFrame:
    """Full image of every record that has commits: newest version and values, with alloc_ord, its place in allocation order."""
    return changes.groupBy("rec").agg(F.min("touch_seq").alias("alloc_ord"), F.max("version").alias("version"), *(F.max_by(v, "version").alias(v) for v in values))


def since_checkpoint(captures: DataFrame) -> DataFrame:
    """Captures from the last checkpoint on: a checkpoint replaces what was before. One row of metadata is joined in."""
    last = captures.where("kind = 'checkpoint'").agg(F.max("sequence").alias("_last"))
    return captures.join(F.broadcast(last)).where(F.col("sequence") >= F.coalesce("_last", F.lit(-1))).drop("_last")


def replay(captures: DataFrame, values: list[str]) -> DataFrame:
    """Recovered records: the last operation of each key since the last checkpoint, if it is a snapshot."""
    at = F.struct("sequence", "op_idx")
    last = since_checkpoint(captures).groupBy("rec").agg(F.max_by("op", at).alias("op"), *(F.max_by(v, at).alias(v) for v in values))
    return last.where("op = 'snapshot'").drop("op")


def recovered_order(captures: DataFrame) -> DataFrame:
    """Place of each recovered record: (sequence, op_idx) of its first snapshot after its last release; updates keep the place."""
    at = F.struct("sequence", "op_idx")
    some = since_checkpoint(captures).select("rec", "op", at.alias("at"))
    gone = F.max(F.when(F.col("op") == "release", F.col("at"))).over(Window.partitionBy("rec"))
    kept = some.withColumn("gone", gone).where((F.col("op") == "snapshot") & (F.col("gone").isNull() | (F.col("at") > F.col("gone"))))
    return kept.groupBy("rec").agg(F.min("at").alias("at")).select("rec", F.col("at.sequence").alias("sequence"), F.col("at.op_idx").alias("op_idx"))


def resolve_layouts(snapshots: DataFrame, layouts: DataFrame) -> DataFrame:
    """Snapshots with the current schema of their (layout_identity, layout_version); layouts is the catalogue of known layouts."""
    return snapshots.join(layouts, ["layout_identity", "layout_version"], "left")
