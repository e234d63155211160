"""Delivery of commits to subscriptions: immediate, latest and batched; counters; state as of a flush.

Subscriptions: sub_id, sub_ord (registration order), rec, fields (compact mask, 0 for all), and optionally from_ord and
to_ord, the commits [from_ord, to_ord) during which the subscription lived. The join is on the record key. A side is
broadcast only by Spark's own size check; otherwise both are shuffled by key, which skew-join handling can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.columns import intersects, matches, ui_matches

MOST_FILTERS = 10_000


def dispatch(changes: DataFrame, subs: DataFrame, ui: bool = False) -> DataFrame:
    """Immediate delivery: one row per commit and matching live subscription; order (txn, touch_seq, sub_ord)."""
    on = changes.join(subs, "rec").where((ui_matches if ui else matches)(F.col("fields"), F.col("mask")))
    if "from_ord" in subs.columns:
        on = on.where((F.col("txn") >= F.col("from_ord")) & (F.col("txn") < F.col("to_ord")))
    return on


def dispatch_wide(changes: DataFrame, subs: DataFrame) -> DataFrame:
    """As dispatch, for masks and selections of more than 31 fields."""
    return changes.join(subs, "rec").where(intersects(F.col("selection"), F.col("mask")))


def latest(delivered: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Per subscription and flush: last matching version, union of the whole masks, coalesced commits, place in the flush."""
    return delivered.groupBy("sub_id", epoch).agg(
        F.first("rec").alias("rec"),
        F.max("version").alias("version"),
        F.bit_or("mask").alias("mask"),
        (F.count("*") - 1).alias("coalesced"),
        F.min("touch_seq").alias("first_ord"),
    )


def batched(delivered: DataFrame, capacity: int, epoch: str = "epoch") -> DataFrame:
    """The store-wide ring of each flush: its last ``capacity`` entries over all subscriptions."""
    newest = Window.partitionBy(epoch).orderBy(F.desc("txn"), F.desc("touch_seq"), F.desc("sub_ord"))
    return delivered.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= capacity).drop("_n")


def flush(latest_rows: DataFrame, batched_rows: DataFrame) -> DataFrame:
    """A flush's deliveries: latest ones by first pending commit (phase 0), then batched ones in ring order (phase 1)."""
    a = latest_rows.select(F.lit(0).alias("phase"), "epoch", "first_ord", F.lit(0).alias("ring_ord"), "sub_id", "version", "mask")
    b = batched_rows.select(F.lit(1).alias("phase"), "epoch", F.col("touch_seq").alias("first_ord"), F.col("sub_ord").alias("ring_ord"), "sub_id", "version", "mask")
    return a.unionByName(b)


def few(filters: DataFrame, most: int = MOST_FILTERS) -> DataFrame:
    """filters, if they are few enough to be sent to every task."""
    if filters.limit(most + 1).count() > most:
        raise EngineError(f"more than {most} filters")
    return filters


def pending(delivered: DataFrame, subs: DataFrame, capacity: int, epoch: str = "epoch") -> DataFrame:
    """Per subscription, what waits for the flush of the last epoch: one entry of the latest policy, and entries in the batched ring."""
    last = delivered.agg(F.max(epoch).alias("_last"))
    open_ = delivered.join(F.broadcast(last), F.col(epoch) == F.col("_last")).drop("_last")
    waiting = open_.groupBy("sub_id").agg(F.lit(1).cast("long").alias("latest_pending"))
    queued = batched(open_, capacity, epoch).groupBy("sub_id").agg(F.count("*").alias("batched_pending"))
    return subs.select("sub_id").join(waiting, "sub_id", "left").join(queued, "sub_id", "left").na.fill(0)


def purge(queued: DataFrame, inactive: DataFrame) -> DataFrame:
    """Queued work without that of inactive subscriptions."""
    return queued.join(inactive.select("sub_id").distinct(), "sub_id", "left_anti")


def metrics(delivered: DataFrame, subs: DataFrame, capacity: int) -> DataFrame:
    """Per subscription: deliveries by policy, coalesced commits, and entries that the batched ring evicted."""
    # flush epochs first: small rows by subscription and epoch are all that the final aggregation shuffles
    per = latest(delivered).groupBy("sub_id").agg(F.count("*").alias("latest_delivered"), F.sum("coalesced").alias("coalesced"))
    offered = delivered.groupBy("sub_id").agg(F.count("*").alias("immediate_delivered"))
    kept = batched(delivered, capacity).groupBy("sub_id").agg(F.count("*").alias("batched_delivered"))
    out = subs.select("sub_id").join(offered, "sub_id", "left").join(per, "sub_id", "left").join(kept, "sub_id", "left").na.fill(0)
    return out.withColumn("dropped", F.col("immediate_delivered") - F.col("batched_delivered"))


def state_as_of(flushed: DataFrame, changes: DataFrame, at: str, values: list[str]) -> DataFrame:
    """Flushed rows with the newest committed state of their record at commit order ``at`` (an as-of join by one union and window)."""
    state = changes.select("rec", F.col("txn").alias("_at"), F.lit(0).alias("_q"), F.struct("version", *values).alias("_s"), F.lit(None).cast(flushed.select(F.struct("*")).schema[0].dataType).alias("_f"))
    asked = flushed.select("rec", F.col(at).alias("_at"), F.lit(1).alias("_q"), F.lit(None).cast(state.schema["_s"].dataType).alias("_s"), F.struct("*").alias("_f"))
    w = Window.partitionBy("rec").orderBy("_at", "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = state.unionByName(asked).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_q = 1")
    return both.select("_f.*", F.col("_s.version").alias("state_version"), *(F.col(f"_s.{v}").alias(v) for v in values))


def frames(changes: DataFrame, filters: DataFrame, frame: str = "frame") -> DataFrame:
    """Frame-coalesced notification: per filter and frame, accepted and coalesced changes, and one notification with the union of masks.

    filters: filter_id, fields; at most MOST_FILTERS rows, which is checked, so they are broadcast.
    """
    on = changes.join(F.broadcast(few(filters)), ui_matches(F.col("fields"), F.col("mask")))
    return on.groupBy("filter_id", frame).agg(F.count("*").alias("accepted"), (F.count("*") - 1).alias("coalesced"), F.bit_or("mask").alias("mask"))
