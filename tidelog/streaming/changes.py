"""Net change, delivery and listeners on streams.

A transaction must lie within one micro-batch: the source has to be cut at transaction ends. Sinks keyed by batch id make
redelivery after a restart idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.delivery import batched, dispatch, few, flush, latest


def net_change_stream(writes: DataFrame, fields: dict[str, object]) -> DataFrame:
    """Streaming form of net_changes for up to 31 numeric or boolean fields: rec, txn, touch_seq, version, mask, values.

    State per record: its image and version. Writes of a record are ordered by (txn, seq) within a micro-batch.
    """
    if len(fields) > 31:
        raise ValueError("31 fields at most on streams")
    names, zeros = list(fields), list(fields.values())
    kinds = {f.name: f.dataType.simpleString() for f in writes.schema}
    real = [kinds[n] in ("float", "double") for n in names]

    def differs(a, b, is_real: bool) -> bool:
        return np.float64(a).tobytes() != np.float64(b).tobytes() if is_real else a != b

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        image, version = (list(state.get[:-1]), int(state.get[-1])) if state.exists else (list(zeros), 0)
        rows = pd.concat(list(batches)).sort_values(["txn", "seq"])
        out = []
        for txn, part in rows.groupby("txn", sort=True):
            before = list(image)
            for i, n in enumerate(names):
                written = part[n].dropna()
                if len(written):
                    v = written.iloc[-1]
                    image[i] = v.item() if hasattr(v, "item") else v
            mask = sum(1 << i for i in range(len(names)) if differs(image[i], before[i], real[i]))
            if mask:
                version += 1
                out.append((key[0], int(txn), int(part["seq"].min()), version, mask, *image))
        state.update((*image, version))
        yield pd.DataFrame(out, columns=["rec", "txn", "touch_seq", "version", "mask", *names])

    values = ", ".join(f"{n} {kinds[n]}" for n in names)
    return (
        writes.select("rec", "txn", "seq", *names)
        .groupBy("rec")
        .applyInPandasWithState(step, f"rec {kinds['rec']}, txn long, touch_seq long, version long, mask int, {values}", f"{values}, version long", "append", GroupStateTimeout.NoTimeout)
    )


def flush_each_batch(changes: DataFrame, subs: DataFrame, path: str, ring: int = 1024, **options):
    """Each micro-batch is a flush: latest and batched deliveries as Parquet under path/batch=<id>, overwritten if the batch runs again."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        delivered = dispatch(batch, subs).withColumn("epoch", F.lit(batch_id).cast("long"))
        own = delivered.where("policy = 'batched'")
        out = flush(latest(delivered.where("policy = 'latest'")), batched(own, ring))
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes.writeStream.foreachBatch(on_batch).outputMode("append").options(**options)


def listen(changes: DataFrame, listeners: list[Callable[[DataFrame, int], None]], **options):
    """All listeners get every batch; the first error is raised after all have run, which fails the query."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        first = None
        batch.persist()
        try:
            for f in listeners:
                try:
                    f(batch, batch_id)
                except Exception as e:
                    first = first or e
        finally:
            batch.unpersist()
        if first:
            raise first

    return changes.writeStream.foreachBatch(on_batch).options(**options)


def frames(changes: DataFrame, ts: str, filters: DataFrame, frame: str = "16 milliseconds", late: str = "1 second") -> DataFrame:
    """Frame-coalesced notifications by event time, for streams: one row per filter and frame once the watermark passed it."""
    from ..functions.columns import ui_matches

    on = changes.withWatermark(ts, late).join(F.broadcast(few(filters)), ui_matches(F.col("fields"), F.col("mask")))
    return on.groupBy("filter_id", F.window(ts, frame)).agg(F.count("*").alias("accepted"), (F.count("*") - 1).alias("coalesced"), F.bit_or("mask").alias("mask"))
