"""Bounded byte-batch work: each batch's checksum and frame count, its failures kept to itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.columns import poly31_of

TRANSFORMS = ("checksum", "frames")


def process(batches: DataFrame, frame_size: int = 1, payload: str = "payload", sequence: str = "sequence") -> DataFrame:
    """sequence, checksum, frame_count, error; a batch whose bytes do not divide into frames has an error and no results.

    What is in flight is bounded by the source: maxFilesPerTrigger, maxOffsetsPerTrigger, maxSequencesPerTrigger of the capture journal.
    """
    if frame_size < 1:
        raise ValueError("frames have a byte at least")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sums, counts, errors = [], [], []
            for raw in part.column(1).to_pylist():
                bad = "no payload" if raw is None else f"{len(raw)} bytes are no frames of {frame_size}" if len(raw) % frame_size else None
                sums.append(None if bad else poly31_of(raw))
                counts.append(None if bad else len(raw) // frame_size)
                errors.append(bad)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums, pa.int64()), pa.array(counts, pa.int64()), pa.array(errors, pa.string())], ["sequence", "checksum", "frame_count", "error"])

    return batches.select(sequence, payload).mapInArrow(run, "sequence long, checksum long, frame_count long, error string")
