"""Ordered folds, one per store or journal: slot allocation, journal admission, frame-rate estimates.

Each depends on all that came before in its store, which no window expresses; parallelism is across stores. Rows are sorted by
Spark and read in batches, so a worker holds a batch and a store's state, never all rows of a store.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def ordered_fold(ops: DataFrame, store: str, columns: list[str], out: dict[str, str], start: Callable[[], object], step: Callable[..., tuple]) -> DataFrame:
    """step(state, *columns) for each row of a store in order of ``ord``, the first of columns, with a state that start makes for each store.

    Returns the store and what step returns, named and typed by out.
    """
    rows = ops.select(store, *columns).repartition(store).sortWithinPartitions(store, columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, begun = None, None, False
        for batch in batches:
            found = []
            for key, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or key != current:
                    state, current, begun = start(), key, True
                found.append(step(state, *values))
            if found:
                arrays = [pa.array(x, _ARROW.get(kind) or batch.schema.field(kind).type) for x, kind in zip(zip(*found, strict=True), out.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [store, *out])

    kinds = {f.name: f.dataType.simpleString() for f in ops.schema}
    fields = [f"`{store}` {kinds[store]}", *(f"`{n}` {k if k in _ARROW else kinds[k]}" for n, k in out.items())]
    return rows.mapInArrow(run, ", ".join(fields))

FRAME_HEADER = SEGMENT_HEADER = 24


class Slots:
    """Slots of one layout: released slots are reused first, last released first within a segment."""

    def __init__(self, per_segment: int) -> None:
        self.per_segment = per_segment
        self.used: list[int] = []  # slots ever handed out, by segment
        self.freed: list[list[int]] = []
        self.generation: dict[tuple[int, int], int] = {}
        self.hot = self.roomy = None  # segments to try first: for released and for fresh slots

    def _fresh(self, s: int | None) -> bool:
        return s is not None and self.used[s] < self.per_segment

    def allocate(self) -> tuple[int, int, int]:
        """(segment, slot, generation)."""
        if self.hot is None or not self.freed[self.hot]:
            self.hot = next((s for s, f in enumerate(self.freed) if f), None)
        if self.hot is not None:
            s, slot = self.hot, self.freed[self.hot].pop()
        else:
            if not self._fresh(self.roomy):
                self.roomy = next((s for s in range(len(self.used)) if self._fresh(s)), None)
            if self.roomy is None:
                self.used.append(0)
                self.freed.append([])
                self.roomy = len(self.used) - 1
            s, slot = self.roomy, self.used[self.roomy]
            self.used[s] += 1
        return s, slot, self.generation.setdefault((s, slot), 1)

    def release(self, segment: int, slot: int) -> None:
        self.generation[segment, slot] += 1
        if self.generation[segment, slot] < 2**32 - 1:  # at the top generation a slot retires
            self.freed[segment].append(slot)
            self.hot = segment

    @property
    def capacity(self) -> int:
        return len(self.used) * self.per_segment


def allocate_slots(ops: DataFrame, store: str, per_segment: int = 1024) -> DataFrame:
    """ops: store, ord, op ('allocate' or 'release'), rec. Returns the place of each operation's record; releases of records that are not live have none."""

    def step(state, at_: int, op: str, rec) -> tuple:
        slots, held = state
        if op == "allocate":
            at = held[rec] = slots.allocate()
        else:
            at = held.pop(rec, None)
            if at:
                slots.release(*at[:2])
        return (at_, op, rec, *(at or (None, None, None)), slots.capacity)

    out = {"ord": "long", "op": "string", "rec": "rec", "segment": "long", "slot": "long", "generation": "long", "capacity": "long"}
    return ordered_fold(ops, store, ["ord", "op", "rec"], out, lambda: (Slots(per_segment), {}), step)


class Admission:
    """Bytes of a segmented journal: what may be appended, and what an acknowledgement frees."""

    def __init__(self, most_pending: int, most_journal: int, most_segment: int) -> None:
        if most_segment > most_journal // 2:
            raise ValueError("a segment may have half of the journal's bytes at most")
        self.most_pending, self.most_journal, self.most_segment = most_pending, most_journal, most_segment
        self.pending = self.journal = 0
        self.frames: deque[tuple[int, int]] = deque()  # (sequence, payload bytes) not acknowledged
        self.segments: list[list[int]] = []  # [first sequence, last sequence, bytes]; the last one is active
        self.next = 1
        self.marks = [0, 0]  # the sequences of the two acknowledgement checkpoints

    def needs_segment(self, payload: int) -> bool:
        return not self.segments or self.segments[-1][2] + FRAME_HEADER + payload > self.most_segment

    def append(self, payload: int) -> int | None:
        """The new frame's sequence, or None if it must be refused."""
        new = self.needs_segment(payload)
        required = FRAME_HEADER + payload + SEGMENT_HEADER * new
        if self.pending > self.most_pending - payload or FRAME_HEADER + SEGMENT_HEADER + payload > self.most_segment or self.journal > self.most_journal - required:
            return None
        if new:
            self.segments.append([self.next, self.next - 1, SEGMENT_HEADER])
        self.segments[-1][1] = self.next
        self.segments[-1][2] += FRAME_HEADER + payload
        self.pending, self.journal, self.next = self.pending + payload, self.journal + required, self.next + 1
        self.frames.append((self.next - 1, payload))
        return self.next - 1

    def acknowledge(self) -> list[list[int]]:
        """Frees the oldest frame; returns the closed segments that both checkpoints cover."""
        sequence, payload = self.frames.popleft()
        self.marks[self.marks.index(min(self.marks))] = sequence
        self.pending -= payload
        gone = [s for s in self.segments[:-1] if s[1] <= min(self.marks)]
        self.segments = [s for s in self.segments if s not in gone]
        self.journal -= sum(s[2] for s in gone)
        return gone


def admit(ops: DataFrame, store: str, most_pending: int, most_journal: int, most_segment: int) -> DataFrame:
    """ops: store, ord, op ('append' or 'ack'), bytes. Returns accepted, sequence, pending and journal bytes and segments after each."""

    def step(a: Admission, at: int, op: str, size: int | None) -> tuple:
        if op == "append":
            sequence = a.append(int(size))
            ok = sequence is not None
        else:
            ok = bool(a.frames)
            sequence = a.frames[0][0] if ok else None
            if ok:
                a.acknowledge()
        return at, op, ok, sequence, a.pending, a.journal, len(a.segments)

    out = {"ord": "long", "op": "string", "accepted": "boolean", "sequence": "long", "pending": "long", "journal": "long", "segments": "long"}
    return ordered_fold(ops, store, ["ord", "op", "bytes"], out, lambda: Admission(most_pending, most_journal, most_segment), step)


def frame_rate(stamps: DataFrame, key: str, micros: str = "micros", window: int = 1_000_000) -> DataFrame:
    """Frames per second at each stamp (null until ``window`` microseconds passed since the last report); stamps that repeat or go back count for nothing.

    stamps: key, ord, micros.
    """

    def step(state: dict, at: int, t: int) -> tuple:
        rate, last = None, state.get("last")
        if last is None:
            state.update(anchor=t, last=t, intervals=0)
        elif t > last:
            state.update(last=t, intervals=state["intervals"] + 1)
            since = t - state["anchor"]
            if since >= window:
                rate = (state["intervals"] * 1_000_000 * 2 + since) // (2 * since)
                state.update(anchor=t, intervals=0)
        return at, t, rate

    return ordered_fold(stamps, key, ["ord", micros], {"ord": "long", "micros": "long", "fps": "long"}, dict, step)
