"""Binary capture journal: batch codec, segmented append log with checksums and acknowledgements, and a Spark data source.

All numbers are big-endian. The file formats are fixed values of the interchange format; the Parquet form of captures needs none of this.
"""

from __future__ import annotations

import contextlib
import fcntl
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import BackpressureError, CaptureFormatError, ClosedError, EngineError, IntegrityError
from ..operators.folds import Admission

# fixed values of the format: magics, version, kinds and tags, header sizes, default limits, file names
BATCH_MAGIC, SEGMENT_MAGIC, FRAME_MAGIC, ACK_MAGIC = 0x50534350, 0x50534A53, 0x50534A46, 0x5053414B
FORMAT = 1
CHECKPOINT, INCREMENTAL = 0, 1
SNAPSHOT, RELEASE = 1, 2
MOST_PENDING, MOST_JOURNAL, MOST_SEGMENT = 8 << 20, 16 << 20, 1 << 20
SEGMENT_NAME = re.compile(r"segment-([0-9]{16})\.psjs")

_U64 = struct.Struct(">Q")


@dataclass(frozen=True)
class Op:
    """A captured operation. Releases have only the record key."""

    segment: int
    slot: int
    generation: int
    release: bool = False
    identity: str = ""
    layout_version: int = 0
    version: int = 0
    image: bytes = b""


def fnv(raw: bytes) -> int:
    h = 0x811C9DC5
    for b in raw:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def encode_batch(kind: int, ops: list[Op]) -> bytes:
    if kind == INCREMENTAL and not ops:
        raise CaptureFormatError("an incremental batch has operations")
    if kind == CHECKPOINT and any(o.release for o in ops):
        raise CaptureFormatError("a checkpoint has snapshots only")
    out = [struct.pack(">IBBI", BATCH_MAGIC, FORMAT, kind, len(ops))]
    for o in ops:
        out.append(struct.pack(">BIII", RELEASE if o.release else SNAPSHOT, o.segment, o.slot, o.generation))
        if not o.release:
            name = o.identity.encode()
            out += [struct.pack(">I", len(name)), name, struct.pack(">IQI", o.layout_version, o.version, len(o.image)), o.image]
    return b"".join(out)


def decode_batch(raw: bytes) -> tuple[int, list[Op]]:
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        s = struct.Struct(form)
        if at + s.size > len(raw):
            raise CaptureFormatError("truncated")
        at += s.size
        return s.unpack_from(raw, at - s.size)

    def blob() -> bytes:
        nonlocal at
        (n,) = take(">I")
        if at + n > len(raw):
            raise CaptureFormatError("truncated")
        at += n
        return raw[at - n : at]

    magic, version, kind, count = take(">IBBI")
    if magic != BATCH_MAGIC or version != FORMAT or kind not in (CHECKPOINT, INCREMENTAL):
        raise CaptureFormatError("no capture batch of a known version")
    if (kind == INCREMENTAL and not count) or count > (len(raw) - at) // 13:
        raise CaptureFormatError("impossible number of operations")
    ops = []
    for _ in range(count):
        tag, segment, slot, generation = take(">BIII")
        if tag == RELEASE and kind == INCREMENTAL:
            ops.append(Op(segment, slot, generation, True))
        elif tag == SNAPSHOT:
            try:
                name = blob().decode()
            except UnicodeDecodeError as e:
                raise CaptureFormatError("layout identity is no UTF-8") from e
            layout_version, record_version = take(">IQ")
            ops.append(Op(segment, slot, generation, False, name, layout_version, record_version, blob()))
        else:
            raise CaptureFormatError(f"operation tag {tag}")
    if at != len(raw):
        raise CaptureFormatError("trailing bytes")
    return kind, ops


def replay(batches: list[tuple[int, list[Op]]]) -> dict[tuple[int, int, int], Op]:
    """State after batches: a checkpoint replaces it, snapshots put, releases remove."""
    state: dict[tuple[int, int, int], Op] = {}
    for kind, ops in batches:
        if kind == CHECKPOINT:
            state = {}
        for o in ops:
            key = (o.segment, o.slot, o.generation)
            if o.release:
                state.pop(key, None)
            else:
                state[key] = o
    return state


def segment_header(first: int) -> bytes:
    head = struct.pack(">IBBHQ", SEGMENT_MAGIC, FORMAT, 0, 0, first)
    return head + struct.pack(">II", fnv(head), 0)


def frame(sequence: int, payload: bytes) -> bytes:
    return struct.pack(">IBBHQII", FRAME_MAGIC, FORMAT, 0, 0, sequence, len(payload), fnv(payload)) + payload


def read_segment(path: str) -> tuple[int, list[tuple[int, bytes]]]:
    """First sequence and frames; any damage raises."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) < 24:
        raise IntegrityError(f"{path}: short header")
    magic, version, _, _, first, check, zero = struct.unpack(">IBBHQII", raw[:24])
    if magic != SEGMENT_MAGIC or version != FORMAT or check != fnv(raw[:16]) or zero:
        raise IntegrityError(f"{path}: bad segment header")
    at, want, out = 24, first, []
    while at < len(raw):
        if at + 24 > len(raw):
            raise IntegrityError(f"{path}: short frame header")
        magic, version, _, _, sequence, size, check = struct.unpack(">IBBHQII", raw[at : at + 24])
        payload = raw[at + 24 : at + 24 + size]
        if magic != FRAME_MAGIC or version != FORMAT or sequence != want or len(payload) != size or check != fnv(payload):
            raise IntegrityError(f"{path}: bad frame {want}")
        out.append((sequence, payload))
        at, want = at + 24 + size, want + 1
    return first, out


def segment_end(path: str) -> tuple[int, int]:
    """First sequence and the one after the last, from the headers alone; payloads are checked where they are read."""
    size, at = os.path.getsize(path), 24
    with open(path, "rb") as f:
        raw = f.read(24)
        if len(raw) < 24:
            raise IntegrityError(f"{path}: short header")
        magic, version, _, _, first, check, zero = struct.unpack(">IBBHQII", raw)
        if magic != SEGMENT_MAGIC or version != FORMAT or check != fnv(raw[:16]) or zero:
            raise IntegrityError(f"{path}: bad segment header")
        want = first
        while at < size:
            f.seek(at)
            raw = f.read(24)
            if len(raw) < 24:
                raise IntegrityError(f"{path}: short frame header")
            magic, version, _, _, sequence, length, _ = struct.unpack(">IBBHQII", raw)
            if magic != FRAME_MAGIC or version != FORMAT or sequence != want or at + 24 + length > size:
                raise IntegrityError(f"{path}: bad frame {want}")
            at, want = at + 24 + length, want + 1
    return first, want


def segment_files(path: str) -> list[tuple[int, str]]:
    """(first sequence, file) in order; names tell the sequence."""
    folder = f"{path}.segments"
    names = os.listdir(folder) if os.path.isdir(folder) else []
    found = sorted((int(m[1]), f"{folder}/{n}") for n in names if (m := SEGMENT_NAME.fullmatch(n)))
    if len({s for s, _ in found}) < len(found):
        raise IntegrityError("two segments start alike")
    return found


class Journal:
    """One owner's journal: appends, ordered replay with one delivery outstanding, durable acknowledgements."""

    _open: set[str] = set()

    def __init__(self, path: str, most_pending: int = MOST_PENDING, most_journal: int = MOST_JOURNAL, most_segment: int = MOST_SEGMENT) -> None:
        self.path, self.failed, self.closed = os.path.realpath(path), None, False
        self.admission = Admission(most_pending, most_journal, most_segment)
        if self.path in Journal._open:
            raise EngineError(f"{path} is open")
        for d in ("segments", "metadata"):
            os.makedirs(f"{self.path}.{d}", exist_ok=True)
        self._lock = open(f"{self.path}.lock", "w")  # noqa: SIM115
        try:
            fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self._lock.close()
            raise EngineError(f"{path} is locked") from e
        Journal._open.add(self.path)
        try:
            self._recover()
        except BaseException:
            self._release()
            raise
        self._file = None
        self._read: tuple[int, dict[int, bytes]] = (0, {})
        self.outstanding: int | None = None

    def _release(self) -> None:
        Journal._open.discard(self.path)
        self._lock.close()

    def _ack_file(self, slot: int) -> str:
        return f"{self.path}.metadata/ack.{'ab'[slot]}"

    def _recover(self) -> None:
        a, valid, seen = self.admission, [], 0
        for slot in (0, 1):
            if not os.path.exists(self._ack_file(slot)):
                continue
            seen += 1
            with open(self._ack_file(slot), "rb") as f:
                raw = f.read()
            if len(raw) == 32:
                magic, version, own, _, generation, sequence, check, zero = struct.unpack(">IBBHQQII", raw)
                if (magic, version, own, zero) == (ACK_MAGIC, FORMAT, slot, 0) and check == fnv(raw[:24]):
                    valid.append((generation, sequence, slot))
        if seen and not valid:
            raise IntegrityError("no valid acknowledgement")
        valid.sort()
        if len(valid) == 2 and not (valid[0][0] < valid[1][0] and valid[0][1] < valid[1][1]):
            raise IntegrityError("acknowledgements contradict each other")
        self.generation, acked, self.slot = valid[-1] if valid else (0, 0, 1)
        a.marks = [s for _, s, _ in valid] if len(valid) == 2 else [0, acked]
        self.payloads: dict[int, str] = {}
        want = None
        for first, file in segment_files(self.path):
            head, frames = read_segment(file)
            if head != first or (want is not None and first != want):
                raise IntegrityError(f"{file}: sequence gap or overlap")
            size = os.path.getsize(file)
            if size > a.most_segment:
                raise IntegrityError(f"{file}: larger than a segment may be")
            a.segments.append([first, first + len(frames) - 1, size])
            a.journal += size
            for sequence, payload in frames:
                if sequence > acked:
                    a.frames.append((sequence, len(payload)))
                    a.pending += len(payload)
            want = first + len(frames)
        if want is None and acked or want is not None and acked >= want or a.segments and a.segments[0][0] > acked + 1:
            raise IntegrityError("acknowledgements and segments do not meet")
        if a.journal > a.most_journal or a.pending > a.most_pending:
            raise IntegrityError("journal is over its limits")
        a.next = want or 1

    def _ready(self) -> None:
        if self.closed:
            raise ClosedError("journal is closed")
        if self.failed:
            raise self.failed

    def _segment_file(self, first: int) -> str:
        return f"{self.path}.segments/segment-{first:016d}.psjs"

    def append(self, payload: bytes) -> int:
        """The sequence of the appended batch; refused whole if a limit would be passed."""
        self._ready()
        a = self.admission
        new = a.needs_segment(len(payload))
        sequence = a.append(len(payload))
        if sequence is None:
            raise BackpressureError("capture refused", a.pending, a.most_pending, len(payload) + 48)
        if new or self._file is None:
            if self._file:
                self._file.close()
            self._file = open(self._segment_file(a.segments[-1][0]), "ab")  # noqa: SIM115
            if new:
                self._file.write(segment_header(sequence))
        self._file.write(frame(sequence, payload))
        return sequence

    def flush(self) -> None:
        self._ready()
        if self._file:
            self._file.flush()
            os.fsync(self._file.fileno())

    def take(self) -> tuple[int, bytes] | None:
        """The oldest batch that is not acknowledged; one at a time."""
        self._ready()
        if self.outstanding is not None:
            raise EngineError("a delivery is outstanding")
        self.flush()
        if not self.admission.frames:
            return None
        sequence = self.admission.frames[0][0]
        first = max(s[0] for s in self.admission.segments if s[0] <= sequence)
        try:
            if self._read[0] != first or sequence not in self._read[1]:  # a segment is read once, and again only for frames that came since
                self._read = (first, dict(read_segment(self._segment_file(first))[1]))
            payload = self._read[1][sequence]
        except (IntegrityError, KeyError, OSError) as e:
            self.failed = e if isinstance(e, IntegrityError) else IntegrityError(f"frame {sequence} cannot be read")
            raise self.failed from e
        self.outstanding = sequence
        return sequence, payload

    def retry(self) -> None:
        """Offer the outstanding batch again."""
        self.outstanding = None

    def acknowledge(self, sequence: int) -> None:
        self._ready()
        if self.outstanding != sequence:
            raise EngineError("not the outstanding delivery")
        self.flush()
        self.generation, self.slot, self.outstanding = self.generation + 1, 1 - self.slot, None
        head = struct.pack(">IBBHQQ", ACK_MAGIC, FORMAT, self.slot, 0, self.generation, sequence)
        with open(self._ack_file(self.slot), "wb") as f:
            f.write(head + struct.pack(">II", fnv(head), 0))
            f.flush()
            os.fsync(f.fileno())
        for s in self.admission.acknowledge():
            os.remove(self._segment_file(s[0]))

    def close(self) -> None:
        if not self.closed:
            if self._file:
                self._file.close()
            self.closed = True
            self._release()


SCHEMA = "sequence long, op_idx int, kind string, op string, segment long, slot long, generation long, layout_identity string, layout_version long, version decimal(20,0), image binary"


class SegmentPartition(InputPartition):
    def __init__(self, file: str, low: int, high: int, first: int = 0, after: int = 0) -> None:
        super().__init__(file)
        self.file, self.low, self.high, self.first, self.after = file, low, high, first, after


def _rows(p: SegmentPartition) -> Iterator[tuple]:
    from decimal import Decimal

    first, frames = read_segment(p.file)
    if first != p.first or first + len(frames) < p.after:
        raise IntegrityError(f"{p.file}: not the sequences that were planned")
    for sequence, payload in frames:
        if not p.low <= sequence < p.high:
            continue
        kind, ops = decode_batch(payload)
        for i, o in enumerate(ops):
            head = (sequence, i, "checkpoint" if kind == CHECKPOINT else "incremental", "release" if o.release else "snapshot", o.segment, o.slot, o.generation)
            yield (*head, None, None, None, None) if o.release else (*head, o.identity, o.layout_version, Decimal(o.version), o.image)


def _plan(path: str, low: int, high: int) -> list[SegmentPartition]:
    """One partition per segment that can hold sequences of [low, high); a gap or overlap at the end of one of them raises."""
    files = segment_files(path)
    out = []
    for k, (name, file) in enumerate(files):
        after = files[k + 1][0] if k + 1 < len(files) else None
        if name < high and (after is None or after > low):
            first, end = segment_end(file)
            if first != name or after not in (None, end):
                raise IntegrityError(f"{file}: sequence gap or overlap")
            out.append(SegmentPartition(file, low, high, first, end))
    return out


class JournalReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.low, self.high = options["path"], int(options.get("from", 0)), int(options.get("to", 1 << 62))

    def partitions(self) -> list[SegmentPartition]:
        return _plan(self.path, self.low, self.high) or [SegmentPartition("", 0, 0)]

    def read(self, partition: SegmentPartition) -> Iterator[tuple]:
        return _rows(partition) if partition.file else iter(())


class JournalStreamReader(DataSourceStreamReader):
    """Offsets are sequences; commit() is the acknowledgement, kept by the checkpoint of the query.

    With the option maxsequencespertrigger an offer ends so many sequences after what was last planned or acknowledged; the
    acknowledged sequence is kept beside the journal, so after a restart an offer is twice that long at most. Spark asks a Python
    source once for the end of an availableNow run, so such a run takes one offer; others go on to the end. With reclaim
    (true), segments whose sequences are all acknowledged are deleted, but for the last one, which tells where the journal goes on.
    """

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most, self.reclaim = int(options.get("maxsequencespertrigger", 0)), options.get("reclaim", "false").lower() == "true"
        if self.most < 0:
            raise EngineError("maxSequencesPerTrigger must be positive")
        self.at: int | None = None

    def _acknowledged(self) -> str:
        return f"{self.path}.metadata/stream"

    def _reached(self) -> int:
        """The sequence up to which the stream has planned or, after a restart, acknowledged."""
        if self.at is None:
            with contextlib.suppress(FileNotFoundError), open(self._acknowledged()) as f:
                return int(f.read()) + self.most
        return self.at or self.initialOffset()["sequence"]

    def initialOffset(self) -> dict:  # noqa: N802
        files = segment_files(self.path)  # acknowledged segments may be gone
        return {"sequence": files[0][0] if files else 1}

    def latestOffset(self) -> dict:  # noqa: N802
        files = segment_files(self.path)
        end = segment_end(files[-1][1])[1] if files else 1
        return {"sequence": min(end, self._reached() + self.most) if self.most else end}

    def partitions(self, start: dict, end: dict) -> list[SegmentPartition]:
        low, high = start["sequence"], end["sequence"]
        self.at = high
        planned = _plan(self.path, low, high)
        if high < low or low < high and not (planned and planned[0].first <= low and planned[-1].after >= high):
            raise IntegrityError(f"{self.path}: sequences of [{low}, {high}) are missing")
        return planned

    def read(self, partition: SegmentPartition) -> Iterator[tuple]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        done = end["sequence"]
        self.at = max(self.at or 0, done)
        if self.most:
            os.makedirs(f"{self.path}.metadata", exist_ok=True)
            with open(f"{self._acknowledged()}.new", "w") as f:
                f.write(str(done))
                f.flush()
                os.fsync(f.fileno())
            os.replace(f"{self._acknowledged()}.new", self._acknowledged())
        if self.reclaim:
            files = segment_files(self.path)
            for (_, file), (after, _) in pairwise(files):
                if after <= done:
                    os.remove(file)


@dataclass
class Written(WriterCommitMessage):
    segments: list


class JournalWriter(DataSourceWriter):
    """Each task writes the captures it holds as segments under temporary names; commit checks that sequences follow on and names them.

    Mode append goes on where the journal ends and refuses any other sequence; overwrite replaces it. Files are forced to
    storage before they get their names. Rows must be range-partitioned and sorted by (sequence, op_idx); see write_captures.
    """

    def __init__(self, options: dict, overwrite: bool = False) -> None:
        self.path, self.most, self.overwrite = options["path"], int(options.get("segmentbytes", MOST_SEGMENT)), overwrite

    def write(self, rows: Iterator) -> Written:
        import uuid

        os.makedirs(f"{self.path}.segments", exist_ok=True)
        done, current, first, last = [], None, None, None

        def finish() -> None:
            current.flush()
            os.fsync(current.fileno())
            current.close()
            done.append((first, last, current.name))

        def put(sequence: int, kind: str, ops: list[Op]) -> None:
            nonlocal current, first, last
            data = frame(sequence, encode_batch(CHECKPOINT if kind == "checkpoint" else INCREMENTAL, ops))
            if current and current.tell() + len(data) > self.most:
                finish()
                current = None
            if current is None:
                current, first = open(f"{self.path}.segments/.{uuid.uuid4().hex}", "wb"), sequence  # noqa: SIM115
                current.write(segment_header(sequence))
            current.write(data)
            last = sequence

        batch: list[Op] = []
        at = None
        for r in rows:
            if at is not None and r.sequence != at[0]:
                put(*at, batch)
                batch = []
            at = (r.sequence, r.kind)
            if r.op == "release":
                batch.append(Op(r.segment, r.slot, r.generation, True))
            else:
                batch.append(Op(r.segment, r.slot, r.generation, False, r.layout_identity, r.layout_version, int(r.version), bytes(r.image)))
        if at is not None:
            put(*at, batch)
            finish()
        return Written(done)

    def commit(self, messages: list) -> None:
        segments = sorted(s for m in messages if m for s in m.segments)
        held = segment_files(self.path)
        want = segment_end(held[-1][1])[1] if held and not self.overwrite else segments[0][0] if segments else 1
        for first, last, _ in segments:
            if first != want:
                self.abort(messages)
                raise IntegrityError(f"sequence {want} is missing" if first > want else f"sequence {first} is there already")
            want = last + 1
        for _, file in held if self.overwrite else ():
            os.remove(file)
        for first, _, name in segments:
            os.link(name, f"{self.path}.segments/segment-{first:016d}.psjs")  # unlike a rename, never onto another segment
            os.remove(name)
        if segments:
            folder = os.open(f"{self.path}.segments", os.O_RDONLY)
            os.fsync(folder)
            os.close(folder)

    def abort(self, messages: list) -> None:
        for m in messages:
            for _, _, name in m.segments if m else []:
                if os.path.exists(name):
                    os.remove(name)


class CaptureJournal(DataSource):
    """Format ``capture_journal``; option path. The path must be on storage that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "capture_journal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> JournalReader:
        return JournalReader(self.options)

    def streamReader(self, schema) -> JournalStreamReader:  # noqa: N802
        return JournalStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> JournalWriter:
        return JournalWriter(self.options, overwrite)


def write_captures(captures, path: str, partitions: int | None = None, mode: str = "append") -> None:
    """Captures as a binary journal, in sequence order, by default in as many tasks as the session shuffles to; a sequence is never split."""
    partitions = partitions or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    captures.sparkSession.dataSource.register(CaptureJournal)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    ordered = captures.select(*columns).repartitionByRange(partitions, "sequence").sortWithinPartitions("sequence", "op_idx")
    ordered.write.format("capture_journal").mode(mode).option("path", path).save()


def read_captures(spark, path: str, low: int = 0, high: int = 1 << 62):
    spark.dataSource.register(CaptureJournal)
    return spark.read.format("capture_journal").option("path", path).option("from", str(low)).option("to", str(high)).load()
