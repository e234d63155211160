"""Packing documents into token sequences along a Hilbert curve.

Each document's token ids give a hashed vector, projected to a few dimensions by a fixed random table and put on a grid;
its place on the Hilbert curve through that grid is the sort key, so neighbours on the curve use similar words. The curve is
cut into ranges that hold about as many bytes of tokens each, whatever the session's partitions; a cell of the curve with more
than a range's bytes is dealt by a hash of id and tokens. Each range is sorted by (key, hash), long documents in parts, and cut
into sequences of ``length`` tokens. Only a range's last sequence can be short: what is left is cut into sequences whose lengths
are powers of two, which need no padding. Ranges follow from exact sums, so reruns give the same sequences.

Tokens: the tokenizer's ids of the whole text, then the end id. Where the normaliser and pre-tokenizer are known never to look
across white space, words between ASCII white space are encoded once and remembered, and plain words go through a faster
encoder with the same vocabulary if that gives the same ids (see ``load``). Any other tokenizer gets whole texts.

Results for special input: null and empty texts are the end id alone; ids, null or repeated, are passed through, each row
packed on its own; an empty table gives an empty result; other columns are ignored; ties on the curve go by a hash of the id and tokens, then the id; rows with equal id and tokens are alike.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, durable, need, partitions, returning, slices

DIMENSIONS, BITS = 4, 12
#: Documents whose words are held at once.
SLICE = 125
#: Documents are sorted in parts of at most PART tokens, in ranges of the curve of about RANGE_BYTES of tokens, found from the bytes in 2 ** CELLS cells of it.
PART, RANGE_BYTES, CELLS = 8192, 64 << 20, 16


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of small non-negative integers.

    Works down from the highest bit: every step undoes the reflection and the exchange of axes that the curve applies in
    the orthant reached so far; what remains is the curve index in Gray code, bit by bit over the axes.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


#: How the lower-casing word tokenizer prepares text. Only for one that does so, plain words take the short way.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Letters of lower-case ASCII and of Latin-1, at most LONGEST bytes: preparing them is lower case only, in one piece.
_PLAIN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")
LONGEST = 64


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(1)
def load(path: str):
    """The tokenizer at path, which ids end a word, whether it prepares text as known, and where possible a faster encoder of the same ids for plain words, each followed by a space.

    The encoder is tiktoken's over the same vocabulary, the end of a word written as a space. It merges whatever two parts
    make the entry of least id, while the tokenizer merges by its list of pairs. Both give the same ids if ids rise along
    that list and follow those of all bytes: an entry is made by one pair only, and where no merge crosses its ends, its
    bytes merge as they do alone. Where this does not hold there is no such encoder.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids, model, fast = t.get_vocab(), json.loads(t.to_str())["model"], None
    end = model.get("end_of_word_suffix")
    by_words = _prepares_as_known(t)
    if model["type"] == "BPE" and end and not (model["dropout"] or model["continuing_subword_prefix"]) and by_words:
        alphabet = _byte_alphabet()
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        entries = [*(c + e for c in alphabet for e in ("", end)), *(a + b for a, b in pairs)]
        singles, order = 2 * len(alphabet), [model["vocab"].get(w, -1) for w in entries]
        if min(order) >= 0 and all(x < y for x, y in pairwise([max(order[:singles]), *order[singles:]])):
            import tiktoken

            as_bytes = lambda w: bytes(alphabet[c] for c in w.removesuffix(end)) + (b" " if w.endswith(end) else b"")
            ranks = {as_bytes(w): i for w, i in zip(entries, order, strict=True)}
            if len(ranks) == len(entries):
                fast = tiktoken.Encoding("words", pat_str="[^ ]++ ", mergeable_ranks=ranks, special_tokens={})
    last = np.zeros(max(ids.values()) + 1, bool)
    last[[i for w, i in ids.items() if end and w.endswith(end)]] = True
    return t, last, fast, by_words


def _prepares_as_known(t) -> bool:
    """Whether t prepares text by NORMALIZERS and PATTERN, byte by byte."""
    if not (t.normalizer and t.pre_tokenizer):
        return False
    first, second = (json.loads(x.__getstate__()) for x in (t.normalizer, t.pre_tokenizer))
    steps = second.get("pretokenizers", [])
    return (
        first.get("normalizers") == NORMALIZERS
        and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": PATTERN}, "Removed", True)
        and (steps[1]["add_prefix_space"], steps[1]["use_regex"]) == (False, False)
    )


class WordTokens(dict):
    """Word -> its ids as little-endian unsigned 16-bit bytes (32-bit if the vocabulary is larger).

    Remembered in two generations of up to LIMIT entries of REMEMBERED bytes at most: when one is full it becomes the older one,
    and words that are seen again move on, so frequent words stay and memory is bounded. Longer words are known until the next
    texts. Looking up a word that is not known gives None and notes it; ``learn`` encodes what was noted, many at a time.
    """

    LIMIT = 250_000
    TOGETHER = 4096

    def __init__(self, path: str) -> None:
        self.tokenizer, self.last, self.fast, self.by_words = load(path)
        self.passing: dict[bytes, bytes] = {}
        self.kind = np.dtype("<u2" if len(self.last) <= 65536 else "<u4")
        self.older: dict[bytes, bytes] = {}
        self.new: set[bytes] = set()

    def __missing__(self, word: bytes) -> bytes | None:
        ids = self.older.get(word)
        if ids is not None:
            self[word] = ids
        elif (ids := self.passing.get(word)) is None:
            self.new.add(word)
        return ids

    def turn(self) -> None:
        """Forget long words, and start a new generation if this one is full."""
        self.passing.clear()
        if len(self) > self.LIMIT:
            self.older = dict(self)
            self.clear()

    def learn(self) -> None:
        """Encode the noted words."""
        plain, other = [], []
        for w in self.new:
            short = self.fast and len(w) <= LONGEST and ((w.isalpha() and w.islower()) or _PLAIN.fullmatch(w))
            (plain if short else other).append(w)
        width = self.kind.itemsize
        for s in range(0, len(plain), self.TOGETHER):
            part = plain[s : s + self.TOGETHER]
            ids = np.array(self.fast.encode_ordinary(b" ".join([*part, b""]).decode().lower()), self.kind)
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, ((np.flatnonzero(self.last[ids]) + 1) * width).tolist(), strict=True):
                self[w] = raw[start:end]
                start = end
        for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
            (self if len(w) <= REMEMBERED else self.passing)[w] = np.array(e.ids, self.kind).tobytes()
        self.new.clear()


_ENDING = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[a-z0-9].)|(?<=\xc3[\xa0-\xb6\xb8-\xbf].))[!-&(-/:-@\[-`{-~]*(?=[ \n])")


_WORD = re.compile(rb"[^ \t-\r]++")


def lowered(raw: bytes) -> bytes:
    """raw with its ASCII capitals in lower case, but in words that hold a combining mark (U+0300 to U+036F, the only ones that compose with ASCII letters).

    The tokenizer composes before it lowers case, and some marks compose with the lower-case letter only.
    """
    low = raw.lower()
    if b"\xcc" not in raw and b"\xcd" not in raw:
        return low
    out = bytearray(low)
    for m in _WORD.finditer(raw):
        if b"\xcc" in m[0] or b"\xcd" in m[0]:
            out[m.start() : m.end()] = m[0]
    return bytes(out)


def split(raw: bytes | None) -> list[bytes]:
    """Parts of a UTF-8 text that the tokenizer encodes on their own: words between ASCII white space, mostly in lower case, closing punctuation apart.

    The tokenizer lowers case itself (see lowered), and splits a letter or digit from punctuation (but for apostrophes), so the ids are the
    same and fewer words are new. Texts that may hold special tokens stay as they are, as those are matched in the raw text.
    """
    raw = raw or b""
    return raw.split() if b"<|" in raw else _ENDING.sub(rb" \g<0>", lowered(raw)).split()


def encode(texts: list[bytes | None], known: WordTokens, end_id: int) -> list[bytes]:
    """Ids of each text, with the end id, as bytes."""
    known.turn()
    end, found = np.array([end_id], known.kind).tobytes(), []
    if not known.by_words:
        return [np.array(e.ids, known.kind).tobytes() + end for e in known.tokenizer.encode_batch_fast([(t or b"").decode() for t in texts], add_special_tokens=False)]
    for t in texts:
        words = split(t)
        ids = list(map(known.__getitem__, words))
        found.append((ids, [(i, words[i]) for i, x in enumerate(ids) if x is None]))
    known.learn()
    out = []
    for ids, gaps in found:
        for i, w in gaps:
            ids[i] = known[w]
        ids.append(end)
        out.append(b"".join(ids))
    return out


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, seed: int = 3) -> DataFrame:
    """Id, Hilbert key, token bytes and their width."""
    source = need(docs, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTokens(tokenizer_path)
        table = np.random.default_rng(seed).normal(0, 1, (1 << 16, DIMENSIONS)).astype(np.float32)
        side, ones = 1 << BITS, np.ones(65536, np.float32)
        for big in slices(batches):
            for s in range(0, len(big), SLICE):
                batch = big.slice(s, SLICE)
                ids = encode(batch.column(1).cast(pa.binary()).to_pylist(), known, end_id)
                spots = np.empty((len(ids), DIMENSIONS), np.float32)
                for i, raw in enumerate(ids):
                    x = np.frombuffer(raw, known.kind)
                    v = sum(ones[: len(x) - k] @ table.take(x[k : k + 65536] & 0xFFFF, axis=0) for k in range(0, len(x), 65536))
                    spots[i] = 4 * v / len(x)
                grid = np.clip((np.arctan(spots) / np.pi + 0.5) * side, 0, side - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(hilbert(grid)), pa.array(ids, pa.binary()), pa.array([known.kind.itemsize] * len(ids), pa.int32())],
                    [id_col, "curve", "ids", "width"],
                )

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(returning(scan), f"`{id_col}` {kind}, curve long, ids binary, width int")


def parts(ready: DataFrame) -> DataFrame:
    """Rows of PART tokens at most: the id, ``curve``, ``tie`` (a hash of id and tokens), ``start`` (first token), ``ids`` and ``doc_tokens``."""
    total = F.floor(F.octet_length("ids") / F.col("width")).cast("long")
    rest = [c for c in ready.columns if c not in ("ids", "width", "curve")]
    tied = ready.select(*rest, "curve", F.xxhash64(*rest, "ids").alias("tie"), "ids", "width", total.alias("doc_tokens"))
    each = tied.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(PART).cast("long"))))
    return each.withColumn("ids", F.substr("ids", (F.col("start") * F.col("width") + 1).cast("int"), F.col("width") * PART))


def ranged(rows: DataFrame, ready: DataFrame) -> tuple[DataFrame, int]:
    """rows with ``range``, the number of their range of the curve, and the number of ranges."""
    cell = F.shiftright("curve", DIMENSIONS * BITS - CELLS)
    sums = sorted(ready.groupBy(cell).agg(F.sum(F.octet_length("ids"))).collect())  # 2 ** CELLS rows at most
    total, before, cells = sum(n for _, n in sums), 0, []
    count = max(1, -(-total // RANGE_BYTES), min(partitions(ready.sparkSession), total // (1 << 20)))
    for c, n in sums:
        first, last = before * count // total, (before + n - 1) * count // total
        cells.append((c, first, last - first + 1))
        before += n
    cells = ready.sparkSession.createDataFrame(cells, "cell long, first long, wide long")
    return rows.join(F.broadcast(cells), cell == F.col("cell")).withColumn("range", F.col("first") + F.pmod(F.col("tie"), F.col("wide"))).drop("cell", "first", "wide"), count


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    ready = durable(tokenized(docs, tokenizer_path, end_id, id_col, text_col))
    rows, ranges = ranged(parts(ready), ready)
    ordered = rows.repartitionByRange(ranges, "range").sortWithinPartitions("range", "curve", "tie", id_col, "start")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = sequence = at = 0
        open_rows: list[list] = []  # the pieces of the sequence that is being filled; ids as lists of arrays
        within = previous = id_type = None

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        def rest() -> list[list]:
            """The pieces of the open sequence, in sequences whose lengths are powers of two."""
            out, left, number, at_ = [], at, sequence, 0
            room = 1 << (left.bit_length() - 1) if left else 0
            for doc, start, n, held, total, _, _ in open_rows:
                x, used = np.concatenate(held), 0
                while used < n:
                    m = min(room - at_, n - used)
                    out.append([doc, start + used, m, x[used : used + m].tobytes(), total, base + number, at_])
                    used, at_ = used + m, at_ + m
                    if at_ == room:
                        left -= room
                        at_, number, room = 0, number + 1, 1 << max(0, left.bit_length() - 1)
            return out

        for batch in slices(batches):
            id_type, done = batch.schema.field(0).type, []
            for doc, range_, tie, first, raw, width, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if range_ != within:
                    done += rest()
                    within, base, sequence, at, open_rows = range_, range_ << 40, 0, 0, []
                x = np.frombuffer(raw, f"<u{width}").astype("<u4")
                used, follows = 0, open_rows and previous == (doc, tie, first, total)
                while used < len(x):
                    n = min(length - at, len(x) - used)
                    if follows:  # the next part of the document that was cut off last
                        open_rows[-1][2] += n
                        open_rows[-1][3].append(x[used : used + n])
                    else:
                        open_rows.append([doc, first + used, n, [x[used : used + n]], total, base + sequence, at])
                    used, at, follows = used + n, at + n, False
                    if at == length:
                        done += [[*r[:3], np.concatenate(r[3]).tobytes(), *r[4:]] for r in open_rows]
                        open_rows, at, sequence = [], 0, sequence + 1
                previous = (doc, tie, first + len(x), total)
            if done:
                yield batch_of(done)
        if last := rest():
            yield batch_of(last)

    return ordered.select(id_col, "range", "tie", "start", "ids", "width", "doc_tokens").mapInArrow(returning(cut), f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    packed = pack(docs, tokenizer_path)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
