"""Removal of repeated word windows, with difference-cover anchors.

A window is ``WINDOW`` consecutive words. Only the short anchors at positions p of a document with p mod PERIOD in COVER
are hashed for the first search. COVER is a difference cover: for any two positions i, j there is a shift below PERIOD
that brings both onto the cover, so two equal windows always hold one equal anchor at the same place inside them. Anchors
that occur once are done with; around the others the search extends to the full windows that hold them, and of each full
window the first occurrence (smallest document, then start) is found. All other occurrences are removed.

Documents are dealt to batches by a hash of id, text and input partition, so neither an id, null or not, nor copies of a row fill
a batch; a batch sends each of its distinct hashes once, with its first occurrence, as packed arrays by hash range, and gets
back one bit for each. So a passage that many documents share costs a batch one entry, no pair of occurrences is ever formed, and
no hash has more rows than there are batches. Anchors have hashes of 64 bits, as they only name candidates. Windows are equal if
two hashes of 64 and 32 bits, by unlike functions of their words' hashes, are: among 10^13 windows two that differ are taken for
equal with a probability of about 10^-3.

Results for special input: null and empty texts have no words; null ids sort before all others; rows that share an id, null or not,
are documents of their own, in order of a hash of text and input partition, copies among them too; an empty table gives an empty
result; other columns are ignored. Ids must be integers: others are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, need, partitions, whole_ids

WINDOW, PERIOD, COVER, ANCHOR = 20, 13, (0, 1, 3, 9), 8
assert ANCHOR + PERIOD - 1 <= WINDOW and {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))

#: Bytes of text in a batch, on average, and the most documents; bytes of text for each hash range.
BATCH_BYTES, BATCH_DOCS, SHARD_BYTES = 4_000_000, 5000, 64 << 20
#: An odd factor for the windows' second hash.
_FACTOR = 0xD6E8FEB86659FD93
_ON = np.isin(np.arange(PERIOD), COVER)
_NULL_ID = -(1 << 63)


def fold(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all anchors and of all windows of a run of word hashes, by doubling."""
    two = mix(h[:-1], h[1:])
    four = mix(two[:-2], two[2:])
    eight = mix(four[:-4], four[4:])
    sixteen = mix(eight[:-8], eight[8:])
    return eight, mix(sixteen[: len(h) - WINDOW + 1], four[16:][: len(h) - WINDOW + 1])


def second(h: np.ndarray) -> np.ndarray:
    """32-bit hashes of all windows of a run of word hashes, as polynomials, by doubling."""
    power = lambda n: np.uint64(pow(_FACTOR, n, 1 << 64))
    two = h[:-1] * power(1) + h[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    sixteen = eight[:-8] * power(8) + eight[8:]
    n = len(h) - WINDOW + 1
    return ((sixteen[:n] * power(4) + four[16:][:n]) >> np.uint64(32)).astype(np.uint32)


class Batch:
    """A batch of documents in order of id and tie, with its anchors and windows."""

    def __init__(self, t: pa.Table) -> None:
        ids = t["doc_id"].to_pylist()
        raws = t["text"].cast(pa.binary()).to_pylist()
        ties = t["tie"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, ties[i], raws[i] or b""))
        self.ids, self.ties = [ids[i] for i in order], np.array([ties[i] for i in order], np.int32)
        self.words = [(raws[i] or b"").split() for i in order]
        known = Words()
        self.hashes = [known.hashes(w) for w in self.words]
        self.long = [i for i, w in enumerate(self.words) if len(w) >= WINDOW]
        self.folded = {i: fold(self.hashes[i]) for i in self.long}

    def anchors(self) -> np.ndarray:
        """Hashes at cover positions, documents in order."""
        if not self.long:
            return np.empty(0, np.uint64)
        return np.concatenate([a[np.resize(_ON, len(a))] for a, _ in (self.folded[i] for i in self.long)])

    def candidates(self, repeated: np.ndarray) -> Windows:
        """The windows that hold a repeated anchor. repeated: flags for anchors()."""
        found, at = [], 0
        for i in self.long:
            a, w = self.folded[i]
            on = np.flatnonzero(np.resize(_ON, len(a)))
            flags = repeated[at : at + len(on)]
            at += len(on)
            if not flags.any():
                continue
            mark = np.zeros(len(a) + 1, np.int32)
            p = on[flags]
            np.add.at(mark, np.maximum(p - (WINDOW - ANCHOR), 0), 1)
            np.add.at(mark, np.minimum(p + 1, len(a)), -1)
            s = np.flatnonzero(np.cumsum(mark)[: len(w)] > 0)
            found.append((w[s], second(self.hashes[i])[s], np.full(len(s), i, np.int32), s.astype(np.int32)))
        if not found:
            return Windows(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32))
        return Windows(*map(np.concatenate, zip(*found, strict=True)))


def in_order(h: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (h, low), and for each place in it whether a new pair begins."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], low[order]
    same, differs = a[1:] == a[:-1], b[1:] != b[:-1]
    if (same & differs).any():  # 64 bits agree by chance
        order = np.lexsort((low, h))
        a, b = h[order], low[order]
        same, differs = a[1:] == a[:-1], b[1:] != b[:-1]
    return order, np.concatenate([[True], ~same | differs])[: len(h)]


class Windows:
    """Candidate windows of a batch, documents and starts ascending; ``first`` are the first of each distinct one, in order of their hashes."""

    def __init__(self, h: np.ndarray, low: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> None:
        self.h, self.low, self.docs, self.starts = h, low, docs, starts
        order, new = in_order(h, low)
        self.first = order[new]


_SENT = "batch int, shard int, hashes binary, lows binary, docs binary, ties binary, starts binary"
_BACK = "batch int, shard int, bits binary"


def _shard(values: np.ndarray, bits: int) -> np.ndarray:
    """The hash range, of 2 ** bits ones, of each value."""
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def _send(batch: int, bits: int, values: np.ndarray, *more: np.ndarray) -> pa.Table:
    """One row for each range that has values (sorted); more: the arrays beside hashes in _SENT, or none."""
    shard = _shard(values, bits)
    begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])[: len(shard)])
    cut = list(zip(begin.tolist(), [*begin[1:].tolist(), len(shard)], strict=True)) if len(begin) else []
    part = lambda x: pa.array([x[a:b].tobytes() for a, b in cut], pa.binary())
    names = ("lows", "docs", "ties", "starts")
    rest = dict(zip(names, map(part, more), strict=True)) if more else {n: pa.array([b""] * len(cut), pa.binary()) for n in names}
    return pa.table({"batch": pa.array([batch] * len(cut), pa.int32()), "shard": pa.array(shard[begin].astype(np.int32)), "hashes": part(values), **rest})


def _judge(t: pa.Table) -> pa.Table:
    """For one hash range: by batch, a bit for each of its hashes. Anchors: whether another batch has the hash. Windows: whether an earlier occurrence is elsewhere."""
    joined = lambda name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind)
    h, low = joined("hashes", np.uint64), joined("lows", np.uint32)
    sizes = [len(x) // 8 for x in t["hashes"].to_pylist()]
    flag = np.zeros(len(h), bool)
    if len(low):
        where = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((where, joined("starts", np.int32), joined("ties", np.int32), joined("docs", np.int64), low, h))
        a, b = h[order], low[order]
        flag[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    else:
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        flag[order[1:]] = same
        flag[order[:-1]] |= same
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bits = [np.packbits(flag[ends[k] : ends[k + 1]]).tobytes() for k in range(len(sizes))]
    return pa.table({"batch": t["batch"], "shard": t["shard"], "bits": pa.array(bits, pa.binary())})


def _flags(back: pa.Table, values: np.ndarray, bits: int) -> np.ndarray:
    """The bits of all hash ranges, put together in order of values."""
    shard, flag = _shard(values, bits), np.zeros(len(values), bool)
    asked = np.asarray(back["shard"])
    for a, b, raw in zip(np.searchsorted(shard, asked, "left").tolist(), np.searchsorted(shard, asked, "right").tolist(), back["bits"].to_pylist(), strict=True):
        flag[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
    return flag


def _number(t: pa.Table) -> int:
    return t["batch"][0].as_py()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    source = need(docs, id_col, text_col).select(whole_ids(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs_n, size = source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_batches = max(1, -(-docs_n // BATCH_DOCS), -(-size // batch_bytes))
    parts = max(partitions(spark), 1)
    bits = max(16, 2 * parts, size // SHARD_BYTES).bit_length()
    spread = F.spark_partition_id()
    dealt = source.select(F.pmod(F.xxhash64("doc_id", "text", spread), F.lit(n_batches)).cast("int").alias("batch"), "doc_id", F.hash("text", spread).alias("tie"), "text").repartition(parts, "batch")

    def send_anchors(t: pa.Table) -> pa.Table:
        return _send(_number(t), bits, np.unique(Batch(t).anchors()))

    def repeated(b: Batch, back: pa.Table) -> np.ndarray:
        a = b.anchors()
        values, inverse, count = np.unique(a, return_inverse=True, return_counts=True)
        return (_flags(back, values, bits) | (count > 1))[inverse]

    def send_windows(t: pa.Table, back: pa.Table) -> pa.Table:
        if not len(t):
            return _send(0, bits, np.empty(0, np.uint64))
        b = Batch(t)
        w = b.candidates(repeated(b, back))
        ids = np.array([_NULL_ID if x is None else x for x in b.ids], np.int64)
        at = w.docs[w.first]
        return _send(_number(t), bits, w.h[w.first], w.low[w.first], ids[at], b.ties[at], w.starts[w.first])

    def finish(t: pa.Table, back: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        b = Batch(t)
        kind = np.asarray(back["kind"])
        w = b.candidates(repeated(b, back.filter(pa.array(kind == 0))))
        gone = np.ones(len(w.h), bool)
        gone[w.first] = _flags(back.filter(pa.array(kind == 1)), w.h[w.first], bits)
        d, s = w.docs, w.starts
        n_removed, kept = [], []
        by = np.searchsorted(d, np.arange(len(b.ids) + 1))
        for i, words in enumerate(b.words):
            starts = s[by[i] : by[i + 1]][gone[by[i] : by[i + 1]]]
            if not len(starts):
                n_removed.append(0)
                kept.append(b" ".join(words))
                continue
            cover = np.zeros(len(words) + 1, np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            stays = np.cumsum(cover)[:-1] == 0
            n_removed.append(int(len(words) - stays.sum()))
            kept.append(b" ".join([words[j] for j in np.flatnonzero(stays)]))
        return pa.table(
            {
                "doc_id": pa.array(b.ids, pa.int64()),
                "n_words": pa.array([len(w) for w in b.words], pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    by_batch = dealt.groupBy("batch")
    anchors = by_batch.applyInArrow(send_anchors, _SENT)
    anchor_bits = anchors.groupBy("shard").applyInArrow(_judge, _BACK)
    sent = by_batch.cogroup(anchor_bits.groupBy("batch")).applyInArrow(send_windows, _SENT)
    window_bits = sent.groupBy("shard").applyInArrow(_judge, _BACK)
    back = anchor_bits.withColumn("kind", F.lit(0)).unionByName(window_bits.withColumn("kind", F.lit(1)))
    out = by_batch.cogroup(back.groupBy("batch")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
