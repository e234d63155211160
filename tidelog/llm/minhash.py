"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles as 64-bit hashes. Two permutations of a domain of D places give the whole
signature: sigma scatters a shingle's place, and coordinate k is the smallest pi value at the scattered places, pi being
shifted circularly by k. Neighbouring coordinates are neighbours in memory, so one gather of a row of pi serves a shingle.

Documents with equal sets are one node from the start. Signature bands are buckets; verification compares full sets.
Within a bucket all nodes are first compared with the bucket's smallest, which links most of a large group in linear work.
In buckets that still hold more than one component, all pairs whose ends are in different components and whose set sizes
allow the similarity are compared. In small buckets they are compared as rows. The nodes of large ones are first sifted: with
the hashes of each set in order of how many of these nodes hold them, rarest first, two sets that are similar enough share one
of the first ninth of the smaller and one of the first fifth of the larger (at 80 %). Documents that share boilerplate and have
their own rest meet nowhere then. What still shares such a hash is compared, as rows where few nodes share it, else within tasks
that each get two blocks of these nodes, bounded in nodes and bytes, count all intersections by one matrix product over the hashes
that both blocks hold, and return a spanning forest of the links. So no candidate is left out, no bucket meets in one task, and
large ones never become rows of pairs.

Results for special input: null text, or text without words, has an empty set and links with nothing; a null id links with
nothing (component null, kept); rows that share an id are one node with all their texts' links; an empty table gives an
empty result; other columns are ignored. Texts with fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, durable, mix, need, returning, slices
from .components import components

PLACES = 1 << 21
#: 40 bands of 6 coordinates: a pair at 0.8 is missed with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: Up to SMALL nodes are compared as rows; more in blocks of about BLOCK nodes, fewer if their sets have more than BLOCK_BYTES.
SMALL, BLOCK, BLOCK_BYTES = 32, 256, 8 << 20


def shingles(raw: bytes, words: Words, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text."""
    h = words.hashes(raw.lower().split())
    n = len(h)
    if not n:
        return h
    if n < width:
        s = h[:1] ^ np.uint64(n)
        for x in h[1:]:
            s = mix(s, np.array([x], np.uint64))
        return s
    s = h[: n - width + 1]
    for k in range(1, width):
        s = mix(s, h[k : n - width + 1 + k])
    return np.unique(s)


class Circulant:
    """sigma and pi, and the signature of a set of hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 29) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.sigma = rng.permutation(PLACES).astype(np.uint32)
        pi = rng.permutation(PLACES).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)

    def signature(self, s: np.ndarray) -> np.ndarray:
        at = self.sigma[s & np.uint64(PLACES - 1)]
        out = self.shifted[at[:1024]].min(axis=0)
        for i in range(1024, len(at), 1024):
            np.minimum(out, self.shifted[at[i : i + 1024]].min(axis=0), out=out)
        return out

    def band_hashes(self, s: np.ndarray) -> np.ndarray:
        """One 64-bit hash per band; the band's number is part of it."""
        b = self.signature(s).reshape(self.bands, self.rows).astype(np.uint64)
        h = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            h = mix(h, b[:, j] + np.uint64(1))
        return h.view(np.int64)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc, n (set size), fp (128-bit hash of the set) and bands."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, circulant = Words(), Circulant()
        for batch in slices(batches):
            n, fp, bands = [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles(raw or b"", words, width)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    bands.append(circulant.band_hashes(s))
            ends = np.concatenate([[0], np.cumsum(np.array(n) > 0) * BANDS]).astype(np.int32)
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc", "n", "fp", "bands"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(returning(scan), f"doc {kind}, n long, fp binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc and its full set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            sets = [shingles(raw or b"", words, width).view(np.int64) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["doc", "set"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(returning(scan), f"doc {kind}, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * |intersection| >= percent * |union|."""
    a = sets.select(F.col("doc").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("doc").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def forest(near: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix, the smallest node it is connected with."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None], len(label)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _by_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what the pairs of each large group connect. rows: bucket (the group), rep, n, comp, size (its nodes), held (the sum of their n)."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(8 * F.col("held") / BLOCK_BYTES)).cast("int")
    dealt = rows.join(sets.withColumnRenamed("doc", "rep"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "comp", "set")
    kind = rows.schema["rep"].dataType.simpleString()

    def compare(t: pa.Table) -> pa.Table:
        column = t["set"].combine_chunks()
        values, ends = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
        size, count = np.diff(ends), len(t)
        distinct, place, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1  # hashes of one node alone are in no intersection
        node = np.repeat(np.arange(count), size)
        on = times[place] > 1
        node, at = node[on], shared[place[on]]
        order = np.argsort(at, kind="stable")
        node, at = node[order], at[order]
        common = np.zeros((count, count), np.float32)
        for s in range(0, int(times[times > 1].size), 4096):
            lo, hi = np.searchsorted(at, [s, s + 4096])
            m = np.zeros((count, 4096), np.float32)
            m[node[lo:hi], at[lo:hi] - s] = 1
            common += m @ m.T
        near = 100 * common >= percent * (size[:, None] + size[None] - common)
        comp = np.asarray(t["comp"])
        label = forest(near | (comp[:, None] == comp[None]))
        rep = np.asarray(t["rep"])
        far = np.flatnonzero(comp != comp[label])
        return pa.table({"a": pa.array(rep[far], t["rep"].type), "b": pa.array(rep[label[far]], t["rep"].type)})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def sifted(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """nodes: rep, n, comp. Rows bucket (a hash), rep, n, comp, size, held of the nodes that share a hash of their prefixes, so that all similar pairs are in one.

    Hashes are ordered by the number of nodes that hold them, then by value. Of sets x and y, x not the larger one, that share
    at least percent / 100 of their union, x has a shared hash among its first n - ceil(2 percent n / (100 + percent)) + 1, and
    y among its first n - ceil(percent n / 100) + 1. Hashes that the same nodes have in their prefixes count once.
    """
    each = nodes.join(sets.withColumnRenamed("doc", "rep"), "rep").select("rep", "n", "comp", F.explode("set").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    order = F.sort_array(F.collect_list(F.struct("often", "token")))
    listed = each.join(common, "token").groupBy("rep", "n", "comp").agg(order.alias("order"))
    alone = F.col("n") - F.size("order")  # hashes that no other node has come first
    probe = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    index = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    first = F.slice("order", F.lit(1), F.greatest(probe - alone, F.lit(0)).cast("int"))
    held = listed.select("rep", "n", "comp", (index - alone).alias("index"), F.posexplode(first).alias("at", "entry")).select("rep", "n", "comp", (F.col("at") < F.col("index")).alias("small"), F.col("entry.token").alias("bucket"))
    held = durable(held)
    who = [F.bit_xor(F.xxhash64(F.lit(k), "rep", "small")).alias(f"who{k}") for k in range(2)]
    groups = held.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("held"), F.max("small").alias("any"), F.min("comp").alias("low"), F.max("comp").alias("high"), *who).where("size > 1 and any and low < high")
    groups = groups.groupBy("size", "held", "who0", "who1").agg(F.min("bucket").alias("bucket"))
    return held.join(groups.select("bucket", "size", "held"), "bucket").select("bucket", "rep", "n", "comp", "size", "held")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, hubs: int = 1) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    source = need(docs, id_col, text_col).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    signed = durable(_signed(source, width))
    first = durable(signed.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc").alias("rep")).where(F.col("rep").isNotNull()))
    nodes = signed.join(first.withColumnRenamed("fp", "f"), (F.col("fp") == F.col("f")) & (F.col("doc") == F.col("rep")))
    rows = nodes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    rows = durable(rows.join(shared, "bucket").distinct())  # all of every bucket that holds two nodes or more

    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    sets = durable(_sets(source.join(rows.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi"), width))
    links, tried = None, None
    comp = rows.select(F.col("rep").alias("node"), F.col("rep").alias("component")).distinct()
    for k in range(hubs):
        held = rows.join(comp, rows["rep"] == comp["node"], "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp")) if k else rows.withColumn("comp", F.col("rep"))
        order = F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), "rep", "n", "comp") if k else F.struct("rep", "n", "comp")
        hub = held.groupBy("bucket").agg(F.min(order).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        hub = hub.select("bucket", F.col("hub.rep").alias("c"), F.col("hub.n").alias("m"), F.col("hub.comp").alias("cc"))
        pairs = held.join(hub, "bucket").where((F.col("comp") != F.col("cc")) & fits).select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
        pairs = durable(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = durable(_verified(pairs, sets, percent))
        links = new if links is None else links.unionByName(new)
        comp = components(links)
    held = rows.join(comp, rows["rep"] == comp["node"], "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    split = held.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high").select("bucket", "size")
    held = durable(held.join(split, "bucket"))
    large = held.where(F.col("size") > SMALL).select("rep", "n", "comp").distinct()
    shared = durable(sifted(large, sets, percent))
    few = held.where(F.col("size") <= SMALL).select("bucket", "rep", "n", "comp").unionByName(shared.where(F.col("size") <= SMALL).select("bucket", "rep", "n", "comp"))
    other = few.select("bucket", F.col("rep").alias("c"), F.col("n").alias("m"), F.col("comp").alias("cc"))
    pairs = few.join(other, "bucket").where((F.col("comp") < F.col("cc")) & fits).select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
    rest = _verified(pairs.join(tried, ["a", "b"], "left_anti"), sets, percent)
    new = durable(rest.unionByName(_by_blocks(shared.where(F.col("size") > SMALL), sets, percent)))
    if not new.isEmpty():
        comp = components(links.unionByName(new))
    # rows that share an id join their texts' nodes
    label = first.join(comp, first["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    empty = signed.where(F.col("fp").isNull()).select("doc", "n", F.lit(None).cast(signed.schema["doc"].dataType).alias("component"))
    out = signed.where(F.col("fp").isNotNull()).select("doc", "n", "fp").join(label, "fp", "left").select("doc", "n", "component").unionByName(empty)
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, width=4)
