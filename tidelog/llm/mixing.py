"""Mixing sources to target weights by the cube method.

Every source gets a target number of words. A document of a source with target / size = r is taken floor(r) times, and
once more with probability r - floor(r). Those fractional probabilities are moved through the null space of two
constraints, the number of documents and the number of words (flight phase), until they are 0 or 1: three documents at
a time, along the one direction that changes neither total. Each chunk of a source leaves at most two undecided
documents; these meet in further flights, and the last two or fewer of a source are rounded so that the words fit best
(landing phase). Chunks are by a hash of the document, so a hot source is many chunks, and all choices are seeded: reruns agree.
Sources may be many: ranks, sizes and targets are columns of a table, and only sums over it reach the driver.

Results for special input: a null text has size 0 and is taken with 0 words; a null source is a source of its own, last in
order; null or repeated ids are separate documents; of more than CHUNK rows with one id and size, which are taken may differ if the input is cut
into other partitions; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, need, word_count

CHUNK = 1024
#: A table of sources or of frequent ties is broadcast up to so many rows; a longer one is joined.
BROADCAST_ROWS = 10_000
EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], most: float = 3.0) -> dict[str | None, float]:
    """Target words by source: weights 1, 2, 3, repeating, in code point order, null last; no target above most times the size. ``targeted`` is this on tables."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: 1 + i % 3 for i, (s, _) in enumerate(order)}
    size = dict(order)
    open_, out, rest = [s for s, _ in order], {}, float(sum(size.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > most * size[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * size[s]
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def flight(p: list[float], z: list[int], draw: random.Random) -> list[float]:
    """Move probabilities p, keeping their sum and the sum of p * z, until at most two are fractional."""
    p = list(p)
    queue = iter([i for i, x in enumerate(p) if EPS < x < 1 - EPS])
    live: list[int] = []
    while True:
        while len(live) < 3 and (i := next(queue, None)) is not None:
            live.append(i)
        if len(live) < 3:
            return p
        a, b, c = live
        u = (z[c] - z[b], z[a] - z[c], z[b] - z[a])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(live, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(live, u, strict=True) if v)
        step = up if draw.random() * (up + down) < down else -down
        for i, v in zip(live, u, strict=True):
            x = p[i] + step * v
            p[i] = 0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x
        live = [i for i in live if 0 < p[i] < 1]


def landing(p: list[float], z: list[int]) -> list[float]:
    """Round the last fractional probabilities (two at most) to the words that come nearest, then to the nearest count."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    best = None
    for bits in range(1 << len(left)):
        s = [float(bits >> k & 1) for k in range(len(left))]
        off = (abs(sum((v - p[i]) * z[i] for v, i in zip(s, left, strict=True))), abs(sum(s) - sum(p[i] for i in left)), bits)
        if best is None or off < best[0]:
            best = (off, s)
    p = list(p)
    for v, i in zip(best[1], left, strict=True):
        p[i] = v
    return p


def _round(units: DataFrame, chunks: str, last: bool, seed: int) -> DataFrame:
    """One flight over each (source, chunk); the last one lands too."""
    schema = units.schema

    def group(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tie", "ascending"), ("size", "ascending"), ("id", "ascending")])
        z, p = t["size"].to_pylist(), t["p"].to_pylist()
        source, chunk = t["source"][0].as_py(), t["chunk"][0].as_py()
        p = flight(p, z, random.Random(f"{seed}:{source}:{chunk}"))
        if last:
            p = landing(p, z)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).drop_columns(["chunk"])

    chunk = F.pmod(F.xxhash64("tie", F.lit(seed)), F.col(chunks)).alias("chunk")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return units.select("*", chunk).groupBy("source", "chunk").applyInArrow(group, fields)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies (how often it is taken).

    Documents are put in chunks and order by a hash of tie_cols, by default of id and size.
    """
    size = need(docs, *dict.fromkeys((id_col, source_col, text_col, *tie_cols)))
    sized = size.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *([F.xxhash64(*tie_cols).alias("tie")] if tie_cols else []))
    sized = durable(sized if tie_cols else sized.withColumn("tie", F.xxhash64("id", "size")))
    return mixed(sized, seed).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``place``, their number in code point order from 0, null last: sorted by ranges, each range numbered by itself."""
    order = (F.col("source").isNull(), F.col("source"))
    pieces = durable(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    piece = F.shiftright("at", 33)
    held = dict(pieces.groupBy(piece).count().collect())  # as many rows as partitions
    first, begin = [], 0
    for k in sorted(held):
        first.append((k, begin))
        begin += held[k]
    begins = sources.sparkSession.createDataFrame(first, "piece long, begin long")
    return pieces.join(F.broadcast(begins), piece == F.col("piece")).withColumn("place", F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "piece", "begin")


def targeted(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """``targets`` on a table of any length (source, source_size): with weight w, a target is the smaller of most * size and level * w.

    The level is that at which targets add up to all sizes. It only rises while sources above their bound are found, so it
    is found in as many rounds; a round sends two sums to the driver.
    """
    s = ranked(sources).withColumn("w", 1 + F.col("place") % 3)
    total, weight = s.agg(F.sum("source_size"), F.sum("w")).first()
    if not weight:
        return s.select("*", F.lit(0.0).alias("target"))
    level, bound = total / weight, F.lit(most) * F.col("source_size")
    while True:
        over = F.lit(level) * F.col("w") > bound
        held, open_ = s.agg(F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("w")))).first()
        risen = (total - most * held) / open_ if open_ else level
        if risen <= level:
            return s.withColumn("target", F.when(over, bound).otherwise(F.lit(level) * F.col("w")).cast("double")).drop("place", "w")
        level = risen


def mixed(sized: DataFrame, seed: int) -> DataFrame:
    """sized: id, source, size, tie. Ties that many rows share are split by row number, so that no chunk is much larger than CHUNK."""
    row = F.monotonically_increasing_id()  # sized is durable, so rows keep their numbers
    hot = durable(sized.groupBy("tie").count().where(F.col("count") > CHUNK).select(F.col("tie").alias("t"), F.ceil(F.col("count") / CHUNK).alias("parts")))
    n_hot = hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        split = F.xxhash64("tie", F.pmod(F.xxhash64("row"), F.col("parts")))
        sized = sized.withColumn("row", row).join(side, F.col("tie") == F.col("t"), "left").withColumn("tie", F.when(F.col("parts").isNotNull(), split).otherwise(F.col("tie"))).drop("row", "t", "parts")
    stats = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(rate + EPS)
    plan = targeted(stats).select(
        F.col("source").alias("s"), "source_size", "target", base.cast("int").alias("base"), F.greatest(F.lit(0.0), rate - base).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("rows") / CHUNK)).cast("long").alias("chunks")
    )
    plan = durable(plan)
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    units = sized.join(plan, sized["source"].eqNullSafe(plan["s"])).drop("s")
    open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    done, left = units.where(~open_), units.where(open_)
    most = plan.agg(F.max("chunks")).first()[0] or 1
    levels = 0
    while most > 1:  # each flight leaves two of a chunk at most, so the next needs a fraction of the chunks
        out = durable(_round(left, "chunks", False, seed + levels))
        done, left = done.unionByName(out.where(~open_)), out.where(open_)
        left = left.withColumn("chunks", F.greatest(F.lit(1), F.ceil(2 * F.col("chunks") / CHUNK)).cast("long"))
        most, levels = max(1, -(-2 * most // CHUNK)), levels + 1
    done = done.unionByName(_round(left, "chunks", True, seed + levels))
    return done.withColumn("copies", (F.col("base") + F.round("p").cast("int")).cast("long"))


def query(docs: DataFrame) -> DataFrame:
    m = mix_sources(docs)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
