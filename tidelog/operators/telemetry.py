"""Inputs and measurements of a high-rate source: simulation, pacing, bursts, rates, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TICK_CAP = 32_768


def simulate(spark: SparkSession, ticks: int, sensors: int = 24, seed: int | None = 7) -> DataFrame:
    """Sine and cosine readings of sensors with noise (none if seed is None) and status flags: 1 hot, 2 low pressure, 4 about one in 80."""
    noise = (lambda k: F.rand(seed + k) - 0.5) if seed is not None else (lambda k: F.lit(0.0))
    base = spark.range(ticks * sensors).select(F.call_function("div", F.col("id"), F.lit(sensors)).alias("tick"), (F.col("id") % sensors).alias("rec"), F.col("id").alias("seq"))
    phase = F.col("tick") * 0.05 + F.col("rec") * 0.7
    read = base.select("*", (24 + 5 * F.sin(phase) + noise(0)).alias("temperature"), (1 + 0.08 * F.cos(phase * 0.6) + 0.01 * noise(1)).alias("pressure"))
    rare = F.pmod(F.xxhash64("seq"), F.lit(80)) == 0
    status = (F.col("temperature") > 28.5).cast("int").bitwiseOR(F.shiftleft((F.col("pressure") < 0.93).cast("int"), 1)).bitwiseOR(F.shiftleft(rare.cast("int"), 2))
    return read.withColumn("status", status)


def paced(ticks: DataFrame, rate: int, cap: int = TICK_CAP) -> DataFrame:
    """ticks: source, ord, micros elapsed. Requested updates per tick with the fraction carried over, accepted up to cap, the rest dropped.

    The carry is what a running sum of elapsed * rate leaves modulo a million, so no fold is needed.
    """
    w = Window.partitionBy("source").orderBy("ord")
    total = F.sum(F.col("micros").cast("long") * F.lit(rate).cast("long")).over(w)
    whole = F.call_function("div", total, F.lit(1_000_000)).cast("long")  # a quotient of doubles is wrong beyond 2**53
    asked = ticks.withColumn("_whole", whole)
    asked = asked.withColumn("requested", F.col("_whole") - F.coalesce(F.lag("_whole").over(w), F.lit(0)))
    return asked.drop("_whole").withColumn("accepted", F.least("requested", F.lit(cap))).withColumn("dropped", F.col("requested") - F.col("accepted"))


def bursts(inputs: DataFrame, tick: str, order: str, transactions: int) -> DataFrame:
    """Which of a tick's transactions each input belongs to: chunks differ by one at most, small ones first."""
    w = Window.partitionBy(tick)
    n = F.count("*").over(w)
    r = F.row_number().over(w.orderBy(order))
    k = F.least(n, F.lit(transactions))
    small = (n / k).cast("long")
    few = k - n % k  # chunks of the small size
    chunk = F.when(r <= few * small, F.ceil(r / small)).otherwise(few + F.ceil((r - few * small) / (small + 1)))
    return inputs.withColumn("chunk", chunk.cast("long"))


def compaction(raw: DataFrame, commits: DataFrame, epoch: str) -> DataFrame:
    """Per epoch: inputs, commits, and inputs that became part of another commit."""
    a = raw.groupBy(epoch).agg(F.count("*").alias("inputs"))
    b = commits.groupBy(epoch).agg(F.count("*").alias("commits"))
    out = a.join(b, epoch, "left").na.fill(0, ["commits"])
    return out.withColumn("compacted", F.greatest(F.lit(0), F.col("inputs") - F.col("commits")).cast("long"))


def rate_per_second(inputs: DataFrame, epoch: str, micros: int) -> DataFrame:
    """Updates per second of each sample of so many microseconds."""
    return inputs.groupBy(epoch).agg((F.count("*") * 1_000_000 / micros).cast("double").alias("rate"))


def history(samples: DataFrame, capacity: int, order: str, values: list[str]) -> DataFrame:
    """The last samples of each record, oldest first as pos 1, 2, ..."""
    w = Window.partitionBy("rec")
    newest = samples.select("rec", order, *values).withColumn("_n", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("_n") <= capacity)
    return newest.withColumn("pos", (F.max("_n").over(w) + 1 - F.col("_n")).cast("long")).drop("_n")
