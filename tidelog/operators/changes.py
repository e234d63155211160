"""Net change: writes to versioned commits.

Input is a table of writes: ``rec`` (record key), ``txn``, ``seq`` (unique, ascending in commit order) and one column per
field, null meaning not written. A record starts as zeros with version 0. Per transaction and record, final values are
compared with the image before the transaction; equal fields are no change, and records without changes have no commit.

All steps share one hash partitioning by record: aggregation, image windows and version numbers need one exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import changed
from ..functions.layout import CustomField

Fields = dict[str, object]  # name: zero value


def _real(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("float", "double")


def _masked(im: DataFrame, names: list[str], custom: dict[str, CustomField] | None = None) -> DataFrame:
    """im with ``mask``, an int with the bits of the fields that differ; custom fields by their own test."""
    custom = custom or {}
    if len(names) > 31:
        raise ValueError("more than 31 fields: use wide_net_changes")
    test = lambda n: custom[n].differs(F.col(n), F.col(f"_p_{n}")) if n in custom else changed(F.col(n), F.col(f"_p_{n}"), _real(im, n))
    bits = [F.shiftleft(test(n).cast("int"), i) for i, n in enumerate(names)]
    return im.withColumn("mask", reduce(lambda a, b: a.bitwiseOR(b), bits))


def images(writes: DataFrame, fields: Fields, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Per (record, transaction): touch_seq, final values, and the values before as ``_p_<field>``."""
    names = list(fields)
    final = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in names]
    done = writes.select(*keys, "txn", "seq", *names).repartition(*keys).groupBy(*keys, "txn").agg(F.min("seq").alias("touch_seq"), *final)
    before = Window.partitionBy(*keys).orderBy("txn").rowsBetween(Window.unboundedPreceding, -1)
    zero = {n: F.lit(z).cast(writes.schema[n].dataType) for n, z in fields.items()}
    with_before = done.select("*", *(F.coalesce(F.last(n, ignorenulls=True).over(before), zero[n]).alias(f"_p_{n}") for n in names))
    return with_before.select(*keys, "txn", "touch_seq", *(F.coalesce(n, f"_p_{n}").alias(n) for n in names), *(F.col(f"_p_{n}") for n in names))


def net_changes(writes: DataFrame, fields: Fields, keys: tuple[str, ...] = ("rec",), custom: dict[str, CustomField] | None = None) -> DataFrame:
    """Commits: keys, txn, touch_seq, version, mask, final values. Order of commits: (txn, touch_seq). custom: fields, encoded, with an own test of change."""
    names = list(fields)
    im = images(writes, fields, keys)
    version = F.row_number().over(Window.partitionBy(*keys).orderBy("txn")).cast("long")
    return _masked(im, names, custom).where("mask <> 0").select(*keys, "txn", "touch_seq", version.alias("version"), "mask", *names)


def wide_net_changes(writes: DataFrame, fields: Fields, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Commits of a layout of any width: keys, txn, touch_seq, version, mask as 31-bit words; values are left to the writes.

    Fields become rows, so sparse writes cost what they hold, and no expression grows with the width. Values are compared in
    string form (binary: hex), which tells 0.0 from -0.0. One exchange, by record.
    """
    names = list(fields)
    text = lambda n: F.hex(n) if writes.schema[n].dataType.typeName() == "binary" else F.col(n).cast("string")
    zeros = F.array(*((F.hex(F.lit(z)) if isinstance(z, bytes) else F.lit(z).cast(writes.schema[n].dataType).cast("string")) for n, z in fields.items()))
    w = writes.select(*keys, "txn", "seq", F.array(*map(text, names)).alias("all")).repartition(*keys)
    cells = w.select(*keys, "txn", "seq", F.posexplode("all").alias("i", "value")).where("value is not null")
    last = cells.groupBy(*keys, "txn", "i").agg(F.max_by("value", "seq").alias("value"), F.min("seq").alias("seq"))
    before = F.lag("value").over(Window.partitionBy(*keys, "i").orderBy("txn"))
    moved = last.withColumn("moved", F.col("value") != F.coalesce(before, F.get(zeros, F.col("i"))))
    bit = F.call_function("shiftleft", F.lit(1), F.col("i") % 31)
    word = lambda k: F.bit_or(F.when(F.col("moved") & (F.floor(F.col("i") / 31) == k), bit).otherwise(0))
    words = F.array(*(word(k) for k in range(-(-len(names) // 31))))
    per = moved.groupBy(*keys, "txn").agg(F.min("seq").alias("touch_seq"), words.alias("mask")).where(F.exists("mask", lambda x: x != 0))
    return per.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy("txn")).cast("long"))


def net_zero(writes: DataFrame, fields: Fields, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """(keys, txn) whose writes changed nothing."""
    names = list(fields)
    im = images(writes, fields, keys)
    return _masked(im, names).where("mask = 0").select(*keys, "txn")


def provisional(writes: DataFrame, fields: Fields, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Per (record, transaction): the union of fields that a write altered, even if restored later in the transaction."""
    names = list(fields)
    before = Window.partitionBy(*keys).orderBy("txn", "seq").rowsBetween(Window.unboundedPreceding, -1)
    w = writes.select(*keys, "txn", "seq", *names).repartition(*keys)
    zero = {n: F.lit(z).cast(writes.schema[n].dataType) for n, z in fields.items()}
    w = w.select("*", *(F.coalesce(F.last(n, ignorenulls=True).over(before), zero[n]).alias(f"_p_{n}") for n in names))
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft((F.col(n).isNotNull() & changed(F.col(n), F.col(f"_p_{n}"), _real(writes, n))).cast("int"), i) for i, n in enumerate(names)])
    return w.groupBy(*keys, "txn").agg(F.bit_or(bits).alias("dirty")).where("dirty <> 0")


def scratch_high_water(writes: DataFrame, fields: Fields, record_bytes: int, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """One row: the most bytes of pre-images that a transaction holds, one record's for each record it altered, and how many transactions alter any."""
    per = provisional(writes, fields, keys).groupBy("txn").agg((F.count("*") * record_bytes).alias("held"))
    return per.agg(F.coalesce(F.max("held"), F.lit(0)).alias("high_water"), F.count("*").alias("transactions"))


def restored(writes: DataFrame, fields: Fields, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Fields that were altered and put back within a transaction."""
    net = net_changes(writes, fields, keys).select(*keys, "txn", "mask")
    both = provisional(writes, fields, keys).join(net, [*keys, "txn"], "left")
    out = F.col("dirty").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0))))
    return both.select(*keys, "txn", out.alias("restored")).where("restored <> 0")


def without_aborted(writes: DataFrame, aborted: DataFrame) -> DataFrame:
    """Writes of transactions that did not roll back; aborted has the column txn."""
    return writes.join(aborted.select("txn").distinct(), "txn", "left_anti")
