"""Registered queries over the test tables, and their SQL.

Events are writes with rec = user_id, txn = event_id div 16, seq = event_id; line items are writes with rec = l_suppkey,
txn = l_orderkey; orders are lifecycle operations of rec = o_custkey (status F releases).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.layout import CustomField, Field, Layout
from ..operators import captures, changes, delivery, folds, journal, telemetry
from ..sources import journal as log
from ..sources.shared import new_path
from ..streaming import worker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CAPACITY, RING, SAMPLE, SEGMENT = 1000, 256, 64, 64
FIELDS = {"v": 0.0, "st": 0}
CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
HOUR_MICROS = 3_600_000_000


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet").select(*columns)


def hour_of(ts: str):
    """Hours since 1970 of a zoneless time stamp, whatever the session's time zone."""
    return (F.unix_date(F.col(ts).cast("date")).cast("long") * 24 + F.hour(ts)).cast("long")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "event_id", "user_id", "event_type", "value", "ts")
    code = F.lit(0)
    for name, n in CODES.items():
        code = F.when(F.col("event_type") == name, n).otherwise(code)
    return e.select(
        F.col("user_id").alias("rec"), F.floor(F.col("event_id") / 16).cast("long").alias("txn"), F.col("event_id").alias("seq"), F.col("value").alias("v"), code.cast("int").alias("st"), hour_of("ts").alias("hour")
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    seq = (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    return r.select(F.col("l_suppkey").alias("rec"), F.col("l_orderkey").alias("txn"), seq.alias("seq"), F.col("l_quantity").alias("v"), F.ascii("l_returnflag").cast("int").alias("st"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    return changes.net_changes(events(spark, d), FIELDS)


def subscriptions(spark: SparkSession, d: str, per_record: int = 8) -> DataFrame:
    recs = read(spark, d, "events", "user_id").distinct()
    return recs.select(F.col("user_id").alias("rec"), F.explode(F.sequence(F.lit(0), F.lit(per_record - 1))).alias("sub_ord")).select(
        "rec", F.col("sub_ord").cast("long").alias("sub_ord"), (F.col("rec") * per_record + F.col("sub_ord")).alias("sub_id"), (F.col("sub_ord") % 4).cast("int").alias("fields")
    )


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    return delivery.dispatch(commits(spark, d), subscriptions(spark, d)).withColumn("epoch", F.floor(F.col("txn") / 64).cast("long"))


# SQL building blocks
E = """w AS (SELECT user_id AS rec, event_id // 16 AS txn, event_id AS seq, value AS v,
 CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 0 END AS st,
 CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS BIGINT) AS hour FROM events)"""
L = """w AS (SELECT l_suppkey AS rec, l_orderkey AS txn, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq,
 l_quantity AS v, ascii(l_returnflag) AS st FROM lineitem)"""
NET = """f AS (SELECT rec, txn, min(seq) AS touch_seq, max_by(v, seq) AS v, max_by(st, seq) AS st FROM w GROUP BY rec, txn),
p AS (SELECT *, coalesce(lag(v) OVER q, 0) AS pv, coalesce(lag(st) OVER q, 0) AS pst FROM f WINDOW q AS (PARTITION BY rec ORDER BY txn)),
m AS (SELECT *, (CASE WHEN v <> pv THEN 1 ELSE 0 END) + (CASE WHEN st <> pst THEN 2 ELSE 0 END) AS mask FROM p),
c AS (SELECT rec, txn, touch_seq, row_number() OVER (PARTITION BY rec ORDER BY txn) AS version, CAST(mask AS INTEGER) AS mask, v, CAST(st AS INTEGER) AS st FROM m WHERE mask <> 0)"""
DIRTY = """pw AS (SELECT *, coalesce(lag(v) OVER q, 0) AS pv, coalesce(lag(st) OVER q, 0) AS pst FROM w WINDOW q AS (PARTITION BY rec ORDER BY txn, seq)),
dirty AS (SELECT rec, txn, CAST(bit_or((CASE WHEN v <> pv THEN 1 ELSE 0 END) + (CASE WHEN st <> pst THEN 2 ELSE 0 END)) AS INTEGER) AS dirty FROM pw GROUP BY rec, txn)"""
SUBS = """s AS (SELECT r.rec, k.k AS sub_ord, r.rec * 8 + k.k AS sub_id, CAST(k.k % 4 AS INTEGER) AS fields FROM (SELECT DISTINCT user_id AS rec FROM events) r, range(8) k(k))"""
DEL = f"""{E}, {NET}, {SUBS}, d AS (SELECT c.*, s.sub_ord, s.sub_id, s.fields, c.txn // 64 AS epoch FROM c JOIN s ON c.rec = s.rec AND (s.fields = 0 OR (s.fields & c.mask) <> 0))"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY txn DESC, touch_seq DESC, sub_ord DESC) AS n FROM d)"


@query(f"WITH {E}, {NET} SELECT * FROM c")
def commits_net_change(spark, d):
    return commits(spark, d)


@query(f"WITH {L}, {NET} SELECT * FROM c")
def commits_net_change_bulk(spark, d):
    return changes.net_changes(lines(spark, d), FIELDS)


@query(f"WITH {L}, {DIRTY} SELECT * FROM dirty WHERE dirty <> 0")
def provisional_dirty_mask(spark, d):
    return changes.provisional(lines(spark, d), FIELDS)


@query(f"WITH {L}, {NET}, {DIRTY} SELECT dirty.rec, dirty.txn, dirty & ~coalesce(c.mask, 0) AS restored FROM dirty LEFT JOIN c ON c.rec = dirty.rec AND c.txn = dirty.txn WHERE (dirty & ~coalesce(c.mask, 0)) <> 0")
def restored_fields(spark, d):
    return changes.restored(lines(spark, d), FIELDS)


@query(f"WITH all_w AS (SELECT user_id AS rec, event_id // 16 AS txn, event_id AS seq, floor(value / 20) AS v FROM events), w AS (SELECT *, 0 AS st FROM all_w), {NET} SELECT rec, txn FROM m WHERE mask = 0")
def net_zero_transactions(spark, d):
    w = events(spark, d).withColumn("v", F.floor(F.col("v") / 20).cast("double")).withColumn("st", F.lit(0))
    return changes.net_zero(w, FIELDS)


@query(f"WITH {E}, {NET} SELECT rec, txn, version, mask FROM c ORDER BY txn DESC, touch_seq DESC LIMIT {CAPACITY}")
def journal_overwrite_oldest(spark, d):
    return journal.keep_newest(commits(spark, d), CAPACITY).select("rec", "txn", "version", "mask")


@query(f"WITH {E}, {NET} SELECT rec, txn, version, mask FROM c ORDER BY txn, touch_seq LIMIT {CAPACITY}")
def journal_reject_newest(spark, d):
    return journal.keep_oldest(commits(spark, d), CAPACITY).select("rec", "txn", "version", "mask")


@query(
    f"""WITH {E}, {NET}, e AS (SELECT *, txn // 64 AS epoch FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY txn DESC, touch_seq DESC) AS k, count(*) OVER (PARTITION BY epoch) AS total FROM e)
SELECT epoch, rec, txn, version, mask, greatest(total - {SAMPLE}, 0) AS overwritten,
(SELECT CAST(sum(greatest(m.total - {SAMPLE}, 0)) AS BIGINT) FROM n m WHERE m.k = 1 AND m.epoch <= n.epoch) AS overwritten_total FROM n WHERE k <= {SAMPLE}"""
)
def journal_sample_and_clear(spark, d):
    c = commits(spark, d).withColumn("epoch", F.floor(F.col("txn") / 64).cast("long"))
    return journal.sample_and_clear(c, "epoch", SAMPLE).select("epoch", "rec", "txn", "version", "mask", "overwritten", "overwritten_total")


@query(f"WITH {E}, {NET}, j AS (SELECT * FROM c ORDER BY txn DESC, touch_seq DESC LIMIT {CAPACITY}) SELECT rec, max(version) AS version, bit_or(mask) AS mask FROM j GROUP BY rec")
def journal_merge(spark, d):
    return journal.merge(journal.keep_newest(commits(spark, d), CAPACITY))


@query(f"WITH {E}, {NET} SELECT least(count(*), {CAPACITY}) AS length, greatest(count(*) - {CAPACITY}, 0) AS overwritten, CAST(least(count(*), {CAPACITY}) AS DOUBLE) / {CAPACITY} AS utilization FROM c")
def journal_utilization(spark, d):
    return journal.loss(commits(spark, d), CAPACITY, "overwritten")


@query(f"WITH {DEL} SELECT sub_id, rec, txn, touch_seq, sub_ord, version, mask FROM d")
def dispatch_immediate(spark, d):
    return deliveries(spark, d).select("sub_id", "rec", "txn", "touch_seq", "sub_ord", "version", "mask")


WIDE = 40


@query(
    f"""WITH {E}, {NET} SELECT c.rec * 3 + k.k AS sub_id, c.rec, c.txn, c.version FROM c, range(3) k(k)
WHERE (k.k = 0 AND (c.mask & 1) <> 0) OR (k.k = 1 AND (c.mask & 2) <> 0) OR k.k = 2"""
)
def dispatch_wide_selection(spark, d):
    """A layout of 40 fields whose fields 0 and 35 carry the values: masks are two words."""
    layout = Layout("wide", [Field(f"f{i}", "float64") for i in range(WIDE)])
    w = events(spark, d).select("rec", "txn", "seq", *((F.col("v") if i == 0 else F.col("st").cast("double") if i == 35 else F.lit(None).cast("double")).alias(f"f{i}") for i in range(WIDE)))
    c = changes.wide_net_changes(w, {f"f{i}": 0.0 for i in range(WIDE)})
    picks = [layout.selection("f0"), layout.selection("f35"), layout.selection("f0", "f35")]
    recs = read(spark, d, "events", "user_id").distinct()
    subs = recs.select(F.col("user_id").alias("rec"), F.posexplode(F.array(*(F.array(*map(F.lit, p)) for p in picks))).alias("k", "selection")).withColumn("sub_id", F.col("rec") * 3 + F.col("k"))
    return delivery.dispatch_wide(c, subs).select("sub_id", "rec", "txn", "version")


LATEST_SQL = "l AS (SELECT sub_id, epoch, any_value(rec) AS rec, max(version) AS version, bit_or(mask) AS mask, count(*) - 1 AS coalesced, min(touch_seq) AS first_ord FROM d GROUP BY sub_id, epoch)"


@query(f"WITH {DEL}, {LATEST_SQL} SELECT * FROM l")
def delivery_latest(spark, d):
    return delivery.latest(deliveries(spark, d))


@query(
    f"""WITH {DEL}, {LATEST_SQL} SELECT l.sub_id, l.epoch, l.version, c.version AS state_version, c.v, c.st FROM l ASOF JOIN c ON l.rec = c.rec AND (l.epoch + 1) * 64 - 1 >= c.txn"""
)
def delivery_latest_state(spark, d):
    flushed = delivery.latest(deliveries(spark, d)).withColumn("flush_txn", (F.col("epoch") + 1) * 64 - 1)
    return delivery.state_as_of(flushed, commits(spark, d), "flush_txn", ["v", "st"]).select("sub_id", "epoch", "version", "state_version", "v", "st")


@query(f"WITH {DEL}, {RANKED} SELECT epoch, sub_id, txn, touch_seq, version, mask FROM ranked WHERE n <= {RING}")
def delivery_batched_ring(spark, d):
    return delivery.batched(deliveries(spark, d), RING).select("epoch", "sub_id", "txn", "touch_seq", "version", "mask")


@query(
    f"""WITH {DEL}, {LATEST_SQL}, {RANKED}, a AS (SELECT sub_id, count(*) AS n FROM d GROUP BY sub_id), b AS (SELECT sub_id, count(*) AS n, CAST(sum(coalesced) AS BIGINT) AS co FROM l GROUP BY sub_id),
r AS (SELECT sub_id, count(*) AS n FROM ranked WHERE n <= {RING} GROUP BY sub_id)
SELECT s.sub_id, coalesce(a.n, 0) AS immediate_delivered, coalesce(b.n, 0) AS latest_delivered, coalesce(b.co, 0) AS coalesced, coalesce(r.n, 0) AS batched_delivered, coalesce(a.n, 0) - coalesce(r.n, 0) AS dropped
FROM s LEFT JOIN a ON s.sub_id = a.sub_id LEFT JOIN b ON s.sub_id = b.sub_id LEFT JOIN r ON s.sub_id = r.sub_id"""
)
def delivery_metrics(spark, d):
    return delivery.metrics(deliveries(spark, d), subscriptions(spark, d), RING)


@query(
    f"""WITH {DEL}, {LATEST_SQL}, {RANKED} SELECT 0 AS phase, epoch, first_ord, 0 AS ring_ord, sub_id, version, mask FROM l UNION ALL SELECT 1, epoch, touch_seq, sub_ord, sub_id, version, mask FROM ranked WHERE n <= {RING}"""
)
def flush_phases(spark, d):
    x = deliveries(spark, d)
    return delivery.flush(delivery.latest(x), delivery.batched(x, RING))


@query(f"WITH {DEL}, {RANKED} SELECT epoch, sub_id, version FROM ranked WHERE n <= {RING} AND sub_id NOT IN (SELECT sub_id FROM s WHERE fields = 2)")
def flush_inactive_purged(spark, d):
    queued = delivery.batched(deliveries(spark, d), RING)
    return delivery.purge(queued, subscriptions(spark, d).where("fields = 2")).select("epoch", "sub_id", "version")


@query(
    f"""WITH {E}, {NET}, h AS (SELECT c.*, w.hour AS frame FROM c JOIN w ON w.rec = c.rec AND w.seq = c.touch_seq), f4 AS (SELECT k AS filter_id, CAST(k AS INTEGER) AS fields FROM range(4) t(k))
SELECT filter_id, frame, count(*) AS accepted, count(*) - 1 AS coalesced, bit_or(mask) AS mask FROM h, f4 WHERE fields = 0 OR mask = 0 OR (fields & mask) <> 0 GROUP BY filter_id, frame"""
)
def frame_coalesced_delivery(spark, d):
    # a commit's frame is its first write's; the touch_seq is that write, so one join on (rec, seq) finds it
    at = events(spark, d).select("rec", F.col("seq").alias("touch_seq"), F.col("hour").alias("frame"))
    filters = spark.range(4).select(F.col("id").alias("filter_id"), F.col("id").cast("int").alias("fields"))
    return delivery.frames(commits(spark, d).join(at, ["rec", "touch_seq"]), filters)


@query(
    f"""WITH {DEL}, {LATEST_SQL}, {RANKED} SELECT (SELECT count(*) FROM c) AS committed, (SELECT count(DISTINCT rec) FROM c) AS live, (SELECT count(*) FROM d) AS immediate_delivered,
(SELECT CAST(sum(coalesced) AS BIGINT) FROM l) AS coalesced, (SELECT count(*) FROM ranked WHERE n > {RING}) AS dropped, (SELECT greatest(count(*) - {CAPACITY}, 0) FROM c) AS overwritten,
CAST(0 AS BIGINT) AS rejected, (SELECT CAST(ceil(count(DISTINCT rec) / {SEGMENT}) AS BIGINT) FROM w) AS segments, (SELECT CAST(ceil(count(DISTINCT rec) / {SEGMENT}) AS BIGINT) * {SEGMENT} FROM w) AS capacity"""
)
def store_counters(spark, d):
    c, x = commits(spark, d), deliveries(spark, d)
    a = c.groupBy("rec").agg(F.count("*").alias("n")).agg(F.sum("n").alias("committed"), F.count("*").alias("live"))
    # two counts per epoch carry all that is needed: entries, and subscriptions that have some
    per = x.groupBy("epoch", "sub_id").agg(F.count("*").alias("n")).groupBy("epoch").agg(F.sum("n").alias("n"), F.count("*").alias("subs"))
    b = per.agg(F.sum("n").alias("immediate_delivered"), F.sum(F.col("n") - F.col("subs")).alias("coalesced"), F.sum(F.greatest(F.col("n") - RING, F.lit(0))).alias("dropped"))
    kept = events(spark, d).select("rec").distinct().agg(F.ceil(F.count("*") / SEGMENT).alias("segments"))  # no record is released, so slots fill in order
    lost = F.greatest(F.col("committed") - CAPACITY, F.lit(0)).cast("long")
    out = a.crossJoin(b).crossJoin(kept)  # one row each
    return out.withColumn("overwritten", lost).withColumn("rejected", F.lit(0).cast("long")).withColumn("capacity", F.col("segments") * SEGMENT)


@query(
    f"""WITH {E}, {NET}, h AS (SELECT w.hour FROM c JOIN w ON w.rec = c.rec AND w.seq = c.touch_seq), a AS (SELECT hour, count(*) AS inputs FROM w GROUP BY hour), b AS (SELECT hour, count(*) AS n FROM h GROUP BY hour)
SELECT a.hour, inputs, coalesce(n, 0) AS commits, greatest(0, inputs - coalesce(n, 0)) AS compacted FROM a LEFT JOIN b ON a.hour = b.hour"""
)
def input_compaction(spark, d):
    e = events(spark, d)
    at = e.select("rec", F.col("seq").alias("touch_seq"), "hour")
    return telemetry.compaction(e, commits(spark, d).join(at, ["rec", "touch_seq"]), "hour")


@query(f"WITH {E}, {DIRTY} SELECT txn, count(DISTINCT rec) AS records FROM dirty WHERE dirty <> 0 GROUP BY txn")
def distinct_records_per_tick(spark, d):
    return changes.provisional(events(spark, d), FIELDS).groupBy("txn").agg(F.count("*").alias("records"))  # one row per (rec, txn) already


@query(f"WITH {E} SELECT hour, CAST(count(*) * 1000000 AS DOUBLE) / {HOUR_MICROS} AS rate FROM w GROUP BY hour")
def visible_update_rate(spark, d):
    return telemetry.rate_per_second(events(spark, d), "hour", HOUR_MICROS)


OPS = "o AS (SELECT o_custkey AS rec, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN 'release' ELSE 'write' END AS op, o_totalprice AS v FROM orders)"
GEN = "g AS (SELECT *, 1 + CAST(coalesce(sum(CASE WHEN op = 'release' THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS generation FROM o)"
LIVE = "v AS (SELECT rec, generation, count(*) AS writes, max_by(v, ord) AS v FROM g GROUP BY rec, generation HAVING sum(CASE WHEN op = 'release' THEN 1 ELSE 0 END) = 0)"


def operations(spark, d):
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return o.select(F.col("o_custkey").alias("rec"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "F", "release").otherwise("write").alias("op"), F.col("o_totalprice").alias("v"))


@query(f"WITH {OPS}, {GEN}, {LIVE} SELECT rec, generation, writes, v FROM v")
def live_state(spark, d):
    return captures.live(operations(spark, d), ["v"])


@query(f"WITH {OPS}, {GEN}, {LIVE} SELECT DISTINCT g.rec, g.generation FROM g WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.rec = g.rec AND v.generation = g.generation)")
def stale_handles(spark, d):
    return captures.stale(operations(spark, d))


@query(f"WITH {OPS} SELECT rec, 1 + count(*) FILTER (WHERE op = 'release') AS generation FROM o GROUP BY rec")
def slot_generations(spark, d):
    return operations(spark, d).groupBy("rec").agg((1 + F.count_if(F.col("op") == "release")).alias("generation"))


@query(f"WITH {E.replace('w AS (', 'all_w AS (')}, w AS (SELECT * FROM all_w WHERE txn NOT IN (SELECT rec * 5 FROM all_w)), {NET} SELECT * FROM c")
def txn_rollback(spark, d):
    """Transactions 5 * rec for any record roll back."""
    w = events(spark, d)
    return changes.net_changes(changes.without_aborted(w, w.select((F.col("rec") * 5).alias("txn"))), FIELDS)


@query(f"WITH {E}, {NET}, {SUBS} SELECT s.sub_id, c.txn, c.version, c.mask FROM c JOIN s ON c.rec = s.rec AND (s.fields = 0 OR (s.fields & c.mask) <> 0) WHERE c.txn >= s.sub_id % 300 AND c.txn < s.sub_id % 300 + 200")
def subscription_validity(spark, d):
    s = subscriptions(spark, d).withColumn("from_ord", F.col("sub_id") % 300).withColumn("to_ord", F.col("sub_id") % 300 + 200)
    return delivery.dispatch(commits(spark, d), s).select("sub_id", "txn", "version", "mask")


@query(f"WITH {E}, {NET} SELECT rec, min(touch_seq) AS alloc_ord, max(version) AS version, max_by(v, version) AS v, max_by(st, version) AS st FROM c GROUP BY rec")
def capture_checkpoint(spark, d):
    return captures.checkpoint(commits(spark, d), ["v", "st"])


CHECKPOINT_TXN = 40
CAPS = f"""k AS (SELECT txn AS sequence, touch_seq AS op_idx, CASE WHEN txn = {CHECKPOINT_TXN} THEN 'checkpoint' ELSE 'incremental' END AS kind, CASE WHEN st = 2 AND txn <> {CHECKPOINT_TXN} THEN 'release' ELSE 'snapshot' END AS op, rec, version, v, st FROM c),
since AS (SELECT * FROM k WHERE sequence >= {CHECKPOINT_TXN}), told AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY sequence DESC, op_idx DESC) AS n, max(CASE WHEN op = 'release' THEN sequence END) OVER (PARTITION BY rec) AS gone FROM since)"""


def captured(spark, d):
    """Commits as captures: transaction 40 is a checkpoint, commits that leave an error code release their record."""
    at = F.col("txn") == CHECKPOINT_TXN
    return commits(spark, d).select(
        F.col("txn").alias("sequence"), F.col("touch_seq").alias("op_idx"), F.when(at, "checkpoint").otherwise("incremental").alias("kind"),
        F.when((F.col("st") == 2) & ~at, "release").otherwise("snapshot").alias("op"), "rec", "version", "v", "st",
    )


@query(f"WITH {E}, {NET}, {CAPS} SELECT rec, version, v, st FROM told WHERE n = 1 AND op = 'snapshot'")
def capture_replay(spark, d):
    return captures.replay(captured(spark, d), ["version", "v", "st"])


@query(
    f"""WITH {E}, {NET}, {CAPS}, first AS (SELECT rec, sequence, op_idx, row_number() OVER (PARTITION BY rec ORDER BY sequence, op_idx) AS n FROM told WHERE op = 'snapshot' AND (gone IS NULL OR sequence > gone)) SELECT rec, sequence, op_idx FROM first WHERE n = 1"""
)
def recovered_order(spark, d):
    return captures.recovered_order(captured(spark, d))


@query(f"WITH {E}, {NET} SELECT rec, version, 'sensor' AS layout_identity, rec % 4 AS layout_version, CASE WHEN rec % 4 < 3 THEN 'schema_' || (rec % 4) END AS resolved FROM c")
def layout_version_join(spark, d):
    known = spark.range(3).select(F.lit("sensor").alias("layout_identity"), F.col("id").alias("layout_version"), F.concat(F.lit("schema_"), F.col("id").cast("string")).alias("resolved"))
    snaps = commits(spark, d).select("rec", "version", F.lit("sensor").alias("layout_identity"), (F.col("rec") % 4).alias("layout_version"))
    return captures.resolve_layouts(snaps, known)


@query(
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity * 10 > 255) AS bad_uint8, count(*) FILTER (WHERE round(l_extendedprice) > 65535) AS bad_uint16,
count(*) FILTER (WHERE length(l_linestatus) <> 1) AS bad_bytes FROM lineitem GROUP BY l_returnflag"""
)
def value_validation(spark, d):
    lay = Layout("line", [Field("quantity", "uint8"), Field("price", "uint16"), Field("flag", "bytes", 1)])
    r = read(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag")
    bad = lambda name, c: F.count_if(~lay.valid(name, c))
    return r.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), bad("quantity", (F.col("l_quantity") * 10).cast("long")).alias("bad_uint8"), bad("price", F.round("l_extendedprice").cast("long")).alias("bad_uint16"),
        bad("flag", F.encode("l_linestatus", "UTF-8")).alias("bad_bytes"),
    )


@query(
    """SELECT event_id, CAST(CAST(event_id AS HUGEINT) * 1844674407370955 // 4294967296 AS BIGINT) AS high, CAST(CAST(event_id AS HUGEINT) * 1844674407370955 % 4294967296 AS BIGINT) AS low,
lower(lpad(to_hex(CAST(CAST(event_id AS HUGEINT) * 1844674407370955 AS HUGEINT)), 16, '0')) AS hex16 FROM events"""
)
def uint64_words(spark, d):
    """The products stay below 2^64 up to event 10000; of larger ones all of the high part is told, and the 16 leading digits."""
    x = F.col("event_id").cast("decimal(20,0)") * F.lit(1844674407370955).cast("decimal(16,0)")  # decimal(37,0)
    e = read(spark, d, "events", "event_id").withColumn("x", x)
    return e.select("event_id", C.high_word(F.col("x")).alias("high"), C.low_word(F.col("x")).alias("low"), C.leading_hex16(F.col("x")).alias("hex16"))


BYTES = "list_transform(range(1, length({c}) + 1), lambda i: ascii(substr({c}, i, 1)))"


@query(f"SELECT p_partkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), {BYTES.format(c='p_name')}), lambda a, b: (a * 31 + b) & 2147483647) AS BIGINT) AS checksum FROM part")
def checksum_poly31(spark, d):
    return read(spark, d, "part", "p_partkey", "p_name").select("p_partkey", C.poly31(F.encode("p_name", "UTF-8")).alias("checksum"))


@query(f"SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {BYTES.format(c='c_name')}), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS BIGINT) AS checksum FROM customer")
def checksum_fnv1a(spark, d):
    return read(spark, d, "customer", "c_custkey", "c_name").select("c_custkey", C.fnv1a(F.encode("c_name", "UTF-8")).alias("checksum"))


@query("SELECT doc_id, CASE WHEN strlen(text) % 4 = 0 THEN strlen(text) // 4 END AS frames FROM documents")
def frame_count(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", C.frame_count(F.col("text"), 4).alias("frames"))


@query(f"WITH {E}, n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY seq DESC) AS k, count(*) OVER (PARTITION BY rec) AS total FROM w) SELECT rec, seq, v, least(total, 16) + 1 - k AS pos FROM n WHERE k <= 16")
def history_ring(spark, d):
    return telemetry.history(events(spark, d), 16, "seq", ["v"]).select("rec", "seq", "v", "pos")


@query(
    f"WITH {E}, n AS (SELECT hour, seq, row_number() OVER (PARTITION BY hour ORDER BY seq) AS r, count(*) OVER (PARTITION BY hour) AS n FROM w), k AS (SELECT *, least(n, 4) AS k FROM n) SELECT hour, seq, CASE WHEN r <= (k - n % k) * (n // k) THEN (r - 1) // (n // k) + 1 ELSE (k - n % k) + (r - (k - n % k) * (n // k) - 1) // (n // k + 1) + 1 END AS chunk FROM k"
)
def burst_split(spark, d):
    return telemetry.bursts(events(spark, d).select("hour", "seq"), "hour", "seq", 4)


@query(
    f"""WITH {E}, t AS (SELECT rec, seq, CAST(seq % 97 * 1000 + 500 AS BIGINT) AS micros FROM w), s AS (SELECT *, CAST(floor(sum(micros * 6000) OVER q / 1000000) AS BIGINT) AS whole FROM t WINDOW q AS (PARTITION BY rec ORDER BY seq)),
r AS (SELECT *, whole - coalesce(lag(whole) OVER (PARTITION BY rec ORDER BY seq), 0) AS requested FROM s) SELECT rec, seq, requested, least(requested, 500) AS accepted, requested - least(requested, 500) AS dropped FROM r"""
)
def paced_input(spark, d):
    ticks = events(spark, d).select(F.col("rec").alias("source"), F.col("seq").alias("ord"), (F.col("seq") % 97 * 1000 + 500).alias("micros"))
    return telemetry.paced(ticks, 6000, 500).select(F.col("source").alias("rec"), F.col("ord").alias("seq"), "requested", "accepted", "dropped")


@query("SELECT * FROM (SELECT i // 24 AS tick, i % 24 AS rec, round(24 + 5 * sin(i // 24 * 0.05 + i % 24 * 0.7), 4) AS temperature, round(1 + 0.08 * cos((i // 24 * 0.05 + i % 24 * 0.7) * 0.6), 4) AS pressure FROM range(24000) r(i))")
def telemetry_source(spark, d):
    return telemetry.simulate(spark, 1000, seed=None).select("tick", "rec", F.round("temperature", 4).alias("temperature"), F.round("pressure", 4).alias("pressure"))


@query()
def slot_allocator(spark, d):
    """One store per order priority; customers hold a record until a finished order releases it."""
    o = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    ops = o.select(F.col("o_orderpriority").alias("store"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "F", "release").otherwise("allocate").alias("op"), F.col("o_custkey").alias("rec"))
    return folds.allocate_slots(ops, "store", 64)


@query()
def journal_admission(spark, d):
    """One journal per event type; every third event acknowledges."""
    e = read(spark, d, "events", "event_id", "event_type", "value")
    ops = e.select(F.col("event_type").alias("store"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 == 0, "ack").otherwise("append").alias("op"), (F.col("value") + 20).cast("long").alias("bytes"))
    return folds.admit(ops, "store", 4000, 8000, 1000)


@query(
    """WITH RECURSIVE e AS (SELECT event_type AS store, event_id AS ord, CASE WHEN event_id % 4 = 0 THEN 'take' ELSE 'append' END AS op, event_id AS value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
f AS (SELECT DISTINCT store, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ord, '' AS op, CAST(NULL AS BIGINT) AS value, CAST([] AS BIGINT[]) AS ring, CAST(0 AS BIGINT) AS lost FROM e
UNION ALL SELECT e.store, e.n, e.ord, e.op, CASE WHEN e.op = 'take' THEN f.ring[1] ELSE e.value END,
CASE WHEN e.op = 'take' THEN f.ring[2:] WHEN len(f.ring) < 64 THEN list_append(f.ring, e.value) ELSE list_append(f.ring[2:], e.value) END,
f.lost + CASE WHEN e.op = 'append' AND len(f.ring) >= 64 THEN 1 ELSE 0 END FROM f JOIN e ON e.store = f.store AND e.n = f.n + 1)
SELECT store, ord, op, value, true AS accepted, CAST(len(ring) AS BIGINT) AS length, lost AS overwritten, CAST(0 AS BIGINT) AS rejected FROM f WHERE n > 0"""
)
def journal_with_takes(spark, d):
    e = read(spark, d, "events", "event_id", "event_type")
    ops = e.select(F.col("event_type").alias("store"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 4 == 0, "take").otherwise("append").alias("op"), F.col("event_id").alias("value"))
    return journal.with_takes(ops, "store", 64, True)


@query(
    f"""WITH RECURSIVE {E}, t AS (SELECT rec, seq AS ord, seq * 16000 AS micros, row_number() OVER (PARTITION BY rec ORDER BY seq) AS n FROM w),
f AS (SELECT rec, ord, micros, n, micros AS anchor, CAST(0 AS BIGINT) AS gaps, CAST(NULL AS BIGINT) AS fps FROM t WHERE n = 1
UNION ALL SELECT t.rec, t.ord, t.micros, t.n, CASE WHEN t.micros - f.anchor >= 1000000 THEN t.micros ELSE f.anchor END, CASE WHEN t.micros - f.anchor >= 1000000 THEN 0 ELSE f.gaps + 1 END,
CASE WHEN t.micros - f.anchor >= 1000000 THEN ((f.gaps + 1) * 2000000 + t.micros - f.anchor) // (2 * (t.micros - f.anchor)) END FROM f JOIN t ON t.rec = f.rec AND t.n = f.n + 1)
SELECT rec, ord, micros, fps FROM f"""
)
def fps_estimate(spark, d):
    e = events(spark, d).select("rec", F.col("seq").alias("ord"), (F.col("seq") * 16_000).alias("micros"))
    return folds.frame_rate(e, "rec")


RECORD = Layout("line", [Field("rec", "int64"), Field("txn", "uint32"), Field("v", "float64"), Field("st", "uint8")])


@query("SELECT l_suppkey AS rec, l_orderkey AS txn, l_quantity AS v, CAST(ascii(l_returnflag) AS SMALLINT) AS st, 32 AS bytes FROM lineitem")
def record_codec(spark, d):
    """Rows to record bytes and back."""
    rows = lines(spark, d).select("rec", "txn", "v", F.col("st").cast("short").alias("st"))
    coded = rows.select(RECORD.encoder().alias("image"))
    return coded.select(RECORD.decoder("image").alias("r"), F.octet_length("image").alias("bytes")).select("r.*", "bytes")


STEP = "((({a}) * 31 + ({b})) & 2147483647)"
#: Bytes of a code point c in UTF-8, folded one by one.
UTF8 = [
    ("c < 128", ["c"]),
    ("c < 2048", ["192 + (c >> 6)", "128 + (c & 63)"]),
    ("c < 65536", ["224 + (c >> 12)", "128 + ((c >> 6) & 63)", "128 + (c & 63)"]),
    ("true", ["240 + (c >> 18)", "128 + ((c >> 12) & 63)", "128 + ((c >> 6) & 63)", "128 + (c & 63)"]),
]


def _folded(parts: list[str]) -> str:
    out = "a"
    for b in parts:
        out = STEP.format(a=out, b=b)
    return out


POLY_TEXT = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(text, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, c: CASE " + " ".join(f"WHEN {when} THEN {_folded(parts)}" for when, parts in UTF8) + " END)"


@query(f"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE {POLY_TEXT} END AS checksum FROM documents")
def checksum_documents(spark, d):
    """Long payloads: the vectorised checksum over whole texts."""
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", C.poly31_long(F.encode("text", "UTF-8")).alias("checksum"))


@query(
    f"""WITH {E}, {DIRTY}, per AS (SELECT txn, count(*) * 32 AS held FROM dirty WHERE dirty <> 0 GROUP BY txn) SELECT coalesce(max(held), 0) AS high_water, count(*) AS transactions FROM per"""
)
def scratch_high_water(spark, d):
    return changes.scratch_high_water(events(spark, d), FIELDS, RECORD.size)


#: A value as whole cents in eight digits of text, which counts as changed from a difference of 5.00 on.
CENTS = CustomField("cents", 8, lambda v: F.encode(F.lpad(F.round(v * 100).cast("long").cast("string"), 8, "0"), "UTF-8"), lambda raw: F.decode(raw, "UTF-8").cast("long"), lambda a, b: F.abs(a - b) >= 500)


@query(
    f"""WITH w0 AS (SELECT user_id AS rec, event_id // 16 AS txn, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS cents FROM events), f AS (SELECT rec, txn, min(seq) AS touch_seq, max_by(cents, seq) AS cents FROM w0 GROUP BY rec, txn),
p AS (SELECT *, coalesce(lag(cents) OVER (PARTITION BY rec ORDER BY txn), 0) AS before FROM f) SELECT rec, txn, row_number() OVER (PARTITION BY rec ORDER BY txn) AS version, cents FROM p WHERE abs(cents - before) >= 500"""
)
def custom_field_changes(spark, d):
    """A field with its own encoding and its own test of change."""
    w = events(spark, d).select("rec", "txn", "seq", CENTS.stored(F.col("v")).alias("cents"))
    c = changes.net_changes(w, {"cents": b"00000000"}, custom={"cents": CENTS})
    return c.select("rec", "txn", "version", CENTS.decode(F.col("cents")).alias("cents"))


@query(
    f"""WITH {DEL}, o AS (SELECT * FROM d WHERE epoch = (SELECT max(epoch) FROM d)), q AS (SELECT sub_id, row_number() OVER (ORDER BY txn DESC, touch_seq DESC, sub_ord DESC) AS n FROM o),
a AS (SELECT DISTINCT sub_id FROM o), b AS (SELECT sub_id, count(*) AS n FROM q WHERE n <= {RING} GROUP BY sub_id)
SELECT s.sub_id, CAST(CASE WHEN a.sub_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS latest_pending, coalesce(b.n, 0) AS batched_pending FROM s LEFT JOIN a ON s.sub_id = a.sub_id LEFT JOIN b ON s.sub_id = b.sub_id"""
)
def delivery_pending(spark, d):
    return delivery.pending(deliveries(spark, d), subscriptions(spark, d), RING)


@query(
    f"""WITH {E}, {NET} SELECT rec, version, CAST(mask | 4 AS INTEGER) AS joined, (mask & 2) <> 0 AS has_st, mask = 0 AS nothing, (mask & 2) <> 0 AS meets, rec % 31 AS high_bit, CAST(1 << (rec % 31) AS BIGINT) AS high_word FROM c"""
)
def mask_algebra(spark, d):
    """Masks as words of a wide layout: union, test of a field, emptiness, intersection, and a field of the second word."""
    wide = Layout("wide", [Field(f"f{i}", "uint8") for i in range(62)])
    picked = F.array(F.lit(0), F.call_function("shiftleft", F.lit(1), (F.col("rec") % 31).cast("int")))  # field 31 + rec % 31
    c = commits(spark, d).select("rec", "version", F.array(F.col("mask"), F.lit(0)).alias("words"), picked.alias("picked"))
    has = F.lit(None).cast("long")
    for i in range(31, 62):
        has = F.when(C.wide_contains(F.col("picked"), i), i - 31).otherwise(has)
    words = lambda *names: F.array(*map(F.lit, wide.selection(*names)))
    return c.select(
        "rec", "version", F.get(C.wide_union(F.col("words"), words("f2")), F.lit(0)).alias("joined"), C.wide_contains(F.col("words"), 1).alias("has_st"), C.is_empty(F.col("words")).alias("nothing"),
        C.intersects(F.col("words"), words("f1", "f40")).alias("meets"), has.cast("long").alias("high_bit"), F.get("picked", F.lit(1)).cast("long").alias("high_word"),
    )


PHASE = "(i // 24 * 0.05 + i % 24 * 0.7)"


@query(
    f"""SELECT i // 24 AS tick, i % 24 AS rec, (24 + 5 * sin({PHASE}) > 28.5) AS hot, (1 + 0.08 * cos({PHASE} * 0.6) < 0.93) AS low,
CAST((CASE WHEN 24 + 5 * sin({PHASE}) > 28.5 THEN 1 ELSE 0 END) + (CASE WHEN 1 + 0.08 * cos({PHASE} * 0.6) < 0.93 THEN 2 ELSE 0 END) AS INTEGER) AS flags FROM range(24000) r(i)"""
)
def telemetry_status(spark, d):
    s = telemetry.simulate(spark, 1000, seed=None)
    return s.select("tick", "rec", C.contains(F.col("status"), 0).alias("hot"), C.contains(F.col("status"), 1).alias("low"), F.col("status").bitwiseAND(F.lit(3)).alias("flags"))


@query(
    """SELECT * FROM (VALUES ('l_orderkey', 0, 8, 0), ('l_partkey', 8, 8, 1), ('l_suppkey', 16, 8, 2), ('l_linenumber', 24, 4, 3), ('l_quantity', 32, 8, 4), ('l_extendedprice', 40, 8, 5), ('l_discount', 48, 8, 6), ('l_tax', 56, 8, 7)) t(name, start, width, place)"""
)
def layout_of_table(spark, d):
    """The layout that the numbers of a table's schema give: offsets are aligned."""
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    lay = Layout.of(type(schema)([f for f in schema.fields if f.dataType.typeName() in ("integer", "long", "double")]), "line")
    rows = [(f.name, f.metadata["offset"], f.metadata["width"], f.metadata["index"]) for f in lay.schema()]
    return spark.createDataFrame(rows, "name string, start int, width int, place int")


def journalled(spark, d) -> str:
    """Events as a binary journal in the shared folder: every tenth releases its record."""
    e, gone = read(spark, d, "events", "event_id", "user_id", "event_type"), F.col("event_id") % 10 == 9
    some = lambda c: F.when(~gone, c)
    rows = e.select(
        (F.col("event_id") + 1).alias("sequence"), F.lit(0).alias("op_idx"), F.lit("incremental").alias("kind"), F.when(gone, "release").otherwise("snapshot").alias("op"),
        F.lit(0).cast("long").alias("segment"), F.col("user_id").alias("slot"), F.lit(1).cast("long").alias("generation"), some(F.lit("event")).alias("layout_identity"), some(F.lit(3).cast("long")).alias("layout_version"),
        some(F.col("event_id").cast("decimal(20,0)")).alias("version"), some(F.encode("event_type", "UTF-8")).alias("image"),
    )
    path = new_path(spark, "journal")
    log.write_captures(rows, path)
    return path


@query("SELECT event_id + 1 AS sequence, CASE WHEN event_id % 10 = 9 THEN 'release' ELSE 'snapshot' END AS op, user_id AS slot, CASE WHEN event_id % 10 <> 9 THEN event_id END AS version, CASE WHEN event_id % 10 <> 9 THEN event_type END AS image FROM events")
def journal_round_trip(spark, d):
    """Captures through the binary journal: sink, then source."""
    back = log.read_captures(spark, journalled(spark, d))
    return back.select("sequence", "op", "slot", F.col("version").cast("long").alias("version"), F.decode("image", "UTF-8").alias("image"))


@query(
    f"""SELECT event_id + 1 AS sequence, CASE WHEN event_id % 10 <> 9 THEN CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), {BYTES.format(c='event_type')}), lambda a, b: (a * 31 + b) & 2147483647) AS BIGINT) END AS checksum,
CASE WHEN event_id % 10 <> 9 THEN length(event_type) END AS frame_count, event_id % 10 = 9 AS failed FROM events"""
)
def journal_stream_checksums(spark, d):
    """The journal as a stream of bounded offers through the byte worker, whose failures stay with their batch."""
    path, n = journalled(spark, d), spark.read.parquet(f"{d}/events.parquet").count()
    stream = spark.readStream.format("capture_journal").option("path", path).option("maxSequencesPerTrigger", str(max(1, -(-n // 3)))).load()
    done = worker.process(stream, payload="image")
    q = done.writeStream.format("parquet").option("path", f"{path}.out").option("checkpointLocation", f"{path}.checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"{path}.out").select("sequence", "checksum", "frame_count", F.col("error").isNotNull().alias("failed"))
