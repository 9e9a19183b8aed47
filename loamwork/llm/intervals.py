"""Interval overlap join of sales and click sessions: totals for each sale and relation, by window functions alone.

Sessions. Clicks of a client within one stretch of 15 minutes of the clock can't be torn apart, so they are summed up to one row (first, last, error at the
last) before anything is shuffled; windows over these rows, of which a client has at most four an hour, join them to sessions.
Totals. Sessions of one client follow one another, so by start and by end they stand in the same order, and the closed ones that start before a slot, or end
before it, are a head of that order. Two heads meet in the shorter one. Endpoint probes (the slots of the sales) are united with session endpoints (closed
ones by start and by end, open ones by start), already summed up for each client and slot; running counts and sums of starts, ends and checksums over slots
then give each probe all heads it needs, and each relation is the difference of two heads.
What a window holds of a client is bounded by the calendar (slots and quarters of an hour), whatever the number of its clicks and sales. Sales meet the
totals by client and slot; open sales, which need no total at their end, are dealt out instead of meeting under one key.

Defined results: rows of clicks without client or ts, and rows of sales without client or sold_at, are left out; a null kind is no error and a null status
not open; a sale without sale_id has no lines; lines without sale_id or shipped_at don't count; repeated lines change nothing, repeated clicks neither
(sessions are made of instants), and each row of sales is a sale of its own; shipped_at before sold_at doesn't shorten a sale; times before 1970 have
negative slots; empty tables give no rows; extra columns are not read. Times without a zone are UTC, whatever the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from loamwork import session

SLOT_HOURS, GAP_MINUTES = 6, 15
#: Parts over which open sales are dealt out.
SPREAD = 4096
MINUTE = 60_000_000
FIELDS = ("n", "starts", "ends", "crc")

#: How a sale's start lies to a session's, how its end does, and the name of the relation.
RELATIONS = {
    ("earlier", "earlier"): "overlaps",
    ("earlier", "equal"): "finished_by",
    ("earlier", "later"): "contains",
    ("equal", "earlier"): "starts",
    ("equal", "equal"): "equals",
    ("equal", "later"): "started_by",
    ("later", "earlier"): "during",
    ("later", "equal"): "finishes",
    ("later", "later"): "overlapped_by",
}


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without a zone is UTC."""
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(df[name].cast("timestamp"))
    since = df[name] - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")


def floored(at: Column, width: int) -> Column:
    """The number of the stretch of `width` microseconds that holds `at`, rounded down also before 1970."""
    return ((at - F.pmod(at, F.lit(width))) / width).cast("long")  # divides without rest


def click_sessions(clicks: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """client_id, first, last (microseconds), open: a click over gap_minutes after the client's previous one begins another session."""
    gap = gap_minutes * MINUTE
    rows = clicks.select(clicks["client_id"].alias("client_id"), micros(clicks, "ts").alias("at"), F.coalesce(clicks["kind"] == "error", F.lit(False)).cast("long").alias("error"))
    rows = rows.where("client_id IS NOT NULL AND at IS NOT NULL")
    # 2 * at + error: the latest instant, and whether a click there is an error, as one number
    near = rows.groupBy("client_id", floored(F.col("at"), gap).alias("stretch")).agg(F.min("at").alias("first"), F.max(F.col("at") * 2 + F.col("error")).alias("ended"))
    by_time = Window.partitionBy("client_id").orderBy("first")
    fresh = F.col("first") - F.lag(F.floor(F.col("ended") / 2)).over(by_time) > gap
    near = near.withColumn("fresh", F.when(fresh, 1).otherwise(0)).withColumn("number", F.sum("fresh").over(by_time))
    ended = F.max("ended")
    whole = near.groupBy("client_id", "number").agg(F.min("first").alias("first"), ended.alias("ended"))
    return whole.select("client_id", "first", F.floor(F.col("ended") / 2).alias("last"), (F.pmod("ended", F.lit(2)) == 1).alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame, slot_hours: int = SLOT_HOURS) -> DataFrame:
    """sale_id, client_id, a, b: slots of a sale's start and end; b is null for open sales."""
    width = slot_hours * 60 * MINUTE
    shipped = lines.select(lines["sale_id"].alias("line_of"), micros(lines, "shipped_at").alias("at")).where("line_of IS NOT NULL AND at IS NOT NULL")
    shipped = shipped.groupBy("line_of").agg(F.max("at").alias("shipped")).withColumn("dealt", F.lit(0))
    own = sales.select(sales["sale_id"].alias("sale_id"), sales["client_id"].alias("client_id"), micros(sales, "sold_at").alias("sold"), F.coalesce(sales["status"] == "open", F.lit(False)).alias("open"))
    own = own.where("client_id IS NOT NULL AND sold IS NOT NULL")
    # sales without an id meet no line: dealt out, they don't gather under null
    own = own.withColumn("part", F.when(F.col("sale_id").isNull(), F.pmod(F.xxhash64("client_id", "sold"), F.lit(SPREAD)).cast("int") + 1).otherwise(0))
    met = own.join(shipped, (own["sale_id"] == shipped["line_of"]) & (own["part"] == shipped["dealt"]), "left")
    ends = F.greatest("sold", "shipped")  # nulls are passed over
    return met.select("sale_id", "client_id", floored(F.col("sold"), width).alias("a"), F.when(~F.col("open"), floored(ends, width)).alias("b"))


def totals_at_slots(sessions: DataFrame, intervals: DataFrame, slot_hours: int = SLOT_HOURS) -> DataFrame:
    """client_id, slot and, for each slot that a sale starts or ends in, the heads as structs: closed sessions that start before it (start_lt), start in it
    or before (start_le), end before it (end_lt), end in it or before (end_le); open ones by start (open_lt, open_le); all of the client (closed, opened)."""
    width = slot_hours * 60 * MINUTE
    slots = sessions.select("client_id", "open", floored(F.col("first"), width).alias("start"), floored(F.col("last"), width).alias("end"), F.crc32(F.col("first").cast("string").cast("binary")).alias("crc"))
    of = lambda kind, slot: F.struct(F.lit(kind).alias("kind"), F.col(slot).alias("slot"))
    ends = slots.select("*", F.explode(F.when(F.col("open"), F.array(of("o", "start"))).otherwise(F.array(of("s", "start"), of("e", "end")))).alias("at"))
    values = {"n": F.lit(1), "starts": F.col("start"), "ends": F.when(~F.col("open"), F.col("end")), "crc": F.col("crc")}
    names = [f"{k}_{f}" for k in "seo" for f in FIELDS]
    ends = ends.select("client_id", "at.slot", *(F.when(F.col("at.kind") == k, values[f]).cast("long").alias(f"{k}_{f}") for k in "seo" for f in FIELDS), F.lit(0).alias("probe"))
    probes = intervals.select("client_id", F.explode(F.array_compact(F.array("a", "b"))).alias("slot")).distinct()
    probes = probes.select("client_id", "slot", *(F.lit(None).cast("long").alias(x) for x in names), F.lit(1).alias("probe"))
    both = ends.unionByName(probes).groupBy("client_id", "slot").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names), F.max("probe").alias("probe"))
    own = Window.partitionBy("client_id")
    upto = own.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.select("client_id", "slot", "probe", *names, *(F.sum(x).over(upto).alias(f"to_{x}") for x in names), *(F.sum(f"{k}_{f}").over(own).alias(f"all_{k}_{f}") for k in "so" for f in FIELDS)).where("probe = 1")
    head = lambda k, make: F.struct(*(make(f"{k}_{f}").alias(f) for f in FIELDS))
    upto_here, before, whole = lambda x: F.col(f"to_{x}"), lambda x: F.col(f"to_{x}") - F.col(x), lambda x: F.col(f"all_{x}")
    heads = {"start_lt": head("s", before), "start_le": head("s", upto_here), "end_lt": head("e", before), "end_le": head("e", upto_here), "open_lt": head("o", before), "open_le": head("o", upto_here), "closed": head("s", whole), "opened": head("o", whole)}
    return run.select("client_id", "slot", *(v.alias(k) for k, v in heads.items()))


def relations(intervals: DataFrame, totals: DataFrame) -> DataFrame:
    """sale_id, relation, n_pairs, overlap_slots, sessions_crc for each relation that a sale has to some session."""
    at_a = totals.select(F.col("client_id").alias("client_a"), F.col("slot").alias("slot_a"), *(F.col(x).alias(f"a_{x}") for x in ("start_lt", "start_le", "end_lt", "open_lt", "open_le", "closed", "opened")))
    at_b = totals.select(F.col("client_id").alias("client_b"), F.col("slot").alias("slot_b"), F.lit(0).alias("dealt"), *(F.col(x).alias(f"b_{x}") for x in ("start_le", "end_lt", "end_le", "open_le")))
    closed = F.col("b").isNotNull()
    pairs = intervals.join(at_a, (F.col("client_id") == F.col("client_a")) & (F.col("a") == F.col("slot_a")))
    pairs = pairs.where("a_closed.n + a_opened.n > 0").withColumn("part", F.when(closed, 0).otherwise(1 + F.pmod(F.xxhash64("sale_id", "client_id", "a"), F.lit(SPREAD)).cast("int")))
    pairs = pairs.join(at_b, (F.col("client_id") == F.col("client_b")) & (F.coalesce("b", F.lit(0)) == F.col("slot_b")) & (F.col("part") == F.col("dealt")), "left")

    a, b = F.col("a"), F.col("b")
    every = F.col("a_closed")
    none = F.struct(*(F.lit(0).cast("long").alias(f) for f in FIELDS))
    reach, end_lt, end_le = (F.when(closed, F.col(x)).otherwise(every) for x in ("b_start_le", "b_end_lt", "b_end_le"))
    by_start = {"earlier": (F.col("a_start_le"), reach), "equal": (F.col("a_start_lt"), F.col("a_start_le")), "later": (F.col("a_end_lt"), F.col("a_start_lt"))}
    by_end = {"earlier": (end_le, every), "equal": (end_lt, end_le), "later": (none, end_lt)}
    open_heads = {"earlier": (F.col("a_open_le"), F.when(closed, F.col("b_open_le")).otherwise(F.col("a_opened"))), "equal": (F.col("a_open_lt"), F.col("a_open_le")), "later": (none, F.col("a_open_lt"))}

    def between(low: Column, high: Column) -> dict[str, Column]:
        some = high["n"] > low["n"]
        return {f: F.when(some, high[f] - low[f]).otherwise(0) for f in FIELDS}

    found = []
    for (start, end), name in RELATIONS.items():
        low, high = (F.greatest(by_start[start][0], by_end[end][0]), F.least(by_start[start][1], by_end[end][1]))
        got = between(low, high)
        if end != "later":  # open sessions end after closed sales, and together with open ones
            held = closed if end == "earlier" else ~closed
            more = between(*open_heads[start])
            got = {f: got[f] + F.when(held, more[f]).otherwise(0) for f in FIELDS}
        last = got["ends"] if end == "later" else got["n"] * b
        first = got["starts"] if start == "earlier" else got["n"] * a
        found.append(F.struct(F.lit(name).alias("relation"), got["n"].alias("n_pairs"), (last - first + got["n"]).alias("overlap_slots"), got["crc"].alias("sessions_crc")))
    out = pairs.select("sale_id", F.explode(F.array(*found)).alias("r")).where("r.n_pairs > 0")
    return out.select("sale_id", "r.relation", "r.n_pairs", "r.overlap_slots", "r.sessions_crc")


def overlap_totals(sales: DataFrame, lines: DataFrame, clicks: DataFrame, slot_hours: int = SLOT_HOURS, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    intervals = session.written(sale_intervals(sales, lines, slot_hours), "intervals")
    return relations(intervals, totals_at_slots(click_sessions(clicks, gap_minutes), intervals, slot_hours))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_totals(*(session.table(spark, sf_dir, x) for x in ("sales", "sale_lines", "clicks")))


#: The same rows by a join of all pairs; crc32 is folded over bytes with its table of 256 remainders.
SQL = """
WITH bits AS (
  SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) x(i))),
near AS (
  SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'error', false) AS error,
         coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY client_id ORDER BY ts) > 900000000, true)::BIGINT AS fresh
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY client_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS number FROM near),
sess AS (
  SELECT client_id, min(us) AS first, max(us) AS last, max(2 * us + error::BIGINT) % 2 <> 0 AS open FROM numbered GROUP BY client_id, number),
slots AS (
  SELECT s.client_id, s.open, floor(s.first / 21600000000)::BIGINT AS s, floor(s.last / 21600000000)::BIGINT AS e,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s.first::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, bits.t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM sess s, bits),
shipped AS (SELECT sale_id, max(shipped_at) AS us FROM sale_lines GROUP BY sale_id),
own AS (
  SELECT x.sale_id, x.client_id, coalesce(x.status = 'open', false) AS open, floor(epoch_us(x.sold_at) / 21600000000)::BIGINT AS a,
         floor(epoch_us(greatest(x.sold_at, coalesce(h.us, x.sold_at))) / 21600000000)::BIGINT AS b
  FROM sales x LEFT JOIN shipped h ON x.sale_id = h.sale_id WHERE x.client_id IS NOT NULL AND x.sold_at IS NOT NULL),
pairs AS (
  SELECT sale_id, a, crc, s, CASE WHEN o.open THEN CASE WHEN t.open THEN 0 ELSE 1 END WHEN t.open THEN -1 ELSE sign(b - e) END AS ending,
         CASE WHEN o.open AND t.open THEN NULL WHEN o.open THEN e WHEN t.open THEN b ELSE least(b, e) END - greatest(a, s) + 1 AS shared
  FROM own o JOIN slots t ON o.client_id = t.client_id AND (o.open OR t.s <= o.b) AND (t.open OR o.a <= t.e))
SELECT sale_id,
       CASE sign(a - s) WHEN -1 THEN CASE ending WHEN -1 THEN 'overlaps' WHEN 0 THEN 'finished_by' ELSE 'contains' END
                        WHEN 0 THEN CASE ending WHEN -1 THEN 'starts' WHEN 0 THEN 'equals' ELSE 'started_by' END
                        ELSE CASE ending WHEN -1 THEN 'during' WHEN 0 THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
       count(*) AS n_pairs, sum(shared)::BIGINT AS overlap_slots, sum(crc)::BIGINT AS sessions_crc
FROM pairs GROUP BY ALL
"""
