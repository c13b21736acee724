"""Queries on sources, sinks and streams: frames, trial files, appended results, ingest and session order as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.operators import ordering, topics
from logweave.plans.ordering_queries import LEASE, _FENCES, _S
from logweave.plans.trace_queries import _SQL_TRIALS, _trials
from logweave.sources import frames, storage, trials
from logweave.sources.derived import SQL_BATCHES, batches, events, faulty
from logweave.streaming import reorder, session_order

_LAST_TICK = 1 << 40


def _frames(s, d):
    """Each client's batches as export frames of its connection: versions by client, gaps flagged, one bad version each 50th."""
    rows = ordering.order2(batches(s, d))
    c, q = F.col("client_id"), F.col("batch_seq")
    version = F.when((c % 50 == 49) & (q == 7), 3).otherwise(1 + c % 2)
    return rows.select(c.alias("connection"), "total_order", "num_msg", (1 + F.col("batch_id") % 150).alias("size"), c, q, version.alias("version"), (q % 11 == 10).alias("gap"))


_SQL_FRAMES = SQL_BATCHES + """, o as (select *, (sum(num_msg) over (order by epoch, broker_id, pbr_index rows unbounded preceding) - num_msg)::bigint as t from batches),
f as (select *, rank() over (partition by client_id order by t) as i, min(case when client_id % 50 = 49 and batch_seq = 7 then t end) over (partition by client_id) as bad from o)"""


def _trial_files(s, d):
    """The trials as CSV files in a folder for each system and load, with a sidecar of its settings beside them."""
    root = storage.shared_folder(s, "trials")
    rows = _trials(s, d).select(F.col("broker_id").alias("s"), F.col("load").alias("l"), "trial", F.when(F.col("trial") % 7 == 3, "n/a").otherwise(F.concat(F.round("us", 3).cast("string"), F.lit(" us"))).alias("latency"))
    rows.write.partitionBy("s", "l").csv(root, header=True)
    cells = rows.select("s", "l").distinct()
    lines = F.concat(F.lit("system="), F.col("s").cast("string"), F.lit("\nload = "), F.col("l").cast("string"), F.lit("\nno pair here"))
    cells.select("s", "l", lines.alias("value")).write.mode("append").partitionBy("s", "l").text(root)
    found = trials.with_sidecars(s, root, "*.csv", "*.txt")
    return found.select(F.col("metadata")["system"].cast("long").alias("system"), F.col("metadata")["load"].cast("long").alias("load"), F.col("trial").cast("long").alias("trial"), F.round(trials.numeric("latency"), 3).alias("us"))


def _appended(s, d):
    """Summaries by load appended to one CSV result, a load at a time, then read back; and two results under one header."""
    path, other = storage.shared_folder(s, "results"), storage.shared_folder(s, "results")
    sums = batches(s, d).groupBy("num_msg").agg(F.count("*").alias("batches"), F.max("latency_us").alias("slowest"))
    for low, high in ((1, 2), (3, 4)):
        storage.append_csv(sums.where(F.col("num_msg").between(low, high)), path)
    storage.append_csv(sums.where("num_msg = 5"), other)
    return trials.concatenated(s, [path, other]).select(*(F.col(c).cast("long").alias(c) for c in ("num_msg", "batches", "slowest")))


def _ingested(s, d, rows, schema, pieces, order, through):
    """Write the rows in pieces, as a broker's files come in, and read them as a stream, a piece a micro-batch."""
    source, out, state = (storage.shared_folder(s, n) for n in ("ingest", "streamed", "state"))
    cut = rows.select(F.floor(F.max(order) / pieces + 1).alias("w")).first().w or 1
    for k in range(pieces):
        part = F.col(order).between(k * cut, (k + 1) * cut - 1) if k < pieces - 1 else F.col(order) >= k * cut
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
    result = through(storage.ingest_stream(s, source, schema, 1))
    storage.appended_stream(result, out, state).awaitTermination()
    return s.read.schema(result.schema).parquet(out)


def _session_stream(s, d):
    log = faulty(s, d).select("client_id", "session_epoch", "batch_seq", "num_msg", "arrival")
    ticks = log.select("client_id", "session_epoch").distinct().select("*", F.lit(None).cast("long").alias("batch_seq"), F.lit(0).cast("long").alias("num_msg"), F.lit(_LAST_TICK).alias("arrival"))
    cut = log.agg(F.max("arrival").alias("m")).first().m or 1
    rows = log.unionByName(ticks).withColumn("_o", F.least("arrival", F.lit(cut)))
    schema = "client_id long, session_epoch long, batch_seq long, num_msg long, arrival long, _o long"
    done = _ingested(s, d, rows, schema, 3, "_o", lambda stream: session_order.ordered(stream, LEASE))
    return done.where("event in ('release', 'fence')").select("client_id", "session_epoch", "batch_seq", "event", "tick")


def _subscribers(s, d):
    """Frames that two subscribers got: some lost, some again, and a gap that the cursor reported."""
    o = ordering.order2(batches(s, d)).select("total_order", "num_msg", "batch_id")
    rows = o.withColumn("subscriber", F.explode(F.array(*(F.lit(k).cast("long") for k in range(2))))).where("not (subscriber = 1 and batch_id % 911 = 37)")
    rows = rows.select("subscriber", (F.col("total_order") * 10 + (F.col("batch_id") * 7) % 300).alias("arrival"), "total_order", F.col("num_msg").alias("num_messages"), (F.col("batch_id") % 5003 == 4000).alias("gap"))
    again = rows.where("total_order % 83 = 5 and not gap").withColumn("arrival", F.col("arrival") + 2000)
    return rows.unionByName(again)


_SQL_SUBSCRIBERS = SQL_BATCHES + """, o as (select batch_id, num_msg, (sum(num_msg) over (order by epoch, broker_id, pbr_index rows unbounded preceding) - num_msg)::bigint as total_order from batches),
r as (select k as subscriber, total_order * 10 + (batch_id * 7) % 300 as arrival, total_order, num_msg as num_messages, batch_id % 5003 = 4000 as gap from o, range(2) t(k) where not (k = 1 and batch_id % 911 = 37)),
frames as (select * from r union all select subscriber, arrival + 2000, total_order, num_messages, gap from r where total_order % 83 = 5 and not gap)"""


def _requests(s, d):
    """Requests to create and delete 50 topics, in the order of events."""
    e = F.col("event_id")
    system = F.when(e % 5 == 0, "CORFU").when(e % 7 == 0, "SCALOG").otherwise("NATIVE")
    ord_ = F.when(e % 5 == 0, F.when(e % 35 == 0, 5).otherwise(2)).when(e % 7 == 0, 1).otherwise((e % 3) * 2)
    return events(s, d).select((e * 13 % 50).alias("topic"), e.alias("at"), F.when(e % 9 == 4, "delete").otherwise("create").alias("action"), (e % 4 - F.when(e % 4 == 3, 2).otherwise(0)).alias("ack"), (e % 3).alias("factor"), ord_.alias("ord"), system.alias("sequencer"))


_SQL_REQUESTS = """q as (select event_id * 13 % 50 as topic, event_id as at_, case when event_id % 9 = 4 then 'delete' else 'create' end as action, event_id % 4 - case when event_id % 4 = 3 then 2 else 0 end as ack, event_id % 3 as factor,
  case when event_id % 5 = 0 then case when event_id % 35 = 0 then 5 else 2 end when event_id % 7 = 0 then 1 else (event_id % 3) * 2 end as ord, case when event_id % 5 = 0 then 'CORFU' when event_id % 7 = 0 then 'SCALOG' else 'NATIVE' end as sequencer from events),
v as (select *, case when ack = 2 and factor < 2 then 'ACK level 2 requires replication_factor>=2 (RF includes the CXL primary; got replication_factor=' || factor || ')' when sequencer = 'CORFU' and ord <> 2 then 'sequencer needs order 2' end as err, count(*) filter (action = 'delete') over (partition by topic order by at_ rows between unbounded preceding and 1 preceding) as life from q),
w as (select *, min(case when action = 'create' and err is null then at_ end) over (partition by topic, life) as first from v),
a as (select w.*, case when w.action = 'delete' then case when w.first is null then 'UNKNOWN' else 'DELETED' end when w.err is not null then w.err when w.at_ = w.first then 'CREATED' when w.ack = f.ack and w.factor = f.factor and w.ord = f.ord and w.sequencer = f.sequencer then 'EXISTS' else 'CONFLICT' end as answer
  from w left join q f on f.at_ = w.first)"""


QUERIES = {
    "frame_messages": (
        lambda s, d: frames.parse(frames.encode(_frames(s, d), 777)).select("connection", "total_order", "client_id", "client_order", "batch_seq", "size", "gap", "valid"),
        f"""with {_SQL_FRAMES}, m as (select *, unnest(range(num_msg)) as k from f where bad is null or t < bad)
select client_id as connection, t + k as total_order, client_id, case when client_id % 2 = 0 then k end as client_order, case when client_id % 2 = 1 then batch_seq end as batch_seq, 1 + batch_id % 150 as size, batch_seq % 11 = 10 and k = 0 as gap, true as valid from m
union all select client_id, t, null, null, null, null, false, false from f where t = bad""",
    ),
    "frame_checks": (
        lambda s, d: batches(s, d).select("batch_id", frames.stride(F.col("latency_us") % 5000).alias("stride"), frames.valid_v1(F.col("latency_us") % 5000 * F.when(F.col("batch_id") % 2 == 0, 64).otherwise(1), F.col("latency_us") * 3).alias("v1"), frames.valid_v2(F.col("latency_us") * F.col("batch_id") % 2_000_000, F.col("batch_id") * 400).alias("v2"), frames.valid_batch(F.col("batch_id") % 4, F.col("latency_us") % 20_000).alias("header")),
        f"""with {SQL_BATCHES}, x as (select *, latency_us % 5000 * case when batch_id % 2 = 0 then 64 else 1 end as p, latency_us * batch_id % 2000000 as z from batches)
select batch_id, (latency_us % 5000 + 127) // 64 * 64 as stride, p >= 64 and p <= 1048640 and p % 64 = 0 and p <= latency_us * 3 as v1, z > 0 and z <= 1048576 and (z + 127) // 64 * 64 <= batch_id * 400 as v2, batch_id % 4 in (1, 2) and latency_us % 20000 between 1 and 10000 as header from x""",
    ),
    "trial_files": (_trial_files, f"with {_SQL_TRIALS} select broker_id as system, load, trial, case when trial % 7 <> 3 then round(us, 3) end as us from trials"),
    "appended_results": (_appended, f"with {SQL_BATCHES} select num_msg, count(*)::bigint as batches, max(latency_us) as slowest from batches group by num_msg"),
    "ingested_log": (
        lambda s, d: _ingested(s, d, batches(s, d).select("batch_id", "client_id", "batch_seq", "arrival"), "batch_id long, client_id long, batch_seq long, arrival long", 2, "arrival", lambda x: x),
        f"with {SQL_BATCHES} select batch_id, client_id, batch_seq, arrival from batches",
    ),
    "session_stream": (
        _session_stream,
        f"""with {_FENCES} select {_S}, batch_seq, 'release' as event, release as tick from prefix left join fences using ({_S}) where fence_seq is null or batch_seq < fence_seq
union all select {_S}, fence_seq, 'fence', fence_tick from fences""",
    ),
    "subscriber_reorder": (
        lambda s, d: reorder.delivered(_subscribers(s, d)).select("subscriber", "arrival", "total_order", "num_messages", "state"),
        f"""with {_SQL_SUBSCRIBERS}, g as (select subscriber, arg_max(total_order, (arrival, total_order)) as anchor from frames where gap group by subscriber),
l as (select f.*, coalesce(anchor, 0) as anchor, row_number() over (partition by subscriber, total_order order by arrival) = 1 and total_order >= coalesce(anchor, 0) as live from frames f left join g using (subscriber)),
s as (select *, anchor + coalesce(sum(num_messages) over (partition by subscriber, live order by total_order rows between unbounded preceding and 1 preceding), 0) as reach from l)
select subscriber, arrival, total_order, num_messages, case when not live then 'stale' when reach = total_order then 'delivered' else 'waiting' end as state from s""",
    ),
    "topic_requests": (lambda s, d: topics.answered(_requests(s, d)).select("topic", F.col("at").alias("asked"), "action", "answer"), f"with {_SQL_REQUESTS} select topic, at_ as asked, action, answer from a"),
    "topic_catalog": (
        lambda s, d: topics.alive(topics.answered(_requests(s, d))),
        f"""with {_SQL_REQUESTS}, l as (select topic, max(at_) filter (answer = 'DELETED') as gone, max(at_) filter (answer = 'CREATED') as c from a group by topic)
select l.topic, ack, factor, ord, sequencer from l join q on q.at_ = l.c where gone is null or gone < c""",
    ),
}
