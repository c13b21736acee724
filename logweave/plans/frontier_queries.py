"""Queries on frontiers, acknowledgements, baseline sequencers and the key-value machine, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.operators import baselines, frontier, ordering, state
from logweave.plans.ordering_queries import _ORDER5, _PREFIX, _S
from logweave.sources.derived import SQL_BATCHES, SQL_FAULTY, SQL_KV_ROWS, SQL_REPLICA_DONE, batches, events, faulty, kv_log, replica_done

_LEVELS = [(a, o, q) for a in (0, 1, 2) for o, q in ((0, "NATIVE"), (2, "NATIVE"), (5, "NATIVE"), (1, "SCALOG"), (2, "LAZYLOG"), (2, "CORFU"))]
_SQL_LEVELS = "levels as (select * from (values " + ", ".join(f"({a}, {o}, '{q}')" for a, o, q in _LEVELS) + ") l(ack, ord, sequencer))"


def _frontier(s, d):
    b = F.col("broker_id")
    sums = batches(s, d).groupBy("broker_id").agg(F.sum("num_msg").alias("written"))
    return sums.select("broker_id", "written", (F.col("written") - b * 5 - 20).alias("ordered"), (F.col("written") - b * 9 - 30).alias("cv_durable"))


_SQL_FRONTIER = f"""{SQL_REPLICA_DONE}, {_SQL_LEVELS},
frontier as (select broker_id, sum(num_msg)::bigint as written, (sum(num_msg) - broker_id * 5 - 20)::bigint as ordered, (sum(num_msg) - broker_id * 9 - 30)::bigint as cv_durable from batches group by broker_id),
least_done as (select broker_id, case when count(last_offset) = count(*) then min(last_offset) + 1 end as durable_next from replica_done group by broker_id)"""


def _levels(s):
    return s.createDataFrame([(a, o, q) for a, o, q in _LEVELS], "ack int, ord int, sequencer string")


def _cuts(s, d):
    """Cumulative cuts of two replicas; the second is a round behind, and some reports are missing."""
    by = batches(s, d).groupBy("broker_id", "epoch").agg(F.sum("num_msg").alias("n"))
    w = Window.partitionBy("broker_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    cum = by.select("broker_id", "epoch", F.sum("n").over(w).alias("cut_cum"))
    two = cum.select("broker_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("replica"), "epoch", "cut_cum")
    return two.select((F.col("epoch") + F.col("replica")).alias("round"), "broker_id", "replica", "cut_cum").where("(round * 3 + broker_id + replica) % 7 <> 0")


_SQL_CUTS = (
    SQL_BATCHES
    + """,
cum as (select broker_id, epoch, sum(sum(num_msg)) over (partition by broker_id order by epoch) as cut_cum from batches group by broker_id, epoch),
local_cuts as (select epoch + r as round, broker_id, r as replica, cut_cum from cum, (values (0), (1)) t(r) where ((epoch + r) * 3 + broker_id + r) % 7 <> 0),
held as (select g.round, s.broker_id, s.replica, max(l.cut_cum) over (partition by s.broker_id, s.replica order by g.round) as cut_cum
  from (select distinct round from local_cuts) g cross join (select distinct broker_id, replica from local_cuts) s left join local_cuts l on l.round = g.round and l.broker_id = s.broker_id and l.replica = s.replica),
cuts as (select round, broker_id, min(cut_cum)::bigint as cut_cum from held where round in (select round from held group by round having count(cut_cum) = 8) group by round, broker_id)"""
)


def _progress(s, d):
    by = batches(s, d).groupBy("broker_id", "epoch").agg(F.sum("num_msg").alias("n"))
    w = Window.partitionBy("broker_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return by.select(F.col("epoch").alias("round"), "broker_id", F.sum("n").over(w).alias("progress_cum")).where("(round + broker_id) % 5 <> 0")


_SQL_BINDINGS = (
    SQL_BATCHES
    + """,
cum as (select broker_id, epoch, sum(sum(num_msg)) over (partition by broker_id order by epoch) as p from batches group by broker_id, epoch),
progress as (select * from cum where (epoch + broker_id) % 5 <> 0),
held as (select g.epoch, s.broker_id, max(l.p) over (partition by s.broker_id order by g.epoch) as p
  from (select distinct epoch from progress) g cross join (select distinct broker_id from progress) s left join progress l using (epoch, broker_id)),
bindings as (select epoch as round, broker_id, (p - coalesce(lag(p) over (partition by broker_id order by epoch), 0))::bigint as delta from held where epoch in (select epoch from held group by epoch having count(p) = 4))"""
)


def _slot_writes(s, d):
    return batches(s, d).select("broker_id", F.expr("pbr_index div 2").alias("slot"), "arrival", "batch_id", (F.col("batch_id") % 3).alias("content"))


def _appends(s, d):
    rows = batches(s, d).select("broker_id", "pbr_index", "batch_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(1))).alias("replica"))
    odd = F.when((F.col("batch_id") % 41 == 0) & (F.col("replica") == 1), 1).otherwise(0)
    return rows.where("not (batch_id % 37 = 0 and replica = 1)").select("broker_id", F.col("pbr_index").alias("slot"), "replica", (F.col("batch_id") + odd).alias("content"))


def _fifo_values(s, d):
    rows = batches(s, d)
    key, version = F.col("client_id"), F.col("batch_seq")
    text = F.when(F.col("batch_id") % 53 == 0, "bad value").otherwise(state.fifo_value(key, version, 48))
    return rows.withColumn("value", text).withColumn("p", state.parsed_fifo(F.col("value")))


_STATE = f"{SQL_KV_ROWS}, last as (select * from (select *, row_number() over (partition by key order by total_order desc, pos desc) as r from pairs) where r = 1), kv_state as (select key, value, total_order from last where op <> 'DELETE')"


def _cas_ops(s, d):
    e = events(s, d)
    return e.select((F.col("event_id") % 97).alias("key"), F.col("event_id").alias("place"), F.expr("event_id div 97 - case when event_id % 11 = 0 then 1 else 0 end").alias("expected"), F.expr("event_id div 97 + 1").alias("new"))


def _ycsb(s, d):
    draw = (F.col("event_id") * 7919 + 13) % 100
    loads = F.explode(F.array(*map(F.lit, state.WORKLOADS)))
    rows = events(s, d).select("event_id", draw.alias("draw"), loads.alias("workload"))
    return rows.groupBy("workload", state.workload_op(F.col("workload"), F.col("draw")).alias("op")).agg(F.count("*").alias("ops"))


_YCSB_CASE = " ".join(
    f"when workload = '{w}' and draw < {edge} then '{kind}'"
    for w, shares in state.WORKLOADS.items()
    for edge, kind, share in ((sum(shares[: k + 1]), kind, shares[k]) for k, kind in enumerate(("read", "update", "insert", "scan", "rmw")))
    if share
)


def _scalars(s, d):
    c = F.col
    size = c("num_msg") * 100 + 7
    return batches(s, d).select(
        "batch_id",
        (F.expr("((num_msg * 100 + 7 + 63) div 64) * 64")).alias("aligned"),
        (F.shiftleft(c("client_id"), 32).bitwiseOR(c("session_epoch"))).alias("session_key"),
        F.shiftrightunsigned(F.shiftleft(c("client_id"), 32).bitwiseOR(c("session_epoch")), 32).alias("unpacked_client"),
        (F.shiftleft(c("broker_id"), 48).bitwiseOR(c("pbr_index"))).alias("global_batch_id"),
        F.when(c("batch_seq") > 0, c("batch_seq") - 1).alias("committed_hwm"),
        F.when(c("session_epoch") == 0, 1).otherwise(c("session_epoch") + 1).cast("long").alias("next_epoch"),
        F.least(F.lit(250), c("num_msg") * 100).cast("long").alias("forced_lease"),
        (c("num_msg").between(1, 10000) & (size <= 1048576)).alias("valid_batch"),
        ((c("num_msg") * 100 + 7) % 64 == 0).alias("whole_lines"),
        F.concat(F.lit("k"), F.lpad(c("client_id").cast("string"), 12, "0")).alias("key"),
        (c("batch_id") % 1024 == 0).alias("sampled"),
    )


_CORFU = f"""{SQL_FAULTY}, c as (select *, row_number() over (partition by {_S}, batch_seq order by arrival, batch_id, broker_id) as copy from faulty),
f as (select *, row_number() over (partition by client_id, broker_id order by batch_seq) - 1 as stream_seq from c where copy = 1),
g as (select *, max(arrival) over (partition by client_id, broker_id order by stream_seq rows unbounded preceding) as granted from f)"""

QUERIES = {
    "ack_offsets": (
        lambda s, d: frontier.ack_offsets(_frontier(s, d), replica_done(s, d), _levels(s)).select("broker_id", F.col("ack").cast("long"), F.col("ord").cast("long"), "sequencer", "ack_next"),
        f"""with {_SQL_FRONTIER} select broker_id, ack::bigint as ack, ord::bigint as ord, sequencer, (case when ack = 0 then null when ack = 1 and ord = 0 then written when ack = 1 then ordered when ord = 5 then cv_durable
  when durable_next is null then null when sequencer in ('SCALOG', 'LAZYLOG') then least(durable_next, ordered) else durable_next end)::bigint as ack_next from frontier left join least_done using (broker_id) cross join levels""",
    ),
    "ack2_clamp": (
        lambda s, d: frontier.min_replicated(replica_done(s, d)).join(_frontier(s, d), "broker_id").select("broker_id", F.when(F.col("durable_next").isNotNull(), F.least("durable_next", "ordered")).alias("clamped"), (F.col("durable_next") > F.col("ordered")).alias("ahead")),
        f"with {_SQL_FRONTIER} select broker_id, case when durable_next is not null then least(durable_next, ordered) end as clamped, durable_next > ordered as ahead from frontier join least_done using (broker_id)",
    ),
    "durable_frontier": (
        lambda s, d: frontier.durable_frontier(ordering.order5(batches(s, d)), F.col("batch_id") % 643 != 642),
        f"""with {_ORDER5}, h as (select broker_id, min(case when batch_id % 643 = 642 then goi end) as hole from order5 group by broker_id)
select broker_id, hole, coalesce(sum(case when hole is null or goi < hole then num_msg end), 0)::bigint as durable_messages, max(case when hole is null or goi < hole then goi end) as durable_goi from order5 join h using (broker_id) group by broker_id, hole""",
    ),
    "durable_credit": (
        lambda s, d: frontier.durable_credit(ordering.order0(batches(s, d)), frontier.min_replicated(replica_done(s, d))),
        f"""with {_SQL_FRONTIER}, o as (select *, sum(num_msg) over (partition by broker_id order by pbr_index rows unbounded preceding) as e from batches)
select client_id, sum(num_msg)::bigint as credited, count(*)::bigint as batches from o join least_done using (broker_id) where e <= durable_next group by client_id""",
    ),
    "client_acks": (
        lambda s, d: ordering.release(faulty(s, d)).groupBy("client_id", "session_epoch").agg(F.sum("num_msg").alias("ordered"), F.max("batch_seq").alias("hwm")),
        f"with {_PREFIX} select {_S}, sum(num_msg)::bigint as ordered, max(batch_seq) as hwm from prefix group by {_S}",
    ),
    "ack_rf_policy": (
        lambda s, d: s.range(4).select((F.col("id") - 1).alias("ack")).join(s.range(5).select((F.col("id") - 1).alias("factor"))).join(_levels(s).select("ord", "sequencer").distinct()).select("ack", "factor", F.col("ord").cast("long"), "sequencer", frontier.policy_error(F.col("ack"), F.col("factor"), F.col("ord"), F.col("sequencer")).alias("error")),
        """with g as (select a - 1 as ack, f - 1 as factor, ord, sequencer from range(4) x(a), range(5) y(f), (values (0, 'NATIVE'), (2, 'NATIVE'), (5, 'NATIVE'), (1, 'SCALOG'), (2, 'LAZYLOG'), (2, 'CORFU')) l(ord, sequencer))
select ack, factor, ord::bigint as ord, sequencer, case when ack not between 0 and 2 then 'ack_level must be 0, 1, or 2 (got ' || ack || ')' when factor < 0 then 'replication_factor must be >= 0 (got ' || factor || ')' when ack = 2 and factor < 2 then 'ACK level 2 requires replication_factor>=2 (RF includes the CXL primary; got replication_factor=' || factor || ')'
  when sequencer in ('CORFU', 'LAZYLOG') and ord <> 2 then 'sequencer needs order 2' when sequencer = 'SCALOG' and ord <> 1 then 'sequencer needs order 1' end as error from g""",
    ),
    "replica_roles": (lambda s, d: frontier.replica_roles(4, 2, s), "select b as broker_id, r as role, (b + r) % 4 as replica from range(4) x(b), range(2) y(r)"),
    "chain_valid": (
        lambda s, d: frontier.chain_valid(batches(s, d).select("batch_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("role")).where("not (batch_id % 19 = 0 and role = 1) and not (batch_id % 23 = 0 and role = 2)"), 3),
        f"with {SQL_BATCHES}, x as (select batch_id, case when batch_id % 19 = 0 then 1 when batch_id % 23 = 0 then 2 else 3 end::bigint as chain from batches) select batch_id, chain, chain >= 3 as durable from x",
    ),
    "ack_match": (
        lambda s, d: frontier.first_ack(
            batches(s, d).withColumn("end_count", F.sum("num_msg").over(Window.partitionBy("client_id").orderBy("batch_seq").rowsBetween(Window.unboundedPreceding, 0))).select("client_id", "batch_seq", "end_count", F.col("arrival").alias("sent")),
            batches(s, d).withColumn("acked", F.sum("num_msg").over(Window.partitionBy("client_id").orderBy("batch_seq").rowsBetween(Window.unboundedPreceding, 0))).where("batch_seq % 3 = 2").select("client_id", "acked", (F.col("batch_id") + 1500).alias("ack_time")),
        ),
        f"""with {SQL_BATCHES}, n as (select *, sum(num_msg) over (partition by client_id order by batch_seq rows unbounded preceding) as e from batches),
a as (select client_id, e as acked, batch_id + 1500 as t from n where batch_seq % 3 = 2)
select n.client_id, n.batch_seq, n.arrival as sent, min(t) as acked_at, min(t) - n.arrival as latency from n left join a on a.client_id = n.client_id and a.acked >= n.e group by n.client_id, n.batch_seq, n.arrival""",
    ),
    "scalar_functions": (
        _scalars,
        f"""with {SQL_BATCHES} select batch_id, ((num_msg * 100 + 7 + 63) // 64) * 64 as aligned, (client_id << 32) | session_epoch as session_key, client_id as unpacked_client, (broker_id << 48) | pbr_index as global_batch_id,
case when batch_seq > 0 then batch_seq - 1 end as committed_hwm, case when session_epoch = 0 then 1 else session_epoch + 1 end as next_epoch, least(250, num_msg * 100) as forced_lease, num_msg between 1 and 10000 and num_msg * 100 + 7 <= 1048576 as valid_batch,
(num_msg * 100 + 7) % 64 = 0 as whole_lines, 'k' || lpad(client_id::varchar, 12, '0') as key, batch_id % 1024 = 0 as sampled from batches""",
    ),
    "corfu_tokens": (
        lambda s, d: baselines.token_grants(faulty(s, d)).select("batch_id", "granted", "status", "total_order", "log_index", "broker_batch_seq").unionByName(baselines.repeated_requests(faulty(s, d)).select("batch_id", F.lit(None).cast("long").alias("granted"), "status", *(F.lit(None).cast("long").alias(c) for c in ("total_order", "log_index", "broker_batch_seq")))),
        f"""with {_CORFU} select batch_id, granted, case when granted = arrival then 'GRANTED' else 'OUT_OF_ORDER' end as status, (sum(num_msg) over a - num_msg)::bigint as total_order, (sum(num_msg) over b * 64 - num_msg * 64)::bigint as log_index, (row_number() over b - 1)::bigint as broker_batch_seq
from g window a as (order by granted, client_id, broker_id, stream_seq rows unbounded preceding), b as (partition by broker_id order by granted, client_id, broker_id, stream_seq rows unbounded preceding)
union all select batch_id, null, 'ALREADY_PROCESSED', null, null, null from c where copy > 1""",
    ),
    "corfu_write_once": (
        lambda s, d: baselines.write_once(_slot_writes(s, d)),
        f"""with {SQL_BATCHES}, w as (select broker_id, pbr_index // 2 as slot, batch_id, batch_id % 3 as content, arrival from batches)
select broker_id, slot, batch_id, case when row_number() over f = 1 then 'WRITTEN' when content = first_value(content) over f then 'ALREADY_SAME' else 'CONFLICT' end as status from w window f as (partition by broker_id, slot order by arrival, batch_id)""",
    ),
    "scalog_cuts": (lambda s, d: baselines.global_cuts(_cuts(s, d), 4, 2), f"with {_SQL_CUTS} select * from cuts"),
    "scalog_order": (
        lambda s, d: baselines.ordered_slices(baselines.cut_deltas(baselines.global_cuts(_cuts(s, d), 4, 2))),
        f"with {_SQL_CUTS}, x as (select round, broker_id, cut_cum - coalesce(lag(cut_cum) over (partition by broker_id order by round), 0) as delta from cuts) select round, broker_id, delta, (sum(delta) over (order by round, broker_id rows unbounded preceding) - delta)::bigint as total_order from x",
    ),
    "lazylog_bindings": (lambda s, d: baselines.bindings(_progress(s, d), 4), f"with {_SQL_BINDINGS} select * from bindings"),
    "lazylog_order": (
        lambda s, d: baselines.ordered_slices(baselines.bindings(_progress(s, d), 4)),
        f"with {_SQL_BINDINGS} select round, broker_id, delta, (sum(delta) over (order by round, broker_id rows unbounded preceding) - delta)::bigint as total_order from bindings",
    ),
    "lazylog_metadata": (
        lambda s, d: baselines.metadata_replicas(_appends(s, d), 2).groupBy("broker_id", "status").agg(F.count("*").alias("slots")),
        f"""with {SQL_BATCHES}, a as (select broker_id, pbr_index as slot, r as replica, batch_id + case when batch_id % 41 = 0 and r = 1 then 1 else 0 end as content from batches, (values (0), (1), (1)) t(r) where not (batch_id % 37 = 0 and r = 1)),
m as (select broker_id, slot, case when count(distinct content) > 1 then 'CONFLICT' when count(distinct replica) >= 2 then 'COMPLETE' else 'PENDING' end as status from a group by broker_id, slot) select broker_id, status, count(*)::bigint as slots from m group by all""",
    ),
    "kv_state": (lambda s, d: state.apply(kv_log(s, d)), f"with {_STATE} select * from kv_state"),
    "kv_scan": (
        lambda s, d: state.scan(state.apply(kv_log(s, d)), s.range(0, 501, 10).select(F.col("id").alias("start")), 5, 501),
        f"with {_STATE}, w as (select a * 10 as start, b as step, 'k' || lpad(((a * 10 + b) % 501)::varchar, 12, '0') as key from range(51) x(a), range(5) y(b)) select start, step, w.key, coalesce(value, '') as value from w left join kv_state using (key)",
    ),
    "kv_digest": (
        lambda s, d: state.digest(state.apply(kv_log(s, d))),
        f"with {_STATE} select count(*)::bigint as keys, (sum(('0x' || substr(md5(key || '=' || value), 1, 15))::bigint::hugeint) % 18446744073709551616::hugeint)::varchar as digest from kv_state",
    ),
    "kv_rmw": (
        lambda s, d: state.read_modify_write(state.writes(kv_log(s, d)).select("key"), "init", "|rmw", 64),
        f"with {_STATE} select key, substr('init' || repeat('|rmw', least(count(*), 64)::int), 1, 64) as value, count(*)::bigint as ops from pairs group by key",
    ),
    "kv_fifo_audit": (
        lambda s, d: state.fifo_audit(_fifo_values(s, d).where("p is not null").select(F.col("p.key").alias("key"), F.col("p.version").alias("version"), F.struct("arrival", "batch_id").alias("place")), ["key"], "version", "place"),
        f"""with {SQL_BATCHES}, x as (select client_id as key, batch_seq < max(batch_seq) over (partition by client_id order by arrival, batch_id rows between unbounded preceding and 1 preceding) as r from batches where batch_id % 53 <> 0)
select key, count(*)::bigint as applied, coalesce(sum(r::int), 0)::bigint as reorders from x group by key""",
    ),
    "kv_malformed": (
        lambda s, d: _fifo_values(s, d).groupBy("broker_id").agg(F.count("*").alias("entries"), F.sum(F.col("p").isNull().cast("long")).alias("malformed"), F.max("batch_id").alias("last_applied")),
        f"with {SQL_BATCHES} select broker_id, count(*)::bigint as entries, sum((batch_id % 53 = 0)::int)::bigint as malformed, max(batch_id) as last_applied from batches group by broker_id",
    ),
    "kv_cas_audit": (
        lambda s, d: state.compare_and_set(_cas_ops(s, d)),
        """with recursive o as (select event_id % 97 as key, row_number() over (partition by event_id % 97 order by event_id) as i, event_id // 97 - case when event_id % 11 = 0 then 1 else 0 end as expected, event_id // 97 + 1 as new from events),
f as (select key, 0::bigint as i, 0::bigint as version, 0::bigint as committed, 0::bigint as rejected from o where i = 1
  union all select f.key, o.i, case when version = expected then new else version end, committed + (version = expected)::int, rejected + (version <> expected)::int from f join o on o.key = f.key and o.i = f.i + 1)
select key, arg_max(committed, i) as committed, arg_max(rejected, i) as rejected, arg_max(version, i) as version from f group by key""",
    ),
    "ycsb_mix": (
        _ycsb,
        f"with x as (select (event_id * 7919 + 13) % 100 as draw, unnest(['A', 'B', 'C', 'D', 'E', 'F']) as workload from events) select workload, case {_YCSB_CASE} end as op, count(*)::bigint as ops from x group by all",
    ),
    "zipf_keys": (
        lambda s, d: state.zipf_draws(events(s, d).select(((F.col("event_id") * 104729) % 1000000).alias("draw")), state.zipf_table(s, 200, 0.99)).groupBy("rank").agg(F.count("*").alias("draws")),
        """with t as (select r as rank, 1 / pow(r, 0.99) as p from range(1, 201) x(r)), c as (select rank, round(sum(p) over (order by rank) / sum(p) over () * 1e6)::bigint as high from t),
b as (select rank, coalesce(lag(high) over (order by rank), 0) as low, high from c) select rank, count(*)::bigint as draws from events, b where (event_id * 104729) % 1000000 >= low and (event_id * 104729) % 1000000 < high group by rank""",
    ),
    "zipf_latest": (
        lambda s, d: events(s, d).select(F.when((F.col("event_id") * 7919) % 100 < 80, F.expr("800 + (event_id * 31) % 200")).otherwise(F.expr("(event_id * 31) % 800")).alias("k")).groupBy(F.expr("k div 200").alias("fifth")).agg(F.count("*").alias("draws")),
        "select (case when (event_id * 7919) % 100 < 80 then 800 + (event_id * 31) % 200 else (event_id * 31) % 800 end) // 200 as fifth, count(*)::bigint as draws from events group by 1",
    ),
}
