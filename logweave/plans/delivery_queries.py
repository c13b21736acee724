"""Queries on delivery, client bookkeeping and parsing, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.operators import delivery, faults, frontier, ordering, state
from logweave.plans.frontier_queries import _STATE
from logweave.plans.ordering_queries import LEASE, _FENCES, _FIRST, _GOI, _ORDER5, _S, _goi
from logweave.sources.derived import SQL_BATCHES, batches, events, faulty, kv_log


def _sessions(s, d):
    log = faulty(s, d)
    done = ordering.release(log).groupBy("client_id", "session_epoch").agg((F.max("batch_seq") + 1).alias("n"))
    fences = faults.session_fences(log, LEASE).select("client_id", "session_epoch", F.lit(True).alias("f"))
    every = log.select("client_id", "session_epoch").distinct().join(done, ["client_id", "session_epoch"], "left").join(fences, ["client_id", "session_epoch"], "left")
    return every.select("client_id", "session_epoch", F.coalesce("n", F.lit(0)).cast("long").alias("expected_seq"), F.coalesce("f", F.lit(False)).alias("fenced"), (F.col("client_id") % 10 != 9).alias("active"))


_SESSIONS = (
    _FENCES
    + f""",
sessions as (select e.client_id, e.session_epoch, coalesce(n, 0)::bigint as expected_seq, f.fence_seq is not null as fenced, e.client_id % 10 <> 9 as active from (select distinct {_S} from faulty) e
  left join (select {_S}, max(batch_seq) + 1 as n from prefix group by {_S}) using ({_S}) left join fences f using ({_S}))"""
)


def _replicas(log):
    """Digests of two replicas: one applies the log as it is, the other a delivery dealt by client, with every third entry twice."""
    again = log.unionByName(log.where("total_order % 3 = 0"))
    states = [state.apply(log), state.apply_in_parts(again, F.col("client_id"))]
    a, b = (x.withColumn("replica", F.lit(k).cast("long")) for k, x in enumerate(states))
    return state.digest(a.unionByName(b), "replica")


def _lines(s, d):
    """Log lines as a tool would print them."""
    e = events(s, d)
    stamp = F.concat(F.lit("I20260718 "), F.lpad(F.expr("event_id div 3600 % 24").cast("string"), 2, "0"), F.lit(":"), F.lpad(F.expr("event_id div 60 % 60").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))
    return e.select("event_id", F.concat(stamp, F.lit(" [COMMIT] client="), F.col("user_id").cast("string"), F.lit(" rate="), (F.col("event_id") % 90).cast("string"), F.lit(".5 GB/s")).alias("line"))


_CORE = "client_id, session_epoch, batch_seq"

QUERIES = {
    "sealed_batches": (
        lambda s, d: delivery.sealed_batches(batches(s, d).select("client_id", "broker_id", F.col("batch_id").alias("message"), (F.col("num_msg") * 100).alias("size")), 8),
        f"with {SQL_BATCHES}, m as (select client_id, broker_id, num_msg * 100 as size, (row_number() over (partition by client_id, broker_id order by batch_id) - 1) // 8 as batch_seq from batches) select client_id, broker_id, batch_seq, count(*)::bigint as num_msg, sum(size)::bigint as total_size from m group by client_id, broker_id, batch_seq",
    ),
    "export_scan": (lambda s, d: delivery.export_scan(ordering.order5(batches(s, d)), 2, 99, 700).select("goi", "batch_id", "total_order"), f"with {_ORDER5} select goi, batch_id, total_order from order5 where broker_id = 2 and goi between 100 and 700"),
    "next_batch": (lambda s, d: delivery.next_batch(ordering.order5(batches(s, d)), 500, 64).select("goi", "batch_id", "total_order"), f"with {_ORDER5} select goi, batch_id, total_order from order5 where total_order >= 500 order by total_order limit 64"),
    "spatial_guard": (
        lambda s, d: delivery.reject_behind(faulty(s, d), _sessions(s, d)).select("batch_id", "arrival", "fenced", "expected_seq"),
        f"with {_SESSIONS} select batch_id, arrival, fenced, expected_seq from faulty join sessions using ({_S}) where active and (fenced or batch_seq < expected_seq)",
    ),
    "ack_guards": (
        lambda s, d: _sessions(s, d).select("client_id", "session_epoch", delivery.withheld(F.when(F.col("client_id") % 4 != 0, F.col("client_id") % 5), F.lit(3)).alias("withheld"), delivery.terminal_fence(F.col("client_id") % 20, F.when(F.col("expected_seq") > 0, F.col("expected_seq") - 1)).alias("terminal")),
        f"with {_SESSIONS} select {_S}, coalesce(case when client_id % 4 <> 0 then client_id % 5 end < 3, false) as withheld, expected_seq = 0 or client_id % 20 > expected_seq - 1 as terminal from sessions",
    ),
    "open_answers": (lambda s, d: delivery.open_answer(_sessions(s, d)), f"with {_SESSIONS} select {_S}, case when fenced then 'FENCED' else 'OK' end as answer, case when expected_seq > 0 then expected_seq - 1 end as committed_hwm from sessions"),
    "client_ledger": (
        lambda s, d: delivery.ledger(batches(s, d), batches(s, d).groupBy("client_id", "session_epoch").agg((F.sum("num_msg") - F.col("client_id") % 40).alias("acked"))).select("client_id", "session_epoch", "batch_seq", "end_count", "retired", "resend"),
        f"""with {SQL_BATCHES}, a as (select {_S}, sum(num_msg) - client_id % 40 as acked from batches group by {_S}), e as (select {_CORE}, sum(num_msg) over (partition by {_S} order by batch_seq) as end_count from batches),
r as (select {_CORE}, end_count, end_count <= acked as retired from e join a using ({_S})) select {_CORE}, end_count::bigint as end_count, retired, coalesce(batch_seq = min(case when not retired then batch_seq end) over (partition by {_S}), false) as resend from r""",
    ),
    "append_progress": (
        lambda s, d: delivery.append_progress(
            ordering.order0(batches(s, d)).select("broker_id", "pbr_index", (F.col("written") + F.col("num_msg")).alias("end"), (F.col("batch_id") % 701 != 700).alias("ready")),
            batches(s, d).groupBy("broker_id").agg((F.sum("num_msg") - F.col("broker_id") * 1900).alias("data_next")),
        ),
        f"""with {SQL_BATCHES}, o as (select broker_id, pbr_index, batch_id % 701 <> 700 as ready, sum(num_msg) over (partition by broker_id order by pbr_index) as e from batches),
h as (select broker_id, min(case when not ready then pbr_index end) as hole from o group by broker_id), n as (select broker_id, sum(num_msg) - broker_id * 1900 as data_next from batches group by broker_id)
select broker_id, max(e)::bigint as append_next, count(*)::bigint as batches from o join h using (broker_id) join n using (broker_id) where (hole is null or pbr_index < hole) and e <= data_next group by broker_id""",
    ),
    "rendezvous_brokers": (
        lambda s, d: delivery.rendezvous(events(s, d).select(F.col("user_id").alias("client_id")).distinct(), "client_id", 4, F.when(F.col("client_id") % 3 == 0, F.col("client_id") % 4)),
        """with c as (select distinct user_id as client_id from events), x as (select client_id, b as broker_id, md5(client_id || '-' || b) as w from c, range(4) r(b) where client_id % 3 <> 0 or b <> client_id % 4)
select client_id, broker_id from (select *, row_number() over (partition by client_id order by w desc, broker_id) as k from x) where k = 1""",
    ),
    "idle_sessions": (lambda s, d: delivery.idle_sessions(batches(s, d).where("client_id % 7 <> 0 or epoch < 20"), 90, 30), f"with {SQL_BATCHES} select {_S}, max(epoch) as last_epoch from batches where client_id % 7 <> 0 or epoch < 20 group by {_S} having 90 - max(epoch) > 30"),
    "overflow_skips": (
        lambda s, d: delivery.overflow_skips(ordering.release(batches(s, d)).where("release > arrival"), 30).select("batch_id", "epoch", "arrival"),
        f"with {_ORDER5}, h as (select *, row_number() over (partition by epoch order by arrival, batch_id) as i, count(*) over (partition by epoch) as n from order5 where release > arrival) select batch_id, epoch, arrival from h where i <= n - 30",
    ),
    "membership": (
        lambda s, d: delivery.membership(batches(s, d).where("broker_id <> 0 or epoch < 5").select("broker_id", F.col("epoch").alias("tick")), 100, 60),
        f"with {SQL_BATCHES}, l as (select broker_id, max(epoch) as last, 100 - max(epoch) <= 60 as alive from batches where broker_id <> 0 or epoch < 5 group by broker_id) select *, broker_id = (select min(broker_id) from l where alive) as is_head from l",
    ),
    "multi_get": (
        lambda s, d: s.range(0, 600, 7).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("key")).join(state.apply(kv_log(s, d)), "key").select("key", "value"),
        f"with {_STATE} select key, value from kv_state where substr(key, 2)::bigint % 7 = 0 and substr(key, 2)::bigint < 600",
    ),
    "replica_convergence": (
        lambda s, d: _replicas(kv_log(s, d)),
        f"with {_STATE}, d as (select count(*)::bigint as keys, (sum(('0x' || substr(md5(key || '=' || value), 1, 15))::bigint::hugeint) % 18446744073709551616::hugeint)::varchar as digest from kv_state) select r as replica, keys, digest from d, range(2) x(r)",
    ),
    "shard_loads": (lambda s, d: batches(s, d).groupBy((F.col("client_id") % 8).alias("shard")).agg(F.count("*").alias("batches"), F.count_distinct("client_id").alias("clients")), f"with {SQL_BATCHES} select client_id % 8 as shard, count(*)::bigint as batches, count(distinct client_id)::bigint as clients from batches group by 1"),
    "ring_order": (
        lambda s, d: batches(s, d).select("client_id", "batch_id", F.row_number().over(Window.partitionBy("client_id").orderBy(F.pmod(F.col("batch_seq") % 16 - 5, F.lit(16)), "batch_seq")).cast("long").alias("place")),
        f"with {SQL_BATCHES} select client_id, batch_id, row_number() over (partition by client_id order by (batch_seq % 16 - 5 + 16) % 16, batch_seq) as place from batches",
    ),
    "merged_streams": (
        lambda s, d: ordering.order2(batches(s, d)).select(F.col("goi").alias("place"), "broker_id", "total_order", "num_msg").orderBy("place"),
        f"with {SQL_BATCHES} select (row_number() over o - 1)::bigint as place, broker_id, (sum(num_msg) over o - num_msg)::bigint as total_order, num_msg from batches window o as (order by epoch, broker_id, pbr_index rows unbounded preceding)",
    ),
    "lost_batches": (
        lambda s, d: batches(s, d).select("batch_id").join(faulty(s, d).select("batch_id"), "batch_id", "left_anti"),
        f"with {_FIRST} select batch_id from batches where batch_id not in (select batch_id from firsts)",
    ),
    "log_lines": (
        lambda s, d: _lines(s, d).select(
            "event_id",
            F.unix_timestamp(F.to_timestamp(F.regexp_extract("line", r"^I(\d{8} \d\d:\d\d:\d\d)", 1), "yyyyMMdd HH:mm:ss")).alias("at"),
            F.regexp_extract("line", r"client=(\d+)", 1).cast("long").alias("client_id"),
            F.expr(r"try_cast(regexp_extract(line, 'rate=([0-9.]+)', 1) as double)").alias("rate"),
            F.sha2("line", 256).alias("sha256"),
        ),
        """with l as (select event_id, 'I20260718 ' || lpad((event_id // 3600 % 24)::varchar, 2, '0') || ':' || lpad((event_id // 60 % 60)::varchar, 2, '0') || ':' || lpad((event_id % 60)::varchar, 2, '0') || ' [COMMIT] client=' || user_id || ' rate=' || (event_id % 90) || '.5 GB/s' as line from events)
select event_id, epoch(strptime(regexp_extract(line, '^I(\\d{8} \\d\\d:\\d\\d:\\d\\d)', 1), '%Y%m%d %H:%M:%S'))::bigint as at, regexp_extract(line, 'client=(\\d+)', 1)::bigint as client_id, regexp_extract(line, 'rate=([0-9.]+)', 1)::double as rate, sha256(line) as sha256 from l""",
    ),
    "isolation_manifest": (
        lambda s, d: _goi(s, d).groupBy("session_epoch").agg(F.count("*").alias("commits"), F.max("goi").alias("last")).select("session_epoch", F.to_json(F.struct("commits", "last")).alias("manifest")),
        f"""with {_GOI} select session_epoch, '{{"commits":' || count(*) || ',"last":' || max(goi) || '}}' as manifest from goi group by session_epoch""",
    ),
    "sampled_stages": (lambda s, d: batches(s, d).where("batch_seq % 16 = 0").groupBy("broker_id").agg(F.count("*").alias("samples"), F.max("latency_us").alias("slowest")), f"with {SQL_BATCHES} select broker_id, count(*)::bigint as samples, max(latency_us) as slowest from batches where batch_seq % 16 = 0 group by broker_id"),
    "uid_ranges": (lambda s, d: batches(s, d).groupBy("client_id").agg(F.count_distinct("batch_id").alias("uids"), F.min("batch_id").alias("first"), F.max("batch_id").alias("last"), F.bool_and(F.col("num_msg").between(1, 5)).alias("in_range")), f"with {SQL_BATCHES} select client_id, count(distinct batch_id)::bigint as uids, min(batch_id) as first, max(batch_id) as last, bool_and(num_msg between 1 and 5) as in_range from batches group by client_id"),
    "synced_frontier": (
        lambda s, d: frontier.durable_frontier(ordering.order5(batches(s, d)), (F.col("batch_id") % 997 != 996) & (F.col("epoch") < 60)).select("broker_id", "hole", "durable_messages"),
        f"""with {_ORDER5}, x as (select *, batch_id % 997 <> 996 and epoch < 60 as synced from order5), h as (select broker_id, min(case when not synced then goi end) as hole from x group by broker_id)
select broker_id, hole, coalesce(sum(case when hole is null or goi < hole then num_msg end), 0)::bigint as durable_messages from x join h using (broker_id) group by broker_id, hole""",
    ),
}
