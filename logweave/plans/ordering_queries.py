"""Queries on ordering, contracts and faults, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.operators import faults, ordering
from logweave.sources.derived import SQL_BATCHES, SQL_FAULTY, batches, faulty

LEASE = 2000
_S = "client_id, session_epoch"

_ORDER5 = (
    SQL_BATCHES
    + """,
rel as (select *, max(arrival) over w as release, max(epoch) over w as commit_epoch from batches window w as (partition by client_id, session_epoch order by batch_seq rows unbounded preceding)),
order5 as (select *, (row_number() over o - 1)::bigint as goi, (sum(num_msg) over o - num_msg)::bigint as total_order from rel window o as (order by commit_epoch, client_id, session_epoch, batch_seq rows unbounded preceding))"""
)
_FIRST = (
    SQL_FAULTY
    + f""",
firsts as (select * exclude (c) from (select *, row_number() over (partition by {_S}, batch_seq order by arrival, batch_id, broker_id) as c from faulty) where c = 1)"""
)
_PREFIX = (
    _FIRST
    + f""",
prefix as (select * exclude (p), max(arrival) over w as release, max(epoch) over w as commit_epoch
  from (select *, row_number() over (partition by {_S} order by batch_seq) - 1 as p from firsts) where p = batch_seq window w as (partition by {_S} order by batch_seq rows unbounded preceding))"""
)
_FENCES = (
    _PREFIX
    + f""",
seen as (select *, min(arrival) over (w rows between 1 following and unbounded following) as next_first, min(arrival) over (w rows between current row and unbounded following) as from_here,
  max(arrival) over (w rows between unbounded preceding and 1 preceding) as before, coalesce(lag(batch_seq) over (w), -1) as prev
  from firsts where session_epoch <> 0 window w as (partition by {_S} order by batch_seq)),
gaps as (select {_S}, batch_seq as missing, greatest(before, next_first) as gap_start, arrival from seen where prev + 1 = batch_seq and next_first < arrival
  union all select {_S}, prev + 1, greatest(before, from_here), null from seen where prev + 1 < batch_seq),
fences as (select {_S}, min(missing)::bigint as fence_seq, (arg_min(gap_start, missing) + {LEASE})::bigint as fence_tick, case when min(missing) > 0 then min(missing) - 1 end::bigint as committed_hwm
  from gaps where arrival is null or arrival > gap_start + {LEASE} group by {_S})"""
)
_GOI = (
    _FENCES
    + f""",
goi as (select *, (row_number() over o - 1)::bigint as goi, (sum(num_msg) over o - num_msg)::bigint as total_order from
  (select prefix.* from prefix left join fences using ({_S}) where fence_seq is null or batch_seq < fence_seq)
  window o as (order by commit_epoch, {_S}, batch_seq rows unbounded preceding))"""
)


def _goi(spark, d):
    return ordering.numbered(faults.fenced_release(faulty(spark, d), LEASE), "commit_epoch", [*ordering.SESSION, "batch_seq"])


def _fences(spark, d):
    return faults.session_fences(faulty(spark, d), LEASE)


def _replicated(spark, d):
    return batches(spark, d).where("batch_id % 7 <> 0").select("batch_id", (1 + F.col("batch_id") % 2).alias("num_replicated"), (F.col("arrival") + F.col("batch_id") % 300).alias("changed"))


_CORE = "batch_id, client_id, session_epoch, batch_seq, broker_id, num_msg"
_cols = [c.strip() for c in _CORE.split(",")]

QUERIES = {
    "order5_goi": (lambda s, d: ordering.order5(batches(s, d)).select(*_cols, "commit_epoch", "goi", "total_order"), f"with {_ORDER5} select {_CORE}, commit_epoch, goi, total_order from order5"),
    "order0_written": (
        lambda s, d: ordering.order0(batches(s, d)).select("broker_id", "pbr_index", "num_msg", "written"),
        f"with {SQL_BATCHES} select broker_id, pbr_index, num_msg, (sum(num_msg) over (partition by broker_id order by pbr_index rows unbounded preceding) - num_msg)::bigint as written from batches",
    ),
    "order1_roundrobin": (
        lambda s, d: ordering.order1(batches(s, d)).select("batch_id", "total_order", "last_message"),
        f"with {SQL_BATCHES}, o as (select batch_id, num_msg, sum(num_msg) over (order by epoch, broker_id, pbr_index rows unbounded preceding) as e from batches) select batch_id, (e - num_msg)::bigint as total_order, (e - 1)::bigint as last_message from o",
    ),
    "order2_total": (
        lambda s, d: ordering.order2(batches(s, d)).select("batch_id", "epoch", "goi", "total_order"),
        f"with {SQL_BATCHES} select batch_id, epoch, (row_number() over w - 1)::bigint as goi, (sum(num_msg) over w - num_msg)::bigint as total_order from batches window w as (order by epoch, broker_id, pbr_index rows unbounded preceding)",
    ),
    "order3_batches": (
        lambda s, d: ordering.order3(batches(s, d)).select("batch_id", "broker_id", "goi", "total_order"),
        f"with {SQL_BATCHES} select batch_id, broker_id, (row_number() over w - 1)::bigint as goi, (sum(num_msg) over w - num_msg)::bigint as total_order from batches window w as (order by pbr_index, broker_id rows unbounded preceding)",
    ),
    "order4_stream": (
        lambda s, d: ordering.order4(faulty(s, d)).select("batch_id", "broker_id", "stream_seq", "late", "commit_epoch", "goi", "total_order"),
        f"""with {SQL_FAULTY}, c as (select *, row_number() over (partition by {_S}, batch_seq order by arrival, batch_id, broker_id) as c from faulty),
f as (select *, (row_number() over (partition by {_S}, broker_id order by batch_seq) - 1)::bigint as stream_seq from c where c = 1),
r as (select batch_id, {_S}, broker_id, batch_seq, num_msg, stream_seq, false as late, max(epoch) over (partition by {_S}, broker_id order by stream_seq rows unbounded preceding) as commit_epoch from f
  union all select batch_id, {_S}, broker_id, batch_seq, num_msg, null, true, epoch from c where c > 1)
select batch_id, broker_id, stream_seq, late, commit_epoch, (row_number() over w - 1)::bigint as goi, (sum(num_msg) over w - num_msg)::bigint as total_order
from r window w as (order by commit_epoch, late, client_id, session_epoch, broker_id, batch_seq, batch_id rows unbounded preceding)""",
    ),
    "message_order": (
        lambda s, d: ordering.order_by_message(batches(s, d)),
        f"with {_ORDER5}, m as (select client_id, session_epoch, batch_seq, total_order, unnest(range(num_msg)) as message from order5) select client_id, session_epoch, batch_seq, message, total_order + message as total_order from m",
    ),
    "contract_violations": (
        lambda s, d: ordering.contract_violations(ordering.order2(batches(s, d)), ordering.SESSION).select("batch_id", "goi", "batch_seq", F.col("previous_seq").cast("long")),
        f"""with {SQL_BATCHES}, o as (select *, row_number() over (order by epoch, broker_id, pbr_index) - 1 as goi from batches),
l as (select *, lag(batch_seq) over (partition by {_S} order by goi) as previous_seq from o) select batch_id, goi::bigint as goi, batch_seq, previous_seq from l where previous_seq >= batch_seq""",
    ),
    "delivered_check": (
        lambda s, d: ordering.delivered_check(ordering.order2(batches(s, d))),
        f"""with {SQL_BATCHES}, o as (select *, sum(num_msg) over (order by epoch, broker_id, pbr_index rows unbounded preceding) - num_msg as t from batches),
l as (select *, lag(batch_seq) over (partition by {_S} order by t) >= batch_seq as back from o)
select count(*)::bigint as batches, sum(num_msg)::bigint as messages, (count(*) - count(distinct t))::bigint as repeated, coalesce(sum(back::int), 0)::bigint as fifo_violations, max(t + num_msg) - min(t) = sum(num_msg) as contiguous from l""",
    ),
    "dedup_log": (lambda s, d: ordering.first_copies(faulty(s, d)).select(*_cols, "arrival"), f"with {_FIRST} select {_CORE}, arrival from firsts"),
    "committed_prefix": (
        lambda s, d: ordering.release(faulty(s, d)).select("client_id", "session_epoch", "batch_seq", "release", "commit_epoch"),
        f"with {_PREFIX} select {_S}, batch_seq, release, commit_epoch from prefix",
    ),
    "committed_ranges": (
        lambda s, d: ordering.committed_ranges(ordering.order5(batches(s, d)).where("goi % 101 <> 100")),
        f"with {_ORDER5}, x as (select goi, goi - row_number() over (order by goi) as i from order5 where goi % 101 <> 100) select min(goi)::bigint as first, max(goi)::bigint as last from x group by i",
    ),
    "committed_seq": (
        lambda s, d: ordering.committed_seq(ordering.order5(batches(s, d)).where("goi % 1009 <> 1008")),
        f"with {_ORDER5}, x as (select goi, goi - row_number() over (order by goi) as i from order5 where goi % 1009 <> 1008), r as (select min(goi) as first, max(goi) as last from x group by i) select max(case when first = 0 then last end)::bigint as committed_seq, count(*)::bigint as ranges from r",
    ),
    "session_fences": (lambda s, d: _fences(s, d), f"with {_FENCES} select * from fences"),
    "fenced_order": (lambda s, d: _goi(s, d).select("client_id", "session_epoch", "batch_seq", "release", "goi", "total_order"), f"with {_GOI} select {_S}, batch_seq, release, goi, total_order from goi"),
    "held_and_fenced": (
        lambda s, d: (
            ordering.first_copies(faulty(s, d))
            .join(_fences(s, d).select(*ordering.SESSION, "fence_seq"), ordering.SESSION, "left")
            .join(ordering.release(faulty(s, d)).select(*ordering.SESSION, "batch_seq", F.lit(True).alias("_r")), [*ordering.SESSION, "batch_seq"], "left")
            .withColumn("state", F.when(F.col("batch_seq") >= F.col("fence_seq"), "fenced").when(F.col("_r"), "committed").otherwise("held"))
            .groupBy("session_epoch", "state")
            .agg(F.count("*").alias("batches"), F.sum("num_msg").alias("messages"))
        ),
        f"""with {_FENCES} select session_epoch, case when f.batch_seq >= fence_seq then 'fenced' when p.batch_seq is not null then 'committed' else 'held' end as state, count(*)::bigint as batches, sum(f.num_msg)::bigint as messages
from firsts f left join fences using ({_S}) left join prefix p using ({_S}, batch_seq) group by all""",
    ),
    "range_skips": (
        lambda s, d: faults.range_skips(faulty(s, d)),
        f"""with {_FIRST}, x as (select {_S}, batch_seq, coalesce(lag(batch_seq) over w, -1) as prev, max(arrival) over (w rows unbounded preceding) as release from firsts window w as (partition by {_S} order by batch_seq))
select {_S}, prev + 1 as skipped_from, batch_seq - prev - 1 as skipped, release from x where batch_seq > prev + 1""",
    ),
    "stale_epochs": (
        lambda s, d: faults.stale_epochs(batches(s, d), 150).select("batch_id", "epoch_created", F.col("age").cast("long")),
        f"with {SQL_BATCHES} select batch_id, epoch_created, (150 - epoch_created + 65536) % 65536 as age from batches where (150 - epoch_created + 65536) % 65536 > 2000",
    ),
    "fence_resubmit": (
        lambda s, d: faults.resubmissions(faulty(s, d), _fences(s, d)),
        f"with {_FENCES} select {_S}, batch_seq, (row_number() over (partition by {_S} order by batch_seq) - 1)::bigint as new_seq, session_epoch + 1 as new_epoch from firsts join fences using ({_S}) where batch_seq >= fence_seq",
    ),
    "recovered_sessions": (
        lambda s, d: faults.recovered_committed(_goi(s, d)),
        f"with {_GOI}, c as (select max(goi) as committed from (select goi, row_number() over (order by goi) - 1 as k from goi) where goi = k) select {_S}, max(batch_seq) + 1 as next_expected, sum(num_msg)::bigint as messages, max(total_order + num_msg) as next_total_order from goi, c where goi <= committed group by {_S}",
    ),
    "stalled_replicas": (
        lambda s, d: faults.stalled_replicas(ordering.order5(batches(s, d)), _replicated(s, d), 9000, 2, 5000).select("batch_id", "release", "num_replicated", "changed"),
        f"""with {_ORDER5}, x as (select batch_id, release, case when batch_id % 7 <> 0 then 1 + batch_id % 2 else 0 end as num_replicated, case when batch_id % 7 <> 0 then arrival + batch_id % 300 else release end as changed from order5)
select batch_id, release, num_replicated::bigint as num_replicated, changed from x where 9000 - release > 5000 and num_replicated < 2 and 9000 - changed >= 5000""",
    ),
}
