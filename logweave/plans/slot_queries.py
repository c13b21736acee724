"""Queries on slots, levels, markers, exports, completions and holes, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.operators import delivery, faults, ordering, slots
from logweave.plans.ordering_queries import LEASE, _FENCES, _ORDER5, _PREFIX, _S
from logweave.sources.derived import SQL_BATCHES, SQL_FAULTY, batches, faulty

TIMEOUT = 300


def _slots(s, d):
    """The ring slots of the log: some uncommitted, some committed under another index, flags by batch."""
    e = batches(s, d)
    commit = F.when(F.col("batch_id") % 17 == 3, None).when(F.col("batch_id") % 53 == 5, F.col("pbr_index") + 1).otherwise(F.col("pbr_index"))
    return e.select("broker_id", (F.col("pbr_index") % 4096).alias("slot"), "pbr_index", "batch_id", "num_msg", commit.alias("publish_commit"), (1 + F.col("batch_id") % 8).cast("int").alias("flags"), (F.col("batch_id") % 19 == 0).alias("complete"))


_SLOTS = SQL_BATCHES + ", slots as (select broker_id, pbr_index, batch_id, num_msg, case when batch_id % 17 = 3 then null when batch_id % 53 = 5 then pbr_index + 1 else pbr_index end as publish_commit, (1 + batch_id % 8)::int as flags, batch_id % 19 = 0 as complete from batches)"


def _ring(s, d):
    """The slots as one lap of the ring has them: the last 4096 of each broker."""
    rows = _slots(s, d)
    last = rows.groupBy("broker_id").agg(F.max("pbr_index").alias("_m"))
    return rows.join(F.broadcast(last), "broker_id").where("pbr_index > _m - 4096").drop("_m")


_RING = _SLOTS + ", ring as (select *, pbr_index % 4096 as slot from slots join (select broker_id, max(pbr_index) as m from slots group by broker_id) using (broker_id) where pbr_index > m - 4096)"


def _claims(s, d):
    """What receivers think they hold: every third slot, some under a batch that isn't there any more."""
    return _slots(s, d).where("batch_id % 3 = 0").select("broker_id", "slot", "pbr_index", F.when(F.col("batch_id") % 15 == 0, F.col("batch_id") + 1).otherwise(F.col("batch_id")).alias("batch_id"))


def _completions(s, d):
    """Completions of the brokers' batches by arrival, some repeated, some missing."""
    done = batches(s, d).where("batch_id % 701 <> 700 or broker_id = 2").select("broker_id", F.col("pbr_index").alias("broker_batch_seq"), "num_msg")
    return done.unionByName(done.where("broker_batch_seq % 31 = 0"))


def _tickets(s, d):
    """Corfu tickets of each client in order of its batches: some never come, one in a while fails."""
    return batches(s, d).where("batch_id % 89 <> 88").select("client_id", F.col("batch_seq").alias("ticket"), "arrival", (F.col("batch_id") % 1201 == 700).alias("failed"))


def _streams(s, d):
    """The faulty log with the numbers that its senders gave in each (client, session, broker) stream, and a few that come very late."""
    key = [*ordering.SESSION, "broker_id"]
    whole = batches(s, d).withColumn("stream_seq", (F.row_number().over(Window.partitionBy(*key).orderBy("batch_seq")) - 1).cast("long"))
    kept = whole.where("batch_id % 97 <> 0").withColumn("arrival", F.when(F.col("batch_id") % 61 == 7, F.col("arrival") + 4000).otherwise(F.col("arrival")))
    again = kept.where("batch_id % 31 = 0").withColumns({"arrival": F.col("arrival") + 5000})
    return kept.unionByName(again)


def _delivered(s, d):
    """A delivered log with faults: lost batches, some given twice, some under another client's number, empty frames."""
    rows = ordering.order2(batches(s, d)).select("client_id", "total_order", F.when(F.col("batch_id") % 907 == 5, 0).otherwise(F.col("num_msg")).cast("long").alias("num_msg"), "batch_seq", "batch_id")
    kept = rows.where("batch_id % 211 <> 9")
    return kept.unionByName(kept.where("batch_id % 101 = 3")).unionByName(kept.where("batch_id % 503 = 4").withColumn("client_id", F.col("client_id") + 1))


_DELIVERED = (
    SQL_BATCHES
    + """, o as (select client_id, batch_seq, batch_id, (sum(num_msg) over (order by epoch, broker_id, pbr_index rows unbounded preceding) - num_msg)::bigint as total_order, case when batch_id % 907 = 5 then 0 else num_msg end as num_msg from batches),
k as (select * from o where batch_id % 211 <> 9), given as (select * from k union all select * from k where batch_id % 101 = 3 union all select * replace (client_id + 1 as client_id) from k where batch_id % 503 = 4)"""
)


QUERIES = {
    "published_slots": (
        lambda s, d: _slots(s, d).where(slots.published()).groupBy("broker_id").agg(F.count("*").alias("slots"), F.sum("num_msg").alias("messages"), F.max("pbr_index").alias("last")),
        f"with {_SLOTS} select broker_id, count(*)::bigint as slots, sum(num_msg)::bigint as messages, max(pbr_index) as last from slots where publish_commit is not distinct from pbr_index and publish_commit is not null group by broker_id",
    ),
    "owned_claims": (
        lambda s, d: slots.still_owned(_ring(s, d), _claims(s, d)).select("broker_id", "pbr_index", "batch_id", "owned"),
        f"""with {_RING}, c as (select broker_id, pbr_index, case when batch_id % 15 = 0 then batch_id + 1 else batch_id end as batch_id from slots where batch_id % 3 = 0)
select c.broker_id, c.pbr_index, c.batch_id, coalesce(r.pbr_index = c.pbr_index and r.batch_id = c.batch_id and (r.flags & 7) = 1 and r.publish_commit is null and not r.complete, false) as owned
from c left join ring r on r.broker_id = c.broker_id and r.slot = c.pbr_index % 4096""",
    ),
    "epoch_levels": (
        lambda s, d: slots.epoch_ready(batches(s, d).withColumn("client_id", F.when(F.col("client_id") % 5 == 0, 0).otherwise(F.col("client_id")).cast("long"))).groupBy("commit_epoch", "level").agg(F.count("*").alias("batches"), F.sum("num_msg").alias("messages"), F.sum((F.col("commit_epoch") > F.col("epoch")).cast("long")).alias("again")),
        f"""with {SQL_BATCHES}, b as (select * replace (case when client_id % 5 = 0 then 0 else client_id end as client_id) from batches),
r as (select epoch, epoch as commit_epoch, 0 as level, num_msg from b where client_id = 0 union all
  select epoch, max(epoch) over (partition by {_S} order by batch_seq rows unbounded preceding), 5, num_msg from b where client_id <> 0)
select commit_epoch, level, count(*)::bigint as batches, sum(num_msg)::bigint as messages, sum((commit_epoch > epoch)::int)::bigint as again from r group by all""",
    ),
    "order_without_markers": (
        lambda s, d: slots.numbered_without_markers(slots.with_held_markers(batches(s, d))).select("batch_id", "commit_epoch", "goi", "total_order"),
        f"with {_ORDER5} select batch_id, commit_epoch, goi, total_order from order5",
    ),
    "consumed_through": (
        lambda s, d: slots.consumed_through(slots.with_held_markers(faulty(s, d).where("broker_id <> 1 or batch_id % 1000 <> 501"))),
        f"""with {_PREFIX.replace("from kept where batch_id % 31 = 0)", "from kept where batch_id % 31 = 0), unfiltered as (select * from faulty)")}, f as (select * from faulty where broker_id <> 1 or batch_id % 1000 <> 501),
u as (select * exclude (c) from (select *, row_number() over (partition by {_S}, batch_seq order by arrival, batch_id, broker_id) as c from f) where c = 1),
p as (select * from (select *, row_number() over (partition by {_S} order by batch_seq) - 1 as q from u) where q = batch_seq),
x as (select distinct broker_id, pbr_index from p), y as (select broker_id, pbr_index, row_number() over (partition by broker_id order by pbr_index) - 1 as k from x)
select broker_id, max(pbr_index) + 1 as consumed_through from y where pbr_index = k group by broker_id""",
    ),
    "slot_export": (
        lambda s, d: slots.slot_export(_slots(s, d).withColumn("publish_commit", F.when(F.col("batch_id") % 613 == 612, None).otherwise(F.col("pbr_index"))), s.range(4).select(F.col("id").alias("broker_id"), (F.col("id") * 25).alias("cursor"))).select("broker_id", "pbr_index", "batch_id", "num_msg"),
        f"""with {SQL_BATCHES}, x as (select broker_id, pbr_index, batch_id, num_msg, batch_id % 613 <> 612 as p from batches where pbr_index >= broker_id * 25), h as (select broker_id, min(case when not p then pbr_index end) as h from x group by broker_id)
select broker_id, pbr_index, batch_id, num_msg from x join h using (broker_id) where h is null or pbr_index < h""",
    ),
    "written_scan": (
        lambda s, d: slots.written_scan(ordering.order0(batches(s, d)), s.range(4).select(F.col("id").alias("broker_id"), (F.col("id") * 100).alias("last"))).select("broker_id", "pbr_index", "written"),
        f"with {SQL_BATCHES}, o as (select broker_id, pbr_index, (sum(num_msg) over (partition by broker_id order by pbr_index rows unbounded preceding) - num_msg)::bigint as written from batches) select broker_id, pbr_index, written from o where written >= broker_id * 100",
    ),
    "corfu_completions": (
        lambda s, d: slots.ordered_completions(_completions(s, d)),
        f"""with {SQL_BATCHES}, c as (select broker_id, pbr_index as q, num_msg from batches where batch_id % 701 <> 700 or broker_id = 2), k as (select *, row_number() over (partition by broker_id order by q) - 1 as k from c)
select broker_id, coalesce(sum(num_msg) filter (q = k), 0)::bigint as acked, (count(*) filter (q = k))::bigint as batches from k group by broker_id""",
    ),
    "ticket_gate": (
        lambda s, d: slots.ticket_gate(_tickets(s, d)),
        f"""with {SQL_BATCHES}, t as (select client_id, batch_seq as ticket, arrival, batch_id % 1201 = 700 as failed from batches where batch_id % 89 <> 88),
x as (select *, row_number() over w - 1 as n, max(arrival) over w as t, bool_or(failed) over w as f from t window w as (partition by client_id order by ticket rows unbounded preceding))
select client_id, ticket, case when f then 'refused' when n = ticket then 'passed' else 'waiting' end as state, case when not f and n = ticket then t end as passed_at from x""",
    ),
    "own_cuts": (
        lambda s, d: slots.own_cuts(batches(s, d).groupBy(F.col("epoch").alias("round"), "broker_id", (F.col("batch_id") % 2).alias("replica")).agg(F.max("pbr_index").alias("cut_cum"))),
        f"with {SQL_BATCHES}, r as (select epoch as round, broker_id, batch_id % 2 as replica, max(pbr_index) as cut_cum from batches group by all) select *, max(cut_cum) over (partition by broker_id, replica order by round rows unbounded preceding) as own_cut from r",
    ),
    "arrival_classes": (
        lambda s, d: slots.arrival_classes(faulty(s, d), faults.session_fences(faulty(s, d), LEASE)).select("batch_id", "broker_id", "arrival", "kind", "credit"),
        f"""with {_FENCES}, x as (select f.*, u.batch_id is not null as lead, p.release, n.fence_seq, n.fence_tick from faulty f
  left join firsts u on u.client_id = f.client_id and u.session_epoch = f.session_epoch and u.batch_seq = f.batch_seq and u.arrival = f.arrival and u.broker_id = f.broker_id
  left join prefix p on p.client_id = f.client_id and p.session_epoch = f.session_epoch and p.batch_seq = f.batch_seq left join fences n on n.client_id = f.client_id and n.session_epoch = f.session_epoch),
k as (select *, case when arrival > fence_tick and batch_seq >= fence_seq then 'fenced' when not lead and release <= arrival then 'late' when not lead then 'repeated' when release = arrival then 'expected' else 'held' end as kind from x)
select batch_id, broker_id, arrival, kind, (case when kind in ('late', 'expected') then num_msg else 0 end)::bigint as credit from k""",
    ),
    "hold_pressure": (
        lambda s, d: slots.hold_pressure(faulty(s, d), 20, 15),
        f"""with {_PREFIX}, w as (select f.epoch, p.commit_epoch from firsts f left join prefix p using ({_S}, batch_seq) where p.commit_epoch is null or p.commit_epoch > f.epoch),
e as (select epoch, 1 as d from w union all select commit_epoch, -1 from w where commit_epoch is not null), c as (select epoch, sum(sum(d)) over (order by epoch rows unbounded preceding) as n from e group by epoch)
select epoch, least(n, 20)::bigint as held, least(greatest(n - 20, 0), 15)::bigint as deferred, greatest(n - 35, 0)::bigint as blocked from c""",
    ),
    "targeted_skips": (
        lambda s, d: slots.released_with_skips(faulty(s, d), batches(s, d).where("batch_id % 194 = 0").select("client_id", "session_epoch", "batch_seq", (F.col("arrival") + 900).alias("tick"))),
        f"""with {_PREFIX}, r as (select {_S}, batch_seq, num_msg, arrival, false as skipped from firsts union all select {_S}, batch_seq, 0, arrival + 900, true from batches where batch_id % 194 = 0 and session_epoch = 0),
n as (select *, row_number() over (partition by {_S} order by batch_seq) - 1 as k from r), c as (select *, max(arrival) over (partition by {_S} order by batch_seq rows unbounded preceding) as release from n where k = batch_seq)
select {_S}, batch_seq, num_msg, release from c where not skipped""",
    ),
    "order4_holes": (
        lambda s, d: slots.stream_release(_streams(s, d), TIMEOUT).select("batch_id", "broker_id", "stream_seq", "arrival", "release", "late"),
        f"""with recursive {SQL_BATCHES}, n as (select *, (row_number() over (partition by {_S}, broker_id order by batch_seq) - 1)::bigint as stream_seq from batches),
k as (select * replace (case when batch_id % 61 = 7 then arrival + 4000 else arrival end as arrival) from n where batch_id % 97 <> 0),
f as (select *, min(arrival) over (partition by {_S}, broker_id order by stream_seq rows between 1 following and unbounded following) as nxt, row_number() over (partition by {_S}, broker_id order by stream_seq) as i from k),
o as (select {_S}, broker_id, i, stream_seq, arrival, nxt, (case when stream_seq = 0 then -1 else greatest(-1, least(arrival, coalesce(nxt, arrival))) + {TIMEOUT} end)::bigint as opened from f where i = 1),
g as (select {_S}, broker_id, i, stream_seq, nxt is not null and arrival > greatest(opened, coalesce(nxt, 0)) + {TIMEOUT} as late, (case when nxt is not null and arrival > greatest(opened, coalesce(nxt, 0)) + {TIMEOUT} then greatest(opened, nxt) + {TIMEOUT} else greatest(opened, arrival) end)::bigint as tick from o
  union all select {_S}, broker_id, i, stream_seq, nxt is not null and arrival > greatest(opened, coalesce(nxt, 0)) + {TIMEOUT}, (case when nxt is not null and arrival > greatest(opened, coalesce(nxt, 0)) + {TIMEOUT} then greatest(opened, nxt) + {TIMEOUT} else greatest(opened, arrival) end)::bigint from
  (select f.client_id, f.session_epoch, f.broker_id, f.i, f.stream_seq, f.arrival, f.nxt, case when f.stream_seq = g.stream_seq + 1 then g.tick else greatest(g.tick, least(f.arrival, coalesce(f.nxt, f.arrival))) + {TIMEOUT} end as opened
   from g join f on f.client_id = g.client_id and f.session_epoch = g.session_epoch and f.broker_id = g.broker_id and f.i = g.i + 1))
select f.batch_id, f.broker_id, f.stream_seq, f.arrival, case when g.late then f.arrival else g.tick end as release, g.late from f join g using ({_S}, broker_id, i)
union all select batch_id, broker_id, stream_seq, arrival + 5000, arrival + 5000, true from k where batch_id % 31 = 0""",
    ),
    "broker_cumulative": (
        lambda s, d: slots.with_broker_counts(ordering.release(batches(s, d))).select("batch_id", "broker_id", "commit_epoch", "broker_messages"),
        f"with {_ORDER5} select batch_id, broker_id, commit_epoch, (sum(num_msg) over (partition by broker_id order by commit_epoch, client_id, session_epoch, batch_seq rows unbounded preceding) - num_msg)::bigint as broker_messages from order5",
    ),
    "fifo_bypass": (
        lambda s, d: slots.bypassed_order(faulty(s, d), faults.session_fences(faulty(s, d), LEASE)).select("batch_id", "epoch", "goi", "total_order"),
        f"""with {_FENCES}, b as (select f.* from firsts f left join fences using ({_S}) where fence_seq is null or batch_seq < fence_seq)
select batch_id, epoch, (row_number() over w - 1)::bigint as goi, (sum(num_msg) over w - num_msg)::bigint as total_order from b window w as (order by epoch, broker_id, pbr_index, batch_id rows unbounded preceding)""",
    ),
    "single_sequencer": (
        lambda s, d: (
            slots.single_order(batches(s, d))
            .select("batch_id", F.col("total_order").alias("single"))
            .join(ordering.order5(batches(s, d)).select("batch_id", "commit_epoch", "total_order"), "batch_id")
            .groupBy("commit_epoch")
            .agg(F.count("*").alias("batches"), F.sum((F.col("single") != F.col("total_order")).cast("long")).alias("moved"), F.max(F.abs(F.col("single") - F.col("total_order"))).alias("furthest"))
        ),
        f"""with {_ORDER5}, x as (select *, (sum(num_msg) over (order by release, client_id, session_epoch, batch_seq rows unbounded preceding) - num_msg)::bigint as single from order5)
select commit_epoch, count(*)::bigint as batches, sum((single <> total_order)::int)::bigint as moved, max(abs(single - total_order)) as furthest from x group by commit_epoch""",
    ),
    "overflowing_clients": (
        lambda s, d: slots.overflowing_clients(faulty(s, d), 12),
        f"""with {_PREFIX}, w as (select client_id, arrival, unnest(range(epoch, commit_epoch)) as epoch from prefix where commit_epoch > epoch)
select epoch, count(*)::bigint as backlog, arg_min(client_id, (arrival, client_id)) as client_id, min(arrival) as oldest from w group by epoch having count(*) > 12""",
    ),
    "overdue_resends": (
        lambda s, d: slots.overdue(delivery.ledger(batches(s, d), batches(s, d).groupBy("client_id", "session_epoch").agg((F.sum("num_msg") - F.col("client_id") % 40).alias("acked"))), 10_500, 300).select("client_id", "session_epoch", "batch_seq", "late_by"),
        f"""with {SQL_BATCHES}, a as (select {_S}, sum(num_msg) - client_id % 40 as acked from batches group by {_S}), e as (select {_S}, batch_seq, arrival, sum(num_msg) over (partition by {_S} order by batch_seq) as e from batches),
r as (select {_S}, min(batch_seq) as batch_seq, arg_min(arrival, batch_seq) as arrival from e join a using ({_S}) where e > acked group by {_S}) select {_S}, batch_seq, 10500 - arrival - 300 as late_by from r where 10500 - arrival > 300""",
    ),
    "replayed_slots": (
        lambda s, d: slots.replayed_slots(batches(s, d).where("batch_id % 61 <> 7").select("broker_id", F.expr("pbr_index div 2").alias("slot"), "arrival", "batch_id", ((F.col("broker_id") != 2) | (F.col("batch_id") % 5000 != 3502)).alias("whole"))),
        f"""with {SQL_BATCHES}, w as (select broker_id, pbr_index // 2 as slot, arrival, batch_id, broker_id <> 2 or batch_id % 5000 <> 3502 as whole from batches where batch_id % 61 <> 7),
c as (select broker_id, min(arrival) filter (not whole) as cut from w group by broker_id), r as (select w.* from w join c using (broker_id) where cut is null or arrival < cut),
f as (select broker_id, slot, arg_min(batch_id, (arrival, batch_id)) as batch_id from r group by all), e as (select broker_id, unnest(range(0, m + 1)) as slot from (select broker_id, max(slot) as m from f group by broker_id))
select broker_id, slot, case when batch_id is null then 'JUNK' else 'WRITTEN' end as state, batch_id from e left join f using (broker_id, slot)""",
    ),
    "delivered_audit": (
        lambda s, d: slots.delivered_audit(_delivered(s, d)),
        f"""with {_DELIVERED}, g as (select total_order, count(*) as n, count(distinct (client_id, batch_seq)) as u, max(num_msg) as m, sum((num_msg not between 1 and 10000)::int) as i from given group by total_order)
select sum(i)::bigint as invalid, sum(n - u)::bigint as given_twice, sum((u > 1)::int)::bigint as contested, (max(total_order + m) - min(total_order) - sum(m))::bigint as missing from g""",
    ),
}
