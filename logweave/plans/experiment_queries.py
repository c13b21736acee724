"""Queries on evaluation tables derived from the batch log, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.functions import percentiles
from logweave.operators import experiments as x
from logweave.operators import faults, frontier, ordering, slots, traces
from logweave.plans.ordering_queries import LEASE, _FENCES, _ORDER5, _S
from logweave.plans.trace_queries import _SQL_SERIES, _SQL_STAGES, _SQL_TRIALS, _series, _stages, _trials
from logweave.sources.derived import SQL_BATCHES, batches, events, faulty

_B = "broker_id"


def _commits(s, d):
    """Commits of three trials (session epochs): each client's batches at their release."""
    return ordering.release(batches(s, d)).select(F.col("session_epoch").alias("trial"), "client_id", F.col("batch_seq").alias("seq"), F.col("release").alias("wall"))


def _gaps(s, d):
    """A gap of each trial's smallest client; the next client is the control. In trial 1 the number is one too small."""
    c = batches(s, d).groupBy(F.col("session_epoch").alias("trial"), "client_id").agg(F.max("arrival").alias("m"), F.count("*").alias("n"))
    two = c.groupBy("trial").agg(F.min("client_id").alias("affected")).select("trial", "affected", (F.col("affected") + 3).alias("control"))
    first = _commits(s, d).join(two.select("trial", F.col("affected").alias("client_id")), ["trial", "client_id"]).where("wall >= 4000").groupBy("trial").agg(F.min("seq").alias("q"), F.min("wall").alias("w"))
    return two.join(first, "trial").select("trial", "affected", "control", (F.col("q") - (F.col("trial") == 1).cast("int")).alias("gap_seq"), F.lit(2500).cast("long").alias("start"), F.col("w").alias("stop"))


_SQL_GAPS = (
    _ORDER5
    + """,
commits as (select session_epoch as trial, client_id, batch_seq as seq, release as wall from order5),
two as (select session_epoch as trial, min(client_id) as affected, min(client_id) + 3 as control from batches group by session_epoch),
firsts as (select c.trial, min(seq) as q, min(wall) as w from commits c join two t on t.trial = c.trial and t.affected = c.client_id where wall >= 4000 group by c.trial),
gaps as (select trial, affected, control, q - (trial = 1)::int as gap_seq, 2500 as start, w as stop from two join firsts using (trial))"""
)


def _kills(s, d):
    """The kill of each broker but the last, at its own tick; broker 0's is before any sample."""
    return s.range(3).select(F.col("id").alias("key"), (F.col("id") * 40 + 3).alias("kill"))


def _rates(s, d):
    return _series(s, d).select(F.col(_B).alias("key"), "tick", F.when((F.col(_B) == 2) & F.col("tick").between(73, 82), 0).otherwise(F.col("rate")).cast("double").alias("rate"))


_SQL_RATES = _SQL_SERIES + ", rates as (select broker_id as key, tick, (case when broker_id = 2 and tick between 73 and 82 then 0 else rate end)::double as rate from series), kills as (select k as key, k * 40 + 3 as kill from range(3) r(k))"
_SQL_BASELINES = (
    _SQL_RATES
    + """, pre as (select key, kill, quantile_cont(rate, 0.5) filter (tick >= kill - 10) as a, quantile_cont(rate, 0.5) as b, quantile_cont(rate, 0.5) filter (rate > 0) as c, count(*) filter (tick >= kill - 10) as n
  from rates join kills using (key) where tick < kill and tick >= 2 group by key, kill),
base as (select key, kill, case when (case when n > 0 then a else b end) > 0 then (case when n > 0 then a else b end) else c end as baseline, case when (case when n > 0 then a else b end) <= 0 then 'nonzero' when n > 0 then 'window' else 'warm' end as basis from pre)"""
)


def _slow(s, d):
    """p99-like values of three trials of two systems under two modes; one cell lacks a trial."""
    e = batches(s, d)
    rows = e.groupBy((F.col(_B) % 2).alias("system"), (F.col("num_msg") % 2 + 1).alias("ack"), F.when(F.col("client_id") % 2 == 0, "slow").otherwise("plain").alias("mode"), (F.col("batch_id") % 3).alias("trial")).agg(F.max("latency_us").alias("p99"))
    return rows.where("not (system = 1 and ack = 2 and mode = 'slow' and trial = 2)")


_SQL_SLOW = SQL_BATCHES + ", slow as (select * from (select broker_id % 2 as system, num_msg % 2 + 1 as ack, case when client_id % 2 = 0 then 'slow' else 'plain' end as mode, batch_id % 3 as trial, max(latency_us) as p99 from batches group by all) where not (system = 1 and ack = 2 and mode = 'slow' and trial = 2))"


def _runs(s, d):
    e = batches(s, d)
    return e.groupBy(_B, (F.col("batch_id") % 5).alias("run")).agg(F.count("*").alias("batches"), F.sum((F.col("latency_us") % 23 == 0).cast("long")).alias("full"), (F.sum("num_msg") / (F.max("epoch") - F.min("epoch") + 1)).alias("throughput"))


_SQL_RUNS = SQL_BATCHES + ", runs as (select broker_id, batch_id % 5 as run, count(*) as batches, sum((latency_us % 23 = 0)::int) as nfull, sum(num_msg) / (max(epoch) - min(epoch) + 1) as throughput from batches group by all)"


def _labels(s, d):
    e = F.col("batch_id")
    systems = F.array(*(F.lit(v) for v in ("OWN", "CORFU", "SCALOG", "LAZYLOG")))
    rows = events(s, d).select(F.col("event_id").alias("batch_id"))
    return rows.select("batch_id", F.element_at(systems, (e % 4 + 1).cast("int")).alias("sequencer"), (e % 6).alias("ord"), (e % 7 != 0).alias("ok"), F.when(e % 5 == 0, "manual").otherwise("auto").alias("mode"), (e % 3).alias("sync"), F.when(e % 2 == 0, "a,beside-log,b").when(e % 9 != 0, "a,b").alias("layout"), (1 + e % 4).alias("clients"))


_SQL_LABELS = "l as (select event_id as batch_id, ['OWN', 'CORFU', 'SCALOG', 'LAZYLOG'][event_id % 4 + 1] as sequencer, event_id % 6 as ord, event_id % 7 <> 0 as ok, case when event_id % 5 = 0 then 'manual' else 'auto' end as mode, event_id % 3 as sync, case when event_id % 2 = 0 then 'a,beside-log,b' when event_id % 9 <> 0 then 'a,b' end as layout, 1 + event_id % 4 as clients from events)"


def _walk(s, d):
    """What four subscribers were given: the order without some batches and with some again."""
    rows = ordering.order2(batches(s, d)).select((F.col("client_id") % 4).alias("subscriber"), (F.col("total_order") * 2).alias("place"), "total_order", "num_msg")
    whole = rows.select("place", "total_order", "num_msg").withColumn("subscriber", F.explode(F.array(*(F.lit(k).cast("long") for k in range(2)))))
    seen = whole.where("(total_order + subscriber) % 53 <> 0")
    again = seen.where("total_order % 71 = 3").withColumn("place", F.col("place") + 1)
    return seen.unionByName(again)


_SQL_WALK = SQL_BATCHES + """, o as (select num_msg, (sum(num_msg) over (order by epoch, broker_id, pbr_index rows unbounded preceding) - num_msg)::bigint as total_order from batches),
seen as (select k as subscriber, total_order * 2 as place, total_order, num_msg from o, range(2) r(k) where (total_order + k) % 53 <> 0), walk as (select * from seen union all select subscriber, place + 1, total_order, num_msg from seen where total_order % 71 = 3)"""


def _outcomes(s, d):
    """Runs of curated cells with status, number of clients and value."""
    e = F.col("batch_id")
    return batches(s, d).where("batch_seq < 12").select(_B, F.col("num_msg").alias("load"), e.alias("run"), F.when(e % 4 == 1, "failed").otherwise("ok").alias("status"), F.col("latency_us").alias("us"))


_SQL_OUTCOMES = SQL_BATCHES + ", outcomes as (select broker_id, num_msg as load, batch_id as run, case when batch_id % 4 = 1 then 'failed' else 'ok' end as status, latency_us as us from batches where batch_seq < 12)"

_MARKS = SQL_BATCHES + ", m as (select client_id, arrival, batch_id % 5 = 0 as det, row_number() over (partition by client_id, batch_id % 5 order by arrival) as n from batches where batch_id % 5 < 2), pairs as (select a.client_id as key, a.n, a.arrival as start, b.arrival as stop from m a join m b on a.client_id = b.client_id and a.n = b.n and a.det and not b.det)"


def _pairs(s, d):
    marks = batches(s, d).where("batch_id % 5 < 2").select("client_id", "arrival", F.when(F.col("batch_id") % 5 == 0, "detect").otherwise("release").alias("kind"))
    return traces.paired(marks, "client_id", "arrival", "kind", "detect", "release").select(F.col("client_id").alias("key"), "n", "start", "stop")


QUERIES = {
    "commit_isolation": (
        lambda s, d: x.commit_isolation(_commits(s, d), _gaps(s, d), 100, 5, 900),
        f"""with {_SQL_GAPS}, r as (select c.*, g.affected, g.control, g.gap_seq, g.start, g.stop, c.client_id = g.control and wall >= start + 100 and wall < stop - 100 as calm from commits c join gaps g using (trial) where client_id in (affected, control)),
k as (select trial, max(w) as control_gap, count(*) as control_commits from (select trial, wall - lag(wall) over (partition by trial order by wall, seq) as w from r where calm) group by trial),
b as (select r.trial, max(gap_seq) as gap_seq, (count(*) filter (client_id = affected and wall >= start and wall < stop and seq >= gap_seq))::bigint as leaked, min((wall, seq)) filter (client_id = affected and wall >= stop) as f from r group by r.trial)
select trial, gap_seq, leaked, f[2]::bigint as first_after, coalesce(control_commits, 0)::bigint as control_commits, control_gap, coalesce(leaked = 0 and f[2] = gap_seq and control_commits >= 5 and control_gap <= 900, false) as valid from b left join k using (trial)""",
    ),
    "stall_baselines": (lambda s, d: x.stall_baselines(_rates(s, d), _kills(s, d), 10, 2), f"with {_SQL_BASELINES} select * from base"),
    "stall_residual": (
        lambda s, d: x.stall_residual(_rates(s, d), x.stall_baselines(_rates(s, d), _kills(s, d), 10, 2), 0.5, 2),
        f"""with {_SQL_BASELINES}, w as (select r.*, b.kill, b.baseline, min(rate) over v as m, count(*) over v as c from rates r join base b using (key) window v as (partition by key order by tick rows between current row and 1 following)),
a as (select *, min(case when c = 2 and m >= 0.5 * baseline and tick >= kill then tick end) over (partition by key) as back_at from w), f as (select *, back_at is null or tick < back_at as short from a where tick >= kill)
select key, kill, max(back_at) as recovered, max(back_at) - kill as stall, round(coalesce(min(case when short then rate end), min(rate)) / max(baseline), 6) as dip, round(sum(case when short then greatest(baseline - rate, 0) else 0 end), 4) as residual from f group by key, kill""",
    ),
    "affected_and_control": (
        lambda s, d: x.with_control(batches(s, d).withColumn("role", F.when(F.col("client_id") % 2 == 0, "affected").otherwise("control")).where("not (broker_id = 2 and num_msg = 3 and client_id % 2 = 1)").groupBy("role", _B, "num_msg").agg(F.max("latency_us").alias("value")), _B, "num_msg"),
        f"with {SQL_BATCHES} select broker_id, num_msg, max(latency_us) filter (client_id % 2 = 0) as affected, max(latency_us) filter (client_id % 2 = 1 and not (broker_id = 2 and num_msg = 3)) as control from batches group by all",
    ),
    "expected_walker": (
        lambda s, d: x.expected_walker(_walk(s, d), "subscriber").select("subscriber", "place", "total_order", "expected", "jump"),
        f"with {_SQL_WALK}, e as (select *, lag(total_order + num_msg) over (partition by subscriber order by place) as expected from walk) select subscriber, place, total_order, expected, total_order - expected as jump from e where expected <> total_order",
    ),
    "dominant_stage": (
        lambda s, d: x.dominant_stage(_stages(s, d).select(_B, "ordered", (F.col("acked") - F.col("ordered")).alias("ack_wait"), (F.col("delivered") - F.col("acked")).alias("deliver_wait")), ["ordered", "ack_wait", "deliver_wait"], 0.99, _B),
        f"""with {_SQL_STAGES}, q as (select broker_id, quantile_disc(ordered, 0.99) as ordered, quantile_disc(acked - ordered, 0.99) as ack_wait, quantile_disc(delivered - acked, 0.99) as deliver_wait from stages group by broker_id)
select *, case greatest(ordered, ack_wait, deliver_wait) when ordered then 'ordered' when ack_wait then 'ack_wait' else 'deliver_wait' end as dominant from q""",
    ),
    "slow_replica_ratios": (
        lambda s, d: x.ratios(_slow(s, d), "p99", "mode", "slow", "plain", 3, "system", "ack"),
        f"""with {_SQL_SLOW}, c as (select system, ack, quantile_cont(p99, 0.5) filter (mode = 'slow') as s, quantile_cont(p99, 0.5) filter (mode = 'plain') as p, count(*) filter (mode = 'slow') as ns, count(*) filter (mode = 'plain') as np from slow group by all)
select system, ack, round(p, 4) as base, round(s, 4) as slow, round(s / p, 6) as ratio, ns = 3 and np = 3 as complete from c""",
    ),
    "batch_sensitivity": (
        lambda s, d: traces.against(x.band(_runs(s, d).withColumn("load", F.col(_B) * 16 + 16).withColumn("rate", F.col("batches") / (F.col("run") + 1)), "rate", "load").withColumn("all", F.lit(1)), "load", F.col("load") == 16, "median", "all").drop("all"),
        f"""with {_SQL_RUNS}, b as (select broker_id * 16 + 16 as load, round(median(batches / (run + 1)), 4) as median from runs group by broker_id), c as (select median as base from b where load = 16)
select load, median, round(median - base, 4) as delta, round(100 * (median - base) / base, 4) as delta_percent, round(median / base, 6) as ratio from b, c""",
    ),
    "ablation_runs": (
        lambda s, d: x.run_summary(_runs(s, d), 4.4, _B),
        f"""with {_SQL_RUNS}, p as (select *, 100 * nfull / (batches + nfull) as share from runs)
select broker_id, round(median(throughput), 4) as median, round(min(throughput), 4) as lo, round(max(throughput), 4) as hi, round(stddev_pop(throughput), 4) as sd, round(100 * stddev_pop(throughput) / avg(throughput), 4) as cv_percent, round(max(share), 4) as full_percent, count(*)::bigint as runs, sum((share <= 4.4)::int)::bigint as valid_runs from p group by broker_id""",
    ),
    "cas_skew": (
        lambda s, d: x.band(batches(s, d).groupBy(_B, F.col("num_msg").alias("skew"), (F.col("batch_id") % 3).alias("trial")).agg((100 * F.avg((F.col("latency_us") % 11 == 0).cast("int"))).alias("rejected")), "rejected", _B, "skew"),
        f"with {SQL_BATCHES}, t as (select broker_id, num_msg as skew, batch_id % 3 as trial, 100 * avg((latency_us % 11 = 0)::int) as rejected from batches group by all) select broker_id, skew, round(median(rejected), 4) as median, round(min(rejected), 4) as lo, round(max(rejected), 4) as hi, count(*)::bigint as n from t group by all",
    ),
    "ordering_percentiles": (
        lambda s, d: traces.summary(_stages(s, d).select((F.col(_B) + 1).alias("brokers"), F.col("acked").alias("us")), "us", "brokers"),
        f"with {_SQL_STAGES} select broker_id + 1 as brokers, quantile_disc(acked, 0.5) as p50, quantile_disc(acked, 0.9) as p90, quantile_disc(acked, 0.95) as p95, quantile_disc(acked, 0.99) as p99, quantile_disc(acked, 0.999) as p999, min(acked) as least, max(acked) as most, round(avg(acked), 4) as mean, count(acked)::bigint as n from stages group by broker_id",
    ),
    "kv_frontier": (
        lambda s, d: batches(s, d).groupBy(F.expr("shiftleft(1, cast(num_msg as int))").alias("depth"), (F.col("batch_id") % 3).alias("trial")).agg(F.count("*").alias("ops"), F.avg("latency_us").alias("us")).groupBy("depth").agg(F.round(F.median("ops"), 4).alias("ops"), F.round(F.median("us"), 4).alias("us")),
        f"with {SQL_BATCHES}, t as (select (1 << num_msg)::int as depth, batch_id % 3 as trial, count(*) as ops, avg(latency_us) as us from batches group by all) select depth, round(median(ops), 4) as ops, round(median(us), 4) as us from t group by depth",
    ),
    "end_to_end_throughput": (
        lambda s, d: traces.trial_stats(batches(s, d).groupBy(_B, (F.expr("batch_id div 500") % 8).alias("trial")).agg((F.sum("num_msg") * 1000 / (F.max("arrival") - F.min("arrival"))).alias("rate")).withColumn("rate", F.when(F.col("trial") != 5, F.col("rate"))), "rate", _B, warmup=2, least=3),
        f"""with {SQL_BATCHES}, t as (select broker_id, (batch_id // 500) % 8 as trial, sum(num_msg) * 1000 / (max(arrival) - min(arrival)) as rate from batches group by all), k as (select broker_id, trial, case when trial <> 5 then rate end as rate, row_number() over (partition by broker_id order by trial) as i, count(*) over (partition by broker_id) as c from t)
select broker_id, count(rate)::bigint as n, round(avg(rate), 4) as mean, round(case when count(rate) = 1 then 0 else stddev_samp(rate) end, 4) as sd, round(1.96 * case when count(rate) = 1 then 0 else stddev_samp(rate) end / sqrt(count(rate)), 4) as ci95, round(100 * stddev_pop(rate) / avg(rate), 4) as cv_percent from k where c - 2 < 3 or i > 2 group by broker_id""",
    ),
    "publish_latency": (
        lambda s, d: traces.summary(
            frontier.first_ack(
                batches(s, d).select("client_id", F.sum("num_msg").over(Window.partitionBy("client_id").orderBy("batch_seq").rowsBetween(Window.unboundedPreceding, 0)).alias("end_count"), "batch_seq", F.col("arrival").alias("sent")),
                batches(s, d).where("batch_seq % 3 = 2").select("client_id", F.sum("num_msg").over(Window.partitionBy("client_id").orderBy("batch_seq").rowsBetween(Window.unboundedPreceding, 0)).alias("acked"), (F.col("arrival") + 5000).alias("ack_time")),
            ).where("latency is not null"),
            "latency",
        ),
        f"""with {SQL_BATCHES}, c as (select client_id, batch_seq, arrival as sent, sum(num_msg) over (partition by client_id order by batch_seq) as e from batches), a as (select client_id, arrival + 5000 as t, sum(num_msg) over (partition by client_id order by batch_seq) as e from batches where batch_seq % 3 = 2),
l as (select min(t) - any_value(sent) as v from c join a on a.client_id = c.client_id and a.e >= c.e group by c.client_id, c.batch_seq)
select quantile_disc(v, 0.5) as p50, quantile_disc(v, 0.9) as p90, quantile_disc(v, 0.95) as p95, quantile_disc(v, 0.99) as p99, quantile_disc(v, 0.999) as p999, min(v) as least, max(v) as most, round(avg(v), 4) as mean, count(v)::bigint as n from l""",
    ),
    "failure_timeline": (
        lambda s, d: (
            events(s, d)
            .select("event_id", F.concat(F.col("event_id").cast("string"), F.lit("ms "), F.when(F.col("event_id") % 1000 == 407, "KILL broker").when(F.col("event_id") % 1000 == 519, "SEND FAILED").when(F.col("event_id") % 1000 == 520, "RECONNECT").otherwise("tick"), F.lit(" trial="), F.expr("event_id div 1000").cast("string")).alias("line"))
            .select(F.expr("try_cast(regexp_extract(line, '^([0-9]+)ms', 1) as bigint)").alias("at"), F.regexp_extract("line", "ms ([A-Z ]+)", 1).alias("what"), F.regexp_extract("line", "trial=([0-9]+)", 1).cast("long").alias("trial"))
            .where("what <> ''")
            .groupBy("trial")
            .agg(F.min(F.when(F.col("what").startswith("KILL"), F.col("at"))).alias("kill"), F.min(F.when(F.col("what").startswith("SEND"), F.col("at"))).alias("fail"), F.min(F.when(F.col("what").startswith("RECON"), F.col("at"))).alias("back"))
            .select("trial", "kill", (F.col("fail") - F.col("kill")).alias("to_fail"), (F.col("back") - F.col("kill")).alias("to_reconnect"))
        ),
        "select event_id // 1000 as trial, min(case when event_id % 1000 = 407 then event_id end) as kill, min(case when event_id % 1000 = 519 then event_id end) - min(case when event_id % 1000 = 407 then event_id end) as to_fail, min(case when event_id % 1000 = 520 then event_id end) - min(case when event_id % 1000 = 407 then event_id end) as to_reconnect from events where event_id % 1000 in (407, 519, 520) group by 1",
    ),
    "gap_seals": (
        lambda s, d: x.paired_seals(_pairs(s, d), batches(s, d).groupBy("epoch").agg(F.max("arrival").alias("seal")).select("seal"), 1000),
        f"""with {_MARKS}, seals as (select max(arrival) as seal from batches group by epoch), j as (select p.*, s.seal from pairs p left join seals s on s.seal >= p.start and s.seal < p.stop)
select key, n, start, stop, count(seal)::bigint as seals, case when count(seal) > 1 then round((max(seal) - min(seal)) / (count(seal) - 1), 4) end as interval from j group by key, n, start, stop""",
    ),
    "open_gaps": (
        lambda s, d: x.open_gaps(faults._gaps(faulty(s, d).where("session_epoch <> 0")), 9000, 3000).select("client_id", "session_epoch", "missing", "gap_start", "stalled"),
        f"with {_FENCES} select {_S}, missing, gap_start, 9000 - gap_start as stalled from gaps where (arrival is null or arrival > 9000) and 9000 - gap_start > 3000",
    ),
    "last_ok_runs": (
        lambda s, d: x.last_ok(_outcomes(s, d), "run", _B, "load").select(_B, "load", "run", "us", x.topology(F.when(F.col("run") % 3 == 0, "x,beside-log"), F.col("load"), "beside-log").alias("topology")),
        f"""with {_SQL_OUTCOMES}, k as (select *, row_number() over (partition by broker_id, load order by run desc) as k from outcomes where status = 'ok')
select broker_id, load, run, us, case when run % 3 = 0 and load >= 2 then case when load = 2 then 'local_as_n2' else 'local_as_n3' end else 'all_remote' end as topology from k where k = 1""",
    ),
    "run_labels": (
        lambda s, d: _labels(s, d).select("batch_id", x.fifo_mode(F.col("ok"), F.col("mode"), F.col("sync"), F.col("sequencer"), F.col("ord"), "OWN").alias("fifo"), x.topology(F.col("layout"), F.col("clients"), "beside-log").alias("topology"), x.append_complete(F.col("ok"), F.col("sync") > 0).alias("appended"), x.exposable(F.col("ok"), F.col("sync") > 0, F.col("ord") > 2).alias("exposed"), x.survives_host(F.col("ok"), F.when(F.col("ord") == 1, "RDMA_REPLICA").otherwise("LOCAL")).alias("survives")),
        f"""with {_SQL_LABELS} select batch_id, case when not ok then '' when mode <> 'auto' then mode when sync = 1 then 'stop_and_wait' when sequencer = 'OWN' and ord = 5 then 'native' when sequencer = 'CORFU' then 'token_order' else 'none' end as fifo,
case when coalesce(layout, '') like '%beside-log%' and clients >= 2 then case when clients = 2 then 'local_as_n2' else 'local_as_n3' end else 'all_remote' end as topology, ok and sync > 0 as appended, ok and sync > 0 and ord > 2 as exposed, ok and ord = 1 as survives from l""",
    ),
    "system_order": (
        lambda s, d: _labels(s, d).groupBy("sequencer").agg(F.count("*").alias("runs")).select("sequencer", "runs", F.row_number().over(Window.orderBy(x.ranked_by_name(F.col("sequencer"), ["OWN", "SCALOG", "CORFU"]), "sequencer")).cast("long").alias("place")),
        f"with {_SQL_LABELS} select sequencer, count(*)::bigint as runs, row_number() over (order by list_position(['OWN', 'SCALOG', 'CORFU', 'LAZYLOG'], sequencer)) as place from l group by sequencer",
    ),
    "fifo_cost": (
        lambda s, d: (
            _trials(s, d)
            .groupBy(_B)
            .pivot("load", [1, 2])
            .agg(F.median("us"))
            .select(_B, F.round(F.col("1"), 4).alias("plain"), F.round(F.col("2"), 4).alias("fifo"), F.round(100 * (F.col("2") - F.col("1")) / F.col("1"), 4).alias("cost_percent"))
        ),
        f"with {_SQL_TRIALS}, m as (select broker_id, median(us) filter (load = 1) as a, median(us) filter (load = 2) as b from trials group by broker_id) select broker_id, round(a, 4) as plain, round(b, 4) as fifo, round(100 * (b - a) / a, 4) as cost_percent from m",
    ),
    "floor_percentiles": (
        lambda s, d: percentiles.at_index(batches(s, d), "latency_us", _B, p50=percentiles.floor_index(0.5), p99=percentiles.floor_index(0.99), median=percentiles.upper_median),
        f"with {SQL_BATCHES}, l as (select broker_id, list_sort(list(latency_us)) as v from batches group by broker_id) select broker_id, v[least(len(v) - 1, floor(0.5 * len(v))::bigint) + 1] as p50, v[least(len(v) - 1, floor(0.99 * len(v))::bigint) + 1] as p99, v[len(v) // 2 + 1] as median from l",
    ),
    "isolation_gate": (
        lambda s, d: x.gate(_commits(s, d).groupBy("trial").agg((F.max("wall") > 9000).alias("valid")).withColumn("suite", F.col("trial") % 2), 2, "suite"),
        f"with {_ORDER5}, t as (select session_epoch as trial, max(release) > 9000 as valid from order5 group by 1) select trial % 2 as suite, count(*)::bigint as trials, count(*) = 2 as complete, bool_and(valid) and count(*) = 2 as passed from t group by 1",
    ),
    "failure_realtime": (
        lambda s, d: x.around_events(_rates(s, d), _kills(s, d).withColumnRenamed("kill", "at"), 12, 8),
        f"""with {_SQL_RATES}, r as (select r.key, kill, avg(rate) filter (tick < kill) as a, avg(rate) filter (tick >= kill) as b from rates r join kills k using (key) where tick >= kill - 12 and tick < kill + 8 group by all)
select key, kill as "at", round(a, 4) as before, round(b, 4) as after, round(case when a > 0 then b / a end, 6) as change from r""",
    ),
    "latency_tables": (
        lambda s, d: x.latency_table(batches(s, d).select(_B, F.col("num_msg").alias("load"), (F.col("batch_id") % 3).alias("trial"), "latency_us"), "latency_us", F.col(_B) == 0, _B),
        f"""with {SQL_BATCHES}, t as (select broker_id, num_msg as load, batch_id % 3 as trial, quantile_disc(latency_us, 0.5) as p50, quantile_disc(latency_us, 0.99) as p99 from batches group by all),
c as (select broker_id, load, round(median(p50), 4) as p50, round(case when count(*) > 1 then stddev_samp(p50) else 0 end, 4) as p50_sd, round(median(p99), 4) as p99, round(case when count(*) > 1 then stddev_samp(p99) else 0 end, 4) as p99_sd, count(*)::bigint as trials from t group by all)
select c.*, round(100 * (c.p50 / b.p50 - 1), 4) as p50_change, round(100 * (c.p99 / b.p99 - 1), 4) as p99_change from c join c b on b.load = c.load and b.broker_id = 0""",
    ),
    "failure_layers": (
        lambda s, d: traces.longest_stall(
            ordering.release(batches(s, d))
            .where("not (commit_epoch between 40 and 49 and client_id % 3 = 1)")
            .select((F.col("client_id") % 3).alias("c"), F.explode(F.array(F.struct(F.lit("sent").alias("layer"), F.col("epoch").alias("tick")), F.struct(F.lit("committed").alias("layer"), F.col("commit_epoch").alias("tick")), F.struct(F.lit("applied").alias("layer"), (F.col("commit_epoch") + 1).alias("tick")))).alias("l"), "num_msg")
            .groupBy(F.concat("l.layer", F.lit("-"), F.col("c").cast("string")).alias("series"), F.col("l.tick").alias("tick"))
            .agg(F.sum("num_msg").alias("n"))
            .select("series", "tick", F.sum("n").over(Window.partitionBy("series").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
            .where("tick % 2 = 0 or n > 3"),
            "series",
        ),
        f"""with {_ORDER5}, r as (select * from order5 where not (commit_epoch between 40 and 49 and client_id % 3 = 1)),
l as (select 'sent-' || client_id % 3 as series, epoch as tick, num_msg from r union all select 'committed-' || client_id % 3, commit_epoch, num_msg from r union all select 'applied-' || client_id % 3, commit_epoch + 1, num_msg from r),
n as (select series, tick, sum(num_msg) as n, sum(sum(num_msg)) over (partition by series order by tick) as cum from l group by series, tick), c as (select * from n where tick % 2 = 0 or n > 3),
m as (select *, coalesce((cum > lag(cum) over (partition by series order by tick))::int, 1) as m from c), q as (select *, sum(m) over (partition by series order by tick) as q from m),
g as (select series, q, min(tick) as since, max(tick) - min(tick) as length from q group by series, q) select series, length, since from (select *, row_number() over (partition by series order by length desc, since) as k from g) where k = 1""",
    ),
    "held_slots_let_go": (
        lambda s, d: x.slots_let_go(
            ordering.release(batches(s, d)).where("commit_epoch > epoch").select("broker_id", (F.col("pbr_index") % 1024).alias("slot"), "pbr_index", "batch_id"),
            ordering.release(batches(s, d)).where("commit_epoch <= 60").select("broker_id", (F.col("pbr_index") % 1024).alias("slot"), "pbr_index"),
        ).select("broker_id", "slot", "batch_id", "let_go"),
        f"with {_ORDER5} select broker_id, pbr_index % 1024 as slot, batch_id, commit_epoch <= 60 as let_go from order5 where commit_epoch > epoch",
    ),
    "late_policies": (
        lambda s, d: x.late_policies(slots.arrival_classes(faulty(s, d), faults.session_fences(faulty(s, d), LEASE)), "client_id"),
        f"""with {_FENCES}, c as (select f.client_id, f.num_msg, u.batch_id is not null as lead, p.release, f.arrival, f.arrival > n.fence_tick and f.batch_seq >= n.fence_seq as fenced from faulty f
  left join firsts u on u.client_id = f.client_id and u.session_epoch = f.session_epoch and u.batch_seq = f.batch_seq and u.arrival = f.arrival and u.broker_id = f.broker_id
  left join prefix p on p.client_id = f.client_id and p.session_epoch = f.session_epoch and p.batch_seq = f.batch_seq left join fences n on n.client_id = f.client_id and n.session_epoch = f.session_epoch),
k as (select client_id, num_msg, coalesce(not coalesce(fenced, false) and not lead and release <= arrival, false) as late, not coalesce(fenced, false) and lead and coalesce(release <> arrival, true) as held from c)
select client_id, sum(late::int)::bigint as dropped, sum(case when late then num_msg else 0 end)::bigint as credited, sum(late::int)::bigint as emitted, sum(late::int)::bigint as rejected, sum(held::int)::bigint as held from k group by client_id""",
    ),
    "delivery_stages": (
        lambda s, d: traces.tail_breakdown(
            traces.best_receive(_stages(s, d), batches(s, d).where("batch_id % 9 <> 0").select("batch_id", (F.col("latency_us") % 97).alias("latency_us"), F.col("num_msg").alias("age_us")), "batch_id").select("delivered", "ordered", (F.col("acked") - F.col("ordered")).alias("ack_wait"), (F.col("delivered") - F.col("acked") - F.coalesce("receive_us", F.lit(0))).alias("deliver_wait"), F.coalesce("receive_us", F.lit(0)).alias("receive")),
            "delivered",
            ["ordered", "ack_wait", "deliver_wait", "receive"],
            0.99,
        ),
        f"""with {_SQL_STAGES}, j as (select s.*, case when s.batch_id % 9 <> 0 then b.latency_us % 97 else 0 end as receive from stages s join batches b using (batch_id)), e as (select quantile_disc(delivered, 0.99) as edge from j),
m as (select count(*)::bigint as n, max(edge) as edge, round(avg(ordered), 4) as ordered, round(avg(acked - ordered), 4) as ack_wait, round(avg(delivered - acked - receive), 4) as deliver_wait, round(avg(receive), 4) as receive from j, e where delivered >= edge)
select *, case greatest(ordered, ack_wait, deliver_wait, receive) when ordered then 'ordered' when ack_wait then 'ack_wait' when deliver_wait then 'deliver_wait' else 'receive' end as dominant from m""",
    ),
}
