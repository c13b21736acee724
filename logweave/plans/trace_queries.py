"""Queries on traces and trials derived from the batch log, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.functions import percentiles
from logweave.operators import faults, ordering, traces
from logweave.plans.ordering_queries import LEASE, _FENCES, _ORDER5, _S
from logweave.sources.derived import SQL_BATCHES, SQL_FAULTY, batches, faulty

_B = "broker_id"


def _series(s, d):
    """Messages of each broker an epoch; broker 1 stands still in epochs 50 to 56."""
    by = batches(s, d).groupBy(_B, F.col("epoch").alias("tick")).agg(F.sum("num_msg").alias("n"))
    return by.select(_B, "tick", F.when((F.col(_B) == 1) & F.col("tick").between(50, 56), 0).otherwise(F.col("n")).cast("long").alias("rate"))


_SQL_SERIES = SQL_BATCHES + ", series as (select broker_id, epoch as tick, (case when broker_id = 1 and epoch between 50 and 56 then 0 else sum(num_msg) end)::bigint as rate from batches group by broker_id, epoch)"
_SQL_CUM = _SQL_SERIES + ", cums as (select broker_id, tick, sum(rate) over (partition by broker_id order by tick) as cum from series)"


def _cums(s, d):
    return _series(s, d).select(_B, "tick", F.sum("rate").over(Window.partitionBy(_B).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))


def _trials(s, d):
    """Trials of four systems (brokers) under five loads: mean latency."""
    return batches(s, d).groupBy(_B, F.col("num_msg").alias("load"), (F.expr("batch_id div 1000") % 10).alias("trial")).agg(F.avg("latency_us").alias("us"))


_SQL_TRIALS = SQL_BATCHES + ", trials as (select broker_id, num_msg as load, (batch_id // 1000) % 10 as trial, avg(latency_us) as us from batches group by all)"


def _gap_marks(s, d):
    return batches(s, d).where("batch_id % 5 < 2").select("client_id", "arrival", F.when(F.col("batch_id") % 5 == 0, "detect").otherwise("release").alias("kind"))


def _pressure(s, d):
    """Pressure counters of each client over the faulty log."""
    by = faults.session_pressure(faulty(s, d), LEASE).groupBy("client_id")
    return by.agg(*(F.sum(c).alias(c) for c in ("expiries", "holds", "skips", "late")), F.max("depth").alias("depth"))


def _audits(s, d):
    e = batches(s, d)
    return e.select(
        _B,
        F.col("num_msg").alias("load"),
        (F.col("batch_id") % 211 != 0).alias("valid"),
        F.when(F.col("batch_id") % 307 == 0, 1).otherwise(0).alias("reorders"),
        F.concat(F.lit("m"), (F.col("batch_id") % 2).cast("string")).alias("label"),
        F.when(F.col("batch_id") % 211 == 0, F.when(F.col("batch_id") % 2 == 0, "fifo+cas").otherwise("digest")).alias("failed"),
    )


def _stages(s, d):
    """Time of a batch until ordered, acknowledged and delivered."""
    return batches(s, d).select("batch_id", "broker_id", F.col("latency_us").alias("ordered"), (F.col("latency_us") + F.col("batch_id") % 300).alias("acked"), (F.col("latency_us") + F.col("batch_id") % 300 + F.col("batch_id") % 1700).alias("delivered"))


_SQL_STAGES = SQL_BATCHES + ", stages as (select batch_id, broker_id, latency_us as ordered, latency_us + batch_id % 300 as acked, latency_us + batch_id % 300 + batch_id % 1700 as delivered from batches)"


def _monotonic(s, d):
    wide = _stages(s, d).agg(*(percentiles.nearest_rank(c, p).cast("long").alias(f"{c}_{n}") for c in ("ordered", "acked", "delivered") for n, p in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999))), *(F.max(c).alias(f"{c}_max") for c in ("ordered", "acked", "delivered")))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("point"), *(F.col(f"{c}_{n}").alias(c) for c in ("ordered", "acked", "delivered"))) for n in ("p50", "p99", "p999", "max")))).alias("x")
    return wide.select(each).select("x.*").withColumn("monotonic", (F.col("ordered") <= F.col("acked")) & (F.col("acked") <= F.col("delivered")))


_STATS = "quantile_disc({0}, 0.5) as p50, quantile_disc({0}, 0.9) as p90, quantile_disc({0}, 0.95) as p95, quantile_disc({0}, 0.99) as p99, quantile_disc({0}, 0.999) as p999, min({0}) as least, max({0}) as most, round(avg({0}), 4) as mean, count({0})::bigint as n"

QUERIES = {
    "latency_summary": (lambda s, d: traces.summary(batches(s, d), "latency_us", _B), f"with {SQL_BATCHES} select broker_id, {_STATS.format('latency_us')} from batches group by broker_id"),
    "percentile_definitions": (
        lambda s, d: (
            batches(s, d)
            .groupBy(_B)
            .agg(percentiles.nearest_rank("latency_us", 0.9).cast("long").alias("nearest"), F.round(percentiles.linear("latency_us", 0.9), 4).alias("linear"))
            .join(percentiles.at_index(batches(s, d), "latency_us", _B, floor_index=percentiles.floor_index(0.9), upper_median=percentiles.upper_median), _B)
        ),
        f"with {SQL_BATCHES} select broker_id, quantile_disc(latency_us, 0.9) as nearest, round(quantile_cont(latency_us, 0.9), 4) as linear, list_sort(list(latency_us))[least(count(*) - 1, floor(0.9 * count(*))::bigint) + 1] as floor_index, list_sort(list(latency_us))[count(*) // 2 + 1] as upper_median from batches group by broker_id",
    ),
    "latency_cdf": (
        lambda s, d: traces.cdf(batches(s, d), "latency_us", "batch_id", _B).select(_B, "batch_id", "latency_us", "share"),
        f"with {SQL_BATCHES} select broker_id, batch_id, latency_us, round(row_number() over (partition by broker_id order by latency_us, batch_id) / count(*) over (partition by broker_id), 6) as share from batches",
    ),
    "tail_breakdown": (
        lambda s, d: traces.tail_breakdown(_stages(s, d).select("delivered", "ordered", (F.col("acked") - F.col("ordered")).alias("ack_wait"), (F.col("delivered") - F.col("acked")).alias("deliver_wait")), "delivered", ["ordered", "ack_wait", "deliver_wait"], 0.99),
        f"""with {_SQL_STAGES}, e as (select quantile_disc(delivered, 0.99) as edge from stages),
m as (select count(*)::bigint as n, max(edge) as edge, round(avg(ordered), 4) as ordered, round(avg(acked - ordered), 4) as ack_wait, round(avg(delivered - acked), 4) as deliver_wait from stages, e where delivered >= edge)
select *, case when ordered = greatest(ordered, ack_wait, deliver_wait) then 'ordered' when ack_wait = greatest(ordered, ack_wait, deliver_wait) then 'ack_wait' else 'deliver_wait' end as dominant from m""",
    ),
    "steady_throughput": (
        lambda s, d: traces.steady_rate(batches(s, d), "batch_id", "num_msg", "batch_id", _B),
        f"""with {SQL_BATCHES}, x as (select *, row_number() over (partition by broker_id order by batch_id) - 1 as i, count(*) over (partition by broker_id) as n from batches)
select broker_id, sum(num_msg)::bigint as size, max(batch_id) - min(batch_id) as span, case when max(batch_id) > min(batch_id) then round(sum(num_msg) / (max(batch_id) - min(batch_id)), 6) end as rate from x where i >= floor(n / 4) and i < floor(n * 3 / 4) group by broker_id""",
    ),
    "stall_detect": (
        lambda s, d: traces.stalls(_series(s, d), _B, 50, 10, 0.5),
        f"""with {_SQL_SERIES}, b as (select broker_id, quantile_cont(rate, 0.5) as baseline from series where tick >= 40 and tick < 50 group by broker_id),
a as (select *, min(rate) over w as m, count(rate) over w as c from series where tick >= 50 window w as (partition by broker_id order by tick rows between current row and 1 following)),
r as (select broker_id, baseline, min(rate) as least, min(case when c = 2 and m >= 0.5 * baseline then tick end) as recovered from a join b using (broker_id) group by broker_id, baseline)
select broker_id, baseline, round(least / baseline, 6) as dip, recovered, recovered - 50 as stall from r""",
    ),
    "isolation_verdict": (
        lambda s, d: traces.stalls(_series(s, d), _B, 50, 10, 0.5).select(_B, F.when(F.col(_B) == 1, "affected").otherwise("control").alias("role"), F.when(F.col(_B) == 1, F.lit(True)).otherwise((F.col("stall") <= 1) & (F.col("dip") >= 0.1)).alias("ok")),
        f"""with {_SQL_SERIES}, b as (select broker_id, quantile_cont(rate, 0.5) as baseline from series where tick >= 40 and tick < 50 group by broker_id),
a as (select *, min(rate) over w as m, count(rate) over w as c from series where tick >= 50 window w as (partition by broker_id order by tick rows between current row and 1 following)),
r as (select broker_id, min(rate) / baseline as dip, min(case when c = 2 and m >= 0.5 * baseline then tick end) - 50 as stall from a join b using (broker_id) group by broker_id, baseline)
select broker_id, case when broker_id = 1 then 'affected' else 'control' end as role, broker_id = 1 or (stall <= 1 and round(dip, 6) >= 0.1) as ok from r""",
    ),
    "overlap_throughput": (
        lambda s, d: traces.overlap_throughput(_cums(s, d), _B, "tick", "cum"),
        f"""with {_SQL_CUM}, w as (select max(a) as start, min(b) as stop from (select broker_id, min(tick) as a, max(tick) as b from cums group by broker_id)),
e as (select broker_id, arg_min(cum, tick) as c0, arg_max(cum, tick) as c1, min(tick) as t0, max(tick) as t1 from cums, w where tick between start and stop group by broker_id)
select broker_id, t0, t1, (c1 - c0)::bigint as progress, case when t1 > t0 then round((c1 - c0) / (t1 - t0), 6) end as rate from e""",
    ),
    "gap_pairs": (
        lambda s, d: traces.paired(_gap_marks(s, d), "client_id", "arrival", "kind", "detect", "release"),
        f"""with {SQL_BATCHES}, m as (select client_id, arrival, batch_id % 5 = 0 as det, row_number() over (partition by client_id, batch_id % 5 order by arrival) as n from batches where batch_id % 5 < 2)
select a.client_id, a.n, a.arrival as start, b.arrival as stop, b.arrival - a.arrival as held from m a join m b on a.client_id = b.client_id and a.n = b.n and a.det and not b.det""",
    ),
    "longest_stall": (
        lambda s, d: traces.longest_stall(_cums(s, d), _B),
        f"""with {_SQL_CUM}, m as (select *, coalesce((cum > lag(cum) over (partition by broker_id order by tick))::int, 1) as m from cums), r as (select *, sum(m) over (partition by broker_id order by tick) as r from m),
g as (select broker_id, r, min(tick) as since, max(tick) - min(tick) as length from r group by broker_id, r) select broker_id, length, since from (select *, row_number() over (partition by broker_id order by length desc, since) as k from g) where k = 1""",
    ),
    "trial_ci": (
        lambda s, d: traces.trial_stats(_trials(s, d), "us", _B, "load", warmup=1, least=2),
        f"""with {_SQL_TRIALS}, k as (select *, row_number() over (partition by broker_id, load order by trial) as i, count(*) over (partition by broker_id, load) as n from trials)
select broker_id, load, count(us)::bigint as n, round(avg(us), 4) as mean, round(case when count(us) = 1 then 0 else stddev_samp(us) end, 4) as sd, round(1.96 * case when count(us) = 1 then 0 else stddev_samp(us) end / sqrt(count(us)), 4) as ci95, round(100 * stddev_pop(us) / avg(us), 4) as cv_percent
from k where n - 1 < 2 or i > 1 group by broker_id, load""",
    ),
    "median_band": (
        lambda s, d: _trials(s, d).groupBy(_B).agg(F.round(F.median("us"), 4).alias("median"), F.round(F.min("us"), 4).alias("lo"), F.round(F.max("us"), 4).alias("hi")),
        f"with {_SQL_TRIALS} select broker_id, round(median(us), 4) as median, round(min(us), 4) as lo, round(max(us), 4) as hi from trials group by broker_id",
    ),
    "speedup_pivot": (
        lambda s, d: _trials(s, d).groupBy("load").pivot(_B, [0, 1, 2, 3]).agg(F.round(F.median("us"), 4)).select("load", *(F.col(str(k)).alias(f"broker{k}") for k in range(4)), F.round(F.col("0") / F.col("1"), 6).alias("speedup")),
        f"with {_SQL_TRIALS}, m as (select load, " + ", ".join(f"round(median(us) filter (broker_id = {k}), 4) as broker{k}" for k in range(4)) + " from trials group by load) select *, round(broker0 / broker1, 6) as speedup from m",
    ),
    "ablation_delta": (
        lambda s, d: traces.against(_trials(s, d).groupBy("load", _B).agg(F.round(F.median("us"), 4).alias("us")), _B, F.col(_B) == 0, "us", "load"),
        f"""with {_SQL_TRIALS}, m as (select load, broker_id, round(median(us), 4) as us from trials group by all), b as (select load, us as base from m where broker_id = 0)
select load, broker_id, us, round(us - base, 4) as delta, round(100 * (us - base) / base, 4) as delta_percent, round(us / base, 6) as ratio from m join b using (load)""",
    ),
    "quality_flags": (
        lambda s, d: traces.quality_flags(_trials(s, d).withColumn("us", F.when((F.col("load") == 5) & (F.col(_B) < 2) & (F.col("trial") > F.col(_B) - 1), None).otherwise(F.col("us"))), "us", _B, "load"),
        f"""with {_SQL_TRIALS}, t as (select broker_id, load, case when load = 5 and broker_id < 2 and trial > broker_id - 1 then null else us end as us from trials)
select broker_id, load, count(us)::bigint as n, round(quantile_cont(us, 0.5), 4) as median, case when count(us) = 0 then 'missing' when count(us) = 1 then 'single_trial' when (max(us) - min(us)) / quantile_cont(us, 0.5) > 0.40 then 'high_variance' else 'ok' end as flag from t group by broker_id, load""",
    ),
    "completeness_gate": (
        lambda s, d: traces.completeness(_trials(s, d).where("not (broker_id = 2 and trial = 3)").withColumns({"commit": F.when((F.col(_B) == 1) & (F.col("trial") == 0), "b").otherwise("a"), "dirty": (F.col(_B) == 3) & (F.col("load") == 2)}), 10, _B, "load"),
        f"""with {_SQL_TRIALS}, t as (select *, case when broker_id = 1 and trial = 0 then 'b' else 'a' end as c, broker_id = 3 and load = 2 as dirty from trials where not (broker_id = 2 and trial = 3)),
g as (select broker_id, load, count(*)::bigint as n, list_filter([case when count(*) <> 10 then 'count' end, case when list_sort(list(distinct trial)) <> range(10) then 'ids' end, case when count(distinct c) <> 1 then 'commits' end, case when bool_or(dirty) then 'dirty' end], lambda x: x is not null) as p from t group by broker_id, load)
select broker_id, load, n, array_to_string(p, '+') as problems, len(p) = 0 as complete from g""",
    ),
    "consensus_validity": (
        lambda s, d: traces.consensus(_audits(s, d), _B, "load"),
        f"""with {SQL_BATCHES}, a as (select broker_id, num_msg as load, batch_id % 211 <> 0 as valid, batch_id % 307 = 0 as r, 'm' || (batch_id % 2) as label, case when batch_id % 211 = 0 then case when batch_id % 2 = 0 then ['fifo', 'cas'] else ['digest'] end else [] end as f from batches)
select broker_id, load, bool_and(valid and not r) as valid, array_to_string(list_sort(list(distinct label)), ',') as labels, array_to_string(list_sort(list_distinct(flatten(list(f)))), '+') as failed from a group by broker_id, load""",
    ),
    "rolling_mean": (
        lambda s, d: traces.rolling_mean(_series(s, d), _B, "rate"),
        f"with {_SQL_SERIES} select broker_id, tick, rate, round(avg(rate) over (partition by broker_id order by tick rows between 2 preceding and current row), 6) as rolling from series",
    ),
    "trimmed_tail": (
        lambda s, d: traces.trimmed_end(_series(s, d), _B, "rate"),
        f"with {_SQL_SERIES}, p as (select *, max(rate) over (partition by broker_id) as p from series) select broker_id, max(tick) as last, max(p) as peak from p where rate >= 0.7 * p group by broker_id",
    ),
    "interpolated_counts": (
        lambda s, d: traces.interpolated(_series(s, d).withColumn("rate", F.when(F.col("tick") % 4 != 1, F.col("rate"))), _B, "rate").select(_B, "tick", "rate", "filled"),
        f"""with {_SQL_SERIES}, k as (select broker_id, tick, case when tick % 4 <> 1 then rate end as rate, case when tick % 4 <> 1 then tick end as t from series),
x as (select *, last_value(rate ignore nulls) over b as ra, last_value(t ignore nulls) over b as ta, first_value(rate ignore nulls) over a as rb, first_value(t ignore nulls) over a as tb from k
  window b as (partition by broker_id order by tick rows between unbounded preceding and current row), a as (partition by broker_id order by tick rows between current row and unbounded following))
select broker_id, tick, rate, round(coalesce(rate::double, case when tb > ta then ra + (rb - ra) / (tb - ta) * (tick - ta) end), 6) as filled from x""",
    ),
    "intercommit_gap": (
        lambda s, d: traces.intercommit(ordering.release(batches(s, d)).select("client_id", (F.col("release") * 1000 + F.col("batch_seq")).alias("commit")), "client_id", "commit", 5),
        f"""with {_ORDER5}, r as (select client_id, release * 1000 + batch_seq as t from order5), m as (select *, row_number() over (partition by client_id order by t) as i, count(*) over (partition by client_id) as n from r),
g as (select client_id, t - lag(t) over (partition by client_id order by t) as g from m where i > 5 and i <= n - 5) select client_id, max(g) as gap, count(*)::bigint as commits from g group by client_id""",
    ),
    "top_pressure_clients": (
        lambda s, d: traces.top_pressure(_pressure(s, d)),
        f"""with {_FENCES}, sk as (select {_S}, batch_seq - 1 - coalesce(lag(batch_seq) over (partition by {_S} order by batch_seq), -1) as k from firsts),
x as (select client_id, max(batch_seq) as depth from firsts group by client_id), l as (select client_id, count(*) - count(distinct batch_seq) as late from faulty group by client_id),
h as (select client_id, sum((release > arrival)::int) as holds from prefix group by client_id), s as (select client_id, sum(k) as skips from sk group by client_id), e as (select client_id, count(*) as expiries from fences group by client_id)
select client_id, coalesce(expiries, 0)::bigint as expiries, coalesce(holds, 0)::bigint as holds, coalesce(skips, 0)::bigint as skips, late::bigint as late, depth from x join l using (client_id) left join h using (client_id) left join s using (client_id) left join e using (client_id)
order by expiries desc, holds desc, skips desc, late desc, depth desc, client_id desc limit 8""",
    ),
    "stage_monotonic": (
        _monotonic,
        f"with {_SQL_STAGES}, x as ("
        + " union all ".join(f"select '{n}' as point, " + ", ".join(f"quantile_disc({c}, {p}) as {c}" for c in ("ordered", "acked", "delivered")) + " from stages" for n, p in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999), ("max", 1.0)))
        + ") select *, ordered <= acked and acked <= delivered as monotonic from x",
    ),
    "best_receive": (
        lambda s, d: traces.best_receive(batches(s, d).select("batch_id", "broker_id"), batches(s, d).where("batch_id % 9 <> 0").select(F.explode(F.array("batch_id", F.col("batch_id") - F.col("batch_id") % 2)).alias("batch_id"), "latency_us", F.col("num_msg").alias("age_us")), "batch_id"),
        f"""with {SQL_BATCHES}, r as (select unnest([batch_id, batch_id - batch_id % 2]) as batch_id, latency_us, num_msg as age_us from batches where batch_id % 9 <> 0), m as (select *, row_number() over (partition by batch_id order by latency_us, age_us) as k from r)
select b.batch_id, broker_id, m.latency_us as receive_us, m.age_us from batches b left join m on m.batch_id = b.batch_id and k = 1""",
    ),
    "missing_cells": (
        lambda s, d: traces.cells(_trials(s, d).where("not (broker_id = 1 and load = 2)").select(_B, "load", "trial"), _trials(s, d).where("trial <> 4").select(_B, "load", "trial"), _B, "load", "trial"),
        f"with {_SQL_TRIALS} select broker_id, load, trial, case when trial = 4 then 'missing' else 'extra' end as state from trials where (trial = 4) <> (broker_id = 1 and load = 2)",
    ),
    "rtt_ewma": (
        lambda s, d: traces.round_trip(batches(s, d).withColumn("resent", F.col("batch_id") % 13 == 0), "client_id", "batch_seq", "latency_us", "resent"),
        f"""with recursive {SQL_BATCHES}, v as (select client_id, latency_us::double as v, row_number() over (partition by client_id order by batch_seq) as i from batches where batch_id % 13 <> 0),
f as (select client_id, i, v as m, v / 2 as d from v where i = 1 union all select f.client_id, v.i, m + (v - m) / 8, d + (abs(v - m) - d) / 4 from f join v on v.client_id = f.client_id and v.i = f.i + 1)
select client_id, max(i)::bigint as samples, round(arg_max(m, i), 3) as mean, round(arg_max(d, i), 3) as deviation, round(least(12000.0, greatest(1700.0, arg_max(m, i) + 4 * arg_max(d, i))), 3) as delta from f group by client_id""",
    ),
    "failure_summary": (
        lambda s, d: _series(s, d).where("rate > 10").groupBy(_B).agg(F.count("*").alias("active"), F.round(F.avg("rate"), 4).alias("mean"), F.round(F.stddev_pop("rate"), 4).alias("sd"), F.max("rate").alias("peak"), F.sum(F.col("tick").between(50, 60).cast("long")).alias("after_kill")),
        f"with {_SQL_SERIES} select broker_id, count(*)::bigint as active, round(avg(rate), 4) as mean, round(stddev_pop(rate), 4) as sd, max(rate) as peak, sum((tick between 50 and 60)::int)::bigint as after_kill from series where rate > 10 group by broker_id",
    ),
    "late_credit": (
        lambda s, d: faulty(s, d).groupBy("client_id").agg(F.count("*").alias("arrived"), (F.count("*") - F.count_distinct("batch_seq")).alias("late_copies")),
        f"with {SQL_FAULTY} select client_id, count(*)::bigint as arrived, (count(*) - count(distinct batch_seq))::bigint as late_copies from faulty group by client_id",
    ),
}
