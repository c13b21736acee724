"""Queries on recovery, audits and validation, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.operators import baselines, faults, ordering, recovery, state
from logweave.plans.ordering_queries import LEASE, _FENCES, _GOI, _S, _fences, _goi
from logweave.sources.derived import SQL_BATCHES, batches, faulty

_ROWS = ["client_id", "session_epoch", "batch_seq", "num_msg", "goi", "total_order"]


def _floor(goi):
    """A durable floor at nine tenths of the order."""
    return goi.agg(F.expr("(max(goi) + 1) * 9 div 10").alias("floor"))


_FLOOR = "floors as (select (max(goi) + 1) * 9 // 10 as floor from goi)"


def _damaged(s, d):
    """The fenced order with faults in it: lost places, batches twice, numbers moved, fences that came earlier."""
    goi = _goi(s, d).select(*_ROWS)
    kept = goi.where("goi % 307 <> 5").withColumn("batch_seq", F.when(F.col("goi") % 401 == 7, F.col("batch_seq") + 2).otherwise(F.col("batch_seq")))
    return kept.unionByName(goi.where("goi % 211 = 3").withColumn("goi", F.col("goi") + 50))


_DAMAGED = """dam as (select client_id, session_epoch, case when goi % 401 = 7 then batch_seq + 2 else batch_seq end as batch_seq, num_msg, goi, total_order from goi where goi % 307 <> 5
  union all select client_id, session_epoch, batch_seq, num_msg, goi + 50, total_order from goi where goi % 211 = 3)"""


def _checked(goi, fences, acked, read, floor, capacity):
    return recovery.invariants(goi, fences, acked, read, floor, capacity)


def _acks(goi, floor, extra):
    durable = goi.crossJoin(F.broadcast(floor)).where("goi < floor").groupBy("client_id", "session_epoch").agg((F.max("batch_seq") + 1).alias("n"))
    return durable.select("client_id", "session_epoch", (F.col("n") + extra).alias("acked_next"))


def _read(goi):
    return goi.select(F.col("goi").alias("place"), "client_id", "session_epoch", "batch_seq")


def _sound(s, d):
    goi = _goi(s, d).select(*_ROWS)
    return _checked(goi, _fences(s, d), _acks(goi, _floor(goi), 0), _read(goi), _floor(goi), 100_000_000)


def _unsound(s, d):
    goi, bad = _goi(s, d).select(*_ROWS), _damaged(s, d)
    fences = _fences(s, d).withColumn("fence_seq", F.greatest(F.col("fence_seq") - 1, F.lit(0)))
    return _checked(bad, fences, _acks(goi, _floor(goi), F.when(F.col("client_id") % 7 == 0, 1).otherwise(0)), _read(goi.where("goi % 2 = 0")), _floor(goi), 100)


def _sql_invariants(goi, fences, acked, read, capacity):
    """One subquery for each invariant."""
    return f"""select unnest(['NoDupCommit', 'PerSessionPrefix', 'LateNeverReordered', 'FencedSuffixNeverCommitted', 'NoWrap', 'AckedIffCommitted', 'DenseOrder', 'DenseMessages', 'ReaderAgreement']) as invariant,
unnest([(select count(*) - count(distinct (client_id, session_epoch, batch_seq)) from {goi}),
 (select count(*) from (select max(batch_seq) + 1 as t, count(distinct batch_seq) as u from {goi} group by {_S}) where t <> u),
 (select count(*) from (select batch_seq, lag(batch_seq) over (partition by {_S} order by goi) as p from {goi}) where p >= batch_seq),
 (select count(*) from {goi} join ({fences}) using ({_S}) where batch_seq >= fence_seq),
 (select greatest(max(goi) + 1 - (select floor from floors) - {capacity}, 0) from {goi}),
 (select count(*) from ({acked}) left join (select {_S}, max(batch_seq) + 1 as sure from {goi}, floors where goi < floor group by {_S}) using ({_S}) where acked_next > coalesce(sure, 0)),
 (select abs(max(goi) + 1 - count(*)) from {goi}), (select abs(max(total_order + num_msg) - sum(num_msg)) from {goi}),
 (select count(*) from ({read}) r left join {goi} g on g.goi = r.goi, floors where r.goi < floor and not coalesce(g.client_id = r.client_id and g.session_epoch = r.session_epoch and g.batch_seq = r.batch_seq, false))])::bigint as violations"""


_SOUND_ACKS = f"select {_S}, max(batch_seq) + 1 as acked_next from goi, floors where goi < floor group by {_S}"


def _reports(s, d):
    """Each replica's cut by epoch, as reported: every third report is late by a round."""
    rows = batches(s, d).withColumn("round", F.col("epoch") + F.when(F.col("batch_id") % 3 == 0, 1).otherwise(0))
    return rows.groupBy("round", "broker_id", (F.col("batch_id") % 8).cast("long").alias("r")).agg(F.max("pbr_index").alias("cut_cum")).select("round", "broker_id", F.expr("r div 4").alias("replica"), "cut_cum")


_REPORTS = SQL_BATCHES + ", reports as (select epoch + case when batch_id % 3 = 0 then 1 else 0 end as round, broker_id, batch_id % 8 // 4 as replica, max(pbr_index) as cut_cum from batches group by all)"


def _transports(s, d, lost):
    reports = _reports(s, d)
    arrived = reports.where(lost) if lost else reports
    a = baselines.global_cuts(reports, 4, 2).select("round", "broker_id", "cut_cum")
    b = recovery.cuts_from_mailbox(arrived.unionByName(arrived.where("round % 2 = 0")), reports.select("round"), 4, 2).select("round", "broker_id", "cut_cum")
    return recovery.differences(a, b, ("called", "mailbox"))


def _sql_cuts(name, where):
    return f"""{name}_g as (select round, broker_id, replica from (select distinct round from reports), (select distinct broker_id, replica from reports)),
{name}_h as (select g.*, max(r.cut_cum) over (partition by g.broker_id, g.replica order by g.round) as c from {name}_g g left join (select round, broker_id, replica, max(cut_cum) as cut_cum from reports where {where} group by all) r using (round, broker_id, replica)),
{name} as (select round, broker_id, min(c) as cut_cum from {name}_h where round in (select round from {name}_h group by round having count(c) = 8) group by all)"""


_LOST = "not (broker_id = 2 and replica = 1 and round between 30 and 33)"


def _writes(s, d):
    """FIFO writes of three systems (session epochs) on ten keys of each client: what was sent, and where it was applied."""
    e = batches(s, d).where("batch_seq is not null")
    key = F.col("client_id") * 10 + F.col("batch_seq") % 7
    place = F.when(F.col("session_epoch") == 1, F.col("arrival") * 1_000_000 + F.col("batch_id")).otherwise(F.col("batch_id"))
    return e.select("client_id", "session_epoch", key.alias("k"), (F.col("batch_seq") + 1).alias("version"), place.alias("place"), (F.col("batch_id") % 331 != 330).alias("applied"))


_WRITES = SQL_BATCHES + ", writes as (select client_id, session_epoch, client_id * 10 + batch_seq % 7 as k, batch_seq + 1 as version, case when session_epoch = 1 then arrival * 1000000 + batch_id else batch_id end as place, batch_id % 331 <> 330 as applied from batches)"


def _validation(s, d):
    w = _writes(s, d)
    key = lambda c: F.concat(F.lit("k"), F.lpad(c.cast("string"), 12, "0"))
    sent = w.groupBy("k").agg(F.max("version").alias("v"))
    grid = w.select("client_id", "session_epoch").distinct().select("session_epoch", F.explode(F.sequence(F.col("client_id") * 10, F.col("client_id") * 10 + 9)).alias("k"))
    expected = grid.join(sent, "k", "left").select("session_epoch", key(F.col("k")).alias("key"), F.when(F.col("v").isNotNull(), state.fifo_value(F.col("k"), F.col("v"), 40)).alias("value"))
    last = w.where("applied").groupBy("k").agg(F.max_by("version", "place").alias("v"))
    left = grid.select("k").join(last, "k", "left").select(key(F.col("k")).alias("key"), F.when(F.col("v").isNotNull(), state.fifo_value(F.col("k"), F.col("v"), 40)).when(F.col("k") % 370 == 9, "junk").otherwise("template").alias("value"))
    found = recovery.final_validation(expected, left, "template", "session_epoch")
    done = w.where("applied")
    sessions = state.fifo_audit(done, ["session_epoch", "client_id"], "version", "place").groupBy("session_epoch").agg(F.sum("reorders").alias("session_reorders"))
    keys = state.fifo_audit(done, ["session_epoch", "k"], "version", "place").groupBy("session_epoch").agg(F.sum("reorders").alias("key_reorders"))
    checks = recovery.failed_checks(session_fifo_apply_order=F.col("session_reorders") > 0, session_fifo_final_value=F.col("final_mismatch") > 0, untouched_key_value=F.col("untouched_mismatch") > 0)
    return found.join(sessions, "session_epoch").join(keys, "session_epoch").withColumn("failed", checks).withColumn("valid", F.col("failed") == "")


def _kv_ops(s, d):
    e = F.col("batch_id")
    op = F.when(e % 29 == 3, "DELETE").when(e % 3 == 0, "PUT").otherwise("RMW")
    return batches(s, d).select((e % 257).alias("key"), e.alias("place"), op.alias("op"), F.when(op == "PUT", F.concat(F.lit("v"), e.cast("string"))).alias("value"))


def _cas_texts(s, d):
    """Compare-and-set texts, some cut short or with a letter among the digits."""
    e = F.col("batch_id")
    text = state.cas_value(F.col("client_id"), F.col("batch_seq"), F.col("batch_seq") + 1, 64)
    odd = F.when(e % 41 == 0, F.substring(text, 1, 40)).when(e % 43 == 0, F.concat(F.substring(text, 1, 20), F.lit("a"), F.expr("''"), F.substring(text, 22, 43))).when(e % 47 == 0, state.fifo_value(F.col("client_id"), F.col("batch_seq"), 64)).otherwise(text)
    return batches(s, d).select("batch_id", odd.alias("text"))


QUERIES = {
    "failover_order": (
        lambda s, d: recovery.failover(_goi(s, d), _floor(_goi(s, d)))[0].select("goi", "client_id", "session_epoch", "batch_seq"),
        f"with {_GOI}, {_FLOOR} select goi, client_id, session_epoch, batch_seq from goi, floors where goi < floor",
    ),
    "failover_state": (
        lambda s, d: recovery.failover_state(_goi(s, d), _floor(_goi(s, d)), 4),
        f"with {_GOI}, {_FLOOR} select {_S}, coalesce(max(batch_seq) filter (goi < floor), -1) + 1 as next_expected, (count(*) filter (goi >= floor))::bigint as orphaned, coalesce(sum(num_msg) filter (goi < floor), 0)::bigint as messages, 5::bigint as control_epoch from goi, floors group by {_S}",
    ),
    "reopened_sessions": (lambda s, d: recovery.reopened(_fences(s, d)), f"with {_FENCES} select client_id, session_epoch + 1 as generation, coalesce(committed_hwm + 1, 0) as next_seq from fences"),
    "reconnect_answers": (
        lambda s, d: ordering.release(faulty(s, d)).groupBy("client_id", "session_epoch").agg((F.max("batch_seq") + 1).alias("n")).select("client_id", "session_epoch", recovery.reconnect_hwm(recovery.inclusive_hwm(F.col("n") - F.col("client_id") % 3), F.when(F.col("client_id") % 5 != 0, recovery.inclusive_hwm(F.col("n") - F.col("client_id") % 4))).alias("hwm")),
        f"""with {_FENCES}, n as (select {_S}, max(batch_seq) + 1 as n from prefix group by {_S}), h as (select {_S}, nullif(n - client_id % 3 - 1, -1) as a, case when client_id % 5 <> 0 then nullif(n - client_id % 4 - 1, -1) end as b, n from n),
x as (select {_S}, case when a < 0 then null else a end as a, case when b < 0 then null else b end as b from h) select {_S}, case when b is null then a when a is not null then least(a, b) end as hwm from x""",
    ),
    "merged_sessions": (
        lambda s, d: recovery.merged_state(
            faults.recovered_committed(_goi(s, d).where("client_id % 11 <> 0")),
            batches(s, d).where("client_id % 13 <> 0").groupBy("client_id", "session_epoch").agg((F.count("*") - 3 - F.col("client_id") % 5).alias("expected_seq")),
        ),
        f"""with {_GOI}, g as (select * from goi where client_id % 11 <> 0), c as (select max(goi) as committed from (select goi, row_number() over (order by goi) - 1 as k from g) where goi = k),
a as (select {_S}, max(batch_seq) + 1 as x from g, c where goi <= committed group by {_S}), b as (select {_S}, count(*) - 3 - client_id % 5 as y from batches where client_id % 13 <> 0 group by {_S})
select {_S}, greatest(x, y) as next_expected, case when x is null then 'table' when y is null then 'order' else 'both' end as known_by from a full join b using ({_S})""",
    ),
    "invariants": (_sound, f"with {_GOI}, {_FLOOR} " + _sql_invariants("goi", "select * from fences", _SOUND_ACKS, "select * from goi", 100_000_000)),
    "invariants_violated": (
        _unsound,
        f"with {_GOI}, {_FLOOR}, {_DAMAGED} "
        + _sql_invariants("dam", "select client_id, session_epoch, greatest(fence_seq - 1, 0) as fence_seq from fences", f"select client_id, session_epoch, acked_next + case when client_id % 7 = 0 then 1 else 0 end as acked_next from ({_SOUND_ACKS})", "select * from goi where goi % 2 = 0", 100),
    ),
    "transport_equality": (
        lambda s, d: baselines.global_cuts(_reports(s, d), 4, 2).agg(F.count("*").alias("cuts"), F.sum("cut_cum").alias("messages")).crossJoin(_transports(s, d, None).agg(F.count("*").alias("different"))),  # two single rows
        f"with {_REPORTS}, {_sql_cuts('a', 'true')}, {_sql_cuts('b', 'true')} select (select count(*) from a)::bigint as cuts, (select sum(cut_cum) from b)::bigint as messages, ((select count(*) from (select * from a except all select * from b)) + (select count(*) from (select * from b except all select * from a)))::bigint as different",
    ),
    "transport_difference": (
        lambda s, d: _transports(s, d, _LOST),
        f"with {_REPORTS}, {_sql_cuts('a', 'true')}, {_sql_cuts('b', _LOST)} select *, 'called' as only from (select * from a except all select * from b) union all select *, 'mailbox' from (select * from b except all select * from a)",
    ),
    "kv_final_validation": (
        _validation,
        f"""with {_WRITES}, sent as (select k, max(version) as v from writes group by k), grid as (select session_epoch, client_id * 10 + unnest(range(10)) as k from (select distinct client_id, session_epoch from writes)),
fin as (select k, arg_max(version, place) as f from writes where applied group by k), x as (select session_epoch, k, v, f, case when v is not null then v is not distinct from f else f is null and k % 370 <> 9 end as fine from grid left join sent using (k) left join fin using (k)),
m as (select session_epoch, (count(v))::bigint as overwritten, (count(*) filter (v is not null and not fine))::bigint as final_mismatch, (count(*) filter (v is null and not fine))::bigint as untouched_mismatch from x group by session_epoch),
r as (select session_epoch, version < max(version) over (partition by session_epoch, client_id order by place rows between unbounded preceding and 1 preceding) as a, version < max(version) over (partition by session_epoch, k order by place rows between unbounded preceding and 1 preceding) as b from writes where applied),
q as (select session_epoch, coalesce(sum(a::int), 0)::bigint as session_reorders, coalesce(sum(b::int), 0)::bigint as key_reorders from r group by session_epoch),
f as (select m.*, session_reorders, key_reorders, array_to_string(list_filter([case when session_reorders > 0 then 'session_fifo_apply_order' end, case when final_mismatch > 0 then 'session_fifo_final_value' end, case when untouched_mismatch > 0 then 'untouched_key_value' end], lambda z: z is not null), '+') as failed from m join q using (session_epoch))
select *, failed = '' as valid from f""",
    ),
    "kv_rmw_live": (
        lambda s, d: state.read_modify_write_live(_kv_ops(s, d), "|rmw", 24),
        f"""with {SQL_BATCHES}, o as (select batch_id % 257 as key, batch_id as place, case when batch_id % 29 = 3 then 'DELETE' when batch_id % 3 = 0 then 'PUT' else 'RMW' end as op from batches),
g as (select *, sum((op <> 'RMW')::int) over (partition by key order by place rows unbounded preceding) as grp from o), t as (select key, max(grp) as grp, count(*)::bigint as ops from g group by key),
x as (select t.key, t.ops, max(case when op = 'PUT' then 'v' || place end) as base, max((op = 'PUT')::int) as put, sum((op = 'RMW')::int)::int as n from t join g on g.key = t.key and g.grp = t.grp group by all)
select key, case when n > 0 then left(coalesce(base, '') || repeat('|rmw', least(n, 24)), 24) when put = 1 then base end as value, ops from x""",
    ),
    "kv_cas_texts": (
        lambda s, d: _cas_texts(s, d).select("batch_id", "text", state.parsed_cas(F.col("text")).alias("p")).select("batch_id", F.length("text").cast("long").alias("size"), "p.key", "p.expected", "p.new"),
        f"""with {SQL_BATCHES}, t as (select batch_id, client_id, batch_seq, batch_id % 41 = 0 as short, batch_id % 43 = 0 as letter, batch_id % 47 = 0 as fifo from batches)
select batch_id, (case when short then 40 else 64 end)::bigint as size, case when not (short or letter or fifo) then client_id end as key, case when not (short or letter or fifo) then batch_seq end as expected, case when not (short or letter or fifo) then batch_seq + 1 end as new from t""",
    ),
    "record_crc32c": (
        lambda s, d: batches(s, d).select("batch_id", state.crc32c(F.concat(F.lit("record-"), F.col("batch_id").cast("string"), F.lit("-"), F.col("client_id").cast("string"))).alias("crc32c")),
        f"""with {SQL_BATCHES}, t as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 2197175160) else c >> 1 end)) as steps),
r as (select batch_id, 'record-' || batch_id || '-' || client_id as text from batches)
select batch_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(text) + 1), lambda k: ascii(substr(text, k, 1))::bigint)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)::bigint as crc32c from r, t""",
    ),
    "session_fifo_audit": (
        lambda s, d: state.fifo_audit(_writes(s, d).where("applied and client_id % 2 = 1"), ["session_epoch", "client_id"], "version", "place"),
        f"""with {_WRITES}, r as (select session_epoch, client_id, version < max(version) over (partition by session_epoch, client_id order by place rows between unbounded preceding and 1 preceding) as r from writes where applied and client_id % 2 = 1)
select session_epoch, client_id, count(*)::bigint as applied, coalesce(sum(r::int), 0)::bigint as reorders from r group by all""",
    ),
}
