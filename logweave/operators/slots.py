"""Slots of the ingest rings and what follows from them: publication, claims, levels, markers, exports, completions, tickets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from pyspark.sql.window import Window

from logweave.operators.ordering import SESSION, contiguous, first_copies, numbered, prefix_sums, release

#: Bits of a slot's flags. Fixed values of the layout.
CLAIMED, VALID, RETIRED = 1, 2, 4


def published() -> Column:
    """Whether a slot is published: its commit word, null while uncommitted, names the slot's own absolute index."""
    return F.coalesce(F.col("publish_commit") == F.col("pbr_index"), F.lit(False))


def still_owned(slots: DataFrame, claims: DataFrame) -> DataFrame:
    """claims(broker_id, slot, pbr_index, batch_id) with `owned`: the slot holds that very claim, flagged claimed and no
    more, uncommitted and incomplete."""
    there = slots.select("broker_id", "slot", F.col("pbr_index").alias("_p"), F.col("batch_id").alias("_b"), "flags", "publish_commit", "complete")
    alone = F.col("flags").bitwiseAND(CLAIMED | VALID | RETIRED) == CLAIMED
    owned = (F.col("_p") == F.col("pbr_index")) & (F.col("_b") == F.col("batch_id")) & alone & F.col("publish_commit").isNull() & ~F.col("complete")
    return claims.join(there, ["broker_id", "slot"], "left").withColumn("owned", F.coalesce(owned, F.lit(False))).select(*claims.columns, "owned")


def by_level(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches of no session (client 0), which need no order, and the others."""
    return batches.where("client_id = 0"), batches.where("client_id <> 0")


def epoch_ready(batches: DataFrame) -> DataFrame:
    """What each epoch commits: its level-0 batches as they come, with the level-5 ones that are released in it. A batch
    that waits is deferred and comes again with the epoch that releases it."""
    plain, chained = by_level(batches)
    ready = plain.withColumns({"release": F.col("arrival"), "commit_epoch": F.col("epoch"), "level": F.lit(0)})
    return ready.unionByName(release(chained).withColumn("level", F.lit(5)))


def with_held_markers(batches: DataFrame) -> DataFrame:
    """The committed log as an epoch hands it over: a batch that was held leaves an empty marker in its epoch of arrival."""
    done = release(batches).withColumn("marker", F.lit(False))
    held = done.where("commit_epoch > epoch").withColumns({"commit_epoch": F.col("epoch"), "num_msg": F.lit(0).cast("long"), "marker": F.lit(True)})
    return done.unionByName(held)


def numbered_without_markers(rows: DataFrame) -> DataFrame:
    """Global numbers; markers and skipped slots are left out before any sum."""
    return numbered(rows.where(~F.col("marker")), "commit_epoch", [*SESSION, "batch_seq"])


def consumed_through(rows: DataFrame) -> DataFrame:
    """For each broker the slots that are accounted for without a hole, markers too: how far its ring may be reused."""
    seen = rows.select("broker_id", "pbr_index").distinct()
    return contiguous(seen, ["broker_id"], "pbr_index").groupBy("broker_id").agg((F.max("pbr_index") + 1).alias("consumed_through"))


def slot_export(slots: DataFrame, cursors: DataFrame) -> DataFrame:
    """What each broker's export reads next from its cursor (first slot to read): published slots up to the first that isn't."""
    here = slots.join(F.broadcast(cursors), "broker_id").where("pbr_index >= cursor")  # a row for each broker
    fine = here.withColumn("_p", published())
    hole = fine.groupBy("broker_id").agg(F.min(F.when(~F.col("_p"), F.col("pbr_index"))).alias("_h"))
    open_ = fine.join(F.broadcast(hole), "broker_id").where(F.col("_h").isNull() | (F.col("pbr_index") < F.col("_h")))
    return open_.drop("_p", "_h", "cursor")


def written_scan(rows: DataFrame, last: DataFrame) -> DataFrame:
    """Export scan without an order: each broker's batches that start at or above what was read last."""
    return rows.join(F.broadcast(last), "broker_id").where(F.col("written") >= F.col("last")).drop("last")  # a row for each broker


def ordered_completions(done: DataFrame) -> DataFrame:
    """(broker_id, acked): completions (broker_id, broker_batch_seq, num_msg) come in any order, repeated too; messages
    of the unbroken prefix of each broker are acknowledged."""
    once = done.groupBy("broker_id", "broker_batch_seq").agg(F.min("num_msg").alias("num_msg"))
    prefix = contiguous(once, ["broker_id"], "broker_batch_seq").groupBy("broker_id").agg(F.sum("num_msg").alias("acked"), F.count("*").alias("batches"))
    return done.select("broker_id").distinct().join(prefix, "broker_id", "left").na.fill(0)


def ticket_gate(tickets: DataFrame) -> DataFrame:
    """tickets(client_id, ticket, arrival, failed) with `state` and the tick at which each passes the client's gate.

    A ticket passes after all before it. A failed one closes the gate for good: what is behind it is refused, never
    reordered; what waits for a ticket that never came is waiting.
    """
    w = Window.partitionBy("client_id").orderBy("ticket").rowsBetween(Window.unboundedPreceding, 0)
    rows = tickets.withColumns({"_n": F.row_number().over(Window.partitionBy("client_id").orderBy("ticket")) - 1, "_t": F.max("arrival").over(w), "_f": F.max(F.col("failed").cast("int")).over(w)})
    state = F.when(F.col("_f") == 1, "refused").when(F.col("_n") == F.col("ticket"), "passed").otherwise("waiting")
    return rows.select("client_id", "ticket", state.alias("state"), F.when(state == "passed", F.col("_t")).alias("passed_at"))


def own_cuts(reports: DataFrame) -> DataFrame:
    """Local cuts: each replica reports its own progress, which never steps back, whatever the others have."""
    w = Window.partitionBy("broker_id", "replica").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return reports.withColumn("own_cut", F.max("cut_cum").over(w))


def arrival_classes(batches: DataFrame, fences: DataFrame) -> DataFrame:
    """Every arrival with its class at that moment and the credit it gives at once.

    fenced: the session is; late: its number was emitted before (credit without effect); repeated: a copy waits already,
    the first one wins; expected: it is the next number, or fills the gap; held: it waits for an earlier one.
    """
    key = [*SESSION, "batch_seq"]
    first = first_copies(batches).select(*key, F.col("arrival").alias("_a"), F.col("batch_id").alias("_b"), F.col("broker_id").alias("_k"))
    done = release(batches).select(*key, "release")
    rows = batches.join(first, key).join(done, key, "left").join(fences.select(*SESSION, "fence_seq", "fence_tick"), SESSION, "left")
    lead = (F.col("arrival") == F.col("_a")) & (F.col("batch_id") == F.col("_b")) & (F.col("broker_id") == F.col("_k"))
    kind = (
        F.when((F.col("arrival") > F.col("fence_tick")) & (F.col("batch_seq") >= F.col("fence_seq")), "fenced")
        .when(~lead & (F.col("release") <= F.col("arrival")), "late")
        .when(~lead, "repeated")
        .when(F.col("release") == F.col("arrival"), "expected")
        .otherwise("held")
    )
    credit = F.when(kind.isin("late", "expected"), F.col("num_msg")).otherwise(0)
    return rows.withColumns({"kind": kind, "credit": credit.cast("long")}).drop("_a", "_b", "_k", "release", "fence_seq", "fence_tick")


def hold_pressure(batches: DataFrame, capacity: int, deferred: int) -> DataFrame:
    """(epoch, held, deferred, blocked) at each epoch's end in which it changes: batches that wait fill the hold buffer,
    then the deferred list; beyond both their slots are blocked and the session's frontier stays as it is."""
    done = release(batches).select(*SESSION, "batch_seq", "commit_epoch")
    rows = first_copies(batches).join(done, [*SESSION, "batch_seq"], "left").where("commit_epoch is null or commit_epoch > epoch")
    steps = rows.select(F.explode(F.array(F.struct(F.col("epoch").alias("epoch"), F.lit(1).alias("d")), F.struct(F.col("commit_epoch").alias("epoch"), F.lit(-1).alias("d")))).alias("s")).select("s.*").where("epoch is not null")
    by_epoch = steps.groupBy("epoch").agg(F.sum("d").alias("d")).withColumn("_range", F.expr("epoch div 1024"))
    ranges = by_epoch.groupBy("_range").agg(F.sum("d").alias("_s"))
    before = ranges.select("_range", F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row for 1024 epochs
    waiting = F.col("_b") + F.sum("d").over(Window.partitionBy("_range").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    rows = by_epoch.join(before, "_range").withColumn("_w", waiting)
    return rows.select("epoch", F.least("_w", F.lit(capacity)).cast("long").alias("held"), F.least(F.greatest(F.col("_w") - capacity, F.lit(0)), F.lit(deferred)).cast("long").alias("deferred"), F.greatest(F.col("_w") - capacity - deferred, F.lit(0)).cast("long").alias("blocked"))


def released_with_skips(batches: DataFrame, skips: DataFrame) -> DataFrame:
    """Release when the scanner gives up named batches: skips(client_id, session_epoch, batch_seq, tick).

    In a session of epoch 0 a skip stands for its batch and the chain goes on; in others it fences the session there.
    """
    rows = first_copies(batches).select(*SESSION, "batch_seq", "num_msg", "arrival", F.lit(False).alias("skipped"))
    named = skips.join(rows.select(*SESSION, "batch_seq"), [*SESSION, "batch_seq"], "left_anti")
    marks = named.where("session_epoch = 0").select(*SESSION, "batch_seq", F.lit(0).cast("long").alias("num_msg"), F.col("tick").alias("arrival"), F.lit(True).alias("skipped"))
    w = Window.partitionBy(*SESSION).orderBy("batch_seq").rowsBetween(Window.unboundedPreceding, 0)
    chain = contiguous(rows.unionByName(marks), SESSION, "batch_seq").withColumn("release", F.max("arrival").over(w))
    return chain.where(~F.col("skipped")).select(*SESSION, "batch_seq", "num_msg", "release")


def stream_release(batches: DataFrame, timeout: int) -> DataFrame:
    """FIFO of (client, session, broker) streams over their senders' numbers (stream_seq), holes and all.

    A stream waits for a hole until `timeout` ticks after something behind it was there, then passes it. An original that
    comes after its place was passed, and every further copy, is emitted at once as late. Each place's tick depends on the
    one before, so the rows of a stream pass one after the other, none of them held; streams pass in parallel.
    """
    key = [*SESSION, "broker_id"]
    first = first_copies(batches, *key, "stream_seq")
    later = Window.partitionBy(*key).orderBy("stream_seq").rowsBetween(1, Window.unboundedFollowing)
    seen = first.withColumn("_next", F.min("arrival").over(later)).sortWithinPartitions(*key, "stream_seq")
    names = first.columns

    def run(parts):
        last, seq, tick = None, -1, -1
        for batch in parts:
            release_, late = [], []
            columns = (batch.column(c).to_pylist() for c in (*key, "stream_seq", "arrival", "_next"))
            for client, session, broker, s, a, later in zip(*columns, strict=True):
                if (client, session, broker) != last:
                    last, seq, tick = (client, session, broker), -1, -1
                opened = tick if s == seq + 1 else max(tick, a if later is None else min(a, later)) + timeout
                given_up = None if later is None else max(opened, later) + timeout
                late.append(given_up is not None and a > given_up)
                seq, tick = s, given_up if late[-1] else max(opened, a)
                release_.append(a if late[-1] else tick)
            found = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(release_, pa.int64()), pa.array(late, pa.bool_())], names=[*names, "release", "late"])
            yield found

    schema = StructType([*first.schema.fields, StructField("release", LongType()), StructField("late", BooleanType())])
    done = seen.mapInArrow(run, schema)
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*key, "stream_seq", "arrival", "batch_id")]
    copies = batches.alias("x").join(first.alias("y"), same, "left_anti").withColumns({"release": F.col("arrival"), "late": F.lit(True)})
    return done.unionByName(copies.select(*done.columns))


def with_broker_counts(committed: DataFrame) -> DataFrame:
    """A commit's per-broker cumulative messages: what each broker has committed before each batch."""
    return prefix_sums(committed, "commit_epoch", [*SESSION, "batch_seq"], {"broker_messages": "num_msg"}, ("broker_id",))


def bypassed_order(batches: DataFrame, fences: DataFrame) -> DataFrame:
    """The order of a sequencer that holds nothing back but still drops copies and fenced suffixes: epochs, brokers, slots."""
    rows = first_copies(batches).join(fences.select(*SESSION, "fence_seq"), SESSION, "left")
    return numbered(rows.where("fence_seq is null or batch_seq < fence_seq").drop("fence_seq"), "epoch", ["broker_id", "pbr_index", "batch_id"])


def single_order(batches: DataFrame) -> DataFrame:
    """The order of a sequencer that takes batches one by one as they are released, without epochs."""
    return numbered(release(batches), "release", [*SESSION, "batch_seq"])


def overflowing_clients(batches: DataFrame, most: int) -> DataFrame:
    """(epoch, backlog, client_id, oldest): epochs at whose end more than `most` batches wait, with the client whose batch
    has waited longest, which is skipped. A batch counts in each epoch of its wait."""
    done = release(batches).select(*SESSION, "batch_seq", "commit_epoch")
    rows = first_copies(batches).join(done, [*SESSION, "batch_seq"]).where("commit_epoch > epoch")
    waits = rows.select("client_id", "arrival", F.explode(F.sequence(F.col("epoch"), F.col("commit_epoch") - 1)).alias("epoch"))
    by = waits.groupBy("epoch").agg(F.count("*").alias("backlog"), F.min(F.struct("arrival", "client_id")).alias("_o"))
    return by.where(F.col("backlog") > most).select("epoch", "backlog", "_o.client_id", F.col("_o.arrival").alias("oldest"))


def overdue(ledger: DataFrame, now: int, timeout: int) -> DataFrame:
    """What a client sends again: of each session only the first batch that no acknowledgement retired, once it is overdue."""
    return ledger.where(F.col("resend") & (F.lit(now) - F.col("arrival") > timeout)).withColumn("late_by", F.lit(now) - F.col("arrival") - timeout)


def replayed_slots(writes: DataFrame) -> DataFrame:
    """(broker_id, slot, state, batch_id) after a replay of a write-once log: writes(broker_id, slot, arrival, batch_id, whole).

    A truncated record ends a broker's replay; what was written after it is lost. Of what is read the first write of a
    slot counts, and slots below the last one that nothing wrote are junk.
    """
    cut = writes.groupBy("broker_id").agg(F.min(F.when(~F.col("whole"), F.col("arrival"))).alias("_cut"))
    read = writes.join(cut, "broker_id").where("_cut is null or arrival < _cut")
    first = read.groupBy("broker_id", "slot").agg(F.min(F.struct("arrival", "batch_id")).alias("_f"))
    last = first.groupBy("broker_id", F.expr("slot div 4096").alias("_r")).agg(F.max("slot").alias("_m"))
    top = last.groupBy("broker_id").agg(F.max("_m").alias("_m"))
    ranges = top.select("broker_id", "_m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("_m div 4096"))).alias("_r"))
    every = ranges.select("broker_id", F.explode(F.sequence(F.col("_r") * 4096, F.least(F.col("_m"), F.col("_r") * 4096 + 4095))).alias("slot"))
    found = every.join(first, ["broker_id", "slot"], "left")
    return found.select("broker_id", "slot", F.when(F.col("_f").isNull(), "JUNK").otherwise("WRITTEN").alias("state"), F.col("_f.batch_id").alias("batch_id"))


def delivered_audit(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """One row of verdicts on a delivered log (client_id, total_order, num_msg, batch_seq): frames of an impossible size,
    rows given twice, numbers given to several batches, and messages missing between the first and the last."""
    by = rows.groupBy("total_order").agg(F.count("*").alias("_n"), F.count_distinct("client_id", "batch_seq").alias("_u"), F.max("num_msg").alias("_m"), F.sum((~F.col("num_msg").between(1, most)).cast("long")).alias("_i"))
    sums = by.agg(F.sum("_i").alias("invalid"), F.sum(F.col("_n") - F.col("_u")).alias("given_twice"), F.sum((F.col("_u") > 1).cast("long")).alias("contested"), (F.max(F.col("total_order") + F.col("_m")) - F.min("total_order") - F.sum("_m")).alias("missing"))
    return sums.select(*(F.col(c).cast("long").alias(c) for c in ("invalid", "given_twice", "contested", "missing")))
