"""Fault semantics: fences of sessions, range skips, stale epochs, resubmission, recovery and safety invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.operators.ordering import SESSION, committed_seq, first_copies


def _gaps(batches: DataFrame) -> DataFrame:
    """For each session and each place where its chain waits: missing seq m, start of the wait and arrival of m (null if lost).

    A wait at m starts when m - 1 is released and a later batch is there, whichever comes last.
    """
    rows = first_copies(batches).select(*SESSION, "batch_seq", "arrival")
    w = Window.partitionBy(*SESSION).orderBy("batch_seq")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumns({"next_first": F.min("arrival").over(ahead), "before": F.max("arrival").over(upto), "prev": F.lag("batch_seq").over(w), "from_here": F.min("arrival").over(w.rowsBetween(0, Window.unboundedFollowing))})
    late = seen.where(F.coalesce("prev", F.lit(-1)) + 1 == F.col("batch_seq")).where("next_first < arrival").select(*SESSION, F.col("batch_seq").alias("missing"), F.greatest("before", "next_first").alias("gap_start"), "arrival")
    lost = seen.where(F.coalesce("prev", F.lit(-1)) + 1 < F.col("batch_seq")).select(*SESSION, (F.coalesce("prev", F.lit(-1)) + 1).alias("missing"), F.greatest("before", "from_here").alias("gap_start"), F.lit(None).cast("long").alias("arrival"))
    return late.unionByName(lost)


def session_fences(batches: DataFrame, lease: int) -> DataFrame:
    """(session, fence_seq, fence_tick, committed_hwm) of each session that a gap outlasting its lease fences.

    Sessions of epoch 0 are never fenced. committed_hwm is the last batch before the fence, null if there is none.
    """
    over = _gaps(batches.where("session_epoch <> 0")).where(F.col("arrival").isNull() | (F.col("arrival") > F.col("gap_start") + lease))
    first = over.groupBy(*SESSION).agg(F.min(F.struct("missing", "gap_start")).alias("f"))
    return first.select(*SESSION, F.col("f.missing").alias("fence_seq"), (F.col("f.gap_start") + lease).alias("fence_tick"), F.when(F.col("f.missing") > 0, F.col("f.missing") - 1).alias("committed_hwm"))


def fenced_release(batches: DataFrame, lease: int) -> DataFrame:
    """Committed batches with their release ticks, the fenced sessions' suffixes left out."""
    from logweave.operators.ordering import release

    fences = session_fences(batches, lease).select(*SESSION, "fence_seq")
    return release(batches).join(fences, SESSION, "left").where(F.col("fence_seq").isNull() | (F.col("batch_seq") < F.col("fence_seq"))).drop("fence_seq")


def range_skips(batches: DataFrame) -> DataFrame:
    """Skip markers of an order that waits no longer: (session, skipped_from, skipped) for each run of missing batches,
    with the release of the batch behind it."""
    rows = first_copies(batches)
    w = Window.partitionBy(*SESSION).orderBy("batch_seq")
    prev = F.coalesce(F.lag("batch_seq").over(w), F.lit(-1))
    seen = rows.withColumns({"prev": prev, "release": F.max("arrival").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return seen.where(F.col("batch_seq") > F.col("prev") + 1).select(*SESSION, (F.col("prev") + 1).alias("skipped_from"), (F.col("batch_seq") - F.col("prev") - 1).alias("skipped"), "release")


def session_pressure(batches: DataFrame, lease: int) -> DataFrame:
    """Pressure counters of each session in one pass over it: expiries (its fence, if a gap outlasts the lease), holds
    (committed batches that waited), skips (numbers missing), late (further copies) and depth (greatest number)."""
    first = batches.groupBy(*SESSION, "batch_seq").agg(F.min("arrival").alias("arrival"), F.count("*").alias("_c"))
    w = Window.partitionBy(*SESSION).orderBy("batch_seq")
    seen = first.withColumns(
        {
            "_prev": F.coalesce(F.lag("batch_seq").over(w), F.lit(-1)),
            "_n": F.row_number().over(w) - 1,
            "_release": F.max("arrival").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_before": F.max("arrival").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_next": F.min("arrival").over(w.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    lost = F.col("_prev") + 1 < F.col("batch_seq")
    over = F.coalesce((F.col("_next") < F.col("arrival")) & (F.col("arrival") > F.greatest("_before", "_next") + lease), F.lit(False))
    fenced = (lost | over) & (F.col("session_epoch") != 0)
    held = (F.col("_n") == F.col("batch_seq")) & (F.col("_release") > F.col("arrival"))
    return seen.groupBy(*SESSION).agg(
        F.max(fenced.cast("long")).alias("expiries"), F.sum(held.cast("long")).alias("holds"), F.sum(F.col("batch_seq") - F.col("_prev") - 1).alias("skips"), F.sum(F.col("_c") - 1).alias("late"), F.max("batch_seq").alias("depth"),
    )


def stale_epochs(batches: DataFrame, current: int, most: int = 2000) -> DataFrame:
    """Batches that a control epoch makes stale: the wrap-aware age in 16 bits is above the bound."""
    return batches.withColumn("age", F.pmod(F.lit(current) - F.col("epoch_created"), F.lit(65536))).where(F.col("age") > most)


def resubmissions(batches: DataFrame, fences: DataFrame) -> DataFrame:
    """What a fenced session sends again: the batches above its committed prefix, renumbered from 0 in the next epoch."""
    left = first_copies(batches).join(fences.select(*SESSION, "fence_seq"), SESSION).where("batch_seq >= fence_seq")
    new = F.row_number().over(Window.partitionBy(*SESSION).orderBy("batch_seq")) - 1
    return left.select(*SESSION, "batch_seq", new.cast("long").alias("new_seq"), (F.col("session_epoch") + 1).alias("new_epoch"))


def recovered_sessions(goi: DataFrame, committed: int | Column) -> DataFrame:
    """Sequencer state from the order up to the committed place: next expected seq, messages and next number of each session."""
    return goi.where(F.col("goi") <= committed).groupBy(*SESSION).agg((F.max("batch_seq") + 1).alias("next_expected"), F.sum("num_msg").alias("messages"), F.max(F.col("total_order") + F.col("num_msg")).alias("next_total_order"))


def recovered_committed(goi: DataFrame) -> DataFrame:
    """recovered_sessions up to the committed place that the order itself has."""
    done = goi.crossJoin(F.broadcast(committed_seq(goi).select("committed_seq")))
    return recovered_sessions(done, F.col("committed_seq"))


def stalled_replicas(goi: DataFrame, replicated: DataFrame, now: int, factor: int, age: int) -> DataFrame:
    """Ordered batches older than `age` with fewer than `factor` replicas and no change in the last `age` ticks."""
    seen = goi.join(replicated, "batch_id", "left").withColumns({"num_replicated": F.coalesce("num_replicated", F.lit(0).cast("long")), "changed": F.coalesce("changed", F.col("release"))})
    return seen.where((F.lit(now) - F.col("release") > age) & (F.col("num_replicated") < factor) & (F.lit(now) - F.col("changed") >= age))
