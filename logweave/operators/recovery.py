"""Recovery and audits: failover to the durable floor, reopened sessions, merged sequencer state, safety invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.operators.ordering import SESSION


def failover(goi: DataFrame, floor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, orphaned) rows of an order whose sequencer fails over: what is below the durable floor stays, the rest is
    orphaned and must be committed again under the next epoch. floor is one row."""
    marked = goi.crossJoin(F.broadcast(floor.select(F.col("floor").alias("_floor"))))
    return marked.where("goi < _floor").drop("_floor"), marked.where("goi >= _floor").drop("_floor")


def failover_state(goi: DataFrame, floor: DataFrame, epoch: int) -> DataFrame:
    """Each session's state after a failover: next expected number, batches orphaned, and the new control epoch."""
    marked = goi.crossJoin(F.broadcast(floor.select(F.col("floor").alias("_floor"))))
    kept = F.col("goi") < F.col("_floor")
    by = marked.groupBy(*SESSION).agg(F.max(F.when(kept, F.col("batch_seq"))).alias("_m"), F.sum((~kept).cast("long")).alias("orphaned"), F.sum(F.when(kept, F.col("num_msg")).otherwise(0)).alias("messages"))
    return by.select(*SESSION, (F.coalesce("_m", F.lit(-1)) + 1).cast("long").alias("next_expected"), "orphaned", "messages", F.lit(epoch + 1).cast("long").alias("control_epoch"))


def merged_state(scanned: DataFrame, sessions: DataFrame) -> DataFrame:
    """The state that the order tells (next_expected) merged with the session table's (expected_seq): the greater of both,
    sessions of either side."""
    both = scanned.select(*SESSION, "next_expected").join(sessions.select(*SESSION, "expected_seq"), SESSION, "full")
    return both.select(*SESSION, F.greatest("next_expected", "expected_seq").alias("next_expected"), F.when(F.col("next_expected").isNull(), "table").when(F.col("expected_seq").isNull(), "order").otherwise("both").alias("known_by"))


def inclusive_hwm(next_expected: Column) -> Column:
    """The last committed number from the next expected one; null for an empty prefix."""
    return F.when(next_expected > 0, next_expected - 1)


def exclusive_next(hwm: Column) -> Column:
    """The next expected number from the last committed one, null for an empty prefix."""
    return F.coalesce(hwm + 1, F.lit(0).cast("long"))


def reconnect_hwm(session_hwm: Column, goi_hwm: Column) -> Column:
    """What a reconnecting client is told: the lesser of both, the session table's where the order can't be read."""
    return F.when(goi_hwm.isNull(), session_hwm).otherwise(F.when(session_hwm.isNotNull(), F.least(session_hwm, goi_hwm)))


def reopened(fences: DataFrame) -> DataFrame:
    """Fenced sessions that open again: the next generation resumes behind the committed prefix."""
    return fences.select("client_id", (F.col("session_epoch") + 1).alias("generation"), exclusive_next(F.col("committed_hwm")).alias("next_seq"))


def invariants(goi: DataFrame, fences: DataFrame, acked: DataFrame, read: DataFrame, floor: DataFrame, capacity: int) -> DataFrame:
    """(invariant, violations) of an order: its batches, the fences, what clients were acknowledged (session, acked_next),
    what a reader was given (place, session, batch_seq) and the durable floor (one row). All are 0 in a sound one.

    One pass by session carries all counts of the order; what readers saw is one join by place.
    """
    along = Window.partitionBy(*SESSION).orderBy("goi")
    marked = goi.crossJoin(F.broadcast(floor.select("floor"))).withColumn("_late", (F.lag("batch_seq").over(along) >= F.col("batch_seq")).cast("long"))
    marked = marked.join(fences.select(*SESSION, "fence_seq"), SESSION, "left")
    durable = F.col("goi") < F.col("floor")
    by = marked.groupBy(*SESSION).agg(
        F.count("*").alias("n"),
        F.count_distinct("batch_seq").alias("u"),
        F.max("batch_seq").alias("top"),
        F.coalesce(F.sum("_late"), F.lit(0)).alias("late"),
        F.sum(F.coalesce(F.col("batch_seq") >= F.col("fence_seq"), F.lit(False)).cast("long")).alias("beyond"),
        F.coalesce(F.max(F.when(durable, F.col("batch_seq"))) + 1, F.lit(0)).alias("sure"),
        F.max("goi").alias("last"),
        F.max(F.col("total_order") + F.col("num_msg")).alias("end"),
        F.sum("num_msg").alias("messages"),
        F.max("floor").alias("floor"),
    )
    told = by.join(acked.select(*SESSION, "acked_next"), SESSION, "full")
    sums = told.agg(
        F.sum(F.col("n") - F.col("u")).alias("NoDupCommit"),
        F.sum((F.col("top") + 1 != F.col("u")).cast("long")).alias("PerSessionPrefix"),
        F.sum("late").alias("LateNeverReordered"),
        F.sum("beyond").alias("FencedSuffixNeverCommitted"),
        F.greatest(F.max("last") + 1 - F.max("floor") - capacity, F.lit(0)).alias("NoWrap"),
        F.sum((F.col("acked_next") > F.coalesce("sure", F.lit(0))).cast("long")).alias("AckedIffCommitted"),
        F.abs(F.max("last") + 1 - F.sum("n")).alias("DenseOrder"),
        F.abs(F.max("end") - F.sum("messages")).alias("DenseMessages"),
    )
    there = goi.select(F.col("goi").alias("place"), *(F.col(c).alias(f"_{c}") for c in (*SESSION, "batch_seq")))
    seen = read.crossJoin(F.broadcast(floor.select("floor"))).where("place < floor").join(there, "place", "left")
    other = ~F.coalesce((F.col("_client_id") == F.col("client_id")) & (F.col("_session_epoch") == F.col("session_epoch")) & (F.col("_batch_seq") == F.col("batch_seq")), F.lit(False))
    agreed = seen.agg(F.sum(other.cast("long")).alias("ReaderAgreement"))
    wide = sums.crossJoin(agreed)  # two single rows
    return wide.unpivot([], wide.columns, "invariant", "violations").select("invariant", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def differences(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Rows that one side has and the other hasn't, both ways, with multiplicity."""
    return left.exceptAll(right).withColumn("only", F.lit(names[0])).unionByName(right.exceptAll(left).withColumn("only", F.lit(names[1])))


def cuts_from_mailbox(reports: DataFrame, rounds: DataFrame, brokers: int, replicas: int) -> DataFrame:
    """Global cuts by another way than global_cuts(): a report stands from its round until its stream's next one that is
    greater, in mailboxes that repeat and overtake; each round takes what stands in it."""
    best = reports.groupBy("broker_id", "replica", "round").agg(F.max("cut_cum").alias("cut_cum"))
    w = Window.partitionBy("broker_id", "replica").orderBy("round")
    rising = best.withColumn("_m", F.max("cut_cum").over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_m").isNull() | (F.col("cut_cum") > F.col("_m")))
    end = rounds.agg(F.max("round").alias("_end"))
    spans = rising.withColumn("_next", F.lead("round").over(w)).crossJoin(F.broadcast(end))  # a single row
    stands = spans.select("broker_id", "cut_cum", F.explode(F.sequence("round", F.coalesce(F.col("_next") - 1, F.greatest("_end", "round")))).alias("round"))
    by = stands.join(rounds.select("round").distinct(), "round", "left_semi").groupBy("round", "broker_id").agg(F.min("cut_cum").alias("cut_cum"), F.count("*").alias("_n"))
    ready = by.groupBy("round").agg(F.sum("_n").alias("_n")).where(F.col("_n") == brokers * replicas).select("round")
    return by.drop("_n").join(ready, "round", "left_semi")


def final_validation(expected: DataFrame, final: DataFrame, template: str, *by: str) -> DataFrame:
    """expected(by..., key, value: the last one written, null for a key that no one wrote) against final(key, value): how many
    overwritten keys there are, and how many of them and of the untouched ones (which hold the template) differ."""
    rows = expected.join(final.select("key", F.col("value").alias("_got")), "key", "left")
    wrong = ~F.coalesce(F.col("_got") == F.coalesce("value", F.lit(template)), F.lit(False))
    written = F.col("value").isNotNull()
    return rows.groupBy(*by).agg(F.sum(written.cast("long")).alias("overwritten"), F.sum((written & wrong).cast("long")).alias("final_mismatch"), F.sum((~written & wrong).cast("long")).alias("untouched_mismatch"))


def failed_checks(**failed: Column) -> Column:
    """The names of the checks that failed, joined by '+'."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in failed.items()))), "+")
