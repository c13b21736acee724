"""Frontiers and acknowledgements: what a producer may be told at each level, and how far the order is durable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def policy_error(ack: Column, factor: Column, order: Column, sequencer: Column) -> Column:
    """Null for a valid (ack, replication factor, order, sequencer), else what is wrong with it. The first three texts are
    fixed values that clients compare."""
    said = lambda text, value: F.concat(F.lit(text), value.cast("string"), F.lit(")"))
    return (
        F.when((ack < 0) | (ack > 2), said("ack_level must be 0, 1, or 2 (got ", ack))
        .when(factor < 0, said("replication_factor must be >= 0 (got ", factor))
        .when((ack == 2) & (factor < 2), said("ACK level 2 requires replication_factor>=2 (RF includes the CXL primary; got replication_factor=", factor))
        .when(sequencer.isin("CORFU", "LAZYLOG") & (order != 2), "sequencer needs order 2")
        .when((sequencer == "SCALOG") & (order != 1), "sequencer needs order 1")
    )


def min_replicated(done: DataFrame) -> DataFrame:
    """(broker_id, durable_next): messages that all replicas have; null unless every replica has started."""
    started = F.count("last_offset") == F.count("*")
    return done.groupBy("broker_id").agg(F.when(started, F.min("last_offset") + 1).alias("durable_next"))


def ack_offsets(frontier: DataFrame, done: DataFrame, levels: DataFrame) -> DataFrame:
    """(broker, ack, order, sequencer, ack_next): frontier has written, ordered and cv_durable by broker; levels is small."""
    base = frontier.join(min_replicated(done), "broker_id", "left").join(F.broadcast(levels))
    replicated = F.when(F.col("sequencer").isin("SCALOG", "LAZYLOG"), F.least("durable_next", "ordered")).otherwise(F.col("durable_next"))
    offset = (
        F.when(F.col("ack") == 0, None)
        .when((F.col("ack") == 1) & (F.col("ord") == 0), F.col("written"))
        .when(F.col("ack") == 1, F.col("ordered"))
        .when(F.col("ord") == 5, F.col("cv_durable"))
        # least() skips nulls, but a frontier that hasn't started must stay unknown
        .otherwise(F.when(F.col("durable_next").isNotNull(), replicated))
    )
    return base.select("broker_id", "ack", "ord", "sequencer", offset.cast("long").alias("ack_next"))


def durable_frontier(goi: DataFrame, complete: Column) -> DataFrame:
    """For each broker the messages of its ordered batches before the first one that isn't fully replicated."""
    first_hole = goi.groupBy("broker_id").agg(F.min(F.when(~complete, F.col("goi"))).alias("hole"))
    held = goi.join(first_hole, "broker_id").where(F.col("hole").isNull() | (F.col("goi") < F.col("hole")))
    found = held.groupBy("broker_id").agg(F.sum("num_msg").alias("durable_messages"), F.max("goi").alias("durable_goi"))
    return first_hole.select("broker_id", "hole").join(found, "broker_id", "left").select("broker_id", "hole", F.coalesce("durable_messages", F.lit(0).cast("long")).alias("durable_messages"), "durable_goi")


def durable_credit(batches: DataFrame, durable: DataFrame) -> DataFrame:
    """Messages of each client in whole batches below their broker's durable frontier."""
    whole = batches.join(durable, "broker_id").where(F.col("written") + F.col("num_msg") <= F.col("durable_next"))
    return whole.groupBy("client_id").agg(F.sum("num_msg").alias("credited"), F.count("*").alias("batches"))


def replica_roles(brokers: int, factor: int, spark) -> DataFrame:
    """(broker, replica, role) of every chain: the broker itself has role 0, then its successors round the ring."""
    return spark.range(brokers).select(F.col("id").alias("broker_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(factor - 1).cast("long"))).alias("role")).withColumn("replica", (F.col("broker_id") + F.col("role")) % brokers)


def chain_valid(tokens: DataFrame, factor: int) -> DataFrame:
    """Batches whose chain of replicas is complete from role 0, and how far each chain has come."""
    done = F.array_sort(F.collect_set("role"))
    ahead = F.size(F.filter(F.transform(done, lambda r, k: F.when(r == k, r)), lambda x: x.isNotNull()))
    return tokens.groupBy("batch_id").agg(ahead.cast("long").alias("chain")).withColumn("durable", F.col("chain") >= factor)


def first_ack(sends: DataFrame, acks: DataFrame) -> DataFrame:
    """As-of join: for each sent batch (client, end_count, sent) the first cumulative ack (client, acked, ack_time) that covers it.

    One window over both, by falling count, instead of a range join: the least ack time at or above the batch's end.
    """
    both = sends.select("client_id", F.col("end_count").alias("c"), F.lit(1).alias("kind"), "batch_seq", "sent", F.lit(None).cast("long").alias("t")).unionByName(
        acks.select("client_id", F.col("acked").alias("c"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("batch_seq"), F.lit(None).cast("long").alias("sent"), F.col("ack_time").alias("t"))
    )
    w = Window.partitionBy("client_id").orderBy(F.desc("c"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("acked_at", F.min("t").over(w)).where("kind = 1").select("client_id", "batch_seq", "sent", "acked_at", (F.col("acked_at") - F.col("sent")).alias("latency"))
