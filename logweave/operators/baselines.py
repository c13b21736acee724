"""The other ordering schemes, for comparison: token grants, cumulative cuts and delta bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.operators.ordering import first_copies, prefix_sums, release


def token_grants(requests: DataFrame, message_bytes: int = 64) -> DataFrame:
    """Tokens of a sequencer that grants each (client, broker) stream in order and lets the others retry.

    status tells the first attempt; a request is granted at the tick its stream reaches it. Grants get total_order,
    the broker's log offset and the broker's batch number.
    """
    first = first_copies(requests)
    place = F.row_number().over(Window.partitionBy("client_id", "broker_id").orderBy("batch_seq")) - 1
    done = release(first.withColumn("stream_seq", place.cast("long")), ["client_id", "broker_id"], "stream_seq")
    done = done.withColumns({"granted": F.col("release"), "status": F.when(F.col("release") == F.col("arrival"), "GRANTED").otherwise("OUT_OF_ORDER"), "size": F.col("num_msg") * message_bytes, "tick_range": F.expr("release div 100"), "_one": F.lit(1).cast("long")})
    order = ["granted", "client_id", "broker_id", "stream_seq"]
    done = prefix_sums(done, "tick_range", order, {"total_order": "num_msg"})
    return prefix_sums(done, "tick_range", order, {"log_index": "size", "broker_batch_seq": "_one"}, ("broker_id",))


def repeated_requests(requests: DataFrame) -> DataFrame:
    """Requests for what has been granted already."""
    copy = F.row_number().over(Window.partitionBy("client_id", "session_epoch", "batch_seq").orderBy("arrival", "batch_id", "broker_id"))
    return requests.withColumn("_c", copy).where("_c > 1").drop("_c").withColumn("status", F.lit("ALREADY_PROCESSED"))


def write_once(writes: DataFrame) -> DataFrame:
    """Status of each write to a write-once slot (broker, slot): WRITTEN, ALREADY_SAME or CONFLICT against the first."""
    first = writes.groupBy("broker_id", "slot").agg(F.min(F.struct("arrival", "batch_id", "content")).alias("f"))
    same = F.col("content") == F.col("f.content")
    status = F.when(F.col("batch_id") == F.col("f.batch_id"), "WRITTEN").when(same, "ALREADY_SAME").otherwise("CONFLICT")
    return writes.join(first, ["broker_id", "slot"]).select("broker_id", "slot", "batch_id", status.alias("status"))


def global_cuts(local: DataFrame, brokers: int, replicas: int) -> DataFrame:
    """(round, broker, cut_cum): local (round, broker, replica, cut_cum) never step back; the cut of a broker is the least
    of its replicas; a round counts once every stream has reported."""
    stream = Window.partitionBy("broker_id", "replica").orderBy("round")
    grid = local.select("round").distinct().join(F.broadcast(local.select("broker_id", "replica").distinct()))  # brokers x replicas rows
    filled = grid.join(local.groupBy("round", "broker_id", "replica").agg(F.max("cut_cum").alias("cut_cum")), ["round", "broker_id", "replica"], "left")
    held = filled.withColumn("cut_cum", F.max("cut_cum").over(stream))
    ready = held.groupBy("round").agg(F.count("cut_cum").alias("n")).where(F.col("n") == brokers * replicas).select("round")
    return held.join(ready, "round", "left_semi").groupBy("round", "broker_id").agg(F.min("cut_cum").alias("cut_cum"))


def cut_deltas(cuts: DataFrame) -> DataFrame:
    """Messages that each cut adds for each broker."""
    w = Window.partitionBy("broker_id").orderBy("round")
    return cuts.withColumn("delta", F.col("cut_cum") - F.coalesce(F.lag("cut_cum").over(w), F.lit(0)))


def ordered_slices(deltas: DataFrame) -> DataFrame:
    """First number of each broker's slice: rounds in order, brokers in order within a round."""
    return prefix_sums(deltas, "round", ["broker_id"], {"total_order": "delta"}).select("round", "broker_id", "delta", "total_order")


def bindings(progress: DataFrame, brokers: int) -> DataFrame:
    """(round, broker, delta): what each round binds beyond what is bound; from the first round in which all have reported."""
    w = Window.partitionBy("broker_id").orderBy("round")
    grid = progress.select("round").distinct().join(F.broadcast(progress.select("broker_id").distinct()))  # a row for each broker
    held = grid.join(progress.groupBy("round", "broker_id").agg(F.max("progress_cum").alias("p")), ["round", "broker_id"], "left").withColumn("p", F.max("p").over(w))
    ready = held.groupBy("round").agg(F.count("p").alias("n")).where(F.col("n") == brokers).select("round")
    bound = held.join(ready, "round", "left_semi")
    return bound.withColumn("delta", F.col("p") - F.coalesce(F.lag("p").over(w), F.lit(0))).select("round", "broker_id", "delta")


def metadata_replicas(appends: DataFrame, factor: int) -> DataFrame:
    """Append-complete entries (broker, slot): all replicas hold one and the same content; idempotent repeats don't count."""
    by = appends.groupBy("broker_id", "slot").agg(F.count_distinct("replica").alias("replicas"), F.count_distinct("content").alias("contents"))
    return by.select("broker_id", "slot", F.when(F.col("contents") > 1, "CONFLICT").when(F.col("replicas") >= factor, "COMPLETE").otherwise("PENDING").alias("status"))
