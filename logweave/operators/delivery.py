"""Delivery and client-side operators: sealing, export scans, guards on acknowledgements, ledgers and membership."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sealed_batches(messages: DataFrame, most: int) -> DataFrame:
    """Messages (client_id, broker_id, message, size) cut into batches of at most `most`: (client, broker, batch_seq, num_msg, total_size)."""
    place = F.row_number().over(Window.partitionBy("client_id", "broker_id").orderBy("message")) - 1
    return messages.withColumn("batch_seq", F.floor(place / most)).groupBy("client_id", "broker_id", "batch_seq").agg(F.count("*").alias("num_msg"), F.sum("size").alias("total_size"))


def export_scan(goi: DataFrame, broker: int, after: int, committed: int) -> DataFrame:
    """What a broker's export cursor reads next: its own non-empty batches above the cursor, up to the committed place."""
    return goi.where((F.col("broker_id") == broker) & (F.col("num_msg") > 0) & F.col("goi").between(after + 1, committed))


def next_batch(goi: DataFrame, total_order: int, most: int) -> DataFrame:
    """The next `most` batches from a message number on, in order (a top-k, not a sort of the log)."""
    return goi.where(F.col("total_order") >= total_order).orderBy("total_order").limit(most)


def consume(goi: DataFrame, total_order: int = 0) -> Iterator[Row]:
    """The ordered batches from a message number on, one by one up to the first hole; the driver holds a partition at a time."""
    expected = total_order
    for row in goi.where(F.col("total_order") >= total_order).orderBy("total_order").toLocalIterator():
        if row.total_order != expected:
            return
        expected += row.num_msg
        yield row


def reject_behind(batches: DataFrame, sessions: DataFrame) -> DataFrame:
    """Spatial guard: batches of an active session that is fenced, or below its durable expected seq."""
    held = batches.join(sessions.where("active"), ["client_id", "session_epoch"])
    return held.where(F.col("fenced") | (F.col("batch_seq") < F.col("expected_seq")))


def withheld(producing_epoch: Column, control_epoch: Column) -> Column:
    """Whether an ack relay must hold back: stamped in an older epoch than the control block's (0: none)."""
    return F.coalesce((control_epoch != 0) & (producing_epoch < control_epoch), F.lit(False))


def terminal_fence(client_hwm: Column, goi_hwm: Column) -> Column:
    """A fence is terminal if the order is missing or behind what the client knows."""
    return goi_hwm.isNull() | F.coalesce(client_hwm > goi_hwm, F.lit(False))


def open_answer(sessions: DataFrame) -> DataFrame:
    """What a reopening client is told: OK or FENCED, with the committed prefix if there is one."""
    return sessions.select("client_id", "session_epoch", F.when(F.col("fenced"), "FENCED").otherwise("OK").alias("answer"), F.when(F.col("expected_seq") > 0, F.col("expected_seq") - 1).alias("committed_hwm"))


def ledger(batches: DataFrame, acked: DataFrame) -> DataFrame:
    """Each sent batch's end count in its session, whether the cumulative ack retires it, and which one is next to resend."""
    w = Window.partitionBy("client_id", "session_epoch").orderBy("batch_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = batches.withColumn("end_count", F.sum("num_msg").over(w)).join(acked, ["client_id", "session_epoch"], "left").withColumn("acked", F.coalesce("acked", F.lit(0).cast("long")))
    rows = rows.withColumn("retired", F.col("end_count") <= F.col("acked"))
    first = F.min(F.when(~F.col("retired"), F.col("batch_seq"))).over(Window.partitionBy("client_id", "session_epoch"))
    return rows.withColumn("resend", F.coalesce(F.col("batch_seq") == first, F.lit(False)))


def append_progress(batches: DataFrame, data: DataFrame) -> DataFrame:
    """For each broker the end of the contiguous metadata-ready batches that its data frontier covers."""
    first = batches.groupBy("broker_id").agg(F.min(F.when(~F.col("ready"), F.col("pbr_index"))).alias("hole"))
    fine = batches.join(first, "broker_id").join(data, "broker_id").where((F.col("hole").isNull() | (F.col("pbr_index") < F.col("hole"))) & (F.col("end") <= F.col("data_next")))
    return fine.groupBy("broker_id").agg(F.max("end").alias("append_next"), F.count("*").alias("batches"))


def rendezvous(keys: DataFrame, key: str, brokers: int, exclude: Column) -> DataFrame:
    """The broker of highest hash for each key, one of them left out; the lowest id wins a tie."""
    spread = keys.select(key, exclude.alias("_x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(brokers - 1).cast("long"))).alias("broker_id")).where("broker_id <> _x or _x is null")
    weight = F.md5(F.concat(F.col(key).cast("string"), F.lit("-"), F.col("broker_id").cast("string")))
    return spread.groupBy(key).agg(F.max(F.struct(weight.alias("w"), (-F.col("broker_id")).alias("b"))).alias("m")).select(key, (-F.col("m.b")).alias("broker_id"))


def idle_sessions(batches: DataFrame, now: int, ttl: int) -> DataFrame:
    """Sessions whose last batch is older than the time to live."""
    return batches.groupBy("client_id", "session_epoch").agg(F.max("epoch").alias("last_epoch")).where(F.lit(now) - F.col("last_epoch") > ttl)


def overflow_skips(held: DataFrame, most: int) -> DataFrame:
    """When more than `most` batches are held in an epoch, the oldest held ones beyond that bound are skipped."""
    w = Window.partitionBy("epoch").orderBy("arrival", "batch_id")
    n = F.count("*").over(Window.partitionBy("epoch"))
    return held.withColumns({"_i": F.row_number().over(w), "_n": n}).where(F.col("_i") <= F.col("_n") - most).drop("_i", "_n")


def membership(beats: DataFrame, now: int, timeout: int) -> DataFrame:
    """Brokers by their last heartbeat, alive within the timeout; the head is the smallest one alive."""
    last = beats.groupBy("broker_id").agg(F.max("tick").alias("last")).withColumn("alive", F.lit(now) - F.col("last") <= timeout)
    head = last.agg(F.min(F.when(F.col("alive"), F.col("broker_id"))).alias("head"))
    return last.crossJoin(F.broadcast(head)).select("broker_id", "last", "alive", (F.col("broker_id") == F.col("head")).alias("is_head"))  # a single row
