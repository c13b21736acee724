"""A subscriber's reorder buffer over delivered frames, in batch form.

Frames carry the number of their first message; a frame flagged with a gap says that the broker's cursor has passed
committed frames, and the expected number moves to its start. Frames behind the expected number are stale; frames ahead
of it wait until what is before them is there or a gap moves past it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def delivered(frames: DataFrame, key: str = "subscriber") -> DataFrame:
    """frames(subscriber, arrival, total_order, num_messages, gap) with `state`: delivered, stale or waiting.

    A gap at tick t anchors its subscriber at its start; only the last anchor counts for what follows it. From the
    anchor on, the frames that continue each other without a hole are delivered.
    """
    arrived = Window.partitionBy(key).orderBy("arrival", "total_order")
    anchor = F.last(F.when(F.col("gap"), F.col("total_order")), True).over(arrived.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = frames.withColumn("anchor", F.coalesce(anchor, F.lit(0).cast("long")))
    first = rows.withColumn("_c", F.row_number().over(Window.partitionBy(key, "total_order").orderBy("arrival")))
    live = first.withColumn("_live", (F.col("_c") == 1) & (F.col("total_order") >= F.col("anchor")))
    order = Window.partitionBy(key, "_live").orderBy("total_order").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.col("anchor") + F.coalesce(F.sum("num_messages").over(order), F.lit(0))
    state = F.when(~F.col("_live"), "stale").when(reach == F.col("total_order"), "delivered").otherwise("waiting")
    return live.withColumn("state", state).drop("_c", "_live", "anchor")
