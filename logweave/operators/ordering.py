"""Ordering operators: release under per-session FIFO, the other contracts, and the assignment of global numbers.

A session's batch q is released when 0..q have all arrived: its release time is the running maximum of the first
arrivals. Global numbers come from prefix sums in three levels (coarse range, epoch, row), so no window holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SESSION = ["client_id", "session_epoch"]
#: Epochs of a coarse range: the top level has a row for each range.
COARSE = 1024
#: Numbers of a range of a key's contiguous prefix.
RANGE = 4096


def first_copies(batches: DataFrame, *key: str) -> DataFrame:
    """Exact dedup: of the copies of a batch the first to arrive (the smallest id, then broker, on a tie)."""
    key = list(key) or [*SESSION, "batch_seq"]
    rest = [c for c in batches.columns if c not in key]
    lead = [c for c in ("arrival", "batch_id", "broker_id") if c in rest]
    ranked = F.struct(*lead, *(c for c in rest if c not in lead))
    return batches.groupBy(*key).agg(F.min(ranked).alias("_r")).select(*key, "_r.*").select(*batches.columns)


def contiguous(rows: DataFrame, key: list[str], seq: str, maxima: dict[str, str] | None = None) -> DataFrame:
    """Rows of the contiguous prefix 0, 1, 2, ... of each key; rows are distinct in (key, seq). maxima adds running maxima
    along the prefix: {result: column}.

    A key's numbers are cut in ranges of RANGE. A range can hold rows of the prefix if all before it are full, which their
    counts tell; only a row for each range meets others of its key, so a key of any size is spread over tasks.
    """
    maxima = maxima or {}
    ranged = rows if "_part" in rows.columns else rows.withColumn("_part", F.expr(f"{seq} div {RANGE}"))
    by = ranged.groupBy(*key, "_part").agg(F.count("*").alias("_n"), *(F.max(c).alias(f"_x_{r}") for r, c in maxima.items()))
    ahead = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = by.select(*key, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_b"), *(F.max(f"_x_{r}").over(ahead).alias(f"_x_{r}") for r in maxima))
    here = Window.partitionBy(*key, "_part").orderBy(seq)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(before.where(F.col("_b") == F.col("_part") * RANGE), [*key, "_part"]).withColumn("_p", F.row_number().over(here) - 1 + F.col("_b"))
    out = out.where(F.col("_p") == F.col(seq)).withColumns({r: F.greatest(f"_x_{r}", F.max(c).over(so_far)) for r, c in maxima.items()})
    return out.select(*(c for c in rows.columns if c != "_part"), *maxima)


def release(batches: DataFrame, key: list[str] | None = None, seq: str = "batch_seq") -> DataFrame:
    """Committed batches with release (tick) and commit_epoch: running maxima over the contiguous prefix."""
    key = key or SESSION
    # Dealt by range once, which serves the dedup, the counts and the windows.
    dealt = batches.withColumn("_part", F.expr(f"{seq} div {RANGE}")).repartition(*key, "_part")
    return contiguous(first_copies(dealt, *key, "_part", seq), key, seq, {"release": "arrival", "commit_epoch": "epoch"})


def prefix_sums(rows: DataFrame, epoch: str, order: list[Column | str], sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds exclusive running sums by (epoch, order), for each group of `by` its own: {result: column}. The order must be
    unique within an epoch. The top level has a row for each COARSE epochs of a group, so a group isn't one task's."""
    coarse = F.floor(F.col(epoch) / COARSE)
    by_epoch = rows.groupBy(*by, epoch).agg(*(F.sum(c).alias(f"_e_{r}") for r, c in sums.items())).withColumn("_coarse", coarse)
    by_range = by_epoch.groupBy(*by, "_coarse").agg(*(F.sum(f"_e_{r}").alias(f"_c_{r}") for r in sums))
    top = (Window.partitionBy(*by) if by else Window).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    before_range = by_range.select(*by, "_coarse", *(F.coalesce(F.sum(f"_c_{r}").over(top), F.lit(0)).alias(f"_c_{r}") for r in sums))
    mid = Window.partitionBy(*by, "_coarse").orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    before_epoch = by_epoch.join(before_range, [*by, "_coarse"]).select(*by, epoch, *((F.col(f"_c_{r}") + F.coalesce(F.sum(f"_e_{r}").over(mid), F.lit(0))).alias(f"_b_{r}") for r in sums))
    low = Window.partitionBy(*by, epoch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(before_epoch, [*by, epoch])
    return out.withColumns({r: (F.col(f"_b_{r}") + F.coalesce(F.sum(c).over(low), F.lit(0))).cast("long") for r, c in sums.items()}).drop(*(f"_b_{r}" for r in sums))


def placed(rows: DataFrame, value: str, tie: str, width: int, *by: str) -> DataFrame:
    """Adds each row's 0-based `place` in its group by (value, tie), and the group's size `n`. Values are cut in ranges of
    `width` for the sums, so no window holds a group. Rows of a null group or value get no place."""
    ranged = rows.withColumns({"_range": F.floor(F.col(value) / width).cast("long"), "_one": F.lit(1).cast("long")})
    sizes = rows.groupBy(*by).agg(F.count(value).alias("n"))
    out = prefix_sums(ranged, "_range", [value, tie], {"place": "_one"}, by)
    return out.join(sizes, list(by)).drop("_range", "_one")


def numbered(rows: DataFrame, epoch: str, order: list[Column | str]) -> DataFrame:
    """Adds goi (place among all batches) and total_order (first message's number)."""
    return prefix_sums(rows.withColumn("_one", F.lit(1).cast("long")), epoch, order, {"goi": "_one", "total_order": "num_msg"}).drop("_one")


def order5(batches: DataFrame) -> DataFrame:
    """Total order with FIFO for each session over all brokers."""
    return numbered(release(batches), "commit_epoch", ["client_id", "session_epoch", "batch_seq"])


def order4(batches: DataFrame) -> DataFrame:
    """FIFO for each (client, session, broker) stream. Further copies arrive behind what their stream expects: they are
    emitted in their own epoch and marked late."""
    key = [*SESSION, "broker_id"]
    stream = batches.withColumn("_f", F.row_number().over(Window.partitionBy(*SESSION, "batch_seq").orderBy("arrival", "batch_id", "broker_id")))
    first = stream.where("_f = 1").drop("_f")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("batch_seq")) - 1
    done = release(first.withColumn("stream_seq", place.cast("long")), key, "stream_seq").withColumn("late", F.lit(False))
    late = stream.where("_f > 1").drop("_f").withColumns({"stream_seq": F.lit(None).cast("long"), "release": F.col("arrival"), "commit_epoch": F.col("epoch"), "late": F.lit(True)})
    return numbered(done.unionByName(late), "commit_epoch", ["late", "client_id", "session_epoch", "broker_id", "batch_seq", "batch_id"])


def order2(batches: DataFrame) -> DataFrame:
    """Total order only: epochs, then brokers, then slots."""
    return numbered(batches, "epoch", ["broker_id", "pbr_index"])


def order3(batches: DataFrame) -> DataFrame:
    """Strict round-robin: one slot of each broker a round."""
    return numbered(batches, "pbr_index", ["broker_id"])


def order1(batches: DataFrame) -> DataFrame:
    """Round-robin that drains what each broker has written: passes of an epoch, messages one by one."""
    return order2(batches).withColumn("last_message", F.col("total_order") + F.col("num_msg") - 1)


def order0(batches: DataFrame) -> DataFrame:
    """No global order: each broker's written offset before its slot. Brokers are cut in ranges of slots for the sums."""
    rows = batches.withColumn("_range", F.expr("pbr_index div 4096"))
    sums = rows.groupBy("broker_id", "_range").agg(F.sum("num_msg").alias("_n"))
    before = Window.partitionBy("broker_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("broker_id", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    within = Window.partitionBy("broker_id", "_range").orderBy("pbr_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, ["broker_id", "_range"]).withColumn("written", (F.col("_b") + F.coalesce(F.sum("num_msg").over(within), F.lit(0))).cast("long")).drop("_b", "_range")


def order_by_message(batches: DataFrame) -> DataFrame:
    """The grain of single messages: order5 with a row for each."""
    rows = order5(batches)
    return rows.select("client_id", "session_epoch", "batch_seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_msg") - 1)).alias("message"), "total_order").withColumn("total_order", F.col("total_order") + F.col("message"))


def contract_violations(rows: DataFrame, key: list[str], seq: str = "batch_seq", place: str = "goi") -> DataFrame:
    """Rows whose sequence doesn't grow along the global order of their key."""
    last = F.lag(seq).over(Window.partitionBy(*key).orderBy(place))
    return rows.withColumn("previous_seq", last).where(F.col("previous_seq") >= F.col(seq))


def committed_ranges(rows: DataFrame, place: str = "goi") -> DataFrame:
    """Gaps and islands of a set of places: (first, last) of each unbroken range.

    Islands are built in ranges of 4096 places. Only those at a range's edges can go on beyond it, two in a range at most,
    and only they meet in one window.
    """
    part = rows.select(F.col(place).alias("x")).distinct().withColumn("_range", F.expr("x div 4096"))
    w = Window.partitionBy("_range").orderBy("x")
    local = part.withColumn("_i", F.col("x") - F.row_number().over(w)).groupBy("_range", "_i").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    edge = (F.pmod("first", F.lit(4096)) == 0) | (F.pmod("last", F.lit(4096)) == 4095)
    edges = local.where(edge).select("first", "last")
    new = F.when(F.lag("last").over(Window.orderBy("first")) + 1 == F.col("first"), 0).otherwise(1)
    island = edges.withColumn("_new", new).withColumn("_id", F.sum("_new").over(Window.orderBy("first")))
    joined = island.groupBy("_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return local.where(~edge).select("first", "last").unionByName(joined.select("first", "last"))


def committed_seq(rows: DataFrame, place: str = "goi") -> DataFrame:
    """The last place before the first hole, null if place 0 is missing: one row."""
    ranges = committed_ranges(rows, place)
    return ranges.agg(F.max(F.when(F.col("first") == 0, F.col("last"))).alias("committed_seq"), F.count("*").alias("ranges"))


def delivered_check(rows: DataFrame) -> DataFrame:
    """One row of verdicts on a delivered log (total_order, num_msg, client_id, session_epoch, batch_seq)."""
    w = Window.partitionBy(*SESSION).orderBy("total_order")
    checked = rows.withColumn("_back", (F.lag("batch_seq").over(w) >= F.col("batch_seq")).cast("int"))
    twice = rows.groupBy("total_order").count().where("count > 1").agg(F.count("*").alias("repeated"))
    sums = checked.agg(
        F.count("*").alias("batches"),
        F.sum("num_msg").alias("messages"),
        (F.max(F.col("total_order") + F.col("num_msg")) - F.min("total_order")).alias("span"),
        F.coalesce(F.sum("_back"), F.lit(0)).alias("fifo_violations"),
    )
    out = sums.crossJoin(twice)  # two single rows
    return out.select("batches", "messages", "repeated", "fifo_violations", (F.col("span") == F.col("messages")).alias("contiguous"))
