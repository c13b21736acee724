"""The batch log that the queries run on, derived from the driver's `events` table by plain expressions.

The same expressions exist as DuckDB text (SQL_*), so both engines start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPOCH = 100  # arrival ticks that an epoch seals
BROKERS = 4


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a batch: who sent it, where it landed, its place in its session and when it arrived (out of order)."""
    e = F.col("event_id")
    arrival = e + (e * 7919) % 997
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return events(spark, sf_dir).select(
        e.alias("batch_id"),
        F.col("user_id").alias("client_id"),
        (F.col("user_id") % 3).alias("session_epoch"),
        seq.cast("long").alias("batch_seq"),
        (e % BROKERS).alias("broker_id"),
        F.expr(f"event_id div {BROKERS}").alias("pbr_index"),
        (1 + e % 5).alias("num_msg"),
        arrival.alias("arrival"),
        F.expr(f"(event_id + (event_id * 7919) % 997) div {EPOCH}").alias("epoch"),
        F.expr(f"((event_id div {EPOCH}) * 3) % 65536").alias("epoch_created"),
        F.round(F.abs("value") * 1000).cast("long").alias("latency_us"),
    )


SQL_BATCHES = f"""
batches as (select event_id as batch_id, user_id as client_id, (user_id % 3)::bigint as session_epoch,
  (row_number() over (partition by user_id order by event_id) - 1)::bigint as batch_seq, (event_id % {BROKERS})::bigint as broker_id,
  (event_id // {BROKERS})::bigint as pbr_index, (1 + event_id % 5)::bigint as num_msg, (event_id + (event_id * 7919) % 997)::bigint as arrival,
  ((event_id + (event_id * 7919) % 997) // {EPOCH})::bigint as epoch, (((event_id // {EPOCH}) * 3) % 65536)::bigint as epoch_created,
  round(abs(value) * 1000)::bigint as latency_us from events)"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with losses (every 97th batch) and late second copies (every 31st, 5000 ticks later, on the next broker)."""
    kept = batches(spark, sf_dir).where("batch_id % 97 <> 0")
    again = kept.where("batch_id % 31 = 0").withColumns(
        {"arrival": F.col("arrival") + 5000, "epoch": F.expr(f"(arrival + 5000) div {EPOCH}"), "broker_id": (F.col("broker_id") + 1) % BROKERS}
    )
    return kept.unionByName(again)


SQL_FAULTY = (
    SQL_BATCHES
    + f""",
kept as (select * from batches where batch_id % 97 <> 0),
faulty as (select * from kept union all
  select batch_id, client_id, session_epoch, batch_seq, ((broker_id + 1) % {BROKERS})::bigint, pbr_index, num_msg, arrival + 5000, ((arrival + 5000) // {EPOCH})::bigint, epoch_created, latency_us
  from kept where batch_id % 31 = 0)"""
)


def replica_done(spark: SparkSession, sf_dir: str, replicas: int = 2) -> DataFrame:
    """(broker_id, replica, last_offset): how far each replica has the broker's messages; the last replica of broker 3 hasn't started."""
    written = batches(spark, sf_dir).groupBy("broker_id").agg(F.sum("num_msg").alias("n"))
    rows = written.select("broker_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicas - 1).cast("long"))).alias("replica"), "n")
    behind = (F.col("broker_id") * 7 + F.col("replica") * 13) % 50
    started = ~((F.col("broker_id") == 3) & (F.col("replica") == replicas - 1))
    return rows.select("broker_id", "replica", F.when(started, F.col("n") - 1 - behind).alias("last_offset"))


SQL_REPLICA_DONE = (
    SQL_BATCHES
    + """,
replica_done as (select broker_id, replica::bigint as replica, case when not (broker_id = 3 and replica = 1) then (n - 1 - (broker_id * 7 + replica * 13) % 50)::bigint end as last_offset
  from (select broker_id, sum(num_msg) as n from batches group by broker_id), (values (0), (1)) r(replica))"""
)


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered state-machine entries: total_order, client, op (PUT, MULTI_PUT, DELETE, NOOP) and its pairs."""
    e, k = F.col("event_id"), F.expr("concat('k', lpad(cast((event_id * 7) % 501 as string), 12, '0'))")
    v = F.concat(F.lit("v"), e.cast("string"))
    k2 = F.expr("concat('k', lpad(cast((event_id * 11 + 3) % 501 as string), 12, '0'))")
    op = F.expr("case when event_id % 13 = 0 then 'DELETE' when event_id % 5 = 0 then 'MULTI_PUT' when event_id % 17 = 0 then 'NOOP' else 'PUT' end")
    pair = lambda a, b: F.struct(a.alias("key"), b.alias("value"))
    two = F.array(pair(k, v), pair(k2, F.concat(v, F.lit("b"))))
    kvs = F.when(op == "MULTI_PUT", two).when(op == "NOOP", F.slice(two, 1, 0)).otherwise(F.slice(two, 1, 1))
    return events(spark, sf_dir).select(e.alias("total_order"), F.col("user_id").alias("client_id"), op.alias("op"), kvs.alias("kvs"))


SQL_KV_ROWS = """
kv as (select event_id as total_order, user_id as client_id, case when event_id % 13 = 0 then 'DELETE' when event_id % 5 = 0 then 'MULTI_PUT' when event_id % 17 = 0 then 'NOOP' else 'PUT' end as op,
  'k' || lpad(((event_id * 7) % 501)::varchar, 12, '0') as k1, 'k' || lpad(((event_id * 11 + 3) % 501)::varchar, 12, '0') as k2, 'v' || event_id as v from events),
pairs as (select total_order, client_id, op, 0 as pos, k1 as key, v as value from kv where op <> 'NOOP'
  union all select total_order, client_id, op, 1, k2, v || 'b' from kv where op = 'MULTI_PUT')"""
