"""The replicated key-value machine: application of the ordered log, audits, digests and workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def writes(log: DataFrame) -> DataFrame:
    """(total_order, pos, client, op, key, value): the single writes of every entry."""
    return log.select("total_order", "client_id", "op", F.posexplode("kvs").alias("pos", "kv")).select("total_order", "client_id", "op", "pos", "kv.key", "kv.value")


def apply(log: DataFrame) -> DataFrame:
    """(key, value, total_order) after the whole log: the last write of each key, deleted keys left out."""
    last = writes(log).groupBy("key").agg(F.max(F.struct("total_order", "pos", "op", "value")).alias("w"))
    return last.where("w.op <> 'DELETE'").select("key", "w.value", "w.total_order")


def apply_in_parts(log: DataFrame, part: Column) -> DataFrame:
    """What apply() gives, by another path: each part of a delivery keeps its own last write of a key, deletes too, and
    these are merged. Entries may come more than once and in any part."""
    last = Window.partitionBy("_part", "key").orderBy(F.desc("total_order"), F.desc("pos"))
    parts = log.withColumn("_part", part).select("_part", "total_order", "op", F.posexplode("kvs").alias("pos", "kv"))
    kept = parts.select("_part", "total_order", "op", "pos", "kv.key", "kv.value").withColumn("_k", F.row_number().over(last)).where("_k = 1")
    merged = kept.groupBy("key").agg(*(F.max_by(c, F.struct("total_order", "pos")).alias(c) for c in ("op", "value", "total_order")))
    return merged.where("op <> 'DELETE'").select("key", "value", "total_order")


def scan(state: DataFrame, starts: DataFrame, count: int, records: int) -> DataFrame:
    """(start, step, key, value): `count` numeric successors of each start, round the key space; absent keys are ''."""
    wanted = starts.select("start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("step"))
    keyed = wanted.withColumn("key", F.concat(F.lit("k"), F.lpad(((F.col("start") + F.col("step")) % records).cast("string"), 12, "0")))
    return keyed.join(state.select("key", "value"), "key", "left").select("start", "step", "key", F.coalesce("value", F.lit("")).alias("value"))


def digest(state: DataFrame, *by: str) -> DataFrame:
    """Commutative digest: the sum modulo 2^64 of 60-bit hashes of the pairs, with the number of keys."""
    h = F.conv(F.substring(F.md5(F.concat("key", F.lit("="), "value")), 1, 15), 16, 10).cast("decimal(38,0)")
    return state.groupBy(*by).agg(F.count("*").alias("keys"), F.pmod(F.sum(h), F.lit(str(2**64)).cast("decimal(38,0)")).cast("string").alias("digest"))


def read_modify_write(ops: DataFrame, initial: str, mark: str, size: int) -> DataFrame:
    """(key, value) after each op appended the mark and cut to `size`: cuts from the right commute with appending, so the
    count alone decides."""
    n = F.least(F.count("*"), F.lit(size)).cast("int")
    return ops.groupBy("key").agg(F.substring(F.concat(F.lit(initial), F.repeat(F.lit(mark), n)), 1, size).alias("value"), F.count("*").alias("ops"))


def read_modify_write_live(ops: DataFrame, mark: str, size: int) -> DataFrame:
    """(key, value, ops) after ordered operations (key, place, op, value): PUT sets, DELETE clears (value null), RMW appends
    the mark to what is there, cut to `size`.

    Marks between two writes commute with the cut, so a key's last write and the count behind it decide: two partial sums.
    """
    last = ops.where("op <> 'RMW'").groupBy("key").agg(F.max(F.struct("place", "op", "value")).alias("w"))
    rows = ops.join(last, "key", "left")
    behind = (F.col("op") == "RMW") & (F.col("w").isNull() | (F.col("place") > F.col("w.place")))
    sums = rows.groupBy("key").agg(F.max("w").alias("w"), F.sum(behind.cast("long")).alias("n"), F.count("*").alias("ops"))
    base = F.when(F.col("w.op") == "PUT", F.col("w.value")).otherwise(F.lit(""))
    marked = F.substring(F.concat(base, F.repeat(F.lit(mark), F.least("n", F.lit(size)).cast("int"))), 1, size)
    value = F.when(F.col("n") > 0, marked).when(F.col("w.op") == "PUT", F.col("w.value"))
    return sums.select("key", value.alias("value"), "ops")


def cas_value(key: Column, expected: Column, new: Column, size: int) -> Column:
    """C|key of 12 digits|expected version of 16|new version of 16|, filled with x."""
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.rpad(F.concat(F.lit("C|"), digits(key, 12), F.lit("|"), digits(expected, 16), F.lit("|"), digits(new, 16), F.lit("|")), size, "x")


def parsed_cas(value: Column) -> Column:
    """Struct of key, expected and new, null if the text isn't such a value."""
    fits = value.rlike(r"^C\|[0-9]{12}\|[0-9]{16}\|[0-9]{16}\|")
    part = lambda a, n, name: F.substring(value, a, n).cast("long").alias(name)
    return F.when(fits, F.struct(part(3, 12, "key"), part(16, 16, "expected"), part(33, 16, "new")))


def crc32c(text: Column) -> Column:
    """CRC-32C of a column's UTF-8 bytes, folded over its hex digits by a table of 16 steps."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0x82F63B78 if k & 1 else 0)
        table.append(k)
    steps = F.array(*(F.lit(x).cast("long") for x in table))
    pairs = F.transform(F.filter(F.split(F.regexp_replace(F.hex(text.cast("string").cast("binary")), "(.)(.)", "$2$1"), ""), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))  # low nibble first
    last = F.aggregate(pairs, F.lit(0xFFFFFFFF).cast("long"), lambda c, d: F.shiftright(c, 4).bitwiseXOR(F.element_at(steps, (c.bitwiseXOR(d).bitwiseAND(F.lit(15)) + 1).cast("int"))))
    return last.bitwiseXOR(F.lit(0xFFFFFFFF).cast("long"))


def fifo_audit(applied: DataFrame, key: list[str], version: str, place: str) -> DataFrame:
    """Applied versions that fall below an earlier one of their key: (key..., applied, reorders)."""
    w = Window.partitionBy(*key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return applied.withColumn("_r", (F.col(version) < F.max(version).over(w)).cast("long")).groupBy(*key).agg(F.count("*").alias("applied"), F.coalesce(F.sum("_r"), F.lit(0).cast("long")).alias("reorders"))


def compare_and_set(ops: DataFrame) -> DataFrame:
    """(key, committed, rejected, version) of ordered compare-and-set ops (key, place, expected, new) from version 0.

    Each result decides the next, so a key's ops are folded in order; keys fold in parallel.
    """
    listed = ops.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "expected", "new"))).alias("ops"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("version"), zero.alias("committed"), zero.alias("rejected"))

    def step(a: Column, x: Column) -> Column:
        fits = a["version"] == x["expected"]
        return F.struct(
            F.when(fits, x["new"]).otherwise(a["version"]).alias("version"),
            (a["committed"] + fits.cast("long")).alias("committed"),
            (a["rejected"] + (~fits).cast("long")).alias("rejected"),
        )

    return listed.select("key", F.aggregate("ops", start, step).alias("r")).select("key", "r.committed", "r.rejected", "r.version")


def fifo_value(key: Column, version: Column, size: int) -> Column:
    """F|key of 12 digits|version of 16 digits|, filled with x."""
    return F.rpad(F.concat(F.lit("F|"), F.lpad(key.cast("string"), 12, "0"), F.lit("|"), F.lpad(version.cast("string"), 16, "0"), F.lit("|")), size, "x")


def parsed_fifo(value: Column) -> Column:
    """Struct of key and version, null if the text isn't such a value."""
    fits = value.rlike(r"^F\|[0-9]{12}\|[0-9]{16}\|")
    return F.when(fits, F.struct(F.substring(value, 3, 12).cast("long").alias("key"), F.substring(value, 16, 16).cast("long").alias("version")))


#: Shares in percent of reads, updates, inserts, scans and read-modify-writes of the standard workloads. Fixed values.
WORKLOADS = {"A": (50, 50, 0, 0, 0), "B": (95, 5, 0, 0, 0), "C": (100, 0, 0, 0, 0), "D": (95, 0, 5, 0, 0), "E": (0, 0, 5, 95, 0), "F": (50, 0, 0, 0, 50)}
_KINDS = ("read", "update", "insert", "scan", "rmw")


def workload_op(workload: Column, draw: Column) -> Column:
    """The kind of operation for a uniform draw in 0..99."""
    out = None
    for name, shares in WORKLOADS.items():
        edge = 0
        for kind, share in zip(_KINDS, shares, strict=True):
            edge += share
            if share:
                test = (workload == name) & (draw < edge)
                out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def zipf_table(spark, records: int, theta: float) -> DataFrame:
    """(rank, low, high): the key ranks' ranges of a uniform draw in millionths under Zipf's law."""
    ranks = spark.range(1, records + 1).select(F.col("id").alias("rank"), (1 / F.pow("id", F.lit(theta))).alias("p"))
    w = Window.orderBy("rank")
    cum = ranks.withColumn("c", F.sum("p").over(w)).withColumn("t", F.sum("p").over(Window.partitionBy()))
    edge = F.round(F.col("c") / F.col("t") * 1e6).cast("long")
    return cum.withColumn("high", edge).select("rank", F.coalesce(F.lag("high").over(w), F.lit(0).cast("long")).alias("low"), "high")


def zipf_draws(draws: DataFrame, table: DataFrame) -> DataFrame:
    """Key rank of each draw (0..999999): a join on buckets of 1000 millionths that the ranks' ranges touch."""
    buckets = table.where("high > low").withColumn("bucket", F.explode(F.sequence(F.expr("low div 1000"), F.expr("(high - 1) div 1000"))))
    hit = draws.withColumn("bucket", F.expr("draw div 1000")).join(buckets, "bucket")
    return hit.where("draw >= low and draw < high").drop("bucket", "low", "high")
