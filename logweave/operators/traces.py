"""Trace analytics: latency statistics, stalls and recovery, overlap windows, pairing, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.functions import percentiles
from logweave.operators.ordering import placed


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank percentiles with min, max, mean and count."""
    at = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    kind = rows.schema[value].dataType
    return rows.groupBy(*by).agg(*(percentiles.nearest_rank(value, p).cast(kind).alias(n) for n, p in at.items()), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 4).alias("mean"), F.count(value).alias("n"))


def cdf(rows: DataFrame, value: str, tie: str, *by: str, width: int = 1024) -> DataFrame:
    """Empirical distribution (i + 1) / n with a place of its own for each row, ties too."""
    return placed(rows, value, tie, width, *by).withColumn("share", F.round((F.col("place") + 1) / F.col("n"), 6)).drop("place", "n")


def tail_breakdown(rows: DataFrame, value: str, stages: list[str], p: float) -> DataFrame:
    """Mean of each stage over the rows at or above the percentile, and which stage dominates there."""
    edge = rows.agg(percentiles.nearest_rank(value, p).cast(rows.schema[value].dataType).alias("edge"))
    tail = rows.crossJoin(F.broadcast(edge)).where(F.col(value) >= F.col("edge"))  # a single row
    means = tail.agg(F.count("*").alias("n"), F.first("edge").alias("edge"), *(F.round(F.avg(s), 4).alias(s) for s in stages))
    top = F.greatest(*stages)
    dominant = F.coalesce(*(F.when(F.col(s) == top, s) for s in stages))
    return means.withColumn("dominant", dominant)


def steady_rate(rows: DataFrame, order: str, size: str, time: str, *by: str, width: int = 4096) -> DataFrame:
    """Throughput between the quarter and three quarter points of each group's deliveries, in size per tick."""
    i, n = F.col("place"), F.col("n")
    mid = placed(rows, order, order, width, *by).where((i >= F.floor(n / 4)) & (i < F.floor(n * 3 / 4)))
    span = F.max(time) - F.min(time)
    return mid.groupBy(*by).agg(F.sum(size).alias("size"), span.alias("span"), F.when(span > 0, F.round(F.sum(size) / span, 6)).alias("rate"))


def stalls(series: DataFrame, key: str, kill: int, before: int, share: float, sustain: int = 2) -> DataFrame:
    """For each series (key, tick, rate): median before the kill, the dip, and the first tick from which `sustain` samples
    in a row reach the share of the baseline. The kill's window is a filter, so no range join is needed."""
    base = series.where((F.col("tick") >= kill - before) & (F.col("tick") < kill)).groupBy(key).agg(percentiles.linear("rate", 0.5).alias("baseline"))
    w = Window.partitionBy(key).orderBy("tick").rowsBetween(0, sustain - 1)
    after = series.where(F.col("tick") >= kill).withColumns({"_m": F.min("rate").over(w), "_c": F.count("rate").over(w)}).join(base, key)
    back = (F.col("_c") == sustain) & (F.col("_m") >= share * F.col("baseline"))
    found = after.groupBy(key).agg(F.first("baseline").alias("baseline"), F.min("rate").alias("least"), F.min(F.when(back, F.col("tick"))).alias("recovered"))
    return found.select(key, "baseline", F.round(F.col("least") / F.col("baseline"), 6).alias("dip"), "recovered", (F.col("recovered") - kill).alias("stall"))


def overlap_throughput(rows: DataFrame, key: str, time: str, count: str) -> DataFrame:
    """The window in which every key is active, and each key's progress inside it: its cumulative count at the first and
    last sample there."""
    active = rows.groupBy(key).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    window = active.agg(F.max("a").alias("start"), F.min("b").alias("stop"))
    inside = rows.crossJoin(F.broadcast(window)).where(F.col(time).between(F.col("start"), F.col("stop")))  # a single row
    ends = inside.groupBy(key).agg(F.min_by(count, time).alias("c0"), F.max_by(count, time).alias("c1"), F.min(time).alias("t0"), F.max(time).alias("t1"))
    return ends.select(key, "t0", "t1", (F.col("c1") - F.col("c0")).alias("progress"), F.when(F.col("t1") > F.col("t0"), F.round((F.col("c1") - F.col("c0")) / (F.col("t1") - F.col("t0")), 6)).alias("rate"))


def paired(rows: DataFrame, key: str, time: str, kind: str, first: str, second: str) -> DataFrame:
    """The n-th start of each key with its n-th end: (key, n, start, stop, held)."""
    w = Window.partitionBy(key, kind).orderBy(time)
    marked = rows.where(F.col(kind).isin(first, second)).withColumn("n", F.row_number().over(w).cast("long"))
    both = marked.groupBy(key, "n").agg(F.max(F.when(F.col(kind) == first, F.col(time))).alias("start"), F.max(F.when(F.col(kind) == second, F.col(time))).alias("stop"))
    return both.where("start is not null and stop is not null").withColumn("held", F.col("stop") - F.col("start"))


def longest_stall(series: DataFrame, key: str) -> DataFrame:
    """Longest run of samples of each series (key, tick, cum) without progress: its first tick and its length."""
    w = Window.partitionBy(key).orderBy("tick")
    moved = series.withColumn("_m", F.coalesce((F.col("cum") > F.lag("cum").over(w)).cast("int"), F.lit(1)))
    run = moved.withColumn("_r", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_r").agg(F.min("tick").alias("since"), (F.max("tick") - F.min("tick")).alias("length"))
    best = run.groupBy(key).agg(F.max(F.struct("length", (-F.col("since")).alias("s"))).alias("b"))
    return best.select(key, F.col("b.length").alias("length"), (-F.col("b.s")).alias("since"))


def trial_stats(rows: DataFrame, value: str, *by: str, warmup: int = 0, least: int = 1) -> DataFrame:
    """Mean, sample deviation and 95 % interval by group; the first trials go if enough are left. One trial: 0."""
    w = Window.partitionBy(*by).orderBy("trial")
    n = F.count("*").over(Window.partitionBy(*by))
    kept = rows.withColumns({"_i": F.row_number().over(w), "_n": n}).where((F.col("_n") - warmup < least) | (F.col("_i") > warmup))
    sd = F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value))
    return kept.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(sd, 4).alias("sd"), F.round(1.96 * sd / F.sqrt(F.count(value)), 4).alias("ci95"), F.round(100 * F.stddev_pop(value) / F.avg(value), 4).alias("cv_percent"))


def against(rows: DataFrame, key: str, baseline: Column, value: str, *by: str) -> DataFrame:
    """Delta and ratio of each cell against the baseline's cell of its group, by conditional aggregation over the group."""
    w = Window.partitionBy(*by)
    base = F.max(F.when(baseline, F.col(value))).over(w)
    return rows.withColumn("base", base).select(*by, key, value, F.round(F.col(value) - F.col("base"), 4).alias("delta"), F.round(100 * (F.col(value) - F.col("base")) / F.col("base"), 4).alias("delta_percent"), F.round(F.col(value) / F.col("base"), 6).alias("ratio"))


def quality_flags(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """missing, single_trial, high_variance (range over median above 0.40) or ok."""
    found = rows.groupBy(*by).agg(F.count(value).alias("n"), percentiles.linear(value, 0.5).alias("median"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    flag = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "single_trial").when((F.col("hi") - F.col("lo")) / F.col("median") > 0.40, "high_variance").otherwise("ok")
    return found.select(*by, "n", F.round("median", 4).alias("median"), flag.alias("flag"))


def completeness(rows: DataFrame, trials: int, *by: str) -> DataFrame:
    """Which groups have exactly the trials 0..T-1, and which problems the others have."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("trial")).alias("ids"), F.count_distinct("commit").alias("commits"), F.max(F.col("dirty").cast("int")).alias("dirty"))
    wrong = F.array_compact(F.array(F.when(F.col("n") != trials, "count"), F.when(F.col("ids") != F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long")), "ids"), F.when(F.col("commits") != 1, "commits"), F.when(F.col("dirty") == 1, "dirty")))
    return found.select(*by, "n", F.array_join(wrong, "+").alias("problems"), (F.size(wrong) == 0).alias("complete"))


def consensus(rows: DataFrame, *by: str) -> DataFrame:
    """A cell is valid if all its trials are and none has reorders; failed checks, joined by '+', are united."""
    checks = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(F.coalesce("failed", F.lit("")), r"\+"), lambda x: x != "")))))
    return rows.groupBy(*by).agg(F.bool_and(F.col("valid") & (F.col("reorders") == 0)).alias("valid"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.array_join(checks, "+").alias("failed"))


def rolling_mean(series: DataFrame, key: str, value: str, width: int = 3) -> DataFrame:
    """Mean over the last `width` samples, fewer at the start."""
    w = Window.partitionBy(key).orderBy("tick").rowsBetween(1 - width, 0)
    return series.withColumn("rolling", F.round(F.avg(value).over(w), 6))


def trimmed_end(series: DataFrame, key: str, value: str, share: float = 0.7) -> DataFrame:
    """Last tick at or above the share of each series' peak."""
    peak = F.max(value).over(Window.partitionBy(key))
    return series.withColumn("_p", peak).where(F.col(value) >= share * F.col("_p")).groupBy(key).agg(F.max("tick").alias("last"), F.max("_p").alias("peak"))


def intercommit(rows: DataFrame, key: str, time: str, edge: int) -> DataFrame:
    """Largest gap between commits of each key, its first and last `edge` commits left out."""
    w = Window.partitionBy(key).orderBy(time)
    n = F.count("*").over(Window.partitionBy(key))
    mid = rows.withColumns({"_i": F.row_number().over(w), "_n": n}).where((F.col("_i") > edge) & (F.col("_i") <= F.col("_n") - edge))
    gap = F.col(time) - F.lag(time).over(w)
    return mid.withColumn("_g", gap).groupBy(key).agg(F.max("_g").alias("gap"), F.count("*").alias("commits"))


def interpolated(series: DataFrame, key: str, value: str) -> DataFrame:
    """Missing values between two known ones on the line between them."""
    w = Window.partitionBy(key).orderBy("tick")
    known = F.when(F.col(value).isNotNull(), F.struct("tick", value))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    s = series.withColumns({"_a": F.last(known, True).over(back), "_b": F.first(known, True).over(ahead)})
    step = (F.col(f"_b.{value}") - F.col(f"_a.{value}")) / (F.col("_b.tick") - F.col("_a.tick"))
    line = F.col(f"_a.{value}") + step * (F.col("tick") - F.col("_a.tick"))
    return s.withColumn("filled", F.round(F.coalesce(F.col(value).cast("double"), F.when(F.col("_b.tick") > F.col("_a.tick"), line)), 6)).drop("_a", "_b")


def round_trip(samples: DataFrame, key: str, order: str, value: str, resent: str) -> DataFrame:
    """Smoothed round trip and its variation (gains 1/8 and 1/4, resent samples skipped), folded in order for each key;
    delta is the sum of the mean and four variations within 1.7 to 12 ms."""
    kept = samples.where(~F.col(resent)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))).alias("l"))
    start = F.struct(F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("d"))

    def step(a: Column, x: Column) -> Column:
        first = a["m"].isNull()
        dev = F.when(first, x["v"] / 2).otherwise(a["d"] + (F.abs(x["v"] - a["m"]) - a["d"]) / 4)
        return F.struct(F.when(first, x["v"]).otherwise(a["m"] + (x["v"] - a["m"]) / 8).alias("m"), dev.alias("d"))

    done = kept.select(key, F.size("l").cast("long").alias("samples"), F.aggregate("l", start, step).alias("r"))
    delta = F.least(F.lit(12000.0), F.greatest(F.lit(1700.0), F.col("r.m") + 4 * F.col("r.d")))
    return done.select(key, "samples", F.round("r.m", 3).alias("mean"), F.round("r.d", 3).alias("deviation"), F.round(delta, 3).alias("delta"))


def top_pressure(rows: DataFrame, n: int = 8) -> DataFrame:
    """The n clients under most pressure: by expiries, holds, skips, late copies, depth, then id, all falling."""
    return rows.orderBy(*(F.desc(c) for c in ("expiries", "holds", "skips", "late", "depth", "client_id"))).limit(n)


def best_receive(delivered: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Each delivery with its fastest receive sample, null if there is none."""
    best = samples.groupBy(key).agg(F.min(F.struct("latency_us", "age_us")).alias("r"))
    return delivered.join(best, key, "left").select(*delivered.columns, F.col("r.latency_us").alias("receive_us"), F.col("r.age_us").alias("age_us"))


def cells(expected: DataFrame, present: DataFrame, *by: str) -> DataFrame:
    """missing and extra cells."""
    e, p = expected.select(*by, F.lit(1).alias("_e")).distinct(), present.select(*by, F.lit(1).alias("_p")).distinct()
    both = e.join(p, list(by), "full")
    return both.where("_e is null or _p is null").select(*by, F.when(F.col("_p").isNull(), "missing").otherwise("extra").alias("state"))
