"""Evaluation tables: isolation of commits, stalls against a baseline, run summaries, curves and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.functions import percentiles


def commit_isolation(commits: DataFrame, gaps: DataFrame, edge: int, least: int, most_gap: int) -> DataFrame:
    """Whether a session's gap held back that session alone: commits(trial, client_id, seq, wall) against gaps(trial,
    affected, control, gap_seq, start, stop).

    Nothing at or above the gap's number may be committed inside the gap, the first commit behind it must be that number,
    and the control client must go on: so many commits, no two of them further apart than allowed. Commits meet gaps by
    trial, so the interval is a filter and no range join.
    """
    inside = (F.col("wall") >= F.col("start")) & (F.col("wall") < F.col("stop"))
    mine, other = F.col("client_id") == F.col("affected"), F.col("client_id") == F.col("control")
    rows = commits.join(F.broadcast(gaps), "trial").where(mine | other)  # a row for each trial
    calm = other & (F.col("wall") >= F.col("start") + edge) & (F.col("wall") < F.col("stop") - edge)
    w = Window.partitionBy("trial", "client_id", "_calm").orderBy("wall", "seq")
    rows = rows.withColumn("_calm", calm).withColumn("_gap", F.when(F.col("_calm"), F.col("wall") - F.lag("wall").over(w)))
    after = F.when(mine & (F.col("wall") >= F.col("stop")), F.struct("wall", "seq"))
    by = rows.groupBy("trial").agg(
        F.max("gap_seq").alias("gap_seq"),
        F.sum((mine & inside & (F.col("seq") >= F.col("gap_seq"))).cast("long")).alias("leaked"),
        F.min(after)["seq"].alias("first_after"),
        F.sum(F.col("_calm").cast("long")).alias("control_commits"),
        F.max("_gap").alias("control_gap"),
    )
    valid = (F.col("leaked") == 0) & (F.col("first_after") == F.col("gap_seq")) & (F.col("control_commits") >= least) & (F.col("control_gap") <= most_gap)
    return by.withColumn("valid", F.coalesce(valid, F.lit(False)))


def stall_baselines(series: DataFrame, kills: DataFrame, before: int, warmup: int) -> DataFrame:
    """(key, kill, baseline, basis) of series(key, tick, rate) and kills(key, kill): the median of the last `before` ticks
    before the kill; without samples there that of all ticks behind the warm-up; where that is nought, of the ones that
    aren't."""
    rows = series.join(F.broadcast(kills), "key").where((F.col("tick") < F.col("kill")) & (F.col("tick") >= warmup))  # an event each
    near = F.col("tick") >= F.col("kill") - before
    by = rows.groupBy("key", "kill").agg(
        F.expr(f"percentile(case when tick >= kill - {before} then rate end, 0.5)").alias("a"),
        F.expr("percentile(rate, 0.5)").alias("b"),
        F.expr("percentile(case when rate > 0 then rate end, 0.5)").alias("c"),
        F.count(F.when(near, 1)).alias("n"),
    )
    first = F.when(F.col("n") > 0, F.col("a")).otherwise(F.col("b"))
    base = F.when(first > 0, first).otherwise(F.col("c"))
    basis = F.when(first <= 0, "nonzero").when(F.col("n") > 0, "window").otherwise("warm")
    return by.select("key", "kill", base.alias("baseline"), basis.alias("basis"))


def stall_residual(series: DataFrame, baselines: DataFrame, share: float, sustain: int) -> DataFrame:
    """(key, kill, recovered, stall, dip, residual): the first tick from the kill on from which `sustain` samples in a row
    reach the share of the baseline, the lowest rate before that, and what was missed until then."""
    w = Window.partitionBy("key").orderBy("tick").rowsBetween(0, sustain - 1)
    after = series.withColumns({"_m": F.min("rate").over(w), "_c": F.count("rate").over(w)}).join(F.broadcast(baselines), "key").where(F.col("tick") >= F.col("kill"))
    back = (F.col("_c") == sustain) & (F.col("_m") >= share * F.col("baseline"))
    marked = after.withColumn("_at", F.min(F.when(back, F.col("tick"))).over(Window.partitionBy("key")))
    short = F.col("_at").isNull() | (F.col("tick") < F.col("_at"))
    by = marked.groupBy("key", "kill").agg(F.max("_at").alias("recovered"), F.coalesce(F.min(F.when(short, F.col("rate"))), F.min("rate")).alias("least"), F.max("baseline").alias("baseline"), F.sum(F.when(short, F.greatest(F.col("baseline") - F.col("rate"), F.lit(0.0))).otherwise(0.0)).alias("missed"))
    return by.select("key", "kill", "recovered", (F.col("recovered") - F.col("kill")).alias("stall"), F.round(F.col("least") / F.col("baseline"), 6).alias("dip"), F.round("missed", 4).alias("residual"))


def with_control(rows: DataFrame, *by: str) -> DataFrame:
    """Each affected row (role, value) beside the control row of its group."""
    a, b = rows.where("role = 'affected'"), rows.where("role = 'control'")
    return a.select(*by, F.col("value").alias("affected")).join(b.select(*by, F.col("value").alias("control")), list(by), "full")


def expected_walker(rows: DataFrame, *by: str) -> DataFrame:
    """Where a delivered log jumps: rows whose first number isn't what the row before them ends with, and by how much.
    After a jump the walk goes on from where it landed."""
    w = Window.partitionBy(*by).orderBy("place")
    expected = F.lag(F.col("total_order") + F.col("num_msg")).over(w)
    return rows.withColumn("expected", expected).where(F.col("expected") != F.col("total_order")).withColumn("jump", F.col("total_order") - F.col("expected"))


def dominant_stage(rows: DataFrame, stages: list[str], p: float, *by: str) -> DataFrame:
    """Each stage's nearest-rank percentile by group, and the stage with the greatest one (the first named on a tie)."""
    kind = {s: rows.schema[s].dataType for s in stages}
    found = rows.groupBy(*by).agg(*(percentiles.nearest_rank(s, p).cast(kind[s]).alias(s) for s in stages))
    top = F.greatest(*stages)
    return found.withColumn("dominant", F.coalesce(*(F.when(F.col(s) == top, F.lit(s)) for s in stages)))


def ratios(rows: DataFrame, value: str, mode: str, slow: str, base: str, trials: int, *by: str) -> DataFrame:
    """Medians of two modes of each group and their ratio, over exactly so many trials each; else complete is false."""
    cell = rows.groupBy(*by).agg(*(x for m in (slow, base) for x in (F.expr(f"percentile(case when {mode} = '{m}' then {value} end, 0.5)").alias(m), F.count(F.when(F.col(mode) == m, F.col(value))).alias(f"n_{m}"))))
    complete = (F.col(f"n_{slow}") == trials) & (F.col(f"n_{base}") == trials)
    return cell.select(*by, F.round(base, 4).alias("base"), F.round(slow, 4).alias("slow"), F.round(F.col(slow) / F.col(base), 6).alias("ratio"), complete.alias("complete"))


def band(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Median, least and greatest value by group, and how many there are."""
    return rows.groupBy(*by).agg(F.round(F.median(value), 4).alias("median"), F.round(F.min(value), 4).alias("lo"), F.round(F.max(value), 4).alias("hi"), F.count(value).alias("n"))


def run_summary(runs: DataFrame, most_full: float, *by: str) -> DataFrame:
    """Runs (throughput, batches, full) by cell: median, least, greatest, population deviation, variation and how many runs
    are valid, that is have at most so many percent of refused reservations."""
    share = F.when(F.col("batches") + F.col("full") > 0, 100 * F.col("full") / (F.col("batches") + F.col("full"))).otherwise(0.0)
    rows = runs.withColumn("_s", share)
    sd, mean = F.stddev_pop("throughput"), F.avg("throughput")
    return rows.groupBy(*by).agg(
        F.round(F.median("throughput"), 4).alias("median"), F.round(F.min("throughput"), 4).alias("lo"), F.round(F.max("throughput"), 4).alias("hi"), F.round(sd, 4).alias("sd"),
        F.round(F.when(mean > 0, 100 * sd / mean), 4).alias("cv_percent"), F.round(F.max("_s"), 4).alias("full_percent"), F.count("*").alias("runs"), F.sum((F.col("_s") <= most_full).cast("long")).alias("valid_runs"),
    )


def last_ok(rows: DataFrame, order: str, *by: str) -> DataFrame:
    """The last row of each cell whose status is ok."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.where("status = 'ok'").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def topology(layout: Column, clients: Column, mark: str) -> Column:
    """How the clients of a run are placed, by its layout text and their number; all are remote unless the layout has the
    mark of one beside the log."""
    return F.when(F.coalesce(layout, F.lit("")).contains(mark) & (clients >= 2), F.when(clients == 2, "local_as_n2").otherwise("local_as_n3")).otherwise("all_remote")


def fifo_mode(valid: Column, mode: Column, sync: Column, sequencer: Column, order: Column, native: str) -> Column:
    """The mechanism a run relies on for its FIFO: as named, else by its sync interval, sequencer and order. native names
    the sequencer that orders sessions itself."""
    by_system = F.when(sequencer == native, F.when(order == 5, "native").otherwise("none")).when(sequencer == "CORFU", "token_order").otherwise("none")
    return F.when(~valid, "").when(mode != "auto", mode).when(sync == 1, "stop_and_wait").otherwise(by_system)


def append_complete(data: Column, metadata: Column) -> Column:
    """A client may be told that its append is done: data and metadata replicas are durable, bound or not."""
    return data & metadata


def exposable(data: Column, metadata: Column, bound: Column) -> Column:
    """A record may be read in order: its append is complete and it is bound."""
    return append_complete(data, metadata) & bound


def survives_host(tolerant: Column, kind: Column) -> Column:
    """Replicas stand on hosts of their own."""
    return tolerant & (kind == "RDMA_REPLICA")


def ranked_by_name(column: Column, order: list[str]) -> Column:
    """Sort key of an order of one's own; names that it doesn't list come last."""
    out = None
    for k, name in enumerate(order):
        out = F.when(column == name, k) if out is None else out.when(column == name, k)
    return out.otherwise(len(order))


def open_gaps(gaps: DataFrame, now: int, most: int) -> DataFrame:
    """Gaps that stall their session: open (never filled, or not yet) and older than allowed."""
    still = F.col("arrival").isNull() | (F.col("arrival") > now)
    return gaps.where(still & (F.lit(now) - F.col("gap_start") > most)).withColumn("stalled", F.lit(now) - F.col("gap_start"))


def paired_seals(pairs: DataFrame, seals: DataFrame, width: int) -> DataFrame:
    """For each detected gap (key, n, start, stop) the epochs sealed while it was open, and the seal interval's mean there.

    Gaps and seals meet in buckets of `width` ticks, so there is no range join over all.
    """
    spread = pairs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    near = spread.join(seals.withColumn("_b", F.floor(F.col("seal") / width)), "_b").where("seal >= start and seal < stop")
    by = near.groupBy("key", "n").agg(F.count("*").alias("seals"), F.min("seal").alias("_a"), F.max("seal").alias("_z"))
    out = pairs.join(by, ["key", "n"], "left")
    return out.select("key", "n", "start", "stop", F.coalesce("seals", F.lit(0)).cast("long").alias("seals"), F.when(F.col("seals") > 1, F.round((F.col("_z") - F.col("_a")) / (F.col("seals") - 1), 4)).alias("interval"))


def gate(rows: DataFrame, trials: int, *by: str) -> DataFrame:
    """Whether a group's trials are all there and all valid."""
    return rows.groupBy(*by).agg(F.count("*").alias("trials"), (F.count("*") == trials).alias("complete"), (F.bool_and("valid") & (F.count("*") == trials)).alias("passed"))


def around_events(series: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """(key, at, before, after, change) of series(key, tick, rate) round events(key, at): mean rates on both sides and what
    is left of the rate. Ticks without any rate before an event give no change."""
    rows = series.join(F.broadcast(events), "key").where((F.col("tick") >= F.col("at") - before) & (F.col("tick") < F.col("at") + after))  # a row for each event
    early = F.col("tick") < F.col("at")
    by = rows.groupBy("key", "at").agg(F.avg(F.when(early, F.col("rate"))).alias("a"), F.avg(F.when(~early, F.col("rate"))).alias("b"))
    return by.select("key", "at", F.round("a", 4).alias("before"), F.round("b", 4).alias("after"), F.round(F.when(F.col("a") > 0, F.col("b") / F.col("a")), 6).alias("change"))


def latency_table(rows: DataFrame, value: str, base: Column, *by: str) -> DataFrame:
    """Median and deviation over trials of each trial's p50 and p99, and the medians' change against the base cell of the
    same load: rows(system, load, trial, value)."""
    kind = rows.schema[value].dataType
    trial = rows.groupBy(*by, "load", "trial").agg(percentiles.nearest_rank(value, 0.5).cast(kind).alias("p50"), percentiles.nearest_rank(value, 0.99).cast(kind).alias("p99"))
    sd = lambda c: F.round(F.when(F.count(c) > 1, F.stddev_samp(c)).otherwise(0.0), 4)
    cell = trial.groupBy(*by, "load").agg(F.round(F.median("p50"), 4).alias("p50"), sd("p50").alias("p50_sd"), F.round(F.median("p99"), 4).alias("p99"), sd("p99").alias("p99_sd"), F.count("*").alias("trials"))
    w = Window.partitionBy("load")
    return cell.withColumns({f"{c}_change": F.round(100 * (F.col(c) / F.max(F.when(base, F.col(c))).over(w) - 1), 4) for c in ("p50", "p99")})


def slots_let_go(held: DataFrame, released: DataFrame) -> DataFrame:
    """Held slots (broker_id, slot, pbr_index) with `let_go`: the release of that very slot and lap is there."""
    there = released.select("broker_id", "slot", "pbr_index", F.lit(True).alias("_r")).distinct()
    return held.join(there, ["broker_id", "slot", "pbr_index"], "left").withColumn("let_go", F.coalesce("_r", F.lit(False))).drop("_r")


def late_policies(classes: DataFrame, *by: str) -> DataFrame:
    """What late batches come to under each contract: dropped and credited (client chains), emitted and counted as a
    violation (streams), rejected (the specification)."""
    late = F.col("kind") == "late"
    n = F.sum(late.cast("long"))
    return classes.groupBy(*by).agg(n.alias("dropped"), F.sum(F.when(late, F.col("num_msg")).otherwise(0)).alias("credited"), n.alias("emitted"), n.alias("rejected"), F.sum((F.col("kind") == "held").cast("long")).alias("held"))
