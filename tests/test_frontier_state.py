"""Frontiers, baselines, the key-value machine, traces and functions on the fixtures' literal inputs."""

from pyspark.sql import functions as F

from logweave.functions import percentiles
from logweave.operators import baselines, frontier, state, traces


def test_ack2_fixtures(spark):
    done = spark.createDataFrame([(0, 0, 99), (1, 0, 199), (1, 1, 149), (2, 0, 29), (3, 0, None)], "broker_id int, replica int, last_offset long")
    front = spark.createDataFrame([(0, 900, 50, 0), (1, 900, 80, 0), (2, 900, 100, 0), (3, 900, 50, 0)], "broker_id int, written long, ordered long, cv_durable long")
    levels = spark.createDataFrame([(2, 1, "SCALOG")], "ack int, ord int, sequencer string")
    got = {r.broker_id: r.ack_next for r in frontier.ack_offsets(front, done, levels).collect()}
    assert got == {0: 50, 1: 80, 2: 30, 3: None}


def test_policy(spark):
    rows = spark.createDataFrame([(2, 1, 5, "NATIVE"), (1, 0, 5, "NATIVE"), (2, 2, 5, "NATIVE"), (1, 1, 5, "CORFU")], "a int, f int, o int, s string")
    got = [r[0] for r in rows.select(frontier.policy_error(*map(F.col, "afos"))).collect()]
    assert [x is None for x in got] == [False, True, True, False]


def test_replica_roles(spark):
    got = sorted((r.broker_id, r.role, r.replica) for r in frontier.replica_roles(4, 2, spark).collect())
    assert got[:2] == [(0, 0, 0), (0, 1, 1)] and got[-2:] == [(3, 0, 3), (3, 1, 0)]


def test_cuts(spark):
    for factor in (1, 2, 3):
        rows = [(e, b, r, (e + 1) * 10 + b * 3 + r) for e in range(2) for b in range(2) for r in range(factor)] + [(0, 0, 0, 10), (0, 0, 0, 9)]
        local = spark.createDataFrame(rows, "round int, broker_id int, replica int, cut_cum long")
        got = sorted(tuple(r) for r in baselines.global_cuts(local, 2, factor).collect())
        assert got == [(0, 0, 10), (0, 1, 13), (1, 0, 20), (1, 1, 23)]


def test_bindings(spark):
    rows = [(e, b, (e + 1) * 100 + b * 7) for e in range(2) for b in range(2)] + [(0, 0, 100), (0, 0, 99)]
    got = sorted(tuple(r) for r in baselines.bindings(spark.createDataFrame(rows, "round int, broker_id int, progress_cum long"), 2).collect())
    assert got == [(0, 0, 100), (0, 1, 107), (1, 0, 100), (1, 1, 100)]


def test_compare_and_set_chain(spark):
    ops = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 2, 3), (1, 2, 1, 4)], "key long, place long, expected long, new long")
    assert [tuple(r) for r in state.compare_and_set(ops).collect()] == [(1, 2, 1, 4)]


def test_fifo_values(spark):
    rows = spark.createDataFrame([("F|000000000007|0000000000000003|xxxx", 0), ("F|000000000007|0000000000000002|xxxx", 1), ("F|7|2|", 2), (None, 3)], "v string, place long")
    parsed = rows.withColumn("p", state.parsed_fifo(F.col("v"))).where("p is not null").select("p.key", "p.version", "place")
    assert [tuple(r) for r in state.fifo_audit(parsed, ["key"], "version", "place").collect()] == [(7, 2, 1)]
    made = spark.range(1).select(state.fifo_value(F.lit(7), F.lit(3), 36)).first()[0]
    assert made == "F|000000000007|0000000000000003|xxxx"


def test_apply_with_delete_and_multi_put(spark):
    kv = "array<struct<key: string, value: string>>"
    log = spark.createDataFrame([(0, 1, "PUT", [("a", "1")]), (1, 1, "MULTI_PUT", [("a", "2"), ("b", "3")]), (2, 1, "DELETE", [("b", "")]), (3, 1, "NOOP", [])], f"total_order long, client_id long, op string, kvs {kv}")
    assert [tuple(r) for r in state.apply(log).collect()] == [("a", "2", 1)]
    one, other = state.digest(state.apply(log)).first(), state.digest(state.apply(log).repartition(3)).first()
    assert one == other


def test_percentile_definitions(spark):
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "x double")
    got = rows.agg(percentiles.nearest_rank("x", 0.5), percentiles.linear("x", 0.5)).first()
    assert tuple(got) == (2.0, 2.5)
    grouped = rows.withColumn("g", F.lit(1)).unionByName(rows.select((F.col("x") * 5000).alias("x"), F.lit(2).alias("g"))).unionByName(rows.where("x = 1").withColumn("g", F.lit(3)))
    got = percentiles.at_index(grouped, "x", "g", floor=percentiles.floor_index(0.5), middle=percentiles.upper_median).collect()
    assert {tuple(r) for r in got} == {(1, 3.0, 3.0), (2, 15000.0, 15000.0), (3, 1.0, 1.0)}


def test_trial_statistics(spark):
    rows = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate((208, 220, 237))] + [("b", 0, 5.0)], "s string, trial int, v double")
    got = {r.s: (r.n, r.sd) for r in traces.trial_stats(rows, "v", "s").collect()}
    assert got == {"a": (3, 14.5717), "b": (1, 0.0)}
    rows = spark.createDataFrame([("V0", 17.307), ("V1", 14.906)], "cell string, gbps double").withColumn("n", F.lit(4))
    got = {r.cell: (r.delta, r.delta_percent) for r in traces.against(rows, "cell", F.col("cell") == "V0", "gbps", "n").collect()}
    assert got["V1"] == (-2.401, -13.873)


def test_consensus_with_a_repaired_inversion(spark):
    rows = spark.createDataFrame([("c", True, 5161, "m", None), ("c", True, 0, "m", "fifo+cas")], "cell string, valid boolean, reorders long, label string, failed string")
    assert [tuple(r) for r in traces.consensus(rows, "cell").collect()] == [("c", False, "m", "cas+fifo")]


def test_ack_as_of(spark):
    sends = spark.createDataFrame([(1, 0, 4, 10), (1, 1, 8, 11), (1, 2, 12, 12)], "client_id long, batch_seq long, end_count long, sent long")
    acks = spark.createDataFrame([(1, 5, 20), (1, 8, 30)], "client_id long, acked long, ack_time long")
    got = sorted((r.batch_seq, r.acked_at) for r in frontier.first_ack(sends, acks).collect() if r.acked_at is not None)
    assert got == [(0, 20), (1, 30)]


def test_round_trip_clamps(spark):
    rows = spark.createDataFrame([(1, 0, 10, False), (1, 1, 10, False), (1, 2, 99999, True)], "c long, i long, us long, resent boolean")
    got = traces.round_trip(rows, "c", "i", "us", "resent").first()
    assert (got.samples, got["mean"], got.delta) == (2, 10.0, 1700.0)


def test_zipf_covers_all_draws(spark):
    table = state.zipf_table(spark, 50, 0.99)
    draws = spark.range(0, 1000000, 997).selectExpr("id as draw")
    assert state.zipf_draws(draws, table).count() == draws.count()
