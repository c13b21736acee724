"""Slots, holes, recovery, audits, topics, sinks and labels on literal inputs."""

import pytest
from pyspark.sql import functions as F

from logweave.operators import delivery, experiments, ordering, recovery, slots, state, topics
from logweave.sources import frames, storage
from logweave.streaming import session_order

LOG = "batch_id long, client_id long, session_epoch long, batch_seq long, broker_id long, num_msg long, arrival long, epoch long"


def rows(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_publication_names_the_slot_itself(spark):
    frame = spark.createDataFrame([(1, 1), (2, 3), (4, None)], "pbr_index long, publish_commit long")
    assert rows(frame.where(slots.published()), "pbr_index") == [(1,)]


def test_claim_is_lost_with_any_of_its_marks(spark):
    there = [(0, 0, 0, 10, 1, None, False), (0, 1, 1, 11, 3, None, False), (0, 2, 2, 12, 1, 2, False), (0, 3, 3, 13, 1, None, True), (0, 4, 4100, 14, 1, None, False)]
    ring = spark.createDataFrame(there, "broker_id long, slot long, pbr_index long, batch_id long, flags int, publish_commit long, complete boolean")
    claims = spark.createDataFrame([(0, k, k, 10 + k) for k in range(6)], "broker_id long, slot long, pbr_index long, batch_id long")
    assert rows(slots.still_owned(ring, claims), "slot", "owned") == [(0, True), *((k, False) for k in range(1, 6))]


def test_stream_passes_a_hole_and_marks_what_comes_behind_it_late(spark):
    log = [(k, 1, 0, q, 0, 1, a, 0) for k, (q, a) in enumerate([(0, 1), (1, 50), (2, 3), (4, 6)])]
    frame = spark.createDataFrame(log, LOG).withColumn("stream_seq", F.col("batch_seq"))
    frame = frame.unionByName(frame.where("batch_seq = 0").withColumn("arrival", F.lit(90).cast("long")))
    got = rows(slots.stream_release(frame, 10), "stream_seq", "release", "late")
    # 1 is waited for until 3 + 10, then 2 goes; 3 never comes: 4 goes 10 ticks after it could; the copy of 0 is late.
    assert got == [(0, 1, False), (0, 90, True), (1, 50, True), (2, 13, False), (4, 23, False)]


def test_gate_stays_closed_behind_a_failed_ticket(spark):
    frame = spark.createDataFrame([(1, 0, 5, False), (1, 1, 2, True), (1, 2, 3, False), (2, 0, 1, False), (2, 2, 4, False)], "client_id long, ticket long, arrival long, failed boolean")
    assert rows(slots.ticket_gate(frame), "client_id", "ticket", "state") == [(1, 0, "passed"), (1, 1, "refused"), (1, 2, "refused"), (2, 0, "passed"), (2, 2, "waiting")]


def test_skips_fence_a_session_but_not_epoch_nought(spark):
    log = [(1, 1, e, q, 0, 1, 10 * q, 0) for e in (0, 1) for q in (0, 2, 3)]
    skips = spark.createDataFrame([(1, 0, 1, 25), (1, 1, 1, 25), (1, 0, 2, 99)], "client_id long, session_epoch long, batch_seq long, tick long")
    got = slots.released_with_skips(spark.createDataFrame(log, LOG), skips)
    assert rows(got, "session_epoch", "batch_seq", "release") == [(0, 0, 0), (0, 2, 25), (0, 3, 30), (1, 0, 0)]


def test_markers_take_no_place(spark):
    log = spark.createDataFrame([(0, 1, 0, 1, 0, 3, 5, 0), (1, 1, 0, 0, 0, 2, 150, 1)], LOG).withColumn("pbr_index", F.col("batch_id"))
    marked = slots.with_held_markers(log)
    assert marked.where("marker").count() == 1
    assert rows(slots.numbered_without_markers(marked), "batch_seq", "goi", "total_order") == [(0, 0, 0), (1, 1, 2)]


def test_failover_and_reopening_commit_each_batch_once(spark):
    goi = spark.createDataFrame([(k, 1 + k % 2, 1, k // 2, 2, 2 * k) for k in range(10)], "goi long, client_id long, session_epoch long, batch_seq long, num_msg long, total_order long")
    floor = spark.createDataFrame([(7,)], "floor long")
    kept, orphaned = recovery.failover(goi, floor)
    state_ = {r.client_id: r for r in recovery.failover_state(goi, floor, 3).collect()}
    assert kept.count() == 7 and orphaned.count() == 3
    assert (state_[1].next_expected, state_[1].orphaned, state_[2].next_expected, state_[2].orphaned, state_[1].control_epoch) == (4, 1, 3, 2, 4)
    again = orphaned.join(recovery.failover_state(goi, floor, 3).select("client_id", "next_expected"), "client_id").where("batch_seq >= next_expected")
    assert kept.unionByName(again.select(kept.columns)).groupBy("client_id", "batch_seq").count().where("count > 1").count() == 0
    fences = spark.createDataFrame([(1, 1, 4, 3), (2, 5, 0, None)], "client_id long, session_epoch long, fence_seq long, committed_hwm long")
    assert rows(recovery.reopened(fences), "client_id", "generation", "next_seq") == [(1, 2, 4), (2, 6, 0)]


def test_reconnecting_client_is_told_the_lesser_prefix(spark):
    frame = spark.createDataFrame([(5, 3), (2, 3), (5, None), (None, 3), (None, None)], "a long, b long")
    got = [r.h for r in frame.select(recovery.reconnect_hwm(F.col("a"), F.col("b")).alias("h")).collect()]
    assert got == [3, 2, 5, None, None]


def test_invariants_name_what_is_broken(spark):
    schema = "goi long, client_id long, session_epoch long, batch_seq long, num_msg long, total_order long"
    sound = [(k, 1, 1, k, 1, k) for k in range(6)]
    fences = spark.createDataFrame([(1, 1, 6)], "client_id long, session_epoch long, fence_seq long")
    floor = spark.createDataFrame([(4,)], "floor long")

    def found(log, fenced=fences, acked=4, read=sound, capacity=100):
        read = spark.createDataFrame([(r[0], *r[1:4]) for r in read], "place long, client_id long, session_epoch long, batch_seq long")
        acks = spark.createDataFrame([(1, 1, acked)], "client_id long, session_epoch long, acked_next long")
        got = recovery.invariants(spark.createDataFrame(log, schema), fenced, acks, read, floor, capacity)
        return {r.invariant: r.violations for r in got.collect() if r.violations}

    assert found(sound) == {}
    assert found([*sound[:4], (4, 1, 1, 3, 1, 4), (5, 1, 1, 5, 1, 5)]) == {"NoDupCommit": 1, "PerSessionPrefix": 1, "LateNeverReordered": 1}
    assert found(sound, fenced=fences.withColumn("fence_seq", F.lit(5).cast("long"))) == {"FencedSuffixNeverCommitted": 1}
    assert found(sound, acked=5) == {"AckedIffCommitted": 1}
    assert found(sound, capacity=1) == {"NoWrap": 1}
    assert found(sound, read=[(0, 1, 1, 1), (5, 1, 1, 0)]) == {"ReaderAgreement": 1}


def test_crc32c_of_the_standard_text(spark):
    frame = spark.createDataFrame([("123456789",), ("",), ("é",)], "t string")
    assert [r.c for r in frame.select(state.crc32c(F.col("t")).alias("c")).collect()][:2] == [0xE3069283, 0]


def test_read_modify_write_sees_writes_between(spark):
    ops = [("a", 0, "RMW", None), ("a", 1, "PUT", "v"), ("a", 2, "RMW", None), ("a", 3, "RMW", None), ("b", 0, "PUT", "x"), ("b", 1, "DELETE", None), ("b", 2, "RMW", None), ("c", 0, "PUT", "y"), ("c", 1, "DELETE", None)]
    frame = spark.createDataFrame(ops, "key string, place long, op string, value string")
    assert sorted(map(tuple, state.read_modify_write_live(frame, "|rmw", 8).collect()), key=str) == [("a", "v|rmw|rm", 4), ("b", "|rmw", 3), ("c", None, 2)]


def test_cas_text_round_trip(spark):
    frame = spark.createDataFrame([(7, 3, 4)], "k long, e long, n long").select(state.cas_value(F.col("k"), F.col("e"), F.col("n"), 64).alias("t"))
    assert frame.first().t == "C|000000000007|0000000000000003|0000000000000004|" + "x" * 15
    assert tuple(frame.select(state.parsed_cas(F.col("t")).alias("p")).first().p) == (7, 3, 4)


def test_topics_are_idempotent(spark):
    schema = "topic string, at long, action string, ack int, factor int, ord int, sequencer string"
    asked = [("t", 0, "delete", 0, 0, 0, "NATIVE"), ("t", 1, "create", 2, 1, 5, "NATIVE"), ("t", 2, "create", 1, 2, 5, "NATIVE"), ("t", 3, "create", 1, 2, 5, "NATIVE"), ("t", 4, "create", 0, 2, 5, "NATIVE"), ("t", 5, "delete", 0, 0, 0, "NATIVE"), ("t", 6, "create", 0, 1, 0, "NATIVE")]
    answers = topics.answered(spark.createDataFrame(asked, schema))
    got = [r.answer for r in answers.orderBy("at").collect()]
    assert got[0] == "UNKNOWN" and "replication_factor>=2" in got[1] and got[2:] == ["CREATED", "EXISTS", "CONFLICT", "DELETED", "CREATED"]
    assert [tuple(r) for r in topics.alive(answers).collect()] == [("t", 0, 1, 0, "NATIVE")]


def test_results_are_appended_under_one_header(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "x int, y string")
    storage.append_csv(one, f"file://{tmp_path}/r")
    storage.append_csv(one, f"file://{tmp_path}/r")
    assert spark.read.csv(f"file://{tmp_path}/r", header=True).count() == 2
    with pytest.raises(ValueError, match="header"):
        storage.append_csv(one.withColumnRenamed("y", "z"), f"file://{tmp_path}/r")


def test_frames_come_back_from_pieces(spark):
    schema = "connection long, total_order long, num_msg long, size long, client_id long, batch_seq long, version int, gap boolean"
    sent = [(c, 10 * k, 1 + k % 3, 1 + 70 * k, 5, k, 1 + c % 2, k == 2) for c in (0, 1) for k in range(5)]
    got = frames.parse(frames.encode(spark.createDataFrame(sent, schema), 100)).collect()
    assert sorted((r.connection, r.total_order, r.size, r.gap) for r in got) == sorted((c, t + j, s, g and j == 0) for c, t, n, s, _, _, _, g in sent for j in range(n))
    assert all(r.valid for r in got)


def test_idle_session_state_ends(spark, tmp_path):
    schema = "client_id long, session_epoch long, batch_seq long, num_msg long, arrival long"
    files = [[(1, 1, 0, 1, 0), (2, 1, 0, 1, 0), (2, 1, 2, 1, 0)], [(1, 1, None, 0, 500), (2, 1, None, 0, 500)], [(1, 1, 0, 1, 600), (2, 1, 1, 1, 600)]]
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = session_order.ordered(storage.ingest_stream(spark, source, schema), None, 100)
        storage.appended_stream(stream, out, f"file://{tmp_path}/state").awaitTermination()
    got = rows(spark.read.schema(session_order.OUTPUT).parquet(out), "client_id", "batch_seq", "event")
    # Session 1 was idle and starts anew; session 2 holds a batch and keeps its state.
    assert got == [(1, 0, "release"), (1, 0, "release"), (2, 0, "release"), (2, 1, "release"), (2, 2, "release")]


def test_consumer_stops_at_a_hole(spark):
    order = spark.createDataFrame([(0, 2), (2, 3), (5, 1), (7, 1)], "total_order long, num_msg long")
    assert [r.total_order for r in delivery.consume(order)] == [0, 2, 5]
    assert [r.total_order for r in delivery.consume(order, 2)] == [2, 5]


def test_places_within_groups(spark):
    frame = spark.createDataFrame([(g, v, t) for g in (1, 2) for t, v in enumerate([5, 5000, 5, 70000, 1])], "g long, v long, t long")
    got = rows(ordering.placed(frame, "v", "t", 1024, "g").where("g = 2"), "v", "t", "place", "n")
    assert got == [(1, 4, 0, 5), (5, 0, 1, 5), (5, 2, 2, 5), (5000, 1, 3, 5), (70000, 3, 4, 5)]


def test_islands_join_at_the_edges_of_ranges(spark):
    places = [*range(4000, 9000), 9001, *range(12287, 12289), 4096 * 5 - 1]
    frame = spark.createDataFrame([(x,) for x in places], "goi long")
    assert rows(ordering.committed_ranges(frame), "first", "last") == [(4000, 8999), (9001, 9001), (12287, 12288), (20479, 20479)]


def test_labels(spark):
    frame = spark.range(1)
    label = lambda *a: frame.select(experiments.fifo_mode(*map(F.lit, a[:5]), a[5]).alias("x")).first().x
    assert [label(False, "auto", 1, "OWN", 5, "OWN"), label(True, "manual", 1, "OWN", 5, "OWN"), label(True, "auto", 1, "SCALOG", 1, "OWN"), label(True, "auto", 0, "OWN", 5, "OWN"), label(True, "auto", 0, "CORFU", 2, "OWN"), label(True, "auto", 0, "SCALOG", 1, "OWN")] == ["", "manual", "stop_and_wait", "native", "token_order", "none"]


def test_prefix_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE", 4)
    numbers = {1: [*range(11), 12, 13], 2: [*range(4), *range(8, 12)], 3: [1, 2], 4: [*range(8)]}
    log = [(100 * c + q, c, 0, q, 0, 1, (q * 7) % 10, q) for c, qs in numbers.items() for q in qs]
    got = rows(ordering.release(spark.createDataFrame(log, LOG)), "client_id", "batch_seq", "release")
    assert got == [(c, q, max((k * 7) % 10 for k in range(q + 1))) for c, n in ((1, 11), (2, 4), (4, 8)) for q in range(n)]
