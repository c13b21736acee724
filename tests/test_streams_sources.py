"""Streams give the batch result on the same rows; sources read what was written."""

import gzip
import random
import struct

import pytest

from logweave.operators import faults
from logweave.sources import frames, trials
from logweave.streaming import reorder, session_order
from tests.test_ordering import log, random_log


def stream_events(spark, tmp_path, rows, lease, pieces):
    """Feed the rows by arrival in so many files and collect the events."""
    schema = "client_id long, session_epoch long, batch_seq long, num_msg long, arrival long"
    ordered = sorted(rows, key=lambda r: r[5])
    source, out = tmp_path / "in", tmp_path / "out"
    for k in range(pieces):
        part = [(c, s, q, n, a) for c, s, q, _, n, a in ordered[k * len(ordered) // pieces : (k + 1) * len(ordered) // pieces]]
        if k == pieces - 1:  # ticks after the last row, for the leases
            part += [(c, s, None, 0, 10_000) for c, s in {(r[0], r[1]) for r in rows}]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = session_order.ordered(stream, lease).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    return spark.read.schema(session_order.OUTPUT).parquet(str(out)).collect()


def test_stream_equals_batch_with_restarts(spark, tmp_path):
    rows, lease = random_log(2), 4
    events = stream_events(spark, tmp_path, rows, lease, 3)
    got = {(e.client_id, e.session_epoch, e.batch_seq): e.tick for e in events if e.event == "release"}
    want = {(r.client_id, r.session_epoch, r.batch_seq): r.release for r in faults.fenced_release(log(spark, rows), lease).collect()}
    assert got == want
    fences = {(e.client_id, e.session_epoch): (e.batch_seq, e.tick) for e in events if e.event == "fence"}
    assert fences == {(r.client_id, r.session_epoch): (r.fence_seq, r.fence_tick) for r in faults.session_fences(log(spark, rows), lease).collect()}


def frame(first, sizes, version=2, flags=0):
    out = struct.pack("<QIHH", first, len(sizes), version, flags)
    for k, n in enumerate(sizes):
        if version == 2:
            head = struct.pack("<IIQIIQQQQII", n, 1, 0, 0, 0, 0, first + k, 0, 42, k, 0)
            out += head + b"x" * n + b"\0" * (frames.aligned(64 + n) - 64 - n)
        else:
            stride = frames.aligned(64 + n)
            out += struct.pack("<QQQQQQQQ", stride, 0, 0, stride, first + k, 7 + k, 42, n) + b"x" * (stride - 64)
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_frames_split_anywhere(version):
    data = frame(0, [10, 64, 100], version) + frame(3, [1], version, frames.GAP)
    rnd = random.Random(version)
    for _ in range(50):
        cuts = sorted(rnd.randrange(len(data)) for _ in range(rnd.randrange(6)))
        parser, got = frames.FrameParser(), []
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            got += parser.feed(data[a:b])
        assert [(m["total_order"], m["size"], m["gap"]) for m in got] == [(0, 10, False), (1, 64, False), (2, 100, False), (3, 1, True)]


def test_frames_in_spark_and_invalid_ones(spark):
    data = frame(0, [10, 20])
    pieces = [(1, k, data[a:b]) for k, (a, b) in enumerate([(0, 7), (7, 90), (90, len(data))])] + [(2, 0, frame(0, [5], 3)), (3, 0, None)]
    rows = frames.parse(spark.createDataFrame(pieces, "connection long, piece_no long, bytes binary")).collect()
    assert sorted((r.connection, r.total_order, r.valid) for r in rows) == [(1, 0, True), (1, 1, True), (2, 0, False)]


def test_reorder_and_gap(spark):
    rows = [(1, 0, 0, 5, False), (1, 1, 10, 5, False), (1, 2, 5, 5, False), (1, 3, 5, 5, False), (2, 0, 0, 5, False), (2, 1, 25, 5, False), (2, 2, 20, 5, True), (2, 3, 40, 5, False)]
    frames_ = spark.createDataFrame(rows, "subscriber long, arrival long, total_order long, num_messages long, gap boolean")
    got = {(r.subscriber, r.arrival): r.state for r in reorder.delivered(frames_).collect()}
    assert got == {(1, 0): "delivered", (1, 1): "delivered", (1, 2): "delivered", (1, 3): "stale", (2, 0): "stale", (2, 1): "delivered", (2, 2): "delivered", (2, 3): "waiting"}


def test_trial_files(spark, tmp_path):
    for k in range(2):
        d = tmp_path / f"run/t{k}"
        d.mkdir(parents=True)
        (d / "summary.csv").write_text("p50,p99\n1,2 us\n" if k else "p50,p99\nx,<3\n")
        (d / "meta.txt").write_text(f"trial = {k}\nnoise\nmode=a=b\n")
    rows = trials.with_sidecars(spark, f"file://{tmp_path}/run", "summary.csv", "meta.txt")
    got = sorted((r.metadata["trial"], r.metadata["mode"], r.a, r.b) for r in rows.select("metadata", trials.numeric("p50").alias("a"), trials.numeric("p99").alias("b")).collect())
    assert got == [("0", "a=b", None, 3.0), ("1", "a=b", 1.0, 2.0)]
    with gzip.open(tmp_path / "log.gz", "wt") as f:
        f.write("x\n[COMMIT] client=7 batch_seq=9 wall_ms=100\n")
    got = trials.log_lines(spark, f"file://{tmp_path}/log.gz", "[COMMIT]", client=r"client=(\d+)", seq=r"batch_seq=(\d+)", none=r"none=(\d+)").first()
    assert (got.client, got.seq, got.none) == ("7", "9", None)
    files = [f"file://{tmp_path}/run/t{k}/summary.csv" for k in range(2)]
    assert trials.concatenated(spark, files).count() == 2
    (tmp_path / "other.csv").write_text("p50\n1\n")
    with pytest.raises(ValueError, match="other.csv"):
        trials.concatenated(spark, [*files, f"file://{tmp_path}/other.csv"])
