"""Queries over whole tables, against plain Python."""

import os

import pytest

from logweave.operators import faults, state
from logweave.plans import catalog, delivery_queries
from logweave.sources.derived import batches, kv_log
from tests.test_catalog import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_merge_holds_every_batch_in_order(spark):
    got = catalog.queries()["merged_streams"](spark, DATA).collect()
    rows = sorted(batches(spark, DATA).collect(), key=lambda r: (r.epoch, r.broker_id, r.pbr_index))
    want, total = [], 0
    for k, r in enumerate(rows):
        want.append((k, r.broker_id, total, r.num_msg))
        total += r.num_msg
    assert len(rows) > 200 and [tuple(r) for r in got] == want


def test_every_client_has_its_ring(spark):
    got = {(r.client_id, r.batch_id): r.place for r in catalog.queries()["ring_order"](spark, DATA).collect()}
    rings = {}
    for r in batches(spark, DATA).collect():
        rings.setdefault(r.client_id, []).append(((r.batch_seq - 5) % 16, r.batch_seq, r.batch_id))
    assert len(rings) > 1 and got == {(c, b): k + 1 for c, ring in rings.items() for k, (*_, b) in enumerate(sorted(ring))}


def test_replicas_are_built_apart(spark, monkeypatch):
    log, apply = kv_log(spark, DATA), state.apply_in_parts
    assert sorted(map(tuple, apply(log, log.client_id).collect())) == sorted(map(tuple, state.apply(log).collect()))
    whole = delivery_queries._replicas(log).collect()
    assert len(whole) == 2 and len({(r.keys, r.digest) for r in whole}) == 1
    monkeypatch.setattr(state, "apply_in_parts", lambda d, part: apply(d.where("total_order <> 1"), part))
    lost = delivery_queries._replicas(log.where("total_order < 20")).collect()
    assert len({r.digest for r in lost}) == 2


def test_recovery_ends_at_the_first_hole(spark):
    columns = "goi long, client_id long, session_epoch long, batch_seq long, num_msg long, total_order long"
    rows = [(k, k % 2, 0, k // 2, 2, 2 * k) for k in range(1200)]
    got = lambda r: sorted(map(tuple, faults.recovered_committed(spark.createDataFrame(r, columns)).collect()))
    assert got(rows) == [(0, 0, 600, 1200, 2398), (1, 0, 600, 1200, 2400)]
    assert got([r for r in rows if r[0] != 700]) == [(0, 0, 350, 700, 1398), (1, 0, 350, 700, 1400)]
    assert got(rows[1:]) == []
