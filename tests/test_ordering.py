"""Ordering, fences and contracts on small logs, against an independent tick simulation of the hold buffer."""

import random

import pytest

from logweave.operators import faults, ordering

LOG = "batch_id long, client_id long, session_epoch long, batch_seq long, broker_id long, pbr_index long, num_msg long, arrival long, epoch long"


def log(spark, rows):
    """rows: (client, session, seq, broker, num_msg, arrival)."""
    return spark.createDataFrame([(k, c, s, q, b, k, n, a, a) for k, (c, s, q, b, n, a) in enumerate(rows)], LOG)


def simulate(rows, lease):
    """Tick by tick: classify the arrivals of the tick, drain, then sweep the leases."""
    state, out, fences = {}, {}, {}
    last = max((r[5] for r in rows), default=0) + lease + 2
    for tick in range(last + 1):
        for c, s, q, _, _, a in sorted(r for r in rows if r[5] == tick):
            x = state.setdefault((c, s), {"next": 0, "held": set(), "gap": None, "fenced": False})
            if not x["fenced"] and q >= x["next"]:
                x["held"].add(q)
        for key, x in state.items():
            moved = False
            while x["next"] in x["held"]:
                x["held"].remove(x["next"])
                out[(*key, x["next"])] = tick
                x["next"] += 1
                moved = True
            if not x["held"]:
                x["gap"] = None
            elif x["gap"] is None or moved:
                x["gap"] = tick
            if x["gap"] is not None and key[1] and not x["fenced"] and tick >= x["gap"] + lease:
                x["fenced"] = True
                fences[key] = (x["next"], x["gap"] + lease)
                x["held"].clear()
                x["gap"] = None
    return out, fences


def random_log(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(4):
        for s in (0, 1):
            n = rnd.randrange(1, 9)
            for q in range(n):
                if rnd.random() < 0.1:
                    continue
                for _ in range(1 + (rnd.random() < 0.2)):
                    rows.append((c, s, q, rnd.randrange(3), 1 + rnd.randrange(3), q * 2 + rnd.randrange(12)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_release_and_fence_match_the_simulation(spark, seed):
    rows, lease = random_log(seed), 4
    want, fences = simulate(rows, lease)
    got = {(r.client_id, r.session_epoch, r.batch_seq): r.release for r in faults.fenced_release(log(spark, rows), lease).collect()}
    assert got == want
    found = {(r.client_id, r.session_epoch): (r.fence_seq, r.fence_tick) for r in faults.session_fences(log(spark, rows), lease).collect()}
    assert found == fences


def test_cascade(spark):
    rows = [(1, 0, 2, 0, 4, 0), (1, 0, 0, 0, 4, 1), (1, 0, 1, 0, 4, 2)]
    got = ordering.order5(log(spark, rows)).orderBy("goi").select("batch_seq", "total_order").collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 4), (2, 8)]


def test_chain_over_brokers_and_far_ahead_start(spark):
    rows = [(77, 1, 7, 1, 1, 0), *((77, 1, k, k % 2, 1, k + 1) for k in range(7))]
    got = ordering.order5(log(spark, rows)).orderBy("goi").collect()
    assert [r.batch_seq for r in got] == list(range(8))
    assert faults.range_skips(log(spark, rows)).count() == 0


def test_skip_of_a_lost_batch(spark):
    got = faults.range_skips(log(spark, [(9, 0, 1, 0, 1, 3)])).collect()
    assert [tuple(r) for r in got] == [(9, 0, 0, 1, 3)]


def test_fence_fixture(spark):
    rows = [(5, 1, q, 0, 1, t) for q, t in ((0, 0), (1, 1), (3, 2), (4, 3))]
    got = faults.session_fences(log(spark, rows), 5).collect()
    assert [tuple(r) for r in got] == [(5, 1, 2, 7, 1)]
    assert faults.session_fences(log(spark, [(5, 0, *r[2:]) for r in rows]), 5).count() == 0
    again = faults.resubmissions(log(spark, rows), faults.session_fences(log(spark, rows), 5)).orderBy("new_seq").collect()
    assert [(r.batch_seq, r.new_seq, r.new_epoch) for r in again] == [(3, 0, 2), (4, 1, 2)]


def test_contract_split(spark):
    rows = spark.createDataFrame([(101, 7, 1, 0), (102, 7, 0, 1)], "goi long, client_id long, batch_seq long, broker_id long")
    assert ordering.contract_violations(rows, ["client_id"]).count() == 1
    assert ordering.contract_violations(rows, ["client_id", "broker_id"]).count() == 0


def test_prefix_sums_over_several_coarse_ranges(spark):
    rows = spark.range(5000).selectExpr("id as e", "id % 3 as n")
    got = ordering.prefix_sums(rows, "e", ["n"], {"s": "n"}).orderBy("e").collect()
    total = 0
    for r in got:
        assert r.s == total
        total += r.n


def test_committed_ranges_and_holes(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, 2, 4, 5, 4095, 4096, 4097)], "goi long")
    assert sorted(tuple(r) for r in ordering.committed_ranges(rows).collect()) == [(0, 2), (4, 5), (4095, 4097)]
    assert ordering.committed_seq(rows).first().committed_seq == 2
    assert ordering.committed_seq(rows.where("goi > 0")).first().committed_seq is None


def test_epoch_age_wraps(spark):
    rows = spark.createDataFrame([(65530,), (500,)], "epoch_created int")
    assert faults.stale_epochs(rows, 5).count() == 0 or [r.epoch_created for r in faults.stale_epochs(rows, 5).collect()] == [500]
    assert [r.epoch_created for r in faults.stale_epochs(rows, 3000).collect()] == [65530, 500]


def test_empty_log(spark):
    empty = log(spark, [])
    assert ordering.order5(empty).count() == 0
    assert faults.session_fences(empty, 5).count() == 0
    assert ordering.committed_seq(ordering.order5(empty)).first().committed_seq is None
