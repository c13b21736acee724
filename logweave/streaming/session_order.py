"""Per-session order of a stream: hold, release in sequence, fence on a lease that ran out.

Time is a column, so replays and restarts give the same rows as one batch run. A row without a batch_seq is a tick: it
only moves the session's time on. State lives in the state store, one hold buffer for each session; a tick that finds
nothing held and nothing new for the time to live ends the session's state. At the end of a log a tick for each session
drains what its lease decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEY = ["client_id", "session_epoch"]
OUTPUT = "client_id long, session_epoch long, batch_seq long, num_msg long, event string, tick long"
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionOrder(StatefulProcessor):
    """Emits released batches (release tick), late or repeated ones, and one fence with the first missing seq."""

    def __init__(self, lease: int | None, ttl: int | None = None):
        self.lease, self.ttl = lease, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        # expected seq, time of the last release, start of the open gap (-1: none, and nothing is held), fenced, last arrival
        self.head = handle.getValueState("head", "expected long, at long, gap long, fenced boolean, seen long")
        self.held = handle.getMapState("held", "seq long", "num_msg long, arrival long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        client, session = (int(k) for k in key)
        expected, at, gap, fenced, seen = self.head.get() if self.head.exists() else (0, -1, -1, False, -1)
        held = {int(k[0]): (int(v[0]), int(v[1])) for k, v in self.held.iterator()} if gap >= 0 and not fenced else {}
        before, over = set(held), False
        out: list[tuple] = []
        frame = pd.concat(list(rows))
        for seq, num, now in frame.sort_values(["arrival", "batch_seq"], kind="stable")[["batch_seq", "num_msg", "arrival"]].itertuples(index=False):
            now = int(now)
            if not fenced and session and self.lease is not None and gap >= 0 and now > gap + self.lease:
                fenced = True
                out.append((client, session, expected, 0, "fence", gap + self.lease))
                held.clear()
            if pd.isna(seq):
                over = self.ttl is not None and not held and seen >= 0 and now - seen > self.ttl
                continue
            seq, num, seen, over = int(seq), int(num), now, False
            if fenced:
                out.append((client, session, seq, num, "fenced", now))
            elif seq < expected or seq in held:
                out.append((client, session, seq, num, "late", now))
            else:
                held[seq] = (num, now)
                opened = gap < 0
                while expected in held:
                    n, arrived = held.pop(expected)
                    at = max(at, arrived)
                    out.append((client, session, expected, n, "release", at))
                    expected += 1
                    opened = True
                if not held:
                    gap = -1
                elif opened:
                    gap = max(at, min(a for _, a in held.values()))
        if over:
            self.head.clear()
        else:
            self.head.update((expected, at, gap, fenced, seen))
        for seq in before - held.keys():
            self.held.removeKey((seq,))
        for seq in held.keys() - before:
            self.held.updateValue((seq,), held[seq])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, lease: int | None = None, ttl: int | None = None) -> DataFrame:
    """Events of the session order of a stream of (client_id, session_epoch, batch_seq, num_msg, arrival).

    Rows of a session must not arrive in a later micro-batch than rows with a greater arrival tick. The session's state
    store must be RocksDB, which is set where nothing is.
    """
    conf = stream.sparkSession.conf
    if conf.get(STORE, None) is None:
        conf.set(STORE, ROCKSDB)
    rows = stream.select(*KEY, "batch_seq", "num_msg", "arrival").groupBy(*KEY)
    return rows.transformWithStateInPandas(SessionOrder(lease, ttl), OUTPUT, "Append", "None")
