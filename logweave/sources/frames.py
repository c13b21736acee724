"""Export frames as rows: a 16-byte batch header, then messages with 64-byte headers padded to 64 bytes, little-endian.

A frame is (first number u64, messages u32, header version u16, flags u16). Version 1 messages start with their padded
size; version 2 messages with their payload size (u32). Bit 0 of the flags marks a gap of the export cursor; other bits
make a frame invalid. Fixed values of the format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PAYLOAD, MOST_MESSAGES, HEADER, GAP = 1 << 20, 10_000, 64, 1
SCHEMA = "connection long, total_order long, client_id long, client_order long, batch_seq long, size long, gap boolean, valid boolean"
_ARROW = pa.schema([(n, pa.bool_() if n in ("gap", "valid") else pa.int64()) for n in (f.split()[0] for f in SCHEMA.split(", "))])


def aligned(n: int) -> int:
    return (n + 63) & ~63


def stride(size: Column) -> Column:
    """Bytes of a message of so much payload, header and padding included, in either version."""
    return (size + HEADER + 63).bitwiseAND(~63)


def valid_v1(padded: Column, rest: Column) -> Column:
    """Whether a version 1 message's padded size can be right, with so many bytes left."""
    return (padded >= HEADER) & (padded <= aligned(HEADER + MOST_PAYLOAD)) & (padded % 64 == 0) & (padded <= rest)


def valid_v2(size: Column, rest: Column) -> Column:
    """Whether a version 2 message's payload size can be right, with so many bytes left."""
    return (size > 0) & (size <= MOST_PAYLOAD) & (stride(size) <= rest)


def valid_batch(version: Column, messages: Column) -> Column:
    """Whether a batch header's version and number of messages can be right."""
    return version.isin(1, 2) & (messages > 0) & (messages <= MOST_MESSAGES)


def encode(batches: DataFrame, piece: int) -> DataFrame:
    """(connection, piece_no, bytes): batches(connection, total_order, num_msg, size, client_id, batch_seq, version, gap) as
    frames, each connection's in order, cut into pieces of so many bytes wherever the cut falls."""
    names = ["connection", "total_order", "num_msg", "size", "client_id", "batch_seq", "version", "gap"]

    def run(parts):
        current, held, number = None, b"", 0
        for part in parts:
            out = []
            for c, first, count, size, client, seq, version, gap in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                if c != current:
                    if held:
                        out.append((current, number, held))
                    current, held, number = c, b"", 0
                held += struct.pack("<QIHH", first, count, version, int(gap))
                step = aligned(HEADER + size)
                if version == 1:
                    message = [struct.pack("<QQQQQQQQ", step, 0, 0, step, 0, k, client, size) for k in range(count)]
                else:
                    message = [struct.pack("<IIQIIQQQQII", size, 1, 0, 0, 0, 0, first + k, 0, client, seq, 0) for k in range(count)]
                held += b"".join(m.ljust(step, b"x") for m in message)
                while len(held) >= piece:
                    out.append((c, number, held[:piece]))
                    held, number = held[piece:], number + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["connection", "piece_no", "bytes"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([number], pa.int64()), pa.array([held], pa.binary())], names=["connection", "piece_no", "bytes"])

    rows = batches.select(*names).repartition("connection").sortWithinPartitions("connection", "total_order")
    return rows.mapInArrow(run, "connection long, piece_no long, bytes binary")


class FrameParser:
    """Messages of one connection, fed in pieces of any size; what isn't complete waits for the next piece."""

    def __init__(self) -> None:
        self.rest = b""
        self.broken = False

    def feed(self, piece: bytes) -> Iterator[dict]:
        if self.broken:
            return
        data, at = self.rest + piece, 0
        while len(data) - at >= 16:
            first, count, version, flags = struct.unpack_from("<QIHH", data, at)
            if version not in (1, 2) or not 0 < count <= MOST_MESSAGES or flags & ~GAP:
                self.broken = True
                yield {"total_order": first, "gap": False, "valid": False}
                return
            messages, place = [], at + 16
            for k in range(count):
                if len(data) - place < HEADER:
                    break
                if version == 1:
                    (stride,) = struct.unpack_from("<Q", data, place)
                    order, client, size = struct.unpack_from("<QQQ", data, place + 40)
                    fine = HEADER <= stride <= aligned(HEADER + MOST_PAYLOAD) and stride % 64 == 0
                    found = {"client_id": client, "client_order": order, "batch_seq": None}
                else:
                    (size,) = struct.unpack_from("<I", data, place)
                    client, seq = struct.unpack_from("<QI", data, place + 48)
                    stride, fine = aligned(HEADER + size), 0 < size <= MOST_PAYLOAD
                    found = {"client_id": client, "client_order": None, "batch_seq": seq}
                if not fine:
                    self.broken = True
                    yield {"total_order": first + k, "gap": False, "valid": False}
                    return
                if len(data) - place < stride:
                    break
                messages.append(found | {"total_order": first + k, "size": size, "gap": bool(flags & GAP) and k == 0, "valid": True})
                place += stride
            if len(messages) < count:
                break
            yield from messages
            at = place
        self.rest = data[at:]


def parse(pieces: DataFrame) -> DataFrame:
    """Messages of pieces(connection, piece_no, bytes): each connection's pieces are read in order by one task, a piece at a
    time; connections are dealt over all tasks."""

    def run(batches):
        parser, current = FrameParser(), None
        for batch in batches:
            out = []
            for c, data in zip(batch.column("connection").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if c != current:
                    parser, current = FrameParser(), c
                out += [{"connection": c, **m} for m in parser.feed(data or b"")]
            if out:
                yield pa.RecordBatch.from_pylist([{n: m.get(n) for n in _ARROW.names} for m in out], _ARROW)

    rows = pieces.select("connection", "piece_no", "bytes").repartition("connection").sortWithinPartitions("connection", "piece_no")
    return rows.mapInArrow(run, SCHEMA)
