"""Exact removal of repeated byte strings by a sparse, hash-compared suffix sort.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Every window of that length is
represented by its anchor, the place of the smallest hash among its `gram`-byte strings (the leftmost on a tie), so
equal windows have equal anchors at equal offsets. Consecutive windows with one anchor form a unit.

1. Units of equal bytes at equal offsets form a class; a class of two or more is repeated as a whole. Equal means: one
   polynomial hash, and of the bytes and offsets one 128-bit digest, which has no structure in common with it. What a
   document repeats by itself is counted and united there, so that a document has one row of a class at most.
2. Where a gram anchors several classes, one unit of each class stands for it; its text is cut out of its document.
   It is cut into slices of offsets, keyed by the hash of what all windows of the slice share, so that only units that
   have most of a window in common meet in a task, however frequent the gram is.
3. In a task the windows of the units that meet are suffixes. They are sorted by a bottom-up mergesort that compares two
   suffixes by their longest common extension, found by binary search over prefix polynomial hashes; a window is
   repeated if it has the whole length in common with a neighbour of the order. Equal hashes are verified byte by byte.
   Of a key with more slices than a task takes, narrower slices and at last single windows are classed as in step 1.
4. The spans of repeated windows are united for each document.

Matches never cross documents; texts are UTF-8 bytes, null as empty. Long documents are read in overlapping pieces that
share no window, so memory is bounded. Rows are told apart by a number of their own, so ids may repeat or be null.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, arrow_map, byte_lists, files_for, materialize, mix64, packed, utf8

GRAM = 32
#: Windows of a piece of a long document, and offsets of a slice.
PIECE, SLICE = 1 << 20, 96
#: Slices of one key that are sorted in one task; those of more frequent keys are told apart by counting.
FREQUENT = 1000
_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) <= n:
        size = 1 << (n + 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


class Hashes:
    """Prefix polynomial hashes of a byte array; a substring's hash takes one subtraction and one product."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.prefix[1:])

    def of(self, start, end):
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, from the running minima of blocks of w in both directions."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def within(doc: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries given document by document: how often an entry's key occurs in its document, and whether it is the first there."""
    order, new = np.lexsort((*key, doc)), np.ones(len(doc), bool)
    new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (doc, *key)], 0)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(doc)))
    n, first = np.empty(len(doc), np.int64), np.zeros(len(doc), bool)
    n[order], first[order[begin]] = np.repeat(size, size), True
    return n, first


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans, those that overlap or touch as one; starts and ends ascend within a document."""
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    return doc[head], start[head], end[np.append(head[1:], True)[: len(doc)]]


def digest(data: bytes, offset: int) -> tuple[int, int]:
    """128 bits of the bytes and the anchor's place in them, as two signed words."""
    h = xxhash.xxh3_128_intdigest(data, offset)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def units(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, class hash, first window, last window, anchor) of each unit of a text."""
    out = []
    for base in range(0, max(1, len(text) - length + 1), PIECE):
        data = np.frombuffer(text, np.uint8)[base : base + PIECE + length - 1]
        windows = len(data) - length + 1
        if windows <= 0:
            break
        h = Hashes(data)
        at = np.arange(len(data) - gram + 1)
        raw = (h.prefix[gram:] - h.prefix[:-gram]) * h.down[: len(at)]
        keyed = (mix64(raw) & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
        anchor = (sliding_min(keyed, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [windows]]) - 1
        anchor = anchor[first]
        whole = mix64(h.of(first, last + length)) ^ mix64(((anchor - first) * (1 << 20) + last - first).astype(np.uint64))
        out.append((mix64(raw[anchor]), whole, first + base, last + base, anchor + base))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)


def common_extension(h: Hashes, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Longest common extension of the suffixes at a and b, up to the limit, by binary search on equal hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
    for _ in range(int(limit).bit_length()):
        mid = (low + high + 1) >> 1
        same = h.of(a, a + mid) == h.of(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _below(h: Hashes, data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether the suffix at a sorts before the one at b."""
    e = common_extension(h, a, b, limit)
    end = e >= limit
    return ~end & (data[np.where(end, a, a + e)] < data[np.where(end, b, b + e)])


def merge_sorted(h: Hashes, data: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes within each group (given together): bottom-up mergesort, all runs of a level at once.

    A run's elements find their places in the sibling run by binary search; equal suffixes keep their order.
    """
    n = len(starts)
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([bounds, [n]]))
    base, total = np.repeat(bounds, size), np.repeat(size, size)
    order, place, width = np.arange(n), np.arange(n) - base, 1
    while n and width < size.max():
        run = place // width
        left = run % 2 == 0
        sibling = np.where(left, run + 1, run - 1) * width
        low, high = np.minimum(sibling, total), np.minimum(sibling + width, total)
        begin = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            mine, other = starts[order[open_]], starts[order[base[open_] + mid]]
            lower = np.where(left[open_], _below(h, data, other, mine, limit), ~_below(h, data, mine, other, limit))
            low[open_], high[open_] = np.where(lower, mid + 1, low[open_]), np.where(lower, high[open_], mid)
        target = base + (run // 2) * 2 * width + place % width + (low - begin)
        moved = np.empty_like(order)
        moved[target] = order
        order, width = moved, width * 2
    return order


def repeated_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows (sorted by group) equal another one of their group: neighbours in suffix order, verified."""
    h = Hashes(data)
    # Windows that share no hash with another can't be equal to one; sorting the others alone keeps the levels few.
    own = h.of(starts, starts + length) ^ mix64(group.astype(np.uint64))
    _, back, many = np.unique(own, return_inverse=True, return_counts=True)
    at = np.flatnonzero(many[back] > 1)
    order = at[merge_sorted(h, data, starts[at], group[at], length)]
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((group[a] == group[b]) & (common_extension(h, starts[a], starts[b], length) >= length))
    out = np.zeros(len(starts), bool)
    for part in np.array_split(near, len(near) // 4096 + 1):
        x, y = starts[a[part], None] + np.arange(length), starts[b[part], None] + np.arange(length)
        fine = part[(data[x] == data[y]).all(1)]
        out[a[fine]] = out[b[fine]] = True
    return out


_KEY = [("id", pa.int64()), ("r1", pa.int64())]
_SPAN = pa.schema([*_KEY, ("s0", pa.int32()), ("s1", pa.int32())])
_SLICE = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), *_KEY, ("s0", pa.int32()), ("s1", pa.int32()), ("p", pa.int32()), ("own", pa.bool_()), ("bytes", pa.binary())])
_SPAN_SQL, _SLICE_SQL = "id long, r1 long, s0 int, s1 int", "key long, c1 long, c2 long, id long, r1 long, s0 int, s1 int, p int, own boolean, bytes binary"


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each document and class of units in it: the first one, and how many there are (n).

    Text of a short period has a unit for each period, all of few classes. That these are repeated is known from the document
    alone: what they cover comes as united spans, with n = 0, and goes through no join.
    """
    schema = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), *_SPAN, ("p", pa.int32()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            found, sure, ids, hashes = [], [], [], []
            for t, i, r in zip(byte_lists(batch), batch.column("id").to_pylist(), batch.column("r1").to_pylist(), strict=True):
                if len(t) >= length:
                    found.append(units(t, length, gram))
                    sure += [digest(t[a : b + length], q - a) for a, b, q in zip(*(x.tolist() for x in found[-1][2:]), strict=True)]
                    ids.append(i)
                    hashes.append(r)
            if found:
                g, c, s0, s1, p = (np.concatenate(x) for x in zip(*found, strict=True))
                c1, c2 = np.array(sure, np.int64).reshape(-1, 2).T
                doc, ids, hashes = np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), np.array(ids, np.int64), np.array(hashes, np.int64)
                n, first = within(doc, c2, c1, c, g)
                again = n > 1
                d, a, b = united(doc[again], s0[again], s1[again] + length)
                made = {"g": g[first].view(np.int64), "c": c[first].view(np.int64), "c1": c1[first], "c2": c2[first], "id": ids[doc[first]], "r1": hashes[doc[first]], "s0": s0[first], "s1": s1[first], "p": p[first], "n": n[first]}
                yield packed(made, schema)
                none = np.zeros(len(d), np.int64)
                yield packed({"g": none, "c": none, "c1": none, "c2": none, "id": ids[d], "r1": hashes[d], "s0": a, "s1": b - length, "p": none, "n": none}, schema)

    return arrow_map(rows.select("id", "r1", "text"), run, f"g long, c long, c1 long, c2 long, {_SPAN_SQL}, p int, n int")


def _cut(out: dict, data: bytes, base: int, s0: int, s1: int, p: int, length: int, width: int, rest: dict) -> None:
    """Add the slices of a unit's windows: those whose anchor offsets fall into one range of the given width.

    All windows of a slice hold the bytes [p - k * width, p - (k + 1) * width + 1 + length), which key it.
    """
    h = Hashes(np.frombuffer(data, np.uint8))
    for k in range((p - s1) // width, (p - s0) // width + 1):
        low, high = p - k * width, p - (k + 1) * width + 1 + length
        first, last = max(s0, high - length), min(s1, low)
        core = h.of(np.array([low - base]), np.array([high - base])) + np.uint64((k * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        own = data[first - base : last + length - base]
        out["key"].append(int(mix64(core).view(np.int64)[0]))
        for name, word in zip(("c1", "c2"), digest(own, p - first), strict=True):
            out[name].append(word)
        out["s0"].append(first)
        out["s1"].append(last)
        out["p"].append(p)
        out["bytes"].append(own)
        for name, value in rest.items():
            out[name].append(value)


def _slices(texts: DataFrame, length: int, width: int) -> DataFrame:
    """The slices of the units listed for each text."""

    def run(batches):
        for batch in batches:
            out = {f.name: [] for f in _SLICE}
            for text, i, r, listed in zip(byte_lists(batch), batch.column("id").to_pylist(), batch.column("r1").to_pylist(), batch.column("units").to_pylist(), strict=True):
                for u in listed:
                    _cut(out, text[u["s0"] : u["s1"] + length], u["s0"], u["s0"], u["s1"], u["p"], length, width, {"id": i, "r1": r, "own": u["n"] == 1})
            yield packed(out, _SLICE)

    return arrow_map(texts.select("id", "r1", "text", "units"), run, _SLICE_SQL)


def _narrowed(slices: DataFrame, length: int, width: int) -> DataFrame:
    """Slices cut again to narrower ones."""

    def run(batches):
        for batch in batches:
            out = {f.name: [] for f in _SLICE}
            for x in batch.to_pylist():
                _cut(out, x["bytes"], x["s0"], x["s0"], x["s1"], x["p"], length, width, {n: x[n] for n in ("id", "r1", "own")})
            yield packed(out, _SLICE)

    return arrow_map(slices.select(*_SLICE.names), run, _SLICE_SQL)


def _sorted_apart(slices: DataFrame, length: int) -> DataFrame:
    """Repeated windows among the slices of each key, by suffix sort. Rows come grouped by key, each group bounded."""

    def flush(held: list[dict]):
        data = np.frombuffer(b"".join(x["bytes"] for x in held), np.uint8)
        sizes = np.array([len(x["bytes"]) for x in held])
        first, last, p = (np.array([x[n] for x in held], np.int64) for n in ("s0", "s1", "p"))
        many = last - first + 1
        unit = np.repeat(np.arange(len(held)), many)
        shift = np.arange(len(unit)) - np.repeat(np.cumsum(many) - many, many)
        starts = (np.cumsum(sizes) - sizes)[unit] + shift
        # Equal windows have one key and one offset of the anchor.
        _, keys = np.unique([x["key"] for x in held], return_inverse=True)
        group = keys[unit] * (1 << 20) + (p - first)[unit] - shift
        order = np.argsort(group, kind="stable")
        found = np.zeros(len(unit), bool)
        found[order] = repeated_windows(data, starts[order], group[order], length)
        found &= np.array([x["own"] for x in held])[unit]
        at = np.flatnonzero(found)
        if not len(at):
            return None
        head = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(unit[at]) > 0)])
        tail = np.concatenate([head[1:], [True]])
        u = unit[at[head]]
        return packed({"id": [held[k]["id"] for k in u], "r1": [held[k]["r1"] for k in u], "s0": first[u] + shift[at[head]], "s1": first[u] + shift[at[tail]]}, _SPAN)

    def run(batches):
        held, size, group, key = [], 0, [], None
        for batch in batches:
            for x in batch.to_pylist():
                if x["key"] != key:
                    if len(group) > 1:
                        held += group
                        size += sum(len(y["bytes"]) for y in group)
                    if size > 1 << 20:
                        if (out := flush(held)) is not None:
                            yield out
                        held, size = [], 0
                    group, key = [], x["key"]
                group.append(x)
        held += group if len(group) > 1 else []
        if held and (out := flush(held)) is not None:
            yield out

    return arrow_map(slices.select(*_SLICE.names).repartition("key").sortWithinPartitions("key"), run, _SPAN_SQL)


_CLASS = ["key", "c1", "c2"]


def _held_by(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is listed. A merge join at every size: Spark splits a frequent key's rows over many tasks."""
    return rows.join(keys.hint("merge"), on, "left_semi")


def _counted_apart(slices: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Repeated windows among slices of frequent keys, without a group in one task: narrow slices, then single windows,
    are counted by their content with partial sums."""
    narrow = scratch.save(_narrowed(slices, length, 8), "narrow")
    classes = scratch.save(narrow.groupBy(*_CLASS).agg(F.count("*").alias("n"), F.min(F.struct("id", "r1", "s0", "s1", "p", "own", "bytes")).alias("u")), "classes")
    again = scratch.save(classes.where("n > 1").select(*_CLASS), "again")
    whole = _held_by(narrow.where("own"), again, _CLASS).select(*_SPAN.names)
    mixed = scratch.save(classes.groupBy("key").agg(F.count("*").alias("k"), F.min("n").alias("m")).where("k > 1 and m = 1").select("key"), "mixed")
    left = _held_by(classes, mixed, ["key"]).select(*_CLASS, "u.id", "u.r1", "u.s0", "u.s1", "u.p", (F.col("u.own") & (F.col("n") == 1)).alias("own"), "u.bytes")
    single = scratch.save(_narrowed(left, length, 1).drop("bytes"), "single")
    again = scratch.save(single.groupBy(*_CLASS).agg(F.count("*").alias("n")).where("n > 1").select(*_CLASS), "again")
    return whole.union(_held_by(single.where("own"), again, _CLASS).select(*_SPAN.names))


def find(docs: DataFrame, length: int = 400, gram: int = GRAM, frequent: int = FREQUENT) -> DataFrame:
    """(id, r1, s0, s1): runs of windows that are repeated; id is doc_id (the least long for null), r1 the text's hash.

    What a frequent gram is joined with is written first, so that Spark can split the gram's rows over many tasks.
    """
    rows, gram = _keyed(docs), min(gram, max(1, length // 2))
    files = files_for(rows)
    with Scratch(docs.sparkSession, files) as scratch:
        runs = scratch.save(_runs(rows, length, gram), "runs")
        inside, runs = runs.where("n = 0").select(*_SPAN.names), runs.where("n > 0")
        live = scratch.save(runs.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"), "live")
        same = ["g", "c", "c1", "c2"]
        # The complement of g keeps Spark from aggregating where it has joined, with all of a frequent gram's rows in one task.
        alive = _held_by(runs, live, ["g"]).withColumn("g", F.bitwise_not("g"))
        classes = alive.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.struct("id", "r1", "s0", "s1", "p")).alias("u"))
        classes = scratch.save(classes.withColumn("g", F.bitwise_not("g")), "classes")
        again = scratch.save(classes.where("n > 1").select(*same), "again")
        whole = inside.union(_held_by(runs.where("n = 1"), again, same).select(*_SPAN.names))
        mixed = scratch.save(classes.groupBy("g").agg(F.count("*").alias("k"), F.min("n").alias("m")).where("k > 1 and m = 1").select("g"), "mixed")
        listed = _held_by(classes, mixed, ["g"]).select("u.id", "u.r1", F.struct("u.s0", "u.s1", "u.p", "n").alias("x"))
        listed = listed.groupBy("id", "r1").agg(F.collect_list("x").alias("units"))  # of a document
        slices = scratch.save(_slices(rows.join(listed.hint("merge"), ["id", "r1"]), length, min(SLICE, max(1, length // 4))), "slices")
        sizes = scratch.save(slices.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
        met = _held_by(slices, sizes.where(f"k <= {frequent}").select("key"), ["key"])
        found = _sorted_apart(met, length)
        often = sizes.where(f"k > {frequent}").select("key")
        if not often.isEmpty():
            found = found.union(_counted_apart(_held_by(slices, often, ["key"]), length, scratch))
        return materialize(whole.union(found), "spans", files)


_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words of a UTF-8 text, parted as str.split() does."""
    space = _ASCII_SPACE[data]
    if data.size and (data > 0x7F).any():
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = pad[:-2], pad[1:-1], pad[2:]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        three |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        space |= two | three
        space[1:] |= (two | three)[:-1]
        space[2:] |= three[:-2]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def short_passages(text: bytes, words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the runs of so many words that are shorter than `length` bytes."""
    first, last = word_bounds(np.frombuffer(text, np.uint8))
    first, last = first[: max(0, len(first) - words + 1)], last[words - 1 :]
    short = last - first < length
    return first[short], last[short]


def find_passages(docs: DataFrame, words: int, length: int) -> DataFrame:
    """(id, r1, s0, s1) like find()'s, s1 + length being the end: runs of so many words, shorter than `length` bytes, whose bytes
    are also such a run elsewhere. Longer ones hold a string of `length` bytes at each of their places, which find() finds.
    Those that their own document repeats are united there and counted once, as in _runs()."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), *_SPAN, ("n", pa.int32())])

    def told(held: list[tuple], ids: np.ndarray, hashes: np.ndarray):
        doc, a, b, sure = zip(*held, strict=True)
        doc, a, b, (h1, h2) = np.concatenate(doc), np.concatenate(a), np.concatenate(b), np.concatenate(sure).T
        n, first = within(doc, h2, h1)
        again = n > 1
        d, s, e = united(doc[again], a[again], b[again])
        yield packed({"h1": h1[first], "h2": h2[first], "id": ids[doc[first]], "r1": hashes[doc[first]], "s0": a[first], "s1": b[first] - length, "n": n[first]}, schema)
        none = np.zeros(len(d), np.int64)
        yield packed({"h1": none, "h2": none, "id": ids[d], "r1": hashes[d], "s0": s, "s1": e - length, "n": none}, schema)

    def run(batches):
        for batch in batches:
            ids, hashes = (batch.column(x).to_numpy() for x in ("id", "r1"))
            held, size = [], 0
            for k, t in enumerate(byte_lists(batch)):
                a, b = short_passages(t, words, length)
                if len(a):
                    held.append((np.full(len(a), k), a, b, np.array([digest(t[x:y], 0) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)))
                    size += len(a)
                if size > 1 << 16:
                    yield from told(held, ids, hashes)
                    held, size = [], 0
            if held:
                yield from told(held, ids, hashes)

    files = files_for(docs.select("text"))
    with Scratch(docs.sparkSession, files) as scratch:
        runs = scratch.save(arrow_map(_keyed(docs).select("id", "r1", "text"), run, f"h1 long, h2 long, {_SPAN_SQL}, n int"), "runs")
        inside, runs = runs.where("n = 0").select(*_SPAN.names), runs.where("n > 0")
        again = scratch.save(runs.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2"), "again")
        return materialize(inside.union(_held_by(runs.where("n = 1"), again, ["h1", "h2"]).select(*_SPAN.names)), "passage-spans", files)


def _keyed(docs: DataFrame, *keep: str) -> DataFrame:
    bytes_ = F.coalesce(utf8(), F.lit(b""))
    return docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(bytes_).alias("r1"), bytes_.alias("text"))


def _marked(docs: DataFrame, length: int, keep: list[str], words: int | None = None) -> DataFrame:
    """The kept columns with the text's bytes and its repeated spans (start and end bytes, as found)."""
    spans = find(docs, length)
    if words:
        spans = spans.union(find_passages(docs, words, length))
    spans = spans.groupBy("id", "r1").agg(F.collect_list(F.struct("s0", "s1")).alias("spans"))
    spans = materialize(spans, "spans", files_for(docs.select("text")))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"keep_{c}") for c in keep), "doc_id", "text")
    return _keyed(rows, *(f"keep_{c}" for c in keep)).join(spans.hint("merge"), ["id", "r1"], "left")


def cut_out(text: bytes, spans: list[dict] | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the text, and the removed runs in order."""
    runs: list[list[int]] = []
    for a, b in sorted((x["s0"], x["s1"] + length) for x in spans or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    edges = [0, *(e for r in runs for e in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), [(a, b) for a, b in runs]


def digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            texts = byte_lists(batch)
            left = [cut_out(t, s, length) for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            yield packed({
                "doc_id": batch.column("keep_doc_id"),
                "n_bytes": [len(t) for t in texts],
                "n_removed": [len(t) - len(k) for t, (k, _) in zip(texts, left, strict=True)],
                "n_spans": [len(r) for _, r in left],
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k, _ in left],
            }, schema)

    marked = _marked(docs.withColumn("doc_id", F.col("doc_id").cast("long")), length, ["doc_id"])
    return arrow_map(marked.select("keep_doc_id", "text", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int, words: int | None = None) -> DataFrame:
    """The documents with their repeated bytes taken out, all columns kept and n_chars (if any) counted anew.

    With `words`, repeated runs of so many words go too, however few bytes they have.
    A character that a cut splits goes as a whole. A document of which only white space is left goes; a document from
    which nothing was taken stays as it is, empty or null texts too.
    """
    columns = docs.columns
    marked = _marked(docs, length, columns, words)
    kept = [f"keep_{c}" for c in columns]
    schema = ", ".join(f"`keep_{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for batch in batches:
            spans, texts = batch.column("spans").to_pylist(), batch.column("keep_text").to_pylist()
            new = [t if not s else cut_out(b, s, length)[0].decode("utf-8", "ignore") for t, s, b in zip(texts, spans, byte_lists(batch), strict=True)]
            stay = pa.array([not s or bool(t.strip()) for t, s in zip(new, spans, strict=True)], pa.bool_())
            held = {n: batch.column(n) for n in kept}
            held["keep_text"] = pa.array(new, batch.schema.field("keep_text").type)
            if "keep_n_chars" in held:
                kind = batch.schema.field("keep_n_chars").type
                held["keep_n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, held["keep_n_chars"].to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays(list(held.values()), names=list(held)).filter(stay)

    done = arrow_map(marked.select(*kept, "text", "spans"), run, schema)
    return done.select(*(F.col(f"`keep_{c}`").alias(c) for c in columns))
