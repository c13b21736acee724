"""Near-duplicates by bottom-k MinHash sketches of one hash function.

A document's set holds its distinct word shingles (its whole sequence if it has fewer words); one hash orders them and
the k smallest are retained. Documents of equal sets form a class. An inverted list of retained values generates
overlaps: two sets that reach the threshold share at least t of their retained values but for a chance below 1e-9, so it
is enough to list a sketch's first |sketch| - t + 1 values in one common order (frequent values last, then by hash).
Within a list only pairs of a pivot and a member are generated. The sketch of the union of both estimates a pair and
drops hopeless ones; what is left is verified on full sets, recomputed from the texts. Components come from alternating
large and small stars. The first pivot of a list is the member whose values are the most frequent, the middle of its
group. Lists whose members aren't yet in one component go on with other pivots while that finds links and the lists are
crowded, and at last with the pairs between components, so no link is lost and members that are together cost nothing.

Two exact bounds keep that last step small. The full set is folded into BITS bits, each the parity of the shingles that
fall on it: two sets differ in as many shingles as their bits do, at least. And in crowded lists a member goes if the
shingles that it shares with no other member leave too few for the threshold.

Words are lower-cased (A-Z) runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
Null and empty texts, and texts without words, have empty sets and are linked with nothing. A row with a null id isn't
linked, is kept and has a null component. Rows that repeat an id are judged by each text; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.common import Scratch, arrow_map, broadcast_if_small, byte_lists, files_for, materialize, mix64, packed, remember, utf8

K = 64
#: A value in more sketches than this stands by its count, for at most so many of the most frequent values (24 bytes each
#: on the driver and in a task); the others come first, by hash. Any order is exact.
FREQUENT, MOST_FREQUENT = 8, 500_000
#: In lists of more members than this the shingles that a member has for itself bound its overlaps.
CROWDED = 24
#: Rounds with one pivot a list: so many in any case, and up to so many while the lists would make more than ROOM pairs
#: for each of their rows. Then the pairs between components are taken.
PIVOT_ROUNDS, MOST_ROUNDS, ROOM = 2, 3, 256
#: Parity bits of a full set, in 64-bit words.
BITS = 1024
_MEMO = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Words()


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > _MEMO:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    m = len(words) - size + 1
    s = np.full(m, size, np.uint64)
    odd = 0x9E3779B97F4A7C15
    for j in range(size):
        s = s * np.uint64(odd) + h[j : j + m]
    return np.unique(mix64(s))


def parity_bits(s: np.ndarray) -> np.ndarray:
    """BITS parities of a set's hashes as 64-bit words: the top bits of a hash say on which one it falls."""
    at = (s >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def differing_bits(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.bitwise_count(a ^ b).sum())


def shared_values(k: int, percent: int) -> int:
    """The most t for which fewer than t of k values agree with a chance below 1e-9 at the threshold."""
    p, tail = percent / 100, 0.0
    for t in range(k + 1):
        tail += comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail >= 1e-9:
            return max(1, t)
    return k


def prefix_length(n: int, k: int, percent: int) -> int:
    """Values of a sketch to list. A set so small that its partners' sketches are whole needs its exact overlap."""
    needed = ceil(n * percent / 100) if n * 100 < k * percent else shared_values(k, percent)
    return min(n, k) - min(needed, min(n, k)) + 1


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, th (64-bit hash of the text), n_shingles, fp (128-bit hash of the set; null if empty), the sketch (k 64-bit
    words) and the parity bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sketch", pa.binary()), ("bits", pa.list_(pa.int64()))])

    def run(batches):
        remember("shingles", _HASHES.clear)
        for batch in batches:
            sets = [shingle_set(t, size) for t in byte_lists(batch)]
            yield packed({
                "doc_id": batch.column("doc_id"),
                "th": batch.column("th"),
                "n_shingles": [len(s) for s in sets],
                "fp": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sketch": [s[:k].tobytes() for s in sets],
                "bits": [parity_bits(s).view(np.int64) if len(s) else None for s in sets],
            }, schema)

    rows = docs.select(F.col("doc_id").cast("long"), _text_hash().alias("th"), utf8().alias("text"))
    return arrow_map(rows, run, "doc_id long, th long, n_shingles long, fp binary, sketch binary, bits array<long>", "shingles")


def _text_hash():
    return F.xxhash64(utf8())


def _exploded(nodes: DataFrame, k: int, percent: int, often: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(v, node, n, common): all retained values, or with `often` (ascending values, counts) the ones to list when values
    stand by their counts. common says how frequent a sketch's values are on the whole: the middle of a group has most."""
    schema = pa.schema([("v", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("common", pa.int64())])
    shared = None if often is None else nodes.sparkSession.sparkContext.broadcast(often)  # at most MOST_FREQUENT rows

    def run(batches):
        for batch in batches:
            out, common, ids, sizes = [], [], batch.column("node").to_pylist(), batch.column("n").to_pylist()
            for raw, n in zip(batch.column("sketch").to_pylist(), sizes, strict=True):
                v, score = np.frombuffer(raw, np.uint64), 0
                if shared is not None and len(shared.value[0]):
                    values, counts = shared.value
                    at = np.minimum(np.searchsorted(values, v), len(values) - 1)
                    c = np.where(values[at] == v, counts[at], 0)
                    score = int(1000 * np.log2(1 + c).mean())
                    v = v[np.lexsort((v, c))]
                if shared is not None:
                    v = v[: prefix_length(n, k, percent)]
                out.append(v.view(np.int64))
                common.append(score)
            many = [len(v) for v in out]
            if sum(many):
                yield packed({"v": np.concatenate(out), "node": np.repeat(np.array(ids, np.int64), many), "n": np.repeat(np.array(sizes, np.int64), many), "common": np.repeat(np.array(common, np.int64), many)}, schema)

    return arrow_map(nodes.select("node", "n", "sketch"), run, "v long, node long, n long, common long")


def _texts_of(classes: DataFrame, sketched: DataFrame, docs: DataFrame, several: bool) -> DataFrame:
    """(node, text): a text of each node's set, as bytes. A repeated row, or one without words, may come beside it."""
    if not several:
        return docs.select(F.col("doc_id").cast("long").alias("node"), utf8().alias("text"))
    named = sketched.join(classes.select("fp", "id", "node"), "fp").where("doc_id = id")
    one = named.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("o")).select("node", F.col("o.doc_id").alias("i"), F.col("o.th").alias("h"))
    found = docs.select(F.col("doc_id").cast("long").alias("i"), _text_hash().alias("h"), utf8().alias("text"))
    return found.join(one, ["i", "h"]).select("node", "text")


def _own_shingles(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, own): how many of a member's shingles no other member of the given lists has. They are in no overlap."""
    texts = texts.join(broadcast_if_small(members, 1_000_000), "node", "left_semi")
    schema = pa.schema([("node", pa.int64()), ("v", pa.int64())])

    def run(batches):
        remember("shingles", _HASHES.clear)
        for batch in batches:
            sets = [shingle_set(t, size).view(np.int64) for t in byte_lists(batch)]
            many = [len(x) for x in sets]
            if sum(many):
                yield packed({"node": np.repeat(np.array(batch.column("node").to_pylist(), np.int64), many), "v": np.concatenate(sets)}, schema)

    held = arrow_map(texts.select("node", "text"), run, "node long, v long", "shingles").groupBy("v").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    return held.where("node = last").groupBy("node").agg(F.count("*").alias("own"))


def _estimated(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose union's sketch agrees in as many values as the threshold needs, and whose parity bits allow it."""
    needed = shared_values(k, percent)
    side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("sketch", "bits", "n")))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            bits = [batch.column(f"bits_{x}").flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64) for x in ("a", "b")]
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            near = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64) * (100 + percent) <= sizes * (100 - percent)
            for x, y, fits in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), near.tolist(), strict=True):
                if not fits:
                    keep.append(False)
                    continue
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([p, q]))
                same = both[1:] == both[:-1]
                distinct = np.concatenate([[True], ~same])
                union = int(distinct.sum())
                if len(p) < k and len(q) < k:  # whole sets
                    keep.append(100 * int(same.sum()) >= percent * union)
                else:
                    edge = both[distinct][min(k, union) - 1]
                    keep.append(int((both[:-1][same] <= edge).sum()) >= needed - (k - min(k, union)))
            yield packed({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")}, schema)

    return arrow_map(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", *(f"{c}_{x}" for c in ("sketch", "bits", "n") for x in ("a", "b"))), run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    needed = broadcast_if_small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 1_000_000)
    texts = texts.join(needed, "node", "left_semi")
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        remember("shingles", _HASHES.clear)
        last, held = None, None
        for batch in batches:
            keep = []
            for x, y in zip(byte_lists(batch, "ta"), byte_lists(batch, "tb"), strict=True):
                if x != last:
                    last, held = x, shingle_set(x, size)
                other = shingle_set(y, size)
                inter = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(inter > 0 and 100 * inter >= percent * (len(held) + len(other) - inter))
            yield packed({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")}, schema)

    return arrow_map(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb"), run, "a long, b long", "shingles")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every linked node: root is the smallest node reachable. Alternating large and small stars."""
    if scratch is None:
        with Scratch(links.sparkSession) as own:
            return materialize(components(links, own), "components")

    def state(df):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = scratch.save(small.where("u <> v").distinct(), "edges")
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def _classes(sketched: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(fp, id, node, n, sketch, bits) of the distinct sets, and whether an id stands for several of them.

    id is the smallest doc_id of the class, and so is its node, but where classes share it all but one have a hash for it.
    """
    found = sketched.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
    found = scratch.save(found, "found")
    several = scratch.save(found.groupBy("id").agg(F.min("fp").alias("one"), F.count("*").alias("_c")).where("_c > 1").select("id", "one"), "several")
    if several.isEmpty():
        return found.withColumn("node", F.col("id")), False
    node = F.when(F.col("one").isNull() | (F.col("one") == F.col("fp")), F.col("id")).otherwise(F.xxhash64("fp"))
    return scratch.save(found.join(broadcast_if_small(several, 1_000_000), "id", "left").withColumn("node", node).drop("one"), "table"), True


def _lists(nodes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(v, node, n, common): the inverted lists of two members or more.

    Here and below, what is found for each list is written before it is joined with the lists: both sides of the join are
    then plain shuffles, and Spark can split a list that holds a third of all rows over many tasks.
    """
    counted = _exploded(nodes, k, percent, None).groupBy("v").count().where(F.col("count") > FREQUENT)
    top = counted.orderBy(F.desc("count"), "v").limit(MOST_FREQUENT).toPandas()
    values, counts = top["v"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(values)
    listed = _exploded(nodes, k, percent, (values[order], counts[order]))
    shared = scratch.save(listed.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v"), "shared")
    return scratch.save(listed.join(shared, "v"), "table")


def _near(percent: int):
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("a") != F.col("b"))


def _with_pivots(member: DataFrame, turn: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): every member of a list with the list's pivot of this turn, unless they are in one component."""
    lead = F.lit(0) if turn else -F.col("common")
    order = F.struct(lead.alias("l"), F.xxhash64("b", F.lit(turn)).alias("o"), F.col("b").alias("a"), F.col("nb").alias("na"), F.col("root").alias("ra"))
    pivot = scratch.save(member.groupBy("v").agg(F.min(order).alias("p")).select("v", "p.a", "p.na", "p.ra"), "pivots")
    return member.join(pivot, "v").where(_near(percent) & (F.col("ra") != F.col("root"))).select("a", "b").distinct()


def _between_components(member: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): the pairs of each list that are in different components and that both exact bounds allow.

    In a list the members of its largest component meet only those outside of it, and a pair counts in the first of its
    lists alone.
    """
    crowd = scratch.save(member.where(F.col("size") > CROWDED).select(F.col("b").alias("node")).distinct(), "crowd")
    own = scratch.save(_own_shingles(crowd, texts, size), "own")
    held = member.join(own.select(F.col("node").alias("b"), "own"), "b", "left").withColumn("ob", F.when(F.col("size") > CROWDED, F.coalesce("own", F.lit(0))).otherwise(0))
    # A member whose own shingles alone keep it from the threshold has no partner, however small that is.
    held = held.where((F.col("nb") - F.col("ob")) * 100 >= F.col("nb") * percent).select("v", "b", "nb", "ob", "root")
    bits = classes.select(F.col("node").alias("b"), *(F.col("bits")[j].alias(f"q{j}") for j in range(BITS // 64)))
    held = scratch.save(held, "held")
    into = held.groupBy("b").agg(F.collect_set("v").alias("vb"))  # at most a sketch's values
    held = scratch.save(held.join(into, "b").join(bits, "b"), "held")
    sizes = held.groupBy("v", "root").agg(F.count("*").alias("c"))
    largest = scratch.save(sizes.groupBy("v").agg(F.max(F.struct("c", "root")).alias("l")).select("v", F.col("l.root").alias("largest")), "largest")
    outside = scratch.save(held.join(largest, "v").where("root <> largest"), "outside")
    other = outside.select("v", "largest", F.col("b").alias("a"), F.col("nb").alias("na"), F.col("ob").alias("oa"), F.col("root").alias("ra"), F.col("vb").alias("va"), *(F.col(f"q{j}").alias(f"p{j}") for j in range(BITS // 64)))
    once = (F.col("ra") != F.col("root")) & ((F.col("root") == F.col("largest")) | (F.col("a") < F.col("b")))
    most = F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob"))  # of the overlap
    reach = most * 100 >= (F.col("na") + F.col("nb") - most) * percent
    apart = sum((F.bit_count(F.col(f"p{j}").bitwiseXOR(F.col(f"q{j}"))) for j in range(1, BITS // 64)), F.bit_count(F.col("p0").bitwiseXOR(F.col("q0"))))
    close = apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    first = F.array_min(F.array_intersect("va", "vb")) == F.col("v")
    return held.join(other, "v").where(_near(percent) & once & reach & close & first).select("a", "b")


def _linked(docs: DataFrame, size: int, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """doc_id, th, fp, n_shingles, node (of the row's class) and root (of its component; both null if it has none), and
    component_id of every row."""
    texts = docs.select("doc_id", "text")
    sketched = scratch.save(sketches(texts, size, k), "sketched")
    classes, several = _classes(sketched, scratch)
    nodes = classes.select("node", "n", "sketch", "bits")
    lists = _lists(nodes, k, percent, scratch)
    of_node = _texts_of(classes, sketched, texts, several)
    links = tried = root = None
    turn, last = 0, False
    while not last:
        member = lists.select("v", F.col("node").alias("b"), F.col("n").alias("nb"), "common")
        if root is None:
            member = member.withColumns({"root": F.col("b"), "size": F.lit(0).cast("long")})
        else:
            member = member.join(root.select(F.col("node").alias("b"), "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
            open_ = member.groupBy("v").agg(F.min("root").alias("_l"), F.max("root").alias("_h"), F.count("*").alias("size")).where("_l <> _h").select("v", "size")
            open_ = scratch.save(open_, "open-lists")
            member = scratch.save(member.join(open_, "v"), "member")
            rows, meetings = member.agg(F.count("*"), F.coalesce(F.sum(F.col("size").cast("double")), F.lit(0.0))).first()
            if not rows:
                break
            last = turn >= PIVOT_ROUNDS and (meetings <= ROOM * rows or turn >= MOST_ROUNDS or none_new)
        pairs = _between_components(member, classes, of_node, size, percent, scratch) if last else _with_pivots(member, turn, percent, scratch)
        if tried is not None:
            swapped = tried.select(F.col("b").alias("a"), F.col("a").alias("b"))
            pairs = pairs.join(tried.union(swapped), ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        likely = scratch.save(_estimated(pairs, nodes, k, percent), "likely")
        found = scratch.save(_verified(likely, of_node, size, percent), "links")
        links = found if links is None else links.union(found)
        scratch.release()
        none_new = found.isEmpty()
        if root is None or not none_new:
            root = components(links, scratch)
        turn += 1
    named = classes.select("fp", "id", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if several:  # a root may be a hash, or the least node without the least id
        named = scratch.save(named, "named")
        named = named.join(named.groupBy("root").agg(F.min("id").alias("component")), "root")
    else:
        named = named.withColumn("component", F.col("root"))
    rows = sketched.select("doc_id", "th", "n_shingles", "fp").join(named.select("fp", "node", "root", "component"), "fp", "left")
    of_row = F.col("doc_id").isNotNull()
    return rows.select("doc_id", "th", "fp", "n_shingles", F.when(of_row, F.col("node")).alias("node"), F.when(of_row, F.col("root")).alias("root"), F.when(of_row, F.coalesce("component", "doc_id")).alias("component_id"))


def link(docs: DataFrame, size: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    files = files_for(docs.select("doc_id", "text"))
    with Scratch(docs.sparkSession, files) as scratch:
        rows = _linked(docs, size, percent, k, scratch)
        kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
        return materialize(rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept")), "near-duplicates", files)


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One document of each component, with all columns: of the smallest id, then of the smallest hash of its set, of its
    text and of its row. What is in no component (null ids, texts without words) stays as it is.

    Rows that repeat an id with texts that aren't linked are in different components, and each stays.
    """
    files = files_for(docs.select("doc_id", "text"))
    with Scratch(docs.sparkSession, files) as scratch:
        rows = _linked(docs, size, percent, k, scratch).where("root is not null")
        first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "th")).alias("f")).select("f.*")
        again = rows.groupBy("doc_id", "fp", "th").agg(F.count("*").alias("__nd_rows"))
        first = materialize(first.join(again, ["doc_id", "fp", "th"]).select(F.col("doc_id").alias("__nd_id"), F.col("th").alias("__nd_th"), "__nd_rows"), "first", files)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    free = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    mine = (F.col("doc_id").cast("long") == F.col("__nd_id")) & (_text_hash() == F.col("__nd_th"))
    kept = docs.join(broadcast_if_small(first.where("__nd_rows = 1"), 1_000_000), mine, "left_semi").select(*columns)
    if not first.where("__nd_rows > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("__nd_id", "__nd_th").orderBy(F.xxhash64(*columns)))
        kept = kept.unionByName(docs.join(first.where("__nd_rows > 1"), mine).withColumn("__nd_place", place).where("__nd_place = 1").select(*columns))
    return kept.unionByName(free)


#: DuckDB SQL for link() on shingles of 3 words at 85 percent. Pairs come from shared shingles of distinct sets.
ORACLE = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, doc_id, case when len(w) = 0 then [] else list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda k: array_to_string(w[k : k + 2], ' ')))) end as s from d),
c as (select s, min(doc_id) as node, len(s) as n from s where len(s) > 0 group by s),
e as (select node, n, unnest(s) as x from c),
p as (select a.node as a, b.node as b from e a join e b on a.x = b.x and a.node < b.node and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      group by a.node, b.node, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l as (select a, b from p union all select b, a from p),
t as (select node as a, node as b from c union select t.a, l.b from t join l on t.b = l.a),
m as (select a as node, min(b) as root from t group by a)
select doc_id, len(s.s)::bigint as n_shingles, coalesce(root, doc_id) as component_id, doc_id = coalesce(root, doc_id) as kept
from s left join c on s.s = c.s left join m using (node)
"""
