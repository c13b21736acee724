"""Exact top-k inner products over integer vectors: norm order, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become floor(scale * x). One pass sums the Gram matrix of all of a dimension; its eigenvectors are the right
singular vectors, and in that rotation the first coordinates carry most of every product. Candidates are dealt by ranges
of their length and packed into tiles in descending order. A first round meets every query with the longest candidates,
which gives it a lower bound of its k-th score, and with it the length below which no candidate can help. Queries are
packed into tiles by that length, so whole pairs of tiles go by Cauchy-Schwarz before any vector is shuffled. In the
pairs that are left candidates are walked by descending length, block by block, while the bounds rise: the rotated
products are summed in slices of coordinates, and after each slice a candidate goes if for every query the partial sum
plus |rest of q| |rest of c| stays below the bound. What is left is multiplied out in integers, so scores and ties are
exact; the float bounds are widened by more than their rounding.

Vectors that are null, or hold a null or non-finite component, take no part. Products are taken between vectors of equal
dimension. The rotations of the ROTATED most common dimensions are kept on the driver; vectors of the others are summed
unrotated. Integers of any size are exact; a score that a long can't hold is an error if it belongs to the result.
Repeated rows are candidates each on their own, and of a query's own id none is returned. Fewer candidates than k give
fewer rows; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.common import Scratch, arrow_map, materialize, packed

#: Bytes of a tile of candidates and of queries at most, and how many tiles there are at least if there are rows for them.
CANDIDATE_BYTES, QUERY_BYTES, TILES = 4 << 20, 1 << 20, 48
#: Rows of a block of candidates and of queries that are multiplied at once; rows of candidates that give first bounds.
CANDIDATES, QUERIES, SEEDS = 2048, 512, 4096
SLICES, ROTATED = 4, 4
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(id, x array<double>, d) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x")).where("id is not null and x is not null")
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False)) & (F.size("x") > 0)).withColumn("d", F.size("x"))


def _matrix(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    """The floored vectors of a batch of one dimension; integers as doubles, which hold them exactly."""
    x = batch.column("x")
    with np.errstate(over="ignore"):
        m = np.floor(x.flatten().to_numpy() * scale).reshape(len(x), -1)
    if not np.isfinite(m).all():
        raise ArithmeticError("a scaled component leaves the range of doubles")
    return m


def rotations(rows: DataFrame, dims: list[int], scale: int) -> dict[int, np.ndarray]:
    """For each of the dimensions the right singular vectors of all its rows, by falling singular value, from Gram matrices
    summed by task."""
    out = {}
    for dim in dims:
        schema = pa.schema([("i", pa.int32()), ("g", pa.list_(pa.float64()))])

        def run(batches, dim=dim, schema=schema):
            g = np.zeros((dim, dim))
            for batch in batches:
                m = _matrix(batch, scale)
                g += m.T @ m
            yield packed({"i": np.arange(dim, dtype=np.int32), "g": list(g)}, schema)

        sums = F.array(*(F.sum(F.col("g")[k]) for k in range(dim)))
        found = arrow_map(rows.where(F.col("d") == dim).select("x"), run, "i int, g array<double>").groupBy("i").agg(sums.alias("g")).toPandas().sort_values("i")
        gram = np.array(found["g"].tolist()).reshape(-1, dim)
        if len(gram) and np.isfinite(gram).all():
            out[dim] = np.linalg.eigh(gram)[1][:, ::-1].copy()
    return out


_TILE = pa.schema([("tile", pa.int64()), ("d", pa.int32()), ("longest", pa.float64()), ("need", pa.float64()), ("ids", pa.binary()), ("data", pa.binary()), ("bounds", pa.binary())])
_TILE_SQL = "tile long, d int, longest double, need double, ids binary, data binary, bounds binary"


def _bytes(m: np.ndarray) -> bytes:
    """Integers as 32-bit words if they fit, else as doubles."""
    return m.astype("<i4" if not m.size or np.abs(m).max() < 1 << 31 else "<f8").tobytes()


def _vectors(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * n * dim else "<f8").astype(float).reshape(n, dim)


def _tiles(rows: DataFrame, scale: int, most_bytes: int, most_rows: int) -> DataFrame:
    """Tiles of the rows, which come sorted by dimension: ids, vectors, bounds (if the rows have them), the greatest length
    in the tile and the least length that one of its queries needs."""
    bounded = "bound" in rows.columns

    def run(batches):
        part, k, held, dim, n = TaskContext.get().partitionId(), 0, [], None, 0

        def tile(parts, k):
            ids, m, b = (np.concatenate([p[j] for p in parts]) for j in range(3))
            length = np.sqrt((m**2).sum(1))
            need = np.where((length > 0) & (b > 0), b / np.maximum(length, 1e-300), 0.0)
            return packed({"tile": [part * (1 << 32) + k], "d": [m.shape[1]], "longest": [float(length.max())], "need": [float(need.min())], "ids": [ids.astype("<i8").tobytes()], "data": [_bytes(m)], "bounds": [b.astype("<f8").tobytes()]}, _TILE)

        for batch in batches:
            dims = batch.column("d").to_numpy()
            for a, b in zip(*_runs(dims), strict=True):
                some = batch.slice(a, b - a)
                if held and (dim != dims[a]):
                    yield tile(held, k)
                    held, n, k = [], 0, k + 1
                dim = int(dims[a])
                size = max(1, min(most_rows, most_bytes // (8 * dim)))
                known = some.column("bound").to_numpy(zero_copy_only=False).astype(float) if bounded else np.full(b - a, -np.inf)
                held.append((some.column("id").to_numpy(), _matrix(some, scale), np.where(np.isnan(known), -np.inf, known)))
                n += b - a
                while n >= size:
                    parts = [np.concatenate([p[j] for p in held]) for j in range(3)]
                    yield tile([[p[:size] for p in parts]], k)
                    held, n, k = [tuple(p[size:] for p in parts)] if n > size else [], n - size, k + 1
        if held:
            yield tile(held, k)

    return arrow_map(rows.select("id", "x", "d", *(["bound"] if bounded else [])), run, _TILE_SQL)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return (np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])) if len(values) else (cut, cut)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of integers, as longs; what is below all longs is the least one."""
    if len(q) and np.abs(q).max() * np.abs(c).max() * q.shape[1] < 1 << 53:  # every partial sum is an exact double
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q.tolist(), c.tolist(), strict=True)]
    if any(s > _MOST for s in out):
        raise ArithmeticError("an inner product among the best exceeds the range of long")
    return np.array([max(s, _LEAST) for s in out], np.int64)


class Best:
    """The k best (query row, id, score) so far, and with them rising bounds."""

    def __init__(self, bounds: np.ndarray, k: int):
        self.bounds, self.k = bounds.copy(), k
        self.row, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        row, ids, score = np.concatenate([self.row, row]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, ~score, row))  # ~s falls as s grows, without the overflow of -s
        row = row[order]
        first = np.searchsorted(row, np.arange(len(self.bounds)))
        place = np.arange(len(row)) - first[row]
        top = order[place < self.k]
        self.row, self.id, self.score = row[place < self.k], ids[top], score[top]
        full = place == self.k - 1
        self.bounds[row[full]] = np.maximum(self.bounds[row[full]], score[order[full]])


def _rests(r: np.ndarray) -> np.ndarray:
    """Length of what is left of each row from each coordinate on."""
    return np.sqrt(np.maximum(0, np.cumsum((r**2)[:, ::-1], 1)[:, ::-1]))


def meet(best: Best, qi, q, ci, c, basis, at: int = 0) -> None:
    """Add the candidates (by descending length) that reach the bounds of the queries, rows `at` and on of best."""
    dim = q.shape[1]
    edges = np.unique(np.linspace(0, dim, SLICES + 1).astype(int))
    rq, rc = (q, c) if basis is None else (q @ basis, c @ basis)
    rest_q, rest_c = _rests(rq), _rests(rc)
    for start in range(0, len(c), CANDIDATES):
        block, long = slice(start, start + CANDIDATES), rest_c[start : start + CANDIDATES]
        longest = long[:, 0].max()
        bound = best.bounds[at : at + len(q)]
        slack = 1e-9 * (1 + rest_q[:, 0] * longest)
        live = np.flatnonzero(rest_q[:, 0] * longest + slack >= bound)
        if not len(live):
            continue
        need, open_, partial, rb = (bound - slack)[live, None], np.arange(len(long)), None, rc[block]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            step = rq[live, a:b] @ rb[open_, a:b].T
            partial = step if partial is None else partial + step
            if b < dim:
                keep = (partial + rest_q[live, b, None] * long[open_, b] >= need).any(0)
                open_, partial = open_[keep], partial[:, keep]
        j, x = np.nonzero(partial >= need)
        j, x = live[j], start + open_[x]
        other = ci[x] != qi[j]
        j, x = j[other], x[other]
        for some in np.array_split(np.arange(len(j)), len(j) // 65536 + 1):
            best.add(at + j[some], ci[x[some]], exact(q[j[some]], c[x[some]]))


_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("d", pa.int32()), ("row", pa.int32()), ("tile", pa.int64())])
_HIT_SQL = "query_id long, vec_id long, score long, d int, row int, tile long"


def _met(pairs: DataFrame, shared, k: int) -> DataFrame:
    """The k best of each pair of tiles for each of its queries. Pairs come sorted by the candidates' tile."""

    def run(batches):
        held = None
        for batch in batches:
            for r in batch.to_pylist():
                if held is None or held[0] != r["tile"]:
                    ci = np.frombuffer(r["ids"], "<i8")
                    held = (r["tile"], ci, _vectors(r["data"], len(ci), r["d"]))
                qi = np.frombuffer(r["qids"], "<i8")
                q, best = _vectors(r["qdata"], len(qi), r["d"]), Best(np.frombuffer(r["qbounds"], "<f8"), k)
                for a in range(0, len(q), QUERIES):
                    meet(best, qi[a : a + QUERIES], q[a : a + QUERIES], held[1], held[2], shared.value.get(r["d"]), a)
                n = len(best.row)
                yield packed({"query_id": qi[best.row], "vec_id": best.id, "score": best.score, "d": np.full(n, r["d"], np.int32), "row": best.row, "tile": np.full(n, r["qtile"])}, _HIT)

    return arrow_map(pairs.select("tile", "d", "ids", "data", "qtile", "qids", "qdata", "qbounds"), run, _HIT_SQL)


def _as_queries(tiles: DataFrame) -> DataFrame:
    return tiles.select(F.col("tile").alias("qtile"), "d", "need", F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.col("bounds").alias("qbounds"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k greatest inner products, ties to the smaller id."""
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        rows = usable(vectors)
        counts = rows.groupBy("d").agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q"))
        common = counts.orderBy(F.desc("n"), "d").limit(ROTATED).collect()
        total, asked = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("q"), F.lit(0))).first()
        shared = spark.sparkContext.broadcast(rotations(rows, [r.d for r in common], scale))  # ROTATED matrices
        some, few = max(1, -(-total // TILES)), max(1, -(-asked // TILES))
        length = F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e)
        parts = max(1, -(-total // some))
        dealt = rows.withColumn("l", length).repartitionByRange(parts, "d", F.col("l").desc(), "id").sortWithinPartitions("d", F.col("l").desc(), "id")
        candidates = scratch.save(_tiles(dealt, scale, CANDIDATE_BYTES, some), "topk-candidates")

        # Round 1: each query against the longest candidates of its dimension.
        top = candidates.groupBy("d").agg(F.max_by("tile", F.struct("longest", -F.col("tile"))).alias("tile")).select("tile")
        head = _heads(candidates.join(top, "tile"), SEEDS)
        wide = max(1, -(-asked // few))
        asking = scratch.save(_tiles(rows.where(is_query).repartition(wide, "id").sortWithinPartitions("d"), scale, QUERY_BYTES, few), "topk-queries")
        seeded = scratch.save(_met(_as_queries(asking).join(head, "d").repartition(wide, "qtile").sortWithinPartitions("tile"), shared, k), "topk-seeds")
        # A query row's k-th score; rows that repeat an id take the least of theirs, which bounds each.
        kth = seeded.groupBy("d", "query_id", "tile", "row").agg(F.count("*").alias("n"), F.min("score").alias("s"))
        bound = kth.groupBy("d", "query_id").agg(F.min(F.when(F.col("n") >= k, F.col("s"))).alias("bound"), F.min("n").alias("n")).where(F.col("n") >= k)
        bound = bound.select(F.col("d").alias("bd"), F.col("query_id").alias("bid"), F.col("bound").cast("double").alias("bound"))

        # Round 2: pairs of tiles that the lengths allow, named by small rows before any vector moves.
        known = rows.where(is_query).join(bound, (F.col("id") == F.col("bid")) & (F.col("d") == F.col("bd")), "left").withColumn("need", F.coalesce(F.col("bound") / F.sqrt(length), F.lit(0.0)))
        ready = known.repartitionByRange(wide, "d", F.col("need").desc(), "id").sortWithinPartitions("d", F.col("need").desc(), "id")
        ready = scratch.save(_as_queries(_tiles(ready.select("id", "x", "d", "bound"), scale, QUERY_BYTES, few)), "topk-ready")
        named = ready.select("qtile", "d", "need").join(candidates.select("tile", "d", "longest"), "d").where(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("need")).select("qtile", "tile")
        pairs = scratch.save(named, "topk-pairs")
        asked_by = pairs.join(ready.drop("d", "need"), "qtile").repartition(2 * parts, "tile")
        found = _met(asked_by.join(candidates, "tile").sortWithinPartitions("tile"), shared, k)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        score = F.when(F.col("score") == _LEAST, F.raise_error(F.lit("an inner product of the result is below the range of long"))).otherwise(F.col("score"))
        return materialize(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.cast("long").alias("score")), "topk")


def _heads(tiles: DataFrame, most: int) -> DataFrame:
    """The first rows of each tile."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["ids"]) // 8
                width = len(r["data"]) // max(1, n)
                yield packed({"tile": [r["tile"]], "d": [r["d"]], "ids": [r["ids"][: 8 * most]], "data": [r["data"][: width * most]]}, pa.schema([_TILE.field(x) for x in ("tile", "d", "ids", "data")]))

    return arrow_map(tiles.select("tile", "d", "ids", "data"), run, "tile long, d int, ids binary, data binary")


#: DuckDB SQL for search() with 20 neighbours of the ids divisible by 20, at a scale of 64.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda e: floor(64 * e::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
      from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 20
"""
