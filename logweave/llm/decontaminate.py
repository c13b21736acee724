"""Benchmark decontamination by a prefix-filtered set join with exact verification over item-sized windows.

A window is `size` consecutive words of an item, or a shorter item as a whole. A document that holds a window holds all
its words, so one necessary prefix token is enough to find it: the window's rarest word by the number of documents it
is in. Each place of that word gives the one position where the window could lie; length and positional bounds drop
what would leave the document, then the other words are compared from rare to common until all have matched.

Words are lower-cased (A-Z) runs of digits, a-z and anything beyond ASCII. Null and empty texts have no words. Items
with a null id are left out; repeated items count once. Duplicate documents are judged each on its own. A benchmark
without words marks nothing; an empty table of documents gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import arrow_map, byte_lists, packed, utf8

_WORD = bytearray(b" " * 256)
_WORD[0x80:] = range(0x80, 0x100)
for _a, _b in (("0", "9"), ("a", "z")):
    _WORD[ord(_a) : ord(_b) + 1] = range(ord(_a), ord(_b) + 1)
_WORD[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
_WORD = bytes(_WORD)
#: Bytes of item text in an index, which takes some 20 times as much in memory; a larger benchmark is matched index by index.
INDEX_BYTES = 4 << 20
#: Places of windows that are compared at once.
PLACES = 1 << 19


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Index:
    """The windows of some items, reachable by their rarest word."""

    def __init__(self, items: list[tuple[int, list[bytes]]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        found, owners = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int64)]
        for item, ws in items:
            ids = np.array([number(w) for w in ws], np.int32)
            if len(ids):
                short = np.concatenate([ids, np.full(max(0, size - len(ids)), -1, np.int32)])
                found.append(np.lib.stride_tricks.sliding_window_view(short, size))
                owners.append(np.full(len(found[-1]), item, np.int64))
        self.windows, of = np.unique(np.concatenate(found), axis=0, return_inverse=True)
        self.lengths = (self.windows >= 0).sum(1)
        pairs = np.unique(np.stack([of.reshape(-1), np.concatenate(owners)], 1), axis=0)
        self.owners, self.begin = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))

    def items(self, windows: np.ndarray) -> set[int]:
        """The items that hold one of the windows."""
        return {i for w in windows.tolist() for i in self.owners[self.begin[w] : self.begin[w + 1]].tolist()}

    def rank(self, frequency: np.ndarray) -> None:
        """frequency: by word id, the documents that hold it. Sets each window's order of comparison and the prefix lists."""
        words = np.maximum(self.windows, 0).astype(np.int64)
        key = np.where(self.windows >= 0, frequency[words] * np.int64(len(frequency) + 1) + words, np.iinfo(np.int64).max) if len(frequency) else words
        self.order = np.argsort(key, axis=1, kind="stable").astype(np.int32)
        prefix = self.windows[np.arange(len(self.windows)), self.order[:, 0]] if len(self.windows) else np.zeros(0, np.int64)
        self.by_prefix = np.argsort(prefix, kind="stable")
        self.first = np.searchsorted(prefix[self.by_prefix], np.arange(len(frequency) + 1))

    def match(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every window in a document's words."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        at = np.flatnonzero(ids >= 0)
        many = self.first[ids[at] + 1] - self.first[ids[at]]
        at, many = at[many > 0], many[many > 0]
        parts = np.cumsum(many) // PLACES
        found = [self._compared(ids, at[parts == k], many[parts == k]) for k in np.unique(parts)]
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def _compared(self, ids: np.ndarray, at: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that lie round the given places, each the place of so many windows' rarest word."""
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        window = self.by_prefix[np.repeat(self.first[ids[at]], many) + within]
        start = np.repeat(at, many) - self.order[window, 0]
        fits = (start >= 0) & (start + self.lengths[window] <= len(ids))
        window, start = window[fits], start[fits]
        for k in range(self.windows.shape[1]):
            if not len(window):
                break
            column = self.order[window, k]
            same = (k >= self.lengths[window]) | (ids[np.minimum(start + column, len(ids) - 1)] == self.windows[window, column])
            window, start = window[same], start[same]
        return window, start


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Over all documents, how many hold each word of the vocabulary."""
    schema = pa.schema([("word", pa.int64()), ("docs", pa.int64())])
    known = frozenset(vocabulary)

    def run(batches):
        seen = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in byte_lists(batch):
                seen[[vocabulary[w] for w in known.intersection(words(text))]] += 1
        at = np.flatnonzero(seen)
        yield packed({"word": at, "docs": seen[at]}, schema)

    counted = arrow_map(docs.select(utf8().alias("text")), run, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    out[counted["word"].to_numpy(np.int64)] = counted["docs"].to_numpy(np.int64)
    return out


def indexes(docs: DataFrame, benchmark: DataFrame, size: int, index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """One index for each `index_bytes` of item text, so that what the driver holds and a task gets is bounded."""

    def made(batch):
        index = Index(batch, size)
        index.rank(frequencies(docs, index.vocabulary) if index.vocabulary else np.zeros(0, np.int64))
        return index

    batch, held = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), utf8().alias("text")).distinct()
    for item, text in rows.toLocalIterator():
        batch.append((item, words(bytes(text))))
        held += len(text)
        if held >= index_bytes:
            yield made(batch)
            batch, held = [], 0
    yield made(batch)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, keep: list[str] | None = None, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The kept columns of every document (doc_id unless named), with n_words, spans and items.

    spans: words [start, end) that are inside an occurring window, merged and in order; items: the ids whose windows
    occur, ascending. Each index is one pass over the rows; one is enough up to `index_bytes` of item text.
    """
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    own = [f for f in docs.schema if f.name in keep]
    schema = ", ".join([*(f"`keep_{f.name}` {f.dataType.simpleString()}" for f in own), "__bytes binary, __n long, __spans array<long>, __items array<long>"])
    extra = pa.schema([("__bytes", pa.binary()), ("__n", pa.int64()), ("__spans", pa.list_(pa.int64())), ("__items", pa.list_(pa.int64()))])
    empty = F.array().cast("array<long>")
    out = docs.select(*(F.col(f"`{f.name}`").alias(f"keep_{f.name}") for f in own), utf8().alias("__bytes"), F.lit(0).cast("long").alias("__n"), empty.alias("__spans"), empty.alias("__items"))
    found = indexes(docs, benchmark, size, index_bytes)
    index = next(found)
    while index is not None:
        shared, index = spark.sparkContext.broadcast(index), next(found, None)  # of at most index_bytes of item text

        def run(batches, shared=shared, last=index is None):
            index = shared.value
            for batch in batches:
                n, spans, items = [], batch.column("__spans").to_pylist(), batch.column("__items").to_pylist()
                texts = byte_lists(batch, "__bytes")
                for j, text in enumerate(texts):
                    ws = words(text)
                    n.append(len(ws))
                    window, start = index.match(ws)
                    if len(window):
                        items[j] = sorted({*items[j], *index.items(np.unique(window))})
                        spans[j] = merged(spans[j], start, start + index.lengths[window])
                columns = [batch.column(f"keep_{f.name}") for f in own] + [pa.array([None] * len(texts) if last else texts, pa.binary()), pa.array(n, pa.int64()), pa.array(spans, extra.field(2).type), pa.array(items, extra.field(3).type)]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"keep_{f.name}" for f in own), *extra.names])

        out = arrow_map(out, run, schema)
    return out.select(*(F.col(f"`keep_{f.name}`").alias(f.name) for f in own), F.col("__n").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def merged(flat: list[int], starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Union of the flat list's [start, end) pairs and the given ones, as a flat ascending list."""
    edges = sorted([*zip(flat[::2], flat[1::2], strict=True), *zip(starts.tolist(), ends.tolist(), strict=True)])
    out: list[int] = []
    for a, b in edges:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def digests(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    found = contamination(docs, benchmark, size)
    hit = F.aggregate(F.transform("spans", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    names = [f"_{k}" for k in range(len(docs.columns))]  # free of clashes with the findings' names
    clean = contamination(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), "text"), benchmark, size, names)
    return clean.where(F.size("spans") == 0).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


#: DuckDB SQL for digests() at size 10: every window of every item against every run of as many document words.
ORACLE = r"""
with a as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
           from benchmark where item_id is not null and text is not null),
p as (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from a where len(w) > 0),
q as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') as s from p),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
e as (select r, w, unnest(range(1, len(w) + 1)) as k from d),
f as (select r, k, n, array_to_string(w[k : k + n - 1], ' ') as s from e, (select distinct n from q) where k + n - 1 <= len(w)),
h as (select r, k, q.n, item_id from f join q on f.n = q.n and f.s = q.s),
c as (select r, count(distinct x) as n_hit from (select r, unnest(range(k, k + n)) as x from h) group by r),
i as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as l from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (r) left join i using (r)
"""
