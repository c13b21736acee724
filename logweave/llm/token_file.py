"""Token ids as Parquet: list columns under a dictionary, ids and offsets delta-coded, small pages with page indexes.

Documents are dealt out by ranges of doc_id and sorted inside each range, so the files, their row groups and their
pages stand in ascending doc_id order: a range of ids touches few pages, and metadata columns are read without the
tokens. Rows of equal doc_id are ordered by their text; a null doc_id comes first; a null text is an empty one, whose
tokens are the end id alone. Extra columns are ignored. An empty table gives an empty file set.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logweave.llm.common import arrow_map, broadcast_if_small, packed, remember, shared_dir

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
#: Parts, and characters of them, that a worker remembers with their ids before it starts anew; bounds its memory.
MEMO, MEMO_CHARACTERS = 800_000, 16_000_000


def writer_options(row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 512) -> dict[str, str]:
    """Version 2 pages; tokens by dictionary, the sorted or increasing columns by delta; page indexes come with every file."""
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part_start", "n_tokens")}
    return plain | {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }


#: The pre-tokens of lower-cased Latin-1 text: elisions, runs of letters, single digits, runs of other marks.
_LETTERS, _NUMBERS, _SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


class _Numbers(dict):
    """Numbers of parts in the order in which they are first asked for; the new ones are listed."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = k = len(self)
        self.new.append(part)
        return k


class Encoder:
    """Ids of whole texts from the tokenizers library, put together from the ids of their parts, which are remembered: each
    part has a number, and by it a place in one array of ids.

    A word vocabulary turns white space to a space that its pre-tokenizer drops, and nothing looks across it, so the ids
    of a text are those of its chunks between spaces and line feeds, in order. Latin-1 text needs no normalisation but
    lower case, and its pre-tokens are found by one pattern, so it is cut into those; the library encodes either. Text
    with the start of a special token is cut into chunks only.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pattern = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex", "")
        #: Whether the vocabulary is of the kind that is cut into pre-tokens, or into chunks at least.
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        #: By id, whether a token ends a pre-token.
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[k for name, k in vocabulary.items() if suffix and name.endswith(suffix)]] = True
        self.memo = memo
        self.forget()

    def forget(self) -> None:
        self.known, self.held = _Numbers(), 0
        self.ends, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # of part k the ids from ends[k] to ends[k + 1]

    def cut(self, text: str) -> tuple[list[str], bool]:
        """The parts of a text, and whether they are pre-tokens."""
        if not self.by_word:
            return [text], False
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return _LATIN.findall(text.lower()), True
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" "), False

    def _ids(self, new: list[str], pre_tokens: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, and how many each has. Pre-tokens are encoded many at a time, and told apart by the ids that end one."""
        if pre_tokens:
            joined = self.tokenizer.encode_batch_fast([" ".join(new[k : k + 500]) for k in range(0, len(new), 500)], add_special_tokens=False)
            ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in joined)])
            edges = np.flatnonzero(self.last[ids]) + 1
            if len(edges) == len(new):
                return ids, np.diff(edges, prepend=0)
        each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)

    def _learn(self, pre_tokens: bool) -> None:
        new, self.known.new = self.known.new, []
        self.held += sum(map(len, new))
        found = [self._ids(new[k : k + 10_000], pre_tokens) for k in range(0, len(new), 10_000)]
        self.data = np.concatenate([self.data, *(ids for ids, _ in found)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)]))])

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text's with the end id behind them, and how many each has."""
        if len(self.known) > self.memo or self.held > MEMO_CHARACTERS:
            self.forget()
        cut = [self.cut(t) for t in texts]
        number, numbers = self.known.__getitem__, [None] * len(texts)
        for kind in (True, False):
            for k, (parts, pre_tokens) in enumerate(cut):
                if pre_tokens == kind:
                    numbers[k] = np.fromiter(map(number, parts), np.int64, len(parts))
            self._learn(kind)
        parts = np.concatenate([np.zeros(0, np.int64), *numbers])
        start, size = self.ends[parts], self.ends[parts + 1] - self.ends[parts]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.data[np.arange(before[-1]) + np.repeat(start - before[:-1], size)]
        edges = before[np.cumsum([0, *map(len, numbers)])]  # of texts
        sizes = np.diff(edges)
        if end is not None:
            ids, sizes = np.insert(ids, edges[1:], np.uint32(end)), sizes + 1
        return ids, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """This process's encoder, which keeps what it remembers from one task to the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, **options) -> None:
    """Encode docs(doc_id, text) and write the token files in ascending doc_id order."""

    def run(batches):
        encoder, part, start = encoder_for(tokenizer_path), TaskContext.get().partitionId(), 0
        remember("tokens", encoder.forget)
        for batch in batches:
            ids, sizes = encoder.encode([t or "" for t in batch.column("text").to_pylist()], end_id)
            after = np.cumsum(sizes)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], after]).astype(np.int32)), pa.array(ids.view(np.int32)))
            yield packed({"doc_id": batch.column("doc_id"), "part": np.full(len(sizes), part, np.int32), "part_start": start + after - sizes, "n_tokens": sizes, "tokens": tokens}, _ARROW)
            start += len(ids)

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    arrow_map(ordered, run, SCHEMA, "tokens").write.options(**(writer_options() | options)).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with `start`, the ids of all documents before; a scan of some columns reads only those."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # a row for each file
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return rows.join(broadcast_if_small(before, 100_000), "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before", "part_start", "part")


def with_crc(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit words."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            at, values = tokens.offsets.to_numpy(), tokens.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield packed({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": crc}, schema)

    return arrow_map(rows.select("doc_id", "start", "n_tokens", "tokens"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digests(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the corpus's token files into the shared folder and digest what is read back from them."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id)
    return with_crc(read(spark, path))
