"""SentencePiece encoding and decoding with exact n-best segmentations of the piece lattice.

A text's lattice has an edge for every piece of the vocabulary that occurs in it, and for a character without a piece
the edges of its UTF-8 bytes. Forward Viterbi gives the best score from the start to each place; taken as the heuristic
of an A* search that walks back from the end, it is exact, so the search pops complete segmentations in order of score.
As every open suffix has a completion of exactly its estimate, the n best open ones are all that can matter: the queue
never holds more, however long a chunk is and however many paths tie. Scores are multiples of UNIT, so their sums are
exact and ties are ties.

No piece holds a space mark after another character, so paths meet before each run of marks and the lattice of a text
is a chain of chunk lattices. Chunks are searched and remembered one by one. Two passes of Viterbi give each chunk's
best path and the gap to its next one; the n best paths of a chain differ from the best in at most n - 1 chunks, those
of the n - 1 smallest gaps, so A* runs in those alone and the lists are merged by score. All paths of those chunks, the
best too, are A*'s, and so is the best path of a chunk whose gap is nought, as passes and search may part on ties.

Scores: a unigram model's own. A BPE model has merge ranks only; its pieces get log(1 / (rank + 1)), Zipf's law. Equal
scores come in the order of the search, which depends on the chunk alone. A null or empty text has no pieces and one
empty segmentation. Repeated rows get equal results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Sequence
from functools import partial
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import arrow_map, packed, remember

MARK = "▁"
#: Stands for a mark that the text itself holds, which its three bytes encode; a lone surrogate is in no text.
OWN = "\ud800"
_CHUNK = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Chunks and characters of chunks that a worker remembers before it starts anew; bounds its memory.
MEMO, MEMO_CHARACTERS = 1_000_000, 16_000_000
#: Characters of a chunk that is searched together with others, and of one that is remembered from batch to batch.
SHORT, COMMON = 24, 10
#: A piece's score is rounded to a multiple of this.
UNIT = 2.0**-20


def _words(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces:
    """A SentencePiece vocabulary as a lattice."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(k) for k in range(sp.vocab_size())]
        self.bytes = [0] * 256
        normal = []
        for k, name in enumerate(names):
            if sp.is_byte(k):
                self.bytes[int(name[3:5], 16)] = k
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                normal.append(k)
        ranked = len({sp.get_score(k) for k in normal if sp.get_score(k) > -1e6 and sp.get_score(k) == int(sp.get_score(k))}) > len(normal) // 2
        score = {k: round((-log(rank + 1.0) if ranked else sp.get_score(k)) / UNIT) * UNIT for rank, k in enumerate(normal)}
        lowest = min(score.values(), default=0.0) - 10
        self.names = names
        self.of = {names[k]: (score[k], k) for k in normal}
        self.longest = max(map(len, self.of), default=1)
        self.chained = not any(MARK in n.lstrip(MARK) or "\n" in n for n in self.of)
        self.byte_score = lowest
        self.raw = {k: bytes([b]) for b, k in enumerate(self.bytes)} | {k: names[k].replace(MARK, " ").encode() for k in normal}
        self.trie: dict = {}
        for name, found in self.of.items():
            node = self.trie
            for c in name:
                node = node.setdefault(c, {})
            node[""] = found
        self.memo = MEMO
        self.single = frozenset(c for c in self.of if len(c) == 1)
        self._flat_trie()
        self.forget()

    def forget(self) -> None:
        """Start the memory of chunks anew: place by chunk, then ids, score and gap by place."""
        self.place: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.scores, self.gaps = np.zeros(1024), np.zeros(1024)
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.held = 0

    def learn(self, chunks: set[str], n: int = 1) -> None:
        """Search the chunks that aren't remembered; n is the length of the lists that A* makes on ties."""
        short, rest = [], []
        for c in chunks:
            if c not in self.place:
                (short if len(c) <= SHORT and self.single.issuperset(c) else rest).append(c)
        scores, gaps, ids = self._best_many(short)
        found = [self._best(c) for c in rest]
        scores, gaps = (np.concatenate([x, [f[k] for f in found]]) for k, x in enumerate((scores, gaps)))
        ids += [f[2] for f in found]
        first = len(self.ids)
        while first + len(ids) > len(self.scores):
            self.scores, self.gaps = np.resize(self.scores, 2 * len(self.scores)), np.resize(self.gaps, 2 * len(self.gaps))
        self.scores[first : first + len(ids)], self.gaps[first : first + len(ids)] = scores, gaps
        new = short + rest
        for k in np.flatnonzero(gaps == 0).tolist():
            ids[k] = self.n_best(new[k], n)[0][1]
        self.place.update(zip(new, range(first, first + len(new)), strict=True))
        self.ids += ids
        self.held += sum(map(len, new))

    def _flat_trie(self) -> None:
        """The trie as arrays: sorted keys (state * characters + character), their states, and each state's piece."""
        chars = sorted({c for name in self.of for c in name})
        self.width = len(chars) + 1
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, self.width)
        keys, states, piece, score, queue = [], [], [-1], [0.0], [self.trie]
        for state, node in enumerate(queue):
            for c, child in node.items():
                if c:
                    keys.append(state * self.width + int(self.code[ord(c)]))
                    states.append(len(queue))
                    queue.append(child)
                    end = child.get("")
                    piece.append(end[1] if end else -1)
                    score.append(end[0] if end else 0.0)
        order = np.argsort(keys)
        kind = np.int32 if len(queue) * self.width < 1 << 31 else np.int64
        self.keys, self.states = np.array(keys, kind)[order], np.array(states, kind)[order]
        self.piece, self.piece_score = np.array(piece, np.int32), np.array(score)

    def _best_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """_best() of chunks whose characters are all pieces, for all of them at once: the pieces at all places are followed
        through the trie together, then the chunks' places are gone through together from the first to the last."""
        n = len(chunks)
        if not n:
            return np.zeros(0), np.zeros(0), []
        size = np.fromiter(map(len, chunks), np.int64, n)
        code = self.code[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        chunk = np.repeat(np.arange(n), size)
        offset = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        rest = size[chunk] - offset
        at, state, found = np.arange(len(code)), np.zeros(len(code), self.keys.dtype), []
        for m in range(1, min(self.longest, int(size.max())) + 1):
            if m > 1:
                inside = rest[at] >= m
                at, state = at[inside], state[inside]
            key = state * self.width + code[at + m - 1]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            at, state = at[hit], self.states[k[hit]]
            ends = self.piece[state] >= 0
            e = at[ends]
            found.append((chunk[e], offset[e], np.full(len(e), m), state[ends]))
        c, i, m, state = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort((i + m) * (self.longest + 1) + m, kind="stable")
        c, i, m, score, piece = c[order], i[order], m[order], self.piece_score[state[order]], self.piece[state[order]]
        group = (i + m) * (self.longest + 1) + m
        cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        low, wide = -1e300, int(size.max()) + 1
        first, second = np.full((wide, n), low), np.full((wide, n), low)
        back, by = np.zeros((wide, n), np.int64), np.zeros((wide, n), np.int32)
        first[0] = 0.0
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):  # one piece for a chunk at most, all of one length
            who, start, end = c[a:b], i[a], i[a] + m[a]
            s, t, old, other = first[start, who] + score[a:b], second[start, who] + score[a:b], first[end, who], second[end, who]
            better = s > old
            second[end, who] = np.where(better, np.maximum(old, t), np.maximum(other, s))
            first[end, who] = np.where(better, s, old)
            back[end, who] = np.where(better, m[a], back[end, who])
            by[end, who] = np.where(better, piece[a:b], by[end, who])
        every = np.arange(n)
        total, next_ = first[size, every], second[size, every]
        steps, place, live = [], size.copy(), every
        while len(live):
            steps.append((live, by[place[live], live]))
            place[live] -= back[place[live], live]
            live = live[place[live] > 0]
        who, ids = np.concatenate([x[0] for x in steps[::-1]]), np.concatenate([x[1] for x in steps[::-1]])
        order = np.argsort(who, kind="stable")
        data, edges = ids[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(who, minlength=n))).tolist()
        return total, np.where(next_ > -1e200, total - next_, np.inf), [data[a:b] for a, b in zip([0, *edges], edges, strict=False)]

    def edges_into(self, chunk: str, j: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of the pieces that end at a place, the shortest first. OWN stands for a mark of the text itself."""
        out, of = [], self.of
        for i in range(j - 1, max(-1, j - self.longest - 1), -1):
            e = of.get(chunk[i:j])
            if e is not None:
                out.append((i, e[0], (e[1],)))
            elif i == j - 1:
                ids = self._byte_ids(chunk[i])
                out.append((i, len(ids) * self.byte_score, ids))
        return out

    def _byte_ids(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in (MARK if c == OWN else c).encode("utf-8", "surrogatepass"))

    def edges(self, chunk: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """edges_into() of each place."""
        return [[], *(self.edges_into(chunk, j) for j in range(1, len(chunk) + 1))]

    def _best(self, chunk: str) -> tuple[float, float, bytes]:
        """Best score, gap to the next path (inf if there is none), and the best path's ids as little-endian words."""
        n, root, low = len(chunk), self.trie, -1e300
        first, second, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        first[0] = 0.0
        for i in range(n):
            a, b, node = first[i], second[i], root
            for j in range(i, n):
                node = node.get(chunk[j])
                if node is None:
                    break
                if "" in node:
                    score, k = node[""]
                    s, j1 = a + score, j + 1
                    if s > first[j1]:
                        second[j1] = max(first[j1], b + score)
                        first[j1], back[j1] = s, (i, k)
                    elif s > second[j1]:
                        second[j1] = s
            if chunk[i] not in self.of:
                ids = self._byte_ids(chunk[i])
                s = a + len(ids) * self.byte_score
                if s > first[i + 1]:
                    second[i + 1] = max(first[i + 1], b + len(ids) * self.byte_score)
                    first[i + 1], back[i + 1] = s, (i, ids)
                elif s > second[i + 1]:
                    second[i + 1] = s
        path, j = [], n
        while j:
            j, ids = back[j]
            path.append(ids)
        flat = [x for ids in reversed(path) for x in (ids if isinstance(ids, tuple) else (ids,))]
        return first[n], first[n] - second[n] if second[n] > -1e200 else float("inf"), _words(flat)

    def n_best(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a chunk by A* from its end, with the forward scores as heuristic."""
        if (chunk, n) in self.lists:
            return self.lists[chunk, n]
        into = self.edges(chunk).__getitem__ if len(chunk) < 1000 else partial(self.edges_into, chunk)  # a long one's edges come anew
        forward = [0.0] * (len(chunk) + 1)
        for j in range(1, len(chunk) + 1):
            forward[j] = max(forward[i] + s for i, s, _ in into(j))
        # (loss against the best, place, number, score behind, path): of equal losses what is nearer to the start goes first.
        queue, out, count = [(0.0, len(chunk), 0, 0.0, None)], [], 0
        while queue and len(out) < n:
            loss, j, _, behind, path = heapq.heappop(queue)
            if j == 0:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((forward[-1] - loss, _words(ids)))
                continue
            for i, s, ids in into(j):
                count += 1
                queue.append((forward[-1] - forward[i] - s - behind, i, count, behind + s, (ids, path)))
            queue = heapq.nsmallest(n - len(out), queue)
        if len(self.lists) > MEMO // 8:
            self.lists.clear()
        self.lists[chunk, n] = out
        self.held += len(chunk)
        return out

    def chunks(self, text: str) -> list[str]:
        """The text with its dummy space, spaces as marks (the text's own marks set apart), cut into chunks."""
        if MARK in text:
            text = text.replace(MARK, OWN)
        text = MARK + text.replace(" ", MARK)
        return _CHUNK.findall(text) if self.chained else [text]

    def encode(self, texts: list[str], n: int = 1) -> list[list[tuple[float, bytes]]]:
        """For each text the n best (score, ids as little-endian words), best first; fewer if its lattice has fewer paths."""
        cut = [self.chunks(t) if t else [] for t in texts]
        if len(self.place) > self.memo or self.held > MEMO_CHARACTERS:
            self.forget()
        every = set().union(*cut)
        rare = {c for c in every if len(c) > COMMON}
        self.learn(every - rare, n)
        kept = len(self.ids)
        self.learn(rare, n)
        out = [self._chain(c, n) for c in cut]
        del self.ids[kept:]
        for c in rare:
            del self.place[c]
        return out

    def _chain(self, chunks: list[str], n: int) -> list[tuple[float, bytes]]:
        at = list(map(self.place.__getitem__, chunks))
        parts = list(map(self.ids.__getitem__, at))
        where = np.array(at, np.int64)
        total = float(self.scores[where].sum())
        if n < 2 or not at:
            return [(total, b"".join(parts))]
        gaps = self.gaps[where]
        spots = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) > n - 1 else np.arange(len(gaps))
        spots = spots[np.argsort(gaps[spots], kind="stable")].tolist()
        # Losses against the best, merged chunk by chunk from the smallest gap on; a choice lists which path is taken at each
        # spot. Another path of a chunk loses its gap at least, so the rest can't help once n losses are below it.
        merged: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for used, k in enumerate(spots):
            if gaps[k] > 1e200 or len(merged) == n and merged[-1][0] <= gaps[k]:
                spots = spots[:used]
                break
            losses = [max(0.0, self.scores[at[k]] - s) for s, _ in self.n_best(chunks[k], n)]
            merged = heapq.nsmallest(n, [(a + b, (*c, m)) for a, c in merged for m, b in enumerate(losses)])
        base, starts = b"".join(parts), None
        out = []
        for loss, choice in merged:
            data, shift = base, 0
            for k, m in sorted(zip(spots, choice, strict=True)):
                if m:  # of each chunk the first path is the best one
                    if starts is None:
                        starts = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
                    other, end = self.n_best(chunks[k], n)[m][1], int(starts[k]) + shift
                    data, shift = data[: end - len(parts[k])] + other + data[end:], shift + len(other) - len(parts[k])
            out.append((total - float(loss), data))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation, without the dummy space."""
        raw = b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I")))
        return raw[1:].decode("utf-8", "surrogatepass")


_VOCABULARIES: dict[str, Pieces] = {}


def pieces_for(path: str) -> Pieces:
    """This process's vocabulary, which keeps what it remembers from one task to the next."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Pieces(path)
    return _VOCABULARIES[path]


def segment(docs: DataFrame, model_path: str, n: int = 3, memo: int = MEMO // 5) -> DataFrame:
    """doc_id and its n best segmentations, best first: score, ids; with the text that the best one decodes to. memo bounds
    what a worker remembers, which here stands beside other operators of a pipeline."""
    schema = pa.schema([("doc_id", pa.int64()), ("segmentations", pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))), ("decoded", pa.string())])

    def run(batches):
        model = pieces_for(model_path)
        model.memo = memo
        remember("pieces", model.forget)
        for batch in batches:
            found = model.encode([t or "" for t in batch.column("text").to_pylist()], n)
            yield packed({
                "doc_id": batch.column("doc_id"),
                "segmentations": [[{"score": s, "ids": np.frombuffer(b, "<i4")} for s, b in x] for x in found],
                "decoded": [model.decode(x[0][1]) for x in found],
            }, schema)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, segmentations array<struct<score: double, ids: array<int>>>, decoded string", "pieces")


def digests(docs: DataFrame, model_path: str, n: int = 3, memo: int = MEMO) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, best and next scores, how many segmentations there are (up to n), and whether the best decodes to the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()), ("next_score", pa.float64()), ("n_best", pa.int32()), ("round_trip", pa.bool_())])

    def run(batches):
        model = pieces_for(model_path)
        model.memo = memo
        remember("pieces", model.forget)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = model.encode(texts, n)
            yield packed({
                "doc_id": batch.column("doc_id"),
                "n_pieces": [len(x[0][1]) // 4 for x in found],
                "ids_crc32": [zlib.crc32(x[0][1]) for x in found],
                "score": [round(x[0][0], 6) for x in found],
                "next_score": [round(x[1][0], 6) if len(x) > 1 else None for x in found],
                "n_best": [len(x) for x in found],
                "round_trip": [model.decode(x[0][1]) == t for x, t in zip(found, texts, strict=True)],
            }, schema)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_pieces long, ids_crc32 long, score double, next_score double, n_best int, round_trip boolean", "pieces")
