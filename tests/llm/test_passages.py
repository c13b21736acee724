"""Words, repeated passages of short words, and ties of segmentations."""

import collections
import random

import numpy as np

import corpus_pipeline
from logweave.llm import pieces, repeats
from logweave.llm.common import tokenizer_path
from tests.llm.test_llm import brute_repeats


def test_words_are_parted_as_python_does():
    text = "a\u00a0bé\u2003\u3000c\x1cd\u1680e\u2028f\u205f g\x85 \u200b中 \n"
    first, last = repeats.word_bounds(np.frombuffer(text.encode(), np.uint8))
    assert [text.encode()[a:b].decode() for a, b in zip(first, last, strict=True)] == text.split()
    assert [len(x) for x in repeats.word_bounds(np.frombuffer(b"", np.uint8))] == [0, 0]


def test_repeated_passages_of_short_words_go(spark):
    rnd = random.Random(3)
    passage = " ".join(rnd.choice("abcdefgh") for _ in range(51))
    fewer = " ".join(rnd.choice("ijklmnop") for _ in range(50))
    rows = [(1, f"one {passage} end"), (2, f"two words {passage}"), (3, f"x1 {fewer} x2"), (4, f"y1 {fewer} y2"), (5, passage[:-1] + "z"), (6, None), (7, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in repeats.without_repeats(docs, corpus_pipeline.REPEAT_BYTES, corpus_pipeline.REPEAT_WORDS).collect()}
    assert len(passage) == 101
    assert got == {1: "one  end", 2: "two words ", 3: rows[2][1], 4: rows[3][1], 5: rows[4][1], 6: None}


def periodic_rows():
    rnd = random.Random(8)
    noise = lambda: "".join(rnd.choice("xyzw v") for _ in range(rnd.randrange(90)))
    rows = [(i, f"{noise()} {'he. Is on' * (50 + i)} {noise()}") for i in range(12)]
    rows += [(20, "ab" * 300), (21, "he. Is on" * 8), (22, noise()), (23, None), rows[3], (24, f"{noise()} {rows[5][1]} é {rows[5][1]}"), (25, "a b " * 99)]
    return [*rows, (26, f"{noise()} {'a b ' * 9}{noise()}"), (27, f"é {'c d ' * 40}ef")]


def test_a_short_period_makes_few_rows(spark):
    rows = periodic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert repeats.find(docs, 64).count() <= 8 * len(rows)  # one for each period made 1,166
    assert sorted((tuple(r) for r in repeats.digests(docs, 64).collect()), key=str) == brute_repeats(rows, 64)


def test_passages_of_a_short_period_make_few_rows(spark):
    rows = [(k, t) for k, (_, t) in enumerate(periodic_rows())]
    seen, at = collections.Counter(), collections.defaultdict(list)
    for k, t in rows:
        b = (t or "").encode()
        for x, y in zip(*(z.tolist() for z in repeats.short_passages(b, 8, 64)), strict=True):
            seen[b[x:y]] += 1
            at[k].append((x, y, b[x:y]))
    want = {(k, i) for k, found in at.items() for x, y, p in found if seen[p] > 1 for i in range(x, y)}
    found = repeats.find_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8, 64).collect()
    assert {(r.id, i) for r in found for i in range(r.s0, r.s1 + 64)} == want
    assert len(found) <= 8 * len(rows)  # 1,916 likewise


def test_what_a_document_repeats_by_itself():
    doc, key = np.array([0, 0, 0, 1, 1, 2]), np.array([5, 7, 5, 5, 7, 9])
    n, first = repeats.within(doc, key)
    assert n.tolist() == [2, 1, 2, 1, 1, 1] and first.tolist() == [True, True, False, True, True, True]
    spans = repeats.united(np.array([0, 0, 0, 1]), np.array([0, 4, 9, 8]), np.array([4, 6, 12, 20]))
    assert [x.tolist() for x in spans] == [[0, 0, 1], [0, 9, 8], [6, 12, 20]]
    assert [len(x) for x in repeats.united(*(np.zeros(0, np.int64),) * 3)] == [0, 0, 0]
    assert [len(x) for x in repeats.within(*(np.zeros(0, np.int64),) * 2)] == [0, 0]


def test_tied_segmentations_are_distinct_and_right():
    model = pieces.pieces_for(tokenizer_path("piece_bpe_32k.model"))

    def paths(into, j):
        if j == 0:
            yield 0.0, ()
        for i, s, ids in into[j] if j else ():
            for a, p in paths(into, i):
                yield a + s, p + ids

    for text in ["aaaaaa", "aaaaaa aaaaaa", "aaaaaaa", "abababab", "x aaaaaa b aaaaa"]:
        full = "".join(model.chunks(text))
        scores = {np.array(ids, "<u4").tobytes(): round(s, 6) for s, ids in paths(model.edges(full), len(full))}
        for n in (1, 2, 3, 5):
            got = model.encode([text], n)[0]
            assert [scores[ids] for _, ids in got] == [round(s, 6) for s, _ in got] == sorted(scores.values(), reverse=True)[:n]
            assert len({ids for _, ids in got}) == len(got)
            floor = round(got[-1][0], 6)
            assert {i for i, s in scores.items() if s > floor} <= {ids for _, ids in got}
        assert len({model.encode([text], n)[0][0][1] for n in (1, 2, 3)}) == 1
