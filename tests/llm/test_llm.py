"""The llm operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, extra columns."""

import collections
import hashlib
import heapq
import itertools
import json
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import decontaminate, langid, neardup, ngrams, pages, pieces, quality, repeats, token_file, topk, toxicity
from logweave.llm import queries as llm_queries
from logweave.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __bytes string, score double"
SMALL = os.environ.get("LOGWEAVE_TEST_DATA", "/root/testdata/sf0.001")


def documents(spark, rows):
    """rows: (doc_id, text); extra columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, None if t is None else "en", "s", None, "x", 0.5) for i, t in rows], DOCS)


def duck(**tables):
    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame.toArrow())
    return c


def records(frame, names):
    def text(v):
        if v is None or str(v) in ("nan", "<NA>"):
            return "none"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[names].astype(object).values.tolist())


ODD = [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "one two"), (104, "one two"), (105, "One TWO"), (106, "w " * 3000), (107, "É à ß 中文 ok"), (None, "no id"), (None, None)]


def near_copies(seed=1, bases=6):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(bases):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 12, 40, 120, 300]))]
        for _ in range(rnd.randrange(1, 8)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 20)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def brute_components(rows, size, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (i, s)), (b, (j, t)) in itertools.combinations(enumerate(sets), 2):
        if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = near_copies() + ODD
    got = neardup.link(documents(spark, rows), size, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, size, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_an_empty_table(spark):
    assert neardup.link(documents(spark, []).where("false"), 3, 85).count() == 0


def test_prefix_lengths_and_overlap_bound():
    assert neardup.prefix_length(20, 64, 85) == 4 and neardup.prefix_length(200, 64, 85) == 64 - neardup.shared_values(64, 85) + 1
    assert 30 <= neardup.shared_values(64, 85) <= 40


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(links).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_token_file_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [*ODD, (5, "Hello, it's <|endoftext|> 2² ½!!"), (3, "naïve ΣΑΣ J̌ İ x\x1cy\x85z")]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t in ordered:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_file.digests(documents(spark, rows), path, 2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_token_file_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    token_file.write(documents(spark, [(k, "a b " * k) for k in range(50)]), f"file://{tmp_path}/t", tokenizer_path("word_bpe_49k.json"), 2)
    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    ids = [x for f in files for x in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert ids == list(range(50))
    meta = pq.ParquetFile(files[0]).metadata.row_group(0)
    columns = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)


def test_pages():
    html = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">accept</div>
    <div id="main12" class="content post-33"><h2>T &amp; x</h2><p>Para one<br>two  &nbsp; three <a href="x">link</a><p>Second<ul><li>a<li>b</ul><div class="ad-slot">buy</div><form>f<input></form></div>
    <section class="comments"><p>nice post, a very long comment from a reader</p></section><aside>s</aside><footer>f</footer><script>if(a<b){"</p>"}</script></body></html>"""
    assert pages.Page(html).text(None) == "T & x\n\nPara one two three link\n\nSecond\n\na\n\nb"
    assert [pages.Page(x).text(None) for x in ("", "plain text", "<p>unclosed", "a<b c", "<script>never closed", "<p>x" * 3)] == ["", "plain text", "unclosed", "a<b c", "", "x\n\nx\n\nx"]


def test_pages_follow_their_host(spark):
    body = "<body><div class='story{}'><p>{}</p></div><div class='extra'><p>{}</p></div></body>"
    rows = [(k, f"http://Ex.com/{k}", body.format(k, "main words " * 20, "x")) for k in range(5)]
    rows += [(9, "https://ex.com/odd", body.format(9, "short", "long and misleading " * 40)), (10, None, None), (11, "bad url", "<p>t"), (11, "bad url", "<p>t")]
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))).collect()}
    assert got[9] == ("short", 5) and got[10] == ("", 0) and got[11] == ("t", 1)
    assert got[0][0] == " ".join(["main words"] * 20)
    assert pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").where("false")).count() == 0


def brute_topk(rows, k):
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in usable:
        if i % 20 == 0:
            best = heapq.nsmallest(k, ((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in usable if j != i and len(c) == len(q)))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_topk(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1 + i % 3) for _ in range(6)]) for i in range(300)]
    rows += [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, [1.0]), (405, []), (406, [0.0] * 6), *[(500 + k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for k in range(40)]]
    rows += [(600 + k, [rnd.gauss(0, 1) for _ in range(2)]) for k in range(50)]  # ragged
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit("clash"))
    got = {tuple(r) for r in topk.search(frame, F.col("id") % 20 == 0).collect()}
    want = brute_topk([(r.vec_id, r.embedding) for r in frame.collect()], 20)
    assert got == want
    few = frame.where("vec_id < 5 or vec_id = 20")
    assert {tuple(r) for r in topk.search(few, F.col("id") % 20 == 0).collect()} == brute_topk([(r.vec_id, r.embedding) for r in few.collect()], 20)
    assert topk.search(frame.where("false"), F.col("id") % 20 == 0).count() == 0


def test_topk_of_large_values(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(20, [1.0, 2.0]), (1, [2e7, 0.0]), (2, [1.0, 1.0]), (3, [-3e9, 1e6]), (40, [12345678.25, -1e8]), (60, [0.0, 0.0])]
    got = {tuple(r) for r in topk.search(spark.createDataFrame(rows, schema), F.col("id") % 20 == 0, 2).collect()}
    assert got == brute_topk(rows, 2)
    assert {(q, v) for q, r, v, _ in got if r == 1} >= {(20, 1)}
    for bad in ([1e18, 0.0], [-1e18, 0.0], [1e307, 0.0]):
        with pytest.raises(Exception, match="range"):
            topk.search(spark.createDataFrame([(20, [1e18, 0.0]), (1, bad)], schema), F.col("id") % 20 == 0).collect()


TOXIC, PLAIN = ["idiot", "moron", "scum"], ["house", "river", "green", "walks", "bright", "table", "summer", "letter"]


def labelled(seed, n):
    rnd = random.Random(seed)
    texts, toxic = [], []
    for k in range(n):
        words = [rnd.choice(PLAIN) for _ in range(30)]
        if k % 4 == 0:
            for _ in range(2):
                words[rnd.randrange(30)] = rnd.choice(TOXIC)
        texts.append(" ".join(words))
        toxic.append(int(k % 4 == 0))
    return texts, toxic


def test_toxicity_and_misspellings(spark):
    texts, toxic = labelled(1, 240)
    docs = documents(spark, [*enumerate(texts), *ODD])
    labels = spark.createDataFrame([*((k, 1, t) for k, t in enumerate(toxic)), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.detect(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert {r.doc_id for r in held} == {k for k in range(240) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.95 * len(held)
    assert len(got) == 240 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    model = toxicity.fit([t.encode() for t in texts], np.array(toxic))
    odd = model.scores([b"house river you idiiot green", b"house river green table summer", b""])
    assert odd[0] > 0.5 > odd[1]
    assert toxicity.fit([], np.zeros(0)).scores([b"x"]).shape == (1,)


def test_quality(spark):
    rnd = random.Random(2)
    rows, marks = [], []
    for k in range(200):
        good = k % 5 != 0
        words = [rnd.choice(PLAIN) for _ in range(rnd.randrange(20, 60))]
        rows.append((k, " ".join(words).capitalize() + "." if good else "$$$ ".join(w.upper() for w in words)))
        marks.append(int(good))
    docs = documents(spark, rows + ODD)
    labels = spark.createDataFrame([(k, m, 0) for k, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert held and sum(r.predicted == marks[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in got) and len(got) == 200 + len(ODD)
    kept = quality.keep_good(docs, labels)
    good = {r.doc_id for r in got if r.predicted}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good
    assert quality.classify(docs, labels.where("false")).count() == 200 + len(ODD)


def test_language(spark):
    rnd = random.Random(4)
    sets = {"aa": ["the", "and", "with", "house"], "bb": ["le", "être", "avec", "maison"], "cc": ["der", "über", "mit", "haus"]}
    rows = [(k, " ".join(rnd.choice(sets[lang]) for _ in range(25)), lang) for k in range(180) for lang in [sorted(sets)[k % 3]]]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 34 !", "bb"), (502, "", None), (None, "the house", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and by[500].score == 0
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 180]
    assert held and all(r.lang_pred == rows[r.doc_id][2] for r in held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 184
    assert langid.identify(docs.where("false")).count() == 0


def brute_repeats(rows, length):
    seen, cut = collections.Counter(), []
    for _, t in rows:
        b = (t or "").encode()
        cut.append(b)
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, cut, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        keep = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(keep).hexdigest()))
    return sorted(out, key=str)


def passages(seed=5):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abc é") for _ in range(1500))
    noise = lambda: "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(200)))
    rows = []
    for i in range(40):
        a = rnd.randrange(1200)
        t = noise() + base[a : a + rnd.randrange(30, 400)] + noise()
        rows.append((i, t.replace("a", "q", 1) if rnd.random() < 0.3 else t))
    return [*rows, *ODD, (200, "ab" * 300), (201, rows[3][1]), (201, rows[3][1]), (202, "z" * 700)]


@pytest.mark.parametrize("frequent", [1000, 1])
def test_repeated_bytes(spark, frequent, monkeypatch):
    rows, find = passages(), repeats.find
    monkeypatch.setattr(repeats, "find", lambda d, n: find(d, n, frequent=frequent))
    got = sorted((tuple(r) for r in repeats.digests(documents(spark, rows), 64).collect()), key=str)
    assert got == brute_repeats(rows, 64)


def test_long_documents_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 100)
    text = "".join(random.Random(1).choice("abcd") for _ in range(3000)).encode()
    parts = repeats.units(text, 64, 16)
    first, last = parts[2], parts[3]
    assert first[0] == 0 and last[-1] == len(text) - 64 and (first[1:] == last[:-1] + 1).all()


def test_suffix_order_is_lexicographic():
    data = np.frombuffer("".join(random.Random(2).choice("ab") for _ in range(400)).encode(), np.uint8)
    starts = np.arange(300)
    group = np.sort(np.arange(300) % 3)
    order = repeats.merge_sorted(repeats.Hashes(data), data, starts, group, 60)
    for g in range(3):
        mine = [int(starts[k]) for k in order if group[k] == g]
        assert [bytes(data[s : s + 60]) for s in mine] == sorted(bytes(data[s : s + 60]) for s in starts[group == g])


def test_decontamination(spark):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["É", "中"]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 4, 10, 14, 25])))) for k in range(12)] + [(50, None), (51, ""), (52, "!!"), (None, "w1 w2"), (3, "dup id words here")]
    rows = []
    for k in range(60):
        t = [rnd.choice(words) for _ in range(rnd.randrange(0, 60))]
        if k % 3 == 0:
            part = (items[rnd.randrange(12)][1]).split()
            t += part[rnd.randrange(3) :] + [rnd.choice(words)]
        rows.append((k, "-".join(t).upper() if k % 2 else ", ".join(t)))
    docs, bench = documents(spark, rows + ODD), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digests(docs, bench)
    names = sorted(got.columns)
    want = duck(documents=docs, benchmark=bench).execute(decontaminate.ORACLE).df()
    assert records(got.toPandas(), names) == records(want, names)
    several = decontaminate.contamination(docs, bench, keep=["doc_id"], index_bytes=40).select("doc_id", "n_words", "spans", "items")
    one = decontaminate.contamination(docs, bench, keep=["doc_id"]).select("doc_id", "n_words", "spans", "items")
    assert sorted(map(str, several.collect())) == sorted(map(str, one.collect()))
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == got.where("not contaminated").count()
    assert decontaminate.digests(docs, bench.where("false")).where("contaminated").count() == 0


def test_piece_lattice_by_brute_force():
    model = pieces.pieces_for(tokenizer_path("piece_bpe_32k.model"))

    def paths(into, j):
        if j == 0:
            yield 0.0, ()
        for i, s, ids in into[j] if j else ():
            for a, p in paths(into, i):
                yield a + s, p + ids

    for text in ["the cat sat", "é▁x\0\1\2 \n a  b", "aaaa aaa", "  ", "\n\n", "hello wor", "▁", "中文 🙂"]:
        full = "".join(model.chunks(text))
        want = sorted((-round(s, 6) for s, _ in paths(model.edges(full), len(full))))[:5]
        got = model.encode([text], 5)[0]
        assert [-round(s, 6) for s, _ in got] == want
        assert all(model.decode(ids) == text for _, ids in got) and len({ids for _, ids in got}) == len(got)
    assert model.encode([""], 3) == [[(0.0, b"")]]


def test_piece_query(spark):
    got = pieces.digests(documents(spark, ODD), tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(got) == len(ODD) and all(r.round_trip for r in got)
    assert {r.n_pieces for r in got if r.doc_id == 100} == {0}


def test_ngrams_stay_inside_words():
    buf, starts, ends = ngrams.joined([b"ab cd", b""], ngrams.letters_table(True))
    assert bytes(buf) == b" ab cd   " and starts.tolist() == [0, 7] and ends.tolist() == [7, 9]
    assert [bytes(buf[k : k + 3]) for k in np.flatnonzero(ngrams.inside_words(buf, 3))] == [b" ab", b"ab ", b" cd", b"cd "]


def brute_pipeline(spark, docs, labels, bench):
    """The pipeline's decisions by brute force, on Python lists; the quality model is the operator's own."""
    model = quality.fit_from(docs, labels)
    rows = [r.asDict() for r in docs.collect()]
    x = np.array([quality.features((r["text"] or "").encode()) for r in rows])
    rows = [r for r, s in zip(rows, model.scores(x), strict=True) if s >= 0.7]
    least = {i: c for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80)}
    rows = [r for r in rows if least[r["doc_id"]] == r["doc_id"]]
    seen, length = collections.Counter(), 250
    for r in rows:
        b = (r["text"] or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    left = []
    for r in rows:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        text = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not gone.any() or text.strip():
            left.append((r["doc_id"], text if gone.any() else r["text"]))
    windows = {tuple(w[k : k + 10]) for r in bench.collect() for w in [decontaminate.words((r.text or "").encode())] if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in left:
        w = decontaminate.words((t or "").encode())
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            out[i] = t or ""
    return out


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    docs, labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    want = brute_pipeline(spark, docs, labels, bench)
    assert {i: r.text for i, r in got.items()} == want
    model = pieces.pieces_for(tokenizer_path("piece_bpe_32k.model"))
    assert all(model.decode(np.array(r.ids, "<u4").tobytes()) == r.text and r.n_pieces == len(r.ids) for r in got.values())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    got, want = llm_queries.queries()[name](spark, SMALL).toPandas(), c.execute(llm_queries.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and records(got, names) == records(want, names)


def test_vocabulary_kind():
    spec = json.load(open(tokenizer_path("word_bpe_49k.json")))
    assert token_file.encoder_for(tokenizer_path("word_bpe_49k.json")).by_word == (spec["model"]["end_of_word_suffix"] == "</w>")


def test_parity_bits_bound_the_difference():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        base = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = np.unique(base[: rnd.integers(1, 300)]), np.unique(base[rnd.integers(0, 299) :])
        assert neardup.differing_bits(neardup.parity_bits(a), neardup.parity_bits(b)) <= len(np.setxor1d(a, b))


def crowd(seed=8, copies=60):
    """Copies of one text with changes of their own, and with changes that some share: linked to each other, not to the middle."""
    rnd = random.Random(seed)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(copies):
        t = list(base)
        for j in range(0, 24, 2):
            t[(j * 8 + k % 6) % 200] = f"x{k % 6}"
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(200)] = f"own{rnd.randrange(40)}"
        rows.append(" ".join(t))
    return list(enumerate(rows))


def test_crowded_lists(spark, monkeypatch):
    rows = crowd()
    want = brute_components(rows, 3, 85)
    assert len({c for _, _, c in want}) > 3
    for rounds, room in ((2, 8), (2, 0), (0, 1e9)):
        monkeypatch.setattr(neardup, "PIVOT_ROUNDS", rounds)
        monkeypatch.setattr(neardup, "ROOM", room)
        got = neardup.link(documents(spark, rows), 3, 85).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_one_of_each_group_stays(spark):
    first, second = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    rows = [(1, first), (1, second), (2, "other words that stand for themselves alone here"), (3, first), (4, second), (4, second), (5, None), (5, None), (6, ""), (None, first), (None, None), (7, "9 8 7 6 5 4 3 2 1"), (7, "9 8 7 6 5 4 3 2 1")]
    docs = documents(spark, rows).withColumn("__place", F.lit("clash"))
    kept = neardup.keep_first(docs, 5, 80)
    assert kept.columns == docs.columns
    want = [(1, first), (1, second), rows[2], (5, None), (5, None), (6, ""), (None, first), (None, None), (7, "9 8 7 6 5 4 3 2 1")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.link(docs, 5, 80).where("doc_id in (1, 3, 4)").collect()}
    assert got == {(1, 1, True), (3, 1, False), (4, 1, False)}
    assert neardup.keep_first(docs.where("false")).count() == 0
