"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import common, decontaminate, langid, neardup, pieces, quality, repeats, token_file, toxicity
from logweave.llm.common import tokenizer_path
from tests.llm.test_llm import ODD, documents, labelled

LONG = " ".join(random.Random(4).choice(["long", "text", "wörter", "of", "one", "document"]) + str(k % 997) for k in range(20_000))
WORD_VOCABULARY, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
CLASH = ["text_", "id", "score", "label", "features", "held_out", "spans", "node", "th", "fp", "start", "tokens", "keep_text", "__bytes", "key", "r1", "path", "bits"]


def tables(spark):
    texts, toxic = labelled(1, 60)
    docs = documents(spark, [*enumerate(texts), *ODD, (900, LONG), (901, LONG), (902, "x" * 100_000)])
    docs = docs.drop("score", "__bytes").withColumns({c: F.lit("clash") for c in CLASH})
    labels = spark.createDataFrame([(k, 1 - t, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(LONG.split()[900:902])), (2, " ".join(LONG.split()[50:70])), (3, None)], "item_id long, text string")
    return docs, labels, bench


OPERATORS = {
    "op1": lambda d, lab, b: neardup.link(d, 3, 85),
    "op2": lambda d, lab, b: token_file.digests(d, tokenizer_path(WORD_VOCABULARY), 2),
    "op5": lambda d, lab, b: langid.identify(d),
    "op6": lambda d, lab, b: repeats.digests(d, 400),
    "op7": lambda d, lab, b: toxicity.detect(d, lab),
    "op8": lambda d, lab, b: decontaminate.digests(d, b),
    "op9": lambda d, lab, b: quality.classify(d, lab),
    "op10": lambda d, lab, b: pieces.digests(d, tokenizer_path(PIECE_MODEL)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_its_result(spark, name):
    docs, labels, bench = tables(spark)
    got = OPERATORS[name](docs, labels, bench).toPandas()
    assert len(got) == docs.count()
    same = got[got["doc_id"].isin([900, 901])].drop(columns=[c for c in ("doc_id", "start", "held_out", "kept") if c in got]).astype(str).values.tolist()
    assert same[0] == same[1]  # one text, one result
    again = got[got["doc_id"] == 104].drop(columns=[c for c in ("start",) if c in got]).astype(str).values.tolist()
    assert len(again) == 2 and again[0] == again[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_an_empty_table_has_an_empty_result(spark, name):
    docs, labels, bench = tables(spark)
    assert OPERATORS[name](docs.where("false"), labels, bench).count() == 0
    assert OPERATORS[name](docs.where("false"), labels.where("false"), bench.where("false")).count() == 0


def test_whole_long_texts_count(spark):
    docs, _, bench = tables(spark)
    n = len(LONG.split())
    found = {r.doc_id: r for r in decontaminate.digests(docs, bench).collect()}
    assert found[900].n_words == n and found[900].n_items == 2
    assert {r.doc_id: r.n_shingles for r in neardup.link(docs, 3, 85).collect()}[900] == len({tuple(LONG.split()[k : k + 3]) for k in range(n - 2)})


def test_one_word_of_benchmark(spark):
    bench = spark.createDataFrame([(7, "hello")], "item_id long, text string")
    docs = documents(spark, [(1, "say hello twice hello"), (2, "nothing"), (3, None)])
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.digests(docs, bench).collect()}
    assert got == {1: (2, 1, True), 2: (0, 0, False), 3: (0, 0, False)}


def test_windows_of_a_frequent_word_are_compared_in_parts(spark, monkeypatch):
    items = [(k, f"the a{k} the b{k} the c{k} the d{k} the e{k}") for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [(k, "the " * 50 + t + " the" * 50) for k, t in items])
    whole = sorted(map(str, decontaminate.digests(docs, bench).collect()))
    found = list(decontaminate.indexes(docs, bench, 10))
    monkeypatch.setattr(decontaminate, "PLACES", 7)
    for k, t in items:
        window, start = found[0].match(decontaminate.words(("the " * 50 + t + " the" * 50).encode()))
        assert start.tolist() == [50] and found[0].items(window) == {k}
    assert whole == sorted(map(str, decontaminate.digests(docs, bench).collect()))


def test_new_words_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path, rnd = tokenizer_path(WORD_VOCABULARY), random.Random(5)
    plain, own = Tokenizer.from_file(path), token_file.Encoder(path, 50)
    alphabet = "abcdefghiéüß's2²½ \n\t.,-!?&<|>ªµ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(1500)] + ["<|endoftext|>", "中文 text", "ΣΑΣ don't"]
    for k in range(0, len(texts), 100):
        ids, sizes = own.encode(texts[k : k + 100], 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts[k : k + 100]]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Far:
        conf = spark.conf

        class sparkContext:
            master = "spark://far:7077"

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="checkpoint"):
            common.shared_dir(Far())


def test_scratch_tables_go_after_an_error(spark):
    with pytest.raises(ZeroDivisionError), common.Scratch(spark) as scratch:
        table = scratch.save(spark.range(3), "gone")
        assert table.count() == 3
        path = scratch.paths[0].removeprefix("file://")
        assert os.path.isdir(path)
        1 / 0
    assert not os.path.exists(path)


def test_broadcasts_are_of_bounded_rows(spark):
    with pytest.raises(TypeError):
        common.broadcast_if_small(spark.range(1).select(F.array("id").alias("a")), 10)


def stages(spark, docs, labels, bench, folder):
    labels.write.parquet(f"file://{folder}/labels.parquet")
    bench.write.parquet(f"file://{folder}/benchmark.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, f"file://{folder}"), "test-stage")
        out.append(docs)
    return out


def test_stages_on_odd_rows(spark, tmp_path):
    docs, labels, bench = tables(spark)
    labels = labels.withColumn("quality", F.lit(1))  # nothing is rejected by quality
    passage = " ".join(f"p{k}" for k in range(60))
    around = [" ".join(f"{c}{k}" for k in range(40)) for c in "uvwx"]
    more = documents(spark, [(920, f"{around[0]} {passage} {around[1]}"), (921, f"{around[2]} {passage} {around[3]}"), (922, "same id one two three four five"), (922, "same id but quite another text here"), (923, "same id one two three four five")])
    docs = docs.unionByName(more.drop("score", "__bytes").withColumns({c: F.lit("clash") for c in CLASH}))
    good, first, cut, clean, coded = stages(spark, docs, labels, bench, tmp_path)
    assert all(x.columns == docs.columns for x in (good, first, cut, clean))
    assert good.count() == docs.count()
    kept = [(r.doc_id, r.text) for r in first.collect()]
    assert sum(i == 922 for i, _ in kept) == 2 and not any(i == 923 for i, _ in kept)
    assert sorted(i for i, t in kept if t == LONG) == [900] and sum(i == 104 for i, _ in kept) == 1
    assert [t for i, t in kept if i in (100, 101)] and sum(i is None for i, _ in kept) == 2
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert "p5" not in texts[920] and "p5" not in texts[921] and texts[920] == f"{around[0]}  {around[1]}" and texts[921] == f"{around[2]}  {around[3]}"
    assert not any(r.doc_id == 900 for r in clean.collect())  # it holds items of the benchmark
    assert {r.text for r in coded.collect()} == {r.text or "" for r in clean.collect()}


def test_stages_on_empty_tables(spark, tmp_path):
    docs, labels, bench = tables(spark)
    found = stages(spark, docs.where("false"), labels.where("false"), bench.where("false"), tmp_path)
    assert [x.count() for x in found] == [0] * 5
