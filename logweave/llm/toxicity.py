"""Toxicity scores from averaged subword embeddings under a linear softmax, trained jointly in numpy.

A text's bag holds the character 3- to 5-grams of its words (with word boundaries), hashed into buckets, so a
misspelling that no one has seen shares most of its vectors with the word it comes from. Null or empty texts have an
empty bag and get the score of the intercept. Repeated rows and ties are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import ngrams
from logweave.llm.common import arrow_map, bounded_sample, byte_lists, crc_mod, first_rows, packed, utf8

ORDERS, BITS, WIDTH = (3, 4, 5), 18, 8
#: Upper bound of the labelled rows that a fit gathers; the smallest hashes of the ids are taken.
MAX_FIT_ROWS = 8000


_MAP = ngrams.letters_table(True)
_AGAIN = re.compile(rb"( [^ ]++) *(?=\1 )")


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mapped texts in one buffer; of a word's repetitions in a row one stays, so that junk can't fill a bag with it."""
    table = _MAP.tobytes()
    return ngrams.joined([_AGAIN.sub(b"", b" " + t.translate(table) + b" ")[1:-1] for t in texts], _MAP)


@dataclass
class ToxicityModel:
    """embeddings (buckets x width), softmax weights (width x 2) and intercepts (2)."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def bucket_margins(self) -> np.ndarray:
        """What one gram adds to the log-odds before averaging: the softmax is linear in the mean."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _scores(texts, self.bucket_margins(), float(self.bias[1] - self.bias[0]))


def _scores(texts: list[bytes], margins: np.ndarray, bias: float) -> np.ndarray:
    buf, starts, ends = _joined(texts)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for n in ORDERS:
        inside = ngrams.inside_words(buf, n)
        if len(inside):
            total += ngrams.span_sums(np.where(inside, margins[ngrams.gram_ids(buf, n, BITS)], np.float32(0)), starts, ends, n)
            count += ngrams.span_sums(inside.astype(np.float32), starts, ends, n)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -30, 30)))


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf, _, _ = _joined([text])
    ids = np.concatenate([ngrams.gram_ids(buf, n, BITS)[ngrams.inside_words(buf, n)] for n in ORDERS])
    ids, counts = np.unique(ids, return_counts=True)
    return ids, (counts / max(1, counts.sum())).astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 10, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> ToxicityModel:
    """Adagrad on the cross-entropy of single texts; embeddings and softmax move together. One class only: a constant."""
    rng = np.random.default_rng(seed)
    bags = [_bag(t) for t in texts]
    model = ToxicityModel(np.zeros((1 << BITS, WIDTH), np.float32), rng.normal(0, 1, (WIDTH, 2)).astype(np.float32), np.zeros(2))
    if not len(labels):
        return model
    share = np.clip(np.mean(labels), 1e-3, 1 - 1e-3)
    model.bias[:] = np.log1p(-share), np.log(share)
    if len(set(np.asarray(labels).tolist())) < 2:
        return model
    e, w, b = model.embeddings, model.weights, model.bias
    e2, w2, b2 = np.full(1 << BITS, 1e-10, np.float32), np.full(w.shape, 1e-2, np.float32), np.full(2, 1.0)
    scale = np.float32(30)  # of the mean, which a few words in a thousand must be able to move
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, tf = bags[k]
            rows = e[ids]
            mean = scale * (tf @ rows) if len(ids) else np.zeros(WIDTH, np.float32)
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[k])] -= 1
            g = (scale * (w @ p)).astype(np.float32)
            if len(ids):
                e2[ids] += (tf * np.sqrt(g @ g / WIDTH)) ** 2
                e[ids] = rows - rate * (np.outer(tf / np.sqrt(e2[ids]), g) + decay * rows)
            gw = np.outer(mean, p)
            w2 += gw**2
            w -= 0.1 * rate * gw / np.sqrt(w2)
            b2 += p**2
            b -= 0.1 * rate * p / np.sqrt(b2)
    model.weights = w * scale
    return model


def fit_from(docs: DataFrame, labels: DataFrame, rows: int = MAX_FIT_ROWS) -> ToxicityModel:
    """Fit on at most `rows` labelled documents whose id's crc32 mod 4 isn't 2 (the bound is the parameter).

    Null labels and null ids aren't learnt from; a document with several labels counts as toxic if any says so.
    """
    marked = labels.select("doc_id", F.col("toxic").alias("_y")).where("doc_id is not null and _y is not null").groupBy("doc_id").agg(F.max("_y").alias("_y"))
    texts = docs.select("doc_id", utf8().alias("_t")).where("_t is not null")
    sample = first_rows(bounded_sample(marked.where(crc_mod("doc_id", 4) != 2), texts, rows), rows).select("_t", "_y").collect()
    return fit([bytes(r._t) for r in sample], np.array([int(r._y > 0) for r in sample], np.int64))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    margins, bias = model.bucket_margins(), float(model.bias[1] - model.bias[0])
    shared = docs.sparkSession.sparkContext.broadcast(margins)  # 2**BITS floats, whatever the corpus
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            yield packed({"doc_id": batch.column("doc_id"), "score": _scores(byte_lists(batch), shared.value, bias)}, schema)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")), run, "doc_id long, score double")


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit_from(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
