"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (proximal, per coordinate) with L1 and L2 penalties; a temperature fitted on
a held-back part of the sample calibrates the probabilities. Document frequencies count all training documents. A text
that is null or has no letter gets `und` with score 0. Repeated rows and ties are predicted alike; of equal
probabilities the language that sorts first wins; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import ngrams
from logweave.llm.common import arrow_map, bounded_sample, byte_lists, crc_mod, first_rows, packed, utf8

ORDERS, BITS = (1, 2, 3), 16
#: Upper bound of the labelled rows that a fit gathers; the smallest hashes of the ids are taken.
MAX_FIT_ROWS = 4000
_LETTER = regex.compile(r"\p{L}")


def _has_letter(text: bytes) -> bool:
    return _LETTER.search(text.decode("utf-8", "replace")) is not None


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, sparse by the L1 penalty
    bias: np.ndarray
    temperature: float

    def table(self) -> np.ndarray:
        return (self.idf[:, None] * self.weights).astype(np.float32)


def _logits(texts: list[bytes], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights times idf, averaged over the n-grams of a text: the tf-idf vector times the weights."""
    buf, starts, ends = ngrams.joined(texts, ngrams.letters_table(False))
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for n in ORDERS:
        ids = ngrams.gram_ids(buf, n, BITS)
        for c in range(table.shape[1]):
            total[:, c] += ngrams.span_sums(table[:, c][ids], starts, ends, n)
        count += np.maximum(0, ends - starts - n + 1)
    return total / np.maximum(count, 1)[:, None] + bias


def _predict(texts: list[bytes], table: np.ndarray, bias: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    z = _logits(texts, table, bias) / temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p.argmax(1), p.max(1)


def _vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf, _, _ = ngrams.joined([text], ngrams.letters_table(False))
    ids, counts = np.unique(np.concatenate([ngrams.gram_ids(buf, n, BITS) for n in ORDERS]), return_counts=True)
    return ids, counts / counts.sum()


def fit(texts: list[bytes], langs: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1e-3, l1: float = 1e-4, l2: float = 1e-4, seed: int = 3) -> LanguageModel:
    languages = sorted(set(langs))
    k = len(languages)
    if not k:
        return LanguageModel(["und"], idf, np.zeros((1 << BITS, 1)), np.zeros(1), 1.0)
    target = np.array([languages.index(x) for x in langs])
    vectors = [(ids, tf * idf[ids]) for ids, tf in map(_vector, texts)]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(order) // 5] if len(order) >= 50 else order[:0]
    learn = order[len(held) :]
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    bias = np.zeros(k)

    def weights(ids):
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    def logits(ids, x):
        return x @ weights(ids) + bias

    for epoch in range(epochs):
        for j in rng.permutation(learn):
            ids, x = vectors[j]
            w = weights(ids)
            s = x @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[target[j]] -= 1
            g = np.outer(x, p)
            old = n[ids]
            new = old + g * g
            z[ids] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[ids] = new
            bias -= 0.01 * p
    temperature = 1.0
    if len(held):
        raw = np.array([logits(*vectors[j]) for j in held])

        def loss(t):
            s = raw / t
            m = s.max(1, keepdims=True)
            return float(np.mean((m[:, 0] + np.log(np.exp(s - m).sum(1))) - s[np.arange(len(held)), target[held]]))

        temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return LanguageModel(languages, idf, weights(slice(None)), bias, temperature)


def training_rows(docs: DataFrame) -> DataFrame:
    """Texts and languages that may be learnt from: crc32 of the id mod 3 isn't 1, language and text not null."""
    known = docs.select("doc_id", utf8().alias("text"), F.col("lang").alias("_lang"))
    return known.where(F.col("_lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 3) != 1))


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """Smoothed idf of each bucket over all training rows: one dense count per task, summed by bucket."""
    size = 1 << BITS
    schema = pa.schema([("bucket", pa.int32()), ("df", pa.int64())])

    def run(batches):
        df, total = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            texts = byte_lists(batch)
            buf, starts, ends = ngrams.joined(texts, ngrams.letters_table(False))
            grams = [ngrams.gram_ids(buf, n, BITS) for n in ORDERS]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                seen = np.zeros(size, bool)
                for g, n in zip(grams, ORDERS, strict=True):
                    seen[g[a : max(a, b - n + 1)]] = True
                df[:-1] += seen
            total += len(texts)
        df[-1] = total
        at = np.flatnonzero(df)
        yield packed({"bucket": at.astype(np.int32), "df": df[at]}, schema)

    counted = arrow_map(rows.select("text"), run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(size + 1)
    df[counted["bucket"].to_numpy()] = counted["df"].to_numpy()
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def fit_from(docs: DataFrame, rows: int = MAX_FIT_ROWS) -> LanguageModel:
    """idf over all training documents; weights from at most `rows` of them (the bound is the parameter)."""
    known = training_rows(docs)
    idf = inverse_frequencies(known)
    ids = known.select("doc_id").groupBy("doc_id").agg(F.lit(1).alias("_y"))
    sample = first_rows(bounded_sample(ids, known, rows), rows).select("text", "_lang").collect()
    return fit([bytes(r.text) for r in sample], [r._lang for r in sample], idf)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.table(), model.bias, model.temperature, model.languages))  # of fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        table, bias, temperature, languages = shared.value
        for batch in batches:
            texts = byte_lists(batch)
            best, p = _predict(texts, table, bias, temperature)
            known = [_has_letter(t) for t in texts]
            yield packed(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang_pred": [languages[b] if k else "und" for b, k in zip(best, known, strict=True)],
                    "score": np.where(known, p, 0.0),
                },
                schema,
            )

    return arrow_map(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    found = predict(docs, fit_from(docs))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
