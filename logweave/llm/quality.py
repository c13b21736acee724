"""Quality scores by Bradley-Terry ranking: preference pairs, logistic loss on feature differences, quantile threshold.

A text becomes a vector of surface features (character kinds, and how varied and repeated its words and lines are) and of
content (the shares of its words' character trigrams, hashed). A pair prefers a document labelled 1 to one labelled 0, and the
probability that it wins is the logistic function of the difference of their scores w.x. The cut is a quantile of the
training scores, and the reported score maps the cut to the threshold. Null and empty texts have the feature vector of
an empty text; repeated rows and ties are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import ngrams
from logweave.llm.common import arrow_map, bounded_sample, byte_lists, crc_mod, first_rows, packed, utf8

#: Upper bound of the labelled rows that a fit gathers (their features only); the smallest hashes of the ids are taken.
MAX_FIT_ROWS = 20000
#: Preference pairs drawn for a fit.
PAIRS = 60000

_KIND = np.zeros(256, np.int64)  # 0 other
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[10] = 5
_KIND[[ord(c) for c in ".,;:'\"?()-"]] = 6
_KIND[ord("!")] = 7
_KIND[[ord(c) for c in "#$%&*@^~_+=<>{}[]\\/`"]] = 8
_KIND[ord("|")] = 9
_KIND[0x80:] = 10

#: Surface features, and bits of the hashed trigrams.
SURFACE, GRAMS = 20, 6
FEATURES = SURFACE + (1 << GRAMS)
_MAP = ngrams.letters_table(False)


def features(text: bytes) -> np.ndarray:
    """Shares of character kinds, how long, varied and repeated words and lines are, and the shares of hashed trigrams."""
    out = np.zeros(FEATURES)
    if not text:
        out[0] = 1
        return out
    n = len(text)
    counts = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=11) / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds, m = set(words), max(1, len(words))
    out[1:12] = np.sqrt(counts)
    out[12] = len(kinds) / m
    out[13] = np.log1p(m) / 10
    out[14] = (n - len(lines)) / m / 10
    out[15] = len(set(lines)) / max(1, len(lines))
    out[16] = np.log1p(n / max(1, len(lines))) / 10
    out[17] = len(kinds) / np.sqrt(m) / 20
    out[18] = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / m
    out[19] = sum(x.rstrip()[-1:] in (b".", b"?", b"!", b":") for x in lines) / max(1, len(lines))
    buf, _, _ = ngrams.joined([text], _MAP)
    inside = ngrams.gram_ids(buf, 3, GRAMS)[ngrams.inside_words(buf, 3)]
    out[SURFACE:] = np.sqrt(np.bincount(inside, minlength=1 << GRAMS) / max(1, len(inside)))
    return out


@dataclass
class QualityModel:
    """score(x) = logistic(steepness * (w.(x - centre)/scale - cut) + logit(threshold))."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    steepness: float
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        """The Bradley-Terry score itself."""
        return (x - self.centre) / self.scale @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.steepness * (self.strength(x) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, threshold: float = 0.7, pairs: int = PAIRS, steps: int = 300, decay: float = 1e-3, seed: int = 11) -> QualityModel:
    """Full-batch Nesterov descent on the pairwise logistic loss. Without both classes: a constant model."""
    x, y = np.asarray(x, float).reshape(-1, FEATURES), np.asarray(y)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    if not len(good) or not len(bad):
        cut = -1.0 if len(good) or not len(y) else 1.0
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), cut, 1.0, threshold)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    scale[SURFACE:] = scale[SURFACE:].max()  # one scale, so that rare buckets weigh little
    z, rng = (x - centre) / scale, np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, moving, rate = np.zeros(FEATURES), np.zeros(FEATURES), 4 / max(1e-9, np.linalg.eigvalsh(diff.T @ diff / pairs)[-1])
    for k in range(steps):
        ahead = w + k / (k + 3) * moving
        step = ahead + rate * (diff.T @ (1 / (1 + np.exp(np.clip(diff @ ahead, -30, 30)))) / pairs - decay * ahead)
        moving, w = step - w, step
    s = z @ w
    # The quantile whose threshold agrees with most labels, between two neighbouring scores.
    order = np.argsort(s, kind="stable")
    right = np.concatenate([[0], np.cumsum(y[order] != 1)]) + (y == 1).sum() - np.concatenate([[0], np.cumsum(y[order] == 1)])
    share = float(np.median(np.flatnonzero(right == right.max()))) / len(s)
    cut = float(np.quantile(s, min(1.0, share), method="midpoint"))
    spread = max(1e-6, float(np.median(s[good]) - cut), float(cut - np.median(s[bad])))
    return QualityModel(centre, scale, w, cut, 4 / spread, threshold)


def featurize(docs: DataFrame, keep: str = "doc_id long") -> DataFrame:
    """The kept columns, of type long, and the feature vector of every row's whole text."""
    names = [x.split()[0] for x in keep.split(", ")]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("features", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            yield packed({n: batch.column(n) for n in names} | {"features": [features(t) for t in byte_lists(batch)]}, schema)

    return arrow_map(docs.select(*names, utf8().alias("text")), run, f"{keep}, features array<double>")


def fit_from(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = MAX_FIT_ROWS) -> QualityModel:
    """Fit on at most `rows` labelled documents whose id's crc32 mod 4 isn't 2 (the bound is the parameter).

    Null labels, null ids and null texts aren't learnt from; with several labels of one document the lowest counts.
    """
    marked = labels.select("doc_id", F.col("quality").alias("_y")).where("doc_id is not null and _y is not null").groupBy("doc_id").agg(F.min("_y").alias("_y"))
    marked = marked.where(crc_mod("doc_id", 4) != 2)
    known = bounded_sample(marked, docs.where("text is not null").select("doc_id", "text"), rows)
    x = featurize(known.select(F.col("doc_id").cast("long"), F.col("_y").cast("long").alias("label"), "text"), "doc_id long, label long")
    sample = first_rows(x, rows).toPandas()
    return fit(np.array(sample["features"].tolist()), sample["label"].to_numpy(), threshold)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in byte_lists(batch)]).reshape(-1, FEATURES)
            yield packed({"doc_id": batch.column("doc_id"), "score": model.scores(x)}, schema)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), utf8().alias("text")), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit_from(docs, labels, threshold))
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    Rows are scored in place, so repeated ids and null ids keep their own decision.
    """
    model = fit_from(docs, labels, threshold)
    names = [f"keep_{c}" for c in docs.columns]  # so that no column clashes with the bytes

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in byte_lists(batch)]).reshape(-1, FEATURES)
            yield batch.select(names).filter(pa.array(model.scores(x) >= threshold))

    schema = ", ".join(f"`keep_{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kept = docs.select(utf8().alias("text"), *(F.col(f"`{c}`").alias(f"keep_{c}") for c in docs.columns))
    return arrow_map(kept, run, schema).select(*(F.col(f"`keep_{c}`").alias(c) for c in docs.columns))
