"""The corpus pipeline: five stages from raw documents to token ids, each written as Parquet and read by the next.

1. quality: documents whose quality score stays below 0.7 go.
2. near_duplicates: of documents linked by 80 % of their 5-word shingles the one with the smallest id stays.
3. repeats: strings of REPEAT_BYTES bytes that also start elsewhere, and shorter passages of REPEAT_WORDS words that are
   also elsewhere, are taken out; a document of which only white space is left goes.
4. decontamination: documents that hold ten consecutive words of a benchmark item go.
5. sentencepiece: what is left is encoded; a document comes out with its best segmentation and the gap to the next one.

Stages 1 to 4 return the columns of documents. Null ids and null or empty texts pass the stages that have nothing to say
about them: a null text has the features of an empty one, is in no group, repeats nothing and has no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import decontaminate, neardup, pieces, quality, repeats
from logweave.llm.common import materialize, table, tokenizer_path

#: Length of a repeated string: below that of most passages of over 50 words, above that of common lines.
REPEAT_BYTES = 250
#: Words of a repeated passage: over 50. Short words need as few as 101 bytes for them, so such passages are found by words.
REPEAT_WORDS = 51


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs, size=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs, REPEAT_BYTES, REPEAT_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), 10)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.segment(docs, tokenizer_path("piece_bpe_32k.model"), 2)
    best = F.col("segmentations")[0]
    gap = F.when(F.size("segmentations") > 1, best["score"] - F.col("segmentations")[1]["score"])
    return found.select("doc_id", best["ids"].alias("ids"), F.size(best["ids"]).cast("long").alias("n_pieces"), best["score"].alias("score"), gap.alias("gap"), F.col("decoded").alias("text"))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeats", repeated_strings),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Classifiers, suffix order and tokenizers have no SQL form; tests/llm checks the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
