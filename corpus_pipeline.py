"""A training corpus from `documents`: filter, deduplicate, decontaminate, mix and encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the documents of the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import decontaminate, mixing, packing, simhash, toxicity
from plotweave.llm.common import shared_dir, table
from plotweave.llm.queries import END_ID, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the classifier learns from the labelled rows that are not held out."""
    scored = toxicity.score(docs, toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels")))
    kept = scored.where(F.col(scored.columns[-1]) < 0.7)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id: shingles of five words, similarity 0.8 or more.

    Candidates are documents whose SimHash fingerprints multi-index hashing links, and, since
    fingerprints answer only for closer copies than these, documents that share a band of least hashes.
    """
    return simhash.first_of_each(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a 13-word window of a test item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, none at all included."""
    return mixing.repeat_rows(docs, mixing.mix(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file's index: where each copy of a document starts, its length, and the ids' CRC-32, read back from the file."""
    return packing.read_documents(spark, packing.write_tokens(docs, tokenizer_path(), end_id=END_ID, keep_encoder=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token packing", encode_tokens),
]

#: Learnt weights, hashed fingerprints and tokenizers have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
