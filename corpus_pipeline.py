"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of
the pipeline (:func:`run`) writes it as Parquet in the shared folder and reads
it again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``.

1. language ID: documents without a known language go (where ``lang`` gives
   nothing to learn from, those without a letter);
2. exact dedup: one document of each group of equal texts stays;
3. SimHash near-dedup: one document of each component stays;
4. mixing: documents are taken as often as their source's target asks;
5. byte-level BPE: token counts and digests of what is left.

Null and empty texts leave at stage 1 (they have no language); repeated rows
meet at stage 2; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seatplan.llm import bpe, exact_dedup, language_id, mixing, simhash
from seatplan.plans.lineage import written

#: Hash functions, sampling keys and trained profiles have no form in DuckDB's
#: SQL; the run is tested against a brute-force version of each stage.
ORACLE_SQL = None

SHINGLE_WORDS, MAX_BITS = 3, 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_each(docs, SHINGLE_WORDS, MAX_BITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, vocabulary)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
