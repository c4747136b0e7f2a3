"""From raw documents to a tokenised training mix, in five stages.

Each stage takes all that its predecessor kept and returns whole documents (the last one their ids):
quality rules reject documents, of each class of near duplicates one stays, personal
data are replaced, sources are mixed to their weights (documents may then occur up to
three times), and the mix is encoded.

Defined results of every stage: a null text is an empty one; nulls in other columns are kept as they are; repeated rows are rows of
their own (of which the near-duplicate stage keeps one); an empty table gives an empty one; columns of other names, whatever they
are, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import bpe, minhash, mixing, pii, quality
from tidewright.llm.common import written
from tidewright.llm.queries import surrogate_key
from tidewright.sources.code import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the likelihood ratio. Empty and short texts fail; without labels only the rules decide."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_documents(spark, docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least id. Documents without words are alike only if their texts are equal."""
    return minhash.keep_one(ship(spark), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts; n_chars, where there is one, follows. A null text stays null."""
    return pii.safe_documents(ship(spark), docs, surrogate_key(spark))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times. A null source is a source; documents without words aren't taken."""
    return mixing.mixed_documents(ship(spark), docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document of the mix."""
    return bpe.encode_decode(ship(spark), docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("bpe_ids", bpe_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near duplicates have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None
