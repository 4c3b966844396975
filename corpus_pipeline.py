"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and its result is
written and read again before the next.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daybook.llm import jaccard_join, langid, packing, pii, toxicity
from daybook.llm.common import cut, table

WORD_VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents predicted toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents for which no language is found (no text, no letter) go."""
    return langid.keep_identified(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of documents linked at a similarity of 0.8 or more, one stays."""
    return jaccard_join.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data give way to surrogates."""
    return pii.replace_entities(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: pieces of the documents with their places in the sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Learned models and tokenizers are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position + 1 < len(STAGES):
            docs = cut(docs)
    return docs
