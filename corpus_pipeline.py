"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Defined cases: null and empty texts are scored like others (as is, the classifier rejects them), link
with nothing, have no passages or secrets, and have no ids; a null id stays null through all stages; rows
that share an id are judged one by one, but of near duplicates all rows with the least id stay; an empty
table gives an empty one; columns that the stages don't know are kept up to the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import decontaminate, ngram_join, quality, secrets, sentencepieces
from siftline.llm.common import materialise
from siftline.llm.queries import table, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, the document with the smallest id."""
    return ngram_join.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and source spans of what is left."""
    return sentencepieces.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality", good_quality), ("near duplicates", one_of_each), ("decontamination", uncontaminated), ("secrets", without_secrets), ("encode", encoded)]

#: The classifier's scores and the forest's can't be put as SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
