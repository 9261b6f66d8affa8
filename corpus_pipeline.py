"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents with benchmark passages go, the rest is mixed and written as token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm import decontam, mix, near, tokens, toxicity
from strandspark.llm.common import cut, fresh, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay as they are. A null or empty text has the score of an empty one; repeated rows and null keys stay or go by their text; without a toxic label, or without rows, nothing goes."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash balls or a Jaccard of 0.8 hold together the document of the smallest doc_id stays, nulls last; ties go to the smaller text hash, of equal rows one stays. Null and empty texts are one group. No rows give none."""
    return near.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten benchmark words stay as they are, null and empty texts and repeated rows too. Null items hit nothing, and neither does an empty benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that is taken twice is two rows of the same doc_id. A null source is a source, null and empty texts have size 0 and are taken as others of their source are; equal rows are counted singly; no rows give none."""
    names = fresh(docs.select("doc_id", "source"), *["_" * k + c for k, c in enumerate(docs.columns, 1)])
    own = dict(zip(docs.columns, names, strict=True)) | {"doc_id": "doc_id", "source": "source"}  # no clash with the names that mixing adds
    mixed = mix.mix(docs.withColumnsRenamed(own), mix.words(F.col(own["text"])))
    return mix.emit(mixed, [own[c] for c in docs.columns]).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of docs: where its ids begin, how many and their crc32, read back from the files. A null text is empty; null keys come first, equal keys by their texts' hash; no rows give none."""
    return tokens.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("token_ids", token_ids),
]
#: Learned weights, shingle sets and subword ids are beyond SQL; tests hold the stages against plainer versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = cut(docs)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
