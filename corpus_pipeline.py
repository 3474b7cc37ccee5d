"""A training-data pipeline of five stages over ``documents``; each is written as Parquet and read again by the next.

Defined results of every stage: an empty table gives an empty table with the same columns; columns beyond those of ``documents``
go, whatever their names; a null text counts as the empty one, and nulls of other columns stay. The stages state the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intake.llm import bpe, mixing, quality, simhash, toxicity
from intake.llm.common import bound_batches, shared_dir, table, unbound_batches
from intake.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't score as toxic. Texts without a known term (null and blank ones too) get the share of toxic rows among such labelled rows; repeated rows stay or go together."""
    bound_batches(spark)
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, index, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects. Null and blank texts go, as all of fewer than 20 words; repeated rows stay or go together."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.kept_rows(quality.decide(docs, rules), COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id; of its repeated rows the first by content. Null, empty and blank texts are one group; a row without an id stays only in a group without ids."""
    bound_batches(spark)
    return simhash.representatives(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn for its source; rows without a source are a source of their own, and repeated rows are drawn alike."""
    return mixing.mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, a row for each; null and empty texts have none."""
    bound_batches(spark)
    return bpe.code(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores, fingerprints and token ids have no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's rows are removed once the next has written its own; those of the last stay, as the result reads them."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    batches = bound_batches(spark)
    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _remove(spark, before)
            before = path
    finally:
        unbound_batches(spark, batches)
    return docs
