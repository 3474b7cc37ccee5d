"""What the pipeline's tasks hold at once, and what a worker holds between them."""

from __future__ import annotations

import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from intake.llm import bpe, common, jaccard, simhash
from intake.llm.queries import tokenizer_path

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


class Frame:
    """Gives the function that a task would run."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_word_caches_go_when_another_operator_begins():
    words = pa.RecordBatch.from_arrays([pa.array(["a word"])], ["text"])
    same = lambda: lambda batch: batch
    bpe.load(tokenizer_path()).encode("a word")
    list(common.map_slices(Frame(), None, same, keeps="bpe")(iter([words])))
    assert bpe.load.cache_info().currsize == 1
    list(jaccard._met(iter([])))
    assert bpe.load.cache_info().currsize == 0
    bpe.load(tokenizer_path())
    list(common.map_slices(Frame(), None, same)(iter([words])))
    assert bpe.load.cache_info().currsize == 0


def test_golay_table_is_made_in_blocks():
    tracemalloc.start()
    made = simhash._decoder.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert (np.bincount(made) == 1 << 11).all()  # the code is perfect: every codeword has as many vectors


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "bpe"])
def test_batches_are_bounded_by_bytes(spark, stage):
    """Rows of long texts don't come 10,000 at once."""

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], ["n"])

    spark.conf.unset(LIMIT)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("word "), 600).alias("text"))
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs, SMALL)
        assert texts.mapInArrow(largest, "n long").first().n < 5 << 20
    finally:
        spark.conf.unset(LIMIT)


def test_run_leaves_the_session_as_it_was(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("only", lambda s, docs, d: seen.append(s.conf.get(LIMIT)) or docs)])
    for before in (None, "7m"):
        spark.conf.unset(LIMIT) if before is None else spark.conf.set(LIMIT, before)
        try:
            corpus_pipeline.run(spark, SMALL)
            assert spark.conf.get(LIMIT, None) == before
        finally:
            spark.conf.unset(LIMIT)
    assert seen == [common.BATCH] * 2
