"""Every pipeline stage on nulls, empty and very long texts, repeated rows, clashing columns and an empty table."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from intake.llm.queries import tokenizer_path

NAMES = ("score", "predicted", "evidence", "kept", "rule", "n_words", "_row", "_id", "_i", "_t1", "root", "fp", "component_id", "_copies", "_place", "_source", "token_ids", "_text_in")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
CLEAN = "The quick brown fox jumps over the lazy dog near the river bank while it rains on the old town wall today."
LONG = " ".join(f"word{i}" for i in range(60_000))
TEXTS = [(0, CLEAN), (0, CLEAN), (1, CLEAN), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "x" * 50_000), (7, "two words"), (None, CLEAN.replace("fox", "cat").replace("wall", "gate")), (None, None)]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 1 else "en", None if i == 0 else "s", None if t is None else len(t), *["clash"] * len(NAMES)) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, docs, name):
    none = STAGES[name](spark, docs.limit(0), SMALL)
    assert none.count() == 0
    assert name == "bpe" or none.columns == list(corpus_pipeline.COLUMNS)


def test_toxicity(spark, docs):
    """None of these texts holds a toxic term, so all stay, with their nulls."""
    kept = STAGES["toxicity"](spark, docs, SMALL)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, docs.select(*corpus_pipeline.COLUMNS).collect()))


def test_quality(spark, docs):
    kept = pairs(STAGES["quality"](spark, docs, SMALL))
    assert all(len(re.findall(r"\S+", t or "")) >= 20 for _, t in kept)
    assert kept[0, CLEAN] == 2 and kept[1, CLEAN] == 1


def test_near_duplicates(spark, docs):
    kept = pairs(STAGES["near_duplicates"](spark, docs, SMALL))
    assert kept == Counter([(0, CLEAN), (2, None), (5, LONG), (6, "x" * 50_000), (7, "two words"), TEXTS[9]])


def test_mixing(spark, docs):
    """Copies are of given rows, equal rows are drawn alike, and a second run draws the same."""
    mixed = STAGES["mixing"](spark, docs, SMALL)
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    got = pairs(mixed)
    assert set(got) <= set(TEXTS) and got[0, CLEAN] % 2 == 0
    assert pairs(STAGES["mixing"](spark, docs, SMALL)) == got


def test_bpe(spark, docs):
    reference = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, tuple(reference.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in STAGES["bpe"](spark, docs, SMALL).collect()) == want


def test_run_keeps_the_last_stage_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [p.name for p in next(tmp_path.iterdir()).iterdir()] == ["4-bpe"]
