"""Counts and base scores of op2 against plain counting; the model must beat its base on held-out texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
from conftest import SMALL

from intake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_base_and_gain(spark):
    texts = {r.doc_id: WORD.findall((r.text or "").translate(LOWER)) + [None] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts: Counter = Counter()
    for i, t in texts.items():
        if not held[i]:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op2_lm"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    late = [r for r in rows if r.held_out]
    assert sum(r.score for r in late) > sum(r.base_score for r in late)
