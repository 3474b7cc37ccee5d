"""Spelling variants against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from conftest import SMALL

from intake.llm import variants

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: v if v and words[v] >= 5 * words[w] else None for w, v in form.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def made(df):
    return sorted(tuple(r) for r in variants.groups(df).select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_whole_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    expected = plain(rows)
    assert made(table) == expected and len(expected) > 100


def test_chains_ties_and_letters(spark, monkeypatch):
    """Forms of forms over several steps, anagrams, letters beyond a-z, and blocks in many chunks."""
    monkeypatch.setattr(variants, "BASE", 3)
    monkeypatch.setattr(variants, "PROBE", 5)
    rng, rows, word = random.Random(5), [], "planétes"
    for k in range(5):
        rows.append((k, f"{word} " * 5 ** (5 - k)))
        word = word[:k] + "q" + word[k + 1 :]
    for k in range(400):
        w = list("straßenÄÿ÷cdef")[: rng.randint(5, 14)]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("aeÀÿ×zß")
        rows.append((1000 + k, f"{''.join(w)}, " * rng.choice((1, 2, 5, 30, 200)) + "abcdef.abcdfe-abcdeg " * 3))
    expected = plain(rows)
    assert made(spark.createDataFrame(rows, SCHEMA)) == expected
    assert any(r[3] and r[3] != r[5] for r in expected) and sum(r[2] for r in expected) > 100


def test_edges(spark):
    assert made(spark.createDataFrame([], SCHEMA)) == []
    rows = [(None, "colour " * 9), (None, None), (1, ""), (1, "中文 12 a b"), (2, "color " * 3), (2, "color " * 3), (3, "colours " * 100_000), (4, "x" * 1_000_000 + " ")] + [(5 + i, "y" * 300_000 + " colour") for i in range(6)]
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS word", "1 AS n", "2 AS block", "3 AS near")
    assert made(extra) == plain(rows)
