"""The manifest against a plain tree, over ids of every kind."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from intake.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def paths(digests):
    """The top of a tree, and for each leaf its siblings (left, right) by level."""
    found, nodes = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for start in range(0, len(nodes), 16):
            run = nodes[start : start + 16]
            for k, (_, below) in enumerate(run):
                for i in below:
                    found[i].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
            above.append((digest(*(d for d, _ in run)), [i for _, b in run for i in b]))
        nodes = above
    return nodes[0][0], found


def plain(rows):
    by: dict = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        rows = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (rows, *paths([leaf(r) for r in rows]))
    root, above = paths([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, above):
        for row, path in zip(trees[s][0], trees[s][2]):
            path = path + up
            tampered = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 5 == 0 and row[4] is not None
            lower = row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            fold = leaf((*row[:4], lower)) if tampered else leaf(row)
            for left, right in path:
                fold = digest(left, fold, right)
            out.append((row[0], leaf(row), trees[s][1], root, digest(*(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=repr)


def made(df):
    found = manifest.manifest(df, manifest.tampered_rows(F.col("doc_id")))
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


CASES = {
    "dense and one source of many levels": [(i, "a", "en", i, f"Text {i}") for i in range(300)] + [(7, "b", "en", 1, "Alone")],
    "sixteen and seventeen": [(i, "s16", None, None, "X") for i in range(16)] + [(i, "s17", None, None, "X") for i in range(17)],
    "spread ids": [(k, s, "en", 3, f"T{k}") for s in ("x", "y", None) for k in (-(2**63), -(2**57), -65, -64, -1, 0, 63, 64, 2**20, 2**40, 2**63 - 1)],
    "nulls, repeats and ties": [(None, None, None, None, None), (None, None, "en", None, "A"), (None, None, "en", None, "A"), (5, "", "en", 1, ""), (5, "", "en", 1, ""), (5, "", "de", 1, "B"), (6, "é", "en", 2, "Straße ÀB"), (5, "null", None, 0, None)] + [(9, "big", "en", 1, f"V{i % 7}") for i in range(60)],
    "many sources": [(i, f"host{i}", "en", i, "Text") for i in range(300)],
}


@pytest.mark.parametrize("case", CASES)
def test_against_plain_trees(spark, case):
    rows = CASES[case]
    assert made(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_empty_long_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert made(empty) == []
    rows = [(1, "a", "en", 1, "Long " * 2_000_000), (2, "a", "en", 1, "b")]
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS slot", "2 AS w", "3 AS digest", "4 AS id", "5 AS path", "6 AS total", "7 AS h", "8 AS _id")
    assert made(extra) == plain(rows)
