"""Classes of spot signatures, and signatures and likeness themselves, against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from intake.llm import spotsigs
from intake.llm.queries import QUERIES


def brute(rows):
    """The least id of the class of every row (id, set)."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            both = len(a & b)
            if (not a and not b) or 5 * both >= 4 * (len(a) + len(b) - both) > 0:
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def spots(text):
    """Signatures as tuples of words."""
    common, w, word = set(spotsigs.COMMON), [spotsigs.START], ""
    for c in (text or "").lower() + " ":
        if c.isalnum() or (word and __import__("unicodedata").category(c)[0] == "M"):
            word += c
        elif word:
            w.append(word)
            word = ""
    out = set()
    for i, a in enumerate(w):
        after = [x for x in w[i + 1 :] if x not in common]
        if (a in common or i == 0) and after:
            out.add((a, after[0], after[1] if len(after) > 1 else None))
    return out


def classes(spark, df):
    return sorted(((r.doc_id, r.class_id) for r in spotsigs.classes(df).collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, spots(r.text)) for r in docs.collect()]
    got = QUERIES["spot_classes"](spark, SMALL).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute(rows)


def test_signatures_and_likeness(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id")
    texts = [r.text or "" for r in docs.collect()]
    sets = [spots(t) for t in texts]
    rows = spotsigs.fingerprints(docs).orderBy("doc_id").collect()
    for k, r in enumerate(rows):
        a, b = sets[k], sets[(k + 1) % len(sets)]
        assert len(r.spots) == len(a)
        assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_large_group_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = [("the " if k % 3 == 0 else "") + f"w{k}" for k in range(180)]
    rows = []
    for k in range(90):
        t = list(base)
        for e in rng.choice(180, int(rng.integers(0, 12)), replace=False):
            t[e] = f"x{k}y{e}"
        rows.append((k, " ".join(t)))
    rows += [(200, None), (201, ""), (None, " \n"), (202, "the of and"), (None, rows[0][1]), (203, rows[0][1]), (203, rows[1][1]), (204, "the word " * 5000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, class_id string, set int")
    assert classes(spark, df) == brute([(i, spots(t)) for i, t in rows])
    assert spotsigs.classes(df.limit(0)).count() == 0
    assert spotsigs.classes(df.withColumn("doc_id", F.lit(None).cast("long"))).where("class_id is not null").count() == 0


def test_sketches_are_made_once_a_set(spark, monkeypatch):
    """The sums over a set's signatures are not worked out again for each of its keys."""
    plans, cut = [], spotsigs.cut

    def seen(df):
        if "leader" in df.columns:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(spotsigs, "cut", seen)
    spotsigs.classes(spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the dog sat on the mat")], "doc_id long, text string"))
    assert len(plans) == 1
    assert "aggregate(" not in plans[0][: plans[0].index("Generate posexplode")]
