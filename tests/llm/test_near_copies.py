"""The pipeline's near-duplicate stage against brute-force Jaccard, and rows without an id."""

from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from intake.llm import components, jaccard, simhash
from intake.llm.common import sifted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """The least id of every component of Jaccard >= 0.8."""
    sets, parent = [words(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 5 * both >= 4 * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def stage(spark, docs):
    return dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SMALL)


def test_stage_is_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(r.doc_id for r in stage(spark, docs).collect()) == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("edits", [4, 9])
def test_large_groups(spark, edits):
    """Many copies of one text with words changed share keys that leaders alone don't settle, beside texts that share a line."""
    rng = np.random.default_rng(edits)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(120):
        t = list(base)
        for e in rng.choice(200, int(rng.integers(0, edits)), replace=False):
            t[e] = f"x{k}y{e}"
        rows.append((k, " ".join(t)))
    rows += [(200 + k, "one line that very many of the texts have in common " + " ".join(f"o{k}n{j}" for j in range(k % 12))) for k in range(60)]
    assert sorted(r.doc_id for r in stage(spark, table(spark, rows)).collect()) == brute_kept(rows)


def test_order_of_shingles_changes_no_pair():
    """Whatever is held as frequent, sets with a link share a shingle of their prefixes."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(-1000, 1000, n))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.93], rng.integers(-1000, 1000, n // 20)])
        known = np.unique(rng.integers(-1000, 1000, int(rng.integers(0, 200))))
        frequent = known, rng.permutation(len(known))
        if len(b) and jaccard.alike(a, b):
            assert len(np.intersect1d(jaccard.prefix(a, frequent), jaccard.prefix(b, frequent)))


def test_rows_without_an_id_and_repeated_ids(spark):
    """One row of every component stays, whatever ids its rows have."""
    text = lambda k: " ".join(f"t{k}n{j}" for j in range(30))
    rows = [(None, text(k)) for k in range(5)] + [(None, text(0)), (None, text(9)), (1, text(9)), (7, text(20)), (7, text(21)), (7, text(21)), (8, text(21))]
    kept = stage(spark, table(spark, rows)).collect()
    want = [(None, text(k)) for k in range(5)] + [(1, text(9)), (7, text(20)), (7, text(21))]
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in want)


def test_stage_goes_by_golay_keys(spark, monkeypatch):
    """Texts whose prints are within two bits are linked by operator 3's step alone, where no set meets a leader."""
    base = [f"w{i}" for i in range(2000)]
    rows = [(0, " ".join(base)), (1, " ".join([*base, "end"])), (2, " ".join(f"o{i}" for i in range(300)))]
    found = [jaccard.prints(jaccard.shingles(t))[0] for _, t in rows]
    assert ((found[0] ^ found[1]) & jaccard._ALL).bit_count() <= 2
    monkeypatch.setattr(jaccard, "_few", lambda led: led.select(F.col("set").alias("a"), F.col("leader").alias("b")).limit(0))
    monkeypatch.setattr(jaccard, "_may_link", lambda x, y: F.lit(False))
    assert sorted(r.doc_id for r in stage(spark, table(spark, rows)).collect()) == [0, 2]


def test_sifted_misses_no_key(spark):
    df = spark.range(-3000, 3000).select(F.xxhash64("id").alias("h"), "id")
    keys = df.where("id % 10 = 0").select("h")
    found = {r.id for r in sifted(df, F.col("h"), keys.union(keys), "may").where("may").collect()}
    assert {k for k in range(-3000, 3000) if k % 10 == 0} <= found
    assert len(found) < 700
    assert sifted(df, F.col("h"), keys.limit(0), "may").where("may").count() == 0


def test_rows_that_surely_stay_are_not_shuffled(spark, monkeypatch):
    """Only rows of which one of their component stays meet the others, not every text."""
    asked, sift = [], simhash.sifted

    def seen(df, key, keys, to):
        asked.append(keys.count())
        return sift(df, key, keys, to)

    monkeypatch.setattr(simhash, "sifted", seen)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    gone = docs.count() - stage(spark, docs).count()
    assert 0 < gone == asked[0]


def test_components_in_few_exchanges(spark, monkeypatch):
    """A round deals its edges out three times; chains and stars get their least node."""
    plans, cut = [], components.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return cut(df)

    monkeypatch.setattr(components, "cut", seen)
    edges = [(k, k + 1) for k in range(100)] + [(k, 500) for k in range(501, 560)] + [(7, 7), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(101), 0) | dict.fromkeys(range(500, 560), 500) | {900: 900, 901: 900}
    assert len(plans) > 2
    assert max(plans) <= 3
