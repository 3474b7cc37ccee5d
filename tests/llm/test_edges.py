"""Every operator with nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import Row
from pyspark.sql import functions as F

from intake.llm import bpe, maxent, mixing, pages, quality, shards, simhash, spotsigs, toxicity, warc
from intake.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, replica string, parts string, cdf string, _id string, _row string, n_words string, token_ids string, fingerprint string, fp string, component_id string, spots string, _source string"
LONG = "lorem ipsum dolor " * 20_000 + "x" * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    clean = "The quick brown fox jumps over the lazy dog near the river bank while it rains on the old town wall today."
    texts = [clean, clean, clean + " Again.", None, "", "   \n\t ", LONG, "Ünïcode <|endoftext|> ΑΣ 中文 😀 a\x1cb", "one", "two words"]
    rows = [(i, t, "en", None if i == 3 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(0, clean, "en", "s0", len(clean)), (None, "no id here", "en", "s1", 10)]
    return spark.createDataFrame([(*r, 1.0, *["clash"] * 13) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    rows = bpe.code(docs, tokenizer_path(), decoded_to="decoded").collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids
        assert r.decoded == reference.decode(ids, skip_special_tokens=False)
    assert [r.back for r in bpe.decode(bpe.code(docs, tokenizer_path(), decoded_to="d"), tokenizer_path(), to="back").collect()] == [r.decoded for r in rows]
    assert bpe.code(none, tokenizer_path()).count() == 0


def test_maxent(docs, none):
    rows = maxent.score(docs.select("doc_id", "text"), F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == docs.count()
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert next(r for r in rows if r.doc_id == 3).n_tokens == 1
    untrained = maxent.score(docs.select("doc_id", "text"), F.lit(False)).collect()
    assert {(r.base_score, r.score, r.train_tokens) for r in untrained} == {(0.0, 0.0, 0)}
    assert maxent.score(none.select("doc_id", "text"), F.lit(True)).count() == 0


def test_maxent_is_a_distribution():
    hot = [b" ", *(f"w{i}".encode() for i in range(60))]
    model = maxent.Model(hot, np.arange(61, 0, -1), int(np.arange(61, 0, -1).sum()) + 5, 64, {"class": np.random.default_rng(0).normal(size=(1 << 12, maxent.CLASSES)).astype(np.float32), "place": np.zeros((1 << 12, maxent.WIDTH), np.float32)})
    history = np.array([3, 7])
    logs = [model.log10(np.array([*history, i]), np.array([0]))[-1] for i in range(len(hot))]
    rare = model.log10(np.array([*history, len(hot)]), np.array([0]))[-1]
    tail = sum(10 ** (rare + np.log10((c + maxent.ALPHA) / model.tail_total)) for c in (2, 2, 1, 0))
    assert sum(10**x for x in logs) + tail == pytest.approx(1, abs=1e-4)


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    small = {r.doc_id: r.text for r in docs.collect() if r.doc_id != 6}
    prints = {i: brute_fingerprint(t) for i, t in small.items()}
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] for r in rows if r.doc_id != 6)
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert simhash.representatives(docs).where("doc_id in (0, 1)").count() == 1
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.representatives(none).count() == 0


def test_simhash_links_of_hot_keys(spark):
    """Large groups give the components that all pairs would."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    found = {centre}
    for _ in range(150):
        x = rng.choice(np.array(sorted(found), dtype=np.uint64))
        found.add(int(x) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    found |= {int(x) for x in rng.integers(1 << 62, size=100)}
    prints = np.array(sorted(found), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    from intake.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    parent = {int(x): int(x) for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in prints:
        for y in prints[np.bitwise_count(prints ^ x) <= 2]:
            a, b = find(int(x)), find(int(y))
            parent[max(a, b)] = min(a, b)
    signed = lambda x: int(np.uint64(x).view(np.int64))
    mine: dict = {}
    for x in prints:
        mine.setdefault(roots.get(signed(x), signed(x)), set()).add(int(x))
    want: dict = {}
    for x in prints:
        want.setdefault(find(int(x)), set()).add(int(x))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_mixing(docs, none, monkeypatch):
    rows = mixing.mix(docs).collect()
    assert rows == mixing.mix(docs).collect()
    counts = Counter(r.doc_id for r in rows)
    assert {(r._source, r._id, r.parts, r.cdf, r._row) for r in rows} == {("clash",) * 5}
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == counts
    assert mixing.mix(docs, weights={"s0": 1.0}, scale=200.0).where("source <> 's0'").count() == 0
    many = mixing.mix(docs, weights={"s0": 1.0}, scale=200.0).count()
    assert abs(many - 200 * docs.count()) < 6 * (200 * docs.count()) ** 0.5 * 2
    assert mixing.mix(none).count() == 0


def test_shards(docs, none, tmp_path):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    rows = shards.materialise(docs, str(tmp_path), path, P.PATTERN).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    enc, got = shards.tokenizer(path, P.PATTERN), Counter()
    parts = {}
    for d, s, ids in shards.read(str(tmp_path), 0, len(rows)):
        parts.setdefault(d, {}).setdefault(s, []).append(ids)
    for r in docs.collect():
        key = -1 if r.doc_id is None else r.doc_id
        assert enc.decode([i for s in sorted(parts[key]) for i in parts[key][s][0]][:-1]) == (r.text or "")
        got[key] += 1
    assert all(len(parts[k][0]) == n for k, n in got.items())
    assert shards.materialise(none, str(tmp_path / "none"), path, P.PATTERN).count() == 0


def test_spotsigs(docs, none):
    rows = spotsigs.fingerprints(docs).collect()
    assert len(rows) == docs.count()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    texts = [r.text or "" for r in order]
    want = Counter()
    for k, t in enumerate(texts):
        h, n = len(t) // 2, texts[(k + 1) % len(texts)]
        want[order[k].doc_id, hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, hashlib.sha256(r.edited.encode()).hexdigest()) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert spotsigs.fingerprints(none).count() == 0


def test_warc(spark):
    df = spark.createDataFrame([("http://a/1", "<html lang=en><title>T &amp; t</title><p>One <b>two</b><script>no</script><p>three <a href='/x'>four</a>", "x"), (None, None, "y")], "url string, html string, type string")
    rows = warc.derive(warc.responses(df)).collect()
    assert Counter(r.type for r in rows) == {"response": 2, "metadata": 2, "conversion": 2}
    ids = {r.record_id for r in rows if r.type == "response"}
    assert {r.refers_to for r in rows if r.type != "response"} == ids
    assert "T & t\nOne two\nthree four" in {r.block for r in rows}
    assert all(next(warc.from_bytes(warc.to_bytes(r))) == tuple(r) for r in rows)


def test_warc_files(spark, tmp_path):
    records = warc.derive(warc.responses(spark.read.parquet(f"{SMALL}/pages.parquet").limit(20)))
    assert warc.write_warc(records, str(tmp_path)).agg(F.sum("records")).first()[0] == 60
    assert sorted(map(tuple, warc.read_warc(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, records.collect()), key=str)


def test_toxicity(spark, docs, none):
    words = ["alpha beta gamma", "delta kind words here", "vile scum of them", "nothing else to say"]
    rows = [(i, f"{words[i % 4]} number{i}") for i in range(200)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 2)) for i in range(0, 200, 2)], "doc_id long, toxic int")
    index = toxicity.fit(many, labels)
    scored = {r.doc_id: r for r in toxicity.score(many, index).collect()}
    assert all(r.predicted == int(i % 4 == 2) for i, r in scored.items())
    assert len(toxicity.score(docs, index).collect()) == docs.count()
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, blank).collect()} == {0}
    assert toxicity.score(none, index).count() == 0


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    n, t = 500, 40
    dense = np.where(rng.random((n, t)) < 0.1, rng.random((n, t)), 0)
    norm = np.sqrt((dense**2).sum(1, keepdims=True))
    dense = dense / np.where(norm == 0, 1, norm)
    term, row = np.nonzero(dense.T)
    index = toxicity.Index([f"t{i}" for i in range(t)], np.ones(t), np.arange(n), rng.random(n) < 0.3, np.searchsorted(term, np.arange(t + 1)), row, dense.T[term, row])
    for q in range(30):
        terms = np.flatnonzero(dense[q])
        if len(terms):
            _, cosines = index.nearest(terms, dense[q][terms])
            assert cosines == pytest.approx(np.sort((dense @ dense[q]))[::-1][: len(cosines)])


def test_quality(docs, none, spark):
    rules = quality.fit(docs, spark.createDataFrame([(0, 1), (8, 0)], "doc_id long, quality int"))
    lines = docs.where("doc_id = 8").withColumn("text", F.lit("a # b\n\n \t\na # b\n<x> & y|\r\na # b\n<x> & y|\r\n  a # b"))
    docs = docs.unionByName(lines)
    rows = quality.decide(docs, rules).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality.decide(none, rules).count() == 0


def test_quality_rules_separate():
    rng = np.random.default_rng(3)
    x = {f: rng.random(2000) for f in quality.FEATURES}
    bad = (x["f_symbols"] > 0.7) | ((x["f_upper"] > 0.8) & (x["f_lone"] < 0.5))
    rules = quality.learn(x, bad, np.arange(2000) % 3 > 0)
    hit = np.zeros(2000, bool)
    for r in rules:
        hit |= quality._covers(r, x, np.ones(2000, bool))
    assert (hit == bad).mean() > 0.97


def test_pages(spark):
    rows = [(1, "http://a/1", "<body><div>Home News Sport Weather Contact us</div><div>One unique story about things told here</div><div class='comments'>bad</div>"),
            (2, "http://a/2", "<body><div>Home News Sport Weather Contact us</div><div>Another tale that no page else has printed</div>"),
            (3, "http://a/3", "<body><div>Home News Sport Weather Contact us</div><div>Third text with its own words 1 < 2</div>"),
            (4, None, None), (5, "x", ""), (6, "http://a/6", "<nav>m</nav><article><h1>T&eacute;</h1><p>Body  text<br>more<aside>no</aside><p>tail</article><footer>f"), (6, "http://a/6", "<nav>m</nav><article><h1>T&eacute;</h1><p>Body  text<br>more<aside>no</aside><p>tail</article><footer>f")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert got == {1: "One unique story about things told here", 2: "Another tale that no page else has printed", 3: "Third text with its own words 1 < 2", 4: "", 5: "", 6: "Té\nBody text more\ntail"}
    assert pages.main_text(df).count() == 7
    assert pages.main_text(df.limit(0)).count() == 0


def test_suffix_windows_match_counting():
    rng = np.random.default_rng(4)
    streams = [[f"t{k}" for k in rng.integers(0, 4, int(rng.integers(0, 40)))] for _ in range(12)]
    want: Counter = Counter()
    for s in streams:
        want.update({xxhash.xxh64_intdigest(" ".join(s[i : i + pages.RUN])) >> 1 for i in range(len(s) - pages.RUN + 1)})
    assert pages.host_windows(streams) == dict(want)


def test_queries_return_whole_tables(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op1_bpe", "op3_simhash", "op6_spotsigs", "op8_toxicity", "op10_quality"):
        assert QUERIES[name](spark, SMALL).count() == n, name


def test_pipeline_against_its_operators(spark):
    """Stage by stage: what goes is what the operator rejects, and the rest keeps its columns."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    named = dict(c.STAGES)
    calm = named["toxicity"](spark, docs, SMALL)
    index = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, index).where("predicted = 1").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in calm.collect()} == rejected
    good = named["quality"](spark, docs, SMALL)
    rules = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.decide(docs, rules).collect() if r.kept}
    single = named["near_duplicates"](spark, docs, SMALL)
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert len(single.collect()) == simhash.near_duplicates(docs).select("component_id").distinct().count()
    kept = [prints[r.doc_id] for r in single.collect()]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(kept) for b in kept[:i])
    for s in (calm, good, single, named["mixing"](spark, docs, SMALL)):
        assert s.columns == list(c.COLUMNS)
    assert c.run(spark, SMALL).where("token_ids is null").count() == 0


def test_warc_cut_off_and_bare_records(spark):
    """Whole records before a cut are read, wherever it is; a response without digest, date or URI is derived."""
    made = [warc.response(f"http://a/{i}", f"<p>page {i} ü</p>") for i in range(3)]
    single = [warc.to_bytes(Row(*(f.name for f in warc.RECORD.fields))(*r)) for r in made]
    for packed in (lambda b: b, lambda b: gzip.compress(b, mtime=0)):
        parts = [packed(b) for b in single]
        data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
        for at in range(0, len(data) + 1, 7):
            got = list(warc.from_bytes(data[:at]))
            assert got == made[: len(got)]
            assert len(got) >= (ends <= at).sum()
    bare = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nH\r\n\r\n<p>hi"
    assert [r[0] for r in warc.from_bytes(b"WARC/1.0\r\nContent-Length: many\r\n\r\n" + bare + b"\r\n\r\n" + bare[:-1])] == ["response"]
    rows = warc.derive(spark.createDataFrame([*warc.from_bytes(bare + b">>>>"), ("response", *[None] * 10)], warc.RECORD)).collect()
    assert Counter(r.type for r in rows) == {"response": 2, "metadata": 2, "conversion": 2}
    assert {r.payload_digest for r in rows} == {None}
