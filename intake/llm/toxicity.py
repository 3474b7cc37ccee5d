"""Operator 8: toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

1. Terms are words and the first 3 to 6 characters of longer words, found once, twice or three times and
   more in a text. From a bounded sample of labelled rows those terms
   are taken whose documents are toxic far more often than others (the lower end of a Wilson interval).
2. Document frequencies of these terms are counted over all documents.
3. The labelled rows become unit vectors and an inverted index in blocks of ``BLOCK`` rows, with the
   highest weight of each term in each block. For a document, the blocks' upper bounds are summed; blocks are scored
   in falling order of their bound, until no bound left reaches the k-th best cosine.
   The neighbours are exact, the work is not spent on blocks that can't hold one.
4. Votes weighted by cosine give a raw score; pool-adjacent-violators on the labelled rows, each
   scored without itself, turns it into a share of toxic rows. The nearest rows are the evidence.

Only the index is sent to the tasks: at most ``MAX_LABELLED`` rows over ``MAX_TERMS`` terms. Scoring is a
map over rows without a shuffle.

Defined results: a null or empty text, as any text without a known term, scores the share of toxic rows among labelled
rows without one; with no labelled rows every score is 0; ties between neighbours go to the
lower row of the index; repeated rows are scored alike; an empty table gives an empty table; ``score``,
``predicted`` and ``evidence`` replace input columns of that name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intake.llm.common import drop_kept, give_back, list_array, map_slices

#: Most labelled rows in the index (in expectation; ids are drawn by their hash) and most terms.
MAX_LABELLED, MAX_TERMS = 12_000, 8192
#: Rows in a block of the index, neighbours that vote, and the weight of the prior among the votes.
BLOCK, NEIGHBOURS, PRIOR_WEIGHT = 64, 15, 0.5
#: A term needs this many labelled documents, and this much as the lower end of its toxic share at 95 %.
MIN_DOCS, MIN_SHARE = 4, 0.4
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6)
#: A term that occurs so often in a text is a term of its own too.
LEVELS = (1, 2, 3)
_WORDS = re.compile(r"\w+")
#: Distinct words kept in a worker's table of terms.
_KNOWN = 300_000


def word_terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def text_words(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def levels(counts: dict, name=lambda t, n: (t, n)) -> dict:
    """Counts of the terms at each level they reach."""
    return {name(t, k): n for t, n in counts.items() for k in LEVELS if n >= k}


def named(term: str, level: int) -> str:
    return term if level == 1 else f"{term} x{level}"


class Terms(dict):
    """The numbers of the known terms of each word, and from them the known terms of a text."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.base: dict[str, int] = {}
        self.known: dict[tuple[int, int], int] = {}
        for i, t in enumerate(terms):
            term, _, level = t.partition(" x")
            self.known[self.base.setdefault(term, len(self.base)), int(level or 1)] = i

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.base[t] for t in word_terms(word) if t in self.base)
        if len(self) >= _KNOWN:
            self.clear()
        if len(word) < 64:
            self[word] = found
        return found

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        for w, n in text_words(text).items():
            for t in self[w]:
                out[t] = out.get(t, 0) + n
        return {self.known[t]: n for t, n in levels(out).items() if t in self.known}


def select_terms(labelled: DataFrame, text_col: str) -> list[str]:
    """Terms of the labelled sample that mark toxic rows, best first."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen, bad = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: Counter = Counter()
                for w, n in text_words(text).items():
                    for t in word_terms(w):
                        found[t] += n
                terms = levels(found, named)
                seen.update(terms)
                if toxic:
                    bad.update(terms)
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], ["term", "n", "bad"])

        return work

    counted = map_slices(labelled.select(text_col, "_toxic"), "term string, n long, bad long", make, 1024).groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    z, p, n = 1.96, F.col("bad") / F.col("n"), F.col("n")
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    best = counted.where((n >= MIN_DOCS) & (low >= MIN_SHARE)).orderBy((low * F.log2(n + 1)).desc(), "term").limit(MAX_TERMS)
    return [r.term for r in best.collect()]


def document_frequencies(docs: DataFrame, terms: list[str], text_col: str) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each term, over all documents."""

    def run(batches):
        drop_kept()
        known, n, total = Terms(terms), 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                total[list(known.counts(text))] += 1
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(total[hit], n))], ["term", "n"])
        del known
        give_back()

    found = {r.term: r.n for r in docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(terms))], np.int64)


@dataclass
class Index:
    """Unit vectors of labelled rows by term: ``start[t]:start[t + 1]`` are the entries of a term, rows in order."""

    terms: list[str]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    start: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    block_start: np.ndarray = field(init=False)
    blocks: np.ndarray = field(init=False)
    block_max: np.ndarray = field(init=False)
    entry: np.ndarray = field(init=False)
    prior: float = field(init=False)
    cuts: np.ndarray = field(init=False)
    shares: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        term_of = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        first = np.flatnonzero(np.r_[True, (np.diff(term_of) != 0) | (np.diff(self.rows // BLOCK) != 0)]) if len(self.rows) else np.zeros(0, int)
        self.entry = np.append(first, len(self.rows))
        self.blocks = self.rows[first] // BLOCK
        self.block_max = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.block_start = np.searchsorted(term_of[first], np.arange(len(self.start)))
        bare = np.ones(len(self.ids), bool)
        bare[self.rows] = False
        among = self.toxic[bare] if bare.any() else self.toxic
        self.prior = float((among.sum() + 0.5) / (len(among) + 1)) if len(self.ids) else 0.0
        self._calibrate()

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.fromiter(counts, np.int64, len(counts))
        w = (1 + np.log(np.fromiter(counts.values(), float, len(counts)))) * self.idf[t]
        return t, w / (np.sqrt((w * w).sum()) or 1)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest labelled rows with a cosine over 0, best first."""
        spans = [np.arange(self.block_start[t], self.block_start[t + 1]) for t in terms]
        at = np.concatenate(spans) if spans else np.zeros(0, int)
        if not len(at):
            return np.zeros(0, int), np.zeros(0)
        q = np.repeat(weights, [len(s) for s in spans])
        bound = np.bincount(self.blocks[at], q * self.block_max[at])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rows, cosines, done, least = np.zeros(0, int), np.zeros(0), 0, 0.0
        while done < len(order) and (len(rows) < k or bound[order[done]] >= least):
            now = order[done : done + 8]
            chosen = np.zeros(len(bound), bool)
            chosen[now] = True
            hit = at[pick := chosen[self.blocks[at]]]
            sizes = self.entry[hit + 1] - self.entry[hit]
            pos = np.arange(sizes.sum()) + np.repeat(self.entry[hit] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
            found, where = np.unique(self.rows[pos], return_inverse=True)
            cos = np.bincount(where, np.repeat(q[pick], sizes) * self.weights[pos])
            if without >= 0:
                cos, found = cos[found != without], found[found != without]
            rows, cosines = np.append(rows, found), np.append(cosines, cos)
            top = np.lexsort((rows, -cosines))[:k]
            rows, cosines, done = rows[top], cosines[top], done + len(now)
            least = cosines[-1] if len(cosines) == k else 0.0
        return rows, cosines

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Share of the toxic among the neighbours, by cosine, with the prior as one more vote."""
        return float(((cosines * self.toxic[rows]).sum() + PRIOR_WEIGHT * self.prior) / (cosines.sum() + PRIOR_WEIGHT))

    def _calibrate(self) -> None:
        """Raw votes of the labelled rows, each without itself, pooled into shares that rise with the vote."""
        row_terms: dict[int, list[tuple[int, float]]] = {}
        for t in range(len(self.start) - 1):
            for e in range(self.start[t], self.start[t + 1]):
                row_terms.setdefault(int(self.rows[e]), []).append((t, self.weights[e]))
        raw, truth = [], []
        for r, pairs in row_terms.items():
            t, w = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            raw.append(self.vote(*self.nearest(t, w, without=r)))
            truth.append(int(self.toxic[r]))
        pools: list[list[float]] = []
        for x, y in sorted(zip(raw, truth, strict=True)):
            pools.append([x, x, y, 1.0])
            while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        # each pool at its middle, drawn towards one half by one row
        self.cuts = np.array([(p[0] + p[1]) / 2 for p in pools])
        self.shares = np.array([(p[2] + 0.5) / (p[3] + 1) for p in pools])

    def score(self, counts: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        if not counts or not len(self.cuts):
            return self.prior, np.zeros(0, int), np.zeros(0)
        rows, cosines = self.nearest(*self.vector(counts))
        if not len(rows):
            return self.prior, rows, cosines
        return float(np.interp(self.vote(rows, cosines), self.cuts, self.shares)), rows, cosines


def fit(docs: DataFrame, labelled: DataFrame, text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Index:
    """An index over ``labelled`` (doc_id, toxic) with the texts and the statistics of ``docs``. An id with both labels counts as toxic."""
    marked = labelled.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    n = marked.count()
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(max_labelled / max(n, 1) * (1 << 20)))
    sample = docs.select("doc_id", F.col(text_col).alias("_text")).join(chosen, "doc_id")
    terms = select_terms(sample, "_text")
    total, df = document_frequencies(docs, terms, text_col)
    idf = np.log((total + 1) / (df + 1)) + 1

    def make():
        known = Terms(terms)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [known.counts(t) for t in batch.column(2).to_pylist()]
            sizes = [len(c) for c in counts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), list_array([t for c in counts for t in c], sizes, pa.int32()), list_array([n for c in counts for n in c.values()], sizes, pa.int32())], ["doc_id", "toxic", "terms", "counts"]
            )

        return work

    rows = map_slices(sample.select(F.col("doc_id").cast("long"), "_toxic", "_text"), "doc_id long, toxic int, terms array<int>, counts array<int>", make).collect()
    rows.sort(key=lambda r: (-len(r.terms), sorted(r.terms), r.doc_id))  # alike rows share blocks, so that bounds are tight
    entries = []
    for r, row in enumerate(rows):
        if row.terms:
            w = (1 + np.log(np.array(row.counts, float))) * idf[list(row.terms)]
            entries += zip(row.terms, [r] * len(w), w / np.sqrt((w * w).sum()), strict=True)
    entries.sort()
    return Index(
        terms, idf, np.array([r.doc_id for r in rows], np.int64), np.array([r.toxic > 0 for r in rows], bool),
        np.searchsorted([e[0] for e in entries], np.arange(len(terms) + 1)), np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries], float),
    )


def score(docs: DataFrame, index: Index, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all, unless given) with ``score``, ``predicted`` and ``evidence`` (the nearest labelled ids)."""
    added = ("score", "predicted", "evidence")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    fields = [*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.LongType()))]
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        index = sent.value
        known = Terms(index.terms)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [index.score(known.counts(t)) for t in batch.column(len(keep)).to_pylist()]
            near = [index.ids[rows[:5]] for _, rows, _ in found]
            out = [pa.array([s for s, _, _ in found], pa.float64()), pa.array([int(s >= THRESHOLD) for s, _, _ in found], pa.int32()), list_array(np.concatenate(near) if near else [], [len(x) for x in near], pa.int64())]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *out], [f.name for f in fields])

        return work

    return map_slices(docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text_in")), T.StructType(fields), make)
