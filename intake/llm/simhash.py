"""Operator 3: SimHash near-duplicates found with Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at
most two bits agree fully in some segment, and every other segment holds at most two errors. A
segment with up to two errors is matched by the perfect Golay code [23, 12, 7]: a 23-bit vector's
keys are the indices of the codewords that it and its one-bit neighbours decode to (six at most),
and two vectors within two bits share one. So each fingerprint gets, for every segment, its exact bits together
with the Golay keys of the next segment: at most 18 keys of 34 bits, and each link shares one.

Exact copies fall together before any key is made. Keys with few fingerprints give pairs, which are
verified. Keys with more than ``SMALL`` give no pairs: their fingerprints are dealt by all vectors
within one bit, where fingerprints that meet are within two bits of each other, so that a star to the
least one holds the same components; this grows with the number of fingerprints only.

Defined results: a null or blank text has fingerprint zero and is linked as any other; repeated rows
keep their rows; an empty table gives an empty table; columns other than the id and the text are kept by
``near_duplicates``, but those named as its outputs are replaced.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intake.llm import jaccard
from intake.llm.common import cut, drop_kept, sifted, words_of, worker_cache
from intake.llm.components import components

#: Keys with at most this many fingerprints are compared pair by pair.
SMALL = 16
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15
#: Vectors that are decoded at once.
_DECODED = 1 << 18
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23.
_GOLAY = 0b101011100011


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles as an unsigned int."""
    w = words_of(text)
    if not w:
        return 0
    joined, size = b" ".join(w), min(size, len(w))
    ends = list(accumulate(map(len, w), lambda a, b: a + b + 1))
    grams = (joined[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[size - 1 :], strict=False))
    n = len(w) - size + 1
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, n, _BLOCK):
        k = min(_BLOCK, n - start)
        h = np.fromiter((digest(next(grams), 42) for _ in range(k)), np.uint64, k)
        counts += np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, size: int = 3) -> Column:
    """Fingerprints as signed longs."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return simhash(F.coalesce(text, F.lit("")))


def _syndrome(vectors: np.ndarray) -> np.ndarray:
    syndrome = vectors.copy()
    for bit in range(22, 10, -1):
        syndrome ^= np.where(syndrome >> bit & 1, np.uint32(_GOLAY << (bit - 11)), np.uint32(0))
    return syndrome


@worker_cache("golay", maxsize=1)
def _decoder() -> np.ndarray:
    """Index of the nearest codeword of every 23-bit vector. Made block by block: a step over all of them at once takes 32 MB."""
    one = [1 << k for k in range(23)]
    errors = [0, *one, *(a | b for a in one for b in one if a < b), *(a | b | c for a in one for b in one if a < b for c in one if b < c)]
    error_of = np.zeros(1 << 11, np.uint32)
    error_of[_syndrome(np.array(errors, np.uint32))] = errors
    out = np.empty(1 << 23, np.uint16)
    for start in range(0, len(out), _DECODED):
        vectors = np.arange(start, start + _DECODED, dtype=np.uint32)
        out[start : start + _DECODED] = (vectors ^ error_of[_syndrome(vectors)]) >> 11
    return out


def golay_keys(segment: np.ndarray, bits: int) -> np.ndarray:
    """For each segment, the codeword indices that it and its one-bit neighbours decode to; -1 fills repeats."""
    flips = np.array([0, *(1 << k for k in range(bits))], np.uint32)
    keys = np.sort(_decoder()[segment.astype(np.uint32)[:, None] ^ flips].astype(np.int64), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def _keys(fp: np.ndarray) -> list[np.ndarray]:
    fp = fp.view(np.uint64)
    cut_out = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    found = []
    for i, exact in enumerate(cut_out):
        j = (i + 1) % 3
        golay = golay_keys(cut_out[j], SEGMENTS[j][1])
        found.append(np.where(golay < 0, -1, i << 40 | exact[:, None] << 12 | golay))
    return [row[row >= 0] for row in np.concatenate(found, axis=1)]


def links(prints: DataFrame) -> DataFrame:
    """``prints`` (distinct fp) -> edges (a, b) whose components are those of all pairs within two bits."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(fp: pd.Series) -> pd.Series:
        drop_kept("golay")
        return pd.Series(_keys(fp.to_numpy(np.int64)))

    # most keys have one fingerprint: these are dropped in the one shuffle of all keys
    order = Window.partitionBy("key").orderBy("fp")
    keyed = prints.select("fp", F.explode(keys("fp")).alias("key")).withColumns({"_before": F.lag("fp").over(order), "_after": F.lead("fp").over(order)})
    met = cut(keyed.where("_before is not null or _after is not null").select("fp", "key"))
    shared = cut(met.join(met.groupBy("key").count(), "key"))
    pairs = (
        shared.where(F.col("count") <= SMALL).groupBy("key").agg(F.collect_list("fp").alias("g"))
        .select(F.explode(F.expr("flatten(transform(g, x -> transform(filter(g, y -> y > x and bit_count(x ^ y) <= 2), y -> struct(x as a, y as b))))")).alias("p"))
        .select("p.a", "p.b")
    )
    ball = F.expr("concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))")
    near = shared.where(F.col("count") > SMALL).select("fp").distinct().select("fp", F.explode(ball).alias("z"))
    stars = near.join(near.groupBy("z").agg(F.min("fp").alias("m")), "z").where("fp <> m").select("fp", "m")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: bool = False) -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (16 hex digits) and ``component_id``, the least id of its component.

    Components are those of texts that share most of their shingles (``jaccard``), or with ``bits`` of fingerprints within two bits.
    """
    kept = [F.col(c) for c in docs.columns if c not in (text_col, "fp", "component_id", "fingerprint")]
    key = [] if bits else jaccard.text_keys(F.col(text_col))
    prints = cut(docs.select(*kept, *key, fingerprints(F.col(text_col), size).alias("fp")))
    on = ["fp"] if bits else ["_t1", "_t2"]
    distinct = cut(prints.groupBy(*on).agg(F.min(id_col).alias("least")))
    if bits:
        roots = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
        rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    else:
        rooted = distinct.join(jaccard.roots(docs, links, text_col), on)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(*on, "component_id")
    return prints.join(named, on).select(*kept, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay if one row of each component of ``jaccard`` does: that with the least id, rows without an id last, and of rows with the same id the first by text."""
    on, text_keys = ["_t1", "_t2"], jaccard.text_keys(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), *text_keys).groupBy("_id", *on).count()
    rooted = cut(rows.join(jaccard.roots(docs, links, text_col), on))
    counted = rooted.groupBy("root", "_id").agg(F.sum("count").alias("n"))
    least = counted.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "n")).alias("l")).select("root", F.col("l._id").alias("_least"), (F.col("l.n") > 1).alias("_several"))
    marked = cut(rooted.join(least, "root").select("_id", *on, "root", "_several", F.col("_id").eqNullSafe(F.col("_least")).alias("_stays")))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_i"), *text_keys)
    # rows that surely stay are written where they are read; only the others meet their component
    both = F.xxhash64("_t1", "_t2", F.struct("_i"))
    doubtful = marked.where("_several or not _stays").withColumnRenamed("_id", "_i").select(both)
    keyed = sifted(keyed, both, doubtful, "_doubtful")
    named = marked.where("_stays")
    kept = keyed.where("_doubtful").join(named, [keyed[c] == named[c] for c in on] + [F.col("_i").eqNullSafe(F.col("_id"))]).select("_row", "root", "_several")
    # components with several rows of the least id are rare: only their rows are ordered
    order = F.struct(F.coalesce(F.col("_row")[text_col], F.lit("")), F.xxhash64(*(F.col("_row")[c] for c in docs.columns)))
    single, several = kept.where("not _several").select("_row.*"), kept.where("_several").groupBy("root").agg(F.min_by("_row", order).alias("_row"))
    return keyed.where("not _doubtful").select("_row.*").unionByName(single).unionByName(several.select("_row.*"))
