"""Groups of texts that share most of their word shingles, for stages that have no fingerprint contract of their own.

Two texts are linked if the Jaccard index of their sets of five-word shingles is ``LIKE`` or more. Candidates share a shingle
of their prefixes: of two such sets, put in one common order, the first fifth (and one) of each share a shingle. The order puts
frequent shingles last; how well it does so changes the cost only, never the pairs found.

Candidates are first compared by SimHash prints of ``BITS`` bits over the sets, which travel with the keys, and only then by their texts.
Of sets at the least index of a link a bit differs with probability 0.152, so that more than ``APART`` of 128 bits do with
probability below 1e-8; sets of fewer than ``SURE`` shingles, where that bound is loose, are always compared by their texts.

Equal sets fall together before any key is made. Sets meet whose first prints are within two bits, as operator 3 finds them by Golay keys. As prints of linked sets may
differ by more, sets meet under the keys of their prefixes too. The sets of a key first meet its leader, each set at most ``LEADERS`` of all its leaders;
what is linked so is a group. Then, in keys that hold several groups, all sets of different groups meet that are in equal or adjacent
length classes, if their prints and sketches allow. So a large group of copies costs a few
comparisons a copy and not all its pairs, and no link between groups is passed over. A pair is tried at a shared key only if what both sets
have from that key on is enough for a link, which at the first shared key holds of every link; and if a sketch of bin parities, by which sets differ at least, allows it. Every pair is verified on its texts.
The leader of a key is the set in whose prefix the key comes first, which of a group of copies has the fewest shingles of its own.

Defined results: null and blank texts have the empty set and are one group; a text of fewer than five words is one shingle; repeated rows are
one text; an empty table has no groups. Whole texts are read, however long: a set of shingles is held one text at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intake.llm.common import cut, drop_kept, give_back, list_array, map_slices, sifted, words_of
from intake.llm.components import components

#: The least Jaccard index of a link, as a fraction.
LIKE = (4, 5)
SIZE = 5
#: Leaders that a set is compared with.
LEADERS = 3
#: Bits of the prints, the most that differ in a candidate, and the shingles from which on prints are trusted.
BITS, APART, SURE = 128, 46, 64
#: The words of the parity sketch.
ODD = ("p0", "p1", "p2", "p3")
#: Shingles held of texts that pairs were just compared with.
HELD = 500_000
#: Shingles that are known as frequent, and how often one must be in a slice of rows to be counted.
FREQUENT, IN_SLICE = 100_000, 4
_ALL = (1 << 64) - 1


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles in order: hashes of the words, mixed along each run of ``size``."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.int64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    size = min(size, len(w))
    n = len(w) - size + 1
    out = words[:n] + np.uint64(size)
    for k in range(1, size):
        out = _mixed(out) + words[k : k + n]
    return np.unique(_mixed(out).view(np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LIKE[1] >= LIKE[0] * (len(a) + len(b) - both)


def prints(found: np.ndarray) -> tuple[int, int]:
    """The SimHash of a set in two signed halves; the second is of the hashes mixed once more."""
    h = found.view(np.uint64)
    out = []
    for x in (h, _mixed(h + np.uint64(1))):
        ones = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(x), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


def parities(found: np.ndarray) -> list[int]:
    """For each of 256 bins of hashes, whether an odd number of the set is in it: two sets differ in at least as many shingles as bins."""
    odd = np.bincount(found & 255, minlength=256).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


def near(a: tuple, b: tuple) -> bool:
    """Whether sets given as (set, n, f, g, at) that share a key at the places ``at`` of their prefixes may be linked.

    Of a pair's shared keys the first has all that it shares from there on: what comes before counts for nothing.
    """
    small, large = (a[1], b[1]) if a[1] <= b[1] else (b[1], a[1])
    if small * LIKE[1] < large * LIKE[0] or min(a[1] - a[4], b[1] - b[4]) * sum(LIKE) < LIKE[0] * (small + large):
        return False
    return small < SURE or ((a[2] ^ b[2]) & _ALL).bit_count() + ((a[3] ^ b[3]) & _ALL).bit_count() <= APART


def length_class(n: Column) -> Column:
    """Sets with a link are in one class or in adjacent ones."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(LIKE[1] / LIKE[0]) + 1e-9).cast("int")


def sizes_allow(a: Column, b: Column) -> Column:
    return (a * LIKE[1] >= b * LIKE[0]) & (b * LIKE[1] >= a * LIKE[0])


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits of hash by which a text is known."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit("text"), text).alias("_t2")


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in order of their hashes, with their place in the common order."""

    def count():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([shingles(t) for t in batch.column(0).to_pylist()]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found[n >= IN_SLICE]), pa.array(n[n >= IN_SLICE])], ["h", "n"])

        return work

    rows = map_slices(texts, "h long, n long", count).groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    order = np.lexsort((rows.h.to_numpy(np.int64), rows.n.to_numpy(np.int64)))
    found = rows.h.to_numpy(np.int64)[order]
    by_hash = np.argsort(found)
    return found[by_hash], by_hash.astype(np.int64)


def prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set in the common order, of which sets with a link share one."""
    if not len(found):
        return found
    known, place = frequent
    rank = np.full(len(found), -1, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        rank = np.where(known[at] == found, place[at], -1)
    return found[np.lexsort((found, rank))[: len(found) + LIKE[0] * len(found) // -LIKE[1] + 1]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, set, n, f, g, at) in order -> (key, set, at, leader) for the sets of keys that several have; the leader is the key's first set, where the two may be linked.

    Of a key only its first set is held, so that a large one's rows pass through.
    """

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)], ["key", "set", "at", "leader"])

    drop_kept()
    last, first, before, rows = None, None, None, []
    for batch in batches:
        # most keys have one set: only rows whose key may have another are looked at; the last row's is not known yet
        keys = batch.column(0).to_numpy()
        same = keys[1:] == keys[:-1]
        batch = batch.filter(pa.array(np.r_[keys[:1] == last, same] | np.r_[same, True][: len(keys)]))
        for key, *one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                last, first, before = key, one, one[0]
            elif one[0] != before:
                if before == first[0]:
                    rows.append((key, before, first[4], None))
                before = one[0]
                rows.append((key, before, one[4], first[0] if near(one, first) else None))
            if len(rows) > 20_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)
            rows = []
    give_back()


def roots(docs: DataFrame, links: Callable[[DataFrame], DataFrame], text_col: str = "text") -> DataFrame:
    """(_t1, _t2, root) for every distinct text of ``docs``, known by ``text_keys``; linked texts have one root.

    ``links`` gives the pairs (a, b) of near prints from distinct ones (fp).
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    frequent = _frequent(texts)
    columns = ["_t1", "_t2", "set", "n", "f", "g", *ODD]

    def read():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, heads = [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text)
                rows.append((np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64), len(found), *prints(found), *parities(found)))
                heads.append(prefix(found, frequent))
            numbers = [pa.array([int(r[j]) for r in rows], pa.int64()) for j in range(len(columns) - 2)]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], *numbers, list_array(np.concatenate(heads) if heads else [], [len(x) for x in heads], pa.int64())], [*columns, "heads"])

        return work

    read_in = cut(map_slices(texts.select(*text_keys(F.col("_text")), "_text"), ", ".join(f"{c} long" for c in columns) + ", heads array<long>", read))
    sets = cut(read_in.groupBy("_t1", "_t2").agg(F.first("set").alias("set")))
    known = read_in.groupBy("set").agg(*(F.first(c).alias(c) for c in columns[3:]))
    close = _near_prints(known.select("set", "n", F.col("f").alias("fp")), links)
    keyed = read_in.select(F.posexplode("heads").alias("at", "key"), "set", "n", "f", "g").select("key", "set", "n", "f", "g", "at")
    met = cut(keyed.repartition(F.col("key")).sortWithinPartitions("key", "at", "set").mapInArrow(_met, "key long, set long, at long, leader long"))
    picked = sets.groupBy("set").agg(F.min(F.struct("_t1", "_t2")).alias("t")).select("set", "t.*")
    edges = _verified(close.union(_few(met.where("leader is not null"))).distinct(), docs, text_col, picked)
    members = met.select("key", "set", "at").join(known, "set").join(components(edges).withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    # keys whose sets are all in one group are done
    split = members.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    one = cut(members.join(split, "key").withColumn("class", length_class(F.col("n"))))
    x = one.select("key", *(F.col(c).alias(f"x_{c}") for c in ("set", "root", "n", "f", "g", "at", *ODD)), F.explode(F.expr("array(class, class + 1)")).alias("class"))
    y = one.select("key", *(F.col(c).alias(f"y_{c}") for c in ("set", "root", "n", "f", "g", "at", *ODD)), "class")
    later = x.join(y, ["key", "class"]).where((F.col("x_root") != F.col("y_root")) & _may_link("x_", "y_"))
    edges = edges.union(_verified(later.select(F.least("x_set", "y_set").alias("a"), F.greatest("x_set", "y_set").alias("b")).distinct(), docs, text_col, picked))
    found = components(edges).select(F.col("node").alias("set"), "root")
    return sets.join(found, "set", "left").select("_t1", "_t2", F.coalesce("root", "set").alias("root"))


def _near_prints(known: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of sets (set, n, fp) to compare: each print's sets with the least of them, and those of near prints; sizes must allow a link."""
    least = cut(known.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("l")))
    same = known.join(least, "fp").select("set", "n", F.col("l.set").alias("to"), F.col("l.n").alias("m"))
    near_ones = links(least.select("fp"))
    for end in ("a", "b"):
        near_ones = near_ones.join(least.select(F.col("fp").alias(end), F.col("l").alias(f"{end}_l")), end)
    pairs = same.union(near_ones.select("a_l.set", "a_l.n", "b_l.set", "b_l.n")).where(F.col("set") != F.col("to")).where(sizes_allow(F.col("n"), F.col("m")))
    return pairs.select(F.least("set", "to").alias("a"), F.greatest("set", "to").alias("b"))


def _may_link(x: str, y: str) -> Column:
    """``near``, and the bound of the parity sketches, as an expression over columns with these prefixes."""
    by_place = f"least({x}n - {x}at, {y}n - {y}at) * {sum(LIKE)} >= {LIKE[0]} * ({x}n + {y}n)"
    by_prints = f"(least({x}n, {y}n) < {SURE} or bit_count({x}f ^ {y}f) + bit_count({x}g ^ {y}g) <= {APART})"
    apart = " + ".join(f"bit_count({x}{p} ^ {y}{p})" for p in ODD)
    return sizes_allow(F.col(f"{x}n"), F.col(f"{y}n")) & F.expr(f"{by_place} and {by_prints} and ({apart}) * {sum(LIKE)} <= ({x}n + {y}n) * {LIKE[1] - LIKE[0]}")


def _few(led: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set with at most ``LEADERS`` of its leaders; a set has no more of them than shingles in its prefix."""
    chosen = led.groupBy("set").agg(F.slice(F.sort_array(F.collect_set("leader")), 1, LEADERS).alias("l"))
    return chosen.select("set", F.explode("l").alias("l")).select(F.least("set", "l").alias("a"), F.greatest("set", "l").alias("b"))


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str, picked: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are linked, by their texts; written, as two steps need them."""
    pairs = cut(pairs)
    named = cut(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(picked, "set"))
    # few texts are wanted: the others stay where they are; copies of a text are made one before they travel
    wanted = sifted(docs.select(*text_keys(F.col(text_col)), F.col(text_col).alias("_text")), F.col("_t1"), named.select("_t1"), "_may").where("_may")
    texts = cut(wanted.groupBy("_t1", "_t2").agg(F.first("_text").alias("_text")).join(named, ["_t1", "_t2"]).select("set", "_text"))

    def compare():
        known: dict[int, np.ndarray] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            same = []
            for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sum(map(len, known.values())) > HELD:
                    known.clear()
                for i, text in ((a, s), (b, t)):
                    if i not in known:
                        known[i] = shingles(text)
                same.append(alike(known[a], known[b]))
            return batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

        return work

    both = pairs.join(texts.select(F.col("set").alias("a"), F.col("_text").alias("s")), "a").join(texts.select(F.col("set").alias("b"), F.col("_text").alias("t")), "b")
    return cut(map_slices(both.select("a", "b", "s", "t"), "a long, b long", compare))
