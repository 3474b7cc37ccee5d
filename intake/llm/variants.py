"""Spelling variants: words of the corpus within one edit of each other, and the frequent form that each belongs to.

Words of one edit differ by at most 2 in the squared distance of their letter counts. A block holds the words of one length with equal
counts of four classes of letters; one edit changes a class's count by one at most, so a word meets its own block, those that a replaced
letter leads to (of two blocks, the later) and those one letter longer. A task multiplies the letter counts of two chunks of
such blocks (numpy), keeps pairs at a squared distance of 2 or less, and verifies the edit on the letters: only true pairs leave it.

Defined results: null and empty texts have no words, a null id counts as the empty text in the hash of a run, repeated rows count again, an empty table gives an
empty result. Very long texts are read whole, one at a time, and very long words are compared in smaller chunks. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intake.llm.common import cut

#: Least length and count of a word; how many times more frequent a form is than its variant; one run in so many loses a letter.
MIN_LENGTH, MIN_COUNT, TIMES, DELETE = 6, 5, 5, 199
#: Classes of letters of about equal frequency: the letters by frequency, dealt in turn.
CLASSES = 4
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
#: Words of a chunk on either side, which bounds a task's matrices; elements of a matrix at once; distinct words a task holds before it passes on counts.
BASE, PROBE, CELLS, HELD = 8192, 32768, 1 << 22, 200_000

#: A byte of Latin-1 as itself in lower case if it is a letter of a run, else as a space.
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Columns of the letter counts: a-z, and six for the letters beyond.
_COLUMN = np.array([b - 97 if 97 <= b <= 122 else 26 + b % 6 for b in range(256)])


def _runs(text: str) -> list[bytes]:
    """Runs of the letters of Latin-1, as its bytes, A-Z lower-cased; any other character ends a run."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def count_runs(ids: list, texts: list[str | None], into: Counter) -> None:
    """Adds the words of texts: runs of enough letters, after the deletion that the hash of id and run asks for."""
    for doc_id, text in zip(ids, texts):
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for run, n in Counter(w for w in _runs(text or "") if len(w) >= MIN_LENGTH).items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % DELETE == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < MIN_LENGTH:
                    continue
            into[run] += n


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        found.clear()
        return made

    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            some = batch.slice(start, 64)
            count_runs(some.column(0).to_pylist(), some.column(1).to_pylist(), found)
            if len(found) >= HELD:
                yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """Words and how often they occur in the whole corpus, of those frequent enough."""
    counts = docs.select("doc_id", "text").mapInArrow(_count_batches, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _classes() -> list[str]:
    """The letters of each class as the inside of a character class; letters beyond a-z by their code."""
    kinds = [""] * CLASSES
    for k, letter in enumerate(BY_FREQUENCY):
        kinds[k % CLASSES] += letter
    for code in range(0xC0, 0x100):
        kinds[code % CLASSES] += chr(code)
    return kinds


def _moves() -> list[list[int]]:
    """Changes of the class counts that lead to another block: one letter more, or one of another class for an earlier one (towards the later block)."""
    one = np.eye(CLASSES, dtype=int)
    return [[0] * CLASSES, *(list(map(int, x)) for x in one), *(list(map(int, one[a] - one[b])) for a in range(CLASSES) for b in range(a + 1, CLASSES))]


def _vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts of words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = _COLUMN[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(np.repeat(np.arange(len(words)), lengths) * 32 + letters, minlength=len(words) * 32).reshape(-1, 32).astype(np.float32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters ``b`` are one edit from those of ``a``: as long, or one letter longer."""
    n = a.shape[1]
    if n == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    same = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    return same + np.logical_and.accumulate(a[:, ::-1] == b[:, :0:-1], axis=1).sum(axis=1) >= n


def near_words(base: list[bytes], probes: list[bytes], same_block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (probe, base) of one edit; the base has one length, as long as a probe or one longer. Within a block each pair is given once."""
    found_a, found_b = [], []
    counts, letters = _vectors(base), np.frombuffer(b"".join(base), np.uint8).reshape(len(base), -1)
    norms, lengths = (counts * counts).sum(axis=1), np.fromiter(map(len, probes), np.int64, len(probes))
    order = {w: k for k, w in enumerate(sorted({*base, *probes}))}
    rank_a, rank_b = (np.fromiter((order[w] for w in x), np.int64, len(x)) for x in (probes, base))
    for length in np.unique(lengths):
        mine = np.flatnonzero(lengths == length)
        step = max(1, CELLS // len(base))
        for start in range(0, len(mine), step):
            some = mine[start : start + step]
            words = [probes[i] for i in some]
            x = _vectors(words)
            gram = x @ counts.T
            a, b = np.nonzero(2 * gram >= (x * x).sum(axis=1)[:, None] + norms[None, :] - 2)
            own = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
            for part in range(0, len(a), size := max(1, CELLS // int(length))):
                at_a, at_b = a[part : part + size], b[part : part + size]
                good = one_edit(own[at_a], letters[at_b])
                at_a, at_b = some[at_a[good]], at_b[good]
                once = ~same_block[at_a] | (rank_a[at_a] < rank_b[at_b])
                found_a.append(at_a[once])
                found_b.append(at_b[once])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(found_a), join(found_b)


PAIRS = "word string, n long, near string, near_n long"


def _compare(base: pa.Table, probes: pa.Table) -> pa.Table:
    """Both directions of every pair of two chunks."""
    latin = lambda c: [w.encode("latin-1") for w in c.to_pylist()]
    if base.num_rows and probes.num_rows:
        a, b = near_words(latin(base.column("word")), latin(probes.column("probe")), probes.column("own").to_numpy())
    else:
        a = b = np.zeros(0, np.int64)
    left, right = probes.select(["probe", "probe_n"]).rename_columns(["word", "n"]).take(pa.array(a)), base.select(["word", "n"]).take(pa.array(b))
    both = [pa.concat_tables([x, y]).combine_chunks() for x, y in ((left, right), (right, left))]
    return pa.table([both[0].column(0), both[0].column(1), both[1].column(0), both[1].column(1)], names=["word", "n", "near", "near_n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of words of one edit, in both directions: word, n, near, near_n."""
    kinds = [F.length("word") - F.length(F.regexp_replace("word", f"[{letters}]", "")) for letters in _classes()]
    blocks = words.withColumn("block", F.array(*kinds))
    probes = blocks.withColumn("move", F.explode(F.array(*[F.array(*map(F.lit, m)) for m in _moves()])))
    probes = probes.select("word", "n", F.zip_with("block", "move", lambda a, b: a + b).alias("block"), F.forall("move", lambda m: m == 0).alias("own"))
    sizes = blocks.groupBy("block").agg(F.ceil(F.count("*") / BASE).cast("int").alias("bases"))
    probes = probes.join(sizes, "block")
    sizes = probes.groupBy("block", "bases").agg(F.ceil(F.count("*") / PROBE).cast("int").alias("probes"))
    part = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = blocks.join(sizes, "block").select("block", "word", "n", part("bases").alias("i"), every("probes").alias("j"))
    right = probes.join(sizes.drop("bases"), "block").select(F.col("block").alias("to"), F.col("word").alias("probe"), F.col("n").alias("probe_n"), "own", every("bases").alias("k"), part("probes").alias("l"))
    return left.groupBy("block", "i", "j").cogroup(right.groupBy("to", "k", "l")).applyInArrow(_compare, PAIRS)


def _roots(links: DataFrame, most: int) -> DataFrame:
    """The last form that each word leads to, by doubling the way looked at; a form is ``TIMES`` as frequent, which bounds the way."""
    steps = 1
    while MIN_COUNT * TIMES ** (steps + 1) <= most:
        steps += 1
    roots = cut(links.select("word", F.col("form").alias("root")))
    while steps > 1:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = cut(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
        steps = -(-steps // 2)
    return roots


def groups(docs: DataFrame) -> DataFrame:
    """Every frequent word with its near words' number, its form and the root of its forms."""
    words = cut(vocabulary(docs))
    near = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_less"), F.col("near").alias("_form"))).alias("_best"))
    form_n = -F.col("_best._less")
    formed = form_n >= TIMES * F.col("n")
    near = cut(near.select("word", "n_near", F.when(formed, F.col("_best._form")).alias("form"), F.when(formed, form_n).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(near.where("form IS NOT NULL"), most)
    found = words.join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
