"""Operator 2: language-model scoring with a hashed maximum-entropy model.

Tokens are counted over all training documents; they give the unigram base. The model factors a token's probability
into its class and its place in the class:

* the most frequent tokens are dealt to classes of ``WIDTH`` by rank; all others form the last class, in
  which a token has its add-0.1 unigram share, the unknown one included, so that the probabilities sum to 1;
* the class and the place each come from a softmax over features of the history: the token before, the two
  before as a pair, and the one before the last alone (a skip). Features are hashed to rows of weights; rows for a
  place are hashed with the class too. Biases hold the unigram shares.

Training takes every training document once, in ``SLICES`` rounds. In a round each task starts from the same weights,
takes AdaGrad steps over its documents, and returns what it changed; Spark sums that per
row, weighted by how often the task met the row, and the next round starts from the mean. The number of
training tasks follows the cores, so what is shuffled per round has a bound that the corpus doesn't raise.

Counts of the ``HOT`` most frequent tokens are sent to the tasks (that many short strings at most); counts of all
others meet the texts in a join, each text's rare tokens counted first.

Defined results: a null or empty text has the end token only; repeated rows are scored one by one and count as often in training;
an empty table gives an empty table; with no training document N and V are 0 and every probability is 1; columns not named in ``keep`` go.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intake.llm.common import cut, list_array, map_slices, words_of

#: Tokens whose counts are sent to the tasks, and their bytes together.
HOT, HOT_BYTES = 1 << 17, 1 << 25
#: Classes (the last is for all tokens not dealt to one), and tokens in a class.
CLASSES, WIDTH = 48, 48
#: Rows of weights for classes, as powers of two: one for so many training tokens, between the least and the most. Places have twice as many, up to the most.
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 12, 1 << 16
#: Rounds of training, tokens in a step, and the step size.
SLICES, STEP, RATE = 2, 4096, 0.25
#: Added to each count.
ALPHA = 0.1
#: The end of a text as a token; no word holds a space.
END = b" "


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    found = words_of(text)
    found.append(END)
    return found


def count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, c) over ``docs``; each task sums what it can hold before the shuffle."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            keys = list(seen)
            rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["token", "c"])
            seen.clear()
            return rows

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens(text))
                if len(seen) > 200_000:
                    yield out()
        yield out()

    return docs.select(text_col).mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    hot: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    rows: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        n, head = len(self.hot), min(len(self.hot), (CLASSES - 1) * WIDTH)
        self.ids, self.head = {t: i for i, t in enumerate(self.hot)}, head
        rank = np.arange(n + 1)
        self.class_of = np.where(rank < head, rank // WIDTH, CLASSES - 1)
        self.place_of = np.where(rank < head, rank % WIDTH, 0)
        c = np.append(self.counts, 0).astype(float)
        self.tail_total = self.total - c[:head].sum() + ALPHA * (self.distinct - head + 1)
        self.base = np.log10((c + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))
        self.in_tail = np.log10((c + ALPHA) / self.tail_total)
        mass = np.bincount(self.class_of[:head], c[:head], CLASSES) if head else np.zeros(CLASSES)
        mass[-1] = self.tail_total
        with np.errstate(divide="ignore"):
            self.class_bias = np.log(mass / mass.sum()).astype(np.float32)
            place = np.full((CLASSES - 1) * WIDTH, 0.0)
            place[:head] = c[:head]
            self.place_bias = np.log(place).reshape(CLASSES - 1, WIDTH).astype(np.float32)
        self.place_bias[np.isneginf(self.place_bias)] = -1e9
        self.class_bias[np.isneginf(self.class_bias)] = -1e9

    def histories(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hashes of the three features of each token's history; ``first`` marks the first token of a text."""
        start = len(self.hot) + 1
        one = np.r_[start, ids[:-1]].astype(np.uint64)
        one[first] = start
        two = np.r_[start, one[:-1]]
        two[first] = start
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        return np.stack([one * a, (one * b) ^ (two * c) + a, two * c + b])

    @staticmethod
    def _rows(history: np.ndarray, salt, n: int) -> np.ndarray:
        x = (history + salt) * np.uint64(0xFF51AFD7ED558CCD)
        return (x >> np.uint64(40) & np.uint64(n - 1)).astype(np.uint16)  # n is a power of two; short numbers sort by radix

    def _softmax(self, table: str, bias: np.ndarray, at: np.ndarray, truth: np.ndarray, learn) -> np.ndarray:
        """Natural log of the probability of ``truth``; takes a step on ``table`` if ``learn`` holds the counts so far."""
        w = self.rows[table]
        x = w.take(at[0], 0)
        x += w.take(at[1], 0)
        x += w.take(at[2], 0)
        x += bias
        np.minimum(x, 80, out=x)  # below the overflow of exp
        of = np.arange(len(truth))
        log = x[of, truth].astype(float)
        np.exp(x, out=x)
        z = x @ np.ones(x.shape[1], np.float32)
        log -= np.log(z)
        if learn is not None:
            x *= (-1 / z)[:, None]
            x[of, truth] += 1
            flat = at.ravel()
            order = np.argsort(flat, kind="stable")
            met = flat[order]
            starts = np.flatnonzero(np.r_[True, met[1:] != met[:-1]])
            rows = met[starts]
            step = np.add.reduceat(x.take(order % len(truth), 0), starts)
            learn[rows] += np.diff(np.r_[starts, len(met)])
            w[rows] += (RATE / np.sqrt(learn[rows]))[:, None].astype(np.float32) * step
        return log

    def log10(self, ids: np.ndarray, first: np.ndarray, learn: dict | None = None) -> np.ndarray:
        """log10 of each token's probability, without the last factor of tokens that aren't hot."""
        out = np.zeros(len(ids))
        if not self.head:
            return out
        history = self.histories(ids, first)
        for a in range(0, len(ids), STEP):
            i, h = ids[a : a + STEP], history[:, a : a + STEP]
            kind = self.class_of[i]
            log = self._softmax("class", self.class_bias, self._rows(h, np.uint64(1), len(self.rows["class"])), kind, learn and learn["class"])
            dealt = np.flatnonzero(kind < CLASSES - 1)
            if len(dealt):
                k = kind[dealt]
                at = self._rows(h[:, dealt], (k.astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15), len(self.rows["place"]))
                log[dealt] += self._softmax("place", self.place_bias[k], at, self.place_of[i[dealt]], learn and learn["place"])
            out[a : a + STEP] = log / np.log(10)
        tail = (ids >= self.head) & (ids < len(self.hot))
        out[tail] += self.in_tail[ids[tail]]
        return out

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all tokens among the hot ones (any other has their number), and the place of each text's first one."""
        get, other = self.ids.get, len(self.hot)
        ids = np.array([get(t, other) for text in texts for t in text], np.int64)
        return ids, np.r_[0, np.cumsum([len(t) for t in texts])[:-1]].astype(np.int64)


def weights(tokens_seen: int) -> dict[str, np.ndarray]:
    """Empty tables of weights, larger for a larger corpus."""
    n = min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, tokens_seen // TOKENS_A_ROW - 1).bit_length()))
    return {"class": np.zeros((n, CLASSES), np.float32), "place": np.zeros((min(MOST_ROWS, 2 * n), WIDTH), np.float32)}


def fit(docs: DataFrame, counts: DataFrame, text_col: str) -> Model:
    """A model from the training documents and their token counts."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count from which on there are at most HOT tokens, by a histogram of 32 bins to the power of two
    kind = F.floor(32 * F.log2("c")).cast("int")
    bins, n, size, least = counts.groupBy(kind.alias("b")).agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).alias("size")).orderBy(F.desc("b")).collect(), 0, 0, None
    for r in bins:
        n, size = n + r.n, size + r.size
        if n > HOT or size > HOT_BYTES:
            break
        least = r.b
    top = sorted(counts.where(kind >= least).collect(), key=lambda r: (-r.c, r.token)) if least is not None else []
    model = Model([r.token.encode() for r in top], np.array([r.c for r in top], np.int64), total[0], total[1], weights(total[0]))
    context = docs.sparkSession.sparkContext
    wide = max(CLASSES, WIDTH)
    columns = [f"d{k}" for k in range(wide)]
    for k in range(SLICES if model.head else 0):
        sent = context.broadcast(model)

        def run(batches, sent=sent):
            given = sent.value
            local = Model(given.hot, given.counts, given.total, given.distinct, {n: w.copy() for n, w in given.rows.items()})
            met = {n: np.zeros(len(w)) for n, w in local.rows.items()}
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    local.log10(*local.encode([tokens(t) for t in batch.column(0).slice(start, 64).to_pylist()]), met)
            for number, (name, w) in enumerate(local.rows.items()):
                rows = np.flatnonzero(met[name])
                change = np.zeros((len(rows), wide))
                change[:, : w.shape[1]] = (w[rows] - given.rows[name][rows]) * met[name][rows, None]
                yield pa.RecordBatch.from_arrays([pa.array(rows * 2 + number), pa.array(met[name][rows]), *(pa.array(change[:, j].astype(np.float32)) for j in range(wide))], ["row", "n", *columns])

        part = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SLICES)) == k).select(text_col).coalesce(2 * context.defaultParallelism)
        changed = part.mapInArrow(run, "row long, n double, " + ", ".join(f"{c} float" for c in columns))
        mean = changed.groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).select("row", F.array(*((F.col(c) / F.col("n")).cast("float") for c in columns)).alias("d")).toArrow()
        rows = mean["row"].to_numpy()
        change = mean["d"].combine_chunks().flatten().to_numpy().reshape(-1, wide)
        for number, w in enumerate(model.rows.values()):
            w[rows[rows % 2 == number] // 2] += change[rows % 2 == number, : w.shape[1]]
        sent.unpersist()
    return model


def score(docs: DataFrame, training: Column, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with counts and scores; learns from the rows where ``training`` holds."""
    learned = docs.where(training).select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counts = cut(count_tokens(learned, "_text"))
    model = fit(learned, counts, "_text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep).schema.fields
    fields = [*kept, *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score")), T.StructField("_rare", T.ArrayType(T.StringType())), T.StructField("_n", T.ArrayType(T.IntegerType()))]

    def make():
        model = sent.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [tokens(t) for t in batch.column(len(kept)).to_pylist()]
            ids, first = model.encode(texts)
            hot = ids < len(model.hot)
            sums = [np.add.reduceat(x, first) for x in (hot.astype(np.int64), np.where(hot, model.base[ids], 0), model.log10(ids, first))]
            rare: list[Counter] = [Counter() for _ in texts]
            late = np.flatnonzero(~hot)
            text_of = np.searchsorted(first, late, "right") - 1
            for t, k in zip(text_of.tolist(), (late - first[text_of]).tolist(), strict=True):
                rare[t][texts[t][k]] += 1
            sizes = [len(r) for r in rare]
            return pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array([len(t) for t in texts], pa.int64()), *(pa.array(s) for s in sums),
                 list_array([w.decode("utf-8", "surrogatepass") for r in rare for w in r], sizes, pa.string()), list_array([n for r in rare for n in r.values()], sizes, pa.int32())],
                [f.name for f in fields],
            )

        return work

    passed = cut(map_slices(docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text_in")), T.StructType(fields), make)).withColumn("_row", F.monotonically_increasing_id())
    tail = float(model.tail_total)
    all_of = model.total + ALPHA * (model.distinct + 1)
    rare = passed.select("_row", F.explode(F.arrays_zip(F.col("_rare").alias("token"), F.col("_n").alias("k"))).alias("x")).select("_row", "x.token", "x.k")
    c = F.coalesce("c", F.lit(0))
    late = rare.join(counts, "token", "left").groupBy("_row").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("_known"), F.sum(F.col("k") * F.log10((c + ALPHA) / all_of)).alias("_base"), F.sum(F.col("k") * F.log10((c + ALPHA) / tail)).alias("_score")
    )
    whole = passed.drop("_rare", "_n").join(late, "_row", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return whole.select(*keep, "n_tokens", plus("n_known", "_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base_score", "_base"), plus("score", "_score"))
