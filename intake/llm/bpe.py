"""Operator 1: BPE encoding and decoding with a ready-made vocabulary.

Text is cut into words as the tokenizer's own pre-tokenizer does it. Each distinct word is merged
once per Python worker: a contiguous array holds the word's part boundaries with the rank of every
pair of neighbours; the lowest rank is found by a scan, its boundary is deleted, and the two ranks
beside it are refreshed. Words beyond ``LONG_WORD`` symbols take a heap with the same order of merges,
as scans over them would take quadratic time.

Encoding is a map over rows: no shuffle, and memory is bounded by one Arrow batch and the word cache, which a worker
drops when a task of another operator begins.

Defined results: a null text counts as empty and gives no tokens; repeated rows are encoded one by
one; an empty table gives an empty table; other columns of the input are kept, except that a column
with the name of an output column is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intake.llm.common import list_array, map_slices, worker_cache

#: Words with more symbols than this are merged with a heap.
LONG_WORD = 200
#: Words held in a cache before it starts anew; longer words are not kept.
CACHE_WORDS, CACHE_WORD_CHARS = 150_000, 100
#: Unicode White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
NO_RANK = 1 << 60


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer file with word ends (lower-cased words, byte symbols) read for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown = {i: t for t, i in (self.vocab | self.special).items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(split.replace(r"\s", SPACE))
        self.chunk = re.compile(f"[^{SPACE}]+")
        self.specials = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")")
        chars = _byte_chars()
        self.first = [self.vocab.get(c, -1) for c in chars]
        self.last = [self.vocab.get(c + self.end, -1) for c in chars]
        self.chunks, self.words = Cache(self._chunk), Cache(self.merge)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        raw = word.encode("utf-8")
        parts = [self.first[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        if -1 in parts:
            parts = [p for p in parts if p >= 0]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank, made = self.rank.get, self.made
        ranks = [rank(p, NO_RANK) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != NO_RANK:
            i = ranks.index(best)
            parts[i] = made[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NO_RANK)
        return tuple(parts)

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], alive[j], after[i] = self.made[best], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (parts[a], parts[b])) in rank:
                    heapq.heappush(heap, (rank[p], a, p))
        return tuple(p for p, a in zip(parts, alive, strict=True) if a)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a run without white space."""
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3")
        text = text.lower()
        found = [text] if text.isascii() and text.isalpha() else self.piece.findall(text)
        return self.words[found[0]] if len(found) == 1 else tuple(i for w in found for i in self.words[w])

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        chunks = self.chunks
        for part in self.specials.split(text or "") if "<|" in (text or "") else (text or "",):
            if part in self.special:
                ids.append(self.special[part])
            else:
                for chunk in self.chunk.findall(part):
                    ids += chunks[chunk]
        return ids

    def decode(self, ids) -> str:
        """Token strings joined by a space, as the file names no decoder; unknown ids are passed over."""
        return " ".join([t for i in ids if (t := self.shown.get(i)) is not None])


class Cache(dict):
    """Results by word. When full it starts anew, but words used since then come back from the older half first."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str):
        if (found := self.older.get(word)) is None:
            found = self.make(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


@worker_cache("bpe", maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def code(docs: DataFrame, path: str, text_col: str = "text", ids_to: str = "token_ids", decoded_to: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all, unless given) with the ids of ``text_col`` and, if named, the text they decode to."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (ids_to, decoded_to)]
    fields = [*docs.select(*keep).schema.fields, T.StructField(ids_to, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_to, T.StringType())] if decoded_to else [])]
    # the text goes last, so that what is kept may hold it too
    given = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text_in"))

    def make():
        bpe = load(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(t) for t in batch.column(len(keep)).to_pylist()]
            out = [*batch.columns[: len(keep)], list_array(list(chain.from_iterable(ids)), [len(x) for x in ids], pa.int32())]
            if decoded_to:
                out.append(pa.array(map(bpe.decode, ids), pa.string()))
            return pa.RecordBatch.from_arrays(out, [f.name for f in fields])

        return work

    return map_slices(given, T.StructType(fields), make, keeps="bpe")


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids of ``ids_col`` stand for; null ids give the empty text."""

    @F.pandas_udf(T.StringType())
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for batch in ids:
            yield batch.map(lambda x: bpe.decode(x.tolist()))

    return docs.withColumn(to, text(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))
