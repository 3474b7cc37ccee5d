"""Operator 5: token ids as binary shards in training order.

Texts become token ids, cut into sequences of at most ``SEQUENCE`` ids per document (the last id of a document is its end).
Sequences are numbered without a shuffle: partitions of the written tokens are counted, and each continues the count where
the ones before end. A keyed Feistel network over the next power of four, walked on until it falls below the number
of sequences, is a permutation: it gives each sequence a global slot. Slots are dealt by range of shards, each task's sequences for a shard as one compressed block, and each task
writes whole shards of ``SHARD`` records of one fixed stride. So slot k stands in shard k // SHARD at byte (k % SHARD) * STRIDE,
and reading can begin or go on at any slot.

A record is the document id (int64), the sequence's number in its document (int32), the number of ids
(int32), then ``SEQUENCE`` ids (uint16), filled up with the end id; all little-endian. A repeated task writes the same bytes.

Defined results: a null or empty text gives one sequence of the end id alone; a null id is written as -1 (and stays null in the table);
repeated rows each have sequences; an empty table writes nothing; other columns go.
"""

from __future__ import annotations

import base64
import math
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intake.llm.common import cut, get_bytes, list_array, map_slices, put_file

SEQUENCE, SHARD = 256, 16_384
HEAD = "<qii"
STRIDE = struct.calcsize(HEAD) + 2 * SEQUENCE
END = 50_256
KEY, ROUNDS = 0x5EED, 6
_ALL = (1 << 64) - 1
#: Sequences that a task gathers before it deals them to shards.
HELD = 120_000
#: Documents whose ids make one compressed block.
PACKED = 2048
#: Compression on the way: two ids are four bytes, so that matches of four are worth looking for.
PACKING = zstandard.ZstdCompressionParameters(window_log=23, hash_log=20, chain_log=20, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2)
#: Tasks that write shards; beyond it each writes a run of several, one after the other.
MAX_TASKS = 20_000
#: A sequence's place on the way to its shard, and what stands for a null id there.
PLACE, NULL = [("slot", "<u2"), ("doc", "<i8"), ("sequence", "<i4"), ("n", "<u2")], -(1 << 63)


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _round(half: np.ndarray, key: int, k: int, bits: int) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + (k + 1) * 0xBF58476D1CE4E5B9) & _ALL)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(31)) & np.uint64((1 << bits) - 1)


def _feistel(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    a, b = x >> np.uint64(bits), x & mask
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            a, b = b ^ _round(a, key, k, bits), a
        else:
            a, b = b, a ^ _round(b, key, k, bits)
    return (a << np.uint64(bits)) | b


def permute(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slot of each index below n, or with ``back`` the index of each slot."""
    bits = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    out = _feistel(np.asarray(index, np.uint64), bits, key, back)
    while (over := out >= n).any():
        out[over] = _feistel(out[over], bits, key, back)
    return out.astype(np.int64)


def materialise(docs: DataFrame, folder: str, path: str, pattern: str, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards to ``folder`` when the result is computed: a row per sequence with its slot, shard and byte offset."""

    def encode():
        enc = tokenizer(path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.array([*enc.encode_ordinary(t), END], np.uint16) for t in batch.column(1).to_pylist()]
            docs_ = list_array(batch.column(0), [len(ids)], pa.int64())
            return pa.RecordBatch.from_arrays([docs_, list_array([len(x) for x in ids], [len(ids)], pa.int32()), pa.array([_pack(ids)], pa.binary())], ["docs", "sizes", "ids"])

        return work

    # a row for each slice of documents, with the ids of all of them as one compressed block
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = cut(map_slices(given, "docs array<long>, sizes array<int>, ids binary", encode, PACKED))
    sequences = F.aggregate("sizes", F.lit(0).cast("long"), lambda n, k: n + F.ceil(k / SEQUENCE))
    n, start = 0, {}
    for r in sorted(coded.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(sequences).alias("n")).collect()):
        start[r.p], n = n, n + r.n

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = start.get(TaskContext.get().partitionId(), 0), []

        def out() -> pa.RecordBatch:
            """What is held, with the sequences of each shard as one compressed block, in the order of documents, and their places as another."""
            held.sort(key=lambda r: r[0] // SHARD)
            rows = []
            for shard, group in groupby(held, key=lambda r: r[0] // SHARD):
                group = list(group)
                places = np.array([(r[0] - shard * SHARD, NULL if r[1] is None else r[1], r[2], len(r[3])) for r in group], PLACE)
                rows.append((shard, _squeeze(b"".join(places[f].tobytes() for f in places.dtype.names)), _pack([r[3] for r in group])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["shard", "places", "ids"])

        for batch in batches:
            for docs_, sizes, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, done, rows = _unpack(block), 0, []
                for d, size in zip(docs_, sizes, strict=True):
                    rows += [(d, k // SEQUENCE, ids[done + k : done + min(size, k + SEQUENCE)]) for k in range(0, size, SEQUENCE)]
                    done += size
                held += [(slot, *r) for slot, r in zip(permute(np.arange(at, at + len(rows)), n, key).tolist(), rows, strict=True)]
                at += len(rows)
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for shard, group in groupby(blocks, key=lambda r: r[0]):
            size = min(SHARD, n - shard * SHARD)
            data, rows = np.zeros((size, STRIDE), np.uint8), []
            for _, places, block in group:
                ids, done = _unpack(block), 0
                for slot, d, k, count in _places(places):
                    record = struct.pack(HEAD, -1 if d == NULL else d, k, count) + ids[done : done + count].tobytes() + END.to_bytes(2, "little") * (SEQUENCE - count)
                    data[slot] = np.frombuffer(record, np.uint8)
                    rows.append((slot + shard * SHARD, None if d == NULL else d, k, count))
                    done += count
            put_file(file_of(folder, shard), data.tobytes())
            rows.sort(key=lambda r: r[0])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            slot, doc, seq, count = (pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([slot, pa.array([shard] * len(rows), pa.int64()), doc, seq, pa.array([r[0] % SHARD * STRIDE for r in rows], pa.int64()), count], ["slot", "shard", "doc_id", "sequence", "offset", "n_ids"])

    placed = coded.mapInArrow(place, "shard long, places binary, ids binary")
    # shards are known numbers, so each has its task without a pass that samples them; a task gets a run of shards
    shards = max(1, math.ceil(n / SHARD))
    parts = min(shards, MAX_TASKS)
    dealt = placed.repartitionById(parts, F.expr(f"cast(shard * {parts} div {shards} as int)")).sortWithinPartitions("shard")
    return dealt.mapInArrow(write, "slot long, shard long, doc_id long, sequence int, offset long, n_ids int")


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(compression_params=PACKING).compress(data)


def _places(block: bytes) -> list[tuple[int, int, int, int]]:
    """(slot in the shard, document, sequence, ids) of a block's sequences."""
    data, kind = zstandard.ZstdDecompressor().decompress(block), np.dtype(PLACE)
    n, at, columns = len(data) // kind.itemsize, 0, []
    for name in kind.names:
        columns.append(np.frombuffer(data, kind[name], n, at).tolist())
        at += n * kind[name].itemsize
    return list(zip(*columns, strict=True))


def _pack(ids: list[np.ndarray]) -> bytes:
    return _squeeze((np.concatenate(ids) if ids else np.zeros(0, np.uint16)).astype("<u2").tobytes())


def _unpack(block: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(block), "<u2")


def file_of(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def read(folder: str, slot: int, count: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, sequence, ids) of ``count`` slots from ``slot`` on, with one read per shard."""
    while count > 0:
        shard, k = divmod(slot, SHARD)
        take = min(count, SHARD - k)
        data = get_bytes(file_of(folder, shard), k * STRIDE, take * STRIDE)
        for a in range(0, len(data), STRIDE):
            d, s, n = struct.unpack_from(HEAD, data, a)
            yield d, s, np.frombuffer(data, "<u2", n, a + struct.calcsize(HEAD))
        slot, count = slot + take, count - take
