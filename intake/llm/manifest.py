"""A Merkle manifest of a dataset: a leaf per row, a tree per source, a tree over the sources, and a proof per row.

A leaf's place among its source's ids is a rank query, not a sort: the ids of a source are kept as bitmap words of 64 (words
without an id are absent), each with the number of ids before it, which comes from running sums over digits of the word's number,
so that no sum is over more than 65,537 rows whatever the ids are. Slots of 256 nodes are then keyed arrays; one pass reduces
two levels of the tree, and the proofs come down the same arrays.

Defined results: an empty table has an empty manifest. Nulls are hashed as ``-``. A null id comes before all others, equal ids are
ordered by their leaves, and rows equal in all five columns have slots in a row and are alike but for their proofs. Ids are whole numbers of 64 bits at most. A
very long text is hashed whole, in one row. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intake.llm.common import ascii_lower, cut, id_hash

#: Children of a node; nodes in a slot array (two levels of them); bits of a digit of the word numbers.
FAN, SPAN, DIGIT = 16, 256, 14
#: Columns that a leaf is made of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The word of rows without an id: the one before the least that an id of 64 bits has.
NULL_WORD = -(2**57) - 1
_PATH = "array<struct<l:string,r:string>>"


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in texts]), 256)


def _key(source: Column) -> Column:
    """A source as a key that is never null and sorts like it, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _word(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id.cast("long"), 6), F.lit(NULL_WORD))


def directory(docs: DataFrame) -> DataFrame:
    """Bitmap words of each source with how many rows come before them: key, w, bits, n, base, total. Reads two columns."""
    ids = docs.select(_key(F.col("source")).alias("key"), F.col("doc_id").cast("long").alias("id"))
    words = cut(ids.groupBy("key", _word(F.col("id")).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(coalesce(id & 63, 0) AS int)))").alias("bits"), F.count("*").alias("n")))
    levels, at = [], words.select("key", F.col("w").alias("k"), "n")
    for last in (False, False, False, True):
        up = F.lit(0).cast("long") if last else F.shiftright("k", DIGIT)
        part = Window.partitionBy("key", "up")
        before = F.coalesce(F.sum("n").over(part.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = at.withColumn("up", up).select("key", "k", "up", "n", before.alias("before"), F.sum("n").over(part).alias("sum"))
        levels.append(at)
        at = at.groupBy("key", F.col("up").alias("k")).agg(F.sum("n").alias("n"))
    base = levels[-1].select("key", F.col("k").alias("up"), F.col("before").alias("more"), F.col("sum").alias("total"))
    for level in levels[-2::-1]:
        base = level.join(base, ["key", "up"]).select("key", F.col("k").alias("up"), (F.col("before") + F.col("more")).alias("more"), "total")
    return words.join(base.select("key", F.col("up").alias("w"), F.col("more").alias("base"), "total"), ["key", "w"])


def _ranked(leaves: DataFrame, words: DataFrame) -> DataFrame:
    """The slot of each leaf within its source. Words that hold an id twice are ranked by counts of (id, leaf)."""
    held = leaves.join(words, ["key", "w"])
    single = F.expr("bit_count(bits) = n")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, cast(coalesce(id & 63, 0) AS int)))")
    ranked = held.where(single).select("key", "total", (F.col("base") + below).alias("slot"), F.col("id"), "digest", "tampered")
    if words.where(~single).isEmpty():
        return ranked
    row = ["key", "w", "base", "total", "id", "digest", "tampered"]
    rows = cut(held.where(~single).groupBy(*row).agg(F.count("*").alias("c")).withColumn("p", F.substring("digest", 1, 4)))
    sums = rows.groupBy("key", "w", "id", "p").agg(F.sum("c").alias("c"))
    first = Window.partitionBy("key", "w").orderBy("id", "p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "w", F.col("id").alias("_id"), "p", F.coalesce(F.sum("c").over(first), F.lit(0)).alias("before"))
    within = Window.partitionBy("key", "w", "id", "p").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("c").over(within), F.lit(0))).join(sums.withColumnRenamed("key", "_k").withColumnRenamed("w", "_w").withColumnRenamed("p", "_p"), (F.col("key") == F.col("_k")) & (F.col("w") == F.col("_w")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("p") == F.col("_p")))
    start = F.col("base") + F.col("before") + F.col("within")
    copies = rows.withColumn("start", start).select("key", "total", F.explode(F.sequence("start", F.col("start") + F.col("c") - 1)).alias("slot"), "id", "digest", "tampered")
    return ranked.unionByName(copies)


def height(total: Column) -> Column:
    """Levels above ``total`` leaves: the hexadecimal digits of the last slot, as a node has 16 children."""
    return F.when(total == 1, 0).otherwise(F.length(F.hex(total - 1)))


def climb(nodes: DataFrame, highest: int) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of every two levels, and the top of each key's tree. ``nodes``: key, total, slot, digest and whatever else the leaves carry."""
    nodes, arrays, tops = nodes.withColumn("h", height(F.col("total"))), [], []
    for s in range(max(1, (highest + 1) // 2)):
        carried = [c for c in nodes.columns if c not in ("key", "h", "total", "slot")]
        group = nodes.groupBy("key", "h", F.shiftright("slot", 8).alias("g")).agg(F.array_sort(F.collect_list(F.struct("slot", *carried))).alias("nodes"))
        group = group.withColumn("a", F.expr("transform(nodes, x -> x.digest)"))
        group = group.withColumn("b", F.expr(f"transform(sequence(0, size(a) - 1, {FAN}), s -> sha2(array_join(slice(a, s + 1, {FAN}), ''), 256))"))
        group = cut(group.withColumn("digest", F.expr(f"CASE WHEN h <= {2 * s} THEN a[0] WHEN h = {2 * s + 1} THEN b[0] ELSE sha2(array_join(b, ''), 256) END")))
        arrays.append(group)
        tops.append(group.where(F.col("h") <= 2 * s + 2).select("key", "digest"))
        nodes = group.where(F.col("h") > 2 * s + 2).select("key", "h", F.col("g").alias("slot"), "digest")
    return arrays, reduce(DataFrame.union, tops)


def descend(arrays: list[DataFrame], above: DataFrame) -> DataFrame:
    """Each leaf with its siblings on the way to the root: key, slot, what it carries, path. ``above``: key, path from the key's top on."""
    upper = None
    for s in range(len(arrays) - 1, -1, -1):
        at = arrays[s].where(F.col("h") <= 2 * s + 2).join(above, "key")
        if upper is not None:
            at = at.unionByName(arrays[s].where(F.col("h") > 2 * s + 2).join(upper, ["key", "g"]))
        run = at.select("key", "h", "g", "a", "b", "path", F.posexplode("nodes").alias("i", "node"))
        low = f"struct(array_join(slice(a, i - i % {FAN} + 1, i % {FAN}), '') AS l, array_join(slice(a, i + 2, {FAN} - 1 - i % {FAN}), '') AS r)"
        high = f"struct(array_join(slice(b, 1, cast(i div {FAN} AS int)), '') AS l, array_join(slice(b, cast(i div {FAN} AS int) + 2, {FAN}), '') AS r)"
        path = F.expr(f"concat(IF(h > {2 * s}, array({low}), cast(array() AS {_PATH})), IF(h > {2 * s + 1}, array({high}), cast(array() AS {_PATH})), path)")
        found = run.select("key", (F.col("g") * SPAN + F.col("i")).alias("slot"), "node", path.alias("path"))
        upper = found.select("key", F.col("slot").alias("g"), "path")
    return found.select("key", "node.*", "path")


def _in_order(keys: DataFrame) -> DataFrame:
    """``slot``: the place of each row by ``key``, without one task for all: ranges of keys, and the sizes of the ranges before."""
    ranged = cut(keys.repartitionByRange("key").sortWithinPartitions("key").withColumn("_id", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    at = ranged.withColumn("_part", F.shiftright("_id", 33)).join(starts, "_part")
    return at.withColumn("slot", F.col("_start") + F.col("_id").bitwiseAND(F.lit(2**33 - 1))).drop("_id", "_part", "_start")


def manifest(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """Leaf, subroot, root, path and folded root of every row. ``tamper``: rows whose text is lower-cased before their leaf is folded."""
    docs = docs.select(*FIELDS)
    spark, fields = docs.sparkSession, [F.col(c) for c in FIELDS]
    words = cut(directory(docs))
    most = words.agg(F.max(height(F.col("total")))).first()[0]
    changed = F.when(tamper, leaf([*fields[:-1], ascii_lower(F.col("text"))])) if tamper is not None else F.lit(None).cast("string")
    leaves = docs.select(_key(F.col("source")).alias("key"), F.col("doc_id").cast("long").alias("id"), _word(F.col("doc_id")).alias("w"), leaf(fields).alias("digest"), changed.alias("tampered"))
    arrays, tops = climb(_ranked(leaves, words), most or 0)
    subroots = cut(_in_order(tops))
    count = subroots.count()
    trees, top = climb(subroots.select(F.lit("").alias("key"), F.lit(count).cast("long").alias("total"), "slot", "digest", F.col("key").alias("source_key")), len(f"{count - 1:x}") if count > 1 else 0)
    root = top.first()
    start = spark.createDataFrame([("", [])], f"key string, path {_PATH}")
    sources = descend(trees, start).select(F.col("source_key").alias("key"), F.col("digest").alias("subroot"), "path")
    found = descend(arrays, sources.select("key", "path")).join(sources.select("key", "subroot"), "key")
    fold = "aggregate(path, coalesce(tampered, digest), (x, p) -> sha2(concat(p.l, x, p.r), 256))"
    proof = "sha2(array_join(transform(path, p -> concat(p.l, p.r)), ''), 256)"
    return found.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(root[1] if root else None).cast("string").alias("root"), F.expr(proof).alias("proof_sha256"), F.expr(fold).alias("folded_root"), "path",
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_rows(doc_id: Column) -> Column:
    """The fifth of the rows that the check of the manifest tampers with."""
    return id_hash(doc_id) % 5 == 0
