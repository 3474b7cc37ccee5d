"""Operator 6: document fingerprints by SpotSigs, in DataFrame functions only.

Common words of four languages are anchors. Each anchor with the next two content words that follow it, common words
skipped, is a spot signature, kept as a 32-bit hash; the start of the text is an anchor too, so that every text with a content word has a signature.
The fingerprint is the ordered set of signatures in hex. Likeness is the Jaccard index of two sets; it
is pruned by set length: sets whose sizes alone keep it below a threshold are not compared, and sets fall
in length classes so that only equal and adjacent classes can hold likely pairs.

``classes`` finds all texts with a likeness of ``LIKE`` or more. Equal sets fall together. A set's signatures are put in one order, frequent ones last,
and keyed by the first of them that likely sets must share one of. Sets that meet under a key are compared only if they are in equal or adjacent
length classes, if their sizes, their places under the key and the parities of their hash bins allow the likeness, and then by their signatures. A key's sets
first meet its leader; only keys whose sets lie in several groups after that give pairs, of sets of different groups.

Positions need no pass in order: the k-th anchor at position p has p - k content words before it, so its
chain is read from the array of content words.

``with_next`` gives each row the row that follows in the order of ids without a global sort: ids are cut
into ranges at percentiles that are ids themselves, rows are dealt by range (the one shuffle of texts), and the row at each cut is
sent to the range before as well.

Defined results: a null text counts as empty, has the empty fingerprint and likeness 1 to another empty set
and 0 to any other; repeated ids are ordered by text, and the next row may have the same id; rows without an id come first;
after the last row comes the first, which may be the same; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intake.llm.common import cut
from intake.llm.components import components

# Common words of English, French, German and Spanish.
COMMON = """
a an and are as at be by for from has have he in is it not of on or that the this to was were which with you
au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une
auf das dem den der die ein eine er es für ich im ist mit nicht sich sie und von zu
al como con del el las lo los más no para por su y
""".split()
#: The start of a text as an anchor.
START = "^"
#: Sets of which one is smaller than this share of the other can't reach the likeness.
LIKE = 0.8
#: Signatures known as frequent, the sets of which one is counted for that order (it changes costs, never the pairs), and the leaders that a set meets.
FREQUENT, ORDER_FROM, LEADERS = 4096, 16, 3
#: Words of the parity sketch.
ODD = ("p0", "p1", "p2", "p3")


def with_spots(df: DataFrame, text: Column, to: str) -> DataFrame:
    """``df`` with the signature set of ``text`` as an ordered array of int."""
    common = ", ".join(f"'{w}'" for w in [START, *COMMON])
    df = df.withColumn("_s_t", F.lower(F.coalesce(text, F.lit(""))))
    df = df.withColumn("_s_w", F.expr(f"concat(array('{START}'), filter(split(_s_t, '[^\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]+'), x -> x <> ''))"))
    df = df.withColumns({
        "_s_c": F.expr(f"filter(_s_w, x -> x not in ({common}))"),
        "_s_p": F.expr(f"filter(transform(_s_w, (x, i) -> if(x in ({common}), i, null)), x -> x is not null)"),
    })
    df = df.withColumn(to, F.expr("transform(_s_p, (p, k) -> if(p - k < size(_s_c), hash(_s_w[p], _s_c[p - k], get(_s_c, p - k + 1)), null))"))
    return df.withColumn(to, F.expr(f"sort_array(array_distinct(filter({to}, x -> x is not null)))")).drop("_s_t", "_s_w", "_s_c", "_s_p")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard index of two signature sets; 0 without comparing them if their sizes keep it below ``least``."""
    shared = f"size(array_intersect({a}, {b}))"
    small, large = f"least(size({a}), size({b}))", f"greatest(size({a}), size({b}))"
    return F.expr(f"case when {large} = 0 then 1D when {small} = 0 or {small} < {least}D * {large} then 0D else {shared} / cast(size({a}) + size({b}) - {shared} as double) end")


def length_class(spots: str) -> Column:
    """Sets with a likeness of at least ``LIKE`` are in one class or in adjacent ones."""
    return F.floor(F.log(F.greatest(F.size(spots), F.lit(1))) / -math.log(LIKE)).cast("int")


def as_text(spots: str) -> Column:
    return F.expr(f"array_join(transform({spots}, x -> lpad(lower(hex(cast(x as bigint) & 4294967295)), 8, '0')), '')")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """``docs`` dealt by ranges of ids, with rows marked ``_extra`` that stand for the next range's first; and the window whose lead is the next row."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(id_col, [k / parts for k in range(parts)], 20 * parts).alias("cuts"), F.min(id_col).alias("least"), F.count(F.when(F.col(id_col).isNull(), 1)).alias("none")).first()
    cuts = sorted({found.least, *(found.cuts or [])} - {None}) or [0]
    bits = len(cuts).bit_length()
    # the number of cuts at or below the id, by halving
    steps = F.array(*(F.lit(1 << k) for k in range(bits - 1, -1, -1)))
    ends = F.lit(cuts)
    at = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= len(cuts)) & (F.get(ends, n + k - 1) <= F.col(id_col)), n + k).otherwise(n))
    dealt = docs.withColumn("_range", F.greatest(F.coalesce(at, F.lit(0)) - 1, F.lit(0)))
    first = F.col(id_col).isNull() if found.none else F.col(id_col) == F.lit(cuts[0])
    to = F.when(first, F.array(F.struct(F.lit(len(cuts) - 1).alias("r"), F.lit(1).alias("x")))).otherwise(F.array().cast("array<struct<r:int,x:int>>"))
    before = F.when((F.col("_range") > 0) & (F.col(id_col) == F.get(ends, F.col("_range"))), F.array(F.struct((F.col("_range") - 1).alias("r"), F.lit(1).alias("x")))).otherwise(F.array().cast("array<struct<r:int,x:int>>"))
    spread = dealt.withColumn("_to", F.explode(F.concat(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("x"))), to, before)))
    rows = spread.withColumn("_range", F.col("_to.r")).withColumn("_extra", F.col("_to.x")).drop("_to")
    return rows, Window.partitionBy("_range").orderBy("_extra", F.asc_nulls_first(id_col), F.asc_nulls_first(text_col))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint beside that of its text with the last half taken from the next row.

    Gives the id, ``edited`` (text), the sets ``spots`` and ``edited_spots``, ``near_edited`` and ``near_next``.
    """
    rows, order = with_next(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)), id_col, text_col)
    rows = rows.withColumn("_next", F.lead(text_col).over(order))
    half = f"cast(floor(length({text_col}) / 2) as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(left({text_col}, length({text_col}) - {half}), left(_next, {half}))")).drop("_next")
    rows = with_spots(with_spots(rows, F.col(text_col), "spots"), F.col("edited"), "edited_spots")
    rows = rows.withColumn("_next_spots", F.lead("spots").over(order)).where("_extra = 0")
    return rows.select(id_col, text_col, "edited", "spots", "edited_spots", likeness("spots", "edited_spots").alias("near_edited"), likeness("spots", "_next_spots").alias("near_next"))


def _may_be_like(x: str, y: str) -> Column:
    """Whether sets met under a key can reach the likeness (4/5), by sizes, places under the key and parities; columns n, at and the sketch with these prefixes."""
    apart = " + ".join(f"bit_count({x}{p} ^ {y}{p})" for p in ODD)
    return F.expr(f"5 * least({x}n, {y}n) >= 4 * greatest({x}n, {y}n) and 9 * least({x}n - {x}at, {y}n - {y}at) >= 4 * ({x}n + {y}n) and 9 * ({apart}) <= {x}n + {y}n")


def _like(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets with the likeness, by their signatures; written, as two steps need them."""
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("spots").alias("_x")), "a").join(sets.select(F.col("set").alias("b"), F.col("spots").alias("_y")), "b")
    return cut(both.where(likeness("_x", "_y", LIKE) >= LIKE).select("a", "b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its id and ``class_id``, the least id of its class. Texts of one class are linked, over others perhaps, by a likeness of ``LIKE`` or more.

    Null, empty and wordless texts have the empty set and are one class; a class of rows without ids has none; an empty table gives an empty table; other columns go.
    """
    rows = with_spots(docs.select(F.col(id_col), F.col(text_col).alias("_text")), F.col("_text"), "spots").select(id_col, "spots", F.xxhash64("spots").alias("set"))
    rows = cut(rows)
    sets = rows.groupBy("set").agg(F.first("spots").alias("spots"))
    counted = rows.where(F.pmod("set", F.lit(ORDER_FROM)) == 0).select(F.explode("spots").alias("s")).groupBy("s").count()
    frequent = F.lit([r.s for r in counted.orderBy(F.desc("count"), "s").limit(FREQUENT).collect()]).cast("array<int>")
    n = F.size("spots")
    ordered = F.concat(F.array_except("spots", "_common"), F.col("_common"))
    heads = F.slice(ordered, F.lit(1), n - F.ceil(n * 4 / 5).cast("int") + 1)
    odd = [F.expr(f"aggregate(spots, 0L, (a, x) -> a ^ if((x >> 6 & 3) = {k}, shiftleft(1L, x & 63), 0L))").alias(p) for k, p in enumerate(ODD)]
    # sketches are made before the keys are exploded, else for each key again
    sketches = sets.where(n > 0).withColumn("_common", F.array_intersect("spots", frequent)).select("set", n.alias("n"), *odd, heads.alias("heads"))
    sketched = sketches.select("set", "n", *ODD, F.posexplode("heads").alias("at", "key"))
    order = Window.partitionBy("key").orderBy("at", "set")
    one = F.struct("set", "n", "at", *ODD)
    met = cut(sketched.select("*", F.first(one).over(order).alias("leader"), F.lead("set").over(order).alias("_more")).where("leader.set <> set or _more is not null").drop("_more"))
    led = met.where((F.col("leader.set") != F.col("set")) & _may_be_like("", "leader.")).groupBy("set").agg(F.slice(F.sort_array(F.collect_set("leader.set")), 1, LEADERS).alias("l"))
    edges = _like(led.select(F.col("set").alias("a"), F.explode("l").alias("b")), sets)
    grouped = met.drop("leader").join(components(edges).withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    split = grouped.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    # sets under one key and in one length class, or in the next, of different groups
    rest = cut(grouped.join(split, "key").withColumn("length_class", F.floor(F.log(F.col("n").cast("double")) / -math.log(LIKE) + 1e-9).cast("int")))
    x = rest.select("key", *(F.col(c).alias(f"x_{c}") for c in ("set", "root", "n", "at", *ODD)), F.explode(F.expr("array(length_class, length_class + 1)")).alias("length_class"))
    y = rest.select("key", *(F.col(c).alias(f"y_{c}") for c in ("set", "root", "n", "at", *ODD)), "length_class")
    late = x.join(y, ["key", "length_class"]).where((F.col("x_root") != F.col("y_root")) & _may_be_like("x_", "y_")).select(F.least("x_set", "y_set").alias("a"), F.greatest("x_set", "y_set").alias("b")).distinct()
    roots = components(edges.union(_like(cut(late), sets)))
    rooted = rows.select(id_col, "set").join(roots.withColumnRenamed("node", "set"), "set", "left").select(id_col, F.coalesce("root", "set").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min(id_col).alias("class_id"))
    return rooted.join(least, "_root").select(id_col, "class_id")
