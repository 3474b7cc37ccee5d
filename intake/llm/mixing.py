"""Operator 4: mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n of N documents and target share w is to be seen ``scale * N * w / n`` times per document. Each document's number of copies is
drawn from the Poisson distribution with that mean by inverting its distribution function at a number
hashed from the id and the seed, so that any run on any cluster draws the same. A mean over ``PART``
is drawn as a sum of independent parts, which is again Poisson. Documents are exploded by their number
and dealt to partitions and ordered by a hash of id and copy: one shuffle.

The table of sources is broadcast if it has at most ``MAX_BROADCAST`` rows; otherwise it meets the documents in
a join on source and one of ``SALT`` parts of it, so that a source with a third of all rows is split.

Defined results: a null source counts as the empty source; a null id is hashed as the empty text; repeated rows are
drawn alike, as the draw follows the id; an empty table gives an empty table; sources without a target weight (when
weights are given) go; an input column ``replica`` is replaced. Null and empty texts are mixed as any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intake.llm.common import cut

#: Largest mean drawn at once, and the number of steps of its distribution function that matter in a double.
PART, STEPS = 32.0, 120
#: Sources that may be broadcast, and the parts of a source in a join.
MAX_BROADCAST, SALT = 10_000, 64
#: Targets follow the documents of a source to this power unless weights are given.
TEMPERATURE = 0.5
SEED = 20


def source_key() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, scale: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """(_source, n, rate, parts, cdf) of each source; target shares are ``weights``, else n to the power ``temperature``, made to sum to 1."""
    counts = docs.groupBy(source_key().alias("_source")).agg(F.count("*").alias("n"))
    share = F.pow("n", F.lit(temperature))
    if weights is not None:
        given = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.create_map().cast("map<string,double>")
        share = F.coalesce(F.element_at(given, F.col("_source")), F.lit(0.0))
    counts = cut(counts.withColumn("_share", share.cast("double")))
    total = counts.agg(F.sum("n").alias("n"), F.sum("_share").alias("w")).first()
    whole, mass = float(total.n or 0), total.w or 1.0
    rated = counts.withColumn("rate", F.lit(scale * whole) * (F.col("_share") / F.lit(mass)) / F.col("n"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("_r", F.col("rate") / F.col("parts"))
    cdf = F.expr(
        f"aggregate(sequence(1, {STEPS}), struct(exp(-_r) as p, array(exp(-_r)) as c), "
        "(a, k) -> struct(a.p * _r / k as p, concat(a.c, array(element_at(a.c, -1) + a.p * _r / k)) as c), a -> a.c)"
    )
    return cut(rated.select("_source", "n", "rate", "parts", cdf.alias("cdf")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, scale: float = 1.0, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as drawn, in a global random order; ``replica`` numbers the copies from 1."""
    docs = docs.drop("replica")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if docs.columns else F.struct()
    sources = rates(docs, weights, scale)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # the row travels as one column, so that no column of it meets those added here
    keyed = docs.select(row.alias("_row"), source_key().alias("_source"), ident.alias("_id"))
    if sources.count() <= MAX_BROADCAST:
        joined = keyed.join(F.broadcast(sources.select("_source", "parts", "cdf")), "_source")
    else:
        salted = sources.select("_source", "parts", "cdf", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
        joined = keyed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALT)).cast("int")).join(salted, ["_source", "_salt"]).drop("_salt")
    # the first 13 hex digits of the hash as a fraction; as many copies as steps of the distribution function are at most that
    unit = f"cast(conv(substr(md5(concat(_id, ':{seed}:', cast(j as string))), 1, 13), 16, 10) as bigint) / {1 << 52}D"
    copies = F.expr(f"aggregate(transform(transform(sequence(1, parts), j -> {unit}), u -> size(filter(cdf, c -> c <= u))), 0, (a, x) -> a + x)")
    # no filter, which would draw once more: an explode of null gives no row
    drawn = joined.withColumn("_copies", copies).withColumn("replica", F.explode(F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies")))))
    place = F.xxhash64(F.lit(seed), "_id", "replica")
    return drawn.withColumn("_place", place).repartition("_place").sortWithinPartitions("_place").select("_row.*", "replica")


def mix_sql(scale: float = 1.0, seed: int = SEED, temperature: float = TEMPERATURE) -> str:
    """The same draw over ``documents`` as SQL."""
    steps = math.ceil(STEPS)
    return f"""
with s as (select coalesce(source, '') as source_key, count(*) as n from documents group by 1),
r as (select source_key, {scale!r} * sum(n) over () * (pow(n, {temperature!r}) / sum(pow(n, {temperature!r})) over ()) / n as rate from s),
p as (select source_key, rate, greatest(1, ceil(rate / {PART!r}))::int as parts from r),
pmf as (select source_key, parts, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) as q from p, range({steps} + 1) t(k)),
cdf as (select source_key, parts, list(c order by k) as c from (select source_key, parts, k, sum(q) over (partition by source_key order by k) as c from pmf) group by 1, 2),
d as (select documents.*, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(c, lambda x: x <=
    (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{seed}:' || j::varchar), 1, 13))::bigint / {1 << 52}::double)))))::int as copies
  from documents join cdf on coalesce(source, '') = source_key)
select doc_id, text, lang, source, n_chars, replica::int as replica from (select *, unnest(range(1, copies + 1)) as replica from d)"""
