"""Bulk corrections: each takes a table and changes to it and gives the new table; inputs stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intake.operators.lookup import school_key



def _shift() -> Column:
    return F.expr("interval 5 hours 30 minutes")


def append_log(log: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """``log`` with the attempts after it, numbered on from its last id in order of ``reading_id``.

    Ids need one order over all new rows: they are ranked within ranges of ``reading_id`` and each range counts on from the ones before.
    """
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    dealt = attempts.withColumn("_range", F.floor(F.col("reading_id") / 10_000))
    before = dealt.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy("reading_id"))).join(before, "_range").crossJoin(last)
    new = ranked.select((F.col("last") + F.col("_before") + F.col("_k")).alias("id"), now.alias("created_at"), *[c for c in attempts.columns if c in log.columns])
    return log.unionByName(new, allowMissingColumns=True)


def mark_scanned(roster: DataFrame, matches: DataFrame) -> DataFrame:
    """``scanned_at`` set for matched people: identifier and school must both agree, blank with blank. ``matches``: student_id, school_name, scanned_at."""
    new = matches.groupBy(F.col("student_id").alias("_id"), school_key("school_name").alias("_school")).agg(F.max("scanned_at").alias("_at"))
    joined = roster.join(new, (F.col("student_id") == F.col("_id")) & (school_key("school_name") == F.col("_school")), "left")
    return joined.withColumn("scanned_at", F.coalesce("_at", "scanned_at")).drop("_id", "_school", "_at")


def resolve_attempts(log: DataFrame, resolved: DataFrame) -> DataFrame:
    """Not-found rows become found with their match; the reading stays, and rows already found do not change. ``resolved``: id, matched_student_id, school_name, matched_via."""
    new = resolved.select(F.col("id").alias("_id"), F.col("matched_student_id").alias("_m"), F.col("school_name").alias("_s"), F.col("matched_via").alias("_v")).dropDuplicates(["_id"])
    joined = log.join(new, (F.col("id") == F.col("_id")) & ~F.col("found_in_db"), "left")
    hit = F.col("_id").isNotNull()
    pick = lambda c, x: F.when(hit, F.col(x)).otherwise(F.col(c)).alias(c)
    changed = {"found_in_db": (F.col("found_in_db") | hit).alias("found_in_db"), "matched_student_id": pick("matched_student_id", "_m"), "school_name": pick("school_name", "_s"), "matched_via": pick("matched_via", "_v")}
    return joined.select(*(changed.get(c, F.col(c)) for c in log.columns))


def mark_reviewed(log: DataFrame, people: DataFrame, through_id: int, at: Column) -> DataFrame:
    """Found, unchecked rows of the listed people up to an id are signed off. ``people``: student_id."""
    listed = people.select(F.upper(F.trim("student_id")).alias("_p")).distinct()
    joined = log.join(listed, F.upper(F.trim("matched_student_id")) == F.col("_p"), "left")
    due = F.col("_p").isNotNull() & F.col("found_in_db") & F.col("reviewed_at").isNull() & (F.col("id") <= through_id)
    return joined.withColumn("reviewed_at", F.when(due, at).otherwise(F.col("reviewed_at"))).drop("_p")


def mark_all_reviewed(log: DataFrame, pending: DataFrame, shown: DataFrame, expected: int, token: str, named: bool, at: Column) -> DataFrame:
    """Everyone pending signed off, if a school or city is named and ``shown`` (n, token: one row) is still what the person saw; else ``log`` as it is."""
    state = shown.first()
    if not named or state is None or (state.n, state.token) != (expected, token):
        return log
    last = pending.agg(F.max("log_id")).first()[0]
    return log if last is None else mark_reviewed(log, pending, last, at)


def delete_not_found(log: DataFrame, ids: DataFrame) -> DataFrame:
    gone = log.where("not found_in_db").join(ids.select("id"), "id", "left_semi").select("id")
    return log.join(gone, "id", "left_anti").select(*log.columns)


def attach_links(log: DataFrame, links: DataFrame) -> DataFrame:
    """``links``: id, link; the greatest link of an id counts."""
    new = links.groupBy("id").agg(F.max("link").alias("link"))
    return log.drop("link").join(new, "id", "left").select(*log.columns, *(["link"] if "link" not in log.columns else []))


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key: the newest by ``order``, changes before base among equals."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*base.columns), F.struct(order, "_new")).alias("_r")).select("_r.*")


def shift_times(df: DataFrame, columns: list[str], cutoff: Column, skip: DataFrame | None = None, marker: str = "times_shifted") -> DataFrame:
    """Times before the cut-off moved from UTC to India time, but for rows listed in ``skip`` (id); refused on a table that is marked as moved."""
    if marker in df.columns:
        raise ValueError("these times have been shifted already")
    joined = df.withColumn("_skip", F.lit(False)) if skip is None else df.join(skip.select(F.col("id").alias("_k")), F.col("id") == F.col("_k"), "left").withColumn("_skip", F.col("_k").isNotNull()).drop("_k")
    moved = {c: F.when(~F.col("_skip") & (F.col(c) < cutoff), F.col(c) + _shift()).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(moved).withColumn(marker, F.lit(True)).drop("_skip")


def merge_links(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn(new, F.coalesce(new, old)).drop(old)


def recheck(corrections: DataFrame, log: DataFrame, exact: DataFrame, shared: DataFrame) -> DataFrame:
    """What becomes of each correction. ``corrections``: id, corrected; ``exact``: id, student_id, in_scope of the exact hit, if any; ``shared``: student_id."""
    open_ = log.where("not found_in_db").select("id", F.lit(True).alias("_open"))
    # the hits meet the shared identifiers before the corrections, as those without a hit would all go to one task; only their outcome goes on, which sorts in less memory
    hits = exact.where("student_id is not null").join(shared.select(F.col("student_id").alias("_shared")), F.col("student_id") == F.col("_shared"), "left")
    hit = F.when(F.col("in_scope"), "resolved").when(F.col("_shared").isNotNull(), "shared_id").otherwise("not_exact_without_scope")
    joined = corrections.join(open_, "id", "left").join(hits.select("id", hit.alias("_hit")), "id", "left")
    outcome = F.when(F.col("_open").isNull(), "gone").otherwise(F.coalesce("_hit", F.lit("no_match")))
    return joined.select("id", "corrected", outcome.alias("outcome"))
