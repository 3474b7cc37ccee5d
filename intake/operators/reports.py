"""Progress, history and review reports over the roster and the log of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intake.functions.text import review_flag
from intake.operators.lookup import school_key

# Ways of matching that need no check by a person.
EXACT_WAYS = ("exact", "shape_fix")

#: Hex digits of a line's hash that pick its range: 65,536 ranges.
TOKEN_DIGITS = 4


def school_progress(roster: DataFrame, locations: DataFrame) -> DataFrame:
    """Totals and scanned people per school, per city and over all, in one pass."""
    keyed = roster.select(school_key("school_name").alias("school"), "scanned_at").join(locations, "school")
    return keyed.rollup("location", "school").agg(F.count("*").alias("total"), F.count("scanned_at").alias("scanned"))


def list_schools(roster: DataFrame) -> DataFrame:
    return roster.select(F.trim("school_name").alias("school_name")).where("school_name <> ''").distinct().orderBy("school_name")


def latest_found(log: DataFrame) -> DataFrame:
    """The newest found row of each matched person; the last of a group by id needs no sort of the group."""
    return log.where("found_in_db and matched_student_id is not null").groupBy("matched_student_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "matched_student_id"]), "id").alias("_r")).select("matched_student_id", "_r.*")


def in_scope(df: DataFrame, locations: DataFrame, school: str | None, location: str | None) -> DataFrame:
    """Rows of the school, else of the city's schools, else all; a city without schools has no rows."""
    if school:
        return df.where(school_key("school_name") == school.strip().upper())
    if location:
        return df.join(locations.where(F.col("location") == location).select("school"), school_key("school_name") == F.col("school"), "left_semi")
    return df


def matching(df: DataFrame, search: str | None, *columns: str) -> DataFrame:
    """Rows with the search in a column; ``%`` and ``_`` typed by the user stay wildcards."""
    if not search:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.upper(F.coalesce(F.col(c), F.lit(""))).like(f"%{search.upper()}%")
    return df.where(hit)


def scanned_students(roster: DataFrame, log: DataFrame, locations: DataFrame, search=None, school=None, location=None) -> DataFrame:
    """Scanned people of the scope with how their newest row matched, newest first."""
    rows = matching(in_scope(roster.where("scanned_at is not null"), locations, school, location), search, "student_id", "student_name")
    newest = latest_found(log).select(F.upper(F.trim("matched_student_id")).alias("_id"), F.col("id").alias("log_id"), "matched_via", "confirmed_student_id", "reviewed_at")
    return rows.join(newest, F.upper(F.trim("student_id")) == F.col("_id"), "left").drop("_id").orderBy(F.desc("scanned_at"), "student_id", "school_name", "person")


def page_of(df: DataFrame, size: int, page: int = 0) -> DataFrame:
    return df.offset(size * page).limit(size)


def not_found_attempts(log: DataFrame, locations: DataFrame, search=None, school=None, location=None) -> DataFrame:
    rows = log.where("not found_in_db").withColumn("school", F.coalesce("scan_school", "school_name"))
    scoped = in_scope(rows.withColumn("school_name", F.col("school")), locations, school, location)
    return matching(scoped, search, "confirmed_student_id").select("id", "created_at", "confirmed_student_id", "school", "source").orderBy(F.desc("id"))


def pending_review(roster: DataFrame, log: DataFrame, locations: DataFrame, search=None, school=None, location=None) -> DataFrame:
    """Scanned people whose newest found row is a guess that nobody has checked."""
    rows = scanned_students(roster, log, locations, search, school, location)
    return rows.where(F.col("log_id").isNotNull() & ~F.coalesce(F.col("matched_via"), F.lit("")).isin(*EXACT_WAYS) & F.col("reviewed_at").isNull()).select("student_id", "school_name", "log_id", "matched_via")


def review_token(pending: DataFrame) -> DataFrame:
    """One row: the number of pending people and a digest of who they are and of their newest rows.

    Lines are digested within ranges of their hashes, and the ranges' digests together, so that no list of all people is held.
    """
    people = pending.select(F.concat_ws(":", F.upper(F.trim("student_id")), F.col("log_id").cast("string")).alias("line")).distinct()
    dealt = people.groupBy(F.substring(F.sha2("line", 256), 1, TOKEN_DIGITS).alias("range"))
    parts = dealt.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "part"))), lambda x: x["part"]), "\n")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.substring(F.sha2(whole, 256), 1, 32).alias("token"))


def review_flags(log: DataFrame) -> DataFrame:
    return log.select("id", review_flag(F.col("matched_via"), F.col("reviewed_at"), F.col("found_in_db")).alias("flag"))


def shared_ids(roster: DataFrame) -> DataFrame:
    """Identifiers held at more than one school."""
    return roster.groupBy(F.upper(F.trim("student_id")).alias("student_id")).agg(F.count_distinct(school_key("school_name")).alias("schools"), F.count("*").alias("holders")).where("schools > 1")


def authorized_staff(sign_ins: DataFrame, employees: DataFrame, schools: list[str], designations: list[str]) -> DataFrame:
    ok = employees.where(F.upper(F.trim("school_acronym")).isin([s.upper() for s in schools]) | F.lower(F.trim("designation")).isin([x.lower() for x in designations]))
    return sign_ins.join(ok.select(F.lower(F.trim("work_email")).alias("_e")), F.lower(F.trim("email")) == F.col("_e"), "left_semi")


def batch_results(log: DataFrame, batch: int, after: int = 0) -> DataFrame:
    return log.where((F.col("source") == f"drive:{batch}") & (F.col("id") > after)).orderBy("id")


def shift_preview(df: DataFrame, columns: list[str], cutoff: Column) -> DataFrame:
    """Per column: rows before the cut-off, the three newest of them, and the first value left alone."""
    long = df.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("timestamp_ntz"))))).alias("column_name", "t")).where("t is not null")
    order = Window.partitionBy("column_name").orderBy(F.desc("t"))
    top = long.where(F.col("t") < cutoff).withColumn("k", F.row_number().over(order)).where("k <= 3").groupBy("column_name").agg(F.array_sort(F.collect_list("t")).alias("newest"))
    counts = long.groupBy("column_name").agg(F.count(F.when(F.col("t") < cutoff, 1)).alias("moved"), F.min(F.when(F.col("t") >= cutoff, F.col("t"))).alias("first_kept"))
    return counts.join(top, "column_name", "left")
