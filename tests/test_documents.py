"""Tail lookups, typed pages and guarded sign-off on small scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from intake.operators import changes, documents, lookup

ROSTER = "person long, student_id string, student_name string, school_name string, grade_name string"


def test_tail_lookup(spark):
    roster = spark.createDataFrame([(1, "KELVOR120309", "K", "EAST", "5"), (2, "NORTAN140211", "N", "WEST", "5")], ROSTER)
    locations = spark.createDataFrame([("EAST", "X"), ("WEST", "X")], "school string, location string")
    files = [(1, "KELVOR120309", 10, "EAST", None, None), (2, "NORTAN140211", 10, "EAST", 9, "WEST"), (3, "NORTAN140211", 10, "EAST", None, None), (4, "a name", 10, "EAST", 9, "WEST"), (5, None, 10, "EAST", 9, "WEST")]
    df = spark.createDataFrame(files, "file_id long, reading string, batch_id long, batch_school string, tail_batch_id long, tail_school string")
    got = {r.file_id: (r.person, r.logged_under, r.reading) for r in lookup.find_with_tail(df, roster, locations).collect()}
    assert got == {1: (1, 10, "KELVOR120309"), 2: (2, 9, "NORTAN140211"), 3: (None, 10, "NORTAN140211"), 4: (None, 10, "a name"), 5: (None, 10, None)}


def test_typed_beats_read_if_it_is_one(spark):
    meta = spark.createDataFrame([(p, "read") for p in "abcd"] + [("e", "failed")], "page_id string, status string")
    read = spark.createDataFrame([("a", "B1-1", "KELVOR120309"), ("b", "B1-2", ""), ("c", None, "NORTAN140211"), ("d", "B1-4", "X")], "page_id string, code string, student_id string")
    typed = spark.createDataFrame([("a", "", ""), ("b", "b9-9", "KELVOR 120309"), ("c", "nonsense", None)], "page_id string, code string, student_id string")
    got = {r.page_id: (r.code, r.code_source, r.student_id, r.student_id_source, r.needs_person) for r in documents.page_view(meta, read, typed).collect()}
    assert got["a"] == ("B1-1", "read", "KELVOR120309", "read", False)
    assert got["b"] == ("B9-9", "typed", "KELVOR120309", "typed", False)
    assert got["c"] == (None, "none", "NORTAN140211", "read", True)
    assert got["e"][4] is True


def test_sign_off_needs_what_was_shown(spark):
    log = spark.createDataFrame([(1, True, "A"), (2, True, "B")], "id long, found_in_db boolean, matched_student_id string").withColumn("reviewed_at", F.lit(None).cast("timestamp_ntz"))
    pending = spark.createDataFrame([("A", 1), ("B", 2)], "student_id string, log_id long")
    shown = spark.createDataFrame([(2, "t")], "n long, token string")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    marked = lambda *guard: changes.mark_all_reviewed(log, pending, shown, *guard, at).where("reviewed_at is not null").count()
    assert (marked(2, "t", True), marked(3, "t", True), marked(2, "u", True), marked(2, "t", False)) == (2, 0, 0, 0)


def test_recheck_outcomes_and_no_null_key(spark):
    """Each outcome; corrections without a hit don't meet the shared identifiers, where all would go to one task."""
    df = spark.createDataFrame
    asked = df([(i, f"A{i}") for i in range(6)], "id long, corrected string")
    log = df([(i, i == 0) for i in range(5)], "id long, found_in_db boolean")
    exact = df([(0, "A0", True), (1, "A1", True), (2, "A2", False), (3, "A3", False), (5, "A5", True)], "id long, student_id string, in_scope boolean")
    got = changes.recheck(asked, log, exact, df([("A1",), ("A2",)], "student_id string"))
    assert [r.outcome for r in got.orderBy("id").collect()] == ["gone", "resolved", "shared_id", "not_exact_without_scope", "no_match", "gone"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("isnotnull(student_id#") == 2
