"""Free names, document trees, normal forms and other cases that once went wrong."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from intake.functions import text
from intake.operators import documents, features, layout
from intake.sources import files


def test_free_names_against_a_plain_rule(spark, monkeypatch):
    monkeypatch.setattr(documents, "NAMES", 3)
    rng = random.Random(8)
    names = ["x.pdf", "x (2).pdf", "x (3).pdf", "x (5).pdf", "x (2) (2).pdf", "y", "y (2)", "y (03)", "z (1).pdf", ".pdf", "a.b.pdf"]
    given = [(i, rng.choice(("f", "g", None)), rng.choice(names)) for i in range(150)]
    taken = [(rng.choice(("f", None)), n) for n in ("x.pdf", "x (4).pdf", "x (7).pdf", "y (2)", "x (9).pdf", "q.pdf")]
    out, used = {}, {*taken, *((f, n) for _, f, n in given)}
    kept = set(taken)
    for i, f, n in sorted(given):
        if (f, n) not in kept:
            kept.add((f, n))
            out[i] = n
            continue
        stem, dot, suffix = n.rpartition(".")
        k = 2
        name = lambda k: f"{stem} ({k}).{suffix}" if dot else f"{n} ({k})"  # noqa: E731, B023
        while (f, name(k)) in used:
            k += 1
        used.add((f, name(k)))
        out[i] = name(k)
    df = spark.createDataFrame(given, "file_id long, folder string, name string")
    got = documents.free_names(df, spark.createDataFrame(taken, "folder string, name string")).collect()
    assert {r.file_id: r.free_name for r in got} == out
    assert len({(r.folder, r.free_name) for r in got} | set(taken)) == len(got) + len(set(taken))


def test_free_names_of_the_batch_itself(spark):
    df = spark.createDataFrame([(1, "f", "x (2).pdf"), (2, "f", "x.pdf"), (3, "f", "x.pdf")], "file_id long, folder string, name string")
    assert [r.free_name for r in documents.free_names(df, df.limit(0).select("folder", "name")).orderBy("file_id").collect()] == ["x (2).pdf", "x.pdf", "x (3).pdf"]
    assert documents.free_names(df.limit(0), df.select("folder", "name")).count() == 0


def test_a_page_without_reason_ends_a_run(spark):
    rows = [("p1", "read", "ID1", ""), ("p2", "read", "", None), ("p3", "read", "", "continuation"), ("p4", "read", "ID2", None), ("p5", "read", None, "continuation"), ("p6", None, None, None), ("p7", "read", "", "declaration")]
    pages = spark.createDataFrame([(p, 1, k, 1, "BOPEMS", "Pune", s, None if k % 2 else "", i, r) for k, (p, s, i, r) in enumerate(rows)], "page_id string, owner long, received_ns long, source_page int, school string, location string, status string, code string, student_id string, skip_reason string")
    assert {r.page_id: r.auto_code for r in documents.pair_uncoded(pages).collect()} == {"p1": "B0-1", "p4": "B0-2", "p5": "B0-2"}


def test_boxes_at_one_place_have_an_order(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0, t) for t in "cab"], "page_id int, mid_y double, min_x double, text string").repartition(3)
    assert [r.text for r in features.reading_order(df).orderBy("position").collect()] == ["a", "b", "c"]


def test_heights_that_are_no_numbers_are_passed_over():
    rows = next(iter(layout.LADDERS.values()))
    (plain,), (mixed,) = layout.fit_ladders([list(rows)]), layout.fit_ladders([[*rows, float("nan"), None, float("inf")]])
    assert mixed == plain and mixed["error"] == mixed["error"]
    assert layout.fit_ladders([[float("nan")] * 9]) == [None]


DOCS = "document_id int, school_name string, grade_name string, division_name string, student_name string, student_id string, code string"


def paths(spark, folder):
    return sorted((r.document_id, r.path.rsplit("/", 1)[1]) for r in spark.read.parquet(folder).collect())


def test_two_calls_keep_both_trees(spark, tmp_path):
    folder = str(tmp_path / "tree")
    a, b, c = (1, "S1", "5", "A", "N", "I1", "B1-2"), (2, "S2", "5", "B", "M", "I2", "B1-3"), (3, "S1", "5", "A", "K", "I3", "B1-4")
    for rows in ([a], [b], [c]):
        files.write_document_tree(spark.createDataFrame(rows, DOCS), folder, "document_id")
    assert paths(spark, folder) == [(1, "N_I1_B1-2.pdf"), (2, "M_I2_B1-3.pdf"), (3, "K_I3_B1-4.pdf")]
    moved = spark.createDataFrame([(2, "S1", "5", "A", "M", "I2", "B1-9")], DOCS)
    for _ in range(2):  # corrected, so it moves; the second call adds nothing
        files.write_document_tree(moved, folder, "document_id")
    assert paths(spark, folder) == [(1, "N_I1_B1-2.pdf"), (2, "M_I2_B1-9.pdf"), (3, "K_I3_B1-4.pdf")]
    assert not (tmp_path / "tree/school=S2/grade=5/division=B").exists()


def test_files_by_batch_move_with_their_code(spark, tmp_path):
    folder = str(tmp_path / "sorted")
    schema, none = "file_id int, owner int, code string, code_source string", spark.createDataFrame([], "owner int, code string, status string")
    ready = spark.createDataFrame([(1, "B2-1", "ready"), (1, "B3-1", "needs_attention")], "owner int, code string, status string")
    files.write_by_batch(spark.createDataFrame([(1, 1, "B2-1", "read"), (2, 1, "B3-1", "read"), (3, 1, "B1-7", "typed"), (4, 1, None, "none")], schema), ready, folder)
    where = lambda: {r.file_id: r.folder for r in spark.read.parquet(folder).collect()}
    assert where() == {1: "B2", 3: "B1"}
    files.write_by_batch(spark.createDataFrame([(1, 1, "B4-1", "typed")], schema), none, folder)
    files.write_by_batch(spark.createDataFrame([], schema), none, folder)
    assert where() == {1: "B4", 3: "B1"}


def test_backup_holds_what_will_move(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, None), (2, 15, 20), (3, None, 3)], "id int, a int, b int")
    files.backup_before(df, ["a", "b"], F.lit(10), str(tmp_path / "old"))
    assert sorted((r.id, r.a, r.b) for r in spark.read.schema("id int, a int, b int").json(str(tmp_path / "old")).collect()) == [(1, 5, None), (3, None, 3)]


def ask(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names_in_normal_form(spark):
    names = ["e\u0301cole", "\u0958\u0932\u092e", "\u0915\u093c\u200d", "a\u200bb\u00adc\x07d", "\ufb01le", "\u00a0x\u2003y\u3000", "n\u0303" * 200, "a/b\\c", " .. ", "x" * 119 + ". y", None]
    got = ask(spark, names, text.safe_name)
    assert got == ["\u00e9cole", "\u0915\u093c\u0932\u092e", "\u0915\u093c", "abcd", "\ufb01le", "x y", "\u00f1" * 120, "a-b-c", "Unknown", "x" * 119, "Unknown"]


def plain_code(written):
    """A code by its definition over Unicode's compatibility form."""
    import re

    folded = unicodedata.normalize("NFKC", written or "").upper().strip()
    if not folded or folded[0] not in "B83":
        return None
    body = re.sub(f"[{text.DASHES}]", "-", folded[1:]).strip()
    parts = re.split(r"\s*-+\s*", body) if "-" in body else body.split()
    numbers = [re.sub(r"\s+", "", p).translate(str.maketrans("IL|O", "1110")) for p in parts]
    if len(numbers) != 2 or not all(re.fullmatch("(?a:[0-9]{1,3})", n) and int(n) for n in numbers):
        return None
    return f"B{int(numbers[0])}-{int(numbers[1])}"


def test_codes_in_other_forms_of_characters(spark):
    rng = random.Random(2)
    forms = {c: [chr(k) for k in range(0x80, 0x1F200) if unicodedata.normalize("NFKC", chr(k)).upper() == c] for c in "B0123456789-. "}
    written = ["B⑩-3", "Ｂ４－６", "𝐁𝟒-𝟗", "B²-³", "B⒈-2", "B4—⑳", "ⒷⅠ-1", "B½-2", "⑦"]
    for _ in range(400):
        code = f"{rng.choice('B83')}{rng.randint(0, 1200)}{rng.choice(('-', ' ', '--', '.', ' - '))}{rng.randint(0, 99)}"
        written.append("".join(rng.choice(forms[c]) if forms.get(c) and rng.random() < 0.4 else c for c in code))
    got = [x and x.code for x in ask(spark, written, text.parse_batch_code)]
    assert got == [plain_code(w) for w in written] and sum(x is not None for x in got) > 150


@pytest.mark.parametrize("empty", [True, False])
def test_numbered_within_large_keys(spark, empty):
    from intake.shared import numbered

    rows = [] if empty else [(i % 3 if i % 5 else None, i * 7 % 1000) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "k int, v int").repartition(7), ["k"], ["v"], "n").collect()
    by: dict = {}
    for k, v in sorted(rows, key=lambda r: (r[0] is not None, r)):
        by.setdefault(k, []).append(v)
    assert sorted(((r.k, r.v, r.n) for r in got), key=str) == sorted(((k, v, i + 1) for k, vs in by.items() for i, v in enumerate(vs)), key=str)


def test_first_call_writes_a_file_a_folder(spark, tmp_path):
    """Rows of many tasks are brought together by folder before the first write too."""
    rows = spark.range(40).selectExpr("cast(id as string) as document_id", "'S' || id % 2 as school_name", "'5' as grade_name", "'A' as division_name", "'n' || id as student_name", "'' as student_id", "'B1-1' as code")
    files.write_document_tree(rows.repartition(8), str(tmp_path / "tree"), "document_id")
    assert len(list((tmp_path / "tree").rglob("*.parquet"))) == 2
