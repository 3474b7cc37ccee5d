"""Readers and writers round-trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from intake.operators import features
from intake.sources import files


def test_tables_round_trip(spark, tmp_path):
    rows = [("KELVOR120309", "A, B", "S", "5", "A", "2026", "M", "Active", None)]
    df = spark.createDataFrame(rows, files.SCHEMAS["roster"])
    for form in ("parquet", "csv", "json", "orc"):
        df.write.format(form).option("header", "true").save(str(tmp_path / form))
        assert files.read_table(spark, "roster", str(tmp_path / form), form).collect() == df.collect()


def test_page_results_take_defaults(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"page_id": "a", "new_key": 1, "matched_student": {"student_id": "X"}}\n{"page_id": "b", "candidates": ["Q"], "blank": true}\n')
    got = {r.page_id: r for r in files.read_page_results(spark, str(tmp_path)).collect()}
    assert (got["a"].student_id, got["a"].candidates, got["a"].blank, got["a"].matched_student.student_id) == ("", [], False, "X")
    assert (got["b"].candidates, got["b"].blank) == (["Q"], True)


def test_scan_files(spark, tmp_path):
    for name, data in {"a.jpg": b"x", "b.TIF": b"II*\0rest", "c.tiff": b"not one", "d.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.scan_files(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.jpg", "b.TIF"]


def test_listings(spark):
    pages = spark.createDataFrame([("1", "a.pdf", "application/pdf", 5, "t2"), ("2", "[done] b.pdf", "application/pdf", 5, "t1"), ("3", "c.png", "image/png", 0, "t1"), ("4", "d.png", "image/png", 1, "t1"), ("5", "e", "text/plain", 9, "t0")], "id string, name string, mime_type string, size long, created_time string")
    assert [r.id for r in files.list_new_pages(pages).collect()] == ["4", "1"]
    folders = spark.createDataFrame([("f1", [{"emailAddress": "A@x"}], "1"), ("f2", [{"emailAddress": "a@X"}], "2"), ("f3", [], "3")], "id string, owners array<struct<emailAddress:string>>, shared_with_me_time string")
    assert [(r.owner, r.folder_id) for r in files.latest_inbox_per_owner(folders).collect()] == [("a@x", "f2")]


def test_document_tree(spark, tmp_path):
    docs = spark.createDataFrame([("S/1", "5", "A", "N", "I1", "B1-2"), ("", "5", None, "M", "I2", "B0-3")], "school_name string, grade_name string, division_name string, student_name string, student_id string, code string")
    files.write_document_tree(docs, str(tmp_path / "tree"))
    got = sorted((r.school, r.path) for r in spark.read.parquet(str(tmp_path / "tree")).collect())
    assert got == [("S-1", "OCR/S-1/5/A/N_I1/N_I1_B1-2.pdf"), ("Unknown school", "OCR/Unknown school/5/Unknown division/M_I2/M_I2.pdf")]


def test_merge_rules_is_a_running_mean(spark):
    rules = [(0.100, 0.1, 0.5), (0.106, 0.05, 0.4), (0.110, 0.2, 0.9), (0.5, 0.0, 1.0)]
    df = spark.createDataFrame([(1, rules)], "i int, r array<struct<y:double,x0:double,x1:double>>")
    got = [tuple(x) for x in df.select(features.merge_rules(F.col("r")).alias("m")).first().m]
    y = ((0.100 + 0.106) / 2 + 0.110) / 2
    assert got == [(y, 0.05, 0.9), (0.5, 0.0, 1.0)]
