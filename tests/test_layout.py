"""Ladder and profile fits, labels and scored readings against plain versions and worked cases."""

from __future__ import annotations

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from intake.operators import layout
from intake.plans import intake

LINE = "page_id int, position int, text string, confidence double, x_min double, x_max double, y_mid double, height double"


def plain_fit(heights: list[float]):
    """Every expected row of every scale and offset by its nearest rule, one at a time."""
    best = {}
    for language, rows in layout.LADDERS.items():
        best[language] = min((sum(min(abs(y * s + o - h) for h in heights) for y in rows) / len(rows), s, o) for s in layout.LADDER_SCALES for o in layout.OFFSETS)
    return min((fit[0], language) for language, fit in best.items())


def test_identify_form_is_the_nearest_ladder(spark):
    rows = {r.vec_id: r for r in intake.ruled(spark, SMALL).where("vec_id < 6").collect()}
    got = {r.vec_id: r.fit for r in layout.identify_form(intake.ruled(spark, SMALL), "heights", "fit").where("vec_id < 6").collect()}
    for k, r in rows.items():
        error, language = plain_fit(r.heights)
        if error > 0.020:
            assert got[k] is None
        else:
            assert got[k].language == language
            assert abs(got[k].error - error) < 1e-9


def test_poor_pages_have_no_form(spark):
    pages = spark.createDataFrame([(1, None), (2, []), (3, [0.1, 0.2, 0.3]), (4, [0.9, 0.91, 0.92, 0.93])], "id int, heights array<double>")
    assert [r.fit for r in layout.identify_form(pages, "heights").collect()] == [None] * 4
    assert [r.turn for r in layout.orientation(pages, "heights").collect()] == [None] * 4
    assert layout.identify_form(pages.where("id > 9"), "heights").count() == 0


def test_orientation_and_box(spark):
    up = list(layout.LADDERS["hindi"])
    pages = spark.createDataFrame([(1, up), (2, [1 - y for y in up])], "id int, heights array<double>")
    assert {r.id: r.turn for r in layout.orientation(pages, "heights").collect()} == {1: 0, 2: 180}
    rules = F.transform("heights", lambda y: F.struct(y.alias("y"), F.lit(0.3).alias("x0"), F.lit(0.7).alias("x1")))
    fit = layout.identify_form(pages.where("id = 1"), "heights")
    box = fit.select(layout.id_box(rules, F.col("fit")).alias("b"), layout.id_box(F.filter(rules, lambda r: r["y"] > 0.5), F.col("fit")).alias("far")).first()
    assert np.allclose(list(box.b), (0.29, 0.4294 - 0.022, 0.71, 0.4294 + 0.007), atol=1e-3)
    assert tuple(box.far) == layout.BOXES["hindi"]


def test_match_profile_is_the_highest_correlation(spark):
    rng, bins = np.random.default_rng(1), 40
    templates = {f"{n}:{k}": rng.random(bins).tolist() for n in ("a", "b") for k in (1, 2)}
    rows = [rng.random(bins).tolist() for _ in range(4)] + [templates["b:2"], [0.5] * bins]
    got = layout.match_profile(spark.createDataFrame([*enumerate(rows), (6, None), (7, [0.1])], "id int, p array<double>"), "p", templates).orderBy("id").collect()
    at = (np.arange(bins) + 0.5) / bins

    def corr(page, template):
        best = -1.0
        for s in layout.PROFILE_SCALES:
            for o in layout.OFFSETS:
                where = (at - o) / s
                ok = (where >= 0) & (where <= 1)
                if ok.sum() >= 0.7 * bins:
                    x, y = np.interp(where[ok], at, template), np.array(page)[ok]
                    x, y = x - x.mean(), y - y.mean()
                    best = max(best, float((x * y).sum() / np.sqrt((x**2).sum() * (y**2).sum() + 1e-12)))
        return best

    for k, row in enumerate(rows):
        scores = {n: corr(row, t) for n, t in templates.items()}
        m = got[k].match
        assert np.allclose([m.best_score, m.first_score, m.later_score], [max(scores.values()), max(scores["a:1"], scores["b:1"]), max(scores["a:2"], scores["b:2"])], atol=1e-6)
        assert k == 5 or m.best_page == max(scores, key=scores.get)
    assert got[6].match is None
    assert got[7].match is None


def test_best_label(spark):
    lines = [
        (1, 0, "Student ID :", 0.9, 0.0, 100.0, 50.0, 20.0), (1, 1, "ABCDEF010203", 0.3, 120.0, 300.0, 55.0, 20.0), (1, 2, "ZZZ99", 0.9, 120.0, 300.0, 55.0, 20.0), (1, 3, "ABCDEFGH010203", 0.3, 120.0, 300.0, 300.0, 20.0),
        (2, 0, "Grade 5", 0.5, 0.0, 100.0, 50.0, 20.0), (2, 1, "odd line", 0.5, 0.0, 100.0, 90.0, 20.0), (2, 2, "QRSTUV111213", 0.5, 0.0, 100.0, 190.5, 20.0),
        (3, 0, "nothing", 0.5, 0.0, 100.0, 50.0, 20.0),
        (4, 0, "Student ID: GHIJKL040506", 0.1, 0.0, 300.0, 50.0, 20.0), (4, 1, "Student ID", 0.9, 0.0, 100.0, 90.0, 20.0),
        (5, 0, "Class 7", 0.5, 0.0, 100.0, 50.0, 20.0), (5, 1, "below", 0.5, 0.0, 100.0, 120.0, 20.0),
    ]
    got = {r.page_id: (r.text, r.language, r.student_id) for r in layout.best_label(spark.createDataFrame(lines, LINE)).collect()}
    assert got == {1: ("Student ID :", "english", "ABCDEF010203"), 2: ("QRSTUV111213", "english", "QRSTUV111213"), 4: ("Student ID: GHIJKL040506", "english", "GHIJKL040506"), 5: ("below", "english", "")}
    assert layout.best_label(spark.createDataFrame([], LINE)).count() == 0


def test_scores_and_fallback(spark):
    rows = [
        (1, 0, "vision", "MNOPQR020304", 0.9, "hindi"), (1, 1, "vision_line", "MNOPQR-020304", 0.9, "hindi"), (1, 2, "rapid", "Student ID: MNOPQR020304", 0.7, "hindi"),
        (1, 3, "easy", "junk", 0.7, "hindi"), (1, 4, "label", "MNOPQR020304", 0.1, "hindi"), (1, 5, "easy", "MNOPX1R0203A", 0.9, "hindi"), (1, 6, "devanagari", "MNOPQR020304", 0.9, "hindi"),
        (2, 0, "rapid", None, 0.9, "english"), (2, 1, "easy", "", None, "english"),
    ]
    df = spark.createDataFrame(rows, "page_id int, position int, reader string, text string, confidence double, language string")
    got = {(r.tag, r.text): round(r.score, 4) for r in layout.score_readings(df).collect()}
    assert got == {("vision", "MNOPQR020304"): 0.99, ("rapid", "MNOPQR020304"): 0.75, ("label", "MNOPQR020304"): 0.92, ("easy-noisy", "MNOPX1R0203A"): 0.65}
    kept = spark.createDataFrame([(1, 0, "english", "ABCDEF010203"), (2, 0, "english", "x")], "page_id int, position int, language string, text string")
    rest = spark.createDataFrame([(p, k, language, f"{language}{p}") for p in (1, 2, 3) for k, language in enumerate(("english", "hindi", "marathi"))], kept.schema)
    preferred = spark.createDataFrame([(2, "marathi")], "page_id int, language string")
    out = {}
    for r in layout.with_fallback(kept, rest, preferred).orderBy("page_id", "position").collect():
        out.setdefault(r.page_id, []).append((r.text, r.stage))
    assert out == {1: [("ABCDEF010203", "found")], 2: [("x", "found"), ("marathi2", "template"), ("english2", "template"), ("hindi2", "template")], 3: [("english3", "template"), ("hindi3", "template"), ("marathi3", "template")]}


def test_page_of_wide_gaps_takes_nearest_rule():
    heights = [0.1, 0.35, 0.36, 0.9]
    fit = layout.fit_ladders([heights])[0]
    assert fit is None or abs(fit["error"] - plain_fit(heights)[0]) < 1e-9


def test_labels_are_parsed_once(spark):
    """The steps after the parsing read its rows: none parses texts again."""
    plan = layout.best_label(spark.createDataFrame([], LINE))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan
