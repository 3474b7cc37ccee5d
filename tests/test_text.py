"""Golden rows of cleaning, parsing and similarity."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from intake.functions import similarity, text


def ask(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_shapes_accepted_and_refused(spark):
    good = ["KELVOR120309", "kelvor-120309", "KELVOR120309_B2", "KELVO 120309", "WXYZ00417", "QRSTUVW7654321C3"]
    bad = ["LENA5550001234", "KEL77POSTBOX", "5550001234", "ONLYLETTERS", "", "KEV120309", "KELVOR1203", "KELVORIN120309", "KELVOR120309XY", None]
    assert ask(spark, good + bad, text.looks_like_id) == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize(
    ("written", "code"),
    [("B4-27", "B4-27"), ("b4-27", "B4-27"), ("84-6", "B4-6"), ("34 - 9", "B4-9"), ("BL-3I", "B1-31"), ("B2O-7", "B20-7"), ("B4--8", "B4-8"), ("B4 ~ 9", "B4-9"), ("B 3 1-6", "B31-6"), ("Ｂ４－６", "B4-6"), ("B4 9", "B4-9"), ("B4.9", "B4-9")]
    + [(x, None) for x in ("B42", "B0-6", "B4-2-7", "B4 2 7", "BX-6", "⑦", "", None, "B4-", "B4-2000", "D4-6")],
)
def test_batch_codes(spark, written, code):
    found = ask(spark, [written], text.parse_batch_code)[0]
    assert (found and found.code) == code


def test_lines(spark):
    lines = ["Student ID: KELVOR120309", "smudge:NORTAN1402S1", "NORTAN1402S1", "STUDENT7654321", "no number", None]
    assert ask(spark, lines, text.id_from_line) == ["KELVOR120309", "NORTAN1402S1", "NORTAN1402S1", "", "", ""]


def test_names_and_paths(spark):
    assert ask(spark, ["a/b:c", "  x  y . ", "", None, "q\tz"], text.safe_name) == ["a-b-c", "x y", "Unknown", "Unknown", "qz"]  # control characters go first


def test_redaction(spark):
    assert ask(spark, ["KELVOR120309", "Someone's name"], text.redact) == ["KELVOR120309", "<not an ID: 14 chars>"]


def test_ratio_agrees_with_table(spark):
    pairs = [("NORTAN140211", "NORIAN140211"), ("", ""), ("ABC", ""), ("ABCDEF", "BADCFE")]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b):
                old, row[j + 1] = row[j + 1], max(row[j], row[j + 1]) if x != y else old + 1
        return row[-1]

    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.s for r in df.select(similarity.ratio(F.col("a"), F.col("b")).alias("s")).collect()]
    want = [2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0 for a, b in pairs]
    assert got == pytest.approx(want)


def test_first_code_of_corners(spark):
    from intake.operators.features import first_code

    rows = [(1, 0, ["B4-27 6"]), (2, 0, ["(6) B4-8"]), (3, 0, ["B4", "-27", "6"]), (4, 0, ["84", "~", "9"]), (5, 0, ["plain", "words"]), (6, 0, ["nothing"]), (6, 1, ["B2-7"]), (7, 0, None), (8, 0, ["\u2462 B3-1", None])]
    df = spark.createDataFrame(rows, "page int, rank int, lines array<string>")
    assert {r.page: r.code for r in first_code(df, "page").collect()} == {1: "B4-27", 2: "B4-8", 3: "B4-27", 4: "B4-9", 6: "B2-7", 8: "B3-1"}


def test_page_ids(spark):
    assert [x and tuple(x) for x in ask(spark, ["0199a1b2c3d40002ffff", "zz", None], text.page_id_parts)] == [(0x0199A1B2C3D4, 2), None, None]


def test_transliteration(spark):
    assert ask(spark, ["क्षत्रिय१२", "\u0928\u093cम", "\u0958ख", "abc-9", None], text.transliterate) == ["KSHTRIY12", "M", "KKH", "ABC9", ""]


def plain_prefix_score(a, b):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b):
                old, row[j + 1] = row[j + 1], max(row[j], row[j + 1]) if x != y else old + 1
        return row[-1]

    def windows(s, t):
        return [2 * lcs(s, w) / (len(s) + len(w)) for k in range(1 - len(s), len(t)) if (w := t[max(0, k) : k + len(s)])]

    if not a or not b:
        return 0.0
    return max([2 * lcs(a, b) / (len(a) + len(b)), *(windows(a, b) if len(a) <= len(b) else []), *(windows(b, a) if len(b) <= len(a) else [])])


def test_prefix_scores_of_any_length_and_letters():
    rng = random.Random(4)
    words = ["".join(rng.choice("ABCé\u0915\U0001f600") for _ in range(rng.choice((0, 1, 2, 5, 6, 7, 70)))) for _ in range(60)]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(300)] + [("A" * 70, "B" * 70), ("", ""), ("A" * 70, "A" * 5)]
    got = similarity.prefix_scores([a for a, _ in pairs], [b for _, b in pairs])
    assert list(got) == pytest.approx([plain_prefix_score(a, b) for a, b in pairs])


def test_subsequences_share_a_key_exactly_if_they_are_equal(spark):
    from itertools import combinations

    rng = random.Random(6)
    rows = [(i, ["".join(rng.choice("AB1é") for _ in range(rng.randint(5, 9))) for _ in range(rng.randint(0, 3))], rng.randint(3, 5)) for i in range(80)] + [(99, ["A" * 14], 10), (98, ["ABCDEFGHIJKL"], 12)]
    df = spark.createDataFrame(rows, "i int, s array<string>, k int").select("i", similarity.subsequence_keys("s", "k").alias("keys"))
    keys = {r.i: r["keys"] for r in df.collect()}
    seen: dict = {}
    for i, strings, k in rows:
        plain = {"".join(c) for s in strings for c in combinations(s, k)}
        assert len(keys[i]) == len(set(keys[i])) == len(plain)
        seen[i] = (k, plain)
    for i, (k, a) in seen.items():
        for j, (n, b) in seen.items():
            assert len(set(keys[i]) & set(keys[j])) == (len(a & b) if k == n else 0)


def test_code_parts(spark):
    assert [x and tuple(x) for x in ask(spark, ["B0-12", "b4-9", "B0-0", "x", None], text.code_parts)] == [(0, 12), (4, 9), None, None, None]
