"""The fuzzy stages against plain loops over all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_text import plain_prefix_score

from intake.functions import similarity
from intake.operators import lookup

ROSTER = "person long, student_id string, student_name string, school_name string"
READINGS = "token string, school string, location string, scope string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], max(row[j], row[j + 1]) if x != y else old + 1
    return row[-1]


def shape(token, k):
    to_letter, to_digit = str.maketrans("0158264", "OISBZGA"), str.maketrans("OQDILSBZGTA", "00011582674")
    return token[:k].translate(to_letter) + token[k:].translate(to_digit)


def forms(token):
    tried = [] if len(token) < 8 else [shape(token, 6)] if len(token) == 12 else [shape(token, k) for k in (6, 5, 7)]
    return {token, token.translate(str.maketrans("OILSBZG", "0115826")), *tried}


def take(scores, token, least):
    """The identifier that is safe to take of {id: score}."""
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    if ranked:
        (best, score), second = ranked[0], ranked[1][1] if len(ranked) > 1 else 0
        if score >= least and (second == 0 or score - second >= 0.08) and abs(len(best) - len(token)) <= 1:
            return best


def people(rng, count):
    """Identifiers of all lengths that the pattern allows, many of them alike."""
    ids = []
    for _ in range(count):
        letters = "".join(rng.choice("ABCDEKLO") for _ in range(rng.choice((3, 5, 6, 6, 6, 6, 7, 12))))
        digits = "".join(rng.choice("0112358") for _ in range(rng.choice((4, 6, 6, 6, 6, 7, 12))))
        ids.append(letters + digits)
        for _ in range(rng.choice((0, 0, 1, 2))):
            k, x = rng.randrange(len(ids[-1])), ids[-1]
            ids.append(x[:k] + rng.choice((x[k + 1 :], (rng.choice("ABC") if x[k].isalpha() else rng.choice("019")) + x[k + 1 :])))
    return [(i, x, f"Name {i}", rng.choice(("North", "South"))) for i, x in enumerate(dict.fromkeys(ids))]


def noisy(rng, x):
    for _ in range(rng.choice((0, 1, 1, 2, 3, 4))):
        k = rng.randrange(len(x))
        x = rng.choice((x[:k] + x[k + 1 :], x[:k] + rng.choice("ABO01S5Z") + x[k:], x[:k] + rng.choice("ABO01S5Z") + x[k + 1 :]))
    return x


@pytest.fixture(scope="module")
def scene(spark):
    rng = random.Random(11)
    roster = people(rng, 150)
    asked = {(noisy(rng, rng.choice(roster)[1]), *rng.choice((("NORTH", "", "NORTH"), ("", "", "")))) for _ in range(500)} | {("", "", "", ""), ("AB1", "", "", ""), ("Q" * 70, "", "", ""), ("X" * 24, "", "", "")}
    asked = sorted(asked)
    return roster, asked, spark.createDataFrame(asked, READINGS), spark.createDataFrame([*roster, (-1, None, None, None)], ROSTER)


def ids_of(roster, scope):
    import re

    return [x for _, x, _, school in roster if scope in ("", school.upper()) and re.fullmatch("[A-Z]{3,12}[0-9]{4,12}", x)]


def found(df):
    return {(r.token, r.school): r.student_id for r in df.collect()}


def test_constrained_repair(scene):
    roster, asked, readings, people_df = scene
    expected = {}
    for token, school, _, scope in asked:
        if len(token) >= 6:
            scores = {x: max(200.0 * lcs(q, x) / (len(q) + len(x)) / 100.0 for q in forms(token)) for x in ids_of(roster, scope)}
            if best := take(scores, token, 0.8):
                expected[token, school] = best
    assert found(lookup.constrained_repair(readings, people_df)) == expected and len(expected) > 100


def test_digit_suffix(scene):
    import re

    roster, asked, readings, people_df = scene
    split = lambda x: re.fullmatch("([A-Z]+)([0-9]+)", x).groups() if re.fullmatch("[A-Z]+[0-9]+", x) else (re.sub("[^A-Z]", "", x[:-6]), x[-6:]) if re.search("[0-9]{6}$", x) else (re.sub("[^A-Z]", "", x), re.sub("[^0-9]", "", x))
    expected = {}
    for token, school, _, scope in asked:
        letters, digits = split(token)
        if len(digits) == 6 and letters:
            if best := take({x: plain_prefix_score(letters, split(x)[0]) for x in ids_of(roster, scope) if x[-6:] == digits}, token, 0.55):
                expected[token, school] = best
    assert found(lookup.digit_suffix(readings, people_df)) == expected and len(expected) > 50


def test_no_rows(spark, scene):
    _, _, readings, people_df = scene
    for stage in (lookup.constrained_repair, lookup.digit_suffix):
        assert stage(readings.limit(0), people_df).count() == 0 and stage(readings, people_df.limit(0)).count() == 0


def test_crowded_digits_give_two_identifiers_a_reading(spark):
    """Hundreds of identifiers end in the same digits: the pairs do not grow with them, the verdicts are those of all pairs."""
    rng = random.Random(5)
    letters = lambda: "".join(rng.choice("ABCDEKLO") for _ in range(rng.choice((3, 5, 6, 6, 6, 7, 12))))
    ids, asked = sorted({letters() for _ in range(400)}), sorted({letters()[: rng.choice((1, 4, 6, 12))] for _ in range(60)})
    rows = spark.createDataFrame([("", "120309", x + "120309", x) for x in ids], "scope string, digits string, id string, _letters string")
    got: dict = {}
    for r in lookup._alike_letters(spark.createDataFrame([("", "120309", x) for x in asked], "scope string, digits string, letters string"), rows).collect():
        got.setdefault(r.letters, []).append((r.score, r.id))
    for x in asked:
        scores = {y + "120309": plain_prefix_score(x, y) for y in ids}
        best = sorted(scores.values(), reverse=True)[:2]
        assert len(got.get(x, [])) <= 2 and all(scores[k] == s for s, k in got.get(x, []))
        assert [s for s, _ in sorted(got.get(x, []), reverse=True)] == [s for s in best if s >= 0.47 - 1e-9]


def test_pairs_of_a_school_come_once(spark):
    """Repeated rows and readings with several schools give each pair once, with the ratio of plain loops."""
    rng = random.Random(7)
    tokens = ["", "A", "AB1203", "Q" * 61, "Q" * 70, *("".join(rng.choice("ABO015") for _ in range(rng.randrange(1, 14))) for _ in range(40))]
    ids = [(rng.choice("NS"), x) for x in tokens[1:]] + [("N", "AB1203"), ("S", "AB1203"), (None, "AB")]
    readings = [(k % 30, rng.choice(("N", "S", None)), tokens[k % 30]) for k in range(90)]
    asked, held = spark.createDataFrame(readings, "reading_id long, scan_school string, token string"), spark.createDataFrame(ids * 2, "scan_school string, id string")
    got = lookup.pairs_of_school(asked, held).withColumn("score", similarity.ratios("token", "id"))
    want = {(k, t, x, None if min(len(t), len(x)) > 60 else 2.0 * lcs(t, x) / (len(t) + len(x))) for k, s, t in readings for s2, x in ids if s and s == s2}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_pairs_carry_strings_only(scene):
    """What is shuffled to make a pair one holds no arrays, which would be sorted."""
    _, _, readings, people_df = scene
    asked = readings.withColumns({"n": F.lit(12), "common": F.lit(10)})
    plan = lookup._near(asked, lookup._candidates(people_df))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_ratios_are_made_block_by_block(spark, monkeypatch):
    """Schools of many blocks, null and very long strings, repeats and readings of several schools: each pair once, with the ratio of plain loops, and no pair goes to Python."""
    monkeypatch.setattr(lookup, "ASKED", 4), monkeypatch.setattr(lookup, "HELD", 3), monkeypatch.setattr(lookup, "BLOCKS", 2)
    rng = random.Random(9)
    tokens = ["", None, "A", "अआ0", "Q" * 60, "Q" * 61, "AB" * 35, *("".join(rng.choice("ABO015") for _ in range(rng.randrange(1, 19))) for _ in range(40))]
    ids = [(rng.choice("NS"), x) for x in tokens] + [("N", "AB1203"), ("S", "AB1203"), (None, "AB")]
    readings = [(k % 47, rng.choice(("N", "S", None)), tokens[k % 47]) for k in range(140)]
    asked, held = spark.createDataFrame(readings, "reading_id long, scan_school string, token string"), spark.createDataFrame(ids * 2, "scan_school string, id string")

    def score(t, x):
        if t is None or x is None or min(len(t), len(x)) > 60:
            return None
        return round(2.0 * lcs(t, x) / (len(t) + len(x)), 4) if t or x else 1.0

    got = lookup.ratios_of_school(asked, held, digits=4)
    want = {(k, x, score(t, x)) for k, s, t in readings for s2, x in ids if s and s == s2}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() > 16


@pytest.mark.parametrize("most", [0, 99])
def test_blocks_of_a_scope_change_nothing(scene, monkeypatch, most):
    """Many small blocks, and scopes too large for them, give what one block gives; only strings are shuffled where a scope has blocks, not the tens of keys that each has."""
    _, _, readings, people_df = scene
    plain = {stage: found(stage(readings, people_df)) for stage in (lookup.constrained_repair, lookup.digit_suffix)}
    monkeypatch.setattr(lookup, "READ", 100), monkeypatch.setattr(lookup, "KNOWN", 40), monkeypatch.setattr(lookup, "MOST", most)
    assert {stage: found(stage(readings, people_df)) for stage in plain} == plain and all(plain.values())
    asked = readings.withColumns({"n": F.lit(12), "common": F.lit(10)})
    plan = lookup._near(asked, lookup._candidates(people_df))._jdf.queryExecution().executedPlan().toString()
    assert ("subsequence_keys" in plan) == (most == 0)


def test_shared_subsequences_in_small_pieces(monkeypatch):
    monkeypatch.setattr(similarity, "CELLS", 60)
    rng = random.Random(3)
    a, b = (["".join(rng.choice("ABO0") for _ in range(n)) for _ in range(40)] for n in (7, 6))
    got = {(int(i), int(j)) for x, y in similarity._sharing(a, b, 5) for i, j in zip(x, y)}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if lcs(x, y) >= 5} and got
