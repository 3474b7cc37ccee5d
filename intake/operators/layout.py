"""Where a page's identifier field is: rule ladders, ink profiles, printed labels, and what the recognisers read there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intake.functions.text import as_id, clean_token, id_from_line, is_grade_label, label_score, reading_class, transliterate
from intake.shared import cut

# The blank forms' rules and value boxes as parts of the page, and the limits of a fit.
LADDERS = {
    "english": (0.1683, 0.2465, 0.2754, 0.3044, 0.3826, 0.4115, 0.4403),
    "hindi": (0.2515, 0.3588, 0.3941, 0.4294, 0.5369, 0.5722, 0.6075, 0.6940),
    "marathi": (0.3040, 0.3863, 0.4164, 0.4467, 0.5272, 0.5575, 0.5876),
}
BOXES = {"english": (0.200, 0.3041, 0.450, 0.3209), "hindi": (0.242, 0.4266, 0.600, 0.4462), "marathi": (0.243, 0.4439, 0.601, 0.4635)}
VALUE_HEIGHTS, ID_RULE = {"english": 0.0175, "hindi": 0.0200, "marathi": 0.0200}, 3
LEAST_RULES, MOST_ERROR, FAR_RULE = 4, 0.020, 0.024
LADDER_SCALES, PROFILE_SCALES, OFFSETS = np.arange(0.85, 1.151, 0.01), np.arange(0.80, 1.151, 0.01), np.arange(-0.12, 0.1201, 0.005)
LEAST_OVERLAP = 0.70
FIT = "struct<language:string,error:double,scale:double,offset:double,runner_up:string,confidence:double>"
PROFILE = "struct<best_page:string,best_score:double,first_score:double,later_score:double>"
# Margins around the rule of the value field, beside it as a share of the page, above and below it as a share of its height; how far (pixels) a label may stand under
# the grade's, and two boxes of one line apart (pixels, heights); what tells Marathi and Hindi labels.
BESIDE, ABOVE, BELOW = 0.010, 1.10, 0.35
UNDER_GRADE, SAME_LINE = (5, 140), (28.0, 1.8)
MARATHI, HINDI = "आयडी|इयत्ता|आयिी", "[आईयडीकक्षा]"
# How far a reader is trusted, what is added to its confidence, and the most (or, for labels, the score) of strict and of other readings.
LINE_TRUST, DEVANAGARI_TRUST, VISION_MORE, PLAIN_MORE = 0.95, 0.8, 0.15, 0.05
LABEL_SCORES, VISION_MOST, PLAIN_MOST, DEVANAGARI_MOST = (0.92, 0.55), (0.99, 0.70), 0.65, (0.75, 0.55)


def _mapped(df: DataFrame, column: str, name: str, kind: str, f: Callable[[list], list]) -> DataFrame:
    """``df`` with a column computed from an array column, a record batch at a time; rows and their order stay."""
    plain = F.struct(F.col(column).alias("x"))
    schema = df.select("*", F.lit(None).cast(kind).alias(name)).schema

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            found = f(b.column(b.num_columns - 1).field(0).to_pylist())
            types = {k: (pa.string() if t == "string" else pa.float64()) for k, t in (p.split(":") for p in kind.removeprefix("struct<").removesuffix(">").split(","))}
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.struct(list(types.items())))], names=[*b.schema.names[:-1], name])

    return df.select("*", plain.alias("_in")).mapInArrow(batches, schema)


def _ladder_grid(rows: tuple[float, ...]) -> np.ndarray:
    """A ladder under every scale and offset, scales outermost."""
    return (np.multiply.outer(LADDER_SCALES, np.array(rows))[:, None, :] + OFFSETS[None, :, None]).reshape(-1, len(rows))


def fit_ladders(pages: list) -> list:
    """The best language of each list of rule heights, as a dict of ``FIT``; None for too few rules or too poor a fit."""
    grids = {language: _ladder_grid(rows) for language, rows in LADDERS.items()}
    out: list = []
    for heights in pages:
        seen = np.array([y for y in heights or () if y is not None], dtype=float)
        seen = np.sort(seen[np.isfinite(seen)])
        if len(seen) < LEAST_RULES:
            out.append(None)
            continue
        fits = []
        for language, grid in grids.items():
            right = np.searchsorted(seen, grid)
            gap = np.minimum(np.abs(grid - seen[np.maximum(right - 1, 0)]), np.abs(grid - seen[np.minimum(right, len(seen) - 1)])).mean(axis=1)
            k = int(gap.argmin())
            fits.append((float(gap[k]), language, float(LADDER_SCALES[k // len(OFFSETS)]), float(OFFSETS[k % len(OFFSETS)])))
        (error, language, scale, offset), (second, runner_up, *_), *_ = sorted(fits)
        sure = min(0.99, max(0.3, (second - error) / max(second, 1e-6)))
        out.append(None if error > MOST_ERROR else {"language": language, "error": error, "scale": scale, "offset": offset, "runner_up": runner_up, "confidence": sure})
    return out


def identify_form(pages: DataFrame, heights: str, name: str = "fit") -> DataFrame:
    """``pages`` with the language whose rule ladder fits best (``FIT``); null with fewer than four rules or an error above 0.02. A pure map."""
    return _mapped(pages, heights, name, FIT, fit_ladders)


def id_box(rules: Column, fit: Column) -> Column:
    """struct(x0, y0, x1, y1) of the value field: around the page's rule where the fit expects it, else the blank form's box; null without a fit."""
    per = lambda values: F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), fit["language"])
    wanted = per({k: v[ID_RULE] for k, v in LADDERS.items()}) * fit["scale"] + fit["offset"]
    near = F.array_min(F.transform(rules, lambda r, k: F.struct(F.abs(r["y"] - wanted).alias("d"), k.alias("k"), r.alias("r"))))
    height, rule = per(VALUE_HEIGHTS) * fit["scale"], near["r"]
    x0, x1 = F.greatest(F.lit(0.0), rule["x0"] - BESIDE), F.least(F.lit(1.0), rule["x1"] + BESIDE)
    y0, y1 = F.greatest(F.lit(0.0), rule["y"] - height * ABOVE), F.least(F.lit(1.0), rule["y"] + height * BELOW)
    box = lambda *c: F.struct(*(v.alias(n) for v, n in zip(c, ("x0", "y0", "x1", "y1"), strict=True)))
    blank = box(*(per({k: v[i] for k, v in BOXES.items()}) for i in range(4)))
    return F.when(fit.isNull(), None).when((near["d"] <= FAR_RULE) & (x1 > x0) & (y1 > y0), box(x0, y0, x1, y1)).otherwise(blank)


def orientation(pages: DataFrame, heights: str, name: str = "turn") -> DataFrame:
    """``pages`` with 0 or 180, whichever way up a ladder fits with the smaller error (0 of equals); null if neither fits."""
    turned = F.transform(F.col(heights), lambda y: 1.0 - y)
    both = identify_form(identify_form(pages, heights, "_up").withColumn("_turned", turned), "_turned", "_down")
    up, down = F.col("_up.error"), F.col("_down.error")
    way = F.when(F.least(up, down).isNull(), None).when(down.isNull() | (up <= down), 0).otherwise(180)
    return both.withColumn(name, way).drop("_up", "_turned", "_down")


def _shifted(template: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A template under every shift that keeps enough of the page: centred and scaled to length 1 where it covers it, the cover, its size."""
    bins = len(template)
    at = (np.arange(bins) + 0.5) / bins
    where = ((at[None, None, :] - OFFSETS[None, :, None]) / PROFILE_SCALES[:, None, None]).reshape(-1, bins)
    cover = (where >= 0) & (where <= 1)
    where, cover = (x[cover.sum(axis=1) >= bins * LEAST_OVERLAP] for x in (where, cover))
    size = cover.sum(axis=1)
    values = np.where(cover, np.interp(where, at, template), 0.0)
    return np.where(cover, values - (values.sum(axis=1) / size)[:, None], 0.0), cover.astype(float), size


def match_profile(pages: DataFrame, profile: str, templates: dict[str, list[float]], name: str = "match") -> DataFrame:
    """``pages`` with the template page whose row-ink profile correlates best under any shift, and the best first and later page (``PROFILE``).

    ``templates``: name (``form:page``) -> profile, the few pages of the blank forms; they travel with the job. Profiles have as many bins as
    the templates; others, and pages without one, give null. The best of equals is the first in order of names. A pure map:
    per record batch and template three matrix products.
    """
    bins = len(next(iter(templates.values()))) if templates else 0

    def scores(rows: list) -> list:
        good = [k for k, r in enumerate(rows) if r is not None and len(r) == bins and None not in r]
        out: list = [None] * len(rows)
        if not good or not bins:
            return out
        ink = np.array([rows[k] for k in good], dtype=float).T
        names, found = sorted(templates), []
        for key in names:
            centred, cover, size = _shifted(np.array(templates[key], dtype=float))
            best = np.full(ink.shape[1], -1.0)
            for a in range(0, ink.shape[1], 512):
                part = ink[:, a : a + 512]
                spread = np.maximum(cover @ part**2 - (cover @ part) ** 2 / size[:, None], 0.0)
                best[a : a + 512] = (centred @ part / np.sqrt((centred**2).sum(axis=1)[:, None] * spread + 1e-12)).max(axis=0)
            found.append(best)
        table = np.array(found)
        first = np.array([n.endswith(":1") for n in names])
        top = lambda rows, k: float(rows[:, k].max()) if len(rows) else -1.0
        for j, k in enumerate(good):
            b = int(table[:, j].argmax())
            out[k] = {"best_page": names[b], "best_score": float(table[b, j]), "first_score": top(table[first], j), "later_score": top(table[~first], j)}
        return out

    return _mapped(pages, profile, name, PROFILE, scores)


def best_label(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """One row per page with a printed label of the identifier field: text, language, confidence, and the identifier on or beside it.

    Lines: ``page``, position, text, confidence, x_min, x_max, y_mid, height. The best label has the highest score + confidence, and 1.5 more if
    it holds an identifier; without a label it is the first line under the topmost grade label, 5 to 140 below. The first of equals, in order of position.
    """
    # texts are parsed once, not again by each of the steps below
    known = cut(lines.withColumns({"_l": label_score("text"), "_parsed": id_from_line("text"), "_token": clean_token("text"), "_is_grade": is_grade_label("text")}))
    ranked = F.coalesce(F.when(F.col("_l.language").isNotNull(), F.col("_l.score")), F.lit(1.5)) + F.col("confidence") + F.when(F.col("_parsed") != "", 1.5).otherwise(0.0)
    line = F.struct("text", F.coalesce("_l.language", F.lit("english")).alias("language"), "confidence", F.col("_parsed").alias("parsed"), "x_max", "y_mid", "height")
    labels = known.where("_l.language is not null or _parsed <> ''").groupBy(page).agg(F.max_by(line, F.struct(ranked, -F.col("position"))).alias("label"))

    grades = known.where("_is_grade").groupBy(page).agg(F.min("y_mid").alias("_grade"))
    language = F.when(F.col("text").rlike(MARATHI), "marathi").when(F.col("text").rlike(HINDI), "hindi").otherwise("english")
    under = known.join(grades, page).join(labels, page, "left_anti").where((F.col("y_mid") > F.col("_grade") + UNDER_GRADE[0]) & (F.col("y_mid") - F.col("_grade") <= UNDER_GRADE[1]))
    guessed = under.withColumn("_l", F.struct(language.alias("language"), F.lit(0.0).alias("score"))).groupBy(page).agg(F.min_by(line, F.struct("y_mid", "position")).alias("label"))
    found = labels.union(guessed)

    beside = known.join(found, page).where((F.col("label.parsed") == "") & (F.abs(F.col("y_mid") - F.col("label.y_mid")) <= F.greatest(F.lit(SAME_LINE[0]), F.col("label.height") * SAME_LINE[1])))
    token = F.col("_token")
    whole = F.length(token).between(6, 20) & token.rlike("[A-Z]") & token.rlike("[0-9]")
    read = F.when(F.col("x_min") < F.col("label.x_max") - 10, F.col("_parsed")).otherwise(F.when(whole, token).otherwise(""))
    near = beside.withColumn("_read", read).where("_read <> ''").groupBy(page).agg(F.max_by("_read", F.struct(F.length("_read"), -F.col("position"))).alias("_near"))
    student_id = F.when(F.col("label.parsed") != "", F.col("label.parsed")).otherwise(F.coalesce("_near", F.lit("")))
    return found.join(near, page, "left").select(page, "label.text", "label.language", "label.confidence", student_id.alias("student_id"))


def score_readings(readings: DataFrame, page: str = "page_id") -> DataFrame:
    """Candidates of each page with their score and ``tag``; junk goes, of equal texts of one reader the first stays.

    Readings: ``page``, position, reader (label, vision, vision_line, rapid, easy, devanagari), text, confidence; further columns stay.
    """
    reader, conf = F.col("reader"), F.col("confidence") * F.when(F.col("reader") == "vision_line", LINE_TRUST).when(F.col("reader") == "devanagari", DEVANAGARI_TRUST).otherwise(1.0)
    parsed = id_from_line("text")
    token = F.when(reader == "devanagari", F.when(F.col("text").rlike("[\u0900-\u097f]"), transliterate("text")).otherwise("")).when((reader == "rapid") & (parsed != ""), parsed).otherwise(clean_token("text"))
    read = F.transform(F.array(token), lambda t: F.struct(t.alias("text"), reading_class(t).alias("kind")))
    strict = lambda r: r["kind"] == "strict"
    loose = lambda r: (r["kind"] == "noisy") | ((reader.startswith("vision") | (reader == "devanagari")) & (r["kind"] == "digits"))
    by = lambda r, of_strict, of_loose: F.when(strict(r), of_strict).when(loose(r), of_loose)
    score = lambda r: (
        F.when(reader == "label", F.when(strict(r), LABEL_SCORES[0]).when(loose(r), LABEL_SCORES[1]))
        .when(reader.startswith("vision"), by(r, F.least(conf + VISION_MORE, F.lit(VISION_MOST[0])), F.least(conf + VISION_MORE, F.lit(VISION_MOST[1]))))
        .when(reader.isin("rapid", "easy"), by(r, conf + PLAIN_MORE, F.least(conf, F.lit(PLAIN_MOST))))
        .when(reader == "devanagari", by(r, F.least(conf, F.lit(DEVANAGARI_MOST[0])), F.least(conf, F.lit(DEVANAGARI_MOST[1]))))
    )
    family = F.when(reader == "vision_line", "vision").otherwise(reader)
    tag = lambda r: F.concat(family, F.when(strict(r), "").otherwise("-noisy"))
    found = F.filter(F.transform(read, lambda r: F.struct(r["text"].alias("_text"), score(r).alias("score"), tag(r).alias("tag"))), lambda r: r["score"].isNotNull())
    scored = readings.select(*(c for c in readings.columns if c not in ("reader", "text", "confidence")), family.alias("_reader"), F.inline(found)).withColumnsRenamed({"_reader": "reader", "_text": "text"})
    order = Window.partitionBy(page, "reader", "text").orderBy("position")
    return scored.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def with_fallback(candidates: DataFrame, fallback: DataFrame, preferred: DataFrame, page: str = "page_id") -> DataFrame:
    """Candidates of each page, and those of the forms' blank boxes where no candidate of it has an identifier's shape.

    ``preferred``: ``page`` and the language whose box is tried first; the others follow in order of ``BOXES``. ``position`` is numbered anew.
    """
    shaped = candidates.where(as_id("text") != "").select(page).distinct()
    rank = F.when(F.col("language") == F.col("_first"), 0).otherwise(F.coalesce(F.array_position(F.array(*map(F.lit, BOXES)), F.col("language")).cast("int"), F.lit(0)))
    kept = candidates.withColumns({"stage": F.lit("found"), "_r": F.lit(-1)})
    rest = fallback.join(shaped, page, "left_anti").join(preferred.select(page, F.col("language").alias("_first")), page, "left").withColumns({"stage": F.lit("template"), "_r": rank}).drop("_first")
    order = Window.partitionBy(page).orderBy("_r", "position", "text")
    return kept.unionByName(rest).withColumn("position", F.row_number().over(order)).drop("_r")
