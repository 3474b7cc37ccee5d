"""Page layout features as arrays: rules, ink profiles, angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tolerances and thresholds of the layout checks.
MERGE_TOL, BLANK_INK, MATCH_MIN, MATCH_MARGIN, EMPTY_BOX_INK, MAX_ANGLE, LEAST_ANGLE = 0.008, 0.02, 0.75, 0.25, 0.02, 8.0, 0.15


def merge_rules(rules: Column | str) -> Column:
    """Rule rows (y, x0, x1) close to the one merged before fuse with it, in order of y: mean height, widest extent."""
    rules = F.array_sort(rules)
    empty = F.slice(rules, 1, 0)

    def step(done, r):
        near = (F.size(done) > 0) & (F.abs(r["y"] - F.get(done, F.size(done) - 1)["y"]) <= MERGE_TOL)
        prev = F.get(done, F.size(done) - 1)
        fused = F.struct(((prev["y"] + r["y"]) / 2.0).alias("y"), F.least(prev["x0"], r["x0"]).alias("x0"), F.greatest(prev["x1"], r["x1"]).alias("x1"))
        return F.when(near, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(fused))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(rules, empty, step)


def skip_reason(ink: Column, declaration: Column, later_score: Column, first_score: Column, box_ink: Column) -> Column:
    """Why a page is not read: blank, declaration, continuation, empty_id; '' if it is."""
    return (
        F.when(ink < BLANK_INK, "blank").when(declaration, "declaration")
        .when((later_score >= MATCH_MIN) & (later_score - first_score >= MATCH_MARGIN), "continuation")
        .when(box_ink < EMPTY_BOX_INK, "empty_id").otherwise("")
    )


def skew_angle(lines: DataFrame, page: str, angle: str) -> DataFrame:
    """The median angle of a page's nearly level lines; 0 without any or if it is negligible."""
    level = F.when(F.abs(F.col(angle)) < MAX_ANGLE, F.col(angle))
    return lines.groupBy(page).agg(F.coalesce(F.percentile(level, 0.5), F.lit(0.0)).alias("_a")).select(page, F.when(F.abs("_a") < LEAST_ANGLE, 0.0).otherwise(F.col("_a")).alias("skew"))


def reuse_duplicates(pages: DataFrame, file: str, fingerprint: str, page: str, reading: str) -> DataFrame:
    """Pages of a file with the fingerprint of an earlier one take its reading."""
    firsts = pages.groupBy(file, fingerprint).agg(F.min_by(F.struct(F.col(page).alias("p"), F.col(reading).alias("r")), page).alias("_f"))
    return pages.join(firsts, [file, fingerprint]).select(page, file, F.col("_f.r").alias("reading"), (F.col(page) != F.col("_f.p")).alias("reused"))


def text_is_declaration(text: Column, phrases: tuple[str, ...]) -> Column:
    compact, hit = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), F.lit(False)
    for p in phrases:
        hit = hit | compact.contains(p)
    return hit


def best_candidate(candidates: DataFrame, page: str = "page_id") -> DataFrame:
    """The best reading of each page: confidence and a quarter more if strict, of those shaped as an identifier; the first of equals."""
    from intake.functions.text import as_id, clean_token, is_strict

    shaped = candidates.withColumn("student_id", as_id("text")).where("student_id <> ''")
    score = F.col("confidence") + F.when(is_strict(clean_token("text")), 0.25).otherwise(0.0)
    order = Window.partitionBy(page).orderBy(F.desc("score"), "position")
    return shaped.withColumn("score", score).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def reading_order(boxes: DataFrame, page: str = "page_id", band: float = 40.0) -> DataFrame:
    """``position`` of boxes by band and left edge; of boxes at one place by height, then by what else they hold."""
    rest = sorted(c for c in boxes.columns if c not in (page, "mid_y", "min_x") and not isinstance(boxes.schema[c].dataType, (T.MapType, T.VariantType)))
    order = Window.partitionBy(page).orderBy(F.floor(F.col("mid_y") / band), "min_x", "mid_y", *rest)
    return boxes.withColumn("position", F.row_number().over(order))


def first_code(corners: DataFrame, key: str, lines_col: str = "lines", rank_col: str = "rank", confidences_col: str | None = None) -> DataFrame:
    """The first candidate of a page's corners that is a code: corners by rank (top right first), candidates in their order. With ``confidence``, the text it was ``raw`` and the corner's ``rank``."""
    from intake.functions.text import candidate_readings, parse_batch_code

    tried = corners.select(key, F.col(rank_col).alias("_r"), F.posexplode(candidate_readings(lines_col, confidences_col)).alias("_i", "_t")).withColumn("_c", parse_batch_code("_t.text")).where("_c is not null")
    first = F.min_by(F.struct("_c.batch", "_c.number", "_c.code", "_t.confidence", F.col("_t.text").alias("raw"), F.col("_r").alias("rank")), F.struct("_r", "_i"))
    return tried.groupBy(key).agg(first.alias("c")).select(key, "c.*")
