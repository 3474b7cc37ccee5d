"""Operator 10: quality rules as a learned decision list, in DataFrame functions only.

Every text gets counts and ratios by built-in functions. From labelled documents, sequential
covering learns rules that reject: a rule grows by the threshold condition of highest FOIL gain on
two thirds of the rows, loses the trailing conditions that don't help on the remaining third, and is kept if
enough of what it covers there is bad; then the rows it covers are set aside and the next is grown. The list becomes
one ordered ``CASE WHEN`` over the columns.

The rules are fitted on at most about ``MAX_LABELLED`` labelled rows, chosen by a hash of the id; their ratios are collected
as numbers, never texts. All counts are a map over rows: no shuffle.

Defined results: a null or blank text has no words, all counts are 0 and it is not kept; repeated
rows each get a row; an empty table gives an empty table; without labelled rows of both kinds the list
is empty and only the base rule rejects. Input columns named as an output column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intake.llm.common import id_hash

#: Most labelled rows that the rules are fitted on (in expectation; ids are drawn by their hash).
MAX_LABELLED = 20_000
#: Candidate thresholds per feature, conditions per rule, rules, and the precision a rule must reach on the pruning rows.
CUTS, MAX_CONDITIONS, MAX_RULES, PRECISION = 40, 3, 12, 0.8
#: Least share of the bad growing rows that a rule must still cover.
MIN_SHARE = 0.01
#: Words in a window of which repeats are counted; a power of two, as hashes are doubled up.
WINDOW = 8
_SPACE = " \t\n\x0b\x0c\r"

#: Ratios that rules may test, as expressions over the counts.
FEATURES = {
    "f_words": "cast(n_words as double)",
    "f_word_chars": "word_chars / greatest(n_words, 1)",
    "f_symbols": "n_symbols / greatest(n_words, 1)",
    "f_dup_lines": "n_dup_lines / greatest(_q_lines, 1)",
    "f_repeats": "n_repeat_words / greatest(n_words, 1)",
    "f_distinct": "_q_distinct / greatest(n_words, 1)",
    "f_upper": "_q_upper / greatest(word_chars, 1)",
    "f_marks": "_q_marks / greatest(n_words, 1)",
    "f_digits": "_q_digits / greatest(word_chars, 1)",
    "f_lone": "_q_lone / greatest(n_words, 1)",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: str, chars: str) -> str:
    return f"length({text}) - length(translate({text}, '{chars}', ''))"


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, the ratios and ``base_failed``."""
    blank = r"[\\x20\\x09-\\x0D]+"
    df = docs.withColumn("_q_text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn("_q_w", F.expr(f"filter(split(_q_text, '{blank}'), x -> x <> '')"))
    df = df.withColumn("_q_l", F.expr(f"filter(split(_q_text, '\\n'), x -> length(translate(x, '{_SPACE}', '')) > 0)"))
    df = df.withColumns({
        "n_words": F.expr("cast(size(_q_w) as bigint)"),
        "word_chars": F.expr(f"cast(length(translate(_q_text, '{_SPACE}', '')) as bigint)"),
        "n_symbols": F.expr(f"cast({_without('_q_text', '#*$%&|<>')} as bigint)"),
        "n_dup_lines": F.expr("cast(size(_q_l) - size(array_distinct(_q_l)) as bigint)"),
        "_q_lines": F.expr("size(_q_l)"),
        "_q_distinct": F.expr("size(array_distinct(_q_w))"),
        "_q_upper": F.expr("length(regexp_replace(_q_text, '[^\\\\p{Lu}]+', ''))"),
        "_q_marks": F.expr(_without("_q_text", "!?~=_^")),
        "_q_digits": F.expr(_without("_q_text", "0123456789")),
        "_q_lone": F.expr("size(filter(_q_w, x -> length(x) = 1))"),
        "_q_h1": F.transform("_q_w", lambda w: F.xxhash64(w)),
    })
    # hashes of 2, 4 and 8 words in a row, each from two of the size before
    for k in (2**j for j in range(WINDOW.bit_length() - 1)):
        df = df.withColumn(f"_q_h{2 * k}", F.expr(f"zip_with(_q_h{k}, slice(_q_h{k}, {k + 1}, size(_q_h{k})), (x, y) -> xxhash64(x, y))"))
    df = df.withColumn("_q_h", F.expr(f"slice(_q_h{WINDOW}, 1, greatest(0, size(_q_h{WINDOW}) - {WINDOW - 1}))"))
    # start positions of windows found more than once, by sorting (hash, position) and looking at both neighbours
    df = df.withColumn("_q_s", F.expr("if(size(array_distinct(_q_h)) < size(_q_h), sort_array(transform(_q_h, (x, i) -> struct(x as h, i as i))), array())"))
    df = df.withColumn("_q_p", F.expr("sort_array(filter(transform(_q_s, (x, i) -> if(x.h = get(_q_s, i - 1).h or x.h = get(_q_s, i + 1).h, x.i, null)), x -> x is not null))"))
    df = df.withColumn("n_repeat_words", F.expr(f"aggregate(transform(_q_p, (x, i) -> least({WINDOW}, coalesce(get(_q_p, i + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)"))
    df = df.withColumns({k: F.expr(v) for k, v in FEATURES.items()} | {"base_failed": F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")})
    return df.drop("_q_text", "_q_w", "_q_l", "_q_lines", "_q_distinct", "_q_upper", "_q_marks", "_q_digits", "_q_lone", "_q_h", *(f"_q_h{2**j}" for j in range(WINDOW.bit_length())), "_q_s", "_q_p")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for c in rule:
        rows = rows & c.holds(x)
    return rows


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and (rows & ~bad).any():
        p0, n0 = (rows & bad).sum(), (rows & ~bad).sum()
        best, gain = None, 1e-9
        for f, v in x.items():
            cuts = np.unique(np.quantile(np.concatenate([np.unique(v[rows & bad]), np.unique(v[rows & ~bad])]), np.linspace(0, 1, CUTS)))
            for t in (cuts[1:] + cuts[:-1]) / 2:
                for above in (True, False):
                    hit = rows & ((v > t) == above)
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(f, above, float(t)), g
        if best is None:
            break
        rule.append(best)
        rows = rows & best.holds(x)
    return tuple(rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, growing: np.ndarray) -> list[Rule]:
    """Rules that reject, in order; ``growing`` marks the rows that rules grow on, the others prune."""
    rules: list[Rule] = []
    left, least = np.ones(len(bad), bool), MIN_SHARE * (bad & growing).sum()
    while len(rules) < MAX_RULES and (left & growing & bad).any() and (left & growing & ~bad).any():
        rule = _grow(x, bad, left & growing)
        scored = []
        for k in range(1, len(rule) + 1):
            hit = _covers(rule[:k], x, left & ~growing)
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            scored.append(((p + 1) / (p + n + 2), -k))
        if not scored or (best := max(scored))[0] < PRECISION:
            break
        rule = rule[: -best[1]]
        if (_covers(rule, x, left & growing) & bad).sum() < max(2, least):
            break
        rules.append(rule)
        left &= ~_covers(rule, x, left)
    return rules


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the documents that ``labels`` (doc_id, quality) covers; an id with labels of both kinds counts as bad."""
    labelled = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    n = labelled.count()
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(max_labelled / max(n, 1) * (1 << 20)))
    rows = measure(docs.select("doc_id", text_col).join(chosen, "doc_id"), text_col).select(*FEATURES, "_good", (id_hash(F.col("doc_id")) % 3 > 0).alias("_grow")).collect()
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn(x, np.array([r["_good"] == 0 for r in rows], bool), np.array([r["_grow"] for r in rows], bool))


def rejects(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    chain = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        hit = F.lit(True)
        for c in rules[k - 1]:
            hit = hit & c.column()
        chain = F.when(hit, F.lit(k)).otherwise(chain)
    return chain


def decide(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with counts, ratios, ``base_failed``, ``rule`` (that rejected) and ``kept``."""
    df = measure(docs, text_col).withColumn("rule", rejects(rules))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_rows(decided: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the rows that ``decide`` keeps. An explode, as a filter would be pushed below the counts and compute them again inside each other."""
    return decided.select(*columns, F.explode(F.when(F.col("kept"), F.array(F.lit(1)))).alias("_one")).drop("_one")
