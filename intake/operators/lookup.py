"""Resolving noisy identifiers against a roster, in stages from exact to fuzzy; each works on what the stage before left.

Readings carry ``reading``, ``scan_school`` and ``scan_location``; equal readings in equal scope are resolved
once. A roster row is found under its school and under the empty scope, which stands for everywhere, so that every scope
is an equi-join. The fuzzy stage meets by shared subsequences, which only pairs that are alike enough have.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intake.functions import similarity, text
from intake.shared import cut

#: Characters that may go from a string to reach a shared subsequence by keys.
DROPPED = 4
#: Readings and identifiers of a scope that meet in one task, about, and the blocks of identifiers up to which a scope's readings go to each; larger scopes meet by keys that are shuffled.
READ, KNOWN, MOST = 1 << 14, 1 << 15, 16
# Thresholds of the fuzzy stages.
MIN_SCORE, MIN_MARGIN, MAX_LENGTH_DELTA, MIN_LETTERS = 0.80, 0.08, 1, 0.55
CANDIDATE = "^[A-Z]{3,12}[0-9]{4,12}$"
PROBE = ("token", "school", "location")
#: Readings and identifiers in a block of pairs at most, about, and blocks in a task.
ASKED, HELD, BLOCKS = 1024, 128, 64


def school_key(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def school_location(schools: DataFrame, employees: DataFrame) -> DataFrame:
    """Each school's most common staff city (the lower one of equals), ``Other`` if it has no staff."""
    staff = employees.groupBy(school_key("school_acronym").alias("school"), "location").agg(F.count("*").alias("n"))
    modal = staff.groupBy("school").agg(F.min_by("location", F.struct(-F.col("n"), "location")).alias("city"))
    return schools.select(school_key("school_name").alias("school")).where("school <> ''").distinct().join(modal, "school", "left").select("school", F.coalesce("city", F.lit("Other")).alias("location"))


def token_of(c: Column | str) -> Column:
    """The cleaned reading; one that holds Devanagari is transliterated first."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(text.has_devanagari(c), text.transliterate(c)).otherwise(text.clean_token(c))


def probes(readings: DataFrame) -> DataFrame:
    """Distinct (token, school, location) of the readings."""
    return readings.select(token_of("reading").alias("token"), school_key("scan_school").alias("school"), F.coalesce("scan_location", F.lit("")).alias("location")).where("token <> ''").distinct()


def resolve_scope(probed: DataFrame, locations: DataFrame) -> DataFrame:
    """``probed`` with ``scope``: the school, else each school of the city, else '' (everywhere; so too if the city has no school)."""
    by_city = locations.select(F.col("location"), F.col("school").alias("_s"))
    city = probed.where("school = '' and location <> ''").join(by_city, "location", "left").select(*PROBE, F.coalesce("_s", F.lit("")).alias("scope"))
    other = probed.where("school <> '' or location = ''").select(*PROBE, F.col("school").alias("scope"))
    return other.union(city)


def roster_keys(roster: DataFrame) -> DataFrame:
    key = school_key("school_name")
    return roster.select("person", "student_id", "student_name", "school_name", F.upper(F.trim("student_id")).alias("id"), key.alias("school_key"), F.explode(F.array_distinct(F.array(key, F.lit("")))).alias("scope"))


def _pick(hits: DataFrame, *first: Column) -> DataFrame:
    """One roster row per probe: the least by ``first``, then by school and name."""
    best = F.min_by(F.struct("person", "student_id", "student_name", "school_name", "via"), F.struct(*first, "school_key", "student_name", "person")).alias("_m")
    return hits.groupBy(*PROBE).agg(best).select(*PROBE, "_m.*")


def exact_lookup(scoped: DataFrame, roster: DataFrame) -> DataFrame:
    keys = roster_keys(roster)
    return _pick(scoped.withColumn("id", F.col("token")).join(keys, ["scope", "id"]).withColumn("via", F.lit("exact")))


def variant_lookup(scoped: DataFrame, roster: DataFrame, with_exact: bool = False) -> DataFrame:
    """The first correction that hits exactly: variants by shape in their order, then the safe one (and before them the token itself)."""
    token = F.col("token")
    tried = F.concat(
        F.transform(text.shape_variants(token), lambda v, i: F.struct((i + 1).alias("rank"), v.alias("id"), F.lit("shape_fix").alias("via"))),
        F.filter(F.array(F.struct(F.lit(9).alias("rank"), text.safe_variant(token).alias("id"), F.lit("safe_variant").alias("via"))), lambda x: x["id"].isNotNull()),
        F.array(F.struct(F.lit(0).alias("rank"), token.alias("id"), F.lit("exact").alias("via"))),
    )
    ranked = scoped.select(*PROBE, "scope", F.inline(tried))
    ranked = ranked if with_exact else ranked.where("rank > 0")
    return _pick(ranked.join(roster_keys(roster), ["scope", "id"]), F.col("rank"))


def _accept(scored: DataFrame, least: float) -> DataFrame:
    """Probes whose best identifier is good enough, clear of the runner-up and of about the reading's length. ``scored``: probe, id, score."""
    one = scored.groupBy(*PROBE, "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*PROBE).orderBy(F.desc("score"), "id")
    ranked = one.withColumn("rank", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0))).where("rank = 1")
    clear = (F.col("second") == 0) | (F.col("score") - F.col("second") >= MIN_MARGIN)
    return ranked.where((F.col("score") >= least) & clear & (F.abs(F.length("id") - F.length("token")) <= MAX_LENGTH_DELTA)).select(*PROBE, "id", "score", "second")


def _found(accepted: DataFrame, scoped: DataFrame, roster: DataFrame, via: str) -> DataFrame:
    hits = accepted.join(scoped, list(PROBE)).join(roster_keys(roster), ["scope", "id"])
    return _pick(hits.withColumn("via", F.lit(via)))


def _queries() -> Column:
    token = F.col("token")
    return F.array_distinct(F.concat(F.array(token, F.translate(token, *text.SAFE_DIGIT)), text.shape_variants(token)))


def _least_common(m: Column, n: Column, score: Column) -> Column:
    """Characters in common that strings of two lengths need for a score."""
    return F.ceil(score * (m + n) / 2.0 - 1e-9).cast("int")


def _keyed(df: DataFrame, strings: Column, length: Column, *keep: str) -> DataFrame:
    """``key`` for each subsequence of ``common`` characters of the strings, in the scope; ``df`` has scope and common."""
    drop = length - F.col("common")
    keyed = df.where((drop >= 0) & (drop <= DROPPED)).withColumn("_s", similarity.subsequence_keys(strings, F.col("common")))
    return keyed.select(*keep, F.explode("_s").alias("_s")).select(*keep, F.xxhash64("scope", "_s").alias("key"))


def _candidates(roster: DataFrame) -> DataFrame:
    """Identifiers of each scope that the fuzzy stages may give, with their length."""
    return roster_keys(roster).where(F.col("id").rlike(CANDIDATE)).select("scope", "id", F.length("id").alias("n")).distinct()


def fuzzy_keys(roster: DataFrame) -> DataFrame:
    """The identifiers by scope that the fuzzy stage asks for, to be made once for many lookups."""
    return cut(_candidates(roster))


def _near(asked: DataFrame, ids: DataFrame) -> DataFrame:
    """Readings with the identifiers of their scope that have ``common`` characters in order in common with one of their forms: PROBE, id, score; of those of a form and a block the two best at least.

    ``asked``: PROBE, scope, n (length of the identifiers meant), common. Two strings have so many in common exactly if they share a subsequence of that length, so
    no other pair meets. A string has tens of these, so they are not shuffled: blocks of readings and of identifiers of a scope meet as strings, and each task makes their keys. Work would grow with the product in a
    very large scope, so that one goes by shuffled keys. Lengths that would need more than ``DROPPED`` characters to go on either side, which are rare, meet by scope and length.
    """
    spark, on = asked.sparkSession, ["scope", "_block", "_salt"]
    asked = cut(asked.select(*PROBE, "scope", F.col("n"), F.col("common").cast("int").alias("common")))
    far = (F.col("n") - F.col("common") > DROPPED) | (F.length("token") - F.col("common") > DROPPED)
    counted = asked.where(~far).groupBy("scope").agg(F.count("*").alias("_m")).join(ids.groupBy("scope").agg(F.count("*").alias("_n")), "scope")
    sizes = cut(counted.select("scope", F.ceil(F.col("_m") / READ).alias("_salts"), F.ceil(F.col("_n") / KNOWN).alias("_blocks")))
    groups, most = sizes.agg(F.sum(F.when(F.col("_blocks") <= MOST, F.col("_blocks") * F.col("_salts"))), F.max("_blocks")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, (groups or 0) // 4)
    small, dealt = sizes.where(F.col("_blocks") <= MOST), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.where(~far).join(small, "scope").withColumn("_salt", F.pmod(F.xxhash64(*PROBE), F.col("_salts"))).select(*PROBE, "scope", "n", "common", "_salt", dealt("_blocks").alias("_block"))
    right = ids.join(small, "scope").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks"))).select("scope", "id", "_block", dealt("_salts").alias("_salt"))
    left, right = left.repartition(tasks, *on).withColumn("forms", _queries()), right.repartition(tasks, *on)
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(similarity.near_ids, "token string, school string, location string, id string, score double")
    met = asked.where(far).join(ids, ["scope", "n"]).select(*PROBE, "id")
    if (most or 0) > MOST:
        large = sizes.where(F.col("_blocks") > MOST).select("scope")
        mine, theirs = asked.where(~far).join(large, "scope"), ids.join(asked.where(~far).select("scope", "n", "common").distinct(), ["scope", "n"]).join(large, "scope")
        keyed = _keyed(mine, _queries(), F.length("token"), *PROBE, "scope", "n", "common")
        keyed_ids = _keyed(theirs, F.array("id"), F.col("n"), "scope", "n", "common", "id")
        # a pair meets at each key it shares: only its strings are shuffled to make it one, its forms are made again
        met = met.unionByName(keyed.join(keyed_ids, ["key", "scope", "n", "common"]).select(*PROBE, "id")).distinct()
    scores = F.transform(_queries(), lambda q: 200.0 * similarity.lcs(q, F.col("id")) / (F.length(q) + F.length("id")) / 100.0)
    return found.unionByName(met.select(*PROBE, "id", F.array_max(scores).alias("score")))


def constrained_repair(scoped: DataFrame, roster: DataFrame, built: DataFrame | None = None) -> DataFrame:
    """The identifier of the scope most like the reading, its confusion-normalised form or a variant, if it is safe to take.

    First the identifiers that could be taken: of about the reading's length and alike enough. Then, for readings that have one clear of the others, the rivals of any length
    that come within the margin of it. ``built``: ``fuzzy_keys`` of the roster.
    """
    ids = fuzzy_keys(roster) if built is None else built
    lengths = ids.select("scope", "n").distinct()
    m, n = F.length("token"), F.col("n")
    asked = scoped.where(m >= 6)
    close = asked.join(lengths, "scope").where(F.abs(n - m) <= MAX_LENGTH_DELTA).withColumn("common", _least_common(m, n, F.lit(MIN_SCORE)))
    takeable = cut(_near(close.where("common <= n and common <= length(token)"), ids))
    best = _accept(takeable, MIN_SCORE).select(*PROBE, (F.col("score") - MIN_MARGIN).alias("least"))
    rivals = asked.join(best, list(PROBE)).join(lengths, "scope").withColumn("common", _least_common(m, n, F.col("least"))).drop("least")
    near = _near(rivals.where("common <= n and common <= length(token)"), ids)
    scored = takeable.join(best, list(PROBE), "left_semi").unionByName(near)
    return _found(_accept(scored, MIN_SCORE), scoped, roster, "constrained_repair")


def _school_blocks(readings: DataFrame, ids: DataFrame) -> DataFrame:
    """Blocks of readings (``asked``: reading_id, token) with blocks of the identifiers (``held``: id) of their schools: each pair of both is in one row alone.

    Repeats go before the pairs are made, so that these, which are many, are never shuffled. Readings go by the set of their schools, so that one with several schools meets an identifier
    that these share once. Blocks are of a bounded size and a task has at most about ``BLOCKS`` of them, whatever the size of a school.
    """
    spark = readings.sparkSession
    schools = readings.where("scan_school is not null").groupBy("reading_id", "token").agg(F.array_sort(F.collect_set("scan_school")).alias("_key"))
    asked = cut(schools)
    each = asked.select("_key").distinct().withColumn("scan_school", F.explode("_key"))
    held = cut(each.join(ids.where("scan_school is not null").distinct(), "scan_school").select("_key", "id").distinct())
    counted = asked.groupBy("_key").agg(F.count("*").alias("_m")).join(held.groupBy("_key").agg(F.count("*").alias("_n")), "_key")
    sizes = cut(counted.select("_key", F.ceil(F.col("_m") / ASKED).alias("_rows"), F.ceil(F.col("_n") / HELD).alias("_parts")))
    blocks = sizes.agg(F.sum(F.col("_rows") * F.col("_parts"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-blocks // BLOCKS))

    def block(df: DataFrame, by: str, *columns: str) -> DataFrame:
        dealt = df.join(sizes, "_key").withColumn("_block", F.pmod(F.xxhash64(*columns), F.col(by)))
        return dealt.groupBy("_key", "_block").agg(F.collect_list(F.struct(*columns)).alias("_some"), F.first("_parts").alias("_parts"))

    rows = block(asked, "_rows", "reading_id", "token").select("_key", F.col("_block").alias("_row"), F.col("_some").alias("asked"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_block"))
    met = rows.join(block(held, "_parts", "id").select("_key", "_block", F.col("_some").alias("held")), ["_key", "_block"])
    return met.repartition(tasks, "_key", "_row", "_block").select("asked", "held")


def pairs_of_school(readings: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct (reading_id, token, id) of readings (reading_id, scan_school, token) and identifiers (scan_school, id) of their school."""
    return _school_blocks(readings, ids).select(F.inline("asked"), "held").select("reading_id", "token", F.inline("held"))


def ratios_of_school(readings: DataFrame, ids: DataFrame, digits: int) -> DataFrame:
    """(reading_id, id, score) of ``pairs_of_school``, with their ratio rounded. Pairs are made where they are scored: only blocks of strings go to Python."""
    kind = readings.schema["reading_id"].dataType.simpleString()
    return _school_blocks(readings, ids).mapInArrow(partial(similarity.ratio_blocks, digits=digits), f"reading_id {kind}, id string, score double")


def _two_best(scored: DataFrame, *by: str) -> DataFrame:
    """Of each key's identifiers two of the highest score."""
    one = scored.repartition(*by).groupBy(*by, "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return one.withColumn("_k", F.row_number().over(order)).where("_k <= 2").drop("_k")


def _alike_letters(asked: DataFrame, ids: DataFrame) -> DataFrame:
    """For each (scope, digits, letters) asked two identifiers of the highest prefix scores, if these may decide: scope, digits, letters, id, score.

    The score is that of the best subsequence both sides have, so both are keyed by these, and two identifiers for each key are enough to show the best score, whether one identifier alone has it, and the next:
    pairs grow with the readings, not with their product with the roster. Digits are dealt over buckets as strings, and keys are made and met in a bucket's task. Strings of more than
    ``KEYED_LETTERS``, which are rare, meet by scope and digits.
    """
    least, most, spark = MIN_LETTERS - MIN_MARGIN, similarity.KEYED_LETTERS, asked.sparkSession
    on, group = ["scope", "digits"], ["scope", "_bucket"]
    asked, ids = asked.withColumn("m", F.length("letters")), cut(ids.withColumn("n", F.length("_letters")).where("n > 0"))
    short, few = asked.where(F.col("m") <= most), ids.where(F.col("n") <= most)
    counted = short.groupBy("scope").agg(F.count("*").alias("_m")).join(few.groupBy("scope").agg(F.count("*").alias("_n")), "scope")
    sizes = cut(counted.select("scope", F.ceil(F.greatest("_m", "_n") / READ).alias("_buckets")))
    groups = sizes.agg(F.sum("_buckets")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, groups // 4)
    left, right = (df.select(*on, *rest).join(sizes, "scope").withColumn("_bucket", F.pmod(F.xxhash64("digits"), F.col("_buckets"))).repartition(tasks, *group) for df, rest in ((short, ["letters"]), (few, ["id", "_letters"])))
    met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(lambda mine, theirs: similarity.letter_ids(mine, theirs, least), "scope string, digits string, letters string, id string, score double")
    pairs = asked.where(F.col("m") > most).join(ids, on).unionByName(short.join(ids.where(F.col("n") > most), on))
    far = pairs.select(*on, "letters", similarity.prefix_similarity("letters", "_letters").alias("score"), "id")
    return _two_best(met.unionByName(far), *on, "letters")


def digit_suffix(scoped: DataFrame, roster: DataFrame) -> DataFrame:
    """Of the scope's identifiers that end in the reading's six digits the one with the most alike letters, if it is safe to take."""
    ids = roster_keys(roster).where(F.col("id").rlike(CANDIDATE)).select("scope", "id", F.right("id", F.lit(6)).alias("digits"), text.split_id(F.col("id"))["letters"].alias("_letters")).distinct()
    parts = cut(scoped.withColumn("_p", text.split_id(F.col("token"))).select(*PROBE, "scope", F.col("_p.letters").alias("letters"), F.col("_p.digits").alias("digits")).where("length(digits) = 6 and letters <> ''"))
    on = ["scope", "digits", "letters"]
    scored = parts.join(_alike_letters(parts.select(*on).distinct(), ids), on).select(*PROBE, "id", "score")
    return _found(_accept(scored, MIN_LETTERS), scoped, roster, "digit_suffix")


def find_student(readings: DataFrame, roster: DataFrame, locations: DataFrame, built: DataFrame | None = None) -> DataFrame:
    """``readings`` with person, student_id, student_name, school_name of the match and ``matched_via``; null where none is found. ``built``: ``fuzzy_keys`` of the roster."""
    scoped = cut(resolve_scope(probes(readings), locations))
    found = cut(variant_lookup(scoped, roster, with_exact=True))
    for stage in (partial(constrained_repair, built=built), digit_suffix):
        left = cut(scoped.join(found, list(PROBE), "left_anti"))
        found = found.unionByName(cut(stage(left, roster)))
    keyed = readings.withColumn("token", token_of("reading")).withColumn("school", school_key("scan_school")).withColumn("location", F.coalesce("scan_location", F.lit("")))
    return keyed.join(found.withColumnRenamed("via", "matched_via"), list(PROBE), "left").drop(*PROBE)


def find_with_tail(files: DataFrame, roster: DataFrame, locations: DataFrame) -> DataFrame:
    """``files`` (reading, batch_id, batch_school, tail_batch_id, tail_school) looked up at the batch's school and, if not found there and a tail is given, at the tail's.

    ``logged_under`` is the batch whose school has the person, else the file's own; readings without an identifier's shape are not looked up.
    """
    asked = files.withColumns({"_given": F.col("reading"), "reading": text.as_id("reading"), "scan_school": F.col("batch_school"), "scan_location": F.lit(None).cast("string")})
    here = cut(find_student(asked, roster, locations))
    again = here.where("matched_via is null and tail_batch_id is not null and reading <> ''").select(*asked.columns).withColumn("scan_school", F.col("tail_school"))
    late = find_student(again, roster, locations).where("matched_via is not null").withColumn("logged_under", F.col("tail_batch_id"))
    own = here.join(late.select("file_id"), "file_id", "left_anti").withColumn("logged_under", F.col("batch_id"))
    return own.unionByName(late).withColumn("reading", F.col("_given")).drop("_given", "scan_school", "scan_location")


def confirm(readings: DataFrame, roster: DataFrame, locations: DataFrame, built: DataFrame | None = None) -> DataFrame:
    """Attempts to log: readings with the shape of an identifier, corrected, with what they resolve to kept apart; others are refused and left out."""
    gated = readings.withColumn("confirmed_student_id", text.as_id("reading")).where("confirmed_student_id <> ''").withColumn("reading", F.col("confirmed_student_id"))
    return find_student(gated, roster, locations, built).withColumn("found_in_db", F.col("matched_via").isNotNull()).drop("reading")
