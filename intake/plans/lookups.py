"""Queries of cleaning, similarity and lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from intake.functions import text
from intake.operators import features, lookup
from intake.plans.fixtures import fixture, with_fixtures
from intake.shared import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return add


# The same functions as SQL.
def q_clean(x):
    return f"upper(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]', '', 'g'))"


def q_shape(x, k):
    return f"translate(substr({x}, 1, {k}), '0158264', 'OISBZGA') || translate(substr({x}, {k + 1}), 'OQDILSBZGTA', '00011582674')"


def q_looks(x):
    return f"regexp_full_match(upper(regexp_replace({x}, '[. _-]', '', 'g')), '[A-Z]{{4,7}}[0-9]{{5,7}}[A-Z]?[0-9]?')"


def q_tail(x):
    return f"regexp_matches({x}, '(^|[^0-9])[0-9]{{6}}$')"


def q_safe(x):
    head, rest = f"regexp_extract({x}, '^([A-Z]+)([0-9OILSBZG]+)$', 1)", f"translate(regexp_extract({x}, '^([A-Z]+)([0-9OILSBZG]+)$', 2), 'OILSBZG', '0115826')"
    return f"case when {head} <> '' and regexp_full_match({head} || {rest}, '[A-Z]{{3,12}}[0-9]{{4,12}}') and {head} || {rest} <> {x} then {head} || {rest} end"


def q_variants(x):
    """Ordered list of distinct variants other than the token."""
    a, b, c = (q_shape(x, k) for k in (6, 5, 7))
    tried = f"case when length({x}) < 8 then [] when length({x}) = 12 then [{a}] else [{a}, {b}, {c}] end"
    return f"list_filter({tried}, lambda v, i: v <> {x} and list_position({tried}, v) = i)"


def q_lcs(a, b):
    mask = f"list_transform(string_split({b}, ''), lambda ch: list_sum(list_transform(range(1, length({a}) + 1), lambda i: case when substr({a}, i, 1) = ch then 1::bigint << (i - 1)::int else 0::bigint end))::bigint)"
    return f"bit_count(((1::bigint << 60) - 1) & ~list_reduce({mask}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::bigint << 60) - 1), (1::bigint << 60) - 1))"


def q_ratio(a, b):
    return f"2.0 * {q_lcs(a, b)} / (length({a}) + length({b}))"


TOKENS = f"select reading_id, reading, {q_clean('reading')} as token from fx_readings"


@query(f"select reading_id, token, {q_shape('token', 6)} as shaped, array_to_string({q_variants('token')}, ',') as variants, coalesce({q_safe('token')}, '') as safe from ({TOKENS})")
def shape_repair(spark, d):
    """Cleaned tokens, forced shapes, ordered variants and the safe variant."""
    t = fixture(spark, d, "fx_readings").select("reading_id", text.clean_token("reading").alias("token"))
    c = F.col("token")
    return t.select("reading_id", "token", text.apply_shape(c, 6).alias("shaped"), F.array_join(text.shape_variants(c), ",").alias("variants"), F.coalesce(text.safe_variant(c), F.lit("")).alias("safe"))


AS_ID = f"case when {q_looks('token')} then token else coalesce(list_filter({q_variants('token')}, lambda w: {q_looks('w')} and {q_tail('w')})[1], '') end"


@query(f"""select reading_id, regexp_full_match(reading, '[A-Z]{{6}}[0-9]{{6}}') as canonical, {q_looks('reading')} as looks, {q_tail('reading')} as tail, {AS_ID} as student_id,
  case when {q_looks('reading')} then reading else '<not an ID: ' || length(reading) || ' chars>' end as shown from ({TOKENS})""")
def id_shapes(spark, d):
    """Shape tests, the identifier a reading stands for, and what a log may show of it."""
    c = F.col("reading")
    return fixture(spark, d, "fx_readings").select("reading_id", text.is_canonical(c).alias("canonical"), text.looks_like_id(c).alias("looks"), text.has_date_tail(c).alias("tail"), text.as_id(c).alias("student_id"), text.redact(c).alias("shown"))


STRICT = "(length(token) between 8 and 20 and not regexp_matches(token, 'STUDENT|GRADE|NAME|CLASS|DIVISION|SCHOOL|DATE') and regexp_full_match(token, '[A-Z]{3,12}[0-9]{4,12}'))"


@query(f"""select reading_id, token, case when {STRICT} then 'strict' when length(token) between 8 and 20 and regexp_matches(token, '^[A-Z]{{4}}') and regexp_matches(token, '[0-9]') then 'noisy'
  when {q_tail('token')} and regexp_matches(token, '[A-Z]') then 'digits' else 'junk' end as kind
  from (select reading_id, regexp_replace(translate(upper(trim(translate(reading, '0123456789', '०१२३४५६७८९'))), '०१२३४५६७८९', '0123456789'), '[^A-Za-z0-9_/-]', '', 'g') as token from fx_readings)""")
def reading_classes(spark, d):
    """Identifiers written in Devanagari digits folded, cleaned and classed."""
    t = fixture(spark, d, "fx_readings").select("reading_id", text.clean_id(F.translate("reading", "0123456789", text.DEVANAGARI_DIGITS)).alias("token"))
    return t.select("reading_id", "token", text.reading_class(F.col("token")).alias("kind"))


@query(f"""select reading_id, case when regexp_full_match(token, '[A-Z]+[0-9]+') then regexp_extract(token, '^([A-Z]+)[0-9]+$', 1) when regexp_matches(token, '[0-9]{{6}}$') then regexp_replace(regexp_extract(token, '^(.*)[0-9]{{6}}$', 1), '[^A-Z]', '', 'g') else regexp_replace(token, '[^A-Z]', '', 'g') end as letters,
  case when regexp_full_match(token, '[A-Z]+[0-9]+') then regexp_extract(token, '^[A-Z]+([0-9]+)$', 1) when regexp_matches(token, '[0-9]{{6}}$') then regexp_extract(token, '([0-9]{{6}})$', 1) else regexp_replace(token, '[^0-9]', '', 'g') end as digits from ({TOKENS})""")
def split_ids(spark, d):
    """Letters and digits of a reading."""
    return fixture(spark, d, "fx_readings").select("reading_id", F.inline(F.array(text.split_id(text.clean_token("reading")))))


CODES = """select event_id, text, a as batch, b as number, 'B' || a || '-' || b as code, 'B' || a as folder from (
  select event_id, text, try_cast(x[1] as int) as a, try_cast(x[2] as int) as b, x, head from (
    select event_id, text, head, list_transform(case when contains(body, '-') then regexp_split_to_array(body, '\\s*-+\\s*') else regexp_split_to_array(body, '\\s+') end, lambda p: translate(regexp_replace(p, '\\s+', '', 'g'), 'IL|O', '1110')) as x
    from (select event_id, text, substr(upper(trim(text)), 1, 1) as head, trim(translate(substr(upper(trim(text)), 2), '~_.', '---')) as body from fx_corner_texts)))
  where len(x) = 2 and head in ('B', '8', '3') and regexp_full_match(x[1], '[0-9]{1,3}') and regexp_full_match(x[2], '[0-9]{1,3}') and try_cast(x[1] as int) > 0 and try_cast(x[2] as int) > 0""".replace("\\\\", "\\")


@query(CODES)
def batch_codes(spark, d):
    """Codes as written or misread, where they are codes."""
    return fixture(spark, d, "fx_corner_texts").select("event_id", "text", F.inline(F.array(text.parse_batch_code("text")))).where("batch is not null")


CORNERS = """select event_id, cast(event_id % 2 as int) as rank, case event_id % 3 when 0 then {array}('{three} ' || text || ' 6') when 1 then {array}('serial', '{three}', text) else {array}(substr(text, 1, 2), substr(text, 3)) end as lines,
  {array}(cast((event_id % 10) / 10.0 as double), cast(0.5 as double), cast(0.25 as double)) as confidences from fx_corner_texts"""
WINDOWS = f"""corners as ({CORNERS.format(array='list_value', three='③')}),
l as (select *, list_filter(list_transform(range(1, len(lines) + 1), lambda i: {{'t': trim(regexp_replace(regexp_replace(lines[i], '③', ' ', 'g'), '\\s+', ' ', 'g')), 'c': confidences[i]}}), lambda x: x.t <> '') as ls from corners),
w as (select *, flatten(list_transform(ls, lambda x: list_transform(string_split(x.t, ' '), lambda y: {{'t': y, 'c': x.c}}))) as ws from l),
r as (select *, flatten(list_transform(range(2, least(len(ws), 6) + 1), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: {{'t': array_to_string(list_transform(ws[i : i + k - 1], lambda x: x.t), ' '), 'c': list_sum(list_transform(ws[i : i + k - 1], lambda x: x.c)) / k}}))) as rs from w),
a as (select event_id, rank, list_concat(ws, ls, rs) as cs from r),
cands as (select event_id, rank, i, cs[i].t as text, cs[i].c as c from (select *, unnest(range(1, len(cs) + 1)) as i from a))"""


@query(f"with {WINDOWS}, codes as ({CODES.replace('event_id, text', 'event_id, rank, i, c, text').replace('fx_corner_texts', 'cands')}) select page, arg_min(code, (rank, i, event_id)) as code, round(arg_min(c, (rank, i, event_id)), 6) as confidence, arg_min(text, (rank, i, event_id)) as raw from (select event_id // 2 as page, * from codes) group by 1")
def corner_codes(spark, d):
    """The first code of each page's two corners, among words, lines and runs of words, with its confidence."""
    corners = fixture(spark, d, CORNERS.format(array="array", three="③")).withColumn("page", F.expr("event_id div 2"))
    return features.first_code(corners, "page", confidences_col="confidences").select("page", "code", F.round("confidence", 6).alias("confidence"), "raw")


SCHOOLED = "select r.reading_id, upper(trim(f.student_id)) as id, r.token from (select reading_id, scan_school, " + q_clean("reading") + " as token from fx_readings) r join fx_roster f on upper(trim(f.school_name)) = r.scan_school"


@query(f"select reading_id, id, round({q_ratio('token', 'id')}, 9) as score from (select distinct * from ({SCHOOLED}))")
def indel_ratio(spark, d):
    """M1: readings against the identifiers of their school."""
    readings = fixture(spark, d, "fx_readings").select("reading_id", "scan_school", text.clean_token("reading").alias("token"))
    ids = fixture(spark, d, "fx_roster").select(lookup.school_key("school_name").alias("scan_school"), F.upper(F.trim("student_id")).alias("id"))
    return lookup.ratios_of_school(readings, ids, digits=9)


LOCATIONS = """loc as (select s.school, coalesce(c.location, 'Other') as location from (select distinct upper(trim(school_name)) as school from fx_roster) s
  left join (select school, location, row_number() over (partition by school order by n desc, location) as k from (select upper(trim(school_acronym)) as school, location, count(*) as n from fx_employees group by 1, 2)) c on c.school = s.school and k = 1)"""


def q_scoped(token: str, readings: str = "fx_readings") -> str:
    """Readings with their scopes, roster keys and exact hits, of tokens by an expression over the readings."""
    return f"""{LOCATIONS}, probe as (select distinct {token} as token, coalesce(upper(trim(scan_school)), '') as school, coalesce(scan_location, '') as location from {readings}),
scoped as (select token, school, location, school as scope from probe where token <> '' and (school <> '' or location = '')
  union all select p.token, p.school, p.location, coalesce(l.school, '') from probe p left join loc l on l.location = p.location where p.token <> '' and p.school = '' and p.location <> ''),
keys as (select person, student_id, student_name, school_name, upper(trim(student_id)) as id, upper(trim(school_name)) as school_key, upper(trim(school_name)) as scope from fx_roster
  union all select person, student_id, student_name, school_name, upper(trim(student_id)), upper(trim(school_name)), '' from fx_roster),
ranked as (select token, school, location, scope, 0 as rank, token as id, 'exact' as via from scoped
  union all select token, school, location, scope, i, v, 'shape_fix' from (select *, unnest({q_variants('token')}) as v, generate_subscripts({q_variants('token')}, 1) as i from scoped)
  union all select token, school, location, scope, 9, {q_safe('token')}, 'safe_variant' from scoped),
hits as (select r.token, r.school, r.location, r.rank, r.via, k.person, k.student_id, k.student_name, k.school_name, k.school_key from ranked r join keys k on k.scope = r.scope and k.id = r.id)"""


SCOPED = q_scoped(q_clean("reading"))


def q_pick(where: str) -> str:
    return f"select token, school, location, person, student_id, student_name, school_name, via from (select *, row_number() over (partition by token, school, location order by rank, school_key, student_name, person) as k from hits where {where}) where k = 1"


def scoped_of(spark, d):
    readings, roster = fixture(spark, d, "fx_readings"), fixture(spark, d, "fx_roster")
    locations = lookup.school_location(roster, fixture(spark, d, "fx_employees"))
    return readings, roster, locations, lookup.resolve_scope(lookup.probes(readings), locations)


@query(f"with {SCOPED} select * from scoped")
def scopes(spark, d):
    """The schools a reading may be found in."""
    return scoped_of(spark, d)[3]


@query(f"with {SCOPED} {q_pick('rank = 0')}")
def exact_lookup(spark, d):
    """J2."""
    _, roster, _, scoped = scoped_of(spark, d)
    return lookup.exact_lookup(scoped, roster)


@query(f"with {SCOPED} {q_pick('rank > 0')}")
def variant_lookup(spark, d):
    """J3, over all readings."""
    _, roster, _, scoped = scoped_of(spark, d)
    return lookup.variant_lookup(scoped, roster)


REPAIR = f"""cand as (select distinct scope, id from keys where regexp_full_match(id, '[A-Z]{{3,12}}[0-9]{{4,12}}')),
left4 as (select * from scoped s where length(token) >= 6 and not exists (select 1 from hits h where h.token = s.token and h.school = s.school and h.location = s.location)),
asked as (select distinct *, unnest(list_distinct([token, translate(token, 'OILSBZG', '0115826')] || {q_variants('token')})) as q from left4),
score4 as (select token, school, location, c.id, max(200.0::double * {q_lcs('q', 'c.id')} / (length(q) + length(c.id)) / 100.0) as score from asked a join cand c on c.scope = a.scope group by 1, 2, 3, 4),
top4 as (select *, coalesce(lead(score) over w, 0) as second, row_number() over w as k from score4 window w as (partition by token, school, location order by score desc, id)),
ok4 as (select * from top4 where k = 1 and score >= 0.8 and (second = 0 or score - second >= 0.08) and abs(length(id) - length(token)) <= 1),
hit4 as (select o.token, o.school, o.location, x.person, x.student_id, x.student_name, x.school_name, row_number() over (partition by o.token, o.school, o.location order by x.school_key, x.student_name, x.person) as k
  from ok4 o join scoped s on s.token = o.token and s.school = o.school and s.location = o.location join keys x on x.scope = s.scope and x.id = o.id)"""


def q_letters(x):
    return f"case when regexp_full_match({x}, '[A-Z]+[0-9]+') then regexp_extract({x}, '^([A-Z]+)[0-9]+$', 1) when regexp_matches({x}, '[0-9]{{6}}$') then regexp_replace(regexp_extract({x}, '^(.*)[0-9]{{6}}$', 1), '[^A-Z]', '', 'g') else regexp_replace({x}, '[^A-Z]', '', 'g') end"


def q_digits(x):
    return f"case when regexp_full_match({x}, '[A-Z]+[0-9]+') then regexp_extract({x}, '^[A-Z]+([0-9]+)$', 1) when regexp_matches({x}, '[0-9]{{6}}$') then regexp_extract({x}, '([0-9]{{6}})$', 1) else regexp_replace({x}, '[^0-9]', '', 'g') end"


def q_windows(s, t):
    """The best ratio of s with a window of its length over t, cut windows included."""
    window = f"substr({t}, greatest(k, 0) + 1, least(k + length({s}), length({t})) - greatest(k, 0))"
    return f"list_max(list_transform(range(1 - length({s}), length({t})), lambda k: {q_ratio(s, window)}))"


PREFIX = f"greatest({q_ratio('a', 'b')}, case when length(a) <= length(b) then {q_windows('a', 'b')} else 0 end, case when length(b) <= length(a) then {q_windows('b', 'a')} else 0 end)"


def q_suffix(*found: str) -> str:
    """The stage of six digits, on what the hits named leave."""
    left = "".join(f" and not exists (select 1 from {h} h where h.token = s.token and h.school = s.school and h.location = s.location)" for h in found)
    return f"""left5 as (select s.*, {q_letters('token')} as a, {q_digits('token')} as digits from scoped s where true{left}),
pair5 as (select distinct l.token, l.school, l.location, l.a, c.id, {q_letters('c.id')} as b from left5 l join (select distinct scope, id from keys where regexp_full_match(id, '[A-Z]{{3,12}}[0-9]{{4,12}}')) c on c.scope = l.scope and right(c.id, 6) = l.digits where length(l.digits) = 6 and l.a <> ''),
like5 as (select a, b, {PREFIX} as score from (select distinct a, b from pair5)),
top5 as (select p.token, p.school, p.location, id, score, coalesce(lead(score) over w, 0) as second, row_number() over w as k from pair5 p join like5 using (a, b) window w as (partition by p.token, p.school, p.location order by score desc, id)),
ok5 as (select * from top5 where k = 1 and score >= 0.55 and (second = 0 or score - second >= 0.08) and abs(length(id) - length(token)) <= 1),
hit5 as (select o.token, o.school, o.location, x.person, x.student_id, x.student_name, x.school_name, row_number() over (partition by o.token, o.school, o.location order by x.school_key, x.student_name, x.person) as k
  from ok5 o join scoped s on s.token = o.token and s.school = o.school and s.location = o.location join keys x on x.scope = s.scope and x.id = o.id)"""


def q_ladder(token: str, readings: str = "fx_readings") -> str:
    """All stages: ``ladder`` has what each (token, school, location) resolves to."""
    return f"""{q_scoped(token, readings)}, {REPAIR}, {q_suffix('hits', 'hit4')},
ladder as ({q_pick('true')} union all select token, school, location, person, student_id, student_name, school_name, 'constrained_repair' from hit4 where k = 1
  union all select token, school, location, person, student_id, student_name, school_name, 'digit_suffix' from hit5 where k = 1)"""


def q_resolved(token: str, readings: str = "fx_readings") -> str:
    """Readings with what they resolve to."""
    return f"(select r.*, l.person, l.student_id, l.student_name, l.school_name, l.via as matched_via from {readings} r left join ladder l on l.token = {token} and l.school = coalesce(upper(trim(r.scan_school)), '') and l.location = coalesce(r.scan_location, ''))"


@query(f"with {SCOPED}, {REPAIR} select token, school, location, person, student_id, student_name, school_name, 'constrained_repair' as via from hit4 where k = 1")
def constrained_repair(spark, d):
    """On what the exact stages leave."""
    _, roster, _, scoped = scoped_of(spark, d)
    scoped = cut(scoped)
    left = cut(scoped.join(lookup.variant_lookup(scoped, roster, with_exact=True), list(lookup.PROBE), "left_anti"))
    return lookup.constrained_repair(left, roster)


@query(f"with {SCOPED}, {q_suffix('hits')} select token, school, location, person, student_id, student_name, school_name, 'digit_suffix' as via from hit5 where k = 1")
def digit_suffix_lookup(spark, d):
    """On what the exact stages leave."""
    _, roster, _, scoped = scoped_of(spark, d)
    scoped = cut(scoped)
    left = cut(scoped.join(lookup.variant_lookup(scoped, roster, with_exact=True), list(lookup.PROBE), "left_anti"))
    return lookup.digit_suffix(left, roster)


CLEAN = q_clean("reading")


@query(f"with {q_ladder(CLEAN)} select reading_id, reading, scan_school, person, student_id, matched_via from {q_resolved(CLEAN)}")
def find_student(spark, d):
    """Every reading through the whole ladder."""
    readings, roster, locations, _ = scoped_of(spark, d)
    return lookup.find_student(readings, roster, locations).select("reading_id", "reading", "scan_school", "person", "student_id", "matched_via")


GATED = f"gated as (select * exclude (reading, token), student_id as reading from (select *, {AS_ID} as student_id from (select *, {CLEAN} as token from fx_readings)) where student_id <> '')"


@query(f"with {GATED.replace('student_id', 'sid')}, {q_ladder('reading', 'gated')} select reading_id, reading as confirmed_student_id, matched_via is not null as found_in_db, student_id, matched_via from {q_resolved('reading', '(select * exclude (sid) from gated)')}")
def confirm_readings(spark, d):
    """Attempts to log."""
    readings, roster, locations, _ = scoped_of(spark, d)
    return lookup.confirm(readings, roster, locations).select("reading_id", "confirmed_student_id", "found_in_db", "student_id", "matched_via")


@query(f"""with {q_ladder(CLEAN)} select upper(trim(coalesce(scan_school, ''))) as school, coalesce(matched_via, 'not_found') as via, count(*) as n, count(distinct person) as people
  from {q_resolved(CLEAN)} group by rollup (upper(trim(coalesce(scan_school, ''))), coalesce(matched_via, 'not_found'))""")
def resolve_progress(spark, d):
    """Flagship: how many scans resolved, and how, by school, with totals."""
    readings, roster, locations, _ = scoped_of(spark, d)
    found = lookup.find_student(readings, roster, locations)
    return found.rollup(lookup.school_key("scan_school").alias("school"), F.coalesce("matched_via", F.lit("not_found")).alias("via")).agg(F.count("*").alias("n"), F.count_distinct("person").alias("people"))


def q_latin(x):
    for a, b in text.latin_steps():
        x = f"replace({x}, '{a}', '{b}')"
    return f"upper(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"


#: Latin letters and digits as Devanagari ones.
WRITTEN = ("KGTDNPBMYRLVSHAIUEO0123456789", "कगतदनपबमयरलवसहअइउएओ०१२३४५६७८९")


@query(f"select reading_id, {q_latin('folded')} as latin from (select reading_id, translate(translate(upper(reading), '{WRITTEN[0]}', '{WRITTEN[1]}'), '०१२३४५६७८९', '0123456789') as folded from fx_readings)")
def transliterate(spark, d):
    """Readings written in Devanagari."""
    return fixture(spark, d, "fx_readings").select("reading_id", text.transliterate(F.translate(F.upper("reading"), *WRITTEN)).alias("latin"))


WROTE = f"wrote as (select * exclude (reading), translate(upper(reading), '{WRITTEN[0]}', '{WRITTEN[1]}') as reading from fx_readings)"
#: What is left in Latin letters alone is cleaned as it is.
LATIN = f"case when regexp_matches(reading, '[\u0900-\u097F]') then {q_latin("translate(reading, '०१२३४५६७८९', '0123456789')")} else {CLEAN} end"


@query(f"with {WROTE}, {q_ladder(LATIN, 'wrote')} select reading_id, person, student_id, matched_via from {q_resolved(LATIN, 'wrote')}")
def find_devanagari(spark, d):
    """Readings written in Devanagari through the whole ladder."""
    readings, roster, locations, _ = scoped_of(spark, d)
    written = readings.withColumn("reading", F.translate(F.upper("reading"), *WRITTEN))
    return lookup.find_student(written, roster, locations).select("reading_id", "person", "student_id", "matched_via")
