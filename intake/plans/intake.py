"""Queries of attribution, documents and page features."""

from __future__ import annotations

from pyspark.sql import functions as F

from intake.functions import text
from intake.operators import attribution, documents, features, layout, lookup
from intake.plans.fixtures import fixture, with_fixtures
from intake.plans.lookups import AS_ID, STRICT, q_clean, q_ladder, q_tail
from intake.sources import files as sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return add


BATCHES = "b as (select event_id as batch_id, folder_id, school, ts as opened_at, closed_at from (select *, lead(ts) over (partition by folder_id order by ts, event_id) as closed_at from fx_batch_events where kind <> 'file') where kind = 'start')"
PLACED = """f as (select event_id as file_id, folder_id, ts as created from fx_batch_events where kind = 'file'),
near_b as (select f.*, (select max(struct_pack(o := opened_at, i := batch_id, s := school, c := closed_at)) from b where b.folder_id = f.folder_id and b.opened_at <= f.created) as x, (select min(struct_pack(o := opened_at, i := batch_id, s := school, c := closed_at)) from b where b.folder_id = f.folder_id) as y from f),
placed as (select file_id, folder_id, created, case when x is null then y.i when x.c is null or created < x.c then x.i end as batch_id, case when x is null then y.s when x.c is null or created < x.c then x.s end as batch_school,
  case when y is null then 'waiting' when x is null or x.c is null or created < x.c then 'batch' else 'set_aside' end as place from near_b)"""


TAILED = f"""{BATCHES}, {PLACED}, lagged as (select batch_id, opened_at, lag(batch_id) over w as pb, lag(school) over w as ps, lag(closed_at) over w as pc from b window w as (partition by folder_id order by opened_at, batch_id)),
lasts as (select f.file_id as f, max(b.opened_at) as o, arg_max(b.closed_at, (b.opened_at, b.batch_id)) as c from f join b on b.folder_id = f.folder_id and b.opened_at <= f.created group by 1),
tailed as (select p.file_id, p.folder_id, p.created, p.batch_id, p.batch_school, p.place, case when ok then pb end as tail_batch_id, case when ok then ps end as tail_school,
  case when place = 'set_aside' then case when created - c < interval '2 minutes' then 'grace' when created - c < interval '6 hours' then 'leftover' else 'late' end end as late
  from (select p.*, pb, ps, coalesce(created >= opened_at and created < pc + interval '10 minutes' and ps is distinct from batch_school, false) as ok from placed p left join lagged using (batch_id)) p left join lasts on f = file_id)"""


def scene(spark, d):
    events = fixture(spark, d, "fx_batch_events")
    return events.where("kind = 'file'").select(F.col("event_id").alias("file_id"), "folder_id", F.col("ts").alias("created")), attribution.close_on_open(events)


@query(f"with {BATCHES} select * from b")
def batches(spark, d):
    """W6."""
    return scene(spark, d)[1]


@query(f"with {BATCHES}, {PLACED} select * from placed")
def attribute_to_batch(spark, d):
    """J8."""
    return attribution.attribute(*scene(spark, d))


@query(f"with {BATCHES}, {PLACED} select p.*, case when ok then q.pb end as tail_batch_id, case when ok then q.ps end as tail_school from (select p.*, q.pb, q.ps, created >= q.opened_at and created < q.pc + interval '10 minutes' and q.ps is distinct from batch_school as ok from placed p left join (select batch_id, opened_at, lag(batch_id) over w as pb, lag(school) over w as ps, lag(closed_at) over w as pc from b window w as (partition by folder_id order by opened_at, batch_id)) q on q.batch_id = p.batch_id) p left join (select batch_id as bb, lag(batch_id) over w as pb, lag(school) over w as ps from b window w as (partition by folder_id order by opened_at, batch_id)) q on q.bb = p.batch_id".replace("select p.*, case", "select file_id, folder_id, created, batch_id, batch_school, place, case"))
def tail_batch(spark, d):
    """J9."""
    files, b = scene(spark, d)
    return attribution.with_tail(attribution.attribute(files, b), b)


@query(f"with {BATCHES}, {PLACED} select b.batch_id, count(p.file_id) as pages_done from b left join placed p on p.batch_id = b.batch_id and p.place = 'batch' group by 1")
def pages_done(spark, d):
    """A8."""
    files, b = scene(spark, d)
    return attribution.pages_done(attribution.attribute(files, b), b)


@query(f"with {BATCHES} select folder_id, batch_id, school, opened_at, closed_at from (select *, row_number() over (partition by folder_id order by opened_at desc, batch_id desc) as k from b where opened_at <= (select max(ts) from events) and (closed_at is null or closed_at > (select max(ts) from events) - interval '6 hours')) where k = 1")
def batches_to_watch(spark, d):
    """R4, as of the last event."""
    last = fixture(spark, d, "select max(ts) as t from events").first().t
    return attribution.batches_to_watch(scene(spark, d)[1], F.lit(last).cast("timestamp_ntz"))


STATES = "select event_id as file_id, case event_id % 5 when 1 then 'reading' when 2 then 'logged' when 3 then 'done' else 'parked' end as state, ts - (event_id % 20) * interval '1' minute as updated_at from fx_batch_events where kind = 'file' and event_id % 5 <> 0"


@query("select event_id as file_id, case when event_id % 5 = 0 then 'new' when event_id % 5 in (1, 2) then 'resume' when event_id % 5 = 3 and event_id % 20 >= 10 then 'new' else 'skip' end as action from fx_batch_events where kind = 'file'")
def relist_action(spark, d):
    """W9."""
    return attribution.relist_action(scene(spark, d)[0], fixture(spark, d, STATES), F.col("created")).select("file_id", "action")


@query("select event_id as file_id from fx_batch_events where kind = 'file' and event_id % 5 in (0, 1)")
def pending_files(spark, d):
    """J13."""
    return attribution.pending_files(scene(spark, d)[0].select("file_id"), fixture(spark, d, STATES))


@query("select event_id, ts + interval '5 hours 30 minutes' as drive_time from events where event_id % 10 <> 0 union all select event_id, null from events where event_id % 10 = 0")
def drive_time(spark, d):
    """Times as text with a Z, and words that are no time."""
    t = fixture(spark, d, "select event_id, ts from events").select("event_id", F.when(F.col("event_id") % 10 == 0, "yesterday").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).alias("t"))
    return t.select("event_id", text.drive_time("t").alias("drive_time"))


@query("select user_id, case when n_kept = 0 then '[skipped] Scan ' || user_id || '.PDF' when n_kept <> 1 then '[done ' || n_kept || ' pages] Scan ' || user_id || '.PDF' when one = '[unread]' then '[unread] Scan ' || user_id || '.PDF' else one || '.pdf' end as name from (select user_id, count(*) filter (label <> '[skipped]') as n_kept, min(label) filter (label <> '[skipped]') as one from (select user_id, case event_type when 'view' then '[skipped]' when 'click' then '[unread]' else 'ID' || event_id end as label from events) group by 1)")
def result_names(spark, d):
    """T17."""
    e = fixture(spark, d, "select user_id, case event_type when 'view' then '[skipped]' when 'click' then '[unread]' else 'ID' || event_id end as label from events")
    return e.groupBy("user_id").agg(F.collect_list("label").alias("labels")).select("user_id", text.result_name(F.concat(F.lit("Scan "), F.col("user_id").cast("string"), F.lit(".PDF")), F.col("labels")).alias("name"))


PAIRED = """u as (select *, status = 'read' and student_id <> '' as starter, not (status = 'read' and student_id = '' and skip_reason in ('declaration', 'continuation')) as head from fx_pages where code is null and school = 'BOPEMS' and not (status = 'read' and student_id = '' and skip_reason = 'blank')),
runs as (select *, sum(head::int) over (partition by owner order by received_ns, source_page, page_id) as run from u),
marked as (select *, row_number() over w as spot, first_value(starter) over w as s, first_value(school) over w as hs, first_value(location) over w as hl from runs window w as (partition by owner, run order by received_ns, source_page, page_id)),
bad as (select *, max((school is distinct from hs or location is distinct from hl)::int) over (partition by owner, run order by received_ns, source_page, page_id) as wrong from marked),
paired as (select page_id, 'B0-' || n as auto_code from (select *, dense_rank() over (partition by owner order by run) as n from bad where s and run > 0 and spot <= 3 and wrong = 0) where n <= 999)"""
CODED = f"""{PAIRED}, coded as (select p.*, row_number() over w as position, lead(status in ('queued', 'reading') and code is null) over w as next_open, coalesce(code, auto_code) as doc_code from fx_pages p left join paired using (page_id) window w as (partition by owner order by received_ns, source_page, p.page_id))"""
JUDGED = f"""{CODED}, docs as (select owner, doc_code as code, count(*) as pages, list_distinct(list(matched_student_id) filter (coalesce(matched_student_id, '') <> '')) as matched, list_distinct(list(student_id) filter (coalesce(student_id, '') <> '')) as read_ids,
  bool_or(status in ('queued', 'reading')) or coalesce(arg_max(coalesce(next_open, false), position), false) as unread, bool_or(status = 'failed') as failed from coded where doc_code is not null group by 1, 2),
sized as (select *, coalesce(len(matched), 0) as m, coalesce(len(read_ids), 0) as r from docs),
judged as (select owner, code, pages, case when m = 1 then matched[1] when m = 0 and r = 1 then read_ids[1] else '' end as student, case when m = 1 then matched[1] end as one,
  case when m > 1 or (m = 0 and r > 1) then 'conflict' when m = 0 and r = 1 then 'no_match' when m = 0 then 'no_id' else '' end as reasons, unread, failed from sized),
stated as (select *, case when unread then 'waiting' when failed then 'failed' when reasons <> '' then 'needs_attention' else 'ready' end as status from judged)"""


def coded(spark, d):
    return documents.with_codes(fixture(spark, d, "fx_pages"))


@query(f"with {PAIRED} select * from paired")
def pair_uncoded(spark, d):
    """W5."""
    return documents.pair_uncoded(fixture(spark, d, "fx_pages"))


@query(f"with {CODED} select page_id, position, coalesce(next_open, false) as next_open from coded")
def scan_order(spark, d):
    """W4."""
    return documents.scan_order(fixture(spark, d, "fx_pages")).select("page_id", "position", F.coalesce("next_open", F.lit(False)).alias("next_open"))


@query(f"with {CODED} select owner, doc_code as code, string_agg(page_id, ',' order by position) as page_ids from coded where doc_code is not null group by 1, 2")
def assemble_documents(spark, d):
    """G1."""
    return documents.assemble(coded(spark, d)).select("owner", "code", F.array_join(F.transform("parts", lambda p: p["page_id"]), ",").alias("page_ids"))


@query(f"with {CODED} select owner, page_id from coded where doc_code is null and status in ('read', 'failed')")
def unsorted_pages(spark, d):
    """G1: pages of no document."""
    return documents.unsorted(coded(spark, d))


@query(f"with {JUDGED} select owner, code, pages, student, reasons, status from stated")
def judge_documents(spark, d):
    """G2, A9."""
    return documents.judge(documents.assemble(coded(spark, d))).select("owner", "code", "pages", "student", F.array_join("reasons", ",").alias("reasons"), "status")


@query(f"with {JUDGED} select owner, code, case when hold then 'needs_attention' else status end as status, case when hold then 'same_student' else reasons end as reasons from (select *, status = 'ready' and count(*) over (partition by owner, one) > 1 as hold from stated)")
def flag_same_student(spark, d):
    """G3."""
    return documents.flag_same_student(documents.judge(documents.assemble(coded(spark, d)))).select("owner", "code", "status", F.array_join("reasons", ",").alias("reasons"))


@query("select owner, count(*) filter (status = 'queued') as queued, count(*) filter (status = 'reading') as reading, count(*) filter (status = 'read') as read, count(*) filter (status = 'failed') as failed from fx_pages group by 1")
def queue_counts(spark, d):
    """A6."""
    return documents.queue_counts(fixture(spark, d, "fx_pages"))


@query(f"with {JUDGED} select owner, cast(regexp_extract(code, '^B([0-9]+)-', 1) as int) as batch, count(*) as documents, sum(pages) as pages, count(*) filter (status = 'waiting') as waiting, count(*) filter (status = 'ready') as ready, count(*) filter (status = 'needs_attention') as needs_attention, count(*) filter (status = 'failed') as failed, 0 as confirmed, 0 as uploaded, case when code like 'B0-%' then 'No code' else regexp_extract(code, '^(B[0-9]+)-', 1) end as label from stated group by 1, 2, label")
def batch_summary(spark, d):
    """A7."""
    return documents.batch_summary(documents.judge(documents.assemble(coded(spark, d))))


@query("select page_id from fx_pages where not (code is not null and owner % 2 = 0)")
def open_pages(spark, d):
    """Pages in no confirmed document; those of every second owner's coded documents are confirmed."""
    pages = fixture(spark, d, "fx_pages")
    done = pages.where("code is not null and owner % 2 = 0").groupBy("owner", "code").agg(F.collect_list("page_id").alias("page_ids"))
    return documents.open_pages(pages, done).select("page_id")


@query("select page_id, case when received_ns % 9 = 0 then 'B7-7' else code end as code, case when received_ns % 9 = 0 then 'typed' when coalesce(code, '') <> '' then 'read' else 'none' end as code_source, student_id from fx_pages")
def page_view(spark, d):
    """J11."""
    p = fixture(spark, d, "fx_pages")
    typed = p.where("received_ns % 9 = 0").select("page_id", F.lit("B7-7").alias("code"), F.lit(None).cast("string").alias("student_id"))
    return documents.page_view(p.select("page_id", "owner"), p.select("page_id", "code", "student_id"), typed).select("page_id", "code", "code_source", "student_id")


@query("select event_id as file_id, user_id % 5 as folder, case when k = 1 then 'Form.pdf' else 'Form (' || k || ').pdf' end as free_name from (select *, row_number() over (partition by user_id % 5 order by event_id) + case when user_id % 5 = 0 then 1 else 0 end as k from events)")
def free_names(spark, d):
    """One folder holds the name already."""
    e = fixture(spark, d, "select event_id as file_id, user_id % 5 as folder, 'Form.pdf' as name from events")
    return documents.free_names(e, e.where("folder = 0").select("folder", "name").distinct()).select("file_id", "folder", "free_name")


@query("select vec_id, case when abs(embedding[1]) < 0.02 then 'blank' when abs(embedding[2]) > 0.2 then 'declaration' when abs(embedding[3]) * 5 >= 0.75 and abs(embedding[3]) * 5 - abs(embedding[4]) >= 0.25 then 'continuation' when abs(embedding[5]) < 0.02 then 'empty_id' else '' end as reason from embeddings")
def skip_reasons(spark, d):
    """F5."""
    x = lambda k: F.abs(F.col("embedding")[k - 1])
    return fixture(spark, d, "select * from embeddings").select("vec_id", features.skip_reason(x(1), x(2) > 0.2, x(3) * 5, x(4), x(5)).alias("reason"))


@query("select vec_id, round(case when abs(coalesce(a, 0)) < 0.15 then 0 else a end, 6) as skew from (select vec_id, quantile_cont(x, 0.5) filter (abs(x) < 8) as a from (select vec_id, unnest(embedding)::double * 40 as x from embeddings) group by 1)")
def skew_angle(spark, d):
    """F8."""
    lines = fixture(spark, d, "select * from embeddings").select("vec_id", F.explode("embedding").alias("x")).select("vec_id", (F.col("x").cast("double") * 40).alias("angle"))
    return features.skew_angle(lines, "vec_id", "angle").select("vec_id", F.round("skew", 6).alias("skew"))


@query("select doc_id, source, first_value(lang || doc_id) over w as reading, doc_id <> first_value(doc_id) over w as reused from documents window w as (partition by source, md5(text) order by doc_id)")
def reuse_duplicates(spark, d):
    """documents as pages, sources as files."""
    pages = fixture(spark, d, "select doc_id, source, md5(text) as fingerprint, lang || doc_id as r from documents")
    return features.reuse_duplicates(pages, "source", "fingerprint", "doc_id", "r").select("doc_id", "source", "reading", "reused")


@query(f"""select page_id, student_id, round(score, 6) as score from (select *, row_number() over (partition by page_id order by score desc, reading_id) as k from (select reading_id, reading_id // 4 as page_id, {AS_ID} as student_id, (reading_id % 7) / 10.0 + case when {STRICT} then 0.25 else 0 end as score from (select *, {q_clean('reading')} as token from fx_readings))
  where student_id <> '') where k = 1""")
def best_candidate(spark, d):
    """The best of the readings of a page."""
    r = fixture(spark, d, "fx_readings").select(F.floor(F.col("reading_id") / 4).alias("page_id"), F.col("reading").alias("text"), F.col("reading_id").alias("position"), ((F.col("reading_id") % 7) / 10.0).alias("confidence"))
    return features.best_candidate(r).select("page_id", "student_id", F.round("score", 6).alias("score"))


@query("""select event_id, case when text like 'B0-%' then 0 else cast(regexp_extract(text, '^B([0-9]+)-', 1) as int) end as batch, cast(regexp_extract(text, '-([0-9]+)$', 1) as int) as number
  from (select event_id, case event_id % 3 when 0 then 'B0-' else 'B' || (1 + event_id % 40) || '-' end || (1 + event_id % 900) as text from events)""")
def code_parts(spark, d):
    """Written and automatic codes."""
    e = fixture(spark, d, "select event_id, case event_id % 3 when 0 then 'B0-' else 'B' || (1 + event_id % 40) || '-' end || (1 + event_id % 900) as text from events")
    return e.select("event_id", F.inline(F.array(text.code_parts("text"))))


@query("select event_id, substr(sha256(lower(trim(' User' || user_id || '@Example.org '))), 1, 24) as owner, 1000 + event_id as received_ms, cast(1 + event_id % 9 as int) as page from events")
def owner_keys(spark, d):
    """owners' keys, and the parts of page ids."""
    e = fixture(spark, d, "select event_id, ' User' || user_id || '@Example.org ' as email, lower(lpad(hex(1000 + event_id), 12, '0')) || lower(lpad(hex(1 + event_id % 9), 4, '0')) || 'ffff' as page_id from events")
    return e.select("event_id", text.owner_key("email").alias("owner"), F.inline(F.array(text.page_id_parts("page_id"))))


LISTED = """select cast(event_id as string) as id, case when event_id % 7 = 0 then '[done] ' else '' end || 'scan' || event_id as name,
  case event_type when 'view' then 'image/png' when 'click' then 'application/pdf' else 'text/plain' end as mime_type, event_id % 5 as size, cast(ts as string) as created_time from events"""


@query(f"select id, name from ({LISTED}) where mime_type in ('image/png', 'application/pdf') and size > 0 and name not like '[%'")
def list_new_pages(spark, d):
    """S4."""
    return sources.list_new_pages(fixture(spark, d, LISTED)).select("id", "name")


@query("select owner, folder_id from (select lower('User' || user_id) as owner, cast(event_id as string) as folder_id, row_number() over (partition by user_id order by event_id desc) as k from events) where k = 1")
def latest_inbox(spark, d):
    """S5."""
    e = fixture(spark, d, "select cast(event_id as string) as id, 'User' || user_id as email, event_id as shared_with_me_time from events")
    return sources.latest_inbox_per_owner(e.withColumn("owners", F.array(F.struct(F.col("email").alias("emailAddress")))))


@query("select event_id, row_number() over (partition by user_id order by floor((event_id % 97) * 3.0 / 40.0), event_id % 89, event_id) as position from events")
def reading_order(spark, d):
    """Events as boxes of a user's page."""
    e = fixture(spark, d, "select event_id, user_id as page_id, (event_id % 97) * 3.0 as mid_y, (event_id % 89) + event_id / 1e9 as min_x from events")
    return features.reading_order(e).select("event_id", "position")


@query("select doc_id, contains(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), 'andthe') or contains(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), 'undder') as declaration from documents".replace("\\\\", "\\"))
def declarations(spark, d):
    """phrases in texts without their white space."""
    return fixture(spark, d, "select doc_id, text from documents").select("doc_id", features.text_is_declaration(F.col("text"), ("andthe", "undder")).alias("declaration"))


RECORDS = "select owner, code, status = 'ready' as uploaded, case when owner % 2 = 0 then 1 end as log_id, owner % 3 <> 0 as log_has_link, timestamp '2024-01-10 00:00:00' - (owner % 10) * interval '1' day as confirmed_at from stated"


@query(f"with {JUDGED} select owner, code, case when done then 'uploaded' else 'confirmed' end as status from (select *, uploaded and log_id is not null and log_has_link as done from ({RECORDS})) where not done or confirmed_at > timestamp '2024-01-10 00:00:00' - interval '72 hours'")
def confirmed_documents(spark, d):
    """Documents as records, as of a fixed time."""
    ready = documents.judge(documents.assemble(coded(spark, d)))
    owner, now = F.col("owner"), F.expr("timestamp_ntz'2024-01-10 00:00:00'")
    records = ready.select("owner", "code", (F.col("status") == "ready").alias("uploaded"), F.when(owner % 2 == 0, 1).alias("log_id"), (owner % 3 != 0).alias("log_has_link"), (now - F.make_dt_interval(days=(owner % 10).cast("int"))).alias("confirmed_at"))
    return documents.confirmed_documents(records, now).select("owner", "code", "status")


def shown_parts(spark, d):
    """Documents with the pages a person was shown: for every fifth owner one page too few."""
    judged = documents.judge(documents.assemble(coded(spark, d)))
    pages = F.transform("parts", lambda p: p["page_id"])
    return judged, judged.select("owner", "code", F.when(F.col("owner") % 5 == 0, F.slice(pages, 2, F.size(pages))).otherwise(F.reverse(pages)).alias("page_ids"))


@query(f"with {JUDGED} select owner, code from stated where owner % 5 <> 0")
def same_parts(spark, d):
    """G5."""
    judged, shown = shown_parts(spark, d)
    return documents.same_parts(shown, judged).select("owner", "code")


@query(f"with {JUDGED} select owner, code, status, student from stated union all select owner, code, 'confirmed', null from stated where owner % 4 = 0")
def all_documents(spark, d):
    """X1."""
    judged = documents.judge(documents.assemble(coded(spark, d)))
    done = judged.where("owner % 4 = 0").select("owner", "code", F.lit("confirmed").alias("status"))
    return documents.all_documents(judged, done).select("owner", "code", "status", "student")


TYPED = "typed as (select s.*, p.person, case when owner % 7 = 1 then 'no id' else upper(trim(p.student_id)) end as said, p.school_name as at_school from stated s join fx_roster p on p.person = s.owner % (select count(*) from customer))"


@query(f"""with {JUDGED}, {TYPED}, outcomes as (select *, case when status = 'waiting' then 'waiting' when owner % 5 = 0 then 'changed' when said = 'no id' then 'not_an_id' when owner % 11 = 3 then 'not_found' else 'confirmed' end as outcome from typed)
  select owner, code, outcome, case when said = 'no id' then '' else said end as confirmed_student_id, case when outcome = 'confirmed' then (select min_by(r.person, (upper(trim(r.school_name)), r.student_name, r.person)) from fx_roster r where upper(trim(r.student_id)) = said and upper(trim(r.school_name)) = upper(trim(at_school))) end as person, case when outcome = 'confirmed' then 'exact' end as matched_via from outcomes""")
def confirm_documents(spark, d):
    """Every open document with a person's identifier; every eleventh owner's documents are of a school that has nobody."""
    judged, shown = shown_parts(spark, d)
    roster = fixture(spark, d, "fx_roster")
    people = fixture(spark, d, "select person, student_id as said, school_name as at_school from fx_roster")
    n = fixture(spark, d, "select count(*) as n from customer").first().n
    named = judged.select("owner", "code").withColumn("person", F.col("owner") % n).join(people, "person").drop("person")
    typed = shown.join(named, ["owner", "code"]).withColumn("student_id", F.when(F.col("owner") % 7 == 1, "no id").otherwise(F.col("said")))
    where = F.when(F.col("owner") % 11 == 3, "NOWHERE").otherwise(F.col("at_school"))
    placed = judged.join(named, ["owner", "code"]).withColumn("parts", F.transform("parts", lambda p: p.withField("school", where).withField("location", F.lit("")))).drop("said", "at_school")
    locations = lookup.school_location(roster, fixture(spark, d, "fx_employees"))
    return documents.confirm_documents(typed.select("owner", "code", "student_id", "page_ids"), placed, roster, locations).select("owner", "code", "outcome", "confirmed_student_id", "person", "matched_via")


ASKED = f"""numbered as (select * exclude (token, raw), {AS_ID} as reading from (select t.file_id, t.batch_id, t.batch_school, t.tail_batch_id, t.tail_school, r.reading as raw, {q_clean('r.reading')} as token from tailed t join fx_readings r on r.reading_id = t.file_id)),
tried as (select reading, batch_school as scan_school, null::varchar as scan_location from numbered union all select reading, tail_school, null from numbered where tail_batch_id is not null)"""
AT = "l.token = a.reading and l.location = '' and l.school = coalesce(upper(trim({})), '')"


@query(f"""with {TAILED}, {ASKED}, {q_ladder('reading', 'tried')}
  select file_id, batch_id, case when h.via is null and l.via is not null then tail_batch_id else batch_id end as logged_under, coalesce(h.person, l.person) as person, coalesce(h.via, l.via) as matched_via
  from numbered a left join ladder h on {AT.format('batch_school').replace('l.', 'h.')} left join ladder l on tail_batch_id is not null and h.via is null and {AT.format('tail_school')}""")
def find_with_tail(spark, d):
    """Files with the reading of their number, at their batch's school and then at the tail's."""
    files, b = scene(spark, d)
    placed = attribution.with_tail(attribution.attribute(files, b), b)
    asked = placed.join(fixture(spark, d, "select reading_id as file_id, reading from fx_readings"), "file_id")
    roster = fixture(spark, d, "fx_roster")
    return lookup.find_with_tail(asked, roster, lookup.school_location(roster, fixture(spark, d, "fx_employees"))).select("file_id", "batch_id", "logged_under", "person", "matched_via")


LINES = "select event_id, case event_id % 9 when 0 then 'Student ID :' when 1 then 'STUDENT card no / ID' when 2 then 'विद्यार्थी आयडी' when 3 then 'छात्र आईडी' when 4 then 'Vidyarthi ka ID' when 5 then 'Student ID information' when 6 then 'Class and division' when 7 then 'विद्यार्थी आईडी' else 'name ' || event_id end as line from events"


@query("""select event_id, case when event_id % 9 in (0, 1) then 'english' when event_id % 9 = 2 then 'marathi' when event_id % 9 in (3, 4, 7) then 'hindi' end as language,
  case when event_id % 9 in (0, 2, 7) then 3.0 when event_id % 9 = 1 then 2.5 when event_id % 9 in (3, 4) then 2.0 else 0.0 end::double as score, event_id % 9 = 6 as grade from events""")
def label_scores(spark, d):
    """Printed labels in three languages."""
    lines = fixture(spark, d, LINES)
    return lines.select("event_id", F.inline(F.array(text.label_score("line"))), text.is_grade_label("line").alias("grade")).withColumn("score", F.col("score").cast("double"))


@query(f"""with {BATCHES}, {PLACED}, l as (select file_id as i, arg_max(b.closed_at, (b.opened_at, b.batch_id)) as c from f join b on b.folder_id = f.folder_id and b.opened_at <= f.created group by 1)
  select file_id, folder_id, created, case when created - c < interval '2 minutes' then 'grace' when created - c < interval '6 hours' then 'leftover' else 'late' end as late from placed join l on i = file_id where place = 'set_aside'""")
def late_pages(spark, d):
    """Z9 in batch."""
    return attribution.late_pages(*scene(spark, d))


def ruled(spark, d):
    e = fixture(spark, d, "select vec_id, embedding from embeddings")
    ladder = F.element_at(F.array(*(F.array(*map(F.lit, rows)) for rows in layout.LADDERS.values())), (F.col("vec_id") % 3 + 1).cast("int"))

    def rule(y, k):
        shake = F.element_at("embedding", k + 1).cast("double")
        at = y * (1 + F.element_at("embedding", 60) / 10) + F.element_at("embedding", 61) / 10 + shake * 0.01
        return F.struct(F.when(F.col("vec_id") % 4 == 0, 1 - at).otherwise(at).cast("double").alias("y"), (0.2 + shake / 50).alias("x0"), (0.6 + shake / 50).alias("x1"))

    pages = e.select("vec_id", features.merge_rules(F.transform(ladder, rule)).alias("rules"))
    return pages.withColumn("heights", F.col("rules.y"))


@query()
def identify_form(spark, d):
    """the form of each page and its value box."""
    found = layout.identify_form(ruled(spark, d), "heights")
    return found.select("vec_id", "fit.language", "fit.runner_up", *(F.round(f"fit.{c}", 6).alias(c) for c in ("error", "scale", "offset", "confidence")), F.transform(F.array(*(layout.id_box(F.col("rules"), F.col("fit"))[k] for k in ("x0", "y0", "x1", "y1"))), lambda v: F.round(v, 6)).cast("string").alias("box"))


@query()
def orientation(spark, d):
    """F6."""
    return layout.orientation(ruled(spark, d), "heights").select("vec_id", "turn")


@query()
def match_profile(spark, d):
    """each page's profile against the mean profiles of the ten labels, which stand for the blank forms' pages."""
    pages = fixture(spark, d, "select vec_id, label, transform(embedding, x -> abs(cast(x as double))) as profile from embeddings")
    means = pages.select("label", F.posexplode("profile").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("profile"))
    templates = {f"form{r.label // 2}:{1 + r.label % 2}": r.profile for r in means.collect()}
    return layout.match_profile(pages, "profile", templates).select("vec_id", "match.best_page", *(F.round(f"match.{c}", 6).alias(c) for c in ("best_score", "first_score", "later_score")))


OCR_LINES = """select e.event_id div 6 as page_id, e.event_id as position, (e.event_id % 10) / 10.0D as confidence, e.y as y_mid, 20.0D as height, e.x as x_min, e.x + 100.0D as x_max,
  case e.event_id % 11 when 0 then 'Student ID :' when 1 then 'Name ' || r.reading when 2 then r.reading when 3 then 'Grade 5' when 4 then 'Student ID: ' || r.reading when 5 then r.reading when 6 then 'Student ID information' when 7 then 'Student no / ID' when 8 then 'School: ' || r.reading else 'words ' || e.event_id end as text
  from (select event_id, cast(event_id * 37 % 200 as double) as y, cast(event_id * 53 % 300 as double) as x from events) e join fx_readings r on r.reading_id = e.event_id"""


@query()
def best_label(spark, d):
    """the identifier field's label on each page, and what is written beside it."""
    return layout.best_label(fixture(spark, d, OCR_LINES))


READ = "select reading_id div 5 as page_id, reading_id as position, array('label', 'vision', 'vision_line', 'rapid', 'easy')[cast(reading_id % 5 as int)] as reader, reading as text, (reading_id % 9) / 10.0D as confidence, array('english', 'hindi', 'marathi')[cast(reading_id % 3 as int)] as language from fx_readings"


FROM_LINE = """case when l <> '' then l when text like '%:%' then case when length(a) between 6 and 20 and regexp_matches(a, '[A-Z]') and regexp_matches(a, '[0-9]') then a else '' end
  when length(o) between 8 and 20 and regexp_matches(o, '[A-Z]') and regexp_matches(o, '[0-9]') and o not like '%STUDENT%' and o not like '%INFORMATION%' then o else '' end"""
SCORED = f"""said as (select *, {q_clean("regexp_extract(text, '(?i)student[ ]*id[ ]*:?[ ]*([A-Za-z0-9][A-Za-z0-9_/ -]{{3,20}})', 1)")} as l, {q_clean("split_part(text, ':', -1)")} as a, {q_clean('text')} as o
  from (select cast(floor(reading_id / 5) as bigint) as page_id, reading_id as position, list_value('label', 'vision', 'vision_line', 'rapid', 'easy')[reading_id % 5 + 1] as reader, reading as text, (reading_id % 9) / 10.0::double as confidence,
    list_value('english', 'hindi', 'marathi')[reading_id % 3 + 1] as language from fx_readings)),
token as (select *, case when reader = 'rapid' and {FROM_LINE} <> '' then {FROM_LINE} else o end as token, confidence * case when reader = 'vision_line' then 0.95 else 1.0 end as conf from said),
kind as (select *, case when {STRICT} then 'strict' when length(token) between 8 and 20 and regexp_matches(token, '^[A-Z]{{4}}') and regexp_matches(token, '[0-9]') then 'noisy' when {q_tail('token')} and regexp_matches(token, '[A-Z]') and reader like 'vision%' then 'noisy' end as kind from token),
score as (select *, case when reader = 'label' then case kind when 'strict' then 0.92 when 'noisy' then 0.55 end when reader like 'vision%' then case kind when 'strict' then least(conf + 0.15, 0.99) when 'noisy' then least(conf + 0.15, 0.70) end
  else case kind when 'strict' then conf + 0.05 when 'noisy' then least(conf, 0.65) end end as score, case when reader = 'vision_line' then 'vision' else reader end as family from kind),
scored as (select page_id, position, family as reader, token as text, score, family || case when kind = 'strict' then '' else '-noisy' end as tag, language from (select *, row_number() over (partition by page_id, family, token order by position) as k from score where score is not null) where k = 1)"""


@query(f"with {SCORED} select page_id, position, reader, text, round(score, 6) as score, tag from scored")
def score_readings(spark, d):
    """Every reader's readings as scored candidates."""
    return layout.score_readings(fixture(spark, d, READ)).select("page_id", "position", "reader", "text", F.round("score", 6).alias("score"), "tag")


@query(f"""with {SCORED}, kept as (select * from scored where reader <> 'easy'),
shaped as (select distinct page_id from (select page_id, {AS_ID} as sid from (select page_id, text as token from kept)) where sid <> ''),
rest as (select s.*, case when language = list_value('english', 'hindi', 'marathi')[page_id % 3 + 1] then 0 else list_position(list_value('english', 'hindi', 'marathi'), language) end as r from scored s where reader = 'easy' and page_id not in (select page_id from shaped))
select page_id, row_number() over (partition by page_id order by r, position, text) as position, language, text, stage
  from (select page_id, position, language, text, -1 as r, 'found' as stage from kept union all select page_id, position, language, text, r, 'template' from rest)""")
def with_fallback(spark, d):
    """The candidates of a page, or those of the blank forms' boxes."""
    scored = layout.score_readings(fixture(spark, d, READ))
    preferred = fixture(spark, d, "select distinct reading_id div 5 as page_id, array('english', 'hindi', 'marathi')[cast(reading_id div 5 % 3 as int)] as language from fx_readings")
    return layout.with_fallback(scored.where("reader <> 'easy'"), scored.where("reader = 'easy'"), preferred).select("page_id", "position", "language", "text", "stage")
