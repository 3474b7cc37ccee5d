"""Queries of reports and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from intake.operators import changes, lookup, reports
from intake.plans.fixtures import fixture
from intake.plans.fixtures import with_fixtures
from intake.plans.lookups import LOCATIONS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CUTOFF = "timestamp '1995-06-01 00:00:00'"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return add


def parts(spark, d):
    roster = fixture(spark, d, "fx_roster")
    return roster, fixture(spark, d, "fx_scan_log"), lookup.school_location(roster, fixture(spark, d, "fx_employees"))


def cutoff():
    return F.expr(CUTOFF).cast("timestamp_ntz")


@query(f"with {LOCATIONS} select location, school, count(*) as total, count(scanned_at) as scanned from fx_roster join loc on school = upper(trim(school_name)) group by rollup(location, school)")
def school_progress(spark, d):
    """A1."""
    roster, _, loc = parts(spark, d)
    return reports.school_progress(roster, loc)


@query("select distinct trim(school_name) as school_name from fx_roster where trim(school_name) <> ''")
def list_schools(spark, d):
    """A2."""
    return reports.list_schools(fixture(spark, d, "fx_roster"))


@query(f"with {LOCATIONS} select * from loc")
def school_location(spark, d):
    """A3."""
    return parts(spark, d)[2]


NEWEST = "newest as (select * from (select *, row_number() over (partition by matched_student_id order by id desc) as k from fx_scan_log where found_in_db and matched_student_id is not null) where k = 1)"
SCANNED = "scanned as (select r.*, n.id as log_id, n.matched_via, n.confirmed_student_id, n.reviewed_at from fx_roster r left join newest n on upper(trim(n.matched_student_id)) = upper(trim(r.student_id)) where r.scanned_at is not null)"


@query(f"with {NEWEST} select matched_student_id, id, matched_via, confirmed_student_id from newest")
def latest_found_log(spark, d):
    """W1."""
    return reports.latest_found(fixture(spark, d, "fx_scan_log")).select("matched_student_id", "id", "matched_via", "confirmed_student_id")


@query(f"with {LOCATIONS}, {NEWEST}, {SCANNED} select person, student_id, student_name, school_name, scanned_at, log_id, matched_via, reviewed_at from scanned where upper(trim(school_name)) in (select school from loc where location = 'ASIA')")
def scanned_students(spark, d):
    """The scanned people of one city."""
    roster, log, loc = parts(spark, d)
    return reports.scanned_students(roster, log, loc, location="ASIA").select("person", "student_id", "student_name", "school_name", "scanned_at", "log_id", "matched_via", "reviewed_at")


@query(f"with {NEWEST}, {SCANNED} select person, student_id, scanned_at from scanned where upper(student_id) like '%A%1%' or upper(student_name) like '%A%1%' order by scanned_at desc, student_id, school_name, person limit 20 offset 20")
def scanned_page(spark, d):
    """The second page of a search."""
    roster, log, loc = parts(spark, d)
    return reports.page_of(reports.scanned_students(roster, log, loc, search="a%1"), 20, 1).select("person", "student_id", "scanned_at")


@query("select id, created_at, confirmed_student_id, coalesce(scan_school, school_name) as school, source from fx_scan_log where not found_in_db and upper(trim(coalesce(scan_school, school_name, ''))) = 'NATION_3'")
def not_found_attempts(spark, d):
    """R2."""
    _, log, loc = parts(spark, d)
    return reports.not_found_attempts(log, loc, school="NATION_3")


PENDING = "pending as (select student_id, school_name, log_id, matched_via from scanned where log_id is not null and coalesce(matched_via, '') not in ('exact', 'shape_fix') and reviewed_at is null)"


@query(f"with {NEWEST}, {SCANNED}, {PENDING} select * from pending")
def pending_review(spark, d):
    """A4."""
    return reports.pending_review(*parts(spark, d))


@query(f"with {NEWEST}, {SCANNED}, {PENDING} select coalesce(sum(n), 0) as n, substr(sha256(coalesce(string_agg(part, chr(10) order by range), '')), 1, 32) as token from (select substr(sha256(line), 1, 4) as range, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as part from (select distinct upper(trim(student_id)) || ':' || log_id as line from pending) group by 1)")
def review_token(spark, d):
    """A5."""
    return reports.review_token(reports.pending_review(*parts(spark, d)))


@query("select id, case when not found_in_db then 'none' when matched_via in ('exact', 'shape_fix') then 'read exactly' when reviewed_at is not null then 'checked' else 'recheck needed' end as flag from fx_scan_log")
def review_flags(spark, d):
    """T21."""
    return reports.review_flags(fixture(spark, d, "fx_scan_log"))


@query("select upper(trim(student_id)) as student_id, count(distinct upper(trim(school_name))) as schools, count(*) as holders from fx_roster group by 1 having count(distinct upper(trim(school_name))) > 1")
def shared_ids(spark, d):
    """J15."""
    return reports.shared_ids(fixture(spark, d, "fx_roster"))


@query("select 'U' || user_id || '@example.org ' as email, event_id from events where event_type = 'signup' and user_id in (select cast(replace(replace(work_email, 'u', ''), '@example.org', '') as bigint) from fx_employees where school_acronym in ('NATION_1', 'NATION_2') or designation = 'School Administration')")
def authorized_staff(spark, d):
    """J14."""
    staff = fixture(spark, d, "fx_employees")
    sign_ins = fixture(spark, d, "select 'U' || user_id || '@example.org ' as email, event_id from events where event_type = 'signup'")
    return reports.authorized_staff(sign_ins, staff, ["NATION_1", "NATION_2"], ["School Administration"])


@query("select id, confirmed_student_id, found_in_db from fx_scan_log where source = 'drive:7' and id > 1000")
def batch_results(spark, d):
    """R3."""
    return reports.batch_results(fixture(spark, d, "fx_scan_log"), 7, 1000).select("id", "confirmed_student_id", "found_in_db")


@query(f"select c as column_name, count(*) filter (t < {CUTOFF}) as moved, min(t) filter (t >= {CUTOFF}) as first_kept, max(t) filter (t < {CUTOFF}) as newest from (select 'created_at' as c, created_at as t from fx_scan_log union all select 'reviewed_at', reviewed_at from fx_scan_log) where t is not null group by 1")
def shift_preview(spark, d):
    """R5."""
    shown = reports.shift_preview(fixture(spark, d, "fx_scan_log"), ["created_at", "reviewed_at"], cutoff())
    return shown.select("column_name", "moved", "first_kept", F.element_at("newest", -1).alias("newest"))


@query("select r.person, r.student_id, r.school_name, coalesce(m.at, r.scanned_at) as scanned_at from fx_roster r left join (select matched_student_id, upper(trim(school_name)) as s, max(created_at) as at from fx_scan_log where found_in_db and id % 7 = 0 group by 1, 2) m on m.matched_student_id = r.student_id and m.s = upper(trim(r.school_name))")
def mark_scanned(spark, d):
    """U1."""
    log = fixture(spark, d, "fx_scan_log").where("found_in_db and id % 7 = 0")
    matches = log.select(F.col("matched_student_id").alias("student_id"), "school_name", F.col("created_at").alias("scanned_at"))
    return changes.mark_scanned(fixture(spark, d, "fx_roster"), matches).select("person", "student_id", "school_name", "scanned_at")


@query("select id, found_in_db or id % 5 = 0 as found_in_db, confirmed_student_id, case when not found_in_db and id % 5 = 0 then 'FIXED' || id else matched_student_id end as matched_student_id, case when not found_in_db and id % 5 = 0 then 'recheck' else matched_via end as matched_via from fx_scan_log")
def resolve_attempts(spark, d):
    """U2."""
    log = fixture(spark, d, "fx_scan_log")
    fixed = log.where("id % 5 = 0").select("id", F.concat(F.lit("FIXED"), F.col("id").cast("string")).alias("matched_student_id"), F.lit("S").alias("school_name"), F.lit("recheck").alias("matched_via"))
    return changes.resolve_attempts(log, fixed).select("id", "found_in_db", "confirmed_student_id", "matched_student_id", "matched_via")


@query(f"with {LOCATIONS}, {NEWEST}, {SCANNED}, {PENDING}, listed as (select * from pending where upper(trim(school_name)) in (select school from loc where location = 'ASIA')) select l.id, case when l.found_in_db and l.reviewed_at is null and l.id <= (select max(log_id) from listed) and upper(trim(l.matched_student_id)) in (select upper(trim(student_id)) from listed) then {CUTOFF} else l.reviewed_at end as reviewed_at from fx_scan_log l")
def mark_all_reviewed(spark, d):
    """Sign-off of everyone pending in a city, as the person was shown them."""
    roster, log, loc = parts(spark, d)
    pending = reports.pending_review(roster, log, loc, location="ASIA")
    seen = reports.review_token(pending).first()
    return changes.mark_all_reviewed(log, pending, reports.review_token(pending), seen.n, seen.token, True, cutoff()).select("id", "reviewed_at")


@query("select id, found_in_db from fx_scan_log where found_in_db or id % 3 <> 0")
def delete_not_found(spark, d):
    """Ids are listed of which some are found rows."""
    log = fixture(spark, d, "fx_scan_log")
    return changes.delete_not_found(log, log.where("id % 3 = 0").select("id")).select("id", "found_in_db")


@query("select id, case when id % 4 = 0 then 'https://files.example.org/' || id end as link from fx_scan_log")
def attach_links(spark, d):
    """U6."""
    log = fixture(spark, d, "fx_scan_log")
    return changes.attach_links(log, log.where("id % 4 = 0").select("id", F.concat(F.lit("https://files.example.org/"), F.col("id").cast("string")).alias("link"))).select("id", "link")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) where k = 1")
def upsert_files(spark, d):
    """The last state of every key from a base and its changes."""
    e = fixture(spark, d, "select user_id, event_id, event_type from events")
    return changes.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@query(f"select id, case when created_at < {CUTOFF} and id % 11 <> 0 then created_at + interval '5 hours 30 minutes' else created_at end as created_at, case when reviewed_at < {CUTOFF} and id % 11 <> 0 then reviewed_at + interval '5 hours 30 minutes' else reviewed_at end as reviewed_at, true as times_shifted from fx_scan_log")
def shift_times(spark, d):
    """U8."""
    log = fixture(spark, d, "fx_scan_log").select("id", "created_at", "reviewed_at")
    return changes.shift_times(log, ["created_at", "reviewed_at"], cutoff(), log.where("id % 11 = 0"))


@query("select id, coalesce(case when id % 2 = 0 then 'new' || id end, case when id % 3 = 0 then 'old' || id end) as link from fx_scan_log")
def merge_link_columns(spark, d):
    """U9."""
    t = fixture(spark, d, "fx_scan_log").selectExpr("id", "case when id % 2 = 0 then 'new' || id end as link", "case when id % 3 = 0 then 'old' || id end as image_link")
    return changes.merge_links(t, "image_link", "link")


@query(f"with {NEWEST} select l.id, upper(trim(l.confirmed_student_id)) as corrected, case when l.found_in_db then 'gone' when h.id is null then 'no_match' when h.here then 'resolved' when s.student_id is not null then 'shared_id' else 'not_exact_without_scope' end as outcome from fx_scan_log l left join (select upper(trim(student_id)) as id, bool_or(false) as x, list(upper(trim(school_name))) as schools, false as here from fx_roster group by 1) g on g.id = upper(trim(l.confirmed_student_id)) left join (select l2.id as log_id, min(upper(trim(r.student_id))) as id, bool_or(upper(trim(r.school_name)) = l2.scan_school or l2.scan_school is null) as here from fx_scan_log l2 join fx_roster r on upper(trim(r.student_id)) = upper(trim(l2.confirmed_student_id)) group by 1) h on h.log_id = l.id left join (select upper(trim(student_id)) as student_id from fx_roster group by 1 having count(distinct upper(trim(school_name))) > 1) s on s.student_id = h.id")
def recheck(spark, d):
    """J16."""
    roster, log, _ = parts(spark, d)
    asked = log.select("id", F.upper(F.trim("confirmed_student_id")).alias("corrected"), "scan_school")
    people = roster.select(F.upper(F.trim("student_id")).alias("student_id"), lookup.school_key("school_name").alias("_s"))
    exact = asked.join(people, F.col("corrected") == F.col("student_id")).groupBy("id").agg(F.min("student_id").alias("student_id"), F.bool_or((F.col("_s") == F.col("scan_school")) | F.col("scan_school").isNull()).alias("in_scope"))
    return changes.recheck(asked.select("id", "corrected"), log, exact, reports.shared_ids(roster))


@query("select * from (select id, confirmed_student_id from fx_scan_log union all select (select max(id) from fx_scan_log) + row_number() over (order by reading_id), reading from fx_readings)")
def append_scan_log(spark, d):
    """S6."""
    attempts = fixture(spark, d, "fx_readings").select("reading_id", F.col("reading").alias("confirmed_student_id"))
    return changes.append_log(fixture(spark, d, "fx_scan_log"), attempts, cutoff()).select("id", "confirmed_student_id")
