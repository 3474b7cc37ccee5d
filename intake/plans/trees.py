"""Queries of names, paths and writers: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from intake.functions import text
from intake.operators import documents
from intake.plans.fixtures import fixture, with_fixtures
from intake.shared import shared_dir
from intake.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return add


NAMED = "select event_id as file_id, user_id % 5 as folder, case event_id % 7 when 0 then 'Form (2).pdf' when 1 then 'Form (4).pdf' when 2 then 'Scan' when 3 then 'Scan (3)' else 'Form.pdf' end as name from events"
TAKEN = "select user_id % 5 as folder, case when user_id % 2 = 0 then 'Form.pdf' else 'Form (3).pdf' end as name from events where user_id % 5 < 2 group by 1, 2"


@query(f"""with f as ({NAMED}), t as ({TAKEN}), held as (select folder, name from f union select folder, name from t),
r as (select f.*, row_number() over (partition by f.folder, f.name order by file_id) - case when t.name is null then 1 else 0 end as r, regexp_extract(f.name, '^(.*?)(\\.[^.]*)?$', 1) as stem, regexp_extract(f.name, '^(.*?)(\\.[^.]*)?$', 2) as ext from f left join t on t.folder = f.folder and t.name = f.name),
m as (select folder, name, stem, ext, max(r) as most from r group by all),
n as (select folder, name, 2 + unnest(range(most + 20)) as n, stem, ext from m),
free as (select n.folder, n.name, n, row_number() over (partition by n.folder, n.name order by n) as r from n left join held h on h.folder = n.folder and h.name = stem || ' (' || n || ')' || ext where h.name is null)
select file_id, r.folder, case when r.r = 0 then r.name else stem || ' (' || n || ')' || ext end as free_name from r left join free on free.folder = r.folder and free.name = r.name and free.r = r.r""".replace("\\\\", "\\"))
def free_names_mixed(spark, d):
    """Several names in a folder, some taken, some given with a number."""
    return documents.free_names(fixture(spark, d, NAMED), fixture(spark, d, TAKEN)).select("file_id", "folder", "free_name")


PEOPLE = """select person, school_name, grade_name, case when person % 9 = 0 then '' else division_name end as division_name, trim(student_id) as student_id,
  case person % 6 when 0 then 'José ' || student_name when 1 then student_name || ' / क़लम' when 2 then ' a​b  ' || student_name || '. .' when 3 then '' when 4 then 'x*?' || student_name || '­' else student_name end as student_name,
  case person % 4 when 0 then 'B0-' || (person % 30) else 'B' || (1 + person % 7) || '-' || (1 + person % 90) end as code from fx_roster"""


def q_safe_name(x: str, fallback: str = "Unknown") -> str:
    shown = f"regexp_replace(nfc_normalize(coalesce({x}, '')), '\\p{{C}}', '', 'g')"
    one_line = f"trim(regexp_replace(regexp_replace({shown}, '[\\\\/:*?\"<>|]+', '-', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"
    return f"coalesce(nullif(rtrim(left(rtrim({one_line}, '. '), 120), '. '), ''), '{fallback}')"


PERSON = q_safe_name(f"{q_safe_name('student_name', 'Unnamed')} || '_' || student_id", "Unnamed")
LEAF = f"case when code like 'B0-%' then {PERSON} else {q_safe_name(PERSON + chr(32) + '|| chr(95) || code')} end"
PLACED = f"select person, {q_safe_name('school_name', 'Unknown school')} as school, {q_safe_name('grade_name', 'Unknown grade')} as grade, {q_safe_name('division_name', 'Unknown division')} as division, {PERSON} as who, {LEAF} as leaf from (select * from people)"


def q_paths(code: str = "code") -> str:
    return f"with people as ({PEOPLE}), placed as ({PLACED}) select person, school, grade, division, 'OCR/' || school || '/' || grade || '/' || division || '/' || who || '/' || leaf || '.pdf' as path from placed"


@query(q_paths())
def document_paths(spark, d):
    """Names of all kinds as paths."""
    return files.document_tree(fixture(spark, d, PEOPLE)).select("person", "school", "grade", "division", "path")


@query(q_paths())
def written_documents(spark, d):
    """The tree after three calls: half of the people, all in another school, and all as they are."""
    people, folder = fixture(spark, d, PEOPLE), f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    for rows in (people.where("person % 2 = 0"), people.withColumn("school_name", F.lit("Elsewhere")), people):
        files.write_document_tree(rows, folder, "person")
    return spark.read.schema(files.document_tree(people).schema).parquet(folder).select("person", "school", "grade", "division", "path")


SENT = "select event_id as file_id, user_id as owner, case when event_id % 11 <> 0 then 'B' || (1 + event_id % 6) || '-' || (1 + event_id % 40) end as code, case event_type when 'click' then 'typed' when 'error' then 'none' else 'read' end as code_source from events"
JUDGED = f"select owner, code, case when count(*) > 3 then 'ready' else 'needs_attention' end as status from ({SENT}) s where code is not null group by 1, 2"


@query(f"with s as ({SENT}), j as ({JUDGED}) select file_id, split_part(s.code, '-', 1) as folder from s left join j using (owner, code) where s.code is not null and (code_source = 'typed' or status = 'ready')")
def sorted_files(spark, d):
    """Files by batch after a wrong code of every third was corrected."""
    sent, judged, folder = fixture(spark, d, SENT), fixture(spark, d, JUDGED), f"{shared_dir(spark)}/sorted-{uuid.uuid4().hex}"
    wrong = sent.withColumns({"code": F.when(F.col("code").isNotNull(), F.lit("B99-1")), "code_source": F.lit("typed")}).where("file_id % 3 = 0 and code_source = 'typed'")
    settled = files.settled_files(sent, judged).select("file_id")
    files.write_by_batch(wrong.join(settled, "file_id", "left_semi"), judged, folder)
    files.write_by_batch(sent, judged, folder)
    return spark.read.schema("file_id long, folder string").parquet(folder)


LINES = """select reading_id, case reading_id % 7 when 0 then 'Student ID: ' || reading when 1 then 'student id ' || reading when 2 then 'x:' || reading when 3 then reading when 4 then 'STUDENT' || reading
  when 5 then 'STUDENT  ID:' || substr(reading, 1, 3) || ' ' || substr(reading, 4) else 'no:' end as line from fx_readings"""


@query(f"""with l as (select reading_id, line, regexp_extract(line, '(?i)student\\s*id\\s*:?\\s*([A-Za-z0-9][A-Za-z0-9_/\\s-]{{3,20}})', 1) as lab from ({LINES})),
c as (select *, upper(regexp_replace(lab, '[^A-Za-z0-9]', '', 'g')) as l, upper(regexp_replace(split_part(line, ':', -1), '[^A-Za-z0-9]', '', 'g')) as a, upper(regexp_replace(line, '[^A-Za-z0-9]', '', 'g')) as o from l)
select reading_id, case when l <> '' then l when line like '%:%' then case when length(a) between 6 and 20 and regexp_matches(a, '[A-Z]') and regexp_matches(a, '[0-9]') then a else '' end
  when length(o) between 8 and 20 and regexp_matches(o, '[A-Z]') and regexp_matches(o, '[0-9]') and o not like '%STUDENT%' and o not like '%INFORMATION%' then o else '' end as student_id from c""")
def id_lines(spark, d):
    """Identifiers in lines of a form."""
    return fixture(spark, d, LINES).select("reading_id", text.id_from_line("line").alias("student_id"))
