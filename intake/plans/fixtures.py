"""Representative inputs derived from the driver's tables, as SQL that Spark and DuckDB run alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

FIXTURES = {
    "fx_roster": """
with k as (select c_custkey, c_name, c_nationkey, c_mktsegment,
    case when c_custkey % 97 = 0 and c_custkey > 0 then c_custkey - 1 else c_custkey end as b
  from customer),
s as (select o_custkey, max(o_orderdate) as scanned_at from orders where o_orderstatus = 'F' and o_orderkey % 4 = 0 group by o_custkey)
select k.c_custkey as person,
  case when k.c_custkey % 50 = 0 then ' ' else '' end
    || translate(substr(md5(cast(b as string)), 1, 6), '0123456789abcdef', 'AEIKLMNOPRSTUDHB')
    || lpad(cast(1 + b % 28 as string), 2, '0') || lpad(cast(1 + b % 12 as string), 2, '0')
    || lpad(cast(10 + b % 12 as string), 2, '0') as student_id,
  c_name as student_name,
  case when k.c_custkey % 10 = 0 then lower(n_name) || ' ' else n_name end as school_name,
  c_mktsegment as grade_name, substr('ABCD', cast(1 + k.c_custkey % 4 as int), 1) as division_name,
  s.scanned_at
from k join nation on c_nationkey = n_nationkey left join s on s.o_custkey = k.c_custkey
""",
    "fx_employees": """
select 'u' || cast(s_suppkey as string) || '@example.org' as work_email, n_name as school_acronym,
  case when s_suppkey % 9 = 0 then 'ELSEWHERE' else r_name end as location,
  case when s_suppkey % 5 = 0 then 'School Administration' else 'Teacher' end as designation
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where n_nationkey <> 24
""",
    "fx_scan_log": """
select cast(o_orderkey + 1 as bigint) as id, o_orderdate as created_at,
  case when o_orderstatus = 'F' and o_orderkey % 25 = 0 then ''
       when o_orderpriority = '1-URGENT' then trim(r.student_id)
       else substr(trim(r.student_id), 1, 11) || 'I' end as confirmed_student_id,
  o_orderstatus <> 'F' as found_in_db,
  case when o_orderstatus <> 'F' then r.student_id end as matched_student_id,
  case when o_orderstatus <> 'F' then r.school_name end as school_name,
  'drive:' || cast(o_orderkey % 20 as string) as source,
  case when o_orderstatus = 'F' then null when o_orderpriority = '1-URGENT' then 'exact'
       when o_orderpriority = '2-HIGH' then 'shape_fix' when o_orderpriority = '3-MEDIUM' then 'constrained_repair'
       when o_orderpriority = '4-NOT SPECIFIED' then 'safe_variant' else 'digit_suffix' end as matched_via,
  case when o_orderkey % 6 = 0 then null else trim(upper(r.school_name)) end as scan_school,
  case when o_orderstatus <> 'F' and o_orderkey % 3 = 0 then o_orderdate + interval '1' day end as reviewed_at
from orders join fx_roster r on r.person = o_custkey
""",
    "fx_readings": """
select e.event_id as reading_id, e.ts, cast(e.event_id % 8 as int) as kind,
  case e.event_id % 8
    when 0 then t when 1 then translate(substr(t, 1, 6), 'OISB', '0158') || substr(t, 7, 6)
    when 2 then substr(t, 1, 6) || translate(substr(t, 7, 6), '0158', 'OISB')
    when 3 then substr(t, 1, 2) || 'X' || substr(t, 4, 9) when 4 then substr(t, 1, 11)
    when 5 then 'X' || substr(t, 2, 2) || 'Q' || substr(t, 5, 8)
    when 6 then lower(substr(t, 1, 6)) || '.' || substr(t, 7, 6)
    else 'RIYA' || lpad(cast(e.event_id as string), 10, '9') end as reading,
  case when e.event_id % 5 <> 0 then trim(upper(r.school_name)) end as scan_school,
  case when e.event_id % 10 = 0 then r.r_name end as scan_location, r.person as true_person
from (select x.*, x.event_id % c.n as p from events x cross join (select count(*) as n from customer) c) e join (
  select person, trim(student_id) as t, fx_roster.school_name, r_name
  from fx_roster join customer on c_custkey = person join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey) r
on r.person = e.p
""",
    "fx_batch_events": """
select event_id, cast(user_id % 5 as int) as folder_id, ts,
  case when event_id % 50 = 0 then 'start' when event_id % 50 = 25 then 'stop' else 'file' end as kind,
  case when event_id % 50 = 0 then 'NATION_' || cast(user_id % 25 as string) end as school
from events
""",
    "fx_pages": """
select lpad(cast(event_id as string), 32, '0') as page_id, user_id as owner, event_id as received_ns, 1 as source_page,
  case when user_id % 3 = 0 then 'BOPEMS' else 'ABMPS' end as school,
  case when event_id % 400 < 200 then 'Pune' else 'Mumbai' end as location,
  case when event_type = 'error' and event_id % 3 = 0 then 'queued' when event_type = 'error' and event_id % 3 = 1 then 'failed' else 'read' end as status,
  case when event_id % 3 = 0 then 'B' || cast(1 + event_id % 4 as string) || '-' || cast(1 + event_id % 20 as string) end as code,
  case when event_type = 'signup' then 'STU' || cast(event_id % 40 as string) else '' end as student_id,
  case when event_type = 'signup' and event_id % 7 <> 0 then 'STU' || cast(event_id % 40 as string) end as matched_student_id,
  case event_type when 'view' then 'declaration' when 'click' then 'continuation' when 'purchase' then 'blank' else '' end as skip_reason
from events
""",
    "fx_corner_texts": """
select event_id, case event_id % 10
    when 0 then 'B' || b || '-' || n when 1 then 'b' || b || ' - ' || n when 2 then '8' || b || '~' || n
    when 3 then 'B' || translate(b, '10', 'IO') || '_' || translate(n, '10', 'l|') when 4 then '3' || b || ' ' || n
    when 5 then 'B' || b || n when 6 then 'B' || b || '-' || n || '-1' when 7 then 'S' || b || '-' || n
    when 8 then 'B' || b || '-' || n || ' 3' else 'B0-' || n end as text
from (select event_id, cast(1 + event_id % 30 as string) as b, cast(1 + event_id % 50 as string) as n from events) q
""",
}


def with_fixtures(sql: str) -> str:
    """``sql`` with the fixtures it names, and those they name, as common table expressions before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in order:
                need(FIXTURES[name])
                order.append(name)

    need(sql)
    ctes = ", ".join(f"{n} as ({FIXTURES[n]})" for n in order)
    if not ctes:
        return sql
    return f"with {ctes}, {sql.strip()[5:]}" if sql.strip().lower().startswith("with ") else f"with {ctes} {sql}"


_READ: dict[tuple[str, str, str], DataFrame] = {}


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """The driver's tables that a query names as views; schemas are read once per application."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _READ:
                _READ[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            _READ[key].createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixtures, or any query over them and the driver's tables."""
    sql = with_fixtures(f"select * from {name}" if re.fullmatch(r"\w+", name) else name)
    views(spark, sf_dir, sql)
    return spark.sql(sql)
