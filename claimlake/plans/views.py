"""Mail, item and vector views over the synthetic tables, as SQL that Spark and DuckDB both run.

The raw tables have no mails: turns of a conversation become mails that quote the turn before
in three styles, and items are derived from them so that every outcome occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMAILS = """
select concat('<c', cast(conv_id as varchar(20)), '.t', cast(turn as varchar(20)), '@corpus>') as message_id,
 conv_id, turn,
 concat(role, '@corpus.example') as from_addr,
 concat('conv-', cast(conv_id % 10 as varchar(20))) as x_origin,
 case when conv_id % 17 = 0 then '' else concat(case when turn % 3 = 1 then 'Re: ' when turn % 3 = 2 then 'FW: RE:  ' else '' end, 'Topic ', cast(conv_id as varchar(20))) end as subject,
 case when turn > 0 then concat('<c', cast(conv_id as varchar(20)), '.t', cast(turn-1 as varchar(20)), '@corpus>') end as in_reply_to,
 case when conv_id % 23 = 0 then cast(null as varchar(40)) else concat('2001-', lpad(cast(1 + conv_id % 12 as varchar(20)),2,'0'), '-', lpad(cast(1 + turn % 28 as varchar(20)),2,'0'), 'T10:00:00') end as date,
 concat(text,
   case when prev_text is null then '' when turn % 3 = 1 then concat(chr(10),chr(10),'-----Original Message-----',chr(10),prev_text)
        when turn % 3 = 2 then concat(chr(10),chr(10),'On day ', cast(turn as varchar(20)), ', ', role, ' wrote:',chr(10),'> ', replace(prev_text,chr(10),concat(chr(10),'> ')))
        else concat(chr(10),'-- ',chr(10),role) end) as body
from (select *, lag(text) over (partition by conv_id order by turn) as prev_text from conversations) q
"""

RELATIONSHIPS = """
select message_id, 0 as idx, concat('P', cast(conv_id % 7 as varchar(20))) as person_a,
 case when (conv_id + turn) % 37 = 0 then '  ' else concat('p', cast((conv_id + turn) % 7 as varchar(20))) end as person_b,
 case (conv_id + turn) % 6 when 0 then 'reports_to' when 1 then 'works_with' when 2 then 'requests_from' when 3 then 'negotiating_with' when 4 then 'informs' else 'friend_of' end as relationship_type,
 case (conv_id * 7 + turn) % 8
  when 0 then substr(body, 3, 60) when 1 then translate(substr(body, 3, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when 2 then replace(substr(body, 3, 50), ' ', concat(chr(10), ' '))
  when 3 then concat('zqx ', substr(body, 3, 40)) when 4 then 'zqx short' when 5 then substr(body, greatest(length(body) - 45, 1), 40)
  when 6 then '' else cast(null as varchar(40)) end as evidence
from emails
"""

_TWO = "cross join (select 0 as idx union all select 1 as idx) n"

PEOPLE = f"""
select message_id, n.idx as idx,
 case when (conv_id + turn + n.idx) % 41 = 0 then ' ' else concat('Person ', cast((conv_id + n.idx) % 50 as varchar(20))) end as name,
 case when (conv_id + turn + n.idx) % 5 = 0 then cast(null as varchar(40)) when (conv_id + turn + n.idx) % 5 = 1 then '' else concat('p', cast((conv_id + n.idx) % 50 as varchar(20)), '@corpus.example') end as email
from emails {_TWO}
"""

ORGANIZATIONS = f"""
select message_id, n.idx as idx,
 case when (conv_id + turn + n.idx) % 41 = 0 then ' ' else concat('Org ', cast((conv_id + turn + n.idx) % 30 as varchar(20))) end as name,
 case (conv_id + turn) % 4 when 0 then cast(null as varchar(40)) when 1 then '' when 2 then 'company' else 'regulator' end as org_type
from emails {_TWO}
"""

DEALS = """
select message_id, 0 as idx, case when (conv_id + turn) % 41 = 0 then '' else concat('Deal ', cast(conv_id % 20 as varchar(20)), ' of a long name that goes well beyond sixty characters') end as name,
 cast(null as varchar(40)) as description
from emails where turn % 2 = 0
"""

DECISIONS = """
select message_id, 0 as idx, case when (conv_id + turn) % 41 = 0 then '  ' else concat('Decide topic ', cast(conv_id as varchar(20))) end as description,
 case when (conv_id + turn) % 11 = 0 then cast(null as varchar(40)) else concat('Person ', cast(conv_id % 50 as varchar(20))) end as made_by
from emails where turn % 3 = 0
"""

AFFECTS = """
select message_id, 0 as idx, concat('PERSON ', cast(conv_id % 50 as varchar(20))) as affects from emails where turn % 3 = 0
union all select message_id, 0 as idx, 'the team' as affects from emails where turn % 3 = 0
"""

_NULL = "cast(null as varchar(40))"
ITEMS = f"""
select message_id, 'people' as field, idx, name, email, {_NULL} as org_type, {_NULL} as description, {_NULL} as made_by, {_NULL} as person_a, {_NULL} as person_b, {_NULL} as relationship_type, {_NULL} as evidence from people
union all select message_id, 'organizations', idx, name, {_NULL}, org_type, {_NULL}, {_NULL}, {_NULL}, {_NULL}, {_NULL}, {_NULL} from organizations
union all select message_id, 'deals', idx, name, {_NULL}, {_NULL}, description, {_NULL}, {_NULL}, {_NULL}, {_NULL}, {_NULL} from deals
union all select message_id, 'decisions', idx, {_NULL}, {_NULL}, {_NULL}, description, made_by, {_NULL}, {_NULL}, {_NULL}, {_NULL} from decisions
union all select message_id, 'relationships', idx, {_NULL}, {_NULL}, {_NULL}, {_NULL}, {_NULL}, person_a, person_b, relationship_type, evidence from relationships
"""

#: In order: each may use those before it.
VIEWS = {"emails": EMAILS, "relationships": RELATIONSHIPS, "people": PEOPLE, "organizations": ORGANIZATIONS, "deals": DEALS, "decisions": DECISIONS, "affects": AFFECTS, "items": ITEMS}


def spark_views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views over the tables of sf_dir."""
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("conversations")
    found = {}
    for name, sql in VIEWS.items():
        df = spark.sql(sql)
        if name == "emails":
            df = df.withColumn("ord", F.struct("conv_id", "turn"))
        if name == "items":
            df = df.withColumn("source", F.lit(None).cast("string")).withColumn("target", F.lit(None).cast("string")).withColumn("has_endpoint_keys", F.lit(False))
        df.createOrReplaceTempView(name)
        found[name] = df
    return [found[n] for n in names]


def with_views(query: str, *names: str) -> str:
    """query for DuckDB with the named views, and those that they need, in front."""
    needs = {"relationships": ["emails"], "people": ["emails"], "organizations": ["emails"], "deals": ["emails"], "decisions": ["emails"], "affects": ["emails"], "items": ["emails", "relationships", "people", "organizations", "deals", "decisions"]}
    wanted = {x for n in names for x in [n, *needs.get(n, [])]}
    parts = [f"{n} as ({VIEWS[n].strip()})" for n in VIEWS if n in wanted]
    return f"with {', '.join(parts)}{query}" if query.lstrip().startswith(",") else f"with {', '.join(parts)} {query}"
