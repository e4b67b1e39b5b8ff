"""Domain tables as projections of the driver's tables, written once for Spark and DuckDB.

A fixture is SQL in the common subset of both, with calls of the dialect where they differ; `build` puts the fixtures that
a query names before it as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import ontology
from ..session import guard

BASE = "region nation customer supplier part orders lineitem events documents pages conversations benchmark labels embeddings".split()


class Spark:
    name = "spark"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def hours(self, ts: str, h: str) -> str:
        return f"(cast({ts} as timestamp) + make_interval(0, 0, 0, 0, cast({h} as int), 0, 0))"

    def minutes(self, ts: str, m: str) -> str:
        return f"(cast({ts} as timestamp) + make_interval(0, 0, 0, 0, 0, cast({m} as int), 0))"

    def text(self, ts: str, pattern: str) -> str:
        return f"date_format({ts}, '{pattern}')"

    def pad(self, x: str, n: int) -> str:
        return f"lpad(cast({x} as string), {n}, '0')"

    def values(self, rows: list[tuple], columns: str) -> str:
        return f"select * from values {_rows(rows)} as t({columns})"

    def local(self, ts: str, zone: str) -> str:
        return f"from_utc_timestamp({ts}, {zone})"

    def users(self) -> str:
        """Suppliers as users of a nation, twenty at most: known before the join, so that it makes no row twice."""
        return "(select distinct s_nationkey, s_suppkey % 20 as s_suppkey from supplier) s"


class Duck(Spark):
    name = "duckdb"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def hours(self, ts: str, h: str) -> str:
        return f"({ts} + to_hours(cast({h} as int)))"

    def minutes(self, ts: str, m: str) -> str:
        return f"({ts} + to_minutes(cast({m} as int)))"

    def text(self, ts: str, pattern: str) -> str:
        for a, b in (("yyyy", "%Y"), ("MMMM", "%B"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
            pattern = pattern.replace(a, b)
        return f"strftime({ts}, '{pattern}')"

    def values(self, rows: list[tuple], columns: str) -> str:
        return f"select * from (values {_rows(rows)}) as t({columns})"

    def local(self, ts: str, zone: str) -> str:
        return f"(({ts} at time zone 'UTC') at time zone {zone})"

    def users(self) -> str:
        return "supplier"


def _rows(rows: list[tuple]) -> str:
    one = lambda x: "cast(null as string)" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _case(x: str, values: list[str]) -> str:
    return f"case {x} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values[:-1])) + f" else '{values[-1]}' end"


FIXTURES: dict[str, Callable[[Spark], str]] = {
    "dim_type": lambda d: d.values(ontology.ENTITY_TYPES, "entity_type, category, parent"),
    "dim_relationship": lambda d: d.values([(i, r[0], r[1]) for i, r in enumerate(ontology.RELATIONSHIPS)], "idx, relationship_type, inverse"),
    "dim_triplet": lambda d: d.values(ontology.triplets(), "source_type, relationship_type, target_type"),
    "dim_closure": lambda d: """
        with own as (select entity_type, entity_type as ancestor from dim_type union all select entity_type, parent from dim_type where parent is not null)
        select distinct s.entity_type as source_type, relationship_type, t.entity_type as target_type
        from dim_triplet x join own s on s.ancestor = x.source_type join own t on t.ancestor = x.target_type""",
    # (order, line) isn't unique in the driver's table
    "lines": lambda d: """
        select l_orderkey as okey, l_linenumber as line, min(l_partkey) as pkey, min(l_suppkey) as skey, min(abs(l_discount)) as discount, min(abs(l_tax)) as tax,
               min(l_shipdate) as ship, min(l_returnflag) as flag, min(l_linestatus) as status, min(l_quantity) as qty
        from lineitem group by l_orderkey, l_linenumber""",
    "mentions": lambda d: f"""
        select 'm_' || cast(okey as string) || '_' || cast(line as string) as mention_id, 'd_' || cast(cast(floor(okey / 32) as bigint) as string) as document_id,
               'c_' || cast(cast(floor(okey / 128) as bigint) as string) as case_id, okey * 10 + line as pos, cast(okey % 32 + 1 as int) as page_number,
               case when okey % 97 = 0 and line = 1 then ' ' when line % 3 = 0 then p_name when line % 3 = 1 then upper(p_name) else upper(substr(p_name, 1, 1)) || substr(p_name, 2) end as text,
               case when line % 4 = 3 or (okey % 97 = 0 and line = 1) then cast(null as string) else lower(p_name) end as normalized_value,
               case p_type when 'STANDARD' then 'PERSON' when 'ECONOMY' then 'COMPANY' when 'PROMO' then 'CASE' when 'MEDIUM' then 'HEARING' when 'LARGE' then 'COURT' else 'PARTY' end as entity_type,
               round(1 - discount * 8, 4) as confidence, cast(line * 40 as int) as start_offset, cast(line * 40 + length(p_name) as int) as end_offset,
               case when okey % 2 = 0 then 'MODEL' else 'RULE' end as extraction_method, p_brand as brand
        from lines join part on p_partkey = pkey""",
    "relations": lambda d: f"""
        select 'r_' || cast(a.okey as string) || '_' || cast(a.line as string) as candidate_id, 'd_' || cast(cast(floor(a.okey / 32) as bigint) as string) as document_id,
               r.relationship_type as relation_type, 'm_' || cast(a.okey as string) || '_' || cast(a.line as string) as source_id,
               case when a.okey % 53 = 0 then 'm_none' else 'm_' || cast(b.okey as string) || '_' || cast(b.line as string) end as target_id,
               a.okey * 10 + a.line as pos, round(1 - a.tax * 8, 4) as confidence, a.okey % 11 <> 0 as is_valid,
               case when a.okey % 11 = 0 then 'flagged' else cast(null as string) end as validation_error
        from lines a join lines b on a.okey = b.okey and b.line = a.line + 1 join dim_relationship r on r.idx = (a.okey + a.line) % 24""",
    "docket": lambda d: f"""
        select o_orderkey as event_id, o_custkey as matter_id, case when o_orderkey % 2 = 0 then 'hearing' else 'deadline' end as kind,
               'Event ' || cast(o_orderkey as string) as title, {d.hours("o_orderdate", "8 + o_orderkey % 9")} as starts_at,
               {_case("cast(o_orderkey % 4 as int)", ["America/New_York", "America/Chicago", "America/Los_Angeles", "Europe/London"])} as timezone,
               case when o_orderstatus = 'O' then 'scheduled' when o_orderstatus = 'F' then 'completed' when o_orderkey % 3 = 0 then 'rescheduled' when o_orderkey % 3 = 1 then 'postponed' else 'cancelled' end as status,
               case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'normal' else 'low' end as priority,
               cast(o_orderkey % 5 as int) as sequence, 'Court ' || cast(o_custkey % 7 as string) as court_name, case when o_orderkey % 3 = 0 then cast(o_orderkey % 20 as string) else cast(null as string) end as courtroom,
               case when o_orderkey % 4 = 0 then 'Judge ' || cast(o_orderkey % 13 as string) else cast(null as string) end as judge,
               case when o_orderkey % 5 = 0 then 'note ' || cast(o_orderkey as string) else cast(null as string) end as notes, o_totalprice as amount
        from orders""",
    "reminders": lambda d: f"""
        select okey * 10 + line as reminder_id, okey as event_id, o_custkey as matter_id, case when line % 3 = 0 then okey * 2 + line % 2 else cast(null as bigint) end as document_id,
               cast(skey % 20 as string) as user_id, case when line % 2 = 1 then 'offset_before_event' else 'fixed_datetime' end as anchor, cast(line as int) as days_before,
               case when line % 4 = 1 then '10:30' when line % 4 = 2 then '14:15:00' else cast(null as string) end as time_of_day, {d.hours("ship", "9 + line")} as fire_at,
               case when flag = 'N' and status = 'O' then 'pending' when flag = 'N' then 'sent' when flag = 'R' and status = 'O' then 'snoozed' when flag = 'R' then 'missed' when status = 'O' then 'acknowledged' else 'cancelled' end as state,
               case when flag = 'R' and status = 'O' then {d.hours("ship", "30 + line")} else cast(null as timestamp) end as snoozed_until,
               case okey % 3 when 0 then 'none' when 1 then 'daily_until_done' else 'daily_until_event' end as repeat_rule
        from lines join orders on o_orderkey = okey""",
    "attached": lambda d: """
        select o_orderkey * 2 + i as document_id, o_orderkey as event_id, o_custkey as matter_id, 'Doc ' || cast(i as string) as display_name,
               case when o_orderkey % 3 = 0 then 'reviewed' when o_orderkey % 3 = 1 then 'to_review' else 'changed_since_review' end as review_status
        from orders, (select 0 as i union all select 1 as i) n""",
    "uploads": lambda d: f"""
        select doc_id as upload_id, doc_id % 5 as matter_id, source as display_name, {d.sha("text")} as sha256, lang, n_chars
        from documents where text is not null""",
    "members": lambda d: f"""
        select distinct c_custkey as matter_id, s_suppkey % 20 as user_no, cast(s_suppkey % 20 as string) as user_id,
               {_case("cast((c_custkey + s_suppkey % 20) % 4 as int)", ["owner", "attorney", "paralegal", "viewer"])} as role
        from customer join {d.users()} on c_nationkey = s_nationkey""",
    "matters": lambda d: "select c_custkey as matter_id, c_name as name, c_mktsegment as segment, c_acctbal as balance from customer",
    "nodes": lambda d: """
        select 'c' || cast(n_regionkey as string) as case_id, 'P' || cast(c_custkey as string) as id, c_name as name, 'PERSON' as entity_type, lower(c_mktsegment) as alias, c_custkey as ord from customer join nation on n_nationkey = c_nationkey
        union all select 'c' || cast(n_regionkey as string), 'S' || cast(s_suppkey as string), s_name, case when s_suppkey % 3 = 0 then 'LAW_FIRM' else 'COMPANY' end, lower(n_name), s_suppkey from supplier join nation on n_nationkey = s_nationkey
        union all select 'c' || cast(n_regionkey as string), 'N' || cast(n_nationkey as string), n_name, 'COURT', 'court ' || cast(n_nationkey as string), n_nationkey from nation
        union all select 'c' || cast(n_regionkey as string), 'O' || cast(o_orderkey as string), 'Order ' || cast(o_orderkey as string), case when o_orderkey % 4 = 0 then 'FILING' when o_orderkey % 4 = 1 then 'HEARING' else 'CASE' end, lower(o_orderpriority), o_orderkey
            from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""",
    "edges": lambda d: """
        select 'c' || cast(n_regionkey as string) as case_id, 'E1_' || cast(o_orderkey as string) as id, 'P' || cast(c_custkey as string) as source_id, 'O' || cast(o_orderkey as string) as target_id, 'PLAINTIFF_IN' as relationship_type, 0.9 as confidence
            from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
        union all select 'c' || cast(n_regionkey as string), 'E2_' || cast(okey as string) || '_' || cast(line as string), 'S' || cast(skey as string), 'O' || cast(okey as string), 'DEFENDANT_IN', cast(0.8 as double)
            from lines join orders on o_orderkey = okey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where line = 1
        union all select 'c' || cast(n_regionkey as string), 'E3_' || cast(o_orderkey as string), 'O' || cast(o_orderkey as string), 'N' || cast(n_nationkey as string), 'FILED_IN', cast(0.7 as double)
            from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
        union all select 'c' || cast(n_regionkey as string), 'E4_' || cast(s_suppkey as string), 'S' || cast(s_suppkey as string), 'P' || cast(s_suppkey as string), 'ASSOCIATED_WITH', cast(1.0 as double) from supplier join nation on n_nationkey = s_nationkey""",
    "timeline": lambda d: f"""
        select 't_' || cast(o_orderkey as string) as event_id, 'd_' || cast(o_custkey as string) as document_id, 'e_' || cast(cast(floor(o_orderkey / 2) as bigint) as string) as canonical_entity_id,
               case when o_orderkey % 5 = 0 then 'DEADLINE' when o_orderkey % 5 < 3 then 'HEARING' else 'FILING' end as event_type, 'Event ' || cast(o_orderkey as string) as description,
               case when o_orderkey % 6 = 0 then cast(null as string) when o_orderkey % 3 = 1 then {d.text("o_orderdate", "yyyy-MM-dd")} when o_orderkey % 3 = 2 then {d.text("o_orderdate", "yyyy-MM")} else {d.text("o_orderdate", "yyyy")} end as event_date,
               case when o_orderkey % 12 = 0 then {d.text("o_orderdate", "yyyy-MM-dd")} else cast(null as string) end as start_date,
               case when o_orderkey % 6 = 0 then 'UNKNOWN_PARTIAL' when o_orderkey % 3 = 1 then 'EXACT_DAY' when o_orderkey % 3 = 2 then 'MONTH' else 'YEAR' end as date_precision,
               case when o_orderkey % 17 = 0 then 'REVIEW_REQUIRED' when o_orderkey % 19 = 0 then 'AMBIGUOUS' else 'RESOLVED' end as temporal_status,
               case when o_orderkey % 7 = 0 then cast(null as int) else cast(o_orderkey % 40 as int) + 1 end as source_page, cast(o_orderkey % 500 as int) as span_start, o_orderkey as pos, round(cast(0.5 as double) + (o_orderkey % 50) / cast(100 as double), 4) as confidence
        from orders""",
    "timeline_edges": lambda d: """
        select 'x_' || cast(a.o_orderkey as string) as relationship_id, 't_' || cast(a.o_orderkey as string) as source_event_id,
               case when a.o_orderkey % 4 = 0 then 'BEFORE' when a.o_orderkey % 4 = 1 then 'AFTER' when a.o_orderkey % 4 = 2 then 'HAS_DEADLINE' else 'CITES' end as relationship_type, 't_' || cast(a.o_orderkey + 1 as string) as target_event_id
        from orders a""",
    "date_texts": lambda d: f"""
        select o_orderkey as id, {d.text("o_orderdate", "yyyy-MM-dd")} as iso, o_orderkey % 9 as form, cast(month(o_orderdate) as int) as m, cast(day(o_orderdate) as int) as dd, cast(year(o_orderdate) as int) as y, {d.text("o_orderdate", "MMMM")} as mname
        from orders""",
}


def _needs(sql: str) -> set[str]:
    return {w for w in re.findall(r"\w+", sql) if w in FIXTURES}


def build(d: Spark, sql: str) -> str:
    """sql with all fixtures that it uses, directly or not, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in sorted(_needs(FIXTURES[name](d)) - {name}):
            add(other)
        if name not in order:
            order.append(name)

    for name in sorted(_needs(sql)):
        add(name)
    own = sql.strip()
    if not order:
        return own
    front = ", ".join(f"{n} as ({FIXTURES[n](d)})" for n in order)
    for head in ("with recursive ", "with "):
        if own.lower().startswith(head):
            return f"{head}{front}, {own[len(head):]}"
    return f"with {front} {own}"


def oracle(sql: str) -> str:
    return build(Duck(), sql)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run text over the driver's tables and the fixtures."""
    guard(spark)
    full = build(Spark(), text)
    for name in set(re.findall(r"\w+", full)) & set(BASE):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(full)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, f"select * from {name}")
