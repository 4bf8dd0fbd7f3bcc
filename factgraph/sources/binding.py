"""The test tables read as fact tables: one SQL text for each, valid in Spark and in DuckDB.

Status ranks: 1 resolved, 2 ambiguous, 3 unresolved. Two-sided tables carry side before / after.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS: dict[str, str] = {
    "fx_side": """
select * from (values ('before'),('after')) as s(side)
""",
    "fx_size": """
select (select count(*) from documents) as n_docs, (select count(*) from part) as n_parts, (select count(*) from supplier) as n_suppliers,
  cast(greatest(floor((select count(*) from supplier) / 8), 15) as bigint) as n_queues
""",
    "fx_files": """
select side, 'source:'||doc_id as file_id, source||'/'||lang||'/'||doc_id||'.ts' as path,
  case when side='after' and doc_id%9=0 then md5(text||'x') else md5(text) end as content_hash, n_chars as byte_length
from documents cross join fx_side
where (side='before' and doc_id%10<>7) or (side='after' and doc_id%10<>8)
""",
    "fx_classes": """
select 'class:'||doc_id as class_id, 'source:'||doc_id as file_id, 'C'||doc_id as qualified_name,
  case doc_id%4 when 0 then 'controller' when 1 then 'entity' when 2 then 'guard' else 'provider' end as role
from documents
""",
    "fx_methods": """
select 'method:o'||o_orderkey as method_id, 'class:'||((o_orderkey*4)%n_docs) as class_id, 'h'||o_orderkey as name from orders cross join fx_size
union all
select 'method:p'||p_partkey, 'class:'||(p_partkey%n_docs), p_name from part cross join fx_size
""",
    "fx_tables": """
select 'table:'||s_suppkey as table_id, lower(s_name) as table_name from supplier
""",
    "fx_endpoints": """
select side, 'endpoint:'||c_custkey as endpoint_id,
  case c_mktsegment when 'AUTOMOBILE' then 'GET' when 'BUILDING' then 'POST' when 'FURNITURE' then 'PUT'
    when 'HOUSEHOLD' then 'PATCH' else 'DELETE' end as http_method,
  '/'||lower(c_mktsegment)||'/'||case when c_custkey%20=0 then 'shared'||(c_custkey-c_custkey%40) else 'c'||c_custkey end as path
from customer cross join fx_side
where (side='before' and c_custkey%10<>7) or (side='after' and c_custkey%10<>8)
""",
    "fx_impl": """
select side, 'endpoint:'||o_custkey as subject_id,
  case when o_custkey%29=0 then null
       when side='after' and o_custkey%17=0 then 'method:o'||max(o_orderkey) else 'method:o'||min(o_orderkey) end as object_id,
  case when o_custkey%29=0 then 3 when o_custkey%23=0 then 2 else 1 end as status_rank
from orders cross join fx_side group by side, o_custkey
""",
    "fx_calls": """
select side, 'method:o'||l_orderkey as subject_id, 'method:p'||l_partkey as object_id,
  min(case when l_linenumber=6 then 2 when l_linenumber=7 then 3 else 1 end) as status_rank, 'evidence:'||l_orderkey||'_'||l_partkey as evidence_id
from lineitem cross join fx_side
where (side='before' and l_partkey%10<>7) or (side='after' and l_partkey%10<>8)
group by side, l_orderkey, l_partkey
union all
select side, 'method:p'||p_partkey, 'method:p'||((p_partkey*7+3)%n_parts), case when p_partkey%11=0 then 2 else 1 end, 'evidence:p'||p_partkey
from part cross join fx_side cross join fx_size where p_partkey%3=0
""",
    "fx_access": """
select side, 'method:p'||l_partkey as subject_id, 'table:'||l_suppkey as object_id,
  case when l_returnflag='R' then 'METHOD_WRITES_TABLE' else 'METHOD_READS_TABLE' end as predicate,
  min(case when l_linestatus='F' and l_quantity<10 and (side='before' or l_suppkey%5<>0) then 2 else 1 end) as status_rank, 'evidence:a'||l_partkey||'_'||l_suppkey as evidence_id
from lineitem cross join fx_side where l_linenumber=1
group by side, l_partkey, l_suppkey, case when l_returnflag='R' then 'METHOD_WRITES_TABLE' else 'METHOD_READS_TABLE' end
""",
    # The rows that fx_calls and fx_access take the best status of: for jobs that take it themselves, of what they need.
    "fx_call_rows": """
select side, 'method:o'||l_orderkey as subject_id, 'method:p'||l_partkey as object_id, case when l_linenumber=6 then 2 when l_linenumber=7 then 3 else 1 end as status_rank
from lineitem cross join fx_side
where (side='before' and l_partkey%10<>7) or (side='after' and l_partkey%10<>8)
union all
select side, 'method:p'||p_partkey, 'method:p'||((p_partkey*7+3)%n_parts), case when p_partkey%11=0 then 2 else 1 end
from part cross join fx_side cross join fx_size where p_partkey%3=0
""",
    "fx_access_rows": """
select side, 'method:p'||l_partkey as subject_id, 'table:'||l_suppkey as object_id,
  case when l_returnflag='R' then 'METHOD_WRITES_TABLE' else 'METHOD_READS_TABLE' end as predicate,
  case when l_linestatus='F' and l_quantity<10 and (side='before' or l_suppkey%5<>0) then 2 else 1 end as status_rank
from lineitem cross join fx_side where l_linenumber=1
""",
    # Both sides in one row, a side's rank null where it has none. Rows of a key are one edge but for copies, each one of its own.
    "fx_call_both": """
select 'method:o'||l_orderkey as subject_id, 'method:p'||l_partkey as object_id, case when l_partkey%10<>7 then status_rank end as before_rank, case when l_partkey%10<>8 then status_rank end as after_rank, 0 as copies
from (select l_orderkey, l_partkey, case when l_linenumber=6 then 2 when l_linenumber=7 then 3 else 1 end as status_rank from lineitem where l_partkey is not null) l
union all
select 'method:p'||p_partkey, 'method:p'||((p_partkey*7+3)%n_parts), case when p_partkey%11=0 then 2 else 1 end, case when p_partkey%11=0 then 2 else 1 end, 1 from part cross join fx_size where p_partkey%3=0
""",
    "fx_access_both": """
select 'method:p'||l_partkey as subject_id, 'table:'||l_suppkey as object_id, case when l_returnflag='R' then 'METHOD_WRITES_TABLE' else 'METHOD_READS_TABLE' end as predicate,
  case when l_linestatus='F' and l_quantity<10 then 2 else 1 end as before_rank, case when l_linestatus='F' and l_quantity<10 and l_suppkey%5<>0 then 2 else 1 end as after_rank, 0 as copies
from lineitem where l_linenumber=1
""",
    "fx_guard_use": """
select 'endpoint:'||c_custkey as endpoint_id, 'guard:'||c_nationkey as guard_id,
  case when c_nationkey%2=0 then 'controller' else 'method' end as scope,
  case when c_nationkey%7=0 then 2 else 1 end as status_rank, 'evidence:g'||c_custkey as evidence_id
from customer where c_acctbal>0
""",
    "fx_global_guards": """
select 'svc'||s.n as service_ns, 'guard:g'||r_regionkey as guard_id, r_regionkey as guard_order
from region cross join (values (0),(1),(2),(3)) as s(n) where r_regionkey<s.n
""",
    "fx_modules": """
select 'svc'||s_suppkey as analysis_id, 'module:'||n_nationkey as module_id, (n_nationkey+s_suppkey)%12=0 as is_global,
  case when (n_nationkey+s_suppkey)%6=5 then 'incomplete' else 'complete' end as completeness from nation cross join supplier
""",
    "fx_module_edges": """
select 'svc'||s_suppkey as analysis_id, 'module:'||n_nationkey as subject_id, 'MODULE_IMPORTS_MODULE' as predicate, 'module:'||((n_nationkey+3)%27) as object_id, case when (n_nationkey+s_suppkey)%9=0 then 2 else 1 end as status_rank
from nation cross join supplier where (n_nationkey+s_suppkey)%4<>0
union all select 'svc'||s_suppkey, 'module:'||n_nationkey, 'MODULE_EXPORTS_MODULE', 'module:'||((n_nationkey*2+1)%25), 1 from nation cross join supplier where n_nationkey%2=0
union all select 'svc'||(doc_id%n_suppliers), 'module:'||(doc_id%25), 'MODULE_PROVIDES_CLASS', 'class:'||doc_id, case when doc_id%31=0 then 2 else 1 end from documents cross join fx_size where doc_id%4<>0 and doc_id%8<>7
union all select 'svc'||(doc_id%n_suppliers), 'module:'||(doc_id%25), 'MODULE_DECLARES_CONTROLLER', 'class:'||doc_id, 1 from documents cross join fx_size where doc_id%4=0
union all select 'svc'||(doc_id%n_suppliers), 'module:'||(doc_id%24), 'MODULE_PROVIDES_CLASS', 'class:'||doc_id, 1 from documents cross join fx_size where doc_id%9=0
union all select 'svc'||(doc_id%n_suppliers), 'module:'||(doc_id%25), 'MODULE_EXPORTS_CLASS', 'class:'||doc_id, 1 from documents cross join fx_size where doc_id%3=0
""",
    "fx_evidence": """
select 'evidence:'||l_orderkey||'_'||l_partkey as evidence_id, 'source:'||(l_partkey%n_docs) as file_id,
  min(cast(l_quantity as int)) as start_line, min(l_linenumber) as start_column,
  min(cast(l_quantity as int))+1 as end_line, max(l_linenumber) as end_column
from lineitem cross join fx_size group by l_orderkey, l_partkey, n_docs
""",
    "fx_regions": """
select 'region:'||p_partkey as region_id, 'source:'||(p_partkey%n_docs) as file_id, p_size as start_line, 1 as start_column,
  p_size+10 as end_line, 9 as end_column from part cross join fx_size where p_partkey%4=0
""",
    "fx_diagnostics": """
select side, 'diagnostic:'||event_id as diagnostic_id,
  case event_id%4 when 0 then 'CALL_DEPTH_LIMIT' when 1 then 'CALL_TARGET_UNRESOLVED' when 2 then 'TARGET_DYNAMIC' else 'IMPORT_UNRESOLVED' end as code,
  case when value>8 and side='after' then 'error' when value>4 then 'warning' else 'info' end as severity,
  case when event_id%5=0 then null else 'endpoint:'||user_id end as subject_id, props as message, 'evidence:d'||event_id as evidence_id
from events cross join fx_side
where event_type='error' and ((side='before' and event_id%10<>7) or (side='after' and event_id%10<>8))
""",
    "fx_interactions": """
select 'interaction:'||event_id as interaction_id, 'svc'||(user_id%8) as service_ns, case when event_id%4=0 then 'method:p'||(user_id%n_parts) else 'method:o'||user_id end as source_method_id,
  case event_type when 'purchase' then 'job_queue' when 'signup' then 'microservice_message' else 'in_process_event' end as kind,
  case when event_id%13=0 then null else 'q'||(user_id%(n_queues-3)) end as queue,
  case when event_id%11=0 then null else 'j'||(cast(regexp_extract(props,'[0-9]+',0) as int)%5) end as job,
  case event_id%5 when 0 then null when 1 then 'kafka' else 'rmq' end as transport,
  case event_id%6 when 0 then 'constructed_cold' when 1 then 'unknown' when 2 then 'proven_activated' else 'eager' end as activation, 'evidence:i'||event_id as evidence_id,
  case when event_type='signup' then case when event_id%3=0 then 'request_response' else 'event' end end as mode, case event_id%4 when 1 then 'asynchronous' when 2 then 'synchronous' else 'unknown' end as dispatch
from events cross join fx_size where event_type in ('purchase','signup','click')
""",
    "fx_handlers": """
select 'handler:'||s_suppkey as handler_id, 'svc'||(s_suppkey%8) as service_ns, 'method:p'||s_suppkey as method_id,
  case when s_suppkey%2=0 then 'job_queue' when s_suppkey%6=1 then 'in_process_event' else 'microservice_message' end as kind,
  'q'||(s_suppkey%n_queues) as queue, case s_suppkey%3 when 0 then null when 1 then 'kafka' else 'rmq' end as transport, case when s_suppkey%4=0 or s_suppkey%2=1 then null else 'j'||(s_suppkey%5) end as job,
  case when s_suppkey%9=0 then 'registration_unknown' else 'proven_registered' end as registration, 'evidence:h'||s_suppkey as evidence_id,
  case when s_suppkey%2=1 and s_suppkey%6<>1 then case when s_suppkey%5<2 then 'request_response' else 'event' end end as mode,
  case when s_suppkey%2=0 then 'bullmq.worker' when s_suppkey%6=1 then case s_suppkey%4 when 1 then 'events.sync.handler' else 'events.plain.handler' end else 'messages.handler' end as rule_id
from supplier cross join fx_size
""",
    "fx_bindings": """
select 'svc'||s.n as service_ns, 'q'||s_suppkey as queue, 'realm:'||((s_suppkey+case when s.n=5 then 1 else 0 end)%5) as realm_id
from supplier cross join (values (0),(1),(2),(3),(4),(5)) as s(n) cross join fx_size where s_suppkey<n_queues
""",
    "fx_patterns": """
select distinct case page_id%7 when 0 then first||'.**' when 1 then first||'.*' when 2 then '*.'||last when 3 then '**.'||last when 4 then first||'.*.'||last when 5 then '*.*' else '*.'||first||'.**' end as pattern
from (select page_id, split_part(rest, '/', 1) as first, split_part(rest, '/', 2) as last from (select page_id, regexp_replace(url, '^https?://[^/]+/', '') as rest from pages) u) v
""",
    "fx_interactions2": """
select s.side, interaction_id, service_ns, source_method_id, kind, case when s.side='after' and n%17=0 then 'q0' else queue end as queue, job,
  case when s.side='after' and n%19=0 then 'unknown' else activation end as activation, mode
from (select *, cast(split_part(interaction_id, ':', 2) as bigint) as n from fx_interactions) i cross join fx_side s where (s.side='before' and n%10<>7) or (s.side='after' and n%10<>8)
""",
    "fx_handlers2": """
select s.side, handler_id, service_ns, method_id, kind, queue, case when s.side='after' and n%7=0 then null else job end as job,
  case when s.side='after' and n%11=0 then 'registration_unknown' else registration end as registration, mode
from (select *, cast(split_part(handler_id, ':', 2) as bigint) as n from fx_handlers) h cross join fx_side s where (s.side='before' and n%10<>7) or (s.side='after' and n%10<>8)
""",
    "fx_branches2": """
select s.side, branch_id, handler_id, selector_kind, case when s.side='after' and n%5=0 then jobs||',j9' else jobs end as jobs
from (select *, cast(split_part(handler_id, ':', 2) as bigint) as n from fx_branches) b cross join fx_side s where (s.side='before' and n%12<>7) or (s.side='after' and n%14<>8)
""",
    "fx_auth_metadata": """
select 'meta:'||c_custkey as metadata_id, 'endpoint:'||c_custkey as endpoint_id, 'key'||(c_nationkey%3) as metadata_key,
  case when c_custkey%2=0 then 'controller' else 'method' end as scope
from customer where c_custkey%4<>3
""",
    "fx_auth_enforcement": """
select 'enf:'||c_custkey as enforcement_id, 'meta:'||c_custkey as metadata_id, 'endpoint:'||c_custkey as endpoint_id,
  case c_custkey%5 when 0 then 'configured_relationship' when 1 then 'enforcement_unknown' else 'proven_enforced' end as state,
  case when c_custkey%5=1 then null else 'guard:'||c_nationkey end as guard_id, case when c_custkey%5=1 then null else 'evidence:e'||c_custkey end as evidence_id
from customer where c_custkey%4<>3
""",
    "fx_parameters": """
select 'param:'||o_custkey as parameter_id, 'method:o'||min(o_orderkey) as method_id,
  case o_custkey%3 when 0 then 'body' when 1 then 'param' else 'query' end as source_kind,
  case when o_custkey%2=0 then 'sel'||(o_custkey%7) else null end as selector
from orders group by o_custkey
""",
    "fx_origins": """
select 'origin:'||o_orderkey as origin_id, 'param:'||o_custkey as parameter_id, 'field'||(o_orderkey%9) as property_path from orders
""",
    "fx_columns": """
select 'column:'||p_partkey as column_id, 'entity:'||(p_partkey%n_docs) as entity_id, 'f'||p_partkey as property_name,
  case when p_partkey%6=0 then null else 'db_'||p_partkey end as database_name from part cross join fx_size
""",
    "fx_influences": """
select 'origin:'||l_orderkey as origin_id, 'column:'||l_partkey as column_id, 'method:p'||l_partkey as method_id,
  max(case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end) as state_rank, cast(min(l_linenumber)-1 as int) as hops
from lineitem where l_linenumber<=3 group by l_orderkey, l_partkey
""",
    "fx_branches": """
select 'branch:'||s_suppkey||'_'||b.n as branch_id, 'handler:'||s_suppkey as handler_id,
  case b.n when 0 then 'exact_jobs' when 1 then 'unmatched_jobs' when 2 then 'all_jobs' else 'unknown' end as selector_kind,
  case when b.n<2 then 'j'||(s_suppkey%5)||',j'||((s_suppkey+1)%5) else '' end as jobs
from supplier cross join (values (0),(1),(2),(3)) as b(n) where s_suppkey%2=0 and (b.n<3 or s_suppkey%8=0)
""",
    "fx_resources": """
select 'resource:'||p_partkey as resource_id, 'method:p'||p_partkey as method_id,
  case p_partkey%3 when 0 then 'read' when 1 then 'write' else 'delete' end as operation,
  case when p_partkey%5=0 then null else p_brand end as target,
  case when p_partkey%5=0 then 'dynamic' when p_partkey%4=0 then 'symbolic' when p_partkey%3=0 then 'template' else 'exact' end as target_kind from part where p_partkey%2=0
""",
    "fx_scoped_calls": """
select 'method:p'||p_partkey as subject_id, 'method:p'||((p_partkey*7+3)%n_parts) as object_id, 'section:'||p_partkey as section_id
from part cross join fx_size where p_partkey%6=0
""",
    "fx_edges": """
select 'METHOD_CALLS_METHOD|'||subject_id||'|'||object_id as edge_id, 'METHOD_CALLS_METHOD' as predicate, subject_id, object_id, status_rank, evidence_id from fx_calls where side='after'
union all select predicate||'|'||subject_id||'|'||object_id, predicate, subject_id, object_id, status_rank, evidence_id from fx_access where side='after'
union all select 'METHOD_ACCESSES_RESOURCE|'||method_id||'|'||resource_id, 'METHOD_ACCESSES_RESOURCE', method_id, resource_id, case when target is null then 2 else 1 end, 'evidence:r'||split_part(resource_id, ':', 2) from fx_resources
union all select 'METHOD_INITIATES_INTERACTION|'||source_method_id||'|'||interaction_id, 'METHOD_INITIATES_INTERACTION', source_method_id, interaction_id, 1, evidence_id from fx_interactions
""",
    "fx_injections": """
select 'class:'||doc_id as class_id, 'binding:'||doc_id as binding_id, case when doc_id%5=0 then 2 when doc_id%7=0 then 3 else 1 end as status_rank, 'evidence:b'||doc_id as evidence_id from documents where doc_id%12=0
""",
    "fx_class_diagnostics": """
select 'class:'||doc_id as subject_id, 'DI_TOKEN_UNSUPPORTED' as code, 'evidence:dc'||doc_id as evidence_id from documents where doc_id%20=0
union all select 'method:p'||p_partkey, case when p_partkey%26=0 then 'TYPEORM_OPERATION_UNSUPPORTED' else 'TYPEORM_ENTITY_UNRESOLVED' end, 'evidence:dm'||p_partkey from part where p_partkey%13=0
""",
    "fx_sections": """
select 'section:'||p_partkey as scope_id, 'method:p'||p_partkey as method_id, case when p_partkey%18<>0 then 'METHOD_ACCESSES_RESOURCE|method:p'||p_partkey||'|resource:'||p_partkey end as lock_edge_id
from part where p_partkey%6=0
""",
    "fx_section_effects": """
select section_id as scope_id, 'METHOD_CALLS_METHOD|'||subject_id||'|'||object_id as edge_id from fx_scoped_calls
union all select 'section:'||split_part(subject_id, ':p', 2), predicate||'|'||subject_id||'|'||object_id from fx_access where side='after' and cast(split_part(subject_id, ':p', 2) as bigint)%6=0 and cast(split_part(object_id, ':', 2) as bigint)%2=0
union all select 'section:'||split_part(source_method_id, ':p', 2), 'METHOD_INITIATES_INTERACTION|'||source_method_id||'|'||interaction_id from fx_interactions where source_method_id like 'method:p%' and cast(split_part(source_method_id, ':p', 2) as bigint)%6=0
""",
    "fx_branch_effects": """
select 'branch:'||split_part(subject_id, ':p', 2)||'_'||(cast(split_part(object_id, ':', 2) as bigint)%4) as branch_id, predicate||'|'||subject_id||'|'||object_id as edge_id
from fx_access join fx_handlers on method_id = subject_id and kind = 'job_queue' where side='after'
union all select branch_id, 'METHOD_CALLS_METHOD|'||subject_id||'|'||object_id from fx_calls join fx_handlers h on h.method_id = subject_id join fx_branches b on b.handler_id = h.handler_id and b.selector_kind <> 'unknown' where side='after'
""",
    "fx_observations": """
select side, 'svc'||s_suppkey as service_ns,
  case when s_suppkey%8=3 and side='after' then 'missing' when s_suppkey%8=4 and side='after' then 'not_present' else 'available' end as state
from fx_side cross join supplier
""",
    "fx_realms": """
select side, 'realm:'||r_regionkey as realm_id, case when r_regionkey=2 and side='after' then 'kafka' else 'rmq' end as transport
from region cross join fx_side where not (r_regionkey=4 and side='after')
""",
}


def needed(sql: str) -> list[str]:
    """The views that a text names, each after those it rests on."""
    order: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in order:
                add(VIEWS[name])
                order.append(name)

    add(sql)
    return order


def with_facts(sql: str) -> str:
    """A query over fact views and test tables as one statement. A text that begins with `with` keeps its own parts."""
    parts = [f"{name} as ({VIEWS[name]})" for name in needed(sql)]
    body = sql.strip()
    head = re.match(r"with\s+(recursive\s+)?", body, re.I)
    recursive = "recursive " if head and head[1] else ""
    if head:
        parts, body = [*parts, body[head.end() :]], ""
        return f"with {recursive}" + ",\n".join(parts)
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


class Facts:
    """The fact tables over a folder of test tables: facts["fx_calls"], facts["documents"], or any SQL over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(f"select * from {name}")

    def sql(self, text: str) -> DataFrame:
        used = " ".join([text, *(VIEWS[v] for v in needed(text))])
        base = [f"{t} as (select * from parquet.`{self.sf_dir}/{t}.parquet`)" for t in TABLES if re.search(rf"\b{t}\b", used)]
        whole = with_facts(text)
        if not base:
            return self.spark.sql(whole)
        rest = re.sub(r"^with\s+", "", whole) if whole.startswith("with ") else None
        return self.spark.sql("with " + ", ".join(base) + (", " + rest if rest else " " + whole))

    def side(self, name: str, side: str = "after") -> DataFrame:
        return self[name].where(f"side = '{side}'").drop("side")
