"""Queries on columns, sources, integrity and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.operators import integrity, select
from factgraph.plans.registry import query
from factgraph.sources import documents as S
from factgraph.sources.binding import Facts

ENVELOPE = """
select file_id as id, 'source' as kind, path||content_hash as payload from fx_files
union all select class_id, 'class', qualified_name from fx_classes
union all select method_id, 'method', name from fx_methods
union all select table_id, 'table', table_name from fx_tables
union all select endpoint_id, 'endpoint', http_method||path from fx_endpoints
union all select distinct module_id, 'module', 'module' from fx_modules
union all select 'x'||table_id, 'table', table_name from fx_tables where table_name like '%7'
"""


@query("s1_record_envelope", f"select kind, count(*) as n, count(distinct id) as n_ids, min(id) as first_id from ({ENVELOPE}) t group by kind")
def record_envelope(f: Facts) -> DataFrame:
    return f.sql(f"select * from ({ENVELOPE}) t").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"))


RUNS = "select c_custkey as analysis_id, (c_custkey % 10)||'.0.0' as version from customer"


@query("s2_capabilities", f"""
select analysis_id, family, case when v not between 1 and 8 then 'unsupported_version' when v >= since then 'available' else 'unavailable' end as availability
from (select analysis_id, cast(split_part(version, '.', 1) as int) as v from ({RUNS}) r) r
cross join (values ('base',1),('v2',2),('interactions',3),('job_queue_branches',4),('authorization',5),('resource_access',6),('critical_sections',7)) as s(family, since)""")
def capabilities(f: Facts) -> DataFrame:
    return S.capabilities(f.sql(RUNS), "version")


FILES = """select case when doc_id % 7 = 0 then 'dist/' when doc_id % 11 = 0 then 'src/Node_Modules/' else 'src/' end||source||'/'||doc_id||
  case when doc_id % 5 = 0 then '.js' when doc_id % 3 = 0 then '.TSX' else '.ts' end as path, text from documents"""


@query("s3_classify_inventory", f"""
select path, reason is null as kept, reason, case when reason is null then sha256(text) end as content_hash, case when reason is null then strlen(text) end as byte_length
from (select path, text, case when path like 'dist/%' or path like 'src/Node_Modules/%' then 'excluded_directory' when path like '%.js' then 'unsupported_extension'
  when strlen(text) > 4000 then 'oversized' end as reason from ({FILES}) x) y""")
def inventory(f: Facts) -> DataFrame:
    return S.classify_inventory(f.sql(FILES).select("path", F.col("text").cast("binary").alias("content")), 4000)


@query("s4_merge_records", """
select conv_id, count(*) as fragments, array_to_string(list_sort(list_distinct(list(role))), ';') as roles,
  case when min(turn % 3) <> max(turn % 3) then 'conflict' else 'merged' end as state from conversations group by conv_id""")
def merge(f: Facts) -> DataFrame:
    rows = f["conversations"].withColumn("payload", F.col("turn") % 3)
    return S.merge_records(rows, "conv_id", "role", ["payload"]).withColumn("role", F.array_join("role", ";")).withColumnRenamed("role", "roles")


CELLS = "select doc_id, case doc_id % 6 when 0 then '=' when 1 then '-' when 2 then 'a,' when 3 then '\"' else '' end||lang as cell, text from documents"


@query("s5_csv_cells", f"""
select doc_id, case when regexp_matches(s, '[",\\r\\n]') then '"'||replace(s, '"', '""')||'"' else s end as cell,
  doc_id||','||case when regexp_matches(b, '[",\\r\\n]') then '"'||replace(b, '"', '""')||'"' else b end as line
from (select doc_id, case when regexp_matches(cell, '^[=+\\-@]') then ''''||cell else cell end as s, case when regexp_matches(text, '^[=+\\-@]') then ''''||text else text end as b from ({CELLS}) c) d""")
def cells(f: Facts) -> DataFrame:
    rows = f.sql(CELLS)
    return rows.select("doc_id", C.csv_cell(F.col("cell")).alias("cell"), F.concat_ws(",", F.col("doc_id").cast("string"), C.csv_cell(F.col("text"))).alias("line"))


@query("s6_canonical_order", """
select user_id, array_to_string(list_sort(list_distinct(list(event_type))), ';') as kinds from events group by user_id""")
def ordered(f: Facts) -> DataFrame:
    rows = f["events"].groupBy("user_id").agg(F.collect_list("event_type").alias("kinds"))
    return S.canonical_order(rows, ["user_id"], ["kinds"]).withColumn("kinds", F.array_join("kinds", ";"))


@query("f1_stable_id", "select doc_id, 'source:'||substr(sha256(to_json([nfc_normalize(source), nfc_normalize(text)])), 1, 32) as stable_id from documents")
def stable_ids(f: Facts) -> DataFrame:
    return f["documents"].select("doc_id", C.stable_id("source", F.col("source"), F.col("text")).alias("stable_id"))


@query("f2_semantic_key", """
select doc_id, to_json(['method', nfc_normalize(source), nfc_normalize(text)]) as semantic_key, trim(regexp_replace(text, '\\s+', ' ', 'g')) as signature from documents""")
def semantic_keys(f: Facts) -> DataFrame:
    return f["documents"].select("doc_id", C.semantic_key("method", F.col("source"), F.col("text")).alias("semantic_key"), C.normalize_signature(F.col("text")).alias("signature"))


@query("f3_fingerprint", """
with rows_ as (select source, sha256(to_json([cast(doc_id as varchar), text])) as h from documents),
parts as (select source, count(*) as n_rows, sum(('0x'||substr(h,1,12))::bigint) as a, sum(('0x'||substr(h,13,12))::bigint) as b, sum(('0x'||substr(h,25,12))::bigint) as c from rows_ group by source)
select source, n_rows, sha256(a||','||b||','||c) as digest from parts""")
def fingerprints(f: Facts) -> DataFrame:
    return C.fingerprint(f["documents"], ["source"], ["doc_id", "text"])


PATHS = "select page_id, regexp_replace(url, '^https?://[^/]+', '') as path from pages"


@query("f4_routes", f"""
select page_id, '/'||array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/') as route,
  '/api/'||array_to_string(list_filter(string_split(regexp_replace(path||'/:id_1', ':([A-Za-z_][A-Za-z0-9_]*)', '{{\\1}}', 'g'), '/'), lambda s: s <> ''), '/') as template
from ({PATHS}) p""")
def routes(f: Facts) -> DataFrame:
    rows = f.sql(PATHS)
    return rows.select("page_id", C.normalize_route(F.col("path")).alias("route"), C.route_to_template(F.concat("path", F.lit("/:id_1")), "api").alias("template"))


URLS = "select page_id, case page_id % 4 when 0 then url when 1 then replace(url, '://', '://user:pw@')||'?b=1&a=2&a=3&{x}=4#frag' when 2 then '?q=1' else url||'#top?z=1' end as url from pages"


@query("f6_clean_target", f"""
with u as (select page_id, split_part(url, '#', 1) as plain from ({URLS}) x),
p as (select page_id, case when strpos(plain,'?')=0 then plain else substr(plain,1,strpos(plain,'?')-1) end as path, case when strpos(plain,'?')=0 then '' else substr(plain,strpos(plain,'?')+1) end as q from u)
select page_id, case when path='' then 'dynamic' else 'exact' end as resolution, case when path<>'' then regexp_replace(path, '^([a-z]+://)[^/]*@', '\\1') end as value,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(q,'&'), lambda x: split_part(x,'=',1)), lambda k: k<>'' and not regexp_matches(k,'[{{}}]')))), ';') as query_keys,
  case when path='' then 'dynamic' end as issue from p""")
def targets(f: Facts) -> DataFrame:
    t = f.sql(URLS).select("page_id", C.clean_target(F.col("url")).alias("t"))
    return t.select("page_id", "t.resolution", "t.value", F.array_join("t.query_keys", ";").alias("query_keys"), "t.issue")


@query("f8_redact_secrets", r"""
select doc_id, regexp_replace(regexp_replace(text, '(?i)(\b(?:api[_-]?key|secret|password|passwd|token|authorization)\b\s*(?:===?|!==?)\s*)("[^\r\n]*?"|''[^\r\n]*?''|`[^\r\n]*?`)', '\1"[REDACTED]"', 'g'),
  '(?i)(\b(?:api[_-]?key|secret|password|passwd|token|authorization)\b\s*[:=]\s*)("[^\r\n]*?"|''[^\r\n]*?''|`[^\r\n]*?`)', '\1"[REDACTED]"', 'g') as redacted from documents""")
def redacted(f: Facts) -> DataFrame:
    return f["documents"].select("doc_id", C.redact_secrets(F.col("text")).alias("redacted"))


@query("f9_bounded_snippet", r"""
select doc_id, case when length(t) <= 240 then t else substr(t, 1, 239)||'…' end as snippet from (select doc_id, regexp_replace(
  regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?i)(\b(?:api[_-]?key|secret|password|passwd|token|authorization)\b\s*[:=]\s*)("[^\r\n]*?"|''[^\r\n]*?''|`[^\r\n]*?`)', '\1"[REDACTED]"', 'g') as t from documents) d""")
def snippets(f: Facts) -> DataFrame:
    return f["documents"].select("doc_id", C.bounded_snippet(F.col("text")).alias("snippet"))


@query("f10_sanitize_text", r"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\r\n\t]+', ' ', 'g'), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') as clean,
  regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{{}}\[\]()#+\-.!|~])', '\\\1', 'g') as escaped from documents""".replace("{{", "{").replace("}}", "}"))
def sanitized(f: Facts) -> DataFrame:
    return f["documents"].select("doc_id", C.sanitize_text(F.col("text"), 1 << 24).alias("clean"), C.escape_markdown(F.col("text")).alias("escaped"))


@query("f12_target_key", """
select interaction_id, '{"job":'||coalesce('"'||job||'"','null')||',"kind":"'||kind||'","queue":'||coalesce('"'||queue||'"','null')||'}' as target_key,
  case kind when 'job_queue' then 'bullmq queue '||coalesce(queue,'dynamic queue')||'; job '||coalesce(job,'any/dynamic job')
   when 'microservice_message' then case when job is null then 'event ' else 'request-response ' end||coalesce(queue,'dynamic pattern')||'; client '||service_ns||'; transport '||coalesce(transport,'unknown transport') else coalesce(queue,'dynamic event') end as label
from fx_interactions""")
def target_keys(f: Facts) -> DataFrame:
    kind, queue, job = F.col("kind"), F.col("queue"), F.col("job")
    mode = F.when(job.isNull(), "event").otherwise("request_response")
    label = C.target_label(kind, queue=queue, job=job, mode=mode, client=F.col("service_ns"), transport=F.col("transport"))
    return f["fx_interactions"].select("interaction_id", C.target_key(kind=kind, queue=queue, job=job).alias("target_key"), label.alias("label"))


@query("f12_resource_label", """
select resource_id, 's3 '||operation||' '||case target_kind when 'exact' then target when 'symbolic' then '$'||target when 'dynamic' then '<dynamic>' else target||'/${0}' end as label from fx_resources""")
def resource_labels(f: Facts) -> DataFrame:
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    segments = F.array(part("literal", F.col("target")), part("literal", F.lit("/")), part("placeholder", F.lit("0")))
    return f["fx_resources"].select("resource_id", C.resource_label(F.lit("s3"), F.col("operation"), F.col("target_kind"), F.col("target"), segments).alias("label"))


STATES = """select c_nationkey, c_custkey, count(d.diagnostic_id) as n, count(case when severity='error' then 1 end) as errors
from customer left join fx_diagnostics d on d.subject_id='endpoint:'||c_custkey and side='after' group by c_nationkey, c_custkey"""


@query("f13_result_state", f"""
with s as (select c_nationkey, case when c_custkey % 3 = 0 and errors > 0 then 3 when n = 0 then 0 else 1 end as r from ({STATES}) x)
select c_nationkey, case max(r) when 3 then 'failed' when 1 then 'completed_with_gaps' else 'completed' end as state from s group by c_nationkey""")
def states(f: Facts) -> DataFrame:
    state = C.result_state(F.col("n"), F.col("errors"), F.col("c_custkey") % 3)
    return f.sql(STATES).withColumn("state", state).groupBy("c_nationkey").agg(C.combine_states(F.col("state")).alias("state"))


@query("v1_check_ids", f"""
select id, n, issue from (select id, count(*) as n, case when min(payload) <> max(payload) then 'id_collision' when count(*) > 1 then 'duplicate_id'
  when max(case when split_part(id, ':', 1) <> kind then 1 else 0 end) = 1 then 'wrong_prefix' end as issue from ({ENVELOPE}) e group by id) x where issue is not null""")
def ids(f: Facts) -> DataFrame:
    return integrity.check_ids(f.sql(f"select * from ({ENVELOPE}) t"))


EDGES = """select subject_id, 'ENDPOINT_IMPLEMENTED_BY' as predicate, object_id, status_rank from fx_impl
union all select subject_id, 'METHOD_CALLS_METHOD', object_id, status_rank from fx_calls union all select subject_id, predicate, object_id, status_rank from fx_access
union all select distinct subject_id, predicate, object_id, status_rank from fx_module_edges union all select subject_id, 'MODULE_OWNS_NOTHING', object_id, 1 from fx_impl where subject_id = 'endpoint:1'"""
RULES = "(values " + ",".join(f"('{p}','{s}','{o}')" for p, s, o in integrity.PREDICATE_KINDS) + ") as r(predicate, subject_kind, object_kind)"


@query("v2_check_references", f"""
with known as (select distinct id, kind from ({ENVELOPE}) e),
ends as (select e.predicate, 'subject' as "end", subject_id as id, subject_kind as want from ({EDGES}) e join {RULES} on e.predicate = r.predicate
  union all select e.predicate, 'object', object_id, object_kind from ({EDGES}) e join {RULES} on e.predicate = r.predicate)
select distinct predicate, 'predicate' as "end", predicate as id, 'unknown_predicate' as issue from ({EDGES}) e where predicate not in (select predicate from {RULES})
union all select distinct predicate, "end", e.id, case when kind is null then 'missing_reference' else 'wrong_kind' end as issue from ends e left join known k on k.id = e.id
where e.id is not null and (kind is null or kind <> want)""")
def references(f: Facts) -> DataFrame:
    return integrity.check_references(f.sql(f"select * from ({EDGES}) e"), f.sql(f"select * from ({ENVELOPE}) e"), f.sql(f"select * from {RULES}"))


PROVEN = f"select e.*, case when status_rank = 1 and subject_id like '%3' then 0 else 1 end as n_evidence from ({EDGES}) e"


@query("v3_check_assertions", f"""
select subject_id, predicate, object_id, case when status_rank <= 2 and object_id is null then 'target_missing' else 'evidence_missing' end as issue
from ({PROVEN}) p where (status_rank <= 2 and object_id is null) or (status_rank = 1 and n_evidence = 0)""")
def assertions(f: Facts) -> DataFrame:
    return integrity.check_assertions(f.sql(f"select * from ({PROVEN}) p"))


HASHED = """select evidence_id, e.file_id, case when start_line % 9 = 0 then end_line + 1 else start_line end as start_line, start_column, end_line, end_column,
case when start_column = 3 then 'stale' else f.content_hash end as content_hash from fx_evidence e left join fx_files f on f.file_id = e.file_id and f.side = 'after'"""


@query("v4_check_evidence", f"""
select evidence_id, file_id, issue from (select h.evidence_id, h.file_id, case when f.content_hash is null then 'file_missing' when h.content_hash <> f.content_hash then 'hash_differs'
 when start_line > end_line or (start_line = end_line and start_column > end_column) then 'range_reversed' end as issue
 from ({HASHED}) h left join (select * from fx_files where side='after') f on f.file_id = h.file_id) x where issue is not null""")
def evidence(f: Facts) -> DataFrame:
    return integrity.check_evidence(f.sql(f"select * from ({HASHED}) h"), f.side("fx_files"))


@query("v5_check_duplicate_refs", """
select conv_id, ref, count(*) as n from (select conv_id, role as ref from conversations) c group by conv_id, ref having count(*) > 1""")
def duplicate_refs(f: Facts) -> DataFrame:
    return integrity.check_duplicate_refs(f["conversations"].groupBy("conv_id").agg(F.collect_list("role").alias("refs")), "conv_id", "refs")


SLOTS = """select c_custkey as selector_id, case c_custkey % 3 when 0 then 'GET' when 1 then 'POST' else 'PUT' end as http_method,
'/'||case c_custkey % 3 when 0 then 'automobile' when 1 then 'building' else 'furniture' end||'/'||case when c_custkey % 5 = 0 then 'shared'||(c_custkey * 20 % 200) else 'c'||c_custkey end as path from customer"""


@query("q1_resolve_endpoints", f"""
select selector_id, case count(endpoint_id) when 0 then 'not_found' when 1 then 'resolved' else 'ambiguous' end as state, count(endpoint_id) as n_matches,
 array_to_string(list_sort(list(endpoint_id) filter (endpoint_id is not null)), ';') as endpoint_ids
from ({SLOTS}) s left join (select * from fx_endpoints where side='after') e on e.http_method = s.http_method and e.path = s.path group by selector_id""")
def resolve(f: Facts) -> DataFrame:
    out = select.resolve_endpoints(f.sql(SLOTS), f.side("fx_endpoints"))
    return out.withColumn("endpoint_ids", F.array_join("endpoint_ids", ";"))


POINTS = "select evidence_id as selector_id, file_id, start_line as line, start_column as \"column\" from fx_evidence"


@query("q2_resolve_symbols", f"""
with hits as (select p.selector_id, count(*) as n, min(region_id) as first from ({POINTS}) p join fx_regions r on r.file_id = p.file_id
 and (line, "column") >= (r.start_line, r.start_column) and (line, "column") < (r.end_line, r.end_column) group by p.selector_id)
select p.selector_id, case coalesce(n,0) when 0 then 'not_found' when 1 then 'resolved' else 'ambiguous' end as state, coalesce(n,0) as n_matches, case when n = 1 then first end as symbol_id
from ({POINTS}) p left join hits h on h.selector_id = p.selector_id""")
def symbols(f: Facts) -> DataFrame:
    points = f["fx_evidence"].select(F.col("evidence_id").alias("selector_id"), "file_id", F.col("start_line").alias("line"), F.col("start_column").alias("column"))
    return select.resolve_symbols(points, f["fx_regions"].withColumnRenamed("region_id", "symbol_id"))


@query("q3_list_endpoints", """
select endpoint_id, http_method, path from fx_endpoints e where side='after' and http_method in ('GET','POST') and path like '/a%'
and exists (select 1 from fx_diagnostics d where d.side='after' and d.subject_id = e.endpoint_id)""")
def listed(f: Facts) -> DataFrame:
    return select.list_endpoints(f.side("fx_endpoints"), f.side("fx_diagnostics"), ["GET", "POST"], "/a", True)


@query("q4_paginate", """
with c as (select count(*) as total, count(case when endpoint_id <= 'endpoint:12' then 1 end) as skipped from fx_endpoints where side='after')
select endpoint_id, http_method, path, total, skipped, greatest(total - skipped - 50, 0) as remaining
from (select * from fx_endpoints where side='after' and endpoint_id > 'endpoint:12' order by endpoint_id limit 50) e cross join c""")
def page(f: Facts) -> DataFrame:
    return select.paginate(f.side("fx_endpoints"), "endpoint_id", "endpoint:12", 50)


@query("q5_bounded_per_group", """
select conv_id, turn, role, total, least(total, 2) as returned, total - least(total, 2) as omitted, rank from (select conv_id, turn, role, count(*) over (partition by conv_id) as total,
 row_number() over (partition by conv_id order by turn, role) as rank from conversations) c where rank <= 2""")
def bounded(f: Facts) -> DataFrame:
    return select.bounded_per_group(f["conversations"].drop("text"), ["conv_id"], [F.col("turn"), F.col("role")], 2)


@query("q6_rank_findings", """
select diagnostic_id, code, severity, case severity when 'error' then 0 when 'warning' then 1 else 2 end as level from fx_diagnostics where side='after'
order by level, code, diagnostic_id limit 100""")
def ranked(f: Facts) -> DataFrame:
    return select.rank_findings(f.side("fx_diagnostics").select("diagnostic_id", "code", "severity"), 100)
