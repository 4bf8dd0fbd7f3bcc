"""Queries on joins, matching and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators import causal as K
from factgraph.operators import events as E
from factgraph.operators import matching as M
from factgraph.operators import reverse as R
from factgraph.operators import walk as W
from factgraph.plans.registry import query
from factgraph.sources.binding import Facts
from factgraph.sources.staging import stage

SERVED = "select 'endpoint:'||c_custkey as endpoint_id, 'svc'||(c_custkey%4) as service_ns from customer"
#: Endpoints of the after side and the methods that implement them: where walks begin.
SEEDS = "select subject_id as root, object_id as node, status_rank as rank from fx_impl where side='after' and status_rank <= 2 and object_id is not null"
CALLS = "select subject_id, object_id, status_rank from fx_calls where side='after' and status_rank <= 2"
#: The rows behind the calls, not grouped.
CALL_ROWS = "select object_id, status_rank from fx_call_rows where side='after'"
ACCESS = "select subject_id, object_id, predicate, status_rank from fx_access where side='after' and status_rank <= 2"


def reach_sql(seeds: str, edges: str, depth: int | None = 3) -> str:
    """r(root, node, rank, depth): all that a bounded walk reaches."""
    bound = f"where r.depth < {depth}" if depth is not None else ""
    level = "r.depth + 1" if depth is not None else "0"
    return f"""with recursive edges as ({edges}), r(root, node, rank, depth) as (
  select root, node, rank, 0 from ({seeds}) s union
  select r.root, e.object_id, greatest(r.rank, e.status_rank), {level} from r join edges e on e.subject_id = r.node {bound})"""


@query("j1_endpoint_catalogue", """
with e as (select *, count(*) over (partition by http_method, path) as in_slot from fx_endpoints where side='after')
select endpoint_id, http_method, path, i.object_id as method_id, m.class_id, c.file_id,
  case when in_slot > 1 then 'ambiguous' when i.object_id is null or i.status_rank > 2 then 'unresolved' when i.status_rank = 2 then 'ambiguous' else 'resolved' end as status
from e left join (select * from fx_impl where side='after') i on i.subject_id = e.endpoint_id left join fx_methods m on m.method_id = i.object_id left join fx_classes c on c.class_id = m.class_id""")
def catalogue(f: Facts) -> DataFrame:
    return M.endpoint_catalogue(f.side("fx_endpoints"), f.side("fx_impl"), f["fx_methods"], f["fx_classes"])


@query("j1_filtered_catalogue", """
with e as (select *, count(*) over (partition by http_method, path) as in_slot from fx_endpoints where side='after')
select endpoint_id, http_method, path, i.object_id as method_id, m.class_id, c.file_id,
  case when in_slot > 1 then 'ambiguous' when i.object_id is null or i.status_rank > 2 then 'unresolved' when i.status_rank = 2 then 'ambiguous' else 'resolved' end as status
from e left join (select * from fx_impl where side='after') i on i.subject_id = e.endpoint_id left join fx_methods m on m.method_id = i.object_id left join fx_classes c on c.class_id = m.class_id where path like '/building/%'""")
def filtered_catalogue(f: Facts) -> DataFrame:
    return M.endpoint_catalogue(f.side("fx_endpoints"), f.side("fx_impl"), f["fx_methods"], f["fx_classes"], route="/building")


@query("j2_effective_guards", f"""
with g as (select s.endpoint_id, guard_id, 'global' as scope, guard_order as place, 1 as status_rank from ({SERVED}) s join fx_global_guards gg on gg.service_ns = s.service_ns
 union all select endpoint_id, guard_id, scope, 0, status_rank from fx_guard_use)
select endpoint_id, guard_id, scope, row_number() over (partition by endpoint_id order by case scope when 'global' then 0 when 'controller' then 1 else 2 end, place, guard_id) as position,
 case status_rank when 1 then 'proven' else 'unproven' end as state from g""")
def guards(f: Facts) -> DataFrame:
    return M.effective_guards(f.sql(SERVED), f["fx_guard_use"], f["fx_global_guards"])


@query("j3_endpoint_authorization", """
select m.endpoint_id, m.metadata_id, metadata_key, scope, state, guard_id, evidence_id from fx_auth_metadata m join fx_auth_enforcement e on e.metadata_id = m.metadata_id""")
def authorization(f: Facts) -> DataFrame:
    return M.endpoint_authorization(f["fx_auth_metadata"], f["fx_auth_enforcement"])


@query("j4_evidence_locations", """
select 'method:o'||split_part(substr(evidence_id, 10), '_', 1) as method_id, array_to_string(list_sort(list_distinct(list(path||':'||start_line||':'||start_column))), ';') as locations
from fx_evidence e join fx_files f on f.file_id = e.file_id and f.side='after' group by 1""")
def located(f: Facts) -> DataFrame:
    ids = f["fx_evidence"].select(F.concat(F.lit("method:o"), F.substring_index(F.substring_index("evidence_id", ":", -1), "_", 1)).alias("method_id"), "evidence_id")
    return M.evidence_locations(ids.groupBy("method_id").agg(F.collect_list("evidence_id").alias("evidence_ids")), "method_id", f["fx_evidence"], f.side("fx_files"))


#: Of one contract; LOCAL within a service, MATCHES across all.
FITS = "h.kind = i.kind and h.queue = i.queue and (i.kind <> 'job_queue' or h.job is null or h.job = i.job) and (i.kind <> 'microservice_message' or (h.transport = i.transport and h.mode = i.mode))"
MATCHES = f"select interaction_id, handler_id from fx_interactions i join fx_handlers h on {FITS}"
LOCAL = f"{MATCHES} and h.service_ns = i.service_ns"


def local(f: Facts) -> DataFrame:
    return M.match_exact(f["fx_interactions"], f["fx_handlers"], ("service_ns",))


@query("j5_match_exact", LOCAL)
def exact(f: Facts) -> DataFrame:
    return local(f)


EVENTS = "select distinct replace(regexp_replace(url, '^https?://[^/]+/', ''), '/', '.') as event from pages"


@query("j6_match_wildcard", f"""
with rules as (select pattern, '^'||array_to_string(list_transform(string_split(pattern, '.'), lambda s: case s when '**' then '(?:[.][^.]*)*' when '*' then '[.][^.]*' else '[.]'||regexp_escape(s) end), '')||'$' as rx from fx_patterns)
select event, pattern from ({EVENTS}) e join rules on regexp_matches('.'||event, rx)""")
def wildcard(f: Facts) -> DataFrame:
    return E.match_wildcard(f.sql(EVENTS), f["fx_patterns"])


#: Pages send events of their address; every document listens to its name, by a pattern of its kind, in one of two applications.
SENT = """select 'page:'||page_id as interaction_id, case when page_id%19=0 then 'dynamic' when page_id%17=0 then 'symbol' else 'string' end as identity,
 replace(regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', ''), '/', case when page_id%3=0 then '::' else '.' end) as event, case when page_id%5=0 then null else 'app:'||(page_id%2) end as application_id from pages"""
HEARD = """select 'doc:'||doc_id as handler_id, case when doc_id%23=0 then 'symbol' else 'string' end as identity,
 case doc_id%6 when 0 then lang||'.'||doc_id when 1 then lang||'.*' when 2 then '*::'||doc_id when 3 then '**.'||doc_id when 4 then '**.'||lang||'.**' else '*.'||lang||'x*' end as value,
 case doc_id%6 when 0 then null when 2 then '::' else '.' end as delimiter, case when doc_id%7=0 then null else 'app:'||(doc_id%2) end as application_id from documents"""


@query("j6_match_events", f"""
with sent as ({SENT}), heard as ({HEARD}),
rules as (select * from heard
 where delimiter is not null and identity = 'string' and len(list_filter(string_split(value, delimiter), lambda s: contains(s, '*') and s not in ('*', '**'))) = 0)
select interaction_id, handler_id from sent s join heard h on h.identity = s.identity and h.value = s.event and h.delimiter is null and coalesce(s.application_id = h.application_id, true) where s.identity <> 'dynamic'
union all
select interaction_id, handler_id from sent s join rules r on s.identity = 'string' and coalesce(s.application_id = r.application_id, true)
 and case split_part(r.value, r.delimiter, 1) when '*' then list_slice(string_split(s.event, r.delimiter), 2, 1000) = list_slice(string_split(r.value, r.delimiter), 2, 1000) and len(string_split(s.event, r.delimiter)) = 2
 when '**' then case when ends_with(r.value, '**') then list_contains(string_split(s.event, r.delimiter), split_part(r.value, r.delimiter, 2)) else list_last(string_split(s.event, r.delimiter)) = split_part(r.value, r.delimiter, 2) end
 else string_split(s.event, r.delimiter)[1] = split_part(r.value, r.delimiter, 1) and len(string_split(s.event, r.delimiter)) = 2 end""")
def heard_events(f: Facts) -> DataFrame:
    return E.match_events(f.sql(SENT), f.sql(HEARD))


@query("j7_cap_fan_out", f"""
select x.interaction_id, handler_id, place, total, case when kind = 'microservice_message' and mode = 'request_response' and total > 1 then 'ambiguous' else 'resolved' end as state, case when total > 2 then 'FAN_OUT_LIMIT' end as diagnostic
from (select interaction_id, handler_id, row_number() over (partition by interaction_id order by handler_id) as place,
 count(*) over (partition by interaction_id) as total from ({LOCAL}) m) x join fx_interactions i on i.interaction_id = x.interaction_id where place <= 2""")
def capped(f: Facts) -> DataFrame:
    return M.cap_fan_out(local(f), f["fx_interactions"], 2)


@query("j8_select_branches", f"""
select m.interaction_id, branch_id, case when selector_kind = 'all_jobs' then 'matches' when selector_kind = 'unknown' or i.job is null then 'unknown'
  when selector_kind = 'exact_jobs' then case when list_contains(string_split(jobs, ','), i.job) then 'matches' else 'does_not_match' end
  else case when list_contains(string_split(jobs, ','), i.job) then 'does_not_match' else 'matches' end end as verdict
from ({LOCAL}) m join fx_interactions i on i.interaction_id = m.interaction_id join fx_branches b on b.handler_id = m.handler_id""")
def branches(f: Facts) -> DataFrame:
    return M.select_branches(local(f), f["fx_interactions"], f["fx_branches"])


@query("j9_attribute_regions", """
select evidence_id, region_id from fx_evidence e join fx_regions r on r.file_id = e.file_id and (e.start_line, e.start_column) >= (r.start_line, r.start_column) and (e.end_line, e.end_column) <= (r.end_line, r.end_column)""")
def regions(f: Facts) -> DataFrame:
    return M.attribute_regions(f["fx_evidence"], f["fx_regions"])


API = """select case c_mktsegment when 'AUTOMOBILE' then 'GET' when 'BUILDING' then 'POST' when 'FURNITURE' then 'PUT' when 'HOUSEHOLD' then 'PATCH' else 'HEAD' end as http_method,
'/'||lower(c_mktsegment)||'/'||case when c_custkey % 15 = 0 then 'shared'||(c_custkey%200) else 'c'||c_custkey end as path from customer"""


SLOTS = f"""select coalesce(a.http_method, b.http_method) as http_method, coalesce(a.path, b.path) as path, coalesce(theirs, 0) as theirs, coalesce(ours, 0) as ours, duplicates,
 case when theirs is null then 'not_listed' when ours is null then 'unmatched' when ours > 1 or theirs > 1 then 'ambiguous' else 'resolved' end as state
from (select http_method, path, count(*) as theirs from ({API}) x group by 1, 2) a
full outer join (select http_method, path, count(*) as ours, case when count(*) > 1 then array_to_string(list_sort(list(endpoint_id)), ';') end as duplicates from fx_endpoints where side='after' group by 1, 2) b
 on a.http_method = b.http_method and a.path = b.path"""


def api_slots(f: Facts) -> DataFrame:
    return M.match_api_slots(f.sql(API), f.side("fx_endpoints"))


@query("j10_match_api_slots", SLOTS)
def slots(f: Facts) -> DataFrame:
    return api_slots(f)


@query("j10_api_summary", f"select state, count(*) as slots, cast(sum(theirs) as bigint) as theirs, cast(sum(ours) as bigint) as ours from ({SLOTS}) s group by state")
def api_summary(f: Facts) -> DataFrame:
    return M.api_summary(api_slots(f))


@query("j11_bind_topology", """
select interaction_id, case when n = 1 then realm end as realm_id, case n when 0 then 'unbound' when 1 then 'bound' else 'conflict' end as state
from (select interaction_id, count(realm_id) as n, min(realm_id) as realm from fx_interactions i left join fx_bindings b on b.service_ns = i.service_ns and b.queue = i.queue group by interaction_id) x""")
def bound(f: Facts) -> DataFrame:
    return M.bind_topology(f["fx_interactions"], f["fx_bindings"])[0]


@query("j11_unused_bindings", "select service_ns, queue, realm_id from fx_bindings b where not exists (select 1 from fx_interactions i where i.service_ns = b.service_ns and i.queue = b.queue)")
def unused(f: Facts) -> DataFrame:
    return M.bind_topology(f["fx_interactions"], f["fx_bindings"])[1]


LINEAGE = """select o.origin_id, c.column_id, source_kind||case when selector is null then '' else '.'||selector end||'.'||property_path as label, coalesce(database_name, property_name) as column_name, hops,
 case state_rank when 1 then 'direct' when 2 then 'derived' else 'unknown' end as state
from fx_origins o join fx_parameters p on p.parameter_id = o.parameter_id join (select origin_id, column_id, max(state_rank) as state_rank, min(hops) as hops from fx_influences group by 1, 2) i on i.origin_id = o.origin_id
join fx_columns c on c.column_id = i.column_id"""


@query("j12_column_lineage", LINEAGE)
def lineage(f: Facts) -> DataFrame:
    return M.column_lineage(f["fx_parameters"], f["fx_origins"], f["fx_influences"], f["fx_columns"])


@query("g1_call_trace", reach_sql(SEEDS, CALLS) + f"""
select root, node as method_id, depth, depth = 3 and node in (select subject_id from edges) as gap from (select root, node, min(depth) as depth from r group by 1, 2) x""")
def call_trace(f: Facts) -> DataFrame:
    return W.call_trace(f.sql(SEEDS), f.side("fx_calls"))


STEPS = f"""select root, subject_id, object_id, depth, e.status_rank, e.object_id is not null and e.status_rank <= 2 as walked
from (select root, node, min(depth) as depth from r group by 1, 2) x join (select * from fx_calls where side='after') e on e.subject_id = x.node where depth < 3"""


@query("g1_call_steps", reach_sql(SEEDS, CALLS) + f"\n{STEPS}")
def call_steps(f: Facts) -> DataFrame:
    return W.trace_steps(W.walk(f.sql(SEEDS), f.sql(CALLS), 3), f.side("fx_calls"))


#: What a started interaction leads to, after the cap on fan-out.
CAPPED = "place <= 50 and "
HOPS = f"""select m.interaction_id, h.method_id, case when i.kind <> 'in_process_event' then 'distributed' when i.dispatch = 'asynchronous' or h.rule_id like '%.async.%' then 'local_async' else 'local_sync' end as label,
 case when i.kind = 'job_queue' and i.job is not null and h.handler_id in (select handler_id from fx_branches) then 'branches:'||h.handler_id||':'||i.job end as scope_id, h.handler_id, i.job
from (select interaction_id, handler_id, row_number() over (partition by interaction_id order by handler_id) as place, count(*) over (partition by interaction_id) as total from ({LOCAL}) l) m
join fx_interactions i on i.interaction_id = m.interaction_id join fx_handlers h on h.handler_id = m.handler_id
where {CAPPED}registration = 'proven_registered' and not (i.kind = 'microservice_message' and i.mode = 'request_response' and total > 1)
 and (i.kind <> 'in_process_event' or i.dispatch = 'asynchronous' or h.rule_id like '%.async.%' or h.rule_id like '%.sync.%')"""
PARTS = f"""hops as materialized ({HOPS}),
members as materialized (select scope_id, edge_id from fx_section_effects union select h.scope_id, f.edge_id from hops h join fx_branches b on b.handler_id = h.handler_id join fx_branch_effects f on f.branch_id = b.branch_id
  where h.scope_id is not null and (selector_kind = 'all_jobs' or (selector_kind = 'exact_jobs' and list_contains(string_split(jobs, ','), h.job)) or (selector_kind = 'unmatched_jobs' and not list_contains(string_split(jobs, ','), h.job)))),
scoped as materialized (select e.*, '' as scope from fx_edges e where edge_id not in (select edge_id from fx_section_effects) union all select e.*, m.scope_id from fx_edges e join members m on m.edge_id = e.edge_id),
own as materialized (select * from scoped where status_rank <= 2 and object_id is not null),
entered as (select s.method_id, s.scope_id, s.lock_edge_id from fx_sections s where lock_edge_id is not null and s.scope_id in (select scope_id from members)),
steps as materialized (select subject_id as method, scope, cast(null as varchar) as label, 0 as hops, 1 as calls, object_id as to_method, '' as to_scope from own where predicate = 'METHOD_CALLS_METHOD'
  union select method_id, '', 'critical_section', 0, 0, method_id, scope_id from entered
  union select method_id, m.scope_id, 'critical_section', 0, 0, method_id, e.scope_id from entered e join members m on m.edge_id = e.lock_edge_id where m.scope_id <> e.scope_id
  union select subject_id, scope, label, 1, 0, h.method_id, coalesce(h.scope_id, '') from own o join hops h on h.interaction_id = o.object_id where predicate = 'METHOD_INITIATES_INTERACTION')"""


def trace_sql(seeds: str, parts: str = PARTS) -> str:
    return f"""with recursive {parts},
r(root, method, scope, hop, class, depth) as (select root, node, '', 0, 'sync', 0 from ({seeds}) s union
  select r.root, to_method, to_scope, r.hop + s.hops, case when r.class = 'distributed' or s.label = 'distributed' then 'distributed' when r.class = 'critical_section' or s.label = 'critical_section' then 'critical_section' else coalesce(s.label, r.class) end,
   case when s.hops = 1 then 0 else r.depth + s.calls end from r join steps s on s.method = r.method and s.scope = r.scope
  where r.hop + s.hops <= 2 and case when s.hops = 1 then 0 else r.depth + s.calls end <= 3),
states as materialized (select root, method, scope, hop, class, min(depth) as depth from r group by 1, 2, 3, 4, 5),
terminals as (select t.root, t.method, t.class, predicate, object_id, min(status_rank) as rank from (select distinct root, method, scope, class from states) t
  join own o on o.subject_id = t.method and o.scope = t.scope where predicate in ('METHOD_ACCESSES_RESOURCE', 'METHOD_READS_TABLE', 'METHOD_WRITES_TABLE') group by 1, 2, 3, 4, 5),
gaps as (select root, method, 'CALL_DEPTH_LIMIT' as code from states t where depth = 3 and exists (select 1 from own o where o.subject_id = t.method and o.scope = t.scope and predicate = 'METHOD_CALLS_METHOD')
  union select root, method, 'INTERACTION_TRACE_LIMIT_REACHED' from states t where hop = 2 and exists (select 1 from steps s where s.hops = 1 and s.method = t.method and s.scope = t.scope)
  union select root, method, 'CALL_TARGET_UNRESOLVED' from states t where depth < 3 and exists (select 1 from scoped o where o.subject_id = t.method and o.scope = t.scope and predicate = 'METHOD_CALLS_METHOD' and (status_rank > 2 or object_id is null)))"""


class Trace:
    """The causal walk over the facts, with what it is made of."""

    def __init__(self, f: Facts, seeds: str, fan_out: int | None = 50):
        hops, chosen = K.contract_hops(f["fx_interactions"], f["fx_handlers"], f["fx_branches"], fan_out)
        members = stage(f["fx_section_effects"].unionByName(chosen.join(f["fx_branch_effects"], "branch_id").select("scope_id", "edge_id")).distinct(), "causal-members")
        starts = f.sql(seeds).select("root", F.col("node").alias("method"))
        met = stage(K.of_met(f["fx_edges"], starts, f["fx_handlers"].select(F.col("method_id").alias("method")), calls=f.sql(CALL_ROWS)), "causal-met")
        self.edges = stage(K.applying(met, members, f["fx_sections"]), "causal-edges")
        self.own = self.edges.where("status_rank <= 2 and object_id is not null")
        self.steps = stage(K.product_steps(self.own, members, f["fx_sections"], hops), "causal-steps")
        self.states = K.causal_states(starts, self.steps)

    def terminals(self) -> DataFrame:
        return K.causal_terminals(self.states, self.own)

    def gaps(self) -> DataFrame:
        return K.causal_gaps(self.states, self.own, self.steps, self.edges)


@query("g2_endpoint_trace", trace_sql(SEEDS) + "\nselect * from states")
def endpoint_trace(f: Facts) -> DataFrame:
    return Trace(f, SEEDS).states


@query("g2_trace_terminals", trace_sql(SEEDS, PARTS.replace(CAPPED, "")) + "\nselect * from terminals")
def trace_terminals(f: Facts) -> DataFrame:
    return Trace(f, SEEDS, fan_out=None).terminals()


@query("g2_trace_gaps", trace_sql(SEEDS) + "\nselect * from gaps")
def trace_gaps(f: Facts) -> DataFrame:
    return Trace(f, SEEDS).gaps()


@query("g2_state_limit", trace_sql(SEEDS) + """
select root, method, scope, hop, class, depth, total, case when total > 5 then 'INTERACTION_TRACE_LIMIT_REACHED' end as diagnostic from (select *, row_number() over (partition by root order by hop, depth, method, scope, class) as place, count(*) over (partition by root) as total from states) x where place <= 5""")
def state_limit(f: Facts) -> DataFrame:
    return W.limit_states(Trace(f, SEEDS).states, 5)


SUMMARY = """
select s.root, methods, hops, coalesce(sync_effects, 0) as sync_effects, coalesce(local_effects, 0) as local_effects, coalesce(critical_effects, 0) as critical_effects, coalesce(distributed_effects, 0) as distributed_effects,
 coalesce(resources, 0) as resources, coalesce(events, 0) as events, coalesce(messages, 0) as messages, coalesce(jobs, 0) as jobs, coalesce(codes, '') = '' as complete, coalesce(codes, '') as codes
from (select root, count(distinct method) as methods, max(hop) as hops from states group by root) s left join (
  select root, count(case when class = 'sync' then 1 end) as sync_effects, count(case when class in ('local_sync', 'local_async') then 1 end) as local_effects,
   count(case when class = 'critical_section' then 1 end) as critical_effects, count(case when class = 'distributed' then 1 end) as distributed_effects from terminals where predicate <> 'METHOD_ACCESSES_RESOURCE' group by root) e on e.root = s.root
 left join (select root, count(distinct object_id) as resources from terminals where predicate = 'METHOD_ACCESSES_RESOURCE' group by root) c on c.root = s.root
 left join (select root, count(case when kind = 'in_process_event' then 1 end) as events, count(case when kind = 'microservice_message' then 1 end) as messages, count(case when kind = 'job_queue' then 1 end) as jobs
  from (select distinct root, i.interaction_id, kind from states t join own o on o.subject_id = t.method and o.scope = t.scope and predicate = 'METHOD_INITIATES_INTERACTION' join fx_interactions i on i.interaction_id = o.object_id) d group by root) i on i.root = s.root
 left join (select root, array_to_string(list_sort(list_distinct(list(code))), ';') as codes from gaps group by root) g on g.root = s.root"""


@query("g4_trace_summary", trace_sql(SEEDS) + SUMMARY)
def trace_summary(f: Facts) -> DataFrame:
    t = Trace(f, SEEDS)
    started = t.own.where(F.col("predicate") == K.START).select(F.col("subject_id").alias("method"), "scope", F.col("object_id").alias("interaction_id")).join(f["fx_interactions"].select("interaction_id", "kind"), "interaction_id")
    return K.causal_summary(t.states, t.terminals(), started, t.gaps())


HANDLED = "select handler_id as root, method_id as node, 1 as rank from fx_handlers"


@query("g5_handler_trace", trace_sql(HANDLED) + "\nselect * from states")
def handler_trace(f: Facts) -> DataFrame:
    return Trace(f, HANDLED).states


@query("g5_handler_terminals", trace_sql(HANDLED) + "\nselect * from terminals")
def handler_terminals(f: Facts) -> DataFrame:
    return Trace(f, HANDLED).terminals()


#: Methods of files whose content changed.
CHANGED = "select distinct method_id as root from fx_methods m join fx_classes c on c.class_id = m.class_id join fx_files f on f.file_id = c.file_id and f.side = 'after' join documents on 'source:'||doc_id = f.file_id where doc_id%9=0 and doc_id%10<>7"


def paths_sql(depth: int = 3) -> str:
    return f"""with recursive back as (select object_id as subject_id, subject_id as object_id, status_rank from ({CALLS}) c),
p(root, node, path, rank, depth) as (select root, root, [root], 1, 0 from ({CHANGED}) t union all
  select p.root, b.object_id, list_append(p.path, b.object_id), greatest(p.rank, b.status_rank), p.depth + 1 from p join back b on b.subject_id = p.node where p.depth < {depth} and not list_contains(p.path, b.object_id))"""


@query("g6_symbol_dependents", paths_sql() + "\nselect root, node, count(*) as n_paths, min(depth) as depth, max(rank) = 2 as ambiguous from p where depth > 0 group by 1, 2")
def dependents(f: Facts) -> DataFrame:
    return W.symbol_dependents(f.sql(CHANGED), f.sql(CALLS))


IMPL = "select subject_id, object_id, status_rank from fx_impl where side='after' and status_rank <= 2 and object_id is not null"


@query("g7_paths_from_endpoints", paths_sql() + f"""
select p.root as target, i.subject_id as endpoint_id, count(*) as n_paths, min(depth) as depth, min(greatest(rank, status_rank)) as rank from p join ({IMPL}) i on i.object_id = p.node group by 1, 2""")
def endpoint_paths(f: Facts) -> DataFrame:
    found = W.paths_from_endpoints(f.sql(CHANGED), f.sql(CALLS), f.sql(IMPL))
    return found.groupBy("target", "endpoint_id").agg(F.count(F.lit(1)).alias("n_paths"), (F.min(F.size("path")) - 1).alias("depth"), F.min("rank").alias("rank"))


REVERSE_STEPS = f"""adds as (select edge_id, list_sort(list_distinct(list(selector_kind||'|'||jobs))) as adds from fx_branch_effects e join fx_branches b on b.branch_id = e.branch_id group by 1),
walked as (select e.*, coalesce(a.adds, []) as adds from fx_edges e left join adds a on a.edge_id = e.edge_id where status_rank <= 2 and object_id is not null and predicate in ('METHOD_CALLS_METHOD', 'METHOD_INITIATES_INTERACTION')),
named as (select *, {{contract}} as contract_id from fx_interactions where queue is not null and (kind <> 'microservice_message' or transport is not null and mode is not null)),
served as (select distinct c.contract_id, h.handler_id, h.method_id, c.kind, c.mode, c.job from (select distinct contract_id, service_ns, kind, queue, transport, mode, case when kind = 'job_queue' then job end as job from named) c join fx_handlers h on h.service_ns = c.service_ns and {FITS.replace("i.", "c.")}),
back as materialized (select object_id as node, subject_id as to_node, edge_id, status_rank, 1 as calls, 0 as hops, false as queued, cast(null as varchar) as job, adds from walked where predicate = 'METHOD_CALLS_METHOD'
 union all select method_id, contract_id, 'HANDLER|'||handler_id||'|'||contract_id, 1, 0, 1, kind = 'job_queue', job, [] from (select *, count(*) over (partition by contract_id) as total from served) s where not (kind = 'microservice_message' and mode = 'request_response' and total > 1)
 union all select contract_id, subject_id, edge_id, status_rank, 0, 0, false, null, adds from walked w join named n on n.interaction_id = w.object_id where predicate = 'METHOD_INITIATES_INTERACTION')"""
#: A contract as the matching names it.
REVERSE_STEPS = REVERSE_STEPS.format(contract="""'{{'||'"service_ns":"'||service_ns||'","kind":"'||kind||'","queue":"'||queue||'","way":"'||case when kind = 'microservice_message' then mode||'/'||transport else '' end||'"'
  ||case when kind = 'job_queue' and job is not null then ',"job":"'||job||'"' else '' end||case when mode is not null then ',"mode":"'||mode||'"' else '' end||'}}'""".replace("{{", "{").replace("}}", "}"))
RUNS = "not (queued and len(branches) > 0 and b.job is not null and len(list_filter(branches, lambda x: (split_part(x, '|', 1) = 'exact_jobs' and not list_contains(string_split(split_part(x, '|', 2), ','), b.job)) or (split_part(x, '|', 1) = 'unmatched_jobs' and list_contains(string_split(split_part(x, '|', 2), ','), b.job)))) = len(branches))"
WALKS = f"""with recursive {REVERSE_STEPS}, t as ({CHANGED}),
r(root, node, branches, calls, hops, rank) as (select root, root, cast([] as varchar[]), 0, 0, 1 from t union all
 select r.root, to_node, list_sort(list_distinct(list_concat(branches, adds))), r.calls + b.calls, r.hops + b.hops, greatest(rank, status_rank) from r join back b on b.node = r.node where {RUNS} and r.calls + b.calls <= 3 and r.hops + b.hops <= 2)"""


REACH = WALKS + f"""
select root as target, i.subject_id as endpoint_id, count(*) as walks, min(calls) as calls, min(hops) as hops, min(greatest(rank, status_rank)) as rank from r join ({IMPL}) i on i.object_id = r.node group by 1, 2"""


def reversed_walks(f: Facts, targets: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Walks back from targets (root), those of CHANGED if there are none given."""
    # All edges are read; what no endpoint's walk can meet is on no way back to one.
    met = K.of_met(f["fx_edges"], f.sql(IMPL).select(F.col("object_id").alias("method")), f["fx_handlers"].select(F.col("method_id").alias("method")), calls=f.sql(CALL_ROWS))
    steps = R.reverse_steps(met, f["fx_interactions"], f["fx_handlers"], f["fx_branches"], f["fx_branch_effects"])
    return R.reverse_rounds(f.sql(CHANGED) if targets is None else targets, stage(steps, "reverse-steps"))


@query("g7_endpoint_reach", REACH)
def endpoint_reach(f: Facts) -> DataFrame:
    return R.endpoint_reach(reversed_walks(f)[0], f.sql(IMPL))


#: The first three simple paths of each pair.
PATHS = f"""with recursive {REVERSE_STEPS}, t as ({CHANGED}),
r(root, node, branches, calls, hops, rank, path, edges) as (select root, root, cast([] as varchar[]), 0, 0, 1, [root], cast([] as varchar[]) from t union all
 select r.root, to_node, list_sort(list_distinct(list_concat(branches, adds))), r.calls + b.calls, r.hops + b.hops, greatest(rank, status_rank), list_prepend(to_node, path), list_prepend(edge_id, edges) from r join back b on b.node = r.node
 where {RUNS} and r.calls + b.calls <= 3 and r.hops + b.hops <= 2 and not list_contains(path, to_node)),
p as (select root as target, i.subject_id as endpoint_id, array_to_string(path, '>') as path, array_to_string(edges, '>') as edges, calls + 2 * hops as length, greatest(rank, status_rank) as rank from r join ({IMPL}) i on i.object_id = r.node)
select * from (select target, endpoint_id, row_number() over (partition by target, endpoint_id order by length, path, edges) as place, path, edges, length, rank from p) x where place <= 3"""


@query("g7_bounded_paths", PATHS)
def bounded_paths(f: Facts) -> DataFrame:
    return R.endpoint_paths(*reversed_walks(f), f.sql(IMPL), 3)


GAPS = "select distinct subject_id as node from fx_calls where side='after' and status_rank = 3"


@query("g8_path_incomplete", paths_sql() + f""", ends as (select p.*, i.subject_id as endpoint_id, greatest(rank, status_rank) as worst from p join ({IMPL}) i on i.object_id = p.node),
gaps as ({GAPS})
select endpoint_id, count(*) as n_paths, count(case when worst > 1 or list_has_any(path, (select list(node) from gaps)) then 1 end) as incomplete from ends group by endpoint_id""")
def incomplete(f: Facts) -> DataFrame:
    found = W.path_incomplete(W.paths_from_endpoints(f.sql(CHANGED), f.sql(CALLS), f.sql(IMPL)), f.sql(GAPS))
    return found.groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("n_paths"), F.count_if("incomplete").alias("incomplete"))


TERMINALS = reach_sql(SEEDS, CALLS) + f""", terminals as (
select root, predicate, a.object_id as table_id, min(greatest(rank, status_rank)) as rank, count(distinct node) as contributors from r join ({ACCESS}) a on a.subject_id = r.node group by 1, 2, 3)"""


@query("g9_terminal_facts", TERMINALS + "\nselect * from terminals")
def terminals(f: Facts) -> DataFrame:
    return W.terminal_facts(f.sql(SEEDS), f.sql(CALLS), f.sql(ACCESS))


RESOLVED = reach_sql(SEEDS + " and status_rank = 1", CALLS + " and status_rank = 1", None)


@query("g10_resolved_reach", RESOLVED + "\nselect distinct root, node from r")
def resolved(f: Facts) -> DataFrame:
    return W.resolved_reach(f.sql(SEEDS), f.sql(CALLS))


VISIBLE = """with recursive links as (select * from fx_module_edges where status_rank = 1 and object_id is not null), ex(a, root, node) as (select analysis_id, module_id, module_id from fx_modules union select ex.a, ex.root, e.object_id from ex join links e on e.analysis_id = ex.a and e.subject_id = ex.node and e.predicate = 'MODULE_EXPORTS_MODULE'),
exported as (select distinct a, root, object_id as class_id from ex join links e on e.analysis_id = ex.a and e.subject_id = ex.node and e.predicate = 'MODULE_EXPORTS_CLASS'),
visible as (select analysis_id, subject_id as module_id, object_id as class_id from links where predicate = 'MODULE_PROVIDES_CLASS'
 union select i.analysis_id, i.subject_id, x.class_id from links i join exported x on x.a = i.analysis_id and x.root = i.object_id where i.predicate = 'MODULE_IMPORTS_MODULE'
 union select m.analysis_id, m.module_id, x.class_id from fx_modules m join exported x on x.a = m.analysis_id join fx_modules g on g.analysis_id = x.a and g.module_id = x.root and g.is_global),
li(a, root, node) as (select analysis_id, module_id, module_id from fx_modules union select li.a, li.root, e.object_id from li join links e on e.analysis_id = li.a and e.subject_id = li.node and e.predicate = 'MODULE_IMPORTS_MODULE'),
broken as (select distinct li.a, li.root from li left join fx_modules b on b.analysis_id = li.a and b.module_id = li.node where b.module_id is null or b.completeness = 'incomplete'),
complete as (select m.analysis_id, m.module_id, b.root is null as complete from fx_modules m left join broken b on b.a = m.analysis_id and b.root = m.module_id)"""


@query("g11_module_visibility", VISIBLE + "\nselect analysis_id, module_id, class_id from visible")
def visibility(f: Facts) -> DataFrame:
    return W.module_visibility(f["fx_modules"], f["fx_module_edges"])[0]


@query("g11_module_completeness", VISIBLE + "\nselect analysis_id, module_id, complete from complete")
def completeness(f: Facts) -> DataFrame:
    return W.module_visibility(f["fx_modules"], f["fx_module_edges"])[1]


FROM = "select distinct method_id as root from fx_handlers"


@query("g13_shortest_path", f"""
with recursive p(root, node, path, depth) as (select root, root, [root], 0 from ({FROM}) t union all
 select p.root, c.object_id, list_append(p.path, c.object_id), p.depth + 1 from p join ({CALLS}) c on c.subject_id = p.node where p.depth < 3 and not list_contains(p.path, c.object_id))
select root, node, split_part(min(depth||'|'||array_to_string(path, '>')), '|', 2) as path, min(depth) as length from p group by 1, 2""")
def shortest(f: Facts) -> DataFrame:
    return W.shortest_path(f.sql(FROM), f.sql(CALLS))
