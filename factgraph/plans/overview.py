"""Queries across services, on metrics and the wide evidence row: the flagship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators import groups as G
from factgraph.operators import matching as M
from factgraph.operators import metrics as X
from factgraph.operators import system as S
from factgraph.operators import transitions as T
from factgraph.operators import walk as W
from factgraph.operators.diff import merge_ambiguities
from factgraph.operators.select import distributed_candidates
from factgraph.plans.change import ALL_IMPACT, P2, P8, RULES, TWICE, Sides, every_impact, keyed_sql, p2, p8, policies, rule_sql
from factgraph.plans.graph import ACCESS, CALLS, FITS, LINEAGE, MATCHES, SEEDS, SERVED, TERMINALS, reach_sql
from factgraph.plans.registry import query
from factgraph.sources.binding import Facts
from factgraph.sources.staging import stage

CONTRACT = """'{"job":'||coalesce('"'||case when kind = 'job_queue' then job end||'"','null')||',"kind":"'||kind||'","mode":'||coalesce('"'||mode||'"','null')||',"queue":'||coalesce('"'||queue||'"','null')||'}'"""
PROJECTED = f"""select record_id, service_ns, role, kind, queue, case when kind = 'job_queue' then job end as job, mode, {CONTRACT} as contract, reason is null as eligible, reason from (
select interaction_id as record_id, service_ns, 'producer' as role, kind, queue, job, mode, case when queue is null or (kind = 'job_queue' and job is null) then 'target identity is not exact' when activation not in ('eager', 'proven_activated') then 'activation is '||activation end as reason from fx_interactions
union all select handler_id, service_ns, 'consumer', kind, queue, job, mode, case when queue is null then 'handler target identity is not exact' when registration <> 'proven_registered' then 'registration is '||registration end from fx_handlers) p where kind <> 'in_process_event'"""


def projected(f: Facts) -> DataFrame:
    return S.project_system_endpoints(f["fx_interactions"], f["fx_handlers"])


@query("x1_project_endpoints", PROJECTED)
def project(f: Facts) -> DataFrame:
    return projected(f)


CORRELATED = f"""b as (select p.record_id, role, kind, queue, job, coalesce(mode, '') as mode, case when realms = 1 then realm end as realm, eligible and coalesce(realms, 0) < 2 as eligible
 from ({PROJECTED}) p left join (select service_ns as s, queue as q, min(realm_id) as realm, count(distinct realm_id) as realms from fx_bindings group by 1, 2) r on r.s = p.service_ns and r.q = p.queue),
fits as (select p.record_id as p_id, c.record_id as c_id, c.realm from b p join b c on c.kind = p.kind and c.queue = p.queue and c.mode = p.mode and (c.job is null or c.job = p.job) where p.role = 'producer' and p.eligible and c.role = 'consumer' and c.eligible),
hits as (select p_id, count(*) as n, min(realm) as lo, max(realm) as hi, count(realm) as bound from fits group by 1),
sides as (select *, case when realm is not null and bound = n and least(lo, realm) = greatest(hi, realm) then realm end as shared, n is not null and coalesce(least(lo, realm) <> greatest(hi, realm), false) as apart, n > 1 and (kind = 'job_queue' or mode = 'request_response') as several
 from b left join hits on p_id = record_id where role = 'producer'),
corr as (select record_id, role, case when not eligible or n is null or apart then 'unmatched' when several then 'ambiguous' when shared is not null then 'declared_realm_candidate' else 'target_only_candidate' end as state,
 case when not eligible then 'unsupported_identity' when n is null then case when kind in (select kind from b where role = 'consumer' and eligible) then 'target_mismatch' else 'producer_only' end when apart then 'realm_mismatch'
  when several then case when kind = 'job_queue' then 'multiple_job_consumers' else 'multiple_request_consumers' end end as reason, coalesce(n, 0) as consumers, case when not eligible or n is null then realm when not apart then shared end as broker_realm from sides
 union all select record_id, 'consumer', 'unmatched', case when eligible then 'consumer_only' else 'unsupported_identity' end, 0, realm from b where role = 'consumer' and record_id not in (select c_id from fits))"""


def correlated(f: Facts) -> DataFrame:
    return S.correlate(projected(f), f["fx_bindings"])


@query("x2_correlate", f"with {CORRELATED}\nselect * from corr")
def correlate(f: Facts) -> DataFrame:
    return correlated(f)


@query("q7_distributed_candidates", f"with {CORRELATED}\nselect c.record_id as interaction_id, state, i.kind, queue, job, consumers from corr c join fx_interactions i on i.interaction_id = c.record_id where state in ('target_only_candidate', 'ambiguous') and i.kind = 'job_queue'")
def candidates(f: Facts) -> DataFrame:
    corr = correlated(f).withColumnRenamed("record_id", "interaction_id").join(f["fx_interactions"].select("interaction_id", "kind"), "interaction_id")
    found = distributed_candidates(corr, ["job_queue"], ["target_only_candidate", "ambiguous"], f["fx_interactions"].select("interaction_id", "queue", "job"))
    return found.select("interaction_id", "state", "kind", "queue", "job", "consumers")


X4A = f"""with {CORRELATED}, v as (select record_id, case when role = 'consumer' then 1 when state = 'declared_realm_candidate' then 2 when state = 'ambiguous' or reason = 'unsupported_identity' then 3 else 4 end as c from corr),
rows_ as (select record_id as subject_key, ['not_applicable', 'pass', 'unknown', 'fail'][c] as outcome, ['declared_realm_candidate_unknown', 'declared_realm_candidate_found', 'declared_realm_candidate_unknown', 'declared_realm_candidate_missing'][c] as reason_code, '' as evidence_ids from v)"""
X4B = f"""with {CORRELATED}, v as (select record_id, case when role = 'consumer' then 1 when state = 'ambiguous' then 2 else 3 end as c from corr),
rows_ as (select record_id as subject_key, ['not_applicable', 'fail', 'pass'][c] as outcome, ['correlation_unambiguous', 'correlation_ambiguous', 'correlation_unambiguous'][c] as reason_code, '' as evidence_ids from v)"""


@query("x4_system_policies", f"select * from ({rule_sql('require-declared-realm-candidate', X4A)}) a union all select * from ({rule_sql('forbid-ambiguous-system-correlation', X4B)}) b")
def system_policies(f: Facts) -> DataFrame:
    return S.system_policies(correlated(f))


SERVICES = "select o.side, o.service_ns, h.handler_id, h.queue from fx_observations o join fx_handlers h on h.service_ns = o.service_ns where o.state = 'available'"


@query("x5_diff_services", f"""
select coalesce(b.service_ns, a.service_ns) as service_ns, coalesce(b.handler_id, a.handler_id) as handler_id, case when a.handler_id is null then case when o.state = 'missing' then 'unknown' else 'removed' end else 'added' end as change, cast(null as varchar) as reasons
from (select * from ({SERVICES}) x where side='before') b full outer join (select * from ({SERVICES}) y where side='after') a on a.service_ns = b.service_ns and a.handler_id = b.handler_id
left join fx_observations o on o.side='after' and o.service_ns = b.service_ns where a.handler_id is null or b.handler_id is null""")
def diff_services(f: Facts) -> DataFrame:
    rows = f.sql(SERVICES)
    return S.diff_systems(rows.where("side = 'before'"), rows.where("side = 'after'"), ["service_ns", "handler_id"], ["queue"], "service_ns", f["fx_observations"])


@query("x5_diff_realms", """
select coalesce(b.realm_id, a.realm_id) as realm_id, case when b.realm_id is null then 'added' when a.realm_id is null then 'removed' else 'modified' end as change, case when b.realm_id is not null and a.realm_id is not null then 'transport' end as reasons
from (select * from fx_realms where side='before') b full outer join (select * from fx_realms where side='after') a on a.realm_id = b.realm_id where a.realm_id is null or b.realm_id is null or a.transport <> b.transport""")
def diff_realms(f: Facts) -> DataFrame:
    return S.diff_keyed(f.side("fx_realms", "before"), f.side("fx_realms"), ["realm_id"], ["transport"])


#: The system on a side.
def sided_system(side: str) -> str:
    return CORRELATED.replace("from fx_interactions", f"from (select * from fx_interactions2 where side='{side}')").replace("from fx_handlers", f"from (select * from fx_handlers2 where side='{side}')").replace(
        "from fx_bindings", f"from (select * from ({BOUND}) y where side='{side}')"
    )


BOUND = "select side, service_ns, queue, case when side='after' and queue = 'q2' then 'realm:9' else realm_id end as realm_id from fx_bindings cross join fx_side where side='before' or queue <> 'q3'"


def sided_correlation(f: Facts, side: str) -> DataFrame:
    ends = S.project_system_endpoints(f.side("fx_interactions2", side), f.side("fx_handlers2", side))
    return S.correlate(ends, f.sql(BOUND).where(f"side = '{side}'").drop("side"))


BINDING_CHANGES = keyed_sql(f"({BOUND}) bound_", "service_ns, queue", "realm_id")
CORRELATION_CHANGES = f"""(select * from (select coalesce(b.record_id, a.record_id) as record_id, case when b.state is null then 'added' when a.state is null then case when coalesce(o.state, 'missing') = 'missing' then 'unknown' else 'removed' end
  when a.state = 'ambiguous' and b.state <> 'ambiguous' then 'became_ambiguous' when b.state = 'ambiguous' and a.state <> 'ambiguous' then 'no_longer_ambiguous' when b.state <> a.state then 'state_changed' when b.consumers <> a.consumers then 'candidates_changed' end as change,
  b.state as before_state, a.state as after_state, b.consumers as before_consumers, a.consumers as after_consumers
 from (with {sided_system('before')} select * from corr where role = 'producer') b full outer join (with {sided_system('after')} select * from corr where role = 'producer') a on a.record_id = b.record_id
 left join (select distinct interaction_id, service_ns from fx_interactions2) s on s.interaction_id = coalesce(b.record_id, a.record_id) left join fx_observations o on o.side = 'after' and o.service_ns = s.service_ns) d where change is not null)"""


def binding_changes(f: Facts) -> DataFrame:
    rows = f.sql(BOUND)
    return S.diff_keyed(rows.where("side = 'before'"), rows.where("side = 'after'"), ["service_ns", "queue"], ["realm_id"])


def correlation_changes(f: Facts) -> DataFrame:
    services = f["fx_interactions2"].select(F.col("interaction_id").alias("record_id"), "service_ns")
    return S.diff_correlations(sided_correlation(f, "before"), sided_correlation(f, "after"), services, f["fx_observations"])


@query("x5_diff_bindings", f"select * from {BINDING_CHANGES} d")
def diff_bindings(f: Facts) -> DataFrame:
    return binding_changes(f)


@query("x5_diff_correlations", f"select * from {CORRELATION_CHANGES} c")
def diff_correlations(f: Facts) -> DataFrame:
    return correlation_changes(f)


@query("x5_summary", f"select 'bindings' as family, change, count(*) as n from {BINDING_CHANGES} b group by change union all select 'correlations', change, count(*) from {CORRELATION_CHANGES} c group by change")
def system_summary(f: Facts) -> DataFrame:
    return S.system_summary({"bindings": binding_changes(f), "correlations": correlation_changes(f)})


def available(table: str, side: str) -> str:
    return f"(select * from {table} where side='{side}' and service_ns in (select o.service_ns from fx_observations o where o.side='{side}' and o.state = 'available'))"


def observed(text: str, side: str) -> str:
    """A text over the system as one of its sides, of the services whose artifacts are there."""
    text = text.replace("from fx_interactions", f"from {available('fx_interactions2', side)}").replace("from fx_handlers", f"from {available('fx_handlers2', side)}")
    return text.replace("from fx_bindings", f"from (select * from ({BOUND}) y where side='{side}')")


#: All artifacts that are not there taken for services that are not there, so that correlations can be compared.
SEEN = "select side, service_ns, case state when 'missing' then 'not_present' else state end as state from fx_observations"
TOPOLOGY = {"before": "available", "after": "available"}
TRANSPORTS = "select interaction_id as record_id, transport from fx_interactions union all select handler_id, transport from fx_handlers"


def observed_ends(f: Facts, side: str) -> tuple[DataFrame, DataFrame]:
    """The endpoints of a side and its bindings, staged, as a diff reads them several times."""
    there = lambda table: f.sql(f"select * from {available(table, side)} x").drop("side")
    ends = S.project_system_endpoints(there("fx_interactions2"), there("fx_handlers2"))
    return stage(ends, "system-ends"), stage(f.sql(BOUND).where(f"side = '{side}'").drop("side"), "system-bindings")


def differs(pairs: dict[str, str], noun: str) -> str:
    """Change and reasons of b and a, in SQL."""
    why = ", ".join(f"case when b.{c} is distinct from a.{c} then '{w}' end" for c, w in pairs.items())
    return f"""case when b.record_id is null then 'added' when a.record_id is null then 'removed' else 'modified' end as change,
 case when b.record_id is null then '{noun}_added' when a.record_id is null then '{noun}_removed' else concat_ws(';', {why}) end as reasons"""


def ends_sql(side: str, other: str) -> str:
    """The endpoints of a side whose service is known on the other."""
    return f"""(with {observed(CORRELATED, side)} select b.role, b.record_id, p.kind, p.contract, t.transport, b.realm from b join ({observed(PROJECTED, side)}) p on p.record_id = b.record_id
 join ({TRANSPORTS}) t on t.record_id = b.record_id where p.service_ns in (select service_ns from fx_observations o2 where o2.side = '{other}' and o2.state in ('available', 'not_present')))"""


def selected_sql(side: str) -> str:
    return f"""(with {observed(CORRELATED, side)}, sel as (select p_id, string_agg(c_id, ',' order by c_id) as sel from fits group by 1)
 select c.role, c.record_id, p.contract, c.state, case c.role when 'consumer' then 'own' else coalesce(sel, '0') end as selection, c.broker_realm, case when c.state = 'unmatched' then c.reason end as unmatched_reason, case when c.state = 'ambiguous' then c.reason end as ambiguity_reason
 from corr c join ({observed(PROJECTED, side)}) p on p.record_id = c.record_id left join sel on sel.p_id = c.record_id)"""


ENDPOINT_CHANGES = f"""(select * from (select coalesce(b.role, a.role) as role, coalesce(b.record_id, a.record_id) as record_id, {differs(T.ENDPOINT_REASONS, 'endpoint')}
 from {ends_sql('before', 'after')} b full outer join {ends_sql('after', 'before')} a on a.role = b.role and a.record_id = b.record_id) e where reasons <> '')"""
SELECTION_CHANGES = f"""(select * from (select coalesce(b.role, a.role) as role, coalesce(b.record_id, a.record_id) as record_id, {differs(T.CORRELATION_REASONS, 'correlation')}, b.state as before_state, a.state as after_state
 from {selected_sql('before')} b full outer join {selected_sql('after')} a on a.role = b.role and a.record_id = b.record_id) e where reasons <> '')"""
CANDIDATE_CHANGES = f"""(select *, 'candidate_'||change as reason from (select coalesce(b.record_id, a.record_id) as record_id, case when b.record_id is null then 'added' when a.record_id is null then 'removed' else 'modified' end as change, b.broker_realm as before_realm, a.broker_realm as after_realm
 from (select * from {selected_sql('before')} x where role = 'producer' and state = 'declared_realm_candidate') b full outer join (select * from {selected_sql('after')} y where role = 'producer' and state = 'declared_realm_candidate') a on a.record_id = b.record_id
 where b.selection is distinct from a.selection or b.broker_realm is distinct from a.broker_realm) c)"""
UNKNOWNS = """(select distinct 'SERVICE_ARTIFACT_'||upper(state) as code, side, 'service:'||service_ns as subject from fx_observations where state not in ('available', 'not_present')
 union all select distinct 'CORRELATION_FACTS_UNAVAILABLE', 'both', 'correlations' from fx_observations where state not in ('available', 'not_present'))"""


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", F.array_join("reasons", ";")).drop("before", "after")


def endpoint_changes(f: Facts) -> DataFrame:
    transports = f.sql(TRANSPORTS)
    sides = [T.bound_endpoints(*observed_ends(f, side)).join(transports, "record_id") for side in ("before", "after")]
    return T.diff_endpoints(*sides, f["fx_observations"])


def selection_changes(f: Facts) -> DataFrame:
    return T.diff_selections(T.selections(*observed_ends(f, "before")), T.selections(*observed_ends(f, "after")), f.sql(SEEN), TOPOLOGY)


@query("x5_diff_endpoints", f"select * from {ENDPOINT_CHANGES} e")
def diff_ends(f: Facts) -> DataFrame:
    return flat(endpoint_changes(f))


@query("x5_diff_selections", f"select * from {SELECTION_CHANGES} e")
def diff_chosen(f: Facts) -> DataFrame:
    rows = selection_changes(f)
    return flat(rows.withColumns({"before_state": F.col("before.state"), "after_state": F.col("after.state")}))


@query("x5_diff_candidates", f"select * from {CANDIDATE_CHANGES} c")
def diff_candidates(f: Facts) -> DataFrame:
    return T.diff_candidates(selection_changes(f))


def group_sql(side: str) -> str:
    return f"(with {observed(CORRELATED, side)} select kind, queue, mode, job, record_id from b where role = 'consumer' and eligible)"


@query("x5_changed_members", f"""
select coalesce(b.kind, a.kind) as kind, coalesce(b.queue, a.queue) as queue, coalesce(b.mode, a.mode) as mode, coalesce(b.job, a.job) as their_job, coalesce(b.record_id, a.record_id) as record_id, case when b.record_id is null then 'added' else 'removed' end as change
from {group_sql('before')} b full outer join {group_sql('after')} a on a.record_id = b.record_id and a.kind = b.kind and a.queue = b.queue and a.mode = b.mode and a.job is not distinct from b.job where a.record_id is null or b.record_id is null""")
def changed_members(f: Facts) -> DataFrame:
    return T.changed_members(*[T.consumer_groups(*observed_ends(f, side)) for side in ("before", "after")])


@query("x5_uncertainties", f"select * from {UNKNOWNS} u")
def unknowns(f: Facts) -> DataFrame:
    return T.uncertainties(f["fx_observations"], TOPOLOGY, {})


@query("x5_transition_summary", f"""
select role||'s' as family, change, count(*) as n from {ENDPOINT_CHANGES} e group by 1, 2 union all select 'correlations', change, count(*) from {SELECTION_CHANGES} s group by 2
union all select 'candidates', change, count(*) from {CANDIDATE_CHANGES} c group by 2 union all select 'uncertainties', code, count(*) from {UNKNOWNS} u group by 2
union all select * from (select 'ambiguities', case when coalesce(before_state, '') <> 'ambiguous' and coalesce(after_state, '') = 'ambiguous' then 'introduced' when coalesce(before_state, '') = 'ambiguous' and coalesce(after_state, '') <> 'ambiguous' then 'resolved' end as change, count(*) from {SELECTION_CHANGES} t group by 2) v where change is not null""")
def transition_summary(f: Facts) -> DataFrame:
    ends, chosen = stage(endpoint_changes(f), "endpoint-changes"), stage(selection_changes(f), "selection-changes")
    parts = {f"{r}s": ends.where(F.col("role") == r) for r in ("producer", "consumer")}
    return T.transition_summary({**parts, "correlations": chosen, "candidates": T.diff_candidates(chosen)}, chosen, T.uncertainties(f["fx_observations"], TOPOLOGY, {}))


ROOTS = f"select s.root as seed, i.interaction_id from ({SEEDS}) s join fx_interactions i on i.source_method_id = s.node"
CONSUMERS = "select handler_id as root, method_id as node, 1 as rank from fx_handlers"
#: The producers that a handler's calls lead to.
ONWARD = f"select distinct w.root as handler_id, i.interaction_id from ({reach_sql(CONSUMERS, CALLS)} select distinct root, node from r) w join fx_interactions i on i.source_method_id = w.node"
HOPPED = f"""with recursive m as ({MATCHES}), onward as ({ONWARD}), seeds as (select distinct seed, interaction_id from ({ROOTS}) r0),
p(seed, interaction_id, hop) as (select seed, interaction_id, 1 from seeds union select p.seed, o.interaction_id, p.hop + 1 from p join m on m.interaction_id = p.interaction_id join onward o on o.handler_id = m.handler_id where p.hop < 4),
least_ as (select seed, interaction_id, min(hop) as hop from p group by 1, 2),
links as (select seed, hop, l.interaction_id, handler_id from least_ l join m on m.interaction_id = l.interaction_id)"""


def onward_places(f: Facts) -> DataFrame:
    return W.walk(f.sql(CONSUMERS), f.sql(CALLS), 3).select(F.col("root").alias("handler_id"), F.col("node").alias("place")).distinct()


def onward(f: Facts) -> DataFrame:
    sent = f["fx_interactions"].select("interaction_id", F.col("source_method_id").alias("place"))
    return onward_places(f).join(sent, "place").select("handler_id", "interaction_id").distinct()


class Places:
    """Propagation by the methods that send: where each seed meets them, where its paths end, and what the methods send."""

    def __init__(self, f: Facts):
        self.f = f
        self.sent = stage(f["fx_interactions"].where("source_method_id is not null").select(F.col("source_method_id").alias("place"), "interaction_id").distinct(), "sent")
        self.fits = stage(self.sent.join(M.match_exact(f["fx_interactions"], f["fx_handlers"]), "interaction_id"), "fits")
        places = self.sent.select("place").distinct()
        seeds = f.sql(SEEDS).select(F.col("root").alias("seed"), F.col("node").alias("place")).join(places, "place")
        self.states, self.cut = S.propagate_places(seeds, self.fits, onward_places(f).join(places, "place"))

    def marked(self) -> DataFrame:
        return stage(S.marked_fits(self.fits, self.f["fx_interactions"], self.f.sql(EFFECTS), self.f["fx_handlers"]), "marked-fits")


@query("x7_propagate", HOPPED + "\nselect * from links")
def propagate(f: Facts) -> DataFrame:
    p = Places(f)
    return S.place_links(p.states, p.fits)


@query("x7_truncations", HOPPED + """
, ahead as (select distinct l.seed, o.interaction_id, l.hop from links l join onward o on o.handler_id = l.handler_id)
select distinct a.seed, a.interaction_id, case when x.hop <= a.hop then 'cycle' else 'hop_limit' end as reason from ahead a left join least_ x on x.seed = a.seed and x.interaction_id = a.interaction_id where x.hop <= a.hop or (x.hop is null and a.hop = 4)""")
def truncations(f: Facts) -> DataFrame:
    p = Places(f)
    return p.cut.join(p.sent, "place").select("seed", "interaction_id", "reason")


EFFECT_ROWS = f"select h.handler_id, a.predicate, a.object_id as table_id, a.status_rank from fx_handlers h join ({ACCESS}) a on a.subject_id = h.method_id"


@query("x7_effects", HOPPED + f"""
select seed, predicate, table_id, min(hop) as hop, bool_or(status_rank = 1) as certain from links l join ({EFFECT_ROWS}) e on e.handler_id = l.handler_id group by 1, 2, 3""")
def effects(f: Facts) -> DataFrame:
    p = Places(f)
    return S.place_effects(p.states, p.fits, f.sql(EFFECT_ROWS))


@query("x7_propagation_summary", HOPPED + "\nselect hop, count(distinct seed) as seeds, count(distinct interaction_id) as producers, count(distinct handler_id) as consumers, count(*) as links from links group by hop")
def propagation_summary(f: Facts) -> DataFrame:
    p = Places(f)
    return S.place_summary(p.states, p.fits)


EFFECTS = f"select h.handler_id, count(*) as n_effects, bool_and(a.status_rank = 1) as certain from fx_handlers h join ({ACCESS}) a on a.subject_id = h.method_id group by 1"
PATHS = HOPPED + f""", paths as (select seed, hop, l.interaction_id, i.queue, l.handler_id, coalesce(n_effects, 0) as n_effects, i.activation in ('proven_activated', 'eager') and h.registration = 'proven_registered' and coalesce(certain, true) as complete
 from links l join fx_interactions i on i.interaction_id = l.interaction_id join fx_handlers h on h.handler_id = l.handler_id left join ({EFFECTS}) e on e.handler_id = l.handler_id)"""


@query("x9_conditional_paths", PATHS + "\nselect * from paths")
def conditional_paths(f: Facts) -> DataFrame:
    p = Places(f)
    return S.place_paths(p.states, p.marked())


@query("x10_path_graph", PATHS + """, at_ as (select 'root' as kind, seed as node_id, hop, complete from paths union all select 'producer', interaction_id, hop, complete from paths union all select 'consumer', handler_id, hop, complete from paths)
select kind, node_id, count(*) as n_paths, min(hop) as hop, case when bool_and(complete) then 'proven' else 'conditional' end as state from at_ group by 1, 2""")
def path_graph(f: Facts) -> DataFrame:
    p = Places(f)
    return S.place_graph(p.states, p.marked())


@query("x10_path_edges", PATHS + """, at_ as (select seed as source, interaction_id as target, hop, complete from paths union all select interaction_id, handler_id, hop, complete from paths)
select source, target, count(*) as n_paths, min(hop) as hop, case when bool_and(complete) then 'proven' else 'conditional' end as state from at_ group by 1, 2""")
def path_edges(f: Facts) -> DataFrame:
    p = Places(f)
    return S.place_edges(p.states, p.marked())


#: Small enough to be met on the test tables.
LIMITS = G.Limits(hops=3, paths=8, effects=2, states=6)
GROUPED = f"""with recursive onward as materialized ({ONWARD}), named as (select interaction_id, kind, queue, case when kind = 'job_queue' then job end as job, mode, transport, '{{"kind":"'||kind||'","queue":"'||queue||'","way":"'||case when kind = 'microservice_message' then mode||'/'||transport else '' end||'"'
  ||case when kind = 'job_queue' and job is not null then ',"job":"'||job||'"' else '' end||case when mode is not null then ',"mode":"'||mode||'"' else '' end||'}}' as contract_id from fx_interactions where queue is not null and (kind <> 'microservice_message' or transport is not null and mode is not null)),
members as materialized (select distinct c.contract_id, h.handler_id from (select distinct contract_id, kind, queue, job, mode, transport from named) c join fx_handlers h on {FITS.replace("i.", "c.")}),
graph as materialized (select distinct m.contract_id, n.contract_id as next_id from members m join onward o on o.handler_id = m.handler_id join named n on n.interaction_id = o.interaction_id),
w(seed, contract_id, hop) as (select distinct r.seed, n.contract_id, 1 from ({ROOTS}) r join named n on n.interaction_id = r.interaction_id union select w.seed, g.next_id, w.hop + 1 from w join graph g on g.contract_id = w.contract_id where w.hop < 4),
least_ as (select seed, contract_id, min(hop) as hop from w group by 1, 2),
ranked as (select *, row_number() over (partition by seed order by hop, contract_id) as place from least_),
kept as (select seed, hop, contract_id from ranked where place <= {LIMITS.states} and hop <= {LIMITS.hops}),
full_ as (select seed, min(hop) as hop from ranked where place > {LIMITS.states} and hop <= {LIMITS.hops} group by 1),
over_ as (select r.seed, 'state_limit' as reason, r.contract_id from ranked r join full_ f on f.seed = r.seed and f.hop = r.hop where place > {LIMITS.states}
 union select k.seed, case when l.hop <= k.hop then 'cycle' else 'hop_limit' end, g.next_id from kept k join graph g on g.contract_id = k.contract_id join least_ l on l.seed = k.seed and l.contract_id = g.next_id left join full_ f on f.seed = k.seed
  where (f.hop is null or k.hop < f.hop) and (l.hop <= k.hop or k.hop = {LIMITS.hops})),
placed as (select k.*, size, sum(size) over (partition by seed order by hop, k.contract_id) - size as start from kept k join (select contract_id, count(*) as size from members group by 1) z on z.contract_id = k.contract_id),
routes as (select seed, hop, p.contract_id, handler_id from placed p join (select *, row_number() over (partition by contract_id order by handler_id) as place from members) m on m.contract_id = p.contract_id where start + m.place <= {LIMITS.paths}),
own_ as (select handler_id, predicate, table_id, min(status_rank) as rank from ({EFFECT_ROWS}) e group by 1, 2, 3),
first_ as (select *, row_number() over (partition by handler_id order by predicate, table_id) as place, count(*) over (partition by handler_id) as of_ from own_),
at_ as (select seed, handler_id, min(hop) as hop from routes group by 1, 2)"""


class Propagation:
    """Seeds through contract groups, with what each limit leaves out."""

    def __init__(self, f: Facts):
        members, graph, keys = G.contract_groups(f["fx_interactions"], f["fx_handlers"], onward(f))
        self.states, self.cut = G.propagate_groups(f.sql(ROOTS).join(keys, "interaction_id").select("seed", "contract_id"), graph, LIMITS)
        self.paths, self.paths_left = G.expand_groups(self.states, members, LIMITS)
        self.effects, self.effects_left = G.limited_effects(self.paths, f.sql(EFFECT_ROWS), LIMITS)


@query("x7_group_states", GROUPED + "\nselect * from kept")
def group_states(f: Facts) -> DataFrame:
    return Propagation(f).states


@query("x7_group_effects", GROUPED + "\nselect seed, a.handler_id, hop, predicate, table_id, rank = 1 as certain from at_ a join first_ e on e.handler_id = a.handler_id where place <= 2")
def group_effects(f: Facts) -> DataFrame:
    return Propagation(f).effects


@query("x7_group_truncations", GROUPED + f"""
select seed, reason, count(*) as n from over_ group by 1, 2 union all select seed, 'path_limit', cast(sum(size) as bigint) - {LIMITS.paths} from placed group by 1 having sum(size) > {LIMITS.paths}
union all select seed, 'effect_limit', cast(sum(of_ - {LIMITS.effects}) as bigint) from at_ a join (select distinct handler_id, of_ from first_ where of_ > {LIMITS.effects}) e on e.handler_id = a.handler_id group by 1""")
def group_truncations(f: Facts) -> DataFrame:
    p = Propagation(f)
    return p.cut.unionByName(p.paths_left).unionByName(p.effects_left)


@query("x9_group_paths", GROUPED + "\nselect * from routes")
def group_paths(f: Facts) -> DataFrame:
    return Propagation(f).paths


FAN = """with c as (select distinct subject_id, object_id from fx_calls where side='after' and status_rank = 1)
select method_id, coalesce(i.n, 0) as fan_in, coalesce(o.n, 0) as fan_out from fx_methods m left join (select object_id, count(*) as n from c group by 1) i on i.object_id = m.method_id left join (select subject_id, count(*) as n from c group by 1) o on o.subject_id = m.method_id"""


def fan(f: Facts) -> DataFrame:
    return X.call_fan(f["fx_methods"], f.side("fx_calls"))


@query("m1_call_fan", FAN)
def call_fan(f: Facts) -> DataFrame:
    return fan(f)


HANDLER_SEEDS = "select handler_id as root, method_id as node, 1 as rank from fx_handlers"
SURE = CALLS + " and status_rank = 1"


@query("m2_reach_counts", f"""
with e as ({reach_sql(SEEDS + ' and status_rank = 1', SURE)} select distinct root, node from r), h as ({reach_sql(HANDLER_SEEDS, SURE)} select distinct root, node from r)
select node, count(case when kind = 'e' then 1 end) as endpoints, count(case when kind = 'h' then 1 end) as handlers from (select 'e' as kind, * from e union all select 'h', * from h) x group by node""")
def reach_counts(f: Facts) -> DataFrame:
    return X.reach_counts(W.resolved_reach(f.sql(SEEDS), f.sql(CALLS), 3), W.resolved_reach(f.sql(HANDLER_SEEDS), f.sql(CALLS), 3))


VALUES = f"(select 'fan_in' as metric, fan_in as value, method_id from ({FAN}) a union all select 'fan_out', fan_out, method_id from ({FAN}) b)"
LEGEND = f"""(select metric, min(case when upto * 100 >= total * 50 then value end) as p50, min(case when upto * 100 >= total * 75 then value end) as p75, min(case when upto * 100 >= total * 90 then value end) as p90, max(value) as max, max(total) as n
 from (select metric, value, row_number() over (partition by metric order by value, method_id) as upto, count(*) over (partition by metric) as total from {VALUES} v) q group by metric)"""


def values(f: Facts) -> DataFrame:
    rows = fan(f)
    part = lambda m: rows.select(F.lit(m).alias("metric"), F.col(m).alias("value"), "method_id")
    return part("fan_in").unionByName(part("fan_out"))


@query("m3_metric_legend", f"select * from {LEGEND} l")
def legend(f: Facts) -> DataFrame:
    return X.metric_legend(values(f))


@query("m3_heat", f"""select v.metric, value, method_id, case when value = 0 then 'zero' when value <= p50 then 'low' when value <= p75 then 'medium' when value <= p90 then 'high' else 'very_high' end as band from {VALUES} v join {LEGEND} l on l.metric = v.metric""")
def heat(f: Facts) -> DataFrame:
    return X.heat(values(f), X.metric_legend(values(f)))


#: Classes with the document that they stand in; some documents have no modules.
CLASSES = "select case when doc_id % 13 = 0 then 'bare' else 'svc'||(doc_id%n_suppliers) end as analysis_id, 'class:'||doc_id as class_id from documents cross join fx_size"
OWNED = f"""select analysis_id, class_id, state, case when state = 'uniquely_owned' then first end as owner from (select c.analysis_id, c.class_id, first, case when open_ is null then 'unavailable' when odd then 'ownership_unknown' when n = 1 then 'uniquely_owned' when n > 1 then 'multiple_owners'
  when open_ then 'ownership_unknown' else 'not_declared_by_supported_modules' end as state from ({CLASSES}) c
 left join (select analysis_id, object_id, count(distinct case when status_rank = 1 then subject_id end) as n, min(case when status_rank = 1 then subject_id end) as first, bool_or(status_rank > 1) as odd from fx_module_edges
  where predicate in ('MODULE_PROVIDES_CLASS', 'MODULE_DECLARES_CONTROLLER') group by 1, 2) o on o.analysis_id = c.analysis_id and o.object_id = c.class_id
 left join (select analysis_id, bool_or(completeness = 'incomplete') as open_ from fx_modules group by 1) m on m.analysis_id = c.analysis_id) x"""


@query("m5_module_ownership", OWNED)
def ownership(f: Facts) -> DataFrame:
    return X.module_ownership(f.sql(CLASSES), f["fx_module_edges"], f["fx_modules"])


@query("m5_architecture_summary", f"select state, count(*) as n, count(owner) as owned from ({OWNED}) o group by state")
def summary(f: Facts) -> DataFrame:
    return X.architecture_summary(X.module_ownership(f.sql(CLASSES), f["fx_module_edges"], f["fx_modules"]))


def named_rules(rules: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [rows.select(F.lit(rule).alias("rule_id"), "subject_key", "outcome", "reason_code") for rule, rows in rules.items()])


GUARDS = f"""g0 as (select s.endpoint_id, guard_id, 0 as scope_rank, guard_order as place, 1 as status_rank from ({SERVED}) s join fx_global_guards gg on gg.service_ns = s.service_ns
 union all select endpoint_id, guard_id, case scope when 'controller' then 1 else 2 end, 0, status_rank from fx_guard_use),
g as (select endpoint_id, string_agg(guard_id, '; ' order by scope_rank, place, guard_id) as guards, count(case when status_rank = 1 then 1 end) as proven_guards from g0 group by 1)"""


@query("m7_control_evidence", TERMINALS + f""", {GUARDS},
t as (select root as endpoint_id, coalesce(array_to_string(list_sort(list_distinct(list(table_id) filter (predicate = 'METHOD_READS_TABLE'))), '; '), '') as db_reads,
 coalesce(array_to_string(list_sort(list_distinct(list(table_id) filter (predicate = 'METHOD_WRITES_TABLE'))), '; '), '') as db_writes, min(case when predicate = 'METHOD_WRITES_TABLE' then rank end) as write_rank from terminals group by 1),
lin as (select method_id, count(distinct (label, column_name)) as lineage_columns from ({LINEAGE}) x join fx_origins o on o.origin_id = x.origin_id join fx_parameters p on p.parameter_id = o.parameter_id group by 1),
txt as (select method_id, string_agg(distinct label||' > '||column_name||' ('||state||')', '; ' order by label||' > '||column_name||' ('||state||')') as lineage from ({LINEAGE}) x join fx_origins o on o.origin_id = x.origin_id join fx_parameters p on p.parameter_id = o.parameter_id group by 1),
sent as (select root, string_agg(distinct kind||' '||coalesce(queue, '?'), '; ' order by kind||' '||coalesce(queue, '?')) as interactions from (select distinct root, node from r) w join fx_interactions i on i.source_method_id = w.node group by 1),
site as (select m.method_id, min(f.path) as location from fx_methods m join fx_classes c on c.class_id = m.class_id join fx_files f on f.side='after' and f.file_id = c.file_id group by 1),
pol as (select subject_key, count(case when outcome = 'fail' then 1 end) as failed_rules, array_to_string(list_sort(list(rule_id||' '||outcome||' '||reason_code)), '; ') as rules
 from (select * from ({rule_sql('authorization', P8)}) y union all select * from ({rule_sql('guard_on_write', P2, on_unknown='error')}) z) u where outcome <> 'not_applicable' group by 1),
e as (select *, count(*) over (partition by http_method, path) as in_slot from fx_endpoints where side='after'),
cat as (select endpoint_id, http_method, path, i.object_id as method_id, case when in_slot > 1 then 'ambiguous' when i.object_id is null or i.status_rank > 2 then 'unresolved' when i.status_rank = 2 then 'ambiguous' else 'resolved' end as status
 from e left join (select * from fx_impl where side='after') i on i.subject_id = e.endpoint_id)
select c.endpoint_id, http_method, path, status, coalesce(guards, '') as guards, coalesce(proven_guards, 0) as proven_guards, coalesce(db_reads, '') as db_reads, coalesce(db_writes, '') as db_writes,
 case when write_rank = 1 then 'write' when write_rank is not null or status <> 'resolved' then 'unknown' else 'non_write' end as mutation, coalesce(lineage_columns, 0) as lineage_columns, coalesce(failed_rules, 0) as failed_rules, coalesce(rules, '') as rules,
 coalesce(lineage, '') as lineage, coalesce(interactions, '') as interactions, location
from cat c left join g on g.endpoint_id = c.endpoint_id left join t on t.endpoint_id = c.endpoint_id left join lin on lin.method_id = c.method_id left join pol on pol.subject_key = c.endpoint_id left join txt on txt.method_id = c.method_id left join sent on sent.root = c.endpoint_id left join site on site.method_id = c.method_id""")
def control_evidence(f: Facts) -> DataFrame:
    catalogue = M.endpoint_catalogue(f.side("fx_endpoints"), f.side("fx_impl"), f["fx_methods"], f["fx_classes"])
    guards = M.effective_guards(f.sql(SERVED), f["fx_guard_use"], f["fx_global_guards"])
    reached = W.walk(f.sql(SEEDS), f.sql(CALLS), 3)
    terminals = W.terminals_of(reached, f.sql(ACCESS))
    sent = reached.select("root", F.col("node").alias("source_method_id")).distinct().join(f["fx_interactions"].select("source_method_id", "kind", "queue"), "source_method_id")
    lineage = M.column_lineage(f["fx_parameters"], f["fx_origins"], f["fx_influences"], f["fx_columns"])
    methods = f["fx_origins"].join(f["fx_parameters"], "parameter_id").select("origin_id", "method_id")
    return X.control_evidence(catalogue, guards, terminals, lineage.join(methods, "origin_id"), named_rules({"authorization": p8(f), "guard_on_write": p2(f, reached)}), sent.select("root", "kind", "queue"), f.side("fx_files"))


SCENES = f"select s.root, c.subject_id as source, c.object_id as target, c.status_rank as kind_rank, c.subject_id||'>'||c.object_id as edge_id from ({SEEDS}) s join fx_calls c on c.side='after' and c.subject_id = s.node and c.object_id is not null"


@query("m8_bounded_scene", f"""
with recursive o as (select *, row_number() over (partition by root order by kind_rank, edge_id) as i, count(*) over (partition by root) as total from ({SCENES}) e),
s(root, i, nodes, kept, taken) as (select distinct root, 0::bigint, [root], 0, null::varchar from o union all
 select o.root, o.i, case when kept < 6 and len(list_distinct(nodes||[source, target])) <= 4 then list_distinct(nodes||[source, target]) else nodes end,
  kept + case when kept < 6 and len(list_distinct(nodes||[source, target])) <= 4 then 1 else 0 end, case when kept < 6 and len(list_distinct(nodes||[source, target])) <= 4 then edge_id end
 from s join o on o.root = s.root and o.i = s.i + 1)
select s.root, taken as edge_id, e.n_nodes, e.total - e.kept as omitted from s join (select s.root, len(s.nodes) as n_nodes, s.kept, o.total from s join o on o.root = s.root and o.i = s.i where s.i = o.total) e on e.root = s.root where taken is not null""")
def bounded_scene(f: Facts) -> DataFrame:
    return X.bounded_scene(f.sql(SCENES), 4, 6)


RUNS = "select o.side, service_ns, case when service_ns like '%6' and side='after' then 'v2' else 'v1' end as tool, 'c'||case when service_ns like '%5' and side = 'after' then 0 else length(service_ns) end as config from fx_observations o where state = 'available'"


@query("m10_check_comparable", f"""
select coalesce(b.service_ns, a.service_ns) as service_ns, case when a.tool is null or b.tool is null then 'missing_side' when a.tool <> b.tool or a.config <> b.config then 'not_comparable' else 'comparable' end as state, case when a.tool <> b.tool then 'tool' when a.config <> b.config then 'config' end as differ
from (select * from ({RUNS}) x where side='before') b full outer join (select * from ({RUNS}) y where side='after') a on a.service_ns = b.service_ns""")
def comparable(f: Facts) -> DataFrame:
    rows = f.sql(RUNS)
    return X.check_comparable(rows.where("side = 'before'"), rows.where("side = 'after'"), "service_ns", ["tool", "config"])


COMPARED = f"""select coalesce(b.service_ns, a.service_ns) as service_ns, case when a.tool is null or b.tool is null then 'missing_side' when a.tool <> b.tool or a.config <> b.config then 'not_comparable' else 'comparable' end as state
from (select * from ({RUNS}) x where side='before') b full outer join (select * from ({RUNS}) y where side='after') a on a.service_ns = b.service_ns"""


@query("m10_gate_gaps", f"""
with pol as ({RULES}), amb as (select kind, key, case when count(distinct side) > 1 then 'both' else min(side) end as side from ({TWICE}) t group by 1, 2), imp as ({ALL_IMPACT} select * from every)
select 'policy' as source, subject_key as subject, reason_code as reason from pol where outcome = 'unknown' union all select distinct 'impact', endpoint_id, category from imp where rank > 1 union all select 'diff', key, 'ambiguous_'||side from amb
union all select 'diagnostics', diagnostic_id, code from fx_diagnostics where side='after' and severity = 'error' union all select 'runs', service_ns, state from ({COMPARED}) c where state <> 'comparable'
union all select 'observations', service_ns, state from fx_observations where side='after' and state <> 'available'""")
def gaps(f: Facts) -> DataFrame:
    sides = Sides(f)
    return X.gate_gaps(policies(f, sides), every_impact(f, sides), merge_ambiguities(f.sql(TWICE)), f.side("fx_diagnostics"), comparable(f), f.side("fx_observations"))


SITES = "select class_id as subject_key, path, 1 as line from fx_classes c join fx_files f on f.side='after' and f.file_id = c.file_id"


@query("m10_gate_findings", f"""
select rule_id, p.subject_key, case severity when 'error' then 'failure' when 'warning' then 'warning' else 'notice' end as level, location from ({RULES}) p
left join (select subject_key, min(path||':'||line) as location from ({SITES}) x group by 1) l on l.subject_key = p.subject_key where outcome = 'fail' or blocking""")
def findings(f: Facts) -> DataFrame:
    return X.gate_findings(policies(f), f.sql(SITES))
