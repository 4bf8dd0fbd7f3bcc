"""Queries on snapshot diffs, change impact and policy rules."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators import diff as D
from factgraph.operators import impact as I
from factgraph.operators import policy as P
from factgraph.operators import reverse as R
from factgraph.operators import walk as W
from factgraph.operators.matching import endpoint_authorization, match_exact
from factgraph.operators.select import filter_policy
from factgraph.plans.graph import ACCESS, CALLS, CHANGED, IMPL, LOCAL, PATHS, REACH, SEEDS, SERVED, TERMINALS, Trace, reach_sql, reversed_walks, trace_sql
from factgraph.plans.registry import query
from factgraph.sources.binding import Facts
from factgraph.sources.staging import stage

KEYS = """with src as (select 'source' as kind, file_id as id, to_json(['source', nfc_normalize(path)]) as key from fx_files where side='{side}'),
cls as (select 'class' as kind, class_id as id, to_json(['class', cast(key as varchar), qualified_name]) as key from fx_classes c join src on src.id = c.file_id),
met as (select 'method' as kind, method_id as id, to_json(['method', cast(key as varchar), nfc_normalize(name)]) as key from fx_methods m join cls on cls.id = m.class_id),
ends as (select 'endpoint' as kind, endpoint_id as id, to_json(['endpoint', http_method, path]) as key from fx_endpoints where side='{side}'),
keys as (select * from src union all select * from cls union all select * from met union all select * from ends)"""


def keys(f: Facts, side: str = "after") -> DataFrame:
    return D.project_keys(f.side("fx_files", side), f["fx_classes"], f["fx_methods"], f.side("fx_endpoints", side))


@query("d1_project_keys", KEYS.format(side="after") + "\nselect kind, id, key from keys")
def project_keys(f: Facts) -> DataFrame:
    return keys(f)


@query("d1_key_collisions", KEYS.format(side="after") + "\nselect kind, key, count(distinct id) as n, array_to_string(list_sort(list_distinct(list(id))), ';') as ids from keys group by 1, 2 having count(distinct id) > 1")
def collisions(f: Facts) -> DataFrame:
    return D.key_collisions(keys(f))


def keyed_sql(source: str, key: str, cols: str) -> str:
    """A keyed diff of the compared columns: change is null where nothing changed."""
    names, compared = ([k.strip() for k in x.split(",")] for x in (key, cols))
    same = " and ".join(f"b.{k} is not distinct from a.{k}" for k in names)
    picked = ", ".join(f"case when b.side is null then a.{k} else b.{k} end as {k}" for k in names)
    least = ", ".join(f"min({c}) as v_{c}" for c in compared)
    differ = " or ".join(f"b.v_{c} is distinct from a.v_{c}" for c in compared)
    why = ", ".join(f"case when b.v_{c} is distinct from a.v_{c} then '{c}' end" for c in compared)
    return f"""(select * from (select {picked}, case when coalesce(b.n,0) > 1 or coalesce(a.n,0) > 1 then 'ambiguous' when b.n is null then 'added' when a.n is null then 'removed'
  when {differ} then 'modified' end as change, case when b.n = 1 and a.n = 1 and ({differ}) then concat_ws(';', {why}) end as reasons
 from (select side, {key}, count(*) as n, {least} from {source} where side = 'before' group by side, {key}) b
 full outer join (select side, {key}, count(*) as n, {least} from {source} where side = 'after' group by side, {key}) a on {same}) x where change is not null)"""


def keyed(f: Facts, table: str, key: list[str], *cols: str) -> DataFrame:
    return D.diff_sides(f[table].where("side in ('before', 'after')"), key, list(cols))


@query("d2_diff_assertions", f"select * from {keyed_sql('fx_calls', 'subject_id, object_id', 'status_rank')} d")
def diff_assertions(f: Facts) -> DataFrame:
    return keyed(f, "fx_calls", ["subject_id", "object_id"], "status_rank")


@query("d2_diff_diagnostics", f"select * from {keyed_sql('fx_diagnostics', 'code, message', 'severity')} d")
def diff_diagnostics(f: Facts) -> DataFrame:
    return keyed(f, "fx_diagnostics", ["code", "message"], "severity")


#: Further families: table, key and compared columns.
FAMILIES = {
    "interactions": ("fx_interactions2", "interaction_id", "kind, queue, job, activation"), "handlers": ("fx_handlers2", "handler_id", "queue, job, registration"),
    "queue_facts": ("fx_branches2", "branch_id", "selector_kind, jobs"),
}


def family(f: Facts, name: str) -> DataFrame:
    table, key, cols = FAMILIES[name]
    return keyed(f, table, [key], *cols.split(", "))


@query("d2_diff_interactions", f"select * from {keyed_sql(*FAMILIES['interactions'])} d")
def diff_interactions(f: Facts) -> DataFrame:
    return family(f, "interactions")


@query("d2_diff_handlers", f"select * from {keyed_sql(*FAMILIES['handlers'])} d")
def diff_handlers(f: Facts) -> DataFrame:
    return family(f, "handlers")


@query("d2_diff_queue_facts", f"select * from {keyed_sql(*FAMILIES['queue_facts'])} d")
def diff_queue_facts(f: Facts) -> DataFrame:
    return family(f, "queue_facts")


HANDLED = "select e.side, e.endpoint_id, e.http_method, e.path, i.object_id as handler from fx_endpoints e left join fx_impl i on i.side = e.side and i.subject_id = e.endpoint_id"
PAIRS = f"""h as (select *, count(*) over (partition by side, http_method, path) as n from ({HANDLED}) x),
paired as (select b.endpoint_id as before_id, a.endpoint_id as after_id, b.http_method, b.path, case when b.handler is not distinct from a.handler then 'exact' else 'slot' end as match
 from h b join h a on a.http_method = b.http_method and a.path = b.path where b.side='before' and a.side='after' and a.n = 1 and b.n = 1),
matched as (select * from paired union all select endpoint_id, null, http_method, path, 'removed' from h where side='before' and endpoint_id not in (select before_id from paired)
 union all select null, endpoint_id, http_method, path, 'added' from h where side='after' and endpoint_id not in (select after_id from paired))"""


def pairs(f: Facts) -> DataFrame:
    rows = f.sql(HANDLED)
    return D.diff_endpoints(rows.where("side = 'before'").drop("side"), rows.where("side = 'after'").drop("side"))


@query("d3_diff_endpoints", f"with {PAIRS}\nselect * from matched")
def diff_endpoints(f: Facts) -> DataFrame:
    return pairs(f)


def of_side(text: str, side: str) -> str:
    """A text that is written for the after side (side='after', without spaces), for either."""
    return text.replace("side='after'", f"side='{side}'")


NUMBER = "cast(split_part(endpoint_id, ':', 2) as bigint)"
#: The values that are compared of an endpoint, by facet; terminals are those of the whole walk on their side.
FACETS = {
    "handler": f"select side, endpoint_id, handler as value from ({HANDLED}) h where handler is not null",
    "guards": f"select side, endpoint_id, scope||':'||guard_id||':'||status_rank as value from fx_guard_use cross join fx_side where side='before' or {NUMBER}%31<>0",
    "effective_guards": f"""select side, endpoint_id, scope||':'||guard_id as value from fx_guard_use cross join fx_side where side='before' or {NUMBER}%31<>0
 union all select side, endpoint_id, 'global:'||guard_id from ({SERVED}) s join fx_global_guards g on g.service_ns = s.service_ns cross join fx_side where side='before' or {NUMBER}%37<>0""",
    "authorization": f"""select side, m.endpoint_id, metadata_key||':'||case when side='after' and cast(split_part(m.endpoint_id, ':', 2) as bigint)%23=0 then 'enforcement_unknown' else state end as value
 from fx_auth_metadata m join fx_auth_enforcement e on e.metadata_id = m.metadata_id cross join fx_side""",
    "resources": """select i.side, i.subject_id as endpoint_id, operation||':'||coalesce(target, '?') as value from fx_impl i join fx_calls c on c.side = i.side and c.subject_id = i.object_id and c.status_rank <= 2
 join fx_resources r on r.method_id = c.object_id where i.status_rank <= 2""",
    "terminals": " union all ".join(f"select '{s}' as side, root as endpoint_id, predicate||table_id||':'||rank as value from ({of_side(TERMINALS, s)} select * from terminals) t_{s}" for s in ("before", "after")),
}
REASONS = f"""{PAIRS}, {", ".join(f"f_{n} as (select side, endpoint_id, to_json(list_sort(list_distinct(list(value)))) as v from ({t}) d group by 1, 2)" for n, t in FACETS.items())},
why as (select p.before_id, p.after_id, {", ".join(f"case when b_{n}.v is distinct from a_{n}.v then '{n}' end as r_{n}" for n in FACETS)} from paired p
 {" ".join(f"left join f_{n} b_{n} on b_{n}.side='before' and b_{n}.endpoint_id = p.before_id left join f_{n} a_{n} on a_{n}.side='after' and a_{n}.endpoint_id = p.after_id" for n in FACETS)}),
reasons as (select * from (select before_id, after_id, concat_ws(';', {", ".join(f"r_{n}" for n in FACETS)}) as reasons from why) y where reasons <> '')"""


class Sides:
    """The calls and accesses of both sides, a row for both, each read once. Of the calls only those of methods that a walk from
    an endpoint can meet and, with `changes`, those that differ are kept."""

    def __init__(self, f: Facts, changes: bool = True):
        self.f = f
        self.implementations = stage(f.sql("select side, subject_id, object_id, status_rank from fx_impl where status_rank <= 2 and object_id is not null"), "implementations")
        rows = f["fx_call_both"]
        met = self.implementations.select("object_id").unionByName(rows.select("object_id")).where("object_id is not null").distinct()
        # Dealt by subject, rows meet both their like and what is met there.
        best = D.of_both(rows.repartition("subject_id"), ["subject_id", "object_id"])
        best = best.join(met.select(F.col("object_id").alias("subject_id"), F.lit(True).alias("met")), "subject_id", "left").withColumn("change", D.change_of_both())
        self.calls = stage(best.where("met or change is not null" if changes else "met"), "calls")

    def steps(self) -> DataFrame:
        """(side, subject_id, object_id, status_rank)"""
        return D.of_either(self.calls.where("met").select("subject_id", "object_id", "before_rank", "after_rank"))

    @cached_property
    def access(self) -> DataFrame:
        return stage(D.of_both(self.f["fx_access_both"], ["subject_id", "predicate", "object_id"]).withColumn("change", D.change_of_both()), "access")


def reasons_of(f: Facts, sides: Sides | None = None) -> DataFrame:
    sides = sides or Sides(f, changes=False)
    handled = stage(f.sql(HANDLED.replace("as handler", "as handler, i.status_rank")), "handled")
    one = lambda s: handled.where(f"side = '{s}'").drop("side", "status_rank")
    ends = stage(D.of_pairs(D.diff_endpoints(one("before"), one("after"))), "pairs")
    starts = stage(ends.join(handled.where("status_rank <= 2 and handler is not null"), ["side", "endpoint_id"]).select(*ends.columns, F.col("handler").alias("node"), F.col("status_rank").alias("rank")), "starts")
    steps = sides.steps()
    facets = {name: f.sql(text) for name, text in FACETS.items() if name not in ("handler", "resources", "terminals")} | {"terminals": None}
    called = starts.join(steps.select("side", F.col("subject_id").alias("node"), F.col("object_id").alias("method_id")), ["side", "node"]).join(f["fx_resources"], "method_id")
    facets["handler"] = handled.where("handler is not null").select("side", "endpoint_id", F.col("handler").alias("value"))
    facets["resources"] = called.select("side", "endpoint_id", F.concat("operation", F.lit(":"), F.coalesce("target", F.lit("?"))).alias("value"))
    own = sides.access.select(F.col("subject_id").alias("node"), "predicate", "object_id", *[F.expr(f"case when {s}_rank <= 2 then {s}_rank end").alias(f"{s}_status_rank") for s in ("before", "after")])
    changed = D.differing_terminals(starts, steps, own).withColumn("facet", F.lit("terminals"))
    return D.endpoint_reasons(ends, {name: facets[name] for name in FACETS}, changed)


@query("d4_endpoint_reasons", f"with {REASONS}\nselect * from reasons")
def endpoint_reasons(f: Facts) -> DataFrame:
    return reasons_of(f)


@query("d5_diff_files", f"select path, change, reasons from {keyed_sql('fx_files', 'path', 'content_hash')} d")
def diff_files(f: Facts) -> DataFrame:
    return D.diff_files(f.side("fx_files", "before"), f.side("fx_files"))


TWICE = "select 'endpoint' as kind, http_method||' '||path as key, side, endpoint_id as candidate from (select *, count(*) over (partition by side, http_method, path) as n from fx_endpoints) x where n > 1"


@query("d6_merge_ambiguities", f"""
select kind, key, case when count(distinct side) > 1 then 'both' else min(side) end as side, array_to_string(list_sort(list_distinct(list(candidate))), ';') as candidates from ({TWICE}) t group by 1, 2""")
def ambiguities(f: Facts) -> DataFrame:
    return D.merge_ambiguities(f.sql(TWICE))


FEED = f"""select 'files' as family, path as subject, change, coalesce(reasons, '') as reasons from {keyed_sql('fx_files', 'path', 'content_hash')} a
union all select 'calls', subject_id||'>'||object_id, change, coalesce(reasons, '') from {keyed_sql('fx_calls', 'subject_id, object_id', 'status_rank')} b
union all select 'access', subject_id||'>'||predicate||'>'||object_id, change, coalesce(reasons, '') from {keyed_sql('fx_access', 'subject_id, predicate, object_id', 'status_rank')} c
union all select 'diagnostics', code||'>'||message, change, coalesce(reasons, '') from {keyed_sql('fx_diagnostics', 'code, message', 'severity')} d
union all select 'endpoints', http_method||' '||path, match, '' from (with {PAIRS} select * from matched where match in ('added', 'removed')) e
union all {" union all ".join(f"select '{n}', {spec[1]}, change, coalesce(reasons, '') from {keyed_sql(*spec)} f_{n}" for n, spec in FAMILIES.items())}"""


def feed(f: Facts) -> DataFrame:
    calls = keyed(f, "fx_calls", ["subject_id", "object_id"], "status_rank")
    access = keyed(f, "fx_access", ["subject_id", "predicate", "object_id"], "status_rank")
    files = D.diff_files(f.side("fx_files", "before"), f.side("fx_files"))
    moved = pairs(f).where("match in ('added', 'removed')").select("http_method", "path", F.col("match").alias("change"), F.lit(None).cast("string").alias("reasons"))
    return D.change_feed({
        "files": (files, F.col("path")), "calls": (calls, F.concat_ws(">", "subject_id", "object_id")),
        "access": (access, F.concat_ws(">", "subject_id", "predicate", "object_id")),
        "diagnostics": (keyed(f, "fx_diagnostics", ["code", "message"], "severity"), F.concat_ws(">", "code", "message")),
        "endpoints": (moved, F.concat_ws(" ", "http_method", "path")), **{n: (family(f, n), F.col(spec[1])) for n, spec in FAMILIES.items()},
    })


@query("d7_change_feed", FEED)
def change_feed(f: Facts) -> DataFrame:
    return feed(f)


@query("d7_diff_summary", f"select family, change, count(*) as n from ({FEED}) x group by 1, 2")
def diff_summary(f: Facts) -> DataFrame:
    return D.diff_summary(feed(f))


#: Of a side: the files that stand there and were changed, added (after) or removed (before).
CHANGED_FILES = f"select file_id from fx_files f join {keyed_sql('fx_files', 'path', 'content_hash')} d on d.path = f.path where f.side='after' and d.change <> 'ambiguous'"


def changed_files(f: Facts, side: str) -> DataFrame:
    changes = D.diff_files(f.side("fx_files", "before"), f.side("fx_files")).where("change <> 'ambiguous'")
    return f.side("fx_files", side).join(changes.select("path"), "path").select("file_id")


def impact_sql(changed: str) -> str:
    """found(endpoint_id, category, subject, direct, rank) from (root, category, subject, own) texts, on both sides."""

    def one(side: str) -> str:
        return f"""(with recursive changed as ({of_side(changed, side)}), calls as ({of_side(CALLS, side)}), t as (select distinct root from changed),
w(root, node, rank, depth) as (select root, root, 1, 0 from t union select w.root, c.subject_id, greatest(w.rank, c.status_rank), w.depth + 1 from w join calls c on c.object_id = w.node where w.depth < 3),
best as (select w.root, i.subject_id as endpoint_id, min(depth) as depth, min(greatest(rank, status_rank)) as rank from w join ({of_side(IMPL, side)}) i on i.object_id = w.node group by 1, 2)
select endpoint_id, category, subject, bool_or(depth = 0 and category <> 'entity_change') as direct, min(greatest(rank, own)) as rank from best b join changed c on c.root = b.root group by 1, 2, 3)"""

    return f"with found as (select endpoint_id, category, subject, bool_or(direct) as direct, min(rank) as rank from (select * from {one('before')} x union all select * from {one('after')} y) u group by 1, 2, 3)"


def changed_of_sides(f: Facts) -> DataFrame:
    """(side, file_id): the same of both sides."""
    changes = D.diff_files(f.side("fx_files", "before"), f.side("fx_files")).where("change <> 'ambiguous'")
    return stage(f["fx_files"].select("side", "path", "file_id").join(changes.select("path"), "path").select("side", "file_id"), "changed-files")


def impact(sides: Sides, changed: DataFrame) -> DataFrame:
    """changed: the changed methods of each side (side, ...), or of both."""
    if "side" not in changed.columns:
        changed = changed.withColumn("side", F.explode(F.array(F.lit("before"), F.lit("after"))))
    return I.impact_of_sides(changed, sides.steps(), sides.implementations)


TOUCHED = f"select m.method_id as root, 'file_change' as category, c.file_id as subject, 1 as own from fx_methods m join fx_classes c on c.class_id = m.class_id join ({CHANGED_FILES}) cf on cf.file_id = c.file_id"
FILE_IMPACT = impact_sql(TOUCHED)


def touched(f: Facts, side: str) -> DataFrame:
    return I.changed_symbols(changed_files(f, side), f["fx_classes"], f["fx_methods"])


def file_impact(f: Facts) -> DataFrame:
    return impact(Sides(f, changes=False), I.changed_symbols(changed_of_sides(f), f["fx_classes"], f["fx_methods"]))


@query("i1_impact_files", FILE_IMPACT + "\nselect * from found")
def impact_files(f: Facts) -> DataFrame:
    return file_impact(f)


MAPPING = "select class_id, 'table:'||(cast(split_part(class_id, ':', 2) as bigint)%n_suppliers) as table_id from fx_classes cross join fx_size where role = 'entity'"
ENTITY_USERS = f"""select distinct a.subject_id as root, 'entity_change' as category, a.object_id as subject, a.status_rank as own from ({ACCESS}) a
 join (select table_id from ({MAPPING}) m join fx_classes c on c.class_id = m.class_id join ({CHANGED_FILES}) cf on cf.file_id = c.file_id) x on x.table_id = a.object_id"""


def entity_users(f: Facts, sides: Sides, files: DataFrame) -> DataFrame:
    return I.changed_entities(files, f["fx_classes"], f.sql(MAPPING), sides.access)


@query("i2_impact_entities", impact_sql(ENTITY_USERS) + "\nselect * from found")
def impact_entities(f: Facts) -> DataFrame:
    sides = Sides(f, changes=False)
    return impact(sides, entity_users(f, sides, changed_of_sides(f)))


DIRECT = f"(with {REASONS} select after_id as endpoint_id, 'endpoint_change' as category, reasons as subject, true as direct, 1 as rank from reasons where reasons <> 'terminals')"


@query("i3_impact_direct", f"select * from {DIRECT} d")
def impact_direct(f: Facts) -> DataFrame:
    return I.impact_direct(reasons_of(f))


CHANGED_ACCESS = f"select subject_id as root, 'table_access' as category, predicate||'>'||object_id||':'||change as subject, 1 as own from {keyed_sql('fx_access', 'subject_id, predicate, object_id', 'status_rank')} d"


def access_changes(sides: Sides) -> DataFrame:
    changes = sides.access.where("change is not null")
    return I.changed_facts("table_access", changes, "subject_id", F.concat("predicate", F.lit(">"), "object_id", F.lit(":"), "change"))


@query("i4_impact_table_access", impact_sql(CHANGED_ACCESS) + "\nselect * from found")
def impact_access(f: Facts) -> DataFrame:
    sides = Sides(f, changes=False)
    return impact(sides, access_changes(sides))


def named_sql(name: str, methods: str) -> str:
    _, key, _ = spec = FAMILIES[name]
    return f"select distinct m.method_id as root, '{name}' as category, d.{key}||':'||change as subject, 1 as own from {keyed_sql(*spec)} d join ({methods}) m on m.{key} = d.{key}"


#: Which method a changed record stands in.
PLACES = {
    "interactions": "select distinct interaction_id, source_method_id as method_id from fx_interactions2", "handlers": "select distinct handler_id, method_id from fx_handlers2",
    "queue_facts": "select distinct branch_id, method_id from fx_branches2 b join fx_handlers h on h.handler_id = b.handler_id",
}
CHANGED_FACTS = f"""select subject_id as root, 'resolution' as category, change as subject, 1 as own from {keyed_sql('fx_calls', 'subject_id, object_id', 'status_rank')} d where change <> 'ambiguous'
 union all {" union all ".join(named_sql(n, places) for n, places in PLACES.items())}"""
CHANGED_FACTS = f"select distinct * from ({CHANGED_FACTS}) facts"
#: Diagnostics that name an endpoint need no walk.
NOTED = f"""select distinct s.subject_id as endpoint_id, 'diagnostics' as category, d.diagnostic_id||':'||change as subject, true as direct, 1 as rank
from {keyed_sql('fx_diagnostics', 'diagnostic_id', 'severity')} d join fx_diagnostics s on s.diagnostic_id = d.diagnostic_id where s.subject_id is not null"""


def fact_changes(f: Facts, sides: Sides) -> DataFrame:
    calls = sides.calls.where("change <> 'ambiguous'")
    parts = [I.changed_facts("resolution", calls, "subject_id", F.col("change"))]
    for name, places in PLACES.items():
        key = FAMILIES[name][1]
        parts.append(I.changed_facts(name, family(f, name).join(f.sql(places), key), "method_id", F.concat_ws(":", key, "change")))
    return I.all_reasons(*parts)


def noted(f: Facts) -> DataFrame:
    changes = keyed(f, "fx_diagnostics", ["diagnostic_id"], "severity")
    rows = changes.join(f["fx_diagnostics"].where("subject_id is not null").select("diagnostic_id", "subject_id").distinct(), "diagnostic_id")
    return rows.select(F.col("subject_id").alias("endpoint_id"), F.lit("diagnostics").alias("category"), F.concat_ws(":", "diagnostic_id", "change").alias("subject"), F.lit(True).alias("direct"), F.lit(1).alias("rank"))


@query("i5_impact_facts", impact_sql(CHANGED_FACTS) + f"\nselect * from found union all select * from ({NOTED}) n")
def impact_facts(f: Facts) -> DataFrame:
    sides = Sides(f)
    return impact(sides, fact_changes(f, sides)).unionByName(noted(f))


EVERY = f"select * from ({TOUCHED}) e1 union all select * from ({ENTITY_USERS}) e2 union all select * from ({CHANGED_ACCESS}) e3 union all select * from ({CHANGED_FACTS}) e4"
UNSURE = "select * from {0} union all select endpoint_id, 'unknown', subject, direct, rank from {0} where rank > 1"
ALL_IMPACT = impact_sql(EVERY) + f", every as (select * from found union all select * from ({NOTED}) n union all select * from {DIRECT} d), whole as ({UNSURE.format('every')})"


def every_impact(f: Facts, sides: Sides | None = None) -> DataFrame:
    """All reasons: one walk serves files, entities, accesses and facts of both sides."""
    sides, files = sides or Sides(f), changed_of_sides(f)
    same = access_changes(sides).unionByName(fact_changes(f, sides)).withColumn("side", F.explode(F.array(F.lit("before"), F.lit("after"))))
    own = I.changed_symbols(files, f["fx_classes"], f["fx_methods"]).unionByName(entity_users(f, sides, files))
    return I.all_reasons(impact(sides, own.unionByName(same)), noted(f), I.impact_direct(reasons_of(f, sides)))


@query("i6_add_uncertainty", FILE_IMPACT + f", whole as ({UNSURE.format('found')}) select * from whole")
def uncertainty(f: Facts) -> DataFrame:
    return I.add_uncertainty(file_impact(f))


ENDS = "select distinct endpoint_id, http_method, path from fx_endpoints"


@query("i7_impacted_endpoints", ALL_IMPACT + f"""
, single as (select http_method, path, category, subject, bool_or(direct) as direct, min(rank) as rank from whole w join ({ENDS}) e on e.endpoint_id = w.endpoint_id group by 1, 2, 3, 4)
select http_method, path, bool_or(direct) as direct, min(rank) = 1 as certain, count(*) as n_reasons, array_to_string(list_sort(list_distinct(list(category))), ';') as categories from single group by 1, 2""")
def impacted(f: Facts) -> DataFrame:
    return I.impacted_endpoints(I.add_uncertainty(every_impact(f)), f.sql(ENDS))


@query("i7_impact_summary", ALL_IMPACT + """
select category, count(distinct endpoint_id) as endpoints, count(case when direct then 1 end) as direct, count(case when rank > 1 then 1 end) as uncertain from whole group by category""")
def impact_summary(f: Facts) -> DataFrame:
    return I.impact_summary(I.add_uncertainty(every_impact(f)))


#: The evidence of a path's steps: edges, and the handlers that stand between a queue and a method.
STEP_EVIDENCE = "select edge_id, evidence_id from fx_edges where predicate in ('METHOD_CALLS_METHOD', 'METHOD_INITIATES_INTERACTION')"

#: The methods of all changed files that stand on the after side, added ones too: what the evidence is traced from.
EVERY_TARGET = f"select distinct root from ({TOUCHED}) every_target"


@query("i7_impact_evidence", f"""
with reach as ({REACH.replace(CHANGED, EVERY_TARGET)}), paths as ({PATHS.replace(CHANGED, EVERY_TARGET)}), touched as ({TOUCHED}),
hits as (select endpoint_id, category, subject, bool_or(calls = 0) as direct, min(greatest(rank, own)) as rank, min(hops) as hops, cast(sum(walks) as bigint) as walks from reach r join touched t on t.root = r.target group by 1, 2, 3),
used as (select distinct endpoint_id, category, subject, edges, substr(sha256(edges), 1, 16) as path_key from paths p join touched t on t.root = p.target),
keys as (select endpoint_id, category, subject, array_to_string(list_sort(list_distinct(list(path_key))), ';') as paths from used group by 1, 2, 3),
proofs as (select endpoint_id, category, subject, array_to_string(list_sort(list_distinct(list(evidence_id))), ';') as evidence_ids from (select endpoint_id, category, subject, unnest(string_split(edges, '>')) as edge_id from used) u
 join ({STEP_EVIDENCE} union all select 'HANDLER|'||handler_id, evidence_id from fx_handlers) e on e.edge_id = case when u.edge_id like 'HANDLER|%' then 'HANDLER|'||split_part(u.edge_id, '|', 2) else u.edge_id end group by 1, 2, 3)
select h.*, coalesce(paths, '') as paths, coalesce(evidence_ids, '') as evidence_ids from hits h left join keys k using (endpoint_id, category, subject) left join proofs p using (endpoint_id, category, subject)""")
def impact_evidence(f: Facts) -> DataFrame:
    changed = stage(touched(f, "after"), "touched")
    states, rounds = reversed_walks(f, changed.select(F.col("method_id").alias("root")))
    reach, paths = R.endpoint_reach(states, f.sql(IMPL)), stage(R.endpoint_paths(states, rounds, f.sql(IMPL), 3), "impact-paths")
    handlers = paths.select(F.explode(F.split("edges", ">")).alias("edge_id")).where("edge_id like 'HANDLER|%'").distinct()
    handlers = handlers.withColumn("handler_id", F.split("edge_id", r"\|")[1]).join(f["fx_handlers"].select("handler_id", "evidence_id"), "handler_id").select("edge_id", "evidence_id")
    return I.impact_evidence(changed, reach, paths, f.sql(STEP_EVIDENCE).unionByName(handlers))


ANY_FILE = f"select distinct file_id from (select * from ({CHANGED_FILES}) a union all select * from ({of_side(CHANGED_FILES, 'before')}) b) c"


@query("i8_unreachable_changes", FILE_IMPACT + f"""
select cf.file_id, case when exists (select 1 from fx_classes c where c.file_id = cf.file_id) then 'no_endpoint_path' else 'no_symbols' end as reason from ({ANY_FILE}) cf where cf.file_id not in (select subject from found)""")
def unreachable(f: Facts) -> DataFrame:
    return I.unreachable_changes(changed_files(f, "before").unionByName(changed_files(f, "after")), f["fx_classes"], file_impact(f))


def rule_sql(rule: str, body: str, severity: str = "error", on_unknown: str = "warning") -> str:
    """Wraps a text whose last part is rows_(subject_key, outcome, reason_code, evidence_ids)."""
    return body + f"""
, done as (select subject_key, outcome, reason_code, evidence_ids from rows_ union all select '', 'not_applicable', 'no_subject', '' where not exists (select 1 from rows_))
select '{rule}' as rule_id, outcome, case when outcome = 'unknown' then '{on_unknown}' else '{severity}' end as severity, reason_code, subject_key, evidence_ids,
 outcome in ('fail', 'unknown') and case when outcome = 'unknown' then '{on_unknown}' else '{severity}' end = 'error' as blocking from done"""


def ids_sql(col: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(list({col}) filter ({col} is not null))), ';'), '')"


P1 = f"""with named as (select min(class_id) as class_id, count(*) as same from fx_classes where role = 'controller' group by file_id, qualified_name),
own as (select n.class_id, m.method_id as subject_id from named n join fx_methods m on m.class_id = n.class_id),
facts as (select class_id, a.status_rank = 1 as sure, evidence_id from own join (select * from fx_access where side='after') a on a.subject_id = own.subject_id union all select class_id, status_rank = 1, evidence_id from fx_injections
 union all select class_id, code = 'TYPEORM_OPERATION_UNSUPPORTED' and d.subject_id <> class_id, evidence_id from (select * from own union all select class_id, class_id from named) s join fx_class_diagnostics d on d.subject_id = s.subject_id
  where code in ('DI_TOKEN_UNSUPPORTED', 'TYPEORM_ENTITY_UNRESOLVED') or (code = 'TYPEORM_OPERATION_UNSUPPORTED' and d.subject_id <> class_id)),
found as (select class_id, count(case when sure then 1 end) as sure, {ids_sql("case when sure then evidence_id end")} as proofs, {ids_sql("case when not sure then evidence_id end")} as doubts from facts group by 1),
rows_ as (select n.class_id as subject_key, case when same > 1 then 'unknown' when sure > 0 then 'fail' when f.class_id is not null then 'unknown' else 'pass' end as outcome,
 case when same > 1 then 'controller_repository_access_unknown' when sure > 0 then 'direct_repository_access' when f.class_id is not null then 'controller_repository_access_unknown' else 'no_direct_repository_access' end as reason_code,
 case when same > 1 then '' when sure > 0 then proofs else coalesce(doubts, '') end as evidence_ids from named n left join found f on f.class_id = n.class_id)"""


def p1(f: Facts) -> DataFrame:
    return P.rule_no_direct_access(f["fx_classes"], f["fx_methods"], f.side("fx_access"), f["fx_injections"], f["fx_class_diagnostics"])


@query("p1_no_direct_access", rule_sql("no_direct_access", P1))
def no_direct_access(f: Facts) -> DataFrame:
    return P.finish(p1(f), "no_direct_access")


SUBJECTS = """subjects as (select min(endpoint_id) as endpoint_id, http_method, count(*) as same, max(in_slot) as in_slot from (select e.*, object_id as handler, count(*) over (partition by http_method, path) as in_slot
 from (select * from fx_endpoints where side='after') e left join (select subject_id, min(object_id) as object_id from fx_impl where side='after' group by 1) i on i.subject_id = e.endpoint_id) x group by http_method, path, handler)"""
WRITING = reach_sql(SEEDS, CALLS) + f""", writing as (select root as endpoint_id, min(greatest(rank, status_rank)) as rank, {ids_sql("evidence_id")} as write_ids, list(evidence_id) as write_list
 from (select root, node, min(rank) as rank from r group by 1, 2) r join (select * from fx_access where side='after' and status_rank <= 2) a on a.subject_id = r.node and predicate = 'METHOD_WRITES_TABLE' group by 1), {SUBJECTS}"""
EFFECTIVE = f"select endpoint_id, status_rank, evidence_id from fx_guard_use union all select s.endpoint_id, 1, nullif('', '') from ({SERVED}) s join fx_global_guards g on g.service_ns = s.service_ns"


def merged_ids(*lists: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(flatten([{', '.join(f'coalesce({x}, [])' for x in lists)}]), lambda x: x is not null))), ';')"


P2 = WRITING + f""", g as (select endpoint_id, count(*) as any_, count(case when status_rank = 1 then 1 end) as sure, list(evidence_id) as guard_list from ({EFFECTIVE}) e group by 1),
v as (select s.endpoint_id, write_ids, write_list, guard_list, case when same > 1 then 1 when rank is null then 2 when rank > 1 then 3 when sure > 0 then 4 when any_ > 0 then 5 else 6 end as c from subjects s left join writing w on w.endpoint_id = s.endpoint_id left join g on g.endpoint_id = s.endpoint_id),
rows_ as (select endpoint_id as subject_key, ['unknown', 'not_applicable', 'unknown', 'pass', 'unknown', 'fail'][c] as outcome,
 ['write_reachability_unknown', 'endpoint_has_no_write', 'write_reachability_unknown', 'write_endpoint_guard_declared', 'write_endpoint_guard_unknown', 'write_endpoint_guard_missing'][c] as reason_code,
 case when c < 3 then '' when c = 3 then write_ids else {merged_ids("write_list", "guard_list")} end as evidence_ids from v)"""


def subjects(f: Facts) -> DataFrame:
    return P.endpoint_subjects(f.side("fx_endpoints"), f.side("fx_impl"))


def written(f: Facts, reach: DataFrame) -> DataFrame:
    access = f["fx_access"].where("side = 'after' and status_rank <= 2").select("subject_id", "predicate", "status_rank", "evidence_id")
    return P.writes(reach.groupBy("root", "node").agg(F.min("rank").alias("rank")), access)


def p2(f: Facts, reach: DataFrame) -> DataFrame:
    return P.rule_guard_on_write(subjects(f), written(f, reach), f.sql(EFFECTIVE))


def reach_of(f: Facts, sides: Sides | None = None) -> DataFrame:
    sides = sides or Sides(f, changes=False)
    return W.walk(f.sql(SEEDS), sides.steps().where("side = 'after'"), 3)


@query("p2_guard_on_write", rule_sql("guard_on_write", P2, on_unknown="error"))
def guard_on_write(f: Facts) -> DataFrame:
    return P.finish(p2(f, reach_of(f)), "guard_on_write", on_unknown="error")


#: Gaps of an endpoint's trace: steps that are not resolved, and diagnostics on it, on its methods and their classes.
NOTES = "select subject_id, evidence_id from fx_class_diagnostics union all select subject_id, evidence_id from fx_diagnostics where side='after' and code in ('CALL_DEPTH_LIMIT', 'CALL_TARGET_UNRESOLVED')"
HOLES = f"""select subject_id as endpoint_id, cast(null as varchar) as evidence_id from fx_impl where side='after' and status_rank > 1
 union all ({trace_sql(SEEDS)}, met as (select distinct root, method from states) select t.root, o.evidence_id from states t join scoped o on o.subject_id = t.method and o.scope = t.scope where (o.status_rank > 1 or o.object_id is null) and (predicate <> 'METHOD_CALLS_METHOD' or t.depth < 3)
  union all select root, evidence_id from met join ({NOTES}) n on n.subject_id = met.method union all select root, evidence_id from met join fx_methods m on m.method_id = met.method join ({NOTES}) n on n.subject_id = m.class_id)
 union all select subject_id, evidence_id from ({NOTES}) n"""
P3 = WRITING + f""", holes as (select endpoint_id, list(evidence_id) as gap_list from ({HOLES}) h group by 1),
v as (select s.endpoint_id, same, in_slot, write_ids, write_list, gap_list, coalesce(rank = 1, false) as sure, rank, http_method in ('POST', 'PUT', 'PATCH', 'DELETE', 'ALL') as writes_, h.endpoint_id is not null or in_slot > 1 as open_
 from subjects s left join writing w on w.endpoint_id = s.endpoint_id left join holes h on h.endpoint_id = s.endpoint_id),
rows_ as (select endpoint_id as subject_key, case when same > 1 then 'unknown' when sure and open_ then 'fail' when sure then 'pass' when rank is not null or (writes_ and open_) then 'unknown' else 'not_applicable' end as outcome,
 case when same > 1 then 'write_trace_unknown' when sure and open_ then 'write_trace_incomplete' when sure then 'write_trace_complete' when rank is not null or (writes_ and open_) then 'write_trace_unknown' else 'no_write_trace_subject' end as reason_code,
 case when same > 1 then '' when in_slot > 1 then coalesce(write_ids, '') else {merged_ids("write_list", "gap_list")} end as evidence_ids from v)"""


def trace_gaps(f: Facts) -> DataFrame:
    t = Trace(f, SEEDS)
    broken = t.edges.where("(status_rank > 1 or object_id is null)").select(F.col("subject_id").alias("method"), "scope", "predicate", "evidence_id")
    steps = t.states.join(broken, ["method", "scope"]).where("predicate <> 'METHOD_CALLS_METHOD' or depth < 3").select(F.col("root").alias("endpoint_id"), "evidence_id")
    met = t.states.select("root", "method").distinct()
    on = met.select("root", F.col("method").alias("subject_id")).unionByName(met.join(f["fx_methods"].withColumnRenamed("method_id", "method"), "method").select("root", F.col("class_id").alias("subject_id")))
    ends = f.side("fx_impl").select("subject_id", "status_rank")
    notes = f.sql(NOTES)
    noted = on.join(notes, "subject_id").select(F.col("root").alias("endpoint_id"), "evidence_id").unionByName(notes.select(F.col("subject_id").alias("endpoint_id"), "evidence_id"))
    return steps.unionByName(noted).unionByName(ends.where("status_rank > 1").select(F.col("subject_id").alias("endpoint_id"), F.lit(None).cast("string").alias("evidence_id")))


def p3(f: Facts, reach: DataFrame) -> DataFrame:
    return P.rule_complete_write_trace(subjects(f), written(f, reach), trace_gaps(f))


@query("p3_complete_write_trace", rule_sql("complete_write_trace", P3))
def complete_write_trace(f: Facts) -> DataFrame:
    return P.finish(p3(f, reach_of(f)), "complete_write_trace")


P4 = f"""with c as (select diagnostic_id, change from {keyed_sql('fx_diagnostics', 'diagnostic_id', 'severity')} d), s as (select diagnostic_id, severity, evidence_id from fx_diagnostics where side='after'),
rows_ as (select c.diagnostic_id as subject_key, case when change = 'added' and severity <> 'info' then 'fail' when change = 'ambiguous' then 'unknown' else 'pass' end as outcome,
 case when change = 'added' and severity <> 'info' then 'new_diagnostic' when change = 'ambiguous' then 'diagnostic_ambiguous' else 'below_severity' end as reason_code, coalesce(evidence_id, '') as evidence_ids from c join s on s.diagnostic_id = c.diagnostic_id where change in ('added', 'ambiguous'))"""


def p4(f: Facts) -> DataFrame:
    changes = keyed(f, "fx_diagnostics", ["diagnostic_id"], "severity").join(f.side("fx_diagnostics").select("diagnostic_id", "severity", "evidence_id"), "diagnostic_id")
    return P.rule_no_new_diagnostics(changes)


@query("p4_no_new_diagnostics", rule_sql("no_new_diagnostics", P4))
def no_new_diagnostics(f: Facts) -> DataFrame:
    return P.finish(p4(f), "no_new_diagnostics")


P5 = """with v as (select interaction_id, evidence_id, case when queue is null or (kind = 'job_queue' and job is null) then 1 when kind = 'microservice_message' and transport is null then 2 else 3 end as c from fx_interactions),
rows_ as (select interaction_id as subject_key, ['fail', 'unknown', 'pass'][c] as outcome, ['interaction_target_dynamic', 'interaction_target_unknown', 'interaction_target_static'][c] as reason_code, coalesce(evidence_id, '') as evidence_ids from v)"""


@query("p5_static_target", rule_sql("static_target", P5))
def static_target(f: Facts) -> DataFrame:
    return P.finish(P.rule_static_target(f["fx_interactions"]), "static_target")


P6 = """with rows_ as (select interaction_id as subject_key, case activation when 'constructed_cold' then 'fail' when 'unknown' then 'unknown' else 'pass' end as outcome,
 case activation when 'constructed_cold' then 'interaction_activation_cold' when 'unknown' then 'interaction_activation_unknown' else 'interaction_activation_proven' end as reason_code, coalesce(evidence_id, '') as evidence_ids from fx_interactions)"""


@query("p6_activation", rule_sql("activation", P6, severity="warning", on_unknown="info"))
def activation(f: Facts) -> DataFrame:
    return P.finish(P.rule_activation(f["fx_interactions"]), "activation", "warning", "info")


P7 = f"""with m as (select interaction_id, list(distinct h.evidence_id) as theirs from ({LOCAL}) x join fx_handlers h on h.handler_id = x.handler_id group by 1),
rows_ as (select i.interaction_id as subject_key, case when m.interaction_id is not null then 'pass' when queue is null then 'unknown' else 'fail' end as outcome,
 case when m.interaction_id is not null then 'local_event_handler_found' when queue is null then 'local_event_handler_unknown' else 'local_event_handler_missing' end as reason_code, {merged_ids("theirs", "[i.evidence_id]")} as evidence_ids
 from fx_interactions i left join m on m.interaction_id = i.interaction_id where kind = 'in_process_event')"""


def p7(f: Facts) -> DataFrame:
    matches = match_exact(f["fx_interactions"], f["fx_handlers"], ("service_ns",)).withColumn("status_rank", F.lit(1))
    return P.rule_local_handler(f["fx_interactions"], matches, f["fx_handlers"])


@query("p7_local_handler", rule_sql("local_handler", P7))
def local_handler(f: Facts) -> DataFrame:
    return P.finish(p7(f), "local_handler")


P8 = f"""with {SUBJECTS}, a as (select m.endpoint_id, bool_or(state = 'configured_relationship') as configured, bool_and(state = 'proven_enforced') as all_, {ids_sql("evidence_id")} as evidence_ids from fx_auth_metadata m join fx_auth_enforcement e on e.metadata_id = m.metadata_id group by 1),
v as (select s.endpoint_id, evidence_ids, case when same > 1 then 1 when all_ is null then 2 when all_ then 3 when configured then 4 else 5 end as c from subjects s left join a on a.endpoint_id = s.endpoint_id),
rows_ as (select endpoint_id as subject_key, ['unknown', 'not_applicable', 'pass', 'unknown', 'unknown'][c] as outcome, ['authorization_enforcement_unknown', 'no_authorization_metadata', 'authorization_enforcement_proven', 'authorization_enforcement_configured', 'authorization_enforcement_unknown'][c] as reason_code,
 case when c = 1 then '' else coalesce(evidence_ids, '') end as evidence_ids from v)"""


def p8(f: Facts) -> DataFrame:
    return P.rule_authorization(subjects(f), endpoint_authorization(f["fx_auth_metadata"], f["fx_auth_enforcement"]))


@query("p8_authorization", rule_sql("authorization", P8))
def authorization(f: Facts) -> DataFrame:
    return P.finish(p8(f), "authorization")


#: Severity and severity of unknowns of each configured rule.
CONFIG = {
    "no_direct_access": (P1, "error", "warning"), "guard_on_write": (P2, "error", "error"), "complete_write_trace": (P3, "error", "warning"),
    "no_new_diagnostics": (P4, "error", "warning"), "static_target": (P5, "error", "warning"), "activation": (P6, "warning", "info"),
    "local_handler": (P7, "error", "warning"), "authorization": (P8, "error", "warning"),
}
RULES = " union all ".join(f"select * from ({rule_sql(n, *c)}) r_{n}" for n, c in CONFIG.items())


def policies(f: Facts, sides: Sides | None = None) -> DataFrame:
    reach = reach_of(f, sides)
    rows = {
        "no_direct_access": p1(f), "guard_on_write": p2(f, reach), "complete_write_trace": p3(f, reach), "no_new_diagnostics": p4(f),
        "static_target": P.rule_static_target(f["fx_interactions"]), "activation": P.rule_activation(f["fx_interactions"]), "local_handler": p7(f), "authorization": p8(f),
    }
    return P.evaluate_policies({rule: (rows[rule], *levels) for rule, (_, *levels) in CONFIG.items()})


@query("p9_evaluate_policies", RULES)
def evaluate(f: Facts) -> DataFrame:
    return policies(f)


@query("p9_policy_summary", f"""
select rule_id, count(case when outcome = 'pass' then 1 end) as passed, count(case when outcome = 'fail' then 1 end) as fail, count(case when outcome = 'unknown' then 1 end) as unknown,
 count(case when outcome = 'not_applicable' then 1 end) as not_applicable, count(case when blocking then 1 end) as blocking from ({RULES}) x group by rule_id""")
def policy_summary(f: Facts) -> DataFrame:
    return P.policy_summary(policies(f))


@query("q7_filter_policy", f"select * from ({RULES}) x where outcome in ('fail', 'unknown') and severity in ('error', 'warning') and blocking")
def filtered(f: Facts) -> DataFrame:
    return filter_policy(policies(f), ["fail", "unknown"], ["error", "warning"], True)
