"""Traces with causal classes: a walk over the product of the call graph with what restricts and labels its edges.

A node is a method together with a scope: unrestricted (''), the effects of a critical section, or the effects of the queue
branches that a job selects. A scope says which of the method's own edges apply; calls leave it again. Steps between such
nodes are joined once and carry a label; a round of the walk is one join of its frontier with them. Labels and classes:

    class \\ label           local_sync     local_async    critical_section   distributed
    sync                    local_sync     local_async    critical_section   distributed
    local_sync, local_async local_sync     local_async    critical_section   distributed
    critical_section        stays          stays          stays              distributed
    distributed             stays          stays          stays              stays

Calls have no label and keep the class. Edges within a section are hidden from the unrestricted walk, whether or not the
section is entered; it is entered only with a lock held that the scope at hand shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators.matching import contract_matches, select_branches
from factgraph.sources.staging import stage

CALL, ACCESS, START = "METHOD_CALLS_METHOD", "METHOD_ACCESSES_RESOURCE", "METHOD_INITIATES_INTERACTION"
TABLES = ("METHOD_READS_TABLE", "METHOD_WRITES_TABLE")


def next_class(now: Column, label: Column) -> Column:
    return (
        F.when((now == "distributed") | (label == "distributed"), "distributed").when((now == "critical_section") | (label == "critical_section"), "critical_section").otherwise(F.coalesce(label, now))
    )


def applying(edges: DataFrame, members: DataFrame, sections: DataFrame) -> DataFrame:
    """edges with a scope each in which they apply: '' for those in no section's effects, and each scope that lists them.
    edges: (edge_id, ...); members: (scope_id, edge_id); sections: (scope_id, ...)."""
    hidden = members.join(sections.select("scope_id").distinct(), "scope_id", "left_semi").select("edge_id").distinct()
    free = edges.join(hidden, "edge_id", "left_anti").withColumn("scope", F.lit(""))
    return free.unionByName(edges.join(members.distinct(), "edge_id").withColumnRenamed("scope_id", "scope"))


def of_met(edges: DataFrame, *starts: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """The edges of methods that a walk can meet at all: those that it starts or is led to at, starts (method), and those that
    some walkable edge calls. All other methods' edges, of a graph with many callers the most, lead no walk anywhere.
    calls: (object_id, status_rank), the same calls as rows that need not be one an edge, if they are at hand for less."""
    calls = edges.where(F.col("predicate") == CALL) if calls is None else calls
    called = calls.where((F.col("status_rank") <= 2) & F.col("object_id").isNotNull()).select(F.col("object_id").alias("method"))
    for start in starts:
        called = called.unionByName(start.select("method"))
    return edges.join(called.distinct().withColumnRenamed("method", "subject_id"), "subject_id", "left_semi")


def product_steps(own: DataFrame, members: DataFrame, sections: DataFrame, hops: DataFrame) -> DataFrame:
    """(method, scope, label, hops, calls, to_method, to_scope): the steps of the product walk.

    own: applying edges (edge_id, subject_id, object_id, predicate, scope) that can be walked. sections: (scope_id, method_id,
    lock_edge_id), a row for each lock that it holds, or one with null. hops: (interaction_id, method_id, label, scope_id): what a started
    interaction leads to; scope_id null if nothing restricts the handler.
    """
    none, from_ = F.lit(None).cast("string"), [F.col("subject_id").alias("method"), "scope"]
    calls = own.where(F.col("predicate") == CALL).select(*from_, none.alias("label"), F.lit(0).alias("hops"), F.lit(1).alias("calls"), F.col("object_id").alias("to_method"), F.lit("").alias("to_scope"))
    full = sections.where("lock_edge_id is not null").join(members.select("scope_id").distinct(), "scope_id", "left_semi")
    entered = full.select(F.col("method_id").alias("method"), F.lit("").alias("scope"), F.col("scope_id").alias("to_scope"))
    shown = full.select(F.col("method_id").alias("method"), F.col("scope_id").alias("to_scope"), F.col("lock_edge_id").alias("edge_id")).join(members.withColumnRenamed("scope_id", "scope"), "edge_id")
    entered = entered.unionByName(shown.select("method", "scope", "to_scope")).where("scope <> to_scope")
    entered = entered.select("method", "scope", F.lit("critical_section").alias("label"), F.lit(0).alias("hops"), F.lit(0).alias("calls"), F.col("method").alias("to_method"), "to_scope")
    started = own.where(F.col("predicate") == START).select(*from_, F.col("object_id").alias("interaction_id"))
    led = started.join(hops.select("interaction_id", F.col("method_id").alias("to_method"), "label", F.coalesce("scope_id", F.lit("")).alias("to_scope")), "interaction_id")
    led = led.select("method", "scope", "label", F.lit(1).alias("hops"), F.lit(0).alias("calls"), "to_method", "to_scope")
    return calls.unionByName(entered).unionByName(led).distinct()


STATE = ["root", "method", "scope", "hop", "class"]


def causal_states(seeds: DataFrame, steps: DataFrame, depth: int = 3, max_hops: int = 2) -> DataFrame:
    """(root, method, scope, hop, class, depth): what the product walk reaches from (root, method), at the least depth.

    A hop starts a call depth of its own. A state exists if any path within the budgets leads to it. (A walk that continues
    only the first path to a state, and none that meets a method again, can miss such states; it reaches the same methods.)
    """
    first = seeds.select("root", "method").distinct().withColumns({"scope": F.lit(""), "hop": F.lit(0), "class": F.lit("sync"), "depth": F.lit(0)})
    frontier = stage(first.select(*STATE, "depth"), "causal")
    seen = frontier
    while not frontier.isEmpty():
        ahead = frontier.join(steps, ["method", "scope"]).select(
            "root", F.col("to_method").alias("method"), F.col("to_scope").alias("scope"), (F.col("hop") + F.col("hops")).alias("hop"), next_class(F.col("class"), F.col("label")).alias("class"),
            F.when(F.col("hops") == 1, 0).otherwise(F.col("depth") + F.col("calls")).alias("depth"),
        ).where((F.col("depth") <= depth) & (F.col("hop") <= max_hops))
        # Late rounds find little: written first, it is small enough to be sent to what was seen, which then stays in place.
        ahead = stage(ahead.groupBy(*STATE).agg(F.min("depth").alias("depth")), "causal-ahead")
        known = seen.join(ahead.select(*STATE), STATE, "left_semi").groupBy(*STATE).agg(F.min("depth").alias("known"))
        fresh = ahead.join(known, STATE, "left").where("known is null or depth < known")
        frontier = stage(fresh.select(*STATE, "depth"), "causal")
        seen = seen.unionByName(frontier)
    return stage(seen.groupBy(*STATE).agg(F.min("depth").alias("depth")), "causal-states")


def causal_terminals(states: DataFrame, own: DataFrame) -> DataFrame:
    """(root, method, class, predicate, object_id, rank): tables and resources that a state's applying edges reach, by class,
    with the best status of their edges."""
    ends = own.where(F.col("predicate").isin(ACCESS, *TABLES)).select(F.col("subject_id").alias("method"), "scope", "predicate", "object_id", "status_rank")
    found = states.select("root", "method", "scope", "class").distinct().join(ends, ["method", "scope"])
    return found.groupBy("root", "method", "class", "predicate", "object_id").agg(F.min("status_rank").alias("rank"))


def causal_gaps(states: DataFrame, own: DataFrame, steps: DataFrame, edges: DataFrame, depth: int = 3, max_hops: int = 2) -> DataFrame:
    """(root, method, code): where a trace is cut or blind: CALL_DEPTH_LIMIT where calls go on below the last level,
    INTERACTION_TRACE_LIMIT_REACHED where hops do, CALL_TARGET_UNRESOLVED where an applying call is not walked.
    own holds only edges that can be walked; edges are all, with a scope each."""
    calls = own.where(F.col("predicate") == CALL).select(F.col("subject_id").alias("method"), "scope").distinct()
    onward = steps.where("hops = 1").select("method", "scope").distinct()
    lost = edges.where((F.col("predicate") == CALL) & ((F.col("status_rank") > 2) | F.col("object_id").isNull())).select(F.col("subject_id").alias("method"), "scope").distinct()
    coded = lambda at, where, code: at.join(where, ["method", "scope"], "left_semi").select("root", "method", F.lit(code).alias("code"))
    found = coded(states.where(F.col("depth") == depth), calls, "CALL_DEPTH_LIMIT").unionByName(coded(states.where(F.col("hop") == max_hops), onward, "INTERACTION_TRACE_LIMIT_REACHED"))
    return found.unionByName(coded(states.where(F.col("depth") < depth), lost, "CALL_TARGET_UNRESOLVED")).distinct()


def causal_summary(states: DataFrame, terminals: DataFrame, started: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per root: methods, deepest hop, effects (distinct method, direction and table) by class with the two local ones as one,
    resources touched, interactions started by kind, and the codes of its gaps; complete without any.
    started: (method, scope, interaction_id, kind)."""
    effects = terminals.where(F.col("predicate").isin(*TABLES))
    of = lambda *classes: F.count_if(F.col("class").isin(*classes))
    effects = effects.groupBy("root").agg(of("sync").alias("sync_effects"), of("local_sync", "local_async").alias("local_effects"), of("critical_section").alias("critical_effects"), of("distributed").alias("distributed_effects"))
    resources = terminals.where(F.col("predicate") == ACCESS).groupBy("root").agg(F.count_distinct("object_id").alias("resources"))
    kinds = {"events": "in_process_event", "messages": "microservice_message", "jobs": "job_queue"}
    sent = states.select("root", "method", "scope").distinct().join(started, ["method", "scope"]).select("root", "interaction_id", "kind").distinct()
    sent = sent.groupBy("root").agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()])
    codes = gaps.groupBy("root").agg(F.array_join(F.sort_array(F.collect_set("code")), ";").alias("codes"))
    rows = states.groupBy("root").agg(F.count_distinct("method").alias("methods"), F.max("hop").alias("hops"))
    for part in (effects, resources, sent, codes):
        rows = rows.join(part, "root", "left")
    counts = ["sync_effects", "local_effects", "critical_effects", "distributed_effects", "resources", *kinds]
    return rows.fillna(0, counts).fillna("", ["codes"]).withColumn("complete", F.col("codes") == "").select("root", "methods", "hops", *counts, "complete", "codes")


def contract_hops(interactions: DataFrame, handlers: DataFrame, branches: DataFrame, fan_out: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """What started interactions lead to (see product_steps), and the scopes of branch selections (scope_id, branch_id).

    Interactions of one contract (service, kind, queue, way, job) lead to the same handlers, so contracts are matched, each
    with its first `fan_out` handlers or, with None, all of them, and interactions take those of theirs. Handlers
    that are not proven registered, requests with several handlers and events whose timing neither side tells are not
    followed. Of a handler with branches, a known job applies those alone that surely run for it.
    """
    matches, keys = contract_matches(interactions, handlers, ("service_ns",), ("dispatch",))
    total = matches.groupBy("contract_id").agg(F.count(F.lit(1)).alias("total"))
    first = matches
    if fan_out is not None:
        place = F.row_number().over(Window.partitionBy("contract_id").orderBy("handler_id"))
        first = matches.withColumn("place", place).where(F.col("place") <= fan_out)
    first = first.join(total, "contract_id")
    first = first.where("not (kind = 'microservice_message' and mode = 'request_response' and total > 1)")
    first = first.join(handlers.where("registration = 'proven_registered'").select("handler_id", "method_id", "rule_id"), "handler_id")
    timing = F.when((F.col("dispatch") == "asynchronous") | F.col("rule_id").contains(".async."), "local_async").when(F.col("rule_id").contains(".sync."), "local_sync")
    first = first.withColumn("label", F.when(F.col("kind") != "in_process_event", "distributed").otherwise(timing)).where("label is not null")
    dispatched = branches.select("handler_id", F.lit(True).alias("branched")).distinct()
    first = first.join(dispatched, "handler_id", "left")
    scope = F.when((F.col("kind") == "job_queue") & F.col("branched") & F.col("job").isNotNull(), F.concat(F.lit("branches:"), "handler_id", F.lit(":"), "job"))
    first = stage(first.select("contract_id", "handler_id", "method_id", "label", "job", scope.alias("scope_id")), "causal-contracts")
    asked = first.where("scope_id is not null").select(F.col("scope_id").alias("interaction_id"), "handler_id", "job").distinct()
    chosen = select_branches(asked.select("interaction_id", "handler_id"), asked.select("interaction_id", "job").distinct(), branches).where("verdict = 'matches'")
    hops = keys.join(first.select("contract_id", "method_id", "label", "scope_id"), "contract_id").select("interaction_id", "method_id", "label", "scope_id")
    return hops, chosen.select(F.col("interaction_id").alias("scope_id"), "branch_id").distinct()
