"""Backwards from targets to the endpoints that can reach them, over calls and over queues and events, within budgets.

Two counters, calls and hops, limit a walk. A hop goes from a handler's method to the contract that it serves and on to the
methods that produce for it, so a hot queue costs its members, not their pairs. Of the queue branches that the edges behind
a hop belong to, one at least must possibly run for the producer's job.

A walk's round follows from its counters, so a round meets all ways to its states at once: they are summed and their best
certainty is taken before the shuffle, and no path is carried. Each round's edges are kept; a bounded list of paths is read
back from them afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators.matching import contract_matches
from factgraph.operators.walk import walkable
from factgraph.sources.staging import stage

STATE = ["root", "node", "branches", "calls", "hops"]
CALL, START = "METHOD_CALLS_METHOD", "METHOD_INITIATES_INTERACTION"


def never_runs(branch: Column, job: Column) -> Column:
    """Whether a branch, as selector kind|jobs, surely does not run for a job."""
    kind, jobs = F.substring_index(branch, "|", 1), F.split(F.substring_index(branch, "|", -1), ",")
    listed = F.array_contains(jobs, job)
    return job.isNotNull() & (((kind == "exact_jobs") & ~listed) | ((kind == "unmatched_jobs") & listed))


def reverse_steps(edges: DataFrame, interactions: DataFrame, handlers: DataFrame, branches: DataFrame, effects: DataFrame) -> DataFrame:
    """(node, to_node, edge_id, status_rank, calls, hops, queued, job, adds): the steps backwards.

    edges: (edge_id, subject_id, object_id, predicate, status_rank) of calls and of started interactions; branches:
    (branch_id, selector_kind, jobs); effects: (branch_id, edge_id). A request that several handlers would answer leads
    nowhere. A step from a handler to its contract tells whether it is a queue's and the job; other steps add the branches
    that their edge belongs to.
    """
    of = effects.join(branches, "branch_id").groupBy("edge_id").agg(F.array_sort(F.collect_set(F.concat_ws("|", "selector_kind", "jobs"))).alias("adds"))
    none = F.array().cast("array<string>")
    own = edges.where("status_rank <= 2 and object_id is not null").join(of, "edge_id", "left").withColumn("adds", F.coalesce("adds", none))
    calls = own.where(F.col("predicate") == CALL).select(
        F.col("object_id").alias("node"), F.col("subject_id").alias("to_node"), "edge_id", "status_rank", F.lit(1).alias("calls"), F.lit(0).alias("hops"), F.lit(False).alias("queued"), F.lit(None).cast("string").alias("job"), "adds"
    )
    matches, keys = contract_matches(interactions, handlers, ("service_ns",))
    total = matches.groupBy("contract_id").agg(F.count(F.lit(1)).alias("total"))
    served = matches.join(total, "contract_id").where("not (kind = 'microservice_message' and mode = 'request_response' and total > 1)").join(handlers.select("handler_id", "method_id"), "handler_id")
    into = served.select(
        F.col("method_id").alias("node"), F.col("contract_id").alias("to_node"), F.concat_ws("|", F.lit("HANDLER"), "handler_id", "contract_id").alias("edge_id"), F.lit(1).alias("status_rank"), F.lit(0).alias("calls"), F.lit(1).alias("hops"),
        (F.col("kind") == "job_queue").alias("queued"), "job", none.alias("adds"),
    )
    sent = own.where(F.col("predicate") == START).join(keys.withColumnRenamed("interaction_id", "object_id"), "object_id")
    onward = sent.select(F.col("contract_id").alias("node"), F.col("subject_id").alias("to_node"), "edge_id", "status_rank", F.lit(0).alias("calls"), F.lit(0).alias("hops"), F.lit(False).alias("queued"), F.lit(None).cast("string").alias("job"), "adds")
    return calls.unionByName(into).unionByName(onward)


def reverse_rounds(targets: DataFrame, steps: DataFrame, depth: int = 3, max_hops: int = 2) -> tuple[DataFrame, list[DataFrame]]:
    """targets: (root). Returns the states (root, node, branches, calls, hops, n, rank): how many walks lead to each and the
    best certainty; and for each round its edges, from a state of the round before (from_node, from_branches) to one of its own."""
    none = F.array().cast("array<string>")
    first = targets.select("root").distinct().select("root", F.col("root").alias("node"), none.alias("branches"), F.lit(0).alias("calls"), F.lit(0).alias("hops"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("rank"))
    frontier = stage(first, "reverse")
    states, rounds = [frontier], []
    named = steps.select("node", "to_node", "edge_id", "status_rank", F.col("calls").alias("more_calls"), F.col("hops").alias("more_hops"), "queued", "job", "adds")
    blocked = F.col("queued") & (F.size("branches") > 0) & F.forall("branches", lambda b: never_runs(b, F.col("job")))
    while not frontier.isEmpty():
        ahead = frontier.join(named, "node").where(~blocked & (F.col("calls") + F.col("more_calls") <= depth) & (F.col("hops") + F.col("more_hops") <= max_hops))
        edges = stage(ahead.select(
            "root", F.col("to_node").alias("node"), F.array_sort(F.array_union("branches", "adds")).alias("branches"), (F.col("calls") + F.col("more_calls")).alias("calls"), (F.col("hops") + F.col("more_hops")).alias("hops"),
            F.col("node").alias("from_node"), F.col("branches").alias("from_branches"), F.col("calls").alias("from_calls"), F.col("hops").alias("from_hops"), "edge_id", "n", F.greatest("rank", "status_rank").alias("rank"), "status_rank",
        ), "reverse-edges")
        frontier = stage(edges.groupBy(*STATE).agg(F.sum("n").alias("n"), F.min("rank").alias("rank")), "reverse")
        states.append(frontier)
        rounds.append(edges)
    return reduce(DataFrame.unionByName, states), rounds


def ends_of(states: DataFrame, implementations: DataFrame) -> DataFrame:
    """states with the endpoints that their node implements, and the rank that includes that step."""
    ends = walkable(implementations).select(F.col("subject_id").alias("endpoint_id"), F.col("object_id").alias("node"), F.col("status_rank").alias("end_rank"))
    return states.join(ends, "node")


def endpoint_reach(states: DataFrame, implementations: DataFrame) -> DataFrame:
    """(target, endpoint_id, walks, calls, hops, rank): how an endpoint reaches a target, with the fewest calls, the fewest
    hops and the best certainty of any walk. walks also counts those that meet a method twice."""
    found = ends_of(states, implementations)
    return found.groupBy(F.col("root").alias("target"), "endpoint_id").agg(F.sum("n").alias("walks"), F.min("calls").alias("calls"), F.min("hops").alias("hops"), F.min(F.greatest("rank", "end_rank")).alias("rank"))


def endpoint_paths(states: DataFrame, rounds: list[DataFrame], implementations: DataFrame, n: int = 3) -> DataFrame:
    """(target, endpoint_id, place, path, edges, length, rank): the first n simple paths from each endpoint to each target, the
    shortest first, then by their nodes and edges. Read back round by round from the endpoint's end: of the paths of a target,
    endpoint and length that have come to one state over the same nodes, what lies ahead is the same, so n of these go on and
    none that the first n need is given up."""
    pair = ["root", "endpoint_id", "length"]
    length = F.col("calls") + 2 * F.col("hops")
    begun = ends_of(states, implementations).select("root", "endpoint_id", length.alias("length"), F.col("node").alias("path"), F.lit("").alias("edges"), F.col("end_rank").alias("rank"), *STATE[1:])
    live = begun.where(F.lit(False))
    for k in range(len(rounds), 0, -1):
        here = live.unionByName(begun.where(F.col("length") == k))
        back = here.join(rounds[k - 1].drop("n", "rank"), STATE).where("not array_contains(split(path, '>'), from_node)").select(
            *pair, F.concat_ws(">", "path", "from_node").alias("path"), F.concat_ws(">", F.nullif("edges", F.lit("")), "edge_id").alias("edges"), F.greatest("rank", "status_rank").alias("rank"),
            F.col("from_node").alias("node"), F.col("from_branches").alias("branches"), F.col("from_calls").alias("calls"), F.col("from_hops").alias("hops"),
        )
        # A closing mark, so that parts of paths come in the order of the whole: a>b10> before a>b1>.
        nodes, order = F.array_join(F.array_sort(F.split("path", ">")), ">"), [F.concat(c, F.lit(">")) for c in ("path", "edges")]
        place = F.row_number().over(Window.partitionBy(*pair, *STATE[1:], nodes).orderBy(*order))
        live = stage(back.withColumn("place", place).where(F.col("place") <= n).drop("place"), "reverse-paths")
    every = live.unionByName(begun.where("length = 0"))
    place = F.row_number().over(Window.partitionBy("root", "endpoint_id").orderBy("length", "path", "edges"))
    return every.withColumn("place", place).where(F.col("place") <= n).select(F.col("root").alias("target"), "endpoint_id", "place", "path", "edges", "length", "rank")
