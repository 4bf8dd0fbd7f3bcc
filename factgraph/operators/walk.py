"""Bounded walks over edges, from every root at once.

A walk keeps ids only; evidence and names are joined afterwards. Each round is one join of the frontier with the edges.
A state that was reached with no more depth and no worse certainty is not walked again, so cycles end. Rank 1 is
resolved, 2 ambiguous; other edges are not walked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.sources.staging import stage


def walkable(edges: DataFrame) -> DataFrame:
    return edges.where("status_rank <= 2 and object_id is not null").select("subject_id", "object_id", "status_rank")


def walk(seeds: DataFrame, edges: DataFrame, depth: int | None) -> DataFrame:
    """seeds: (root, node, rank); edges: (subject_id, object_id, status_rank). Returns (root, node, rank, depth): the least
    depth at which a root reaches a node with that rank, the worst of a path's steps. depth None: until nothing is new."""
    steps = stage(walkable(edges).distinct(), "walk-steps")
    frontier = stage(seeds.select("root", "node", "rank").distinct().withColumn("depth", F.lit(0)), "walk")
    seen, level = frontier, 0
    while (depth is None or level < depth) and not frontier.isEmpty():
        level += 1
        ahead = frontier.join(steps, F.col("node") == F.col("subject_id")).select("root", F.col("object_id").alias("node"), F.greatest("rank", "status_rank").alias("rank")).distinct()
        frontier = stage(ahead.join(seen, ["root", "node", "rank"], "left_anti").withColumn("depth", F.lit(level)), "walk")
        seen = seen.unionByName(frontier)
    return seen


def call_trace(starts: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(root, method_id, depth, gap): methods by least depth; gap where the limit hides further calls."""
    reached = walk(starts, edges, depth).groupBy("root", "node").agg(F.min("depth").alias("depth"))
    more = walkable(edges).select(F.col("subject_id").alias("node"), F.lit(True).alias("calls")).distinct()
    gap = F.coalesce(F.col("calls"), F.lit(False)) & (F.col("depth") == depth)
    return reached.join(more, "node", "left").select("root", F.col("node").alias("method_id"), "depth", gap.alias("gap"))


def trace_steps(reached: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(root, subject_id, object_id, depth, status_rank, walked): the edges that leave what a walk reached before its last
    level, at the least depth of their start; those that are not walked (unresolved, without an object) too."""
    first = reached.groupBy("root", F.col("node").alias("subject_id")).agg(F.min("depth").alias("depth")).where(F.col("depth") < depth)
    steps = first.join(edges.select("subject_id", "object_id", "status_rank"), "subject_id")
    return steps.select("root", "subject_id", "object_id", "depth", "status_rank", (F.col("object_id").isNotNull() & (F.col("status_rank") <= 2)).alias("walked"))


def limit_states(states: DataFrame, n: int) -> DataFrame:
    """The first n states of each root by hop, depth, method, scope and class, with how many there were and a diagnostic
    where some were left out."""
    total = states.groupBy("root").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("hop", "depth", "method", "scope", "class"))
    rows = states.withColumn("place", place).where(F.col("place") <= n).join(total, "root")
    return rows.select("root", "method", "scope", "hop", "class", "depth", "total", F.when(F.col("total") > n, "INTERACTION_TRACE_LIMIT_REACHED").alias("diagnostic"))


def simple_paths(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """All simple paths of up to `depth` steps: (root, node, path, rank). path holds the nodes from the root on."""
    steps = walkable(edges).distinct()
    frontier = stage(roots.select("root").distinct().select("root", F.col("root").alias("node"), F.array("root").alias("path"), F.lit(1).alias("rank")), "paths")
    found = frontier
    for _ in range(depth):
        ahead = frontier.join(steps, F.col("node") == F.col("subject_id")).where(~F.array_contains("path", F.col("object_id")))
        frontier = stage(ahead.select("root", F.col("object_id").alias("node"), F.array_append("path", F.col("object_id")).alias("path"), F.greatest("rank", "status_rank").alias("rank")), "paths")
        found = found.unionByName(frontier)
    return found


def steps_below(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The edges that a walk of `depth` rounds from the starts (node) takes, whoever its roots are: those that leave what it
    reaches before its last level."""
    steps = stage(walkable(edges).distinct(), "walk-steps")
    fresh = stage(starts.select("node").distinct(), "below")
    known, taken = fresh, []
    for _ in range(depth):
        taken.append(stage(steps.join(fresh, F.col("subject_id") == F.col("node"), "left_semi"), "below"))
        fresh = stage(taken[-1].select(F.col("object_id").alias("node")).distinct().join(known, "node", "left_anti"), "below")
        known = known.unionByName(fresh)
    return reduce(DataFrame.unionByName, taken)


def steps_met(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that leave what the starts (node) or any edge's object name, with all their columns: no walk takes others.
    Of a graph with many callers that nothing calls, these are few, and only they are joined further or written."""
    met = starts.select("node").unionByName(edges.select(F.col("object_id").alias("node"))).distinct()
    return stage(edges.join(met, F.col("subject_id") == F.col("node"), "left_semi"), "steps-met")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.where("object_id is not null").select(F.col("object_id").alias("subject_id"), F.col("subject_id").alias("object_id"), "status_rank")


def symbol_dependents(targets: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Per target and dependent: number of simple paths, the shortest, and whether any step of any path is ambiguous."""
    paths = simple_paths(targets, reverse(edges), depth).where(F.size("path") > 1)
    return paths.groupBy("root", "node").agg(F.count(F.lit(1)).alias("n_paths"), (F.min(F.size("path")) - 1).alias("depth"), (F.max("rank") == 2).alias("ambiguous"))


def paths_from_endpoints(targets: DataFrame, edges: DataFrame, implementations: DataFrame, depth: int = 3) -> DataFrame:
    """(target, endpoint, path, rank): simple call paths backwards from targets, stopped where an endpoint is implemented.
    implementations: (subject_id endpoint, object_id method, status_rank)."""
    paths = simple_paths(targets, reverse(edges), depth)
    ends = walkable(implementations).select(F.col("subject_id").alias("endpoint_id"), F.col("object_id").alias("node"), F.col("status_rank").alias("end_rank"))
    return paths.join(ends, "node").select(F.col("root").alias("target"), "endpoint_id", "path", F.greatest("rank", "end_rank").alias("rank"))


def path_incomplete(paths: DataFrame, gaps: DataFrame) -> DataFrame:
    """paths with `incomplete`: a step is not resolved, or a node of it has a gap. gaps: (node)."""
    numbered = stage(paths.withColumn("path_key", F.sha2(F.concat_ws(">", "endpoint_id", F.array_join("path", ">")), 256)), "path-keys")
    hit = numbered.select("path_key", F.explode("path").alias("node")).join(gaps.select("node").distinct(), "node", "left_semi").select("path_key", F.lit(True).alias("gap")).distinct()
    flagged = numbered.join(hit, "path_key", "left")
    return flagged.withColumn("incomplete", (F.col("rank") > 1) | F.coalesce("gap", F.lit(False))).drop("gap")


def terminal_facts(seeds: DataFrame, calls: DataFrame, access: DataFrame, depth: int = 3) -> DataFrame:
    """(root, predicate, table_id, rank, contributors): over all paths the best status wins, where a path is as certain as
    its worst step."""
    return terminals_of(walk(seeds, calls, depth), access)


def terminals_of(reached: DataFrame, access: DataFrame) -> DataFrame:
    """The same of a walk that is at hand."""
    found = reached.join(access.select(F.col("subject_id").alias("node"), F.col("object_id").alias("table_id"), "predicate", "status_rank"), "node")
    found = found.withColumn("rank", F.greatest("rank", "status_rank"))
    return found.groupBy("root", "predicate", "table_id").agg(F.min("rank").alias("rank"), F.count_distinct("node").alias("contributors"))


def chain_ends(nodes: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(start, node): each of nodes with all that follow it on its chain. jumps[k]: (subject_id, object_id), 2^k steps ahead
    where every step is a node's only one; further ones are added as they are needed. With the first 2^k nodes of all chains
    at hand a jump gives the next 2^k, so a chain takes rounds by the logarithm of its length. Cycles end: what a round
    finds again is no news."""
    news = stage(nodes.select(F.col("node").alias("start"), "node").distinct(), "chains")
    held, k = news, 0
    while not news.isEmpty():
        if k == len(jumps):
            ahead = jumps[-1].select(F.col("subject_id").alias("object_id"), F.col("object_id").alias("to"))
            jumps.append(stage(jumps[-1].join(ahead, "object_id").select("subject_id", F.col("to").alias("object_id")), "jumps"))
        found = held.join(jumps[k], F.col("node") == F.col("subject_id")).select("start", F.col("object_id").alias("node"))
        news = stage(found.distinct().join(held, ["start", "node"], "left_anti"), "chains")
        held, k = held.unionByName(news), k + 1
    return held


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node): all that the seeds (root, node) reach over edges (subject_id, object_id), at any depth. Chains of nodes
    with one step each are followed once for all roots that meet them, by doubling; only where nodes have several steps a
    round of the walk is one step."""
    steps = stage(edges.select("subject_id", "object_id").where("object_id is not null and subject_id <> object_id").distinct(), "steps")
    out = steps.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    jumps = [stage(steps.join(out.where("n = 1"), "subject_id", "left_semi"), "jumps")]
    forks = stage(steps.join(out.where("n > 1"), "subject_id", "left_semi"), "forks")
    frontier = stage(seeds.select("root", "node").distinct(), "closure")
    seen = None
    while not frontier.isEmpty():
        ends = chain_ends(frontier.select("node"), jumps).withColumnRenamed("node", "to")
        reached = frontier.join(ends, F.col("node") == F.col("start")).select("root", F.col("to").alias("node")).distinct()
        reached = stage(reached if seen is None else reached.join(seen, ["root", "node"], "left_anti"), "closure")
        seen = reached if seen is None else seen.unionByName(reached)
        ahead = reached.join(forks, F.col("node") == F.col("subject_id")).select("root", F.col("object_id").alias("node")).distinct()
        frontier = stage(ahead.join(seen, ["root", "node"], "left_anti"), "closure")
    return frontier if seen is None else seen


def resolved_reach(seeds: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node): what resolved edges alone reach."""
    sure, steps = seeds.where("rank = 1"), edges.where("status_rank = 1")
    return closure(sure, steps) if depth is None else walk(sure, steps, depth).select("root", "node").distinct()


def module_visibility(modules: DataFrame, edges: DataFrame, scope: str = "analysis_id") -> tuple[DataFrame, DataFrame]:
    """(scope, module_id, class_id) visible, and (scope, module_id, complete).

    A module exports what it exports itself and what the modules it exports export (a fixpoint over rounds). It sees its
    own providers, the exports of imports, and those of the global modules of its document. It is complete if its imports
    lead to no module that is incomplete or has no record. Only resolved edges count. Ids hold within a document, which
    `scope` names.
    """
    whole = lambda c: F.concat_ws("/", scope, c)
    of = lambda p: edges.where((F.col("predicate") == p) & (F.col("status_rank") == 1) & F.col("object_id").isNotNull()).select(scope, whole("subject_id").alias("subject_id"), F.col("object_id").alias("raw"), whole("object_id").alias("object_id")).distinct()
    resolved = lambda df: df.select("subject_id", "object_id").withColumn("status_rank", F.lit(1))
    known = modules.withColumn("node", whole("module_id"))
    every = known.select(F.col("node").alias("root"), "node", F.lit(1).alias("rank"))
    exporters = walk(every, resolved(of("MODULE_EXPORTS_MODULE")), None).select("root", "node").distinct()
    exported = exporters.join(of("MODULE_EXPORTS_CLASS"), F.col("node") == F.col("subject_id")).select(F.col("root").alias("exporter"), F.col("raw").alias("class_id")).distinct()
    exported = stage(exported, "exports")
    own = of("MODULE_PROVIDES_CLASS").select(F.col("subject_id").alias("node"), F.col("raw").alias("class_id"))
    imported = of("MODULE_IMPORTS_MODULE").join(exported, F.col("object_id") == F.col("exporter")).select(F.col("subject_id").alias("node"), "class_id")
    everywhere = known.where("is_global").join(exported, F.col("node") == F.col("exporter")).select(scope, "class_id").distinct()
    shared = known.select(scope, "node").join(everywhere, scope).select("node", "class_id")
    seen = own.unionByName(imported).unionByName(shared).distinct()
    visible = known.select(scope, "module_id", "node").join(seen, "node").select(scope, "module_id", "class_id")
    whole_modules = known.where("completeness <> 'incomplete'").select("node")
    led = walk(every, resolved(of("MODULE_IMPORTS_MODULE")), None)
    bad = led.join(whole_modules, "node", "left_anti").select(F.col("root").alias("node"), F.lit(False).alias("whole")).distinct()
    complete = known.join(bad, "node", "left").select(scope, "module_id", F.coalesce("whole", F.lit(True)).alias("complete"))
    return visible, complete


def shortest_path(starts: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(root, node, path, length): one shortest path from each root to each node, the least of equals by its nodes. Breadth
    first: each round keeps one path to a node, and only to nodes that no earlier round has reached."""
    steps = walkable(edges).select("subject_id", "object_id").distinct()
    frontier = stage(starts.select("root").distinct().select("root", F.col("root").alias("node"), F.col("root").alias("path"), F.lit(0).alias("length")), "shortest")
    found = frontier
    for length in range(1, depth + 1):
        ahead = frontier.join(steps, F.col("node") == F.col("subject_id")).select("root", F.col("object_id").alias("node"), F.concat_ws(">", "path", "object_id").alias("path"))
        best = ahead.groupBy("root", "node").agg(F.min("path").alias("path")).join(found.select("root", "node"), ["root", "node"], "left_anti")
        frontier = stage(best.withColumn("length", F.lit(length)), "shortest")
        found = found.unionByName(frontier)
        if frontier.isEmpty():
            break
    return found
