"""Propagation across services on contract groups, within budgets.

Producers and consumers of one contract are a group: consumers are stored once, with their place in it, and contracts lead
to contracts (those that consumers' calls produce for). Seeds walk over that graph of groups, so a queue with a million
producers and as many consumers costs a step, not their pairs. Members are expanded last, and only as far as a seed's quota
of paths goes: sums of group sizes tell where it ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators.matching import contract_matches
from factgraph.sources.staging import stage


@dataclass(frozen=True)
class Limits:
    """What a propagation may cost where nothing else is said."""

    hops: int = 4
    paths: int = 200
    effects: int = 64
    states: int = 1000


def contract_groups(interactions: DataFrame, handlers: DataFrame, onward: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contract_id, handler_id, place, size): the consumers of each contract in their order; (contract_id, next_id): the
    contracts that their calls produce for; (interaction_id, contract_id). onward: (handler_id, interaction_id)."""
    matches, keys = contract_matches(interactions, handlers)
    served = matches.select("contract_id", "handler_id").distinct()
    sizes = served.groupBy("contract_id").agg(F.count(F.lit(1)).alias("size"))
    members = served.withColumn("place", F.row_number().over(Window.partitionBy("contract_id").orderBy("handler_id"))).join(sizes, "contract_id")
    members = stage(members, "groups-members")
    produced = onward.join(keys, "interaction_id").select("handler_id", F.col("contract_id").alias("next_id")).distinct()
    graph = stage(members.select("contract_id", "handler_id").join(produced, "handler_id").select("contract_id", "next_id").distinct(), "groups-graph")
    return members, graph, keys


def propagate_groups(seeds: DataFrame, graph: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """seeds: (seed, contract_id). Returns (seed, hop, contract_id), each contract at its first hop, by hop and contract as
    many of a seed as its quota of states has; and (seed, reason, n): contracts that were met before (cycle), lie behind the
    last hop (hop_limit), or did not fit the quota, which then ends the seed's walk (state_limit)."""
    frontier = seeds.select("seed", "contract_id").distinct()
    used = seeds.select("seed").distinct().withColumn("used", F.lit(0).cast("long"))
    kept, cut, hop = None, None, 0
    while True:
        hop += 1
        place = F.row_number().over(Window.partitionBy("seed").orderBy("contract_id"))
        ranked = stage(frontier.withColumn("place", place).join(used, "seed").withColumn("fits", F.col("place") + F.col("used") <= limits.states), "groups-round")
        found = ranked.where("fits").select("seed", F.lit(hop).alias("hop"), "contract_id")
        over = ranked.where("not fits").select("seed", F.lit("state_limit").alias("reason"), "contract_id")
        kept, cut = (found, over) if kept is None else (kept.unionByName(found), cut.unionByName(over))
        used = stage(used.join(ranked.where("fits").groupBy("seed").agg(F.count(F.lit(1)).alias("more")), "seed", "left").select("seed", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used")), "groups-used")
        ended = over.select("seed").distinct()
        ahead = stage(found.join(graph, "contract_id").select("seed", F.col("next_id").alias("contract_id")).distinct().join(ended, "seed", "left_anti"), "groups-ahead")
        seen = kept.select("seed", "contract_id")
        cut = cut.unionByName(ahead.join(seen, ["seed", "contract_id"], "left_semi").select("seed", F.lit("cycle").alias("reason"), "contract_id"))
        frontier = stage(ahead.join(seen, ["seed", "contract_id"], "left_anti"), "groups-frontier")
        if hop >= limits.hops:
            cut = cut.unionByName(frontier.select("seed", F.lit("hop_limit").alias("reason"), "contract_id"))
        if hop >= limits.hops or frontier.isEmpty():
            return kept, cut.distinct().groupBy("seed", "reason").agg(F.count(F.lit(1)).alias("n"))


def expand_groups(states: DataFrame, members: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """The first paths (seed, hop, contract_id, handler_id) of each seed, by hop, contract and consumer, and (seed, reason, n)
    of those that its quota leaves out. Where a contract's consumers begin among a seed's paths follows from the sizes of the
    groups before it."""
    sizes = members.select("contract_id", "size").distinct()
    before = F.sum("size").over(Window.partitionBy("seed").orderBy("hop", "contract_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = stage(states.join(sizes, "contract_id").withColumn("start", F.coalesce(before, F.lit(0))), "groups-placed")
    paths = placed.where(F.col("start") < limits.paths).join(members.select("contract_id", "handler_id", "place"), "contract_id").where(F.col("start") + F.col("place") <= limits.paths)
    total = placed.groupBy("seed").agg(F.sum("size").alias("n")).where(F.col("n") > limits.paths)
    return paths.select("seed", "hop", "contract_id", "handler_id"), total.select("seed", F.lit("path_limit").alias("reason"), (F.col("n") - limits.paths).alias("n"))


def limited_effects(paths: DataFrame, effects: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(seed, handler_id, hop, predicate, table_id, certain) of what the consumers of paths do, the first effects of each, and
    (seed, reason, n) of those left out. effects: (handler_id, predicate, table_id, status_rank)."""
    own = effects.groupBy("handler_id", "predicate", "table_id").agg(F.min("status_rank").alias("rank"))
    counted = own.groupBy("handler_id").agg(F.count(F.lit(1)).alias("of"))
    place = F.row_number().over(Window.partitionBy("handler_id").orderBy("predicate", "table_id"))
    first = own.withColumn("place", place).where(F.col("place") <= limits.effects)
    at = stage(paths.groupBy("seed", "handler_id").agg(F.min("hop").alias("hop")), "groups-handlers")
    rows = at.join(first, "handler_id").select("seed", "handler_id", "hop", "predicate", "table_id", (F.col("rank") == 1).alias("certain"))
    over = at.join(counted.where(F.col("of") > limits.effects), "handler_id").groupBy("seed").agg(F.sum(F.col("of") - limits.effects).alias("n"))
    return rows, over.select("seed", F.lit("effect_limit").alias("reason"), "n")
