"""What changes between two systems: endpoints, correlations with the consumers that they select, candidates, and what cannot
be told because an artifact is missing.

The consumers of a producer are those of its contract's groups. A group has a digest that no order changes (two hashes of its
members, combined by exclusive or, and their number), so selections are compared by digest, one row a producer; members are
read only for groups whose digests differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.system import bound_endpoints, correlate

#: States of a service or of the topology in which its facts are known, absence included.
KNOWN = ("available", "not_present")
GROUP = ["kind", "queue", "mode", "their_job"]
#: Which changed column gives which reason, in the order of the output.
ENDPOINT_REASONS = {"kind": "interaction_kind_changed", "contract": "contract_changed", "transport": "source_transport_changed", "realm": "broker_binding_changed"}
CORRELATION_REASONS = {
    "contract": "contract_changed", "state": "state_changed", "selection": "consumer_selection_changed", "broker_realm": "broker_realm_changed",
    "unmatched_reason": "unmatched_reason_changed", "ambiguity_reason": "ambiguity_reason_changed",
}


def set_digest(member: str) -> list[Column]:
    """Aggregates that tell sets of members apart: their number and 128 bits."""
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(member)).alias("one"), F.bit_xor(F.xxhash64(member, F.lit("other"))).alias("two")]


def consumer_groups(endpoints: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, queue, mode, their_job, n, one, two) for each group of consumers, and its members (..., record_id)."""
    members = bound_endpoints(endpoints, bindings).where("eligible and role = 'consumer'").select("kind", "queue", "mode", F.col("job").alias("their_job"), "record_id").distinct()
    return members.groupBy(*GROUP).agg(*set_digest("record_id")), members


def selections(endpoints: DataFrame, bindings: DataFrame) -> DataFrame:
    """Correlations with contract and selection, a text that is equal for equal sets of consumers."""
    groups, _ = consumer_groups(endpoints, bindings)
    sent = bound_endpoints(endpoints, bindings).where("eligible and role = 'producer'").select("record_id", "kind", "queue", "mode", "job")
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731 consumers of any job have the empty name
    asked = sent.select("kind", "queue", "mode", "job").distinct().withColumn("name", F.explode(F.array_distinct(F.array(F.lit(""), named("job")))))
    contracts = asked.join(groups.withColumn("name", named("their_job")), ["kind", "queue", "mode", "name"])
    whole = contracts.groupBy("kind", "queue", "mode", "job").agg(F.concat_ws(":", F.sum("n"), F.bit_xor("one"), F.bit_xor("two")).alias("selection"))
    same = reduce(Column.__and__, [F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("kind", "queue", "mode", "job")])
    chosen = sent.alias("s").join(whole.alias("w"), same).select("record_id", "selection")
    rows = correlate(endpoints, bindings).join(endpoints.select("record_id", "contract", "role", "service_ns"), ["record_id", "role"]).join(chosen, "record_id", "left")
    reason = lambda state: F.when(F.col("state") == state, F.col("reason"))
    own = F.when(F.col("role") == "consumer", F.lit("own")).otherwise(F.coalesce("selection", F.lit("0")))
    return rows.withColumns({"selection": own, "unmatched_reason": reason("unmatched"), "ambiguity_reason": reason("ambiguous")})


def unique_on_both(before: DataFrame, after: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides without keys that are not unique on one of them, and (side, key...) of those."""
    counted = before.select(*key, F.lit("before").alias("side")).unionByName(after.select(*key, F.lit("after").alias("side")))
    several = counted.groupBy("side", *key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    taken = several.select(*key).distinct()
    return before.join(taken, key, "left_anti"), after.join(taken, key, "left_anti"), several


def reasons_of_change(before: DataFrame, after: DataFrame, key: list[str], noun: str, reasons: dict[str, str]) -> DataFrame:
    """(key..., change, reasons, before, after): what is new, gone or differs, before and after as structs of the columns."""
    kept = lambda df, side: df.select(*key, F.struct(*reasons).alias(side))
    both = kept(before, "before").join(kept(after, "after"), key, "full_outer")
    differs = F.filter(F.array(*[F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), why) for c, why in reasons.items()]), lambda r: r.isNotNull())
    lone = lambda side: F.col(side).isNull()
    why = F.when(lone("before"), F.array(F.lit(f"{noun}_added"))).when(lone("after"), F.array(F.lit(f"{noun}_removed"))).otherwise(differs)
    change = F.when(lone("before"), "added").when(lone("after"), "removed").otherwise("modified")
    return both.select(*key, change.alias("change"), why.alias("reasons"), "before", "after").where(F.size("reasons") > 0)


def known_services(observations: DataFrame, side: str) -> DataFrame:
    return observations.where(F.col("side") == side).where(F.col("state").isin(*KNOWN)).select("service_ns").distinct()


def diff_endpoints(before: DataFrame, after: DataFrame, observations: DataFrame) -> DataFrame:
    """(role, record_id, change, reasons, before, after) of endpoints whose service is known on the other side: what is gone
    from a service that was not observed is not removed. Sides have role, record_id, service_ns, kind, contract, transport and
    realm; keys that repeat on a side are left out (unique_on_both)."""
    here = before.join(known_services(observations, "after"), "service_ns", "left_semi")
    there = after.join(known_services(observations, "before"), "service_ns", "left_semi")
    left, right, _ = unique_on_both(here, there, ["role", "record_id"])
    return reasons_of_change(left, right, ["role", "record_id"], "endpoint", ENDPOINT_REASONS)


def comparable(observations: DataFrame, topology: dict[str, str]) -> DataFrame:
    """One row (ok): whether correlations can be compared: each service and the topology known on both sides."""
    known = F.coalesce(F.bool_and(F.col("state").isin(*KNOWN)), F.lit(True))
    return observations.agg((known & F.lit(all(topology.get(s, "missing") in KNOWN for s in ("before", "after")))).alias("ok"))


def diff_selections(before: DataFrame, after: DataFrame, observations: DataFrame, topology: dict[str, str]) -> DataFrame:
    """(role, record_id, change, reasons, before, after) of correlations, as `selections` gives them for either side. None at
    all unless everything was observed: any service may hold a consumer of any producer."""
    left, right, _ = unique_on_both(before, after, ["role", "record_id"])
    changes = reasons_of_change(left, right, ["role", "record_id"], "correlation", CORRELATION_REASONS)
    return changes.crossJoin(F.broadcast(comparable(observations, topology))).where("ok").drop("ok")


def diff_candidates(changes: DataFrame) -> DataFrame:
    """(record_id, change, reason, before_realm, after_realm) of producers' candidates in a declared realm, over
    diff_selections."""
    side = lambda s: F.when(F.col(f"{s}.state") == "declared_realm_candidate", F.struct(f"{s}.selection", f"{s}.broker_realm"))
    rows = changes.where("role = 'producer'").select("record_id", side("before").alias("b"), side("after").alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("modified")
    rows = rows.where("(b is not null or a is not null) and not (b <=> a)").withColumn("change", change)
    return rows.select("record_id", "change", F.concat(F.lit("candidate_"), "change").alias("reason"), F.col("b.broker_realm").alias("before_realm"), F.col("a.broker_realm").alias("after_realm"))


def changed_members(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, queue, mode, their_job, record_id, change): consumers that joined or left a group; of groups with equal digests
    no member is read. Sides are as consumer_groups gives them."""
    flat = lambda df: df.withColumn("their_job", F.coalesce(F.concat(F.lit("="), "their_job"), F.lit("")))  # noqa: E731 a null is a key
    pairs = [(flat(groups), flat(members)) for groups, members in (before, after)]
    moved = pairs[0][0].withColumn("side", F.lit(0)).unionByName(pairs[1][0].withColumn("side", F.lit(1))).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("sides"), *[F.count_distinct(c).alias(f"d_{c}") for c in ("n", "one", "two")])
    moved = moved.where("sides = 1 or d_n > 1 or d_one > 1 or d_two > 1").select(*GROUP)
    left, right = (members.join(moved, GROUP, "left_semi") for _, members in pairs)
    lone = lambda a, b, change: a.join(b, [*GROUP, "record_id"], "left_anti").withColumn("change", F.lit(change))
    rows = lone(right, left, "added").unionByName(lone(left, right, "removed"))
    return rows.withColumn("their_job", F.when(F.col("their_job") != "", F.expr("substr(their_job, 2)")))


def uncertainties(observations: DataFrame, topology: dict[str, str], ambiguous: dict[str, DataFrame]) -> DataFrame:
    """(code, side, subject) of what cannot be told: artifacts that are missing or incompatible, correlations then, and keys
    that are not unique (unique_on_both, by what they are keys of)."""
    spark = observations.sparkSession
    bad = observations.where(~F.col("state").isin(*KNOWN)).select(F.concat(F.lit("SERVICE_ARTIFACT_"), F.upper("state")).alias("code"), "side", F.concat(F.lit("service:"), "service_ns").alias("subject")).distinct()
    of = [(f"TOPOLOGY_ARTIFACT_{topology.get(s, 'missing').upper()}", s, "topology") for s in ("before", "after") if topology.get(s, "missing") not in KNOWN]
    rows = bad.unionByName(spark.createDataFrame(of, "code string, side string, subject string"))
    rows = rows.unionByName(comparable(observations, topology).where("not ok").select(F.lit("CORRELATION_FACTS_UNAVAILABLE").alias("code"), F.lit("both").alias("side"), F.lit("correlations").alias("subject")))
    for name, df in ambiguous.items():
        keys = [c for c in df.columns if c != "side"]
        rows = rows.unionByName(df.select(F.lit("SEMANTIC_IDENTITY_AMBIGUOUS").alias("code"), "side", F.concat_ws(":", F.lit(name), *keys).alias("subject")))
    return rows


def transition_summary(parts: dict[str, DataFrame], correlations: DataFrame, unknown: DataFrame) -> DataFrame:
    """(family, change, n): the rows of each diff by change, correlations that became ambiguous or no longer are, and what
    cannot be told."""
    counted = [df.groupBy("change").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("family"), "change", "n") for name, df in parts.items()]
    was, is_ = (F.coalesce(F.col(f"{s}.state") == "ambiguous", F.lit(False)) for s in ("before", "after"))
    turned = correlations.select(F.when(~was & is_, "introduced").when(was & ~is_, "resolved").alias("change")).where("change is not null")
    counted.append(turned.groupBy("change").agg(F.count(F.lit(1)).alias("n")).select(F.lit("ambiguities").alias("family"), "change", "n"))
    counted.append(unknown.groupBy(F.col("code").alias("change")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("uncertainties").alias("family"), "change", "n"))
    return reduce(DataFrame.unionByName, counted)
