"""Comparing two snapshots by semantic key. A key that is not unique on a side is reported, never paired by order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions.columns import semantic_key
from factgraph.operators.walk import walk


def project_keys(files: DataFrame, classes: DataFrame, methods: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(kind, id, key): keys built from the file down, independent of ids."""
    source = files.select(F.lit("source").alias("kind"), F.col("file_id").alias("id"), semantic_key("source", F.col("path")).alias("key"))
    cls = classes.join(source.select(F.col("id").alias("file_id"), F.col("key").alias("parent")), "file_id")
    cls = cls.select(F.lit("class").alias("kind"), F.col("class_id").alias("id"), semantic_key("class", F.col("parent"), F.col("qualified_name")).alias("key"))
    met = methods.join(cls.select(F.col("id").alias("class_id"), F.col("key").alias("parent")), "class_id")
    met = met.select(F.lit("method").alias("kind"), F.col("method_id").alias("id"), semantic_key("method", F.col("parent"), F.col("name")).alias("key"))
    ends = endpoints.select(F.lit("endpoint").alias("kind"), F.col("endpoint_id").alias("id"), semantic_key("endpoint", F.col("http_method"), F.col("path")).alias("key"))
    return source.unionByName(cls).unionByName(met).unionByName(ends)


def key_collisions(keys: DataFrame) -> DataFrame:
    groups = keys.groupBy("kind", "key").agg(F.count_distinct("id").alias("n"), F.array_join(F.sort_array(F.collect_set("id")), ";").alias("ids"))
    return groups.where("n > 1")


def diff_keyed(before: DataFrame, after: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """(key, change, reasons): added, removed, modified (with the columns that differ) or ambiguous (a side has the key more
    than once)."""
    side = lambda df, name: df.select(F.lit(name).alias("side"), *key, *compare)
    return diff_sides(side(before, "before").unionByName(side(after, "after")), key, compare)


def diff_sides(rows: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """The same of rows that have a side: both sides of a key meet in one aggregation, never in a join."""
    of = lambda s, c: F.when(F.col("side") == s, c)
    counted = [F.count(of(s, F.lit(1))).alias(f"{s}_n") for s in ("before", "after")]
    both = rows.groupBy(*key).agg(*counted, *[F.min(of(s, F.col(c))).alias(f"{s}_{c}") for s in ("before", "after") for c in compare])
    changed = [F.when(~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")), F.lit(c)) for c in compare]
    reasons = F.array_join(F.array_compact(F.array(*changed)), ";") if compare else F.lit("")
    change = F.when(F.greatest("before_n", "after_n") > 1, "ambiguous").when(F.col("before_n") == 0, "added").when(F.col("after_n") == 0, "removed").when(reasons != "", "modified")
    return both.select(*key, change.alias("change"), F.when(change == "modified", reasons).alias("reasons")).where("change is not null")


def of_both(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: (key, before_n, after_n, before_rank, after_rank), how often a side has it and the best rank there.
    rows: (key, before_rank, after_rank, copies), a side's rank null where it has none; rows of a key are one record but for
    copies (1), each of which is one of its own."""
    here = lambda s: F.col(f"{s}_rank").isNotNull()
    n = lambda s: F.greatest(F.sum(F.when(here(s), F.col("copies")).otherwise(0)), F.max(F.when(here(s), 1).otherwise(0)))
    return rows.groupBy(*key).agg(*[n(s).alias(f"{s}_n") for s in ("before", "after")], *[F.min(f"{s}_rank").alias(f"{s}_rank") for s in ("before", "after")])


def change_of_both() -> Column:
    """The change of a row of of_both, as diff_keyed has it; null where nothing changed."""
    differ = ~F.col("before_rank").eqNullSafe(F.col("after_rank"))
    return F.when(F.greatest("before_n", "after_n") > 1, "ambiguous").when(F.col("before_n") == 0, "added").when(F.col("after_n") == 0, "removed").when(differ, "modified")


def of_either(both: DataFrame) -> DataFrame:
    """(side, the other columns, status_rank): the edges of both sides that can be walked, of rows that hold a rank for each."""
    ranks = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_rank").alias("status_rank")) for s in ("before", "after")]))
    rest = [c for c in both.columns if c.split("_")[0] not in ("before", "after")]
    return both.select(*rest, ranks.alias("of")).where("of.status_rank <= 2 and object_id is not null").select("of.side", *rest, "of.status_rank")


def diff_endpoints(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before_id, after_id, http_method, path, match). Sides: (endpoint_id, http_method, path, handler).

    Slots that a side holds twice are blocked. Of the rest, endpoints of equal slot and handler are matched (exact), then
    what is left in equal slots (slot). All others, blocked ones included, are removed or added.
    """
    slot = ["http_method", "path"]
    lone = lambda df: df.groupBy(*slot).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*slot)
    b = before.select(F.col("endpoint_id").alias("before_id"), *slot, F.col("handler").alias("before_handler"))
    a = after.select(F.col("endpoint_id").alias("after_id"), *slot, F.col("handler").alias("after_handler"))
    # A slot that is single on both sides pairs its two endpoints in the second or the third pass.
    paired = b.join(lone(b), slot).join(a.join(lone(a), slot), slot)
    match = F.when(F.col("before_handler").eqNullSafe(F.col("after_handler")), "exact").otherwise("slot")
    paired = paired.select("before_id", "after_id", *slot, match.alias("match"))
    gone = b.join(paired.select("before_id"), "before_id", "left_anti").select("before_id", F.lit(None).cast("string").alias("after_id"), *slot, F.lit("removed").alias("match"))
    new = a.join(paired.select("after_id"), "after_id", "left_anti").select(F.lit(None).cast("string").alias("before_id"), "after_id", *slot, F.lit("added").alias("match"))
    return paired.unionByName(gone).unionByName(new)


def of_pairs(pairs: DataFrame) -> DataFrame:
    """(side, endpoint_id, before_id, after_id): both endpoints of each pair."""
    both = pairs.where("before_id is not null and after_id is not null").select("before_id", "after_id")
    one = lambda side: both.select(F.lit(side).alias("side"), F.col(f"{side}_id").alias("endpoint_id"), "before_id", "after_id")
    return one("before").unionByName(one("after"))


def endpoint_reasons(ends: DataFrame, facets: dict[str, DataFrame | None], changed: DataFrame) -> DataFrame:
    """(before_id, after_id, reasons): facets that differ, in their order. ends: see of_pairs. A facet is (side, endpoint_id,
    value) rows, of which a side's values are compared as a set, or None if changed, (before_id, after_id, facet), tells it.

    All facets' rows meet their pair in one join and are counted within it, in the tasks that this leaves them in."""
    rows = reduce(DataFrame.unionByName, [df.select("side", "endpoint_id", F.lit(n).alias("facet"), "value") for n, df in facets.items() if df is not None])
    met = rows.join(ends, ["side", "endpoint_id"]).repartition("before_id")
    on = lambda side: F.bool_or(F.col("side") == side).alias(side)
    values = met.groupBy("before_id", "after_id", "facet", "value").agg(on("before"), on("after"))
    differ = F.bool_or(F.col("value").isNotNull() & (F.col("before") != F.col("after"))) | (F.bool_or("before") != F.bool_or("after"))
    found = values.groupBy("before_id", "after_id", "facet").agg(differ.alias("differ")).where("differ").drop("differ").unionByName(changed)
    place = F.array_position(F.array(*map(F.lit, facets)), F.col("facet"))
    ordered = F.sort_array(F.collect_set(F.struct(place.alias("place"), "facet")))
    return found.groupBy("before_id", "after_id").agg(F.array_join(ordered["facet"], ";").alias("reasons"))


def changed_terminals(starts: DataFrame, steps: DataFrame, access: DataFrame, depth: int = 3) -> DataFrame:
    """(before_id, after_id): the pairs whose terminals differ, by table, predicate and best status over all paths.

    starts: (before_id, after_id, side, node, rank), the pairs' handlers; steps and access: edges with a side. Both sides are
    walked at once, a node being a side's. What a method accesses is one row for both sides, and so is that a pair reaches it,
    so that what both sides have meets once."""
    least = [F.min(F.when(F.col("side") == s, F.col("status_rank"))).alias(f"{s}_status_rank") for s in ("before", "after")]
    return differing_terminals(starts, steps, access.groupBy(F.col("subject_id").alias("node"), "predicate", "object_id").agg(*least), depth)


def differing_terminals(starts: DataFrame, steps: DataFrame, own: DataFrame, depth: int = 3) -> DataFrame:
    """The same with what methods access in one row for both sides: (node, predicate, object_id, before_status_rank,
    after_status_rank)."""
    on = lambda c: F.concat(F.col("side"), F.lit("/"), F.col(c)).alias(c)
    least = lambda c: [F.min(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("before", "after")]
    reached = walk(starts.select(F.struct("before_id", "after_id").alias("root"), on("node"), "rank"), steps.select(on("subject_id"), on("object_id"), "status_rank"), depth)
    reached = reached.select("root", F.substring_index("node", "/", 1).alias("side"), F.expr("substr(node, instr(node, '/') + 1)").alias("node"), "rank")
    reached = reached.groupBy("root", "node").agg(*least("rank"))
    met = [F.when(F.col(f"{s}_rank").isNotNull() & F.col(f"{s}_status_rank").isNotNull(), F.greatest(f"{s}_rank", f"{s}_status_rank")).alias(s) for s in ("before", "after")]
    found = reached.join(own, "node").select("root", "predicate", "object_id", *met).where("before is not null or after is not null").repartition("root")
    best = found.groupBy("root", "predicate", "object_id").agg(F.min("before").alias("before"), F.min("after").alias("after"))
    named = F.col("predicate").isNotNull() & F.col("object_id").isNotNull()
    differ = F.bool_or(named & ~F.col("before").eqNullSafe(F.col("after"))) | (F.bool_or(F.col("before").isNotNull()) != F.bool_or(F.col("after").isNotNull()))
    return best.groupBy("root").agg(differ.alias("differ")).where("differ").select("root.before_id", "root.after_id")


def diff_files(before: DataFrame, after: DataFrame) -> DataFrame:
    return diff_keyed(before, after, ["path"], ["content_hash"])


def merge_ambiguities(rows: DataFrame) -> DataFrame:
    """rows: (kind, key, side, candidate). One row a key with side before, after or both and all candidates."""
    side = F.when(F.count_distinct("side") > 1, "both").otherwise(F.min("side"))
    return rows.groupBy("kind", "key").agg(side.alias("side"), F.array_join(F.sort_array(F.collect_set("candidate")), ";").alias("candidates"))


def change_feed(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(family, subject, change, reasons) from diffs of several families; each with the column that names its subject."""
    rows = [df.select(F.lit(name).alias("family"), subject.alias("subject"), "change", F.coalesce("reasons", F.lit("")).alias("reasons")) for name, (df, subject) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def diff_summary(feed: DataFrame) -> DataFrame:
    return feed.groupBy("family", "change").agg(F.count(F.lit(1)).alias("n"))
