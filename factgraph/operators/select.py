"""Selection: resolving selectors, filters, pages, bounded groups and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators.matching import line_blocks


def resolution(n: Column) -> Column:
    return F.when(n == 0, "not_found").when(n == 1, "resolved").otherwise("ambiguous")


def resolve_endpoints(selectors: DataFrame, endpoints: DataFrame) -> DataFrame:
    """selectors: (selector_id, http_method, path). All matches count; none is picked. Returns selector_id, state,
    n_matches, endpoint_ids (sorted)."""
    slots = endpoints.groupBy("http_method", "path").agg(F.sort_array(F.collect_set("endpoint_id")).alias("endpoint_ids"))
    joined = selectors.join(slots, ["http_method", "path"], "left")
    n = F.coalesce(F.size("endpoint_ids"), F.lit(0))
    n = F.when(F.col("endpoint_ids").isNull(), 0).otherwise(n).cast("long")
    return joined.select("selector_id", resolution(n).alias("state"), n.alias("n_matches"), "endpoint_ids")


def resolve_symbols(selectors: DataFrame, symbols: DataFrame) -> DataFrame:
    """selectors: (selector_id, file_id, line, column); symbols: (symbol_id, file_id and a half-open range). A symbol
    matches if the position lies in its range. Ranges are met by blocks of lines within one file, see line_blocks."""
    at = F.col("line") * (1 << 20) + F.col("column")
    start, end = (F.col(f"{x}_line") * (1 << 20) + F.col(f"{x}_column") for x in ("start", "end"))
    blocks = line_blocks(symbols)
    levels = blocks.groupBy("file_id").agg(F.collect_set("level").alias("levels"))
    asked = selectors.join(levels, "file_id").withColumn("level", F.explode("levels")).drop("levels").withColumn("block", F.expr("shiftright(line, level)"))
    hits = asked.join(blocks, ["file_id", "level", "block"]).where((at >= start) & (at < end)).groupBy("selector_id").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("first"))
    n = F.coalesce("n", F.lit(0))
    return selectors.join(hits, "selector_id", "left").select("selector_id", resolution(n).alias("state"), n.alias("n_matches"), F.when(n == 1, F.col("first")).alias("symbol_id"))


def list_endpoints(endpoints: DataFrame, diagnostics: DataFrame, methods: list[str], prefix: str, has_diagnostics: bool | None = None) -> DataFrame:
    found = endpoints.where(F.col("http_method").isin(methods) & F.col("path").startswith(prefix))
    if has_diagnostics is None:
        return found
    subjects = diagnostics.select(F.col("subject_id").alias("endpoint_id")).where("endpoint_id is not null")
    return found.join(subjects, "endpoint_id", "left_semi" if has_diagnostics else "left_anti")


def paginate(df: DataFrame, key: str, cursor: str | None, limit: int) -> DataFrame:
    """The page of `limit` rows after the cursor, with total, skipped and remaining (counted in one aggregate)."""
    after = F.lit(True) if cursor is None else F.col(key) > F.lit(cursor)
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~after).alias("skipped"))
    page = df.where(after).orderBy(key).limit(limit)
    left = F.greatest(F.col("total") - F.col("skipped") - limit, F.lit(0))
    return page.crossJoin(F.broadcast(counts)).withColumn("remaining", left)  # counts is one row


def bounded_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with total, returned and omitted. Totals come from an aggregate of their own, and a
    group's first rows are found without sorting more than Spark's group limit keeps."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    first = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    returned = F.least(F.col("total"), F.lit(n).cast("long"))
    return first.join(total, keys).withColumn("returned", returned).withColumn("omitted", F.col("total") - returned)


def rank_findings(df: DataFrame, k: int) -> DataFrame:
    """The k most pressing findings: by severity, then category, then id."""
    level = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return df.withColumn("level", level).orderBy("level", "code", "diagnostic_id").limit(k)


def filter_policy(results: DataFrame, outcomes: list[str], severities: list[str], blocking: bool | None = None) -> DataFrame:
    found = results.where(F.col("outcome").isin(outcomes) & F.col("severity").isin(severities))
    return found if blocking is None else found.where(F.col("blocking") == blocking)


def distributed_candidates(correlations: DataFrame, kinds: list[str], states: list[str], producers: DataFrame) -> DataFrame:
    """Correlations of some kinds and states with their producers' rows attached."""
    return correlations.where(F.col("kind").isin(kinds) & F.col("state").isin(states)).join(producers, "interaction_id")
