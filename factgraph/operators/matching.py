"""Joins: catalogue, guards, authorization, producers and handlers, regions, slots, bindings, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def endpoint_catalogue(endpoints: DataFrame, implementations: DataFrame, methods: DataFrame, classes: DataFrame, controller: str | None = None, route: str | None = None) -> DataFrame:
    """Endpoint, handler, class, file and status: ambiguous where the slot is not its own, unresolved without handler. Only
    those of a controller (its qualified name) or below a route (whole segments), if these are given; a slot is counted
    over all endpoints."""
    slots = endpoints.groupBy("http_method", "path").agg(F.count(F.lit(1)).alias("in_slot"))
    if route is not None:
        below = F.col("path").startswith(route.rstrip("/") + "/") | (F.col("path") == route)
        endpoints = endpoints.where(below)
    rows = (
        endpoints.join(slots, ["http_method", "path"])
        .join(implementations.select(F.col("subject_id").alias("endpoint_id"), F.col("object_id").alias("method_id"), "status_rank"), "endpoint_id", "left")
        .join(methods.select("method_id", "class_id"), "method_id", "left").join(classes.select("class_id", "file_id", "qualified_name"), "class_id", "left")
    )
    if controller is not None:
        rows = rows.where(F.col("qualified_name") == controller)
    status = F.when(F.col("in_slot") > 1, "ambiguous").when(F.col("method_id").isNull() | (F.col("status_rank") > 2), "unresolved").when(F.col("status_rank") == 2, "ambiguous").otherwise("resolved")
    return rows.select("endpoint_id", "http_method", "path", "method_id", "class_id", "file_id", status.alias("status"))


def effective_guards(endpoints: DataFrame, uses: DataFrame, global_guards: DataFrame) -> DataFrame:
    """(endpoint_id, guard_id, scope, position, state): global guards in their order, then the controller's, then the
    method's. endpoints: (endpoint_id, service_ns). The global set of a service is joined by its name."""
    glob = endpoints.join(global_guards, "service_ns").select("endpoint_id", "guard_id", F.lit("global").alias("scope"), F.col("guard_order").cast("int").alias("place"), F.lit(1).alias("status_rank"))
    own = uses.join(endpoints.select("endpoint_id"), "endpoint_id").select("endpoint_id", "guard_id", "scope", F.lit(0).alias("place"), "status_rank")
    rank = F.when(F.col("scope") == "global", 0).when(F.col("scope") == "controller", 1).otherwise(2)
    position = F.row_number().over(Window.partitionBy("endpoint_id").orderBy(rank, "place", "guard_id"))
    state = F.when(F.col("status_rank") == 1, "proven").otherwise("unproven")
    return glob.unionByName(own).select("endpoint_id", "guard_id", "scope", position.alias("position"), state.alias("state"))


def endpoint_authorization(metadata: DataFrame, enforcement: DataFrame) -> DataFrame:
    """Requirements of each endpoint with what enforces them."""
    proofs = enforcement.select("metadata_id", "state", "guard_id", "evidence_id")
    return metadata.join(proofs, "metadata_id").select("endpoint_id", "metadata_id", "metadata_key", "scope", "state", "guard_id", "evidence_id")


def evidence_locations(df: DataFrame, key: str, evidence: DataFrame, files: DataFrame) -> DataFrame:
    """(key, locations): the places of each key's evidence ids as path:line:column, sorted, joined by ';'."""
    ids = df.select(key, F.explode("evidence_ids").alias("evidence_id")).distinct()
    places = ids.join(evidence, "evidence_id").join(files.select("file_id", "path"), "file_id")
    at = F.concat_ws(":", "path", "start_line", "start_column")
    return places.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(at)), ";").alias("locations"))


def way() -> Column:
    """What a message must share besides its queue: mode and transport, unknown (null) unless both are known. '' for others."""
    return F.when(F.col("kind") == "microservice_message", F.concat("mode", F.lit("/"), "transport")).otherwise("")


def contract_matches(interactions: DataFrame, handlers: DataFrame, scope: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(contract_id, kind, mode, job, handler_id) for each contract that producers have, and (interaction_id, contract_id).

    A contract is a kind and queue, a message's mode and transport, a job's name, and the columns of `scope` and `also`. A
    message fits handlers of its mode and transport where both sides know them; a job fits handlers of that job or of any
    (null); events fit by queue. A producer whose queue, or message's transport, is not known has no contract."""
    keys = [*scope, "kind", "queue", "way"]
    named = interactions.withColumns({"way": way(), "job": F.when(F.col("kind") == "job_queue", F.col("job"))}).where("queue is not null and way is not null")
    named = named.withColumn("contract_id", F.to_json(F.struct(*keys, "job", "mode", *also)))
    theirs = handlers.withColumn("way", way()).select("handler_id", *keys, F.col("job").alias("handler_job"))
    contracts = named.select("contract_id", *keys, "job", "mode", *also).distinct()
    fits = contracts.join(theirs, keys).where("kind <> 'job_queue' or handler_job is null or handler_job = job")
    return fits.select("contract_id", "kind", "mode", "job", *also, "handler_id"), named.select("interaction_id", "contract_id")


def match_exact(interactions: DataFrame, handlers: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(interaction_id, handler_id): same kind and queue, and what else their kind asks. Within one document or service if
    `scope` names its columns. See contract_matches."""
    matches, keys = contract_matches(interactions, handlers, scope)
    return keys.join(matches, "contract_id").select("interaction_id", "handler_id")


def cap_fan_out(matches: DataFrame, interactions: DataFrame, n: int) -> DataFrame:
    """The first n handlers of each producer, with how many there were, the diagnostic where some were left out, and the
    state: a request (mode request_response) that several handlers would answer is ambiguous."""
    total = matches.groupBy("interaction_id").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.partitionBy("interaction_id").orderBy("handler_id"))
    first = matches.withColumn("place", place).where(F.col("place") <= n)
    rows = first.join(total, "interaction_id").join(interactions.select("interaction_id", "kind", "mode"), "interaction_id")
    asked = (F.col("kind") == "microservice_message") & (F.col("mode") == "request_response")
    state = F.when(asked & (F.least("total", F.lit(n)) > 1), "ambiguous").otherwise("resolved")
    return rows.select("interaction_id", "handler_id", "place", "total", state.alias("state"), F.when(F.col("total") > n, "FAN_OUT_LIMIT").alias("diagnostic"))


def select_branches(matches: DataFrame, interactions: DataFrame, branches: DataFrame) -> DataFrame:
    """(interaction_id, branch_id, verdict): whether a handler's branch runs for the producer's job."""
    rows = matches.join(interactions.select("interaction_id", "job"), "interaction_id").join(branches, "handler_id")
    listed = F.array_contains(F.split("jobs", ","), F.col("job"))
    verdict = (
        F.when(F.col("selector_kind") == "all_jobs", "matches").when((F.col("selector_kind") == "unknown") | F.col("job").isNull(), "unknown")
        .when(F.col("selector_kind") == "exact_jobs", F.when(listed, "matches").otherwise("does_not_match"))
        .otherwise(F.when(listed, "does_not_match").otherwise("matches"))
    )
    return rows.select("interaction_id", "branch_id", verdict.alias("verdict"))


def line_blocks(ranges: DataFrame, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """ranges with (level, block): a range lies in at most two blocks of 2^level lines, the power that its length asks for."""
    level = F.ceil(F.log2(F.col(end) - F.col(start) + 1)).cast("int")
    leveled = ranges.where(F.col(start) <= F.col(end)).withColumn("level", level)
    return leveled.withColumn("block", F.explode(F.expr(f"sequence(shiftright({start}, level), shiftright({end}, level))")))


def attribute_regions(evidence: DataFrame, regions: DataFrame) -> DataFrame:
    """(evidence_id, region_id): the regions that hold an evidence range whole, within one file.

    Regions are put into blocks of lines, of a size by their own length; evidence looks into the block of its start at each
    size that its file has, of which there are no more than a line number has bits. So files with very many ranges are
    joined by block, not each with each."""
    code = lambda p, x: F.col(f"{p}.{x}_line").cast("long") * (1 << 20) + F.col(f"{p}.{x}_column")
    inside = (code("e", "start") >= code("r", "start")) & (code("e", "end") <= code("r", "end"))
    blocks = line_blocks(regions)
    levels = blocks.groupBy("file_id").agg(F.collect_set("level").alias("levels"))
    asked = evidence.join(levels, "file_id").withColumn("level", F.explode("levels")).drop("levels").withColumn("block", F.expr("shiftright(start_line, level)"))
    same = [F.col(f"e.{c}") == F.col(f"r.{c}") for c in ("file_id", "level", "block")]
    return asked.alias("e").join(blocks.alias("r"), [*same, inside]).select("e.evidence_id", "r.region_id")


def match_api_slots(slots: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(http_method, path, theirs, ours, state, duplicates): an external list against our endpoints, both sides' leftovers
    included; duplicates names our endpoints of a slot that holds several."""
    a = slots.groupBy("http_method", "path").agg(F.count(F.lit(1)).alias("theirs"))
    several = F.when(F.count(F.lit(1)) > 1, F.array_join(F.sort_array(F.collect_list("endpoint_id")), ";"))
    b = endpoints.groupBy("http_method", "path").agg(F.count(F.lit(1)).alias("ours"), several.alias("duplicates"))
    both = a.join(b, ["http_method", "path"], "full_outer").fillna(0, ["theirs", "ours"])
    state = F.when(F.col("theirs") == 0, "not_listed").when(F.col("ours") == 0, "unmatched").when((F.col("ours") > 1) | (F.col("theirs") > 1), "ambiguous").otherwise("resolved")
    return both.withColumn("state", state)


def api_summary(slots: DataFrame) -> DataFrame:
    """Counts of slots by state, with the entries of either side in them."""
    return slots.groupBy("state").agg(F.count(F.lit(1)).alias("slots"), F.sum("theirs").alias("theirs"), F.sum("ours").alias("ours"))


def bind_topology(interactions: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(interaction_id, realm_id, state) with more than one realm an error, and the bindings that nothing used."""
    hits = interactions.select("interaction_id", "service_ns", "queue").join(bindings, ["service_ns", "queue"], "left")
    bound = hits.groupBy("interaction_id").agg(F.count("realm_id").alias("n"), F.min("realm_id").alias("realm"))
    state = F.when(F.col("n") == 0, "unbound").when(F.col("n") == 1, "bound").otherwise("conflict")
    unused = bindings.join(interactions.select("service_ns", "queue").distinct(), ["service_ns", "queue"], "left_anti")
    return bound.select("interaction_id", F.when(F.col("n") == 1, F.col("realm")).alias("realm_id"), state.alias("state")), unused


def column_lineage(parameters: DataFrame, origins: DataFrame, influences: DataFrame, columns: DataFrame) -> DataFrame:
    """(parameter_id, property_path, column_id, label, column_name, hops, state): the weakest of a path's states wins."""
    best = influences.groupBy("origin_id", "column_id").agg(F.max("state_rank").alias("state_rank"), F.min("hops").alias("hops"))
    rows = origins.join(parameters, "parameter_id").join(best, "origin_id").join(columns, "column_id")
    label = F.concat("source_kind", F.when(F.col("selector").isNull(), "").otherwise(F.concat(F.lit("."), F.col("selector"))), F.lit("."), F.col("property_path"))
    state = F.element_at(F.array(F.lit("direct"), F.lit("derived"), F.lit("unknown")), F.col("state_rank"))
    return rows.select("origin_id", "column_id", label.alias("label"), F.coalesce("database_name", "property_name").alias("column_name"), "hops", state.alias("state"))
