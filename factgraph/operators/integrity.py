"""Integrity checks: filters, anti-joins and grouped counts over fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each predicate leads from and to.
PREDICATE_KINDS = (
    ("ENDPOINT_IMPLEMENTED_BY", "endpoint", "method"), ("METHOD_CALLS_METHOD", "method", "method"), ("CLASS_INJECTS_CLASS", "class", "class"), ("CLASS_INJECTS_REPOSITORY", "class", "repository_binding"),
    ("REPOSITORY_FOR_ENTITY", "repository_binding", "entity"), ("ENTITY_MAPS_TO_TABLE", "entity", "table"), ("METHOD_READS_TABLE", "method", "table"), ("METHOD_WRITES_TABLE", "method", "table"),
    ("ENDPOINT_USES_GUARD", "endpoint", "guard"), ("MODULE_IMPORTS_MODULE", "module", "module"), ("MODULE_PROVIDES_CLASS", "module", "class"), ("MODULE_EXPORTS_CLASS", "module", "class"),
    ("MODULE_EXPORTS_MODULE", "module", "module"), ("MODULE_DECLARES_CONTROLLER", "module", "class"), ("MODULE_REGISTERS_GLOBAL_GUARD", "module", "guard"), ("APPLICATION_REGISTERS_GLOBAL_GUARD", "module", "guard"),
    ("METHOD_DECLARES_REQUEST_PARAMETER", "method", "request_parameter"), ("METHOD_DECLARES_RESPONSE", "method", "response_contract"), ("CONTRACT_TYPE_DECLARES_FIELD", "contract_type", "contract_field"),
    ("ENTITY_DECLARES_COLUMN", "entity", "entity_column"), ("REQUEST_PARAMETER_HAS_FIELD_ORIGIN", "request_parameter", "request_field_origin"), ("REQUEST_FIELD_MAY_FLOW_TO_COLUMN", "request_field_origin", "entity_column"),
    ("APPLICATION_USES_ROOT_MODULE", "application", "module"), ("METHOD_INITIATES_INTERACTION", "method", "interaction"), ("INTERACTION_MATCHES_LOCAL_HANDLER", "interaction", "interaction_handler"),
    ("HANDLER_IMPLEMENTED_BY", "interaction_handler", "method"), ("METHOD_ACCESSES_RESOURCE", "method", "resource_access"),
)


def check_ids(envelope: DataFrame) -> DataFrame:
    """envelope: (id, kind, payload). One row for each id that occurs more than once, with equal content
    (duplicate_id) or not (id_collision), or whose prefix is not its kind (wrong_prefix)."""
    groups = envelope.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.sha2("payload", 256)).alias("lo"), F.max(F.sha2("payload", 256)).alias("hi"),
        F.max((F.substring_index("id", ":", 1) != F.col("kind")).cast("int")).alias("odd"),
    )
    issue = F.when(F.col("lo") != F.col("hi"), "id_collision").when(F.col("n") > 1, "duplicate_id").when(F.col("odd") == 1, "wrong_prefix")
    return groups.select("id", "n", issue.alias("issue")).where("issue is not null")


def check_references(edges: DataFrame, envelope: DataFrame, rules: DataFrame) -> DataFrame:
    """edges: (subject_id, predicate, object_id); rules: (predicate, subject_kind, object_kind), a closed list (PREDICATE_KINDS). One row
    for each end that is missing or of a kind that the predicate does not allow, and for each predicate without a rule."""
    known = envelope.select("id", "kind").distinct()
    ends = edges.join(F.broadcast(rules), "predicate").select(
        "subject_id", "predicate", "object_id",
        F.explode(F.array(
            F.struct(F.lit("subject").alias("end"), F.col("subject_id").alias("id"), F.col("subject_kind").alias("want")),
            F.struct(F.lit("object").alias("end"), F.col("object_id").alias("id"), F.col("object_kind").alias("want")),
        )).alias("checked"),
    ).select("predicate", "checked.*").where("id is not null")
    issue = F.when(F.col("kind").isNull(), "missing_reference").when(F.col("kind") != F.col("want"), "wrong_kind")
    odd = edges.select("predicate").distinct().join(F.broadcast(rules.select("predicate")), "predicate", "left_anti")
    odd = odd.select("predicate", F.lit("predicate").alias("end"), F.col("predicate").alias("id"), F.lit("unknown_predicate").alias("issue"))
    return ends.join(known, "id", "left").select("predicate", "end", "id", issue.alias("issue")).where("issue is not null").distinct().unionByName(odd)


def check_assertions(assertions: DataFrame) -> DataFrame:
    """assertions: (subject_id, predicate, object_id, status_rank, n_evidence). A resolved or ambiguous edge needs an
    object, a resolved one evidence."""
    issue = F.when((F.col("status_rank") <= 2) & F.col("object_id").isNull(), "target_missing").when(
        (F.col("status_rank") == 1) & (F.coalesce("n_evidence", F.lit(0)) == 0), "evidence_missing"
    )
    return assertions.select("subject_id", "predicate", "object_id", issue.alias("issue")).where("issue is not null")


def check_evidence(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence whose hash differs from its file's, and ranges that start after they end. Ranges are half-open."""
    backwards = (F.col("start_line") > F.col("end_line")) | ((F.col("start_line") == F.col("end_line")) & (F.col("start_column") > F.col("end_column")))
    joined = evidence.join(files.select("file_id", F.col("content_hash").alias("file_hash")), "file_id", "left")
    issue = F.when(F.col("file_hash").isNull(), "file_missing").when(F.col("content_hash") != F.col("file_hash"), "hash_differs").when(backwards, "range_reversed")
    return joined.select("evidence_id", "file_id", issue.alias("issue")).where("issue is not null")


def check_duplicate_refs(df: DataFrame, key: str, col: str) -> DataFrame:
    """References that a set column holds more than once."""
    items = df.select(key, F.explode(col).alias("ref"))
    return items.groupBy(key, "ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
