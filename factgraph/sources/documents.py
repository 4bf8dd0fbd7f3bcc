"""Reading fact documents and inventories, merging fragments, writing evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.functions.columns import csv_cell
from factgraph.sources.staging import stage

TEXT = "struct<resolution:string,value:string>"
SHAPE = "struct<typeText:string,kind:string,source:string,alternatives:array<string>,contractTypeIds:array<string>>"
#: What an interaction is aimed at: of one kind, so most fields are null; `targetKind` tells which are meant.
TARGET = f"struct<targetKind:string,method:string,url:{TEXT},queryKeys:array<string>,identityKind:string,value:string,pattern:struct<kind:string,delimiter:string>,technology:string,queue:{TEXT},job:{TEXT},mode:string,patternKind:string,canonicalPattern:string,clientToken:{TEXT},transport:string>"
RESOURCE = "struct<kind:string,value:string,token:string,segments:array<struct<kind:string,value:string,token:string,index:int>>>"
RULE = "ruleId string, evidenceIds array<string>"

#: The record families of a fact document in the order of its versions: kind, first version, fields beside id.
FAMILIES = {
    "sourceFiles": ("source", 1, "path string, contentHash string, byteLength long"),
    "classes": ("class", 1, "sourceFileId string, qualifiedName string, displayName string, roles array<string>, declarationEvidenceId string"),
    "methods": ("method", 1, "classId string, qualifiedName string, displayName string, signature string, declarationEvidenceId string"),
    "endpoints": ("endpoint", 1, "httpMethod string, path string"),
    "guards": ("guard", 1, "classId string, displayName string"),
    "repositoryBindings": ("repository_binding", 1, "ownerClassId string, memberName string, declarationEvidenceId string"),
    "entities": ("entity", 1, "classId string, displayName string"),
    "tables": ("table", 1, "name string, nameSource string"),
    "assertions": ("assertion", 1, f"subjectId string, predicate string, objectId string, status string, {RULE}"),
    "evidence": ("evidence", 1, "fileId string, startLine int, startColumn int, endLine int, endColumn int, role string, snippet string, contentHash string"),
    "diagnostics": ("diagnostic", 1, "code string, severity string, message string, subjectId string, evidenceIds array<string>"),
    "modules": ("module", 2, "classId string, isGlobal boolean, metadataCompleteness string, declarationEvidenceId string"),
    "globalGuardRegistrations": ("global_guard_registration", 2, "guardId string, moduleId string, kind string, order int, assertionId string, registrationEvidenceId string"),
    "contractTypes": ("contract_type", 2, "sourceFileId string, qualifiedName string, displayName string, declarationKind string, shapeSource string, declarationEvidenceId string"),
    "contractFields": ("contract_field", 2, "contractTypeId string, declaringContractTypeId string, name string, typeText string, optional boolean, readonly boolean, inherited boolean, shapeSource string, declarationEvidenceId string, declaredConstraints array<struct<name:string,argumentTexts:array<string>,decoratorEvidenceId:string>>"),
    "requestParameters": ("request_parameter", 2, f"methodId string, parameterIndex int, parameterName string, sourceKind string, selector string, selectorState string, optional boolean, declaredType {SHAPE}, declarationEvidenceId string, decoratorEvidenceId string"),
    "responseContracts": ("response_contract", 2, f"methodId string, handling string, outerTypeText string, promiseUnwrapped boolean, declaredType {SHAPE}, declarationEvidenceId string, manualResponseEvidenceId string"),
    "entityColumns": ("entity_column", 2, "entityId string, declaringClassId string, propertyName string, databaseName string, databaseNameSource string, columnKind string, insert boolean, update boolean, transformer string, inherited boolean, declarationEvidenceId string, decoratorEvidenceId string"),
    "requestFieldOrigins": ("request_field_origin", 2, "requestParameterId string, propertyPath array<string>, contractFieldIds array<string>, resolution string, originEvidenceId string"),
    "columnInfluences": ("column_influence", 2, "methodId string, originId string, columnId string, state string, sinkKind string, sinkPropertyName string, assertionId string, sinkEvidenceId string, operationEvidenceId string, propagationEvidenceIds array<string>, callPath array<struct<callerMethodId:string,calleeMethodId:string,callEvidenceId:string>>"),
    "applications": ("application", 3, "kind string, rootModuleId string, rootResolution string, transportState string, transport string, bootstrapEvidenceId string"),
    "interactions": ("interaction", 3, f"kind string, sourceMethodId string, applicationId string, direction string, activation string, boundary string, dispatchTiming string, target {TARGET}, {RULE}"),
    "interactionHandlers": ("interaction_handler", 3, f"kind string, methodId string, applicationId string, registrationState string, target {TARGET}, configurationEvidenceIds array<string>, ruleId string, handlerEvidenceId string"),
    "interactionHandlerDispatches": ("handler_dispatch", 4, f"handlerId string, state string, branchIds array<string>, {RULE}"),
    "interactionHandlerBranches": ("handler_branch", 4, f"dispatchId string, selector struct<kind:string,jobs:array<string>,excludedJobs:array<string>>, controlFlow string, {RULE}"),
    "interactionHandlerBranchEffects": ("handler_branch_effect", 4, f"branchId string, kind string, targetId string, sourceAssertionId string, status string, {RULE}"),
    "authorizationMetadata": ("authorization_metadata", 5, f"endpointId string, scope string, metadataKey string, source string, decorator struct<kind:string,moduleSpecifier:string,exportedName:string,sourceFileId:string>, valueShape struct<kind:string,scalarType:string,itemCount:int,itemTypes:array<string>,dynamicItems:boolean,keys:array<string>,dynamicKeys:boolean,redacted:boolean>, {RULE}"),
    "authorizationEnforcements": ("authorization_enforcement", 5, f"metadataId string, endpointId string, state string, guardId string, guardAssertionId string, {RULE}"),
    "resourceAccesses": ("resource_access", 6, f"resourceKind string, operation string, technology string, api string, sourceMethodId string, target {RESOURCE}, selector {RESOURCE}, {RULE}"),
    "criticalSections": ("critical_section", 7, f"sourceMethodId string, lockResourceAccessIds array<string>, callbackKind string, callbackEvidenceId string, effectAssertionIds array<string>, {RULE}"),
}
#: What a document says of its analyses as a whole, by first version.
STATES = {
    "globalGuardAnalysis": (2, "struct<completeness:string,state:string>"),
    "interactionAnalysis": (3, "struct<schemaKinds:array<string>,supportedKinds:array<string>,enabledKinds:array<string>,state:string>"),
    "resourceAccessAnalysis": (6, "struct<supportedTechnologies:array<string>,enabledTechnologies:array<string>,state:string>"),
}
RUN = "struct<id:string,repositoryRevision:string,tsconfigPath:string,tool:struct<name:string,version:string,typescriptVersion:string>,configuration:string>"
SCHEMA = ", ".join([
    "schemaVersion string, runId string, resultState string", f"analysisRun {RUN}", *[f"{n} {t}" for n, (_, t) in STATES.items()],
    *[f"{n} array<struct<id string, {fields}>>" for n, (_, _, fields) in FAMILIES.items()], "unreadable string",
])
VERSIONS = tuple(f"{n}.0.0" for n in range(1, 9))


def problems(whole: bool) -> Column:
    """Why a document is not taken, an array: it cannot be read, is of an unknown version, has what its version has not, or
    (if it must be whole) lacks what its version has."""
    number = F.element_at(F.split("schemaVersion", r"\."), 1).cast("int")
    parts = {**{n: since for n, (_, since, _) in FAMILIES.items()}, **{n: since for n, (since, _) in STATES.items()}}
    early = [F.when(F.col(n).isNotNull() & (number < since), f"unexpected {n}") for n, since in parts.items() if since > 1]
    lacking = [F.when(F.col(n).isNull() & (number >= since), f"missing {n}") for n, since in parts.items()] if whole else []
    known = F.coalesce(F.col("schemaVersion").isin(*VERSIONS), F.lit(False))
    found = F.filter(F.array(*early, *lacking), lambda p: p.isNotNull())
    return F.when(F.col("unreadable").isNotNull(), F.array(F.lit("unreadable"))).when(~known, F.array(F.lit("unknown version"))).otherwise(found)


def read_documents(spark: SparkSession, path: str, whole: bool = False) -> dict[str, DataFrame]:
    """One table for each family, its rows with analysis_id (the file they come from); `runs`, one row a document that could be
    read; and `rejected`, (analysis_id, problem), whose documents have no rows in any family.

    The schema is fixed, never inferred; JSON is parsed once and staged by column, so that a job reads the families it uses.
    If `whole`, a document that lacks a family of its version is rejected, else that family is empty."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="unreadable")
    docs = stage(raw.withColumn("analysis_id", F.input_file_name()).withColumn("problems", problems(whole)), "documents")
    runs = docs.where("unreadable is null").select("analysis_id", "schemaVersion", F.coalesce("analysisRun.id", "runId").alias("runId"), "resultState", "analysisRun", *STATES)
    taken = docs.where(F.size("problems") == 0)
    tables = {name: taken.select("analysis_id", F.explode(name).alias("r")).select("analysis_id", "r.*") for name in FAMILIES}
    return {"runs": runs, **tables, "rejected": docs.select("analysis_id", F.explode("problems").alias("problem"))}


def within(col: Column, kind: T.DataType, name: str, scope: Column) -> Column:
    """A value with the scope in front of the ids in it, at any depth."""
    if isinstance(kind, T.StructType):
        parts = [within(col[f.name], f.dataType, f.name, scope).alias(f.name) for f in kind.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda c: within(c, kind.elementType, name, scope))
    return F.concat(scope, F.lit("/"), col) if name == "id" or name.endswith(("Id", "Ids")) else col


def qualify_ids(tables: dict[str, DataFrame], scope: str = "analysis_id") -> dict[str, DataFrame]:
    """The tables with the document in front of every id and of every reference (fields named id, ...Id, ...Ids, also those
    within structs and arrays): then the jobs take the records of many documents at once, though ids repeat."""
    out = {}
    for family, df in tables.items():
        cols = [F.col(f.name) if f.name == scope else within(F.col(f.name), f.dataType, f.name, F.col(scope)).alias(f.name) for f in df.schema.fields]
        out[family] = df.select(*cols) if scope in df.columns else df
    return out


def record_envelope(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, kind, payload) of all records."""
    parts = [tables[n].select("id", F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("payload")) for n, (kind, _, _) in FAMILIES.items() if n in tables]
    return reduce(DataFrame.unionByName, parts)


#: The first version that has each group of families.
SINCE = {"base": 1, "v2": 2, "interactions": 3, "job_queue_branches": 4, "authorization": 5, "resource_access": 6, "critical_sections": 7}


def capabilities(runs: DataFrame, version: str = "schemaVersion", key: str = "analysis_id") -> DataFrame:
    """(key, family, availability). A version that is not known has no family: availability unsupported_version."""
    number = F.element_at(F.split(version, r"\."), 1).cast("int")
    known = F.coalesce(F.col(version).isin(*VERSIONS), F.lit(False))
    family = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("since")) for f, n in SINCE.items()]))
    state = F.when(~F.col("known"), "unsupported_version").when(F.col("number") >= F.col("f.since"), "available").otherwise("unavailable")
    return runs.select(key, number.alias("number"), known.alias("known"), family.alias("f")).select(key, "f.family", state.alias("availability"))


#: Folders that hold no sources, and what a source's name ends in.
EXCLUDED = (".git", ".hg", ".svn", "build", "coverage", "dist", "node_modules", "out")
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts")


def classify_inventory(files: DataFrame, max_bytes: int = 1 << 20, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """files: (path, content). Keep or skip with the first reason that holds; hash and size of what is kept."""
    folders = F.slice(F.split(F.lower("path"), "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    size = F.octet_length("content").cast("long")
    reason = (
        F.when(F.arrays_overlap(folders, F.lit(list(excluded))), "excluded_directory")
        .when(~F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*EXTENSIONS), "unsupported_extension")
        .when(size > max_bytes, "oversized")
        .when(F.instr(F.col("content").cast("string"), "\0") > 0, "binary")
    )
    kept = reason.isNull()
    return files.select("path", kept.alias("kept"), reason.alias("reason"), F.when(kept, F.sha2("content", 256)).alias("content_hash"), F.when(kept, size).alias("byte_length"))


def merge_records(df: DataFrame, key: str, set_col: str, payload: list[str]) -> DataFrame:
    """Fragments of one record: equal ones are one, their sets are joined, unequal payloads are a conflict."""
    digest = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload])), 256)
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("fragments"), F.sort_array(F.collect_set(set_col)).alias(set_col), F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    return out.select(key, "fragments", set_col, F.when(F.col("lo") != F.col("hi"), "conflict").otherwise("merged").alias("state"))


def csv_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """The lines of a CSV file, lists joined by '; '."""
    kinds = dict(df.dtypes)
    text = lambda c: F.coalesce(F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit(""))
    return df.select(F.concat_ws(",", *[csv_cell(text(c)) for c in cols]).alias("line"))


def write_evidence_csv(df: DataFrame, path: str, cols: list[str]) -> None:
    """Text files whose lines end in CR LF. The header is a file of its own that sorts first (a part of one line)."""
    spark = df.sparkSession
    header = spark.createDataFrame([(",".join(cols),)], "line string").coalesce(1)
    header.unionByName(csv_rows(df, cols)).write.option("lineSep", "\r\n").text(path)


def canonical_order(df: DataFrame, keys: list[str], sets: list[str] | None = None) -> DataFrame:
    """Rows in the order of their keys over all partitions, set columns sorted and without repeats."""
    for c in sets or []:
        df = df.withColumn(c, F.sort_array(F.array_distinct(c)))
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def locations(col: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(col)), ";")
