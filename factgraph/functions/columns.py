"""Column functions: keys, hashes, routes, targets, redaction, safe text, document states."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a secret, and the marks that stand for it.
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
URL_CREDENTIALS = r"(?i)(\b[a-z][a-z0-9+.-]*://[^\s/:@]+:)[^\s@/]+(@)"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+"
SECRET_NAME = r"(?i)(\b(?:api[_-]?key|secret|password|passwd|token|authorization)\b\s*"
MAX_TARGET, MAX_QUERY_KEYS = 2048, 50


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _cut(values: pd.Series, limits: pd.Series) -> pd.Series:
    whole = lambda v, n: v if v is None else v.encode()[:n].decode(errors="ignore")
    return pd.Series([whole(v, n) for v, n in zip(values, limits, strict=True)])


def nfc(col: Column) -> Column:
    """Unicode normal form C; plain ASCII values never reach Python."""
    return F.coalesce(_nfc(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def stable_id(kind: str, *cols: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.to_json(F.array(*map(nfc, cols))), 256), 1, 32))


def semantic_key(kind: str, *cols: Column) -> Column:
    return F.to_json(F.array(F.lit(kind), *map(nfc, cols)))


def normalize_signature(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def fingerprint(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One digest for each group, whatever the order of its rows: row hashes are summed by the halves of a SHA-256, so no
    group is collected. Returns keys, rows, digest."""
    row = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])), 256)
    part = lambda k: F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(part(k)).cast("decimal(38,0)").alias(f"__{k}") for k in range(3)]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    return out.select(*keys, "n_rows", F.sha2(F.concat_ws(",", *[F.col(f"__{k}").cast("string") for k in range(3)]), 256).alias("digest"))


def normalize_route(col: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(nfc(col), "/"), lambda s: s != ""), "/"))


def route_to_template(col: Column, prefix: str = "/") -> Column:
    """/users/:id to /users/{id}, behind a prefix."""
    return normalize_route(F.concat(F.lit(prefix), F.lit("/"), F.regexp_replace(col, r":([A-Za-z_][A-Za-z0-9_]*)", r"{$1}")))


def clean_target(url: Column) -> Column:
    """struct(resolution, value, query_keys, issue): a URL without fragment, query values and user-info. One that is
    too long, or has no path left, is dynamic."""
    plain = F.substring_index(url, "#", 1)
    cut = F.instr(plain, "?")
    path = nfc(F.when(cut == 0, plain).otherwise(F.substring(plain, F.lit(1), cut - 1)))
    path = F.regexp_replace(path, r"^((?:[^/]*?:)?//)[^/]*@", "$1")
    query = F.when(cut == 0, "").otherwise(F.substring(plain, cut + 1, F.length(plain)))
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    keys = F.array_sort(F.array_distinct(F.slice(F.filter(keys, lambda k: (k != "") & ~k.rlike(r"[{}]")), 1, MAX_QUERY_KEYS)))
    long = F.char_length(url) > MAX_TARGET
    dynamic = long | (path == "")
    return F.struct(
        F.when(dynamic, "dynamic").otherwise("exact").alias("resolution"),
        F.when(~dynamic, path).alias("value"),
        F.when(long, F.array().cast("array<string>")).otherwise(keys).alias("query_keys"),
        F.when(long, "limit").when(path == "", "dynamic").alias("issue"),
    )


def redact_secrets(col: Column) -> Column:
    """Key blocks, then URL credentials, bearer tokens, comparisons and assignments."""
    col = F.regexp_replace(col, KEY_BLOCK, "[REDACTED PRIVATE KEY]")
    col = F.regexp_replace(col, URL_CREDENTIALS, "$1[REDACTED]$2")
    col = F.regexp_replace(col, BEARER, "Bearer [REDACTED]")
    for operator in (r"(?:===?|!==?)", r"[:=]"):
        col = F.regexp_replace(col, SECRET_NAME + operator + r"\s*)([\"'`])[^\r\n]*?\2", "$1$2[REDACTED]$2")
    return col


def bounded_snippet(col: Column, n: int = 240) -> Column:
    text = redact_secrets(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def cut_bytes(col: Column, limit: int) -> Column:
    """The longest prefix of whole characters within a number of bytes; only longer values reach Python."""
    long = F.octet_length(col) > limit
    return F.when(long, _cut(F.when(long, col), F.lit(limit))).otherwise(col)


def sanitize_text(col: Column, max_bytes: int) -> Column:
    """No bidirectional controls, control characters as spaces, white space folded, cut to whole characters."""
    col = F.regexp_replace(col, r"[‪-‮⁦-⁩]", "")
    col = F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    col = F.regexp_replace(F.regexp_replace(col, r"[\r\n\t]+", " "), r"\s{2,}", " ")
    return cut_bytes(F.regexp_replace(col, r"^\s+|\s+$", ""), max_bytes)


def escape_markdown(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return F.regexp_replace(col, r"([\\`*_{}\[\]()#+\-.!|~])", r"\\$1")


def csv_cell(col: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where it must be."""
    safe = F.when(col.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike(r'[",\r\n]'), quoted).otherwise(safe)


def target_key(**parts: Column) -> Column:
    """A target as JSON with its parts by name; absent parts stay null."""
    return F.to_json(F.struct(*[parts[name].alias(name) for name in sorted(parts)]), {"ignoreNullFields": "false"})


def target_label(kind: Column, **target: Column) -> Column:
    """A target as people read it: a queue's job, a message of a mode, client and transport, an outbound request, or an
    event. Parts that are not known are named so. kind: job_queue, microservice_message, outbound_http or another."""
    part = lambda name, default: F.coalesce(target.get(name, F.lit(None).cast("string")), F.lit(default))
    queued = F.concat(part("technology", "bullmq"), F.lit(" queue "), part("queue", "dynamic queue"), F.lit("; job "), part("job", "any/dynamic job"))
    mode = F.when(part("mode", "request_response") == "request_response", "request-response").otherwise("event")
    message = F.concat(mode, F.lit(" "), part("queue", "dynamic pattern"), F.lit("; client "), part("client", "dynamic client"), F.lit("; transport "), part("transport", "unknown transport"))
    keys = target.get("query_keys", F.array().cast("array<string>"))
    asked = F.concat(part("http_method", "GET"), F.lit(" "), part("url", "dynamic target"), F.when(F.size(keys) > 0, F.concat(F.lit("; query keys: "), F.array_join(keys, ", "))).otherwise(""))
    name = part("queue", "dynamic event")
    wild = F.when(target["delimiter"].isNull(), name).otherwise(F.concat(name, F.lit(" [wildcard; delimiter "), target["delimiter"], F.lit("]"))) if "delimiter" in target else name
    return F.when(kind == "job_queue", queued).when(kind == "microservice_message", message).when(kind == "outbound_http", asked).otherwise(wild)


def resource_label(technology: Column, operation: Column, kind: Column, value: Column, segments: Column) -> Column:
    """segments: array of struct(kind, value) of a template: literal, symbolic or placeholder (value is its number)."""
    text = F.array_join(F.transform(segments, lambda s: F.when(s["kind"] == "literal", s["value"]).otherwise(F.concat(F.lit("${"), s["value"], F.lit("}")))), "")
    target = F.when(kind == "exact", value).when(kind == "symbolic", F.concat(F.lit("$"), value)).when(kind == "dynamic", "<dynamic>").otherwise(text)
    return F.concat_ws(" ", technology, operation, target)


def result_state(diagnostics: Column, errors: Column, facts: Column) -> Column:
    """Of a document by its counts: nothing but errors is failed, any gap is completed_with_gaps."""
    return F.when((facts == 0) & (errors > 0), "failed").when(diagnostics == 0, "completed").otherwise("completed_with_gaps")


def combine_states(state: Column) -> Column:
    """An aggregate: the worst of a group's states; not_declared without any."""
    rank = F.max(F.when(state == "failed", 3).when(state == "canceled", 2).when(state == "completed_with_gaps", 1).when(state == "completed", 0))
    return F.when(rank == 3, "failed").when(rank == 2, "canceled").when(rank == 1, "completed_with_gaps").when(rank == 0, "completed").otherwise("not_declared")
