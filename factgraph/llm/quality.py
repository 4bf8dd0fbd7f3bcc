"""A quality classifier by importance resampling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm.common import digest_rows, documents, stage, unstage

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Words and pairs of words are hashed into this many buckets, whatever the size of the corpus.
BUCKETS = 10_000
PRIOR = 16
#: The log weight is the mean over a text's n-grams; divided by this, it is that of a text of 100 of them.
TEMPERATURE = 0.01


def hashed_grams(text: str, buckets: int) -> np.ndarray:
    """The buckets of a text's tokens and pairs of neighbouring tokens, lower-cased. Pairs of equal tokens share one."""
    h = np.fromiter((crc32(t.encode()) for t in TOKEN.findall(text.lower())), np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs[h[:-1] == h[1:]] = 0
    return (np.concatenate([h, pairs >> np.uint64(17)]) % np.uint64(buckets)).astype(np.int64)


def labelled_sample(labels: DataFrame, limit: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, quality and fold of at most `limit` labelled rows, taken in hash order. Rows without id or quality go."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rows.select("doc_id", "quality", h.alias("h")).orderBy("h", "doc_id").limit(limit).collect()
    rows = sorted((r["doc_id"], r["quality"], r["h"] & 1) for r in rows)
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def gram_models(docs: DataFrame, good: np.ndarray, buckets: int) -> np.ndarray:
    """log of (target / raw) by bucket. The raw model counts all texts, and one more for each bucket; the target model
    those whose ids are in `good` (sorted), smoothed with the raw model as a prior that counts as many n-grams as there
    are buckets. One pass; a task sends one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for ids, texts in digest_rows(batches, ["id", "text"]):
            for i, text in zip(ids, texts, strict=True):
                found = np.bincount(hashed_grams(text or "", buckets), minlength=buckets)
                raw += found
                if i is not None and len(good) and (k := int(np.searchsorted(good, i))) < len(good) and good[k] == i:
                    target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "raw": pa.array(raw[at]), "target": pa.array(target[at])})

    pairs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    counts = pairs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    raw /= raw.sum()
    return np.log((target / raw + buckets) / (target.sum() + buckets))


def gumbel(seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def scored(docs: DataFrame, ratios: np.ndarray, seed: int, names: tuple[str, str, str], temperature: float = TEMPERATURE) -> DataFrame:
    """The rows with three columns more: number of n-grams, log weight, Gumbel key. The log weight is the mean of the
    n-grams' log ratios, with PRIOR further ones of 0, so that length alone decides nothing. Columns of these names are
    replaced."""
    grams, weight, key = names
    docs = docs.drop(*names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [hashed_grams(t or "", len(ratios)) for t in part.column(at).to_pylist()]
                part = part.append_column(grams, pa.array([len(f) for f in found], pa.int64()))
                yield part.append_column(weight, pa.array([round(float(ratios[f].sum()) / (len(f) + PRIOR), 9) for f in found], pa.float64()))

    schema = T.StructType([*docs.schema.fields, T.StructField(grams, T.LongType()), T.StructField(weight, T.DoubleType())])
    return docs.mapInArrow(score, schema).withColumn(key, F.col(weight) / temperature + gumbel(seed))


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 1024) -> float | None:
    """The exact k-th largest value: histograms of ever narrower ranges, `bins` rows at most come to the driver."""
    if k < 1:
        return None
    row = df.agg(F.min(col), F.max(col)).first()
    low, high, above = row[0], row[1], 0
    while low is not None and low < high:
        step = (high - low) / bins
        part = df.where(F.col(col).between(low, high)).groupBy(F.floor((F.col(col) - low) / (step or 1.0)).alias("bin"))
        rows = sorted(part.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect(), reverse=True)
        for r in rows:
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        else:
            return low
    return low


def calibrated_cut(weights: np.ndarray, quality: np.ndarray) -> float:
    """The lowest cut on the log weight with the best mean of the shares of good rows kept and bad rows rejected."""
    good, bad = np.sort(weights[quality == 1]), np.sort(weights[quality != 1])
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.concatenate([[-np.inf], np.unique(weights)])
    kept = 1 - np.searchsorted(good, cuts, "left") / len(good)
    rejected = np.searchsorted(bad, cuts, "left") / len(bad)
    best = np.flatnonzero(kept + rejected >= (kept + rejected).max() - 1e-12)[0]
    # Halfway to the bad row below: a little room for good rows that the sample lacks.
    below = bad[bad < cuts[best]]
    return float((cuts[best] + below[-1]) / 2) if len(below) else float(cuts[best])


def fit(docs: DataFrame, labels: DataFrame, max_labels: int, seed: int, buckets: int) -> tuple[np.ndarray, float]:
    """Log ratios by bucket and the cut. Half of the labelled sample makes the target model, the other half the cut."""
    ids, quality, fold = labelled_sample(labels, max_labels, seed)
    ratios = gram_models(docs, ids[(quality == 1) & (fold == 0)], buckets)
    held = dict(zip(ids[fold == 1].tolist(), quality[fold == 1].tolist(), strict=True))
    wanted = docs.sparkSession.createDataFrame([(i,) for i in held], "id long")  # at most max_labels numbers
    chosen = docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("id"), "left_semi")
    weights = scored(chosen.select("doc_id", "text"), ratios, seed, ("n", "w", "k"))
    # One weight for each label: the mean where several rows share an id, in decimals, whose sum has no order.
    rows = weights.groupBy("doc_id").agg(F.avg(F.col("w").cast("decimal(20,9)")).cast("double").alias("w")).collect() if held else []
    pairs = [(r["w"], held[r["doc_id"]]) for r in rows]
    return ratios, calibrated_cut(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))


def resample(
    docs: DataFrame, labels: DataFrame, target_size: int | None = None, temperature: float = TEMPERATURE, max_labels: int = 50_000, seed: int = 1,
    buckets: int = BUCKETS, names: tuple[str, str, str] = ("n_grams", "log_weight", "gumbel_key"),
) -> tuple[DataFrame, float | None]:
    """The rows of docs with `names` added, and the least Gumbel key of a row that is kept (None: none is).

    A hashed n-gram model of texts labelled good is set against one of all texts. A row's log weight is the mean log
    ratio of its likelihoods. `target_size` rows are drawn without replacement in proportion to exp(log weight /
    temperature) by Gumbel top-k: those whose tempered log weight plus Gumbel noise is largest. By default as many are
    drawn as have a log weight at or above the cut that held-out labels set. The fit sees at most `max_labels` labelled
    rows; the raw model, the weights and the number drawn cover every row.

    Null and empty texts have weight 0 in logarithm, no n-grams. Rows that tie with the k-th are all kept, repeated
    rows share one fate. Without good or without bad labels every row is kept. An empty table gives an empty result.
    """
    ratios, cut = fit(docs, labels, max_labels, seed, buckets)
    rows = scored(docs, ratios, seed, names, temperature)
    keys = stage(rows.select(*names[1:]), "quality-keys")
    k = keys.where(F.col(names[1]) >= F.lit(cut)).count() if target_size is None else min(target_size, keys.count())
    least = kth_largest(keys, names[2], k)
    unstage(keys)
    return rows, least


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ratios, cut = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 50_000, 1, BUCKETS)
    rows = stage(scored(docs, ratios, 1, ("n_grams", "log_weight", "gumbel_key")).drop("text"), "quality-scores")
    least = kth_largest(rows, "gumbel_key", rows.where(F.col("log_weight") >= F.lit(cut)).count())
    return rows.withColumn("kept", F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False)))
