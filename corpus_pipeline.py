"""A training corpus from documents: quality, near-duplicates, personal data, source mix, tokens.

Each stage works on all rows that the one before it kept and returns the columns of documents; the last returns tokens.
Null, empty and repeated rows, empty tables and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import minhash, mixing, pii, quality, tokens
from factgraph.llm.common import WORD, documents, stage, with_unique_id


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the texts labelled good: rejected documents go. Null and empty texts have weight 0 and
    share the fate of that weight; repeated rows share theirs; an empty table stays empty; no labels reject nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, least = quality.resample(docs, labels, names=("__grams", "__weight", "__key"))
    return rows.where(F.col("__key") >= F.lit(least).cast("double")).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates on shingles of five words at a similarity of 0.8: the row of least id of each group stays. Rows
    without words are like no other and stay; of repeated rows one stays; rows that share an id, or have none, are told
    apart by text; an empty table stays empty."""
    rows = with_unique_id(docs)
    kept = minhash.near_duplicates(rows, k=5, percent=80, id_col="__uid").where("kept").select(F.col("doc_id").alias("__uid"))
    return rows.join(kept, "__uid", "left_semi").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emails, addresses, card, phone and account numbers and logins become <KIND>. n_chars stays the source's figure. Null
    and empty texts stay as they are, repeated rows stay alike, an empty table stays empty."""
    return pii.redact_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Where it takes a part, the first words make a row of their own, with the
    white space between them. Rows without words are taken in no mix and go; repeated rows are rows of their own; a null
    source is a source; an empty table stays empty."""
    rows = with_unique_id(docs)
    taken = mixing.mix_sources(rows, id_col="__uid").select(F.col("doc_id").alias("__uid"), F.col("whole").alias("__whole"), F.col("tail").alias("__tail"), F.col("size").alias("__size"))
    copies = F.col("__whole") + (F.col("__tail") > 0).cast("long")
    rows = rows.join(taken.where("__whole + __tail > 0"), "__uid").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    words = F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("__tail").cast("int"))
    part = (F.col("__copy") > F.col("__whole")) & (F.col("__tail") < F.col("__size"))
    return rows.withColumn("text", F.when(part, F.array_join(words, "")).otherwise(F.col("text"))).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (SentencePiece, space-joined) and round_trip: whether decoding gives the text again. Null and
    empty texts have no ids, repeated rows give repeated results, an empty table an empty one."""
    return tokens.token_rows(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", keep_one_of_each),
    ("pii", redact_personal_data),
    ("source mix", mix),
    ("sentencepiece", tokenize),
]

#: Sampling, connected components and tokenization are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs
