"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm.common import WORD, documents, stage, with_row_number

#: A document's place in its source's sampling order is a hash; places are first summed in this many bins,
#: so that no task sees a whole source.
BINS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_level(sources: DataFrame, budget: float, max_epochs: float) -> float:
    """The water level: a source gets weight * level words, or max_epochs times its size if that is less.

    Starts from proportional shares, clamps the sources above their caps, hands their excess to the rest by
    weight, and repeats until no further source is above. Each round is one distributed aggregate; only two
    sums come to the driver.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    level, clamped = -1.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(full.cast("int")).alias("clamped"),
        ).first()
        if row["clamped"] is None or row["clamped"] == clamped or not row["weight"]:
            return level if row["clamped"] is None or row["weight"] else float("inf")
        clamped, level = row["clamped"], (budget - row["used"]) / row["weight"]


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget_ratio: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes.

    Sources in code point order (null is a source of its own, last) take the weights in turn, repeating. The
    budget is `budget_ratio` times all words. A source's target over its size gives whole repetitions of every
    document; the rest is filled in seeded hash order, the last document in part, so each source meets its
    target to the word. Returns doc_id, size, source_size, target, taken, whole (repetitions) and tail (words
    of one further, possibly partial repetition).

    A null or empty text has size 0 and takes nothing; a source without words has target 0; repeated rows are
    separate rows; an empty table gives an empty result; other columns are ignored.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 52))
    sizes = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), u.alias("place")
        ),
        "mix-sizes",
    )
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked, n = with_row_number(per_source, [F.col("source").asc_nulls_last()], "mix-sources", "rank")
    turn = F.element_at(F.lit(list(map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stage(ranked.withColumn("weight", turn), "mix-weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = fill_level(sources, total * budget_ratio, max_epochs) if n else 0.0
    cap = F.col("source_size") * F.lit(max_epochs)
    plans = sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    plans = plans.withColumn("whole", epochs).withColumn(
        "rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size")
    )
    binned = sizes.withColumn("bin", F.shiftright("place", 52 - BINS.bit_length() + 1).cast("int"))
    bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size")
    starts = bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), before.alias("start"))
    plans = plans.withColumnRenamed("source", "of")
    starts = starts.join(plans, F.col("s").eqNullSafe(F.col("of"))).select("s", "b", "start", "source_size", "target", "whole", "rest")
    in_bin = Window.partitionBy("source", "bin").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumn("ahead", F.coalesce(F.sum("size").over(in_bin), F.lit(0)))
    tail = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("ahead")))
    return (
        placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
        .withColumn("tail", tail)
        .select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("tail")).alias("taken"), "whole", "tail")
    )


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
