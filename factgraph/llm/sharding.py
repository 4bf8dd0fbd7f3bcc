"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import documents, with_row_number

#: The round function works modulo this prime, so that products fit in 63 bits.
PRIME = 2147483647
ROUNDS = 6


@dataclass(frozen=True)
class Feistel:
    """A seeded permutation of 0 .. n-1: a Feistel network over left x right >= n, cycle-walked back into range.

    left * right exceeds n by less than left = ceil(sqrt(n)), so few values leave the range; `walks`, found from
    those few alone, is the longest walk, and so a bound for every row.
    """

    n: int
    seed: int

    @property
    def sides(self) -> tuple[int, int]:
        left = max(1, math.isqrt(max(self.n - 1, 0)) + 1)
        return left, max(1, -(-self.n // left))

    @property
    def keys(self) -> list[tuple[int, int, int, int]]:
        rng = random.Random(f"feistel-{self.seed}")
        return [tuple(rng.randrange(1, PRIME) for _ in range(4)) for _ in range(ROUNDS)]

    def once(self, value: int) -> int:
        left, right = self.sides
        x, y = divmod(value, right)
        for k, (a, b, c, d) in enumerate(self.keys):
            h = ((y if k % 2 == 0 else x) * a + b) % PRIME
            h = (h * h + c) % PRIME
            h = (h * d + b) % PRIME
            x, y = ((x + h) % left, y) if k % 2 == 0 else (x, (y + h) % right)
        return x * right + y

    @property
    def walks(self) -> int:
        """Steps that the longest walk needs after the first one."""
        left, right = self.sides
        longest = 0
        for value in range(self.n, left * right):
            steps = 0
            while value >= self.n and steps <= left:
                value, steps = self.once(value), steps + 1
            longest = max(longest, steps)
        return longest

    def column(self, row: Column) -> Column:
        left, right = self.sides
        keys = F.array(*[F.array(*[F.lit(x).cast("long") for x in k]) for k in self.keys])

        def step(state: Column, k: Column) -> Column:
            even, key = k % 2 == 0, lambda i: F.get(F.get(keys, k), F.lit(i))
            h = (F.when(even, state["y"]).otherwise(state["x"]) * key(0) + key(1)) % PRIME
            h = (((h * h + key(2)) % PRIME) * key(3) + key(1)) % PRIME
            return F.struct(
                F.when(even, (state["x"] + h) % left).otherwise(state["x"]).alias("x"),
                F.when(even, state["y"]).otherwise((state["y"] + h) % right).alias("y"),
            )

        def once(value: Column) -> Column:
            start = F.struct(F.floor(value / right).cast("long").alias("x"), (value % right).cast("long").alias("y"))
            return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["x"] * right + s["y"])

        first = once(row)
        if not (walks := self.walks):
            return first
        again = lambda v, _: F.when(v >= self.n, once(v)).otherwise(v)
        return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, again)


def feistel_shards(
    docs: DataFrame, shards: int = 8, seed: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard and slot of every row under a reproducible shuffle.

    Rows are numbered in the order of id, size and checksum; the permuted number p gives shard p mod `shards`
    and slot p div `shards`, so shard sizes differ by one row at most, slots have no gaps, and both can be
    computed from the row number alone. Returns doc_id, size (UTF-8 bytes + 1), text_crc32, row_number, shard, slot.

    A null text counts as empty here (size 1, checksum 0); null ids come first; repeated rows each get a slot;
    an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    numbered, n = with_row_number(rows, [F.col(c) for c in ("doc_id", "size", "text_crc32")], "shard-rows")
    place = numbered.withColumn("__p", Feistel(n, seed).column(F.col("row_number")))
    return place.select(
        "doc_id", "size", "text_crc32", "row_number", (F.col("__p") % shards).cast("int").alias("shard"),
        F.floor(F.col("__p") / shards).cast("long").alias("slot"),
    )


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feistel_shards(documents(spark, sf_dir))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
