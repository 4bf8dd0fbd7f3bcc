"""A Katz back-off language model of word pairs, and its score of every document.

Words and pairs are counted in buckets by their hashes, pairs by their first word; a first word with more than its share is
split by the second. What chunks ask about their distinct words and pairs comes back as numbers and counts, packed; only
pairs never seen in training need their first word's back-off weight, by a join.

Counts up to K are discounted by Good and Turing's estimate as Katz has it; larger ones stand but for a reserve of 1/100
occurrence, so that every first word keeps some mass (Katz's own would leave none where all counts are large, and unseen
pairs without probability). Back-off weights share exactly that mass over the words not seen after it:
    P(w | h) = c*(h, w) / c(h)                                    if training has (h, w)
             = (1 - sum of c*(h, .) / c(h)) / (1 - sum of P(w) over those seen) * P(w)   otherwise
    P(w)     = c*(w) / N, and 1 - sum of c*(w) / N for the one word that stands for all unknown ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.chunks import COUNTS, buckets, by_chunk, merged_words, mixed, pack, pack_sorted, sent, stage_chunks, unpack, unpack_sorted, word_chunks, word_requests, word_table
from factgraph.llm.common import documents, stage, width

#: Counts above this are taken as they are, but for the reserve.
K, RESERVE = 5, 0.01
#: What is taken off every count where Good and Turing's estimate has no use (counts of counts that are 0 or not falling).
ABSOLUTE = 0.5
UNKNOWN = -1


def discounted(of_count: dict[int, int]) -> np.ndarray:
    """What counts 1 to K are worth, at 1 to K, and at 0 what is taken off larger ones. of_count: how many have a count.
    As many counts are discounted as the estimate gives values for that fall short of the count and are positive."""
    for k in range(K, 0, -1):
        n = [of_count.get(r, 0) for r in range(k + 2)]
        if all(n[1:]) and (k + 1) * n[k + 1] < n[1]:
            common = (k + 1) * n[k + 1] / n[1]
            worth = [r * ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
            if all(0 < x < r for r, x in enumerate(worth, 1)):
                return np.array([RESERVE, *worth, *(r - RESERVE for r in range(k + 1, K + 1))])
    return np.array([ABSOLUTE, *(r - ABSOLUTE for r in range(1, K + 1))])


def worth(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(counts > K, counts - table[0], np.where(counts > 0, table[np.clip(counts, 0, K)], 0.0))


@dataclass
class Words:
    """What holds for all words: how many training documents' words there are (`total`) and how many different ones, what
    small counts are worth, and in how many buckets pairs are counted."""

    total: int
    distinct: int
    table: np.ndarray
    left: float
    n_buckets: int

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of words that training has so often; unknown ones share what the discounts leave. Without training all words
        are that one."""
        return np.where(counts > 0, worth(counts, self.table) / max(1, self.total), self.left)

    def bucket(self, first: np.ndarray, second: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Pairs go by their first word; those of a word (it occurs `count` times) with more than an eighth of a bucket's
        share by both, in as many parts as it has eighths."""
        parts = (count // max(1, self.total // (8 * self.n_buckets)) + 1).astype(np.uint64)
        return (mixed(mixed(first) + mixed(second) % parts) % np.uint64(self.n_buckets)).astype(np.int64)


def counted_words(answers: DataFrame, n_buckets: int) -> Words:
    """From the counts of counts of all buckets; a few numbers come to the driver."""
    told = {r["id"]: r["n"] for r in answers.where("chunk is null").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    total, distinct, few = told.get(-1, 0), told.get(0, 0), {r: told.get(r, 0) for r in range(1, COUNTS + 1)}
    table = discounted(few)
    small = range(1, K + 1)
    large = total - sum(r * few[r] for r in small) - table[0] * (distinct - sum(few[r] for r in small))
    return Words(total, distinct, table, 1 - float(large + sum(few[r] * table[r] for r in small)) / total if total else 1.0, n_buckets)


#: Stands for what is before a document's first word. Words have numbers from 1 on.
START, UNKNOWN = 0, -1
CODED = pa.schema([("chunk", pa.int64()), ("found", pa.binary()), ("times", pa.binary())])


def coded(chunks: DataFrame, answers: DataFrame, n_buckets: int) -> DataFrame:
    """(chunk, found, times): the numbers and counts of each chunk's distinct words."""

    def work(row: dict, found: pa.Table) -> list[pa.RecordBatch]:
        bucket = unpack(row["hashes"].as_py()) % n_buckets
        ids, times = np.full(len(bucket), UNKNOWN), np.zeros(len(bucket), np.int64)
        told = dict(zip(found["bucket"].to_pylist(), zip(found["found"].to_pylist(), found["times"].to_pylist(), strict=True), strict=True))
        for b, x in sent(0, bucket, {"at": np.arange(len(bucket))}):
            got, n = map(unpack, told[b])
            ids[x["at"]], times[x["at"]] = np.where(got < 0, UNKNOWN, got + 1), n
        return [pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row["chunk"].as_py(), pack(ids), pack(times)), CODED, strict=True)], schema=CODED)]

    return by_chunk(chunks.select("chunk", "hashes"), answers.where("chunk is not null").select("chunk", "bucket", "found", "times"), work, CODED, "chunk long, found binary, times binary")


@dataclass
class Pairs:
    """A chunk's words by place: whether each and what stands before it is known, with their counts; and its distinct pairs of
    known words, with their counts and buckets."""

    sizes: np.ndarray
    before: np.ndarray
    after_count: np.ndarray
    before_count: np.ndarray
    asked: np.ndarray
    which: np.ndarray
    first: np.ndarray
    second: np.ndarray
    second_count: np.ndarray
    bucket: np.ndarray

    @classmethod
    def of(cls, row: dict, words: Words) -> Pairs:
        numbers, ids, times = (unpack(row[c].as_py()) for c in ("numbers", "found", "times"))
        end, starts = row["end"].as_py(), len(ids)  # a place in the dictionary of its own
        sizes = np.diff(np.flatnonzero(numbers == end), prepend=-1)
        ids, times = np.append(ids, START), np.append(times, times[end])
        prior = np.concatenate([[starts], numbers[:-1]])
        prior[np.cumsum(sizes)[:-1]] = starts
        asked = np.flatnonzero((times[prior] > 0) & (ids[numbers] >= 0))
        keys, which = np.unique(prior[asked] * starts + numbers[asked], return_inverse=True)
        first, second = keys // max(1, starts), keys % max(1, starts)
        order = np.lexsort((ids[second], ids[first]))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        first, second = first[order], second[order]
        return cls(sizes, ids[prior], times[numbers], times[prior], asked, place[which], ids[first], ids[second], times[second], words.bucket(ids[first], ids[second], times[first]))


def requests(chunks: DataFrame, words: Words) -> DataFrame:
    """(bucket, chunk, first, second, count, n): each chunk's distinct pairs with the second word's count and how often its
    training documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(f)[i] for f in batch.schema.names}
                pairs = Pairs.of(row, words)
                trained = np.repeat(np.array(row["kept"].as_py(), bool), pairs.sizes)[pairs.asked]
                n = np.bincount(pairs.which, trained, len(pairs.first)).astype(np.int64)
                for b, x in sent(0, pairs.bucket, {"first": pairs.first, "second": pairs.second, "count": pairs.second_count, "n": n}):
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int64()), "chunk": pa.array([row["chunk"].as_py()], pa.int64()), "first": [pack_sorted(x["first"])], **{c: [pack(x[c])] for c in ("second", "count", "n")}})

    return chunks.mapInArrow(run, "bucket long, chunk long, first binary, second binary, count binary, n binary")


TABLE = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("count", pa.binary()), ("n", pa.binary())])


def merged(rows: DataFrame) -> DataFrame:
    """The table of pairs by bucket (first, second, count, n: those that training has, chunk null), and the counts for each
    chunk in the order in which it asked."""

    def run(table: pa.Table) -> pa.Table:
        first, second, count, n = ([unpacked(x) for x in table[c].to_pylist()] for c, unpacked in (("first", unpack_sorted), ("second", unpack), ("count", unpack), ("n", unpack)))
        bucket = table["bucket"][0].as_py()
        bs, b = np.unique(np.concatenate(first), return_inverse=True)
        ws, at, w = np.unique(np.concatenate(second), return_index=True, return_inverse=True)
        known = np.concatenate(count)[at]
        keys, which = np.unique(b * max(1, len(ws)) + w, return_inverse=True)
        total = np.bincount(which, np.concatenate(n), len(keys)).astype(np.int64)
        answers = [pack(x) for x in np.split(total[which], np.cumsum([len(x) for x in first])[:-1])]
        keys, total = keys[total > 0], total[total > 0]
        held = [[bucket], [None], [pack_sorted(bs[keys // max(1, len(ws))])], [pack(ws[keys % max(1, len(ws))])], [pack(known[keys % max(1, len(ws))])], [pack(total)]]
        none = [None] * len(answers)
        replies = [[bucket] * len(answers), table["chunk"].to_pylist(), none, none, none, answers]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(part, TABLE, strict=True)], schema=TABLE) for part in (held, replies)], TABLE)

    return rows.groupBy("bucket").applyInArrow(run, "bucket long, chunk long, first binary, second binary, count binary, n binary")


def counts_of_counts(pairs: DataFrame) -> dict[int, int]:
    """How many pairs occur once, twice, and up to K + 1 times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n = unpack(x)
                yield pa.RecordBatch.from_pydict({"r": pa.array(np.arange(1, K + 2)), "k": pa.array(np.bincount(n[n <= K + 1], minlength=K + 2)[1:].astype(np.int64))})

    return {r["r"]: r["k"] for r in pairs.select("n").mapInArrow(run, "r long, k long").groupBy("r").agg(F.sum("k").alias("k")).collect()}


def contexts(pairs: DataFrame, words: Words, table: np.ndarray) -> DataFrame:
    """(id, weight): the back-off weight of every first word. A bucket sums up what it has of one; those that are split meet
    in one aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, n, count = unpack_sorted(row["first"]), unpack(row["n"]), unpack(row["count"])
                ids, which = np.unique(first, return_inverse=True)
                sums = [np.bincount(which, x, len(ids)) for x in (worth(n, table), n, words.probability(count))]
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "seen": pa.array(sums[0]), "total": pa.array(sums[1]), "below": pa.array(sums[2])})

    sums = pairs.select("first", "count", "n").mapInArrow(run, "id long, seen double, total double, below double").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("seen", "total", "below")])
    return sums.select("id", ((1 - F.col("seen") / F.col("total")) / (1 - F.col("below"))).alias("weight"))


SCORED = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("context", pa.int64()), ("times", pa.int64())])
SCORED_SQL = "doc long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, context long, times long"


def scored(chunks: DataFrame, replies: DataFrame, words: Words, table: np.ndarray) -> DataFrame:
    """Two kinds of rows: of each document what is known without back-off weights, and how often (times) it backs off from
    which first word (context)."""

    def work(row: dict, found: pa.Table) -> Iterator[pa.RecordBatch]:
        pairs, chunk = Pairs.of(row, words), row["chunk"].as_py()
        counts, answers = np.zeros(len(pairs.first), np.int64), dict(zip(found["bucket"].to_pylist(), found["n"].to_pylist(), strict=True))
        for b, x in sent(0, pairs.bucket, {"at": np.arange(len(pairs.first))}):
            counts[x["at"]] = unpack(answers[b])
        n = np.zeros(len(pairs.before), np.int64)
        n[pairs.asked] = counts[pairs.which]
        of = np.repeat(np.arange(len(pairs.sizes)), pairs.sizes)
        total = lambda x: np.bincount(of, x, len(pairs.sizes))
        score = total(np.log10(np.where(n > 0, worth(n, table) / np.maximum(pairs.before_count, 1), words.probability(pairs.after_count))))
        base = total(np.log10((pairs.after_count + 1) / (words.total + 1 * (words.distinct + 1))))
        doc = (chunk << 32) + np.arange(len(pairs.sizes))
        none, kept = pa.nulls(len(doc), pa.int64()), np.array(row["kept"].as_py(), bool)
        known = total(pairs.after_count > 0).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row["ids"].as_py(), pa.int64()), pa.array(~kept), pa.array(pairs.sizes), pa.array(known), pa.array(base), pa.array(score), none, none], schema=SCORED)
        back = np.flatnonzero((n == 0) & (pairs.before_count > 0))
        ids, local = np.unique(pairs.before[back], return_inverse=True)
        key, times = np.unique(of[back] * max(1, len(ids)) + local, return_counts=True)
        empty = [pa.nulls(len(key), f.type) for f in SCORED]
        yield pa.RecordBatch.from_arrays([pa.array(doc[key // max(1, len(ids))]), *empty[1:7], pa.array(ids[key % max(1, len(ids))]), pa.array(times.astype(np.int64))], schema=SCORED)

    return by_chunk(chunks, replies.select("chunk", "bucket", "n"), work, SCORED, SCORED_SQL)


def katz_scores(docs: DataFrame, trained: str = "crc32(cast(doc_id as string)) % 7 <> 2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the documents for which the SQL condition `trained` over doc_id holds, and scores all: (doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score).

    Tokens are words in lower case (A-Z only) and one end for each document. base_score is that of single words, each count
    one more; score is the model's log10 probability of the document, end included. A null or empty text is an end alone. A
    document for which the condition is null (a null id) is trained on; repeated rows count and are scored each on its own; without training
    documents every token has probability 1 in the model; an empty table gives an empty result; other columns are ignored.
    Texts of any length are scored whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.lit("").alias("lang"), F.coalesce(F.expr(trained), F.lit(True)).alias("kept"))
    chunks = stage_chunks(word_chunks(rows, word_table("", "\t\n\x0b\x0c\r ")), "lm-chunks")
    n_buckets = buckets(chunks.agg(F.sum("n")).first()[0] or 0, width(docs.sparkSession))
    answers = stage(merged_words(word_requests(chunks, n_buckets), n_buckets, 1, listed=False), "lm-words")
    words = counted_words(answers, n_buckets)
    texts = chunks.select("chunk", "end", "numbers", "ids", "kept").join(stage_chunks(coded(chunks, answers, n_buckets), "lm-dictionaries"), "chunk")
    table_and_replies = stage(merged(requests(texts, words)), "lm-pairs")
    pairs = table_and_replies.where("chunk is null")
    table = discounted(counts_of_counts(pairs))
    found = stage(scored(texts, table_and_replies.where("chunk is not null"), words, table), "lm-scores")
    weights = contexts(pairs, words, table)
    back = found.where("context is not null").select("doc", "context", "times").join(weights, F.col("context") == F.col("id"))
    back = back.groupBy("doc").agg(F.sum(F.col("times") * F.log10("weight")).alias("backed"))
    whole = found.where("context is null").join(back, "doc", "left")
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("backed", F.lit(0.0))).alias("score"))


def op12_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))
