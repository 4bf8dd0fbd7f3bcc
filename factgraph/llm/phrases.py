"""Phrase collocations by stripes.

A prefix keys a counter of the words that follow it: its stripe. Chunks send the stripes of what they hold, stripes of one
prefix are merged element by element, and what stays frequent are the prefix's extensions, each a prefix of the next round.
From this one structure come the phrases (extensions), the counts of their parts (prefix totals) and the largest count of
a longer phrase that holds a phrase (subsumption maxima). A phrase is as frequent as asked only if its first words and its
last words are, so a round looks only where two frequent phrases of the round before overlap: nothing frequent is lost.

A stripe is split by next word over all buckets, so that the stripe of a very frequent prefix is no task's alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm.chunks import END, buckets, by_chunk, merged_words, mixed, pack, pack_sorted, sent, stage_chunks, unpack, unpack_sorted, word_chunks, word_requests, word_table
from factgraph.llm.common import documents, stage, unstage, width

#: Parts that a language's best phrases are first sought in.
PARTS = 64
STATE = pa.schema([("chunk", pa.int64()), ("grams", pa.binary()), ("last", pa.binary())])
STATE_SQL = "chunk long, grams binary, last binary"


def state_row(chunk: int, grams: np.ndarray, last: np.ndarray | None = None) -> pa.RecordBatch:
    """The frequent phrases of a chunk by place (-1: none) with their last words, if they are not the phrases themselves; of
    places without one, one is kept in a row."""
    kept = (grams >= 0) | np.concatenate([[False], grams[:-1] >= 0])
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack(grams[kept])], pa.binary()), pa.array([None if last is None else pack(last[kept])], pa.binary())], schema=STATE)


def state_of(grams: bytes, last: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    held = unpack(grams)
    return held, held if last is None else unpack(last)


def distinct(prefix: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (prefix, next word) in order, and which of them each pair is."""
    ps, p = np.unique(prefix, return_inverse=True)
    ws, w = np.unique(after, return_inverse=True)
    keys, which = np.unique(p * max(1, len(ws)) + w, return_inverse=True)
    return ps[keys // max(1, len(ws))], ws[keys % max(1, len(ws))], which


def stripes(grams: np.ndarray, last: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stripes of a chunk: places where a frequent phrase is followed by one that overlaps it, the distinct
    (prefix, next word), which of them each place has, and their buckets."""
    places = np.flatnonzero((grams[:-1] >= 0) & (grams[1:] >= 0))
    prefix, after, which = distinct(grams[places], last[places + 1])
    return places, prefix, after, which, (mixed(mixed(prefix) ^ after.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)


def requests(state: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, chunk, prefix, after, n): the stripes of every chunk, packed, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, (grams, last) = batch.column(0)[i].as_py(), state_of(*(batch.column(c)[i].as_py() for c in (1, 2)))
                _, prefix, after, which, bucket = stripes(grams, last, n_buckets)
                dealt = sent(key, bucket, {"prefix": prefix, "after": after, "n": np.bincount(which, minlength=len(prefix))})
                yield from (pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int64()), "chunk": [key], "prefix": [pack_sorted(x["prefix"])], "after": [pack(x["after"])], "n": [pack(x["n"])]}) for b, x in dealt)

    return state.mapInArrow(run, "bucket long, chunk long, prefix binary, after binary, n binary")


MERGED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("found", pa.binary()), ("prefix", pa.int64()), ("after", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])


def merged(rows: DataFrame, n_buckets: int, least: int) -> DataFrame:
    """Stripes merged element by element, in two kinds of rows: extensions (prefix, after, id, n) that occur `least` times,
    and for each chunk the ids of what it sent, in its order, -1 for what is not frequent."""

    def run(table: pa.Table) -> pa.Table:
        parts = [[unpack_sorted(x) for x in table["prefix"].to_pylist()], *([unpack(x) for x in table[c].to_pylist()] for c in ("after", "n"))]
        bucket = table["bucket"][0].as_py()
        prefix, after, which = distinct(*(np.concatenate(x) for x in parts[:2]))
        n = np.bincount(which, np.concatenate(parts[2]), len(prefix)).astype(np.int64)
        frequent = n >= least
        ids = np.where(frequent, (np.cumsum(frequent) - 1) * n_buckets + bucket, -1)
        answers = np.split(ids[which], np.cumsum([len(x) for x in parts[0]])[:-1])
        replies = {"chunk": table["chunk"].to_pylist(), "bucket": table["bucket"].to_pylist(), "found": [pack(x) for x in answers]}
        found = {"prefix": prefix[frequent], "after": after[frequent], "id": ids[frequent], "n": n[frequent]}
        batch = lambda rows, columns: pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in MERGED], schema=MERGED)
        return pa.Table.from_batches([batch(len(answers), replies), batch(int(frequent.sum()), found)], MERGED)

    return rows.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, found binary, prefix long, after long, id long, n long")


def advanced(state: DataFrame, replies: DataFrame, n_buckets: int) -> DataFrame:
    """The state of the next round: phrases of one more word by place."""

    def work(row: dict, found: pa.Table) -> list[pa.RecordBatch]:
        grams, last = state_of(row["grams"].as_py(), row["last"].as_py())
        places, prefix, _, which, bucket = stripes(grams, last, n_buckets)
        ids, longer = np.full(len(prefix), -1), np.full(len(grams), -1)
        answers = dict(zip(found["bucket"].to_pylist(), found["found"].to_pylist(), strict=True))
        for b, x in sent(0, bucket, {"at": np.arange(len(prefix))}):
            ids[x["at"]] = unpack(answers[b])
        longer[places] = ids[which]
        return [state_row(row["chunk"].as_py(), longer, np.append(last[1:], -1))]

    return by_chunk(state, replies.select("chunk", "bucket", "found"), work, STATE, STATE_SQL)


def coded(chunks: DataFrame, replies: DataFrame, n_buckets: int) -> DataFrame:
    """The chunks as ids of frequent words by place."""

    def work(row: dict, found: pa.Table) -> list[pa.RecordBatch]:
        bucket = unpack(row["hashes"].as_py()) % n_buckets
        table, answers = np.full(len(bucket), -1), dict(zip(found["bucket"].to_pylist(), found["found"].to_pylist(), strict=True))
        for b, x in sent(0, bucket, {"at": np.arange(len(bucket))}):
            table[x["at"]] = unpack(answers[b])
        return [state_row(row["chunk"].as_py(), table[unpack(row["numbers"].as_py())])]

    return by_chunk(chunks.select("chunk", "hashes", "numbers"), replies.select("chunk", "bucket", "found"), work, STATE, STATE_SQL)


def frequent_phrases(docs: DataFrame, longest: int, least: int, ends: str, spaces: str) -> tuple[list[DataFrame], DataFrame]:
    """For 1 to `longest` words the phrases that occur `least` times, (lang, id, phrase, n), each without what it begins with
    but for length 1 also (lang, n) of all words: see mine_collocations. docs: (text, lang)."""
    cut = word_chunks(docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("und")).alias("lang"), F.lit(True).alias("kept")), word_table(ends, spaces))
    chunks = stage_chunks(cut, "phrase-chunks")
    n_buckets = buckets(chunks.agg(F.sum("n")).first()[0] or 0, width(docs.sparkSession))
    counted = stage(merged_words(word_requests(chunks, n_buckets), n_buckets, least).drop("times"), "phrase-words")
    sizes = counted.where("found is null and word is null").groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary = counted.where("word is not null").select("lang", "word", "id", "n")
    state = stage_chunks(coded(chunks, counted.where("found is not null"), n_buckets), "phrase-state")
    unstage(chunks)
    found = [vocabulary.select("lang", "id", F.col("word").alias("phrase"), "n")]
    words = vocabulary.select(F.col("id").alias("after"), "word")
    for _ in range(2, longest + 1):
        answers = stage(merged(requests(state, n_buckets), n_buckets, least), "phrase-stripes")
        heads = found[-1].select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"))
        extensions = answers.where("id is not null").select("prefix", "after", "id", "n").join(heads, "prefix").join(words, "after")
        found.append(stage(extensions.select("lang", "id", F.concat_ws(" ", "head", "word").alias("phrase"), "n"), "phrases"))
        if len(found) < longest:
            longer = stage_chunks(advanced(state, answers.where("found is not null"), n_buckets), "phrase-state")
            unstage(state)
            state = longer
    return found, sizes


def mine_collocations(
    docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, scale: int = 1000, top: int = 2000, ends: str = ".,;:!?\n\x0b\x0c\r", spaces: str = " \t", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The best-scored phrases of 2 to `longest` words of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase occurs a >= `least` times within pieces of text (between `ends`), l and r are the counts of its parts at the
    cut that scores lowest, floor(scale * a * n / (l * r)) in exact arithmetic, n the language's words. Equal scores of cuts
    go to the shorter first part. A phrase that a longer one of these holds in `percent` of its occurrences is left out.
    Ties of phrases go to the larger a, then to the lesser phrase.

    A null or empty text has no words, a null language is `und`; repeated rows count again; all words of texts of any
    length count; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found, sizes = frequent_phrases(rows, longest, least, ends, spaces)
    of = lambda some: [df.select("lang", "phrase", "n") for df in some]
    every = of(found)[0]
    for df in of(found)[1:]:
        every = every.unionByName(df)
    candidates = every.where(F.instr("phrase", " ") > 0)
    longer = candidates.where(F.size(F.split("phrase", " ")) > 2)
    inside = F.explode(F.array(F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)")))
    most = longer.select("lang", inside.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = candidates.join(most, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {int(percent)} * n").select("lang", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("rest"))
    part = lambda name, n: every.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    score = F.expr(f"(cast({int(scale)} * cast(a as decimal(19,0)) as decimal(23,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", place("lang", "part")).where(F.col("rank") <= top).drop("part")
    ranked = first.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))


def op13_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(documents(spark, sf_dir))


SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w cross join (values (1), (2), (3), (4), (5)) as s(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from g group by 1, 2, 3),
sizes as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
c as (select * from f where k >= 2 and f >= 100),
held as (select distinct s.lang, s.phrase from c s join c t on t.lang = s.lang and t.k > s.k and 100 * t.f >= 100 * s.f and contains(' '||t.phrase||' ', ' '||s.phrase||' ')),
cuts as (select c.lang, c.phrase, c.f as a, unnest(range(1, c.k)) as k, string_split(c.phrase, ' ') as words from c where not exists (select 1 from held h where h.lang = c.lang and h.phrase = c.phrase)),
scored as (select x.lang, x.phrase, x.a, x.k, l.f as l, r.f as r, n, (1000::hugeint * x.a * n // (l.f::hugeint * r.f))::bigint as score
 from cuts x join f l on l.lang = x.lang and l.phrase = array_to_string(words[1:x.k], ' ') join f r on r.lang = x.lang and r.phrase = array_to_string(words[x.k + 1:], ' ') join sizes z on z.lang = x.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""
