"""Words of documents in chunks, and counting over all chunks what is distinct in each.

A chunk is half a million neighbouring words, as numbers into a dictionary of its own: one row. What a chunk knows locally
(words, pairs of words) it sends once, with a count; what all chunks together say comes back to it once. So shuffles carry
what is distinct in a chunk, packed, and no row, task or driver ever holds a count table of the whole corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import shared_dir, width

#: Words in a chunk (the documents that begin in it are in it whole), and keys in a bucket that chunks are merged in.
WORDS, KEYS = 500_000, 1 << 20
#: Rows that are cut at once.
ROWS = 256
#: Counts of counts are told up to this count.
COUNTS = 6
#: Stands for the end of a document or piece among words, none of which can hold it.
END = "\n"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from -1 on, byte plane by byte plane, compressed."""
    up = values.astype(np.int64) + 1
    width = max(1, (int(up.max(initial=0)).bit_length() + 7) // 8)
    planes = up.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if len(up) else b""
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    out = np.zeros((len(planes) // data[0], 8), np.uint8)
    out[:, : data[0]] = planes.reshape(data[0], -1).T
    return out.view(np.int64).ravel() - 1


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def mixed(values: np.ndarray) -> np.ndarray:
    """Evenly spread hashes of whole numbers."""
    h = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashed(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def word_table(ends: str, spaces: str) -> np.ndarray:
    """What each byte of a text becomes: A-Z lower case, `ends` END, `spaces` a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(ends.encode())], table[list(spaces.encode())] = ord(END), ord(" ")
    return table


def words_of(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one after the other, END behind each, and where each text's begin."""
    whole = pc.binary_join_element_wise(texts, "", "")
    data = whole.buffers()[2]
    if data is not None and len(data):
        whole = pa.Array.from_buffers(whole.type, len(whole), [None, whole.buffers()[1], pa.py_buffer(table[np.frombuffer(data, np.uint8)])])
    cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(whole, END, ""), END, f" {END} "), " ")
    words = cut.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    starts = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
    return words.filter(real), starts


CHUNK = pa.schema([("chunk", pa.int64()), ("words", pa.list_(pa.string())), ("langs", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("hashes", pa.binary()), ("end", pa.int64()), ("numbers", pa.binary()), ("ids", pa.list_(pa.int64())), ("kept", pa.list_(pa.bool_())), ("n", pa.int64())])


def word_chunks(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """docs: (doc_id long, text, lang, kept boolean). Returns a row for each chunk: its distinct (lang, word), the most
    frequent first, with how often the documents that are `kept` hold them and a hash each, the first of these that is END,
    its words as numbers into these, its documents' ids and `kept`. A document's last word is END; there is none else unless
    the table makes some. A null text is an empty one."""

    def chunk(key: int, held: list[tuple]) -> pa.RecordBatch:
        words, langs, ids, kept, sizes = (list(x) for x in zip(*held, strict=True))
        coded = pa.concat_arrays(words).dictionary_encode()
        names = pa.concat_arrays(langs).dictionary_encode()
        sizes, kept = np.concatenate(sizes), np.concatenate(kept)
        n = len(coded.dictionary)
        both, numbers, every = np.unique(np.repeat(names.indices.to_numpy().astype(np.int64), sizes) * n + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
        order = np.argsort(-every, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        both, numbers = both[order], place[numbers]
        counts = np.bincount(numbers, np.repeat(kept, sizes), len(both)).astype(np.int64)
        hashes = (hashed(coded.dictionary)[both % n] ^ mixed(hashed(names.dictionary))[both // n]) & np.uint64(0xFFFFFFFF)
        end = int(np.argmax(both % n == coded.dictionary.index(END).as_py()))
        row = [key, coded.dictionary.take(pa.array(both % n)), names.dictionary.take(pa.array(both // n)), pa.array(counts), pack(hashes), end, pack(numbers), pa.concat_arrays(ids), pa.array(kept), len(numbers)]
        listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(f.type) if isinstance(x, pa.Array) else pa.array([x], f.type) for x, f in zip(row, CHUNK, strict=True)]
        return pa.RecordBatch.from_arrays(listed, schema=CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size, held = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                ids, texts, langs, kept = batch.slice(start, ROWS).columns
                words, starts = words_of(pc.fill_null(texts, ""), table)
                held.append((words, langs, ids, kept.to_numpy(zero_copy_only=False), np.diff(starts)))
                size += len(words)
                if size >= WORDS:
                    yield chunk(part << 24 | n, held)
                    n, size, held = n + 1, 0, []
        if held:
            yield chunk(part << 24 | n, held)

    schema = "chunk long, words array<string>, langs array<string>, counts array<long>, hashes binary, end long, numbers binary, ids array<long>, kept array<boolean>, n long"
    return docs.select("doc_id", "text", "lang", "kept").mapInArrow(run, schema)


def stage_chunks(df: DataFrame, name: str) -> DataFrame:
    """Writes rows with a chunk into the shared folder, bucketed by it, so that what is later asked of or told to chunks moves
    and the chunks themselves stay."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.bucketBy(width(spark), "chunk").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def by_chunk(left: DataFrame, right: DataFrame, work: Callable[[dict, pa.Table], Iterator[pa.RecordBatch] | list[pa.RecordBatch]], schema: pa.Schema, sql: str) -> DataFrame:
    """For each row of `left`, one for a chunk, and all rows of `right` of that chunk: what `work` makes of them."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.Table.from_batches([x for row in a.to_batches() for i in range(row.num_rows) for x in work({f: row.column(f)[i] for f in row.schema.names}, b)], schema)

    # A column of its own tells the sides apart where both come from one table.
    return left.groupBy("chunk").cogroup(right.withColumn("of", F.col("chunk") + 0).drop("chunk").groupBy("of")).applyInArrow(run, sql)


def buckets(words: int, width: int) -> int:
    return max(width, words // KEYS + 1)


def sent(chunk: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The entries of a chunk dealt out over buckets; those of a bucket stay in order."""
    order = np.argsort(bucket, kind="stable")
    dealt = bucket[order]
    cuts = [0, *(np.flatnonzero(dealt[1:] != dealt[:-1]) + 1).tolist(), len(dealt)]
    for start, stop in zip(cuts, cuts[1:] if len(dealt) else [], strict=False):
        yield int(dealt[start]), {k: v[order[start:stop]] for k, v in columns.items()}


def word_requests(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, chunk, words, names, langs, n): the words of every chunk, which are the stripe of the empty phrase, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            for i in range(batch.num_rows):
                key, words, langs, counts, hashes = (batch.column(c)[i] for c in range(5))
                words, names = words.values, langs.values.dictionary_encode()
                for b, x in sent(0, unpack(hashes.as_py()) % n_buckets, {"at": np.arange(len(words))}):
                    at = pa.array(x["at"])
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([b], pa.int64()), "chunk": pa.array([key.as_py()], pa.int64()), "words": [squeeze(END.join(w if w != END else "" for w in words.take(at).to_pylist()).encode())],
                        "names": pa.array([names.dictionary.to_pylist()], pa.list_(pa.string())), "langs": [pack(names.indices.take(at).to_numpy())], "n": [pack(counts.values.take(at).to_numpy())],
                    })

    return chunks.select("chunk", "words", "langs", "counts", "hashes").mapInArrow(run, "bucket long, chunk long, words binary, names array<string>, langs binary, n binary")


FOUND = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("found", pa.binary()), ("times", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("n", pa.int64())])


def merged_words(rows: DataFrame, n_buckets: int, least: int, listed: bool = True) -> DataFrame:
    """Words merged over all chunks: for each chunk the ids (`found`) and counts (`times`) of what it sent, -1 and 0 for those
    that do not occur `least` times in documents that count, and rows without a chunk. If `listed`, END is no word, and
    these are the frequent words (lang, word, id, n) and each bucket's total of a language (word null). Else END is one, and
    they are the counts of counts of a bucket: n words occur id times; id 0 is the number of its words, id -1 their total."""

    def run(table: pa.Table) -> pa.Table:
        open_, bucket = zstandard.ZstdDecompressor().decompress, table["bucket"][0].as_py()
        parts = [open_(x).decode().split(END) for x in table["words"].to_pylist()]
        words = pa.array([w for p in parts for w in p], pa.string()).dictionary_encode()
        langs = pa.concat_arrays([pa.array(names, pa.string()).take(pa.array(unpack(x))) for names, x in zip(table["names"].to_pylist(), table["langs"].to_pylist(), strict=True)]).dictionary_encode()
        size = len(words.dictionary)
        keys, which = np.unique(langs.indices.to_numpy().astype(np.int64) * size + words.indices.to_numpy(), return_inverse=True)
        n = np.bincount(which, np.concatenate([unpack(x) for x in table["n"].to_pylist()]), len(keys)).astype(np.int64)
        real = np.ones(len(keys), bool) if not listed else np.array([w != "" for w in words.dictionary.to_pylist()])[keys % size]
        order = np.flatnonzero(real & (n >= least))
        order = order[np.argsort(-n[order], kind="stable")]
        ids = np.full(len(keys), -1)
        ids[order] = np.arange(len(order)) * n_buckets + bucket
        cuts = np.cumsum([len(x) for x in parts])[:-1]
        answers = {"found": [pack(x) for x in np.split(ids[which], cuts)], "times": [pack(x) for x in np.split(np.where(ids < 0, 0, n)[which], cuts)]}
        batch = lambda rows, columns: pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in FOUND], schema=FOUND)
        batches = [batch(len(parts), {"chunk": table["chunk"].to_pylist(), "bucket": table["bucket"].to_pylist(), **answers})]
        if listed:
            totals = np.bincount(keys[real] // size, n[real], len(langs.dictionary)).astype(np.int64)
            batches.append(batch(len(order), {"lang": langs.dictionary.take(pa.array(keys[order] // size)).to_pylist(), "word": words.dictionary.take(pa.array(keys[order] % size)).to_pylist(), "id": ids[order], "n": n[order]}))
            batches.append(batch(len(totals), {"lang": langs.dictionary.to_pylist(), "n": totals}))
        else:
            few = np.bincount(n[order][n[order] <= COUNTS], minlength=COUNTS + 1)
            batches.append(batch(COUNTS + 2, {"id": np.arange(-1, COUNTS + 1), "n": np.concatenate([[n[order].sum(), len(order)], few[1:]]).astype(np.int64)}))
        return pa.Table.from_batches(batches, FOUND)

    return rows.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, found binary, times binary, lang string, word string, id long, n long")
