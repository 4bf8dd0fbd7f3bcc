"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizations of a text cut the same bytes. A link is a pair of tokens, one of each, whose bytes overlap; a group ends
where both end a token. Pairs of token ids are indexed the other way round: for each pair, in which documents it is linked,
as compressed bitmaps over documents (a container for each pair and chunk of documents: sorted 16-bit places, or plain
bits where these are shorter), with further planes for the bits of how often. OR-merged containers are popcounted for
document counts, planes weigh in for link counts; then the postings carry the counts back to the documents.

Documents are numbered by (chunk, place) as the tasks meet them, so no shuffle is needed to number them. A pair's bitmap is
the set of its containers, never one row: a pair in all documents is spread like any other.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factgraph.llm.common import documents, stage
from factgraph.llm.tokens import MODEL, SPACE, Pieces, plain_model

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: White space of all kinds, as a class: at least what the byte tokenizer's pattern takes for such.
WHITE = "[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: A worker keeps the alignments of units that it met before, up to this many of them and of their links.
CACHE, LINKS = 1_000_000, 8_000_000
#: Longer units are encoded on their own.
UNIT = 64
#: Rows that are aligned at once; a chunk ends with PLACES documents or ENTRIES (pair, document) entries.
ROWS, PLACES, ENTRIES = 512, 1 << 16, 2_000_000

#: Bits that are unpacked at once.
CELLS = 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Aligner:
    byte_model: str
    piece_model: bytes
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.forget()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        self.a = Tokenizer.from_str(self.byte_model)
        self.a.encode_special_tokens = True
        self.a.no_padding(), self.a.no_truncation()
        self.pieces = Pieces(self.piece_model)
        alphabet, size = byte_alphabet(), max(self.a.get_vocab().values()) + 1
        entries: list[bytes] = [b""] * size
        for entry, i in self.a.get_vocab().items():
            entries[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.bytes_a, self.bytes_b = pa.array(entries, pa.binary()), pc.fill_null(self.pieces.surfaces, b"")
        self.shown = pa.array([f"{i}{mark}" for mark in ",|" for i in range(size)] + [f"{i}{mark}" for mark in ",;" for i in range(len(self.bytes_b))], pa.binary())
        self.at_b = 2 * size

    def units(self, texts: pa.Array) -> pa.ListArray:
        """Each text cut before the spaces that follow something else than white space; without the one in front. There the
        byte tokenizer's pattern ends a word and no piece goes on."""
        if not self.pieces.by_word:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
        cut = pc.split_pattern(texts, " ")
        odd = np.flatnonzero(pc.match_substring_regex(pc.binary_join_element_wise(" ", texts, ""), f"{WHITE} ").to_numpy(zero_copy_only=False))
        if not len(odd):
            return cut
        several = [re.split(f"(?<!{WHITE}) ", " " + texts[int(i)].as_py()) for i in odd]
        several = [[first[1:], *rest] if first else rest for first, *rest in several]
        at = np.arange(len(texts))
        at[odd] = len(texts) + np.arange(len(odd))
        return pa.concat_arrays([cut, pa.array(several, cut.type)]).take(pa.array(at))

    def forget(self) -> None:
        """Starts the table of aligned units anew: their counts (of A, of B, groups, whether the bytes are held), links and
        groups as text, with where each unit's begin."""
        self.known.clear()
        self.counts, self.pairs, self.text = np.zeros((4, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.pair_at, self.text_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def tokens(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, bool]:
        """The ids of both for strings that end where units end, and whether their bytes are those of the strings."""
        a = np.concatenate([np.zeros(0, np.int64), *(np.array(e.ids, np.int64) for e in self.a.encode_batch(strings, add_special_tokens=False))])
        b = np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in self.pieces.processor.encode([s.replace(" ", SPACE) for s in strings], num_threads=1))])
        text = "".join(strings).encode()

        def held(table: pa.Array, ids: np.ndarray) -> bool:
            if not len(ids):
                return not text
            taken = table.take(pa.array(ids))
            return taken.buffers()[2][: np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)[-1]].equals(pa.py_buffer(text))

        return a, b, held(self.bytes_a, a) and held(self.bytes_b, b)

    def learn(self, words: list[str]) -> None:
        """Aligns units that are not in the table. Those that end in something else than white space are encoded many at a
        time."""
        full = [" " + w for w in words]
        alone = [w for w in full if w[-1:].isspace() or SPACE in w or len(w) > UNIT]
        apart = set(alone)
        joined = [w for w in full if w not in apart]
        found = []
        for first in range(0, len(joined), 1 << 14):
            part = joined[first : first + (1 << 14)]
            a, b, held = self.tokens(["".join(part[k : k + 512]) for k in range(0, len(part), 512)])
            together = self.linked([len(w.encode()) for w in part], a, b) if held else None
            found += [together] if together else [self.one(w) for w in part]
        found += [self.one(w) for w in alone]
        self.known.update((w[1:], i) for i, w in enumerate(joined + alone, len(self.known)))
        counts, n_pairs, pairs, n_text, text = zip(*found, strict=True)
        self.counts, self.pairs, self.text = np.concatenate([self.counts, *counts], axis=1), np.concatenate([self.pairs, *pairs]), np.concatenate([self.text, *text])
        self.pair_at = np.concatenate([self.pair_at, self.pair_at[-1] + np.cumsum(np.concatenate(n_pairs))])
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + np.cumsum(np.concatenate(n_text))])

    def one(self, text: str) -> tuple[np.ndarray, ...]:
        a, b, held = self.tokens([text])
        none = np.zeros(1, np.int64)
        return self.linked([len(text.encode())], a, b) if held else (np.zeros((4, 1), np.int64), none, none[:0], none, np.zeros(0, np.uint8))

    def linked(self, sizes: list[int], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """Units of these sizes in bytes, from the ids of both over their concatenation: counts, number of links, links,
        length of the groups as text, that text. None if a unit ends inside a token."""
        of = lambda table, ids: np.cumsum(pc.binary_length(table).to_numpy().astype(np.int64)[ids])
        ends_a, ends_b, ends = of(self.bytes_a, a), of(self.bytes_b, b), np.cumsum(sizes)
        both = np.sort(np.concatenate([ends_a, ends_b]))
        again = both[1:] == both[:-1]
        both, common = both[np.concatenate([~again, [True]])], both[1:][again]
        at = np.searchsorted(common, ends)
        if at[-1] >= len(common) or (common[at] != ends).any():
            return None
        pairs = a[np.searchsorted(ends_a, both)] << 32 | b[np.searchsorted(ends_b, both)]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        upto_a, upto_b = np.searchsorted(ends_a, common, "right"), np.searchsorted(ends_b, common, "right")
        shown = np.zeros(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]] = a + (common[group_a] == ends_a) * (self.at_b // 2)
        shown[np.arange(len(b)) + upto_a[group_b]] = b + (common[group_b] == ends_b) * len(self.bytes_b) + self.at_b
        text = self.shown.take(pa.array(shown))
        places = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1)
        n_a, n_b = upto_a[at], upto_b[at]
        links = np.searchsorted(both, ends, "right")
        step = lambda x: np.diff(x, prepend=0).astype(np.int64)
        counts = np.stack([step(n_a), step(n_b), step(at + 1), np.ones(len(ends), np.int64)])
        return counts, step(links), pairs, step(places[n_a + n_b]), np.frombuffer(text.buffers()[2], np.uint8, places[-1])

    def batch(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: counts by document, digests, and (pair, place, times) of what is linked, by pair and place."""
        units = self.units(texts)
        coded = units.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > CACHE or len(self.pairs) > LINKS:
            self.forget()
        known = list(map(self.known.get, words))
        if new := [w for w, i in zip(words, known, strict=True) if i is None]:
            self.learn(new)
            known = list(map(self.known.get, words))
        found = np.array(known, np.int64)
        which, starts = found[coded.indices.to_numpy()], units.offsets.to_numpy() - units.offsets[0].as_py()
        of = np.repeat(np.arange(len(texts)), np.diff(starts))
        bad = (np.bincount(of, self.counts[3][which] == 0, len(texts)) > 0) | (pc.binary_length(texts).to_numpy() == 0)
        which, of = which[~bad[of]], of[~bad[of]]
        total = lambda values: np.bincount(of, values[which], len(texts)).astype(np.int64)
        n_pairs, n_text = np.diff(self.pair_at), np.diff(self.text_at)
        counts = dict(zip(("n_a", "n_b", "n_groups", "n_links"), (*(total(x) for x in self.counts[:3]), total(n_pairs)), strict=True))
        shown = pa.Array.from_buffers(pa.large_binary(), len(n_text), [None, pa.py_buffer(self.text_at), pa.py_buffer(self.text)]).take(pa.array(which))
        data, ends = memoryview(shown.buffers()[2] or b""), np.cumsum(total(n_text)).tolist()
        digests = ["" if end == start else hashlib.sha256(data[start : end - 1]).hexdigest() for start, end in zip([0, *ends], ends, strict=False)]
        # Links by their number among those of the units at hand, which are fewer than the links of the texts.
        span = lambda at, n: np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        met, which = np.unique(which, return_inverse=True)
        n = n_pairs[met]
        keys, local = np.unique(self.pairs[span(self.pair_at[met], n)], return_inverse=True)
        flat = local[span((np.cumsum(n) - n)[which], n[which])]
        entries = np.sort(flat * len(texts) + np.repeat(of, n[which]))
        first = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1]])) if len(entries) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(entries)))
        entries = entries[first]
        return counts, digests, keys[entries // len(texts)], entries % len(texts), times


ROW = pa.schema([
    ("chunk", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("places", pa.int32()), ("n", pa.int32()), ("dense", pa.bool_()), ("bits", pa.binary()),
])
ROW_SQL = "chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, plane int, places int, n int, dense boolean, bits binary"


def row_batch(rows: int, **columns) -> pa.RecordBatch:
    """A batch with these columns, nulls in all others."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in ROW], schema=ROW)


def containers(chunk: int, plane: int, pairs: np.ndarray, docs: np.ndarray, places: int) -> Iterator[pa.RecordBatch]:
    """One plane's containers from (pair, document) sorted by both: 16-bit places, or bits where they are fewer bytes."""
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(pairs)))
    dense = 2 * n > (places + 7) // 8
    for wide in (False, True):
        rows = np.flatnonzero(dense == wide)
        if not len(rows):
            continue
        kept = docs[np.repeat(dense == wide, n)]
        if wide:
            bits = np.zeros((len(rows), places), bool)
            bits[np.repeat(np.arange(len(rows)), n[rows]), kept] = True
            data, sizes = np.packbits(bits, axis=1, bitorder="little").tobytes(), np.full(len(rows), (places + 7) // 8)
        else:
            data, sizes = kept.astype("<u2").tobytes(), 2 * n[rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        key = pairs[first[rows]]
        of_all = {k: np.full(len(rows), x) for k, x in (("chunk", chunk), ("plane", plane), ("places", places), ("dense", wide))}
        yield row_batch(len(rows), a=key >> 32, b=key & 0xFFFFFFFF, n=n[rows], bits=held, **of_all)


def or_merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings (pair, document, times) of the batches of a chunk as one, by pair and document. A document is in one batch."""
    pairs, docs, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(pairs, kind="stable")
    return pairs[order], docs[order], times[order]


def postings(chunk: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], places: int) -> Iterator[pa.RecordBatch]:
    """The containers of a chunk: plane 0 holds the documents of a pair, plane k those with bit k - 1 of the further links."""
    pairs, docs, times = or_merged(parts)
    yield from containers(chunk, 0, pairs, docs, places)
    more = times - 1
    for k in range(int(more.max(initial=0)).bit_length()):
        has = (more >> k & 1) == 1
        yield from containers(chunk, k + 1, pairs[has], docs[has], places)


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds, staged: one for each document, and the containers of each chunk's pairs."""
    with open(byte_path) as f:
        byte_model = f.read()
    piece_model = plain_model(piece_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = Aligner(byte_model, piece_model), TaskContext.get().partitionId()
        n, places, held, entries = 0, 0, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                ids, texts = batch.slice(start, ROWS).columns
                counts, digests, pairs, docs, times = aligner.batch(pc.fill_null(texts, ""))
                if held and (places + len(ids) > PLACES or entries + len(pairs) > ENTRIES):
                    yield from postings(part << 24 | n, held, places)
                    n, places, held, entries = n + 1, 0, [], 0
                where = np.arange(places, places + len(ids), dtype=np.int32)
                yield row_batch(len(ids), chunk=[part << 24 | n] * len(ids), place=where, doc_id=ids, groups_sha256=digests, **counts)
                held.append((pairs, docs + places, times))
                places, entries = places + len(ids), entries + len(pairs)
        if held:
            yield from postings(part << 24 | n, held, places)

    return stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ROW_SQL), "alignment")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best): over all documents, how many link a pair, how many links hold it, and whether no pair
    of the same b has more."""
    held = rows.where("a is not null")
    weight = F.when(F.col("plane") == 0, F.col("n").cast("long")).otherwise(F.expr("shiftleft(cast(n as bigint), plane - 1)"))
    counts = held.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"), F.sum(weight).alias("n_links"))
    counts = stage(counts, "alignment-counts")
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    return counts.join(most, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def returned(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, place, n_best, count_sum): what the postings bring back to each document that has links. A chunk's containers
    meet in one task, which adds them up as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, places, n, times, count, best, dense = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            weights = np.stack([times * best, times * count])
            for c in np.unique(chunk).tolist():
                own = chunk == c
                total = sums.setdefault(c, np.zeros((2, int(places[own][0])), np.int64))
                for wide in (False, True):
                    at = np.flatnonzero(own & (dense == wide))
                    if not len(at):
                        continue
                    data = np.concatenate([np.frombuffer(batch.column(7)[int(i)].as_buffer(), np.uint8) for i in at])
                    if wide:
                        bits, step = data.reshape(len(at), -1), max(1, CELLS // total.shape[1])
                        for k in range(0, len(at), step):
                            total += weights[:, at[k : k + step]] @ np.unpackbits(bits[k : k + step], axis=1, count=total.shape[1], bitorder="little")
                    else:
                        for sums_of, weight in zip(total, weights, strict=True):
                            np.add.at(sums_of, data.view("<u2"), np.repeat(weight[at], n[at]))
        for c, (n_best, count_sum) in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": np.full(len(n_best), c), "place": np.arange(len(n_best), dtype=np.int32), "n_best": n_best, "count_sum": count_sum})

    times = F.expr("shiftleft(1L, greatest(plane - 1, 0))").alias("times")
    scores = counts.select("a", "b", F.col("n_links").alias("count"), "best")
    sent = rows.where("a is not null").join(scores, ["a", "b"]).select("chunk", "places", "n", times, "count", "best", "dense", "bits")
    return sent.repartition("chunk").mapInArrow(run, "chunk long, place int, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, byte_path: str = BYTE_MODEL, piece_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Aligns the tokens of a byte-level model (A) and of a SentencePiece model (B, which adds a space) over space + text.

    Returns a row for each document (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and one for each
    pair of ids that is linked (a, b, n_docs, n_links, best). A null or empty text, or one that a tokenizer does not give
    back byte for byte (U+2581 is a space to B), has no tokens: zeros and an empty digest. Repeated rows are rows of their
    own and all count; ids may be null or repeated; ties for the most links of a B id are all best; an empty table gives
    two empty ones; other columns are ignored. Texts of any length are read whole; a stretch without a space is one unit.
    """
    rows = aligned(docs, byte_path, piece_path, id_col, text_col)
    counts = stage(pair_counts(rows), "alignment-pairs")
    found = rows.where("a is null").join(returned(rows, counts), ["chunk", "place"], "left").fillna(0, ["n_best", "count_sum"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))[0]
