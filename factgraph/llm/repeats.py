"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

Every window of `length` bytes is represented by one suffix that starts in it: the one whose q-gram has the least
hash. Equal windows choose the same suffix, so a window can only repeat where its suffix's q-gram does. Suffixes are
first bucketed by q-gram; a bucket of one is final. The others are refined: the identifier of a place becomes that of
the pair (own identifier, identifier `reach` bytes later), the reach doubles each time, and each step takes what the one
before has written (`Ladder`). Two identifiers of one rung, at a stretch's start and so that they end with it, say what
the whole stretch is. Where a bucket still holds several classes, groups of neighbouring windows and at last single
windows are refined the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import digest_rows, documents, stage, unstage, width, with_unique_id

#: Window starts that are worked on at once: bounds memory on giant texts.
TILE = 1 << 18
BASE = 0x9E3779B97F4A7C15
U = np.uint64


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64."""
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, b, U), dtype=U)]) for b in (BASE, inverse))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gram_ids(data: np.ndarray, q: int) -> np.ndarray:
    """The bucket identifier of the q-gram at each position: a polynomial hash, so it says only what the bytes are."""
    up, down = powers(TILE + 4096)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)], dtype=U)])
    return mixed((sums[q:] - sums[:-q]) * down[: len(data) - q + 1])


class Ladder:
    """Identifiers of places, refined by those at later offsets: rung k says what the next q * 2 ** k bytes are."""

    def __init__(self, ids: np.ndarray, q: int):
        self.ids, self.q = ids, q

    def rung(self, k: int, at: np.ndarray) -> np.ndarray:
        """From the rung below, there and as many bytes later as that reaches. Only for the places that are asked for."""
        if not k:
            return self.ids[at]
        return mixed(self.rung(k - 1, at) * U(0xFF51AFD7ED558CCD) + self.rung(k - 1, at + (self.q << (k - 1))))

    def stretch(self, first: np.ndarray, span: np.ndarray, salts: tuple[int, ...] = (0,)) -> list[np.ndarray]:
        """What the bytes first .. first + span are, once for each salt: the highest rung that fits, at the start and so
        that it ends with them."""
        out = [np.zeros(len(first), U) for _ in salts]
        height = np.log2(span // self.q).astype(np.int64)
        for k in np.unique(height).tolist():
            at = height == k
            a, n = first[at], span[at]
            begin, end = self.rung(k, a), self.rung(k, a + n - (self.q << k)) + n.astype(U)
            for column, salt in zip(out, salts, strict=True):
                column[at] = mixed((begin ^ U(salt)) * U(0x9FB21C651E98DF25) + end)
        return out


def sliding_argmin(ids: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` neighbours, the leftmost of equals."""
    v = (ids & ~U(0xFFFFF)) | np.arange(len(ids), dtype=U)
    reach = 1
    while reach * 2 <= width:
        v = np.minimum(v[:-reach], v[reach:])
        reach *= 2
    if width > reach:
        v = np.minimum(v[: len(v) - (width - reach)], v[width - reach :])
    return (v & U(0xFFFFF)).astype(np.int64)


@dataclass(frozen=True)
class Plan:
    length: int = 100
    q: int = 32

    def tiles(self, data: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """Overlapping pieces; each window starts in one of them."""
        whole = np.frombuffer(data, np.uint8)
        for start in range(0, max(0, len(data) - self.length + 1), TILE):
            yield start, whole[start : start + TILE + self.length - 1]

    def runs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and suffix of each run of windows with one suffix."""
        at = sliding_argmin(ids, self.length - self.q + 1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return first, np.diff(np.append(first, len(at))), at[first]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


#: Sampled suffixes that a task holds before it deals them out.
HELD = 200_000
COLUMNS = (np.int64, np.int64, np.int64, np.int32, np.int32)


def dealt(docs: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """(part, done, body): the sampled suffixes (bucket, refined class, document, first window, shape), columns packed, in
    parts by bucket. shape is windows * 1024 + offset of the suffix. Of suffixes of one class that a task holds at once,
    all but the first are done: they repeat. These need no bucket and are dealt evenly; so a class that is everywhere sends
    few to its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        pack = zstandard.ZstdCompressor(1)

        def flush() -> pa.RecordBatch:
            h, k, uid, start, shape = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((start, uid, k, h))
            h, k, uid, start, shape = (x[order] for x in (h, k, uid, start, shape))
            later = np.concatenate([[False], (h[1:] == h[:-1]) & (k[1:] == k[:-1])])
            anywhere = mixed(uid[:1].view(U) ^ mixed(start[:1].astype(U)))
            part = (np.where(later, anywhere, h.view(U) >> U(32)) % U(parts)).astype(np.int64) * 2 + later
            order = np.lexsort((start, uid, part))  # by document within a part: so the columns compress
            part, columns = part[order], [x[order].astype(t) for x, t in zip((h, k, uid, start, shape), COLUMNS, strict=True)]
            cuts = np.flatnonzero(np.diff(part)) + 1
            pieces = zip(*(np.split(c, cuts) for c in columns), strict=True)
            keys = part[np.concatenate([[0], cuts])]
            bodies = [pack.compress(b"".join(c.tobytes() for c in x)) for x in pieces]
            return pa.RecordBatch.from_pydict({"part": pa.array((keys // 2).astype(np.int32)), "done": pa.array(keys % 2 == 1), "body": pa.array(bodies, pa.binary())})

        for uids, texts in digest_rows(batches, ["uid", "text"]):
            for uid, text in zip(uids, texts, strict=True):
                for begin, tile in plan.tiles((text or "").encode()):
                    ids = gram_ids(tile, plan.q)
                    first, n, at = plan.runs(ids)
                    shape = n * 1024 + at - first
                    key = Ladder(ids, plan.q).stretch(first, n + plan.length - 1)[0] ^ mixed(shape.astype(U))
                    held.append((ids[at].view(np.int64), key.view(np.int64), np.full(len(first), uid), first + begin, shape))
            if sum(len(x[0]) for x in held) >= HELD:
                yield flush()
        if held:
            yield flush()

    return docs.select("uid", "text").mapInArrow(run, "part int, done boolean, body binary")


def unpacked(bodies: list[bytes]) -> list[np.ndarray]:
    width, out = sum(np.dtype(t).itemsize for t in COLUMNS), [[np.zeros(0, t)] for t in COLUMNS]
    unpack = zstandard.ZstdDecompressor()
    for body in map(unpack.decompress, bodies):
        n, at = len(body) // width, 0
        for column, t in zip(out, COLUMNS, strict=True):
            column.append(np.frombuffer(body, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(c) for c in out]


def sampled(dealt: DataFrame, parts: int) -> DataFrame:
    """The rows of dealt, unpacked, each bucket in one partition, sorted by bucket and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, bodies in digest_rows(batches, ["done", "body"], 1):
            columns = unpacked(bodies)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), done[0])), *map(pa.array, columns)], ["done", "h", "k", "uid", "start", "shape"])

    rows = dealt.repartition(parts, "part").mapInArrow(run, "done boolean, h long, k long, uid long, start int, shape int")
    return rows.sortWithinPartitions("h", "k", "uid", "start")


def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted samples: (uid, start, shape, open). Later members of a class repeat as a whole; the first of each class is
    open if its bucket holds several classes, and else final, as is a bucket of one. Holds one batch and one row."""
    at = None  # bucket and class of the row before
    first = None  # the first row of its bucket, while one class of that is known
    for batch in batches:
        done, h, k, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        out = [[x[done] for x in (*rest, np.zeros(len(done), bool))]]
        h, k, *rest = (x[~done] for x in (h, k, *rest))
        if len(h):
            new_h = np.concatenate([[at is None or h[0] != at[0]], h[1:] != h[:-1]])
            new_k = new_h | np.concatenate([[at is None or k[0] != at[1]], k[1:] != k[:-1]])
            bucket = np.cumsum(new_h)
            several = np.bincount(bucket, weights=new_k & ~new_h) > 0  # a class after the bucket's first
            if first is not None and several[0]:
                out.append([*first, np.ones(1, bool)])
            if several[0] or bucket[-1]:
                first = None
            keep = ~new_h | several[bucket]
            out.append([x[keep] for x in (*rest, new_k)])
            if bucket[-1] and not several[-1]:
                place = np.flatnonzero(new_h)[-1:]
                first = [x[place] for x in rest]
            at = h[-1], k[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["uid", "start", "shape", "open"])


def packed(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, body): the texts, compressed for the network."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for uids, ids, texts in digest_rows(batches, ["uid", "doc_id", "text"]):
            bodies = [pack.compress((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_pydict({"uid": pa.array(uids, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "body": pa.array(bodies, pa.binary())})

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, body binary")


def cores(bodies: DataFrame, plan: Plan) -> DataFrame:
    """(core, uid, start, n): the windows of open runs in groups of neighbours, each with the identifier of what all windows
    of that place in a run share. Where that does not repeat, none of them does; a chance match costs no more than work."""
    slack = plan.length - plan.q
    edges = [(slack + 1) * j // 4 for j in range(5)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for uids, texts, opened in digest_rows(batches, ["uid", "body", "open"], 64):
            out: list[list[np.ndarray]] = [[np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for uid, body, runs in zip(uids, texts, opened, strict=True):
                runs = np.array([(r["start"], r["shape"] // 1024, r["shape"] % 1024) for r in runs], np.int64).reshape(-1, 3)
                for begin, tile in plan.tiles(unpack.decompress(body)):
                    ids = Ladder(gram_ids(tile, plan.q), plan.q)
                    s, n, off = runs[(runs[:, 0] >= begin) & (runs[:, 0] < begin + TILE)].T
                    at = s - begin + off
                    for j, (low, high) in enumerate(zip(edges, (e - 1 for e in edges[1:]), strict=False)):
                        a, b = np.maximum(off - n + 1, low), np.minimum(off, high)  # distances of windows to the suffix
                        some = a <= b
                        span = np.full(int(some.sum()), plan.length - (high - low))
                        first = at[some] - low
                        mark = U(j + 1)
                        for column, x in zip(out, (ids.stretch(first, span)[0] ^ mark, np.full(len(first), uid), at[some] - b[some] + begin, (b - a + 1)[some]), strict=True):
                            column.append(x)
            core, uid, start, n = map(np.concatenate, out)
            yield pa.RecordBatch.from_pydict({"core": signed(core), "uid": pa.array(uid), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32))})

    return bodies.mapInArrow(run, "core long, uid long, start int, n int")


#: Windows that a task holds before it hands them on.
WINDOWS = 1 << 17


def windows(bodies: DataFrame, plan: Plan) -> DataFrame:
    """(done, w1, w2, uid, start, end): the windows of the runs in `open`, by the identifiers of their bytes. Of equal
    windows that a task holds at once all but the first repeat: these are done, joined to stretches, and dealt evenly. So
    a window that is everywhere sends one row for each WINDOWS windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            w1, w2, uid, start = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((start, uid, w2, w1))
            w1, w2, uid, start = (x[order] for x in (w1, w2, uid, start))
            later = np.concatenate([[False], (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])])
            d, s = uid[later], start[later]
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
            tail = np.append(head[1:], len(d))[: len(head)] - 1
            anywhere = mixed(d[head].view(U) ^ mixed(s[head].astype(U)))
            columns = (
                [np.ones(len(head), bool), anywhere, np.zeros(len(head), U), d[head], s[head], s[tail] + plan.length],
                [np.zeros(int((~later).sum()), bool), w1[~later], w2[~later], uid[~later], start[~later], start[~later] + plan.length],
            )
            done, w1, w2, uid, start, end = (np.concatenate(c) for c in zip(*columns, strict=True))
            arrays = [pa.array(done), signed(w1), signed(w2), pa.array(uid), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
            return pa.RecordBatch.from_arrays(arrays, ["done", "w1", "w2", "uid", "start", "end"])

        for uids, texts, opened in digest_rows(batches, ["uid", "body", "open"], 64):
            for uid, body, runs in zip(uids, texts, opened, strict=True):
                runs = np.array([(r["start"], r["n"]) for r in runs], np.int64).reshape(-1, 2)
                for begin, tile in plan.tiles(unpack.decompress(body)):
                    mine = runs[(runs[:, 0] >= begin) & (runs[:, 0] < begin + TILE)]
                    if len(mine):
                        ids = Ladder(gram_ids(tile, plan.q), plan.q)
                        starts = np.concatenate([np.arange(s, s + n) - begin for s, n in mine])
                        span = np.full(len(starts), plan.length)
                        held.append((*ids.stretch(starts, span, (0, 0x5BD1E995)), np.full(len(starts), uid), starts + begin))
                    if sum(len(x[0]) for x in held) >= WINDOWS:
                        yield flush()
        if held:
            yield flush()

    return bodies.select("uid", "body", "open").mapInArrow(run, "done boolean, w1 long, w2 long, uid long, start int, end int")


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted windows: the stretches (uid, start, end) of those that are done or not the first of their kind. Holds one
    batch and one row."""
    last = None
    for batch in batches:
        done, w1, w2, *rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        same = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1]) & ~done[:-1]
        first = last is not None and len(w1) > 0 and not done[0] and (w1[0], w2[0]) == last
        again = done | np.concatenate([[first], same])[: len(w1)]
        if len(w1):
            last = (w1[-1], w2[-1]) if not done[-1] else None
        yield pa.RecordBatch.from_arrays([pa.array(x[again].astype(np.int64)) for x in rest], ["uid", "start", "end"])


def removed(docs: DataFrame, plan: Plan) -> DataFrame:
    """(uid, start, end) stretches whose windows all start earlier elsewhere; they may overlap."""
    parts = 4 * width(docs.sparkSession)
    runs = sampled(dealt(docs, plan, parts), parts).mapInArrow(sifted, "uid long, start int, shape int, open boolean")
    runs = stage(runs, "repeat-runs")
    whole = runs.where("not open").select("uid", "start", (F.col("start") + F.floor(F.col("shape") / 1024) + plan.length - 1).alias("end"))
    opened = runs.where("open").groupBy("uid").agg(F.collect_list(F.struct("start", "shape")).alias("open"))
    bodies = stage(packed(docs).join(opened, "uid").select("uid", "body", "open"), "repeat-bodies")
    groups = stage(cores(bodies, plan), "repeat-cores")
    twice = groups.groupBy("core").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("core")
    left = groups.join(twice, "core", "left_semi").groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("open"))
    # All but the first repeat. Windows are sorted and read as a stream, so no group of copies is held in one place.
    single = windows(bodies.drop("open").join(left, "uid"), plan).repartition(parts, "w1").sortWithinPartitions("w1", "w2", "done", "uid", "start")
    again = stage(single.mapInArrow(repeated, "uid long, start long, end long"), "repeat-windows")
    unstage(bodies, groups)
    return whole.unionByName(again)


def drop_repeats(docs: DataFrame, length: int = 100, q: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end in bytes, maximal and in order) and kept (the remaining bytes).

    Texts are UTF-8 bytes. A byte goes if a string of `length` bytes over it also starts earlier: in a document of
    smaller id, or before it in the same one. Strings are compared as they stand in the input and never reach over a
    document's end. Strings are compared by identifiers, not byte by byte: within a bucket of equal q-grams (64 bits)
    stretches by 64 bits, single windows by 128.

    A null or empty text, or a shorter one than `length`, keeps all. Rows that share an id, or have none, rank by text
    (null ids first), so the second of two equal rows is removed whole. An empty table gives an empty result; other
    columns are ignored.
    """
    plan = Plan(length, q)
    rows = with_unique_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "uid")
    spans = removed(rows, plan).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for ids, bodies, spans in digest_rows(batches, ["doc_id", "body", "spans"], 64):
            n, cut, kept = [], [], []
            for body, found in zip(bodies, spans, strict=True):
                data = unpack.decompress(body)
                stretches: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in found or ()):
                    if stretches and start <= stretches[-1][1]:
                        stretches[-1][1] = max(end, stretches[-1][1])
                    else:
                        stretches.append([start, end])
                n.append(len(data))
                cut.append([{"start": s, "end": e} for s, e in stretches])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(e for _, e in stretches)], [*(s for s, _ in stretches), len(data)], strict=True)))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "removed": pa.array(cut, SPANS), "kept": pa.array(kept, pa.binary())})

    bodies = packed(rows).join(spans, "uid", "left").select("doc_id", "body", "spans")
    return bodies.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start long, end long>>, kept binary")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return drop_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", length(F.col("removed")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
