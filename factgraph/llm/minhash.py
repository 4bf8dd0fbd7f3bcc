"""Near-duplicate documents by MinHash: banding, verification, connected components."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import digest_rows, documents, stage, unstage
from factgraph.llm.components import connected_components


def words(text: str) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space."""
    return text.encode().lower().split()


def shingle_set(text: str, k: int) -> set[tuple[bytes, ...]]:
    w = words(text)
    if not w:
        return set()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)}


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; one for the whole text if it has fewer than k words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words(text)), np.uint64)
    if not len(h):
        return h
    k = min(k, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - k + 1 + i]
    return np.unique(out ^ (out >> np.uint64(32)))


@dataclass(frozen=True)
class MinHash:
    """`bands` bands of `rows` minima each. At a similarity of 0.8 two texts share no band with a probability of
    (1 - 0.8 ** rows) ** bands: 5e-9 for 5 and 48. The hashes are a * x + b modulo 2 ** 64, upper half."""

    bands: int = 48
    rows: int = 5
    seed: int = 6

    @cached_property
    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = random.Random(self.seed)
        n = self.bands * self.rows
        a, b = ([rng.getrandbits(64) for _ in range(n)] for _ in range(2))
        return np.array([x | 1 for x in a], np.uint64), np.array(b, np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.factors
        least = np.full(len(a), 0xFFFFFFFF, np.uint64)
        for start in range(0, len(hashes), 2048):
            part = hashes[None, start : start + 2048] * a[:, None] + b[:, None]
            np.minimum(least, (part >> np.uint64(32)).min(axis=1), out=least)
        return least

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        parts = signature.reshape(self.bands, self.rows)
        keys = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(self.rows):
            keys = (keys ^ parts[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
            keys ^= keys >> np.uint64(32)
        return keys.view(np.int64)

    def least_matches(self, threshold: float) -> int:
        """Matching minima below which a pair is not looked at: six deviations under what the threshold makes expect."""
        n = self.bands * self.rows
        return math.floor(n * threshold - 6 * math.sqrt(n * threshold * (1 - threshold)))


def features(docs: DataFrame, k: int, mh: MinHash) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the words), bands (their keys), low bytes of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in digest_rows(batches, ["id", "text"]):
            n, keys, bands, low = [], [], [], []
            for text in texts:
                found = shingle_hashes(text or "", k)
                n.append(len(found))
                signature = mh.signature(found) if len(found) else None
                keys.append(hashlib.blake2b(b" ".join(words(text)), digest_size=16).digest() if len(found) else None)
                bands.append(mh.band_keys(signature) if len(found) else None)
                low.append(signature.astype(np.uint8).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(n, pa.int64()), "set_key": pa.array(keys, pa.binary()),
                "bands": pa.array(bands, pa.list_(pa.int64())), "low": pa.array(low, pa.binary()),
            })

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, low binary")


def packed(docs: DataFrame) -> DataFrame:
    """The texts, compressed: they cross the network to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for ids, texts in digest_rows(batches, ["id", "text"]):
            yield pa.RecordBatch.from_pydict({"node": pa.array(ids, pa.int64()), "body": pa.array([pack.compress((t or "").encode()) for t in texts], pa.binary())})

    return docs.mapInArrow(run, "node long, body binary")


def confirmed(pairs: DataFrame, nodes: DataFrame, k: int, mh: MinHash, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: first by signature, then on the full sets. nodes: (node, low, body)."""
    least = mh.least_matches(percent / 100)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, x, y in digest_rows(batches, ["a", "b", "x", "y"], 4096):
            n = [np.count_nonzero(np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8)) >= least for p, q in zip(x, y, strict=True)]
            keep = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in keep], pa.int64()), "b": pa.array([b[i] for i in keep], pa.int64())})

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for a, b, x, y in digest_rows(batches, ["a", "b", "x", "y"], 64):
            keep, sets = [], {}
            for i, bodies in enumerate(zip(x, y, strict=True)):
                for body in bodies:
                    if body not in sets:
                        sets[body] = shingle_set(unpack.decompress(body).decode(), k)
                p, q = (sets[body] for body in bodies)
                both = len(p & q)
                if both and 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_pydict({"u": pa.array([a[i] for i in keep], pa.int64()), "v": pa.array([b[i] for i in keep], pa.int64())})

    def with_both(table: DataFrame, column: str) -> DataFrame:
        x = nodes.select(F.col("node").alias("a"), F.col(column).alias("x"))
        y = nodes.select(F.col("node").alias("b"), F.col(column).alias("y"))
        return table.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    close = stage(with_both(pairs, "low").mapInArrow(likely, "a long, b long"), "near-likely")
    return stage(with_both(close, "body").mapInArrow(linked, "u long, v long"), "near-links")


def labelled(members: DataFrame, components: DataFrame | None) -> DataFrame:
    """members (key, node) with the component of each node."""
    if components is None:
        return members.withColumn("component", F.col("node"))
    joined = members.join(components, "node", "left")
    return joined.select("key", "node", F.coalesce("component", "node").alias("component"))


def open_buckets(members: DataFrame, components: DataFrame | None) -> DataFrame:
    """(key, node, component) of the buckets that hold several components: all others have nothing left to link."""
    rows = labelled(members, components)
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    return stage(rows.join(mixed.select("key"), "key", "left_semi"), "near-open")


def star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket against the bucket's hub, which another turn chooses anew. One row for a member at most."""
    choice = F.struct(F.lit(0) if turn == 0 else F.xxhash64(F.lit(turn), "node"), "node", "component")
    hubs = rows.groupBy("key").agg(F.min(choice).alias("hub")).select("key", "hub.node", "hub.component").toDF("key", "hub", "hub_component")
    pairs = rows.join(hubs, "key").where("component != hub_component")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def unshared(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, n, u): of the nodes in open buckets, how many shingles they have, and how many that no other of these nodes
    has. A partner must be one of these nodes, so two sets share at most n - u shingles, and miss at least each other's u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for ids, bodies in digest_rows(batches, ["node", "body"], 64):
            found = [shingle_hashes(unpack.decompress(b).decode(), k) for b in bodies]
            h = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h), "node": pa.array(np.repeat(np.array(ids, np.int64), [len(f) for f in found]))})

    part = nodes.select("node", "body").join(rows.select("node").distinct(), "node", "left_semi")
    shingles = part.mapInArrow(run, "h long, node long")
    once = shingles.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("hi")).where("node = hi").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    sizes = shingles.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return stage(sizes.join(once, "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u")), "near-unshared")


def linkable(rows: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """The rows with n and u, without nodes that can be linked with nothing, in buckets that hold several components."""
    able = rows.join(counts.where(F.lit(100) * (F.col("n") - F.col("u")) >= F.lit(percent) * F.col("n")), "node")
    mixed = able.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    return stage(able.join(mixed.select("key"), "key", "left_semi"), "near-linkable")


def clean_star_pairs(rows: DataFrame) -> DataFrame:
    """Each member of a bucket against the one with the fewest shingles of its own."""
    hubs = rows.groupBy("key").agg(F.min(F.struct("u", "node", "component")).alias("hub")).select("key", "hub.node", "hub.component").toDF("key", "hub", "hub_component")
    pairs = rows.join(hubs, "key").where("component != hub_component")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def differences(members: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """members (hub, node, component) with what tells each from its hub: `shared_hub` (|H|), `weight` (100 for each of the
    hub's shingles that it misses, `percent` for each that it has besides), `own_bound` and `marks` (the hashes of those
    shingles, missing ones inverted).

    For two members a and b of one hub, 100 |A & B| >= percent |A | B| is the same as
    weight a + weight b <= (100 - percent) |H| + (100 + percent) (marks that a and b share).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for hubs, ids, components, x, y in digest_rows(batches, ["hub", "node", "component", "x", "y"], 64):
            sets = {body: shingle_hashes(unpack.decompress(body).decode(), k).view(np.int64) for body in {*x, *y}}
            size, weight, bound, marks = [], [], [], []
            for hub, own in zip((sets[body] for body in x), (sets[body] for body in y), strict=True):
                missing, extra = np.setdiff1d(hub, own, assume_unique=True), np.setdiff1d(own, hub, assume_unique=True)
                size.append(len(hub))
                weight.append(100 * len(missing) + percent * len(extra))
                # A partner shares percent / 100 of this set at least.
                bound.append(-(-percent * len(own) // 100) - len(hub) + len(missing))
                marks.append(np.concatenate([~missing, extra]))
            n = pa.int64()
            yield pa.RecordBatch.from_pydict({
                "hub": pa.array(hubs, n), "node": pa.array(ids, n), "component": pa.array(components, n), "shared_hub": pa.array(size, n),
                "weight": pa.array(weight, n), "own_bound": pa.array(bound, n), "marks": pa.array(marks, pa.list_(n)),
            })

    x = nodes.select(F.col("node").alias("hub"), F.col("body").alias("x"))
    y = nodes.select("node", F.col("body").alias("y"))
    both = members.join(y, "node").join(x, "hub").select("hub", "node", "component", "x", "y")
    return both.mapInArrow(run, "hub long, node long, component long, shared_hub long, weight long, own_bound long, marks array<long>")


def with_need(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of differences with `far` (not linked with the hub) and `need`: how many marks a row shares at least with
    any partner that it may be linked with. One of two partners is far: two that are linked with the hub are joined
    already. Rows that have fewer marks go, as do hubs without far members."""
    far = F.col("weight") > (100 - percent) * F.col("shared_hub")
    least = rows.groupBy("hub").agg(F.min("weight").alias("any_weight"), F.min(F.when(far, F.col("weight"))).alias("far_weight")).where("far_weight is not null")
    partner = F.when(far, F.col("any_weight")).otherwise(F.col("far_weight"))
    spare = F.col("weight") + partner - (100 - percent) * F.col("shared_hub")
    need = F.greatest(F.ceil(spare / (100 + percent)), F.col("own_bound"), F.lit(1)).cast("int")
    out = rows.join(least, "hub").withColumn("far", far).withColumn("need", need)
    return out.drop("any_weight", "far_weight").where(F.size("marks") >= F.col("need"))


def common_marks(rows: DataFrame) -> DataFrame:
    """The rows with the marks alone that another row of their hub has too, the rarest first."""
    single = rows.select("hub", "node", F.explode("marks").alias("mark"))
    often = single.groupBy("hub", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = single.join(often, ["hub", "mark"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("n", "mark")))["mark"].alias("marks"))
    return rows.drop("marks").join(kept, ["hub", "node"])


def crossing_pairs(rows: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of different components that may be linked, of the members that have one hub.

    They are found by an overlap join on what tells the members from their hub: of two rows that share t marks, the
    first (number of marks - t + 1) of either, rarest first, have one in common, and from there on either has t left.
    What all members have from their hub is never joined on, and no pair within the bounds is left out.
    """
    hubs = rows.groupBy("key").agg(F.min(F.struct("u", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    members = rows.join(hubs, "key").where("node != hub").select("hub", "node", "component").distinct()
    open_rows = stage(differences(members, nodes, k, percent), "near-differences")
    for name in ("near-marks", "near-marks-again"):  # what is rare after the first round leaves further rows too few marks
        open_rows = stage(common_marks(with_need(open_rows, percent).drop("far", "need")), name)
    left = with_need(open_rows, percent).withColumn("size", F.size("marks"))
    first = left.select("hub", "node", "component", "shared_hub", "weight", "far", "size", F.posexplode(F.slice("marks", F.lit(1), F.col("size") - F.col("need") + 1)).alias("at", "mark"))
    first = stage(first.withColumn("rest", F.col("size") - F.col("at")).drop("size", "at"), "near-first-marks")
    a = first.select("hub", "mark", "shared_hub", *[F.col(c).alias(f"{c}_a") for c in ("node", "component", "weight", "far", "rest")])
    b = first.where("far").select("hub", "mark", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "weight", "rest")])
    fits = f"weight_a + weight_b <= {100 - percent} * shared_hub + {100 + percent} * least(rest_a, rest_b)"
    pairs = a.join(b, ["hub", "mark"]).where(f"component_a != component_b and (node_a < node_b or not far_a) and {fits}")
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, mh: MinHash | None = None, star_turns: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Rows with equal words fold into their least id first. The others meet in buckets of equal band keys. In
    `star_turns` rounds the members of each bucket are held against a hub of it; a bucket whose members are all in one
    component is done. For the others the shingles that a node has for itself alone are counted: they bound what it can
    share. A further round takes the member with the fewest as hub. Pairs that then still cross components are found by
    an overlap join on what tells them from their hub (crossing_pairs), so no link is lost that any bucket holds, and
    pairs that have no more in common than their hub's text are not made. Links are confirmed on the full sets.
    component_id is the least id that links reach; kept marks that row.

    A null or empty text, or one without words, has no shingles and is linked with nothing. A text with fewer than k
    words is one shingle. Repeated rows share their result. Rows that share an id are one node of the graph. A row
    without an id is its own component (null) unless its set has an id elsewhere. An empty table gives an empty
    result; other columns are ignored.
    """
    mh = mh or MinHash()
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = stage(features(pairs, k, mh), "near-features")
    sets = stage(found.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "near-sets")
    reps = found.join(sets, "set_key").where("doc_id = rep").select("rep", F.explode("bands").alias("key"))
    bands = stage(reps.select("key", F.col("rep").alias("node")), "near-bands")
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    members = stage(bands.join(shared, "key", "left_semi"), "near-members")
    unstage(bands)
    wanted = stage(members.select("node").distinct(), "near-wanted")
    low = found.select(F.col("doc_id").alias("node"), "low").where("low is not null").join(wanted, "node", "left_semi")
    bodies = packed(pairs).join(wanted, "node", "left_semi")
    nodes = stage(bodies.join(low, "node"), "near-nodes")
    components = counts = None
    for turn in range(star_turns + 2):
        rows = open_buckets(members, components)
        unstage(members)
        members = rows.select("key", "node")  # a bucket that is closed stays so
        if turn >= star_turns and not rows.isEmpty():
            counts = unshared(rows, nodes, k) if counts is None else counts
            rows = linkable(rows, counts, percent)
        if rows.isEmpty():
            break
        wanted = star_pairs(rows, turn) if turn < star_turns else clean_star_pairs(rows) if turn == star_turns else crossing_pairs(rows, nodes, k, percent)
        components = connected_components(confirmed(stage(wanted, "near-pairs"), nodes, k, mh, percent), components)
    owned = found.select("doc_id", "n_shingles", "set_key").join(sets, "set_key", "left")
    owned = owned.withColumn("node", F.coalesce("rep", "doc_id"))
    if components is not None:
        owned = owned.join(components, "node", "left")
    else:
        owned = owned.withColumn("component", F.lit(None).cast("long"))
    own = F.coalesce("component", "node")
    return owned.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def op6_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=2)
