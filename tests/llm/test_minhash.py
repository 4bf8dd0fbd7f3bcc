import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import minhash
from factgraph.llm.common import documents
from factgraph.llm.components import connected_components


def brute(rows, k=2, percent=80):
    """component by row for (id, text) rows with distinct ids, over all pairs that share a shingle."""
    sets = {i: minhash.shingle_set(t or "", k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    counts = {}
    for ids in where.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            counts[a, b] = counts.get((a, b), 0) + 1
    for (a, b), both in counts.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    docs = documents(spark, f"/root/testdata/{sf}")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op6_minhash_components(spark, f"/root/testdata/{sf}").collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_and_outlying_hubs(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for group in range(2):
        base = [f"w{group}x{i}" for i in range(120)]
        for _ in range(30):  # a drifting family: neighbours are close, the ends are not
            base[rng.randrange(120)] = f"n{n}"
            base[rng.randrange(120)] = f"m{n}"
            rows.append((n, " ".join(base)))
            n += 1
    rng.shuffle(rows)
    ids = list(range(n))
    rng.shuffle(ids)
    rows = [(ids[i], t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k=2).collect()}
    assert got == brute(rows, 2)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, 100 + i) for i in range(1, 9)] + [(300, 299)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {100 + i: 100 for i in range(1, 9)} | {300: 299}


def test_odd_rows(spark, docs):
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, k=2).collect()), key=str)
    assert len(got) == 9
    want = [(0, 4, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 4, 0, False), (3, 4, 0, False), (None, 1, None, True), (5, 1, 5, True), (7, 1, 7, True)]
    assert [r for r in got if r[0] != 6] == sorted(want, key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.near_duplicates(docs.where("doc_id = 7")).select(F.col("component_id")).first()[0] == 7


def family(n, words, edits, pool, seed):
    """n near copies of one text: `edits` words of each are replaced, from a pool; every tenth is a small change of another."""
    rng = random.Random(seed)
    base, rows = [f"b{i}" for i in range(words)], []
    for i in range(n):
        text = list(rows[rng.randrange(i)].split()) if i and i % 10 == 0 else list(base)
        for _ in range(rng.randrange(1, 4) if i and i % 10 == 0 else rng.randrange(*edits)):
            text[rng.randrange(words)] = f"p{rng.randrange(pool)}"
        rows.append(" ".join(text))
    return rows


def brute_by_matrix(texts, k, percent=80):
    """component by place: all pairs by a product of the incidence matrix."""
    sets = [minhash.shingle_set(t, k) for t in texts]
    place = {x: i for i, x in enumerate(sorted({x for s in sets for x in s}))}
    m = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    component = np.arange(len(sets))
    while True:
        new = np.where(linked, component[None, :], len(sets)).min(axis=1)
        if (new == component).all():
            return component.tolist(), int((linked.sum() - len(sets)) // 2)
        component = new


@pytest.mark.parametrize("n, words, edits, pool", [(2000, 140, (9, 17), 10**6), (600, 140, (9, 17), 40), (400, 60, (2, 14), 8)])
def test_a_large_family_of_near_copies(spark, n, words, edits, pool):
    texts = list(dict.fromkeys(family(n, words, edits, pool, 11)))
    want, links = brute_by_matrix(texts, 2)
    assert len(set(want)) > 20 and links > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=2).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_pairs_made_stay_few(spark, monkeypatch):
    """A family whose members share nothing but their hub's text makes few pairs, though each bucket holds most of them."""
    made = []
    pairs = minhash.crossing_pairs
    monkeypatch.setattr(minhash, "crossing_pairs", lambda *a: made.append(pairs(*a)) or made[-1])
    texts = family(1000, 140, (13, 17), 10**6, 12)
    minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=2).collect()
    assert made and made[0].count() < 20 * len(texts)


def test_components_add_to_known_ones(spark):
    edges = lambda *e: spark.createDataFrame(e, "u long, v long")
    known = connected_components(edges((2, 1), (3, 2), (6, 5)))
    got = {r.node: r.component for r in connected_components(edges((6, 3), (9, 8)), known).collect()}
    assert got == {2: 1, 3: 1, 5: 1, 6: 1, 9: 8}
