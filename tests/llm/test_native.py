import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from factgraph.llm import fingerprints, mixing, sharding
from factgraph.llm.common import documents

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: (r.text or "", r.source) for r in documents(spark, SF).collect()}


def test_fingerprints_against_plain_python(spark):
    docs, ids = texts(spark), None
    ids = sorted(docs)
    rows = {r.doc_id: r for r in fingerprints.op3_merkle_fingerprints(spark, SF).collect()}
    assert sorted(rows) == ids
    for k, i in enumerate(ids):
        text, donor = docs[i][0], docs[ids[(k + 1) % len(ids)]][0]
        n = len(text) // 4
        edited = text[: len(text) - n] + donor[:n]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        paragraph = lambda p: sha("".join(map(sha, re.findall(fingerprints.LEAF, p))))
        root = lambda t: sha("".join(sha("".join(map(paragraph, s.split("\n")))) for s in t.split("\n\n")))
        assert all("".join(re.findall(fingerprints.LEAF, p)) == p for p in text.split("\n"))
        assert (r.fingerprint, r.edited_fingerprint) == (root(text), root(edited))
        assert (r.near_edited == 1) == (text == edited) and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert (r.edited_section == 0) == (text == edited)
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.95 * len(rows)


def test_fingerprints_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = fingerprints.op3_merkle_fingerprints(spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(con.sql(f"select {', '.join(cols)} from ({fingerprints.SQL}) q").fetchall())


def test_fingerprints_handle_odd_rows(spark, docs):
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert len(rows) == 9
    by = defaultdict(set)
    for r in rows:
        by[r.text].add(r.tree.root)
    assert all(len(x) == 1 for x in by.values()) and len(by) == 6
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
    pairs = fingerprints.with_next_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()
    assert len(pairs) == 9
    assert next(p for p in pairs if p.doc_id == 7).next_text == "x"  # the null id comes first
    one = docs.where("doc_id = 0").select("doc_id", "text")
    assert [tuple(r) for r in fingerprints.with_next_text(one).collect()] == [(0, "one two three.\nfour five", "one two three.\nfour five")]
    assert fingerprints.with_next_text(one.limit(0)).count() == 0


def test_an_edit_is_located(spark):
    df = spark.createDataFrame([("a\nb\n\nc\nd\ne", "a\nb\n\nc\nX\ne")], "p string, q string")
    p, q = fingerprints.merkle(F.col("p")), fingerprints.merkle(F.col("q"))
    assert tuple(df.select(fingerprints.first_difference(p, q).alias("d")).first().d) == (2, 2)


def brute_targets(totals, weights=(5, 2, 1)):
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    budget = Fraction(3, 2) * sum(totals.values())
    target, open_ = {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * totals[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: Fraction(2 * totals[s]) for s in over}
        open_ -= over
    return target


def check_mix(rows, docs):
    totals = defaultdict(int)
    for _, text, source in docs:
        totals[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target, taken = brute_targets(totals), defaultdict(int)
    source = {i: s for i, _, s in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == totals[s] and r.target == pytest.approx(float(target[s])) and 0 <= r.taken <= 2 * r.size
        assert r.taken == r.whole * r.size + r.tail
        taken[s] += r.taken
    assert len(rows) == len(docs)
    for s in totals:
        assert abs(taken[s] - float(target[s])) <= 1, s


def test_mix_against_plain_python(spark):
    rows = mixing.op4_source_mix(spark, SF).collect()
    check_mix(rows, [(i, t, s) for i, (t, s) in texts(spark).items()])
    assert sorted(rows) == sorted(mixing.mix_sources(documents(spark, SF).repartition(7)).collect())


def test_mix_handles_odd_rows(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    check_mix(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert [r.target for r in mixing.mix_sources(docs.where("doc_id = 2")).collect()] == [0.0]


def test_feistel_is_a_permutation():
    for n in (0, 1, 2, 3, 5, 17, 100, 1000):
        f = sharding.Feistel(n, 3)
        out = []
        for v in range(n):
            v, steps = f.once(v), 0
            while v >= n:
                v, steps = f.once(v), steps + 1
            assert steps <= f.walks
            out.append(v)
        assert sorted(out) == list(range(n))


def test_shards_against_plain_python(spark):
    docs = texts(spark)
    rows = sharding.op8_feistel_shards(spark, SF).collect()
    f = sharding.Feistel(len(docs), 20)
    for k, (r, i) in enumerate(zip(sorted(rows), sorted(docs), strict=True)):
        text = docs[i][0].encode()
        v = f.once(k)
        while v >= f.n:
            v = f.once(v)
        assert (r.doc_id, r.size, r.text_crc32, r.row_number, r.shard, r.slot) == (i, len(text) + 1, zlib.crc32(text), k, v % 8, v // 8)


def test_shards_handle_odd_rows(spark, docs):
    rows = sharding.feistel_shards(docs, shards=4).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 9 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.feistel_shards(docs.limit(0)).count() == 0
