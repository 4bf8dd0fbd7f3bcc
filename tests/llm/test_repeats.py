import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from factgraph.llm import repeats
from factgraph.llm.common import documents


def brute(rows, length):
    """{id: (bytes, removed, spans, kept)} by remembering every string, in order of id and start."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            part = hashlib.blake2b(data[s : s + length], digest_size=12).digest()
            if part in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(part)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_every_string(spark, sf):
    want = brute([(r.doc_id, r.text) for r in documents(spark, f"/root/testdata/{sf}").collect()], 100)
    rows = repeats.op5_suffix_repeats(spark, f"/root/testdata/{sf}").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == {
        i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in want.items()
    }
    assert sum(r.n_removed for r in rows) > 0


def test_small_alphabets_periods_and_tiles(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        parts = [rng.choice(["ab" * rng.randrange(1, 40), "a" * rng.randrange(1, 90), "é" * rng.randrange(1, 30), "".join(rng.choice("ab") for _ in range(rng.randrange(1, 60)))]) for _ in range(rng.randrange(0, 9))]
        if rows and rng.random() < 0.6:
            donor = rng.choice(rows)[1]
            at = rng.randrange(len(donor) + 1)
            parts.insert(rng.randrange(len(parts) + 1), donor[at : at + rng.randrange(120)])
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for length, q in ((20, 8), (33, 16)):
        got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in repeats.drop_repeats(df, length, q).collect()}
        assert got == brute(rows, length)


def test_tiles_do_not_change_runs(monkeypatch):
    data = bytes(random.Random(1).choices(b"abc ", k=3000))
    plan = repeats.Plan(40, 12)

    def owners():
        out = []
        for begin, tile in plan.tiles(data):
            first, n, at = plan.runs(repeats.gram_ids(tile, plan.q))
            out += [(int(f + begin + j), int(a + begin)) for f, c, a in zip(first, n, at, strict=True) for j in range(c)]
        return out

    whole = owners()
    monkeypatch.setattr(repeats, "TILE", 64)
    assert owners() == whole and [w for w, _ in whole] == list(range(2961))


def test_a_class_that_is_everywhere_fills_no_group(spark):
    rows = [(i, "-" * 300 + f"{i % 7}{i}" * 9 + " " * (i % 90)) for i in range(64)]
    df = spark.createDataFrame(rows, "uid long, text string").repartition(8)
    alike = df.select("uid", F.lit("-" * 300).alias("text"))  # one bucket
    sent = repeats.dealt(alike, repeats.Plan(), 64)
    assert sent.where("done").select("part").distinct().count() > 1
    bodies = [bytes(r.body) for r in sent.where("not done").collect()]
    assert sum(len(x) for x in repeats.unpacked(bodies)[:1]) <= 2 * 8
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in repeats.drop_repeats(df.withColumnRenamed("uid", "doc_id"), 20, 8).collect()}
    assert got == brute(rows, 20)


def test_rungs_say_what_the_bytes_are():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 4000, np.uint8)
    ladder = repeats.Ladder(repeats.gram_ids(data, 4), 4)
    for span in (4, 7, 8, 9, 15, 16, 20, 33):
        first = np.arange(len(data) - span + 1)
        found = ladder.stretch(first, np.full(len(first), span))[0].tolist()
        texts = [data[i : i + span].tobytes() for i in first]
        assert len(set(found)) == len(set(texts)) == len(set(zip(found, texts, strict=True)))


def test_windows_do_not_depend_on_batches_or_flushes(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["abcabcab", "xyz" * 9, f"{i}", "q" * 30]) for _ in range(12))) for i in range(40)]
    monkeypatch.setattr(repeats, "WINDOWS", 50)  # in the driver only; workers take the usual number
    bodies = [(i, zstandard.compress(t.encode()), [{"start": 0, "n": max(0, len(t) - 19)}]) for i, t in rows]
    batch = pa.RecordBatch.from_pydict({"uid": [b[0] for b in bodies], "body": [b[1] for b in bodies], "open": [b[2] for b in bodies]})

    class Bodies:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return pa.Table.from_batches(list(run(iter([batch]))))

    table = repeats.windows(Bodies(), repeats.Plan(20, 8)).sort_by([(c, "ascending") for c in ("w1", "w2", "done", "uid", "start")])
    want = {i: d for i, (_, _, _, d) in brute(rows, 20).items()}
    for size in (1, 3, 1000):
        gone = {i: bytearray(len(t)) for i, t in rows}
        for b in repeats.repeated(iter(table.to_batches(max_chunksize=size))):
            for uid, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                gone[uid][start:end] = b"\x01" * (end - start)
        assert {i: bytes(b for b, g in zip(t.encode(), gone[i], strict=True) if not g) for i, t in rows} == want


def test_sifting_does_not_depend_on_batches():
    rng = np.random.default_rng(5)
    names = ["done", "h", "k", "uid", "start", "shape"]
    for _ in range(60):
        n = int(rng.integers(1, 30))
        rows = sorted(((bool(rng.random() < 0.2), int(rng.integers(5)), int(rng.integers(3)), i, 0, 1) for i in range(n)), key=lambda r: r[1:])
        table = pa.table({c: pa.array(x, t) for c, x, t in zip(names, zip(*rows), [pa.bool_(), *[pa.int64()] * 3, pa.int32(), pa.int32()])})
        want = [(r[3], False) for r in rows if r[0]]
        live = [r for r in rows if not r[0]]
        for i, r in enumerate(live):
            new = not any(x[1:3] == r[1:3] for x in live[:i])
            several = len({x[2] for x in live if x[1] == r[1]}) > 1
            want += [(r[3], new)] if not new or several else []
        for size in (1, 2, 5, 100):
            out = pa.Table.from_batches(list(repeats.sifted(iter(table.to_batches(max_chunksize=size)))))
            assert sorted(zip(out["uid"].to_pylist(), out["open"].to_pylist())) == sorted(want)


def test_odd_rows(spark, docs):
    rows = sorted(repeats.drop_repeats(docs).collect(), key=str)
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[7].kept == b"solo"
    assert by[5].n_bytes == 60000 and [(s.start, s.end) for s in by[5].removed] == [(2, 60000)]
    assert repeats.drop_repeats(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "x1 y2 " * 5 + "".join(map(str, range(80))))] * 2, "doc_id long, text string")
    assert sorted(len(r.kept) for r in repeats.drop_repeats(twice).collect())[0] == 0
