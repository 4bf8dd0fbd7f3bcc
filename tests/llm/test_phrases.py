"""Collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import chunks, phrases


def brute(rows, longest=5, least=100, percent=100, top=2000):
    found, words_of = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            words_of[lang] += len(words)
            for k in range(1, longest + 1):
                found.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: n for p, n in found.items() if len(p) > 2 and n >= least}
    dropped = set()
    for long, n in candidates.items():
        for k in range(2, len(long) - 1):
            for i in range(1, len(long) - k + 1):
                if 100 * n >= percent * candidates[(long[0], *long[i : i + k])]:
                    dropped.add((long[0], *long[i : i + k]))
    out = defaultdict(list)
    for p, a in candidates.items():
        if p not in dropped:
            cuts = [(1000 * a * words_of[p[0]] // (found[p[:k]] * found[p[:1] + p[k:]]), k, found[p[:k]], found[p[:1] + p[k:]]) for k in range(2, len(p))]
            score, _, left, right = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, n, p.decode(), -a, left, right, words_of[lang], -score) for lang, some in out.items() for n, (score, a, p, left, right) in enumerate(sorted(some)[:top], 1))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    words = ["a", "B", "c", "d", "É", "rare", "\xa0x"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "."]) for _ in range(draw.randint(0, 60))) for _ in range(300)]
    rows = [(t, draw.choice(["en", "de", None])) for t in texts]
    return rows + rows[:5] + [(None, "en"), ("", "en"), (" \t ", None), ("one two three. " * 2000, "fr"), ("z z z z z z z z", "en"), ("a b", "und")]


@pytest.mark.parametrize(("longest", "least", "percent", "top"), [(5, 10, 100, 2000), (3, 4, 60, 15), (2, 1, 100, 50)])
def test_equals_plain_python(spark, corpus, longest, least, percent, top):
    docs = spark.createDataFrame([(*r, 1, "x") for r in corpus], "text string, lang string, rank int, phrase string").repartition(5)
    got = phrases.mine_collocations(docs, longest=longest, least=least, percent=percent, top=top)
    assert rows_of(got) == brute(corpus, longest, least, percent, top)


def test_small_chunks(spark, corpus, monkeypatch):
    """Many chunks and buckets give what one gives."""
    docs = spark.createDataFrame(corpus, "text string, lang string").repartition(23)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert rows_of(phrases.mine_collocations(docs, least=10)) == brute(corpus, least=10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table(spark, corpus):
    docs = spark.createDataFrame(corpus, "text string, lang string")
    assert phrases.mine_collocations(docs.where(F.lit(False))).count() == 0
    assert phrases.mine_collocations(docs.where("text is null")).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    """1000 * a * n of counts near 10^12."""
    rows = spark.sql("select 900000000000L a, 999999999999L n, 900000000001L l, 900000000007L r")
    score = rows.selectExpr("(cast(1000 * cast(a as decimal(19,0)) as decimal(23,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) s").first()["s"]
    assert score == 1000 * 900000000000 * 999999999999 // (900000000001 * 900000000007)


def test_packing():
    draw = np.random.default_rng(1)
    for high in (0, 1, 255, 1 << 20, 1 << 60):
        values = draw.integers(-1, high + 1, 1000)
        assert (chunks.unpack(chunks.pack(values)) == values).all()
        assert (chunks.unpack_sorted(chunks.pack_sorted(np.sort(np.abs(values)))) == np.sort(np.abs(values))).all()
    assert len(chunks.unpack(chunks.pack(np.zeros(0, np.int64)))) == 0
