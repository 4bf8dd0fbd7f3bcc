"""The back-off model against plain Python, its normalisation, and whether it predicts held-out texts better than words alone."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factgraph.llm import katz
from factgraph.llm.common import documents

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall("[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def trained(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


class Brute:
    def __init__(self, rows):
        self.words, self.pairs, self.before = Counter(), Counter(), Counter()
        for doc_id, text in rows:
            if trained(doc_id):
                ts = tokens(text)
                self.words.update(ts)
                self.pairs.update(zip(["<s>", *ts[:-1]], ts, strict=True))
        self.total = sum(self.words.values())
        self.of_words, self.of_pairs = katz.discounted(Counter(self.words.values())), katz.discounted(Counter(self.pairs.values()))
        self.after = defaultdict(list)
        for (h, w), n in self.pairs.items():
            self.before[h] += n
            self.after[h].append(w)
        self.unknown = 1 - sum(self.worth(n, self.of_words) for n in self.words.values()) / self.total if self.total else 1.0

    @staticmethod
    def worth(n, table):
        return n - table[0] if n > katz.K else table[n] if n else 0.0

    def below(self, w):
        return self.worth(self.words[w], self.of_words) / self.total if self.words[w] else self.unknown

    def weight(self, h):
        seen = sum(self.worth(self.pairs[h, w], self.of_pairs) for w in self.after[h]) / self.before[h]
        return (1 - seen) / (1 - sum(map(self.below, self.after[h])))

    def probability(self, h, w):
        if self.pairs[h, w]:
            return self.worth(self.pairs[h, w], self.of_pairs) / self.before[h]
        return self.below(w) * (self.weight(h) if self.before[h] else 1)

    def row(self, doc_id, text):
        ts = tokens(text)
        base = sum(math.log10((self.words[w] + 1) / (self.total + len(self.words) + 1)) for w in ts)
        score = sum(math.log10(self.probability(h, w)) for h, w in zip(["<s>", *ts[:-1]], ts, strict=True))
        return doc_id, not trained(doc_id), len(ts), sum(self.words[w] > 0 for w in ts), self.total, base, score


def compare(df, rows):
    model = Brute(rows)
    memo = {}
    model.weight = lambda h, weight=model.weight: memo[h] if h in memo else memo.setdefault(h, weight(h))
    order = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    got = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in df.collect()), key=order)
    want = sorted((model.row(*r) for r in rows), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    return model, want


def test_query_equals_plain_python_and_is_normalised(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).select("doc_id", "text").collect()]
    model, want = compare(katz.op12_katz_backoff(spark, SF), rows)
    for h in ["<s>", *[w for w, _ in model.words.most_common(3) if w != "\n"], *list(model.before)[5:9]]:
        assert sum(model.probability(h, w) for w in [*model.words, "<none>"]) == pytest.approx(1, abs=1e-9)
    held = [(w[5], w[6]) for w in want if w[1]]
    assert held and sum(s for _, s in held) > sum(b for b, _ in held)


ODD = [(0, "a b a b c"), (1, None), (2, ""), (3, "A B\x0bA  b"), (3, "A B\x0bA  b"), (None, "a b unseen"), (5, "x " * 30000), (6, "É é\xa0z"), (7, " \t\n"), (8, "b a"), (9, "never met"), (10, "a b c d"), (11, "zz yy zz yy zz yy zz yy zz yy zz yy zz yy")]


def test_odd_rows_and_small_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id bigint, text string, chunk string, n_known int").repartition(4)
    compare(katz.katz_scores(docs), ODD)


def test_many_chunks_and_split_words(spark):
    """One word in front of a third of all others; more partitions than words in many of them."""
    rows = [(i, " ".join(f"hot w{(i * k) % 37} other{(i + k) % 5}" for k in range(20))) for i in range(150)]
    compare(katz.katz_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12)), rows)


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    rows = katz.katz_scores(docs, trained="false").collect()
    assert [(r["train_tokens"], r["n_known"], r["score"]) for r in rows] == [(0, 0, 0.0)] * 2
    assert katz.katz_scores(docs.where(F.lit(False))).count() == 0


def test_discounts():
    assert katz.discounted({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5})[1] == pytest.approx((2 * 40 / 100 - 6 * 5 / 100) / (1 - 6 * 5 / 100))
    assert katz.discounted({}).tolist() == [0.5, 0.5, 1.5, 2.5, 3.5, 4.5]
    assert all(0 < x <= r for r, x in enumerate(katz.discounted({1: 10, 2: 4})[1:], 1))
