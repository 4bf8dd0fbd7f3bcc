import math
import struct
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from factgraph.llm import quality
from factgraph.llm.common import documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_the_top_k(spark):
    rows = quality.op1_importance_resampling(spark, SF)
    assert rows.columns == ["doc_id", "n_grams", "log_weight", "gumbel_key", "kept"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null")
    # Only labels of the other fold made the model; the cut saw this fold, so both are held against the labels.
    held = labels.withColumn("fold", F.xxhash64(F.lit(1), "doc_id").bitwiseAND(1)).join(rows, "doc_id").collect()
    for fold in (0, 1):
        good = [r.kept for r in held if r.fold == fold and r.quality == 1]
        bad = [r.kept for r in held if r.fold == fold and r.quality == 0]
        assert sum(good) > 0.98 * len(good) and sum(bad) < 0.05 * len(bad)
    out = rows.collect()
    keys = sorted((r.gumbel_key for r in out), reverse=True)
    k = sum(r.kept for r in out)
    assert len(out) == documents(spark, SF).count() and {r.doc_id for r in out if r.kept} == {r.doc_id for r in out if r.gumbel_key >= keys[k - 1]}
    assert sorted(map(tuple, out)) == sorted(map(tuple, quality.op1_importance_resampling(spark, SF).collect()))


def test_models_against_plain_counting(spark):
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    good = np.array([0, 3, 5], np.int64)
    ratios = quality.gram_models(docs, good, 500)
    raw, target = np.ones(500), np.zeros(500)
    for r in docs.collect():
        tokens = quality.TOKEN.findall(r.text.lower())
        assert len(quality.hashed_grams(r.text, 500)) == max(0, 2 * len(tokens) - 1)
        counts = np.bincount(quality.hashed_grams(r.text, 500), minlength=500)
        raw += counts
        target += counts * (r.doc_id in good)
    raw /= raw.sum()
    assert np.allclose(ratios, np.log((target / raw + 500) / (target.sum() + 500)))
    assert math.isclose(float(np.log((0 + 500) / 500)), 0)


def spark_hash(*values):
    """xxhash64 of Spark over an int, a long and a text."""
    h = 42
    for form, v in zip(("<i", "<q", None), values, strict=True):
        h = xxhash.xxh64_intdigest(struct.pack(form, v) if form else v.encode(), h) if v is not None else h
    return h


def test_the_whole_query_by_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id is not None and r.quality is not None}
    fold = {i: xxhash.xxh64_intdigest(struct.pack("<q", i), xxhash.xxh64_intdigest(struct.pack("<i", 1), 42)) & 1 for i in labels}
    good = {i for i, q in labels.items() if q == 1 and fold[i] == 0}
    counts = {i: Counter(quality.hashed_grams(t, quality.BUCKETS).tolist()) for i, t in docs.items()}
    raw, target = Counter(range(quality.BUCKETS)), Counter()
    for i, c in counts.items():
        raw.update(c)
        target.update(c if i in good else {})
    total, n_target = sum(raw.values()), sum(target.values())
    ratio = [math.log((target[b] / (raw[b] / total) + quality.BUCKETS) / (n_target + quality.BUCKETS)) for b in range(quality.BUCKETS)]
    weight = {i: sum(ratio[b] * n for b, n in c.items()) / (sum(c.values()) + quality.PRIOR) for i, c in counts.items()}
    held = [i for i in labels if fold[i] == 1 and i in docs]
    best = max(
        (sum(weight[i] >= cut - 1e-9 for i in held if labels[i] == 1) / sum(labels[i] == 1 for i in held) + sum(weight[i] < cut - 1e-9 for i in held if labels[i] != 1) / sum(labels[i] != 1 for i in held), -cut)
        for cut in [-1e9, *(weight[i] for i in held)]
    )
    cut = -best[1]
    cut = (cut + max(weight[i] for i in held if labels[i] != 1 and weight[i] < cut - 1e-9)) / 2
    noise = {i: -math.log(-math.log(((spark_hash(1, i, t) >> 11) + 0.5) / 2**53)) for i, t in docs.items()}
    key = {i: weight[i] / quality.TEMPERATURE + noise[i] for i in docs}
    k = sum(w >= cut for w in weight.values())
    kept = set(sorted(key, key=key.get)[len(key) - k :])
    rows = quality.op1_importance_resampling(spark, sf).collect()
    assert {r.doc_id for r in rows if r.kept} == kept and 0 < k < len(docs)
    for r in rows:
        assert r.n_grams == sum(counts[r.doc_id].values()) and math.isclose(r.log_weight, weight[r.doc_id], abs_tol=2e-9) and math.isclose(r.gumbel_key, key[r.doc_id], abs_tol=1e-6)


def test_draws_follow_the_weights(spark):
    """Of two kinds of rows with log weights w and w + 1, the second is drawn e times as often at temperature 1."""
    ratios = np.array([0.0, 1.0])
    words = {quality.hashed_grams(w, 2)[0]: w for w in ("a", "b", "c", "d", "e")}
    repeated = [" ".join([words[b]] * 400) for b in (0, 1)]
    weights = [ratios[quality.hashed_grams(t, 2)].sum() / (799 + quality.PRIOR) for t in repeated]
    df = spark.createDataFrame([(i, repeated[i % 2]) for i in range(8000)], "doc_id long, text string")
    rows = quality.scored(df, ratios, 3, ("n", "w", "k"), temperature=0.5)
    least = quality.kth_largest(rows, "k", 400)
    drawn = Counter(r.doc_id % 2 for r in rows.where(F.col("k") >= least).collect())
    assert drawn.total() == 400
    share = math.exp((weights[1] - weights[0]) / 0.5)
    assert drawn[0] > 0 and 0.6 * share < drawn[1] / drawn[0] < 1.6 * share  # a plain top 400 would hold no even ids
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id bigint, quality int")
    rows, least = quality.resample(df.withColumn("log_weight", F.lit(9)), labels, target_size=123)
    assert rows.where(F.col("gumbel_key") >= least).count() == 123 and rows.columns.count("log_weight") == 1


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=500), np.repeat(0.25, 300), [1e9, -1e9]]).tolist()
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 100, 250, 400, 801, 802):
        assert quality.kth_largest(df, "x", k, bins=16) == ordered[k - 1]
    assert quality.kth_largest(df, "x", 0) is None and quality.kth_largest(df.limit(0), "x", 3) is None


def test_one_weight_for_each_label(spark, monkeypatch):
    texts = ["good words stand here", "bad bad spam", "other good words", "spam spam"] * 5
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(20)], "doc_id bigint, quality int")
    sizes = []
    cut = quality.calibrated_cut
    monkeypatch.setattr(quality, "calibrated_cut", lambda w, q: sizes.append(len(w)) or cut(w, q))
    once = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for docs in (once, once.union(once).union(once)):
        quality.fit(docs, labels, 50, 1, 100)
    assert sizes[0] == sizes[1] <= 20


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1), (7, 0), (None, 1), (5, None), (0, 1), (3, 0), (99, 1)], "doc_id bigint, quality int")
    rows, least = quality.resample(docs, labels, names=("__n", "__w", "__k"))
    assert rows.columns == [*docs.columns, "__n", "__w", "__k"] and rows.count() == 9
    assert least is not None and {r["__w"] for r in rows.collect() if not r.text} == {0.0}
    rows, least = quality.resample(docs, labels.limit(0))
    assert rows.where(F.col("gumbel_key") >= least).count() == 9
    rows, least = quality.resample(docs.limit(0), labels)
    assert rows.count() == 0 and least is None
