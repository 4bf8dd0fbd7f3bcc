import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from factgraph.llm import pii, quality, tokens
from factgraph.llm.common import documents
from tests.llm.test_minhash import brute
from tests.llm.test_native import brute_targets

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return df.select("doc_id", "text", "source").collect()


def test_every_stage_against_plain_python(spark, tmp_path):
    docs = documents(spark, SF)
    outs = []
    for k, (_, work) in enumerate(cp.STAGES):
        out = work(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs)
        if k < 4:
            assert docs.columns == documents(spark, SF).columns
    good, single, clean, mixed, ids = (x.collect() for x in outs)
    kept = {r.doc_id for r in quality.op1_importance_resampling(spark, SF).collect() if r.kept}
    assert {r.doc_id for r in good} == kept and len(good) == len(kept)
    want = brute([(r.doc_id, r.text) for r in good], k=5)
    assert sorted(r.doc_id for r in single) == sorted(i for i, (_, _, keep) in want.items() if keep)
    anchors = pii.automaton()
    texts = {r.doc_id: pii.redacted(r.text, pii.find(r.text, anchors)) for r in single}
    assert {r.doc_id: r.text for r in clean} == texts
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        totals[r.source] += size(r.text)
    for r in mixed:
        taken[r.source] += size(r.text)
        assert r.text == texts[r.doc_id] or texts[r.doc_id].split()[: size(r.text)] == r.text.split()
    target = brute_targets(totals)
    assert all(abs(taken[s] - float(target[s])) <= 1 for s in totals)
    library = sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL)
    assert Counter((r.doc_id, r.ids) for r in ids) == Counter((r.doc_id, " ".join(map(str, library.encode(r.text)))) for r in mixed)
    assert all(r.round_trip for r in ids)
    assert ids[0].asDict().keys() == cp.run(spark, SF).limit(1).collect()[0].asDict().keys()


@pytest.mark.parametrize("k", range(5))
def test_stages_handle_odd_rows(spark, docs, tmp_path, k):
    spark.createDataFrame([(0, 1), (7, 0), (None, 1), (3, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = cp.STAGES[k][1](spark, docs, str(tmp_path))
    rows = out.collect()
    assert rows and (k == 4 or out.columns == docs.columns)
    if k == 1:
        assert len(rows) == 7  # of the rows with one text, and of the repeated ones, one stays
    assert cp.STAGES[k][1](spark, docs.limit(0), str(tmp_path)).count() == 0
    nulls = docs.select([F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    cp.STAGES[k][1](spark, nulls, str(tmp_path)).collect()
