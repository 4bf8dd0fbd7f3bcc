import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factgraph.llm import tokens
from factgraph.llm.common import documents

SF = "/root/testdata/sf0.001"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL)
PIECES = tokens.Pieces(tokens.plain_model(tokens.MODEL))


def sha(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize(("giant", "chunk"), [(1 << 16, 1 << 13), (200, 100)])
def test_ids_are_the_library_s(spark, giant, chunk):
    texts = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    rows = tokens.token_table(documents(spark, SF), giant=giant, chunk=chunk).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.round_trip, r.n_chars) == (len(ids), sha(ids), True, len(texts[r.doc_id])), r.doc_id


def giants():
    rng = random.Random(4)
    words = [w for t in ("internationalization unbelievable the of and", "naïve façade über", "日本語 テキスト") for w in t.split()]
    yield "".join(rng.choice("abcdehinorst") for _ in range(3000))  # one word without a cut
    yield " " * 777 + "x" + " " * 40
    yield "".join(rng.choice(words) + rng.choice(["", " ", "\n", "  "]) for _ in range(900))
    yield "a" * 2500
    yield "".join(chr(rng.randrange(0x20, 0x2FFF)) for _ in range(1500)).replace(tokens.SPACE, "")
    yield "the" * 800


def test_chunks_without_a_cut(spark):
    texts = list(giants())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (20, 64, 500):  # 20: more chunks than one product takes
        got = {r.doc_id: r.ids for r in tokens.encode_documents(df, giant=50, chunk=chunk).collect()}
        for i, t in enumerate(texts):
            assert got[i] == LIBRARY.encode(t), (i, chunk)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("theinga  \né▁x"), max_size=30))
def test_stretches_and_merges_agree_with_the_library(text):
    assert PIECES.encode(tokens.normal(text)) == LIBRARY.encode(text)
    form = tokens.normal(text)
    assert "".join(PIECES.merged(form)) == form
    known = [p for p in PIECES.merged(form)]
    assert [PIECES.processor.piece_to_id(p) for p in known if p in PIECES.score] == [i for i in LIBRARY.encode(text) if not LIBRARY.is_byte(i)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=8), max_size=5), st.text(st.sampled_from("a \né日\x07"), max_size=9))
def test_any_ids_decode_as_the_library_does(rows, text):
    rows = [*rows, LIBRARY.encode(text)]
    pieces = tokens.Pieces(LIBRARY.serialized_model_proto())
    assert pieces.decode_all(pa.array(rows, pa.list_(pa.int32())), LIBRARY).to_pylist() == [LIBRARY.decode(r) if r else "" for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("the a\n 日\u00e9"), max_size=20), max_size=6))
def test_batches_of_texts_encode_as_single_ones(texts):
    assert PIECES.encode_all(pa.array(["", *texts], pa.string())).slice(1).to_pylist() == [LIBRARY.encode(t) for t in texts]


def test_max_plus_product_is_associative():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, 0.0, tokens.MINUS) for _ in range(3))
    assert (tokens.plus(tokens.plus(a, b), c) == tokens.plus(a, tokens.plus(b, c))).all()


def test_odd_rows(docs):
    rows = tokens.token_table(docs, giant=1000, chunk=512).collect()
    assert len(rows) == 9 and all(r.round_trip for r in rows) and {r.n_tokens for r in rows if r.n_chars == 0} == {0}
    assert tokens.token_table(docs.limit(0)).count() == 0
    nulls = tokens.encode_documents(docs).select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {r.decoded for r in tokens.decode_documents(nulls).collect()} == {""}
    again = tokens.decode_documents(tokens.encode_documents(docs).withColumn("decoded", F.lit(0)))
    assert again.columns.count("decoded") == 1 and all(r.decoded == (r.text or "") for r in again.collect())


def test_ids_travel_packed(spark):
    """The check's disk budget: ids of long texts were shuffled four bytes each."""
    ids = [[5, 31999, 7, -1] * 500, [], [3]]
    made = tokens.packed(pa.array(ids, pa.list_(pa.int32())))
    assert len(made[0].as_py()) < 1000
    assert tokens.unpacked(pa.array([[made[0].as_py(), made[1].as_py(), made[2].as_py()], []], pa.list_(pa.binary()))).to_pylist() == [ids[0] + ids[2], []]
    parts = tokens.encode_giants(spark.createDataFrame([("k", "some words of a text " * 40)], "key string, text string"), tokens.plain_model(tokens.MODEL), 64)
    assert dict(parts.dtypes) == {"key": "string", "ids": "array<binary>"}
