"""Alignment of two tokenizers against plain Python over the libraries' own ids."""

import hashlib
import itertools
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factgraph.llm import alignment
from factgraph.llm.common import documents
from factgraph.llm.tokens import MODEL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(alignment.BYTE_MODEL)
    a.encode_special_tokens = True
    return a, {i: e for e, i in a.get_vocab().items()}, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def tokens(libraries, text):
    a, entries, b = libraries
    alphabet = alignment.byte_alphabet()
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    held = [[bytes(alphabet[c] for c in entries[i]) for i in ids[0]], [piece(i) for i in ids[1]]]
    if not text or any(b"".join(h) != (" " + text).encode() for h in held):
        return None
    return [list(zip(i, [0, *itertools.accumulate(map(len, h))], itertools.accumulate(map(len, h)), strict=False)) for i, h in zip(ids, held, strict=True)]


def overlaps(a, b):
    """The ids of all overlapping tokens, byte by byte."""
    at = lambda side: [n for n, (_, start, end) in enumerate(side) for _ in range(start, end)]
    return [(a[i][0], b[j][0]) for i, j in sorted(set(zip(at(a), at(b), strict=True)))]


def brute(libraries, texts):
    """Rows of all texts: n_a, n_b, n_groups, n_links, n_best, count_sum, digest; and the counts of pairs."""
    found = [tokens(libraries, t or "") for t in texts]
    links = [overlaps(*f) if f else [] for f in found]
    count = Counter(p for ps in links for p in ps)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for f, ps in zip(found, links, strict=True):
        if not f:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for *_, e in f[0]} & {e for *_, e in f[1]})
        number = {e: n for n, e in enumerate(ends)}
        group = [["", ""] for _ in ends]
        for k, side in enumerate(f):
            for i, _, e in side:
                n = next(number[x] for x in range(e, ends[-1] + 1) if x in number)
                group[n][k] += f",{i}" if group[n][k] else str(i)
        groups = ";".join("|".join(g) for g in group)
        rows.append((len(f[0]), len(f[1]), len(ends), len(ps), sum(count[p] == most[p[1]] for p in ps), sum(count[p] for p in ps), hashlib.sha256(groups.encode()).hexdigest()))
    return rows, count, Counter(p for ps in links for p in set(ps))


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_plain_python(spark, libraries):
    docs = documents(spark, SF).collect()
    want = dict(zip([d["doc_id"] for d in docs], brute(libraries, [d["text"] for d in docs])[0], strict=True))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.op11_pair_bitmaps(spark, SF).collect()}
    assert got == want


ODD = [
    None, "", " ", "  ", "x", "a  b", "a \n b", "tail ", "tail  ", " head", "\ttab", "don't 's  't", "café naïve", " x  y", "　 z", "a▁b", "<|endoftext|> </s> <0x41>",
    "\x00 \x1c x", "😀 🏳️‍🌈", "日本 語", "x" * 500, "the the the the the", "the the the the the", "word " * 3000, "a\n\n\nb \n  c", "   ",
]


def test_odd_texts_and_rows(spark, libraries):
    rows = [(None if i == 3 else min(i, 20), t, "x", 1) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, chunk string, n_a int").repartition(3)
    want, links, in_docs = brute(libraries, ODD)
    got, pairs = alignment.align_tokenizers(docs)
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect()) == Counter((i, *w) for (i, *_), w in zip(rows, want, strict=True))
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in pairs.collect()} == {p: (in_docs[p], n) for p, n in links.items()}


def test_small_chunks_and_bitmaps(spark, libraries, monkeypatch):
    """Documents over many chunks, with pairs in nearly all of them (plain bits) and in few (places)."""
    texts = [f"the same words {i % 3} and again the the {'same ' * (i % 5)} word{i}" for i in range(600)]
    want = brute(libraries, texts)[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    rows = alignment.aligned(docs, alignment.BYTE_MODEL, MODEL, "doc_id", "text")
    assert rows.where("dense").count() and rows.where("not dense").count() and rows.where("plane > 1").count()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(docs)[0].collect()}
    assert got == dict(enumerate(want))


def test_empty_table(spark):
    docs = documents(spark, SF).where(F.lit(False))
    got, pairs = alignment.align_tokenizers(docs)
    assert got.count() == 0 and pairs.count() == 0
