import base64
import gzip
import hashlib
import lzma
import re
import time
import zlib
from collections import Counter
from urllib.parse import quote

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from factgraph.llm import pii, secrets
from factgraph.llm.common import documents

SF = "/root/testdata/sf0.01"


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def plain_secrets(text):
    word = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    out = [("assign", *m.span()) for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def held(spark, rows, plain, base):
    texts = {r.doc_id: r.text or "" for r in documents(spark, SF).collect()}
    assert len(rows) == len(texts)
    total = Counter()
    for r in rows:
        want = plain(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        n = Counter(k for k, *_ in want)
        assert all(r[f"n_{k}"] == n[k] for k in base)
        assert set(joined.split(",")) <= set(r.spans.split(","))
        total += n
    assert total


def test_pii_against_regular_expressions(spark):
    held(spark, pii.op2_pii_anchors(spark, SF).collect(), plain_pii, pii.BASE)


def test_secrets_against_regular_expressions(spark):
    held(spark, secrets.op7_secret_layers(spark, SF).collect(), plain_secrets, secrets.BASE)


ANCHORS = pii.automaton()


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a.@-+ 0159%é(x"), max_size=40))
def test_pii_base_spans_hold_on_any_text(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.find(text, ANCHORS) if k < 4] == plain_pii(text)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["password", "ToKen", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "%3D", "é", "\\u0041", "x"]), max_size=14).map("".join))
def test_secret_base_spans_hold_on_any_text(text):
    assert [(secrets.KINDS[k], a, b) for k, a, b in secrets.find(text, 1 << 20) if k < 3] == plain_secrets(text)


def kinds(text):
    return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find(text, ANCHORS)]


def test_pii_the_method_adds():
    assert kinds("see ftp://bob:pw@host/x") == [("login", "bob:pw")]
    assert ("account", "DE89 3704 0044 0532 0130 00") in kinds("IBAN: DE89 3704 0044 0532 0130 00")
    assert "account" not in dict(kinds("iban DE88 3704 0044 0532 0130 00"))
    assert kinds("Account no. 12-345-678") == [("account", "12-345-678")]
    assert kinds("account of the year") == []


def test_account_numbers_end_at_their_boundary():
    accounts = lambda text: [v for k, v in kinds(text) if k == "account"]
    assert accounts("IBAN DE89370400440532013000 2024 10 20") == ["DE89370400440532013000"]
    assert accounts("IBAN DE89 3704 0044 0532 0130 00 2024 12345678 12345678 12345678") == ["DE89 3704 0044 0532 0130 00"]
    assert accounts("account 12345678 " + "23456789 " * 9) == ["12345678 23456789 23456789 23456789"]
    assert accounts("account AB12345 2024 10 20 30") == ["AB12345 2024 10"]
    assert accounts("iban DE88370400440532013000 2025") == []
    for head in ("Account Number: ", "ACCOUNT NO ", "Customer No ", "iBaN code ", "\u0130 Acct Nr. ", "Tax ID #"):
        assert accounts(head + "12345678") == ["12345678"]


def test_cues_and_dots_without_end_take_linear_time():
    began = time.time()
    for text in ("acct1" * 200_000, "account " * 100_000 + "x", "acct 1 " * 100_000, "1.2." * 200_000, "iban " + "1 " * 400_000, "a.@" * 300_000):
        kinds(text)
    assert time.time() - began < 60


def test_redaction_keeps_the_rest():
    text = "mail a.b@c.de or +49 30 1234567 é"
    assert pii.redacted(text, pii.find(text, ANCHORS)) == "mail <EMAIL> or <PHONE> é"


def layers(text):
    return [(secrets.KINDS[k], text[a:b]) for k, a, b in secrets.find(text, 1 << 20)]


def test_nested_layers_are_mapped_back():
    secret = 'password = "hunter2hunter2"'
    b64 = base64.b64encode(zlib.compress(secret.encode())).decode()
    assert layers(f"é x {b64} y") == [("decoded_assign", b64)]
    twice = base64.b64encode(quote(b64, safe="").encode()).decode()
    assert ("decoded_assign", twice) in layers(f"say {twice}!")
    assert layers("q=token%3Dabcdef123 z") == [("decoded_assign", "token%3Dabcdef123")]
    assert layers("\\u0070assword=abcdef9") == [("decoded_assign", "\\u0070assword=abcdef9")]
    assert layers("%2525252541KIA" + "B" * 20) == [("decoded_access", "%2525252541KIA" + "B" * 20)]
    assert layers("nothing %zz here " * 50) == []


def test_each_place_of_an_encoded_secret_is_reported():
    b64 = base64.b64encode(b'password = "hunter2hunter2"').decode()
    text = f"first {b64} then {b64}, and {quote(b64, safe='').replace('a', '%61')}"
    found = [(a, b) for k, a, b in secrets.find(text, 1 << 20) if secrets.KINDS[k] == "decoded_assign"]
    assert found[:2] == [(6, 6 + len(b64)), (12 + len(b64), 12 + 2 * len(b64))]
    assert found[-1][1] == len(text) and len(found) == 3
    assert layers("q=token%3Dabcdef123 q=token%3Dabcdef123") == [("decoded_assign", "token%3Dabcdef123")] * 2


def test_chains_of_escapes_take_linear_time():
    began = time.time()
    for n in (4, 400_000):
        secret = "AKIA" + "B" * 20
        for chain in ("%" + "25" * n + "41KIA", "\\u005c" + "u005c" * n + "u0041KIA", "&" + "#38;" * n + "#65;KIA", "&" + "amp;" * n + "#x41;KIA"):
            text = f"see {chain}{secret[4:]}!"
            assert ("decoded_access", f"{chain}{secret[4:]}") in layers(text)
            assert not [k for k, _ in layers(f"see {chain[: -len('41KIA')]} and") if k.startswith("decoded")]
    assert time.time() - began < 60


def test_streams_end():
    inner = b"x"
    for _ in range(40):
        inner = zlib.compress(inner)
    assert layers(base64.b64encode(inner).decode()) == []
    many = " ".join(base64.b64encode(zlib.compress(bytes([i]) + b" " * 3_000_000)).decode() for i in range(12))
    assert layers(many) == []


def test_more_layers_are_opened():
    secret = b"password=abcdefgh"
    members = base64.b64encode(gzip.compress(b"nothing here") + gzip.compress(secret)).decode()
    assert layers(members) == [("decoded_assign", members)]
    behind = base64.b64encode(secret + b"!").decode()
    assert layers(f"dir/sub/{behind}") == [("decoded_assign", behind)]
    assert layers("password&equals;abcdef9") == [("decoded_assign", "password&equals;abcdef9")]
    assert layers("&nosuchname; password &amp;c") == []
    assert layers("\\ud83d\\ude00 token\\x3dabcdef1") == [("decoded_assign", "token\\x3dabcdef1")]


def test_large_layers_are_read(spark):
    bomb = base64.b64encode(zlib.compress(b"password=abcdefgh " * 2_000_000)).decode()
    assert layers(f"a {bomb}") == [("decoded_assign", bomb)]
    junk = "".join(f"line {i}, of no account\n" for i in range(9000))
    pack = lambda text: base64.b64encode(zlib.compress(text.encode())).decode()
    for text in (f"{junk}password=abcdefgh\n{junk}", f"{junk}{pack(junk + 'password=abcdefgh')}\n{junk}", "password=abcdefgh " * 9000):
        b64 = pack(text)
        docs = spark.createDataFrame([(1, f"é {b64}")], "doc_id long, text string")
        rows = secrets.find_secrets(docs, max_layer_bytes=4096).collect()
        assert [(s.kind, s.start, s.end) for s in rows[0].spans] == [("decoded_assign", 2, 2 + len(b64))]
        assert secrets.find(f"é {b64}", 1 << 24) == secrets.find(f"é {b64}", 4096)
    # Decoders get the dictionary and window that a stream asks for.
    big = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(window_log=28)).compressobj()
    for body in (lzma.compress(b"password=abcdefgh", preset=9), big.compress(b"password=abcdefgh") + big.flush()):
        b64 = base64.b64encode(body).decode()
        assert layers(b64) == [("decoded_assign", b64)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "token", "=", "%3D", "%253D", ":", " ", "\n", '"', "abc123", "zzzz", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "&#61;", ",", "cGFzc3dvcmQ9YWJj", "ZGVmZ2hpamtsbW5v"]), max_size=40).map("".join), st.integers(8, 60))
def test_windows_find_what_the_whole_holds(text, limit):
    data = text.encode()
    source = lambda: (data[i : i + 7] for i in range(0, len(data), 7))
    pieces = list(secrets.windows(source, "utf-8", limit))
    assert "".join(pieces) == text
    assert {k for k, _, _ in secrets.find(text, 1 << 20)} == {k for p in pieces for k, _, _ in secrets.find(p, 1 << 20)}


def test_any_text_in_base64_is_read():
    for text in ("a\u00a0b password=abcdefgh", "\x00\x0c\x1b password=abcdefgh"):
        for coding in ("utf-8", "utf-16", "utf-16-le", "utf-16-be", "utf-32"):
            b64 = base64.b64encode(text.encode(coding)).decode()
            assert layers(b64) == [("decoded_assign", b64)]


def test_wrapped_base64_is_joined():
    b64 = base64.b64encode(b"some words to begin with and password=abcdefghijklmnop and others behind").decode()
    for n in (17, 19, 34, 50):
        for end in ("\n", "\r\n", "\n    ", "\\n"):
            wrapped = end.join(b64[i : i + n] for i in range(0, len(b64), n))
            assert ("decoded_assign", wrapped) in layers(f"-----BEGIN CERTIFICATE-----{end}{wrapped}{end}-----END CERTIFICATE-----")
            assert ("decoded_assign", wrapped) in layers(f"{wrapped}{end}and so on")
    early = f"{b64[:11 + 9]}\n{b64[20:54]}\n{b64[54:88]}\n{b64[88:]}"
    assert ("decoded_assign", early) in layers(f"key: {early}")


def test_scans_handle_odd_rows(docs):
    for rows in (pii.find_pii(docs), secrets.find_secrets(docs)):
        assert rows.count() == 9 and rows.where("size(spans) > 0").count() == 0
    assert pii.find_pii(docs.limit(0)).count() == secrets.find_secrets(docs.limit(0)).count() == 0
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
