"""Secret scans by a recursive decoding worklist."""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import digest_rows, documents

#: Kinds in the order of the output; the first three are the base ones, the others are found in decoded layers.
KINDS = ("assign", "access", "hex", "decoded_assign", "decoded_access", "decoded_hex")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
# An escape whose own first character was escaped, any number of times, is one layer: so a chain of them is read once.
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\(?:u005[Cc]|x5[Cc])*(?:u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})"
    r"|&(?:\#38;|\#[xX]26;|amp;)*(?:\#[0-9]{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", re.ASCII
)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
# The further lines of base64 that is wrapped; line ends may be escaped. A line with other words behind is none.
LINE = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*([A-Za-z0-9+/_-]++(?![\x20\t]+\S)={0,2})")
MORE = re.compile(rf"(?:{LINE.pattern.replace('={0,2}', '')})+={{0,2}}")
# Where a text can be cut: no match of the above, and no such match once escapes are decoded, reaches over.
CUT = re.compile(r"""[^A-Za-z0-9+/_.=\-"':\x20%\\&#;\t\r\n]|(?<=[.:"'%\\&#=\n])\n|(?<=[g-zG-Z_./+"'-])\x20(?=[A-Za-z0-9_./+"'-])""")
SEPARATOR, PART = re.compile("[/_-]"), re.compile("[A-Za-z0-9+]{16,}+={0,2}")
#: Bytes that a decoder gives at once.
STEP = 1 << 18


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end): leftmost, non-overlapping for each kind; matches that are too short are dropped."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return spans + [(2, *m.span()) for m in HEX.finditer(text)]


class Layer:
    """A decoded text and, for its stretches, the places in the document that they come from.

    stretches: (start here, start there, end there, decoded). A plain stretch maps character by character, a decoded
    one as a whole.
    """

    def __init__(self, text: str, stretches: list[tuple[int, int, int, bool]]):
        self.text, self.stretches, self.starts = text, stretches, [s[0] for s in stretches]

    def key(self) -> bytes:
        """What it says and where it comes from: equal layers of two places are two."""
        return hashlib.sha256(repr((self.text, self.stretches)).encode()).digest()

    def origin(self, start: int, end: int) -> tuple[int, int, bool]:
        """The document's span behind start:end, and whether any of it was decoded."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (at, there, _, coded), (last_at, last, last_end, last_coded) = self.stretches[i], self.stretches[j]
        first = there if coded else there + start - at
        return first, last_end if last_coded else last + end - last_at, any(s[3] for s in self.stretches[i : j + 1])


def packing(head: bytes) -> str | None:
    """How a stream that begins with these bytes may be compressed."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
        return "zlib"
    return {b"BZh": "bz2", b"\xfd7z": "xz", b"\x28\xb5\x2f": "zstd"}.get(head[:3])


class Chunks:
    """A stream of chunks as a file to read."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.left = chunks, b""

    def read(self, size: int) -> bytes:
        self.left = self.left or next(self.chunks, b"")
        out, self.left = self.left[:size], self.left[size:]
        return out


def inflated(chunks: Iterator[bytes], how: str) -> Iterator[bytes]:
    """The content of a gzip, zlib, bzip2, xz or zstd stream in pieces, as far as it can be read. Decoders take the memory
    that the stream's dictionary or window needs."""
    try:
        if how == "zlib":
            stream = zlib.decompressobj(47)
            for data in chunks:
                while data:
                    if stream.eof:  # a further gzip member
                        if data[:1] != b"\x1f":
                            return
                        stream = zlib.decompressobj(47)
                    yield stream.decompress(data, STEP)
                    data = stream.unconsumed_tail or stream.unused_data
            yield stream.flush()
        elif how == "zstd":
            with zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(Chunks(chunks)) as reader:
                while out := reader.read(STEP):
                    yield out
        else:
            stream = bz2.BZ2Decompressor() if how == "bz2" else lzma.LZMADecompressor()
            for data in chunks:
                yield stream.decompress(data, STEP)
                while not stream.eof and not stream.needs_input:
                    yield stream.decompress(b"", STEP)
                if stream.eof:
                    break
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        return


#: A stream that can be read from its start again.
Source = Callable[[], Iterator[bytes]]


def held(chunks: Iterator[bytes], limit: int) -> bytes | None:
    """All of a stream, None if it exceeds the limit."""
    parts, size = [], 0
    for chunk in chunks:
        parts.append(chunk)
        size += len(chunk)
        if size > limit:
            return None
    return b"".join(parts)


def contents(data: bytes, limit: int) -> Iterator[Source]:
    """The data, what it holds if it is a compressed stream, what that holds, and so on. What exceeds the limit is
    decompressed each time it is read."""
    source: Source = lambda: iter((data,))
    seen = set()
    while True:
        yield source
        head = b""
        for chunk in source():
            head += chunk
            if len(head) >= 3:
                break
        if not (how := packing(head)):
            return
        mark = hashlib.sha256()
        for chunk in source():
            mark.update(chunk)
        if mark.digest() in seen:  # a stream that holds itself
            return
        seen.add(mark.digest())
        whole = held(inflated(source(), how), limit)
        source = partial(lambda outer, how: inflated(outer(), how), source, how) if whole is None else partial(lambda part: iter((part,)), whole)


def codings(source: Source) -> Iterator[str]:
    """The encodings in which a stream is text. A secret is ASCII: in UTF-16 and UTF-32 it takes zero bytes."""
    zero = any(b"\0" in chunk for chunk in source())
    for coding in ("utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be")[: 5 if zero else 1]:
        decoder = codecs.getincrementaldecoder(coding)()
        try:
            for chunk in source():
                decoder.decode(chunk)
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            continue
        yield coding


def windows(source: Source, coding: str, limit: int) -> Iterator[str]:
    """A text in pieces of about `limit` characters, cut only where nothing that is searched for or decoded can reach
    over. Where there is no such place a piece grows until there is one."""
    decoder = codecs.getincrementaldecoder(coding)()
    parts, size, goal = [], 0, limit
    for chunk in source():
        parts.append(decoder.decode(chunk))
        size += len(parts[-1])
        if size >= goal:
            text = "".join(parts)
            cut = 0
            for begin in (max(0, len(text) - 65536), 0):
                for m in CUT.finditer(text, begin):
                    cut = m.end()
                if cut:
                    break
            if cut:
                yield text[:cut]
            parts, size = [text[cut:]], len(text) - cut
            goal = limit if cut and size < limit else 2 * size
    yield "".join([*parts, decoder.decode(b"", True)])


def unpacked(run: str) -> bytes | None:
    """The bytes of a base64 run."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def opens(data: bytes) -> bool:
    """Whether bytes are text or the beginning of a compressed stream."""
    source: Source = lambda: iter((data,))
    how = packing(data)
    return next(codings(source), None) is not None or how is not None and any(inflated(source(), how))


def blocks(sizes: list[int]) -> Iterator[list[tuple[int, int]]]:
    """Of lines with these many base64 characters, those that may be one wrapped run: lines of one length, the line
    before if it is shorter (it began within its line) and the line after if it is shorter (the last)."""
    i = 0
    while i < len(sizes):
        j = i + 1
        while j < len(sizes) and sizes[j] == sizes[i]:
            j += 1
        head = i - (i > 0 and sizes[i - 1] < sizes[i])
        tail = j + (j < len(sizes) and sizes[j] < sizes[i])
        yield [(a, b) for a, b in dict.fromkeys([(head, tail), (head, j), (i, tail), (i, j)]) if b - a > 1]
        i = j


def runs(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of the base64 runs of a text: those within a line, and those that are wrapped over lines, of
    which the longest choice of lines counts that opens."""
    done = 0
    for m in BASE64.finditer(text):
        if data := unpacked(m[0]):
            yield *m.span(), data
        if SEPARATOR.search(m[0]) and not (data and opens(data)):  # what stands between separators, as in a path
            for part in PART.finditer(m[0]):
                if inner := unpacked(part[0]):
                    yield m.start() + part.start(), m.start() + part.end(), inner
        if m.start() < done or m[0][-1] == "=" or not (more := MORE.match(text, m.end())):
            continue
        done = more.end()
        lines = [m.span(), *(k.span(1) for k in LINE.finditer(text, m.end(), done))]
        for choices in blocks([len(text[a:b].rstrip("=")) for a, b in lines]):
            for i, j in choices:
                if (data := unpacked("".join(text[a:b] for a, b in lines[i:j]))) and opens(data):
                    yield lines[i][0], lines[j - 1][1], data
                    break


def variants(text: str) -> Iterator[str]:
    """The text and all that decoding its escapes in place makes of it."""
    work, seen = deque([text]), set()
    while work:
        text = work.popleft()
        key = hashlib.sha256(text.encode(errors="surrogatepass")).digest()
        if key in seen:
            continue
        seen.add(key)
        yield text
        if "%" in text:
            work.append(PERCENT.sub(lambda m: unpercent(m[0]), text))
        if "\\" in text or "&" in text:
            work.append(ESCAPE.sub(lambda m: unescape(m[0]) or m[0], text))


def kinds_within(data: bytes, limit: int) -> set[int]:
    """The places of the kinds found in the bytes of a base64 run and in all layers within. They come from the run as a
    whole, so no more than the kinds is needed, and layers are read as streams."""
    found: set[int] = set()
    seen: set[bytes] = set()

    def scanned(data: bytes) -> Iterator[bytes]:
        for source in contents(data, limit):
            for coding in codings(source):
                for window in windows(source, coding, limit):
                    for text in variants(window):
                        found.update(kind for kind, _, _ in detect(text))
                        yield from (inner for _, _, inner in runs(text))

    stack = [iter((data,))]
    while stack and len(found) < len(BASE):
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        elif (key := hashlib.sha256(inner).digest()) not in seen:
            seen.add(key)
            stack.append(scanned(inner))
    return found


def unpercent(run: str) -> str:
    return unquote_to_bytes(CHAIN.sub("%", run)).decode(errors="replace")


CHAIN = re.compile("%(?:25)+(?=[0-9A-Fa-f]{2})")
LINKS = re.compile(r"^&(?:\#38;|\#[xX]26;|amp;)*(?=[\#A-Za-z])|^\\(?:u005[Cc]|x5[Cc])*(?=[ux])")


def unescape(run: str) -> str:
    """The character behind an escape or a reference; nothing for a name that no character has."""
    run = run[0] + run[LINKS.match(run).end() :]
    if run[0] == "&":
        text = html.unescape(run)
        return "" if text == run else text
    if len(run) == 12:  # a pair of surrogates
        return (bytes.fromhex(run[2:6]) + bytes.fromhex(run[8:12])).decode("utf-16-be")
    return chr(int(run[2:], 16))


def replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all of a pattern's runs decoded."""
    out, stretches, at, size = [], [], 0, 0

    def plain(start: int, end: int) -> None:
        nonlocal size
        while start < end:  # cut at the stretches below, so that each piece maps on its own
            i = bisect_right(layer.starts, start) - 1
            stop = min(end, layer.starts[i + 1]) if i + 1 < len(layer.starts) else end
            first, last, coded = layer.origin(start, stop)
            stretches.append((size, first, last, coded))
            out.append(layer.text[start:stop])
            size, start = size + stop - start, stop

    for m in pattern.finditer(layer.text):
        text = decode(m[0])
        if not text:
            continue
        plain(at, m.start())
        first, last, _ = layer.origin(*m.span())
        stretches.append((size, first, last, True))
        out.append(text)
        at, size = m.end(), size + len(text)
    if not out:
        return None
    plain(at, len(layer.text))
    return Layer("".join(out), stretches)


def find(text: str, limit: int) -> list[tuple[int, int, int]]:
    """All spans of a text and its layers, by start and kind, in code points of the text. Compressed layers over the limit
    are read in windows of about that size."""
    spans = set(detect(text))
    work, seen, within = deque([Layer(text, [(0, 0, len(text), False)])]), set(), {}
    while work:
        layer = work.popleft()
        for start, end, data in runs(layer.text):
            if data not in within:
                within[data] = kinds_within(data, limit)
            first, last, _ = layer.origin(start, end)
            spans.update((kind + len(BASE), first, last) for kind in within[data])
        inner = []
        if "%" in layer.text:
            inner.append(replaced(layer, PERCENT, unpercent))
        if "\\" in layer.text or "&" in layer.text:
            inner.append(replaced(layer, ESCAPE, unescape))
        for new in inner:
            if new and (key := new.key()) not in seen:
                seen.add(key)
                work.append(new)
                for kind, start, end in detect(new.text):
                    first, last, coded = new.origin(start, end)
                    if coded:
                        spans.add((kind + len(BASE), first, last))
    return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer_bytes: int = 1 << 24) -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end) in code points, end exclusive, by start and kind.

    Every text is scanned, then its layers: runs of percent escapes, Unicode escapes and character references are
    decoded in place (an escape that was escaped again and again is one layer), base64 runs, also wrapped ones and those
    between separators, are opened, through compressed streams, and read if they are UTF-8, UTF-16 or UTF-32. Layers
    join a worklist until there is no new one; a layer is not scanned again if one of the same content came from the
    same places of the document. Each decoding shortens its run, so layers end. A finding in a layer is a decoded_ kind
    over the stretch of the document it was encoded in. A compressed layer of more than `max_layer_bytes` is read as a
    stream, in windows of about so many characters that are cut where nothing reaches over; a stretch without such a
    place, and a decoder's dictionary, are held as they are. A null or empty text has no spans; repeated rows give
    repeated results; an empty table gives an empty result; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in digest_rows(batches, ["id", "text"]):
            found = [find(t or "", max_layer_bytes) for t in texts]
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s] for s in found]
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "spans": pa.array(rows, SPANS)})

    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(scan, "id long, spans array<struct<kind string, start long, end long>>").withColumnRenamed("id", "doc_id")


def op7_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    of = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )
