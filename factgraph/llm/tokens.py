"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The model at hand is a BPE model. A sequence of pieces is its encoding exactly if every two neighbours are: merging the
text of the two gives the two. So the encoding is the one path of finite weight through a lattice whose edges weigh 0
between such neighbours and minus infinity between others. A chunk of a giant document is a matrix over the pieces that
can lie across its two ends. Max-plus products are taken in a tree, level by level, so that no task sees more than FAN
matrices; going down the tree again tells which piece lies across each end; then each chunk is traced back on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from factgraph.llm.common import documents, stage, width

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
# Fixed values of the model format.
NORMAL, BYTE, BPE = 1, 6, 2
#: Encodings of words that were met before, up to this many in a worker.
CACHE = 300_000
MINUS = float("-inf")
#: Matrices that one product of the tree takes.
FAN = 64
#: Rows that are encoded at once.
ROWS = 512


def plain_model(path: str) -> bytes:
    """The model without its dummy prefix, which belongs to a document's first chunk alone."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix or model.trainer_spec.model_type != BPE:
        raise ValueError("made for BPE models that do not change their text but for the dummy prefix")
    model.normalizer_spec.add_dummy_prefix = False
    return model.SerializeToString()


@dataclass
class Pieces:
    """A loaded model with what the scan asks of it. Texts are in normal form: SPACE for a space, one in front."""

    model: bytes
    known: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model)
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.longest = max(map(len, self.score))
        #: Neighbouring characters that some piece holds. Between any others no merge can reach.
        self.inner = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        #: No piece has a space behind another character: so merges never cross from a word to the next.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        surface = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.surfaces = pa.array([surface[p.type](p.piece) if p.type in surface else None for p in proto.pieces], pa.binary())
        self.heads = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces])
        self.numbers = {mark: pa.array([f"{i}{mark}" for i in range(len(proto.pieces))], pa.binary()) for mark in ", "}

    def units(self, texts: pa.Array) -> pa.ListArray:
        """Each text's words, with all but one of the spaces before them; spaces at the end are a word. A word of the
        text may hold line ends."""
        spaced = pc.replace_substring(texts, SPACE, " ")
        if not self.by_word:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), spaced)
        cut = pc.split_pattern(spaced, " ")
        odd = np.unique(pc.list_parent_indices(cut).to_numpy()[pc.equal(pc.binary_length(cut.flatten()), 0).to_numpy(zero_copy_only=False)])
        if not len(odd):
            return cut
        several = [re.findall(f"{SPACE}([{SPACE}]*[^{SPACE}]*)", normal(spaced[int(i)].as_py())) for i in odd]
        at = np.arange(len(texts))
        at[odd] = len(texts) + np.arange(len(odd))
        return pa.concat_arrays([cut, pa.array(several, cut.type)]).take(pa.array(at))

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of whole texts. Words that were not met before go to the model in one call; the rest is looked up."""
        units = self.units(texts)
        coded = units.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = {w: self.known[w] for w in words if w in self.known}
        self.known.update(zip(new, (np.array(x, np.int32) for x in self.processor.encode([SPACE + w.replace(" ", SPACE) for w in new])), strict=True) if new else ())
        found = [self.known[w] for w in words]
        for w in new:
            if len(w) >= 64:
                del self.known[w]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat, starts = np.concatenate([np.zeros(0, np.int32), *found]), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[units.offsets.to_numpy() - units.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))

    def encode(self, text: str) -> list[int]:
        """Ids of a text in normal form."""
        return self.encode_all(pa.array([text[1:].replace(SPACE, " ")], pa.string()))[0].as_py() if text else []

    def joined(self, ids: pa.ListArray, table: pa.Array) -> list[memoryview | None]:
        """The entries of a table that each row's ids stand for, one after the other; None where one is missing."""
        taken = table.take(ids.flatten())
        if not len(taken):
            return [memoryview(b"")] * len(ids)
        rows = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        bounds = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)[rows].tolist()
        missing = np.concatenate([[0], np.cumsum(taken.is_null().to_numpy(zero_copy_only=False))])[rows]
        data = memoryview(taken.buffers()[2] or b"")
        return [None if gone else data[a:b] for a, b, gone in zip(bounds, bounds[1:], np.diff(missing).tolist(), strict=False)]

    def decode_all(self, ids: pa.ListArray, library: sentencepiece.SentencePieceProcessor) -> pa.StringArray:
        """The texts of ids that come from whole documents. Where ids are not such, the library says what they mean."""
        out = []
        for i, found in enumerate(self.joined(ids, self.surfaces)):
            try:
                text = str(found[1:], "utf-8") if found and self.heads[ids[i][0].as_py()] else None
            except UnicodeDecodeError:
                text = None
            out.append(library.decode(ids[i].as_py()) if text is None and len(ids[i]) else text or "")
        return pa.array(out, pa.string())

    def cuts(self, text: str, start: int, stop: int) -> Iterator[int]:
        return (i for i in range(max(start, 1), stop) if text[i - 1 : i + 1] not in self.inner)

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored merge first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], MINUS), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def neighbours(self, a: str, b: str) -> bool:
        if a[-1] + b[0] not in self.inner:
            return True
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def across(self, text: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that can hold the character before `at`: start < at <= end."""
        return [(s, e) for s in range(max(0, at - self.longest), at) for e in range(at, min(len(text), s + self.longest) + 1) if e == s + 1 or text[s:e] in self.score]

    def walk(self, text: str, begin: list[tuple[int, int]], stop: int) -> dict[tuple[int, int], set[int]]:
        """Which of the pieces `begin` (by number) lead to each piece that holds the character before `stop`."""
        live: dict[int, dict[tuple[int, int], set[int]]] = {}
        for n, piece in enumerate(begin):
            live.setdefault(piece[1], {}).setdefault(piece, set()).add(n)
        done: dict[tuple[int, int], set[int]] = {}
        at = min(live, default=stop)
        while at < stop:
            for (s, e), origins in live.pop(at, {}).items():
                for stop_at in range(e + 1, min(len(text), e + self.longest) + 1):
                    if (stop_at == e + 1 or text[e:stop_at] in self.score) and self.neighbours(text[s:e], text[e:stop_at]):
                        live.setdefault(stop_at, {}).setdefault((e, stop_at), set()).update(origins)
            at += 1
        for ends in live.values():
            for piece, origins in ends.items():
                if piece[0] < stop <= piece[1]:
                    done.setdefault(piece, set()).update(origins)
        return done

    def transfer(self, text: str, begin: list[tuple[int, int]], end: list[tuple[int, int]], start: int, stop: int) -> np.ndarray:
        """Max-plus matrix of a chunk start..stop: 0 where a path leads from a piece across its start to one across its end."""
        out = np.full((len(begin), len(end)), MINUS)
        first = next(self.cuts(text, start + self.longest, stop - self.longest), None)
        if first is None:
            for piece, origins in self.walk(text, begin, stop).items():
                out[sorted(origins), end.index(piece)] = 0
            return out
        # No merge reaches over a cut: what comes before it says nothing about what comes after.
        last = next(i for i in range(stop - self.longest, first - 1, -1) if text[i - 1 : i + 1] not in self.inner)
        enters = {n for (_, e), origins in self.walk(text, begin, first).items() if e == first for n in origins}
        leaves = self.walk(text, [(last - 1, last)], stop)
        enters |= {n for n, (_, e) in enumerate(begin) if e == first}
        out[np.ix_(sorted(enters), [end.index(p) for p in leaves])] = 0
        return out

    def path(self, text: str, begin: int, end: int, before: tuple[int, int] | None = None, last: tuple[int, int] | None = None) -> list[str]:
        """The pieces from `begin` to `end` of the one path that follows the piece `before` and ends with the piece `last`
        (none: there is a cut): forwards through the lattice, then back along what led to each piece."""
        led: dict[tuple[int, int], tuple[int, int] | None] = {}
        live = {begin: [before]}
        for at in range(begin, end):
            for piece in live.pop(at, ()):
                for stop in range(at + 1, min(end, at + self.longest) + 1):
                    if (at, stop) not in led and (stop == at + 1 or text[at:stop] in self.score) and (piece is None or self.neighbours(text[slice(*piece)], text[at:stop])):
                        led[at, stop] = piece
                        live.setdefault(stop, []).append((at, stop))
        out, piece = [], last or next(iter(live.get(end, [None])))
        while piece is not None and piece != before:
            out.append(text[slice(*piece)])
            piece = led[piece]
        return out[::-1]

    def ids_of(self, pieces: list[str]) -> list[int]:
        return [i for p in pieces for i in ([self.processor.piece_to_id(p)] if p in self.score else self.processor.encode(p))]

    def words_between(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and the last place after `begin` and up to `end` where a word begins: no merge reaches over it."""
        found = WORD_START.search(text, begin, end + 1) if self.by_word else None
        if not found:
            return None
        last = text.rfind(SPACE, begin, end + 1)
        while text[last - 1] == SPACE:
            last -= 1
        return found.end() - 1, last

    def traced(self, rows: list[tuple[str, int, int, tuple[int, int] | None, tuple[int, int]]]) -> pa.ListArray:
        """For each (text, begin, end, before, last) the ids from behind the piece `before`, which ends at `begin`, to the
        piece `last`, which ends at `end`. Up to the first word and from the last one on the path is traced through the
        lattice. From word to word it is the words' own, which are looked up."""
        heads, middles, tails = [], [], []
        for text, begin, end, before, last in rows:
            cut = self.words_between(text, begin, last[0]) if begin < end else None
            if begin >= end:
                heads.append([])
            elif cut:
                heads.append(self.ids_of(self.path(text, begin, cut[0], before)))
            else:
                heads.append(self.ids_of(self.path(text, begin, end, before, last)))
            middles.append(text[cut[0] + 1 : cut[1]].replace(SPACE, " ") if cut else "")
            tails.append(self.ids_of(self.path(text, cut[1], end, None, last)) if cut else [])
        known = self.encode_all(pa.array(middles, pa.string()))
        values, at = known.values.to_numpy(), known.offsets.to_numpy()
        parts = [x for i, (head, tail) in enumerate(zip(heads, tails, strict=True)) for x in (head, values[at[i] : at[i + 1]], tail)]
        sizes = np.array(list(map(len, parts)), np.int64).reshape(-1, 3).sum(axis=1)
        flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in parts)])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))


#: A space behind something else.
WORD_START = re.compile(f"(?<=[^{SPACE}]){SPACE}")


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


#: Makes columns of a batch's texts and ids.
Describe = Callable[[Pieces, pa.StringArray, pa.ListArray], dict[str, pa.Array]]


def encoded(rows: DataFrame, model: bytes, describe: Describe, schema: str) -> DataFrame:
    """(doc_id, text) to doc_id and what `describe` makes, each text in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                doc_id, text = batch.slice(start, ROWS).columns
                yield pa.RecordBatch.from_pydict({"doc_id": doc_id, **describe(pieces, text, pieces.encode_all(pc.fill_null(text, "")))})

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def described(rows: DataFrame, model: bytes, describe: Describe, schema: str) -> DataFrame:
    """The same of (doc_id, text, ids), the ids packed by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                doc_id, text, ids = batch.slice(start, 64).columns
                yield pa.RecordBatch.from_pydict({"doc_id": doc_id, **describe(pieces, text, unpacked(ids))})

    return rows.select("doc_id", "text", "ids").mapInArrow(run, f"doc_id long, {schema}")


def packed(ids: pa.ListArray) -> pa.BinaryArray:
    """Each row's ids compressed for the network, where Spark's own compression gains next to nothing on them."""
    pack = zstandard.ZstdCompressor(3)
    values, at = ids.values.to_numpy().astype("<i4"), ids.offsets.to_numpy()
    return pa.array([pack.compress(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def unpacked(parts: pa.ListArray) -> pa.ListArray:
    """The ids of rows of packed parts, joined."""
    unpack = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(b"".join(unpack.decompress(p) for p in row), "<i4").astype(np.int32) for row in parts.to_pylist()]
    flat, at = np.concatenate([np.zeros(0, np.int32), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, pa.int32()))


def chunks(texts: DataFrame, size: int, halo: int) -> DataFrame:
    """(key, n, piece, start, stop, last): overlapping pieces of the texts in normal form, compressed for the network;
    start..stop is the chunk. Texts of one key are equal, so their pieces are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                form = normal(text)
                starts = range(0, len(form), size)
                for first in range(0, len(starts), 64):
                    rows = []
                    for n, begin in enumerate(starts[first : first + 64], first):
                        low, stop = max(0, begin - halo), min(begin + size, len(form))
                        rows.append({"key": key, "n": n, "piece": pack.compress(form[low : stop + halo].encode()), "start": begin - low, "stop": stop - low, "last": stop == len(form)})
                    yield pa.RecordBatch.from_pylist(rows, CHUNK)

    return texts.select("key", "text").mapInArrow(run, "key string, n int, piece binary, start int, stop int, last boolean")


CHUNK = pa.schema([("key", pa.string()), ("n", pa.int32()), ("piece", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("last", pa.bool_())])


def matrices(rows: DataFrame, model: bytes) -> DataFrame:
    """(key, n, begin, end, m): each chunk's matrix over the pieces across its ends, these as places relative to the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, unpack = Pieces(model), zstandard.ZstdDecompressor()
        relative = lambda ps, at: [x - at for p in ps for x in p]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, start, stop = unpack.decompress(row["piece"]).decode(), row["start"], row["stop"]
                begin = pieces.across(text, start) if start else [(0, 0)]
                end = [p for p in pieces.across(text, stop) if not row["last"] or p[1] == stop]
                if start:
                    m = pieces.transfer(text, begin, end, start, stop)
                else:  # the document's first chunk: nothing lies before its first piece
                    m = np.full((1, len(end)), MINUS)
                    heads = [(0, e) for e in range(1, min(len(text), pieces.longest) + 1) if e == 1 or text[:e] in pieces.score]
                    if stop > 2 * pieces.longest:
                        m[0] = pieces.transfer(text, heads, end, 0, stop).max(axis=0)
                    else:
                        m[0, [end.index(p) for p in pieces.walk(text, heads, stop)]] = 0
                out.append({"key": row["key"], "n": row["n"], "begin": relative(begin, start), "end": relative(end, stop), "m": m.ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("n", pa.int32()), ("begin", pa.list_(pa.int32())), ("end", pa.list_(pa.int32())), ("m", pa.list_(pa.float64()))]))

    return rows.mapInArrow(run, MATRIX)


MATRIX = "key string, n int, begin array<int>, end array<int>, m array<double>"


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def unflat(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.array(m).reshape(len(b) // 2, len(e) // 2) for m, b, e in zip(rows["m"], rows["begin"], rows["end"], strict=True)]


def product(group: pd.DataFrame) -> pd.DataFrame:
    """The product of at most FAN neighbouring matrices of one document."""
    group = group.sort_values("n")
    ms = unflat(group)
    out = ms[0]
    for m in ms[1:]:
        out = plus(out, m)
    first, last = group.iloc[0], group.iloc[-1]
    return pd.DataFrame({"key": [first["key"]], "n": [first["n"] // FAN], "begin": [first["begin"]], "end": [last["end"]], "m": [out.ravel()]})


def parted(group: pd.DataFrame) -> pd.DataFrame:
    """Of at most FAN neighbouring matrices whose outer pieces are known (enters, leaves: their numbers): the pieces between."""
    group = group.sort_values("n")
    ms = unflat(group)
    forward = [ms[0][[group["enters"].iloc[0]]]]
    for m in ms[1:]:
        forward.append(plus(forward[-1], m))
    at = int(group["leaves"].iloc[-1])
    leaves = [at]
    for f, m in zip(reversed(forward[:-1]), reversed(ms[1:]), strict=True):
        at = int(np.argmax(f[0] + m[:, at]))
        leaves.insert(0, at)
    return pd.DataFrame({"key": group["key"], "n": group["n"], "enters": [int(group["enters"].iloc[0]), *leaves[:-1]], "leaves": leaves})


def boundaries(rows: DataFrame) -> DataFrame:
    """(key, n, in_start, in_end, out_start, out_end): the piece across each end of each chunk, relative to that end.

    Products go up a tree of fan FAN, as many levels as the longest document needs; then each level's choice of pieces
    splits among the matrices below it. A task holds FAN matrices of one document at a time.
    """
    above = F.floor(F.col("n") / FAN).cast("int")
    levels = [rows]
    while not levels[-1].where("n > 0").isEmpty():
        levels.append(stage(levels[-1].groupBy("key", above.alias("above")).applyInPandas(product, MATRIX), "token-products"))
    # At the top one matrix for a document: one row (nothing before), of whose columns the best is taken.
    best = F.array_position("m", F.array_max("m")).cast("int") - 1
    chosen = levels[-1].select("key", "n", F.lit(0).alias("enters"), best.alias("leaves"))
    for level in reversed(levels[:-1]):
        outer = chosen.select("key", F.col("n").alias("above"), "enters", "leaves")
        chosen = stage(level.withColumn("above", above).join(outer, ["key", "above"]).groupBy("key", "above").applyInPandas(parted, "key string, n int, enters int, leaves int"), "token-states")
    place = lambda c, i, k: F.element_at(c, (2 * F.col(i) + k).cast("int"))
    return rows.join(chosen, ["key", "n"]).select(
        "key", "n", place("begin", "enters", 1).alias("in_start"), place("begin", "enters", 2).alias("in_end"), place("end", "leaves", 1).alias("out_start"), place("end", "leaves", 2).alias("out_end")
    )


def traced(rows: DataFrame, model: bytes) -> DataFrame:
    """The ids of each chunk, packed: from behind the piece across its start to the end of that across its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, unpack = Pieces(model), zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                start, stop = r["start"], r["stop"]
                before = (start + r["in_start"], start + r["in_end"]) if start else None
                end = stop + r["out_end"]
                out.append((unpack.decompress(r["piece"]).decode(), before[1] if before else 0, end, before, (stop + r["out_start"], end)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(pieces.traced(out))], ["key", "n", "part"])

    return rows.select("key", "n", "piece", "start", "stop", "in_start", "in_end", "out_start", "out_end").mapInArrow(run, "key string, n int, part binary")


def encode_giants(texts: DataFrame, model: bytes, size: int) -> DataFrame:
    """(key, text) to (key, ids), the ids packed by chunk: equal texts have one key."""
    spread = chunks(texts, size, 2 * Pieces(model).longest).repartition(width(texts.sparkSession), "key", "n")
    rows = stage(spread.dropDuplicates(["key", "n"]), "token-chunks")
    states = boundaries(stage(matrices(rows, model), "token-matrices"))
    parts = traced(rows.join(states, ["key", "n"]), model)
    return parts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda p: p["part"]).alias("ids"))


def tokenized(docs: DataFrame, path: str, giant: int, chunk: int, describe: Describe, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and what `describe` makes of each text and its ids; see encode_documents."""
    model = plain_model(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.char_length("text") > giant, F.lit(False))
    small = encoded(rows.where(~long), model, describe, schema)
    giants = rows.where(long).withColumn("key", F.sha2("text", 256))
    if giants.isEmpty():
        return small
    ids = stage(encode_giants(giants, model, chunk), "token-giants")
    return small.unionByName(described(giants.join(ids, "key"), model, describe, schema))


def encode_documents(docs: DataFrame, path: str = MODEL, giant: int = 1 << 14, chunk: int = 1 << 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and `ids`, the model's own encoding of the whole text.

    Texts of up to `giant` characters are encoded where they are. Longer ones are cut into chunks of `chunk`
    characters, which Spark spreads: each gives its matrix, the matrices of a document are combined in a tree, and each
    chunk is traced back on its own. The ids are those that encoding the text as a whole gives. A null or empty text
    has no ids and stays as it is; repeated rows give repeated results; an empty table gives an empty result; other
    columns are ignored.
    """
    return tokenized(docs, path, giant, chunk, lambda _, text, ids: {"text": text, "ids": ids}, "text string, ids array<int>", id_col, text_col)


def decode_documents(tokens: DataFrame, path: str = MODEL, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the text that their ids stand for. Exact for ids of any text without the character U+2581, which
    the model takes for a space. Null or no ids give an empty text. A column named `out` is replaced."""
    with open(path, "rb") as f:
        model = f.read()
    tokens = tokens.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = part.column(part.schema.get_field_index(ids_col)).cast(pa.list_(pa.int32()))
                if ids.null_count:
                    ids = pa.array([x or [] for x in ids.to_pylist()], ids.type)
                yield part.append_column(out, pieces.decode_all(ids, pieces.processor))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{fields}, `{out}` string")


def round_trip(pieces: Pieces, library: sentencepiece.SentencePieceProcessor, text: pa.StringArray, ids: pa.ListArray) -> dict[str, pa.Array]:
    return {"n_tokens": pc.list_value_length(ids).cast(pa.int64()), "round_trip": pc.equal(pieces.decode_all(ids, library), pc.fill_null(text, ""))}


@dataclass
class Library:
    """The library's own model, loaded where it is first used."""

    model: bytes
    processor: sentencepiece.SentencePieceProcessor | None = None

    def __call__(self) -> sentencepiece.SentencePieceProcessor:
        self.processor = self.processor or sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self.processor


def token_table(docs: DataFrame, path: str = MODEL, giant: int = 1 << 14, chunk: int = 1 << 12) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_sha256 (of the ids, comma-joined) and round_trip (decoding gives the text).
    Odd rows as for encode_documents."""
    with open(path, "rb") as f:
        library = Library(f.read())

    def describe(pieces: Pieces, text: pa.StringArray, ids: pa.ListArray) -> dict[str, pa.Array]:
        digests = [hashlib.sha256(b[:-1]).hexdigest() for b in pieces.joined(ids, pieces.numbers[","])]
        return {"n_chars": pc.utf8_length(pc.fill_null(text, "")).cast(pa.int64()), "ids_sha256": pa.array(digests, pa.string()), **round_trip(pieces, library(), text, ids)}

    return tokenized(docs, path, giant, chunk, describe, "n_chars long, ids_sha256 string, n_tokens long, round_trip boolean").select("doc_id", "n_chars", "n_tokens", "ids_sha256", "round_trip")


def token_rows(docs: DataFrame, path: str = MODEL, giant: int = 1 << 14, chunk: int = 1 << 12) -> DataFrame:
    """doc_id, n_tokens, ids (joined by spaces) and round_trip. Odd rows as for encode_documents."""
    with open(path, "rb") as f:
        library = Library(f.read())

    def describe(pieces: Pieces, text: pa.StringArray, ids: pa.ListArray) -> dict[str, pa.Array]:
        joined = [str(b[:-1], "ascii") for b in pieces.joined(ids, pieces.numbers[" "])]
        return {"ids": pa.array(joined, pa.string()), **round_trip(pieces, library(), text, ids)}

    return tokenized(docs, path, giant, chunk, describe, "ids string, n_tokens long, round_trip boolean").select("doc_id", "n_tokens", "ids", "round_trip")


def op9_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(documents(spark, sf_dir))
