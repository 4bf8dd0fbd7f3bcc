"""Media columns: MPEG audio streams that carry bytes, and what their frames say."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import digest_rows, documents

# Fixed values of the MPEG audio format: kbit/s by (version 1?, layer) and index, Hz by version, samples a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF
# Layer II: bits of the allocation of each subband, as (bits, number of subbands), by table.
ALLOCATIONS = {
    "a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19)),
}
# ID3: text encodings, and the fields of a tag at the end as (name, from, to).
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
LAST_TAG = (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97), ("COMM", 97, 125))


@dataclass(frozen=True)
class Header:
    version1: bool
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    bound: int  # subbands from here on share one allocation between the channels

    @property
    def channels(self) -> int:
        return 1 if self.mono else 2

    def protected_bits(self, body: bytes) -> int:
        """How many bits behind the checksum it covers: side information, or allocations (and, in layer II, what says
        which scale factors follow)."""
        if self.layer == 3:
            return 8 * self.side_info
        if self.layer == 1:
            return 4 * (32 if self.mono else 2 * self.bound + 32 - self.bound)
        bits, at, used = int.from_bytes(body[:64], "big"), 0, 0
        band = 0
        for size, n in ALLOCATIONS[self.table]:
            for _ in range(n):
                for _ in range(1 if self.mono or band >= self.bound else 2):
                    given = bits >> (8 * len(body[:64]) - at - size) & (1 << size) - 1 if at + size <= 8 * len(body) else 0
                    used += (given > 0) * (self.channels if band >= self.bound else 1)
                    at += size
                band += 1
        return at + 2 * used

    @property
    def table(self) -> str:
        """Of layer II: which table of allocations holds."""
        each = self.kbps // self.channels
        if not self.version1:
            return "low"
        if each < 56:
            return "d" if self.rate == 32000 else "c"
        return "a" if self.rate == 48000 or each < 96 else "b"

    @property
    def side_info(self) -> int:
        """Bytes of side information of a layer III frame."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version1 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(word: int) -> Header | None:
    """The meaning of a frame header's 32 bits; None if they are none (free-format streams count as none)."""
    version, layer, index, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    v1, padding = version == 3, word >> 9 & 1
    kbps, hertz = BITRATES[v1, layer][index], RATES[version][rate]
    samples = 384 if layer == 1 else 576 if layer == 3 and not v1 else 1152
    length = (12000 * kbps // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + padding
    mode = word >> 6 & 3
    return Header(v1, layer, not word >> 16 & 1, kbps, hertz, mode == 3, length, samples, 4 * (word >> 4 & 3) + 4 if mode == 1 else 32)


@lru_cache(maxsize=4096)
def checksum(data: bytes, bits: int | None = None) -> int:
    """Of the first `bits` of the data, or of all."""
    crc = CRC_START
    for i in range(8 * len(data) if bits is None else min(bits, 8 * len(data))):
        bit = data[i >> 3] >> (7 - (i & 7)) & 1
        crc = (crc << 1 ^ CRC_POLYNOMIAL if (crc >> 15) ^ bit else crc << 1) & 0xFFFF
    return crc


@dataclass
class Stream:
    """What reading a stream gives. offsets: of the audio frames in bytes, to seek by; a Xing frame is not one."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    bodies: list[bytes] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bitrates: set[int] = field(default_factory=set)
    bad_checksums: int = 0
    skipped: int = 0
    declared_frames: int | None = None
    declared_bytes: int | None = None
    toc: bytes = b""
    #: Of a VBRI table: bytes from entry to entry, and the frames that each stands for.
    steps: list[int] = field(default_factory=list)
    entry_frames: int = 0


def synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def text_of(raw: bytes, encoding: int) -> str:
    coding = ENCODINGS[encoding] if encoding < len(ENCODINGS) else "latin-1"
    if coding == "utf-16" and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        coding = "utf-16-le"
    return raw.decode(coding, "replace")


def read_frames(tag: bytes, major: int, flags: int, out: Stream) -> None:
    """The text frames of an ID3v2 tag of version 2.2, 2.3 or 2.4."""
    if flags & 0x80 and major < 4:  # unsynchronised as a whole
        tag = tag.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and major > 2 and len(tag) >= 4:  # an extended header
        at = synchsafe(tag[:4]) if major == 4 else 4 + int.from_bytes(tag[:4], "big")
    name_size, head = (3, 6) if major == 2 else (4, 10)
    while at + head <= len(tag) and tag[at : at + name_size].strip(b"\0"):
        length = tag[at + name_size : at + (6 if major == 2 else 8)]
        size = synchsafe(length) if major == 4 else int.from_bytes(length, "big")
        body = tag[at + head : at + head + size]
        if major == 4 and (flags & 0x80 or tag[at + 9] & 2):
            body = body.replace(b"\xff\x00", b"\xff")
        if major == 4 and tag[at + 9] & 1:  # a length stands in front
            body = body[4:]
        name = tag[at : at + name_size].decode("latin-1")
        if name[0] == "T" and body:
            value = text_of(body[1:], body[0]).rstrip("\0")
            if name in ("TXXX", "TXX") and "\0" in value:
                name, value = value.split("\0", 1)
            out.tags[name] = value.lstrip("\ufeff").replace("\0", "; ")
        at += head + size


def read_tags(data: bytes, out: Stream) -> tuple[int, int]:
    """Parses ID3v2 tags in front and an ID3v1 tag behind; where the audio begins and ends."""
    begin, end = 0, len(data)
    while data[begin : begin + 3] == b"ID3" and len(data) >= begin + 10:
        major, flags = data[begin + 3], data[begin + 5]
        stop = min(end, begin + 10 + synchsafe(data[begin + 6 : begin + 10]))
        read_frames(data[begin + 10 : stop], major, flags, out)
        begin = min(end, stop + 10 * (major == 4 and flags >> 4 & 1))  # a footer
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        last = data[end - 128 : end]
        for name, a, b in LAST_TAG:
            if value := last[a:b].split(b"\0")[0].rstrip(b" ").decode("latin-1"):
                out.tags.setdefault(name, value)
        if not last[125] and last[126]:
            out.tags.setdefault("TRCK", str(last[126]))
        end -= 128
    return begin, end


def read_seek_table(body: bytes, frame: bytes, out: Stream) -> bool:
    """Whether a first frame is a Xing, Info or VBRI table, which is then read. body: what follows the side information."""
    if body[:4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(body[4:8], "big"), 8
        for bit, name in ((1, "declared_frames"), (2, "declared_bytes")):
            if flags & bit:
                setattr(out, name, int.from_bytes(body[p : p + 4], "big"))
                p += 4
        out.toc = body[p : p + 100] if flags & 4 else b""
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:  # always 32 bytes behind the header
        out.declared_bytes, out.declared_frames = (int.from_bytes(frame[i : i + 4], "big") for i in (46, 50))
        entries, scale, size = (int.from_bytes(frame[i : i + 2], "big") for i in (54, 56, 58))
        out.entry_frames = int.from_bytes(frame[60:62], "big")
        out.steps = [scale * int.from_bytes(frame[62 + k * size : 62 + (k + 1) * size], "big") for k in range(entries) if 62 + (k + 1) * size <= len(frame)]
        return True
    return False


def read(data: bytes) -> Stream:
    """Reads a stream: tags, then frame after frame; where no header stands, it moves on byte by byte until two headers
    stand a frame apart (or one ends the stream). A header alone can be chance, two in step are not."""
    out = Stream()
    at, end = read_tags(data, out)
    locked = False
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        if h and at + h.length <= end and not locked:
            after = at + h.length
            follows = header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else None
            if after != end and (not follows or (follows.layer, follows.rate, follows.version1) != (h.layer, h.rate, h.version1)):
                h = None
        if not h or at + h.length > end:
            locked = False
            jump = data.find(b"\xff", at + 1, end)
            jump = end if jump < 0 else jump
            out.skipped, at = out.skipped + jump - at, jump
            continue
        locked, begin = True, at + 4 + 2 * h.protected
        if h.protected:
            bits = h.protected_bits(data[begin : at + h.length])
            covered = data[at + 2 : at + 4] + data[begin : begin + (bits + 7) // 8]
            out.bad_checksums += checksum(covered, 16 + bits) != int.from_bytes(data[at + 4 : at + 6], "big")
        body = data[begin + h.side_info : at + h.length]
        if out.offsets or out.declared_frames is not None or not read_seek_table(body, data[at : at + h.length], out):
            out.offsets.append(at)
            out.bodies.append(body)
            out.samples += h.samples
            out.rate = h.rate
            out.bitrates.add(h.kbps)
        at += h.length
    out.skipped += end - at
    return out


def word(kbps: int, protected: bool) -> int:
    """Header bits of MPEG 1 layer III, 44.1 kHz, stereo."""
    return 0x7FF << 21 | 3 << 19 | 1 << 17 | (not protected) << 16 | BITRATES[True, 3].index(kbps) << 12


#: Frame sizes by rate for the last frame; a frame's body begins with the number of bytes it carries.
SIZES = [(header(word(k, True)).length - 4 - 2 - 32 - 2, k) for k in BITRATES[True, 3][1:]]
FULL, FULL_RATE = SIZES[-1]


@lru_cache(maxsize=64)
def head(kbps: int) -> bytes:
    """Header, checksum and side information of a frame of silence, after which its bytes are free."""
    bits, side = struct.pack(">I", word(kbps, True)), bytes(32)
    return bits + struct.pack(">H", checksum(bits[2:] + side)) + side


def write(payload: bytes) -> bytes:
    """A valid variable-bitrate layer III stream of silence whose frames carry the payload, which must not be empty."""
    frames = []
    for start in range(0, len(payload), FULL):
        part = payload[start : start + FULL]
        room, kbps = next(x for x in SIZES if x[0] >= len(part))
        frames.append(head(kbps) + struct.pack(">H", len(part)) + part + bytes(room - len(part)))
    text = b"\x03payload-bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + bytes((0, 0, 0, len(text))) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + bytes((0, 0, len(frame) >> 7, len(frame) & 127)) + frame
    xing = header(word(128, False)).length
    total = xing + sum(map(len, frames))
    at, offsets = xing, []
    for f in frames:
        offsets.append(at)
        at += len(f)
    toc = bytes(min(255, offsets[k * len(frames) // 100] * 256 // total) for k in range(100))
    info = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    first = struct.pack(">I", word(128, False)) + bytes(32) + info
    return tag + first + bytes(xing - len(first)) + b"".join(frames)


def carried(stream: Stream) -> bytes:
    return b"".join(b[2 : 2 + int.from_bytes(b[:2], "big")] for b in stream.bodies)


def padded(text: bytes, block: int = 64) -> bytes:
    """Bytes 0 up to a positive multiple of the block."""
    return text + bytes(max(block, -(-len(text) // block) * block) - len(text))


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in digest_rows(batches, ["id", "text"]):
        raw = [(t or "").encode() for t in texts]
        yield pa.RecordBatch.from_pydict(
            {"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(list(map(len, raw)), pa.int64()), "media": pa.array([write(padded(b)) for b in raw], pa.binary())}
        )


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8, before padding) and `media`: the text as an MPEG stream. A null text counts as empty."""
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(encode, "id long, n_bytes long, media binary").withColumnRenamed("id", "doc_id")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_samples long, sample_rate long, duration_s double, bad_checksums long, skipped_bytes long, frame_offsets array<long>"


def features(media: bytes | None) -> dict:
    s = read(media or b"")
    payload = carried(s)
    described = {
        "frames": len(s.offsets), "samples": s.samples, "rate": s.rate, "vbr": int(len(s.bitrates) > 1), "kbps": "+".join(map(str, sorted(s.bitrates))),
        "declared": s.declared_frames, "bad": s.bad_checksums, "skipped": s.skipped, "tags": len(s.tags),
        "seek": zlib.crc32(struct.pack(f">{len(s.offsets)}Q", *s.offsets)), "toc": zlib.crc32(s.toc),
    }
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media or b""), "media_sha256": hashlib.sha256(media or b"").hexdigest(), "feature": ";".join(f"{k}={v}" for k, v in described.items()),
        "n_frames": len(s.offsets), "n_samples": s.samples, "sample_rate": s.rate, "duration_s": s.samples / s.rate if s.rate else 0.0,
        "bad_checksums": s.bad_checksums, "skipped_bytes": s.skipped, "frame_offsets": s.offsets,
    }


def media_features(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media_col: str = "media") -> DataFrame:
    """The columns in `keep`, and for each stream: bytes carried, exact samples, duration, checksums and frame offsets.

    Works on any MPEG 1, 2 or 2.5 stream of layers I to III (free format excepted) with ID3 tags of any version: damaged
    parts are skipped and counted, checksums of all layers are verified, Xing, Info and VBRI tables are read. A null or empty stream has no frames, duration 0. Rows are independent; nothing is shuffled.
    """
    kept = [f for f in media.select(*keep).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [features(m) for m in part.column(part.schema.get_field_index(media_col)).to_pylist()]
                out = {k: part.column(part.schema.get_field_index(k)) for k in keep}
                yield pa.RecordBatch.from_pydict(out | {k: pa.array([r[k] for r in rows], t) for k, t in TYPES.items()})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return media.select(*keep, media_col).mapInArrow(run, f"{schema}, {FEATURES}")


ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
TYPES = {name: ARROW[kind] for name, kind in (x.strip().split(" ") for x in FEATURES.split(","))}


def op10_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as MPEG streams, read back. Equal texts give equal streams; repeated rows give repeated results; an empty
    table gives an empty result; other columns are ignored."""
    rows = media_features(text_media(documents(spark, sf_dir)))
    return rows.withColumn("frame_offsets", F.array_join(F.transform("frame_offsets", lambda o: o.cast("string")), ","))
