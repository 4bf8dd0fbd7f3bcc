import hashlib
import random
import struct
import zlib

from factgraph.llm import mpeg
from factgraph.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_round_trip_and_figures():
    rng = random.Random(1)
    for size in (64, 128, 1004 // 64 * 64, 64 * 16, 64 * 40, 64 * 333):
        payload = bytes(rng.choice((255, 251, 224, rng.randrange(256))) for _ in range(size))
        media = mpeg.write(payload)
        s = mpeg.read(media)
        assert mpeg.carried(s) == payload
        assert (s.bad_checksums, s.skipped, s.declared_frames) == (0, 0, len(s.offsets))
        assert s.samples == 1152 * len(s.offsets) and s.rate == 44100 and s.tags == {"payload-bytes": str(size)}
        assert all(media[o : o + 2] == b"\xff\xfa" for o in s.offsets)
        for k in range(100):  # the table points at or before the frame it stands for
            assert s.toc[k] * s.declared_bytes // 256 <= s.offsets[k * len(s.offsets) // 100] - s.offsets[0] + 417


def id3(major, frames, flags=0, extra=b""):
    body = extra + b"".join(frames)
    n = len(body)
    return b"ID3" + bytes((major, 0, flags, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body


def test_tags_of_every_version():
    frame = lambda name, body: name + len(body).to_bytes(4, "big") + b"\0\0" + body
    short = lambda name, body: name + len(body).to_bytes(3, "big") + body
    tags = lambda data: mpeg.read(data + mpeg.write(b"x" * 64)).tags
    assert tags(id3(3, [frame(b"TIT2", b"\x01" + "S\u00f6ng".encode("utf-16")), frame(b"TPE1", b"\x00B\xe9")]))["TIT2"] == "S\u00f6ng"
    assert tags(id3(4, [frame(b"TIT2", b"\x02" + "\u65e5".encode("utf-16-be"))]))["TIT2"] == "\u65e5"
    assert tags(id3(2, [short(b"TT2", b"\x00Old")]))["TT2"] == "Old"
    assert tags(id3(3, [frame(b"TIT2", b"\x00\xff\x01x").replace(b"\xff", b"\xff\x00")], 0x80))["TIT2"] == "\xff\x01x"
    assert tags(id3(3, [frame(b"TIT2", b"\x00After")], 0x40, (6).to_bytes(4, "big") + bytes(6)))["TIT2"] == "After"
    assert tags(id3(4, [frame(b"TIT2", b"\x03After")], 0x40, bytes((0, 0, 0, 6, 1, 0))))["TIT2"] == "After"
    last = b"TAG" + b"Song".ljust(30, b"\0") + b"Who".ljust(30, b" ") + b"What".ljust(30, b"\0") + b"1999" + b"said".ljust(28, b"\0") + b"\0\x07" + b"\x05"
    got = mpeg.read(mpeg.write(b"x" * 64) + last).tags
    assert len(last) == 128 and {k: got[k] for k in ("TIT2", "TPE1", "TALB", "TYER", "COMM", "TRCK")} == {"TIT2": "Song", "TPE1": "Who", "TALB": "What", "TYER": "1999", "COMM": "said", "TRCK": "7"}


def low_layer_frame(layer, kbps, bits, mode=0, extension=0):
    """A protected MPEG 1 frame at 44.1 kHz whose body begins with these bits (a text of 0 and 1) and its right checksum."""
    word = 0x7FF << 21 | 3 << 19 | (4 - layer) << 17 | mpeg.BITRATES[True, layer].index(kbps) << 12 | mode << 6 | extension << 4
    h = mpeg.header(word)
    head = word.to_bytes(4, "big")
    crc = 0xFFFF
    for b in f"{int.from_bytes(head[2:], 'big'):016b}{bits}":
        crc = (crc << 1 ^ 0x8005 if (crc >> 15) ^ int(b) else crc << 1) & 0xFFFF
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    frame = head + crc.to_bytes(2, "big") + body
    return frame + bytes(h.length - len(frame))


def test_checksums_of_the_lower_layers():
    one = low_layer_frame(1, 128, "0101" * 64)
    joint = low_layer_frame(1, 128, "0011" * (2 * 8 + 24), 1, 1)
    mono = low_layer_frame(1, 96, "1001" * 32, 3)
    # 192 kbit/s stereo: table b, 30 subbands; two used allocations in the first subband, so 4 bits follow.
    two = low_layer_frame(2, 192, "00010010" + "0" * (8 * 10 + 6 * 12 + 4 * 7) + "1001")
    shared = low_layer_frame(2, 192, "0" * (8 * 4) + "0001" + "0" * (4 * 6 + 3 * 12 + 2 * 7) + "1001", 1, 0)
    for frame in (one, joint, mono, two, shared):
        s = mpeg.read(frame * 4)
        assert (len(s.offsets), s.bad_checksums, s.skipped) == (4, 0, 0)
        bad = bytearray(frame)
        bad[7] ^= 0x80
        assert mpeg.read(bytes(bad) * 4).bad_checksums == 4


def test_a_vbri_table_is_read():
    frames = mpeg.write(b"y" * 6400)
    s = mpeg.read(frames)
    audio = frames[s.offsets[0] :]
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, len(audio), len(s.offsets), 3, 2, 2, 4) + struct.pack(">HHH", 10, 20, 30)
    first = struct.pack(">I", mpeg.word(128, False)) + bytes(32) + table
    got = mpeg.read(first + bytes(417 - len(first)) + audio)
    assert (got.declared_frames, got.declared_bytes, got.steps, got.entry_frames) == (len(s.offsets), len(audio), [20, 40, 60], 4)
    assert len(got.offsets) == len(s.offsets) and got.offsets[0] == 417 and mpeg.carried(got) == b"y" * 6400


def test_damage_is_found_and_left_behind():
    payload = bytes(range(256)) * 64
    media = mpeg.write(payload)
    clean = mpeg.read(media)
    at = clean.offsets[3]
    broken = mpeg.read(media[:at] + b"junk\xff\xfbjunk" + media[at:])
    assert broken.skipped == 10 and mpeg.carried(broken) == payload
    flipped = bytearray(media)
    flipped[at + 20] ^= 1
    assert mpeg.read(bytes(flipped)).bad_checksums == 1
    gone = bytearray(media)
    gone[at] = 0
    lost = mpeg.read(bytes(gone))
    assert len(lost.offsets) == len(clean.offsets) - 1 and lost.offsets == [o for o in clean.offsets if o != at]
    assert mpeg.read(media + b"TAG" + b"Song".ljust(125, b"\0")).tags["TIT2"] == "Song"
    assert mpeg.read(b"").offsets == [] and mpeg.read(b"\xff" * 50).offsets == []


def test_known_headers():
    h = mpeg.header(0xFFFB9064)  # 128 kbit/s, 44.1 kHz, joint stereo, no checksum
    assert (h.kbps, h.rate, h.length, h.samples, h.layer, h.protected) == (128, 44100, 417, 1152, 3, False)
    assert mpeg.header(0xFFF38064).length == 64 * 72000 // 22050  # version 2, layer III
    assert mpeg.header(0xFFFFFFFF) is None and mpeg.header(0) is None
    assert mpeg.checksum(b"123456789") == 0xAEE7  # this polynomial and start value, as published


def test_query_against_plain_python(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in documents(spark, SF).collect()}
    rows = mpeg.op10_mpeg_media(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        media = mpeg.write(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.bad_checksums == r.skipped_bytes == 0
        assert r.duration_s == r.n_frames * 1152 / 44100


def test_odd_rows(docs):
    rows = mpeg.media_features(mpeg.text_media(docs)).collect()
    assert len(rows) == 9 and {r.payload_bytes for r in rows if r.n_bytes == 0} == {64}
    assert mpeg.media_features(mpeg.text_media(docs.limit(0))).count() == 0
    null = mpeg.text_media(docs).selectExpr("doc_id", "n_bytes", "cast(null as binary) as media")
    assert {r.n_frames for r in mpeg.media_features(null).collect()} == {0}
