"""Media columns: MPEG audio streams that carry a payload, and a reader of such streams."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm._common import free_name, raw_texts

# Fixed values of the MPEG audio format: kbit/s by bitrate index for (MPEG-1 or not, layer), and rates by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Bits of an allocation in layer II, subband by subband, as (bits, subbands): at most 48 kbit/s a channel at 44.1 and
# 48 kHz, the same at 32 kHz, at most 80 kbit/s a channel or 48 kHz, more, and not MPEG-1.
ALLOCATION = {
    "low": ((4, 2), (3, 6)),
    "low32": ((4, 2), (3, 10)),
    "middle": ((4, 11), (3, 12), (2, 4)),
    "high": ((4, 11), (3, 12), (2, 7)),
    "lsf": ((4, 4), (3, 7), (2, 19)),
}

#: What the writer makes: MPEG-1 layer III, mono, 48 kHz, with checksums. 17 bytes of zero side information say that
#: both granules are silent, so the rest of a frame is ancillary data, and holds the payload.
SIDE, HEAD = 17, 4 + 2 + 17
OWNER = b"edgeloom/payload\0"


@dataclass(frozen=True)
class Frame:
    """What a frame's four header bytes say."""

    size: int
    samples: int
    rate: int
    kbps: int
    side: int
    protected: bool
    layer: int
    mpeg1: bool
    channels: int
    bound: int


@lru_cache(maxsize=4096)
def frame_header(head: bytes) -> Frame | None:
    """The frame that begins with these four bytes, or None if they are no header of a frame of known size."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    index, rate_index, pad = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3:
        return None
    first = version == 3
    kbps, rate = BITRATES[first, layer][index], RATES[version][rate_index]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples * 125 * kbps // rate + pad
    mono, joint = head[3] >> 6 == 3, head[3] >> 6 == 1
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return Frame(size, samples, rate, kbps, side if layer == 3 else 0, not head[1] & 1, layer, first, 1 if mono else 2, 4 * (1 + (head[3] >> 4 & 3)) if joint else 32)


@lru_cache(maxsize=65536)
def crc16(covered: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, begun at 0xFFFF, highest bit first."""
    crc = 0xFFFF
    for byte in covered:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(value: int, bits: int) -> int:
    """crc16 of the lowest `bits` bits of a number, the highest of them first."""
    crc = 0xFFFF
    for i in range(bits - 1, -1, -1):
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ value >> i) & 1 else 0)) & 0xFFFF
    return crc


def covered_bits(frame: Frame, data: bytes, at: int) -> int:
    """How many bits behind the checksum of the layer I or II frame at `at` it covers: the allocations, and in layer II
    which scale factors follow."""
    if frame.layer == 1:
        widths = [4] * 32
    else:
        low, most = frame.kbps / frame.channels <= 48, frame.kbps / frame.channels > 80 and frame.rate != 48000
        table = "lsf" if not frame.mpeg1 else ("low32" if frame.rate == 32000 else "low") if low else "high" if most else "middle"
        widths = [bits for bits, n in ALLOCATION[table] for _ in range(n)]
    shared = [k >= frame.bound for k in range(len(widths))]
    allocations = sum(w * (1 if alike else frame.channels) for w, alike in zip(widths, shared, strict=True))
    if frame.layer == 1:
        return allocations
    value = int.from_bytes(data[at + 6 : at + 6 + 32], "big")
    cursor, factors = 256, 0
    for w, alike in zip(widths, shared, strict=True):
        for _ in range(1 if alike else frame.channels):
            cursor -= w
            if value >> cursor & (1 << w) - 1:
                factors += 2 * (frame.channels if alike else 1)
    return allocations + factors


def checksum_fits(frame: Frame, data: bytes, at: int) -> bool:
    """Whether a protected frame's checksum is that of its header and what it covers; False if the frame is too short."""
    written = data[at + 4] << 8 | data[at + 5]
    if frame.layer == 3:
        return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + frame.side]) == written
    bits = covered_bits(frame, data, at)
    end = 6 + (bits + 7) // 8
    if end > frame.size:
        return False
    value = int.from_bytes(data[at + 2 : at + 4] + data[at + 6 : at + end], "big") >> -bits % 8
    return crc16_bits(value, 16 + bits) == written


@lru_cache(maxsize=16)
def _head(index: int, protected: bool = True) -> bytes:
    header = bytes([0xFF, 0xFA if protected else 0xFB, index << 4 | 1 << 2, 0xC0])
    return header + crc16(header[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE) if protected else header


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


#: Frame sizes of the writer by bitrate index.
SIZES = {i: 3 * k for i, k in enumerate(BITRATES[True, 3]) if k}


def write_stream(payload: bytes) -> bytes:
    """An MPEG audio stream that holds the payload byte for byte.

    An ID3v2 tag with a private frame says how long the payload is, a Xing frame has the number of frames, the bytes
    and the seek table, and frames of the highest bitrate carry the payload; the last one has the bitrate that fits.
    """
    room = SIZES[14] - HEAD
    full = len(payload) // room
    frames = np.zeros((full, SIZES[14]), np.uint8)
    frames[:, :HEAD] = np.frombuffer(_head(14), np.uint8)
    frames[:, HEAD:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    audio, rest, sizes = frames.tobytes(), payload[full * room :], full
    if rest:
        index = next(i for i, s in SIZES.items() if s - HEAD >= len(rest))
        audio += _head(index) + rest + bytes(SIZES[index] - HEAD - len(rest))
        sizes += 1
    private = OWNER + len(payload).to_bytes(8, "big")
    tag = b"PRIV" + len(private).to_bytes(4, "big") + bytes(2) + private
    info_size = SIZES[3]
    total = info_size + len(audio)
    seek = bytes(min(255, 256 * (info_size + SIZES[14] * (i * sizes // 100)) // total) for i in range(100))
    info = _head(3, protected=False) + bytes(SIDE) + b"Xing" + (7).to_bytes(4, "big") + sizes.to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    return b"ID3\x03\0\0" + _synchsafe(len(tag)) + tag + info.ljust(info_size, b"\0") + audio


@dataclass
class Stream:
    """What read_stream finds. offsets: where frames begin, the info frame not counted."""

    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    kbps: set[int] = field(default_factory=set)
    bad_checksums: int = 0
    skipped: int = 0
    bytes: int = 0
    table: dict = field(default_factory=dict)
    private: dict = field(default_factory=dict)
    payload: bytes = b""

    @property
    def seconds(self) -> Fraction:
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)

    @property
    def table_agrees(self) -> bool | None:
        """Whether the stream's table names as many frames and bytes as were found; None without a table."""
        return None if not self.table else all(self.table.get(k, found) == found for k, found in (("frames", len(self.offsets)), ("bytes", self.bytes)))


def _tag(data: bytes, out: Stream) -> int:
    """Reads an ID3v2 tag's private frames; where the tag ends, 0 without a tag."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0
    size = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end = min(len(data), 10 + size(data[6:10]))
    at = 10
    while at + 10 <= end and data[at] and data[3] in (3, 4):
        n = size(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        if data[at : at + 4] == b"PRIV":
            owner, _, value = data[at + 10 : min(end, at + 10 + n)].partition(b"\0")
            out.private[owner] = value
        at += 10 + n
    return end


def _variable(data: bytes, at: int, frame: Frame) -> dict:
    """The Xing, Info or VBRI table of a frame; empty if it has none."""
    x = at + 4 + frame.side + 2 * frame.protected
    word = lambda i: int.from_bytes(data[i : i + 4], "big")
    if data[x : x + 4] in (b"Xing", b"Info"):
        out, flags, x = {"kind": data[x : x + 4].decode()}, word(x + 4), x + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], x = word(x), x + 4
        return out | ({"seek": data[x : x + 100]} if flags & 4 else {})
    x = at + 36
    return {"kind": "VBRI", "bytes": word(x + 10), "frames": word(x + 14)} if data[x : x + 4] == b"VBRI" else {}


def read_stream(data: bytes) -> Stream:
    """Walks a stream's frames. After bytes that are no frame it goes on at the next header whose frame ends at another
    header, at a closing tag or at the end of the data; a frame that the data cut off is not counted.

    The 128 bytes of a closing tag are told only where the walk comes to them: inside a frame they are the frame's.
    Checksums of all three layers are verified."""
    out = Stream()
    at, last, body = _tag(data, out), len(data), []
    closing = last - 128 if data[-128:-125] == b"TAG" else -1
    synced = False
    while at + 4 <= last and at != closing:
        frame = frame_header(data[at : at + 4])
        end = at + frame.size if frame else 0
        if frame and end <= last and (synced or end in (last, closing) or frame_header(data[end : end + 4])):
            table = _variable(data, at, frame) if not out.offsets and not out.table else {}
            if table:
                out.table = table
                out.bytes += frame.size
            else:
                if frame.protected and not checksum_fits(frame, data, at):
                    out.bad_checksums += 1
                out.offsets.append(at)
                out.bytes += frame.size
                out.samples += frame.samples
                out.rate = out.rate or frame.rate
                out.kbps.add(frame.kbps)
                body.append(data[at + 4 + frame.side + 2 * frame.protected : end])
            at, synced = end, True
        else:
            after = data.find(b"\xff", at + 1, last)
            after = last if after < 0 else after
            after = closing if at < closing < after else after
            out.skipped += after - at
            at, synced = after, False
    if OWNER[:-1] in out.private:
        out.payload = b"".join(body)[: int.from_bytes(out.private[OWNER[:-1]], "big")]
    return out


def payload_of(text: bytes) -> bytes:
    """A text's bytes, filled with zeros to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def to_audio(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, in an MPEG audio stream.

    A null text is the empty one, whose payload is 64 zero bytes. Null and repeated doc_ids are kept; other columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = raw_texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([write_stream(payload_of(t)) for t in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "frames long, samples long, rate int, bitrates array<int>, bad_checksums long, skipped long, seek_offsets array<long>, seconds string, table_kind string, table_agrees boolean"


def read_audio(media: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """The columns `keep`, and of each stream: payload digests, exact length in samples and in seconds (a fraction such
    as 3/125), frame seek offsets, and its variable-bitrate table's kind and whether it names the frames and bytes that
    were found (null without a table).

    Null media and bytes without any frame have no frames, rate 0 and an empty payload.
    """
    kept = media.select(*keep, F.col(column).alias(free_name(keep, "__media")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*keep).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                data = data or b""
                s = read_stream(data)
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), len(s.offsets), s.samples, s.rate, sorted(s.kbps), s.bad_checksums, s.skipped, s.offsets, str(s.seconds), s.table.get("kind"), s.table_agrees))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.bool_()]
            found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "samples", "rate", "bitrates", "bad_checksums", "skipped", "seek_offsets", "seconds", "table_kind", "table_agrees"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*keep, *names])

    return kept.mapInArrow(run, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, {FEATURES}")


def feature(df: DataFrame) -> DataFrame:
    """Adds feature: frames, exact milliseconds, rate, bitrates, bad checksums and a digest of the seek offsets."""
    ms = F.when(F.col("rate") > 0, F.col("samples") * 1000 / F.col("rate")).otherwise(0.0)
    seek = F.crc32(F.array_join(F.col("seek_offsets").cast("array<string>"), ",").cast("binary"))
    return df.withColumn("feature", F.format_string("frames=%d;ms=%.3f;rate=%d;kbps=%s;bad=%d;seek=%08x", "frames", ms, "rate", F.array_join(F.col("bitrates").cast("array<string>"), ","), "bad_checksums", seek))
