"""MPEG audio as a column: a writer that carries bytes losslessly, and a reader of any stream.

The writer makes MPEG-1 Layer III mono frames at 48 kHz with checksums. Their side
information says that no bits are used for sound, so what follows is ancillary data, where
the payload goes. Frames take one, two or four units of 192 bytes at 80, 160 or 320 kbit/s,
so the stream's bit rate varies; an ID3v2 tag carries the length and an Info frame the
table of frames, bytes and seek points.

The reader finds tags, resynchronises on frame headers past anything else, checks each
protected frame's CRC-16 in all three layers, and gives each frame's place and the exact
duration, less the encoder delay and padding where the stream names them. Free-format bit
rates are not read: such frames are skipped like anything that is no frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, per_text

UNIT = 192

# Fixed values of the MPEG audio header: kbit/s by index for (version 1, layers I II III) and (versions 2 and 2.5, layer I, layers II III).
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Units a frame and its bit rate's index.
FRAMES = ((4, 14), (2, 10), (1, 6))


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5, as in the header's bits
    layer: int
    protected: bool
    kbps: int
    sample_rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple:
        """What all frames of a stream have in common."""
        return self.version, self.layer, self.sample_rate


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none. Free-format bit rates are not accepted."""
    if (known := _headers.get(four, 0)) != 0:
        return known
    found = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer, rate, of = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
        if version != 1 and layer != 4 and rate not in (0, 15) and of != 3 and four[3] & 3 != 2:
            kbps = BITRATES[(1, layer) if version == 3 else (2, min(layer, 2))][rate]
            hz, pad = SAMPLE_RATES[version][of], four[2] >> 1 & 1
            samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
            size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
            found = Header(version, layer, not four[1] & 1, kbps, hz, four[3] >> 6 == 3, size, samples)
    if len(_headers) < 4096:
        _headers[four] = found
    return found


def crc16(data: bytes) -> int:
    """The MPEG audio CRC: polynomial 0x8005, all ones at first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(data: bytes, n_bits: int) -> int:
    """crc16() of the first n_bits."""
    crc = crc16(data[: n_bits // 8])
    for k in range(n_bits // 8 * 8, n_bits):
        bit = data[k // 8] >> (7 - k % 8) & 1
        crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ bit) & 1 else crc << 1) & 0xFFFF
    return crc


def allocation_widths(head: Header) -> list[int]:
    """Bits of each subband's allocation in Layer II, by bit rate a channel and sample rate."""
    if head.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = head.kbps if head.mono else head.kbps // 2
    if each < 56:
        return [4] * 2 + [3] * (10 if head.sample_rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if each >= 96 and head.sample_rate != 48000 else 4)


def protected_bits(data: bytes, at: int, head: Header) -> int:
    """How many bits after the checksum it covers: side information, or allocations (and in Layer II their scale factor choices)."""
    if head.layer == 3:
        return 8 * head.side
    channels, mode = (1 if head.mono else 2), data[at + 3] >> 6
    widths = [4] * 32 if head.layer == 1 else allocation_widths(head)
    bound = 4 * ((data[at + 3] >> 4 & 3) + 1) if mode == 1 else len(widths)
    own = [channels if k < bound else 1 for k in range(len(widths))]
    bits = sum(w * c for w, c in zip(widths, own, strict=True))
    if head.layer == 1:
        return bits
    body = int.from_bytes(data[at + 6 : at + 6 + -(-bits // 8)], "big") >> (-bits % 8)
    left, choices = bits, 0
    for width, times in zip(widths, own, strict=True):
        for _ in range(times):
            left -= width
            choices += (body >> left & (1 << width) - 1 > 0) * (channels if times < channels else 1)
    return bits + 2 * choices


_crcs: dict[bytes, int] = {}


def _crc(data: bytes) -> int:
    """crc16(), remembered: most frames of a stream protect the same few bytes."""
    if (known := _crcs.get(data)) is None:
        known = crc16(data)
        if len(_crcs) < 4096:
            _crcs[data] = known
    return known


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _frame_start(index: int) -> bytes:
    """Header, checksum and empty side information of a protected mono Layer III frame at 48 kHz."""
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    return head + _crc(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


def write_stream(data: bytes) -> bytes:
    """A stream that carries data, padded with blanks to whole units, at least one."""
    units = max(1, -(-len(data) // UNIT))
    payload = data.ljust(units * UNIT, b" ")
    frames, at = [], 0
    for per, index in FRAMES:
        start = _frame_start(index)
        size = header(start[:4]).size
        while (units - at) >= per:
            frames.append((start + payload[at * UNIT : (at + per) * UNIT]).ljust(size, b"\0"))
            at += per
    lengths = np.fromiter(map(len, frames), np.int64, len(frames))
    info = _frame_start(6)
    total = header(info[:4]).size + int(lengths.sum())
    starts = (total - int(lengths.sum()) + np.cumsum(lengths) - lengths) * 256 // total
    toc = bytes(np.minimum(starts[np.arange(100) * len(frames) // 100], 255).astype(np.uint8))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    first = (info + table).ljust(header(info[:4]).size, b"\0")
    text = b"\0payload\0" + str(len(data)).encode()
    frame = b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame + first + b"".join(frames)


@dataclass
class Stream:
    """What a stream holds. offsets: of each audio frame; ancillary: (start, end) after each frame's side information."""

    tags: dict[str, str] = field(default_factory=dict)
    id3v1: bool = False
    table: dict | None = None
    frames: int = 0
    samples: int = 0
    sample_rate: int = 0
    bitrates: dict[int, int] = field(default_factory=dict)
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    resyncs: int = 0
    trimmed: int = 0  # samples of encoder delay and padding
    offsets: list[int] = field(default_factory=list)
    ancillary: list[tuple[int, int]] = field(default_factory=list)

    @property
    def duration_us(self) -> int:
        return max(0, self.samples - self.trimmed) * 1_000_000 // self.sample_rate if self.sample_rate else 0


def _id3v2(data: bytes, at: int, found: Stream) -> int:
    """The end of the ID3v2 tag at this place; at itself if there is none that is whole."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at
    whole = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, end = data[at + 3], at + 10 + whole(data[at + 6 : at + 10])
    if end > len(data):
        return at
    k = at + 10
    while major >= 3 and k + 10 <= end and data[k : k + 1].isalnum():
        name = data[k : k + 4].decode("latin-1")
        size = whole(data[k + 4 : k + 8]) if major == 4 else int.from_bytes(data[k + 4 : k + 8], "big")
        if k + 10 + size > end:
            break
        body = data[k + 10 : k + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
            if name == "TXXX" and "\0" in text:
                name, text = text.split("\0", 1)
            found.tags[name] = text
        k += 10 + size
    return end + (10 if data[at + 5] & 0x10 else 0)


def _table(data: bytes, at: int, head: Header) -> dict | None:
    """The variable-bitrate table in a frame: Xing or Info after the side information, or VBRI."""
    k = at + 4 + head.side + (2 if head.protected else 0)
    for k in (k, at + 4 + head.side):
        if data[k : k + 4] in (b"Xing", b"Info"):
            flags, k = int.from_bytes(data[k + 4 : k + 8], "big"), k + 8
            out: dict = {"kind": "Xing"}
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit and k + size <= at + head.size:
                    out[name] = data[k : k + size] if name == "toc" else int.from_bytes(data[k : k + size], "big")
                    k += size
            if k + 24 <= at + head.size and data[k : k + 4].isalpha():  # an encoder's name, then its settings
                both = int.from_bytes(data[k + 21 : k + 24], "big")
                out["delay"], out["padding"] = both >> 12, both & 0xFFF
            return out
    if data[at + 36 : at + 40] == b"VBRI" and head.size >= 62:
        size, frames = struct.unpack(">II", data[at + 46 : at + 54])
        entries, scale, width, per = struct.unpack(">HHHH", data[at + 54 : at + 62])
        body = data[at + 62 : at + 62 + entries * width]
        points = [int.from_bytes(body[k : k + width], "big") * scale for k in range(0, len(body), width)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "points": points, "frames_per_point": per}
    return None


def _trailing(data: bytes, at: int) -> dict[int, bool]:
    """Where trailing tags may begin: places after `at` from which an APE tag, an ID3v1 tag or both reach the end; whether ID3v1 is there."""
    size = len(data)
    ends = {size: False}
    if size - at >= 128 and data[-128:-125] == b"TAG":
        ends[size - 128] = True
    begins = {end: True for end in ends if end < size}
    for end, id3v1 in ends.items():
        if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
            length = int.from_bytes(data[end - 20 : end - 16], "little") + (32 if data[end - 9] & 0x80 else 0)
            if 32 <= length <= end - at:
                begins[end - length] = id3v1
    return begins


def read_stream(data: bytes) -> Stream:
    """Reads any bytes. A header counts as a frame if the next frame of the stream, or the end of sound, follows it.

    Frames that follow each other go before tags: what looks like a trailing tag is one only where it
    begins right after a frame or in bytes that are no frame.
    """
    found, size, at = Stream(), len(data), 0
    while (end := _id3v2(data, at, found)) > at:
        at = end
    begins = _trailing(data, at)
    kind, synced, first = None, False, True
    while at + 4 <= size:
        head = header(data[at : at + 4])
        good = head is not None and at + head.size <= size and (kind is None or head.kind == kind)
        if good:
            after = at + head.size
            nearby = header(data[after : after + 4])
            followed = after == size or (nearby is not None and nearby.kind == head.kind)
            good = followed or after in begins or (synced and not any(at < place < after for place in begins))
        if not good:
            if at in begins:
                found.id3v1, size = begins[at], at
                break
            if synced:
                found.resyncs += 1
            synced = False
            nxt = data.find(b"\xff", at + 1, size)
            nxt = min([size if nxt < 0 else nxt, *(place for place in begins if place > at)])
            found.skipped += nxt - at
            at = nxt
            continue
        synced, kind = True, head.kind
        begin = at + 4 + (2 if head.protected else 0)
        if head.protected:
            named = int.from_bytes(data[at + 4 : at + 6], "big")
            if head.layer == 3:
                ok = named == _crc(data[at + 2 : at + 4] + data[begin : begin + head.side])
            else:
                bits = protected_bits(data, at, head)
                ok = begin + -(-bits // 8) <= at + head.size and named == crc16_bits(data[at + 2 : at + 4] + data[begin : begin + -(-bits // 8)], 16 + bits)
            found.crc_ok += ok
            found.crc_bad += not ok
        if first and (table := _table(data, at, head)):
            found.table = table
            found.trimmed = table.get("delay", 0) + table.get("padding", 0)
        else:
            found.frames += 1
            found.samples += head.samples
            found.sample_rate = head.sample_rate
            found.bitrates[head.kbps] = found.bitrates.get(head.kbps, 0) + 1
            found.offsets.append(at)
            found.ancillary.append((begin + (head.side if head.layer == 3 else 0), at + head.size))
        first = False
        at += head.size
    found.skipped += max(0, size - at)
    if found.id3v1:
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if text := data[len(data) - 128 + a : len(data) - 128 + b].rstrip(b"\0 ").decode("latin-1"):
                found.tags.setdefault(name, text)
    return found


def payload(data: bytes, found: Stream) -> bytes:
    """What write_stream() was given, padded: the whole units of each frame's ancillary data, by its bit rate."""
    return b"".join(data[a : a + (b - a) // UNIT * UNIT] for a, b in found.ancillary)


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (binary): each whole text's UTF-8 as a stream; a null text counts as empty.

    Repeated rows and rows with a null doc_id each get a row; an empty table gives none;
    other columns are ignored whatever their names.
    """
    make = lambda: lambda text: (write_stream((text or "").encode("utf-8", "surrogatepass")),)
    return per_text(id_text(docs, id_col, text_col), make, pa.schema([("doc_id", pa.int64()), ("media", pa.binary())]), "doc_id long, media binary")


_READ = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
    + [(n, pa.int64()) for n in ("frames", "samples", "duration_us", "crc_ok", "crc_bad", "resyncs", "skipped")]
    + [("table_frames", pa.int64()), ("seek_offsets", pa.list_(pa.int64())), ("feature", pa.string())]
)
_READ_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, samples long, duration_us long, crc_ok long, crc_bad long, resyncs long, skipped long, table_frames long, seek_offsets array<long>, feature string"


def read(stored: DataFrame) -> DataFrame:
    """Reads the column media of rows of doc_id and media: payload digests, exact durations, frame seek offsets.

    Any bytes are accepted: a stream without frames has duration 0 and no offsets; null
    media count as empty. n_bytes is null where no tag names the payload's length. Repeated
    rows each get a row; an empty table gives none; other columns are ignored.
    """

    def of(media: bytes | None) -> tuple:
        media = media or b""
        found = read_stream(media)
        data = payload(media, found)
        length = found.tags.get("payload", "")
        seek = hashlib.sha256(np.asarray(found.offsets, "<i8").tobytes()).hexdigest()[:16]
        rates = "/".join(f"{k}:{n}" for k, n in sorted(found.bitrates.items()))
        feature = f"{found.frames} frames, {found.samples} samples, {found.duration_us} us, kbit/s {rates}, crc {found.crc_ok}+{found.crc_bad}, table {(found.table or {}).get('frames')}, seek {seek}"
        return (
            int(length) if length.isdigit() else None, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(),
            found.frames, found.samples, found.duration_us, found.crc_ok, found.crc_bad, found.resyncs, found.skipped, (found.table or {}).get("frames"), found.offsets, feature,
        )

    return per_text(stored.select("doc_id", "media"), lambda: of, _READ, _READ_DDL)
