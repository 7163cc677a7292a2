"""MPEG audio in a binary column: resynchronised frames, tags, rate tables, checksums, durations, seek offsets.

``parse`` reads any MPEG-1/2/2.5 stream of layers I to III. Bytes that are no frame (tags, damage) are stepped over until
two headers in a row agree. ``write`` makes a lossless carrier: silent layer III frames whose ancillary bytes hold a
payload, after an ID3v2 tag and a frame with a variable-rate table.

Checksums of all three layers are verified: over the header and layer I's allocation, layer II's allocation and scale factor selection,
layer III's side information. Free-format frames (rate 0) are not told and are stepped over. Durations count whole frames: the
encoder's delay and padding, where a table gives them, are not taken off.

Null bytes: all fields null but the counts, which are 0. Empty bytes or no frame at all: counts 0, duration 0. Damaged bytes never fail: what
can't be read is skipped or null. Repeated rows, each its own; an empty table, an empty one. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quarrylens.llm.common import bounded_batches, fresh, map_rows

# Fixed values of the format: kbit/s by (MPEG-1 or not, layer), samples a second by version bits, samples a frame.
RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Layer II: bits of allocation in each subband, by table (a to d for MPEG-1, e for the lower rates), as (bits, subbands).
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "e": ((4, 4), (3, 7), (2, 19)),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    """The checksum of MPEG audio frames: polynomial 0x8005, most significant bit first."""
    c = start
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


def crc16_bits(data: bytes, bits: int, start: int = 0xFFFF) -> int:
    """The checksum of the first ``bits`` bits."""
    c = crc16(data[: bits // 8], start)
    for k in range(bits % 8):
        bit = data[bits // 8] >> (7 - k) & 1
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


@dataclass(frozen=True)
class Header:
    mpeg1: bool
    layer: int
    protected: bool
    kbps: int
    hertz: int
    mono: bool
    size: int
    samples: int
    bound: int  # the first subband whose allocation both channels share

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.mpeg1 else (9 if self.mono else 17)

    @property
    def allocation(self) -> list[int]:
        """Layer II: bits of allocation of each subband."""
        rate = self.kbps // (1 if self.mono else 2)
        if not self.mpeg1:
            table = "e"
        elif rate <= 48:
            table = "d" if self.hertz == 32000 else "c"
        else:
            table = "a" if self.hertz == 48000 or rate <= 80 else "b"
        return [bits for bits, n in ALLOCATION[table] for _ in range(n)]

    def checked_bits(self, body: bytes) -> int:
        """How many bits after the checksum it covers."""
        if self.layer == 3:
            return 8 * self.side
        channels = 1 if self.mono else 2
        if self.layer == 1:
            return 4 * (32 if self.mono else 32 + self.bound)
        bits, at, picked = "".join(f"{b:08b}" for b in body[:96]), 0, 0
        for subband, n in enumerate(self.allocation):
            own = channels if subband < self.bound else 1
            for _ in range(own):
                picked += (channels // own) * ("1" in bits[at : at + n])
                at += n
        return at + 2 * picked


_HEADERS: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The frame header in a 32-bit word, or None. Free-format and reserved values are none."""
    if word in _HEADERS:
        return _HEADERS[word]
    out, version, layer, rate, hz = None, word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 == 0x7FF and version != 1 and layer != 4 and 0 < rate < 15 and hz != 3 and word & 3 != 2:
        key = (version == 3, layer)
        kbps, hertz, pad = RATES[key][rate], HERTZ[version][hz], word >> 9 & 1
        size = (12000 * kbps // hertz + pad) * 4 if layer == 1 else SAMPLES[key] // 8 * 1000 * kbps // hertz + pad
        out = Header(version == 3, layer, not word >> 16 & 1, kbps, hertz, word >> 6 & 3 == 3, size, SAMPLES[key], 4 * ((word >> 4 & 3) + 1) if word >> 6 & 3 == 1 else 32)
    if len(_HEADERS) < 1 << 14:
        _HEADERS[word] = out
    return out


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    hertz: int | None = None
    channels: int | None = None
    layer: int | None = None
    variable: bool = False
    checked: int = 0
    bad_crc: int = 0
    skipped: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] | None = None
    tags: dict[str, str] = field(default_factory=dict)
    seek: list[tuple[int, int]] = field(default_factory=list)
    spans: list[tuple[int, int, Header]] = field(default_factory=list)

    @property
    def duration_us(self) -> int:
        return round(Fraction(self.samples * 1_000_000, self.hertz)) if self.hertz else 0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _as_synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


_TEXT = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length and text fields of a tag at the start; 0 if there is none. Broken fields end the reading."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] > 4 or any(b & 0x80 for b in data[6:10]):
        return 0, {}
    end, at, tags = min(len(data), 10 + _synchsafe(data[6:10])), 10, {}
    if data[5] & 0x40 and end >= 14:
        at += _synchsafe(data[10:14]) if data[3] == 4 else 4 + struct.unpack(">I", data[10:14])[0]
    while at + 10 <= end and data[at : at + 4].strip(b"\0").isalnum():
        size = _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 10 : min(end, at + 10 + size)]
        if data[at : at + 1] == b"T" and body[:1] and body[0] in _TEXT:
            tags[data[at : at + 4].decode("latin-1")] = body[1:].decode(_TEXT[body[0]], "replace").rstrip("\0").replace("\0", "=", 1)
        at += 10 + size
    return end + (10 if data[5] & 0x10 else 0), tags


def _id3v1(data: bytes) -> dict[str, str]:
    text = lambda a, b: data[a:b].split(b"\0")[0].decode("latin-1").strip()
    n = len(data) - 128
    return {k: v for k, v in (("TIT2", text(n + 3, n + 33)), ("TPE1", text(n + 33, n + 63)), ("TALB", text(n + 63, n + 93)), ("TDRC", text(n + 93, n + 97))) if v}


def _rate_table(frame: bytes, h: Header, into: Stream) -> bool:
    """Whether the frame is a table of a variable-rate (Xing), constant-rate (Info) or VBRI stream. Fields beyond the frame's end stay null."""

    def number(at: int, n: int) -> int | None:
        return int.from_bytes(frame[at : at + n], "big") if at + n <= len(frame) else None

    x = 4 + 2 * h.protected + h.side
    if frame[x : x + 4] in (b"Xing", b"Info"):
        flags, x = number(x + 4, 4) or 0, x + 8
        for bit, name in ((1, "table_frames"), (2, "table_bytes")):
            if flags & bit:
                setattr(into, name, number(x, 4))
                x += 4
        if flags & 4 and x + 100 <= len(frame):
            into.toc = list(frame[x : x + 100])
        return True
    if frame[36:40] == b"VBRI":
        into.table_bytes, into.table_frames = number(46, 4), number(50, 4)
        n, scale, width = (number(at, 2) or 0 for at in (54, 56, 58))
        if width and 62 + n * width <= len(frame):
            into.toc = [number(62 + i * width, width) * scale for i in range(n)]
        return True
    return False


def _sound(h: Header, frame: bytes) -> bool:
    """Whether a protected frame's checksum holds."""
    body = frame[6:]
    bits = h.checked_bits(body)
    return bits <= 8 * len(body) and crc16_bits(body, bits, crc16(frame[2:4])) == int.from_bytes(frame[4:6], "big")


def parse(data: bytes, seek_every: int = 100) -> Stream:
    """Every frame of a stream. ``seek``: (first sample, byte offset) of each ``seek_every``th frame."""
    out = Stream()
    at, out.tags = _id3v2(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.tags = _id3v1(data) | out.tags
        end -= 128
    synced, first, word = False, True, struct.Struct(">I").unpack_from
    rates = set()
    while at + 4 <= end:
        h = header(word(data, at)[0])
        if h is None or at + h.size > end or h.size < 6:
            synced, nxt = False, data.find(b"\xff", at + 1, end)
            out.skipped += (nxt if nxt >= 0 else end) - at
            at = nxt if nxt >= 0 else end
            continue
        if not synced:  # a lone header may be chance: the next one has to agree, or the stream to end
            after = at + h.size
            follow = header(word(data, after)[0]) if after + 4 <= end else h
            if follow is None or (follow.layer, follow.hertz, follow.mpeg1) != (h.layer, h.hertz, h.mpeg1):
                at += 1
                out.skipped += 1
                continue
            synced = True
        if h.protected:
            out.checked += 1
            out.bad_crc += not _sound(h, data[at : at + h.size])
        if not (first and h.layer == 3 and _rate_table(data[at : at + h.size], h, out)):
            if out.frames % seek_every == 0:
                out.seek.append((out.samples, at))
            out.hertz, out.channels, out.layer = out.hertz or h.hertz, out.channels or (1 if h.mono else 2), out.layer or h.layer
            out.frames += 1
            out.samples += h.samples
            rates.add(h.kbps)
            out.spans.append((at, at + h.size, h))
        first = False
        at += h.size
    out.skipped += max(0, end - at)
    out.variable = len(rates) > 1
    return out


def _frame(kbps: int, body: bytes) -> bytes:
    """A silent, checksummed layer III frame of 32 kHz stereo with ``body`` as ancillary bytes."""
    head = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | RATES[True, 3].index(kbps) << 12 | 2 << 10)
    side = bytes(32)
    return head + struct.pack(">H", crc16(side, crc16(head[2:]))) + side + body


#: Bytes of a frame that are not ancillary, and ancillary bytes by rate, smallest first.
_OVER = 4 + 2 + 32
_ROOM = {k: 144 * k // 32 - _OVER for k in RATES[True, 3][1:]}


def write(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """A variable-rate stream that carries ``payload``: frames of the highest rate, the last of the lowest that has room."""
    top, frames, offsets = max(_ROOM), [], []
    for i in range(0, len(payload), _ROOM[top]):
        part = payload[i : i + _ROOM[top]]
        kbps = next(k for k, room in _ROOM.items() if room >= len(part))
        frames.append(_frame(kbps, part + bytes(_ROOM[kbps] - len(part))))
    fields = b"".join(k.encode() + _as_synchsafe(len(v.encode()) + 1) + b"\0\0\3" + v.encode() for k, v in sorted((tags or {}).items()))
    tag = b"ID3\4\0\0" + _as_synchsafe(len(fields)) + fields
    total = sum(map(len, frames)) + 144 * 64 // 32
    at = 144 * 64 // 32
    for f in frames:
        offsets.append(at)
        at += len(f)
    toc = bytes(min(255, offsets[min(len(offsets) - 1, i * len(offsets) // 100)] * 256 // total) if offsets else 0 for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"".join([tag, _frame(64, table.ljust(_ROOM[64], b"\0")), *frames])


def payload_of(data: bytes, stream: Stream, n: int) -> bytes:
    """The first ``n`` ancillary bytes of the frames that ``write`` made."""
    return b"".join(data[a + _OVER : b] for a, b, _ in stream.spans)[:n]


AUDIO = "duration_us long, frames long, samples long, sample_rate int, channels int, layer int, variable boolean, checked long, bad_crc long, skipped long, table_frames long, table_bytes long, tags map<string,string>, seek array<struct<sample:long,offset:long>>"


def audio_columns(df: DataFrame, column: str, seek_every: int = 100) -> DataFrame:
    """``df`` with ``AUDIO``'s columns of what the streams in ``column`` (binary) hold; a name that ``df`` has gets an underscore before it."""
    have = {c.lower() for c in df.columns}
    fields = _parse_datatype_string(AUDIO).fields
    for f in fields:
        if f.name.lower() in have:
            f.name = fresh(df, f.name)[0]
    schema = StructType([*df.schema.fields, *fields])
    kinds, n, place = to_arrow_schema(schema), len(df.columns), df.columns.index(column)

    def one(data):
        if data is None:
            return (None, 0, 0, *[None] * 4, 0, 0, 0, *[None] * 4)
        s = parse(bytes(data), seek_every)
        return (s.duration_us, s.frames, s.samples, s.hertz, s.channels, s.layer, s.variable, s.checked, s.bad_crc, s.skipped, s.table_frames, s.table_bytes, list(s.tags.items()), [{"sample": a, "offset": b} for a, b in s.seek])

    def run(batches):
        for batch in batches:
            found = [one(data) for data in batch.column(place).to_pylist()]
            new = [pa.array([row[i] for row in found], kinds.field(n + i).type) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=kinds.names)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def store_text(text: str | None) -> tuple[bytes, int]:
    """The stream that carries a text's UTF-8 bytes, padded with 0 to a positive multiple of 64; the unpadded length."""
    raw = (text or "").encode()
    return write(raw.ljust(max(64, -len(raw) // 64 * -64), b"\0"), {"TLEN": str(len(raw)), "TSSE": "quarrylens"}), len(raw)


def digest(text: str | None) -> tuple:
    """Contract columns of one text, from the bytes as stored and parsed again."""
    media, n = store_text(text)
    s = parse(media)
    length = int(s.tags["TLEN"])
    payload = payload_of(media, s, max(64, -length // 64 * -64))
    offsets = ",".join(f"{a}:{b}" for a, b in s.seek)
    feature = f"us={s.duration_us};frames={s.frames}/{s.table_frames};hz={s.hertz};ch={s.channels};layer={s.layer};vbr={int(s.variable)};crc={s.checked - s.bad_crc}/{s.checked};skipped={s.skipped};bytes={s.table_bytes};seek={zlib.crc32(offsets.encode()):08x}"
    return length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text stored as an MPEG audio stream and read again; null texts are empty ones.

    Columns: the id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), lambda: lambda i, t: (i, *digest(t)), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
