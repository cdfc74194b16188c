"""GIF columns: encode samples, decode streams, compose frames and count colours."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Samples of a row, and rows of a frame at most.
WIDTH, HEIGHT = 64, 1024
#: Hundredths of a second that an encoded frame is shown.
DELAY = 10
#: Bytes of text that are padded to a multiple of this.
UNIT = 64
#: Bits of red, green and blue by which colours are counted.
HISTOGRAM = (1, 1, 1)


@functools.cache
def palette_332() -> np.ndarray:
    """256 colours by 3 bits of red, 3 of green and 2 of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8)


def _bits(codes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The bits of codes whose widths never decrease, lowest first."""
    out, lo = [], 0
    while lo < len(codes):
        w = int(widths[lo])
        hi = int(np.searchsorted(widths, w, side="right"))
        out.append((codes[lo:hi, None] >> np.arange(w, dtype=np.uint16) & 1).astype(np.uint8).ravel())
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of each of the first ``n`` codes after a clear code; the table grows by one entry with every code but the first."""
    entries = (1 << size) + 2 + np.arange(n) - 1
    return np.minimum(np.maximum(np.ceil(np.log2(np.maximum(entries, 1) + 1)).astype(np.int64), size + 1), 12)


@functools.cache
def _code_widths(size: int) -> np.ndarray:
    return _widths(4096 - (1 << size) - 2 + 1, size)


def compress(samples: bytes, size: int = 8) -> bytes:
    """LZW codes of samples below 2**size; the table is cleared when full."""
    clear, end = 1 << size, (1 << size) + 1
    known = _code_widths(size)
    bits = [_bits(np.array([clear], dtype=np.uint16), np.array([size + 1]))]
    # a key is a code plus the next sample, moved beyond all codes
    moved = (np.frombuffer(samples, dtype=np.uint8).astype(np.int32) << 12).tolist()
    codes: list[int] = []
    table: dict[int, int] = {}
    emit, seen, free = codes.append, table.get, end + 1
    prefix = moved[0] >> 12 if moved else -1
    for m in moved[1:]:
        key = prefix + m
        if code := seen(key):
            prefix = code
            continue
        emit(prefix)
        if free < 4096:
            table[key] = free
            free += 1
        else:
            emit(clear)
            bits.append(_bits(np.array(codes, dtype=np.uint16), np.append(known[: len(codes) - 1], 12)))
            codes.clear()
            table.clear()
            free = end + 1
        prefix = m >> 12
    if prefix >= 0:
        emit(prefix)
    emit(end)
    run = len(codes) - 1
    bits.append(_bits(np.array(codes, dtype=np.uint16), np.append(known[:run], known[min(run, len(known) - 1)])))
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


@functools.cache
def _literals(size: int) -> list[bytes]:
    return [bytes([i]) for i in range(1 << size)] + [b"", b""]


def decompress(stream: bytes, size: int, limit: int) -> bytes:
    """The samples of a code stream, at most ``limit``; it ends at its end code or where it is cut off.

    Between two clear codes the width of a code follows from its number, so that
    a whole run is read at once; the entries are then followed one by one.
    """
    clear, end = 1 << size, (1 << size) + 1
    known = _code_widths(size)
    bits = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8)
    total = len(stream) * 8
    literal = _literals(size)
    out, made, at = [], 0, 0
    lanes = np.ndarray((len(stream) + 1,), dtype="<u4", buffer=bits, strides=(1,))
    while at < total and made < limit:
        # a full table stays as it is, so a run may go on at 12 bits
        n = len(known)
        ends = at + np.cumsum(known)
        while True:
            starts = ends - (known if n == len(known) else np.append(known, np.full(n - len(known), 12)))
            ok = int(np.searchsorted(ends, total, side="right"))
            widths = (ends - starts)[:ok]
            codes = lanes[starts[:ok] >> 3] >> (starts[:ok] & 7).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or ok < n:
                break
            more = np.arange(1, 4097) * 12
            ends, n = np.append(ends, ends[-1] + more), n + 4096
        last = int(stop[0]) if len(stop) else ok
        found = _follow(codes[:last].tolist(), literal)
        out += found
        made += sum(map(len, found))
        if not len(stop) or codes[last] == end:
            break
        at = int(ends[last])
    return b"".join(out)[:limit]


def _follow(codes: list[int], literal: list[bytes]) -> list[bytes]:
    """The text of each code of a run that starts with an empty table."""
    if not codes:
        return []
    if codes[0] >= len(literal) - 2:
        raise ValueError("a code of the stream has no entry")
    entries, before = literal.copy(), literal[codes[0]]
    add, n, out = entries.append, len(literal), [before]
    put = out.append
    grow = 4096 - n
    for code in codes[1 : grow + 1]:
        if code < n:
            text = entries[code]
        elif code == n:
            text = before + before[:1]
        else:
            raise ValueError("a code of the stream has no entry")
        add(before + text[:1])
        put(text)
        n += 1
        before = text
    return out + [entries[code] for code in codes[grow + 1 :]]


def encode(payload: bytes, width: int = WIDTH, height: int = HEIGHT, palette: np.ndarray | None = None) -> bytes:
    """A GIF89a whose frames hold the payload as palette indices, ``width`` in a row; its length is a multiple of ``width``."""
    colours = palette_332() if palette is None else palette
    rows = max(1, len(payload) // width)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0), colours.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for lo in range(0, len(payload), width * height):
        part = payload[lo : lo + width * height]
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0))
        parts.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0))
        data = compress(part)
        blocks = [bytes([min(255, len(data) - k)]) + data[k : k + 255] for k in range(0, len(data), 255)]
        parts.append(b"\x08" + b"".join(blocks) + b"\0")
    return b"".join(parts) + b"\x3b"


@dataclass
class Frame:
    """One image of a file: where it stands, when it is shown, its samples, and the canvas with it drawn."""

    start: int
    delay: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    samples: bytes
    canvas: np.ndarray


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order; times in hundredths of a second. A file without a GIF header raises ValueError."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((high, wide, 4), dtype=np.uint8)
    delay, disposal, clear, now = 0, 0, None, 0

    def blocks(k: int) -> tuple[bytes, int]:
        found = []
        while k < len(data) and data[k]:
            found.append(data[k + 1 : k + 1 + data[k]])
            k += 1 + data[k]
        return b"".join(found), k + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = common
        if flags & 0x80:
            n = 2 << (flags & 7)
            colours = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
            at += 3 * n
        size = data[at]
        body, at = blocks(at + 1)
        samples = decompress(body, size, w * h)
        index = np.zeros(w * h, dtype=np.uint8)
        index[: len(samples)] = np.frombuffer(samples, dtype=np.uint8)
        index = index.reshape(h, w)
        if flags & 0x40:  # rows come in four passes
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        table = np.zeros((256, 4), dtype=np.uint8)
        if colours is not None:
            table[: len(colours), :3] = colours
        table[:, 3] = 255
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        drawn = table[index][: area.shape[0], : area.shape[1]]
        area[...] = drawn if clear is None else np.where((index[: area.shape[0], : area.shape[1]] == clear)[:, :, None], area, drawn)
        yield Frame(now, delay, left, top, w, h, disposal, clear, index.tobytes(), canvas.copy() if disposal in (2, 3) else canvas)
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        now, delay, disposal, clear = now + delay, 0, 0, None


def histogram(canvas: np.ndarray, bits: tuple[int, int, int] = HISTOGRAM) -> np.ndarray:
    """Pixels of the canvas by colour; fully transparent ones aren't counted."""
    r, g, b = bits
    c = canvas.reshape(-1, 4)
    cell = (c[:, 0] >> (8 - r)).astype(np.int64) << (g + b) | (c[:, 1] >> (8 - g)).astype(np.int64) << b | c[:, 2] >> (8 - b)
    if not c[:, 3].all():
        cell = cell[c[:, 3] > 0]
    return np.bincount(cell, minlength=1 << (r + g + b))


FRAMES = "frame int, start_cs int, delay_cs int, left int, top int, width int, height int, disposal int, transparent int, samples binary, rgba binary, histogram array<long>, error string"


def decode_frames(media: DataFrame, id_col: str = "doc_id", data_col: str = "data") -> DataFrame:
    """A row for each frame of each GIF: id, frame number, times, place, samples, composed canvas and colour histogram.

    A null, empty or broken file gives one row with a null frame and the reason in ``error``.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = ["id", *(f.split()[0] for f in FRAMES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("frame", pa.int32()), ("start_cs", pa.int32()), ("delay_cs", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("samples", pa.binary()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                rows, data = [], batch.column(1)[i].as_py()
                try:
                    for k, f in enumerate(decode(data or b"")):
                        rows.append((k, f.start, f.delay, f.left, f.top, f.width, f.height, f.disposal, f.transparent, f.samples, f.canvas.tobytes(), histogram(f.canvas).tolist(), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((*[None] * 12, str(e) or type(e).__name__))
                columns = [pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema]
                ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(rows)) if rows else batch.column(0).slice(0, 0)
                yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    return media.select(id_col, data_col).mapInArrow(run, f"id {kind}, {FRAMES}")


def pad(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def digest(text: bytes) -> tuple:
    """Stores a padded text as a GIF, reads the file back and computes the digest columns from what was read."""
    stored = encode(pad(text))
    frames, read, colours, shown = 0, [], np.zeros(1 << sum(HISTOGRAM), dtype=np.int64), 0
    for f in decode(stored):
        frames += 1
        shown += f.delay
        read.append(f.samples)
        colours += histogram(f.canvas)
    payload = b"".join(read)
    feature = f"frames={frames};cs={shown};rows={len(payload) // WIDTH};colours={','.join(map(str, colours))}"
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        seen: dict[bytes, tuple] = {}
        for lo in range(0, batch.num_rows, 256):
            rows = []
            for x in texts.slice(lo, 256):
                t = x.as_py() or b""
                key = hashlib.sha256(t).digest()
                if key not in seen:
                    seen[key] = digest(t)
                rows.append(seen[key])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=names)


def store_texts(docs: DataFrame) -> DataFrame:
    """Digest columns of every text stored as a GIF and read back: see ``digest``. A null text is empty; equal texts give equal rows.

    Rows that repeat, also with the same id, are stored each; an empty table
    gives no rows; texts of any length are stored whole, in as many frames as they
    need; other columns, whatever their names, are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _digests, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
