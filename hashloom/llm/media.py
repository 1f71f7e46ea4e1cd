"""Media columns of baseline JPEG files: lossless storage, decoding and thumbnail hashes in numpy."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads fill whole images of 24 x 24 blocks.
UNIT = 576
#: Blocks between restart markers: runs that decode side by side.
RUN = 24
#: Blocks a side that a frame can have (65535 pixels).
SIDE = 8191
#: What ends a scan: a marker other than a restart.
MARKER = re.compile(b"\xff[^\x00\xd0-\xd7]", re.DOTALL)
# The Huffman table of luminance DC sizes that the standard suggests (codes of each length 1 to 16; sizes).
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SIZES = tuple(range(12))
#: The only AC symbol in stored payloads: end of block, as one 0 bit.
AC_LENGTHS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)


def canonical(lengths, symbols) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of a Huffman table given as code counts by length and symbols in order."""
    out, code, at = [], 0, 0
    for bits, count in enumerate(lengths, 1):
        for _ in range(count):
            out.append((symbols[at], code, bits))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(lengths, symbols) -> np.ndarray:
    """Symbol and code length (symbol << 8 | bits) by the next 16 bits; 0 where no code begins."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, code, bits in canonical(lengths, symbols):
        table[code << (16 - bits):(code + 1) << (16 - bits)] = symbol << 8 | bits
    return table


def shape(units: int) -> list[tuple[int, int]]:
    """(rows, columns) of blocks of the frames that hold ``units`` units; one frame up to 8191 units."""
    out = []
    while units:
        n = min(units, SIDE)
        c = next(c for c in (1, 2, 3, 4, 6, 8, 12, 24) if 24 * n // c <= SIDE)
        out.append((24 * n // c, 24 * c))
        units -= n
    return out


def _header(rows: int, columns: int) -> bytes:
    part = lambda marker, body: struct.pack(">BBH", 255, marker, len(body) + 2) + body
    return (
        b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, b"\0" + bytes([8] + [1] * 63))
        + part(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * columns, 1) + b"\1\x11\0")
        + part(0xC4, b"\0" + bytes(DC_LENGTHS) + bytes(DC_SIZES)) + part(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS))
        + part(0xDD, struct.pack(">H", RUN)) + part(0xDA, b"\1\1\0\0\x3f\0"))


def padded(text: bytes) -> bytes:
    """``text`` with bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


@cache
def _step_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits (left-justified, big-endian) and their number: of DC steps -255 to 255 with the end of block, then of 0 to 7 ones."""
    table = {symbol: (code, bits) for symbol, code, bits in canonical(DC_LENGTHS, DC_SIZES)}
    values, widths = [], []
    for step in range(-255, 256):
        size = abs(step).bit_length()
        code, bits = table[size]
        value = ((code << size) | (step if step >= 0 else step + (1 << size) - 1)) << 1
        values.append(value << (15 - bits - size))
        widths.append(bits + size + 1)
    for ones in range(8):
        values.append(((1 << ones) - 1) << (16 - ones))
        widths.append(ones)
    return np.array(values, ">u2"), np.array(widths, np.uint8)


@cache
def _prefixes() -> np.ndarray:
    """Masks of 16 that begin with so many trues."""
    return np.arange(16)[None, :] < np.arange(17)[:, None]


@cache
def _fused(dc: bytes, ac: bytes) -> np.ndarray:
    """By the next 16 bits, where they hold a DC symbol, its value and an end of block: value << 6 | bits << 1 | 1; else 0."""
    d, a, at = lookup(dc[:16], dc[16:]), lookup(ac[:16], ac[16:]), np.arange(1 << 16)
    bits, size = d & 255, d >> 8
    fits = (bits > 0) & (bits + size < 16)
    bits, size = np.where(fits, bits, 1), np.where(fits, size, 0)
    extra = ((at << bits) & 0xFFFF) >> (16 - size)
    value = np.where(size == 0, 0, np.where((extra >> np.maximum(size - 1, 0)) == 0, extra - (1 << size) + 1, extra))
    end = a[(at << (bits + size)) & 0xFFFF]
    fits &= (end > 0) & (end >> 8 == 0) & (bits + size + (end & 255) <= 16)
    return np.where(fits, (value << 6) | ((bits + size + (end & 255)) << 1) | 1, 0).astype(np.int32)


def store(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file (or several, end to end) of each payload: one 8 x 8 block a byte, flat at the byte's grey.

    The quantised DC coefficient is the byte less 128, at step 8 and without AC
    coefficients, so the file's DC-only thumbnail is the payload. Each payload must be a
    positive multiple of UNIT bytes.
    """
    frames = [shape(len(p) // UNIT) for p in payloads]
    sizes = np.array([r * c // RUN for f in frames for r, c in f], np.int64)  # runs of each frame
    runs = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, RUN).astype(np.int16)
    steps = np.empty((len(runs), RUN + 1), np.int16)  # a last column for what fills a run's last byte
    steps[:, 0], steps[:, 1:RUN] = runs[:, 0] + 127, runs[:, 1:] - runs[:, :-1] + 255
    codes, widths = _step_codes()
    width = widths[steps[:, :RUN]]
    total = width.sum(axis=1, dtype=np.int64)
    steps[:, RUN] = 511 + -total % 8
    total = (total + 7) // 8
    first = np.cumsum(total) - total
    steps = steps.ravel()
    every = np.unpackbits(codes[steps].view(np.uint8)).reshape(-1, 16)
    raw = np.packbits(every[_prefixes()[widths[steps]]])
    # room: a zero after each 255, a marker after each run but a frame's last, which is followed by the end of the frame
    last = np.zeros(len(total), bool)
    last[np.cumsum(sizes) - 1] = True
    room = 1 + (raw == 255).astype(np.int64)
    room[first + total - 1] += 2
    place = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[place] = raw
    close = place[first + total - 1] + room[first + total - 1] - 2
    order = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.zeros(0, np.int64)
    out[close] = 255
    out[close + 1] = np.where(last, 0xD9, 0xD0 + order % 8)
    data, cuts = out.tobytes(), (close[last] + 2).tolist()
    files, at_frame, start = [], 0, 0
    for f in frames:
        parts = []
        for r, c in f:
            parts += [_header(r, c), data[start:cuts[at_frame]]]
            start, at_frame = cuts[at_frame], at_frame + 1
        files.append(b"".join(parts))
    return files


@dataclass
class Frame:
    """What the markers of one baseline frame say; scan: the entropy-coded bytes from SOS to the next marker."""
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    order: list[tuple[int, int, int]] = field(default_factory=list)  # component index, DC table, AC table
    steps: dict[int, int] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    scan: bytes = b""
    thumbnail: np.ndarray | None = None


def parse(data: bytes) -> list[Frame]:
    """The frames of a file, which may hold several images end to end. ValueError where it is not baseline JPEG."""
    frames, frame, at = [], None, 0
    while at + 1 < len(data):
        if data[at] != 255:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        at += 2
        if marker == 0xD8:
            frame = Frame()
            continue
        if marker == 0xD9:
            frame = None
            continue
        if marker == 255:
            at -= 1
            continue
        if frame is None or at + 2 > len(data):
            raise ValueError("truncated")
        size = int.from_bytes(data[at:at + 2], "big")
        body, at = data[at + 2:at + size], at + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                frame.steps[body[0] & 15] = int.from_bytes(body[1:2 + wide], "big")
                body = body[1 + 64 * (1 + wide):]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                frame.tables[body[0]] = body[1:17 + n]
                body = body[17 + n:]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples are not of 8 bits")
            frame.height, frame.width = struct.unpack(">HH", body[1:5])
            frame.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            frame.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            by_id = {c[0]: i for i, c in enumerate(frame.components)}
            order = [(by_id[body[i]], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            found = MARKER.search(data, at)
            end = found.start() if found else len(data)
            if any(c == 0 for c, _, _ in order):  # scans without luminance do not count
                frame.order, frame.scan = order, data[at:end]
                frames.append(frame)
            at = end
    if not frames:
        raise ValueError("no scan")
    return frames


def decode(frames: list[Frame]) -> None:
    """Set each frame's thumbnail: one luminance value a block, from DC coefficients alone.

    Frames with equal tables and layout are decoded together, all their restart runs in
    step: each numpy operation advances every run by one symbol.
    """
    groups: dict[tuple, list[Frame]] = {}
    for f in frames:
        key = (tuple(sorted(f.tables.items())), tuple(f.components), tuple(f.order))
        groups.setdefault(key, []).append(f)
    for same in groups.values():
        _decode_group(same)


def _decode_group(frames: list[Frame]) -> None:
    first = frames[0]
    one = len(first.order) == 1
    h0, v0 = first.components[0][1:3]
    hmax, vmax = max(c[1] for c in first.components), max(c[2] for c in first.components)
    tables = {k: lookup(t[:16], t[16:]) for k, t in first.tables.items()}
    # blocks of a unit: (component, DC table, AC table), a lone component has one block a unit
    pattern = [(c, tables[d], tables[0x10 | a], _fused(first.tables[d], first.tables[0x10 | a])) for c, d, a in first.order for _ in range(1 if one else first.components[c][1] * first.components[c][2])]
    grids, counts, starts, pieces, owner = [], [], [], [], []
    at = 0
    for k, f in enumerate(frames):
        if one:  # a lone component's blocks cover its own samples
            rows, columns = -(-(-(-f.height * v0 // vmax)) // 8), -(-(-(-f.width * h0 // hmax)) // 8)
        else:
            rows, columns = -(-f.height // (8 * vmax)), -(-f.width // (8 * hmax))
        grids.append((rows, columns))
        raw = np.frombuffer(f.scan, np.uint8)
        full = np.flatnonzero(raw[:-1] == 255)
        marks = full[raw[full + 1] >= 0xD0]
        keep = np.ones(len(raw), bool)
        keep[full + 1] = False
        keep[marks] = False
        begins = np.concatenate([[0], np.cumsum(keep)[marks]]).astype(np.int64)
        units, step = rows * columns, f.interval or rows * columns
        if len(begins) != -(-units // step):
            raise ValueError("restart markers do not match the interval")
        starts.append(begins + at)
        counts.append(np.minimum(step, units - step * np.arange(len(begins))))
        pieces.append(raw[keep])
        at += int(keep.sum())
        owner.append(len(begins))
    data = np.concatenate([*pieces, np.zeros(8, np.uint8)]).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    limit = len(words) - 1
    pos, count = np.concatenate(starts) * 8, np.concatenate(counts)
    peek = lambda p: (words[np.minimum(p >> 3, limit)] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF
    most = int(count.max())
    luma = sum(c == 0 for c, *_ in pattern)
    out = np.zeros((most, luma, len(pos)), np.int16)
    last = {c: np.zeros(len(pos), np.int64) for c, _, _ in first.order}
    live = None if int(count.min()) == most else count
    for u in range(most):
        on = slice(None) if live is None else np.flatnonzero(live > u)
        p, y = pos[on], 0
        for c, dc, ac, fused in pattern:
            word = peek(p)
            short = fused[word]
            if short.all():
                last[c][on] += short >> 6
                p = p + ((short >> 1) & 31)
                if c == 0:
                    out[u, y, on] = last[c][on]
                    y += 1
                continue
            code = dc[word]
            if not code.all():
                raise ValueError("no such code")
            p = p + (code & 255)
            size = code >> 8
            extra = peek(p).astype(np.int64) >> (16 - size)
            value = last[c][on] + np.where((extra >> np.maximum(size - 1, 0)) == 0, extra - (1 << size) + 1, extra) * (size > 0)
            p = p + size
            last[c][on] = value
            if c == 0:
                out[u, y, on] = value
                y += 1
            code = ac[peek(p)]
            p = p + (code & 255)
            symbol = code >> 8
            if symbol.any() or not code.all():
                _skip_ac(p, code, ac, peek)
        pos[on] = p
    at = 0
    for f, n, (rows, columns) in zip(frames, owner, grids):
        dc = out[:, :, at:at + n].transpose(2, 0, 1)[: n]
        units = np.concatenate([dc[i, :k] for i, k in enumerate(count[at:at + n].tolist())]) if n > 1 and count[at + n - 1] != count[at] else dc.reshape(-1, luma)
        units = units[: rows * columns]
        v, h = (1, 1) if one else (v0, h0)
        plane = units.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h).astype(np.int64)
        grey = (plane * f.steps[f.components[0][3]] + 4) // 8 + 128
        high, wide = -(-(-(-f.height * v0 // vmax)) // 8), -(-(-(-f.width * h0 // hmax)) // 8)
        f.thumbnail = np.clip(grey, 0, 255).astype(np.uint8)[:high, :wide]
        at += n


def _skip_ac(p: np.ndarray, code: np.ndarray, ac: np.ndarray, peek) -> None:
    """Advance ``p`` in place past the AC coefficients of a block whose first symbol, ``code``, has been read."""
    on = np.arange(len(p))
    k = np.ones(len(p), np.int64)
    while len(on):
        if not code.all():
            raise ValueError("no such code")
        symbol = code >> 8
        run, size = symbol >> 4, symbol & 15
        p[on] += size
        k = k + run + 1
        more = ((size > 0) | (run == 15)) & (k < 64)
        on, k = on[more], k[more]
        code = ac[peek(p[on])]
        p[on] += code & 255


def feature(frames: list[Frame]) -> str:
    """WIDTHxHEIGHT:average hash:hash of the thumbnail, for each frame, comma-joined."""
    out = []
    for f in frames:
        t = f.thumbnail
        rows, columns = np.arange(8) * t.shape[0] // 8, np.arange(8) * t.shape[1] // 8
        heights = np.diff(np.append(rows, t.shape[0])).clip(1)
        sums = np.add.reduceat(np.add.reduceat(t.astype(np.int64), rows, axis=0), columns, axis=1)
        cells = sums / (heights[:, None] * np.diff(np.append(columns, t.shape[1])).clip(1)[None, :])
        mean = np.packbits(cells > cells.mean()).tobytes().hex()
        out.append(f"{f.width}x{f.height}:{mean}:{xxhash.xxh64_hexdigest(t.tobytes())}")
    return ",".join(out)


def describe(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with width, height and feature of the JPEG files in ``column`` (binary).

    Null cells and cells that are not whole baseline JPEG files get nulls. Columns of
    these names are replaced. Several frames in a cell: width and height of the first.
    """
    keep = [c for c in media.columns if c not in ("width", "height", "feature", "_at")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(keep.index(column)).to_pylist():
                try:
                    frames = parse(data or b"")
                    decode(frames)
                    found.append((frames[0].width, frames[0].height, feature(frames)))
                except (ValueError, KeyError, IndexError, struct.error):
                    found.append((None, None, None))
            extra = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*keep, "width", "height", "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*keep).schema)
    return media.select(*keep).mapInArrow(run, f"{schema}, width int, height int, feature string")


def store_texts(docs: DataFrame, batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, media) of every row of ``docs`` (doc_id, text, others ignored): each text as a JPEG file in a binary column.

    Texts are padded to whole units; a null text is stored like an empty one. Repeated rows and null doc_ids
    stay, very long texts take several frames of one file, an empty table gives none. ``batch_bytes``: how much text is coded in step.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _steps([x or 0 for x in pc.binary_length(texts).to_pylist()], batch_bytes):
                part = [t or b"" for t in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(map(len, part), pa.int64()), pa.array(store([padded(t) for t in part]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {key}, n_bytes bigint, media binary")


def _steps(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with at most ``most`` bytes together, or of one."""
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= most):
            size, end = size + max(sizes[end], UNIT), end + 1
        yield at, end
        at = end


def read_back(stored: DataFrame, batch_bytes: int = 1 << 21) -> DataFrame:
    """What the files of ``store_texts`` hold, decoded from the column ``media``.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256
    and feature of every row. A cell that is null or no whole baseline JPEG file is an error.
    Repeated rows each get a row; an empty table gives none.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2)
            for a, b in _steps([x or 0 for x in pc.binary_length(cells).to_pylist()], batch_bytes):
                files = cells.slice(a, b - a).to_pylist()
                parsed, rows = [parse(f) for f in files], []
                decode([f for frames in parsed for f in frames])
                for data, frames in zip(files, parsed):
                    payload = b"".join(f.thumbnail.tobytes() for f in frames)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(frames)))
                found = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *found], names=["doc_id", "n_bytes", *names])

    key = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        run, f"doc_id {key}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
