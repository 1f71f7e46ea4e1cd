"""Removal of byte strings that an earlier document has: anchored candidates, then a hash-compared suffix sort.

Every string of LENGTH bytes has one anchor, the least-hashed K-byte string in it (the
first of equals), so equal strings have equal anchors at equal places. Strings that
follow one another and share an anchor form a stretch; most repeated text consists of
equal stretches, which a document's bytes give in about one of fifteen places. Stretches
are matched by hash across documents. Different stretches of one anchor can share a
string only if they agree on the bytes before the anchor or on those after it, half of
what a string has besides; where they do, the suffixes of these, and only these, are
sorted, dealt out by anchor and those bytes: a frequent anchor between many different
texts is no single group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from hashloom.llm.common import materialize

LENGTH, K = 50, 20
#: Bytes beside the anchor, before or after, that each string must have.
SIDE = (LENGTH - K) // 2
#: Text bytes for each bucket of anchors, and for each group of documents that is read back.
BUCKET_BYTES = 6 << 20
#: Text that is hashed at a time, and longest piece of a document.
CHUNK = 1 << 19
#: Entries held before a task sends them off.
HELD = 600_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
NEVER = (1 << 63) - 1
#: A stretch's hash is its lower 48 bits; the upper ones tell the bytes before and after the anchor.
STRETCH = _U((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    return x ^ (x >> _U(29))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(int(n).bit_length(), 16))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2 ** 64, of bytes sent through a random table."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTER[data] * powers(_BASE, len(data))[: len(data)], out=out[1:])
    return out


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, order, low, high, anchor, stretch, at) of all stretches: window starts low to high, two hashes, and the anchor's place.

    Anchors are told by 48 bits, stretches by 48 bits and 8 for either side of the anchor.
    """
    parts, held, size = [], [], 0
    counts = [0] * len(texts)

    def flush():
        nonlocal held, size
        if not held:
            return
        data = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        sizes = np.array([len(t) for _, _, t in held])
        ends = np.cumsum(sizes)
        prefix, inverse = prefix_hashes(data), powers(_INVERSE, len(data))
        n = len(data) - K + 1
        grams = _mix((prefix[K:] - prefix[:n]) * inverse[:n])
        least = (grams & ~_U((1 << 24) - 1)) | np.arange(n, dtype=_U)
        width, wanted = 1, LENGTH - K + 1
        while width < wanted:
            step = min(width, wanted - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = (least & _U((1 << 24) - 1)).astype(np.int64)
        piece = np.repeat(np.arange(len(held)), sizes)[: len(at)]
        start = np.arange(len(at))
        valid = start + LENGTH <= ends[piece]
        start, at, piece = start[valid], at[valid], piece[valid]
        firsts = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
        lasts = np.append(firsts[1:], len(at)) - 1
        low, high, at, piece = start[firsts], start[lasts], at[firsts], piece[firsts]
        begin = (ends - sizes)[piece]

        def side(i: np.ndarray, fits: np.ndarray) -> np.ndarray:
            """8 bits of the SIDE bytes from i on, 0 where the text does not reach so far."""
            i = np.where(fits, i, 0)
            return np.where(fits, _mix((prefix[i + SIDE] - prefix[i]) * inverse[i]) % _U(255) + _U(1), _U(0))

        sides = side(at - SIDE, at - SIDE >= begin) << _U(48) | side(at + K, at + K + SIDE <= ends[piece]) << _U(56)
        whole = _mix((prefix[high + LENGTH] - prefix[low]) * inverse[low] ^ _mix((high - low).astype(_U) + _U(77)))
        doc, base = np.array([d for d, _, _ in held])[piece], np.array([b for _, b, _ in held])[piece]
        shift = np.concatenate([[0], np.cumsum(sizes)[:-1]])[piece]
        order = np.zeros(len(doc), np.int64)
        for d in np.unique(doc):
            a, b = np.searchsorted(doc, [d, d + 1])
            order[a:b] = counts[d] + np.arange(b - a)
            counts[d] += int(b - a)
        parts.append((doc, order, low - shift + base, high - shift + base, grams[at] >> _U(16), whole & STRETCH | sides, at - shift + base))
        held, size = [], 0

    for d, text in enumerate(texts):
        for base in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            piece = text[base:base + CHUNK + LENGTH - 1]
            if size + len(piece) > CHUNK:
                flush()
            held.append((d, base, piece))
            size += len(piece)
    flush()
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U, np.int64))
    return tuple(np.concatenate(c) for c in zip(*parts))


# Packed rows: entries of fixed-width columns, one binary cell each.
ROWS = "key bigint, kind int, doc binary, row binary, place binary, anchor binary, stretch binary"
NAMES = ["key", "kind", "doc", "row", "place", "anchor", "stretch"]


def _planes(x: np.ndarray, keep: int = 8) -> bytes:
    """Byte planes of 64-bit values, lowest first, without the upper ones; slowly varying planes compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[:keep]).tobytes()


def _plain(data: bytes, keep: int = 8) -> np.ndarray:
    out = np.zeros((len(data) // keep, 8), np.uint8)
    out[:, :keep] = np.frombuffer(data, np.uint8).reshape(keep, -1).T
    return out.view(_U).ravel()


def _packed(key: np.ndarray, kind: int, doc: np.ndarray, row: np.ndarray, place: np.ndarray, anchor: np.ndarray, stretch: np.ndarray) -> list[tuple]:
    """One row for each key; entries come in the order of anchors."""
    order = np.lexsort((anchor, key))
    key, doc, row, place, anchor, stretch = (x[order] for x in (key, doc, row, place, anchor, stretch))
    firsts = np.flatnonzero(np.diff(key, prepend=-1))
    rows = []
    for a, b in zip(firsts.tolist(), np.append(firsts[1:], len(key)).tolist()):
        names, back = np.unique(np.stack([doc[a:b], row[a:b]]), axis=1, return_inverse=True)
        gaps = np.diff(anchor[a:b], prepend=_U(0))
        rows.append((int(key[a]), kind, names.tobytes(), _planes(back.ravel().astype(_U), 3), _planes(place[a:b].astype(_U), 4),
                     _planes(gaps) if kind == 0 else b"", _planes(stretch[a:b], 8 if kind == 0 else 1)))
    return rows


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """(doc, row, place, anchor, stretch) of the entries of packed rows."""
    out = []
    for r in rows:
        names = np.frombuffer(r["doc"], np.int64).reshape(2, -1)
        back = _plain(r["row"], 3).astype(np.int64)
        anchor = np.cumsum(_plain(r["anchor"]), dtype=_U) if r["kind"] == 0 else np.zeros(len(back), _U)
        out.append((names[0][back], names[1][back], _plain(r["place"], 4).astype(np.int64), anchor, _plain(r["stretch"], 8 if r["kind"] == 0 else 1)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    return tuple(np.concatenate(c) for c in zip(*out))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


_TYPES = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
#: What is known of a stretch: an earlier document has it, others may share a string on its anchor's side before, or after (added up).
REMOVED, BEFORE, AFTER = 1, 2, 4


def _ask(buckets: int):
    """Stretches of all documents, by bucket of their anchor (kind 0), and answers that are known at once (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            doc, row, place, anchor, stretch = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((doc, stretch & STRETCH, anchor))
            doc, row, place, anchor, stretch = (x[order] for x in (doc, row, place, anchor, stretch))
            fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ((stretch[1:] ^ stretch[:-1]) & STRETCH != 0)])
            first = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            known = doc > first  # a smaller document of this very batch has it
            rows = []
            if known.any():
                k = known
                rows += _packed(row[k] % buckets, 1, doc[k], row[k], place[k], anchor[k], np.full(int(k.sum()), REMOVED, _U))
            k = ~known
            rows += _packed((anchor[k] % _U(buckets)).astype(np.int64), 0, doc[k], row[k], place[k], anchor[k], stretch[k])
            return _batch(rows, NAMES, _TYPES)

        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            ids, keys = ids.to_numpy(), keys.to_numpy()
            for at in range(0, batch.num_rows, 256):
                d, order, _, _, anchor, stretch, _ = stretches([t or b"" for t in texts.slice(at, 256).to_pylist()])
                if len(d):
                    held.append((ids[at + d], keys[at + d], order, anchor, stretch))
                    n += len(d)
                if n >= HELD:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()
    return run


def _answer(buckets: int):
    """Of a bucket's stretches: those of later documents (REMOVED), and those that others of their anchor may share a string with (BEFORE, AFTER)."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ready = [tuple(r[n] for n in NAMES) for r in rows if r["kind"] == 1]
        doc, row, place, anchor, stretch = _unpacked([r for r in rows if r["kind"] == 0])
        if len(doc):
            order = np.lexsort((doc, stretch & STRETCH, anchor))
            doc, row, place, anchor, stretch = (x[order] for x in (doc, row, place, anchor, stretch))
            group = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            fresh = group | np.concatenate([[True], (stretch[1:] ^ stretch[:-1]) & STRETCH != 0])
            at = np.flatnonzero(fresh)
            first = doc[at]  # the least document of each different stretch
            of = np.cumsum(group)[at] - 1
            alike = np.zeros(len(at), np.int64)
            for shift, told in ((48, BEFORE), (56, AFTER)):  # stretches of one anchor and one side, of different documents
                side = (stretch[at] >> _U(shift)) & _U(255)
                turn = np.lexsort((side, of))
                starts = np.flatnonzero(np.concatenate([[True], (of[turn][1:] != of[turn][:-1]) | (side[turn][1:] != side[turn][:-1])]))
                differ = np.minimum.reduceat(first[turn], starts) < np.maximum.reduceat(first[turn], starts)
                sizes = np.diff(np.append(starts, len(turn)))
                alike[turn] += told * (np.repeat(differ, sizes) & (side[turn] > 0))
            kind = np.cumsum(fresh) - 1
            code = np.where(doc > first[kind], REMOVED, alike[kind])
            k = code > 0
            if k.any():
                ready += _packed(row[k] % buckets, 1, doc[k], row[k], place[k], anchor[k], code[k].astype(_U))
        return pa.Table.from_batches([_batch(ready, NAMES, _TYPES)])
    return run


class Answers:
    """Answers by (doc, row): arrays of (place, code)."""

    def __init__(self, rows: list[dict]):
        doc, row, place, _, code = _unpacked(rows)
        order = np.lexsort((row, doc))
        self.doc, self.row, self.place, self.code = doc[order], row[order], place[order], code[order]

    def of(self, doc: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.doc, doc), np.searchsorted(self.doc, doc, side="right")
        c, d = a + np.searchsorted(self.row[a:b], row), a + np.searchsorted(self.row[a:b], row, side="right")
        return self.place[c:d], self.code[c:d]


def _runs(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes that windows (their starts, ascending) cover."""
    if not len(windows):
        return windows, windows
    breaks = np.flatnonzero(np.diff(windows) > LENGTH)
    return windows[np.concatenate([[0], breaks + 1])], windows[np.append(breaks, len(windows) - 1)] + LENGTH


def _summary(text: bytes, windows: np.ndarray) -> tuple[int, int, bytes, str]:
    """(n_bytes, n_removed, spans, kept_sha256) when the bytes of all ``windows`` (starts) go; spans: starts, then ends, as 64-bit numbers."""
    starts, ends = _runs(np.sort(windows))
    kept, at = hashlib.sha256(), 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), int((ends - starts).sum()), np.concatenate([starts, ends]).astype("<i8").tobytes(), kept.hexdigest()


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the ranges low to high, both included."""
    sizes = high - low + 1
    return np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


PARTS = "part int, key bigint, doc bigint, null_id boolean, row bigint, n_bytes bigint, n_removed bigint, spans binary, kept_sha256 string, text binary, windows binary, low bigint, mark bigint"
_PARTS = ["part", "key", "doc", "null_id", "row", "n_bytes", "n_removed", "spans", "kept_sha256", "text", "windows", "low", "mark"]
_PART_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
DONE, WAITING, SUFFIXES = 0, 1, 2


def _halves(text: bytes, low: int, high: int, at: int, anchor: int, code: int) -> Iterator[tuple[int, int, int]]:
    """(mark, first, last): the open strings of a stretch, from starts first to last, that have SIDE bytes before the anchor, and the others, with SIDE after it.

    Equal strings have their anchors at equal places, so they are of one half, and equal
    in the anchor and those SIDE bytes, of which the mark is a hash.
    """
    for told, first, last, side in ((BEFORE, low, min(high, at - SIDE), at - SIDE), (AFTER, max(low, at - SIDE + 1), high, at + K)):
        if code & told and first <= last:
            name = b"%d %d " % (anchor, told) + text[side:side + SIDE]
            yield int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little") >> 1, first, last


def _apply(buckets: int):
    """Documents whose answers are final (DONE), others with what is settled so far (WAITING), and open halves of stretches (SUFFIXES)."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found, rows = Answers(answers.to_pylist()), []
        ids, nulls, keys, texts = (docs.column(n).to_pylist() for n in ("doc", "null_id", "row", "text"))
        for at in range(0, len(ids), 256):
            part = [t or b"" for t in texts[at:at + 256]]
            got = [found.of(ids[at + i], keys[at + i]) for i in range(len(part))]
            some = [i for i, (p, _) in enumerate(got) if len(p)]
            d, _, low, high, anchor, _, middle = stretches([part[i] for i in some])
            bounds = np.searchsorted(d, np.arange(len(some) + 1))
            where = {i: k for k, i in enumerate(some)}
            for i, text in enumerate(part):
                doc, null, row = ids[at + i], nulls[at + i], keys[at + i]
                windows, still = np.zeros(0, np.int64), {}
                if i in where:
                    a, b = bounds[where[i]], bounds[where[i] + 1]
                    place, code = got[i]
                    gone = np.unique(place[code == REMOVED])
                    windows = _ranges(low[a:b][gone], high[a:b][gone])
                    still = code > REMOVED
                    still = {k: c for k, c in zip(place[still].tolist(), code[still].tolist())}
                    for k in gone.tolist():
                        still.pop(k, None)
                if not still:
                    rows.append((DONE, None, doc, null, row, *_summary(text, windows), None, None, None, None))
                    continue
                rows.append((WAITING, row % buckets, doc, null, row, None, None, None, None, text, windows.astype(np.int64).tobytes(), None, None))
                for k, c in still.items():
                    k += a
                    for mark, lo, hi in _halves(text, int(low[k]), int(high[k]), int(middle[k]), int(anchor[k]), c):
                        rows.append((SUFFIXES, mark % buckets, doc, null, row, None, None, None, None, text[lo:hi + LENGTH], None, lo, mark))
        return pa.Table.from_batches([_batch(rows, _PARTS, _PART_TYPES)])
    return run


class Suffixes:
    """Strings of LENGTH bytes at places of one byte array, compared by prefix hashes."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.prefix, self.inverse = prefix_hashes(self.data), powers(_INVERSE, len(self.data) + 1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common extension, LENGTH at most: a binary search over hash comparisons."""
        out = np.zeros(len(x), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            reach = out + step
            fits = reach <= LENGTH
            r = np.where(fits, reach, 0)
            same = (self.prefix[x + r] - self.prefix[x]) * self.inverse[x] == (self.prefix[y + r] - self.prefix[y]) * self.inverse[y]
            out = np.where(fits & same, reach, out)
        return out

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the string at x comes before that at y; -1 stands for one after all others."""
        a, b = np.maximum(x, 0), np.maximum(y, 0)
        n = np.minimum(self.common(a, b), LENGTH - 1)
        before = self.data[a + n] < self.data[b + n]
        return np.where(x < 0, False, np.where(y < 0, True, before))

    def merge(self, both: np.ndarray) -> np.ndarray:
        """Rows of two sorted halves, merged: each element's rank in the other half by binary search."""
        rows, width = both.shape[0], both.shape[1] // 2
        left, right = both[:, :width], both[:, width:]

        def rank(of: np.ndarray, among: np.ndarray, equal_counts: bool) -> np.ndarray:
            low, high = np.zeros(of.shape, np.int64), np.full(of.shape, width, np.int64)
            for _ in range(width.bit_length()):
                mid = (low + high) // 2
                probe = np.take_along_axis(among, np.minimum(mid, width - 1), 1)
                x, y = of.ravel(), probe.ravel()
                up = (~self.less(x, y) if equal_counts else self.less(y, x)).reshape(of.shape) & (low < high)
                low, high = np.where(up, mid + 1, low), np.where(up | (low >= high), high, mid)
            return low

        out = np.empty_like(both)
        at = np.arange(rows)[:, None]
        out[at, np.arange(width) + rank(left, right, False)] = left
        out[at, np.arange(width) + rank(right, left, True)] = right
        return out

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """``starts`` in the order of their strings: by their first eight bytes, then groups that tie by mergesort, strings of one hash as one."""
        head = np.zeros(len(starts), _U)
        for i in range(8):
            head = (head << _U(8)) | self.data[starts + i].astype(_U)
        whole = (self.prefix[starts + LENGTH] - self.prefix[starts]) * self.inverse[starts]
        order = np.lexsort((whole, head))
        every, head, whole = starts[order], head[order], whole[order]
        runs = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (whole[1:] != whole[:-1])])) if len(head) else np.zeros(0, np.int64)
        ends = np.append(runs[1:], len(head)) - 1
        ordered = self._merged(every[runs], head[runs])
        by = np.argsort(every[runs])
        run = by[np.searchsorted(every[runs], ordered, sorter=by)]
        return every[_ranges(runs[run], ends[run])]

    def _merged(self, starts: np.ndarray, head: np.ndarray) -> np.ndarray:
        """``starts``, in the order of ``head``, in the order of their strings."""
        starts = starts.copy()
        firsts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(firsts, len(starts)))
        classes = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        for c in np.unique(classes):
            if c == 0:
                continue
            every = np.flatnonzero(classes == c)
            step = max(1, (1 << 18) >> c)
            for k in range(0, len(every), step):
                groups = every[k:k + step]
                width = 1 << int(c)
                cell = firsts[groups][:, None] + np.arange(width)
                real = np.arange(width) < sizes[groups][:, None]
                table = np.where(real, starts[np.where(real, cell, 0)], -1)
                run = 1
                while run < width:
                    table = self.merge(table.reshape(-1, 2 * run)).reshape(len(groups), width)
                    run *= 2
                starts[cell[real]] = table[real]
        return starts

    def classes(self, starts: np.ndarray) -> np.ndarray:
        """A number for each sorted string, equal for equal ones. Equal hashes are verified byte by byte; a collision raises."""
        if not len(starts):
            return starts
        same = self.common(starts[:-1], starts[1:]) == LENGTH
        for at in range(0, len(starts) - 1, 1 << 16):
            part = np.flatnonzero(same[at:at + (1 << 16)]) + at
            a, b = (self.data[starts[part + s][:, None] + np.arange(LENGTH)] for s in (0, 1))
            if not (a == b).all():
                raise ValueError("hash collision")
        return np.concatenate([[0], np.cumsum(~same)])


def _sorted_classes(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = Suffixes(data)
    try:
        ordered = s.sort(starts)
        return ordered, s.classes(ordered)
    except ValueError:  # told apart by their bytes, whatever the hashes say
        ordered = np.array(sorted(starts.tolist(), key=lambda x: data[x:x + LENGTH]), np.int64)
        return ordered, np.concatenate([[0], np.cumsum([data[a:a + LENGTH] != data[b:b + LENGTH] for a, b in zip(ordered[:-1], ordered[1:])])]).astype(np.int64)


def _settle(buckets: int):
    """Of a bucket's open stretches: the windows of later documents, found by sorting all suffixes."""
    def run(table: pa.Table) -> pa.Table:
        mark, doc = table.column("mark").to_numpy(), table.column("doc").to_numpy()
        turn = np.argsort(mark)
        firsts = np.flatnonzero(np.concatenate([[True], np.diff(mark[turn]) != 0]))
        shared = np.minimum.reduceat(doc[turn], firsts) < np.maximum.reduceat(doc[turn], firsts)
        met = np.sort(turn[np.repeat(shared, np.diff(np.append(firsts, len(turn))))])  # what one document alone has settles itself
        if not len(met):
            return pa.Table.from_batches([_batch([], NAMES, _TYPES)])
        texts, docs, rows, lows = (table.column(n).take(pa.array(met)).to_pylist() for n in ("text", "doc", "row", "low"))
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        starts = _ranges(begins, begins + sizes - LENGTH)
        owner = np.repeat(np.arange(len(texts)), sizes - LENGTH + 1)
        ordered, label = _sorted_classes(b"".join(texts), starts)
        own = owner[np.searchsorted(starts, ordered)]
        doc = np.array(docs, np.int64)[own]
        firsts = np.flatnonzero(np.diff(label, prepend=-1))
        gone = doc > np.minimum.reduceat(doc, firsts)[label]
        own, place = own[gone], (ordered - begins[own] + np.array(lows, np.int64)[own])[gone]
        row = np.array(rows, np.int64)[own]
        packed = _packed(row % buckets, 1, doc[gone], row, place, np.zeros(len(own), _U), np.full(len(own), REMOVED, _U)) if len(own) else []
        return pa.Table.from_batches([_batch(packed, NAMES, _TYPES)])
    return run


def _finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
    found, rows = Answers(answers.to_pylist()), []
    for r in docs.to_pylist():
        place, _ = found.of(r["doc"], r["row"])
        windows = np.unique(np.concatenate([np.frombuffer(r["windows"], np.int64), place]))
        rows.append((r["doc"], r["null_id"], r["row"], *_summary(r["text"], windows)))
    return pa.Table.from_batches([_batch(rows, ["doc", "null_id", "row", "n_bytes", "n_removed", "spans", "kept_sha256"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()])])


def _row(docs: DataFrame) -> Column:
    """Number of a row, by id and text."""
    return F.abs(F.xxhash64("doc_id", "text") % F.lit(1 << 62))


def _ranked(docs: DataFrame) -> DataFrame:
    """(doc_id, number) of the different ids, numbered in their order: texts of integers by value, before all others by themselves."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    order = ids.orderBy(F.col("doc_id").cast("string").try_cast("long").asc_nulls_last(), "doc_id")
    return materialize(order.select("doc_id", F.monotonically_increasing_id().alias("number")), "ids")  # ascending in a sorted table


def find_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, row, n_bytes, n_removed, spans and kept_sha256 of every row of ``docs`` (doc_id, text, others ignored).

    spans: what goes, as 64-bit little-endian numbers: starts of maximal runs of bytes, ascending, then their ends (exclusive).
    row: hash of id and text. Texts are UTF-8 bytes, null and empty ones have none. Each byte goes that
    is covered by a LENGTH-byte string which also starts in a document of smaller doc_id;
    strings are judged on the input, and never cross documents. Rows of one doc_id do not
    remove from each other, so repeated rows give equal rows. doc_ids may be of any type that sorts: texts of integers
    come first, by value, then others by themselves; null ones count as larger than all, and as equal. Long texts are
    read in pieces. An empty table gives none.
    Removal by equal stretches rests on 48 hash bits of the anchor and 48 of the stretch;
    open stretches are verified byte by byte.
    """
    key = docs.schema["doc_id"].dataType
    ranked = None if isinstance(key, IntegralType) else _ranked(docs)
    docs = docs.select("doc_id", "text") if ranked is None else docs.select("doc_id", "text").join(ranked, "doc_id", "left")
    number = F.col("doc_id").cast("long") if ranked is None else F.col("number")
    base = docs.select(F.coalesce(number, F.lit(NEVER)).alias("doc"), number.isNull().alias("null_id"), _row(docs).alias("row"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // bucket_bytes + 1)
    asked = base.select("doc", "row", "text").mapInArrow(_ask(buckets), ROWS)
    answered = materialize(asked.groupBy("key").applyInArrow(_answer(buckets), ROWS), "answers")
    keyed = base.withColumn("key", F.col("row") % buckets)
    parts = materialize(keyed.groupBy("key").cogroup(answered.groupBy("key")).applyInArrow(_apply(buckets), PARTS), "substrings", partition_by="part")
    wait, opened = parts.where(F.col("part") == WAITING), parts.where(F.col("part") == SUFFIXES)
    settled = opened.select("key", "text", "doc", "row", "low", "mark").groupBy("key").applyInArrow(_settle(buckets), ROWS)
    last = wait.select("key", "doc", "null_id", "row", "text", "windows").groupBy("key").cogroup(settled.groupBy("key")).applyInArrow(
        _finish, "doc bigint, null_id boolean, row bigint, n_bytes bigint, n_removed bigint, spans binary, kept_sha256 string")
    out = parts.where(F.col("part") == DONE).select(*last.columns).union(last)
    told = F.when(~F.col("null_id"), F.col("doc")).cast(key)
    if ranked is not None:
        out, told = out.join(ranked.withColumnRenamed("number", "doc"), "doc", "left"), F.col("doc_id")
    return out.select(told.alias("doc_id"), "row", "n_bytes", "n_removed", "spans", "kept_sha256")


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``docs``, all columns, its ``text`` without the bytes of ``find_repeats``.

    Bytes of characters that a span cuts in two become U+FFFD. Null texts stay null.
    """
    found = find_repeats(docs, bucket_bytes).where("n_removed > 0").select(F.col("row").alias("_row"), "spans").dropDuplicates(["_row"])
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("binary").alias("text"), _row(docs).alias("_row")).join(found, "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is not None and spans:
                    starts, ends = np.frombuffer(spans, "<i8").reshape(2, -1).tolist()
                    text = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)]))
                texts.append(None if text is None else text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "kept"])

    kept = rows.select("row", "text", "spans").mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, kept string")
    return kept.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
