"""Language-model scoring: quantised n-gram counts in log-frequency Bloom filters, probed for smoothed probabilities."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import materialize

#: N-grams of one to so many tokens are counted.
ORDER = 3
#: Filter bits for each stored mark, and probes of a mark: one of 5,000 that were never stored is found.
BITS_PER_KEY = 20
PROBES = 7
#: Counts up to EXACT are levels of their own; above, each level is a factor of STEP, up to LEVELS.
EXACT, STEP, LEVELS = 20, 1.005, 8192
#: Levels above EXACT are stored as two digits, the lower one below FINE.
FINE = 10
#: A filter of at most so many bytes (single tokens' counts included) is broadcast; a larger one is probed by shards.
BROADCAST_BYTES = 16 << 20
#: Weight of the lower order in each order's mixture, in counts (by the length of the n-gram).
PRIOR = {2: 4.0, 3: 2.0}
#: Tokens whose different n-grams are looked up together, and those for each bucket of the filter.
CHUNK_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 20
#: Bytes of text that are cut into words at a time.
PIECE_BYTES = 1 << 20

_U = np.uint64
#: Hashes of the token at the end of a text, and of the place before its first token (no word has either).
END, START = _U(0x1F83D9ABFB41BD6B), _U(0x5BE0CD19137E2179)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0d]")
#: A random number for each byte, the same for A-Z as for a-z.
_LETTER = np.random.default_rng(10).integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_BIT = (1 << np.arange(8)).astype(np.uint8)
#: Longer words are hashed on their own: polynomials modulo 2 ** 64 repeat for some strings of a thousand letters.
LONG_WORD = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PIECE_BYTES that end where words do."""
    at = 0
    while len(text) - at > 2 * PIECE_BYTES:
        gap = _GAP.search(text, at + PIECE_BYTES)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): 64-bit hashes of each text's words with A-Z in lower case, END after each text; tokens in each."""
    if len(texts) == 1 and len(texts[0]) > 2 * PIECE_BYTES:
        words = [_word_hashes([part])[0][:-1] for part in _cut(texts[0])]
        words = np.append(np.concatenate(words), END)
        return words, np.array([len(words)])
    return _word_hashes(texts)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    bits = max(len(data).bit_length(), 16)
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum(_LETTER[data] * _powers(_BASE, bits)[:len(data)], out=prefix[1:])
    gap = _SPACE[data]
    edge = np.diff(gap.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # the last byte is a gap
    inverse = _powers(pow(_BASE, -1, 1 << 64), bits)
    words = _mix((prefix[ends] - prefix[starts]) * inverse[starts] ^ _mix((ends - starts).astype(_U)))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        words[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes().lower())
    closes = np.cumsum([len(t) + 1 for t in texts]) - 1
    upto = np.searchsorted(starts, closes)
    return np.insert(words, upto, END), np.diff(upto, prepend=0) + 1


def level_of(counts: np.ndarray) -> np.ndarray:
    """The level that a count is stored at (0: not at all)."""
    over = np.floor(np.log(np.maximum(counts, EXACT) / EXACT) / np.log(STEP) + 1e-9).astype(np.int64)
    return np.where(counts <= EXACT, counts, np.minimum(EXACT + over, LEVELS)).astype(np.int64)


@cache
def counts_of() -> np.ndarray:
    """The count that each level stands for."""
    low = EXACT * STEP ** np.arange(1, LEVELS - EXACT + 1)
    return np.concatenate([np.arange(EXACT + 1), low * STEP ** 0.5])


class Filter:
    """A Bloom filter of keys and their levels, kept as bytes.

    A key is stored with marks: 1 to its level, or above EXACT 1 to the higher digit and,
    apart from them, 1 to the lower digit. Membership of marks is monotone in each digit.
    """

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        high, low = self._digits(levels)
        bits, most = max(int((high + low).sum()) * BITS_PER_KEY // 8 * 8, 64), int(high.max(initial=0))
        flags = np.zeros(bits, bool)
        for digit, upto, tag in ((high, most, 0), (low, int(low.max(initial=0)), LEVELS)):
            order = np.argsort(-digit, kind="stable")
            sorted_keys, members = keys[order], np.searchsorted(-digit[order], -np.arange(1, upto + 1), side="right")
            for mark, n in enumerate(members.tolist(), 1):
                for at in self._places(*self._hashed(sorted_keys[:n], np.full(n, mark + tag)), bits):
                    flags[at] = True
        self.bits, self.most, self.data = bits, most, np.packbits(flags, bitorder="little")

    @classmethod
    def stored(cls, bits: int, most: int, data: bytes) -> Filter:
        """A filter from what was kept of it."""
        out = cls.__new__(cls)
        out.bits, out.most, out.data = bits, most, np.frombuffer(data, np.uint8)
        return out

    @staticmethod
    def _digits(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        over = np.maximum(levels - EXACT, 0)
        return np.minimum(levels, EXACT) + over // FINE, over % FINE

    @staticmethod
    def _hashed(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys + marks.astype(_U) * _U(0x9E3779B97F4A7C15))
        return h.astype(np.uint32), (h >> _U(32)).astype(np.uint32) | np.uint32(1)

    @staticmethod
    def _places(h: np.ndarray, step: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        """The bit of each probe in turn: 32-bit hashes that step on, scaled to the filter's size."""
        for _ in range(PROBES):
            yield (h.astype(_U) * _U(bits) >> _U(32)).astype(np.int64)
            h = h + step

    def holds(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Whether each key is a member at its mark."""
        h, step = self._hashed(keys, marks)
        on = None  # of the keys that no probe has missed yet
        for _ in range(PROBES):
            at = (h.astype(_U) * _U(self.bits) >> _U(32)).astype(np.int64)
            hit = np.flatnonzero(self.data[at >> 3] & _BIT[at & 7])
            on = hit if on is None else on[hit]
            h, step = h[hit], step[hit]
            h = h + step
        out = np.zeros(len(keys), bool)
        out[on] = True
        return out

    def _digit(self, keys: np.ndarray, most: int, tag: int) -> np.ndarray:
        """A digit of each key: probes double it until one misses, then halve what is left between."""
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), most + 1)
        on, ask = np.arange(len(keys)), 1
        while len(on) and ask <= most:
            hit = self.holds(keys[on], np.full(len(on), ask + tag))
            low[on[hit]], high[on[~hit]] = ask, ask
            on, ask = on[hit], 2 * ask
        on = np.flatnonzero(high - low > 1)
        while len(on):
            mid = (low[on] + high[on]) // 2
            hit = self.holds(keys[on], mid + tag)
            low[on[hit]], high[on[~hit]] = mid[hit], mid[~hit]
            on = on[high[on] - low[on] > 1]
        return low

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level, 0 where it is not held."""
        out = self._digit(keys, self.most, 0)
        above = np.flatnonzero(out >= EXACT)
        out[above] = EXACT + (out[above] - EXACT) * FINE + self._digit(keys[above], FINE - 1, LEVELS)
        return out


def grams(words: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for n from 1 to ORDER; 0 where a text has not so many tokens before.

    The place before a text counts as one token, so that bigrams hold the first words.
    """
    firsts = np.cumsum(sizes) - sizes
    before = np.concatenate([words[:1], words[:-1]])
    before[firsts] = START
    out = [words, _mix(_mix(before) + words)]
    back = np.arange(len(words)) - np.repeat(firsts, sizes)  # tokens of the text before this one
    for n in range(3, ORDER + 1):
        prior = np.concatenate([out[-1][:1], out[-1][:-1]])
        out.append(np.where(back >= n - 2, _mix(_mix(prior + _U(n)) + words), _U(0)))
    return out


def _planes(x: np.ndarray, keep: int) -> bytes:
    """The lower bytes of 64-bit values, by place; slowly varying places compress well."""
    return np.ascontiguousarray(x.astype(_U).view(np.uint8).reshape(-1, 8).T[:keep]).tobytes()


def _plain(data: bytes, keep: int) -> np.ndarray:
    out = np.zeros((len(data) // keep, 8), np.uint8)
    out[:, :keep] = np.frombuffer(data, np.uint8).reshape(keep, -1).T
    return out.view(_U).ravel()


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as the first one and the gaps, in no more bytes than the largest gap needs."""
    gaps = np.diff(values)
    keep = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([keep]) + values[:1].astype(_U).tobytes() + _planes(gaps, keep)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.append(np.frombuffer(data[1:9], _U), _plain(data[9:], data[0])), dtype=_U)


def _small(x: np.ndarray) -> bytes:
    """Non-negative integers in no more bytes than the largest needs."""
    keep = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([keep]) + _planes(x, keep)


def _unsmall(data: bytes) -> np.ndarray:
    return _plain(data[1:], data[0]).astype(np.int64)


def key_bits(total: int) -> int:
    """Bits of the keys that are sent about for ``total`` tokens: 14 more than it takes to number their n-grams, at most 64."""
    return min(64, max(total * ORDER, 1).bit_length() + 14)


def buckets_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The bucket of each key: even ranges of all keys of so many bits, ascending."""
    return ((keys >> _U(bits - 24) if bits > 24 else keys << _U(24 - bits)) * _U(buckets) >> _U(24)).astype(np.int64)


def different(names: np.ndarray, at: np.ndarray, sizes: np.ndarray, bits: int, kinds: range = range(ORDER)) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(keys, places, bits) for each kind (length of n-gram less one): the different keys, ascending, and each token's place among them.

    Keys of single tokens (``names``, with places ``at``) stay whole, others keep ``bits`` bits.
    """
    out = []
    for kind in kinds:
        if kind == 0:
            out.append((names, at, 64))
        else:
            each, place = np.unique(grams(names[at], sizes)[kind] >> _U(64 - bits), return_inverse=True)
            out.append((each, place.ravel(), bits))
    return out


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: the crc32 of its id as text leaves 1 modulo 5 (a null id never does)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


CHUNK = "chunk bigint, n bigint, ids array<{}>, teaches binary, sizes binary, names binary, at binary"


def chunks(docs: DataFrame, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row for each about ``tokens`` tokens of texts: ids, which of them teach, sizes, the different words' hashes, and each token's word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, held = 0, 0, []  # of texts: ids, which teach, sizes, words

        def out() -> pa.RecordBatch:
            ids, teaches, sizes, words = zip(*held)
            ids, (names, at) = pa.concat_arrays(ids), np.unique(np.concatenate(words), return_inverse=True)
            cells = (np.concatenate(teaches).astype(np.uint8).tobytes(), _small(np.concatenate(sizes)), names.tobytes(), _small(at.ravel()))
            return pa.RecordBatch.from_arrays([
                pa.array([name]), pa.array([n]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([c], pa.binary()) for c in cells]],
                names=["chunk", "n", "ids", "teaches", "sizes", "names", "at"])

        for batch in batches:
            upto, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy().astype(np.int64)), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE_BYTES, side="right")))
                part = batch.slice(at, end - at)
                name = name if n else part.column(0)[0].as_py()
                words, sizes = word_hashes([t or b"" for t in part.column(3).to_pylist()])
                held.append((part.column(1), part.column(2).to_numpy(zero_copy_only=False), sizes, words))
                n, at = n + len(words), end
                if n >= tokens:
                    yield out()
                    n, held = 0, []
        if n:
            yield out()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (~held_out(F.col("doc_id"))).alias("teaches"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, CHUNK.format(docs.schema["doc_id"].dataType.simpleString()))


def asks(read: DataFrame, bits: int, buckets: int, kind: int, teach: bool) -> DataFrame:
    """(bucket, chunk, kind, keys, counts): each chunk's different n-grams of one kind by bucket.

    With ``teach`` those of training texts, with their counts there; else those of all texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, at = _unsmall(row["sizes"]), _unsmall(row["at"])
                taught = np.frombuffer(row["teaches"], np.uint8) > 0
                if teach and not taught.all():
                    at, sizes = at[np.repeat(taught, sizes)], sizes[taught]
                if not len(sizes):
                    continue
                keys, place, wide = different(np.frombuffer(row["names"], _U), at, sizes, bits, range(kind, kind + 1))[0]
                n = np.bincount(place, minlength=len(keys)) if teach else np.ones(len(keys), np.int64)
                keys, n = keys[n > 0], n[n > 0]
                where = buckets_of(keys, wide, buckets)
                firsts = np.flatnonzero(np.diff(where, prepend=-1))
                cuts = list(zip(firsts.tolist(), [*firsts[1:].tolist(), len(keys)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(where[firsts]), pa.array([row["chunk"]] * len(cuts), pa.int64()), pa.array([kind] * len(cuts), pa.int32()),
                    pa.array([pack(keys[a:b]) for a, b in cuts], pa.binary()), pa.array([_small(n[a:b]) if teach else b"" for a, b in cuts], pa.binary())],
                    names=["bucket", "chunk", "kind", "keys", "counts"])

    return read.select("chunk", "teaches", "sizes", "names", "at").mapInArrow(run, "bucket bigint, chunk bigint, kind int, keys binary, counts binary")


SHARD = "bucket bigint, kind int, bits bigint, most bigint, data binary, names binary, total bigint, distinct bigint"


def build(table: pa.Table) -> pa.Table:
    """A bucket's shards of the filter, one for each length of n-gram, from the counts of all chunks.

    Of single tokens the shard is the exact table (names, and their counts as data).
    """
    kinds = table["kind"].to_numpy()
    out = []
    for kind in np.unique(kinds).tolist():
        part = table.filter(pa.array(kinds == kind))
        each, place = np.unique(np.concatenate([unpack(k) for k in part["keys"].to_pylist()]), return_inverse=True)
        n = np.bincount(place.ravel(), np.concatenate([_unsmall(c) for c in part["counts"].to_pylist()]), len(each)).astype(np.int64)
        row = {"bucket": part["bucket"][0].as_py(), "kind": kind, "bits": 0, "most": 0, "names": b"", "total": 0, "distinct": 0}
        if kind == 0:
            out.append(row | {"data": _small(n), "names": pack(each), "total": int(n.sum()), "distinct": len(each)})
        else:
            f = Filter(each, level_of(n))
            out.append(row | {"bits": f.bits, "most": f.most, "data": f.data.tobytes()})
    return pa.Table.from_pylist(out, schema=pa.schema([
        ("bucket", pa.int64()), ("kind", pa.int32()), ("bits", pa.int64()), ("most", pa.int64()), ("data", pa.binary()), ("names", pa.binary()),
        ("total", pa.int64()), ("distinct", pa.int64())]))


class Shard:
    """What a bucket holds of one length of n-gram; ``ask`` gives levels, of single tokens counts."""

    def __init__(self, row: dict):
        self.filter = Filter.stored(row["bits"], row["most"], row["data"]) if row["kind"] else None
        if not self.filter:
            self.names, self.counts = unpack(row["names"]), _unsmall(row["data"])

    def ask(self, keys: np.ndarray) -> np.ndarray:
        if self.filter:
            return self.filter.levels(keys)
        at = np.minimum(np.searchsorted(self.names, keys), len(self.names) - 1)
        return np.where(self.names[at] == keys, self.counts[at], 0)


def answer(asked: pa.Table, shards: pa.Table) -> pa.Table:
    """Of one bucket and kind: what its shard says to the n-grams of each chunk, in the order asked; equal ones are probed once."""
    keys = [unpack(k) for k in asked["keys"].to_pylist()]
    each, place = np.unique(np.concatenate([*keys, np.zeros(0, _U)]), return_inverse=True)
    said = np.zeros(len(each), np.int64)
    for r in shards.to_pylist():
        said = Shard(r).ask(each)
    said, edges = said[place.ravel()], np.cumsum([0, *map(len, keys)])
    found = [_small(said[a:b]) for a, b in zip(edges, edges[1:])]
    return pa.Table.from_arrays([asked["chunk"].combine_chunks(), asked["kind"].combine_chunks(), asked["bucket"].combine_chunks(), pa.array(found, pa.binary())],
                                names=["chunk", "kind", "bucket", "found"])


def probabilities(levels: list[np.ndarray], exact: np.ndarray, sizes: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """P(token | those before) for each token, from the levels of the n-grams that end there and the single tokens' counts.

    A token's own probability is (c + 0.5) / (N + 0.5 (V + 1)). Each longer n-gram mixes its
    share of its context's count with the order below, which weighs PRIOR counts:
    (c(context, w) + m P) / (c(context) + m). The place before a text was met as often as
    END. Counts of a context's n-grams add up to its own count, and each is read within a
    quarter of a per cent of it, so the probabilities of all tokens after a context add up
    to one within half a per cent.
    """
    back = np.arange(len(exact)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # tokens of the text before this one
    p, context = (exact + 0.5) / (total + 0.5 * (distinct + 1)), np.roll(exact, 1)
    context = np.where(back == 0, exact[-1], context)
    for n in range(2, ORDER + 1):
        c = counts_of()[levels[n - 1]]
        p = np.where(back >= n - 2, (np.minimum(c, context) + PRIOR[n] * p) / (context + PRIOR[n]), p)
        context = np.roll(c, 1)
    return p


def score_texts(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Model and base scores of every row of ``docs`` (doc_id, text, others ignored).

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Training rows
    are those that ``held_out`` leaves (a null doc_id trains); a null text is empty and has
    the end token alone. base_score is of exact counts. score: log10 of the product of
    ``probabilities``, whose counts of two and three tokens are read from log-frequency
    Bloom filters. Words are told by 64-bit hashes, longer n-grams by ``key_bits`` bits.
    Without training rows counts are zero. Repeated rows each get a row; an empty table
    gives none; a very long text is a chunk of its own.

    The filter grows with the corpus and keeps every count, single ones too. It is built
    once, in shards by ranges of hashes, and written as bytes; tasks that score hold no
    counts of n-grams. While all shards take at most ``broadcast_bytes``, they are
    broadcast and probed where the texts are. Beyond, texts' different n-grams go to their
    shards and levels come back, one length of n-gram after the other, so that shuffles of
    one length only lie on disk. Both ways give the same scores.
    """
    read = materialize(chunks(docs, chunk_tokens), "chunks")
    tokens = read.agg(F.sum("n")).head()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, bits = max(4 * parts, tokens // bucket_tokens + 1), key_bits(tokens)
    each = [materialize(asks(read, bits, buckets, k, True).groupBy("bucket").applyInArrow(build, SHARD), "shards") for k in range(ORDER)]
    shards = reduce(DataFrame.unionAll, each)
    total, distinct, size = (int(x or 0) for x in shards.agg(F.sum("total"), F.sum("distinct"), F.sum(F.octet_length("data") + F.octet_length("names"))).head())

    def score(chunk: dict, found: list[np.ndarray]) -> list[np.ndarray]:
        """sizes, known tokens, logs and scores of a chunk's texts; found: by length of n-gram, what each token's has."""
        sizes, c = _unsmall(chunk["sizes"]), found[0]
        firsts = np.cumsum(sizes) - sizes
        p = probabilities(found, c, sizes, total, distinct)
        return [sizes, *(np.add.reduceat(x, firsts) for x in ((c > 0).astype(np.int64), np.log10(c + 0.5), np.log10(p)))]

    def keys_of(chunk: dict) -> list[tuple[np.ndarray, np.ndarray, int]]:
        return different(np.frombuffer(chunk["names"], _U), _unsmall(chunk["at"]), _unsmall(chunk["sizes"]), bits)

    columns = ["doc_id", "n_tokens", "n_known", "logs", "score"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_known bigint, logs double, score double"
    cells = read.select("chunk", "ids", "sizes", "names", "at")
    if size <= broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in shards.collect()])  # at most ``broadcast_bytes``

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {(r["bucket"], r["kind"]): Shard(r) for r in shared.value}
            for batch in batches:
                for i, chunk in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                    found = []
                    for kind, (keys, place, wide) in enumerate(keys_of(chunk)):
                        where, got = buckets_of(keys, wide, buckets), np.zeros(len(keys), np.int64)
                        edges = [*np.flatnonzero(np.diff(where, prepend=-1)).tolist(), len(keys)]
                        for a, b in zip(edges, edges[1:]):
                            if (int(where[a]), kind) in held:
                                got[a:b] = held[int(where[a]), kind].ask(keys[a:b])
                        found.append(got[place])
                    yield pa.RecordBatch.from_arrays([batch["ids"].slice(i, 1).flatten(), *map(pa.array, score(chunk, found))], names=columns)

        scored = cells.mapInArrow(by_broadcast, schema)
    else:
        def ask(kind: int) -> DataFrame:
            asked = asks(read, bits, buckets, kind, False).select("bucket", "chunk", "kind", "keys")
            return materialize(asked.groupBy("bucket").cogroup(each[kind].groupBy("bucket")).applyInArrow(
                answer, "chunk bigint, kind int, bucket bigint, found binary"), "levels")

        told = reduce(DataFrame.unionAll, map(ask, range(ORDER)))

        def by_shards(answers: pa.Table, table: pa.Table) -> pa.Table:
            got = sorted(answers.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
            chunk = table.drop_columns(["ids"]).to_pylist()[0]
            found = [np.concatenate([_unsmall(r["found"]) for r in got if r["kind"] == k])[place] for k, (_, place, _) in enumerate(keys_of(chunk))]
            return pa.Table.from_arrays([table["ids"].combine_chunks().flatten(), *map(pa.array, score(chunk, found))], names=columns)

        scored = told.groupBy("chunk").cogroup(cells.groupBy("chunk")).applyInArrow(by_shards, schema)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))).alias("base_score"), "score")
