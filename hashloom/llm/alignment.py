"""Cross-tokenizer alignment: an event sweep over the token ends of two tokenizers."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import materialize

#: End events of one side that lie within so many bytes of a document travel in one row.
WINDOW = 1 << 16
#: Texts that are encoded at a time, and their bytes.
TEXTS, TEXT_BYTES = 64, 1 << 20
#: Events that are swept at a time, and links for each row of the written table.
EVENTS, LINKS = 1 << 20, 1 << 20


#: White space too long for the faster library.
_GAP = re.compile(r"\s{4096}")
# Fixed value: how byte-level files of this kind cut a text before merging.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts than this without white space are left to the slower library, which takes them in n log n.
LONG_CUT = 1 << 14


class SideA:
    """The byte-level tokenizer of a file: ids of texts, and the bytes of each id.

    Where the file says that its ids are the ranks of its merges and that nothing but CUTS
    cuts or changes a text, ids come from a faster library that merges by rank; they are
    the same. Any other file is left to its own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.codec = Tokenizer.from_file(path)
        self.codec.encode_special_tokens = True  # their strings in a text are plain text
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocabulary = self.codec.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.ranked = self._ranked(json.loads(self.codec.to_str()))

    def _ranked(self, told: dict):
        model, cut = told["model"], told["pre_tokenizer"] or {}
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
        plain = (model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not told["normalizer"] and not model.get("continuing_subword_prefix")
                 and cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True) and not model.get("end_of_word_suffix"))
        if not plain or any(b <= a for a, b in zip([255, *merged], merged)) or {len(self.tokens[i]) for i in range(256)} != {1} or len(merged) + 256 > len(self.tokens):
            return None
        from tiktoken import Encoding
        return Encoding("ranked", pat_str=CUTS, mergeable_ranks={self.tokens[i]: i for i in [*range(256), *merged]}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked and all(len(t) <= LONG_CUT or max(map(len, t.split()), default=0) <= LONG_CUT and not _GAP.search(t) for t in texts):
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.codec.encode_batch_fast(texts, add_special_tokens=False)]


class SideB:
    """The piece tokenizer: ids of texts (it adds the space before them itself), and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.codec = SentencePieceProcessor(model_file=path)
        pieces = map(self.codec.id_to_piece, range(self.codec.get_piece_size()))
        self.tokens = [bytes([int(p[3:5], 16)]) if self.codec.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.codec.encode(texts, num_threads=1)


@cache
def sides(a: str, b: str) -> tuple[SideA, SideB]:
    """Both tokenizers, once a worker."""
    return SideA(a), SideB(b)


@cache
def _kind(a: str, b: str) -> type:
    """What ids are sent as."""
    return np.uint16 if max(len(side.tokens) for side in sides(a, b)) <= 1 << 16 else np.uint32


@cache
def widths(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each id, by side."""
    return tuple(np.array([len(t) for t in side.tokens], np.int64) for side in sides(a, b))


def events(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(row, side, at, doc_id, ids): both sides' end events of every document, as ids of the tokens that end in a window at ``at``.

    A token's length follows from its id, so its end is the sum of lengths so far. The row
    of side 0 and window 0 has the doc_id; of a document without tokens it is the only one.
    """
    key = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, lengths, kind = sides(a, b), widths(a, b), _kind(a, b)
        for batch in batches:
            for rows, names, texts in _slices(batch):
                spaced = [" " + t for t in texts]
                found = both[0].encode(spaced), both[1].encode(texts)
                out: tuple[list, ...] = [], [], [], [], []
                for i, text in enumerate(spaced):
                    ids = [side[i] for side in found]
                    if not texts[i] or any(b"".join(map(s.tokens.__getitem__, x)) != text.encode() for s, x in zip(both, ids)):
                        ids = [[], []]
                    for side, x in enumerate(map(np.array, ids)):
                        window = (np.cumsum(lengths[side][x]) - 1) // WINDOW if len(x) else np.zeros(0, np.int64)
                        edges = [*np.flatnonzero(np.diff(window, prepend=-1)).tolist(), len(x)]
                        starts = [0] if not len(x) and side == 0 else edges[:-1]
                        for s, e in zip(starts, edges[1:] or [0]):
                            for column, value in zip(out, (rows[i], side, int(window[s]) * WINDOW if len(x) else 0, names[i], x[s:e].astype(kind).tobytes())):
                                column.append(value)
                if out[0]:
                    name = pa.array([n if s == 0 and at == 0 else None for n, s, at in zip(out[3], out[1], out[2])], batch.schema.field(1).type)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), name, pa.array(out[4], pa.binary())],
                        names=["row", "side", "at", "doc_id", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"row bigint, side int, at bigint, doc_id {key.simpleString()}, ids binary")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list[str]]]:
    """Rows, doc_ids and texts of a few documents at a time."""
    start = 0
    sizes = pc.binary_length(batch.column(2)).to_numpy()
    while start < batch.num_rows:
        end = start + 1
        held = sizes[start]
        while end < batch.num_rows and end - start < TEXTS and held + sizes[end] <= TEXT_BYTES:
            held += sizes[end]
            end += 1
        yield tuple(batch.column(c).slice(start, end - start).to_pylist() for c in range(3))
        start = end


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the ascending x are in the ascending y."""
    return np.append(y, -1)[np.searchsorted(y, x)] == x


def _digits(mark: str, ids: int) -> list[str]:
    return [f"{i}{mark}" for i in range(ids)]


class Sweep:
    """The state between events: the open document's totals and the tokens of its open group.

    Ends that both sides share close a group; each span between two neighbouring ends is
    the overlap of one token of A with one of B, which is a link. Only tokens since the
    last shared end are kept, as their group's ids of A come before those of B.
    """

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths = lengths
        self.words = [w for mark in ",|;" for w in _digits(mark, max(map(len, lengths)))]
        self.row, self.name, self.open = None, None, [np.zeros(0, np.int64)] * 2
        self._clear()

    def _clear(self) -> None:
        self.n = [0, 0, 0, 0]
        self.hash = hashlib.sha256()

    def close(self) -> list:
        """Totals of the document that ends: doc_id, tokens by side, groups, links, hash."""
        out = [self.name, *self.n, self.hash.hexdigest() if self.n[2] else ""]
        self._clear()
        return out

    def feed(self, rows: list[int], names: list, at_side: list[int], ids: list[np.ndarray]) -> tuple[list[list], np.ndarray]:
        """(closed documents, links): rows sorted by document, window and side; links are pairs of ids, in order of documents."""
        starts = [i for i, r in enumerate(rows) if r != (rows[i - 1] if i else self.row)]
        heads = [names[i] for i in starts]  # a document's first row has its doc_id
        size = len(self.lengths[1])
        sides, docs = [], []
        order = np.zeros(len(rows), np.int64)
        order[starts] = 1
        order = np.cumsum(order)  # 0: the document that was open before
        for side in (0, 1):
            on = [i for i, s in enumerate(at_side) if s == side]
            sides.append(np.concatenate([self.open[side], *(ids[i] for i in on)]).astype(np.int64))
            docs.append(np.concatenate([np.zeros(len(self.open[side]), np.int64), *(np.full(len(ids[i]), order[i]) for i in on)]).astype(np.int64))
        ends = [np.cumsum(w[x]) for w, x in zip(self.lengths, sides)]
        shared = [_among(ends[0], ends[1]), _among(ends[1], ends[0])]
        upto = [int(np.flatnonzero(s)[-1]) + 1 if s.any() else 0 for s in shared]
        self.open = [x[k:] for x, k in zip(sides, upto)]
        ids_, ends, shared, docs = ([x[:k] for x, k in zip(v, upto)] for v in (sides, ends, shared, docs))
        group = [np.cumsum(s) - s for s in shared]
        # the place of each token in the written order: its group's tokens of A, then those of B
        upto_group = [np.cumsum(np.bincount(g)) if len(g) else np.zeros(0, np.int64) for g in group]
        place = [np.arange(upto[0]) + np.append(0, upto_group[1])[group[0]], np.arange(upto[1]) + upto_group[0][group[1]]]
        code = np.zeros(sum(upto), np.int64)
        wide = len(self.words) // 3
        code[place[0]] = ids_[0] + wide * shared[0]
        code[place[1]] = ids_[1] + 2 * wide * shared[1]
        span = np.sort(np.concatenate(ends), kind="stable")  # two sorted runs
        span = span[np.diff(span, prepend=-1) > 0]
        of = [np.searchsorted(e, span) for e in ends]
        links = ids_[0][of[0]] * size + ids_[1][of[1]]
        last = len(starts)
        count = lambda d: np.bincount(d, minlength=last + 1)
        totals = np.stack([count(docs[0]), count(docs[1]), count(docs[0][shared[0]]), count(docs[0][of[0]])], axis=1)
        edges = np.append(0, np.cumsum(totals[:, 0] + totals[:, 1]))
        written = code.tolist()
        closed = []
        for d in range(last + 1):
            if d:
                if self.row is not None:
                    closed.append(self.close())
                self.row, self.name = rows[starts[d - 1]], heads[d - 1]
            if edges[d + 1] > edges[d]:
                text = "".join(map(self.words.__getitem__, written[edges[d]:edges[d + 1]]))[:-1]
                self.hash.update((";" * (self.n[2] > 0) + text).encode())
                self.n = [x + y for x, y in zip(self.n, totals[d].tolist())]
        return closed, links


SWEPT = "chunk bigint, ids array<{}>, totals array<bigint>, hashes array<string>, pairs array<bigint>, counts array<bigint>, links binary"


def sweep(sorted_events: DataFrame, a: str, b: str, links: int = LINKS) -> DataFrame:
    """One row for each about ``links`` links: doc_ids, four totals of each document, hashes, the different pairs with counts, each link's pair."""
    key = sorted_events.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep(widths(a, b))
        held: tuple[list, list] = [], []
        chunk = None

        def out(kind: pa.DataType, done: list[list], found: np.ndarray) -> pa.RecordBatch:
            pairs, at, n = np.unique(found, return_inverse=True, return_counts=True)
            cells = [[d[0] for d in done], [x for d in done for x in d[1:5]], [d[5] for d in done], pairs, n]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, k)) for c, k in zip(cells, kinds)]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists, pa.array([at.ravel().astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32).tobytes()], pa.binary())],
                                              names=["chunk", "ids", "totals", "hashes", "pairs", "counts", "links"])

        kind, sent = None, _kind(a, b)
        for batch in batches:
            kind = batch.schema.field(3).type
            upto, at = np.cumsum(pc.binary_length(batch.column(4)).to_numpy().astype(np.int64) // np.dtype(sent).itemsize), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + EVENTS, side="right")))
                part = batch.slice(at, end - at)
                ids = [np.frombuffer(x, sent) for x in part.column(4).to_pylist()]
                rows = part.column(0).to_pylist()
                chunk = rows[0] if chunk is None else chunk
                done, found = state.feed(rows, part.column(3).to_pylist(), part.column(1).to_pylist(), ids)
                held[0].extend(done)
                held[1].append(found)
                at = end
                closed = sum(d[4] for d in held[0])
                if closed >= links:
                    every = np.concatenate(held[1])
                    yield out(kind, held[0], every[:closed])
                    held, chunk = ([], [every[closed:]]), state.row
        if state.row is not None:
            held[0].append(state.close())
            yield out(kind, held[0], np.concatenate(held[1]))

    return sorted_events.select("row", "side", "at", "doc_id", "ids").mapInArrow(run, SWEPT.format(key))


def align(docs: DataFrame, a: str, b: str, links: int = LINKS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): alignment of every row of ``docs`` (doc_id, text, others ignored), and how often each pair of ids is linked.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; pairs:
    a_id, b_id, count, is_best (no pair of that b_id counts more). Null and empty texts,
    and those whose tokens do not spell a space and the text on both sides, have no tokens:
    zeros and an empty hash. Repeated rows each get a row and count each; ties are all best;
    null doc_ids stay; an empty table gives no rows. Very long texts are swept window by
    window, with a document's open group as state.

    End events of both tokenizers are dealt out by document and sorted by place; one
    sweep of a partition emits groups and links. Pairs are counted a chunk of documents
    before they are shuffled, and each chunk asks once for its different pairs, so nothing
    is broadcast, and a frequent pair is one row a chunk. Rows are told by the place in
    which ``docs`` gives them, which must be the same if a task runs again (as files do).
    """
    found = events(docs, a, b).repartition("row").sortWithinPartitions("row", "at", "side")
    told = materialize(sweep(found, a, b, links), "links")
    size = len(widths(a, b)[1])
    met = told.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    met = materialize(met.withColumn("b_id", F.col("pair") % size), "pairs")
    best = met.groupBy("b_id").agg(F.max("count").alias("top"))
    pairs = met.join(best, "b_id").select("pair", F.expr(f"pair div {size}").alias("a_id"), "b_id", "count", (F.col("count") == F.col("top")).alias("is_best"))
    asked = told.select("chunk", F.posexplode("pairs").alias("place", "pair")).join(pairs.select("pair", "count", "is_best"), "pair").select(F.col("chunk").alias("of"), "place", "count", "is_best")

    def score(answers: pa.Table, chunk: pa.Table) -> pa.Table:
        places = answers["place"].to_numpy()
        count, top = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        count[places], top[places] = answers["count"].to_numpy(), answers["is_best"].to_numpy()
        ids, hashes = (chunk[c].combine_chunks().flatten() for c in ("ids", "hashes"))
        totals = chunk["totals"].combine_chunks().flatten().to_numpy().reshape(-1, 4)
        edges = np.append(0, np.cumsum(totals[:, 3]))
        cell = chunk["links"][0].as_py()
        at = np.frombuffer(cell, np.uint16 if len(cell) == 2 * edges[-1] else np.uint32)
        sums = [np.diff(np.append(0, np.cumsum(x[at]))[edges]) for x in (top, count)]
        return pa.Table.from_arrays([ids, *(pa.array(c) for c in (*totals.T.copy(), *sums)), hashes], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = docs.schema["doc_id"].dataType.simpleString()
    scored = asked.groupBy("of").cogroup(told.select("chunk", "ids", "totals", "hashes", "links").groupBy("chunk")).applyInArrow(
        score, f"doc_id {key}, " + ", ".join(f"{n} bigint" for n in names[1:-1]) + ", groups_sha256 string")
    return scored, pairs.drop("pair")
