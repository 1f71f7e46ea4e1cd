"""SentencePiece encoding and decoding: an Aho-Corasick automaton feeding a single-pass Viterbi."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Stands for a literal SPACE of the text, which must not come back as a blank; no valid text holds it.
LITERAL = "\udfff"
#: What an unknown character costs beyond the worst piece.
UNKNOWN = 10.0
#: Words kept encoded in each worker: two generations of so many.
KEPT = 200_000


def read_model(path: str) -> tuple[list[tuple[str, float, int]], list[int]]:
    """((piece, score, id) of text pieces, id of each byte piece or -1) of a model file; read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, of_byte = [], [-1] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            of_byte[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), model.get_score(i), i))
    return pieces, of_byte


class Codec:
    """Best-score segmentation of texts into pieces, with bytes for unknown characters.

    A blank is written SPACE, and one SPACE is put before a text that is not empty. The
    segmentation of a text is that of highest total score; of equal totals the one whose
    last piece is longest, as the automaton meets longer pieces first. Texts are cut where no piece can
    reach across (before a SPACE after another character, around line ends), which leaves
    the optimum as it is and lets equal words be encoded once.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], of_byte: list[int]):
        if min(of_byte) < 0:
            raise ValueError("the model lacks byte pieces: unknown characters could not be decoded")
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.of_byte = of_byte
        self.unknown = min(s for _, s, _ in pieces) - UNKNOWN
        cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in pieces)
        lines = not any("\n" in p and p != "\n" for p, _, _ in pieces)
        self.units = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if cuts and lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if cuts else "(?s).+")
        self.bytes_of = {i: bytes([b]) for b, i in enumerate(of_byte)} | {i: p.replace(SPACE, " ").encode() for p, _, i in pieces}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def viterbi(self, unit: str) -> list[int]:
        n = len(unit)
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        reached = 0  # ends before this are final: every match of theirs has been seen
        for last, (size, score, i) in self.automaton.iter(unit):
            end = last + 1
            while reached + 1 < end:
                reached += 1
                self._unknown(best, back, reached)
            total = best[end - size] + score
            if total > best[end]:
                best[end], back[end] = total, (size, i)
        while reached < n:
            reached += 1
            self._unknown(best, back, reached)
        out: list[int] = []
        at = n
        while at:
            size, i = back[at]
            if i < 0:
                raw = unit[at - 1].replace(LITERAL, SPACE).encode()
                out.extend(self.of_byte[b] for b in reversed(raw))
            else:
                out.append(i)
            at -= size
        return out[::-1]

    def _unknown(self, best: list[float], back: list[tuple[int, int]], end: int) -> None:
        """An end that no single-character piece reaches may take its character as unknown."""
        if back[end][0] != 1 and best[end - 1] + self.unknown > best[end]:
            best[end], back[end] = best[end - 1] + self.unknown, (1, -1)

    def _unit(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            found = np.array(self.viterbi(unit), np.int32).tobytes()
        if len(self.young) >= KEPT:
            self.old, self.young = self.young, {}
        if len(unit) < 64:
            self.young[unit] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as packed 32-bit integers; an empty or null text has none."""
        if not text:
            return b""
        whole = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
        get, unit = self.young.get, self._unit
        return b"".join([get(u) or unit(u) for u in self.units.findall(whole)])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 come back as replacement characters."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip for every row of ``docs`` (doc_id, text, others ignored).

    ids: array of int, the best-score segmentation of the whole text. round_trip: whether
    decoding them gives the text back, which it always does; a null text counts as empty
    and has no ids. Null doc_ids and repeated rows stay; very long texts are read whole, in
    time linear in their length; an empty table gives none. The model (its size is that of
    its vocabulary) is read from path ``model`` on the driver and broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                texts = batch.column(1).to_pylist()
                packed = [codec.encode(t) for t in texts]
                sizes = np.array([len(p) // 4 for p in packed], np.int32)
                ids = np.frombuffer(b"".join(packed), np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int32)]).astype(np.int32)
                whole = [codec.decode(np.frombuffer(p, np.int32).tolist()) == (t or "") for p, t in zip(packed, texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(sizes.astype(np.int64)), pa.array(whole)],
                    names=["doc_id", "ids", "n_tokens", "round_trip"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, ids array<int>, n_tokens bigint, round_trip boolean")


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text, no ids an empty one, an empty table no rows. Lists of any length are read whole."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    key = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {key}, text string")
