"""Quality classifier: attention-based multiple-instance learning over the passages of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import materialize
from hashloom.llm.lm import word_hashes
from hashloom.llm.toxicity import held_out

#: Words of a passage.
WORDS = 64
#: Labelled rows that train, at most, and passages of all of them together: those of least hash of their id.
TRAINING_ROWS, TRAINING_PASSAGES = 6_000, 60_000
#: Hash values of character trigrams, and the shares that describe a passage besides.
TRIGRAMS, SHARES = 512, 8
#: Units of a passage's representation and of its attention.
HIDDEN, GATES = 32, 16
EPOCHS, BATCH, RATE, DECAY = 16, 64, 0.01, 1e-4
#: Passages that are encoded at a time, and bytes of text.
BLOCK, PIECE_BYTES = 4096, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Each byte as trigrams see it: lower case, one digit, one kind of space.
_SEEN = np.arange(256, dtype=np.uint32)
_SEEN[65:91] += 32
_SEEN[48:58] = 48
_SEEN[_SPACE] = 32
#: Classes of bytes: upper case, digits, marks other than those of plain sentences, beyond ASCII.
_CLASSES = np.zeros((4, 256))
_CLASSES[0, 65:91] = _CLASSES[1, 48:58] = _CLASSES[3, 128:] = 1
_CLASSES[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CLASSES[2, list(b".,;:'\"!?()-")] = 0


@dataclass
class Layout:
    """Where the passages of some texts lie: bytes, words (start, end, passage), and passages of each text."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    passage: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    again: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Layout:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        edge = np.diff(_SPACE[data].astype(np.int8), prepend=1)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        ends = ends[ends > 0]
        tokens, sizes = word_hashes(texts)  # with an end after each text
        words = sizes - 1
        hashes = np.delete(tokens, np.cumsum(sizes) - 1)
        counts = np.maximum(-(-words // WORDS), 1)
        firsts = np.cumsum(words) - words
        place = np.arange(len(hashes)) - np.repeat(firsts, words)
        passage = np.repeat(np.cumsum(counts) - counts, words) + place // WORDS
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (place[1:] > 0)
        return cls(data, starts, ends, passage, counts, hashes, again)


def encode(at: Layout) -> Iterator[np.ndarray]:
    """Features of all passages, BLOCK passages at a time: hashed trigrams of unit length, and shares.

    Each byte of a word gives one trigram with its neighbours (a space at the word's ends).
    Shares: words equal to the one before, different words, upper case, digits, marks,
    bytes beyond ASCII, length of words, number of words. A passage without words is all zeros.
    """
    total = int(at.counts.sum())
    for low in range(0, total, BLOCK):
        n = min(BLOCK, total - low)
        i, j = np.searchsorted(at.passage, [low, low + n])
        out = np.zeros((n, TRIGRAMS + SHARES), np.float32)
        if i < j:
            owner, size = at.passage[i:j] - low, at.ends[i:j] - at.starts[i:j]
            where = np.arange(size.sum()) + np.repeat(at.starts[i:j] - (np.cumsum(size) - size), size)
            of = np.repeat(owner, size)
            seen = _SEEN[at.data]
            before = np.where(where > 0, seen[where - 1], 32)
            code = (before * np.uint32(0x9E3779B1) ^ seen[where] * np.uint32(0x85EBCA77) ^ seen[where + 1] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(23)
            grams = np.log1p(np.bincount(of * TRIGRAMS + code, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS))
            out[:, :TRIGRAMS] = grams / np.maximum(np.sqrt((grams * grams).sum(axis=1)), 1)[:, None]
            words, letters = np.bincount(owner, minlength=n), np.bincount(owner, size, n)
            pairs = np.unique(at.hashes[i:j] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
            columns = [np.bincount(owner, at.again[i:j], n) / np.maximum(words, 1), np.bincount(owner[pairs], minlength=n) / np.maximum(words, 1)]
            columns += [np.bincount(of, kind[at.data[where]], n) / np.maximum(letters, 1) for kind in _CLASSES]
            columns += [np.minimum(letters / np.maximum(words, 1) / 16, 4), np.log1p(words) / 5]
            out[:, TRIGRAMS:] = np.stack(columns, axis=1)
        yield out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Gated attention over passages: h = tanh(x W), a = softmax of w (tanh(h V) * sigmoid(h U)), chance = sigmoid(c sum a h)."""

    SHAPES = {"W": (TRIGRAMS + SHARES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,), "d": (1,)}

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in self.SHAPES.items()}

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(representation, attention before the softmax) of each passage."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        return h, (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]

    def pool(self, h: np.ndarray, e: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights of passages, representation of texts, chance of texts) for texts of so many passages each."""
        firsts, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
        a = np.exp(e - np.maximum.reduceat(e, firsts)[owner])
        a = a / np.add.reduceat(a, firsts)[owner]
        z = np.add.reduceat(a[:, None] * h, firsts, axis=0)
        return a, z, _sigmoid(z @ self.p["c"] + self.p["d"])

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of labels ``y``, with respect to each parameter."""
        p, firsts, owner = self.p, np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
        h, e = self.passages(x)
        up, gate = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a, z, chance = self.pool(h, e, counts)
        off = (chance - y) / len(y)
        back = off[owner, None] * p["c"]
        by_weight = (h * back).sum(axis=1)
        by_e = a * (by_weight - np.add.reduceat(a * by_weight, firsts)[owner])
        by_gated = by_e[:, None] * p["w"]
        by_up, by_gate = by_gated * gate * (1 - up * up), by_gated * up * gate * (1 - gate)
        by_h = (a[:, None] * back + by_up @ p["V"].T + by_gate @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ by_h, "b": by_h.sum(axis=0), "V": h.T @ by_up, "U": h.T @ by_gate, "w": (up * gate).T @ by_e, "c": z.T @ off, "d": off.sum(keepdims=True)}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 0) -> Model:
        """Adam over shuffled batches of texts, with decaying rate; ``x`` holds the passages of all texts."""
        rng, firsts = np.random.default_rng(seed), np.cumsum(counts) - counts
        mean, square, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        mean, square = mean
        steps = EPOCHS * -(-len(y) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for low in range(0, len(y), BATCH):
                on = order[low:low + BATCH]
                n = counts[on]
                rows = np.arange(n.sum()) + np.repeat(firsts[on] - (np.cumsum(n) - n), n)
                step += 1
                rate = RATE * (1 - (step - 1) / steps)
                for k, g in self.gradients(x[rows].astype(np.float32), n, y[on]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    move = mean[k] / (1 - 0.9 ** step) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
                    self.p[k] -= (rate * (move + (DECAY * self.p[k] if k not in "bd" else 0))).astype(np.float32)
        return self

    def texts(self, texts: list[bytes]) -> tuple[Layout, np.ndarray, np.ndarray]:
        """(layout, weights of passages, chance of texts)."""
        at = Layout.of(texts)
        found = [self.passages(x) for x in encode(at)]
        weights, _, chance = self.pool(np.concatenate([h for h, _ in found]), np.concatenate([e for _, e in found]), at.counts)
        return at, weights, chance


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, passages: int) -> list[tuple[bytes, int]]:
    """(text, label) of the labelled rows that train: whole texts in order of their ids' hash, while both bounds hold.

    Of several labels of one doc_id the greatest counts, of several texts the greatest.
    """
    usable = labels.where(f"`{label}` is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce("text", F.lit(""))
    found = materialize(docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(  # at most ``rows`` ids
        F.max("text").alias("text"), F.first("y").alias("y")), "passages-sample")
    n = F.greatest(F.ceil(F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")) / WORDS), F.lit(1)).cast("long")
    sizes = found.select("doc_id", F.xxhash64("doc_id").alias("h"), n.alias("n")).orderBy("h", "doc_id").limit(rows).collect()
    held, most = 0, None
    for r in sizes:
        if held + r["n"] > passages:
            break
        held, most = held + r["n"], (r["h"], r["doc_id"])
    if most is None:
        return []
    inside = (F.xxhash64("doc_id") < most[0]) | ((F.xxhash64("doc_id") == most[0]) & (F.col("doc_id") <= F.lit(most[1])))
    return [(r["text"].encode(), r["y"]) for r in found.where(inside).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, passages: int = TRAINING_PASSAGES, seed: int = 0) -> Model | None:
    """A fitted model, or none without labels of both kinds.

    The fit is bounded: at most ``rows`` labelled texts of together at most ``passages``
    passages reach the driver. Scores cover all rows and whole texts.
    """
    found = sample(docs, labels, label, rows, passages)
    y = np.array([v for _, v in found], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    x, counts, at = [], [], 0
    while at < len(found):
        part, size = [], 0
        while at < len(found) and (not part or size < PIECE_BYTES):
            part.append(found[at][0])
            size, at = size + len(part[-1]), at + 1
        layout = Layout.of(part)
        x.extend(b.astype(np.float16) for b in encode(layout))
        counts.append(layout.counts)
    return Model(seed).fit(np.concatenate(x), np.concatenate(counts), y)


def _run(rows: DataFrame, model: Model, make, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model.p)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model()
        model.p = shared.value
        for batch in batches:
            upto, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE_BYTES, side="right")))
                part = batch.slice(at, end - at)
                yield make(part.column(0), *model.texts([t or b"" for t in part.column(1).to_pylist()]))
                at = end

    return rows.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def score_texts(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, passages: int = TRAINING_PASSAGES, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every row of ``docs`` (doc_id, text, others ignored).

    ``labels`` (doc_id, ``label``) teach, but for held-out ids; nothing but the text goes
    into a score. Every passage of a whole text, however long, is encoded and weighed. Null
    and empty texts have one passage without words, which is scored like any other. Repeated
    rows each get a row; null ids stay; an empty table gives no rows. Without labels of both
    kinds every text scores 1: nothing is known against it.
    """
    model = learn(docs, labels, label, rows, passages)
    if model is None:
        found = docs.select("doc_id", F.lit(1.0).alias("score"), F.greatest(
            F.ceil(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")) / WORDS), F.lit(1)).cast("long").alias("n_passages"))
    else:
        def make(ids: pa.Array, at: Layout, weights: np.ndarray, chance: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(chance.astype(np.float64)), pa.array(at.counts.astype(np.int64))], names=["doc_id", "score", "n_passages"])
        found = _run(docs, model, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_passages bigint")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, passage, weight) of every passage of every text: how much the attention gives it; a text's weights add up to one."""
    def make(ids: pa.Array, at: Layout, weights: np.ndarray, chance: np.ndarray) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(at.counts)), at.counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(at.counts) - at.counts, at.counts)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(place), pa.array(weights.astype(np.float64))], names=["doc_id", "passage", "weight"])
    return _run(docs, model, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, passage bigint, weight double")
