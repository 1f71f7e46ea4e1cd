"""Toxicity: a gapped-subsequence string kernel, a support vector machine over Nyström landmarks."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import materialize

#: Subsequences of four characters within so many neighbouring ones count, each missing character at a factor of DECAY.
SPAN, DECAY = 6, 0.5
#: Characters of a unit in one window; longer units are cut into overlapping windows, so none is left out.
WIDTH = 24
#: Labelled rows that train, at most: those of least hash of their id. All other figures cover all rows.
TRAINING_ROWS = 12_000
#: Words of toxic texts, and other words, that the machine learns from, at most (parameters of ``learn``).
POSITIVES, NEGATIVES = 1_500, 6_000
#: Shares of a word's places that may lie in clean texts, as labels can be wrong, for it to be a bad example; ``learn`` takes the best of them.
SPARED = (0.0, 0.02, 0.05, 0.1)
LANDMARKS = 512
#: Insults of so many ordinary words each are learned from windows of the text, these many at most.
WINDOWS, PHRASES = (2, 3), 500
#: Bound on the expected number of windows that are taken for insults by chance.
CHANCE = 0.01
#: Subsequences are told apart by this many hash values.
CODES = 1 << 18
#: Positions of a subsequence's later characters after its first.
OFFSETS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
_ALONE = re.compile(r"(?:(?<=\s)|^)\w(?:\s+\w){2,}(?=\s|$)")
_LETTERS = {chr(c): c - 96 for c in range(97, 123)}
#: Codes: 0 none, 1 to 26 a to z, 27 to 29 other letters, 30 digits, 31 a word's first and last place.
EDGE = 31
#: What describes a text: its three greatest margins and the logarithm of its number of units.
SIGNS = 4


def units(text: str | None) -> list[str]:
    """What is scored: a text's words in lower case, and each run of three or more lone characters as one word."""
    low = (text or "").lower()
    return low.split() + [re.sub(r"\s+", "", m) for m in _ALONE.findall(low)]


def plain(unit: str) -> str:
    """A unit's letters and digits."""
    return "".join(filter(str.isalnum, unit))


@cache
def _code(c: str) -> int:
    return _LETTERS.get(c) or (30 if c.isdigit() else 27 + ord(c) % 3 if c.isalnum() else 0)


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owner): windows of character codes, zero-padded, and the word each belongs to.

    Characters that are neither letters nor digits are left out, so that marks put
    between letters change nothing. A word without any has one empty window.
    """
    rows, owner = [], []
    for k, word in enumerate(words):
        inner = bytes(filter(None, map(_code, word)))
        codes = b"\x1f" + inner + b"\x1f" if inner else b""
        for at in range(0, max(len(codes) - SPAN, 1), WIDTH - SPAN):
            rows.append(codes[at:at + WIDTH].ljust(WIDTH, b"\0"))
            owner.append(k)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH).astype(np.int32), np.array(owner, np.int64)


@cache
def _norms() -> np.ndarray:
    """By length: the norm in feature space of a window whose subsequences all differ."""
    squares = np.zeros(WIDTH + 1)
    for *_, c in OFFSETS:
        squares += np.maximum(np.arange(WIDTH + 1) - c, 0) * DECAY ** (2 * (c - 3))
    return np.sqrt(np.maximum(squares, 1e-9)).astype(np.float32)


def features(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pattern of gaps, the (hashed) subsequences of each row, 0 where there is none, and their weight."""
    for a, b, c in OFFSETS:
        n = WIDTH - c
        last = codes[:, c:]
        index = ((codes[:, :n] << 15) | (codes[:, a:a + n] << 10) | (codes[:, b:b + n] << 5) | last) * 40503 >> 4 & CODES - 1
        yield np.where(last > 0, index | 1, 0), DECAY ** (c - 3)


def lengths(codes: np.ndarray) -> np.ndarray:
    return _norms()[(codes > 0).sum(axis=1)]


class Machine:
    """A trained scorer of units: kernel values with all landmarks, folded into one weight a subsequence.

    The kernel is that of gap-weighted subsequences, normalised by the lengths of both words.
    """

    def __init__(self, weights: np.ndarray, offset: float, members: frozenset[str] = frozenset()):
        self.weights, self.offset, self.members = weights, offset, members
        self.known: dict[str, float] = {}
        self.parts: dict[str, str | None] = {}  # a word's letters, if they are a member

    def windows(self, words: list[str]) -> list[str]:
        """Windows of neighbouring words that all are members: words that learned insults of several words have."""
        if not self.members:
            return []
        fresh = set(words) - self.parts.keys()
        if len(self.parts) + len(fresh) > 600_000:
            self.parts.clear()
            fresh = set(words)
        for w in fresh:
            p = plain(w)
            self.parts[w] = p if p in self.members else None
        at = [self.parts[w] for w in words]
        found = []
        for i in [i for i, p in enumerate(at) if p is not None]:
            for n in WINDOWS:
                run = at[i:i + n]
                if len(run) < n or run[-1] is None:
                    break
                found.append(" ".join(run))
        return found

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -np.inf)
        for at in range(0, len(words), 2048):
            codes, owner = encode(words[at:at + 2048])
            total = np.zeros(len(codes), np.float32)
            for index, weight in features(codes):
                total += self.weights[index].sum(axis=1) * np.float32(weight)
            np.maximum.at(out, owner + at, total / lengths(codes) + self.offset)
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """SIGNS of each text; margins that a short text lacks are those of an empty unit."""
        counts, lists = [], []
        for t in texts:
            own = units(t)
            counts.append(len(own))
            lists.append(own + self.windows((t or "").lower().split()))
        fresh = list({w for words in lists for w in words} - self.known.keys())
        if len(self.known) + len(fresh) > 600_000:
            self.known.clear()
            fresh = list({w for words in lists for w in words})
        self.known.update(zip(fresh, self.margins(fresh).tolist()))
        get = self.known.__getitem__
        rest = [self.offset] * 3
        return np.array([[*heapq.nlargest(3, [*map(get, words), *rest]), math.log1p(n)] for n, words in zip(counts, lists)]).reshape(-1, SIGNS)


def spoilt(word: str) -> list[str]:
    """Two forms of a word with a character put in (a letter of its own, at a third and at two thirds)."""
    a, b = len(word) // 3, 2 * len(word) // 3
    return [word[:a] + "x" + word[a:], word[:b] + word[0] + word[b:]] if len(word) > 3 else []


def train(bad: list[str], good: list[str]) -> Machine:
    """A machine that separates ``bad`` words from ``good`` ones; without both, one of margin -1 for all.

    Good words that a first machine takes for bad ones become landmarks of a second.
    Bad words also teach in two forms with a character put in. The squared-hinge machine
    is fitted in the landmarks' feature map by Newton's method, both classes weighing the
    same.
    """
    if not bad or not good:
        return Machine(np.zeros(CODES, np.float32), -1.0)
    even = lambda words, n: [words[i * len(words) // n] for i in range(n)] if len(words) > n else words
    first = _fit(bad, even(good, 2000), even(bad, LANDMARKS // 2) + even(good, LANDMARKS // 4))
    near = [good[i] for i in np.argsort(-first.margins(good), kind="stable")[: LANDMARKS // 2]]
    return _fit(bad, good, even(bad, LANDMARKS // 2) + near)


def _fit(bad: list[str], good: list[str], marks: list[str]) -> Machine:
    marks = sorted(set(marks))
    used: dict[int, int] = {}
    codes, owner = encode(marks)
    scale = 1 / lengths(codes)
    parts = [(index, weight) for index, weight in features(codes)]
    for i in np.unique(np.concatenate([index.ravel() for index, _ in parts])).tolist():
        used[i] = len(used)
    place = np.zeros(CODES, np.int64)  # place 0: not in any landmark
    place[list(used)] = np.arange(len(used))
    table = np.zeros((len(used), len(marks)), np.float32)
    for index, weight in parts:
        np.add.at(table, (place[index], np.broadcast_to(owner[:, None], index.shape)), weight * scale[:, None])
    table[0] = 0

    def kernel(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(marks)))
        for at in range(0, len(words), 512):
            codes, owner = encode(words[at:at + 512])
            dense = np.zeros((len(codes), len(used)), np.float32)
            for index, weight in features(codes):
                np.add.at(dense, (np.arange(len(codes))[:, None], place[index]), np.float32(weight))
            np.maximum.at(out, owner + at, dense @ table / lengths(codes)[:, None])
        return out

    values, vectors = np.linalg.eigh(kernel(marks))
    root = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T
    forms = [f for w in bad for f in spoilt(w)]
    x = np.c_[kernel(bad + forms + good) @ root, np.ones(len(bad) + len(forms) + len(good))]
    y = np.r_[np.ones(len(bad) + len(forms)), -np.ones(len(good))]
    each = np.r_[np.full(len(bad), 0.4 / len(bad)), np.full(len(forms), 0.1 / max(len(forms), 1)), np.full(len(good), 0.5 / len(good))]
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, 1e-5), 1e-9]
    for _ in range(25):
        on = y * (x @ w) < 1
        a = x[on] * each[on][:, None]
        fresh = np.linalg.solve(a.T @ x[on] + np.diag(ridge), a.T @ y[on])
        if np.abs(fresh - w).max() < 1e-6:
            break
        w = w + (fresh - w) * (1.0 if _ < 15 else 0.5)
    weights = np.zeros(CODES, np.float32)
    weights[list(used)] = table @ (root @ w[:-1])
    weights[0] = 0
    return Machine(weights, float(w[-1]))


def calibrate(signs: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Logistic coefficients from SIGNS (and a constant) to the chance of label 1, by Newton steps with a small ridge.

    Without texts of both kinds, or where no margin tells texts apart (nothing was learned),
    they give every text a chance of 0.05, as length alone says nothing.
    """
    if not len(signs) or toxic.min() == toxic.max() or np.ptp(signs[:, :3]) == 0:
        return [*[0.0] * SIGNS, math.log(0.05 / 0.95)]
    x = np.c_[signs, np.ones(len(signs))]
    w = np.zeros(SIGNS + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(SIGNS + 1)
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (toxic - p) - 1e-2 * w), -2, 2)
    return w.tolist()


def unlike(signs: np.ndarray, toxic: np.ndarray, half: np.ndarray) -> float:
    """Mean negative log likelihood of labels, by halves: each is told by coefficients that the other half gives."""
    total = 0.0
    for h in (0, 1):
        w = np.array(calibrate(signs[half != h], toxic[half != h]))
        line = np.clip(signs[half == h] @ w[:-1] + w[-1], -30, 30)
        total += float(np.logaddexp(0, np.where(toxic[half == h] > 0, -line, line)).sum())
    return total / max(len(toxic), 1)


def held_out(key: Column) -> Column:
    """Whether a document's label is kept from training: the crc32 of its id as text leaves 2 modulo 4 (a null id never does)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _signs(rows: DataFrame, machine: Machine, carried: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((machine.weights, machine.offset, machine.members))  # of fixed size
    names = [*carried, "signs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Machine(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = scorer.texts(part.column(len(carried)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found.tolist(), pa.list_(pa.float64()))], names=names)

    kept = rows.select(*carried, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(run, f"{schema}, signs array<double>" if carried else "signs array<double>")


def phrases(sample: DataFrame, most: int = PHRASES) -> tuple[list[str], list[str]]:
    """(insults of several words, other windows of their words) from texts with the label of each.

    A window of WINDOWS words counts once for each pair of neighbours, as words do. It is an
    insult if so many of its places lie in toxic texts that, at the rate of all windows,
    CHANCE such windows are expected among all (a large-deviation bound over their number).
    """
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for w in map(plain, (text or "").lower().split()) if w]
                around = ["", *words, ""]
                seen = {(" ".join(words[i:i + n]), crc32(f"{around[i]} {around[i + n + 1]}".encode()), toxic) for n in WINDOWS for i in range(len(words) - n + 1)}
                if seen:
                    columns = [pa.array(c, t) for c, t in zip(zip(*seen), (pa.string(), pa.int64(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["phrase", "place", "toxic"])

    met = materialize(sample.select("text", "toxic").mapInArrow(places, "phrase string, place bigint, toxic int").distinct().groupBy("phrase").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where("bad + good > 1"), "toxicity-windows")
    total, bad, good = met.agg(F.count("*"), F.sum("bad"), F.sum("good")).head()
    if not total or not bad or not good:
        return [], []
    rate = bad / (bad + good)
    b, n = F.col("bad"), F.col("bad") + F.col("good")
    part = lambda x, r: F.when(x > 0, x * F.log(x / n / r)).otherwise(0.0)
    surprise = part(b, rate) + part(F.col("good"), 1 - rate)
    told = met.where(b / n > max(rate, 1 - max(SPARED))).where(surprise > math.log(total / CHANCE))
    found = sorted(r["phrase"] for r in told.orderBy(surprise.desc(), "phrase").limit(most).collect())
    if not found:
        return [], []
    members = sorted({w for f in found for w in f.split(" ")})
    inside = F.size(F.array_except(F.split("phrase", " "), F.array(*map(F.lit, members)))) == 0
    rest = met.where(inside & (b == 0)).orderBy(F.xxhash64("phrase"), "phrase").limit(4 * most).collect()
    return found, sorted(r["phrase"] for r in rest)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, positives: int = POSITIVES, negatives: int = NEGATIVES) -> tuple[Machine, list[float]]:
    """(machine, coefficients) from the labelled rows that are not held out, ``rows`` of them at most.

    The fit is bounded: it sees ``rows`` labelled documents, and of their words the
    ``positives`` most frequent bad ones and ``negatives`` others. Scores cover all rows.

    Words of three letters or digits and more count, stripped of other marks, once for
    each pair of neighbours, so that copies of a text weigh as one.
    A word is a bad example if it has three such places in toxic texts and at most a share
    of all its places in others, a good one if it has more there. Two thirds of the rows teach
    words, the others how margins turn into chances. Insults of several words that are
    ordinary ones by themselves are learned from windows (``phrases``). The share is that of SPARED whose chances
    suit the others best (``unlike``), the least of equals; held-out rows have no say in it.
    """
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic")), "toxicity-sample")  # at most ``rows`` ids

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = ["", *("".join(filter(str.isalnum, u)) for u in units(text)), ""]
                seen.update((w, crc32(f"{a} {c}".encode()), toxic) for a, w, c in zip(words, words[1:], words[2:]) if len(w) > 2)
            if seen:
                columns = [pa.array(c, t) for c, t in zip(zip(*seen), (pa.string(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "place", "toxic"])

    teaches = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0
    met = sample.where(teaches).select("text", "toxic").mapInArrow(places, "word string, place bigint, toxic int").distinct().groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    met = materialize(met, "toxicity-words")
    several, others = phrases(sample.where(teaches))
    best, examples = None, None
    for share in SPARED:
        insult = F.expr(f"bad >= 3 and good <= {share} * (bad + good)")
        bad = [r["word"] for r in met.where(insult).orderBy(F.desc("bad"), "word").limit(positives).collect()]
        clean = met.where("good > 0").where(~insult)
        good = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(negatives * 3 // 4).collect()]
        good += [r["word"] for r in clean.orderBy(F.desc("good"), "word").limit(negatives // 4).collect()]
        good = sorted(set(good))
        if (bad, good) == examples:
            continue
        examples = bad, good
        known = set(bad)
        insults = [f for f in several if known.isdisjoint(f.split(" "))]  # those with a bad word are found by that
        machine = train(bad + insults, sorted({*good, *others}) if insults else good)
        machine.members = frozenset(w for f in insults for w in f.split(" "))
        found = _signs(sample.where(~teaches).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2))), machine, ["toxic", "half"]).toPandas()
        signs, toxic, half = np.array(found["signs"].tolist()).reshape(-1, SIGNS), found["toxic"].to_numpy(), found["half"].to_numpy()
        loss = unlike(signs, toxic, half)
        if best is None or loss < best[0]:
            best = loss, machine, calibrate(signs, toxic)
    return best[1:]


def score_texts(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text, others ignored).

    ``labels`` (doc_id, toxic) teach; of several labels of one doc_id the greatest
    counts. Nothing but the text goes into a score. Null and empty texts have no units
    and get the lowest score there is. Repeated rows each get a row; an empty table gives
    none; null ids stay and train nothing; very long texts are read whole. Without labels of
    both kinds, or where these teach no word, every text scores 0.05.
    """
    machine, weights = learn(docs, labels, rows)
    line = sum((F.col("signs")[i] * w for i, w in enumerate(weights[:-1])), F.lit(weights[-1]))
    found = _signs(docs.select("doc_id", "text"), machine, ["doc_id"]).withColumn("score", 1 / (1 + F.exp(-line)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
