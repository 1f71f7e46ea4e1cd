"""Vector codes, tokenizer alignment and passage classification against plain versions."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("hashloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from hashloom.llm import alignment, passages, vectors  # noqa: E402
from hashloom.llm.queries import BYTE_MODEL, MODEL, oracle_sql  # noqa: E402


# --- vector codes -----------------------------------------------------------

def brute_nearest(x, entries):
    d = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 11), st.integers(1, 40), st.integers(0, 3), st.integers(0, 10_000))
def test_bounds_lose_no_nearest_entry(width, entries, spread, seed):
    rng = np.random.default_rng(seed)
    size = [2, 40, 9000, vectors.LIMIT - 1][spread]
    x, e = rng.integers(-size, size, (70, width)), rng.integers(-size, size, (entries, width))
    x[:10], e[entries // 2] = e[0], e[0]  # equal entries, and vectors on them
    got, want = vectors.nearest(x, e), brute_nearest(x, e)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next(len(r[1]) for r in order if r[1] and len(r[1]) % parts == 0)
    w = size // parts
    start = [r for r in order if len(r[1]) == size][:entries]
    books = [[r[1][p * w:(p + 1) * w] for r in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, book: min(range(len(book)), key=lambda k: (far(v, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            won = {}
            for _, v, _ in kept:
                if len(v) == size:
                    part = v[p * w:(p + 1) * w]
                    won.setdefault(best(part, books[p]), []).append(part)
            books[p] = [[sum(c) // len(won[k]) for c in zip(*won[k])] if k in won else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        if len(v) != size:
            out.append((i, None, None, label))
            continue
        cut = [v[p * w:(p + 1) * w] for p in range(parts)]
        at = [best(c, books[p]) for p, c in enumerate(cut)]
        out.append((i, bytes(at).hex(), sum(far(c, books[p][k]) for p, (c, k) in enumerate(zip(cut, at))), label))
    sums = Counter()
    for _, _, e, label in out:
        if e is not None:
            sums[label] += e
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return Counter((*r[:3], sums[r[3]] if r[3] in sums else None) for r in out), hashlib.sha256(text.encode()).hexdigest()


def test_codes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)], rng.choice([0, 0, 0, 1, None])) for i in range(150)]
    rows += [rows[3], rows[3], (None, [0.25] * 12, 4), (700, None, 1), (701, [0.5] * 11 + [None], 1), (702, [0.5] * 11 + [float("nan")], 1),
             (703, [float("-inf")] + [0.5] * 11, 1), (704, [0.5] * 7, 9), (705, [], 1), (-5, [0.1] * 5, 1), (706, [-1e-9] * 12, None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, code string").repartition(5)
    for parts, entries, rounds in ((4, 8, 2), (12, 3, 1), (1, 200, 2)):
        want, digest = brute_codes(rows, parts, entries, rounds)
        for hot in (0.001, 2.0):
            monkeypatch.setattr(vectors, "HOT", hot)
            got, books = vectors.compress(d, parts=parts, entries=entries, rounds=rounds)
            assert Counter(tuple(r[c] for c in ("vec_id", "code", "error", "label_error")) for r in got.collect()) == want
            assert vectors.digest(books) == digest
    back = got.where("code is not null").select("code", vectors.decode(F.col("code"), books).alias("v")).head()
    assert back["v"] == [c / 256 for c in books[0][int(back["code"], 16)]]
    none, books = vectors.compress(d.limit(0))
    assert none.count() == 0 and books.size == 0
    with pytest.raises(Exception, match="component"):
        vectors.compress(spark.createDataFrame([(1, [1e9] * 16, 1)], "vec_id bigint, embedding array<double>, label int"))[0].collect()


# --- tokenizer alignment ----------------------------------------------------

ODD = [None, "", " ", "a", "\n\n\t x", "▁", "a▁b", "naïve café — ½ 日本語", "<|endoftext|>", "x <s> </s> <unk> <0x41>", "\u0000a", "é", "🙂🙂", "ﬁ ²", "A" * 300, "  two  spaces  "]


def tokens_of(text):
    a, b = alignment.sides(BYTE_MODEL, MODEL)
    want = (" " + text).encode() if text else b""
    ids = [s.encode([t])[0] for s, t in zip((a, b), (" " + (text or ""), text or ""))]
    if not text or any(b"".join(s.tokens[i] for i in x) != want for s, x in zip((a, b), ids)):
        return [], []
    return tuple([(i, len(s.tokens[i])) for i in x] for s, x in zip((a, b), ids))


def test_ranks_give_the_ids_of_the_file():
    a, _ = alignment.sides(BYTE_MODEL, MODEL)
    assert a.ranked
    rng = random.Random(6)
    letters = "aé ñ'\n\t09 ,.日🙂stredmIl\u00a0_<|>"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["x" * 40_000, "ab " * 9000, " " * 9000 + "a", "\n" * 5000, "y" * alignment.LONG_CUT]
    plain = [e.ids for e in a.codec.encode_batch(texts, add_special_tokens=False)]
    assert [a.encode([t])[0] for t in texts] == plain and a.encode(texts) == plain
    assert all(b"".join(a.tokens[i] for i in ids) == t.encode() for t, ids in zip(texts, plain))


def brute_alignment(rows):
    spans = []
    for i, text in rows:
        sides = []
        for tokens in tokens_of(text):
            at, side = 0, []
            for t, n in tokens:
                side.append((t, at, at + n))
                at += n
            sides.append(side)
        spans.append((i, *sides))
    links = [[(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])] for _, a, b in spans]
    count = Counter(p for ls in links for p in ls)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (i, a, b), ls in zip(spans, links):
        shared = sorted({x[2] for x in a} & {y[2] for y in b})
        low, groups = 0, []
        for cut in shared:
            groups.append(",".join(str(x[0]) for x in a if low < x[2] <= cut) + "|" + ",".join(str(y[0]) for y in b if low < y[2] <= cut))
            low = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), digest))
    return Counter(out), count


def test_alignment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = ["the", "Straße", "tion", "ing", "über", "日本", "x1y2", "—", "supercalifragilistic", "ñandú", "🙂"]
    rows = [*enumerate(ODD), *((100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(40)), (3, "a"), (None, "tion tion"), (None, None)]
    want, count = brute_alignment(rows)
    assert sum(n == 0 for _, n, *_ in want.elements()) >= 4  # null, empty and unspellable texts
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, count int").withColumn("row", F.lit("x")).repartition(3)
    got, pairs = alignment.align(d, BYTE_MODEL, MODEL)
    assert Counter(map(tuple, got.collect())) == want
    assert {(r["a_id"], r["b_id"]): r["count"] for r in pairs.collect()} == dict(count)
    assert Counter(map(tuple, alignment.align(d, BYTE_MODEL, MODEL, links=50)[0].collect())) == want
    assert alignment.align(d.limit(0), BYTE_MODEL, MODEL)[0].count() == 0
    named = d.where("doc_id < 8").withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    assert {r["doc_id"] for r in alignment.align(named, BYTE_MODEL, MODEL)[0].collect()} == {f"n{i}" for i in range(8)}


@pytest.mark.parametrize("window, fed", [(1 << 16, 1 << 20), (7, 1 << 20), (7, 1), (1, 5)])
def test_the_sweep_goes_on_where_it_stopped(window, fed, monkeypatch):
    """One state, fed by pieces of any size, gives what the whole does."""
    text = "naïve café " * 30 + "日本語 🙂🙂 " * 10 + "A" * 50
    want, count = brute_alignment([(1, text), (2, "tion"), (3, None), (4, "x" * 40)])
    lengths = alignment.widths(BYTE_MODEL, MODEL)
    rows = []
    for i, t in ((1, text), (2, "tion"), (3, None), (4, "x" * 40)):
        sides = tokens_of(t)
        if not sides[0]:
            rows.append((i, 0, 0, i, []))
        for side, tokens in enumerate(sides):
            at = np.cumsum([n for _, n in tokens])
            for w in sorted({int(e - 1) // window for e in at}):
                rows.append((i, w * window, side, i if w == side == 0 else None, [t for (t, _), e in zip(tokens, at) if (e - 1) // window == w]))
    rows.sort(key=lambda r: r[:3])
    for n, r in enumerate(rows):  # a document's first row carries its name
        if not n or rows[n - 1][0] != r[0]:
            rows[n] = (*r[:3], r[0], r[4])
    state, done, links = alignment.Sweep(lengths), [], []
    for low in range(0, len(rows), fed):
        part = rows[low:low + fed]
        closed, found = state.feed([r[0] for r in part], [r[3] for r in part], [r[2] for r in part], [np.array(r[4], np.uint32) for r in part])
        done += closed
        links += found.tolist()
    done.append(state.close())
    size = len(lengths[1])
    assert Counter((*d[:5], d[5]) for d in done) == Counter((*w[:5], w[7]) for w in want.elements())
    assert Counter((p // size, p % size) for p in links) == count


# --- passages ---------------------------------------------------------------

def brute_features(words):
    """Of one passage, plainly: trigram counts and shares."""
    low = lambda b: bytes(48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in b)
    grams = np.zeros(passages.TRIGRAMS)
    for w in words:
        s = b" " + low(w) + b" "
        for a, b, c in zip(s, s[1:], s[2:]):
            code = ((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) & 0xFFFFFFFF
            grams[(code * 0x27D4EB2F & 0xFFFFFFFF) >> 23] += 1
    grams = np.log1p(grams)
    n, letters, every = len(words), sum(map(len, words)), b"".join(words)
    folded = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    marks = set(b"#$%&*+/<=>@[\\]^_`{|}~")
    share = lambda f: sum(map(f, every)) / max(letters, 1)
    return np.r_[grams / max(np.linalg.norm(grams), 1), len(set(folded)) / max(n, 1), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57),
                 share(lambda c: c in marks), share(lambda c: c > 127), min(letters / max(n, 1) / 16, 4), math.log1p(n) / 5]


def test_features_equal_plain_computation(monkeypatch):
    rng = random.Random(4)
    texts = ["", " \n", "One", "a a A b\tb\x0bb", "é" * 50 + " x y", " ".join(rng.choice(["The", "ab#", "12", "||", "über"]) for _ in range(300))]
    for block in (4096, 2):
        monkeypatch.setattr(passages, "BLOCK", block)
        at = passages.Layout.of([t.encode() for t in texts])
        got = np.concatenate(list(passages.encode(at)))
        i = 0
        for t, n in zip(texts, at.counts):
            words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", t.encode()) if w]
            assert n == max(1, -(-len(words) // passages.WORDS))
            folded = [w.decode().translate({c: c + 32 for c in range(65, 91)}) for w in words]
            for k in range(n):
                part = words[k * passages.WORDS:(k + 1) * passages.WORDS]
                again = sum(j > 0 and folded[j] == folded[j - 1] for j in range(k * passages.WORDS, k * passages.WORDS + len(part))) / max(len(part), 1)
                want = brute_features(part)
                if not part:
                    want[:] = 0
                assert np.allclose(got[i], np.insert(want, passages.TRIGRAMS, again), atol=1e-5)
                i += 1
        assert i == len(got)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = passages.Model(3)
    model.p = {k: rng.normal(0, 0.3, v.shape) for k, v in model.p.items()}
    counts, y = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(0, 0.3, (8, passages.TRIGRAMS + passages.SHARES))

    def loss():
        _, _, chance = model.pool(*model.passages(x), counts)
        return -np.mean(y * np.log(chance) + (1 - y) * np.log(1 - chance))
    grads = model.gradients(x, counts, y)
    for k, g in grads.items():
        flat = model.p[k].reshape(-1)
        for i in rng.integers(0, flat.size, 5):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            assert math.isclose((up - loss()) / 2e-5, g.reshape(-1)[i], rel_tol=1e-4, abs_tol=1e-7)
            flat[i] = old


def graded(spark, n=600):
    """Texts of which some have junk in one passage out of several."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([70, 130, 260]))]
        if i % 3 == 0:
            at = rng.randrange(len(text) - 30)
            text[at:at + 30] = [w + "###" for w in text[at:at + 30]] if i % 2 else [text[at]] * 30
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 > 0)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_poor_passages_are_found_and_weighed(spark):
    d, labels = graded(spark)
    got = passages.score_texts(d, labels).join(labels, "doc_id").collect()
    assert len(got) == 600 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    out = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] for r in out if r["quality"]]) >= 0.95 and np.mean([r["predicted"] for r in out if not r["quality"]]) <= 0.15
    weights = passages.weigh(d, passages.learn(d, labels)).groupBy("doc_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert len(weights) == 600 and all(math.isclose(r["w"], 1, rel_tol=1e-5) for r in weights)
    assert {r["doc_id"]: r["n"] for r in weights} == {r["doc_id"]: r["n_passages"] for r in got}


def test_quality_scores_of_odd_rows(spark):
    rows = [(None, "x"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "w" * 300_000), (5, "word " * 5000)]
    d = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    _, labels = graded(spark, 40)
    for taught in (none, labels.where("quality = 1"), labels, labels.union(spark.createDataFrame([(3, 0), (3, None), (None, 0)], "doc_id bigint, quality int"))):
        got = passages.score_texts(d, taught).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
        assert {(r["doc_id"], r["n_passages"]) for r in got} == {(None, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 79)}
    assert all(r["predicted"] == 1 for r in passages.score_texts(d, none).collect())
    assert passages.score_texts(d.limit(0), labels).count() == 0


def test_training_rows_are_bounded(spark):
    d, labels = graded(spark, 120)
    every = passages.sample(d, labels, "quality", 1000, 10_000)
    taught = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(every) == len(taught)
    assert passages.sample(d, labels, "quality", 20, 10_000) == every[:20]
    few = passages.sample(d, labels, "quality", 1000, 30)
    assert few == every[:len(few)] and 0 < sum(max(1, -(-len(t.split()) // passages.WORDS)) for t, _ in few) <= 30
    assert passages.sample(d, labels, "quality", 1000, 0) == []
