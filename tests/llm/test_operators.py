"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hashloom.llm import html, lm, media, mixing, pieces, quality, secrets, simhash, substrings, toxicity
from hashloom.llm.common import connected_components
from hashloom.llm.queries import MODEL, WEIGHTS, domain

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile("[^\x20\x09-\x0d]+")


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(("ba", "ko", "ri", "té", "sun", "el")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def odd_texts():
    return [None, "", " \n\t", "word", "a b", "a  b\nc", "x" * 5000, "Ünï ✓ ▁ x", "\x00 nul", "one two three " * 400, "line\nline\nother\nline", "#*$%&|<> AKIA" + "A1" * 10]


@pytest.fixture(scope="module")
def docs(spark):
    rng, words, rows = random.Random(5), vocabulary(800, 1), []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 220)))
        if i % 5 == 4:  # copies, whole, spoilt, and of passages
            old = rows[rng.randrange(i)][1]
            text = [old, old.replace("ko", "kO", 1), text + " " + old[: len(old) // 2], old + " tail"][rng.randrange(4)]
        rows.append((i, text, rng.choice(["en", "de"]), f"src{rng.randrange(4)}", len(text)))
    rows += [(1000 + k, t, None, None, None) for k, t in enumerate(odd_texts())]
    rows += [rows[3], (None, rows[7][1], "en", "src1", 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def same(got, want):
    got, want = Counter(got), Counter(want)
    assert not got - want and not want - got


# --- quality ----------------------------------------------------------------

def base_stats(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_text_statistics_equal_brute_force(docs, rows):
    got = quality.text_stats(docs.select("doc_id", "text", F.lit(1).alias("n_words"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    same([tuple(r) for r in got], [(i, *base_stats(t)) for i, t in rows])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from("a b c d e f g h i j k l m n o p q".split()), max_size=120))
def test_repeated_windows_both_ways(spark, words):
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    want = base_stats(" ".join(words))[4]
    before = quality.LOOKUP
    try:
        for quality.LOOKUP in (before, 0):
            assert quality.text_stats(df).head()["n_repeat_words"] == want
    finally:
        quality.LOOKUP = before


def test_rules_find_what_was_planted(spark):
    rng = random.Random(2)
    words = vocabulary(300, 3)
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        text = " ".join(rng.choice(words) + ("$$$" if bad else "") for _ in range(80))
        rows.append((i, text))
        if i % 2 == 0 or bad:
            labels.append((i, 0 if bad else 1))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(None, 0), (5, None)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(d, lab).collect()}
    assert got == {i: i % 6 != 0 for i in range(300)}
    kept = quality.keep(d.withColumn("row", F.lit("x")).withColumn("n_words", F.lit("y")), lab)
    assert kept.columns == ["doc_id", "text", "row", "n_words"] and kept.count() == 250


def test_quality_without_labels_or_rows(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.judge(docs, none).select("doc_id", "kept").collect()
    failed = lambda t: base_stats(t)[0] < 50 or 100 * base_stats(t)[4] > 50 * base_stats(t)[0]
    same([tuple(r) for r in got], [(i, not failed(t)) for i, t in rows])
    assert quality.judge(empty, none).count() == 0


# --- secrets ----------------------------------------------------------------

def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(9)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, f"é {i} key " + "".join(rng.choice(b64) for _ in range(44)) + " end") for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate([
        None, "", "secret=token : abcdefgh", 'API_KEY = "abc.def-123"', "password: short passwd='longer_one'", "AKIA" + "B" * 15, "xAKIA" + "B" * 16 + "c", "deadbeef" * 3, "é" * 30 + "0a" * 12 + "g",
        "token=" + "f" * 30, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa11", "internationalizationofthesettings1", "secret:" * 50, "/usr/local/share/example/path/v2/index"])]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_base_spans_equal_regular_expressions(leaky):
    for r in secrets.find_secrets(leaky).join(leaky, "doc_id").collect():
        want = base_spans(r["text"])
        told = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[2] == k for x in want) for k in ("assign", "access", "hex"))
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))


def test_random_strings_are_found_and_written_ones_left(leaky):
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(leaky).collect()}
    assert sum("random" in found[i] for i in range(40)) >= 36
    assert not any("random" in found[i] for i in found if i >= 110)


def test_redaction(leaky, spark):
    for r in secrets.redact_secrets(leaky.withColumn("base", F.lit(1)).withColumn("n_chars", F.length("text"))).join(leaky.select("doc_id", F.col("text").alias("old")), "doc_id").collect():
        want, at = "", 0
        for a, _, _, b in base_spans(r["old"]):
            if a >= at:
                want += ("" if a == at and at else (r["old"] or "")[at:a]) + ("" if a == at and at else "[SECRET]")
            at = max(at, b)
        want = None if r["old"] is None else want + r["old"][at:]
        if r["doc_id"] >= 100:
            assert r["text"] == want and r["n_chars"] == (None if want is None else len(want))
        assert r["base"] == 1
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


WORDS = "the quick settings internal value index report analysis customer history update message network storage session manager provider module function handler request".split()


def written(rng):
    w = [rng.choice(WORDS) for _ in range(rng.randint(3, 6))]
    return rng.choice(["_".join(w), w[0] + "".join(x.title() for x in w[1:]), "/".join(w) + str(rng.randint(1, 99)), "".join(w), "-".join(w) + "-2024"])


def test_written_strings_stay_below_the_false_discovery_rate(spark):
    rng = random.Random(4)
    rows = [" ".join(written(rng) for _ in range(10)) for _ in range(200)]
    alphabets = dict(secrets.ALPHABETS)
    rows += ["".join(rng.choice(alphabets[e]) for _ in range(n)) for e, n in (("base62", 32), ("base64", 40), ("HEX", 64), ("base32", 64)) for _ in range(50)]
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    false, true = (sum(r["spans"].count("random") for r in got if (r["doc_id"] < 200) == x) for x in (True, False))
    assert true >= 180 and false <= 0.02 * (true + false)


def test_the_three_tests_equal_plain_computation(spark):
    rng = random.Random(2)
    rows = ["".join(rng.choice(a) for _ in range(rng.randint(20, 90))) for _, a in secrets.ALPHABETS for _ in range(4)] + [written(rng) for _ in range(20)] + ["a" * 30, "0" * 20]
    rows = [r for r in rows if len(r) >= 20]
    normal = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    for t, b in [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "t string").select("t", secrets._battery(F.col("t"))).collect()]:
        fits = [(e, a) for e, a in secrets.ALPHABETS if set(t) <= set(a)]
        if not fits:
            assert b is None
            continue
        (e, a), n = fits[0], len(t)
        k, x = len(a), [a.index(c) for c in t]
        chi = sum((c - n / k) ** 2 * k / n for c in (t.count(c) for c in a))
        over = max(k * secrets.COINCIDENCE - 1, secrets.LEAST_EXCESS) * n
        kind = [next(i for i, c in enumerate(secrets.CLASSES) if re.match(c, ch)) for ch in t]
        rate = secrets.SWITCHES[not {0, 1} <= set(kind)]
        runs = 1 + sum(p != q for p, q in zip(kind, kind[1:]))
        mean = sum(x) / n
        var = sum((v - mean) ** 2 for v in x)
        z = (sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / var * n + 1) / math.sqrt(n) if var else 99.0
        want = (normal((chi - k + 1 - over) / math.sqrt(2 * (k - 1) + 4 * over)), 1 - normal((runs - 1.5 - rate * (n - 1)) / math.sqrt(rate * (1 - rate) * (n - 1))), 2 * normal(abs(z)) - 1)
        assert b["encoding"] == e and all(math.isclose(p, q, abs_tol=1e-5) for p, q in zip((b["p_chi"], b["p_runs"], b["p_serial"]), want))
        s = -sum(math.log(max(b[c], 1e-12)) for c in ("p_chi", "p_runs", "p_serial"))
        assert math.isclose(b["p"], math.exp(-s) * (1 + s + s * s / 2), rel_tol=1e-6)


def test_texts_full_of_secrets_are_read_whole(spark):
    text = "é " + " ".join(f"token=abcdef{i}" for i in range(3000))
    r = secrets.redact_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).head()
    assert r["text"] == "é " + " ".join(["[SECRET]"] * 3000)
    touching = "AKIA" + "A" * 20 + "token=abcdefgh" + "0a" * 15  # overlaps and touches: one mark
    assert secrets.redact_secrets(spark.createDataFrame([(1, touching)], "doc_id bigint, text string")).head()["text"] == "[SECRET]"


# --- repeated bytes ---------------------------------------------------------

def brute_repeats(rows):
    first = {}
    big = 1 << 63
    for i, t in rows:
        b, i = (t or "").encode(), big if i is None else i
        for s in range(len(b) - 49):
            first[b[s:s + 50]] = min(first.get(b[s:s + 50], big + 1), i)
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), big if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < own:
                gone[s:s + 50] = b"\1" * 50
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_repeats_equal_brute_force(docs, rows, empty):
    want = brute_repeats(rows)
    for size in (substrings.BUCKET_BYTES, 500):
        got = substrings.find_repeats(docs, bucket_bytes=size).collect()
        same([(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]) // 16, r["kept_sha256"]) for r in got], want)
    assert substrings.find_repeats(empty).count() == 0
    kept = substrings.remove_repeats(docs.withColumn("spans", F.lit("x")).withColumn("kept", F.lit(1)))
    assert kept.columns == [*docs.columns, "spans", "kept"]
    whole = {r[0]: r[4] for r in want}
    for r in kept.collect():
        if r["text"] is not None and "\ufffd" not in r["text"]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() in (whole[r["doc_id"]], hashlib.sha256(b"").hexdigest())
    as_text = substrings.find_repeats(docs.where("doc_id < 60").select(F.col("doc_id").cast("string").alias("doc_id"), "text")).collect()
    same([(int(r["doc_id"]), r["kept_sha256"]) for r in as_text], [(r[0], r[4]) for r in brute_repeats([x for x in rows if x[0] is not None and x[0] < 60])])


def test_ids_of_any_type_keep_their_order(spark):
    a, b = "first text of more than fifty bytes, which others have as well.", "another one that is long enough for a string of fifty bytes too"
    rows = [("9", a), ("10", a + "!"), ("b2", a), ("a1", b), ("b1", b), (None, b), (None, a), ("b2", b)]
    for shape, kind in (("doc_id string", str), ("doc_id struct<k: string>", lambda k: None if k is None else (k,))):
        got = substrings.find_repeats(spark.createDataFrame([(kind(i) if i else None, t) for i, t in rows], f"{shape}, text string")).collect()
        name = lambda r: r["doc_id"] if shape == "doc_id string" or r["doc_id"] is None else r["doc_id"][0]
        gone = sorted(((name(r) or "~"), r["n_bytes"], r["n_removed"] > 0) for r in got)
        assert len(got) == len(rows) and {(i, n) for i, n, g in gone if not g} == {("a1", len(b)), ("9" if kind is str else "10", len(a) + (kind is not str))}


def test_long_pieces_join_up(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)
    rng = random.Random(4)
    a = bytes(rng.choice(b"abcd") for _ in range(1000))
    whole = substrings.stretches([a, b"x" * 40, a])
    assert whole[0].tolist().count(0) == whole[0].tolist().count(2) and 1 not in whole[0]
    for d in (0, 2):
        k = whole[0] == d
        assert substrings._ranges(whole[2][k], whole[3][k]).tolist() == list(range(951)) and whole[1][k].tolist() == list(range(int(k.sum())))


def test_a_frequent_anchor_is_dealt_out_by_what_is_beside_it():
    rng = np.random.default_rng(7)
    tried = rng.integers(97, 123, (20_000, 20)).astype(np.uint8)
    word = min((t.tobytes() for t in tried), key=lambda t: int(substrings._mix(np.array([substrings.prefix_hashes(np.frombuffer(t, np.uint8))[20]]))[0]))
    n, buckets = 600, 50
    texts = [rng.integers(97, 123, 40).astype(np.uint8).tobytes() + word + rng.integers(97, 123, 40).astype(np.uint8).tobytes() for _ in range(n)]
    texts[500] = texts[3][:60] + texts[500][60:]  # 50 bytes of the third, on one side of the word
    docs = pa.table({"doc": list(range(n)), "row": list(range(n)), "text": texts})
    asked = pa.Table.from_batches(substrings._ask(buckets)(iter(docs.to_batches())))
    told = pa.concat_tables([substrings._answer(buckets)(asked.filter(pa.compute.equal(asked["key"], k))) for k in range(buckets)])
    parts = substrings._apply(buckets)(docs.append_column("null_id", pa.array([False] * n)), told)
    opened = parts.filter(pa.compute.equal(parts["part"], substrings.SUFFIXES))
    per = np.bincount(opened["key"].to_numpy())
    assert per.sum() > 500 and per.max() < 100
    settled = [substrings._settle(buckets)(opened.filter(pa.compute.equal(opened["key"], k))) for k in np.flatnonzero(per)]
    assert {int(d) for t in settled for d in substrings._unpacked(t.to_pylist())[0]} == {500}


@settings(max_examples=25, deadline=None)
@given(st.binary(min_size=50, max_size=700), st.integers(1, 3))
def test_suffix_sort_is_a_sort(data, letters):
    data = bytes(c % letters for c in data) + data[:60]
    starts = np.arange(len(data) - 49)
    ordered, label = substrings._sorted_classes(data, starts)
    cut = [data[s:s + 50] for s in ordered.tolist()]
    assert cut == sorted(cut) and sorted(ordered.tolist()) == starts.tolist()
    assert len(set(cut)) == label[-1] + 1


def test_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(substrings, "_LETTER", np.zeros(256, np.uint64))  # all hashes equal
    data = bytes(range(40)) + bytes(range(40)) + bytes(range(100, 160))
    ordered, label = substrings._sorted_classes(data, np.arange(len(data) - 49))
    cut = [data[s:s + 50] for s in ordered.tolist()]
    assert cut == sorted(cut) and len(set(cut)) == label[-1] + 1


# --- near copies ------------------------------------------------------------

def brute_simhash(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(values, distance=2):
    values, label = sorted(set(values)), {}
    for v in values:
        if v not in label:
            todo, label[v] = [v], v
            while todo:
                x = todo.pop()
                for y in values:
                    if y not in label and (x ^ y).bit_count() <= distance:
                        label[y] = v
                        todo.append(y)
    return label


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    fps = [brute_simhash(t) for _, t in rows]
    label = brute_components(fps)
    names = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            names[label[f]] = min(names.get(label[f], i), i)
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    same(got, [(i, f, names.get(label[f])) for (i, _), f in zip(rows, fps)])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    same([r["doc_id"] for r in kept.collect() if r["doc_id"] is not None], {names[label[f]] for (i, _), f in zip(rows, fps) if label[f] in names})
    assert simhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_group_stays_by_its_own_text(spark):
    long = [" ".join(random.Random(k).choices(vocabulary(300, 2), k=80)) for k in range(4)]
    rows = [(1, long[0], "a"), (2, long[0], "b"), (2, long[1], "c"), (2, long[1], "c"), (3, long[1], "d"), (None, long[0], "e"), (None, None, "f"), (4, None, "g"), (5, "", "h"), (4, long[3], "i")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string, row string")).collect()
    same([tuple(r) for r in got], [rows[0], rows[2], rows[5], rows[6], rows[7], rows[9]])


def test_the_blocks_guarantee_their_counts():
    for spoilt in range(4):
        from itertools import combinations
        left = {sum(not set(b) & set(s) for b in simhash.BLOCKS) for s in combinations(range(8), spoilt)}
        assert left == {(14, 7, 3, 1)[spoilt]}


@pytest.mark.parametrize("limit", [1, 48])
def test_dense_neighbourhoods_lose_no_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "POSTING_PAIRS", limit)
    rng = random.Random(limit)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(60)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    for distance in (2, 1):
        label = brute_components(values, distance)
        found = {r["node"]: r["component"] for r in connected_components(simhash.links(fps, distance)).collect()}
        groups = {}
        for v in values:
            groups.setdefault(label[v], set()).add(found.get(signed(v), signed(v)))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


# --- HTML -------------------------------------------------------------------

def page(i, body):
    return f'<!DOCTYPE html><html><head><title>T{i}</title><script>var x="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="ad">buy {i}</div>{body}<footer>&copy; {i}</footer></body></html>'


def test_article_is_what_remains(spark):
    bodies = [f"<article><h1>Head {i}</h1><p>One <b>bo</b>ld &amp; {i}<br>two<p>three</article>" for i in range(6)]
    rows = [(i, "http://a.example/x", page(i, b)) for i, b in enumerate(bodies)] + [(9, "http://b.example/", None), (10, None, page(10, bodies[0])), (11, "http://c/", "")]
    rows.append(rows[0])
    got = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2))).collect()
    want = [(i, f"Head {i} One bold & {i} two three") for i in range(6)] + [(9, ""), (10, "Head 0 One bold & 0 two three"), (11, ""), (0, "Head 0 One bold & 0 two three")]
    same([(r["page_id"], r["text"]) for r in got], want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def pages_of(spark, htmls, parts=2):
    return spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string").repartition(parts)


def story(i):
    return (f"<div><p>Welcome to our site</p></div><div id=story><h2>Title {i}</h2><p>{'text of story ' * 20}{i}</p><p>Read more on this site</p></div>"
            f"<div class='cookie-notice'>We use cookies {i}</div><ul class=links><li><a href=x>link {i}</a></ul><div class=comments><p>nice {i}</p></div>")


def test_wrappers_come_the_same_both_ways(spark, monkeypatch):
    rows = pages_of(spark, [story(i) for i in range(9)]).unionByName(spark.createDataFrame([(90, "http://other/", story(1)), (91, None, story(2)), (92, "http://h.example/", None)], "page_id bigint, url string, html string"))
    told = {r["page_id"]: r["text"] for r in html.main_text(rows).collect()}
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    assert {r["page_id"]: r["text"] for r in html.main_text(rows).collect()} == told and len(told) == 12 and told[92] == ""


def test_templates_without_article_element(spark):
    for n, parts in ((8, 1), (50, 4), (97, 7)):  # neither the number of pages nor of partitions matters
        out = {r["page_id"]: r["text"] for r in html.main_text(pages_of(spark, [story(i) for i in range(n)], parts)).collect()}
        assert out == {i: f"Title {i} {'text of story ' * 20}{i} Read more on this site" for i in range(n)}
    assert html.extract(story(1)).startswith("Welcome to our site Title 1")  # what alignment alone can tell


def test_the_way_to_the_text_outranks_names(spark):
    make = lambda i: f"<form class='header search'><div><p>{'long text of the page ' * 9}{i}</p></div><div class=ad>buy {i}</div></form><p>a lead {i}</p>"
    out = {r["page_id"]: r["text"] for r in html.main_text(pages_of(spark, [make(i) for i in range(9)])).collect()}
    assert out == {i: f"{'long text of the page ' * 9}{i} a lead {i}" for i in range(9)}


@pytest.mark.parametrize("layout", range(4))
def test_unlisted_names_and_varying_notices(spark, layout):
    """Hosts whose names say nothing: what a place's texts are over the pages tells article and rest apart."""
    rng = random.Random(layout)
    words = vocabulary(600, layout)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pool, pages, wants = [say(9) for _ in range(5)], [], []
    for i in range(40):
        body = [say(rng.randint(20, 70)) for _ in range(rng.randint(3, 7))]
        inner = "".join(f"<p>{b}</p>" for b in body)
        notice, offer = f"<div class=zq>{rng.choice(pool)}</div>", f"<div class=wx><span>{say(6)}</span> {i}</div>"
        talk = "".join(f"<div class=vv><p>{say(rng.randint(5, 40))}</p></div>" for _ in range(rng.randint(0, 4)))
        links = "<div class=kk>" + "".join(f"<a href=x>{say(2)}</a> " for _ in range(8)) + "</div>"
        title = say(6)
        pages.append((f"<body>{links}{notice}<div class=pp><h1>{title}</h1>{inner}</div>{offer}<div class=oo>{talk}</div><div class=ff>host {rng.choice(pool)}</div></body>",
                      f"<body><div><div class=q1>{offer}{notice}</div><div class=q2><h1>{title}</h1><div class=q3>{inner}{notice}</div></div></div><div class=q5>{talk}{links}</div></body>",
                      f"<body><table><tr><td class=l>{links}</td><td class=r><h1>{title}</h1>{inner}</td></tr></table>{notice}{offer}</body>",
                      f"<body>{notice}<h1>{title}</h1><section><div class=aa>{inner}</div></section><section class=bb>{offer}<p class=cc>{say(4)}</p></section></body>")[layout])
        wants.append(" ".join([title, *body]).split())
    got = {r["page_id"]: r["text"].split() for r in html.main_text(pages_of(spark, pages, 3)).collect()}
    both = sum(sum((Counter(got[i]) & Counter(w)).values()) for i, w in enumerate(wants))
    assert both >= 0.95 * sum(map(len, got.values())) and both >= 0.95 * sum(map(len, wants))


def test_identical_pages_do_not_erase_each_other(spark):
    got = html.main_text(pages_of(spark, [page(1, "<article><p>same</p></article>")] * 5)).collect()
    assert [r["text"] for r in got] == ["same"] * 5


def test_inner_elements_keep_their_text():
    inner = "<article><p>a <math><mi>x</mi></math> <object>o</object> <svg><text>s</text></svg> <noscript>n</noscript>b</p></article>"
    assert html.extract(inner) == "a x o s b"


def test_many_ids_and_deep_pages_take_linear_time(spark):
    rows = [f"<main><h1>t {i}</h1><p>{'words of page ' * 9}{i}</p></main>" + "".join(f"<div id=comment-{i * 2000 + k}>c{k}</div>" for k in range(2000)) for i in range(48)]
    began = time.time()
    out = {r["page_id"]: r["text"] for r in html.main_text(pages_of(spark, rows)).collect()}
    assert all(out[i].startswith(f"t {i} words") for i in out) and time.time() - began < 60
    assert html.extract("<div>" * 50_000 + "<p>deep" + "</div>" * 50_000 + "<p>after") == "deep after"
    assert html.extract("<p>" + "long text " * 200_000).count("long") == 200_000


@settings(max_examples=60, deadline=None)
@given(st.text("<>/pdivb a='\"&;!-x", max_size=60))
def test_any_soup_is_read(soup):
    html.extract(soup, html.Tree.of(html.Page(soup[::-1]))[0])


def brute_match(a, b):
    """Trees are lists of (key, tree)."""
    def forest(x, y):
        if not x or not y:
            return 0
        both = 1 + brute_match(x[0][1], y[0][1]) if x[0][0] == y[0][0] else 0
        return max(forest(x[1:], y), forest(x, y[1:]), both + forest(x[1:], y[1:]))
    return forest(a, b)


TREES = st.recursive(st.just([]), lambda c: st.lists(st.tuples(st.sampled_from("pduvw"), c), max_size=4, unique_by=lambda x: x[0]), max_leaves=8)


@settings(max_examples=120, deadline=None)
@given(TREES, TREES)
def test_tree_matching_equals_brute_force(x, y):
    def tree(kids):
        parents, keys, todo = [-1], ["root"], [(0, kids)]
        while todo:
            at, rest = todo.pop(0)
            for key, inner in rest:
                parents.append(at)
                keys.append(key)
                todo.append((len(parents) - 1, inner))
        return html.Tree(parents, keys)
    a, b = tree(x), tree(y)
    weight, partner = html.tree_match(a, b)
    assert weight == 1 + brute_match(x, y) == sum(p >= 0 for p in partner)
    assert all(p < 0 or a.keys[p] == b.keys[s] and (s == 0 or partner[b.parents[s]] == a.parents[p]) for s, p in enumerate(partner))


# --- mixing -----------------------------------------------------------------

def brute_share(children, budget):
    """children: name -> (weight, cap)."""
    got, live = {}, {k: v for k, v in children.items() if v[0] and v[1]}
    budget = min(budget, sum(c for _, c in live.values()))
    while True:
        total = sum(w for w, _ in live.values())
        full = {k for k, (w, c) in live.items() if c * total <= budget * w}
        if not full:
            break
        for k in full:
            got[k] = live.pop(k)[1]
            budget -= got[k]
    total = sum(w for w, _ in live.values())
    for k, (w, _) in live.items():
        got[k] = budget * w / total
    return got


def test_budgets_water_fill_the_tree(spark):
    rng = random.Random(1)
    leaves = [(f"d{a}", lang, f"s{c}", rng.choice([10, 200, 5000]), 3) for a in range(3) for lang in ("en", "de") for c in range(4)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, available bigint, rows bigint")
    weights = {"domain": {"d0": 5, "*": 1}, "lang": {"en": 3}, "source": {"s0": 2, "s3": 0}}
    for share in (5, 40, 100):
        budget = sum(x[3] for x in leaves) * share // 100
        got = {(r["domain"], r["lang"], r["source"]): r["target"] for r in mixing.budgets(df, weights, F.expr(f"sum(available) * {share} div 100"), 2).collect()}
        w = lambda level, k: weights[level].get(k, weights[level].get("*", 1))
        cap = {x[:3]: 2 * x[3] if w("source", x[2]) else 0 for x in leaves}
        want = {k: 0 for k in got}
        tops = brute_share({d: (w("domain", d), sum(c for k, c in cap.items() if k[0] == d)) for d in {k[0] for k in cap}}, budget)
        for d, b in tops.items():
            for lang, b2 in brute_share({x: (w("lang", x), sum(c for k, c in cap.items() if k[:2] == (d, x))) for x in ("en", "de")}, b).items():
                for s, b3 in brute_share({k[2]: (w("source", k[2]), c) for k, c in cap.items() if k[:2] == (d, lang)}, b2).items():
                    want[d, lang, s] = b3
        assert all(abs(got[k] - want[k]) <= 3 for k in got) and sum(got.values()) == min(budget, sum(cap.values()))


def test_prefixes_meet_their_targets(docs, rows, empty):
    mixed = mixing.mix(docs.withColumn("copies", F.lit("x")), domain(), WEIGHTS, percent=60).collect()
    assert Counter(r["doc_id"] for r in mixed) == Counter(i for i, _ in rows)
    total, used, longest = (f([r["n_tokens"] * k(r) for r in mixed]) for f, k in ((sum, lambda r: 1), (sum, lambda r: r["copies"]), (max, lambda r: 1)))
    leaves = len({(r["domain"], r["lang"], r["source"]) for r in mixed})
    assert 0 <= used - total * 60 // 100 < leaves * longest and max(r["copies"] for r in mixed) <= 2
    again = mixing.mix(docs.drop("x").repartition(7), domain(), WEIGHTS, percent=60).collect()
    same([(r["doc_id"], r["n_tokens"], r["copies"]) for r in again], [(r["doc_id"], r["n_tokens"], r["copies"]) for r in mixed])
    taken = mixing.take(docs, domain(), WEIGHTS, percent=60)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in mixed)
    assert mixing.mix(empty, domain(), WEIGHTS).count() == 0


def test_mixing_keeps_columns_of_any_name(docs):
    names = ["rows", "epochs", "rest", "edge", "same", "_h", "key", "part", "row", "budget", "available", "_domain", "_copy", "col", "domain"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    taken = mixing.take(wide, domain(), WEIGHTS)
    assert taken.columns == wide.columns and all(r[n] is None or r[n] == f"{n}{r['doc_id']}" for r in taken.collect() for n in names)
    plain = Counter(r["doc_id"] for r in mixing.take(docs, domain(), WEIGHTS).collect())
    assert Counter(r["doc_id"] for r in taken.collect()) == plain
    assert set(names) - {"domain"} < set(mixing.mix(wide, domain(), WEIGHTS).columns)


def against_sql(spark, name, folder):
    import duckdb

    import __spark_entry__
    con = duckdb.connect()
    con.execute("set threads = 4")
    for t in ("documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, folder).select(*want.columns).toPandas()
    same(list(got.itertuples(index=False, name=None)), list(want.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["op6_mixing"])
def test_queries_equal_their_sql(spark, name):
    against_sql(spark, name, "/root/testdata/sf0.001")


# --- pieces -----------------------------------------------------------------

@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(*pieces.read_model(MODEL))


def brute_pieces(codec, scores, text):
    unit = pieces.SPACE + text.replace(" ", pieces.SPACE)
    best = [(0.0, ())] + [None] * len(unit)
    for end in range(1, len(unit) + 1):
        for size in range(1, min(end, 48) + 1):
            p = unit[end - size:end]
            s = scores.get(p, codec.unknown if size == 1 else None)
            if s is not None and best[end - size] is not None and (best[end] is None or best[end - size][0] + s > best[end][0]):
                best[end] = (best[end - size][0] + s, best[end - size][1] + (p,))
    return best[-1][0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("the an  ing\n▁é✓", max_size=60))
def test_round_trip_and_best_score(codec, text):
    ids = np.frombuffer(codec.encode(text), np.int32).tolist()
    assert codec.decode(ids) == text
    if text and pieces.SPACE not in text:
        model, of_byte = pieces.read_model(MODEL)
        by_id, scores = {i: (p, s) for p, s, i in model}, {p: s for p, s, _ in model}
        run, total, k = [], 0.0, 0
        while k < len(ids):  # byte pieces of one character cost what an unknown character costs
            if ids[k] in by_id:
                total, k = total + by_id[ids[k]][1], k + 1
            else:
                run = codec.bytes_of[ids[k]][0]
                total, k = total + codec.unknown, k + (1 if run < 128 else 2 if run < 224 else 3 if run < 240 else 4)
        assert math.isclose(total, brute_pieces(codec, scores, text), rel_tol=1e-6, abs_tol=1e-2)


def test_ids_equal_the_library_on_the_same_pieces(codec, docs, rows, tmp_path):
    """The library, told to read the model's pieces as a unigram model, finds the same scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    equal = 0
    texts = [t for _, t in rows if t and pieces.SPACE not in t and "\x00" not in t and len(t) < 3000]
    for t in texts:
        equal += lib.encode(t) == np.frombuffer(codec.encode(t), np.int32).tolist()
    assert equal >= 0.98 * len(texts)


def test_encode_and_decode_tables(docs, rows, empty):
    got = pieces.encode(docs, MODEL)
    assert got.where("not round_trip").count() == 0
    back = pieces.decode(got, MODEL).collect()
    same([(r["doc_id"], r["text"]) for r in back], [(i, t or "") for i, t in rows])
    assert pieces.encode(empty, MODEL).count() == 0


# --- JPEG -------------------------------------------------------------------

class Bits:
    def __init__(self):
        self.out, self.n, self.k = bytearray(), 0, 0

    def put(self, value, bits):
        for b in range(bits - 1, -1, -1):
            self.n = self.n << 1 | value >> b & 1
            self.k += 1
            if self.k == 8:
                self.out += bytes([self.n]) + (b"\0" if self.n == 255 else b"")
                self.n = self.k = 0

    def end(self):
        while self.k:
            self.put(1, 1)
        return bytes(self.out)


def colour_jpeg(seed, rows, columns, interval):
    """A 4:2:0 file with AC coefficients, and the luminance DC plane that was put in."""
    rng = random.Random(seed)
    dc = {s: (c, n) for s, c, n in media.canonical(media.DC_LENGTHS, media.DC_SIZES)}
    symbols = (0x00, 0x01, 0x12, 0xF0, 0x31)
    lengths = (0, 2, 3) + (0,) * 13
    ac = {s: (c, n) for s, c, n in media.canonical(lengths, symbols)}
    mh, mw = -(-rows // 2), -(-columns // 2)
    plane = np.array([[rng.randint(-60, 60) for _ in range(2 * mw)] for _ in range(2 * mh)])
    scan, bits, last = b"", Bits(), [0, 0, 0]
    units = [(y, x) for y in range(mh) for x in range(mw)]
    for k, (y, x) in enumerate(units):
        if interval and k and k % interval == 0:
            scan += bits.end() + bytes([255, 0xD0 + (k // interval - 1) % 8])
            bits, last = Bits(), [0, 0, 0]
        for c, v in [(0, plane[2 * y + a, 2 * x + b]) for a in (0, 1) for b in (0, 1)] + [(1, rng.randint(-9, 9)), (2, 0)]:
            d, last[c] = int(v) - last[c], int(v)
            size = abs(d).bit_length()
            bits.put(*dc[size])
            bits.put(d if d >= 0 else d + (1 << size) - 1, size)
            for s in rng.sample((0x01, 0x12, 0xF0, 0x31), rng.randint(0, 3)):
                bits.put(*ac[s])
                bits.put(rng.getrandbits(s & 15) if s & 15 else 0, s & 15)
            bits.put(*ac[0])
    scan += bits.end()
    part = lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
    table = lambda i, ls, ss: bytes([i]) + bytes(ls) + bytes(ss)
    h, w = 8 * rows - 3, 8 * columns - 5
    return (b"\xff\xd8" + part(0xFE, b"comment") + part(0xDB, b"\0" + bytes([16] + [3] * 63)) + part(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
            + part(0xC4, table(0, media.DC_LENGTHS, media.DC_SIZES) + table(0x10, lengths, symbols)) + (part(0xDD, interval.to_bytes(2, "big")) if interval else b"")
            + part(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"), np.clip((plane * 16 + 4) // 8 + 128, 0, 255)[:rows, :columns], (w, h)


@pytest.mark.parametrize("interval", [0, 2, 5])
def test_colour_files_decode(spark, interval):
    made = [colour_jpeg(s, 3 + s, 5, interval) for s in range(3)]
    frames = [media.parse(d) for d, _, _ in made]
    media.decode([f for fs in frames for f in fs])
    for (f,), (_, plane, size) in zip(frames, made):
        assert (f.thumbnail == plane).all() and (f.width, f.height) == size
    df = spark.createDataFrame([(bytearray(made[0][0]),), (bytearray(b"junk"),), (None,)], "media binary")
    assert [r["width"] for r in media.describe(df.withColumn("width", F.lit("x"))).collect()] == [35, None, None]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=4))
def test_storage_is_lossless(texts):
    payloads = [media.padded(t) for t in texts]
    frames = [media.parse(f) for f in media.store(payloads)]
    media.decode([f for fs in frames for f in fs])
    assert [b"".join(f.thumbnail.tobytes() for f in fs) for fs in frames] == payloads


def test_large_payloads_take_several_frames():
    for size in (341, 342, 9000):
        assert sum(r * c for r, c in media.shape(size)) == size * media.UNIT and all(r <= media.SIDE and c <= media.SIDE for r, c in media.shape(size))
    data = random.Random(1).randbytes(8200 * media.UNIT)
    (f,) = media.store([data])
    frames = media.parse(f)
    media.decode(frames)
    assert b"".join(x.thumbnail.tobytes() for x in frames) == data and len(frames) == 2


def test_stored_texts(docs, rows, empty):
    got = media.read_back(media.store_texts(docs, 4000), 5000).collect()
    want = []
    for i, t in rows:
        p = media.padded((t or "").encode())
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    same([tuple(r)[:5] for r in got], want)
    by_text = {}
    for r in got:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(x) == 1 for x in by_text.values())
    assert media.read_back(media.store_texts(empty)).count() == 0
    files = media.describe(media.store_texts(docs)).collect()
    assert len(files) == len(rows) and all(r['width'] > 0 and r['media'][:2] == b'\xff\xd8' for r in files)


# --- toxicity ---------------------------------------------------------------

def insults(spark, n=500):
    rng = random.Random(3)
    words, bad = vocabulary(900, 8), ["grobian", "lumpenhund", "dummkopf", "trottel"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(40)]
        for _ in range(3 * toxic):
            w = rng.choice(bad)
            k = rng.randrange(1, len(w))
            text.insert(rng.randrange(len(text)), rng.choice([w, w, w, w, ".".join(w), w[:k] + "x" + w[k:], " ".join(w)]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxic_texts_are_told_apart(spark, docs, rows):
    d, labels = insults(spark)
    got = toxicity.score_texts(d, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    out = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] for r in out if r["toxic"]]) >= 0.9 and np.mean([r["predicted"] for r in out if not r["toxic"]]) <= 0.05
    assert Counter(r["doc_id"] for r in toxicity.score_texts(docs, labels).collect()) == Counter(i for i, _ in rows)


def test_insults_of_ordinary_words_are_learned(spark):
    """None of the words tells anything by itself, and neither does another order of them."""
    rng = random.Random(12)
    words = vocabulary(300, 2) + ["nobody", "wants", "you", "go", "home"]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        at = rng.randrange(50)
        text[at:at] = rng.choice([["nobody", "wants", "you"], ["Go", "home,", "you"]]) if toxic else rng.sample(["you", "nobody", "home", "wants", "go"], 5)[::2]
        if not toxic and ("nobody wants you" in " ".join(text) or "go home you" in " ".join(text)):
            continue
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found, others = toxicity.phrases(d.join(lab, "doc_id").select("text", "toxic"))
    assert {"nobody wants you", "go home you"} <= set(found) and len(found) <= 8 and others and not set(found) & set(others)
    out = [r for r in toxicity.score_texts(d, lab).join(lab, "doc_id").collect() if r["held_out"]]
    assert np.mean([r["predicted"] for r in out if r["toxic"]]) >= 0.9 and np.mean([r["predicted"] for r in out if not r["toxic"]]) <= 0.05
    assert toxicity.phrases(d.limit(0).withColumn("toxic", F.lit(1))) == ([], [])


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["predicted"] for r in toxicity.score_texts(docs, none).select("predicted").distinct().collect()} == {0}
    assert toxicity.score_texts(empty, none).count() == 0


def test_a_few_labels_teach_nothing(spark, docs):
    few = spark.createDataFrame([(0, 1), (1, 0), (4, 1), (5, 0)], "doc_id bigint, toxic int")
    odd = spark.createDataFrame([(0, "one", 1), (1, "two " * 30_000, 1), (4, None, 1), (5, "", 1), (None, "x", 1), (9, "idiot", 1)], "doc_id bigint, text string, score int").withColumn("toxic", F.lit(1)).withColumn("signs", F.lit("x"))
    got = toxicity.score_texts(odd, few).collect()
    assert len(got) == 6 and {round(r["score"], 6) for r in got} == {0.05} and {r["predicted"] for r in got} == {0}


def test_shares_are_compared_by_the_other_half():
    rng = np.random.default_rng(4)
    toxic, half = (np.arange(400) % 5 == 0).astype(int), np.arange(400) // 5 % 2
    clear, blurred = (np.c_[toxic * far + rng.normal(0, 1, 400), np.zeros((400, 3))] for far in (8, 1))
    assert toxicity.unlike(clear, toxic, half) < 0.1 < toxicity.unlike(blurred, toxic, half)
    assert toxicity.unlike(np.zeros((0, 4)), np.zeros(0), np.zeros(0)) == 0.0


def test_the_kernel_is_the_sum_over_gapped_subsequences():
    def explicit(word):
        codes = toxicity.encode([word])[0][0].tolist()
        out = Counter()
        for i in range(len(codes)):
            for a, b, c in toxicity.OFFSETS:
                if i + c < len(codes) and codes[i + c]:
                    out[codes[i], codes[i + a], codes[i + b], codes[i + c]] += toxicity.DECAY ** (c - 3)
        return out, toxicity._norms()[sum(x > 0 for x in codes)]
    marks = ["dummkopf", "trottel"]
    (a, na), (b, nb) = explicit("dummxkopf"), explicit(marks[0])
    table = np.zeros(toxicity.CODES, np.float32)
    codes, _ = toxicity.encode([marks[0]])
    for index, weight in toxicity.features(codes):
        np.add.at(table, index, np.float32(weight) / toxicity.lengths(codes)[:, None])
    table[0] = 0
    got = toxicity.Machine(table, 0.0).margins(["dummxkopf"])[0]
    assert math.isclose(got, sum(a[k] * b[k] for k in a) / (na * nb), rel_tol=1e-4)


# --- language model ---------------------------------------------------------

def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_base_scores_equal_brute_force(docs, rows, empty):
    lists = [(i, [*WORD.findall(lower(t)), ""]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in lists if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in lists)
    for chunk, bucket in ((lm.CHUNK_TOKENS, lm.BUCKET_TOKENS), (300, 100), (1, 10_000)):
        got = lm.score_texts(docs.withColumn("n", F.lit("x")).withColumn("row", F.lit(1)), chunk, bucket).collect()
        same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], want.elements())
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_texts(empty).count() == 0
    alone = lm.score_texts(docs.where("doc_id in (0, 1)").select(F.lit(3).alias("doc_id"), "text")).collect()  # 3 is held out
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in alone)


class Counts:
    """What the model counts, plainly: (n, c) of words, pairs from the place before a text on, and triples."""

    def __init__(self, texts):
        self.c = [Counter(), Counter(), Counter()]
        for t in texts:
            w = [*WORD.findall(lower(t)), ""]
            self.c[0].update(w)
            self.c[1].update(zip([None, *w], w))
            self.c[2].update(zip([None, *w], w, w[1:]))

    def score(self, text, near):
        w, total, every = [*WORD.findall(lower(text)), ""], 0.0, sum(self.c[0].values()) + 0.5 * (len(self.c[0]) + 1)
        for i, x in enumerate(w):
            before = w[i - 1] if i else None
            p = (self.c[0][x] + 0.5) / every
            n = self.c[0][before if i else ""]
            p = (min(near(self.c[1][before, x]), n) + lm.PRIOR[2] * p) / (n + lm.PRIOR[2])
            if i:
                old = w[i - 2] if i > 1 else None
                n = near(self.c[1][old, before])
                p = (min(near(self.c[2][old, before, x]), n) + lm.PRIOR[3] * p) / (n + lm.PRIOR[3])
            total += math.log10(p)
        return total


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{int(400 * rng.random() ** 2)}" for _ in range(rng.randint(0, 90))) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    plain = Counts(t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1)
    near = lambda n: float(lm.counts_of()[lm.level_of(np.array([n]))[0]])
    answers = []
    for chunk, most in ((1 << 20, lm.BROADCAST_BYTES), (500, lm.BROADCAST_BYTES), (1 << 20, 0), (500, 0)):  # neither the size of chunks nor where the filter is probed changes anything
        got = {r["doc_id"]: r["score"] for r in lm.score_texts(d, chunk, 700, most).collect()}
        off = sum(not math.isclose(got[i], plain.score(t, near), rel_tol=1e-6, abs_tol=1e-9) for i, t in enumerate(texts))
        assert len(got) == len(texts) and off <= 0.02 * len(texts)  # the filter's false positives: one of 5,000 absent n-grams
        answers.append(got)
    assert all(math.isclose(a[i], answers[0][i], rel_tol=1e-12) for a in answers for i in a)


def test_probabilities_after_a_context_add_up_to_one():
    rng = random.Random(3)
    texts = [" ".join(f"w{int(60 * rng.random() ** 3)}" for _ in range(40)) for _ in range(400)]
    plain = Counts(texts)
    words, level = [*plain.c[0]], lambda n: lm.level_of(np.array([n]))
    total, distinct = sum(plain.c[0].values()), len(words)
    for u, v in [("w0", "w0"), ("w1", "w0"), ("w9", "w3"), ("w50", "w0"), ("w0", "w59")]:
        mass = 0.0
        for x in [*words, "unseen"]:
            ws = [u, v, x]
            exact = np.array([*(plain.c[0][w] for w in ws), len(texts)])
            pairs = np.concatenate([level(plain.c[1][p]) for p in [(None, u), (u, v), (v, x), (x, "")]])
            triples = np.concatenate([level(0), *(level(plain.c[2][p]) for p in [(None, u, v), (u, v, x), (v, x, "")])])
            mass += lm.probabilities([pairs, pairs, triples], exact, np.array([4]), total, distinct)[2]
        assert abs(mass - 1) < 0.01


def test_filters_keep_every_level():
    rng = np.random.default_rng(2)
    keys, counts = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64), np.minimum(1 / rng.random(60_000), 1e6).astype(np.int64)
    found = lm.Filter(keys, lm.level_of(counts))
    got = found.levels(keys)
    assert (got >= lm.level_of(counts)).all() and (got > lm.level_of(counts)).mean() < 0.01
    assert (found.levels(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)) > 0).mean() < 0.01
    near = lm.counts_of()[lm.level_of(counts)] / counts
    assert (near[counts <= lm.EXACT] == 1).all() and abs(near - 1).max() < 0.05
    assert lm.Filter(keys[:0], counts[:0]).levels(keys[:5]).tolist() == [0] * 5
    asked = np.sort(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    where = lm.buckets_of(asked, 40, 37)
    assert (np.diff(where) >= 0).all() and set(where) == set(range(37))


def test_word_hashes_follow_words():
    long = "Word " * 300 + "x" * 3000 + " É\u00a0a\x0bb"
    texts = [t or "" for t in odd_texts()] + [long, long.lower()]
    hashes, sizes = lm.word_hashes([t.encode() for t in texts])
    want = [[*WORD.findall(lower(t)), ""] for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    of = {}
    for h, w in zip(hashes.tolist(), (w for ws in want for w in ws)):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


def test_long_texts_are_cut_at_words(monkeypatch):
    text = " ".join(vocabulary(400, 4)).encode() + b" " + b"y" * 500 + b"  z"
    whole, sizes = lm.word_hashes([text])
    monkeypatch.setattr(lm, "PIECE_BYTES", 50)
    assert b"".join(lm._cut(text)) == text and (lm.word_hashes([text])[0] == whole).all() and len(whole) == sizes[0]


def test_keys_pack_and_unpack():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    for v in (x, x >> np.uint64(30), x[:0]):
        assert (lm.unpack(lm.pack(v)) == v).all()


# --- registration -----------------------------------------------------------

def test_every_operator_has_a_query_and_the_pipeline_its_stages():
    import __spark_entry__
    import corpus_pipeline

    found = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)) and "pipeline" in found
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_take_effect(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and got.where("not round_trip").count() == 0
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, str(tmp_path))
        assert out.columns == docs.columns, name
        stage = out
