"""Rule learning and the step-up rule against plain versions over rows in memory."""

import math
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("hashloom.llm")

from hashloom.llm import quality, secrets  # noqa: E402


def ratios(r):
    per = lambda a, b: r[a] / r[b] if r[b] else 0.0
    return {"words": float(r["n_words"]), "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "repeated": per("n_repeat_words", "n_words"),
            "upper": per("n_upper", "word_chars"), "marks": per("n_marks", "n_words"), "distinct": per("n_distinct", "n_words"), "dup_lines": per("n_dup_lines", "n_words")}


def plain_rules(rows, max_rules, max_conditions, cuts, min_precision, min_cover):
    """Sequential covering as the docstring tells it: each count is a scan over the rows."""
    points = [(ratios(r), r["bad"], r["part"]) for r in rows]
    if {bad for _, bad, _ in points} != {True, False}:
        return []
    limits = {}
    for name in points[0][0]:
        limits[name] = set()
        for kind in (True, False):
            values = sorted(x[name] for x, bad, _ in points if bad is kind)
            limits[name] |= {values[max(math.ceil(i / cuts * len(values) - 1e-9) - 1, 0)] for i in range(1, cuts)}
    holds = lambda x, c: (x[c[0]] > c[2]) == c[1]
    rules, left = [], points
    while len(rules) < max_rules:
        inside, grown = [p for p in left if p[2]], []
        while len(grown) < max_conditions:
            p = sum(bad for _, bad, _ in inside)
            n = len(inside) - p
            if not p or not n:
                break
            best, chosen = 0.0, None
            for name in limits:
                for v in sorted(limits[name]):
                    for above in (False, True):
                        met = [bad for x, bad, _ in inside if (x[name] > v) == above]
                        a = sum(met)
                        gain = a * (math.log2(a / len(met)) - math.log2(p / (p + n))) if a >= min_cover else 0.0
                        if gain > best + 1e-9:
                            best, chosen = gain, (name, above, v)
            if chosen is None:
                break
            grown.append(chosen)
            inside = [p for p in inside if holds(p[0], chosen)]
        scores = []
        for k in range(len(grown)):
            met = [(bad, part) for x, bad, part in left if all(holds(x, c) for c in grown[: k + 1])]
            good = sum(not bad and not part for bad, part in met)
            hits = sum(bad and not part for bad, part in met)
            scores.append(((hits + 1) / (hits + good + 2), -k, hits, good, sum(bad for bad, _ in met)))
        if not scores:
            break
        _, k, hits, good, every = max(scores)
        if not hits or hits / (hits + good) < min_precision or every < min_cover:
            break
        rules.append(grown[: 1 - k])
        left = [p for p in left if not all(holds(p[0], c) for c in rules[-1])]
    return rules


@pytest.mark.parametrize("seed", range(4))
def test_rules_equal_a_plain_learner(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(420):
        n = rng.randint(50, 400)
        r = dict(n_words=n, word_chars=n * rng.randint(3, 9), n_symbols=rng.choice([0, 0, 1, n // 4]), n_dup_lines=rng.randint(0, 9), n_repeat_words=rng.randint(0, n // 2),
                 n_chars=n * 7, n_upper=rng.randint(0, n), n_marks=rng.randint(0, 5), n_distinct=rng.randint(n // 4, n))
        bad = r["n_symbols"] > 10 or seed % 2 and r["n_repeat_words"] > 0.4 * n and r["n_upper"] < n / 2
        rows.append(r | {"bad": bool(bad) != (rng.random() < 0.02), "part": rng.random() < 0.67})
    if seed == 3:
        rows += rows[:60]  # repeated rows count each
    d = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} bigint" for c in quality.STATS) + ", bad boolean, part boolean").repartition(3)
    for options in (dict(max_rules=8, max_conditions=3, cuts=24, min_precision=0.95, min_cover=8), dict(max_rules=3, max_conditions=1, cuts=6, min_precision=0.6, min_cover=2)):
        got = [[(c.feature, c.above, c.threshold) for c in r.conditions] for r in quality.learn_rules(d, **options)]
        assert got == plain_rules(rows, **options)
    assert got and quality.learn_rules(d.where("bad")) == [] == quality.learn_rules(d.where("false"))


def plain_step_up(tests, rate):
    """Benjamini and Hochberg: of each class, all up to the greatest k with p(k) <= rate k / m."""
    passed = set()
    for stratum in {s for _, s, _ in tests}:
        own = sorted((10 ** (-step / 10), key) for key, s, step in tests if s == stratum)
        best = max((k for k, (p, _) in enumerate(own, 1) if p <= rate * k / len(own)), default=0)
        limit = own[best - 1][0] if best else -1.0
        passed |= {key for p, key in own if p <= limit}
    return passed


@pytest.mark.parametrize("rate", [0.001, 0.01, 0.2, 1.0])
def test_the_step_up_rule_is_the_plain_one(spark, rate):
    rng = random.Random(7)
    docs, tests = [], []
    for i in range(120):
        cands = []
        for k in range(rng.randint(0, 5)):
            stratum = rng.choice(["base62:Aa0:4", "base32:A0:5", "HEX:A0:4", "lone:a:4"])
            step = rng.choice([0, 3, 10, 18, 25, 30, 60, secrets.STEPS]) if stratum != "lone:a:4" else rng.randint(0, 19)
            cands.append((k * 100, k * 100 + 20, stratum, step))
            tests.append(((i, k * 100), stratum, step))
        docs.append((i, [], cands))
    d = spark.createDataFrame(docs, f"doc_id bigint, base array<{secrets.SPAN}>, tested array<struct<start:int,end:int,stratum:string,step:int>>").repartition(4)
    got = {(r["doc_id"], s["start"]) for r in secrets.apply_rate(d, rate).collect() for s in r["found"]}
    assert got == plain_step_up(tests, rate)
    assert not secrets.apply_rate(d.where("doc_id < 0"), rate).collect()
