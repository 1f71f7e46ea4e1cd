"""The five stages of the pipeline, one after the other, against a plain version of each."""

import random
import sys
from collections import Counter

import pytest

from hashloom.llm import pieces
from hashloom.llm.queries import MIXING_SQL, MODEL

sys.path.insert(0, __file__.rpartition("/")[0])
from test_operators import DOCS, base_spans, base_stats, brute_components, brute_simhash, same, vocabulary  # noqa: E402


def planted():
    rng, words, rows = random.Random(11), vocabulary(700, 6), []
    for i in range(90):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(55, 160))), rng.choice(["en", "de", None]), f"src{rng.randrange(4)}"))
    rows += [(100 + k, rows[k][1], "en", "src1") for k in range(8)]  # exact copies
    rows += [(120 + k, rows[20 + k][1] + " token=abcdef" + "gh" * k, "de", "src2") for k in range(6)]  # near copies and secrets
    rows += [(140 + k, rows[40 + k][1][::-1] + " AKIA" + "B2" * 9 + " and password: opensesame", "en", "src0") for k in range(5)]
    rows += [(160, "too short", "en", "src0"), (161, "one two three " * 60, "en", "src0"), (162, None, None, None), (163, "", "en", "src3")]
    rows += [rows[50], rows[50], (51, rows[60][1][::-1], "en", "src9"), (None, rows[52][1], "en", "src8")]  # the last two alone in their leaves
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def plain_quality(rows):
    stats = [base_stats(r[1]) for r in rows]
    return [r for r, s in zip(rows, stats) if s[0] >= 50 and 100 * s[4] <= 50 * s[0]]


def plain_near_dedup(rows):
    fps = [brute_simhash(r[1]) for r in rows]
    label = brute_components(fps)
    groups = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            groups.setdefault(label[f], []).append(r)
    return [min(g, key=lambda r: r[0]) for g in groups.values()] + [r for r in rows if r[0] is None]


def plain_redact(text):
    out, at = "", 0
    for a, _, _, b in base_spans(text):
        if a > at or not at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def plain_secrets(rows):
    texts = [plain_redact(r[1]) for r in rows]
    return [(r[0], t, *r[2:4], len(t)) for r, t in zip(rows, texts)]


def plain_mix(rows):
    """Copies by the query's SQL, which has no null levels: they count as the empty name. Rows of one doc_id differ in source."""
    import duckdb
    import pandas as pd

    documents = pd.DataFrame([(*r[:2], *(x or "" for x in r[2:4])) for r in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    copies = dict(duckdb.sql(MIXING_SQL).select("(doc_id, source), copies").fetchall())
    return [r for r in rows for _ in range(copies[r[0], r[3]])]


@pytest.mark.parametrize("drop", [False, True])
def test_pipeline_equals_plain_stages(spark, tmp_path, drop):
    import corpus_pipeline

    rows = [] if drop else planted()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = rows
    if rows:
        for (name, stage), plain in zip(corpus_pipeline.STAGES, (plain_quality, plain_near_dedup, plain_secrets, plain_mix)):
            before, want = want, plain(want)
            got = stage(spark, spark.createDataFrame(before, DOCS), str(tmp_path)).collect()
            assert before != want, name
            assert Counter(map(tuple, got)) == Counter(want), name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and docs.count() == len(rows)
    found = out.collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)
    codec = pieces.Codec(*pieces.read_model(MODEL))
    same([(r["doc_id"], codec.decode(r["ids"])) for r in found], [r[:2] for r in want])
