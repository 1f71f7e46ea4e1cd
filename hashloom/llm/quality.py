"""Quality rules: text statistics and a learned decision list, all in DataFrame expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import let, materialize, words_of

#: Repeated windows of more distinct hashes than this are found by sorting positions instead of by lookup.
LOOKUP = 32
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_marks", "n_distinct")


def _window_words(words: Column) -> Column:
    """Words inside a three-word window that the list holds at least twice."""
    def covered(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x))

    def by_lookup(hashes: Column, repeated: Column) -> Column:
        marks = F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i).otherwise(-1))
        return F.filter(marks, lambda i: i >= 0)

    def by_sorting(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def marked(s):
            same = lambda x, j: x["h"] == F.get(s, j)["h"]
            mark = lambda x, j: F.when(F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)), x["i"]).otherwise(-1)
            return F.sort_array(F.filter(F.transform(s, mark), lambda i: i >= 0))
        return let(pairs, marked)

    def of_hashes(hashes: Column) -> Column:
        # equal neighbours of the sorted hashes: each repeated value, once for each further occurrence
        again = let(F.sort_array(hashes), lambda s: F.array_distinct(
            F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())))
        found = let(again, lambda r: F.when(F.size(r) == 0, F.array().cast("array<int>"))
                    .when(F.size(r) <= LOOKUP, by_lookup(hashes, r)).otherwise(by_sorting(hashes)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(found, covered))

    windows = let(words, lambda w: F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    return let(windows, of_hashes)


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the long columns STATS of each whole text.

    A null text has no words. Columns of ``docs`` called like a statistic are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    less = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    word_stats = let(words_of(F.col(text)), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
        F.size(F.array_distinct(w)).alias("n_distinct"), _window_words(w).alias("n_repeat_words")))
    keep = [c for c in docs.columns if c not in STATS and c != text and c != "_w"]
    wide = docs.select(
        *keep, word_stats.alias("_w"), less(r"[#*$%&|<>]+").alias("n_symbols"), lines.alias("n_dup_lines"),
        F.length(t).alias("n_chars"), less(r"\p{Lu}+").alias("n_upper"), less(r"[!?|]+").alias("n_marks"))
    return wide.select(*keep, *[
        (F.col(f"_w.{c}") if c in ("n_words", "word_chars", "n_distinct", "n_repeat_words") else F.col(c)).cast("long").alias(c) for c in STATS])


def base_failed() -> Column:
    """The fixed rule: fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Ratios that conditions test, by name, as expressions over STATS."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"),
        "repeated": per("n_repeat_words", "n_words"), "upper": per("n_upper", "word_chars"), "marks": per("n_marks", "n_words"),
        "distinct": per("n_distinct", "n_words"), "dup_lines": per("n_dup_lines", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.threshold if self.above else x <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions hold."""
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def learn_rules(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, cuts: int = 24,
                min_precision: float = 0.95, min_cover: int = 8) -> list[Rule]:
    """Ordered rejection rules from rows of STATS with ``bad`` (boolean).

    Sequential covering: a rule grows by the threshold condition of best information gain
    on two thirds of the rows, loses its last conditions while that raises its precision
    on the other third, and is kept if the precision there reaches ``min_precision`` with
    ``min_cover`` bad rows over both parts. Rows that it covers leave, and the next rule
    starts. Every count is one aggregation over all labelled rows; only histograms of
    len(features) x ``cuts`` cells reach the driver. No rows, or no bad ones: no rules.
    """
    names = list(features())
    data = materialize(labelled.select("bad", F.col("part").alias("part"), *[x.alias(n) for n, x in features().items()]), "labelled")
    at = [i / cuts for i in range(1, cuts)]
    rows = data.groupBy("bad").agg(F.count("*").alias("n"), *[F.percentile_approx(n, at, 10000).alias(n) for n in names]).collect()
    if {r["bad"] for r in rows} != {True, False}:
        return []
    thresholds = {n: sorted({v for r in rows for v in r[n]}) for n in names}
    # written once: the sums of comparisons would else be planned and compiled again in each of the jobs below
    below = lambda x, cells: F.size(F.filter(F.lit(cells), lambda v: x > v))
    bins = F.array(*[below(F.col(n), thresholds[n]) for n in names])
    left = materialize(data.select("bad", "part", bins.alias("bins")), "binned")
    rules: list[Rule] = []

    def histogram(rows: DataFrame) -> dict:
        h = rows.where("part").select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(
            F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        return {(r["f"], r["b"]): (r["p"], r["n"]) for r in h.collect()}

    def best(h: dict) -> tuple[float, Condition | None]:
        p = sum(v[0] for (f, _), v in h.items() if f == 0)
        n = sum(v[1] for (f, _), v in h.items() if f == 0)
        if not p or not n:
            return 0.0, None
        found, base = (0.0, None), log2(p / (p + n))
        for f, name in enumerate(names):
            low = [0, 0]
            for b, v in enumerate(thresholds[name]):
                cell = h.get((f, b), (0, 0))
                low = [low[0] + cell[0], low[1] + cell[1]]
                for above, (a, c) in ((False, low), (True, (p - low[0], n - low[1]))):
                    gain = a * (log2(a / (a + c)) - base) if a >= min_cover else 0.0
                    if gain > found[0] + 1e-9:
                        found = (gain, Condition(name, above, v))
        return found

    def test(c: Condition) -> Column:
        k = len([v for v in thresholds[c.feature] if v < c.threshold])
        b = F.col("bins")[names.index(c.feature)]
        return b > k if c.above else b <= k

    while len(rules) < max_rules:
        grown, inside = [], left
        while len(grown) < max_conditions:
            gain, c = best(histogram(inside))
            if c is None or gain <= 0:
                break
            grown.append(c)
            inside = inside.where(test(c))
        if not grown:
            break
        cover, counts = F.lit(True), []
        for k, c in enumerate(grown):
            cover = cover & test(c)
            counts += [F.count_if(cover & F.col("bad") & ~F.col("part")).alias(f"p{k}"), F.count_if(cover & ~F.col("bad") & ~F.col("part")).alias(f"n{k}"),
                       F.count_if(cover & F.col("bad")).alias(f"all{k}")]
        r = left.agg(*counts).head()
        worth = lambda k: (r[f"p{k}"] + 1) / (r[f"p{k}"] + r[f"n{k}"] + 2)
        size = max(range(len(grown)), key=lambda k: (worth(k), -k))
        p, n = r[f"p{size}"], r[f"n{size}"]
        if not p or p / (p + n) < min_precision or r[f"all{size}"] < min_cover:
            break
        rules.append(Rule(tuple(grown[: size + 1])))
        covered = F.lit(True)
        for c in grown[: size + 1]:
            covered = covered & test(c)
        left = left.where(~covered)
    return rules


def decision(rules: list[Rule]) -> Column:
    """Index of the first rule that rejects, as one ordered conditional; null where none does."""
    out = None
    for i, r in enumerate(rules):
        out = (F.when if out is None else out.when)(r.column(), F.lit(i))
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that the base rule passes, with ``bad`` and ``part`` (true: grows rules, false: prunes them)."""
    taught = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return stats.where(~base_failed()).join(taught, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, STATS, base_failed, rule and kept for every row of ``docs`` (doc_id, text, others ignored).

    ``labels`` (doc_id, quality) teaches the rules: quality 0 is bad, other non-null values
    are good, and of several labels of one doc_id the least counts. Without usable labels
    only the base rule rejects. Null texts have no words and fail it; very long ones are
    measured whole. Ties between conditions go to the first feature and lower threshold;
    repeated rows each get a row, null ids stay and teach nothing, an empty table gives none.
    """
    stats = materialize(text_stats(docs.select("doc_id", "text")), "text-stats")
    rules = learn_rules(_labelled(stats, labels), **options)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules)).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps.

    Each row travels with its statistics through one written table, so that its text is
    neither measured twice nor shuffled.
    """
    row = F.struct(*docs.columns).alias("row")
    stats = materialize(text_stats(docs.select("doc_id", "text", row)), "documents-with-stats")
    rules = learn_rules(_labelled(stats.drop("row"), labels), **options)
    return stats.where(~base_failed() & decision(rules).isNull()).select("row.*")
