"""Secret scans: fixed patterns, and a randomness test battery over encoded strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import let, materialize

# Patterns of the base kinds, in order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

# Classes of characters.
CLASSES = ("[A-Z]+", "[a-z]+", "[0-9]+", "[+/_-]+")
#: Strings that may be an encoding of random bytes.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
# Encodings and their alphabets, narrowest first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Index of coincidence of written words (English letters), whatever the alphabet they are read in.
COINCIDENCE = 0.0667
#: Least excess over a uniform alphabet that is taken for written (digits among sixteen: 16 / 10 - 1).
LEAST_EXCESS = 0.6
#: How often a written string goes from one class of characters (upper case, lower case, digits, marks) to another: in two cases, in one.
SWITCHES = (0.4, 0.25)
#: Strings are tested in classes of one encoding, one set of character classes and one octave of length, up to this many octaves.
OCTAVES = 24
#: P-values are counted in steps of a tenth of a decade, down to 10 ** -30.
STEPS = 300
#: Arrays grow in blocks of so many elements, so that a text's spans cost little more than their number; texts are cut in blocks of so many characters.
BLOCK, WIDTH = 256, 1024
SPAN = "struct<start:int,end:int,rank:int,kind:string>"
MATCH = "struct<start:int,end:int,rank:int,kind:string,m:string>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _running(values: Column, op) -> Column:
    """Running totals of an array of integers, from 0, by ``op``. The result grows in blocks, so that it is not copied each time."""
    def step(s: Column, x: Column) -> Column:
        at, full = op(s["at"], x), F.size(s["cur"]) >= BLOCK
        return F.struct(at.alias("at"), F.when(full, F.array(at)).otherwise(F.concat(s["cur"], F.array(at))).alias("cur"),
                        F.when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"))
    zero = F.struct(F.lit(0).alias("at"), _none("int").alias("cur"), _none("array<int>").alias("done"))
    return F.aggregate(values, zero, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["cur"]))))


def _occurrences(text: Column, pattern: str, least: int, group: int, kind: str) -> Column:
    """Array of MATCH: leftmost non-overlapping matches whose group has ``least`` characters."""
    def spans(ms: Column) -> Column:
        ends = _running(F.zip_with(F.slice(F.split(text, pattern), 1, F.size(ms)), ms, lambda gap, m: F.length(gap) + F.length(m)), lambda a, b: a + b)
        each = F.zip_with(ends, ms, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m.alias("m")))
        if group == 0:
            return F.filter(each, lambda x: F.length(x["m"]) >= least)
        wide = F.zip_with(each, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, g: F.when(F.length(g) >= least, x))
        return F.filter(wide, lambda x: x.isNotNull())
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(_none(MATCH))


def _runs(spans: Column) -> Column:
    """Maximal runs of touching or overlapping spans, which are ordered by start: array of (start, end)."""
    def of(reach: Column) -> Column:
        starts = F.filter(F.transform(spans, lambda x, i: F.when(x["start"] > F.coalesce(F.get(reach, i - 1), F.lit(-1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda f: F.transform(f, lambda k, j: F.struct(
            F.get(spans, k)["start"].alias("start"), F.get(reach, F.coalesce(F.get(f, j + 1), F.size(spans)) - 1).alias("end"))))
    return let(_running(F.transform(spans, lambda x: x["end"]), F.greatest), of)


def _replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with each of ``_runs(spans)`` replaced by ``by(run)``."""
    def of(blocks: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first, last = F.floor(start / WIDTH).cast("int"), F.floor((end - 1) / WIDTH).cast("int")
            return F.when(end > start, F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * WIDTH + 1, end - start)).otherwise("")

        def joined(runs: Column) -> Column:
            pieces = F.transform(runs, lambda r, i: F.concat(cut(F.coalesce(F.get(runs, i - 1)["end"], F.lit(0)), r["start"]), by(r)))
            return F.concat(F.array_join(pieces, ""), cut(F.element_at(runs, -1)["end"], F.length(text)))
        return let(_runs(spans), joined)
    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % WIDTH), F.lit(0)), of)).otherwise(text)


def _normal(z: Column) -> Column:
    """Lower tail of the standard normal law (Abramowitz and Stegun 26.2.17, error under 1e-7)."""
    def of(x):
        t = 1 / (1 + 0.2316419 * F.abs(x))
        tail = F.exp(-x * x / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.when(x < 0, tail).otherwise(1 - tail)
    return let(z, of)


def _battery(token: Column) -> Column:
    """(encoding, kinds, p) of a string, or null where no alphabet fits.

    p: one value from three tests, each of which asks how likely a written string of this
    length would look as random as this one, by Fisher's sum of logarithms (with its law
    for independent values). Chi-squared of the alphabet's counts, against the
    non-centrality that COINCIDENCE gives a written character in this alphabet; runs of
    one class of characters, against the SWITCHES of written strings; lag-one serial
    correlation, against independent characters. kinds: classes of characters it has.
    """
    fits = [F.when(token.rlike(f"^[{a.replace('-', '')}{'-' * ('-' in a)}]+$"), F.struct(F.lit(n).alias("e"), F.lit(a).alias("a"))) for n, a in ALPHABETS]

    def tests(v: Column) -> Column:
        x, k, n, a = v["x"], v["k"], v["n"], v["a"]
        counts = F.transform(F.split(a, ""), lambda c: F.when(c == "", 0.0).otherwise(F.pow((n - F.length(F.replace(v["t"], c, F.lit("")))), F.lit(2))))
        chi = F.aggregate(counts, F.lit(0.0), lambda s, y: s + y) * k / n - n
        mean = F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / n
        pairs = F.zip_with(F.slice(x, 2, F.size(x)), F.slice(x, 1, F.size(x) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        # runs of one class: what is left of the string when each is cut down to one mark
        runs = v["t"]
        for letter, kind in zip(".:;,", CLASSES):
            runs = F.regexp_replace(runs, kind, letter)
        return F.struct(v["e"].alias("e"), k.alias("k"), n.alias("n"), chi.alias("chi"), mean.alias("mean"), F.length(runs).cast("double").alias("runs"), x.alias("x"), pairs.alias("pairs"),
                        v["kinds"].alias("kinds"))

    def verdict(v: Column) -> Column:
        k, n = v["k"], v["n"]
        variance = F.aggregate(v["x"], F.lit(0.0), lambda s, y: s + (y - v["mean"]) * (y - v["mean"]))
        covariance = F.aggregate(v["pairs"], F.lit(0.0), lambda s, y: s + (y["p"] - v["mean"]) * (y["q"] - v["mean"]))
        # a string of one character is as dependent as can be
        serial = F.when(variance > 0, (covariance / variance * n + 1) / F.sqrt(n)).otherwise(F.lit(99.0))
        excess = F.greatest(k * COINCIDENCE - 1, F.lit(LEAST_EXCESS)) * n
        written = (v["chi"] - (k - 1 + excess)) / F.sqrt(2 * (k - 1) + 4 * excess)
        rate = F.when(v["kinds"].contains("A") & v["kinds"].contains("a"), SWITCHES[0]).otherwise(SWITCHES[1])
        switches = (v["runs"] - 1.5 - rate * (n - 1)) / F.sqrt(rate * (1 - rate) * (n - 1))
        values = [_normal(written), 1 - _normal(switches), 1 - 2 * _normal(-F.abs(serial))]
        log = -sum((F.log(F.greatest(p, F.lit(1e-12))) for p in values), F.lit(0.0))
        return F.struct(v["e"].alias("encoding"), v["kinds"].alias("kinds"), *[p.alias(n) for p, n in zip(values, ("p_chi", "p_runs", "p_serial"))], log.alias("log"))

    def combined(v: Column) -> Column:
        p = F.exp(-v["log"]) * (1 + v["log"] + v["log"] * v["log"] / 2)
        return F.struct(v["encoding"].alias("encoding"), v["kinds"].alias("kinds"), v["p_chi"].alias("p_chi"), v["p_runs"].alias("p_runs"), v["p_serial"].alias("p_serial"), p.alias("p"))

    def first(f: Column) -> Column:
        kinds = F.concat(*[F.when(token.rlike(c), F.lit(n)).otherwise("") for n, c in zip("Aa0-", CLASSES)])
        return F.struct(
            f["e"].alias("e"), f["a"].alias("a"), F.length(f["a"]).cast("double").alias("k"), F.length(token).cast("double").alias("n"), token.alias("t"), kinds.alias("kinds"),
            F.transform(F.array_remove(F.split(token, ""), ""), lambda c: F.instr(f["a"], c).cast("double") - 1).alias("x"))
    return let(F.coalesce(*fits), lambda f: F.when(f.isNotNull(), let(let(let(first(f), tests), verdict), combined)))


def _stratum(battery: Column, length: Column) -> Column:
    return F.concat_ws(":", battery["encoding"], battery["kinds"], F.least(F.floor(F.log2(length.cast("double"))), F.lit(OCTAVES)).cast("string"))


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found for every row of ``docs`` (doc_id, text, others ignored).

    found: array of (start, end, rank, kind) in code points, end exclusive, ordered by
    start, then kind. Base kinds follow fixed patterns. Kind random: strings between base
    spans whose combined p-value passes the step-up rule of Benjamini and Hochberg at a
    false-discovery ``rate``, within each class of encoding, kinds of characters and
    octave of length. Every candidate counts as a test, none is left out for its value.
    Counts for the rule cover all rows; only class totals (7 encodings x 15 sets x 25
    octaves x 301 steps at most) reach the driver. Null texts are empty, and have no
    spans. Repeated rows and null doc_ids stay as they are. Long texts with many secrets
    take time in proportion. An empty table gives an empty result.

    Short strings of narrow alphabets are not told from written ones at this rate:
    see ``detection`` in the README for what is found by encoding and length.
    """
    scanned = materialize(scan(docs.select("doc_id", "text")), "scanned")
    return apply_rate(scanned, rate)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with base spans and tested candidates (arrays ``base``, ``tested``)."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.sort_array(F.transform(F.concat(
        _occurrences(t, ASSIGN, 6, 2, "assign"), _occurrences(t, ACCESS, 20, 0, "access"), _occurrences(t, HEX, 24, 0, "hex")), lambda s: s.dropFields("m")))
    # base spans turn into blanks, so that candidates lie between them
    tokens = _occurrences(F.col("bare"), CANDIDATE, 20, 0, "random")
    battery = F.transform("cands", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _battery(c["m"]).alias("b")))
    tested = F.transform(F.filter(battery, lambda c: c["b"].isNotNull()), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), _stratum(c["b"], c["end"] - c["start"]).alias("stratum"),
        F.least(F.floor(-10 * F.log10(F.greatest(c["b"]["p"], F.lit(1e-300)))), F.lit(STEPS)).cast("int").alias("step")))
    keep = [c for c in docs.columns if c not in (text, "base", "tested", "cands", "bare")]
    found = docs.select(*keep, t.alias("bare"), base.alias("base"))
    found = found.withColumn("bare", _replaced(F.col("bare"), F.col("base"), lambda r: F.repeat(F.lit(" "), r["end"] - r["start"])))
    return found.select(*keep, "base", tokens.alias("cands")).select(
        *keep, "base", F.when(F.size("cands") > 0, tested).otherwise(_none("struct<start:int,end:int,stratum:string,step:int>")).alias("tested"))


def apply_rate(scanned: DataFrame, rate: float) -> DataFrame:
    """Decide the tested candidates of ``scan`` at a false-discovery ``rate``."""
    cells = scanned.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.step").agg(F.count("*").alias("n"))
    counts: dict[str, dict[int, int]] = {}
    for r in cells.collect():
        counts.setdefault(r["stratum"], {})[r["step"]] = r["n"]
    limits = {}
    for stratum, steps in counts.items():
        total, below, best = sum(steps.values()), 0, None
        for step in sorted(steps, reverse=True):  # from the least p-value up; a step's largest value stands for all of it
            below += steps[step]
            if 10 ** (-step / 10) <= rate * below / total:
                best = step
        if best is not None:
            limits[stratum] = best
    passes = F.lit(False)
    if limits:
        table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        passes = lambda c: F.coalesce(c["step"] >= table[c["stratum"]], F.lit(False))
    extra = F.transform(F.filter("tested", passes), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), F.lit(KINDS.index("random")).alias("rank"), F.lit("random").alias("kind"))) if limits else _none(SPAN)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    by_kind = lambda spans: F.array_sort(spans, lambda a, b: F.when(
        (a["start"] != b["start"]), a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    keep = [c for c in scanned.columns if c not in ("base", "tested")]
    return scanned.withColumn("base", by_kind(F.col("base"))).withColumn("found", by_kind(F.concat("base", extra))).select(
        *keep, of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("found")).alias("spans"), "found")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each maximal run of touching or overlapping spans replaced by ``mark``."""
    return _replaced(text, found, lambda r: F.lit(mark))


def redact_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """``docs`` (all columns) with secrets in its text redacted, and n_chars, if there, counted anew."""
    scanned = materialize(scan(docs.select(F.struct(*docs.columns).alias("row"), "text")), "scanned-docs")
    out, text = apply_rate(scanned, rate), redact(F.col("row.text"), F.col("found"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("found") > 0, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
