"""Hash comparisons, identifiers and hash aggregates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by what they make of a node.
SCRIPT_EXTENSIONS = ("py", "r", "jl", "sh", "m")
CLAIM_EXTENSIONS = ("tex", "bib", "bbl")


def starts_with_expected(current: Column, expected: Column) -> Column:
    """File comparison: the current hash begins with the expected one; an empty expectation matches."""
    return F.left(current, F.length(expected)) == expected


def consistent(a: Column, b: Column, fold_case: bool = False) -> Column:
    """Comparison over the shorter of two hashes; an empty or absent one never matches."""
    if fold_case:
        a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    n = F.least(F.length(a), F.length(b))
    return F.coalesce((n > 0) & (F.left(a, n) == F.left(b, n)), F.lit(False))


def combined_hash(key: Column, value: Column) -> Column:
    """Aggregate: sha256 of ``key:hash`` pairs, without separator, in order of key. Null pairs do not count."""
    pair = F.when(key.isNotNull() & value.isNotNull(), F.struct(key.alias("k"), value.alias("v")))
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat(x["k"], F.lit(":"), x["v"])), ""), 256)


def merkle_root(value: Column) -> Column:
    """Aggregate: '' of no hashes, a lone hash itself, else sha256 of the sorted hashes' bytes.

    Hashes that are not hexadecimal of even length enter as UTF-8.
    """
    all_ = F.array_sort(F.collect_list(value))
    raw = F.transform(all_, lambda h: F.when(h.rlike("^([0-9a-fA-F]{2})+$"), F.lower(h)).otherwise(F.lower(F.hex(F.encode(h, "UTF-8")))))
    return F.when(F.size(all_) == 0, "").when(F.size(all_) == 1, all_[0]).otherwise(F.sha2(F.unhex(F.array_join(raw, "")), 256))


def ledger_root(session: Column, combined: Column) -> Column:
    """Aggregate: sha256 over ``session||combined`` in order of session; null of no rows. One ordered digest, so one task."""
    rows = F.array_sort(F.collect_list(F.struct(session.alias("s"), F.coalesce(combined, F.lit("")).alias("h"))))
    return F.when(F.size(rows) > 0, F.sha2(F.array_join(F.transform(rows, lambda x: F.concat(x["s"], x["h"])), ""), 256))


def claim_id(path: Column, line: Column, kind: Column, value: Column) -> Column:
    """claim_ and twelve digits of sha256(location:type:value); line 0 or null means no line, a null value is empty."""
    place = F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(path, F.lit(":L"), line.cast("string"))).otherwise(path)
    return F.concat(F.lit("claim_"), F.substring(F.sha2(F.concat_ws(":", place, kind, F.coalesce(value, F.lit(""))), 256), 1, 12))


def short_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and twelve digits of sha256 of the colon-joined parts (hints, stamps)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def display_path(path: Column, mode: str = "name", base: str | None = None) -> Column:
    """A path to show: its name, relative to ``base`` if it lies there, or absolute (names from ``base`` on made whole); null and empty ones are unknown."""
    if mode not in ("name", "relative", "absolute"):
        raise ValueError(f"unknown path mode {mode}")
    known = (F.length(path) > 0) & (path != "unknown")
    root = (base or "").rstrip("/") + "/"
    shown = {"name": basename(F.rtrim(path, F.lit("/"))), "relative": F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path),
             "absolute": F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root), path))}[mode]
    return F.when(known, shown).otherwise("unknown")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def node_id(path: Column) -> Column:
    """file_<basename with . - and space as _>_<eight digits of md5(path)>."""
    return F.concat(F.lit("file_"), F.translate(basename(path), ".- ", "___"), F.lit("_"), F.substring(F.md5(path), 1, 8))


def node_class(role: Column, path: Column) -> Column:
    """source, input, output or claim by role and extension; null for a script role without script extension and for other roles."""
    ext = extension(path)
    script, claim = ext.isin(*SCRIPT_EXTENSIONS), ext.isin(*CLAIM_EXTENSIONS)
    return (F.when((role == "script") & script, "source").when((role == "input") & script, "source").when(role == "input", "input")
            .when((role == "output") & claim, "claim").when(role == "output", "output"))


def metadata_text(fields: dict[str, Column]) -> Column:
    """The JSON text that a citation's metadata hash is of: keys sorted, values trimmed and lower-cased, blanks left out; null if none is left.

    Separators are ', ' and ': '. Quotes, backslashes and control characters are escaped, others stay as they are.
    """
    parts = []
    for name in sorted(fields):
        v = F.lower(F.regexp_replace(fields[name].cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
        parts.append(F.when(v != "", F.concat(F.lit(f'"{name}": "'), _escaped(v), F.lit('"'))))
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.concat(F.lit("{"), F.array_join(kept, ", "), F.lit("}")))


def _escaped(text: Column) -> Column:
    out = F.regexp_replace(text, r'(["\\])', r"\\$1")
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    rare = out
    for code in range(32):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(named.get(code, f"\\u{code:04x}")))
    return F.when(text.rlike(r"[\x00-\x1f]"), rare).otherwise(out)


def metadata_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(metadata_text(fields), 256)
