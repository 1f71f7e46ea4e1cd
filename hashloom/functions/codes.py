"""Statuses, exit codes and severities, and the reductions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary of results.
VERIFIED, MISMATCH, SUSPECT, MISSING, UNKNOWN = "verified", "mismatch", "suspect", "missing", "unknown"
LEVELS = ("cache", "rerun", "registered")
CLAIM_TYPES = ("statistic", "figure", "table", "text", "value")
CLAIM_STATUSES = ("registered", "verified", "suspect", "mismatch", "missing", "superseded")
STATUS_COLOURS = {
    "verified": "2da44e", "suspect": "d29922", "mismatch": "cf222e", "missing": "a40e26",
    "registered": "6e7781", "exception": "8250df", "frozen": "0072b2", "unsourced": "b26a00",
}
BUCKET_COLOURS = {"verified": "2da44e", "suspect": "d29922", "failed": "cf222e", "exception": "8250df"}
BUCKETS = {"mismatch": "failed", "missing": "failed", "registered": "suspect", "unsourced": "suspect", "frozen": "verified"}
EXIT_CODES = {
    "OK": 0, "UNVERIFIED": 10, "SOURCE_MISSING": 11, "HASH_MISMATCH": 12, "NO_LINEAGE": 13,
    "CITATION_STUB": 14, "CITATION_UNRESOLVED": 15, "CITATION_UNLINKED": 16, "UNSOURCED": 17, "NO_CLAIMS": 20,
}
#: From harmless to worst.
SEVERITY_ORDER = (
    "OK", "NO_CLAIMS", "NO_LINEAGE", "UNSOURCED", "UNVERIFIED", "SOURCE_MISSING", "HASH_MISMATCH",
    "CITATION_UNLINKED", "CITATION_UNRESOLVED", "CITATION_STUB",
)
SEVERITIES = ("error", "warning", "ignore")

NAME_OF = {v: k for k, v in EXIT_CODES.items()}
RANK = {EXIT_CODES[n]: i for i, n in enumerate(SEVERITY_ORDER)}


def lookup(table: dict, key: Column, default=None) -> Column:
    """Value of ``key`` in a small constant table."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[key], F.lit(default)) if default is not None else m[key]


def worst_code(code: Column) -> Column:
    """Aggregate: the code of highest severity rank; 0 where there is none."""
    return F.coalesce(F.max_by(code, lookup(RANK, code)), F.lit(0))


def resolve_severity(config: dict[str, str] | None = None, overrides: dict[str, str] | None = None, strict: bool = False) -> dict[int, str]:
    """Severity of each exit code: defaults, then ``config``, then ``overrides``; ``strict`` makes missing lineage an error.

    Names are matched without regard to case, by name or number; unknown names or levels raise ValueError.
    """
    out = {c: "error" for c in NAME_OF} | {EXIT_CODES["NO_LINEAGE"]: "error" if strict else "warning"}
    for given in (config or {}, overrides or {}):
        for name, level in given.items():
            key = str(name).upper().replace("-", "_")
            code = EXIT_CODES.get(key, int(key) if key.isdigit() and int(key) in NAME_OF else None)
            if code is None or str(level).lower() not in SEVERITIES:
                raise ValueError(f"unknown severity setting {name}: {level}")
            out[code] = str(level).lower()
    return out


def classify_exit(fired: DataFrame, severity: dict[int, str], code: str = "code") -> DataFrame:
    """One row: exit_code, errors and warnings (sorted different codes) of a table of fired codes."""
    level = lookup(severity, F.col(code), "error")
    counted = fired.where(F.col(code) != 0).select(F.col(code).cast("int").alias("c"), level.alias("l"))
    pick = lambda l: F.array_sort(F.collect_set(F.when(F.col("l") == l, F.col("c"))))
    return counted.agg(worst_code(F.when(F.col("l") == "error", F.col("c"))).alias("exit_code"), pick("error").alias("errors"), pick("warning").alias("warnings"))


def run_exit_code(status: Column) -> Column:
    """Exit code of a single run's status."""
    return F.when(status == VERIFIED, 0).when(status == MISMATCH, 12).when(status == MISSING, 11).otherwise(10)


def worst_status(status: Column, order: tuple[str, ...] = (MISMATCH, MISSING, SUSPECT)) -> Column:
    """Aggregate: verified if all are (or none there are), else the first of ``order`` that occurs, else unknown."""
    out = F.when(F.coalesce(F.bool_and(status == VERIFIED), F.lit(True)), VERIFIED)
    for s in order:
        out = out.when(F.bool_or(status == s), s)
    return out.otherwise(UNKNOWN)
