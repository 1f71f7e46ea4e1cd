"""Estimates from the history of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.operators import lineage

HEAVY_SECONDS = 300.0


def duration(started: Column, finished: Column) -> Column:
    """Seconds between two times; null if either is, or if it is negative."""
    d = (F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1e6
    return F.when(d >= 0, d)


def successful() -> Column:
    return F.coalesce((F.col("status") == "success") | (F.col("exit_code") == 0), F.lit(False))


def output_volume(files: DataFrame) -> DataFrame:
    """(session_id, n_outputs, bytes); bytes are null where no output has a size."""
    return files.where("role = 'output'").groupBy("session_id").agg(F.count("*").alias("n_outputs"), F.sum("size_bytes").alias("bytes"))


def history(runs: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """Statistics of the finished runs of each script hash or path (``by``).

    n, p50 and p90 (linear interpolation), success_rate, typical_outputs and
    typical_bytes (medians, cut to whole numbers), all unrounded where fractional.
    """
    done = runs.where("finished_at is not null").where(F.col(by).isNotNull()).withColumn("_d", duration(F.col("started_at"), F.col("finished_at")))
    x = done.join(output_volume(files), "session_id", "left").withColumn("n_outputs", F.coalesce("n_outputs", F.lit(0)))
    return x.groupBy(by).agg(
        F.count("*").alias("n"), F.percentile("_d", 0.5).alias("p50"), F.percentile("_d", 0.9).alias("p90"),
        F.avg(successful().cast("double")).alias("success_rate"), F.median("n_outputs").cast("long").alias("typical_outputs"), F.median("bytes").cast("long").alias("typical_bytes"))


def estimates(wanted: DataFrame, runs: DataFrame, files: DataFrame, heavy_threshold: float = HEAVY_SECONDS) -> DataFrame:
    """Estimates of scripts (script_path, script_hash): by exact hash, else by path, else a cold start with nulls.

    p50 and p90 are rounded to one digit and the rate to three, half to even.
    """
    a, b = history(runs, files, "script_hash"), history(runs, files, "script_path")
    stats = ("n", "p50", "p90", "success_rate", "typical_outputs", "typical_bytes")
    one = wanted.join(a.select("script_hash", *[F.col(c).alias(f"a_{c}") for c in stats]), "script_hash", "left").join(
        b.select("script_path", *[F.col(c).alias(f"b_{c}") for c in stats]), "script_path", "left")
    tier = F.when(F.col("a_n").isNotNull(), "exact_hash").when(F.col("b_n").isNotNull(), "path_history").otherwise("unknown")
    pick = lambda c: F.when(F.col("tier") == "exact_hash", F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    out = one.withColumn("tier", tier)
    return out.select("script_path", "script_hash", "tier", F.coalesce(pick("n"), F.lit(0)).alias("n"), F.bround(pick("p50"), 1).alias("p50"), F.bround(pick("p90"), 1).alias("p90"),
                      F.bround(pick("success_rate"), 3).alias("success_rate"), pick("typical_outputs").alias("typical_outputs"), pick("typical_bytes").alias("typical_bytes"),
                      F.coalesce(pick("p90") > heavy_threshold, F.lit(False)).alias("heavy"))


def resolve_scripts(wanted: DataFrame, runs: DataFrame, files: DataFrame, disk: DataFrame) -> DataFrame:
    """(identifier, script_path, script_hash) of scripts or output files: what ``estimates`` wants.

    A path that ends in .py is a script itself. Another one that is there is an output: its
    script is that of its newest producer (null if nobody wrote it). One that is not there
    is taken as a script. script_hash is that of the file as it is now, null if it is gone.
    """
    ids = wanted.select("identifier").distinct()
    now = disk.where("exists").select(F.col("file_path").alias("_p"), F.col("current_hash").alias("_h"))
    there = ids.join(now.select(F.col("_p").alias("identifier"), F.lit(True).alias("_there")), "identifier", "left")
    made = lineage.newest_producers(files).select(F.col("file_path").alias("identifier"), "session_id").join(runs.select("session_id", F.col("script_path").alias("_script")), "session_id", "left")
    own = F.lower("identifier").endswith(".py") | F.col("_there").isNull()
    path = there.join(made, "identifier", "left").select("identifier", F.when(own, F.col("identifier")).otherwise(F.col("_script")).alias("script_path"))
    return path.join(now, F.col("script_path") == F.col("_p"), "left").select("identifier", "script_path", F.col("_h").alias("script_hash"))


def target_estimates(wanted: DataFrame, runs: DataFrame, files: DataFrame, disk: DataFrame, heavy_threshold: float = HEAVY_SECONDS) -> DataFrame:
    """``estimates`` by identifier: a script, or a file whose script is looked up."""
    found = resolve_scripts(wanted, runs, files, disk)
    told = estimates(found.select("script_path", "script_hash").distinct(), runs, files, heavy_threshold)
    same = F.col("script_path").eqNullSafe(F.col("_path")) & F.col("script_hash").eqNullSafe(F.col("_hash"))
    return found.join(told.withColumnsRenamed({"script_path": "_path", "script_hash": "_hash"}), same).drop("_path", "_hash")


def _size_text(size: Column) -> Column:
    """A number of bytes in the largest unit that it has at least one of."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024 ** power, F.concat(F.format_number(size / 1024 ** power, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def hint(tier: Column, p90: Column, success_rate: Column, heavy: Column, typical_bytes: Column) -> Column:
    """What to expect, as text: whether the script changed, how long nine of ten runs took, their output, how many failed."""
    took = F.when(p90 >= 60, F.concat(F.format_number(p90 / 60, 0), F.lit(" min"))).otherwise(F.concat(F.format_number(p90, 0), F.lit(" s")))
    parts = [
        F.when(tier == "path_history", "the script has changed: told from its earlier versions"),
        F.when(heavy, F.concat(F.lit("long: up to "), took, F.lit("; try a part first, or run it in the background"))).otherwise(F.concat(F.lit("up to "), took)),
        F.concat(F.lit("output of about "), _size_text(typical_bytes)),
        F.when(success_rate < 1, F.concat(F.format_number((1 - success_rate) * 100, 0), F.lit("% of the runs failed")))]
    return F.when(tier == "unknown", "no earlier runs: nothing to estimate from").otherwise(F.concat_ws("; ", *parts))
