"""Mixing sources to target weights: budgets down a domain-language-source tree, then seeded token prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.llm.common import materialize, words_of

LEVELS = ("domain", "lang", "source")


def _weight(names: Column, weights: dict[str, int]) -> Column:
    """Integer weight of each name; names that ``weights`` lacks weigh its "*", or 1."""
    other = F.lit(int(weights.get("*", 1))).cast("long")
    named = {k: v for k, v in weights.items() if k != "*"}
    if not named:
        return other
    table = F.create_map(*[F.lit(x) for k, v in sorted(named.items()) for x in (k, int(v))])
    return F.coalesce(table[names].cast("long"), other)


def share(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``children`` with ``got``: each parent's ``budget`` dealt to its children by weight ``w`` up to ``cap``.

    Children that cannot use their share are filled to the cap and what they leave goes
    to their siblings by weight (water filling). Shares are whole tokens and add up to
    the budget, or to all caps where that is less. Ties of cap to weight go by name.
    """
    by = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), name)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parents)
    live = children.where("w > 0 and cap > 0")
    x = live.withColumn("before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("rest", F.sum("w").over(after))
    x = x.withColumn("full", F.col("cap") / F.col("w") * F.col("rest") <= F.col("budget") - F.col("before"))
    x = x.withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
    x = x.withColumn("open", F.when(F.col("full"), 0).otherwise(F.col("w")))
    x = x.withColumn("sum", F.sum("open").over(whole)).withColumn("upto", F.sum("open").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = F.expr("(left * upto) div sum - (left * (upto - open)) div sum")
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.least(dealt, F.col("cap")))
    return x.withColumn("got", got).drop("before", "rest", "full", "left", "open", "sum", "upto")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """Leaves (LEVELS, available, rows) with ``target`` tokens each.

    A node's capacity is its leaves' tokens times ``max_epochs``. Budgets go from the
    root down, so a leaf's shortage is met by its siblings first, and reaches an
    ancestor's siblings only when the whole subtree is exhausted.
    """
    caps = leaves.withColumn("cap", F.col("available") * max_epochs)
    for level in LEVELS:
        caps = caps.withColumn(f"w_{level}", _weight(F.col(level), weights.get(level, {})))
    caps = caps.where(" and ".join(f"w_{level} > 0" for level in LEVELS))
    parents: list[str] = []
    given = None
    for level in LEVELS:
        nodes = caps.groupBy(*parents, level).agg(F.sum("cap").alias("cap"), F.first(f"w_{level}").alias("w"))
        if given is None:
            total = leaves.agg(budget.cast("long")).head()[0]
            given = share(nodes.withColumns({"root": F.lit(0), "budget": F.lit(total or 0)}), ["root"], level)
        else:
            given = share(nodes.join(given, parents), parents, level)
        parents = [*parents, level]
        given = given.select(*parents, F.col("got").alias("budget"))
    return leaves.join(given, list(LEVELS), "left").withColumn("target", F.coalesce("budget", F.lit(0))).drop("budget")


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with ``key``, their place in the epoch's seeded order, and ``part``, one of about sqrt(rows) even ranges of it."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("_h").cast("string")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), name))
    unit = F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    return rows.withColumn("key", key).withColumn("part", F.floor(unit * F.ceil(F.sqrt("rows"))))


def plan(narrow: DataFrame, weights: dict[str, dict[str, int]], budget: Column, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(leaves, decided): what each leaf takes, and which rows of its boundary range.

    narrow: doc_id, _h (hash of the text), LEVELS, n_tokens. A leaf of target T and A
    tokens takes every document T div A times, and of the next epoch's order those that
    start before token T mod A. Token sums of about sqrt(rows) ranges of that order find
    the range that holds the boundary; only its rows are sorted.
    """
    leaves = materialize(narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available"), F.count("*").alias("rows")), "leaf-sizes")
    dealt = budgets(leaves, weights, budget, max_epochs).withColumn("epochs", F.expr("if(available > 0, target div available, 0)")).withColumn(
        "rest", F.expr("if(available > 0, target % available, 0)"))
    dealt = materialize(dealt.select(*LEVELS, "available", "rows", "target", "epochs", "rest"), "leaves")
    placed = _placed(narrow.join(dealt.where("rest > 0"), list(LEVELS)), seed)
    parts = placed.groupBy(*LEVELS, "rest", "part").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edge = parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where("before < rest and before + n >= rest")
    edge = edge.groupBy(*LEVELS).agg(F.min("part").alias("edge"), F.min_by("before", "part").alias("before"))
    leaves = materialize(dealt.join(edge, list(LEVELS), "left"), "leaf-edges")
    rows = _placed(narrow.join(leaves.where("edge is not null"), list(LEVELS)), seed).where("part = edge")
    order = Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "_h", "n_tokens")
    run = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    decided = rows.withColumn("run", run).withColumn("inside", F.col("before") + F.col("run") < F.col("rest"))
    decided = decided.groupBy("doc_id", "_h", *LEVELS).agg(F.count_if("inside").alias("inside"), F.count("*").alias("same"))
    return leaves, materialize(decided, "edge-rows")


def _copies(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], percent: int, max_epochs: int, seed: int) -> DataFrame:
    """(row, LEVELS, n_tokens, copies): every row of ``docs``, whole in a struct, whatever its columns are called."""
    base = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(domain, F.lit("")).alias("domain"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")],
                       "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"), F.xxhash64("text").alias("_h"))
    narrow = materialize(base.drop("row"), "tokens")
    leaves, decided = plan(narrow, weights, F.expr(f"sum(available) * {int(percent)} div 100"), max_epochs, seed)
    placed = _placed(base.join(leaves.select(*LEVELS, "rows", "epochs", "edge", "rest"), list(LEVELS)), seed)
    at_edge = F.coalesce(F.col("part") == F.col("edge"), F.lit(False))
    clear = placed.where(~at_edge).withColumn("copies", F.col("epochs") + F.coalesce((F.col("part") < F.col("edge")).cast("long"), F.lit(0)))
    close = placed.where(at_edge).join(
        decided.toDF("_id", "_h2", "domain2", "lang2", "source2", "inside", "same"),
        F.expr("doc_id <=> _id and _h = _h2 and domain = domain2 and lang = lang2 and source = source2"))
    turn = Window.partitionBy("doc_id", "_h", *LEVELS).orderBy("n_tokens")
    one = close.where("same = 1").withColumn("copies", F.col("epochs") + F.col("inside"))
    more = close.where("same > 1").withColumn("copies", F.col("epochs") + (F.row_number().over(turn) <= F.col("inside")).cast("long"))
    out = ["row", "domain", "n_tokens", "copies"]
    return clear.select(*out).union(one.select(*out)).union(more.select(*out))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], percent: int = 70, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """``docs`` with domain, n_tokens (words) and ``copies``: how often each row is to be used.

    The budget is ``percent`` of all tokens. Null levels count as the empty name; null
    texts have no tokens and take none of a budget (their copies follow their leaf's
    whole epochs). A leaf of weight 0 gives nothing. Null doc_ids are ordered by their
    texts' hashes. Of repeated rows in a boundary range, as many as fit are used, first
    come by order of the row. Columns of ``docs`` that are called domain, n_tokens or
    copies are replaced, all others come through. An empty table stays empty. Siblings
    of one node are sorted together; there are as many as a domain and language has sources.
    """
    spare = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    return _copies(docs, domain, weights, percent, max_epochs, seed).select(*spare, "domain", "n_tokens", "copies")


def take(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], percent: int = 70, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, all its columns, each as often as ``mix`` says."""
    mixed = _copies(docs, domain, weights, percent, max_epochs, seed).where("copies > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
