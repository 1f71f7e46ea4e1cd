"""Lineage over files: producers, edges, bounded closures, orders and forward propagation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.plans.scratch import materialize


def producers(files: DataFrame) -> DataFrame:
    """(file_path, session_id, at): when each session last wrote each path."""
    return files.where("role = 'output'").groupBy("file_path", "session_id").agg(F.max("recorded_at").alias("at"))


def newest_producers(files: DataFrame, keep: int = 1) -> DataFrame:
    """The ``keep`` newest producers of each path with ``rank``; equal times go by session id.

    A bounded top-k a path: Spark prunes each partition to ``keep`` rows before the shuffle.
    """
    order = Window.partitionBy("file_path").orderBy(F.desc("at"), "session_id")
    return producers(files).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def file_edges(files: DataFrame) -> DataFrame:
    """(child, parent): who read what whom wrote. Only a path's newest producer other than the reader counts.

    The two newest producers of a path are enough: if the newest is the reader itself,
    the second is taken. There is no condition on time.
    """
    first = newest_producers(files, 2)
    pair = first.groupBy("file_path").agg(
        F.max(F.when(F.col("rank") == 1, F.col("session_id"))).alias("newest"), F.max(F.when(F.col("rank") == 2, F.col("session_id"))).alias("next"))
    read = files.where("role = 'input'").select(F.col("session_id").alias("child"), "file_path")
    parent = F.when(F.col("newest") != F.col("child"), F.col("newest")).otherwise(F.col("next"))
    return read.join(pair, "file_path").select("child", parent.alias("parent")).where("parent is not null").distinct()


def traced(files: DataFrame) -> DataFrame:
    """``files`` with ``parent`` (of an input: whose file it read, as in ``file_edges``), ``newest`` (the path's newest producer), ``first`` and ``needed``.

    first: true in one row of each path. needed: true in rows of outputs whose session is
    the newest producer or the parent of somebody. Rows without a path make and read
    nothing. All comes from one window by path, so files that are dealt by path stay where
    they are; a path's rows meet in one task.
    """
    by = Window.partitionBy("file_path").orderBy(F.desc("role"), F.desc("recorded_at"), "session_id")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made, me = (F.col("role") == "output") & F.col("file_path").isNotNull(), F.col("session_id")
    x = files.withColumn("newest", F.first(F.when(made, me), ignorenulls=True).over(whole)).withColumn("first", F.row_number().over(by) == 1)
    x = x.withColumn("_mine", me == F.col("newest")).withColumns({
        "_next": F.first(F.when(made & ~F.col("_mine"), me), ignorenulls=True).over(whole), "_own": F.bool_or((F.col("role") == "input") & F.col("_mine")).over(whole)})
    parent = F.when(F.col("role") == "input", F.when(~F.col("_mine"), F.col("newest")).otherwise(F.col("_next")))
    needed = made & (F.col("_mine") | (F.col("_own") & (me == F.col("_next"))))
    return x.withColumn("parent", parent).withColumn("needed", F.coalesce(needed, F.lit(False))).drop("_mine", "_next", "_own")


def recorded_edges(runs: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, parent) as recorded with the runs: listed parents, and a run's own parent where none is listed."""
    listed = parents.select(F.col("session_id").alias("child"), F.col("parent_session").alias("parent"))
    own = runs.where("parent_session is not null").select(F.col("session_id").alias("child"), F.col("parent_session").alias("parent"))
    return listed.union(own.join(listed.select("child"), "child", "left_anti")).where("child <> parent").distinct()


def paths(edges: DataFrame) -> DataFrame:
    """(session_id, path) of every child in ``edges`` with one parent each: its ancestors, nearest first, each once.

    Path doubling: in round k each pending child appends the path of the last session of
    its own, which is as long, so chains of n take log2(n) rounds, and no pair is looked
    up among those met before. A path that meets a session again, or its own child, has
    gone round a cycle and ends there. What is written adds up to the result's size.
    """
    columns = ["session_id", "path", "more"]

    def told(path: Column, more: Column) -> Column:
        once = F.array_remove(F.array_distinct(path), F.col("session_id"))
        return F.struct(once.alias("path"), (more & (F.size(once) == F.size(path))).alias("more"))

    first = edges.select(F.col("child").alias("session_id"), "parent").distinct()
    made = first.withColumn("x", told(F.array("parent"), F.lit(True))).select("session_id", "x.*")
    done, pending, k = None, materialize(made, "paths-0"), 0
    while not pending.isEmpty():
        k += 1
        known = pending if done is None else pending.union(done)
        up = known.select(F.col("session_id").alias("_at"), F.col("path").alias("_path"), F.col("more").alias("_more"))
        at = pending.where("more").withColumn("_at", F.element_at("path", -1)).join(up, "_at", "left")
        x = told(F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")), F.coalesce("_more", F.lit(False)))
        moved = materialize(at.withColumn("x", x).select("session_id", "x.*"), f"paths-{k}")
        ends = [pending.where("not more"), moved.where("not more").select(columns)]
        for rows in ends:
            done = rows if done is None else done.union(rows)
        pending = moved.where("more").select(columns)
    return (pending if done is None else done).select("session_id", "path")


def closure(edges: DataFrame, leaves: DataFrame, max_depth: int | None = 50, children: bool = False) -> DataFrame:
    """(leaf, session_id, depth): everything upstream of each leaf, itself at depth 0, with the least number of hops.

    Breadth first for all leaves at once. A node is expanded if it is fewer than
    ``max_depth`` hops away, so one at the bound is in the result without its parents.
    Cycles end because nothing is met twice. Each hop is one join on the frontier only,
    written to shared storage. Without a bound, where nobody has two parents, pairs come
    from ``paths`` instead. children: every child of ``edges`` is a leaf.
    """
    if max_depth is None and edges.distinct().groupBy("child").count().where("count > 1").isEmpty():
        found = paths(edges)
        if not children:
            found = found.join(leaves.select("session_id"), "session_id", "left_semi")
        up = found.select(F.col("session_id").alias("leaf"), F.posexplode("path").alias("depth", "session_id")).select("leaf", "session_id", F.col("depth") + 1)
        return leaves.select(F.col("session_id").alias("leaf"), "session_id").distinct().withColumn("depth", F.lit(0)).union(up)
    frontier = materialize(leaves.select(F.col("session_id").alias("leaf"), "session_id").distinct().withColumn("depth", F.lit(0)), "closure-0")
    seen, hop = frontier, 0
    step = edges.select(F.col("child").alias("session_id"), "parent")
    while max_depth is None or hop < max_depth:
        hop += 1
        met = frontier.join(step, "session_id").select("leaf", F.col("parent").alias("session_id")).distinct()
        frontier = materialize(met.join(seen.select("leaf", "session_id"), ["leaf", "session_id"], "left_anti").withColumn("depth", F.lit(hop)), f"closure-{hop}")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def reachable(edges: DataFrame, leaves: DataFrame, max_depth: int | None = 50) -> DataFrame:
    """(session_id, depth): everything upstream of any leaf, with the least number of hops.

    ``closure`` without telling leaves apart: a session is kept once, not once for each leaf that it feeds.
    """
    frontier = materialize(leaves.select("session_id").distinct().withColumn("depth", F.lit(0)), "reach-0")
    seen, hop = frontier, 0
    step = edges.select(F.col("child").alias("session_id"), "parent")
    while max_depth is None or hop < max_depth:
        hop += 1
        met = frontier.join(step, "session_id").select(F.col("parent").alias("session_id")).distinct()
        frontier = materialize(met.join(seen.select("session_id"), "session_id", "left_anti").withColumn("depth", F.lit(hop)), f"reach-{hop}")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def within(edges: DataFrame, members: DataFrame, max_depth: int | None = 50) -> DataFrame:
    """The ``edges`` out of members (session_id, depth) of ``reachable``; those at the bound keep none."""
    inner = members if max_depth is None else members.where(F.col("depth") < max_depth)
    return edges.join(inner.select(F.col("session_id").alias("child")), "child", "left_semi")


def inherited(edges: DataFrame, own: DataFrame, merges: dict[str, Callable], max_depth: int | None = 50) -> DataFrame:
    """(session_id, ...): what each session has of its own or from anything upstream within ``max_depth`` hops.

    own: (session_id, a column for each of ``merges``); sessions without a row have nothing.
    merges: by column, an aggregate that does not mind repetition (bit_or, min, max). A round sends what is new at its sessions to those that
    read from them, so it costs what changed, whatever the number of leaves: no pair of
    leaf and ancestor is ever made. A session's value after k rounds is that of all within
    k hops. Cycles end when nothing changes. Sessions that get nothing have no row.
    """
    put = [f(c).alias(c) for c, f in merges.items()]
    first = materialize(own.groupBy("session_id").agg(*put), "inherited-0")
    fresh, known, hop, step = first, first, 0, edges.select(F.col("parent").alias("session_id"), "child")
    while (max_depth is None or hop < max_depth) and not fresh.isEmpty():
        hop += 1
        met = fresh.join(step, "session_id").select(F.col("child").alias("session_id"), *merges, F.lit(True).alias("_met"))
        both = met.union(known.select("session_id", *merges, F.lit(False))).groupBy("session_id").agg(
            F.bool_or("_met").alias("_met"), *put, *[f(F.when(~F.col("_met"), F.col(c))).alias(f"_{c}") for c, f in merges.items()])
        changed = F.lit(False)
        for c in merges:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        fresh = materialize(both.where(F.col("_met") & changed).select("session_id", *merges), f"inherited-{hop}")
        known = known.union(fresh)
    return known.groupBy("session_id").agg(*put)


#: Hops after which ``totals`` drops what was met before.
SIFTED = (8, 16, 32)


def totals(edges: DataFrame, own: DataFrame, max_depth: int | None = 50) -> DataFrame:
    """(session_id, n, marks): how many sessions each chain has, as in ``closure``, itself included, and the bits that occur in it.

    own: (session_id, marks), one row for each session that is asked for or lies upstream
    of one; edges from or to others do not count. Sessions are numbered, so a pair is
    three numbers, and pairs bring the bits of their upper end along. Hop k joins only
    what hop k - 1 met. What was met by shorter ways is not looked up at each hop, but
    after the hops in SIFTED and each 32nd one, so cycles end; chains count it once.
    """
    known = materialize(own.select("session_id", F.monotonically_increasing_id().alias("id"), "marks"), "totals-own")
    up, down = known.select(F.col("session_id").alias("parent"), F.col("id").alias("at"), "marks"), known.select(F.col("session_id").alias("child"), F.col("id").alias("leaf"))
    links = materialize(edges.join(down, "child").join(up, "parent").select("leaf", "at", "marks").distinct(), "totals-1")
    step = links.select(F.col("leaf").alias("at"), F.col("at").alias("_at"), F.col("marks").alias("_marks"))
    seen = known.select(F.col("id").alias("leaf"), F.col("id").alias("at"), "marks")
    fresh, hop = links, 1
    if max_depth is None or max_depth > 0:
        while not fresh.isEmpty():
            seen = seen.union(fresh)
            if max_depth is not None and hop >= max_depth:
                break
            hop += 1
            met = fresh.join(step, "at").select("leaf", F.col("_at").alias("at"), F.col("_marks").alias("marks")).distinct()
            fresh = materialize(met, f"totals-{hop}")
            if (hop in SIFTED or hop % 32 == 0) and not fresh.isEmpty():
                fresh = materialize(fresh.join(seen.select("leaf", "at"), ["leaf", "at"], "left_anti"), f"totals-new-{hop}")
    once = seen.repartition("leaf").distinct().groupBy(F.col("leaf").alias("id")).agg(F.count("*").alias("n"), F.bit_or("marks").alias("marks"))
    return known.select("session_id", "id").join(once, "id").select("session_id", "n", "marks")


#: For ``inherited``: bits that add up, and the least value.
BITS = F.bit_or
LEAST = F.min


def adjacency(edges: DataFrame, members: DataFrame, max_depth: int | None = 50) -> DataFrame:
    """(session_id, parents): the members of a closure (session_id, depth) and their parents, sorted.

    A member at the depth bound keeps no parents.
    """
    least = members.groupBy("session_id").agg(F.min("depth").alias("depth"))
    inner = least if max_depth is None else least.where(F.col("depth") < max_depth)
    found = edges.join(inner.select(F.col("session_id").alias("child")), "child", "left_semi").groupBy(F.col("child").alias("session_id")).agg(
        F.array_sort(F.collect_set("parent")).alias("parents"))
    return least.select("session_id").join(found, "session_id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def chain(runs: DataFrame, leaf: str, max_steps: int = 10_000) -> list[str]:
    """A run and its single recorded parents up to the root, leaf first; it ends where a run comes again.

    One point lookup a step: this is the driver's walk of one path, not a join over all.
    """
    out, at = [], leaf
    while at is not None and at not in out and len(out) < max_steps:
        row = runs.where(F.col("session_id") == at).select("parent_session").head()
        if row is None:
            break
        out.append(at)
        at = row["parent_session"]
    return out


def chains(runs: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(leaf, session_id, depth) of the single-parent chains of the asked leaves, or of all runs.

    A row for each pair: for all runs of deep chains ``chain_roots`` tells ends and depths instead.
    """
    edges = runs.where("parent_session is not null").select(F.col("session_id").alias("child"), F.col("parent_session").alias("parent"))
    known = runs.select(F.col("session_id").alias("parent"))
    asked = runs if leaves is None else leaves.join(runs.select("session_id"), "session_id", "left_semi")
    return closure(materialize(edges.join(known, "parent", "left_semi").select("child", "parent"), "chains"), asked, None, children=leaves is None)


def chain_roots(runs: DataFrame) -> DataFrame:
    """(session_id, root, depth) of every run: where its chain of single parents ends, and after how many steps.

    Pointer doubling: in round k each pending run looks at the run 2^k steps up, and takes
    over what that one points to, so a chain of n runs takes log2(n) rounds. Runs that are
    still pending when pointers are longer than there are runs lie on or behind a cycle:
    their root and depth are null. A parent without a row of its own ends the chain below it.
    """
    r = runs.select("session_id", "parent_session").dropDuplicates(["session_id"])
    known = r.select(F.col("session_id").alias("parent_session"), F.lit(True).alias("_known"))
    start = materialize(r.join(known, "parent_session", "left").select("session_id", F.when(F.col("_known"), F.col("parent_session")).alias("up")), "roots-0")
    ends = start.where("up is null").select("session_id", F.col("session_id").alias("root"), F.lit(0).cast("long").alias("depth"))
    pending = start.where("up is not null").select("session_id", "up", F.lit(1).cast("long").alias("steps"))
    total, reach, k = start.count(), 1, 0
    while not pending.isEmpty() and reach <= total:
        k, reach = k + 1, reach * 2
        at = ends.select(F.col("session_id").alias("up"), "root", "depth", F.lit(None).cast("string").alias("_up"), F.lit(None).cast("long").alias("_steps")).unionByName(
            pending.select(F.col("session_id").alias("up"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), F.col("up").alias("_up"), F.col("steps").alias("_steps")))
        moved = materialize(pending.join(at, "up").select(
            "session_id", "root", (F.col("depth") + F.col("steps")).alias("depth"), F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps")), f"roots-{k}")
        ends = ends.union(moved.where("root is not null").select("session_id", "root", "depth"))
        pending = moved.where("root is null").select("session_id", "up", "steps")
    lost = pending.select("session_id", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"))
    return ends.union(lost)


#: Rounds of walking down from the roots before a graph is taken to have a cycle, and peeled.
WALKS = 64


def levels(edges: DataFrame, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """(session_id, level): longest distance from a node without parents, within ``nodes``.

    Round k finds the nodes at the end of a path of k edges from a root, with one join and
    one table; a node's level is its last round. If that leaves nodes unmet or does not
    end, there may be a cycle, and nodes are peeled instead. Nodes on or behind a cycle
    have no level: with ``strict`` that is a ValueError, else their level is null.
    """
    return failing_levels(edges, nodes.select("session_id", F.lit(False).alias("bad")), strict).select("session_id", "level")


def failing_levels(edges: DataFrame, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """(session_id, level, failed): ``levels``, and whether a node or anything upstream of it is ``bad``, in the same rounds.

    Each path from a root is walked to its end, so a bad node on it is met before all that
    lies below.
    """
    names = materialize(nodes.groupBy("session_id").agg(F.bool_or(F.coalesce("bad", F.lit(False))).alias("bad")), "levels-nodes")
    known = names.select("session_id")
    inner = materialize(edges.join(names.select(F.col("session_id").alias("child"), "bad"), "child").join(known.toDF("parent"), "parent", "left_semi").select(
        "child", "parent", "bad").distinct(), "levels-edges")
    roots = names.join(inner.select(F.col("child").alias("session_id")), "session_id", "left_anti")
    fresh, k = materialize(roots.select("session_id", F.lit(0).alias("level"), F.col("bad").alias("failed")), "levels-0"), 0
    met, step = fresh, inner.select(F.col("parent").alias("session_id"), "child", "bad")
    while k < WALKS and not fresh.isEmpty():
        k += 1
        below = fresh.join(step, "session_id").groupBy(F.col("child").alias("session_id")).agg(F.bool_or(F.col("failed") | F.col("bad")).alias("failed"))
        fresh = materialize(below.select("session_id", F.lit(k).alias("level"), "failed"), f"levels-{k}")
        met = met.union(fresh)
    if k < WALKS:
        found = materialize(met.groupBy("session_id").agg(F.max("level").alias("level"), F.bool_or("failed").alias("failed")), "levels")
        if found.count() == names.count():
            return found
    links = inner.select("child", "parent")
    below = downstream(links, names.where("bad")).withColumn("failed", F.lit(True))
    return _peeled(links, known, strict).join(below, "session_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


def _peeled(inner: DataFrame, names: DataFrame, strict: bool) -> DataFrame:
    """``levels`` where there may be cycles: a node gets its level when all its parents have theirs."""
    fresh = materialize(names.join(inner.select(F.col("child").alias("session_id")), "session_id", "left_anti").withColumn("level", F.lit(0)), "peeled-0")
    done, left, k = fresh, materialize(names.join(fresh, "session_id", "left_anti"), "peeled-left"), 0
    while not left.isEmpty():
        k += 1
        waiting = inner.join(left.toDF("parent"), "parent", "left_semi").select(F.col("child").alias("session_id"))
        fresh = materialize(left.join(waiting, "session_id", "left_anti").withColumn("level", F.lit(k)), f"peeled-{k}")
        if fresh.isEmpty():
            if strict:
                raise ValueError("the graph has a cycle")
            return done.union(left.withColumn("level", F.lit(None).cast("int")))
        done = done.union(fresh)
        left = materialize(left.join(fresh, "session_id", "left_anti"), "peeled-left")
    return done


def roots_first(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, level) in order: parents before children, equal levels by id, nodes on cycles last by id."""
    return levels(edges, nodes, strict=False).orderBy(F.col("level").asc_nulls_last(), "session_id")


def downstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(session_id): the seeds and all that read from them, directly or not."""
    turned = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    seeds = seeds.select("session_id").distinct()
    frontier = materialize(seeds, "downstream-0")
    seen, hop, step = frontier, 0, turned.select(F.col("child").alias("session_id"), "parent")
    while not frontier.isEmpty():
        hop += 1
        met = frontier.join(step, "session_id").select(F.col("parent").alias("session_id")).distinct()
        frontier = materialize(met.join(seen, "session_id", "left_anti"), f"downstream-{hop}")
        seen = seen.union(frontier)
    return seen


def layout(edges: DataFrame, nodes: DataFrame, x_gap: float = 3.0, y_gap: float = 1.6) -> DataFrame:
    """(session_id, level, x, y): layers by level, each centred on y = 0; nodes on cycles form the last layer."""
    placed = levels(edges, nodes, strict=False)
    top = placed.agg(F.coalesce(F.max("level"), F.lit(0)) + 1).head()[0]
    filled = placed.withColumn("level", F.coalesce("level", F.lit(top)))
    by = Window.partitionBy("level")
    spot = F.row_number().over(by.orderBy("session_id")) - 1 - (F.count("*").over(by) - 1) / 2
    return filled.select("session_id", "level", (F.col("level") * x_gap).alias("x"), (-spot * y_gap).alias("y"))
