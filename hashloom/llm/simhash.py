"""SimHash near-duplicate groups through an inverted index of fingerprint bytes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import connected_components, materialize

#: Fourteen sets of four byte positions: any two positions are missing together from three of them, any one from seven.
BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
#: Postings that two fingerprints share at least, by the greatest number of differing bits.
SHARED = {0: 14, 1: 7, 2: 3}
#: A posting list of more distinct fingerprints than this is linked by one-bit neighbours instead of pairs.
POSTING_PAIRS = 48


def simhash(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a word list; no words: 0, fewer than ``shingle``: one shingle of all."""
    if not words:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(text, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - shingle].tolist()
    n = len(starts)
    hashes = np.fromiter((digest(text[s:e], seed) for s, e in zip(starts, ends[shingle - 1:].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*carried, fp): the SimHash of each row's whole text as a signed long; null text counts as empty."""
    def run(batches):
        for batch in batches:
            fps = [simhash((t or b"").lower().split(), shingle) for t in batch.column(len(carried)).to_pylist()]
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names=[*carried, "fp"])

    kept = docs.select(*carried)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*carried, F.col("text").cast("binary")).mapInArrow(run, f"{schema}, fp bigint")


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of "at most ``distance`` (0 to 2) differing bits".

    Each differing bit spoils at most one of the eight bytes. The index posts every
    distinct fingerprint under the bytes at each of BLOCKS, positions included; two
    spoilt bytes leave three postings whole, three leave one, four one at most. In
    posting lists, shared postings are tallied for each pair, pairs below the
    guaranteed minimum go, and the others are verified bit by bit.

    A list of more than POSTING_PAIRS entries would give too many pairs. Its members are
    linked exactly another way: fingerprints at most two bits apart have a common
    neighbour at most one bit from both, and each neighbour's at most 65 owners are tied
    to the least of them. A pair that shares such a list is found there; one that does
    not has all its shared postings in short lists, so its tally is whole.
    """
    if distance not in SHARED:
        raise ValueError("distance must be 0, 1 or 2: wider ones leave too few whole bytes")
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(0xFF))
    keys = [sum((F.shiftleft(byte(i), 8 * k) for k, i in enumerate(b)), F.shiftleft(F.lit(n).cast("long"), 32)) for n, b in enumerate(BLOCKS)]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = materialize(postings.join(sizes, "key"), "postings")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= distance
    met = (
        sized.where(F.col("n") <= POSTING_PAIRS).groupBy("key").agg(F.collect_list("fp").alias("l"))
        .select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a < b")
    )
    few = met.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= SHARED[distance]).where(near(F.col("a"), F.col("b"))).select("a", "b")
    many = sized.where(F.col("n") > POSTING_PAIRS).select("fp").distinct()
    flips = [F.lit(0).cast("long")] + [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
    owners = (
        many.select("fp", F.explode(F.array(*flips)).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).agg(F.collect_list("fp").alias("l"))
        .where(F.size("l") > 1)
    )
    # With distance below two the star does not hold; the owners are then compared pair by pair.
    if distance == 2:
        star = owners.select(F.array_min("l").alias("a"), F.explode("l").alias("b")).where("a <> b")
    else:
        star = owners.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a < b")
    return few.union(star.where(near(F.col("a"), F.col("b")))).distinct()


def _components(each: DataFrame, distance: int) -> DataFrame:
    """(fp, part, component_id) of the distinct fingerprints of ``each`` (doc_id, fp): part is the same throughout a component."""
    fps = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    parts = connected_components(links(fps, distance), "near-duplicates").toDF("fp", "part")
    named = fps.join(parts, "fp", "left").select("fp", "first", F.coalesce("part", "fp").alias("part"))
    names = named.groupBy("part").agg(F.min("first").alias("component_id"))
    return materialize(named.join(names, "part").select("fp", "part", "component_id"), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text, any others).

    Texts are lower-cased in A-Z only and cut into words at ASCII white space. Rows of
    one fingerprint, and of linked fingerprints, share a component, named after its
    least doc_id. Null texts count as empty; texts without words have fingerprint zero
    and are linked like any other. Null doc_ids are kept and never name a component
    unless it has no other. Very long texts are read whole. Repeated rows give repeated
    rows; an empty table gives none.
    """
    each = materialize(fingerprints(docs, shingle), "fingerprints")
    return each.join(_components(each, distance), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, that of the least doc_id, then the least hash of its text.

    Rows without doc_id stay all, and other rows stay beside them. Of rows with the same
    doc_id and text one stays; where texts of one doc_id lie in different components, one
    of each stays. All columns are kept. An empty table stays empty.
    """
    mark = F.xxhash64("text")
    each = materialize(fingerprints(docs.where("doc_id is not null").select("doc_id", "text", mark.alias("_text")), shingle, ("doc_id", "_text")), "fingerprints")
    first = each.join(_components(each, distance), "fp").groupBy("part").agg(F.min(F.struct("doc_id", "_text")).alias("f")).select(
        F.col("f.doc_id").alias("_id"), F.col("f._text").alias("_text"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), mark.alias("_text"))
    kept = row.where("_id is not null").join(first, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"])
    return kept.unionByName(row.where("_id is null")).select("row.*")
