"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Bit positions are labelled with non-zero vectors of radius + 1 bits. For each non-zero vector v of that
length one table keeps the positions whose label has an odd overlap with v. Any ``radius`` positions
leave some v that overlaps all their labels evenly, so each pair within the radius is equal in at
least one table: no pair is missed. Buckets of a table that hold many fingerprints are split into blocks of
bounded size, and each pair of blocks is one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import drop_written, written

WORDS, RADIUS, SEED = 4, 4, 42
BITS = 64
#: Members of a bucket beyond which it is split into blocks of about half as many.
CROWD = 20_000
#: One member of so many tells which buckets are crowded; crowded buckets that are few enough to broadcast (1 MB).
ONE_OF, BROADCAST_ROWS = 16, 50_000


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 values of all shingles of a whole text, repeats included; a shorter text is one shingle."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    k = min(words, len(tokens))
    begin, end = starts[: len(tokens) - k + 1].tolist(), (starts + sizes)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[b:e], SEED) for b, e in zip(begin, end, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bits set in over half of them; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a whole text; a text without words has 0."""
    return majority(shingle_hashes(text, words))


def covering_masks(radius: int) -> list[int]:
    """The tables' masks, as signed 64-bit numbers; each keeps about half of the positions."""
    size = 1 << (radius + 1)
    labels = np.random.default_rng(radius).permutation(np.arange(BITS) % (size - 1) + 1).tolist()
    masks = [sum(1 << i for i, m in enumerate(labels) if (m & v).bit_count() % 2) for v in range(1, size)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def linked(prints: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """(fingerprint, one within reach of it, reached before) in groups that links of at most ``reach`` differing bits connect.

    prints: distinct int64 values. A group grows from one member; each member is compared once with
    those not yet reached, so that a dense group costs little more than its size, and no list of
    pairs is made.
    """
    rest, out = np.sort(prints), []
    while len(rest) > 1:
        group, rest = [rest[0]], rest[1:]
        at = 0
        while at < len(group) and len(rest):
            near = np.bitwise_count(rest ^ group[at]) <= reach
            out.extend((int(x), int(group[at])) for x in rest[near])
            group.extend(rest[near])
            rest = rest[~near]
            at += 1
    return out


def crowds_split(members: DataFrame, bucket: str, member: str, crowd: int | None = None) -> DataFrame:
    """members (bucket, member) with ``block``: each two of a bucket share a block, and no block holds many over ``crowd`` (default: CROWD).

    A bucket is one block (-1) unless it is crowded; a crowded one's members are dealt by hash, and
    every pair of deals is a block. One member of ONE_OF, by hash, tells which buckets are crowded; that
    decides about blocks' sizes only. Nothing of a bucket is gathered to find out.
    """
    crowd = crowd or CROWD
    digest = F.xxhash64(F.lit(23), member)
    some = members.where(F.pmod(F.shiftright(digest, 32), F.lit(ONE_OF)) == 0).groupBy(bucket).agg((F.count("*") * ONE_OF).alias("n"))
    full = written(some.where(F.col("n") > crowd).select(bucket, F.ceil(F.col("n") / (crowd // 2)).cast("int").alias("deals")), "crowds")
    n_full = full.count()
    if not n_full:
        return members.withColumn("block", F.lit(-1))
    own = F.pmod(digest, F.col("deals")).cast("int")
    pair = lambda other: F.least(own, other) * F.col("deals") + F.greatest(own, other)
    blocks = F.when(F.col("deals").isNull(), F.array(F.lit(-1))).otherwise(F.transform(F.sequence(F.lit(0), F.col("deals") - 1), pair))
    # Dealt anew by block, so that a crowd's blocks are many tasks.
    known = F.broadcast(full) if n_full <= BROADCAST_ROWS else full
    return members.join(known, bucket, "left").select(*members.columns, F.explode(blocks).alias("block")).repartition(bucket, "block")


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for all nodes of edges (a, b).

    Each round sends every node to its least neighbour, contracts the edges and goes on with what is
    left; fingerprints are as good as random, so a constant part of the nodes goes in each round.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes, done = None, []
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        step = written(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("to")), "step")
        if nodes is None:
            nodes = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            # Roots without edges left stay as they are.
            moved = nodes.join(step, F.col("root") == F.col("a"), "left").select("node", F.coalesce("to", "root").alias("root"))
            nodes = written(moved, "nodes")
            drop_written(*done)
            done = [nodes]
        to_a, to_b = step.select("a", F.col("to").alias("ra")), step.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        done += [step, edges]
        turned = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        edges = written(turned.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return nodes


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and print (signed 64-bit number) of every row of docs (doc_id, text)."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            prints = np.array([fingerprint(t, words) for t in rows["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "print": prints}).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(mark, "doc_id long, print long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: pairs of the distinct fingerprints of prints (print) that differ in at most radius bits and connect all such pairs."""

    def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [pair for met in rows["met"] for pair in linked(np.asarray(met, np.int64), radius)]
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    seen = [F.xxhash64(F.lit(t), F.col("print").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(radius))]
    keyed = prints.select("print", F.explode(F.array(*seen)).alias("bucket"))
    buckets = crowds_split(keyed, "bucket", "print").groupBy("bucket", "block").agg(F.collect_list("print").alias("met"))
    return buckets.where(F.size("met") > 1).select("met").mapInPandas(connect, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, print and component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach; links join fingerprints of at most radius
    differing bits, equal ones among them. Rows with a null id take part; a component of such rows
    alone has none. Null texts and texts without words have fingerprint 0 and are linked like others.
    Copies and repeated rows meet in one fingerprint before anything is compared, so that no group of
    copies is ever spread out in pairs. An empty table gives an empty result; other columns aren't read.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    distinct = written(marked.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    groups = components(links(distinct.select("print"), radius)).withColumnRenamed("node", "print")
    ids = groups.join(distinct, "print").select("print", "root", "first_id")
    least = ids.groupBy("root").agg(F.min("first_id").alias("least_id"))
    by_print = (
        distinct.join(ids.select("print", "root"), "print", "left")
        .join(least, "root", "left")
        .select("print", F.coalesce("least_id", "first_id").alias("component_id"))
    )
    return marked.join(by_print, "print").select("doc_id", "print", "component_id")


def op5_covering_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
