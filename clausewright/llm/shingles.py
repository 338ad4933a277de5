"""Near duplicates by shingle sets: covering SimHash first, an exact join for what lies beyond its radius.

Operator 5 (``simhash``) gives candidates: fingerprints within its radius. Their whole shingle sets are
compared, and what is similar is linked. Pairs of similarity 0.8 often differ in more bits than any number
of tables could cover (about 10 of 64), so a prefix-filtered self-join adds the rest: all sets are sorted
by one order of the shingles; two sets of similarity s share at least s times the larger one's shingles, so
that a shingle is common to their first n - ceil(s n) + 1 ones. Sets that meet in no prefix needn't be
compared, and no pair is missed, whatever the order. Frequent shingles come last, which keeps common lines
and passages out of the prefixes, and sets that SimHash has linked already aren't compared again, which
spares the large groups of near copies. What meets is first held to two bounds that no similar pair exceeds
(places in the prefixes, shingles counted by class), and what is left is compared by whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.llm.shared import drop_written, tidy, written
from clausewright.llm.simhash import SEED, components, crowds_split, links, majority, shingle_hashes

#: Shingles' words; the least similarity as a fraction of whole numbers.
WORDS, LEAST = 5, (4, 5)
#: One text of so many, by its digest, tells which shingles are frequent, from so often on, and at most so many.
#: This decides about the order of shingles only, not about what is found.
ONE_OF, OFTEN, LISTED = 16, 3, 1 << 18
#: Sets of larger buckets are compared as groups, pairs of the others one by one; shingles of a group's block.
PAIRED, BLOCK = 64, 1 << 18
#: Members of a bucket beyond which it is split; sets that one fingerprint's neighbours are compared with at once.
CROWD, AROUND = 8_192, 256
#: Texts that a Python worker holds the shingles of at once.
ROWS = 512
#: Texts to fetch that are few enough to broadcast their digests (8 bytes each); more are merged.
BROADCAST_ROWS = 1_000_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a whole text as sorted XXH64 values (signed); a shorter text is one shingle."""
    return np.unique(shingle_hashes(text, words).view(np.int64))


def node_of(own: np.ndarray) -> int:
    """A digest of a set that stands for it."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def packed(own: np.ndarray) -> bytes:
    """The upper 40 bits of each shingle of a set, in order: enough to compare two sets, in 5 bytes instead of 8."""
    return np.ascontiguousarray(own.view(np.uint64) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """What ``packed`` kept, as numbers."""
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.int64).reshape(-1)


def prefix(own: np.ndarray, listed: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The part of a set that meets that of each similar set. listed: sorted shingles, ranked behind all others."""
    part, whole = LEAST
    count = len(own) - -(-part * len(own) // whole) + 1 if len(own) else 0
    rank = np.zeros(len(own), np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
        rank = np.where(listed[at] == own, ranks[at], 0)
    return own[np.lexsort((own, rank))[:count]]


def similar(shared, a, b):
    """Whether sets of a and b shingles, of which they share some, have the least similarity."""
    part, whole = LEAST
    return (part + whole) * shared >= part * (a + b)


def classes(own: np.ndarray) -> bytes:
    """Counts of a set's shingles by their low bits, about two to four a class; more than 255 count as 255."""
    n = 1 << max(4, (len(own) // 2).bit_length() - 1)
    return np.minimum(np.bincount(own & (n - 1), minlength=n), 255).astype(np.uint8).tobytes()


def possible(a: bytes, b: bytes, sizes: int) -> bool:
    """Whether sets of these classes, of so many shingles in sum, can be similar: their counts differ by no more than similar sets do."""
    part, whole = LEAST
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b))
    n = min(len(x), len(y))
    if 255 in (x.max(), y.max()):
        return True
    return (part + whole) * int(np.abs(x.reshape(-1, n).sum(axis=0) - y.reshape(-1, n).sum(axis=0)).sum()) <= (whole - part) * sizes


def groups(nodes: np.ndarray, sizes: np.ndarray, places: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    """Groups of a bucket's nodes in which each two that can be similar by sizes and places are together.

    places: of the bucket's shingle in each set's order. Where similar sets meet first, no more is shared than
    what follows in either. known: nodes of equal numbers are linked already and needn't be together.
    """
    part, whole = LEAST
    order = np.lexsort((nodes, sizes))
    nodes, sizes, rest, known = nodes[order], sizes[order], (sizes - places)[order], known[order]
    if len(nodes) <= PAIRED:
        a, b = np.triu_indices(len(nodes), 1)
        fits = (known[a] != known[b]) & (whole * sizes[a] >= part * sizes[b]) & similar(np.minimum(rest[a], rest[b]), sizes[a], sizes[b])
        return list(np.sort(np.c_[nodes[a], nodes[b]][fits], axis=1))
    values, counts = np.unique(known, return_counts=True)
    if len(values) == 1:
        return []
    largest = known == values[np.argmax(counts)]
    blocks = []  # (nodes, least size, most, whether all are of the largest group)
    for own in (largest, ~largest):
        at = np.flatnonzero(own)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[at]) // BLOCK)) + 1
        blocks += [(nodes[i], sizes[i[0]], sizes[i[-1]], own is largest) for i in np.split(at, cuts) if len(i)]
    out = []
    for i, (x, low_x, high_x, of_largest) in enumerate(blocks):
        near = [y for y, low_y, high_y, also in blocks[i + 1 :] if not (of_largest and also) and whole * high_x >= part * low_y and whole * high_y >= part * low_x]
        out += [np.r_[x, y] for y in near] or ([] if of_largest else [x])
    return [np.sort(g) for g in out]


def linked(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(node, its group's first) for distinct nodes in groups that pairs of similar sets connect.

    Each member of a group is compared once with all that are not yet reached.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    rest = np.flatnonzero(sizes)
    if len(rest) == 2:
        i, j = rest
        both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
        return [(int(nodes[j]), int(nodes[i]))] if similar(both, sizes[i], sizes[j]) else []
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.cumsum(sizes) - sizes
    mark, out = np.zeros(int(codes.max(initial=-1)) + 1, bool), []
    flat, starts = codes, begin[rest]
    while len(rest) > 1:
        group, rest = [rest[0]], rest[1:]
        flat, starts = flat[sizes[group[0]] :], starts[1:] - sizes[group[0]]
        starts = starts - starts[0]
        at = 0
        while at < len(group) and len(rest):
            own = codes[begin[group[at]] : begin[group[at]] + sizes[group[at]]]
            mark[own] = True
            near = similar(np.add.reduceat(mark[flat], starts, dtype=np.int64), sizes[rest], sizes[group[at]])
            mark[own] = False
            if near.any():
                group.extend(rest[near].tolist())
                flat = flat[np.repeat(~near, sizes[rest])]
                rest = rest[~near]
                starts = np.cumsum(sizes[rest]) - sizes[rest]
            at += 1
        out.extend((int(nodes[i]), int(nodes[group[0]])) for i in group[1:])
    return out


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks) of the frequent shingles of docs (text), the shingles sorted."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"shingle": np.concatenate([shingles(t) for t in rows["text"]] or [np.empty(0, np.int64)])})

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ONE_OF)) == 0)
    counts = some.mapInPandas(tidy(split), "shingle long").groupBy("shingle").count().where(F.col("count") >= OFTEN)
    found = counts.orderBy(F.desc("count"), "shingle").limit(LISTED).toPandas().sort_values("shingle")
    return found["shingle"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def sets_of(docs: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """node, own (``packed``): the shingle sets of the nodes in members, made from their texts again.

    Few nodes of a corpus have candidates; sets of all of them would weigh more than the texts.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (b.iloc[lo : lo + ROWS] for b in batches for lo in range(0, len(b), ROWS)):
            own = [shingles(t) for t in rows["text"]]
            yield pd.DataFrame({"node": [node_of(s) for s in own], "own": [packed(s) for s in own]}).astype({"node": "int64"})

    wanted = written(sets.select("node", "text_hash").join(members.select("node").distinct(), "node", "left_semi").select("text_hash").distinct(), "shingle-texts")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash", "left_semi").select("text").distinct()
    return texts.mapInPandas(tidy(make), "node long, own binary").dropDuplicates(["node"])


def confirmed(docs: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """a, b: links that connect all similar sets among the nodes of each group of members (met, node).

    sets: node, text_hash, counts, size, one row a node. Pairs that ``possible`` rules out never have
    their sets fetched.
    """

    def sieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            left = [(m, n) for m, n, c, s in zip(rows["met"], rows["nodes"], rows["counts"], rows["sizes"], strict=True) if len(n) != 2 or possible(*c, sum(s))]
            ids = np.repeat(np.array([m for m, _ in left], np.int64), [len(n) for _, n in left])
            yield pd.DataFrame({"met": ids, "node": np.concatenate([n for _, n in left]) if left else np.empty(0, np.int64)})

    def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for nodes, own in zip(rows["nodes"], rows["own"], strict=True):
                found += linked(np.asarray(nodes, np.int64), [unpacked(x) for x in own])
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    sketched = members.join(sets.select("node", "counts", "size"), "node").groupBy("met").agg(F.collect_list(F.struct("node", "counts", "size")).alias("x"))
    sketched = sketched.select("met", F.col("x.node").alias("nodes"), F.col("x.counts").alias("counts"), F.col("x.size").alias("sizes"))
    left = written(sketched.mapInPandas(tidy(sieve), "met long, node long"), "shingle-groups")
    joined = left.join(sets_of(docs, sets, left), "node").groupBy("met").agg(F.collect_list(F.struct("node", "own")).alias("x"))
    found = written(joined.select(F.col("x.node").alias("nodes"), F.col("x.own").alias("own")).mapInPandas(tidy(connect), "a long, b long"), "shingle-links")
    drop_written(left)
    return found


def near_by_fingerprint(sets: DataFrame) -> DataFrame:
    """met, node: groups of a node and others whose SimHash fingerprints are equal or within the radius (candidates).

    sets: node, print. A group holds about AROUND nodes, however many lie around one.
    """
    first = written(sets.groupBy("print").agg(F.min("node").alias("b")), "fingerprint-nodes")
    pairs = sets.join(first, "print").where("node <> b").select(F.col("node").alias("a"), "b")
    ends = links(first.select("print")).select(F.col("a").alias("print"), F.col("b").alias("other"))
    ends = ends.join(first.select("print", F.col("b").alias("a")), "print").select("a", F.col("other").alias("print")).join(first, "print").select("a", "b")
    pairs = written(pairs.union(ends), "fingerprint-pairs")
    deals = pairs.groupBy("b").agg(F.ceil(F.count("*") / AROUND).alias("deals"))
    met = F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("deals")))
    dealt = pairs.join(deals, "b").select(met.alias("met"), "a", "b")
    out = written(dealt.select("met", F.explode(F.array("a", "b")).alias("node")).distinct(), "fingerprint-groups")
    drop_written(pairs, first)
    return out


def near_by_prefix(sets: DataFrame) -> DataFrame:
    """met, node: groups in which each two similar sets that aren't known to be linked are together.

    sets: node, size, first, known.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = {}
            for bucket in zip(rows["nodes"], rows["sizes"], rows["places"], rows["known"], strict=True):
                for g in groups(*(np.asarray(x, np.int64) for x in bucket)):
                    found[xxhash.xxh64_intdigest(g.tobytes()) - (1 << 63)] = g
            ids = np.repeat(np.fromiter(found, np.int64, len(found)), [len(g) for g in found.values()])
            yield pd.DataFrame({"met": ids, "node": np.concatenate(list(found.values())) if found else np.empty(0, np.int64)})

    keyed = sets.select("node", "size", "known", F.posexplode("first").alias("place", "shingle"))
    member = F.struct("node", "size", "place", "known")
    buckets = crowds_split(keyed, "shingle", "node", CROWD).groupBy("shingle", "block").agg(F.collect_list(member).alias("met"))
    buckets = buckets.where((F.size("met") > 1) & (F.size(F.array_distinct("met.known")) > 1))
    buckets = buckets.select(F.col("met.node").alias("nodes"), F.col("met.size").alias("sizes"), F.col("met.place").alias("places"), F.col("met.known").alias("known"))
    return written(buckets.mapInPandas(tidy(meet), "met long, node long").distinct(), "shingle-meetings")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (digest of the shingle set) and root of every row of docs (doc_id, text).

    Rows have the same root if pairs of similarity LEAST or more connect them. Equal sets are one
    node before anything is compared, texts without words (null ones too) among them.
    """
    listed, ranks = frequent(docs)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (b.iloc[lo : lo + ROWS] for b in batches for lo in range(0, len(b), ROWS)):
            hashes = [shingle_hashes(t, WORDS) for t in rows["text"]]
            own = [np.unique(h.view(np.int64)) for h in hashes]
            found = {"node": [node_of(s) for s in own], "first": [prefix(s, listed, ranks) for s in own]}
            found["counts"], found["size"] = [classes(s) for s in own], [len(s) for s in own]
            found["print"] = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            found = {"doc_id": rows["doc_id"], "text_hash": rows["text_hash"]} | found
            yield pd.DataFrame(found).astype({"doc_id": "Int64", "text_hash": "int64", "node": "int64", "size": "int32"})

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, node long, first array<long>, counts binary, size int, print long"
    rows = written(texts.mapInPandas(tidy(mark), schema), "shingles")
    # A node has several fingerprints only by repeats inside texts of one shingle set; any of them may name its candidates.
    sets = written(rows.drop("doc_id").dropDuplicates(["node"]), "shingle-sets")
    close = near_by_fingerprint(sets.select("node", "print"))
    first_links = confirmed(docs, sets, close)
    known = components(first_links).select("node", F.col("root").alias("known"))
    with_known = sets.join(known, "node", "left").withColumn("known", F.coalesce("known", "node"))
    far = near_by_prefix(with_known)
    more = confirmed(docs, sets, far)
    roots = components(first_links.union(more))
    drop_written(sets, close, far, first_links, more)
    return rows.select("doc_id", "text_hash", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of docs without those that have a near duplicate kept in their place; all columns as they are.

    Of each component the row of least doc_id stays (of equal ids, the one of least text hash; null
    ids come last), and of repeated rows one. An empty table gives an empty result; besides doc_id and
    text, columns may have any names.
    """
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    kept = near_duplicates(docs).groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"))
    packed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row"))
    own = packed.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
    copy = F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy("text_hash"))
    return own.withColumn("copy", copy).where("copy = 1").select("row.*")
