import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clausewright.llm import simhash
from clausewright.llm.simhash import components, covering_masks, fingerprint, linked, near_duplicates, op5_covering_simhash


def plain_fingerprint(text, k=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    ids = sorted(prints, key=lambda i: (i is None, i))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 4, 6])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = np.array(covering_masks(radius))
    rng = np.random.default_rng(1)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        flips = np.int64(0)
        for i in rng.choice(64, rng.integers(0, radius + 1), replace=False):
            flips |= np.int64(np.uint64(1) << np.uint64(i))
        assert (masks & flips == 0).any()


def test_fingerprint_is_the_plain_one():
    for t in [None, "", " \n", "One", "A b c", "a b c d", "É È\x0b\x0cx\x1cy z", "to be or not to be " * 40, "Ünï " * 5 + "\x85 \xa0 q"]:
        assert fingerprint(t) == plain_fingerprint(t), t


def test_spark_hashes_alike(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a bé c d")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("a bé c d".encode(), 42)


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_covering_simhash(spark, sf).collect()}
    roots = plain_components(prints, 4)
    assert got == {i: (format(p, "016x"), roots[i]) for i, p in prints.items()}


def test_linked_and_components_are_brute_force(spark):
    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 1 << 13, 400).astype(np.int64) << 7)
    for radius in (1, 2):
        want = plain_components({int(p): int(p) for p in prints}, radius)
        found = linked(prints, radius)
        assert all((a ^ b).bit_count() <= radius for a, b in found)
        frame = spark.createDataFrame(found, "a long, b long")
        got = {r.node: r.root for r in components(frame).collect()}
        assert {n: r for n, r in want.items() if n in got} == got
        assert set(want) - set(got) == {n for n in want if list(want.values()).count(want[n]) == 1}
    path = [(int(a), int(b)) for a, b in zip(rng.permutation(300)[:-1], rng.permutation(300)[1:], strict=True)]
    want = {n: n for e in path for n in e}
    for _ in range(300):
        for a, b in path:
            want[a] = want[b] = min(want[a], want[b])
    assert {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()} == {n: r for n, r in want.items() if any(a != b and n in (a, b) for a, b in path)}


@pytest.mark.parametrize("crowd", [16, 50])
def test_split_buckets_lose_no_link(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 50_000 if crowd == 16 else 0)
    rng = np.random.default_rng(8)
    near = np.unique(rng.integers(0, 1 << 12, 300).astype(np.int64) << 30)
    frame = spark.createDataFrame([(int(p),) for p in near], "print long")
    want = plain_components({int(p): int(p) for p in near}, 4)
    got = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    assert all(got.get(p, p) == r for p, r in want.items())
    split = simhash.crowds_split(frame.withColumn("bucket", F.lit(1)), "bucket", "print", crowd).groupBy("bucket", "block").count()
    assert split.agg(F.max("count")).first()[0] <= 4 * crowd


def test_edge_rows(spark):
    long = "all these words make one long text " * 3000
    rows = [(5, None), (3, ""), (None, " "), (9, long), (9, long), (8, long), (7, "Some other text of a few words"), (None, "nothing like it")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, prints int")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 8), (9, 8), (8, 8), (7, 7), (None, None)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
