import itertools

import numpy as np
import pytest

import corpus_pipeline
from clausewright.llm import shingles
from clausewright.llm.shingles import linked, near_duplicates


def plain_shingles(text, k=5):
    words = (text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_groups(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(i) for i in range(len(sets))]


def edited(rng, words, edits):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"e{rng.integers(10**9)}"
    return out


def texts(rng):
    vocabulary = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(vocabulary, 30))
    out = [None, "", " ", "one", "ONE", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(120):  # pairs, most of them near 0.8
        words = rng.choice(vocabulary, int(rng.integers(8, 400))).tolist()
        out += [" ".join(words), " ".join(edited(rng, words, int(rng.integers(0, 1 + len(words) // 30)) + 1)) + " " + line * int(rng.integers(0, 2))]
    base = rng.choice(vocabulary, 150).tolist()
    return out + [" ".join(edited(rng, base, int(rng.integers(1, 6)))) for _ in range(60)]


@pytest.mark.parametrize(("block", "crowd", "paired"), [(1 << 18, 8192, 64), (1000, 16, 4)])
def test_stage_is_brute_force_jaccard(spark, block, crowd, paired, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "CROWD", crowd)
    monkeypatch.setattr(shingles, "PAIRED", paired)
    monkeypatch.setattr(shingles, "AROUND", crowd)
    monkeypatch.setattr(shingles, "BROADCAST_ROWS", crowd - 16)
    monkeypatch.setattr(shingles, "ONE_OF", 2)
    found = texts(np.random.default_rng(5))
    sets = [plain_shingles((t or "").lower()) for t in found]
    want = plain_groups(sets)
    alike = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2) if a & b]
    assert sum(0.8 <= s < 0.85 for s in alike) > 10 and sum(0.7 <= s < 0.8 for s in alike) > 10
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert kept.columns == docs.columns


def test_linked_and_prefixes_miss_no_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**62), 2**62, 200)
    sets = [np.unique(np.r_[rng.choice(base, int(rng.integers(150, 200)), replace=False), rng.integers(0, 2**62, int(rng.integers(0, 30)))]) for _ in range(90)]
    sets.append(np.empty(0, np.int64))
    want = plain_groups([set(s.tolist()) for s in sets])
    got = dict(linked(np.arange(len(sets)), sets))
    assert [got.get(i, i) for i in range(len(sets))] == want and len(set(want)) > 2
    listed = np.sort(rng.choice(base, 50, replace=False))
    first = [set(shingles.prefix(s, listed, np.arange(50) + 1).tolist()) for s in sets]
    for i, j in itertools.combinations(range(len(sets)), 2):
        shared = np.intersect1d(sets[i], sets[j]).size
        if shared and shingles.similar(shared, len(sets[i]), len(sets[j])):
            assert first[i] & first[j]


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (None, "x y"), (9, "a b c d e f"), (9, "a b c d e f"), (None, "nothing like it")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, own int")
    kept = shingles.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, ""), (None, "x y"), (9, "a b c d e f"), (None, "nothing like it")], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0 == shingles.one_of_each(docs.limit(0)).count()


def test_groups_keep_unknown_pairs_together(monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(shingles, "BLOCK", 500)
    nodes, sizes, known = np.arange(300), rng.integers(80, 120, 300), np.where(rng.random(300) < 0.8, 7, rng.integers(100, 105, 300))
    together = set()
    for g in shingles.groups(nodes, sizes, np.zeros(300, np.int64), known):
        together |= set(itertools.combinations(sorted(g.tolist()), 2))
    for i, j in itertools.combinations(range(300), 2):
        if known[i] != known[j] and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j]):
            assert (i, j) in together
    assert shingles.groups(nodes, sizes, np.zeros(300, np.int64), np.zeros(300, np.int64)) == []
