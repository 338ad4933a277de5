import math
import random
import re
from collections import Counter

import duckdb
import pytest

from clausewright.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            scored += [(-s, i is None, i)] * (s > 0)
        out.update((item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1))
    return out


def rows(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_query_is_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows(rs.op13_threshold_search(spark, sf))
    assert got == plain(docs, items, 20) and got
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    assert Counter(db.sql(f"select item_id, rank, doc_id, score from ({rs.OP13_SQL})").fetchall()) == got


DOCS = [(1, "The cat, the CAT"), (2, "École a1 école"), (3, None), (4, ""), (5, "..."), (None, "cat no id"), (6, "cat no id"), (6, "cat no id"), (7, "dog " * 100_000 + "cat"), *[(i, "copy of a cat") for i in range(100, 130)]]
ITEMS = [(1, "Cat cat the"), (2, None), (3, "!"), (4, "unheard"), (None, "école"), (5, "dog id"), (5, "dog id"), (6, "copy")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_edge_rows(spark, k):
    docs = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, slice int, term string")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, query int")
    assert rows(rs.search(docs, items, k)) == plain(DOCS, ITEMS, k)
    if k == 3:
        assert rows(rs.search(docs, items, k, block_terms=2)) == plain(DOCS, ITEMS, k)
        assert rs.search(docs, items.limit(0), k).count() == rs.search(docs.limit(0), items, k).count() == 0


def test_thresholds_leave_lists_unread_and_results_whole(spark, monkeypatch):
    """Many small slices, skewed words: the same rows as scoring everything, from fewer entries than the lists hold."""
    monkeypatch.setattr(rs, "SLICE_DOCS", 50)
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randrange(5, 60)))) for i in range(1500)]
    items = [(i, " ".join(draw.choices(vocabulary, k=6))) for i in range(12)] + [(99, docs[3][1])]
    seen = []
    original = rs._over
    monkeypatch.setattr(rs, "_over", lambda least: (seen.append(least), original(least))[1])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(rs.search(frame, spark.createDataFrame(items, "item_id long, text string"), 5)) == plain(docs, items, 5)
    assert seen and any(x > 300_000 for x in seen[0].values())
