import hashlib
import re
from collections import Counter

import duckdb

from clausewright.llm.decontamination import OP2_SQL, Windows, contamination, index, near_matches, op2_positional_index, phrase_matches, ranked_terms


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - size + 1)) if w else []:
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in ids if x is not None))))
    return Counter(out)


def as_counter(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect())


def test_query_is_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in plain(docs, items)}
    assert {tuple(r) for r in op2_positional_index(spark, sf).collect()} == want and any(w[2] for w in want)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    assert set(db.sql(OP2_SQL).fetchall()) == want


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs far away"), (2, "to be"), (3, "ÉCOLE a1"), (4, None), (5, "..."), (6, "x"), (None, "no id here"), (7, "to be")]
DOCS = [
    (1, "THE quick, brown fox jumps over the lazy dog and runs far away! the end"), (2, "quick brown fox jumps over the lazy dog and"), (3, "To be or not TO BE to be"),
    (4, "ÉCOLE A1 école a1"), (5, None), (6, ""), (7, "X x y"), (None, "no id here too"), (8, "to be"), (8, "to be"), (9, "a the of " * 20_000 + "x"),
]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, term_id int")
    items = spark.createDataFrame([(*i, "en") for i in ITEMS], "item_id long, text string, window string")
    assert as_counter(contamination(docs, items)) == plain(DOCS, ITEMS)
    assert as_counter(contamination(docs, items, 3)) == plain(DOCS, ITEMS, 3)
    assert as_counter(contamination(docs, items.limit(0))) == plain(DOCS, [])
    assert contamination(docs.limit(0), items).count() == 0


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta")], "doc_id long, text string")
    windows = Windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    postings = index(docs, windows.vocabulary)
    ranked = ranked_terms(postings, windows)
    ids = lambda df: sorted({r.doc_id for r in df.collect()})
    assert ids(phrase_matches(postings, ranked)) == ids(near_matches(postings, ranked, 0)) == [1]
    assert ids(near_matches(postings, ranked, 1)) == [1, 2]
    assert ids(near_matches(postings, ranked, 4)) == [1, 2, 3]
