import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright.llm import fill_in_middle as fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


@given(st.lists(st.integers(0, 5000), unique=True).map(sorted), st.integers(0, 100_000))
def test_elias_fano_selects_every_value(values, more):
    packed = fim.elias_fano(np.array(values, np.int64), (values[-1] if values else 0) + more)
    assert [fim.selected(packed, i) for i in range(len(values))] == values


@given(st.text(st.sampled_from("ab é\n\t\x0b\x00\x85 漢😀<P>"), max_size=40))
def test_units_end_where_the_pattern_says(text):
    assert fim.unit_ends(text).tolist() == [m.end() for m in UNIT.finditer(text)]


def plain(doc_id, text):
    text = text or ""
    units = [m.group() for m in UNIT.finditer(text)]
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ROWS = [
    *[(i, "the same text\nof many  ") for i in range(60)], *[(i, f"text é {i} 漢字 😀 end" * (i % 5)) for i in range(60, 120)], (None, "no id, some words"), (120, None), (121, ""), (122, " "), (122, " "),
    (123, "has <M> inside"), *[(i, "a<P\t>b < P> <S") for i in range(124, 150)], (150, "long word " * 200_000), (151, "x" * 300_000), (60, "twice"), (60, "twice"),
]


def test_edge_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, "u") for r in ROWS], "doc_id long, text string, n int, units string")
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter(plain(*r) for r in ROWS)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made) == want
    assert {r.form for r in made} == {"plain", "psm", "spm"} and all(r.back == r.text for r in made)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    # Texts of many documents are dealt in parts, and are still listed once a part.
    monkeypatch.setattr(fim, "GROUP_DOCS", 10)
    index = fim.text_index(docs).select("text", F.size("ids").alias("n")).collect()
    hot = [r.n for r in index if r.text == ROWS[0][1]]
    assert sum(hot) == 60 and len(hot) > 1 and len({r.text for r in index}) == len({t or "" for _, t in ROWS})
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.fill_in_middle(docs).collect()) == want


def test_query_is_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"create view documents as from '{sf}/documents.parquet'")
    df = fim.op12_boundary_index(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert Counter(rows) == Counter(db.sql(f"select {', '.join(df.columns)} from ({fim.OP12_SQL})").fetchall())
    texts = dict(db.sql("select doc_id, text from documents").fetchall())
    assert all(r[6] == hashlib.sha256((texts[r[0]] or "").encode()).hexdigest() for r in rows)
