import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from clausewright.llm.mixing import OP11_SQL, copies, mix, op11_exponential_mix, running, targets
from tests.test_oracle import value


def plain_targets(sizes):
    """Shares by weight; what is over three times a source's size is shared again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), {s for s in order if sizes[s]}
    left = float(sum(sizes.values()))
    while left > 1e-9 and open_:
        whole, excess = sum(weight[s] for s in open_), 0.0
        for s in sorted(open_, key=str):
            target[s] += left * weight[s] / whole
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                excess += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.remove(s)
        left = excess
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3, None: 50}, {"a": 5}, {"b": 0, "a": 7}, {"b": 0, "a": 0}, {f"s{i}": (i * 37) % 101 + (900 if i == 7 else 0) for i in range(40)}, {"é": 4, "z": 9, "Z": 2, "": 100}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_running_totals_over_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 11).alias("v")).repartition(7)
    got = {r.id: r.s for r in running(df, [F.col("id").desc()], {"s": F.col("v")}).collect()}
    assert got == {i: sum(j * 7 % 11 for j in range(i + 1, 1000)) for i in range(1000)}


def test_query_is_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"create view documents as from '{sf}/documents.parquet'")
    df = op11_exponential_mix(spark, sf)
    want = db.sql(f"select {', '.join(df.columns)} from ({OP11_SQL})").fetchall()
    rows = df.collect()
    assert sorted(tuple(value(x) for x in r) for r in rows) == sorted(tuple(value(x) for x in r) for r in want)
    assert rows and {tuple(r) for r in op11_exponential_mix(spark, sf).collect()} == {tuple(r) for r in rows}


ROWS = [(i, "w " * (i % 7 + 1), "hot") for i in range(300)] + [(None, "a b", None), (1, None, "n"), (2, "", "n"), (3, "x y z", "n"), (3, "x y z", "n"), (4, "long " * 50_000, "big"), (5, "1!", "big")]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "c") for r in ROWS], "doc_id long, text string, source string, key int, cell string")
    rows = mix(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), len((t or "").split())) for i, t, _ in ROWS)
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and r.epochs * r["size"] <= r.taken
    assert target == pytest.approx(plain_targets(size))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
    assert mix(docs.limit(0)).count() == 0
    assert mix(docs.where("text is null or text = ''")).agg(F.sum("taken")).first()[0] == 0


def test_copies_are_what_is_taken(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    mixed = mix(docs.where("doc_id is not null")).groupBy("doc_id", "source", "size", "epochs").agg(F.max("taken").alias("taken"), F.max("extra").alias("extra"))
    times = copies(mixed).groupBy("doc_id", "source").agg(F.sum("words").alias("w"), F.max("epoch").alias("e"), F.count("*").alias("n"))
    want = {(r.doc_id, r.source): r.taken for r in mixed.collect() if r.taken}
    got = times.collect()
    assert {(r.doc_id, r.source): r.w for r in got} == want and all(r.e == r.n for r in got)


def test_weights_decide_who_is_drawn(spark):
    """Of two halves of a source that weigh 9 to 1, nearly all of a tenth comes from the heavy one; complete epochs come first."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one").alias("text"), F.when(F.col("id") < 15_000, "a").otherwise("b").alias("source"))
    # a weighs 1 of 3 and holds three quarters of all: a third of 20,000 is taken of its 15,000; b gives the rest of 20,000 from 5,000.
    rows = mix(docs, F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)).collect()
    a = [r for r in rows if r.source == "a" and r.taken]
    assert len(a) == 6667 and all(r.epochs == 0 for r in a)
    # Without replacement: of n heavy and n light, keys below x are drawn, 1 - e^-9x and 1 - e^-x of them.
    share = lambda x: (1 - math.exp(-9 * x)) / (2 - math.exp(-9 * x) - math.exp(-x))
    x = next(x / 10_000 for x in range(1, 100_000) if 7500 * (2 - math.exp(-9 * x / 10_000) - math.exp(-x / 10_000)) >= 6667)
    assert sum(r.doc_id % 2 == 0 for r in a) / len(a) == pytest.approx(share(x), abs=0.02)
    b = [r for r in rows if r.source == "b"]
    assert {r.epochs for r in b} == {2} and sum(r.taken for r in b) == 13_333
