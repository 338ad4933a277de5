"""Chains walked from genesis against a plain walk, and days joined to versions against a plain lookup."""

import datetime
import hashlib
import random

import pytest

from clausewright.operators import asof
from clausewright.operators import governance as gv

FIELDS = {f: "x" for f in gv.FIELDS}


def link(before, seq, version="1", **fields):
    own = FIELDS | {"details": f"d{seq}"} | fields
    parts = [b"1", bytes.fromhex(before), *(own[f].encode() for f in gv.FIELDS)]
    return (seq, version, before, hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in parts)).hexdigest(), *(own[f] for f in gv.FIELDS))


def chain(name, n, seqs=None):
    before, out = hashlib.sha256(name.encode()).hexdigest(), []
    for seq in seqs or range(n):
        out.append(link(before, seq))
        before = out[-1][3]
    return out


SCHEMA = "chain string, seq long, hash_version string, prev_hash string, entry_hash string, " + ", ".join(f"{f} string" for f in gv.FIELDS)


def plain(rows, start):
    """(bad seq, reason, out of order) by walking one chain as it is told."""
    rows = sorted(rows)
    for seq, version, before, own, *fields in rows:
        if version != "1":
            return seq, "unknown version", False
        if link(before, seq, **dict(zip(gv.FIELDS, fields, strict=True)))[3] != own:
            return seq, "altered", False
    seen = {}
    for seq, _, before, *_ in rows:
        if before in seen:
            return seq, "same predecessor", False
        seen[before] = seq
    by, order, at = {r[2]: r for r in rows}, [], start
    while at in by:
        row = by.pop(at)
        order.append(row[0])
        at = row[3]
    if by:
        return min(r[0] for r in by.values()), "not linked" if order else "wrong start", False
    return None, None, order != sorted(order)


def test_chains(spark):
    rng = random.Random(4)
    chains = {"whole": chain("whole", 70), "mixed": chain("mixed", 6, [0, 3, 2, 4, 1, 9]), "one": chain("one", 1), "cut": chain("cut", 9)[:4] + chain("cut", 9)[5:], "headless": chain("headless", 9)[3:]}
    chains["altered"] = [(*r[:-1], "other") if r[0] == 4 else r for r in chain("altered", 8)]
    chains["versions"] = [(r[0], "2", *r[2:]) if r[0] == 5 else r for r in chain("versions", 8)]
    forked = chain("forked", 6)
    chains["forked"] = [*forked, link(forked[3][2], 9), link(forked[3][2], 8)]
    chains["shuffled"] = chain("shuffled", 40, rng.sample(range(1000), 40))
    rows = [(name, *r) for name, own in chains.items() for r in own]
    rng.shuffle(rows)
    genesis = spark.createDataFrame([(c, hashlib.sha256(c.encode()).hexdigest()) for c in chains], "chain string, genesis string")
    entries = spark.createDataFrame(rows, SCHEMA)
    got = {r.chain: (r.entries, r.bad_seq, r.reason, r.out_of_order) for r in gv.verified_chains(entries, genesis).collect()}
    assert got == {c: (len(own), *plain(own, hashlib.sha256(c.encode()).hexdigest())) for c, own in chains.items()}
    assert {r for _, _, r, _ in got.values()} == {None, "altered", "unknown version", "same predecessor", "not linked", "wrong start"}
    turns = {r.seq: r.turn for r in gv.walked(entries.where("chain = 'mixed'"), genesis).collect()}
    assert turns == {0: 1, 3: 2, 2: 3, 4: 4, 1: 5, 9: 6}
    assert gv.verified_chains(entries.limit(0), genesis).count() == 0


def test_a_circle_is_not_linked(spark):
    rows = [("c", s, "1", a, b, *FIELDS.values()) for s, a, b in ((1, "aa", "bb"), (2, "bb", "cc"), (3, "cc", "aa"), (4, "cc", "dd"))]
    genesis = spark.createDataFrame([("c", "00")], "chain string, genesis string")
    assert {r.turn for r in gv.walked(spark.createDataFrame(rows, SCHEMA), genesis).collect()} == {None}


def test_days(spark):
    rng, day = random.Random(2), datetime.date(2000, 1, 1)
    some = lambda: day + datetime.timedelta(days=rng.randrange(4000))
    versions = [(d, 100 * d + i, rng.randrange(4), rng.choice(["published", "published", "draft"]), some()) for d in range(12) for i in range(8)]
    versions += [(99, 1, 1, "published", None), (98, 1, 1, "published", day), (98, 2, 3, "published", day), (97, 1, 1, "draft", day)]
    asked = [some() for _ in range(9)] + [day, datetime.date(1999, 12, 31), datetime.date(2030, 5, 5)]
    frame = spark.createDataFrame(versions, "document long, version long, number int, status string, effective date")
    days = spark.createDataFrame([(d,) for d in [*asked, None]], "day date")
    want = []
    for d in asked:
        for document in {v[0] for v in versions}:
            own = [(e, n, v) for x, v, n, s, e in versions if x == document and s == "published" and e and e <= d]
            if own:
                want.append((d, document, max(own)[2]))
    found = asof.in_force_on_days(frame, days)
    assert sorted((r.day, r.document, r.version) for r in found.collect()) == sorted(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = asof.in_force_on_days(frame, days)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Cartesian" not in plan
    assert asof.in_force_on_days(frame, days.limit(0)).count() == asof.in_force_on_days(frame.limit(0), days).count() == 0


def test_new_clauses_are_placed(spark):
    old = [("p", f"law:{k}", i) for i, k in enumerate(["art-1", "art-2", "art-5", "art-10"])] + [("q", "law:b", 7), ("q", "law:a", 9), ("q", "law:c", 8)]
    new = [("p", f"law:{k}") for k in ("art-5-bis", "art-3", "art-11", "art-2", "art-0", "art-4", "art-4")] + [("q", "law:a2"), ("r", "law:x")]
    got = asof.placed(spark.createDataFrame(old, "parent string, key string, place int"), spark.createDataFrame(new, "parent string, key string")).collect()
    order = lambda p: [r.key[4:] for r in sorted((r for r in got if r.parent == p), key=lambda r: r.turn)]
    assert order("p") == ["art-0", "art-1", "art-2", "art-3", "art-4", "art-5", "art-5-bis", "art-10", "art-11"]
    # Where the old ones aren't in natural order, a new one stands before the first that comes after it.
    assert order("q") == ["a2", "b", "c", "a"] and order("r") == ["x"]
    assert {r.key for r in got if r.added} == {"law:art-5-bis", "law:art-3", "law:art-11", "law:art-0", "law:art-4", "law:a2", "law:x"}


def test_file_as_read(spark):
    from clausewright.operators import corpus as cp

    lines = spark.createDataFrame([("f", 1, "one"), ("f", 2, " "), ("f", 3, "three"), ("f", 4, "four"), ("g", 1, None), ("g", 2, "x"), ("g", 2, "x")], "file string, position int, text string")
    clauses = spark.createDataFrame([("f", "b", 2, 1, [1, 1]), ("f", "a", 1, 2, [1, 3]), ("f", "c", 1, 1, [3, 9]), ("g", "d", 1, 1, [])], "file string, key string, depth int, place int, positions array<int>")
    aside = spark.createDataFrame([("f", [4], "contents"), ("f", [4], "blank"), ("g", None, "none")], "file string, positions array<int>, reason string")
    got = sorted((r.file, r.position, r.clause, r.clauses, r.set_aside) for r in cp.file_as_read(lines, clauses, aside).collect())
    assert got == [("f", 1, "a", ["a", "b"], None), ("f", 3, "c", ["c", "a"], None), ("f", 4, None, [], "blank"), ("g", 2, None, [], None), ("g", 2, None, [], None)]
    assert cp.file_as_read(lines.limit(0), clauses, aside).count() == 0


def test_configurations(spark):
    from pyspark.sql import functions as F

    from clausewright.operators import evaluation as ev

    lists = [("keyword", False, 1, "a:1", 3.0, 1), ("keyword", False, 1, "b:2", 2.0, 2), ("keyword", True, 1, "b:2", 2.0, 1), ("meaning", False, 1, "b:2", 0.9, 1), ("meaning", False, 1, "c:3", 0.1, 2), ("meaning", True, 1, "c:3", 0.1, 1), ("questions", False, 1, "c:3", 0.8, 1), ("questions", False, 1, "d:4", 0.1, 2)]
    grid = [("keyword", []), ("keyword", ["normative"]), ("meaning", []), ("meaning", ["questions"]), ("rrf:10", []), ("keyword", ["questions"]), ("keyword", ["x"]), ("meaning", ["normative", "normative"]), ("keyword", ["rerank"])]
    found = ev.run_configurations(
        spark.createDataFrame(grid, "base string, modifiers array<string>"), spark.createDataFrame(lists, "retriever string, normative boolean, qid int, key string, score double, rank int"),
        spark.createDataFrame([(1, "b"), (2, "z")], "qid int, answer string"), F.substring_index("key", ":", -1).cast("int"),
    )
    got = {r.configuration: (r.problem, r.mrr) for r in found.collect()}
    assert got == {"keyword": (None, 0.25), "keyword+normative": (None, 0.5), "meaning": (None, 0.5), "meaning+questions": (None, 0.5), "rrf:10": (None, 0.5), "keyword+questions": ("no meaning list", None), "keyword+x": ("unknown modifier", None), "meaning+normative+normative": ("named twice", None), "keyword+rerank": (None, 0.5)}


def test_entries_asked_for(spark):
    from clausewright.operators import querylog as ql

    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(1, day(1), 7, 8, "search.ok", "50%_x"), (2, day(2), None, 7, "search", None), (3, day(3), 8, None, "searched", "ANNA"), (4, day(4), 9, 9, "search.ok", "50 x")]
    entries = spark.createDataFrame(rows, "id int, created_at timestamp, actor int, target int, action string, details string")
    people = spark.createDataFrame([(7, "Anna"), (8, "Bo"), (10, "Cy")], "person int, name string")
    ids = lambda **kw: sorted(r.id for r in ql.governance_entries(entries, people, **kw).collect())
    assert ids() == [1, 2, 3, 4] and ids(action="search") == [1, 2, 4] and ids(actor=7) == [1, 2] and ids(text="anna") == [1, 2, 3] and ids(text="0%_X") == [1]
    assert ids(since="2024-01-02", until="2024-01-04") == [2, 3] and ids(action="search", text="bo", until="2024-01-02") == [1] and ids(text="nobody") == []
    assert {(r.id, r.actor_name, r.target_name) for r in ql.governance_entries(entries, people).collect()} == {(1, "Anna", "Bo"), (2, None, "Anna"), (3, "Bo", None), (4, None, None)}
    assert ql.governance_entries(entries.limit(0), people, text="x").count() == 0


@pytest.mark.parametrize("order", ["kept", "turned", "mixed"])
def test_runs_of_a_chain_are_walked_at_once(spark, monkeypatch, order):
    made = []
    monkeypatch.setattr(gv, "cut", lambda df: made.append(1) or df.localCheckpoint())
    n = 200
    seq = {"kept": list(range(n)), "turned": list(range(n))[::-1], "mixed": [(i * 77) % n for i in range(n)]}[order]
    rows = [("a", seq[i], f"h{i - 1}" if i else "start", f"h{i}") for i in range(n)] + [("b", 1, "start", "x"), ("b", 2, "lost", "y"), ("b", 3, "y", "z")]
    entries = spark.createDataFrame(rows, "chain string, seq long, prev_hash string, entry_hash string")
    genesis = spark.createDataFrame([("a", "start"), ("b", "start")], "chain string, genesis string")
    got = {(r.chain, r.seq): r.turn for r in gv.walked(entries, genesis).collect()}
    assert got == {**{("a", seq[i]): i + 1 for i in range(n)}, ("b", 1): 1, ("b", 2): None, ("b", 3): None}
    assert len(made) == 2 or order != "kept"  # the whole log was written once more for each doubling before


def test_placing_takes_more_tasks_as_rows_grow(spark, monkeypatch):
    """A task's share is bounded whatever the session's number of partitions; old rows of one key stay, new ones come once."""
    from clausewright import session

    old = spark.range(300).selectExpr("id % 60 as parent", "concat('a:art-', cast(id div 60 * 2 as string)) as key", "cast(id div 60 as int) as place")
    twice = old.where("parent = 1 and place = 2")
    new = spark.range(120).selectExpr("id % 60 as parent", "case when id % 60 < 30 then 'a:art-3' else 'a:art-2' end as key")
    kept, few = {}, asof.placed(old.union(twice), new)
    for r in few.collect():
        kept.setdefault(r.parent, []).append((r.turn, r.key, r.added))
    assert [k for _, k, _ in sorted(kept[0])] == ["a:art-0", "a:art-2", "a:art-3", "a:art-4", "a:art-6", "a:art-8"] and len(kept[1]) == 7 and len(kept[40]) == 5
    assert [added for _, _, added in sorted(kept[0])] == [False, False, True, False, False, False] and not any(added for _, _, added in kept[40])
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    many = asof.placed(old.union(twice), new)
    assert many.rdd.getNumPartitions() >= 42 > few.rdd.getNumPartitions() and sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
