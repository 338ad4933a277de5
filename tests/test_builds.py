"""Embedded strings, builds, judged runs, trigger scores, pages and listed versions against plain loops and on edge rows."""

import datetime
import random
import re

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from clausewright.operators import asof
from clausewright.operators import embedding as em
from clausewright.operators import evaluation as ev
from clausewright.operators import governance as gv
from clausewright.plans.build_queries import ancestor_headings, embedded_strings
from clausewright.plans.clause_view_queries import corpus

RUN = "pack string, set string, id string, topic string, score double, hit boolean"


def placed(name, headings, text, most):
    parts = [p.strip() for p in [name, *(headings or [])] if p and p.strip()]
    while len(parts) > 1 and len(re.findall(r"\w+|[^\w\s]", " > ".join(parts))) > most:
        if len(parts) == 2:
            parts = parts[1:]
        else:
            del parts[len(parts) // 2]
    return " > ".join([*parts, text])


def test_contexts_are_those_of_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", " Act ", "General Data Act"]), rng.choice([None, [], [rng.choice([None, " ", "One", "Two words", "Règle (3)"]) for _ in range(rng.randint(1, 9))]]), f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "id int, name string, headings array<string>, text string")
    for most in (1, 4, 9, 64):
        got = {r.id: r.c for r in docs.select("id", em.context(F.col("name"), F.col("headings"), F.col("text"), most=most).alias("c")).collect()}
        assert got == {i: placed(n, h, t, most) for i, n, h, t in rows}


def test_headings_take_the_wording_of_the_day(spark):
    nodes = spark.createDataFrame([(1, None, "I"), (2, 1, "II"), (3, 2, "III"), (4, 9, None)], "id long, parent long, label string")
    day = datetime.date(2024, 5, 1)
    texts = [(10, 1, "en", "Old", None, None), (11, 1, "en", "New", None, day), (20, 2, "en", None, None, None), (21, 2, "fr", None, "art. 2", None), (30, 3, "en", "x", None, day), (31, 3, "en", "x", None, None), (32, 3, "fr", "x", None, None), (40, 4, "en", "x", None, None)]
    texts = spark.createDataFrame(texts, "text_id long, node long, lang string, heading string, label string, applies_from date")
    got = {r.text_id: r.headings for r in em.ancestor_headings(texts, nodes).collect()}
    assert got == {20: ["Old"], 21: ["I"], 30: ["New", "II"], 31: ["Old", "II"], 32: ["I", "art. 2"]}
    assert em.ancestor_headings(texts.limit(0), nodes).count() == 0


def test_builds_leave_alone_what_is_there(spark):
    texts = spark.createDataFrame([(1, "one"), (2, None), (3, "  "), (4, "four"), (5, "five")], "text_id long, text string")
    store = spark.createDataFrame([(1, "a", "r1", [0.0]), (4, "a", "r0", [0.0]), (4, "b", "r1", [0.0]), (9, "a", "r1", [0.0])], "text_id long, model string, recipe string, vector array<double>")
    encode = lambda rows: rows.select("text_id", F.array(F.length("text").cast("double")).alias("vector"))
    vectors, counts = em.build_index(texts, store, "a", "r1", encode)
    assert sorted(tuple(r) for r in vectors.collect()) == [(1, "a", "r1", [0.0]), (4, "a", "r1", [4.0]), (4, "b", "r1", [0.0]), (5, "a", "r1", [4.0]), (9, "a", "r1", [0.0])]
    assert tuple(counts.collect()[0]) == (2, 2, 2)
    again = em.build_index(texts, vectors, "a", "r1", encode)
    assert tuple(again[1].collect()[0]) == (0, 2, 4) and again[0].count() == 5
    assert tuple(em.build_index(texts, store, "a", "r1", encode, skip_embedded=False)[1].collect()[0]) == (3, 2, 0)
    assert tuple(em.build_index(texts.limit(0), store.limit(0), "a", "r1", encode)[1].collect()[0]) == (0, 0, 0)


def run(spark, scores):
    return spark.createDataFrame([("p", s, str(i), t, x, x > 0) for s, i, t, x in scores], RUN)


def test_judgements(spark):
    was = [("s", i, f"t{i % 9}", 0.0) for i in range(18)] + [("u", i, f"t{i % 9}", 1.0) for i in range(9)]
    better = [(s, i, t, 1.0) for s, i, t, _ in was]
    told = ev.judgement(run(spark, was), run(spark, better), 2000).collect()[0]
    assert (told.questions, told.topics, told.topics_found, told.topics_lost, told.worse_sets, told.kept) == (27, 9, 9, 0, 0, True) and told.chance < 0.02
    lost = [(s, i, t, 1.0 - x) for s, i, t, x in was]
    told = ev.judgement(run(spark, was), run(spark, lost), 2000).collect()[0]
    assert told.worse_sets == 1 and told.kept is False and told.topics_found == 9
    sets = {r.set: r for r in ev.set_changes(run(spark, was), run(spark, lost), 2000).collect()}
    assert sets["u"].worse and not sets["s"].worse and sets["s"].chance_of_loss == 1.0 and (sets["u"].hits_before, sets["u"].hits_after) == (9, 0)
    same = ev.judgement(run(spark, was), run(spark, was), 200).collect()[0]
    assert same.chance == 1.0 and same.kept is False
    odd = [*was, was[0], ("v", 1, "t1", 1.0)]
    assert sorted(tuple(r) for r in ev.unpaired(run(spark, odd), run(spark, was[1:])).collect()) == [("p", "s", "0", "twice"), ("p", "v", "1", "only before")]
    assert ev.judgement(run(spark, odd), run(spark, was), 200).collect()[0].kept is None
    none = ev.judgement(run(spark, was).limit(0), run(spark, was).limit(0), 200).collect()[0]
    assert (none.questions, none.topics, none.kept) == (0, 0, None)


def test_trigger_scores_and_the_log(spark):
    tasks = spark.createDataFrame([("a", "should"), ("b", "should"), ("c", "not"), ("d", "never")], "task string, group string")
    rows = [
        ("a", 1, 1, True, False, False, 0, 0, 0), ("a", 1, 2, True, True, True, 1, 1, 1), ("a", 1, 3, False, False, False, 9, 9, 0), ("a", 2, 1, True, True, False, 1, 2, 3),
        ("b", 1, 1, True, True, False, 1, 2, 2), ("b", 2, 1, True, False, False, 1, 1, 0), ("c", 1, 1, True, False, None, 0, 0, None),
    ]
    kinds = "task string, run int, attempt int, scored boolean, called boolean, before_edit boolean, answered int, sent int, log_rows int"
    outcomes = spark.createDataFrame(rows, kinds)
    got = {r.group: r for r in ev.trigger_scores(tasks, outcomes, 200).collect()}
    s = got["should"]
    assert (s.tasks, s.runs, s.calls, s.share, s.low, s.high, s.every, s.some, s.none, s.early_share) == (2, 4, 3, 0.75, 0.5, 1.0, 1, 1, 0, 0.25)
    assert (got["not"].share, got["not"].none, got["not"].early_share) == (0.0, 1, None)
    assert (got["never"].tasks, got["never"].runs, got["never"].share) == (1, None, None)
    assert sorted(tuple(r) for r in ev.log_disagreements(outcomes).collect()) == [("a", 2), ("b", 2)]
    assert ev.trigger_scores(tasks.limit(0), outcomes.limit(0), 10).count() == 0


def test_pages_of_entries(spark):
    rows = [(i, i % 3 or None, None, "x.y" if i % 2 else "x", ["user", "token", "pack", None][i % 4], ["1", "2", "law", "1"][i % 4]) for i in range(10)]
    entries = spark.createDataFrame(rows, "seq long, actor long, actor_token long, action string, target_type string, target string")
    users, tokens = (spark.createDataFrame([(1, f"{n} one"), (2, f"{n} two")], "id long, name string") for n in ("user", "token"))
    first = gv.entry_page(entries, users, tokens, 4).orderBy("turn").collect()
    assert [r.seq for r in first] == [9, 8, 7, 6] and {(r.next_before, r.total) for r in first} == {(6, 10)}
    assert [(r.actor_name, r.target_user_name, r.target_token_name) for r in first] == [(None, None, "token two"), ("user two", "user one", None), ("user one", None, None), (None, None, None)]
    last = gv.entry_page(entries, users, tokens, 4, before=4).collect()
    assert sorted(r.seq for r in last) == [0, 1, 2, 3] and {r.next_before for r in last} == {None}
    assert gv.latest_of(entries, users, tokens, "x").collect()[0].seq == 8 and gv.latest_of(entries, users, tokens, "z").count() == 0
    assert gv.entry_page(entries.limit(0), users.limit(0), tokens, 4).count() == 0


def test_versions_listed_with_drafts(spark):
    day = datetime.date
    rows = [(1, 10, 1, "published", day(2020, 1, 1)), (1, 11, 2, "published", day(2021, 1, 1)), (1, 12, 3, "published", day(2021, 1, 1)), (1, 13, 4, "published", day(2030, 1, 1)), (1, 14, 5, "draft", day(2031, 1, 1)), (1, 15, 6, "draft", None), (1, 16, 7, "discarded", day(2022, 1, 1))]
    versions = spark.createDataFrame(rows, "document long, version long, number int, status string, effective date")
    flags = spark.createDataFrame([(14, None, None), (14, day(2024, 1, 1), None), (14, None, day(2024, 1, 1)), (10, None, None)], "version long, accepted date, resolved date")
    got = {r.version: (r.state, r.until, r.flags, r.open) for r in asof.listed_versions(versions, flags, "2025-01-01").collect()}
    assert got == {
        10: ("replaced", day(2020, 12, 31), None, None), 11: ("replaced", day(2020, 12, 31), None, None), 12: ("in_force", day(2029, 12, 31), None, None),
        13: ("scheduled", None, None, None), 14: ("draft", None, 3, 1), 15: ("draft", None, 0, 0),
    }
    assert asof.listed_versions(versions, flags, "2025-01-01", drafts=False).count() == 4


def test_headings_and_names_go_with_the_texts(spark):
    """All columns of a text stay; headings come by one row a clause, names by one row a document."""
    nodes = spark.createDataFrame([(1, None, "N1"), (2, 1, None), (3, 2, "N3"), (4, 99, None)], "id long, parent long, label string")
    rows = [
        (10, 1, "en", "early", None, None), (11, 1, "en", "that day", None, "2020-01-01"), (12, 1, "fr", None, "fr label", None), (20, 2, "en", None, None, None),
        (30, 3, "en", "x", None, "2020-01-01"), (31, 3, "fr", "x", None, None), (32, 3, None, "x", None, None), (33, 3, "de", "x", None, None), (40, 4, "en", "x", None, None),
    ]
    texts = spark.createDataFrame(rows, "text_id long, node long, lang string, heading string, label string, applies_from string").withColumns({"applies_from": F.to_date("applies_from"), "slug": F.lit("d")})
    found = {r.text_id: r for r in em.with_headings(texts, nodes).collect()}
    assert len(found) == len(rows) and found[30].slug == "d"
    assert {i: r.headings for i, r in found.items() if r.headings} == {20: ["early"], 30: ["that day"], 31: ["fr label"], 32: ["N1"], 33: ["N1"]}
    assert {r.text_id: r.headings for r in em.ancestor_headings(texts, nodes).collect()} == {i: r.headings for i, r in found.items() if r.headings}
    names = spark.createDataFrame([("d", "fr", "Loi"), ("d", "en", "Act"), ("e", "de", "Gesetz")], "slug string, lang string, title string")
    asked = spark.createDataFrame([("d", "fr"), ("d", "de"), ("e", "en"), ("f", "en"), ("d", None)], "slug string, lang string")
    assert {(r.slug, r.lang): r.name for r in em.with_name(asked, names).collect()} == {("d", "fr"): "Loi", ("d", "de"): "Act", ("e", "en"): "Gesetz", ("f", "en"): None, ("d", None): None}


def test_corpus_reads_its_clauses_once_a_use(spark):
    """The texts of a clause come out of one row of it, and nothing is joined for parents and predecessors a clause at a time."""
    known = corpus(spark, "/root/testdata/sf0.001")
    assert known.texts._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    ids = {r.id for r in known.nodes.select("id").collect()}
    met = known.nodes.where("parent is not null or previous_id is not null").select("parent", "previous_id").collect()
    assert any(r.previous_id for r in met) and all(x in ids for r in met for x in r if x is not None)


def test_texts_of_trees_have_the_headings_that_joins_find(spark):
    """Every tree in one row: lost parents, clauses and trees without texts, wordings of other days, and depth and cycles as errors."""
    rng = random.Random(5)
    nodes, texts = [], []
    for tree in range(40):
        for i in range(rng.choice([0, 1, 3, 9, 40])):
            up = rng.choice([None, 999_999, *(tree * 100 + j for j in range(i))]) if i else None
            nodes.append((tree, tree * 100 + i, up, rng.choice([None, f"N{i}"])))
            texts += [((tree * 100 + i) * 8 + k, tree * 100 + i, rng.choice(["en", "fr", None]), rng.choice([None, f"h{k}"]), rng.choice([None, "l"]), rng.choice([None, datetime.date(2020, 1, k + 1)])) for k in range(rng.choice([0, 1, 4]))]
    rng.shuffle(nodes)
    nodes = spark.createDataFrame(nodes, "tree int, id long, parent long, label string")
    texts = spark.createDataFrame(texts, "text_id long, node long, lang string, heading string, label string, applies_from date")
    own = texts.groupBy(F.col("node").alias("id")).agg(F.collect_list(F.struct("text_id", "lang", "heading", "label", "applies_from")).alias("texts"))
    nested = lambda nodes: nodes.join(own, "id", "left").groupBy("tree").agg(F.collect_list(F.struct("id", "parent", "label", "texts")).alias("clauses"))
    trees = nested(nodes)
    got = {r.text_id: (r.tree, r.headings) for r in em.texts_of_trees(trees).select("tree", "text_id", "headings").collect()}
    assert got == {r.text_id: (r.node // 100, r.headings or []) for r in em.with_headings(texts, nodes).collect()} and any(len(h) > 3 for _, h in got.values())
    assert em.texts_of_trees(trees).columns == ["tree", "text_id", "lang", "heading", "label", "applies_from", "headings"]
    assert em.texts_of_trees(trees.limit(0)).count() == 0 and em.texts_of_trees(trees.withColumn("clauses", F.when(F.col("tree") < 0, F.col("clauses")))).count() == 0
    with_text = lambda c: c.withField("texts", F.array(F.struct(c["id"].alias("text_id"), *(F.lit("x").alias(n) for n in ("lang", "heading", "label", "applies_from")))))
    for odd in ([(1, 1, 2, "a"), (1, 2, 1, "b")], [(1, i, i - 1 or None, "c") for i in range(1, 7)]):
        with pytest.raises(PythonException, match="more than 3 nodes"):
            em.texts_of_trees(nested(spark.createDataFrame(odd, nodes.schema)).withColumn("clauses", F.transform("clauses", with_text)), levels=3).collect()


def test_embedded_strings_store_nothing_and_deal_each_table_once(spark):
    """Disk: lines, versions (by document, then by version) and names are shuffled once each, and no table is kept on the way."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query, most in ((embedded_strings, 4), (ancestor_headings, 2)):
            plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
            assert "RDD" not in plan.optimizedPlan().toString() and "Loop" not in plan.optimizedPlan().toString()
            assert plan.executedPlan().toString().count("Exchange hashpartitioning") == most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lines_without_a_number_are_no_clauses(spark, tmp_path):
    """As in SQL, where no clause has their id; a clause below a line that isn't there has nothing above it."""
    for name in ("customer", "orders", "lineitem"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "lineitem":
            rows = rows.where("l_orderkey < 300 and not (l_orderkey % 3 = 0 and l_linenumber = 1)").withColumn("l_linenumber", F.when(F.col("l_linenumber") != 5, F.col("l_linenumber")))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    got = [r.text_id for r in embedded_strings(spark, str(tmp_path)).collect()]
    assert got and None not in got and len(got) == len(set(got)) and not any(i // 8 % 8 == 5 for i in got)
    above = {r.text_id: r.headings for r in ancestor_headings(spark, str(tmp_path)).collect()}
    assert above and not any(i // 64 % 3 == 0 and i // 8 % 8 in (2, 3) for i in above)
