"""Chains and exports, evaluation sets and runs, rights: on events, orders, embeddings, parts and customers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.operators import evaluation as ev
from clausewright.operators import governance as gv
from clausewright.operators import querylog as ql
from clausewright.operators import retrieval as rt
from clausewright.plans.bindings import LOG_SQL, log_entries
from clausewright.plans.catalog import query
from clausewright.plans.corpus_queries import _FIELD, _HASHED, _governed
from clausewright.plans.retrieval_queries import _KEYWORD, _MEANING, _clauses, _question_vectors, _questions, _vectors
from clausewright.session import cut, table

_RECIPE = f"""sha256({_FIELD.format("'1'")} || unhex('0000000000000020') || unhex({{prev}}) || {" || ".join(_FIELD.format(f) for f in _HASHED)})"""


@query(
    "gov2_built_chains",
    f"""WITH RECURSIVE {LOG_SQL}, own AS (SELECT *, id % 251 AS chain, row_number() OVER (PARTITION BY id % 251 ORDER BY id) AS n FROM entries),
    links AS (SELECT chain, id AS seq, n, sha256(CAST(chain AS VARCHAR)) AS prev_hash, {_RECIPE.format(prev="sha256(CAST(chain AS VARCHAR))")} AS entry_hash FROM own WHERE n = 1
      UNION ALL SELECT own.chain, own.id, own.n, links.entry_hash, {_RECIPE.format(prev="links.entry_hash")} FROM links JOIN own ON own.chain = links.chain AND own.n = links.n + 1)
    SELECT chain, seq, prev_hash, entry_hash FROM links""",
)
def built_chains(spark, sf_dir):
    """GOV2: many chains of the log, each entry hashed over the one before."""
    return gv.chained(_governed(spark, sf_dir).withColumn("chain", F.col("seq") % 251), "chain")


@query(
    "gov3_verified_chains",
    f"""WITH {LOG_SQL}, own AS (SELECT id AS seq, coalesce(actor, 0) AS chain, row_number() OVER (PARTITION BY coalesce(actor, 0) ORDER BY id) AS n, count(*) OVER (PARTITION BY coalesce(actor, 0)) AS size FROM entries),
    t AS (SELECT chain, size, chain % 8 AS kind, max(seq) FILTER (n = 5) AS fifth, max(seq) FILTER (n = 6) AS sixth, max(seq) FILTER (n = 2) AS second FROM own GROUP BY chain, size)
    SELECT chain, size - CASE WHEN kind IN (3, 5) THEN 1 ELSE 0 END AS entries, CASE WHEN kind IN (1, 2) THEN fifth WHEN kind IN (3, 6) THEN sixth WHEN kind = 5 THEN second END AS bad_seq,
      CASE kind WHEN 1 THEN 'altered' WHEN 2 THEN 'unknown version' WHEN 3 THEN 'not linked' WHEN 5 THEN 'wrong start' WHEN 6 THEN 'altered' END AS reason, kind = 4 AS out_of_order FROM t""",
)
def verified_chains(spark, sf_dir):
    """GOV3: each actor's chain of the log, built with real hashes and then harmed in six ways, walked from genesis."""
    chain = F.coalesce(F.col("actor").cast("long"), F.lit(0))
    rows = _governed(spark, sf_dir).drop("prev_hash").withColumn("chain", chain)
    built = cut(gv.chained(rows, "chain").join(rows, ["chain", "seq"]).withColumn("hash_version", F.lit("1")))
    n, kind = F.row_number().over(W.partitionBy("chain").orderBy("seq")), F.col("chain") % 8
    placed = built.withColumn("n", n)
    gone = placed.where(~(((kind == 3) & (F.col("n") == 5)) | ((kind == 5) & (F.col("n") == 1))))
    # 1: other details; 2: another version; 3: one is missing; 4: two change their numbers; 5: the first is missing; 6: a link to another entry, so that the hash is wrong.
    swapped = F.when((kind == 4) & F.col("n").isin(5, 6), F.when(F.col("n") == 5, F.lead("seq").over(W.partitionBy("chain").orderBy("seq"))).otherwise(F.lag("seq").over(W.partitionBy("chain").orderBy("seq")))).otherwise(F.col("seq"))
    harmed = gone.withColumns({
        "details": F.when((kind == 1) & (F.col("n") == 5), "{}").otherwise(F.col("details")), "hash_version": F.when((kind == 2) & (F.col("n") == 5), "2").otherwise(F.col("hash_version")),
        "prev_hash": F.when((kind == 6) & (F.col("n") == 6), F.sha2(F.lit("x"), 256)).otherwise(F.col("prev_hash")), "moved": swapped,
    }).drop("seq").withColumnRenamed("moved", "seq")
    genesis = rows.select("chain").distinct().withColumn("genesis", F.sha2(F.col("chain").cast("string"), 256))
    return gv.verified_chains(harmed, genesis)


@query(
    "gov4_verified_exports",
    """WITH e AS (SELECT event_id % 97 AS export, event_id AS seq, sha256('p' || event_id) AS prev_hash, sha256('e' || event_id) AS entry_hash FROM events),
    x AS (SELECT export, count(*) AS n FROM e GROUP BY export) SELECT export, CASE WHEN export % 10 = 1 THEN 'count' WHEN export % 10 = 2 THEN 'start' ELSE 'end' END AS problem FROM x WHERE export % 10 IN (1, 2, 3)""",
)
def verified_exports(spark, sf_dir):
    """GOV4: exports whose manifest tells another count, start or end."""
    digest = lambda letter: F.sha2(F.concat(F.lit(letter), F.col("event_id").cast("string")), 256)
    entries = table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("export"), F.col("event_id").alias("seq"), digest("p").alias("prev_hash"), digest("e").alias("entry_hash"))
    told = entries.groupBy("export").agg(
        F.count("*").alias("n"), F.min(F.struct("seq", "prev_hash"))["prev_hash"].alias("first"), F.max(F.struct("seq", "entry_hash"))["entry_hash"].alias("last")
    )
    kind, wrong = F.col("export") % 10, F.lit("00")
    manifests = told.select(
        "export", F.when(kind == 1, F.col("n") + 1).otherwise(F.col("n")).alias("entries"), (kind % 2 == 0).alias("anchored"),
        F.when(kind == 2, wrong).otherwise(F.col("first")).alias("genesis_hash"), F.col("first").alias("first_prev_hash"), F.when(kind == 3, wrong).otherwise(F.col("last")).alias("final_entry_hash"),
    )
    return gv.verify_exports(entries, manifests)


_GRID = """b AS (SELECT unnest(['keyword', 'meaning', 'convex:0.5', 'rrf:10']) AS base), m AS (SELECT unnest(range(10)) AS i),
  g AS (SELECT base, list_sort(CASE i WHEN 8 THEN ['normative', 'normative'] WHEN 9 THEN ['light'] ELSE list_filter(['normative', 'questions', 'rerank'], lambda x, n: (i >> (n - 1)) % 2 = 1) END) AS mods FROM b, m),
  told AS (SELECT base || CASE WHEN len(mods) > 0 THEN '+' || array_to_string(mods, '+') ELSE '' END AS configuration, base, mods,
    CASE WHEN list_contains(mods, 'light') THEN 'unknown modifier' WHEN list_contains(mods, 'questions') AND base = 'keyword' THEN 'no meaning list' WHEN len(list_distinct(mods)) < len(mods) THEN 'named twice' END AS problem FROM g)"""
_RUNS = f"""WITH {_KEYWORD}, {_MEANING}, {_GRID},
  named AS (SELECT doc_id AS key, source || ':' || lang || ':' || doc_id AS path FROM documents),
  modes AS (SELECT unnest([false, true]) AS normative),
  every_list AS (
    SELECT 'keyword' AS retriever, normative, qid, key, score, row_number() OVER (PARTITION BY normative, qid ORDER BY score DESC, key) AS at_ FROM bm, modes WHERE NOT normative OR key % 4 <> 0
    UNION ALL SELECT 'meaning', normative, qid, key, score, row_number() OVER (PARTITION BY normative, qid ORDER BY score DESC, key) FROM cos, modes WHERE NOT normative OR key % 4 <> 0
    UNION ALL SELECT 'questions', normative, qid, key, score, row_number() OVER (PARTITION BY normative, qid ORDER BY score DESC, key) FROM cos, modes WHERE key % 3 = 0 AND (NOT normative OR key % 4 <> 0)),
  lists AS (SELECT retriever, normative, qid, path AS key, score FROM every_list JOIN named USING (key) WHERE at_ <= 100),
  z AS (SELECT normative, qid, key, CASE WHEN min(score) OVER w = max(score) OVER w THEN 0e0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END AS z FROM lists WHERE retriever <> 'keyword' WINDOW w AS (PARTITION BY normative, qid, retriever)),
  each_list AS (SELECT * FROM lists WHERE retriever <> 'questions' UNION ALL SELECT 'blended', normative, qid, key, round(max(z), 5) FROM z GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY retriever, normative, qid ORDER BY score DESC, key) AS rank FROM each_list),
  used AS (
    SELECT configuration, base, list_contains(mods, 'rerank') AS rerank, qid, CASE retriever WHEN 'keyword' THEN 'keyword' ELSE 'meaning' END AS retriever, key, score, rank
    FROM placed JOIN told ON problem IS NULL AND list_contains(mods, 'normative') = normative
    AND CASE WHEN retriever = 'keyword' THEN base <> 'meaning' ELSE base <> 'keyword' AND list_contains(mods, 'questions') = (retriever = 'blended') END),
  spread AS (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high FROM used WHERE base = 'convex:0.5' WINDOW w AS (PARTITION BY configuration, qid, retriever)),
  fused AS (
    SELECT configuration, rerank, qid, key, score FROM used WHERE base IN ('keyword', 'meaning')
    UNION ALL SELECT configuration, rerank, qid, key, round(sum(1e0 / (10 + rank)), 9) FROM used WHERE base = 'rrf:10' GROUP BY ALL
    UNION ALL SELECT configuration, rerank, qid, key, round(sum(CASE WHEN high = low THEN 1e0 ELSE (score - low) / (high - low) END * 0.5e0), 6) FROM spread GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY configuration, qid ORDER BY score DESC, key) AS rank FROM fused QUALIFY rank <= 100),
  results AS (
    SELECT configuration, qid, key, row_number() OVER (PARTITION BY configuration, qid ORDER BY CASE WHEN rerank AND rank <= 25 THEN 0 ELSE 1 END, CASE WHEN rerank AND rank <= 25 THEN CAST(split_part(key, ':', 3) AS BIGINT) * 7919 % 101 END DESC, rank) AS rank FROM ranked),
  expected AS (SELECT configuration, item_id AS qid, 'src' || (item_id % 5) AS answer FROM benchmark, told WHERE problem IS NULL),
  firsts AS (SELECT e.configuration, e.qid, min(rank) FILTER (starts_with(r.key, answer || ':')) AS first FROM expected e LEFT JOIN results r ON r.configuration = e.configuration AND r.qid = e.qid GROUP BY ALL),
  scored AS (SELECT configuration, count(*) AS n, round(avg(CASE WHEN first <= 5 THEN 1e0 ELSE 0e0 END), 4) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1e0 ELSE 0e0 END), 4) AS recall_10, round(avg(coalesce(1e0 / first, 0)), 4) AS mrr FROM firsts GROUP BY 1)
  SELECT configuration, problem, n, recall_5, recall_10, mrr FROM told LEFT JOIN scored USING (configuration)"""


@query("ev5_configurations", _RUNS)
def configurations(spark, sf_dir):
    """EV5, EV10: a grid of configurations, each valid one run over every benchmark item: recall and mean reciprocal rank."""
    questions, clauses, vectors = _questions(spark, sf_dir), _clauses(spark, sf_dir), _vectors(spark, sf_dir)
    asked, normative = _question_vectors(spark, sf_dir), F.col("key") % 4 != 0
    named = clauses.select(F.col("key").alias("id"), F.concat_ws(":", "source", "lang", F.col("key").cast("string")).alias("key"))
    listed = lambda found, retriever, only: found.withColumnRenamed("key", "id").join(named, "id").select(F.lit(retriever).alias("retriever"), F.lit(only).alias("normative"), "qid", "key", "score", "rank")
    lists = listed(rt.keyword_search(questions, clauses), "keyword", False)
    lists = lists.unionByName(listed(rt.keyword_search(questions, clauses, among=clauses.where(normative).select("key")), "keyword", True))
    for only, kept in ((False, vectors), (True, vectors.where(normative))):
        lists = lists.unionByName(listed(rt.meaning_search(asked, kept), "meaning", only)).unionByName(listed(rt.meaning_search(asked, kept.where("key % 3 = 0")), "questions", only))
    expected = questions.select("qid", F.concat(F.lit("src"), (F.col("qid") % 5).cast("string")).alias("answer"))
    bases = F.explode(F.array(*[F.lit(b) for b in ("keyword", "meaning", "convex:0.5", "rrf:10")]))
    bits = F.array_compact(F.array(*[F.when(F.shiftright("id", i) % 2 == 1, F.lit(m)) for i, m in enumerate(ev.MODIFIERS)]))
    chosen = F.when(F.col("id") == 8, F.array(F.lit("normative"), F.lit("normative"))).when(F.col("id") == 9, F.array(F.lit("light"))).otherwise(bits)
    grid = spark.range(10).select(bases.alias("base"), chosen.alias("modifiers"))
    fresh = F.substring_index("key", ":", -1).cast("long") * 7919 % 101
    return ev.run_configurations(grid, cut(lists), expected, fresh)


_OUTCOMES = "SELECT label % 2 AS \"set\", 'run/' || (vec_id % 9) || CASE WHEN vec_id % 4 = 0 THEN '-chat' ELSE '' END AS id, CASE WHEN vec_id % 5 <> 3 THEN vec_id % 11 + 1 END AS first FROM embeddings"


def _outcomes(spark, sf_dir):
    i = F.col("vec_id")
    name = F.concat(F.lit("run/"), (i % 9).cast("string"), F.when(i % 4 == 0, "-chat").otherwise(""))
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("set"), name.alias("id"), F.when(i % 5 != 3, i % 11 + 1).alias("first"))


@query("ev6_pooled_topics", f"WITH o AS ({_OUTCOMES}) SELECT regexp_extract(regexp_replace(id, '-chat$', ''), '([^/]*)$', 1) AS topic, count(*) FILTER (first <= 5) AS hits, count(*) AS total FROM o GROUP BY 1")
def pooled_topics(spark, sf_dir):
    """EV6: outcomes of all sets pooled by topic."""
    return ev.pooled(_outcomes(spark, sf_dir))


@query(
    "ev8_judged_sets",
    f"""WITH o AS ({_OUTCOMES}), t AS (SELECT "set", regexp_extract(id, '([^/]*)$', 1) AS topic, count(*) FILTER (first <= 5) AS b, count(*) FILTER (first % 4 <= 1 AND first <= 8) AS a FROM o GROUP BY ALL)
    SELECT "set", sum(greatest(a - b, 0)) AS gained, sum(greatest(b - a, 0)) AS lost, sum(greatest(a - b, 0)) >= sum(greatest(b - a, 0)) AS kept FROM t GROUP BY 1""",
)
def judged_sets(spark, sf_dir):
    """EV8: two runs by topics' sums, and each set's decision."""
    before = _outcomes(spark, sf_dir).withColumn("topic", F.regexp_extract("id", "([^/]*)$", 1))
    after = before.withColumn("first", F.when((F.col("first") % 4 <= 1) & (F.col("first") <= 8), 1))
    return ev.judged(before, after)


@query("ag19_answered_in_full", "SELECT l_orderkey AS question, bool_and(l_quantity > 10) AS answered FROM lineitem GROUP BY 1")
def answered_in_full(spark, sf_dir):
    """AG19: questions all of whose parts were hit."""
    return ev.answered_in_full(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), (F.col("l_quantity") > 10).alias("hit")))


@query(
    "ev11_trigger_rates",
    """WITH r AS (SELECT user_id AS task, event_id % 3 AS run, event_id AS attempt, CASE WHEN event_type <> 'signup' THEN value > 10 END AS passed FROM events),
    l AS (SELECT task, run, arg_max(passed, attempt) AS passed FROM r WHERE passed IS NOT NULL GROUP BY ALL)
    SELECT task, round(avg(CAST(passed AS INTEGER)), 4) AS share, CASE WHEN bool_and(passed) THEN 'every' WHEN bool_or(passed) THEN 'some' ELSE 'none' END AS verdict FROM l GROUP BY task""",
)
def trigger_rates(spark, sf_dir):
    """EV11, AG22, AG23: the last scored attempt of each run, and how consistent a task's runs are."""
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), (F.col("event_id") % 3).alias("run"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") != "signup", F.col("value") > 10).alias("passed"))
    return ev.consistency(ev.last_attempts(runs))


@query(
    "ev12_audited_questions",
    r"""WITH q AS (SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS article, CASE WHEN p_partkey % 3 = 0 THEN 'Article ' || (p_size + p_partkey % 2) || ' says' END AS quote, CASE WHEN p_partkey % 5 = 0 THEN 'n' END AS note,
      CASE WHEN p_partkey % 4 = 0 THEN 'The text' ELSE 'As Art. ' || p_size || ' or Article ' || p_size || ' says' END AS evidence FROM part)
    SELECT id, CASE WHEN quote IS NOT NULL AND NOT contains(evidence, quote) THEN 'rejected' WHEN regexp_matches(coalesce(quote, evidence), '\b(?:Article|Art\.)\s*' || article || '\b') THEN 'cited' WHEN note IS NOT NULL THEN 'justified' ELSE 'rejected' END AS verdict FROM q""",
)
def audited_questions(spark, sf_dir):
    """EV12: which questions their sources bear out."""
    i, n = F.col("p_partkey"), F.col("p_size").cast("string")
    quote = F.when(i % 3 == 0, F.concat(F.lit("Article "), (F.col("p_size") + i % 2).cast("string"), F.lit(" says")))
    evidence = F.when(i % 4 == 0, "The text").otherwise(F.concat(F.lit("As Art. "), n, F.lit(" or Article "), n, F.lit(" says")))
    return ev.audited(table(spark, sf_dir, "part").select(i.alias("id"), n.alias("article"), quote.alias("quote"), F.when(i % 5 == 0, "n").alias("note"), evidence.alias("evidence")))


@query(
    "ag17_managers",
    """WITH u AS (SELECT c_custkey AS user_id, c_acctbal > 0 AS active, c_nationkey % 4 AS role FROM customer), t AS (SELECT o_custkey AS user_id, o_orderstatus <> 'F' AS works FROM orders)
    SELECT role, count(DISTINCT u.user_id) FILTER (active) AS holders, count(*) FILTER (active AND works) AS tokens FROM u LEFT JOIN t ON t.user_id = u.user_id GROUP BY role""",
)
def managers(spark, sf_dir):
    """AG17: active holders of each role and their working tokens."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("active"), (F.col("c_nationkey") % 4).alias("role"))
    tokens = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") != "F").alias("works"))
    counted = tokens.groupBy("user_id").agg(F.count_if("works").alias("n"))
    return users.join(counted, "user_id", "left").groupBy("role").agg(F.count_if("active").alias("holders"), F.sum(F.when(F.col("active"), F.coalesce("n", F.lit(0))).otherwise(0)).alias("tokens"))


@query(
    "fil14_token_states",
    """SELECT o_orderkey AS token, CASE WHEN o_orderstatus = 'F' THEN 'revoked' WHEN o_orderdate + INTERVAL 500 DAY <= TIMESTAMP '1997-01-01' THEN 'expired' WHEN c_acctbal < 0 THEN 'owner_inactive'
    WHEN TIMESTAMP '1997-01-01' - o_orderdate > INTERVAL 90 DAY THEN 'idle' ELSE 'usable' END AS state FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def token_states(spark, sf_dir):
    """FIL14, SM5: revoked, expired, of an inactive owner, idle, usable."""
    now, day = F.lit("1997-01-01").cast("timestamp"), F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    state = (
        F.when(F.col("o_orderstatus") == "F", "revoked").when(day + F.expr("interval 500 days") <= now, "expired").when(F.col("c_acctbal") < 0, "owner_inactive")
        .when(day < now - F.expr("interval 90 days"), "idle").otherwise("usable")
    )
    return rows.select(F.col("o_orderkey").alias("token"), state.alias("state"))


@query(
    "snk1_loaded_packs",
    """WITH old AS (SELECT o_custkey AS document, o_orderkey AS version, 'pack:' || o_custkey || '@' || o_orderkey AS source_ref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders WHERE o_orderkey % 3 <> 0),
    new AS (SELECT DISTINCT o_custkey AS document, o_orderkey AS version, 'pack:' || o_custkey || '@' || o_orderkey AS source_ref FROM orders WHERE o_orderkey % 2 = 0),
    last AS (SELECT document, max(version) AS version, max(number) AS number FROM old GROUP BY 1), fresh AS (SELECT new.* FROM new WHERE source_ref NOT IN (SELECT source_ref FROM old))
    SELECT f.document, f.version, CASE WHEN f.version < l.version THEN 'older' ELSE 'loaded' END AS outcome, CASE WHEN f.version > coalesce(l.version, -1) THEN coalesce(l.number, 0) + row_number() OVER (PARTITION BY f.document, f.version < l.version ORDER BY f.version) END AS number
    FROM fresh f LEFT JOIN last l ON l.document = f.document""",
)
def loaded_packs(spark, sf_dir):
    """SNK1: releases not loaded yet get the next numbers, older ones are refused, loaded ones are left out."""
    ref = F.concat(F.lit("pack:"), F.col("o_custkey").cast("string"), F.lit("@"), F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("version"), ref.alias("source_ref"))
    return gv.loaded(rows.where("version % 3 <> 0"), rows.where("version % 2 = 0").distinct())


@query("snk6_logged_results", f"WITH {LOG_SQL} SELECT e.id, row_number() OVER (PARTITION BY e.id ORDER BY l_orderkey, l_linenumber, l_partkey) AS rank, l_partkey AS clause FROM entries e JOIN (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 48) ON l_suppkey = actor WHERE status = 'ok'")
def logged_results(spark, sf_dir):
    """SNK6: ranked results of answered entries that resolve to a version; what doesn't resolve is skipped."""
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("actor"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("clause")).distinct()
    return ql.resolved(log_entries(spark, sf_dir).where("status = 'ok'").select("id", "actor"), known, "actor", ["l_orderkey", "l_linenumber", "clause"]).select("id", "rank", "clause")
