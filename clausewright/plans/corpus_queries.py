"""Trees, governance chain, evaluation, redaction and rights on the driver's tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from clausewright.functions import redaction as rd
from clausewright.operators import evaluation as ev
from clausewright.operators import governance as gv
from clausewright.operators import retrieval as rt
from clausewright.operators import trees
from clausewright.plans.bindings import LOG_SQL, VERSIONS_SQL, log_entries, versions
from clausewright.plans.catalog import query
from clausewright.plans.retrieval_queries import _KEYWORD, _keyword
from clausewright.session import table

_NODES = """nodes AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent, r_regionkey AS place, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, CAST(s_suppkey AS INTEGER), s_name FROM supplier)"""
_WALK = f"""RECURSIVE {_NODES}, walk AS (
  SELECT id, [name] AS trail, [place] AS order_path, id AS root FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.id, list_append(trail, n.name), list_append(order_path, n.place), root FROM walk JOIN nodes n ON n.parent = walk.id)"""


def _nodes(spark, sf_dir):
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    region = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("place"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"), "n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey"), F.col("s_suppkey").cast("int"), "s_name")
    return region.union(nation).union(supplier)


@query("tr3_subtrees", f"WITH {_WALK} SELECT root, id, CAST(len(trail) AS INTEGER) AS depth, row_number() OVER (PARTITION BY root ORDER BY order_path) AS position FROM walk")
def subtrees(spark, sf_dir):
    """TR3, SO6, ST1: subtrees in reading order."""
    return trees.subtrees(_nodes(spark, sf_dir), 3)


@query("tr2_breadcrumbs", f"WITH {_WALK} SELECT id, array_to_string(trail[1 : len(trail) - 1], ' > ') AS crumbs FROM walk")
def breadcrumbs(spark, sf_dir):
    """TR2, TR8: ancestors, outermost first."""
    return trees.breadcrumbs(_nodes(spark, sf_dir), 3)


_CLAUSES = """keyed AS (SELECT v AS version, l_partkey * 10 + (l_linenumber + v * CAST(l_partkey % 5 = 0 AS INTEGER)) % 7 AS key, l_orderkey * 8 + l_linenumber AS id FROM lineitem, (VALUES (1), (2), (3)) t(v)),
clauses AS MATERIALIZED (SELECT version, key, min(id) AS id, CASE WHEN version > 1 AND (min(id) // 8) % 3 <> 0 THEN min(id) END AS previous_id FROM keyed GROUP BY version, key)"""


@query(
    "tr4_continuations",
    f"""WITH {_CLAUSES}, before AS MATERIALIZED (SELECT version + 1 AS version, key, id FROM clauses)
    SELECT c.version, c.key, CASE WHEN o.key <> c.key THEN o.key END AS moved_from, CASE WHEN h.id IS NOT NULL AND h.id IS DISTINCT FROM c.previous_id THEN h.id END AS formerly
    FROM clauses c LEFT JOIN before o ON o.version = c.version AND o.id = c.previous_id LEFT JOIN before h ON h.version = c.version AND h.key = c.key""",
)
def continuations(spark, sf_dir):
    """JN2, TR5: clauses moved since the version before, numbers that named another clause there."""
    return trees.continued(_clauses(spark, sf_dir))


def _clauses(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    shift = F.when(F.col("l_partkey") % 5 == 0, F.col("version")).otherwise(0)
    key, own = F.col("l_partkey") * 10 + (F.col("l_linenumber") + shift) % 7, F.col("l_orderkey") * 8 + F.col("l_linenumber")
    first = li.groupBy("version", key.alias("key")).agg(F.min(F.struct("l_orderkey", own.alias("id"))).alias("c"))
    previous = F.when((F.col("version") > 1) & (F.col("c.l_orderkey") % 3 != 0), F.col("c.id"))
    return first.select("version", "key", "c.id", previous.alias("previous_id"))


@query(
    "wn7_distinct_keys",
    """SELECT l_partkey AS parent, l_orderkey * 8 + l_linenumber AS place, l_returnflag || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS key
    FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey * 8 + l_linenumber) AS n FROM lineitem)""",
)
def distinct_keys(spark, sf_dir):
    """WN7, PL5: suffixes of repeated keys."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("parent"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), F.col("l_returnflag").alias("segment"))
    return trees.distinct_keys(rows)


@query(
    "so5_natural_order",
    r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_brand || '-' || p_size, '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(p, 20, '0') ELSE p END), '|') AS sort_key FROM part""",
)
def natural_order(spark, sf_dir):
    """SO5: digits compare as numbers."""
    name = F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(rd.natural_key(name), "|").alias("sort_key"))


@query(
    "src15_newest_release",
    """WITH r AS (SELECT c_mktsegment AS law, '20' || c_nationkey || '.' || (c_custkey % 13) AS version, c_custkey % 4 = 0 AS draft FROM customer)
    SELECT law, arg_max(version, list_transform(string_split(version, '.'), lambda p: CAST(p AS INTEGER))) AS newest FROM r WHERE NOT draft GROUP BY law""",
)
def newest_release(spark, sf_dir):
    """SRC15, SC11: the newest version by its numbers, drafts left out."""
    version = F.concat(F.lit("20"), F.col("c_nationkey").cast("string"), F.lit("."), (F.col("c_custkey") % 13).cast("string"))
    rows = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_mktsegment").alias("law"), version.alias("version"))
    return rows.groupBy("law").agg(F.max_by("version", rd.version_key(F.col("version"))).alias("newest"))


_FIELD = "unhex(printf('%016x', octet_length(encode({0})))) || encode({0})"
_HASHED = [
    "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ')", "coalesce(CAST(actor AS VARCHAR), '')", "''", "operation || '.' || status", "'document'", "pack", "props",
]
_CHAIN = f"""{LOG_SQL}, chained AS (SELECT id AS seq, sha256('entry' || (id - 1)) AS prev_hash, sha256('entry' || id) AS entry_hash FROM entries)"""


def _governed(spark, sf_dir):
    log = log_entries(spark, sf_dir)
    return log.select(
        F.col("id").alias("seq"), F.sha2(F.concat(F.lit("entry"), (F.col("id") - 1).cast("string")), 256).alias("prev_hash"),
        gv.timestamp_text(F.col("created_at")).alias("occurred_at"), F.col("actor").cast("string").alias("actor"), F.lit(None).cast("string").alias("token"),
        F.concat_ws(".", "operation", "status").alias("action"), F.lit("document").alias("target_type"), F.col("pack").alias("target_id"), F.col("props").alias("details"),
    )


@query(
    "gov1_entry_hashes",
    f"""WITH {_CHAIN} SELECT seq, sha256({_FIELD.format("'1'")} || unhex('0000000000000020') || unhex(prev_hash) || {" || ".join(_FIELD.format(f) for f in _HASHED)}) AS hash
    FROM chained JOIN entries ON id = seq""",
)
def entry_hashes(spark, sf_dir):
    """GOV1, GOV5: the hash of every entry over its nine fields."""
    return _governed(spark, sf_dir).select("seq", gv.entry_hash(F.unhex("prev_hash"), *map(F.col, gv.FIELDS)).alias("hash"))


@query(
    "gov3_broken_links",
    f"""WITH {LOG_SQL}, c AS (SELECT id AS seq, sha256('entry' || CASE WHEN id % 101 = 7 THEN id - 2 WHEN id % 103 = 9 THEN id + 5 WHEN id % 107 = 11 THEN -9 ELSE id - 1 END) AS prev_hash, sha256('entry' || id) AS entry_hash FROM entries),
    f AS (SELECT prev_hash, min(seq) AS first FROM c GROUP BY 1 HAVING count(*) > 1)
    SELECT seq, 'forked' AS problem FROM c JOIN f USING (prev_hash) WHERE seq <> first
    UNION ALL SELECT a.seq, CASE WHEN b.seq IS NULL THEN 'orphan' ELSE 'out_of_order' END FROM c a LEFT JOIN c b ON a.prev_hash = b.entry_hash
    WHERE a.prev_hash <> sha256('entry-1') AND (b.seq IS NULL OR b.seq >= a.seq)""",
)
def broken_links(spark, sf_dir):
    """GOV3: forks, orphans, wrong order; altered fields are a test of their own."""
    i = F.col("seq")
    wrong = F.when(i % 101 == 7, i - 2).when(i % 103 == 9, i + 5).when(i % 107 == 11, -9).otherwise(i - 1)
    digest = lambda n: F.sha2(F.concat(F.lit("entry"), n.cast("string")), 256)
    rows = _governed(spark, sf_dir).withColumns({"prev_hash": digest(wrong), "entry_hash": digest(i)})
    genesis = hashlib.sha256(b"entry-1").hexdigest()
    return gv.verify(rows, genesis).where("problem <> 'altered'")


@query(
    "gov4_export_manifest",
    f"WITH {_CHAIN} SELECT count(*) AS count, min(seq) AS from_seq, max(seq) AS to_seq, arg_max(entry_hash, seq) AS final_hash FROM chained",
)
def export_manifest(spark, sf_dir):
    """GOV4, SNK9: the manifest of an export."""
    rows = _governed(spark, sf_dir)
    return gv.manifest(rows.withColumn("entry_hash", F.sha2(F.concat(F.lit("entry"), F.col("seq").cast("string")), 256)))


_HITS = f"""{_KEYWORD}, results AS (SELECT qid, source || ':' || lang || ':' || kw.key AS key, rank FROM kw JOIN bodies ON bodies.key = kw.key),
expected AS (SELECT item_id AS qid, 'src' || (item_id % 5) AS answer FROM benchmark),
firsts AS (SELECT e.qid, min(rank) FILTER (r.key = answer OR starts_with(r.key, answer || ':')) AS first FROM expected e LEFT JOIN results r ON r.qid = e.qid GROUP BY e.qid)"""


def _first_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "lang")
    results = _keyword(spark, sf_dir).join(docs, "key").select("qid", F.concat_ws(":", "source", "lang", F.col("key").cast("string")).alias("key"), "rank")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return ev.first_hits(results, items.withColumn("answer", F.concat(F.lit("src"), (F.col("qid") % 5).cast("string"))))


@query(
    "ev3_recall_mrr",
    f"""WITH {_HITS} SELECT qid % 3 AS topic, count(*) AS n, round(avg(CASE WHEN first <= 5 THEN 1e0 ELSE 0e0 END), 4) AS recall_5,
    round(avg(CASE WHEN first <= 10 THEN 1e0 ELSE 0e0 END), 4) AS recall_10, round(avg(coalesce(1e0 / first, 0)), 4) AS mrr FROM firsts GROUP BY 1""",
)
def recall_mrr(spark, sf_dir):
    """EV1, EV2, EV3, JN12: recall and reciprocal rank by topic."""
    return ev.scores(_first_hits(spark, sf_dir).withColumn("topic", F.col("qid") % 3), "topic")


_GROUPS = 'groups AS (SELECT label AS "group", count(*) FILTER (vec_id % 3 = 0) AS hits, count(*) AS total FROM embeddings GROUP BY label)'


@query(
    "ev4_bootstrap",
    f"""WITH {_GROUPS}, own AS (SELECT *, row_number() OVER (ORDER BY "group") - 1 AS i, count(*) OVER () AS n FROM groups),
    draws AS (SELECT round, CAST('0x' || substr(md5(round || '#' || i), 1, 8) AS BIGINT) % n AS i FROM own, range(2000) t(round)),
    rates AS (SELECT round, round(sum(hits) / sum(total), 4) AS rate FROM draws JOIN own USING (i) GROUP BY round),
    r AS (SELECT list_sort(list(rate)) AS r FROM rates) SELECT r[51] AS low, r[1951] AS high FROM r""",
)
def bootstrap(spark, sf_dir):
    """EV4: the resampled interval of a rate."""
    groups = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("group")).agg(F.count_if(F.col("vec_id") % 3 == 0).alias("hits"), F.count("*").alias("total"))
    return ev.interval(groups)


@query(
    "ev7_sign_flips",
    """WITH c AS (SELECT label AS "group", CAST(count(*) FILTER (vec_id % 7 = 0) - count(*) FILTER (vec_id % 8 = 0) AS BIGINT) AS change FROM embeddings GROUP BY label),
    s AS (SELECT round, sum(CASE WHEN CAST('0x' || substr(md5(round || '#' || "group"), 1, 8) AS BIGINT) % 2 = 0 THEN change ELSE -change END) AS s, sum(change) AS measured FROM c, range(10000) t(round) GROUP BY round)
    SELECT max(measured) AS measured, CASE WHEN max(measured) <= 0 THEN 1e0 ELSE round((count(*) FILTER (s >= measured) + 1) / 10001e0, 6) END AS chance FROM s""",
)
def sign_flips(spark, sf_dir):
    """EV7: the chance of a gain."""
    vectors = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("group"))
    return ev.chance_of_gain(vectors.agg((F.count_if(F.col("vec_id") % 7 == 0) - F.count_if(F.col("vec_id") % 8 == 0)).alias("change")))


@query(
    "ev8_compared_runs",
    f"""WITH {_HITS}, later AS (SELECT qid + 3 AS qid, first FROM firsts)
    SELECT coalesce(a.qid, b.qid) AS qid, CASE WHEN b.qid IS NULL THEN 'new' WHEN a.qid IS NULL THEN 'gone' WHEN coalesce(a.first <= 5, false) AND NOT coalesce(b.first <= 5, false) THEN 'gained'
      WHEN coalesce(b.first <= 5, false) AND NOT coalesce(a.first <= 5, false) THEN 'lost' ELSE 'same' END AS state FROM firsts b FULL JOIN later a ON a.qid = b.qid""",
)
def compared_runs(spark, sf_dir):
    """EV8, ST2: two runs, question by question."""
    hits = _first_hits(spark, sf_dir)
    return ev.compared(hits, hits.select((F.col("qid") + 3).alias("qid"), "first"))


@query(
    "ev9_gate",
    """WITH m AS (SELECT lang AS name, avg(CAST(n_chars > 400 AS INTEGER)) AS value FROM documents GROUP BY lang), p AS (SELECT DISTINCT lang AS name, len(lang) / 4e0 AS floor FROM documents WHERE lang <> 'en')
    SELECT name, CASE WHEN floor IS NULL THEN 'unpublished' WHEN value < floor THEN 'regression' ELSE 'ok' END AS verdict FROM m LEFT JOIN p USING (name)""",
)
def regression_gate(spark, sf_dir):
    """EV9: measured against published floors."""
    docs = table(spark, sf_dir, "documents")
    measured = docs.groupBy(F.col("lang").alias("name")).agg(F.avg((F.col("n_chars") > 400).cast("int")).alias("value"))
    published = docs.where("lang <> 'en'").select(F.col("lang").alias("name"), (F.length("lang") / 4).alias("floor")).distinct()
    return ev.gate(measured, published)


@query(
    "sc1_arabic_light",
    f"""WITH words(id, text) AS (VALUES (1, 'وَالْقانونُ'), (2, 'المادة ٧ للبيانات الشخصيّة'), (3, 'ال law')),
    plain AS (SELECT id, string_split_regex(translate(regexp_replace(text, '[ً-ٰٟـ]', '', 'g'), '{rd.FOLD_FROM}', '{rd.FOLD_TO}'), '[^0-9A-Za-zء-ي]+') AS w
      FROM (SELECT * FROM words UNION ALL SELECT doc_id + 100, text FROM documents))
    SELECT id, coalesce(array_to_string(list_transform(list_filter(w, lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^(وال|فال|بال|كال)..') THEN substr(x, 4)
      WHEN regexp_matches(x, '^(ال|لل)..') THEN substr(x, 3) ELSE x END), ' '), '') AS light FROM plain""",
)
def folded_words(spark, sf_dir):
    """SC1: light Arabic folding."""
    words = spark.createDataFrame([(1, "وَالْقانونُ"), (2, "المادة ٧ للبيانات الشخصيّة"), (3, "ال law")], "id long, text string")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), "text")
    return words.union(docs).select("id", F.coalesce(rd.arabic_light(F.col("text")), F.lit("")).alias("light"))


@query("sc3_redacted_questions")
def redacted_questions(spark, sf_dir):
    """SC3, SNK6: what is safe to store of every turn; the tests hold it to worked cases."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", rd.redact(F.col("text")).alias("r"))
    return told.select("conv_id", "turn", "r.text", "r.count", "r.types")


@query(
    "ag18_permissions",
    """WITH held AS (SELECT o_custkey AS user_id, o_orderpriority AS permission FROM orders WHERE o_orderstatus <> 'P'),
    own AS (SELECT user_id, list_sort(list(DISTINCT permission)) AS p FROM held GROUP BY user_id)
    SELECT c_custkey AS user_id, array_to_string(CASE WHEN c_acctbal < 0 THEN [] ELSE coalesce(p, []) END, ',') AS permissions,
      array_to_string(list_filter(CASE WHEN c_acctbal < 0 THEN [] ELSE coalesce(p, []) END, lambda x: x IN ('1-URGENT', '5-LOW')), ',') AS token FROM customer LEFT JOIN own ON user_id = c_custkey""",
)
def permissions(spark, sf_dir):
    """AG18, ST3: a user's rights over all roles, and what a token leaves of them."""
    held = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    none = F.array().cast("array<string>")
    own = F.when(F.col("c_acctbal") < 0, none).otherwise(F.coalesce("p", none))
    rows = table(spark, sf_dir, "customer").join(held, "c_custkey", "left").select(F.col("c_custkey").alias("user_id"), own.alias("own"))
    token = F.array_intersect("own", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    return rows.select("user_id", F.array_join("own", ",").alias("permissions"), F.array_join(token, ",").alias("token"))


@query(
    "vr10_policies",
    f"""WITH {VERSIONS_SQL} SELECT document, count(*) FILTER (status = 'published' AND effective <= DATE '1996-06-30') AS published, count(*) FILTER (status = 'published' AND effective > DATE '1996-06-30') AS scheduled,
      count(*) FILTER (status = 'draft') AS drafts, max(effective) AS last_change FROM versions GROUP BY document""",
)
def policies(spark, sf_dir):
    """VR10: versions of each document by state."""
    before, published = F.col("effective") <= F.lit("1996-06-30").cast("date"), F.col("status") == "published"
    return versions(spark, sf_dir).groupBy("document").agg(
        F.count_if(published & before).alias("published"), F.count_if(published & ~before).alias("scheduled"),
        F.count_if(F.col("status") == "draft").alias("drafts"), F.max("effective").alias("last_change"),
    )


@query(
    "snk4_upserted_vectors",
    "SELECT vec_id, label + CASE WHEN vec_id % 4 = 0 THEN 100 ELSE 0 END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 100 + label FROM embeddings WHERE vec_id % 40 = 0",
)
def upserted_vectors(spark, sf_dir):
    """SNK4: new rows take the place of old ones of their key."""
    old = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = old.where("vec_id % 4 = 0").withColumn("label", F.col("label") + 100)
    more = old.where("vec_id % 40 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), (F.col("label") + 100).alias("label"))
    both = old.withColumn("turn", F.lit(0)).union(new.union(more).withColumn("turn", F.lit(1)))
    return both.groupBy("vec_id").agg(F.max_by("label", "turn").alias("label"))


@query(
    "sc18_words_of_documents",
    r"SELECT source, lang, sum(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS words, count(*) AS clauses FROM documents GROUP BY source, lang",
)
def words_of_documents(spark, sf_dir):
    """SC18: clauses and words by source and language."""
    counted = table(spark, sf_dir, "documents").select("source", "lang", F.size(rt.tokens(F.col("text"))).alias("n"))
    return counted.groupBy("source", "lang").agg(F.sum("n").alias("words"), F.count("*").alias("clauses"))
