"""Retrieval on documents (clauses), embeddings (vectors) and benchmark items (questions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.operators import retrieval as rt
from clausewright.plans.catalog import query
from clausewright.session import table

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_KEYWORD = f"""asked AS (SELECT DISTINCT item_id AS qid, unnest({_WORDS.format("text")}) AS term FROM benchmark),
bodies AS (SELECT doc_id AS key, lang, source, {_WORDS.format("text")} AS words FROM documents WHERE length(trim(text)) > 0),
stats AS (SELECT count(*) AS n, avg(len(words)) AS mean_words FROM bodies),
tf AS (SELECT key, term, n_words, count(*) AS tf FROM (SELECT key, len(words) AS n_words, unnest(words) AS term FROM bodies) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT qid, key, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * n_words / mean_words))), 6) AS score
       FROM tf JOIN df USING (term) JOIN asked USING (term), stats GROUP BY qid, key),
kw AS (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM bm QUALIFY rank <= 100)"""
_MEANING = """vecs AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
qvecs AS (SELECT item_id AS qid, v AS q FROM benchmark JOIN vecs ON key = item_id),
cos AS (SELECT qid, key, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: q[i] * v[i]))
          / (sqrt(list_sum(list_transform(q, lambda x: x * x))) * sqrt(list_sum(list_transform(v, lambda x: x * x)))), 6) AS score FROM vecs, qvecs),
me AS (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM cos QUALIFY rank <= 100)"""
_LISTS = f"{_KEYWORD}, {_MEANING}, lists AS (SELECT 'keyword' AS retriever, * FROM kw UNION ALL SELECT 'meaning', * FROM me)"
_SPREAD = """spread AS (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS sd
  FROM lists WINDOW w AS (PARTITION BY qid, retriever))"""
_CONVEX = f"""{_SPREAD}, fused AS (SELECT qid, key, round(sum(CASE WHEN high = low THEN 1e0 ELSE (score - low) / (high - low) END * 0.5e0), 6) AS score
  FROM spread GROUP BY qid, key)"""
_TOP = "SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM {} QUALIFY rank <= {}"


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _clauses(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("body"), "lang", "source")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")


def _question_vectors(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return items.join(_vectors(spark, sf_dir), F.col("qid") == F.col("key")).select("qid", "vector")


def _keyword(spark, sf_dir):
    return rt.keyword_search(_questions(spark, sf_dir), _clauses(spark, sf_dir))


def _meaning(spark, sf_dir):
    return rt.meaning_search(_question_vectors(spark, sf_dir), _vectors(spark, sf_dir))


def _lists(spark, sf_dir):
    label = lambda df, name: df.select(F.lit(name).alias("retriever"), "qid", "key", "score", "rank")
    return label(_keyword(spark, sf_dir), "keyword").union(label(_meaning(spark, sf_dir), "meaning"))


@query("rt1_bm25", f"WITH {_KEYWORD} SELECT qid, key, score, rank FROM kw WHERE rank <= 10")
def bm25(spark, sf_dir):
    """RT1, FIL8, FIL9, WN1: keyword ranking of every benchmark item."""
    return _keyword(spark, sf_dir).where("rank <= 10")


@query(
    "rt2_bm25_by_language",
    f"""WITH asked AS (SELECT DISTINCT item_id AS qid, lang, unnest({_WORDS.format("text")}) AS term FROM benchmark, (SELECT DISTINCT lang FROM documents)),
    bodies AS (SELECT doc_id AS key, lang, {_WORDS.format("text")} AS words FROM documents WHERE length(trim(text)) > 0),
    stats AS (SELECT lang, count(*) AS n, avg(len(words)) AS mean_words FROM bodies GROUP BY lang),
    tf AS (SELECT key, lang, term, n_words, count(*) AS tf FROM (SELECT key, lang, len(words) AS n_words, unnest(words) AS term FROM bodies) GROUP BY ALL),
    df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL),
    bm AS (SELECT qid, lang, key, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * n_words / mean_words))), 6) AS score
           FROM tf JOIN df USING (lang, term) JOIN asked USING (lang, term) JOIN stats USING (lang) GROUP BY ALL)
    SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM bm QUALIFY rank <= 10""",
)
def bm25_by_language(spark, sf_dir):
    """RT2: an index, with its own statistics, per language."""
    clauses = _clauses(spark, sf_dir)
    asked = _questions(spark, sf_dir).crossJoin(clauses.select("lang").distinct())
    return rt.keyword_search(asked, clauses, 10, by_index=True)


@query("rt3_cosine", f"WITH {_MEANING} SELECT qid, key, score, rank FROM me WHERE rank <= 10")
def cosine(spark, sf_dir):
    """RT3, JN10, SC13: exact cosine ranking."""
    return _meaning(spark, sf_dir).where("rank <= 10")


@query(
    "rt4_nearest_question_per_key",
    f"""WITH {_MEANING}, best AS (SELECT qid, label AS key, max(score) AS score FROM cos JOIN embeddings ON vec_id = key GROUP BY ALL)
    {_TOP.format("best", 100)}""",
)
def nearest_question_per_key(spark, sf_dir):
    """RT4: labels as keys, vectors as their questions."""
    asked = _vectors(spark, sf_dir).select(F.col("label").alias("key"), "vector")
    return rt.nearest_question(_question_vectors(spark, sf_dir), asked)


@query(
    "rt5_blend_questions",
    f"""WITH {_MEANING}, half AS (SELECT 'meaning' AS retriever, * FROM me UNION ALL
      SELECT 'questions', qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM cos WHERE key % 3 = 0 QUALIFY rank <= 100),
    lists AS (SELECT * FROM half), {_SPREAD},
    best AS (SELECT qid, key, round(max(CASE WHEN high = low THEN 0e0 ELSE (score - mean) / sd END), 5) AS score FROM spread GROUP BY ALL)
    {_TOP.format("best", 1000000)}""",
)
def blend_questions(spark, sf_dir):
    """RT5, WN4: z-scores, the greater one of each key."""
    questions, vectors = _question_vectors(spark, sf_dir), _vectors(spark, sf_dir)
    asked = rt.meaning_search(questions, vectors.where("key % 3 = 0"))
    return rt.with_questions(rt.meaning_search(questions, vectors), asked)


@query("rt6_fuse_rrf", f"WITH {_LISTS}, fused AS (SELECT qid, key, round(sum(1e0 / (10 + rank)), 9) AS score FROM lists GROUP BY ALL) {_TOP.format('fused', 20)}")
def fuse_rrf(spark, sf_dir):
    """RT6: reciprocal ranks."""
    return rt.ranked(rt.fusion("rrf:10")(_lists(spark, sf_dir)), 20)


@query("rt7_fuse_convex", f"WITH {_LISTS}, {_CONVEX} {_TOP.format('fused', 20)}")
def fuse_convex(spark, sf_dir):
    """RT7, WN3: min-max, convex."""
    return rt.ranked(rt.fusion("convex")(_lists(spark, sf_dir)), 20)


@query(
    "rt8_fuse_standardised",
    f"""WITH {_LISTS}, {_SPREAD}, z AS (SELECT qid, retriever, key, CASE WHEN high = low THEN 0e0 ELSE (score - mean) / sd END AS z FROM spread),
    floors AS (SELECT qid, coalesce(min(z) FILTER (retriever = 'keyword'), 0) AS kf, coalesce(min(z) FILTER (retriever = 'meaning'), 0) AS mf FROM z GROUP BY qid),
    both_lists AS (SELECT qid, key, max(z) FILTER (retriever = 'keyword') AS k, max(z) FILTER (retriever = 'meaning') AS m FROM z GROUP BY ALL)
    SELECT qid, key, round(0.3e0 * coalesce(k, kf) + 0.7e0 * coalesce(m, mf), 5) AS score FROM both_lists JOIN floors USING (qid)""",
)
def fuse_standardised(spark, sf_dir):
    """RT8: z-scores, floors for what a list lacks."""
    return rt.fusion("standardised:0.3")(_lists(spark, sf_dir))


@query("rt14_hybrid_search", f"WITH {_LISTS}, {_CONVEX} {_TOP.format('fused', 10)}")
def hybrid_search(spark, sf_dir):
    """RT14, SO4: keyword and meaning candidates, convex fusion, the ten best of every question."""
    return rt.ranked(rt.convex(_lists(spark, sf_dir)), 10)


@query(
    "rt11_sources_in_turns",
    f"""WITH {_KEYWORD}, cand AS (
      SELECT qid, source, key, score, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, key) AS rank, max(score) OVER (PARTITION BY qid, source) AS strength,
             source = 'src3' AS is_policy, key % 4 <> 0 AS is_normative FROM kw JOIN documents ON doc_id = key),
    turned AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY strength DESC, is_policy, source) AS s FROM cand),
    taken AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, s) AS slot FROM turned QUALIFY slot <= 15),
    a AS (SELECT qid, source, slot, row_number() OVER (PARTITION BY qid, source ORDER BY slot) AS n FROM taken),
    b AS (SELECT qid, source, key, score, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, is_normative DESC, rank) AS n FROM taken)
    SELECT qid, slot, source, key, score FROM a JOIN b USING (qid, source, n) WHERE slot <= 10""",
)
def sources_in_turns(spark, sf_dir):
    """RT11: round-robin over sources, normative first on ties."""
    found = _keyword(spark, sf_dir).drop("rank").join(_clauses(spark, sf_dir).select("key", "source"), "key")
    found = rt.ranked(found, 1 << 30, "source")
    strength = found.groupBy("qid", "source").agg(F.max("score").alias("strength"))
    found = found.join(strength, ["qid", "source"]).withColumn("is_policy", F.col("source") == "src3").withColumn("is_normative", F.col("key") % 4 != 0)
    return rt.in_turns(found, 10)


@query(
    "rt16_rerank_head",
    f"""WITH {_KEYWORD} SELECT qid, key, rank AS old_rank, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 25 THEN 0 ELSE 1 END,
      CASE WHEN rank <= 25 THEN (key * 7919) % 101 END DESC, rank) AS new_rank FROM kw""",
)
def rerank_head(spark, sf_dir):
    """RT16: a fresh score for the head, the tail behind it as it was."""
    return rt.rerank(_keyword(spark, sf_dir), (F.col("key") * 7919) % 101)


@query(
    "rt13_expand_siblings",
    "SELECT a.n_nationkey AS clause, b.n_nationkey AS sibling, r_name AS parent FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey",
)
def expand_siblings(spark, sf_dir):
    """RT13, JN7: parent and siblings of a clause."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    other = n.select(F.col("n_nationkey").alias("sibling"), F.col("n_regionkey").alias("r_regionkey"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(other, "r_regionkey").where("n_nationkey <> sibling").select(
        F.col("n_nationkey").alias("clause"), "sibling", F.col("r_name").alias("parent")
    )


@query(
    "rt15_language_by_script",
    r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[ء-ي]')) > len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) THEN 'ar' ELSE 'en' END AS script FROM documents
    UNION ALL SELECT * FROM (VALUES (-1, 'ar'), (-2, 'en'), (-3, 'en'))""",
)
def language_by_script(spark, sf_dir):
    """RT15: which script prevails."""
    literals = spark.createDataFrame([(-1, "ما هي العقوبة in law"), (-2, "law قانون law"), (-3, "12")], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").union(literals).select("doc_id", rt.language_of(F.col("text")).alias("script"))


@query(
    "rt17_fingerprints",
    r"""SELECT source, doc_id // 4 AS clause, substr(sha256(string_agg(lang || chr(10) || body, chr(10) ORDER BY lang, body)), 1, 16) AS fingerprint
    FROM (SELECT *, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS body FROM documents) GROUP BY ALL""",
)
def fingerprints(spark, sf_dir):
    """RT17, SC8, SC12: a clause's fingerprint over all its texts, in order of their languages."""
    clause = F.floor(F.col("doc_id") / 4).alias("clause")
    return table(spark, sf_dir, "documents").groupBy("source", clause).agg(rt.fingerprint(F.col("lang"), F.col("text")).alias("fingerprint"))


@query(
    "em3_unembedded",
    "SELECT lang, count(*) AS todo, (SELECT count(*) FROM embeddings) AS embedded FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) GROUP BY lang",
)
def unembedded(spark, sf_dir):
    """EM3, EM6, JN5: what a build would still embed."""
    vectors = table(spark, sf_dir, "embeddings")
    todo = table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("vec_id"), "left_anti").groupBy("lang").agg(F.count("*").alias("todo"))
    return todo.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("embedded"))))


@query(
    "em5_pooled_vectors",
    """WITH dims AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
    SELECT label, i AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM dims""",
)
def pooled_vectors(spark, sf_dir):
    """EM5: mean pooling and unit length, by label."""
    spread = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = spread.groupBy("label", (F.col("i") + 1).alias("dim")).agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("size"))
    return mean.join(size, "label").select("label", "dim", F.round(F.col("m") / F.col("size"), 6).alias("value"))


@query("em4_length_batches")
def length_batches(spark, sf_dir):
    """EM4: batches of like lengths under a budget of rows times longest squared; held to a plain loop by the tests."""
    length = F.least(F.col("n_chars") / 4, F.lit(512)).cast("long")
    return rt.batches(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), length.alias("length")))


@query(
    "em1_context_prefix",
    """SELECT c_custkey, CASE WHEN len(string_split(r_name || ' > ' || n_name || ' > ' || c_mktsegment, ' ')) > 6 THEN r_name || ' > ' || c_mktsegment
       ELSE r_name || ' > ' || n_name || ' > ' || c_mktsegment END || ': ' || c_name AS context
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def context_prefix(spark, sf_dir):
    """EM1, EM2: the trail of headings, the middle dropped while it is too long."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    long = F.concat_ws(" > ", "r_name", "n_name", "c_mktsegment")
    cut = F.when(F.size(F.split(long, " ")) > 6, F.concat_ws(" > ", "r_name", "c_mktsegment")).otherwise(long)
    return rows.select("c_custkey", F.concat(cut, F.lit(": "), F.col("c_name")).alias("context"))
