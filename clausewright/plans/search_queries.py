"""Search over a stored index: texts are added once, then every benchmark item asked in one call."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.operators import hybrid
from clausewright.operators import search_index as si
from clausewright.plans.catalog import query
from clausewright.plans.clause_queries import _CORPUS, DAY, _corpus, _editions
from clausewright.session import scratch, table

PACKS = [f"src{i}" for i in range(10) if i != 3]
_FOLD = f"translate(lower({{0}}), '{si._ACCENTS}', '{si._PLAIN}')"
_TERMS = rf"CASE WHEN {{1}} IN ('de', 'es', 'fr') THEN regexp_extract_all({_FOLD}, '[\p{{{{L}}}}\p{{{{N}}}}]+') ELSE regexp_extract_all(lower({{0}}), '[\p{{{{L}}}}\p{{{{N}}}}]+') END"
_QUESTIONS = "questions AS (SELECT item_id AS qid, text, CASE item_id % 5 WHEN 1 THEN 'es' WHEN 2 THEN 'fr' WHEN 3 THEN 'de' ELSE 'en' END AS lang, embedding AS vector FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"


def _terms(text: str, lang: str) -> str:
    return _TERMS.format(text, lang)


_INDEXED = f"""{_CORPUS}, {_QUESTIONS}, asked AS (SELECT DISTINCT qid, lang, unnest({_terms("text", "lang")}) AS term FROM questions),
bodies AS (SELECT text_id, lang, {_terms("'Article ' || (text_id // 2) || ' ' || body", "lang")} AS words FROM corpus WHERE length(trim(body)) > 0),
stats AS (SELECT lang, count(*) AS n, avg(len(words)) AS mean_words FROM bodies GROUP BY lang),
tf AS (SELECT text_id, lang, term, n_words, count(*) AS tf FROM (SELECT text_id, lang, len(words) AS n_words, unnest(words) AS term FROM bodies) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT qid, text_id, lang, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * n_words / mean_words))), 6) AS score
  FROM tf JOIN df USING (lang, term) JOIN asked USING (lang, term) JOIN stats USING (lang) GROUP BY ALL)"""
_READABLE = f"""readable AS (SELECT *, CASE WHEN kind = 'policy' THEN '' ELSE pack END AS source FROM corpus WHERE version = 2 AND NOT pending AND NOT coalesce(applies_until <= DATE '{DAY}', false) AND length(trim(body)) > 0
  AND ((kind = 'law' AND pack IN ({", ".join(f"'{p}'" for p in PACKS)})) OR kind = 'policy'))"""


def indexed_texts(spark, sf_dir):
    """documents as texts of clauses, with headings."""
    heading = F.concat(F.lit("Article "), F.floor(F.col("text_id") / 2).cast("string"))
    return _corpus(spark, sf_dir).withColumns({"heading": heading, "source": F.col("pack")})


def built_index(spark, sf_dir) -> si.Index:
    """The index of all texts; what it is asked reads the index, not the texts."""
    index = si.Index(spark, scratch(spark, "keyword-index"))
    index.add(indexed_texts(spark, sf_dir))
    return index


def _asked(spark, sf_dir):
    i = F.col("item_id") % 5
    lang = F.when(i == 1, "es").when(i == 2, "fr").when(i == 3, "de").when(i == 0, "en")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left").select(F.col("item_id").alias("qid"), "text", lang.alias("lang"), "vector")


@query(
    "rt2_stored_index",
    f"""WITH {_INDEXED} SELECT qid, pack AS source, text_id, score FROM bm JOIN corpus USING (text_id) WHERE text_id % 11 <> 0
    QUALIFY row_number() OVER (PARTITION BY qid, pack ORDER BY score DESC, text_id) <= 3""",
)
def stored_index(spark, sf_dir):
    """RT1, RT2: the three best texts of each source by a stored index, headings included, each language analysed in its own way."""
    questions = _asked(spark, sf_dir).withColumn("lang", F.coalesce("lang", F.lit("en")))
    among = indexed_texts(spark, sf_dir).where("text_id % 11 <> 0")
    found, _ = built_index(spark, sf_dir).search(questions, 3, among)
    return found.select("qid", "source", "text_id", "score")


_HYBRID = f"""WITH {_INDEXED}, {_READABLE},
kw_rows AS (SELECT qid, source, key, score FROM bm JOIN readable USING (text_id, lang) QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, text_id) <= 100),
kw AS (SELECT qid, source, key, max(score) AS score, row_number() OVER (PARTITION BY qid, source ORDER BY max(score) DESC, key) AS rank FROM kw_rows GROUP BY qid, source, key),
qv AS (SELECT qid, CAST(vector AS DOUBLE[]) AS q FROM questions WHERE vector IS NOT NULL),
tv AS (SELECT source, key, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN readable ON vec_id = text_id),
av AS (SELECT DISTINCT r.source, r.key, e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e JOIN corpus c ON c.text_id = e.vec_id + 1 JOIN readable r ON r.key = c.key WHERE e.vec_id % 3 = 0 AND r.source <> ''),
me_rows AS (SELECT qid, source, key, id, round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) AS score FROM tv, qv QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, id) <= 100),
me AS (SELECT qid, source, key, max(score) AS score, row_number() OVER (PARTITION BY qid, source ORDER BY max(score) DESC, key) AS rank FROM me_rows GROUP BY qid, source, key),
ne_rows AS (SELECT qid, source, key, round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) AS score FROM av, qv QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, key) <= 100),
ne AS (SELECT qid, source, key, max(score) AS score, row_number() OVER (PARTITION BY qid, source ORDER BY max(score) DESC, key) AS rank FROM ne_rows GROUP BY qid, source, key),
strong AS (SELECT 'meaning' AS retriever, * FROM me UNION ALL SELECT 'questions', * FROM ne),
z AS (SELECT *, CASE WHEN min(score) OVER w = max(score) OVER w THEN 0e0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END AS z FROM strong WINDOW w AS (PARTITION BY qid, source, retriever)),
blended AS (SELECT qid, source, key, CASE WHEN (SELECT count(*) FROM ne WHERE ne.qid = z.qid AND ne.source = z.source) > 0 THEN round(max(z), 5) ELSE max(score) FILTER (retriever = 'meaning') END AS score FROM z GROUP BY qid, source, key),
lists AS (SELECT 'keyword' AS retriever, qid, source, key, score FROM kw UNION ALL SELECT 'meaning', qid, source, key, score FROM blended),
spread AS (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high FROM lists WINDOW w AS (PARTITION BY qid, source, retriever)),
fused AS (SELECT qid, source, key, round(sum(CASE WHEN high = low THEN 1e0 ELSE (score - low) / (high - low) END * 0.5e0), 6) AS score FROM spread GROUP BY ALL),
strength AS (SELECT qid, source, max(score) AS strength FROM strong GROUP BY ALL),
normative AS (SELECT key, max(is_normative) AS is_normative FROM readable GROUP BY key),
cand AS (SELECT f.*, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, key) AS rank, coalesce(strength, 0) AS strength, source = '' AS is_policy, is_normative FROM fused f LEFT JOIN strength USING (qid, source) JOIN normative USING (key)),
turned AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY strength DESC, is_policy, source) AS s FROM cand),
taken AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, s) AS slot FROM turned QUALIFY slot <= 15),
a AS (SELECT qid, source, slot, row_number() OVER (PARTITION BY qid, source ORDER BY slot) AS n FROM taken),
b AS (SELECT qid, source, key, score, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, is_normative DESC, rank) AS n FROM taken),
result AS (SELECT qid, slot, source, key, score FROM a JOIN b USING (qid, source, n) WHERE slot <= 10),
nodes AS (SELECT DISTINCT key, pack || ':ch-' || (text_id // 2 // 10) AS parent, text_id // 2 AS place FROM corpus WHERE version = 2),
near AS (SELECT n.key, string_agg(o.key, ' ' ORDER BY o.place, o.key) AS around FROM nodes n JOIN nodes o ON o.parent = n.parent AND o.key <> n.key GROUP BY n.key)
SELECT qid, slot, nullif(r.source, '') AS source, r.key, r.score, kw.rank AS keyword_rank, me.rank AS meaning_rank, ne.rank AS questions_rank, coalesce(around, '') AS around
FROM result r LEFT JOIN kw USING (qid, source, key) LEFT JOIN me USING (qid, source, key) LEFT JOIN ne USING (qid, source, key) LEFT JOIN near USING (key)"""


@query("rt14_search", _HYBRID)
def search(spark, sf_dir):
    """RT1, RT2, RT10, RT13, RT14: language, scope, day, questions and what stands beside a match, for every benchmark item in one call."""
    texts, vectors = indexed_texts(spark, sf_dir), table(spark, sf_dir, "embeddings")
    of_text = vectors.select(F.col("vec_id").alias("text_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("vec_id % 3 = 0").join(texts, F.col("text_id") == F.col("vec_id") + 1).select("key", F.col("embedding").alias("vector"))
    place = F.floor(F.col("text_id") / 2)
    parent = F.concat("pack", F.lit(":ch-"), F.floor(place / 10).cast("string"))
    nodes = texts.where("version = 2").select("key", parent.alias("parent"), place.alias("place")).distinct()
    found, _ = hybrid.hybrid_search(
        _asked(spark, sf_dir), built_index(spark, sf_dir), of_text, texts, _editions(spark, sf_dir), nodes, DAY, today=DAY, packs=PACKS, asked=asked, expand="siblings"
    )
    return found.select("qid", "slot", "source", "key", "score", "ranks.*", F.array_join("around", " ").alias("around"))
