"""The corpus as readers see it, on documents, orders, lineitem and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.operators import corpus as cp
from clausewright.operators import retrieval as rt
from clausewright.plans.bindings import TEXTS_SQL, texts
from clausewright.plans.catalog import query
from clausewright.plans.retrieval_queries import _WORDS
from clausewright.session import table

DAY = "1996-06-30"
_CORPUS = """corpus AS (SELECT doc_id AS text_id, source || ':art-' || CAST(doc_id // 2 AS VARCHAR) AS key, source AS pack, CASE source WHEN 'src3' THEN 'policy' ELSE 'law' END AS kind,
  doc_id % 3 + 1 AS version, lang, text AS body, doc_id % 4 <> 0 AS is_normative, doc_id % 11 = 0 AS pending, CAST(DATE '1995-01-01' + CAST(doc_id % 900 AS INTEGER) AS DATE) AS applies_from,
  CAST(CASE WHEN doc_id % 5 = 0 THEN DATE '1995-01-01' + CAST(doc_id % 900 + 200 AS INTEGER) END AS DATE) AS applies_until FROM documents)"""
_READABLE = f"""{_CORPUS}, readable AS (SELECT * FROM corpus WHERE version = 2 AND NOT pending AND NOT coalesce(applies_until <= DATE '{DAY}', false) AND length(trim(body)) > 0
  AND is_normative AND ((kind = 'law' AND pack IN ('src0', 'src1', 'src2')) OR kind = 'policy'))"""


def _corpus(spark, sf_dir):
    i = F.col("doc_id")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (i % 900).cast("int"))
    return table(spark, sf_dir, "documents").select(
        i.alias("text_id"), F.concat("source", F.lit(":art-"), F.floor(i / 2).cast("string")).alias("key"), F.col("source").alias("pack"),
        F.when(F.col("source") == "src3", "policy").otherwise("law").alias("kind"), (i % 3 + 1).alias("version"), "lang", F.col("text").alias("body"),
        (i % 4 != 0).alias("is_normative"), (i % 11 == 0).alias("pending"), start.alias("applies_from"), F.when(i % 5 == 0, F.date_add(start, 200)).alias("applies_until"),
    )


def _editions(spark, sf_dir):
    packs = table(spark, sf_dir, "documents").select(F.col("source").alias("document")).distinct()
    rows = packs.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    day = F.date_add(F.lit("1995-06-01").cast("date"), ((F.col("version") - 1) * 300).cast("int"))
    return rows.withColumns({"number": F.col("version"), "status": F.lit("published"), "effective": day})


@query(
    "rt1_search_in_force",
    f"""WITH {_READABLE}, asked AS (SELECT DISTINCT item_id AS qid, unnest({_WORDS.format("text")}) AS term FROM benchmark),
    bodies AS (SELECT text_id, {_WORDS.format("body")} AS words FROM corpus WHERE length(trim(body)) > 0), stats AS (SELECT count(*) AS n, avg(len(words)) AS mean_words FROM bodies),
    tf AS (SELECT text_id, term, n_words, count(*) AS tf FROM (SELECT text_id, len(words) AS n_words, unnest(words) AS term FROM bodies) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    bm AS (SELECT qid, text_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * n_words / mean_words))), 6) AS score
      FROM tf JOIN df USING (term) JOIN asked USING (term), stats WHERE text_id IN (SELECT text_id FROM readable) GROUP BY qid, text_id),
    top AS (SELECT qid, key, lang, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key, lang) AS at_ FROM bm JOIN readable USING (text_id) QUALIFY at_ <= 100),
    one AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY at_) = 1)
    SELECT qid, key, lang, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM one""",
)
def search_in_force(spark, sf_dir):
    """RT1, RT12, FIL6, FIL7, JN1, WN1: only texts in force, not ended, in scope and normative are ranked; one row a key."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return cp.search(questions, _corpus(spark, sf_dir), _editions(spark, sf_dir), DAY, packs=["src0", "src1", "src2"], normative_only=True)


_ASKED = "asked AS (SELECT source || ':art-' || CAST(doc_id AS VARCHAR) AS key, lang, 'what of ' || source AS questions, doc_id % 3 <> 1 AS current FROM documents)"


@query(
    "jn3_keyword_texts",
    f"""WITH {_CORPUS}, {_ASKED}, now AS (SELECT * FROM asked WHERE current), worded AS (SELECT * FROM corpus WHERE length(trim(body)) > 0)
    SELECT w.key, w.lang, md5(concat_ws(' ', body, questions)) AS words FROM worded w LEFT JOIN now a ON a.key = w.key AND a.lang = w.lang AND NOT pending AND applies_from <= DATE '{DAY}' AND (applies_until IS NULL OR applies_until > DATE '{DAY}')
    UNION ALL SELECT key, lang, md5(questions) FROM now a WHERE NOT EXISTS (SELECT 1 FROM worded w WHERE w.key = a.key AND w.lang = a.lang)""",
)
def keyword_texts(spark, sf_dir):
    """JN3, SNK5, AG10: texts with their questions where they apply, questions alone where there is no text."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.select(
        F.concat("source", F.lit(":art-"), F.col("doc_id").cast("string")).alias("key"), "lang", F.concat(F.lit("what of "), "source").alias("questions"), (F.col("doc_id") % 3 != 1).alias("current")
    )
    return cp.keyword_texts(_corpus(spark, sf_dir), asked, DAY).select("key", "lang", F.md5("words").alias("words"))


_NOW = r"""now AS (SELECT key, substr(sha256(string_agg(lang || chr(10) || trim(regexp_replace(body, '[ \t\n\r]+', ' ', 'g')), chr(10) ORDER BY lang, trim(regexp_replace(body, '[ \t\n\r]+', ' ', 'g')))), 1, 16) AS now FROM corpus GROUP BY key)"""


@query(
    "rt18_current_marks",
    f"""WITH {_CORPUS}, {_NOW}, stored AS (SELECT key, CASE WHEN length(now) > 0 AND ascii(substr(now, 1, 1)) % 2 = 0 THEN now ELSE 'stale' END AS fingerprint FROM now)
    SELECT key, fingerprint, fingerprint = now AS current FROM stored JOIN now USING (key)""",
)
def current_marks(spark, sf_dir):
    """RT18, RT17: which stored fingerprints are those of the texts now."""
    rows = _corpus(spark, sf_dir)
    stored = rows.groupBy("key").agg(rt.fingerprint(F.col("lang"), F.col("body")).alias("f"))
    stored = stored.select("key", F.when(F.ascii(F.substring("f", 1, 1)) % 2 == 0, F.col("f")).otherwise("stale").alias("fingerprint"))
    return cp.marked_current(stored, rows)


@query(
    "fil12_scope_problems",
    """WITH asked AS (SELECT DISTINCT c_mktsegment AS slug FROM customer), loaded AS (SELECT DISTINCT c_mktsegment AS slug FROM customer WHERE c_mktsegment <> 'MACHINERY'), selected AS (SELECT DISTINCT c_mktsegment AS slug FROM customer WHERE c_mktsegment < 'C')
    SELECT slug, CASE WHEN slug NOT IN (SELECT slug FROM loaded) THEN 'unknown' ELSE 'not_selected' END AS problem FROM asked WHERE slug NOT IN (SELECT slug FROM loaded) OR slug NOT IN (SELECT slug FROM selected)""",
)
def scope_problems(spark, sf_dir):
    """FIL12: laws that can't be searched, and why."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("slug"))
    return cp.scope_problems(asked, asked.where("slug <> 'MACHINERY'"), asked.where("slug < 'C'"))


@query(
    "fil13_newly_arrived",
    """SELECT o_orderkey AS slug, o_orderdate AS loaded_at FROM orders WHERE o_orderdate > greatest((SELECT min(o_orderdate + INTERVAL 400 DAY) FROM orders WHERE o_orderkey % 9 = 0), TIMESTAMP '1998-01-01' - INTERVAL 30 DAY)""",
)
def newly_arrived(spark, sf_dir):
    """FIL13: loaded since the first selection and lately."""
    chosen = F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderdate") + F.expr("interval 400 days"))
    return cp.newly_arrived(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), F.col("o_orderdate").alias("loaded_at"), chosen.alias("selected_at")), "1998-01-01")


_NAMES = "names AS (SELECT DISTINCT source AS pack, lang, source || '/' || lang AS title FROM documents WHERE NOT (source = 'src1' AND lang IN ('fr', 'en')) AND NOT (source = 'src2' AND lang = 'fr'))"


def _names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("pack"), "lang", F.concat_ws("/", "source", "lang").alias("title")).distinct()
    return rows.where("not (pack = 'src1' and lang in ('fr', 'en')) and not (pack = 'src2' and lang = 'fr')")


def _labelled(spark, sf_dir):
    number = (F.col("text_id") % 7).cast("string")
    return _corpus(spark, sf_dir).withColumns({"label": F.when(F.col("text_id") % 3 == 0, F.concat(F.lit("Rule "), number)), "node_label": F.concat(F.lit("Article "), number)})


_TITLES = f"{_NAMES}, titled AS (SELECT pack, title FROM names QUALIFY row_number() OVER (PARTITION BY pack ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, lang) = 1)"
_LABEL = "coalesce(CASE WHEN text_id % 3 = 0 THEN 'Rule ' || (text_id % 7) END, 'Article ' || (text_id % 7))"


@query("prj1_clause_views", f"WITH {_CORPUS}, {_TITLES} SELECT text_id, {_LABEL} AS label, title, CASE WHEN NOT pending THEN applies_from END AS in_force_from FROM corpus LEFT JOIN titled USING (pack)")
def clause_views(spark, sf_dir):
    """PRJ1, JN6: label, name by language with its fallbacks, start."""
    return cp.views(_labelled(spark, sf_dir), _names(spark, sf_dir), "fr")


@query(
    "prj2_citations",
    f"""WITH {_CORPUS}, {_TITLES} SELECT text_id, concat_ws(', ', title, {_LABEL}) || ' (version ' || version || ')' AS citation,
    CASE WHEN pending THEN 'Not in force yet, with no date set.' WHEN applies_from > DATE '{DAY}' THEN 'In force from ' || applies_from || '.' WHEN applies_until <= DATE '{DAY}' THEN 'No longer in force since ' || applies_until || '.'
      WHEN applies_until IS NOT NULL THEN 'In force until ' || applies_until || '.' ELSE 'In force.' END AS standing FROM corpus LEFT JOIN titled USING (pack)""",
)
def citations(spark, sf_dir):
    """PRJ2: how a clause is cited, and when it applies."""
    rows = _labelled(spark, sf_dir).join(cp.titles(_names(spark, sf_dir), "fr"), "pack", "left")
    cited = cp.citation(F.col("title"), F.coalesce("label", "node_label"), F.col("version"))
    return rows.select("text_id", cited.alias("citation"), cp.standing(DAY, F.col("applies_from"), F.col("applies_until"), F.col("pending")).alias("standing"))


@query("prj3_expiry", "SELECT event_id AS id, CAST(ts + INTERVAL 90 DAY AS DATE) AS expires_on FROM events")
def expiry(spark, sf_dir):
    """PRJ3: when retention ends."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_date(F.col("ts") + F.expr("interval 90 days")).alias("expires_on"))


@query(
    "jn13_named_results",
    f"""WITH {TEXTS_SQL} SELECT text_id, node, lang FROM texts WHERE (node, lang) IN (SELECT l_partkey, CASE WHEN l_quantity > 25 THEN 'en' ELSE 'fr' END FROM lineitem WHERE l_suppkey % 10 = 1)""",
)
def named_results(spark, sf_dir):
    """JN13: rows whose pair of columns is in a list."""
    lang = F.when(F.col("l_quantity") > 25, "en").otherwise("fr")
    wanted = table(spark, sf_dir, "lineitem").where("l_suppkey % 10 = 1").select(F.col("l_partkey").alias("node"), lang.alias("lang"))
    return texts(spark, sf_dir).join(wanted, ["node", "lang"], "left_semi").select("text_id", "node", "lang")


@query("ag11_document_summary", "SELECT source AS document, count(*) AS clauses, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents GROUP BY source")
def document_summary(spark, sf_dir):
    """AG11: clauses and languages of each document."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("document")).agg(F.count("*").alias("clauses"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


@query(
    "ag12_law_counts",
    """WITH c AS (SELECT n_regionkey AS law, n_name AS document, count(*) FILTER (s_suppkey % 3 <> 0) AS a, count(*) FILTER (s_suppkey % 3 = 0) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
    SELECT law, sum(a) AS articles, sum(r) AS recitals, first(document ORDER BY a DESC, document) AS main FROM c GROUP BY law""",
)
def law_counts(spark, sf_dir):
    """AG12: articles and recitals of each law, and its main document."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return cp.law_counts(rows.select(F.col("n_regionkey").alias("law"), F.col("n_name").alias("document"), F.when(F.col("s_suppkey") % 3 == 0, "recital").otherwise("article").alias("kind")))


@query(
    "ag13_index_status",
    "SELECT m.label AS model, count(v.vec_id) AS vectors, min(v.label % 3) AS recipe FROM (SELECT unnest(range(15)) AS label) m LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) v ON v.label = m.label GROUP BY m.label",
)
def index_status(spark, sf_dir):
    """AG13: vectors of every model, none included."""
    vectors = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("label").cast("long").alias("model"), "vec_id")
    models = spark.range(15).withColumnRenamed("id", "model")
    return models.join(vectors, "model", "left").groupBy("model").agg(F.count("vec_id").alias("vectors"), F.min(F.when(F.col("vec_id").isNotNull(), F.col("model") % 3)).alias("recipe"))


@query("ag14_dominant_language", "SELECT source, lang FROM (SELECT source, lang, sum(n_chars) AS w FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY w DESC, lang) = 1")
def dominant_language(spark, sf_dir):
    """AG14: the language of most characters."""
    return cp.dominant(table(spark, sf_dir, "documents"), "source", "lang", "n_chars")


@query(
    "ag15_coverage",
    r"""WITH p AS (SELECT conv_id AS file, turn AS position, text, length(regexp_replace(text, '\s', '', 'g')) AS n, turn % 5 <> 3 AS c, turn % 7 = 2 AS s FROM conversations)
    SELECT file, sum(n) AS characters, sum(CASE WHEN c THEN n ELSE 0 END) AS in_clauses, sum(CASE WHEN s THEN n ELSE 0 END) AS set_aside, count(*) FILTER (CAST(c AS INTEGER) + CAST(s AS INTEGER) <> 1) AS gaps FROM p GROUP BY file""",
)
def coverage(spark, sf_dir):
    """AG15, PL6: what of a file is in clauses or set aside, and what isn't there exactly once."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("position"), "text").dropDuplicates(["file", "position"])
    uses = rows.where("position % 5 <> 3").select("file", "position", F.lit("clause").alias("place")).union(rows.where("position % 7 = 2").select("file", "position", F.lit("aside")))
    return cp.coverage(rows, uses)


@query(
    "wn6_numbering_gaps",
    """WITH c AS (SELECT source AS parent, doc_id AS place, CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 13 = 0 THEN 1 ELSE doc_id // 5 - CAST(doc_id % 11 = 0 AS INTEGER) END AS number FROM documents),
    w AS (SELECT *, last_value(number IGNORE NULLS) OVER (PARTITION BY parent ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(number) OVER (PARTITION BY parent ORDER BY place) IS NULL AS broken FROM c)
    SELECT parent, place, CASE WHEN number = before THEN 'repeats' ELSE 'gap' END AS what FROM w WHERE number IS NOT NULL AND before IS NOT NULL AND number <> before + 1 AND NOT (broken AND number = 1)""",
)
def numbering_gaps(spark, sf_dir):
    """WN6, PL6: numbers that don't follow one another."""
    i = F.col("doc_id")
    n = F.when(i % 7 == 3, None).when(i % 13 == 0, 1).otherwise(F.floor(i / 5) - (i % 11 == 0).cast("int"))
    return cp.numbering_gaps(table(spark, sf_dir, "documents").select(F.col("source").alias("parent"), i.alias("place"), n.alias("number")))


@query(
    "tr6_outline",
    """SELECT r_regionkey AS id, r_regionkey AS place, CASE WHEN r_regionkey % 2 = 0 THEN 'fr ' || r_name ELSE r_name END AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS children FROM region""",
)
def outline(spark, sf_dir):
    """TR6: the top level, its names by language or else the source's, and what lies below."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = region.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_regionkey").alias("place"))
    below = nation.select((F.col("n_nationkey") + 100).cast("long"), F.col("n_regionkey").cast("long"), "n_nationkey")
    names = region.select(F.col("r_regionkey").cast("long").alias("id"), F.lit("en").alias("lang"), F.col("r_name").alias("name"), F.lit(True).alias("is_authoritative"))
    more = region.where("r_regionkey % 2 = 0").select(F.col("r_regionkey").cast("long"), F.lit("fr"), F.concat(F.lit("fr "), "r_name"), F.lit(False))
    return cp.outline(top.union(below), names.union(more), "fr")


@query(
    "pl8_file_as_read",
    """WITH l AS (SELECT doc_id AS file, unnest(string_split(text, '. ')) AS text, unnest(range(1, len(string_split(text, '. ')) + 1)) AS position FROM documents),
    n AS (SELECT doc_id AS file, len(string_split(text, '. ')) AS n FROM documents),
    c AS (SELECT l.file, position, 'ch-' || ((position - 1) // 10) AS key, 1 AS depth, (position - 1) // 10 AS place FROM l WHERE (position - 1) // 10 % 3 <> 2
      UNION ALL SELECT l.file, position, 'para-' || (position // 7), 2, position // 7 FROM l WHERE position % 7 < 2 AND position >= 7),
    g AS (SELECT file, position, list(key ORDER BY depth, place, key) AS keys FROM c GROUP BY ALL)
    SELECT l.file, l.position, md5(l.text) AS text, keys[1] AS clause, coalesce(array_to_string(keys, ','), '') AS clauses, CASE WHEN (l.position - 1) // 10 % 3 = 2 AND l.position % 4 = 0 THEN 'contents' END AS set_aside
    FROM l LEFT JOIN g USING (file, position) WHERE length(regexp_replace(l.text, '\\s', '', 'g')) > 0""",
)
def file_as_read(spark, sf_dir):
    """PL8: every line of a file in order, with the clauses it went to or why it was set aside."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.split("text", r"\. ").alias("parts")).where("parts is not null")
    lines = docs.select("file", F.posexplode("parts").alias("p", "text")).select("file", (F.col("p") + 1).alias("position"), "text")
    at = F.sequence(F.lit(1), F.size("parts"))
    spans = lambda name, depth, group, test: docs.select("file", F.explode(F.filter(at, test)).alias("position")).groupBy("file", group.alias("place")).agg(F.collect_list("position").alias("positions")).select("file", F.concat(F.lit(name), F.col("place").cast("string")).alias("key"), F.lit(depth).alias("depth"), "place", "positions")
    tens = F.floor((F.col("position") - 1) / 10)
    chapters = spans("ch-", 1, tens, lambda p: F.floor((p - 1) / 10) % 3 != 2)
    paragraphs = spans("para-", 2, F.floor(F.col("position") / 7), lambda p: (p % 7 < 2) & (p >= 7))
    aside = docs.select("file", F.filter(at, lambda p: (F.floor((p - 1) / 10) % 3 == 2) & (p % 4 == 0)).alias("positions"), F.lit("contents").alias("reason"))
    return cp.file_as_read(lines, chapters.unionByName(paragraphs), aside).select("file", "position", F.md5("text").alias("text"), "clause", F.array_join("clauses", ",").alias("clauses"), "set_aside")
