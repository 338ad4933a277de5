"""Files written and read back, on documents, parts, benchmark items, embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.plans.catalog import query
from clausewright.plans.corpus_queries import _governed
from clausewright.session import cut, scratch, table
from clausewright.sources import files, packs
from clausewright.sources.named_text import write_named

@query(
    "src2_clause_files",
    r"""WITH d AS (SELECT *, 'law:' || source || ':art-' || (doc_id // 4) AS top, trim(regexp_replace(text, '[ \t\x0B\f\r]+', ' ', 'g'), ' ' || chr(10)) AS body FROM documents),
    r AS (SELECT top, min(doc_id) AS one FROM d GROUP BY top)
    SELECT top AS key, NULL AS parent, 1 AS depth, 'No. ' || (one % 3) AS label, 'Scope: ' || one || ' "it" \ that' AS heading, md5('# not a heading' || chr(10) || '---' || chr(10) || '\# nor this') AS body, CASE WHEN one % 2 = 0 THEN 'no' ELSE 'en' END AS lang, one % 5 <> 0 AS normative FROM r
    UNION ALL SELECT d.top || ':para-' || doc_id, d.top, 2, doc_id || '.', NULL, md5(CASE WHEN doc_id % 2 = 0 THEN '## ' ELSE '' END || body), CASE WHEN one % 2 = 0 THEN 'no' ELSE 'en' END, one % 5 <> 0 FROM d JOIN r ON r.top = d.top""",
)
def clause_files(spark, sf_dir):
    """SRC2, SNK11: clauses written as Markdown, one file an article, and read back as they were: lines, marks, quotes and all."""
    top = F.concat(F.lit("law:"), "source", F.lit(":art-"), F.floor(F.col("doc_id") / 4).cast("string"))
    body = F.trim(F.regexp_replace("text", r"[ \t\x0B\f\r]+", " "), F.lit(" \n"))
    docs = table(spark, sf_dir, "documents").select(top.alias("top"), "doc_id", body.alias("body"))
    roots = docs.groupBy("top").agg(F.min("doc_id").alias("one"))
    i, one = F.col("doc_id").cast("string"), F.col("one")
    named = lambda df, key, place, depth, label, heading, text: df.select(
        F.replace("top", F.lit(":"), F.lit("_")).alias("file"), key.alias("key"), place.cast("int").alias("place"), F.lit(depth).alias("depth"), label.alias("label"), heading.cast("string").alias("heading"),
        text.alias("body"), F.when(one % 2 == 0, "no").otherwise("en").alias("lang"), (one % 5 != 0).alias("normative"),
    )
    title = F.concat(F.lit("Scope: "), one.cast("string"), F.lit(' "it" \\ that'))
    above = named(roots, F.col("top"), F.lit(0), 1, F.concat(F.lit("No. "), (one % 3).cast("string")), title, F.lit("# not a heading\n---\n\\# nor this"))
    marked = F.concat(F.when(F.col("doc_id") % 2 == 0, "## ").otherwise(""), "body")
    below = named(docs.join(roots, "top"), F.concat("top", F.lit(":para-"), i), F.col("doc_id") + 1, 2, F.concat(i, F.lit(".")), F.lit(None), marked)
    path = scratch(spark, "clause-files")
    files.write_clauses(above.union(below), path)
    return files.read_clauses(spark, path).select("key", "parent", "depth", "label", "heading", F.md5("body").alias("body"), "lang", "normative")


_PACK_SQL = """packs AS (
  SELECT c_custkey AS id, 'pack-' || c_custkey AS slug, c_custkey % 12 AS kind, c_nationkey FROM customer)"""


def pack_files(spark, sf_dir):
    """customer as pack descriptions, most of them wrong in one way."""
    c, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 12
    only = lambda test, text, other="": F.when(test, text).otherwise(F.lit(other))
    names = lambda field: F.concat(F.lit(f"{field}:\n  fr: 'Loi: "), c, F.lit("'\n"), only(kind == 1, "", "  en: Act\n") if field == "name" else F.lit("  en: Act\n"), only(kind == 2, "  de: Gesetz\n") if field == "short_name" else F.lit(""))
    region = F.element_at(F.array(*[F.lit(r) for r in packs.REGIONS]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    entry = F.concat(
        F.lit("  - slug: doc-"), c, F.lit("\n    title: {fr: Titre, en: Title}\n    expected_clauses: "), (F.col("c_custkey") % 40).cast("string"), F.lit("\n    commencement:\n      - keys: ['doc-"), c, F.lit(":art-1']\n        source: Act 1\n        from: "),
        only(kind == 3, "pending", "2020-05-01"), F.lit("\n        until: "), only(kind == 4, "2019-01-01", "2024-01-01"), F.lit("\n      - keys: ['doc-"), c, F.lit(":art-1:para-2', 'doc-"), c, F.lit(":art-2']\n        source: Act 2\n        from: 2021-0"), (F.col("c_nationkey") % 9 + 1).cast("string"), F.lit("-01\n"),
    )
    text = F.concat(
        F.lit("format: "), only(kind == 5, "1", "2"), F.lit("\nslug: pack-"), c, F.lit("\n"), names("name"), names("short_name"), names("jurisdiction"), F.lit("region: "), F.when(kind == 6, "Atlantis").otherwise(region),
        F.lit("\nversion: '2026."), (F.col("c_custkey") % 30).cast("string"), F.lit("'\neffective_date: "), only(kind == 7, "soon", "2018-05-25"), F.lit("\ntrust_tier: community\nsource_url: https://example.org/"), c, F.lit("\nlicense: "), only(kind == 8, "''", "free"),
        F.lit("\nauthoritative_language: fr\ntranslations:\n  - {lang: en, status: "), only(kind == 9, "good", "official"), F.lit(", license: free}\n"), only(kind == 10, "", "documents:\n"), F.when(kind != 10, entry).otherwise(""), only(kind == 11, "oops: [\n"),
    )
    # A small file is one task's, but its packs are long to read: they are spread first.
    spread = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return spread.select(F.concat(F.lit("p"), c, F.lit(".pack.yaml")).alias("file"), text.alias("value"))


@query(
    "src1_pack_metadata",
    f"""WITH {_PACK_SQL}, told AS (SELECT *, CASE kind WHEN 1 THEN 'not named in each language' WHEN 2 THEN 'named in different languages' WHEN 4 THEN 'commencement ends before it starts' WHEN 5 THEN 'another format' WHEN 6 THEN 'region' WHEN 7 THEN 'effective_date'
      WHEN 8 THEN 'empty license' WHEN 9 THEN 'translation status' WHEN 10 THEN 'missing documents' WHEN 11 THEN 'no YAML' END AS problem FROM packs)
    SELECT 'p' || id || '.pack.yaml' AS file, problem, CASE WHEN problem IS NULL THEN slug END AS slug, CASE WHEN problem IS NULL THEN 'Loi: ' || id END AS french_name, CASE WHEN problem IS NULL THEN (['Africa', 'Americas', 'Asia Pacific', 'Europe', 'Middle East'])[c_nationkey % 5 + 1] END AS region,
      CASE WHEN problem IS NULL THEN DATE '2018-05-25' END AS effective_date, CASE WHEN problem IS NULL THEN 'en=official' END AS translations, CASE WHEN problem IS NULL THEN 'doc-' || id || '=' || (id % 40) || '/2' END AS documents FROM told""",
)
def pack_metadata(spark, sf_dir):
    """SRC1: pack descriptions written as YAML, read and checked; each wrong one says why."""
    path = scratch(spark, "packs")
    write_named(pack_files(spark, sf_dir), path)
    found = packs.read_packs(spark, path)
    translations = F.array_join(F.transform("translations", lambda t: F.concat(t["lang"], F.lit("="), t["status"])), ",")
    documents = F.array_join(F.transform("documents", lambda d: F.concat(d["slug"], F.lit("="), d["expected_clauses"].cast("string"), F.lit("/"), F.size(d["commencement"]).cast("string"))), ",")
    return found.select("file", "problem", "slug", F.element_at("name", "fr").alias("french_name"), "region", "effective_date", translations.alias("translations"), documents.alias("documents"))


@query(
    "snk3_dated_apart",
    f"""WITH {_PACK_SQL}, good AS (SELECT * FROM packs WHERE kind IN (0, 3)), k AS (SELECT id, kind, c_nationkey, part FROM good, (VALUES ('art-1'), ('art-1:para-1'), ('art-1:para-2:sub-1'), ('art-2'), ('art-3')) t(part))
    SELECT 'doc-' || id || ':' || part AS key,
      CASE WHEN part IN ('art-1', 'art-1:para-1') THEN CASE WHEN kind = 0 THEN DATE '2020-05-01' END WHEN part IN ('art-1:para-2:sub-1', 'art-2') THEN make_date(2021, c_nationkey % 9 + 1, 1) END AS starts, part IN ('art-1', 'art-1:para-1') AND kind = 3 AS pending,
      CASE WHEN part LIKE 'art-1%' THEN DATE '2024-01-01' END AS ends, CASE part WHEN 'art-1:para-2:sub-1' THEN 'Act 2; Act 1' WHEN 'art-2' THEN 'Act 2' WHEN 'art-3' THEN '' ELSE 'Act 1' END AS sources FROM k""",
)
def dated_apart(spark, sf_dir):
    """SNK3: a clause's start and end, each from the most specific entry that sets it, and what set them."""
    # Kept before they are filtered: the filter would have every pack read again, once for each field that it looks at.
    found = cut(packs.pack_rows(pack_files(spark, sf_dir)).select("problem", "slug", "documents")).where("problem is null")
    parts = F.explode(F.array(*[F.lit(p) for p in ("art-1", "art-1:para-1", "art-1:para-2:sub-1", "art-2", "art-3")]))
    documents = found.select(F.col("slug").alias("pack"), F.explode("documents.slug").alias("document")).withColumn("part", parts)
    keys = documents.select("pack", "document", F.concat_ws(":", "document", "part").alias("key"))
    return packs.dated(keys, found).select("key", "starts", "pending", "ends", F.array_join("sources", "; ").alias("sources"))


@query(
    "src3_law_order",
    r"""WITH f AS (SELECT p_brand AS document, 'art-' || p_size || '-' || p_partkey AS file, p_size, p_partkey FROM part), e AS (SELECT p_brand AS document, count(*) - CASE WHEN p_brand = 'Brand#3' THEN 1 ELSE 0 END AS n FROM part GROUP BY 1)
    SELECT document, file, row_number() OVER (PARTITION BY document ORDER BY p_size, p_partkey) AS turn, CASE WHEN count(*) OVER (PARTITION BY document) <> n THEN 'count' END AS problem FROM f JOIN e USING (document)""",
)
def law_order(spark, sf_dir):
    """SRC3, SO5: files in the law's order, and documents that hold another number of them than said."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "document")
    rows = part.select("document", F.concat_ws("-", F.lit("art"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("file"))
    told = part.groupBy("document").agg((F.count("*") - F.when(F.col("document") == "Brand#3", 1).otherwise(0)).alias("n"))
    return files.in_law_order(rows, told)


@query("src4_unaligned", "WITH c AS (SELECT DISTINCT doc_id // 5 AS key, lang FROM documents) SELECT key, l.lang FROM (SELECT DISTINCT key FROM c), (SELECT unnest(['en', 'fr', 'de']) AS lang) l WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.key = c.key AND x.lang = l.lang)".replace("(SELECT DISTINCT key FROM c),", "(SELECT DISTINCT key FROM c) c,"))
def unaligned(spark, sf_dir):
    """SRC4: clauses that a declared language lacks."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("key"), "lang").distinct()
    return files.unaligned(rows, ["en", "fr", "de"])


@query(
    "src5_coming_texts",
    """WITH f AS (SELECT p_partkey, 'art-' || p_partkey AS stem, '199' || (p_size % 10) || '-0' || (p_size % 9 + 1) || '-' || CASE WHEN p_partkey % 6 = 0 THEN '31' ELSE '15' END AS day, CASE WHEN p_partkey % 3 = 0 THEN 'fr' END AS lang, p_partkey % 8 = 5 AS odd FROM part)
    SELECT CASE WHEN odd THEN stem ELSE stem || '@' || day || coalesce('.' || lang, '') || '.md' END AS file, CASE WHEN NOT odd THEN stem END AS stem, CASE WHEN NOT odd THEN try_cast(day AS DATE) END AS starts, CASE WHEN NOT odd THEN lang END AS lang,
      CASE WHEN odd OR try_cast(day AS DATE) IS NULL THEN 'name' WHEN CAST(day AS DATE) <= DATE '1995-01-01' THEN 'too early' END AS problem FROM f""",
)
def coming_texts(spark, sf_dir):
    """SRC5: names of amended texts, and which of them don't hold."""
    i, n = F.col("p_partkey"), F.col("p_size")
    day = F.concat(F.lit("199"), (n % 10).cast("string"), F.lit("-0"), (n % 9 + 1).cast("string"), F.lit("-"), F.when(i % 6 == 0, "31").otherwise("15"))
    stem = F.concat(F.lit("art-"), i.cast("string"))
    name = F.when(i % 8 == 5, stem).otherwise(F.concat(stem, F.lit("@"), day, F.when(i % 3 == 0, ".fr").otherwise(""), F.lit(".md")))
    return files.coming(table(spark, sf_dir, "part").select(name.alias("file")), "1995-01-01")


@query("src10_question_files", "SELECT CAST(item_id AS VARCHAR) AS id, md5(regexp_replace(text, '\\s+', ' ', 'g')) AS question, 'en' AS lang, 'law:art-' || item_id AS expected, NULL AS problem FROM benchmark")
def question_files(spark, sf_dir):
    """SRC10: question files in YAML, read back."""
    i, text = F.col("item_id").cast("string"), F.regexp_replace("text", r"\s+", " ")
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    entry = F.concat(F.lit("  - id: '"), i, F.lit("'\n    question: "), quoted, F.lit("\n    lang: en\n    expected_keys: ['law:art-"), i, F.lit("']"))
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("file"), F.struct("item_id", entry.alias("e")).alias("entry"))
    whole = items.groupBy("file").agg(F.concat(F.lit("questions:\n"), F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda x: x["e"]), "\n")).alias("value"))
    path = scratch(spark, "question-files")
    whole.write.partitionBy("file").text(path)
    return files.read_questions(spark, path).select("id", F.md5("question").alias("question"), "lang", F.array_join("expected", ",").alias("expected"), "problem")


@query("snk13_rounded_scores", "SELECT label AS name, round(avg(CASE WHEN vec_id % 3 = 0 THEN 1e0 ELSE 0e0 END), 4) AS recall, count(*) AS questions FROM embeddings GROUP BY label")
def rounded_scores(spark, sf_dir):
    """SNK13, SRC12: results written as JSON to four places, and read back."""
    rows = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("name")).agg(F.avg((F.col("vec_id") % 3 == 0).cast("double")).alias("recall"), F.count("*").alias("questions"))
    path = scratch(spark, "scores")
    files.write_scores(rows, path)
    return spark.read.schema("name int, recall double, questions long").json(path)


@query(
    "src13_governance_export",
    "SELECT count(*) AS n, min(event_id) AS from_seq, max(event_id) AS to_seq, count(*) AS told, sum(length(props)) AS detail_chars FROM events",
)
def governance_export(spark, sf_dir):
    """SRC13, SNK9: an export and its manifest, read back; details stay the text they were."""
    entries = _governed(spark, sf_dir).withColumn("entry_hash", F.sha2(F.col("seq").cast("string"), 256))
    path = scratch(spark, "export")
    files.write_export(entries, path)
    found, manifest = files.read_export(spark, path, "seq long, prev_hash string, entry_hash string, details string")
    told = manifest.select(F.col("count").alias("told"))
    return found.agg(F.count("*").alias("n"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.sum(F.length("details")).alias("detail_chars")).crossJoin(F.broadcast(told))
