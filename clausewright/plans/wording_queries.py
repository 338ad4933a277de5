"""Readings of text on documents, pages, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions import wording as wd
from clausewright.plans.catalog import query
from clausewright.session import table

_LABEL = "CASE p_partkey % 5 WHEN 0 THEN (p_size % 9) || '.' || p_size WHEN 1 THEN '(' || ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xiv'][p_size % 12 + 1] || ')' WHEN 2 THEN chr(97 + p_size % 8) || ')' WHEN 3 THEN p_size || '.' ELSE '-' END"


def _labels(spark, sf_dir):
    i, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    roman = F.element_at(F.array(*[F.lit(x) for x in "i ii iii iv v vi vii viii ix x xi xiv".split()]), (F.col("p_size") % 12 + 1).cast("int"))
    label = (
        F.when(i == 0, F.concat((F.col("p_size") % 9).cast("string"), F.lit("."), n)).when(i == 1, F.concat(F.lit("("), roman, F.lit(")")))
        .when(i == 2, F.concat(F.char(97 + F.col("p_size") % 8), F.lit(")"))).when(i == 3, F.concat(n, F.lit("."))).otherwise("-")
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", label.alias("label"))


@query(
    "sc5_labels",
    f"""SELECT p_partkey, label, CASE p_partkey % 5 WHEN 0 THEN 'decimal' WHEN 1 THEN 'roman' WHEN 2 THEN 'letter' WHEN 3 THEN 'decimal' END AS style,
    CASE p_partkey % 5 WHEN 1 THEN [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14][p_size % 12 + 1] WHEN 2 THEN p_size % 8 + 1 WHEN 4 THEN NULL ELSE p_size END AS number FROM (SELECT *, {_LABEL} AS label FROM part)""",
)
def labels(spark, sf_dir):
    """SC5: styles and numbers of printed labels."""
    return _labels(spark, sf_dir).select("p_partkey", "label", wd.label_style(F.col("label")).alias("style"), wd.label_value(F.col("label")).alias("number"))


@query(
    "sc6_slugs",
    r"""SELECT doc_id, CASE WHEN s = '' THEN 'policy' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(substr(array_to_string(regexp_extract_all(lower(strip_accents(nfc_normalize(text))), '[\p{L}\p{N}_]+'), '-'), 1, 60), '^[-_]+|[-_]+$', '', 'g') AS s FROM documents)""",
)
def slugs(spark, sf_dir):
    """SC6: slugs of names."""
    return table(spark, sf_dir, "documents").select("doc_id", wd.slug(F.col("text")).alias("slug"))


@query(
    "sc7_snippets",
    r"""WITH p AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(CASE WHEN contains(substr(t, 1, 80), ' ') THEN regexp_replace(substr(t, 1, 81), ' [^ ]*$', '') ELSE substr(t, 1, 80) END, '[ ,;:]+$', '') || '…' END AS snippet FROM p""",
)
def snippets(spark, sf_dir):
    """SC7: beginnings to quote."""
    return table(spark, sf_dir, "documents").select("doc_id", wd.snippet(F.col("text"), 80).alias("snippet"))


@query(
    "sc9_sentences",
    r"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS t FROM conversations), p AS (SELECT conv_id, turn, string_split(regexp_replace(trim(t), '([.!?؟؛۔]["''”’)\]]*[ \t]+)', '\1' || chr(1), 'g'), chr(1)) AS p FROM c)
    SELECT conv_id, turn, array_to_string(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))), ',') AS starts FROM p""",
)
def sentences(spark, sf_dir):
    """SC9: where sentences begin."""
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(wd.boundaries(plain).cast("array<string>"), ",").alias("starts"))


@query(
    "sc15_quotes",
    r"""WITH t AS (SELECT page_id, trim(regexp_replace(translate(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '‘’“”', '''''""'), '\s+', ' ', 'g')) AS t FROM pages)
    SELECT page_id, length(t) AS n_chars, contains(t, 'track') AND contains(t, 'the') AS quoted, contains(t, substr(t, 10, 20)) AS own FROM t""",
)
def quotes(spark, sf_dir):
    """SC15, EV12: words of a page, and whether it holds a quote."""
    read = table(spark, sf_dir, "pages").select("page_id", wd.page_text(F.col("html")).alias("t"))
    return read.select("page_id", F.length("t").alias("n_chars"), wd.quoted(F.lit("track ... the"), F.col("t")).alias("quoted"), F.contains("t", F.substring("t", 10, 20)).alias("own"))


@query(
    "sc19_predicates",
    r"""SELECT conv_id, turn, regexp_matches(text, '\p{L}') AND text = upper(text) AS capitals, regexp_matches(rtrim(text), '[.;:,!?]["''”’)\]]*$') AS prose FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN upper(text) ELSE text END AS text FROM conversations)""",
)
def predicates(spark, sf_dir):
    """SC19: capitals, prose."""
    text = F.when(F.col("turn") % 3 == 0, F.upper("text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", wd.in_capitals(text).alias("capitals"), wd.ends_as_prose(text).alias("prose"))


@query(
    "sc20_ligatures",
    "SELECT p_partkey, replace(replace(p_name, 'fi', '#'), '#', 'fi') || ' office' AS name FROM part",
)
def ligatures(spark, sf_dir):
    """SC20: letters for ligatures."""
    return table(spark, sf_dir, "part").select("p_partkey", wd.without_ligatures(F.concat(F.replace("p_name", F.lit("fi"), F.lit("ﬁ")), F.lit(" oﬃce"))).alias("name"))


_TEXT = """'See Article ' || (l_partkey % 30) || '(' || l_linenumber || '), Article 7(1)(b) and point (c) of Article ' || (l_suppkey % 9) || '(2)' ||
  CASE l_orderkey % 3 WHEN 0 THEN ' of the Directive 9' WHEN 1 THEN ' of Treaty 2' ELSE ' of this law' END"""


@query(
    "tr7_references",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 30 AS a, l_suppkey % 9 AS s, l_orderkey % 3 = 2 AS own FROM lineitem),
    r AS (SELECT DISTINCT l_orderkey, l_linenumber, a, s, 'law:art-' || a || ':para-' || l_linenumber AS key FROM t UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, a, s, 'law:art-7:para-1:pt-b' FROM t
      UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, a, s, 'law:art-' || s || ':para-2:pt-c' FROM t WHERE own UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, a, s, 'law:art-' || s || ':para-2' FROM t WHERE own),
    known AS (SELECT DISTINCT 'law:art-' || (p_partkey % 20) || ':para-' || (p_size % 4) AS key FROM part)
    SELECT key, count(DISTINCT (l_orderkey, l_linenumber, a, s)) AS named, key IN (SELECT key FROM known) AS resolved FROM r GROUP BY key""",
)
def references(spark, sf_dir):
    """TR7: clauses that texts name, and whether they exist."""
    text = F.concat(
        F.lit("See Article "), (F.col("l_partkey") % 30).cast("string"), F.lit("("), F.col("l_linenumber").cast("string"), F.lit("), Article 7(1)(b) and point (c) of Article "),
        (F.col("l_suppkey") % 9).cast("string"), F.lit("(2)"), F.element_at(F.array(F.lit(" of the Directive 9"), F.lit(" of Treaty 2"), F.lit(" of this law")), (F.col("l_orderkey") % 3 + 1).cast("int")),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", text.alias("text")).distinct()
    named = rows.select(F.explode(wd.references(F.col("text"), F.lit("law"))).alias("r")).groupBy(F.col("r.key").alias("key")).agg(F.count("*").alias("named"))
    known = table(spark, sf_dir, "part").select(F.concat(F.lit("law:art-"), (F.col("p_partkey") % 20).cast("string"), F.lit(":para-"), (F.col("p_size") % 4).cast("string")).alias("key")).distinct()
    return named.join(known.withColumn("resolved", F.lit(True)), "key", "left").na.fill(False, ["resolved"])
