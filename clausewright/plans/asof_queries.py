"""As-of queries on orders and lineitem."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.operators import asof
from clausewright.plans.bindings import TEXTS_SQL, VERSIONS_SQL, texts, versions
from clausewright.plans.catalog import query
from clausewright.session import dealt, table

DAY = "1996-06-30"
_LIFE = """life AS (
  SELECT document, version, number, effective, lead(effective) OVER (PARTITION BY document ORDER BY effective) AS next_effective
  FROM (SELECT * FROM versions WHERE status = 'published'
        QUALIFY row_number() OVER (PARTITION BY document, effective ORDER BY number DESC, version DESC) = 1))"""
_TIERS = f"""tiers AS (
  SELECT *, CASE WHEN NOT pending AND applies_from <= DATE '{DAY}' AND (applies_until IS NULL OR applies_until > DATE '{DAY}') THEN 0
                 WHEN NOT coalesce(applies_until <= DATE '{DAY}', false) THEN 1 ELSE 2 END AS tier FROM texts),
ordered AS (
  SELECT *, CASE WHEN tier = 1 AND pending THEN 1 ELSE 0 END AS waits,
         CASE tier WHEN 0 THEN -datediff('day', DATE '1970-01-01', applies_from) WHEN 1 THEN datediff('day', DATE '1970-01-01', applies_from)
                   ELSE -datediff('day', DATE '1970-01-01', applies_until) END AS spot FROM tiers)"""


@query(
    "fil1_in_force_version",
    f"""WITH {VERSIONS_SQL} SELECT document, version, number, effective FROM versions
    WHERE status = 'published' AND effective <= DATE '{DAY}'
    QUALIFY row_number() OVER (PARTITION BY document ORDER BY effective DESC, number DESC, version DESC) = 1""",
)
def in_force_version(spark, sf_dir):
    """FIL1, WN2: the version of each document in force on one day."""
    return asof.in_force(versions(spark, sf_dir), DAY)


@query(
    "jn11_in_force_on_days",
    f"""WITH {VERSIONS_SQL}, {_LIFE}, days(day) AS (VALUES (DATE '1994-01-01'), (DATE '1995-07-01'), (DATE '1997-12-31'))
    SELECT day, document, version, number, effective FROM days JOIN life
    ON effective <= day AND (next_effective IS NULL OR day < next_effective)""",
)
def in_force_on_days(spark, sf_dir):
    """JN11: the as-of join for many days."""
    days = spark.createDataFrame([("1994-01-01",), ("1995-07-01",), ("1997-12-31",)], "day string").select(F.to_date("day").alias("day"))
    return asof.in_force_on_days(versions(spark, sf_dir), days)


@query(
    "wn5_version_states",
    f"""WITH {VERSIONS_SQL}, {_LIFE}
    SELECT document, version, effective, CAST(next_effective - INTERVAL 1 DAY AS DATE) AS until,
           CASE WHEN effective > DATE '{DAY}' THEN 'scheduled' WHEN next_effective <= DATE '{DAY}' THEN 'replaced' ELSE 'in_force' END AS state
    FROM life""",
)
def version_states(spark, sf_dir):
    """WN5, VR6: scheduled, in force or replaced."""
    return asof.states(versions(spark, sf_dir), DAY)


@query(
    "fil2_applying_texts",
    f"""WITH {TEXTS_SQL} SELECT node, text_id, coalesce(applies_until <= DATE '{DAY}', false) AS ended FROM texts
    WHERE NOT pending AND (applies_from IS NULL OR applies_from <= DATE '{DAY}') AND (applies_until IS NULL OR applies_until > DATE '{DAY}')""",
)
def applying_texts(spark, sf_dir):
    """FIL2: half-open validity."""
    now = F.lit(DAY).cast("date")
    return texts(spark, sf_dir).where(asof.applies(now)).select("node", "text_id", asof.ended(now).alias("ended"))


@query(
    "fil3_ended_texts",
    f"WITH {TEXTS_SQL} SELECT lang, count(*) AS n_ended FROM texts WHERE applies_until <= DATE '{DAY}' GROUP BY lang",
)
def ended_texts(spark, sf_dir):
    """FIL3: texts whose end has come."""
    return texts(spark, sf_dir).where(asof.ended(F.lit(DAY).cast("date"))).groupBy("lang").agg(F.count("*").alias("n_ended"))


@query(
    "fil4_text_on_day",
    f"""WITH {TEXTS_SQL}, {_TIERS} SELECT node, lang, tier, text_id FROM ordered
    QUALIFY row_number() OVER (PARTITION BY node, lang ORDER BY tier, waits, spot, text_id) = 1""",
)
def text_on_day(spark, sf_dir):
    """FIL4: the three-tier choice."""
    return asof.text_on(texts(spark, sf_dir), DAY, "node", "lang")


@query(
    "fil5_texts_for_reader",
    f"""WITH {TEXTS_SQL}, {_TIERS},
    own AS (SELECT node, text_id FROM ordered WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY node ORDER BY tier, waits, spot, text_id) = 1),
    src AS (SELECT node, text_id FROM ordered WHERE is_authoritative QUALIFY row_number() OVER (PARTITION BY node ORDER BY tier, waits, spot, text_id) = 1),
    picked AS (SELECT coalesce(own.node, src.node) AS node, coalesce(own.text_id, src.text_id) AS text_id, src.text_id AS source FROM own FULL JOIN src ON own.node = src.node),
    coming AS (SELECT node, lang, min(applies_from) AS coming_from FROM texts WHERE NOT pending AND applies_from > DATE '{DAY}' GROUP BY ALL)
    SELECT p.node, p.text_id, t.lang AS shown_lang, CASE WHEN NOT t.is_authoritative THEN p.source END AS prevailing, c.coming_from
    FROM picked p JOIN texts t ON t.text_id = p.text_id LEFT JOIN coming c ON c.node = p.node AND c.lang = t.lang""",
)
def texts_for_reader(spark, sf_dir):
    """FIL5: shown text, prevailing text, coming text."""
    return asof.texts_for(texts(spark, sf_dir), DAY, "en")


@query(
    "snk2_validity_slices",
    f"""WITH {TEXTS_SQL} SELECT node, lang, text_id, applies_from, until FROM (
      SELECT *, least(coalesce(applies_until, DATE '9999-12-31'), coalesce(lead(applies_from) OVER (PARTITION BY node, lang ORDER BY applies_from, text_id), DATE '9999-12-31')) AS until
      FROM texts WHERE NOT pending AND applies_from IS NOT NULL) WHERE applies_from < until""",
)
def validity_slices(spark, sf_dir):
    """SNK2: disjoint slices of validity."""
    return asof.slices(texts(spark, sf_dir))


@query(
    "snk2_amended_texts",
    f"""WITH {TEXTS_SQL}, fresh AS (SELECT node, min(applies_from) + 700 AS new_from FROM texts WHERE node % 3 = 0 GROUP BY node),
    cut AS (SELECT t.node, text_id, applies_from, least(applies_until, CAST(new_from AS DATE)) AS applies_until FROM texts t LEFT JOIN fresh f ON f.node = t.node)
    SELECT * FROM cut WHERE applies_until IS NULL OR applies_from < applies_until""",
)
def amended_texts(spark, sf_dir):
    """SNK2: new words end old ones and drop those that never apply."""
    old = texts(spark, sf_dir)
    fresh = old.where("node % 3 = 0").groupBy("node").agg(F.date_add(F.min("applies_from"), 700).alias("new_from"))
    return asof.amended(old, fresh)


@query(
    "snk3_commencement",
    """WITH keys AS (SELECT DISTINCT r_name || ':' || n_name || ':' || c_mktsegment AS key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    entries AS (SELECT r_name AS entry, r_regionkey AS begins FROM region UNION ALL SELECT r_name || ':' || n_name, 100 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
                UNION ALL SELECT DISTINCT r_name || ':' || n_name || ':BUILDING', 1000 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0)
    SELECT key, entry, begins FROM keys JOIN entries ON key = entry OR starts_with(key, entry || ':')
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY len(string_split(entry, ':')) DESC) = 1""",
)
def commencement(spark, sf_dir):
    """SNK3, JN12: the most specific covering entry."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    keys = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    keys = keys.select(F.concat_ws(":", "r_name", "n_name", "c_mktsegment").alias("key")).distinct()
    entries = (
        table(spark, sf_dir, "region").select(F.col("r_name").alias("entry"), F.col("r_regionkey").alias("begins"))
        .union(nation.where("n_nationkey % 2 = 0").select(F.concat_ws(":", "r_name", "n_name"), F.col("n_nationkey") + 100))
        .union(nation.where("n_nationkey % 3 = 0").select(F.concat_ws(":", "r_name", "n_name", F.lit("BUILDING")), F.col("n_nationkey") + 1000))
    )
    return asof.most_specific(keys, entries)


@query(
    "gov7_changed_after_publication",
    f"""WITH {VERSIONS_SQL}, now AS (SELECT document, version, number + CASE WHEN version % 50 = 3 THEN 1 ELSE 0 END AS number, status, effective FROM versions WHERE version % 40 <> 5)
    SELECT v.version, CASE WHEN n.version IS NULL THEN 'missing' ELSE 'changed' END AS problem
    FROM versions v LEFT JOIN now n USING (version) WHERE v.status = 'published' AND (n.version IS NULL OR n.number <> v.number)""",
)
def published_changes(spark, sf_dir):
    """GOV7: published rows that a new snapshot lacks or alters."""
    before = versions(spark, sf_dir)
    now = before.where("version % 40 <> 5").withColumn("number", F.col("number") + F.when(F.col("version") % 50 == 3, 1).otherwise(0))
    return asof.changed_after_publication(before, now, "version")


@query(
    "snk2_placed_clauses",
    """WITH old AS (SELECT DISTINCT l_orderkey AS parent, l_linenumber * 3 AS n, 8 - l_linenumber % 5 AS place_, l_linenumber FROM lineitem),
    o AS (SELECT parent, n, row_number() OVER (PARTITION BY parent ORDER BY place_, n) AS place FROM old),
    w AS (SELECT DISTINCT parent, n FROM (SELECT o_orderkey AS parent, o_custkey % 23 AS n FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 10 * 3 + 1 FROM orders) x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.parent = x.parent AND o.n = x.n)),
    e AS (SELECT parent, n, place, place AS at_, 1 AS was FROM o UNION ALL SELECT w.parent, w.n, NULL, coalesce(min(o.place) FILTER (o.n > w.n), 9999), 0 FROM w LEFT JOIN o ON o.parent = w.parent GROUP BY w.parent, w.n)
    SELECT parent, 'law:art-' || n AS key, row_number() OVER (PARTITION BY parent ORDER BY at_, was, n) AS turn, was = 0 AS added FROM e""",
)
def placed_clauses(spark, sf_dir):
    """SNK2: clauses that amendments add, each where it belongs among its siblings."""
    key = lambda n: F.concat(F.lit("law:art-"), n.cast("string"))
    line = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), line)
    old = dealt(lines, lines.count(), "parent").distinct()
    turn = F.row_number().over(W.partitionBy("parent").orderBy(8 - line % 5, line))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"), F.explode(F.array(F.col("o_custkey") % 23, F.col("o_orderkey") % 10 * 3 + 1)).alias("n"))
    return asof.placed(old.select("parent", key(line * 3).alias("key"), turn.alias("place")), orders.select("parent", key(F.col("n")).alias("key")))
