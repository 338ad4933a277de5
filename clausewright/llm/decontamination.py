"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index stores, for every word of a test window, where it stands in the training documents. A window
is looked up from its rarest word: the lists of its words, each shifted back by the word's place in the
window, are intersected from the rarest on, and what is left are the places where the phrase begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.llm.shared import written

WINDOW = 10
#: Words before their A-Z are lower-cased: runs of digits, letters and anything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents with candidates of which up to so many ids (some 100 bytes each in memory) are broadcast; beyond, the join is shuffled.
BROADCAST_DOCS = 500_000
_DOC = ["doc_id", "text_hash"]


def words(text: Column) -> Column:
    """Words of a text as they are written; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _plain(word: Column) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def _same_doc(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.text_hash") == F.col(f"{right}.text_hash"))


class Windows:
    """The test windows of items: ``phrases`` (window, item_id), ``terms`` (window, off, term_id, size), ``vocabulary``."""

    def __init__(self, items: DataFrame, size: int = WINDOW):
        own = F.transform(words(F.col("text")), _plain)
        item = items.select("item_id", own.alias("w")).where(F.size("w") > 0)
        runs = F.when(
            F.size("w") >= size, F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
        ).otherwise(F.array("w"))
        each = written(item.select("item_id", F.explode(runs).alias("w")), "windows")
        phrases = written(each.select("w").distinct().withColumn("window", F.monotonically_increasing_id()), "phrases")
        self.phrases = written(each.join(phrases, "w").select("window", "item_id").distinct(), "window-items")
        spread = phrases.select("window", F.size("w").alias("size"), F.posexplode("w").alias("off", "term"))
        distinct = spread.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id())
        # The empty word, which no text has, ends each document in the index and tells its length.
        end = items.sparkSession.createDataFrame([("", -1)], "term string, term_id long")
        self.vocabulary = written(distinct.unionByName(end), "vocabulary")
        self.terms = written(spread.join(self.vocabulary, "term").select("window", "size", "off", "term_id"), "window-terms")


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings doc_id, text_hash, pos, term_id of the vocabulary's words in docs (doc_id, text).

    term_id -1 stands once for each row of docs, at its number of words.
    """
    placed = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.array_append(words(F.col("text")), F.lit(""))).alias("pos", "word")
    )
    # lower() is the quick test; it also folds letters outside A-Z, so the exact one follows.
    found = placed.join(vocabulary.withColumn("key", F.lower("term")), F.lower("word") == F.col("key"))
    exact = (F.col("word") == F.col("term")) | (_plain(F.col("word")) == F.col("term"))
    return written(found.where(exact).select(*_DOC, "pos", "term_id"), "postings")


def ranked_terms(postings: DataFrame, windows: Windows) -> DataFrame:
    """window, size, and its terms (n, off, term_id) from the rarest on, for windows whose words all occur."""
    often = postings.where("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("n"))
    met = windows.terms.join(often, "term_id").groupBy("window", "size")
    ranked = met.agg(F.array_sort(F.collect_list(F.struct("n", "off", "term_id"))).alias("terms"))
    return written(ranked.where(F.size("terms") == F.col("size")), "ranked-terms")


def _starts(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """Where windows may begin, by their rarest word alone."""
    anchors = ranked.select("window", "size", F.col("terms")[0]["off"].alias("off"), F.col("terms")[0]["term_id"].alias("term_id"))
    found = postings.join(anchors, "term_id").select(*_DOC, "window", "size", (F.col("pos") - F.col("off")).alias("start"))
    return found.where("start >= 0").distinct()


def phrase_matches(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """doc_id, text_hash, window, size, start of every exact occurrence of a window."""
    starts = _starts(postings, ranked)
    # The second rarest word: lists are still short.
    seconds = ranked.where("size > 1").select(
        F.col("window").alias("second"), F.col("terms")[1]["off"].alias("off"), F.col("terms")[1]["term_id"].alias("second_id")
    )
    of_seconds = postings.join(seconds.select(F.col("second_id").alias("term_id")).distinct(), "term_id", "left_semi")
    probe = starts.join(seconds, F.col("window") == F.col("second"), "left").alias("s")
    here = (
        _same_doc("s", "p") & (F.col("p.pos") == F.col("s.start") + F.col("s.off")) & (F.col("p.term_id") == F.col("s.second_id"))
    )
    two = probe.where("size > 1").join(of_seconds.alias("p"), here).select("s.doc_id", "s.text_hash", "window", "size", "start").distinct()
    two = written(two, "two-words")
    # The rest: only the documents that still have candidates.
    ids = two.select(*_DOC).distinct()
    ids = (F.broadcast(ids) if ids.count() <= BROADCAST_DOCS else ids).alias("i")
    own = postings.where("term_id >= 0").alias("p").join(ids, _same_doc("p", "i"), "left_semi")
    left = ranked.where("size > 2").select(F.col("window").alias("w"), F.explode(F.slice("terms", 3, 1 << 20)).alias("t"))
    probes = two.join(left, F.col("window") == F.col("w")).select(
        *_DOC, "window", "size", "start", (F.col("start") + F.col("t.off")).alias("pos"), F.col("t.term_id").alias("term_id")
    )
    hit = probes.alias("s").join(
        own.alias("p"), _same_doc("s", "p") & (F.col("p.pos") == F.col("s.pos")) & (F.col("p.term_id") == F.col("s.term_id"))
    )
    full = (
        hit.groupBy("s.doc_id", "s.text_hash", "window", "size", "start")
        .agg(F.count_distinct("s.pos").alias("n"))
        .where("n = size - 2")
        .select(*_DOC, "window", "size", "start")
    )
    columns = [*_DOC, "window", "size", "start"]
    return starts.where("size = 1").select(*columns).unionByName(two.where("size = 2").select(*columns)).unionByName(full)


def near_matches(postings: DataFrame, ranked: DataFrame, slack: int) -> DataFrame:
    """doc_id, text_hash, window, size, start of windows whose words all stand within slack of their places.

    Places count from where the rarest word puts the window's begin. slack 0 gives the exact phrases.
    """
    anchors = ranked.select("window", "size", "terms", F.col("terms")[0]["off"].alias("off"), F.col("terms")[0]["term_id"].alias("term_id"))
    starts = postings.join(anchors, "term_id").select(*_DOC, "window", "size", (F.col("pos") - F.col("off")).alias("start"), "terms").distinct()
    wide = F.lit(slack + 1)
    probes = starts.select(*_DOC, "window", "size", "start", F.posexplode("terms").alias("rank", "t")).select(
        "*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("side")
    )
    probes = probes.withColumn("cell", F.floor((F.col("start") + F.col("t.off")) / wide) + F.col("side"))
    cells = postings.where("term_id >= 0").withColumn("cell", F.floor(F.col("pos") / wide))
    hit = probes.alias("s").join(
        cells.alias("p"), _same_doc("s", "p") & (F.col("p.cell") == F.col("s.cell")) & (F.col("p.term_id") == F.col("s.t.term_id"))
    )
    near = hit.where(F.abs(F.col("p.pos") - F.col("s.start") - F.col("s.t.off")) <= slack)
    counted = near.groupBy("s.doc_id", "s.text_hash", "window", "size", "start").agg(F.count_distinct("rank").alias("n"))
    return counted.where("n = size").select(*_DOC, "window", "size", "start")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items (sorted ids) for every row of docs (doc_id, text).

    items: item_id, text. Null texts, and texts without words, have no windows and are not hit. Items
    without an id hit words but aren't counted; items of equal text are counted each. Repeated rows of
    docs get equal results; null ids are ids like others. Texts are read whole, however long. Empty
    tables are fine: without items nothing is hit. Other columns aren't read.
    """
    windows = Windows(items, size)
    postings = index(docs, windows.vocabulary)
    found = written(phrase_matches(postings, ranked_terms(postings, windows)), "matches")
    by_start = W.partitionBy(*_DOC).orderBy("start", "size").rowsBetween(W.unboundedPreceding, -1)
    spans = found.select(*_DOC, "start", (F.col("start") + F.col("size")).alias("end"), "size").distinct()
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(by_start), F.lit(0))))
    hits = spans.withColumn("fresh", fresh).groupBy(*_DOC).agg(F.sum("fresh").alias("n_hit"))
    named = found.select(*_DOC, "window").distinct().join(windows.phrases, "window")
    ids = named.groupBy(*_DOC).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    rows = postings.where("term_id = -1").select(*_DOC, F.col("pos").cast("long").alias("n_words")).alias("r")
    marked = hits.alias("h").join(ids.alias("i"), _same_doc("h", "i")).select("h.doc_id", "h.text_hash", "n_hit", "items").alias("m")
    return rows.join(marked, _same_doc("r", "m"), "left").select(
        "r.doc_id", "r.text_hash", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_sort("items"), F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs, all columns, without the rows that hold a window of an item."""
    bad = written(contamination(docs, items, size).where("n_hit > 0").select(*_DOC).distinct(), "contaminated").alias("b")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row")).alias("d")
    return rows.join(bad, _same_doc("d", "b"), "left_anti").select("row.*")


def op2_positional_index(spark, sf_dir: str) -> DataFrame:
    """Which words of every document lie in a window of 10 words of a benchmark item."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
runs AS (
  SELECT item_id, w, least(len(w), 10) AS size, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i + 1 : i + size], ' ') AS phrase FROM runs),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT rid, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size),
found AS (
  SELECT p.rid, p.i, p.size, x.item_id
  FROM (SELECT rid, i, size, array_to_string(w[i + 1 : i + size], ' ') AS phrase FROM places) p JOIN windows x USING (phrase, size)),
hit AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS spot FROM (SELECT DISTINCT rid, i, size FROM found)) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""
