"""What is embedded: a clause's text after its place in the document, by model and recipe, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.operators.clauses import MOST_LEVELS, ancestors
from clausewright.operators.trees import places_above

#: What stands between the parts of a place, and how many tokens a place may have.
SEPARATOR, MOST_TOKENS = " > ", 64


def words_and_marks(text: Column) -> Column:
    """How many words and single marks a text has: a stand-in for a model's own tokens."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


def context(name: Column, headings: Column, text: Column, tokens: Callable[[Column], Column] = words_and_marks, most: int = MOST_TOKENS) -> Column:
    """The text after its document's name and the headings above it, outermost first.

    While the place has too many tokens its middle part goes, so that name and nearest heading stay; of two parts the heading
    stays. Parts are trimmed; null and blank ones don't count.
    """
    given = F.concat(F.array(name), F.coalesce(headings, F.array().cast("array<string>")))
    parts = F.filter(F.transform(given, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))

    def shorter(kept: Column, _: Column) -> Column:
        n = F.size(kept)
        middle = F.floor(n / 2).cast("int")
        without = F.concat(F.slice(kept, F.lit(1), middle), F.slice(kept, middle + 2, n - middle - 1))
        long = (n > 1) & (tokens(F.array_join(kept, SEPARATOR)) > most)
        return F.when(long, F.when(n == 2, F.slice(kept, 2, 1)).otherwise(without)).otherwise(kept)

    # Of n parts at most n - 1 go. An array of one array lets the parts be found once, not as often as they are named.
    shortened = lambda p: F.aggregate(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), p, shorter)
    kept = F.transform(F.array(parts), shortened)[0]
    return F.array_join(F.concat(kept, F.array(text)), SEPARATOR)


def ancestor_headings(texts: DataFrame, nodes: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """text_id, headings: of the clauses above each text (text_id, node, lang, heading, label, applies_from), outermost first.

    Of a clause's texts in the language of the text below, the one that starts on the same day counts, else the earliest (no day
    first), ties to the least text_id; its heading, else its label, else that of the clause (nodes: id, parent, label). Clauses without any
    are passed over; a text without headings above has no row. The way up is one recursive query.
    """
    found = with_headings(texts.select("text_id", "node", "lang", "heading", "label", "applies_from"), nodes, levels)
    return found.where(F.size("headings") > 0).select("text_id", "headings")


def with_headings(texts: DataFrame, nodes: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """texts, all their columns, with the ``headings`` of ``ancestor_headings``; null or empty where there are none.

    The texts of a clause meet in one row, which goes to the clauses below it; each text then chooses among them where it stands.
    """
    up = ancestors(texts.select(F.col("node").alias("id")).distinct(), nodes.select("id", "parent"), levels)
    said = F.collect_list(F.struct("lang", "applies_from", F.col("text_id").alias("other"), F.coalesce("heading", "label").alias("heading")))
    worded = texts.groupBy(F.col("node").alias("ancestor")).agg(said.alias("said"))
    labelled = up.join(nodes.select(F.col("id").alias("ancestor"), F.col("label").alias("node_label")), "ancestor").join(worded, "ancestor", "left")
    # At most as many as there are levels.
    above = labelled.groupBy(F.col("id").alias("node")).agg(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("at"), "node_label", "said"))).alias("above"))

    said = lambda clause: F.coalesce(clause["said"], F.array().cast(worded.schema["said"].dataType))
    heading = lambda clause: _heading(said(clause), F.col("lang"), F.col("applies_from"), clause["node_label"])
    headings = F.filter(F.transform("above", heading), lambda h: h.isNotNull())
    return texts.join(above, "node", "left").withColumn("headings", headings).drop("above")


def _heading(said: Column, lang: Column, day: Column, label: Column) -> Column:
    """Of said (lang, applies_from, other, heading), a clause's texts, the heading for a text in lang that starts on day, else the clause's label."""
    own = F.filter(said, lambda x: x["lang"] == lang)
    best = F.array_min(F.transform(own, lambda x: F.struct((~x["applies_from"].eqNullSafe(day)).alias("other_day"), x["applies_from"], x["other"], x["heading"])))
    return F.coalesce(best["heading"], label)


def texts_of_trees(trees: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """A row a text, with the other columns of its tree and with ``headings`` as in ``with_headings``; empty where there are none.

    trees: ``clauses``, an array of (id, parent, label, texts), where texts is an array of (text_id, lang, heading, label,
    applies_from, ...) or null. A parent is in the same tree. A tree, a version's clauses, is one row, so that nothing is
    shuffled; where trees outgrow a row, ``with_headings`` joins instead.
    """
    of = lambda name: F.transform("clauses", lambda c: c[name])
    above = F.arrow_udf(places_above(levels), "array<array<int>>")(of("id"), of("parent"))

    def said(clause: Column) -> Column:
        return F.transform(clause["texts"], lambda x: F.struct(x["lang"], x["applies_from"], x["text_id"].alias("other"), F.coalesce(x["heading"], x["label"]).alias("heading")))

    def worded(clause: Column, place: Column) -> Column:
        heading = lambda t: lambda p: _heading(said(F.col("clauses")[p]), t["lang"], t["applies_from"], F.col("clauses")[p]["label"])
        headings = lambda t: F.filter(F.transform(F.col("above")[place], heading(t)), lambda h: h.isNotNull())
        return F.transform(clause["texts"], lambda t: F.struct(t.alias("text"), headings(t).alias("headings")))

    texts = F.flatten(F.filter(F.transform("clauses", worded), lambda x: x.isNotNull()))
    rows = trees.withColumn("above", above).withColumn("worded", F.explode(texts))
    return rows.select(*(c for c in trees.columns if c != "clauses"), "worded.text.*", "worded.headings")


def name_in(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """slug, lang, name of wanted (slug, lang): the name (slug, lang, title) in that language, else in English, else in the first language by code."""
    given = names.select("slug", F.col("lang").alias("of"), "title")
    order = F.struct((F.col("of") != F.col("lang")).alias("a"), (F.col("of") != "en").alias("b"), "of", "title")
    return wanted.select("slug", "lang").distinct().join(given, "slug").groupBy("slug", "lang").agg(F.min(order)["title"].alias("name"))


def names_given(names: DataFrame) -> DataFrame:
    """slug, given: a document's names (slug, lang, title), one a language, in one row."""
    return names.groupBy("slug").agg(F.collect_list(F.struct("lang", "title")).alias("given"))


def name_of(given: Column, lang: Column) -> Column:
    """Of a document's names (lang, title), the one that ``name_in`` chooses."""
    order = F.transform(given, lambda n: F.struct((n["lang"] != lang).alias("a"), (n["lang"] != "en").alias("b"), n["lang"].alias("of"), n["title"].alias("title")))
    return F.when(lang.isNotNull(), F.array_min(order)["title"])


def with_name(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (slug, lang) with ``name``, as ``name_in`` chooses it; the names of a document meet in one row."""
    return rows.join(names_given(names), "slug", "left").withColumn("name", name_of(F.col("given"), F.col("lang"))).drop("given")


def to_embed(texts: DataFrame, vectors: DataFrame, model: str, recipe: str) -> DataFrame:
    """The texts (text_id, text) that have words and no vector (text_id, model, recipe) of this model under this recipe yet."""
    there = vectors.where((F.col("model") == model) & (F.col("recipe") == recipe)).select("text_id")
    return texts.where(F.length(F.trim("text")) > 0).join(there, "text_id", "left_anti")


def build_index(
    texts: DataFrame, vectors: DataFrame, model: str, recipe: str, encode: Callable[[DataFrame], DataFrame], skip_embedded: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The vectors (text_id, model, recipe, vector) after a build, and its counts: embedded, skipped_without_text, skipped_already_embedded.

    encode: rows of texts -> text_id, vector. A text has one vector a model: a new one takes the place of that of another recipe, and
    other models' stay. Null and blank texts are skipped; without skip_embedded all others are embedded again. text_id is unique.
    """
    worded = texts.where(F.length(F.trim("text")) > 0)
    chosen = to_embed(texts, vectors, model, recipe) if skip_embedded else worded
    fresh = encode(chosen).select("text_id", F.lit(model).alias("model"), F.lit(recipe).alias("recipe"), "vector")
    stays = vectors.select("text_id", "model", "recipe", "vector").join(chosen.select("text_id", F.lit(model).alias("model")), ["text_id", "model"], "left_anti")
    there = vectors.where((F.col("model") == model) & (F.col("recipe") == recipe) & F.lit(skip_embedded))
    # Three counts, one row each.
    counts = chosen.agg(F.count("*").alias("embedded"))
    counts = counts.crossJoin(F.broadcast(texts.agg(F.count_if(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0).alias("skipped_without_text"))))
    return stays.select("text_id", "model", "recipe", "vector").unionByName(fresh), counts.crossJoin(F.broadcast(there.agg(F.count("*").alias("skipped_already_embedded"))))
