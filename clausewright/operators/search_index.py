"""A stored keyword index: texts analysed once, lists read in blocks, searched exactly without scoring every text.

Two tables, both appended to when texts come. ``postings`` holds a row a text: its terms and how often it has them.
``blocks`` holds each term's texts by falling weight in blocks of BLOCK_TEXTS, with the greatest frequency and the
least length of each block, from which its highest possible score follows whatever the statistics have become.
Terms are spread over folders by hash, so that a search reads the folders of its own terms.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clausewright.functions.redaction import arabic_light
from clausewright.operators.retrieval import tokens, weight
from clausewright.session import cut

#: Texts in a block; texts whose lists are made at once; folders that terms are spread over; blocks that are handed on at once.
BLOCK_TEXTS, RUN_TEXTS, FOLDERS, LISTS_A_BATCH = 128, 4096, 16, 10_000
#: Questions are answered in blocks of about so many (question, term) pairs, which every task holds.
QUESTION_TERMS = 200_000
#: Lists of the highest bounds whose first blocks are read to begin with, for each question and source.
FIRST_LISTS = 3
#: Scores are rounded to six digits; bounds leave room for that.
ROUNDING = 1e-6
_ACCENTS, _PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    """Tokens of a text without their accents."""
    return tokens(F.translate(F.lower(text), _ACCENTS, _PLAIN))


#: How a language's texts and questions become terms; any other language: plain tokens.
ANALYZERS: dict[str, Callable[[Column], Column]] = {"ar": lambda text: tokens(arabic_light(text)), "de": folded, "es": folded, "fr": folded}


def analyzed(text: Column, lang: Column, analyzers: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The terms of a text in its language."""
    chosen = F.when(F.lit(False), tokens(text))
    for name, analyzer in (ANALYZERS if analyzers is None else analyzers).items():
        chosen = chosen.when(lang == name, analyzer(text))
    return chosen.otherwise(tokens(text))


_POSTINGS = "text_id long, source string, lang string, n_words int, terms array<string>, tfs array<int>"
_BLOCKS = "term string, lang string, source string, run long, block int, n int, most int, least_words int, text_ids array<long>"


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each entry of a list column, and the entries."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words as terms and their frequencies, few texts at a time."""
    for whole in batches:
        for first in range(0, whole.num_rows, 256):
            batch = whole.slice(first, 256)
            row, words = _flat(batch.column("words"))
            coded = words.dictionary_encode()
            n = max(1, len(coded.dictionary))
            pairs, tfs = np.unique(row * n + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(pairs // n, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (coded.dictionary.take(pa.array(pairs % n)), pa.array(tfs.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("text_id", "source", "lang", "n_words")] + lists, names=["text_id", "source", "lang", "n_words", "terms", "tfs"])


def _inverted(mean_words: float, block_texts: int, run_texts: int):
    """A task's texts, a run of them at a time, as lists, by falling weight, in blocks."""

    def invert(texts: pa.Table, run: int) -> pa.Table:
        column = {c: texts[c].combine_chunks() for c in texts.column_names}
        row, terms = _flat(column["terms"])
        if not len(terms):
            return kinds.empty_table()
        coded, langs, sources = terms.dictionary_encode(), column["lang"].dictionary_encode(), column["source"].dictionary_encode()
        term, of = coded.indices.to_numpy(), (langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy())[row]
        tfs, n_words, ids = column["tfs"].flatten().to_numpy(), column["n_words"].to_numpy()[row], column["text_id"].to_numpy()[row]
        order = np.lexsort((ids, -weight(tfs, n_words, mean_words), of, term))
        term, of, tfs, n_words, ids = (x[order] for x in (term, of, tfs, n_words, ids))
        opens = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (of[1:] != of[:-1])))
        place = np.arange(len(ids)) - np.repeat(opens, np.diff(np.append(opens, len(ids))))
        starts = np.flatnonzero(place % block_texts == 0)
        ends = np.append(starts, len(ids)).astype(np.int32)
        return pa.table(
            [
                coded.dictionary.take(pa.array(term[starts])), langs.dictionary.take(pa.array(of[starts] // len(sources.dictionary))), sources.dictionary.take(pa.array(of[starts] % len(sources.dictionary))),
                pa.array(np.full(len(starts), run, np.int64)), pa.array((place[starts] // block_texts).astype(np.int32)), pa.array(np.diff(ends)),
                pa.array(np.maximum.reduceat(tfs, starts)), pa.array(np.minimum.reduceat(n_words, starts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
            ],
            schema=kinds,
        )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, run_texts - sum(b.num_rows for b in held))
                held, batch = [*held, part], batch.slice(part.num_rows)
                if sum(b.num_rows for b in held) == run_texts:
                    yield from invert(pa.Table.from_batches(held), run).to_batches(max_chunksize=LISTS_A_BATCH)
                    run, held = run + 1, []
        if held:
            yield from invert(pa.Table.from_batches(held), run).to_batches(max_chunksize=LISTS_A_BATCH)

    kinds = to_arrow_schema(StructType.fromDDL(_BLOCKS))
    return runs


def _scored(asked: list[tuple], known: dict[tuple[str, str], tuple[float, float]], limit: int, kind: pa.Schema):
    """Of a batch of texts, the limit best of each source for each question (qid, lang, term), and what ties with the last of them."""
    by_lang: dict[str, dict] = defaultdict(lambda: defaultdict(list))
    for qid, lang, term in asked:
        if (term, lang) in known:
            by_lang[lang][qid].append(term)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = {}
        for lang, questions in by_lang.items():
            number = {t: i for i, t in enumerate(dict.fromkeys(t for own in questions.values() for t in own))}
            idf, mean = np.array([known[t, lang][0] for t in number]), known[next(iter(number)), lang][1]
            starts = np.cumsum([0] + [len(own) for own in questions.values()])[:-1]
            plans[lang] = pa.array(list(number), pa.string()), idf, mean, np.array([number[t] for own in questions.values() for t in own]), starts, list(questions)
        for batch in batches:
            texts = pa.Table.from_batches([batch])
            for source, lang in set(zip(texts["source"].to_pylist(), texts["lang"].to_pylist(), strict=True)):
                if lang not in plans:
                    continue
                names, idf, mean, places, starts, qids = plans[lang]
                own = texts.filter(pc.and_(pc.equal(texts["source"], source), pc.equal(texts["lang"], lang))).combine_chunks()
                row, terms = _flat(own["terms"].combine_chunks())
                found = pc.index_in(terms, value_set=names)
                some = found.is_valid().to_numpy(zero_copy_only=False)
                row, term, tfs = row[some], found.drop_null().to_numpy(), own["tfs"].combine_chunks().flatten().to_numpy()[some]
                parts = weight(tfs, own["n_words"].to_numpy()[row], mean) * idf[term]
                bounds = np.searchsorted(row, np.arange(own.num_rows + 1))
                table = np.empty((own.num_rows, len(qids)))
                for at in range(own.num_rows):
                    part = np.zeros(len(names))
                    part[term[bounds[at] : bounds[at + 1]]] = parts[bounds[at] : bounds[at + 1]]
                    table[at] = np.add.reduceat(part[places], starts)
                table = np.round(table, 6)
                n = min(limit, own.num_rows)
                least = np.partition(table, own.num_rows - n, axis=0)[own.num_rows - n]
                text_at, question_at = np.nonzero((table >= least[None, :]) & (table > 0))
                columns = [[qids[i] for i in question_at], [source] * len(text_at), own["text_id"].to_numpy()[text_at], table[text_at, question_at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return score


def _folder(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int").alias("folder")


@dataclass(frozen=True)
class Index:
    """A keyword index in a folder that all machines share."""

    spark: SparkSession
    path: str

    def add(self, texts: DataFrame, analyzers: dict[str, Callable[[Column], Column]] | None = None) -> None:
        """Append texts (text_id, source, lang, heading, body) that the index doesn't hold; texts without a worded body aren't kept.

        A text_id is added once: rows whose id the index holds already are left out. Null headings, sources and
        languages count as empty.
        """
        if texts.limit(1).isEmpty():
            return
        worded = texts.where(F.length(F.trim("body")) > 0)
        try:
            worded = worded.join(self.postings().select("text_id").distinct(), "text_id", "left_anti")
        except AnalysisException:
            pass  # there is no index yet
        if worded.isEmpty():
            return
        words = analyzed(F.concat_ws(" ", "heading", "body"), F.col("lang"), analyzers)
        sized = worded.select("text_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), words.alias("words")).withColumn("n_words", F.size("words"))
        load = f"load={uuid.uuid4().hex}"
        sized.mapInArrow(_counted, _POSTINGS).write.option("compression", "zstd").parquet(f"{self.path}/postings/{load}")
        counted = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings/{load}")
        n_texts, total = counted.agg(F.count("*"), F.sum("n_words")).first()
        # A frequent term's list is kept in runs of texts, so that no task holds a whole list; texts become lists where they are read.
        lists = counted.mapInArrow(_inverted(max(1.0, total / n_texts), BLOCK_TEXTS, RUN_TEXTS), _BLOCKS)
        lists.withColumn("folder", _folder("term")).sortWithinPartitions("folder", "term").write.option("compression", "zstd").partitionBy("folder").parquet(f"{self.path}/blocks/{load}")

    def postings(self) -> DataFrame:
        """text_id, source, lang, n_words, terms, tfs: a row a text."""
        return self.spark.read.option("basePath", f"{self.path}/postings").schema(_POSTINGS).parquet(f"{self.path}/postings/load=*")

    def blocks(self) -> DataFrame:
        """term, lang, source, run, block, n, most, least_words, text_ids, load, folder."""
        return self.spark.read.option("basePath", f"{self.path}/blocks").schema(f"{_BLOCKS}, load string, folder int").parquet(f"{self.path}/blocks/load=*")

    def statistics(self) -> DataFrame:
        """lang, texts, mean_words over all that was added."""
        return self.postings().groupBy("lang").agg(F.count("*").alias("texts"), F.avg("n_words").alias("mean_words"))

    def search(self, questions: DataFrame, limit: int, among: DataFrame, analyzers: dict[str, Callable[[Column], Column]] | None = None) -> tuple[DataFrame, DataFrame]:
        """The limit best texts of each source for each of questions (qid, lang, text), and what was read for that.

        First: qid, source, text_id, score (BM25, six digits), the texts of among (text_id) in the question's language
        only; frequencies and lengths are those of all texts of the language. Second: blocks, blocks_read, texts, texts_scored,
        a row for each block of questions. Exact: a block is left unread only if no text of it can reach a score that enough
        texts of its source have for sure. A question without terms finds nothing. Each block of questions reads the index once.
        """
        asked = cut(questions.select("qid", "lang", F.explode(F.array_distinct(analyzed(F.col("text"), F.col("lang"), analyzers))).alias("term")))
        rounds = max(1, -(-asked.count() // QUESTION_TERMS))
        only, stats = cut(among.select("text_id").distinct()), {r.lang: (r.texts, r.mean_words) for r in self.statistics().collect()}
        found = report = None
        for r in range(rounds):
            own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == r)
            some, told = self._answered(own, limit, only, stats)
            found, report = (some, told) if found is None else (found.unionByName(some), report.unionByName(told))
        return found, report

    def _answered(self, asked: DataFrame, limit: int, only: DataFrame, stats: dict[str, tuple[int, float]]) -> tuple[DataFrame, DataFrame]:
        pairs = [tuple(r) for r in asked.select("qid", "lang", "term").collect()]
        folders = [r.folder for r in asked.select(_folder("term")).distinct().collect()]
        list_of = ["term", "lang", "source"]
        block_of = [*list_of, "load", "run", "block"]
        # The terms of one block of questions, of a stated number: only their lists go into a shuffle.
        own_terms = self.spark.createDataFrame(sorted({(t, x) for _, x, t in pairs if x is not None}), "term string, lang string")
        blocks = self.blocks().where(F.col("folder").isin(folders)).join(F.broadcast(own_terms), ["term", "lang"], "left_semi")
        sums = cut(blocks.select(*block_of, "n", "most", "least_words"))
        known = {}
        for row in sums.groupBy("term", "lang").agg(F.sum("n").alias("df")).collect():
            n, mean = stats[row.lang]
            known[row.term, row.lang] = math.log(1 + (n - row.df + 0.5) / (row.df + 0.5)), float(mean)
        terms = self.spark.createDataFrame([(t, x, *v) for (t, x), v in known.items()], "term string, lang string, idf double, mean_words double")
        bounded = sums.join(terms, ["term", "lang"]).select(*block_of, (F.col("idf") * weight(F.col("most"), F.col("least_words"), F.col("mean_words"))).alias("bound"))
        high = bounded.groupBy(*list_of).agg(F.max("bound").alias("high"))
        by_high = W.partitionBy("qid", "source").orderBy("high", "term")
        lists = asked.join(high, ["term", "lang"]).select("qid", *list_of, "high", F.sum("high").over(by_high).alias("up_to"), F.sum("high").over(W.partitionBy("qid", "source")).alias("all_high"))
        lists = cut(lists.withColumn("turn", F.row_number().over(W.partitionBy("qid", "source").orderBy(F.desc("high"), "term"))))

        def best(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
            """The limit best of the texts of blocks wanted, for all questions; and those texts."""
            texts = cut(blocks.join(wanted, block_of, "left_semi").select(F.explode("text_ids").alias("text_id")).distinct().join(only, "text_id", "left_semi"))
            scores = self.postings().join(texts, "text_id", "left_semi").mapInArrow(_scored(pairs, known, limit, to_arrow_schema(StructType.fromDDL(kind))), kind)
            order = W.partitionBy("qid", "source").orderBy(F.desc("score"), "text_id")
            return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit), texts

        kind = f"qid {dict(asked.dtypes)['qid']}, source string, text_id long, score double"
        rarest = lists.where(F.col("turn") <= FIRST_LISTS).select(*list_of).distinct()
        first = bounded.where("block = 0").join(rarest, list_of, "left_semi").select(*block_of)
        sure = best(first)[0].where(F.col("place") == limit).select("qid", "source", F.col("score").alias("sure"))
        aims = lists.join(sure, ["qid", "source"], "left").withColumn("sure", F.coalesce("sure", F.lit(0.0)) - ROUNDING)
        # A text that is in these lists only can't reach it; nor can one of a block that all other lists together don't lift to it.
        needs = aims.where("up_to >= sure").groupBy(*list_of).agg(F.min(F.col("sure") - (F.col("all_high") - F.col("high"))).alias("least"))
        wanted = cut(bounded.join(needs, list_of).where("bound >= least").select(*block_of))
        found, texts = best(wanted)
        report = sums.agg(F.count("*").alias("blocks")).crossJoin(wanted.agg(F.count("*").alias("blocks_read")))
        report = report.crossJoin(self.postings().agg(F.count("*").alias("texts"))).crossJoin(texts.agg(F.count("*").alias("texts_scored")))
        return found.drop("place"), report
