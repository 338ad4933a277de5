"""Scores of retrieval runs: recall, reciprocal rank, resampled intervals, sign flips, gates.

Random draws come from digests of (round, place), so that every engine and every rerun draws alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.operators import retrieval as rt


def first_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """qid, first: rank of the first result that answers, null for none.

    results: qid, key, rank; expected: qid, answer. A key answers if it is the answer or lies below it
    (colon path): keys are spread over their ancestors, which makes the prefix join an equi-join.
    """
    parts = F.split("key", ":")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))
    spread = results.select("qid", "rank", F.explode(above).alias("answer"))
    hit = spread.join(expected, ["qid", "answer"]).groupBy("qid").agg(F.min("rank").alias("first"))
    return expected.select("qid").distinct().join(hit, "qid", "left")


def scores(hits: DataFrame, *by: str) -> DataFrame:
    """recall at 5 and 10 and mean reciprocal rank of hits (qid, first), to 4 places."""
    share = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 4)
    mrr = F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4)
    return hits.groupBy(*by).agg(F.count("*").alias("n"), share(5).alias("recall_5"), share(10).alias("recall_10"), mrr.alias("mrr"))


def _drawn(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("#", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def _numbered(groups: DataFrame) -> DataFrame:
    # One row a topic of an evaluation set: dozens.
    return groups.withColumn("i", F.row_number().over(W.orderBy("group")) - 1).withColumn("n", F.count("*").over(W.partitionBy()))


def interval(groups: DataFrame, rounds: int = 2000) -> DataFrame:
    """low, high: 95 % interval of sum(hits) / sum(total) of groups (group, hits, total) drawn with replacement."""
    own = _numbered(groups)
    draws = own.select("n", F.col("i").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    draws = draws.withColumn("i", _drawn(F.col("round"), F.col("place")) % F.col("n"))
    rates = draws.join(own.select("i", "hits", "total"), "i").groupBy("round").agg((F.sum("hits") / F.sum("total")).alias("rate"))
    at = F.array_sort(F.collect_list(F.round("rate", 4)))  # as many numbers as rounds
    low, high = int(0.025 * rounds), min(int(0.975 * rounds), rounds - 1)
    return rates.agg(at.alias("r")).select(F.col("r")[low].alias("low"), F.col("r")[high].alias("high"))


def chance_of_gain(changes: DataFrame, rounds: int = 10_000) -> DataFrame:
    """measured, chance: how often changes (group, change) of random sign sum up to the measured gain or more."""
    own = changes.select("group", "change").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    flipped = F.when(_drawn(F.col("round"), F.col("group")) % 2 == 0, F.col("change")).otherwise(-F.col("change"))
    sums = own.groupBy("round").agg(F.sum(flipped).alias("s"), F.sum("change").alias("measured"))
    chance = (F.count_if(F.col("s") >= F.col("measured")) + 1) / (F.lit(rounds) + 1)
    found = sums.agg(F.max("measured").alias("measured"), F.round(chance, 6).alias("c"))
    return found.select("measured", F.when(F.col("measured") <= 0, 1.0).otherwise(F.col("c")).alias("chance"))


def compared(before: DataFrame, after: DataFrame, k: int = 5) -> DataFrame:
    """Per qid of two runs (qid, first): gained, lost, same, or only in one of them."""
    hit = lambda side: F.coalesce(F.col(f"{side}.first") <= k, F.lit(False))
    both = before.alias("b").join(after.alias("a"), F.col("b.qid") == F.col("a.qid"), "full")
    state = (
        F.when(F.col("b.qid").isNull(), "new").when(F.col("a.qid").isNull(), "gone")
        .when(hit("a") & ~hit("b"), "gained").when(hit("b") & ~hit("a"), "lost").otherwise("same")
    )
    return both.select(F.coalesce("a.qid", "b.qid").alias("qid"), state.alias("state"))


def gate(measured: DataFrame, published: DataFrame) -> DataFrame:
    """name, verdict: regression where a measured value falls below the published interval's floor."""
    verdict = F.when(F.col("floor").isNull(), "unpublished").when(F.col("value") < F.col("floor"), "regression").otherwise("ok")
    return measured.join(published, "name", "left").select("name", verdict.alias("verdict"))


MODIFIERS = ("normative", "questions", "rerank")


def configurations(grid: DataFrame) -> DataFrame:
    """configuration, base, modifiers, problem of a grid (base, modifiers): combinations that can't be run are named, not dropped.

    base: keyword, meaning, or a fusion rule with its parameter. Questions need a meaning list; a modifier is named once, and is one of MODIFIERS.
    """
    has = lambda m: F.array_contains("modifiers", m)
    name = F.concat_ws("+", "base", F.array_join(F.array_sort("modifiers"), "+"))
    problem = (
        F.when(F.size(F.array_except("modifiers", F.array(*[F.lit(m) for m in MODIFIERS]))) > 0, "unknown modifier")
        .when(has("questions") & (F.col("base") == "keyword"), "no meaning list")
        .when(F.size(F.array_distinct("modifiers")) < F.size("modifiers"), "named twice")
    )
    return grid.select(F.regexp_replace(name, r"\+$", "").alias("configuration"), "base", "modifiers", problem.alias("problem"))


def run_configurations(grid: DataFrame, lists: DataFrame, expected: DataFrame, fresh: Column, depth: int = 25) -> DataFrame:
    """configuration, problem, n, recall_5, recall_10, mrr: every valid configuration of grid (base, modifiers) run over the same candidate lists.

    lists: retriever (keyword, meaning, questions), normative (whether only such clauses are in it), qid, key, score, rank;
    expected: qid, answer; fresh: a score of key for reranking the head. Parameters are columns: all configurations are fused,
    reranked and scored in one plan, and the lists are made once, whatever the grid. Configurations with a problem have no scores.
    """
    told = configurations(grid)
    has = lambda m: F.array_contains("modifiers", m)
    valid = told.where("problem is null").select("configuration", "base", *[has(m).alias(m) for m in MODIFIERS]).withColumnRenamed("normative", "only_normative")
    both = lists.where("retriever <> 'keyword'").select(F.struct("normative", "qid").alias("qid"), "retriever", "key", "score")
    lifted = rt.z_scores(both).groupBy("qid", "key").agg(F.round(F.max("z"), 5).alias("score"))
    own = lists.where("retriever <> 'questions'").select("retriever", "normative", "qid", "key", "score")
    each = own.unionByName(lifted.select(F.lit("blended").alias("retriever"), "qid.normative", "qid.qid", "key", "score"))
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("retriever", "normative", "qid").orderBy(F.desc("score"), "key")))
    wanted = F.when(F.col("retriever") == "keyword", F.col("base") != "meaning").otherwise((F.col("base") != "keyword") & (F.col("questions") == (F.col("retriever") == "blended")))
    used = each.join(F.broadcast(valid), F.col("only_normative") == F.col("normative")).where(wanted)
    run = F.struct("configuration", "rerank", "qid").alias("qid")
    used = used.select("base", run, F.when(F.col("retriever") == "keyword", "keyword").otherwise("meaning").alias("retriever"), "key", "score", "rank")
    found = used.where(F.col("base").isin("keyword", "meaning")).select("qid", "key", "score")
    for rule in sorted({r.base for r in valid.select("base").distinct().collect()} - {"keyword", "meaning"}):
        found = found.unionByName(rt.fusion(rule)(used.where(F.col("base") == rule)).select("qid", "key", "score"))
    ranked = rt.ranked(found, rt.CANDIDATES)
    head = F.col("qid.rerank") & (F.col("rank") <= depth)
    order = W.partitionBy("qid").orderBy(F.when(head, 0).otherwise(1), F.when(head, fresh).desc(), "rank")
    results = ranked.select(F.struct("qid.configuration", "qid.qid").alias("qid"), "key", F.row_number().over(order).alias("rank"))
    answers = expected.crossJoin(F.broadcast(valid.select("configuration"))).select(F.struct("configuration", "qid").alias("qid"), "answer")
    scored = scores(first_hits(results, answers).select(F.col("qid.configuration").alias("configuration"), "first"), "configuration")
    return told.select("configuration", "problem").join(scored, "configuration", "left")


def pooled(outcomes: DataFrame) -> DataFrame:
    """topic, hits, total over all sets of outcomes (set, id, first): the topic is what follows the last slash of an id, a ``-chat`` ending aside."""
    topic = F.regexp_replace(F.regexp_extract("id", r"([^/]*)$", 1), "-chat$", "")
    hit = F.count_if(F.coalesce(F.col("first") <= 5, F.lit(False)))
    return outcomes.groupBy(topic.alias("topic")).agg(hit.alias("hits"), F.count("*").alias("total"))


def judged(before: DataFrame, after: DataFrame, k: int = 5) -> DataFrame:
    """set, gained, lost, kept of runs (set, id, topic, first): topics' sums of hits compared; kept: no topic worse, or more gained than lost."""
    hits = lambda df, name: df.groupBy("set", "topic").agg(F.count_if(F.coalesce(F.col("first") <= k, F.lit(False))).alias(name))
    change = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    both = hits(before, "b").join(hits(after, "a"), ["set", "topic"], "full").select("set", change.alias("c"))
    sums = both.groupBy("set").agg(F.sum(F.greatest("c", F.lit(0))).alias("gained"), F.sum(F.greatest(-F.col("c"), F.lit(0))).alias("lost"))
    return sums.withColumn("kept", F.col("gained") >= F.col("lost"))


def answered_in_full(parts: DataFrame) -> DataFrame:
    """question, answered: whether every part of a question (question, hit) was hit."""
    return parts.groupBy("question").agg(F.bool_and("hit").alias("answered"))


def last_attempts(runs: DataFrame) -> DataFrame:
    """The last scored attempt of each (task, run): task, run, passed."""
    return runs.where("passed is not null").groupBy("task", "run").agg(F.max_by("passed", "attempt").alias("passed"))


def consistency(attempts: DataFrame) -> DataFrame:
    """task, passed (share of its runs), verdict: every, some or none of them passed."""
    verdict = F.when(F.bool_and("passed"), "every").when(F.bool_or("passed"), "some").otherwise("none")
    return attempts.groupBy("task").agg(F.round(F.avg(F.col("passed").cast("int")), 4).alias("share"), verdict.alias("verdict"))


def audited(questions: DataFrame) -> DataFrame:
    """id, verdict of questions (id, article, quote, note, evidence): cited, justified or rejected.

    A quote that its source (evidence) doesn't hold is rejected; where the quote, or else the source, names the article
    the question is cited; else a note justifies it.
    """
    told = F.coalesce("quote", "evidence")
    names = F.col("article").isNotNull() & F.expr("coalesce(quote, evidence) rlike concat('\\\\b(?:Article|Art\\\\.)\\\\s*', article, '\\\\b')")
    missing = F.col("quote").isNotNull() & ~F.contains("evidence", "quote")
    verdict = F.when(missing, "rejected").when(told.isNotNull() & names, "cited").when(F.col("note").isNotNull(), "justified").otherwise("rejected")
    return questions.select("id", verdict.alias("verdict"))


#: Fixed value: how likely a change may be by chance alone, shared by the sets that are looked at.
CHANCE = 0.05


def unpaired(before: DataFrame, after: DataFrame) -> DataFrame:
    """pack, set, id, problem of questions that can't be judged: asked twice in a run, or in one of the runs only."""
    keys = ["pack", "set", "id"]
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(before, "b").join(count(after, "a"), keys, "full")
    problem = F.when((F.col("b") > 1) | (F.col("a") > 1), "twice").when(F.col("a").isNull(), "only before").when(F.col("b").isNull(), "only after")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def _chances(changes: DataFrame, *by: str, rounds: int) -> DataFrame:
    """by, chance: how often the changes (by, topic, change) of a group sum up to as much when each takes a random sign. Sums are compared to 12 places."""
    own = changes.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    flipped = F.when(_drawn(F.col("round"), F.col("topic")) % 2 == 0, F.col("change")).otherwise(-F.col("change"))
    sums = own.groupBy(*by, "round").agg(F.sum(flipped).alias("s"), F.sum("change").alias("measured"))
    found = sums.groupBy(*by).agg(F.max("measured").alias("m"), F.round((F.count_if(F.col("s") >= F.col("measured") - 1e-12) + 1) / F.lit(rounds + 1), 6).alias("c"))
    return found.select(*by, F.when(F.col("m") <= 1e-12, 1.0).otherwise(F.col("c")).alias("chance"))


def _paired(before: DataFrame, after: DataFrame) -> DataFrame:
    now = after.select("pack", "set", "id", F.col("score").alias("now"), F.col("hit").alias("hit_now"))
    return before.select("pack", "set", "id", "topic", "score", "hit").join(now, ["pack", "set", "id"])


def set_changes(before: DataFrame, after: DataFrame, rounds: int = 10_000) -> DataFrame:
    """A row for each set of two runs (pack, set, id, topic, score, hit): questions, hits and mean scores of both, chance_of_loss, worse.

    A topic asked in several forms moves as one: its changes are added up before signs are drawn. A set is worse if its
    score falls by more than chance explains; the chance allowed is divided by the number of sets. Unpaired questions are left out
    (``unpaired`` names them).
    """
    both = _paired(before, after)
    told = both.groupBy("pack", "set").agg(
        F.count("*").alias("questions"), F.count_if("hit").alias("hits_before"), F.count_if("hit_now").alias("hits_after"),
        F.round(F.avg("score"), 9).alias("score_before"), F.round(F.avg("now"), 9).alias("score_after"),
    )
    lost = both.groupBy("pack", "set", "topic").agg((F.sum("score") - F.sum("now")).alias("change"))
    chance = _chances(lost, "pack", "set", rounds=rounds).withColumnRenamed("chance", "chance_of_loss")
    sets = told.agg(F.count("*").alias("sets"))  # one row
    worse = (F.col("score_after") < F.col("score_before")) & (F.col("chance_of_loss") < CHANCE / F.col("sets"))
    return told.join(chance, ["pack", "set"]).crossJoin(F.broadcast(sets)).withColumn("worse", worse).drop("sets")


def judgement(before: DataFrame, after: DataFrame, rounds: int = 10_000) -> DataFrame:
    """One row for two runs (pack, set, id, topic, score, hit): questions, topics, hits, topics_found, topics_lost, chance, worse_sets, unpaired, kept.

    A topic is one of its pack, in all its sets. kept: the gain is more than chance gives and no set is worse; null if questions are
    unpaired, or there are none.
    """
    both = _paired(before, after)
    topics = both.groupBy("pack", "topic").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("was"), F.count_if("hit_now").alias("is"), (F.sum("now") - F.sum("score")).alias("change")
    )
    told = topics.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("questions"), F.count("*").alias("topics"), F.coalesce(F.sum("was"), F.lit(0)).alias("hits_before"), F.coalesce(F.sum("is"), F.lit(0)).alias("hits_after"),
        F.count_if(F.col("is") > F.col("was")).alias("topics_found"), F.count_if(F.col("is") < F.col("was")).alias("topics_lost"),
    )
    named = topics.select(F.concat_ws("/", "pack", "topic").alias("topic"), "change")
    # Each of these is one row.
    chance = _chances(named.withColumn("all", F.lit(1)), "all", rounds=rounds).agg(F.max("chance").alias("chance"))
    worse = set_changes(before, after, rounds).agg(F.count_if("worse").alias("worse_sets"))
    odd = unpaired(before, after).agg(F.count("*").alias("unpaired"))
    one = told.crossJoin(F.broadcast(chance)).crossJoin(F.broadcast(worse)).crossJoin(F.broadcast(odd))
    kept = F.when((F.col("unpaired") == 0) & (F.col("questions") > 0), (F.col("chance") < CHANCE) & (F.col("worse_sets") == 0))
    return one.withColumn("kept", kept)


def rates(measured: DataFrame, rounds: int = 2000) -> DataFrame:
    """group, runs, hits, share, low, high of measured (group, task, hit): a 95 % interval of the share, tasks drawn with all their runs together.

    Null hits aren't measured; a task without any is no task here.
    """
    own = measured.where("hit is not null").groupBy("group", "task").agg(F.count_if("hit").alias("hits"), F.count("*").alias("runs"))
    own = own.withColumn("i", F.row_number().over(W.partitionBy("group").orderBy("task")) - 1).withColumn("n", F.count("*").over(W.partitionBy("group")))
    draws = own.select("group", "n", F.col("i").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    draws = draws.select("group", "round", (_drawn(F.col("round"), F.col("place")) % F.col("n")).alias("i"))
    drawn = draws.join(own.select("group", "i", "hits", "runs"), ["group", "i"]).groupBy("group", "round").agg(F.round(F.sum("hits") / F.sum("runs"), 4).alias("rate"))
    ends = drawn.groupBy("group").agg(F.array_sort(F.collect_list("rate")).alias("r"))  # as many numbers as rounds
    low, high = int(0.025 * rounds), min(int(0.975 * rounds), rounds - 1)
    told = own.groupBy("group").agg(F.sum("runs").alias("runs"), F.sum("hits").alias("hits"), F.round(F.sum("hits") / F.sum("runs"), 4).alias("share"))
    return told.join(ends.select("group", F.col("r")[low].alias("low"), F.col("r")[high].alias("high")), "group")


def trigger_scores(tasks: DataFrame, outcomes: DataFrame, rounds: int = 2000) -> DataFrame:
    """A row for each group of tasks (task, group): how many, the rate of runs that called with its interval, tasks that called in every, some or no run,
    and the rate of runs that called before an edit with its interval.

    outcomes: task, run, attempt, scored, called, before_edit; the last scored attempt of a run counts. A group without scored runs has null rates.
    """
    last = outcomes.where("scored").groupBy("task", "run").agg(F.max_by(F.struct("called", "before_edit"), "attempt").alias("o"))
    runs = tasks.select("task", "group").join(last, "task").select("group", "task", F.col("o.called").alias("called"), F.col("o.before_edit").alias("before_edit"))
    called = rates(runs.withColumnRenamed("called", "hit"), rounds).withColumnRenamed("hits", "calls")
    early = rates(runs.withColumnRenamed("before_edit", "hit"), rounds).select("group", *[F.col(c).alias(f"early_{c}") for c in ("share", "low", "high")])
    verdicts = runs.groupBy("group", "task").agg(F.bool_and("called").alias("a"), F.bool_or("called").alias("o"))
    counts = verdicts.groupBy("group").agg(F.count_if("a").alias("every"), F.count_if(~F.col("a") & F.col("o")).alias("some"), F.count_if(~F.col("o")).alias("none"))
    told = tasks.groupBy("group").agg(F.count_distinct("task").alias("tasks"))
    return told.join(called, "group", "left").join(counts, "group", "left").join(early, "group", "left")


def log_disagreements(outcomes: DataFrame) -> DataFrame:
    """task, run whose last scored attempt (answered, sent, log_rows) doesn't fit the log.

    The log holds at least the calls that were answered and at most those sent: a run may stop with a call under way. Without a count
    of rows nothing is known.
    """
    last = outcomes.where("scored").groupBy("task", "run").agg(F.max_by(F.struct("answered", "sent", "log_rows"), "attempt").alias("o"))
    return last.where("not (o.log_rows between o.answered and o.sent)").select("task", "run")
