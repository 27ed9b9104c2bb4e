"""Operator 12, filter interaction audit: exploded words give totals and distincts, flags meet in 32 conditional counts."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spaced, written

#: The filters, one bit each of a document's mask of failures.
FILTERS = "ABCDE"
#: Fewest words, least percent of distinct words and most percent of capitals that pass, and characters that fail.
WORDS, DISTINCT, CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"


def _identified(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    digest = F.coalesce(F.unhex(F.sha2(value, 256)), F.lit(b""))  # never null, so that no join computes it once more to see whether it is
    return docs.select(F.col(doc_id).alias("doc_id"), digest.alias("digest"), value.alias("text"), *more)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_words, n_distinct) of every different (id, text) that has words; digest is the text's SHA-256.

    Repeated rows are combined before anything is shuffled. Texts are dealt once, by id and digest; the exploded words
    are then counted by (id, digest, word) and by (id, digest) where they are, without another exchange. A word of a
    hot id or text costs as much as any other.
    """
    one = _identified(docs, doc_id, text).dropDuplicates(["doc_id", "digest"])
    words = one.select("doc_id", "digest", F.explode(F.split(spaced(F.col("text")), " ")).alias("word")).filter("word <> ''")
    by_word = words.groupBy("doc_id", "digest", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("doc_id", "digest").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, copies, mask, good, toxic): rows of one id, part and text are one with their number.

    Bit i of mask is set where the i-th filter fails: A too few words, B too few different ones, C too many capitals,
    D a mark, E a text that a smaller id has. good and toxic tell whether any label of the id says so.
    """
    value = F.col("text")
    capitals = F.length(value) - F.length(F.regexp_replace(value, "[A-Z]+", ""))
    own = _identified(docs, doc_id, text, F.coalesce(F.col(part), F.lit("")).alias("part"))
    own = own.select("doc_id", "part", "digest", (100 * capitals > CAPITALS * F.length(value)).alias("c"), value.rlike(MARKS).alias("d"))
    rows = written(own.groupBy("doc_id", "part", "digest", "c", "d").agg(F.count("*").alias("copies")), "flags")
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least")
    said = labels.groupBy(F.col("doc_id").alias("said_id")).agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))))
    counts = word_counts(docs, doc_id, text).toDF("counted_id", "counted", "n_words", "n_distinct")
    met = rows.join(counts, F.col("doc_id").eqNullSafe(F.col("counted_id")) & (F.col("digest") == F.col("counted")), "left")
    met = met.join(shared.withColumnRenamed("digest", "text_of"), F.col("digest") == F.col("text_of"), "left").join(said, F.col("doc_id") == F.col("said_id"), "left")
    total, different = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    failed = (total < WORDS, 100 * different < DISTINCT * total, F.col("c"), F.col("d"), F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)))
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)), F.lit(0))
    return met.select("doc_id", "part", "copies", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _orders(k: int) -> list[tuple[int, str, int, int, int]]:
    """(number, filter_order, step, bit, before) of every step of every order; before has the bits of the earlier steps."""
    names = ("".join(p) for p in permutations(FILTERS[:k]))
    steps = [(o, s, 1 << FILTERS.index(o[s]), sum(1 << FILTERS.index(x) for x in o[:s])) for o in names for s in range(k)]
    return [(i, o, s + 1, bit, before) for i, (o, s, bit, before) in enumerate(steps)]


def interactions(masks: DataFrame) -> DataFrame:
    """Every part's row for each of the 600 steps of the 120 orders of the filters, from (part, copies, mask, good, toxic).

    A part is one row of 32 conditional counts for each of all, good and toxic documents: whatever the orders ask for
    is a sum over these. Parts without a failure have zeros; no documents give no rows.
    """
    size = 1 << len(FILTERS)
    count = lambda name, of: F.array(*(F.coalesce(F.sum(F.when((F.col("mask") == m) & of, F.col("copies"))), F.lit(0)) for m in range(size))).alias(name)
    cells = masks.groupBy("part").agg(count("n", F.lit(True)), count("g", F.col("good")), count("t", F.col("toxic")))
    orders = _orders(len(FILTERS))
    steps = cells.sparkSession.createDataFrame(orders, "number int, filter_order string, step int, bit int, before int")  # 600 rows
    rows = cells.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))).join(F.broadcast(steps), "number")
    over = lambda of, test, value=lambda n, m: n: F.aggregate(F.filter(F.transform(F.col(of), lambda n, m: F.when(test(m), value(n, m)).otherwise(F.lit(0).cast("long"))), lambda n: n > 0), F.lit(0).cast("long"), lambda s, n: s + n)
    hit, earlier = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: hit(m) & ~earlier(m)
    turns = F.lit(len(orders) // len(FILTERS))
    return rows.select(
        "part", "filter_order", "step",
        over("n", lambda m: ~hit(m) & ~earlier(m)).alias("kept"),
        over("n", here).alias("removed"),
        over("n", lambda m: hit(m) & earlier(m)).alias("redundant"),
        over("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        over("g", here).alias("good_lost"),
        over("t", here).alias("toxic_lost"),
        over("n", hit, lambda n, m: (n * turns / F.bit_count(m)).cast("long")).alias("shapley"),  # a mask of b bits goes to each of them in 1 of b orders
    )


def interaction_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each filter removes, in every order of the five, by part: see failures() and interactions().

    Null texts are empty and null parts the empty string; a row with a null id is no copy of a smaller id and has no
    labels; repeated rows count as often as they occur; an id with several labels has what any of them says. A very
    long text's words are rows like any other's. An empty table gives an empty one, other columns don't matter.
    """
    return interactions(failures(docs, labels, doc_id, text, part))
