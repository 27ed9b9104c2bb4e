"""Nested evaluation sets of retrieval, read from JSON and checked: what is usable as tables, the rest as rejections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A set: its version, the documents searched, and the queries with a grade for each document that is relevant.
SCHEMA = """
    dataset_version string,
    corpus array<struct<id: string, document: string, skills: array<string>, experience_years: double>>,
    queries array<struct<id: string, text: string, language: string, role_family: string, required_skills: array<string>, preferred_skills: array<string>, minimum_experience: double, relevance: map<string, int>>>,
    _corrupt string"""
#: Least and largest grade of a judgment.
GRADES = (0, 3)


def read_sets(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """(dataset_version, corpus, queries, _corrupt): a row for each JSON document, a file each or, without `multiline`,
    a line each. What isn't JSON of this form has its text in _corrupt."""
    return spark.read.schema(SCHEMA).option("multiLine", multiline).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def evaluation_sets(sets: DataFrame) -> dict[str, DataFrame]:
    """The tables documents, queries and judgments of all sets, and "rejected" (dataset, part, item, reason).

    A set that can't be parsed or has no version is rejected as a whole. In the others a document or query without id
    or text is, all but one of those that share an id in a set are, and judgments whose grade is missing or outside
    GRADES or whose document isn't in the set's corpus. A set is one row; what is exploded from it spreads over tasks
    by set and id. Empty lists give no rows.
    """
    whole = sets.filter("_corrupt is null and dataset_version is not null")
    bad = sets.filter("_corrupt is not null or dataset_version is null").select(F.col("dataset_version").alias("dataset"), F.lit("set").alias("part"), F.lit(None).cast("string").alias("item"), F.when(F.col("_corrupt").isNotNull(), "not a set").otherwise("no version").alias("reason"))

    def items(column: str, text: str) -> tuple[DataFrame, DataFrame]:
        each = whole.select(F.col("dataset_version").alias("dataset"), F.posexplode(column).alias("_at", "_i")).select("dataset", "_at", "_i.*")
        empty = F.coalesce(F.trim(text), F.lit("")) == ""
        named = each.withColumn("reason", F.when(F.coalesce("id", F.lit("")) == "", "no id").when(empty, "no text"))
        first = named.filter("reason is null").groupBy("dataset", "id").agg(F.min("_at").alias("_first"))
        told = named.join(first, ["dataset", "id"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_at") > F.col("_first"), "id used before")))
        part = "document" if column == "corpus" else "query"
        return told.filter("reason is null").drop("reason", "_at", "_first"), told.filter("reason is not null").select("dataset", F.lit(part).alias("part"), F.col("id").alias("item"), "reason")

    documents, no_documents = items("corpus", "document")
    queries, no_queries = items("queries", "text")
    graded = queries.select("dataset", F.col("id").alias("query"), F.explode("relevance").alias("document", "grade"))
    known = documents.select("dataset", F.col("id").alias("document"), F.lit(True).alias("_known"))
    reason = F.when(F.col("grade").isNull() | ~F.col("grade").between(*GRADES), "grade").when(F.col("_known").isNull(), "unknown document")
    judged = graded.join(known, ["dataset", "document"], "left").withColumn("reason", reason)
    wrong = judged.filter("reason is not null").select("dataset", F.lit("judgment").alias("part"), F.concat_ws("/", "query", "document").alias("item"), "reason")
    return {
        "documents": documents, "queries": queries.drop("relevance"), "judgments": judged.filter("reason is null").select("dataset", "query", "document", "grade"),
        "rejected": bad.unionByName(no_documents).unionByName(no_queries).unionByName(wrong),
    }
