"""Exports: shortlist reports, subject exports, annotation sets, and tenant-partitioned sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pseudonym


def shortlist_report(rows: DataFrame, job: str) -> DataFrame:
    """(job, text): a Markdown report with a section per shortlisted row, by place.

    Rows have place, name, score, recommendation, evidence and questions; at most 8 evidence lines and 7 questions.
    """
    bullets = lambda c, n: F.array_join(F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), lambda x: F.concat(F.lit("- "), x)), "\n")
    section = F.concat_ws(
        "\n", F.concat(F.lit("## "), F.col("place").cast("string"), F.lit(". "), "name"),
        F.concat(F.lit("Score: "), F.col("score").cast("string"), F.lit(" ("), F.coalesce("recommendation", F.lit("-")), F.lit(")")),
        F.lit("### Evidence"), bullets(F.col("evidence"), 8), F.lit("### Questions"), bullets(F.col("questions"), 7),
    )
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", section.alias("s")))), lambda p: p["s"])
    return rows.groupBy(job).agg(F.concat(F.lit("# Shortlist\n\n"), F.array_join(parts, "\n\n")).alias("text"))


def subject_export(subjects: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """(key, json): each subject with all its children nested by table name."""
    out = subjects
    for name, rows in children.items():
        nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c != key)))).alias(name))
        out = out.join(nested, key, "left")
    return out.select(key, F.to_json(F.struct(*out.columns)).alias("json"))


def annotation_pairs(queries: DataFrame, corpus: DataFrame, key: str, salt: str) -> DataFrame:
    """Every query with every pseudonymous document and a null label: the set that annotators fill in.

    The full product is the export itself; the queries are a handful, chosen by a person, and are broadcast.
    """
    docs = corpus.select(pseudonym("cv_", salt, F.col(key)).alias("document"))
    return docs.crossJoin(F.broadcast(queries)).withColumn("label", F.lit(None).cast("int"))


def write_by_owner(rows: DataFrame, path: str, owner: str = "owner_id") -> None:
    """Append rows under owner folders, so that scans of one owner read its files only."""
    rows.write.mode("append").partitionBy(owner).parquet(path)


def seed(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Seed rows whose key isn't there yet, the first of each: what an idempotent load appends."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def fingerprint(files: DataFrame) -> DataFrame:
    """(path, sha256) of a binaryFile table, to compare with a stored manifest."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def drifted(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths whose content differs from the manifest's, new and vanished ones included."""
    old = manifest.select("path", F.col("sha256").alias("_old"))
    return fingerprint(files).join(old, "path", "full").filter(~F.col("sha256").eqNullSafe(F.col("_old"))).select("path")
