"""Document sources: files as rows, the upload guard, text extraction, and a paged remote listing as a data source."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import flat, normal_lines, redact_blank
from ..operators.joins import spread

SUFFIXES = ("pdf", "docx", "txt")
LEAST_CHARS = 20


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content, suffix): every file below a path as a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "content", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"))


def pdf_text(data: bytes, layout: bool = True) -> str:
    """Text of a PDF, page by page; a page of fewer than 3 words in layout mode is read plainly. Needs pypdf."""
    from pypdf import PdfReader

    pages = []
    for page in PdfReader(io.BytesIO(data)).pages:
        text = page.extract_text(extraction_mode="layout") if layout else ""
        pages.append(text if len(text.split()) >= 3 else page.extract_text() or "")
    return "\n".join(pages)


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file by line. Needs python-docx."""
    from docx import Document

    return "\n".join(p.text for p in Document(io.BytesIO(data)).paragraphs)


def plain_text(content: Column) -> Column:
    """UTF-8 text without a byte order mark; bytes that aren't UTF-8 become replacement characters."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


def strict_error(content: Column) -> Column:
    """Why a file can't be read as UTF-8 text where no character may be replaced; null where it can."""
    return F.when(~F.is_valid_utf8(content.cast("string")), "UNREADABLE: bytes that aren't UTF-8")


def extract(files: DataFrame, layout: bool = True, strict: bool = False) -> DataFrame:
    """Adds raw_text and error: plain text in the JVM, PDF and DOCX in Arrow batches.

    `strict` refuses text files with bytes that aren't UTF-8: they get an error, for guard() to reject.
    """

    @F.pandas_udf("raw string, error string")
    def parse(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for kind, data in zip(suffix, content):
            try:
                out.append((pdf_text(data, layout) if kind == "pdf" else docx_text(data), None))
            except Exception as e:  # a damaged file, or a parser that isn't installed, is a rejected row
                out.append((None, f"UNREADABLE: {type(e).__name__}"))
        return pd.DataFrame(out, columns=["raw", "error"])

    text = files.filter(~F.col("suffix").isin("pdf", "docx")).withColumns({"raw_text": plain_text(F.col("content")), "error": strict_error(F.col("content")) if strict else F.lit(None).cast("string")})
    other = files.filter(F.col("suffix").isin("pdf", "docx")).withColumn("_p", parse("suffix", "content"))
    return text.unionByName(other.withColumns({"raw_text": F.col("_p.raw"), "error": F.col("_p.error")}).drop("_p"))


def guard(files: DataFrame, most_mb: int = 10) -> DataFrame:
    """Adds text, checksum and reason: null for an accepted file, else why it is rejected.

    Reasons in this order: UNSUPPORTED_TYPE, TOO_LARGE, UNREADABLE, NO_TEXT (fewer than 20 characters).
    """
    text = normal_lines(F.coalesce("raw_text", F.lit("")))
    reason = (
        F.when(~F.col("suffix").isin(*SUFFIXES), "UNSUPPORTED_TYPE")
        .when(F.col("length") > most_mb * 1024 * 1024, "TOO_LARGE")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.length(F.col("text")) < LEAST_CHARS, "NO_TEXT")
    )
    return files.withColumns({"text": text, "checksum": F.sha2("content", 256)}).withColumn("reason", reason)


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and comments dropped, tags as blanks, five common entities resolved."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return flat(out)


def hard_chunks(docs: DataFrame, key: str, text: str, size: int = 900) -> DataFrame:
    """(key, ordinal, chunk): the text cut every `size` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    place = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    return docs.select(key, F.col(text).alias("_t"), place.alias("ordinal")).select(key, "ordinal", F.substring("_t", F.col("ordinal") * size + 1, F.lit(size)).alias("chunk"))


def greedy_groups(items: Column, size: Column, joiner: int, most: int) -> Column:
    """Array of arrays: items packed in order into groups whose sizes, with joiners, stay within `most` beyond `size`.

    A single item that doesn't fit is a group of its own, as is one that begins with ALONE.
    """
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), size.cast("int").alias("n"))

    def step(s, x):
        more = F.length(x) + F.when(F.size(s["now"]) > 0, F.lit(joiner)).otherwise(0)
        alone = x.startswith("\x01") | F.coalesce(F.get(s["now"], F.lit(0)).startswith("\x01"), F.lit(False))
        full = (F.size(s["now"]) > 0) & ((s["n"] + more > most) | alone)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(x)).otherwise(F.concat(s["now"], F.array(x))).alias("now"),
            F.when(full, size.cast("int") + F.length(x)).otherwise(s["n"] + more).cast("int").alias("n"),
        )

    return F.aggregate(items, empty, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def section_chunks(docs: DataFrame, key: str, text: str, most: int = 900) -> DataFrame:
    """(key, section, ordinal, chunk) of a search document with a "label: a; b" line for each section.

    Values of a line are packed in order within `most` characters, the label and joiners counted.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    parts = lines.select(
        key, "line_no",
        F.when(F.contains("line", F.lit(":")), F.trim(F.substring_index("line", ":", 1))).otherwise(F.trim("line")).alias("label"),
        F.when(F.contains("line", F.lit(":")), F.trim(F.regexp_replace("line", "^[^:]*:", ""))).otherwise(F.trim("line")).alias("body"),
    ).filter("body <> ''")
    values = F.filter(F.transform(F.split("body", ";"), lambda v: F.trim(v)), lambda v: v != "")
    groups = parts.select(key, "line_no", "label", F.posexplode(greedy_groups(values, F.length("label") + 2, 2, most)).alias("group_no", "group"))
    section = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("other"))
    named = groups.withColumn("section", section)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key, "section").orderBy("line_no", "group_no")) - 1
    return named.select(key, "section", place.alias("ordinal"), F.concat("label", F.lit(": "), F.array_join("group", "; ")).alias("chunk"))


#: Fixed pattern: paragraphs end at blank lines and before short lines that begin with a capital.
PARAGRAPH = r"(?m)\n{2,}|(?=^[A-ZĐÁÀẢÃẠĂÂÊÔƠƯ][^\n]{2,50}:?$)"
#: Stands before a piece that shares its chunk with no other.
ALONE = "\x01"


def paragraph_chunks(docs: DataFrame, key: str, text: str, most: int = 900, cap: int | None = None) -> DataFrame:
    """(key, ordinal, chunk): paragraphs of whole texts packed within `most` characters, longer ones cut every `most`.

    `cap` is the reference's input limit for callers who ask for it: a text's first chunks only.
    """
    paragraphs = F.filter(F.transform(F.split(text, PARAGRAPH), lambda p: F.trim(p)), lambda p: p != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.ceil(F.length(p) / most).cast("int") - 1), lambda i: F.concat(F.lit(ALONE), F.trim(F.substring(p, i * most + 1, F.lit(most)))))
    pieces = F.filter(F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(cut(p)))), lambda p: p != ALONE)
    groups = greedy_groups(pieces, F.lit(0), 1, most)
    if cap is not None:
        groups = F.slice(groups, 1, cap)
    return docs.select(key, F.posexplode(groups).alias("ordinal", "group")).select(key, "ordinal", F.replace(F.array_join("group", "\n"), F.lit(ALONE), F.lit("")).alias("chunk"))


SECTIONS = ("specialization", "roles", "level", "canonical skills", "certifications", "experience years", "industries", "responsibilities", "projects", "impact", "education", "professional summary")


def search_document(sections: dict[str, Column], redact: Callable[[Column], Column]) -> Column:
    """A line "label: a; b" for each section with values, in the fixed order of SECTIONS, each value redacted."""
    lines = []
    for label in SECTIONS:
        if label in sections:
            values = F.filter(F.transform(sections[label], redact), lambda v: v != "")
            lines.append(F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, "; "))))
    return F.concat_ws("\n", *lines)


#: Fixed version of the search document's form, part of what its digest covers.
TEMPLATE = "search-document-v1"


def document_digest(text: Column, template: str = TEMPLATE) -> Column:
    """SHA-256 of the canonical JSON of a search document: keys in order, a blank behind colon and comma."""
    escaped = F.substring(F.to_json(F.struct(text.alias("t"))), 6, 1 << 30)  # {"t":"..."} from its quote on
    return F.sha2(F.concat(F.lit(f'{{"template": "{template}", "text": '), escaped), 256)


def searchable(rows: DataFrame, key: str, sections: dict[str, Column], private: Column, template: str = TEMPLATE) -> DataFrame:
    """(key, text, content_hash): search documents of all SECTIONS, and a digest that changes when the text does.

    Each value loses e-mail addresses, phone numbers and the values in `private`; equal values of a section count
    once, in order, without regard to case; nulls and blanks don't count.
    """
    def once(values: Column) -> Column:
        trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
        first = lambda clean: F.filter(clean, lambda v, i: ~F.exists(F.slice(clean, F.lit(1), i), lambda w: F.lower(w) == F.lower(v)))
        return F.transform(F.array(trimmed), first)[0]  # trimmed once, not for each value

    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"no sections: {sorted(unknown)}")
    text = search_document({k: once(v) for k, v in sections.items()}, lambda v: redact_blank(v, private))
    return spread(rows, key).select(key, text.alias("text")).withColumn("content_hash", document_digest(F.col("text"), template))


class PagedListing(DataSource):
    """A remote listing read page by page: option "fetch" names module:function, "size" the rows of a page.

    fetch(page, size) returns a list of (id, checksum, payload) rows; a page of fewer rows than the size is the last.
    Option "tasks", 8 by default, many tasks read every so-many-th page each. A page that fails is fetched again up to
    "retries" times, 3 by default, before its task fails; a task that Spark runs again reads its pages anew.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "id string, checksum string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.size, self.tasks = options["fetch"], int(options.get("size", 100)), int(options.get("tasks", 8))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from importlib import import_module

        module, _, function = self.fetch.partition(":")
        fetch, page = getattr(import_module(module), function), partition.value
        while rows := self._page(fetch, page):
            yield from rows
            if len(rows) < self.size:
                return
            page += self.tasks

    def _page(self, fetch: Callable, page: int) -> list[tuple]:
        for left in range(self.retries, -1, -1):
            try:
                return fetch(page, self.size)
            except Exception:
                if not left:
                    raise
