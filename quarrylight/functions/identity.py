"""Name and e-mail address of a résumé's owner, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EMAIL

#: Fixed words that a name line doesn't have.
NOT_NAMES = r"(?i)(?<![\p{L}\p{N}_])(cv|curriculum|vitae|resume|h[oồ] s[oơ]|ứng viên|engineer|developer|intern|manager|senior|junior|lead)(?![\p{L}\p{N}_])"
UNKNOWN = "Ứng viên chưa xác định"


def first_email(text: Column) -> Column:
    return F.substring(F.regexp_extract(F.coalesce(text, F.lit("")), EMAIL, 0), 1, 320)


def _lines(text: Column) -> Column:
    clean = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^[ |—\\-·•]+|[ |—\\-·•]+$", ""))
    return F.filter(clean, lambda x: x != "")


def looks_like_name(line: Column) -> Column:
    """2 to 6 words that all begin with a letter, without digits, contact marks and job words."""
    words = F.split(line, " ")
    shape = F.length(line).between(2, 60) & ~line.rlike(r"[\d@:•|/\\]") & F.size(words).between(2, 6) & ~line.rlike(NOT_NAMES)
    return shape & F.forall(words, lambda w: w.rlike(r"^\p{L}"))


def person_name(text: Column, file_name: Column) -> Column:
    """The first of 8 lines that looks like a name; else a name whose words stand on lines of their own; else the first
    line without digits and at-signs; else the file's stem. At most 200 characters."""
    lines = _lines(text)
    head = F.slice(lines, 1, 8)
    strict = F.get(F.filter(head, looks_like_name), F.lit(0))
    top = F.slice(lines, 1, 6)
    word = lambda x: x.rlike(r"^\p{L}{2,20}$")
    run = F.filter(top, lambda x, i: F.forall(F.slice(top, F.lit(1), i + 1), word))
    joined = F.transform(F.sequence(F.lit(5), F.lit(2)), lambda n: F.when(F.size(run) >= n, F.array_join(F.slice(run, F.lit(1), n), " ")))
    scattered = F.size(F.filter(F.slice(lines, 1, 12), lambda x: F.contains(x, F.lit(" ")))) <= 2
    split = F.when(scattered, F.get(F.filter(joined, lambda x: x.isNotNull() & looks_like_name(x)), F.lit(0)))
    lax = F.get(F.filter(head, lambda x: F.length(x).between(2, 80) & ~x.rlike(r"[@\d]")), F.lit(0))
    stem = F.trim(F.translate(F.regexp_replace(F.coalesce(F.nullif(file_name, F.lit("")), F.lit(UNKNOWN)), r"^.*/|\.[^./]*$", ""), "_-", "  "))
    return F.substring(F.coalesce(strict, split, lax, stem), 1, 200)
