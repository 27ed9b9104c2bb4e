"""Text scalars: tokens, folding, normal forms, redaction, templates. Built from JVM functions but where noted."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed patterns of personal data. The look-behind only spares the other starts inside a run of local characters,
#: which end at the same at-sign; without it the time grows with the square of a run.
EMAIL = r"(?i)\b(?<![A-Z0-9_][.%+-]{0,64})[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<![\p{L}\p{N}_])(?:\+?\d[\s().-]*){8,15}(?![\p{L}\p{N}_])"
#: Spellings of skills whose punctuation is kept.
PROTECTED = ("c++", "c#", ".net", "f#", "node.js")


def casefold(text: Column) -> Column:
    """Lower case, with the one letter of the supported languages that folds to two."""
    return F.lower(F.replace(text, F.lit("ß"), F.lit("ss")))


def tokens(text: Column) -> Column:
    """Distinct words of two or more characters, folded, in order of first appearance."""
    found = F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query's tokens that the document has; 0 for a query without tokens."""
    return F.size(F.array_intersect(query, doc)) / F.greatest(F.lit(1), F.size(query))


def has_word(low: Column, word: str) -> Column:
    """Whether a folded text has a word: only where it holds these characters are the ends of the word looked at."""
    escaped = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)
    return F.contains(low, F.lit(word)) & low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){escaped}(?![\p{{L}}\p{{N}}_])")


def word_overlap(text: Column, words: list[str]) -> Column:
    """overlap() of a query's few tokens with those of a text, which isn't cut into its own."""
    if not words:
        return F.lit(0.0)
    low = F.transform(F.array(casefold(F.coalesce(text, F.lit("")))), lambda t: sum((has_word(t, w).cast("int") for w in words), F.lit(0)))  # the text is folded once
    return low[0] / len(words)


def _fold_table() -> tuple[str, str]:
    """Letters of the Latin blocks and the letter without marks that each becomes, plus đ and blanks."""
    pairs = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    pairs = {a: b.lower() for a, b in pairs.items() if b != a and len(a.lower()) == 1}
    pairs |= {"đ": "d", "Đ": "d", "\t": " ", "\r": " ", "\u00a0": " "}
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics, one character for one, blanks as spaces; line breaks stay."""
    source, target = _fold_table()
    return F.lower(F.translate(text, source, target))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normal form, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def skill_name(text: Column, normal_form: bool = True) -> Column:
    """A skill's key: folded, with protected spellings whole, else without blanks, dots, dashes and underscores."""
    low = F.trim(F.regexp_replace(casefold(nfkc(text) if normal_form else text), r"\s+", " "))
    return F.when(low.isin(*PROTECTED), low).otherwise(F.regexp_replace(low, r"[\s._-]", ""))


def email_key(text: Column) -> Column:
    low = casefold(F.trim(text))
    return F.when(low != "", low)


def phone_key(text: Column) -> Column:
    """Digits in national form: 84 before 9 or 10 more becomes 0; null unless 9 to 11 digits remain."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    local = F.when(digits.startswith("84") & F.length(digits).between(11, 12), F.concat(F.lit("0"), F.substring(digits, 3, 20))).otherwise(digits)
    return F.when(F.length(local).between(9, 11), local)


def redact_blank(text: Column, values: Column | None = None) -> Column:
    """Text without e-mail addresses, phone numbers and the given values in any case (longest first), blanks squeezed."""
    out = F.regexp_replace(F.regexp_replace(text, EMAIL, " "), PHONE, " ")
    if values is not None:
        ordered = F.transform(F.sort_array(F.transform(F.filter(values, lambda v: F.length(v) > 0), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
        out = F.aggregate(ordered, out, lambda t, v: F.regexp_replace(t, F.concat(F.lit("(?i)"), F.regexp_replace(v, r"([^\p{L}\p{N}\s])", r"\\$1")), F.lit(" ")))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def redact_tags(text: Column, name: Column | None = None) -> Column:
    """Text with a name, e-mail addresses and phone numbers as tags."""
    out = text if name is None else F.when(F.length(name) > 0, F.replace(text, name, F.lit("[CANDIDATE_NAME]"))).otherwise(text)
    return F.regexp_replace(F.regexp_replace(out, EMAIL, "[EMAIL]"), PHONE, "[PHONE]")


def normal_lines(text: Column) -> Column:
    """Each line with blanks squeezed and trimmed, without empty lines."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda line: F.trim(F.regexp_replace(line, "[ \\t\u00a0]+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\\s\u00a0]+", " "))


def version_file_name(name: Column, version: Column, suffix: Column) -> Column:
    """A file name from a person's name, at most 120 characters of it, and a version number."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", "")
    stem = F.when(stem == "", F.lit("candidate")).otherwise(F.substring(stem, 1, 120))
    return F.concat(stem, F.lit("_CV_v"), version.cast("string"), suffix)


def render(template: Column, values: dict[str, Column]) -> Column:
    """Replace {{name}} by its value; names without one become empty."""
    for name, value in values.items():
        template = F.regexp_replace(template, F.lit(r"\{\{\s*" + name + r"\s*\}\}"), F.coalesce(F.regexp_replace(value.cast("string"), r"([\\$])", r"\\$1"), F.lit("")))
    return F.regexp_replace(template, r"\{\{[^}]*\}\}", "")


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """The first 32 bits of the key's SHA-256 modulo `buckets`."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % buckets


def pseudonym(prefix: str, salt: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value.cast("string")), 256), 1, 16))


def token_estimate(text: Column, used: Column) -> Column:
    """A quarter of the characters, one at least, where a model was used; else 0."""
    return F.when(used, F.greatest(F.lit(1), F.floor(F.length(text) / 4))).otherwise(0).cast("long")


def model_json(text: Column) -> Column:
    """The JSON part of a model's answer: inside a code fence, else from the first brace to the last; null if neither."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(braced != "", braced)


def quoted(quote: Column, source: Column) -> Column:
    """Whether a quote occurs in its source, folded; empty quotes don't."""
    low = casefold(F.trim(quote))
    return (F.length(low) > 0) & F.contains(casefold(source), low)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID of RFC 9562: SHA-1 of the namespace's bytes and the name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def stable_json(columns: dict[str, Column]) -> Column:
    """A JSON object of the columns with its keys in order and nulls kept, so that equal values give equal text."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def flattened(values: Column, fields: list[str]) -> Column:
    """For each struct of an array its fields that aren't blank, joined by a comma; structs without any go."""
    clean = lambda s: F.filter(F.array(*(F.trim(s[f]) for f in fields)), lambda v: v != "")
    return F.filter(F.transform(values, lambda s: F.array_join(clean(s), ", ")), lambda v: v != "")


def valid_answer(answer: Column, known: list[str], lists: list[str], least: int = 5) -> Column:
    """Whether a model's answer is usable: JSON, see model_json(), with `least` of the known fields, whose `lists` hold
    strings only."""
    body = model_json(answer)
    keys = F.json_object_keys(body)
    enough = F.size(F.array_intersect(keys, F.array(*map(F.lit, known)))) >= least
    strings = F.lit(True)
    for name in lists:
        found = F.get_json_object(body, f"$.{name}")
        items = F.from_json(found, "array<string>")
        strings &= found.isNull() | (items.isNotNull() & (F.regexp_count(found, F.lit(r'"(?:[^"\\\\]|\\\\.)*"')) == F.size(items)))
    return F.coalesce(keys.isNotNull() & enough & strings, F.lit(False))


def verified_claims(claims: Column, source: Column, ids: Column, kinds: list[str]) -> Column:
    """Of an array of (id, kind, quote, confidence) those with a known id and kind whose quote is in the source;
    confidences are brought to 0..1."""
    kept = F.filter(claims, lambda c: F.array_contains(ids, c["id"]) & c["kind"].isin(kinds) & quoted(c["quote"], source))
    return F.transform(kept, lambda c: c.withField("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c["confidence"], F.lit(0.0))))))
