"""Operator 2, personal data: an Aho-Corasick pass finds anchors, local parsers expand and validate the spans."""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Kinds in the order that digests list them; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
#: Fixed anchors: schemes that begin an address, and cues that an account or secret follows.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "api_key", "apikey", "iban", "passport", "passwd", "password", "secret", "ssn", "tax id", "token")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ADDRESS, HOST = re.compile(r"[^\s<>\"'`]+"), re.compile(r"[^\s<>\"'`/]+")
IDENTIFIER = re.compile(r"\s{0,3}(?:(?:no\.?|number|is)\s{1,3})?[:=#]?\s{0,3}[\"']?(?=[A-Za-z0-9](?:[ -]?[A-Za-z0-9_]){5})")
#: What an identifier is read as: an account code of up to 34 characters, a run without blanks, or digits.
CODE, SOLID, NUMBER = re.compile(r"[A-Za-z0-9](?:[ -]?[A-Za-z0-9]){14,33}"), re.compile(r"[A-Za-z0-9](?:-?[A-Za-z0-9_])*+"), re.compile(r"[0-9](?:[ -]?[0-9])*+")
DIGITS = "0123456789"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban_length(code: str) -> int:
    """Characters of the longest prefix of `code`, 15 to 34 letters and digits, whose check digits are right; 0 for none.

    The check is the remainder by 97 of the code with its first four characters behind the rest, letters as 10 to 35;
    it is carried from each prefix to the next.
    """
    if not re.match("[A-Z]{2}[0-9]{2}", code):
        return 0
    head = int("".join(str(int(c, 36)) for c in code[:4]))  # six digits
    best = rest = 0
    for n, c in enumerate(code[4:34], 5):
        value = int(c, 36)
        rest = (rest * (10 if value < 10 else 100) + value) % 97
        if n >= 15 and (rest * 1_000_000 + head) % 97 == 1:
            best = n
    return best


@cache
def anchors() -> ahocorasick.Automaton:
    """The automaton over all anchors; each worker builds it once."""
    found = ahocorasick.Automaton()
    for kind, strings in (("at", ["@"]), ("plus", ["+"]), ("digit", DIGITS), ("scheme", SCHEMES), ("cue", CUES)):
        for s in strings:
            found.add_word(s, (kind, len(s)))
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """Lower case with every code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def _account(text: str, cue: str, end: int, dry: int) -> tuple[tuple[int, int] | None, int]:
    """The identifier behind a cue, and up to where runs are known to hold none: a run that begins before `dry` is the
    rest of one that was read and is no identifier, so it isn't read once more."""
    m = IDENTIFIER.match(text, end)
    if not m:
        return None, dry
    start = m.end()
    if cue == "iban":
        code = CODE.match(text, start)
        at = [i for i, c in enumerate(code[0], 1) if c.isalnum()] if code else []
        n = iban_length("".join(c for c in code[0] if c.isalnum()).upper()) if code else 0  # the longest that the check digits confirm
        return ((start, start + at[n - 1]) if n else None), dry
    if start >= dry:
        solid = SOLID.match(text, start)[0]
        if sum(map(solid.count, DIGITS)) >= 4 and len(solid) >= 6:
            return (start, start + len(solid)), dry
        dry = start + len(solid)
    digits = NUMBER.match(text, start)
    return ((start, digits.end()) if digits and sum(c in DIGITS for c in digits[0]) >= 6 else None), dry


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start. Per kind matches are leftmost and don't overlap.

    A match that fails its validation is dropped and scanning goes on behind it. No part of a text is read more than a
    few times: what was read for nothing is remembered, or ends before the next anchor of its kind.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    behind, dry = dict.fromkeys(KINDS, 0), 0
    low = folded(text)
    for last, (kind, size) in anchors().iter(low):
        at = last - size + 1
        if kind == "digit":
            if at >= behind["ip"] and (at == behind["ip"] or text[at - 1] not in DIGITS) and (m := IP.match(text, at)):
                behind["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found["ip"].append(m.span())
            if at >= behind["card"] and (m := CARD.match(text, at)):
                behind["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif kind == "at":
            start = at
            while start > behind["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                behind["email"] = m.end()
                found["email"].append((start, m.end()))
        elif kind == "plus":
            if at >= behind["phone"] and (m := PHONE.match(text, at)):
                behind["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "scheme":
            if at >= behind["url"] and (m := HOST.match(text, last + 1)) and "." in m[0]:
                end = last + 1 + len(ADDRESS.match(text, last + 1)[0].rstrip(".,;:!?)]}"))
                if "." in text[last + 1 : end].split("/")[0]:
                    behind["url"] = end
                    found["url"].append((at, end))
        elif at >= behind["account"] and not (at and low[at - 1].isalnum()) and not low[last + 1 : last + 2].isalnum():
            span, dry = _account(text, low[at : last + 1], last + 1, dry)
            if span:
                behind["account"] = span[1]
                found["account"].append(span)
    return [(k, *span) for k in KINDS for span in found[k]]


@F.pandas_udf(StringType())
def _digest(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: ",".join(f"{k}:{a}:{b}" for k, a, b in find_spans(t or "")))


@F.pandas_udf(StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t and redact(t))


def redact(text: str) -> str:
    """`text` with each span as [KIND]; spans that overlap become one, named after the first of KINDS."""
    merged: list[list] = []
    for a, b, rank in sorted((a, b, KINDS.index(k)) for k, a, b in find_spans(text)):
        if merged and a < merged[-1][1]:
            merged[-1][1:] = max(b, merged[-1][1]), min(rank, merged[-1][2])
        else:
            merged.append([a, b, rank])
    out, at = [], 0
    for a, b, rank in merged:
        out += [text[at:a], f"[{KINDS[rank].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add `out`: all spans of the whole text as "kind:start:end" joined by commas, by kind as in KINDS, then start.

    Null and empty texts give an empty string, an empty table an empty one. Rows are independent, so ties and repeated
    rows need no rule; other columns, null or not, are kept, and a column named `out` is replaced. A very long text is
    scanned whole by one task, in time that grows with its length.
    """
    return docs.withColumn(out, _digest(F.col(text)))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span in `text` by its kind in brackets; null stays null and empty texts empty.

    Rows, repeated ones too, are independent; an empty table gives an empty one. Other columns are kept, whatever
    their names. A very long text is held by one task.
    """
    return docs.withColumn(text, _redacted(F.col(text)))


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    """The entries of personal_data()'s column that are of these kinds."""
    return F.filter(F.split(spans, ","), lambda s: F.substring_index(s, ":", 1).isin(*kinds))
