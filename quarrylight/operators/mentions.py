"""Names of a vocabulary table found in text: an automaton over whole tokens, then joins and windows over its matches.

Tasks scan clauses in Arrow batches and emit matches only; whether a name of daily use counts is decided by Spark from
what stands around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .joins import dealt

#: A token: letters and digits, with marks inside and plus or number signs behind.
TOKEN = re.compile(r"[^\W_]++(?:[.+#/'&-]++[^\W_]++)*+[+#]*+")
#: Characters before and behind a match in which cues and denying words are looked for, and most between two names of
#: one list.
AROUND, GAP = 40, 14
#: Fixed words that join the names of a list, folded, and heads before a colon that announce one.
JOINERS = ("and", "or", "va", "hoac", "voi", "cung", "plus", "nhu", "as", "including")
LISTS = re.compile(r"^[\s•·*-]*([^:]{0,40}):")
LIST_HEADS = re.compile(r"\b(?:skills?|tools?|stack|technologies|languages?|ky nang|cong nghe|ngon ngu)\b")
#: Characters of aliases in one automaton, some tens of MB of memory; a larger vocabulary takes one pass over the text
#: for each so many.
BLOCK = 4_000_000
#: Columns that a vocabulary may have beside alias, name, kind and category: spellings that an alias in doubt must have
#: (none: it is never in doubt), words near it that settle the doubt, and words right before or behind it that deny it.
RULES = ("forms", "cues", "deny_before", "deny_after")


def _blocks(words: DataFrame) -> list[int]:
    """Numbers of the vocabulary's blocks."""
    size = words.agg(F.sum(F.length("alias") + 1)).first()[0] or 0
    return list(range(-(-size // BLOCK)))


def beside(rows: DataFrame, words: DataFrame) -> DataFrame:
    """`rows` joined to a table of aliases: broadcast if these fill no more than one block, else both are dealt by alias.
    Without a hint Spark may broadcast the rows, as it knows no size of a local table."""
    return rows.join(F.broadcast(words), "alias") if len(_blocks(words)) <= 1 else dealt(rows).join(dealt(words), "alias")


def _automaton(aliases: list[str]) -> ahocorasick.Automaton:
    """The aliases' tokens between spaces, with their number and the aliases that have these tokens."""
    lines: dict[str, tuple[int, list[str]]] = {}
    for alias in aliases:
        if tokens := TOKEN.findall(alias):
            lines.setdefault(f" {' '.join(tokens)} ", (len(tokens), []))[1].append(alias)
    machine = ahocorasick.Automaton()
    for line, held in lines.items():
        machine.add_word(line, held)
    machine.make_automaton()
    return machine


def matched(folded: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, int, int, str]]:
    """(place, n, start, end, alias) of every alias in a clause: token number, tokens, and characters.

    A name's possessive counts as the name; names joined by a slash count one by one, with n of 0, unless the whole is
    a name.
    """
    tokens = TOKEN.findall(folded)
    if not tokens or not len(machine):
        return []
    line = f" {' '.join(tokens)} "
    hits = [(line, end, found) for end, found in machine.iter(line)]
    if "'s " in line:
        owned = line.replace("'s ", " ")
        hits += [(owned, end, found) for end, found in machine.iter(owned)]
    slashed = [i for i, t in enumerate(tokens) if "/" in t] if "/" in line else []
    if not hits and not slashed:
        return []
    spans, out = [m.span() for m in TOKEN.finditer(folded)], []
    for text in dict.fromkeys(h[0] for h in hits):
        ends = {at: i for i, at in enumerate(m.start() for m in re.finditer(" ", text))}  # a space before and behind each token
        for _, end, (n, named) in (h for h in hits if h[0] is text):
            i = ends[end] - n
            out += [(i, n, spans[i][0], spans[i + n - 1][1], alias) for alias in named]
    for i in slashed:
        at = spans[i][0]
        for w in tokens[i].split("/"):
            if found := machine.get(f" {w} ", None):
                out += [(i, 0, at, at + len(w), alias) for alias in found[1]]
            at += len(w) + 1
    return out


def _scan(parts: DataFrame, aliases, keep: list[str]) -> DataFrame:
    """(keep, place, n, start, end, alias, form, before, after, listed) of every match of the broadcast aliases."""
    kept = [f for f in parts.schema if f.name in keep]
    added = StructType.fromDDL("place int, n int, start int, end int, alias string, form string, before string, after string, listed boolean")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(aliases.value)
        for batch in batches:
            rows, at = [], []
            texts = zip(batch.column("original").to_pylist(), batch.column("folded").to_pylist())
            for row, (original, folded) in enumerate(texts):
                found = matched(folded, machine)
                if found:
                    head = LISTS.match(folded)
                    listed = bool(head and LIST_HEADS.search(head.group(1)))
                    rows += [(p, n, a, b, alias, original[a:b], folded[max(0, a - AROUND) : a], folded[b : b + AROUND], listed) for p, n, a, b, alias in found]
                    at += [row] * len(found)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(pa.array(at)) for f in kept), *columns], names=[*(f.name for f in kept), *added.names])

    return parts.mapInArrow(scan, StructType([*kept, *added.fields]))


def ruled(words: DataFrame) -> DataFrame:
    """A vocabulary with all RULES columns, empty where it has none."""
    none = F.array().cast("array<string>")
    return words.select("alias", "name", "kind", "category", *(F.coalesce(F.col(c), none).alias(c) if c in words.columns else none.alias(c) for c in RULES))


def _near(around: Column, cues: Column) -> Column:
    """Whether one of the cues stands in a text, as whole words."""
    padded = F.concat(F.lit(" "), F.regexp_replace(around, r"[^\p{L}\p{N}+#]+", " "), F.lit(" "))
    return F.exists(cues, lambda c: F.contains(padded, F.concat(F.lit(" "), c, F.lit(" "))))


def _joined(gap: Column) -> Column:
    """Whether the text between two names is that of a list: marks, and one joining word at most."""
    plain = F.trim(F.regexp_replace(gap, r"[\s,;/|&+•·()\[\]:–—-]+", " "))
    return plain.isin("", *JOINERS)


def mentions(parts: DataFrame, words: DataFrame, key: str, skills: tuple[str, ...]) -> DataFrame:
    """(key, line, clause, place, n, start, end, before, after, name, kind, category): longest alias matches over whole
    tokens of clauses, with their places in the clause and what stands around them.

    `words` is a vocabulary table of any size and with aliases of any length: alias (folded), name, kind, category,
    and RULES. An alias in doubt counts in one of its spellings, where no denying word stands next to it and its clause
    begins like a list of skills or has a cue near it; or, unless a word before it denies it, in an unbroken list
    (nothing but marks and a joining word between neighbours, over the lines of bullets, too) with a name of kind
    `skills` that is certain or accepted so: the list is an island of matches, so it vouches both ways at any length.
    Inside foo.js and the like a name isn't a token at all. Null texts have no clauses; a vocabulary without rows finds
    nothing. A clause is held by one task; matches are dealt by the key once.
    """
    spark, listed = parts.sparkSession, ruled(words)
    numbers = _blocks(listed)
    keep = [key, "line", "clause"]
    found = None
    for number in numbers:
        own = [r["alias"] for r in listed.filter(F.pmod(F.xxhash64("alias"), F.lit(len(numbers))) == number).select("alias").distinct().collect()]  # BLOCK characters
        hits = _scan(parts, spark.sparkContext.broadcast(own), keep)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return parts.select(*keep).limit(0).select(*keep, *(F.lit(None).cast(t).alias(c) for c, t in (*((c, "int") for c in ("place", "n", "start", "end")), *((c, "string") for c in ("before", "after", "name", "kind", "category")))))
    clause = Window.partitionBy(*keep)
    top = found.repartition(key).withColumn("_m", F.max("n").over(clause.partitionBy(*keep, "place"))).filter("n = _m").drop("_m")
    reach = F.max(F.col("place") + F.greatest("n", F.lit(1))).over(clause.orderBy("place").rangeBetween(Window.unboundedPreceding, -1))
    free = top.withColumn("_reach", F.coalesce(reach, F.lit(0))).filter("place >= _reach").drop("_reach")
    named = beside(free, listed).dropDuplicates([*keep, "place", "name", "kind"])
    doubt = F.size("forms") > 0
    spelled = named.filter(~doubt | F.array_contains("forms", F.col("form")))
    behind, before = F.ltrim("after"), F.concat(F.lit(" "), F.rtrim("before"))
    letter = r"[\p{L}\p{N}]"
    denied_behind = F.exists("deny_after", lambda w: F.startswith(behind, w) & ~F.substring(behind, F.length(w) + 1, 1).rlike(letter))
    denied_before = F.exists("deny_before", lambda w: F.endswith(before, w) & ~F.substring(before, F.length(before) - F.length(w), F.lit(1)).rlike(letter))
    cued = ~denied_behind & ~denied_before & (F.col("listed") | _near(F.concat("before", F.lit(" "), "after"), F.col("cues")))
    alone = F.when(doubt, cued).otherwise(True)
    order = Window.partitionBy(key).orderBy("line", "clause", "place", F.desc("start"), "name")
    last = lambda c: F.lag(c).over(order)
    same = (last("line") == F.col("line")) & (last("clause") == F.col("clause"))
    between = F.col("start") - last("end")
    inside = F.when(between <= 0, F.lit("")).when(between <= GAP, F.expr("substring(before, greatest(1, length(before) - (start - _end) + 1))"))
    across = F.when((F.col("line") - last("line") <= 1) & (F.length(last("after")) + F.col("start") <= GAP), F.concat(last("after"), F.lit(" "), "before"))
    told = spelled.withColumn("_alone", alone).withColumn("_doubt", doubt).withColumn("_stopped", denied_before & doubt & ~F.col("_alone")).withColumn("_end", last("end"))
    gapped = told.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_gap", F.when(F.col("_same"), inside).otherwise(across)).withColumn("_was", last("_stopped"))
    islands = gapped.withColumn("_island", F.sum(F.when(F.coalesce(_joined(F.col("_gap")), F.lit(False)) & ~F.col("_stopped") & ~F.col("_was"), 0).otherwise(1)).over(order))
    vouched = F.max(F.col("_alone") & F.col("kind").isin(*skills)).over(Window.partitionBy(key, "_island"))
    return islands.withColumn("_vouched", vouched).filter(F.col("_alone") | F.col("_vouched")).select(*keep, "place", "n", "start", "end", "before", "after", "name", "kind", "category")
