"""Operator 8, URL filters: dated list entries become validity intervals, joined as of each capture's fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, released

#: Most characters of a host name; longer ones can't be resolved and are no host.
LONGEST_HOST = 253
#: The parts of a URL before the host, the host (an IPv6 address stands in brackets), and an IPv4 address.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.%]+\]|[^/?#:@\[\]]+)"
IPV4 = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"


def host(url: Column) -> Column:
    """The host of `url` in lower case without user, port and the dot at its end; null where there is none.

    A name of more than LONGEST_HOST characters is none.
    """
    found = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")
    return F.when((found != "") & (F.length(found) <= LONGEST_HOST), found)


def domains(name: Column) -> Column:
    """`name` and its parents down to two labels; a name of one label, or an IP address, stands alone."""
    labels = F.split(name, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    parents = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(name.rlike(IPV4) | name.startswith("["), F.array(name)).otherwise(parents)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, since, until) from dated entries (domain, action, listed).

    An entry holds from its date until the domain's next one, until is null for the last. Of several entries of a
    domain with one date "block" wins over other actions, else the last by name; entries without domain, action or
    date are void. Domains are in lower case, a dot at the end of one doesn't count.
    """
    named = entries.select(F.regexp_replace(F.lower("domain"), r"\.$", "").alias("domain"), "action", "listed").dropna()
    one = named.groupBy("domain", "listed").agg(F.max_by("action", F.struct(F.col("action") == "block", "action")).alias("action"))
    return one.select("domain", "action", F.col("listed").alias("since"), F.lead("listed").over(Window.partitionBy("domain").orderBy("listed")).alias("until"))


def verdicts(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, at, rule, verdict) for the distinct pairs of (host, at) that an entry is active for.

    Of the entries active at the time the one for the longest domain decides. Both sides meet on domain and month: an
    interval lies in every month that it touches from the first fetch to the last, so a domain with a long history
    meets a capture only in the capture's month, and what was listed long before costs no more than what was listed
    then. A host's captures of one time are one row here; should those of one domain
    and month still be skewed, Spark splits them in the join.
    """
    month = lambda t: F.year(t) * 12 + F.month(t)
    each = asked.distinct().select("host", "at", month("at").alias("month"), F.explode(domains(F.col("host"))).alias("domain"))
    fetched = F.broadcast(asked.agg(F.min("at").alias("begin"), F.max("at").alias("end")))  # one row
    spans = intervals(entries).crossJoin(fetched).filter((F.col("since") <= F.col("end")) & (F.col("until").isNull() | (F.col("until") > F.col("begin"))))
    months = F.sequence(month(F.greatest("since", "begin")), month(F.least("end", F.coalesce("until", "end"))))
    active = spans.withColumn("month", F.explode(months)).drop("begin", "end")
    hits = each.join(active, ["domain", "month"]).filter((F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    best = hits.groupBy("host", "at").agg(F.max_by(F.struct(F.col("domain").alias("rule"), F.col("action").alias("verdict")), F.length("domain")).alias("best"))
    return best.select("host", "at", "best.*")


def listed_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Add host, rule (the listed domain that decides) and verdict (its action, "none" without an active entry).

    A verdict depends on host and fetch time only, so it is found once for each pair of these and joined back; rows
    need no numbers, and a row that is computed again gets the same verdict. Rows without host or fetch time get
    "none"; repeated rows are judged alike; an empty table gives an empty one, an empty list "none" everywhere. A
    very long URL is one expression's work, as hosts are bounded. Existing columns host, rule and verdict are
    replaced, others keep their names, whatever these are.
    """
    rows = held(captures, host=host(F.col(url)), at=F.col(fetched))
    found = verdicts(rows.select("host", "at").dropna(), entries)
    return released(rows.join(found, ["host", "at"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("none"))), "host", "rule", "verdict")
