"""Scans, predicates and paging. Every filter is a column expression that Catalyst can push to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_owner(rows: DataFrame, owner: str, column: str = "owner_id") -> DataFrame:
    """A tenant's rows; to be applied before any other operator, so that a table partitioned by owner is pruned."""
    return rows.filter(F.col(column) == owner)


def status(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows of a status; "ALL" and None keep every row."""
    return rows if value in (None, "ALL") else rows.filter(F.col(column) == value)


def any_ilike(rows: DataFrame, query: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows with the query inside one of the columns, in any case. % and _ are wildcards; a blank query keeps all."""
    if not (query or "").strip():
        return rows
    hit = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return rows.filter(hit)


def json_equals(rows: DataFrame, column: str, path: str, value: str) -> DataFrame:
    """Rows whose JSON has this value, as text, at the path."""
    return rows.filter(F.get_json_object(column, path) == value)


def prefixed(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.filter(F.col(column).startswith(prefix))


def hard_filters(rows: DataFrame, required: Sequence[str] = (), minimum: float | None = None, category: str | None = None) -> DataFrame:
    """Rows with every required skill, enough years, and the category; a null category is UNCLASSIFIED."""
    if required:
        rows = rows.filter(F.size(F.array_except(F.array(*map(F.lit, required)), "skills")) == 0)
    if minimum is not None:
        rows = rows.filter(F.col("years") >= minimum)
    if category is not None:
        rows = rows.filter(F.coalesce("category", F.lit("UNCLASSIFIED")) == category)
    return rows


def warehouse_filters(rows: DataFrame, least: float | None = None, most: float | None = None, location: str | None = None, source: str | None = None, category: str | None = None, categories: Sequence[str] = ()) -> DataFrame:
    """Inclusive range of years, location that contains, source that equals, both folded; unknown categories are UNCLASSIFIED."""
    if least is not None:
        rows = rows.filter(F.col("years") >= least)
    if most is not None:
        rows = rows.filter(F.col("years") <= most)
    if location:
        rows = rows.filter(F.contains(F.lower("location"), F.lit(location.casefold())))
    if source:
        rows = rows.filter(F.lower("source") == source.casefold())
    if category:
        rows = rows.filter(F.coalesce("category", F.lit("UNCLASSIFIED")) == (category if category in categories else "UNCLASSIFIED"))
    return rows


def sandbox_allows(email: Column, enabled: bool, base: str, most: int, listed: Sequence[str] = ()) -> Column:
    """Whether mail may go out: the sandbox is off, or the address is listed, the base, or local+N@domain with N of 1 to `most`."""
    if not enabled:
        return F.lit(True)
    local, _, domain = base.lower().partition("@")
    address = F.lower(F.trim(email))
    number = F.regexp_extract(address, "^" + "".join(c if c.isalnum() else "\\" + c for c in local) + r"\+([0-9]{1,6})@" + "".join(c if c.isalnum() else "\\" + c for c in domain) + "$", 1)
    inside = (number != "") & F.coalesce(number.try_cast("int"), F.lit(0)).between(1, most)
    return address.isin(base.lower(), *(x.lower() for x in listed)) | inside


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows `offset` to `offset + limit` in an order that should end with a unique key."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def one_of(rows: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column has one of a few values, without duplicates of these; none keeps no row."""
    return rows.filter(F.col(column).isin(sorted(set(values)))) if values else rows.limit(0)
