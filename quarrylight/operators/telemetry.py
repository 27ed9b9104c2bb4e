"""Operational telemetry: counts, percentiles, reports, service levels, quotas, canaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled_counts(rows: DataFrame, status: str, statuses: list[str]) -> DataFrame:
    """(status, n) with a row for every listed status, also those without rows; others are left out."""
    listed = rows.sparkSession.createDataFrame([(s,) for s in statuses], f"{status} string")
    counts = rows.filter(F.col(status).isin(statuses)).groupBy(status).agg(F.count("*").alias("n"))  # as few rows as statuses
    return listed.join(F.broadcast(counts), status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(p: float, value: str) -> Column:
    """Nearest-rank percentile as an aggregate, for groups that are small: it holds a group's distinct values. For any
    size there is nearest_ranks()."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def floor_index_rows(rows: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """(key, p_value): the value at index floor((n - 1) * p) of each key, without collecting a group."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    over = Window.partitionBy(key)
    placed = counts.withColumns({"upto": F.sum("n").over(over.orderBy(value)), "all": F.sum("n").over(over)})
    return placed.filter(F.col("upto") > F.floor((F.col("all") - 1) * p)).groupBy(key).agg(F.min(value).alias("p_value"))


def since(rows: DataFrame, time: str, now: Column, hours: int) -> DataFrame:
    return rows.filter((F.col(time) >= now - F.expr(f"interval {hours} hours")) & (F.col(time) <= now))


def operations_report(tasks: DataFrame, steps: DataFrame, outbox: DataFrame, approvals: DataFrame, now: Column, hours: int) -> DataFrame:
    """A row per owner: success rate, latencies, outbox and approval counts, and whether operation is degraded.

    Tasks, steps and outbox counts lie in the window; the due backlog and approvals don't depend on it. The rate is
    null without finished tasks.
    """
    done, failed = F.count_if(F.col("status") == "COMPLETED"), F.count_if(F.col("status") == "FAILED")
    a = since(tasks, "created_at", now, hours).groupBy("owner").agg(F.count("*").alias("tasks"), done.alias("completed"), failed.alias("failed"))
    a = a.withColumn("success_rate", F.when(F.col("completed") + F.col("failed") > 0, F.round(F.col("completed") / (F.col("completed") + F.col("failed")), 4)))
    b = nearest_ranks(since(steps, "created_at", now, hours), ["owner"], "latency", {"p50": 0.5, "p95": 0.95})
    bad = F.col("status").isin("FAILED", "BLOCKED")
    window = (F.col("created_at") >= now - F.expr(f"interval {hours} hours")) & (F.col("created_at") <= now)
    c = outbox.groupBy("owner").agg(F.count_if(window & bad).alias("outbox_failed"), F.count_if((F.col("status") == "PENDING") & (F.col("available_at") <= now)).alias("due_backlog"))
    pending = F.col("status") == "PENDING"
    d = approvals.groupBy("owner").agg(F.count_if(pending).alias("pending"), F.count_if(pending & (F.col("created_at") < now - F.expr("interval 24 hours"))).alias("stale"))
    out = a.join(b, "owner", "full").join(c, "owner", "full").join(d, "owner", "full").na.fill(0, ["tasks", "completed", "failed", "outbox_failed", "due_backlog", "pending", "stale"])
    return out.withColumn("degraded", (F.col("outbox_failed") > 0) | (F.col("due_backlog") > 0) | (F.col("stale") > 0))


def search_quality(events: DataFrame, grades: DataFrame) -> DataFrame:
    """One row: searches, share of fallbacks, mean latency, grade histogram 0 to 3 and share of grades from 2."""
    a = events.agg(
        F.count("*").alias("searches"),
        F.round(F.coalesce(F.avg((F.coalesce("fallback", F.lit("")) != "").cast("double")), F.lit(0.0)), 4).alias("fallback_rate"),
        F.round(F.avg("latency"), 4).alias("avg_latency"),
    )
    b = grades.agg(*(F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in range(4)), F.round(F.avg((F.col("grade") >= 2).cast("double")), 4).alias("positive_rate"))
    return a.crossJoin(F.broadcast(b))


def batch_rollup(items: DataFrame, batch: str, status: str) -> DataFrame:
    """A batch's status from its items': PROCESSING, FAILED, PARTIAL or COMPLETED, with the counts."""
    out = items.groupBy(batch).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(s.lower()) for s in ("COMPLETED", "FAILED", "SKIPPED")))
    terminal = F.col("completed") + F.col("failed") + F.col("skipped")
    state = (
        F.when(terminal < F.col("total"), "PROCESSING")
        .when((F.col("failed") > 0) & (F.col("completed") + F.col("skipped") == 0), "FAILED")
        .when(F.col("failed") > 0, "PARTIAL")
        .otherwise("COMPLETED")
    )
    return out.withColumn("state", state)


def budget_percent(used: Column, limit: Column) -> Column:
    return F.when(limit > 0, F.round(used / limit * 100, 2)).otherwise(100.0)


def slo_breaches(report: DataFrame, policy: dict[str, float]) -> DataFrame:
    """(owner, signal, severity, observed, threshold) of every service level that an owner's report breaks.

    Comparisons are strict but for budgets, which break on reaching the warning percentage. A null doesn't break.
    Budgets need used_ and limit_ columns of screenings, tokens and cost_micros.
    """
    rules = [
        ("screening_success_rate", "CRITICAL", "success_rate", "min_success_rate", False),
        ("screening_p95_latency", "WARNING", "p95", "max_p95", True),
        ("outbox_due_backlog", "CRITICAL", "due_backlog", "max_due_outbox", True),
        ("outbox_failures", "CRITICAL", "outbox_failed", "max_failed_outbox", True),
        ("stale_approvals", "WARNING", "stale", "max_stale_approvals", True),
    ]
    made = []
    for signal, severity, column, key, above in rules:
        seen, bound = F.col(column).cast("double"), F.lit(float(policy[key]))
        made.append((signal, severity, seen, bound, seen > bound if above else seen < bound))
    for kind in ("screenings", "tokens", "cost_micros"):
        if f"used_{kind}" in report.columns:
            seen, bound = budget_percent(F.col(f"used_{kind}"), F.col(f"limit_{kind}")), F.lit(float(policy["budget_warning_percent"]))
            made.append((f"budget_{kind}", "WARNING", seen, bound, seen >= bound))
    signals = F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(v).alias("severity"), o.alias("observed"), t.alias("threshold"), F.coalesce(b, F.lit(False)).alias("broken")) for s, v, o, t, b in made))
    return report.select("owner", F.inline(signals)).filter("broken").drop("broken")


def canary_reasons(base: str, new: str, policy: dict[str, float]) -> Column:
    """Array of the reasons that block a candidate, from struct columns of baseline and candidate telemetry.

    Both hold samples, success_rate, p95_latency_ms, cost_per_screening_micros and outbox_failures. Regressions of
    latency and cost count only against a baseline above 0.
    """
    b, c = (lambda x: F.coalesce(F.col(f"{base}.{x}"), F.lit(0))), (lambda x: F.coalesce(F.col(f"{new}.{x}"), F.lit(0)))
    grown = lambda x, key: (b(x) > 0) & (c(x) > b(x) * (1 + policy[key] / 100))
    rules = [
        ("too few samples", c("samples") < policy["min_canary_samples"]),
        ("success rate below the service level", c("success_rate") < policy["min_success_rate"]),
        ("success rate dropped", b("success_rate") - c("success_rate") > policy["max_success_rate_drop"]),
        ("latency above the service level", c("p95_latency_ms") > policy["max_p95"]),
        ("latency regressed", grown("p95_latency_ms", "max_latency_regression_percent")),
        ("cost regressed", grown("cost_per_screening_micros", "max_cost_regression_percent")),
        ("outbox failures", c("outbox_failures") > 0),
    ]
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)))


def promotable(gates: DataFrame, alerts: DataFrame, ready: Column) -> DataFrame:
    """Adds promotable: the gate is allowed, the owner has no open critical alert, and is ready."""
    open_ = alerts.filter((F.col("severity") == "CRITICAL") & F.col("status").isin("OPEN", "ACKNOWLEDGED")).select("owner").distinct().withColumn("_open", F.lit(True))
    allowed = (F.col("status") == "PROMOTION_ALLOWED") & F.col("_open").isNull() & ready
    return gates.join(open_, "owner", "left").withColumn("promotable", allowed).drop("_open")


def rate_window(events: DataFrame, owner: str, time: str, key: str, limit: int) -> DataFrame:
    """Adds minute and accepted: the first `limit` events of an owner's minute, by time and key, are accepted."""
    minute = F.date_format(time, "yyyyMMddHHmm")
    order = Window.partitionBy(owner, "minute").orderBy(time, key)
    return events.withColumn("minute", minute).withColumn("accepted", F.row_number().over(order) <= limit)


def monthly_usage(usage: DataFrame, owner: str, time: str, amount: str) -> DataFrame:
    """(owner, period, used, n): totals by calendar month; negative amounts count as 0."""
    return usage.groupBy(owner, F.date_format(time, "yyyy-MM").alias("period")).agg(F.sum(F.greatest(F.lit(0), F.col(amount))).alias("used"), F.count("*").alias("n"))


def rolling_counts(events: DataFrame, owner: str, time: str, width: str, step: str) -> DataFrame:
    """(owner, start, n): events in every window of `width` that begins each `step`."""
    return events.groupBy(owner, F.window(time, width, step).alias("w")).agg(F.count("*").alias("n")).select(owner, F.col("w.start").alias("start"), "n")


def group_counts(rows: DataFrame, group: Column, name: str = "group") -> DataFrame:
    """Counts by group, and of all rows under "all"."""
    both = F.explode(F.array(group, F.lit("all"))).alias(name)
    return rows.select(both).groupBy(name).agg(F.count("*").alias("n"))


def predicate_counts(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that meet each predicate; predicates may overlap."""
    return rows.agg(*(F.count_if(p).alias(k) for k, p in predicates.items()))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def readiness(checks: DataFrame) -> DataFrame:
    """Counts of pass, warn and fail, and whether nothing failed."""
    return checks.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("pass", "warn", "fail"))).withColumn("ready", F.col("fail") == 0)


def quota_decisions(usage: DataFrame, owner: str, time: str, key: str, amount: str, limit: int) -> DataFrame:
    """Adds period, used and accepted: what an owner's month had used before a row, which is rejected from `limit` on.

    Negative amounts count as 0. Rejected rows count too, as the reader of a log can't know what they would have used.
    """
    before = Window.partitionBy(owner, "period").orderBy(time, key).rowsBetween(Window.unboundedPreceding, -1)
    rows = usage.withColumn("period", F.date_format(time, "yyyy-MM"))
    used = F.coalesce(F.sum(F.greatest(F.lit(0), F.col(amount))).over(before), F.lit(0))
    return rows.withColumn("used", used).withColumn("accepted", F.col("used") < limit)


def batch_counters(items: DataFrame, batch: str, status: str, statuses: list[str]) -> DataFrame:
    """A row per batch with a count for each status, 0 included, and the total: what an import reports."""
    return items.groupBy(batch).agg(*(F.count_if(F.col(status) == s).alias(s.lower()) for s in statuses), F.count("*").alias("total"))


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 256) -> DataFrame:
    """(keys, a column for each share): nearest-rank percentiles, the value at ceil(n * share), without holding a group.

    A histogram finds the bin that holds the rank; only that bin's values, counted, are put in order. Each doubling of
    a value's size has `bins` bins, whatever other values there are, so outliers make no bin wider. Nulls don't count;
    keys without a value have no row.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    size = (F.floor(F.greatest(F.lit(-1100.0), F.least(F.lit(1100.0), F.log2(F.abs("_v")))) * bins) + (1100 * bins + 1)).cast("long")  # above 0
    binned = known.withColumn("_bin", F.when(F.col("_v") > 0, size).when(F.col("_v") < 0, -size).otherwise(F.lit(0).cast("long")))
    group = Window.partitionBy(*keys)
    upto = F.sum("_k").over(group.orderBy("_bin"))
    table = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_k")).withColumns({"_upto": upto, "_n": F.sum("_k").over(group)})
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("_name"), F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(p))).alias("rank")) for name, p in shares.items())))
    chosen = table.select("*", asked.alias("_a")).filter((F.col("_a.rank") > F.col("_upto") - F.col("_k")) & (F.col("_a.rank") <= F.col("_upto"))).select(*keys, "_bin", "_a._name", (F.col("_a.rank") - F.col("_upto") + F.col("_k")).alias("_left"))
    counted = binned.join(chosen.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").groupBy(*keys, "_bin", "_v").agg(F.count("*").alias("_k"))
    placed = counted.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*keys, "_bin").orderBy("_v")))
    found = placed.join(chosen, [*keys, "_bin"]).filter("_upto >= _left").groupBy(*keys, "_name").agg(F.min("_v").alias("_v"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in shares))
