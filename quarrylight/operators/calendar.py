"""Slots, busy intervals, runs and deadlines. Times are UTC; the clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import dealt


def free_of_overlap(slots: DataFrame, busy: DataFrame, owner: str) -> DataFrame:
    """Slots (owner, start, end) that no busy interval (owner, busy_start, busy_end) overlaps, half-open.

    Both sides are dealt by owner and hour, however many intervals there are, and none is broadcast; a slot's hours
    are few, and a busy interval has a row for each hour that it touches. Empty intervals block nothing.
    """
    hours = lambda a, b: F.explode(F.sequence(F.date_trunc("hour", a), F.date_trunc("hour", b - F.expr("interval 1 microsecond")), F.expr("interval 1 hour")))
    cells = busy.filter(F.col("busy_start") < F.col("busy_end")).withColumn("_h", hours(F.col("busy_start"), F.col("busy_end"))).select(owner, "_h", "busy_start", "busy_end")
    asked = slots.select(owner, "start", "end").distinct().withColumn("_h", hours(F.col("start"), F.col("end")))
    hit = asked.join(dealt(cells), [owner, "_h"]).filter((F.col("start") < F.col("busy_end")) & (F.col("end") > F.col("busy_start")))
    return slots.join(dealt(hit.select(owner, "start", "end").distinct()), [owner, "start", "end"], "left_anti")


def candidate_slots(policies: DataFrame, now: Column, minutes: int, days: int) -> DataFrame:
    """(owner, start, end, local_start): hourly starts from the next full hour within working days and hours.

    `policies` has owner, timezone, working_days (Monday is 0), start_hour and end_hour; a slot must end by closing
    time of the day on which it starts.
    """
    first = F.date_trunc("hour", now) + F.expr("interval 1 hour")
    starts = F.explode(F.sequence(first, first + F.expr(f"interval {days * 24 - 1} hours"), F.expr("interval 1 hour")))
    rows = policies.withColumn("start", starts).withColumn("end", F.col("start") + F.expr(f"interval {minutes} minutes"))
    rows = rows.withColumns({"local_start": F.from_utc_timestamp("start", F.col("timezone")), "_end": F.from_utc_timestamp("end", F.col("timezone"))})
    day = F.to_date("local_start").cast("timestamp")
    at = lambda c, hour: c >= day + F.make_interval(hours=F.col(hour))
    inside = F.array_contains("working_days", F.weekday("local_start")) & at(F.col("local_start"), "start_hour") & (F.col("_end") <= day + F.make_interval(hours=F.col("end_hour")))
    return rows.filter(inside).select("owner", "start", "end", "local_start")


def available_slots(policies: DataFrame, busy: DataFrame, now: Column, minutes: int, days: int = 21) -> DataFrame:
    """Candidate slots without those that a busy interval overlaps."""
    return free_of_overlap(candidate_slots(policies, now, minutes, days), busy, "owner")


def busy_union(*kinds: DataFrame) -> DataFrame:
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more)
    return out.select("owner", "busy_start", "busy_end")


def slots_by_day(slots: DataFrame) -> DataFrame:
    """(owner, day, starts): an owner's slots of a local day in order."""
    return slots.groupBy("owner", F.to_date("local_start").alias("day")).agg(F.array_sort(F.collect_list("local_start")).alias("starts"))


def instant_conflicts(asked: DataFrame, interviews: DataFrame, skip_cancelled: bool = False) -> DataFrame:
    """Requests whose (owner, start) an interview has already."""
    taken = interviews.filter("status <> 'CANCELLED'") if skip_cancelled else interviews
    return asked.join(dealt(taken.select("owner", "start")), ["owner", "start"], "left_semi")


def merge_runs(hours: DataFrame, owner: str, hour: str) -> DataFrame:
    """(owner, start, end): runs of consecutive hours as intervals; repeated hours count once."""
    order = Window.partitionBy(owner).orderBy(hour)
    number = F.unix_timestamp(hour) / 3600
    runs = hours.select(owner, hour).distinct().withColumn("_run", number.cast("long") - F.row_number().over(order))
    return runs.groupBy(owner, "_run").agg(F.min(hour).alias("start"), (F.max(hour) + F.expr("interval 1 hour")).alias("end")).drop("_run")


def hour_cells(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Adds cell: a row for each hour that a non-empty interval touches."""
    last = F.col(end) - F.expr("interval 1 microsecond")
    return intervals.filter(F.col(start) < F.col(end)).withColumn("cell", F.explode(F.sequence(F.date_trunc("hour", start), last, F.expr("interval 1 hour"))))


def weeks_grid(now: Column, weeks: int = 3) -> Column:
    """Array of the days of `weeks` weeks from this week's Monday on."""
    monday = F.date_trunc("week", now).cast("date")
    return F.sequence(monday, F.date_add(monday, 7 * weeks - 1))


def reminders(interviews: DataFrame, start: str, offsets: str, now: Column) -> DataFrame:
    """Adds offset and due: a row for each distinct positive offset in minutes whose time isn't over for 5 minutes."""
    each = F.explode(F.array_distinct(F.filter(offsets, lambda m: m > 0)))
    rows = interviews.withColumn("offset", each)
    due = F.col(start) - F.make_interval(mins=F.col("offset"))
    return rows.withColumn("due", due).filter(F.col("due") > now - F.expr("interval 5 minutes"))


def expired_invitations(invitations: DataFrame, now: Column) -> DataFrame:
    return invitations.filter((F.col("status") == "PENDING") & (F.col("expires_at") <= now))


def overdue_feedback(interviews: DataFrame, scorecards: DataFrame, now: Column, hours: int) -> DataFrame:
    """Ended interviews without a scorecard whose time for one is over."""
    late = interviews.filter((F.col("end") <= now) & (F.col("end") + F.expr(f"interval {hours} hours") <= now))
    return late.join(dealt(scorecards.select("interview")), "interview", "left_anti")


def due_outbox(events: DataFrame, now: Column, most: int = 200) -> DataFrame:
    """The `most` pending events that have been due for longest: a sweep's batch, the rest is left to the next one."""
    return events.filter((F.col("status") == "PENDING") & (F.col("available_at") <= now)).orderBy("available_at", "event").limit(most)
