"""Entity resolution, versions, deduplication, set differences and lookup joins."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, email_key, phone_key


def resolve_profiles(incoming: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds profile and conflict: the owner's profile with the row's e-mail, else with its phone number.

    A row whose e-mail and phone belong to two profiles has a conflict and no profile; without a match profile is
    null, a new one. `incoming` has owner, email and phone; `profiles` owner, profile, email_key and phone_key, unique
    by owner and key.
    """
    rows = incoming.withColumns({"_e": email_key(F.col("email")), "_p": phone_key(F.col("phone"))})
    by_email = profiles.filter("email_key is not null").select(F.col("owner"), F.col("email_key").alias("_e"), F.col("profile").alias("_by_email"))
    by_phone = profiles.filter("phone_key is not null").select(F.col("owner"), F.col("phone_key").alias("_p"), F.col("profile").alias("_by_phone"))
    joined = rows.join(by_email, ["owner", "_e"], "left").join(by_phone, ["owner", "_p"], "left")
    conflict = F.coalesce(F.col("_by_email") != F.col("_by_phone"), F.lit(False))
    return joined.select(*incoming.columns, F.when(~conflict, F.coalesce("_by_email", "_by_phone")).alias("profile"), conflict.alias("conflict"))


def merged_profiles(profiles: DataFrame, resolved: DataFrame) -> DataFrame:
    """Profiles after their rows: the latest name that isn't blank, the first e-mail and phone, first and last seen."""
    rows = resolved.filter("profile is not null").select(
        "profile", F.struct("seen_at", "name").alias("at"), F.trim("name").alias("name"), "email", "phone", "seen_at"
    )
    new = rows.groupBy("profile").agg(
        F.max_by(F.when(F.col("name") != "", F.col("name")), F.when(F.col("name") != "", F.col("at"))).alias("new_name"),
        F.min_by("email", F.when(email_key(F.col("email")).isNotNull(), F.col("seen_at"))).alias("new_email"),
        F.min_by("phone", F.when(phone_key(F.col("phone")).isNotNull(), F.col("seen_at"))).alias("new_phone"),
        F.max("seen_at").alias("new_seen"),
    )
    return profiles.join(new, "profile", "left").select(
        "owner", "profile", F.coalesce("new_name", "name").alias("name"), F.coalesce("email", "new_email").alias("email"),
        F.coalesce("phone", "new_phone").alias("phone"), "first_seen", F.greatest("last_seen", "new_seen").alias("last_seen"),
    )


def identity_key(email: Column, phone: Column, own: Column) -> Column:
    """E-mail, else phone number, else the row's own id."""
    return F.coalesce(F.concat(F.lit("e:"), email_key(email)), F.concat(F.lit("p:"), phone_key(phone)), F.concat(F.lit("i:"), own.cast("string")))


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)))


def running_number(rows: DataFrame, keys: list[str], order: list[str], out: str, bucket: Column | None = None) -> DataFrame:
    """Adds `out`: the rows of a key numbered from 1 in the order given.

    Without `bucket` each key is one task's work. With it, a coarse form of the first order column that grows with it,
    such as a day of a time, keys are numbered by bucket and the buckets' sizes are added up, so that a key with a
    third of all rows is many tasks' work.
    """
    if bucket is None:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    parts = rows.withColumn("_bucket", bucket)
    sizes = parts.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    named = [f"_key{i}" for i in range(len(keys))]
    offsets = sizes.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    placed = parts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return placed.join(offsets, _same([*keys, "_bucket"], [*named, "_of"])).select(*rows.columns, (F.col("_before") + F.col("_n")).alias(out))


def number_versions(rows: DataFrame, profile: str, checksum: str, order: list[str], existing: DataFrame | None = None, bucket: Column | None = None) -> DataFrame:
    """Rows with new content only, numbered from 1 (or after the profile's existing versions) in the order given.

    Content that the profile has already is no new version; of equal content the first row stays. For `bucket` see
    running_number().
    """
    first = Window.partitionBy(profile, checksum).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    if existing is None:
        return running_number(kept, [profile], order, "version", bucket)
    fresh = kept.join(existing.select(profile, checksum), [profile, checksum], "left_anti")
    top = existing.groupBy(profile).agg(F.max("version").alias("_top"))
    numbered = running_number(fresh, [profile], order, "version", bucket).join(top, profile, "left")
    return numbered.withColumn("version", F.coalesce("_top", F.lit(0)) + F.col("version")).drop("_top")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def import_decisions(remote: DataFrame, versions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds decision and warning to remote rows (owner, name, email, phone, checksum), checked in this order:

    IDENTITY_SPLIT (e-mail and phone of two profiles), CHECKSUM_IDENTITY_CONFLICT (content of another profile),
    DUPLICATE_CONTENT, NEW_VERSION, NEW_PROFILE. Warnings: NAME_MISMATCH with the profile found, or
    POSSIBLE_NAME_DUPLICATE of a profile under another identity.
    """
    found = resolve_profiles(remote, profiles)
    content = versions.groupBy("owner", "checksum").agg(F.min("profile").alias("_holder"))
    names = profiles.select(F.col("owner").alias("_owner"), F.col("profile").alias("_p"), F.lower(F.trim("name")).alias("_known"))
    twins = names.groupBy(F.col("_owner").alias("owner"), F.col("_known").alias("_name")).agg(F.lit(True).alias("_twin"))
    joined = found.withColumn("_name", F.lower(F.trim("name"))).join(content, ["owner", "checksum"], "left")
    joined = joined.join(names, (F.col("profile") == F.col("_p")) & (F.col("owner") == F.col("_owner")), "left").join(twins, ["owner", "_name"], "left")
    decision = (
        F.when(F.col("conflict"), "IDENTITY_SPLIT")
        .when(F.col("_holder").isNotNull() & (F.col("profile").isNull() | (F.col("_holder") != F.col("profile"))), "CHECKSUM_IDENTITY_CONFLICT")
        .when(F.col("_holder").isNotNull(), "DUPLICATE_CONTENT")
        .when(F.col("profile").isNotNull(), "NEW_VERSION")
        .otherwise("NEW_PROFILE")
    )
    warning = F.when(F.col("profile").isNotNull() & (F.col("_known") != F.col("_name")), "NAME_MISMATCH").when(F.col("profile").isNull() & F.col("_twin"), "POSSIBLE_NAME_DUPLICATE")
    return joined.select(*remote.columns, "profile", decision.alias("decision"), warning.alias("warning"))


def sync_new(remote: DataFrame, local: DataFrame, checksum: str, order: list[str]) -> DataFrame:
    """Remote rows whose checksum is neither local nor seen earlier in the listing; blank checksums always stay."""
    blank = F.coalesce(F.col(checksum), F.lit("")) == ""
    fresh = remote.filter(~blank).join(local.select(checksum), checksum, "left_anti").select(*remote.columns)
    return latest(fresh, checksum, *map(F.col, order)).unionByName(remote.filter(blank))


def refresh_lookup(local: DataFrame, remote: DataFrame, checksum: str, order: Column, value: str) -> DataFrame:
    """Local rows with the value of the last remote row of their checksum, null without one."""
    last = remote.groupBy(checksum).agg(F.max_by(value, order).alias(value))
    return local.join(last, checksum, "left")


def canonical_skills(values: DataFrame, skills: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, name, raw, confidence) by skill: names first, approved aliases over them, unknown ones as raw.

    `values` has place, raw and norm; `skills` norm and name; `aliases` norm and name. The first occurrence of a key
    stays. The vocabularies are dimensions joined by hash, whichever size Spark finds them to have.
    """
    known = skills.select("norm", F.col("name").alias("_n")).dropDuplicates(["norm"])
    other = aliases.select("norm", F.col("name").alias("_a")).dropDuplicates(["norm"])
    joined = values.join(known, "norm", "left").join(other, "norm", "left")
    name = F.coalesce("_a", "_n")
    out = joined.select(
        *keys, "place", F.when(name.isNotNull(), F.lower(name)).otherwise(F.concat(F.lit("raw:"), "norm")).alias("key"),
        F.coalesce(name, "raw").alias("name"), "raw", F.when(name.isNotNull(), 1.0).otherwise(0.0).alias("confidence"),
    )
    first = Window.partitionBy(*keys, "key").orderBy("place")
    return out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def diff_skills(before: DataFrame, after: DataFrame, pair: str) -> DataFrame:
    """Skill part of a version diff: (pair, bucket, key, before, after) from two tables of (pair, key, raw)."""
    b, a = before.select(pair, "key", F.col("raw").alias("before")), after.select(pair, "key", F.col("raw").alias("after"))
    bucket = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.lower("before") != F.lower("after"), "ALIAS_RENAMED")
        .otherwise("unchanged")
    )
    return b.join(a, [pair, "key"], "full").select(pair, bucket.alias("bucket"), "key", "before", "after")


def diff_value(before: Column, after: Column) -> Column:
    """Bucket of a single value: added, removed, modified, unchanged, or null where both are blank."""
    b, a = F.nullif(F.trim(before.cast("string")), F.lit("")), F.nullif(F.trim(after.cast("string")), F.lit(""))
    return F.when(b.isNull() & a.isNull(), F.lit(None)).when(b.isNull(), "added").when(a.isNull(), "removed").when(b == a, "unchanged").otherwise("modified")


def experience_conflict(before: Column, after: Column) -> Column:
    return F.coalesce(after < before, F.lit(False))


def diff_lists(before: Column, after: Column) -> Column:
    """Array of (bucket, value) between two lists of strings, by folded value; unchanged values as in `after`."""
    key = lambda x: F.lower(x)
    last = lambda xs: F.map_from_entries(F.transform(F.array_distinct(F.transform(xs, key)), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(xs, lambda v: key(v) == k), -1).alias("v"))))
    none = F.array().cast("array<string>")
    named = lambda bucket, keys, values: F.transform(F.array_sort(keys), lambda k: F.struct(F.lit(bucket).alias("bucket"), F.element_at(values, k).alias("value")))

    def parts(m):
        b, a = m["b"], m["a"]
        return F.concat(
            named("added", F.array_except(F.map_keys(a), F.map_keys(b)), a),
            named("removed", F.array_except(F.map_keys(b), F.map_keys(a)), b),
            named("unchanged", F.array_intersect(F.map_keys(a), F.map_keys(b)), a),
        )

    return F.transform(F.array(F.struct(last(F.coalesce(before, none)).alias("b"), last(F.coalesce(after, none)).alias("a"))), parts)[0]  # the maps are made once, not for each value


def diff_counts(diff: DataFrame, pair: str) -> DataFrame:
    """Numbers of added, removed, modified, unchanged and conflicting entries of each pair."""
    named = {"added": ["added"], "removed": ["removed"], "modified": ["modified", "ALIAS_RENAMED", "VALUE_CHANGED", "TEXT_CHANGED"], "unchanged": ["unchanged"], "conflicts": ["conflict"]}
    return diff.groupBy(pair).agg(*(F.count_if(F.col("bucket").isin(v)).alias(k) for k, v in named.items()))


def change_summary(versions: DataFrame, profile: str, order: str, checksum: str, text: str, bucket: Column | None = None) -> DataFrame:
    """Adds change (INITIAL, SAME_CONTENT or CHANGED) and word_delta against the profile's version before.

    With `bucket`, see running_number(), the first version of a bucket meets the last one of the bucket before.
    """
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    rows = versions.withColumns({"_words": words, "_bucket": F.lit(0) if bucket is None else bucket})
    over = Window.partitionBy(profile, "_bucket").orderBy(order)
    state = F.struct(F.col(checksum).alias("c"), F.col("_words").alias("w"))
    placed = rows.withColumn("_was", F.lag(state).over(over))
    if bucket is not None:
        last = rows.groupBy(profile, "_bucket").agg(F.max_by(state, order).alias("_last"))
        before = last.select(F.col(profile).alias("_key0"), F.col("_bucket").alias("_of"), F.lag("_last").over(Window.partitionBy(profile).orderBy("_bucket")).alias("_carried"))
        placed = placed.join(before, _same([profile, "_bucket"], ["_key0", "_of"])).withColumn("_was", F.coalesce("_was", "_carried"))
    change = F.when(F.col("_was").isNull(), "INITIAL").when(F.col("_was.c").eqNullSafe(F.col(checksum)), "SAME_CONTENT").otherwise("CHANGED")
    return placed.select(*versions.columns, change.alias("change"), (F.col("_words") - F.coalesce("_was.w", F.lit(0))).alias("word_delta"))


def similarity(pairs: DataFrame, before: str, after: str, out: str = "similarity") -> DataFrame:
    """Adds the longest-matching-block ratio of two texts, times 100 and rounded; row-local Python, as no function has it."""
    from difflib import SequenceMatcher

    @F.pandas_udf("int")
    def ratio(b: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([round(100 * SequenceMatcher(None, x or "", y or "").ratio()) for x, y in zip(b, a)], dtype="int32")

    return pairs.withColumn(out, ratio(before, after))


def neighbours(versions: DataFrame, profile: str, version: str) -> DataFrame:
    """Adds previous and next: the nearest lower and higher version numbers of the profile, gaps allowed."""
    over = Window.partitionBy(profile).orderBy(version)
    return versions.withColumns({"previous": F.lag(version).over(over), "next": F.lead(version).over(over)})


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with count and surplus."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").withColumn("surplus", F.col("n") - 1)


def distinct_in_order(values: Column) -> Column:
    """Array without values that were there before in another case; first spellings stay, blanks go."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    keys = F.transform(clean, lambda v: F.lower(v))
    return F.filter(clean, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def merge_requirements(required: DataFrame, preferred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, skill, name, place) by skill: first place, last spelling; preferred without the required ones."""

    def one(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "skill").agg(F.min("place").alias("place"), F.max_by("name", F.struct("place", "name")).alias("name"))

    need = one(required)
    nice = one(preferred).join(need.select(*keys, "skill"), [*keys, "skill"], "left_anti")
    return need.withColumn("kind", F.lit("required")).unionByName(nice.withColumn("kind", F.lit("preferred"))).select(*keys, "kind", "skill", "name", "place")


def unknown_ids(selected: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Selected keys that aren't known; a request is valid where this is empty."""
    return selected.select(key).distinct().join(known.select(key), key, "left_anti")


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): the distinct values of columns, arrays by element, without nulls and blanks."""
    out = None
    for c in columns:
        value = F.explode(c) if dict(rows.dtypes)[c].startswith("array") else F.col(c)
        one = rows.select(value.cast("string").alias("value")).filter("value is not null and value <> ''").distinct().select(F.lit(c).alias("facet"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def skill_facets(rows: DataFrame, key: str, skills: str) -> DataFrame:
    """(skill, n): documents by skill, raw keys left out."""
    each = rows.select(key, F.explode(F.array_distinct(skills)).alias("skill")).filter(~F.col("skill").startswith("raw:"))
    return each.groupBy("skill").agg(F.count("*").alias("n"))


def claim_matrix(links: DataFrame, claim: str, model: str, relation: str, models: list[str]) -> DataFrame:
    """A row per claim and a column per model with the strongest relation, N/A without one."""
    rank = F.when(F.col(relation) == "POTENTIAL_INCONSISTENCY", 3).when(F.col(relation) == "VERIFIED", 2).otherwise(1)
    wide = links.groupBy(claim).pivot(model, models).agg(F.max_by(relation, rank))
    return wide.na.fill("N/A", models)


def consensus(links: DataFrame, claim: str, model: str, relation: str, n_models: int) -> DataFrame:
    """Claims that every model verifies, or any finds inconsistent, with the number of models."""
    verified = F.count_distinct(F.when(F.col(relation) == "VERIFIED", F.col(model))).alias("verified_by")
    against = F.count_distinct(F.when(F.col(relation) == "POTENTIAL_INCONSISTENCY", F.col(model))).alias("inconsistent_by")
    return links.groupBy(claim).agg(verified, against).filter((F.col("verified_by") == n_models) | (F.col("inconsistent_by") > 0))


def index_actions(wanted: DataFrame, indexed: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """(keys, action): skip what is ready with the same hash, upsert what changed or is forced, delete what vanished."""
    w, i = wanted.select(*keys, F.col("hash").alias("_want")), indexed.select(*keys, F.col("hash").alias("_have"), F.col("status").alias("_status"))
    ready = (F.col("_want") == F.col("_have")) & (F.col("_status") == "READY") & F.lit(not force)
    action = F.when(F.col("_want").isNull(), "delete").when(F.coalesce(ready, F.lit(False)), "skip").otherwise("upsert")
    return w.join(i, keys, "full").select(*keys, action.alias("action"))


def prior_submissions(rows: DataFrame, key: str, email: str, time: str) -> DataFrame:
    """(key, prior, at): other rows with the same trimmed, folded e-mail address; blank addresses have none.

    The pairs are the result: each row lists the others of its address.
    """
    keyed = rows.select(F.col(key), email_key(F.col(email)).alias("_e"), F.col(time).alias("at")).filter("_e is not null")
    other = keyed.select(F.col(key).alias("prior"), "_e", "at")
    return keyed.drop("at").join(other, "_e").filter(F.col(key) != F.col("prior")).select(key, "prior", "at")


def superseded(rows: DataFrame, key: str, order: str, status: str, live: list[str]) -> DataFrame:
    """Statuses after a new row arrived: of a key's live rows only the latest stays, the others are SUPERSEDED."""
    later = F.max(F.col(order)).over(Window.partitionBy(key))
    return rows.withColumn(status, F.when(F.col(status).isin(live) & (F.col(order) < later), "SUPERSEDED").otherwise(F.col(status)))


def backfill_identities(rows: DataFrame, email: str, phone: str, own: str, created: str, digest: str, text: str) -> DataFrame:
    """Adds identity, number and content: the number of a row among those of its identity by time and id, and its
    digest, or where it has none that of its text."""
    keyed = rows.withColumn("identity", identity_key(F.col(email), F.col(phone), F.col(own)))
    order = Window.partitionBy("identity").orderBy(created, own)
    return keyed.withColumns({"number": F.row_number().over(order), "content": F.coalesce(F.nullif(F.col(digest), F.lit("")), F.sha2(text, 256))})


def active_counts(owned: DataFrame, tasks: DataFrame, key: str, group: str, active: list[str]) -> DataFrame:
    """(group, active): tasks of an active status by the group of the row that they belong to; groups without any have 0."""
    n = owned.select(key, group).join(tasks.filter(F.col("status").isin(active)).select(key), key).groupBy(group).agg(F.count("*").alias("_n"))
    return owned.select(group).distinct().join(n, group, "left").select(group, F.coalesce("_n", F.lit(0)).alias("active"))


def linked_pairs(links: DataFrame, parts: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """Links with the value of both parts that they name: the same table joined twice."""
    a, b = (parts.select(F.col(key).alias(c), F.col(value).alias(f"{value}_{c}")) for c in (first, second))
    return links.join(a, first).join(b, second)


def resolved_values(values: DataFrame, catalog: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(key, place, value): filter values as catalog ids, in order and without repetitions.

    `values` has place and raw; `catalog` norm (a name, an alias or an id, folded) and id; `ids` db_id and id. A value
    that neither knows stands as "raw:" and its folded text; blank ones go.
    """
    rows = values.withColumn("_t", F.trim("raw")).filter("_t <> ''").withColumn("norm", casefold(F.col("_t")))
    joined = rows.join(catalog.groupBy("norm").agg(F.min("id").alias("_c")), "norm", "left").join(ids.groupBy(F.col("db_id").alias("_t")).agg(F.min("id").alias("_d")), "_t", "left")
    named = joined.select(key, "place", F.coalesce("_c", "_d", F.concat(F.lit("raw:"), "norm")).alias("value"))
    return named.groupBy(key, "value").agg(F.min("place").alias("place")).select(key, "place", "value")


def ordered_children(parents: DataFrame, children: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Parents with an array of their children's values in order, empty without any: one join instead of a read for each."""
    listed = children.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda c: c[value]).alias(f"{value}s"))
    none = F.array().cast(f"array<{dict(children.dtypes)[value]}>")
    return parents.join(listed, key, "left").withColumn(f"{value}s", F.coalesce(f"{value}s", none))


def truth_by_email(files: DataFrame, prefixes: dict[str, str], name: str, email: str) -> DataFrame:
    """(email, category): the category that a file's name begins with, by folded address; of several the first by name."""
    category = F.coalesce(*(F.when(F.col(name).startswith(p), c) for p, c in sorted(prefixes.items(), key=lambda x: -len(x[0]))))
    rows = files.select(email_key(F.col(email)).alias("email"), category.alias("category"), name).filter("email is not null and category is not null")
    return rows.groupBy("email").agg(F.min_by("category", name).alias("category"))


def category_counts(rows: DataFrame, column: str, listed: list[str]) -> DataFrame:
    """(category, n) with a row for every listed category, also those of no row, and one for rows without a listed one."""
    known = F.when(F.col(column).isin(listed), F.col(column)).otherwise("UNCLASSIFIED")
    counts = rows.select(known.alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(c,) for c in [*listed, "UNCLASSIFIED"]], "category string")
    return every.join(F.broadcast(counts), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def diff_versions(pairs: DataFrame, before: DataFrame, after: DataFrame, pair: str, values: list[str] = (), texts: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """(pair, bucket, category, before, after, change_type): the whole difference of two versions as a long table.

    `before` and `after` hold a version's skills (pair, key, raw). `pairs` has for every other field two columns,
    b_ and a_: years (a drop is a conflict as well), single `values`, `texts`, and `lists`, compared by folded value.
    Blank or null on both sides gives no row.
    """
    skills = diff_skills(before, after, pair).select(pair, F.when(F.col("bucket") == "ALIAS_RENAMED", "modified").otherwise(F.col("bucket")).alias("bucket"), F.lit("skills").alias("category"), "before", "after", F.when(F.col("bucket") == "ALIAS_RENAMED", F.col("bucket")).alias("change_type"))
    text = lambda c: c.cast("string")
    one = lambda bucket, category, b, a, change: F.struct(bucket.alias("bucket"), F.lit(category).alias("category"), text(b).alias("before"), text(a).alias("after"), change.alias("change_type"))
    parts = []
    for c, change in [("years", "VALUE_CHANGED"), *((v, "VALUE_CHANGED") for v in values), *((t, "TEXT_CHANGED") for t in texts)]:
        b, a = F.col(f"b_{c}"), F.col(f"a_{c}")
        bucket = diff_value(b, a)
        parts.append(F.array(one(bucket, c, b, a, F.when(bucket == "modified", F.lit(change)))))
    dropped = experience_conflict(F.col("b_years"), F.col("a_years"))
    parts.append(F.array(one(F.when(dropped, "conflict"), "years", F.col("b_years"), F.col("a_years"), F.lit(None).cast("string"))))
    for c in lists:
        parts.append(F.transform(diff_lists(F.col(f"b_{c}"), F.col(f"a_{c}")), lambda d: one(d["bucket"], c, F.when(d["bucket"] != "added", d["value"]), F.when(d["bucket"] != "removed", d["value"]), F.lit(None).cast("string"))))  # noqa: B023
    return skills.unionByName(pairs.select(pair, F.inline(F.filter(F.concat(*parts), lambda d: d["bucket"].isNotNull()))))
