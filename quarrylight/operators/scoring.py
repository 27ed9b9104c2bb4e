"""Explainable scoring, calibration, routing labels, interview roll-ups and retrieval-quality metrics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed weights of the rule screening; the last two only count where a job asks for them.
SCREEN_WEIGHTS = {"required": 0.40, "semantic": 0.20, "experience": 0.25, "preferred": 0.15}


#: Fixed patterns of the screening: a stated number of years, and a word of its vocabulary count.
YEARS, SCREENED_WORD = r"(\d+)\+?\s*(?:năm|years?)", r"[a-zA-Z][a-zA-Z+#.]{1,}"


def years_mentioned(text: Column) -> Column:
    """The largest whole number right before "năm", "year" or "years"; 0 without one."""
    found = F.regexp_extract_all(F.lower(text), F.lit(YEARS), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda v: v.try_cast("int"))), F.lit(0))


def mentions(text: Column, skill: Column) -> Column:
    """Whether a skill occurs as a whole token, in any case."""
    quoted = F.regexp_replace(F.lower(skill), r"([^a-z0-9\s])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))


def screen(docs: DataFrame, text: str, required: list[str], preferred: list[str], minimum: int) -> DataFrame:
    """Adds the rule screening's scores of 0..100 and its band; parts that a job doesn't ask for are left out."""
    t = F.col(text)
    hits = lambda skills: sum((mentions(t, F.lit(s)).cast("int") for s in skills), F.lit(0))
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(SCREENED_WORD), F.lit(0))))
    years = years_mentioned(t)
    parts = {
        "required": 100 * hits(required) / max(len(required), 1),
        "semantic": F.least(F.lit(100.0), 35 + hits(required) * 65 / max(len(required), 1) + F.least(words, F.lit(80)) / 8),
    }
    if minimum > 0:
        parts["experience"] = F.least(F.lit(100.0), years / minimum * 100)
    if preferred:
        parts["preferred"] = 100 * hits(preferred) / len(preferred)
    total = sum(SCREEN_WEIGHTS[k] for k in parts)
    final = F.round(sum((parts[k] * SCREEN_WEIGHTS[k] for k in parts), F.lit(0.0)) / total, 1)
    band = F.when(F.col("final_score") >= 80, "Strong Match").when(F.col("final_score") >= 65, "Potential Match").otherwise("Needs Review")
    scored = docs.withColumns({f"{k}_score": F.round(v, 1) for k, v in parts.items()} | {"experience_years": years, "final_score": final})
    return scored.withColumn("recommendation", band)


def snippet(text: Column, at: Column, length: Column) -> Column:
    """The sentence about a hit that begins at the 1-based place `at`: from a mark within 240 characters, else 90 back,
    up to the next mark or 150 characters behind the hit."""
    before = F.substring(text, F.lit(1), at - 1)
    begin = F.lit(0)
    for mark in (". ", "! ", "? ", " • ", " | "):
        place = F.length(before) - F.length(F.substring_index(before, mark, -1))
        begin = F.greatest(begin, F.when(F.contains(before, F.lit(mark)), place).otherwise(0))
    start = F.when((begin > 0) & (at - begin <= 240), begin + 1).otherwise(F.greatest(F.lit(1), at - 90))
    stop = F.least(F.length(text) + 1, at + length + 150)
    for mark in (". ", "! ", "? ", " • ", " | "):
        place = F.locate(mark, F.substring(text, at + length, F.lit(150)))
        stop = F.least(stop, F.when(place > 0, at + length + place - 1).otherwise(stop))
    return F.trim(F.substring(text, start, stop - start))


def calibrated(raw: Column, vector_score: Column, evidence: Column, required_coverage: Column) -> dict[str, Column]:
    """score, confidence and review reasons: the raw score with a twentieth of the vector score."""
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.95 * raw + 0.05 * vector_score)), 1)
    confidence = F.round(0.65 * evidence + 0.35 * required_coverage, 3)
    reasons = F.array_compact(F.array(F.when(confidence < 0.6, "LOW_CONFIDENCE"), F.when(score.between(60, 75), "BORDERLINE_SCORE"), F.when((raw >= 80) & (required_coverage < 0.5), "SCORE_EVIDENCE_MISMATCH")))
    return {"score": score, "confidence": confidence, "reasons": reasons}


def route(score: Column, reject_below: float) -> Column:
    """A label only: nothing acts on it."""
    return F.when(score.isNull(), F.lit(None)).when(score < reject_below, "REJECTED").otherwise("WAITING_REVIEW")


def reroute(rows: DataFrame, score: str, status: str, reviewed: str, reject_below: float) -> DataFrame:
    """Labels anew the rows that have a score and weren't reviewed."""
    return rows.withColumn(status, F.when(F.col(reviewed) | F.col(score).isNull(), F.col(status)).otherwise(route(F.col(score), reject_below)))


def band(score: Column, confidence: Column, approve: float, minimum: float) -> Column:
    return F.when((score >= approve) & (confidence * 100 >= minimum), "APPROVE").otherwise("REVIEW")


#: Bins of a score brought to 0..1 that a fit sums its pairs in.
FIT_BINS = 10_000


def fit_platt(pairs: DataFrame, owner: str, score: str, relevance: str, least: int = 30) -> DataFrame:
    """(owner, n, slope, intercept, brier, log_loss): a full-batch logistic fit for each owner with enough pairs.

    Positive from relevance 2 on; scores are brought to 0..1; owners with fewer than `least` pairs or with one class are
    left out. Spark sums pairs by bin and class, with the first three moments about the bin's middle, so an owner of
    any size is FIT_BINS rows of each class at the most. Of a score with two decimals the moments are zero; of others
    the series of the logistic function about the middle is off by the fourth power of slope / 20,000, far below the 8
    digits that are returned.
    """
    y = (F.col(relevance) >= 2).cast("int")
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double") / 100))
    placed = pairs.dropna(subset=[score, relevance]).select(F.col(owner).alias("owner"), x.alias("x"), F.round(x * FIT_BINS).cast("int").alias("bin"), y.alias("y")).withColumn("d", F.col("x") - F.col("bin") / FIT_BINS)
    summed = placed.groupBy("owner", "bin", "y").agg(F.count("*").alias("n"), *(F.sum(F.pow("d", F.lit(k))).alias(f"d{k}") for k in (1, 2, 3)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "y"])
        x, t, w = pdf["bin"].to_numpy() / FIT_BINS, pdf["y"].to_numpy(float), pdf["n"].to_numpy(float)
        d1, d2, d3 = (pdf[f"d{k}"].to_numpy() for k in (1, 2, 3))
        n, positive = w.sum(), (w * t).sum()
        if n < least or positive in (0, n):
            return pd.DataFrame(columns=["owner", "n", "slope", "intercept", "brier", "log_loss"])
        a, b = 1.0, float(np.log((positive + 1) / (n - positive + 1)))

        def sums() -> tuple[np.ndarray, ...]:
            """The function in the middle, its first two derivatives, and over a bin's pairs its sum and that of it
            times the distance from the middle."""
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
            p1 = p * (1 - p)
            p2, p3 = p1 * (1 - 2 * p), p1 * (1 - 6 * p1)
            return p, p1, p2, w * p + a * d1 * p1 + a * a * d2 * p2 / 2 + a**3 * d3 * p3 / 6, d1 * p + a * d2 * p1 + a * a * d3 * p2 / 2

        for _ in range(2000):
            _, _, _, total, moved = sums()
            e, ex = total - w * t, moved - d1 * t
            a, b = a - 0.1 * ((e * x + ex).sum() / n + 0.01 * a), b - 0.1 * e.sum() / n
        p, p1, p2, total, _ = sums()
        squares = w * p * p + a * d1 * 2 * p * p1 + a * a * d2 * (p1 * p1 + p * p2)
        brier = (squares - 2 * t * total + t * w).sum() / n
        q = np.clip(p, 1e-12, 1 - 1e-12)
        loss = (-w * (t * np.log(q) + (1 - t) * np.log(1 - q)) + a * d1 * (p - t) + a * a * d2 * p1 / 2).sum() / n
        return pd.DataFrame([(pdf["owner"].iloc[0], int(n), round(a, 8), round(b, 8), round(float(brier), 8), round(float(loss), 8))], columns=["owner", "n", "slope", "intercept", "brier", "log_loss"])

    kind = dict(pairs.dtypes)[owner]
    return summed.groupBy("owner").applyInPandas(fit, f"owner {kind}, n long, slope double, intercept double, brier double, log_loss double").withColumnRenamed("owner", owner)


def brier_log_loss(pairs: DataFrame, p: Column, y: Column) -> DataFrame:
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return pairs.agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))


def scorecards(answers: DataFrame, interview: str) -> DataFrame:
    """(interview, criterion, mean, n, verdict, conflict) from ratings by criterion."""
    out = answers.groupBy(interview, "criterion").agg(F.avg("rating").alias("mean"), F.count("*").alias("n"), F.min("rating").alias("_a"), F.max("rating").alias("_b"))
    verdict = F.when(F.col("mean") >= 4, "strength").when(F.col("mean") <= 2.5, "concern").otherwise("neutral")
    return out.withColumns({"verdict": verdict, "conflict": (F.col("n") > 1) & (F.col("_b") - F.col("_a") >= 2)}).drop("_a", "_b")


def recommendation_conflicts(cards: DataFrame, interview: str, recommendation: str) -> DataFrame:
    return cards.groupBy(interview).agg((F.count_distinct(recommendation) > 1).alias("recommendation_conflict"))


def cross_analysis(claims: DataFrame, claim_links: DataFrame, requirement_links: DataFrame, known: DataFrame, session: str) -> DataFrame:
    """Numbers by session: claims verified, unverified and inconsistent, requirements covered and not covered."""
    linked = claim_links.groupBy(session, "claim").agg(F.bool_or(F.col("relation") == "VERIFIED").alias("v"), F.bool_or(F.col("relation") == "POTENTIAL_INCONSISTENCY").alias("i"))
    a = claims.select(session, "claim").distinct().join(linked, [session, "claim"], "left").groupBy(session).agg(
        F.count_if("v").alias("verified"), F.count_if(F.col("v").isNull()).alias("unverified"), F.count_if("i").alias("inconsistent")
    )
    covered = requirement_links.filter(F.col("strength").isin("STRONG", "WEAK")).select(session, "requirement").distinct().withColumn("c", F.lit(True))
    b = known.select(session, "requirement").distinct().join(covered, [session, "requirement"], "full").groupBy(session).agg(
        F.count_if("c").alias("covered"), F.count_if(F.col("c").isNull()).alias("not_covered")
    )
    return a.join(b, session, "full").na.fill(0, ["verified", "unverified", "inconsistent", "covered", "not_covered"])


def assessment(rolled: DataFrame) -> DataFrame:
    """Adds score and recommendation to cross_analysis() counts: three fifths requirements, two fifths claims."""
    claims, needs = F.col("verified") + F.col("unverified"), F.col("covered") + F.col("not_covered")
    c, r = F.col("verified") / F.nullif(claims, F.lit(0)), F.col("covered") / F.nullif(needs, F.lit(0))
    base = F.coalesce(0.6 * r + 0.4 * c, r, c, F.lit(0.0))
    penalty = F.least(F.lit(40), F.col("inconsistent") * 15)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(base * 100 - penalty, 0))).cast("int")
    label = F.when(F.col("score") >= 85, "STRONG_YES").when(F.col("score") >= 65, "YES").when(F.col("score") >= 40, "MIXED").when(F.col("score") >= 20, "NO").otherwise("STRONG_NO")
    return rolled.withColumns({"score": score, "penalty": penalty}).withColumn("recommendation", label)


def shortlist(rows: DataFrame, job: str, score: str, key: str, n: int) -> DataFrame:
    """The `n` (1 to 20) best scored rows of each job, ties by key, with their place."""
    order = Window.partitionBy(job).orderBy(F.desc(score), key)
    return rows.filter(F.col(score).isNotNull()).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(1, min(20, n)))


def proposal_key(rows: DataFrame, job: str, key: str, score: str) -> DataFrame:
    """(job, members, proposal): the first 20 hex digits of the digest of the sorted members "key@score"."""
    member = F.concat(F.col(key).cast("string"), F.lit("@"), F.col(score).cast("string"))
    return rows.groupBy(job).agg(F.array_sort(F.collect_list(member)).alias("members")).withColumn("proposal", F.substring(F.sha2(F.array_join("members", ","), 256), 1, 20))


def in_given_order(rows: DataFrame, key: str, chosen: list) -> DataFrame:
    """Rows of the chosen keys, in the order in which they were chosen."""
    listed = F.array(*map(F.lit, chosen))
    return rows.filter(F.col(key).isin(chosen)).withColumn("place", F.array_position(listed, F.col(key))).orderBy("place")


def ideal_gains(grades: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(query, relevant, ideal_K for each k): relevant documents, and the gain of the best order of all graded ones.

    A query's grades are counted, so of any number of judgments a query is a row for each grade; the discounts of the
    places that a grade takes are a difference of two partial sums.
    """
    sums = [0.0]
    for place in range(1, max(ks) + 1):
        sums.append(sums[-1] + 1 / math.log2(place + 1))
    discount = lambda n, k: F.element_at(F.array(*map(F.lit, sums)), (F.least(n, F.lit(k)) + 1).cast("int"))
    counts = grades.groupBy("query", "grade").agg(F.count("*").alias("n"))
    placed = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("grade"))))
    ideal = lambda k: F.sum((F.pow(F.lit(2.0), "grade") - 1) * (discount(F.col("upto"), k) - discount(F.col("upto") - F.col("n"), k)))
    return placed.groupBy("query").agg(F.coalesce(F.sum(F.when(F.col("grade") >= 2, F.col("n"))), F.lit(0)).alias("relevant"), *(ideal(k).alias(f"ideal_{k}") for k in ks))


def metrics_at(ranked: DataFrame, grades: DataFrame, ks: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, query, rr, and precision_at_K, recall_at_K, ndcg_at_K for each k) of several rankings in one pass.

    `ranked` has `by`, query, doc and rank; relevant from grade 2. Precision divides by k. Recall is 1 for a query
    without relevant documents, nDCG where the ideal gain is 0. Judged queries without a ranking have a row only where
    there is nothing to tell rankings apart by.
    """
    judged = ranked.join(grades, ["query", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    hits = lambda k: F.count_if((F.col("rank") <= k) & (F.col("grade") >= 2)).alias(f"hits_{k}")
    found = judged.groupBy(*by, "query").agg(F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("first"), *map(hits, ks), *(F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}") for k in ks))
    both = found.join(ideal_gains(grades, ks), "query", "left" if by else "full")
    both = both.na.fill(0, [c for c in both.columns if c not in (*by, "query", "first")])
    out = [*by, "query", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr")]
    for k in ks:
        n, ideal = F.col(f"hits_{k}"), F.col(f"ideal_{k}")
        out += [
            (n / k).alias(f"precision_at_{k}"), F.when(F.col("relevant") == 0, 1.0).otherwise(F.try_divide(n, F.col("relevant"))).alias(f"recall_at_{k}"),
            F.when(ideal < 1e-12, 1.0).otherwise(F.try_divide(F.col(f"dcg_{k}"), ideal)).alias(f"ndcg_at_{k}"),
        ]
    return both.select(*out)


def retrieval_metrics(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """(query, precision, recall, rr, ndcg) at k from (query, doc, rank) and (query, doc, grade): see metrics_at(). Every
    query of either table has a row."""
    at = metrics_at(ranked, grades, (k,))
    return at.select("query", F.col(f"precision_at_{k}").alias("precision"), F.col(f"recall_at_{k}").alias("recall"), "rr", F.col(f"ndcg_at_{k}").alias("ndcg"))


def slice_means(rows: DataFrame, dimensions: list[str], measures: list[str]) -> DataFrame:
    """(dimension, value, n, means): independent slices, one grouping set for each dimension."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))
    return rows.select(each.alias("_d"), *measures).groupBy("_d.dimension", "_d.value").agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in measures))


def micro_scores(expected: DataFrame, found: DataFrame, case: str, item: str) -> DataFrame:
    """One row: micro precision and recall of items, and the share of cases that are exactly right; 1 without any."""
    e, f = expected.select(case, item).distinct().withColumn("e", F.lit(1)), found.select(case, item).distinct().withColumn("f", F.lit(1))
    both = e.join(f, [case, item], "full").na.fill(0, ["e", "f"])
    cases = both.groupBy(case).agg(F.sum(F.col("e") * F.col("f")).alias("tp"), F.sum("e").alias("e"), F.sum("f").alias("f"))
    share = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(1.0))
    exact = F.coalesce(F.avg(((F.col("tp") == F.col("e")) & (F.col("tp") == F.col("f"))).cast("double")), F.lit(1.0))
    return cases.agg(share("tp", "f").alias("precision"), share("tp", "e").alias("recall"), exact.alias("exact"))


def gate(metrics: DataFrame, columns: list[str], least: float = 1.0) -> DataFrame:
    """Whether every metric of every row reaches `least`."""
    passed = F.lit(True)
    for c in columns:
        passed &= F.col(c) >= least
    return metrics.agg(F.coalesce(F.bool_and(passed), F.lit(True)).alias("passed"))


def retained(rows: DataFrame, created: str, status: str, now: Column, days: int) -> DataFrame:
    """Adds expired: a finished row that is older than the retention period."""
    old = F.col(created) < now - F.expr(f"interval {days} days")
    return rows.withColumn("expired", old & F.col(status).isin("REJECTED", "ARCHIVED", "SCREENING_FAILED"))


def erased(rows: DataFrame, subjects: DataFrame, key: str, hashed: list[str], cleared: list[str]) -> DataFrame:
    """Rows of erased subjects with some columns as digests and others null; all other rows as they were."""
    marked = rows.join(subjects.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    change = {c: F.when(F.col("_gone"), F.sha2(F.col(c).cast("string"), 256)).otherwise(F.col(c).cast("string")) for c in hashed}
    change |= {c: F.when(F.col("_gone").isNull(), F.col(c)) for c in cleared}
    return marked.withColumns(change).drop("_gone")


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children whose parent isn't gone."""
    return children.join(gone.select(key), key, "left_anti")


def proposals(applications: DataFrame, tasks: DataFrame, job: str, key: str, trigger: str, approve_at: float = 80, min_confidence: float = 0, min_completed: int = 2, min_score: float = 65, top_n: int = 5) -> DataFrame:
    """(job, key, score, place): what a shortlist proposal selects, best first, ties by key.

    "screening_completed" takes the scored applications that wait for a review and whose band is REVIEW. Any other
    trigger, a person's, gives nothing for a job with active tasks (QUEUED, RUNNING, RETRYING) or with fewer than
    `min_completed` scored applications; else the best `top_n` (1 to 20) from `min_score` on, or where none reaches
    that the best `top_n`. `applications` has score, confidence (0 to 1) and status; `tasks` has key and status.
    """
    scored = applications.filter(F.col("score").isNotNull())
    if trigger == "screening_completed":
        kept = scored.filter((F.col("status") == "WAITING_REVIEW") & (band(F.col("score"), F.col("confidence"), approve_at, min_confidence) == "REVIEW"))
    else:
        busy = applications.select(job, key).join(tasks.filter(F.col("status").isin("QUEUED", "RUNNING", "RETRYING")).select(key), key).select(job).distinct()
        totals = scored.groupBy(job).agg(F.count("*").alias("_n"), F.count_if(F.col("score") >= min_score).alias("_good"))
        open_ = totals.filter(F.col("_n") >= max(1, min_completed)).join(busy, job, "left_anti")
        kept = scored.join(open_, job).filter((F.col("_good") == 0) | (F.col("score") >= min_score))
        return shortlist(kept, job, "score", key, top_n).select(job, key, "score", "place")
    order = Window.partitionBy(job).orderBy(F.desc("score"), key)
    return kept.select(job, key, "score", F.row_number().over(order).alias("place"))


#: Fixed weights of an interview's criteria.
RUBRIC = {"required skills": 35, "depth of experience": 25, "problem solving": 20, "communication": 10, "learning what is missing": 10}


def interview_kit(rows: DataFrame, matched: str, missing: str, required: str, title: str) -> DataFrame:
    """Adds focus, gap and questions: up to three matched requirements, else required ones, else a general word; the
    first that is missing; and five questions made of them by templates."""
    first = lambda c: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 3)
    focus = F.when(F.size(first(F.col(matched))) > 0, first(F.col(matched))).when(F.size(first(F.col(required))) > 0, first(F.col(required))).otherwise(F.array(F.lit("relevant experience")))
    kit = rows.withColumns({"focus": focus, "gap": F.coalesce(F.get(F.col(missing), F.lit(0)), F.lit(""))})
    post = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("this position"))
    questions = F.array(
        F.concat(F.lit("Which project of yours shows "), F.element_at("focus", 1), F.lit(" best, and what of it would serve "), post, F.lit("?")),
        F.concat(F.lit("How would you handle errors, logs and tests of a service built on "), F.element_at("focus", -1), F.lit("?")),
        F.when(F.col("gap") != "", F.concat(F.lit("Your CV says little of "), F.col("gap"), F.lit(": where have you met it?"))).otherwise(F.lit("Which of your skills would you still like to deepen?")),
        F.lit("A request changes shortly before the deadline: what do you do?"), F.concat(F.lit("What should decide for you as "), post, F.lit("?")),
    )
    return kit.withColumn("questions", questions)


def violation_rate(returned: DataFrame, required: str, skills: str, years: str, minimum: str) -> DataFrame:
    """(violations, returned, rate): how often a result breaks a hard filter; a row can break both and counts twice."""
    lacks = F.coalesce(F.size(F.array_except(required, skills)) > 0, F.lit(False)).cast("int")
    young = F.coalesce(F.coalesce(F.col(years), F.lit(0)) < F.col(minimum), F.lit(False)).cast("int")
    sums = returned.agg(F.coalesce(F.sum(lacks + young), F.lit(0)).alias("violations"), F.count("*").alias("returned"))
    return sums.withColumn("rate", F.coalesce(F.round(F.try_divide(F.col("violations"), F.col("returned")), 4), F.lit(0.0)))


def precision_by_category(hits: DataFrame, k: int) -> DataFrame:
    """(system, category, precision, overall, lowest) from (system, query, category, rank, relevant): the share of k by
    category, and for each system the mean over its queries and the category that does worst."""
    query = hits.groupBy("system", "category", "query").agg((F.count_if(F.col("relevant") & (F.col("rank") <= k)) / k).alias("p"))
    each = query.groupBy("system", "category").agg(F.avg("p").alias("precision"), F.count("*").alias("_n"))
    over = Window.partitionBy("system")  # a row for each category
    return each.withColumns({"overall": F.sum(F.col("precision") * F.col("_n")).over(over) / F.sum("_n").over(over), "lowest": F.min("precision").over(over)}).drop("_n")


def case_metrics(fields: DataFrame, evidence: DataFrame, ranked: DataFrame, routed: DataFrame) -> DataFrame:
    """One row: cases, requirement_accuracy, evidence_support, top_1 and routing_accuracy of screening cases, by 3 digits.

    `fields` has expected and found; `evidence` matched and supported (an unmatched item needs no support); `ranked`
    case, candidate, score and expected_top; `routed` expected and found. gate() tells whether all of them are 1.
    """
    share = lambda hit: F.round(F.coalesce(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), F.lit(1.0)), 3)
    best = ranked.groupBy("case").agg(F.max_by("candidate", F.struct("score", F.lit(0))).alias("top"), F.max("expected_top").alias("expected_top"))
    one = best.agg(F.count("*").alias("cases"), share(F.col("top") == F.col("expected_top")).alias("top_1"))
    parts = [fields.agg(share(F.col("expected").eqNullSafe(F.col("found"))).alias("requirement_accuracy")), evidence.agg(share(~F.col("matched") | F.col("supported")).alias("evidence_support")), routed.agg(share(F.col("expected") == F.col("found")).alias("routing_accuracy"))]
    for part in parts:
        one = one.crossJoin(F.broadcast(part))  # one row each
    return one


def evaluated_modes(matches: DataFrame, queries: DataFrame, grades: DataFrame, rank, rerank: DataFrame | None = None) -> DataFrame:
    """(mode, query, precision_at_5, recall_at_10, recall_at_20, rr, ndcg_at_10): one retrieval under the four modes.

    `matches` has query, dense and lexical beside what `rank` needs, a function from matches to (query, doc, rank,
    score); dense mode hides the overlap, keyword mode puts twice the overlap less one in place of the cosine, and
    reranked mode, given scores (query, doc, rerank), sorts by these mixed into hybrid's scores. `queries` is a
    handful; every query has a row in each mode.
    """
    keyword = matches.withColumn("dense", F.col("lexical") * 2 - 1)
    modes = {"dense": matches.withColumn("lexical", F.lit(None).cast("double")), "keyword": keyword, "hybrid": matches}
    ranked = {mode: rank(rows).select("query", "doc", "rank", "score") for mode, rows in modes.items()}
    if rerank is not None:
        mixed = ranked["hybrid"].join(rerank, ["query", "doc"], "left").withColumn("score", F.col("score") * 0.3 + 100 * F.coalesce("rerank", F.lit(0.0)) * 0.7)
        ranked["reranked"] = mixed.select("query", "doc", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rank")).alias("rank"), "score")
    all_modes = reduce(DataFrame.unionByName, (rows.select(F.lit(mode).alias("mode"), "query", "doc", "rank") for mode, rows in ranked.items()))
    told = metrics_at(all_modes, grades, (5, 10, 20), ("mode",))
    judged = metrics_at(all_modes.limit(0).drop("mode"), grades, (5, 10, 20))  # of queries that a mode has no documents for
    wanted = queries.select("query", F.explode(F.array(*map(F.lit, ranked))).alias("mode"))
    none = wanted.join(told.select("mode", "query"), ["mode", "query"], "left_anti").join(judged, "query", "left").na.fill(0.0)
    out = told.join(queries.select("query"), "query", "left_semi").unionByName(none)
    return out.select("mode", "query", "precision_at_5", "recall_at_10", "recall_at_20", "rr", "ndcg_at_10")
