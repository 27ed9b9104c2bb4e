"""Hybrid retrieval and ranking: dense and lexical channels, the version ranker, the warehouse ranker, reranking."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, has_word, word_overlap
from ..functions.vector import lenient_cosine, sigmoid, strict_cosine

#: Fixed weights of the version ranker; a category that is asked for adds its weight on top.
WEIGHTS = {"semantic": 0.50, "required": 0.25, "preferred": 0.10, "experience": 0.10, "freshness": 0.05}
CATEGORY_WEIGHT, LEXICAL_WEIGHT, FRESH_DAYS = 0.12, 0.20, 730
#: Fixed weights of the warehouse ranker, and heads and weight of the two rerankers.
WAREHOUSE_WEIGHTS = {"semantic": 0.45, "lexical": 0.10, "required": 0.35, "preferred": 0.10, "category": 0.12}
RERANK_HEAD, RERANK_WEIGHT, WAREHOUSE_HEAD = 20, 0.70, 30
#: Characters of a document that stand for it where none of its lines holds a word of the query.
CONTEXT_CHARS = 360


def oversample(limit: int) -> int:
    """How many chunks a channel retrieves for a result of `limit` rows."""
    return max(100, 10 * limit)


def dense_topk(chunks: DataFrame, query: list[float], k: int, key: str, vector: str) -> DataFrame:
    """The `k` chunks of the highest cosine with the query, ties by key: (key, dense)."""
    scored = chunks.select(key, strict_cosine(F.col(vector), F.array(*map(F.lit, query))).alias("dense"))
    return scored.orderBy(F.desc("dense"), key).limit(k)


def lexical_topk(chunks: DataFrame, overlap: Column, k: int, key: str) -> DataFrame:
    """The `k` chunks of the highest overlap with the query above 0, ties by key: (key, lexical)."""
    return chunks.select(key, overlap.alias("lexical")).filter("lexical > 0").orderBy(F.desc("lexical"), key).limit(k)


def hybrid_hits(dense: DataFrame, lexical: DataFrame, key: str) -> DataFrame:
    """Union of both channels by chunk; a chunk without a lexical hit has overlap 0, one without a dense hit null."""
    both = dense.select(key, "dense", F.lit(0.0).alias("lexical")).unionByName(lexical.select(key, F.lit(None).cast("double").alias("dense"), "lexical"))
    return both.groupBy(key).agg(F.max("dense").alias("dense"), F.max("lexical").alias("lexical"))


def blend(dense: Column, lexical: Column, weight: float = LEXICAL_WEIGHT) -> Column:
    """Cosine brought to 0..1 and mixed with the overlap; alone where there is no overlap column value."""
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dense + 1) / 2))
    lex = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lexical))
    return F.when(lexical.isNull(), d).otherwise(d * (1 - weight) + lex * weight)


def best_chunk(hits: DataFrame, version: str, key: str, weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """A version's chunk of the highest blended score, ties by key; a chunk without cosine has 0 for it."""
    score = F.coalesce((F.col("dense") + 1) / 2, F.lit(0.0)) * (1 - weight) + F.col("lexical") * weight
    return hits.groupBy(version).agg(F.max_by(F.struct(key, "dense", "lexical"), F.struct(score.alias("s"), (-F.col(key)).alias("k"))).alias("best")).select(version, "best.*")


def page_of(hits: DataFrame, most: int) -> DataFrame:
    """A result page of at most `most` rows, evaluated once and held as a local table; more are an error."""
    rows = hits.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a page of {most} rows was announced")
    return hits.sparkSession.createDataFrame(rows, hits.schema)


def chained_matches(versions: DataFrame, page: DataFrame, query_vector: list[float] | None, words: list[str], weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """Each version with the score and the evidence of the first level that it has: adds dense, lexical, level, method
    and evidence.

    `versions` has version, document, status and vector of its own index entry; `page` is a page_of() chunk hits
    (version, chunk, dense, lexical, chunk_text). A version's best chunk counts where it has a cosine; else the cosine
    of the whole document where its entry is READY and the query has a vector; else the overlap of words, brought to
    the cosine's scale. Versions without a hit are left out, unless the retrieval found nothing at all: then all are
    read. The evidence is the chunk's text, else the first line that has a word, else the document's beginning.
    """
    best = best_chunk(page, "version", "chunk", weight).join(page.select("chunk", "chunk_text"), "chunk").withColumnsRenamed({"dense": "_dense", "lexical": "_lexical"})
    found = not page.isEmpty()
    rows = versions.join(F.broadcast(best), "version") if found else versions.join(best, "version", "left")  # a page is small
    document = F.coalesce("document", F.lit(""))
    share = word_overlap(document, words)
    chunked = F.col("_dense").isNotNull()
    whole = (F.col("status") == "READY") & F.col("vector").isNotNull() if query_vector else F.lit(False)
    level = F.when(chunked, "CHUNK").when(F.coalesce(whole, F.lit(False)), "DOCUMENT").otherwise("OVERLAP")
    cosine = strict_cosine(F.col("vector"), F.array(*map(F.lit, query_vector))) if query_vector else F.lit(None).cast("double")
    told = rows.withColumn("level", level).withColumn("_share", F.when(~chunked, share))
    line = evidence_line(document, words)
    method = F.when(chunked, "SEMANTIC_CHUNK").when(F.col("chunk").isNotNull(), "LEXICAL_CHUNK").when(F.exists(F.split(document, "\n"), lambda x: line_has(x, words)), "LEXICAL_LINE").otherwise("DOCUMENT_CONTEXT")
    return told.select(
        *versions.columns, "level",
        F.when(F.col("level") == "CHUNK", F.col("_dense")).when(F.col("level") == "DOCUMENT", cosine).otherwise(F.col("_share") * 2 - 1).alias("dense"),
        F.when(chunked, F.col("_lexical")).otherwise(F.col("_share")).alias("lexical"),
        method.alias("method"), F.when(F.col("chunk").isNotNull(), F.col("chunk_text")).otherwise(line).alias("evidence"),
    )


def line_has(line: Column, words: list[str]) -> Column:
    """Whether a line has one of the words as a whole token."""
    return F.exists(F.array(casefold(line)), lambda low: reduce(or_, (has_word(low, w) for w in words), F.lit(False)))


def evidence_line(doc: Column, words: list[str]) -> Column:
    """The first line that has one of the words, else the first CONTEXT_CHARS characters."""
    lines = F.filter(F.split(doc, "\n"), lambda line: line_has(line, words))
    return F.coalesce(F.get(lines, F.lit(0)), F.substring(doc, 1, CONTEXT_CHARS))


def coverage(have: Column, want: Column) -> Column:
    return F.size(F.array_intersect(have, want)) / F.size(want)


def coverage_gate(rows: DataFrame, have: str, explicit: list[str], read: list[str], minimum: float = 1.0, minimum_set: bool = False) -> DataFrame:
    """Rows that have at least `minimum` of the gate's skills.

    Skills given explicitly always gate; skills read from the query gate only where the caller set the minimum.
    """
    gate = sorted(set(explicit) | (set(read) if minimum_set else set()))
    return rows.filter(coverage(F.col(have), F.array(*map(F.lit, gate))) >= minimum) if gate else rows


def rank_versions(matches: DataFrame, now: Column, limit: int, required: list[str] = (), preferred: list[str] = (), minimum_experience: float = 0, category: str | None = None, hard_required: bool = False, hard_category: bool = False, weights: dict[str, float] = WEIGHTS, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """One row per profile: its best version, the score of 0..100, the components, and the other versions.

    `matches` has profile, version, number, dense (a cosine), lexical, skills, years, submitted and category. The
    active components are semantic and freshness, and those asked for; weights are scaled to the active total.
    Profiles go by rounded score, version number, then profile; a profile's versions by unrounded score and number.
    """
    if min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must not be negative and sum to 1")
    listed = lambda values: F.array(*map(F.lit, values))
    parts = {"semantic": blend(F.col("dense"), F.col("lexical"), lexical_weight)}
    if required:
        parts["required"] = coverage(F.col("skills"), listed(required))
    if preferred:
        parts["preferred"] = coverage(F.col("skills"), listed(preferred))
    if minimum_experience > 0:
        parts["experience"] = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("years")) / minimum_experience)
    age = (F.unix_micros(now) - F.unix_micros(F.col("submitted"))) / 86_400_000_000
    parts["freshness"] = F.when(F.col("submitted").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / FRESH_DAYS)))
    active = {k: weights[k] for k in parts}
    if category is not None:
        parts["category"] = F.when(F.col("category").isNull(), F.lit(0.5)).otherwise((F.col("category") == category).cast("double"))
        active["category"] = CATEGORY_WEIGHT
    rows = matches
    if hard_required and required:
        rows = rows.filter(F.size(F.array_except(listed(required), "skills")) == 0)
    if hard_category and category is not None:
        rows = rows.filter(F.coalesce("category", F.lit("UNCLASSIFIED")) == category)
    total = sum(active.values())
    score = sum((parts[k] * (active[k] / total) for k in parts), F.lit(0.0))
    scored = rows.select("profile", "version", "number", *(v.alias(f"c_{k}") for k, v in parts.items()), score.alias("raw"))
    versions = Window.partitionBy("profile").orderBy(F.desc("raw"), F.desc("number"), "version")
    placed = scored.withColumn("_place", F.row_number().over(versions))
    best = placed.groupBy("profile").agg(
        *(F.max(F.when(F.col("_place") == 1, F.col(c))).alias(c) for c in scored.columns if c != "profile"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_place") > 1, F.struct("_place", "version")))), lambda s: s["version"]).alias("others"),
    )
    return best.withColumn("score", F.round(F.col("raw") * 100, 2)).drop("raw").orderBy(F.desc("score"), F.desc("number"), "profile").limit(limit)


def fallback_cut(ranked: DataFrame, fallback: bool) -> DataFrame:
    """In keyword mode, rows whose semantic part is over one half; to be applied after the ranker's limit."""
    return ranked.filter("c_semantic > 0.5") if fallback else ranked


def rerank_blend(ranked: DataFrame, scores: DataFrame, limit: int, head: int = RERANK_HEAD, weight: float = RERANK_WEIGHT) -> DataFrame:
    """Mix the first `head` rows' scores with a reranker's (profile, rerank), sort them anew, append the rest as it is."""
    order = [F.desc("score"), F.desc("number"), "profile"]
    first = ranked.orderBy(*order).limit(head)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rerank")))
    mixed = F.when(F.col("rerank").isNotNull(), F.round((F.col("score") / 100 * (1 - weight) + clipped * weight) * 100, 2)).otherwise(F.col("score"))
    anew = first.join(scores, "profile", "left").withColumn("score", mixed).select(*ranked.columns, F.lit(0).alias("_last"))
    if limit <= head:
        return anew.orderBy(*order).limit(limit).drop("_last")
    rest = ranked.join(first.select("profile"), "profile", "left_anti").select(*ranked.columns, F.lit(1).alias("_last"))
    return anew.unionByName(rest).orderBy("_last", *order).limit(limit).drop("_last")


def confidence(score: Column, slope: float, intercept: float) -> Column:
    """Calibrated probability of a score of 0..100, rounded to 4 digits."""
    return F.round(sigmoid(slope * score / 100 + intercept), 4)


def warehouse_rank(docs: DataFrame, chunks: DataFrame, query_vector: list[float] | None, query_words: Column, required: list[str] = (), preferred: list[str] = (), category: str | None = None, limit: int = 20) -> DataFrame:
    """Weighted mean over the components present, by document: (cv, score, semantic, lexical, mode).

    Semantic is the best chunk's cosine, not below 0, and only with a query vector; lexical the best overlap of any
    chunk; category only where the query itself names one. `docs` has cv, skills and category; `chunks` cv, words,
    vector. Ties by cv.
    """
    overlap = F.size(F.array_intersect(query_words, "words")) / F.greatest(F.lit(1), F.size(query_words))
    semantic = F.greatest(F.lit(0.0), lenient_cosine(F.col("vector"), F.array(*map(F.lit, query_vector)))) if query_vector else F.lit(None).cast("double")
    best = chunks.groupBy("cv").agg(F.max(semantic).alias("semantic"), F.max(overlap).alias("lexical"))
    parts = {"lexical": F.coalesce("lexical", F.lit(0.0))}
    if query_vector:
        parts["semantic"] = F.coalesce("semantic", F.lit(0.0))
    for name, wanted in (("required", required), ("preferred", preferred)):
        if wanted:
            parts[name] = coverage(F.col("skills"), F.array(*map(F.lit, wanted)))
    if category is not None:
        parts["category"] = (F.col("category") == category).cast("double")
    total = sum(WAREHOUSE_WEIGHTS[k] for k in parts)
    score = sum((v * (WAREHOUSE_WEIGHTS[k] / total) for k, v in sorted(parts.items())), F.lit(0.0)) * 100
    mode = F.lit("HYBRID_SEMANTIC" if query_vector else "KEYWORD_FALLBACK")
    return docs.join(best, "cv", "left").select("cv", score.alias("score"), "semantic", "lexical", mode.alias("mode")).orderBy(F.desc("score"), "cv").limit(limit)


def warehouse_rerank(ranked: DataFrame, scores: DataFrame, head: int = WAREHOUSE_HEAD) -> DataFrame:
    """The first `head` rows by the reranker's score alone, the rest behind them as they were: adds place. The rows are
    numbered in one task: a ranker's result, as long as its caller's limit."""
    placed = ranked.withColumn("_was", F.row_number().over(Window.orderBy(F.desc("score"), "cv")))
    joined = placed.join(scores, "cv", "left")
    order = Window.orderBy((F.col("_was") > head).cast("int"), F.when(F.col("_was") > head, F.col("_was")), F.desc_nulls_last("rerank"), "_was")
    return joined.withColumn("place", F.row_number().over(order)).drop("_was", "rerank")


def result_rows(ranked: DataFrame, event: Column, query: Column) -> DataFrame:
    """Telemetry of a result: rank from 1 in final order, and the query as the SHA-256 of its folded text. The rows are
    numbered in one task: a ranker's result, as long as its caller's limit."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("number"), "profile"))
    return ranked.select(event.alias("event"), rank.alias("rank"), "profile", "score", F.sha2(F.lower(query), 256).alias("query_hash"))
