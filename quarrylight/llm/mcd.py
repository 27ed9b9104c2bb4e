"""Operator 1, quality rules: base statistics and robust multivariate outliers, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, held, let, released, spaced, written

#: Characters that the base rules count as symbols.
SYMBOL = "[#*$%&|<>]"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Exact count of the words inside 3-word windows found twice or more.

    Each window becomes one long, a hash prefix over its position, so that sorting puts windows of one prefix side by
    side. Those that share a prefix are sorted once more by their words, which makes equal ones neighbours.
    """

    def counted(w: Column, m: Column, s: Column) -> Column:
        near = F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1), F.lit(0)).bitwiseAND(-m) == x.bitwiseAND(-m)) & (i > 0) | (F.coalesce(F.get(s, i + 1), F.lit(0)).bitwiseAND(-m) == x.bitwiseAND(-m)) & (i < F.size(s) - 1))
        spelled = F.transform(F.transform(near, lambda x: x.bitwiseAND(m - 1).cast("int")), lambda p: F.struct(w[p].alias("a"), w[p + 1].alias("b"), w[p + 2].alias("c"), p.alias("p")))
        return let(F.sort_array(spelled), covered)

    def covered(t: Column) -> Column:
        same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        twice = F.filter(t, lambda x, i: same(x, F.get(t, i - 1)) | same(x, F.get(t, i + 1)))
        return F.size(let(F.transform(twice, lambda x: x["p"]), lambda at: F.array_distinct(F.concat(at, F.transform(at, lambda p: p + 1), F.transform(at, lambda p: p + 2)))))

    def packed(w: Column, m: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(-m).bitwiseOR(i.cast("long")))

    #: The power of two above the number of words: positions lie below it, hash prefixes above.
    room = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(words) + 1.0))).cast("long")
    return let(room, lambda m: let(F.sort_array(packed(words, m)), lambda s: counted(words, m, s)))


def statistics(text: Column) -> Column:
    """The row-local counts of a whole text as a struct of STATISTICS; a null or empty text counts as zero everywhere.

    Only texts whose window hashes repeat at all go through the exact comparison; equal windows have equal hashes, so
    none is missed.
    """
    t = F.coalesce(text, F.lit(""))
    size = lambda c: F.size(c).cast("long")

    def measured(pieces: Column, full: Column) -> Column:
        return let(F.array_remove(pieces, ""), lambda w: let(F.when(F.size(w) > 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))), lambda windows: F.struct(
            size(w).alias("n_words"),
            (F.length(t).cast("long") - size(pieces) + 1).alias("word_chars"),
            (size(F.split(t, SYMBOL)) - 1).alias("n_symbols"),
            size(full).alias("n_lines"),
            (size(full) - size(F.array_distinct(full))).alias("n_dup_lines"),
            F.when(F.size(F.array_distinct(windows)) < F.size(windows), _repeat_words(w)).otherwise(0).cast("long").alias("n_repeat_words"),
        )))

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x09-\\x0D\\x20]"))
    return let(F.split(spaced(t), " "), lambda pieces: let(lines, lambda full: measured(pieces, full)))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add STATISTICS of every whole text; `docs` keeps its columns, those with clashing names are replaced."""
    return released(held(docs, s=statistics(F.col(text))).select("docs", "s.*"), *STATISTICS)


#: Names of the transformed statistics, kept as whole thousandths so that sums are exact in any order.
FEATURES = ("x1", "x2", "x3", "x4")
#: Standard deviations in thousandths that every feature has at least. Most texts have no symbols or repeats at all, so
#: that a pool's own scatter is often zero; then a floor times the root of CUTOFF is what one feature alone may reach:
#: a mean word 1.5 times as long, 22 % of symbols, 68 % of repeated lines, 49 % of repeated words. Anything less is
#: for the base rules and for the features together to judge.
FLOORS = (80, 100, 200, 160)
#: Share of a pool that the determinant is minimised over, and the factor that makes its covariance consistent
#: for 4 normal features: 0.75 / P(chi2_6 <= 5.385).
SUBSET, CONSISTENCY = 0.75, 1.485
#: Chi-square quantile 0.975 with 4 degrees of freedom, up to which rows count in the reweighted estimate, and its
#: factor: 0.975 / P(chi2_6 <= 11.143).
INLIER, REWEIGHTED = 11.143, 1.0646
#: Chi-square quantile 0.9999 with 4 degrees of freedom.
CUTOFF = 23.513
#: Fewest texts of a language and source with an estimate of their own.
LEAST_POOL = 40
#: Concentration steps; each can only lower the determinant, and few change it after the fourth.
STEPS = 4
#: Squared distances are binned by sixteenths up to this bin, so a pool's histogram has a fixed size.
LAST_BIN = 1024
#: Most pools whose estimates are broadcast (a digest and 14 doubles each, 4 MB in all); more are joined by a shuffle.
BROADCAST_POOLS = 20_000
#: The pool of all rows.
ALL = "all"
_D = range(len(FEATURES))
_ESTIMATE = [*(f"m{i}" for i in _D), *(f"l{i}{j}" for i in _D for j in range(i + 1))]


def features(stats: DataFrame) -> DataFrame:
    """Transformed statistics: log word length, and arcsine roots of the shares of symbols, repeated lines and repeated words."""
    scaled = lambda e: F.expr(f"cast(floor(1000 * ({e}) + 0.5) as bigint)")
    return stats.withColumns(
        {
            "x1": scaled("ln(cast(word_chars as double) / nullif(n_words, 0))"),
            "x2": scaled("asin(sqrt(cast(n_symbols as double) / nullif(word_chars, 0)))"),
            "x3": scaled("asin(sqrt(cast(n_dup_lines as double) / nullif(n_lines, 0)))"),
            "x4": scaled("asin(sqrt(cast(n_repeat_words as double) / nullif(n_words, 0)))"),
        }
    )


def _pools(rows: DataFrame, least: int) -> DataFrame:
    """(pool): the keys that need an estimate. A language and source of `least` rows has its own; the sources of a
    language with fewer share one of all the language, and languages with fewer than `least` rows one of all rows."""
    sizes = written(rows.groupBy("own", "lang").agg(F.count("*").alias("n")), "sizes")
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("n"), F.min("n").alias("smallest"))
    own = sizes.filter(F.col("n") >= least).select(F.col("own").alias("pool"))
    shared = langs.filter((F.col("smallest") < least) & (F.col("n") >= least)).select(F.col("lang").alias("pool"))
    rest = langs.agg(F.min("n").alias("smallest"), F.sum("n").alias("n")).filter((F.col("smallest") < least) & (F.col("n") >= least)).select(F.lit(ALL).alias("pool"))
    return written(own.union(shared).union(rest), "pools")


def _by_key(rows: DataFrame, small: DataFrame, on: Column, how: str, few: bool) -> DataFrame:
    """Join to a table with few fixed-width rows for each pool: broadcast if the pools are few, else shuffled (skew left to AQE)."""
    return rows.join(F.broadcast(small) if few else small, on, how)


def _estimates(sums: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Means and the Cholesky factor of the scatter from n and the sums of products, by keys."""
    out = sums.withColumns({f"m{i}": F.expr(f"cast(s{i} as double) / n") for i in _D})
    cov = lambda i, j: f"({factor} * (cast(p{i}{j} as double) / n - m{i} * m{j}){f' + {FLOORS[i] ** 2}' if i == j else ''})"
    for j in _D:
        inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        out = out.withColumn(f"l{j}{j}", F.expr(f"sqrt(greatest({cov(j, j)}{inner}, {FLOORS[j] ** 2 / 4}))"))
        for i in range(j + 1, len(FEATURES)):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out = out.withColumn(f"l{i}{j}", F.expr(f"({cov(i, j)}{inner}) / l{j}{j}"))
    return out.select(*keys, *_ESTIMATE)


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i in _D for j in range(i + 1))]


def _distance(rows: DataFrame) -> Column:
    """Squared Mahalanobis distance by forward substitution; null without an estimate."""
    z: list[Column] = []
    for i, x in enumerate(FEATURES):
        inner = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            inner = inner - F.col(f"l{i}{k}") * z[k]
        z.append(inner / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _measured(rows: DataFrame, estimates: DataFrame, few: bool = True) -> DataFrame:
    """Every row of a pool with its distance by each of the pool's estimates."""
    other = estimates.withColumnRenamed("pool", "_pool").withColumn("pool", F.col("_pool"))
    met = _by_key(rows.withColumnRenamed("pool", "of"), other.drop("_pool"), F.col("of") == F.col("pool"), "inner", few).drop("of")
    return met.select("pool", "start", *FEATURES, _distance(met).alias("distance"))


def _concentrated(rows: DataFrame, share: float) -> DataFrame:
    """n and sums, by pool and start, over the smallest distance bins that hold `share` of a pool: one pass, then a
    window over its bins, of which there are LAST_BIN + 1 at most."""
    bins = rows.withColumn("bin", F.expr(f"cast(least(floor(16 * distance), {LAST_BIN}) as int)")).groupBy("pool", "start", "bin").agg(*_sums())
    pool = Window.partitionBy("pool", "start")
    before = F.coalesce(F.sum("n").over(pool.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = bins.withColumns({"_before": before, "_all": F.sum("n").over(pool)}).filter(F.col("_before") < share * F.col("_all"))
    return inside.groupBy("pool", "start").agg(*(F.sum(c).alias(c) for c in bins.columns if c not in ("pool", "start", "bin")))


def minimum_determinant(rows: DataFrame, few: bool = True) -> DataFrame:
    """(pool, m.., l..): the reweighted minimum-covariance-determinant estimate of each pool of (pool, features); `few`
    tells whether the pools are at most BROADCAST_POOLS.

    Concentration steps go from three starts at once: the medians with quartile spreads, the means and covariances of
    all rows, and those of the half nearest the medians. Of the three ends the one of least determinant stays (of
    equal ones the first start's); a last step takes all rows within INLIER of it. Percentiles hold a count for each
    of the few thousand values that a feature can have.
    """
    spread = lambda i: f"sqrt((q{i}[2] - q{i}[0]) * (q{i}[2] - q{i}[0]) / 1.8198 + {FLOORS[i] ** 2})"
    both = written(rows.groupBy("pool").agg(*(F.percentile(x, [0.25, 0.5, 0.75]).alias(f"q{i}") for i, x in enumerate(FEATURES)), *_sums()), "starts")
    median = both.select("pool", F.lit(0).alias("start"), *(F.expr(f"q{i}[1]").alias(f"m{i}") for i in _D), *((F.expr(spread(i)) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in _D for j in range(i + 1)))
    whole = _estimates(both.withColumn("start", F.lit(1)), 1.0, "pool", "start")
    half = _estimates(_concentrated(_measured(rows, median, few), 0.5), 1.0, "pool", "start").withColumn("start", F.lit(2))
    now = written(median.unionByName(whole).unionByName(half), "estimates")
    for _ in range(STEPS):
        now = written(_estimates(_concentrated(_measured(rows, now, few), SUBSET), CONSISTENCY, "pool", "start"), "estimates")
    size = sum((F.log(f"l{i}{i}") for i in _D), F.lit(0.0))
    best = now.groupBy("pool").agg(F.min_by(F.struct("start", *_ESTIMATE), F.struct(size, "start")).alias("e")).select("pool", "e.*")
    inliers = _measured(rows, written(best, "estimates"), few).filter(F.col("distance") <= INLIER)
    return written(_estimates(inliers.groupBy("pool").agg(*_sums()), REWEIGHTED, "pool"), "estimates")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_pool: int = LEAST_POOL, cutoff: float = CUTOFF) -> DataFrame:
    """Add the base statistics, base_failed, the robust distance of the transformed statistics, and kept.

    Location and scatter are minimum-covariance-determinant estimates per language and source over the rows that
    pass the base rules; a language and source of fewer than `least_pool` of these is judged by its language's
    estimate, a language of fewer by that of all rows, and only a table of fewer has none (distance null, kept). The
    subset is whole distance bins, so it is defined without ties, and all sums are of whole numbers, so it doesn't
    depend on the order of rows. Null languages and sources count as values of their own; a null or empty text fails
    the base rules. Repeated rows count as often as they occur; an empty table gives an empty one. A very long text is
    one row's work: its words and windows are arrays in one task. Columns keep their names, whatever these are, but
    for those that the operator adds itself, which replace them.
    """
    return released(judged(docs, text, lang, source, least_pool, cutoff), *STATISTICS, "base_failed", "distance", "kept")


def passed(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_pool: int = LEAST_POOL, cutoff: float = CUTOFF) -> DataFrame:
    """The rows that quality_rules() keeps, with the columns of `docs` alone, whatever their names."""
    return released(judged(docs, text, lang, source, least_pool, cutoff).filter("kept"))


def judged(docs: DataFrame, text: str, lang: str, source: str, least_pool: int, cutoff: float) -> DataFrame:
    """`docs` as held() holds it, beside the columns that quality_rules() adds."""
    key = lambda *c: F.md5(F.to_json(F.struct(F.lit(len(c)).alias("k"), *(F.col(x).cast("string").alias(f"c{i}") for i, x in enumerate(c)))))
    rows = held(docs, own=key(lang, source), lang=key(lang), s=statistics(F.col(text))).select("docs", "own", "lang", "s.*")
    saved = written(rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "quality")
    fit = written(features(saved.filter(~F.col("base_failed")).select("own", "lang", *STATISTICS)).select("own", "lang", *FEATURES), "features")
    pools = _pools(fit, least_pool)
    spread = fit.select(F.explode(F.array("own", "lang", F.lit(ALL))).alias("of"), *FEATURES)
    few = pools.count() <= BROADCAST_POOLS
    member = written(_by_key(spread, pools, F.col("of") == F.col("pool"), "inner", few).select("pool", *FEATURES), "members")
    estimates = minimum_determinant(member, few)
    drop_written(member)
    out = features(saved)
    for name, on in (("by_own", F.col("own")), ("by_lang", F.col("lang")), ("by_all", F.lit(ALL))):
        out = _by_key(out, estimates.select("pool", F.struct(*_ESTIMATE).alias(name)), on == F.col("pool"), "left", few).drop("pool")
    out = out.withColumn("e", F.coalesce("by_own", "by_lang", "by_all")).select("docs", *STATISTICS, "base_failed", *FEATURES, "e.*")
    far = out.withColumn("distance", F.when(~F.col("base_failed"), _distance(out)))
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
