"""Quality rules: base counts, then robust multivariate outliers per language and source.

The counts of a document are column expressions over its whole text. Their
transformed ratios form a vector; for each language and source the
minimum-covariance-determinant estimate (center and scatter of the most compact
three quarters) is found by concentration steps, each one grouped aggregate, and
vectors too far from it in Mahalanobis distance are rejected. Groups under
``min_rows`` are judged by the estimate of all rows of their language, large
sources included, and languages under it by that of all rows.

Null text counts as empty. A document that fails the base rules is neither used
for the estimates nor judged by them. Null languages and sources form groups of
their own. Equal rows get equal verdicts. Only the needed columns are read, so
extra columns don't matter; an empty table gives no rows. A text is counted
within its row, whatever its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parterre.llm.common import NOT_SPACE, let, matches, store

WINDOW = 8
#: Share of a group that the estimate rests on; steps; distance squared above which a vector is rejected: what one normal
#: vector of five in a thousand exceeds (chi2 with 5).
CORE, STEPS, CUTOFF = 0.75, 3, 20.515
#: Makes the scatter of the core three quarters consistent for normal vectors of five: 0.75 / P(chi2 with 7 < 6.626).
CONSISTENCY = 1.41
#: The least standard deviation of each feature: log words, mean word length, and the square roots of the symbol,
#: repeated-line and repeated-word shares. Shares that are zero nearly everywhere have no scatter of their own.
FEATURES = {"f_words": 0.3, "f_length": 0.15, "f_symbols": 0.05, "f_lines": 0.08, "f_repeats": 0.08}
MIN_ROWS = 200


def _repeated_words(words: Column) -> Column:
    """Words inside windows that occur twice or more, overlaps counted once."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x))

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) > WINDOW, found).otherwise(0)


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    counts = let(matches(text, NOT_SPACE + "+"), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w).cast("long").alias("n_repeat_words")))
    return docs.select(
        *keep, counts.alias("_counts"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
    ).select(*keep, "_counts.n_words", "_counts.word_chars", "n_symbols", "n_dup_lines", "n_lines", "_counts.n_repeat_words")


def _distance(scaled: list[Column]) -> Column:
    """Squared length of the solution of L z = x - center; ``l_i_j`` and ``c_i`` are columns of the row."""
    z: list[Column] = []
    for i, x in enumerate(scaled):
        rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * z[k], range(i), x - F.col(f"c_{i}"))
        z.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in z])


def _estimate(rows: DataFrame) -> DataFrame:
    """Center and factored scatter of each group's rows."""
    names = list(FEATURES)
    sums = rows.groupBy("g").agg(
        F.count("*").alias("n"), *[F.avg(x).alias(f"c_{i}") for i, x in enumerate(names)],
        *[F.covar_pop(x, names[j]).alias(f"s_{i}_{j}") for i, x in enumerate(names) for j in range(i + 1)])
    floor = list(FEATURES.values())
    # one column at a time, so that each entry of the factor is a short expression over earlier columns
    out = sums.select("g", *[f"c_{i}" for i in range(len(names))], *[
        ((F.col(f"s_{i}_{j}") * CONSISTENCY) + (floor[i] ** 2 if i == j else 0.0)).alias(f"s_{i}_{j}")
        for i in range(len(names)) for j in range(i + 1)])
    for i in range(len(names)):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"s_{i}_{j}"))
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return out.drop(*[f"s_{i}_{j}" for i in range(len(names)) for j in range(i + 1)])


def _start(rows: DataFrame) -> DataFrame:
    """Medians as center, and the distance of the middle half as independent spread."""
    names, floor = list(FEATURES), list(FEATURES.values())
    quartiles = rows.groupBy("g").agg(*[
        F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, x in enumerate(names)])
    spread = lambda i: F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(floor[i]))
    return quartiles.select(
        "g", *[F.col(f"q_{i}")[1].alias(f"c_{i}") for i in range(len(names))],
        *[(spread(i) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(len(names)) for j in range(i + 1)])


def quality_rules(docs: DataFrame, core: float = CORE, steps: int = STEPS, cutoff: float = CUTOFF,
                  min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``distance`` (squared, null if failed) and ``kept``."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = store(base_counts(docs, "doc_id", "lang", "source").withColumns({
        "base_failed": failed, "f_words": F.log1p("n_words"),
        "f_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        "f_symbols": share("n_symbols", "word_chars"), "f_lines": share("n_dup_lines", "n_lines"),
        "f_repeats": share("n_repeat_words", "n_words")}), "quality-counts")

    # the group that judges a row: language and source, or what is large enough around it
    sizes = counts.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("lang"))
    # nulls are named, or a null source would be taken for its whole language
    named = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    groups = store(sizes.withColumn("n_lang", whole).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
        F.when(F.col("n") >= min_rows, named("lang", "source"))
        .when(F.col("n_lang") >= min_rows, named("lang")).otherwise("{}").alias("g"),
        F.array(named("lang", "source"), named("lang"), F.lit("{}")).alias("around")), "quality-groups")
    # a row counts for each group around it that judges any row, its own or others'
    feeds = store(groups.select("g_lang", "g_source", F.explode("around").alias("g")).join(
        groups.select("g").distinct(), "g", "left_semi"), "quality-feeds")
    groups = groups.drop("around")
    in_group = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    rows = counts.where("not base_failed").join(feeds, in_group).select("g", *FEATURES)

    features = [F.col(x) for x in FEATURES]
    fit = store(_start(rows), "quality-fit")
    for _ in range(steps):
        placed = rows.join(fit, "g").select("g", *FEATURES, _distance(features).alias("d"))
        bound = store(placed.groupBy("g").agg(F.percentile_approx("d", core, 10000).alias("most")), "quality-bound")
        fit = store(_estimate(placed.join(bound, "g").where("d <= most")), "quality-fit")
    distance = F.when(~F.col("base_failed"), _distance(features))
    judged = counts.join(groups, in_group, "left").join(fit, "g", "left").withColumn("distance", distance)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"), "distance")
