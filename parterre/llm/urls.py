"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule allows or blocks a host, its subdomains and the paths that start with its
own; the longest fitting rule wins, and of equally long ones blocking. URLs that
a rule fits are the labelled ones: a boosted-tree model (Spark's own, all in the
JVM) is trained on up to ``train_rows`` of them, chosen by hash, and judges the
others by length, depth, digit ratio, entropy, parameter counts and the block
rate of the host's suffix among the labelled.

Null URLs and URLs without ``://`` have empty host and path, fit no rule and are
judged by the model like others. Where the labelled URLs are all of one verdict
that verdict stands, and where there is none, ``allow``. Repeated URLs get equal
verdicts. A long URL is judged by expressions within its row. Only ``keep`` and the url are read, so other columns may have
any name. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parterre.llm.common import LOWER, UPPER, store

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
TRAIN_ROWS = 20_000
FEATURES = ["url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "mark_ratio", "entropy",
            "n_params", "query_length", "longest_run", "is_https", "suffix_rate"]


def with_parts(pages: DataFrame) -> DataFrame:
    """``host`` (A-Z lower-cased) and ``path`` of ``url``."""
    rest = F.coalesce(F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) end"), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return pages.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``, as (rule, verdict); null if none does."""
    def fitting(rule: str, verdict: str) -> Column:
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        return F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))

    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block"))
    return F.coalesce(*[fitting(*r) for r in ordered], F.lit(None).cast("struct<rule:string,verdict:string>"))


def with_features(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    share = lambda kept: F.length(F.regexp_replace(url, kept, "")) / size
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c == "", 0.0).otherwise(
        (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size))
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    runs = F.transform(F.split(url, r"[^A-Za-z0-9]+"), lambda x: F.length(x))
    count = lambda text, mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")
    return pages.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"), "host_depth": count(F.col("host"), "."),
        "path_depth": count(F.col("path"), "/"), "digit_ratio": share("[^0-9]+"), "mark_ratio": share("[A-Za-z0-9]+"),
        "entropy": entropy, "n_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "query_length": F.length(query).cast("double"), "longest_run": F.array_max(runs).cast("double"),
        "is_https": url.startswith("https:").cast("double")})


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, train_rows: int = TRAIN_ROWS,
               trees: int = 12, depth: int = 3, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns with host, path, rule, verdict, and block_score (null where a rule decides)."""
    judged = with_features(with_parts(pages.select(F.struct(*keep).alias("_kept"), "url"))).withColumn("_r", rule_of(rules))
    labelled = judged.where("_r is not null").withColumn("label", (F.col("_r.verdict") == "block").cast("double"))

    # block rate of a suffix, drawn to the overall rate by 20 rows' weight
    total = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("rate"), F.min("label").alias("a"), F.max("label").alias("b")).first()
    rate = total["rate"] if total["n"] else 0.0
    rates = store(labelled.groupBy("suffix").agg(
        ((F.sum("label") + 20 * rate) / (F.count("*") + 20)).alias("suffix_rate")), "url-suffixes")
    placed = lambda rows: rows.join(rates, "suffix", "left").fillna({"suffix_rate": rate})

    if not total["n"] or total["a"] == total["b"]:
        scored = judged.withColumn("block_score", F.lit(rate))
    else:
        # by hash, so that every labelled URL has the same chance and a rerun takes the same ones
        part = min(1.0, train_rows / total["n"])
        chosen = F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < round(part * 1_000_000)
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
        train = store(placed(labelled.where(chosen)).select("label", *FEATURES), "url-train")
        if train.agg(F.countDistinct("label")).first()[0] < 2:
            scored = judged.withColumn("block_score", F.lit(rate))
        else:
            model = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_class",
                                  maxIter=trees, maxDepth=depth, seed=7)
            fitted = model.fit(assemble.transform(train))
            scored = fitted.transform(assemble.transform(placed(judged))).withColumn("block_score", vector_to_array("probability")[1])
    by_model = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("_kept.*", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", by_model).alias("verdict"),
                         F.when(F.col("_r").isNull(), F.col("block_score")).alias("block_score"))
