"""URL verdicts: host and path rules, else gradient-boosted trees on lexical features.

Everything is DataFrame expressions and Spark's own tree learner.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Steps

# (verdict, host, path). A rule fits its host and all subdomains of it.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
SAMPLE_ROWS = 16_000  # most labelled URLs that the trees are fitted on
TREES, DEPTH = 12, 4
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy",
    "parameters", "suffix_rate", "suffix_weight",
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both are empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, kind).otherwise(verdict)
    return text, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that a URL alone gives, and its suffix (the last label of the host)."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    length = F.length(url)
    of = F.greatest(length, F.lit(1))
    share = lambda c: (length - F.length(F.replace(url, c, F.lit("")))) / of
    characters = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    entropy = F.aggregate(characters, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return urls.withColumns({
        "url_length": length, "host_length": F.length(host), "path_length": F.length(path),
        "depth": length - F.length(F.replace(url, F.lit("/"), F.lit(""))),
        "host_labels": F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))),
        "digit_ratio": (length - F.length(F.translate(url, "0123456789", ""))) / of,
        "entropy": entropy,
        "parameters": F.regexp_count(url, F.lit(r"[?&;][^=&;#?]+=")),
        "suffix": F.substring_index(host, ".", -1),
    })


def with_suffixes(urls: DataFrame, suffixes: DataFrame, overall: float) -> DataFrame:
    return urls.join(suffixes, "suffix", "left").withColumns({
        "suffix_rate": F.coalesce("suffix_rate", F.lit(overall)),
        "suffix_weight": F.coalesce("suffix_weight", F.lit(0.0)),
    })


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH):
    """A function that adds `score`, the probability that a URL is bad, to lexical features.

    `labelled` has url, host, path and bad (0 or 1). At most `sample_rows` rows are used, those
    with the smallest hashes of their URL. Without rows of both classes the score is the share of
    bad rows, 0 if there are none.
    """
    rows = labelled.filter("bad is not null and url is not null").select("url", "host", "path", F.col("bad").cast("double"))
    sample = Steps(labelled.sparkSession).write(
        lexical(rows.orderBy(F.xxhash64("url"), "url", "bad").limit(sample_rows)), "url-sample"
    )
    found = sample.agg(F.count("*").alias("n"), F.coalesce(F.avg("bad"), F.lit(0.0)).alias("rate")).first()
    if not 0 < found.rate < 1:
        return lambda urls: urls.withColumn("score", F.lit(float(found.rate)))
    suffixes = sample.groupBy("suffix").agg(
        ((F.sum("bad") + 10 * found.rate) / (F.count("*") + 10)).alias("suffix_rate"),
        F.log1p(F.count("*")).alias("suffix_weight"),
    )
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    learner = GBTClassifier(
        labelCol="bad", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7,
        minInstancesPerNode=5,
    )
    model = learner.fit(gather.transform(with_suffixes(sample, suffixes, found.rate)))

    def scored(urls: DataFrame) -> DataFrame:
        out = model.transform(gather.transform(with_suffixes(urls, suffixes, found.rate)))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    return scored


def judge_urls(
    pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per page.

    `labels` has url and bad. The longest rule that fits decides; else a URL whose score reaches
    `threshold` is blocked. A null URL has empty host and path and no rule. Repeated rows are
    judged each on their own; empty tables give no rows, other columns are not read.
    """
    def parts(df: DataFrame, keep: list[Column]) -> DataFrame:
        host, path = url_parts(F.col("url"))
        return df.select(*keep, "url", host.alias("host"), path.alias("path"))

    urls = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")), [F.col("page_id")])
    score = fit(parts(labels, [F.col("bad")]))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return score(lexical(urls)).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
