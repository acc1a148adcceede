"""URL filters: explicit rules, then logistic regression on hashed character n-grams of host and path.

Everything runs as DataFrame expressions and the JVM's own learner. The learner is trained on a small
table of labelled URLs: those that a rule decides, at most MAX_TRAINING distinct ones, half of each verdict, the first by a hash.
Rules are a driver-side list of at most MAX_RULES.

A null URL, or one without "://", has an empty host and path, fits no rule and gets the method's verdict,
as does any URL no rule fits. With no labelled URL, or labels of one kind only, the verdict is that kind,
else allow. Repeated rows are judged alike, and are one URL for the learner. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import shared

#: Fixed values: (verdict, rule).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
MAX_RULES = 1000
MAX_TRAINING = 4000
FEATURES = 1 << 14
GRAMS = (2, 3, 4)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    domain, slash, rest = rule.partition("/")
    return ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)


def ruled(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are held in one expression")
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule = F.when(fits(text, host, path), F.lit(text)).otherwise(rule)
        verdict = F.when(fits(text, host, path), F.lit(kind)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with where it stands."""

    def of(text: Column, mark: str, n: int) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        return F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(f"{mark}{n}:"), F.substring(padded, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(text, mark, n) for text, mark in ((host, "h"), (path, "p")) for n in GRAMS))


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES, max_training: int = MAX_TRAINING, features: int = FEATURES) -> DataFrame:
    """For each row: page_id, host, path, rule, verdict and p_block, the learner's probability."""
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    parts = parts.withColumns({"rule": rule, "said": verdict})
    chosen = shared.written(training(parts.where("said is not null"), max_training), "labelled")
    kinds = {r["said"] for r in chosen.select("said").distinct().collect()}
    if len(kinds) < 2:
        alone = "block" if "block" in kinds else "allow"
        p = F.lit(1.0 if alone == "block" else 0.0)
        return parts.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(alone)).alias("verdict"), p.alias("p_block"))
    scored = learned(chosen, parts, F.col("said"), features)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def training(labelled: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """host, path, said and n, its number of rows, for half of `most` distinct URLs of each verdict at most, the first by a hash. However often a URL is repeated, it is one
    row, and each verdict that has any has some."""
    urls = labelled.groupBy("host", "path", "said").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("said").orderBy(F.xxhash64("host", "path"), "host", "path"))
    return urls.withColumn("place", place).where(F.col("place") <= max(1, most // 2)).drop("place")


def learned(labelled: DataFrame, parts: DataFrame, verdict: Column, features: int = FEATURES) -> DataFrame:
    """parts (host, path, ...) with p_block, from a learner fitted on labelled (host, path, ...; n, the number of rows, if there is one), a small table, whose verdict
    tells block from allow. A URL counts by the logarithm of its number of rows, so one that is repeated without end doesn't drown the others."""
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
    weight = F.log2(F.col("n") + 1) if "n" in labelled.columns else F.lit(1.0)
    rows = labelled.select("host", "path", F.when(verdict == "block", 1.0).otherwise(0.0).alias("label"), weight.cast("double").alias("weight")).orderBy("host", "path", "label").coalesce(1)
    model = LogisticRegression(regParam=0.01, maxIter=30, featuresCol="features", labelCol="label", weightCol="weight").fit(hashed.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path")))))
    scored = model.transform(hashed.transform(parts.withColumn("grams", grams(F.col("host"), F.col("path")))))
    return scored.select(*parts.columns, vector_to_array("probability")[1].alias("p_block"))


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
