"""URL filters: host and path rules first, a logistic regression for the rest.

Rules are (host, path prefix) pairs that allow or block; a rule fits its host
and all subdomains, and the longest that fits wins.  Urls without a rule are
judged by a logistic regression on hashed character n-grams of host and path,
trained from a small labelled url table.  Everything is built from SQL
functions and MLlib stages, row by row: no shuffle of the pages, so a hot
host costs nothing extra.

The labelled table holds at most MAX_LABELLED distinct urls (by hash); where
none is given, it is taken from the urls that a rule decides.  With labels of
one class only, or none, urls without a rule are allowed.

Defined results: a null url or one without ``://`` has an empty host and
path; repeated rows give repeated results; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Distinct urls in the labelled table, at most.
MAX_LABELLED = 10_000
N = (3, 4)
BUCKETS = 1 << 14
#: Rule text -> verdict.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``."""
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null.  The rules are a short list and become one expression."""
    longest_first = sorted(rules, key=lambda r: (-len(r), r))
    found = F.lit(None).cast("string")
    for rule in reversed(longest_first):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    return reduce(lambda c, r: c.when(rule == r, rules[r]), rules, F.when(F.lit(False), F.lit("")))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by where they are from; linear in the length."""
    def of(mark: str, value: Column, n: int) -> Column:
        padded = F.concat(F.lit("^"), value, F.lit("$"))
        return F.transform(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)),
                           lambda g: F.concat(F.lit(mark), g))

    return F.concat(*(of(mark, value, n) for mark, value in (("h", host), ("p", path)) for n in N))


def parsed(pages: DataFrame, rules=RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """Rows (key, host, path, rule)."""
    host, path = host_and_path(F.col(url).cast("string"))
    return (pages.select(F.col(key), host.alias("host"), path.alias("path"))
            .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))


def labelled_by_rules(urls: DataFrame, rules=RULES, bound: int = MAX_LABELLED) -> DataFrame:
    """A labelled table (host, path, blocked) of at most ``bound`` distinct urls that a rule decides."""
    decided = urls.filter("rule is not null").select(
        "host", "path", (verdict_of(F.col("rule"), rules) == "block").cast("double").alias("blocked")).distinct()
    return decided.orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(bound)


def _hashed(urls: DataFrame) -> DataFrame:
    with_grams = urls.withColumn("__grams", grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__features").transform(with_grams)


def train(labelled: DataFrame, bound: int = MAX_LABELLED) -> LogisticRegressionModel | None:
    """The model of a labelled table (host, path, blocked), or None without labels of both classes.

    At most ``bound`` rows, by hash, are written once and read by every pass of the fit.
    """
    order = [F.xxhash64("host", "path"), F.col("host"), F.col("path"), F.col("blocked")]
    table = written(labelled.select("host", "path", "blocked").orderBy(*order).limit(bound), "url-labels")
    classes = table.agg(F.min("blocked"), F.max("blocked")).first()
    if classes[0] is None or classes[0] == classes[1]:
        return None
    return LogisticRegression(featuresCol="__features", labelCol="blocked", maxIter=30, regParam=1e-3).fit(_hashed(table))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, url: str = "url",
          key: str = "page_id") -> DataFrame:
    """Per page: key, host, path, rule, verdict, and blocked_score (the model's probability, null with a rule)."""
    urls = parsed(pages, rules, url, key)
    model = train(labelled if labelled is not None else labelled_by_rules(urls, rules))
    if model is None:
        scored = urls.withColumn("__p", F.lit(0.0))
    else:
        model.setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__prediction")
        scored = model.transform(_hashed(urls)).withColumn("__p", vector_to_array("__probability")[1])
    learned = F.when(F.col("__p") >= 0.5, "block").otherwise("allow")
    no_rule = F.col("rule").isNull()
    return scored.select(
        key, "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), learned).alias("verdict"),
        F.when(no_rule, F.col("__p")).alias("blocked_score"))
