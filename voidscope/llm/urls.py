"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for the rest.

Native: column expressions and Spark ML only.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import bounded_sample

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict); a rule fits its host and every subdomain where the path starts with the rule's.
RULES = (
    ("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK),
)
SLOTS = 1 << 12
GRAMS = (3, 4)
PER_VERDICT = 1000  # bound of the labelled URL table, rows of each verdict
ROUNDS, RIDGE = 50, 0.01
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a NULL url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest fitting rule as text, and its verdict; NULL where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # later conditions stand in front
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host between ``^`` and ``$``, and of the path with digits folded to 0."""
    out = []
    folded = F.translate(F.translate(path, _UPPER, _LOWER), "123456789", "000000000")
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), folded, F.lit("$")))):
        for n in GRAMS:
            last = F.length(text) - n + 1
            starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            out.append(_pieces(mark, text, starts, n))
    return F.concat(*out)


def _pieces(mark: str, text: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))


def _vectors(pages: DataFrame) -> DataFrame:
    hashed = HashingTF(numFeatures=SLOTS, inputCol="_grams", outputCol="_vector", binary=True)
    return hashed.transform(pages.withColumn("_grams", grams(F.col("host"), F.col("path")))).drop("_grams")


def labelled_urls(pages: DataFrame, rules=RULES, per_verdict: int = PER_VERDICT) -> DataFrame:
    """Small labelled table ``host, path, label`` (1: block): urls that a rule decides, bounded per verdict."""
    host, path = split_url(F.col("url"))
    rows = pages.select("url").withColumns({"host": host, "path": path})
    _, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("verdict", verdict).filter("verdict is not null")
    return bounded_sample(ruled, "verdict", "url", per_verdict).select(
        "host", "path", (F.col("verdict") == BLOCK).cast("double").alias("label"))


def learn(labelled: DataFrame) -> LogisticRegressionModel | None:
    """Logistic regression on ``host, path, label``; None unless both labels are there."""
    if labelled.select("label").distinct().limit(2).count() < 2:
        return None
    rows = _vectors(labelled.coalesce(1))  # a bounded table
    return LogisticRegression(
        featuresCol="_vector", labelCol="label", predictionCol="_predicted", probabilityCol="_probability",
        rawPredictionCol="_raw", maxIter=ROUNDS, regParam=RIDGE).fit(rows)


def judge(pages: DataFrame, model: LogisticRegressionModel | None, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages(page_id, url)``.

    The longest fitting rule decides, else the model (0.5 and more: block; without a model: allow). NULL urls
    and urls without ``://`` have empty host and path, so no rule fits. Repeated rows give repeated results;
    further columns of the input are not read.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_verdict": verdict})
    if model is None:
        guess = F.lit(ALLOW)
    else:
        rows = model.transform(_vectors(rows))
        guess = F.when(F.col("_predicted") == 1, BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_verdict", guess).alias("verdict"))
