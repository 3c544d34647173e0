"""URL filters: host and path rules, and a logistic regression for the rest.

The features of a url are its host's and path's character n-grams, hashed to a fixed
number of bins; the model is fitted by Spark ML on a small labelled table of urls.
Everything stays within Spark's own expressions.

Defined results: a null url, or one without `://`, has empty host and path and is
judged by the model like any other; with labels of one kind only, every url gets that
verdict; with none, `allow`.  Repeated urls are judged alike.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of (rule, verdict) that fits, and its verdict; nulls if none does. A rule is a host and what the path begins with."""
    found = None
    for text, judged in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        pair = F.struct(F.lit(text).alias("rule"), F.lit(judged).alias("verdict"))
        found = F.when(fits, pair) if found is None else found.when(fits, pair)
    if found is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return found.getField("rule"), found.getField("verdict")


def _grams(text: Column, sizes: tuple[int, ...], mark: str) -> Column:
    def run(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), *(F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(n))))

    # the text is split once: within the inner lambdas `chars` is a variable, not the split, which would be done again for each character
    chars = F.array(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""))
    return F.get(F.transform(chars, lambda c: F.concat(*(run(c, n) for n in sizes))), F.lit(0))


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Character n-grams of host and path, each marked with where it is from."""
    return F.concat(*(_grams(text, sizes, mark) for mark, text in (("h", host), ("p", path))))


def _features(urls: DataFrame, bins: int) -> DataFrame:
    hashed = HashingTF(numFeatures=bins, binary=True, inputCol="grams", outputCol="features")
    return hashed.transform(urls.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")


def classify(urls: DataFrame, labelled: DataFrame, bins: int = 1 << 14, iterations: int = 20, ridge: float = 1e-4) -> DataFrame:
    """urls (host, path and any other columns) with `p_block`, the model's probability. labelled: a small table of host, path and blocked (boolean)."""
    labelled = labelled.where(F.col("blocked").isNotNull())
    kinds = [r.blocked for r in labelled.select("blocked").distinct().collect()]
    if len(kinds) < 2:
        return urls.withColumn("p_block", F.lit(1.0 if kinds == [True] else 0.0))
    train = _features(labelled.select("host", "path", F.col("blocked").cast("double").alias("label")), bins)
    model = LogisticRegression(maxIter=iterations, regParam=ridge).fit(train)
    kept = urls.select("host", "path", F.struct(*urls.columns).alias("row"))
    judged = model.transform(_features(kept, bins))
    return judged.select("row.*", vector_to_array("probability").getItem(1).alias("p_block"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every page. Without a labelled table, at most `rows` urls that rules judge (by a hash of host and path) make it."""
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "said": said})
    if labelled is None:
        known = urls.where("rule is not null").select("host", "path", (F.col("said") == "block").alias("blocked"), F.xxhash64("host", "path").alias("turn"))
        labelled = bounded_sample(known, "turn", rows).drop("turn")
    out = classify(urls, labelled)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("p_block") > threshold, "block").otherwise("allow")).alias("verdict"), "p_block")
