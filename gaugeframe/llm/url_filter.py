"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained from a small labelled table and its weights, one number for each of
``BINS`` hash bins, become a constant array in the scoring expression. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_examples import examples

BINS, SIZES = 4096, (3, 4, 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path; both empty without one or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """Distinct hash bins of the character n-grams of host and path, hashed with different seeds."""
    text = lambda kind, part: F.concat(F.lit(kind), part, F.lit("$"))
    # a lookahead matches at every place, so all n-grams come from one pass
    found = [F.regexp_extract_all(text(kind, part), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for kind, part in (("h^", host), ("p^", path)) for n in SIZES]
    seeded = lambda seed: lambda x: F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(BINS)).cast("int")
    return F.array_distinct(F.concat(*(F.transform(g, seeded(k // len(SIZES))) for k, g in enumerate(found))))


def train(spark: SparkSession, table: DataFrame | None = None, ridge: float = 0.0005) -> tuple[list[float], float]:
    """Weights by hash bin and the intercept, from a small table of (url, label); 1 means block.

    Null labels are left out. Without both labels the weights are 0 and the intercept gives the
    label that there is; without any, 0.
    """
    if table is None:
        rows = F.array(*(F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in examples()))
        table = spark.range(1).select(F.inline(rows))
    table = table.where("label in (0, 1)").select(F.col("label").cast("double").alias("label"), grams(*host_and_path(F.col("url"))).cast("array<string>").alias("grams"))
    kinds = {r["label"] for r in table.select("label").distinct().collect()}
    if len(kinds) < 2:
        return [0.0] * BINS, {frozenset([1.0]): 5.0, frozenset([0.0]): -5.0}.get(frozenset(kinds), 0.0)
    bins = CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=BINS, binary=True).fit(table)
    rows = Normalizer(inputCol="counts", outputCol="features").transform(bins.transform(table)).select("label", "features").coalesce(1)
    model = LogisticRegression(maxIter=40, regParam=ridge, standardization=False).fit(rows)
    weights = [0.0] * BINS
    for name, weight in zip(bins.vocabulary, model.coefficients):
        weights[int(name)] = float(weight)
    return weights, float(model.intercept)


def probability(found: Column, weights: Sequence[float], intercept: float) -> Column:
    """The probability that a page with these n-grams is one to block."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a constant
    total = F.aggregate(found, F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    return 1 / (1 + F.exp(-(F.coalesce(F.try_divide(total, F.sqrt(F.size(found))), F.lit(0.0)) + intercept)))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, or null; among equally long, one that blocks."""
    fits = None
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:])):
        this = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(this, value) if fits is None else fits.when(this, value)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: tuple[list[float], float] | None = None) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``block_probability``.

    The verdict is the rule's where one fits, else the regression's (block from 0.5 on). Null, empty
    and odd urls have an empty host and path, fit no rule and get the regression's answer for no text.
    Repeated rows and null ids come back as they are; further columns are ignored.
    """
    model = model or train(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("block_probability", probability(grams(F.col("host"), F.col("path")), *model))
    verdict = F.coalesce("fit.verdict", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "block_probability")
