"""URL filter: rules first, then gradient-boosted trees on lexical features.

The trees are trained from labelled URLs, on a bounded sample. Suffix statistics, the smoothed share of blocked URLs by top-level label, by that and
the path's first segment, and by domain, are grouped aggregates over all
labelled URLs. Hosts are dealt to folds, and a URL that trains the trees has its statistics from the other folds, so that no label,
nor one of its own host, tells on itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hash_sample, scratch, small, written

# The rules, as (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Labelled URLs that train the trees, about; drawn by a hash.
SAMPLE = 20_000
TREES, DEPTH, SMOOTHING, FOLDS = 20, 4, 5.0, 5

NUMERIC = ["url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio", "hyphens", "longest_label", "vowel_ratio", "entropy", "parameters", "has_fragment", "suffix_rate", "section_rate", "domain_rate"]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ://, up to / ? # or the end, A-Z lower-cased; then up to ? or #. Without :// both are empty."""
    c = F.coalesce(url, F.lit(""))
    at = F.instr(c, "://")
    rest = F.when(at > 0, F.substring(c, at + 3, F.char_length(c))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and begins the path; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decides, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rule_path = name.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rule_path))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(decides)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty one."""
    n = F.char_length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda x: F.when(x == "", F.lit(0.0)).otherwise((n - F.char_length(F.replace(text, x, F.lit("")))) / n))
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))


def lexical(df: DataFrame, url: str) -> DataFrame:
    """Adds host, path, suffix, domain and the lexical features of `url`; null URLs are empty."""
    c = F.coalesce(F.col(url), F.lit(""))
    host, path = split_url(F.col(url))
    base = df.withColumns({"host": host, "path": path})
    n, h = F.greatest(F.char_length(c), F.lit(1)), F.greatest(F.char_length("host"), F.lit(1))

    def times(text: Column, chars: str) -> Column:
        return F.char_length(text) - F.char_length(F.translate(text, chars, ""))

    made = {
        "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
        "section": F.concat(F.substring_index("host", ".", -1), F.regexp_extract("path", "^/[^/]*", 0)),
        "url_length": F.char_length(c), "host_length": F.char_length("host"), "path_length": F.char_length("path"),
        "host_depth": times(F.col("host"), "."), "path_depth": times(F.col("path"), "/"),
        "digit_ratio": times(c, "0123456789") / n, "host_digit_ratio": times(F.col("host"), "0123456789") / h,
        "hyphens": times(F.col("host"), "-"), "longest_label": F.array_max(F.transform(F.split("host", "[.]"), lambda x: F.char_length(x))),
        "vowel_ratio": times(F.col("host"), "aeiou") / h,
        "entropy": entropy(F.substring(c, 1, 1 << 30)),
        "parameters": F.when(F.contains(c, F.lit("?")), 1 + times(F.substring_index(c, "?", -1), "&")).otherwise(0), "has_fragment": F.contains(c, F.lit("#")).cast("int"),
    }
    return base.withColumns(made)


@dataclass
class UrlModel:
    suffixes: DataFrame
    sections: DataFrame
    domains: DataFrame
    rate: float
    trees: GBTClassificationModel | None


def _with_rates(df: DataFrame, suffixes: DataFrame, sections: DataFrame, domains: DataFrame, rate: float) -> DataFrame:
    out = df.join(small(suffixes), "suffix", "left").join(small(sections), "section", "left").join(small(domains), "domain", "left")
    of_suffix = F.coalesce("suffix_rate", F.lit(rate))
    return out.withColumns({"suffix_rate": of_suffix, "section_rate": F.coalesce("section_rate", of_suffix), "domain_rate": F.coalesce("domain_rate", of_suffix)})


def _assembled(df: DataFrame) -> DataFrame:
    doubles = df.withColumns({c: F.col(c).cast("double") for c in NUMERIC})
    return VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(doubles)


def out_of_fold(chosen: DataFrame, rows: DataFrame, rate: float) -> DataFrame:
    """`chosen` (suffix, section, domain, fold) with the smoothed shares of blocked URLs among `rows` of the other folds."""
    out = chosen
    for key, name in (("suffix", "suffix_rate"), ("section", "section_rate"), ("domain", "domain_rate")):
        folds = rows.groupBy(key, "fold").agg(F.sum("blocked").alias("b"), F.count("*").alias("n"))
        whole = folds.groupBy(key).agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"))
        # A key without rows of the chosen row's fold has the statistics of all.
        share = (F.col("all_b") - F.coalesce("b", F.lit(0.0)) + SMOOTHING * rate) / (F.col("all_n") - F.coalesce("n", F.lit(0)) + SMOOTHING)
        out = out.join(whole, key, "left").join(folds, [key, "fold"], "left")
        out = out.withColumn(name, F.when(F.col("all_n") > F.coalesce("n", F.lit(0)), share)).drop("all_b", "all_n", "b", "n")
    of_suffix = F.coalesce("suffix_rate", F.lit(rate))
    return out.withColumns({"suffix_rate": of_suffix, "section_rate": F.coalesce("section_rate", of_suffix), "domain_rate": F.coalesce("domain_rate", of_suffix)})


def train(labelled: DataFrame, url: str = "url", sample: int = SAMPLE) -> UrlModel:
    """From rows of `url` and `blocked` (0 or 1). With one label only, or no row, there are no trees and the rate decides.
    Each label has about half of the sample, so that a rare one is learnt too; the other weighs so much the more."""
    folder = scratch(labelled.sparkSession)
    features = lexical(labelled.select(url, F.col("blocked").cast("double").alias("blocked")), url)
    rows = written(features.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")), folder, "labelled")
    whole = rows.agg(F.avg("blocked").alias("rate"), F.sum("blocked").alias("blocked"), F.count("*").alias("n")).first()
    rate, blocked = float(whole["rate"] or 0.0), int(whole["blocked"] or 0)

    def rates(key: str, out: str) -> DataFrame:
        share = (F.sum("blocked") + SMOOTHING * rate) / (F.count("*") + SMOOTHING)
        return written(rows.groupBy(key).agg(share.alias(out)), folder, out)

    tables = rates("suffix", "suffix_rate"), rates("section", "section_rate"), rates("domain", "domain_rate")
    if blocked in (0, whole["n"]):
        return UrlModel(*tables, rate, None)
    distinct = written(rows.groupBy([c for c in rows.columns]).agg(F.count("*").alias("copies")), folder, "distinct")
    sizes = {r["blocked"]: r["n"] for r in distinct.groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    halves = [hash_sample(distinct.filter(F.col("blocked") == label), sample // 2, n, url).withColumn("weight", F.col("copies") * max(1.0, n / (sample // 2))) for label, n in sizes.items()]
    chosen = written(halves[0].unionByName(halves[1]), folder, "chosen")
    ready = written(_assembled(out_of_fold(chosen, rows, rate)).select("features", "blocked", "weight"), folder, "sample").coalesce(1)
    trees = GBTClassifier(labelCol="blocked", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(ready)
    return UrlModel(*tables, rate, trees)


def judged(pages: DataFrame, model: UrlModel, url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Every row of `pages` with host, path, rule, block_probability and verdict: the rule's, else the trees'.

    Null URLs and those without :// have an empty host and path and are judged by the trees like others.
    Repeated rows are judged each; columns of `pages` with the names of the added or the lexical columns are left out.
    """
    pages = pages.drop(*({*NUMERIC, "host", "path", "rule", "verdict", "block_probability", "suffix", "section", "domain", "features", "rawPrediction", "probability", "prediction"} - {url}))
    rows = _with_rates(lexical(pages, url), model.suffixes, model.sections, model.domains, model.rate)
    if model.trees is None:
        scored = rows.withColumn("block_probability", F.lit(model.rate))
    else:
        scored = model.trees.transform(_assembled(rows)).withColumn("block_probability", F.element_at(vector_to_array("probability"), 2))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_trees = F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_trees)}).select(*pages.columns, "host", "path", "rule", "verdict", "block_probability")
