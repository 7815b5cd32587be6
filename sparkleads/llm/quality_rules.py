"""Quality rules as a short-circuit cascade.

Each rule is a Boolean expression over the text (true: reject). A bounded sample gives each
rule's cost and rejection rate; rules then run in the order of rejection per cost, each only on
rows that all before it passed. Rules differ in cost: some compare statistics that are there anyway, others
read the whole text.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, scratch, words, written

#: Rows, about, of the sample that costs and rejections are measured on, and runs of each measurement; the fastest counts.
SAMPLE, RUNS = 2000, 3


@dataclass(frozen=True)
class QualityRule:
    name: str
    rejects: Column


def measure(sample: DataFrame, rules: list[QualityRule], runs: int = RUNS) -> list[tuple[QualityRule, float, float]]:
    """(rule, seconds, share rejected) of each rule over a bounded sample. What a job takes that only counts rows is subtracted."""

    def fastest(condition: Column) -> tuple[float, int, int]:
        found = []
        for _ in range(runs):
            began = time.perf_counter()
            row = sample.agg(F.count("*").alias("n"), F.count_if(condition).alias("bad")).first()
            found.append((time.perf_counter() - began, row["n"], row["bad"]))
        return min(found)

    empty = fastest(F.col(sample.columns[0]).isNull())[0]
    timed = [(rule, *fastest(rule.rejects)) for rule in rules]
    return [(rule, max(seconds - empty, 1e-4), bad / max(1, n)) for rule, seconds, n, bad in timed]


def ordered(df: DataFrame, rules: list[QualityRule], key: str = "doc_id", rows: int = SAMPLE) -> list[QualityRule]:
    """The rules by rejection per cost, highest first, as about `rows` rows show them that a hash of `key` draws from all of `df`.
    The order changes what is computed, never which rows are kept."""
    sample = written(hash_sample(df, rows, df.count(), key), scratch(df.sparkSession), "sample")
    return [r for r, cost, bad in sorted(measure(sample, rules), key=lambda x: (-x[2] / x[1], x[0].name))]


def cascade(df: DataFrame, rules: list[QualityRule], out: str = "rejected_by") -> DataFrame:
    """Adds `out`: the first rule, in the given order, that rejects the row, else null. Later rules aren't evaluated.
    A rule that is null on a row doesn't reject it."""
    if not rules:
        return df.withColumn(out, F.lit(None).cast("string"))
    chain = F.when(rules[0].rejects, F.lit(rules[0].name))
    for rule in rules[1:]:
        chain = chain.when(rule.rejects, F.lit(rule.name))
    return df.withColumn(out, chain)


#: Columns that `cheap_statistics` adds.
CHEAP = ["n_symbols", "word_chars", "n_dup_lines", "n_words"]


def cheap_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols and n_dup_lines of the whole text, and _hashes of its words.

    Null and empty texts have zero of each. Input columns with these names are replaced.
    """
    c = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(c, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    sized = df.withColumns({
        "n_symbols": F.regexp_count(c, F.lit("[#*$%&|<>]")).cast("long"),
        "_lines": lines,
        "_words": words(F.col(f"`{text}`")),
    })
    counted = sized.withColumns({
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_words": F.size("_words").cast("long"), "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    return counted.drop("_lines", "_words")


def with_repeats(df: DataFrame) -> DataFrame:
    """Replaces _hashes by n_repeat_words, the words in windows of three that occur twice or more. Windows are compared by 64-bit hashes, one
    text at a time; only texts with an equal pair have theirs sorted."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("_hashes", "_windows", "_placed", "_at", "n_repeat_words")]
    h = F.col("_hashes")
    windows = F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), 1, F.greatest(F.size(h) - 2, F.lit(0)))
    hashed = df.select(*rest, windows.alias("_windows"))
    placed = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    sorted_ = hashed.select(*rest, F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed).otherwise(none).alias("_placed"))
    near = F.col("_placed")
    repeated = F.filter(near, lambda x, i: (x["h"] == F.get(near, i - 1)["h"]) | (x["h"] == F.get(near, i + 1)["h"]))
    at = sorted_.select(*rest, F.array_sort(F.transform(repeated, lambda x: x["p"])).alias("_at"))
    # A window covers three words, or as many as there are up to the next one.
    steps = F.zip_with("_at", F.slice("_at", 2, 1 << 30), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3))))
    return at.select(*rest, F.aggregate(steps, F.lit(0), lambda s, n: s + n).cast("long").alias("n_repeat_words"))


def judged(df: DataFrame, rules: list[QualityRule], text: str = "text") -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by and kept; the text isn't returned.

    Rules run over the text and the cheap statistics, in the given order, before the repeated words are counted; a text fails
    the base if it has few words or many repeated ones. Columns of these names are replaced. Repeated rows are judged each; an
    empty table has no rows.
    """
    rest = [c for c in df.columns if c not in (*CHEAP, text, "n_repeat_words", "base_failed", "rejected_by", "kept")]
    ruled = cascade(cheap_statistics(df, text), rules).select(*[F.col(f"`{c}`") for c in rest], *CHEAP, "rejected_by", "_hashes")
    counted = with_repeats(ruled).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", F.col("rejected_by").isNull() & ~F.col("base_failed"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def production_rules(text: str = "text") -> list[QualityRule]:
    """Rules over `cheap_statistics` and the text; thresholds are in whole numbers, so that they hold exactly.

    The first five compare statistics. The others read the text: letters are rare among the characters of words, most letters are
    upper-case, most are digits, or hardly any two words differ.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    c = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def times(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern))

    return [
        QualityRule("few_words", n < 50),
        QualityRule("symbols", 20 * F.col("n_symbols") > n),
        QualityRule("short_words", chars < 2 * n),
        QualityRule("long_words", chars > 25 * n),
        QualityRule("repeated_lines", 10 * F.col("n_dup_lines") > n),
        QualityRule("few_letters", 2 * times("\\p{L}") < chars),
        QualityRule("upper_case", 2 * times("\\p{Lu}") > times("\\p{L}")),
        QualityRule("digits", 3 * times("[0-9]") > chars),
        QualityRule("few_kinds", 20 * F.size(F.array_distinct("_hashes")) < n),
    ]
