"""Labels for URLs from what their pages hold, so that a URL model learns from evidence and not from a list of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words
from .language_id import visible_text
from .url_filter import RULES, rule_for, split_url

#: A page is blocked if its visible words are fewer, or a share passes its bound: of symbols and exclamation marks to words, of upper-case characters, of
#: words said before, of links to words.
LEAST_WORDS, MOST_SYMBOLS, MOST_UPPER, MOST_REPEATED, MOST_LINKS = 20, 0.2, 0.4, 0.8, 0.5


def page_signs(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """`keep`, and n_words, symbols, upper, repeated and links of each page's visible text. Null pages have no words, and 0 for every share."""
    text = pages.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("_html"), F.explode_outer(F.array(visible_text(F.col(html)))).alias("_text"))
    seen = text.select(*keep, "_html", "_text", F.explode_outer(F.array(F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)))).alias("_words"))
    n = F.size("_words")
    some = F.greatest(n, F.lit(1))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    return seen.select(
        *keep, n.alias("n_words"), (count(F.col("_text"), "[#*$%&|<>!]") / some).alias("symbols"), (count(F.col("_text"), "\\p{Lu}") / F.greatest(F.char_length("_text"), F.lit(1))).alias("upper"),
        F.when(n > 0, 1 - F.size(F.array_distinct("_words")) / some).otherwise(0.0).alias("repeated"),
        (count(F.col("_html"), "(?i)<a\\s") / some).alias("links"),
    )


def labelled(pages: DataFrame, url: str = "url", html: str = "html", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(url, blocked) of every page: what a rule says of its URL, else 1 for a page whose visible text is too short, shouted, repetitive, or mostly symbols or links, else 0.
    Null URLs are labelled by their page; repeated rows each."""
    signs = page_signs(pages, [url], html)
    host, path = split_url(F.col(url))
    bad = (F.col("n_words") < LEAST_WORDS) | (F.col("symbols") > MOST_SYMBOLS) | (F.col("upper") > MOST_UPPER) | (F.col("repeated") > MOST_REPEATED) | (F.col("links") > MOST_LINKS)
    _, verdict = rule_for(F.col("_host"), F.col("_path"), rules)
    rows = signs.withColumns({"_host": host, "_path": path})
    return rows.select(url, F.when(verdict == "block", 1).when(verdict == "allow", 0).otherwise(bad.cast("int")).alias("blocked"))
