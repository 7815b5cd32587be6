"""Language identification by Bayesian evidence fusion.

The likelihood of a page's words is combined with its declared markup language, its address suffix and a
prior of its host. What the declared languages and suffixes say is learnt by grouped aggregation from the
other pages' text: a page's own text counts once, as its own likelihood. Host priors are smoothed towards their domain's, and those
towards the whole table's, without the page as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import hash_sample, left_join_any, scratch, words, written
from .url_filter import split_url

#: Labelled texts that train the word model, about, and its most frequent words; the others say nothing about a text's language.
SAMPLE_TEXTS, VOCABULARY = 20_000, 30_000
#: A text's log likelihood counts as so many words' at most: words of one text aren't independent.
EFFECTIVE_WORDS = 30
SMOOTHING, HOST_WEIGHT = 1.0, 10.0


def lower_words(text: Column) -> Column:
    return words(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\p{L}\\p{M}']+", " ")))


def visible_text(html: Column) -> Column:
    """A page's text: no scripts, styles, comments, tags or entities."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<!--.*?-->|<(script|style)\\b.*?</\\1\\s*>|<[^>]*>", " ")
    return F.regexp_replace(bare, "&#?[A-Za-z0-9]{1,10};", " ")


def declared_language(html: Column) -> Column:
    """The primary subtag of the html element's lang, lower-cased, or empty."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]{2,8})", 1))


def address_suffix(host: Column, path: Column) -> Column:
    """The top-level label, with a first path segment of two letters if there is one: com, com/fr."""
    return F.concat(F.substring_index(host, ".", -1), F.lower(F.regexp_extract(path, "^(/[A-Za-z]{2})(?:/|$)", 1)))


@dataclass(frozen=True)
class WordModel:
    languages: list[str]
    words: list[str]
    table: np.ndarray  # (words, languages): log probabilities


def train_words(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_TEXTS, vocabulary: int = VOCABULARY) -> WordModel:
    """Word probabilities by language from about `sample` labelled texts, drawn by a hash."""
    chosen = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    chosen = hash_sample(chosen, sample, chosen.count(), "text")
    counts = chosen.select("lang", F.explode_outer(lower_words(F.col("text"))).alias("word")).filter("word IS NOT NULL").groupBy("word", "lang").count()
    kept = counts.groupBy("word").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by")).orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    languages = sorted({x for r in kept for x in r["by"]})
    table = np.full((len(kept), len(languages)), 0.5)
    for k, r in enumerate(kept):
        for x, n in r["by"].items():
            table[k, languages.index(x)] += n
    if len(kept):
        table = np.log(table / table.sum(axis=0))
    return WordModel(languages, [r["word"] for r in kept], table)


def _text_evidence(model: WordModel):
    """A task that replaces the words in the last column by the log likelihoods of the languages, the greatest being 0; words that the
    model doesn't know are left out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, width = pa.array(model.words, pa.string()), len(model.languages)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            at = pc.fill_null(pc.index_in(lists.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[at >= 0]
            at = at[at >= 0]
            known = np.bincount(rows, minlength=batch.num_rows)
            total = np.stack([np.bincount(rows, weights=model.table[at, k], minlength=batch.num_rows) for k in range(width)], axis=1)
            total *= np.where(known > EFFECTIVE_WORDS, EFFECTIVE_WORDS / np.maximum(known, 1), 1.0)[:, None]
            total -= total.max(axis=1, keepdims=True)
            ends = pa.array(np.arange(0, (batch.num_rows + 1) * width, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], names=batch.schema.names)

    return task


def _counts(rows: DataFrame, key: str, name: str, languages: list[str]) -> DataFrame:
    """(key, <name>: the key's pages by their text's language), null keys left out."""
    counted = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(F.col("text_lang") == x).alias(f"n{k}") for k, x in enumerate(languages)])
    return counted.select(key, F.array(*[f"n{k}" for k in range(len(languages))]).alias(name))


def identified(pages: DataFrame, model: WordModel, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """One row for each page: page_id, lang, confidence, and the evidence text_lang, declared, suffix and host.

    Null or empty pages have no text evidence; the rest decides, in the end the language most common in the table. Ties
    go to the first language in order. Without any trained language lang is null. Repeated rows are judged each.
    """
    languages = model.languages
    host, path = split_url(F.col(f"`{url}`"))
    source = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"), declared_language(F.col(f"`{html}`")).alias("declared"), lower_words(visible_text(F.col(f"`{html}`"))).alias("evidence"))
    source = source.select("page_id", "host", F.substring_index("host", ".", -2).alias("domain"), address_suffix(F.col("host"), F.col("path")).alias("suffix"), "declared", "evidence")
    if not languages:
        return source.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host")
    names = F.array(*[F.lit(x) for x in languages])
    schema = source.drop("evidence").schema.add("evidence", ArrayType(DoubleType()))
    best_text = F.when(F.array_min("evidence") < 0, F.element_at(names, F.array_position("evidence", F.array_max("evidence")).cast("int")))
    folder = scratch(pages.sparkSession)
    rows = written(source.mapInArrow(_text_evidence(model), schema).withColumn("text_lang", best_text), folder, "text")

    count = range(len(languages))
    whole = rows.agg(*[F.count_if(F.col("text_lang") == x).alias(f"n{k}") for k, x in enumerate(languages)], *[F.countDistinct(F.nullif(x, F.lit(""))).alias(f"kinds_{x}") for x in ("declared", "suffix")]).first()
    own = [F.coalesce((F.col("text_lang") == x).cast("int"), F.lit(0)) for x in languages]
    keyed = base = rows.withColumns({f"_{x}": F.nullif(x, F.lit("")) for x in ("declared", "suffix")})
    for key, name in (("host", "of_host"), ("domain", "of_domain"), ("_declared", "of_declared"), ("_suffix", "of_suffix")):
        keyed = left_join_any(keyed, written(_counts(base, key, name, languages), folder, name), key)

    def others(name: str, k: int) -> Column:
        """The pages of language k with this page's key, without this page."""
        return F.coalesce(F.get(name, F.lit(k)), F.lit(0)) - own[k]

    def total(column) -> Column:
        return sum((column(k) for k in count), F.lit(0))

    rest = [F.lit(whole[f"n{k}"]) - own[k] for k in count]
    all_rest = sum(rest, F.lit(0))
    score = []
    for k in count:
        prior = (rest[k] + SMOOTHING) / (all_rest + SMOOTHING * len(languages))
        for name in ("of_domain", "of_host"):
            prior = (others(name, k) + HOST_WEIGHT * prior) / (total(lambda j, name=name: others(name, j)) + HOST_WEIGHT)
        found = F.get("evidence", F.lit(k)) + F.log(prior)
        for x in ("declared", "suffix"):
            share = (others(f"of_{x}", k) + SMOOTHING) / (rest[k] + SMOOTHING * (whole[f"kinds_{x}"] + 1))
            found = found + F.when(F.col(f"_{x}").isNull(), 0.0).otherwise(F.log(share))
        score.append(found)
    scored = keyed.withColumn("score", F.array(*score)).withColumn("most", F.array_max("score"))
    spread = F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    lang = F.element_at(names, F.array_position("score", F.col("most")).cast("int"))
    return scored.select("page_id", lang.alias("lang"), F.round(1 / spread, 6).alias("confidence"), "text_lang", "declared", "suffix", "host")
