"""Exclusion rules: every term of a rule must occur in the pooled fields; any rule excludes.

Pooled fields in normal form are words with one space between, so a term is a piece of text with a space before it and, unless it is a stem, one after it. A few rules
are looked for directly, over pooled text made once for each set of fields. Many go through an inverted index: each rule hangs on its rarest word in the
corpus, or on a stem if it has no whole word; an equal join with the words of the rows, and with their prefixes of the lengths that such stems have,
brings the candidates, and only these are looked through for all terms.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .latest import top_per_key
from .settle import settled, small

SCOPES = ("leads", "corpus")
STEM_CHARACTERS = 3
#: Rules that are looked for directly; more go through the index.
DIRECT = 32


def normal_term(term: str) -> str:
    """Lower case, without possessives and apostrophes, one space between words; a trailing * (a stem) stays."""
    stem = term.strip().endswith("*")
    text = re.sub(r"['’]s(?![0-9a-z])", "", term.lower())
    text = re.sub(r"[^0-9a-z]+", " ", re.sub(r"['’]", "", text)).strip()
    return f"{text}*" if stem and text else text


def needle(term: str) -> str:
    """What a padded normal text holds if it has the term: whole words, the last one any that begins with it if the term is a stem."""
    text = normal_term(term)
    stem, bare = text.endswith("*"), text.rstrip("*").strip()
    if not bare or (stem and len(bare) < STEM_CHARACTERS):
        raise ValueError(f"term {term!r} is empty or its stem too short")
    return f" {' '.join(bare.split())}" + ("" if stem else " ")


@dataclass(frozen=True)
class Rule:
    terms: tuple[str, ...]
    scope: str = "leads"
    fields: tuple[str, ...] = ("title",)
    note: str = ""
    added: str | None = None
    rule_id: str = field(init=False, default="")

    def __post_init__(self) -> None:
        normal = tuple(sorted({normal_term(t) for t in self.terms} - {""}))
        if not normal or self.scope not in SCOPES or not self.fields:
            raise ValueError(f"not a rule: {self}")
        for t in normal:
            needle(t)
        object.__setattr__(self, "terms", normal)
        object.__setattr__(self, "fields", tuple(sorted(set(self.fields))))
        object.__setattr__(self, "rule_id", f"{self.scope}:{'+'.join(self.fields)}:{'&'.join(normal)}")

    def describe(self) -> str:
        return f"{' AND '.join(self.terms)} in {', '.join(self.fields)} ({self.scope})"


def canonical(rules: Sequence[Rule]) -> list[Rule]:
    """Each rule once, by identity, in order of identity."""
    return [r for _, r in sorted({r.rule_id: r for r in rules}.items())]


def for_scope(rules: Sequence[Rule], scope: str) -> list[Rule]:
    return [r for r in canonical(rules) if r.scope == scope]


def add_rule(rules: Sequence[Rule], rule: Rule) -> list[Rule]:
    return canonical([rule, *rules]) if rule.rule_id not in {r.rule_id for r in rules} else canonical(rules)


def remove_rule(rules: Sequence[Rule], rule_id: str) -> list[Rule]:
    return [r for r in canonical(rules) if r.rule_id != rule_id]


def _pool(df: DataFrame, fields: tuple[str, ...]) -> Column:
    """The fields that `df` has, in normal form, with a space on either side."""
    return F.concat(F.lit(" "), normalize_text(F.concat_ws(" \n ", *[F.col(f) for f in fields if f in df.columns])), F.lit(" "))


def _pooled(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, dict[tuple[str, ...], str]]:
    """`df` with a column of pooled text for each set of fields, made once, and their names."""
    names = {fields: f"_pool{k}" for k, fields in enumerate(sorted({r.fields for r in rules}))}
    for fields, name in names.items():
        df = df.select("*", F.explode_outer(F.array(_pool(df, fields))).alias(name))
    return df, names


def _holds(pool: Column, rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(pool, F.lit(needle(t))) for t in rule.terms])


def rule_mask(df: DataFrame, rule: Rule) -> Column:
    return _holds(_pool(df, rule.fields), rule)


def rule_hits(rows: DataFrame, rules: Sequence[Rule], key: str) -> DataFrame:
    """(key, k): the rows, each with its own `key`, that the k-th rule matches. `rows` is settled or cheap to read."""
    pooled, names = _pooled(rows, rules)
    if len(rules) <= DIRECT:
        found = F.array_compact(F.array(*[F.when(_holds(F.col(names[r.fields]), r), F.lit(k)) for k, r in enumerate(rules)]))
        return pooled.select(key, F.explode(found).alias("k"))
    listed = [(k, names[r.fields], [needle(t) for t in r.terms]) for k, r in enumerate(rules)]
    whole = [(k, pool, w) for k, pool, needles in listed for n in needles for w in (n.split() if n.endswith(" ") else n.split()[:-1])]
    stems = {k: (pool, n.split()[-1]) for k, pool, needles in reversed(listed) for n in needles if not n.endswith(" ")}
    spark = rows.sparkSession
    words = spark.createDataFrame(whole, "k int, pool string, word string").distinct()
    seen = F.explode(F.array(*[F.struct(F.lit(name).alias("pool"), F.array_distinct(F.split(F.trim(F.col(name)), " ")).alias("words"), F.col(name).alias("text")) for name in names.values()]))
    tokens = pooled.select(key, seen.alias("_x")).select(key, "_x.*")
    counted = tokens.select("pool", F.explode("words").alias("word")).join(small(words.select("pool", "word").distinct()), ["pool", "word"], "left_semi").groupBy("pool", "word").count()
    rarest = words.join(small(settled(counted)), ["pool", "word"], "left").groupBy("k", "pool").agg(F.min_by("word", F.struct(F.coalesce("count", F.lit(0)), "word")).alias("word"))
    anchored = {k for k, _, _ in whole}
    hung = spark.createDataFrame([(k, pool, f"{stem}*") for k, (pool, stem) in stems.items() if k not in anchored], "k int, pool string, word string")
    needles = spark.createDataFrame([(k, n) for k, _, n in listed], "k int, needles array<string>")
    index = settled(rarest.select("k", "pool", "word").unionByName(hung).join(needles, "k"))
    lengths = sorted({len(stem) for k, (_, stem) in stems.items() if k not in anchored})
    begins = F.flatten(F.transform("words", lambda w: F.array_compact(F.array(*[F.when(F.char_length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in lengths]))))
    keys = F.array_distinct(F.concat("words", begins)) if lengths else F.col("words")
    candidates = tokens.select(key, "pool", "text", F.explode(keys).alias("word")).join(small(index), ["pool", "word"])
    return candidates.filter(F.forall("needles", lambda n: F.contains("text", n))).select(key, "k")


def _with_key(df: DataFrame) -> DataFrame:
    return settled(df.withColumn("_row", F.monotonically_increasing_id()))


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that no rule matches."""
    if not rules:
        return df
    if len(rules) <= DIRECT:
        pooled, names = _pooled(df, rules)
        hit = reduce(lambda a, b: a | b, [_holds(F.col(names[r.fields]), r) for r in rules])
        return pooled.filter(~F.coalesce(hit, F.lit(False))).select(*df.columns)
    rows = _with_key(df)
    return rows.join(rule_hits(rows, rules, "_row").select("_row").distinct(), "_row", "left_anti").select(*df.columns)


def apply_to_results(results: dict[str, DataFrame], rules: Sequence[Rule]) -> dict[str, DataFrame]:
    return {name: apply_rules(df, for_scope(rules, "leads")) for name, df in results.items()}


def with_first_match(df: DataFrame, rules: Sequence[Rule], out: str = "matched_rule") -> DataFrame:
    """Adds the identity of the first rule, in canonical order, that matches; null if none does."""
    listed = canonical(rules)
    if len(listed) <= DIRECT:
        pooled, names = _pooled(df, listed)
        found = [F.when(_holds(F.col(names[r.fields]), r), F.lit(r.rule_id)) for r in listed]
        return pooled.withColumn(out, F.coalesce(*found) if found else F.lit(None).cast("string")).select(*[c for c in df.columns if c != out], out)
    rows = _with_key(df)
    first = rule_hits(rows, listed, "_row").groupBy("_row").agg(F.min("k").alias("k"))
    names_of = df.sparkSession.createDataFrame([(k, r.rule_id) for k, r in enumerate(listed)], f"k int, `{out}` string")
    return rows.drop(out).join(first.join(small(names_of), "k").select("_row", out), "_row", "left").select(*[c for c in df.columns if c != out], out)


def partition(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    matched = with_first_match(df, rules)
    return matched.filter("matched_rule IS NULL").drop("matched_rule"), matched.filter("matched_rule IS NOT NULL")


def reach(df: DataFrame, rules: Sequence[Rule], title: str = "title", examples: int = 3) -> DataFrame:
    """(rule, scope, terms, matched_rows, matched_share, examples) of each rule. Examples are the least titles."""
    listed = canonical(rules)
    rows = _with_key(df.select(title, *sorted({f for r in listed for f in r.fields if f in df.columns} - {title})))
    hit = settled(rule_hits(rows, listed, "_row"))
    counts = hit.groupBy("k").agg(F.count("*").alias("matched_rows"))
    titled = hit.join(rows.select("_row", F.col(title).alias("_title")), "_row").groupBy("k", "_title").count().drop("count")
    shown = top_per_key(titled, ["k"], [F.asc_nulls_last("_title")], examples).groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("_title")), " | ").alias("examples"))
    names = df.sparkSession.createDataFrame([(k, r.rule_id, r.scope, ", ".join(r.terms)) for k, r in enumerate(listed)], "k int, rule string, scope string, terms string")
    total = rows.count()
    matched = F.coalesce("matched_rows", F.lit(0)).cast("long")
    out = names.join(counts, "k", "left").join(shown, "k", "left")
    return out.select("rule", "scope", "terms", matched.alias("matched_rows"), F.coalesce(F.try_divide(matched, F.lit(total)), F.lit(0.0)).alias("matched_share"), F.coalesce("examples", F.lit("")).alias("examples"))
