"""Text functions: normal forms, tokens, n-grams, signatures, scripts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that say nothing about a title.
STOPWORDS = """a about after again all also am an and any are as at be because been before being but by can could did do does
doing for from had has have having he her here hers him his how i if in into is it its just me more most my new no not now of off on
once only or other our out over own same she should so some such than that the their them then there these they this those
through to too under until up very was we were what when where which while who why will with would you your""".split()


#: Names under which Spark ML has lists of stopwords, by language tag.
STOPWORD_LISTS = {"da": "danish", "nl": "dutch", "fi": "finnish", "fr": "french", "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish"}


def stopwords_for(languages: Iterable[str | None] = ()) -> list[str]:
    """STOPWORDS, and for each language other than English Spark ML's list, if there is one. The English list is short on purpose: longer ones hold words of themes."""
    found = set(STOPWORDS)
    for tag in languages:
        name = STOPWORD_LISTS.get((tag or "").lower().replace("_", "-").split("-")[0])
        if name:
            found |= set(StopWordsRemover.loadDefaultStopWords(name))
    return sorted(found)


def _form(name: str):
    @F.pandas_udf(StringType())
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize(name, x), na_action="ignore")

    return form


_NFKC, _NFKD = _form("NFKC"), _form("NFKD")


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def _only_beyond_ascii(c: Column, change, otherwise) -> Column:
    """`change` sees only texts beyond ASCII; the others stay in the JVM."""
    return F.coalesce(change(F.when(c.rlike("[^\\x00-\\x7F]"), c)), otherwise(c))


def nfkc(c: Column) -> Column:
    return _only_beyond_ascii(c, _NFKC, lambda x: x)


def nfkd(c: Column) -> Column:
    return _only_beyond_ascii(c, _NFKD, lambda x: x)


def casefold(c: Column) -> Column:
    return _only_beyond_ascii(c, _casefold, F.lower)


def normalize_title(c: Column) -> Column:
    """Comparable form of a title: compatibility form, no symbols and format characters, hashtags, brackets or one trailing segment
    after a bar or dot; folded case; everything but letters and digits a space."""
    t = F.regexp_replace(nfkc(c), "[\\p{So}\\p{Cf}\\p{Sk}]+", "")
    t = F.regexp_replace(t, "#[\\p{L}\\p{N}_]+", " ")
    t = F.regexp_replace(t, "\\[[^\\]]*\\]|\\([^)]*\\)|\\{[^}]*\\}", " ")
    t = F.regexp_replace(t, "\\s*[|·]\\s*[^|·]{1,40}$", "")
    return F.trim(F.regexp_replace(casefold(t), "[^\\p{L}\\p{N}]+", " "))


def normalize_text(c: Column) -> Column:
    """Form that rules match: lower case, no possessive 's, no apostrophes, everything but 0-9 and a-z one space."""
    t = F.regexp_replace(F.lower(c), "['’]s(?![0-9a-z])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "['’]", ""), "[^0-9a-z]+", " "))


def tokens(c: Column, stopwords: list[str] = STOPWORDS, ascii_only: bool = False) -> Column:
    """Words of a title: lower-cased, no punctuation, stopwords, single characters or words with digits. None for null. Where the caller knows that
    texts are `ascii_only` no row goes to Python."""
    text = F.coalesce(c, F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(F.lower(text if ascii_only else nfkc(text)), "_", " "), "[^\\p{L}\\p{N}\\s]+", " ")
    found = F.filter(F.split(F.trim(plain), "\\s+"), lambda w: (F.char_length(w) > 1) & ~w.rlike("[0-9]"))
    return F.filter(found, lambda w: ~w.isin(stopwords)) if stopwords else found


def ngrams(word_list: Column, least: int = 1, most: int = 3) -> Column:
    """The distinct runs of `least` to `most` words, joined by spaces. `word_list` must be a column, not an expression with a UDF."""
    def of(n: int) -> Column:
        starts = F.when(F.size(word_list) >= n, F.sequence(F.lit(1), F.size(word_list) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(word_list, i, n), " "))
    return F.array_distinct(F.concat(*[of(n) for n in range(least, most + 1)]))


def signature(word_list: Column) -> Column:
    """Sorted distinct words: equal for titles that differ in order only."""
    return F.array_join(F.array_sort(F.array_distinct(word_list)), " ")


#: Letters, marks and digits of any script but Latin and those that scripts share.
_FOREIGN = "[[\\p{L}\\p{M}\\p{N}]&&[^\\p{IsLatin}\\p{IsCommon}\\p{IsInherited}]]"
SCRIPT_CHARACTERS = 3


def foreign_script_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(_FOREIGN))


def carries_foreign_script(c: Column) -> Column:
    return foreign_script_count(c) >= SCRIPT_CHARACTERS


def fold_ascii(c: Column) -> Column:
    """Decomposed and lower-cased, without what is beyond ASCII."""
    return F.lower(F.regexp_replace(nfkd(c), "[^\\x00-\\x7F]+", ""))


def marker_tokens(c: Column) -> Column:
    """Words of ASCII letters and inner apostrophes, three characters at least."""
    found = F.regexp_extract_all(F.coalesce(fold_ascii(c), F.lit("")), F.lit("[a-z][a-z']*"), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: F.char_length(w) >= 3)
